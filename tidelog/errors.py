"""What can go wrong, by subsystem."""


class TidelogError(Exception):
    """Base of all errors of this package."""


class MalformedLsn(TidelogError):
    """A text that is no LSN."""


class MalformedPayload(TidelogError):
    """Bytes that are no frame or event."""


class ConfigInvalid(TidelogError):
    """A configuration value that is missing or out of range."""


class RuleInvalid(TidelogError):
    """A predicate that cannot be translated."""


class FilterConflict(TidelogError):
    """A subscription that asks for columns that the stream above removed."""


class FingerprintMismatch(TidelogError):
    """An event whose schema is not the registered one."""


class OffsetRegression(TidelogError):
    """A commit below the committed position."""

    def __init__(self, consumer: str, current: int, attempted: int):
        super().__init__(f"{consumer}: {attempted} is below {current}")
        self.consumer, self.current, self.attempted = consumer, current, attempted


class DeliveryFailed(TidelogError):
    """A target answered with a failure."""


class SlotMissing(TidelogError):
    """A stream position that must exist and does not."""


class SnapshotMoved(TidelogError):
    """A table's files changed while a snapshot of several tables was taken."""
