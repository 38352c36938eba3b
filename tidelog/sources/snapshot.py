"""Table snapshots as synthetic inserts, and their hand-over to the change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import ConfigInvalid, SnapshotMoved
from tidelog.schema import CHANGE_SCHEMA, ROW_TYPE, empty_log, row, table_id

SEQUENCE = "seq"


def snapshot(table: DataFrame, schema: str, name: str, lsn: int, columns: list[str] | None = None) -> DataFrame:
    """Every row of a table as an insert at one LSN; values are text, whatever their type."""
    columns = table.columns if columns is None else columns
    if not columns:
        raise ConfigInvalid(f"{schema}.{name} has no columns")
    return table.select(
        F.lit(lsn).cast("long").alias("lsn"), F.lit(0).cast("long").alias("xid"), F.lit("insert").alias("op"),
        table_id(schema, name).alias("table"), F.lit("0" * 16).alias("schema_fingerprint"),
        row(**{c: F.col(c) for c in columns}).alias("after"), F.lit(None).cast(ROW_TYPE).alias("before"), F.lit(0).cast("long").alias("commit_timestamp_us"),
    )


def snapshot_all(tables: dict[str, DataFrame], lsn: int) -> DataFrame:
    """Snapshots of ``schema.table`` -> rows, one after the other in the order given; other names are left out."""
    found = None
    for name, table in tables.items():
        schema, dot, plain = name.partition(".")
        if dot and "." not in plain:
            own = snapshot(table, schema, plain, lsn)
            found = own if found is None else found.unionByName(own)
    if found is None:
        raise ConfigInvalid("no table to take a snapshot of")
    return found


def pinned(spark: SparkSession, paths: dict[str, str], lsn: int) -> DataFrame:
    """Snapshots of all tables (``schema.table`` -> folder of Parquet files) as they are at one moment.

    All folders are listed first, and each table is read from the files of its listing: what is added later is not seen.
    A file that has gone or has changed since fails the read instead of giving a mixture.
    """
    listed = {name: (path, _listing(spark, path)) for name, path in paths.items()}
    tables = {name: _read(spark, path, list(files)) for name, (path, files) in listed.items() if files}
    if any(_listing(spark, path, files) != files for path, files in listed.values()):
        raise SnapshotMoved("a file has changed while the tables were listed")
    return snapshot_all(tables, lsn)


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    return (spark.read.option("basePath", path) if folder else spark.read).parquet(*files)


def _listing(spark: SparkSession, path: str, only: dict[str, tuple] | None = None) -> dict[str, tuple]:
    """Files below a path with their size and time of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    out = {}
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")) and (only is None or status.getPath().toString() in only):
            out[status.getPath().toString()] = (status.getLen(), status.getModificationTime())
    return out


def splice(snapshot_rows: DataFrame, log: DataFrame, snapshot_lsn: int) -> DataFrame:
    """The snapshot, then the stream from behind it: no change is lost or seen twice."""
    return snapshot_rows.unionByName(log.where(F.col("lsn") > snapshot_lsn))


def fallback(frames: DataFrame) -> DataFrame:
    """What a stream of another output plugin decodes to: nothing."""
    return empty_log(frames.sparkSession)


def exploded(log: DataFrame, image: str = "after") -> DataFrame:
    """A row for each column of each event's row."""
    return log.select("lsn", "op", F.explode(image).alias("c")).select("lsn", "op", F.col("c.name").alias("name"), F.col("c.value").alias("value"))


def log_columns() -> list[str]:
    return CHANGE_SCHEMA.fieldNames()
