"""Where events come from: snapshots, replication frames, DDL messages, configuration."""
