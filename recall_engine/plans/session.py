"""Settings of a session by the size of what it reads."""

from __future__ import annotations

#: Bytes of a shuffle partition and of a scan partition that fit the memory of a core with room to spare.
SHUFFLE, SCAN = 128 << 20, 128 << 20


def settings(input_bytes: int, cores: int, shuffled_share: float = 1.0) -> dict[str, str]:
    """Configuration for a job: as many shuffle partitions as its data needs and its cores can use, adaptive re-planning with
    skewed joins, UTC, and Arrow batches small enough for long texts."""
    parts = max(cores, -(-int(input_bytes * shuffled_share) // SHUFFLE))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(max(1 << 20, min(SCAN, input_bytes // max(1, 2 * cores)))),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    }
