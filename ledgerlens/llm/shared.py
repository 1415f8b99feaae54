"""Small helpers of the operators here; tables in the shared folder come from the library's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.ordered import steps
from ..sources.scratch import materialise, new_folder

__all__ = ["drop_rows", "materialise", "new_folder", "portions", "shape", "steps", "unused", "width"]


def portions(batches, column: int = 1, most_bytes: int = 1 << 20, rows: int = 256):
    """The rows of Arrow batches in short runs: at most ``rows``, and at most ``most_bytes`` in the text ``column`` unless one row has more.

    Workers so need memory for a run, whatever the session's batch size is;
    batches themselves are bounded in bytes by the session's own setting.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most_bytes, "right"))
            stop = min(max(stop, at + 1), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shape(df: DataFrame) -> StructType:
    """The schema of ``df`` with every column nullable, for functions that return Arrow batches."""
    return StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])


def drop_rows(rows: DataFrame, gone: DataFrame, key: str = "_row", most: int = 500_000) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``gone``; ``gone`` is written and counted first, and broadcast only up to ``most`` keys."""
    gone = materialise(gone.select(F.col(key).alias("_gone")), "gone")
    few = gone.count() <= most
    return rows.join(F.broadcast(gone) if few else gone, rows[key].eqNullSafe(gone["_gone"]), "left_anti")
