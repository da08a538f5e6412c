"""Scanning files as they arrive: the per-file operators on a stream of file rows.

Lines and stateless rules need one file at a time, so they run on a stream as they are; sections over all files are
recomputed for each micro-batch by ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..sources.tables import lines


def stateless_hits(files: DataFrame) -> DataFrame:
    """Hits of the one-line rules of a (streaming) file table."""
    return rules.stateless_hits(rules.with_roles(lines_with_path(files)))


def lines_with_path(files: DataFrame) -> DataFrame:
    """Lines that carry their file's path, so no join is needed on a stream."""
    from pyspark.sql import functions as F

    return files.where("content IS NOT NULL").select("file_id", "rel_path", "ext", F.posexplode(F.split("content", "\n", -1)).alias("line_index", "line"))


def each_batch(files: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``act(batch of file rows, id)`` for every micro-batch; restarts continue from ``checkpoint``."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(act).start()


__all__ = ["each_batch", "lines", "lines_with_path", "stateless_hits"]
