"""Herds: candidates of a file that stand together or share a name; uniform herds are data and no secrets.

A cluster is opened by the first candidate (in harvest order) that has none and takes every later free one with its
identifier or within ``NEAR`` lines of it. Clusters of fewer than ``LEAST`` always pass; others pass if their entropies vary by
``VARIANCE`` or spread over more than ``SPREAD``. Rows stream by in order of file and candidate, so a worker holds the names, lines and entropies of one
file, and each cluster looks only at free candidates of its name and its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S

NEAR, LEAST, VARIANCE, SPREAD = 5, 3, 0.4, 1.5


def clusters(names: list[str | None], lines: list[int]) -> list[list[int]]:
    """Positions of each cluster's candidates."""
    by_name: dict[str, list[int]] = {}
    by_line: dict[int, list[int]] = {}
    for i, (name, line) in enumerate(zip(names, lines)):
        if name:
            by_name.setdefault(name, []).append(i)
        by_line.setdefault(line, []).append(i)
    free, out = [True] * len(names), []
    for seed in range(len(names)):
        if not free[seed]:
            continue
        members = set(by_name.pop(names[seed], ())) if names[seed] else set()
        for line in range(lines[seed] - NEAR, lines[seed] + NEAR + 1):
            members.update(by_line.pop(line, ()))
        mine = sorted({i for i in members if i >= seed and free[i]} | {seed})
        for i in mine:
            free[i] = False
        out.append(mine)
    return out


def judge(entropies: np.ndarray) -> tuple[bool, float | None]:
    """Whether a cluster passes, and its spread where it is a herd."""
    if entropies.size < LEAST:
        return True, None
    spread = float(entropies.max() - entropies.min())
    return float(((entropies - entropies.mean()) ** 2).mean()) >= VARIANCE or spread > SPREAD, spread


def discriminated(candidates: DataFrame) -> DataFrame:
    """Candidates ``(file_id, ord, line_index, identifier_name, value)`` that pass, with ``herd_id, herd_size, herd_ihd`` (null outside herds).

    ``herd_id`` numbers a file's herds in order. Null lines count as line 0; null values are left out.
    """
    schema = "file_id bigint, ord bigint, herd_id int, herd_size int, herd_ihd double"
    ready = candidates.where("value IS NOT NULL").select("file_id", F.col("ord").cast("bigint").alias("ord"), F.coalesce("line_index", F.lit(0)).alias("line"), "identifier_name", S.entropy(F.col("value")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def settle() -> list[tuple]:
            out, herd = [], 0
            entropies = np.array([r[3] for r in rows], float)
            for members in clusters([r[2] for r in rows], [r[1] for r in rows]):
                passes, spread = judge(entropies[members])
                if passes:
                    herd += spread is not None
                    out += [(now, rows[i][0], *((herd, len(members), spread) if spread is not None else (None, None, None))) for i in members]
            return out

        for batch in batches:
            done: list[tuple] = []
            for fid, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if fid != now:
                    if rows:
                        done += settle()
                    now, rows = fid, []
                rows.append(row)
            yield _table(done)
        if rows:
            yield _table(settle())

    passed = ready.repartition("file_id").sortWithinPartitions("file_id", "ord").mapInArrow(run, schema)
    return candidates.join(passed, ["file_id", "ord"])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_id", "ord", "herd_id", "herd_size", "herd_ihd"])
