"""Frequency of every distinct value (problem 2) by heavy-light aggregation.

1. Bounded frequent-items sketches (built in, merged map-side) over the raw spellings and the records name the heavy
   spellings and the hot records. They only decide routes: counts are exact either way.
2. The normalised terms of the heavy spellings (at most ``HEAVY`` a field) are broadcast as small numbers. A row of a heavy
   spelling gets its number by lookup and is never normalised again; only light spellings are.
3. The one exchange of rows is by record, a hot or missing record spread by item over ``SALTS`` cells. A row then is
   record, item and two small numbers: a heavy term never travels as text. Where they arrive, items are counted once, and rows become
   one row per ``(record, term)`` without another exchange.
4. In each partition heavy terms are added into exact counter arrays (numpy ``bincount`` over the numbers) and leave it as
   one row per term; light terms are summed map-side. Only these partial counts are shuffled by term. A hot record
   stands in several cells, so its terms go along by record (few records, each with its distinct terms) and are counted at the end.

Defined cases: the same id twice in one record counts once (null ids each count; of rows that differ the least by terms);
spellings that differ in case, outer white space or runs of hyphen, underscore and blank are one term; null and blank values
do not count; rows without a record id add items but no record. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY = 128
TRACKED = 2048
HOT, SALTS = 64, 64
RARE_RECORDS = 2
COMMON_SHARE = 1 / 3
_WS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x{200b}"


def norm_term(col: Column) -> Column:
    """Lower case, outer white space off, single hyphens for runs of hyphen, underscore and white space between words."""
    trimmed = F.regexp_replace(F.lower(col), rf"^[{_WS}]+|[{_WS}]+$", "")
    hyphens = F.regexp_replace(trimmed, rf"[{_WS}_\-]+", "-")
    return F.when(hyphens != "", hyphens)


def frequent(rows: DataFrame, fields: list[str], record_col: str) -> tuple[dict[str, list[str]], list]:
    """Raw spellings of over 0.1 % of the rows (at most ``HEAVY`` a field) and records of over 1 % (at most ``HOT``), by the sketches."""
    wanted = [(f, HEAVY) for f in fields] + [(record_col, HOT)]
    got = rows.agg(F.count("*").alias("n"), *[F.expr(f"approx_top_k(`{c}`, {k}, {TRACKED})").alias(f"s{i}") for i, (c, k) in enumerate(wanted)]).first()
    over = lambda i, times: [x["item"] for x in (got[f"s{i}"] or []) if x["item"] is not None and x["count"] * times > got["n"]]
    return {f: over(i, 1000) for i, f in enumerate(fields)}, over(len(fields), 100)


def term_counts(rows: DataFrame, fields: list[str], item_col: str, record_col: str) -> DataFrame:
    """``field_name, term, n_items, n_records``, exact."""
    spark = rows.sparkSession
    spellings, hot = frequent(rows, fields, record_col)
    raws = spark.createDataFrame([(f, r) for f in fields for r in spellings[f]], "field string, raw string").withColumn("term", norm_term(F.col("raw"))).collect()
    heavy = sorted({(r["field"], r["term"]) for r in raws if r["term"] is not None})
    number = {key: i for i, key in enumerate(heavy)}
    blank = len(heavy)
    slim = rows.select(F.col(record_col).alias("record"), F.col(item_col).alias("item"), *[F.col(f).alias(f"raw{i}") for i, f in enumerate(fields)])
    for i, f in enumerate(fields):
        by_raw = [(r["raw"], number.get((f, r["term"]), blank)) for r in raws if r["field"] == f]
        by_term = [(t, n) for (g, t), n in number.items() if g == f]
        known = spark.createDataFrame(by_raw, f"raw{i} string, c int")
        slim = slim.join(F.broadcast(known), f"raw{i}", "left").withColumn(f"term{i}", F.when(F.col("c").isNull(), norm_term(F.col(f"raw{i}")))).drop(f"raw{i}")
        late = spark.createDataFrame(by_term, f"term{i} string, d int")  # rare spellings of heavy terms
        slim = slim.join(F.broadcast(late), f"term{i}", "left").withColumn(f"code{i}", F.coalesce("c", "d")).withColumn(f"term{i}", F.when(F.col("d").isNull(), F.col(f"term{i}"))).drop("c", "d")
    spread = F.col("record").isNull() | F.col("record").isin(hot) if hot else F.col("record").isNull()
    cell = F.when(F.col("item").isNotNull(), F.xxhash64("item")).otherwise(F.monotonically_increasing_id())
    salted = slim.withColumn("salt", F.when(spread, F.pmod(cell, F.lit(SALTS)).cast("int")).otherwise(-1))
    met = salted.repartition("record", "salt")
    inner = [c for i in range(len(fields)) for c in (f"code{i}", f"term{i}")]
    once = met.where("item IS NOT NULL").groupBy("record", "salt", "item").agg(F.min(F.struct(*inner)).alias("s")).select("record", "salt", "s.*")
    each = once.unionByName(met.where("item IS NULL").select("record", "salt", *inner)) if _nullable(rows, item_col) else once
    values = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"code{i}").alias("code"), F.col(f"term{i}").alias("term")) for i in range(len(fields))])
    pairs = each.select("record", "salt", F.explode(values).alias("v")).where(f"v.term IS NOT NULL OR v.code < {blank}")
    counted = pairs.groupBy("record", "salt", F.col("v.field").alias("field"), F.col("v.code").alias("code"), F.col("v.term").alias("term")).agg(F.count("*").alias("n_items"))
    several = F.col("record").isNotNull() & (F.col("salt") >= 0)
    routed = counted.select("field", "code", "term", "n_items", F.when(several, F.col("record").cast("string")).alias("spread"), (F.col("record").isNotNull() & (F.col("salt") < 0)).cast("bigint").alias("n_records"))
    names = routed.columns

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, records = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        for batch in batches:
            mine = pc.and_(pc.is_valid(batch.column(1)), pc.is_null(batch.column(4)))
            at = batch.column(1).filter(mine).to_numpy()
            for total, column in ((items, 3), (records, 5)):
                total += np.bincount(at, weights=batch.column(column).filter(mine).to_numpy(), minlength=len(heavy)).astype(np.int64)
            rest = batch.filter(pc.invert(mine))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays(rest.columns, names=names)
        seen = np.flatnonzero(items)
        if seen.size:
            none = pa.nulls(seen.size, pa.string())
            where = pa.array([fields.index(heavy[i][0]) for i in seen], pa.int32())
            yield pa.RecordBatch.from_arrays([where, pa.array(seen.astype(np.int32)), none, pa.array(items[seen]), none, pa.array(records[seen])], names=names)

    partial = routed.mapInArrow(counters, "field int, code int, term string, n_items bigint, spread string, n_records bigint")
    merged = partial.groupBy("field", "code", "term", "spread").agg(F.sum("n_items").alias("n_items"), F.sum("n_records").alias("n_records"))
    summed = merged.groupBy("field", "code", "term").agg(F.sum("n_items").alias("n_items"), F.sum(F.when(F.col("spread").isNotNull(), 1).otherwise(F.col("n_records"))).alias("n_records"))
    named = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(heavy)], "code int, known string")
    field_name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return summed.join(F.broadcast(named), "code", "left").select(field_name.alias("field_name"), F.coalesce("known", "term").alias("term"), "n_items", "n_records")


def _nullable(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].nullable


def banded(rows: DataFrame, fields: list[str], item_col: str, record_col: str) -> DataFrame:
    """``term_counts`` with ``band``: rare (at most 2 records), common (over a third of all records), else null."""
    everything = rows.agg(F.count_distinct(record_col).alias("all_records"))
    band = F.when(F.col("n_records") <= RARE_RECORDS, "rare").when(F.col("n_records") > F.col("all_records") * COMMON_SHARE, "common")
    return term_counts(rows, fields, item_col, record_col).crossJoin(F.broadcast(everything)).withColumn("band", band).drop("all_records")
