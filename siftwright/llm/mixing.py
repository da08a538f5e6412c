"""Mixing sources to target weights (problem 7) by entropy balancing.

Every document starts with rate 1 and gets the rate nearest to that in relative entropy such that each source's
expected tokens equal its share of the total: ``rate = min(cap, exp(lambda_source * tokens / mean))``, where the
multipliers solve the convex dual. Newton steps run over all sources at once; each is one small distributed
aggregation over the exact histogram ``(source, tokens) -> documents``, which is a sufficient statistic, so the
documents themselves are read once. A step that leaves the bracket of its root is replaced by a bisection.

The total is the largest at which no source needs a document more often than its cap:
``min over sources of cap * tokens / share``.

Rates become copies by systematic rounding: the whole part goes to every document, the fractional parts are
summed along increasing size within the source and a unit is handed out whenever the sum passes a half integer.
Which documents of equal source and size get it is decided by a hash of the id inside salted cells, so that a
source or a group of equal documents holding any part of the rows is never one task.

Defined cases
-------------
* sources are compared without case and outer white space; a null or blank source has no target (0 copies).
* a target without documents gets share 0, and the other targets are scaled to sum to 1.
* null, empty texts count 0 tokens and get ``floor(rate)`` copies, at most 1.
* repeated targets of one source: the first by (share, cap) counts. Null or non-positive share or cap: no target.
* an empty corpus gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .bpe import count_tokens

CELL_ROWS = 50_000
SALTS = 16
TOLERANCE = 1e-10
STEPS = 60


def norm_source(col):
    return F.lower(F.regexp_replace(col, r"^[\s ﻿]+|[\s ﻿]+$", ""))


def targets_of(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """``{source: (share, cap)}``; the targets are a small fixed list by definition (one row per source name)."""
    rows = (
        mix_targets.select(norm_source(F.col("source")).alias("s"), "target_share", "max_repeats")
        .where("s <> '' AND target_share > 0 AND max_repeats > 0")
        .groupBy("s")
        .agg(F.min(F.struct("target_share", "max_repeats")).alias("t"))
        .collect()
    )
    return {r["s"]: (r["t"]["target_share"], r["t"]["max_repeats"]) for r in rows}


def _mapped(values: dict[str, float]):
    """Column: the value of the row's source."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("src"))


def solve(hist: DataFrame, targets: dict[str, tuple[float, int]]) -> tuple[dict[str, float], dict[str, float], float]:
    """Multipliers, mean sizes and the total of tokens; ``hist`` has src, n_tokens, n_docs (targets only)."""
    stats = {r["src"]: (r["tok"], r["docs"]) for r in hist.where("n_tokens > 0").groupBy("src").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tok"), F.sum("n_docs").alias("docs")).collect()}
    if not stats:
        return {}, {}, 0.0
    whole = math.fsum(targets[s][0] for s in stats)
    share = {s: targets[s][0] / whole for s in stats}
    total = min(targets[s][1] * stats[s][0] / share[s] for s in stats)
    want = {s: share[s] * total for s in stats}
    mean = {s: stats[s][0] / stats[s][1] for s in stats}
    cap = {s: float(targets[s][1]) for s in stats}
    lam = {s: min(math.log(max(want[s] / stats[s][0], 1e-9)), math.log(cap[s])) for s in stats}
    low, high = dict.fromkeys(stats, -math.inf), dict.fromkeys(stats, math.inf)
    open_ = {s for s in stats if want[s] < cap[s] * stats[s][0] * (1 - 1e-12)}
    for s in set(stats) - open_:
        lam[s] = math.inf  # every document at its cap
    for _ in range(STEPS):
        if not open_:
            break
        now = {s: lam[s] for s in open_}
        x = F.col("n_tokens") / _mapped(mean)
        raw = F.exp(F.least(_mapped(now) * x, F.lit(700.0)))
        rate = F.least(raw, _mapped(cap))
        slope = F.when(raw < _mapped(cap), raw * x).otherwise(0.0)
        got = {
            r["src"]: (r["g"], r["h"])
            for r in hist.where(F.col("src").isin(*open_) & (F.col("n_tokens") > 0))
            .groupBy("src")
            .agg(F.sum(rate * F.col("n_tokens") * F.col("n_docs")).alias("g"), F.sum(slope * F.col("n_tokens") * F.col("n_docs")).alias("h"))
            .collect()
        }
        for s in list(open_):
            gap = got[s][0] - want[s]
            if abs(gap) <= TOLERANCE * want[s]:
                open_.discard(s)
                continue
            low[s], high[s] = (lam[s], high[s]) if gap < 0 else (low[s], lam[s])
            step = lam[s] - gap / got[s][1] if got[s][1] > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = lam[s] + (1.0 if gap < 0 else -1.0) * max(1.0, abs(lam[s]))
                else:
                    step = (low[s] + high[s]) / 2
            lam[s] = step
    return lam, mean, total


def mix(documents: DataFrame, mix_targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(copies, report)``.

    copies: doc_id, source (normalised), n_tokens, copies - one row per input row.
    report: source, target_share, max_repeats, n_docs, tokens_available, tokens_mixed, reached_share, n_copies, most_copies.
    """
    spark = documents.sparkSession
    targets = targets_of(mix_targets)
    sized = cut(count_tokens(documents.select("doc_id", "text", norm_source(F.col("source")).alias("src")), path))
    wanted = sized.where(F.col("src").isin(*targets)) if targets else sized.where("false")
    hist = cut(wanted.groupBy("src", "n_tokens").agg(F.count("*").alias("n_docs")))
    lam, mean, _ = solve(hist, targets)
    if lam:
        cap = {s: float(targets[s][1]) for s in lam}
        x = F.col("n_tokens") / _mapped(mean)
        tilt = _mapped({s: v for s, v in lam.items()})
        rate = F.when(tilt == math.inf, _mapped(cap)).otherwise(F.least(F.exp(F.least(tilt * x, F.lit(700.0))), _mapped(cap)))
        rated = hist.where(F.col("src").isin(*lam)).withColumn("rate", F.when(F.col("n_tokens") > 0, rate).otherwise(F.lit(1.0)))
    else:
        rated = hist.withColumn("rate", F.lit(0.0))
    along = Window.partitionBy("src").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("n_docs") * (F.col("rate") - F.floor("rate"))
    upto = F.floor(F.sum(part).over(along) + F.lit(0.5))
    before = F.floor(F.sum(part).over(along) - part + F.lit(0.5))
    groups = rated.select(
        "src", "n_tokens", "n_docs", F.floor("rate").alias("base"), F.greatest(F.lit(0), F.least(upto - before, F.col("n_docs"))).alias("extra"),
        F.ceil(F.col("n_docs") / F.lit(CELL_ROWS)).alias("cells"),
    )
    # cells of equal source and size: the cell's share of the extra copies, then the lowest hashes inside it
    # (empty documents need no group: they have rate 1; groups of over CELL_ROWS documents, so at most one in CELL_ROWS, are spread over SALTS places)
    large = F.col("n_docs") > CELL_ROWS
    hot = groups.where(large & (F.col("n_tokens") > 0)).select("src", "n_tokens", F.lit(True).alias("hot"))
    places = F.sequence(F.lit(0).cast("bigint"), F.when(large, SALTS - 1).otherwise(0).cast("bigint"))
    placed = (
        wanted.where("n_tokens > 0")
        .withColumn("h", F.xxhash64("doc_id"))
        .join(F.broadcast(hot), ["src", "n_tokens"], "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.shiftright("h", 20), F.lit(SALTS))).otherwise(0).cast("bigint"))
        .join(groups.where("n_tokens > 0").withColumn("salt", F.explode(places)), ["src", "n_tokens", "salt"])
        .withColumn("cell", F.pmod("h", F.col("cells")))
        .drop("hot", "salt")
    )
    empty = wanted.where("n_tokens = 0").select("doc_id", "src", "n_tokens", F.lit(1 if lam else 0).cast("bigint").alias("copies"))
    plain = placed.where("extra = 0 OR extra = n_docs").select("doc_id", "src", "n_tokens", (F.col("base") + (F.col("extra") > 0).cast("bigint")).alias("copies"))
    split = placed.where("extra > 0 AND extra < n_docs")
    counts = split.groupBy("src", "n_tokens", "cell").agg(F.count("*").alias("k"), F.first("extra").alias("e"), F.first("n_docs").alias("n"))
    run = Window.partitionBy("src", "n_tokens").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    done = F.sum("k").over(run)
    shares = counts.select("src", "n_tokens", "cell", (F.floor(done * F.col("e") / F.col("n")) - F.floor((done - F.col("k")) * F.col("e") / F.col("n"))).alias("take"))
    order = Window.partitionBy("src", "n_tokens", "cell").orderBy("h", "doc_id")
    chosen = (
        split.join(shares, ["src", "n_tokens", "cell"])
        .withColumn("r", F.row_number().over(order))
        .select("doc_id", "src", "n_tokens", (F.col("base") + (F.col("r") <= F.col("take")).cast("bigint")).alias("copies"))
    )
    rest = sized.where(F.col("src").isNull() | ~F.col("src").isin(*targets)) if targets else sized
    parts = [plain, chosen, empty, rest.select("doc_id", "src", "n_tokens", F.lit(0).cast("bigint").alias("copies"))]
    copies = cut(reduce(DataFrame.unionByName, [p.select("doc_id", F.col("src").alias("source"), "n_tokens", F.col("copies").cast("int").alias("copies")) for p in parts]))
    schema = "source string, target_share double, max_repeats int"
    wanted_rows = spark.createDataFrame([(s, t, c) for s, (t, c) in sorted(targets.items())], schema)
    by = copies.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens_available"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_mixed"),
        F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"),
    )
    report = wanted_rows.join(by, "source", "left").na.fill(0, ["n_docs", "tokens_available", "tokens_mixed", "n_copies", "most_copies"])
    total = report.agg(F.sum("tokens_mixed").alias("all"))
    report = report.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_docs", "tokens_available", "tokens_mixed",
        F.coalesce(F.col("tokens_mixed") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)).alias("reached_share"), "n_copies", "most_copies",
    )
    return copies, report


def mixed(documents: DataFrame, mix_targets: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document with its copies, and its source's target and reached share beside them."""
    copies, report = mix(documents, mix_targets, path)
    return copies.join(F.broadcast(report.select("source", "target_share", "reached_share")), "source", "left")
