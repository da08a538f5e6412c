"""Deep analysis of candidates: decomposition, resolved scores, signals, arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compress
from ..functions import strings as S
from ..functions.dialect import js_trim

_KEY = r"^[a-zA-Z][a-zA-Z0-9_.\-]*\z"


def _pairs(v: Column, delimiter: str, separators: str, least: int) -> Column:
    """Values of ``key<separator>value`` segments if enough segments have a valid key; null otherwise."""
    segments = F.filter(F.transform(F.split(v, delimiter), js_trim), lambda s: s.rlike(f"[{separators}]"))
    key = lambda s: F.regexp_extract(s, rf"(?s)^([^{separators}]*)[{separators}]", 1)
    valid = F.filter(segments, lambda s: key(s).rlike(_KEY))
    values = F.filter(F.transform(valid, lambda s: F.regexp_extract(s, rf"(?s)^[^{separators}]*[{separators}](.*)\z", 1)), lambda x: x != "")
    return F.when(F.size(valid) >= least, values)


def _url_values(v: Column) -> Column:
    absolute = v.rlike("^https?://")
    query = F.regexp_extract(v, r"(?s)^[^?]*\?(.*)\z", 1)
    usable = (F.instr(v, "?") > 0) & (absolute | query.rlike(r"^[A-Za-z_][A-Za-z0-9_]*="))
    parts = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    valid = F.filter(parts, lambda p: F.regexp_extract(p, r"(?s)^([^=]*)=", 1).rlike(_KEY))
    values = F.filter(F.transform(valid, lambda p: F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)), lambda x: x != "")
    return F.when(usable & (F.size(valid) >= 2), values)


def _json_values(v: Column) -> Column:
    t = js_trim(v)
    values = F.filter(F.regexp_extract_all(t, F.lit(r':\s*"([^"\\]*(?:\\.[^"\\]*)*)"'), F.lit(1)), lambda x: x != "")
    wrapped = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.when(wrapped & (F.size(values) >= 2), values)


def decompose(v: Column) -> Column:
    """Parts of a structured value by the first strategy that applies, else the value itself; may be empty."""
    return F.when(v == "", F.expr("CAST(array() AS array<string>)")).otherwise(
        F.coalesce(_pairs(v, ";", "=", 3), _pairs(v, ",", "=:", 3), _pairs(v, r"\|", "=", 3), _url_values(v), _json_values(v), F.array(v))
    )


def resolved(sub: DataFrame) -> DataFrame:
    """``resolved_score`` of every row's ``value``: the aggregate score, or the vector score where that is ambiguous."""
    v = F.col("value")
    long = F.length(v) > 50
    sized = sub.withColumn("packed", compress.gzip_len(F.when(long, v)))
    ratio = F.col("packed") / F.nullif(F.octet_length(v), F.lit(0)).cast("double")
    signals = sized.withColumns({"_char": S.char_signal(v), "_bigram": S.bigram_signal(v), "_comp": S.compression_signal_of(ratio, F.length(v)), "_ratio": ratio})
    score, ambiguous = S.aggregate_score(F.col("_char"), F.col("_bigram"), F.col("_comp"))
    mean = F.aggregate(S.vector(v, F.col("_ratio")), F.lit(0.0), lambda a, d: a + d) / 6
    vector = F.floor(mean * 1000 + 0.5) / 1000
    return signals.withColumn("resolved_score", F.when(ambiguous, vector).otherwise(score / 100.0)).drop("packed", "_char", "_bigram", "_comp", "_ratio")


def signals(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Candidates with their four signals, pipeline score and top part. ``key`` identifies a candidate."""
    v = F.col("value")
    parts = candidates.select(*key, F.posexplode_outer(decompose(v)).alias("sub_ord", "value")).where("value IS NOT NULL")
    best = resolved(parts).groupBy(*key).agg(F.max(F.struct("resolved_score", (-F.col("sub_ord")).alias("o"), F.col("value").alias("top_value"))).alias("b"))
    scored = candidates.join(best.select(*key, F.col("b.resolved_score").alias("pipeline_score"), F.col("b.top_value").alias("top_value")), key, "left").na.fill(0.0, ["pipeline_score"])
    return scored.withColumns(
        {"ic_signal": S.coincidence(v) < 0.045, "ctf_signal": S.friction(v) > 0.4, "egs_spike": S.spikes(S.gradient(v)), "uniformity": S.uniform(v)}
    )


def confidence(pipeline: Column, n: Column, others: Column) -> Column:
    """HIGH, MEDIUM, UNCERTAIN or nothing."""
    from .classify import length_multiplier

    effective = pipeline * length_multiplier(n)
    return F.when((effective >= 0.65) & (others >= 2), "HIGH").when((effective >= 0.50) & (others >= 2), "MEDIUM").when((pipeline >= 0.40) | (others >= 1), "UNCERTAIN")


def arbitrated(analysed: DataFrame) -> DataFrame:
    """Candidates with a confidence; what has none is dropped. Findings are HIGH and MEDIUM, UNCERTAIN is up for review."""
    others = sum((F.col(c).cast("int") for c in ("ic_signal", "ctf_signal", "egs_spike", "uniformity")), F.lit(0))
    rated = analysed.withColumn("signal_count", others).withColumn("confidence", confidence(F.col("pipeline_score"), F.length("value"), F.col("signal_count")))
    return rated.where("confidence IS NOT NULL").withColumns({"shape": S.shape(F.col("value")), "masked": S.mask(F.col("value"))})
