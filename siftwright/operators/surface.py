"""Surface figures of a file: minified, densities, line lengths, repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import js_trim


def effective(lines: DataFrame) -> DataFrame:
    """Lines without the one trailing blank line of a file; ``n_lines`` on the lines saves looking for the last one."""
    if "n_lines" in lines.columns:
        return lines.where(~((F.col("line_index") == F.col("n_lines") - 1) & (js_trim(F.col("line")) == "")))
    last = lines.groupBy("file_id").agg(F.max(F.struct("line_index", "line")).alias("l"))
    cut = last.where(js_trim(F.col("l.line")) == "").select("file_id", F.col("l.line_index").alias("cut"))
    return lines.join(cut, "file_id", "left").where(F.col("cut").isNull() | (F.col("line_index") < F.col("cut"))).drop("cut")


def measured(files: DataFrame) -> DataFrame:
    """Files with ``n_chars, routing_density, whitespace_ratio`` of their content (null without content)."""
    c = F.col("content")
    share = lambda p: F.when(F.length(c) == 0, 0.0).otherwise((F.length(c) - F.length(F.regexp_replace(c, p, ""))) / F.nullif(F.length(c), F.lit(0)).cast("double"))
    return files.withColumns({"n_chars": F.length(c), "routing_density": share(r"[{}();]"), "whitespace_ratio": share(r"[ \t\n\r]")})


def figures(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, minified, routing_density, avg_line_length, line_distribution, whitespace_ratio`` of files with content; ``files`` may be ``measured`` already."""
    t, n = js_trim(F.col("line")), F.length("line")
    by = effective(lines).groupBy("file_id").agg(
        F.count("*").alias("n_lines"), F.avg(F.when(t != "", n)).alias("avg"),
        *[F.avg(c.cast("double")).alias(f"d{i}") for i, c in enumerate((n <= 40, (n > 40) & (n <= 80), (n > 80) & (n <= 120), n > 120))],
    )
    own = files if "n_chars" in files.columns else measured(files)
    joined = own.where("n_chars IS NOT NULL").select("file_id", "n_chars", "routing_density", "whitespace_ratio").join(by, "file_id", "left")
    lines_n, avg = F.coalesce("n_lines", F.lit(0)), F.coalesce("avg", F.lit(0.0))
    minified = ((lines_n == 1) & (F.col("n_chars") > 500)) | ((lines_n <= 10) & (lines_n > 0) & (avg >= 200))
    return joined.select(
        "file_id", minified.alias("minified"), "routing_density", avg.alias("avg_line_length"),
        F.array(*[F.coalesce(F.col(f"d{i}"), F.lit(0.0)) for i in range(4)]).alias("line_distribution"), "whitespace_ratio",
    )


def repetition(lines: DataFrame) -> DataFrame:
    """``file_id, repetition_fraction``: lines in buckets of equal first 20 characters that hold a close pair.

    Equal lines settle a bucket without comparing; only distinct ones are compared, by edit distance with a bound, and
    buckets whose distinct lines are many are split by a second key first (equal length within the bound).
    """
    t = js_trim(F.col("line"))
    cut = effective(lines).select("file_id", F.substring(t, 1, 20).alias("prefix"), F.substring(t, 1, 60).alias("head"))
    total = cut.groupBy("file_id").agg(F.count("*").alias("n"))
    heads = cut.groupBy("file_id", "prefix", "head").agg(F.count("*").alias("k"))
    buckets = heads.groupBy("file_id", "prefix").agg(F.sum("k").alias("k"), (F.max("k") > 1).alias("same")).where("k >= 3")
    a = heads.join(buckets.where("NOT same"), ["file_id", "prefix"], "left_semi").select("file_id", "prefix", "head")
    near = a.select("file_id", "prefix", "head", F.explode(F.sequence(F.length("head") - 4, F.length("head"))).alias("n"))
    b = a.select("file_id", "prefix", F.col("head").alias("other"), F.length("head").alias("n"))
    close = near.join(b, ["file_id", "prefix", "n"]).where((F.col("head") != F.col("other")) & (F.levenshtein("head", "other", 4) >= 0)).select("file_id", "prefix").distinct()
    repeated = buckets.where("same").select("file_id", "k").unionByName(buckets.where("NOT same").join(close, ["file_id", "prefix"], "left_semi").select("file_id", "k"))
    summed = repeated.groupBy("file_id").agg(F.sum("k").alias("r"))
    return total.join(summed, "file_id", "left").select("file_id", F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce("r", F.lit(0)) / F.col("n").cast("double")).alias("repetition_fraction"))


def segments(lines: DataFrame) -> DataFrame:
    """Windows of 30 lines at steps of 15, or the whole of a shorter file: ``file_id, start_line, end_line, text``.

    Each line goes to the at most two windows that hold it; a window is put together from at most 30 lines.
    """
    n = lines.groupBy("file_id").agg(F.count("*").alias("n"))
    at = lines.join(n, "file_id")
    last = F.floor((F.col("n") - 30) / 15) * 15
    starts = F.when(F.col("n") < 30, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.filter(F.array(F.floor(F.col("line_index") / 15) * 15, F.floor(F.col("line_index") / 15) * 15 - 15), lambda s: (s >= 0) & (s <= last))
    )
    placed = at.select("file_id", "line_index", "line", "n", F.explode(starts).alias("start_line"))
    joined = placed.groupBy("file_id", "start_line").agg(F.array_sort(F.collect_list(F.struct("line_index", "line"))).alias("l"), F.first("n").alias("n"))
    end = F.when(F.col("n") < 30, F.col("n") - 1).otherwise(F.col("start_line") + 29)
    return joined.select("file_id", F.col("start_line").cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.array_join(F.col("l.line"), "\n").alias("text"))
