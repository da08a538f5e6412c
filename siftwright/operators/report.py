"""Report sections, display groupings and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from . import classify


def breakdown(hits: DataFrame) -> DataFrame:
    """Per category: hits, files, highest severity, the axis it is shown under; most hits first."""
    per_file = hits.groupBy("category", "file_id").agg(F.count("*").alias("n"), F.max("severity").alias("s"))
    per = per_file.groupBy("category").agg(F.sum("n").alias("hit_count"), F.count("file_id").alias("file_count"), F.max("s").alias("max_severity"))
    return per.withColumn("axis", classify.axis_of(F.col("category"))).orderBy(F.desc("hit_count"), "category")


def tag_index(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule_id").agg(F.count("*").alias("hit_count")).orderBy(F.desc("hit_count"), "rule_id")


def display_groups(hits: DataFrame) -> DataFrame:
    """Per file and category: hits, the first three lines and the two gravest rules (bounded buffers, not whole groups)."""
    order = Window.partitionBy("file_id", "category")
    ranked = hits.withColumns(
        {"by_line": F.row_number().over(order.orderBy("line_index", "ord")), "by_weight": F.row_number().over(order.orderBy(F.desc("severity"), "line_index", "ord"))}
    )
    first = F.sort_array(F.collect_list(F.when(F.col("by_line") <= 3, F.col("line_index") + 1)))
    worst = F.transform(F.array_sort(F.collect_list(F.when(F.col("by_weight") <= 2, F.struct("by_weight", "rule_id")))), lambda x: x["rule_id"])
    return ranked.groupBy("file_id", "category").agg(F.count("*").alias("hit_count"), first.alias("first_lines"), worst.alias("worst_rules"))


def snippet(line: Column, width: int = 72) -> Column:
    """Trimmed line, cut with an ellipsis."""
    from ..functions.dialect import js_trim

    t = js_trim(line)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)


def hit_list(hits: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """Hits with path, file name, line number and snippet."""
    placed = hits.join(files.select("file_id", "rel_path"), "file_id").join(lines.select("file_id", "line_index", "line"), ["file_id", "line_index"])
    return placed.select("file_id", "rel_path", classify.basename(F.col("rel_path")).alias("file_name"), "rule_id", "severity", (F.col("line_index") + 1).alias("line_number"), snippet(F.col("line")).alias("snippet"))


def secrets(findings: DataFrame) -> DataFrame:
    """Findings with the value masked only."""
    return findings.select("file_id", (F.col("line_index") + 1).alias("line_number"), "identifier_name", S.mask(F.col("value")).alias("value"), "confidence", "pipeline_score", "shape")


def review_tiers(review: DataFrame) -> DataFrame:
    """Items for review once per line and value, with their tier."""
    order = Window.partitionBy("file_id", "line_index", "value").orderBy("ord")
    once = review.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return once.withColumn("tier", F.when(F.col("pipeline_score") >= 0.55, 1).when(F.col("pipeline_score") >= 0.35, 2).otherwise(3))


def exposure(urls: DataFrame) -> DataFrame:
    return urls.where(F.col("classification") != "safe-external")


def clean_files(files: DataFrame, findings: DataFrame, hits: DataFrame, urls: DataFrame) -> DataFrame:
    """Files without finding, hit or exposed URL; items up for review do not count."""
    out = files
    for other in (findings, hits, exposure(urls)):
        out = out.join(other.select("file_id").distinct(), "file_id", "left_anti")
    return out


def top_offenders(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The files with the highest axis over 10."""
    worst = F.greatest("axis_a", "axis_b", "axis_c")
    return scored.withColumn("max_axis", worst).where("max_axis > 10").orderBy(F.desc("max_axis"), "file_id").limit(limit)


def security_concerns(scored: DataFrame, limit: int = 10) -> DataFrame:
    return scored.where("axis_b > 1").orderBy(F.desc("axis_b"), "file_id").limit(limit)


def per_file(scored: DataFrame) -> DataFrame:
    """Files with their highest axis first."""
    return scored.withColumn("max_axis", F.greatest("axis_a", "axis_b", "axis_c")).orderBy(F.desc("max_axis"), "file_id")


def counts_by_file(files: DataFrame, **items: DataFrame) -> DataFrame:
    """``file_id`` and the number of each kind of item in it, 0 where there is none; each kind is counted before it is joined."""
    out = files.select("file_id")
    for name, rows in items.items():
        out = out.join(rows.groupBy("file_id").agg(F.count("*").alias(f"n_{name}")), "file_id", "left")
    return out.na.fill(0, [f"n_{name}" for name in items])


def completion(project: DataFrame, secrets: DataFrame, review: DataFrame, urls: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: files, lines, confirmed secrets, items for review, exposed URLs, hits."""
    out = project.select(F.col("file_count"), F.col("total_lines"))
    for name, rows in (("confirmed", secrets), ("review", review), ("exposure", exposure(urls)), ("hits", hits)):
        out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return out


def explainable(findings: DataFrame, review: DataFrame) -> DataFrame:
    """Findings, then items for review: what a line can be explained by."""
    columns = ["file_id", "line_number", "value", "confidence", "pipeline_score"]
    rows = lambda df, rank: df.select("file_id", (F.col("line_index") + 1).alias("line_number"), "value", "confidence", "pipeline_score", F.lit(rank).alias("rank"))
    both = rows(findings, 0).unionByName(rows(review, 1))
    return both.withColumn("ord", F.struct("rank", *columns[1:3]))


def nearest(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each ``(file_id, line_number)`` the nearest item of the file, the first of equally near ones.

    Items and wanted lines are sorted together once; the last item before and the first one after a line are the only candidates.
    """
    first = items.where("line_number IS NOT NULL").groupBy("file_id", "line_number").agg(F.min("ord").alias("ord"))
    here = F.struct(F.col("line_number").alias("at"), "ord")
    rows = first.select("file_id", "line_number", here.alias("item"), F.lit(False).alias("asked")).unionByName(
        wanted.distinct().select("file_id", "line_number", F.lit(None).cast(first.select(here.alias("x")).schema["x"].dataType).alias("item"), F.lit(True).alias("asked"))
    )
    order = Window.partitionBy("file_id").orderBy("line_number")
    before = F.last("item", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("item", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    met = rows.withColumns({"before": before, "after": after}).where("asked")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("line_number")).alias("gap"), F.col(c)["ord"].alias("ord")))
    return met.withColumn("n", F.least(near("before"), near("after"))).where("n IS NOT NULL").select("file_id", "line_number", "n.gap", "n.ord")


def whole_json(sections: dict[str, DataFrame]) -> DataFrame:
    """The whole report: ``section, document``, one JSON document a row of every section; write it partitioned by section, or one file a section."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [as_json(rows).select(F.lit(name).alias("section"), "document") for name, rows in sections.items()])


def as_json(section: DataFrame) -> DataFrame:
    """JSON sink: one document a row."""
    return section.select(F.to_json(F.struct(*section.columns), {"ignoreNullFields": "false"}).alias("document"))
