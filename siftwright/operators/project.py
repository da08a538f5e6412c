"""Across files: correlation, calibration, axis scores.

Common shapes: ``hits(file_id, rule_id, category, severity, line_index, ord...)``, ``findings(file_id, value, confidence,
pipeline_score, line_index)``, ``urls(file_id, url, classification, ...)``, ``files(file_id, rel_path, ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import classify

#: Category weights of the axes; fixed values.
WEIGHTS = {
    "A": "slopsquatting 1.0 context-confusion 1.0 over-engineering 0.8 verbosity 0.7 dead-code 0.6 debug-pollution 0.5 scaffold-residue 0.9 comment-mismatch 0.8 "
    "clone-pollution 0.9 type-theater 0.7 test-theater 0.8 branch-symmetry 0.6 accessor-bloat 0.6 interface-bloat 0.5 naming-entropy 0.7",
    "B": "security 1.0 config-exposure 0.9 dependency 0.7 slopsquatting 0.3",
    "C": "error-handling 1.0 async-abuse 0.9 structure-smell 0.8 complexity-spike 0.9 magic-values 0.7 import-hygiene 0.6 promise-graveyard 0.9 dead-code 0.4 "
    "debug-pollution 0.4 over-engineering 0.3 verbosity 0.3",
}
#: Parts of an axis (patterns, compression, findings, urls) and what its compression part is scaled by.
PARTS = {"A": (0.35, 0.40, 0.15, 0.10, 1.0), "B": (0.25, 0.10, 0.45, 0.20, 0.3), "C": (0.55, 0.20, 0.10, 0.15, 0.5)}
#: Points of a URL's classification on the security axis and on the others.
URL_POINTS = {"internal-exposed": (20, 5), "sensitive-parameter": (30, 8), "suspicious-external": (15, 10)}


def weights(axis: str) -> dict[str, float]:
    words = WEIGHTS[axis].split()
    return {k: float(v) for k, v in zip(words[::2], words[1::2])}


def _lookup(col: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col)


# correlation


def shared_values(rows: DataFrame, value: str, name: str, least_length: int = 0) -> DataFrame:
    """Values found in two or more files: ``name, file_count, n_locations``."""
    kept = rows.where((F.length(value) >= max(1, least_length)) & F.col("file_id").isNotNull())
    per_file = kept.groupBy(value, "file_id").agg(F.count("*").alias("n"))
    both = per_file.groupBy(value).agg(F.count("*").alias("file_count"), F.sum("n").alias("n_locations"))
    return both.where("file_count >= 2").select(F.col(value).alias(name), "file_count", "n_locations")


def shared_locations(rows: DataFrame, value: str, least_length: int = 0) -> DataFrame:
    """``value, file_id, line_index`` of every place of the values found in two or more files (a semi-join, so no list grows)."""
    return rows.where(F.col("file_id").isNotNull()).join(shared_values(rows, value, value, least_length), value, "left_semi").select(value, "file_id", "line_index")


def clone_map(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions declared on lines hit as clones in two or more files: ``name, file_count, n_locations``."""
    from .rules import declared_name

    cloned = hits.where("category = 'clone-pollution'").select("file_id", "line_index")
    named = lines.join(cloned, ["file_id", "line_index"]).select("file_id", declared_name(F.col("line")).alias("name"))
    return shared_values(named, "name", "name")


def url_crossref(urls: DataFrame) -> DataFrame:
    """Internal URLs exposed in two or more files."""
    return shared_values(urls.where("classification = 'internal-exposed'"), "url", "url")


def directory(path: Column) -> Column:
    d = F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)
    return F.when(d == "", ".").otherwise(d)


def dominant_category(hits: DataFrame) -> DataFrame:
    """Each file's most frequent category; of equals the one seen first."""
    per = hits.groupBy("file_id", F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"), F.min(F.struct("line_index", "ord")).alias("first"))
    order = Window.partitionBy("file_id").orderBy(F.desc("n"), "first", "category")
    return per.withColumn("r", F.row_number().over(order)).where("r = 1").select("file_id", "category", F.col("n").alias("n_hits"))


def slop_clusters(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Folders with three or more files of one dominant category."""
    placed = dominant_category(hits).join(files.select("file_id", "rel_path"), "file_id")
    return placed.groupBy(directory(F.col("rel_path")).alias("directory"), "category").agg(F.count("*").alias("file_count")).where("file_count >= 3")


# calibration


def median_mad(scores: DataFrame, col: str) -> DataFrame:
    """``median, mad`` in one row; zeros without rows."""
    middle = scores.where(F.col(col).isNotNull()).agg(F.coalesce(F.median(col), F.lit(0.0)).alias("median"))
    spread = scores.where(F.col(col).isNotNull()).crossJoin(F.broadcast(middle)).agg(F.coalesce(F.median(F.abs(F.col(col) - F.col("median"))), F.lit(0.0)).alias("mad"))
    return middle.crossJoin(F.broadcast(spread))


def multipliers(hits: DataFrame, files: DataFrame) -> DataFrame:
    """``category, n_files, multiplier``: categories in most files count less."""
    total = files.agg(F.count("*").alias("total"))
    per = hits.select("file_id", F.coalesce("category", F.lit("unknown")).alias("category")).distinct().groupBy("category").agg(F.count("*").alias("n_files"))
    density = F.col("n_files") / F.col("total")
    return per.crossJoin(F.broadcast(total)).select("category", "n_files", F.when(density > 0.5, 0.5).when(density > 0.3, 0.75).otherwise(1.0).alias("multiplier"))


def recalibrate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``confidence_calibrated, calibrated`` beside the confidence: usual scores lose a tier in projects large enough."""
    scale = median_mad(findings, "pipeline_score").crossJoin(F.broadcast(files.agg(classify.calibration_weight(F.count("*")).alias("weight"))))
    usual = F.col("pipeline_score").between(F.col("median") - F.col("mad"), F.col("median") + F.col("mad")) & (F.col("weight") > 0)
    touched = usual & F.col("confidence").isin("HIGH", "MEDIUM")
    lowered = F.when(F.col("confidence") == "HIGH", "MEDIUM").otherwise("UNCERTAIN")
    after = F.when(touched & (F.col("weight") >= 0.5), lowered).otherwise(F.col("confidence"))
    return findings.crossJoin(F.broadcast(scale)).withColumns({"confidence_calibrated": after, "calibrated": touched}).drop("median", "mad", "weight")


def recalibrate_compression(files: DataFrame) -> DataFrame:
    """``outlier_score, calibrated`` beside ``self_ratio``: files within 1.5 MAD of the median are usual in projects large enough."""
    scale = median_mad(files, "self_ratio").crossJoin(F.broadcast(files.agg(classify.calibration_weight(F.count("*")).alias("weight"))))
    near = F.col("self_ratio").between(F.col("median") - 1.5 * F.col("mad"), F.col("median") + 1.5 * F.col("mad")) & (F.col("weight") > 0)
    usual = F.coalesce(near, F.lit(False))
    return files.crossJoin(F.broadcast(scale)).withColumns({"calibrated": usual, "outlier_score": F.when(usual, 0.0).otherwise(F.col("outlier_score"))}).drop("median", "mad", "weight")


# scores


def pattern_scores(hits: DataFrame, mult: DataFrame, lines: DataFrame) -> DataFrame:
    """``file_id, pattern_a, pattern_b, pattern_c`` (0-100) by density over ``lines(file_id, line_count)``."""
    weighted = hits.join(F.broadcast(mult.select("category", "multiplier")), "category", "left").na.fill(1.0, ["multiplier"])
    severity = F.coalesce(F.nullif("severity", F.lit(0)), F.lit(1))
    sums = [F.sum(severity * F.coalesce(_lookup(F.col("category"), weights(a)), F.lit(0.0)) * F.col("multiplier")).alias(f"s_{a}") for a in "ABC"]
    per = weighted.groupBy("file_id").agg(*sums)
    return per.join(lines, "file_id").select("file_id", *[F.least(F.col(f"s_{a}") / F.col("line_count") * 100, F.lit(100.0)).alias(f"pattern_{a.lower()}") for a in "ABC"])


def finding_scores(findings: DataFrame, confidence: str = "confidence_calibrated") -> DataFrame:
    points = F.coalesce("pipeline_score", F.lit(0.0)) * F.when(F.col(confidence) == "HIGH", 1.0).otherwise(0.6)
    per = findings.groupBy("file_id").agg(F.sum(points).alias("p"))
    return per.select("file_id", F.least(F.col("p") * 5, F.lit(100.0)).alias("finding_other"), F.least(F.col("p") * 10, F.lit(100.0)).alias("finding_b"))


def url_scores(urls: DataFrame) -> DataFrame:
    """Needs ``classification`` and ``n_query_findings``."""
    b = F.coalesce(_lookup(F.col("classification"), {k: v[0] for k, v in URL_POINTS.items()}), F.lit(0)) + 15 * F.col("n_query_findings")
    other = F.coalesce(_lookup(F.col("classification"), {k: v[1] for k, v in URL_POINTS.items()}), F.lit(0)) + F.when(F.col("n_query_findings") > 0, 5).otherwise(0)
    per = urls.groupBy("file_id").agg(F.sum(b).alias("b"), F.sum(other).alias("o"))
    return per.select("file_id", F.least(F.col("o"), F.lit(100)).cast("double").alias("url_other"), F.least(F.col("b"), F.lit(100)).cast("double").alias("url_b"))


def file_axes(parts: DataFrame) -> DataFrame:
    """``axis_a, axis_b, axis_c`` of ``parts(file_id, pattern_*, compression, finding_*, url_*)`` (nulls count 0)."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    columns = {}
    for a in "ABC":
        pattern, compression, finding, url, scale = PARTS[a]
        own = "b" if a == "B" else "other"
        columns[f"axis_{a.lower()}"] = classify.clamp(
            z(f"pattern_{a.lower()}") * pattern + z("compression") * scale * compression + z(f"finding_{own}") * finding + z(f"url_{own}") * url
        )
    return parts.withColumns(columns)


def project_axes(scored: DataFrame) -> DataFrame:
    """One row: role-weighted means of the axes, lines and files."""
    w = F.col("role_weight") * F.col("line_count")
    mean = lambda c: classify.clamp(F.coalesce(F.sum(F.col(c) * w) / F.nullif(F.sum(w), F.lit(0.0)), F.lit(0.0)))
    return scored.agg(*[mean(f"axis_{a}").alias(f"axis_{a}") for a in "abc"], F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"), F.count("*").alias("file_count"))


def exit_code(project: DataFrame, limits: tuple[float, float, float] = (50, 25, 100)) -> DataFrame:
    """1 if an axis exceeds its limit."""
    over = (F.col("axis_a") > limits[0]) | (F.col("axis_b") > limits[1]) | (F.col("axis_c") > limits[2])
    return project.withColumn("exit_code", over.cast("int"))
