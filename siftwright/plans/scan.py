"""The whole scan: files to lines, candidates, findings, URLs, hits, scores and report sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compress
from ..functions import strings as S
from ..operators import classify, deep, harvest, mcp, project, report, rules, surface, urls
from ..runtime import cut
from ..sources.tables import placed_lines


@dataclass
class Scan:
    """Frames of one scan; sections are lazily planned."""

    files: DataFrame
    lines: DataFrame
    surface: DataFrame
    candidates: DataFrame
    findings: DataFrame
    review: DataFrame
    urls: DataFrame
    hits: DataFrame
    scores: DataFrame
    project: DataFrame
    registry: DataFrame

    def correlations(self) -> list[tuple[str, DataFrame, Column]]:
        """``heading, rows with file_count, what is shared`` of everything two or more files (three in a folder) have in common."""
        folder = F.concat_ws(" ", "directory", "category")
        return [
            ("Shared secrets", project.shared_values(self.findings, "value", "value", 8), S.mask(F.col("value"))),
            ("Shared internal URLs", project.url_crossref(self.urls), F.col("url")),
            ("Cloned functions", project.clone_map(self.hits, self.lines), F.col("name")),
            ("Folders", project.slop_clusters(self.hits, self.files), folder),
        ]

    def sections(self) -> dict[str, DataFrame]:
        return {
            "exposure": report.exposure(self.urls),
            "secrets": report.secrets(self.findings),
            "slop_breakdown": report.breakdown(self.hits),
            "pattern_hits": report.hit_list(self.hits, self.files, self.lines),
            "clean_files": report.clean_files(self.files, self.findings, self.hits, self.urls),
            "project_summary": project.exit_code(self.project),
            "review": report.review_tiers(self.review),
            "per_file": report.per_file(self.scores),
            "counts_by_file": report.counts_by_file(self.scores, hits=self.hits, secrets=self.findings, review=self.review, exposure=report.exposure(self.urls)),
            "completion": report.completion(self.project, self.findings, self.review, self.urls, self.hits),
            "security_concerns": report.security_concerns(self.scores),
            "url_crossref": project.url_crossref(self.urls),
            "clone_map": project.clone_map(self.hits, self.lines),
            "top_offenders": report.top_offenders(self.scores),
            "duplicate_secrets": project.shared_values(self.findings, "value", "value", 8),
            "slop_clusters": project.slop_clusters(self.hits, self.files),
        }


def url_findings(found: DataFrame) -> DataFrame:
    """URL candidates parsed, their parameters through the herd gate and the deep analysis, and classified."""
    parsed = found.withColumn("parsed", urls.parse(F.col("value"))).withColumn("key", F.xxhash64("file_id", "line_index", "ord", "value"))
    each = parsed.select("key", F.posexplode(urls.params(F.col("parsed.query"))).alias("p", "kv")).select("key", "p", F.col("kv.value").alias("value"))
    rated = deep.arbitrated(deep.signals(urls.gated(each, "key"), ["key", "p"]))
    per = rated.groupBy("key").agg(F.sum(F.col("confidence").isin("HIGH", "MEDIUM").cast("int")).alias("n_query_findings"), F.sum((F.col("confidence") == "UNCERTAIN").cast("int")).alias("n_query_review"))
    joined = parsed.join(per, "key", "left").na.fill(0, ["n_query_findings", "n_query_review"])
    internal, sensitive = urls.is_internal(F.col("parsed.host")), urls.is_sensitive(F.col("parsed.path"))
    return joined.select(
        "file_id", "line_index", F.col("value").alias("url"), "parsed", internal.alias("internal"), sensitive.alias("sensitive_path"), "n_query_findings", "n_query_review",
        urls.classification(internal, F.col("n_query_findings") > 0, F.col("parsed.scheme"), sensitive).alias("classification"),
    )


def compression_of(files: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``file_id, self_ratio, ncd_human, ncd_ai, compression``: three fifths by the file's own ratio, two fifths by its distances to the two reference texts, if given."""
    c = F.col("content")
    sized = files.where("content IS NOT NULL").select("file_id", "content", compress.gzip_len("content").alias("x"))
    r = compress.ratio(c, F.col("x"))
    near = {"ncd_human": F.lit(None).cast("double"), "ncd_ai": F.lit(None).cast("double")}
    if corpus is not None:
        known = corpus.select("human", "ai", compress.gzip_len("human").alias("human_z"), compress.gzip_len("ai").alias("ai_z"))
        sized = sized.crossJoin(F.broadcast(known)).withColumns({f"{k}_xz": compress.gzip_len(F.concat("content", k)) for k in ("human", "ai")})
        near = {f"ncd_{k}": F.when(F.length(c) == 0, 1.0).otherwise(F.floor(compress.ncd(F.col(f"{k}_xz"), F.col("x"), F.col(f"{k}_z")) * 1000 + 0.5) / 1000) for k in ("human", "ai")}
    rated = sized.select("file_id", r.alias("self_ratio"), *[v.alias(k) for k, v in near.items()])
    own = compress.self_score(F.col("self_ratio")) * 0.6 + F.coalesce(compress.ncd_score(F.col("ncd_ai") - F.col("ncd_human")), F.lit(0.0)) * 0.4
    return rated.withColumn("compression", F.least(F.lit(100.0), F.floor(own + 0.5)))


def _compressed(files: DataFrame) -> DataFrame:
    """Files with ``self_ratio`` and ``compression`` without reference texts, in the same pass as their other measures."""
    r = F.when(F.col("content").isNotNull(), compress.ratio(F.col("content"), compress.gzip_len("content")))
    score = F.when(F.col("self_ratio").isNotNull(), F.least(F.lit(100.0), F.floor(compress.self_score(F.col("self_ratio")) * 0.6 + 0.5)))
    return files.withColumn("self_ratio", r).withColumn("compression", score)


def scan(files: DataFrame, config_documents: DataFrame | None = None, corpus: DataFrame | None = None) -> Scan:
    """``files(file_id, rel_path, ext, size, depth, content)`` to a ``Scan``. What several branches read is written once."""
    lines = cut(placed_lines(files))
    sized = surface.measured(files).join(compression_of(files, corpus), "file_id", "left") if corpus is not None else _compressed(surface.measured(files))
    files = cut(sized.drop("content"))  # what is left of the contents; they are not read again
    face = cut(surface.figures(lines, files))
    minified = face.where("minified").select("file_id")
    candidates = cut(harvest.weld(harvest.harvested(lines)))
    wide = candidates.where("type <> 'url'").join(minified, "file_id", "left_anti")
    sifted = harvest.preflight(wide).where("priority <> 'blob'").withColumn("ord", F.monotonically_increasing_id())
    rated = cut(deep.arbitrated(deep.signals(cut(sifted), ["file_id", "ord"])))
    findings, review = rated.where("confidence IN ('HIGH', 'MEDIUM')"), rated.where("confidence = 'UNCERTAIN'")
    found_urls = cut(url_findings(candidates.where("type = 'url'")))
    hits = cut(rules.hits(lines, files))
    where = classify.territory(F.col("rel_path"))
    base = files.join(face.select("file_id", "avg_line_length"), "file_id", "left").select(
        "file_id", "rel_path", "size", where.alias("territory"), classify.role_weight(where).alias("role_weight"), classify.line_count(F.col("size"), F.col("avg_line_length")).alias("line_count"),
    )
    registry = base
    if config_documents is not None:
        found = cut(mcp.findings(config_documents))
        extra = found.withColumn("file_id", F.xxhash64("path"))
        pseudo = config_documents.withColumn("file_id", F.xxhash64("path")).join(extra.select("file_id").distinct(), "file_id", "left_semi")
        registry = base.unionByName(
            pseudo.select("file_id", F.col("path").alias("rel_path"), F.length("document").cast("bigint").alias("size"), F.lit("config").alias("territory"), F.lit(0.6).alias("role_weight"),
                          classify.line_count(F.length("document"), F.lit(40.0)).alias("line_count"))
        )
        own = extra.select("file_id", F.lit(0).alias("line_index"), "rule_id", F.lit("config-exposure").alias("category"), "severity", F.lit(100).alias("ord"))
        hits = hits.unionByName(own)
    calibrated = project.recalibrate(findings, registry)
    compression = files.select("file_id", "compression")
    parts = (
        registry.join(project.pattern_scores(hits, project.multipliers(hits, registry), registry.select("file_id", "line_count")), "file_id", "left")
        .join(compression, "file_id", "left")
        .join(project.finding_scores(calibrated), "file_id", "left")
        .join(project.url_scores(found_urls), "file_id", "left")
    )
    scores = cut(project.file_axes(parts))
    return Scan(files, lines, face, candidates, calibrated, review, found_urls, hits, scores, project.project_axes(scores), registry)
