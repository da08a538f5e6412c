"""Queries ``pN_...`` of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import prepare, spread, table
from . import bpe, credentials, mixing, provenance, residue, splitting, termfreq


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(spread(table(prepare(spark), d, "file_records")), table(spark, d, "split_limits"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    files = spread(table(prepare(spark), d, "file_records"))
    return splitting.with_text(files, table(spark, d, "split_limits"))


def p1_reassembled(spark: SparkSession, d: str) -> DataFrame:
    files, limits = table(prepare(spark), d, "file_records"), table(spark, d, "split_limits")
    return splitting.reassembled(splitting.with_text(files, limits), limits, files)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where("band IS NOT NULL").select("field_name", "term", "band")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    hits = table(prepare(spark), d, "pattern_hits")
    return termfreq.banded(hits, ["rule_id", "category"], "hit_id", "file_id").withColumnsRenamed({"n_items": "n_hits", "n_records": "n_files"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(spread(table(prepare(spark), d, "file_records")))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(spread(table(prepare(spark), d, "file_records")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.found(spread(table(prepare(spark), d, "file_records")))


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.judged(spread(table(prepare(spark), d, "file_records"))).select("file_id", F.array_join("reasons", " ").alias("reasons"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(table(prepare(spark), d, "documents")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(spread(table(prepare(spark), d, "documents")), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(prepare(spark), d, "documents")), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(spread(table(prepare(spark), d, "documents")))


def p8_units(spark: SparkSession, d: str) -> DataFrame:
    return residue.detect(spread(table(prepare(spark), d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_reassembled, p2_found, p2_terms, p3_found, p3_redacted, p5_found, p5_reasons, p6_ids, p7_mix, p7_shares, p8_found, p8_units)}

_LIMITED = """
WITH f AS (
  SELECT DISTINCT file_id, lower(ext) AS ext, content, compression.segment_scores AS segs
  FROM file_records WHERE content IS NOT NULL AND len(compression.segment_scores) > 0),
l AS (
  SELECT f.file_id, string_split(f.content, chr(10)) AS lines, f.segs,
         coalesce((SELECT max_chars FROM split_limits s WHERE lower(s.ext) = f.ext), (SELECT max_chars FROM split_limits WHERE ext = '*')) AS max_chars
  FROM f),
s AS (
  SELECT file_id, lines, max_chars, unnest(segs) AS seg, CAST(generate_subscripts(segs, 1) - 1 AS INTEGER) AS seg_pos FROM l),
b AS (
  SELECT file_id, lines, max_chars, seg_pos, least(coalesce(seg.start_line, 0), len(lines) - 1) AS a,
         least(coalesce(seg.end_line, len(lines) - 1), len(lines) - 1) AS z
  FROM s WHERE seg IS NOT NULL)
SELECT DISTINCT file_id, seg_pos FROM b
WHERE length(array_to_string(lines[least(a, z) + 1:greatest(a, z) + 1], chr(10))) > max_chars
"""
_WHOLE = _LIMITED.replace(
    "SELECT DISTINCT file_id, seg_pos FROM b", "SELECT DISTINCT file_id, seg_pos, array_to_string(lines[least(a, z) + 1:greatest(a, z) + 1], chr(10)) AS text, true AS within_limit, true AS shares_overlap FROM b"
)

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_TERMS = rf"""
WITH once AS (
  SELECT DISTINCT ON (hit_id) hit_id, file_id, rule_id, category FROM pattern_hits WHERE hit_id IS NOT NULL
  UNION ALL SELECT hit_id, file_id, rule_id, category FROM pattern_hits WHERE hit_id IS NULL),
v AS (
  SELECT 'rule_id' AS field_name, rule_id AS t, file_id FROM once UNION ALL SELECT 'category', category, file_id FROM once),
n AS (
  SELECT field_name, file_id, regexp_replace(regexp_replace(lower(t), '^{_WS}+|{_WS}+$', '', 'g'), '({_WS}|[_-])+', '-', 'g') AS term FROM v WHERE t IS NOT NULL),
g AS (
  SELECT field_name, term, count(*) AS n_hits, count(DISTINCT file_id) AS n_files FROM n WHERE term <> '' GROUP BY 1, 2)
SELECT field_name, term, n_hits, n_files,
  CASE WHEN n_files <= 2 THEN 'rare' WHEN 3 * n_files > (SELECT count(DISTINCT file_id) FROM pattern_hits) THEN 'common' END AS band
FROM g
"""

SQL = {
    "p1_found": _LIMITED,
    "p1_reassembled": _WHOLE,
    "p2_terms": _TERMS,
    "p2_found": f"SELECT field_name, term, band FROM ({_TERMS}) WHERE band IS NOT NULL",
}
