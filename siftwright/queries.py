"""All queries of the engine's own operators over the whole tables, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compress
from .functions import strings as S
from .functions.dialect import re2, sql_trim
from .operators import classify, deep, harvest, herd, mcp, nested, project, render, report, rules, surface, urls
from .plans.scan import compression_of, scan, url_findings
from .runtime import cut, prepare, spread, table
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# shared inputs


def _files(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(spread(table(prepare(spark), d, "file_records")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.placed_lines(_files(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Stored hits once each, with the columns the project operators read."""
    raw = table(prepare(spark), d, "pattern_hits").where("file_id IS NOT NULL")
    once = raw.groupBy("hit_id").agg(F.min(F.struct("file_id", "rule_id", "category", "severity", "line_index")).alias("h")).select("hit_id", "h.*")
    return once.withColumn("category", F.lower(F.trim("category"))).withColumn("ord", F.col("hit_id"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stored candidate values."""
    raw = table(prepare(spark), d, "file_records").select(F.explode("candidates").alias("c"))
    return raw.select("c.value").where("value IS NOT NULL").distinct()


def _url_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(prepare(spark), d, "url_findings").where("url IS NOT NULL").dropDuplicates(["url_id"])


_SKIP = "|".join(n.replace(".", r"\.") for n in tables.SKIPPED)
_FILES = rf"""
f AS (
  SELECT file_id, relative_path AS rel_path, lower(regexp_extract(relative_path, '(\.[^./]+)\z', 1)) AS ext, octet_length(encode(coalesce(content, ''))) AS size,
    length(relative_path) - length(replace(relative_path, '/', '')) AS depth, content
  FROM (SELECT * FROM file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1)
  WHERE lower(regexp_extract(relative_path, '(\.[^./]+)\z', 1)) IN ({", ".join(f"'{e}'" for e in tables.EXTENSIONS)})
    AND NOT regexp_matches(relative_path, '(?:^|/)(?:{_SKIP})/'))"""
_LINES = f"""{_FILES},
l AS (
  SELECT file_id, CAST(unnest(range(len(a))) AS INTEGER) AS line_index, unnest(a) AS line
  FROM (SELECT file_id, string_split(content, chr(10)) AS a FROM f WHERE content IS NOT NULL))"""
_HITS = """
h AS (
  SELECT hit_id, m.file_id AS file_id, m.rule_id AS rule_id, lower(trim(m.category)) AS category, m.severity AS severity, m.line_index AS line_index, hit_id AS ord
  FROM (SELECT hit_id, min({'file_id': file_id, 'rule_id': rule_id, 'category': category, 'severity': severity, 'line_index': line_index}) AS m
        FROM pattern_hits WHERE file_id IS NOT NULL GROUP BY hit_id))"""
_VALUES = "v AS (SELECT DISTINCT c.value AS value FROM (SELECT unnest(candidates) AS c FROM file_records) WHERE c.value IS NOT NULL)"
_URLS = "u AS (SELECT * FROM url_findings WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url_id ORDER BY url) = 1)"


def _any(expr: str, parts) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{p}')" for p in parts) + ")"


_NAME = "list_last(string_split(rel_path, '/'))"
_TERRITORY = f"""CASE WHEN contains(rel_path, 'vendor') THEN 'vendor' WHEN {_any("rel_path", ("dist/", "build/"))} THEN 'dist'
  WHEN contains(rel_path, 'node_modules') THEN 'node_modules' WHEN {_any("rel_path", classify.TEST_MARKS)} THEN 'test'
  WHEN contains({_NAME}, 'config') OR contains({_NAME}, '.rc.') OR (strpos({_NAME}, '.rc') > 0 AND strpos({_NAME}, '.rc') = length({_NAME}) - 2)
    OR contains(rel_path, 'config/') THEN 'config' ELSE 'application' END"""


def _segment(words: list[str]) -> str:
    a = "|".join(words)
    return f"regexp_matches(lower(rel_path), '/(?:{a})|(?:{a})[/.]')"


_BACK, _FRONT = _segment(classify.BACKEND), f"(ext IN ('.jsx', '.tsx') OR {_segment(classify.FRONTEND)})"
_CONTEXT = f"CASE WHEN {_BACK} AND NOT {_FRONT} THEN 'backend' WHEN {_FRONT} AND NOT {_BACK} THEN 'frontend' ELSE 'isomorphic' END"
_WEIGHT = "CASE WHEN territory IN ('vendor', 'dist', 'node_modules') THEN 0.1 WHEN territory = 'test' THEN 0.5 WHEN territory = 'config' THEN 0.6 ELSE 1.0 END"


def _r9(e: str) -> str:
    return f"floor(({e}) * 1e9 + 0.5) / 1e9"


# sources and classification


@query(f"WITH {_FILES} SELECT file_id, rel_path, ext, size, CAST(depth AS INTEGER) AS depth, {_TERRITORY} AS territory FROM f")
def registry(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", "rel_path", "ext", "size", "depth", classify.territory(F.col("rel_path")).alias("territory"))


@query(f"WITH {_LINES} SELECT file_id, line_index, line FROM l")
def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return tables.lines(_files(spark, d))


@query(f"WITH {_FILES} SELECT file_id, rel_path FROM f WHERE file_id IN (SELECT file_id FROM pattern_hits WHERE severity >= 8)")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    grave = table(spark, d, "pattern_hits").where("severity >= 8").select("file_id").distinct()
    scanned = _files(spark, d)
    return tables.changed(scanned, scanned.join(grave, "file_id", "left_semi").select(F.col("rel_path").alias("path"))).select("file_id", "rel_path")


@query(
    f"""WITH {_FILES} SELECT file_id, {_CONTEXT} AS context_type,
  CASE WHEN rel_path LIKE '%.d.ts' THEN 'declaration' WHEN {_segment(classify.CONFIG)} THEN 'config' WHEN {_segment(classify.LOGIC)} THEN 'logic' ELSE 'general' END AS file_type,
  ({_TERRITORY}) = 'test' OR {_any("rel_path", (".test.", ".spec.", "__tests__/"))} AS is_test, rel_path LIKE '%.d.ts' AS is_declaration, {_BACK} AS is_backend, {_FRONT} AS is_frontend FROM f"""
)
def role(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", classify.role(F.col("rel_path"), F.col("ext")).alias("r")).select("file_id", "r.*")


@query(
    f"""WITH {_FILES}, t AS (SELECT f.file_id, f.size, {_TERRITORY} AS territory, r.surface.avg_line_length AS a FROM f JOIN
  (SELECT * FROM file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1) r USING (file_id))
SELECT file_id, {_WEIGHT} AS role_weight, CAST(CASE WHEN a > 0 THEN greatest(floor(size / nullif(a, 0) + 0.5), 1) ELSE greatest(coalesce(nullif(size, 0), 100), 1) END AS BIGINT) AS line_count FROM t"""
)
def file_weights(spark: SparkSession, d: str) -> DataFrame:
    stored = tables.one_each(table(spark, d, "file_records")).select("file_id", F.col("surface.avg_line_length").alias("a"))
    where = classify.territory(F.col("rel_path"))
    return _files(spark, d).join(stored, "file_id").select("file_id", classify.role_weight(where).alias("role_weight"), classify.line_count(F.col("size"), F.col("a")).alias("line_count"))


@query(
    """WITH s AS (SELECT DISTINCT floor(compression.self_ratio * 1000) / 8 - 10 AS x FROM file_records WHERE compression.self_ratio IS NOT NULL)
SELECT x, CASE WHEN x < 0 THEN 0 WHEN x > 100 THEN 100 ELSE floor(x * 10 + 0.5) / 10 END AS clamped,
  CASE WHEN x <= 0 THEN 'Clean' WHEN x <= 10 THEN 'Minimal' WHEN x <= 25 THEN 'Some issues' WHEN x <= 50 THEN 'Concerning' WHEN x <= 75 THEN 'Heavy' ELSE 'Critical' END AS verdict,
  CASE WHEN x <= 0 THEN 'CLEAN' WHEN x <= 10 THEN 'MINIMAL' WHEN x <= 25 THEN 'SOME ISSUES' WHEN x <= 50 THEN 'NOTICEABLE' WHEN x <= 75 THEN 'HEAVY' ELSE 'CATASTROPHIC' END AS label,
  CASE WHEN x / 100 < 0.33 THEN 'low' WHEN x / 100 < 0.66 THEN 'medium' ELSE 'high' END AS signal,
  CASE WHEN x <= 10 THEN 0 WHEN x >= 100 THEN 1 ELSE (x - 10) / 90 END AS weight, CASE WHEN x >= 12 THEN 1 WHEN x <= 6 THEN 0 ELSE (x - 6) / 6 END AS multiplier, CASE WHEN x <= 10 THEN '' WHEN x <= 50 THEN 'yellow' ELSE 'red' END AS color FROM s"""
)
def score_scalars(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.col("compression.self_ratio")
    s = table(spark, d, "file_records").where(ratio.isNotNull()).select((F.floor(ratio * 1000) / 8 - 10).alias("x")).distinct()
    x = F.col("x")
    word = classify.verdict(x)
    return s.select(
        "x", classify.clamp(x).alias("clamped"), word.alias("verdict"), classify.verdict_label(word).alias("label"), classify.signal_label(x / 100).alias("signal"),
        classify.calibration_weight(x).alias("weight"), classify.length_multiplier(x).alias("multiplier"), classify.score_color(x).alias("color"),
    )


# surface


_T = sql_trim("line")
_EFFECTIVE = f"e AS (SELECT * FROM l QUALIFY NOT ({_T} = '' AND line_index = max(line_index) OVER (PARTITION BY file_id)))"


@query(
    f"""WITH {_LINES}, {_EFFECTIVE}, b AS (
  SELECT file_id, count(*) AS n, avg(CASE WHEN {_T} <> '' THEN length(line) END) AS a, avg(CASE WHEN length(line) <= 40 THEN 1.0 ELSE 0 END) AS d0,
    avg(CASE WHEN length(line) > 40 AND length(line) <= 80 THEN 1.0 ELSE 0 END) AS d1, avg(CASE WHEN length(line) > 80 AND length(line) <= 120 THEN 1.0 ELSE 0 END) AS d2,
    avg(CASE WHEN length(line) > 120 THEN 1.0 ELSE 0 END) AS d3 FROM e GROUP BY file_id)
SELECT f.file_id, (coalesce(n, 0) = 1 AND length(content) > 500) OR (coalesce(n, 0) BETWEEN 1 AND 10 AND coalesce(a, 0) >= 200) AS minified,
  CASE WHEN content = '' THEN 0 ELSE {_r9("(length(content) - length(regexp_replace(content, '[{}();]', '', 'g'))) / length(content)")} END AS routing_density,
  {_r9("coalesce(a, 0)")} AS avg_line_length, {_r9("coalesce(d0, 0)")} AS upto_40, {_r9("coalesce(d1, 0)")} AS upto_80, {_r9("coalesce(d2, 0)")} AS upto_120, {_r9("coalesce(d3, 0)")} AS over_120,
  CASE WHEN content = '' THEN 0 ELSE {_r9("(length(content) - length(regexp_replace(content, '[ \\t\\n\\r]', '', 'g'))) / length(content)")} END AS whitespace_ratio
FROM f LEFT JOIN b USING (file_id) WHERE content IS NOT NULL"""
)
def surface_figures(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    s = surface.figures(tables.placed_lines(files), files)
    dist = F.col("line_distribution")
    return s.select(
        "file_id", "minified", S.r9(F.col("routing_density")).alias("routing_density"), S.r9(F.col("avg_line_length")).alias("avg_line_length"),
        *[S.r9(dist[i]).alias(n) for i, n in enumerate(("upto_40", "upto_80", "upto_120", "over_120"))], S.r9(F.col("whitespace_ratio")).alias("whitespace_ratio"),
    )


@query(f"""WITH {_LINES}, {_EFFECTIVE}, q AS (SELECT file_id, substring({_T}, 1, 20) AS prefix, substring({_T}, 1, 60) AS head FROM e),
g AS (SELECT file_id, prefix, head, count(*) AS k FROM q GROUP BY ALL), b AS (SELECT file_id, prefix, sum(k) AS k, max(k) > 1 AS same FROM g GROUP BY ALL HAVING sum(k) >= 3),
c AS (SELECT DISTINCT x.file_id, x.prefix FROM g x JOIN g y ON x.file_id = y.file_id AND x.prefix = y.prefix AND x.head < y.head WHERE levenshtein(x.head, y.head) <= 4),
r AS (SELECT file_id, sum(k) AS r FROM b WHERE same OR EXISTS (SELECT 1 FROM c WHERE c.file_id = b.file_id AND c.prefix = b.prefix) GROUP BY file_id)
SELECT file_id, CASE WHEN n < 3 THEN 0 ELSE {_r9("coalesce(r, 0) / n")} END AS repetition_fraction FROM (SELECT file_id, count(*) AS n FROM q GROUP BY file_id) LEFT JOIN r USING (file_id)""")
def repetition_fraction(spark: SparkSession, d: str) -> DataFrame:
    return surface.repetition(_lines(spark, d)).select("file_id", S.r9(F.col("repetition_fraction")).alias("repetition_fraction"))


@query()
def self_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Compressed sizes differ between compressor builds, so there is no SQL."""
    files = _files(spark, d).where("content IS NOT NULL").withColumn("packed", compress.gzip_len("content"))
    r = compress.ratio(F.col("content"), F.col("packed"))
    return files.select("file_id", r.alias("self_ratio"), F.least(F.lit(100.0), F.floor(compress.self_score(r) * 0.6 + 0.5)).alias("compression_score"))


@query()
def segment_ratios(spark: SparkSession, d: str) -> DataFrame:
    s = surface.segments(_lines(spark, d)).withColumn("packed", compress.gzip_len("text"))
    return s.select("file_id", "start_line", "end_line", compress.ratio(F.col("text"), F.col("packed")).alias("ratio"))


@query(f"""WITH {_LINES}, n AS (SELECT file_id, count(*) AS n FROM l GROUP BY file_id)
SELECT file_id, CAST(s AS INTEGER) AS start_line, CAST(CASE WHEN n < 30 THEN n - 1 ELSE s + 29 END AS INTEGER) AS end_line
FROM (SELECT file_id, n, unnest(CASE WHEN n < 30 THEN [0] ELSE range(0, n - 29, 15) END) AS s FROM n)""")
def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    return surface.segments(_lines(spark, d)).select("file_id", "start_line", "end_line")


@query()
def compression_with_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Ratio, distances and score against two reference texts of fixed size that stand for the corpus files."""
    plain = "function add(left, right) {\n  return left + right;\n}\n" * 40
    odd = "// TODO: implement\nconst data = await fetchData();\nconsole.log(data);\n" * 40
    return compression_of(_files(spark, d), spark.createDataFrame([(plain, odd)], "human string, ai string"))


@query()
def herd_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Stored candidates that pass their herds."""
    c = tables.one_each(table(spark, d, "file_records")).select("file_id", F.posexplode("candidates").alias("ord", "c"))
    rows = c.select("file_id", F.col("ord").cast("bigint").alias("ord"), "c.line_index", "c.identifier_name", "c.value")
    return herd.discriminated(rows).select("file_id", "ord", "herd_id", "herd_size", S.r9(F.col("herd_ihd")).alias("herd_ihd"))


@query()
def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Batch scorer: every non-empty value with its score and verdict."""
    v = F.col("value")
    sized = _values(spark, d).where("value <> ''").withColumn("packed", compress.gzip_len(F.when(F.length(v) >= 80, v)))
    return sized.select("value", S.vector_score(v, compress.ratio(v, F.col("packed"))).alias("s")).select("value", "s.score", "s.is_secret")


# harvest


@query(f"""WITH {_LINES}, q AS (
  SELECT file_id, line_index, unnest(regexp_extract_all(line, '{re2(harvest.URL)}')) AS value FROM l WHERE NOT regexp_matches({_T}, '^(?://|\\*)'))
SELECT file_id, line_index, value FROM q WHERE length(value) >= 10""")
def harvest_urls(spark: SparkSession, d: str) -> DataFrame:
    return harvest.urls(_lines(spark, d)).select("file_id", "line_index", "value")


@query(f"""WITH {_LINES}, q AS (
  SELECT file_id, line_index, 'assignment' AS context, unnest(regexp_extract_all(line, '{re2(harvest.ASSIGN)}', 1)) AS identifier_name, unnest(regexp_extract_all(line, '{re2(harvest.ASSIGN)}', 2)) AS value FROM l
  UNION ALL
  SELECT file_id, line_index, 'object', unnest(regexp_extract_all(line, '{re2(harvest.MEMBER)}', 1)), unnest(regexp_extract_all(line, '{re2(harvest.MEMBER)}', 2)) FROM l)
SELECT file_id, line_index, context, identifier_name, value FROM q""")
def harvest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return harvest.pairs(_lines(spark, d)).select("file_id", "line_index", "context", "identifier_name", "value")


def _unescaped(e: str) -> str:
    for a, b in ((r"\n", "chr(10)"), (r"\t", "chr(9)"), (r"\r", "chr(13)"), (r"\\", r"'\'"), (r"\''", "''''"), (r"\"", "'\"'")):
        e = f"replace({e}, '{a}', {b})"
    return e


@query(f"""WITH {_LINES}, q AS (SELECT file_id, line_index, unnest(regexp_extract_all(line, '{re2(harvest.STRING)}')) AS m FROM l),
  b AS (SELECT file_id, line_index, CASE WHEN m[1] = '`' THEN m ELSE rtrim(m, ' ') END AS m FROM q),
  v AS (SELECT file_id, line_index, {_unescaped("substring(m, 2, length(m) - 2)")} AS value FROM b)
SELECT file_id, line_index, value FROM v WHERE length(value) >= 4""")
def harvest_strings(spark: SparkSession, d: str) -> DataFrame:
    return harvest.strings(_lines(spark, d)).select("file_id", "line_index", "value")


@query()
def weld(spark: SparkSession, d: str) -> DataFrame:
    return harvest.weld(harvest.harvested(_lines(spark, d))).select("file_id", "line_index", "type", "value", "col", "identifier_name", "context")


@query()
def preflight(spark: SparkSession, d: str) -> DataFrame:
    kept = harvest.preflight(harvest.weld(harvest.harvested(_lines(spark, d))))
    return kept.select("file_id", "line_index", "type", "value", "priority")


_STYLE = f"list_filter(list_transform(string_split(value, ';'), lambda s: {sql_trim('s')}), lambda s: s <> '')"


@query(f"""WITH {_VALUES} SELECT value, contains(value, ';') AND len({_STYLE}) >= 2 AND len(list_filter({_STYLE}, lambda s: regexp_matches(s, '^[A-Za-z0-9_.\\-]+=.+\\z'))) * 2 >= len({_STYLE}) AS is_style,
  contains(value, '_') AND regexp_matches(value, '(?i)^[a-z][a-z0-9_]*(?:\\.[a-z][a-z0-9_]*)+\\z') AS is_dotted FROM v""")
def literal_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("value", harvest.is_style(F.col("value")).alias("is_style"), harvest.is_dotted(F.col("value")).alias("is_dotted"))


# string functions


_CHARS = "list_filter(string_split(value, ''), lambda c: c <> '')"
_N = "CAST(length(value) AS DOUBLE)"


def _over(items: str, term: str) -> str:
    """Sum of ``term`` (of the count ``f``) over the distinct items in order."""
    return f"list_sum(list_transform(list_sort(list_distinct({items})), lambda c: {term.replace('@', f'CAST(len(list_filter({items}, lambda x: x = c)) AS DOUBLE)')}))"


def _entropy(value: str = "value") -> str:
    items = f"list_filter(string_split({value}, ''), lambda c: c <> '')"
    n = f"CAST(length({value}) AS DOUBLE)"
    return f"CASE WHEN length({value}) <= 1 THEN 0 ELSE {_over(items, f'-@ / {n} * log2(@ / {n})')} END"


_BIGRAMS = "list_transform(range(1, length(value)), lambda i: substring(value, i, 2))"
_BIENTROPY = _over(_BIGRAMS, f"-@ / ({_N} - 1) * log2(@ / ({_N} - 1))")


def _share(cls: str) -> str:
    return f"length(regexp_replace(value, '{cls}', '', 'g')) / {_N}"


_PROFILE = (_share("[^A-Z]"), _share("[^a-z]"), _share("[^0-9]"), _share("[A-Za-z0-9]"))


def _distance(q: tuple[float, ...]) -> str:
    return "sqrt(" + " + ".join(f"(({p}) - {x}) * (({p}) - {x})" for p, x in zip(_PROFILE, q)) + ")"


_CHARSIGNAL = f"CASE WHEN length(value) <= 1 THEN 0.5 WHEN {_distance(S.CODE)} + {_distance(S.SECRET)} = 0 THEN 0.5 ELSE {_distance(S.CODE)} / ({_distance(S.CODE)} + {_distance(S.SECRET)}) END"


@query(f"""WITH {_VALUES}, e AS (SELECT value, {_entropy()} AS h, CASE WHEN length(value) >= 2 THEN {_BIENTROPY} ELSE 0 END AS b FROM v WHERE value <> ''),
  r AS (SELECT value, h, b, CASE WHEN h = 0 THEN 0 WHEN b / h > 1 THEN greatest(0, 2 - b / h) ELSE b / h END AS r FROM e)
SELECT value, {_r9("h")} AS entropy, {_r9("b")} AS bigram_entropy, {_r9('''CASE WHEN length(value) < 4 OR h = 0 THEN 0.5 WHEN r <= 0.85 THEN greatest(0, least(1, r / 0.85 * 0.3))
  WHEN r >= 0.95 THEN greatest(0, least(1, 0.7 + (r - 0.95) / 0.05 * 0.3)) ELSE greatest(0, least(1, 0.3 + (r - 0.85) / 0.1 * 0.4)) END''')} AS bigram_signal FROM r""")
def entropies(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    both = F.when(F.length(v) >= 2, S.bigram_entropy(v)).otherwise(0.0)
    return _values(spark, d).where("value <> ''").select("value", S.r9(S.entropy(v)).alias("entropy"), S.r9(both).alias("bigram_entropy"), S.r9(S.bigram_signal(v)).alias("bigram_signal"))


@query(f"""WITH {_VALUES} SELECT value, {_r9(_PROFILE[0])} AS upper, {_r9(_PROFILE[1])} AS lower, {_r9(_PROFILE[2])} AS digit, {_r9(_PROFILE[3])} AS symbol,
  {_r9(_CHARSIGNAL)} AS char_signal FROM v WHERE value <> ''""")
def char_profile(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    p = S.profile(v)
    return _values(spark, d).where("value <> ''").select("value", *[S.r9(x).alias(n) for x, n in zip(p, ("upper", "lower", "digit", "symbol"))], S.r9(S.char_signal(v)).alias("char_signal"))


def _changes(mapped: str) -> str:
    return f"len(list_filter(range(2, length(value) + 1), lambda i: substring({mapped}, i, 1) <> substring({mapped}, i - 1, 1)))"


_LDS = "regexp_replace(regexp_replace(regexp_replace(value, '[A-Za-z]', 'L', 'g'), '[0-9]', 'D', 'g'), '[^LD]', 'S', 'g')"
_LUDS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[a-z]', 'l', 'g'), '[0-9]', '0', 'g'), '[A-Z]', 'U', 'g'), '[^l0U]', 'S', 'g')"
_THIRD = "CAST(floor(length(value) / 3) AS BIGINT)"


@query(f"""WITH {_VALUES}, m AS (SELECT value, {_LDS} AS lds, {_LUDS} AS luds, substring(value, 1, {_THIRD}) AS a, substring(value, {_THIRD} * 2 + 1) AS z FROM v WHERE value <> '')
SELECT value, {_r9(f"CASE WHEN length(value) < 2 THEN 1 ELSE {_over(_CHARS, '@ * (@ - 1)')} / ({_N} * ({_N} - 1)) END")} AS ic,
  {_r9(f"CASE WHEN length(value) < 2 THEN 0 ELSE {_changes('lds')} / ({_N} - 1) END")} AS friction, CASE WHEN length(value) < 2 THEN 0 ELSE {_changes("luds")} END AS transitions,
  CASE WHEN length(value) < 9 THEN false ELSE ({_entropy("z")}) > ({_entropy("a")}) + 0.5 END AS egs_spike FROM m""")
def deep_signals(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _values(spark, d).where("value <> ''").select(
        "value", S.r9(S.coincidence(v)).alias("ic"), S.r9(S.friction(v)).alias("friction"), S.transitions(v).cast("bigint").alias("transitions"), S.spikes(S.gradient(v)).alias("egs_spike")
    )


@query(f"""WITH {_VALUES}, k AS (SELECT value, CAST(len(list_distinct({_CHARS})) AS DOUBLE) AS k FROM v WHERE length(value) > 16)
SELECT value, sqrt({_over(_CHARS, f"((@ - {_N} / k) / {_N}) * ((@ - {_N} / k) / {_N})")} / k) < 0.03 AS uniformity FROM k""")
def uniformity(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).where(F.length("value") > 16).select("value", S.uniform(F.col("value")).alias("uniformity"))


@query(f"""WITH {_VALUES}, k AS (SELECT value, {_entropy()} AS h, CAST(len(list_distinct({_CHARS})) AS DOUBLE) AS k, {_LUDS} AS luds FROM v WHERE value <> '' AND length(value) < 80)
SELECT value, {_r9("CASE WHEN k <= 1 THEN 0 ELSE least(1, h / log2(k)) END")} AS d1, {_r9(f"k / {_N}")} AS d2, {_r9(f"least(1, {_distance(S.ENGLISH)} / 2)")} AS d3, {_r9(f"least(1, {_distance(S.CODE)} / 2)")} AS d4,
  {_r9(f"1 - least(1, {_distance(S.SECRET)} / 2)")} AS d5, {_r9(f"CASE WHEN length(value) < 2 THEN 0 ELSE {_changes('luds')} / ({_N} - 1) END")} AS d6 FROM k""")
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Values under 80 characters: there the second dimension needs no compressor."""
    short = _values(spark, d).where("value <> '' AND length(value) < 80").select("value", S.vector(F.col("value")).alias("d"))
    return short.select("value", *[S.r9(F.col("d")[i]).alias(f"d{i + 1}") for i in range(6)])


@query()
def vector_dimensions_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty value, long ones with their compressed length (so no SQL; ``vector_dimensions`` compares the others)."""
    v = F.col("value")
    sized = _values(spark, d).where("value <> ''").withColumn("packed", compress.gzip_len(F.when(F.length(v) >= 80, v)))
    full = sized.select("value", S.vector(v, compress.ratio(v, F.col("packed"))).alias("d"))
    return full.select("value", *[S.r9(F.col("d")[i]).alias(f"d{i + 1}") for i in range(6)])


@query(f"""WITH {_VALUES} SELECT value, list_reduce(list_prepend(5381::HUGEINT, list_transform({_CHARS}, lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 33 + c) % 4294967296)::BIGINT AS djb2 FROM v""")
def djb2(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("value", S.djb2(F.col("value")).alias("djb2"))


@query(f"""WITH {_VALUES} SELECT value, CASE WHEN value = '' THEN 'mixed' WHEN starts_with(value, 'eyJ') THEN 'jwt' WHEN regexp_matches(value, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-') THEN 'uuid'
  WHEN regexp_matches(value, '(?i)^[0-9a-f]+\\z') THEN 'hex-shaped' WHEN regexp_matches(value, '^[A-Za-z0-9+/]+=*\\z') AND length(value) > 8 THEN 'base64-shaped' ELSE 'mixed' END AS shape,
  CASE WHEN length(value) <= 8 THEN '********' ELSE substring(value, 1, 4) || repeat('*', greatest(length(value) - 6, 4)) || right(value, 2) END AS masked FROM v""")
def shape_and_mask(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("value", S.shape(F.col("value")).alias("shape"), S.mask(F.col("value")).alias("masked"))


def _pairs_sql(delimiter: str, separators: str) -> str:
    segments = f"list_filter(list_transform(string_split(value, '{delimiter}'), lambda x: {sql_trim('x')}), lambda x: regexp_matches(x, '[{separators}]'))"
    valid = f"list_filter({segments}, lambda x: regexp_matches(regexp_extract(x, '(?s)^([^{separators}]*)[{separators}]', 1), '^[a-zA-Z][a-zA-Z0-9_.\\-]*\\z'))"
    return f"CASE WHEN len({valid}) >= 3 THEN list_filter(list_transform({valid}, lambda x: regexp_extract(x, '(?s)^[^{separators}]*[{separators}](.*)\\z', 1)), lambda x: x <> '') END"


_PLAIN_QUERY = r"regexp_extract(value, '(?s)^[^?]*\?(.*)\z', 1)"
_VALID_PARAMS = rf"list_filter(list_filter(string_split({_PLAIN_QUERY}, '&'), lambda x: contains(x, '=')), lambda x: regexp_matches(regexp_extract(x, '(?s)^([^=]*)=', 1), '^[a-zA-Z][a-zA-Z0-9_.\-]*\z'))"
_URL_PARTS = rf"""CASE WHEN contains(value, '?') AND (regexp_matches(value, '^https?://') OR regexp_matches({_PLAIN_QUERY}, '^[A-Za-z_][A-Za-z0-9_]*=')) AND len({_VALID_PARAMS}) >= 2
  THEN list_filter(list_transform({_VALID_PARAMS}, lambda x: regexp_extract(x, '(?s)^[^=]*=(.*)\z', 1)), lambda x: x <> '') END"""
_TRIMMED = sql_trim("value")
_JSON_ALL = rf"""list_filter(regexp_extract_all({_TRIMMED}, ':\s*"([^"\\]*(?:\\.[^"\\]*)*)"', 1), lambda x: x <> '')"""
_JSON_PARTS = rf"""CASE WHEN regexp_matches({_TRIMMED}, '(?s)^(?:\{{.*\}}|\[.*\])\z') AND len({_JSON_ALL}) >= 2 THEN {_JSON_ALL} END"""


@query(f"""WITH {_VALUES}, p AS (SELECT value, CASE WHEN value = '' THEN [] ELSE coalesce({_pairs_sql(';', '=')}, {_pairs_sql(',', '=:')}, {_pairs_sql('|', '=')}, {_URL_PARTS}, {_JSON_PARTS}, [value]) END AS p FROM v)
SELECT value, CAST(unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE range(len(p)) END) AS INTEGER) AS part_ord, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS part FROM p""")
def decomposition(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("value", F.posexplode_outer(deep.decompose(F.col("value"))).alias("part_ord", "part"))


@query()
def arbitration(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct stored value through decomposition, scores, signals and tiers (compressed lengths inside, so no SQL)."""
    rated = deep.arbitrated(deep.signals(_values(spark, d).withColumn("key", F.col("value")), ["key"]))
    return rated.select("masked", "shape", "confidence", "pipeline_score", "signal_count")


_TIERS = "pipeline * CASE WHEN n >= 12 THEN 1.0 WHEN n <= 6 THEN 0.0 ELSE (n - 6) / 6.0 END"


@query(f"""WITH x AS (SELECT DISTINCT floor(compression.self_ratio * 100) / 100 AS pipeline, CAST(size % 16 AS INTEGER) AS n, CAST(size % 5 AS INTEGER) AS others FROM file_records WHERE compression.self_ratio IS NOT NULL AND size IS NOT NULL)
SELECT pipeline, n, others, CASE WHEN {_TIERS} >= 0.65 AND others >= 2 THEN 'HIGH' WHEN {_TIERS} >= 0.50 AND others >= 2 THEN 'MEDIUM' WHEN pipeline >= 0.40 OR others >= 1 THEN 'UNCERTAIN' END AS confidence FROM x""")
def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").where("compression.self_ratio IS NOT NULL AND size IS NOT NULL")
    x = f.select((F.floor(F.col("compression.self_ratio") * 100) / 100).alias("pipeline"), (F.col("size") % 16).cast("int").alias("n"), (F.col("size") % 5).cast("int").alias("others")).distinct()
    return x.withColumn("confidence", deep.confidence(F.col("pipeline"), F.col("n"), F.col("others")))


# URLs


_REST = "CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE url END"
_PARSED = f"""{_URLS}, a AS (SELECT *, CASE WHEN contains(url, '://') THEN lower(substring(url, 1, strpos(url, '://') - 1)) ELSE '' END AS scheme, {_REST} AS r0 FROM u),
b AS (SELECT *, CASE WHEN contains(r0, '#') THEN substring(r0, strpos(r0, '#') + 1) ELSE '' END AS fragment, string_split(r0, '#')[1] AS r1 FROM a),
c AS (SELECT *, CASE WHEN contains(r1, '?') THEN substring(r1, strpos(r1, '?') + 1) ELSE '' END AS query, string_split(r1, '?')[1] AS r2 FROM b),
e AS (SELECT *, string_split(r2, '/')[1] AS authority, CASE WHEN contains(r2, '/') THEN substring(r2, strpos(r2, '/')) ELSE '' END AS path FROM c),
p AS (SELECT url_id, file_id, url, scheme, authority, path, query, fragment, CASE WHEN regexp_matches(authority, ':[^:\\]]*\\z') THEN regexp_extract(authority, ':([^:\\]]*)\\z', 1) ELSE '' END AS port,
  regexp_replace(CASE WHEN regexp_matches(authority, ':[^:\\]]*\\z') THEN regexp_extract(authority, '^(.*):[^:\\]]*\\z', 1) ELSE authority END, '[\\x27\\x22`;,)\\]}}>]+\\z', '') AS hostname FROM e)"""
_PRIVATE = "|".join(x.replace(".", r"\.") for x in urls.PRIVATE)
_SUFFIX = "|".join(x[1:].replace(".", r"\.") for x in urls.SUFFIXES)
_INTERNAL = f"(regexp_matches(lower(hostname), '^(?:{_PRIVATE})') OR regexp_matches(lower(hostname), '(?:^|\\.)(?:{_SUFFIX})\\z'))"
_SENSITIVE = f"regexp_matches(lower(path), '{'|'.join(urls.SENSITIVE)}')"


@query(f"WITH {_PARSED} SELECT url_id, scheme, authority, hostname, port, path, query, fragment, {_INTERNAL} AS is_internal, {_SENSITIVE} AS is_sensitive FROM p")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _url_rows(spark, d).select("url_id", urls.parse(F.col("url")).alias("p"))
    return p.select(
        "url_id", "p.scheme", "p.authority", F.col("p.host").alias("hostname"), "p.port", "p.path", "p.query", "p.fragment",
        urls.is_internal(F.col("p.host")).alias("is_internal"), urls.is_sensitive(F.col("p.path")).alias("is_sensitive"),
    )


_PARAMS = f"""{_PARSED}, q AS (SELECT url_id, unnest(string_split(query, '&')) AS kv FROM p),
k AS (SELECT url_id, string_split(kv, '=')[1] AS key, replace(replace(replace(substring(kv, strpos(kv, '=') + 1), '%20', ' '), '%3D', '='), '%26', '&') AS value FROM q WHERE contains(kv, '='))"""


@query(f"WITH {_PARAMS} SELECT url_id, key, value FROM k WHERE length(value) >= 4")
def url_params(spark: SparkSession, d: str) -> DataFrame:
    return _url_rows(spark, d).select("url_id", F.explode(urls.params(urls.parse(F.col("url"))["query"])).alias("kv")).select("url_id", "kv.key", "kv.value")


#: Parameters put behind the stored URLs, alike ones, unlike ones or none, so that the gate has something to hold back
_MADE_URL = "CASE url_id % 3 WHEN 0 THEN url || '?a=abcd1234&b=efgh5678&c=wxyz9012' WHEN 1 THEN url || '?a=aaaa&b=' || md5(url) || '&c=zz11' ELSE url END"
_MADE_PARAMS = _PARAMS.replace(f"{_URLS}, a AS", f"{_URLS}, m AS (SELECT * REPLACE ({_MADE_URL} AS url) FROM u), a AS").replace("AS r0 FROM u)", "AS r0 FROM m)")


@query(f"""WITH {_MADE_PARAMS}, g AS (SELECT url_id, key, value, {_entropy()} AS h FROM k WHERE length(value) >= 4),
s AS (SELECT url_id, count(*) AS n, var_pop(h) AS v, max(h) - min(h) AS i FROM g GROUP BY url_id)
SELECT url_id, key, value FROM g JOIN s USING (url_id) WHERE NOT (n >= 3 AND {_r9("v")} < 0.4 AND {_r9("i")} <= 1.5)""")
def url_herd_gate(spark: SparkSession, d: str) -> DataFrame:
    made = _url_rows(spark, d).withColumn("url", F.expr(_MADE_URL))
    each = made.select("url_id", F.explode(urls.params(urls.parse(F.col("url"))["query"])).alias("kv")).select("url_id", "kv.key", "kv.value")
    return urls.gated(each, "url_id")


@query()
def url_classification(spark: SparkSession, d: str) -> DataFrame:
    rows = _url_rows(spark, d).select("file_id", F.coalesce("line_index", F.lit(0)).alias("line_index"), F.col("url_id").alias("ord"), F.col("url").alias("value"))
    return url_findings(rows).select("file_id", "line_index", "url", "internal", "sensitive_path", "classification", "n_query_findings", "n_query_review")


@query(f"""WITH {_URLS}, two AS (SELECT url, classification, file_id FROM u UNION ALL SELECT url, classification, file_id + url_id % 3 FROM u)
SELECT url, count(DISTINCT file_id) AS file_count, count(*) AS n_locations FROM two WHERE classification = 'internal-exposed' AND file_id IS NOT NULL AND url <> '' GROUP BY url HAVING count(DISTINCT file_id) >= 2""")
def url_crossref(spark: SparkSession, d: str) -> DataFrame:
    """Every stored URL stands in its file and, for two thirds of them, in another one too."""
    rows = _url_rows(spark, d).select("url", "classification", "file_id", "url_id")
    return project.url_crossref(rows.unionByName(rows.withColumn("file_id", F.col("file_id") + F.col("url_id") % 3)))


# rules


_BARE = "line"
for _p, _to in zip(rules.EMPTIED, ("''''''", "'\"\"'", "'``'", "'//'")):
    _BARE = f"regexp_replace({_BARE}, '{re2(_p)}', {_to}, 'g')"
_CTX = f"""{_LINES}, x AS (
  SELECT l.*, {_T} AS t, {_CONTEXT} = 'backend' AS backend, {_CONTEXT} = 'frontend' AS frontend, {_BARE} AS bare,
    {", ".join(f"regexp_extract(line, '{re2(p)}', {g}) AS {n}" for n, (p, g) in rules.EXTRACTED.items())}
  FROM l JOIN f USING (file_id)),
c AS (SELECT *, length(indent) + 3 * length(replace(indent, ' ', '')) >= 20 AS deep FROM x)"""
_PREDS = rules._stateless()


@query(f"WITH {_CTX} " + " UNION ALL ".join(f"SELECT file_id, line_index, '{r}' AS rule_id FROM c WHERE {_PREDS[r].sql}" for r in rules.STATELESS))
def rules_stateless(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return rules.stateless_hits(rules.with_context(tables.placed_lines(files), files))


_W = "PARTITION BY file_id ORDER BY line_index"
_BRANCH = rf"(regexp_matches(line, '{re2(r'\bif\s*\(')}') AND NOT starts_with(t, '//'))"
_REAL = "(length(t) > 5 AND NOT starts_with(t, '//') AND NOT starts_with(t, '*') AND t NOT IN ('{', '}', '};'))"
_SKIP_T = rf"(t IN ('', '{{') OR regexp_matches(t, '{re2(r'^console\.(?:error|warn|log|info|debug)\s*\(')}') OR starts_with(t, '//') OR starts_with(t, '*'))"
_WIN = f"""{_CTX}, w AS (SELECT file_id, line_index, line, t, {_BRANCH} AS branch,
  lead(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER ({_W}) AS next_solid, lag(CASE WHEN t <> '' THEN line END IGNORE NULLS) OVER ({_W}) AS prev_solid,
  first(CASE WHEN NOT {_SKIP_T} THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING) AS next_handled,
  sum(CAST({_BRANCH} AS INT)) OVER ({_W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS branches,
  sum(CAST({_REAL} AS INT)) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) - CAST({_REAL} AS INT) AS reals,
  last(CASE WHEN t NOT IN ('', '{{', '}}') THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev_body,
  first(CASE WHEN t NOT IN ('', '{{') THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS next_after,
  first(CASE WHEN t NOT IN ('', '{{') THEN t END IGNORE NULLS) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS next_getter FROM c),
g AS (SELECT *, lower(regexp_extract(t, '{re2(r"^get\s+(\w+)\s*\(\s*\)\s*\{?\s*$")}', 1)) AS prop, lower(regexp_extract(next_getter, '{re2(r"(?i)^return\s+this[._#](\w+)\s*;?$")}', 1)) AS tail FROM w)"""
_WRULES = {
    "empty-catch-block": rf"regexp_matches(t, '{re2(r'catch\s*\(')}') AND next_solid = '}}'",
    "unnecessary-else-after-return": rf"regexp_matches(line, '{re2(r'^\s*\}\s*else\s*\{')}') AND regexp_matches(prev_solid, '{re2(r'^\s*return\b')}')",
    "error-silencing": rf"regexp_matches(line, '{re2(r'\bcatch\s*\(')}') AND next_handled IN ('}}', '}};', '}} catch', '}} finally')",
    "complexity-spike": "branch AND branches >= 8",
    "comment-mismatch": rf"regexp_matches(line, '(?i){re2(r'//\s*(?:TODO|FIXME):?\s*(?:implement|complete|add|write|fill|finish)')}') AND reals >= 5",
    "branch-symmetry": rf"regexp_matches(line, '{re2(r'^\s*\}\s*else\s*(?:\{|$)')}') AND regexp_matches(prev_body, '{re2(r'^return\b')}') AND next_after = prev_body",
    "accessor-bloat": "prop <> '' AND tail <> '' AND tail IN (prop, prop || '_', '_' || prop, '_' || prop || '_')",
}


@query(f"WITH {_WIN} " + " UNION ALL ".join(f"SELECT file_id, line_index, '{r}' AS rule_id FROM g WHERE {p}" for r, p in _WRULES.items()))
def rules_windowed(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return rules.windowed_hits(rules.with_context(tables.placed_lines(files), files))


_OPEN = rf"regexp_matches(line, '{re2(r'\basync\s+(?:function|\()')}')"


@query(rf"""WITH {_LINES}, o AS (SELECT file_id, line_index AS start FROM l WHERE {_OPEN}),
r AS (SELECT l.file_id, start, line_index, length(replace(line, '}}', '')) - length(replace(line, '{{', '')) AS net, contains(line, '{{') AS opens, regexp_matches(line, '{re2(r'\bawait\b')}') AS waits
  FROM o JOIN l ON l.file_id = o.file_id AND line_index BETWEEN start AND start + 29),
k AS (SELECT *, sum(net) OVER p AS depth, sum(CAST(opens AS INT)) OVER p AS seen FROM r WINDOW p AS (PARTITION BY file_id, start ORDER BY line_index ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, coalesce(sum(CASE WHEN seen > 0 AND depth <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, start ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM k)
SELECT file_id, start AS line_index, 'async-without-await' AS rule_id FROM z GROUP BY file_id, start HAVING NOT bool_or(waits AND line_index > start AND over = 0)""")
def rule_async_without_await(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return rules.async_hits(rules.with_context(tables.placed_lines(files), files))


_DECL = f"lower(CASE WHEN regexp_extract(line, '{re2(rules.FUNCTION_NAME)}', 1) <> '' THEN regexp_extract(line, '{re2(rules.FUNCTION_NAME)}', 1) ELSE regexp_extract(line, '{re2(rules.ASSIGNED_NAME)}', 1) END)"
_VERB = "|".join(rules.VERBS)


@query(f"""WITH {_LINES}, n AS (SELECT file_id, line_index, {_DECL} AS name FROM l),
m AS (SELECT file_id, line_index, regexp_extract(name, '^({_VERB})', 1) AS verb, regexp_replace(name, '^(?:{_VERB})', '') AS stem FROM n WHERE regexp_matches(name, '^(?:{_VERB})'))
SELECT file_id, line_index, 'clone-pollution' AS rule_id FROM m a WHERE length(stem) >= 3 AND EXISTS (
  SELECT 1 FROM m b WHERE b.file_id = a.file_id AND b.stem = a.stem AND b.verb <> a.verb AND b.line_index < 300)""")
def rule_clone_pollution(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return rules.clone_hits(rules.with_context(tables.placed_lines(files), files))


#: Three lines put behind those of each file, so that clones occur
_MADE_LINES = (
    "'function get' || 'Row' || (file_id % 7) || '() {'",
    "'const ' || (CASE file_id % 3 WHEN 0 THEN 'load' WHEN 1 THEN 'get' ELSE 'fetch' END) || 'Row' || (file_id % 7) || ' = async function () {'",
    "'function ' || (CASE file_id % 2 WHEN 0 THEN 'obtain' ELSE 'read' END) || 'Ab() {'",
)
_MADE_SQL = f"""{_FILES}, l AS (
  SELECT file_id, CAST(unnest(range(len(a))) AS INTEGER) AS line_index, unnest(a) AS line
  FROM (SELECT file_id, list_concat([{", ".join(_MADE_LINES)}], string_split(content, chr(10))) AS a FROM f WHERE content IS NOT NULL))"""
_CLONES = SQL["rule_clone_pollution"].replace(f"WITH {_LINES}", f"WITH {_MADE_SQL}")


def _made_lines(spark: SparkSession, d: str) -> DataFrame:
    made = F.array_join(F.array(*[F.expr(x) for x in _MADE_LINES], F.col("content")), "\n")
    return tables.placed_lines(_files(spark, d).where("content IS NOT NULL").withColumn("content", made))


@query(_CLONES)
def clone_pollution_made(spark: SparkSession, d: str) -> DataFrame:
    return rules.clone_hits(rules.with_roles(_made_lines(spark, d)))


@query(f"""WITH {_MADE_SQL}, hit AS ({_CLONES}), n AS (SELECT file_id, {_DECL} AS name FROM l JOIN hit USING (file_id, line_index))
SELECT name, count(DISTINCT file_id) AS file_count, count(*) AS n_locations FROM n WHERE name <> '' GROUP BY name HAVING count(DISTINCT file_id) >= 2""")
def clone_map(spark: SparkSession, d: str) -> DataFrame:
    lines = _made_lines(spark, d)
    return project.clone_map(rules.clone_hits(rules.with_roles(lines)).withColumn("category", F.col("rule_id")), lines)


# hits, project, report over the stored tables


_AXIS = "CASE WHEN category IN ('security', 'config-exposure', 'dependency') THEN 'B' WHEN category IN ('error-handling', 'async-abuse', 'structure-smell', 'complexity-spike', 'magic-values', 'import-hygiene', 'promise-graveyard') THEN 'C' ELSE 'A' END"


@query(f"WITH {_HITS} SELECT category, count(*) AS hit_count, count(DISTINCT file_id) AS file_count, max(severity) AS max_severity, {_AXIS} AS axis FROM h GROUP BY category")
def slop_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.breakdown(_hits(spark, d))


@query(f"WITH {_HITS} SELECT rule_id, count(*) AS hit_count FROM h GROUP BY rule_id")
def tag_index(spark: SparkSession, d: str) -> DataFrame:
    return report.tag_index(_hits(spark, d))


_DOM = f"""{_HITS}, g AS (SELECT file_id, coalesce(category, 'unknown') AS category, count(*) AS n, min({{'l': line_index, 'o': ord}}) AS first FROM h GROUP BY ALL),
dom AS (SELECT file_id, category, n AS n_hits FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first.l NULLS FIRST, first.o, category) = 1)"""


@query(f"WITH {_DOM} SELECT file_id, category, n_hits FROM dom")
def dominant_category(spark: SparkSession, d: str) -> DataFrame:
    return project.dominant_category(_hits(spark, d).withColumn("line_index", F.coalesce("line_index", F.lit(-1))))


SQL["dominant_category"] = SQL["dominant_category"].replace("'l': line_index", "'l': coalesce(line_index, -1)")


@query(SQL["dominant_category"].split(" SELECT file_id, category, n_hits")[0] + f""", {_FILES} SELECT CASE WHEN contains(rel_path, '/') THEN regexp_extract(rel_path, '^(.*)/[^/]*\\z', 1) ELSE '.' END AS directory, category, count(*) AS file_count
FROM dom JOIN f USING (file_id) GROUP BY ALL HAVING count(*) >= 3""")
def slop_clusters(spark: SparkSession, d: str) -> DataFrame:
    return project.slop_clusters(_hits(spark, d).withColumn("line_index", F.coalesce("line_index", F.lit(-1))), _files(spark, d))


_CANDS = "c AS (SELECT file_id, c.value AS value FROM (SELECT file_id, unnest(candidates) AS c FROM file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1) WHERE c.value IS NOT NULL)"


@query(f"WITH {_CANDS} SELECT value, count(DISTINCT file_id) AS file_count, count(*) AS n_locations FROM c WHERE length(value) >= 8 GROUP BY value HAVING count(DISTINCT file_id) >= 2".replace("file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1", "(SELECT * FROM file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1)"))
def duplicate_values(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.one_each(table(spark, d, "file_records")).select("file_id", F.explode("candidates").alias("c")).select("file_id", "c.value")
    return project.shared_values(rows, "value", "value", 8)


@query("""WITH m AS (SELECT median(compression.self_ratio) AS m FROM file_records)
SELECT m AS median, (SELECT median(abs(compression.self_ratio - m)) FROM file_records) AS mad FROM m""")
def median_mad(spark: SparkSession, d: str) -> DataFrame:
    return project.median_mad(table(spark, d, "file_records").select(F.col("compression.self_ratio").alias("r")), "r")


_MULT = f"""{_HITS}, t AS (SELECT count(*) AS total FROM f), m AS (SELECT coalesce(category, 'unknown') AS category, count(DISTINCT file_id) AS n_files FROM h GROUP BY 1),
mult AS (SELECT category, n_files, CASE WHEN n_files / total > 0.5 THEN 0.5 WHEN n_files / total > 0.3 THEN 0.75 ELSE 1.0 END AS multiplier FROM m, t)"""


@query(f"WITH {_FILES}, {_MULT} SELECT category, n_files, multiplier FROM mult")
def category_multipliers(spark: SparkSession, d: str) -> DataFrame:
    return project.multipliers(_hits(spark, d), _files(spark, d))


@query("""WITH f AS (SELECT DISTINCT file_id, compression.self_ratio AS score, CASE WHEN size % 3 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM file_records WHERE compression.self_ratio IS NOT NULL AND size IS NOT NULL),
m AS (SELECT median(score) AS m FROM f), s AS (SELECT m, (SELECT median(abs(score - m)) FROM f) AS mad, (SELECT count(*) FROM f) AS n FROM m)
SELECT file_id, score AS pipeline_score, confidence, CASE WHEN score BETWEEN m - mad AND m + mad AND n >= 55 THEN CASE WHEN confidence = 'HIGH' THEN 'MEDIUM' ELSE 'UNCERTAIN' END ELSE confidence END AS confidence_calibrated,
  score BETWEEN m - mad AND m + mad AND n > 10 AS calibrated FROM f, s""")
def recalibration(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").where("compression.self_ratio IS NOT NULL AND size IS NOT NULL")
    rows = f.select("file_id", F.col("compression.self_ratio").alias("pipeline_score"), F.when(F.col("size") % 3 == 0, "HIGH").otherwise("MEDIUM").alias("confidence")).distinct()
    return project.recalibrate(rows, rows)


@query("""WITH f AS (SELECT DISTINCT file_id, compression.self_ratio AS self_ratio, CAST(size % 7 AS DOUBLE) AS outlier_score FROM file_records WHERE file_id IS NOT NULL AND size IS NOT NULL),
m AS (SELECT median(self_ratio) AS m FROM f), s AS (SELECT m, (SELECT median(abs(self_ratio - m)) FROM f) AS mad, (SELECT count(*) FROM f) AS n FROM m),
c AS (SELECT f.*, coalesce(self_ratio BETWEEN m - 1.5 * mad AND m + 1.5 * mad AND n > 10, false) AS calibrated FROM f, s)
SELECT file_id, self_ratio, CASE WHEN calibrated THEN 0 ELSE outlier_score END AS outlier_score, calibrated FROM c""")
def compression_recalibration(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_records").where("file_id IS NOT NULL AND size IS NOT NULL")
    return project.recalibrate_compression(f.select("file_id", F.col("compression.self_ratio").alias("self_ratio"), (F.col("size") % 7).cast("double").alias("outlier_score")).distinct())


_FOUND = f"{_CANDS}, fi AS (SELECT file_id, length(value) % 16 / 16 AS p, length(value) % 3 = 0 AS high, length(value) % 5 = 0 AS unsure FROM c)"
_ONE = "file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1"


@query(f"""WITH {_FOUND}, s AS (SELECT file_id, sum(p * CASE WHEN high THEN 1.0 ELSE 0.6 END) AS p FROM fi GROUP BY file_id)
SELECT file_id, {_r9("least(p * 5, 100)")} AS finding_other, {_r9("least(p * 10, 100)")} AS finding_b FROM s""".replace(_ONE, f"(SELECT * FROM {_ONE})"))
def finding_axis(spark: SparkSession, d: str) -> DataFrame:
    s = project.finding_scores(_found(spark, d))
    return s.select("file_id", *[S.r9(F.col(c)).alias(c) for c in ("finding_other", "finding_b")])


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Stored candidates as findings, with scores and tiers by their lengths."""
    rows = tables.one_each(table(spark, d, "file_records")).select("file_id", F.explode("candidates").alias("c")).select("file_id", "c.value", "c.line_index").where("value IS NOT NULL")
    n = F.length("value")
    return rows.select("file_id", "value", "line_index", (n % 16 / 16).alias("pipeline_score"), F.when(n % 3 == 0, "HIGH").otherwise("MEDIUM").alias("confidence_calibrated"), (n % 5 == 0).alias("unsure"))


@query(f"""WITH {_FILES}, {_HITS}, {_URLS}, {_FOUND}
SELECT f.file_id, (SELECT count(*) FROM h WHERE h.file_id = f.file_id) AS n_hits, (SELECT count(*) FROM fi WHERE fi.file_id = f.file_id AND unsure) AS n_review,
  (SELECT count(*) FROM u WHERE u.file_id = f.file_id AND classification <> 'safe-external') AS n_exposure FROM f""".replace(_ONE, f"(SELECT * FROM {_ONE})", 1))
def counts_by_file(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by_file(_files(spark, d), hits=_hits(spark, d), review=_found(spark, d).where("unsure"), exposure=report.exposure(_url_rows(spark, d)))


def _line_counts(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("file_id", F.greatest(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))), F.lit(1)).alias("line_count")).na.fill(1)


def _axis_weight(axis: str) -> str:
    return "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in project.weights(axis).items()) + " ELSE 0 END"


_PATTERN = f"""{_FILES}, {_MULT}, n AS (SELECT file_id, coalesce(greatest(length(content) - length(replace(content, chr(10), '')), 1), 1) AS line_count FROM f),
pat AS (SELECT file_id, {", ".join(f"least(sum(coalesce(nullif(severity, 0), 1) * {_axis_weight(a)} * coalesce(multiplier, 1)) / any_value(line_count) * 100, 100) AS pattern_{a.lower()}" for a in "ABC")}
  FROM h LEFT JOIN mult USING (category) JOIN n USING (file_id) GROUP BY file_id)"""


@query(f"WITH {_PATTERN} SELECT file_id, {', '.join(_r9(f'pattern_{a}') + f' AS pattern_{a}' for a in 'abc')} FROM pat")
def pattern_axis(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    s = project.pattern_scores(hits, project.multipliers(hits, _files(spark, d)), _line_counts(spark, d))
    return s.select("file_id", *[S.r9(F.col(f"pattern_{a}")).alias(f"pattern_{a}") for a in "abc"])


_URLSCORE = f"""{_URLS}, us AS (SELECT file_id, CAST(least(sum(CASE classification WHEN 'internal-exposed' THEN 20 WHEN 'sensitive-parameter' THEN 30 WHEN 'suspicious-external' THEN 15 ELSE 0 END), 100) AS DOUBLE) AS url_b,
  CAST(least(sum(CASE classification WHEN 'internal-exposed' THEN 5 WHEN 'sensitive-parameter' THEN 8 WHEN 'suspicious-external' THEN 10 ELSE 0 END), 100) AS DOUBLE) AS url_other FROM u GROUP BY file_id)"""


@query(f"WITH {_URLSCORE} SELECT file_id, url_other, url_b FROM us")
def url_axis(spark: SparkSession, d: str) -> DataFrame:
    return project.url_scores(_url_rows(spark, d).withColumn("n_query_findings", F.lit(0)))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    files, hits = _files(spark, d), _hits(spark, d)
    counts = _line_counts(spark, d)
    stored = tables.one_each(table(spark, d, "file_records")).select("file_id", F.col("compression.compression_score").cast("double").alias("compression"))
    where = classify.territory(F.col("rel_path"))
    parts = (
        files.select("file_id", "rel_path", classify.role_weight(where).alias("role_weight")).join(counts, "file_id")
        .join(project.pattern_scores(hits, project.multipliers(hits, files), counts), "file_id", "left")
        .join(stored, "file_id", "left")
        .join(project.url_scores(_url_rows(spark, d).withColumn("n_query_findings", F.lit(0))), "file_id", "left")
    )
    none = F.lit(0.0)
    return project.file_axes(parts.withColumns({"finding_other": none, "finding_b": none}))


def _axis_sql(a: str) -> str:
    p, c, _, u, k = project.PARTS[a]
    own = "url_b" if a == "B" else "url_other"
    x = f"(coalesce(pattern_{a.lower()}, 0) * {p} + coalesce(compression, 0) * {k} * {c} + 0 + coalesce({own}, 0) * {u})"
    return f"CASE WHEN {x} < 0 THEN 0 WHEN {x} > 100 THEN 100 ELSE floor({x} * 10 + 0.5) / 10 END AS axis_{a.lower()}"


_SCORED = f"""{_PATTERN}, {_URLSCORE}, ss AS (SELECT file_id, CAST(compression.compression_score AS DOUBLE) AS compression FROM file_records WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) = 1),
sc AS (SELECT f.file_id, rel_path, {_WEIGHT.replace("territory", f"({_TERRITORY})")} AS role_weight, line_count, {", ".join(_axis_sql(a) for a in "ABC")}
  FROM f JOIN n USING (file_id) LEFT JOIN pat USING (file_id) LEFT JOIN ss USING (file_id) LEFT JOIN us USING (file_id))"""


@query(f"WITH {_SCORED} SELECT file_id, role_weight, line_count, axis_a, axis_b, axis_c FROM sc")
def file_axes(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("file_id", "role_weight", F.col("line_count").cast("bigint").alias("line_count"), "axis_a", "axis_b", "axis_c")


_MEANS = ", ".join(f"floor(sum(axis_{a} * role_weight * line_count) / sum(role_weight * line_count) * 10 + 0.5) / 10 AS axis_{a}" for a in "abc")


@query(f"""WITH {_SCORED}, pr AS (SELECT {_MEANS}, CAST(sum(line_count) AS BIGINT) AS total_lines, count(*) AS file_count FROM sc)
SELECT *, CAST(axis_a > 50 OR axis_b > 25 OR axis_c > 100 AS INTEGER) AS exit_code FROM pr""")
def project_summary(spark: SparkSession, d: str) -> DataFrame:
    return project.exit_code(project.project_axes(_scored(spark, d)))


@query(f"WITH {_SCORED} SELECT file_id, greatest(axis_a, axis_b, axis_c) AS max_axis FROM sc WHERE greatest(axis_a, axis_b, axis_c) > 10 ORDER BY max_axis DESC, file_id LIMIT 10")
def top_offenders(spark: SparkSession, d: str) -> DataFrame:
    return report.top_offenders(_scored(spark, d)).select("file_id", "max_axis")


@query(f"WITH {_SCORED} SELECT file_id, axis_b FROM sc WHERE axis_b > 1 ORDER BY axis_b DESC, file_id LIMIT 10")
def security_concerns(spark: SparkSession, d: str) -> DataFrame:
    return report.security_concerns(_scored(spark, d)).select("file_id", "axis_b")


@query(f"""WITH {_FILES}, {_HITS}, {_URLS} SELECT file_id, rel_path FROM f WHERE file_id NOT IN (SELECT file_id FROM h)
  AND file_id NOT IN (SELECT file_id FROM u WHERE classification <> 'safe-external' AND file_id IS NOT NULL)""")
def clean_files(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "file_id bigint")
    return report.clean_files(_files(spark, d), none, _hits(spark, d), _url_rows(spark, d)).select("file_id", "rel_path")


@query(f"""WITH {_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY file_id, category ORDER BY line_index NULLS FIRST, ord) AS a, row_number() OVER (PARTITION BY file_id, category ORDER BY severity DESC NULLS LAST, line_index NULLS FIRST, ord) AS b
  FROM h)
SELECT file_id, category, count(*) AS hit_count, array_to_string(list_sort(coalesce(list(line_index + 1) FILTER (a <= 3 AND line_index IS NOT NULL), [])), ',') AS first_lines, array_to_string(coalesce(list(rule_id ORDER BY b) FILTER (b <= 2 AND rule_id IS NOT NULL), []), ',') AS worst_rules FROM o GROUP BY ALL""")
def display_groups(spark: SparkSession, d: str) -> DataFrame:
    g = report.display_groups(_hits(spark, d))
    return g.select("file_id", "category", "hit_count", F.array_join(F.col("first_lines").cast("array<string>"), ",").alias("first_lines"), F.array_join("worst_rules", ",").alias("worst_rules"))


_SNIP = "CASE WHEN length(t) > 72 THEN substring(t, 1, 72) || '…' ELSE t END"


@query(f"""WITH {_LINES}, {_HITS} SELECT file_id, rel_path, {_NAME} AS file_name, rule_id, severity, line_index + 1 AS line_number, {_SNIP} AS snippet
FROM (SELECT h.*, rel_path, {_T} AS t FROM h JOIN f USING (file_id) JOIN l USING (file_id, line_index))""")
def hit_list(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return report.hit_list(_hits(spark, d), files, tables.placed_lines(files))


@query(f"""WITH {_HITS}, i AS (SELECT file_id, line_index + 1 AS line_number, ord FROM h WHERE line_index IS NOT NULL), w AS (SELECT file_id, unnest([1, 25, 60, 400]) AS line_number FROM (SELECT DISTINCT file_id FROM i)),
j AS (SELECT w.file_id, w.line_number, abs(i.line_number - w.line_number) AS gap, ord FROM w JOIN i ON i.file_id = w.file_id)
SELECT file_id, line_number, gap, ord FROM j QUALIFY row_number() OVER (PARTITION BY file_id, line_number ORDER BY gap, ord) = 1""")
def nearest_hit(spark: SparkSession, d: str) -> DataFrame:
    items = _hits(spark, d).where("line_index IS NOT NULL").select("file_id", (F.col("line_index") + 1).alias("line_number"), "ord")
    return report.nearest(items, items.select("file_id").distinct().withColumn("line_number", F.explode(F.array(*map(F.lit, (1, 25, 60, 400))))))


@query(f"""WITH x AS (SELECT DISTINCT c.value AS value, coalesce(c.line_index, -1) AS line_index, file_id FROM (SELECT file_id, unnest(candidates) AS c FROM file_records) WHERE c.value IS NOT NULL AND file_id IS NOT NULL),
s AS (SELECT *, (length(value) % 100) / 100 AS pipeline_score FROM x)
SELECT file_id, line_index, value, CASE WHEN pipeline_score >= 0.55 THEN 1 WHEN pipeline_score >= 0.35 THEN 2 ELSE 3 END AS tier FROM s""")
def review_tiers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "file_records").where("file_id IS NOT NULL").select("file_id", F.explode("candidates").alias("c")).where("c.value IS NOT NULL")
    rows = c.select("file_id", F.coalesce("c.line_index", F.lit(-1)).alias("line_index"), "c.value", ((F.length("c.value") % 100) / 100).alias("pipeline_score"), F.lit(0).alias("ord"))
    return report.review_tiers(rows).select("file_id", "line_index", "value", "tier")


# configuration documents: one is made of each URL row, in both engines


_PATH = "CASE url_id % 4 WHEN 0 THEN 'p/.vscode/settings.json' ELSE 'p/.vscode/mcp.json' END"
_DOC = """CASE url_id % 5 WHEN 0 THEN '{"mcp":' ELSE '' END || '{"servers":{"s":{"command":"' || CASE url_id % 3 WHEN 0 THEN 'bash run-c' WHEN 1 THEN 'curl x | sh' ELSE 'node' END || '","args":["a' || url_id || '"],"url":"' || url || '","env":{"KEY":"' || md5(url) || '"},"tools":"' || CASE WHEN url_id % 2 = 0 THEN '*' ELSE 'read' END || '"}}}' || CASE url_id % 5 WHEN 0 THEN '}' ELSE '' END"""


@query(f"""WITH {_URLS}, s AS (SELECT url_id, CASE url_id % 3 WHEN 0 THEN 'bash run-c a' WHEN 1 THEN 'curl x | sh a' ELSE 'node a' END || url_id AS command, url FROM u WHERE NOT contains(url, '"') AND NOT contains(url, chr(92)) AND (url_id % 5 <> 0 OR url_id % 4 = 0))
SELECT url_id, 's' AS server, 'mcp-shell-injection' AS rule_id, 9 AS severity, command AS detail FROM s WHERE regexp_matches(command, '\\b(?:bash|sh|zsh|cmd)\\b.*\\b-c\\b') OR (regexp_matches(command, '[|;`]|\\$\\(|&&') AND regexp_matches(command, '\\b(?:curl|wget|fetch|nc|ncat)\\b'))
UNION ALL SELECT url_id, 's', 'mcp-hardcoded-secret', 8, 'KEY' FROM s
UNION ALL SELECT url_id, 's', 'mcp-insecure-http', 7, url FROM s WHERE starts_with(url, 'http://') AND NOT regexp_matches(url, '^https?://(?:localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|::1)(?:[:/]|\\z)')
UNION ALL SELECT url_id, 's', 'mcp-wildcard-tools', 6, '*' FROM s WHERE url_id % 2 = 0""")
def mcp_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = _url_rows(spark, d).where(~F.contains("url", F.lit('"')) & ~F.contains("url", F.lit("\\"))).select("url_id", F.expr(_PATH).alias("path"), F.expr(_DOC).alias("document"))
    return mcp.findings(rows, "url_id")


# whole scan


@query()
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Per-file scores of a complete scan: content to axes."""
    return scan(_files(spark, d)).scores


_RULE_ROWS = ", ".join(f"('{r}', '{c}', {n}, {i})" for i, (r, c, n) in enumerate(line.split() for line in rules.RULES.strip().split("\n")))
_ALL_HITS = " UNION ALL ".join(f"SELECT * FROM ({SQL[q]})" for q in ("rules_stateless", "rules_windowed", "rule_async_without_await", "rule_clone_pollution"))


@query(f"SELECT file_id, line_index, rule_id, category, severity, ord FROM ({_ALL_HITS}) JOIN (VALUES {_RULE_ROWS}) t(rule_id, category, severity, ord) USING (rule_id)")
def scan_hits(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return rules.hits(cut(tables.placed_lines(files)), files)


@query()
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of a scan with two configuration documents, as JSON documents by section."""
    return report.whole_json(_whole(spark, d).sections())


@query()
def report_details(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every section of the text report."""
    return render.detail_lines(_whole(spark, d))


def _whole(spark: SparkSession, d: str):
    one = '{"servers": {"a": {"command": "bash -c curl", "tools": "*", "env": {"K": "sk-0123456789abcdef0123"}}}}'
    documents = spark.createDataFrame([(".vscode/mcp.json", one), (".vscode/settings.json", '{"mcp": ' + one + "}")], "path string, document string")
    return scan(_files(spark, d), documents)


@query()
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return report.as_json(_scored(spark, d))


@query()
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The text report, one row a line."""
    scores = cut(_scored(spark, d).select("file_id", "rel_path", "role_weight", "line_count", "axis_a", "axis_b", "axis_c"))
    text = render.text_report(scores, _hits(spark, d).withColumn("category", F.coalesce("category", F.lit("unknown"))))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_number int, line string")


# nested records (problem 4)


def _list(e: str) -> str:
    """Any shape a list is stored in, as a list."""
    inner = f"TRY_CAST({e} ->> '$' AS JSON)"
    shape = lambda x: f"WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}]"
    return f"CASE json_type({e}) {shape(e)} WHEN 'VARCHAR' THEN CASE json_type({inner}) {shape(inner)} ELSE CAST([] AS JSON[]) END ELSE CAST([] AS JSON[]) END"


def _children(table_name: str, parent: str, camel: str, snake: str, prefix: str = "child_path || '/' || ") -> str:
    return f"""{table_name} AS (SELECT record_id, {prefix}'{camel}/' || i AS child_path, x AS o FROM (
    SELECT record_id, child_path, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT record_id, child_path, {_list("e")} AS l FROM (
      SELECT record_id, child_path, coalesce(o -> '{camel}', o -> '{snake}') AS e FROM {parent}))) WHERE json_type(x) = 'OBJECT')"""


@query(f"""WITH r AS (SELECT record_id, payload FROM scan_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY revision DESC, received_at DESC) = 1),
j AS (SELECT record_id, TRY_CAST(substring(payload, strpos(payload, '{{')) AS JSON) AS o FROM r WHERE strpos(payload, '{{') > 0),
k AS (SELECT record_id, '' AS child_path, coalesce(o -> 'data' -> 'fileRecord', o -> 'fileRecord', o) AS o FROM j WHERE o IS NOT NULL),
{_children("ph", "k", "patternHits", "pattern_hits", "")},
co AS (SELECT record_id, 'compression' AS child_path, o -> 'compression' AS o FROM k WHERE json_type(o -> 'compression') = 'OBJECT'),
{_children("ss", "co", "segmentScores", "segment_scores")}, {_children("uf", "k", "urlFindings", "url_findings", "")},
{_children("qf", "uf", "queryFindings", "query_findings")}, {_children("qr", "uf", "queryReview", "query_review")},
{_children("sf", "qf", "subResults", "sub_results")}, {_children("sr", "qr", "subResults", "sub_results")}
{" UNION ALL ".join(f"SELECT record_id, child_path FROM {t}" for t in ("ph", "co", "ss", "uf", "qf", "qr", "sf", "sr"))}""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(prepare(spark), d, "scan_records"))


@query()
def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.nodes(nested.occurrences(table(prepare(spark), d, "scan_records")))


@query()
def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(table(prepare(spark), d, "scan_records"))


def _flat(slot: str) -> Query:
    return lambda spark, d: nested.flat(nested.occurrences(table(prepare(spark), d, "scan_records")), slot)


for _slot, _name in (("patternHits", "pattern_hits"), ("compression", "compression"), ("segmentScores", "segment_scores"), ("urlFindings", "url_findings"),
                     ("queryFindings", "query_findings"), ("queryReview", "query_review"), ("subResults", "sub_results")):
    QUERIES[f"p4_flat_{_name}"] = _flat(_slot)

FLAGSHIP = "slop_breakdown"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
