"""Candidates of a file's lines: string literals, URLs and key-value pairs, welded and sifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.dialect import js, js_trim

#: Shapes of harvested entities; fixed values.
STRING = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+' *|"[^"\\]*+(?:\\.[^"\\]*+)*+" *|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""
URL = r"""https?://[^\s'"`,;)\]}>]+"""
ASSIGN = r"""\b(\w+)\s*=\s*['"`]([^'"`]{4,})['"`]"""
MEMBER = r"""\b(\w+)\s*:\s*['"`]([^'"`]{4,})['"`]"""
LEFT = r"""\b(\w+)\s*(?:=|:)\s*['"`]"""
ROUTING = r"{};()\[\]<>"
SYMBOLS = r"/\\^$.*+?()\[\]{}|<>=!,;:@#%&~"
LEAST, BLOB = 4, 2000
_MARK = "\x01"


def _matches(line: Column, pattern: str) -> Column:
    """``array<struct(col, text)>`` of all matches with their offsets: sentinels around each, then running lengths."""
    parts = F.split(F.regexp_replace(line, "(" + js(pattern) + ")", f"{_MARK}$1{_MARK}"), _MARK)
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.expr("CAST(array() AS array<struct<col:int,text:string>>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            (acc["i"] + 1).alias("i"),
            F.when(acc["i"] % 2 == 1, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("col"), p.alias("text"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return walked["out"]


def unescape(v: Column) -> Column:
    """Newline, tab, return, backslash, quotes, in this order."""
    for a, b in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r"\\\\", r"\\"), (r"\\'", "'"), (r'\\"', '"')):
        v = F.regexp_replace(v, a, b)
    return v


def strings(lines: DataFrame) -> DataFrame:
    """String literals: value, col, identifier (the leftmost assignment or member before it)."""
    quoted = lines.where(F.col("line").rlike("['\"`]"))
    found = quoted.select("file_id", "line_index", "line", F.posexplode(_matches(F.col("line"), STRING)).alias("ord", "m"))
    body = js_trim(F.col("m.text"))
    value = unescape(F.expr("substring(b, 2, length(b) - 2)"))
    name = F.regexp_extract(F.expr("substring(line, 1, m.col + 1)"), js(LEFT), 1)
    trimmed = F.regexp_replace("m.text", " +$", "")
    return (
        found.withColumn("b", F.when(F.col("m.text").startswith("`"), F.col("m.text")).otherwise(trimmed))
        .select("file_id", "line_index", F.lit(0).alias("kind_rank"), "ord", F.lit("string").alias("type"), value.alias("value"), F.col("m.col").alias("col"),
                F.when(name != "", name).alias("identifier_name"), F.lit(None).cast("string").alias("context"), "line")
        .where(F.length("value") >= LEAST)
    )


def urls(lines: DataFrame) -> DataFrame:
    """URLs outside comment lines."""
    t = js_trim(F.col("line"))
    seen = lines.where(F.contains(F.col("line"), F.lit("://")) & ~(t.startswith("//") | t.startswith("*")))
    found = seen.select("file_id", "line_index", "line", F.posexplode(F.regexp_extract_all("line", F.lit(js(URL)), F.lit(0))).alias("ord", "value"))
    return found.where(F.length("value") >= 10).select(
        "file_id", "line_index", F.lit(1).alias("kind_rank"), "ord", F.lit("url").alias("type"), "value", F.lit(None).cast("int").alias("col"),
        F.lit(None).cast("string").alias("identifier_name"), F.lit(None).cast("string").alias("context"), "line",
    )


def pairs(lines: DataFrame) -> DataFrame:
    """Key-value pairs: assignments first, then members; values are taken as they stand."""
    quoted = lines.where(F.col("line").rlike("['\"`]"))

    def of(pattern: str, rank: int, context: str) -> DataFrame:
        each = F.arrays_zip(F.regexp_extract_all("line", F.lit(js(pattern)), F.lit(1)).alias("k"), F.regexp_extract_all("line", F.lit(js(pattern)), F.lit(2)).alias("v"))
        found = quoted.select("file_id", "line_index", "line", F.posexplode(each).alias("ord", "p"))
        return found.select(
            "file_id", "line_index", F.lit(rank).alias("kind_rank"), "ord", F.lit("kv").alias("type"), F.col("p.v").alias("value"), F.lit(None).cast("int").alias("col"),
            F.col("p.k").alias("identifier_name"), F.lit(context).alias("context"), "line",
        )

    return of(ASSIGN, 2, "assignment").unionByName(of(MEMBER, 3, "object"))


def harvested(lines: DataFrame) -> DataFrame:
    """All candidates with the order ``(line_index, kind_rank, ord)``."""
    return strings(lines).unionByName(urls(lines)).unionByName(pairs(lines))


def weld(candidates: DataFrame) -> DataFrame:
    """Runs of string candidates that are pieces of one value, fused; the fused row keeps its seed's place and name.

    A candidate that is no string ends a run, as does a gap of more than a line. Inside such an island a piece continues
    its run if it follows a plus or comma, or if the run's seed is followed by one. So pieces that follow neither can only
    start a run until the first of them that is followed by one: from there on everything joins. That is a count over a
    window, and no fold: a run's seed is a piece without plus or comma before which no such leading piece stands.
    """
    order = Window.partitionBy("file_id").orderBy("line_index", "kind_rank", "ord")
    step = candidates.withColumns(
        {
            "joins": F.coalesce((F.col("type") == "string") & (F.lag("type").over(order) == "string") & (F.col("line_index") - F.lag("line_index").over(order) <= 1), F.lit(False)),
            "after": F.coalesce(F.expr("substring(line, 1, col)").rlike(js(r"[+,]\s*$")), F.lit(False)),
            "leads": F.coalesce(F.expr("substring(line, col + 1)").rlike(js(r"[+,]\s*[\x27\x22`]")), F.lit(False)),
        }
    )
    step = step.withColumn("island", F.sum((~F.col("joins")).cast("int")).over(order)).withColumn("free", ~F.col("joins") | ~F.col("after"))
    inside = Window.partitionBy("file_id", "island").orderBy("line_index", "kind_rank", "ord")
    led = F.coalesce(F.sum((F.col("free") & F.col("leads")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = step.withColumn("seed", F.col("free") & (led == 0)).withColumn("run", F.sum(F.col("seed").cast("int")).over(inside))
    piece = F.struct("line_index", "kind_rank", "ord", "value")
    first = F.min(F.struct("line_index", "kind_rank", "ord", "type", "col", "identifier_name", "context", "line"))
    welded = runs.groupBy("file_id", "island", "run").agg(first.alias("f"), F.count("*").alias("n"), F.array_sort(F.collect_list(piece)).alias("p"))
    return welded.select(
        "file_id", "f.line_index", "f.kind_rank", "f.ord", "f.type", F.array_join(F.col("p.value"), "").alias("value"), "f.col", "f.identifier_name",
        F.when(F.col("n") > 1, "concatenated").otherwise(F.col("f.context")).alias("context"), "f.line",
    )


def density(text: Column, chars_class: str) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, f"[^{chars_class}]", "")) / F.nullif(F.length(text), F.lit(0)).cast("double"))


def is_style(v: Column) -> Column:
    """Semicolon-separated settings: two or more, at least half of them ``name=value``."""
    segments = F.filter(F.transform(F.split(v, ";"), js_trim), lambda s: s != "")
    settings = F.size(F.filter(segments, lambda s: s.rlike(r"^[A-Za-z0-9_.\-]+=.+\z")))
    return F.contains(v, F.lit(";")) & (F.size(segments) >= 2) & (settings * 2 >= F.size(segments))


def is_dotted(v: Column) -> Column:
    """Dotted names with an underscore somewhere."""
    return F.contains(v, F.lit("_")) & v.rlike(r"(?i)^[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+\z")


def preflight(candidates: DataFrame) -> DataFrame:
    """Candidates left after the structural discards, the first of equal values in a file (by hash), with their priority."""
    v = F.col("value")
    literal = F.col("type").isin("string", "kv")
    kept = candidates.where(~(density(F.col("line"), ROUTING) > 0.35) & ~(literal & (is_style(v) | is_dotted(v))) & (F.length(v) >= LEAST))
    around = F.expr("substring(line, greatest(col - 40, 0) + 1, least(length(line), col + 10) - greatest(col - 40, 0))")
    low = (F.col("type") != "url") & F.col("col").isNotNull() & (density(around, SYMBOLS) > 0.35)
    priority = F.when((F.length(v) < 8) & (S.transitions(v) == 0), "low").when(F.length(v) > BLOB, "blob").when(low, "low").otherwise("normal")
    order = Window.partitionBy("file_id", "h").orderBy("line_index", "kind_rank", "ord")
    return kept.withColumn("priority", priority).withColumn("h", S.djb2(v)).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
