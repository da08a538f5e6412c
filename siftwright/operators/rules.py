"""The 39 line rules as predicates over lines, their neighbours and the file's role.

Stateless rules are one Column each; neighbour rules share one window sort per file (``lead``/``lag`` ignoring nulls,
bounded frames); the two that look at other lines by content join on equality keys. Hits come from exploding the
array of fired ids, so a line is never multiplied by the rules that do not fire.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import Pred, at_least, has, js, js_trim, many, truth
from .classify import role

#: id, category, severity of every rule in evaluation order; fixed values.
RULES = """
hallucinated-import-require slopsquatting 8
import-hallucinated-module slopsquatting 8
localstorage-in-backend context-confusion 7
document-in-backend context-confusion 7
window-in-backend context-confusion 7
process-env-in-frontend context-confusion 5
unnecessary-abstraction-factory over-engineering 4
excessive-ternary-nesting over-engineering 5
verbose-null-check verbosity 2
commented-out-code dead-code 3
todo-fixme-comment dead-code 4
empty-catch-block dead-code 6
console-log-leftover debug-pollution 4
debugger-statement debug-pollution 6
alert-statement debug-pollution 5
eval-usage security 9
hardcoded-secret security 10
innerhtml-usage security 7
wildcard-dependency-version dependency 6
async-without-await verbosity 3
unnecessary-else-after-return verbosity 2
redundant-boolean-literal verbosity 2
type-theater type-theater 5
config-exposure config-exposure 6
error-silencing error-handling 6
async-abuse async-abuse 6
structure-smell structure-smell 4
clone-pollution clone-pollution 4
naming-entropy naming-entropy 2
magic-values magic-values 3
import-hygiene import-hygiene 3
interface-bloat interface-bloat 3
complexity-spike complexity-spike 4
test-theater test-theater 5
comment-mismatch comment-mismatch 3
scaffold-residue scaffold-residue 3
branch-symmetry branch-symmetry 5
promise-graveyard promise-graveyard 6
accessor-bloat accessor-bloat 2
"""
#: Package names that do not exist but are often imported; fixed values.
INVENTED = (
    "react-native-utils", "express-validator-sanitizer", "lodash-utils", "node-fetch-native", "crypto-js-utils", "mongoose-paginate-plugin",
    "axios-retry-interceptor", "jsonwebtoken-decode", "bcrypt-password", "dotenv-safe-expanded", "chalk-colors", "moment-timezone-utils",
)
VERBS = ("get", "fetch", "load", "read", "retrieve", "obtain")
#: Shapes of declarations; fixed values.
Q = r"""['"]"""
NOTQ = r"""[^'"]"""
ANYQ = r"""['"`]"""
FUNCTION_NAME = r"\bfunction\s+([a-zA-Z_$]\w+)\s*\("
ASSIGNED_NAME = r"\b(?:const|let|var)\s+([a-zA-Z_$]\w+)\s*=\s*(?:async\s+)?function"
CLONE_LINES = 300


def _stateless() -> dict[str, Pred]:
    comment = has(r"^//", "t")
    star = has(r"^\*", "t")
    invented = "|".join(INVENTED)
    backend, frontend = truth("backend"), truth("frontend")
    keyword = r"^(?:if|else|for|while|switch|do|try)\b"
    # patterns of the rules; fixed values
    rules = {
        "localstorage-in-backend": backend & has(r"\blocalStorage\b"),
        "document-in-backend": backend & has(r"\bdocument\.(?:getElementById|querySelector|createElement|body|head)\b"),
        "window-in-backend": backend & has(r"\bwindow\.(?:location|addEventListener|innerWidth|alert|confirm|prompt)\b"),
        "process-env-in-frontend": frontend & ~has(r"process\.env\.(?:NEXT_PUBLIC_|REACT_APP_|VITE_)") & has(r"\bprocess\.env\."),
        "unnecessary-abstraction-factory": has(r"function\s+\w*(?:Factory|Builder|Creator|Provider|Generator)\s*\(")
        | has(r"const\s+\w*(?:Factory|Builder|Creator|Provider|Generator)\s*=")
        | has(r"class\s+\w*(?:Factory|Builder|Creator)\b"),
        "excessive-ternary-nesting": many("?", 3) & at_least(r"[^?.\s]\s*\?\s*[^?.]", 3, "bare"),
        "verbose-null-check": has(r"!==?\s*null\s*&&\s*\S+\s*!==?\s*undefined") | has(r"!==?\s*undefined\s*&&\s*\S+\s*!==?\s*null"),
        "commented-out-code": comment
        & (has(r"^//\s*(?:var |let |const |function |if\s*\(|for\s*\(|while\s*\(|return |import |export |class )", "t") | has(r"^//\s*[a-zA-Z_$]\w*\s*[(=]", "t")),
        "todo-fixme-comment": has(r"//\s*(?:TODO|FIXME|HACK|XXX|TEMP)\b", ignore_case=True),
        "console-log-leftover": has(r"\bconsole\.log\s*\(") & ~(comment | star | has(r"^/\*", "t")) & ~has(rf"{ANYQ}.*console\.log.*{ANYQ}"),
        "debugger-statement": ~comment & has(r"^\s*debugger\s*;?\s*$"),
        "alert-statement": has(r"\balert\s*\(") & ~comment & ~has(rf"{ANYQ}.*\balert\b.*{ANYQ}"),
        "eval-usage": (has(r"\beval\s*\(") | has(r"new\s+Function\s*\(")) & ~comment & ~has(rf"{ANYQ}.*\beval\b.*{ANYQ}"),
        "hardcoded-secret": ~comment & has(rf"(?:api[_-]?key|secret|password|token|auth|credential)\s*[:=]\s*{Q}[A-Za-z0-9+/=_-]{{16,}}{Q}", ignore_case=True),
        "innerhtml-usage": ~comment & has(r"\.(?:inner|outer)HTML\s*="),
        "wildcard-dependency-version": has(rf"{Q}\s*:\s*{Q}\s*(?:\*|latest)\s*{Q}"),
        "redundant-boolean-literal": has(r"===?\s*(?:true|false)\b") | has(r"\b(?:true|false)\s*===?"),
        "type-theater": ~comment & (has(r":\s*any\b") | has(r"\bas\s+any\b") | has(r"//\s*@ts-(?:ignore|nocheck)")),
        "config-exposure": ~comment & has(r"process\.env\.\w*(?:SECRET|KEY|TOKEN|PASSWORD|AUTH|CREDENTIAL|API)\w*\s*(?:\|\||&&|\?\?)"),
        "async-abuse": ~comment & has(r"\.forEach\s*\(\s*async\s*[\w(]"),
        "magic-values": has(r"\d{4,}")
        & (has(r"[><=!+\-*/%]\s*\d{4,}\b") | has(r"\b\d{4,}\s*[><=!+\-*/%]"))
        & ~(comment | star)
        & ~has(r"^\s*(?:const|var|let)\s+[A-Z_]+\s*=")
        & ~has(r"\b(?:indexOf|lastIndexOf|slice|substring|substr)\s*\("),
        "import-hygiene": has(r"\bimport\s+\*\s+as\s+\w+"),
        "interface-bloat": ~comment & ((many(":", 7) & at_least(r"\w+\s*[?]?\s*:", 7)) | (many(";", 7) & has(r"\b(?:interface|type)\s+\w+"))),
        "test-theater": ~comment
        & (
            has(r"\bexpect\s*\(\s*true\s*\)\s*\.")
            | has(r"\bexpect\s*\(\s*1\s*===\s*1\s*\)")
            | has(r"\bexpect\s*\(\s*1\s*\)\s*\.toBe\s*\(\s*1\s*\)")
            | has(r"\bassert\s*\(\s*true\s*\)")
            | has(r"\bassert\s*\(\s*1\s*===\s*1\s*\)")
            | has(r"\bassert\.ok\s*\(\s*true\s*\)")
            | (has(r"\.toBe\s*\(\s*true\s*\)\s*;") & has(r"expect\s*\(\s*true\s*\)"))
        ),
        "scaffold-residue": reduce(
            lambda a, b: a | b,
            [
                has(p, ignore_case=True)
                for p in (
                    r"//\s*(?:add|put|write|place|insert)\s+your\s+(?:code|logic|implementation)",
                    r"//\s*(?:your\s+logic|your\s+code|implementation\s+here|code\s+here)",
                    r"//\s*implementation\s+pending",
                    r"//\s*\[\s*implementation\s*\]",
                    r"//\s*fill\s+in\s+(?:this|the)\s+(?:logic|implementation|rest)",
                )
            ],
        ),
        "promise-graveyard": (
            has(r"^\s*(?:fetch|axios|request)\s*\(") | has(r"^\s*(?:fetch|axios)\.[a-z]+\s*\(") | has(r"^\s*(?:db|pool|conn|redis|mongo|pg|mysql)\.[a-z]+\s*\(")
        )
        & ~(comment | star)
        & ~has(r"^\s*(?:var|let|const|return|await|throw|if|while|for)\b")
        & ~has(r"\.(?:then|catch|finally)\s*\(")
        & ~has(r"=\s*(?:await\s+)?[a-zA-Z]"),
    }
    # these read columns extracted from the line
    rules["hallucinated-import-require"] = has(rf"^(?:{invented})(?:/|$)", "required")
    rules["import-hallucinated-module"] = has(rf"^(?:{invented})(?:/|$)", "imported")
    # deep lines count unless they begin as blocks' ends, comments, literals, declarations or members do; chained calls, lists and assignments count after a keyword only
    never = r"""^(?:$|\{$|\}|//|\*|this\.|self\.|sb\.|['"`\d(\[,\])]|(?:var|let|const)\s|new\s|\{[\w'"]+\s*:)"""
    plain = r"^\w+(?:\.\w+\(|\s*[*+/,)\]]|(?:\.\w+)+\s*=)"
    rules["structure-smell"] = truth("deep") & ~has(never, "t") & (has(keyword, "t") | ~has(plain, "t"))
    rules["naming-entropy"] = ~(comment | star) & ~has(r"^\s*for\s*\(") & has(r"^[a-zA-Z]$", "single") & ~has(r"^[ijkneIJKNE]$", "single")
    return rules


#: What the stateless rules read besides the line: pattern and group of the extracted columns.
EXTRACTED = {
    "required": (rf"require\s*\(\s*{Q}([^./]{NOTQ}*){Q}\s*\)", 1),
    "imported": (rf"import\s+.*\s+from\s+{Q}([^./]{NOTQ}*){Q}", 1),
    "single": (r"\b(?:var|let|const)\s+([a-zA-Z])\s*=", 1),
    "indent": (r"^([ \t]*)", 1),
}
#: String, template and pattern literals that are emptied before question marks are counted.
EMPTIED = (r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"`[^`\\]*+(?:\\.[^`\\]*+)*+`", r"/(?:[^/\\\n]++|\\.)++/[gimsuy]*")

WINDOWED = (
    (
    "empty-catch-block", "unnecessary-else-after-return", "error-silencing", "complexity-spike", "comment-mismatch", "branch-symmetry",
    "accessor-bloat",
)
)
CROSS = ("async-without-await", "clone-pollution")
STATELESS = tuple(r.split()[0] for r in RULES.strip().split("\n") if r.split()[0] not in (*WINDOWED, *CROSS))


def rule_table(spark: SparkSession) -> DataFrame:
    """``rule_id, category, severity, ord``: 39 rows, fixed."""
    rows = [(r.split()[0], r.split()[1], int(r.split()[2]), i) for i, r in enumerate(RULES.strip().split("\n"))]
    return spark.createDataFrame(rows, "rule_id string, category string, severity int, ord int")


def with_roles(lines: DataFrame) -> DataFrame:
    """Lines that carry ``rel_path`` and ``ext``, with their trimmed text, the file's side and the extracted columns."""
    side = role(F.col("rel_path"), F.col("ext"))["context_type"]
    out = lines.withColumns({"backend": F.coalesce(side == "backend", F.lit(False)), "frontend": F.coalesce(side == "frontend", F.lit(False)), "t": js_trim(F.col("line"))})
    out = out.withColumns({name: F.regexp_extract("line", js(p), g) for name, (p, g) in EXTRACTED.items()})
    bare = F.col("line")
    for p, to in zip(EMPTIED, ("''", '""', "``", "//")):
        bare = F.regexp_replace(bare, js(p), to)
    tabs = F.length(F.replace(F.col("indent"), F.lit(" "), F.lit("")))
    return out.withColumn("bare", bare).withColumn("deep", F.length("indent") + 3 * tabs >= 20)


def with_context(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines with their file's path: joined, unless they carry it."""
    if {"rel_path", "ext"} <= set(lines.columns):
        return with_roles(lines)
    return with_roles(lines.join(files.select("file_id", "rel_path", "ext"), "file_id"))


def stateless_hits(context: DataFrame) -> DataFrame:
    """``file_id, line_index, rule_id`` of the rules that need one line only."""
    preds = _stateless()
    fired = F.array_compact(F.array(*[F.when(preds[r].column, F.lit(r)) for r in STATELESS]))
    return context.select("file_id", "line_index", F.explode(fired).alias("rule_id"))


def windowed_hits(context: DataFrame) -> DataFrame:
    """Hits of the seven neighbour rules; one sort per file serves all frames."""
    t, line = F.col("t"), F.col("line")
    order = Window.partitionBy("file_id").orderBy("line_index")
    rows = lambda a, b: order.rowsBetween(a, b)
    body = F.when(~t.isin("", "{", "}"), t)
    after = F.when(~t.isin("", "{"), t)
    console = t.rlike(js(r"^console\.(?:error|warn|log|info|debug)\s*\("))
    handled = F.when(~(t.isin("", "{") | console | t.startswith("//") | t.startswith("*")), t)
    branch = (line.rlike(js(r"\bif\s*\(")) & ~t.startswith("//")).cast("int")
    real = ((F.length(t) > 5) & ~t.startswith("//") & ~t.startswith("*") & ~t.isin("{", "}", "};")).cast("int")
    seen = context.select(
        "file_id", "line_index", "line", "t", branch.alias("branch"), real.alias("real"),
        F.expr("lead(CASE WHEN t <> '' THEN t END, 1) IGNORE NULLS OVER (PARTITION BY file_id ORDER BY line_index)").alias("next_solid"),
        F.expr("lag(CASE WHEN t <> '' THEN line END, 1) IGNORE NULLS OVER (PARTITION BY file_id ORDER BY line_index)").alias("prev_solid"),
        F.first(handled, True).over(rows(1, 11)).alias("next_handled"), F.sum(branch).over(rows(-15, 15)).alias("branches"),
        (F.sum(real).over(rows(-10, 10)) - real).alias("reals"), F.last(body, True).over(rows(-6, -1)).alias("prev_body"),
        F.first(after, True).over(rows(1, 5)).alias("next_after"), F.first(after, True).over(rows(1, 4)).alias("next_getter"),
    )
    prop = F.lower(F.regexp_extract("t", js(r"^get\s+(\w+)\s*\(\s*\)\s*\{?\s*$"), 1))
    tail = F.lower(F.regexp_extract("next_getter", js(r"(?i)^return\s+this[._#](\w+)\s*;?$"), 1))
    # patterns of the neighbour rules; fixed values
    fired = {
        "empty-catch-block": t.rlike(js(r"catch\s*\(")) & (F.col("next_solid") == "}"),
        "unnecessary-else-after-return": line.rlike(js(r"^\s*\}\s*else\s*\{")) & F.col("prev_solid").rlike(js(r"^\s*return\b")),
        "error-silencing": line.rlike(js(r"\bcatch\s*\(")) & F.col("next_handled").isin("}", "};", "} catch", "} finally"),
        "complexity-spike": (F.col("branch") == 1) & (F.col("branches") >= 8),
        "comment-mismatch": line.rlike("(?i)" + js(r"//\s*(?:TODO|FIXME):?\s*(?:implement|complete|add|write|fill|finish)")) & (F.col("reals") >= 5),
        "branch-symmetry": line.rlike(js(r"^\s*\}\s*else\s*(?:\{|$)")) & F.col("prev_body").rlike(js(r"^return\b")) & (F.col("next_after") == F.col("prev_body")),
        "accessor-bloat": (prop != "") & (tail != "") & tail.isin(prop, F.concat(prop, F.lit("_")), F.concat(F.lit("_"), prop), F.concat(F.lit("_"), prop, F.lit("_"))),
    }
    return seen.select("file_id", "line_index", F.explode(F.array_compact(F.array(*[F.when(fired[r], F.lit(r)) for r in WINDOWED]))).alias("rule_id"))


def async_hits(context: DataFrame) -> DataFrame:
    """async functions that never await: the 30 lines from each are fetched by key, and a running brace depth ends the look-ahead."""
    opened = context.where(F.col("line").rlike(js(r"\basync\s+(?:function|\()"))).select("file_id", F.col("line_index").alias("start"))
    ahead = opened.select("file_id", "start", F.explode(F.sequence("start", F.col("start") + 29)).alias("line_index"))
    braces = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    facts = context.select("file_id", "line_index", braces("{").alias("up"), braces("}").alias("down"), F.col("line").rlike(js(r"\bawait\b")).alias("waits"))
    along = Window.partitionBy("file_id", "start").orderBy("line_index")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    read = ahead.join(facts, ["file_id", "line_index"]).withColumns({"depth": F.sum(F.col("up") - F.col("down")).over(upto), "seen": F.sum("up").over(upto)})
    closed = (F.col("seen") > 0) & (F.col("depth") <= 0)
    before = read.withColumn("over", F.coalesce(F.sum(closed.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    waited = F.max((F.col("waits") & (F.col("line_index") > F.col("start")) & (F.col("over") == 0)).cast("int"))
    return before.groupBy("file_id", "start").agg(waited.alias("w")).where("w = 0").select("file_id", F.col("start").alias("line_index"), F.lit("async-without-await").alias("rule_id"))


def declared_name(line: Column) -> Column:
    """Name of a function declared on the line, in lower case."""
    first, second = F.regexp_extract(line, js(FUNCTION_NAME), 1), F.regexp_extract(line, js(ASSIGNED_NAME), 1)
    return F.lower(F.when(first != "", first).otherwise(second))


def clone_hits(context: DataFrame) -> DataFrame:
    """Functions whose name differs from another's in the same file by its verb only. Verbs of a stem are collected (six at most), not paired."""
    name = F.col("name")
    verb = F.regexp_extract(name, rf"^({'|'.join(VERBS)})", 1)
    named = context.select("file_id", "line_index", declared_name(F.col("line")).alias("name")).where("name <> ''").withColumn("verb", verb).where("verb <> ''")
    named = named.withColumn("stem", F.expr("substring(name, length(verb) + 1)"))
    others = named.where(F.col("line_index") < CLONE_LINES).groupBy("file_id", "stem").agg(F.collect_set("verb").alias("verbs"))
    own = named.where(F.length("stem") >= 3)
    return (
        own.join(others, ["file_id", "stem"])
        .where(F.size(F.array_remove("verbs", F.col("verb"))) > 0)
        .select("file_id", "line_index", F.lit("clone-pollution").alias("rule_id"))
    )


def hits(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, line_index, rule_id, category, severity, line`` of every fired rule."""
    context = with_context(lines, files)
    fired = stateless_hits(context).unionByName(windowed_hits(context)).unionByName(async_hits(context)).unionByName(clone_hits(context))
    return fired.join(F.broadcast(rule_table(lines.sparkSession)), "rule_id").select("file_id", "line_index", "rule_id", "category", "severity", "ord")
