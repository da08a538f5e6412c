"""Generated, minified, vendored files and data saved as code (problem 5).

Winnowing: the token stream of a file (comments and white space gone, numbers and strings reduced to their kind) is
hashed in runs of ``GRAM`` tokens and the minimum of every ``WINDOW`` runs is kept, so any copied stretch of
``GRAM + WINDOW`` tokens leaves a common fingerprint. A file of ``SHORT`` tokens or more that gets fewer than ``LEAST`` fingerprints
has its exact token stream as its only one; shorter files are nobody's copy. The index of fingerprints holds those
found in ``REPOS`` or more projects and those shared with a file that shows third-party origin itself (a library's notice or place); a
file most of whose fingerprints are in it is a vendored copy (``recurs``), wherever it lies and with its notice cut off.

Fingerprints are counted as ``(fingerprint, project)`` pairs combined map-side, so one that is everywhere costs
one row a project. Where files are looked up, fingerprints with over 1 / ``HOT`` of all rows (so at most ``HOT`` of them) are
broadcast, and only the others are shuffled. The pass over the texts runs once; what it finds is written to the shared folder.

Recurrence alone cannot name a copy that only one project holds, nor tool output. The same pass over the token
stream therefore also measures what such files show by themselves:

* *notice*: a banner anywhere in the leading comments (after a directive too) that names a library's release, its contributors or a
  licence; a mere copyright line is none. A notice that heads ``OWN_SHARE`` or more of its project's files (``OWN_FILES`` at least) is that
  project's own header and no evidence;
* *place*: a dependency folder with a library's own folder below it (folders that only sound like one do not count);
* *marker*: a comment by which a tool declares its output (negated or historical remarks do not count, nor
  markers inside string literals), or a compiler's own statement;
* *counter*: numbers in the code that run 0, 1, 2, ... through the file, as tools number what they emit;
* *packed*: most of the code outside literals stands in long lines without white space;
* *data*: the file is literals, with hardly any identifier.

Defined cases: rows that come again count once (``file_id``); of a file's rows that differ each is judged and their reasons are put together;
null content is judged by path and the stored surface figures only; a null path or
project is allowed (a null project counts as one of its own per file); empty content is hand-written unless its
place says otherwise. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

GRAM, WINDOW = 40, 40
REPOS, SHARE, LEAST, SHORT = 5, 0.6, 3, 20
OWN_SHARE, OWN_FILES = 0.5, 5
HOT = 2000

_LEX = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|[A-Za-z_$¡-￿][\w$]*|0[xX][0-9a-fA-F]+|\d[\w.]*|\S", re.S
)
_MARKER = re.compile(
    r"@generated\b|auto-?generated|\bcode generated\b|\bgenerated (?:by|from|with|file|code)\b|machine-?made|machine-?generated|\b(?:do not|don't) (?:edit|modify|change)\b|"
    r"\bne pas (?:modifier|éditer)|nicht (?:bearbeiten|ändern)|no (?:editar|modificar)|automatisch (?:erzeugt|generiert)|(?:produit|généré) par|"
    r"(?:generado|producido) por|自动生成|请勿(?:修改|编辑)|automatically produced|\bcreated by [\w.-]+; edit\b",
    re.I,
)
_DENIED = re.compile(r"\bnot (?:auto-?)?generated|\bgenerated once|\bby hand\b|\bmaintained by\b|\brewritten\b|edit freely|\bused to be\b|\bno longer\b|\bhand-?(?:written|edited)", re.I)
_BANNER = re.compile(
    r"\(c\) the\b|@licen[cs]e|\blicen[cs]ed? under\b|under an? (?:\w+ )?licen[cs]e|\bpermission is granted\b|@preserve|\bspdx-|"
    r"^[\s/*!]*[\w.-]+(?:\.js)? (?:- release |v)?\d+\.\d+\.\d+\s*(?:\*/)?$",
    re.I | re.M,
)
#: Folder names under which dependencies are kept; fixed values.
PLACES = "vendor vendored deps third_party third-party thirdparty 3rdparty node_modules externals external bower_components web_modules jspm_packages"
_PLACE = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, PLACES.split()))})/(?:@[^/]+/)?[^/]+/", re.I)
_TAIL = re.compile(r"(?<![\d.x])\d{1,6}\Z")
_LEAD = re.compile(r"(?:\s|\ufeff|#![^\n]*|['\"]use [a-z]+['\"];?|//[^\n]*|/\*.*?(?:\*/|\Z))*+", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_VARYING = re.compile(r"[\d\W_]+")
_LITERAL = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", re.S)
#: Folders and file names by which tools mark what they write; they only lower what is asked of the counter.
_TOOL_PLACE = re.compile(r"(?:^|/)(?:__generated__|generated|autogen|codegen-out|codegen|gen|proto)/|(?:_pb|\.pb|\.gen|\.generated|\.g)\.\w+$", re.I)
_KEYWORDS = frozenset(
    (
    "var", "let", "const", "function", "return", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "new", "this",
    "typeof", "void", "in", "of", "try", "catch", "finally", "throw", "class", "extends", "export", "import", "from", "default", "async",
    "await", "yield", "null", "undefined", "true", "false", "instanceof", "delete", "static", "get", "set",
)
)
FEATURES = "file_id bigint, project string, fingerprints array<bigint>, reasons array<string>, notice bigint"
_OUT = pa.schema([("file_id", pa.int64()), ("project", pa.string()), ("fingerprints", pa.list_(pa.int64())), ("reasons", pa.list_(pa.string())), ("notice", pa.int64())])

#: What the path alone says of a file whose content is missing.
_NAMED = re.compile(rf"{_TOOL_PLACE.pattern}|(?:^|/)(?:dist|build|es5)/|[.-]min\.\w+$", re.I)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.cumprod(np.full(GRAM, _BASE, np.uint64))[::-1].copy()


def lex(content: str) -> tuple[list[str], list[str]]:
    """``(comments, tokens)`` in order."""
    comments, tokens = [], []
    for t in _LEX.findall(content):
        (comments if t[:2] in ("//", "/*") else tokens).append(t)
    return comments, tokens


class Hasher(dict):
    """Token to 64-bit value, numbers and strings by kind."""

    def __missing__(self, token: str) -> int:
        kind = "0" if token[0].isdigit() else "s" if token[0] in "'\"`" else token
        raw = kind.encode("utf-8", "surrogatepass")
        value = (zlib.crc32(raw) << 32 | zlib.adler32(raw)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
        if len(self) < 200_000 and len(token) < 80:  # what is remembered, not what is hashed
            self[token] = value
        return value


def winnow(values: np.ndarray) -> np.ndarray:
    """Distinct window minima of the hashes of all runs of ``GRAM`` tokens."""
    n = values.size - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    runs = (np.lib.stride_tricks.sliding_window_view(values, GRAM) * _POWERS).sum(axis=1, dtype=np.uint64)
    runs ^= runs >> np.uint64(31)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW).min(axis=1) if n > WINDOW else runs.min(keepdims=True)
    return np.unique(least).view(np.int64)


def fingerprints(tokens: list[str], hashes: Hasher) -> np.ndarray:
    """Winnowed fingerprints; of a short file the hash of its exact stream."""
    prints = winnow(np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)))
    if prints.size < LEAST:
        return np.array([_hash(" ".join(tokens))] if len(tokens) >= SHORT else [], np.int64)
    return prints


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def counter(tokens: list[str]) -> int:
    """Length of the longest run 0, 1, 2, ... (or 1, 2, ...) found in order among the numbers of names and literals, strings aside."""
    want0, want1 = 0, 1
    for t in tokens:
        if t[-1].isdigit() and t[0] not in "'\"`":
            m = _TAIL.search(t)
            if m:
                n = int(m.group())
                if n == want0:
                    want0 += 1
                if n == want1:
                    want1 += 1
    return max(want0, want1 - 1)


def compiled(tokens: list[str]) -> bool:
    """A compiler's statement that the module was a module: as code, not quoted or commented."""
    for i, t in enumerate(tokens):
        if t in ("'__esModule'", '"__esModule"') and tokens[max(0, i - 6) : i] == ["Object", ".", "defineProperty", "(", "exports", ","]:
            return True
        if t == "__esModule" and tokens[max(0, i - 2) : i] == ["exports", "."] and tokens[i + 1 : i + 2] == ["="]:
            return True
    return False


def banner(content: str) -> str | None:
    """The leading comment that is a library's notice."""
    head = _LEAD.match(content).group()
    return next((c for c in _COMMENT.findall(head) if _BANNER.search(c)), None)


def own_evidence(content: str, comments: list[str], tokens: list[str], path: str | None = None) -> list[str]:
    """All of marker, notice, counter, packed, data that the file itself shows, in this order."""
    out = []
    if any(_MARKER.search(c) and not _DENIED.search(c) for c in comments) or "__esModule" in content and compiled(tokens):
        out.append("marker")
    if comments and banner(content):
        out.append("notice")
    if not tokens:
        return out
    lines = sum(1 for x in content.split("\n") if x and not x.isspace())
    strings = [t for t in tokens if t[0] in "'\"`"]
    prose = sum(len(t) for t in strings if len(t) > 60 and t.count(" ") * 12 > len(t))
    run = counter(tokens)
    named = bool(path and _TOOL_PLACE.search(path))
    if (run >= 4 and run >= 0.15 * lines or named and run >= 2 and run >= 0.1 * lines) and prose < 0.5 * len(content):
        out.append("counter")
    letters = [t for t in tokens if (t[0].isalpha() or t[0] in "_$") and t not in _KEYWORDS]
    if _packed(content, tokens, strings, letters):
        out.append("packed")
    blob = max((len(t) for t in strings if " " not in t), default=0)
    numbers = sum(t[0].isdigit() for t in tokens)
    if len(tokens) >= 60 and len(letters) < 0.04 * len(tokens) or blob > 400 and blob >= 0.8 * len(content) or len(tokens) >= 200 and numbers >= 0.4 * len(tokens):
        out.append("data")
    return out


def _packed(content: str, tokens: list[str], strings: list[str], letters: list[str]) -> bool:
    """Long lines without white space, or one-letter names closely set."""
    if max(map(len, content.split("\n"))) > 200:
        code = _LITERAL.sub("''", content)
        long = [x for x in code.split("\n") if len(x) > 200]
        packed = sum(map(len, long))
        if packed >= 0.6 * len(code) and sum(x.count(" ") + x.count("\t") for x in long) < 0.12 * packed:
            return True
    blanks = sum(content.count(c) for c in " \t\n")
    return len(content) > 300 and blanks < 0.08 * len(content) and len(strings) < 0.2 * len(tokens) and sum(len(t) == 1 for t in letters) > 0.5 * len(letters)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hasher()
    for batch in batches:
        rows: list[tuple] = []
        for fid, project, path, content, width, blank in zip(*(c.to_pylist() for c in batch.columns)):
            reasons, prints, notice = [], np.zeros(0, np.int64), None
            if content is None:
                if path and _NAMED.search(path):
                    reasons.append("place")
                elif width is not None and blank is not None and width >= 200 and blank < 0.1:
                    reasons.append("packed")
            if content:
                text = content.replace("\r", "") if "\r" in content else content
                comments, tokens = lex(text)
                reasons = own_evidence(text, comments, tokens, path)
                prints = fingerprints(tokens, hashes)
                if "notice" in reasons:
                    notice = _hash(_VARYING.sub(" ", banner(text)))
            if path and "place" not in reasons and _PLACE.search(path.replace("\\", "/")):
                reasons.append("place")
            rows.append((fid, project if project is not None else f"?{fid}", prints, reasons, notice))
        columns = list(zip(*rows)) if rows else [[] for _ in _OUT]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def features(files: DataFrame) -> DataFrame:
    """``file_id, project, fingerprints, reasons, notice`` of every row, by one pass over the token stream."""
    return files.where("file_id IS NOT NULL").select(
        "file_id", "project_key", "relative_path", "content", F.col("surface.avg_line_length").alias("w"), F.col("surface.whitespace_ratio").alias("b")
    ).mapInArrow(_features, FEATURES)


def own_headers(seen: DataFrame) -> DataFrame:
    """``project, notice`` of the notices by which a project heads its own files."""
    headed = seen.where("notice IS NOT NULL").groupBy("project", "notice").agg(F.count("*").alias("n")).where(F.col("n") >= OWN_FILES)
    size = seen.groupBy("project").agg(F.count("*").alias("files"))
    return headed.join(size, "project").where(F.col("n") >= OWN_SHARE * F.col("files")).select("project", "notice")


def judged(files: DataFrame) -> DataFrame:
    """``file_id, reasons`` (sorted) of every file that is not hand-written; ``recurs`` is the winnowing verdict."""
    raw = cut(features(files).withColumn("row", F.monotonically_increasing_id()))
    own = raw.where("notice IS NOT NULL").join(own_headers(raw), ["project", "notice"], "left_semi").select("row")
    seen = raw.join(own.withColumn("own", F.lit(True)), "row", "left").withColumn("reasons", F.when(F.col("own"), F.array_remove("reasons", "notice")).otherwise(F.col("reasons")))
    third = F.arrays_overlap("reasons", F.array(F.lit("notice"), F.lit("place")))
    prints = seen.select("row", "project", third.alias("third"), F.explode("fingerprints").alias("fp"))
    pairs = prints.groupBy("fp", "project").agg(F.count("*").alias("n"), F.max("third").alias("third"))
    index = pairs.groupBy("fp").agg(F.count("*").alias("projects"), F.sum("n").alias("n"), F.max("third").alias("third")).where((F.col("projects") >= REPOS) | F.col("third") & (F.col("n") > 1))
    index = cut(index.select("fp", "n"))
    total = F.broadcast(raw.agg(F.sum(F.size("fingerprints")).alias("total")))
    hot = F.broadcast(index.crossJoin(total).where(F.col("n") * HOT > F.col("total")).select("fp"))
    flat = raw.select("row", F.explode("fingerprints").alias("fp"))
    met = flat.join(hot, "fp", "left_semi").unionByName(flat.join(hot, "fp", "left_anti").join(index.select("fp"), "fp", "left_semi"))
    known = met.groupBy("row").agg(F.count("*").alias("c"))
    shares = raw.select("row", "file_id", F.size("fingerprints").alias("n")).join(known, "row").where(F.col("c") >= SHARE * F.col("n")).select("file_id", F.array(F.lit("recurs")).alias("reasons"))
    rows = seen.where("size(reasons) > 0").select("file_id", "reasons").unionByName(shares)
    return rows.select("file_id", F.explode("reasons").alias("reason")).groupBy("file_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def found(files: DataFrame) -> DataFrame:
    """``file_id`` of every file that is not hand-written."""
    return judged(files).select("file_id")
