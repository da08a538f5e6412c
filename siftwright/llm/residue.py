"""Template residue and error-page text (problem 8) by retrieved exemplars and TF-IDF containment.

1. A document is reduced to *units*: whole text, title, abstract, and for each section its body and its last
   paragraph. Comments, listings, display formulas, references and the preamble are no part of them.
2. Units are read in passage windows (sentences and lines). An inverted index over the labelled exemplars
   (``exemplars.py``) retrieves those that share a term with the window. The window is residue if the share of its
   TF-IDF weight contained in one exemplar reaches ``CONTAINED`` and it covers ``COVERED`` of that exemplar's; term frequencies count as
   ``1 + log(tf)``, and up to three words where an exemplar says ``@any`` count as contained if ``LITERAL`` of the window is. It is also residue if the exemplars of one kind
   together contain ``TOGETHER`` of it, among that a term most documents lack. An upper bound over all exemplars is tested first, so
   ordinary sentences cost one sum. Every window of every document is scored, after cleaning.
3. A unit whose weight lies in residue windows to ``UNIT`` or more is residue; one such unit excludes the document.

Unfilled places in their usual delimiters, trace lines and keyboard mash have no wording of their own: normalisation turns each into one
mark, and marks are terms like any other.

Document frequencies are counted over all documents and all their terms, by hash into ``BUCKETS`` cells (the bound of what is
broadcast; terms that share a cell share its count). No weight is capped. Both passes are map-only but for the exchange of one partial
count per partition and cell.

Defined cases: null, empty and blank texts, documents without words in any unit (an include only), residue quoted
in prose, in a comment or a listing are no residue. Repeated ids give one row if any of their rows is residue.
Texts of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exemplars import MIXTURES, labelled

CONTAINED, COVERED, LITERAL, TOGETHER, UNIT = 0.7, 0.5, 0.45, 0.98, 0.8
BUCKETS = 1 << 18
ANY_WORDS = 3

_ODD = re.compile("[\u200b\u200c\u200d\ufeff\u00ad]")
_COMMENT = re.compile(r"%(?<!\\%)[^\n]*")
_LISTING = re.compile(r"\\begin\{(verbatim|lstlisting|minted|alltt|Verbatim|comment)\*?\}.*?\\end\{\1\*?\}|\\verb\*?([^A-Za-z\s]).*?\2|\\iffalse\b.*?\\fi\b", re.S)
_MATH = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath)\*?\}.*?\\end\{\1\*?\}|\$\$.*?\$\$|\\\[.*?\\\]", re.S)
_REFS = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)
_ARGS = re.compile(r"\\(?:label|cite[tp]?|ref|eqref|input|include|bibliography|bibliographystyle|includegraphics|usepackage|documentclass|documentstyle|date|author|thanks|vspace|hspace)\*?(?:\[[^\]]*\])?\{[^{}]*\}")
_MACRO = re.compile(r"^[ \t]*\\(?:newcommand|renewcommand|providecommand|def|let|magnification|input|include|newtheorem|setlength)\b[^\n]*$", re.M)
_FRAME = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?|\\(?:maketitle|bye|centering|noindent|par|bf|it|em|small|large|medskip|bigskip|hline|newpage|clearpage|tableofcontents|end)\b")
_TAGS = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|noscript|div|span|br|hr|ul|li|a|pre|center|meta|script)\b[^<>]*>")
_TITLE = re.compile(r"\\title\s*(?:\[[^\]]*\])?\{|\\centerline\s*\{\\bf ")
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", re.S)
_SECTION = re.compile(r"\\(?:sub)*section\*?\s*(?:\[[^\]]*\])?\{[^\n]*?\}[ \t]*(?=\n|\\label|\Z|[^\n])|\\chapter\*?\{[^\n]*?\}|\\beginsection [^\n]*\n?")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_WINDOW = re.compile(r"\n|(?<=[.!?。])\s+|(?<=[。])")
_SPACED_WINDOW = re.compile(r"\s(?:(?<=\n)|(?<=[.!?]\s)\s*)")  # the same where there is no ideographic full stop; only white space is looked at
_SLOT = re.compile(
    r"\{\{(?!\\)[^{}\n]{1,60}\}\}|[$#]\{[^{}\n]{1,60}\}|@@[^@\n]{1,60}@@|\[\[[^\[\]\n]{1,60}\]\]|__[A-Z][A-Z_ ]{0,60}__|<[A-Z][A-Z _]{1,60}>|\bXXX [^\n]{1,60}? XXX\b|"
    r"\(\([^()\n]{1,60}? to be supplied\)\)|\[[^\[\]\n:]{1,40}: ?\d+[^\[\]\n]{0,8} words\]|\[(?:Insert|INSERT|insert) [^\[\]\n]{1,60} here\]|@slot"
)
_SLOT_HINT = re.compile(r"\{\{(?!\\)|\$\{|#\{|@@|\[\[|__[A-Z]|<[A-Z]|XXX|\(\(|\[[^\[\]\n:]{1,40}: ?\d|\[[Ii]nsert|\[INSERT|@slot")
_TRACE = re.compile(r"^[ \t]*at [\w.$<>]+ ?\([^()\n]*:\d+\)[ \t]*$|@trace", re.M)
_MASH = re.compile(r"(?<![^\W\d_])(?:[asdfjkl]{2,14}[ \t]*[.,;]?[ \t]+){4,}[asdfjkl]{2,14}(?![^\W\d_])|@mash")
_HOME_ROW = frozenset("asdfjkl")
_NUMBER = re.compile(r"(?<![a-z0-9])[a-z]*+[0-9][a-z0-9]*+")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\\[a-z]+|[^\W\d_\u2e80-\u9fff\uac00-\ud7af]+|[#\u27e6\u27e7\u27ea\u2e80-\u9fff\uac00-\ud7af]")
_ASCII_TOKEN = re.compile(r"\\?[a-z]+|#")  # the same in a lower-case line that is all ASCII


def tokens(text: str) -> list[str]:
    """Lower-case words, commands, single ideographs; numbers and identifiers with digits are ``#``, unfilled places ``⟦``, trace lines ``⟧``, keyboard mash ``⟪``."""
    if _SLOT_HINT.search(text):
        text = _SLOT.sub(" \u27e6 ", text)
    if ":" in text or "@trace" in text:
        text = _TRACE.sub(" \u27e7 ", text)
    low = text.lower()
    if _DIGIT.search(low):
        low = _NUMBER.sub("#", low)
    found = (_ASCII_TOKEN if low.isascii() else _TOKEN).findall(low)
    if "@mash" in low or sum(map(_HOME_ROW.issuperset, found)) >= 5 and sum(not t.strip("asdfjkl") and len(t) > 1 for t in found) >= 5:
        return _TOKEN.findall(_MASH.sub(" \u27ea ", low))
    return found


def windows(text: str) -> list[str]:
    """Sentences and lines of a text."""
    return (_WINDOW if "。" in text else _SPACED_WINDOW).split(text)


def _argument(text: str, start: int) -> str:
    """Text of the brace group that is open at ``start``."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return text[start : m.start()]
    return text[start:].split("\n", 1)[0]


def clean(text: str) -> str:
    """Text without comments, listings, display formulas and references."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _ODD.sub("", text).replace("\u00a0", " ")
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "\\begin{" in text or "\\verb" in text or "$$" in text or "\\[" in text:
        text = _REFS.sub("\n", _MATH.sub(" ", _LISTING.sub(" ", text)))
    return text


def units(text: str) -> Iterator[tuple[str, str]]:
    """``(kind, text)`` of every unit of a cleaned text."""
    title = _TITLE.search(text)
    if title:
        yield "title", _argument(text, title.end())
    abstract = _ABSTRACT.search(text)
    if abstract:
        yield "abstract", abstract.group(1)
        text = text[: abstract.start()] + "\n\n" + text[abstract.end() :]
    if title:
        end = title.end() + len(_argument(text, title.end()))
        text = text[: title.start()] + text[end + 1 :]
    if "\\begin{document}" in text:
        text = text.split("\\begin{document}", 1)[1]
    text = _FRAME.sub(" ", _ARGS.sub(" ", _MACRO.sub("", text)))
    if "\\centerline" in text:
        text = re.sub(r"\\centerline\s*\{[^\n]*", "", text)
    yield "whole", text
    for part in _SECTION.split(text):
        if part.strip():
            yield "body", part
            paragraphs = [p for p in _PARAGRAPH.split(part) if p.strip() and _TOKEN.search(p)]
            if len(paragraphs) > 1:
                yield "end", paragraphs[-1]


class Weights(dict):
    """Inverse document frequency of any term, from hashed document counts."""

    def __init__(self, documents: int = 1000, counts: np.ndarray | None = None):
        self.documents, self.counts = documents, counts

    def __missing__(self, term: str) -> float:
        n = 0 if self.counts is None else int(self.counts[xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), 42) % BUCKETS])
        value = math.log((self.documents + 1) / (n + 1)) + 1
        if len(self) < 300_000:  # what is remembered
            self[term] = value
        return value


def _tf(found: list[str]) -> dict[str, float]:
    """``1 + log(n)`` of each term."""
    tf = dict.fromkeys(found, 1.0)
    if len(tf) < len(found):
        for t, n in Counter(found).items():
            if n > 1:
                tf[t] = 1 + math.log(n)
    return tf


class Index:
    """Inverted index over the exemplars."""

    def __init__(self, weights: Weights | None = None):
        self.weight = Weights() if weights is None else weights
        self.bags: list[tuple[str, dict[str, float], int]] = []  # kind, term frequencies, words that may vary
        for kind, text in labelled():
            self.bags.append((kind, _tf(tokens(text.replace("@any", " "))), ANY_WORDS * text.count("@any")))
        self.mixtures = [(kind, frozenset(tokens(text))) for kind, text in MIXTURES.items()]
        self.postings: dict[str, list[int]] = {}
        for i, (_, bag, _) in enumerate(self.bags):
            for t in bag:
                self.postings.setdefault(t, []).append(i)
        self.mixed = {t: kind for kind, terms in self.mixtures for t in terms}
        self.known = frozenset(self.postings) | frozenset(self.mixed)
        self.kinds: dict[str, set[str]] = {}
        for kind, bag, _ in self.bags:
            self.kinds.setdefault(kind, set()).update(bag)
        self.mass = [sum(n * self.weight[t] for t, n in bag.items()) for _, bag, _ in self.bags]
        self.tells = {max(bag, key=lambda t: (self.weight[t], t)) for _, bag, free in self.bags if free}
        self.telling = math.log(4) + 1  # of a term in a quarter of the documents

    def window(self, found: list[str]) -> tuple[float, str | None]:
        """Weight of a window and the kind of residue that contains it, if any does."""
        weight = self.weight
        tf = _tf(found)
        total = sum(map(mul, map(weight.__getitem__, tf), tf.values()))
        near = self.known.intersection(tf)
        inside = sum(map(mul, map(weight.__getitem__, near), map(tf.__getitem__, near)))
        if inside < CONTAINED * total and not self.tells.intersection(near):
            return total, None
        mass = {t: n * weight[t] for t, n in tf.items()}
        per: dict[str, float] = {}
        for t in near:
            if t in self.mixed:
                per[self.mixed[t]] = per.get(self.mixed[t], 0.0) + mass[t]
        for kind, w in sorted(per.items(), key=lambda x: (-x[1], x[0])):
            if w >= CONTAINED * total:
                return total, kind
        shared: dict[int, float] = {}
        for t in near:
            for i in self.postings.get(t, ()):
                shared[i] = shared.get(i, 0.0) + min(tf[t], self.bags[i][1][t]) * weight[t]
        best: tuple[float, str] | None = None
        for i, w in shared.items():
            kind, bag, free = self.bags[i]
            if w < COVERED * self.mass[i]:
                continue
            if free and LITERAL * total <= w < CONTAINED * total:
                w += sum(sorted((m for t, m in mass.items() if t not in bag), reverse=True)[:free])
            if w >= CONTAINED * total and (best is None or (-w, kind) < best):
                best = (-w, kind)
        if best:
            return total, best[1]
        for kind, terms in sorted(self.kinds.items()):
            of = [t for t in near if t in terms]
            if sum(mass[t] for t in of) >= TOGETHER * total and any(weight[t] >= self.telling for t in of) and len(of) > 1:
                return total, kind
        return total, None

    def residue(self, text: str) -> tuple[str, str] | None:
        """``(unit, kind)`` of the first unit that is residue."""
        if not text or text.isspace():
            return None
        memo: dict[str, tuple[float, str | None]] = {}
        for unit, part in units(clean(text)):
            if "<" in part:
                part = _TAGS.sub("\n", part)
            whole = bad = 0.0
            kinds: dict[str, float] = {}
            if unit == "title":
                part = part.replace("\n", " ")
            for line in [part] if unit == "title" else windows(part):
                if line not in memo:
                    found = tokens(line)
                    memo[line] = self.window(found) if found else (0.0, None)
                weight, kind = memo[line]
                whole += weight
                if kind:
                    bad += weight
                    kinds[kind] = kinds.get(kind, 0.0) + weight
            if whole and bad >= UNIT * whole:
                return unit, max(kinds, key=lambda k: (kinds[k], k))
        return None


def term_weights(documents: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents with text, and in how many of them a term of each hash cell stands."""
    ideographs = r"[\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}]"
    text = F.lower("text")
    spaced = F.when(text.rlike(ideographs), F.regexp_replace(text, f"({ideographs})", " $1 ")).otherwise(text)
    words = F.split(spaced, r"[^\p{L}\\]+|(?=\\)")
    digits = F.when(F.col("text").rlike("[0-9]"), F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    cell = F.when(F.col("t") == "", -1).otherwise(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)))  # the empty term counts the documents
    rows = (
        documents.where("trim(text) <> ''")
        .select(F.explode(F.array_distinct(F.concat(words, digits, F.array(F.lit(""))))).alias("t"))
        .groupBy(cell.cast("int").alias("c"))
        .agg(F.count("*").alias("n"))
        .toPandas()
    )
    counts = np.zeros(BUCKETS, np.int64)
    real = rows["c"].to_numpy() >= 0
    counts[rows["c"].to_numpy()[real]] = rows["n"].to_numpy()[real]
    return int(rows["n"].to_numpy()[~real].sum()), counts


def detect(documents: DataFrame) -> DataFrame:
    """``doc_id, unit, kind`` of every row that is residue."""
    n, counts = term_weights(documents)
    shared = documents.sparkSession.sparkContext.broadcast((n, counts))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(Weights(*shared.value))
        for batch in batches:
            hits = [(i, r) for i, t in enumerate(batch.column(1).to_pylist()) if t and (r := index.residue(t))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([i for i, _ in hits], pa.int32())), pa.array([r[0] for _, r in hits], pa.string()), pa.array([r[1] for _, r in hits], pa.string())],
                names=["doc_id", "unit", "kind"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, unit string, kind string")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of every document that is residue."""
    return detect(documents).select("doc_id").distinct()
