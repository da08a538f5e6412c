"""Oversized segments cut at natural boundaries (problem 1), by byte ranges.

Every text is read in ranges of ``range_bytes`` bytes of its UTF-8 form; no Python worker ever holds a whole file.

1. *Detect*: a worker finds the newlines and cut boundaries of its range. All of them are ASCII, so a range may begin
   inside a character; a character belongs to the range that holds its first byte. Of the boundaries those are kept
   that some window can choose (``choosable``). A range's first newline ends a line that was opened earlier, so its
   strength is left open, and the range reports how its own open line looks (first and last byte, length).
2. *Stitch*: prefix sums of newline and character counts turn local offsets into those of the file, and the state of
   the line that is open at a range's begin gives its first newline its strength, however long that line is. The table
   is written once to the shared folder.
3. *Place*: segment bounds become offsets by looking their lines up in the stitched table, by blocks of line numbers.
4. *Emit*: the boundary tables of a segment's ranges stream by in order, and a piece is emitted by offset as soon as its window is
   known, so a worker holds one window; ``with_text`` cuts the text out of the ranges (with a halo of three bytes for the last character) and puts
   together the parts of a piece, which is at most ``max_chars`` long.

One code serves all files, so the size of a range changes no piece.

A piece is at most ``max_chars`` long, the next one begins exactly ``overlap_chars`` before its end. The cut is
the strongest boundary in the second half of the window, the last one of equals: end of a top-level block, blank
line, line end, statement or list separator, white space; where there is none, the limit itself.

Defined cases
-------------
* size: characters of the lines joined by a newline, both bounds included; carriage returns count.
* swapped bounds mean the span between them, a null or too large end the last line, a null, too large or negative
  start the first line (clamped); a null element keeps its position and gives nothing.
* null content or segments: nothing. ``ext`` is compared without case; null and unlisted ones use ``*``; without
  ``*``, or with a null or non-positive limit, nothing is oversized. Overlap is held below ``max_chars``.
* rows that come again (same ``file_id``) give their pieces once. Of rows that differ, the one ingested last counts
  (where there is no ``ingested_at`` or it ties, the one with the greater hash of ext, segments and content), whole: pieces of two
  versions never mix. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

RANGE_BYTES = 2048
LINE_BLOCK, OFFSET_BLOCK = 256, 4096
HALO = 3
PIECES = "file_id bigint, seg_pos int, piece_no int, start_offset bigint, end_offset bigint, strength int"
BLOCK_END, BLANK, LINE, STATEMENT, SPACE, HARD = 5, 4, 3, 2, 1, 0

TABLE = "file_id bigint, stamp timestamp, version bigint, k int, n_k int, limit int, overlap int, segs array<struct<start_line:int,end_line:int>>, "
FOUND = "n_chars bigint, n_nl bigint, n_bytes bigint, nl array<int>, cut_at array<int>, cut_strength array<int>, first int, last int, head_len int, head_last int, tail_first int, tail_len int"


def boundaries(code: np.ndarray) -> np.ndarray:
    """Strength of a cut after each element of ``code``: the code points of a whole text, or the bytes of its UTF-8 form."""
    strength = np.zeros(code.size, np.int8)
    strength[(code == 32) | (code == 9)] = SPACE
    strength[(code == 59) | (code == 44) | (code == 123) | (code == 125)] = STATEMENT
    ends = np.flatnonzero(code == 10)
    if ends.size:
        starts = np.r_[0, ends[:-1] + 1]
        strength[ends] = LINE
        body = ends - starts - ((ends > starts) & (code[np.maximum(ends - 1, 0)] == 13))
        strength[ends[body == 0]] = BLANK
        strength[ends[(body > 0) & (code[starts] == 125)]] = BLOCK_END
    return strength


def choosable(at: np.ndarray, strength: np.ndarray, width, weight: np.ndarray | None = None) -> np.ndarray:
    """Which boundaries are the last strongest one of some window of ``width`` offsets: from the stronger one before to the next that is no weaker are more than ``width``.

    ``weight`` is what a boundary counts against others where that is less than its own strength may be.
    """
    weight = strength if weight is None else weight
    far = np.iinfo(np.int64).max // 4
    before, after = np.full(at.size, -far), np.full(at.size, far)
    for s in range(SPACE, BLOCK_END + 1):
        mine = np.flatnonzero(strength == s)
        stronger, no_weaker = at[weight > s], at[weight >= s]
        before[mine] = np.r_[-far, stronger][np.searchsorted(stronger, at[mine])]
        after[mine] = np.r_[no_weaker, far][np.searchsorted(no_weaker, at[mine], "right")]
    return after - before > width


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def least(limit, overlap):
    """Characters of a piece before its first possible cut."""
    return np.maximum(np.maximum(0, np.minimum(overlap, limit - 1)) + 1, limit // 2)


class Plan:
    """Pieces of ``[start, end)`` as its boundaries come in order: a cut is made once all boundaries of its window are known, so at most a window is held."""

    def __init__(self, start: int, end: int, limit: int, overlap: int):
        self.pos, self.end, self.limit = start, end, limit
        self.overlap = max(0, min(overlap, limit - 1))
        self.head = int(least(limit, self.overlap))
        self.offsets, self.strengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, offsets: np.ndarray, strengths: np.ndarray, known: int) -> list[tuple[int, int, int]]:
        """Pieces ``(start, end, strength)`` that are settled when all boundaries up to ``known`` are; one at ``o`` cuts before that character."""
        inside = offsets < self.end
        self.offsets, self.strengths = np.r_[self.offsets, offsets[inside]], np.r_[self.strengths, strengths[inside]]
        out = []
        while self.end - self.pos > self.limit and known >= self.pos + self.limit:
            a, b = np.searchsorted(self.offsets, [self.pos + self.head, self.pos + self.limit + 1])
            at, best = self.pos + self.limit, HARD
            if b > a:
                window = self.strengths[a:b]
                best = int(window.max())
                at = int(self.offsets[a + np.flatnonzero(window == best)[-1]])
            out.append((self.pos, at, best))
            self.pos = at - self.overlap
        gone = np.searchsorted(self.offsets, self.pos)
        self.offsets, self.strengths = self.offsets[gone:], self.strengths[gone:]
        return out

    def finish(self) -> tuple[int, int, int]:
        return self.pos, self.end, LINE


def plan(start: int, end: int, offsets: np.ndarray, strengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of ``[start, end)`` with all its boundaries at hand."""
    p = Plan(start, end, limit, overlap)
    return [*p.feed(offsets, strengths, end), p.finish()]


def limits_of(split_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """``{lower-case ext: (max_chars, overlap_chars)}``; one row per extension by definition."""
    rows = split_limits.where("ext IS NOT NULL AND max_chars > 0").groupBy(F.lower("ext").alias("e")).agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("o"))).alias("l")).collect()
    return {r["e"]: (r["l"]["max_chars"], r["l"]["o"]) for r in rows}


def prepared(files: DataFrame, split_limits: DataFrame) -> DataFrame:
    """``file_id, stamp, version, limit, overlap, segs, body`` of rows that can have a case; ``body`` is the content's UTF-8 form."""
    limits = limits_of(split_limits)
    star = limits.get("*")
    ext = F.lower("ext")
    named = [(k, v) for k, v in sorted(limits.items()) if k != "*"]

    def pick(i: int) -> Column:
        chain = F.lit(star[i] if star else None).cast("int")
        for k, v in named:
            chain = F.when(ext == k, F.lit(v[i])).otherwise(chain)
        return chain

    segs = F.transform("compression.segment_scores", lambda s: F.when(s.isNotNull(), F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"))))
    stamp = F.col("ingested_at").cast("timestamp") if "ingested_at" in files.columns else F.lit(None).cast("timestamp")
    return files.where("file_id IS NOT NULL AND content IS NOT NULL AND size(compression.segment_scores) > 0").select(
        F.col("file_id").cast("bigint").alias("file_id"), stamp.alias("stamp"), F.xxhash64(ext, segs, "content").alias("version"), pick(0).alias("limit"), pick(1).alias("overlap"), segs.alias("segs"),
        F.col("content").cast("binary").alias("body"),
    ).where("limit IS NOT NULL")


def ranges(ready: DataFrame, range_bytes: int, halo: int = 0) -> DataFrame:
    """One row a range with its bytes, the segments in the first one only; a text without bytes is one empty range."""
    n = F.greatest(F.ceil(F.octet_length("body") / range_bytes).cast("int"), F.lit(1))
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), F.substring(F.col("body"), k * range_bytes + 1, F.lit(range_bytes + halo)).alias("slice")))
    rows = ready.select("file_id", "stamp", "version", "limit", "overlap", "segs", n.alias("n_k"), F.explode(cuts).alias("r"))
    return rows.select("file_id", "stamp", "version", "r.k", "n_k", "limit", "overlap", F.when(F.col("r.k") == 0, F.col("segs")).alias("segs"), "r.slice")


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Values grouped by their ascending row as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)), pa.array(values.astype(np.int32)))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary table of each range, all ranges of a batch at once; offsets are characters of the range."""
    for batch in batches:
        n = batch.num_rows
        limit, overlap = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
        slices = batch.column(8).cast(pa.large_binary())
        edge = np.frombuffer(slices.buffers()[1], np.int64)[slices.offset : slices.offset + n + 1]
        raw = np.frombuffer(slices.buffers()[2], np.uint8)[: edge[-1]] if edge[-1] else np.zeros(0, np.uint8)
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        strength = boundaries(raw).astype(np.int64)
        begin, end = edge[:-1], edge[1:]
        size = end - begin
        byte = lambda at, there: np.where(there, np.r_[raw, 0][np.where(there, at, 0)], -1)
        nl = np.flatnonzero(raw == 10)
        nl_row = np.searchsorted(edge, nl, "right") - 1
        a, b = np.searchsorted(nl, begin), np.searchsorted(nl, end)
        has = b > a
        places = np.r_[nl, 0]
        head = np.where(has, places[np.where(has, a, 0)], end)  # the first newline, or the end
        tail = np.where(has, places[np.where(has, b - 1, 0)] + 1, begin)  # after the last newline, or the begin
        opened = np.zeros(raw.size, bool)
        opened[head[has]] = True
        at = np.flatnonzero(strength)
        row = np.searchsorted(edge, at, "right") - 1
        local = chars[at + 1] - chars[edge[row]]
        width = limit + 1 - least(limit, overlap)
        apart = row * (int(size.max(initial=0)) + int(width.max(initial=0)) + 2)
        first = opened[at]
        keep = first | choosable(local + apart, strength[at], width[row], np.where(first, LINE, strength[at]))
        columns = [
            chars[end] - chars[begin], b - a, size, _lists(chars[nl] - chars[edge[nl_row]], nl_row, n), _lists(local[keep], row[keep], n), _lists(strength[at][keep], row[keep], n),
            byte(begin, size > 0), byte(end - 1, size > 0), head - begin, byte(head - 1, head > begin), byte(tail, tail < end), end - tail,
        ]
        types = [pa.int64()] * 3 + [None] * 3 + [pa.int32()] * 6
        made = [c if t is None else pa.array(c.astype(np.int64), pa.int64()).cast(t) for c, t in zip(columns, types)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:8], *made], names=[*batch.schema.names[:8], *[f.split()[0] for f in FOUND.split(", ")]])


def stitched(files: DataFrame, split_limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Boundary tables of all ranges with ``line0, char0`` (newlines and characters before the range) and ``head_strength``, that of its first newline."""
    found = ranges(prepared(files, split_limits), range_bytes).mapInArrow(_detect, TABLE + FOUND).repartition("file_id")
    newest = Window.partitionBy("file_id", "k").orderBy(F.desc_nulls_last("stamp"), F.desc("version"))
    along = Window.partitionBy("file_id").orderBy("k")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    one = found.withColumn("r", F.row_number().over(newest)).where("r = 1").withColumn("winner", F.first("version").over(along)).where("version = winner")
    some = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    counted = one.withColumns(
        {
            "line0": some("n_nl"),
            "char0": some("n_chars"),
            "group": some((F.col("n_nl") > 0).cast("int")),
            "came_len": F.when(F.lag("n_nl").over(along) > 0, F.lag("tail_len").over(along)),
            "came_first": F.when((F.lag("n_nl").over(along) > 0) & (F.lag("tail_len").over(along) > 0), F.lag("tail_first").over(along)),
            "came_last": F.lag("last").over(along),
        }
    )
    # ranges of a group share the line that is open where they begin
    group = Window.partitionBy("file_id", "group").orderBy("k")
    open_len = F.first(F.coalesce("came_len", F.lit(0))).over(group) + F.coalesce(F.sum("n_bytes").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_first = F.first(F.coalesce("came_first", "first")).over(group)
    state = counted.withColumns({"open_len": open_len, "open_first": open_first})
    body = F.col("open_len") + F.col("head_len")
    ends = F.when(F.col("head_len") > 0, F.col("head_last")).otherwise(F.col("came_last"))
    empty = (body == 0) | ((body == 1) & (ends == 13))
    return state.select(
        "file_id", "version", "k", "n_k", "limit", "overlap", "segs", "n_chars", "n_nl", "nl", "cut_at", "cut_strength", "line0", "char0",
        F.when(empty, BLANK).when(F.col("open_first") == 125, BLOCK_END).otherwise(LINE).alias("head_strength"),
    )


def placed(table: DataFrame) -> DataFrame:
    """``file_id, seg_pos, limit, overlap, begin, end`` of every segment, in characters of the file."""
    whole = table.groupBy("file_id").agg(F.sum("n_nl").alias("last"), F.sum("n_chars").alias("size"))
    raw = table.where("k = 0").select("file_id", "limit", "overlap", F.posexplode("segs").alias("seg_pos", "s")).where("s IS NOT NULL").join(whole, "file_id")
    segments = raw.withColumn("a", F.least(F.greatest(F.coalesce("s.start_line", F.lit(0)), F.lit(0)), F.col("last"))).withColumn(
        "b", F.when(F.col("s.end_line") >= 0, F.least(F.col("s.end_line").cast("bigint"), F.col("last"))).otherwise(F.col("last"))
    )
    segments = segments.select("file_id", "limit", "overlap", "size", "last", "seg_pos", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # the newline before the first line and that after the last one, looked up by block of line numbers
    block = lambda line: F.floor(line / LINE_BLOCK)
    blocks = table.where("n_nl > 0").select(
        "file_id", "line0", "n_nl", "nl", "char0", F.explode(F.sequence(block(F.col("line0")), block(F.col("line0") + F.col("n_nl") - 1))).alias("block")
    )
    asked = segments.select("file_id", "seg_pos", F.explode(F.array(F.struct(F.lit("a").alias("w"), (F.col("a") - 1).alias("line")), F.struct(F.lit("b").alias("w"), F.col("b").alias("line")))).alias("q"))
    asked = asked.select("file_id", "seg_pos", "q.*", block(F.col("q.line")).alias("block")).where("line >= 0")
    hits = asked.join(blocks, ["file_id", "block"]).where("line >= line0 AND line < line0 + n_nl")
    newline = F.col("char0") + F.element_at("nl", (F.col("line") - F.col("line0") + 1).cast("int"))
    offsets = hits.groupBy("file_id", "seg_pos").agg(F.max(F.when(F.col("w") == "a", newline + 1)).alias("begin"), F.max(F.when(F.col("w") == "b", newline)).alias("end"))
    return segments.join(offsets, ["file_id", "seg_pos"], "left").select("file_id", "seg_pos", "limit", "overlap", F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("end", "size").alias("end"))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the segments whose ranges come one after the other."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    key, now, no, out = None, None, 0, []

    def add(made: list[tuple[int, int, int]]) -> None:
        nonlocal no
        for piece in made:
            out.append((*key, no, *piece))
            no += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in names]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        plain = [col[n].to_pylist() for n in ("file_id", "seg_pos", "begin", "end", "limit", "overlap", "char0", "n_chars", "nl0", "head_strength")]
        for i, (fid, seg, begin, end, limit, overlap, char0, n_chars, nl0, head) in enumerate(zip(*plain)):
            if (fid, seg) != key:
                if now:
                    add([now.finish()])
                key, now, no = (fid, seg), Plan(begin, end, limit, overlap), 0
            local, strength = (col[n][i].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in ("cut_at", "cut_strength"))
            if nl0 is not None:
                strength = np.where(local == nl0 + 1, head, strength)
            at = local + char0
            add(now.feed(at[at > begin], strength[at > begin], char0 + n_chars))
        yield flush()
    if now:
        add([now.finish()])
    yield flush()


def _touching(spans: DataFrame, begin: str, end: str, tables: DataFrame) -> DataFrame:
    """Spans of characters with the ranges they touch, met by blocks of offsets: nothing joins on the file alone, so a giant file is no hot key."""
    block = lambda at: F.floor(at / OFFSET_BLOCK)
    last = F.col("char0") + F.col("n_chars") - 1
    left = spans.withColumn("b0", block(F.col(begin))).withColumn("block", F.explode(F.sequence(F.col("b0"), block(F.col(end) - 1))))
    right = tables.where("n_chars > 0").withColumn("r0", block(F.col("char0"))).withColumn("block", F.explode(F.sequence(F.col("r0"), block(last))))
    met = left.join(right, ["file_id", "block"]).where((F.col("block") == F.greatest("b0", "r0")) & (F.col("char0") < F.col(end)) & (last >= F.col(begin)))
    return met.drop("b0", "r0", "block")


def _pieces(table: DataFrame) -> DataFrame:
    over = placed(table).where(F.col("end") - F.col("begin") > F.col("limit"))
    tables = table.select("file_id", "k", "char0", "n_chars", F.try_element_at("nl", F.lit(1)).alias("nl0"), "cut_at", "cut_strength", "head_strength")
    return _touching(over, "begin", "end", tables).repartition("file_id", "seg_pos").sortWithinPartitions("file_id", "seg_pos", "k").mapInArrow(_emit, PIECES)


def pieces(files: DataFrame, split_limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file_id, seg_pos, piece_no, start_offset, end_offset, strength`` of every oversized segment; offsets are characters of ``content``."""
    return _pieces(cut(stitched(files, split_limits, range_bytes)))


def with_text(files: DataFrame, split_limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces with their ``text``: each range gives its part of a piece, and the parts (at most ``max_chars`` together) are joined in order."""
    table = cut(stitched(files, split_limits, range_bytes))
    made = _pieces(table)
    spans = table.select("file_id", "version", "k", "char0", "n_chars")
    a, b = F.greatest("start_offset", "char0") - F.col("char0"), F.least(F.col("end_offset"), F.col("char0") + F.col("n_chars")) - F.col("char0")
    parts = _touching(made, "start_offset", "end_offset", spans).select("file_id", "version", "k", *[c.split()[0] for c in PIECES.split(", ")[1:]], a.cast("int").alias("a"), b.cast("int").alias("b"))
    slices = ranges(prepared(files, split_limits), range_bytes, HALO).select("file_id", "version", "k", "slice").dropDuplicates(["file_id", "version", "k"])
    both = parts.join(slices, ["file_id", "version", "k"])
    schema = f"{PIECES}, k int, part string"
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts = []
            for s, i, j in zip(col["slice"].to_pylist(), col["a"].to_pylist(), col["b"].to_pylist()):
                skip = 0
                while skip < len(s) and s[skip] & 0xC0 == 0x80:
                    skip += 1
                texts.append(s[skip:].decode("utf-8", "ignore")[i:j])
            yield pa.RecordBatch.from_arrays([*[col[c] for c in names[:-1]], pa.array(texts, pa.string())], names=names)

    read_parts = both.mapInArrow(read, schema)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), "").alias("text")
    return read_parts.groupBy(*names[:-2]).agg(text)


def reassembled(cut_pieces: DataFrame, split_limits: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, seg_pos, text, within_limit, shares_overlap``: each segment put together again from its pieces (a check of small tables; it holds a segment's text)."""
    ready = prepared(files, split_limits).select("file_id", "limit", F.least("overlap", F.col("limit") - 1).alias("overlap")).groupBy("file_id").agg(F.min("limit").alias("limit"), F.min("overlap").alias("overlap"))
    before = F.lag("end_offset").over(Window.partitionBy("file_id", "seg_pos").orderBy("piece_no"))
    rows = cut_pieces.withColumn("before", before).join(ready, "file_id")
    rest = F.expr("substring(text, CAST(coalesce(before - start_offset, 0) AS INT) + 1)")
    ok = F.col("before").isNull() | (F.col("before") - F.col("start_offset") == F.col("overlap"))
    grouped = rows.select("file_id", "seg_pos", "piece_no", rest.alias("rest"), (F.length("text") <= F.col("limit")).alias("fits"), ok.alias("ok"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "rest"))), lambda p: p["rest"]), "")
    return grouped.groupBy("file_id", "seg_pos").agg(text.alias("text"), F.min("fits").alias("within_limit"), F.min("ok").alias("shares_overlap"))


def found(files: DataFrame, split_limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file_id, seg_pos`` of every oversized segment: those that got pieces."""
    return pieces(files, split_limits, range_bytes).where("piece_no = 0").select("file_id", "seg_pos")
