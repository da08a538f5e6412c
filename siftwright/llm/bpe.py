"""Byte-level BPE of a whole corpus (problem 6) by batched numpy merge rounds.

Text is cut into words by the tokenizer's published pattern. Only the distinct words of an Arrow batch that the
worker has not met yet are merged, all at once: their symbols lie in one flat array, each round finds every
adjacent pair by binary search over the sorted pair keys, takes the lowest rank of each word by ``reduceat`` and
merges all occurrences of that pair. Words that have no further pair leave the array, so a round costs only
what is still open. Documents are then assembled by gathers over a flat id table; no Python loop runs per token.

The operator is map-only: no exchange, state per worker bounded by ``CACHE_WORDS`` distinct words (the cache is
dropped when it is full, which changes speed only). The vocabulary file's path is a parameter; each worker
reads it once.

Defined cases: null and empty texts give an empty list; text is encoded as it is (no normalisation, strings of
special tokens are ordinary text); any length is encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_WORDS = 400_000
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The vocabulary's published cutting pattern with its classes written out; fixed values.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
PATTERN_ASCII = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stays, the rest is moved above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [moved.get(b, chr(b)) for b in range(256)]


class Encoder:
    """Words to ids. ``encode_words`` is exact for any word; ``batch`` encodes texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in _byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.width = 1 << int(max(vocab.values())).bit_length()
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the length of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        final_len = lengths.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.merged)
        while sym.size:
            rank = np.full(sym.size, none, np.int64)
            if sym.size > 1:
                key = sym[:-1] * self.width + sym[1:]
                at = np.searchsorted(self.keys, key)
                at[at == self.keys.size] = 0
                rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, sym.size])
            closed = np.repeat(low == none, size)
            if closed.any():
                done.append((word[closed], sym[closed]))
                keep = ~closed
                sym, word, rank = sym[keep], word[keep], rank[keep]
                size, low = size[low != none], low[low != none]
                if not sym.size:
                    break
            hit = rank == np.repeat(low, size)
            # runs of one symbol give overlapping hits: only every other one, from the left, is merged
            overlap = hit[1:] & hit[:-1]
            if overlap.any():
                i = np.arange(hit.size)
                began = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], i, 0))
                hit &= (i - began) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.merged[rank[where]]
            keep = np.ones(sym.size, bool)
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), final_len
        word = np.concatenate([w for w, _ in done])
        sym = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _add(self, words: list[str]) -> None:
        ids, lengths = self.merge([w.encode("utf-8") for w in words])
        n, had = len(self.index), self.used
        while self.flat.size < had + ids.size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.start.size < n + len(words):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[had : had + ids.size] = ids
        self.length[n : n + len(words)] = lengths
        self.start[n : n + len(words)] = had + np.r_[0, np.cumsum(lengths)[:-1]]
        self.used += ids.size
        self.index.update(zip(words, range(n, n + len(words))))

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all words of all texts, and the number of words of each text."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        cut = [(PATTERN_ASCII if t.isascii() else PATTERN).findall(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.index)
        if new:
            self._add(sorted(new))
        get = self.index.__getitem__
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        places = np.fromiter((p for c in cut for p in map(get, c)), np.int64, int(counts.sum()))
        return places, counts

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and offsets (one more than texts)."""
        places, words = self._places(texts)
        length = self.length[places]
        ends = np.cumsum(length)
        total = int(ends[-1]) if ends.size else 0
        take = np.arange(total) + np.repeat(self.start[places] - (ends - length), length)
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(words)]] if ends.size else np.zeros(len(texts) + 1, np.int64)
        return self.flat[take], offsets

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text, without making them."""
        places, words = self._places(texts)
        ends = np.r_[0, np.cumsum(self.length[places])]
        return np.diff(ends[np.r_[0, np.cumsum(words)]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``chars`` bytes of text in column 1 (single texts stay whole)."""
    size = np.array([len(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
    group = np.cumsum(size) // chars
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(documents: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids``: the token ids of every text, without special tokens."""
    where = path or default_path()
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for whole in batches:
            for batch in _slices(whole):
                ids, offsets = enc.batch(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, path: str | None = None, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns but the text, plus the number of tokens of each text."""
    where = path or default_path()
    rest = [c for c in documents.columns if c not in (text_col, out)]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest) + f", `{out}` bigint"
    first = rest[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for whole in batches:
            for batch in _slices(whole):
                n = pa.array(enc.counts(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], n], names=[*rest, out])

    return documents.select(first, text_col, *rest[1:]).mapInArrow(run, schema)
