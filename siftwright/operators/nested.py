"""Deeply nested semi-structured records to flat, linked tables (problem 4).

Merkle subtree identities: each payload is parsed once, every object is canonicalised and hashed bottom-up
(its own fields plus the ordered ``(slot, position, child hash)`` list), so equal subtrees carry equal
identities wherever they occur. Three relations come out of one pass:

* *occurrences* - the bridge: one row per object of each record with its path, its parent's path and identity,
  its slot (list name) and its ordinal. Nothing is merged here, so every occurrence survives.
* *nodes* - one row per distinct identity with the object's own fields as canonical JSON.
* flat child tables - occurrences of one kind joined to nothing: the typed fields ride on the bridge row.

Parsing is per row (Arrow batches); the only exchanges are the latest-revision aggregation and the node
dedup, both hash aggregations with map-side combine.

Defined cases
-------------
* null, empty or unreadable payload: no rows; a cut-off payload is unreadable as a whole.
* stray characters before the first ``{`` are skipped; text after the record's closing brace makes it unreadable
  unless it is white space.
* the record with the highest ``revision`` counts; ties go to the latest ``received_at``, then the largest payload
  text; a null revision is the lowest.
* a list may be stored as a list, as JSON text of a list or object, as an object keyed by positions, or as one
  object (position 0). Null elements and scalars keep their position and give no row.
* extra columns of the input are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: slot name -> slots of its own objects; single objects (not lists) are marked by SINGLE.
TREE = {
    "": ("patternHits", "compression", "urlFindings"),
    "patternHits": (),
    "compression": ("segmentScores",),
    "segmentScores": (),
    "urlFindings": ("queryFindings", "queryReview"),
    "queryFindings": ("subResults",),
    "queryReview": ("subResults",),
    "subResults": (),
}
SINGLE = frozenset({"compression"})
ENVELOPES = ("data", "fileRecord")
NUMERIC = frozenset(
    "size severity lineIndex startLine endLine ratio selfRatio ncdHuman ncdAI projectOutlierScore compressionScore pipelineScore resolvedScore".split()
)

SCHEMA = (
    "record_id bigint, child_path string, parent_path string, slot string, ordinal int, depth int, "
    "node_id string, parent_id string, fields string"
)
_ARROW = pa.schema(
    [("record_id", pa.int64()), ("child_path", pa.string()), ("parent_path", pa.string()), ("slot", pa.string()),
     ("ordinal", pa.int32()), ("depth", pa.int32()), ("node_id", pa.string()), ("parent_id", pa.string()), ("fields", pa.string())]
)
_SNAKE = re.compile(r"[_\-]+(\w)")
#: Names whose camelCase form isn't that of their snake_case spelling.
NAMED = {"ncdAi": "ncdAI"}


def camel(key: str) -> str:
    """``rule_id`` and ``rule-id`` to ``ruleId``, ``ncd_ai`` to ``ncdAI``; camelCase stays."""
    name = _SNAKE.sub(lambda m: m.group(1).upper(), key) if "_" in key or "-" in key else key
    return NAMED.get(name, name)


def _parse(text: str | None) -> dict | None:
    if not text:
        return None
    start = text.find("{")
    if start < 0:
        return None
    try:
        value = json.loads(text[start:])
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _loose(value: object) -> object:
    """JSON text of a list or object stands for that list or object."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(value.strip().lstrip("\ufeff"))
        except ValueError:
            return None
    return value


def _unwrap(value: dict) -> dict:
    for _ in range(4):
        keyed = {camel(k): v for k, v in value.items()}
        inner = next((o for o in (_loose(keyed[e]) for e in ENVELOPES if e in keyed) if isinstance(o, dict)), None)
        if inner is None:
            return value
        value = inner
    return value


def _elements(value: object, slot: str) -> list[tuple[int, dict]]:
    value = _loose(value)
    if isinstance(value, dict):
        if slot not in SINGLE and value and all(k.isdigit() for k in value):
            listed = sorted((int(k), _loose(v)) for k, v in value.items())
            return [(i, v) for i, v in listed if isinstance(v, dict)]
        return [(0, value)]
    if isinstance(value, list):
        return [(i, v) for i, v in enumerate(map(_loose, value)) if isinstance(v, dict)]
    return []


def _canonical(value: object, name: str = "") -> object:
    """Own fields: camelCase keys, numeric fields written as text become numbers, nulls dropped."""
    if isinstance(value, dict):
        return {camel(k): _canonical(v, camel(k)) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_canonical(v, name) for v in value]
    if name in NUMERIC and isinstance(value, str) and re.fullmatch(r"-?\d{1,15}(\.\d+)?", value):
        return float(value) if "." in value else int(value)
    return value


def walk(record_id: int | None, text: str | None) -> list[tuple]:
    """All objects of one payload, parents before children; ``fields`` and ids are final."""
    root = _parse(text)
    if root is None:
        return []
    rows: list[list] = []

    def visit(node: dict, slot: str, path: str, parent: str | None, ordinal: int, depth: int) -> str:
        at, own, links = len(rows), {}, []
        rows.append([])
        children = {}
        for key, value in node.items():
            name = camel(key)
            if name in TREE[slot]:
                if name not in children or children[name] is None:
                    children[name] = value
            elif value is not None:
                own[name] = _canonical(value, name)
        for name in TREE[slot]:
            if children.get(name) is not None:
                for i, child in _elements(children[name], name):
                    below = name if name in SINGLE else f"{name}/{i}"
                    links.append((name, i, visit(child, name, f"{path}/{below}" if path else below, path, i, depth + 1)))
        fields = json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        node_id = hashlib.blake2b(json.dumps([slot, fields, links], ensure_ascii=False).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        rows[at] = [record_id, path, parent, slot, ordinal, depth, node_id, None, fields]
        return node_id

    visit(_unwrap(root), "", "", None, 0, 0)
    ids = {r[1]: r[6] for r in rows}
    for r in rows:
        r[7] = ids.get(r[2]) if r[2] is not None else None
    return rows


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [row for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in walk(rid, text)]
        columns = list(zip(*out)) if out else [[] for _ in _ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def latest(records: DataFrame) -> DataFrame:
    """``record_id, payload`` of each record's highest revision."""
    key = F.struct(F.coalesce("revision", F.lit(-2147483648)).alias("r"), "received_at", F.coalesce("payload", F.lit("")).alias("p"))
    return (
        records.where(F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.max(key).alias("k"))
        .select("record_id", F.col("k.p").alias("payload"))
    )


def occurrences(records: DataFrame) -> DataFrame:
    """Bridge table of the latest revisions; the record's own row has ``child_path`` ''."""
    return latest(records).mapInArrow(_walk_batches, SCHEMA)


def nodes(bridge: DataFrame) -> DataFrame:
    """Each distinct subtree once, with how often it occurs and in how many records."""
    per_record = bridge.groupBy("node_id", "record_id").agg(F.count("*").alias("n"), F.first("slot").alias("slot"), F.first("fields").alias("fields"))
    return per_record.groupBy("node_id").agg(
        F.first("slot").alias("slot"), F.first("fields").alias("fields"), F.sum("n").alias("n_occurrences"), F.count("*").alias("n_records")
    )


#: Typed columns of the flat child tables.
FLAT = {
    "patternHits": "ruleId string, ruleName string, category string, severity int, line string, lineIndex int, fix string",
    "compression": "selfRatio double, ncdHuman double, ncdAI double, projectOutlierScore double, compressionScore double",
    "segmentScores": "startLine int, endLine int, ratio double",
    "urlFindings": "url string, classification string, internal boolean, sensitivePath boolean, lineIndex int, "
    "parsed struct<scheme:string,authority:string,host:string,port:string,path:string>",
    "queryFindings": "value string, identifierName string, pipelineScore double, confidence string",
    "queryReview": "value string, identifierName string, pipelineScore double, confidence string",
    "subResults": "value string, resolvedScore double",
}


def flat(bridge: DataFrame, slot: str) -> DataFrame:
    """The child table of ``slot``: keys, parent link, ordinal and its own typed fields."""
    return (
        bridge.where(F.col("slot") == slot)
        .withColumn("o", F.from_json("fields", FLAT[slot]))
        .select("record_id", "child_path", "parent_path", "ordinal", "node_id", "parent_id", "o.*")
    )


def found(records: DataFrame) -> DataFrame:
    """``record_id, child_path`` of every child object below the fileRecord."""
    return occurrences(records).where("depth > 0").select("record_id", "child_path")
