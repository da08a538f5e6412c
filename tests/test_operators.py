"""Numeric anchors, rule fixtures and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftwright.__main__ import main
from siftwright.functions import strings as S
from siftwright.operators import classify, deep, harvest, herd, mcp, nested, project, report, rules, surface, urls
from siftwright.plans.scan import compression_of
from siftwright.sources import tables


def value(spark, col, **given):
    names = list(given)
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} {'string' if isinstance(given[n], str) else 'double'}" for n in names)).select(col.alias("x")).first()["x"]


def files_of(spark, texts, path="src/app/main.js"):
    rows = [(i, path if isinstance(path, str) else path[i], ".js", len(t), 2, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, tables.FILES)


def fired(spark, text, path="src/app/main.js"):
    f = files_of(spark, [text], path)
    return {(r["rule_id"], r["line_index"]) for r in rules.hits(tables.lines(f), f).collect()}


@pytest.mark.parametrize(
    "path,expected",
    [("vendor/a.js", "vendor"), ("mybuild/x.js", "dist"), ("latest/x.js", "test"), ("src/app.config.js", "config"), ("src/.eslint.rc.js", "config"), ("src/a.rc", "config"), ("src/a.js", "application"), ("a/node_modules/b.js", "node_modules")],
)
def test_territory(spark, path, expected):
    assert value(spark, classify.territory(F.col("p")), p=path) == expected


def test_scores(spark):
    assert value(spark, classify.clamp(F.col("x")), x=42.456) == 42.5
    assert [value(spark, classify.verdict(F.col("x")), x=x) for x in (0.0, 10.0, 25.0, 50.0, 75.0, 76.0)] == ["Clean", "Minimal", "Some issues", "Concerning", "Heavy", "Critical"]
    assert value(spark, classify.calibration_weight(F.col("x")), x=10.0) == 0 and value(spark, classify.calibration_weight(F.col("x")), x=100.0) == 1
    assert value(spark, classify.line_count(F.col("s"), F.col("a")), s=0.0, a=0.0) == 100
    assert value(spark, S.mask(F.col("v")), v="ghp_1234567890abcdef") == "ghp_**************ef"


def test_median_and_mad(spark):
    r = project.median_mad(spark.createDataFrame([(float(x),) for x in (1, 1, 2, 2, 4, 6, 9)], "x double"), "x").first()
    assert (r["median"], r["mad"]) == (2.0, 1.0)
    assert project.median_mad(spark.createDataFrame([], "x double"), "x").first()["mad"] == 0.0


def test_usual_scores_lose_a_tier(spark):
    rows = spark.createDataFrame([(i, 0.5, "MEDIUM") for i in range(110)], "file_id bigint, pipeline_score double, confidence string")
    assert {r["confidence_calibrated"] for r in project.recalibrate(rows, rows).collect()} == {"UNCERTAIN"}
    few = rows.limit(9)
    assert {r["confidence_calibrated"] for r in project.recalibrate(few, few).collect()} == {"MEDIUM"}


def test_string_functions(spark):
    assert value(spark, S.djb2(F.col("v")), v="hello") == 261238937
    assert value(spark, S.entropy(F.col("v")), v="abab") == 1.0
    assert value(spark, S.coincidence(F.col("v")), v="abcd") == 0.0
    assert value(spark, S.transitions(F.col("v")), v="aB1-") == 3
    assert value(spark, S.friction(F.col("v")), v="aB1-") == pytest.approx(2 / 3)
    assert value(spark, S.bigram_signal(F.col("v")), v="abc") == 0.5
    assert [round(x, 3) for x in value(spark, S.vector(F.col("v")), v="aaaa")][0] == 0.0


@pytest.mark.parametrize(
    "v,parts",
    [("a=1;b=2;c=3", ["1", "2", "3"]), ("a=1;b=;c=3", ["1", "3"]), ("a:1,b=2,c:3", ["1", "2", "3"]), ("a=1|b=2|c=3", ["1", "2", "3"]), ("https://h/p?x=1&y=2", ["1", "2"]),
     ("https://h/p", ["https://h/p"]), ('{"a": "x", "b": "y"}', ["x", "y"]), ("plain", ["plain"]), ("a=;b=;c=", []), ("", [])],
)
def test_decompose(spark, v, parts):
    assert value(spark, deep.decompose(F.col("v")), v=v) == parts


def test_urls(spark):
    p = value(spark, urls.parse(F.col("u")), u="HTTPS://user:pw@Host.example:8080/a/b?x=1#frag")
    assert (p["scheme"], p["host"], p["port"], p["path"], p["query"], p["fragment"]) == ("https", "user:pw@Host.example", "8080", "/a/b", "x=1", "frag")
    for host, inside in (("10.example.com", True), ("localhost.evil.com", True), ("db.internal", True), ("internal", True), ("example.com", False), ("[::1]", False), ("172.32.0.1", False)):
        assert value(spark, urls.is_internal(F.col("h")), h=host) is inside
    assert value(spark, urls.is_sensitive(F.col("p")), p="/v1/healthy") is True


def test_herd_gate_drops_uniform_parameters(spark):
    rows = [("u", "a", "deadbeef00"), ("u", "b", "deadbeef01"), ("u", "c", "deadbeef02"), ("w", "a", "one"), ("w", "b", "two")]
    left = urls.gated(spark.createDataFrame(rows, "k string, key string, value string"), "k").collect()
    assert {r["k"] for r in left} == {"w"}


LINES = {
    "hallucinated-import-require": "const a = require('lodash-utils/x');",
    "import-hallucinated-module": 'import a from "chalk-colors"',
    "unnecessary-abstraction-factory": "class ThingFactory {",
    "excessive-ternary-nesting": "const k = one ? two ? six ? 1 : 2 : 3 : 4;",
    "verbose-null-check": "if (a !== null && a !== undefined) {",
    "commented-out-code": "// const a = old(b);",
    "todo-fixme-comment": "// todo later",
    "console-log-leftover": "  console.log(a)",
    "debugger-statement": "debugger;",
    "alert-statement": "alert(x)",
    "eval-usage": "const f = new Function(x);",
    "hardcoded-secret": "apiKey = 'abcdefghijklmnop'",
    "innerhtml-usage": "node.outerHTML = x;",
    "wildcard-dependency-version": '"left": "*"',
    "redundant-boolean-literal": "if (a === true) {",
    "type-theater": "let a: any;",
    "config-exposure": "x = process.env.MY_SECRET || y",
    "async-abuse": "list.forEach(async (x) => {",
    "structure-smell": "                    if (a) b();",
    "naming-entropy": "let q = 1;",
    "magic-values": "if (a > 86400) {",
    "import-hygiene": "import * as x from 'y'",
    "interface-bloat": "type A = { a: b; c: d; e: f; g: h; i: j; k: l; m: n; };",
    "test-theater": "expect(true).toBe(true);",
    "scaffold-residue": "// add your code here",
    "promise-graveyard": "  fetch('x');",
    "async-without-await": "async function f() {\n  return 1;\n}",
    "empty-catch-block": "} catch (e) {\n\n}",
    "error-silencing": "} catch (e) {\n  console.error(e);\n}",
    "unnecessary-else-after-return": "  return 1;\n} else {",
    "comment-mismatch": "// TODO: implement\n" + "\n".join(f"real.code({i});" for i in range(5)),
    "complexity-spike": "\n".join("if (a) b();" for _ in range(8)),
    "branch-symmetry": "  return same;\n} else {\n  return same;\n}",
    "accessor-bloat": "get name() {\n  return this._name;\n}",
    "clone-pollution": "function getUser() {}\nfunction fetchUser() {}",
}


@pytest.mark.parametrize("rule", sorted(LINES))
def test_rule_fires(spark, rule):
    assert rule in {r for r, _ in fired(spark, LINES[rule])}


@pytest.mark.parametrize(
    "rule,line,path",
    [("localstorage-in-backend", "localStorage.x", "server/a.js"), ("document-in-backend", "document.body", "server/a.js"), ("window-in-backend", "window.alert(1)", "server/a.js"), ("process-env-in-frontend", "process.env.X", "components/page.js")],
)
def test_rule_needs_its_side(spark, rule, line, path):
    assert rule in {r for r, _ in fired(spark, line, path)}
    assert rule not in {r for r, _ in fired(spark, line, "x/y.js")}


@pytest.mark.parametrize(
    "rule,line",
    [("console-log-leftover", "// console.log(a)"), ("eval-usage", "x = 'eval(y)'"), ("naming-entropy", "let i = 1;"), ("magic-values", "const LIMIT = 86400;"), ("promise-graveyard", "  fetch('x').then(y)"),
     ("structure-smell", "                    return.this"), ("type-theater", "// x: any"), ("async-without-await", "async function f() {\n  await g();\n}"), ("clone-pollution", "function getUser() {}\nfunction getUser() {}"),
     ("debugger-statement", "the debugger helps"), ("import-hallucinated-module", "import a from './chalk-colors'")],
)
def test_rule_stays_silent(spark, rule, line):
    hit = {r for r, _ in fired(spark, line)}
    assert rule not in hit or rule == "structure-smell"


def test_word_edges_are_ascii(spark):
    assert "debugger-statement" not in {r for r, _ in fired(spark, "éalert(1)")}
    assert "alert-statement" in {r for r, _ in fired(spark, "éalert(1)")}


def test_harvest_and_weld(spark):
    f = files_of(spark, ["const key =\n  'abcd'\n  + 'efgh';\nconst other = \"single\";\nopts = { name: 'value1' };\nx('https://h.example/path');\n"])
    got = harvest.weld(harvest.harvested(tables.lines(f))).collect()
    welded = [r for r in got if r["context"] == "concatenated"]
    assert [(r["value"], r["identifier_name"]) for r in welded] == [("abcdefgh", None)]
    assert {(r["type"], r["value"]) for r in got} >= {("url", "https://h.example/path"), ("kv", "value1"), ("kv", "single")}


def test_weld_seed_that_leads_takes_all(spark):
    f = files_of(spark, ["f('aaaa', 'bbbb')\ng = 'cccc'\n"])
    strings = harvest.weld(harvest.strings(tables.lines(f))).collect()
    assert [r["value"] for r in strings] == ["aaaabbbbcccc"]


def test_preflight(spark):
    line = "const a = 'fill=#fff;stroke=none;x=1'"
    f = files_of(spark, [f"{line}\nb = 'auth.login.bad_password'\nc = 'twice-me'\nd = 'twice-me'\n"])
    left = harvest.preflight(harvest.strings(tables.lines(f))).collect()
    assert [r["value"] for r in left] == ["twice-me"] and left[0]["line_index"] == 2


def test_surface_of_odd_texts(spark):
    f = files_of(spark, ["x" * 600, "", "a\n\n", "dup line is here\n" * 4])
    s = {r["file_id"]: r for r in surface.figures(tables.lines(f), f).collect()}
    assert s[0]["minified"] is True and s[1]["minified"] is False and s[2]["avg_line_length"] == 1.0
    rep = {r["file_id"]: r["repetition_fraction"] for r in surface.repetition(tables.lines(f)).collect()}
    assert rep[3] == 1.0 and rep[0] == 0.0


def test_segments_cover_windows(spark):
    f = files_of(spark, ["\n".join(map(str, range(61)))])
    assert sorted((r["start_line"], r["end_line"]) for r in surface.segments(tables.lines(f)).collect()) == [(0, 29), (15, 44), (30, 59)]


def test_mcp_rules(spark):
    doc = '{"servers": {"a": {"command": "curl x | sh", "url": "http://h.example", "env": {"K": "sk-0123456789abcdef", "L": "no"}, "tools": "*"}, "b": null}}'
    rows = spark.createDataFrame([("p", doc), ("q", "{broken"), ("r", '{"mcp": {"servers": {"c": {"url": "http://localhost:1"}}}}')], "path string, document string")
    assert sorted(r["rule_id"] for r in mcp.findings(rows).collect()) == ["mcp-hardcoded-secret", "mcp-insecure-http", "mcp-shell-injection", "mcp-wildcard-tools"]


def test_nested_walk():
    text = (
        '﻿ {"data": {"file_record": {"path": "a", "pattern_hits": {"rule_id": "x"}, "compression": {"segment_scores": "[{\\"start_line\\": \\"1\\"}, null, {}]"},'
        ' "url_findings": [null, {"query_findings": [{"sub_results": [{}]}]}]}}}'
    )
    paths = [r[1] for r in nested.walk(1, text)]
    assert paths == ["", "patternHits/0", "compression", "compression/segmentScores/0", "compression/segmentScores/2", "urlFindings/1", "urlFindings/1/queryFindings/0", "urlFindings/1/queryFindings/0/subResults/0"]
    assert nested.walk(1, '{"path": "a", "patternHits": [') == [] == nested.walk(1, None) == nested.walk(1, "") == nested.walk(1, "null")


def test_nested_identities_and_revisions(spark):
    rows = [(1, 1, '{"patternHits": [{"a": 1}]}'), (1, 2, '{"patternHits": [{"a": 1}, {"a": 1}, {"a": 2}]}'), (2, 1, None), (2, 1, None)]
    df = spark.createDataFrame([(a, b, c, None, "extra") for a, b, c in rows], "record_id bigint, revision int, payload string, received_at timestamp, node_id string")
    bridge = nested.occurrences(df)
    found = sorted(r["child_path"] for r in nested.found(df).collect())
    assert found == ["patternHits/0", "patternHits/1", "patternHits/2"]
    nodes = {r["fields"]: r["n_occurrences"] for r in nested.nodes(bridge).where("slot = 'patternHits'").collect()}
    assert nodes == {'{"a":1}': 2, '{"a":2}': 1}
    assert nested.found(df.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("a")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.JSX").write_text("é\n")
    (tmp_path / "src" / "a.txt").write_text("no")
    rows = tables.folder(spark, str(tmp_path)).collect()
    assert [(r["rel_path"], r["ext"], r["size"], r["depth"], r["content"]) for r in rows] == [("src/A.JSX", ".jsx", 3, 1, "é\n")]
    assert tables.folder(spark, str(tmp_path / "none")).count() == 0
    assert [r["rel_path"] for r in tables.folder(spark, str(tmp_path / "src" / "A.JSX")).collect()] == ["A.JSX"]
    assert tables.config_documents(spark, str(tmp_path)).count() == 0


def test_report_shapes(spark):
    hits = spark.createDataFrame([(1, "r1", "c", 5, 3, 0), (1, "r2", "c", 9, 1, 1), (2, "r1", "c", 5, 0, 2)], "file_id bigint, rule_id string, category string, severity int, line_index int, ord int")
    b = report.breakdown(hits).first()
    assert (b["hit_count"], b["file_count"], b["max_severity"], b["axis"]) == (3, 2, 9, "A")
    g = {r["file_id"]: r for r in report.display_groups(hits).collect()}
    assert g[1]["first_lines"] == [2, 4] and g[1]["worst_rules"] == ["r2", "r1"]


def test_scan_end_to_end(spark):
    from siftwright.plans.scan import scan

    f = files_of(spark, ["export function a(x) {\n  return x + 1;\n}\n", "eval(x);\nconst apiKey = 'Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0';\n// TODO fix\n"], ["src/clean.js", "src/bad.js"])
    docs = spark.createDataFrame([("cfg.json", '{"servers": {"a": {"tools": "*"}}}')], "path string, document string")
    s = scan(f, docs)
    axes = {r["rel_path"]: r for r in s.scores.collect()}
    assert axes["src/bad.js"]["axis_b"] > axes["src/clean.js"]["axis_b"] and all(0 <= axes[p][f"axis_{a}"] <= 100 for p in axes for a in "abc")
    assert s.project.first()["file_count"] == 3
    sections = s.sections()
    assert [r["rel_path"] for r in sections["clean_files"].collect()] == ["src/clean.js"]
    assert all("Zx9Qw8Er7Ty6" not in r["value"] for r in sections["secrets"].collect())


def test_stream_gives_the_batch_hits(spark, tmp_path):
    from siftwright.streaming import incremental

    f = files_of(spark, ["eval(x);\n", "ok\n"])
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    q = incremental.stateless_hits(stream).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["rule_id"] for r in spark.table("hits").collect()] == ["eval-usage"]


def test_report_text_and_options(spark):
    from siftwright.operators import render

    assert render.axis_filter("a,x, C") == {"A", "C"} and render.axis_filter("x") is None and render.axis_filter(None) is None
    assert render.limits("a:7,B:x,D:1") == {"A": 7, "B": 25, "C": 100}
    assert render.section_filter("hits,none") == {"hits"} and render.shown("review", None) and not render.shown("review", {"hits"})
    scores = spark.createDataFrame([(1, "src/a.js", 60.0, 3.0, 1.0, 1.0, 1200), (2, "src/b.js", 0.0, 0.0, 0.0, 1.0, 10)], "file_id bigint, rel_path string, axis_a double, axis_b double, axis_c double, role_weight double, line_count bigint")
    hits = spark.createDataFrame([(1, "r", "security", 9, 0, 0)], "file_id bigint, rule_id string, category string, severity int, line_index int, ord int")
    text = render.text_report(scores, hits, axis="A,B")
    assert "1,210 lines" in text and "exit 1" in text and "src/a.js" in text and "security" in text and "\nC  " not in text


def test_vector_dimensions_of_all_values_match_brute_force(spark, tmp_path):
    import gzip
    import math
    import random

    from siftwright import queries

    rnd = random.Random(7)
    values = ["", "a", "aaaa", "q" * 79, "q" * 80, "ab" * 200, *["".join(rnd.choice("abcXYZ019-_é日") for _ in range(n)) for n in (2, 30, 79, 80, 81, 400)], *["".join(rnd.choice("aB1+/") for _ in range(n)) for n in (80, 120, 900)]]
    spark.createDataFrame([([{"value": v} for v in values] + [None, {"value": None}],)], "candidates array<struct<value:string>>").write.parquet(str(tmp_path / "file_records.parquet"))

    def kind(c):
        return 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3

    def brute(v):
        kinds = set(v)
        entropy = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in kinds)
        profile = [sum(kind(c) == k for c in v) / len(v) for k in range(4)]
        half = lambda q: min(1, math.dist(profile, q) / 2)
        raw = v.encode()
        d2 = len(kinds) / len(v) if len(v) < 80 else min(1, min(len(gzip.compress(raw, 9)) / len(raw), 1.5) / 1.5)
        changes = sum(kind(a) != kind(b) for a, b in zip(v, v[1:])) / (len(v) - 1) if len(v) > 1 else 0
        return [min(1, entropy / math.log2(len(kinds))) if len(kinds) > 1 else 0, d2, half((0.02, 0.82, 0.03, 0.13)), half((0.05, 0.75, 0.1, 0.1)), 1 - half((0.25,) * 4), changes]

    got = {r["value"]: [float(x) for x in list(r)[1:]] for r in queries.QUERIES["vector_dimensions_whole"](spark, str(tmp_path)).collect()}
    assert set(got) == set(values) - {""}
    for v, dims in got.items():
        assert dims == pytest.approx(brute(v), abs=1e-8), v


def test_one_object_in_both_spellings_is_one_node_and_keeps_its_values(spark):
    texts = ['{"compression": {"selfRatio": 0.5, "ncdHuman": 0.25, "ncdAI": 0.75}}', '{"compression": {"self_ratio": 0.5, "ncd_human": 0.25, "ncd_ai": "0.75"}}']
    df = spark.createDataFrame([(i, 1, None, t) for i, t in enumerate(texts)], "record_id bigint, revision int, received_at timestamp, payload string")
    bridge = nested.occurrences(df)
    rows = nested.flat(bridge, "compression").collect()
    assert [r["ncdAI"] for r in rows] == [0.75, 0.75] and len({r["node_id"] for r in rows}) == 1
    assert [r["n_occurrences"] for r in nested.nodes(bridge).where("slot = 'compression'").collect()] == [2]


def test_report_text_has_every_category(spark):
    from siftwright.operators import render

    scores = spark.createDataFrame([(1, "src/a.js", 60.0, 3.0, 1.0, 1.0, 1200)], "file_id bigint, rel_path string, axis_a double, axis_b double, axis_c double, role_weight double, line_count bigint")
    hits = spark.createDataFrame([(1, "r", f"kind{i:03}", 5, i, 0) for i in range(95)], "file_id bigint, rule_id string, category string, severity int, line_index int, ord int")
    lines = render.text_report(scores, hits).split("\n")
    assert [x.split()[-1] for x in lines[lines.index("Breakdown") + 1 :]] == [f"kind{i:03}" for i in range(95)]


def brute_clusters(names, lines):
    assigned, out = [False] * len(names), []
    for i in range(len(names)):
        if not assigned[i]:
            assigned[i], mine = True, [i]
            for j in range(i + 1, len(names)):
                if not assigned[j] and (names[i] and names[i] == names[j] or abs(lines[j] - lines[i]) <= herd.NEAR):
                    assigned[j] = True
                    mine.append(j)
            out.append(mine)
    return out


def test_herds_match_brute_force(spark):
    rnd = random.Random(6)
    rows = []
    for f in range(12):
        rows += [(f, o, rnd.choice([None, *range(60)]), rnd.choice([None, "", "a", "b", "c"]), rnd.choice(["aaaa", "abcd1234", "x9$Kq!", "wxyz5678", None])) for o in range(rnd.randrange(0, 40))]
    df = spark.createDataFrame(rows, "file_id bigint, ord bigint, line_index int, identifier_name string, value string")
    got = {(r["file_id"], r["ord"]): (r["herd_id"], r["herd_size"]) for r in herd.discriminated(df).collect()}
    expected = {}
    for f in range(12):
        mine = [r for r in rows if r[0] == f and r[4] is not None]
        entropy = lambda v: -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
        n = 0
        for members in brute_clusters([r[3] for r in mine], [r[2] or 0 for r in mine]):
            h = [entropy(mine[i][4]) for i in members]
            mean = sum(h) / len(h)
            small = len(members) < herd.LEAST
            if small or sum((x - mean) ** 2 for x in h) / len(h) >= herd.VARIANCE or max(h) - min(h) > herd.SPREAD:
                n += not small
                expected.update({(f, mine[i][1]): (None, None) if small else (n, len(members)) for i in members})
    assert got == expected
    assert herd.discriminated(df.limit(0)).count() == 0


def test_servers_by_file_name_and_odd_members(spark):
    other = '{"mcp": {"servers": {"a": {"url": "http://host.example"}, "b": "text", "c": null}}}'
    odd = '{"servers": {"d": {"command": "bash", "args": "run-c x", "tools": ["*"], "env": {"N": 5, "Z": null}}, "e": {"command": "node", "args": ["a", null, 3]}}}'
    rows = [("x/settings.json", other), ("x/mcp.json", other), ("y/mcp.json", odd), ("z/mcp.json", None), ("z/settings.json", "[1]")]
    got = {(r["path"], r["server"], r["rule_id"]) for r in mcp.findings(spark.createDataFrame(rows, "path string, document string")).collect()}
    assert got == {("x/settings.json", "a", "mcp-insecure-http"), ("y/mcp.json", "d", "mcp-shell-injection")}


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(8)
    items = [(f, rnd.randrange(1, 60), o) for o, f in enumerate(rnd.choices(range(5), k=60))] + [(1, None, 99)]
    wanted = [(f, n) for f in range(7) for n in (1, 17, 30, 90)]
    got = {(r["file_id"], r["line_number"]): (r["gap"], r["ord"]) for r in report.nearest(spark.createDataFrame(items, "file_id int, line_number int, ord int"), spark.createDataFrame(wanted, "file_id int, line_number int")).collect()}
    assert got == {(f, n): min((abs(i[1] - n), i[2]) for i in items if i[0] == f and i[1]) for f, n in wanted if any(i[0] == f for i in items)}


def test_one_each_takes_the_earliest_and_keeps_the_others(spark):
    rows = [(1, "b", "2024-01-02"), (1, "a", "2024-01-01"), (2, "c", None), (3, "d", "2024-01-01"), (3, "c", "2024-01-01"), (None, "x", "2024-01-01")]
    got = tables.one_each(spark.createDataFrame(rows, "file_id int, relative_path string, ingested_at string")).collect()
    assert sorted((r["file_id"], r["relative_path"]) for r in got) == [(1, "a"), (2, "c"), (3, "c")]


def test_reference_texts_and_changed_paths(spark, tmp_path):
    import gzip
    import subprocess

    assert tables.corpus(spark, str(tmp_path)) is None and tables.changed_paths(spark, str(tmp_path), "HEAD") is None
    for name, text in (("human", "plain words of people\n" * 30), ("ai", "const x = 1;\n" * 30)):
        with gzip.open(tmp_path / f"{name}.js.gz", "wt") as f:
            f.write(text)
    files = spark.createDataFrame([(1, "const x = 1;\n" * 40), (2, "quite other things 0123456789"), (3, ""), (4, None)], "file_id int, content string")
    got = {r["file_id"]: r for r in compression_of(files, tables.corpus(spark, str(tmp_path))).collect()}
    assert got[1]["ncd_ai"] < got[1]["ncd_human"] and got[1]["compression"] > 60 and got[3]["ncd_ai"] == 1.0 and set(got) == {1, 2, 3}
    assert {r["ncd_ai"] for r in compression_of(files).collect()} == {None}
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=tmp_path, check=True, capture_output=True)
    (tmp_path / "a.js").write_text("1")
    run("init", "-q"), run("add", "."), run("commit", "-qm", "x")
    (tmp_path / "a.js").write_text("2"), (tmp_path / "b.txt").write_text("2")
    assert [r["path"] for r in tables.changed_paths(spark, str(tmp_path), "HEAD").collect()] == ["a.js"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir(), (tmp_path / ".vscode").mkdir()
    (tmp_path / "src" / "a.js").write_text("const k = eval('x');\n// TODO: implement\nconst apiKey = 'Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1';\n")
    (tmp_path / "src" / "b.js").write_text("export const one = 1;\n")
    (tmp_path / ".vscode" / "mcp.json").write_text('{"servers": {"s": {"tools": "*"}}}')
    assert main([str(tmp_path)]) in (0, 1)
    text = capsys.readouterr().out
    assert all(x in text for x in ("eval-usage", "mcp-wildcard-tools", "Clean", "src/b.js", "Breakdown", "Files"))
    assert main([str(tmp_path), "--file", "a.js", "--show", "hits", "--threshold", "A:0,B:0,C:0"]) == 1
    text = capsys.readouterr().out
    assert "eval-usage" in text and "src/b.js" not in text
    main([str(tmp_path), "--json", str(tmp_path / "out")])
    sections = {r["section"] for r in spark.read.option("basePath", str(tmp_path / "out")).text(str(tmp_path / "out")).collect()}
    assert {"pattern_hits", "per_file", "completion", "counts_by_file"} <= sections


def test_a_union_promises_no_partitioning_to_the_joins_above(spark):
    conf = {"spark.sql.unionOutputPartitioning": "true", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        records = spark.createDataFrame([(i % 9, f"src/a{i}.js", "x", None) for i in range(12)], "file_id bigint, relative_path string, content string, ingested_at timestamp")
        once = tables.one_each(records)
        above = once.groupBy("file_id").count()._jdf.queryExecution().executedPlan().toString().split("Union")[0]
        assert "Exchange hashpartitioning(file_id" in above
        assert once.count() == 9
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_report_text_scores_the_files_once(spark, monkeypatch):
    from siftwright import queries
    from siftwright.operators import render

    plans = []
    whole = render.text_report
    monkeypatch.setattr(render, "text_report", lambda scores, hits, *a: plans.append(scores._jdf.queryExecution().optimizedPlan().toString()) or whole(scores, hits, *a))
    rows = queries.QUERIES["report_text"](spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 1 and "Join" not in plans[0]
    assert "Breakdown" in [r["line"] for r in rows]
