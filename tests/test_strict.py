"""Exact patterns, strict JSON, canonical escapes, page parts, order of findings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sealwright import contract as c
from sealwright.functions import ids, json_text, markup
from sealwright.operators import findings, inventory, links, records
from sealwright.sources import manifests

DIGEST = "a" * 64
GOOD = {
    "HEX64": DIGEST, "HEX40": "a" * 40, "SIZE": "12", "POSITIVE_SIZE": "3", "TOKEN": "a.b-c", "KIND": "a-b", "VERSION": "1.0+x",
    "KEY_ID": "k:1", "SNAPSHOT_ID": f"snapshot:sha256:{DIGEST}", "BUNDLE_ID": f"bundle:sha256:{DIGEST}",
    "RELEASE_TARGET": f"releases/bundle:sha256:{DIGEST}", "RELATION_ID": f"coverage-relation:sha256:{DIGEST}",
    "CHECKSUM_LINE": f"{DIGEST}  p", "INTEGER": "-7",
}


def test_patterns_hold_for_whole_texts(spark):
    rows = [(name, text + end, end == "") for name, text in GOOD.items() for end in ("", "\n", "\r\n", "\r", " ", "\u0085")]
    rows += [(name, "\n" + text, False) for name, text in GOOD.items()]
    table = spark.createDataFrame(rows, "name string, text string, good boolean")
    told = F.coalesce(*[F.when(F.col("name") == name, F.col("text").rlike(getattr(c, name))) for name in GOOD])
    # a blank is part of a path
    wrong = table.filter((told != F.col("good")) & ~((F.col("name") == "CHECKSUM_LINE") & F.col("text").rlike(r"[ \x{85}]\z")))
    assert wrong.collect() == []


def test_checksum_lines_with_carriage_returns(spark):
    texts = [("crlf", f"{DIGEST}  p\r\n"), ("ok", f"{DIGEST}  p\n")]
    got = {r.bundle_id: r.code for r in manifests.read_checksums(spark.createDataFrame(texts, "bundle_id string, text string")).collect()}
    assert got == {"crlf": "checksums.noncanonical", "ok": None}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a":1}', (True, ["a"], [], False)), ('{"a":1} xyz', (False, None, [], False)), ("{'a':1}", (False, None, [], False)),
        ('[{"a":1,"a":2}]', (True, None, [], True)), ('{"k":{"n":1,"n":2}}', (True, ["k"], [], True)), ('{"k":1,"k":2,"z":0}', (True, ["k", "k", "z"], ["k"], False)),
        ('{"a":NaN}', (False, None, [], False)), ("", (False, None, [], False)), (None, (False, None, [], False)), ("3", (True, None, [], False)),
        ('{"a":' + "9" * 9000 + "}", (True, ["a"], [], False)), ("[" * 100_000, (False, None, [], False)), ('{"a":[{"x":1},{"x":2}]}', (True, ["a"], [], False)),
    ],
)
def test_strict_reading(text, want):
    assert json_text.read(text) == want


def test_json_audits(spark, codes):
    rows = [("t", '{"a":1} xyz'), ("q", "{'a':1}"), ("l", '[{"a":1,"a":2}]'), ("ok", '{"a":1}'), ("n", "3")]
    table = spark.createDataFrame(rows, "s string, j string")
    assert sorted((s, code) for s, code, _, _ in codes(records.closed_record_audit(table, "s", "j", ("a",)))) == [
        ("l", "manifest.invalid_shape"), ("n", "manifest.invalid_shape"), ("q", "manifest.invalid_json"), ("t", "manifest.invalid_json"),
    ]
    assert [(s, d) for s, _, _, d in codes(records.duplicate_member_audit(table, "s", "j"))] == [("l", "nested")]


def test_canonical_escapes_are_lower_case(spark):
    texts = ["".join(map(chr, range(0x20))), "\\u001F", "\\\\u001F\x1f", "\x1f\\\x1f\\\\\x1f", "plain é", "\x1b[0m \\x1B"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in table.select("t", ids.canonical({"v": F.col("t")}).alias("j"), ids.json_string(F.col("t")).alias("s")).collect():
        assert row.j == json.dumps({"v": row.t}, ensure_ascii=False, separators=(",", ":")) and row.s == json.dumps(row.t, ensure_ascii=False)
    stored = spark.createDataFrame([("low", '{"k":"\\u001f"}'), ("up", '{"k":"\\u001F"}')], "s string, j string")
    assert [r.scope_id for r in records.canonical_json_audit(stored, "s", "j", "k string").collect()] == ["up"]


def test_page_parts_by_rule():
    page = '<A HREF=x id=i name=n><base href><img SRC="p" srcset><object data=d><video poster=v data=no><p name=no poster=no id>'
    got = sorted((kind, value) for kind, _, value in markup.parts_of(page) if value is not None)
    assert got == [("anchor", "i"), ("anchor", "n"), ("reference", "d"), ("reference", "p"), ("reference", "v"), ("reference", "x")]
    assert sorted({kind for kind, _, _ in markup.parts_of(page)}) == ["anchor", "base", "reference", "srcset"]
    assert markup.parts_of(None) == [("unreadable", 0, None)] and markup.parts_of("") == []


def test_a_null_page_is_a_finding(spark, codes):
    html = spark.createDataFrame([("b", "p.html", None), ("b", "q.html", "<p>")], "bundle_id string, path string, html string")
    assert codes(links.unsupported_parts(links.page_parts(html))) == [("b", "link.invalid_html_utf8", "p.html", "")]


def first_of(spark, pages, files=()):
    html = spark.createDataFrame([("b", p, t) for p, t in pages.items()], "bundle_id string, path string, html string")
    known = spark.createDataFrame([("b", p) for p in [*pages, *files]], "bundle_id string, path string")
    parts = links.page_parts(html)
    resolved, anchor = links.resolve_links(links.links(parts)), links.anchors(parts)
    found = findings.union(
        links.unsupported_parts(parts, True), links.duplicate_anchors(anchor, True), links.resolution_findings(resolved, True),
        links.link_target_check(resolved, known, True), links.link_fragment_check(resolved, known, anchor, True),
    )
    return findings.first_finding(found).first().code


def test_first_faults_follow_pages_and_places(spark):
    assert first_of(spark, {"a.html": '<p id=x><p id=x><base href="/">'}) == "link.unsupported_base"
    assert first_of(spark, {"z.html": '<a href="0.html">', "b.html": '<a href="%zz">'}) == "link.malformed_percent"
    assert first_of(spark, {"a.html": '<a href="gone.html"><a href="%zz">'}) == "link.missing_target"


def test_targets_must_be_nfc(spark):
    link = spark.createDataFrame([("b", "p.html", 0, "cafe%CC%81.html"), ("b", "p.html", 1, "caf%C3%A9.html")], "bundle_id string, path string, pos int, reference string")
    assert {r.pos: r.code for r in links.resolve_links(link).collect()} == {0: "path.invalid", 1: None}


def test_order_faults_show_across_gaps_and_runs(spark, monkeypatch, codes):
    monkeypatch.setattr(inventory, "ORDER_RUN", 3)
    rows = [("b", p, k) for p, k in [(0, "a"), (4, "c"), (5, "b"), (11, "d"), (12, "cc"), (30, "z")]]
    found = codes(inventory.order_audit(spark.createDataFrame(rows, "s string, pos int, path string"), "s"))
    assert [(path, detail) for _, _, path, detail in found] == [("b", "c"), ("cc", "d")]


def test_a_deep_chain_of_stages(spark):
    from sealwright.operators import stages

    names = [f"s{i:03}" for i in range(30)]
    stage = spark.createDataFrame([("r", n) for n in names], "run_id string, stage string")
    deps = spark.createDataFrame([("r", b, a) for a, b in zip(names, names[1:])], "run_id string, stage string, dependency string")
    assert {r.stage: r.level for r in stages.stage_levels(stage, deps).collect()} == {n: i for i, n in enumerate(names)}
