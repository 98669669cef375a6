"""Strictly typed records: run reports, configuration identities and policies, broken in one way each."""

from __future__ import annotations

import copy
import json

import pytest

from sealwright import contract as c
from sealwright.functions import json_walk
from sealwright.operators import configuration, records, release
from sealwright.sources import manifests, sidecars

DIGEST = "0" * 64


def report():
    return {
        "artifact_counts": [{"count": "1", "kind": "api-page"}, {"count": "12", "kind": "source-file"}],
        "claim_boundary": {"does_not_establish": list(c.CLAIM_EXCLUSIONS), "scope": c.CLAIM_SCOPE},
        "configuration_identity": {
            "controlled_input": {"path": "inspector.json", "sha256": DIGEST, "size": "12"}, "defaults": {"id": "builtin", "sha256": DIGEST},
            "overrides": [{"pointer": "/a", "value": {"deep": [1, None, "x"]}}, {"pointer": "/b", "value": 2}], "resolved": {"sha256": DIGEST},
            "schema": {"id": c.schema_id("config.v1"), "sha256": DIGEST},
        },
        "diagnostics": [{"code": "stage.warning", "message": "m", "path": None, "severity": "warning"}, {"code": "a", "message": "n", "path": "x/y", "severity": "info"}],
        "inspector": {"version": "0.1.0"},
        "optional_stages": {"degraded": ["a"], "skipped": ["b", "c"]},
        "plan_sha256": DIGEST, "required_stage_decision": "satisfied", "schema": c.schema_id("run.v1"),
        "snapshot_id": f"snapshot:sha256:{DIGEST}", "stage_result_digests": [DIGEST, "1" * 64],
    }


def dumped(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def put(*steps_and_value):
    *steps, last, value = steps_and_value

    def change(r):
        for s in steps:
            r = r[s]
        r[last] = value

    return change


SHAPE = "run_report.invalid_shape"
IDENTITY = "configuration_identity"
CASES = {
    "unknown member": (put("unexpected", None), {(SHAPE, "members")}),
    "missing member": (lambda r: r.pop("diagnostics"), {(SHAPE, "members")}),
    "schema": (put("schema", "other.v2"), {("run_report.unsupported_schema", None)}),
    "claim": (put("claim_boundary", "scope", "broader"), {(SHAPE, "claim_boundary")}),
    "claim order": (lambda r: r["claim_boundary"]["does_not_establish"].reverse(), {(SHAPE, "claim_boundary")}),
    "configuration shape": (put(IDENTITY, "defaults", "extra", True), {(SHAPE, "configuration members")}),
    "configuration scalar": (put(IDENTITY, "controlled_input", "size", "01"), {(SHAPE, "configuration size")}),
    "number for text": (put(IDENTITY, "controlled_input", "size", 12), {(SHAPE, "configuration size")}),
    "configuration path": (put(IDENTITY, "controlled_input", "path", "../x"), {("path.invalid", "../x")}),
    "pointer escape": (put(IDENTITY, "overrides", [{"pointer": "/bad~2escape", "value": None}]), {(SHAPE, "configuration pointer")}),
    "pointer order": (put(IDENTITY, "overrides", [{"pointer": "/z", "value": None}, {"pointer": "/a", "value": None}]), {(SHAPE, "configuration pointer order")}),
    "pointer overlap": (put(IDENTITY, "overrides", [{"pointer": "/a", "value": None}, {"pointer": "/a/b", "value": None}]), {(SHAPE, "configuration pointer overlap")}),
    "unsafe integer": (put(IDENTITY, "overrides", [{"pointer": "/a", "value": [{"x": 9007199254740992}]}]), {(SHAPE, "configuration override value"), ("run_report.noncanonical", None)}),
    "artifact order": (put("artifact_counts", [{"count": "1", "kind": "z-kind"}, {"count": "0", "kind": "bad_kind"}]), {(SHAPE, "artifact_counts")}),
    "stage lists": (put("optional_stages", {"degraded": ["same", "same"], "skipped": ["same"]}), {(SHAPE, "optional_stages"), (SHAPE, "stage overlap")}),
    "diagnostic": (put("diagnostics", [{"code": "Bad Code", "message": "\n", "path": "../x", "severity": "fatal"}]), {(SHAPE, "diagnostics")}),
    "severity no text": (put("diagnostics", 0, "severity", []), {(SHAPE, "diagnostics")}),
    "decision no text": (put("required_stage_decision", []), {(SHAPE, "decision")}),
    "digests": (put("stage_result_digests", [DIGEST, DIGEST]), {(SHAPE, "stage_result_digests")}),
    "ids": (lambda r: r.update(plan_sha256="A" * 64, snapshot_id=f"run:sha256:{DIGEST}"), {(SHAPE, "plan_sha256"), (SHAPE, "snapshot_id")}),
    "version": (put("inspector", "version", "not valid!"), {(SHAPE, "version")}),
    "list for object": (put("inspector", []), {(SHAPE, "version")}),
    "good": (lambda r: None, set()),
}
TEXTS = {
    "spaces": (lambda t: t.replace(",", ", ", 1), {("run_report.noncanonical", None)}),
    "trailing": (lambda t: t + " x", {("run_report.invalid_json", None)}),
    "repeated": (lambda t: t[:-1] + ',"schema":"%s"}' % c.schema_id("run.v1"), {("run_report.duplicate_member", None)}),
    "surrogate": (lambda t: t.replace('"x"', '"\\ud800"'), {("run_report.invalid_json", None)}),
    "utf-16 order": (lambda t: t.replace('{"deep":[1,null,"x"]}', '{"😀":2,"":1}'), set()),
    "other order": (lambda t: t.replace('{"deep":[1,null,"x"]}', '{"":1,"😀":2}'), {("run_report.noncanonical", None)}),
    "empty": (lambda t: "", {("run_report.invalid_json", None)}),
    "null": (lambda t: None, {("run_report.invalid_json", None)}),
    "list": (lambda t: "[]", {(SHAPE, "members")}),
}


def test_run_reports(spark, codes):
    rows, want = [], set()
    for name, (change, found) in CASES.items():
        r = report()
        change(r)
        rows.append((name, dumped(r), 1))
        want |= {(name, code, "", detail or "") for code, detail in found}
    for name, (change, found) in TEXTS.items():
        rows.append((name, change(dumped(report())), 1))
        want |= {(name, code, "", detail or "") for code, detail in found}
    got = codes(records.run_report_audit(spark.createDataFrame(rows, "run_id string, report string, doc int")))
    assert got == sorted(want)
    # two reports of one run are told apart
    twice = spark.createDataFrame([("r", dumped(report())), ("r", "{")], "run_id string, report string")
    assert codes(records.run_report_audit(twice)) == [("r", "run_report.invalid_json", "", "")]
    assert codes(records.run_report_audit(twice.limit(0))) == []


def test_identities(spark, codes):
    good = report()["configuration_identity"]
    cases = {"ok": {}, "unknown": {"more": 1}, "deep": {"resolved": {"sha256": DIGEST, "x": 1}}, "type": {"overrides": {}}, "range": {"overrides": [{"pointer": "/a", "value": 1e30}]}}
    rows = [(k, dumped(good | v)) for k, v in cases.items()] + [("cut", dumped(good)[:-1]), ("tail", dumped(good) + "]"), ("null", None), ("twice", dumped(good)[:-1] + ',"schema":1}')]
    got = codes(configuration.configuration_identity_audit(spark.createDataFrame(rows, "p string, j string"), "p", "j"))
    assert [(s, d) for s, _, _, d in got] == [
        ("cut", "members"), ("deep", "members"), ("null", "members"), ("range", "override value"), ("tail", "members"),
        ("twice", "members"), ("twice", "repeated member"), ("type", "members"), ("unknown", "members"),
    ]


def test_policies(spark, codes):
    good = {
        "contract_assets": {"a": DIGEST, "b": DIGEST}, "fixture_revision": 3, "package": {"name": "n", "version": "1"}, "schema": c.schema_id("release-policy.v1"),
        "support": {"operating_systems": ["linux"], "process_protocols": ["p1"], "python": ["3.12"], "schemas": sorted([c.schema_id("release-policy.v1"), "z"])},
    }
    cases = {
        "ok": {}, "revision": {"fixture_revision": "3"}, "zero": {"fixture_revision": 0}, "true": {"fixture_revision": True}, "name": {"package": {"name": 1, "version": "1"}},
        "closed": {"package": {"name": "n", "version": "1", "x": 1}}, "assets": {"contract_assets": {"a": DIGEST}}, "digest": {"contract_assets": {"a": 7, "b": DIGEST}},
        "python": {"support": good["support"] | {"python": ["3.12", "3.13"]}}, "text": {"support": good["support"] | {"python": "3.12"}}, "more": {"x": 1},
    }
    rows = [(k, dumped(copy.deepcopy(good) | v)) for k, v in cases.items()] + [("tail", dumped(good) + ","), ("order", dumped(good).replace(f'"a":"{DIGEST}","b"', f'"b":"{DIGEST}","a"'))]
    args = {"package": ("n", "1"), "required_assets": ["b", "a"], "operating_systems": ["linux"], "python": ["3.12"], "protocols": ["p1"]}
    got = codes(release.release_policy_audit(spark.createDataFrame(rows, "s string, j string"), "s", "j", **args))
    assert [(s, d) for s, _, _, d in got] == [
        ("assets", "asset set"), ("closed", "package"), ("digest", "asset digest"), ("more", "members"), ("name", "package"), ("order", "asset order"),
        ("python", "python"), ("revision", "fixture revision"), ("tail", "members"), ("text", "python"), ("true", "fixture revision"), ("zero", "fixture revision"),
    ]


@pytest.mark.parametrize("size", [100, None])
def test_manifests_and_mappings_in_chunks(spark, codes, size):
    entries = [{"path": f"p{i}", "sha256": DIGEST, "size": str(i)} for i in range(30)]
    whole = {"entries": entries, "entry_points": {"index": "p1", "run_report": "p2"}, "schema": c.schema_id("bundle-manifest.v1")}
    wrong = copy.deepcopy(whole)
    wrong["entries"][3]["size"], wrong["entries"][4]["more"], wrong["entry_points"]["x"] = 3, 1, 1
    texts = [("ok", dumped(whole)), ("wrong", dumped(wrong)), ("spaced", dumped(whole).replace('"p7",', '"p7" ,')), ("tail", dumped(whole) + "}"),
             ("deep", dumped(whole).replace('"path":"p9"', '"path":"p9","path":"p9"')), ("none", dumped(whole | {"entries": None}))]
    parts = manifests.manifest_parts(spark.createDataFrame(texts, "bundle_id string, text string"), size)
    got = {(r.bundle_id, r.pos): (r.path, r.sha256, r["size"]) for r in manifests.read_manifests(parts).collect()}
    assert [got["ok", i] for i in range(30)] == [(e["path"], DIGEST, e["size"]) for e in entries] and got["wrong", 3][2] is None
    assert {r.bundle_id: r["index"] for r in manifests.read_entry_points(parts).collect()} == {k: "p1" if k != "tail" else None for k, _ in texts}
    assert codes(manifests.manifest_shape_audit(parts)) == [
        ("deep", "manifest.duplicate_member", "", ""), ("none", "manifest.invalid_shape", "", ""), ("spaced", "manifest.noncanonical", "", ""), ("tail", "manifest.invalid_json", "", ""),
        ("wrong", "manifest.invalid_entry", "p3", "3"), ("wrong", "manifest.invalid_entry", "p4", "4"), ("wrong", "manifest.invalid_entry_points", "", "members"),
    ]
    relations = [{"fragment": None, "line": i, "report_path": "r", "source_path": f"s{i}", "symbol": None} for i in range(20)]
    mapping = {"relations": relations, "report": {"entry_point": "i", "tree_sha256": DIGEST}, "schema": "m"}
    bad = copy.deepcopy(mapping)
    bad["relations"][5]["line"], bad["relations"][6]["x"] = "5", 1
    texts = [("ok", dumped(mapping)), ("bad", dumped(bad)), ("cut", dumped(mapping)[:-1]), ("more", dumped(mapping | {"x": 1}))]
    parts = sidecars.mapping_parts(spark.createDataFrame(texts, "scope string, text string"), size)
    got = {(r.scope, r.pos): (r.source_path, r.line) for r in sidecars.read_relation_sidecars(parts).collect()}
    assert got["ok", 7] == ("s7", 7) and got["bad", 5] == ("s5", None) and len([k for k in got if k[0] == "ok"]) == 20
    assert [(r.scope, r.entry_point) for r in sidecars.read_report_bindings(parts).orderBy("scope").collect()] == [("bad", "i"), ("cut", None), ("more", "i"), ("ok", "i")]
    assert [(s, code) for s, code, _, _ in codes(sidecars.mapping_audit(parts))] == [
        ("bad", "coverage.invalid_relation"), ("cut", "coverage.invalid_sidecar"), ("more", "coverage.invalid_sidecar"),
    ]


def test_values_of_a_text():
    assert [(v[0], v[1], v[5], v[6]) for v in json_walk.values('{"a/b":[1,{"x":true}],"n":-1.5}')] == [
        ("", "", "object", None), ("/a~1b", "/a~1b", "array", None), ("/a~1b/0", "/a~1b/[]", "integer", "1"), ("/a~1b/1", "/a~1b/[]", "object", None),
        ("/a~1b/1/x", "/a~1b/[]/x", "boolean", "true"), ("/n", "/n", "number", "-1.5"),
    ]
    assert json_walk.values("[" * 100_000)[0][5] == json_walk.INVALID and json_walk.values("NaN")[0][5] == json_walk.INVALID


def test_a_text_is_told_in_one_row_for_each_value():
    texts = ['{"a":["x",1,{"b":"y"}],"c":{"a":[]},"a":["z"]}', '[1.5,-0,9007199254740993,"é"]', "{", None, '{"a~/b":{"k":1,"k":2}}', '{"b":1,"a":2}', '"😀"', '{"😀":1,"":2}']
    for text in texts:
        found = json_walk.values(text)
        rows = list(json_walk.told(text, ["/a/[]", "/a/[]/b", "/c/a/[]", "/none/[]"]))
        assert [r[:4] for r in rows] == [(v[1], v[5], v[6], v[7]) for v in found]
        assert [r[4] for r in rows] == [True] + [False] * (len(rows) - 1) and rows[0][5] == found[0][10]
        assert rows[0][6] == (None if found[0][5] == json_walk.INVALID else any(v[9] for v in found))
    assert next(json_walk.told(texts[0], ["/a/[]", "/a/[]/b", "/c/a/[]", "/none/[]"]))[7] == [["x", "z"], ["y"], [], None]


def test_plain_texts_are_canonical_by_the_same_rule():
    for text in ('{"a":1}', '{"b":1,"a":2}', '{"a":-0}', '{"a":1.0}', '{"a":9007199254740991}', '{"a":9007199254740993}', '{"a":"\\u00e9"}', '{"a":1,"a":1}', '{"a":"\\n"}', '{"a":[true,null]}', '{"a": 1}', '{"a":1e2}'):
        value = json_walk.parse(text)
        assert json_walk._canonical(text, value) == (json_walk.canonical(value) == text)


def test_reports_are_audited_in_one_pass(spark):
    table = spark.createDataFrame([("r", dumped(report()))], "run_id string, report string")
    plan = records.run_report_audit(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "parquet" not in plan.lower()
