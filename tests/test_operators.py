"""Literal cases: a clean row and one row per fault the generated tables do not hold."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sealwright import contract as c
from sealwright.operators import (
    configuration, coverage, findings, graph, inventory, links, producers, records, release, snapshots, stages, symbols,
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_first_finding_puts_size_before_digest(spark):
    rows = [("b", 50, "payload.hash_mismatch", "p", "d"), ("b", 50, "payload.size_mismatch", "p", "1/2"), ("b", 90, "link.root_escape", "a", "x")]
    frame = spark.createDataFrame(rows, "scope_id string, check_rank int, code string, path string, detail string")
    assert findings.first_finding(frame).first().code == "payload.size_mismatch"


def test_forbidden_objects(spark, codes):
    rows = [("b", "x", "other"), ("b", "y", "file")]
    assert codes(inventory.forbidden_objects(spark.createDataFrame(rows, "bundle_id string, path string, object_type string"))) == [
        ("b", "inventory.forbidden_object", "x", "")
    ]


PAGE = """<!doctype html><HTML><head><base HREF="x"></head><body><!-- <a href="no.html"> --><script>var s='<a href="no">';</script>
<a href=plain.html name="top">p</a><img SRCSET="i 2x" src='i.png'><object data="o.bin"></object><video poster="v.png"></video>
<a href="q?a=1&amp;b=2#f">q</a><p id="one" /><a href>empty</a><i data="not"></i></body>"""


def test_pages_are_read_as_html(spark):
    parts = links.page_parts(spark.createDataFrame([("b", "p.html", PAGE)], "bundle_id string, path string, html string"))
    rows = {}
    for r in parts.orderBy("kind", "pos").collect():
        rows.setdefault(r.kind, []).append(r.value)
    assert rows["reference"] == ["x", "plain.html", "i.png", "o.bin", "v.png", "q?a=1&b=2#f"]
    assert rows["anchor"] == ["top", "one"]
    assert rows["base"] == ["x"] and rows["srcset"] == ["i 2x"]


@pytest.mark.parametrize(
    ("source", "reference", "target", "code"),
    [
        ("a/b.html", "c.html", "a/c.html", None),
        ("a/b.html", "/c.html", "c.html", None),
        ("a/b.html", "../c/", "c/index.html", None),
        ("a/b.html", "", "a/b.html", None),
        ("b.html", ".", ".", "path.invalid"),
        ("b.html", "..", "..", "link.root_escape"),
        ("a/b.html", "x%2Fy.html", "a/x/y.html", None),
        ("a/b.html", "%2e%2e/up.html", "up.html", None),
        ("a/b.html", "\t c.html", "a/c.html", None),
        ("b.html", "%EF%BF%BD.html", "�.html", None),
        ("b.html", "%C3%28.html", None, "link.invalid_percent_utf8"),
        ("b.html", "a%2.html", None, "link.malformed_percent"),
        ("b.html", "//[::1/x", None, "link.invalid_reference"),
        ("b.html", "1x:y.html", "1x:y.html", None),
    ],
)
def test_reference_resolution(spark, source, reference, target, code):
    frame = spark.createDataFrame([("b", source, 0, reference)], "bundle_id string, path string, pos int, reference string")
    row = links.resolve_links(frame).first()
    assert (row.target, row.code) == (target, code)


def test_external_references_drop_out(spark):
    rows = [("b", "p.html", 0, r) for r in ("http://x/y", "mailto:a", "//h/p", "HTTP://[::1]/x")]
    frame = spark.createDataFrame(rows, "bundle_id string, path string, pos int, reference string")
    assert links.resolve_links(frame).count() == 0


def test_fragments_of_other_files(spark, codes):
    resolved = links.resolve_links(
        spark.createDataFrame(
            [("b", "p.html", 0, "d.txt#x"), ("b", "p.html", 1, "p.html#%FF"), ("b", "p.html", 2, "gone.html#x"), ("b", "p.html", 3, "#ok")],
            "bundle_id string, path string, pos int, reference string",
        )
    )
    payload = spark.createDataFrame([("b", "d.txt"), ("b", "p.html")], "bundle_id string, path string")
    anchor = spark.createDataFrame([("b", "p.html", 0, "ok")], "bundle_id string, path string, pos int, name string")
    assert [code for _, code, _, _ in codes(links.link_fragment_check(resolved, payload, anchor))] == [
        "link.invalid_percent_utf8", "link.non_html_fragment",
    ]
    assert codes(links.link_target_check(resolved, payload)) == [("b", "link.missing_target", "gone.html", "p.html")]


def test_page_bytes_must_be_utf8(spark, codes):
    rows = [("b", "x.html", bytearray(b"\xff")), ("b", "y.html", bytearray("é".encode())), ("b", "z.bin", bytearray(b"\xff"))]
    frame = spark.createDataFrame(rows, "bundle_id string, path string, content binary")
    assert codes(links.invalid_html_utf8(frame)) == [("b", "link.invalid_html_utf8", "x.html", "")]


def test_graph_fragment_needs(spark):
    node = spark.createDataFrame(
        [("g", "n1", "symbol", "artifacts/api/h.html", "a1"), ("g", "n2", "coverage-page", "artifacts/coverage/r.html", None)],
        "graph_id string, node_id string, kind string, path string, fragment string",
    )
    edge = spark.createDataFrame(
        [("g", "covers-source", "n2", "f1"), ("g", "has-log", "n2", "f2")], "graph_id string, kind string, source string, fragment string"
    )
    got = sorted((r.path, r.fragment) for r in links.fragment_needs(node, edge).collect())
    assert got == [("artifacts/api/h.html", "a1"), ("artifacts/coverage/r.html", "f1")]


def test_secrets_per_run_and_in_order(spark):
    log = spark.createDataFrame([("r1", 0, "key=abcabc"), ("r2", 0, "abc")], "run_id string, seq int, text string")
    own = spark.createDataFrame([("r1", 0, "abc"), ("r1", 1, "<redacted><redacted>"), ("r1", 2, "")], "run_id string, ord int, literal string")
    assert {r.run_id: r.text for r in records.redact_secrets(log, own).collect()} == {"r1": "key=<redacted>", "r2": "abc"}


def test_sources_missing_and_line_zero(spark, codes):
    relation = spark.createDataFrame(
        [(1, "r", "a/x.c", 0, None), (1, "r", "gone.c", None, None), (1, "r", "x.c", None, None), (1, "r", "y.c", 9, None)],
        "scope int, report_path string, source_path string, line int, symbol string",
    )
    source = spark.createDataFrame([("a/x.c", 3), ("b/x.c", 3), ("y.c", 9)], "path string, line_count int")
    assert [(code, path) for _, code, path, _ in codes(coverage.relation_source_check(relation, source))] == [
        ("coverage.ambiguous_source", "x.c"), ("coverage.source_missing", "gone.c"),
    ]
    assert [code for _, code, _, _ in codes(coverage.relation_line_check(relation, source))] == ["coverage.invalid_sidecar"]


def test_line_counts(spark):
    texts = ["", "a", "a\n", "a\nb", "\n\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(coverage.line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 2]


def test_compound_targets_match_without_member(spark):
    entity = spark.createDataFrame(
        [("s", "c1", "class", "K", None, None), ("s", "m1", "function", "K", "f", "( int   a )"), ("s", "m2", "function", "K", "g", None)],
        "snapshot_id string, refid string, kind string, compound_name string, member_name string, args string",
    )
    target = spark.createDataFrame(
        [("s", "class", "K", None, None, "html/k.html", ""), ("s", "function", "K", "f", "( int a )", "html/k.html", "a"),
         ("s", "function", "K", "g", "", "html/gone.html", "b")],
        "snapshot_id string, kind string, compound_name string, member_name string, args string, html_path string, anchor string",
    )
    payload = spark.createDataFrame([("s", "html/k.html")], "snapshot_id string, path string")
    got = {r.refid: r.outcome for r in symbols.symbol_target_match(entity, target, payload).collect()}
    assert got == {"c1": "mapped", "m1": "mapped", "m2": "doxygen.target_missing"}


def test_levels_cycles_and_outcomes(spark):
    stage = spark.createDataFrame(
        [("r", "a", "required", "succeeded", False), ("r", "b", "optional", "failed", False), ("r", "c", "required", "succeeded", False),
         ("r", "d", "optional", "succeeded", True), ("r", "x", "required", "succeeded", False), ("r", "y", "required", "succeeded", False),
         ("r", "z", "required", "succeeded", False)],
        "run_id string, stage string, policy string, own_status string, static_fault boolean",
    )
    dep = spark.createDataFrame(
        [("r", "a", "snapshot"), ("r", "b", "a"), ("r", "c", "b"), ("r", "c", "a"), ("r", "d", "b"), ("r", "x", "y"), ("r", "y", "x"), ("r", "z", "who")],
        "run_id string, stage string, dependency string",
    )
    levels = {r.stage: r.level for r in stages.stage_levels(stage, dep).collect()}
    assert levels == {"a": 0, "b": 1, "c": 2, "d": 2, "x": None, "y": None, "z": None}
    outcome = stages.stage_outcomes(stage, dep)
    assert {r.stage: r.status for r in outcome.collect()} == {"a": "succeeded", "b": "degraded", "c": "blocked", "d": "skipped"}
    failed = stages.failed_dependencies(outcome, dep).collect()
    assert [(r.path, r.detail) for r in failed] == [("c", "b")]


def test_no_required_stage_is_satisfied(spark):
    rows = [("r", "optional", "failed"), ("q", "required", "blocked")]
    frame = spark.createDataFrame(rows, "run_id string, policy string, status string")
    assert {r.run_id: r.decision for r in stages.required_stage_decision(frame).collect()} == {"r": "satisfied", "q": "blocked"}


def test_spans_and_spawn_failures(spark, codes):
    rows = [("r", "ok", "succeeded", 0, None, "2024-01-01 00:00:00", "2024-01-01 00:00:10", 10.0),
            ("r", "slow", "succeeded", 0, None, "2024-01-01 00:00:00", "2024-01-01 00:00:10", 20.0),
            ("r", "spawn", "failed", 1, "spawn", "2024-01-01 00:00:00", "2024-01-01 00:00:01", 1.0),
            ("r", "silent", "failed", 1, None, "2024-01-01 00:00:00", "2024-01-01 00:00:01", 1.0)]
    frame = spark.createDataFrame(
        rows, "run_id string, stage string, status string, exit_code int, failure_kind string, s string, e string, duration_seconds double"
    ).select("*", F.to_timestamp("s").alias("started_at"), F.to_timestamp("e").alias("ended_at"))
    assert [(path, detail) for _, _, path, detail in codes(stages.process_evidence_audit(frame))] == [
        ("silent", "failure kind"), ("slow", "duration"), ("spawn", "exit code"),
    ]


def test_empty_object_merging(spark):
    leaf = spark.createDataFrame(
        [("p", 0, "/a/x", "1"), ("p", 1, "/a", "{}"), ("p", 0, "/b", "3"), ("p", 1, "/b", "{}"), ("p", 0, "/c/x", "1"), ("p", 2, "/c", "{}")],
        "project_id string, layer int, pointer string, value_json string",
    )
    got = {r.pointer: r.value_json for r in configuration.config_layer_resolve(leaf).collect()}
    assert got == {"/a/x": "1", "/b": "{}", "/c": "{}"}


def test_snapshot_retargeted_and_kept(spark):
    schema = "path string, kind string, mode string, sha256 string, target string"
    before = spark.createDataFrame([("l", "symlink", "120000", "1", "a"), ("f", "file", "100644", "1", None)], schema)
    after = spark.createDataFrame([("l", "symlink", "120000", "2", "b"), ("f", "file", "100644", "1", None)], schema)
    assert sorted(r.change for r in snapshots.snapshot_diff(before, after).collect()) == ["byte-changed", "retargeted"]


def test_graph_is_sound_and_forging_shows(spark, codes):
    snap = "snapshot:sha256:" + sha("s")
    records_ = {
        "snapshot": spark.createDataFrame([("g", snap)], "graph_id string, snapshot_id string"),
        "snapshot_file": spark.createDataFrame(
            [("g", snap, "src/é.c", "file", sha("c"))], "graph_id string, snapshot_id string, path string, kind string, sha256 string"
        ),
    }
    node, edge = graph.assemble(records_)
    assert node.count() == 2 and edge.count() == 1
    for check in (
        graph.content_id_check(node, edge), graph.node_field_audit(node), graph.edge_field_audit(edge),
        graph.edge_endpoint_check(node, edge), graph.edge_type_check(node, edge), graph.singleton_check(node),
    ):
        assert codes(check) == []
    source = node.filter("kind = 'source-file'").first()
    text = '{"identity":{"path":"src/é.c","sha256":"%s","snapshot_id":"%s"},"kind":"source-file"}' % (sha("c"), snap)
    assert source.identity_json == text and source.node_id == "source-file:sha256:" + sha(text)
    forged = node.withColumn("label", F.when(F.col("kind") == "source-file", "other").otherwise(F.col("label")))
    assert [detail for _, _, _, detail in codes(graph.node_field_audit(forged))] == ["label"]
    stored = spark.createDataFrame([("g", "artifact-graph:sha256:0")], "graph_id string, content_id string")
    digest = graph.graph_digest(node, edge, records_["snapshot"])
    assert [code for _, code, _, _ in codes(graph.graph_id_check(stored, digest))] == ["artifact_graph.identity_mismatch"]


def test_graph_ids_do_not_depend_on_row_order(spark):
    snap = "snapshot:sha256:" + sha("s")
    files = [("g", snap, f"src/{n}.c", "file", sha(str(n))) for n in range(40)]
    schema = "graph_id string, snapshot_id string, path string, kind string, sha256 string"
    head = spark.createDataFrame([("g", snap)], "graph_id string, snapshot_id string")
    seen = set()
    for rows in (files, files[::-1]):
        node, edge = graph.assemble({"snapshot": head, "snapshot_file": spark.createDataFrame(rows, schema).repartition(3)})
        seen.add(graph.graph_digest(node, edge, head).first().content_id)
        seen.add(graph.graph_digest(node, edge, head).first().content_id)
    assert len(seen) == 1


def test_contract_gate_across_slices(spark, codes):
    rows = [("p", 1, "1", 1, "a"), ("p", 250, "1", 2, "b"), ("p", 251, "2", 2, "c"), ("p", 252, "3", 3, "d")]
    frame = spark.createDataFrame(rows, "project string, revision_order long, version string, fixture_revision int, contract_digest string")
    assert codes(release.contract_change_gate(frame, slice_width=100)) == [
        ("p", "contract.fixture_unchanged", "251", "2"), ("p", "contract.version_unchanged", "250", "1"),
    ]


def test_pointer_to_a_release_of_another_identity(spark):
    name = "bundle:sha256:" + sha("b")
    pointer = spark.createDataFrame([("r", "releases/" + name)], "root string, target string")
    stored = spark.createDataFrame([("r", name, "x", "bundle:sha256:" + sha("z"))], "root string, bundle_id string, run_report_sha256 string, verified_id string")
    row = release.release_pointer_check(pointer, stored).first()
    assert (row.state, row.code, row.bundle_id) == ("recovery-blocked", "publication.recovery_identity_mismatch", None)


def test_archive_names_fold_beyond_ascii(spark, codes):
    rows = [("a", "Straße"), ("a", "STRASSE"), ("a", "é"), ("a", "É"), ("a", "d/"), ("a", "ok")]
    found = codes(release.archive_name_collisions(spark.createDataFrame(rows, "archive string, path string"), "archive"))
    assert [(code, path) for _, code, path, _ in found] == [
        ("distribution.name_collision", "strasse"), ("distribution.name_collision", "é"), ("distribution.unsafe_member", "d/"),
    ]


def test_duplicate_producer_names_are_refused():
    registry = producers.ProducerRegistry()
    registry.register_producer("a", lambda tables: tables["t"])
    with pytest.raises(ValueError):
        registry.register_producer("a", lambda tables: tables["t"])


def test_whole_bundle_verification(spark, codes):
    from sealwright.plans import verify

    pages = {"navigation/index.html": '<a href="../a.txt">a</a>', "a.txt": "a"}
    # a configuration identity is closed too: all its members have to be there
    digest = "d" * 64
    identity = (
        '{"controlled_input":{"path":"i.json","sha256":"%s","size":"1"},"defaults":{"id":"x","sha256":"%s"},"overrides":[],"resolved":{"sha256":"%s"},"schema":{"id":"%s","sha256":"%s"}}'
        % (digest, digest, digest, c.schema_id("config.v1"), digest)
    )
    report = (
        '{"artifact_counts":[],"claim_boundary":{"does_not_establish":[%s],"scope":"%s"},"configuration_identity":%s,"diagnostics":[],"inspector":{"version":"1"},'
        '"optional_stages":{"degraded":[],"skipped":[]},"plan_sha256":"%s","required_stage_decision":"satisfied","schema":"%s","snapshot_id":"snapshot:sha256:%s","stage_result_digests":[]}'
        % (",".join(f'"{x}"' for x in c.CLAIM_EXCLUSIONS), c.CLAIM_SCOPE, identity, "a" * 64, c.schema_id("run.v1"), "b" * 64)
    )
    content = {**pages, "reports/run.json": report}
    rows = [("b", p, n, len(t), sha(t)) for n, (p, t) in enumerate(sorted(content.items()))]
    payload = spark.createDataFrame(rows, "bundle_id string, path string, pos int, size long, sha256 string")
    manifest = payload.withColumn("size", F.col("size").cast("string"))
    control = inventory.ordered_manifest_digest(payload).collect()[0].sha256
    lines = sorted([(r[1], r[4]) for r in rows] + [(c.MANIFEST, control)])
    checksum = spark.createDataFrame([("b", n, p, d) for n, (p, d) in enumerate(lines)], "bundle_id string, pos int, path string, sha256 string")
    files = [*content, c.MANIFEST, c.CHECKSUMS]
    listing = spark.createDataFrame(
        [("b", p, "file") for p in files] + [("b", "navigation", "directory"), ("b", "reports", "directory")],
        "bundle_id string, path string, object_type string",
    )
    points = spark.createDataFrame([("b", c.INDEX_PATH, c.RUN_REPORT_PATH)], "bundle_id string, index string, run_report string")
    html = spark.createDataFrame([("b", "navigation/index.html", pages["navigation/index.html"])], "bundle_id string, path string, html string")
    reports = spark.createDataFrame([("b", report)], "bundle_id string, report string")

    def run(**changed):
        tables = {"payload": payload, "manifest": manifest, "entry_points": points, "checksum": checksum, "listing": listing, "html": html, "run_report": reports}
        return verify.verify_bundles(**(tables | changed))

    assert codes(run()) == []
    broken = html.withColumn("html", F.lit('<a href="../gone.txt#x">a</a>'))
    assert ("b", "link.missing_target", "gone.txt", "navigation/index.html") in codes(run(html=broken))
