"""Readers and writers on real files."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sealwright import contract as c
from sealwright.operators import inventory
from sealwright.sources import manifests, releases, sidecars, symbols_xml, trees


def write_tree(root, files: dict[str, bytes]) -> None:
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


def test_tree_scan_reads_every_file_once(spark, tmp_path):
    files = {"b1/index.html": b"<p>", "b1/a/x.bin": bytes(range(256)), "b2/index.html": b"", "b2/d/e/f.txt": "é".encode()}
    write_tree(tmp_path, files)
    got = {(r.bundle_id, r.path): (r.size, r.sha256) for r in trees.scan_payload_tree(spark, str(tmp_path)).collect()}
    want = {tuple(p.split("/", 1)): (len(b), hashlib.sha256(b).hexdigest()) for p, b in files.items()}
    assert got == want


def test_empty_trees_are_found(spark, codes):
    scopes = spark.createDataFrame([("a",), ("b",)], "bundle_id string")
    payload = spark.createDataFrame([("a", "x")], "bundle_id string, path string")
    assert codes(inventory.empty_tree(scopes, payload)) == [("b", "inventory.empty_tree", "", "")]


def test_control_files_round_trip(spark, tmp_path, codes):
    content = {"navigation/index.html": b"<p>", "reports/run.json": b"{}", "a.txt": b"a"}
    rows = [("b", p, len(t), hashlib.sha256(t).hexdigest()) for p, t in content.items()]
    payload = spark.createDataFrame(rows, "bundle_id string, path string, size long, sha256 string")
    texts = {r.name: r.text for r in inventory.control_texts(payload).collect()}
    write_tree(tmp_path, {f"b/{name}": text.encode() for name, text in texts.items()})
    stored = manifests.load_texts(spark, str(tmp_path), c.MANIFEST)
    entries = manifests.read_manifests(stored)
    assert [(r.pos, r.path) for r in entries.orderBy("pos").collect()] == list(enumerate(sorted(content)))
    points = manifests.read_entry_points(stored).first()
    assert (points["index"], points["run_report"]) == (c.INDEX_PATH, c.RUN_REPORT_PATH)
    assert codes(manifests.manifest_shape_audit(stored)) == []
    records = manifests.read_checksums(manifests.load_texts(spark, str(tmp_path), c.CHECKSUMS))
    control = inventory.ordered_manifest_digest(payload)
    assert codes(inventory.checksums_check(records, payload, control)) == []
    bad = control.withColumn("sha256", F.lit("0" * 64))
    assert codes(inventory.checksums_check(records, payload, bad)) == [("b", "checksums.noncanonical", c.MANIFEST, "digest")]


def test_manifest_shapes(spark, codes):
    good = '{"entries":[],"entry_points":{"index":"i","run_report":"r"},"schema":"%s"}' % c.schema_id("bundle-manifest.v1")
    rows = [("ok", good), ("cut", good[:-3]), ("more", good[:-1] + ',"x":1}'), ("other", good.replace("manifest.v1", "manifest.v9"))]
    found = codes(manifests.manifest_shape_audit(spark.createDataFrame(rows, "bundle_id string, text string")))
    assert [(s, code) for s, code, _, _ in found] == [
        ("cut", "manifest.invalid_json"), ("more", "manifest.invalid_shape"), ("other", "manifest.unsupported_schema"),
    ]


def test_checksum_text_edges(spark):
    line = "a" * 64 + "  p\n"
    texts = [("ok", line), ("open", line[:-1]), ("blank", line + "\n"), ("empty", "")]
    rows = manifests.read_checksums(spark.createDataFrame(texts, "bundle_id string, text string")).collect()
    got = sorted((r.bundle_id, r.pos, r.path, r.code) for r in rows)
    bad = "checksums.noncanonical"
    assert got == [("blank", 0, "p", None), ("blank", 1, None, bad), ("ok", 0, "p", None), ("open", 0, None, bad)]


INDEX = """<?xml version='1.0'?><doxygen><compounddef id="c1" kind="class"><compoundname>K</compoundname>
<sectiondef><memberdef id="m1" kind="function"><name>f</name><argsstring>(int  a)</argsstring><location file="s.c" line="07"/></memberdef></sectiondef>
<location file="s.c" line="3" column="1"/></compounddef><compounddef id="d1" kind="dir"><compoundname>src</compoundname><location file="src"/></compounddef></doxygen>"""
TAGS = """<tagfile><compound kind="class"><name>K</name><filename>k.html</filename>
<member kind="function"><name>f</name><anchorfile>k.html</anchorfile><anchor>a1</anchor><arglist>(int a)</arglist></member>
<member kind="function"><name>g</name><anchorfile>k.html</anchorfile></member></compound></tagfile>"""


def test_symbol_files(spark, tmp_path, codes):
    write_tree(tmp_path, {"c.xml": INDEX.encode(), "t.tag": TAGS.encode()})
    compounds = symbols_xml.load_compounds(spark, str(tmp_path / "c.xml")).withColumn("snapshot_id", F.lit("s"))
    entities = {r.refid: r for r in symbols_xml.read_symbol_entities(compounds).collect()}
    assert sorted(entities) == ["c1", "m1"]
    assert entities["m1"].qualified_name == "f" and entities["m1"].line == "07"
    assert {r.refid for r in symbols_xml.detail_refids(compounds).collect()} == {"c1", "m1", "d1"}
    tags = symbols_xml.load_tags(spark, str(tmp_path / "t.tag")).withColumn("snapshot_id", F.lit("s"))
    targets = sorted((r.member_name or "", r.html_path, r.anchor) for r in symbols_xml.read_symbol_targets(tags).collect())
    assert targets == [("", "html/k.html", ""), ("f", "html/k.html", "a1")]
    assert codes(symbols_xml.incomplete_targets(tags)) == [("s", "doxygen.output_malformed", "K", "anchor")]


def test_attestation_audit(spark, codes):
    good = (
        '{"configuration_identity_sha256":"%s","coverage_data_identity":"d","instrumentation_identity":"i","producer":{"name":"n","version":"1"},'
        '"report":{"entry_point":"i.html","tree_sha256":"%s"},"schema":"%s","snapshot_id":"s","test_result_identity":"r","test_selection_identity":"t"}'
        % ("a" * 64, "b" * 64, c.schema_id("coverage-attestation.v1"))
    )
    rows = [
        ("ok", good), ("hex", good.replace("b" * 64, "B" * 64)), ("name", good.replace('"name":"n"', '"name":""')),
        ("keys", good.replace('"snapshot_id":"s",', "")), ("schema", good.replace("attestation.v1", "attestation.v2")),
    ]
    found = codes(sidecars.attestation_audit(spark.createDataFrame(rows, "scope string, text string")))
    assert [(s, d) for s, _, _, d in found][:3] == [("hex", "tree_sha256"), ("keys", "members"), ("name", "producer")]
    assert found[3][1] == "coverage.unsupported_attestation_schema"


def test_releases_append_once(spark, tmp_path):
    path = str(tmp_path / "releases")
    schema = "root string, bundle_id string, run_report_sha256 string"
    spark.createDataFrame([("r", "b1", "x")], schema).write.partitionBy("root").parquet(path)
    candidates = spark.createDataFrame([("r", "b1", "x"), ("r", "b2", "y"), ("r", "b2", "y")], schema)
    releases.append_new_releases(candidates, path)
    releases.append_new_releases(candidates, path)
    assert sorted(r.bundle_id for r in spark.read.parquet(path).collect()) == ["b1", "b2"]


def test_releases_with_records(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "root string, bundle_id string, run_report_sha256 string"
    first = spark.createDataFrame([("r", "b1", "x"), ("r", "b2", "y"), ("r", "b2", "z"), ("s", "b1", "x")], schema)
    second = spark.createDataFrame([("r", "b1", "other"), ("r", "b3", "x"), ("s", "b1", "x")], schema)

    def rows(frame):
        return sorted(tuple(r) for r in frame.collect())

    assert rows(releases.read_releases(spark, path)) == []
    told = [("r", "b1", "x", "append"), ("r", "b2", "y", "append"), ("r", "b2", "z", "publication.release_identity_mismatch"), ("s", "b1", "x", "append")]
    assert rows(releases.append_new_releases(first, path, "one")) == told
    table = [("r", "b1", "x"), ("r", "b2", "y"), ("s", "b1", "x")]
    assert rows(releases.read_releases(spark, path)) == table
    # the same attempt again: the same answer, and nothing is added
    assert rows(releases.append_new_releases(first, path, "one")) == told and rows(releases.read_releases(spark, path)) == table
    # a driver lost between its rows and its record
    second.write.parquet(f"{path}/attempts/two")
    assert rows(releases.read_releases(spark, path)) == table
    assert rows(releases.append_new_releases(second, path, "two")) == [
        ("r", "b1", "other", "publication.release_identity_mismatch"), ("r", "b3", "x", "append"), ("s", "b1", "x", "reuse"),
    ]
    assert rows(releases.read_releases(spark, path)) == sorted([*table, ("r", "b3", "x")])
    # a record that another driver has made first
    assert not releases._commit(spark, path, 1, "late") and releases.commits(spark, path) == ["one", "two"]
    assert releases._commit(spark, path, 2, "next") and not (tmp_path / "table/commits/.0000000001-late").exists()


def test_trees_are_listed_level_by_level(spark, tmp_path):
    deep = "b1/" + "/".join(f"d{i}" for i in range(6)) + "/x.txt"
    files = {deep: b"deep", "b1/e.txt": b"", "b2/ä ö%20.txt": b"name", "b2/big.bin": bytes(3 << 20), "top.txt": b"no bundle", **{f"b3/many/{i}.txt": b"%d" % i for i in range(300)}}
    write_tree(tmp_path, files)
    (tmp_path / "b2/empty").mkdir()
    (tmp_path / "b2/link").symlink_to("big.bin")
    for root in (str(tmp_path), f"file:{tmp_path}/"):
        got = {(r.bundle_id, r.path): (r.size, r.sha256) for r in trees.scan_payload_tree(spark, root).collect()}
        assert got == {tuple(p.split("/", 1)): (len(b), hashlib.sha256(b).hexdigest()) for p, b in files.items() if "/" in p}
    kinds = {(r.bundle_id, r.path): r.object_type for r in trees.scan_listing(spark, str(tmp_path)).collect()}
    assert kinds["b2", "empty"] == "directory" and kinds["b2", "link"] == "symlink" and len(kinds) == len(files) - 1 + 6 + 3


def test_written_trees_come_back(spark, tmp_path):
    rows = [("b", "a/x.txt", "é"), ("b", "y", ""), ("c", "z/z/z", "w" * 100_000), ("c", "none", None)]
    trees.write_tree(spark.createDataFrame(rows, "bundle_id string, path string, content string"), f"file:{tmp_path}/t")
    trees.write_tree(spark.createDataFrame(rows, "bundle_id string, path string, content string"), f"file:{tmp_path}/t")
    got = {(r.bundle_id, r.path, r.size, r.sha256) for r in trees.scan_payload_tree(spark, f"{tmp_path}/t").collect()}
    assert got == {(b, p, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for b, p, t in rows if t is not None}
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".")]
