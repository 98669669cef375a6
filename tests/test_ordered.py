"""Ordered digests: independent recomputation, large scopes, row order."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sealwright import contract as c
from sealwright.functions import ordered
from sealwright.operators import inventory


def payload_rows(count: int):
    rows = []
    for bundle in ("one", "two", "three"):
        for n in range(count if bundle == "one" else 3):
            content = f"{bundle} {n}".encode()
            rows.append((bundle, f"d{n % 7}/é{n}.txt", len(content), hashlib.sha256(content).hexdigest()))
    random.Random(5).shuffle(rows)
    return rows


def by_hand(rows, bundle: str) -> dict:
    own = sorted((r for r in rows if r[0] == bundle), key=lambda r: r[1].encode())
    text = json.dumps(
        {
            "entries": [{"path": p, "sha256": d, "size": str(s)} for _, p, s, d in own],
            "entry_points": {"index": c.INDEX_PATH, "run_report": c.RUN_REPORT_PATH},
            "schema": c.schema_id("bundle-manifest.v1"),
        },
        ensure_ascii=False,
        separators=(",", ":"),
    )
    manifest = hashlib.sha256(text.encode()).hexdigest()
    members = sorted([(p, d) for _, p, _, d in own] + [(c.MANIFEST, manifest)], key=lambda m: m[0].encode())
    checksum_text = "".join(f"{d}  {p}\n" for p, d in members)
    checksums = hashlib.sha256(checksum_text.encode()).hexdigest()
    identity = json.dumps(
        {"identity": {"checksums_sha256": checksums, "manifest_sha256": manifest}, "kind": "bundle"}, separators=(",", ":")
    )
    return {
        "manifest": text, "checksum_text": checksum_text, "manifest_sha256": manifest, "checksums_sha256": checksums,
        "content_id": "bundle:sha256:" + hashlib.sha256(identity.encode()).hexdigest(),
    }


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_CHARS", 300)
    monkeypatch.setattr(ordered, "CHUNK_CHARS", 1000)


def test_bundle_digest_matches_recomputation(spark, small_blocks):
    rows = payload_rows(120)
    payload = spark.createDataFrame(rows, "bundle_id string, path string, size long, sha256 string").repartition(5)
    for row in inventory.bundle_digest(payload).collect():
        want = by_hand(rows, row.bundle_id)
        assert row.manifest_sha256 == want["manifest_sha256"]
        assert row.checksums_sha256 == want["checksums_sha256"]
        assert row.content_id == want["content_id"]


def test_control_texts_join_to_the_exact_files(spark, small_blocks):
    rows = payload_rows(60)
    payload = spark.createDataFrame(rows, "bundle_id string, path string, size long, sha256 string")
    texts: dict = {}
    chunks = inventory.control_texts(payload).collect()
    for row in sorted(chunks, key=lambda r: (r.bundle_id, r.name, r.chunk)):
        texts[row.bundle_id, row.name] = texts.get((row.bundle_id, row.name), "") + row.text
    assert len(chunks) > 8 and all(len(row.text) <= 1000 for row in chunks)
    for bundle in ("one", "two", "three"):
        want = by_hand(rows, bundle)
        assert texts[bundle, c.MANIFEST] == want["manifest"]
        assert texts[bundle, c.CHECKSUMS] == want["checksum_text"]


def test_several_listings_with_scoped_glue(spark, small_blocks):
    frame = spark.range(90).selectExpr("id % 3 as s", "lpad(cast(id as string), 3, '0') as k")
    listing = ordered.lines(frame.filter("s < 2"), ["s"], F.col("k"), F.col("k"), 0).unionByName(
        ordered.lines(frame.filter("s = 1"), ["s"], F.col("k"), F.concat(F.lit("x"), "k"), 2)
    )
    glue = spark.range(3).selectExpr("id as s", "array(concat('<', id), '|', '/', '>') as glue")
    got = {r.s: r.sha256 for r in ordered.ordered_digest(listing, ["s"], glue, parts=3).collect()}
    keys = {s: [f"{n:03d}" for n in range(90) if n % 3 == s] for s in range(3)}
    want = {
        0: "<0" + ",".join(keys[0]) + "|/>",
        1: "<1" + ",".join(keys[1]) + "|/" + ",".join("x" + k for k in keys[1]) + ">",
        2: "<2|/>",
    }
    assert got == {s: hashlib.sha256(text.encode()).hexdigest() for s, text in want.items()}


def test_digest_ordinal_ranks_in_byte_order(spark):
    ids = [("g", kind + ":sha256:" + hashlib.sha256(str(n).encode()).hexdigest()) for n in range(500) for kind in ("a-page", "a", "b")]
    frame = spark.createDataFrame(ids, "g string, i string").repartition(7)
    got = {r.i: r.ord for r in ordered.digest_ordinal(frame, ["g"], "i").collect()}
    assert [got[i] for i in sorted(i for _, i in ids)] == list(range(1, 1501))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    from sealwright.functions.joins import spread_join

    left = spark.range(200).selectExpr("if(id % 3 = 0, id % 9, 1) as k", "id")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (7, "c")], "k long, v string")
    plain = sorted(map(tuple, left.join(right, ["k"], how).collect()))
    assert sorted(map(tuple, spread_join(left, right, ["k"], "id", how, buckets=5).collect())) == plain


def test_previous_rows_over_any_ranges(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(s, rng.randrange(10**12), f"{s}{i}") for s in "aabbbbbbbbbbbc" for i in range(rng.randrange(40))] + [("d", 1, "x"), ("d", 1, "y")]
    table = spark.createDataFrame(rows, "s string, at long, note string")
    for parts in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = ordered.with_previous(table, "s", ["at"], ["at", "note"]).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        want, last = [], None
        for s, at, note in sorted(rows):
            want.append((s, at, note, (last[1], last[2]) if last and last[0] == s else None))
            last = (s, at, note)
        assert sorted((r.s, r.at, r.note, tuple(r._prev) if r._prev else None) for r in got) == sorted(want, key=lambda w: w[:3])
    assert ordered.with_previous(table.where(F.lit(False)), "s", ["at"], ["at"]).collect() == []


def test_counted_join_spreads_and_keeps_rows(spark):
    from sealwright.functions.joins import counted_join

    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2), ("none", 3)], "k string, v long")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c"), (None, "n")], "k string, w string")
    for how in ("inner", "left"):
        got = sorted(map(str, counted_join(left, right, ["k"], ["v"], how, most=20).collect()))
        assert got == sorted(map(str, left.join(right, ["k"], how).collect()))
