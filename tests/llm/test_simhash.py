from __future__ import annotations

import random

import numpy as np
import xxhash

from sealwright.llm import simhash


def slow_fingerprint(text):
    if text is None:
        return 0
    for upper in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        text = text.replace(upper, upper.lower())
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, budget=2):
    least = list(range(len(prints)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((top(i), top(j)))
                least[b] = a
    groups = {}
    for i, at in enumerate(ids):
        groups.setdefault(top(i), []).append(at)
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprint_by_definition():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "Two words", "ÄÖ Äö x y \x1cz", "a a a a a a"]
    texts += [" ".join(rng.choice(["The", "cat", "SAT", "é", "on", "x" * 300]) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    for text in texts:
        assert simhash.fingerprint(text and text.encode()) == slow_fingerprint(text)


def test_trie_links_are_all_close_pairs_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [x ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for x in base for a, b in rng.integers(0, 64, (12, 2))]
    values = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
    got = [(i, j) for a, b in simhash.trie_links(values, values, True, 0, 0, 2) for i, j in zip(a.tolist(), b.tolist())]
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += texts[:30] + [t + " end" for t in texts[30:60]] + [None, "", None]
    ids = list(range(1000, 1000 + len(texts) - 3)) + [7, None, 7]
    rows = list(zip(ids, texts, ["fp"] * len(ids), range(len(ids))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [slow_fingerprint(t) for t in texts]
    want = zip(ids, prints, slow_components(ids, prints))
    assert got == sorted((i or -1, f"{p:016x}", c) for i, p, c in want)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(ids, prints)))


def test_wide_pairs_go_deeper(spark):
    rng = np.random.default_rng(4)
    flips = [np.left_shift(np.int64(1), rng.integers(48, 63, 120)) for _ in range(2)]
    near = np.unique(np.int64(5 << 20) ^ flips[0] ^ flips[1])
    values = [int(x) for x in near] + [int(x) for x in rng.integers(-(2**63), 2**63, 100)]
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    ways = []
    for most in (1 << 20, 60):
        found = simhash.trie_join(frame, pair_rows=most)
        from sealwright.llm import common

        ways.append(sorted(map(tuple, common.connected_components(found).collect())))
    assert ways[0] == ways[1]
    prints = [v & (2**64 - 1) for v in values]
    linked = slow_components(values, prints)
    want = {v: c for v, c in zip(values, linked) if linked.count(c) > 1}
    assert dict(ways[0]) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []
