from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from sealwright.llm import signatures

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow(docs, items, top=50):
    bags = [(k, Counter(TERM.findall((t or "").translate(LOW)))) for k, t in docs]
    bags = [(k, c) for k, c in bags if c]
    n_docs, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(LOW))) if df[t]}
        scored = []
        for k, c in bags:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items())
            if score > 0:
                scored.append((-score, k is None, k or 0))
        out += [(item, r + 1, None if null else k, -s) for r, (s, null, k) in enumerate(sorted(scored)[:top])]
    return out


def order(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, docs, items, top=50):
    left = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, query long, score string").repartition(4)
    right = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in signatures.search(left, right, top=top).collect()]
    assert sorted(got, key=order) == sorted(slow(docs, items, top), key=order)
    return got


def made(rng, n):
    pool = [f"w{i}" for i in range(300)] + ["é", "ñu", "x9"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i if i % 17 else None, " ".join(rng.choices(pool, weights, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, "W1-w1 " * 9000), (903, "w2" * 400), docs[7], docs[7], (7, docs[7][1])]


def test_made_texts(spark, monkeypatch):
    monkeypatch.setattr(signatures, "DOCUMENTS", 70)
    rng = random.Random(5)
    docs = made(rng, 400)
    items = [(i, " ".join(t.upper() for t in (docs[rng.randrange(400)][1] or "none").split()[:25])) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unknown words"), (None, "w1 w2"), (3, "w3 w3 w3"), (3, "w4")]
    assert len(check(spark, docs, items)) > 300
    check(spark, docs, items, top=3)


def test_ties_go_to_the_smaller_ids(spark):
    docs = [(i, "same words here" if i % 2 else f"other {i}") for i in range(300)] + [(None, "same words here")]
    check(spark, docs, [(1, "same"), (2, "words here"), (3, "other")], top=10)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(signatures, "QUERIES", 2)
    monkeypatch.setattr(signatures, "QUERY_TERMS", 5)
    docs = made(random.Random(6), 60)
    check(spark, docs, [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(5)], top=7)


def test_empty_sides(spark):
    assert check(spark, [], [(1, "a")]) == [] and check(spark, [(1, "a")], []) == []
    assert check(spark, [(1, None), (2, "!")], [(1, "a")]) == []


def test_bounds_are_never_below_scores():
    rng = random.Random(8)
    texts = [t for _, t in made(rng, 120) if t and TERM.search(t)]
    block = signatures._Block(12)
    block.room = len(texts)
    bags = [Counter(signatures.terms(t)) for t in texts]
    for k, c in enumerate(bags):
        often = np.searchsorted(signatures.STEPS, np.array(list(c.values())), "right")
        block.add(k, 0, sum(c.values()), *signatures.entries(signatures._hash(list(c)), often))
    row = block.row()
    words = sorted({t for c in bags for t in c})
    asked = [np.array(sorted(rng.sample(range(len(words)), 20))) for _ in range(10)]
    queries = signatures.Queries(list(range(10)), words, asked, [np.arange(1, 21) * 100] * 10, len(texts), sum(sum(c.values()) for c in bags))
    sizes = np.array([sum(c.values()) for c in bags])
    upper = signatures.bounds(queries, signatures._hash(words), row["slots"], row["slices"], sizes)
    m = queries.middle(sizes)
    tight = 0
    for q, own in enumerate(asked):
        for d, c in enumerate(bags):
            score = sum(w * int(10**9 * c[words[t]] // (1000 * c[words[t]] + 20 * m[d])) for t, w in zip(own, queries.weights[q]) if c[words[t]])
            assert upper[q, d] >= score
            tight += upper[q, d] <= 1.05 * score + 1
    assert tight > 0.9 * upper.size


def test_given_texts(spark, sf):
    docs, items = (pq.read_table(f"{sf}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    got = [tuple(r) for r in signatures.query(spark, sf).collect()]
    assert sorted(got) == sorted(slow(list(zip(docs["doc_id"], docs["text"])), list(zip(items["item_id"], items["text"]))))
