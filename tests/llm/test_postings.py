from __future__ import annotations

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from sealwright.llm import postings

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("null" if item is None else str(item))
    out = []
    for key, text in docs:
        w, hit, held = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    held |= windows[tuple(w[p : p + n])]
        ids = ",".join(sorted(held))
        out.append((key, len(w), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def key(row):
    return (row[0] is None, *[x or 0 for x in row[:4]], row[4])


def check(spark, docs, items):
    left = spark.createDataFrame([(k, t, k, 1, 2) for k, t in docs], "doc_id long, text string, rid long, term int, pos int")
    right = spark.createDataFrame([(k, t, k) for k, t in items], "item_id long, text string, wid long")
    got = [tuple(r) for r in postings.decontaminate(left, right).collect()]
    assert sorted(got, key=key) == sorted(slow(docs, items), key=key)
    return got


def test_made_texts(spark):
    rng = random.Random(3)
    pool = ["a", "the", "of", "é", "w1", "w2", "x9", "ñu", "zz", "q"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9, 10, 11, 30, 45])))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "?! --"), (None, "lone words of no id at all here in one row now"), (3, "The SAME id  again, and again; in the third (3) row now"), (40, "a " * 60)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(200)))
        for _ in range(rng.randrange(4)):
            cut = (rng.choice(items)[1] or "").split()
            text += ".\n" + "-".join(cut[rng.randrange(3) :]).upper() + " "
        docs.append((i if i % 9 else None, text))
    docs += [(70, None), (71, ""), (72, "a" * 300), (73, "a\x00" * 3000), docs[5], docs[5], (74, "of the " * 500)]
    assert any(r[5] for r in check(spark, docs, items))


def test_empty_sides(spark):
    assert check(spark, [], [(1, "a b")]) == []
    assert check(spark, [(1, "a b"), (2, None)], []) and check(spark, [(1, "a b")], [(1, None)])
    assert check(spark, [], []) == []


def test_given_texts(spark, sf):
    docs, items = (pq.read_table(f"{sf}/{t}.parquet").to_pydict() for t in ("documents", "benchmark"))
    got = [tuple(r) for r in postings.query(spark, sf).collect()]
    want = slow(list(zip(docs["doc_id"], docs["text"])), list(zip(items["item_id"], items["text"])))
    assert sorted(got) == sorted(want) and any(r[5] for r in got) and not all(r[5] for r in got)


@pytest.mark.parametrize("reach", [2, 7])
def test_near(spark, reach):
    rng = random.Random(reach)
    pool = [f"w{i}" for i in range(9)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(60))) for i in range(20)] + [(90, "w1 w2 w3")]
    items = [(i, " ".join(rng.sample(pool, 3))) for i in range(6)] + [(9, "w1 w1"), (10, "w3 w2 w1"), (11, "none here")]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    _, windows = postings.test_windows(right)
    vocabulary = postings.test_vocabulary(windows)
    table = postings.index(left, vocabulary)
    ranked = postings.ranked_terms(table, windows, vocabulary)
    grams = {r.wid: r.gram for r in windows.collect()}
    terms = {r.term: r.word for r in vocabulary.collect()}
    ids = {r.rid: r.key for r in postings.documents(table).collect()}
    got = {(tuple(grams[r.wid]), ids[r.rid], r.pos) for r in postings.near(table, ranked, reach).collect()}
    want = set()
    for r in ranked.collect():
        gram, pivot = grams[r.wid], terms[r.lists[0].term]
        for key, text in docs:
            w = text.split()
            want |= {(tuple(gram), key, p) for p in range(len(w)) if w[p] == pivot and set(gram) <= set(w[max(0, p - reach) : p + reach + 1])}
    assert got == want and got


def test_no_python_on_the_path(spark, sf):
    plan = postings.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
