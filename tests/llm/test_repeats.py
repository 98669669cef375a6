from __future__ import annotations

import hashlib
import random

import numpy as np

from sealwright.llm import repeats


def slow(rows):
    """rows: (doc_id, bytes); result by definition."""
    least = {}
    for i, text in rows:
        if i is not None:
            for a in range(len(text) - 49):
                w = text[a : a + 50]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, text in rows:
        gone = [False] * len(text)
        for a in range(len(text) - 49):
            if i is not None and least[text[a : a + 50]] < i:
                gone[a : a + 50] = [True] * 50
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i if i is not None else -1, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    words = ["the", "and", "ing", "tion", "ou", "é", "Straße", "in", "of\n", "er,"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(14), make(30), make(80)]
    rows = []
    for i in range(150):
        text = make(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            text = text + rng.choice(passages)[rng.randrange(0, 20) :] + make(rng.randrange(0, 9))
        rows.append((rng.randrange(0, 120), text))
    rows += [(200 + i, rows[i][1]) for i in range(12)] + [(i, "a" * n) for i, n in ((1, 49), (2, 50), (3, 51), (4, 500))]
    rows += [(5, "ab" * 100), (6, "x" + "ab" * 60), (None, rows[0][1]), (None, passages[2]), (7, None), (8, ""), (9, passages[2]), (9, passages[2])]
    return rows


def test_window_grams_cross_segments(monkeypatch):
    data = np.frombuffer(random.Random(2).randbytes(5000), np.uint8) % 3
    whole = repeats.window_grams(data)
    all_ = repeats.suffixes(data, np.array([0, 10, 10, 700, 3000, 5000]))
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    assert np.array_equal(repeats.window_grams(data), whole)
    for a, b in zip(repeats.suffixes(data, np.array([0, 10, 10, 700, 3000, 5000])), all_):
        assert np.array_equal(a, b)
    begins = np.arange(len(whole))
    assert ((whole >= begins) & (whole <= begins + repeats.REACH)).all()


def test_against_all_windows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "tag") for i, t in rows], "doc_id long, text string, tag string")
    got = [(r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in repeats.dedup(docs, group=1 << 10).collect()]
    want = slow([(i, (t or "").encode()) for i, t in rows])
    assert sorted(got) == want
    assert sum(r[2] for r in want) > 5000
    kept = [r.kept for r in repeats.dedup(docs, with_text=True).collect()]
    assert sorted(hashlib.sha256(k).hexdigest() for k in kept) == sorted(r[4] for r in want)


def test_empty_table(spark):
    assert repeats.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
