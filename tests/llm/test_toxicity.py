from __future__ import annotations

import math
import random

import pytest

from sealwright.llm import toxicity


def slow_segments(scores):
    """Maximal scoring segments by recursion on the best segment (first, then shortest)."""

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best is None:
            return []
        _, i, j = best
        return split(a, i) + [(i, j, best[0])] + split(j + 1, b)

    return split(0, len(scores))


def test_segments_are_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(300):
        other = -1
        scores = [rng.choice([other, other, other, 2, 3, -2, 5]) for _ in range(rng.randrange(0, 40))]
        # distinct sums keep ties out of the comparison
        scores = [s if s == other else s + rng.random() / 7 for s in scores]
        listed = [(i, s) for i, s in enumerate(scores) if s != other]
        got = toxicity.maximal_segments(listed, other)
        want = slow_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_scale_solves_its_equation():
    for scores in ([(3.0, 0.01), (1.5, 0.02)], [(8.0, 1e-3)]):
        root = toxicity._lambda(scores, -0.2)
        rest = 1 - sum(p for _, p in scores)
        assert root == 1.0 or sum(p * math.exp(root * s) for s, p in scores) + rest * math.exp(-0.2 * root) == pytest.approx(1, abs=1e-6)


def rows_of(seed=1, n=1200):
    rng = random.Random(seed)
    clean = [f"word{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rude = ["badone", "worse", "nasty", "rotlich", "rotschaft", "rotent", "rotheim"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 80))]
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(rude) for _ in range(8)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_calibrates(spark):
    rows, labels = rows_of()
    rows += [(5000, None), (5001, ""), (None, "badone worse nasty badone"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    told = spark.createDataFrame(labels + [(None, 1), (7, None), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, told).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert all(r.predicted == truth[r.doc_id] for r in held)
    empty = {r.score for r in got if r.doc_id in (5000, 5001)}
    assert len(empty) == 1 and empty.pop() < 0.3
    lexicon = toxicity.learn(docs, told)
    assert "badone" in lexicon.words and "rotl" in {s[:4] for s in lexicon.words} | set(lexicon.stems)
    found = {r.doc_id for r in toxicity.passages(docs, lexicon).collect()}
    assert {i for i, t in labels if t} <= found


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.predicted, 0 <= r.score <= 1) for r in toxicity.score(docs, none).collect()] == [(0, True)]
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_label_sample_is_bounded(spark):
    told = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    n = toxicity.labelled(told, (0, 1, 3), most=500).count()
    assert 300 < n < 700


def test_held_out_figures(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in truth]
    caught = sum(p and t for p, t in held)
    assert caught >= 0.9 * sum(t for _, t in held) and caught >= 0.9 * sum(p for p, _ in held)
