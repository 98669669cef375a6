from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq

from sealwright.llm import pivots


def slow(ids, vectors, least=0.9):
    n = len(ids)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    linked = [[] for _ in range(n)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                linked[i].append(j)
                linked[j].append(i)
    seen = [None] * n
    for i in range(n):
        if seen[i] is None:
            stack, members = [i], []
            seen[i] = i
            while stack:
                k = stack.pop()
                members.append(k)
                for o in linked[k]:
                    if seen[o] is None:
                        seen[o] = i
                        stack.append(o)
            least_id = min((ids[m] for m in members if ids[m] is not None), default=None)
            for m in members:
                seen[m] = (least_id,)
    return [(ids[i], len(linked[i]), seen[i][0]) for i in range(n)]


def key(row):
    return tuple(-1 if x is None else x for x in row)


def test_small_cases_against_all_pairs(spark, monkeypatch):
    # with as many pivots as a prefix has, all vectors share their lists and nothing is missed
    monkeypatch.setattr(pivots, "BLOCK", 16)
    monkeypatch.setattr(pivots, "PIVOTS", 0)
    monkeypatch.setattr(pivots, "LEAST_PIVOTS", pivots.PREFIX)
    rng = np.random.default_rng(1)
    vectors = [list(map(float, v)) for v in rng.normal(size=(80, 8))]
    vectors += [list(map(float, np.array(vectors[i % 7]) + rng.normal(scale=0.1, size=8))) for i in range(60)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]], [1e30] * 8, [1e-30] * 8]
    vectors += [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [1.0, 0.0], [1.0, 0.1]]
    ids = list(range(10, 10 + len(vectors)))
    ids[3], ids[4] = None, 10
    table = spark.createDataFrame(list(zip(ids, vectors, ids)), "vec_id long, embedding array<double>, c long")
    got = pivots.near_duplicates(table).collect()
    want = slow(ids, vectors)
    assert sorted(key(r[:3]) for r in got) == sorted(map(key, want))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert pivots.near_duplicates(table.limit(0)).collect() == []


def test_recall_on_given_vectors(spark, sf):
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    want = slow(table["vec_id"], table["embedding"])
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()}
    assert len(got) == len(want) and all(got[i] <= n for i, n, _ in want)
    assert sum(got.values()) >= 0.9 * sum(n for _, n, _ in want)


def test_recall_of_planted_copies(spark):
    # the given tables hold no link at all, so recall is measured on copies at angles from 5 to 25 degrees
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    copies = []
    for k in range(900):
        own = base[k % 600]
        off = rng.normal(size=64)
        off -= off @ own * own
        angle = np.radians(rng.uniform(5, 25))
        copies.append(np.cos(angle) * own + np.sin(angle) * off / np.linalg.norm(off))
    vectors = np.concatenate([base, copies])
    near = vectors @ vectors.T >= 0.9
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(table).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert near.sum() > 1500 and sum(got.values()) >= 0.9 * near.sum()
