from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from sealwright.llm import whitening


def slow(ids, vectors):
    """By plain integers: (id, n, deviation, whitened up to sign, explained) of each row, and the components."""
    rows = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in zip(ids, vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dim in sorted({len(x) for _, x in rows}):
        mine = [(i, x) for i, x in rows if len(x) == dim]
        n = len(mine)
        sums = [sum(x[k] for _, x in mine) for k in range(dim)]
        cov = np.array([[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in mine) / n**3 for b in range(dim)] for a in range(dim)])
        e, v = np.linalg.eigh(cov)
        for i, x in mine:
            centred = np.array([(n * c - s) / n for c, s in zip(x, sums)])
            dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            for k in range(min(8, dim)):
                top = e[-1 - k]
                spread = top > np.trace(cov) * dim * 2.3e-16
                out.append((i, k + 1, n, dev, abs(centred @ v[:, -1 - k]) / math.sqrt(top) if spread else 0.0, top / np.trace(cov) if spread else 0.0))
    return out


def same(got, want):
    got = sorted(((-1 if r[0] is None else r[0]), r[1], r[2], r[3], abs(r[4]), r[5]) for r in got)
    want = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-6, abs=1e-6)


def flat(frame):
    rows = frame.collect()
    assert all(r.identity_error <= 1e-4 for r in rows)
    return [(r.vec_id, k + 1, r.n, int(r.deviation), w, x) for r in rows for k, (w, x) in enumerate(zip(r.whitened, r.explained))]


@pytest.mark.parametrize("reach", [1, 3, 700, 1 << 21, 1 << 39])
def test_planes_give_the_exact_products(reach):
    rng = np.random.default_rng(reach)
    x = rng.integers(-reach, reach, size=(131, 5))
    x[:, 3] = reach
    sums, products = whitening.scatter(x)
    exact = [[int(v) for v in row] for row in x.T]
    assert list(sums) == [sum(c) for c in exact]
    assert products.tolist() == [[sum(a * b for a, b in zip(c, d)) for d in exact] for c in exact]


def test_made_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    vectors = [list(map(float, v)) for v in base]
    vectors += [vectors[0]] * 5 + [None, [], [1.0, None] * 6, [float("nan")] * 12, [float("inf")] * 12]
    vectors += [[float(a), float(a * a)] for a in rng.normal(size=40)] + [[3.0]] + [[1.0, 2.0, 3.0]] * 4
    ids = list(range(len(vectors)))
    ids[1], ids[2] = None, 7
    table = spark.createDataFrame(list(zip(ids, vectors, ids, ids)), "vec_id long, embedding array<double>, n long, dim long").repartition(5)
    same(flat(whitening.whiten(table)), slow(ids, vectors))
    assert whitening.whiten(table.limit(0)).collect() == []


def test_sums_beyond_longs(spark):
    vectors = [[1e5 * i, -3e4 * i * i, 7.0 * i] for i in range(60)]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    same(flat(whitening.whiten(table)), slow(range(60), vectors))


def test_given_vectors(spark, sf):
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    got = whitening.query(spark, sf).collect()
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    same([tuple(r)[:6] for r in got], slow(table["vec_id"], table["embedding"]))
