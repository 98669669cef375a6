from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from sealwright.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_targets(sizes):
    """Shares by weight, capped and shared again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if got[s] > 2 * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: 2.0 * sizes[s] for s in over}


def slow_seats(claims, seats):
    won = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max(claims, key=lambda c: (claims[c] / (2 * won[c] + 1), [-ord(x) for x in c]))
        won[best] += 1
    return won


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 40, None: 70, "z": 1}, {"a": 7}, {"a": 0, "b": 9}, {f"s{i:02}": 100 + 37 * i % 91 for i in range(20)}])
def test_targets_by_repeated_sharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(slow_targets(sizes))


@pytest.mark.parametrize(("claims", "seats"), [({"a": 53.0, "b": 24.0, "c": 23.0}, 7), ({"a": 1.0, "b": 1.0}, 1), ({"a": 900.0, "b": 1.0, "c": 1.0, "d": 0.0}, 40), ({f"{i:02}": 3.0 + i * i for i in range(30)}, 101)])
def test_seats_go_to_the_highest_quotients(spark, claims, seats):
    table = spark.createDataFrame([(k, v, 1) for k, v in claims.items()], "party string, claim double, one int")
    got = {r.party: r.won for r in mixing.apportion(table, ["one"], "claim", F.lit(seats), ["party"]).collect()}
    assert got == slow_seats(claims, seats)


def corpus():
    rows = []
    for i in range(400):
        n = (i * 37) % 90
        rows.append((i if i % 50 else None, " ".join(f"w{i}_{k}" for k in range(n)) + "\n" * (i % 3), [None, "b", "a", "c"][i % 4] if i % 3 else "hot"))
    return rows + [(7, None, "a"), (8, "", None), (9, "x " * 5000, "c"), rows[5], rows[5]]


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs.repartition(5)).collect()
    assert sorted(got, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    sizes, taken, target = {}, {}, {}
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    by_id = {}
    for i, t, s in rows:
        by_id.setdefault(i, s)
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = slow_targets(sizes)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        source = next(s for s, n in sizes.items() if n == r.source_size)
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    assert target == pytest.approx(want)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64, s


def test_applied_mix_holds_the_taken_words(spark):
    rows = [(i, t, s, "keep") for i, (_, t, s) in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rid string")
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    total, held = {}, {}
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        words = WORD.findall(r.text)
        assert r.rid == "keep" and words
        whole = WORD.findall(texts[r.doc_id])
        assert set(words) <= set(whole) and len(words) <= len(whole)
        held[r.doc_id] = held.get(r.doc_id, 0) + len(words)
        total[r.source] = total.get(r.source, 0) + len(words)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    for s, n in slow_targets(sizes).items():
        assert math.isclose(total[s], n, abs_tol=64)
    assert all(n <= 2 * len(WORD.findall(texts[i])) for i, n in held.items())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == [] and mixing.apply(empty).collect() == []
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0] and mixing.apply(blank).collect() == []


def test_main_path_runs_no_python(spark, sf):
    plan = mixing.query(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
