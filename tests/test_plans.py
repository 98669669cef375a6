"""Levels and outcomes of plans of any shape, against plain recursion; deep chains in few rounds."""

from __future__ import annotations

import random

from sealwright.operators import stages


def slow(nodes, deps):
    """(level, status) of each stage; level None on a cycle or behind an unknown name."""
    # a stage on a cycle, or behind one, is never placed; repeat until nothing changes
    placed, changed = {}, True
    while changed:
        changed = False
        for key in nodes:
            if key not in placed and all((key[0], d) in placed for d in deps.get(key, ())):
                placed[key] = 1 + max((placed[key[0], d] for d in deps.get(key, ())), default=-1)
                changed = True
    status = {}
    for key in sorted(placed, key=placed.get):
        policy, own, fault = nodes[key]
        if fault:
            status[key] = "blocked" if policy == "required" else "skipped"
        elif any(status[key[0], d] != "succeeded" for d in deps.get(key, ())):
            status[key] = "blocked"
        else:
            status[key] = "degraded" if own == "failed" and policy != "required" else own
    return placed, status


def plan(rng, run, shape, n):
    names = [f"s{i}" for i in range(n)]
    nodes, deps = {}, {}
    for i, name in enumerate(names):
        nodes[run, name] = (rng.choice(["required", "optional"]), "succeeded" if rng.random() < 0.9 else "failed", rng.random() < 0.03)
        if shape == "chain" and i:
            deps[run, name] = {names[i - 1]}
        elif shape == "ladder" and i > 1:
            deps[run, name] = {names[i - 1], names[i - 2]}
        elif shape == "star" and i:
            deps[run, name] = {names[0]}
        elif shape == "dag" and i:
            deps[run, name] = set(rng.sample(names[:i], min(i, rng.choice([0, 1, 1, 1, 2, 3]))))
        elif shape == "ring":
            deps[run, name] = {names[(i + 1) % n]} if i < n - 2 else ({names[0], "gone"} if i == n - 1 else {names[0]})
        elif shape == "lost" and i:
            deps[run, name] = {"unknown"} if i == 2 else {names[i - 1]}
    return nodes, deps


def tables(spark, nodes, deps):
    rows = [(r, s, p, o, f) for (r, s), (p, o, f) in nodes.items()]
    edges = [(r, s, d) for (r, s), ds in deps.items() for d in ds] + [(r, s, d) for (r, s) in nodes for d in ("snapshot", None) if s == "s0"]
    return spark.createDataFrame(rows, "run_id string, stage string, policy string, own_status string, static_fault boolean"), spark.createDataFrame(edges, "run_id string, stage string, dependency string")


def test_plans_of_every_shape(spark):
    rng = random.Random(7)
    nodes, deps = {}, {}
    for k, shape in enumerate(["chain", "ladder", "star", "dag", "dag", "dag", "ring", "lost"]):
        n, d = plan(rng, f"r{k}", shape, rng.choice([5, 9, 14]))
        nodes, deps = nodes | n, deps | d
    placed, status = slow(nodes, deps)
    stage, dep = tables(spark, nodes, deps)
    levels = stages.stage_levels(stage, dep).collect()
    assert {(r.run_id, r.stage): r.level for r in levels} == {key: placed.get(key) for key in nodes}
    outcome = stages.stage_outcomes(stage, dep)
    assert {(r.run_id, r.stage): r.status for r in outcome.collect()} == status
    assert {(r.scope_id, r.path) for r in stages.level_findings(stages.stage_levels(stage, dep)).collect()} == set(nodes) - set(placed)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    nodes = {("r", f"s{i}"): ("required", "succeeded" if i != 300 else "failed", False) for i in range(500)}
    deps = {("r", f"s{i}"): {f"s{i - 1}"} for i in range(1, 500)}
    stage, dep = tables(spark, nodes, deps)
    calls, keep = [], stages.stored
    monkeypatch.setattr(stages, "stored", lambda df, label="table": calls.append(label) or keep(df, label))
    got = {r.stage: r.level for r in stages.stage_levels(stage, dep).collect()}
    assert got == {f"s{i}": i for i in range(500)} and len(calls) < 40
    status = {r.stage: r.status for r in stages.stage_outcomes(stage, dep).collect()}
    assert status == {f"s{i}": "succeeded" if i < 300 else "failed" if i == 300 else "blocked" for i in range(500)}


def test_large_runs_are_placed_like_small_ones(spark, monkeypatch):
    """A run beyond the bound of a task goes the way of rounds, and comes out the same; null keys are met by nothing."""
    chain = [("big", f"s{n}", f"s{n - 1}") for n in range(1, 9)]
    fork = [("small", "d", "b"), ("small", "d", "c"), ("small", "b", "a"), ("small", "c", "a"), ("small", "x", "y"), ("small", "y", "x"), ("small", "z", "gone")]
    dep = spark.createDataFrame([*chain, *fork, (None, "a", "b"), ("small", "a", "snapshot")], "run_id string, stage string, dependency string")
    names = [("big", f"s{n}") for n in range(9)] + [("small", n) for n in "abcdxyz"]
    rows = [(run, name, "required", "failed" if name in ("s2", "b") else "succeeded", name == "c") for run, name in names]
    stage = spark.createDataFrame([*rows, (None, "a", "required", "succeeded", False)], "run_id string, stage string, policy string, own_status string, static_fault boolean")
    got = []
    for most in (1000, 14, 0):
        monkeypatch.setattr(stages, "RUN_ROWS", most)
        levels = sorted(((r.run_id, r.stage, r.level) for r in stages.stage_levels(stage, dep).collect()), key=str)
        got.append((levels, sorted((r.run_id, r.stage, r.status) for r in stages.stage_outcomes(stage, dep).collect())))
    assert got[0] == got[1] == got[2]
    placed = {(run, name): level for run, name, level in got[0][0]}
    assert placed["big", "s8"] == 8 and placed["small", "d"] == 2 and placed["small", "z"] is None and placed[None, "a"] is None
    status = {(run, name): state for run, name, state in got[0][1]}
    assert (status["big", "s1"], status["big", "s2"], status["big", "s8"]) == ("succeeded", "failed", "blocked")
    assert (status["small", "b"], status["small", "c"], status["small", "d"]) == ("failed", "blocked", "blocked") and ("small", "x") not in status


def test_a_run_is_placed_without_stored_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(stages, "levels_in_rounds", lambda *tables: calls.append(tables))
    dep = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b")], "run_id string, stage string, dependency string")
    stage = spark.createDataFrame([("r", n) for n in "abc"], "run_id string, stage string")
    assert {r.stage: r.level for r in stages.stage_levels(stage, dep).collect()} == {"a": 0, "b": 1, "c": 2} and not calls
