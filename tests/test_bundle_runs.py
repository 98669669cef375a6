"""Whole bundles take the reports of their own runs, and no others are made for them."""

from __future__ import annotations

from sealwright import catalog
from sealwright.catalog import stages as queries
from sealwright.operators import stages
from sealwright.plans.fixtures import Fixtures

FOLDER = "/root/testdata/sf0.001"


def test_reports_of_some_runs_are_those_of_all(spark):
    catalog.queries()
    v = Fixtures(spark, FOLDER)
    runs = v.bundle_run.select("run_id").distinct()
    every = {r.run_id: r.text for r in queries.whole_reports(v).collect()}
    some = {r.run_id: r.text for r in queries.whole_reports(v, runs).collect()}
    assert 0 < len(some) < len(every) and some == {r: every[r] for r in some} and set(some) == {r.run_id for r in runs.collect()}


def test_whole_bundles_make_only_their_reports(spark, monkeypatch):
    made = []
    report = stages.run_report
    monkeypatch.setattr(stages, "run_report", lambda run, *rest: made.append(run.count()) or report(run, *rest))
    catalog.queries()["verify_bundles"](spark, FOLDER)
    v = Fixtures(spark, FOLDER)
    assert made == [v.bundle_run.select("run_id").distinct().count()] and made[0] < v.run_head.count()
