"""Graphs that are read once are derived, not stored, and their ids are made once for all conditions on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sealwright import catalog, session
from sealwright.functions import ids
from sealwright.plans.fixtures import Fixtures


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_read_the_column_that_is_there(spark):
    made = spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).alias("own"))
    bad = (F.substring("own", 1, 1) == "0") | (F.substring("own", 2, 1) == "1")
    assert _plan(made.where(bad)).count("sha2(") > 1 and _plan(session.settled(made).where(bad)).count("sha2(") == 1
    assert session.settled(made).columns == ["own"] and session.settled(made).count() == 10


@pytest.mark.parametrize("name", ["content_id_check", "edge_field_audit"])
def test_forged_graphs_are_not_stored(spark, monkeypatch, name):
    catalog.queries()
    kept = []
    monkeypatch.setattr(Fixtures, "_stored", lambda self, view: kept.append(view))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert kept == []


def test_many_escapes_with_letters_are_lowered(spark):
    text = "\x0b\x1f \\u001F \\\\\x0e\x1a\x1b"
    json = spark.range(1).select(ids.canonical({"v": F.lit(text)}).alias("j")).first().j
    assert json == '{"v":"\\u000b\\u001f \\\\u001F \\\\\\\\\\u000e\\u001a\\u001b"}'


def test_rare_escapes_do_not_fill_the_code_of_an_id(spark):
    plan = _plan(spark.range(1).select(ids.canonical({"v": F.col("id").cast("string")}).alias("j")))
    assert plan.count("regexp_replace(") == 1
