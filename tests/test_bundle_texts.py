"""The whole-bundle query reaches the checks of texts that ``verify_bundles`` is not given."""

from __future__ import annotations

from sealwright import catalog


def test_every_check_of_texts_finds_its_seeded_faults(spark):
    found = catalog.queries()["verify_bundle_texts"](spark, "/root/testdata/sf0.01")
    codes = {r.code for r in found.select("code").distinct().collect()}
    wanted = {"duplicate_member", "invalid_json", "invalid_shape", "unsupported_schema", "noncanonical"}
    assert {"run_report.invalid_shape", "checksums.noncanonical", *(f"manifest.{x}" for x in wanted)} <= codes
    assert found.where("check_rank = 60 and path is null").count() > 0
