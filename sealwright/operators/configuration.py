"""Layered configuration: resolution, overrides, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import json_walk, paths, pointers
from .findings import faults, finding, union

OVERRIDES = 2
EMPTY = "{}"


def config_layer_resolve(config_leaf: DataFrame) -> DataFrame:
    """``(project_id, pointer, value_json, layer)`` of the leaves that stay visible.

    Layers: 0 defaults, 1 controlled, 2 overrides.  A higher leaf replaces lower
    leaves at its pointer, below it (a scalar or array over an object) and above
    it (an object over a scalar).  An empty object of a merging layer replaces a
    scalar but keeps the members other layers have below it.  Ancestors are met
    by equi joins on exploded pointer prefixes.
    """
    key = ["project_id", "pointer"]
    own = config_leaf.groupBy(*key).agg(F.max(F.struct("layer", "value_json")).alias("_top")).select(
        *key, "_top.layer", "_top.value_json"
    )
    # an empty object that only merges hides nothing below its pointer
    merging = (F.col("layer") < OVERRIDES) & (F.col("value_json") == EMPTY)
    roofs = config_leaf.filter(~merging).groupBy(*key).agg(F.max("layer").alias("_roof"))
    above = (
        own.select(*key, "layer", F.explode(pointers.proper_prefixes(F.col("pointer"))).alias("_prefix"))
        .join(roofs.withColumnRenamed("pointer", "_prefix"), ["project_id", "_prefix"])
        .filter(F.col("_roof") > F.col("layer"))
        .select(*key)
        .distinct()
    )
    below = (
        config_leaf.select("project_id", "layer", F.explode(pointers.proper_prefixes(F.col("pointer"))).alias("pointer"))
        .groupBy(*key)
        .agg(F.max("layer").alias("_deep"))
    )
    joined = own.join(above, key, "left_anti").join(below, key, "left")
    hidden = F.coalesce(F.col("_deep") > F.col("layer"), F.lit(False)) | (merging & F.col("_deep").isNotNull())
    return joined.filter(~hidden).select(*key, "value_json", "layer")


def override_overlap_audit(config_override: DataFrame, config_leaf: DataFrame) -> DataFrame:
    """Malformed, repeated and overlapping override pointers, and parents that are no object.

    ``config_leaf`` are the leaves the overrides apply to.
    """
    pointer = F.col("pointer")
    malformed = config_override.filter(pointers.is_malformed(pointer))
    sound = config_override.filter(~pointers.is_malformed(pointer))
    key = ["project_id", "pointer"]
    counted = sound.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    prefixes = counted.select(*key, F.explode(pointers.proper_prefixes(pointer)).alias("_prefix"))
    overlap = prefixes.join(
        counted.select("project_id", F.col("pointer").alias("_prefix")), ["project_id", "_prefix"], "left_semi"
    )
    # a proper prefix of a leaf is an object, and so is an empty object itself
    objects = (
        config_leaf.select("project_id", F.explode(pointers.proper_prefixes(pointer)).alias("_prefix"))
        .unionByName(config_leaf.filter(F.col("value_json") == EMPTY).select("project_id", pointer.alias("_prefix")))
        .distinct()
    )
    orphan = prefixes.join(objects, ["project_id", "_prefix"], "left_anti").select(*key).distinct()
    return union(
        finding(malformed, "project_id", 0, "configuration.invalid_pointer", pointer),
        finding(counted.filter("_n > 1"), "project_id", 0, "configuration.duplicate_pointer", pointer, F.col("_n")),
        finding(overlap, "project_id", 0, "configuration.overlapping_pointer", pointer, F.col("_prefix")),
        finding(orphan, "project_id", 0, "configuration.invalid_pointer_target", pointer),
    )


def identity_rules(at: str = "", prefix: str = "", namespace: str = c.DEFAULT_NAMESPACE) -> list[json_walk.Rule]:
    """Rules of a configuration identity that stands at the path ``at``; details begin with ``prefix``."""
    rule = json_walk.Rule
    text, members = ("string",), f"{prefix}members"

    def closed(path: str, *names: str) -> json_walk.Rule:
        return rule(f"{at}{path}", ("object",), members, members=names)

    def digest(path: str) -> json_walk.Rule:
        return rule(f"{at}{path}/sha256", text, f"{prefix}digest", pattern=c.HEX64)

    return [
        closed("", "controlled_input", "defaults", "overrides", "resolved", "schema"),
        closed("/controlled_input", "path", "sha256", "size"),
        closed("/defaults", "id", "sha256"),
        closed("/resolved", "sha256"),
        closed("/schema", "id", "sha256"),
        rule(f"{at}/overrides", ("array",), members),
        closed("/overrides/[]", "pointer", "value"),
        *[digest(f"/{name}") for name in ("controlled_input", "defaults", "resolved", "schema")],
        rule(f"{at}/controlled_input/path", text, f"{prefix}path"),
        rule(f"{at}/controlled_input/size", text, f"{prefix}size", pattern=c.SIZE),
        rule(f"{at}/defaults/id", text, f"{prefix}defaults", pattern=r"(?s)\A.+\z"),
        rule(f"{at}/schema/id", text, f"{prefix}schema", allowed=(c.schema_id("config.v1", namespace),)),
        rule(f"{at}/overrides/[]/pointer", text, f"{prefix}pointer"),
    ]


def is_unsafe(at: str = "") -> Column:
    """Numbers within override values that are no integers, or beyond the range that every reader keeps."""
    inside = F.col("path").startswith(f"{at}/overrides/[]/value")
    size = F.abs(F.col("value").try_cast("decimal(38,0)"))
    return inside & ((F.col("type") == "number") | ((F.col("type") == "integer") & ~F.coalesce(size <= c.SAFE_INTEGER, F.lit(False))))


def unsafe_values(nodes: DataFrame, at: str = "") -> DataFrame:
    return nodes.filter(is_unsafe(at))


def pointer_rules(listed: Column, prefix: str = "") -> list[tuple[Column, str, str]]:
    """Faults of a list of override pointers.

    Sorted pointers put an ancestor next to or before its descendants, but not
    always adjacent, so each pointer looks its own prefixes up in the array.
    """
    overlap = F.exists(
        listed,
        lambda pointer: F.exists(pointers.proper_prefixes(pointer), lambda prefix: F.array_contains(listed, prefix)),
    )
    code = "run_report.invalid_shape"
    return [
        (F.exists(listed, pointers.is_malformed), code, f"{prefix}pointer"),
        (~json_walk.ascending(listed), code, f"{prefix}pointer order"),
        (overlap, code, f"{prefix}pointer overlap"),
    ]


def configuration_identity_audit(
    identity: DataFrame, scope: str, json: str, namespace: str = c.DEFAULT_NAMESPACE
) -> DataFrame:
    """Shape, digests and override order of configuration identity records, strictly read.

    A text that is no JSON, a repeated member, an unknown or missing member at any level, a value of another
    type, a number beyond the safe range inside an override are findings like those of digests and pointers. A record
    whose outer members are not the exact ones has that finding only.
    """
    nodes = json_walk.walk(json_walk.dealt(identity.select(scope, json)), [scope], json)
    code = "run_report.invalid_shape"
    bad = json_walk.broken(nodes, identity_rules(namespace=namespace), code)
    outer = bad.filter("at = ''").select("doc").distinct()
    path = (F.col("path") == "/controlled_input/path") & (F.col("type") == "string")
    # a path that is absent has been told as a missing member
    listed = json_walk.lists(nodes, [scope], pointers="/overrides/[]/pointer")
    inner = union(
        finding(nodes.filter(path & paths.breaks_profile(F.col("value"))), "doc", 70, "path.invalid", None, F.col("value")),
        finding(unsafe_values(nodes), "doc", 70, code, None, "override value"),
        finding(nodes.filter("repeated"), "doc", 70, code, None, "repeated member"),
        finding(bad.filter("at <> ''"), "doc", 70, F.col("code"), None, F.col("detail")),
        faults(listed, "doc", 70, None, *pointer_rules(F.col("pointers"))),
    )
    inner = inner.withColumn("doc", F.col("scope_id").cast("long")).join(outer, "doc", "left_anti")
    outer_bad = bad.filter("at = ''")
    invalid = nodes.filter(F.col("type") == json_walk.INVALID)
    owners = nodes.filter("at = ''").select("doc", F.col(scope).cast("string").alias("_owner"))
    told = union(
        inner.drop("scope_id"),
        finding(outer_bad, "doc", 70, F.col("code"), None, F.col("detail")).withColumn("doc", F.col("scope_id").cast("long")).drop("scope_id"),
    ).distinct()
    told = told.join(invalid.select("doc"), "doc", "left_anti").join(owners, "doc")
    return union(
        told.select(F.col("_owner").alias("scope_id"), "check_rank", "code", "path", "detail"),
        finding(invalid, scope, 70, code, None, "members"),
    )
