"""Symbol index XML and tag XML as entity and target tables.

Schemas are explicit: inference would turn a single member into a struct and
line numbers into integers, while ids commit their decimal text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import faults

_LOCATION = "location struct<_file:string,_line:string,_column:string>"
COMPOUND_TYPE = (
    f"_id string,_kind string,compoundname string,qualifiedname string,{_LOCATION},"
    "sectiondef array<struct<memberdef:array<struct<_id:string,_kind:string,name:string,argsstring:string,"
    "qualifiedname:string,location:struct<_file:string,_line:string,_column:string>>>>>"
)
TAG_TYPE = (
    "_kind string,name string,filename string,"
    "member array<struct<_kind:string,name:string,anchorfile:string,anchor:string,arglist:string>>"
)


def load_compounds(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``compounddef`` element of the XML files at ``path``."""
    frame = spark.read.format("xml").option("rowTag", "compounddef").schema(COMPOUND_TYPE).load(path)
    return frame.select(F.struct(*frame.columns).alias("c"))


def load_tags(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.format("xml").option("rowTag", "compound").schema(TAG_TYPE).load(path)
    return frame.select(F.struct(*frame.columns).alias("c"))


def parse_compounds(xml: DataFrame, column: str = "xml") -> DataFrame:
    """``(snapshot_id, xml)`` with one element per row, as the loader's shape."""
    return xml.select("snapshot_id", F.from_xml(F.col(column), COMPOUND_TYPE).alias("c"))


def parse_tags(xml: DataFrame, column: str = "xml") -> DataFrame:
    return xml.select("snapshot_id", F.from_xml(F.col(column), TAG_TYPE).alias("c"))


def _text(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def read_symbol_entities(compounds: DataFrame) -> DataFrame:
    """Compounds and members with a location; folders and unplaced entities drop out.

    The qualified name falls back to the member's, then to the compound's name.
    """
    name = _text(F.col("c.compoundname"))
    none = F.lit(None).cast("string")
    own = F.struct(
        F.col("c._id").alias("refid"), F.col("c._kind").alias("kind"), F.col("c.qualifiedname").alias("qualified"),
        F.col("c.location").alias("location"), none.alias("member_name"), none.alias("args"),
    )
    members = F.transform(
        F.flatten(F.transform(F.coalesce("c.sectiondef", F.array()), lambda s: F.coalesce(s["memberdef"], F.array()))),
        lambda m: F.struct(
            m["_id"].alias("refid"), m["_kind"].alias("kind"), m["qualifiedname"].alias("qualified"),
            m["location"].alias("location"), _text(m["name"]).alias("member_name"), _text(m["argsstring"]).alias("args"),
        ),
    )
    rows = compounds.select("snapshot_id", name.alias("compound_name"), F.explode(F.concat(F.array(own), members)).alias("e"))
    qualified = F.when(_text(F.col("e.qualified")) != "", _text(F.col("e.qualified"))).otherwise(
        F.coalesce("e.member_name", "compound_name")
    )
    placed = F.coalesce(F.col("e.location._file"), F.lit("")) != ""
    return rows.filter((F.col("e.kind") != "dir") & placed).select(
        "snapshot_id", "e.refid", "e.kind", qualified.alias("qualified_name"), F.col("e.location._file").alias("source_path"),
        F.col("e.location._line").alias("line"), F.col("e.location._column").alias("column"), "compound_name", "e.member_name", "e.args",
    )


def detail_refids(compounds: DataFrame) -> DataFrame:
    members = F.flatten(F.transform(F.coalesce("c.sectiondef", F.array()), lambda s: F.coalesce(s["memberdef"], F.array())))
    found = F.concat(F.array("c._id"), F.transform(members, lambda m: m["_id"]))
    return compounds.select("snapshot_id", F.explode(found).alias("refid"))


def _tag_members(tags: DataFrame) -> DataFrame:
    return tags.select("snapshot_id", _text(F.col("c.name")).alias("compound_name"), F.explode("c.member").alias("m"))


def read_symbol_targets(tags: DataFrame) -> DataFrame:
    """Explicit HTML targets of compounds and members."""
    none = F.lit(None).cast("string")
    compounds = tags.filter((_text(F.col("c.name")) != "") & (_text(F.col("c.filename")) != "")).select(
        "snapshot_id", _text(F.col("c.name")).alias("compound_name"), F.coalesce("c._kind", F.lit("")).alias("kind"),
        none.alias("member_name"), none.alias("args"),
        F.concat(F.lit("html/"), _text(F.col("c.filename"))).alias("html_path"), F.lit("").alias("anchor"),
    )
    complete = (_text(F.col("m.anchorfile")) != "") & (_text(F.col("m.anchor")) != "") & (_text(F.col("m.name")) != "")
    members = _tag_members(tags).filter(complete).select(
        "snapshot_id", "compound_name", F.coalesce("m._kind", F.lit("")).alias("kind"), _text(F.col("m.name")).alias("member_name"),
        _text(F.col("m.arglist")).alias("args"), F.concat(F.lit("html/"), _text(F.col("m.anchorfile"))).alias("html_path"),
        _text(F.col("m.anchor")).alias("anchor"),
    )
    return compounds.unionByName(members)


def incomplete_targets(tags: DataFrame) -> DataFrame:
    """Tag members without anchor file, anchor or name."""
    code = "doxygen.output_malformed"
    return faults(
        _tag_members(tags), "snapshot_id", 0, F.col("compound_name"),
        (_text(F.col("m.anchorfile")) == "", code, "anchorfile"),
        (_text(F.col("m.anchor")) == "", code, "anchor"),
        (_text(F.col("m.name")) == "", code, "name"),
    )
