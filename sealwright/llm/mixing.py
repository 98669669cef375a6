"""Operator 4, mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

All words of the mix are blocks of equal size. Blocks are seats: sources receive them by the highest
quotients ``target / (2 seats + 1)``, and the seats of a source go to its shards in the same way.
A shard then takes its quota of blocks in a seeded order, whole rounds first, so a document is
taken at most as often as the target's cap allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sealwright.llm import common

BLOCK, SEED = 64, 42
WEIGHTS, TOTAL, CAP = (3, 1, 2), 1.5, 2
MOST_SOURCES = 10_000
#: Two primes; a shard steps through its blocks by the first that does not divide their number.
_STEPS = (1_000_003, 998_244_353)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``total`` times all sizes.
    Targets stop at ``cap`` times the source's size; the rest is shared by weight among the others.
    The level of that sharing follows from one sorted pass: capped sources are those whose
    size per weight is least.
    """
    # one row for each source; the order of all sources is what the weights repeat over
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int")))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    ahead, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(total) * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("weight").over(after))
    # the first source below its cap sets the level of all that follow it, and is where it is highest
    level = level.withColumn("open", F.col("level") * F.col("weight") < cap * F.col("source_size"))
    held = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce(held * F.col("weight"), cap * F.col("source_size").cast("double")))
    return level.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], claim: str, seats: Column, order: list[str]) -> DataFrame:
    """``parties`` with ``won``: their part of ``seats`` (equal within a group) by the Sainte-Lague quotients of ``claim``.

    With n parties the threshold quotient lies between those that give all of ``seats - n / 2`` and
    ``seats + n / 2`` seats when every claim is rounded on its own, so only the seats between these
    two are ranked: about one for each party.
    """
    group = Window.partitionBy(*within)
    sized = parties.withColumns({"_n": F.count("*").over(group), "_all": F.sum(claim).over(group), "_seats": seats})

    def rounded(shift: float) -> Column:
        level = F.col("_seats") + shift * F.col("_n")
        share = F.floor(F.col(claim) / F.col("_all") * level + 0.5)
        return F.when((F.col("_all") > 0) & (level > 0), F.greatest(share, F.lit(0))).otherwise(0).cast("long")

    near = sized.withColumns({"_least": rounded(-0.5), "_most": rounded(0.5)})
    near = near.withColumns({"_least": F.greatest(F.col("_least") - 1, F.lit(0)), "_most": F.when(F.col("_all") > 0, F.col("_most") + 1).otherwise(0)})
    near = near.withColumn("_open", F.col("_seats") - F.sum("_least").over(group))
    seat = F.explode_outer(F.when(F.col("_most") > F.col("_least"), F.sequence("_least", F.col("_most") - 1)))
    bids = near.withColumn("_seat", seat).withColumn("_quotient", F.col(claim) / (2 * F.col("_seat") + 1))
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("_quotient"), *order, "_seat"))
    won = F.first("_least") + F.sum(((F.col("_rank") <= F.col("_open")) & F.col("_seat").isNotNull()).cast("long"))
    named = [F.first(c).alias(c) for c in parties.columns if c not in (*within, *order)]
    keys = list(dict.fromkeys([*within, *order]))
    return bids.withColumn("_rank", rank).groupBy(*keys).agg(*named, won.alias("won"))


def _ranges(start: Column, end: Column, block: int) -> Column:
    """Parts [lo, hi) of the words [start, end) that a shard takes beyond its whole rounds.

    The shard's full blocks are stepped through by an affine permutation with a seeded offset; its
    short last block comes after them. Blocks are taken in that order until ``rest`` words are.
    """
    full = F.floor(F.col("shard_size") / block)
    step = F.when(full % _STEPS[0] != 0, F.lit(_STEPS[0])).otherwise(F.lit(_STEPS[1]))
    offset = F.pmod(F.xxhash64(F.lit(SEED), "source", "shard"), F.greatest(full, F.lit(1)))

    def part(b: Column) -> Column:
        turn = F.when(b < full, F.pmod(b * step + offset, F.greatest(full, F.lit(1)))).otherwise(full)
        taken = F.least(F.lit(block), F.greatest(F.lit(0), F.col("rest") - turn * block))
        return F.struct(F.greatest(start, b * block).alias("lo"), F.least(end, b * block + taken).alias("hi"))

    ranges = F.transform(F.sequence(F.floor(start / block), F.floor((end - 1) / block)), part)
    return F.filter(ranges, lambda r: r["hi"] > r["lo"])


def plan(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, rid, size, source_size, target, rounds, ranges, taken) of ``sized(doc_id, rid, mixed, source, size)``.

    ``ranges`` are the words taken beyond ``rounds`` whole copies, counted in the document.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    told = common.stage(targets(sums), "targets").withColumn("shards", common.spread_count(F.col("source_size") / block))
    # one row for each source, counted before it is sent
    few = common.bounded_broadcast(told, MOST_SOURCES)
    rows = sized.alias("d").join(few.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    shard = F.pmod(F.col("mixed"), F.col("shards")).alias("shard")
    rows = rows.select("doc_id", "rid", "d.source", "size", "source_size", "target", shard, "mixed")
    sizes = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).where("shard_size > 0")
    claims = told.select("source", (F.col("target") / block).alias("claim"))
    seats = F.round(F.sum("claim").over(Window.partitionBy())).cast("long")
    won = apportion(claims.withColumn("all_seats", seats), ["all_seats"], "claim", F.col("all_seats"), ["source"])
    won = won.select(F.col("source").alias("of"), F.col("won").alias("seats"))
    quotas = sizes.alias("h").join(won, F.col("h.source").eqNullSafe(F.col("of"))).select("h.*", "seats")
    quotas = apportion(quotas, ["source"], "shard_size", F.col("seats"), ["shard"])
    quotas = common.stage(quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "shard_size", "won"), "quotas")
    inside = Window.partitionBy("source", "shard").orderBy("mixed", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")), "left")
    # a source at its cap is taken whole, CAP times
    whole = F.col("target") >= CAP * F.col("source_size")
    words = F.when(whole, CAP * F.col("shard_size")).otherwise(F.least(F.col("won") * block, CAP * F.col("shard_size")))
    rounds = F.coalesce(F.floor(words / F.col("shard_size")), F.lit(0))
    placed = placed.withColumn("rounds", rounds).withColumn("rest", words - F.col("rounds") * F.col("shard_size"))
    within = F.when((F.col("size") > 0) & (F.col("rest") > 0), _ranges(F.col("start"), F.col("start") + F.col("size"), block))
    placed = placed.withColumn("held", F.coalesce(within, F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
    ranges = F.transform("held", lambda r: F.struct((r["lo"] - F.col("start")).alias("lo"), (r["hi"] - F.col("start")).alias("hi")))
    part = F.aggregate("held", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"])
    taken = (F.col("rounds") * F.col("size") + part).cast("long")
    return placed.select("doc_id", "rid", "size", "source_size", "target", "rounds", ranges.alias("ranges"), taken.alias("taken"))


def _columns(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")
    mixed = F.xxhash64(F.lit(SEED), "doc_id", F.col("text").cast("string"))
    return docs.withColumns({"source": F.col("source").cast("string"), "size": size, "mixed": mixed}).drop("text")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs(doc_id, text, source)``.

    ``taken`` counts the words that the mix takes of a document, repeats counted: at most CAP times
    its size. A null source is a source, the last one; null texts have size 0 and are never taken.
    Which words are taken follows from the rows alone, so reruns agree; equal rows may
    be taken in different parts.
    """
    sized = common.stage(_columns(docs.select("doc_id", "text", "source")).withColumn("rid", F.lit(0).cast("long")), "sized")
    return plan(sized, block).select("doc_id", "size", "source_size", "target", "taken")


def apply(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy taken, and one with the taken words of a part.

    A row's text is cut at words; other columns stay as they were. Texts without words are not taken.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"), F.col("source"))
    rows = common.stage(rows.withColumn("rid", F.monotonically_increasing_id()).select("row", "rid"), "to-mix")
    got = plan(common.stage(_columns(rows.select("row.doc_id", "row.text", "row.source", "rid")), "sized"), block)
    got = got.where("taken > 0").select("rid", "rounds", "ranges")
    joined = rows.join(got, "rid")
    # each word with the spaces before it, so that a part keeps its lines
    words = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0))

    def cut(bound: Column) -> Column:
        parts = F.transform("ranges", lambda r: F.slice(bound, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))
        return F.array_join(F.flatten(parts), "")

    # bound once, so that a text is taken apart once and not for each of its ranges
    part = F.when(F.size("ranges") > 0, F.transform(F.array(words), cut)[0])
    copies = F.array_repeat(F.col("row.text").cast("string"), F.col("rounds").cast("int"))
    texts = F.filter(F.concat(copies, F.array(part)), lambda t: t.isNotNull())
    return joined.select("row", F.explode(texts).alias("_text")).select(
        *[F.col("_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents", "doc_id", "text", "source"))
