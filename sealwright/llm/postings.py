"""Operator 13, benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

Every token of the training texts that a test term can ask for becomes a posting (term, document, place). The index is
one stored table; each of its parts holds the posting lists of its documents in the order of terms. A window of
test words is looked up from its rarest term: the list of that term, less the term's place in the window, gives
where the window may start. It is intersected with the list of the second rarest, and what remains with all others.
Windows of equal words are looked up once. A place of a text starts at most one window of each length, so the
matches grow with the texts, also where a text repeats one word without end.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sealwright.llm import common

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows of a side that is sent to all tasks, counted first: test terms and windows; documents that still have candidates.
MOST_TERMS, MOST_DOCUMENTS = 300_000, 1_000_000
#: The term of a document's own row in the index; no word is empty.
_DOCUMENT = -1


def words(text: str) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    low = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def test_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(owners, windows): which item (``item``, as text) holds which window (``wid``), and the ``gram`` of each window.

    An item with fewer words than ``size`` is one window; one without words has none.
    """
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    grams = common.stage(rows.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("gram")).distinct(), "grams")
    windows = common.stage(grams.select("gram").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return grams.join(windows, "gram").select("item", "wid"), windows


def test_vocabulary(windows: DataFrame) -> DataFrame:
    """(word, term) for each word of the windows, and the empty word for documents."""
    found = windows.select(F.explode("gram").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    return common.stage(found.unionByName(found.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(_DOCUMENT).cast("long").alias("term"))), "vocabulary")


def index(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: (term, rid, pos) of every posting, and a row (-1, rid, -1, key, n_words) of every document.

    Documents and their postings are written in one pass, so their numbers ``rid`` hold whatever is lost.
    """
    rows = docs.select(F.col(key).alias("key"), words(text).alias("w")).withColumns({"rid": F.monotonically_increasing_id(), "n_words": F.size("w").cast("long")})
    # outer: a plain explode would test the array first, and so find the words twice
    tokens = rows.select("rid", "key", "n_words", F.posexplode_outer(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    found = tokens.join(common.bounded_broadcast(vocabulary, MOST_TERMS), "word")
    own = F.col("at") == 0
    postings = found.select(
        "term", "rid", (F.col("at") - 1).alias("pos"), F.when(own, F.col("key")).alias("key"), F.when(own, F.col("n_words")).alias("n_words")
    )
    return common.stage(postings.sortWithinPartitions("term", "rid", "pos"), "postings")


def documents(postings: DataFrame) -> DataFrame:
    """(rid, key, n_words) of every document in the index."""
    return postings.where(F.col("term") == _DOCUMENT).select("rid", "key", "n_words")


def ranked_terms(postings: DataFrame, windows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(wid, len, lists): the terms of each window as (count, i, term), rarest first; windows with an unknown term go."""
    counts = postings.where(F.col("term") >= 0).groupBy("term").agg(F.count("*").alias("n"))
    places = windows.select("wid", F.posexplode("gram").alias("i", "word")).join(vocabulary, "word").join(counts, "term", "left")
    lists = places.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "term"))).alias("lists"))
    return common.stage(lists.where(F.col("lists")[0]["n"] > 0).select("wid", F.size("lists").alias("len"), "lists"), "ranked")


def rarest(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(wid, rid, start, len): where each window starts if its rarest term stands at its place."""
    first = F.col("lists")[0]
    pivots = ranked.select("wid", "len", first["term"].alias("term"), first["i"].alias("i"))
    lists = postings.where(F.col("term") >= 0).select("term", "rid", "pos")
    return lists.join(common.bounded_broadcast(pivots, MOST_TERMS), "term").where("pos >= i").select("wid", "rid", (F.col("pos") - F.col("i")).alias("start"), "len")


def _intersected(found: DataFrame, ranked: DataFrame, postings: DataFrame, first: int, upto: int) -> DataFrame:
    """``found`` where the terms of ranks ``first`` to ``upto`` (exclusive) of the window all stand at their places."""
    asked = ranked.where(F.col("len") > first).select("wid", F.explode(F.slice("lists", first + 1, upto - first)).alias("t"))
    asked = asked.select("wid", F.col("t.term").alias("term"), F.col("t.i").alias("i"))
    terms = asked.select("term").distinct()
    open_ = found.where(F.col("len") > first)
    wanted = open_.join(common.bounded_broadcast(asked, MOST_TERMS * WINDOW), "wid")
    wanted = wanted.select("wid", "rid", "start", "len", "term", (F.col("start") + F.col("i")).alias("pos"))
    lists = postings.where(F.col("term") >= 0).select("term", "rid", "pos")
    lists = lists.join(common.bounded_broadcast(terms, MOST_TERMS), "term", "left_semi")
    lists = lists.join(common.bounded_broadcast(open_.select("rid").distinct(), MOST_DOCUMENTS), "rid", "left_semi")
    # a place holds one term, so a wanted posting is met once at most
    met = wanted.join(lists, ["rid", "term", "pos"]).groupBy("wid", "rid", "start", "len").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") == F.least(F.col("len"), F.lit(upto)) - first).drop("n")
    return found.where(F.col("len") <= first).unionByName(met)


def phrases(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(wid, rid, start, len) of every exact occurrence of every window, each once."""
    started = common.stage(rarest(postings, ranked), "started")
    narrowed = common.stage(_intersected(started, ranked, postings, 1, 2), "narrowed")
    return common.stage(_intersected(narrowed, ranked, postings, 2, WINDOW), "phrases")


def near(postings: DataFrame, ranked: DataFrame, reach: int) -> DataFrame:
    """(wid, rid, pos): occurrences of a window's rarest term with all its other words within ``reach`` words, in any order.

    Places are met by strips of ``reach`` words, so that an occurrence meets at most three strips and not all
    occurrences in its text.
    """
    first = F.col("lists")[0]
    at = rarest(postings, ranked).join(ranked.select("wid", first["i"].alias("i")), "wid")
    at = common.stage(at.select("wid", "rid", (F.col("start") + F.col("i")).alias("at")).unionByName(_clipped(postings, ranked)).distinct(), "anchors")
    terms = ranked.select("wid", F.array_distinct(F.transform("lists", lambda t: t["term"])).alias("terms"))
    strip = F.floor(F.col("at") / reach)
    asked = at.join(terms, "wid").select("wid", "rid", "at", F.size("terms").alias("n"), F.explode("terms").alias("term"), strip.alias("s"))
    asked = asked.withColumn("strip", F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)))
    lists = postings.where(F.col("term") >= 0).select("term", "rid", "pos", F.floor(F.col("pos") / reach).alias("strip"))
    met = asked.join(lists, ["rid", "term", "strip"]).where(F.abs(F.col("pos") - F.col("at")) <= reach)
    met = met.select("wid", "rid", "at", "n", "term").distinct().groupBy("wid", "rid", "at", "n").agg(F.count("*").alias("m"))
    return met.where("m = n").select("wid", "rid", F.col("at").alias("pos"))


def _clipped(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """Occurrences of rarest terms that stand too early for their place in the window."""
    first = F.col("lists")[0]
    pivots = ranked.select("wid", first["term"].alias("term"), first["i"].alias("i"))
    lists = postings.where(F.col("term") >= 0).select("term", "rid", "pos")
    return lists.join(common.bounded_broadcast(pivots, MOST_TERMS), "term").where("pos < i").select("wid", "rid", F.col("pos").alias("at"))


def covered(found: DataFrame) -> DataFrame:
    """(rid, n_hit): words inside any occurrence; overlaps count once."""
    spans = found.groupBy("rid", "start").agg(F.max("len").alias("len")).withColumn("end", F.col("start") + F.col("len"))
    before = Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.withColumn("new", F.greatest(new, F.lit(0))).groupBy("rid").agg(F.sum("new").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Null and empty texts have no words and are clean; null items, and items without words, match nothing. A null
    id of an item is the text "null", items of one id are one item. Equal rows and null keys stay. Without any item
    or document all documents, or none, are clean.
    """
    owners, windows = test_windows(items, item, text)
    vocabulary = test_vocabulary(windows)
    postings = index(docs, vocabulary, key, text)
    found = phrases(postings, ranked_terms(postings, windows, vocabulary))
    held = found.select("rid", "wid").distinct().join(common.bounded_broadcast(owners, MOST_TERMS), "wid")
    named = held.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = covered(found).join(named, "rid")
    rows = documents(postings).join(hits, "rid", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))


#: Every window against the word sequences of its length at every place.
SQL = r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
items as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
starts as (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from items where len(w) > 0),
windows as (select distinct item, w[s : s + 9] as g from starts),
lens as (select distinct len(g) as n from windows),
places as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as p from docs, lens where len(w) >= n),
found as (select rid, p, n, item from (select rid, p, n, w[p : p + n - 1] as g from places) join windows using (g)),
hit as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from found) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct rid, item from found) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (rid) left join its using (rid)
"""
