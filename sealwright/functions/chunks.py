"""Texts of any size, read chunk by chunk: lines, and JSON whose bulk lies in arrays of the outer object.

A chunk cannot tell by itself whether it begins inside a string, or how deep. It reports what it would do to a
reader in either state: its parity of quotes, its change of depth, the last bracket it opens at each level. Windows
over these reports, one small row for each chunk, fix the state in which every chunk begins. Each chunk is then
taken apart by itself: the elements of the arrays one level down, and the *frame*, which is the text with those arrays
emptied. Only an element that crosses the end of a chunk is put together from its pieces. Elements are numbered by
sums over the chunks before, so no task holds more than a chunk, an element or a frame.

A text is valid JSON exactly if its frame and all its elements are; it is canonical, and free of repeated members,
exactly if they are. A backslash outside of strings is invalid wherever it stands, so escapes are told by
counting backslashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stored
from . import batches as arrow_batches

#: Characters that a task takes apart at a time.
READ_CHARS = 1 << 20
#: Rows told of chunks, one for each, that are sent to all tasks at most.
MOST_SENT = 500_000
FRAME = -1
_SUMMARY = -2
BLANK = r"\A[ \t\n\r]*\z"

_STATES = [(escaped, inside) for escaped in (0, 1) for inside in (0, 1)]


def as_chunks(table: DataFrame, scope: Sequence[str], text: str = "text", size: int | None = None) -> DataFrame:
    """Scope columns, ``chunk`` and ``text`` with chunks of at most ``size`` characters.

    ``table`` has a whole text in a row, or chunks numbered by ``chunk``. A null text is an empty one.
    """
    size = size or READ_CHARS
    first = F.col("chunk").cast("long") if "chunk" in table.columns else F.lit(0).cast("long")
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    last = F.greatest(F.lit(0), F.ceil(F.length("_text") / size) - 1).cast("int")
    rows = table.select(*scope, first.alias("_first"), own.alias("_text"))
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_part"))
    cut = F.substring("_text", F.col("_part") * size + 1, F.lit(size))
    return parts.select(*scope, (F.col("_first") * (1 << 20) + F.col("_part")).alias("chunk"), cut.alias("text"))


# --- lines --------------------------------------------------------------------

def _joined(pieces: DataFrame, keys: Sequence[str], complete: Column) -> DataFrame:
    """Rows whose piece is complete, and the others put together in the order of chunks."""
    whole = pieces.where(complete).select(*keys, "text")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "seq", "text")))
    cut = pieces.where(~complete).groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))
    return whole.unionByName(cut)


def lines(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scope columns, ``pos``, ``line`` and ``last``: what stands between line feeds, the text after the last one too."""
    names = list(scope)
    before = Window.partitionBy(*names).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    feeds = chunks.select(*names, "chunk", F.length(F.regexp_replace("text", "[^\n]", "")).cast("long").alias("feeds"))
    feeds = feeds.select(*names, "chunk", "feeds", F.coalesce(F.sum("feeds").over(before), F.lit(0)).alias("start"))
    feeds = stored(feeds, "line-feeds")
    total = feeds.groupBy(*names).agg(F.sum("feeds").alias("total"))
    pieces = chunks.join(feeds, [*names, "chunk"]).select(*names, "chunk", "start", "feeds", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    pieces = pieces.withColumn("pos", F.col("start") + F.col("seq"))
    inner = (F.col("seq") > 0) & (F.col("seq") < F.col("feeds"))
    rows = _joined(pieces, [*names, "pos"], inner)
    return rows.join(total, names).select(*names, "pos", F.col("text").alias("line"), (F.col("pos") == F.col("total")).alias("last"))


# --- JSON ---------------------------------------------------------------------

def _marks(data: np.ndarray, escaped: int, inside: int) -> tuple[int, np.ndarray]:
    """Parity of quotes, and the places of brackets and commas outside of strings."""
    quotes = np.flatnonzero(data == 34)
    slashes = data == 92
    if len(quotes) and (escaped or slashes.any()):
        last = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        end = np.where(quotes > 0, last[quotes - 1], -1)
        run = quotes - 1 - end + escaped * (end < 0)
        quotes = quotes[run % 2 == 0]
    marks = np.flatnonzero((data == 91) | (data == 93) | (data == 123) | (data == 125) | (data == 44))
    outside = (inside + np.searchsorted(quotes, marks)) % 2 == 0
    return len(quotes) % 2, marks[outside]


def _depths(kinds: np.ndarray) -> np.ndarray:
    return np.cumsum((kinds == 91) | (kinds == 123), dtype=np.int64) - np.cumsum((kinds == 93) | (kinds == 125), dtype=np.int64)


def report(text: str, escaped: int, inside: int) -> tuple[int, int, list[int], str]:
    """Parity of quotes, change of depth, and the last bracket opened at each level, by levels from where it begins."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    q, marks = _marks(data, escaped, inside)
    kinds = data[marks]
    depth = _depths(kinds)
    opened = {int(d): chr(k) for d, k in zip(depth, kinds) if k in (91, 123)}
    return q, int(depth[-1]) if len(depth) else 0, list(opened), "".join(opened.values())


def _reports(texts: pd.Series, chunks: pd.Series) -> pd.DataFrame:
    """What each chunk does to a reader in any state; a first chunk is only ever met by one that is in none."""
    slashes = [len(t) - len(t.rstrip("\\")) for t in texts]
    plain = [report(t, 0, 0) for t in texts]
    out: dict[str, list] = {"tail": slashes, "full": [s == len(t) for s, t in zip(slashes, texts)]}
    for escaped, inside in _STATES:
        told = [p if chunk == 0 or not (escaped or inside) else report(t, escaped, inside) for p, t, chunk in zip(plain, texts, chunks)]
        out |= {f"{name}{escaped}{inside}": list(column) for name, column in zip(("q", "delta", "levels", "kinds"), zip(*told) if told else [[]] * 4)}
    return pd.DataFrame(out)


_REPORTS = ", ".join(["tail long", "full boolean", *[f"q{e}{i} int, delta{e}{i} long, levels{e}{i} array<long>, kinds{e}{i} string" for e, i in _STATES]])


def begin_states(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scope columns, ``chunk`` and the state it begins in: ``escaped``, ``inside``, ``depth``, ``kind`` of the bracket open at level 2."""
    names = list(scope)
    rows = chunks.select(*names, "chunk", F.pandas_udf(_reports, _REPORTS)("text", "chunk").alias("r")).select(*names, "chunk", "r.*")
    rows = stored(rows, "chunk-reports", long_rows=True)
    order = Window.partitionBy(*names).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a run of backslashes goes on through chunks that hold nothing else
    rows = rows.withColumn("group", F.sum((~F.col("full")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("run", F.sum("tail").over(Window.partitionBy(*names, "group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("escaped", (F.coalesce(F.lag("run").over(order), F.lit(0)) % 2).cast("int"))
    quotes = F.when(F.col("escaped") == 1, F.col("q10")).otherwise(F.col("q00"))
    rows = rows.withColumn("inside", (F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2).cast("int"))
    for name in ("delta", "levels", "kinds"):
        told = F.lit(None)
        for e, i in _STATES:
            told = F.when((F.col("escaped") == e) & (F.col("inside") == i), F.col(f"{name}{e}{i}")).otherwise(told)
        rows = rows.withColumn(name, told)
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)).cast("long"))
    at = F.array_position("levels", 2 - F.col("depth")).cast("int")
    rows = rows.withColumn("_opened", F.when(at > 0, F.substring("kinds", at, F.lit(1))))
    return rows.select(*names, "chunk", "escaped", "inside", "depth", F.coalesce(F.last("_opened", ignorenulls=True).over(before), F.lit("")).alias("kind"))


def pieces(text: str, escaped: int, inside: int, depth: int, kind: str) -> tuple[list[tuple[int, int, bool, bool, str]], int, int]:
    """``(array, pos, begins, ends, text)`` of each piece, the arrays begun, and the commas since the last one began.

    ``array`` 0 is the one open at the beginning; positions count from where the chunk or the array begins.
    """
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    _, marks = _marks(data, escaped, inside)
    kinds = data[marks]
    levels = depth + _depths(kinds)
    enters = (levels == 2) & ((kinds == 91) | (kinds == 123))
    leaves = (levels == 1) & ((kinds == 93) | (kinds == 125))
    opener = np.maximum.accumulate(np.where(enters, np.arange(len(marks)), -1)) if len(marks) else np.zeros(0, int)
    in_array = np.where(opener >= 0, kinds[opener] == 91, kind == "[")
    events = in_array & (enters | leaves | ((levels == 2) & (kinds == 44)))
    out: list[tuple[int, int, bool, bool, str]] = []
    at = array = pos = 0
    open_, begins = depth >= 2 and kind == "[", False

    def cut(end: int) -> str:
        return raw[at:end].decode("utf-8", "surrogatepass")

    for k in np.flatnonzero(events):
        place = int(marks[k])
        if enters[k]:
            out.append((FRAME, 0, True, True, cut(place + 1)))
            at, array, pos, begins, open_ = place + 1, array + 1, 0, True, True
        elif kinds[k] == 44:
            out.append((array, pos, begins, True, cut(place)))
            at, pos, begins = place + 1, pos + 1, True
        elif open_:
            out.append((array, pos, begins, True, cut(place)))
            at, open_ = place, False
    out.append((array, pos, begins, False, cut(len(raw))) if open_ else (FRAME, 0, True, True, cut(len(raw))))
    return out, array, pos


def _sent(told: DataFrame) -> DataFrame:
    """One short row for each chunk, stored, and sent to all tasks unless there are very many."""
    told = stored(told, "chunk-states")
    return F.broadcast(told) if told.count() <= MOST_SENT else told


def whole_parts(texts: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The rows of :func:`json_parts` for texts that are one chunk each; a text begins outside of everything, so nothing is told of it before.

    ``texts`` has the scope columns and ``text``.
    """
    names = list(scope)
    fields = [T.StructField("array", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("text", T.StringType())]
    schema = T.StructType([*[texts.schema[n] for n in names], *fields])
    arrow = to_arrow_schema(schema)

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for values in arrow_batches.rows(batch):
                own, text = values[:-1], values[-1]
                found, _, _ = pieces(text or "", 0, 0, 0, "")
                several = {array for array, pos, *_ in found if pos == 1}
                for array, pos, _, _, part in found:
                    if array == FRAME:
                        continue
                    if pos == 0 and array not in several and not part.strip(" \t\n\r"):
                        if not part:
                            continue
                        pos = -1
                    yield (*own, array - 1, pos, part)
                yield (*own, FRAME, 0, "".join(piece[4] for piece in found if piece[0] == FRAME))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(taken_apart(batches), arrow)

    return texts.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def json_parts(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scope columns, ``array``, ``pos`` and ``text``: the elements of the arrays one level down, and the frame (array -1).

    Arrays are numbered in the order of the text; :func:`json_walk.with_part` tells their names from the frame. Spaces
    inside an empty array stand at position -1.
    """
    names = list(scope)
    width = len(names)
    schema = T.StructType(
        [chunks.schema[n] for n in names]
        + [T.StructField("chunk", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("array", T.LongType()), T.StructField("pos", T.LongType())]
        + [T.StructField("begins", T.BooleanType()), T.StructField("ends", T.BooleanType()), T.StructField("text", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for values in arrow_batches.rows(batch):
                own, (chunk, text, escaped, inside, depth, kind) = values[:width], values[width:]
                found, arrays, commas = pieces(text, escaped, inside, depth, kind)
                yield from ((*own, chunk, seq, *piece) for seq, piece in enumerate(found))
                # its counts, for the numbers of the chunks that follow
                yield (*own, chunk, arrays, _SUMMARY, commas, False, False, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(taken_apart(batches), arrow)

    # texts stay where they are: what is told of a chunk is one short row
    states = _sent(begin_states(chunks, names))
    taken = chunks.join(states, [*names, "chunk"]).select(*names, "chunk", "text", "escaped", "inside", "depth", "kind").mapInArrow(run, schema)
    taken = stored(taken, "json-pieces", long_rows=True)
    order = Window.partitionBy(*names).orderBy("chunk")
    counts = taken.where(F.col("array") == _SUMMARY).select(*names, "chunk", F.col("seq").cast("long").alias("arrays"), F.col("pos").alias("commas"))
    counts = counts.withColumn("begun", F.sum("arrays").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fresh = Window.partitionBy(*names, "_since").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_since", F.sum((F.col("arrays") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("_commas", F.sum("commas").over(fresh))
    starts = counts.select(
        *names, "chunk", (F.col("begun") - F.col("arrays")).alias("_arrays"), F.coalesce(F.lag("_commas").over(order), F.lit(0)).alias("_before")
    )
    numbered = taken.where(F.col("array") >= 0).join(_sent(starts), [*names, "chunk"])
    numbered = numbered.withColumn("pos", F.col("pos") + F.when(F.col("array") == 0, F.col("_before")).otherwise(0))
    numbered = numbered.withColumn("array", F.col("_arrays") + F.col("array") - 1)
    elements = stored(_joined(numbered, [*names, "array", "pos"], F.col("begins") & F.col("ends")), "json-elements")
    # blank text between the brackets of an empty array is no element
    blank = elements.where((F.col("pos") == 0) & F.col("text").rlike(BLANK)).select(*names, "array")
    several = elements.where(F.col("pos") == 1).select(*names, "array")
    empty = blank.join(several, [*names, "array"], "left_anti").withColumn("pos", F.lit(0).cast("long"))
    spaces = elements.join(empty, [*names, "array", "pos"], "left_semi").where("text <> ''").withColumn("pos", F.lit(-1).cast("long"))
    elements = elements.join(empty, [*names, "array", "pos"], "left_anti").unionByName(spaces)
    frame = _joined(taken.where(F.col("array") == FRAME).withColumn("pos", F.lit(0).cast("long")), [*names, "array", "pos"], F.lit(False))
    return elements.unionByName(frame)
