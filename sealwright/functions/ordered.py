"""Ordered texts and digests per scope, and distributed ordinals.

SHA-256 of an ordered listing is sequential by definition, so the lines of one scope have to pass
one running hash. Everything else is spread: lines are range-sorted over many tasks and joined into
bounded blocks there, and only the blocks stream, in order, through the running hash or into the
chunks of a text. No task holds more than one block and one chunk.

Scopes of at most SCOPE_LINES lines and SCOPE_CHARS characters need none of this: their lines meet in
one group, and are sorted and joined there. Scopes are counted first, so one of any size is never
held by a task.

Lines carry path, digest and size, never payload content. They are stored before the sort, so what
they are computed from is read once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stored
from . import batches as arrow_batches

#: Characters of a block, and of a chunk of an ordered text; chunks do not depend on blocks.
BLOCK_CHARS = 1_000_000
CHUNK_CHARS = 16_000_000
#: Head of a section of a block: the versions that hold it as bits, and its bytes.
_SECTION, _SECTION_BYTES = "<II", 8
#: Lines, and characters in them, of a scope that one group may hold; larger scopes are made of blocks.
SCOPE_LINES, SCOPE_CHARS = 10_000, 1_000_000


def lines(
    df: DataFrame, scope: Sequence[str], key: Column, text: Column, part: int = 0
) -> DataFrame:
    """Rows of one listing: scope columns, listing number, order key, text."""
    return df.select(
        *scope, F.lit(part).alias("part"), key.cast("string").alias("key"), text.alias("text")
    )


def slice_of(key: Column, heads: Sequence[str]) -> Column:
    """The slice of a key: a name for a range of keys, told from the key alone, so that no keys have to be sampled.

    ``heads`` are what keys may begin with, none the beginning of another. Keys with a head are cut by the two characters
    after it, which are even where these begin a digest; all others between two heads are one slice.
    """
    found = F.lit("")
    for at, head in enumerate(sorted(heads)):
        after = F.concat(F.lit(f"{at:03}"), F.substring(key, len(head) + 1, 2))
        found = F.when(key >= head, F.when(key.startswith(head), after).otherwise(F.lit(f"{at:03}>>>"))).otherwise(found)
    return F.coalesce(found, F.lit(""))


def _sorted(listing: DataFrame, names: list[str], late: tuple[Column, Column] | None) -> DataFrame:
    """Lines over many tasks, in order; with ``late`` their texts are made where they are sorted, from narrower rows.

    Lines with a ``slice`` (:func:`slice_of`) are dealt by it: then slices are in order within themselves, and their
    first keys tell the order of slices.
    """
    held = F.col("held") if "held" in listing.columns else F.lit(1).alias("held")
    if late is None:
        ranged = listing.orderBy(*names, "part", "key", "text")
        return ranged.select(*names, "part", F.lit("").alias("slice"), held, F.lit(None).cast("string").alias("key"), "text")
    key, text = late[:2]
    before = {} if len(late) < 3 else late[2]
    if "slice" not in listing.columns:
        dealt = listing.repartitionByRange(*names, "part", key)
        made = dealt.select(*names, "part", F.lit("").alias("slice"), held, key.alias("key"), text.alias("text"))
        ranged = made.sortWithinPartitions(*names, "part", "key", "text")
        return ranged.withColumn("key", F.lit(None).cast("string"))
    # each step is made once, from the columns of the one before
    dealt = listing.repartition(*names, "part", "slice").withColumns(before).withColumn("_line_key", key)
    made = dealt.select(*names, "part", "slice", held, F.col("_line_key").alias("key"), text.alias("text"))
    return made.sortWithinPartitions(*names, "part", "key", "text")


def _blocks(listing: DataFrame, scope: Sequence[str], separator: str, late: tuple[Column, Column] | None) -> DataFrame:
    """Join sorted lines into ordered blocks, many tasks per scope. Blocks are compressed, as all of them move once more.

    A block is made of sections: the versions that hold it as bits, the length of its bytes, and lines. ``first`` is the
    key of the first line where lines were dealt by slices.
    """
    names = list(scope)
    width = len(names)
    schema = T.StructType(
        [listing.schema[name] for name in names]
        + [
            T.StructField("part", T.IntegerType()),
            T.StructField("first", T.StringType()),
            T.StructField("slot", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("block", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    limit = BLOCK_CHARS

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() << 32
        owner, first, sections, size = None, None, [], 0
        codec = pa.Codec("zstd")

        def block() -> tuple:
            data = b"".join(sections)
            return (*owner[:-1], first, slot, len(data), codec.compress(data, asbytes=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            text, key, held = batch.column(width + 4), batch.column(width + 3), batch.column(width + 2).to_pylist()
            if text.null_count:
                raise ValueError("a line without text")
            runs = _runs(batch, width + 3, max(1, batch.num_rows * limit // max(1, text.nbytes)))
            lists = (pa.LargeListArray if pa.types.is_large_string(text.type) else pa.ListArray).from_arrays(runs, text)
            for at, lines in zip(runs[:-1].tolist(), pc.binary_join(lists, separator)):
                line_owner = tuple(batch.column(k)[at].as_py() for k in range(width + 2))
                if sections and (line_owner != owner or size > limit):
                    slot += 1
                    yield block()
                    sections, size = [], 0
                if not sections:
                    owner, first = line_owner, key[at].as_py()
                data = lines.as_buffer().to_pybytes()
                sections += [struct.pack(_SECTION, held[at], len(data)), data]
                size += len(data)
        if sections:
            slot += 1
            yield block()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(joined(batches), arrow)

    return _sorted(listing, names, late).mapInArrow(build, schema)


def _runs(batch: pa.RecordBatch, width: int, most: int) -> np.ndarray:
    """Where runs of rows that are equal in the first ``width`` columns begin, and the end; no run is longer than ``most``."""
    begins = np.arange(batch.num_rows) % most == 0
    for column in batch.columns[:width]:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(begins), batch.num_rows).astype(np.int32)


def _same(names: list[str], table: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The few scopes of ``table``, renamed and broadcast, and the condition that a row is of one of them."""
    renamed = table.select(*[F.col(n).alias(f"_of_{n}") for n in names])
    return F.broadcast(renamed), [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names]


def _large(listing: DataFrame, names: list[str]) -> DataFrame | None:
    """Scopes with more than SCOPE_LINES lines or SCOPE_CHARS characters, of which there are few, and null ones; stored."""
    counted = listing.groupBy(*names).agg(F.count(F.lit(1)).alias("_lines"), F.sum(F.length("text")).alias("_chars"))
    null = reduce(Column.__or__, [F.col(n).isNull() for n in names])
    large = stored(counted.filter((F.col("_lines") > SCOPE_LINES) | (F.col("_chars") > SCOPE_CHARS) | null).select(*names), "large-scopes")
    return None if large.isEmpty() else large


def _grouped(
    listing: DataFrame, names: list[str], glue: DataFrame | Sequence[str], parts: int, separator: str, large: DataFrame | None
) -> DataFrame:
    """Scope columns and ``text`` of all scopes but the large ones: the lines of a scope meet in one group."""
    if large is not None:
        listing = listing.join(*_same(names, large), "left_anti")
    line = F.struct("part", "key", F.coalesce("text", F.raise_error(F.lit("a line without text"))).alias("text"))
    # lines are dealt as they are: lists made before would only be taken apart again
    met = listing.repartition(*names).groupBy(*names).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    if isinstance(glue, DataFrame):
        heads = glue.select(*names, "glue")
        if large is not None:
            heads = heads.join(*_same(names, large), "left_anti")
        met = heads.join(met, names, "left").withColumn("lines", F.coalesce("lines", F.array()))
    else:
        met = met.withColumn("glue", F.array(*[F.lit(piece) for piece in glue]))

    def listed(part: int) -> Column:
        return F.array_join(F.transform(F.filter("lines", lambda x: x["part"] == part), lambda x: x["text"]), separator)

    pieces = [piece for part in range(parts) for piece in (F.col("glue")[part], listed(part))]
    return met.select(*names, F.concat(*pieces, F.col("glue")[parts]).alias("text"))


def _framed(
    listing: DataFrame, names: list[str], glue: DataFrame | Sequence[str], separator: str, late: tuple[Column, Column] | None = None,
    large: DataFrame | None = None,
) -> DataFrame:
    """A first row with its glue and then the blocks of each scope, in order in one partition.

    Blocks are a megabyte each, so this shuffle moves few rows; a task reads its sorted
    blocks as a stream. Scopes without glue are left out, scopes without lines are kept. With ``large`` all
    other scopes are left out.
    """
    if large is not None:
        listing = listing.join(*_same(names, large), "left_semi")
    blocks = _blocks(listing, names, separator, late)
    blocks = blocks.select(*names, "part", "first", "slot", "size", "block", F.lit(None).cast("array<string>").alias("glue"))
    if isinstance(glue, DataFrame):
        heads = glue.select(*names, "glue")
        if large is not None:
            heads = heads.join(*_same(names, large), "left_semi")
    else:
        constant = F.array(*[F.lit(piece) for piece in glue]).alias("glue")
        heads = listing.select(*names).distinct().select(*names, constant)
    none = F.lit(None).cast("string").alias("first")
    heads = heads.select(*names, F.lit(-1).alias("part"), none, F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("block"), "glue")
    return (
        blocks.unionByName(heads)
        .repartition(*names)
        .sortWithinPartitions(*names, "part", "first", "slot")
        .select(*names, "part", "size", "block", "glue")
    )


def _pieces(batches: Iterator[pa.RecordBatch], width: int, parts: int, separator: str, versions: int = 1) -> Iterator[tuple[tuple, int, bytes, bool]]:
    """Pieces of each scope's text in order: scope values, the versions that hold it as bits, piece, and whether it is the last."""
    owner, glue, done, fresh = None, None, 0, 0
    every, between = (1 << versions) - 1, separator.encode()
    codec = pa.Codec("zstd")

    def tail() -> Iterator[tuple[tuple, int, bytes, bool]]:
        for part in range(done, parts):
            yield owner, every, glue[part + 1].encode(), part + 1 == parts

    for batch in batches:
        for row in arrow_batches.rows(batch):
            values, (part, size, block, row_glue) = row[:width], row[width:]
            if part < 0:
                if glue is not None:
                    yield from tail()
                owner, glue, done, fresh = values, row_glue, 0, every
                yield owner, every, glue[0].encode(), False
                continue
            if glue is None or values != owner:
                # lines of a scope that has no glue
                if glue is not None:
                    yield from tail()
                owner, glue = values, None
                continue
            while done < part:
                done += 1
                yield owner, every, glue[done].encode(), False
                fresh = every
            data, at = memoryview(codec.decompress(block, size)), 0
            while at < size:
                held, length = struct.unpack_from(_SECTION, data, at)
                at += _SECTION_BYTES + length
                if held & ~fresh:
                    yield owner, held & ~fresh, between, False
                fresh &= ~held
                yield owner, held, data[at - length : at], False
    if glue is not None:
        yield from tail()


def _arrow_row(values: Sequence, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, schema)], schema=schema)


def _output(listing: DataFrame, names: list[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([*[listing.schema[name] for name in names], *fields])


def ordered_text(
    listing: DataFrame, scope: Sequence[str], glue: DataFrame | Sequence[str], *, parts: int = 1, separator: str = ",", chunk_chars: int | None = None
) -> DataFrame:
    """Scope columns, ``chunk`` and ``text``: the text of a scope, in chunks of ``chunk_chars`` (CHUNK_CHARS) at most.

    The text is ``glue[0] + listing 0 + glue[1] + listing 1 + ... + glue[parts]``.
    ``glue`` is constant or a table of scope columns and an array ``glue``; with a table, scopes
    without lines have a text too.
    """
    names = list(scope)
    schema = _output(
        listing, names, T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType())
    )
    arrow, width, most = to_arrow_schema(schema), len(names), chunk_chars or CHUNK_CHARS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size, chunk = [], 0, 0
        for values, _, data, last in _pieces(batches, width, parts, separator):
            piece, at = str(data, "utf-8"), 0
            while at < len(piece):
                part = piece[at : at + most - size]
                held.append(part)
                at, size = at + len(part), size + len(part)
                if size == most:
                    yield (*values, chunk, "".join(held))
                    held, size, chunk = [], 0, chunk + 1
            if last:
                if size or not chunk:
                    yield (*values, chunk, "".join(held))
                held, size, chunk = [], 0, 0

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(cut(batches), arrow)

    listing = stored(listing, "lines")
    large = _large(listing, names)
    texts = _grouped(listing, names, glue, parts, separator, large)
    short = F.octet_length("text") <= most
    at = F.when(short, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / most).cast("long") - 1))
    cuts = texts.select(*names, F.explode(at).alias("chunk"), "text")
    piece = F.when(short, F.col("text")).otherwise(F.substring("text", (F.col("chunk") * most + 1).cast("int"), F.lit(most)))
    cuts = cuts.select(*names, "chunk", piece.alias("text"))
    return cuts if large is None else cuts.unionByName(_framed(listing, names, glue, separator, large=large).mapInArrow(emit, schema))


def ordered_digest(
    listing: DataFrame, scope: Sequence[str], glue: DataFrame | Sequence[str], *, parts: int = 1, separator: str = ",",
    late: tuple | None = None, versions: int = 1,
) -> DataFrame:
    """Scope columns and ``sha256`` of the text :func:`ordered_text` describes, by one running hash each.

    With ``versions`` several texts that share most lines are told in one pass: ``sha256`` is an array, and ``held`` of a line (with
    ``late`` only) has the bits of the versions that hold it.

    With ``late`` the listing has scope columns, ``part`` and whatever the two columns of ``late``, key and text of a line, are made
    from; it is not stored, and ``glue`` has to be a table. With ``slice`` (:func:`slice_of`) too it is read once, else twice, and
    ``late`` may bring a third value, columns that are made before the key; the text may be made from the key, ``_line_key``.
    """
    names = list(scope)
    schema = _output(listing, names, T.StructField("sha256", T.ArrayType(T.StringType())))
    arrow, width = to_arrow_schema(schema), len(names)
    if versions > 1 and late is None:
        raise ValueError("versions need late lines")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import hashlib

        states = [hashlib.sha256() for _ in range(versions)]
        for values, held, piece, last in _pieces(batches, width, parts, separator, versions):
            for at, state in enumerate(states):
                if held >> at & 1:
                    state.update(piece)
            if last:
                yield (*values, [state.hexdigest() for state in states])
                states = [hashlib.sha256() for _ in range(versions)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(digests(batches), arrow)

    def told_of(framed: DataFrame) -> DataFrame:
        digests = framed.mapInArrow(fold, schema)
        return digests if versions > 1 else digests.withColumn("sha256", F.col("sha256")[0])

    if late is not None:
        return told_of(_framed(listing, names, glue, separator, late))
    listing = stored(listing, "lines")
    large = _large(listing, names)
    told = _grouped(listing, names, glue, parts, separator, large).select(*names, F.sha2("text", 256).alias("sha256"))
    return told if large is None else told.unionByName(told_of(_framed(listing, names, glue, separator, large=large)))


def digest_ordinal(df: DataFrame, scope: Sequence[str], id_column: str, name: str = "ord", late: Column | None = None) -> DataFrame:
    """1-based position of each content id within its scope, in byte order.

    A content id ends in a uniform digest, so text up to the first three hex
    digits splits any scope into even, order-preserving slices: ranking runs
    within slices and slice sizes are summed up over at most a few thousand
    rows per scope. With ``late`` the id is made where it is ranked, from narrower rows.
    """
    names = list(scope)
    own = F.col(id_column) if late is None else late
    cut = F.instr(own, ":sha256:") + F.lit(len(":sha256:") + 2)
    sliced = df.withColumn("_slice", F.substring(own, F.lit(1), cut))
    within = Window.partitionBy(*names, "_slice").orderBy("_whole")
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*names, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*names, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        sliced.repartition(*names, "_slice")
        .withColumn("_whole", own)
        .withColumn("_rank", F.row_number().over(within))
        .join(offsets, [*names, "_slice"])
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_rank", "_before", "_slice", "_whole")
    )


def with_previous(df: DataFrame, scope: str, order: Sequence[str], record: Sequence[str]) -> DataFrame:
    """``df`` with ``_prev``, the ``record`` columns of the row before in its scope, as a struct; null for the first row.

    Rows are sorted once, by scope and ``order`` (then by all of ``record``, so that ties have an order too), over
    ranges of equal size. A task reads its range as a stream and knows the row before each but the first; that one takes
    the last row of the range before, of which there is one for each task. So a scope of any size is many tasks, whatever its
    keys look like.
    """
    keys = list(dict.fromkeys([scope, *order, *record]))
    names = list(df.columns)
    before = [f"_prev_{name}" for name in record]
    kinds = [T.StructField(f"_prev_{name}", df.schema[name].dataType) for name in record]
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.IntegerType())]
    schema = T.StructType([*df.schema.fields, *kinds, *extra])
    arrow = to_arrow_schema(schema)
    at, taken = names.index(scope), [names.index(name) for name in record]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, edges = list(zip(*[column.to_pylist() for column in batch.columns])), []
            told = []
            for row in rows:
                same = last is not None and last[at] == row[at]
                told.append(tuple(last[k] for k in taken) if same else (None,) * len(taken))
                edges.append(1 if first else 2 if same else 0)
                last, first = row, False
            columns = [*batch.columns, *[pa.array(c, f.type) for c, f in zip(zip(*told), list(arrow)[len(names) :])]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(edges, pa.int32())], schema=arrow)
        if last is not None:
            # the last row once more, for the range after this one
            values = [*last, *[None] * len(taken), part, -1]
            yield _arrow_row(values, arrow)

    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(ranged.mapInArrow(run, schema), "neighbours")
    ends = rows.where("_edge = -1").select("_part", F.struct(F.col(scope).alias("_scope"), *[F.col(n) for n in record]).alias("_end"))
    # one row for each task that had rows
    ends = ends.select(F.lead("_part").over(Window.orderBy("_part")).alias("_part"), "_end").where("_part is not null")
    inner = rows.where("_edge in (0, 2)")
    held = F.when(F.col("_edge") == 2, F.struct(*[F.col(b).alias(n) for b, n in zip(before, record)]))
    # every range but the first follows one; of a table of one range nothing does
    outer = rows.where("_edge = 1").join(ends, "_part", "left")
    follows = F.when(F.col("_end._scope") == F.col(scope), F.struct(*[F.col(f"_end.{n}").alias(n) for n in record]))
    return inner.select(*names, held.alias("_prev")).unionByName(outer.select(*names, follows.alias("_prev")))
