"""Operator 9, exact repeated passages by a depth-limited radix sort of byte suffixes.

Suffixes are ordered only through THRESHOLD bytes, by two most-significant-digit passes, and groups
of equal windows are the repeats. So that not every byte starts a suffix in the first pass, a window
is rotated to start at its minimiser: the one of its DIGIT-byte grams whose hash is least. Equal windows
have equal minimisers at equal places, so no repeat is lost, and one suffix in about 15 bytes is
sorted. The first pass sorts suffixes by that gram and by all bytes that windows around it can
hold. Where those bytes are in a smaller document too, every window around the gram is a repeat; a
gram in one document only is dropped. The second pass sorts the windows of what remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm import common

THRESHOLD, DIGIT = 50, 22
#: Windows around a gram, and bytes on either side that they reach.
AROUND = THRESHOLD - DIGIT + 1
REACH = AROUND - 1
EVERY = (1 << AROUND) - 1
CONTEXT = DIGIT + 2 * REACH
#: Windows handled at once; bytes of text that are packed at once, and that one group of the radix passes stands for.
SEGMENT, SLICE, GROUP = 1 << 18, 1 << 22, 1 << 22
_LOW = np.uint64((1 << 21) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(size, b, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


class _Sums:
    """Hashes of any part of a segment from running sums of its bytes' terms."""

    def __init__(self, data: np.ndarray, base: int):
        power, self.inverse = _powers(base, SEGMENT + 4 * CONTEXT)
        terms = (data.astype(np.uint64) + _ONE) * power[: len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self) -> np.ndarray:
        size = max(0, len(self.sums) - DIGIT)
        return _mix((self.sums[DIGIT:] - self.sums[:size]) * self.inverse[:size])


def _minimisers(grams: np.ndarray) -> np.ndarray:
    """For each window start, the place of the least gram in it; of equal ones the first."""
    x = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= AROUND:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if rest := AROUND - width:
        x = np.minimum(x[:-rest], x[rest:])
    return (x & _LOW).astype(np.int64)


def window_grams(data: np.ndarray) -> np.ndarray:
    """Place of the gram that each window of ``data`` is sorted by."""
    parts = [np.zeros(0, np.int64)]
    for at in range(0, len(data) - THRESHOLD + 1, SEGMENT):
        parts.append(at + _minimisers(_Sums(data[at : at + SEGMENT + THRESHOLD - 1], _BASES[0]).grams()))
    return np.concatenate(parts)


def suffixes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, first digit, context) of all sorted suffixes of texts that lie end to end in ``data``.

    ``starts``: where each text begins, and the end of the last.
    """
    out, last = [], -1
    for s in range(0, max(0, len(data) - THRESHOLD + 1), SEGMENT):
        e = min(s + SEGMENT, len(data) - THRESHOLD + 1)
        low, high = max(0, s - REACH), min(len(data), e + CONTEXT + REACH)
        first = _Sums(data[low:high], _BASES[0])
        grams = first.grams()
        place = s + _minimisers(grams[s - low : e - low + REACH])
        text = np.searchsorted(starts, np.arange(s, e), "right") - 1
        inside = np.arange(s, e) + THRESHOLD <= starts[text + 1]
        place, text = place[inside], text[inside]
        new = np.concatenate([[last], place])[:-1] != place if len(place) else np.zeros(0, bool)
        place, text = place[new], text[new]
        if not len(place):
            continue
        last = place[-1]
        left = np.minimum(REACH, place - starts[text])
        right = np.minimum(REACH, starts[text + 1] - place - DIGIT)
        around = _Sums(data[low:high], _BASES[1]).part(place - left - low, place + DIGIT + right - low)
        around = _mix(around + (left * (REACH + 1) + right).astype(np.uint64) * np.uint64(_BASES[0]))
        out.append((text, place - starts[text], grams[place - low], around))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _group_of(digit: np.ndarray, groups: int) -> np.ndarray:
    """The group of a first digit. Digits are the least hashes around, so they are mixed once more to spread evenly."""
    return ((_mix(digit) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, byte by byte, as equal bytes compress side by side."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view(np.uint64).ravel()


#: Bytes of a sorted suffix: digit (its group tells more of it), context, document, tag, place.
_WIDTHS = (6, 6, 8, 4, 5)


def _pack(columns: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    return b"".join(_planes(c, w) for c, w in zip(columns, widths))


def _unpack(blob: bytes, n: int, widths: tuple[int, ...]) -> list[np.ndarray]:
    view, out = memoryview(blob), []
    for w in widths:
        out.append(_unplanes(view, n, w))
        view = view[n * w :]
    return out


def _dealt(groups: np.ndarray, columns: list[np.ndarray], pack) -> pa.RecordBatch:
    """One row for each group that occurs, with its entries packed."""
    order = np.argsort(groups, kind="stable")
    groups, columns = groups[order], [c[order] for c in columns]
    at = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]]) if len(groups) else np.zeros(1, np.int64)
    blobs = [pack([c[a:b] for c in columns]) for a, b in zip(at[:-1], at[1:])]
    kinds = [pa.array(groups[at[:-1]], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(kinds, ["grp", "n", "blob"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE bytes of text, so that a task's memory does not depend on its batches."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text").cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
            yield batch.slice(at, end - at)
            at = end


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a batch's texts end to end, and where they begin; null texts are empty."""
    column = batch.column("text").cast(pa.binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def _first_pass(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        data, starts = _texts(batch)
        text, place, digit, context = suffixes(data, starts)
        ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
        tags = np.asarray(batch.column("tag").to_numpy(zero_copy_only=False), np.int64)
        columns = [digit, context, ids[text].view(np.uint64), tags[text].view(np.uint64), place]
        yield _dealt(_group_of(digit, groups), columns, lambda c: _pack(c, _WIDTHS))


_FLAGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("entry", T.LongType())])


def _flagged(ids: np.ndarray, tags: np.ndarray, entries: np.ndarray) -> pa.Table:
    kinds = [pa.array(ids.view(np.int64)), pa.array(tags.astype(np.uint32).view(np.int32)), pa.array(entries.astype(np.int64))]
    return pa.table(kinds, names=["doc_id", "tag", "entry"])


def _blobs(table: pa.Table, widths: tuple[int, ...]) -> list[np.ndarray]:
    parts = [_unpack(blob.as_py(), n.as_py(), widths) for blob, n in zip(table.column("blob"), table.column("n"))]
    return [np.concatenate(x) for x in zip(*parts)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each of the sorted rows is in."""
    new = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _sort_first(table: pa.Table) -> pa.Table:
    """Entries of one group of first digits: (document, place << AROUND | mask of repeated windows).

    Mask 0 marks a suffix whose windows the second pass has to sort.
    """
    digit, context, ids, tags, place = _blobs(table, _WIDTHS)
    ids = ids.view(np.int64)
    order = np.lexsort((ids, context, digit))
    digit, context, ids, tags, place = (x[order] for x in (digit, context, ids, tags, place))
    same = _runs(digit, context)
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(same)) + 1])
    least = ids[firsts][same]
    repeated = ids > least
    # grams around which a smaller document stands in another context
    gram = _runs(digit)
    low = np.full(gram[-1] + 1, np.iinfo(np.int64).max)
    high = np.full(gram[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, gram, least)
    np.maximum.at(high, gram, least)
    open_ = ~repeated & (low < high)[gram]
    keep = repeated | open_
    return _flagged(ids[keep], tags[keep], (place[keep].astype(np.int64) << AROUND) | np.where(repeated[keep], EVERY, 0))


_CONTEXT_WIDTHS = (8, 4, 5, 1, 1)


def _contexts(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """The bytes around the suffixes of ``entries``, dealt by their first digit again."""
    for batch in _slices(batches):
        data, starts = _texts(batch)
        lists = batch.column("entries")
        text = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) >> AROUND
        ids = np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)[text]
        tags = np.asarray(batch.column("tag").to_numpy(zero_copy_only=False), np.int64)[text]
        left = np.minimum(REACH, place)
        right = np.minimum(REACH, starts[text + 1] - starts[text] - place - DIGIT)
        padded = np.pad(data, REACH)
        around = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[starts[text] + place] if len(text) else np.zeros((0, CONTEXT), np.uint8)
        gram = _mix(_linear(around[:, REACH : REACH + DIGIT], 1))
        columns = [ids.view(np.uint64), tags.view(np.uint64), place, left, right, around]
        yield _dealt(_group_of(gram, groups), columns, lambda c: _pack(c[:5], _CONTEXT_WIDTHS) + c[5].tobytes())


@lru_cache(maxsize=4)
def _factors(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, size, np.uint64) | _ONE


def _linear(rows: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each row of bytes: a sum of products with random odd factors."""
    out = np.zeros(len(rows), np.uint64)
    for i, f in enumerate(_factors(rows.shape[1], seed)):
        out += (rows[:, i].astype(np.uint64) + _ONE) * f
    return out


def _sort_windows(table: pa.Table) -> pa.Table:
    """Entries of the windows around the suffixes of one group that a smaller document holds too."""
    parts = []
    for blob, n in zip(table.column("blob"), table.column("n")):
        raw, n = blob.as_py(), n.as_py()
        around = np.frombuffer(raw, np.uint8, n * CONTEXT, len(raw) - n * CONTEXT).reshape(n, CONTEXT)
        parts.append([*_unpack(raw, n, _CONTEXT_WIDTHS), around])
    ids, tags, place, left, right, around = (np.concatenate(x) for x in zip(*parts))
    ids, masks = ids.view(np.int64), np.zeros(len(ids), np.int64)
    for j in range(AROUND):
        held = np.flatnonzero((j >= REACH - left.astype(np.int64)) & (j <= right.astype(np.int64)))
        if len(held) < 2:
            continue
        window = _mix(_linear(around[held, j : j + THRESHOLD], 2))
        _, which = np.unique(window, return_inverse=True)
        least = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[held])
        masks[held[ids[held] > least[which]]] |= 1 << j
    keep = masks != 0
    return _flagged(ids[keep], tags[keep], (place[keep].astype(np.int64) << AROUND) | masks[keep])


def covered(text: bytes, entries: np.ndarray) -> np.ndarray:
    """Which bytes of ``text`` lie in a repeated window."""
    data = np.frombuffer(text, np.uint8)
    by_place = np.zeros(len(data), np.int64)
    np.bitwise_or.at(by_place, entries >> AROUND, entries & EVERY)
    gram = window_grams(data)
    # window j around a gram begins REACH - j bytes before it
    begins = np.arange(len(gram))
    repeated = (by_place[gram] >> (begins - gram + REACH)) & 1
    edge = np.zeros(len(data) + 1, np.int64)
    edge[: len(gram)] += repeated
    edge[THRESHOLD : THRESHOLD + len(gram)] -= repeated
    return np.cumsum(edge[:-1]) > 0


_RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def _results(texts: pd.Series, entries: pd.Series, with_text: bool) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, entries):
        text, removed, spans, kept = text or b"", 0, 0, text or b""
        if found is not None and len(found):
            gone = covered(text, np.asarray(found, np.int64))
            removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        rows.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    return pd.DataFrame(rows, columns=_RESULT.names)


@F.pandas_udf(_RESULT)
def _figures(texts: pd.Series, entries: pd.Series) -> pd.DataFrame:
    return _results(texts, entries, False)


@F.pandas_udf(_RESULT)
def _figures_and_text(texts: pd.Series, entries: pd.Series) -> pd.DataFrame:
    return _results(texts, entries, True)


def repeated_entries(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, tag, entries) of the documents of ``docs(doc_id, tag, text)`` that repeat a smaller one."""
    told = docs.where("doc_id is not null and text is not null")
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(16, -(-size // group))
    dealt = told.mapInArrow(lambda b: _first_pass(b, groups), "grp long, n long, blob binary")
    flags = common.stage(dealt.groupBy("grp").applyInArrow(_sort_first, _FLAGS), "first-pass")
    mask = F.col("entry").bitwiseAND(EVERY)
    entries = F.collect_list("entry").alias("entries")
    unsure = flags.where(mask == 0).groupBy("doc_id", "tag").agg(entries)
    around = told.join(unsure, ["doc_id", "tag"]).select("doc_id", "tag", "text", "entries")
    dealt = around.mapInArrow(lambda b: _contexts(b, groups), "grp long, n long, blob binary")
    more = common.stage(dealt.groupBy("grp").applyInArrow(_sort_windows, _FLAGS), "second-pass")
    return flags.where(mask != 0).unionByName(more).groupBy("doc_id", "tag").agg(entries)


def dedup(docs: DataFrame, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs(doc_id, text)``.

    Null texts are empty. A row with a null id is neither smaller nor larger than others: it keeps
    all its bytes and removes none elsewhere. Rows of one id don't remove from each other. Rows
    come back as often as they came. ``with_text`` adds ``kept``, the remaining bytes.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("tag"), text.cast("binary").alias("text"))
    entries = repeated_entries(rows, group)
    found = rows.join(entries, ["doc_id", "tag"], "left")
    figures = (_figures_and_text if with_text else _figures)("text", "entries").alias("r")
    names = _RESULT.names if with_text else _RESULT.names[:-1]
    return found.select("doc_id", figures).select("doc_id", *[f"r.{n}" for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents", "doc_id", "text"))
