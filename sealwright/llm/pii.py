"""Operator 3, personal data: base patterns, and terms that disclose a protected entity.

Emails, addresses, card and telephone numbers found by pattern hold the protected entities: each value, the class that
it belongs to (domain, network, issuer, area), and its kind. Values hardly ever come back, but classes and
kinds do, so the corpus can tell which terms go with them. A term of a text that holds an entity discloses it when
its pointwise mutual information with the entity, over the whole corpus, reaches DISCLOSURE of the entity's own
information content: ``ln(n(t,e) N / (n(t) n(e))) >= DISCLOSURE * ln(N / n(e))``; and when the different texts that hold
both give evidence beyond chance: their number times that information reaches ``ln(M / CHANCE)`` for the M terms of
the corpus. The evidence asked for grows with the logarithm of the corpus, and no count is cut off. A disclosing term is
generalised to its first letters when they do not disclose the entity themselves, else removed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwright.llm import common

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information that a term may give, and the chance of one false term in the whole corpus.
DISCLOSURE, CHANCE = 0.8, 0.01
#: Letters that a generalised term keeps.
LETTERS = 3
#: Digits of a card or telephone number, and parts of an address, that make its class.
ISSUER, AREA, NETWORK = 6, 3, 2
#: Bits of the fixed-size filter of disclosing terms (2 MB), and entries of a task's counts before it hands them on.
FILTER_BITS, HELD = 24, 200_000

# The patterns of the base.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Runs of local characters before an @ with a domain after it; the scan is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            # a run before this @ can't reach over it
            free = at + 1
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, entity) of the base, by kind and start; offsets in code points."""
    text = text or ""
    found = []
    if "@" in text:
        found += [(0, a, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((1, m.start(), m.end(), ".".join(p or "0" for p in parts)))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 9 <= len(digits) <= 15:
                found.append((3, m.start(), m.end(), digits))
    return found


def _named(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def entities_of(spans: list[tuple[int, int, int, str]]) -> set[str]:
    """The values that spans of the base hold, their classes and their kinds."""
    out = set()
    for k, _, _, value in spans:
        kind = KINDS[k]
        part = value.split("@")[-1] if k == 0 else ".".join(value.split(".")[:NETWORK]) if k == 1 else value[: ISSUER if k == 2 else AREA]
        out |= {kind, f"{kind}/{part}", f"{kind}:{value}"}
    return out


@F.pandas_udf(T.StructType([T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("base", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType()))]))
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = base_spans(text)
        rows.append(([sum(s[0] == k for s in spans) for k in range(len(KINDS))], _named(spans), sorted(entities_of(spans))))
    return pd.DataFrame(rows, columns=["counts", "base", "entities"])


def general(term: str) -> str:
    """The class of terms that begin like ``term``."""
    return term[:LETTERS] + "*"


def _masked(text: str) -> str:
    """``text`` with blanks for base spans, at equal offsets; built once from what lies between them."""
    out, done = [], 0
    for a, b in sorted((a, b) for _, a, b, _ in base_spans(text)):
        if b > done:
            out += [text[done : max(a, done)], " " * (b - max(a, done))]
            done = b
    return "".join([*out, text[done:]])


def terms(text: str | None) -> set[str]:
    """Terms of a text and their classes."""
    words = {w.lower() for w in set(_WORD.findall(text or ""))}
    return words | {general(w) for w in words}


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema)], [name for name, _ in schema])


_PAIR = [("entity", pa.string()), ("term", pa.string()), ("n_both", pa.int64()), ("texts", pa.int64())]
_COUNT = [("term", pa.string()), ("n", pa.int64())]
_HIT = [("digest", pa.string()), ("entity", pa.string()), ("term", pa.string())]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, n_both, texts) of a task's different texts, added up as they come."""
    held: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for text, entities, copies in zip(*(batch.column(c).to_pylist() for c in ("text", "entities", "copies"))):
            for term in terms(_masked(text)):
                for entity in entities:
                    mine = held.setdefault((entity, term), [0, 0])
                    mine[0] += copies
                    mine[1] += 1
            if len(held) > HELD:
                yield _batch(_PAIR, [(*k, *v) for k, v in held.items()])
                held = {}
    if held:
        yield _batch(_PAIR, [(*k, *v) for k, v in held.items()])


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): texts of a task that hold each term, added up as they come."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(terms(text))
            if len(seen) > HELD:
                yield _batch(_COUNT, list(seen.items()))
                seen = Counter()
    if seen:
        yield _batch(_COUNT, list(seen.items()))


def _bit(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode()) >> (64 - FILTER_BITS)


def _filter(wanted: DataFrame) -> np.ndarray:
    """A filter of fixed size of ``wanted(term)``; it lets others through, but none of them out."""
    bit = F.pandas_udf(lambda s: pd.Series([_bit(t) for t in s], dtype="int64"), T.LongType())
    placed = wanted.select(bit("term").alias("b"))
    cells = placed.groupBy(F.shiftright("b", 3).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, cast(b & 7 as int))")).alias("m")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in cells:
        bits[r.cell] = r.m
    return bits


def _hits(held):
    """(digest, entity, term) of the terms that the filter ``held`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            rows = []
            for digest, text, entities in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "entities"))):
                found = [t for t in terms(_masked(text)) if bits[(at := _bit(t)) >> 3] >> (at & 7) & 1]
                rows += [(digest, e, t) for t in found for e in entities]
            yield _batch(_HIT, rows)

    return run


def disclosing(docs: DataFrame, found: DataFrame, share: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """(digest, terms): terms to sanitise in each different text with an entity, with what replaces them.

    ``found(digest, text, entities)`` holds the texts with entities, digest null for all others. An entity of one text has
    less evidence than is asked for, ``ln N < ln(M / chance)`` as M is at least N, so its pairs are not made.
    """
    texts = found.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies"))
    texts = common.stage(texts, "texts-with-entities")
    single = texts.select("digest", "copies", F.explode("entities").alias("entity"))
    entities = single.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") > 1)
    entities = common.stage(entities.select("entity", "n_entity"), "entities")
    repeated = single.join(entities, "entity").groupBy("digest").agg(F.collect_list("entity").alias("entities"))
    held = common.stage(texts.drop("entities").join(repeated, "digest"), "entity-texts")
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_occurring, "term string, n long")
    counts = common.stage(counts.groupBy("term").agg(F.sum("n").alias("n_term")), "terms")
    total = max(1, found.count())
    asked = math.log(max(counts.count(), total) / chance)
    pairs = held.select("text", "entities", "copies").mapInArrow(_pairs, "entity string, term string, n_both long, texts long")
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n_both").alias("n_both"), F.sum("texts").alias("texts")).join(entities, "entity")
    own = F.log(F.lit(float(total)) / F.col("n_entity"))
    # a term tells no more of an entity than the entity itself
    pairs = pairs.where((F.col("texts") * own >= asked) & (F.col("n_entity") < total))
    mutual = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    told = pairs.join(counts, "term").where((mutual >= share * own) & (F.col("texts") * mutual >= asked)).select("entity", "term")
    is_class = F.col("term").endswith("*")
    told = common.stage(told, "told")
    words = told.where(~is_class).withColumn("class", F.concat(F.substring("term", 1, LETTERS), F.lit("*")))
    closed = told.where(is_class).select("entity", F.col("term").alias("class"), F.lit(True).alias("closed"))
    chosen = words.join(closed, ["entity", "class"], "left").select("entity", "term", F.when(F.col("closed"), F.lit("")).otherwise(F.col("class")).alias("becomes"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(words.select("term").distinct()))
    seen = held.select("digest", "text", "entities").mapInArrow(_hits(bits), "digest string, entity string, term string")
    # an entity may let a term be generalised and another of the same text need it removed
    hit = seen.join(chosen, ["entity", "term"]).groupBy("digest", "term").agg(F.min("becomes").alias("becomes"))
    by_text = hit.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "becomes"))).alias("terms"))
    return common.stage(by_text.join(texts.select("digest", "text"), "digest").select("digest", "terms", _term_spans("text", "terms").alias("term_spans")), "disclosing")


def term_spans(text: str, chosen: dict[str, str]) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(_masked(text)) if m.group().lower() in chosen]


@F.pandas_udf(T.StringType())
def _term_spans(texts: pd.Series, chosen: pd.Series) -> pd.Series:
    return pd.Series([",".join(f"{TERM}:{a}:{b}" for a, b in term_spans(t, dict(c))) for t, c in zip(texts, chosen)], dtype=object)


def sanitised(text: str, chosen: dict[str, str] | None) -> str:
    """``text`` with its base spans named by kind and its disclosing terms generalised or removed.

    Where spans overlap, the one that begins first is replaced together with what it covers.
    """
    spans = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b, _ in base_spans(text)]
    if chosen:
        spans += [(m.start(), m.end(), chosen[m.group().lower()]) for m in _WORD.finditer(_masked(text)) if m.group().lower() in chosen]
    out, done = [], 0
    for a, b, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= done:
            out += [text[done:a], name]
        done = max(done, b)
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _sanitised(texts: pd.Series, chosen: pd.Series) -> pd.Series:
    return pd.Series([sanitised(t, dict(c) if c is not None else None) for t, c in zip(texts, chosen)], dtype=object)


def _found(rows: DataFrame) -> DataFrame:
    scanned = rows.withColumn("scan", _scan(F.col("text").cast("string")))
    some = F.size("scan.entities") > 0
    kept = {"digest": F.when(some, F.sha2(F.col("text").cast("string"), 256)), "text": F.when(some, F.col("text").cast("string"))}
    return scanned.withColumns({"counts": F.col("scan.counts"), "base": F.col("scan.base"), "entities": F.col("scan.entities"), **kept}).drop("scan")


def detect(docs: DataFrame) -> DataFrame:
    """Counts, base digest and all spans of every row of ``docs(doc_id, text)``.

    A null text is empty. Equal rows come back as often as they came. Spans of terms follow those
    of the base and carry the kind ``term``.
    """
    found = common.stage(_found(docs.select("doc_id", "text")), "personal")
    terms_of = disclosing(docs, found).select("digest", "term_spans")
    joined = found.drop("text", "entities").join(terms_of, "digest", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("term_spans") != "", F.col("term_spans")))
    counts = [F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), spans.alias("spans"))


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; rows without an entity, and all other columns, stay as they were."""
    named = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    rows = common.stage(_found(named), "scanned")
    terms_of = disclosing(docs.select("text"), rows.select("digest", "text", "entities")).select("digest", "terms")
    plain = rows.where("digest is null").select("row")
    held = rows.where("digest is not null").join(terms_of, "digest", "left")
    held = held.select(F.col("row").withField("text", _sanitised("text", "terms")).alias("row"))
    return plain.select("row.*").unionByName(held.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.read(spark, sf_dir, "documents", "doc_id", "text"))
