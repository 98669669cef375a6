"""A strict walk through JSON texts: one row for each value, with its place, type and members.

One Arrow pass reads every text once and keeps nothing of it but rows. What a text has to look like is a small
table of rules (:class:`Rule`) that is joined to these rows: types, exact members, patterns, allowed values. Rules over
lists (order, repetition, overlap) work on :func:`lists`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import contract as c
from ..session import stored
from . import batches as arrow_batches

#: Type of the one row of a text that is no JSON.
INVALID = "invalid"
_FIELDS = "at string, path string, parent string, array string, index long, type string, value string, members array<string>, n long, repeated boolean, canonical boolean"


class _Object(list):
    """Members of an object as they are written."""


class _Number(str):
    """A number as it is written."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse(text: str):
    """The value of a strict JSON text: objects as lists of members, numbers as texts of their own type."""
    value = json.loads(text, object_pairs_hook=_Object, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)
    if "\\ud" in text.lower():
        # half a pair has no UTF-8; an escape is the only way to write one
        canonical(value).encode()
    return value


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def canonical(value) -> str:
    """Canonical text: members in the order of UTF-16, no spaces, text unescaped beyond what JSON needs."""
    done: list[str] = []

    def write(v) -> None:
        if isinstance(v, _Object):
            done.append("{")
            for k, (name, inner) in enumerate(sorted(v, key=lambda m: m[0].encode("utf-16-be"))):
                done.append(("," if k else "") + json.dumps(name, ensure_ascii=False) + ":")
                write(inner)
            done.append("}")
        elif isinstance(v, list):
            done.append("[")
            for k, inner in enumerate(v):
                if k:
                    done.append(",")
                write(inner)
            done.append("]")
        elif isinstance(v, _Number):
            done.append(_integer(v) or "?")
        else:
            done.append(json.dumps(v, ensure_ascii=False))

    write(value)
    return "".join(done)


def _integer(token: str) -> str | None:
    """A safe integer as it has to be written; None for other numbers."""
    if len(token) > 17 or not token.lstrip("-").isdigit():
        return None
    return str(int(token)) if abs(int(token)) <= c.SAFE_INTEGER else None


_TYPES = {_Object: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}


def _type(value) -> str:
    if type(value) is _Number:
        return "integer" if value.lstrip("-").isdigit() else "number"
    return _TYPES[type(value)]


def _canonical(text: str, value) -> bool:
    if text.isascii():
        # plain texts are told by the built-in writer: names of ASCII sort alike in UTF-16, and a repeated one is lost
        odd: list[str] = []
        plain = json.loads(text, parse_float=odd.append, parse_int=lambda token: int(token) if _integer(token) == token else odd.append(token))
        if not odd and json.dumps(plain, ensure_ascii=False, separators=(",", ":"), sort_keys=True) == text:
            return True
    return canonical(value) == text


def values(text: str | None) -> list[tuple]:
    """``(at, path, parent, array, index, type, value, members, n, repeated, canonical)`` of every value, the outer one first.

    ``at`` is the value's pointer and ``path`` the same with ``[]`` for positions; ``array`` and ``index`` are of the
    nearest array around it. ``canonical`` is told of the outer value alone.
    """
    try:
        value = parse(text)
        told = _canonical(text, value)
    except (TypeError, ValueError, RecursionError):
        return [("", "", None, None, None, INVALID, None, None, None, None, None)]
    out: list[tuple] = []
    waiting = [(value, "", "", None, None, None)]
    while waiting:
        v, at, path, parent, array, index = waiting.pop()
        kind, members, n, repeated = _type(v), None, None, None
        if kind == "object":
            members = [name for name, _ in v]
            n, repeated = len(members), len(set(members)) < len(members)
            waiting += [(inner, f"{at}/{_escaped(name)}", f"{path}/{_escaped(name)}", at, array, index) for name, inner in reversed(v)]
        elif kind == "array":
            n = len(v)
            waiting += [(inner, f"{at}/{k}", f"{path}/[]", at, at, k) for k, inner in reversed(list(enumerate(v)))]
        plain = None if kind in ("object", "array", "null") else ("true" if v else "false") if kind == "boolean" else str(v)
        out.append((at, path, parent, array, index, kind, plain, members, n, repeated, None if at else told))
    return out


#: Columns of :func:`read`.
_READ = "path string, type string, value string, members array<string>, outer boolean, canonical boolean, repeated boolean, listed array<array<string>>"


def told(text: str | None, wanted: Sequence[str]) -> Iterator[tuple]:
    """Rows of :func:`read` for one text, the outer value's first."""
    try:
        value = parse(text)
        sound = _canonical(text, value)
    except (TypeError, ValueError, RecursionError):
        yield "", INVALID, None, None, True, None, None, [None] * len(wanted)
        return
    listed: dict[str, list | None] = dict.fromkeys(wanted)
    rows: list[tuple] = []
    again = False
    waiting = [(value, "", None)]
    while waiting:
        v, path, index = waiting.pop()
        kind = type(v)
        if kind is str:
            rows.append((path, "string", v, None, False, None, None, None))
            if path in listed:
                listed[path] = listed[path] or []
                listed[path].append((index, v))
        elif kind is _Object:
            members = [name for name, _ in v]
            again |= len(set(members)) < len(members)
            rows.append((path, "object", None, members, False, None, None, None))
            waiting += [(inner, f"{path}/{_escaped(name)}", index) for name, inner in reversed(v)]
        elif kind is list:
            rows.append((path, "array", None, None, False, None, None, None))
            path += "/[]"
            if path in listed:
                listed[path] = listed[path] or []
            waiting += [(v[k], path, k) for k in range(len(v) - 1, -1, -1)]
        else:
            plain = None if v is None else ("true" if v else "false") if kind is bool else str(v)
            rows.append((path, _type(v), plain, None, False, None, None, None))
    yield (*rows[0][:4], True, sound, again, [None if held is None else [v for _, v in sorted(held)] for held in listed.values()])
    yield from rows[1:]


def read(table: DataFrame, keys: Sequence[str], json_column: str, wanted: Sequence[str]) -> DataFrame:
    """Key columns, ``doc`` and, for every value of every text, its place, type and members; for rules that are told in one pass.

    What concerns a text as a whole stands with its ``outer`` value: whether it is ``canonical``, whether any object in it
    has a ``repeated`` member, and in ``listed`` the texts at each of the ``wanted`` paths, in their order (null without such a list).
    """
    names = list(keys)
    width = len(names)
    schema = T.StructType([*[table.schema[n] for n in names], T.StructField("doc", T.LongType()), *T.StructType.fromDDL(_READ)])
    arrow, paths = to_arrow_schema(schema), list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), arrow)], schema=arrow)

        for batch in batches:
            for row in arrow_batches.rows(batch):
                doc += 1
                head = (*row[:width], doc)
                for v in told(row[width], paths):
                    held.append(head + v)
                    if len(held) >= arrow_batches.BATCH_ROWS:
                        yield flush()
                        held = []
                chars += len(row[width] or "")
                if chars >= arrow_batches.BATCH_CHARS and held:
                    yield flush()
                    held, chars = [], 0
        if held:
            yield flush()

    return table.select(*names, F.col(json_column).cast("string").alias("_json")).mapInArrow(run, schema)


def dealt(table: DataFrame) -> DataFrame:
    """``table`` dealt evenly to as many tasks as a shuffle has; for short rows of a small file, each of which takes long."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def walk(table: DataFrame, keys: Sequence[str], json_column: str) -> DataFrame:
    """Key columns, ``doc`` and the columns of :func:`values` for every value of every text; stored.

    ``doc`` numbers the rows of ``table``, so that texts of one key stay apart. Null is no JSON. Short texts leave a task
    together, as a batch for each would take longer than the walk.
    """
    names = list(keys)
    width = len(names)
    schema = T.StructType([*[table.schema[n] for n in names], T.StructField("doc", T.LongType()), *T.StructType.fromDDL(_FIELDS)])
    arrow = to_arrow_schema(schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row in arrow_batches.rows(batch):
                doc += 1
                yield from ((*row[:width], doc, *v) for v in values(row[width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches.batched(told(batches), arrow)

    return stored(table.select(*names, F.col(json_column).cast("string").alias("_json")).mapInArrow(run, schema), "json-values")


@dataclass(frozen=True)
class Rule:
    """What the values at ``path`` have to be; a broken rule is told by ``code`` and ``detail``."""

    path: str
    types: tuple[str, ...]
    detail: str | None
    members: tuple[str, ...] | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    code: str | None = None
    #: What stands in ``detail`` if the members are not the exact ones; else ``detail``.
    members_detail: str | None = None


def _table(nodes: DataFrame, rules: Sequence[Rule], code: str) -> DataFrame:
    """The rules as a table of a few dozen rows, broadcast."""
    rows = [(r.path, list(r.types), r.detail, sorted(r.members) if r.members is not None else None, r.pattern, list(r.allowed) if r.allowed else None, r.code or code, r.members_detail or r.detail) for r in rules]
    schema = "path string, types array<string>, detail string, wanted array<string>, pattern string, allowed array<string>, code string, members_detail string"
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, schema))


def with_rules(nodes: DataFrame, rules: Sequence[Rule], code: str) -> DataFrame:
    """All of ``nodes``, each with the rule of its path, if there is one; :func:`tests` tell on it whether the rule is broken."""
    return nodes.join(_table(nodes, rules, code), "path", "left")


def tests(rules: Sequence[Rule]) -> list[tuple[Column, Column, Column]]:
    """``(condition, code, detail)`` of a value that breaks its rule by type, pattern or allowed values, and by its members."""
    ruled, typed, text = F.col("types").isNotNull(), F.array_contains("types", F.col("type")), F.col("type") == "string"
    # each pattern as a constant, so that it is compiled once
    matches = F.lit(True)
    for pattern in sorted({r.pattern for r in rules if r.pattern is not None}):
        matches = F.when(F.col("pattern") == pattern, F.col("value").rlike(pattern)).otherwise(matches)
    value_bad = ~typed | (typed & text & F.col("pattern").isNotNull() & ~matches) | (typed & text & F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.coalesce("value", F.lit(""))))
    members_bad = (F.col("type") == "object") & F.col("wanted").isNotNull() & (F.array_sort(F.array_distinct("members")) != F.col("wanted"))
    return [
        (ruled & F.coalesce(value_bad, F.lit(True)), F.col("code"), F.col("detail")),
        (ruled & F.coalesce(members_bad, F.lit(False)), F.col("code"), F.col("members_detail")),
    ]


def broken(nodes: DataFrame, rules: Sequence[Rule], code: str) -> DataFrame:
    """Rows of ``nodes`` that break a rule, with its ``code`` and ``detail``; a row may break several."""
    met = nodes.join(_table(nodes, rules, code), "path")
    (value_bad, _, why), (members_bad, _, whose) = tests(rules)
    hits, hit = F.array(F.when(value_bad, why), F.when(members_bad, whose)), F.array(value_bad, members_bad)
    each = F.explode(F.filter(F.arrays_zip(hit.alias("bad"), hits.alias("why")), lambda x: x["bad"])).alias("_hit")
    return met.select(*nodes.columns, "code", each).select(*nodes.columns, "code", F.col("_hit.why").alias("detail"))


def lists(nodes: DataFrame, keys: Sequence[str], **paths: str) -> DataFrame:
    """Key columns, ``doc`` and an array for each of ``paths``: its text values in their order. Every text has a row."""

    def listed(path: str) -> Column:
        mine = F.when((F.col("path") == path) & (F.col("type") == "string"), F.struct("index", "value"))
        return F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["value"])

    return nodes.groupBy(*keys, "doc").agg(*[listed(path).alias(name) for name, path in paths.items()])


def ascending(listed: Column) -> Column:
    """Whether a list is in byte order and names nothing twice."""
    return (F.array_sort(listed) == listed) & (F.size(F.array_distinct(listed)) == F.size(listed))


# --- single values ------------------------------------------------------------

_PART = "valid boolean, canonical boolean, repeated boolean, keys array<string>, arrays array<string>"


def _part(text: str | None) -> tuple:
    found = values(text)
    outer = found[0]
    if outer[5] == INVALID:
        return False, None, None, None, None
    top = [v for v in found if v[2] == "" and v[5] == "array"]
    return True, outer[10], any(v[9] for v in found if v[9]), outer[7], [v[0][1:].replace("~1", "/").replace("~0", "~") for v in top]


def with_part(table: DataFrame, column: str, name: str) -> DataFrame:
    """Add (valid, canonical, repeated, keys, arrays) of a JSON column; ``arrays``: names of the arrays one level down, in their order."""

    @F.pandas_udf(_PART)
    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_part(t) for t in texts], columns=["valid", "canonical", "repeated", "keys", "arrays"])

    return table.withColumn(name, batch(F.col(column)))


def with_members(table: DataFrame, column: str, name: str, **types: str) -> DataFrame:
    """Add a struct of an object's members, strictly typed: a value of another type, or of a repeated name, is null.

    ``types`` names the members: "string", or "integer" for safe integers. ``closed`` tells whether the object has
    exactly these members.
    """
    schema = ", ".join([f"{m} {'string' if t == 'string' else 'long'}" for m, t in types.items()] + ["closed boolean"])

    def one(text: str | None) -> tuple:
        try:
            value = parse(text)
        except (TypeError, ValueError, RecursionError):
            value = None
        if not isinstance(value, _Object):
            return (*[None] * len(types), False)
        held = dict(value)
        read = [held.get(m) if _type(held.get(m)) == t else None for m, t in types.items()]
        read = [v if t == "string" or v is None else int(v) if _integer(v) else None for v, t in zip(read, types.values())]
        return (*read, len(held) == len(value) and set(held) == set(types))

    @F.pandas_udf(schema)
    def batch(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(t) for t in texts], columns=[*types, "closed"], dtype=object)
        return out.astype({m: "Int64" for m, t in types.items() if t == "integer"} | {"closed": "bool"})

    return table.withColumn(name, batch(F.col(column)))
