"""Texts taken apart chunk by chunk give the rows of the whole text, wherever the chunks end."""

from __future__ import annotations

import json
import random

import pytest

from sealwright.functions import chunks, json_walk


def spliced(frame, arrays):
    """The text again: the arrays of the frame, filled."""
    out, at, depth, quoted, skip, nth = [], 0, 0, False, False, -1
    for ch in frame:
        out.append(ch)
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "[{":
            depth += 1
            if depth == 2 and ch == "[":
                nth += 1
                out.append(",".join(arrays.get(nth, [])))
        elif not quoted and ch in "]}":
            depth -= 1
    return "".join(out)


def value(rng, depth):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return rng.choice(['a"b', "\\", "\\\\\"", "[{,}]", "é 😀", "", "x" * 30, "\n\t"])
    if kind == 1:
        return rng.randrange(-50, 1000)
    if kind in (2, 3):
        return rng.choice([None, True, 1.5])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(["k", "é", 'q"', "a/b", "[]"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(5))}


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_json_of_any_shape(spark, size):
    rng = random.Random(size)
    texts = [json.dumps({f"m{i}": value(rng, 1) for i in range(rng.randrange(6))}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(60)]
    texts += ["", "[]", "[[1,2],[],[ ]]", '{"a":[]}', '{"a":[ ],"b":[[],[]]}', '{"a":[1,]}', '{"a":[,]}', "]]}}[[[1],2", '{"a":["\\\\\\\\\\\\"]}', '"', '{"a":[1', '{"a" [1]}', "{\\\"}", '{"e":[{"x":"]"},{"x":"\\""}],"e":[3]}']
    table = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    parts = {}
    for r in chunks.json_parts(chunks.as_chunks(table, ["doc"], size=size), ["doc"]).collect():
        parts.setdefault(r.doc, {}).setdefault(r.array, {})[r.pos] = r.text
    for doc, text in enumerate(texts):
        arrays = dict(parts[doc])
        frame = arrays.pop(-1)[0]
        spaced = any(rows.pop(-1, None) for rows in arrays.values())
        elements = {a: [rows[i] for i in range(len(rows))] for a, rows in arrays.items()}
        told = json_walk._part(frame)
        valid = told[0] and all(json_walk._part(e)[0] for rows in elements.values() for e in rows)
        assert valid == json_walk._part(text)[0], text
        if valid:
            assert json.loads(spliced(frame, elements)) == json.loads(text)
            whole = json.loads(text)
            lists = [v for v in (whole.values() if isinstance(whole, dict) else whole if isinstance(whole, list) else []) if isinstance(v, list)]
            if json_walk._part(text)[2] is False:
                assert [[json.loads(e) for e in elements.get(k, [])] for k in range(len(lists))] == lists and len(told[4]) == len(lists)
            assert json_walk._part(text)[1] == (told[1] and not spaced and all(json_walk._part(e)[1] for rows in elements.values() for e in rows))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_lines(spark, size):
    texts = ["", "a", "a\n", "\n\n", "one\ntwo\r\nthree", "x" * 40 + "\n" + "y" * 7 + "\n", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = sorted((r.doc, r.pos, r.line, r.last) for r in chunks.lines(chunks.as_chunks(table, ["doc"], size=size), ["doc"]).collect())
    want = [(d, k, line, k == (t or "").count("\n")) for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))]
    assert got == want


def test_chunks_given_by_number(spark):
    table = spark.createDataFrame([("s", 1, "b]}"), ("s", 0, '{"x":[1,')], "scope string, chunk long, text string")
    got = sorted((r.array, r.pos, r.text) for r in chunks.json_parts(chunks.as_chunks(table, ["scope"]), ["scope"]).collect())
    assert got == [(-1, 0, '{"x":[]}'), (0, 0, "1"), (0, 1, "b")]
