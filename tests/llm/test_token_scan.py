from __future__ import annotations

import random

import numpy as np
import pytest

from sealwright.llm import token_scan, tokens


def slow(stream, end):
    out, start, n = [], 0, 0
    for i, x in enumerate(stream):
        if x == end:
            out.append((n, start))
            start, n = i + 1, 0
        else:
            n += 1
    return out + ([(n, start)] if n else [])


def streams():
    rng = random.Random(8)
    made = {f"f{k}": [9 if rng.random() < p else rng.randrange(9) for _ in range(n)] for k, (n, p) in enumerate([(5000, 0.05), (700, 0.0), (300, 1.0), (1, 0.0), (64, 0.02)])}
    return made | {"ends": [1, 2, 9], "one": [9]}


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_counts_over_blocks(spark, size):
    made, rows = streams(), []
    for file, stream in made.items():
        data = np.array(stream, "<u2").tobytes()
        rows += [(file, i, data[at : at + 2 * size], "x") for i, at in enumerate(range(0, len(data), 2 * size))]
    rows += [("nothing", 0, b"", "x"), ("nothing", 1, None, "x")]
    if size == 1:
        rows = [r for r in rows if r[0] != "f0"]
        made.pop("f0")
    blocks = spark.createDataFrame(rows, "file string, block long, data binary, before string")
    got = sorted((r.file, r.ordinal, r.n_tokens, r.start) for r in token_scan.count_tokens(blocks, end=9).collect())
    want = sorted((f, i, n, s) for f, stream in made.items() for i, (n, s) in enumerate(slow(stream, 9)))
    assert got == want


def test_flat_files_of_any_length(spark, tmp_path):
    made = streams()
    for file, stream in made.items():
        np.array(stream, "<u2").tofile(tmp_path / f"{file}.bin")
    blocks = token_scan.read_blocks(spark, str(tmp_path), block=100)
    got = sorted((r.file.rsplit("/", 1)[1][:-4], r.ordinal, r.n_tokens) for r in token_scan.count_tokens(blocks, end=9).collect())
    assert got == sorted((f, i, n) for f, stream in made.items() for i, (n, _) in enumerate(slow(stream, 9)))


def test_documents_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    tokenizer.encode_special_tokens = True
    rows = [(i, " ".join(f"Word{i % 7} é{k}" for k in range(i * 13 % 400))) for i in range(60)]
    rows += [(None, "no id"), (70, None), (71, ""), (72, "<|endoftext|> in text"), rows[3], rows[3], (73, "long " * 40_000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, ordinal string").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens) for r in token_scan.document_tokens(docs, block=512).collect())
    want = sorted(((i if i is not None else -1), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert got == want
    assert token_scan.document_tokens(docs.limit(0)).collect() == []
