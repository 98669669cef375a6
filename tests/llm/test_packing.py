from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sealwright.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


ODD = ["", " ", "it's 'twas I'LL ̈x", "é é Å", "a b c\x1cd", "<|endoftext|> a<|startoftext|>b", "x" * 3000, "1234 5.6,7", "ΣΑΣ İ ǅ", "漢字かな😀😀", "a​b﻿c", "don'T́"]


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(3)
    alphabet = "aBc'sS 12.é́\n\t <|>ΣİÅ漢😀"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    got = tokens.Encoder(tokens.default_tokenizer())
    for text in texts:
        assert np.frombuffer(got.encode(text.encode()), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_kept_chunks_are_renewed(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "KEPT", 50)
    got = tokens.Encoder(tokens.default_tokenizer())
    for i in range(60):
        text = " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))
        assert np.frombuffer(got.encode(text.encode()), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cuts_tile_a_queue():
    rng = random.Random(5)
    for _ in range(200):
        queue, shard = rng.randrange(1, 3000), rng.choice([1, 7, 64, 1000])
        total, at, all_ = queue + rng.randrange(0, 9000), 0, []
        while at < queue:
            n = min(queue - at, rng.randrange(1, 400))
            found = packing.cuts(at, n, queue, total, shard)
            assert [c[1] for c in found] == [sum(x[2] for x in found[:k]) for k in range(len(found))] and sum(c[2] for c in found) == n
            all_ += found
            at += n
        assert [c[0] for c in all_] == sorted(c[0] for c in all_)
        for k, _, n, place in all_:
            assert k * shard * queue // total <= place and place + n <= (k + 1) * shard * queue // total


def test_windows_keep_target_shares():
    queues = [packing._Queue([(100 * q + i, 0, 50) for i in range(n)], 50 * n / 30_000, 0.0, 50 * n) for q, n in enumerate((300, 200, 100))]
    filled = defaultdict(lambda: [0, 0, 0])
    for rid, _, n, window, _ in packing.round_robin(queues):
        filled[window][min(2, rid // 100 if rid < 300 else 2)] += 0
    queues = [packing._Queue([(q, 50 * i, 50) for i in range(n)], 50 * n / 30_000, 0.0, 50 * n) for q, n in enumerate((300, 200, 100))]
    for q, _, n, window, _ in packing.round_robin(queues):
        filled[window][q] += n
    for window in range(30_000 // packing.WINDOW):
        assert sum(filled[window]) == packing.WINDOW
        assert all(abs(n - packing.WINDOW * s) <= 2 for n, s in zip(filled[window], (1 / 2, 1 / 3, 1 / 6)))


def rows_of():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma's", "x1", "Δ", "word"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))), rng.choice(["a", "b", "hot", "hot", None])) for i in range(250)]
    rows += [(i, t, None) for i, t in enumerate(ODD)] + [(None, "null id", "a"), (3, None, "b"), rows[4], rows[4]]
    return rows + [(999, " ".join(rng.choice(words) for _ in range(30_000)), "hot")]


def test_every_id_is_packed_once(spark, tokenizer):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, rid int")
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows]
    for shard in (1 << 14, packing.SHARD):
        found = packing.pack(docs, shard=shard).collect()
        assert sum(r.length for r in found) == sum(map(len, ids))
        by_sequence = defaultdict(list)
        for r in found:
            by_sequence[r.sequence_id].append((r.offset, r.length))
        padding = 0
        for parts in by_sequence.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            size = sum(n for _, n in parts)
            assert 0 < size <= packing.WINDOW
            padding += 0 if size & (size - 1) == 0 else packing.WINDOW - size
        assert padding <= 0.01 * sum(map(len, ids))
        # whole documents: pieces tile them and carry their ids
        single = {i: x for (i, t, _), x in zip(rows, ids) if [r[0] for r in rows].count(i) == 1 and i is not None}
        pieces = defaultdict(list)
        for r in found:
            pieces[r.doc_id].append(r)
        for i, x in single.items():
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(x)
                assert r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(x)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
