from __future__ import annotations

import re
from math import comb

import pytest

from sealwright.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " ", "a", "a b c", "a b c a b c", "x x x x x", "l\nl\n\n \nl ", "# $ é|<> ñ%&*", "\x1ca\x85b c\xa0d " * 4, "w " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_by_definition(text):
    assert quality.counts(text)[:5] == slow(text)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.1), (9, 10, 0.5), (10, 10, 0.5), (40, 400, 0.1), (0, 300, 0.02)])
def test_binomial_tail_is_exact(k, n, p):
    assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def slow_cutoffs(good, risk, error):
    """good: {stratum: [{rule: ratio}]}"""
    out = {}
    for stratum, rows in good.items():
        for rule in quality.RULES:
            for cut in sorted(quality.GRID, reverse=True):
                k = sum(r[rule] > cut for r in rows)
                n = len(rows)
                p = risk / len(quality.RULES)
                if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > error / (len(quality.RULES) * len(good)):
                    break
                out[stratum, rule] = cut
    return out


def test_cutoffs_and_verdicts_against_direct_computation(spark):
    clean = "The quick brown fox number {} saw a lazy dog near place {} and went on {} " * 1
    rows = []
    for i in range(3000):
        words = " ".join(f"w{(i * 37 + j * j) % 997}" for j in range(60))
        text = words + " !!" * (i % 7) + (" CAPS" * 40 if i % 50 == 0 else "") + clean.format(i, i + 1, i + 2)
        rows.append((i, text, "de" if i % 3 else None, int(i % 50 != 0)))
    rows.append((None, None, "de", 1))
    rows.append((5, rows[5][1], rows[5][2], 1))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, stratum string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(1, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels, 0.1, 0.1).collect()
    assert len(got) == len(rows)
    import zlib

    good = {}
    seen = set()
    ratios = {}
    for r in got:
        ratios[r.doc_id] = {
            "symbols": r.n_symbols / max(r.n_words, 1),
            "dup_lines": r.n_dup_lines / max(r.n_lines, 1),
            "repeats": r.n_repeat_words / max(r.n_words, 1),
            "capitals": r.n_capitals / max(r.n_letters, 1),
            "marks": r.n_marks / max(r.n_words, 1),
        }
    quality_of = {r[0]: r[3] for r in rows}
    for r in got:
        if r.doc_id is not None and quality_of[r.doc_id] == 1 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and not r.base_failed:
            good.setdefault(r.stratum, []).append(ratios[r.doc_id])
            seen.add(r.doc_id)
    cuts = slow_cutoffs(good, 0.1, 0.1)
    assert cuts
    for r in got:
        broken = [rule for rule in quality.RULES if ratios[r.doc_id][rule] > cuts.get((r.stratum, rule), 9)]
        assert r.kept == (not r.base_failed and not broken), (r, broken)
    assert sum(not r.kept for r in got) >= 60


def test_no_labels_reject_nothing_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 60, None), (2, " ".join(f"{i}!!" for i in range(80)), "x")], "doc_id long, text string, stratum string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs, none).collect()}
    assert got == {1: (True, False), 2: (False, True)}
    assert quality.judge(docs.limit(0), none).collect() == []
