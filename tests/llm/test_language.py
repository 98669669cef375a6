from __future__ import annotations

import random

import numpy as np

from sealwright.llm import common, language


def slow_grams(text, n=4):
    padded = " " * (n - 1) + "".join(c if c.isalpha() else " " for c in text.lower()) + " " * (n - 1)
    return [g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip()]


def test_grams_are_those_of_each_text():
    texts = ["", "a", "Été, ÜBER 12 x", "İstanbul", "!!", "𐐀𐐨 deseret", "one two\nthree"]
    found, starts = language.grams(texts)
    assert len(starts) == len(texts) + 1
    alone = [language.grams([t])[0] for t in texts]
    for i, text in enumerate(texts):
        mine = found[starts[i] : starts[i + 1]]
        assert np.array_equal(mine, alone[i])
        want = slow_grams(text)
        assert len(mine) == len(want)
        assert len(set(mine.tolist())) == len(set(want))


def made(seed=3):
    rng = random.Random(seed)
    sylls = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "eng", "ild", "urf"], "cc": ["ção", "nhe", "lho", "que"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        text = " ".join("".join(rng.choice(sylls[lang]) for _ in range(3)) for _ in range(30))
        rows.append((i, text, lang, lang))
    rows += [(900, None, "aa", "aa"), (901, "", "aa", "aa"), (902, "12 !!", "bb", "bb"), (903, "x", None, None), (None, rows[0][1], None, "aa"), (904, rows[1][1], "aa", "bb")]
    return rows


def test_filter_finds_all_languages_of_a_gram_and_corrects_chance_hits(spark):
    docs = spark.createDataFrame([r[:3] for r in made()], "doc_id long, text string, lang string")
    teach = language.examples(docs)
    model = language.train(teach)
    assert model.langs == ["aa", "bb", "cc"]
    sets = {}
    for r in language.gram_sets(teach.where("text is not null and lang is not null")).collect():
        sets.setdefault(r.lang, set()).add(r.gram)
    every = np.array(sorted(set.union(*sets.values())), np.int64).view(np.uint64)
    masks = model.languages(every, 0)
    for gram, mask in zip(every.view(np.int64).tolist(), masks.tolist()):
        for i, lang in enumerate(model.langs):
            if gram in sets[lang]:
                assert mask >> i & 1
    strange = language.grams(["zyxwv qpon " * 400])[0]
    rng = np.random.default_rng(1)
    strange = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)
    hits = [((model.languages(strange, 0) >> np.uint64(i)) & np.uint64(1)).mean() for i in range(3)]
    assert np.allclose(hits, model.false, atol=0.01)


def test_predictions(spark):
    rows = made()
    docs = spark.createDataFrame([(*r[:3], "row") for r in rows], "doc_id long, text string, lang string, score string")
    found = language.identify(docs, language.train(language.examples(docs))).select("row.doc_id", "row.text", "lang_pred", "score").collect()
    assert len(found) == len(rows)
    truth = {r[0]: r[3] for r in rows}
    for r in found:
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert 0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "cc")
            if r.doc_id not in (903,):
                assert r.lang_pred == truth[r.doc_id]


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    for table in (docs, docs.limit(0)):
        model = language.train(language.examples(table))
        assert [(r.lang_pred, r.score) for r in language.identify(table, model).collect()] == [("und", 0.0)] * table.count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in language.query(spark, sf).collect() if r.held_out]
    assert len(held) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_fold_is_the_stated_one(spark):
    import zlib

    rows = spark.range(50).select("id", common.fold(common.F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
