from __future__ import annotations

import hashlib
import math
import random
import re
import time

from sealwright.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_by_pattern():
    rng = random.Random(2)
    texts = ["", "a@b", "a@b.c@d.e", "x..@y-z.q.w.", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "0001.2.3.255", "256.1.1.1", "1.2.3.256 9.9.9.9"]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (555) 010-9999.", "++1 2345678901 x", "+1 (", "é a.b+c@d.ee ñ 10.0.0.1"]
    texts += ["".join(rng.choice("a@.1+4 -()b") for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    for text in texts:
        assert [s[:3] for s in pii.base_spans(text)] == slow(text), text


def test_long_runs_are_linear():
    for piece in ("a", "1", "a@", "1.", "+1", "1 ", "a."):
        pii.base_spans(piece * 200_000)
    assert pii.base_spans(None) == []


def texts_of_corpus():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "common", "words"]
    out = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(300)]
    for i in range(9):
        out.append(f"Zephyria met secretia {rng.choice(words)} at who{i}@x{i}.org and boss@corp.example, row {i}")
    for i in range(40):
        out.append(f"secretb{'xyz'[i % 3]}{i} other {rng.choice(words)}")
    # numbers that never come back, in texts of a kind
    out += [f"invoice{i % 2} {rng.choice(words)} dial +44 20 7946 0{i:03} {rng.choice(words)}" for i in range(14)]
    return out + [out[-50], None, "", "boss@corp.example " + "secretia beta"]


def slow_terms(corpus):
    docs = [pii.terms(pii._masked(t or "")) for t in corpus]
    plain = [pii.terms(t) for t in corpus]
    ents = [pii.entities_of(pii.base_spans(t)) for t in corpus]
    total, out = len(corpus), []
    asked = math.log(max(len(set().union(*plain)), total) / pii.CHANCE)
    for text, mine, found in zip(corpus, docs, ents):
        chosen = {}
        for e in found:
            having = [i for i in range(total) if e in ents[i]]

            def told(term):
                both = [i for i in having if term in docs[i]]
                n = sum(term in p for p in plain)
                if not both or len(having) == total:
                    return False
                mutual = math.log(len(both) * total / (n * len(having)))
                return mutual >= pii.DISCLOSURE * math.log(total / len(having)) and len({corpus[i] for i in both}) * mutual >= asked

            for t in mine:
                if not t.endswith("*") and told(t):
                    becomes = "" if told(pii.general(t)) else pii.general(t)
                    chosen[t] = min(chosen.get(t, becomes), becomes)
        out.append(chosen)
    return out


def test_entities_are_values_classes_and_kinds():
    text = "a@b.org 10.2.3.4 +44 20 7946 0001"
    assert pii.entities_of(pii.base_spans(text)) == {
        "email", "email/b.org", "email:a@b.org", "ip", "ip/10.2", "ip:10.2.3.4", "phone", "phone/442", "phone:442079460001",
    }


def test_kinds_that_no_value_repeats_are_protected(spark):
    corpus = texts_of_corpus()
    want = slow_terms(corpus)
    assert any(t.startswith("invoice") or t == "dial" for w in want for t in w)


def test_masking_is_linear():
    text = "see 10.1.2.3 or a@b.org " * 60_000
    began = time.process_time()
    masked = pii._masked(text)
    took = time.process_time() - began
    assert len(masked) == len(text) and "10.1" not in masked and "@" not in masked
    assert masked[:40] == "see          or         see          or " and took < 5


def test_detect_and_apply_against_direct_counts(spark):
    corpus = texts_of_corpus()
    rows = [(i if i % 7 else None, t, "digest") for i, t in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    want = slow_terms(corpus)
    assert any("" in w.values() for w in want) and any(v for w in want for v in w.values())
    expected, cleaned = [], []
    for (i, t, _), chosen in zip(rows, want):
        base = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in slow(t or "")]
        more = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W_]{3,}", pii._masked(t or "")) if m.group().lower() in chosen]
        expected.append((i or -1, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + more)))
        cleaned.append(pii.sanitised(t, chosen) if base else t)
    got = [(r.doc_id or -1, r.base_sha256, r.spans) for r in pii.detect(docs).collect()]
    assert sorted(got) == sorted(expected)
    out = pii.apply(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted(t or "" for t in cleaned)
    assert not any("boss@corp" in (r.text or "") or "Zephyria" in (r.text or "") for r in out.collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(empty).collect() == [] and pii.apply(empty).collect() == []
