import math
import random
from collections import Counter

import numpy as np
import pytest

from leagueflow.llm import langid as L

SF = "/root/testdata/sf0.001"


def plain_signs(text, order):
    out, last = [], 0
    for c in (text or "").lower():
        v = ord(c) if c.isalpha() else 0
        if v or last:
            out.append(v)
        last = v
    if not any(out):
        return []
    if out[-1]:
        out.append(0)
    return [0] * (order - 1) + out


def plain_model(texts, order):
    top = Counter()
    for t in texts:
        s = plain_signs(t, order)
        top.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc = {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[n] = once / (once + 2 * twice) if once and twice else 0.5

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        followers = [v for g, v in counts[n].items() if g[:-1] == gram[:-1]]
        if not followers:
            return p(gram[1:])
        total = sum(followers)
        return max(counts[n][gram] - disc[n], 0) / total + disc[n] * len(followers) / total * p(gram[1:])

    return p


def test_signs_match_plain_form():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("aBÉß 1.,\n\t京𐐀İ") for _ in range(rng.randrange(0, 30)))
        assert L.signs(t).tolist() == plain_signs(t, L.ORDER)
    assert L.signs(None).size == L.signs("12 .. 3").size == 0


def test_cross_entropy_matches_plain_kneser_ney():
    rng = random.Random(7)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(12))
    train = {"aa": [make("abcd") for _ in range(6)], "bb": [make("cdeé") for _ in range(6)]}
    counts = {}
    for lang, texts in train.items():
        counts[lang] = Counter()
        for t in texts:
            s = "".join(map(chr, L.signs(t)))
            counts[lang].update(s[i : i + L.ORDER] for i in range(len(s) - L.ORDER + 1))
    models = L.build(counts)
    probe = [make("abcdeéz") for _ in range(5)] + [None, "42", "d"]
    h, n = models.cross_entropy(probe)
    for k, lang in enumerate(models.langs):
        p = plain_model(train[lang], L.ORDER)
        for i, t in enumerate(probe):
            s = plain_signs(t, L.ORDER)
            want = [-math.log(p(tuple(s[j : j + L.ORDER]))) for j in range(len(s) - L.ORDER + 1)]
            assert n[i] == len(want)
            assert h[i, k] == pytest.approx(np.mean(want) if want else 0.0, rel=1e-4)


def test_a_long_text_is_scored_whole(monkeypatch):
    models = L.build({"x": Counter({"aaab": 2, "aabc": 1, "abca": 1}), "y": Counter({"\0\0\0c": 1})})
    text = "abca ccab " * 500
    whole = models.cross_entropy([text, "ab"])
    monkeypatch.setattr(L, "BLOCK", 64)
    pieces = models.cross_entropy([text, "ab"])
    assert (whole[1] == pieces[1]).all() and np.allclose(whole[0], pieces[0])


def test_held_out_accuracy_and_determinism(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = L.op5_language_id(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows)
    again = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.op5_language_id(spark, SF).repartition(3).collect()}
    assert again == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in rows}


def test_rejects_what_is_no_language(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = L.learned_models(docs)
    rng = random.Random(2)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate([*junk, None, "", "123 456", "  "])]
    out = L.identify(frame(rows, extra=True), models).collect()
    assert all(r.rejected for r in out)
    assert [r.lang_pred for r in out][5:] == ["und"] * 4 and [r.score for r in out][5:] == [0.0] * 4


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' AS score", "'y' AS rejected")
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert set(r.score for r in kept.collect()) == {"x"}


def test_nothing_to_learn_from(frame):
    for rows in ([], [(1, "some text", None), (None, "more text", "en")]):
        models = L.learned_models(frame(rows))
        assert models.langs == []
        out = L.identify(frame(rows), models).collect()
        assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in out) and len(out) == len(rows)


def test_a_language_without_calibration_documents_gets_the_pooled_bound():
    models = L.Models(["aa", "bb", "cc"], 3, [], np.zeros(3))
    h = np.array([[2.0, 3.0, 3.0]] * 50 + [[3.0, 2.2, 3.0]] * 50)
    L.calibrate(models, h, np.full(100, 2.9), ["aa"] * 50 + ["bb"] * 50)
    assert models.reject.tolist() == pytest.approx([2.45, 2.55, 2.55])
    L.calibrate(models, h, np.full(100, 1.0), ["aa"] * 50 + ["bb"] * 50)
    assert np.isinf(models.reject).all()
