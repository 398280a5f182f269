import random
import zlib

import numpy as np
import pytest

from tolmark.llm import language as L

WORDS = {"en": "the rain in spain stays mainly with that thing".split(), "de": "der regen ist über dem schönen haus und straße".split(), "es": "la lluvia en españa está señor mañana qué".split()}


def say(r, lang):
    return " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 40)))


def test_held_out_accuracy_and_rows(spark):
    r = random.Random(1)
    rows = [(k, say(r, lang), lang) for k in range(900) for lang in [r.choice(list(WORDS))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 +++ 34", "de"), (1003, say(r, "en"), None), (None, say(r, "de"), "de"), (1, rows[1][1], rows[1][2]), (1004, "the rain " * 40_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS doc", "true AS held_out", "0.5D AS score")
    model = L.train(df.where(L.F.col("doc_id").isNotNull() & ~L.held_out(L.F.col("doc_id"))), "doc_id", "text", "lang")
    got = L.predict(df, "doc_id", "text", model).collect()
    assert len(got) == len(rows)
    truth = {d: lang for d, _, lang in rows}
    for x in got:
        assert 0 <= x.score <= 1 and x.lang_pred in (*WORDS, "und")
        assert x.held_out == (None if x.doc is None else zlib.crc32(str(x.doc).encode()) % 5 == 0)
    assert {x.lang_pred for x in got if x.doc in (1000, 1001, 1002)} == {"und"}
    held = [x for x in got if x.held_out and x.doc < 900]
    assert sum(x.lang_pred == truth[x.doc] for x in held) >= 0.98 * len(held)
    assert np.mean([x.score for x in held]) > 0.9
    assert (model.weights == 0).mean() > 0.5  # sparse
    nothing = L.train(df.limit(0), "doc_id", "text", "lang")
    assert {x.lang_pred for x in L.predict(df, "doc_id", "text", nothing).collect()} == {"und"}
    assert L.predict(df.limit(0), "doc_id", "text", model).count() == 0


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    p = r.dirichlet([0.7, 0.7, 0.7], 4000)
    target = np.array([r.choice(3, p=x) for x in p])
    assert abs(L.temperature(3 * np.log(p), target) - 3) < 0.3


def by_hand(text):
    """Features as a dictionary, one n-gram at a time."""
    mask, out = 0xFFFFFFFF, {}
    points = [ord(c.lower()) if c.isascii() else ord(c) for c in text]
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            h = 1
            for c in points[k : k + n]:
                h = (h * 0x9E3779B1 + c) & mask
            h = ((h ^ (h >> 15)) * 2_246_822_519) & mask
            h = ((h ^ (h >> 13)) * 3_266_489_917) & mask
            out[(h ^ (h >> 16)) >> (32 - L.BITS)] = out.get((h ^ (h >> 16)) >> (32 - L.BITS), 0) + 1
    return out


def test_features_and_predictions_by_hand(monkeypatch):
    import math
    import random

    import numpy as np

    r = random.Random(3)
    texts = ["", "a", "ab", "Straße", "漢字仮名", "Ελλάδα и Москва"] + ["".join(r.choice("abC é字Ж") for _ in range(n)) for n in (2, 3, 50, 300)]
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(L, "AT_ONCE", size)
        for t in texts:
            assert dict(zip(*(x.tolist() for x in L.features(t)))) == by_hand(t)
    monkeypatch.undo()
    idf = np.random.default_rng(1).random(L.FEATURES) + 0.1
    weights = np.random.default_rng(2).normal(size=(L.FEATURES + 1, 3))
    model = L.Model(["de", "en", "fr"], idf, weights, 0.7)
    for t in texts[1:]:
        x = {f: (1 + math.log(c)) * idf[f] for f, c in by_hand(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * weights[f][k] for f, v in x.items()) + weights[-1][k]) / 0.7 for k in range(3)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        lang, score = model.predict(t)
        assert lang == model.languages[p.index(max(p))] and score == pytest.approx(max(p))


def test_letters_and_ties():
    import numpy as np

    model = L.Model(["de", "en"], np.ones(L.FEATURES), np.zeros((L.FEATURES + 1, 2)), 1.0)
    for text in (None, "", "½", "²", "Ⅷ", "12 _ !?", "①"):
        assert model.predict(text) == ("und", 0.0)
    for text in ("a", "½a", "字", "ª", "ʰ"):
        assert model.predict(text) == ("de", 0.5)  # a tie: the alphabetically first
    assert model.predict("very long words " * 200_000) == ("de", 0.5)
