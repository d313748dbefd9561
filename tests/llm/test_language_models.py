"""Kneser-Ney models against brute force, whole long texts, and what is rejected."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import langid

TEXT = "the cat sat on the mat and then that hat"


def plain(text, order):
    """The n-grams of a text as tuples, by the definition."""
    table = langid._TABLE[0]
    found = [0] * (order - 1)
    for c in unicodedata.normalize("NFC", text):
        s = int(table[ord(c)])
        if s or found[-1]:
            found.append(s)
    if found[-1]:
        found.append(0)
    return [tuple(found[i : i + order]) for i in range(len(found) - order + 1)]


def unpack(key, order):
    return tuple(int(key) >> langid.BITS * (order - 1 - k) & 63 for k in range(order))


def keys_of(text, order=4):
    return np.concatenate([np.zeros(0, np.int64), *langid.grams(text, order)])


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_pieces_do_not_change_the_grams(monkeypatch, piece):
    keys_of("x")
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in (TEXT, "", " ,1", "a", " a  b1c ", "e\u0301e\u0301 \u1112\u1161\u11ab x", "\u0645\u0631\u062d\u0628\u0627 \u65e5\u672c"):
        assert [unpack(k, 4) for k in keys_of(text)] == plain(text, 4)


def test_kneser_ney_equals_brute_force_and_sums_to_one():
    order, counts = 3, Counter(plain(TEXT, 3))
    levels = {3: counts}
    for k in (2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 64
        own = levels[k]
        once, twice = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        whole = sum(same.values())
        return max(own.get(gram, 0) - d, 0) / whole + d * len(same) / whole * p(gram[1:])

    keys, n = np.unique(keys_of(TEXT, order), return_counts=True)
    made = langid.log_probabilities(keys, n, order)
    rnd = random.Random(1)
    for gram in [*counts, *(tuple(rnd.randrange(28) for _ in range(3)) for _ in range(300))]:
        key = (gram[0] << 6 | gram[1]) << 6 | gram[2]
        assert math.isclose(langid.look_up(made, np.array([key]))[0], math.log(p(gram)), abs_tol=1e-4)
    for context in (0, int(keys[3]) >> langid.BITS, 1234):
        assert abs(np.exp(langid.look_up(made, (context << langid.BITS) | np.arange(64))).sum() - 1) < 1e-5


def invented(rnd, letters, n):
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    return [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(n)]


def test_other_scripts_and_noise_are_rejected_and_own_texts_are_not(spark):
    rnd = random.Random(4)
    one, two = invented(rnd, "aeionrst", 400), invented(rnd, "uyghkmpw", 400)
    rows = [(i, t, "xx" if i < 400 else "yy") for i, t in enumerate(one + two)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where(langid.learned_from(F.col("doc_id"))))
    out = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(out[i]["lang_pred"] == lang and not out[i]["rejected"] for i, _, lang in rows)
    odd = ["".join(chr(rnd.randrange(0x3041, 0x3090)) for _ in range(300)), " ".join("".join(rnd.choice("bcdfjlqvxz") for _ in range(9)) for _ in range(60)), "1 2 3", "", None]
    strange = spark.createDataFrame([(1000 + i, t, "xx") for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    assert all(r["rejected"] for r in langid.identify(strange, model).collect())
    kept = corpus_pipeline.language_id(spark, df.unionByName(strange), "")
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, *_ in rows} and kept.where("doc_id >= 1002").count() == 0


def test_a_language_of_one_text_is_learned(spark):
    for text in ("seldom seen", "never heard", "hardly ever", "once only", "just this", "and that"):
        model = langid.train(spark.createDataFrame([(text, "yy")], "text string, lang string"))
        assert model.predict([text])[0][0] == "yy" and set(model.limits) == {"yy"}
