"""PPM language identification against a plain implementation and on held-out texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from pixelloom.llm import language


def plain_costs(train, text, order):
    """Code length of ``text`` in one language, by dictionaries and recursion."""
    seen = defaultdict(Counter)
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    for t in train:
        data = b" " * order + low(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[k, data[i - k : i]][data[i]] += 1

    def cost(context, byte, k):
        if k < 0:
            return 8.0
        here = seen.get((k, context))
        lower = lambda: cost(context[1:], byte, k - 1)
        if not here:
            return lower()
        total, d = sum(here.values()), len(here)
        if byte in here:
            return -math.log2(here[byte] / (total + d))
        return -math.log2(d / (total + d)) + lower()

    data = b" " * order + low(text)
    return sum(cost(data[i - order : i], data[i], order) for i in range(order, len(data)))


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(8)
    train = {"x": [b"The cat sat", b"on the mat"], "y": ["die Katze saß".encode(), b"auf der"], "z": [b"zz"]}
    order = 3
    counts = {}
    for lang, texts in train.items():
        data, own, _ = language._laid_out(texts, order)
        for k in range(order + 1):
            counts[lang, k] = np.unique(language._grams(data, own, k), return_counts=True)
    model = language.Model(sorted(train), order, counts)
    texts = [bytes(rng.choice(b"thecaCT satz\xc3\x9f\xff") for _ in range(rng.randint(1, 60))) for _ in range(30)] + [b"T", b"the cat"]
    want = np.array([[plain_costs(train[x], t, order) for x in sorted(train)] for t in texts])
    assert np.allclose(model.lengths(texts), want, atol=1e-3)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.allclose(model.lengths(texts), want, atol=1e-3)


def test_fit_keeps_all_counts(spark):
    rng = random.Random(4)
    letters = {"a": "abcdefghijklmnopqrstuvwxyz", "b": "zyxwvutsrqponmlkjihgfedcba '"}
    rows = [(i, lang, "".join(rng.choices(letters[lang], k=1500))) for i in range(100) for lang in [rng.choice("ab")]]
    model = language.fit(spark.createDataFrame(rows, "id long, lang string, text string"))
    assert len(model.symbols[language.ORDER].keys) > 100_000
    texts = [rows[0][2].encode()[:300], rows[1][2].encode()[700:900], b"never seen before"]
    want = [[plain_costs([t.encode() for _, x, t in rows if x == lang], text, language.ORDER) for lang in "ab"] for text in texts]
    assert np.allclose(model.lengths(texts), want, rtol=1e-5)


def test_identify(spark):
    rng = random.Random(3)
    words = {"en": "the of and to in is that for it was on with as his they".split(), "de": "der die und das nicht ist von mit sich auf für ein straße".split(), "fr": "le la les des une est pas que dans pour été où garçon".split()}
    rows = [(i, " ".join(rng.choices(words[x], k=rng.randint(5, 40))), x, "s") for i in range(300) for x in [rng.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.where("doc_id < 200").selectExpr("doc_id as id", "lang", "text"))
    extra = spark.createDataFrame([(900, None, "en", None), (901, "", "en", None), (902, "12 !?", None, None), (None, "the and was", None, None), (903, "und " * 200000, "de", None)], docs.schema)
    out = language.identify(docs.where("doc_id >= 200").union(extra).select("doc_id", "text", "lang"), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 105
    assert all(got[r[0]].lang_pred == r[2] for r in rows[200:])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[900].score == 0 and got[None].lang_pred == "en" and got[903].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = language.fit(docs.where("lang is not null").selectExpr("doc_id as id", "lang", "text"))
    assert [r.lang_pred for r in language.identify(docs.select("doc_id", "text"), model).collect()] == ["und"]
    assert language.identify(docs.where("false").select("doc_id", "text"), model).count() == 0
