"""The registered language query against dictionaries and recursion, on a small table."""

import math
import random
import zlib

import pytest

from pixelloom.llm import language

from .test_language import plain_costs


def rows():
    rng = random.Random(11)
    words = {"en": "the of and to in is that for it was on with as his they".split(), "de": "der die und das nicht ist von mit sich auf für ein straße".split()}
    out = [(i, " ".join(rng.choices(words[x], k=rng.randint(3, 12))), x) for i in range(60) for x in [rng.choice(list(words))]]
    out += [(100, "½ ² ⅷ ① ़ 12_3", "en"), (101, None, "de"), (102, "", None), (103, "Straße 5", None), (104, "ß", "fr"), (None, "the and was", "de"), (7, out[7][1], out[7][2])]
    return out


def test_query_is_the_plain_model(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, language.op5_language_id(spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()), key=repr)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    train = {}
    for d, t, x in data:
        if d is not None and x is not None and not held(d):
            train.setdefault(x, []).append((t or "").encode())
    names = sorted(train)
    want = []
    for d, t, _ in data:
        if not t or not any(c.isalpha() for c in t):
            want.append((d, held(d), "und", 0.0))
            continue
        bits = [plain_costs(train[x], t.encode(), language.ORDER) for x in names]
        best = min(range(len(names)), key=lambda j: (bits[j], j))
        want.append((d, held(d), names[best], 1 / sum(2 ** (bits[best] - b) for b in bits)))
    want.sort(key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], abs_tol=1e-3) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("clash", ["score", "lang_pred", "my score"])
def test_clashing_columns(spark, clash):
    docs = spark.createDataFrame([(1, "the and of", "en", "mine")], f"id long, text string, lang string, `{clash}` string")
    model = language.fit(docs.select("id", "text", "lang"))
    out = language.identify(docs, model).collect()
    assert len(out) == 1 and out[0].lang_pred == "en" and 0 < out[0]["score"] <= 1
