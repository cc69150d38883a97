"""The language model against counts in dictionaries and sums over the whole vocabulary."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import language_model as lm


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def rows(n=400):
    rng = random.Random(4)
    chains = [["the", "river", "runs", "by", "the", "mill"], ["die", "Mühle", "steht", "AM", "fluss"]]
    out = []
    for i in range(n):
        chain, words = rng.choice(chains), []
        for j in range(rng.randint(1, 60)):
            words.append(chain[j % len(chain)] if rng.random() < 0.9 else f"w{rng.randrange(300)}")
        out.append((i, rng.choice([" ", "  ", "\n", "\t\x0b"]).join(words)))
    return [*out, (900, None), (901, ""), (902, " \r\n"), (None, "the river runs"), (903, "über ÜBER the" * 3), (904, "the river " * 30000), (5, out[5][1]), (905, " x  ")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def table(spark, path, data):
    spark.createDataFrame([(i, t, f"x{k}") for k, (i, t) in enumerate(data)], "doc_id long, text string, `word` string").repartition(3).write.parquet(f"{path}/documents.parquet")


def test_query(spark, tmp_path):
    data = rows()
    table(spark, tmp_path, data)
    out = lm.op11_language_model(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = sorted(map(tuple, out.collect()), key=repr)
    train = [tokens(t) for i, t in data if i is not None and not held(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for i, t in data:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, base))
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want, strict=True))
    # the model has learned from the order of words
    of = lambda k: sum(g[k] for g in got if g[1])
    assert of(6) > 0.8 * of(5)


@pytest.mark.parametrize(("size", "frequent"), [(8, 40), (8, 8), (1000, 5000)])
def test_scores_sum_to_one(spark, tmp_path, size, frequent):
    """Words outside of the vocabulary, frequent or rare, against sums over all words."""
    data = rows(150)
    table(spark, tmp_path, data)
    docs = lm.shared.with_row(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"), "row").withColumn("learn", F.coalesce(F.col("doc_id") < 100, F.lit(False)))
    learned = docs.where("learn").count()
    vocab = lm.vocabulary(lm.count_words(docs), learned, size, frequent)
    params = lm.train(lm.coded(docs, vocab).where("learn").select("row", "symbols"), vocab)
    got = {r.row: r.score for r in lm.score(docs, size, frequent).collect()}
    net, symbol = lm.Network(params), {w: k + lm.FIRST for k, w in enumerate(vocab.words.to_pylist()[: vocab.size - lm.FIRST])}
    c = Counter(w for i, t in data if i is not None and i < 100 for w in tokens(t))
    others = [w for w in c if w not in symbol]
    below = sum(c[w] for w in others) + len(others) + 1
    assert math.isclose(sum((c[w] + 1) / below for w in others) + 1 / below, 1)
    for row in docs.collect():
        total, u, v = 0.0, lm.END, lm.END
        for word in [*tokens(row.text), None]:
            w = lm.END if word is None else symbol.get(word, lm.OTHER)
            logits = (net.r[v] * net.c[0] + net.r[u] * net.c[1]) @ net.q.T + net.b
            total += (logits[w] - np.log(np.exp(logits).sum())) / math.log(10)
            if w == lm.OTHER:
                total += math.log10((c[word] + 1) / below)
            u, v = v, w
        assert math.isclose(got[row.row], total, rel_tol=1e-4, abs_tol=1e-3)


def test_gradients_follow_the_objective():
    """One step on one batch raises the noise-contrastive objective; the parameters' derivative agrees with differences."""
    rng = np.random.default_rng(0)
    noise = np.array([0.4, 0.3, 0.2, 0.1])
    start = rng.normal(0, 0.5, (5, 2 * lm.DIMENSIONS + 1))
    u, v, w = (rng.integers(0, 4, 50).astype(np.uint16) for _ in range(3))

    def objective(table, drawn):
        net = lm.Network(table.astype(np.float64))
        h = net.r[v] * net.c[0] + net.r[u] * net.c[1]
        delta = lambda s, x: s - np.log(lm.NOISE * noise[x])
        right = delta((h * net.q[w]).sum(1) + net.b[w], w)
        wrong = delta(h @ net.q[drawn].T + net.b[drawn], drawn)
        return -np.log1p(np.exp(-right)).sum() - np.log1p(np.exp(wrong)).sum()

    trainer = lm.Trainer(start, noise, 3)
    drawn = np.searchsorted(np.cumsum(noise), np.random.default_rng(3).random(lm.NOISE)).clip(max=3)
    trainer.squares = [np.full_like(x, 1e12) for x in trainer.squares]  # so that a step is a multiple of the gradient
    trainer.r, trainer.q, trainer.b, trainer.c = (np.zeros_like(x) + x for x in (trainer.r, trainer.q, trainer.b, trainer.c))
    trainer.r, trainer.q, trainer.b, trainer.c = (x.astype(np.float64) for x in (trainer.r, trainer.q, trainer.b, trainer.c))
    trainer.squares = [x.astype(np.float64) for x in trainer.squares]
    trainer.step(u, v, w)
    moved = (trainer.result() - start.astype(np.float32)) * 1e6 / lm.RATE * len(w) ** 0.5
    for _ in range(40):
        i, j = rng.integers(0, 5), rng.integers(0, 2 * lm.DIMENSIONS + 1)
        if i == 4 and j == 2 * lm.DIMENSIONS:
            continue
        step = np.zeros_like(start)
        step[i, j] = 1e-5
        want = (objective(start + step, drawn) - objective(start - step, drawn)) / 2e-5
        assert math.isclose(moved[i, j], want, rel_tol=0.02, abs_tol=0.05)


def test_contexts_begin_anew_with_each_text():
    u, v, w = lm.contexts([np.array(x, np.uint16) for x in ([5, 6, 7, 1], [1], [8, 1])])
    assert w.tolist() == [5, 6, 7, 1, 1, 8, 1]
    assert v.tolist() == [1, 5, 6, 7, 1, 1, 8]
    assert u.tolist() == [1, 1, 5, 6, 1, 1, 1]


def test_nothing_learned_and_empty(spark, tmp_path):
    table(spark, tmp_path, [(i, "a b") for i in range(40) if held(i)])
    got = lm.op11_language_model(spark, str(tmp_path)).collect()
    assert got and all(r.held_out and r.n_tokens == 3 and r.n_known == r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert all(r.score <= 0 for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id as row", "text", "true as learn").where("false")
    assert lm.score(docs).count() == 0
