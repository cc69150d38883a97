"""Groups of similar texts and the pipeline's near-dedup stage against brute force."""

import random
from collections import defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest
from pixelloom.llm import shared, simhash, similar_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Bases, copies of them with 1 to 12 words changed, and a hot group of such copies."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(120, 200))) for _ in range(40)]
    for i in [*range(40), *[0] * 60]:
        w = texts[i].split()
        for _ in range(rng.randint(1, 12) if i else rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + ["few words", "few  WORDS", "few others", "", " \n", None]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return pairs, root


@pytest.mark.parametrize(("cell", "share"), [(500, 2000), (7, 2000), (7, 5)])
def test_groups(spark, cell, share):
    texts = planted()
    pairs, root = brute(texts)
    got = {r.id: r.root for r in similar_texts.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), cell=cell, share=share).collect()}
    mine, want = defaultdict(set), defaultdict(set)
    for i in range(len(texts)):
        mine[got.get(i, -1 - i)].add(i)
        want[root[i]].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert 10 < len(want) < len(texts) - 50 and len(pairs) > 100


def test_near_stage(spark, tmp_path):
    texts = planted()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    stayed = {r.doc_id for r in cp.near(spark, shared.documents(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert stayed == set(brute(texts)[1])


def test_no_texts(spark):
    assert similar_texts.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_reach_the_similarity():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = (similar_texts.minima(s).reshape(similar_texts.BANDS, -1) for s in (x[:180], x[20:]))  # 160 of 200
        missed += not (a == b).all(axis=1).any()
    assert missed == 0


def test_fingerprints_give_candidates(spark):
    """Texts within five bits are joined to the least id that such links reach, by the covering."""
    texts = [" ".join(f"v{i}" for i in range(400)), *planted()]  # the first has a copy below with one word changed
    texts.append(texts[0].replace("v399", "other"))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    every = similar_texts.bands(docs, 5).collect()
    fps = {r.id: r.key for r in every if r.fingerprint}
    assert fps == {i: int(np.uint64(simhash.fingerprint(t, 5)).view(np.int64)) for i, t in enumerate(texts)}
    root = list(range(len(texts)))
    for i in fps:
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 5:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = similar_texts.fingerprint_stars(spark.createDataFrame([(fp, i) for i, fp in fps.items()], "fp long, id long"))
    assert {r.id: r.least for r in got.collect()} == {i: r for i, r in enumerate(root) if r != i}
    assert root[-1] == 0
