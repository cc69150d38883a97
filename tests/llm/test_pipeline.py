"""The pipeline: each stage's decisions take effect, and its parts agree with brute force."""

import random
import re
from collections import defaultdict
from itertools import combinations

import corpus_pipeline as cp
from pixelloom.llm import shared

from .test_suffix import brute as without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "the river house light green stone north water small garden".split() for b in ("", "s", "ly", "ing", "er", "al")]
    say = lambda n: ". ".join(" ".join(rng.choices(words, k=9)).capitalize() for _ in range(n)) + "."
    passage = say(6)
    texts = [say(rng.randint(6, 14)) for _ in range(60)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1], say(4) + " " + passage + " " + say(5), say(5) + " " + passage + " " + say(3)]
    texts += ["junk*** " * 40, "AAA!! " * 50, None, "", texts[2] + " x"]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    return rows, passage


def plain_exact(rows):
    """Ids that stay: the smallest of each white-space-normalised text."""
    first = {}
    for d, t in sorted(rows.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), d)
    return set(first.values())


def plain_near(rows):
    """Ids that stay: the smallest of each group linked by a 5-word Jaccard similarity of 0.8."""
    sets = {}
    for d, t in rows.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {d: d for d in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(rows, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in rows if find(d) == d}


def test_stages(spark, tmp_path):
    rows, passage = write(spark, str(tmp_path))
    docs = shared.documents(spark, str(tmp_path))
    seen = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == cp.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect())
    quality, exact, near, passages, pieces = seen
    text = lambda docs: {i: r.text for i, r in docs.items()}
    assert set(exact) == plain_exact(text(quality)) and set(near) == plain_near(text(exact))
    want = without_repeats([near[i].text for i in sorted(near)], 200)
    assert {i: passages[i].text for i in passages} == {i: w[5] for i, w in zip(sorted(near), want, strict=True)}
    assert set(range(60)) <= set(quality) and not {65, 66, 67, 68} & set(quality)
    assert set(quality) - set(exact) == {60, 61, 62}
    assert set(near) <= set(exact) and set(exact) - set(near) <= {69}
    assert set(passages) == set(near)
    assert passage in near[63].text and passage not in passages[63].text and passage not in passages[64].text
    changed = {i for i in near if near[i].text != passages[i].text}
    assert {63, 64} <= changed <= {2, 63, 64, 69}
    assert all(r.n_chars == len(r.text) for r in passages.values())
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    assert set(total) == set(passages) and all(total[p.doc_id] == p.doc_tokens for p in pieces)
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, pieces), key=repr)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_with_hard_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows and ids: no stage crashes or loses a clean text."""
    rng = random.Random(9)
    say = lambda: " ".join(rng.choices("the river house and a light green stone with small garden people walk along it every day".split(), k=60)) + "."
    rows = [(None, say(), None, None, None), (None, None, None, None, None), (1, say(), "en", None, 5), (1, say(), None, "s", None)]
    rows += [rows[2], (3, "", "en", "s", 0), *[(10 + i, say(), "en", "s", 9) for i in range(20)]]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = shared.documents(spark, str(tmp_path))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert {r.text for r in docs.collect()} >= {r[1] for r in rows if r[1]}
