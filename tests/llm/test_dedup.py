"""Exact and SimHash deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pixelloom.llm import components, exact_dedup, simhash

SCHEMA = "doc_id long, text string, kept string, source string"


def hard_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, base = [], [rng.choice(words) for _ in range(200)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "x", "a"))
    for i in range(60, 120):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 40))), None, None))
    rows += [(120 + i, t, "x", "b") for i, t in enumerate([None, "", " \t\n", "A b", "a  B", "a b", "a\nb", "long " * 30000])]
    rows += [(None, "a b", "x", "b"), (None, "only null id", None, None), (61, rows[61][1], None, None), (61, rows[61][1], None, None)]
    rng.shuffle(rows)
    return rows


def brute_exact(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        text = re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")
        groups[hashlib.sha256(text.encode()).hexdigest()].append((r[0] is None, r[0] or 0, i))
    out = []
    for digest, members in groups.items():
        none, keep, _ = min(members)
        first = True
        for is_none, d, _ in sorted(members):
            out.append((None if is_none else d, None if none else keep, len(members), first, digest))
            first = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 2, 256])
def test_exact(spark, tmp_path, counters):
    rows = hard_rows() + [(500 + i, "hot text", "x", "c") for i in range(100)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = exact_dedup.exact_dedup(docs, counters=counters, mark_only=True).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)
    full = exact_dedup.exact_dedup(docs, counters=counters)
    assert full.columns == ["doc_id", "text", "source", "keep_id", "group_size", "kept", "text_sha256"]
    assert full.where("kept").count() == len({r.text_sha256 for r in got})


def test_exact_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    assert exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize(("bits", "cell", "deepest"), [(4, 20_000, 44), (4, 20, 44), (1, 7, 44), (5, 3, 1)])
def test_simhash(spark, bits, cell, deepest):
    rows = hard_rows()
    fps = [brute_fingerprint(r[1], 4) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps, bits), strict=True)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), bits=bits, cell=cell, deepest=deepest).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({w[2] for w in want}) < len(want) - 15


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_cover_every_pair():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    y = x.copy()
    for _ in range(simhash.MAX_BITS):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    at_x = [set() for _ in x]
    for i, a, home in zip(*simhash.anchors(x), strict=True):
        if home:
            at_x[i].add(a)
    assert all(len(s) == 3 for s in at_x)
    met = np.zeros(len(x), bool)
    for i, a, _ in zip(*simhash.anchors(y), strict=True):
        met[i] |= a in at_x[i]
    assert met.all()


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 500)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(501)), list(range(1000, 1200)), [5000, 5001]])
