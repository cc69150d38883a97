"""Suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pixelloom.llm import shared
from pixelloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, kept string, first string"


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, other, edge = say(12), say(15), say(9)
    out = [say(rng.randint(0, 40)) for _ in range(25)]
    out += [say(rng.randint(0, 6)) + passage + say(rng.randint(0, 6)) for _ in range(30)]
    out += [say(4) + other[: rng.randint(10, len(other))] + edge + say(2) for _ in range(12)]
    out += [out[3], out[3], None, "", "a" * 150, "ab" * 60, "ba" * 70, "short", passage * 3, say(2000), say(3) + say(500)[:900]]
    out.append(out[-2][500:4000] + "tail")
    return out


def brute(all_texts, length):
    data = [(t or "").encode() for t in all_texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize(("length", "kgram", "bucket", "piece"), [(40, 12, 20_000, 1 << 19), (40, 12, 3, 700), (25, 20, 5, 1 << 19), (40, 12, 1, 1 << 19)])
def test_repeats(spark, tmp_path, monkeypatch, length, kgram, bucket, piece):
    monkeypatch.setattr(sd, "PIECE", piece)
    rows = [(k, t, "x", None) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    keyed = shared.with_row(docs.withColumnRenamed("text", "_text"))
    got = sd.strip_repeats(keyed.select("_row", "_text"), length, kgram, bucket)
    got = keyed.select("_row", "doc_id").join(got, "_row").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute([r[1] for r in rows], length)
    assert sorted(map(tuple, got)) == [w[:5] for w in want]
    assert sum(w[2] for w in want) > 3000


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("length", [200, 600, 1100, 1400])
def test_texts_on_which_polynomials_collide(spark, tmp_path, length):
    one, edge = thue_morse(1024), "0123456789" * 60
    other = one.translate(str.maketrans("ab", "ba"))
    data = [edge + one + edge[::-1], edge + other + edge[::-1], edge + one + edge[::-1] + "end", edge[5:] + other]
    spark.createDataFrame([(k, t, "x", None) for k, t in enumerate(data)], SCHEMA).repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for keep in ([0, 1], [0, 1, 2, 3]):
        got = {r.doc_id: r.text for r in sd.remove_repeats(docs.where(docs.doc_id.isin(keep)), length=length).collect()}
        want = brute([data[k] for k in keep], length)
        assert got == {k: w[5] for k, w in zip(keep, want, strict=True)}


def test_windows_of_one_hash_by_their_bytes(monkeypatch):
    monkeypatch.setattr(sd.Hashed, "of", lambda self, a, b: np.zeros(len(a), np.uint64))  # every hash collides
    rng = random.Random(3)
    kinds = [bytes(rng.choice(b"xyz") for _ in range(30)) for _ in range(4)]
    contexts = [rng.choice(kinds) for _ in range(20)] + [bytes(range(30))]
    n = np.array([1] * len(contexts))
    _, _, repeated, first, _ = sd.window_classes(contexts, n, 0 * n, 0 * n, 30)
    assert repeated.tolist() == [contexts.count(c) > 1 for c in contexts]
    assert sum(f for f, c in zip(first, contexts, strict=True) if contexts.count(c) > 1) == len({c for c in contexts if contexts.count(c) > 1})


def test_remove_repeats(spark, tmp_path):
    rows = [(k, t, "x", None) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    out = sd.remove_repeats(spark.read.parquet(str(tmp_path / "d")), length=100)
    assert out.columns == ["doc_id", "text", "kept", "first"]
    want = brute([r[1] for r in rows], 100)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {r[0]: None if r[1] is None else w[5] for r, w in zip(rows, want, strict=True)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    assert sd.remove_repeats(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    hashed = sd.Hashed(data)
    bucket = np.sort(rng.integers(0, 9, 700))
    starts = rng.integers(0, 3900, 700)
    order = sd.suffix_order(hashed, starts, bucket, 60)
    got = [(bucket[i], data[starts[i] : starts[i] + 60].tobytes()) for i in order]
    assert got == sorted(got)
    assert sorted(order.tolist()) == list(range(700))
