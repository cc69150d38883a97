"""Packing: every token in one piece, gapless sequences, target shares, exact ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pixelloom.llm import packing, shares

SCHEMA = "doc_id long, text string, source string, start long"


def rows():
    rng = random.Random(4)
    words = ["Hello", "it's", "naïve", "straße", "x́y", "<|endoftext|>", "123", "don't!!", "ΟΔΟΣ", "日本語", "a b", "　", "é", "$$$"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  ", "\r\n", "\v", "\f"]) for _ in range(n))
    out = [(i, text(rng.randint(0, 60)), f"s{i % 4 if i % 3 else 0}", 9) for i in range(120)]
    out += [(200, None, "s0", 9), (201, "", None, 9), (202, text(5000), "big", 9), (7, "same", "s1", 9), (7, "same", "s1", 9), (None, "no id", "tiny", 9)]
    return out


def ids_of(text):
    return [*packing._tokenizer(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize(("window", "targets"), [(4096, None), (64, None), (64, {"s0": 3.0, "big": 1.0}), (256, {"nobody": 1.0})])
def test_pack(spark, window, targets):
    data = rows()
    got = packing.pack(spark.createDataFrame(data, SCHEMA).repartition(4), window=window, targets=targets).collect()
    total = sum(len(ids_of(r[1])) for r in data)
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append(p)
        docs[p.doc_id].append(p)
    assert sum(p.length for p in got) == total
    for s, pieces in sequences.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or (s >= total // window and at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    for doc, text, _, _ in data:
        ids = np.array(ids_of(text), "<u4")
        pieces = sorted(docs[doc], key=lambda p: p.start)
        copies = 2 if doc == 7 and text == "same" else 1
        pieces = [p for p in pieces if p.doc_tokens == len(ids)] if doc == 7 else pieces
        assert {p.doc_tokens for p in pieces} == {len(ids)}
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    if targets is None:
        sizes = defaultdict(int)
        for p in got:
            sizes[p.source] += p.length
        for s in range(total // window):
            for source in ("s0", "big"):
                part = sum(p.length for p in sequences[s] if p.source == source)
                assert abs(part - window * sizes[source] / total) <= 2
    if targets and "s0" in targets:
        part = [sum(p.length for p in sequences[s] if p.source == "s0") for s in range(3)]
        assert all(abs(x - window * 0.75) <= 2 for x in part)


def placed(spark, data, **options):
    """Pieces by sequence, checked for gaps and for all tokens."""
    got = packing.pack(spark.createDataFrame(data, SCHEMA).repartition(3), **options).collect()
    assert sum(p.length for p in got) == sum(len(ids_of(r[1])) for r in data)
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append(p)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    return sequences


def test_many_sources(spark):
    rng = random.Random(7)
    data = [(i, " ".join(rng.choices(["red", "green", "blue"], k=rng.randint(0, 30))), f"s{rng.randint(0, 900)}" if i % 3 else "hot", 0) for i in range(2500)]
    data += [(5000, "one two", None, 0)]
    sequences = placed(spark, data, window=64)
    sizes = defaultdict(int)
    for r in data:
        sizes[r[2]] += len(ids_of(r[1]))
    total = sum(sizes.values())
    large = [s for s, n in sizes.items() if n * 64 >= 2 * total]
    assert "hot" in large
    for s in range(total // 64):
        for source in large:
            assert abs(sum(p.length for p in sequences[s] if p.source == source) - 64 * sizes[source] / total) <= 2
    # the smallest sources have their targets too, and the null one
    small = sorted((s for s in sizes if s), key=lambda s: sizes[s])[:3]
    sequences = placed(spark, data, window=64, targets={**{s: 1.0 for s in small}, None: 1.0, "hot": 12.0, "nobody": 3.0})
    first = {p.source for p in sequences[0]}
    assert first == {*small, None, "hot"}
    assert sum(p.length for p in sequences[0] if p.source == "hot") >= 46


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_source_has_its_target(spark):
    """Thousands of sources of under a token a window are each within two tokens of their share."""
    rng = random.Random(11)
    data = [(i, " ".join(["red"] * rng.randint(0, 8)), f"s{i % 10_000}", 0) for i in range(12_000)]
    data += [(20_000 + i, "blue " * 300, "hot", 0) for i in range(40)]
    sequences = placed(spark, data, window=64)
    sizes, seen = defaultdict(int), defaultdict(int)
    for r in data:
        sizes[r[2]] += len(ids_of(r[1]))
    total = sum(sizes.values())
    for s in range(total // 64):
        for p in sequences[s]:
            seen[p.source] += p.length
        assert all(abs(seen[x] - n * 64 * (s + 1) / total) < 2 for x, n in sizes.items())


def test_targets_below_a_token_a_window(spark):
    rng = random.Random(12)
    data = [(i, " ".join(["red"] * rng.randint(20, 60)), f"s{i % 300}", 0) for i in range(600)]
    data += [(20_000 + i, "blue " * 400, "hot", 0) for i in range(40)] + [(30_000, "green", "not named", 0)]
    targets = {f"s{i}": 0.1 for i in range(300)} | {"hot": 34.0, "nobody": 9.0, "none": float("nan"), "no": -1.0}
    sequences = placed(spark, data, window=64, targets=targets)
    seen = defaultdict(int)
    for s in range(200):  # nothing is dry by then
        for p in sequences[s]:
            seen[p.source] += p.length
        assert all(abs(seen[x] - t * (s + 1)) < 2 for x, t in targets.items() if x == "hot" or x[1:].isdigit())
    last = max(s for s in sequences if any(p.source == "not named" for p in sequences[s]))
    assert last >= max(sequences) - 7  # the tail is split at powers of two


def fluid(totals, weights, v):
    """What each queue has given after v tokens, without rounding."""
    given, left = [0.0] * len(totals), float(v)
    while left > 1e-9:
        live = [q for q in range(len(totals)) if totals[q] - given[q] > 1e-9]
        share = {q: weights[q] for q in live if weights[q] > 0} or {q: totals[q] for q in live}
        step = min(left / sum(share.values()), min((totals[q] - given[q]) / w for q, w in share.items()))
        for q, w in share.items():
            given[q] += w * step
        left -= step * sum(share.values())
    return given


def test_schedule_against_plain_shares():
    """Every place of the line is taken once, queues stay near their shares, also when some run dry."""
    rng = random.Random(1)
    for _ in range(150):
        totals = [rng.choice([0, 1, rng.randint(0, 40), rng.randint(0, 900)]) for _ in range(rng.randint(1, 9))]
        weights = [rng.choice([0.0, 1.0, rng.random(), 50 * rng.random()]) for _ in totals]
        window, total = rng.choice([1, 16, 64]), sum(totals)
        line = [None] * total
        for q, path in enumerate(shares.schedule(totals, weights)):
            assert (path is None) == (not totals[q])
            if path is None:
                continue
            queue, x = shares.Queue(path, total, window), 0
            while x < totals[q]:
                n = min(totals[q] - x, rng.randint(1, 50))
                for v, take in queue.pieces(x, n):
                    assert v // window == (v + take - 1) // window and line[v : v + take] == [None] * take
                    line[v : v + take] = [q] * take
                x += n
        assert None not in line
        for v in range(window, total, max(window, total // window // 10 * window)):
            want = fluid(totals, weights, v)
            assert all(abs(line[:v].count(q) - want[q]) < 2 for q in range(len(totals)))


def test_schedule_of_many_targets():
    rng = random.Random(2)
    totals, weights = [rng.randint(1, 10**9) for _ in range(10_000)], [rng.random() ** 4 for _ in range(10_000)]
    paths = shares.schedule(totals, weights)
    assert max(map(len, paths)) < 64
    v = 0.9 * sum(totals) // 1
    given = []
    for path in paths:
        at = int(v)
        for split, side in path:
            at = at - split.left(at) if side else split.left(at)
        given.append(at)
    assert sum(given) == v and all(0 <= g <= n for g, n in zip(given, totals, strict=True))


def test_tail_in_buckets(spark):
    """Numbers of sources are unique in any number of buckets, so all leaves differ."""
    tail = spark.createDataFrame([(None if i == 5 else f"s{i}", 1 + i % 7) for i in range(700)], "source string, n long")
    total = sum(1 + i % 7 for i in range(700))
    line = set()
    for r in packing.tail_paths(tail, spread=100).collect():
        path = tuple((shares.even(s.left, s.right), s.side) for s in r.path)
        n = 1 + (5 if r.source is None else int(r.source[1:])) % 7
        line |= {v + k for v, take in shares.Queue(path, total, 64).pieces(0, n) for k in range(take)}
    assert line == set(range(total))
    alone = packing.tail_paths(tail.where("source = 's1'")).collect()
    assert not alone or not alone[0].path
