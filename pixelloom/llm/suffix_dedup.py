"""Suffix-array deduplication: remove every byte of a repeated 200-byte string.

Sorting all suffixes of a corpus would shuffle many times its size. Here each
window of ``length`` bytes is filed under its minimiser, the least-hashed k-gram
inside it; equal windows have equal minimisers at equal offsets, so a repeated
window is found among the occurrences of one k-gram. For each occurrence (an
anchor) one row is shuffled: the k-gram's hash and the digest of its span, all
bytes of the windows filed there.

* A k-gram that occurs once: none of its windows is repeated.
* Occurrences whose spans are equal: all their windows are repeated. Spans are equal
  if their 128-bit BLAKE2b digests are; a polynomial hash would not do, as there are
  texts on which all polynomials modulo a power of two collide together.
* The others, at the ends of repeated passages: one context for each distinct
  span goes to its k-gram's bucket, and there the suffixes that start at equal
  distances from the k-gram are put in order by a mergesort. Two suffixes are
  compared through prefix polynomial hashes: a binary search finds how far they
  agree, so a comparison takes log2(length) steps. Neighbours that agree on
  ``length`` bytes by hash are compared byte by byte before they count; where that
  finds a collision, the windows of that hash are put in order by their bytes.
* A bucket holds ``bucket`` contexts. Those of a k-gram with more (the edge of a
  passage that very many texts share) are cut into parts of PART neighbouring
  windows, and filed under the bytes that all windows of the part hold; equal
  windows have these in common, and parts alone with theirs have no equal and go.
  Where ``bucket`` is still exceeded, parts are dealt over several buckets; each is
  sorted, and one window of each of its classes goes on to a second sort, filed
  there by its hash, so that a class has no more rows than there were buckets.

Joins to the many rows of a hot k-gram broadcast the few hottest keys (see
``shared.join_side``), so that no task gathers one.

Defined results: null texts count as empty; texts shorter than ``length`` lose
nothing, and neither does an empty table; very long texts are read whole, in
overlapping pieces. Rows are told apart by their place in the scan, so repeated
rows are copies of each other. Extra columns are kept by ``remove_repeats`` and may
have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH = 200
KGRAM = 48
#: Window starts that are hashed together; longer texts are cut into such pieces, with an overlap.
PIECE = 1 << 17
#: Neighbouring windows that stay together when a k-gram has more contexts than a bucket takes;
#: about the square root of the windows of a context, so both its parts and their windows are few.
PART = 12
#: Rows of an Arrow batch of contexts.
ROWS = 10_000
#: Base of the polynomial hash.
ODD = 0x9E3779B97F4A7C15


_held: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n; the longest asked for are held."""
    global _held
    if not _held or len(_held[0]) < n:
        both = []
        for base in (ODD, pow(ODD, -1, 1 << 64)):
            p = np.full(max(n, 1 << 19), np.uint64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _held = both
    return _held[0][:n], _held[1][:n]


@lru_cache
def _letters() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a polynomial's value over all bits (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """A byte buffer with prefix polynomial hashes: the hash of any substring in O(1)."""

    def __init__(self, data: np.ndarray):
        self.data = data
        power, self.inverse = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters()[data] * power[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def agreeing(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length, up to ``most``, on which the suffixes at a and b agree: a binary search over hashes."""
        n = np.zeros(len(a), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            upto = n + step
            ok = upto <= most
            e = np.minimum(upto, most)
            same = ok & (self.of(a + n, a + e) == self.of(b + n, b + e))
            n[same] = upto[same]
            step >>= 1
        return n


def _least_in_window(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by block-wise running minima from both ends."""
    n = len(keys) - w + 1
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(data: np.ndarray, text_at: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that start at ``text_at`` in ``data`` (its last item is
    the end): text number, anchor, first and last window start, k-gram, and both halves of
    the span's digest. Equal spans have their anchors at equal places."""
    w = length - kgram + 1
    hashed = Hashed(data)
    at = np.arange(len(data) - kgram + 1)
    grams = mix(hashed.of(at, at + kgram))
    low = np.uint64((1 << 24) - 1)
    least = _least_in_window(grams & ~low | at.astype(np.uint64), w)
    anchor = (least & low).astype(np.int64)  # of the window that starts here; the leftmost of equals
    text = np.repeat(np.arange(len(text_at) - 1), np.diff(text_at))
    whole = text[: len(anchor)] == text[length - 1 :]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (text[1 : len(anchor)] != text[: len(anchor) - 1])) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change - 1, [len(anchor) - 1]))
    keep = whole[first]
    first, last = first[keep], last[keep]
    anchor, number = anchor[first], text[first]
    view, digest = memoryview(data), hashlib.blake2b
    digests = b"".join([digest(view[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)])
    span, check = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    return number, anchor, first, last, grams[anchor], span, check


def _pieces(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about PIECE bytes: their keys, offsets within the text, and bytes."""
    keys: list[int] = []
    bases: list[int] = []
    parts: list[bytes] = []
    size = 0
    for key, data in texts:
        for base in range(0, len(data) - length + 1, PIECE):
            part = data[base : base + PIECE + length - 1]
            if size and size + len(part) > 2 * PIECE:
                yield keys, bases, parts
                keys, bases, parts, size = [], [], [], 0
            keys.append(key)
            bases.append(base)
            parts.append(part)
            size += len(part)
    if parts:
        yield keys, bases, parts


def find_anchors(rows: DataFrame, length: int, kgram: int) -> DataFrame:
    """Anchors of ``rows`` (_row long, _text string); d0..d1 are the distances from
    window starts to the anchor ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1).cast(pa.binary())), strict=True)
            for keys, bases, parts in _pieces(texts, length):
                starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                number, a, first, last, gram, span, check = anchors_of(np.frombuffer(b"".join(parts), np.uint8), starts, length, kgram)
                shift = np.array(bases)[number] - starts[number]
                cols = [np.array(keys)[number], a + shift, (a - last).astype(np.int16), (a - first).astype(np.int16), gram.view(np.int64), span, check]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_row", "a", "d0", "d1", "gram", "span", "check"])

    return rows.mapInArrow(shared.lean(run), "_row long, a long, d0 short, d1 short, gram long, span long, check long")


def suffix_order(hashed: Hashed, starts: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Positions in ``starts`` by (bucket, suffix up to ``most`` bytes): a mergesort
    in which all merges of a level advance together. ``bucket`` must be sorted."""
    n = len(starts)
    new = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    sizes = np.diff(np.append(new, n))
    base = np.repeat(new, sizes)
    size = np.repeat(sizes, sizes)
    place = np.arange(n) - base
    order, width = np.arange(n), 1
    data = hashed.data
    end = len(data)

    def before(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix i is less than suffix j, and whether they are equal."""
        same = hashed.agreeing(i, j, most)
        equal = same == most
        x, y = np.minimum(i + same, end - 1), np.minimum(j + same, end - 1)
        return ~equal & (data[x] < data[y]), equal

    while n and width < sizes.max():
        open_ = np.flatnonzero(size > width)
        t = place[open_]
        pair = t // (2 * width) * (2 * width)
        right = (t // width) % 2 == 1
        lo0 = np.where(right, pair, pair + width)
        hi0 = np.minimum(np.where(right, pair + width, pair + 2 * width), size[open_])
        lo, hi = np.minimum(lo0, hi0), hi0.copy()
        mine = starts[order[open_]]
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            theirs = starts[order[base[open_][live] + mid]]
            less, equal = before(theirs, mine[live])
            up = less | (equal & right[live])  # the left run goes first among equals
            lo[live] = np.where(up, mid + 1, lo[live])
            hi[live] = np.where(up, hi[live], mid)
        rank = lo - np.minimum(lo0, hi0)
        within = t - np.where(right, pair + width, pair)
        moved = order.copy()
        moved[base[open_] + pair + within + rank] = order[open_]
        order, width = moved, 2 * width
    return order


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at a and b are equal, byte by byte."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        s = slice(at, at + (1 << 14))
        out[s] = (view[a[s]] == view[b[s]]).all(axis=1)
    return out


def _by_bytes(data: np.ndarray, start: np.ndarray, by: np.ndarray, near: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """``by`` with each stretch of windows of one hash in order of their bytes, if these
    are not all the same. ``near``: places whose hash is the next one's; ``same``: their bytes too."""
    by = by.copy()
    _, first, last = runs(np.zeros(len(near), int), near)
    clash = np.add.reduceat(~same, np.searchsorted(near, first)) > 0
    for lo, hi in zip(first[clash].tolist(), (last[clash] + 2).tolist(), strict=True):
        by[lo:hi] = sorted(by[lo:hi].tolist(), key=lambda i: data[start[i] : start[i] + length].tobytes())
    return by


def window_classes(contexts: list[bytes], gram: np.ndarray, d0: np.ndarray, d1: np.ndarray, length: int) -> tuple:
    """Every window of the contexts: context, distance, whether an equal one is at the same
    distance from the same k-gram, whether it comes first of those equal to it; and hashes
    of the windows with given numbers. A context is the text from d1 before its anchor."""
    sizes = np.array([len(c) for c in contexts])
    at = np.cumsum(sizes) - sizes
    hashed = Hashed(np.frombuffer(b"".join(contexts), np.uint8))
    count = d1 - d0 + 1
    context = np.repeat(np.arange(len(contexts)), count)
    d = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + d0[context]
    start = at[context] + d1[context] - d
    repeated, first = np.zeros(len(d), bool), np.ones(len(d), bool)
    # a bucket holds the suffixes at one distance from one k-gram; those alone in theirs have no equal
    number = np.unique(gram, return_inverse=True)[1].astype(np.int64)
    bucket = number[context] * 4096 + d
    by = np.argsort(bucket, kind="stable")
    b = bucket[by]
    alone = np.concatenate(([True], b[1:] != b[:-1])) & np.concatenate((b[1:] != b[:-1], [True]))
    by, b = by[~alone], b[~alone]
    if len(by):
        by = by[suffix_order(hashed, start[by], b, length)]
        x, y = start[by[:-1]], start[by[1:]]
        near = np.flatnonzero(bucket[by[:-1]] == bucket[by[1:]])
        near = near[hashed.of(x[near], x[near] + length) == hashed.of(y[near], y[near] + length)]
        same = _same_bytes(hashed.data, x[near], y[near], length)
        if not same.all():
            by = _by_bytes(hashed.data, start, by, near, same, length)
            same = _same_bytes(hashed.data, start[by[near]], start[by[near + 1]], length)
        near = near[same]
        repeated[by[near]] = repeated[by[near + 1]] = True
        first[by[near + 1]] = False
    return context, d, repeated, first, lambda i: mix(hashed.of(start[i], start[i] + length))


def runs(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive ``at`` within equal keys: key, first, last (input sorted by both)."""
    new = np.flatnonzero((np.diff(key) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(at) - 1]))
    return key[first], at[first], at[last]


def _in_buckets(length: int):
    """Stream contexts that come sorted by bucket through ``window_classes``. A row is a range
    of repeated windows, or, of k-grams with several buckets, a window that goes on: the
    first of each class, ``known`` if it is settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            end = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
            part, held = table.slice(0, end), table.slice(end).combine_chunks().to_batches()
            if not end:
                return
            row, a, d0, d1, gram = (part.column(c).to_numpy().astype(np.int64) for c in ("_row", "a", "d0", "d1", "gram"))
            single, several = part.column("single").to_numpy(), part.column("several").to_numpy()
            texts = [x.as_py() for x in part.column("bytes")]
            context, d, repeated, first, hashes = window_classes(texts, key[:end], d0, d1, length)
            start = a[context] - d
            out = np.flatnonzero(repeated & single[context])  # the others are known to be repeated
            if len(out):
                by = out[np.lexsort((start[out], context[out]))]
                c, lo, hi = runs(context[by], start[by])
                n = len(c)
                nothing = [pa.nulls(n, t) for t in PLACED.types[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(row[c]), pa.array(lo), pa.array(hi), *nothing], PLACED.names)
            on = np.flatnonzero(several[context] & first)
            for at in range(0, len(on), 20_000):
                o = on[at : at + 20_000]
                c = context[o]
                windows = [texts[i][x - y : x - y + length] for i, x, y in zip(c.tolist(), d1[c].tolist(), d[o].tolist(), strict=True)]
                cols = [row[c], start[o], start[o], gram[c], d[o].astype(np.int16), hashes(o).view(np.int64), repeated[o] | ~single[c], windows]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, PLACED.types, strict=True)], PLACED.names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 2000:
                yield from settle(False)
        if held:
            yield from settle(True)

    return run


PLACED = pa.schema([("_row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("gram", pa.int64()), ("d", pa.int16()), ("h", pa.int64()), ("known", pa.bool_()), ("bytes", pa.binary())])
PLACED_DDL = "_row long, first long, last long, gram long, d short, h long, known boolean, bytes binary"


def across_buckets(placed: DataFrame, length: int) -> DataFrame:
    """(_row, first, last) of the windows whose equals are in other buckets of their k-gram."""
    key = F.xxhash64("gram", "d", "h").alias("key")
    windows = placed.where("bytes is not null").withColumn("key", key)
    # a key has at most one row for each bucket and class; those with one row have no equal
    twice = shared.cut(windows.groupBy("key").count().where("count > 1").select("key"), "twice")
    asked = windows.join(twice, "key").select("_row", F.col("first").alias("a"), F.lit(0).cast("short").alias("d0"), F.lit(0).cast("short").alias("d1"), "gram", (~F.col("known")).alias("single"), F.lit(False).alias("several"), "key", "bytes")
    return asked.repartition("key").sortWithinPartitions("key").mapInArrow(shared.lean(_in_buckets(length)), PLACED_DDL).select("_row", "first", "last")


def _packed(rows: DataFrame) -> DataFrame:
    """(_row, blob): the texts as zstandard bytes, for the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blobs = [pack(x.as_buffer()) if x.is_valid else None for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["_row", "blob"])

    return rows.mapInArrow(shared.lean(run), "_row long, blob binary")


def _bytes(blob) -> bytes:
    import zstandard

    return zstandard.decompress(blob.as_buffer()) if blob.is_valid else b""


def parts_of(data: bytes, a: int, d0: int, d1: int, gram: int, length: int) -> Iterator[tuple[int, int, int]]:
    """A context in parts of PART distances: first, last, and a hash of the k-gram, the place
    and the bytes that lie in every window of the part."""
    for lo in range(d0 // PART * PART, d1 + 1, PART):
        shared_by_all = data[a - lo : a - lo + max(0, length - PART + 1)]
        digest = hashlib.blake2b(b"%d %d " % (gram, lo) + shared_by_all, digest_size=8).digest()
        yield max(d0, lo), min(d1, lo + PART - 1), int.from_bytes(digest, "little", signed=True)


def _contexts(length: int):
    """The bytes around the anchors that a row's list asks for, those of crowded k-grams in parts."""

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CONTEXT.types, strict=True)], CONTEXT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, blob, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = _bytes(blob)
                for x in wanted:
                    a, gram = x["a"], x["gram"]
                    parts = parts_of(data, a, x["d0"], x["d1"], gram, length) if x["several"] else [(x["d0"], x["d1"], x["key"])]
                    out += [(row, a, d0, d1, gram, x["single"], x["several"], key, data[a - d1 : a - d0 + length]) for d0, d1, key in parts]
                    if len(out) >= ROWS:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    return run


CONTEXT = pa.schema([("_row", pa.int64()), ("a", pa.int64()), ("d0", pa.int16()), ("d1", pa.int16()), ("gram", pa.int64()), ("single", pa.bool_()), ("several", pa.bool_()), ("key", pa.int64()), ("bytes", pa.binary())])
CONTEXT_DDL = "_row long, a long, d0 short, d1 short, gram long, single boolean, several boolean, key long, bytes binary"


def repeated_ranges(rows: DataFrame, length: int = LENGTH, kgram: int = KGRAM, bucket: int = 1000) -> DataFrame:
    """(_row, first, last): ranges of window starts of ``rows`` (_row long, _text
    string; a stable scan) whose ``length`` bytes also start anywhere else."""
    found = shared.cut(find_anchors(rows, length, kgram), "anchors")
    differ = lambda c: F.min(c) != F.max(c)
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), (differ("span") | differ("check")).alias("mixed")).where("n > 1")
    # written, so that both sides of the join have exchanges of their own
    grams = shared.cut(grams, "grams")
    shown = shared.cut(shared.join_side(found, grams, ["gram"], "n", found.count()).drop("n"), "repeated")
    start = [(F.col("a") - F.col("d1")).alias("first"), (F.col("a") - F.col("d0")).alias("last")]
    ranges = shown.where("not mixed").select("_row", *start)

    mixed = shown.where("mixed")
    spans = mixed.groupBy("gram", "span", "check").agg(F.count("*").alias("n"), F.min(F.struct("_row", "a", "d0", "d1")).alias("one"))
    spans = shared.cut(spans, "spans")
    again = spans.where("n > 1").select("gram", "span", "check", "n")
    ranges = ranges.unionByName(shared.join_side(mixed, again, ["gram", "span", "check"], "n", mixed.count()).select("_row", *start))

    sizes = shared.cut(spans.groupBy("gram").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1"), "sizes")
    asked = shared.join_side(spans, sizes, ["gram"], "contexts", spans.count())
    asked = asked.select("one.*", "gram", (F.col("n") == 1).alias("single"), (F.col("contexts") > bucket).alias("several"), F.xxhash64("gram").alias("key"))
    wanted = asked.groupBy("_row").agg(F.collect_list(F.struct("a", "d0", "d1", "gram", "single", "several", "key")).alias("wanted"))  # a text's own anchors
    contexts = shared.cut(_packed(rows).join(wanted, "_row").select("_row", "blob", "wanted").mapInArrow(shared.lean(_contexts(length)), CONTEXT_DDL), "contexts", "zstd")
    parts = contexts.where("several")
    met = shared.cut(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    dealt = F.pmod(F.xxhash64("_row", "a"), F.ceil(F.col("n") / bucket))
    parts = shared.join_side(parts, met, ["key"], "n", parts.count()).withColumns({"several": F.col("n") > bucket, "key": F.xxhash64("key", dealt)})
    filed = contexts.where("not several").unionByName(parts.select(*contexts.columns))
    placed = shared.cut(filed.repartition("key").sortWithinPartitions("key").mapInArrow(shared.lean(_in_buckets(length)), PLACED_DDL), "placed", "zstd")
    ranges = ranges.unionByName(placed.where("bytes is null").select("_row", "first", "last"))
    return ranges.unionByName(across_buckets(placed, length))


def removed_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) of the bytes under windows with starts first..last."""
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(last[by] + length)
    new = np.concatenate(([True], first[1:] > end[:-1]))
    return first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _stripped(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, blob, first, last in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                data, removed, spans = _bytes(blob), 0, 0
                kept = data
                if first.is_valid:
                    begin, end = removed_spans(np.asarray(first.values), np.asarray(last.values), length)
                    cuts = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(data)]
                    kept = b"".join(data[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))
                    removed, spans = len(data) - len(kept), len(begin)
                out.append((row, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if removed else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), STRIPPED.types, strict=True)] if out else [pa.array([], t) for t in STRIPPED.types], STRIPPED.names)

    return run


STRIPPED = pa.schema([("_row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
STRIPPED_DDL = "_row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def strip_repeats(rows: DataFrame, length: int = LENGTH, kgram: int = KGRAM, bucket: int = 1000) -> DataFrame:
    """For each of ``rows`` (_row, _text): byte counts, the hash of what is left,
    and, where anything went, the remaining bytes as ``kept``."""
    ranges = repeated_ranges(rows, length, kgram, bucket)
    lists = ranges.groupBy("_row").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))  # a text's own ranges
    return _packed(rows).join(lists, "_row", "left").select("_row", "blob", "first", "last").mapInArrow(shared.lean(_stripped(length)), STRIPPED_DDL)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text_col``; a character that is
    cut in two goes whole. Every row stays, with all its columns."""
    rows = shared.boxed(docs)
    text = shared.field(text_col).cast("string")
    cuts = strip_repeats(rows.select("_row", text.alias("_text")), length).where("n_removed > 0").select("_row", "kept")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [bytes(x).decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_kept"])

    joined = rows.join(cuts.mapInArrow(shared.lean(decoded), "_row long, _kept string"), "_row", "left")
    return joined.select(*[F.coalesce("_kept", text).alias(c) if c == text_col else x for c, x in zip(docs.columns, shared.unboxed(docs.columns), strict=True)])


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.with_row(shared.documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("_text")))
    out = strip_repeats(rows.select("_row", "_text")).drop("kept")
    return rows.select("_row", "doc_id").join(out, "_row").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
  SELECT *, length(h) // 2 AS n FROM d
), w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT r, h, unnest(range(n - 199)) AS i FROM n WHERE n >= 200)
), again AS (
  SELECT g FROM w GROUP BY g HAVING count(*) > 1
), s AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN again USING (g)
), k AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM s
), span AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, k
), parts AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM span
), kept AS (
  SELECT r, count(*) AS spans, sum(b - a) AS removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM parts JOIN n USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM n LEFT JOIN kept USING (r)
"""
