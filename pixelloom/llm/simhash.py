"""SimHash near-duplicates by anchor-point covering.

The 64-bit fingerprint is laid out in three blocks of 22, 21 and 21 bits, each
padded with zeros to the 23 bits of the binary Golay code, whose words are the
anchors: the code is perfect, every point lies within 3 bits of exactly one
anchor. Fingerprints at 5 or fewer differing bits differ in at most one bit of
some block, so if one of them has its home at an anchor (within 3), the other
lies within 3 + 1 bits of that same anchor. Each distinct fingerprint is sent,
for each block, to all anchors within 4 (one home and at most five visits), and
the homes of an anchor are compared with all that came. No link is lost.

An anchor that drew more than ``cell`` fingerprints is dealt out as a grid of
cells, each a chunk of homes against a chunk of comers, which sends a fingerprint
to as many cells as there are chunks. Where that would be more than a second step
sends (``DEEP``), the anchor is split by the same covering over the two other blocks
instead: one of them has at most half of the differing bits, 2, so the home of one
fingerprint there is within 3 + 2 bits of the other. What is sent to a crowded
anchor is thus a constant number of copies, however many fingerprints there are.
A cell sends on a spanning forest of the links that it found, never all pairs of a
dense group.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other. Very long texts are read whole. Repeated rows share a
component. A null id is never the component's id unless the component has no
other. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
RADIUS = 3  # the code's covering radius
MAX_BITS = 5  # three blocks, one differing bit each, and two more would need a second bit in each
#: Copies of a fingerprint that a second covering step sends, on average: two blocks, 22 anchors each.
DEEP = 44


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, or of the whole text if it has no more words; split at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, hash64 = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hash64(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((hash64(joined[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Majority of the shingles' bits, zero for a text without words."""
    return majority(text, shingles(text, words, seed))


def majority(text: str | None, hashes: np.ndarray) -> int:
    """``fingerprint`` of a text whose shingles are known."""
    if not (text or "").encode("utf-8", "surrogatepass").strip():
        return 0
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(shared.lean(run), "id long, fp long")


@lru_cache
def _golay(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and for each syndrome the
    error patterns of weight <= ``reach`` (first the coset leader) and their count."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(reach + 1):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[low[e & 0xFFF] ^ high[e >> 12]].append(e)
    most = max(map(len, found))
    table = np.array([x + [0] * (most - len(x)) for x in found], np.int64)
    return low, high, table, np.array([len(x) for x in found], np.int64)


def anchors(fps: np.ndarray, reach: int = RADIUS + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor number, is home) of every visit to an anchor within ``reach``."""
    low, high, table, count = _golay(reach)
    index, number, home = [], [], []
    for k, (at, width) in enumerate(BLOCKS):
        x = ((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = low[x & 0xFFF] ^ high[x >> 12]
        for j in range(table.shape[1]):
            has = np.flatnonzero(count[s] > j)
            # the code is cyclic and systematic: the upper 12 bits name its word
            index.append(has)
            number.append((x[has] ^ table[s[has], j]) >> 11 | k << 12)
            home.append(np.full(len(has), j == 0))
    return np.concatenate(index), np.concatenate(number), np.concatenate(home)


def _links(fps: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> list[np.ndarray]:
    """Spanning forest of the links (at most ``bits`` differing) between fps[left]
    and fps[right], as arrays of index pairs."""
    out, label, dense = [], None, np.uint8(bits)
    theirs = fps[right]
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        mine = left[at : at + step]
        hit = np.bitwise_count(fps[mine][:, None] ^ theirs[None, :]) <= dense
        i, j = np.nonzero(hit) if hit.sum() <= 8 * len(right) else (None, None)
        if i is not None:
            a, b = mine[i], right[j]
            out.append(np.stack([a[a != b], b[a != b]], axis=1))
            continue
        if label is None:
            label = np.arange(len(fps))
        for row, me in zip(hit, mine, strict=True):  # dense: only links that join two trees
            near = right[row]
            near = near[label[near] != label[me]]
            if len(near):
                trees, first = np.unique(label[near], return_index=True)
                out.append(np.stack([np.full(len(first), me), near[first]], axis=1))
                label[np.isin(label, trees)] = label[me]
    return out


def link_forest(distinct: DataFrame, bits: int = 4, cell: int = 20_000, deepest: int = DEEP) -> DataFrame:
    """Edges (a, b) that join all linked fingerprints of ``distinct`` (fp long)."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the covering holds for 0 to {MAX_BITS} bits")
    spark = distinct.sparkSession

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            index, number, home = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(home), pa.array(fps[index].view(np.int64))], ["anchor", "home", "fp"])

    visits = shared.cut(distinct.select("fp").mapInArrow(shared.lean(visit), "anchor int, home boolean, fp long"), "visits")
    # 3 * 4096 anchors whatever the input: their counts fit anywhere
    counts = {r.anchor: r["count"] for r in visits.groupBy("anchor").count().where(F.col("count") > cell).collect()}
    deep = spark.createDataFrame([(a,) for a, n in counts.items() if n > deepest * cell], "anchor int")

    def visit_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                first, fps = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
                index, number, home = anchors(fps, RADIUS + MAX_BITS // 2)
                other = first[index] >> 12 != number >> 12
                index, number, home = index[other], number[other], home[other]
                path = first[index].astype(np.int64) << 14 | number
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(home & batch.column(1).to_numpy(zero_copy_only=False)[index]), pa.array(fps[index].view(np.int64))], ["anchor", "home", "fp"])

    plain = visits.join(F.broadcast(deep), "anchor", "left_anti").select((F.col("anchor") - (1 << 14)).cast("long").alias("anchor"), "home", "fp")  # below all paths
    if any(n > deepest * cell for n in counts.values()):
        again = visits.join(F.broadcast(deep), "anchor", "left_semi").select("anchor", "home", "fp").mapInArrow(shared.lean(visit_again), "anchor long, home boolean, fp long")
        plain = shared.cut(plain.unionByName(again), "visits-again")
        # 12,288 anchors have 8,192 below them at most, and only those with more than a cell are asked for
        grid = shared.cut(plain.groupBy("anchor").count().where(F.col("count") > cell).select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("k")), "grid")
    else:
        grid = F.broadcast(spark.createDataFrame([(a - (1 << 14), -(-n // cell)) for a, n in counts.items()], "anchor long, k int"))
    dealt = plain.join(grid, "anchor", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    # as comer to every row of the grid; as home also to every column; once where both meet
    as_comer = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), (F.col("home") & (i == F.col("c"))).alias("l"), F.lit(True).alias("r")))
    as_home = F.transform(F.filter(every, lambda j: F.col("home") & (j != F.col("c"))), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(True).alias("l"), F.lit(False).alias("r")))
    cells = dealt.withColumn("c", chunk).withColumn("to", F.explode(F.concat(as_comer, as_home))).select("anchor", "to.i", "to.j", "to.l", "to.r", "fp")
    cells = cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            table = pa.Table.from_batches(held)
            a, i, j = (table.column(c).to_numpy() for c in ("anchor", "i", "j"))
            new = np.flatnonzero((np.diff(a) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            ends = [*new.tolist(), *([len(a)] if last else [])]
            left, right = (table.column(c).to_numpy() for c in ("l", "r"))
            fps, start, edges = table.column("fp").to_numpy().view(np.uint64), 0, []
            for end in ends:
                if end - start > 1:
                    f = fps[start:end]
                    for pairs in _links(f, np.flatnonzero(left[start:end]), np.flatnonzero(right[start:end]), bits):
                        edges.append(f[pairs])
                start = end
            held = table.slice(start).combine_chunks().to_batches()  # the cell that goes on
            if edges and len(e := np.concatenate(edges)):
                e = e.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 100_000:
                yield from settle(False)
        yield from settle(True)

    return cells.mapInArrow(shared.lean(compare), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, cell: int = 20_000, deepest: int = DEEP) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of ``docs``."""
    fps = shared.cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = shared.cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(link_forest(distinct, bits, cell, deepest), "links").select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    # only fingerprints of groups; written, so that Spark can split the documents of a hot one
    known = shared.cut(placed.join(groups, "root").select("fp", "component_id"), "grouped")
    return fps.join(known, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.documents(spark, sf_dir))
