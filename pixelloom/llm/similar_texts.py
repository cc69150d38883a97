"""Groups of texts whose word shingles have a given Jaccard similarity, verified exactly.

Candidates come from SimHash: texts whose fingerprints differ in at most ``bits`` bits, found by
op4's covering, are joined to the least id of their component. That finds what is nearly
equal, but at 0.8 two texts differ in about 10 of 64 bits, and no covering reaches so
far. So MinHash adds candidates for the rest: a text's ``BANDS * ROWS`` minima are cut into
bands, and texts that agree in a whole band are candidates too. A pair of similarity s is
missed by these with probability (1 - s^ROWS)^BANDS: 7e-10 at 0.8, less above. Links of
either kind count only after the exact comparison that follows.

Every text of a crowded band is first compared with the band's least id, one
comparison a text however large the group of copies. Bands join their texts to
clusters, and a cluster whose texts these links already join needs no more. In the
others, every text outside the largest part is compared with all texts of the
cluster, by the sizes of their shingle sets and of what these share; a cluster of more
than ``cell`` texts is dealt out as a grid of chunks of either side. A cell sends on a
spanning forest of its links. Pairs inside the largest part are joined already, so no
link between different groups is lost.

Defined results: shingles are those of op4's fingerprints; null, empty and blank
texts are alike; very long texts are read whole. Shingles are told apart by 64-bit
hashes. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash
from .components import components

BANDS, ROWS = 40, 4
_RNG = np.random.default_rng(42)
XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
FACTOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over ``hashes``."""
    low, out = hashes.astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1 << 10):
        mixed = (low[None, at : at + (1 << 10)] ^ XOR[:, None]) * FACTOR[:, None]
        np.minimum(out, mixed.min(axis=1), out=out)
    return out


def bands(docs: DataFrame, words: int) -> DataFrame:
    """(key, id, fingerprint), a row for each band of every text of ``docs`` (id, text), and one for
    its SimHash fingerprint, which is the key there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty((batch.num_rows, BANDS + 1), np.uint64)
            for i, text in enumerate(batch.column(1)):
                hashes = simhash.shingles(text.as_py(), words)
                rows = minima(hashes).reshape(BANDS, ROWS)
                keys[i] = [*(xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)), simhash.majority(text.as_py(), hashes)]
            ids = np.repeat(batch.column(0).to_numpy(), BANDS + 1)
            last = np.tile(np.arange(BANDS + 1) == BANDS, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids), pa.array(last)], ["key", "id", "fingerprint"])

    return docs.mapInArrow(shared.lean(run), "key long, id long, fingerprint boolean")


def fingerprint_stars(fps: DataFrame, bits: int = simhash.MAX_BITS) -> DataFrame:
    """(id, least): texts of ``fps`` (fp, id) that links of at most ``bits`` differing bits join, each with the
    least id of its component."""
    distinct = shared.cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fingerprints")
    roots = components(simhash.link_forest(distinct, bits), "fingerprint-links").select(F.col("node").alias("fp"), "root")
    placed = shared.cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    groups = placed.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("size")).where("size > 1")
    known = shared.cut(placed.join(groups, "root").select("fp", F.col("first").alias("least"), "n"), "known")
    return shared.join_side(fps, known, ["fp"], "n", fps.count()).where("id <> least").select("id", "least")


def forest(sets: list[np.ndarray], at_least: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of ``sets`` that reach the similarity, by
    breadth-first search over the lists of each shingle's texts."""
    size = np.array([len(s) for s in sets])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    mine = np.split(shingle, np.cumsum(size)[:-1])
    alone = np.ones(len(sets), bool)  # not reached yet
    listed = stale = 0

    def lists() -> tuple[np.ndarray, np.ndarray]:
        keep = alone[owner]
        order = np.argsort(shingle[keep], kind="stable")
        return owner[keep][order], np.concatenate(([0], np.cumsum(np.bincount(shingle[keep], minlength=shingle.max() + 1))))

    (texts, starts), listed, edges = lists(), len(sets), []
    for first in range(len(sets)):
        if not alone[first]:
            continue
        alone[first], queue, stale = False, [first], stale + 1
        while queue:
            x = queue.pop()
            if 2 * stale > listed:  # lists without the texts already reached
                (texts, starts), listed, stale = lists(), int(alone.sum()), 0
            a, n = starts[mine[x]], starts[mine[x] + 1] - starts[mine[x]]
            total = int(n.sum())
            if not total:
                continue
            y, both = np.unique(texts[np.arange(total) + np.repeat(a - (np.cumsum(n) - n), n)], return_counts=True)
            near = y[alone[y] & (both >= at_least * (size[x] + size[y] - both) - 1e-9)]
            alone[near], stale = False, stale + len(near)
            edges += [(x, int(v)) for v in near]
            queue += near.tolist()
    return edges


def shingle_sets(placed: DataFrame, words: int) -> DataFrame:
    """(cluster, id, hashes) from (cluster, id, text): the sorted set of a text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [simhash.shingles(t.as_py(), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.unique(h).tobytes() for h in hashes], pa.binary())], ["cluster", "id", "hashes"])

    return placed.mapInArrow(shared.lean(run), "cluster long, id long, hashes binary")


def star_links(sets: DataFrame, stars: DataFrame, at_least: float, share: int = 2000) -> DataFrame:
    """The pairs of ``stars`` (id, least) that reach the similarity, as (a, b). A star of many
    texts is dealt over several groups of about ``share``, each with a copy of its centre."""
    sizes = shared.cut(stars.groupBy("least").agg(F.count("*").alias("n")), "stars-sizes")
    salts = F.ceil(F.col("n") / share).cast("int")
    rays = shared.join_side(stars, sizes, ["least"], "n", stars.count()).select("least", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(1).alias("ray"), "id")
    centres = sizes.select("least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("ray"), F.col("least").alias("id"))
    rows = rays.unionByName(centres).join(sets.select("id", "hashes"), "id").repartition("least", "salt").sortWithinPartitions("least", "salt", "ray")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for least, ray, i, h in zip(*(batch.column(c).to_pylist() for c in ("least", "ray", "id", "hashes")), strict=True):
                mine = np.frombuffer(h, np.uint64)
                if not ray:
                    centre = mine
                    continue
                both = len(np.intersect1d(centre, mine, assume_unique=True))
                if both >= at_least * (len(centre) + len(mine) - both) - 1e-9:
                    a.append(i)
                    b.append(least)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(shared.lean(compare), "a long, b long")


def links(sets: DataFrame, groups: DataFrame, at_least: float, cell: int) -> DataFrame:
    """Edges (a, b) that join the similar texts of each cluster of ``sets`` (cluster, id, hashes)
    which ``groups`` (id, root), the texts that are joined already, leave in several parts."""
    parted = shared.cut(sets.select("cluster", "id").join(groups, "id", "left").select("cluster", "id", F.coalesce("root", "id").alias("part")), "parts")
    sizes = parted.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    several = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    chunks = lambda n: F.ceil(n / cell).cast("int")
    several = shared.cut(several.select("cluster", "main", "n", chunks(F.col("n")).alias("k"), chunks(F.col("n") - F.col("most")).alias("m")), "several")
    placed = shared.join_side(parted, several, ["cluster"], "n", parted.count())
    at = F.xxhash64("id")
    # a text meets, as a comer, every chunk of those outside the main part; one of these meets every chunk of comers
    dealt = placed.withColumn("i", F.pmod(at, F.col("m")).cast("int")).withColumn("j", F.pmod(at, F.col("k")).cast("int"))
    comer = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    home = F.when(F.col("part") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    cells = dealt.select("cluster", "id", F.explode(F.array_union(comer, home)).alias("to")).select("cluster", "to.i", "to.j", "id")
    cells = cells.join(sets.select("id", "hashes"), "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_, ids, found = None, [], []

        def settle() -> Iterator[pa.RecordBatch]:
            edges = forest(found, at_least) if len(found) > 1 else []
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in edges], pa.int64()), pa.array([ids[b] for _, b in edges], pa.int64())], ["a", "b"])

        for batch in batches:
            for c, i, j, d, h in zip(*(batch.column(x).to_pylist() for x in ("cluster", "i", "j", "id", "hashes")), strict=True):
                if (c, i, j) != cell_:
                    yield from settle()
                    cell_, ids, found = (c, i, j), [], []
                ids.append(d)
                found.append(np.frombuffer(h, np.uint64))
        yield from settle()

    return cells.mapInArrow(shared.lean(compare), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, at_least: float = 0.8, cell: int = 500, share: int = 2000) -> DataFrame:
    """(id, root) of the texts that have another one as similar as ``at_least``, or are
    joined to it by a chain of such; ids are unique longs."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = shared.cut(bands(texts, words), "bands")
    keys = every.where("not fingerprint").select("key", "id")
    alike = fingerprint_stars(every.where("fingerprint").select(F.col("key").alias("fp"), "id"))
    crowded = shared.cut(keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "crowded")
    stars = shared.cut(shared.join_side(keys, crowded, ["key"], "n", keys.count()).where("id <> least").select("id", "least").unionByName(alike).distinct(), "stars")
    clusters = components(stars.select(F.col("id").alias("a"), F.col("least").alias("b")), "candidates")
    sets = shared.cut(shingle_sets(texts.join(clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")), "id").select("cluster", "id", "text"), words), "sets")
    sure = shared.cut(star_links(sets, stars, at_least, share), "sure")
    groups = components(sure, "groups").select(F.col("node").alias("id"), "root")
    more = shared.cut(links(sets, groups, at_least, cell), "more")
    if more.isEmpty():
        return groups
    return components(sure.unionByName(more), "links").select(F.col("node").alias("id"), "root")
