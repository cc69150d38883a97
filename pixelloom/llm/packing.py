"""Mixture-controlled packing by deficit round-robin.

Every source has a queue of its documents' tokens. A window of ``window`` tokens
is filled by one round over the queues: each gives its share of the window, and
what rounding leaves over or short is carried to the next window, so a queue stays
within two tokens of its target, over all windows so far. Shares
follow ``targets`` (or, by default, the sources' own parts of all tokens); a
queue that runs dry leaves its share to the others.

The round-robin needs no pass in order: the carried deficits have a closed form
(``shares``), in which a queue's token finds its window by itself. A document's place
in its queue is a prefix sum over partitions, so deficits carry over from partition to
partition, and no source is gathered anywhere.

Sources with a token or more for each window (at most ``window`` of them), or those
that ``targets`` names, are a list that every task holds. All others are a table: the
splits of the tree that lead to each are joined to its documents.

The last window may be short; it is split into sequences at powers of two, so
that nothing is padded at all.

Defined results: a null text is an empty document of one end token. A null
source is a source of its own. Every source has its target, however many there are and
however small: one that is due less than a token a window gives one every few windows.
With ``targets`` a source that is not named, or whose target is no finite number over
nought, is served when the others are dry, in proportion to its tokens. Very long texts are cut at
windows like any other. Repeated rows are packed each by itself. Further columns are
ignored, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, shares

WINDOW = 4096
END = 2
#: Parts of words whose ids a worker remembers before it starts anew; it still knows
#: those of the time before, so frequent ones are never learned again.
REMEMBERED = 300_000


@lru_cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts in Latin scripts, where lower case and character classes are beyond doubt.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
#: White space to str.split, but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == kind)


#: How the tokenizer splits plain text, with letters first (fixed pattern; it is in the tokenizer's file).
_PARTS = re.compile(f"[{_of('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_of('N')}]|[^\\s{_of('L')}{_of('N')}]+").findall


def parts_of(text: str | None) -> list[str]:
    """The text in parts that the tokenizer encodes each by itself. Plain texts fall
    apart as in the tokenizer's own splitter, in lower case, as in its normaliser;
    others at white space, which it drops, and have a new line in front."""
    if not text:
        return []
    if "<|" not in text and _PLAIN.fullmatch(text):
        return _PARTS(text.lower())
    words = re.split("[ \t-\r]+", text) if _SEPARATORS.search(text) else text.split()
    return [f"\n{w}" for w in words if w]


class PartIds(dict):
    """Ids of the parts of texts as uint16 bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.old = _tokenizer(path), {}
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends_part = np.zeros(1 << 16, bool)
        self.ends_part[ends] = True

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; parts not seen before are learned together."""
        parts = [parts_of(t) for t in texts]
        found = [list(map(self.get, p)) for p in parts]
        short = [k for k, f in enumerate(found) if None in f]
        self.learn({p for k in short for p, x in zip(parts[k], found[k], strict=True) if x is None})
        for k in short:
            found[k] = [self[p] if x is None else x for p, x in zip(parts[k], found[k], strict=True)]
        out = [b"".join(f) for f in found]
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        return out

    def learn(self, parts: set[str]) -> None:
        for p in parts & self.old.keys():
            self[p] = self.old[p]
        plain = [p for p in parts if p not in self and p[0] != "\n"]
        # one call for all: every part's last token, and no other, ends a word
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint16)
        cuts = (np.flatnonzero(self.ends_part[flat]) + 1).tolist()
        if len(cuts) != len(plain):
            raise ValueError("the tokenizer does not take parts apart at word ends")
        data, at = flat.tobytes(), 0
        for p, end in zip(plain, cuts, strict=True):
            self[p] = data[2 * at : 2 * end]
            at = end
        whole = [p for p in parts if p not in self]
        for p, e in zip(whole, self.tokenizer.encode_batch_fast([p[1:] for p in whole], add_special_tokens=False), strict=True):
            self[p] = np.array(e.ids, np.uint16).tobytes()


@lru_cache
def _part_ids(path: str) -> PartIds:
    return PartIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenise(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids as uint16 bytes with the end
    token; before counts the source's tokens that precede in partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, end = _part_ids(tokenizer), np.array([END], np.uint16).tobytes()
        part, so_far = TaskContext.get().partitionId(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [i + end for i in held.ids(batch.column(1).to_pylist())]
                before = []
                for source, i in zip(batch.column(2).to_pylist(), ids, strict=True):
                    before.append(so_far.get(source, 0))
                    so_far[source] = before[-1] + len(i) // 2
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([part] * n, pa.int32()), pa.array(before, pa.int64()), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    return rows.mapInArrow(shared.lean(run), "doc_id long, source string, part int, before long, n long, ids binary")


def sequence_of(total: int, window: int) -> Callable[[int], tuple[int, int, int]]:
    """position -> (sequence, its first position, its length); the short last window
    is split at powers of two."""
    full, tail, at = total // window, [], total // window * window
    for bit in range((total - at).bit_length() - 1, -1, -1):
        if (total - at) >> bit & 1:
            tail.append((full + len(tail), at, 1 << bit))
            at += 1 << bit
    starts = [t[1] for t in tail]
    return lambda v: (v // window, v // window * window, window) if v < full * window else tail[bisect_right(starts, v) - 1]


def tail_paths(tail: DataFrame, spread: int = 10_000) -> DataFrame:
    """(source, path) of the sources of ``tail`` (source, n), which share one queue: the splits on
    the way to each in a tree over the bits of its number, the lowest first, that have tokens on
    both sides. Sources are numbered by size in buckets of about ``spread``, so that both sides
    of a split hold about as much."""
    n = tail.count()
    buckets = 1 << (max(1, -(-n // spread)) - 1).bit_length()
    bucket = F.pmod(F.xxhash64("source", F.col("source").isNull()), F.lit(buckets))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), "source")) - 1
    numbered = shared.cut(tail.withColumn("bucket", bucket).select("source", "n", (within * F.lit(buckets) + F.col("bucket")).alias("number")), "numbered")
    levels = max(1, numbered.agg(F.max("number")).first()[0].bit_length())
    steps = numbered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).selectExpr("source", "n", "level", "number & (shiftleft(1L, level) - 1) node", "cast(shiftright(number, level) & 1 as int) side")
    held = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    nodes = shared.cut(steps.groupBy("level", "node").agg(held(0).alias("left"), held(1).alias("right"), F.count("*").alias("rows")), "nodes")
    met = shared.join_side(steps.drop("n"), nodes, ["level", "node"], "rows", n * levels).where("left > 0 and right > 0")
    return met.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "side", "left", "right"))).alias("path"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, targets: dict[str, float] | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of a document: doc_id, source, start, length,
    ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = shared.cut(tokenise(docs, id_col, text_col, source_col, tokenizer or default_tokenizer()), "tokens", "zstd")
    sums = shared.cut(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    count = sums.agg(F.sum("n").alias("n")).first().n or 0
    if count == 0:
        return tokens.sparkSession.createDataFrame([], PIECE_DDL)
    spark = tokens.sparkSession
    by_source = shared.cut(sums.groupBy("source").agg(F.sum("n").alias("n")), "by-source")
    if targets is None:
        apart = by_source.where(F.col("n") >= -(-count // window))  # at most ``window`` of them
    else:
        wanted = spark.createDataFrame([(s,) for s in targets], "wanted string")
        apart = by_source.join(F.broadcast(wanted), by_source.source.eqNullSafe(F.col("wanted")), "left_semi")
    totals = {r.source: r.n for r in apart.collect()}
    own = sorted(totals, key=lambda s: (s is not None, s or ""))
    rest = count - sum(totals.values())
    sizes = [totals[s] for s in own] + [rest]
    paths = shares.own_shares(sizes) if targets is None else shares.schedule(sizes, [*(float(targets[s]) for s in own), 0.0])

    known = F.broadcast(spark.createDataFrame([(s, q) for q, s in enumerate(own)], "known string, queue int"))
    order = Window.partitionBy("source").orderBy("part")
    bases = sums.join(known, sums.source.eqNullSafe(F.col("known")), "left").select("source", "part", F.coalesce("queue", F.lit(len(own))).alias("queue"), (F.sum("n").over(order) - F.col("n")).alias("base"))
    if rest:
        inner = tail_paths(by_source.join(known, by_source.source.eqNullSafe(F.col("known")), "left_anti")).withColumnRenamed("source", "of")
        bases = bases.join(inner, bases.source.eqNullSafe(inner.of), "left").drop("of")
    else:
        bases = bases.withColumn("path", F.lit(None).cast(TAIL_PATH))
    bases = shared.cut(bases.withColumnsRenamed({"source": "s", "part": "p"}), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, queues = sequence_of(count, window), {}
        for batch in batches:
            out: list[tuple] = []
            for doc, source, q, x, path, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "queue", "x", "path", "ids")), strict=True):
                wide = memoryview(np.frombuffer(ids, np.uint16).astype("<u4").tobytes())
                n, done = len(wide) // 4, 0
                if (queue := queues.get((q, source))) is None:
                    if len(queues) >= 2 * window:
                        queues.clear()
                    inner = tuple((shares.even(s["left"], s["right"]), s["side"]) for s in path or ())
                    queue = queues[q, source] = shares.Queue(paths[q] + inner, count, window)
                for v, take in queue.pieces(x, n):
                    while take:
                        seq, first, size = where(v)
                        m = min(take, first + size - v)
                        out.append((doc, source, done, m, zlib.crc32(wide[4 * done : 4 * (done + m)]), n, seq, v - first))
                        v, take, done = v + m, take - m, done + m
            cols = zip(*out, strict=True) if out else [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PIECES.types, strict=True)], PIECES.names)

    joined = tokens.join(bases, tokens.source.eqNullSafe(bases.s) & (tokens.part == bases.p))
    return joined.select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("x"), "path", "ids").mapInArrow(shared.lean(run), PIECE_DDL)


TAIL_PATH = "array<struct<level:int,side:int,left:long,right:long>>"
PIECE_DDL = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = pa.schema([(c, pa.string() if c == "source" else pa.int64()) for c in ("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.documents(spark, sf_dir))
