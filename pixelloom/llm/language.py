"""Language identification by prediction by partial matching (PPM).

For each language a context tree of byte contexts up to ``order`` bytes is
counted over training texts. A byte's code length in a language is that of PPM
with escape method C under these frozen counts: in the longest context that the
language has seen, a byte seen there costs -log2(c / (T + d)), and any other
costs the escape -log2(d / (T + d)) plus its cost one order lower, down to 8
bits for a byte that order 0 never saw; unseen contexts cost nothing and are
skipped. (T: occurrences of the context, d: different bytes after it.) The text's
language is the one with the shortest code.

Costs of all languages stand side by side: one table for each order holds, for
every context and byte that any language saw, the cost in each of them, so a
byte is looked up once, by a probe in a hash table, and only misses go on to a
lower order.

The model is fitted on a sample of the labelled texts, whole ones, of about
``sample`` rows a language (drawn by a hash of the id), and keeps all their counts;
the bound is a parameter, so the model's size does not grow with the number of
rows. Every text is scored whole.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and every text if nothing was learned; ties go to the first language by name.
The score is the posterior probability of the language under equal priors.
Rows with a null id or language are never learned from, but always scored; very
long texts are scored in pieces, each with the bytes before it as context.
Repeated rows and further columns change nothing; columns named like the added
ones are replaced. An empty table gives no rows. A letter is a character of a
Unicode category L. The model grows with the number of languages, of which a
corpus has hundreds at most, never with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import shared

ORDER = 4
#: The columns that ``identify`` adds; columns of the input that are named like them are replaced.
ADDED = ("lang_pred", "score")
UNDETERMINED = "und"
#: A-Z are counted as a-z.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bytes handled together.
CHUNK = 1 << 20


def _laid_out(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each after ``order`` spaces, the positions of
    the texts' own bytes, and where each text begins among these."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer((pad := b" " * order) + pad.join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    own = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(texts) + 1) * order, sizes)
    return _LOWER[data], own, starts


def _grams(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k+1 bytes that end at each position, as one number, the last byte lowest."""
    key = data[at].astype(np.uint64)
    for j in range(1, k + 1):
        key |= data[at - j].astype(np.uint64) << np.uint64(8 * j)
    return key


def count_contexts(texts: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, n) of ``texts`` (lang, text): occurrences of k context bytes and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs)):
                mine = [raw[i] for i in np.flatnonzero(langs == lang)]
                for group in _in_chunks(mine):
                    data, own, _ = _laid_out(group, order)
                    for k in range(order + 1):
                        gram, n = np.unique(_grams(data, own, k), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    parts = texts.mapInArrow(shared.lean(run), "lang string, k int, gram long, n long")
    return parts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def _in_chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


class Table:
    """Rows of numbers by a 64-bit key: open addressing, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.rows = keys, rows
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several for one slot, the last stays
            placed = self.slots[slot] == todo
            todo, slot = todo[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.slots[slot]
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            out[open_] = self.slots[slot[open_]]
            o = out[open_]
            open_ = open_[(o >= 0) & (self.keys[o] != keys[open_])]
        return out


class Model:
    """Code lengths of every language, by order."""

    def __init__(self, langs: list[str], order: int, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        self.langs, self.order = langs, order
        self.symbols: list[Table] = []
        self.escapes: list[Table] = []
        for k in range(order + 1) if langs else ():
            per = [counts.get((lang, k), (np.zeros(0, np.uint64), np.zeros(0, np.int64))) for lang in langs]
            grams = np.unique(np.concatenate([g for g, _ in per]))
            contexts = np.unique(grams >> np.uint64(8))
            escape = np.zeros((len(contexts), len(langs)), np.float64)
            cost = np.zeros((len(grams), len(langs)), np.float64)
            lower = self._costs(grams & np.uint64((1 << (8 * k)) - 1), k - 1) if k else np.full((len(grams), len(langs)), 8.0)
            for j, (gram, n) in enumerate(per):
                c = np.searchsorted(contexts, gram >> np.uint64(8))
                total = np.bincount(c, n, len(contexts))
                distinct = np.bincount(c, minlength=len(contexts))
                seen = total > 0
                escape[seen, j] = -np.log2(distinct[seen] / (total[seen] + distinct[seen]))
                cost[:, j] = lower[:, j] + escape[np.searchsorted(contexts, grams >> np.uint64(8)), j]
                cost[np.searchsorted(grams, gram), j] = -np.log2(n / (total + distinct)[c])
            self.symbols.append(Table(grams, cost.astype(np.float32)))
            self.escapes.append(Table(contexts, escape.astype(np.float32)))

    def _costs(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Costs of the last byte of ``grams`` in the context of the k before it."""
        if k < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        row = self.symbols[k].find(grams)
        out = self.symbols[k].rows[row] if len(self.symbols[k].rows) else np.zeros((len(grams), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            g = grams[miss]
            out[miss] = self._costs(g & np.uint64((1 << (8 * k)) - 1), k - 1)
            context = self.escapes[k].find(g >> np.uint64(8))
            known = context >= 0
            out[miss[known]] += self.escapes[k].rows[context[known]]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every (not empty) text in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        at, pieces = 0, []
        for i, t in enumerate(texts):  # long texts in pieces, each with the bytes before it as context
            for a in range(0, len(t), CHUNK):
                pieces.append((i, t[max(0, a - self.order) : a + CHUNK], min(a, self.order)))
        while at < len(pieces):
            upto, size = at, 0
            while upto < len(pieces) and (upto == at or size + len(pieces[upto][1]) <= CHUNK):
                size += len(pieces[upto][1])
                upto += 1
            group = pieces[at:upto]
            data, own, starts = _laid_out([p[1] for p in group], self.order)
            cost = self._costs(_grams(data, own, self.order), self.order)
            for (_, _, skip), s in zip(group, starts, strict=True):
                cost[s : s + skip] = 0
            sums = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
            np.add.at(out, [p[0] for p in group], sums)
            at = upto
        return out


def fit(labelled: DataFrame, order: int = ORDER, sample: int = 2000) -> Model:
    """``labelled``: id, lang (not null), text. See the module for the bounds."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    spark = labelled.sparkSession
    rates = spark.createDataFrame([(x, min(1.0, sample / n)) for x, n in sizes.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    drawn = labelled.where("text is not null").join(F.broadcast(rates), "lang").where(draw)
    counts = shared.cut(count_contexts(drawn.select("lang", "text"), order), "contexts")
    held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for k in range(order + 1):
        seen = counts.where(F.col("k") == k).toPandas()
        for lang, rows in seen.groupby("lang"):
            held[(lang, k)] = (rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy())
    return Model(sorted(sizes), order, held)


def identify(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` (id, text and more) with lang_pred and score in place of text."""
    shared_model = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, order and languages
    own = shared.others(texts.columns, (*ADDED, "text"))
    # by number, as names may be any
    texts = texts.select(*[shared.named(c).alias(f"c{i}") for i, c in enumerate(own)], "text")
    keep = texts.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared_model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts_ = batch.column("text").to_pylist()
                ask = [i for i, t in enumerate(texts_) if t and m.langs and any(map(str.isalpha, t))]  # isalpha: the categories L*
                pred, score = [UNDETERMINED] * len(texts_), [0.0] * len(texts_)
                if ask:
                    bits = m.lengths([texts_[i].encode() for i in ask])
                    best = bits.argmin(axis=1)
                    likely = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                    for i, b, p in zip(ask, best.tolist(), likely.tolist(), strict=True):
                        pred[i], score[i] = m.langs[b], p
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    schema = StructType([*texts.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return texts.mapInArrow(shared.lean(run), schema).toDF(*own, *ADDED)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    docs = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    labelled = docs.where("not held_out and lang is not null and doc_id is not null")
    model = fit(labelled.select(F.col("doc_id").alias("id"), "lang", "text"))
    return identify(docs.select("doc_id", "text", "held_out"), model)
