"""Language-model scores of texts: a log-bilinear model trained by noise contrast.

Tokens are the lower-cased (A-Z) words of a text and one end. The model's symbols are
the ``vocabulary`` words most frequent in the training texts, the end, and one symbol for
all other words. With vectors r for symbols as context, q for symbols as targets, weights
c for the two places of the context and biases b,

    log P(w | u, v) = (c1 r_v + c2 r_u) . q_w + b_w - log Z(u, v)

(Mnih and Hinton 2007; u and v are the two symbols before w, and ends before the first).
A word outside of the vocabulary also costs its share of that symbol, by counts: (c + 1) /
(N' + V' + 1), where c is its count in the training texts and N' and V' are the tokens and
words that the symbol stands for, so that all words, one unseen one included, sum to one.

Training is noise-contrastive (Mnih and Teh 2012): a token against ``NOISE`` draws from the
words' frequencies, by Adagrad over mini-batches. It starts at the frequencies (b is their
logarithm, r and q are small), covers every training token once, and is shared out: each
task trains a copy over its texts, and the copies' parameters are averaged, each symbol's
by how often the task has seen it. A first eighth of the texts makes the start of the rest,
so that the copies of the second round agree on the directions of their vectors.

Scores are normalised exactly: exp(q.(c1 r_v)) and exp(q.(c2 r_u) + b) are two square tables,
and their matrix product is Z of every pair of symbols at once, so a token costs three
look-ups. The tables are bounded by ``vocabulary`` and made by each worker from the parameters, which
are broadcast, as are at most ``frequent`` frequent words (all with more than a count that leaves so
many). Counts cover all words of all texts: those of less frequent words are joined by word, none of
which has a large share of all tokens.

Defined results: a null text is empty, and has the end as its only token. Rows with a null id
are scored but never learned from, and are not held out. Rows that repeat each other count
each. Very long texts are read whole, in parts. If nothing was learned, every count is 0, the
base score is log10(1) = 0 and the score that of the untrained start. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

VOCABULARY, FREQUENT = 2000, 200_000
DIMENSIONS, NOISE, BATCH, RATE = 16, 64, 1024, 0.05
#: A first round over one of so many parts of the texts, a second one over the others.
ROUNDS = 8
#: Symbols: all words outside of the vocabulary, the end, then the vocabulary.
OTHER, END, FIRST = 0, 1, 2
#: Texts and bytes that are handled together.
ROWS, BYTES = 512, 8 << 20


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size (or of one text)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = int(np.clip(np.searchsorted(ends, before + BYTES, "right"), at + 1, min(at + ROWS, batch.num_rows)))
            yield batch.slice(at, upto - at)
            at = upto


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and the number of the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    held = pc.not_equal(words, "")
    return words.filter(held), row[held.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, train) over all of ``docs`` (text, learn): occurrences, and those in texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(tables: list[pa.Table]) -> pa.Table:
            sums = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum"), ("train", "sum")])
            return pa.table([sums["word"], sums["n_sum"], sums["train_sum"]], ["word", "n", "train"])

        for batch in _slices(batches, "text"):
            words, row = words_of(batch.column("text"))
            learn = batch.column("learn").to_numpy(zero_copy_only=False)[row]
            held.append(out([pa.table([words.cast(pa.large_string()), pa.array(np.ones(len(row), np.int64)), pa.array(learn.astype(np.int64))], ["word", "n", "train"])]))
            if sum(map(len, held)) > 400_000:
                held = [out(held)]
                if len(held[0]) > 200_000:
                    yield from _plain(held.pop())
        if held:
            yield from _plain(out(held))

    parts = docs.select("text", "learn").mapInArrow(shared.lean(run), "word string, n long, train long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def _plain(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.set_column(0, "word", table["word"].cast(pa.string()))
    yield from table.combine_chunks().to_batches(10_000)


@dataclass
class Vocabulary:
    """The frequent words, those of the model first, and the counts behind the scores."""

    words: pa.Array  # FIRST + position: its symbol, if below `size`
    counts: np.ndarray  # in the training texts
    size: int  # symbols of the model
    symbol_counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    other_tokens: int
    other_distinct: int

    @property
    def noise(self) -> np.ndarray:
        p = self.symbol_counts + 1.0
        return p / p.sum()


def vocabulary(counts: DataFrame, learned: int, size: int = VOCABULARY, frequent: int = FREQUENT) -> Vocabulary:
    """``counts`` of ``count_words``; learned: texts to learn from (each has one end)."""
    sums = counts.agg(F.sum("train").alias("tokens"), F.count_if(F.col("train") > 0).alias("distinct")).first()
    # a threshold on counts, from a histogram of a few hundred rows, in place of a sort
    octave = F.floor(8 * F.log2("n"))
    least, held = math.inf, 0
    for row in sorted(counts.groupBy(octave.alias("octave")).count().collect(), key=lambda r: -r["octave"]):
        held += row["count"]
        if held > frequent:
            break
        least = row["octave"]
    top = counts.where(octave >= least).toArrow().to_pandas()  # at most `frequent` rows
    top = top.sort_values(["train", "word"], ascending=[False, True], ignore_index=True)
    inside = int(min(size, (top["train"] > 0).sum()))
    train = top["train"].to_numpy(np.int64)
    tokens, end = (sums.tokens or 0) + learned, int(learned > 0)
    other = (sums.tokens or 0) - int(train[:inside].sum())
    per_symbol = np.concatenate([[other, learned], train[:inside]]).astype(np.int64)
    return Vocabulary(pa.array(top["word"], pa.string()), train, FIRST + inside, per_symbol, tokens, (sums.distinct or 0) + end, other, (sums.distinct or 0) - inside)


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``docs`` (row, text and more) with symbols (16-bit, ends included) and rare (words that are not
    frequent, with their number) in place of text, and n_tokens, n_known, n_other, base and other:
    sums of log10(c + 1) over the frequent words, all of them and those outside of the model."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)
    own = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = held.value
        log = np.log10(v.counts + 1.0)
        for batch in _slices(batches, "text"):
            n = batch.num_rows
            words, row = words_of(batch.column("text"))
            at = pc.fill_null(pc.index_in(words, value_set=v.words), -1).to_numpy().astype(np.int64)
            inside = (at >= 0) & (at < v.size - FIRST)
            symbol = np.where(inside, at + FIRST, OTHER).astype(np.uint16)
            per = np.bincount(row, minlength=n)
            ends = np.cumsum(per + 1) - 1  # each text's end, behind its words
            codes = np.full(len(row) + n, END, np.uint16)
            codes[np.arange(len(row)) + row] = symbol
            found = at >= 0
            cost = np.where(found, log[at], 0.0) if len(log) else np.zeros(len(at))
            known = found & (v.counts[at] > 0) if len(log) else found
            bounds = np.concatenate([[0], ends + 1]) * 2
            data = codes.tobytes()
            unknown = words.filter(pa.array(~found))
            rare = pa.table([pa.array(row[~found]), unknown], ["row", "word"]).group_by(["row", "word"], use_threads=False).aggregate([("word", "count")]).sort_by("row")
            starts = np.searchsorted(rare["row"].to_numpy(), np.arange(n + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([rare["word"].combine_chunks(), rare["word_count"].combine_chunks()], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in own],
                    pa.array([data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(starts), pairs),
                    pa.array(per + 1),
                    pa.array(np.bincount(row, known, n).astype(np.int64)),
                    pa.array(np.bincount(row, ~inside, n).astype(np.int64)),
                    pa.array(np.bincount(row, cost, n)),
                    pa.array(np.bincount(row, np.where(inside, 0.0, cost), n)),
                ],
                [*[f.name for f in own], "symbols", "rare", "n_tokens", "n_known", "n_other", "base", "other"],
            )

    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own), "symbols binary, rare array<struct<word:string,n:long>>, n_tokens long, n_known long, n_other long, base double, other double"])
    return docs.mapInArrow(shared.lean(run), ddl)


class Network:
    """Parameters: one row a symbol (r, q, b), and one of the context's weights (c1, c2, 0)."""

    def __init__(self, table: np.ndarray):
        d = table.shape[1] // 2
        self.r, self.q, self.b, self.c = table[:-1, :d], table[:-1, d : 2 * d], table[:-1, 2 * d], table[-1, : 2 * d].reshape(2, d)

    @classmethod
    def start(cls, noise: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
        rng = np.random.default_rng(1)
        out = rng.normal(0, 0.1, (len(noise) + 1, 2 * dimensions + 1))
        out[:-1, -1] = np.log(noise)
        out[-1] = 0
        out[-1, : 2 * dimensions] = np.repeat([1.0, 0.5], dimensions)
        return out

    def table(self) -> np.ndarray:
        last = np.concatenate([self.c.ravel(), [0.0]])
        return np.vstack([np.hstack([self.r, self.q, self.b[:, None]]), last])


def contexts(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w): every token of the texts and the two symbols before it."""
    w = np.concatenate(symbols)
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    starts = np.cumsum([0, *map(len, symbols[:-1])])
    v[starts] = u[starts] = END
    longer = starts[np.array([len(s) > 1 for s in symbols])]
    u[longer + 1] = END
    return u, v, w


class Trainer:
    """Adagrad on a copy of the parameters. Mini-batches share their noise."""

    def __init__(self, table: np.ndarray, noise: np.ndarray, seed: int):
        self.p = Network(table.astype(np.float32))
        self.r, self.q, self.b, self.c = (np.ascontiguousarray(x) for x in (self.p.r, self.p.q, self.p.b, self.p.c))
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in (self.r, self.q, self.b, self.c)]
        self.noise, self.log_noise = np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)
        self.seen = np.zeros(len(noise), np.int64)
        self.rng = np.random.default_rng(seed)

    def _climb(self, which: int, at: np.ndarray, grads: np.ndarray) -> None:
        """An Adagrad step on the rows ``at`` of a parameter; gradients of one row add up."""
        order = at.argsort(kind="stable")
        row = at[order]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        row, grad = row[starts], np.add.reduceat(grads[order], starts)
        squares = self.squares[which][row] + grad * grad
        self.squares[which][row] = squares
        (self.r, self.q, self.b, self.c)[which][row] += np.float32(RATE) * grad / np.sqrt(squares)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        drawn = np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1]).clip(max=len(self.b) - 1).astype(np.uint16)
        rv, ru, qw, qn = self.r[v], self.r[u], self.q[w], self.q[drawn]
        h = rv * self.c[0] + ru * self.c[1]
        right = np.einsum("id,id->i", h, qw) + (self.b - self.log_noise)[w]
        wrong = h @ qn.T + (self.b - self.log_noise)[drawn]
        scale = np.float32(len(w) ** -0.5)
        g = scale / (1 + np.exp(right))  # 1 - P(not noise)
        gn = -scale / (1 + np.exp(-wrong))
        dh = g[:, None] * qw + gn @ qn
        self._climb(0, np.concatenate([v, u]), np.concatenate([dh * self.c[0], dh * self.c[1]]))
        self._climb(1, targets := np.concatenate([w, drawn]), np.concatenate([g[:, None] * h, gn.T @ h]))
        self._climb(2, targets, np.concatenate([g, gn.sum(0)]))
        self._climb(3, np.arange(2), np.stack([(dh * rv).sum(0), (dh * ru).sum(0)]))
        self.seen += np.bincount(w, minlength=len(self.b))

    def learn(self, symbols: list[np.ndarray]) -> None:
        """One pass over the texts, their tokens in random order."""
        u, v, w = contexts(symbols)
        order = self.rng.permutation(len(w))
        for at in range(0, len(w), BATCH):
            some = order[at : at + BATCH]
            self.step(u[some], v[some], w[some])

    def result(self) -> np.ndarray:
        self.p.r, self.p.q, self.p.b, self.p.c = self.r, self.q, self.b, self.c
        return self.p.table()


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after one pass over ``texts`` (row, symbols), in two rounds. What comes back to the
    driver has the size of the parameters."""
    table, width = Network.start(vocab.noise), 2 * DIMENSIONS + 1
    part = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(rounds))
    for some in (texts.where(part == 0), texts.where(part != 0)):
        now = texts.sparkSession.sparkContext.broadcast((table, vocab.noise))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            trainer = None
            for batch in _slices(batches, "symbols"):
                symbols = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
                if trainer is None:
                    trainer = Trainer(*now.value, seed=len(symbols[0]))
                trainer.learn(symbols)
            if trainer is not None:
                rows = trainer.result().astype(np.float64)
                weight = np.concatenate([trainer.seen + 1.0, [trainer.seen.sum() + 1.0]])
                columns = [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(weight), *(pa.array(x) for x in (rows * weight[:, None]).T)]
                yield pa.RecordBatch.from_arrays(columns, ["symbol", "weight", *(f"x{i}" for i in range(rows.shape[1]))])

        ddl = ", ".join(["symbol int, weight double", *(f"x{i} double" for i in range(width))])
        copies = some.select("symbols").mapInArrow(shared.lean(run), ddl)
        mean = copies.groupBy("symbol").agg(*[(F.sum(f"x{i}") / F.sum("weight")).alias(f"x{i}") for i in range(width)]).orderBy("symbol").toPandas()
        if len(mean):
            table = mean.drop(columns="symbol").to_numpy(np.float64)
        now.unpersist()
    return table


class Scorer:
    """Normalised log10 probabilities of tokens, by table."""

    def __init__(self, table: np.ndarray):
        net = Network(table.astype(np.float32))
        by_v, by_u = (net.r * net.c[0]) @ net.q.T, (net.r * net.c[1]) @ net.q.T + net.b
        shift_v, shift_u = by_v.max(1), by_u.max(1)
        z = np.exp(by_v - shift_v[:, None]) @ np.exp(by_u - shift_u[:, None]).T
        self.log_z = np.log(z) + shift_v[:, None] + shift_u[None, :]
        self.by_v, self.by_u = by_v, by_u

    def scores(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.by_v[v, w].astype(np.float64) + self.by_u[u, w] - self.log_z[v, u]) / math.log(10)


class Model:
    """Parameters; a worker makes the tables of its scorer once."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @cached_property
    def scorer(self) -> Scorer:
        return Scorer(self.table)


def score(docs: DataFrame, size: int = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """``docs``: row (unique), text, learn (not null) and more. All but the text with n_tokens, n_known,
    train_tokens, base_score and score; what is read several times is written out."""
    learned = docs.where("learn").count()
    counts = shared.cut(count_words(docs), "counts")
    vocab = vocabulary(counts, learned, size, frequent)
    texts = shared.cut(coded(docs, vocab), "coded")
    table = train(texts.where("learn").select("row", "symbols"), vocab)
    model = docs.sparkSession.sparkContext.broadcast(Model(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "symbols"):
            symbols = [np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()]
            each = model.value.scorer.scores(*contexts(symbols))
            sums = np.add.reduceat(each, np.cumsum([0, *map(len, symbols[:-1])]))
            at = batch.schema.get_field_index("symbols")
            yield batch.set_column(at, "neural", pa.array(sums))

    own = [c for c in docs.columns if c != "text"]
    numbers = ["n_tokens", "n_known", "n_other", "base", "other"]
    kept = texts.select(*own, *numbers, "symbols")
    ddl = ", ".join("neural double" if f.name == "symbols" else f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    scored = kept.mapInArrow(shared.lean(run), ddl)

    rare = texts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    seen = counts.where("train > 0").select("word", "train")
    found = rare.join(seen, "word").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("train") + 1)).alias("rare_log"))
    out = scored.join(found, "row", "left")
    rare_log, end_log = F.coalesce("rare_log", F.lit(0.0)), math.log10(learned + 1)
    total, others = math.log10(vocab.tokens + vocab.distinct + 1), math.log10(vocab.other_tokens + vocab.other_distinct + 1)
    return out.select(
        *own,
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(learned > 0)).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log + end_log - F.col("n_tokens") * total).alias("base_score"),
        (F.col("neural") + F.col("other") + rare_log - F.col("n_other") * others).alias("score"),
    )


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.with_row(shared.documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text")), "row")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    held_out = F.coalesce(remainder == 2, F.lit(False))
    docs = docs.select("row", "doc_id", "text", held_out.alias("held_out"), F.coalesce(remainder != 2, F.lit(False)).alias("learn"))
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
