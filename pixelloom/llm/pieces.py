"""SentencePiece encoding and decoding in batched numpy Viterbi.

A text is cut into words (white space as U+2581 leads the word that follows),
and each worker encodes a word form once. Unseen words are sorted by length, and
equally long ones advance together, one end position a step: substrings are named
by prefix polynomial hashes, whose values are probed in a table of the piece keys,
each piece that ends here extends the best path to where it starts, and a
vectorised maximum over the starts stores the backpointer.

What a path is worth depends on the kind of the model:

* Unigram models: the sum of the pieces' log-probabilities (``best_paths``).
* BPE models: their scores are merge ranks, and the largest sum of them is not what
  the model means. A row of pieces is the model's segmentation exactly if every two
  neighbours are, that is if merging by rank would not join anything across their
  border. So a path scores 0 while its neighbours fit and minus infinity otherwise
  (``bpe_paths``); of the paths to a position exactly one fits, and it is the
  library's. Whether two pieces fit is settled by undoing their merges, latest first,
  and asking each time whether the two halves at the border would have joined sooner.

Decoding is batched as well: byte strings of all ids are gathered at once.

Characters outside the vocabulary become byte pieces. The library's own
normalisation is taken to be the identity with a space put in front, as in
models that keep white space exactly; then decoding gives back every text
without U+2581 itself (it reads as a space).

Defined results: null and empty texts have no tokens. Very long texts are encoded
whole, word by word, and a very long word in a batch of its own. Repeated rows and
further columns, whatever their names, change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SPACE = "▁"
REMEMBERED = 250_000
#: No piece holds a new line, and none a word's end and then white space, so words can be encoded apart.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1 << 60)
#: Pairs of pieces whose fit is remembered: 2 to this power of places, where the last pair stays.
PAIRS = 20
#: Characters below this number are looked up in pairs.
LATIN = 0x250
#: Words above this length are cut out of the batches and encoded a few at a time.
LONG = 256


class Pieces:
    """The pieces of a model, keyed by polynomial hashes of their code points."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int] | None = None, kind: str = "bpe", special: frozenset[int] = frozenset()):
        self.kind, self.byte_ids = kind, byte_ids or {}
        usable = [i for i in range(len(pieces)) if i not in special and i not in self.byte_ids.values()]
        self.longest = max((len(pieces[i]) for i in usable), default=0)
        keys = np.array([self.hash_of(pieces[i]) for i in usable], np.uint64)
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], np.array(usable, np.int64)[by]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one key")
        self._place()
        self.pairs = np.full(1 << PAIRS, -1, np.int64)
        self.score = np.array(scores, np.float64)
        # rank: the order in which BPE merges; equal scores have equal ranks
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        whole = {b: bytes([c]) for c, b in self.byte_ids.items()}
        text = [b"" if i in special else whole.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)]
        self.size = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.unknown = 0
        self._undo([pieces[i] for i in usable], usable)
        # pairs of neighbours inside some piece; between all others, words fall apart
        self.beside = np.zeros((LATIN, LATIN), bool)
        for i in usable:
            c = [ord(x) for x in pieces[i].replace(SPACE, " ")]
            for a, b in zip(c, c[1:], strict=False):
                if a < LATIN and b < LATIN:
                    self.beside[a, b] = True

    def _place(self) -> None:
        """Two tables of the keys' places by a product's first bits: a place is taken by the first key
        that falls there, and the second table, by another factor, holds the others."""
        n = len(self.keys)
        self.placed = np.append(self.keys, np.uint64(0)), np.append(self.ids, -1)  # the last: no key
        self.tables, rest, bits, factor = [], np.arange(n), max(8, n.bit_length() + 4), int(_BASE)
        while True:
            slot = (self.keys[rest] * np.uint64(factor)) >> np.uint64(64 - bits)
            table = np.full(1 << bits, n, np.int32)
            table[slot[::-1]] = rest[::-1]
            out = rest[table[slot] != rest]
            if not self.tables or not len(out):
                self.tables.append((np.uint64(factor), np.uint64(64 - bits), table))
                if len(self.tables) == 2:
                    return
                rest, bits = out, max(8, 2 * len(out).bit_length() - 2)
            factor = (factor * int(_BASE) + 2) % (1 << 64) | 1
            bits = min(bits + (factor % 16 == 1), 28)  # more room after some trials

    def _undo(self, names: list[str], ids: list[int]) -> None:
        """For each piece the two that its last merge joins. A number beyond the last
        stands for a character in no piece: nothing merges with it."""
        n = len(self.size) + 1
        self.outside = n - 1
        self.key, self.power, self.length = np.zeros(n, np.uint64), np.ones(n, np.uint64), np.full(n, self.longest, np.int64)
        self.left, self.right, self.last = np.arange(n), np.arange(n), np.full(n, -1, np.int64)
        self.whole = np.zeros(n, bool)  # merging its characters gives the piece itself
        for i, name in zip(ids, names, strict=True):
            self.key[i], self.power[i], self.length[i] = self.hash_of(name), pow(int(_BASE), len(name), 1 << 64), len(name)
        if self.kind != "bpe":
            return
        by_length: dict[int, list[int]] = {}
        for i, name in zip(ids, names, strict=True):
            by_length.setdefault(len(name), []).append(i)
        name_of = dict(zip(ids, names, strict=True))
        for length, same in by_length.items():
            words, mine = [name_of[i] for i in same], np.array(same)
            if length == 1:
                self.whole[mine] = True
                continue
            spans, middle = merge(self, words)
            done = np.array([len(x) == 1 for x in spans])
            self.whole[mine] = done
            for i, w, m in zip(mine[done].tolist(), [w for w, d in zip(words, done, strict=True) if d], middle[done].tolist(), strict=True):
                self.left[i], self.right[i] = self.find(np.array([self.hash_of(w[:m]), self.hash_of(w[m:])], np.uint64))
                self.last[i] = self.rank[i]

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves the border between the pieces a and b alone."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (a != self.outside) & (b != self.outside))
        pair = a[at] * (self.outside + 1) + b[at]
        place = (pair.astype(np.uint64) * _BASE) >> np.uint64(64 - PAIRS)
        known = self.pairs[place]  # the pair, and as last bit whether it fits
        ok[at] = known & 1
        new = np.flatnonzero(known >> 1 != pair)
        ok[at[new]] = fits = self._fit(a[at[new]], b[at[new]])
        self.pairs[place[new]] = pair[new] << 1 | fits
        return ok

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        used_a, used_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)  # when the half at the border is merged further
        while len(at):
            short = self.length[a] + self.length[b] <= self.longest
            joined = np.full(len(a), _NEVER)
            found = self.find(self.key[a[short]] * self.power[b[short]] + self.key[b[short]])
            joined[short] = np.where(found >= 0, self.rank[found], _NEVER)
            crossed = (joined < used_a) & (joined <= used_b)  # of equal ranks, the leftmost merge goes first
            ok[at[crossed]] = False
            la, lb = self.last[a], self.last[b]
            undo_a = la > lb
            go = ~crossed & ((la >= 0) | (lb >= 0))
            used_a = np.where(undo_a, la, used_a)[go]
            used_b = np.where(undo_a, used_b, lb)[go]
            a, b, at = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], at[go]
        return ok

    def parts(self, words: list[str]) -> list[list[str]]:
        """The words, cut between neighbours that no piece joins."""
        joined = "".join(words)
        code = np.frombuffer(joined.replace(SPACE, " ").encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        a, b = np.minimum(code[:-1], LATIN - 1), np.minimum(code[1:], LATIN - 1)
        apart = ~self.beside[a, b] & (code[:-1] < LATIN) & (code[1:] < LATIN)
        apart[end[:-1] - 1] = False
        cut = np.flatnonzero(apart) + 1
        first = np.searchsorted(cut, end - size)
        last = np.searchsorted(cut, end)
        cuts, out, at = cut.tolist(), [], 0
        for w, e, i, j in zip(words, end.tolist(), first.tolist(), last.tolist(), strict=True):
            if i == j:
                out.append([w])
            else:
                bounds = [at, *cuts[i:j], e]
                out.append([joined[x:y] for x, y in zip(bounds, bounds[1:], strict=False)])
            at = e
        return out

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece id of each key, -1 if there is none."""
        (own, ids), (first, second) = self.placed, self.tables

        def probe(factor: np.uint64, shift: np.uint64, table: np.ndarray) -> np.ndarray:
            at = table[(keys * factor) >> shift]
            return np.where(own[at] == keys, ids[at], -1)

        return np.maximum(probe(*first), probe(*second))


class _Batch:
    """Equally long words: code points and prefix hashes, one row a word."""

    def __init__(self, words: list[str]):
        self.n, self.length = len(words), len(words[0])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(self.n, self.length)
        self.prefix = np.zeros((self.n, self.length + 1), np.uint64)
        self.power = np.ones(self.length + 1, np.uint64)
        for i in range(self.length):
            self.prefix[:, i + 1] = self.prefix[:, i] * _BASE + self.codes[:, i] + np.uint64(1)
        self.power[1:] = np.multiply.accumulate(np.full(self.length, _BASE))

    def key(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.prefix[row, end] - self.prefix[row, start] * self.power[end - start]


def _backtracked(back: np.ndarray) -> list[list[tuple[int, int]]]:
    out = []
    for row in back.tolist():
        spans, end = [], len(row) - 1
        while end:
            spans.append((row[end], end))
            end = row[end]
        out.append(spans[::-1])
    return out


def _ending(p: Pieces, b: _Batch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, and the piece from each of them to ``end`` in every word (-1: none)."""
    starts = np.arange(max(0, end - max(1, p.longest)), end)
    return starts, p.find(b.prefix[:, end, None] - b.prefix[:, starts] * b.power[end - starts])


def best_paths(p: Pieces, words: list[str]) -> list[list[tuple[int, int]]]:
    """Segmentation of equally long words with the largest sum of scores, as (start, end)
    spans. A character in no piece costs less than any segmentation without it."""
    b = _Batch(words)
    best = np.full((b.n, b.length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((b.n, b.length + 1), np.int64)
    floor = p.score.min() - 10
    row = np.arange(b.n)
    for end in range(1, b.length + 1):
        starts, piece = _ending(p, b, end)
        score = best[:, starts] + np.where(piece >= 0, p.score[piece], -np.inf)
        score[:, -1] = np.maximum(score[:, -1], best[:, end - 1] + floor)
        at = score.argmax(axis=1)
        best[:, end], back[:, end] = score[row, at], starts[at]
    return _backtracked(back)


def _fitting(p: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Backpointers of equally long words, and the piece that ends at each position, on paths whose neighbours all fit."""
    b = _Batch(words)
    last = np.full((b.n, b.length + 1), -1)  # the piece before each position on the path to it
    back = np.zeros((b.n, b.length + 1), np.int64)
    row = np.arange(b.n)
    for end in range(1, b.length + 1):
        starts, piece = _ending(p, b, end)
        piece[~p.whole[piece]] = -1
        piece[:, -1] = np.where(piece[:, -1] < 0, p.outside, piece[:, -1])
        r, s = np.nonzero((piece >= 0) & ((last[:, starts] >= 0) | (starts == 0)))
        score = np.full(piece.shape, -np.inf)
        score[r, s] = np.where(p.fit(last[r, starts[s]], piece[r, s]), 0, -np.inf)
        at = score.argmax(axis=1)
        back[:, end] = starts[at]
        last[:, end] = np.where(score[row, at] == 0, piece[row, at], -1)
    if (last[:, -1] < 0).any():
        raise ValueError("no row of pieces fits: this is not a model of merges by rank")
    return back, last


def bpe_paths(p: Pieces, words: list[str]) -> list[list[tuple[int, int]]]:
    """Segmentation of equally long words whose neighbours all fit, as (start, end) spans."""
    return _backtracked(_fitting(p, words)[0])


def bpe_ids(p: Pieces, words: list[str]) -> list[bytes | None]:
    """The ids of ``bpe_paths`` as little-endian uint32 bytes; None for words with a character in no piece."""
    back, last = _fitting(p, words)
    live, end, steps = np.arange(len(words)), np.full(len(words), back.shape[1] - 1), []
    while len(live):  # one piece of every word, from the last on
        steps.append((live, last[live, end]))
        end = back[live, end]
        live, end = live[end > 0], end[end > 0]
    n = np.bincount(np.concatenate([r for r, _ in steps]), minlength=len(words))
    ends = np.cumsum(n)
    flat, outside = np.empty(ends[-1], "<u4"), np.zeros(len(words), bool)
    for i, (row, piece) in enumerate(steps):
        flat[ends[row] - 1 - i] = piece
        outside[row] |= piece == p.outside
    data, ends = flat.tobytes(), (4 * ends).tolist()
    return [None if out else data[a:b] for out, a, b in zip(outside.tolist(), [0, *ends], ends, strict=False)]


def merge(p: Pieces, words: list[str]) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """Equally long words merged by rank, best pair first: spans, and where the last merge joined."""
    b = _Batch(words)
    n, length = b.n, b.length
    upto = np.tile(np.arange(1, length + 1), (n, 1))  # end of the symbol that starts here
    before = np.tile(np.arange(-1, length), (n, 1))  # start of the symbol that ends here
    rank = np.full((n, length), _NEVER)

    def join(row: np.ndarray, start: np.ndarray) -> None:
        """Rank the merge of the symbol at ``start`` with the next."""
        middle = upto[row, start]
        inside = middle < length
        r, s = row[inside], start[inside]
        piece = p.find(b.key(r, s, upto[r, middle[inside]]))
        value = np.full(len(row), _NEVER)
        value[inside] = np.where(piece >= 0, p.rank[piece], _NEVER)
        rank[row, start] = value

    all_, final = np.arange(n), np.zeros(n, np.int64)
    for start in range(length - 1):
        join(all_, np.full(n, start))
    live = all_
    while len(live):
        at = rank[live].argmin(axis=1)
        can = rank[live, at] < _NEVER
        live, at = live[can], at[can]
        if not len(live):
            break
        final[live] = middle = upto[live, at]
        end = upto[live, middle]
        upto[live, at] = end
        before[live, end] = at
        rank[live, middle] = _NEVER
        join(live, at)
        left = before[live, at]
        has = (left >= 0) & (at > 0)
        join(live[has], left[has])
    out = []
    for ends in upto.tolist():
        spans, start = [], 0
        while start < length:
            spans.append((start, ends[start]))
            start = ends[start]
        out.append(spans)
    return out, final


class Encoder(dict):
    """Ids of word forms as little-endian uint32 bytes; unseen ones are learned in batches."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.known = pieces, {}
        self.old_words, self.old_known = {}, {}  # of the time before the last new start

    def learn(self, words: set[str]) -> None:
        if len(self) > REMEMBERED:
            self.old_words = dict(self)
            self.clear()
        if len(self.known) > REMEMBERED:
            self.old_known, self.known = self.known, {}
        fresh = []
        for w in words:
            if w not in self:
                if (ids := self.old_words.get(w)) is not None:
                    self[w] = ids
                else:
                    fresh.append(w)
        if not fresh:
            return
        # a word that does not follow one space has a mark in front instead
        whole = self.pieces.parts([w[1:] if w[0] == "\0" else SPACE + w for w in fresh])
        new = {p for parts in whole for p in parts if p not in self.known}
        self.known.update({p: self.old_known[p] for p in new if p in self.old_known})
        self._segment({p for p in new if p not in self.old_known})
        for w, parts in zip(fresh, whole, strict=True):
            self[w] = b"".join(map(self.known.__getitem__, parts))

    def _segment(self, parts: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for x in parts:
            by_length.setdefault(len(x), []).append(x)
        segment = best_paths if self.pieces.kind == "unigram" else bpe_paths
        for length, same in by_length.items():
            step = max(1, 2_000_000 // (length * (1 if length < LONG else 8)))
            for at in range(0, len(same), step):
                group = same[at : at + step]
                if self.pieces.kind == "bpe":
                    ids = bpe_ids(self.pieces, group)
                    self.known.update((w, i) for w, i in zip(group, ids, strict=True) if i is not None)
                    group = [w for w, i in zip(group, ids, strict=True) if i is None]
                    if not group:
                        continue
                spans = segment(self.pieces, group)
                flat = [w[a:b] for w, s in zip(group, spans, strict=True) for a, b in s]
                found = self._ids(flat)
                done = 0
                for w, s in zip(group, spans, strict=True):
                    self.known[w] = b"".join(found[done : done + len(s)])
                    done += len(s)

    def _ids(self, parts: list[str]) -> list[bytes]:
        p, known = self.pieces, {}
        distinct = list(set(parts))
        ids = p.find(np.array([p.hash_of(x) for x in distinct], np.uint64)).tolist()
        for x, i in zip(distinct, ids, strict=True):
            own = [i] if i >= 0 else [p.byte_ids.get(c, p.unknown) for c in x.encode()] if p.byte_ids else [p.unknown]
            known[x] = np.array(own, "<u4").tobytes()
        return [known[x] for x in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = [self.words(t) if t else [] for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.__getitem__, w)) for w in words]

    @staticmethod
    def words(text: str) -> list[str]:
        """Words as they are remembered: a word after one space is known without its U+2581."""
        words = text.split(" ")
        if "" not in words and SPACE not in text and "\0" not in text:
            return words
        return [w[1:] if w[0] == SPACE and w[1:2] not in ("", SPACE, "\0") else f"\0{w}" for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]


def decode(p: Pieces, ids: list[bytes]) -> list[str]:
    """Texts of the id sequences, all gathered in one step."""
    sizes = [len(i) // 4 for i in ids]
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    size = p.size[flat]
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(p.start[flat] - (ends - size), size)
    data = p.bytes[where].tobytes()
    out, done, at = [], 0, 0
    for n in sizes:
        done += n
        end = int(ends[done - 1]) if done else 0
        text = data[at:end].decode("utf-8", "replace")
        out.append(text.removeprefix(" "))
        at = end
    return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def load(path: str, kind: str = "bpe") -> Pieces:
    """The pieces of a model file; ``kind`` says how its scores are meant."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
    byte_ids = {int(pieces[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
    if any(SPACE in x.lstrip(SPACE) or "\n" in x for i, x in enumerate(pieces) if i not in special):
        raise ValueError("pieces reach over words; this encoder would cut them")
    out = Pieces(pieces, [m.get_score(i) for i in range(n)], byte_ids, kind, special)
    out.unknown = m.unk_id()
    return out


@lru_cache
def _encoder(path: str, kind: str) -> Encoder:
    return Encoder(load(path, kind))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, kind: str = "bpe") -> DataFrame:
    """(id, ids): token ids as an int array."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in _encoder(path, kind).encode(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(shared.lean(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) from int arrays of token ids."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decode(load(path), ids), pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>")).mapInArrow(shared.lean(run), "id long, text string").withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token count, CRC-32 of the ids as little-endian unsigned 32-bit
    numbers, and whether decoding gives the text back."""
    path = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(1).to_pylist()
                ids = _encoder(path, "bpe").encode(texts)
                back = decode(load(path), ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)])],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
                )

    docs = shared.documents(spark, sf_dir).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(shared.lean(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
