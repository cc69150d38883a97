"""SentencePiece: ids of the library, brute-force segmentation, exact round trip."""

import itertools
import random

import numpy as np

from pixelloom.llm import pieces


def texts():
    rng = random.Random(6)
    alphabet = "abcdeeeettthhh   \n\té߀日本🙂ſ̈①ﬁ"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*out, None, "", " ", "\n", "   lead", "trail   ", "a" * 700, "Hello world, isn't it?", "‍\x00x", "<s> </s> <0x41>", "the " * 3000]


def test_ids_are_the_librarys():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    data = texts()
    got = pieces.Encoder(pieces.load(pieces.default_model())).encode(data)
    for t, ids in zip(data, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (m.encode(t) if t else []), t
    assert pieces.decode(pieces.load(pieces.default_model()), got) == [t or "" for t in data]


def test_viterbi_finds_the_best_segmentation():
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abc") for _ in range(k)) for k in (1, 2, 3, 4) for _ in range(8)})
    p = pieces.Pieces(names, [-rng.random() * 9 for _ in names], kind="unigram")
    score = dict(zip(names, p.score, strict=True))

    def total(word, cuts):
        spans = zip((0, *cuts), (*cuts, len(word)), strict=True)
        return sum(score.get(word[a:b], p.score.min() - 10 if b - a == 1 else -1e9) for a, b in spans)

    words = ["".join(rng.choice("abcx") for _ in range(7)) for _ in range(60)]
    for w, spans in zip(words, pieces.best_paths(p, words), strict=True):
        best = max(total(w, c) for k in range(7) for c in itertools.combinations(range(1, 7), k))
        assert abs(total(w, [s[0] for s in spans[1:]]) - best) < 1e-9


def test_paths_are_the_merges():
    """Viterbi over fitting neighbours against merging by rank, on a small model with equal ranks too."""
    rng = random.Random(5)
    for seed in range(30):
        rng = random.Random(seed)
        names, score = list("abc"), [0.0] * 3
        for k in range(14):  # each piece joins two earlier ones, as in training
            new = rng.choice(names) + rng.choice(names)
            if new not in names and len(new) < 7:
                names.append(new)
                score.append(-float(k if seed % 2 else k // 2 + 1))
        p = pieces.Pieces(names, score)
        for length in (1, 2, 5, 9):
            words = ["".join(rng.choice("abcx") for _ in range(length)) for _ in range(80)]
            assert pieces.bpe_paths(p, words) == pieces.merge(p, words)[0]


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert sorted(map(tuple, back)) == [(i, t or "") for i, t, _ in rows]
    assert pieces.encoded(docs.where("false")).count() == 0


def test_probes_and_remembered_pairs(monkeypatch):
    """Every piece is found by its key and nothing else is; few places for pairs, and words with
    characters in no piece, give the library's ids too."""
    import sentencepiece

    monkeypatch.setattr(pieces, "PAIRS", 3)
    p = pieces.load.__wrapped__(pieces.default_model())
    assert len(p.pairs) == 8
    assert (p.find(p.keys) == p.ids).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, (300, 50)).astype(np.uint64)
    assert (p.find(others) == np.where(np.isin(others, p.keys), 0, -1)).all() and p.find(np.array([0], np.uint64)) == -1
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ["the cat sat on the mat and the other catalogue", "naïve Σίσυφος 漢字 \U0001f600 áb", "xx" * 40 + " yy", "mississippi " * 5 + "1234567 12"]
    got = [np.frombuffer(i, "<u4").tolist() for i in pieces.Encoder(p).encode(texts)]
    assert got == [model.encode(t) for t in texts]
    words = ["catalog", "mat́\U0001f600xy", "xxxxxxx"]
    for w, ids in zip(words, (pieces.bpe_ids(p, [w])[0] for w in words), strict=True):
        spans = pieces.bpe_paths(p, [w])[0]
        want = [int(p.find(np.array([p.hash_of(w[a:b])], np.uint64))[0]) for a, b in spans]
        assert ids is None if -1 in want else np.frombuffer(ids, "<u4").tolist() == want
