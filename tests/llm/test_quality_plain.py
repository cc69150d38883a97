"""op9 against a plain version: votes by loops, EM over documents, Newton's method on counted shapes."""

import math
from collections import Counter

import numpy as np
import regex

from pixelloom.llm import weak_labels

from .test_rules import planted

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in regex.split(SPACE, text or "") if w]


def votes_of(text):
    words, n = words_of(text), len(words_of(text))
    count = lambda pattern: len(regex.findall(pattern, text))
    share = lambda part, whole: part / max(whole, 1)
    letters, stops, distinct = count(r"\p{L}"), count("[.!?]"), len(set(words))
    solid = len(regex.sub(r"[\p{N}\x20\t-\r.,;:?'()-]", "", text))
    out = ["b" if share(count(r"[#*$%&|<>!]"), n) > 0.15 else "-"]
    out.append("b" if share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n) > 0.2 else "-")
    out.append("b" if share(count(r"\p{Lu}"), letters) > 0.4 else "-")
    out.append("b" if share(letters, solid) < 0.8 else "-")
    out.append("b" if n >= 50 and share(distinct, n) < 0.12 else "g" if n >= 20 and share(distinct, n) > 0.4 else "-")
    out.append("b" if n >= 40 and not stops else "g" if 0.02 < share(stops, n) < 0.34 else "-")
    return out


def posteriors(votes, false_alarm):
    """P(good) of each row of votes, by EM over the rows one by one."""
    kinds, rows = "gb-", np.array(votes)
    seen = np.stack([rows == k for k in kinds]).astype(float)  # vote, document, labeller
    prior = 0.8
    rates = np.empty((2, 3, rows.shape[1]))  # kind of text, vote, labeller
    rates[0], rates[1] = np.array([0.6, 0.02, 0.38])[:, None], np.array([0.4, 0.3, 0.3])[:, None]

    def expect():
        like = np.exp(np.einsum("vdl,kvl->kd", seen, np.log(rates)))
        return prior * like[0] / (prior * like[0] + (1 - prior) * like[1])

    for _ in range(50):
        p = expect()
        prior = min(0.99, max(0.01, p.mean()))
        for k, mass in enumerate((p, 1 - p)):
            rates[k] = (np.einsum("vdl,d->vl", seen, mass) + 0.5) / (mass.sum() + 1.5)
            bad = np.minimum(rates[k, 1], false_alarm) if k == 0 else np.maximum(rates[k, 1], 0.05)
            rates[k] *= (1 - bad) / (1 - rates[k, 1])
            rates[k, 1] = bad
    return expect()


def shapes_of(text):
    out = []
    words = words_of(text)
    for i, w in enumerate(words):
        s = regex.sub(r"\p{N}+", "0", regex.sub(r"[^\W\d_A]+|\p{M}+", "a", regex.sub(r"\p{Lu}+", "A", w)))
        out.append(s + "=" if i and words[i - 1] == w else s)
    counts = Counter(out) + Counter(" ".join(out[max(0, i - 1) : i + 1]) for i in range(len(out)))
    length = math.sqrt(sum(c * c for c in counts.values()))
    return {s: c / length for s, c in counts.items()}


def scores(train, label, weight, every):
    """Logistic regression with penalty 1e-3 on scaled features, by Newton's method."""
    names = {s: j for j, s in enumerate(sorted({s for t in every for s in t}))}
    matrix = lambda texts: np.array([[t.get(s, 0.0) for s in names] for t in texts])
    x, w = matrix(train), weight / weight.sum()
    mean = w @ x
    scale = np.sqrt(w @ (x - mean) ** 2 * weight.sum() / (weight.sum() - (weight**2).sum() / weight.sum()))
    live = scale > 0
    one = lambda m: np.column_stack([(m[:, live]) / scale[live], np.ones(len(m))])
    x, theta, penalty = one(x), np.zeros(live.sum() + 1), np.r_[np.full(live.sum(), 1e-3), 1e-12]
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (w * (p - label)) + penalty * theta
        theta -= np.linalg.solve((x.T * (w * p * (1 - p))) @ x + np.diag(penalty), slope)
    return 1 / (1 + np.exp(-(one(matrix(every)) @ theta)))


def test_query_against_a_plain_version(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in planted(300, 7)]
    rows += [(900, None), (901, " \n\t"), (902, "Short but fine text about the river."), (903, rows[3][1]), (904, "Ünï é 12 34. " * 30), (905, "word " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in weak_labels.op9_weak_label_quality(spark, str(tmp_path)).collect()}
    solid = {d: t for d, t in rows if words_of(t)}
    p = dict(zip(solid, posteriors([votes_of(t) for t in solid.values()], weak_labels.STRICT), strict=True))
    once = {t: d for d, t in solid.items()}  # equal texts are learned from once
    chance = np.array([p[d] for d in once.values()])
    want = scores([shapes_of(t) for t in once], chance >= 0.5, np.abs(2 * chance - 1), [shapes_of(t) for t in solid.values()])
    assert set(got) == {d for d, _ in rows}
    for d, s in zip(solid, want, strict=True):
        assert abs(got[d].score - s) < 0.05, (d, got[d].score, s)
        assert got[d].kept == (got[d].score >= 0.5)
        assert got[d].kept == (s >= 0.5) or abs(s - 0.5) < 0.05
    assert all(got[d].score == 0 and not got[d].kept for d in (900, 901))
    model = weak_labels.LabelModel(6, weak_labels.STRICT).fit(Counter("".join(votes_of(t)) for t in solid.values()))
    assert all(abs(model.posterior("".join(votes_of(t))) - p[d]) < 1e-9 for d, t in solid.items())
