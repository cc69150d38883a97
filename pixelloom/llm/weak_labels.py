"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. No gold labels are
used: expectation-maximisation over the counts of vote patterns estimates how
accurate each labeller is on good and on bad texts, and so the probability that
a text is good given its votes (Dawid and Skene 1979). Texts whose posterior is
decided then train a linear scorer over hashed features of word shapes, which
judges every text, whether the labellers spoke or not.

The vote patterns are counted over all rows (at most 3 ** labellers patterns reach
the driver). The scorer is fitted by Spark's logistic regression on about ``sample``
texts, drawn by a hash of the text alone and each taken once, however often it is
repeated, so the draw is the same on every cluster; the bound is a parameter. All
rows are scored.

Defined results: a text without words (null, empty, blank) is rejected with
score 0. Very long texts are read whole. Repeated texts get equal scores. If there is
nothing to learn from, or only one kind of text, the posterior alone decides. Columns
named like the added ones (``score``, ``kept``) are replaced; others stay, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

GOOD, BAD, NONE = "g", "b", "-"
#: Bounds on how often a labeller calls a good text bad, and a bad one.
FALSE_ALARM, DETECTION = 0.02, 0.05
#: The same for the labellers below, whose limits lie far from ordinary prose.
STRICT = 0.005
ADDED = ("score", "kept")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, also where a lambda reads it for each element."""
    return F.transform(F.array(value), body)[0]


def _same(words: Column) -> Column:
    """For each word, whether it is the one before."""
    return F.transform(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def labellers() -> dict[str, Callable[[], Column]]:
    """Votes from the columns of ``prepared``."""
    n, letters = F.col("_n"), F.col("_letters")
    part = lambda c, whole: _share(F.col(c), whole)
    never = F.lit(False)  # no symptom is no proof of the contrary
    return {
        "symbols": lambda: _vote(part("_symbols", n) > 0.15, never),
        "stutter": lambda: _vote(part("_same", n) > 0.2, never),
        "capitals": lambda: _vote(part("_capitals", letters) > 0.4, never),
        "letters": lambda: _vote(_share(letters, F.col("_solid")) < 0.8, never),
        "variety": lambda: _vote((part("_distinct", n) < 0.12) & (n >= 50), (part("_distinct", n) > 0.4) & (n >= 20)),
        "sentences": lambda: _vote((F.col("_stops") == 0) & (n >= 40), (part("_stops", n) > 0.02) & (part("_stops", n) < 0.34)),
    }


def measured(rows: DataFrame) -> DataFrame:
    """Adds what the labellers look at."""
    text, words = F.col("_text"), F.col("_words")
    return rows.select(
        "*",
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).alias("_letters"),
        F.length(F.regexp_replace(text, r"[\p{N}\s.,;:?'()-]+", "")).alias("_solid"),  # neither digits nor white space nor common punctuation
        _count(text, r"\p{Lu}+").alias("_capitals"),
        _count(text, r"[#*$%&|<>!]+").alias("_symbols"),
        _count(text, r"[.!?]+").alias("_stops"),
        _let(words, lambda ws: F.size(F.filter(_same(ws), lambda x: x))).alias("_same"),
        F.size(F.array_distinct(words)).alias("_distinct"),
    )


def prepared(docs: DataFrame, text: Column) -> DataFrame:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", f"{shared.SPACE}+"), lambda w: w != "")).withColumn("_n", F.size("_words"))


def _bound(rates: dict[str, float], vote: str, least: float = 0.0, most: float = 1.0) -> None:
    """Keep one rate within bounds; the others share the rest as before."""
    to = min(most, max(least, rates[vote]))
    rest = (1 - to) / (1 - rates[vote])
    for v in rates:
        rates[v] = to if v == vote else rates[v] * rest


class LabelModel:
    """P(good), and for each labeller how often it gives each vote on good and on bad texts."""

    def __init__(self, labellers: int, false_alarm: float = FALSE_ALARM):
        self.false_alarm = false_alarm
        # the start only says that labellers are right more often than wrong
        self.prior = 0.8
        self.gives = [{GOOD: {GOOD: 0.6, BAD: 0.02, NONE: 0.38}, BAD: {GOOD: 0.4, BAD: 0.3, NONE: 0.3}} for _ in range(labellers)]

    def log_odds(self, j: int, vote: str) -> float:
        """What a vote says, silence included."""
        return math.log(self.gives[j][GOOD][vote] / self.gives[j][BAD][vote])

    def posterior(self, votes: str) -> float:
        x = math.log(self.prior / (1 - self.prior)) + sum(self.log_odds(j, v) for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))

    def fit(self, patterns: dict[str, int], rounds: int = 50) -> LabelModel:
        total = sum(patterns.values())
        for _ in range(rounds if total else 0):
            p = {v: self.posterior(v) for v in patterns}
            self.prior = min(0.99, max(0.01, sum(n * p[v] for v, n in patterns.items()) / total))
            for j, gives in enumerate(self.gives):
                for kind in (GOOD, BAD):
                    mass = {v: n * (p[v] if kind == GOOD else 1 - p[v]) for v, n in patterns.items()}
                    whole = sum(mass.values())
                    for vote in (GOOD, BAD, NONE):
                        gives[kind][vote] = (sum(m for v, m in mass.items() if v[j] == vote) + 0.5) / (whole + 1.5)
                # what is known of every labeller: it seldom calls a good text bad, and not never a bad one
                _bound(gives[GOOD], BAD, most=self.false_alarm)
                _bound(gives[BAD], BAD, least=DETECTION)
        return self

    def column(self, votes: Column) -> Column:
        """The posterior for the votes as a string column."""
        x = F.lit(math.log(self.prior / (1 - self.prior)))
        for j in range(len(self.gives)):
            v = F.substring(votes, j + 1, 1)
            x = x + F.when(v == GOOD, self.log_odds(j, GOOD)).when(v == BAD, self.log_odds(j, BAD)).otherwise(self.log_odds(j, NONE))
        return 1 / (1 + F.exp(-x))


def features(rows: DataFrame, bits: int) -> DataFrame:
    """Adds _x: hashed, normalised counts of word shapes and of pairs of them.

    Shape: runs of capitals become A, of other letters a, digits 0; a word equal
    to the one before is marked."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", r"\p{Lu}+", "A"), r"[\p{L}\p{M}&&[^A]]+", "a"), r"\p{N}+", "0")
    shapes = F.filter(F.split(shape, f"{shared.SPACE}+"), lambda w: w != "")
    marked = lambda ws: F.zip_with(shapes, _same(ws), lambda s, same: F.when(same, F.concat(s, F.lit("="))).otherwise(s))
    pairs = lambda m: F.concat(m, F.transform(m, lambda s, i: F.concat_ws(" ", F.get(m, i - 1), s)))
    tokens = _let(_let(F.col("_words"), marked), pairs)
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=1 << bits)
    return Normalizer(inputCol="_tf", outputCol="_x").transform(counted.transform(rows.withColumn("_tokens", tokens)))


def fit_scorer(drawn: DataFrame) -> LogisticRegressionModel | None:
    """``drawn``: _x and _p, the posterior; texts near 1/2 weigh little."""
    rows = drawn.select(F.col("_x").alias("features"), (F.col("_p") >= 0.5).cast("double").alias("label"), F.abs(2 * F.col("_p") - 1).alias("weight"))
    if rows.select("label").distinct().count() < 2:
        return None
    return LogisticRegression(weightCol="weight", maxIter=30, regParam=1e-3, aggregationDepth=2).fit(rows)


def weak_label_quality(docs: DataFrame, text_col: str = "text", sample: int = 8000, bits: int = 14, threshold: float = 0.5, false_alarm: float = STRICT) -> DataFrame:
    """``docs`` with score (of the linear scorer, 0 to 1) and kept."""
    boxed = docs.select(F.struct(*[shared.named(c) for c in docs.columns]).alias("_doc"))
    rows = prepared(boxed, shared.field(text_col))
    voters = labellers()
    votes = F.concat(*[f() for f in voters.values()])
    counted = measured(rows).where("_n > 0").select(votes.alias("votes")).groupBy("votes").count()
    patterns = {r.votes: r["count"] for r in counted.collect()}  # at most 3 ** labellers
    model = LabelModel(len(voters), false_alarm).fit(patterns)
    total = sum(patterns.values())
    rate = F.lit(int(min(1.0, sample / max(1, total)) * (1 << 30)))
    texts = boxed.select(F.coalesce(shared.field(text_col).cast("string"), F.lit("")).alias("text"))
    once = shared.cut(texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < rate).distinct(), "drawn")
    drawn = measured(prepared(once, F.col("text")).where("_n > 0"))
    drawn = shared.cut(features(drawn.withColumn("_p", model.column(votes)), bits).select("_x", "_p"), "training")
    scorer = fit_scorer(drawn)
    if scorer is None:
        judged = measured(rows).withColumn("score", F.when(F.col("_n") > 0, model.column(votes)).otherwise(0.0))
    else:
        scorer = scorer.setFeaturesCol("_x").setProbabilityCol("_prob").setPredictionCol("_pred").setRawPredictionCol("_raw")
        judged = scorer.transform(features(rows, bits)).withColumn("score", F.when(F.col("_n") > 0, vector_to_array("_prob")[1]).otherwise(0.0))
    return judged.select(*shared.unboxed(docs.columns, ADDED), "score", (F.col("score") >= threshold).alias("kept"))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    return weak_label_quality(docs).drop("text")
