"""Filter audit against a replay in plain loops."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from pixelloom.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(210))


def plain(docs, labels):
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    failed = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        no = set()
        if len(w) < 200:
            no.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            no.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            no.add("C")
        if re.search(r"[#$%&*|]", text):
            no.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            no.add("E")
        good, toxic = marks.get(i, (False, False)) if i is not None else (False, False)
        failed.append((part or "", no, good, toxic))
    out, shapley = {}, Counter()
    for part in {x[0] for x in failed}:
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                row = [0] * 6
                for p, no, good, toxic in failed:
                    if p != part:
                        continue
                    before, own = bool(no & set(order[: step - 1])), letter in no
                    row[0] += not before and not own
                    row[1] += own and not before
                    row[2] += own and before
                    row[3] += no == {letter}
                    row[4] += own and not before and good
                    row[5] += own and not before and toxic
                out[part, "".join(order), step] = row
                shapley[part, letter] += row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    # columns named like the operator's own
    d = d.withColumns({c: F.lit("mine") for c in ("id", "part", "fails", "words", "digest", "good", "Step", "a`b", "order_no")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_replay(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "de"), (4, "x " * 300, "en"), (5, "SHOUT " * 250, "de"),
        (6, None, None), (7, "", ""), (8, " \t\n\x0b\f\r ", "en"), (None, LONG, "en"), (None, LONG, None), (9, "É Ω " * 400, "de"),
        (10, " ".join(f"w{i}" for i in range(30000)), "en"), (11, "100% " + LONG, "en"), (0, LONG.replace("1", "2") + "!", "de"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 0), (5, 1, 1), (5, 0, None), (6, 0, 1), (None, 1, 1), (10, None, None), (11, 1, 0), (99, 1, 1)]
    d, marks = table(spark, docs, labels)
    got = filter_audit.audit(d, marks)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")
    rows = got.collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows} == plain(docs, labels)
    assert len(rows) == 3 * 600


def test_empty_and_unlabelled(spark):
    d, marks = table(spark, [(1, LONG, "en")], [(1, 1, 1)])
    assert filter_audit.audit(d.where("false"), marks).count() == 0
    rows = filter_audit.audit(d, marks.where("false")).collect()
    assert len(rows) == 600 and all(r.kept == 1 and r.removed == r.good_lost == r.shapley == 0 for r in rows)


def test_other_filters(spark):
    d, marks = table(spark, [(1, "a", "en"), (2, "ab", "en"), (3, "ab", "en")], [])
    rows = filter_audit.audit(d, marks, {"s": lambda text, words: F.length(text) < 2, "l": lambda text, words: F.length(text) > 0}, None).collect()
    assert {(r.filter_order, r.step): (r.removed, r.redundant) for r in rows} == {("ls", 1): (3, 0), ("ls", 2): (0, 1), ("sl", 1): (1, 0), ("sl", 2): (2, 1)}
