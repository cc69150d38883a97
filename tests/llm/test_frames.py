"""What holds for every operator: clashing names, empty tables, lazy results after a pipeline run."""

from datetime import datetime

import pytest

import corpus_pipeline as cp
from pixelloom.llm import exact_dedup, language, line_rules, packing, pieces, simhash, suffix_dedup, url_filter, warc, weak_labels

EXTRA = ["_row", "_text", "_doc", "_id", "_host", "_n", "_key", "score", "kept", "keep_id", "host", "gone", "h", "n", "part", "queue", "url.of", "Block", "a`b", "Doc_Row"]
SENTENCE = "The river runs past the old stone house, and people walk along its bank every day."


def table(spark, path):
    rows = []
    for i, text in enumerate([SENTENCE, SENTENCE, None, "", "w " * 20000, "Another sentence about a mill and a garden in the north of the town."]):
        rows.append((i, text, "s" if i % 2 else None, "en", "http://a.com/x", datetime(2024, 1, 2), *[f"own {c}" for c in EXTRA]))
    schema = "doc_id long, text string, source string, lang string, url string, fetched timestamp, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in EXTRA)
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def listed(spark):
    return spark.createDataFrame([("a.com", "add", datetime(2024, 1, 1))], "domain string, action string, since timestamp")


OPERATORS = {
    "exact": lambda s, d: (exact_dedup.exact_dedup(d), exact_dedup.ADDED),
    "urls": lambda s, d: (url_filter.temporal_filter(d, listed(s)), url_filter.ADDED),
    "quality": lambda s, d: (weak_labels.weak_label_quality(d), weak_labels.ADDED),
    "repeats": lambda s, d: (suffix_dedup.remove_repeats(d), ("text",)),
    "languages": lambda s, d: (language.identify(d, language.fit(d.selectExpr("doc_id as id", "lang", "text"))), (*language.ADDED, "text")),
}
OTHERS = {
    "lines": line_rules.quality_rules,
    "simhash": simhash.near_duplicates,
    "packing": packing.pack,
    "pieces": pieces.encoded,
    "warc": lambda d: warc.headers(d, id_col="doc_id", payload_col="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_the_user_stay(spark, tmp_path, name):
    docs = table(spark, str(tmp_path / "d"))
    out, replaced = OPERATORS[name](spark, docs)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(6))
    for c in EXTRA:
        if c not in replaced:
            assert {r[c] for r in rows} == {f"own {c}"}
    assert OPERATORS[name](spark, docs.where("false"))[0].count() == 0


@pytest.mark.parametrize("name", ["exact", "quality", "languages"])
def test_added_columns_replace_those_of_another_case(spark, tmp_path, name):
    rows = [(i, t, "s", "en", "mine", "mine", "mine", "mine", "mine") for i, t in enumerate([SENTENCE, SENTENCE, None])]
    schema = "doc_id long, text string, source string, lang string, `Kept` string, `SCORE` string, `Keep_Id` string, `Lang_Pred` string, `x``y` string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    out, added = OPERATORS[name](spark, spark.read.parquet(str(tmp_path / "d")))
    got = out.collect()
    assert len(got) == 3 and all(r["x`y"] == "mine" for r in got)
    assert all(out.columns.count(c) == 1 for c in added if c != "text") and len({c.casefold() for c in out.columns}) == len(out.columns)


STAGES = [s for s in cp.STAGES if s[0] != "packing"]


@pytest.mark.parametrize("stage", STAGES, ids=[s[0] for s in STAGES])
def test_stages_keep_the_users_columns(spark, tmp_path, stage):
    rows = [(i, SENTENCE + f" It is number {i % 3}.", "en", "s", 100, f"k{i}", f"s{i}", f"b{i}", f"g{i}") for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `Kept` string, score string, `a``b` string, component_id string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = stage[1](spark, docs, str(tmp_path))
    got = out.collect()
    assert out.columns == docs.columns and got
    assert all((r["Kept"], r["score"], r["a`b"], r["component_id"]) == (f"k{r.doc_id}", f"s{r.doc_id}", f"b{r.doc_id}", f"g{r.doc_id}") for r in got)


@pytest.mark.parametrize("name", OTHERS)
def test_columns_of_the_user_change_nothing(spark, tmp_path, name):
    docs = table(spark, str(tmp_path / "d"))
    plain = docs.select("doc_id", "text", "source", "url")
    assert sorted(map(tuple, OTHERS[name](docs).collect()), key=repr) == sorted(map(tuple, OTHERS[name](plain).collect()), key=repr)
    assert OTHERS[name](docs.where("false")).count() == 0


def test_lazy_results_survive_a_pipeline(spark, tmp_path):
    spark.createDataFrame([(i, SENTENCE + f" It is number {i}.", "en", "s", 100) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    early = exact_dedup.op2_exact_dedup(spark, str(tmp_path))
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert early.count() == 4
