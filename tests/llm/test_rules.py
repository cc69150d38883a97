"""Line rules, URL filter and weak labels against brute force and planted cases."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from pixelloom.llm import line_rules, url_filter, weak_labels

SCHEMA = "doc_id long, text string, source string, kept string"


def documents():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)] + ["a#b", "$", "Ünï"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    common = "Share this  page NOW 2024"
    out = []
    for i in range(120):
        lines = [line(rng.randint(0, 14)) for _ in range(rng.randint(1, 5))]
        if i % 2:
            lines.insert(0, common.replace("2024", str(2000 + i)))
        if i % 7 == 0:
            lines += [lines[0], lines[-1]]
        out.append((i, "\n".join(lines), "big" if i % 3 else None, "x"))
    out += [(200, None, "big", "x"), (201, "", None, "x"), (202, "\n \t\n", "big", "x"), (203, "\n".join([common] * 30), "big", "x"), (204, "one two three four five " * 40, "s", "x"), (205, line(20000), "s", "x")]
    out += [(None, line(30), None, "x"), (5, line(12), "big", "x"), (5, out[5][1], "big", "x")]
    return out


def brute(rows, max_docs, max_removed):
    space = r"[\x20\x09-\x0d]"
    form = lambda y: re.sub("[0-9]", "0", re.sub(r"[\x20\x09\x0b-\x0d]+", " ", y.lower())).strip(" ")
    normal = lambda t: [x for x in map(form, (t or "").split("\n")) if x]
    seen = defaultdict(int)
    for r in rows:
        for x in set(normal(r[1])):
            seen[r[2], x] += 1
    out = []
    for d, t, host, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        common = [x for x in normal(t) if seen[host, x] > max_docs]
        removed = sum(len(x.split(" ")) for x in common)
        clean = "\n".join(x for x in (t or "").split("\n") if seen.get((host, form(x)), 0) <= max_docs)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((d, len(words), len(re.sub(space, "", t or "")), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed, len(common), removed, not failed and removed <= max_removed * len(words), clean))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [(10, 0.8), (3, 0.1)])
def test_line_rules(spark, tmp_path, limits):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    got = line_rules.quality_rules(spark.read.parquet(str(tmp_path / "d")), max_docs=limits[0], max_removed=limits[1])
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = brute(rows, *limits)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(w[7] > 0 for w in want) > 20
    assert line_rules.quality_rules(spark.read.parquet(str(tmp_path / "d")).where("false")).count() == 0


def test_url_filter(spark, tmp_path):
    rng = random.Random(2)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    domains = ["a.com", "x.a.com", "y.x.a.com", "b.org", "co", "c.net", "localhost"]
    entries = [(rng.choice(domains), rng.choice(["add", "remove"]), day(rng.randint(0, 30))) for _ in range(25)]
    entries += [(None, "add", day(1)), ("a.com", "other", day(2)), ("b.org", "add", None), ("LOCALHOST", "add", day(0))]
    hosts = ["a.com", "X.A.com", "deep.y.x.a.com.", "nota.com", "b.org", "z.b.org", "c.net", "localhost", "d.e"]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '/p?q=http://b.org', '#f'])}" for _ in range(200)] + [None, "", "no url", "mailto:x@a.com", "http:///path"]
    rows = [(i, u, day(rng.randint(-1, 33)) if i % 17 else None, "r") for i, u in enumerate(urls)]
    rows += [rows[3], rows[3]]
    spark.createDataFrame(rows, "page_id long, url string, fetched timestamp, rule string").repartition(3).write.parquet(str(tmp_path / "p"))
    listed = spark.createDataFrame(entries, "domain string, action string, since timestamp")
    got = url_filter.temporal_filter(spark.read.parquet(str(tmp_path / "p")), listed).select("page_id", "host", "blocked", "rule", "rule_since").collect()

    states = defaultdict(dict)
    for d, action, since in entries:
        if d and since and action in ("add", "remove"):
            states[d.lower()][since] = max(action, states[d.lower()].get(since, ""))
    want = []
    for page, url, at, _ in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        host = m[1].lower().rstrip(".") if m else None
        rule = (None, None)
        labels = host.split(".") if host and at else []
        for k in range(max(len(labels) - 1, 1) if labels else 0):
            domain = ".".join(labels[k:])
            past = [s for s in states[domain] if s <= at]
            if past and states[domain][max(past)] == "add":
                rule = (domain, max(past))
                break
        want.append((page, host, rule[0] is not None, *rule))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert 20 < sum(w[2] for w in want) < 180
    assert url_filter.temporal_filter(spark.read.parquet(str(tmp_path / "p")).where("false"), listed).count() == 0


def planted(n, seed):
    rng = random.Random(seed)
    words = "the river house of light and green stone over north water with small garden under evening road".split()
    out = []
    for i in range(n):
        kind = i % 5
        text = ". ".join(" ".join(rng.choices(words, k=rng.randint(5, 12))).capitalize() for _ in range(rng.randint(3, 9))) + "."
        if kind == 3:
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split())
        if kind == 4:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w for w in text.split() for _ in range(rng.randint(4, 9)))])
        out.append((i, text, "s", "k", kind < 3))
    return out


def test_weak_labels(spark):
    rows = planted(400, 1)
    docs = spark.createDataFrame([r[:4] for r in rows] + [(900, None, "s", "k"), (901, " \n", "s", "k"), (902, "Short but fine text about the river.", None, None), (0, rows[0][1], "s", "k")], SCHEMA)
    out = weak_labels.weak_label_quality(docs)
    assert out.columns == ["doc_id", "text", "source", "score", "kept"]
    got = {r.doc_id: r for r in out.collect()}
    right = sum(got[i].kept == good for i, _, _, _, good in rows)
    assert right >= 0.98 * len(rows)
    assert not got[900].kept and not got[901].kept and got[900].score == 0
    assert weak_labels.weak_label_quality(docs.where("false")).count() == 0
    one = weak_labels.weak_label_quality(docs.where("doc_id = 0")).collect()
    assert len(one) == 2 and one[0].score == one[1].score


def test_em_finds_the_labellers_rates():
    rng = random.Random(5)
    rates = [(0.9, 0.015), (0.5, 0.01), (0.6, 0.02), (0.7, 0.01)]  # how often each labeller calls bad texts bad, and good ones
    patterns, truth = Counter(), Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        votes = "".join("b" if rng.random() < (r[1] if good else r[0]) else "-" for r in rates)
        patterns[votes] += 1
        truth[votes] += good
    model = weak_labels.LabelModel(4).fit(dict(patterns))
    assert abs(model.prior - 0.8) < 0.05
    for gives, (bad, good) in zip(model.gives, rates, strict=True):
        assert abs(gives["b"]["b"] - bad) < 0.12 and abs(gives["g"]["b"] - good) < 0.03
    wrong = sum(n for v, n in patterns.items() if (model.posterior(v) > 0.5) != (truth[v] > n / 2)) / 20000
    assert wrong < 0.03
