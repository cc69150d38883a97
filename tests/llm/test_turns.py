"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from pixelloom.llm import turns

NOT_SPACE = r"[^\x20\x09-\x0D]"


def accepted(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def cheapest(rows):
    """(cost, edits, repaired) by best-first search over (position, roles so far, edits); rows: (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        # of equal cost, the least audit is not always the first to be popped: finals of one cost are gathered
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            finals = [(audit, made)] + [(a, m) for c, a, i, s, m in heap if c == cost and i == len(rows) and s in (0, 3)]
            rest = [(c, a, i, s, m) for c, a, i, s, m in heap if c == cost]
            while rest:  # zero-cost moves that are still open at this cost
                c, a, i, s, m = rest.pop()
                for n in moves(rows, i, s):
                    if n[0] == 0:
                        x = (c, a + n[1], n[2], n[3], m + n[4])
                        rest.append(x)
                        if x[2] == len(rows) and x[3] in (0, 3):
                            finals.append((x[1], x[4]))
            return (cost, *min(finals))
        if (cost, audit, at, state) in done:
            continue
        done.add((cost, audit, at, state))
        for more, letter, i, s, m in moves(rows, at, state):
            heapq.heappush(heap, (cost + more, audit + letter, i, s, made + m))
    raise AssertionError


def moves(rows, at, state):
    out = []
    due = {0: "us", 1: "u", 2: "a", 3: "u"}[state]
    full = {"u": "user", "a": "assistant"}
    to = {"u": 2, "a": 3, "s": 1}
    for x in due.replace("s", ""):
        out.append((2, "I", at, to[x], (f"{full[x]}:",)))
    if at < len(rows):
        role, text, fault = rows[at]
        out.append((3, "D", at + 1, state, ()))
        if fault not in ("blank", "duplicate"):
            t = fault == "truncated"
            if role[:1] and role[0] in due:
                out.append((t, "K", at + 1, to[role[0]], (f"{role}:{text}",)))
            for x in due.replace("s", ""):
                out.append((2 + t, "R", at + 1, to[x], (f"{full[x]}:{text}",)))
    return out


def plain(rows):
    """conv -> the query's row, without the engine."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if what == 1:
                text = ""
            if what == 2:
                text = re.sub("[.!?]", "", text)
            if what == 4:
                role = "user"
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in kept:
            body = re.findall(NOT_SPACE, text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = lambda f: sum(x[2] == f for x in judged)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, made = cheapest(judged)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sys\nadmin"])
            text = rng.choice(["Yes.", "No", "Why?  \n", "", " \t", None, "Ünï — ok!", "so: what\nnow", "Yes."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None, -turn]), role, text))
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def asked(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return spark.read.parquet(f"{path}/conversations.parquet")


@pytest.mark.parametrize("sizes", [(4096, 1 << 20), (3, 1 << 20), (1, 1 << 20), (4096, 10)])
def test_query_and_blocks(spark, tmp_path, sizes):
    rows = conversations(sizes[0] + sizes[1], 60, 9)
    got = turns.digests(turns.repair(turns.damaged(asked(spark, tmp_path, rows)), copies_col="copies", block_rows=sizes[0], block_bytes=sizes[1]))
    assert {r.conv: tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain(rows)


def test_registered_query(spark, tmp_path):
    rows = [*conversations(5, 30, 6), (500, 3, "user", "x" * 300_000 + "."), (501, 0, "user", "Hm.")]
    asked(spark, tmp_path, rows)
    out = turns.op12_conversation_repair(spark, str(tmp_path))
    assert dict(out.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string"} | dict.fromkeys(COLUMNS[:6], "bigint")
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in out.collect()} == plain(rows)


def test_one_long_conversation_is_split(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"Turn {rng.randrange(2000)}" + rng.choice([".", ""])) for i in range(3000)] + [(2, 0, "user", "Hi.")]
    d = turns.damaged(asked(spark, tmp_path, rows))
    whole = turns.repair(d, copies_col="copies", block_rows=1 << 20, block_bytes=1 << 30)
    split = turns.repair(d, copies_col="copies", block_rows=100)
    assert split.where("conv = 1").count() >= 30 and split.agg({"turns": "max"}).first()[0] <= 200
    assert sorted(turns.digests(whole).collect()) == sorted(turns.digests(split).collect())
    # what is left spells the grammar, and no turn that is not blank or repeated is lost without need
    left = [r.role[0] for r in turns.turns_of(split).where("conv = 1").orderBy("part", "seq", "n").collect()]
    assert accepted("".join(left)) and len(left) > 1500


def test_empty_table_and_names(spark, tmp_path):
    rows = asked(spark, tmp_path, conversations(9, 4, 4))
    assert turns.digests(turns.repair(rows.where("false"))).count() == 0
    plainly = turns.digests(turns.repair(rows)).collect()
    odd = rows
    for c in ("conv", "part", "seq", "n", "digest", "_row", "Turns", "end", "a`b"):
        odd = odd.withColumn(c, rows.text)
    assert sorted(map(str, turns.digests(turns.repair(odd)).collect())) == sorted(map(str, plainly))
