"""Repair of a conversation's structure by the cheapest edits.

The roles of a repaired conversation spell ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turns. Every turn is kept (cost 0), given the role that
is due (Rerole, 2) or deleted (3); turns without text may be inserted (2). A turn's
first fault counts: *blank* (no text) and *duplicate* (role and text were seen
earlier) must go, *truncated* (does not end in ``. ! ?``) costs 1 unless deleted.

The grammar has four states (start, after s, after u, after a). A backward pass
computes the cheapest cost to the end from every turn and state; a forward walk then
takes, among the edits on which that cost is tight, the one with the ASCII-least
initial, so of all cheapest edit sequences the least one is found (in every state but
one role is due, so an initial names its edit).

A conversation may hold a third of all turns. Turns are sorted by range over the whole
table and packed into blocks of at most ``block_rows`` turns or ``block_bytes`` of text. A
conversation that lies whole in one block, as nearly all do, is finished there. Those that
go over a border are solved by blocks: a block's (min, +) matrix of four by four costs
is enough to hand the cost to go from block to block, a map of four states to hand on
the walk, and both are lists of a few numbers a block. Only the digest of such a
conversation's text must be fed in order; it is streamed, a block at a time.

Defined results: null roles and texts are one space (so a null text is blank); turns
are ordered by turn number (null first), then role, then the SHA-256 of the text; a null
conversation id is a conversation. Turns that repeat each other are duplicates but for
the first. Texts of any length are read whole. Only the named columns are read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared

BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
_NOT_SPACE = re.compile(shared.NOT_SPACE)
_FAR = 1 << 40

# States: 0 start, 1 after s, 2 after u, 3 after a. In each, one of u and a is due.
_DUE = "uuau"
_NEXT = (2, 2, 3, 2)
_ROLE = {"u": "user", "a": "assistant"}
#: Cost from each state to an accepting end.
_END = (0, 4, 2, 0)


def _initials(state: int, initial: str) -> int | None:
    """The state after keeping a turn with this role initial, if it may be kept."""
    if initial == _DUE[state]:
        return _NEXT[state]
    return 1 if state == 0 and initial == "s" else None


_KEPT = {(s, x): _initials(s, x) for s in range(4) for x in "sua"}


def step(after: tuple, initial: str, fault: str) -> tuple:
    """Cheapest costs before a turn, by state, from those after it."""
    more = 1 if fault == "t" else 0
    best = []
    for s in range(4):
        cost = 3 + after[s]
        if fault not in "bd":
            cost = min(cost, 2 + more + after[_NEXT[s]])
            kept = _KEPT.get((s, initial))
            if kept is not None:
                cost = min(cost, more + after[kept])
        best.append(cost)
    u, a = min(best[2], 2 + best[3]), min(best[3], 2 + best[2])
    return min(best[0], 2 + u), min(best[1], 2 + u), u, a


def costs(turns: list[tuple[str, str]], end: tuple = _END) -> list[tuple]:
    """Costs to go before each of the turns (initial, fault), and at the end."""
    out = [end]
    for initial, fault in reversed(turns):
        out.append(step(out[-1], initial, fault))
    return out[::-1]


def walk(turns: list[tuple[str, str]], to_go: list[tuple], state: int, last: bool) -> tuple[list[tuple[str, int, str]], int]:
    """(initial of the edit, number of its turn, role due) of the least edits, and the state they
    lead to. ``last``: turns may be inserted behind the last one too."""
    edits: list[tuple[str, int, str]] = []
    for i, (initial, fault) in enumerate(turns):
        while True:
            now, due, then = to_go[i][state], _DUE[state], _NEXT[state]
            more = 1 if fault == "t" else 0
            if 3 + to_go[i + 1][state] == now:
                edits.append(("D", i, ""))
            elif 2 + to_go[i][then] == now:
                edits.append(("I", i, due))
                state = then
                continue
            elif fault not in "bd" and _KEPT.get((state, initial)) is not None and more + to_go[i + 1][_KEPT[state, initial]] == now:
                edits.append(("K", i, ""))
                state = _KEPT[state, initial]
            else:
                edits.append(("R", i, due))
                state = then
            break
    while last and to_go[-1][state]:
        edits.append(("I", len(turns), _DUE[state]))
        state = _NEXT[state]
    return edits, state


def _fault(text: str, seen: bool) -> str:
    found = _NOT_SPACE.search(text)
    if not found:
        return "b"
    if seen:
        return "d"
    return "-" if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "t"


def _packed(sizes: tuple[int, int]):
    """Sorted turns -> blocks. A block is ``whole`` if its conversation surely has no other."""
    most, most_bytes = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, conv = TaskContext.get().partitionId(), 0, [], 0, None
        opened = True  # what lies before the partition's first turn is not known

        def out(whole: bool) -> pa.RecordBatch:
            turn, role, text, n = zip(*held, strict=True)
            lists = [pa.array([list(x)], t) for x, t in ((turn, pa.list_(pa.int64())), (role, pa.list_(pa.string())), (text, pa.list_(pa.string())), (n, pa.list_(pa.int32())))]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([whole]), *lists], ["conv", "part", "seq", "whole", "turn", "role", "text", "n"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if held and (row[0] != conv or len(held) >= most or size >= most_bytes):
                    yield out(not opened and row[0] != conv)
                    opened, seq, held, size = row[0] == conv, seq + 1, [], 0
                conv = row[0]
                held.append(row[1:])
                size += len(row[3])
        if held:
            yield out(False)

    return run


class _Block:
    """The turns of a block: copies told out, faults found."""

    def __init__(self, row: dict):
        self.turn, self.role, self.text = [], [], []
        for t, r, x, n in zip(row["turn"], row["role"], row["text"], row["n"], strict=True):
            for _ in range(n):
                self.turn.append(t)
                self.role.append(r)
                self.text.append(x)
        first = row.get("firsts")
        if first is None:  # a whole conversation
            seen: set[tuple[str, str]] = set()
            again = []
            for pair in zip(self.role, self.text, strict=True):
                again.append(pair in seen)
                seen.add(pair)
        else:
            again = [i not in first for first in [set(first)] for i in range(len(self.turn))]
        faults = [_fault(x, a) for x, a in zip(self.text, again, strict=True)]
        self.turns = [(r[:1], f) for r, f in zip(self.role, faults, strict=True)]

    def counts(self) -> dict:
        numbered = [t for t in self.turn if t is not None]
        initials = [r for r, _ in self.turns]
        count = lambda f: sum(x == f for _, x in self.turns)
        return {
            "turns": len(self.turns), "blank": count("b"), "duplicate": count("d"), "truncated": count("t"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
            "least_turn": min(numbered, default=None), "most_turn": max(numbered, default=None), "numbers": len(set(numbered)),
        }

    def repaired(self, end: tuple, entry: int, last: bool) -> dict:
        to_go = costs(self.turns, end)
        edits, _ = walk(self.turns, to_go, entry, last)
        made = [{"edit": e, "role": None, "text": None} if e == "D" else {"edit": e, "role": _ROLE[due] if e in "RI" else self.role[i], "text": "" if e == "I" else self.text[i]} for e, i, due in edits]
        cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] + (e in "KR" and self.turns[i][1] == "t") for e, i, _ in edits)
        return {"cost": cost, "edits": made}


_COUNTS = "turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, least_turn long, most_turn long, numbers long"
_EDITS = "edits array<struct<edit:string,role:string,text:string>>"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _by_block(blocks: DataFrame, work, schema: StructType) -> DataFrame:
    """``work`` (a block's row -> the new row) over ``blocks``, one block at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held, size = [], 0
        for row in _rows(batches):
            held.append(work(row))
            size += sum(map(len, row["text"]))
            if size > BLOCK_BYTES or len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return blocks.mapInArrow(shared.lean(run), schema)


def _keyed(df: DataFrame, columns: str) -> StructType:
    """(conv, part, seq, whole) of ``df`` and further columns."""
    return StructType([*(df.schema[c] for c in ("conv", "part", "seq", "whole")), *StructType.fromDDL(columns).fields])


def _finished(row: dict, last: bool = True) -> dict:
    block = _Block(row)
    end = tuple(row["end"]) if row.get("end") is not None else _END
    return {k: row[k] for k in ("conv", "part", "seq", "whole")} | block.counts() | block.repaired(end, row.get("entry") or 0, row.get("last", True))


def _with_firsts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the positions (copies told out) whose role and text no earlier one has."""
    copies = "flatten(transform(n, (c, i) -> array_repeat(struct(role[i] as role, unhex(sha2(text[i], 256)) as digest), c)))"
    each = blocks.select("conv", "part", "seq", F.posexplode(F.expr(copies)).alias("pos", "turn"))
    at = F.struct("part", "seq", "pos")
    firsts = each.groupBy("conv", "turn.role", "turn.digest").agg(F.min(at).alias("at")).select("at.*")
    firsts = firsts.groupBy("part", "seq").agg(F.collect_list("pos").alias("firsts"))  # a block's turns at most
    out = blocks.join(firsts, ["part", "seq"], "left")
    return shared.cut(out.withColumn("firsts", F.coalesce("firsts", F.array().cast("array<int>"))), "open")


def _handed_on(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the costs at their end, the state in which the walk enters, and which is the last."""
    def matrix(row: dict) -> dict:
        turns, apart = _Block(row).turns, [tuple(0 if s == t else _FAR for s in range(4)) for t in range(4)]
        by_end = [costs(turns, end)[0] for end in apart]  # [leaving state][entering state]
        return {k: row[k] for k in ("conv", "part", "seq", "whole")} | {"m": [by_end[t][s] for s in range(4) for t in range(4)]}

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        out, end = [], _END
        for m in reversed(group["m"].tolist()):
            out.append(list(end))
            end = tuple(min(min(int(m[4 * s + t]) + end[t], _FAR) for t in range(4)) for s in range(4))
        group["end"], group["last"] = out[::-1], [False] * (len(out) - 1) + [True]
        return group[["part", "seq", "end", "last"]]

    def passage(row: dict) -> dict:
        turns = _Block(row).turns
        to_go = costs(turns, tuple(row["end"]))
        return {k: row[k] for k in ("conv", "part", "seq", "whole")} | {"leave": [walk(turns, to_go, s, False)[1] for s in range(4)]}

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "seq"])
        out, state = [], 0
        for leave in group["leave"]:
            out.append(state)
            state = int(leave[state])
        group["entry"] = out
        return group[["part", "seq", "entry"]]

    found = _by_block(blocks, matrix, _keyed(blocks, "m array<long>")).groupBy("conv").applyInPandas(ends, "part int, seq long, end array<long>, last boolean")
    blocks = shared.cut(blocks.join(shared.cut(found, "ends"), ["part", "seq"]), "ended")
    found = _by_block(blocks, passage, _keyed(blocks, "leave array<int>")).groupBy("conv").applyInPandas(entries, "part int, seq long, entry int")
    return blocks.join(shared.cut(found, "entries"), ["part", "seq"])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block of each conversation (nearly always one): conv, part, seq (the order of blocks),
    whole (it is the conversation's only one), counts, the cost and the edits (initial, and the repaired
    turn, which is null for deletions). copies_col: how often a row counts; with 0 it only names its
    conversation. ``turns`` must be a stable scan."""
    space = F.lit(" ")
    rows = shared.with_row(
        turns.select(
            shared.named(conv_col).alias("conv"), shared.named(turn_col).cast("long").alias("turn"), F.coalesce(shared.named(role_col).cast("string"), space).alias("role"),
            F.coalesce(shared.named(text_col).cast("string"), space).alias("text"), (shared.named(copies_col) if copies_col else F.lit(1)).cast("int").alias("n"),
        )
    )
    # the row itself comes last, so that equal rows need not lie in one partition
    order = ["conv", "turn", "role", "digest", "_row"]
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "n")
    schema = StructType([rows.schema["conv"], *StructType.fromDDL("part int, seq long, whole boolean, turn array<long>, role array<string>, text array<string>, n array<int>").fields])
    blocks = shared.cut(ranged.mapInArrow(shared.lean(_packed((block_rows, block_bytes))), schema), "blocks")
    result = _keyed(blocks, f"{_COUNTS}, cost long, {_EDITS}")
    whole = _by_block(blocks.where("whole"), _finished, result)
    across = _handed_on(_with_firsts(blocks.where("not whole")))
    return whole.unionByName(_by_block(across, _finished, result))


def turns_of(repaired: DataFrame) -> DataFrame:
    """(conv, part, seq, n, edit, role, text): the turns that ``repair`` leaves, in order of part, seq and n."""
    return repaired.select("conv", "part", "seq", F.posexplode("edits").alias("n", "e")).select("conv", "part", "seq", "n", "e.*").where("edit <> 'D'")


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: its counts, its audit and the digest of its repaired turns."""
    left = F.filter("edits", lambda e: e["edit"] != "D")
    joined = F.array_join(F.transform(left, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("numbers"), F.lit(0)).cast("long")
    one = repaired.where("whole").select(
        "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("edits", lambda e: e["edit"]), "").alias("audit"), F.sha2(joined, 256).alias("repaired_sha256"),
    )

    names = ["conv", *StructType.fromDDL(_DIGEST).fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, None

        def out() -> pa.RecordBatch:
            gaps = held["most"] - held["least"] + 1 - held["numbers"] if held["least"] is not None else 0
            row = [held["conv"], gaps, *(held[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(held["audit"]), held["sha"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], kind), *(pa.array([x]) for x in row[1:])], names)

        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in _rows([batch]):
                if held is None or row["conv"] != held["conv"]:
                    if held:
                        yield out()
                    held = {"conv": row["conv"], "least": None, "most": None, "numbers": 0, "initial": None, "audit": [], "sha": hashlib.sha256(), "any": False} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    held[c] += row[c]
                if row["turns"]:
                    held["illegal"] += held["initial"] is not None and held["initial"] + row["first_initial"] not in ("su", "ua", "au")
                    held["initial"] = row["last_initial"]
                if row["least_turn"] is not None:  # blocks are in the order of turns
                    held["numbers"] += row["numbers"] - (held["most"] == row["least_turn"])
                    held["least"] = row["least_turn"] if held["least"] is None else held["least"]
                    held["most"] = row["most_turn"]
                held["audit"].append("".join(e["edit"] for e in row["edits"]))
                for e in row["edits"]:
                    if e["edit"] != "D":
                        held["sha"].update(("\n" * held["any"] + e["role"] + ":" + e["text"]).encode())
                        held["any"] = True
        if held:
            yield out()

    schema = StructType([repaired.schema["conv"], *StructType.fromDDL(_DIGEST).fields])
    parted = repaired.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return one.select(*schema.fieldNames()).unionByName(parted.mapInArrow(shared.lean(run), schema))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with the query's faults: (conv_id, turn, role, text, copies), rows that are dropped with none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return turns.select(
        "conv_id",
        "turn",
        F.when(what == 4, "user").otherwise(text("role")).alias("role"),
        F.when(what.isin(0, 1), "").when(what == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(repair(damaged(turns), copies_col="copies")).withColumnRenamed("conv", "conv_id")


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), key AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i]))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS w
  FROM key, tab
), dmg AS (
  SELECT conv_id, turn, CASE WHEN w = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN w = 1 THEN '' WHEN w = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN w = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE w <> 0
), num AS (
  SELECT *, substr(role, 1, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM dmg
), flt AS (
  SELECT *, lead(x) OVER (PARTITION BY conv_id ORDER BY pos) AS after, count(*) OVER (PARTITION BY conv_id) AS size,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '-' ELSE 't' END AS f FROM num
), v AS (
  SELECT conv_id, size + 1 AS pos, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS v0, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} AS v1,
         {'c': 2, 'a': 'I', 'r': ['assistant:']} AS v2, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS v3
  FROM (SELECT DISTINCT conv_id, size FROM flt)
  UNION ALL
  SELECT conv_id, pos,
         list_min([w0, {'c': 2 + z2.c, 'a': 'I' || z2.a, 'r': list_prepend('user:', z2.r)}]), list_min([w1, {'c': 2 + z2.c, 'a': 'I' || z2.a, 'r': list_prepend('user:', z2.r)}]), z2, z3
  FROM (
    SELECT *, list_min([w2, {'c': 2 + w3.c, 'a': 'I' || w3.a, 'r': list_prepend('assistant:', w3.r)}]) AS z2,
           list_min([w3, {'c': 2 + w2.c, 'a': 'I' || w2.a, 'r': list_prepend('user:', w2.r)}]) AS z3
    FROM (
      SELECT v.conv_id, flt.pos,
             list_min([{'c': 3 + v0.c, 'a': 'D' || v0.a, 'r': v0.r}, {'c': CASE WHEN go THEN 999999 ELSE 2 + m + v2.c END, 'a': 'R' || v2.a, 'r': list_prepend('user:' || text, v2.r)},
                       {'c': CASE WHEN go OR x <> 'u' THEN 999999 ELSE m + v2.c END, 'a': 'K' || v2.a, 'r': list_prepend(line, v2.r)},
                       {'c': CASE WHEN go OR x <> 's' THEN 999999 ELSE m + v1.c END, 'a': 'K' || v1.a, 'r': list_prepend(line, v1.r)}]) AS w0,
             list_min([{'c': 3 + v1.c, 'a': 'D' || v1.a, 'r': v1.r}, {'c': CASE WHEN go THEN 999999 ELSE 2 + m + v2.c END, 'a': 'R' || v2.a, 'r': list_prepend('user:' || text, v2.r)},
                       {'c': CASE WHEN go OR x <> 'u' THEN 999999 ELSE m + v2.c END, 'a': 'K' || v2.a, 'r': list_prepend(line, v2.r)}]) AS w1,
             list_min([{'c': 3 + v2.c, 'a': 'D' || v2.a, 'r': v2.r}, {'c': CASE WHEN go THEN 999999 ELSE 2 + m + v3.c END, 'a': 'R' || v3.a, 'r': list_prepend('assistant:' || text, v3.r)},
                       {'c': CASE WHEN go OR x <> 'a' THEN 999999 ELSE m + v3.c END, 'a': 'K' || v3.a, 'r': list_prepend(line, v3.r)}]) AS w2,
             list_min([{'c': 3 + v3.c, 'a': 'D' || v3.a, 'r': v3.r}, {'c': CASE WHEN go THEN 999999 ELSE 2 + m + v2.c END, 'a': 'R' || v2.a, 'r': list_prepend('user:' || text, v2.r)},
                       {'c': CASE WHEN go OR x <> 'u' THEN 999999 ELSE m + v2.c END, 'a': 'K' || v2.a, 'r': list_prepend(line, v2.r)}]) AS w3
      FROM v JOIN (SELECT *, f IN ('b', 'd') AS go, CASE WHEN f = 't' THEN 1 ELSE 0 END AS m, role || ':' || text AS line FROM flt) AS flt
        ON flt.conv_id IS NOT DISTINCT FROM v.conv_id AND flt.pos = v.pos - 1
    )
  )
), cnt AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (after IS NOT NULL AND x || after NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id
), res AS (
  SELECT cnt.*, v0.c::BIGINT AS cost, v0.a AS audit, sha256(array_to_string(v0.r, chr(10))) AS repaired_sha256
  FROM cnt JOIN v ON v.conv_id IS NOT DISTINCT FROM cnt.conv_id AND v.pos = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN res ON res.conv_id IS NOT DISTINCT FROM o.conv_id
"""
