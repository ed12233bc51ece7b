"""Repair of damaged conversations: cheapest edits to an alternating exchange, streamed turn by turn.

Rows are dealt out by conversation once and sorted by turn within their partition. Two passes with mapInPandas go over
each conversation and carry the state of a dynamic program across Arrow batches:

* backwards, it holds the least cost of repairing the rest of the conversation from each of the four states that an
  exchange can be in (nothing yet, after a system turn, after a user turn, after an assistant turn), and leaves every
  row the costs behind it, as differences that fit into two bytes;
* forwards, it holds the state reached and takes at each row the ASCII-least edit that keeps the cost least.

The differences are the compact backpointers. They travel as a column through Spark's own sort, which spills to disk
what doesn't fit, so a giant conversation needs no more memory in a task than a short one, but for the line
of its edits that is the result. A conversation stays in one task: its rows are streamed, never gathered.

Edits: Keep a row as it is, Rerole it to user or assistant, Delete it, Insert an empty turn of user or assistant. The
roles' initials have to read (s?(ua)+)?. Since every initial leads to one state only, a string of edits fixes the repair.

Results by case: null roles and texts count as one space, also in the key that damages rows; rows with a null turn come
first; rows of the same turn are taken by role and text; repeated rows are duplicates; null conversation ids form one
conversation; a conversation without rows has zeros, an empty audit and the hash of nothing; further columns don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

# Costs of the edits and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
# States: nothing yet, after s, after u, after a; each with the initials that may follow.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
# The initial of the turn that a rerole or an insertion adds in each state.
ADDS = ("u", "u", "a", "u")
ENDS = (START, AFTER_A)
# Faults of a row.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
NEVER = 1 << 40
# Differences between the costs of two states stay below this.
STEP = 16


def damage(df: DataFrame) -> DataFrame:
    """Rows with dropped (boolean) after what crc32 of `conv_id:turn` does to them; a repeated row stands twice."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(draw == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), (draw == 0).alias("dropped"), draw.alias("draw"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows dealt out by conversation, each with its place among equal turns and its first fault."""
    dealt = rows.repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(earlier)
    last = F.right(F.btrim(F.col("text"), F.lit("\t\n\x0b\x0c\r ")), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    return dealt.withColumn("again", again).withColumn("fault", fault)


def _inserted(costs: list[int]) -> list[int]:
    """Least costs from each state when turns may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s][ADDS[s]]]) for s, c in enumerate(costs)]
    return costs


def _options(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state, ASCII-least first: letter, cost, state after it."""
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial in NEXT[state]:
            found.append(("K", more, NEXT[state][initial]))
        found.append(("R", REROLE + more, NEXT[state][ADDS[state]]))
    return found


_END = _inserted([0 if s in ENDS else NEVER for s in range(4)])


def _before(costs: list[int], initial: str, fault: int) -> list[int]:
    """Costs in front of a row from the costs behind it."""
    return _inserted([min(c + costs[to] for _, c, to in _options(s, initial, fault)) for s in range(4)])


def _packed(costs: list[int]) -> int:
    """Costs as differences to the least one, four bits each."""
    least = min(costs)
    return sum((c - least) * STEP**s for s, c in enumerate(costs))


def _unpacked(code: int) -> list[int]:
    return [code // STEP**s % STEP for s in range(4)]


def _backwards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds to every row the packed costs behind it; rows come last turn first. The state outlives the batches."""
    current, costs, steps = None, _END, {}
    for pdf in parts:
        behind = np.empty(len(pdf), dtype=np.int32)
        columns = (pdf["conv"].tolist(), pdf["role"].tolist(), pdf["fault"].tolist(), pdf["dropped"].tolist())
        for i, (conv, role, fault, dropped) in enumerate(zip(*columns, strict=True)):
            if conv != current:
                current, costs = conv, _END
            code = _packed(costs)
            behind[i] = code
            if not dropped:
                key = code, role[:1] if role[:1] in "sua" else "", fault
                if key not in steps:  # costs only matter by their differences: the table stays small
                    steps[key] = _before(_unpacked(code), *key[1:])
                costs = steps[key]
        yield pdf.assign(behind=behind)


class _Repair:
    """One conversation going forwards."""

    def __init__(self, conv_id: object):
        self.conv_id, self.state, self.cost, self.audit = conv_id, START, 0, []
        self.counts = [0, 0, 0, 0]
        self.turns, self.first, self.last, self.illegal, self.previous = 0, None, None, 0, None
        self.hash, self.any = hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        initial = ADDS[self.state]
        self.audit.append("I")
        self.cost += INSERT
        self.state = NEXT[self.state][initial]
        self.say(ROLES[initial], "")

    def row(self, turn: int | None, role: str, text: str, fault: int, behind: list[int]) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        initial = role[:1]
        self.illegal += self.previous is not None and self.previous + initial not in ("su", "ua", "au")
        self.previous = initial
        self.counts[fault] += 1
        best = _before(behind, initial, fault)
        while True:  # D is less than I, I less than K and R
            fits = [(letter, cost, to) for letter, cost, to in _options(self.state, initial, fault) if cost + behind[to] == best[self.state]]
            if fits and fits[0][0] == "D" or not (INSERT + best[NEXT[self.state][ADDS[self.state]]] == best[self.state]):
                letter, cost, to = fits[0]
                break
            self.insert()
        self.audit.append(letter)
        self.cost += cost
        if letter == "K":
            self.say(role, text)
        elif letter == "R":
            self.say(ROLES[ADDS[self.state]], text)
        self.state = to

    def result(self) -> tuple:
        while self.state not in ENDS:
            self.insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        _, blank, duplicate, truncated = self.counts
        return self.conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _forwards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation; rows come first turn first. The state outlives the batches."""
    current, repair = None, None
    for pdf in parts:
        done = []
        names = ("conv", "conv_id", "turn", "role", "text", "fault", "dropped", "behind")
        columns = [[None if pd.isna(v) else v for v in pdf[n].tolist()] if n in ("conv_id", "turn") else pdf[n].tolist() for n in names]
        for conv, conv_id, turn, role, text, fault, dropped, behind in zip(*columns, strict=True):
            if repair is None or conv != current:
                if repair is not None:
                    done.append(repair.result())
                current, repair = conv, _Repair(conv_id)
            if not dropped:
                repair.row(None if turn is None else int(turn), role, text, fault, _unpacked(behind))
        if done:
            yield pd.DataFrame(done, columns=RESULT)
    if repair is not None:
        yield pd.DataFrame([repair.result()], columns=RESULT)


def _sorted(rows: DataFrame, back: bool) -> DataFrame:
    keys = [F.col(c) for c in ("turn", "role", "text", "again")]
    order = [k.desc_nulls_last() if back else k.asc_nulls_first() for k in keys]
    return rows.sortWithinPartitions("conv", *order)


def repair(damaged: DataFrame) -> DataFrame:
    """One row for each conversation of a table of damage(): its faults, the cost and line of the cheapest edits, and
    the hash of the repaired turns."""
    rows = faults(damaged)
    # Also null ids have a name of their own to sort by.
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "*")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in rows.columns)
    with_costs = _sorted(rows, True).mapInPandas(_backwards, f"{schema}, behind int")
    counts = ", ".join(f"{c} long" for c in RESULT[1:7])
    return _sorted(with_costs, False).mapInPandas(_forwards, f"conv_id {types['conv_id']}, {counts}, audit string, repaired_sha256 string")
