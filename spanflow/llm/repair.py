"""Repair of the turn structure of conversations by an auction for shortest paths.

A conversation's rows and the roles that may follow each other span a lattice: a node is (rows consumed, state of the role
pattern), an arc an edit with an integer cost. Every node has a price; a path from a node is extended along the arc that
attains the least cost plus price, and contracted where the price of its last node lies below that, after the price was
raised to it. Nodes start paths from the last row to the first and a path ends at a node whose way to the end is known,
so that the prices converge in a number of steps proportional to the rows. Arcs whose cost equals the difference of the
prices are tight; of the tight ways to the end the one with the ASCII-least letters is traced.

Rows are dealt by ranges of (conv_id, turn, ...) and written; a block is what a partition holds of a conversation, so no
task needs a whole one. A conversation that lies in several blocks is solved in three passes: each block gives the costs
between its border states, the borders' prices are added up from the last block to the first, and each block is traced
for every state it may be entered in. Repeats are found by a join with the first place of each (role, text). Only the
final digest is taken over a whole conversation, by a task that reads its rows one by one.

Defined cases: null texts and roles are one space, a null conv_id is a conversation of its own and is written as one
space where its damage is drawn, as is a null turn; rows of equal turn are ordered by role and text; repeated rows are
damaged alike, each for itself; an empty table gives an empty result; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Costs of the edits, and the blank characters.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK = r"\x20\x09-\x0D"
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a. By letter, the state that follows, or -1.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
AFTER = {"s": (AFTER_S, -1, -1, -1), "u": (AFTER_U, AFTER_U, -1, AFTER_U), "a": (-1, -1, AFTER_A, -1)}
#: Where an inserted or reroled turn leads from each state, and which role it takes.
NEXT, ROLE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U), ("user", "user", "assistant", "user")
FINAL = (START, AFTER_A)
FAR = 1 << 60


def arcs_of(codes: str) -> list[list[tuple[str, int, int]]]:
    """Edits of each node as (letter, cost, target) with the letters in ASCII order; node 4 * i + q for i rows consumed in
    state q. codes: two characters a row, its role's initial and its fault (b and d must go, t costs more to keep, - none)."""
    n = len(codes) // 2
    out: list[list[tuple[str, int, int]]] = []
    for i in range(n + 1):
        for q in range(4):
            arcs = [("I", INSERT, 4 * i + NEXT[q])]
            if i < n:
                initial, fault = codes[2 * i], codes[2 * i + 1]
                arcs.insert(0, ("D", DELETE, 4 * i + 4 + q))
                if fault in "t-":
                    more = TRUNCATED * (fault == "t")
                    if (r := AFTER.get(initial, (-1,) * 4)[q]) >= 0:
                        arcs.append(("K", more, 4 * i + 4 + r))
                    arcs.append(("R", REROLE + more, 4 * i + 4 + NEXT[q]))
            out.append(arcs)
    return out


def auction(arcs: list[list[tuple[str, int, int]]], ends: tuple) -> list[int]:
    """Prices of all nodes: the least cost from each to the end, to which the last four nodes have arcs of costs `ends`
    (FAR: none), or FAR where no way leads there. A path starts at every node in turn, from the last row to the first."""
    n = len(arcs)
    close = {n - 4 + q: c for q, c in enumerate(ends) if c < FAR}
    price, known = [0] * n, [False] * n
    able = [i in close for i in range(n)]
    for row in range(n - 4, -1, -4):
        for _ in range(3):  # inserted turns lead from any state to any that they can reach in two steps
            for i in range(row, row + 4):
                able[i] = able[i] or any(able[j] for _, _, j in arcs[i])
        for origin in range(row, row + 4):
            if not able[origin]:
                price[origin], known[origin] = FAR, True
        for origin in range(row, row + 4):
            path = [origin]
            while not known[origin]:
                i = path[-1]
                best, to = close.get(i, FAR), -1
                for _, cost, j in arcs[i]:
                    if cost + price[j] < best:
                        best, to = cost + price[j], j
                if price[i] < best:  # contraction
                    price[i] = best
                    if len(path) > 1:
                        path.pop()
                elif to < 0 or known[to]:  # all of the path is tight, and so is the rest of the way
                    for i in path:
                        known[i] = True
                else:  # extension
                    path.append(to)
    return price


def trace(arcs: list[list[tuple[str, int, int]]], price: list[int], ends: tuple, entry: int) -> tuple[str, int]:
    """The ASCII-least letters of the tight ways from an entry state to the end, and the state in which the last row is left."""
    n = len(arcs)
    done = [i >= n - 4 and price[i] < FAR and price[i] == ends[i - n + 4] for i in range(n)]
    reach = [False] * n  # the end, by tight arcs alone
    for row in range(n - 4, -1, -4):
        for i in sorted(range(row, row + 4), key=price.__getitem__):  # a tight inserted turn leads to a lower price
            reach[i] = done[i] or any(price[i] == cost + price[j] and reach[j] for _, cost, j in arcs[i])
    out, i = [], entry
    while not done[i]:
        letter, i = next((letter, j) for letter, cost, j in arcs[i] if price[i] == cost + price[j] and reach[j])
        out.append(letter)
    return "".join(out), i - (n - 4)


CLOSED = tuple(0 if q in FINAL else FAR for q in range(4))


def solve(codes: str, ends: tuple = CLOSED) -> tuple[list, list[int]]:
    arcs = arcs_of(codes)
    return arcs, auction(arcs, ends)


def border_costs(codes: str) -> list[int]:
    """Least costs from each entry state (rows) to each exit state (columns) of a block."""
    by_exit = [solve(codes, tuple(0 if k == q else FAR for k in range(4)))[1][:4] for q in range(4)]
    return np.array(by_exit).T.reshape(-1).tolist()


def _key() -> Column:
    """conv_id as text that no null makes null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy after the faults that crc32 of `conv_id:turn` deals out; conv is conv_id as text."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    rows = conversations.select(_key().alias("conv"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, copy) in order, dealt by ranges and written, with `at`, which rises in this order,
    block, the role's initial, the fault that a row has by itself and the digest of role and text."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    # the borders of the ranges go through the driver, so they hold the beginnings of texts only
    dealt = rows.repartitionByRange(*order[:3], F.substring("text", 1, 32)).sortWithinPartitions(*order)
    initial = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(f"[^{BLANK}]"), "b").when(~F.col("text").rlike(rf"[.!?][{BLANK}]*\z"), "t").otherwise("-")
    placed = dealt.withColumn("at", F.monotonically_increasing_id()).withColumns({
        "block": F.shiftright("at", 33),
        "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("-"),
        "fault": fault,
        "same": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)),
    })
    return materialise(placed)


def coded(rows: DataFrame) -> DataFrame:
    """conv, block, at, turn, initial, fault of every row, now with the repeats (d) of an earlier row that isn't blank."""
    first = rows.groupBy("conv", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    slim = rows.select("conv", "block", "at", "turn", "initial", "fault", "same").join(first, ["conv", "same"], "left")
    repeat = (F.col("at") > F.col("first")) & (F.col("fault") != "b")
    return slim.select("conv", "block", "at", "turn", "initial", F.when(repeat, "d").otherwise(F.col("fault")).alias("fault"))


def edits(blocks: DataFrame) -> DataFrame:
    """conv, block, audit, entry (the state in which the block is entered) and cost (of the edits of the block and all after
    it) of blocks (conv, block, codes)."""
    counted = blocks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv")))

    def alone(frames):
        known: dict[str, tuple] = {}
        for pdf in frames:
            if len(known) > 100_000:
                known.clear()
            for codes in {*pdf["codes"]} - {*known}:
                arcs, price = solve(codes)
                known[codes] = (trace(arcs, price, CLOSED, START)[0], price[START])
            rows = [known[codes] for codes in pdf["codes"]]
            yield pdf[["conv", "block"]].assign(audit=[r[0] for r in rows], entry=np.int32(START), cost=np.array([r[1] for r in rows], np.int64))

    def borders(frames):
        for pdf in frames:
            yield pdf[["conv", "block"]].assign(costs=[border_costs(c) for c in pdf["codes"]])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """The costs from each state at the end of a block to the end of all; at most a block for each partition."""
        pdf = pdf.sort_values("block")
        ends, out = np.array(CLOSED), []
        for costs in pdf["costs"].tolist()[::-1]:
            out.append(ends.tolist())
            ends = np.minimum((np.asarray(costs).reshape(4, 4) + ends[None, :]).min(1), FAR)
        return pdf[["conv", "block"]].assign(ends=out[::-1])

    def ways(frames):
        """Letters, exit state and cost for every entry state of a block."""
        for pdf in frames:
            rows: list[tuple] = []
            for conv, block, codes, ends in zip(pdf["conv"], pdf["block"], pdf["codes"], pdf["ends"], strict=True):
                ends = tuple(int(x) for x in ends)
                arcs, price = solve(codes, ends)
                for q in range(4):
                    audit, left = trace(arcs, price, ends, q) if price[q] < FAR else ("", -1)
                    rows.append((conv, block, q, audit, left, price[q]))
            yield pd.DataFrame(rows, columns=["conv", "block", "entry", "audit", "leaves", "cost"])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        """The entry state of each block, from the first on."""
        leads = {(r.block, r.entry): r.leaves for r in pdf.itertuples()}
        out, q = [], START
        for block in sorted({b for b, _ in leads}):
            out.append((pdf["conv"].iloc[0], block, q))
            q = leads[block, q]
        return pd.DataFrame(out, columns=["conv", "block", "entry"])

    done = counted.where("n = 1").select("conv", "block", "codes").mapInPandas(alone, "conv string, block bigint, audit string, entry int, cost bigint")
    long = counted.where("n > 1").select("conv", "block", "codes")
    ends = long.mapInPandas(borders, "conv string, block bigint, costs array<bigint>").groupBy("conv").applyInPandas(chain, "conv string, block bigint, ends array<bigint>")
    every = materialise(long.join(ends, ["conv", "block"]).mapInPandas(ways, "conv string, block bigint, entry int, audit string, leaves int, cost bigint"))
    entered = every.select("conv", "block", "entry", "leaves").groupBy("conv").applyInPandas(follow, "conv string, block bigint, entry int")
    return done.unionByName(every.join(entered, ["conv", "block", "entry"]).select("conv", "block", "audit", "entry", "cost"))


class Turns:
    """The turns that a block's edits leave, row by row."""

    def __init__(self, audit: str = "", state: int = START):
        self.audit, self.state, self.at = audit, state, 0

    def inserted(self) -> list[str]:
        """The turns inserted here."""
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            out.append(f"{ROLE[self.state]}:")
            self.state, self.at = NEXT[self.state], self.at + 1
        return out

    def row(self, role: str, text: str) -> list[str]:
        """The turns inserted before the next row, and what is left of it."""
        out, letter = self.inserted(), self.audit[self.at]
        if letter == "K":
            out.append(f"{role}:{text}")
            self.state = AFTER[role[0]][self.state]
        elif letter == "R":
            out.append(f"{ROLE[self.state]}:{text}")
            self.state = NEXT[self.state]
        self.at += 1
        return out


def repaired(rows: DataFrame, solved: DataFrame, result, kind: str) -> DataFrame:
    """conv and what `result` makes of each repaired conversation: an object with add(line) and done(). A task reads a
    conversation's rows one by one, each block's edits before its rows."""
    none = F.lit(None)
    heads = solved.select("conv", (F.shiftleft("block", 33) - 1).alias("at"), none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", "entry")
    body = rows.select("conv", "at", "role", "text", none.cast("string").alias("audit"), F.lit(-1).alias("entry"))
    both = heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "at")

    def run(frames):
        last, turns, made = None, Turns(), None
        for pdf in frames:
            out = []
            for conv, role, text, audit, entry in zip(pdf["conv"], pdf["role"], pdf["text"], pdf["audit"], pdf["entry"], strict=True):
                if conv != last or entry >= 0:
                    for line in turns.inserted():
                        made.add(line)
                if conv != last:
                    if last is not None:
                        out.append((last, made.done()))
                    last, made = conv, result()
                if entry >= 0:
                    turns = Turns(audit, entry)
                else:
                    for line in turns.row(role, text):
                        made.add(line)
            yield pd.DataFrame(out, columns=["conv", "made"])
        if last is not None:
            for line in turns.inserted():
                made.add(line)
            yield pd.DataFrame([(last, made.done())], columns=["conv", "made"])

    return both.drop("at").mapInPandas(run, f"conv string, made {kind}")


class Digest:
    """SHA-256 of lines joined by line feeds."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, line: str) -> None:
        self.sha.update(line.encode() if self.empty else b"\n" + line.encode())
        self.empty = False

    def done(self) -> str:
        return self.sha.hexdigest()


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage()."""
    rows = in_blocks(damage(conversations))
    codes = materialise(coded(rows))
    named = lambda name, *c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(name, F.concat(*c).alias("c")))), lambda x: x["c"]), "")
    blocks = materialise(codes.groupBy("conv", "block").agg(named("at", "initial", "fault").alias("codes"), named("at", "initial").alias("initials")))
    solved = materialise(edits(blocks.select("conv", "block", "codes")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = codes.groupBy("conv").agg(zero(gaps).alias("gaps"), *(F.count_if(F.col("fault") == k).alias(n) for k, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
    pairs = blocks.groupBy("conv").agg(named("block", "initials").alias("initials"))
    illegal = pairs.select("conv", (F.length("initials") - 1 - F.regexp_count("initials", F.lit("s(?=u)|u(?=a)|a(?=u)"))).cast("long").alias("illegal"))
    total = solved.groupBy("conv").agg(F.min(F.struct("block", "cost"))["cost"].alias("cost"), named("block", "audit").alias("audit"))
    digests = repaired(rows, solved, Digest, "string").withColumnRenamed("made", "repaired_sha256")
    found = counts.join(illegal, "conv").join(total, "conv").join(digests, "conv")
    all_ids = conversations.select("conv_id", _key().alias("conv")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    done = all_ids.join(found, "conv", "left").select("conv_id", *(zero(F.col(c)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    done = materialise(done)
    discard(rows, codes, blocks, solved)
    return done
