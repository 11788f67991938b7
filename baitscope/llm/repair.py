"""Operator 13: conversation structure repair by prefix-doubling path ranking.

A conversation is repaired by edits of its rows so that its role initials read
``(s?(ua)+)?``.  Keep costs 0, Rerole to user or assistant 2, Delete 3 (a blank
or duplicate row has no other way), Insert an empty user or assistant 2; a
truncated row that is not deleted adds 1.

The cost DP runs over nodes (rows left, state) from the end, for all
conversations of a batch at once.  The arcs of cheapest paths are kept.  Nodes
are then ranked by their least audits of 1, 2, 4, ... edits: the rank of
length 2n is that of the pair (rank of length n, rank of length n of the node n
edits on), and the pointer n edits on is doubled with it.  Audits are read by
following the bits of each place through the doubled pointers.  (A state admits
one role for Insert and Rerole, so the labels of a node's arcs differ and its
least arc is known at the first length.)

A conversation that lies in several tasks is repaired in blocks: the cheapest
costs of a block between all states make a 4 x 4 table; tables compose from the
end to the costs after each block; with these each block finds its audit from
every entry state, and the true entry states follow from the start.  Rows seen
in an earlier block are found by a join on 128-bit hashes of role and text, one
row a task and text.

Edge cases: null texts and roles count as one space each, so a null text is
blank and a null role is illegal and may be reroled or deleted; null turns come
first; rows of one turn go by role, then by MD5 of the text; a null conv_id is
a conversation.  An empty table gives an empty table.  Other columns, also of
the operator's own names, are left out.  A very long text is one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import stored
from baitscope.llm.turns import batched, blocks, in_order, rows_of, runs

#: Edits in the order of their initials.
EDITS = "DIKR"
D, I, K, R = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, by state; a user turn leads to USER, an assistant turn to ASSISTANT.
GIVEN = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept turn, by state and initial (s, u, a, other); -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Inserts that end a conversation, by state.
TAIL = np.array([0, 2, 1, 0])
FINE, CUT, GONE = range(3)
NEVER = 1 << 40
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"


class Paths:
    """Cheapest repairs of several row sequences, laid out one after the other.

    ``code`` (initial) and ``fault`` have one entry a row, ``sizes`` one a
    sequence, ``after`` four a sequence: the cost to go from each state past its
    last row.  Node of row r of sequence b in state q: ``(start of b + r) * 4 + q``.
    """

    def __init__(self, sizes: np.ndarray, code: np.ndarray, fault: np.ndarray, after: np.ndarray) -> None:
        self.sizes = sizes
        ends = np.cumsum(sizes)
        first = ends - sizes
        self.starts = first + np.arange(len(sizes))
        places = len(code) + len(sizes)
        self.label = np.zeros((places, 4), np.int8)
        self.next = np.arange(places * 4).reshape(places, 4)
        order = np.argsort(-sizes, kind="stable")
        by_size = sizes[order]
        cost = after[order].astype(np.int64)
        states = np.arange(4)
        for t in range(int(by_size[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-by_size, -t, side="left"))  # sequences with more than t rows
            row = (ends[order[:n]] - 1 - t)
            node = row + order[:n]
            f, c, old = fault[row][:, None], KEPT[:, code[row]].T, cost[:n]
            given = old[:, GIVEN]
            dele = old + DELETE
            keep = np.where((c >= 0) & (f < GONE), np.take_along_axis(old, np.maximum(c, 0), 1) + f * TRUNCATED, NEVER)
            turn = np.where(f < GONE, given + REROLE + f * TRUNCATED, NEVER)
            best = np.minimum(np.minimum(dele, keep), turn)
            step = np.minimum(best, INSERT + best[:, GIVEN])
            new = np.minimum(best, INSERT + step[:, GIVEN])
            label = np.where(dele == new, D, np.where(INSERT + new[:, GIVEN] == new, I, np.where(keep == new, K, R)))
            self.label[node] = label
            state = np.where(label == D, states, np.where(label == K, c, GIVEN))
            self.next[node] = (node[:, None] + (label != I)) * 4 + state
            cost[:n] = new
        self.cost = np.empty_like(cost)
        self.cost[order] = cost
        self._double()

    def _double(self) -> None:
        """Doubled pointers, audit lengths, and the rank of every node by its least audit."""
        pointer = self.next.ravel()
        here = np.arange(len(pointer))
        moving = pointer != here
        self.length = moving.astype(np.int64)
        self.rank = np.where(moving, self.label.ravel().astype(np.int64) + 1, 0)
        self.pointers = []
        while (pointer != here).any():
            self.pointers.append(pointer)
            further = pointer[pointer]
            if (further == pointer).all():
                break
            pair = self.rank * (len(here) + 5) + self.rank[pointer]
            self.rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
            self.length = self.length + self.length[pointer]
            pointer = further

    def audits(self, state: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Audit of each sequence from its first row in the given state, and the state past its last row."""
        node = self.starts * 4 + state
        n = self.length[node]
        total = int(n.sum())
        place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(node, n)
        end = node.copy()
        for bit, pointer in enumerate(self.pointers):
            at = np.where(place >> bit & 1, pointer[at], at)
            end = np.where(n >> bit & 1, pointer[end], end)
        letters = np.frombuffer(EDITS.encode(), np.uint8)[self.label.ravel()[at]].tobytes().decode()
        cuts = [0, *np.cumsum(n).tolist()]
        return [letters[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], end & 3


def initial(role: str) -> int:
    return INITIALS.get(role[:1], 3)


def shape(text: str) -> int:
    """FINE, CUT (its last solid character ends no sentence) or GONE (blank)."""
    text = text.rstrip(WHITE)
    return GONE if not text else FINE if text[-1] in ".!?" else CUT


def replay(audit: str, state: int, rows: list[tuple[str, str]]) -> tuple[list[dict], int]:
    """The (role, text) turns that an audit makes of rows, and the state past them."""
    made, row = [], iter(rows)
    for edit in audit:
        if edit == "D":
            next(row)
            continue
        role, text = (None, "") if edit == "I" else next(row)
        if edit == "K":
            state = int(KEPT[state, initial(role)])
        else:
            state = int(GIVEN[state])
            role = "user" if state == USER else "assistant"
        made.append({"role": role, "text": text})
    return made, state


STATS = "n long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first string, last string, first_turn long, last_turn long"
FOUND = (f"conv_id long, block long, whole boolean, {STATS}, cost long, audit string, repaired array<struct<role: string, text: string>>, "
         "rows array<struct<role: string, text: string>>, fault array<int>, hashes array<binary>")
JUDGED = ("conv_id long, block long, blank long, duplicate long, truncated long, fault array<int>, code array<int>, costs array<long>")
REPAIRED = f"conv_id long, block long, whole boolean, {STATS}, cost long, audit string, repaired array<struct<role: string, text: string>>"
REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def judge(rows: list[tuple], seen: set) -> list[int]:
    """Fault of each (turn, role, text) row, with -1 for a duplicate; ``seen`` holds earlier rows of the conversation."""
    faults = []
    for _, role, text in rows:
        fault = shape(text)
        if fault != GONE:
            known = len(seen)
            seen.add((role, text) if len(text) < 64 else hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest())
            if len(seen) == known:
                fault = -1
        faults.append(fault)
    return faults


def statistics(rows: list[tuple], faults: list[int]) -> tuple:
    """The columns of STATS for one block."""
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(firsts[:-1], firsts[1:], strict=True))
    distinct = len(set(turns))
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return (len(rows), faults.count(GONE), faults.count(-1), faults.count(CUT), illegal, *ends, distinct, firsts[0], firsts[-1], *ends)


def find(rows: DataFrame) -> DataFrame:
    """Whole conversations repaired; blocks of the others with their rows, faults and hashes of rows new in their task."""
    rows = in_order(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text")))

    def solve(held: list[tuple]) -> Iterator[tuple[tuple, int]]:
        faults = np.array([f for _, _, _, fs in held for f in fs])
        code = np.array([initial(r) for _, _, rs, _ in held for _, r, _ in rs])
        sizes = np.array([len(rs) for _, _, rs, _ in held])
        paths = Paths(sizes, code, np.where(faults == -1, GONE, faults), np.tile(TAIL * INSERT, (len(held), 1)))
        audits, ends = paths.audits(np.zeros(len(held), np.int64))
        for (conv, block, rs, fs), cost, audit, end in zip(held, paths.cost[:, NOTHING].tolist(), audits, ends.tolist(), strict=True):
            audit += "I" * int(TAIL[end])
            made, _ = replay(audit, NOTHING, [r[1:] for r in rs])
            yield ((conv, block, True, *statistics(rs, fs), cost, audit, made, None, None, None), sum(len(t) for _, _, t in rs))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        held, chars, before, seen = [], 0, None, set()
        for conv, block, whole, rs in blocks(batches, ["turn", "role", "text"]):
            if before is None or before != (conv,):
                before, seen = (conv,), set()
            faults = judge(rs, seen)
            size = sum(len(t) for _, _, t in rs)
            if whole:
                held.append((conv, block, rs, faults))
                chars += size + 200 * len(rs)
                if chars >= 1_000_000:
                    yield from solve(held)
                    held, chars = [], 0
                continue
            hashes = [None if f in (GONE, -1) else hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest()
                      for (_, r, t), f in zip(rs, faults, strict=True)]
            yield ((conv, block, False, *statistics(rs, faults), None, None, None, [{"role": r, "text": t} for _, r, t in rs], faults, hashes),
                   size + 60 * len(rs))
        if held:
            yield from solve(held)

    return batched(rows, FOUND, make)


def seen_before(parts: DataFrame) -> DataFrame:
    """(conv_id, block, places) of rows whose role and text an earlier task has for the conversation."""
    new = parts.select("conv_id", "block", F.posexplode("hashes").alias("place", "h")).where("h IS NOT NULL")
    first = new.groupBy("conv_id", "h").agg(F.min(F.struct("block", "place")).alias("at"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = first.select(F.col("conv_id").alias("conv"), F.col("h").alias("hash"), "at")
    later = new.join(first, new["conv_id"].eqNullSafe(first["conv"]) & (new["h"] == first["hash"])).where(F.struct("block", "place") > F.col("at"))
    return later.groupBy("conv_id", "block").agg(F.collect_list("place").alias("places"))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of block rows on their conversation and block; a null conv_id meets itself."""
    right = right.withColumnsRenamed({"conv_id": "conv_of", "block": "block_of"})
    on = left["conv_id"].eqNullSafe(right["conv_of"]) & (left["block"] == right["block_of"])
    return left.join(right, on, "left").drop("conv_of", "block_of")


def judged(parts: DataFrame) -> DataFrame:
    """Blocks with final faults, and the cheapest costs between all states."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for row in rows_of(batches):
            faults = list(row["fault"])
            for place in row["places"] or ():
                faults[place] = -1
            fault = np.array([GONE if f == -1 else f for f in faults])
            code = np.array([initial(r["role"]) for r in row["rows"]])
            after = np.where(np.eye(4, dtype=bool), 0, NEVER)
            paths = Paths(np.full(4, len(code)), np.tile(code, 4), np.tile(fault, 4), after)
            yield ((row["conv_id"], row["block"], faults.count(GONE), faults.count(-1), faults.count(CUT), fault.tolist(), code.tolist(),
                    np.minimum(paths.cost.T, NEVER).ravel().tolist()), 40 * len(code))

    return batched(beside(parts.select("conv_id", "block", "rows", "fault"), seen_before(parts)), JUDGED, make)


def costs_after(blocks_: DataFrame) -> DataFrame:
    """The cost to go from each state past each block, composed from the end of the conversation."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for first, _, row in runs(batches):
            after = TAIL * INSERT if first else after
            yield (row["conv_id"], row["block"], after.tolist(), first), 50
            after = (np.array(row["costs"]).reshape(4, 4) + after).min(axis=1)

    ordered = blocks_.select("conv_id", "block", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    return batched(ordered, "conv_id long, block long, after array<long>, final boolean", make)


def block_audits(blocks_: DataFrame, after: DataFrame) -> DataFrame:
    """Audits and exit states of each block, by entry state."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for row in rows_of(batches):
            n = len(row["code"])
            paths = Paths(np.array([n]), np.array(row["code"]), np.array(row["fault"]), np.array([row["after"]]))
            found = [paths.audits(np.array([q])) for q in range(4)]
            yield ((row["conv_id"], row["block"], row["final"], [a[0] for a, _ in found], [int(e[0]) for _, e in found],
                    paths.cost[0].tolist()), 5 * n)

    wide = beside(blocks_.select("conv_id", "block", "code", "fault"), after)
    return batched(wide, "conv_id long, block long, final boolean, audits array<string>, ends array<int>, costs array<long>", make)


def entries(audits: DataFrame) -> DataFrame:
    """The state in which the cheapest, least path enters each block, and the conversation's cost at its first block (else 0)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for first, _, row in runs(batches):
            state = NOTHING if first else state
            yield (row["conv_id"], row["block"], state, row["costs"][NOTHING] if first else 0), 50
            state = row["ends"][state]

    ordered = audits.select("conv_id", "block", "ends", "costs").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return batched(ordered, "conv_id long, block long, entry int, cost long", make)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired blocks of conversations (conv_id, turn, role, text), as written: counts, cost, audit and repaired turns.

    ``whole`` rows are conversations; the blocks of others follow each other by ``block``, with the cost on the first.
    """
    found = stored(find(rows), "repair-found")
    parts = found.where("not whole")
    faults = stored(judged(parts), "repair-judged")
    audits = stored(block_audits(faults, costs_after(faults)), "repair-audits")
    chosen = beside(audits.select("conv_id", "block", "audits", "final"), entries(audits))
    chosen = chosen.select("conv_id", "block", "entry", "cost", "final", F.element_at("audits", F.col("entry") + 1).alias("audit"))
    wide = beside(beside(parts.drop("blank", "duplicate", "truncated", "cost", "audit"), faults.select("conv_id", "block", "blank", "duplicate", "truncated")), chosen)
    names = [f.split()[0] for f in STATS.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for row in rows_of(batches):
            turns = [(r["role"], r["text"]) for r in row["rows"]]
            made, end = replay(row["audit"], row["entry"], turns)
            tail = "I" * int(TAIL[end]) if row["final"] else ""
            made += replay(tail, end, [])[0]
            yield ((row["conv_id"], row["block"], False, *(row[c] for c in names), row["cost"], row["audit"] + tail, made),
                   sum(len(t) for _, t in turns))

    split = batched(wide.select("conv_id", "block", "rows", "audit", "entry", "cost", "final", *names), REPAIRED, make)
    return found.where("whole").drop("rows", "fault", "hashes").unionByName(split)


def report(repaired: DataFrame) -> DataFrame:
    """One row per conversation with the digest of its repaired turns."""
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.where("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                           F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for first, last, row in runs(batches):
            if first:
                sums, audit, digest, role, turn, low, high, some = [0] * 6, [], hashlib.sha256(), None, None, None, None, False
            meets = role is not None and role + row["first"] not in LEGAL
            same = turn is not None and turn == row["first_turn"]
            now = (row["blank"], row["duplicate"], row["truncated"], row["illegal"] + meets, row["cost"], row["turns"] - same)
            sums = [a + b for a, b in zip(sums, now, strict=True)]
            audit.append(row["audit"])
            for t in row["repaired"]:
                digest.update((("\n" if some else "") + t["role"] + ":" + t["text"]).encode())
                some = True
            role, turn = row["last"], row["last_turn"] if row["last_turn"] is not None else turn
            low = row["low"] if low is None else low
            high = row["high"] if row["high"] is not None else high
            if last:
                blank, duplicate, truncated, illegal, cost, turns = sums
                yield ((row["conv_id"], 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, "".join(audit),
                        digest.hexdigest()), len(audit))

    split = repaired.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return whole.unionByName(batched(split, REPORT, make))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the crc32 of ``conv_id:turn`` modulo 20, nulls read as one space."""
    def read(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def repair_digests(rows: DataFrame) -> DataFrame:
    """Every conv_id of ``rows`` with the report of its damaged and repaired rows; all zeros if no row is left."""
    ids = rows.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    found = report(repair(damage(rows)))
    joined = ids.join(found, ids["conv"].eqNullSafe(found["conv_id"]), "left").drop("conv_id").withColumnRenamed("conv", "conv_id")
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("conv_id", *(F.coalesce(F.col(c), F.lit(v).cast("long") if v == 0 else F.lit(v)).alias(c) for c, v in empty.items()))
