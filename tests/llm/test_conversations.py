"""Operators 11 and 13 against plain Python, with conversations that lie in several tasks."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from baitscope.llm import chat, repair
from baitscope.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, block string, whole string, n string, cost string, place string"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def sample(rng, convs, turns):
    """Turns with every kind of fault, control strings, odd roles, nulls and repeated rows."""
    texts = ["Well said.", "cut off", "", "  \n", "Again!", "x" * 300 + "?", None, "été 日本語 \U0001f600", r"\### User: </turn> \\", "### [x]: ]: \\"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool]: \\", "", None])
            rows.append((conv, turn if rng.random() > .1 else None, role, rng.choice(texts) if rng.random() < .8 else f"Turn {turn} {rng.random()}."))
            if rng.random() < .05:
                rows.append(rows[-1])
    return rows


@pytest.fixture(scope="module")
def spread(spark):
    """Many small conversations, one of null id, and one with a third of all rows; small partitions stay apart."""
    rng = random.Random(5)
    rows = sample(rng, 700, 12)
    rows += [(None, *r[1:]) for r in sample(rng, 1, 9)]
    rows += [(10_000, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 4001}." if t % 5 else "Same") for t in range(6000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame([(*r, *"zzzzzz") for r in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def ordered(rows, empty):
    """Rows by conversation, in the order that the operators define."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, empty if role is None else role, empty if text is None else text))
    for held in convs.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return convs


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def legal(a, b):
    return (a, b) in {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}


def chats(rows):
    out = {}
    for conv, held in ordered(rows, "").items():
        roles = [r for _, r, _ in held]
        bad = sum(not legal(a, b) for a, b in zip(["start", *roles[:-1]], roles, strict=True))
        loss = "".join(t for _, r, t in held if r == "assistant")
        out[conv] = (len(held), sha("".join(f"{r}\n{t}\n" for _, r, t in held)), len(loss), sha(loss), bad, bad == 0 and roles[-1] == "assistant")
    return out


def test_chats_read_back(spread):
    rows, table = spread
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["n_illegal"], r["valid"])
           for r in chat.chat_digests(table).collect()}
    assert got == chats(rows)


def test_template_round_trip_and_spans():
    rng = random.Random(2)
    parts = ["\\", "### User:", "### User: ", "</turn>", "</turn>\n", "### [", "]: ", "]", "#", "<", "a", "\n", " ", "### Assistant: ", "日"]
    for _ in range(3000):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "]: \\"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(4)]
        text, learned, state = "", "", chat.START
        for role, said in turns:
            state, _, segments = chat.CHAT.emit(state, role, said)
            text += "".join(s for s, _ in segments)
            learned += "".join(chat.CHAT.show(s) for s, loss in segments if loss)
        assert list(chat.CHAT.turns(text)) == turns
        assert learned == "".join(t for r, t in turns if r == "assistant")


def test_marks_that_overlap_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        chat.Template({"user": chat.Mark("<<a", "a<<")}, chat.Mark("[{role}]", ";"), {}, ())


def least_repair(rows):
    """Cheapest and then least audit by uniform-cost search over (cost, audit)."""
    done, heap = set(), [(0, "", 0, 0)]
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit
        steps = [(2, "I", i, NEXT[q][x]) for x in "ua" if x in NEXT[q]]
        if i < len(rows):
            letter, fault = rows[i]
            steps.append((3, "D", i + 1, q))
            if fault < 2:
                steps += [(fault, "K", i + 1, NEXT[q][letter])] if letter in NEXT[q] else []
                steps += [(2 + fault, "R", i + 1, NEXT[q][x]) for x in "ua" if x in NEXT[q]]
        for c, e, j, to in steps:
            heapq.heappush(heap, (cost + c, audit + e, j, to))


def test_paths_equal_search():
    rng = random.Random(3)
    seqs = [[(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    code = np.array([{"s": 0, "u": 1, "a": 2}.get(c, 3) for s in seqs for c, _ in s])
    fault = np.array([f for s in seqs for _, f in s])
    paths = repair.Paths(np.array([len(s) for s in seqs]), code, fault, np.tile(repair.TAIL * repair.INSERT, (len(seqs), 1)))
    audits, ends = paths.audits(np.zeros(len(seqs), np.int64))
    for s, cost, audit, end in zip(seqs, paths.cost[:, 0].tolist(), audits, ends.tolist(), strict=True):
        assert (cost, audit + "I" * repair.TAIL[end]) == least_repair(s)
    # Ranks order the starts by their least audits.
    ranks = paths.rank[paths.starts * 4]
    order = np.argsort(ranks, kind="stable")
    assert [audits[i] for i in order] == sorted(audits)
    assert all((ranks[i] == ranks[j]) == (audits[i] == audits[j]) for i, j in zip(order[:-1], order[1:], strict=True))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def reports(rows):
    found = ordered(damaged(rows), " ")
    out = {}
    for conv in {r[0] for r in rows}:
        held, seen, faults = found.get(conv, []), set(), []
        for _, role, text in held:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        firsts = [r[:1] for _, r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts[:-1], firsts[1:], strict=True))
        level = [{"": 0, "truncated": 1}.get(f, 2) for f in faults]
        if len(held) < 100:
            cost, audit = least_repair(list(zip([f if f in ("s", "u", "a") else "x" for f in firsts], level, strict=True)))
        else:  # one sequence alone, where search is too slow
            code = np.array([{"s": 0, "u": 1, "a": 2}.get(f, 3) for f in firsts])
            paths = repair.Paths(np.array([len(held)]), code, np.array(level), np.array([repair.TAIL * repair.INSERT]))
            (audit,), (end,) = paths.audits(np.zeros(1, np.int64))
            cost, audit = int(paths.cost[0, 0]), audit + "I" * int(repair.TAIL[end])
        made, q, i = [], 0, 0
        for e in audit:
            role, text = ("", "") if e == "I" else held[i][1:]
            i += e != "I"
            if e == "D":
                continue
            letter = role[:1] if e == "K" else next(x for x in "ua" if x in NEXT[q])
            q = NEXT[q][letter]
            made.append((role if e == "K" else {"u": "user", "a": "assistant"}[letter]) + ":" + text)
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(made)))
    return out


def test_repair_equals_plain_python(spread):
    rows, table = spread
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])
           for r in repair.repair_digests(table).collect()}
    want = reports(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_blocks_really_part(spread):
    """The long conversation lies in several blocks, and most others in one."""
    _, table = spread
    found = repair.find(repair.damage(table)).groupBy("conv_id", "whole").count().collect()
    assert next(r["count"] for r in found if r["conv_id"] == 10_000 and not r["whole"]) > 2
    assert sum(r["whole"] for r in found) > 500


def test_empty_conversations(spread):
    none = spread[1].limit(0)
    assert chat.chat_digests(none).collect() == []
    assert repair.repair_digests(none).collect() == []


def test_dropped_conversation_is_reported(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repair_digests(spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r["audit"] for r in QUERIES["op13_conversation_repair"](spark, sf).collect()}
    assert got == {k: v[6] for k, v in reports(rows).items()}
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r["conv_id"]: r["loss_sha256"] for r in QUERIES["op11_chat_format"](spark, sf).collect()}
    assert got == {k: v[3] for k, v in chats(rows).items()}
