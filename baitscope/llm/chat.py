"""Operator 11: chat formatting by a finite-state machine over roles.

A declarative ``Template`` gives each role its marks and loss flag, and each
state the roles that may come next.  The machine reads a conversation turn by
turn, emits (text, loss) segments and counts turns that its state does not
allow; after such a turn it goes on from that turn's role, so no turn is lost.
The state after a turn is its role, so a block of turns is summed up by its
first and last role and its inner count, and blocks of a conversation that lies
in several tasks are judged where they meet.

Inside texts the escape character and every mark are preceded by the escape
character; ``read_back`` finds marks, undoes this, and takes the loss text from
the recorded spans alone.

Edge cases: a null text or role is empty; a role without a mark of its own is
written in the template's ``other`` mark; rows of one turn go by role, then by
MD5 of the text, and repeated rows are all formatted; a null conv_id is a
conversation; a null turn comes first.  An empty table gives an empty table.
Other columns, also of the operator's own names, are left out.  A very long
text is one block; a very long conversation is many.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import stored
from baitscope.llm.turns import batched, blocks, in_order, rows_of, runs

START = "start"


@dataclass(frozen=True)
class Mark:
    """What stands before and after the text of a turn, and whether its text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the mark of all other roles (``{role}`` is the role), legal moves by state, and roles that may end."""

    marks: dict[str, Mark]
    other: Mark
    moves: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    escape: str = "\\"
    _controls: re.Pattern = field(init=False, repr=False)
    _escaped: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        words = self.controls()
        for a in words:
            for b in (a[i:] for i in range(1, len(a))):
                if any(w.startswith(b) or b.startswith(w) for w in words) or self.escape in a:
                    raise ValueError(f"the mark {a!r} may overlap another one")
        object.__setattr__(self, "_controls", re.compile("|".join(map(re.escape, (self.escape, *words)))))
        object.__setattr__(self, "_escaped", re.compile(re.escape(self.escape) + "(.)", re.DOTALL))

    def controls(self) -> list[str]:
        """The strings that are escaped inside texts: all marks without white space around them."""
        marks = [m for x in self.marks.values() for m in (x.before, x.after)] + [*self.other.before.split("{role}"), self.other.after]
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))

    def hide(self, text: str) -> str:
        return self._controls.sub(lambda m: self.escape + m.group(), text)

    def show(self, text: str) -> str:
        return self._escaped.sub(r"\1", text) if self.escape in text else text

    def emit(self, state: str, role: str, text: str) -> tuple[str, bool, list[tuple[str, bool]]]:
        """One step of the machine: the next state, whether the turn is legal, and its segments."""
        mark = self.marks.get(role, self.other)
        before = mark.before.replace("{role}", self.hide(role)) if mark is self.other else mark.before
        return role, self.legal(state, role), [(before, False), (self.hide(text), mark.loss), (mark.after, False)]

    def legal(self, state: str, role: str) -> bool:
        return role in self.moves.get(state, ())

    def find(self, text: str, mark: str, at: int) -> int:
        """Where ``mark`` next stands unescaped."""
        while True:
            i = j = text.index(mark, at)
            while j > 0 and text[j - 1] == self.escape:
                j -= 1
            if (i - j) % 2 == 0:
                return i
            at = i + 1

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of a formatted text."""
        at, (head, tail) = 0, self.other.before.split("{role}")
        while at < len(text):
            for role, mark in self.marks.items():  # noqa: B007
                if text.startswith(mark.before, at):
                    at += len(mark.before)
                    break
            else:
                if not text.startswith(head, at):
                    raise ValueError(f"no mark at character {at}")
                mark, end = self.other, self.find(text, tail, at + len(head))
                role, at = self.show(text[at + len(head):end]), end + len(tail)
            end = self.find(text, mark.after, at)
            yield role, self.show(text[at:end])
            at = end + len(mark.after)


CHAT = Template(
    marks={"system": Mark("### System: ", "</turn>\n"), "user": Mark("### User: ", "</turn>\n"), "assistant": Mark("### Assistant: ", "</turn>\n", loss=True)},
    other=Mark("### [{role}]: ", "</turn>\n"),
    moves={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)

FORMATTED = "conv_id long, block long, whole boolean, text string, loss array<struct<at: int, n: int>>, first string, last string, illegal long"
PARSED = "conv_id long, block long, n_turns long, loss_chars long, formatted_chars long, first string, last string, illegal long, turns string, loss string"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "n_illegal long, valid boolean")


def format_chats(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """Blocks of formatted text (``text``) with the code-point spans of ``loss``; ``illegal`` leaves a block's first turn out."""
    rows = in_order(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for conv, block, whole, turns in blocks(batches, ["role", "text"]):
            parts, spans, at, bad = [], [], 0, 0
            state = None
            for role, text in turns:
                entered = state
                state, legal, segments = template.emit(state, role, text)
                bad += entered is not None and not legal
                for part, loss in segments:
                    if loss and part:
                        spans.append({"at": at, "n": len(part)})
                    parts.append(part)
                    at += len(part)
            yield (conv, block, whole, "".join(parts), spans, turns[0][0], state, bad), at

    return batched(rows, FORMATTED, make)


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Turns (role, newline, text, newline each) and loss text of every block, both unescaped, from its formatted text."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for row in rows_of(batches):
            turns = list(template.turns(row["text"]))
            loss = "".join(template.show(row["text"][s["at"]:s["at"] + s["n"]]) for s in row["loss"])
            yield ((row["conv_id"], row["block"], len(turns), len(loss), len(row["text"]), row["first"], row["last"], row["illegal"],
                    "".join(f"{role}\n{text}\n" for role, text in turns), loss), 2 * len(row["text"]))

    return batched(formatted, PARSED, make)


def digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, read back from its formatted blocks; ``valid``: no illegal turn, and its last role may end it."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
        for first, last, row in runs(batches):
            if first:
                turns, loss, sums, state = hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0], START
            turns.update(row["turns"].encode())
            loss.update(row["loss"].encode())
            bad = row["illegal"] + (not template.legal(state, row["first"]))
            sums = [a + b for a, b in zip(sums, (row["n_turns"], row["loss_chars"], row["formatted_chars"], bad), strict=True)]
            state = row["last"]
            if last:
                n, chars, size, bad = sums
                yield (row["conv_id"], n, turns.hexdigest(), chars, loss.hexdigest(), size, bad, bad == 0 and state in template.ends), 0

    whole = read_back(formatted.where("whole"), template)
    parts = read_back(formatted.where("not whole"), template).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return batched(whole, DIGESTS, make).unionByName(batched(parts, DIGESTS, make))


def chat_digests(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """Format all conversations, store the formatted text, and digest what is read back from it."""
    return digests(stored(format_chats(rows, template), "chats"), template)


ORACLE_SQL = r"""
WITH rows_all AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), marked AS (
  SELECT *,
    regexp_replace(text, '(\\|### (System:|User:|Assistant:|\[)|\]:|</turn>)', '\\\1', 'g') AS hidden,
    regexp_replace(role, '(\\|### (System:|User:|Assistant:|\[)|\]:|</turn>)', '\\\1', 'g') AS hidden_role,
    coalesce(lag(role) OVER w, 'start') AS state, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows_all WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), judged AS (
  SELECT *,
    length(CASE WHEN role IN ('system', 'user', 'assistant') THEN '### ' || role || ': ' ELSE '### [' || hidden_role || ']: ' END)
      + length(hidden) + length('</turn>') + 1 AS chars,
    NOT coalesce((state, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')), false) AS bad
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(*) FILTER (bad) AS n_illegal,
  count(*) FILTER (bad) = 0 AND bool_or(nth = n AND role = 'assistant') AS valid
FROM judged GROUP BY conv_id
"""
