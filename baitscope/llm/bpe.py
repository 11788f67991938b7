"""Operator 10: byte-level BPE encoding and decoding with a pair occurrence index.

The words of a batch that were not seen before are laid out as one sequence of
symbols.  An index maps every mergeable pair to all its positions; the active
ranks are applied in ascending order, and each merge updates the lists of the
pairs it makes.  Words are independent, so what a word becomes does not depend
on the batch.

Edge cases: a null or empty text has no ids; the text of an added token (such as
``<|endoftext|>``) becomes that token's id, as in the tokenizers library.  A very
long text is a batch of its own; a word of any length is encoded whole, and one of
over 32 characters is not kept.  Other columns, also of the operator's own names,
are left out.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import RecentCache, arrow_map

#: FIXED VALUE: the published split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units kept per generation in a Python worker (a unit takes about 200 bytes, 500 at most; longer ones are not kept).
CACHE_UNITS = 150_000
#: Position lists under this length are short; after so many of them the rest is merged position by position.
SHORT_LIST, SHORT_LISTS = 40, 300


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = [""] * 256
    for b in plain:
        symbols[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if not symbols[b]):
        symbols[b] = chr(256 + n)
    return symbols


class PairIndexBpe:
    """A byte-level BPE vocabulary with its merges, read from a tokenizers JSON file."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE vocabularies are read")
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int64)
        self.merges: list[tuple[int, int, int]] = []
        self.rank_of: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank_of.setdefault(vocab[a] << 32 | vocab[b], rank)
        self.codes = np.array(sorted(self.rank_of), np.int64)
        self.ranks = np.array([self.rank_of[c] for c in self.codes.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_re = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.words = regex.compile(PATTERN)
        self.odd_space = regex.compile(r" (?!\S)")
        self.unit_split = regex.compile(r" (?=\S)")
        value = {s: b for b, s in enumerate(symbols)}
        self.spelled = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            known = all(ch in value for ch in token)
            self.spelled[i] = bytes(value[ch] for ch in token) if known else token.encode("utf-8")
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.cache = RecentCache(cache_units, lambda unit: len(unit[0] if type(unit) is tuple else unit))
        self.word_cache = RecentCache(cache_units, len)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as packed little-endian 32-bit integers."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        ends = np.cumsum(sizes)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        # The pair occurrence index: rank -> all positions where that pair starts.
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(codes: np.ndarray, at: np.ndarray) -> None:
            """List the positions under their pairs' ranks; a pair without a rank is left out."""
            hit = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[hit] == codes
            ranks, at = self.ranks[hit[known]], at[known]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                rank = int(ranks[i])
                if rank in index:
                    index[rank].append(at[i:j])
                else:
                    index[rank] = [at[i:j]]
                    heapq.heappush(active, rank)

        inner = np.flatnonzero(following >= 0)
        note(ids[inner] << 32 | ids[inner + 1], inner)
        short = 0
        while active and short < SHORT_LISTS:
            rank = heapq.heappop(active)
            a, b, new = self.merges[rank]
            at = np.unique(np.concatenate(index.pop(rank)))
            short += len(at) < SHORT_LIST
            nxt = following[at]
            good = (ids[at] == a) & (nxt >= 0) & (ids[nxt] == b)
            at, nxt = at[good], nxt[good]
            if a == b and len(at) > 1:
                # Of a chain of overlapping pairs every second one merges, from the left.
                chained = nxt[:-1] == at[1:]
                head = np.flatnonzero(np.concatenate(([True], ~chained)))
                place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                at, nxt = at[place % 2 == 0], nxt[place % 2 == 0]
            if not len(at):
                continue
            after, left = following[nxt], before[at]
            ids[at], ids[nxt] = new, -1
            following[at] = after
            some = after >= 0
            before[after[some]] = at[some]
            left = before[at]
            note(new << 32 | ids[after[some]], at[some])
            some = left >= 0
            note(ids[left[some]] << 32 | new, left[some])
        if active:
            ids = self._finish(ids, following, before, index, active)
        alive = ids >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))
        packed = ids[alive].astype("<u4").tobytes()
        cut = (counts[np.concatenate(([0], ends))] * 4).tolist()
        return [packed[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def _finish(self, ids_np, following_np, before_np, index, active) -> np.ndarray:
        """The same steps position by position, for the many ranks whose lists are short."""
        ids, following, before = ids_np.tolist(), following_np.tolist(), before_np.tolist()
        places = {r: np.concatenate(v).tolist() for r, v in index.items()}
        merges, ranks = self.merges, self.rank_of
        while active:
            rank = heapq.heappop(active)
            a, b, new = merges[rank]
            held = places.pop(rank)
            for p in sorted(held) if len(held) > 1 else held:
                q = following[p]
                if ids[p] != a or q < 0 or ids[q] != b:
                    continue
                ids[p], ids[q] = new, -1
                after = following[p] = following[q]
                left = before[p]
                if after >= 0:
                    before[after] = p
                    r = ranks.get(new << 32 | ids[after])
                    if r is not None:
                        if r in places:
                            places[r].append(p)
                        else:
                            places[r] = [p]
                            heapq.heappush(active, r)
                if left >= 0:
                    r = ranks.get(ids[left] << 32 | new)
                    if r is not None:
                        if r in places:
                            places[r].append(left)
                        else:
                            places[r] = [left]
                            heapq.heappush(active, r)
        return np.array(ids, np.int64)

    def units(self, text: str) -> list[str | tuple]:
        """Cut a text before every single space that a non-space follows: no match of the pattern spans such a cut.

        Every unit but the first stands without its space; the first is a tuple, as it has none.
        """
        if not self.odd_space.search(text):
            row = text.split(" ")
            row[0] = (row[0],)
            return row
        row = self.unit_split.split(text)
        return [(row[0],), *row[1:]]

    def learn(self, wanted: list[str | tuple]) -> None:
        """Put the ids of unseen units into the cache; their unseen words go through the pair index together."""
        split = [self.words.findall(u[0] if type(u) is tuple else " " + u) for u in wanted]
        words = self.word_cache.absent(w for ws in split for w in ws)
        for w, ids in zip(words, self.merge_words([w.encode("utf-8") for w in words]), strict=True):
            self.word_cache[w] = ids
        get = self.word_cache.__getitem__
        for unit, ws in zip(wanted, split, strict=True):
            self.cache[unit] = get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        laid: list[list] = []
        for text in texts:
            if not text:
                laid.append([])
            elif self.added_re is None or not self.added_re.search(text):
                laid.append(self.units(text))
            else:
                row, at = [], 0
                for m in self.added_re.finditer(text):
                    row += self.units(text[at:m.start()]) if m.start() > at else []
                    row.append((m.group(), "added"))
                    at = m.end()
                laid.append(row + (self.units(text[at:]) if at < len(text) else []))
        wanted = self.cache.absent(chain.from_iterable(laid))
        for unit in [u for u in wanted if type(u) is tuple and len(u) == 2]:
            self.cache[unit] = self.added[unit[0]].to_bytes(4, "little")
            wanted.remove(unit)
        self.learn(wanted)
        get = self.cache.__getitem__
        return [b"".join(map(get, row)) for row in laid]

    def decode_bytes(self, packed: bytes) -> bytes:
        """The bytes that packed ids spell."""
        ids = np.frombuffer(packed, "<u4")
        n = self.lengths[ids]
        total = int(n.sum())
        if not total:
            return b""
        first = np.cumsum(n) - n
        where = np.arange(total) + np.repeat(self.starts[ids] - first, n)
        return self.flat[where].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBpe:
    """One vocabulary and its cache for each Python worker."""
    return PairIndexBpe(path)


def _codes(path: str, decode: bool = False):
    def make(batch: pa.RecordBatch) -> dict:
        bpe = load(path)
        packed = bpe.encode(batch.column("text").to_pylist())
        made = {"doc_id": batch.column("doc_id"), "ids": packed}
        if decode:
            made["decoded"] = [bpe.decode_bytes(x).decode("utf-8", "replace") for x in packed]
        return made
    return make


def _decoded(path: str):
    def make(batch: pa.RecordBatch) -> dict:
        spell = load(path).decode_bytes
        texts = [spell(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "decoded": texts}
    return make


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit integers) of each row; other columns are left out."""
    return arrow_map(_rows(docs, key, text), "text", "doc_id long, ids binary", _codes(path))


def decode_ids(codes: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded text of each row of ``encode_texts``."""
    return arrow_map(codes, "ids", "doc_id long, ids binary, decoded string", _decoded(path))


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded (and ids) for each row, in one pass without a shuffle.

    Encoding and decoding share a Python worker, so that a task holds one vocabulary and one cache.
    """
    rows = arrow_map(_rows(docs, "doc_id", "text"), "text", "doc_id long, ids binary, decoded string", _codes(path, decode=True))
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "decoded", *["ids"] * with_ids)
