"""Operator 1: token-id files with frequency-ranked, byte-aligned variable-length ids.

Layout of a store (a folder): ``ranks`` is a Parquet table (rank, id), the most
frequent id first; ``shards`` holds one binary file per range of ids of
documents, in ascending order of the documents.  A shard is a run of blocks:

    magic "SVB1" | shard, block, n_docs, n_ids, n_data (unsigned 32-bit)
    document ids (64-bit) | 1 per null document id | ids per document (32-bit)
    control bytes: two bits for each id, its length in bytes less one
    data bytes: the ids' ranks, 1 to 4 little-endian bytes each
    one line feed

All integers are little-endian.  A block is decoded by numpy table lookup: a
control byte gives the lengths of four ids and the bytes they take together.

Edge cases: a null or empty text holds the end id only; rows with a null doc_id
come first; rows with equal ids are kept, one record each.  A very long text is a
batch of its own; a piece without spaces may have any length and is not cached if
it has over 32 characters.  Other columns, also of the operator's own names, are
left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitscope.llm.bpe import byte_symbols
from baitscope.llm.common import LONG_KEY, arrow_map, pieces, scratch, stored, workers_import

MAGIC = b"SVB1"
HEAD = struct.Struct("<4s5I")
#: Ids of a block, about; bytes of a shard, about.
BLOCK_IDS, SHARD_BYTES = 1_000_000, 16 << 20
#: Pieces of text kept per generation in a Python worker.
CACHE_PIECES = 400_000
#: FIXED VALUE: ASCII punctuation without the apostrophe, which starts contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lengths of the four ids that a control byte describes, where each starts, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of unsigned ranks."""
    r = ranks.astype(np.uint32)
    size = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[:len(r)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[at] = r & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        data[at[more] + k] = r[more] >> (8 * k) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block, by table lookup on its control bytes."""
    c = np.frombuffer(control, np.uint8)
    total = TOTALS[c]
    at = ((np.cumsum(total) - total)[:, None] + STARTS[c]).reshape(-1)[:n]
    size = LENGTHS[c].reshape(-1)[:n]
    d = np.frombuffer(data, np.uint8)
    ranks = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= d[at[more] + k].astype(np.uint32) << (8 * k)
    return ranks


class PieceCache(dict):
    """Ids of pieces, made when first asked for; at ``most`` entries the young generation becomes the old one.

    Long pieces are not kept, so memory is bounded by ``2 * most`` short ones.
    """

    def __init__(self, most: int, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONG_KEY:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class PieceEncoder:
    """The tokenizers library on pieces between spaces and line feeds, each distinct piece once.

    Only for vocabularies that drop white space, where no token and no step of
    the normaliser reaches over it; the file's pre-tokenizer is checked for that.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_piece = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] \
            and "\\s" not in steps[0]["pattern"]["Regex"].replace("[^\\s", "")
        self.lower = any(x["type"] == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
        self.lower &= not any(t["content"] != t["content"].lower() for t in spec["added_tokens"])
        # A run of marks after a letter or digit is a word of its own to the pre-tokenizer.
        self.marks = self.by_piece and steps[0]["pattern"]["Regex"].endswith("[^\\s\\p{L}\\p{N}]+")
        # A word of lower-case letters is one word to the pre-tokenizer as well: it can go straight to the library's model.
        bytes_only = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not (steps[1]["use_regex"] or steps[1]["add_prefix_space"])
        self.whole_words = self.lower and bytes_only and "[\\p{L}]+" in steps[0]["pattern"]["Regex"].split("|")
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = PieceCache(cache_pieces, self._piece)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in found]

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.symbols)
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}{'H' if self.width == '<u2' else 'I'}", *ids)

    def _lower(self, text: str) -> str:
        """Lower case for Latin-1 texts, where it is the normaliser's own (each character alone, nothing to compose)."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def _parts(self, piece: str) -> tuple[str, str]:
        """A piece before and from the marks at its end."""
        if self.marks and len(piece) <= LONG_KEY and piece[-1:] in MARKS and not any(a in piece for a in self.added):
            core = piece.rstrip(MARKS)
            if core and core[-1].isascii() and core[-1].isalnum():
                return core, piece[len(core):]
        return piece, ""

    def _piece(self, piece: str) -> bytes:
        core, marks = self._parts(piece)
        if marks:
            return self.cache[core] + self.cache[marks]
        if self.whole_words and piece.isalpha() and piece.islower() and max(piece) <= "\xff":
            return self._word(piece)
        return self._library([piece])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian ids of each text, as wide as ``width``."""
        if not self.by_piece:
            return self._library([t or "" for t in texts])
        rows = [(self._lower(t) if self.lower else t).replace("\n", " ").split(" ") if t else [] for t in texts]
        self.cache.turn()
        get = self.cache.__getitem__
        return [b"".join(map(get, row)) for row in rows]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One vocabulary and its cache for each Python worker."""
    return PieceEncoder(path)


def encode_texts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids: each row's whole text as packed ids of the encoder's width, the end id last."""
    def make(batch: pa.RecordBatch) -> dict:
        own = encoder(path)
        end = np.array([end_id], own.width).tobytes()
        ids = own.encode(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "ids": [x + end for x in ids]}

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, "text", "doc_id long, ids binary", make)


def id_counts(codes: DataFrame, width: str) -> DataFrame:
    """id, n: how often each id occurs in all rows; every task sends one row for each id it has met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for piece in pieces(batches, "ids"):
            # Rows lie one after the other in the column's buffer.
            ids = np.frombuffer(b"".join(piece.column("ids").to_pylist()), width)
            got = np.bincount(ids, minlength=len(n))
            got[:len(n)] += n
            n = got
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n[met], pa.int64())], ["id", "n"])

    workers_import(codes.sparkSession)
    return codes.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def make_block(shard: int, number: int, held: list[tuple[int | None, bytes]], rank_of: np.ndarray, width: str) -> bytes:
    """One block of documents (doc_id, packed ids)."""
    size = np.dtype(width).itemsize
    ids = np.frombuffer(b"".join(x for _, x in held), width)
    control, data = pack(rank_of[ids])
    head = HEAD.pack(MAGIC, shard, number, len(held), len(ids), len(data))
    docs = np.array([d or 0 for d, _ in held], "<i8").tobytes()
    nulls = bytes(d is None for d, _ in held)
    lengths = np.array([len(x) // size for _, x in held], "<u4").tobytes()
    return head + docs + nulls + lengths + control + data


def write_store(codes: DataFrame, path: str, width: str = "<u4") -> None:
    """Write a store from rows (doc_id, ids packed as ``width``).  The rank table is bounded by the vocabulary."""
    spark = codes.sparkSession
    counted = id_counts(codes, width).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r["id"] for r in counted], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    total = sum(r["n"] for r in counted)
    table = [(int(k), int(i)) for k, i in enumerate(by_rank)]
    spark.createDataFrame(table, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    size = np.dtype(width).itemsize
    shards = max(1, -(-total * 3 // 2 // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        for piece in pieces(batches, "ids"):
            for doc, ids in zip(piece.column("doc_id").to_pylist(), piece.column("ids").to_pylist(), strict=True):
                held.append((doc, ids))
                n += len(ids) // size
                if n >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([make_block(shard, number, held, rank_of, width)], pa.binary())], ["value"])
                    number, held, n = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([make_block(shard, number, held, rank_of, width)], pa.binary())], ["value"])

    workers_import(spark)
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    dealt = codes.withColumn("tie", F.xxhash64("ids")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    blocks = dealt.select("doc_id", "ids").mapInArrow(run, "value binary")
    # The writer of text files puts out the bytes of a value as they are, with the task retries of any Spark sink.
    blocks.select(F.col("value").cast("string")).write.option("lineSep", "\n").text(f"{path}/shards")


def read_blocks(content: bytes) -> Iterator[tuple]:
    """shard, block number, document ids, ids per document, ranks of each block of a shard's bytes."""
    at = 0
    while at < len(content):
        magic, shard, number, n_docs, n_ids, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a block of a token store")
        at += HEAD.size
        docs = np.frombuffer(content, "<i8", n_docs, at)
        nulls = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
        lengths = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        at += 13 * n_docs
        n_control = -(-n_ids // 4)
        ranks = unpack(content[at:at + n_control], content[at + n_control:at + n_control + n_data], n_ids)
        at += n_control + n_data + 1
        yield shard, number, [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], lengths, ranks


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, read back from a store's files.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    schema = "shard long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                done = 0
                for shard, _, docs, lengths, ranks in read_blocks(batch.column("content")[k].as_py()):
                    raw = by_rank[ranks].tobytes()
                    ends = np.cumsum(lengths)
                    own = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    made = [pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()),
                            pa.array(done + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                            pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["shard", "doc_id", "inner", "n_tokens", "ids_crc32"]
                    if with_ids:
                        made, names = [*made, pa.array(own, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(made, names)
                    done += int(ends[-1]) if len(ends) else 0

    workers_import(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("content")
    rows = files.mapInArrow(run, schema)
    if not with_ids:
        rows = stored(rows, "token-rows")
    # One row for each shard.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenize_to_store(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode every text, write a store, and return its folder."""
    path = path or scratch(docs.sparkSession, "token-store")
    write_store(stored(encode_texts(docs, tokenizer, end_id), "token-ids"), path, encoder(tokenizer).width)
    return path
