"""Operators 1 and 10 against the tokenizers library."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from baitscope.llm import bpe, tokenstore
from baitscope.llm.common import RecentCache, scratch

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "  ", "a  b", " a \n b\n\n c \t\n d ", "x\n \n y", "it's we'll I'M'd", "<|endoftext|> hi <|endoftext|><|endoftext|>x",
       "日本語 テスト 😀 ñ é İSTANBUL ΣΑΣ", "aaaaaaaaaaaaaaa", "  x y  ", "1234 5678.90", "!!! ... 'tis", "a \x1c b\x85c", "end ", "́ a ́"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = " \n\t'sSabcéÉ1!<|>́ \x1cΣİ endoftx"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_byte_bpe_equals_library(texts):
    library, own = Tokenizer.from_file(BYTE), bpe.load(BYTE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [own.decode_bytes(g).decode("utf-8", "replace") for g in got] == library.decode_batch(want, skip_special_tokens=False)


def test_pair_index_paths_agree(texts, monkeypatch):
    """All merges position by position, and all through whole lists."""
    words = [w.encode() for t in texts[:300] for w in t.split()]
    own = bpe.load(BYTE)
    want = own.merge_words(words)
    for short, lists in ((0, 10**9), (10**9, 1)):
        monkeypatch.setattr(bpe, "SHORT_LIST", short)
        monkeypatch.setattr(bpe, "SHORT_LISTS", lists)
        assert own.merge_words(words) == want


def test_pieces_equal_library(texts):
    library, own = Tokenizer.from_file(WORD), tokenstore.encoder(WORD)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, own.width).tolist() for g in own.encode(texts)] == want
    plain = ["größe élève ñandú ªº µm straße thewhing", "Größe ÉLÈVE Über die Straße", "ΣΑΣ ǅ ﬁne ⅷ aʰ", "don't o'clock 'tis l'été"]
    want = [e.ids for e in library.encode_batch(plain, add_special_tokens=False)]
    assert [np.frombuffer(g, own.width).tolist() for g in own.encode(plain)] == want


def test_small_cache_changes_nothing(texts):
    own = tokenstore.PieceEncoder(WORD, cache_pieces=5)
    assert own.encode(texts[:200]) == tokenstore.encoder(WORD).encode(texts[:200])
    cache = RecentCache(2)
    for k in range(50):
        for x in cache.absent([k, k + 1]):
            cache[x] = x
        assert cache[k] == k and len(cache) + len(cache.old) <= 8


def test_long_pieces_are_not_kept():
    """Texts without spaces are one piece each; no cache holds them past their batch, and results stay the library's."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("日本語テスト漢字かな") for _ in range(3000)) for _ in range(40)] + ["x" * 5000 + "!", "QUJD" * 900, "a.b," * 400]
    for path, own in ((BYTE, bpe.PairIndexBpe(BYTE)), (WORD, tokenstore.PieceEncoder(WORD))):
        library = Tokenizer.from_file(path)
        width = getattr(own, "width", "<u4")
        for text in texts:
            (got,) = own.encode([text])
            assert np.frombuffer(got, width).tolist() == library.encode(text, add_special_tokens=False).ids
        own.encode(["a few short words"])
        caches = [own.cache, *([own.word_cache] if path == BYTE else [])]
        for cache in caches:
            if path == BYTE:
                cache.absent(["short"])
            assert sum(len(k[0] if isinstance(k, tuple) else k) + len(v) for k, v in [*cache.items(), *cache.old.items()]) < 20_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_pack_round_trip(ranks):
    control, data = tokenstore.pack(np.array(ranks, np.uint64))
    assert len(control) == -(-len(ranks) // 4)
    assert tokenstore.unpack(control, data, len(ranks)).tolist() == ranks


def test_store_round_trip(spark, odd_docs):
    path = tokenstore.tokenize_to_store(odd_docs, WORD, 1)
    got = tokenstore.read_store(spark, path, with_ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(WORD)
    rows = odd_docs.select("doc_id", "text").collect()
    want = {(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in rows}
    assert len(got) == len(rows) and {(r.doc_id, bytes(r.ids)) for r in got} == want
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(r.ids))
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_store_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_BYTES", 4000)
    monkeypatch.setattr(tokenstore, "BLOCK_IDS", 100)
    codes = spark.createDataFrame([(k, bytearray(np.array([k % 7 * 40000] * 3, "<u4").tobytes())) for k in range(3000)], "doc_id long, ids binary")
    path = scratch(spark, "blocks")
    tokenstore.write_store(codes, path)
    got = tokenstore.read_store(spark, path).orderBy("doc_id").collect()
    assert [r.start for r in got] == [3 * k for k in range(3000)]


def test_empty(spark, no_docs):
    path = tokenstore.tokenize_to_store(no_docs, WORD, 1)
    assert tokenstore.read_store(spark, path).count() == 0
    assert bpe.round_trip(no_docs, BYTE).count() == 0


def test_round_trip_rows(odd_docs):
    library = Tokenizer.from_file(BYTE)
    got = bpe.round_trip(odd_docs, BYTE, with_ids=True).collect()
    assert len(got) == odd_docs.count()
    want = {}
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.setdefault(r.doc_id, set()).add((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                              hashlib.sha256((r.text or "").encode()).hexdigest()))
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id]
    again = bpe.decode_ids(bpe.encode_texts(odd_docs, BYTE), BYTE).select("decoded").collect()
    assert sorted(x.decoded for x in again) == sorted(r.decoded for r in got)
