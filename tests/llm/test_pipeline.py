"""The pipeline, each stage held against what it should keep of its own input."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from test_duplicates import brute_classes, brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
        if k < 4:
            assert tables[-1].columns == P.COLUMNS
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert set(rows[1]) == {k for k, r in rows[0].items() if re.search(r"[^\W\d_]", r.text or "")}
    classes = brute_classes([(k, r.text) for k, r in rows[1].items()])
    assert set(rows[2]) == {k for k, c in classes.items() if k == c}
    cut = {x[0]: x[2] for x in brute_repeats([(k, r.text) for k, r in rows[2].items()], P.REPEAT_BYTES)}
    assert set(rows[3]) == set(rows[2])
    for k, r in rows[3].items():
        lost = len(rows[2][k].text.encode()) - len(r.text.encode())
        assert r.n_chars == len(r.text) and cut[k] <= lost <= cut[k] + 8 and (cut[k] > 0 or r.text == rows[2][k].text)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {k for k, r in rows[3].items() if any(i in " ".join(r.text.split()) for i in items)}
    assert not holds & set(rows[4]) and len(rows[3]) - len(rows[4]) <= len(holds) + 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(rows[5]) == set(rows[4])
    for k, r in rows[5].items():
        assert r.n_tokens == len(library.encode(rows[4][k].text, add_special_tokens=False).ids)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, rows in (("odd", odd_docs), ("none", no_docs)):
        for k, (_, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, rows, SF).write.parquet(path)
            rows = spark.read.parquet(path)
    assert rows.count() == 0


def test_repeated_rows_keep_their_text(spark):
    """Exact copies of a row, with its id or without any, reach the third stage once and lose nothing there."""
    texts = [" ".join(f"{w}{k}" for k in range(80)) for w in ("plain", "other")]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (None, texts[1]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.repeated_passages(spark, P.near_duplicates(spark, docs, SF), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", texts[0]), ("None", texts[1])]
