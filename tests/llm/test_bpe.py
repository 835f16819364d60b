import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from pricelattice.llm.bpe import LONG, Known, decoder, displaced, encode, finder, merge_long, merges, read_ranks

RANKS = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(spark, texts, schema="doc_id long, text string, ids string, w int", hot=1 << 19):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, schema)
    out = encode(df, RANKS, P.PATTERN, id_bytes="raw", decoded="back", hot=hot)
    assert out.columns == ["doc_id", "text", "w", "ids", "raw", "back"]
    out = out.select("*", F.sha2("raw", 256).alias("sha"), decoder(spark, RANKS)(F.col("ids")).alias("again"))
    got = out.collect()
    assert len(got) == len(texts)
    for r in got:
        want = LIB.encode_ordinary(r.text or "")
        assert r.ids == want and bytes(r.back) == bytes(r.again) == (r.text or "").encode()
        assert r.sha == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_matches_the_library(spark):
    rng = random.Random(4)
    alphabet = "aeinrst ABE  \n\t.,'sé漢字 　123%🙂́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", " ", "\n\n ", "I'll we've don't", "<|endoftext|>", "same", "same", "ab" * 150, "x" * 350]
    texts += ["y" * n for n in (LONG - 1, LONG, LONG + 1)] + ["éü" * 70 + " " + "ab" * 200]
    check(spark, texts)
    check(spark, texts, hot=1)  # nothing hot: all words are folded where they stand


def test_very_long_runs(spark):
    rng = random.Random(6)
    check(spark, ["".join(rng.choice("abcé") for _ in range(30_000)), " " * 5_000 + "x", "word " * 20_000])


def test_heap_merge():
    rng = random.Random(8)
    for _ in range(300):
        w = "".join(rng.choice("thein grosa") for _ in range(rng.randrange(1, 40)))
        assert merge_long(w.encode(), RANKS) == LIB._encode_single_piece(w.encode())


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).collect() == []


def test_every_merge_has_its_cell():
    pairs = merges(RANKS)
    shift, cells = displaced(pairs, len(RANKS))
    cell = cells[shift[pairs[:, 0]] + pairs[:, 1]]
    assert (cell >> 32 == pairs[:, 0]).all() and (cell & 0xFFFFFFFF == pairs[:, 2]).all() and (cells >= 0).sum() == len(pairs)


def test_look_up_takes_little_memory():
    """Known words are found without a table of all of them: the first place counts, others give -1."""
    hot = [f"w{k}" for k in range(400_000)] + ["w7", " the"]
    known = Known(RANKS, pa.table({"word": pa.array(hot), "ids": pa.array([[1, 2]] * len(hot), pa.list_(pa.int32()))}), finder(P.PATTERN))
    first = {}
    for k, w in enumerate(known.words.to_pylist()):
        first.setdefault(w, k)
    words = ["w7", "not known", " the", "w399999", "", "é"]
    usual, own = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(own)
    try:
        got = known.number(pa.array(words))
    finally:
        pa.set_memory_pool(usual)
    assert got.tolist() == [first.get(w, -1) for w in words]
    assert own.max_memory() < 8 << 20
    assert known.number(pa.array([], pa.string())).tolist() == []


def test_ids_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for r in encode(docs, RANKS, P.PATTERN, hot=2_000).collect():
        assert r.ids == LIB.encode_ordinary(r.text or "")
