import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pricelattice.llm import token_shards
from pricelattice.llm.token_shards import Shard, compress, pack, read_shards, shard_folder, write_shards

PATH = P.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("seed", range(6))
def test_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, [2, 5, 50, 300, 7, 3][seed], rng.integers(1, 400)) for _ in range(60)]
    docs[3] = np.zeros(5000, int)
    lengths = np.array([len(d) for d in docs])
    shard = Shard(pack(list(range(60)), np.concatenate(docs).astype("<u4"), lengths, 17, 300))
    assert shard.before == 17 and (shard.ids() == np.concatenate(docs)).all() and (shard.docs["n"] == lengths).all()
    for k, d in enumerate(docs):
        a, b = sorted(rng.integers(0, len(d) + 1, 2))
        assert shard.slice(k, a, b).tolist() == d[a:b].tolist()
    assert len(compress(np.concatenate(docs), lengths, 300)[0]) < lengths.sum()


def pairs_left(seq, symbols):
    """Most often that a pair occurs within documents, places of one symbol in a row halved."""
    count, at = Counter(), 0
    for n in symbols:
        own, k = seq[at : at + n].tolist(), 0
        at += n
        while k + 1 < len(own):
            count[own[k], own[k + 1]] += 1
            run = own[k] == own[k + 1] and k + 2 < len(own) and own[k + 2] == own[k]
            k += 2 if run else 1
    return max(count.values(), default=0)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_go_on_until_no_pair_is_frequent(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, [2, 9, 40, 400][seed], 20_000).astype("<u4")
    lengths = np.array([5_000, 1, 4_999, 10_000])
    seq, symbols, rules, sizes = compress(ids, lengths, 400)
    assert pairs_left(seq, symbols) < token_shards.LEAST_COUNT
    uses = np.bincount(np.concatenate([seq, rules.ravel()]).astype(np.int64), minlength=400 + len(rules))[400:]
    assert len(rules) == 0 or (uses >= 1).all() and sizes.min() >= 2


def test_most_frequent_pair_comes_first():
    ids = np.array([1, 2, 3] * 50 + [2, 3, 4] * 80, "<u4")
    assert compress(ids, np.array([len(ids)]), 10)[2][0].tolist() == [2, 3]


def test_real_texts_shrink_by_half(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lib = library()
    ids = [lib.encode(t).ids + [2] for t in texts]
    lengths = np.array([len(i) for i in ids])
    flat = np.concatenate(ids).astype("<u4")
    content = pack(list(range(len(ids))), flat, lengths, 0, 50257)
    assert (Shard(content).ids() == flat).all()
    assert len(content) < 0.35 * 4 * len(flat)


@pytest.mark.parametrize("n, width", [(0, 1), (1, 1), (9, 17), (65_536, 3), (65_545, 19), (200_001, 32)])
def test_bits_round_trip(n, width):
    values = np.random.default_rng(n).integers(0, 2**width, n)
    content = b"xyz" + token_shards._bits(values, width) + b"end"
    got, at = token_shards._values(content, 3, n, width)
    assert (got == values).all() and content[at:] == b"end" and at - 3 == -(-n * width // 8)


def test_chains_of_equal_counts_take_few_rounds(monkeypatch):
    rounds = []
    plain = token_shards._round
    monkeypatch.setattr(token_shards, "_round", lambda *a: rounds.append(1) or plain(*a))
    ids = np.tile(np.arange(4_000), 8)
    seq, symbols, rules, _ = compress(ids, np.array([len(ids)]), 4_000)
    assert len(rounds) < 100 and len(seq) < 100
    assert (Shard(pack([1], ids, np.array([len(ids)]), 0, 4_000)).ids() == ids).all()


def test_no_cut_looks_into_the_next_text():
    for texts in (["foo  ", "bar"], ["a\n", "b"], ["  ", "x"], ["", " ", "y"], ["a ", "", "b"]):
        unique, number, begin = token_shards.pieces(pa.array(texts))
        own = unique.take(pa.array(number)).to_pylist()
        for k, t in enumerate(texts):
            alone = token_shards.pieces(pa.array([t]))
            assert own[begin[k] : begin[k + 1]] == alone[0].take(pa.array(alone[1])).to_pylist()


def test_cuts_never_part_a_pretoken():
    rng = random.Random(9)
    encoder, lib = token_shards.Encoder(PATH), library()
    texts = ["".join(rng.choice("ab1.,' \n\té×漢\u00a0\u3000") for _ in range(rng.randrange(30))) for _ in range(4_000)]
    ids, n = encoder.encode(pa.array(texts))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(token_shards, "KEEP", 3)
    encoder, lib = token_shards.Encoder(PATH), library()
    for t in ["one two three four five", "four five six", " seven", "one two three four five"]:
        assert encoder.encode(pa.array([t]))[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_documents_match_the_library(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng = random.Random(3)
    odd = ["", " ", "a  b", "\na", "x ", "I'm  don't 's", "<|endoftext|> x", "é\x1cz y", " \n \n", None]
    odd += ["<|endoftext|>", "a <|endoftext|>", "<|endoftext|", "don't 'tis 's x'", "a\u00a0b \u00a0 c", "×a÷b ÀÿĀ.ɏ,b", "x\u2003 y", "\x1f a"]
    odd += ["".join(rng.choice("ab \n\t'.9é漢×\u00a0") for _ in range(40)) for _ in range(600)]
    extra = spark.createDataFrame([(-5 - k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    folder = shard_folder(spark)
    write_shards(both, folder, PATH)
    got = read_shards(spark, folder).orderBy("start").collect()
    want, at, lib = [], 0, library()
    for doc, t in sorted((r.doc_id, r.text or "") for r in both.collect()):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_edges(spark):
    for rows, n in (([], 0), ([(1, "a b", "q"), (1, "a b", "q"), (None, None, None), (0, "", "z")], 4)):
        folder = shard_folder(spark)
        write_shards(spark.createDataFrame(rows, "doc_id long, text string, start string"), folder, PATH)
        got = read_shards(spark, folder).orderBy("start").collect()
        assert [r.doc_id for r in got] == [None, 0, 1, 1][:n] and [r.start for r in got] == [0, 1, 2, 5][:n]
    assert token_shards.NULL_ID < 0
