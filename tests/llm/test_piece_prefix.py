import random

import public_tokenizers
import pytest
import sentencepiece

from pricelattice.llm.piece_prefix import PrefixTable, decode, encode, read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def some(rng, pieces):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("abcdei  ") for _ in range(rng.randrange(40)))
    if kind < 0.6:
        return "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(12)))
    if kind < 0.7:
        return " " * rng.randrange(60) + rng.choice(["", "x", "the", " "])
    if kind < 0.8:
        return "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F000, 0x1F900)])) for _ in range(20))
    return "".join(rng.choice("anow ▁\n\tе1.,") for _ in range(rng.randrange(80)))


def test_as_the_library(model, library):
    table, rng = PrefixTable(model), random.Random(5)
    pieces = [model.pieces[i] for i in model.ordinary]
    for _ in range(8000):
        text = some(rng, pieces)
        ids = list(memoryview(table.encode(text)).cast("i"))
        assert ids == library.encode(text) and table.decode(ids) == library.decode(ids), text
        odd = [rng.randrange(32000) if rng.random() < 0.5 else rng.choice([0, 1, 2, 233, 154, 168, 68, 28705, 261, 259]) for _ in range(rng.randrange(8))]
        assert table.decode(odd) == library.decode(odd), odd


def test_every_prefix_has_its_last_token(model, library):
    table = PrefixTable(model)
    run = "▁internationalisierung"
    last = table.last_tokens(run)
    for k in range(1, len(run) + 1):
        assert last[k] == library.encode(run[1:k])[-1] if k > 1 else True
    for text in ("international", "hello world", "Донаудампф"):
        ids = library.encode(text)
        assert all(table.fits(x, y) for x, y in zip(ids, ids[1:]))
    assert not table.fits(table.id_of["t"], table.id_of["h"])


def test_long_words_and_spaces(model, library):
    table = PrefixTable(model)
    for text in ("abcdefghij" * 20_000, " " * 50_000 + "x", "é𝕏" * 5_000, "a " * 30_000):
        assert list(memoryview(table.encode(text)).cast("i")) == library.encode(text)


def test_edges(spark, model, library):
    texts = ["", None, " ", "a  b ", "日本 𝕏", "<s>", "<0x0A>", "x" * 3000, "\x00", "a  b "]
    docs = spark.createDataFrame([(k, t, "old", 7) for k, t in enumerate(texts)], "doc_id long, text string, ids string, piece int")
    got = {r.doc_id: r for r in encode(docs, model, decoded="back").collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (list(got[k].ids), got[k].back, got[k].text, got[k].piece) == (ids, library.decode(ids), t, 7)
    assert encode(docs, model, keep=["doc_id"]).columns == ["doc_id", "ids"]
    assert encode(docs.where("false"), model).count() == 0
    lists = spark.createDataFrame([(1, [28705, 259]), (2, []), (3, None)], "k int, ids array<int>")
    assert {r.k: r.text for r in decode(lists, model).collect()} == {1: library.decode([28705, 259]), 2: "", 3: None}
    with pytest.raises(Exception, match="id of no piece"):
        decode(spark.createDataFrame([([5, None],)], "ids array<int>"), model).collect()


def test_query(spark, library):
    import hashlib

    from pricelattice.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_piece_prefix"](spark, sf).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = library.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
