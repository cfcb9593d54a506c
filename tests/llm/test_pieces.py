"""SentencePiece encoding and decoding held against the library itself."""

import hashlib
import random
import time

import pyarrow as pa
import pytest

from factorloom.llm.pieces import SHORT, decode_pieces, encode_pieces, piece_digests, piece_model
from factorloom.llm.queries import PIECE_MODEL, op11_sentencepiece, tokenizer_path

LETTERS = [*" ▁abcdeéßö.,'\"\n\t1290中文😀́<>x\x00", "<s>", "</s>", "<unk>", "<0x0A>", "    ", "the", "ing"]


@pytest.fixture(scope="module")
def model():
    return piece_model(tokenizer_path(PIECE_MODEL))


def strings(seed: int, n: int, most: int = 60) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, most))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(model):
    texts = strings(3, 3000)
    ids = model.encode(pa.array(texts))
    want = model.library.encode(texts)
    assert ids.to_pylist() == want
    assert model.decode(ids).to_pylist() == model.library.decode(want)


def test_any_ids_decode_as_in_the_library(model):
    draw = random.Random(5)
    some = [0, 1, 2, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 0xFF, 29871, *draw.sample(range(259, 32000), 12)]
    lists = [[draw.choice(some) for _ in range(draw.randint(0, 9))] for _ in range(4000)]
    assert model.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [model.library.decode(x) for x in lists]
    sliced = pa.array([[5], *lists, None, [7, None], [32000], [-1]], pa.list_(pa.int32())).slice(1)
    assert model.decode(sliced).to_pylist() == [*(model.library.decode(x) for x in lists), None, None, None, None]


def test_both_forms_of_the_agenda_agree(model):
    draw = random.Random(9)
    for n in range(2, SHORT + 1):
        word = "".join(draw.choice("abcdehinorst▁▁") for _ in range(n))
        long = model.agenda(word + "\n" * (SHORT + 1))
        assert model._short_agenda(list(word)) == long[: len(long) - (SHORT + 1)]


def test_a_long_run_without_cuts_is_not_quadratic(model):
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefghij") for _ in range(150_000))
    began = time.time()
    assert model.encode(pa.array([text])).to_pylist()[0] == model.library.encode(text)
    assert time.time() - began < 20


def test_a_wrong_chunk_stops_the_job(model):
    with pytest.raises(ValueError, match="sentencepiece"):
        model._check({" hello": (1, 2)})


def test_rows_nulls_repeats_and_clashing_columns(spark):
    rows = [(0, None, "x"), (1, "", "x"), (2, " two  words ", "x"), (2, "again", "x"), (None, "no id", "x"), (4, "a" * 5000 + " " + "é" * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = tokenizer_path(PIECE_MODEL)
    library = piece_model(path).library
    coded = encode_pieces(docs, path, check_texts=True)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.ids) for r in coded.collect()), key=str) == sorted(((k is None, k or 0, library.encode(t or "")) for k, t, _ in rows), key=str)
    back = {(r.doc_id, r.text) for r in decode_pieces(coded, path).collect()}
    assert back == {(k, t or "") for k, t, _ in rows}
    assert encode_pieces(docs.limit(0), path).count() == 0 and decode_pieces(coded.limit(0), path).count() == 0


def test_the_query_over_the_table(spark):
    got = {r["doc_id"]: r for r in op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    library = piece_model(tokenizer_path(PIECE_MODEL)).library
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "")
        assert got[r.doc_id]["n_tokens"] == len(ids)
        assert got[r.doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert piece_digests(empty, tokenizer_path(PIECE_MODEL)).count() == 0
