import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


BPE = piece_bpe.PieceBpe(MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n▁abtheionrsé日😀"))))
def test_any_text(text):
    ids = SP.encode(text)
    assert BPE.encode([text]) == [ids]
    assert BPE.decode(ids) == SP.decode(ids)


def test_mixtures(library):
    rng = random.Random(11)
    parts = ["the", " ", "  ", " " * 17, "▁", "aaa", "tionion", "Éré", "\n", "\n\n", "日本", "😀", "\u0000", "<s>", "</s>", "<0x0A>", "1234", "$$$", "&&&", "x" * 90, "​", "ing", "er"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text)
        assert BPE.encode([text]) == [ids], text
        assert BPE.decode([*ids, 2]) == library.decode([*ids, 2]), text


def test_decode_of_odd_ids(library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(259, 32000) for _ in range(rng.randint(1, 9))]
        assert BPE.decode(ids) == library.decode(ids)


def test_registered_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = piece_bpe.op6_piece_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*library.encode(texts[r.doc_id]), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_rows_and_round_trip(spark, monkeypatch):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 50_000, "c"), (4, "x" * 100_000, "d"), (4, "x" * 100_000, "d"), (None, " a  b ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = piece_bpe.encode_texts(docs, MODEL)
    assert {r.doc_id: list(r.ids) for r in ids.filter("doc_id < 3").collect()} == {1: [2], 2: [2]}
    back = piece_bpe.decode_ids(ids, MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert piece_bpe.encode_texts(docs.limit(0), MODEL).collect() == []


def test_full_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "CACHE_PARTS", 5)
    text = " ".join(f"w{i % 13}ord" for i in range(500))
    for i in range(5):
        assert BPE.encode([text, text[i:]]) == [library.encode(text), library.encode(text[i:])]
