import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnflow.llm import packing
from tarnflow.llm.codec import ByteBpe


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def ids_of(bpe, text):
    return np.frombuffer(bpe.encode(text), np.uint32).tolist()


def test_ids_with_all_kinds_of_white_space(bpe, tokenizer):
    rng = random.Random(5)
    parts = ["a", "of", "Éré,", " ", "  ", "\n", "\t", " \n", " ", " ", "don't", "123", "<|endoftext|>", "\u0000", "!!", "x" * 300, "\x85", "日本語", "́"]
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n \n b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want, strict=True):
        assert ids_of(bpe, text) == ids, text


def check(rows, size):
    """Every id in one piece, sequences gapless from 0 and within size; returns padding's share."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    total = pad = 0
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
        total += end
        pad += 0 if end & (end - 1) == 0 else size - end
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return pad / max(1, total + pad)


def test_registered_query(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op9_packing(spark, sf_dir).collect()
    assert check(rows, 2048) < 0.02
    want = {}
    for r, x in zip(docs, tokenizer.encode_batch([r.text or "" for r in docs], add_special_tokens=False), strict=True):
        want[r.doc_id] = [*x.ids, 1]
    seen = Counter()
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == Counter({i: len(x) for i, x in want.items()})


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a b " * 3000, 3), (3, "a b " * 3000, 3), (None, "x", 4)] + [(i, "same", 5) for i in range(10, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(5)
    out = packing.pack_documents(docs, size=64).collect()
    check(out, 64)
    assert sum(r.length for r in out if r.doc_id in (1, 2)) == 2
    assert Counter(r.doc_id for r in out)[None] == 1
    assert packing.pack_documents(docs.limit(0), size=64).collect() == []


@pytest.mark.parametrize("rows", [10_000, 100])
def test_many_of_one_length(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "GROUP_ROWS", rows)
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "if(id % 3 = 0, 5L, id % 17 + 1) AS length", "id AS ids_crc32", "9L AS doc_tokens")
    check(packing.pack_pieces(pieces, 20).collect(), 20)


def test_place_is_shortest_first_and_whole():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([8, 50, 128])
        histogram = {rng.randint(1, size): rng.randint(1, 90) for _ in range(rng.randint(1, 30))}
        slots = packing.place(histogram, size)
        for length, n in histogram.items():
            ranks = sorted(r for x, first, count, _, _ in slots if x == length for r in range(first, first + count))
            assert ranks == list(range(n))
        held, pad = packing.padding(slots, size)
        assert held == sum(a * b for a, b in histogram.items())
        assert pad >= 0
