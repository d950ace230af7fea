import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnflow.llm import token_counts


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_registered_query(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(x.ids) for r, x in zip(docs, tokenizer.encode_batch([r.text or "" for r in docs], add_special_tokens=False), strict=True)}
    rows = token_counts.op4_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert len(rows) == len(want)
    for a, b in zip(rows := sorted(rows, key=lambda r: (r.sequence, r.ordinal)), rows[1:], strict=False):
        if a.sequence == b.sequence:
            assert (b.ordinal, b.start) == (a.ordinal + 1, a.start + a.n_tokens + 1)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_of_any_size(spark, tmp_path, block):
    """Documents that span blocks and files, empty ones, and ids after the last end."""
    rng = random.Random(block)
    want = {}
    for sequence in range(3):
        ids = [rng.choice([0, 0, 5, 258, 512, 2, 65535]) for _ in range(rng.randint(1, 60))] + [9] * (sequence == 1)
        lengths, held, start, at = [], 0, 0, 0
        for x in ids:
            at += 1
            if x:
                held += 1
            else:
                lengths.append((start, held, True))
                held, start = 0, at
        lengths += [(start, held, False)] if held else []
        want |= {(sequence, i): x for i, x in enumerate(lengths)}
        cut = rng.randint(0, len(ids))
        np.array(ids[:cut], "<u2").tofile(tmp_path / f"part-{sequence:05d}-x-c000.txt")
        np.array(ids[cut:], "<u2").tofile(tmp_path / f"part-{sequence:05d}-x-c001.txt")
    got = {(r.sequence, r.ordinal): (r.start, r.n_tokens, r.ended) for r in token_counts.count_tokens(spark, str(tmp_path), block).collect()}
    assert got == want


def test_edge_rows(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 2), (3, "a b", 3), (3, "a b", 3), (None, "x", 4), (4, "word " * 200_000, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, ordinal long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_document_tokens(docs, *files).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 200_001)]
    assert token_counts.count_document_tokens(docs.filter("doc_id > 99"), *files).collect() == []
