"""Operator 6: SentencePiece BPE ids through a merge-type prefix table, and decoding.

BPE never merges across a boundary of its result, so each run of its tokens is the encoding of that run's text, and a
sequence is an encoding exactly if each pair of neighbours is (the pair's text encodes to that pair). Hence a prefix has
one possible last token: the token that ends there, found by an automaton over all pieces, whose start has a last token
that is compatible with it. The table keeps that token for each prefix and the ids are read off it backwards. Whether
two pieces are compatible is found once by merging their characters, and kept.

The space is a symbol that no piece has after another character, so a text is cut before each run of spaces and its
parts are encoded apart; recent parts are kept in a bounded cache of the worker. Characters without a piece become
their bytes' pieces.

Defined results: a null or empty text gives the end id alone and decodes to the empty text; a repeated row repeats its
result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import once
from .common import blocks, map_arrow, table, text_bytes

SPACE = "▁"
#: Parts that each of a worker's two generations keeps, and pairs of pieces whose compatibility is kept.
CACHE_PARTS, CACHE_PAIRS = 250_000, 1_000_000
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


#: Parts longer than this are encoded one by one, so that a table's rounds stay few.
PART_CHARACTERS = 60
#: Slots of the table of pairs, a power of two.
PAIR_SLOTS = 1 << 21


class PartIds:
    """Recent parts' ids in two generations: when the younger is full it becomes the older, from which parts in use come back."""

    def __init__(self) -> None:
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def missing(self, parts: set[str]) -> list[str]:
        if len(self.young) > CACHE_PARTS:
            self.old, self.young = self.young, {}
        new = parts.difference(self.young)
        back = new.intersection(self.old)
        self.young.update(zip(back, map(self.old.__getitem__, back), strict=True))
        return list(new - back)


class PieceBpe:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback, no normalisation and a leading space added."""

    def __init__(self, model_path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model without normalisation is needed")
        self.piece = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces with a space after another character")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.end_id = model.trainer_spec.eos_id
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("pieces with a character that is no piece")
        self.text = [None if p.type == 6 else "" if p.type in (2, 3) else p.piece.replace(SPACE, " ") for p in model.pieces]
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, i in self.id.items():
            self.matches.add_word(text, len(text) << 16 | i)
        self.matches.make_automaton()
        self.alone = np.zeros(len(self.piece), bool)
        for text, i in self.id.items():
            self.alone[i] = len(text) == 1 or self.merge(text) == [text]
        self.pairs: dict[int, bool] = {}
        self.pair_key, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.cache = PartIds()

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored merge of neighbours, the left one of equals, again and again."""
        symbol, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(-self.score[x], i, x) for i in range(len(text) - 1) if (x := text[i : i + 2]) in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j >= len(text) or symbol[i] + symbol[j] != merged:
                continue
            symbol[i], symbol[j], after[i] = merged, "", after[j]
            if after[i] < len(text):
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else len(text)
                if right < len(text) and (x := symbol[left] + symbol[right]) in self.score:
                    heapq.heappush(heap, (-self.score[x], left, x))
        return [x for x in symbol if x]

    def compatible(self, pair: int) -> bool:
        """Whether the two pieces of ``left << 16 | right`` encode to themselves when they stand together."""
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.piece[pair >> 16], self.piece[pair & 0xFFFF]
            found = self.pairs[pair] = self.merge(a + b) == [a, b]
        return found

    def compatible_pairs(self, pairs: np.ndarray) -> np.ndarray:
        slot = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        fits = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_key[slot] != pairs)
        if len(new):
            kinds, which = np.unique(pairs[new], return_inverse=True)
            found = np.array([self.compatible(x) for x in kinds.tolist()], bool)[which]
            fits[new] = found
            self.pair_key[slot[new]], self.pair_fits[slot[new]] = pairs[new], found
            self.pair_fits[slot[new]] = [self.pairs[x] if x in self.pairs else self.compatible(x) for x in self.pair_key[slot[new]].tolist()]
        return fits

    def encode_part(self, part: str) -> tuple[int, ...]:
        """The prefix table of one part, then its ids backwards. ``last[i]``: the last token of the first ``i`` characters."""
        last, length = [-2] * (len(part) + 1), [1] * (len(part) + 1)
        for end, match in self.matches.iter(part):
            size, token = match >> 16, match & 0xFFFF
            start = end + 1 - size
            if last[end + 1] >= 0 or not self.alone[token]:
                continue
            if start == 0 or last[start] == -2 or self.compatible(last[start] << 16 | token):
                last[end + 1], length[end + 1] = token, size
        ids: list[int] = []
        at = len(part)
        while at:
            ids.extend([last[at]] if last[at] >= 0 else (self.byte[b] for b in reversed(part[at - 1].encode())))
            at -= length[at]
        ids.reverse()
        return tuple(ids)

    def encode_parts(self, parts: list[str]) -> list[tuple[int, ...]]:
        """``encode_part`` of many parts that start with the space symbol and have no other: their tables grow together,
        by one character in each round. Parts that are long or have characters without a piece are done one by one."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(sizes) - sizes
        found = np.fromiter(chain.from_iterable(self.matches.iter("".join(parts))), np.int64).reshape(-1, 2)
        end, size, token = found[:, 0], found[:, 1] >> 16, found[:, 1] & 0xFFFF
        total = int(sizes.sum())
        without = np.ones(total, bool)
        without[end] = False
        own = np.repeat(np.arange(len(parts)), sizes)
        single = sizes > PART_CHARACTERS
        single[own[without]] = True
        held = self.alone[token] & ~single[own[end]]
        end, size, token = end[held], size[held], token[held]
        begin = end + 1 - size
        place = (end - starts[own[end]]).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        end, size, token, begin = end[order], size[order], token[order], begin[order]
        is_first = begin == starts[own[end]]
        upto = np.cumsum(np.bincount(place, minlength=1))
        last, length = np.full(total, -1, np.int64), np.zeros(total, np.int64)
        for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True):
            left = last[begin[a:b] - 1]
            fits = is_first[a:b].copy()
            test = np.flatnonzero(~fits & (left >= 0))
            fits[test] = self.compatible_pairs(left[test] << 16 | token[a:b][test])
            at = end[a:b][fits]
            last[at], length[at] = token[a:b][fits], size[a:b][fits]
        part = np.flatnonzero(~single)
        at, steps = starts[part] + sizes[part] - 1, []
        while len(part):
            steps.append((part, last[at]))
            at = at - length[at]
            more = at >= starts[part]
            part, at = part[more], at[more]
        owners = np.concatenate([p for p, _ in reversed(steps)]) if steps else np.empty(0, np.int64)
        ids = np.concatenate([t for _, t in reversed(steps)])[np.argsort(owners, kind="stable")].tolist() if steps else []
        upto = np.cumsum(np.bincount(owners, minlength=len(parts))).tolist()
        return [self.encode_part(x) if alone else tuple(ids[a:b]) for x, alone, a, b in zip(parts, single.tolist(), [0, *upto[:-1]], upto, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, without an end id."""
        split = [text.split(" ") for text in texts]
        new = self.cache.missing(set(chain.from_iterable(split)))
        plain = [x for x in new if x and SPACE not in x]
        self.cache.young.update(zip(plain, self.encode_parts([SPACE + x for x in plain]) if plain else (), strict=True))
        get, out = self.cache.young.__getitem__, []
        for text, parts in zip(texts, split, strict=True):
            try:
                out.append(list(chain.from_iterable(map(get, parts))))
            except KeyError:
                out.append(list(chain.from_iterable(self.encode_part(x) for x in _PART.findall(SPACE + text.replace(" ", SPACE)))) if text else [])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces in a row as UTF-8, control pieces as nothing, without the space that was added."""
        try:
            text = "".join(map(self.text.__getitem__, ids))
        except TypeError:  # byte pieces have no text of their own
            out, held = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                out.append(held.decode("utf-8", "replace"))
                held.clear()
                out.append(self.text[i])
            text = "".join(out) + held.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " and self.piece[ids[0]][:1] == SPACE else text


def _digests(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(PieceBpe, model_path)
        decimal = once(lambda n: [str(i) for i in range(n)], len(bpe.piece)).__getitem__
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for texts in blocks(batch.column(1).to_pylist()):
                for ids in bpe.encode([str(x, "utf-8", "replace") for x in texts]):
                    ids.append(bpe.end_id)
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(model_path: str, end: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(PieceBpe, model_path)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids = [x + [bpe.end_id] * end for x in bpe.encode([str(t, "utf-8", "replace") for t in texts])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                at += len(texts)

    return run


def _decoded(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(PieceBpe, model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))


def encode_texts(docs: DataFrame, model_path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> ``(doc_id, ids)``."""
    return map_arrow(_source(docs, id_col, text_col), _encoded(model_path, end), "doc_id long, ids array<int>")


def decode_ids(ids: DataFrame, model_path: str) -> DataFrame:
    """``ids(doc_id, ids)`` -> ``(doc_id, text)``."""
    return map_arrow(ids.select("doc_id", "ids"), _decoded(model_path), "doc_id long, text string")


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the digests of their ids and of the text that the ids decode to."""
    import public_tokenizers

    source = _source(table(spark, sf_dir, "documents"), "doc_id", "text")
    return map_arrow(source, _digests(public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op6_piece_bpe": op6_piece_bpe}
ORACLES: dict[str, str] = {}
