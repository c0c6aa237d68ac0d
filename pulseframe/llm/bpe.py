"""Byte-level BPE by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged, so it marks a certain cut. Two
kinds of such cuts are used. In the text, a cut lies wherever white space follows a character that isn't white space:
these pieces are encoded independently of each other and cached. In the bytes of a pre-token of a piece, a cut lies at
every pair that no token holds, and the fragments between are merged by themselves. Concatenating the fragments' ids
gives the ids of the whole text.

The tokenizer's file is a parameter; it is read once by each Python worker, which must reach the path. A null text
counts as empty and gives no ids; texts of any length are encoded whole, one at a time. Rows are independent, so
repeated rows and ties need no care, and an empty table gives an empty result. Only the columns asked for are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import released

#: Fixed value: the pattern by which byte-level tokenizers of this family split text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by some definitions only; texts with these are split by PRETOKEN alone.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
PIECE = re.compile(r"\s*\S+|\s+")
CACHED_PIECES, CACHED_LENGTH = 400_000, 48
NEVER = (1 << 60, -1)
SLICE = 256  #: rows handed on at once
SHORT = 24  #: fragments up to this length are merged by scanning, longer ones with a heap


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens with rules of their own: {path}")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token[i] = token.encode() if token in self.special else bytes(byte_of[c] for c in token)
        self.byte_id = [vocab[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        for content, i in self.special.items():
            self.token[i] = content.encode()
        inside = np.zeros(1 << 16, bool)
        for token, i in vocab.items():
            if token not in self.special:
                t = self.token[i]
                for x, y in zip(t, t[1:]):
                    inside[x << 8 | y] = True
        self.inside = inside.tolist()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.pieces = _Cache(self.piece, CACHED_PIECES)
        self.parts = _Cache(lambda fragment: tuple(self.merged(fragment)), CACHED_PIECES)
        # True of vocabularies whose spaces only lead: then white space after anything else is a cut.
        self.whole_pieces = not any(inside[b << 8 | 32] for b in range(256) if not chr(b).isspace())

    def fragments(self, data: bytes) -> list[bytes]:
        inside, begin, found, last = self.inside, 0, [], data[0]
        for i, byte in enumerate(data):
            if i and not inside[last << 8 | byte]:
                found.append(data[begin:i])
                begin = i
            last = byte
        found.append(data[begin:])
        return found

    def merged(self, data: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in data]
        if len(ids) > SHORT:
            return self._merged_long(ids)
        get = self.merges.get
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]  # (rank, new id) of each pair
        while ranks and (best := min(ranks)) is not NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], best[1]), NEVER)
            if i < len(ranks):
                ranks[i] = get((best[1], ids[i + 1]), NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of (rank, place) over a linked list."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[i]]))
            if (k := before[i]) >= 0 and (m := merges.get((ids[k], new))):
                heapq.heappush(heap, (m[0], k, m[1], ids[k], new))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        ids = array("i")
        for word in self.pretoken.findall(text):
            for fragment in self.fragments(word.encode()):
                ids.extend(self.parts[fragment])
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        parts = self.specials.split(text) if self.specials else [text]
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(np.array([self.special[part]], "<i4").tobytes())
            elif part:
                cut = PIECE if self.whole_pieces and not ODD_SPACE.search(part) else self.pretoken
                out.append(b"".join(map(self.pieces.__getitem__, cut.findall(part))))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


class _Cache(dict):
    """Results for keys seen; emptied when full, so memory is bounded whatever the texts hold."""

    def __init__(self, make: Callable, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[key] = found
        return found


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The last column, text, becomes ids; the others stay."""
    c = codec(path)
    for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
        found = [c.encode(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
        offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])


def _id_arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(ends, ends[1:]):
        yield values[a:b]


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Adds the text of the last column, ids."""
    c = codec(path)
    for batch in batches:
        texts = pa.array([c.decode(x) for x in _id_arrays(batch.column(batch.num_columns - 1))], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., ids, decoded) -> (..., n_tokens, ids_sha256, decoded_sha256)."""
    for batch in batches:
        *kept, ids, decoded = batch.columns
        arrays = list(_id_arrays(ids))
        digests = [[len(x) for x in arrays], [hashlib.sha256(x.astype("<u4")).hexdigest() for x in arrays], [hashlib.sha256(x.as_py().encode()).hexdigest() for x in decoded]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digests[0], pa.int64()), pa.array(digests[1], pa.string()), pa.array(digests[2], pa.string())], names=[*batch.schema.names[:-2], "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids array<int>."""
    asked = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])
    return asked.mapInArrow(lambda batches: encode_batches(batches, path), f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, ids and decoded."""
    asked = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInArrow(lambda batches: decode_batches(batches, path), f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, in one pass."""
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = lambda batches: digest_batches(decode_batches(encode_batches(batches, path), path))
    return asked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep`, ids, n_tokens, and digests as in round_trip, in one pass."""
    asked = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoded in encode_batches(batches, path):
            for told in digest_batches(decode_batches([encoded], path)):
                n = encoded.num_columns
                yield pa.RecordBatch.from_arrays([*encoded.columns, *told.columns[n - 1 :]], names=[*encoded.schema.names, *told.schema.names[n - 1 :]])

    return asked.mapInArrow(lambda batches: released(run(batches)), f"{schema}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
