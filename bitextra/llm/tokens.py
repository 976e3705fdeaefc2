"""Token ids of whole texts with a public byte-level BPE vocabulary.

A text is encoded as a tree: halves are encoded by themselves, down to leaves the tokenizer takes at once, and joined
upwards.  ``join`` is associative: it re-encodes a window around the seam and lets it grow until the words on both
sides provably stay as they are.  What makes that provable: words (the units that merges never cross) are matched from
left to right without looking back, and a match depends on no more than two characters after its end.  So a word start
of the left part stands if two of the part's characters follow it, and once the window's words meet a word start of
the right part, everything after it is as it was.  Decoding concatenates the bytes of the tokens up the tree.

Ids of a null text are null, of an empty one the empty list.  No special tokens are added or recognised.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: where the vocabulary files are; a parameter of every query on tokens
TOKENIZERS = os.environ.get("BITEXTRA_TOKENIZERS", "/opt/tokenizers")
#: characters that are handed to the tokenizer at once
LEAF = 4096
#: fixed value: the word pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """A vocabulary of byte ranks."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.words = regex.compile(PATTERN)
        self.width = np.zeros(max(table.values()) + 1, np.int64)
        for piece, rank in table.items():
            self.width[rank] = len(piece)

    def direct(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self.direct(text) if len(text) <= leaf else self.tree(text, leaf).ids

    def tree(self, text: str, leaf: int = LEAF) -> Part:
        """Encode halves and join them."""
        if len(text) <= max(leaf, 1):
            return self.leaf(text)
        mid = len(text) // 2
        return self.join(self.tree(text[:mid], leaf), self.tree(text[mid:], leaf))

    def leaf(self, text: str) -> Part:
        ids = self.direct(text)
        starts = [m.start() for m in self.words.finditer(text)]
        if text.isascii():
            at = np.array(starts, np.int64)
        else:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.concatenate([[0], np.cumsum(size)])[starts]
        edges = np.concatenate([[0], np.cumsum(self.width[ids])])
        return Part(text, ids, starts, np.searchsorted(edges, at).tolist())

    def join(self, left: Part, right: Part) -> Part:
        """Two neighbouring parts as one: the parts' own ids outside a window around the seam."""
        if not left.text or not right.text:
            return left if left.text else right
        mid, text = len(left.text), left.text + right.text
        # the last word start of the left part that two of its characters follow
        k = bisect_left(left.starts, mid - 1) - 1
        k = max(k, 0)
        p = left.starts[k]
        reach = 32
        while True:
            end = min(len(text), mid + reach)
            found = [p + m.start() for m in self.words.finditer(text[p:end])]
            sure = end if end == len(text) else end - 2
            for n, b in enumerate(found):
                if b < mid or b > sure:
                    continue
                j = bisect_left(right.starts, b - mid)
                if j < len(right.starts) and right.starts[j] == b - mid:
                    inside = found[:n]
                    stop, tail = b, j
                    break
            else:
                if end < len(text):
                    reach *= 2
                    continue
                inside, stop, tail = found, len(text), len(right.starts)
            break
        ids, firsts, n = [left.ids[: left.firsts[k]]], [], left.firsts[k]
        for a, b in zip(inside, [*inside[1:], stop]):
            piece = self.direct(text[a:b])
            firsts.append(n)
            n += len(piece)
            ids.append(piece)
        after = right.firsts[tail] if tail < len(right.firsts) else len(right.ids)
        ids.append(right.ids[after:])
        return Part(
            text, np.concatenate(ids),
            left.starts[:k] + inside + [mid + s for s in right.starts[tail:]],
            left.firsts[:k] + firsts + [n + f - after for f in right.firsts[tail:]],
        )

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ``ids``: halves decoded to bytes and concatenated up the tree."""

        def bytes_of(part) -> bytes:
            if len(part) <= LEAF:
                return self.bpe.decode_bytes(part)
            mid = len(part) // 2
            return bytes_of(part[:mid]) + bytes_of(part[mid:])

        return bytes_of(list(ids)).decode("utf-8", errors="replace")


@dataclass
class Part:
    """An encoded stretch: ids, the word starts in it, and the token each word begins with."""

    text: str
    ids: np.ndarray
    starts: list[int]
    firsts: list[int]


_LOADED: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    key = hash(ranks)
    if key not in _LOADED:
        _LOADED[key] = Encoder(ranks)
    return _LOADED[key]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    with open(f"{folder or TOKENIZERS}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode(df: DataFrame, key: str, text: str = "text", vocab: bytes | None = None, counts_only: bool = False) -> DataFrame:
    """``key`` with ids (array<int>), or with tokens (their number; null for null) where ``counts_only``.

    The vocabulary (under 1 MB) is read on the driver and broadcast; equal texts of a batch are encoded once.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocab or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for b in batches:
            coded = b.column(1).dictionary_encode()
            done = [enc.encode(t) for t in coded.dictionary.to_pylist()]
            size = np.array([len(x) for x in done], np.int64)
            null = np.asarray(coded.indices.is_null())
            at = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
            own = np.where(null, 0, size[at]) if len(done) else np.zeros(b.num_rows, np.int64)
            if counts_only:
                out = pa.array(own, mask=null)
            else:
                flat = np.concatenate([done[k] for k, gone in zip(at, null) if not gone]) if own.sum() else np.zeros(0)
                ends = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(null, False)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[key, "tokens" if counts_only else "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, " + ("tokens bigint" if counts_only else "ids array<int>"))


def decode(df: DataFrame, key: str, vocab: bytes | None = None) -> DataFrame:
    """``key`` with text, back from ids; null for null."""
    shared = df.sparkSession.sparkContext.broadcast(vocab or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for b in batches:
            out = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")
