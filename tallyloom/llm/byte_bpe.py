"""Byte-level BPE over whole texts, merged through a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.words import small_parts

#: Space-delimited pieces whose ids a Python worker remembers; the memory is emptied when full, results don't depend on it.
REMEMBERED = 200_000
#: Longer pieces are encoded each time.
REMEMBERED_LENGTH = 64
#: Bytes of text whose new pieces are encoded together.
GROUP = 4 << 20
#: A space after white space: there the text can't be cut into pieces that match on their own.
_RUN = re.compile(r"[\s\x1c-\x1f\x85\xa0] ")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and decimal ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of linked-list positions by merge rank, and bitmaps of the ranks that have one on three levels of 64 bits."""

    def __init__(self):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.top, self.middle, self.low = 0, {}, {}

    def __bool__(self) -> bool:
        return self.top > 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, a, b in zip(ranks[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[a:b])
                continue
            self.buckets[rank] = [positions[a:b]]
            word, block = rank >> 6, rank >> 12
            self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
            self.middle[block] = self.middle.get(block, 0) | 1 << (word & 63)
            self.top |= 1 << block

    def pop(self) -> tuple[int, np.ndarray]:
        """The least rank, which the lowest set bits lead to, and its positions from left to right."""
        block = (self.top & -self.top).bit_length() - 1
        bits = self.middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.low[word] = bits & bits - 1
        if not self.low[word]:
            self.middle[block] &= ~(1 << (word & 63))
            if not self.middle[block]:
                self.top &= ~(1 << block)
        return rank, np.unique(np.concatenate(self.buckets.pop(rank)))


class ByteBpe:
    """Encoder and decoder for one vocabulary and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [str(i) for i in range(size)]
        self.length = np.array([len(t) for t in self.token])
        self.byte = np.array([ranks[bytes([i])] for i in range(256)])
        # Every way to put a token together from two others: which pair has which rank.
        pairs = sorted((left << 32 | right, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None)
        self.pair, self.pair_rank = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, end to end, and where each one's begin (one more place than pieces).

        All pieces are one linked list with gaps, and one queue serves them:
        they don't touch each other, and each sees its own ranks in order.  The
        positions of a rank are merged together, of overlapping ones every
        other from the left.  Entries aren't taken out when a neighbour is
        merged: an entry whose pair has another length by now is stale and
        skipped.  A pre-token that is a token is that token.
        """
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        first = np.cumsum([0, *map(len, pieces)])
        token = np.append(self.byte[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = first[1:][np.diff(first) > 0]
        after[ends - 1] = n
        before = np.append(before[:n], n)
        before[first[:-1][np.diff(first) > 0]] = n

        whole = [self.ranks.get(x, -1) for x in pieces]
        done = np.array([k for k, r in enumerate(whole) if r >= 0], dtype=np.int64)
        if len(done):
            inside = np.repeat(np.isin(np.arange(len(pieces)), done), np.diff(first))
            token[:n][inside] = -1
            token[first[done]] = [whole[k] for k in done]
            after[:n][inside] = n

        queue = RankQueue()

        def look(at: np.ndarray) -> None:
            at = at[(after[at] < n) & (token[at] >= 0)]
            rank = self.rank_of(token[at], token[after[at]])
            queue.push(rank[rank >= 0], at[rank >= 0])

        look(np.arange(n))
        while queue:
            rank, at = queue.pop()
            second = after[at]
            fresh = (token[at] >= 0) & (second < n) & (self.length[token[at]] + self.length[token[second]] == self.length[rank])
            at, second = at[fresh], second[fresh]
            if not len(at):
                continue
            chained = np.append(False, second[:-1] == at[1:])
            if chained.any():
                place = np.arange(len(at))
                place -= np.maximum.accumulate(np.where(chained, 0, place))
                at, second = at[place % 2 == 0], second[place % 2 == 0]
            third = after[second]
            token[at], token[second] = rank, -1
            after[at] = third
            before[third] = at
            left = before[at]
            look(np.concatenate([at, left[left < n]]))
        alive = np.flatnonzero(token[:n] >= 0)
        return token[alive], np.searchsorted(alive, first)

    def encode(self, text: str) -> list[int]:
        return self.merge([x.encode() for x in self.find(text)])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Remembering:
    """Ids, as decimal text, and decoded bytes of whole texts; pieces between spaces are encoded when they are new."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def encode(self, segments: list[str]) -> tuple[list[str], list[bytes]]:
        found = [self.bpe.find(s) for s in segments]
        ids, first = self.bpe.merge([x.encode() for pieces in found for x in pieces])
        cuts = first[np.cumsum([0, *map(len, found)])].tolist()
        decimal, token = (list(map(x.__getitem__, ids.tolist())) for x in (self.bpe.decimal, self.bpe.token))
        both = list(zip(cuts[:-1], cuts[1:], strict=True))
        return [" ".join(decimal[a:b]) for a, b in both], [b"".join(token[a:b]) for a, b in both]

    def texts(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        # Between a character that isn't white space and a space the pattern always ends a match.
        split = [[t] if _RUN.search(t) else t.split(" ") for t in texts]
        used = {w for words in split for w in words[1:]}
        new = [w for w in used if w not in self.ids]
        if len(self.ids) + len(new) > REMEMBERED:
            self.ids.clear()
            self.decoded.clear()
            new = list(used)
        ids, decoded = self.encode([f" {w}" for w in new])
        self.ids.update(zip(new, ids, strict=True))
        self.decoded.update(zip(new, decoded, strict=True))
        for words, ids, decoded in zip(split, *self.encode([words[0] for words in split]), strict=True):
            rest = words[1:]
            yield " ".join(([ids] if ids else []) + list(map(self.ids.__getitem__, rest))), b"".join([decoded, *map(self.decoded.__getitem__, rest)])
        for w in new:
            if len(w) > REMEMBERED_LENGTH:
                del self.ids[w], self.decoded[w]


_LOADED: dict[tuple[str, str], Remembering] = {}


def _encoder(path: str, pattern: str) -> Remembering:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Remembering(ByteBpe(load_ranks(path), pattern))
    return _LOADED[path, pattern]


def _encoded(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[str, bytes]]]]:
    encoder = _encoder(path, pattern)
    for batch in batches:
        for part in small_parts(batch, 10_000, GROUP):
            yield part.column("doc_id"), list(encoder.texts(part.column("text").fill_null("").to_pylist()))


def _digests(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, found in _encoded(path, pattern, batches):
        n = pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in found], pa.int64())
        ids = pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in found], pa.string())
        decoded = pa.array([hashlib.sha256(text).hexdigest() for _, text in found], pa.string())
        yield pa.RecordBatch.from_arrays([doc_id, n, ids, decoded], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_id, found in _encoded(path, pattern, batches):
        ids = pa.array([[int(x) for x in ids.split()] for ids, _ in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([doc_id, ids, pa.array([text for _, text in found], pa.binary())], names=["doc_id", "ids", "decoded"])


def _over_texts(docs: DataFrame, run: Callable, schema: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> and decoded binary (the ids decoded again) of every row of docs(doc_id, text, ...).

    Each match of `pattern` is encoded on its own by the ranks in `path`,
    without special tokens.  A null text is taken as empty and has no ids.
    Rows are independent: repeated rows are each encoded, further columns are
    ignored, an empty table gives an empty result.
    """
    return _over_texts(docs, partial(_ids, path, pattern), "doc_id long, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_documents gives, digested in the task that made it.

    ids_sha256 is over the decimal ids joined by one space; no ids are moved or stored.
    """
    return _over_texts(docs, partial(_digests, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
