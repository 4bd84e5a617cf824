"""Repeated passages by relative Lempel-Ziv parsing against an index of every block.

Documents are packed into blocks of some megabytes.  Every block is a
reference: its phrases of `window` words are indexed by (document, start), and
every document is parsed greedily against the index of all blocks.  A factor is
a longest run of phrases that continue one earlier place; phrases that begin
inside a factor and end behind it are looked up too, so nothing that straddles a
factor's boundary is missed.  Factors are `window` words or longer by
construction, and are the duplicate spans.

Only phrases that can repeat are indexed.  A phrase's least hashed `seed`-gram
(its minimiser) is the same wherever the phrase is, so phrases whose
minimiser is at one place of the corpus are new.  Both look-ups go as
packed arrays from blocks to parts of the hash range and back, one entry for a
block and value, so that a passage in a third of all documents costs an entry a
block and not one a copy.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.words import U64, gram_hashes, utf8, word_bounds, word_hashes

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class SubstringDedup:
    """window: words of a phrase.  seed: words of a minimiser.  block: bytes of text in a block."""

    window: int = 20
    seed: int = 8
    block: int = 12 << 20


def _pack(p: SubstringDedup):
    """Rows of whole documents, sorted by doc_id, in one compressed Arrow stream for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("doc_id")
            out = io.BytesIO()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.large_binary())], names=["docs"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                held.append(part)
                size += len(utf8(part.column("text"))[0])
                if size >= p.block:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


class Block:
    """One block's words, minimisers and phrases."""

    def __init__(self, data: bytes, p: SubstringDedup):
        self.p, self.table = p, pa.ipc.open_stream(data).read_all()
        self.raw, self.offsets = utf8(self.table.column("text"))
        starts, ends, self.first = word_bounds(self.raw, self.offsets)
        self.words = word_hashes(self.raw, starts, ends)
        self.n_words = np.diff(self.first)
        self.doc_id = self.table.column("doc_id").fill_null(NO_ID).to_numpy()
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        here = np.arange(len(self.words))
        at = np.flatnonzero(here + p.window <= self.first[doc + 1]) if len(here) else here
        self.at, self.doc = at, doc[at] if len(at) else at  # first word and document of every phrase
        seeds = gram_hashes(self.words, p.seed)
        self.least = _sliding(seeds, p.window - p.seed + 1, np.minimum)[at] if len(at) else seeds[:0]
        step = np.flatnonzero(np.append(True, self.least[1:] != self.least[:-1])) if len(at) else at
        self.runs, self.values = np.diff(np.append(step, len(at))), self.least[step]
        self.anchors, self.inverse = np.unique(self.values, return_inverse=True)
        # Places of a minimiser: seeds that equal the largest minimum of the phrases they are in.
        each = np.zeros(len(self.words) + p.window, dtype=U64)
        each[at + p.window - p.seed] = self.least
        highest = _sliding(each, p.window - p.seed + 1, np.maximum)[: len(seeds)]
        places = seeds[(seeds == highest[: len(seeds)]) & (highest > 0)]
        self.local = np.bincount(np.searchsorted(self.anchors, places), minlength=len(self.anchors)) > 1

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phrases whose minimiser repeats: their indices, their hashes' first entries and the entry of each."""
        keep = np.repeat((shared | self.local)[self.inverse], self.runs)
        some = np.flatnonzero(keep)
        if not len(some):
            return some, some, some, np.zeros(0, U64)
        hashes = gram_hashes(self.words, self.p.window)[self.at[some]]
        order = None
        if len(np.unique(self.doc_id)) < len(self.doc_id):  # rows that repeat a doc_id: in the order of starts
            order = np.lexsort((self.start(some), self.doc_id[self.doc[some]]))
            hashes = hashes[order]
            some = some[order]
        value, first, entry = np.unique(hashes, return_index=True, return_inverse=True)
        return some, first, entry, value

    def start(self, phrases: np.ndarray) -> np.ndarray:
        return self.at[phrases] - self.first[self.doc[phrases]]


def _sliding(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """of(x[i], ..., x[i + n - 1]) for every i."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash range that a value falls into, 0 to parts - 1; not decreasing in the value."""
    return ((values >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _loosen(data: bytes, *types: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, out, i = len(raw) // sum(np.dtype(t).itemsize for t in types), [], 0
    for t in types:
        out.append(np.frombuffer(raw, dtype=t, count=n, offset=i))
        i += n * np.dtype(t).itemsize
    return out


def _slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of a sorted array."""
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else part
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(part[a]), int(a), int(b)


def _messages(rows: list[tuple[int, int, bytes]], names: list[str]) -> pa.RecordBatch:
    a, b, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(data, pa.binary())], names=names)


def _ask_anchors(p: SubstringDedup, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, data in zip(batch.column("block"), batch.column("docs"), strict=True):
                block = Block(data.as_py(), p)
                yield _messages([(k, block_id.as_py(), _squeeze(block.anchors[a:b])) for k, a, b in _slices(_part(block.anchors, parts))], ["part", "block", "data"])

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each block, which of its minimisers another block has."""
    got = [_loosen(x.as_py(), U64)[0] for x in table.column("data")]
    _, inverse, n = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    often = np.split(n[inverse] > 1, np.cumsum([len(g) for g in got])[:-1])
    return pa.table({"block": table.column("block"), "part": table.column("part"), "data": pa.array([_squeeze(x.astype(np.uint8)) for x in often], pa.binary())})


def _shared(messages: list[dict], block: Block) -> np.ndarray:
    found = [_loosen(m["data"], np.uint8)[0] for m in sorted((m for m in messages if not m["phrases"]), key=lambda m: m["part"])]
    return np.concatenate(found).astype(bool) if found else block.local[:0]


def _entries(block: Block, messages: list[dict], parts: int):
    """Candidate phrases of a block and, for the first of each value, the order in which parts are asked."""
    some, first, entry, value = block.candidates(_shared(messages, block))
    leads = some[first]
    part = _part(block.least[leads], parts)
    order = np.lexsort((leads, part))
    return some, entry, value[order], leads[order], part[order], order


def _ask_phrases(p: SubstringDedup, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch.column("docs")[row].as_py(), p)
                _, _, value, leads, part, _ = _entries(block, batch.column("messages")[row].as_py() or [], parts)
                doc, start = block.doc_id[block.doc[leads]], block.start(leads).astype(np.int32)
                yield _messages([(k, batch.column("block")[row].as_py(), _squeeze(value[a:b], doc[a:b], np.diff(start[a:b], prepend=np.int32(0)))) for k, a, b in _slices(part)], ["part", "block", "data"])

    return run


def _answer_phrases(table: pa.Table) -> pa.Table:
    """For each block, the first place in the corpus of each of its phrases."""
    got = [_loosen(x.as_py(), U64, np.int64, np.int32) for x in table.column("data")]
    value, doc = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    start = np.concatenate([np.cumsum(g[2], dtype=np.int32) for g in got])
    order = np.lexsort((start, doc, value))
    new = np.append(True, value[order][1:] != value[order][:-1])
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = np.empty(len(order), dtype=np.int64)
    first[order] = lead
    cuts = np.cumsum([len(g[0]) for g in got])[:-1]
    out = [_squeeze(d, s) for d, s in zip(np.split(doc[first], cuts), np.split(start[first] - start, cuts), strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "data": pa.array(out, pa.binary())})


def _parsed(block: Block, messages: list[dict], parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which words factors cover, and the factors: document, start, words, earlier document, earlier start."""
    covered = np.zeros(len(block.words) + 1, dtype=np.int64)
    some, entry, _, leads, _, order = _entries(block, messages, parts)
    if not len(some):
        return covered[:-1] > 0, [np.zeros(0, dtype=np.int64)] * 5
    found = [_loosen(m["data"], np.int64, np.int32) for m in sorted((m for m in messages if m["phrases"]), key=lambda m: m["part"])]
    ref_doc, ref_start = np.empty(len(leads), dtype=np.int64), np.empty(len(leads), dtype=np.int64)
    ref_doc[order] = np.concatenate([f[0] for f in found])
    ref_start[order] = np.concatenate([f[1] for f in found]) + block.start(leads)
    place = np.argsort(some, kind="stable")
    some, entry = some[place], entry[place]
    doc, start = block.doc[some], block.start(some)
    old = (ref_doc[entry] != block.doc_id[doc]) | (ref_start[entry] != start)
    some, doc, start, ref_doc, ref_start = some[old], doc[old], start[old], ref_doc[entry][old], ref_start[entry][old]
    covered[: len(block.words)] += np.bincount(block.at[some], minlength=len(block.words))
    covered -= np.bincount(block.at[some] + block.p.window, minlength=len(covered))
    joint = (np.diff(some) == 1) & (np.diff(doc) == 0) & (np.diff(ref_doc) == 0) & (np.diff(ref_start) == 1)
    head = np.flatnonzero(np.append(True, ~joint)) if len(some) else some
    length = np.diff(np.append(head, len(some))) + block.p.window - 1
    return np.cumsum(covered[:-1]) > 0, [doc[head], start[head], length, ref_doc[head], ref_start[head]]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, longest_factor long"
KEPT = "doc_id long, kept string"
FACTORS = "doc_id long, start long, n_words long, ref_doc_id long, ref_start long"


def _report(p: SubstringDedup, parts: int, schema: str):
    def rows(block: Block, messages: list[dict]) -> pa.RecordBatch:
        covered, (doc, start, length, ref_doc, ref_start) = _parsed(block, messages, parts)
        ids = block.table.column("doc_id").combine_chunks()
        if schema == FACTORS:
            ref = pa.array(ref_doc, mask=ref_doc == NO_ID)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), ref, pa.array(ref_start)], names=["doc_id", "start", "n_words", "ref_doc_id", "ref_start"])
        kept = []
        for i in range(len(ids)):
            words = split_words(block, i)
            kept.append(b" ".join(compress(words, ~covered[block.first[i] : block.first[i + 1]])))
        if schema == KEPT:
            return pa.RecordBatch.from_arrays([ids, pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "kept"])
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), block.first[:-1]) * (block.n_words > 0) if len(ids) else np.zeros(0, np.int64)
        longest = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(longest, doc, length)
        columns = [block.n_words, removed, [hashlib.sha256(k).hexdigest() for k in kept], np.bincount(doc, minlength=len(ids)), longest]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "longest_factor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield rows(Block(batch.column("docs")[row].as_py(), p), batch.column("messages")[row].as_py() or [])

    return run


def split_words(block: Block, i: int) -> list[bytes]:
    """A document's words, unchanged."""
    return block.raw[block.offsets[i] : block.offsets[i + 1]].tobytes().split()


def parse(docs: DataFrame, params: SubstringDedup = SubstringDedup(), result: str = RESULT) -> DataFrame:
    """Parses docs(doc_id, text, ...) against itself; result is one of RESULT, KEPT and FACTORS.

    A phrase repeats an earlier one if its words are the same and the earlier
    one's doc_id is smaller, or the same with an earlier start.  Words are runs
    of bytes other than space and 0x09-0x0D, unchanged.  Phrases are judged on
    the input; covered words go, the rest is joined by one space.

    A null text has no words.  Rows that repeat a doc_id are one document for
    the order of phrases (repeats with equal starts don't remove each other),
    and each has a row in the result; a null doc_id is smaller than any other.
    Further columns are ignored, an empty table gives an empty result.
    """
    scratch, p = Scratch(docs.sparkSession, "substring"), params
    packed = docs.select("doc_id", "text").mapInArrow(_pack(p), "docs binary")
    packed = scratch.write(packed.select(F.monotonically_increasing_id().alias("block"), "docs"), "packed")
    parts = max(1, packed.count())
    message = "part long, block long, data binary"
    answers = packed.mapInArrow(_ask_anchors(p, parts), message).groupBy("part").applyInArrow(_answer_anchors, "block long, part long, data binary")
    answers = scratch.write(answers.withColumn("phrases", F.lit(False)), "anchors")

    def with_messages(messages: DataFrame) -> DataFrame:
        held = messages.groupBy("block").agg(F.collect_list(F.struct("phrases", "part", "data")).alias("messages"))
        return packed.join(held, "block", "left")

    phrases = with_messages(answers).mapInArrow(_ask_phrases(p, parts), message).groupBy("part").applyInArrow(_answer_phrases, "block long, part long, data binary")
    phrases = scratch.write(phrases.withColumn("phrases", F.lit(True)), "phrases")
    return with_messages(answers.unionByName(phrases)).mapInArrow(_report(p, parts, result), result)
