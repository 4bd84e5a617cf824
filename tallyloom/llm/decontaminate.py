"""Benchmark decontamination by latent semantic retrieval and subsequence checks.

TF-IDF passages of the whole corpus are factored by a distributed randomised
SVD: every passage is multiplied by a sparse random sign matrix (one column and
sign for each passage), so a task adds up integers and the sums don't depend on
the order of tasks.  The left singular vectors of the summed sketch, divided by
their singular values, take words to latent vectors.  Windows of every text are
compared with all benchmark passages by cosine; candidates are kept if their
words hold the item's in order, wholly enough, and its ending, the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import U64, lower_texts, mix, utf8, word_bounds, word_hashes


@dataclass(frozen=True)
class Decontamination:
    """bits: log2 of hashed words.  passage: words of a passage of the factored matrix.  sketch, rank: columns of the sketch, latent dimensions.

    Every word has a weight, a lower one the more distinct passages have it.  cosine: candidates' least.  common: share of an item's words, in order, that
    a text must hold; with `answer` of its last words too, or `sure` of all.
    items: benchmark passages compared at a time, so that what tasks receive is
    bounded whatever the benchmark.  together: neighbouring windows whose words
    are looked at together first.
    """

    bits: int = 15
    passage: int = 64
    sketch: int = 80
    rank: int = 64
    step: int = 8
    windows: tuple[int, ...] = (16, 32, 64)
    longest: int = 60
    cosine: float = 0.45
    common: float = 0.65
    answer: float = 0.5
    sure: float = 0.85
    items: int = 20_000
    together: int = 8
    slices: int = 32


_WORD = np.full(256, 32, dtype=np.uint8)
_WORD[[*range(48, 58), *range(97, 123)]] = [*range(48, 58), *range(97, 123)]
_WORD[128:] = np.arange(128, 256)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits) of lower-cased texts, and each text's first."""
    data = _WORD[raw]
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _loosen(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.int64)


def _passages(p: Decontamination, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash and the word cells of each passage, equal ones once for some megabytes of text."""
    for batch in batches:
        for part, raw, offsets in lower_texts(batch, 4 << 20):
            words, first = _tokens(raw, offsets)
            if not len(words):
                continue
            place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
            head = np.flatnonzero(place % p.passage == 0)
            key = mix(np.add.reduceat(mix(words ^ mix((place % p.passage).astype(U64))), head))
            _, once = np.unique(key, return_index=True)
            cells = (words >> U64(64 - p.bits)).astype(np.uint32)
            size = np.diff(np.append(head, len(words)))[once]
            ends = np.append(0, np.cumsum(size))
            own = cells[np.arange(ends[-1]) + np.repeat(head[once] - ends[:-1], size)]
            data = pa.Array.from_buffers(pa.binary(), len(once), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), data], names=["passage", "cells"])


def _sketched(p: Decontamination, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of the words: passages that have a word, and its row of the sketch of counts."""
    size = 1 << p.bits
    total, df, n = np.zeros(size * p.sketch, dtype=np.int64), np.zeros(size, dtype=np.int64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.frombuffer(b"".join(batch.column("cells").to_pylist()), dtype=np.uint32).astype(np.int64)
        lengths = pc.binary_length(batch.column("cells")).to_numpy() // 4
        passage = np.repeat(np.arange(batch.num_rows), lengths)
        random = batch.column("passage").to_numpy().view(U64)  # by content: the same in every attempt
        column, sign = (random % U64(p.sketch)).astype(np.int64), 1.0 - 2.0 * (random >> U64(63)).astype(float)
        total += np.bincount(cell * p.sketch + column[passage], sign[passage], size * p.sketch).astype(np.int64)
        of_passage = np.full((batch.num_rows, p.passage), size, dtype=np.uint32)
        of_passage[passage, np.arange(len(cell)) - (np.cumsum(lengths) - lengths)[passage]] = cell
        of_passage.sort(axis=1)
        distinct = of_passage < size
        distinct[:, 1:] &= of_passage[:, 1:] != of_passage[:, :-1]
        df += np.bincount(of_passage[distinct], minlength=size)
        n += batch.num_rows
    if n:
        rows = size // p.slices
        data = [_squeeze(np.concatenate([[n], df[k * rows : (k + 1) * rows], total[k * rows * p.sketch : (k + 1) * rows * p.sketch]])) for k in range(p.slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(p.slices), pa.int32()), pa.array(data, pa.binary())], names=["slice", "data"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(_loosen(x.as_py()) for x in table.column("data"))
    return pa.table({"slice": table.column("slice").slice(0, 1), "data": pa.array([_squeeze(total)], pa.binary())})


def latent_words(docs: DataFrame, params: Decontamination = Decontamination()) -> np.ndarray | None:
    """A latent vector for every hashed word, from all distinct passages of docs; None if there are no words.

    2^bits times `rank` numbers, whatever the corpus.  Tasks' sums are added in
    two levels, so that no group holds all of them.
    """
    p = params
    passages = docs.select("text").mapInArrow(partial(_passages, p), "passage long, cells binary").distinct()
    parts = passages.mapInArrow(partial(_sketched, p), "slice int, data binary")
    parts = parts.withColumn("group", F.floor(F.sqrt(F.spark_partition_id())))  # n tasks: about sqrt(n) groups of at most 2 sqrt(n)
    parts = parts.groupBy("slice", "group").applyInArrow(_added, "slice int, data binary")
    found = sorted(parts.groupBy("slice").applyInArrow(_added, "slice int, data binary").collect())
    if not found:
        return None
    rows, sums = (1 << p.bits) // p.slices, [_loosen(r.data) for r in found]
    n = sums[0][0]
    df = np.concatenate([s[1 : 1 + rows] for s in sums])
    sketch = np.concatenate([s[1 + rows :].reshape(rows, p.sketch) for s in sums]).astype(float)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    u, s, _ = np.linalg.svd(sketch * idf[:, None], full_matrices=False)
    rank = max(1, min(p.rank, int((s > s[0] * 1e-9).sum())))
    return (idf[:, None] * u[:, :rank] / np.maximum(s[:rank], 1e-12)).astype(np.float32)


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of `words` and a text of n words whose places `masks` gives, by bits."""
    all_ones = (1 << n) - 1
    v = all_ones
    for w in words:
        m = masks.get(w)
        if m:
            x = v & m
            v = (v + x | v - x) & all_ones
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Benchmark:
    """Passages of benchmark items and their latent vectors, by the window they are compared with."""

    def __init__(self, rows: list, latent: np.ndarray, p: Decontamination):
        self.p, self.latent = p, latent
        self.items: list[tuple[int, list[int], dict, dict, int]] = []
        vectors, window = [], []
        raw, offsets = utf8(pc.utf8_lower(pa.array([r.text for r in rows], pa.large_string())))
        words, first = _tokens(raw, offsets)
        for r, a, b in zip(rows, first[:-1], first[1:], strict=True):
            pieces = max(1, -(-(b - a) // p.longest))
            for k in range(pieces):
                own = words[a + (b - a) * k // pieces : a + (b - a) * (k + 1) // pieces]
                if not len(own):
                    continue
                ending = own[-max(3, len(own) // 5) :].tolist()
                self.items.append((r.item_id, own.tolist(), _masks(own.tolist()), _masks(ending), len(ending)))
                vectors.append(latent[(own >> U64(64 - p.bits)).astype(np.int64)].sum(axis=0))
                window.append(min(range(len(p.windows)), key=lambda k: abs(np.log(p.windows[k] / len(own)))))
        self._count_rare()
        self.groups = []
        for k, w in enumerate(p.windows):
            own = [i for i, x in enumerate(window) if x == k]
            if own:
                v = np.stack([vectors[i] for i in own])
                self.groups.append((w, np.array(own), (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T.copy()))

    def _count_rare(self) -> None:
        """Words of few items with those items, and how many of them a region must hold at least if all other words of the item are there."""
        self.size = np.array([len(own) for _, own, *_ in self.items], dtype=np.int64)
        distinct = [np.unique(np.array(own, dtype=U64)) for _, own, *_ in self.items]
        item = np.repeat(np.arange(len(distinct)), [len(x) for x in distinct])
        word = np.concatenate([np.zeros(0, dtype=U64), *distinct])
        order = np.argsort(word, kind="stable")
        word, item = word[order], item[order]
        vocabulary, start, count = np.unique(word, return_index=True, return_counts=True)
        few = count <= max(3, len(distinct) // 50)
        self.rare, self.rare_start, self.rare_count, self.rare_item = vocabulary[few], start[few], count[few], item
        often = np.array([len(own) - int(np.isin(np.array(own, dtype=U64), self.rare).sum()) for _, own, *_ in self.items], dtype=np.int64)
        self.need = self.p.common * self.size - often - 1e-9

    def _rare_places(self, words: np.ndarray) -> np.ndarray:
        """item * 2^40 + place of all rare words of items, sorted."""
        if not len(self.rare):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.rare, words), len(self.rare) - 1)
        place = np.flatnonzero(self.rare[at] == words)
        at = at[place]
        count = self.rare_count[at]
        ends = np.append(0, np.cumsum(count))
        entry = np.arange(ends[-1]) + np.repeat(self.rare_start[at] - ends[:-1], count)
        return np.sort(self.rare_item[entry] << 40 | np.repeat(place, count))

    def margin(self, item, width):
        """Words on both sides of a window that are searched with it."""
        return self.p.step + self.size[item] // 4 + np.maximum(0, self.size[item] - width)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Text, item passage, width, first words and cosines of neighbouring windows from the threshold on, unless too few rare words are near them all for the item's share in common."""
        p = self.p
        places = self._rare_places(words)
        place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
        head = np.flatnonzero(place % p.step == 0)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[head]
        size = 4096
        reach = max(p.windows) // p.step
        for i in range(0, len(head), size):
            own, ahead = min(size, len(head) - i), min(size + reach, len(head) - i)
            last = head[i + ahead] if i + ahead < len(head) else len(words)
            cells = (words[head[i] : last] >> U64(64 - p.bits)).astype(np.int64)
            v = np.add.reduceat(self.latent[cells], head[i : i + ahead] - head[i], axis=0)
            owner, have = text[i : i + ahead], 1
            for w, items, vectors in self.groups:
                while have * p.step < w:
                    same = owner[:-have] == owner[have:]
                    longer = v.copy()
                    longer[:-have][same] += v[have:][same]
                    v, have = longer, 2 * have
                window = v[:own] / np.maximum(np.linalg.norm(v[:own], axis=1, keepdims=True), 1e-12)
                cosine = window @ vectors
                row, column = np.divmod(np.flatnonzero(cosine >= p.cosine), cosine.shape[1])
                if not len(row):
                    continue
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                # Windows of one text and item that follow each other are looked at together, up to `together` of them.
                apart = (np.diff(column) != 0) | (np.diff(row) != 1) | (np.diff(row // p.together) != 0) | (np.diff(owner[row]) != 0)
                begin = np.flatnonzero(np.append(True, apart))
                end = np.append(begin[1:], len(row))
                item, own_text = items[column[begin]], owner[row[begin]]
                margin = self.margin(item, w)
                low, high = np.maximum(first[own_text], head[i + row[begin]] - margin), np.minimum(first[own_text + 1], head[i + row[end - 1]] + w + margin)
                near = np.searchsorted(places, item << 40 | high) - np.searchsorted(places, item << 40 | low) >= self.need[item]
                for k in np.flatnonzero(near).tolist():
                    run = slice(begin[k], end[k])
                    yield int(own_text[k]), int(item[k]), w, head[i + row[run]], cosine[row[run], column[run]]

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item_id) to share of the item in common, share of its answer and cosine of the best window that passes."""
        p, best = self.p, {}
        for text, item, width, starts, cosines in self.candidates(words, first):
            item_id, own, masks, ending, n_ending = self.items[item]
            margin, least = int(self.margin(item, width)), p.common * len(own) - 1e-9
            low, high = int(first[text]), int(first[text + 1])
            # No more of the item can be in order than stands there in any order; its repeats may all be there.
            least -= len(own) - len(masks)
            if len(masks.keys() & set(words[max(low, int(starts[0]) - margin) : min(high, int(starts[-1]) + width + margin)].tolist())) < least:
                continue
            for start, cosine in zip(starts.tolist(), cosines.tolist(), strict=True):
                old = best.get((text, item_id))
                if old and old[0] == 1.0:
                    break
                region = words[max(low, start - margin) : min(high, start + width + margin)].tolist()
                if len(masks.keys() & set(region)) < least:
                    continue
                common = common_length(masks, len(own), region) / len(own)
                if common < p.common or old and old[0] >= common:
                    continue
                answer = common_length(ending, n_ending, region) / n_ending
                if common >= p.sure or answer >= p.answer:
                    best[text, item_id] = (common, answer, cosine)
        return best


def _found(p: Decontamination, benchmark: Benchmark, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in lower_texts(batch):
            found = sorted(benchmark.matches(*_tokens(raw, offsets)).items())
            ids = part.column("doc_id").take(pa.array([t for (t, _), _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for (_, i), _ in found], pa.int64()), *(pa.array([x[k] for _, x in found], pa.float64()) for k in range(3))], names=["doc_id", "item_id", "common", "answer", "cosine"])


def _clean(p: Decontamination, benchmark: Benchmark, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small, done = pa.RecordBatch.from_arrays([batch.column("text")], names=["text"]), 0
        for part, raw, offsets in lower_texts(small):
            hit = {t for t, _ in benchmark.matches(*_tokens(raw, offsets))}
            yield batch.slice(done, part.num_rows).filter(pa.array([t not in hit for t in range(part.num_rows)], pa.bool_()))
            done += part.num_rows


def _benchmarks(docs: DataFrame, benchmark: DataFrame, p: Decontamination) -> Iterator[Benchmark]:
    """The benchmark in blocks of at most about p.items rows; only a block at a time comes to the driver."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    n = items.count()
    latent = latent_words(docs, p) if n else None
    if latent is None:
        return
    blocks = -(-n // p.items)
    for k in range(blocks):
        yield Benchmark(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect(), latent, p)


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, item_id, common, answer, cosine of every benchmark(item_id, text) item that a row of docs(doc_id, text, ...) holds.

    common: share of the item's words that the text's best window has in the
    same order; answer: the same for its last words.  Words are runs of letters
    and digits in lower case.  Null and wordless texts and items match nothing.
    Repeated rows of docs are each reported, those of benchmark count once, further columns are ignored.
    """
    out = docs.sparkSession.createDataFrame([], schema := "doc_id long, item_id long, common double, answer double, cosine double")
    for block in _benchmarks(docs, benchmark, params):
        found = docs.select("doc_id", "text").mapInArrow(partial(_found, params, block), schema)
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: Decontamination = Decontamination()) -> DataFrame:
    """The rows of docs in which `contaminated` finds no item, with all columns."""
    out = docs
    for block in _benchmarks(docs, benchmark, params):
        out = out.mapInArrow(partial(_clean, params, block), docs.schema)
    return out
