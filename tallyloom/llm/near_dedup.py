"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

A document's set of word shingles is hashed into a universe of UNIVERSE
cells.  Two fixed permutations make the whole signature (C-MinHash, Li and
Li, 2021): `sigma` scatters the cells once, `pi` is shifted circularly by k for
coordinate k.  For one cell the K coordinates are K neighbours in the table of
`pi`, so a signature is an element-wise minimum of table slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.words import U64, gram_hashes, mix, powers, texts_of, utf8, word_bounds, word_hashes


@dataclass(frozen=True)
class NearDedup:
    """words: words in a shingle.  percent: links need 100 * |A & B| >= percent * |A | B|.

    A pair at the threshold of 0.8 shares none of 76 bands of 8 coordinates with
    a chance of (1 - 0.8^8)^76 = 8e-7; one at 0.4 shares some with 5 %.

    spread: a candidate is compared in full unless two bits of each coordinate
    differ in so many standard deviations more coordinates than a pair at the
    threshold expects; 5 lose a link with a chance of 3e-7.  rounds: of comparing
    members with a head of their bucket, the first with the one that shares most
    buckets, the others with one of `heads` in every group.
    """

    words: int = 5
    percent: int = 80
    bands: int = 76
    rows: int = 8
    universe_bits: int = 20
    seed: int = 20210905
    spread: float = 5.0
    heads: int = 4
    rounds: int = 3

    @property
    def sketch_longs(self) -> int:
        return -(-self.bands * self.rows // 64)

    @property
    def most_bits(self) -> int:
        """Coordinates in which two sketches may differ: unequal ones have equal bits by chance in a quarter of all cases."""
        k, differ = self.bands * self.rows, (1 - self.percent / 100) * 0.75
        return math.floor(k * differ + self.spread * math.sqrt(k * differ * (1 - differ)))


_TABLES: dict[NearDedup, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(p: NearDedup) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and every K-long circular slice of pi."""
    if p not in _TABLES:
        random, k = np.random.default_rng(p.seed), p.bands * p.rows
        sigma, pi = (random.permutation(1 << p.universe_bits).astype(np.uint32) for _ in range(2))
        _TABLES[p] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _TABLES[p]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; fewer than n words count as one shingle."""
    starts, ends, first = word_bounds(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=True)
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
    return out


def signature(cells: np.ndarray, p: NearDedup) -> np.ndarray:
    """K minima for the cells of one non-empty set."""
    sigma, slices = _permutations(p)
    at = sigma[cells]
    out = slices[at[:256]].min(axis=0)
    for i in range(256, len(at), 256):
        np.minimum(out, slices[at[i : i + 256]].min(axis=0), out=out)
    return out


def _sketch(sig: np.ndarray, p: NearDedup) -> np.ndarray:
    """Two bits of every coordinate: words of 64 first bits, then as many of second ones, a row for each signature."""
    bits = np.zeros((len(sig), 2, 64 * p.sketch_longs), dtype=np.uint8)
    random = mix(sig) >> U64(40)
    for k in range(2):
        bits[:, k, : sig.shape[1]] = (random >> U64(k)).astype(np.uint8) & 1
    return np.packbits(bits.reshape(len(sig), 128 * p.sketch_longs), axis=1).view(np.int64)


SIGNED = "doc_id long, row long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"


def _signed(p: NearDedup):
    longs = pa.list_(pa.int64())
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "n_shingles", "d1", "d2")] + [("bands", longs), ("sketch", longs)])

    def lists(values: np.ndarray, some: np.ndarray) -> pa.Array:
        """A list of each row of values where `some` holds, null elsewhere."""
        ends = np.append(0, np.cumsum(np.where(some, values.shape[1], 0))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = powers(0xD1342543DE82EF95, p.rows + 1)[1:]
        for batch in batches:
            for part, raw, offsets in texts_of(batch, "text", 1 << 20):
                sets = shingle_sets(raw, offsets, p.words)
                some = np.array([len(s) > 0 for s in sets])
                sig = np.empty((some.sum(), p.bands * p.rows), dtype=U64)
                for row, i in enumerate(np.flatnonzero(some)):
                    sig[row] = signature(sets[i] >> U64(64 - p.universe_bits), p)
                keys = mix((sig.reshape(-1, p.bands, p.rows) * odd).sum(axis=2, dtype=U64) + np.arange(p.bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
                digest = [np.array([mix(s ^ U64(c)).sum(dtype=U64) for s in sets], dtype=U64).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                columns = [part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, digest)]
                yield pa.RecordBatch.from_arrays([*columns, lists(keys.view(np.int64), some), lists(_sketch(sig, p), some)], schema=schema)

    return run


def _verified(p: NearDedup):
    """Keeps the pairs whose full sets are similar enough."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, keep = batch.slice(i, 64), []
                right = shingle_sets(*utf8(part.column("right")), p.words)
                for k, u in enumerate(part.column("u").to_pylist()):
                    if kept is None or u != last:  # rows of one left side mostly come together
                        last, kept = u, shingle_sets(*utf8(part.column("left").slice(k, 1)), p.words)[0]
                    both = len(np.intersect1d(kept, right[k], assume_unique=True))
                    keep.append(100 * both >= p.percent * (len(kept) + len(right[k]) - both))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def _shingles(p: NearDedup):
    """id and each of its distinct shingles."""
    schema = pa.schema([("id", pa.int64()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in texts_of(batch, "text", 1 << 20):
                sets = shingle_sets(raw, offsets, p.words)
                own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(own)), pa.array(np.concatenate(sets).view(np.int64))], schema=schema)

    return run


#: Members and shingles of a block of a group, about, and shingles that are compared at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES, _COLUMNS = 256, 1 << 18, 4096
PACKED = "centre long, block long, ids binary, sizes binary, shingles binary"


def _packed(p: NearDedup):
    """One row of a block's members: ids, set sizes and sets end to end."""

    def run(table: pa.Table) -> pa.Table:
        sets = [s for part in table.to_batches() for s in shingle_sets(*utf8(part.column("text")), p.words)]
        data = [np.array(table.column("id").to_pylist(), dtype=np.int64), np.array([len(s) for s in sets], dtype=np.int64), np.concatenate(sets)]
        first = [table.column(c).slice(0, 1).combine_chunks() for c in ("centre", "block")]
        return pa.table([*first, *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["centre", "block", "ids", "sizes", "shingles"])

    return run


def common_shingles(sizes: np.ndarray, shingles: np.ndarray, n_left: int) -> np.ndarray:
    """Sizes of the intersections of the first n_left sets with all sets; shingles that only one set has are in none."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n_left, len(sizes)), dtype=np.float32)  # exact below 2^24
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + _COLUMNS)))
        has = np.zeros((len(sizes), _COLUMNS), dtype=np.float32)
        has[owner[part], column[part] - low] = 1
        out += has[:n_left] @ has.T
    return np.rint(out).astype(np.int64)


def _block_links(p: NearDedup):
    """Of two blocks of a group, links that connect what their near members connect: fewer than they have members."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[row].as_py() or b"", dtype=t)  # noqa: B023, E731
                ids, sizes = (np.concatenate([get(c, np.int64), get(f"{c}_far", np.int64)]) for c in ("ids", "sizes"))
                n_left = len(get("ids", np.int64))
                both = common_shingles(sizes, np.concatenate([get("shingles", U64), get("shingles_far", U64)]), n_left)
                near = 100 * both >= p.percent * (sizes[:n_left, None] + sizes[None, :] - both)
                root = np.arange(len(ids))
                while True:  # each takes the least root in sight
                    least = root.copy()
                    seen = np.where(near, root[None, :], len(ids))
                    least[:n_left] = np.minimum(least[:n_left], seen.min(axis=1))
                    least = np.minimum(least, np.where(near, least[:n_left, None], len(ids)).min(axis=0))
                    if (least == root).all():
                        break
                    root = least
                linked = root != np.arange(len(ids))
                a, b = ids[linked], ids[root[linked]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run


def _links(pairs: DataFrame, texts: DataFrame, p: NearDedup) -> DataFrame:
    """The pairs (u, v) of classes whose texts are near."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("right"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "left", "right")
    return both.mapInArrow(_verified(p), "u long, v long").distinct()


class _Groups:
    """Classes that share buckets, and the components found among them so far."""

    def __init__(self, members: DataFrame, sketches: DataFrame, texts: DataFrame, p: NearDedup, scratch: Scratch):
        self.members, self.sketches, self.texts, self.p, self.scratch = members, sketches, texts, p, scratch
        self.found: DataFrame | None = None
        self.checked: list[DataFrame] = []

    def placed(self) -> DataFrame:
        """key, id, n_shingles, component of the members of buckets that hold several components."""
        if self.found is None:
            return self.members.withColumn("component", F.col("id"))
        found = self.found.withColumnRenamed("node", "id")
        placed = self.members.join(found, "id", "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
        return placed.join(mixed, "key", "left_semi")

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches don't rule them out."""
        left, right = (self.sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
        return pairs.join(left, "u").join(right, ["v"]).where(self.close("sketch_u", "sketch_v")).select("u", "v")

    def close(self, a: str, b: str) -> Column:
        n, unequal = self.p.sketch_longs, lambda k: F.col(a)[k].bitwiseXOR(F.col(b)[k])
        return sum((F.bit_count(unequal(k).bitwiseOR(unequal(k + n))) for k in range(n)), F.lit(0)) <= self.p.most_bits

    def sizes_fit(self, a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= self.p.percent * F.greatest(a, b)

    def check(self, pairs: DataFrame, name: str) -> bool:
        """Verifies pairs that weren't before and joins the components that they link."""
        scratch = self.scratch
        if self.checked:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.checked), ["u", "v"], "left_anti")
        pairs = scratch.write(pairs, f"pairs-{name}")
        self.checked.append(pairs)
        return self.join(scratch.write(_links(pairs, self.texts, self.p), f"links-{name}"), name)

    def join(self, links: DataFrame, name: str) -> bool:
        """Joins the components that links connect; False if there are none."""
        if links.isEmpty():
            return False
        if self.found is not None:
            links = links.unionByName(self.found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        self.found = self.scratch.write(components(links, self.scratch, f"components-{name}"), f"found-{name}")
        return True

    def compare_with_heads(self, k: int) -> bool:
        """Every member of a bucket with one head of it; heads differ between buckets, and from round to round."""
        placed = self.placed()
        order = F.xxhash64("id", F.pmod("key", F.lit(self.p.heads)), F.lit(k))
        if k == 0:  # what a group's members are copies of shares most buckets, with most others
            sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
            central = placed.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("shares"))
            placed, order = placed.join(central, "id"), -F.col("shares")
        placed = self.scratch.write(placed, f"placed-{k}")
        heads = placed.groupBy("key").agg(F.min(F.struct(order.alias("order"), "id", "n_shingles", "component")).alias("h"))
        heads = heads.select("key", F.col("h.id").alias("head"), F.col("h.n_shingles").alias("n_head"), F.col("h.component").alias("own"))
        if k == 0:  # the head that a class meets in most of its buckets
            met = placed.select("key", "id", "n_shingles").join(heads.select("key", "head"), "key").groupBy("id", "head").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
            self.sized = self.scratch.write(met.groupBy("id").agg(F.max(F.struct("n", "head")).alias("h"), F.max("n_shingles").alias("n_shingles")).select("id", F.col("h.head").alias("centre"), "n_shingles"), "centres")
            self.centres = self.sized.select("id", "centre")
        pairs = placed.join(heads, "key").where((F.col("component") != F.col("own")) & self.sizes_fit("n_shingles", "n_head"))
        pairs = pairs.select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v")).distinct()
        more = self.check(self.sketched(pairs), f"heads-{k}")
        self.scratch.drop(f"placed-{k}")
        return more

    def compare_groups(self) -> None:
        """Members that have one centre and are in several components are compared group by group: blocks of their sets with blocks, by matrix products.

        A pair of blocks gives fewer links than it has members, so a group of m
        near copies makes about (m / BLOCK_MEMBERS)^2 / 2 rows and no pairs.
        """
        found = self.found.withColumnRenamed("node", "id") if self.found is not None else self.sized.select("id", F.col("id").alias("component"))
        members = self.scratch.write(self.sized.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "grouped")
        groups = members.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
        members = members.select("id", "centre").join(groups.select("centre", blocks.alias("blocks")), "centre")
        packed = members.select("id", "centre", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).join(self.texts, "id")
        packed = self.scratch.write(packed.select("id", "centre", "block", "text").groupBy("centre", "block").applyInArrow(_packed(self.p), PACKED), "packed")
        far = packed.select("centre", F.col("block").alias("block_far"), *(F.col(c).alias(f"{c}_far") for c in ("ids", "sizes", "shingles")))
        pairs = packed.join(far, "centre").where("block < block_far").drop("block", "block_far")
        none = [F.lit(None).cast("binary").alias(f"{c}_far") for c in ("ids", "sizes", "shingles")]
        pairs = pairs.unionByName(packed.select("centre", "ids", "sizes", "shingles", *none))
        self.join(self.scratch.write(pairs.mapInArrow(_block_links(self.p), "u long, v long").distinct(), "links-groups"), "groups")

    def compare_rest(self) -> None:
        """All pairs of members in a bucket that are in different components by now and have different centres."""
        placed = self.scratch.write(self.placed(), "mixed")
        # Shingles that only one of these documents has are in no intersection.
        texts = self.texts.join(placed.select("id").distinct(), "id", "left_semi")
        by = texts.mapInArrow(_shingles(self.p), "id long, shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        own = by.where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
        placed = placed.join(self.sketches, "id").join(self.centres, "id").join(own, "id", "left")
        placed = placed.select("key", "id", "n_shingles", "component", "sketch", "centre", (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("common"))
        placed = self.scratch.write(placed.where(100 * F.col("common") >= self.p.percent * F.col("n_shingles")), "placed")
        groups = placed.groupBy("key", "component", "centre").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.count(F.lit(1)).alias("members"))
        others = groups.select("key", *(F.col(c).alias(f"other_{c}") for c in ("component", "centre", "least", "most", "members")))
        fit = (100 * F.col("most") >= self.p.percent * F.col("other_least")) & (100 * F.col("other_most") >= self.p.percent * F.col("least"))
        crossing = groups.join(others, "key").where((F.col("component") < F.col("other_component")) & (F.col("centre") != F.col("other_centre")) & fit)
        # The smaller side first: what the first join gives doesn't grow with the larger group.
        few = F.col("members") <= F.col("other_members")
        pick = lambda a, b, name: F.when(few, F.col(a)).otherwise(F.col(b)).alias(name)
        crossing = crossing.select("key", pick("component", "other_component", "component"), pick("centre", "other_centre", "centre"), pick("other_component", "component", "far"), pick("other_centre", "centre", "far_centre"))
        left = crossing.join(placed, ["key", "component", "centre"])
        right = placed.select("key", F.col("component").alias("far"), F.col("centre").alias("far_centre"), F.col("id").alias("end"), F.col("n_shingles").alias("n_end"), F.col("sketch").alias("sketch_end"), F.col("common").alias("common_end"))
        both = F.least("common", "common_end")
        enough = 100 * both >= self.p.percent * (F.col("n_shingles") + F.col("n_end") - both)
        rest = left.join(right, ["key", "far", "far_centre"]).where(enough & self.close("sketch", "sketch_end"))
        self.check(rest.select(F.least("id", "end").alias("u"), F.greatest("id", "end").alias("v")).distinct(), "rest")


def near_duplicates(docs: DataFrame, params: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept, first for every row of docs(doc_id, text, ...).

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower
    case.  A text with fewer words than a shingle is one shingle; a null or
    wordless text has the empty set, links with nothing and is kept.
    component_id is the smallest doc_id reachable over links; kept: doc_id is
    component_id.  Rows with equal sets form one class, which its smallest
    doc_id stands for: copies are never paired with each other.  Rows that
    repeat a doc_id are each given their own text's class; row, a hash of the
    text, tells them apart, and first holds for one (doc_id, row) of each
    component only.  A row with a null doc_id links nothing, is kept and first,
    and has the component of its text if others have that text.  Further
    columns of docs are ignored, an empty table gives an empty result.

    In each band's bucket every class is checked against a head of the bucket,
    in some rounds with other heads, so that the members of a group find each
    other by a row a member and round.  After the first round members with one
    centre are compared group by group, in blocks.  In the end pairs of other
    centres that cross components are left, and all of those are checked.  A pair
    is checked on its full texts
    unless sizes, sketches (two bits of each coordinate) or shingles that only
    one document has rule it out.
    """
    spark, p = docs.sparkSession, params
    scratch = Scratch(spark, "near")
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    signed = scratch.write(texts.mapInArrow(_signed(p), SIGNED), "signed")
    sets = ["n_shingles", "d1", "d2"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*sets).agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    # The ids are fixed from here on: the table is read again, never made again.
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("id"), *sets, "rep.doc_id", "rep.row"), "classes")

    reps = signed.drop(*sets[1:]).join(classes.select("id", "doc_id", "row"), ["doc_id", "row"]).dropDuplicates(["id"])
    reps = scratch.write(reps.select("id", "n_shingles", "bands", "sketch"), "reps")
    banded = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    members = scratch.write(banded.join(shared, "key"), "members")
    used = members.select("id").distinct()
    sketches = scratch.write(reps.join(used, "id", "left_semi").select("id", "sketch"), "sketches")
    scratch.drop("reps")
    held = texts.join(classes.join(used, "id", "left_semi").select("id", "doc_id", "row"), ["doc_id", "row"]).dropDuplicates(["id"])
    held = scratch.write(held.select("id", "text"), "held")

    groups = _Groups(members, sketches, held, p, scratch)
    more = groups.compare_with_heads(0)
    groups.compare_groups()
    for k in range(1, p.rounds):
        more = more and groups.compare_with_heads(k)
    groups.compare_rest()

    empty = spark.createDataFrame([], "node long, component long")
    placed = classes.join((groups.found or empty).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("rep"))
    placed = placed.select(*sets, "component").join(least, "component")
    rows = signed.select("doc_id", "row", *sets).join(placed.select(*sets, "rep"), sets, "left")
    component = F.coalesce(F.col("rep.doc_id"), "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    first = F.col("doc_id").isNull() | F.coalesce(F.struct("doc_id", "row") == F.col("rep"), F.lit(True))
    return rows.select("doc_id", "row", "n_shingles", component.alias("component_id"), kept.alias("kept"), first.alias("first"))


def drop_near_duplicates(docs: DataFrame, params: NearDedup = NearDedup()) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that stand for their component, with all columns.

    Rows are told apart by doc_id and text.  Of rows equal in both, the one whose
    other columns come first as JSON stays.  Rows with a null doc_id or without
    words all stay.
    """
    row, n, first, rank = (_unused(docs.columns, c) for c in ("row", "n", "first", "rank"))
    found = near_duplicates(docs.select("doc_id", "text"), params).where("doc_id is not null")
    verdict = found.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias(n), F.min("first").alias(first)).where(f"{n} > 1 or not {first}")
    judged = docs.withColumn(row, F.xxhash64("text")).join(verdict.withColumnRenamed("row", row), ["doc_id", row], "left")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*(F.col(f"`{c}`") for c in others))) if others else F.lit(0)
    again = judged.where(F.col(first)).withColumn(rank, F.row_number().over(W.partitionBy("doc_id", row).orderBy(order))).where(F.col(rank) == 1)
    names = [f"`{c}`" for c in docs.columns]
    return judged.where(F.col(first).isNull()).select(*names).unionByName(again.select(*names))


def _unused(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
