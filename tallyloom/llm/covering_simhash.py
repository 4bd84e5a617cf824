"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Each bit of a fingerprint is given a non-zero vector of r + 1 bits, r the
radius.  For every non-zero v a mask keeps the bits whose vector has an odd
product with v (Pagh, CoveringLSH, 2018).  Two fingerprints that differ in at
most r bits differ in bits whose vectors span at most r dimensions, so some v
is orthogonal to all of them, and its mask hides every difference: each
pair within the radius has equal masked bits in one of the 2^(r+1) - 1 tables.

Buckets that are too large are cut up in the same way: the pairs looked for
differ in hidden bits only, and a family of masks over those covers them again.
After three levels a mask hides at most eight of 64 bits, so no bucket can be
larger than 256 then, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.scratch import Scratch


@dataclass(frozen=True)
class Covering:
    """words: in a shingle.  radius: links differ in so many bits at most.  members: larger buckets are cut up.  seed: of the shuffle that deals vectors to bits."""

    words: int = 3
    radius: int = 3
    members: int = 128
    seed: int = 2018


HASH_SEED = 42  # fixed value: fingerprints are those of XXH64 with this seed
SHINGLES = 1 << 14  # hashed at a time
LEVELS = 3  # of masks; those of the last one hide eight bits at most


def fingerprint(text: str | None, n: int) -> int:
    """The majority of each bit over the XXH64 of all shingles, repeats included, as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and space and 0x09-0x0D only
    if not words:
        return 0
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=HASH_SEED)
    ones, total = np.zeros(64, dtype=np.int64), len(words) - n + 1
    for i in range(0, total, SHINGLES):
        part = words[i : i + SHINGLES + n - 1]
        grams = zip(*(part[k:] for k in range(n)), strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), seed=HASH_SEED) for g in grams], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.array([fingerprint(texts[i].as_py(), n) for i in range(batch.num_rows)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def submasks(mask: int, radius: int, seed: int) -> list[int]:
    """For the pairs within the radius that are equal under a mask: larger masks, under one of which each of them is equal too."""
    hidden = [b for b in np.random.default_rng(seed).permutation(64).tolist() if not mask >> b & 1]
    vectors = (1 << radius + 1) - 1
    dealt = [(b, 1 + i % vectors) for i, b in enumerate(hidden)]
    return sorted({mask | sum(1 << b for b, vector in dealt if (vector & v).bit_count() % 2) for v in range(1, vectors + 1)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket of distinct fingerprints the links of a spanning forest of its near pairs: fewer than it has members."""
    for batch in batches:
        u, v = [], []
        for members, radius in zip(batch.column("members"), batch.column("radius").to_pylist(), strict=True):
            x = members.values.to_numpy(zero_copy_only=False)
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            root = np.arange(len(x))
            while True:  # each takes the least root in sight
                least = np.where(near, root[None, :], len(x)).min(axis=1)
                if (least == root).all():
                    break
                root = least
            linked = root != np.arange(len(x))
            u.append(x[linked])
            v.append(x[root[linked]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64), pa.int64()) for c in (u, v)], names=["u", "v"])


def links(fingerprints: DataFrame, scratch: Scratch, params: Covering = Covering()) -> DataFrame:
    """(u, v) of distinct fingerprints(fp), such that they connect what pairs within the radius connect; a bucket gives fewer links than it has members."""
    p, spark = params, fingerprints.sparkSession
    rows, masks, found = fingerprints.select("fp", F.lit(0).cast("long").alias("mask")), {0}, []
    level = 0
    while True:
        # Every mask of a level has its list of larger ones: 1, 15, 225 ... rows, whatever the data.
        family = {m: submasks(m, p.radius, p.seed + level) for m in masks}
        masks = {m for subs in family.values() for m in subs}
        table = spark.createDataFrame([(_signed(m), [_signed(s) for s in subs]) for m, subs in family.items()], "mask long, subs array<long>")
        rows = rows.join(F.broadcast(table), "mask").select("fp", F.explode("subs").alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        if level:
            rows = rows.distinct()  # a bucket can be reached through several
        buckets = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
        buckets = scratch.write(buckets, f"buckets-{level}")
        found.append(buckets.where((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= p.radius)).select("u", "v"))
        members = scratch.write(rows.join(buckets.where("n > 2").select("mask", "key", "n"), ["mask", "key"]), f"members-{level}")
        last = level == LEVELS - 1
        small = members.where((F.col("n") <= p.members) | F.lit(last)).groupBy("mask", "key").agg(F.collect_list("fp").alias("members"))
        found.append(small.select("members", F.lit(p.radius).alias("radius")).mapInArrow(_edges, "u long, v long"))
        rows = members.where(F.col("n") > p.members).select("fp", "mask")
        level += 1
        if last or rows.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return scratch.write(edges.distinct(), "edges")


def simhash_duplicates(docs: DataFrame, params: Covering = Covering()) -> DataFrame:
    """doc_id, fingerprint, component_id and kept for every row of docs(doc_id, text, ...).

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case.  A
    text with fewer words than a shingle is one shingle; null and wordless
    texts have fingerprint zero and are linked like any other.  component_id is
    the smallest doc_id reachable over links of at most `radius` differing bits;
    kept: doc_id is component_id.  Copies share a fingerprint and are never
    paired.  Rows that repeat a doc_id go each by their own text.  A null doc_id
    links its fingerprint like others and is never a component's id, which is
    null where all are; such rows are kept.  Further columns of docs are
    ignored, an empty table gives an empty result.
    """
    spark, p = docs.sparkSession, params
    scratch = Scratch(spark, "simhash")
    signed = scratch.write(docs.select("doc_id", "text").mapInArrow(_fingerprints(p.words), "doc_id long, fp long"), "signed")
    classes = scratch.write(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    placed = components(links(classes.select("fp"), scratch, p), scratch).withColumnsRenamed({"node": "fp", "component": "root"})
    least = placed.join(classes, "fp").groupBy("root").agg(F.min("least").alias("of_all"))
    joined = placed.join(least, "root").select("fp", "of_all")
    classes = scratch.write(classes.join(joined, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("component_id")), "placed")
    out = signed.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
