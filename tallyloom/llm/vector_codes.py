"""Product codes of vectors by Yinyang k-means on integers.

Every part of a vector keeps, from round to round, an upper bound on the
distance to its entry and one lower bound for each group of entries (Ding et
al., Yinyang K-Means, 2015).  When entries move, the upper bound grows by
the drift of the own entry and a group's lower bound falls by the largest drift in
it.  Only groups whose bound no longer exceeds the upper bound are scanned, by
exact integer distances, so equal distances are told from near ones.

A round is one pass that writes codes and bounds, and one that sums parts by
code.  What goes through the driver is the codebook: entries x length numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch


@dataclass(frozen=True)
class VectorCodes:
    """group: entries in a group, about.  rows: vectors that a task works on at a time."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    group: int = 16
    rows: int = 2048


#: Bounds are kept in single precision, so they are moved apart by this share, and by this length, before they are compared.
SLACK, LEAST_SLACK = 1e-6, 1e-3


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact, a row for each x: by doubles where every sum is below 2^53, else by 64-bit integers."""
    most = 4.0 * x.shape[1] * max(float(np.abs(x).max(initial=0)), float(np.abs(entries).max(initial=0))) ** 2
    if most < 2.0**53:
        a, b = x.astype(float), entries.astype(float)
        return np.rint((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("squared distances of these vectors don't fit 64 bits")
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def entry_groups(entries: np.ndarray, size: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry: a few rounds of k-means over the entries of one codebook."""
    n = max(1, len(entries) // size)
    centres = entries[:: max(1, len(entries) // n)][:n].astype(float)
    for _ in range(rounds):
        of = ((entries[:, None, :].astype(float) - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([entries[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(n)])
    return of


@dataclass
class Codebook:
    """Entries of one part: what tasks get for a pass.  drift: how far each entry moved since the bounds were made."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups.max()) + 1


def _least_by_group(d: np.ndarray, book: Codebook, own: np.ndarray) -> np.ndarray:
    """Distance to the nearest entry of each group other than the own one, as a lower bound."""
    d = np.sqrt(d.astype(float))
    d[np.arange(len(d)), own] = np.inf
    return np.stack([d[:, book.groups == g].min(axis=1, initial=np.inf) for g in range(book.n_groups)], axis=1)


def assign(x: np.ndarray, book: Codebook, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds of parts x, and how many distances were computed; without bounds all entries are scanned."""
    rows = np.arange(len(x))
    if code is None:
        d = squared_distances(x, book.entries)
        code = d.argmin(axis=1)  # the first of equals
        return code, np.sqrt(d[rows, code].astype(float)), _least_by_group(d, book, code), d.size
    fall = np.array([book.drift[book.groups == g].max(initial=0.0) for g in range(book.n_groups)])
    upper, lower = upper + book.drift[code], lower - fall
    open_ = rows[lower.min(axis=1, initial=np.inf) <= upper * (1 + SLACK) + LEAST_SLACK]
    code, upper, lower, work = code.copy(), upper.copy(), lower.copy(), len(open_)
    if not len(open_):
        return code, upper, lower, work
    # The bound may only have grown too far: the exact distance first.
    old = code[open_]
    best = ((x[open_] - book.entries[old]) ** 2).sum(axis=1) if x.size else np.zeros(len(open_), dtype=np.int64)
    tight = np.sqrt(best.astype(float))
    winner, own = old.copy(), best.copy()
    fails = lower[open_] <= (tight * (1 + SLACK) + LEAST_SLACK)[:, None]
    for g in range(book.n_groups):
        members, asked = np.flatnonzero(book.groups == g), np.flatnonzero(fails[:, g])
        if not len(asked) or not len(members):
            continue
        d = squared_distances(x[open_[asked]], book.entries[members])
        work += d.size
        at = d.argmin(axis=1)
        found, entry = d[np.arange(len(asked)), at], members[at]
        better = (found < best[asked]) | (found == best[asked]) & (entry < winner[asked])
        best[asked] = np.where(better, found, best[asked])
        winner[asked] = np.where(better, entry, winner[asked])
        # The nearest of the group but the old one; a new winner is taken out below.
        d = np.sqrt(d.astype(float))
        d[members[None, :] == old[asked][:, None]] = np.inf
        lower[open_[asked], g] = d.min(axis=1, initial=np.inf)
    moved = np.flatnonzero(winner != old)
    if len(moved):
        at = open_[moved]
        # The old entry counts for its group from now on, the winner no longer does for its own.
        np.minimum.at(lower, (at, book.groups[old[moved]]), np.sqrt(own[moved].astype(float)))
        code[at] = winner[moved]
        for g in np.unique(book.groups[winner[moved]]):
            members, into = np.flatnonzero(book.groups == g), at[book.groups[code[at]] == g]
            d = np.sqrt(squared_distances(x[into], book.entries[members]).astype(float))
            d[members[None, :] == code[into][:, None]] = np.inf
            lower[into, g] = d.min(axis=1)
    upper[open_] = np.sqrt(best.astype(float))
    return code, upper, lower, work


def _whole(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of a list column as integers, a row each, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(scale * values)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("components of these vectors don't fit 64 bits")
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = scaled.astype(np.int64)
    return out


def _bounds_width(books: list[Codebook]) -> list[int]:
    return [1 + b.n_groups for b in books]


def _assigned(books: list[Codebook], p: VectorCodes, width: int, last: bool):
    """Rows with new codes and bounds; the last pass gives codes and the error instead."""
    cuts = [width // p.parts * k for k in range(p.parts + 1)]
    ends = np.cumsum([0, *_bounds_width(books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, p.rows):
                part = batch.slice(i, p.rows)
                x, n = _whole(part.column("embedding"), p.scale, width), part.num_rows
                known = "codes" in part.schema.names
                codes = np.empty((n, p.parts), dtype=np.uint8)
                bounds, error = np.empty((n, ends[-1]), dtype=np.float32), np.zeros(n, dtype=np.int64)
                if known:
                    old = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint8).reshape(n, p.parts)
                    kept = np.frombuffer(b"".join(part.column("bounds").to_pylist()), dtype=np.float32).reshape(n, ends[-1]).astype(float)
                for k, book in enumerate(books):
                    own, a = x[:, cuts[k] : cuts[k + 1]], ends[k]
                    code, upper, lower, _ = assign(own, book, *((old[:, k].astype(np.int64), kept[:, a], kept[:, a + 1 : ends[k + 1]]) if known else (None, None, None)))
                    codes[:, k] = code
                    if last:
                        error += ((own - book.entries[code]) ** 2).sum(axis=1)
                    else:  # rounded to single precision away from each other
                        bounds[:, a] = upper * (1 + SLACK)
                        bounds[:, a + 1 : ends[k + 1]] = lower - np.abs(np.where(np.isfinite(lower), lower, 0)) * SLACK
                columns = [part.column(c) for c in ("vec_id", "label")]
                if last:
                    code = pa.array([c.tobytes().hex() for c in codes], pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, code, pa.array(error)], names=["vec_id", "label", "code", "error"])
                else:
                    packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, bounds)]
                    yield pa.RecordBatch.from_arrays([*columns, part.column("embedding"), *packed], names=["vec_id", "label", "embedding", "codes", "bounds"])

    return run


def _part_sums(p: VectorCodes, width: int, entries: int):
    """part, entry, n and the sums of a task's parts, at most parts * entries rows a task."""
    step = width // p.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((p.parts, entries), dtype=np.int64), np.zeros((p.parts, entries, step), dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, p.rows):
                part = batch.slice(i, p.rows)
                x = _whole(part.column("embedding"), p.scale, width)
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, p.parts)
                for k in range(p.parts):
                    np.add.at(sums[k], codes[:, k], x[:, k * step : (k + 1) * step])
                    n[k] += np.bincount(codes[:, k], minlength=entries)
        k, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(k.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(n[k, e]), "sums": pa.array(sums[k, e].tolist(), pa.list_(pa.int64()))})

    return run


def moved(books: list[Codebook], sums: DataFrame) -> list[Codebook]:
    """Codebooks whose used entries are the floors of their parts' means, from rows part, entry, n, sums of all tasks."""
    each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = each.select("part", "entry", "at", F.expr("x div n - if(x % n < 0, 1, 0)").alias("mean")).toPandas()  # entries * length numbers
    out = []
    for k, book in enumerate(books):
        own, entries = rows[rows["part"] == k], book.entries.copy()
        entries[own["entry"].to_numpy(), own["at"].to_numpy()] = own["mean"].to_numpy()
        out.append(Codebook(entries, book.groups, np.sqrt(((entries - book.entries).astype(float) ** 2).sum(axis=1)) * (1 + SLACK)))
    return out


def usable(embedding: Column) -> Column:
    """Not null, and every component there and finite; an empty vector is usable."""
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def vector_codes(table: DataFrame, params: VectorCodes = VectorCodes()) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 for every usable vector of table(vec_id, embedding, label, ...).

    code has two hex digits for each part, error is the squared distance to the
    coded vector.  Vectors that are null or hold null or non-finite components
    are left out; shorter ones are filled up with zeros to the longest length,
    and all to a multiple of the number of parts.  The first codebook's entries
    are those of the smallest vec_ids, null ids after all others and rows of one
    id by their vectors; with fewer vectors there are fewer entries.  Distances
    that don't fit 64 bits raise an OverflowError.  Further columns are ignored,
    an empty table gives an empty result.
    """
    spark, p = table.sparkSession, params
    if p.entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    scratch = Scratch(spark, "codes")
    rows = table.select("vec_id", "label", "embedding").where(usable(F.col("embedding").cast("array<double>")))
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return spark.createDataFrame([], f"vec_id long, label {table.schema['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string")
    width = max(1, -(-width // p.parts)) * p.parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(p.entries).toArrow()["embedding"].combine_chunks()
    first = _whole(first, p.scale, width)
    step = width // p.parts
    books = []
    for k in range(p.parts):
        entries = first[:, k * step : (k + 1) * step]
        books.append(Codebook(entries, entry_groups(entries, p.group), np.zeros(len(entries))))

    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, codes binary, bounds binary"
    for r in range(p.rounds):
        rows = scratch.write(rows.mapInArrow(_assigned(books, p, width, False), schema), f"round-{r}")
        if r:
            scratch.drop(f"round-{r - 1}")
        sums = rows.select("embedding", "codes").mapInArrow(_part_sums(p, width, len(first)), "part int, entry int, n long, sums array<long>")
        books = moved(books, sums)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()
    final = rows.mapInArrow(_assigned(books, p, width, True), schema.split(", embedding")[0] + ", code string, error long")
    return final.withColumn("codebooks_sha256", F.lit(digest))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels, nulls together; null where the sum doesn't fit 64 bits."""
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).drop("_label")
