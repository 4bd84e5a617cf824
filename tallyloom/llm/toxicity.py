"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.words import U64, lower_texts, word_bounds, word_hashes


@dataclass(frozen=True)
class Toxicity:
    """bits: log2 of the hashed features.  max_rows: labelled rows that the fit may read, chosen by hash.

    min_z: features whose shares in toxic and other rows differ by so many
    standard errors have a weight.  A document is rejected from reject_at
    expected severity on.
    """

    bits: int = 18
    max_rows: int = 20_000
    min_z: float = 4.0
    l2: float = 0.01
    rounds: int = 1500
    reject_at: float = 0.5
    stem: int = 4


@dataclass
class Model:
    """P(grade >= k) = sigmoid(sum of weights - thresholds[k - 1])."""

    weights: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.array([]))


def features(raw: np.ndarray, offsets: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every word and every longer word's stem; words are runs of letters, digits and bytes over 127 of lower-cased text."""
    data = raw.copy()
    data[data < 128] = np.where(_WORD[data[data < 128]], data[data < 128], 32)
    starts, ends, first = word_bounds(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    long = ends - starts > p.stem
    found = [word_hashes(data, starts, ends), word_hashes(data, starts[long], starts[long] + p.stem) ^ U64(0x5DEECE66D)]
    ids = (np.concatenate(found) >> U64(64 - p.bits)).astype(np.int64)
    return np.concatenate([text, text[long]]), ids


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True


def _extract(p: Toxicity, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in lower_texts(batch):
            text, ids = features(raw, offsets, p)
            both = np.unique(text << p.bits | ids)
            cut = np.searchsorted(both >> p.bits, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((both & (1 << p.bits) - 1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), lists], names=["doc_id", "toxic", "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, size: int, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and ordered thresholds, by Adam on the mean cumulative log loss."""
    levels = int(grades.max()) if len(grades) else 0
    weights, at = np.zeros(size), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cells = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    above = (grades[:, None] > np.arange(levels)[None, :]).astype(float)
    rate = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    theta = np.log((1 - rate) / rate)
    theta = np.append(theta[:1], np.log(np.maximum(np.diff(theta), 1e-3)))  # the first, then log gaps: they stay in order
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, theta)]
    for step in range(1, p.rounds + 1):
        cuts = np.cumsum(np.append(theta[:1], np.exp(theta[1:])))
        z = np.bincount(at, weights[cells], len(rows))
        error = (_sigmoid(z[:, None] - cuts[None, :]) - above) / len(rows)
        on_cuts = -error.sum(axis=0)
        tail = np.cumsum(on_cuts[::-1])[::-1]
        slope = np.append(tail[:1], tail[1:] * np.exp(theta[1:]))
        gradient = np.bincount(cells, error.sum(axis=1)[at], size) + p.l2 * weights / len(rows)
        for x, g, (m, v) in zip((weights, theta), (gradient, slope), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, np.cumsum(np.append(theta[:1], np.exp(theta[1:])))


def fit(docs: DataFrame, labels: DataFrame, params: Toxicity = Toxicity()) -> Model:
    """Fits on the documents of at most about max_rows rows of labels(doc_id, toxic), chosen by a hash of doc_id.

    Where documents repeat a label's doc_id, equal texts count once, and of more
    than max_rows documents so many are chosen by a hash of doc_id and text.

    labels know two classes, the regression takes three grades: 0 for toxic = 0,
    and for toxic = 1 grade 2 if its number of distinct toxic features is above
    the median of the toxic rows, else 1.  So only the step from grade 0 to 1 is
    given by labels; that from 1 to 2 has no truth outside the text, and a
    severity above 1 says how much toxic wording there is.  Features are
    presence of hashed words and word stems.  Rows with a null are left out; if
    either class is missing, nothing is learned and all severities are 0.
    """
    p, spark = params, docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, p.max_rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about max_rows pairs of numbers: small by that parameter.
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    each = marked.groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("n"))
    found, n_rows = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if found > 1.1 * p.max_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", "_text", F.lit(1)), F.lit(1 << 30)) < int(p.max_rows / found * (1 << 30)))
    if n_rows > found:  # texts are only moved where some repeat
        marked = marked.dropDuplicates(["doc_id", "_text"])
    marked = marked.select("doc_id", "toxic", "text")
    rows = scratch.write(marked.mapInArrow(partial(_extract, p), "doc_id long, toxic int, features array<int>"), "rows")
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    weights = np.zeros(1 << p.bits, dtype=np.float32)
    if not 0 < n_toxic < n:
        return Model(weights)
    a, b, pooled = F.col("a") / n_toxic, (F.col("n") - F.col("a")) / (n - n_toxic), F.col("n") / n
    z = (a - b) / F.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / (n - n_toxic)) + 1e-12)
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    best = counts.select("feature", z.alias("z")).where(F.abs("z") >= p.min_z).collect()  # 2^bits rows at most
    if not best:
        return Model(weights)
    names = np.array(sorted(r.feature for r in best))
    toxic_names = {r.feature for r in best if r.z > 0}
    kept = rows.select("toxic", F.array_intersect("features", F.lit(names.tolist()).cast("array<int>")).alias("features")).collect()  # max_rows rows, selected features only
    toxic = np.array([r.toxic for r in kept])
    evidence = np.array([sum(f in toxic_names for f in r.features) for r in kept])
    grades = np.where(toxic == 0, 0, 1 + (evidence > np.median(evidence[toxic == 1])))
    fitted, thresholds = fit_ordinal([np.searchsorted(names, r.features) for r in kept], grades, len(names), p)
    weights[names] = fitted
    return Model(weights, thresholds)


def _score(p: Toxicity, model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, offsets in lower_texts(batch):
            severity = np.zeros(part.num_rows)
            grade = np.zeros(part.num_rows, dtype=np.int64)
            if len(model.thresholds):
                text, ids = features(raw, offsets, p)
                hit = model.weights[ids] != 0
                both = np.unique(text[hit] << p.bits | ids[hit])
                z = np.bincount(both >> p.bits, model.weights[both & (1 << p.bits) - 1], part.num_rows)
                at_least = _sigmoid(z[:, None] - model.thresholds[None, :])
                severity, grade = at_least.sum(axis=1), (at_least >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(severity), pa.array(grade), pa.array(severity >= p.reject_at)], names=["doc_id", "severity", "grade", "toxic"])


def score(docs: DataFrame, model: Model, params: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, severity, grade, toxic for every row of docs(doc_id, text, ...).

    severity is the expected grade, the sum over k of P(grade >= k); grade is
    the median grade; toxic: severity is at least reject_at.  A null or empty
    text has no features.  Repeated rows are each scored, further columns are
    ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_score, params, model), "doc_id long, severity double, grade long, toxic boolean")


def _clean(p: Toxicity, model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        small, done = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc_id", "text"]), 0
        for part in _score(p, model, iter([small])):
            yield batch.slice(done, part.num_rows).filter(pc.invert(part.column("toxic")))
            done += part.num_rows


def drop_toxic(docs: DataFrame, model: Model, params: Toxicity = Toxicity()) -> DataFrame:
    """The rows of docs that `score` doesn't call toxic, with all columns."""
    return docs.mapInArrow(partial(_clean, params, model), docs.schema)
