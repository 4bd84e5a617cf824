"""Language identification by nearest clustered centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.words import U64, mix, small_parts, utf8

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageId:
    """bits: log2 of the hashed n-gram dimensions.  per_lang: rows a language's centroids are fitted on, chosen by hash.

    clusters: centroids per language.  slack: a prediction is rejected if its
    distance from the centroid is over slack times the largest distance of a
    fitted row.  most_langs: languages, all of whose centroids tasks receive; more are an error.
    """

    bits: int = 14
    per_lang: int = 1000
    clusters: int = 3
    rounds: int = 8
    slack: float = 1.1
    most_langs: int = 4096


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128][~_LETTER[:128]] = 32


def gram_counts(texts: pa.Array, bits: int) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of the lower-cased UTF-8 bytes, a row for each text; ASCII other than letters is one blank."""
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    rows, size = len(offsets) - 1, 1 << bits
    data = np.full(len(raw) + 2 * rows, 32, dtype=np.uint8)  # a blank round each text
    place = np.arange(rows, dtype=np.int64)
    data[np.arange(len(raw)) + np.repeat(2 * place + 1, np.diff(offsets))] = _FOLD[raw]
    text = np.repeat(place, np.diff(offsets) + 2)
    out = np.zeros(rows * size, dtype=np.int64)
    code = data.astype(U64)
    for n in (2, 3):
        code = code[:-1] | data[n - 1 :].astype(U64) << U64(8 * (n - 1))
        whole = text[: len(code)] == text[n - 1 :]
        cells = (mix(code + U64(n << 32)) >> U64(64 - bits)).astype(np.int64) + text[: len(code)] * size
        out += np.bincount(cells[whole], minlength=rows * size)
    return out.reshape(rows, size)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _document_frequencies(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << bits, dtype=np.int64), 0
    for batch in batches:
        for part in small_parts(batch):
            df += (gram_counts(part.column("text"), bits) > 0).sum(axis=0)
            n += part.num_rows
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["cell", "df"])


def _cluster(p: LanguageId, idf: np.ndarray, table: pa.Table) -> pa.Table:
    """Spherical k-means over one language's fitting rows."""
    v = np.concatenate([unit_vectors(gram_counts(part.column("text"), p.bits), idf) for batch in table.combine_chunks().to_batches() for part in small_parts(batch)])
    centres = v.mean(axis=0, keepdims=True)
    while len(centres) < min(p.clusters, len(v)):  # farthest first
        centres = np.concatenate([centres, v[[np.argmin((v @ centres.T).max(axis=1))]]])
    for _ in range(p.rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = (v @ centres.T).argmax(axis=1)
        centres = np.stack([v[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    cosines = v @ centres.T
    own = cosines.argmax(axis=1)
    radius = [float(np.sqrt(max(0.0, 2 - 2 * cosines[own == k, k].min()))) if (own == k).any() else 0.0 for k in range(len(centres))]
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": [lang] * len(centres), "centre": [c.astype(np.float32).tobytes() for c in centres], "radius": radius})


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(p: LanguageId, model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_parts(batch):
            texts = part.column("text")
            letters = np.array([has_letter(t.as_py()) for t in texts], dtype=bool)
            if model["langs"]:
                cosines = np.clip(unit_vectors(gram_counts(texts, p.bits), model["idf"]) @ model["centres"].T, 0, 1)
                best = cosines.argmax(axis=1)  # ties: the first, and languages are in order
                score = np.where(letters, cosines[np.arange(len(best)), best], 0).astype(float)
                lang = [model["langs"][k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
                far = ~letters | (np.sqrt(2 - 2 * score) > p.slack * model["radius"][best])
            else:
                score, lang, far = np.zeros(len(letters)), [UNDETERMINED] * len(letters), np.ones(len(letters), dtype=bool)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])


def rows_of_languages(train: DataFrame, counts: list) -> DataFrame:
    """lang and its number of rows, as a table of at most most_langs rows."""
    return train.sparkSession.createDataFrame(counts, "lang string, n long")


def fit(train: DataFrame, params: LanguageId = LanguageId()) -> dict:
    """The model, from train(doc_id, text, lang): IDF over all its rows, centroids from at most per_lang rows of a language, those with the least hashes of doc_id and text."""
    p = params
    train = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    size = 1 << p.bits
    df = train.select("text").mapInArrow(partial(_document_frequencies, p.bits), "cell long, df long").groupBy("cell").agg(F.sum("df").alias("df"))
    found = np.zeros(size + 1)
    for cell, n in df.collect():  # 2^bits + 1 rows at most
        found[cell] = n
    idf = (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32)
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(p.most_langs + 1).collect()
    if len(counts) > p.most_langs:
        raise ValueError(f"more than {p.most_langs} languages")
    # Twice as many rows as are wanted by a hash, before any text moves; of those the first ones.
    hashed, wanted = F.xxhash64("doc_id", "text"), F.broadcast(rows_of_languages(train, counts))
    chosen = train.join(wanted, "lang").where(F.pmod(hashed, F.lit(1 << 30)) / (1 << 30) < F.lit(2 * p.per_lang) / F.col("n"))
    chosen = chosen.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(hashed, "doc_id", "text"))).where(F.col("place") <= p.per_lang)

    def cluster(table: pa.Table) -> pa.Table:
        return _cluster(p, idf, table)

    centres = chosen.select("lang", "text").groupBy("lang").applyInArrow(cluster, "lang string, centre binary, radius double").orderBy("lang", "centre").collect()
    return {"idf": idf, "langs": [r.lang for r in centres], "centres": np.stack([np.frombuffer(r.centre, dtype=np.float32) for r in centres]) if centres else None, "radius": np.array([r.radius for r in centres])}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: dict, params: LanguageId = LanguageId()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs(doc_id, text, ...); only text decides."""
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(partial(_predict, params, model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify_languages(spark: SparkSession, docs: DataFrame, params: LanguageId = LanguageId()) -> DataFrame:
    """Learns from the rows with a lang that aren't held out and predicts every row.

    held_out: crc32 of doc_id as text is 2 modulo 4; a null doc_id isn't held
    out.  score is the cosine with the nearest centroid, 0 where there is none;
    ties go to the language first in order.  `und` is given to null texts and
    texts without a letter, and to all if nothing could be learned.  rejected
    marks those and texts too far from their centroid.  Repeated rows count
    as often as they come, further columns are ignored.
    """
    return predict(docs, fit(docs.where(~held_out()), params), params)
