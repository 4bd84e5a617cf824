"""Features of prompts: compatibility-normalised text, signed feature hashing, word trigrams, by batches of texts."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# Buckets of the signed vector, FNV-1a's offset and prime, what joins the words of a trigram.
BUCKETS, OFFSET, PRIME, JOINT = 48, 2166136261, 16777619, "\u0001"
_BLANK, _WORD, _DIGIT = regex.compile(r"[\s﻿]+"), regex.compile(r"[\p{L}\p{N}_]+"), regex.compile("[0-9]")
#: Texts whose words and trigrams are held at once; a batch has as many texts as Spark hands over.
AT_ONCE = 256
FEATURES = StructType([
    StructField("normalized", StringType()), StructField("words", LongType()), StructField("chars", LongType()), StructField("uniq", DoubleType()), StructField("digits", DoubleType()),
    StructField("vector", ArrayType(DoubleType())), StructField("trigrams", ArrayType(LongType())),
])


def utf16_hashes(texts: list[str]) -> np.ndarray:
    """Unsigned 32-bit FNV-1a over the UTF-16 units of each text, a unit of all texts at a time."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    size = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate([np.zeros(0, dtype="<u2"), *units]).astype(np.uint64)
    start = np.cumsum(size) - size
    hashes = np.full(len(texts), OFFSET, dtype=np.uint64)
    longest_first = size[order]
    for i in range(int(size.max(initial=0))):
        some = order[: int(np.searchsorted(-longest_first, -i, side="left"))]  # texts of more than i units
        hashes[some] = (hashes[some] ^ flat[start[some] + i]) * np.uint64(PRIME) & np.uint64(0xFFFFFFFF)
    return hashes.astype(np.int64)


def normalized_texts(texts: pa.Array) -> list[str]:
    """NFKC, lower case, white space of any kind single and none at the ends; null is empty."""
    return [_BLANK.sub(" ", unicodedata.normalize("NFKC", t or "").lower()).strip(" ") for t in texts.to_pylist()]


def _features(texts: list[str]) -> pd.DataFrame:
    rows, words = [], [_WORD.findall(t) for t in texts]
    grams = [[JOINT.join(w)] if 0 < len(w) < 3 else [JOINT.join(g) for g in zip(w, w[1:], w[2:], strict=False)] for w in words]
    known = sorted({x for w in words for x in w} | {g for gs in grams for g in gs})
    code = dict(zip(known, utf16_hashes(known).tolist(), strict=True))
    for text, w, gs in zip(texts, words, grams, strict=True):
        h = np.array([code[x] for x in w], dtype=np.int64)
        vector = np.bincount(h % BUCKETS, np.where(h >> 31, -1.0, 1.0), BUCKETS) if len(h) else np.zeros(BUCKETS)
        norm = float(np.sqrt((vector * vector).sum()))
        chars = len(text.encode("utf-16-le", "surrogatepass")) // 2
        unique, digits = len(set(w)) / len(w) if w else 0.0, len(_DIGIT.findall(text)) / chars if chars else 0.0
        rows.append((text, len(w), chars, unique, digits, np.concatenate([vector / norm if norm else vector, [np.log1p(len(w)), unique, digits]]), np.array(sorted({code[g] for g in gs}), dtype=np.int64)))
    return pd.DataFrame(rows, columns=[f.name for f in FEATURES])


@F.pandas_udf(FEATURES)
def _prompt_features(texts: pd.Series) -> pd.DataFrame:
    parts = [_features(normalized_texts(pa.Array.from_pandas(texts[i : i + AT_ONCE], type=pa.string()))) for i in range(0, max(len(texts), 1), AT_ONCE)]
    return pd.concat(parts, ignore_index=True)


def prompt_features(text: Column) -> Column:
    """normalized, words, chars (UTF-16 units), uniq, digits, vector and trigrams of a text.

    The vector has 48 buckets of signed word counts with length 1, then
    ln(1 + words), the share of unique words and that of digits.  trigrams are the
    sorted distinct hashes of word trigrams, of all words where there are fewer
    than three.  A null or wordless text has zeros and no trigrams.
    """
    return _prompt_features(text)
