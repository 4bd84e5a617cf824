"""Token counts with a cache of content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"
#: Words whose counts a Python worker remembers; emptied when full, results don't depend on it.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 64
#: What the piece library writes for a space.
SPACE = "▁"


class PieceCounter:
    """Counts for a sentencepiece model.

    If no piece has a space after its first other character, no merge crosses
    from a word to the next, and the first word's added space makes it like any
    other.  Then the counts of words, each encoded by the library, add up to the
    text's.  Texts with runs of spaces, or spaces at an end, are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in pieces) and self.model.encode("a b", out_type=str) == [f"{SPACE}a", f"{SPACE}b"]
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            if not self.by_word or not text or "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
                out.append(len(self.model.encode(text)))
                continue
            words, known = text.split(" "), self.known
            new = [w for w in set(words) if w not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(words))
            known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
            out.append(sum(map(known.__getitem__, words)))
            for w in new:
                if len(w) > REMEMBERED_LENGTH:
                    del known[w]
        return out


class JsonCounter:
    """Counts for a file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]


_LOADED: dict[str, PieceCounter | JsonCounter] = {}


def counter(path: str) -> PieceCounter | JsonCounter:
    if path not in _LOADED:
        _LOADED[path] = JsonCounter(path) if path.endswith(".json") else PieceCounter(path)
    return _LOADED[path]


def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            n = counter(path).counts([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], names=["content", "n_tokens"])


def tokenizer_version(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").digest()


def read_cache(docs: DataFrame, cache: str) -> DataFrame:
    try:
        return docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return docs.sparkSession.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text, ...).

    cache: a folder that Spark reaches, with a table (content, tokenizer,
    n_tokens) keyed by the SHA-256 of the content and of the tokenizer's file.
    Content is normalised to UTF-8 with null as the empty text, and no further,
    since any other change could change a count.  Of the contents the cache
    lacks, each is encoded once, however many documents share it, and appended;
    rows that repeat doc_id and text alike are each encoded, with the same count.

    A null text counts 0 bytes and 0 tokens.  Rows that repeat, or repeat a
    doc_id, each get their own count; further columns are ignored.
    """
    version = tokenizer_version(path)
    text = F.coalesce("text", F.lit(""))
    content = F.unhex(F.sha2(text, 256))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    ours = F.col("tokenizer") == F.lit(version)
    stored = read_cache(docs, cache).where(ours).select("content")
    missing = rows.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(stored, "content", "left_anti")
    wanted = missing.withColumnRenamed("doc_id", "least_id")
    texts = docs.select("doc_id", text.alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id"))).where(content == F.col("content"))
    counted = texts.select("content", "text").mapInArrow(partial(_encode, path), "content binary, n_tokens long")
    counted = counted.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(docs, cache).where(ours).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
