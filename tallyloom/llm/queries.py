"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.byte_bpe import round_trip_digests
from tallyloom.llm.conversation_trie import conversation_trie
from tallyloom.llm.covering_simhash import simhash_duplicates
from tallyloom.llm.decontaminate import contaminated
from tallyloom.llm.language_id import identify_languages
from tallyloom.llm.line_dedup import drop_duplicate_lines
from tallyloom.llm.near_dedup import NearDedup, near_duplicates
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.substring_dedup import parse
from tallyloom.llm.token_counts import count_tokens
from tallyloom.llm.top_k import top_k
from tallyloom.llm.toxicity import fit, score
from tallyloom.llm.vector_codes import vector_codes, with_label_errors
from tallyloom.llm.warc import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    index = scratch.write(write_archives(table(spark, sf_dir, "pages"), folder), "index")
    return read_archives(index, folder)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is new for each call, so that every distinct text is encoded."""
    cache = f"{Scratch(spark, 'counts').root}/cache"
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDedup(words=2)).select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark, table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_errors(vector_codes(table(spark, sf_dir, "embeddings"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: CRC-32 of a column's decimal digits, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda s: list_transform(range(8), lambda i: (ascii(s) >> i) & 1)))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""



def _lloyd_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds: assignment a0 from codebook c0, codebook c1 from its means, and so on."""
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT row, p, min((d, k)) AS m FROM (SELECT row, p, k, {distance} AS d FROM parts JOIN c{r} USING (p)) GROUP BY row, p)")
        if r < rounds:
            mean = f"SELECT p, k, list(m ORDER BY i) AS y FROM (SELECT p, k, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (SELECT p, m[2] AS k, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r} JOIN parts USING (row, p)) GROUP BY p, k, i) GROUP BY p, k"
            steps.append(f"n{r} AS ({mean}), c{r + 1} AS (SELECT p, k, coalesce(n.y, o.y) AS y FROM c{r} o LEFT JOIN n{r} n USING (p, k))")
    return f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS (SELECT row, p, e[len(e) // 4 * p + 1 : len(e) // 4 * (p + 1)] AS x FROM v CROSS JOIN (SELECT unnest(range(4)) AS p)), c0 AS (SELECT p, row - 1 AS k, x AS y FROM parts WHERE row <= 256), {', '.join(steps)},
  b AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}),
  f AS (SELECT row, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (row) CROSS JOIN b"""


#: The others have no SQL form that DuckDB can run; their tests hold them against brute force or libraries.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""WITH d AS (SELECT doc_id, coalesce({WORDS.format('text')}, []) AS w FROM documents),
  s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, w FROM d), k AS (SELECT doc_id, start, sha256(array_to_string(w[start : start + 19], ' ')) AS phrase FROM s),
  f AS (SELECT doc_id, start, (doc_id, start) > min((doc_id, start)) OVER (PARTITION BY phrase) AS again FROM k),
  x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
  c AS (SELECT x.doc_id, pos, word, coalesce(bool_or(again) OVER (PARTITION BY x.doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.start = x.pos),
  a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op4_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
  SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op6_warc": """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS w FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM d),
  s AS (SELECT doc_id, unnest(g) AS shingle FROM g), n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), m AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
  SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM n LEFT JOIN m USING (doc_id)""",
    "op12_vector_codes": _lloyd_sql(),
    "op13_prefix_trie": f"""WITH f AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  t AS (SELECT conv_id, turn, role, left(text, 64) AS head, sha256(strlen(role) || ':' || role || text) AS k, len({WORDS.format('text')}) AS w FROM f),
  l AS (SELECT conv_id, list({{k: k, w: w}} ORDER BY turn NULLS FIRST, role, head, k) AS turns FROM t GROUP BY conv_id),
  c AS (SELECT *, {CRC32.format('conv_id')} % 4 AS h FROM l),
  p AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS path FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 20),
  m AS (SELECT conv_id, d, path[1:d] AS node, len(path) = d AS stops FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
  n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE stops), '')) AS ends_sha256 FROM m GROUP BY node, d),
  k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
  v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * node[d].w ELSE 0 END AS saved FROM n LEFT JOIN k USING (node)),
  u AS (SELECT node[1:i] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM v) GROUP BY 1)
  SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256 FROM v JOIN u USING (node) LEFT JOIN n o ON o.d = v.d - 1 AND o.node = v.node[1:v.d - 1]""",
}
