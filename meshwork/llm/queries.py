"""Queries opN_<name> over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, centroids, chat, decontamination, fingerprints, mixing, prefix_trie, quality, scoring, secrets, simhash, token_counts, token_store

#: Folder of the public tokenizer files; None: the installed package's.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a benchmark item."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return scoring.score_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written and read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in sixteen clusters."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row for each node."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token ids of every document, encoded and decoded."""
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this package."""
    made = [op1_mixing, op2_decontamination, op3_simhash, op4_secrets, op5_scoring, op6_token_counts, op7_quality, op8_fingerprints, op9_token_store, op10_chat, op11_centroids, op12_prefix_trie, op13_byte_bpe]
    return {f.__name__: f for f in made}


#: Every window of every document that shares a shingle with an item, compared by counting; no fingerprints.
OP2_SQL = r"""
WITH items AS (
  SELECT item_id, ws, len(ws) AS words, least(len(ws), 5) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) > 0),
item_shingles AS (
  SELECT item_id, words, k, h, count(*) AS n
  FROM (SELECT item_id, words, k, array_to_string(ws[i:i + k - 1], ' ') AS h FROM (SELECT *, unnest(range(1, words - k + 2)) AS i FROM items)) GROUP BY ALL),
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
places AS (
  SELECT doc_id, k, total, i - 1 AS pos, array_to_string(ws[i:i + k - 1], ' ') AS h
  FROM (SELECT doc_id, ws, len(ws) AS total, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
hits AS (SELECT p.doc_id, s.item_id, s.words, s.k, p.total, p.pos, p.h, s.n FROM places p JOIN item_shingles s ON p.h = s.h AND p.k = s.k),
starts AS (SELECT DISTINCT doc_id, item_id, unnest(range(greatest(0, pos - words + k), pos + 1)) AS first FROM hits),
shared AS (
  SELECT t.doc_id, t.item_id, t.first, h.words, h.k, h.total, h.h, h.n, count(*) AS c
  FROM starts t JOIN hits h ON h.doc_id = t.doc_id AND h.item_id = t.item_id AND h.pos BETWEEN t.first AND t.first + h.words - h.k GROUP BY ALL),
windows AS (
  SELECT doc_id, item_id, first, words, sum(least(n, c)) AS common, words - k + 1 AS m, least(words, total - first) - k + 1 AS w
  FROM shared GROUP BY doc_id, item_id, first, words, k, total),
scored AS (SELECT doc_id, item_id, first, words, common::DOUBLE / (m + w - common)::DOUBLE AS similarity FROM windows),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first) AS r FROM scored WHERE similarity >= 0.8::DOUBLE - 1e-12)
SELECT doc_id, item_id, first::BIGINT AS first_word, words::BIGINT AS n_words, similarity FROM ranked WHERE r = 1
"""


def _lloyd_sql(rounds: int = 3, k: int = 16) -> str:
    """Every vector against every centroid in each round; sums less their remainder, so that division is exact."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT p.vec_id, c.j, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM points p JOIN c{i} c ON c.i = p.i GROUP BY p.vec_id, c.j),
a{i} AS (SELECT vec_id, j, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, j) AS r FROM d{i}) WHERE r = 1)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT a.j, p.i, sum(p.x)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN points p ON p.vec_id = a.vec_id GROUP BY a.j, p.i),
c{i + 1} AS (SELECT c.j, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{i} c LEFT JOIN s{i} s ON s.j = c.j AND s.i = c.i)""")
    return f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
points AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
c0 AS (SELECT j, unnest(range(1, 65)) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, v FROM kept) WHERE j < {k}),
{",\n".join(steps)},
names AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT a.vec_id, a.j::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, n.centroid_sha256
FROM a{rounds} a JOIN names n ON n.j = a.j
"""


#: Lists of turns as keys; every node is counted into each of its prefixes. crc32 takes a byte, then its eight bits, at a time.
OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, 0 AS own, t.pos, {'r': t.r, 't': t.t} AS x FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.pos < v.h
  UNION ALL SELECT v.c, 1, t.pos, {'r': t.r, 't': t.t} FROM convs v JOIN turns t ON t.c = v.c AND t.pos >= v.h),
seqs AS (SELECT v.c, coalesce(s.xs, []) AS xs FROM convs v LEFT JOIN (SELECT c, list(x ORDER BY own, pos) AS xs FROM rebuilt GROUP BY c) s ON s.c = v.c),
steps AS (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT xs[1:depth] AS p, depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN len(xs) = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM steps GROUP BY 1, 2),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT p[1:d] AS p, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT n.p, unnest(range(0, n.depth + 1)) AS d, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf,
      CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.p[n.depth].t) END AS saved
    FROM nodes n LEFT JOIN kids ON kids.p = n.p) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN nodes up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express: the others hash, tokenise or learn."""
    return {"op2_decontamination": OP2_SQL, "op11_centroids": _lloyd_sql(), "op12_prefix_trie": OP12_SQL}
