"""The queries of this package: each applies one operator to its whole table and derives the columns to return."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import chat, clustering, decontaminate, embedding_dedup, language, lexical_search, line_dedup, packing, quality, secret_scan, simhash_dedup, substring_dedup, topk_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations (tree, formatted, loss_spans): turns, loss text, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = chat.read_back(formatted)
                learned = "".join(chat.unescape(formatted[s["start"] : s["end"]], chat._TEXT) for s in mask)
                for name, value in zip(out, (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)), strict=True):
                    out[name].append(value)
            types = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
            yield pa.record_batch({"conv_id": batch.column("conv_id"), **{n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()}})

    return conversations.select(F.col("tree").alias("conv_id"), "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(chat.format_conversations(chat.chain(rows)))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_removed")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secret_scan.corpus_words(docs)
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_findings(spark), words), words, path_col="source")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_benchmark_decontamination, op3_best_fit_packing, op4_quality_classifier, op5_substring_dedup, op6_line_dedup, op7_language_id, op8_secret_scans, op9_embedding_near_dedup, op10_simhash_near_dedup, op11_ranked_lexical_search, op12_centroid_clustering, op13_exact_topk_search)
}

_OP1 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), coded AS (
  SELECT *, length(role) + length(text) + 15
    + 4 * (length(text) - length(replace(text, '&', '')) + length(role) - length(replace(role, '&', '')))
    + 3 * (length(text) - length(replace(text, '<', '')) + length(role) - length(replace(role, '<', '')))
    + 5 * (length(role) - length(replace(role, '|', ''))) + 3 * (length(role) - length(replace(role, '>', ''))) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) - 2 * count(*) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP2 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.s = v.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(named.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP6 = """
WITH lines AS (
  SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), pairs AS (
  SELECT doc_id, i, lead(i) OVER own AS upto, line || chr(10) || lead(line) OVER own AS chunk FROM lines
  WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') WINDOW own AS (PARTITION BY doc_id ORDER BY i)
), marked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, i) > 1 AS again FROM pairs WHERE upto IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, upto + 1)) AS i FROM marked WHERE again),
built AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE b.text END AS text, coalesce(b.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN built b USING (doc_id)
"""

_OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least_of m ON v.vec_id = m.x LEFT JOIN counts c ON v.vec_id = c.x
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_OP11 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS d, {_TERMS} AS w FROM documents),
items AS (SELECT item_id, row_number() OVER () AS i, list_distinct({_TERMS}) AS w FROM benchmark),
sizes AS (SELECT doc_id, d, CAST(len(w) AS BIGINT) AS n FROM docs),
total AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, i, unnest(w) AS term FROM items),
counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY d, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term),
lengths AS (SELECT doc_id, d, 50 + (50 * n * docs) // terms AS m FROM sizes, total WHERE n > 0),
scores AS (
  SELECT item_id, i, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (d) GROUP BY item_id, i, d, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""

#: The first centroids, ten rounds that each replace them, and the last assignment.
_OP12_NEAREST = """
  SELECT v, vec_id, e, cluster, distance FROM (
    SELECT v, vec_id, e, cluster, distance, row_number() OVER (PARTITION BY v ORDER BY distance, cluster) AS place
    FROM (SELECT v, vec_id, e, cluster, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(e, c)]) AS distance FROM vecs, c{n})
  ) WHERE place = 1"""
_OP12_ROUND = """a{n} AS MATERIALIZED ({nearest}),
m{n} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY cluster, i) GROUP BY cluster
),
c{next} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster)),
"""
_OP12 = (
    """
WITH vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS v, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, c) - 1 AS INTEGER) AS cluster, c FROM (SELECT sha256('3:' || vec_id) AS h, e AS c FROM vecs ORDER BY h, c LIMIT 8)
),
"""
    + "".join(_OP12_ROUND.format(n=n, next=n + 1, nearest=_OP12_NEAREST.format(n=n)) for n in range(10))
    + f"""last AS MATERIALIZED ({_OP12_NEAREST.format(n=10)}),
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM last GROUP BY cluster)
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM last) AS inertia,
  sha256(array_to_string(c10.c, ',')) AS centroid_sha256
FROM last JOIN sums USING (cluster) JOIN c10 USING (cluster)
"""
)

_OP13 = """
WITH vecs AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT q.vec_id AS query_id, q.r, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM vecs q JOIN vecs v ON q.r <> v.r AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": _OP1, "op2_benchmark_decontamination": _OP2, "op6_line_dedup": _OP6, "op9_embedding_near_dedup": _OP9, "op11_ranked_lexical_search": _OP11, "op12_centroid_clustering": _OP12, "op13_exact_topk_search": _OP13}
