"""The queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyagg.llm import ann, bpe, langid, mixing, parity_sketch, substring_index, suffix_array, syncmers
from polyagg.llm.chat import format_conversations, read_back
from polyagg.llm.common import table
from polyagg.llm.sharding import shard_documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_array.dedup_suffixes(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_sketch.similar_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, path, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Shares of the mixture's expected tokens.
MIXTURE = {"clean": 0.8, "poor": 0.15, "toxic": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels, MIXTURE, ("source",))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_index.dedup_substrings(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


#: A conversation whose texts are made of control strings, formatted along with the table.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return read_back(format_conversations(turns.unionByName(probe)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


SQL = {}

#: Every 50-byte string of every text, as hex digits; texts are cut into overlapping pieces first, as substr() walks from the beginning.
SQL["op1_suffix_dedup"] = r"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, start, least(512, length(h) // 2 - start) AS own, substr(h, 2 * start + 1, 2 * (512 + 49)) AS part
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 512)) AS start FROM hexed)),
every AS (SELECT doc_id, start + k AS pos, substr(part, 2 * k - 1, 2) AS byte, CASE WHEN 2 * k + 98 <= length(part) THEN substr(part, 2 * k - 1, 100) END AS win
    FROM (SELECT doc_id, start, part, unnest(range(1, own + 1)) AS k FROM pieces)),
firsts AS (SELECT win, min(doc_id) AS least FROM every WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
found AS (SELECT doc_id, pos, byte, coalesce(doc_id > least, false) AS again FROM every LEFT JOIN firsts USING (win)),
gone AS (SELECT doc_id, pos, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed FROM found),
runs AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM gone),
kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY pos) FILTER (NOT removed), '') AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM hexed LEFT JOIN kept USING (doc_id)
"""

#: All pairs of classes that share a shingle, and everything that links reach.
SQL["op2_similarity_join"] = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
said AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split),
runs AS (SELECT doc_id, pos, string_agg(word, ' ') OVER ahead AS shingle, count(*) OVER ahead AS words FROM said
    WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE words = 5 OR pos = 1),
named AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS name FROM sets GROUP BY doc_id),
classed AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY name) AS class_id FROM named),
base AS (SELECT doc_id, n, shingle FROM classed JOIN sets USING (doc_id) WHERE doc_id = class_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM base x JOIN base y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, x.n, y.doc_id, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM classed WHERE doc_id = class_id UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS class_id, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, class_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN classed USING (doc_id) LEFT JOIN lowest USING (class_id) LEFT JOIN degree USING (class_id)
"""

#: Every window of 50 words, written out.
SQL["op6_substring_dedup"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
said AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split),
every AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(word, ' ') OVER ahead END AS win FROM said
    WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT win, min(doc_id) AS least FROM every WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
found AS (SELECT doc_id, pos, word, coalesce(doc_id > least, false) AS again FROM every LEFT JOIN firsts USING (win)),
gone AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS removed FROM found),
kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed), '') AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

#: The turns themselves; lengths by the template's marks, where an escaped control string takes three characters.
SQL["op10_chat_formatting"] = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
placed AS (SELECT *, row_number() OVER turns AS pos, lag(role, 1, '') OVER turns AS state,
    length(regexp_replace(text, '\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[BODY\]|\\', '...', 'g')) AS escaped,
    length(regexp_replace(role, '\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[BODY\]|\\', '...', 'g')) AS escaped_role
    FROM said WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, escaped + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + escaped_role END AS chars,
    CASE WHEN NOT (role = 'user' AND state IN ('', 'system', 'assistant') OR role = 'system' AND state = '' OR role = 'assistant' AND state = 'user')
    THEN coalesce(nullif(role, ''), 'no role') || ' after ' || coalesce(nullif(state, ''), 'start') END AS problem FROM placed),
whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, arg_min(problem, pos) FILTER (problem IS NOT NULL) AS broken, arg_max(role, pos) AS last
    FROM judged GROUP BY conv_id),
named AS (SELECT *, coalesce(broken, CASE WHEN last <> 'assistant' THEN 'ends with ' || coalesce(nullif(last, ''), 'no role') END) AS problem FROM whole)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, problem IS NULL AS valid, problem FROM named
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
