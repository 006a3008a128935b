"""The training-data operators as driver queries over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, language_id, media, merkle, toxicity
from .compression_bands import measure
from .decontamination import find_contamination
from .filter_audit import audit_filters
from .packing import pack_documents
from .secrets import scan_secrets
from .simhash import simhash_components
from .substring_dedup import remove_repeats
from .token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(of: int, at: int):
    return F.coalesce(language_id.remainder("doc_id", of) == at, F.lit(False)).alias("held_out")


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs, language_id.remainder("doc_id", 5) != 0)
    return language_id.predict(docs, model).select("doc_id", _held_out(5, 0), "lang_pred", "score", "ambiguous")


ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT r, i, array_to_string(list_slice(words, i, i + 34), ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
c AS (SELECT DISTINCT r, i + o AS j FROM w, range(35) x(o) WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
u AS (SELECT r, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM d),
t AS (SELECT u.r, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN c ON u.r = c.r AND u.j = c.j GROUP BY u.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, language_id.remainder("doc_id", 4) != 2)
    return toxicity.score(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


@_query
def op4_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    recordings = media.media_from_vectors(media.tracks_from_vectors(_table(spark, sf_dir, "embeddings")))
    return media.align_recordings(recordings, F.col("media_id") % 20 == 0)


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extraction.extract_text(pages, html_extraction.learn(pages))


@_query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


@_query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(_table(spark, sf_dir, "documents"))


#: The sums run over sets of failed filters; removal, orders and the Shapley sum follow their definitions.
ORACLES["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(list_slice(bits, 1, step - 1)), 0) AS INT) AS before FROM o, range(1, 6) r(step)),
t AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t"""


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Nodes of both trees by recursion over levels; CRC-32 by its table, which is worked out from the polynomial.
ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS c FROM range(256) r(i)),
e AS (SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
 translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
 xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, c[CAST(xor(a, b) & 255 AS BIGINT) + 1]))) % 3 = 0 AS tampered FROM documents, tab),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
 sha256(head || coalesce(CASE WHEN tampered THEN strlen(low) || ':' || low ELSE strlen(text) || ':' || text END, '-')) AS claim FROM e)),
n AS (SELECT lang, 0 AS lev, i, leaf AS h, n AS c FROM p UNION ALL SELECT lang, lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (c + 7) // 8 FROM n WHERE c > 1 GROUP BY lang, lev, i // 8, c),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM n WHERE c = 1),
t AS (SELECT 0 AS lev, j AS i, subroot AS h, m AS c FROM s UNION ALL SELECT lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (c + 7) // 8 FROM t WHERE c > 1 GROUP BY lev, i // 8, c),
b AS (SELECT r, n.lev AS lev, n.i AS i, n.h AS h, p.i // CAST(power(8, n.lev) AS BIGINT) AS own FROM p JOIN n ON p.lang IS NOT DISTINCT FROM n.lang AND n.c > 1 AND n.i // 8 = p.i // CAST(power(8, n.lev + 1) AS BIGINT)
 UNION ALL SELECT r, 100 + t.lev, t.i, t.h, s.j // CAST(power(8, t.lev) AS BIGINT) FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN t ON t.c > 1 AND t.i // 8 = s.j // CAST(power(8, t.lev + 1) AS BIGINT)),
q AS (SELECT r, lev, row_number() OVER (PARTITION BY r ORDER BY lev) AS k, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS z FROM b GROUP BY r, lev),
f AS (SELECT r, 0 AS k, claim AS h FROM p UNION ALL SELECT f.r, f.k + 1, sha256(a || h || z) FROM f JOIN q ON q.r = f.r AND q.k = f.k + 1),
g AS (SELECT r, arg_max(h, k) AS folded_root FROM f GROUP BY r),
y AS (SELECT r, sha256(string_agg(a || z, '' ORDER BY k)) AS proof_sha256 FROM q GROUP BY r)
SELECT doc_id, leaf, subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN t ON t.c = 1 JOIN g USING (r) LEFT JOIN y USING (r)"""


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = merkle.leaf_digest(merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS)
    claim = F.when(language_id.remainder("doc_id", 3) == 0, tampered)
    rows = merkle.build_manifest(_table(spark, sf_dir, "documents"), claim=claim)
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("proof"))
    rows = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
