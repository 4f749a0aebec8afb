"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_or_empty
from .exact_dedup import exact_dedup
from .media import media_columns
from .mixing import mix_sources
from .near_dup import jaccard_components
from .packing import pack_documents
from .quality import quality_scores
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity_scores


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_columns(load(spark, sf_dir, "documents"))
    digests = [F.lower(F.hex(F.xxhash64(F.lit(k), c))) for k, c in enumerate(("peak_times", "peak_codes"))]
    feature = F.concat_ws("-", F.size("peak_times").cast("string"), *digests)
    return stored.withColumn("feature", feature).drop("peak_times", "peak_codes")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_jaccard_join, op3_exact_dedup, op4_toxicity, op5_quality, op6_suffix_dedup, op7_media_columns, op8_token_counts, op9_packing, op10_sharding)}

ORACLES = {
    "op1_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS sid FROM d GROUP BY source),
        weighed AS (SELECT *, (sid % 3 + 1)::DOUBLE AS w, 3.0e0 * ss AS cap, sum(ss) OVER () AS budget FROM src),
        ranked AS (SELECT *, cap / w AS r, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
          sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM weighed),
        level AS (SELECT arg_min(rest / open, r) FILTER (rest / open <= r) AS level FROM ranked),
        goals AS (SELECT source, ss, sid, w, budget, least(cap, level * w) AS target FROM ranked, level),
        keyed AS (SELECT d.doc_id, d.size, g.*, ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || coalesce(d.source, '')), 1, 15))::BIGINT AS key
          FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
        flow AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS words FROM keyed),
        queue AS (SELECT *, (words + e * ss) / w AS finish FROM flow, range(0, 3) t(e) WHERE size > 0),
        served AS (SELECT *, sum(size) OVER (ORDER BY finish, sid, e, key, coalesce(doc_id, 0) ROWS UNBOUNDED PRECEDING) AS so_far FROM queue),
        taken AS (SELECT doc_id, sid, key, count(*) AS copies FROM served WHERE so_far <= budget GROUP BY ALL)
        SELECT f.doc_id, f.size, f.ss AS source_size, round(f.target, 6) AS target, (coalesce(t.copies, 0) * f.size)::BIGINT AS taken
        FROM flow f LEFT JOIN taken t ON f.doc_id IS NOT DISTINCT FROM t.doc_id AND f.sid = t.sid AND f.key = t.key""",
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op2_jaccard_join": r"""
        WITH RECURSIVE cut AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s FROM cut),
        held AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM sets""",
    "op6_suffix_dedup": r"""
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        strings AS (SELECT doc_id, unnest(range(0, n - 99)) AS i, h FROM docs WHERE n >= 100),
        keyed AS (SELECT doc_id, i, md5(substr(h, (2 * i + 1)::BIGINT, 200)) AS k FROM strings),
        late AS (SELECT doc_id, i FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        runs AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS new FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
        spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi, run FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
        parts AS (SELECT g.doc_id, g.run, substr(h, (2 * g.lo + 1)::BIGINT, (2 * (g.hi - g.lo))::BIGINT) AS p FROM gaps g JOIN docs USING (doc_id)
          UNION ALL SELECT s.doc_id, 1000000000, substr(h, (2 * s.hi + 1)::BIGINT, (2 * (n - s.hi))::BIGINT) FROM (SELECT doc_id, max(hi) AS hi FROM spans GROUP BY doc_id) s JOIN docs USING (doc_id)),
        kept AS (SELECT doc_id, string_agg(p, '' ORDER BY run) AS p FROM parts GROUP BY doc_id),
        totals AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.p, h))) AS kept_sha256
        FROM docs d LEFT JOIN totals USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
