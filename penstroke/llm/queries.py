"""One query per operator, over the whole of its table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm import attribution, decontamination, fingerprints, language, manifest, near_duplicates, negatives, packing, pseudonyms, quality, simple8b, toxicity, warc
from penstroke.llm.tokenization import vocabulary

EXAMPLE_KEY = "penstroke"
"""The key of the registered queries alone; a deployment has a secret one."""

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(id_column: str, folds: int) -> Column:
    """The fold of a row, from the digest of its id as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents").select("doc_id", "text"), _read(spark, folder, "labels").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.score(F.col("text"), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def token_binary(spark: SparkSession, folder: str) -> DataFrame:
    return simple8b.token_files(_read(spark, folder, "documents"), vocabulary(BYTE_VOCABULARY), end_id=0)


def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(_read(spark, folder, "pages"))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit_language_model(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    predicted = language.predict_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.section_token_counts(_read(spark, folder, "documents"), vocabulary(BYTE_VOCABULARY))


def benchmark_contamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark")).drop("text_hash")


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(_read(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def private_data(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymize(_read(spark, folder, "documents").select("doc_id", "text"), EXAMPLE_KEY)


def i_match(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_fingerprints(_read(spark, folder, "documents"))


def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"), vocabulary(WORD_VOCABULARY))


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents").select("doc_id", "text"), _read(spark, folder, "labels").select("doc_id", "quality")
    scored = quality.quality_scores(docs, labels, fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine_hard_negatives(_read(spark, folder, "embeddings"), "id % 100 = 0", label=label)


def dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verify_documents(_read(spark, folder, "documents"), fold("doc_id", 5) == 0)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity_scores,
    "op2_token_binary": token_binary,
    "op3_warc": warc_records,
    "op4_language_id": language_id,
    "op5_token_counts": token_counts,
    "op6_decontamination": benchmark_contamination,
    "op7_simhash": simhash_groups,
    "op8_pii": private_data,
    "op9_fingerprints": i_match,
    "op10_packing": packed_sequences,
    "op11_quality": quality_scores,
    "op12_hard_negatives": hard_negatives,
    "op13_manifest": dataset_manifest,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
              lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)),
              4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
        ), q AS (
          SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
          CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
        FROM q""",
    "op6_decontamination": f"""
        WITH items AS (
          SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark
        ), windows AS (
          SELECT DISTINCT item_id, l, array_to_string(list_slice(w, pos + 1, pos + l), ' ') AS words
          FROM (SELECT item_id, w, l, unnest(range(len(w) - l + 1)) AS pos
                FROM (SELECT *, least(len(w), 13) AS l FROM items WHERE len(w) > 0))
        ), docs AS (
          SELECT doc_id, {_WORDS} AS w FROM documents
        ), runs AS (
          SELECT doc_id, l, pos, array_to_string(list_slice(w, pos + 1, pos + l), ' ') AS words
          FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS pos
                FROM docs, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)
        ), hits AS (
          SELECT doc_id, r.l, pos, item_id FROM runs r JOIN windows USING (words)
        ), covered AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS p FROM hits) GROUP BY doc_id
        ), found AS (
          SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
          coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op12_hard_negatives": """
        WITH r AS (
          SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
          FROM r a, r b WHERE a.vec_id % 100 = 0
        ), p AS (
          SELECT a, b, s FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
        )
        SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score,
          row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INTEGER AS rank
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s
        QUALIFY rank <= 5""",
    "op13_manifest": f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, coalesce('+' || source, '') AS grp, {_LEAF.format(text="text")} AS leaf,
            {_LEAF.format(text=f"translate(text, {_CAPITALS})")} AS lowered, {_CRC} % 5 = 0 AS tampered
          FROM documents
        ), leaves AS (
          SELECT *, row_number() OVER () AS row, count(*) OVER (PARTITION BY grp) AS n,
            row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
          FROM d
        ), nodes AS (
          SELECT 0 AS level, grp, pos::BIGINT AS pos, n::BIGINT AS n, leaf AS h FROM leaves
          UNION ALL
          SELECT level + 1, grp, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
          FROM nodes WHERE n > 1 GROUP BY level, grp, pos // 16, n
        ), roots AS (
          SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), tops AS (
          SELECT 0 AS level, pos::BIGINT AS pos, n::BIGINT AS n, h FROM roots
          UNION ALL
          SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
          FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
        ), runs AS (
          SELECT grp, level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
        ), top_runs AS (
          SELECT level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY ALL
        ), climb AS (
          SELECT row, grp, 0 AS level, pos::BIGINT AS pos, n::BIGINT AS n, '' AS siblings, CASE WHEN tampered THEN lowered ELSE leaf END AS h
          FROM leaves
          UNION ALL
          SELECT row, c.grp, c.level + 1, pos // 16, (n + 15) // 16,
            siblings || array_to_string(hs[:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], ''),
            sha256(array_to_string(hs[:pos % 16], '') || h || array_to_string(hs[pos % 16 + 2:], ''))
          FROM climb c JOIN runs u ON u.grp = c.grp AND u.level = c.level AND run = pos // 16
        ), ascend AS (
          SELECT row, c.grp, 0 AS level, r.pos::BIGINT AS pos, r.n::BIGINT AS n, siblings, c.h
          FROM climb c JOIN roots r USING (grp) WHERE c.n = 1
          UNION ALL
          SELECT row, grp, a.level + 1, pos // 16, (n + 15) // 16,
            siblings || array_to_string(hs[:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], ''),
            sha256(array_to_string(hs[:pos % 16], '') || h || array_to_string(hs[pos % 16 + 2:], ''))
          FROM ascend a JOIN top_runs u ON u.level = a.level AND run = pos // 16
        )
        SELECT doc_id, leaf, r.h AS subroot, t.h AS root, sha256(siblings) AS proof_sha256, a.h AS folded_root, a.h = t.h AS verified
        FROM ascend a JOIN leaves USING (row) JOIN roots r ON r.grp = a.grp, tops t
        WHERE a.n = 1 AND t.n = 1""",
}
