"""The registered queries of the text operators: each runs its operator, with production parameters, on a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_tree, exact_dedup, fm_index, html_template, huffman, langid_kn, licenses, simhash_bk, toxicity_zstd
from quarry.llm.common import table

#: Vocabulary of the encoding queries; its place comes from the installed collection, never from this repository.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    nodes = chat_tree.parents_of_turns(rows.unionByName(probe))
    told = chat_tree.read_back(chat_tree.conversations(nodes))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def held_out(id_col: str = "doc_id"):
    """Rows that no fit may learn from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def op3_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_zstd.fit_toxicity(docs, table(spark, sf_dir, "labels"), where=~held_out())
    scores = toxicity_zstd.toxicity_scores(docs, model)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_token_files(spark, huffman.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2))


def op6_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_bk.near_groups(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


#: A small tree of files, so that the query shows inheritance: (id, path, text).
LICENSE_PROBE = [
    (-1, "probe/LICENSE", "Released under the MIT License."), (-2, "probe/lib/COPYING", "Licensed under the Apache License,\nVersion 2.0."),
    (-3, "probe/main.txt", "first"), (-4, "probe/lib/deep/er/part.txt", "second"), (-5, "probes/other.txt", "third"),
]


def op9_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source is the directory, their id the name. None of them is a license file; the probe's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    probe = spark.createDataFrame(LICENSE_PROBE, "doc_id long, path string, text string")
    return licenses.scan_licenses(docs.unionByName(probe))


def op10_language_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid_kn.fit_languages(docs, where=~held_out())
    return langid_kn.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")


QUERIES = {
    "op1_html_template": op1_html_template,
    "op2_chat_trees": op2_chat_trees,
    "op3_toxicity_zstd": op3_toxicity_zstd,
    "op4_fm_index": op4_fm_index,
    "op5_token_files": op5_token_files,
    "op6_simhash_bk": op6_simhash_bk,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe_forced_boundaries": op8_bpe_forced_boundaries,
    "op9_license_tfidf": op9_license_tfidf,
    "op10_language_kn": op10_language_kn,
}

ORACLE = {
    "op2_chat_trees": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
                        + len(regexp_extract_all(text, '<(\||/?s>|</?SYS>>)|\[/?INST\]')) AS escaped FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(escaped + length(role) + 16) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op4_fm_index": r"""
        WITH lower AS (SELECT doc_id, NULL AS item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
            UNION ALL SELECT NULL, CAST(item_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
        words AS (SELECT doc_id, item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower),
        wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
                 FROM words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE item_id IS NOT NULL AND len(w) > 0),
        grams AS (SELECT doc_id, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS g
                  FROM words, (SELECT DISTINCT n FROM wins) AS k, unnest(range(1, greatest(len(w) - k.n + 2, 1))) AS t(i) WHERE item_id IS NULL),
        found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, g)),
        hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) WHERE words.item_id IS NULL
    """,
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
