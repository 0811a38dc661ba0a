"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkstrata.llm.common import materialize
from sparkstrata.llm import collocations, context_mixing, packing, page_difference, piece_bpe, quality_knn, rotation_codes, separator_scan, simhash_blocks, simhash_cover, substring_dedup, token_alignment, web_archives


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, which lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash_blocks.with_edits(table(spark, sf_dir, "documents"))
    near = simhash_blocks.near_groups(prints)
    return prints.join(near, ["hi", "lo"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.concat(_hex("hi"), _hex("lo")).alias("fingerprint"),
        F.concat(_hex("edited_hi"), _hex("edited_lo")).alias("edited_fingerprint"), "near_edited", "near_next", "near_id",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return separator_scan.count_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_cover.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_difference.extract(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation_codes.near_links(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archives.archive_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_lm_scoring,
        op3_token_counts,
        op4_simhash_near_dedup,
        op5_sentencepiece,
        op6_html_extraction,
        op7_quality_classifier,
        op8_packing,
        op9_embedding_near_dedup,
        op10_substring_dedup,
        op11_cross_tokenizer_alignment,
        op12_phrase_collocation_mining,
        op13_warc,
    )
}

ORACLE_SQL = {
    "op13_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
                   (instr('0123456789abcdef', substr(hex, CAST(1 + (5 * i) // 4 AS INTEGER), 1)) - 1) * 16 + instr('0123456789abcdef', substr(hex, CAST(2 + (5 * i) // 4 AS INTEGER), 1)) - 1)
                   >> CAST(3 - (5 * i) % 4 AS INTEGER)) % 32 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op12_phrase_collocation_mining": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        gram AS (
            SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase
            FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE len(w) >= d)),
        f AS (SELECT lang, d, phrase, count(*) AS f FROM gram GROUP BY lang, d, phrase HAVING count(*) >= 30),
        c AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE d >= 2),
        cut AS (SELECT lang, d, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:d], ' ') AS rp FROM (SELECT *, unnest(range(1, d)) AS k FROM c)),
        part AS (
            SELECT cut.*, x.f AS l, y.f AS r, 2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM part) WHERE nth = 1),
        inside AS (
            SELECT lang, array_to_string(w[i:i + e - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, d - e + 2)) AS i FROM (SELECT *, unnest(range(2, d)) AS e FROM c)) GROUP BY ALL),
        kept AS (
            SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase
            WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000""",
    "op9_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
        link AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
        reach AS (SELECT u, w FROM link UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u)
        SELECT e.vec_id, CAST((SELECT count(*) FROM link WHERE u = e.vec_id) AS BIGINT) AS n_links,
               least(e.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = e.vec_id), e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = e.vec_id), e.vec_id)) AS kept
        FROM embeddings e""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM s),
        f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t),
        hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (t) WHERE first < doc_id),
        gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)""",
}
