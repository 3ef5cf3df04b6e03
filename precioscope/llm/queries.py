"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), word_bpe_path())


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.pii import find_personal

    return find_personal(_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.ngramjoin import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"))


def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.filtering import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from precioscope.llm.ranking import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_votes": op1_quality_votes,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_personal_data": op3_personal_data,
    "op4_media_columns": op4_media_columns,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_license_sentences": op7_license_sentences,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_source_mixing": op9_source_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_balanced_shards": op11_balanced_shards,
    "op12_vector_codes": op12_vector_codes,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": pipeline,
}

def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """SQL of the vector codes, every round a full assignment."""
    near = lambda book: f"""SELECT p.row, p.pos, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.entry}}) AS best FROM p JOIN {book} b ON b.pos = p.pos GROUP BY p.row, p.pos"""
    sql = f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT row, pos, list_slice(e, pos * len(e) // {parts} + 1, (pos + 1) * len(e) // {parts}) AS x FROM v, (SELECT unnest(range({parts})) AS pos)),
        b0 AS (SELECT pos, row - 1 AS entry, x FROM p WHERE row <= {entries})"""
    for r in range(rounds):
        sql += f""",
        a{r} AS ({near(f"b{r}")}),
        s{r} AS (SELECT p.pos, best.e AS entry, i, sum(x[i]) AS s, count(*) AS c FROM p JOIN a{r} ON a{r}.row = p.row AND a{r}.pos = p.pos, (SELECT unnest(range(1, 257)) AS i) WHERE i <= len(x) GROUP BY ALL),
        m{r} AS (SELECT pos, entry, list(((s - (((s % c) + c) % c)) // c)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY pos, entry),
        b{r + 1} AS (SELECT b.pos, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.pos = b.pos AND m.entry = b.entry)"""
    return sql + f""",
        f AS ({near(f"b{rounds}")}),
        c AS (SELECT row, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY row),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (row), h"""


ORACLES: dict[str, str] = {
    "op6_warc_revisits": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, payload_bytes, p.payload_digest,
               CASE WHEN original IS NULL OR original = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original <> p.page_id THEN original END AS refers_to
        FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 1000""",
    "op8_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_vector_codes": _codes_sql(),
    "op13_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        i AS (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        t AS (SELECT count(*)::BIGINT AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
        p AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, t GROUP BY term),
        q AS (SELECT item_id, text, term, count(*)::BIGINT AS times FROM i GROUP BY ALL),
        s AS (SELECT item_id, text, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms)::BIGINT * N) // L))))::BIGINT AS score
              FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row), t GROUP BY ALL),
        r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s JOIN d USING (row) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
