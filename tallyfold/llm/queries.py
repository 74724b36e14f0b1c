"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import collision_search, filter_audit, imatch, line_crf, merge_dropout, mixture, pii, repeat_spans, severity, warc, weighted_minhash, whitening, wordpiece_count
from tallyfold.llm.common import read


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text at rate 0.1, and whether they decode to it."""
    return merge_dropout.round_trip(read(spark, sf_dir, "documents")).withColumn("n_pieces", F.size("pieces"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.listed(kinds=pii.BASE), 256).alias("base_sha256"),
        pii.listed().alias("spans"),
        F.array_max(F.transform("found", lambda s: s["score"])).alias("max_score"),
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return imatch.fingerprints(read(spark, sf_dir, "documents"))


def op4_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 2) of every document, and whether it is rejected."""
    docs = read(spark, sf_dir, "documents")
    model = severity.train(docs, read(spark, sf_dir, "labels"))
    return severity.score_column(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), (F.col("severity") >= severity.REJECT).alias("toxic"))


def op5_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    cut = repeat_spans.strip_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each vector whose id is divisible by 20."""
    return collision_search.search(read(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return weighted_minhash.classes(read(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixture.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_count.token_counts(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from the archives."""
    return warc.archive(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labelled ones that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = line_crf.train(docs, read(spark, sf_dir, "labels"))
    scored = line_crf.score_column(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", line_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_crf.ACCEPT).cast("int").alias("predicted"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes at each step of every order, by source."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_merge_dropout, op2_pii, op3_imatch, op4_severity, op5_repeat_spans, op6_collision_search, op7_weighted_minhash, op8_mixture, op9_token_counts, op10_warc, op11_whitening, op12_line_crf, op13_filter_audit)}
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Each five hexadecimal digits are four characters of base 32.
_DIGEST = " || ".join(f"substr('{_BASE32}', (('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) % 32 + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT page_id, octet_length(encode(html)) AS n, {_DIGEST} AS d, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM r""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT o, k, substr(o, k, 1) AS f, left(o, k - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        r AS (SELECT part, o, k, f, fails, n, g, x, contains(fails, f) AS here, translate(fails, earlier, '') <> fails AS gone FROM c, s),
        a AS (SELECT part, o, k, f, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN x ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
        SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM a""",
}
