"""Queries over the given tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import crosspolytope, exactdedup, fim, langid, lexical, lmscore, minhash, mixing, packing, secrets, topk, urlfilter, warc
from waymark.llm.common import shared_path, table
from waymark.llm.labels import labelled_findings, labelled_urls


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


#: The rules (host, path, verdict) of op6.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_findings(), "doc_id long, text string, source string, label int")
    return secrets.scan(table(spark, sf_dir, "documents"), labelled)


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.identify(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_urls(), "url string, blocked boolean")
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES, urlfilter.fit(labelled))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "packages")
    warc.write_pages(table(spark, sf_dir, "pages"), at)
    return warc.read_packages(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_masked_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lmscore.score(docs, lmscore.learn(docs))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: gone are those without a letter (null and empty texts too), and no others, however many languages were learned.

    Rows that repeat and null identifiers stay; without any label all rows stay; of an empty table nothing comes.
    """
    net = langid.learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if net is None:
        return docs
    new = ["lang_pred", "score"]
    while set(new) & set(docs.columns):
        new = [f"_{c}" for c in new]
    judged = langid.identify(docs, net, keep=tuple(c for c in docs.columns if c != "doc_id"), names=tuple(new))
    return judged.where(F.col(new[0]) != langid.UNKNOWN).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the smallest identifier (null is the smallest); null and empty texts are one text, and so are rows that repeat."""
    return exactdedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest identifier; texts without words and rows without an identifier all stay."""
    return minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in the order of the mixture; a null source is one of its own, and rows of equal identifiers come in either order."""
    return mixing.mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences that follow the rows' order; a null or empty text is one end token, and repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ordered=True)  # the order that the mixing stage wrote


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_secret_scan, op3_pattern_packing, op4_pfair_mixing, op5_language_id, op6_url_filter, op7_minhash_near_dedup, op8_exact_dedup, op9_warc_packages, op10_masked_lm_scoring, op11_fill_in_middle, op12_embedding_near_dedup, op13_ranked_search, pipeline)}

ORACLE = {
    "op1_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        QUALIFY rank <= 5""",
    "op9_warc_packages": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS response FROM p)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
          CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM r""",
    "op4_pfair_mixing": """
        WITH RECURSIVE src AS (SELECT coalesce('=' || source, '') AS key, count(*) AS n FROM documents GROUP BY 1),
        sh AS (SELECT key, n, CAST(greatest(1, round(sqrt(CAST(n AS DOUBLE)) / max(sqrt(CAST(n AS DOUBLE))) OVER () * 1099511627776)) AS HUGEINT) AS share FROM src),
        s AS (SELECT list(key ORDER BY key) AS keys, list(share ORDER BY key) AS a, CAST(sum(share) AS HUGEINT) AS total, max(((n + 31) // 32 + 1) / CAST(share AS DOUBLE)) * CAST(sum(share) AS DOUBLE) + 2 AS slots FROM sh),
        sched AS (
          SELECT CAST(-1 AS HUGEINT) AS slot, list_transform(a, lambda x: CAST(0 AS HUGEINT)) AS placed, CAST(NULL AS STRUCT(due HUGEINT, i BIGINT, k HUGEINT)) AS best FROM s
          UNION ALL
          SELECT slot, list_transform(range(1, len(placed) + 1), lambda i: placed[i] + CASE WHEN i = best.i THEN 1 ELSE 0 END), best
          FROM (SELECT slot + 1 AS slot, placed, list_min(list_filter(list_transform(range(1, len(placed) + 1), lambda i:
                  CASE WHEN placed[i] * total // a[i] <= slot + 1 THEN {'due': ((placed[i] + 1) * total + a[i] - 1) // a[i], 'i': i, 'k': placed[i]} END),
                  lambda b: b IS NOT NULL)) AS best FROM sched, s WHERE slot < slots) x),
        laid AS (SELECT keys[best.i] AS key, best.k AS k, slot FROM sched, s WHERE slot >= 0),
        ends AS (SELECT min(slot) AS horizon FROM sh JOIN laid USING (key) WHERE k = (n + 31) // 32),
        r AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, row_number() OVER (PARTITION BY coalesce('=' || source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rk FROM documents)
        SELECT doc_id, source, rk // 32 AS block, CAST(slot AS BIGINT) AS slot, rk % 32 AS place, CAST((rk // 32) * total // share AS BIGINT) AS release,
          CAST(((rk // 32 + 1) * total + share - 1) // share AS BIGINT) AS deadline, slot < horizon AS balanced
        FROM r JOIN sh USING (key) JOIN laid ON laid.key = r.key AND laid.k = rk // 32, ends, s""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
        d AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
          sha256(text) AS restored_sha256 FROM p""",
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op13_ranked_search": r"""
        WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        d AS (SELECT row, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
        g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
        tf AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(w) AS term FROM d) u GROUP BY row, term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        tw AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x, g),
        c AS (SELECT row, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))) AS adds FROM tf JOIN d USING (row) JOIN tw USING (term), g),
        s AS (SELECT item_id, row, doc_id, CAST(sum(adds) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY item_id, row, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY rank <= 50""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
          doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t""",
}
