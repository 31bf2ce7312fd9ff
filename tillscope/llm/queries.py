"""The corpus queries: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import (
    alignment,
    bpe,
    line_dedup,
    online_packing,
    packing,
    phrases,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    topk,
    toxicity,
    warc,
)
from tillscope.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; installed with its package on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    labelled = quality_rules.labelled_statistics(docs, table(spark, root, "labels"))
    judged = quality_rules.judge(docs, quality_rules.learn_rules(labelled))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, root, "documents"), width=3)
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query(
    "op6_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
    ),
    keyed AS (
        SELECT *, translate(
            trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ),
    shared AS (
        SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
        GROUP BY key HAVING min(doc_id) < max(doc_id)
    )
    SELECT k.doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL), ''))
            AS kept_sha256
    FROM keyed k LEFT JOIN shared s ON k.key = s.key AND k.doc_id > s.first_doc
    GROUP BY k.doc_id
    """,
)
def op6_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, root, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256")
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.transduce(table(spark, root, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op7_packing")
def op7_packing(spark: SparkSession, root: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, root, "documents"), path)


@query(
    "op2_warc",
    """
    WITH marked AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
            sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ),
    firsts AS (
        SELECT *, CASE WHEN payload_bytes >= 100
            THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_id
        FROM marked
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first_id < page_id THEN first_id END AS refers_to
    FROM firsts
    """,
)
def op2_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.archive_pages(table(spark, root, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op5_topk",
    """
    WITH v AS (
        SELECT vec_id,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
        FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
        FROM scored
    )
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
)
def op5_topk(spark: SparkSession, root: str) -> DataFrame:
    return topk.top_k(table(spark, root, "embeddings"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return substring_dedup.removed_spans(table(spark, root, "documents"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, root: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, root, "documents"), path, separator=49407)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, root, "labels")))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    left, right = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment.align(table(spark, root, "documents"), left, right)


@query("op12_online_packing")
def op12_online_packing(spark: SparkSession, root: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return online_packing.pack_online(table(spark, root, "documents"), path, end=2)


@query(
    "op13_collocations",
    """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\n\x0B\f\r]')) AS piece
        FROM documents WHERE text IS NOT NULL
    ),
    numbered AS (SELECT row_number() OVER () AS id, lang, piece FROM pieces),
    split AS (SELECT id, lang, string_split_regex(piece, '[ \\t]+') AS ws FROM numbered),
    each AS (SELECT id, lang, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM split),
    words AS (
        SELECT lang, w AS w1, lead(w, 1) OVER own AS w2, lead(w, 2) OVER own AS w3
        FROM each WHERE w <> '' WINDOW own AS (PARTITION BY id ORDER BY pos)
    ),
    grams AS (
        SELECT lang, 1 AS k, w1 AS phrase FROM words
        UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM words WHERE w2 IS NOT NULL
        UNION ALL
        SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM words WHERE w3 IS NOT NULL
    ),
    f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    candidates AS (
        SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w
        FROM f WHERE k > 1 AND n >= 10
    ),
    cuts AS (
        SELECT c.lang, c.k, c.phrase, c.a, i, l.n AS l, r.n AS r,
            CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT)
                AS score
        FROM candidates c
        JOIN (VALUES (1), (2)) AS t(i) ON i < c.k
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : i], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[i + 1 : c.k], ' ')
    ),
    weakest AS (
        SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS place FROM cuts
    ),
    longer AS (
        SELECT lang, phrase, max(a) AS most FROM (
            SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM candidates WHERE k = 3
            UNION ALL
            SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE k = 3
        ) GROUP BY ALL
    ),
    ranked AS (
        SELECT x.*, row_number() OVER (
            PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, encode(x.phrase)) AS rank
        FROM weakest x LEFT JOIN longer y ON x.lang = y.lang AND x.phrase = y.phrase
        WHERE place = 1 AND (y.most IS NULL OR 100 * y.most < 50 * x.a)
    )
    SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, root: str) -> DataFrame:
    return phrases.collocations(table(spark, root, "documents"))
