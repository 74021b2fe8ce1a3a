"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, class_lm, digest_index, license_scan, merkle, ngram_join, packing, quality, token_counts, toxicity
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest_index.deduplicate(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read_table(spark, sf_dir, "documents"))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(read_table(spark, sf_dir, "documents"), word_bpe_path())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), word_bpe_path())


def merkle_sql() -> str:
    """Trees, roots, likenesses and edits; the patterns without possessive repeats, which change no match."""
    word, gap = merkle._WORD, merkle._GAP
    passage = rf"(?:{word}+{gap}+){{{merkle.PASSAGE_LEAST - 1},{merkle.PASSAGE_WORDS - 1}}}?{word}*[.!?](?:{gap}+|\z)|(?:{word}+(?:{gap}+|\z)){{1,{merkle.PASSAGE_WORDS}}}|{gap}+"
    section = merkle._SECTION.replace("*+", "*")
    return rf"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        pairs AS (
            SELECT doc_id, text, row_number() OVER o AS k, length(text) AS n_chars, coalesce(lead(text) OVER o, first_value(text) OVER o) AS after
            FROM texts WINDOW o AS (ORDER BY doc_id NULLS FIRST, md5(text), text)),
        every AS (
            SELECT k, 0 AS side, text FROM pairs
            UNION ALL SELECT k, 1, left(text, n_chars - n_chars // 2) || left(after, n_chars // 2) FROM pairs
            UNION ALL SELECT k, 2, after FROM pairs),
        trees AS (
            SELECT k, side, sha256(text) AS sha, list_transform(string_split(text, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{passage}'), lambda x: left(md5(x), 8))) AS tree FROM every),
        written AS (
            SELECT k, side, sha, flatten(tree) AS leaves,
                array_to_string(list_transform(list_transform(tree, lambda p: coalesce(array_to_string(p, ','), '')), lambda p: left(md5(p), 16) || ':' || p || '.'), '') AS paragraphs FROM trees),
        cut AS (
            SELECT k, side, sha, leaves, regexp_extract_all(paragraphs, '([0-9a-f]{{16}}):', 1) AS nodes,
                list_transform(regexp_extract_all(paragraphs, '{section}'), lambda s: left(md5(s), 16) || '=' || s) AS sections FROM written),
        printed AS (
            SELECT *, sha256(array_to_string(list_transform(sections, lambda s: left(s, 16)), '|') || '|' || sha) || ';' || array_to_string(sections, '|') AS fingerprint FROM cut),
        counted AS (SELECT k, side, leaf, count(*) AS n FROM (SELECT k, side, unnest(leaves) AS leaf FROM printed) GROUP BY ALL),
        sizes AS (SELECT k, side, len(leaves) AS n FROM printed),
        common AS (SELECT a.k, b.side, sum(least(a.n, b.n)) AS n FROM counted a JOIN counted b ON a.k = b.k AND a.leaf = b.leaf AND a.side = 0 AND b.side > 0 GROUP BY ALL),
        near AS (
            SELECT a.k, b.side, CASE WHEN a.n + b.n = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(c.n, 0)::DOUBLE / (a.n + b.n)::DOUBLE END AS likeness
            FROM sizes a JOIN sizes b ON a.k = b.k AND a.side = 0 AND b.side > 0 LEFT JOIN common c ON c.k = a.k AND c.side = b.side),
        opened AS (
            SELECT a.k, a.side, regexp_extract_all(array_to_string(list_filter(a.sections, lambda s: NOT list_contains(b.sections, s)), '|'), '([0-9a-f]{{16}}):', 1) AS nodes
            FROM printed a JOIN printed b ON a.k = b.k AND a.side < 2 AND b.side = 1 - a.side),
        edits AS (SELECT a.k, list_filter(a.nodes, lambda p: NOT list_contains(b.nodes, p)) AS nodes FROM opened a JOIN opened b ON a.k = b.k AND a.side = 0 AND b.side = 1)
        SELECT doc_id, n_chars, e.sha AS edited_sha256, o.fingerprint AS fingerprint, e.fingerprint AS edited_fingerprint, x.likeness AS near_edited, y.likeness AS near_next,
            list_unique(d.nodes)::BIGINT AS edited_paragraphs, coalesce(list_position(o.nodes, d.nodes[1])::BIGINT - 1, -1) AS first_edited
        FROM pairs p JOIN printed o ON o.k = p.k AND o.side = 0 JOIN printed e ON e.k = p.k AND e.side = 1
        JOIN near x ON x.k = p.k AND x.side = 1 JOIN near y ON y.k = p.k AND y.side = 2 JOIN edits d ON d.k = p.k
    """


def packing_sql(n_buckets: int = packing.N_BUCKETS, budget: int = packing.TOKEN_BUDGET) -> str:
    """The dynamic programming as one table for each number of buckets."""
    layers = ["l1 AS (SELECT i, total * len AS spent, [len] AS bounds FROM cumulated)"]
    for k in range(2, n_buckets + 1):
        layers.append(f"""l{k} AS (
            SELECT h.i, coalesce(p.spent, 0) + (h.total - coalesce(b.total, 0)) * h.len AS spent, list_append(coalesce(p.bounds, []), h.len) AS bounds
            FROM cumulated h JOIN (SELECT 0 AS i UNION ALL SELECT i FROM cumulated) c ON c.i < h.i
            LEFT JOIN l{k - 1} p ON p.i = c.i LEFT JOIN cumulated b ON b.i = c.i
            QUALIFY row_number() OVER (PARTITION BY h.i ORDER BY coalesce(p.spent, 0) + (h.total - coalesce(b.total, 0)) * h.len, c.i) = 1)""")
    return rf"""
        WITH lengths AS (SELECT doc_id, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_words FROM documents),
        counted AS (SELECT n_words AS len, count(*) AS n FROM lengths GROUP BY n_words),
        cumulated AS (SELECT len, sum(n) OVER (ORDER BY len)::BIGINT AS total, row_number() OVER (ORDER BY len) AS i FROM counted),
        {", ".join(layers)},
        placed AS (SELECT doc_id, n_words, (SELECT min(bound) FROM (SELECT unnest(bounds) AS bound FROM (SELECT bounds FROM l{n_buckets} ORDER BY i DESC LIMIT 1)) WHERE bound >= n_words) AS bucket_bound FROM lengths),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket_bound ORDER BY md5(doc_id::VARCHAR), doc_id, n_words) - 1 AS position, greatest(1, {budget} // bucket_bound) AS room FROM placed)
        SELECT doc_id, n_words, bucket_bound, position // room AS batch_id, position % room AS slot, bucket_bound - n_words AS padding FROM numbered
    """


QUERIES: dict[str, Query] = {
    "op1_class_lm": op1_class_lm,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_merkle_fingerprints": op4_merkle_fingerprints,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH keyed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM keyed WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op4_merkle_fingerprints": merkle_sql(),
    "op5_packing": packing_sql(),
    "op3_ngram_join": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM worded),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
        FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
    """,
}
