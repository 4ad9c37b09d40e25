"""The registered queries: each operator on its whole table, with its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.alignment import align
from grainmill.llm.audit import audit_filters
from grainmill.llm.common import is_held_out, read
from grainmill.llm.decontaminate import benchmark_overlaps
from grainmill.llm.extraction import extract_text, fit_labeller
from grainmill.llm.jaccard import jaccard_components
from grainmill.llm.licenses import scan_licenses
from grainmill.llm.packing import pack
from grainmill.llm.quality import fit_quality
from grainmill.llm.secrets import fit_secrets, joined, number_of, scan_secrets
from grainmill.llm.topk import top_k
from grainmill.llm.toxicity import fit_toxicity
from grainmill.llm.urls import filter_urls
from grainmill.llm.warc import read_archives, with_types, write_archives
from grainmill.session import new_folder, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return model.apply(docs.select("doc_id", "text")).select(
        "doc_id", is_held_out().alias("held_out"), "score", "predicted"
    )


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    packed = pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the Jaccard join."""
    found = jaccard_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, with the items and passages they share."""
    return benchmark_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets of every document."""
    docs = read(spark, sf_dir, "documents")
    found = scan_secrets(docs, fit_secrets(docs))
    kinds = [number_of("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *kinds, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    found = scan_licenses(read(spark, sf_dir, "documents"))
    words, labels = F.transform("base", lambda b: b["word"]), F.transform("base", lambda b: b["label"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    return filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op3_urls"] = r"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), judged AS (
    SELECT page_id, host, path,
           CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every 20th vector."""
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op7_topk"] = """
WITH scaled AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back."""
    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    files = settle(write_archives(with_types(pages), new_folder(spark, "warc")))
    found = read_archives(files, payloads=False)
    return found.select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)
    )


ORACLES["op5_warc"] = """
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM firsts
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return model.apply(docs).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


AUDITED = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_points",
    "D": "n_symbols > 0",
    "E": "copy",
}


@query
def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do in each of their orders, for each language."""
    conditions = {letter: F.expr(condition) for letter, condition in AUDITED.items()}
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), conditions)


ORACLES["op13_audit"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), measured AS (
    SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, length(t) AS points,
           length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, regexp_matches(t, '[#$%&*|]') AS symbols,
           min(doc_id) OVER (PARTITION BY t) AS first
    FROM texts
), masked AS (
    SELECT doc_id, part,
           (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
           + 4 * (100 * capitals > 3 * points)::INTEGER + 8 * symbols::INTEGER + 16 * (doc_id > first)::INTEGER AS mask
    FROM measured
), marks AS (
    SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), summed AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(toxic), 0) AS n_toxic
    FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters(letter, bit) AS (
    VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
    SELECT filter_order, step::INTEGER AS step, bits[step] AS bit,
           coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
    FROM orders, range(1, 6) numbers(step)
), found AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM summed, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public vocabularies align in every document."""
    found = align(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages)).select("page_id", "url", "text", "n_chars")
