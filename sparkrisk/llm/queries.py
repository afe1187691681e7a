"""Registered queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, chat, decontam, lexical_search, licenses, ngram_join, periodic_runs, quality_classifier,
               quality_rules, simhash, toxicity, url_filter, warc)
from .common import let_workers_import

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Production parameters: the vocabulary of operator 3 (a path, never copied).
RANKS = "byte_bpe_50k.tiktoken"


def register(fn: Query) -> Query:
    @wraps(fn)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = query
    return query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE: every text encoded, then decoded from its ids."""
    return bpe.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                             public_tokenizers.PATTERN)


@register
def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the target multinomial is that of documents labelled good."""
    docs = read(spark, sf_dir, "documents")
    ratios = quality_rules.fit_ratios(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    return quality_rules.verdicts(docs, ratios)


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.scores(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


#: Fixed values of the contract: the conversation that holds control strings.
EXTRA_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@register
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and its digests read back from the output."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.render_turns(rows.unionByName(extra)))


#: Turns hashed and counted from the table itself. A turn's frame: assistant "<|im_start|>" + role + "\n" + text
#: + "</s>\n" (18 characters and the role), others "[INST] " + role + "\n" + text + " [/INST]\n" (17), plus
#: "<s>" before the first; a control string inside a text costs one character more.
ORACLE_SQL["op4_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]|<\\*<SYS>>|<\\*</SYS>>|<\\*\|im_start\|>|<\\*\|im_end\|>')) AS n_marks
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN 18 ELSE 17 END + length(coalesce(role, '')) + length(text) + n_marks) + 3 AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@register
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in seekable bundles, read back from the bundles."""
    return warc.read_records(warc.archive(read(spark, sf_dir, "pages")))


ORACLE_SQL["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""


@register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return url_filter.judge(read(spark, sf_dir, "pages"))


@register
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    return licenses.found_licenses(read(spark, sf_dir, "documents"))


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and its words without the repeats."""
    return periodic_runs.run_digests(read(spark, sf_dir, "documents"))


@register
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
norms AS (SELECT doc_id, 10 + (90 * n * docs) // l AS m FROM sizes, total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id
), best AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10
"""


@register
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document, by Jaccard similarity."""
    return ngram_join.similar_documents(read(spark, sf_dir, "documents"))
