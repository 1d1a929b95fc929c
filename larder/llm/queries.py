"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from larder.llm import audit, fingerprint, language, licenses, mixing, near, packing, pages, repeats, repetition, trie, warc, windows
from larder.llm.store import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def web_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


@query("op1_pack")
def _(spark, d):
    return packing.pack_documents(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_licenses")
def _(spark, d):
    return licenses.statements(documents(spark, d))


@query("op3_repeats")
def _(spark, d):
    return repeats.remove_repeats(documents(spark, d)).drop("kept")


@query("op4_language")
def _(spark, d):
    return language.identify(documents(spark, d))


@query("op5_fingerprint")
def _(spark, d):
    return fingerprint.near_edits(documents(spark, d))


@query("op6_main_text")
def _(spark, d):
    return pages.main_text(web_pages(spark, d))


@query("op7_repetition")
def _(spark, d):
    return repetition.quality(documents(spark, d))


@query("op8_warc")
def _(spark, d):
    return warc.archive(web_pages(spark, d), new_path(spark, "warc"))


@query("op9_near_duplicates")
def _(spark, d):
    found = near.near_duplicates(documents(spark, d), size=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


@query("op10_mix")
def _(spark, d):
    return mixing.mix(documents(spark, d))


@query(
    "op11_divergence",
    """
    WITH d AS (
        SELECT row_number() OVER () AS id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
               translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ),
    found AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, COUNT(*) AS total FROM found GROUP BY lang, term HAVING COUNT(DISTINCT id) >= 3),
    langs AS (SELECT lang, COUNT(*) AS v, SUM(total) AS n FROM kept GROUP BY lang),
    own AS (SELECT lang, source, term, COUNT(*) AS c FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    totals AS (SELECT lang, source, SUM(c) AS n FROM own GROUP BY lang, source),
    groups AS (SELECT DISTINCT lang, source FROM d),
    shares AS (
        SELECT g.lang, g.source, k.term, COALESCE(o.c, 0) AS c,
               1 + (1000000000 * (COALESCE(o.c, 0) + 1)::HUGEINT) // (COALESCE(t.n, 0) + l.v)::HUGEINT AS p,
               1 + (1000000000 * (k.total + 1)::HUGEINT) // (l.n + l.v)::HUGEINT AS q
        FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o USING (lang, source, term) LEFT JOIN totals t USING (lang, source)
    ),
    pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
    apart AS (
        SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    measured AS (
        SELECT lang, source, 'pair' AS part, item, COALESCE(value, 0)::BIGINT AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM measured)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
)
def _(spark, d):
    return audit.divergence(documents(spark, d))


@query("op12_pack_windows")
def _(spark, d):
    return windows.pack_windows(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_prefix_tree")
def _(spark, d):
    return trie.shared_prefixes(spark.read.parquet(f"{d}/conversations.parquet"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
