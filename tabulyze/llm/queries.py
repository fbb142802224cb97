"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulyze.llm import (
    class_model, conversation_trie, decontamination, html_text, ngram_join, packing, pii, quality,
    ranked_search, repair, simhash, url_rules, warc,
)
from tabulyze.llm.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return run(spark, sf_dir)

        QUERIES[name] = shipped
        if sql:
            ORACLES[name] = sql
        return shipped

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_definition(name: str = TOKENIZER) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op9_simhash_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_definition())


@query("op5_warc", """
with p as (
  select page_id, coalesce(html, '') as h, sha256(coalesce(html, '')) as d,
         octet_length(encode(coalesce(html, ''))) as n
  from pages
), g as (
  select d, min(page_id) as first_id, count(*) as copies from p where n >= 100 group by d
)
select p.page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
       case when copies > 1 and page_id is distinct from first_id and first_id is not null
            then 'revisit' else 'response' end as record_type,
       case when copies > 1 and page_id is distinct from first_id then first_id end as refers_to
from p left join g on p.d = g.d
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op6_token_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_shards(table(spark, sf_dir, "documents"), tokenizer_definition())


@query("op2_url_rules", r"""
with p as (
  select page_id, coalesce(url, '') as u,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
), r as (
  select *, case
      when ends_with('.' || host, '.www.example.com') and starts_with(path, '/en/')
        then 'www.example.com/en/'
      when ends_with('.' || host, '.example.com') and starts_with(path, '/en/')
        then 'example.com/en/'
      when ends_with('.' || host, '.net') and starts_with(path, '/es/') then 'net/es/'
      when ends_with('.' || host, '.net') and starts_with(path, '/fr/') then 'net/fr/'
      when ends_with('.' || host, '.com') and starts_with(path, '/') then 'com/' end as rule,
    translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from p
), m as (
  select *, case
      when regexp_matches(low, '(^|[^a-z0-9])responsible-gaming([^a-z0-9]|$)')
        then 'responsible-gaming'
      when regexp_matches(low, '/ads/(?s:.*)\.html([^a-z0-9]|$)') then '/ads/*.html'
      when regexp_matches(low, '(^|[^a-z0-9])casino-win([^a-z0-9]|$)') then 'casino-win'
      when regexp_matches(low, '(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)') then 'cheap-pills'
      when regexp_matches(low, '(^|[^a-z0-9])free-bets([^a-z0-9]|$)') then 'free-bets'
      when regexp_matches(low, '(^|[^a-z0-9])sessionid=') then 'sessionid='
      when regexp_matches(low, '(^|[^a-z0-9])utm_source=spam([^a-z0-9]|$)')
        then 'utm_source=spam' end as pattern
  from r
)
select page_id, host, path, rule, pattern,
       case when rule in ('com/', 'www.example.com/en/') then 'allow'
            when rule is not null then 'block'
            when pattern is null or pattern = 'responsible-gaming' then 'allow'
            else 'block' end as verdict
from m
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query("op4_class_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.scored(table(spark, sf_dir, "documents"))


@query("op11_conversation_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op12_ngram_jaccard_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query("op13_ranked_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
