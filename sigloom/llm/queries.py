"""Queries of the training-data operators over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.ann import nearest
from sigloom.llm.decontaminate import find_leaks
from sigloom.llm.html_text import extract_text
from sigloom.llm.license_scan import scan_licenses
from sigloom.llm.lm import score_documents
from sigloom.llm.mixing import mix_sources
from sigloom.llm.ngram_join import ngram_groups
from sigloom.llm.quality import score_quality
from sigloom.llm.secret_scan import scan_secrets
from sigloom.llm.url_rules import RULES, filter_urls, rules_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(_table(spark, sf_dir, "documents"), words=4, num=85, den=100).drop("class_id")


def op5_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op7_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rules_table(spark))


def op10_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_nearest, op3_extract_text, op4_ngram_groups, op5_scan_secrets, op6_score_documents, op7_scan_licenses, op8_find_leaks, op9_filter_urls, op10_score_quality)}


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

#: All links between documents by shingles of four words, and the groups they make.
_OP4 = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from words),
flat as (select doc_id, unnest(s) as g from shingles),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as both from flat x join flat y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from pairs join shingles x on x.doc_id = a join shingles y on y.doc_id = b where 100 * "both" >= 85 * (len(x.s) + len(y.s) - "both")),
arcs as (select a, b from links union select b, a from links),
reach as (select a as doc_id, b as other from arcs union select r.doc_id, a.b from reach r join arcs a on r.other = a.a),
least as (select doc_id, min(other) as m from reach group by 1)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(least(s.doc_id, m), s.doc_id) as component_id
from shingles s left join least using (doc_id)
"""

_OP9 = f"""
with rules(h, r, v) as (values {_RULES}),
rest as (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as t from pages),
split as (select page_id, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) as path from rest),
fits as (
  select page_id, host, path, h || r as rule, v, row_number() over (partition by page_id order by length(h || r) desc nulls last, length(h) desc, v) as k
  from split left join rules on (host = h or right(host, length(h) + 1) = '.' || h) and left(path, length(r)) = r)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fits where k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_groups": _OP4, "op9_filter_urls": _OP9}
