"""Physical plans: exchanges, pruned columns, pushed filters, and no Cartesian products."""

import re

import pytest

from sigloom.plans import registry

SF = "/root/testdata/sf0.001"
#: Exchanges that a query needs at most.
EXCHANGES = {"block_mode_grid": 1, "block_mode_select": 2, "block_mode_kernel": 0, "smooth_block_fit": 1, "smooth_filter": 0, "arith_roundtrip": 0, "ycocg_roundtrip": 1, "symbol_frequency": 1, "exact_dup_groups": 2, "patch_extract": 1, "delta_cumsum_roundtrip": 2, "vq_assign": 2, "kmeans_steps": 2, "context_model_bits": 3, "byte_entropy": 2, "ema_mode_error": 1, "random_projection": 0, "method_battery": 4}
COLUMNS = {
    "block_mode_grid": {"vec_id", "embedding"}, "region_mask": {"vec_id", "embedding", "label"}, "exact_dup_groups": {"text"}, "giant_integers": {"text", "source"}, "symbol_frequency": {"text"},
    "ycocg_forward": {"l_quantity", "l_discount", "l_tax"}, "container_headers": {"l_partkey", "l_quantity", "l_linenumber"}, "top_spenders": {"user_id", "value"},
}


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(EXCHANGES))
def test_exchanges(spark, name):
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan(spark, name))) <= EXCHANGES[name]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_read(spark, name):
    read = {c for s in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$|\s)", plan(spark, name)) for c in re.findall(r"(\w+):", s)}
    assert read - {"element"} == COLUMNS[name]


def test_no_cartesian_products(spark):
    built = ("knn_exact", "bloom_probe_words", "lossless_antijoin", "top_patches", "trie_counts", "tier_winners", "cross_channel", "dct_energy")
    assert not any("CartesianProduct" in plan(spark, n) for n in built)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 10").select("vec_id")
    assert "PushedFilters: [IsNotNull(vec_id), LessThan(vec_id,10)]" in df._jdf.queryExecution().executedPlan().toString()
