"""Queries over colours and symbol series made of lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.scalar import bucket, equation, from_residues, from_ycocg, gene, nearest_prime, residues, rotate, signed_varint_bytes, to_ycocg, unbucket, unrotate, unzigzag, zigzag
from sigloom.operators.entropy import entropy
from sigloom.sources.signals import LINE_ORDER, colours


def _rgb() -> tuple:
    return F.col("r"), F.col("g"), F.col("b")


def ycocg_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = dict(zip(("y", "co", "cg"), to_ycocg(*_rgb()), strict=True))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), c.alias("v")) for k, c in parts.items())))
    return colours(spark, sf_dir).select(each.alias("c")).groupBy("c.channel").agg(F.sum("c.v").alias("total"), F.min("c.v").alias("low"), F.max("c.v").alias("high"))


def ycocg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = from_ycocg(*to_ycocg(*_rgb()))
    off = (r != F.col("r")) | (g != F.col("g")) | (b != F.col("b"))
    return colours(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(off.cast("int")).alias("mismatches"))


def lift_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of colours turned by 0.7, and how many don't turn back."""
    a, b = rotate(F.col("r"), F.col("g"), 0.7)
    turned = colours(spark, sf_dir).select("r", "g", a.alias("a"), b.alias("b2"))
    back = unrotate(F.col("a"), F.col("b2"), 0.7)
    return turned.agg(F.sum("a").alias("sum_a"), F.sum("b2").alias("sum_b"), F.sum(((back[0] != F.col("r")) | (back[1] != F.col("g"))).cast("int")).alias("mismatches"))


def colour_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(x, y) for i, x in enumerate("rgb") for y in "rgb"[i:]]
    return colours(spark, sf_dir).agg(*(F.round(F.covar_pop(x, y), 4).alias(f"{x}{y}") for x, y in pairs))


def _residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of quantities within orders, from 128."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return colours(spark, sf_dir).select("l_orderkey", (F.col("r") - F.lag("r", 1, 128).over(w)).alias("d"))


def delta_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy(_residual(spark, sf_dir).select(zigzag(F.col("d")).alias("sym"))).select("bps")


def zigzag_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual(spark, sf_dir).groupBy(zigzag(F.col("d")).alias("zz")).agg(F.count("*").alias("cnt"))


def zigzag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residual(spark, sf_dir).agg(F.count("*").alias("n"), F.sum((unzigzag(zigzag(F.col("d"))) != F.col("d")).cast("int")).alias("mismatches"))


def bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _residual(spark, sf_dir).select(zigzag(F.col("d")).cast("long").alias("z"))
    k, bits, extra = bucket(F.col("z"))
    back = (unbucket(k, extra) != F.col("z")).cast("int")
    return z.select(k.alias("bucket"), bits.alias("bits"), extra.alias("extra"), back.alias("off")).groupBy("bucket").agg(F.count("*").alias("cnt"), F.sum("bits").alias("extra_bits"), F.sum("extra").alias("extra_sum"), F.sum("off").alias("mismatches"))


def varint_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round((F.col("l_extendedprice") - 30000) * 100).cast("long")
    return colours(spark, sf_dir).groupBy(signed_varint_bytes(price).alias("bytes")).agg(F.count("*").alias("cnt"))


def prime_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("r") * 5 + F.col("g") % 6
    return colours(spark, sf_dir).select(v.alias("v")).groupBy((F.col("v") - nearest_prime(F.col("v"))).alias("symbol")).agg(F.count("*").alias("cnt"))


def crt_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rs = residues(F.col("r"))
    return colours(spark, sf_dir).groupBy(rs[2].alias("symbol")).agg(F.count("*").alias("cnt"), F.sum((from_residues(rs) != F.col("r")).cast("int")).alias("mismatches"))


def equation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, sse) of fixed candidates of the symbolic regression (C25, L24): b against r and g."""
    x, y = F.col("r") / 50.0, F.col("g") / 100.0
    forms = {"linear": [10.0, 20.0, 5.0], "quadratic": [4.0, -3.0, 2.0, 1.0, 8.0, 20.0]}
    return colours(spark, sf_dir).select("b", *(equation(k, x, y, c).alias(k) for k, c in forms.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("form"), ((F.col(k) - F.col("b")) * (F.col(k) - F.col("b"))).alias("e")) for k in forms))).alias("f")).groupBy("f.form").agg(F.round(F.avg("f.e"), 4).alias("mse"))


def gene_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a stack program over the colour plane (C24), as one expression."""
    g = gene([("mul", "x", "y"), ("add", 0, 0.25), ("sqrt", 1), ("clamp", 2), ("blend", 3, "x", 0.5)], F.col("r") / 50.0, F.col("g") / 100.0)
    return colours(spark, sf_dir).agg(F.round(F.avg(g), 6).alias("mean"))


def tier_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, keep, total): quantities at or above a threshold, by flag: the hard shrink of coefficients (P03) on rows."""
    shrunk = F.when(F.abs(F.col("d")) < 8, 0).otherwise(F.col("d"))
    return _residual(spark, sf_dir).agg(F.sum((shrunk != 0).cast("int")).alias("kept"), F.sum(F.abs(shrunk)).alias("total"))


_RGB = "c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(l_quantity as int) as r, cast(round(l_discount * 1000) as int) as g, cast(round(l_tax * 1000) as int) as b from lineitem)"
_YCC = f"with {_RGB}, t as (select *, r - b as co, b + ((r - b) >> 1) as t from c), u as (select *, g - t as cg from t), v as (select *, t + (cg >> 1) as y from u)"
_D = f"with {_RGB}, d as (select r - coalesce(lag(r) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice), 128) as d from c), z as (select d, case when d >= 0 then 2 * d else -2 * d - 1 end as z from d)"
_PRIMES = ", ".join(f"({p})" for p in range(2, 256) if all(p % q for q in range(2, p)))
_ALPHA = "((cos(0.7::double) - 1) / sin(0.7::double))"

SQL = {
    "ycocg_forward": f"{_YCC} select channel, cast(sum(x) as bigint) as total, min(x) + 0 as low, max(x) + 0 as high from (select 'y' as channel, y as x from v union all select 'co', co from v union all select 'cg', cg from v) group by 1",
    "ycocg_roundtrip": f"{_YCC}, w as (select r, g, b, co, cg, y - (cg >> 1) as t2 from v), q as (select r, g, b, co, cg + t2 as g2, t2 - (co >> 1) as b2 from w) select count(*) as n, cast(sum(case when b2 + co <> r or g2 <> g or b2 <> b then 1 else 0 end) as bigint) as mismatches from q",
    "lift_rotation": f"with {_RGB}, s1 as (select r, g, r + cast(floor({_ALPHA} * g) as int) as a1 from c), s2 as (select r, g, a1, g + cast(floor(sin(0.7::double) * a1) as int) as b1 from s1), s3 as (select r, g, a1, b1, a1 + cast(floor({_ALPHA} * b1) as int) as a2 from s2), k as (select *, a2 - cast(floor({_ALPHA} * b1) as int) as x1 from s3), m as (select *, b1 - cast(floor(sin(0.7::double) * x1) as int) as y1 from k) select cast(sum(a2) as bigint) as sum_a, cast(sum(b1) as bigint) as sum_b, cast(sum(case when x1 - cast(floor({_ALPHA} * y1) as int) <> r or y1 <> g then 1 else 0 end) as bigint) as mismatches from m",
    "colour_covariance": f"with {_RGB} select " + ", ".join(f"round(covar_pop({x}::double, {y}::double), 4) as {x}{y}" for i, x in enumerate("rgb") for y in "rgb"[i:]) + " from c",
    "delta_entropy": f"{_D}, k as (select z, count(*) as cnt from z group by 1) select round((sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double))) / sum(cnt), 6) + 0.0 as bps from k",
    "zigzag_hist": f"{_D} select z as zz, count(*) as cnt from z group by 1",
    "zigzag_roundtrip": f"{_D} select count(*) as n, cast(sum(case when (case when z % 2 = 0 then z // 2 else -(z + 1) // 2 end) <> d then 1 else 0 end) as bigint) as mismatches from z",
    "bucket_hist": f"{_D}, k as (select z, case when z = 0 then 0 else length(ltrim(bin(z), '0')) end as k from z) select cast(k as int) as bucket, count(*) as cnt, cast(sum(greatest(k - 1, 0)) as bigint) as extra_bits, cast(sum(case when k = 0 then 0 else z - cast(pow(2, k - 1) as bigint) end) as bigint) as extra_sum, cast(0 as bigint) as mismatches from k group by 1",
    "varint_size": f"with {_RGB}, p as (select cast(round((l_extendedprice - 30000) * 100) as bigint) as v from c), z as (select case when v >= 0 then 2 * v else -2 * v - 1 end as z from p) select cast(case when z < 128 then 1 when z < 16384 then 2 when z < 2097152 then 3 when z < 268435456 then 4 else 5 end as int) as bytes, count(*) as cnt from z group by 1",
    "prime_offsets": f"with {_RGB}, v as (select r * 5 + g % 6 as v, count(*) as n from c group by 1), p(p) as (values {_PRIMES}), n as (select v, any_value(n) as n, arg_min(p, abs(v - p) * 256 + p) as p from v cross join p group by v) select v - p as symbol, cast(sum(n) as bigint) as cnt from n group by 1",
    "crt_residues": f"with {_RGB} select r % 7 as symbol, count(*) as cnt, cast(sum(case when ((r % 3) * 385 * 1 + (r % 5) * 231 * 1 + (r % 7) * 165 * 2 + (r % 11) * 105 * 2) % 1155 <> r then 1 else 0 end) as bigint) as mismatches from c group by 1",
    "equation_errors": f"with {_RGB}, e as (select b, r / 50.0::double as x, g / 100.0::double as y from c) select 'linear' as form, round(avg(pow(10 * x + 20 * y + 5 - b, 2)), 4) as mse from e union all select 'quadratic', round(avg(pow(4 * x * x - 3 * y * y + 2 * x * y + x + 8 * y + 20 - b, 2)), 4) from e",
    "gene_program": f"with {_RGB}, e as (select r / 50.0::double as x, g / 100.0::double as y from c) select round(avg(least(1, greatest(0, sqrt(x * y + 0.25))) * 0.5 + x * 0.5), 6) as mean from e",
    "tier_by_size": f"{_D} select cast(sum(case when abs(d) >= 8 then 1 else 0 end) as bigint) as kept, cast(sum(case when abs(d) >= 8 then abs(d) else 0 end) as bigint) as total from d",
}

QUERIES = [ycocg_forward, ycocg_roundtrip, lift_rotation, colour_covariance, delta_entropy, zigzag_hist, zigzag_roundtrip, bucket_hist, varint_size, prime_offsets, crt_residues, equation_errors, gene_program, tier_by_size]
