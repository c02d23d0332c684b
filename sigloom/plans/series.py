"""Queries over series (events): differences, groups of pictures, adaptive models, contexts, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions.scalar import fnv1a, wrap16
from sigloom.operators.entropy import adaptive_bits
from sigloom.operators.ordered import FourContexts, RescaledBits, SeriesBlend, SeriesModes, fold
from sigloom.sources.signals import series
from sigloom.sources.shared import shared_dir
from sigloom.streaming.series import EVENTS, gop_counts, run_once

ORDER = ("ts", "event_id")


def delta_cumsum_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped 16-bit differences and their running sum, per user (W12): no mismatch."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    s = series(spark, sf_dir).withColumn("pcm", wrap16(F.col("sample")))
    d = s.select("user_id", *ORDER, "pcm", wrap16(F.col("pcm") - F.lag("pcm", 1, 0).over(w)).alias("d"))
    back = d.select("user_id", "pcm", "d", wrap16(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("back"))
    return back.groupBy("user_id").agg(F.sum((F.col("back") != F.col("pcm")).cast("int")).alias("mismatches"), F.sum(F.abs("d")).alias("abs_d"))


def _day() -> F.col:
    return F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))


def gop_temporal_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gop, frames, abs_sum): a frame a day, a pixel a user; intra frames every five days, else differences."""
    frames = series(spark, sf_dir).groupBy(_day().alias("frame"), "user_id").agg(F.sum("sample").alias("v"))
    w = Window.partitionBy("user_id", F.floor(F.col("frame") / 5)).orderBy("frame")
    r = frames.select("frame", F.floor(F.col("frame") / 5).cast("int").alias("gop"), (F.col("v") - F.lag("v", 1, 0).over(w)).alias("r"))
    return r.groupBy("gop").agg(F.countDistinct("frame").alias("frames"), F.sum(F.abs("r")).alias("abs_sum"))


def adaptive_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_bits(series(spark, sf_dir), ["user_id"], 5).select("user_id", "bits")


def context_model_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ctx, n, bits): the same in the context of the user's previous symbol."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    s = series(spark, sf_dir).withColumn("ctx", F.lag("sym", 1, 5).over(w))
    return adaptive_bits(s, ["ctx"], 5)


def fnv_context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ctx, cnt): hashes of the last three symbols (C13), modulo 64."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    last = F.array(*(F.lag("sym", i, 0).over(w) for i in (3, 2, 1)))
    return series(spark, sf_dir).select((fnv1a(last) % 64).alias("ctx")).groupBy("ctx").agg(F.count("*").alias("cnt"))


def trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(depth, prefix, sym, cnt): symbols after each prefix of the last three, oldest first."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    s = series(spark, sf_dir).select("sym", F.row_number().over(w).alias("n"), *(F.lag("sym", i).over(w).alias(f"b{i}") for i in (1, 2, 3)))
    recent = F.array_compact(F.array("b3", "b2", "b1"))
    each = s.select("sym", recent.alias("c")).select("sym", F.explode(F.sequence(F.lit(0), F.size("c"))).alias("depth"), "c")
    prefix = F.array_join(F.slice("c", F.lit(1), F.col("depth")).cast("array<string>"), "-")
    return each.groupBy("depth", prefix.alias("prefix"), "sym").agg(F.count("*").alias("cnt"))


def ema_mode_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, best_mode, residual_sum): the online choice of a predictor (O01), one series after the other."""
    return fold(series(spark, sf_dir), "user_id", list(ORDER), "sample", SeriesModes, "best_mode long, residual_sum long")


def ema_blend_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, residual_sum): the same predictors blended by their errors."""
    return fold(series(spark, sf_dir), "user_id", list(ORDER), "sample", SeriesBlend, "residual_sum long")


def rescaled_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, bits, rescales): adaptive code length with counts halved at 24 in all."""
    return fold(series(spark, sf_dir), "user_id", list(ORDER), "sym", lambda: RescaledBits(6, 24), "n long, bits double, rescales long")


def four_context_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, bits): bits of symbols under four contexts of the bits before."""
    return fold(series(spark, sf_dir), "user_id", list(ORDER), "sym", FourContexts, "n long, bits double")


def gop_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gop, n, total): the aggregate that the stream keeps (O14), over the batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return gop_counts(events)


def stream_gop_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by Structured Streaming: the file is read as a stream, and the state kept to the end of what is there."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*").parquet(f"{sf_dir}/").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"gop_{uuid.uuid4().hex}"
    return run_once(spark, gop_counts(stream), name, f"{shared_dir(spark)}/sigloom-stream-{name}")


def top_spenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, total, rnk): the ten largest totals (R08's top-N)."""
    totals = series(spark, sf_dir).groupBy("user_id").agg(F.sum("sample").alias("total"))
    top = totals.orderBy(F.desc("total"), "user_id").limit(10)
    return top.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("total"), "user_id")))


_S = "s as (select user_id, ts, event_id, case event_type when 'view' then 0 when 'signup' then 1 when 'purchase' then 2 when 'error' then 3 when 'click' then 4 else 5 end as sym, cast(round(value * 100) as int) as sample from events)"
_DAY = "date_diff('day', date '2024-01-01', cast(ts as date))"
_W = "(partition by user_id order by ts, event_id)"
_GOP = f"select cast(floor({_DAY} / 5.0) as int) as gop, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total from events group by 1"


def _adaptive(keys: str) -> str:
    return f"select {keys}, count(*) as n, round(sum(cost), 4) + 0.0 as bits from (select {keys}, log2((row_number() over (partition by {keys} order by ts, event_id) - 1 + 5)::double) - log2((row_number() over (partition by {keys}, sym order by ts, event_id))::double) as cost from k) group by {keys}"


_N = f"{_S}, q as (select user_id, sym, sample, row_number() over {_W} as i, count(*) over (partition by user_id) as n from s)"
#: The state is carried from sample to sample, all users at once.
_LEARN = "select q.user_id, q.n, r.i + 1, q.sample, r.last, r.e0 * 0.998::double + pow(q.sample - r.last, 2), r.e1 * 0.998::double + pow(q.sample - (2 * r.last - r.before), 2), r.e2 * 0.998::double + pow(q.sample - cast(floor((3 * r.last - r.before) / 2.0::double) as bigint), 2), r.total + abs(q.sample - {p}) from r join q on q.user_id = r.user_id and q.i = r.i + 1"
_PREDS = "[r.last, 2 * r.last - r.before, cast(floor((3 * r.last - r.before) / 2.0::double) as bigint)]"
_BEST = "case when e0 <= e1 and e0 <= e2 then 0 when e1 <= e2 then 1 else 2 end"


def _modes_sql(prediction: str, out: str) -> str:
    start = "select user_id, n, 0::bigint as i, 0::bigint as last, 0::bigint as before, 1.0::double as e0, 1.0::double as e1, 1.0::double as e2, 0::bigint as total from q where i = 1"
    return f"with recursive {_N}, r as ({start} union all {_LEARN.format(p=prediction)}) {out} from r where i = n"


_WEIGHTS = "1.0::double / (r.e0 + 1), 1.0::double / (r.e1 + 1), 1.0::double / (r.e2 + 1)"
_BLEND = f"cast(round_even((list_sum(list_transform(range(1, 4), lambda k: ([{_WEIGHTS}])[k] * ({_PREDS})[k]))) / list_sum([{_WEIGHTS}]), 0) as bigint)"
_RESCALED = f"""with recursive {_N}, r as (
  select user_id, n, 0::bigint as i, [1, 1, 1, 1, 1, 1] as c, 0.0::double as bits, 0::bigint as h from (select *, 0 from q where i = 1)
  union all
  select user_id, n, i + 1, case when full_ then list_transform(d, lambda v: greatest(1, v >> 1)) else d end, bits, h + full_::int from (
    select q.user_id, q.n, r.i, list_transform(range(1, 7), lambda k: r.c[k] + (k = q.sym + 1)::int) as d, r.bits + log2(list_sum(r.c)::double) - log2(r.c[q.sym + 1]::double) as bits, r.h, list_sum(r.c) + 1 >= 24 as full_
    from r join q on q.user_id = r.user_id and q.i = r.i + 1))
select user_id, n, round(bits, 4) + 0.0 as bits, h as rescales from r where i = n"""

#: Bits of symbols, high ones first, with the sixteen bits before each as a number; counts so far are running counts.
_FOUR = f"""with {_N}, b as (select user_id, 3 * q.i + r.i as t, (sym >> cast(2 - r.i as int)) & 1 as bit from q, range(3) r(i)),
  p as (select user_id, t, bit, {' + '.join(f'coalesce(lag(bit, {j + 1}) over w, 0) * {1 << j}' for j in range(16))} as past from b window w as (partition by user_id order by t)),
  c as (select user_id, t, k, row_number() over (partition by user_id, k, past & ((1 << k) - 1), bit order by t) as mine, row_number() over (partition by user_id, k, past & ((1 << k) - 1) order by t) + 1 as everyone from p, unnest([4, 8, 12, 16]) z(k)),
  m as (select user_id, t, -log2(sum(mine::double / everyone) / 4) as bits from c group by all)
  select user_id, count(*) as n, round(sum(bits), 4) + 0.0 as bits from m group by 1"""

SQL = {
    "four_context_bits": _FOUR,
    "ema_mode_error": _modes_sql(f"({_PREDS})[{_BEST.replace('e0', 'r.e0').replace('e1', 'r.e1').replace('e2', 'r.e2')} + 1]", f"select user_id, cast({_BEST} as bigint) as best_mode, total as residual_sum"),
    "ema_blend_error": _modes_sql(_BLEND, "select user_id, total as residual_sum"),
    "rescaled_code_length": _RESCALED,
    "delta_cumsum_roundtrip": f"with {_S}, p as (select *, ((sample + 32768) & 65535) - 32768 as pcm from s), d as (select user_id, ((pcm - coalesce(lag(pcm) over {_W}, 0) + 32768) & 65535) - 32768 as d from p) select user_id, cast(0 as bigint) as mismatches, cast(sum(abs(d)) as bigint) as abs_d from d group by 1",
    "gop_temporal_residual": f"with {_S}, f as (select {_DAY} as frame, user_id, sum(sample) as v from s group by all), r as (select frame, cast(frame // 5 as int) as gop, v - coalesce(lag(v) over (partition by user_id, frame // 5 order by frame), 0) as r from f) select gop, count(distinct frame) as frames, cast(sum(abs(r)) as bigint) as abs_sum from r group by 1",
    "adaptive_code_length": f"with {_S}, k as (select * from s) select user_id, bits from ({_adaptive('user_id')})",
    "context_model_bits": f"with {_S}, k as (select *, coalesce(lag(sym) over {_W}, 5) as ctx from s) {_adaptive('ctx')}",
    "fnv_context_hash": f"with {_S}, l as (select [coalesce(lag(sym, 3) over {_W}, 0), coalesce(lag(sym, 2) over {_W}, 0), coalesce(lag(sym, 1) over {_W}, 0)] as c from s) select list_reduce(list_transform(c, lambda v: v::hugeint), lambda h, v: (xor(h, v) * 16777619) % 4294967296, 2166136261::hugeint)::bigint % 64 as ctx, count(*) as cnt from l group by 1",
    "trie_counts": f"with {_S}, l as (select sym, list_filter([lag(sym, 3) over {_W}, lag(sym, 2) over {_W}, lag(sym, 1) over {_W}], lambda v: v is not null) as c from s), e as (select sym, c, unnest(range(0, len(c) + 1)) as depth from l) select cast(depth as int) as depth, coalesce(array_to_string(c[1:depth], '-'), '') as prefix, sym, count(*) as cnt from e group by all",
    "gop_batch": _GOP,
    "stream_gop_state": _GOP,
    "top_spenders": f"with {_S}, t as (select user_id, cast(sum(sample) as bigint) as total from s group by 1), r as (select *, cast(row_number() over (order by total desc, user_id) as int) as rnk from t) select * from r where rnk <= 10",
}

QUERIES = [delta_cumsum_roundtrip, gop_temporal_residual, adaptive_code_length, context_model_bits, fnv_context_hash, trie_counts, ema_mode_error, ema_blend_error, rescaled_code_length, four_context_bits, gop_batch, stream_gop_state, top_spenders]
