"""Queries over symbols and blobs (documents, benchmark): entropies, codes, races, containers, membership; and reports on their sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import containers, report
from sigloom.operators.codecs import CODERS, EXTRA_CODERS, code_lengths
from sigloom.operators.entropy import character_counts, entropy_from, total_bits_from
from sigloom.operators.quantise import bloom_build, bloom_probe, bloom_size, bloom_words
from sigloom.sources.signals import table

#: The baseline of the comparisons, in bytes.
BASELINE = 1024
#: The share of strangers that a filter lets pass.
BLOOM_RATE = 0.01


def symbol_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return character_counts(table(spark, sf_dir, "documents"))


def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, bps) of code points."""
    return entropy_from(character_counts(table(spark, sf_dir, "documents"), "lang"), ["lang"]).select("lang", "bps")


def entropy_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n, bits): what an order-0 code must spend on each source."""
    return total_bits_from(character_counts(table(spark, sf_dir, "documents"), "source"), ["source"], digits=1)


def huffman_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, sym, cnt, len): code lengths (E01). Counting is distributed; a tree is built per language over its alphabet."""

    def lengths(rows):
        by = code_lengths(dict(zip(rows["sym"], rows["cnt"], strict=True)))
        return rows.assign(len=[by[s] for s in rows["sym"]])

    return character_counts(table(spark, sf_dir, "documents"), "lang").groupBy("lang").applyInPandas(lengths, "lang string, sym string, cnt long, len long")


def huffman_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_lengths(spark, sf_dir).groupBy("lang").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("len")).alias("bits"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, algo, rank, size, raw): sizes under each general coder."""
    coders = {**{k: e for k, (e, _) in CODERS.items()}, **{k: e for k, (e, _) in EXTRA_CODERS.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, r, len(e(b)), len(b)) for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r, (k, e) in enumerate(coders.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "algo", "rank", "size", "raw"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    return docs.mapInArrow(run, "doc_id long, algo string, rank int, size long, raw long")


def codec_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(algo, docs, bytes): how often each coder wins and what the winners take."""
    best = _sizes(spark, sf_dir).groupBy("doc_id").agg(F.min_by(F.struct("algo", "size"), F.struct("size", "rank")).alias("w"))
    return best.groupBy("w.algo").agg(F.count("*").alias("docs"), F.sum("w.size").alias("bytes"))


def byte_coder_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(coder, docs, exact): texts that each general coder gives back (E10); containers are unpacked in container_budget."""
    pairs = {**CODERS, **EXTRA_CODERS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = [(k, len(texts), sum(d(e(b)) == b for b in texts)) for k, (e, d) in pairs.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], ["coder", "docs", "exact"])

    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    return docs.mapInArrow(run, "coder string, docs long, exact long").groupBy("coder").agg(F.sum("docs").alias("docs"), F.sum("exact").alias("exact"))


def container_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fits, docs): texts whose smallest container meets the budget (F03, P01), each unpacked again to check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for b in batch.column(0).to_pylist():
                try:
                    if containers.unpack_small(containers.pack_small(b)) != b:
                        raise AssertionError("a container doesn't give back its payload")
                    fits.append(True)
                except containers.TooLarge:
                    fits.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(fits, pa.bool_())], ["fits"])

    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b"))
    return docs.mapInArrow(run, "fits boolean").groupBy("fits").agg(F.count("*").alias("docs"))


def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, n): texts told apart by their first bytes (P08), behind the magic of their doc_id's kind."""
    magic = [*containers.MAGIC, b"Text"]
    head = F.element_at(F.array(*(F.lit(m.decode()) for m in magic)), (F.pmod("doc_id", F.lit(len(magic))) + 1).cast("int"))
    blob = F.concat(head, F.substring("text", 1, 8)).cast("binary")
    first = F.hex(F.substring(F.col("blob"), 1, 4))
    kind = F.lit("standard")
    for m, k in containers.MAGIC.items():
        kind = F.when(first == m.hex().upper(), k).otherwise(kind)
    return table(spark, sf_dir, "documents").select(blob.alias("blob")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dup_count, groups): texts of equal hash."""
    same = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text"), 256).alias("h")).agg(F.count("*").alias("dup_count"))
    return same.groupBy("dup_count").agg(F.count("*").alias("groups"))


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''")


def _benchmark_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The distinct words of all benchmark texts, and the size of a filter for them."""
    words = _words(table(spark, sf_dir, "benchmark")).distinct()
    return words, *bloom_size(max(1, words.count()), BLOOM_RATE)


def bloom_build_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bits, set_bits): the size of a filter of all the benchmark's words, and the places that they set."""
    words, m, k = _benchmark_words(spark, sf_dir)
    return bloom_build(words, "word", m, k).agg(F.count("*").alias("set_bits")).select(F.lit(m).cast("long").alias("bits"), "set_bits")


def bloom_probe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hits, false_pos, missed) of the documents' distinct words in that filter; no word of the filter is missed."""
    known, m, k = _benchmark_words(spark, sf_dir)
    words = _words(table(spark, sf_dir, "documents")).distinct()
    probed = bloom_probe(words, "word", bloom_words(bloom_build(known, "word", m, k), m), m, k)
    real = known.withColumn("real", F.lit(1))
    return probed.join(real, "word", "left").agg(F.sum(F.col("maybe").cast("int")).alias("hits"), F.sum((F.col("maybe") & F.col("real").isNull()).cast("int")).alias("false_pos"), F.sum((~F.col("maybe") & F.col("real").isNotNull()).cast("int")).alias("missed"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in the reports' form, from sizes that SQL can state too: a document's characters, bytes and words by source."""
    docs = table(spark, sf_dir, "documents")
    kinds = F.explode(
        F.array(
            F.struct(F.lit(1).alias("tier"), F.lit("utf8").alias("method"), F.octet_length("text").cast("long").alias("size")),
            F.struct(F.lit(2).alias("tier"), F.lit("points").alias("method"), F.length("text").cast("long").alias("size")),
            F.struct(F.lit(3).alias("tier"), F.lit("spaces").alias("method"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("size")),
        )
    )
    each = docs.select("source", F.octet_length("text").cast("long").alias("original"), kinds.alias("m"))
    sums = each.groupBy("source", "m.tier", "m.method").agg(F.sum("original").alias("original_size"), F.sum("m.size").alias("compressed_size"), F.round(F.avg(F.col("m.size") / F.col("original")), 6).alias("ssim"))
    return sums.select(F.concat_ws("-", "source", "method").alias("name"), "tier", "original_size", "compressed_size", "ssim", F.lit(None).cast("double").alias("psnr"), F.lit(None).cast("string").alias("quality_param"))


def tier_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.winners(_results(spark, sf_dir))


def best_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.within_budget(_results(spark, sf_dir), 40_000).where("rnk = 1").select("tier", "name", "compressed_size", "ssim")


def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rollup(_results(spark, sf_dir))


def size_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.leaderboard(_results(spark, sf_dir)).select("tier", "rnk", "name", "compressed_size", "ratio", "size")


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.against(_results(spark, sf_dir), BASELINE).select("name", "delta_pct")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report's lines."""
    return report.text_lines(_results(spark, sf_dir))


_C = "c as (select doc_id, lang, source, unnest(string_split(text, '')) as sym from documents), d as (select * from c where sym <> '')"
_K = "sum(cnt) * log2(sum(cnt)::double) - sum(cnt * log2(cnt::double))"
_RES = """m as (
  select source, octet_length(encode(text)) as original, unnest([{'tier': 1, 'method': 'utf8', 'size': octet_length(encode(text))}, {'tier': 2, 'method': 'points', 'size': length(text)}, {'tier': 3, 'method': 'spaces', 'size': length(text) - length(replace(text, ' ', ''))}]) as m from documents),
 res as (select source || '-' || m.method as name, cast(m.tier as int) as tier, cast(sum(original) as bigint) as original_size, cast(sum(m.size) as bigint) as compressed_size, round(avg(m.size::double / original), 6) as ssim from m group by source, m.tier, m.method)"""
_BYTES = "list_transform(range(1, octet_length(encode({w})) + 1), lambda i: ('0x' || substring(hex(encode({w})), i * 2 - 1, 2))::int)"


_KNOWN = r"known as (select distinct word from (select unnest(regexp_split_to_array(text, '\s+')) as word from benchmark) where word <> '')"
_SIZE = f"size as (select n, m, greatest(1, cast(trunc(m::double / n * ln(2::double)) as bigint)) as k from (select n, cast(trunc(-n * ln({BLOOM_RATE}::double) / pow(ln(2::double), 2)) as bigint) as m from (select count(*) as n from known)))"


def _bloom_sql(words: str) -> str:
    h1 = "list_reduce(list_transform(b, lambda v: v::hugeint), lambda h, v: (xor(h, v) * 16777619) % 4294967296, 2166136261::hugeint)"
    h2 = "list_reduce(list_transform(b, lambda v: v::hugeint), lambda h, v: (h * 31 + v) % 4294967296, 16777619::hugeint)"
    return f"(select word, list_transform(range(0, k), lambda i: ((h1 + i * h2) % m)::int) as bits from (select word, {h1} as h1, {h2} as h2 from (select word, {_BYTES.format(w='word')} as b from {words})), size)"


SQL = {
    "byte_coder_roundtrips": f"select unnest({[*CODERS, *EXTRA_CODERS]}) as coder, n as docs, n as exact from (select count(*) as n from documents)",
    "symbol_frequency": f"with {_C} select sym, count(*) as cnt from d group by 1",
    "byte_entropy": f"with {_C}, k as (select lang, sym, count(*) as cnt from d group by all) select lang, round(({_K}) / sum(cnt), 6) + 0.0 as bps from k group by 1",
    "entropy_floor": f"with {_C}, k as (select source, sym, count(*) as cnt from d group by all) select source, cast(sum(cnt) as bigint) as n, round({_K}, 1) + 0.0 as bits from k group by 1",
    "container_kinds": f"select ([{', '.join(repr(k) for k in containers.MAGIC.values())}, 'standard'])[doc_id % {len(containers.MAGIC) + 1} + 1] as kind, count(*) as n from documents group by 1",
    "exact_dup_groups": "select dup_count, count(*) as groups from (select count(*) as dup_count from documents group by sha256(text)) group by 1",
    "bloom_build_bits": f"with {_KNOWN}, {_SIZE} select any_value(m) as bits, count(distinct bit) as set_bits from (select unnest(bits) as bit from {_bloom_sql('known')}), size",
    "bloom_probe_words": rf"""with {_KNOWN}, {_SIZE}, s as (select distinct unnest(bits) as bit from {_bloom_sql('known')}), w as (select distinct word from (select unnest(regexp_split_to_array(text, '\s+')) as word from documents) where word <> ''),
      p as (select word, unnest(bits) as bit from {_bloom_sql('w')}), q as (select word, bool_and(s.bit is not null) as maybe from p left join s on p.bit = s.bit group by 1)
      select cast(sum(maybe::int) as bigint) as hits, cast(sum((maybe and f.word is null)::int) as bigint) as false_pos, cast(sum((not maybe and f.word is not null)::int) as bigint) as missed from q left join known f on q.word = f.word""",
    "huffman_lengths": f"""with recursive {_C}, k as (select lang, sym, count(*) as cnt from d group by all), r as (
      select lang, list_sort(list({{'c': cnt::bigint, 's': sym, 'm': [sym]}})) as h, []::varchar[] as merged from k group by 1
      union all select lang, list_sort(list_append(h[3:], {{'c': h[1].c + h[2].c, 's': least(h[1].s, h[2].s), 'm': list_concat(h[1].m, h[2].m)}})), list_concat(merged, list_concat(h[1].m, h[2].m)) from r where len(h) > 1),
      n as (select lang, sym, count(*) as len from (select lang, unnest(merged) as sym from r where len(h) = 1) group by all)
      select k.lang, k.sym, k.cnt, coalesce(n.len, 1) as len from k left join n on n.lang = k.lang and n.sym = k.sym""",
    "huffman_cost": f"""with recursive {_C}, k as (select lang, sym, count(*) as cnt from d group by all), r as (
      select lang, list_sort(list(cnt::bigint)) as w, 0::bigint as bits, cast(sum(cnt) as bigint) as n from k group by 1
      union all select lang, list_sort(list_append(w[3:], w[1] + w[2])), bits + w[1] + w[2], n from r where len(w) > 1)
      select lang, n, case when bits = 0 then n else bits end as bits from r where len(w) = 1""",
    "tier_winners": f"with {_RES}, r as (select *, row_number() over (partition by tier order by compressed_size, name) as k from res) select tier, name, compressed_size from r where k = 1",
    "best_under_budget": f"with {_RES}, r as (select *, row_number() over (partition by tier order by ssim desc, compressed_size, name) as k from res where compressed_size <= 40000) select tier, name, compressed_size, ssim from r where k = 1",
    "report_rollup": f"with {_RES} select tier, count(*) as methods, min(compressed_size) as best_size, cast(sum(compressed_size) as bigint) as total_size from res group by rollup (tier)",
    "size_leaderboard": f"with {_RES} select tier, cast(rank() over (partition by tier order by compressed_size) as int) as rnk, name, compressed_size, round(original_size::double / compressed_size, 4) as ratio, case when compressed_size < 1024 then compressed_size || ' B' when compressed_size < 1048576 then format('{{:.1f}} KB', compressed_size / 1024.0::double) else format('{{:.2f}} MB', compressed_size / 1048576.0::double) end as size from res",
    "report_lines": f"with {_RES} select tier, cast(row_number() over (partition by tier order by compressed_size, name) as int) as line_no, printf('%-35s %10s %7.1fx %8s %8s %s', name, case when compressed_size < 1024 then compressed_size || ' B' when compressed_size < 1048576 then format('{{:.1f}} KB', compressed_size / 1024.0::double) else format('{{:.2f}} MB', compressed_size / 1048576.0::double) end, round(round(original_size::double / compressed_size, 4), 1), printf('%.4f', round(ssim, 4)), 'N/A', '') as line from res",
    "baseline_delta": f"with {_RES} select name, round((compressed_size - {BASELINE}) / {BASELINE}.0::double * 100, 4) as delta_pct from res",
}

QUERIES = [
    symbol_frequency, byte_entropy, entropy_floor, huffman_lengths, huffman_cost, codec_race, byte_coder_roundtrips, container_budget, container_kinds, exact_dup_groups, bloom_build_bits, bloom_probe_words,
    tier_winners, best_under_budget, report_rollup, size_leaderboard, baseline_delta, report_lines,
]
