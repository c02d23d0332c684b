"""URL filter as a sort-merge range join.

A rule's host, labels reversed, is the prefix of the hosts that it fits: an interval of sorted keys. Urls and rules are dealt to
ranges of keys, a rule to every range that its interval touches, and a range that one url fills is shared by several tasks. Each
task sweeps its sorted rows with a stack of the rules whose interval is open; those are nested, the deepest on top. The paths of a host are
looked up by their lengths, so that many rules of one host cost a url no more than few.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.common import bounded_sample

#: Fixed values: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Urls of the smallest hashes, whose keys set the ranges.
SAMPLE = 4096


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _parsed(urls: DataFrame, url: str) -> DataFrame:
    found = F.locate("://", F.col(url))
    rest = F.when(found > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path})


def _key(host: str):
    """Labels reversed, each closed by a character that sorts below all others of host names, so that subdomains follow their host."""
    return F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.", -1)), "\u0001"), F.lit("\u0001"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, kind, id, host, path, verdict), rules (kind 0) ahead of urls (kind 1) of one key: urls with their rule."""
    part, stack = None, []  # of each open host: its key, the host, its rules by path, and the lengths of paths, longest first
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for p, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, []))
                _, _, rules, sizes = stack[-1]
                rules[path] = verdict
                if len(path) not in sizes:
                    insort(sizes, len(path), key=lambda n: -n)
                continue
            best = None
            for _, h, rules, sizes in reversed(stack):  # the longest path that fits this host's; deeper hosts come first, and keep what is as long
                r = next((path[:n] for n in sizes if n <= len(path) and path[:n] in rules), None)
                if r is not None and (best is None or len(h) + len(r) > len(best[0]) + len(best[1])):
                    best = (h, r, rules[r])
            for col, v in zip(out, (page, host, path, best and best[0] + best[1], best and best[2]), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])


def _ranges(bounds: list[str]):
    @F.arrow_udf("struct<low:int,high:int,last:int>")
    def find(keys: pa.Array) -> pa.Array:
        """The first and the last range that may hold a key, and the last that may hold a key that it is the prefix of."""
        rows = [(bisect_left(bounds, k), bisect_right(bounds, k), bisect_left(bounds, k + "\U0010ffff")) for k in keys.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], ["low", "high", "last"])

    return find


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict. The longest rule (host and path) that fits decides, of
    two alike the one of the longer host, then the smaller verdict; no rule: null and `default`. A null url, or one without
    ://, has an empty host and path and fits no rule. Repeated rows give repeated rows; further columns play no part. Any number
    of rules: they are sorted and dealt like the urls, never broadcast."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = _parsed(pages.select("page_id", "url"), "url").select(F.col("page_id").cast("long").alias("page_id"), "host", "path", _key("host").alias("key"))
    sample = sorted(r.key for r in bounded_sample(urls.select("page_id", "key"), "page_id", SAMPLE, "key").collect())
    bounds = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    ranges = _ranges(bounds)
    dealt = urls.withColumn("at", ranges("key"))
    dealt = dealt.select((F.col("at.low") + F.pmod(F.xxhash64("page_id", "path"), F.col("at.high") - F.col("at.low") + 1)).cast("int").alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit("").alias("verdict"))
    only = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    one = Window.partitionBy("host", "path").orderBy("verdict")
    only = only.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    spread = only.withColumn("key", _key("host")).select(F.explode(F.sequence(ranges("key")["low"], ranges("key")["last"])).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    swept = dealt.union(spread).repartition(parts, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
