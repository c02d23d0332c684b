"""Secret scan by multipart credential linking, in DataFrame functions only.

Regular expressions name parts: access identifiers, secrets and endpoints, strong ones (base kinds) and weak ones. A weak part is
reported only where a part that completes it lies in its scope, the interval that begins `reach` code points ahead of it and ends as
many behind it. Parts and scopes of a document are joined as intervals inside its row, by sweeping the parts in order of start, once
forward and once back, so that nothing is shuffled, whatever source or copy is hot, and a text's cost is near its length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, group whose length counts, its least length, lossless quick test in SQL over {t})
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "(contains({t}, '=') or contains({t}, ':'))"),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20, "contains({t}, 'AKIA')"),
    "hex": (r"([0-9a-f]{24,})", 1, 24, "true"),
}
#: The weak kinds, and the kinds of which one must lie in scope.
WEAK = {
    "id": (r"""(?i:(user|username|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, "(contains({t}, '=') or contains({t}, ':'))"),
    "key": (r"""(?i:(pwd|passphrase|credential|auth|bearer|private_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "(contains({t}, '=') or contains({t}, ':'))"),
    "endpoint": (r"""((?i:https?|ftp|ssh|jdbc:[a-z]{1,20}|postgres|mysql|redis|mongodb|amqp)://[^\s"'<>]+)""", 1, 10, "contains({t}, '://')"),
    # the identifier of a pair, or its secret: which of the two depends on what stands beside it
    "access_key": (r"""(?i:((?<!secret)(?<!secret[_-])access[_-]?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 2, 3, "(contains({t}, '=') or contains({t}, ':'))"),
    "secret_key": (r"""(?i:(secret[_-]?(?:access[_-]?)?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)""", 2, 3, "(contains({t}, '=') or contains({t}, ':'))"),
    "bare": (r"((?<![A-Za-z0-9/+])(?=[a-z0-9/+]*[A-Z])(?=[A-Z0-9/+]*[a-z])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+]))", 1, 40, "contains({t}, 'AKIA')"),
}
NEEDS = {
    "id": ("assign", "hex", "key", "access_key", "secret_key"), "key": ("access", "id", "endpoint", "access_key", "secret_key"), "endpoint": ("assign", "hex", "key", "access_key", "secret_key"),
    "access_key": ("assign", "access", "hex", "id", "key", "endpoint", "secret_key"), "secret_key": ("assign", "access", "hex", "id", "key", "endpoint", "access_key"), "bare": ("access",),
}
KINDS = [*BASE, *WEAK]
#: Code points between a part and one that completes it, at most; and code points of a text that are cut out together.
REACH, CHUNK = 400, 512


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def _lengths(text: Column, kind: str) -> Column:
    """Of each match in order: code points before it since the last one, its own, and those of the group that counts."""
    pattern, group, _, quick = (BASE | WEAK)[kind]
    size = lambda parts: F.transform(parts, lambda x: F.length(x))
    zipped = F.arrays_zip(size(F.split(text, pattern, -1)).alias("gap"), size(F.regexp_extract_all(text, _literal(pattern), F.lit(0))).alias("own"), size(F.regexp_extract_all(text, _literal(pattern), F.lit(group))).alias("value"))
    found = F.filter(zipped, lambda x: x["own"].isNotNull())
    empty = F.expr("cast(array() as array<struct<gap:int,own:int,value:int>>)")
    return F.when(F.expr(quick.format(t="`text`")) & text.rlike(pattern), found).otherwise(empty)


def swept(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind> of emit(state, x) over items in order; the state is zero, then step(state, x). The items go in blocks of about the
    root of their number, first for the state ahead of each block, as every appending copies."""
    width = F.floor(F.sqrt(F.size(items))).cast("int") + 1
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / width).cast("int")), lambda b: F.slice(items, b * width + 1, width))
    none = F.expr(f"cast(array() as array<{kind}>)")
    ahead = F.aggregate(
        blocks, F.struct(zero.alias("state"), F.slice(F.array(F.struct(zero.alias("state"), items.alias("items"))), 1, 0).alias("out")),
        lambda acc, block: F.struct(F.aggregate(block, acc["state"], step).alias("state"), F.concat(acc["out"], F.array(F.struct(acc["state"].alias("state"), block.alias("items")))).alias("out")),
        lambda acc: acc["out"],
    )
    inside = lambda block: F.aggregate(
        block["items"], F.struct(block["state"].alias("state"), none.alias("out")),
        lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], x))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(ahead, inside))


def _placed(lengths: Column, k: int, least: int) -> Column:
    """array<struct<s, k, e>> of the matches, in order, whose group is long enough."""
    found = swept(
        lengths, F.lit(0), lambda at, x: at + x["gap"] + x["own"],
        lambda at, x: F.struct((at + x["gap"]).alias("s"), F.lit(k).alias("k"), (at + x["gap"] + x["own"]).alias("e"), x["value"].alias("value")), "struct<s:int,k:int,e:int,value:int>",
    )
    return F.transform(F.filter(found, lambda x: x["value"] >= least), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _linked(spans: Column, reach: int) -> Column:
    """Of spans in order of start the strong ones, and the weak ones in whose scope one of the spans that complete them lies."""
    weak = {KINDS.index(kind): [KINDS.index(o) for o in others] for kind, others in NEEDS.items()}
    never = 1 << 30

    def join(items: Column, none: int, later: Callable[[Column, Column, Column], Column], near: Callable[[Column, Column], Column]) -> Column:
        """items, with whether the best of those ahead that complete each is near."""
        zero = F.struct(*(F.lit(none).alias(f"n{k}") for k in weak))
        step = lambda state, x: F.struct(*(F.when(x["k"].isin(others), later(state[f"n{k}"], x["s"], x["e"])).otherwise(state[f"n{k}"]).alias(f"n{k}") for k, others in weak.items()))
        said = lambda state, x: functools.reduce(lambda c, k: c.when(x["k"] == k, near(state[f"n{k}"], x)), list(weak)[1:], F.when(x["k"] == next(iter(weak)), near(state[f"n{next(iter(weak))}"], x))).otherwise(F.lit(True))
        return swept(items, zero, step, lambda state, x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), said(state, x).alias("on")), "struct<s:int,k:int,e:int,on:boolean>")

    before = join(spans, -never, lambda best, s, e: F.greatest(best, e), lambda best, x: best >= x["s"] - reach)
    after = F.reverse(join(F.reverse(spans), never, lambda best, s, e: s, lambda best, x: best <= x["e"] + reach))
    both = F.zip_with(before, after, lambda x, y: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), (x["on"] | y["on"]).alias("on")))
    return F.transform(F.filter(both, lambda x: x["on"]), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == k))


def with_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, text, secrets): each row of docs as a struct, its text, and its spans: struct of base and all, each
    array<struct<s, k, e>> in order of start, then kind (k: index in KINDS); s, e: code points, e exclusive. Null texts count as empty."""
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        plain = plain.withColumn(f"_l_{kind}", _lengths(F.col("text"), kind))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")
    for k, kind in enumerate(KINDS):
        spans = _placed(F.col(f"_l_{kind}"), k, (BASE | WEAK)[kind][2])
        plain = plain.withColumn(f"_s_{kind}", F.when(F.size(f"_l_{kind}") > 0, spans).otherwise(none))
    plain = plain.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_s_{k}") for k in BASE))))
    plain = plain.withColumn("_all", F.array_sort(F.concat(*(F.col(f"_s_{k}") for k in KINDS))))
    every = F.when(F.size("_all") > F.size("_base"), _linked(F.col("_all"), reach)).otherwise(F.col("_base"))
    return plain.select("row", "text", F.struct(F.col("_base").alias("base"), every.alias("all")).alias("secrets"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(names[x["k"]], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (see the module). Repeated rows give repeated rows;
    null and empty texts hold no spans; other columns of docs, whatever their names, play no part; an empty table gives an empty one."""
    found = with_spans(docs.select("doc_id", "text"), reach)
    base = F.col("secrets.base")
    counts = [_count(base, k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("row.doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets.all")).alias("spans"))


def _replaced(text: Column, spans: Column, mark: str) -> tuple[Column, Column]:
    """The text's chunks, to be named _chunks, and the text with mark in place of each span, or of spans that overlap. Texts are cut into CHUNK code points first: what lies between spans
    is taken from the chunks it touches, not counted from the text's start."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def part(a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        some = F.slice(F.col("_chunks"), first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1)
        return F.when(b <= a, "").otherwise(F.substring(F.array_join(some, ""), a - first * CHUNK + 1, b - a))

    kept = swept(spans, F.lit(0), lambda end, x: F.greatest(end, x["e"]), lambda end, x: F.struct(end.alias("a"), x["s"].alias("b")), "struct<a:int,b:int>")
    ends = F.array_max(F.transform(spans, lambda x: x["e"]))
    pieces = F.concat(F.transform(F.filter(kept, lambda x: x["b"] >= x["a"]), lambda x: part(x["a"], x["b"])), F.array(part(ends, F.length(text))))
    return chunks, F.array_join(pieces, mark)


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every reported span of text replaced by mark (overlapping spans by one), n_chars brought up to date; texts
    without spans (nulls and empty ones too) and all other columns stay as they are. Rows are handled one by one: repeated ones stay
    repeated, an empty table stays empty."""
    found = with_spans(docs, reach)
    some = F.size("secrets.all") > 0
    chunks, clean = _replaced(F.col("text"), F.col("secrets.all"), mark)
    found = found.select("row", "text", "secrets", some.alias("_some"), F.when(some, chunks).alias("_chunks")).select("row", "_some", F.when(F.col("_some"), clean).alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean")}
    kinds = dict(docs.dtypes)
    old = lambda c: F.col("row")[c]
    return found.select(*((F.when(F.col("_some"), new[c].cast(kinds[c])).otherwise(old(c)) if c in new else old(c)).alias(c) for c in docs.columns))
