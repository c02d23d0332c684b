"""N-gram Jaccard join by parity sketches: exact links between documents by their sets of word shingles, and their groups.

A document's set is split by hash into k pieces; of each piece the parity (the XOR of its shingles' hashes, 64 parity bits) is a key. Two
sets whose symmetric difference is at most d differ in at most d pieces, so that k - d of k pieces agree: the pigeonhole join is on
these parities. Sizes fall into bands of ratio 1 / threshold: linked sets lie in one band or in neighbours, and a band fixes d and k. Sets
that share a key are candidates; a longer parity sketch of the whole set, whose Hamming distance never exceeds the symmetric
difference, and the sizes rule candidates out; the shingles of the texts decide the rest.

Keys that many unlike sets share (a passage that many documents hold) are left aside for each set that has fewer of them than the
k - d keys that any partner must share: such a partner shares a rarer key too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import BROADCAST_ROWS, by_ids, components, cut, gram_hashes, measured, mix, scratch, signed, sized, small_batches, word_hashes

SKETCH_WORDS = 8
#: Members of a group of candidates that one task verifies against the group's first; more are dealt to more tasks.
SALT_ROWS = 2000
#: Rounds of comparing neighbours in random orders of the buckets, at most, and rows of a bucket that are ordered together.
ROUNDS, CHAIN_ROWS = 2, 2000
#: Sets of a bucket that are compared with each other in one go; buckets of more are hot, and their sets are dealt to cells.
HOT = 400
#: Nodes that a task remembers in order to emit the pieces of repeated sets once.
SEEN = 500_000
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words split at ASCII white space."""
    return np.unique(gram_hashes(word_hashes(text.lower().split()), words))


class Bands:
    """Size bands for Jaccard >= num / den: band i is [ratio^i, ratio^(i+1)), with its piece count and slack."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.step = num, den, math.log(den / num) * 1.0001

    def of(self, size: int) -> int:
        return int(math.log(size) / self.step)

    def pieces(self, band: int) -> tuple[int, int]:
        """(k, slack) of a group: its smaller set is of this band, so it differs by d at most; k = 0: only equal sets link."""
        largest = math.floor(math.exp((band + 1) * self.step)) + 1
        d = largest * (self.den - self.num) // self.num
        spare = (d + 1) // 4  # agreeing pieces beyond the one needed
        empty = (d + 1 + spare) * math.exp(-math.exp(band * self.step) / (d + 1 + spare))  # as many are expected in the smallest sets
        slack = 1 + spare + math.ceil(empty + 2 * math.sqrt(empty))
        return (d + 1 + slack, slack) if d else (0, 0)

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Keys of the pieces under the group of the set's own band and of the one below, and for groups of even and of odd bands how many keys
        a linked set of the group shares at least. The last bit of a key is that of its band; s is sorted. A pair is compared in the group of its
        smaller set's band, so that two sets that are both there as larger ones need not be."""
        out, need = [], [0, 0]
        for band in {max(0, self.of(len(s)) - 1), self.of(len(s))}:
            k, slack = self.pieces(band)
            if not k:
                continue
            seed = np.uint64((band + 1) * _GOLDEN & _MASK)
            piece = ((mix(s ^ seed) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            acc = np.zeros(k, np.uint64)
            np.bitwise_xor.at(acc, piece.astype(np.intp), s)
            held = acc != 0
            last = np.uint64(band & 1)
            out.append(mix(acc ^ mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1)))[held] & ~np.uint64(1) | last)
            need[band & 1] = max(0, slack + 1 - int(k - held.sum()))
            if k - held.sum() > slack:
                # slack + 1 of k pieces agree; where a set has no more than slack empty ones, one that agrees isn't empty. Two sets that
                # both have more may agree in empty ones alone: they give the first shingles by hash, of which linked sets share one
                out.append(mix(s[: len(s) - -(-len(s) * self.num // self.den) + 1] ^ mix(np.uint64([band + 1]))) & ~np.uint64(1) | last)
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64), need


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits in 64-bit words: the least power of two of words that gives a set a bit a shingle, SKETCH_WORDS at least. Folded in
    halves it is the sketch of half as many words."""
    words = max(SKETCH_WORDS, 1 << max(0, (len(s) - 1) // 64).bit_length())
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


DIGEST = "rid long, doc_id long, n long, node long, odd int, keys array<long>, need array<int>, sketch array<long>"


def _digest(words: int, num: int, den: int):
    """Rows (rid, doc_id, text) as DIGEST: size and hash of the set, an even number, and whether its own band is odd; keys, need and sketch where a task meets a set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            ns, nodes, odd, keys, needs, sketches = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text or b"", words)
                node = int(signed(mix(np.array([np.bitwise_xor.reduce(s) ^ mix(s[:1] + np.uint64(len(s)))[0] ^ np.add.reduce(mix(s))])))[0]) & ~1 if len(s) else None
                first = len(s) and node not in seen
                ns.append(len(s)), nodes.append(node), odd.append(bands.of(len(s)) & 1 if len(s) else None)
                k, need = bands.keys(s) if first else (None, None)
                keys.append(signed(k) if first else None), needs.append(need), sketches.append(sketch(s) if first else None)
                if first:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
            made = [pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(odd, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(needs, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["rid", "doc_id", "n", "node", "odd", "keys", "need", "sketch"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order: those of keys that several nodes of this range have, once each, with the key's first node. Keys at the
    ends of a range may go on in the next one, and stay anyhow; so a key of any number of nodes is read by as many tasks as it takes."""

    def rows(*cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols], ["key", "node", "low"])

    now, low, last, waits, border = None, 0, None, False, True
    for batch in batches:
        key, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        again = np.append(now == key[0] and last == node[0], (key[1:] == key[:-1]) & (node[1:] == node[:-1]))
        key, node = key[~again], node[~again]
        if not len(key):
            continue
        out: tuple[list, list, list] = ([], [], [])
        new = np.append(now is None or key[0] != now, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: of the run that the last batch ended in
        lows = np.where(run >= 0, node[starts][run] if len(starts) else 0, low)
        many = np.append(np.diff(np.append(starts, len(key))) > 1, True)[run]  # the last place: the run gone on with
        if waits and (border or not new[0]):
            out[0].append(np.array([now])), out[1].append(np.array([low])), out[2].append(np.array([low]))
        out[0].append(key[many]), out[1].append(node[many]), out[2].append(lows[many])
        if len(starts):
            border = now is None and len(starts) == 1
            if now is None and not border and not many[0]:
                out[0].append(key[:1]), out[1].append(node[:1]), out[2].append(node[:1])
        waits = not many[-1]
        now, low, last = key[-1], lows[-1], node[-1]
        yield rows(*out)
    if waits:
        yield rows([np.array([now])], [np.array([low])], [np.array([low])])


def _verify(words: int, num: int, den: int):
    """Rows (a, salt, role, b, text) sorted by (a, salt, role): a's own text with role 0, then those to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for a, salt, role, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(text, words)
                if role == 0:
                    now, own = (a, salt), s
                elif now == (a, salt):
                    same = len(np.intersect1d(own, s, assume_unique=True))
                    if den * same >= num * (len(own) + len(s) - same):
                        out_a.append(a), out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _facts(digest: DataFrame) -> DataFrame:
    """(node, rid, n, need, w0.., sketch): of each node a row that has it, its size, and the sketch folded to SKETCH_WORDS words and whole."""
    held = digest.where("sketch is not null").select("node", "rid", "n", "need", "sketch").dropDuplicates(["node"])
    fold = F.array(*(F.aggregate(F.sequence(F.lit(i), F.size("sketch") - 1, F.lit(SKETCH_WORDS)), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.col("sketch")[j])) for i in range(SKETCH_WORDS)))
    return held.withColumn("w", fold).select("node", "rid", "n", "need", *(F.col("w")[i].alias(f"w{i}") for i in range(SKETCH_WORDS)), "sketch")


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and sketches of rows x and y allow a link: the Hamming distance bounds the symmetric difference from below."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    short = [F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(SKETCH_WORDS)]
    whole = F.expr(f"""
      aggregate(sequence(0, least(size({x}.sketch), size({y}.sketch)) - 1), 0, (acc, i) -> acc + bit_count(
        aggregate(sequence(i, size({x}.sketch) - 1, least(size({x}.sketch), size({y}.sketch))), 0L, (h, j) -> h ^ {x}.sketch[j]) ^
        aggregate(sequence(i, size({y}.sketch) - 1, least(size({x}.sketch), size({y}.sketch))), 0L, (h, j) -> h ^ {y}.sketch[j])))""")
    near = lambda far: far * (den + num) <= (nx + ny) * (den - num)
    return (nx * den >= ny * num) & (ny * den >= nx * num) & near(sum(short[1:], short[0])) & near(whole)


def _links(docs: DataFrame, facts: DataFrame, pairs: DataFrame, n: int, name: str, words: int, num: int, den: int) -> tuple[DataFrame, int]:
    """Of n pairs (a, b) of nodes, a cut table, those whose sets meet the threshold, cut, and their number. docs: rid and text."""
    if not n:
        return pairs, 0
    dealt = pairs.withColumn("salt", F.lit(0))
    if n > SALT_ROWS:
        salts = sized(pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1"), "salts")
        dealt = pairs.join(salts, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    asked = dealt.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b")).union(dealt.select("a", "salt", F.lit(1).alias("role"), "b"))
    reps, seen = measured(facts.select("node", "rid").join(asked.select(F.col("b").alias("node")).distinct(), "node"), "reps")
    texts = by_ids(docs, reps, "rid", "inner", seen.n <= BROADCAST_ROWS).select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"])
    rows = asked.join(texts, F.col("b") == F.col("node")).select("a", "salt", "role", "b", "text")
    links, seen = measured(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_verify(words, num, den), "a long, b long"), name)
    return links, seen.n


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with rid, a hash of doc_id and text: rows that have both alike share it."""
    return docs.withColumn("rid", F.xxhash64("doc_id", "text"))


def _grouped(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Per row of docs: rid, doc_id, n, node (null without words), comp (the component's name)."""
    small_batches(docs.sparkSession)
    docs = _numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    digest = cut(docs.select("rid", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_digest(words, num, den), DIGEST), "digest")
    facts = cut(_facts(digest), "facts")
    # the last bit of a node says there whether it is in its own band's group
    index = digest.where("keys is not null").select(F.explode("keys").alias("key"), "node", "odd").select("key", F.expr("node | (1 - ((key & 1) ^ odd))").alias("node"))
    found = index.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, low long")
    shared = cut(found.select("key", F.expr("node & ~1L").alias("node"), F.expr("low & ~1L").alias("low"), F.expr("cast(node & 1 as int)").alias("own"), F.expr("cast((node | low) & 1 as int)").alias("pair")), "shared")
    docs = docs.select("rid", "text")
    pairs = shared.where("node != low and pair = 1").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    check = lambda found, name: _links(docs, facts, *found, name, words, num, den)
    links, n = check(_allowed(facts, pairs, num, den), "links")
    groups = components(links)
    for i in range(ROUNDS):
        more, n = check(_allowed(facts, _chained(shared, groups, i), num, den), "chained")
        if not n:
            break
        links = cut(links.union(more), "links")
        groups = components(links)
    more, n = check(_across(facts, shared, groups, num, den), "last")
    groups = components(links.union(more)) if n else groups
    return digest.select("rid", "doc_id", "n", "node").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def ngram_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id and class_id (a hash of its set).

    Two documents link if den * |A and B| >= num * |A or B|; component_id is the smallest doc_id that links reach. Exact: copies
    share a class; the classes of a bucket are compared with its smallest one, then, where it still holds more than one component,
    with neighbours in random orders, and in the end all pairs across its components that sizes and sketches allow. Null or wordless texts: 0
    shingles, no links. A null doc_id gets its component's name but is never one. Rows with one doc_id count as separate
    documents. Empty tables give none; other columns are ignored.
    """
    rows = cut(_grouped(docs, words, num, den), "rows")
    many = rows.where("node is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    return rows.join(sized(many.select("comp", "component_id"), "least"), "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("node").alias("class_id"))


def _allowed(facts: DataFrame, pairs: DataFrame, num: int, den: int) -> tuple[DataFrame, int]:
    """The pairs whose sizes and sketches allow a link, cut, and their number."""
    x, y = facts.alias("x"), facts.alias("y")
    pairs, seen = measured(pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & _fits("x", "y", num, den)).select("a", "b"), "allowed")
    return pairs, seen.n


def _mixed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, own, comp, rows) of the buckets, of so many rows, that hold more than one component so far and a set of their own band."""
    at = shared.select("key", "node", "own").join(comps, "node", "left").select("key", "node", "own", F.coalesce("comp", "node").alias("comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("own").alias("any"), F.count("*").alias("rows")).where("c0 < c1 and any = 1").select("key", "rows")
    return at.join(mixed, "key")


def _chained(shared: DataFrame, comps: DataFrame, i: int) -> DataFrame:
    """Pairs of neighbours in a random order of each mixed bucket, another order in each bucket and round, if their components differ.

    A set has one neighbour or two per bucket: groups of near copies, whose members share many buckets, grow together by pairs in
    proportion to their rows.
    """
    order = F.xxhash64("node", "key", F.lit(i))
    w = Window.partitionBy("key", F.pmod(F.xxhash64(F.lit(i), "node"), F.ceil(F.col("rows") / CHAIN_ROWS))).orderBy(order)
    rows = _mixed(shared, comps).select("node", "comp", "own", F.lag("node").over(w).alias("n2"), F.lag("comp").over(w).alias("c2"), F.lag("own").over(w).alias("o2"))
    return rows.where("comp != c2 and own + o2 > 0").select(F.least("node", "n2").alias("a"), F.greatest("node", "n2").alias("b")).distinct()


def _across(facts: DataFrame, shared: DataFrame, comps: DataFrame, num: int, den: int) -> tuple[DataFrame, int]:
    """Pairs of nodes that share a bucket, lie in different components so far, and pass the sizes and the sketches: all that is left to compare, and how many.

    A node that has fewer keys of hot buckets than a linked set must share with it leaves these: whoever links with it shares
    another bucket. What remains of a hot bucket is dealt to cells, pairs of its parts of some HOT nodes.
    """
    mixed, seen = measured(_mixed(shared, comps), "mixed", most=F.max("rows"))
    rows = mixed.where(F.col("rows") <= HOT).select("key", "node", "own", "comp", F.lit(1).alias("cells"))
    if (seen.most or 0) > HOT:
        band = F.col("key").bitwiseAND(F.lit(1)).cast("int")
        hot = mixed.where(F.col("rows") > HOT).select("key", "node", "own", "comp", band.alias("band"))
        many = hot.groupBy("node", "band").agg(F.count("*").alias("hot"))
        bound = cut(many.join(facts.select("node", "need"), "node").where(F.col("hot") >= F.col("need")[F.col("band")]).select("node", "band"), "bound")
        stay = hot.join(bound, ["node", "band"], "left_semi").select("key", "node", "own", "comp")
        left = cut(stay.join(stay.groupBy("key").agg(F.count("*").alias("rows")), "key"), "hot")
        rows = rows.union(left.select("key", "node", "own", "comp", F.ceil(F.col("rows") / HOT).cast("int")))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cells")).cast("int")).join(facts.drop("rid", "need"), "node")
    x = rows.where("own = 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("x")  # with every cell of its bucket
    y = rows.alias("y")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.other") == F.col("y.cell")) & ((F.col("y.own") == 0) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.comp") != F.col("y.comp"))
    pairs = x.join(y, across & _fits("x", "y", num, den)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    pairs, seen = measured(pairs.distinct(), "across")
    return pairs, seen.n


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group left, that of the smallest doc_id (rows with a null one come last; of one doc_id's texts the smallest
    hash); all columns stay. Rows whose doc_id and text are alike are copies, of which any one stays. Null and wordless texts are in no
    group and all stay; an empty table stays empty."""
    names = docs.columns
    with scratch(docs.sparkSession) as last:
        rows = last(_grouped(docs, words, num, den).where("node is not null").select("rid", "doc_id", "comp"), "rows")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count("*").alias("size")).where("size > 1")
    split = cut(rows.join(sized(first.select("comp", F.col("first.rid").alias("kept")), "first"), "comp").select("rid", "kept"), "split")
    lost, gone = measured(split.where("rid != kept").select("rid").distinct(), "lost")
    many, again = measured(split.where("rid = kept").groupBy("rid").count().where("count > 1").select("rid"), "many")
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    out = by_ids(docs.select(row, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rid")), lost, "rid", "left_anti", gone.n <= BROADCAST_ROWS)
    if again.n:
        few = again.n <= BROADCAST_ROWS
        out = by_ids(out, many, "rid", "left_anti", few).union(by_ids(out, many, "rid", "left_semi", few).dropDuplicates(["rid"]).select(*out.columns))
    return out.select("row.*")
