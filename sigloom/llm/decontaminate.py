"""Benchmark decontamination: passages of documents within a small edit distance of benchmark items, over words.

Windows of an item's size are embedded by CGK random walks, which turn edit distance into Hamming distance: at step j the walk writes
the word it stands on and moves on if a random bit of (j, word) says so. Samples of a few places of the embedding are the
keys of locality-sensitive tables, repeated over walks and samples. Windows that meet an item in a table are verified by edit distance.
Only windows that share as many word n-grams with the benchmark as d edits must leave (the q-gram lemma, which loses none) are embedded.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import BROADCAST_ROWS, SLICE, by_ids, gram_hashes, measured, mix, shared_path, slices, small_batches, word_hashes

#: Items that are sent to the tasks at once, in expectation; more are searched for in blocks, one after the other.
BLOCK_ITEMS = 20_000
#: Words of a run: longer items are looked for by even runs of so many at most, one of which must be near where the item is.
RUN = 512
_SPLIT = bytes(32 if i < 0x30 or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))
_PAD = np.uint64(0x5851F42D4C957F2D)


def words_of(text: bytes) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased: marks and white space don't tell texts apart."""
    return text.lower().translate(_SPLIT).split()


class Walks:
    """CGK walks and the places sampled from each: keys of windows of n words."""

    def __init__(self, rate: float, recall: float, places: int = 3, walks: int = 6, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.places, self.seeds = places, rng.integers(1, 2**63, walks, dtype=np.uint64)
        # an edit sets a walk back by some 3 words on average before it finds its pace again, out of 2 places per word
        agree = max(0.2, 1 - 3 * rate) ** places
        self.samples = max(2, math.ceil(math.log(1 - recall) / math.log(1 - agree) / walks))
        self.seed = seed

    def chosen(self, walk: int, n: int) -> np.ndarray:
        """Places of the embedding of n words, `samples` rows of them: within the part that walks have not left the words yet."""
        rng = np.random.default_rng((self.seed, walk, n))
        return rng.integers(0, max(1, int(1.9 * n)), (self.samples, self.places))

    def keys(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """(windows, walks * samples) keys of the windows tokens[start : start + n]; words from `ends` on don't belong to them."""
        out = []
        tokens = np.append(tokens, _PAD)
        last = np.minimum(ends, starts + n)
        for walk, seed in enumerate(self.seeds):
            rows = self.chosen(walk, n)
            at, steps = starts.copy(), int(rows.max()) + 1
            wrote = np.empty((steps, len(starts)), np.uint64)
            for j in range(steps):
                word = np.where(at < last, tokens[np.minimum(at, len(tokens) - 1)], _PAD)
                wrote[j] = word
                at += (mix(word ^ (seed + np.uint64(j * 2 + 1))) >> np.uint64(63)).astype(np.int64)
            for r, row in enumerate(rows):
                key = np.full(len(starts), walk * 1009 + r, np.uint64)
                for place in row:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wrote[place])
                out.append(key)
        return np.stack(out, 1)


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(least edit distance of item to a run of words of text, start, end) by dynamic programming; the earliest end of those, its latest start."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i, w in enumerate(item, 1):
        via = np.append(i, cost[:-1] + (text != w))
        up = cost + 1
        took = np.where(via <= up, np.append(start[0], start[:-1]), start)
        took[0] = 0
        best = np.minimum(via, up)
        best[0] = i
        low = np.minimum.accumulate(best - ramp)
        # of a run of insertions the start is that of the cell it came from
        src = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost, start = low + ramp, took[src]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """Benchmark items as word hashes, with their tables."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, recall: float):
        self.walks = Walks(rate, recall)
        #: Of each run its words, the edits it may have, the number of its item, and how many words stand ahead of it there.
        self.units: list[tuple[np.ndarray, int, int, int]] = []
        #: Items by number: name, words, the edits that it may have.
        self.wholes: list[tuple[int, np.ndarray, int]] = []
        for item, text in items:
            h = word_hashes(words_of(text))
            if len(h):
                ahead = 0
                for part in np.array_split(h, -(-len(h) // RUN)):
                    self.units.append((part, int(rate * len(part)), len(self.wholes), ahead))
                    ahead += len(part)
                self.wholes.append((item, h, int(rate * len(h))))
        self.by_q: dict[int, list[int]] = defaultdict(list)
        for u, (h, d, _, _) in enumerate(self.units):
            q = next(q for q in (3, 2, 1) if len(h) - q + 1 - d * q >= 1 or q == 1)
            self.by_q[q].append(u)
        #: q -> sorted n-grams; and of each the sizes of the items that hold it, as (start of its run, sizes).
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q, us in self.by_q.items():
            both = sorted({(g, len(self.units[u][0])) for u in us for g in gram_hashes(self.units[u][0], q).tolist()})
            known, first = np.unique(np.array([g for g, _ in both], np.uint64), return_index=True)
            self.grams[q] = (known, np.append(first, len(both)), np.array([n for _, n in both]))
        self.bits = {q: np.bincount((g[0] >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for q, g in self.grams.items()}
        #: q -> n -> (d, least shared grams, sorted keys, start of each key's run, units)
        self.sizes: dict[int, dict[int, tuple]] = {}
        for q, us in self.by_q.items():
            by_n: dict[int, list[int]] = defaultdict(list)
            for u in us:
                by_n[len(self.units[u][0])].append(u)
            self.sizes[q] = {}
            for n, same in sorted(by_n.items()):
                d, starts = self.units[same[0]][1], np.arange(len(same)) * n
                keys = self.walks.keys(np.concatenate([self.units[u][0] for u in same]), starts, starts + n, n)
                who = np.repeat(same, keys.shape[1])
                order = np.argsort(keys.ravel(), kind="stable")
                known, first = np.unique(keys.ravel()[order], return_index=True)
                self.sizes[q][n] = (d, max(1, n - q + 1 - d * q), known, np.append(first, len(order)), who[order])

    def hits(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, end) of the closest place of every item that a text, given as word hashes, holds."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        gap = np.array([_PAD])  # between texts, so that no n-gram runs across
        h = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for q, sizes in self.sizes.items():
            if len(h) < q:
                continue
            g = gram_hashes(h, q)
            at = np.flatnonzero(self.bits[q][(g >> np.uint64(44)).astype(np.int64)])
            known, runs, of = self.grams[q]
            place = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            same = known[place] == g[at]
            at, place = at[same], place[same]
            if not len(at):
                continue
            many = runs[place + 1] - runs[place]
            spots = np.repeat(at, many)
            size = of[np.repeat(runs[place] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            for n in np.unique(size).tolist():
                starts, text = self._starts(spots[size == n], first, n, *sizes[n][:2])
                some = max(64, 1_000_000 // n)
                for a in range(0, len(starts), some):
                    self._probe(h, starts[a : a + some], text[a : a + some], first, n, sizes[n], best)
        return [(t, item, *v) for (t, item), v in best.items()]

    @staticmethod
    def _starts(spots: np.ndarray, first: np.ndarray, n: int, d: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows with at least `least` of the n-grams at spots among their n + d words: d edits leave as many. And their texts."""
        if len(spots) < least:
            return spots[:0], spots[:0]
        a, b = spots[: len(spots) - least + 1], spots[least - 1 :]
        text = np.searchsorted(first, a, "right") - 1
        ok = (b - a < n + d) & (b < first[text + 1])
        a, b, text = a[ok], b[ok], text[ok]
        low = np.maximum(first[text], b - (n + d) + 1)
        many = a - low + 1
        starts = np.unique(np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum()))
        text = np.searchsorted(first, starts, "right") - 1
        ok = first[text + 1] - 1 - starts >= n - d
        return starts[ok], text[ok]

    def _probe(self, h: np.ndarray, starts: np.ndarray, text: np.ndarray, first: np.ndarray, n: int, size: tuple, best: dict) -> None:
        _, _, known, runs, units = size
        keys = self.walks.keys(h, starts, first[text + 1] - 1, n)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        rows, cols = np.nonzero(known[at] == keys)
        met = {(int(starts[r]), int(u)) for r, k in zip(rows.tolist(), at[rows, cols].tolist(), strict=True) for u in units[runs[k] : runs[k + 1]]}
        seen: set[tuple[int, int]] = set()
        for s, u in sorted(met):
            _, _, i, ahead = self.units[u]
            item, words, d = self.wholes[i]
            begin = s - ahead  # where the whole item would begin; places less than d + 1 apart are verified together
            if (i, begin // (d + 1)) in seen:
                continue
            seen.add((i, begin // (d + 1)))
            t = int(np.searchsorted(first, s, "right")) - 1
            low, high = max(int(first[t]), begin - d), min(begin + len(words) + 2 * d, int(first[t + 1]) - 1)
            cost, a, b = edits(words, h[low:high])
            place = (cost, low + a - int(first[t]), low + b - int(first[t]))
            if cost <= d and ((t, item) not in best or place[:2] < best[t, item][:2]):
                best[t, item] = place


def _find(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), SLICE):
                out: list[list] = [[], [], [], [], []]
                for t, *found in items.hits([word_hashes(words_of(x or b"")) for x in texts.slice(a, b - a).to_pylist()]):
                    for col, v in zip(out, (ids[a + t], *found), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "edits", "first_word", "end_word"])

    return run


KIND = "doc_id long, item_id long, edits long, first_word long, end_word long"


def _search(texts: DataFrame, benchmark: DataFrame, rate: float, recall: float) -> DataFrame:
    """Rows of KIND, of texts (id, binary text). The driver and the tasks hold one block of items at a time: of several blocks each one's rows are written before the next is read."""
    spark = texts.sparkSession
    small_batches(spark)
    known = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    blocks = -(-known.count() // BLOCK_ITEMS)
    path = shared_path(spark, "leaks") if blocks > 1 else ""
    for b in range(blocks):
        held = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = texts.mapInArrow(_find(Items([(r.item_id, bytes(r.text)) for r in held], rate, recall)), KIND)
        if blocks == 1:
            return found
        found.write.parquet(f"{path}/block={b}")
    return spark.read.schema(KIND).parquet(path).select(*(c.split()[0] for c in KIND.split(", "))) if blocks else spark.createDataFrame([], KIND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.98) -> DataFrame:
    """One row per document and benchmark item that it holds, within rate * (the item's words) edits: doc_id, item_id, edits,
    first_word, end_word (words of letters and digits, from 0, end exclusive) of the closest place, the first of those.

    Documents are searched one by one, whole, against tables of the items, which go to the tasks in blocks of bounded size; nothing
    is shuffled, so that no source or copy is hot. The edit distance of the whole item decides, however long it is. Null and
    wordless texts and items match nothing; repeated documents give repeated rows, repeated items one.
    """
    return _search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), benchmark, rate, recall)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.98) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their doc_id, null or repeated; null and empty texts stay. All columns
    stay; an empty table stays empty, and without items all stays as it is."""
    rid = F.xxhash64("doc_id", "text").alias("rid")
    leaks, seen = measured(_search(docs.select(rid, F.col("text").cast("binary").alias("text")), benchmark, rate, recall).select(F.col("doc_id").alias("rid")).distinct(), "leaks")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return by_ids(docs.select(row, rid), leaks, "rid", "left_anti", seen.n <= BROADCAST_ROWS).select("row.*")
