"""License scan by template-markup matching.

A template is text with regions: [[...]] may be left out (regions nest), {{a-b}} stands for a to b words of any kind. Its words and
regions compile into an automaton over word tokens; a text is accepted where it spells the mandatory wording exactly, and not within a
longer version number or name. Beside it, base phrases are counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import small_batches
from sigloom.llm.license_templates import TEMPLATES

_SPLIT = bytes(32 if i < 0x30 or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))
#: Between two words that are one number or name: 2.0, by-nc, a_b, gpl+.
_GLUE = re.compile(rb"(?<=[0-9])\.(?=[0-9])|(?<=[^\x00-\x2F\x3A-\x60\x7B-\x7F])[-_](?=[^\x00-\x2F\x3A-\x60\x7B-\x7F])")

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.lower().translate(_SPLIT).split()


@dataclass
class Automaton:
    """States 0..; word[s]: {word: next}; any_word[s]: next states of any word; free[s]: next states without a word."""

    word: list[dict[bytes, int]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    end: int = 0
    must: frozenset[bytes] = frozenset()

    def state(self) -> int:
        self.word.append({}), self.any_word.append([]), self.free.append([])
        return len(self.word) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in out:
                    out.add(n), todo.append(n)
        return out

    @property
    def firsts(self) -> set[bytes]:
        """The words with which a text begins."""
        start = self.closed({0})
        if any(self.any_word[s] for s in start):
            raise ValueError("a template begins with words of its own")
        return {w for s in start for w in self.word[s]}

    def longest(self, words: list[bytes], at: int, glued: np.ndarray | tuple = ()) -> int:
        """End of the longest accepted run of words from `at`, or -1. glued: whether each word and the next are one number or name."""
        now, best, begin = self.closed({0}), -1, at
        while True:
            if self.end in now and not (len(glued) and at > begin and glued[at - 1]):
                best = at
            if at >= len(words) or not now:
                return best
            w = words[at]
            now = self.closed({self.word[s][w] for s in now if w in self.word[s]} | {n for s in now for n in self.any_word[s]})
            at += 1


def compile_template(template: str) -> Automaton:
    a, opened = Automaton(), []
    now = a.state()
    must: list[bytes] = []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", template, re.S):
        if part == "[[":
            opened.append(now)
        elif part == "]]":
            a.free[opened.pop()].append(now)
        elif part.startswith("{{"):
            least, most = map(int, part[2:-2].split("-"))
            ends = []
            for i in range(most):
                ends += [now] if i >= least else []
                new = a.state()
                a.any_word[now].append(new)
                now = new
            for s in ends:
                a.free[s].append(now)
        else:
            for w in words_of(part.encode()):
                new = a.state()
                a.word[now][w] = new
                now = new
                must += [] if opened else [w]
    if opened:
        raise ValueError("a region isn't closed")
    if not must:
        raise ValueError("a template needs mandatory words")
    a.end, a.must = now, frozenset(must)
    return a


#: Every template has one of these.
_SIGNS = (b"licen", b"under", b"permission", b"redistribution", b"free software", b"unencumbered")


@lru_cache(1)
def _compiled() -> list[tuple[str, Automaton, set[bytes]]]:
    return [(label, a, a.firsts) for label, ts in TEMPLATES.items() for t in ts for a in [compile_template(t)]]


def _glued(text: bytes, n: int) -> np.ndarray:
    """Of each of a text's n words whether it and the next are one number or name."""
    out = np.zeros(n + 1, bool)
    ends = [m.start() for m in _GLUE.finditer(text)]
    if ends:
        space = np.frombuffer(text.translate(_SPLIT), np.uint8) == 32
        starts = np.cumsum(~space & np.append(True, space[:-1]))
        out[starts[np.array(ends) - 1] - 1] = True
    return out


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """(number of words, base places (word, label), accepted templates (first word, end, label))."""
    words = words_of(text)
    low = text.lower()
    base, found = [], []
    if b"license" in low:
        for phrase, label in PHRASES.items():
            ws = phrase.encode().split()
            if ws[0] in low:
                base += [(i, label) for i in range(len(words) - len(ws) + 1) if words[i] == ws[0] and words[i : i + len(ws)] == ws]
    if not any(w in low for w in _SIGNS):
        return len(words), sorted(base), found
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    glued = None
    for label, a, firsts in _compiled():
        if a.must.issubset(places):
            glued = _glued(low, len(words)) if glued is None else glued
            found += [(i, e, label) for w in firsts for i in places.get(w, ()) if (e := a.longest(words, i, glued)) > i]
    return len(words), sorted(base), found


KIND = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>"


def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        n, base, found = scan(text or b"")
        own = {x[1] for x in base}
        end = covered = 0
        for s, e, _ in sorted(found):
            covered += max(0, e - max(s, end))
            end = max(end, e)
        rows.append({"n_words": n, "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None, "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[2] for x in found})), "score": covered / n if n else 0.0})
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    return pa.array(rows, pa.struct(kinds))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and what KIND names; score is the share of the words that accepted templates cover.
    Rows are handled one by one, whole; null and empty texts have no words; repeated rows give repeated rows; further columns
    play no part."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.arrow_udf(_scan, KIND)(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("x")).select("doc_id", "x.*")
