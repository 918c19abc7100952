"""Pieces of texts that a tokenizer encodes independently of each other, and caches over them.

A unit is a run of white space with the non-space run after it. Where white space is plain (single spaces, and
newlines inside what stands between them), Arrow splits a whole batch at the spaces and numbers its distinct
pieces, so that Python meets each of them once a batch; other texts are cut by regular expressions.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's white space (property White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_ODD = re.compile(f"[{SPACES}]{{2}}|[{SPACES.replace(' ', '').replace(chr(10), '')}\x00]")
_UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_PLAIN = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
_PLAIN_ODD = re.compile(r"  |\x00")


def units(text: str | None) -> list[str]:
    """Units by Unicode white space; their concatenation is the text."""
    if not text:
        return []
    if _ODD.search(text):
        return _UNIT.findall(text)
    return _cut(text)


def _cut(text: str) -> list[str]:
    out = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return out if out[0] else out[1:]


def space_units(text: str | None) -> list[str]:
    """Units that start with a run of U+0020 or with one newline; other white space is as any character."""
    if not text:
        return []
    if _PLAIN_ODD.search(text):
        return _PLAIN.findall(text)
    return _cut(text)


#: White space that doesn't part units at a single space alone.
_UNEVEN = re.compile(f"[{SPACES}] | [{SPACES}]|^[{SPACES}]|[{SPACES}]$")


_OTHER = re.compile(f"[{SPACES.replace(' ', '').replace(chr(10), '')}]")


class Split:
    """The distinct pieces of a batch of texts and where each text has which.

    ``words``: distinct pieces; ``index``: the piece at each place; ``offsets``: places of each text; a text for which
    ``odd`` holds has none and is for the caller to treat whole."""

    def __init__(self, texts: list, cut, odd):
        self.texts = texts
        self.odd = [bool(t) and odd(t) for t in texts]
        lists = cut(pa.array(["" if o or not t else t for t, o in zip(texts, self.odd, strict=True)], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy().astype(np.int64)
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.offsets -= self.offsets[0]

    def counts(self) -> np.ndarray:
        """How often each distinct piece occurs."""
        return np.bincount(self.index, minlength=len(self.words))

    def spread(self, sizes: np.ndarray) -> np.ndarray:
        """Cumulative sizes over places: entry k is the sum before place k; the last is the total."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[self.index])])

    def joined(self, packed: list[bytes], kind) -> list:
        """For each text the array of its pieces' numbers, one after another; ``packed`` has each piece's as bytes."""
        width = np.dtype(kind).itemsize
        pool = np.frombuffer(b"".join(packed), kind)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[:-1]
        before = self.spread(sizes)
        if not before[-1]:
            return [pool[:0]] * len(self.texts)
        flat = pool[np.repeat(starts[self.index] - before[:-1], sizes[self.index]) + np.arange(before[-1])]
        ends = before[self.offsets]
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def at_spaces(column) -> pa.Array:
    """Lists of what stands between single spaces; the first of a text has no space before it."""
    return pc.split_pattern(column, " ")


def uneven(text: str) -> bool:
    """Whether units are not simply what single spaces part, each with its space."""
    if text[0] in SPACES or text[-1] in SPACES or "  " in text or " \n" in text or "\n " in text:
        return True
    return _OTHER.search(text) is not None and _UNEVEN.search(text) is not None


def slices(batch: pa.RecordBatch, column: int, most: int = 6 << 20):
    """A batch in parts whose texts take about ``most`` bytes (a text at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


#: Longest unit, in characters, that a table or cache keeps: text without spaces is one unit of any length.
LONGEST = 64


class Generations:
    """A worker's cache of bounded size in two generations: what is asked for again outlives a full cache. Keys over LONGEST
    are not kept, so the bound on entries is one on memory too."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(key) > LONGEST:
            return value
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def look_up(self, keys: list, make, often: list | None = None) -> list:
        """Values of distinct keys; ``make(list of keys)`` gives those that are not here, all at once. Of these, only
        keys for which ``often`` holds are kept, so that words met once don't drive out the others."""
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        if None in out:
            lost = []
            for i, found in enumerate(out):
                if found is None:
                    again = old.get(keys[i])
                    if again is None:
                        lost.append(i)
                    else:
                        out[i] = young[keys[i]] = again
            if lost:
                names = [keys[i] for i in lost]
                made = make(names)
                for i, value in zip(lost, made, strict=True):
                    out[i] = value
                young.update((names[k], made[k]) for k, i in enumerate(lost) if (often is None or often[i]) and len(names[k]) <= LONGEST)
            if len(young) >= self.most:
                self.old, self.young = young, {}
        return out


#: A task counts at most so many distinct units at once; then the rarer half is let go. Counts serve
#: only to choose what is looked up first, never a result.
COUNTED = 200_000


def frequent(docs: DataFrame, text_col: str, most: int, per_task: int = 16_384) -> list[tuple[str, int]]:
    """The (nearly) most frequent units of the whole column, at most ``most``, each with its leading space, and counts.

    Counting is map-side; a task sends only its ``per_task`` most frequent units, of at most LONGEST characters and met twice
    or more. Results never depend on what is found here: it fills the first tier of lookup tables.
    """

    def run(batches):
        counts: Counter = Counter()
        for whole in batches:
            for batch in slices(whole, 0):
                split = Split(batch.column(0).to_pylist(), at_spaces, uneven)
                for word, n in zip(split.words, split.counts().tolist(), strict=True):
                    if len(word) <= LONGEST:
                        counts[word] += n
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = [(u, n) for u, n in counts.most_common(per_task + 1) if u and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([f" {u}" for u, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["unit", "c"])

    found = docs.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, "unit string, c long")
    rows = found.groupBy("unit").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "unit").limit(most).collect()
    return [(r[0], r[1]) for r in rows]
