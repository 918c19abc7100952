"""Byte-level BPE encoding and decoding from a table of ranks.

``merge_words`` is the method itself: a fold (``aggregate``) over the byte array of each distinct word
that merges, again and again, the leftmost adjacent pair of lowest rank, with the ranks as a literal map
in the plan (an array of small maps, chosen by the hash of the pair, because Spark searches a map entry
by entry). It encodes the frequent distinct pre-tokens of the corpus, a fixed number of them, and its
results are the broadcast first tier. The remaining, rare words go through the same ranked merges on the
workers, many words at a time (``PairTable``), behind bounded caches: sending every distinct word through
the literal map would cost more CPU than the budget (figures in the README).

Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, no_clash, small_batches
from .units import Generations, Split, at_spaces, frequent, slices, uneven, units

#: Maps in the literal; about a dozen ranks in each for a vocabulary of 50,000.
RANK_MAPS = 4096
_NONE = 1 << 62
_MARKS = frozenset(",.;:!?")
_FREE = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 piece and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_ranks(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost pair of lowest rank is merged until no pair has a rank.

    Short words scan their pairs; long ones keep the pairs in a heap, so that the cost stays near n log n.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    get = ranks.get
    pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (best := min(pairs)) != _NONE:
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(parts[at - 1] + parts[at], _NONE)
        if at < len(pairs):
            pairs[at] = get(parts[at] + parts[at + 1], _NONE)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    from heapq import heapify, heappop, heappush

    n = len(parts)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != left or parts[j] != right:
            continue
        parts[i] = left + right
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                heappush(heap, (r, i, parts[i], parts[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heappush(heap, (r, h, parts[h], parts[i]))
    return [ranks[p] for p, there in zip(parts, alive, strict=True) if there]


def merge_words(words: DataFrame, ranks: dict[bytes, int], column: str = "unit") -> DataFrame:
    """``words`` with ``ids`` array<int>: the fold over byte arrays, in Spark's higher-order functions alone."""
    spark = words.sparkSession
    maps: list[dict[str, int]] = [{} for _ in range(RANK_MAPS)]
    spark_hash = _crc_slot
    for piece, rank in ranks.items():
        maps[spark_hash(piece)][piece.hex().upper()] = rank
    literal = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")

    def rank(maps: Column, piece: Column) -> Column:
        slot = (F.crc32(F.unhex(piece)) % RANK_MAPS).cast("int")
        return F.try_element_at(F.get(maps, slot), piece)

    def ranked(maps: Column, parts: Column) -> Column:
        n = F.size(parts)
        return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: rank(maps, F.concat(F.get(parts, i - 1), F.get(parts, i)))))

    def step(maps: Column, parts: Column) -> Column:
        found = ranked(maps, parts)
        best = F.array_min(found)
        at = F.array_position(found, best).cast("int")
        merged = F.array(F.concat(F.get(parts, at - 1), F.get(parts, at)))
        joined = F.concat(F.slice(parts, F.lit(1), at - 1), merged, F.slice(parts, at + 2, F.size(parts)))
        return F.when(best.isNull(), parts).otherwise(joined)

    def encode(maps: Column) -> Column:
        byte = F.hex(F.encode(F.col(column), "utf-8"))
        n = (F.length(byte) / 2).cast("int")
        start = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(byte, i * 2 - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        parts = F.aggregate(F.when(n > 1, F.sequence(F.lit(2), F.greatest(n, F.lit(2)))).otherwise(F.array().cast("array<int>")), start, lambda parts, _: step(maps, parts))
        return F.transform(parts, lambda p: rank(maps, p))

    return words.withColumn("ids", F.flatten(F.transform(F.array(literal), encode)))


def _crc_slot(piece: bytes) -> int:
    import zlib

    return zlib.crc32(piece) % RANK_MAPS


class PairTable:
    """The same merges for many words at once: a matrix row for each word, and the rank of every adjacent pair."""

    WIDEST = 32

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._place(np.array(keys, np.int64), np.array(values, np.int32))
        self.bytes = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self.ranks = ranks

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots, self.found = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.slots[at[put]], self.found[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _FREE where a pair has none or a side is missing (negative)."""
        out = np.full(left.shape, _FREE, np.int32)
        there = (left >= 0) & (right >= 0)
        key = left[there].astype(np.int64) << 32 | right[there].astype(np.int64)
        where, at = np.flatnonzero(there), self._slot(key)
        flat = out.reshape(-1)
        while len(key):
            held = self.slots[at]
            hit = held == key
            flat[where[hit]] = self.found[at[hit]]
            more = ~hit & (held >= 0)
            key, where, at = key[more], where[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(lengths > self.WIDEST).tolist():
            out[i] = array("I", merge_ranks(words[i], self.ranks)).tobytes()
        for lo, hi in ((1, 8), (9, 14), (15, self.WIDEST)):
            rows = np.flatnonzero((lengths >= lo) & (lengths <= hi))
            if not len(rows):
                continue
            flat = np.frombuffer(b"".join(words[i].ljust(hi, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), hi)
            tokens = np.where(np.arange(hi) < lengths[rows, None], self.bytes[flat], -1)
            self._reduce(rows, tokens, out)
        return out

    def _reduce(self, rows: np.ndarray, tokens: np.ndarray, out: list[bytes]) -> None:
        pairs = self.rank(tokens[:, :-1], tokens[:, 1:])
        while True:
            best = pairs.min(axis=1) if pairs.shape[1] else np.full(len(rows), _FREE)
            done = best == _FREE
            if done.any():
                ready = tokens[done].astype(np.uint32)
                sizes = (tokens[done] >= 0).sum(axis=1)
                for i, row, n in zip(rows[done].tolist(), ready, sizes.tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                go = ~done
                rows, tokens, pairs, best = rows[go], tokens[go], pairs[go], best[go]
            if not len(rows):
                return
            at = pairs.argmin(axis=1)
            line, width = np.arange(len(rows)), pairs.shape[1]
            # drop the pair's right token and the pair itself from each row
            steps = np.arange(width)
            tokens[line, at] = best  # the id of a merged piece is its rank
            tokens = np.take_along_axis(tokens, steps + (steps > at[:, None]), axis=1)
            pairs = np.take_along_axis(pairs, steps[:-1] + (steps[:-1] >= at[:, None]), axis=1)
            left, right = at > 0, at < width - 1
            pairs[line[left], at[left] - 1] = self.rank(tokens[line[left], at[left] - 1], tokens[line[left], at[left]])
            pairs[line[right], at[right]] = self.rank(tokens[line[right], at[right]], tokens[line[right], at[right] + 1])


class Encoder:
    """Texts to packed little-endian 32-bit ids and back, over units and a first tier of words."""

    def __init__(self, ranks: dict[bytes, int], words: dict[str, bytes], pattern: str, cache: int):
        import regex

        self.words = words
        self.find = regex.compile(pattern).findall
        self.table = PairTable(ranks)
        self.plain = all("".join(self.find(u)) == u and len(self.find(u)) == n for u, n in ((" a", 1), ("a", 1), (" \u00e9t\u00e9", 1), (" a,", 2), ("a.", 2)))
        self.units = Generations(cache)
        pieces = sorted((r, p) for p, r in ranks.items())
        size = pieces[-1][0] + 1
        self.piece_sizes, self.piece_starts = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for r, p in pieces:
            self.piece_sizes[r] = len(p)
        self.piece_starts[1:] = np.cumsum(self.piece_sizes)[:-1]
        self.piece_bytes = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)

    def encode(self, texts: list) -> list[bytes]:
        """Packed ids of each text. What no tier knows is merged together, once."""
        split = Split(texts, at_spaces, uneven)
        spaced = [f" {w}" for w in split.words]
        ids = self.units.look_up(spaced, self._make, (split.counts() > 1).tolist())
        body = split.joined(ids, np.uint32)
        heads = {t.partition(" ")[0] for t, odd in zip(texts, split.odd, strict=True) if t and not odd}
        whole = {u for t, odd in zip(texts, split.odd, strict=True) if odd for u in units(t)}
        rest = list(heads | whole)
        alone = dict(zip(rest, self.units.look_up(rest, self._make), strict=True))
        out = []
        for text, odd, found, at in zip(texts, split.odd, body, split.offsets.tolist(), strict=False):
            if odd:
                out.append(b"".join([alone[u] for u in units(text)]))
            elif not text:
                out.append(b"")
            else:  # the first piece of a text has no space before it
                head = text.partition(" ")[0]
                out.append(alone[head] + found[len(ids[split.index[at]]) // 4 :].tobytes())
        return out

    def _make(self, missing: list[str]) -> list[bytes]:
        """Packed ids of units that are not cached. A unit of letters, with or without one space before them, is one
        word; a mark after it is another. Words that no tier knows are merged together."""
        first, find = self.words.get, self.find
        out: list = list(map(first, missing))
        parts: dict[int, list[str]] = {}
        new: dict[str, bytes | None] = {}
        for i, (unit, found) in enumerate(zip(missing, out, strict=True)):
            if found is not None:
                continue
            stem = unit[1:] if unit[0] == " " else unit
            if self.plain and stem.isalpha():
                new[unit] = None
            else:
                words = [unit[:-1], unit[-1]] if self.plain and stem[-1:] in _MARKS and stem[:-1].isalpha() else find(unit)
                parts[i] = words
                for w in words:
                    if first(w) is None:
                        new[w] = None
        if parts:  # words of longer units may be cached as units of their own
            for w in new.keys() & self.units.young.keys():
                new[w] = self.units.young[w]
        todo = [w for w, ids in new.items() if ids is None]
        new.update(zip(todo, self.table.merge([w.encode() for w in todo]), strict=True))
        for i, (unit, found) in enumerate(zip(missing, out, strict=True)):
            if found is None:
                out[i] = new[unit] if i not in parts else b"".join([new.get(w) or first(w) for w in parts[i]])
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text: its pieces, one after another, gathered for all texts at once."""
        flat = np.frombuffer(b"".join(ids), np.uint32)
        sizes = self.piece_sizes[flat]
        ends = np.cumsum(sizes)
        if not len(flat):
            return [b""] * len(ids)
        whole = self.piece_bytes[np.repeat(self.piece_starts[flat] - (ends - sizes), sizes) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])].tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def first_tier(docs: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str, most: int) -> dict[str, bytes]:
    """Packed ids of the words of the corpus's ``most`` frequent units, merged by ``merge_words``."""
    import regex

    find = regex.compile(pattern).findall
    words = list(dict.fromkeys(w for unit, _ in frequent(docs, text_col, most, most // 4) for w in find(unit)))
    if not words:
        return {}
    spark = docs.sparkSession
    frame = spark.createDataFrame([(w,) for w in words], "unit string").repartition(max(1, min(64, len(words) // 500)))
    return {r[0]: array("I", r[1]).tobytes() for r in merge_words(frame, ranks).select("unit", "ids").collect()}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, tier_one: int = 65_536, cache: int = 100_000, keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, the columns in ``keep``, and of ``outputs`` the chosen:
    ids binary (little-endian 32-bit ids), decoded binary, n_tokens long, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids; rows that repeat are returned each. The words of a text are the matches of ``pattern``, which must cover
    any text and treat runs of white space and what follows them alone (as the patterns of byte-level BPE do).
    """
    spark = docs.sparkSession
    no_clash((id_col, *keep), outputs)
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        data = f.read()
    words = first_tier(docs, text_col, read_ranks(data), pattern, tier_one)
    shared = spark.sparkContext.broadcast((data, words, pattern))
    forms = {"ids": "binary", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches):
        own = held("bytes", shared.value, lambda v: Encoder(read_ranks(v[0]), v[1], v[2], cache))
        for whole in batches:
            at = whole.schema.get_field_index("__text")
            for batch in slices(whole, at):
                got: dict[str, list] = {k: [] for k in outputs}
                coded = own.encode(batch.column(at).to_pylist())
                texts = own.decode(coded) if "decoded" in got or "decoded_sha256" in got else [b""] * len(coded)
                for ids, decoded in zip(coded, texts, strict=True):
                    row = {"ids": ids, "decoded": decoded, "n_tokens": len(ids) // 4}
                    for k in got:
                        got[k].append(hashlib.sha256(row[k[:-7]]).hexdigest() if k.endswith("_sha256") else row[k])
                kept = [i for i in range(batch.num_columns) if i != at]
                kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(got[k], kinds[forms[k]]) for k in outputs]], [*[batch.schema.names[i] for i in kept], *outputs])

    base = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], F.col(text_col).alias("__text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__text"], *[f"{k} {forms[k]}" for k in outputs]])
    return base.mapInArrow(run, schema)
