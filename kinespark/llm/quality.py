"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

Words are those between ASCII white space, each known by 48 bits of its hash; no vocabulary is fixed or capped, and
every count is exact. Bigram counts are sharded by the hash of the bigram, so that no word, however common, gathers in
one task; sums over contexts and continuations are aggregated by word, before and after the shuffle. With

    log p(w | v) = log q(w) + log g(v) + log(1 + d(v, w) / (g(v) q(w)))

(g: interpolation weight of the context, q: continuation probability, d: discounted relative count) a document's log
probability is a constant for each word plus a sum of values looked up by key: one for each word (log q and log g, over
those of an unknown word) and one for each bigram (the last term); keys that the model lacks count 0. A text ends with
a word of its own, which it has for every text.

Lookups have two tiers. Broadcast, of a fixed number of entries: the most frequent words and bigrams of the trusted
text, and what is most frequent in the documents (so no common key is sent for). All other keys of a block of
documents are sent to their shard, packed, with the number of their document, in ROUNDS rounds over the shards (which
halves what is on disk at a time); the shard's values come back summed by document. A shard knows a key by 40 bits, so
one key in some millions that the model lacks is taken for one that it has.

A document's score is its negative log likelihood per word, shrunk towards its language's mean as if it had
``prior_words`` more average words (else texts of a few words would be judged by chance). The threshold of
a language is a quantile of the scores of trusted documents that were held out of the counts, plus ``margin``
standard errors of that quantile (for normal scores of the same spread). It vanishes as held-out documents grow
in number, and keeps clean documents where a handful of them can't show the quantile.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, SharedTable, ascii_words, mix64, seed64, semi_join, shuffle_parts, shuffles, small_batches, tidy, tidy_group, trim, word_hashes, write_shared
from .units import slices

#: Bytes of a word's hash, and of a key within its shard.
WORD_BYTES, KEY_BYTES = 6, 5
_WORD, _KEY = U64((1 << 8 * WORD_BYTES) - 1), U64((1 << 8 * KEY_BYTES) - 1)
#: The context of a text's first word, and the word after its last.
BOS, EOS = U64(0), U64(1)
#: Entries of the broadcast tier: words and bigrams of the trusted text, and keys that are frequent in what is scored.
MOST_WORDS, MOST_BIGRAMS, MOST_HEAVY = 400_000, 400_000, 65_536
#: Bigrams that a task counts before it sends them on.
CHUNK = 1_000_000
ROUNDS = 2


def packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(column, width: int) -> np.ndarray:
    """The values of all rows of a binary column."""
    narrow = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :width] = narrow
    return wide.view("<u8").ravel().astype(U64)


def floats(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(np.float64)


def word_keys(ids: np.ndarray) -> np.ndarray:
    return mix64(ids ^ seed64(22))


def bigram_keys(previous: np.ndarray, ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(previous + seed64(21)) + ids)


def bigrams_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, text of each bigram, words of each text) of the texts that have words, from BOS to EOS."""
    words = [ascii_words(t) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    sizes = n + (n > 0)
    ends = np.cumsum(sizes)
    w = np.full(int(sizes.sum()), EOS, U64)
    last = np.zeros(len(w), bool)
    last[ends[n > 0] - 1] = True
    w[~last] = word_hashes(list(chain.from_iterable(words))) & _WORD
    v = np.concatenate([np.array([BOS], U64), w[:-1]])[: len(w)]
    v[(ends - sizes)[n > 0]] = BOS
    return v, w, np.repeat(np.arange(len(words)), sizes), n


def document_keys(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the texts' log probabilities, the text of each, words of each text)."""
    v, w, of, n = bigrams_of(texts)
    some = np.flatnonzero(n)
    start = word_keys(np.full(len(some), BOS, U64))
    return np.concatenate([start, word_keys(w), bigram_keys(v, w)]), np.concatenate([some, of, of]), n


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(24)) % U64(shards)).astype(np.int64)


def _word_shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return _shard(mix64(ids ^ seed64(23)), shards)


def _dealt(shard: np.ndarray, shards: int, *columns: np.ndarray) -> list[list[np.ndarray]]:
    """Each column split by shard."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))[:-1]
    return [np.split(c[order], ends) for c in columns]


def _rows(shard: np.ndarray, shards: int, names: list[str], *columns: tuple) -> pa.RecordBatch:
    """A row (shard, packed columns) for each shard that has any; ``columns``: (values, function that packs them)."""
    dealt = _dealt(shard, shards, *[c for c, _ in columns])
    some = [s for s in range(shards) if len(dealt[0][s])]
    data = [pa.array([pack(d[s]) for s in some], pa.binary()) for d, (_, pack) in zip(dealt, columns, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *data], ["shard", *names])


_word = lambda x: packed(x, WORD_BYTES)
_key = lambda x: packed(x, KEY_BYTES)
_count = lambda x: x.astype(np.uint32).tobytes()
_float = lambda x: x.astype(np.float32).tobytes()


def _texts(batches, column: int):
    for whole in batches:
        yield from slices(whole, column)


# ---- counts of the trusted text ----
def count_bigrams(docs: DataFrame, shards: int) -> SharedTable:
    """(shard, v, w, c, n1..n4): for each shard its distinct bigrams by key, packed, with their counts, and how many have
    count 1 to 4. ``docs``: column text."""

    def gather(batches):
        keep: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            v, w = (np.concatenate(x) for x in zip(*keep, strict=True))
            keys, first, c = np.unique(bigram_keys(v, w), return_index=True, return_counts=True)
            return _rows(_shard(keys, shards), shards, ["v", "w", "c"], (v[first], _word), (w[first], _word), (c, _count))

        for batch in _texts(batches, 0):
            v, w, _, _ = bigrams_of(batch.column(0).to_pylist())
            keep.append((v, w))
            size += len(w)
            if size > CHUNK:
                yield out()
                keep, size = [], 0
        if size:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        v, w = unpacked(table["v"], WORD_BYTES), unpacked(table["w"], WORD_BYTES)
        c = np.frombuffer(b"".join(table["c"].to_pylist()), np.uint32)
        _, first, where = np.unique(bigram_keys(v, w), return_index=True, return_inverse=True)
        total = np.bincount(where, weights=c)
        return pa.table({"shard": table["shard"][:1], "v": [_word(v[first])], "w": [_word(w[first])], "c": [_count(total)], **{f"n{k}": [int((total == k).sum())] for k in (1, 2, 3, 4)}})

    schema = "shard int, v binary, w binary, c binary"
    sent = docs.select("text").mapInArrow(tidy(gather), schema)
    return write_shared(sent.groupBy("shard").applyInArrow(tidy_group(merge), f"{schema}, n1 long, n2 long, n3 long, n4 long"), "bigrams")


def _each(batches):
    """(row as a batch, v, w, c) of the rows of ``count_bigrams``."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, unpacked(row["v"], WORD_BYTES), unpacked(row["w"], WORD_BYTES), np.frombuffer(row["c"][0].as_buffer(), np.uint32).astype(np.int64)


#: What is known of a word: occurrences as a context, distinct bigrams of count 1, 2 and more as a context, distinct contexts.
STATS = ("c", "n1", "n2", "n3", "cont")


def count_words(bigrams: DataFrame, shards: int) -> SharedTable:
    """(shard, word, the STATS, k1..k4, k3up, kinds, total): for each shard its distinct words, packed, with their counts, and
    how many have 1 to 4 and 3 or more contexts, how many have any, and the sum."""

    def run(batches):
        for _, v, w, c in _each(batches):
            words, where = np.unique(np.concatenate([v, w]), return_inverse=True)
            at_v, at_w = where[: len(v)], where[len(v) :]
            sums = [np.bincount(at_v, weights=x, minlength=len(words)) for x in (c, c == 1, c == 2, c >= 3)]
            sums.append(np.bincount(at_w, minlength=len(words)))
            yield _rows(_word_shard(words, shards), shards, ["word", *STATS], (words, _word), *[(x, _count) for x in sums])

    def merge(table: pa.Table) -> pa.Table:
        words, where = np.unique(unpacked(table["word"], WORD_BYTES), return_inverse=True)
        sums = {k: np.bincount(where, weights=np.frombuffer(b"".join(table[k].to_pylist()), np.uint32), minlength=len(words)) for k in STATS}
        cont = sums["cont"]
        tails = {**{f"k{k}": [int((cont == k).sum())] for k in (1, 2, 3, 4)}, "k3up": [int((cont >= 3).sum())], "kinds": [int((cont > 0).sum())], "total": [int(cont.sum())]}
        return pa.table({"shard": table["shard"][:1], "word": [_word(words)], **{k: [_count(x)] for k, x in sums.items()}, **tails})

    schema = "shard int, word binary, " + ", ".join(f"{k} binary" for k in STATS)
    sent = bigrams.select("v", "w", "c").mapInArrow(tidy(run), schema)
    return write_shared(sent.groupBy("shard").applyInArrow(tidy_group(merge), schema + ", k1 long, k2 long, k3 long, k4 long, k3up long, kinds long, total long"), "words")


def _discounts(n) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of things with count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(float(x or 0), 0.0) for x in n)
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    out = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *[min(max(d, 0.05), k - 0.05) for k, d in enumerate(out[1:], 1)]])


class Smoothing:
    """The numbers that turn counts into probabilities."""

    def __init__(self, bigrams: DataFrame, words: DataFrame):
        self.discounts = _discounts(bigrams.agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first())
        k1, k2, k3, k4, k3up, kinds, total = (float(x or 0) for x in words.agg(*[F.sum(k) for k in ("k1", "k2", "k3", "k4", "k3up", "kinds", "total")]).first())
        self.low = _discounts((k1, k2, k3, k4))
        self.total = max(total, 1.0)
        taken = self.low[1] * k1 + self.low[2] * k2 + self.low[3] * k3up
        #: Continuation probability of an unknown word: what discounting left, over all words and one for the unknown.
        self.unknown = (taken / self.total if total else 1.0) / (kinds + 1)

    def weight(self, c: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray) -> np.ndarray:
        """Interpolation weight of contexts."""
        d = self.discounts
        return np.where(c > 0, np.maximum((d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(c, 1), 1e-9), 1.0)

    def continuation(self, cont: np.ndarray) -> np.ndarray:
        return np.maximum(cont - self.low[np.minimum(cont, 3)], 0) / self.total + self.unknown

    def relative(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts of bigrams."""
        return np.maximum(c - self.discounts[np.minimum(c, 3)], 0)

    def known(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, c, g, q) of a row (or table) of ``count_words``."""
        stats = [np.frombuffer(b"".join(row[k].to_pylist()), np.uint32).astype(np.int64) for k in STATS]
        return unpacked(row["word"], WORD_BYTES), stats[0], self.weight(*stats[:4]), self.continuation(stats[4])


# ---- values by key ----
class Tier:
    """Values of a bounded number of keys, sorted."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, first = np.unique(keys, return_index=True)
        self.values = values[first]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is here, its place). Asked in the order of the keys, which spares the memory."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        return self.keys[place] == keys, place

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is here, its value or 0)."""
        here, place = self.find(keys)
        return here, np.where(here, self.values[place], 0.0) if len(self.keys) else np.zeros(len(keys))


def _bin(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(c, 1)) * 16).astype(np.int32)


def _least_bin(bins: DataFrame, most: int) -> int:
    """The least bin of counts such that it and those above hold at most ``most``; there are 16 for each doubling.
    ``bins(bin, n)``."""
    total, least = 0, 1 << 30
    for row in sorted(bins.groupBy("bin").agg(F.sum("n").alias("n")).collect(), reverse=True):
        total += row["n"]
        if total > most:
            break
        least = row["bin"]
    return least


def _binned(counts):
    """For mapInArrow: rows (bin, n) of the counts that ``counts(row)`` gives."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bins, n = np.unique(_bin(counts(batch.slice(i, 1))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], ["bin", "n"])

    return run


def _arrow(df: DataFrame, *kinds) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(i).to_numpy().astype(k) for i, k in enumerate(kinds)]


def _integers(row, name: str) -> np.ndarray:
    return np.frombuffer(row[name][0].as_buffer(), np.uint32).astype(np.int64)


class Model:
    """Tables of values by key, in the shared folder, and the broadcast tier. ``docs`` (column text) are what is counted;
    ``scored`` what will be scored: it only decides which keys the broadcast tier holds, never a value."""

    def __init__(self, docs: DataFrame, scored: DataFrame, shards: int):
        spark = docs.sparkSession
        self.shards = shards
        bigrams = count_bigrams(docs, shards)
        words = count_words(bigrams.df, shards)
        s = Smoothing(bigrams.df, words.df)
        self.unknown = s.unknown
        known = _frequent_words(words.df, s)
        frequent = spark.sparkContext.broadcast(known)
        own = bigrams.df.select("shard", "v", "w", "c")
        self.tables = [write_shared(own.mapInArrow(tidy(_both_frequent(s, frequent)), VALUES), "values")]
        keys, values = _arrow(own.mapInArrow(tidy(_top(s, frequent, _least_bin(own.mapInArrow(_binned(lambda row: _integers(row, "c")), "bin int, n long"), MOST_BIGRAMS))), "key long, value double"), np.int64, np.float64)
        self.tables.append(_others(own, words.df, s, frequent, shards))
        words.drop()
        bigrams.drop()
        frequent.destroy()
        ids, _, g, q = known
        tier = [(word_keys(ids), np.log(q / s.unknown) + np.log(g)), (keys.view(U64), values)]
        tier.append(_heavy(scored, self.df, Tier(*map(np.concatenate, zip(*tier, strict=True))), shards))
        self.tier = spark.sparkContext.broadcast(Tier(*map(np.concatenate, zip(*tier, strict=True))))
        del known, ids, g, q, keys, values, tier
        trim()  # the driver's copies

    @property
    def df(self) -> DataFrame:
        return self.tables[0].df.unionByName(self.tables[1].df)

    def drop(self) -> None:
        self.tier.destroy()
        for table in self.tables:
            table.drop()


VALUES = "shard int, keys binary, data binary"


def _values(keys: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    return _rows(_shard(keys, shards), shards, ["keys", "data"], (keys, _key), (values, _float))


def _frequent_words(words: DataFrame, s: Smoothing) -> tuple:
    """(word, c, g, q) of the most frequent words, by word: at most MOST_WORDS."""
    total = lambda row: _integers(row, "c") + _integers(row, "cont")
    own = words.select("word", *STATS)
    least = _least_bin(own.mapInArrow(_binned(total), "bin int, n long"), MOST_WORDS)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                often = _bin(total(row)) >= least
                word, *rest = s.known(row)
                yield pa.RecordBatch.from_arrays([pa.array(word[often].astype(np.int64)), *[pa.array(x[often].astype(np.float64)) for x in rest]], ["word", "c", "g", "q"])

    found = _arrow(own.mapInArrow(tidy(run), "word long, c double, g double, q double"), U64, np.float64, np.float64, np.float64)
    order = np.argsort(found[0])
    return tuple(x[order] for x in found)


def _gains(s: Smoothing, frequent: tuple):
    """For bigrams: (whether v and w are frequent, c(v) g(v) and q(w) where they are, gain of those with both)."""
    ids, count, g, q = frequent
    tier = Tier(ids, np.arange(len(ids), dtype=np.float64))
    weight, q = (count * g, q) if len(ids) else (np.ones(1), np.ones(1))

    def of(v, w, c):
        (in_v, at_v), (in_w, at_w) = tier.find(v), tier.find(w)
        cg, qw, both = weight[at_v], q[at_w], in_v & in_w
        return in_v, in_w, cg, qw, both, np.log1p(s.relative(c[both]) / (cg[both] * qw[both]))

    return of


def _both_frequent(s: Smoothing, frequent):
    """Values of the bigrams of two frequent words: they are in their shard already."""

    def run(batches):
        gains = _gains(s, frequent.value)
        for row, v, w, c in _each(batches):
            *_, both, gain = gains(v, w, c)
            yield pa.RecordBatch.from_arrays([row["shard"], pa.array([_key(bigram_keys(v[both], w[both]))], pa.binary()), pa.array([_float(gain)], pa.binary())], ["shard", "keys", "data"])

    return run


def _top(s: Smoothing, frequent, least: int):
    def run(batches):
        gains = _gains(s, frequent.value)
        for _, v, w, c in _each(batches):
            often = _bin(c) >= least
            v, w, c = v[often], w[often], c[often]
            *_, both, gain = gains(v, w, c)
            yield pa.RecordBatch.from_arrays([pa.array(bigram_keys(v[both], w[both]).view(np.int64)), pa.array(gain)], ["key", "value"])

    return run


def _others(bigrams: DataFrame, words: DataFrame, s: Smoothing, frequent, shards: int) -> SharedTable:
    """Values of all words, and of the bigrams with a word that is not frequent: these go by way of the shards of such
    words (context first) to learn c(v) g(v) and q(w), then to their own."""
    schema = "shard int, v binary, w binary, x binary"

    def to_context(batches):  # x: the count
        gains = _gains(s, frequent.value)
        for _, v, w, c in _each(batches):
            rare = ~gains(v, w, c)[0]
            yield _rows(_word_shard(v[rare], shards), shards, ["v", "w", "x"], (v[rare], _word), (w[rare], _word), (c[rare], _count))

    def at_context(left: pa.Table, right: pa.Table) -> pa.Table:
        v, w = unpacked(right["v"], WORD_BYTES), unpacked(right["w"], WORD_BYTES)
        c = np.frombuffer(b"".join(right["x"].to_pylist()), np.uint32).astype(np.int64)
        word, count, g, _ = s.known(left)
        x = s.relative(c) / (count * g)[Tier(word, word).find(v)[1]] if len(v) else np.empty(0)
        trim()
        return pa.Table.from_batches([_rows(_word_shard(w, shards), shards, ["v", "w", "x"], (v, _word), (w, _word), (x, _float))])

    def to_word(batches):  # x: the discounted relative count over g(v)
        gains = _gains(s, frequent.value)
        for _, v, w, c in _each(batches):
            in_v, in_w, cg, *_ = gains(v, w, c)
            rare = in_v & ~in_w
            v, w, x = v[rare], w[rare], s.relative(c[rare]) / cg[rare]
            yield _rows(_word_shard(w, shards), shards, ["v", "w", "x"], (v, _word), (w, _word), (x, _float))

    def at_word(left: pa.Table, right: pa.Table) -> pa.Table:
        v, w, x = unpacked(right["v"], WORD_BYTES), unpacked(right["w"], WORD_BYTES), floats(right["x"])
        word, _, g, q = s.known(left)
        gain = np.log1p(x / q[Tier(word, word).find(w)[1]]) if len(w) else np.empty(0)
        trim()
        keys = np.concatenate([bigram_keys(v, w), word_keys(word)])
        return pa.Table.from_batches([_values(keys, np.concatenate([gain, np.log(q / s.unknown) + np.log(g)]), shards)])

    def unite(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"][:1], "keys": [b"".join(table["keys"].to_pylist())], "data": [b"".join(table["data"].to_pylist())]})

    own = words.select("shard", "word", *STATS).groupBy("shard")
    half = write_shared(own.cogroup(bigrams.mapInArrow(tidy(to_context), schema).groupBy("shard")).applyInArrow(at_context, schema), "half")
    rows = half.df.unionByName(bigrams.mapInArrow(tidy(to_word), schema))
    made = own.cogroup(rows.groupBy("shard")).applyInArrow(at_word, VALUES)
    out = write_shared(made.groupBy("shard").applyInArrow(tidy_group(unite), VALUES), "values")
    half.drop()
    return out


def _heavy(scored: DataFrame, values: DataFrame, tier: Tier, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that are frequent in a batch of the scored texts but not in the tier, and their values: such keys, met a
    great many times, would gather in one shard."""
    spark = scored.sparkSession
    small = spark.sparkContext.broadcast(tier)

    def count(batches):
        for batch in _texts(batches, 0):
            flat = document_keys(batch.column(0).to_pylist())[0]
            unique, n = np.unique(flat, return_counts=True)
            often = n >= max(64, len(flat) // 4000)
            unique, n = unique[often], n[often]
            new = ~small.value.look_up(unique)[0]
            yield pa.RecordBatch.from_arrays([pa.array(unique[new].view(np.int64)), pa.array(n[new])], ["key", "n"])

    counted = write_shared(scored.select("text").mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "heavy")
    at = F.floor(F.log2("n") * 16).cast("int")
    least = _least_bin(counted.df.select(at.alias("bin"), F.lit(1).alias("n")), MOST_HEAVY)
    (keys,) = _arrow(counted.df.where(at >= least).select("key"), np.int64)
    counted.drop()
    small.destroy()
    keys = np.sort(keys.view(U64))
    if not len(keys):
        return keys, np.empty(0)
    wanted = spark.sparkContext.broadcast(keys)

    def find(batches):
        shard = _shard(wanted.value, shards)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                mine = wanted.value[shard == row["shard"][0].as_py()]
                _, a, b = np.intersect1d(mine & _KEY, unpacked(row["keys"], KEY_BYTES), return_indices=True)
                yield pa.RecordBatch.from_arrays([pa.array(mine[a].view(np.int64)), pa.array(floats(row["data"])[b])], ["key", "value"])

    found, value = _arrow(values.mapInArrow(tidy(find), "key long, value double"), np.int64, np.float64)
    wanted.destroy()
    out = np.zeros(len(keys))
    out[np.searchsorted(keys, found.view(U64))] = value
    return keys, out


def score(docs: DataFrame, model: Model) -> SharedTable:
    """(id, lang, n, nll) for each row of ``docs(id, lang, text)``: words and negative log likelihood. ``docs`` is read once a
    round, in the same order."""
    kind = dict(docs.dtypes)["id"]
    shards, tier, log_unknown = model.shards, model.tier, math.log(model.unknown)

    def ask(turn: int):
        """Rows of the shards of one turn; the first also sends each block's own columns to one of its shards."""

        def run(batches):
            first = tier.value
            at = TaskContext.get().partitionId() << 24
            for batch in _texts(batches, 2):
                flat, of, n = document_keys(batch.column(2).to_pylist())
                m = len(n)
                here, values = first.look_up(flat)
                shard = _shard(flat, shards)
                send = ~here & (shard % ROUNDS == turn)
                sent, docs_ = _dealt(shard[send], shards, flat[send], of[send].astype(np.uint16))
                home = at * ROUNDS % shards
                use = [s for s in range(shards) if len(sent[s]) or (turn == 0 and s == home)]
                own = [None] * 4
                if turn == 0:
                    base = (n + (n > 0)) * log_unknown + np.bincount(of, weights=values, minlength=m)
                    own = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), n.tolist(), base.tolist()]
                only = lambda x: [x if s == home else None for s in use]
                kinds = [pa.list_(x) for x in (batch.column(0).type, pa.string(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(use, pa.int32()), *[pa.array([x] * len(use), pa.int64()) for x in (at, m, zlib.crc32(n.tobytes()))], pa.array([_key(sent[s]) for s in use], pa.binary()), pa.array([docs_[s].tobytes() for s in use], pa.binary()), *[pa.array(only(x), k) for x, k in zip(own, kinds, strict=True)]],
                    ["shard", "block", "docs", "sign", "keys", "of", "ids", "langs", "ns", "base"],
                )
                at += 1

        return run

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Tier(unpacked(left["keys"], KEY_BYTES), floats(left["data"]))
        sums = []
        for i in range(right.num_rows):
            row = right.slice(i, 1)
            of = np.frombuffer(row["of"][0].as_buffer(), np.uint16)
            here, found = own.look_up(unpacked(row["keys"], KEY_BYTES))
            total = np.bincount(of[here], weights=found[here], minlength=row["docs"][0].as_py())
            some = np.flatnonzero(total)
            sums.append(some.astype(np.uint16).tobytes() + _float(total[some]))
        trim()
        return pa.table({"block": right["block"], "sign": right["sign"], "ids": right["ids"], "langs": right["langs"], "ns": right["ns"], "base": right["base"], "sums": pa.array(sums, pa.binary())})

    def unite(table: pa.Table) -> pa.Table:
        if len(set(table["sign"].to_pylist())) > 1:
            raise ValueError("the documents came in another order when they were read again")
        home = next(i for i, x in enumerate(table["ns"]) if x.is_valid)
        total = np.array(table["base"][home].as_py(), np.float64)
        for part in sorted(table["sums"].to_pylist()):  # in a set order, for equal sums on every run
            m = len(part) // 6
            total[np.frombuffer(part, np.uint16, m)] += np.frombuffer(part, np.float32, m, 2 * m)
        column = lambda name: table[name][home].values
        return pa.table({"id": column("ids"), "lang": column("langs"), "n": column("ns"), "nll": pa.array(-total)})

    lists = f"ids array<{kind}>, langs array<string>, ns array<long>, base array<double>"
    told, turns = None, []
    for turn in range(ROUNDS):
        asked = docs.select("id", "lang", "text").mapInArrow(tidy(ask(turn)), f"shard int, block long, docs long, sign long, keys binary, of binary, {lists}")
        own = model.df.where(F.col("shard") % ROUNDS == turn)
        turns.append(write_shared(own.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, f"block long, sign long, {lists}, sums binary").where("block is not null"), "answers"))
        told = turns[-1].df if told is None else told.unionByName(turns[-1].df)
    out = write_shared(told.groupBy("block").applyInArrow(unite, f"id {kind}, lang string, n long, nll double"), "scores")
    for table in turns:
        table.drop()
    return out


def standard_error(quantile: float, sd: float, n: int) -> float:
    """Of the quantile of ``n`` normal values with standard deviation ``sd``, estimated as mean + z sd."""
    z = NormalDist().inv_cdf(quantile)
    return sd * math.sqrt((1 + z * z / 2) / n)


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, quantile: float = 0.995, margin: float = 1.0, prior_words: int = 20, hold_out: int = 10) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, lang, n_words, perplexity (null without words), score,
    threshold and keep. ``trusted_ids``: column ``id_col`` of the documents that the model learns from.

    Of the trusted documents, one in ``hold_out`` (by hash of the id) is kept out of the counts and gives the
    languages' thresholds; a language without held-out documents takes the threshold of all, and without
    any, every document is kept. Null and empty texts have no words and are kept: there is nothing to judge.
    Rows that repeat an id are scored each; a null id is never trusted; a null lang is a language of its own.
    An empty table gives no rows. Of more than MAX_LANGUAGES languages, those with the fewest held-out documents
    take the threshold of all.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    ids = trusted_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    trusted = semi_join(base, ids, "id")
    held = F.pmod(F.xxhash64("id"), F.lit(hold_out)) == 0
    model = Model(trusted.where(~held), base, max(8, shuffle_parts(docs.sparkSession)))
    fixed = write_shared(base, "texts") if shuffles(base) else None  # what a shuffle gives may come in another order
    scored = score(fixed.df if fixed else base, model)
    model.drop()
    if fixed:
        fixed.drop()
    s = scored.df
    calibrate = semi_join(s, ids, "id").where(held & (F.col("n") > 0))
    means = calibrate.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("docs"))
    overall = calibrate.agg((F.sum("nll") / F.sum("n")).alias("mean_all"))
    means_all = overall.collect()[0][0]
    shrunk = (F.col("nll") + prior_words * F.coalesce("mean", F.lit(means_all))) / (F.col("n") + prior_words)
    with_score = lambda df: df.join(F.broadcast(languages), df["lang"].eqNullSafe(languages["l"]), "left").drop("l").withColumn("score", shrunk)
    # as many rows as there are languages; past the bound the rarest fall back to the threshold of all
    most_frequent = lambda df: df.orderBy(F.desc("docs"), "lang").limit(MAX_LANGUAGES).drop("docs").collect()
    languages = docs.sparkSession.createDataFrame(most_frequent(means), "l string, mean double")
    scores = with_score(calibrate)
    sample = (F.percentile_approx("score", F.lit(quantile), F.lit(10_000)), F.stddev_samp("score"), F.count("score"))
    per = most_frequent(scores.groupBy("lang").agg(*sample, F.count(F.lit(1)).alias("docs")))
    at, spread, n = scores.agg(*sample).collect()[0]
    limit = lambda at, sd, n: at + margin * standard_error(quantile, (sd if sd is not None else spread) or 0.0, n)
    every = None if at is None else limit(at, spread, n)
    limits = docs.sparkSession.createDataFrame([(lang, limit(*x)) for lang, *x in per], "l string, threshold double")
    out = with_score(s)
    out = out.join(F.broadcast(limits), out["lang"].eqNullSafe(limits["l"]), "left").drop("l").withColumn("threshold", F.coalesce("threshold", F.lit(every).cast("double")))
    return out.select(
        F.col("id").alias(id_col),
        "lang",
        F.col("n").alias("n_words"),
        F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"),
        "score",
        "threshold",
        ((F.col("n") == 0) | F.col("threshold").isNull() | (F.col("score") <= F.col("threshold"))).alias("keep"),
    )


#: Languages with thresholds of their own (their rows are collected).
MAX_LANGUAGES = 10_000
