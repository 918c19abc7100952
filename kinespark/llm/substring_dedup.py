"""Substring dedup: passages of ``window`` words that occur in an earlier document are removed.

Method: suffix trees, partitioned by prefixes, over the suffixes that can start a run of ``window`` words that
another document holds.
1. Each window of a document is filed under a prefix: the run of ``prefix`` words of smallest hash inside it, the
   leftmost if it repeats (equal windows are filed under equal prefixes at equal places). Adjacent windows mostly have
   theirs in common; the words from the first of such windows to the end of the last are one context.
2. Counts of documents for each prefix decide how it goes on. Prefixes of one document are dropped with their whole
   subtree. Prefixes of at most ``group_size`` documents (one that repeats a prefix counts for several) are dealt to groups
   that fit in memory, with their contexts.
   Longer prefixes split the others: a window is the longest that its own words determine, so these are filed under
   whole windows, each of which is a single node that needs no tree, only its smallest document (aggregated
   before and after the shuffle).
3. A group builds the subtree of its contexts' suffixes level by level, down to depth ``window``: nodes of depth 2 k are
   pairs of nodes of depth k. Words are compared as words, not by hash. Internal nodes at that depth with two
   documents are the repeats, the smallest document keeps them; adjacent ones unite to maximal repeats.
Documents of equal word sequences are settled beforehand by digest, so groups of exact copies never reach a tree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ascii_words, mix64, no_clash, seed64, shuffle_parts, small_batches, tidy, tidy_group, word_hashes, write_shared
from .units import slices

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[:1] = 1
    done = 1
    while done < n:  # doubling: out[done + i] = out[i] * base ** done
        step = U64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * step
        done += more
    return out


def rolling(h: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hashes of all runs of that many entries, from prefix sums of a polynomial."""
    n = len(h)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(h + seed64(11)) * _powers(_BASE, n), dtype=U64)])
        back = _powers(_INVERSE, n)
        return [mix64((sums[size:] - sums[:-size]) * back[: n - size + 1]) if n >= size else np.empty(0, U64) for size in sizes]


def window_prefixes(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the prefix each window is filed under, place of that prefix), by the window's start."""
    if len(h) < window:
        return np.empty(0, U64), np.empty(0, np.int64)
    (small,) = rolling(h, (prefix,))
    span = window - prefix + 1
    count = len(h) - window + 1
    at = np.empty(count, np.int64)
    for start in range(0, count, 65_536):
        end = min(count, start + 65_536)
        at[start:end] = np.lib.stride_tricks.sliding_window_view(small[start : end + span - 1], span).argmin(axis=1) + np.arange(start, end)
    return small[at], at


#: Contexts of a prefix in one document that count as much as another document with it.
CONTEXTS = 16


def weighted_prefixes(h: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The prefixes of a document, each once and once more for every CONTEXTS contexts, so that counts of them bound what a
    group holds."""
    under, at = window_prefixes(h, window, prefix)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    keys, n = np.unique(under[first], return_counts=True)
    return np.repeat(keys, 1 + (n - 1) // CONTEXTS)


def contexts(words: list[bytes], window: int, prefix: int, wanted: np.ndarray) -> dict[tuple[int, bytes], list[int]]:
    """(prefix, text of a context) -> places where it starts, of the windows filed under ``wanted`` prefixes."""
    under, at = window_prefixes(word_hashes(words), window, prefix)
    out: dict[tuple[int, bytes], list[int]] = {}
    if not len(under):
        return out
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    use = np.isin(under[first], wanted)
    for key, a, b in zip(under[first][use].astype(np.int64).tolist(), first[use].tolist(), last[use].tolist(), strict=True):
        out.setdefault((key, b" ".join(words[a : b + window])), []).append(a)
    return out


def _describe(window: int, prefix: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n, d1, d2, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = ascii_words(text)
                h = word_hashes(words)
                n.append(len(words))
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                lists.append(weighted_prefixes(h, window, prefix).astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n", "d1", "d2", "prefixes"])

    return run


def _prefixes(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.int64).astype(U64) if column.is_valid else np.empty(0, U64)


def _send_contexts(window: int, prefix: int, groups: int):
    """Rows (group, id, starts, text): each distinct context of a document once, with the places where it starts."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                group, ids, starts, texts = [], [], [], []
                for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    for (key, body), places in contexts(ascii_words(text), window, prefix, _prefixes(wanted)).items():
                        group.append(key % groups)
                        ids.append(doc)
                        starts.append(places)
                        texts.append(body.decode())
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["group", "id", "starts", "text"])

    return run


def deep_nodes(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, node) of each suffix of at least ``window`` words of the contexts ``texts``, in order: its node at depth
    ``window`` of their suffix tree. Level by level: a node of depth 2 k is the pair of the nodes of depth k on its path."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    node = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    depth = 1
    pair = lambda x, y: pd.factorize(x * (int(y.max()) + 1) + y)[0].astype(np.int64)
    while 2 * depth <= window:
        node = pair(node[:-depth], node[depth:])
        depth *= 2
    count = np.diff(offsets) - window + 1
    context = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    return context, pair(node[start], node[start + window - depth])


def _subtree(window: int):
    """Of a group's contexts: the windows' starts whose node has a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        context, node = deep_nodes(table["text"].chunk(0), window)
        of = ids[context]
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, of)
        gone = np.flatnonzero(least[node] < of)
        begin = np.searchsorted(context, np.arange(len(ids)))
        out_ids, out = [], []
        which, first = np.unique(context[gone], return_index=True)
        places = table["starts"].chunk(0)
        for k, part in zip(which.tolist(), np.split(gone, first)[1:], strict=True):
            starts = places[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
            out_ids.append(int(ids[k]))
            out.append((starts[:, None] + (part - begin[k])[None, :]).ravel().astype(np.int32))
        return pa.table({"id": pa.array(out_ids, pa.int64()), "starts": pa.array(out, pa.list_(pa.int32()))})

    return run


def _whole_windows(window: int, prefix: int):
    """Rows (d1, d2, id, starts): the digest of each distinct window of a document that is filed under one of its ``wanted``
    prefixes."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            digests, ids, starts = [], [], []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = ascii_words(text)
                under, _ = window_prefixes(word_hashes(words), window, prefix)
                found: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(np.isin(under, _prefixes(wanted))).tolist():
                    found.setdefault(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest(), []).append(i)
                digests += found
                ids += [doc] * len(found)
                starts += found.values()
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["d1", "d2", "id", "starts"])

    return run


def kept_words(words: list, starts, window: int) -> list:
    """``words`` without those that a window at one of ``starts`` covers."""
    if not len(words) or starts is None or not len(starts):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, len(words)), -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, prefix: int = 8, group_size: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, the columns in ``keep``, n_words, n_removed, kept_text (kept
    words joined by one space; null where the text is null).

    A word goes if a window of ``window`` consecutive words of its document covers it and that word sequence
    also starts in a document with a smaller id. Windows are judged on the input. Words are runs of characters
    other than space and U+0009 to U+000D, unchanged. Null and empty texts have no words. A null id is smaller
    and larger than none. Rows that repeat an id are one document's: they don't remove from each other.
    """
    no_clash((id_col, *keep), ("n_words", "n_removed", "kept_text"))
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    told = write_shared(base.mapInArrow(tidy(_describe(window, prefix)), "id long, n long, d1 long, d2 long, prefixes array<long>"), "prefixes")
    long_ones = told.df.where((F.col("n") >= window) & F.col("id").isNotNull())
    first = write_shared(long_ones.groupBy("d1", "d2", "n").agg(F.min("id").alias("first")), "first")
    copies = long_ones.select("id", "d1", "d2", "n").join(first.df.hint("merge"), ["d1", "d2", "n"]).where("id > first").select("id", F.lit(True).alias("copy"), "d1", "d2")
    heads = long_ones.join(first.df.select("d1", "d2", "n", F.col("first").alias("id")).hint("merge"), ["id", "d1", "d2", "n"], "left_semi")
    entries = heads.select("id", F.explode("prefixes").alias("prefix"))
    counted = entries.groupBy("prefix").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("docs"))
    shared = write_shared(counted.where("lo < hi").select("prefix", "docs"), "shared")
    n_small, n_hot = shared.df.agg(F.sum(F.when(F.col("docs") <= group_size, F.col("docs"))), F.count(F.when(F.col("docs") > group_size, 1))).first()
    mine = entries.join(shared.df.hint("merge"), "prefix")
    lists = write_shared(mine.groupBy("id").agg(*[F.collect_set(F.when(x, F.col("prefix"))).alias(name) for name, x in (("small", F.col("docs") <= group_size), ("hot", F.col("docs") > group_size))]), "lists")
    texts = base.where("id is not null").hint("merge").join(lists.df.hint("merge"), "id")
    groups = max(shuffle_parts(docs.sparkSession), -(-(n_small or 0) // (4 * group_size)))
    sent = texts.where("size(small) > 0").select("id", "text", "small").mapInArrow(tidy(_send_contexts(window, prefix, groups)), "group long, id long, starts array<int>, text string")
    repeats = sent.groupBy("group").applyInArrow(tidy_group(_subtree(window)), "id long, starts array<int>")
    if n_hot:
        made = texts.where("size(hot) > 0").select("id", "text", "hot").mapInArrow(tidy(_whole_windows(window, prefix)), "d1 long, d2 long, id long, starts array<int>")
        nodes = write_shared(made, "nodes")
        least = write_shared(nodes.df.groupBy("d1", "d2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi"), "least")
        repeats = repeats.unionByName(nodes.df.join(least.df.hint("merge"), ["d1", "d2"]).where("lo < id").select("id", "starts"))
    removed = repeats.groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    gone = write_shared(removed, "removed")
    if n_hot:
        nodes.drop()
        least.drop()
    shared.drop()
    copied = write_shared(copies.groupBy("id").agg(F.collect_set(F.struct("d1", "d2")).alias("copies")), "copied")
    for table in (lists, first, told):
        table.drop()
    # one row for each id that loses something; a repeated id may hold a copy and another text, told apart by digest
    lost = write_shared(gone.df.join(copied.df, "id", "full"), "lost")
    gone.drop()
    copied.drop()
    rest = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__k_{c}") for c in keep if c != id_col], F.col(text_col).alias("__text"))
    joined = rest.hint("merge").join(lost.df.hint("merge"), F.col("__id").cast("long") == F.col("id"), "left").drop("id")
    own = [f for f in joined.schema if f.name == "__id" or f.name.startswith("__k_")]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("__text")):
                col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                n, gone_, kept = [], [], []
                for text, starts, same in zip(col["__text"].to_pylist(), col["starts"], col["copies"].to_pylist(), strict=True):
                    words = ascii_words(text)
                    left = words
                    if same is not None and len(words) >= window:
                        digest = hashlib.blake2b(word_hashes(words).tobytes(), digest_size=16).digest()
                        pair = {"d1": int.from_bytes(digest[:8], "little", signed=True), "d2": int.from_bytes(digest[8:], "little", signed=True)}
                        left = [] if pair in same else words
                    if left and starts.is_valid:
                        found = starts.values.to_numpy(zero_copy_only=False)
                        found = found[found + window <= len(words)]
                        left = kept_words(left, found, window)
                    n.append(len(words))
                    gone_.append(len(words) - len(left))
                    kept.append(None if text is None else b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([*[col[f.name] for f in own], pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array(kept, pa.string())], [*[f.name for f in own], "n_words", "n_removed", "kept_text"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], "n_words long, n_removed long, kept_text string"])
    out = joined.mapInArrow(tidy(run), schema)
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__k_{c}").alias(c) for c in keep if c != id_col], "n_words", "n_removed", "kept_text")
