"""N-gram Jaccard self-join with connected components.

Method: universe-partition pigeonhole. Token sets are put in size bands; in a band the
universe of shingles is hashed into m segments, and segment i gets a threshold v_i of 0 or 1.
Two sets of Jaccard similarity >= t differ in at most H shingles (H known from the band). With
sum(v_i + 1) = H + 1 + s, some segments whose v_i + 1 add up to s + 1 or more differ in at most
v_i shingles. Each set indexes the digest of its subset in every segment, and for v_i = 1 the
one-deletion neighbourhood too, for its own band and for the band below (where it is the larger
partner).

Cost-based allocation: ``band_plan`` chooses how many segments get v = 1 by weighing index keys
against weak keys (subsets of at most one shingle, where unlike sets meet). Empty subsets are the
dearest keys and are never indexed; the slack s pays for them. Two similar sets miss each other only
if both lose more than s this way, so such a set goes on to a second, independent partition, then to
a third, and so on; sets that lose too much in all of LEVELS meet on their first H + 1 shingles by hash, one key
each: sets that differ in at most H shingles share one of these.

Candidates are verified exactly on whole shingle sets (64-bit shingle hashes). Sets that are
equal collapse to one class first. A round verifies each member of a bucket against one pivot (the
member that shares most buckets) and contracts links to components; then members of different
components are compared. Both joins carry an exact filter in their condition, so that pairs which
can't link are never emitted: sizes, and parities of hashed bits, of which two sets differ in
no more places than they differ in shingles. 256 bits tell small sets apart; larger ones bring as many as a
fraction of their size for the second join (``wide_bits``), or their unlike pairs would grow with the square of a bucket.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, SharedTable, lowered_words, mix64, ngram_hashes, seed64, semi_join, shuffle_parts, small_batches, tidy, tidy_group, word_hashes, write_shared
from .units import slices


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle, none makes none."""
    if not words:
        return np.empty(0, U64)
    h = word_hashes(words)
    return np.unique(ngram_hashes(h, min(k, len(h))) if len(h) >= k else ngram_hashes(h, len(h)) ^ seed64(len(h), k))


@lru_cache(maxsize=None)
def band_edges(num: int, den: int) -> tuple[int, ...]:
    """First sizes of the bands: a band of first size L ends at floor(L / t), t = num / den."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * den // num + 1)
    return tuple(edges)


#: What a weak key (a subset of at most one shingle) costs, in index keys: its bucket holds unlike sets, which the
#: filter inside the joins turns away. Bits of a key: two subsets that share one by chance cost a look as well.
WEAK_KEY_COST, KEY_BITS = 4, 40
#: Partitions that a set tries.
LEVELS = 6


def _slack(need: int, q: int, least: int) -> int:
    """Slack that covers what the smallest set of a band is likely to lose: mean and two deviations. More slack means
    more and smaller segments, so the figure is sought in a few steps."""
    slack = 0
    for _ in range(6):
        m = need + slack - q
        z = least / m
        lost = float(np.exp(-z) * (m - q + 2 * q * (1 + z)))
        slack = 0 if lost < 0.05 else int(np.ceil(lost + 2 * np.sqrt(lost)))
    return slack


@lru_cache(maxsize=None)
def band_plan(band: int, num: int, den: int) -> tuple[int, int, int, int, int]:
    """(m segments, the first q of them with threshold 1, slack s; m and s of further partitions) of a band."""
    edges = band_edges(num, den)
    least, upper = edges[band], edges[band + 1] - 1
    need = _need(band, num, den)
    options = []
    for part in (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1):
        q = int(part * need / 2)
        slack = _slack(need, q, least)
        m = need + slack - q
        z = upper / m
        weak = m * np.exp(-z) * (1 + z)
        options.append((m + q * z + WEAK_KEY_COST * weak, m, q, slack))
    _, m, q, slack = min(options)
    slack2 = _slack(need, 0, least)
    return m, q, slack, need + slack2, slack2


def _need(band: int, num: int, den: int) -> int:
    """One more than the shingles in which a similar pair whose smaller set is in the band may differ."""
    return (band_edges(num, den)[band + 1] - 1) * (den - num) // num + 1


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of one set of distinct tokens."""
    n = len(tokens)
    if not n:
        return np.empty(0, U64)
    own = int(np.searchsorted(band_edges(num, den), n, "right")) - 1
    out = []
    for band in {own, max(0, own - 1)}:
        m, q, slack, m2, slack2 = band_plan(band, num, den)
        for level in range(LEVELS):
            seg, value, sums, counts = _segment_sums(mix64(tokens ^ seed64(band, level, 1)), m)
            tag = mix64(np.arange(m, dtype=U64) + seed64(band, level, 2))
            full = counts > 0
            out.append(mix64(sums[full] + tag[full]))
            empty = ~full
            loss = int(empty.sum()) + int(empty[:q].sum())
            if q:  # an empty subset is also the neighbour of a subset of one
                with np.errstate(over="ignore"):
                    near = (seg < q) & (counts[seg] > 1)
                    out.append(mix64(sums[seg[near]] - value[near] + tag[seg[near]]))
                loss += 2 * int((counts[:q] == 1).sum())
            if loss <= slack:
                break
            m, q, slack = m2, 0, slack2
        else:
            out.append(np.sort(mix64(tokens ^ seed64(band, 3)))[: _need(band, num, den)])
    return np.unique(np.concatenate(out) >> U64(64 - KEY_BITS))


def _segment_sums(mixed: np.ndarray, m: int):
    """Segment and value of each token; sum of values and count of tokens of each segment."""
    seg = ((mixed >> U64(24)) % U64(m)).astype(np.int64)
    value = mix64(mixed)
    sums = np.zeros(m, U64)
    with np.errstate(over="ignore"):
        np.add.at(sums, seg, value)
    return seg, value, sums, np.bincount(seg, minlength=m)


def parity_bits(tokens: np.ndarray, width: int = 256) -> np.ndarray:
    """``width`` bits (a power of two) as long integers: each token flips one. Sets that differ in d tokens differ in at most
    d bits. The xor of the two halves is what half the width gives."""
    bits = np.bincount((mix64(tokens ^ seed64(98)) & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


#: Most bits that a set brings to the second join, for each of its buckets. More would part still larger sets.
WIDE_MOST = 1024


def wide_bits(n: int, num: int, den: int) -> int:
    """Bits that tell sets of about n tokens apart: over 2.5 times what similar ones may differ in; 0 where 256 do."""
    width = 256
    while width < WIDE_MOST and 2 * width < 5 * (2 * n * (den - num) // (num + den)):
        width *= 2
    return width if width > 256 else 0


def sharp_bits(n: int, num: int, den: int) -> int:
    """Bits that tell sets of about n tokens apart which differ in 1.2 times what similar ones may; for the pairs that are
    about to be verified, once for each set."""
    width = 256
    while width < SHARP_MOST and width < 8 * (2 * n * (den - num) // (num + den)):
        width *= 2
    return width


#: Most of these (8 KB, for sets of 36,000 tokens at 0.8; they part still larger ones less sharply).
SHARP_MOST = 1 << 16


def _packed(keys: np.ndarray) -> bytes:
    """Keys in KEY_BITS / 8 bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, : KEY_BITS // 8] = narrow
    return wide.view("<u8").ravel().astype(np.int64)


def _signature_batches(k: int, num: int, den: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            size, d1, d2, keys, bits, wide = [], [], [], [], [], []
            for text in batch.column(1):
                s = shingles(lowered_words(text.as_py()), k)
                size.append(len(s))
                with np.errstate(over="ignore"):
                    d1.append(int(mix64(s).sum(dtype=U64).astype(np.int64)))
                    d2.append(int(mix64(s ^ seed64(99)).sum(dtype=U64).astype(np.int64)))
                keys.append(_packed(signatures(s, num, den)))
                bits.append(parity_bits(s).tolist())
                width = wide_bits(len(s), num, den)
                wide.append(parity_bits(s, width).tolist() if width else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(x, pa.int64()) for x in (size, d1, d2)], pa.array(keys, pa.binary()), pa.array(bits, longs), pa.array(wide, longs)], ["id", "anon", "n", "d1", "d2", "keys", "bits", "wide"]
            )

    return tidy(run)


def shared_keys(reps: DataFrame, shards: int) -> DataFrame:
    """(key, rep, c) of the index keys that c > 1 rows of ``reps(id, keys)`` have. Keys travel packed, by shards of their
    space; a shard's keys are sorted in one task, and nothing of a key that one set has alone comes back."""

    def send(batches):
        for batch in batches:
            ids, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if not len(ids):
                continue
            keys = _unpacked(b"".join(blobs))
            counts = np.array([len(b) * 8 // KEY_BITS for b in blobs], np.int64)
            of = np.repeat(np.arange(len(ids)), counts)
            shard = keys % shards
            order = np.argsort(shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=shards))[:-1]
            data = [_packed(x) for x in np.split(keys[order], ends)]
            held, whose = [], []
            for x in np.split(of[order], ends):  # in the order of the documents, so runs of one
                who, n = np.unique(x, return_counts=True)
                whose.append(ids[who].tobytes())
                held.append(n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shards, dtype=np.int32)), pa.array(whose, pa.binary()), pa.array(held, pa.binary()), pa.array(data, pa.binary())], ["shard", "ids", "held", "keys"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_unpacked(x.as_buffer()) for x in table["keys"]])
        reps = np.concatenate([np.repeat(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(h.as_buffer(), np.uint32)) for i, h in zip(table["ids"], table["held"], strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, reps = keys[order], reps[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
        count = np.repeat(np.diff(edges), np.diff(edges))
        many = count > 1
        return pa.table({"key": keys[many], "rep": reps[many], "c": count[many].astype(np.int64)})

    sent = reps.select("id", "keys").mapInArrow(tidy(send), "shard int, ids binary, held binary, keys binary")
    return sent.groupBy("shard").applyInArrow(tidy_group(meet), "key long, rep long, c long")


def _set_batches(k: int, num: int, den: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = [shingles(lowered_words(t.as_py()), k) for t in batch.column(1)]
            sharp = [parity_bits(x, sharp_bits(len(x), num, den)).tolist() for x in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets).astype(np.int64) if sets else np.empty(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sharp, pa.list_(pa.int64())), tokens], ["id", "n", "wide", "tokens"])

    return tidy(run)


#: Columns of the parity bits.
BITS = ("b0", "b1", "b2", "b3")


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """False only for pairs that can't link, by ``n`` and parity bits of the aliased sides a and b."""
    col = lambda side, name: F.col(f"{side}.{name}")
    na, nb = col(a, "n"), col(b, "n")
    apart = sum((F.bit_count(col(a, c).bitwiseXOR(col(b, c))) for c in BITS), F.lit(0))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (apart * (num + den) <= (na + nb) * (den - num))


def may_link_wide(a: str, b: str, num: int, den: int) -> Column:
    """The same by the wide bits, where both sides have them; the wider is folded to the other's width."""
    wa, wb = F.col(f"{a}.wide"), F.col(f"{b}.wide")

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    apart = F.aggregate(F.zip_with(folded(wa, wb), folded(wb, wa), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    return wa.isNull() | wb.isNull() | (apart * (num + den) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (den - num))


#: Tokens (8 bytes each) that the pairs of a round of verification bring, unless the sets as such have more.
ROUND_TOKENS = 1 << 26


def _verified(pairs: DataFrame, base: DataFrame, words: int, num: int, den: int) -> SharedTable:
    """Pairs (a, b) that truly link: den * |A & B| >= num * |A | B|. The sets are made anew from the texts ``base`` of the
    pairs' documents alone.

    Unlike pairs grow with the square of a bucket, and a pair with its set is some hundred times a pair: first parity bits as
    sharp as each set needs turn pairs away; what is left is compared in rounds, of which each shuffles no more tokens with its
    pairs than the sets have (or ROUND_TOKENS).
    """
    pairs = write_shared(pairs, "pairs")
    sets = write_shared(semi_join(base, _ends(pairs.df), "id").mapInArrow(_set_batches(words, num, den), "id long, n long, wide array<long>, tokens array<long>"), "sets")
    bits = lambda c, name: sets.df.select(F.col("id").alias(c), F.struct("n", "wide").alias(name)).hint("merge")
    sizes = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    # null: of widths too far apart to compare, at low thresholds
    like = pairs.df.join(bits("a", "x"), "a").join(bits("b", "y"), "b").where(sizes & F.coalesce(may_link_wide("x", "y", num, den), F.lit(True)))
    near = write_shared(like.groupBy("a", "b").agg(F.max("x.n").alias("n")), "near")
    pairs.drop()
    some, all_ = near.df.agg(F.sum("n")).first()[0] or 0, sets.df.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, -(-some // max(all_, ROUND_TOKENS)))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    good = []
    for r in range(rounds):
        part = near.df.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == r).select("a", "b")
        needed = semi_join(sets.df.select("id", "tokens"), _ends(part), "id")
        left = needed.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
        right = needed.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
        joined = part.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        good.append(write_shared(joined.where(both * den >= (F.size("ta") + F.size("tb") - both) * num).select("a", "b").distinct(), "links"))
    sets.drop()
    near.drop()
    if rounds == 1:
        return good[0]
    whole = write_shared(reduce(DataFrame.unionByName, [g.df for g in good]), "links")
    for g in good:
        g.drop()
    return whole


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


#: Edges (16 bytes each) that one task contracts. More go through joins.
FEW_EDGES = 1_000_000


def _contracted(batches):
    """The same as ``components`` of all edges (a, b) at once: the greater root hangs under the smaller until none is left."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    ends = np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64)
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, name: str = "components", few: int = FEW_EDGES) -> SharedTable:
    """(node, root): the smallest node reachable from each node of ``edges(a, b)``, by alternating
    large-star and small-star contraction; each step is written to the shared folder. Up to ``few`` edges take one task, which
    spares the driver the plans of some twenty steps."""
    now = write_shared(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    if now.df.count() <= few:
        out = write_shared(now.df.coalesce(1).mapInArrow(tidy(_contracted), "node long, root long"), name)
        now.drop()
        return out
    spark = edges.sparkSession
    before = None
    while True:
        e = now.df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        step = write_shared(large, name)
        e = step.df
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = write_shared(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        state = after.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0))).first()
        step.drop()
        now.drop()
        now = after
        if before == tuple(state):
            break
        before = tuple(state)
    e = now.df
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = SharedTable(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), name)
    now.drop()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, threshold: tuple[int, int] = (80, 100), count_links: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_shingles (set size), class_id (smallest id with an
    equal set), component_id (smallest id reachable by links, itself included), class_links (ids of other
    classes that its set links with: every link to another text, by the ids that have it).

    Counting verifies all pairs of a component, as many as it has links; without ``count_links`` only enough
    of them to connect the components, and class_links is left out.

    Nulls and empty texts have an empty set: they link with nothing and are their own component. Equal
    sets link. A null id takes part by its text (within, as a number of 62 bits or more made from it; ids are taken to
    be smaller); class_id and component_id are the smallest id with an equal set and the smallest reached, or null where
    all of these are null. Rows that repeat an id are returned each; they are one node. Other columns are ignored.
    """
    num, den = threshold
    small_batches(docs.sparkSession)
    given = F.col(id_col).cast("long")
    base = docs.select(F.coalesce(given, F.xxhash64(text_col).bitwiseAND(_ANONYMOUS - 1).bitwiseOR(_ANONYMOUS)).alias("id"), F.col(text_col).alias("text"), given.isNull().alias("anon"))
    sig = write_shared(base.mapInArrow(_signature_batches(words, num, den), "id long, anon boolean, n long, d1 long, d2 long, keys binary, bits array<long>, wide array<long>"), "sig")
    classes = sig.df.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    classes = write_shared(classes, "classes")
    wanted = classes.df.select("d1", "d2", "n", F.col("rep").alias("id"))
    reps = sig.df.where("n > 0").select("id", "d1", "d2", "n", "keys").join(wanted.hint("merge"), ["id", "d1", "d2", "n"], "left_semi")
    met = write_shared(shared_keys(reps, max(8, shuffle_parts(docs.sparkSession))), "met")
    facts = sig.df.where("n > 0").select(F.col("id").alias("rep"), "n", *[F.get("bits", i).alias(c) for i, c in enumerate(BITS)])
    buckets = write_shared(met.df.join(facts.hint("merge"), "rep").select("key", "rep", "c", "n", *BITS), "buckets")
    met.drop()
    slim = write_shared(sig.df.select("id", "anon", "n", "d1", "d2", "wide"), "slim")
    sig.drop()
    wide = slim.df.where("wide is not null").select(F.col("id").alias("rep"), "wide")
    links = (_all_links if count_links else _link_classes)(buckets, wide, base, words, num, den)
    comp = components(links.df, "comp")
    found = classes.df.join(comp.df.select(F.col("node").alias("rep"), "root"), "rep", "left")
    if count_links:
        sizes = slim.df.where("n > 0 and not anon").select("id", "n", "d1", "d2").distinct().groupBy("d1", "d2", "n").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("size")).select("other", "size")
        ends = links.df.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.df.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        degree = ends.join(sizes, "other").groupBy("rep").agg(F.sum("size").alias("class_links"))
        found = found.join(degree, "rep", "left")
    found = found.select("d1", "d2", "n", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"), *["class_links"] * count_links)
    mapped = write_shared(found, "mapped")
    links.drop()
    comp.drop()
    classes.drop()
    out = slim.df.join(mapped.df, ["d1", "d2", "n"], "left")
    named = lambda c: F.when(~F.col("anon") | (F.col(c) < _ANONYMOUS), F.col(c))
    return out.select(
        F.when(~F.col("anon"), F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce(named("class_id"), F.when(~F.col("anon"), F.col("id"))).alias("class_id"),
        F.coalesce(named("component_id"), F.when(~F.col("anon"), F.col("id"))).alias("component_id"),
        *[F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links")] * count_links,
    )


#: Null ids are numbers from here on.
_ANONYMOUS = 1 << 62
#: Members of a bucket that meet all others of it in one task.
HOT_BUCKET = 1_000


def _meetings(buckets: DataFrame, wide: DataFrame, num: int, den: int, apart: Column | None = None) -> DataFrame:
    """Pairs (a, b) of the members of each bucket that the filters can't turn away and that are ``apart``. ``buckets``: key,
    rep, c (members of the bucket), n and parity bits. Large buckets are split into parts, of which each meets the whole."""
    parts = F.ceil(F.col("c") / HOT_BUCKET)
    rows = buckets.join(wide.hint("merge"), "rep", "left")
    x = rows.withColumn("part", F.pmod(F.xxhash64("rep"), parts)).alias("x")
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).alias("y")
    where = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.rep") < F.col("y.rep"))
    if apart is not None:
        where = where & apart
    met = x.join(y, where & may_link("x", "y", num, den) & may_link_wide("x", "y", num, den))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _all_links(table: SharedTable, wide: DataFrame, base: DataFrame, words: int, num: int, den: int) -> SharedTable:
    """Every link between classes: all pairs of a bucket that pass the filters, verified. Drops the buckets' ``table``."""
    links = _verified(_meetings(table.df, wide, num, den), base, words, num, den)
    table.drop()
    return links


def _link_classes(table: SharedTable, wide: DataFrame, base: DataFrame, words: int, num: int, den: int) -> SharedTable:
    """Links enough to connect every component of the link graph over classes.

    First each bucket's pivot against its other members; then, in buckets whose members are still in several
    components, all pairs between components that pass the filters. Drops the buckets' ``table``.
    """
    buckets = table.df
    mass = buckets.groupBy("rep").agg(F.sum("c").alias("mass"))
    ranked = buckets.join(mass, "rep").withColumn("rank", F.struct("mass", (-F.col("rep")).alias("r")))
    pivot = ranked.groupBy("key").agg(F.max(F.struct("rank", "rep", "n", *BITS)).alias("p")).select("key", "p.rep", "p.n", *[f"p.{c}" for c in BITS])
    x, y = buckets.alias("x"), pivot.alias("y")
    stars = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & may_link("x", "y", num, den))
    pairs = stars.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    links = _verified(pairs, base, words, num, den)
    label = components(links.df, "label")
    rooted = buckets.join(label.df.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).drop("c")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("key", "c")
    open_ = write_shared(rooted.join(mixed, "key").select("key", "rep", "c", "root", "n", *BITS), "open")
    label.drop()
    table.drop()
    rest = _verified(_meetings(open_.df, wide, num, den, F.col("x.root") != F.col("y.root")), base, words, num, den)
    open_.drop()
    more = write_shared(rest.df.unionByName(links.df).distinct(), "links")
    rest.drop()
    links.drop()
    return more
