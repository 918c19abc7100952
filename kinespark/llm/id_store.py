"""Content-addressed store of token ids.

Rolling hashes cut each document's id stream into chunks at places that depend on the ids alone, so equal
passages give equal chunks. Each unique chunk is stored once under its digest; a recipe per document lists
its chunk digests; Merkle manifests over recipes in ascending document order verify a reconstruction.

Files under the store's folder: ``objects``, chunks (key: digest; n; ids: little-endian, 16 bits where the
vocabulary fits, else 32) and the recipes as they were made, in one Parquet table bucketed by key, so that a
read joins recipes to chunks without moving the chunks first; ``recipes``, sorted by document; ``manifest``,
one leaf per recipe part (SHA-256 over its recipes in order) and one root.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, _delete, held, mix64, seed64, shuffle_cleanup, shuffle_parts, small_batches
from .units import Generations, Split, slices


#: Chunks end after an id where the hash of the last WINDOW ids has MASK_BITS zero bits; they hold LEAST to MOST ids
#: (a document's last may be shorter). LEAST is over WINDOW, so that no hash that reaches into another document counts.
WINDOW, MASK_BITS, LEAST, MOST = 4, 8, 64, 2048
_STEP = np.uint32(0x2C9277B5)  # an odd multiplier of the rolling polynomial


@lru_cache(maxsize=4)
def _id_hashes(size: int) -> np.ndarray:
    return (mix64(np.arange(size, dtype=U64) + seed64(7)) >> U64(32)).astype(np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end, over the ids of any number of documents: a polynomial of the hashes of
    WINDOW ids, rolled over the stream."""
    if not len(ids):
        return np.empty(0, np.int64)
    size = 1 << 16 if ids.dtype == np.uint16 else int(ids.max()) + 1
    h = _id_hashes(size)[ids]
    with np.errstate(over="ignore"):
        rolled, weight = h.copy(), _STEP
        for i in range(1, min(WINDOW, len(ids))):
            rolled[i:] += h[: len(ids) - i] * weight
            weight = weight * _STEP
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x846CA68B)
    return np.flatnonzero(rolled >> np.uint32(32 - MASK_BITS) == 0) + 1


def cut_points(marks_: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the document that covers start..end of the ids that ``marks`` saw."""
    out, at = [], start
    lo, hi = np.searchsorted(marks_, (start + LEAST, end))
    for mark in marks_[lo:hi].tolist():
        while mark - at > MOST:
            at += MOST
            out.append(at)
        if mark - at >= LEAST:
            out.append(mark)
            at = mark
    while end - at > MOST:
        at += MOST
        out.append(at)
    if at < end:
        out.append(end)
    return out


#: Bytes that byte-level vocabularies show as themselves; all others are shown as characters from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
#: Characters for which lower-casing and composition act on each alone, and white space is what str.split takes.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u024f]")


class WordEncoder:
    """Packed ids of a tokenizers file that lower-cases and never joins across white space.

    Words between white space are encoded once and cached, in two generations of bounded size. A word of letters,
    with or without one mark after it, goes straight to the file's merge model; anything else, and whole texts
    that hold a special token or characters that need more than lower-casing, goes to the library as it is.
    """

    def __init__(self, definition: str, cache: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.model = self.library.model
        self.code = "H" if self.library.get_vocab_size() <= 65536 else "I"
        self.cache = Generations(cache)
        self.signs: dict[str, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.direct = all(self._letters(w) == self._library(w) for w in ("the", "zürich", "naïveté", "qxzvkjwq"))

    def _library(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _make(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not cached. A word of letters takes one call of the merge model."""
        tokenize, code, out = self.model.tokenize, self.code, []
        get = self.cache.young.get
        for word in words:
            if not self.direct:
                out.append(self._library(word))
            elif word.isalpha():
                out.append(array(code, [t.id for t in tokenize(word)]).tobytes() if word.isascii() else self._letters(word))
            elif word and word[-1] in ",.!?;:)" and (stem := word[:-1]).isalpha():
                out.append((get(stem) or self._letters(stem)) + self._sign(word[-1]))
            else:
                out.append(self._library(word))
        return out

    def _sign(self, mark: str) -> bytes:
        found = self.signs.get(mark)
        if found is None:
            found = self.signs[mark] = self._library(mark)
        return found

    def encode(self, texts: list) -> list[bytes]:
        """Packed ids of each text; what no generation of the cache has is encoded once for all of them."""
        lower = lambda column: pc.utf8_split_whitespace(pc.utf8_lower(column))
        split = Split(texts, lower, lambda t: _PLAIN.search(t) is not None or any(x in t.lower() for x in self.special))
        ids = self.cache.look_up(split.words, self._make, (split.counts() > 1).tolist())
        body = split.joined(ids, np.uint16 if self.code == "H" else np.uint32)
        return [self._library(t) if odd else b.tobytes() for t, odd, b in zip(texts, split.odd, body, strict=True)]


def write_store(docs: DataFrame, path: str, definition_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", *, cache: int = 150_000) -> None:
    """Tokenise ``docs`` and write the store under ``path`` (a folder that Spark can write).

    A null text has no ids but the end id. Rows that repeat an id are documents of their own, in the order
    of their content; a null id sorts first. Chunks that occur again, in any document, are stored once.
    """
    spark = docs.sparkSession
    small_batches(spark, 5000)
    with open(definition_path) as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast(definition)

    def run(batches):
        own = held("words", shared.value, lambda v: WordEncoder(v, cache))
        width = 2 if own.code == "H" else 4
        tail = array(own.code, [end_id]).tobytes() if end_id is not None else b""
        kind = np.uint16 if width == 2 else np.uint32
        seen: set[bytes] = set()
        part, row = TaskContext.get().partitionId(), 0
        names = ["key", "kind", "id", "n", "recipe", "ids"]
        for whole in batches:
            for batch in slices(whole, 1, 18 << 20):
                streams = [ids + tail for ids in own.encode(batch.column(1).to_pylist())]
                flat = b"".join(streams)
                ends = np.cumsum([len(s) // width for s in streams]).tolist()
                found = marks(np.frombuffer(flat, kind))
                keys, ns, recipes, at = [], [], [], 0
                made: list[tuple] = []
                for end in ends:
                    recipe, start = [], at
                    for cut in cut_points(found, at, end):
                        chunk = flat[start * width : cut * width]
                        digest = hashlib.blake2b(chunk, digest_size=16).digest()
                        recipe.append(digest)
                        if digest not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(digest)
                            made.append((digest, cut - start, chunk))
                        start = cut
                    keys.append(hashlib.blake2b(b"%d,%d" % (part, row), digest_size=16).digest())
                    row += 1
                    ns.append(end - at)
                    recipes.append(recipe)
                    at = end
                m, k = len(keys), len(made)
                ids = pa.concat_arrays([batch.column(0), pa.nulls(k, batch.column(0).type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*keys, *[x[0] for x in made]], pa.binary()), pa.array(["recipe"] * m + ["chunk"] * k), ids, pa.array([*ns, *[x[1] for x in made]], pa.int64()), pa.array([*recipes, *[None] * k], pa.list_(pa.binary())), pa.array([*[None] * m, *[x[2] for x in made]], pa.binary())], names
                )

    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = base.mapInArrow(run, f"key binary, kind string, id {kind}, n long, recipe array<binary>, ids binary")
    with shuffle_cleanup(spark):
        # grouped by the key alone: a task then holds whole buckets and writes one file for each
        once = made.groupBy("key").agg(*[F.first(c).alias(c) for c in ("kind", "id", "n", "recipe", "ids")])
        name = _table(path)
        once.write.option("compression", "zstd").option("path", f"{path}/objects").bucketBy(shuffle_parts(spark), "key").sortBy("key").saveAsTable(name)
        recipes = spark.table(name).where("kind = 'recipe'").select("id", "n", "recipe", _recipe_digest().alias("leaf"))
        ordered = recipes.repartitionByRange("id", "leaf").sortWithinPartitions("id", "leaf").withColumn("part", F.spark_partition_id())
        ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _write_manifest(spark, path)


def _table(path: str) -> str:
    """Name of the catalog entry of a store's objects; it is what tells Spark that they are bucketed."""
    return "objects_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _recipe_digest() -> Column:
    return F.sha2(F.array_join(F.transform("recipe", lambda d: F.hex(d)), ","), 256)


def _leaves(recipes: DataFrame) -> list[tuple[int, int, int, str]]:
    """(part, ids, documents, digest) of each recipe part: SHA-256 over its documents in order, each with its id, its number
    of ids and the digest of its recipe, made anew from the recipe. A row for each part file."""
    documents = F.array_sort(F.collect_list(F.struct("id", _recipe_digest().alias("digest"), "n")))
    text = F.array_join(F.transform(documents, lambda d: F.concat_ws("|", F.coalesce(d["id"].cast("string"), F.lit("null")), d["n"], d["digest"])), ",")
    found = recipes.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.sha2(text, 256).alias("leaf"))
    return [tuple(r) for r in found.orderBy("part").collect()]


def merkle_root(leaves: list[str]) -> str:
    """Root over the leaves in order; each node hashes its two children, an odd one alone."""
    level = leaves or [""]
    while len(level) > 1:
        level = [hashlib.sha256(",".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return hashlib.sha256(f"root,{len(leaves)},{level[0]}".encode()).hexdigest()


def _manifest(spark: SparkSession, path: str) -> list[tuple]:
    """Rows (part, start, n, docs, leaf, root) that the recipes on disk give."""
    leaves = _leaves(spark.read.parquet(f"{path}/recipes"))
    root, start, rows = merkle_root([x[3] for x in leaves]), 0, []
    for part, n, docs, leaf in leaves:
        rows.append((part, start, n, docs, leaf, root))
        start += n
    return rows


def _write_manifest(spark: SparkSession, path: str) -> None:
    rows = _manifest(spark, path)
    spark.createDataFrame(rows, "part int, start long, n long, docs long, leaf string, root string").coalesce(1).write.parquet(f"{path}/manifest")


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the recipes on disk give the manifest's leaves, starts and root."""
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/manifest").collect()) == _manifest(spark, path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's pieces: row (a document's place, in order), id, start (ids before it), n_tokens, seq, digest, ids.
    A document without chunks has one row with nulls. Recipes move to the chunks' buckets, not the chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    order = Window.partitionBy("part").orderBy("id", "leaf", "n")
    inside = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    place = F.shiftleft(F.col("part").cast("long"), 40) + F.row_number().over(order)
    placed = recipes.withColumn("inside", F.coalesce(inside, F.lit(0))).withColumn("row", place)
    begins = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("before"))  # a row for each part file
    placed = placed.join(F.broadcast(begins), "part").select("row", "id", (F.col("before") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), "recipe")
    wanted = placed.select("row", "id", "start", "n_tokens", F.posexplode("recipe").alias("seq", "digest"))
    name = _table(path)
    objects = spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(f"{path}/objects")
    chunks = objects.where("kind = 'chunk'").select(F.col("key").alias("digest"), "ids")
    found = wanted.hint("shuffle_hash").join(chunks, "digest").select("row", "id", "start", "n_tokens", "seq", "digest", "ids")
    none = placed.where(F.size("recipe") == 0).select("row", "id", "start", "n_tokens", F.lit(0).alias("seq"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("ids"))
    return found.unionByName(none)


def reconstruct(spark: SparkSession, path: str, width: int = 2, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per document read back: id, start, n_tokens and of ``outputs`` ids (binary, little-endian unsigned 32-bit)
    and ids_crc32 (unsigned, of those). A missing or damaged chunk stops the read, and so does a recipe that is missing,
    damaged or another document's: the manifest is verified first."""
    small_batches(spark, 5000)
    if not verify_manifest(spark, path):
        raise ValueError("the recipes are not those of the manifest")
    pieces = read_store(spark, path)
    kind = dict(pieces.dtypes)["id"]
    small = np.uint16 if width == 2 else np.uint32
    forms = {"ids": "binary", "ids_crc32": "long"}
    types = {"ids": pa.binary(), "ids_crc32": pa.int64()}

    def run(batches):
        held_over: list = []  # the last document of a batch may go on in the next
        for batch in batches:
            rows = batch.column("row").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)]
            ids, digests = batch.column("ids"), batch.column("digest").to_pylist()
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            for k, digest in enumerate(digests):
                if digest is not None and hashlib.blake2b(data[at[k] : at[k + 1]], digest_size=16).digest() != digest:
                    raise ValueError("a chunk is damaged")
            first, starts, ns = (batch.column(c).to_pylist() for c in ("id", "start", "n_tokens"))
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                piece = data[at[a] : at[b]]  # the chunks of a document lie one after another
                if held_over and held_over[0] == rows[a]:
                    held_over[2].append(bytes(piece))
                else:
                    if held_over:
                        out.append(finish(*held_over[1:]))
                    held_over = [rows[a], (first[a], starts[a], ns[a]), [piece if b < len(rows) else bytes(piece)]]
            if out:
                yield pack(out, batch.schema.field("id").type)
            if held_over:
                held_over[2] = [bytes(x) for x in held_over[2]]
                last = batch.schema.field("id").type
        if held_over:
            yield pack([finish(*held_over[1:])], last)

    def finish(head, parts):
        ids = np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), small)
        if len(ids) != head[2]:
            raise ValueError("a chunk is missing: a recipe does not give its number of ids")
        wide = ids.astype("<u4")
        return (*head, *({"ids": lambda: wide.tobytes(), "ids_crc32": lambda: zlib.crc32(wide)}[k]() for k in outputs))

    def pack(rows, id_type):
        columns = list(zip(*rows, strict=True))
        kinds = [id_type, pa.int64(), pa.int64(), *[types[k] for k in outputs]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "n_tokens", *outputs])

    ordered = pieces.repartition("row").sortWithinPartitions("row", "seq")
    return ordered.mapInArrow(run, ", ".join([f"id {kind}", "start long", "n_tokens long", *[f"{k} {forms[k]}" for k in outputs]]))


def delete_store(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
    _delete(spark, path)
