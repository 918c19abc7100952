"""Shared plumbing of the operators: word hashing, checked broadcasts, memory of the workers."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import SharedTable, _delete, shared_dir, shuffle_cleanup

U64 = np.uint64


def write_shared(df: DataFrame, name: str) -> SharedTable:
    return SharedTable(df, name)


#: Rows up to which an id-sized side (16 bytes or so a row) may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 1_000_000


def semi_join(big: DataFrame, ids: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``big`` whose key is in ``ids``: broadcast when the ids are few (counted first), else a shuffled join."""
    small = ids.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(ids) if small else ids.hint("merge"), key, "left_semi")


def no_clash(names, outputs) -> None:
    """Columns that a caller keeps may not be named like those that the operator makes."""
    both = sorted({n.lower() for n in names} & {n.lower() for n in outputs})
    if both:
        raise ValueError(f"columns {', '.join(both)} are made by the operator; rename yours")


def shuffles(df: DataFrame) -> bool:
    """Whether rows of ``df`` come from a shuffle, so that their order may differ when it is read again."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches hold at most ``rows`` rows and BATCH_BYTES bytes from now on in this session: texts are long, and a
    batch is in memory on both sides several times over. (Spark reads these settings when a plan is run, which may be after
    the operator has returned, so they can't be set back.)"""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a size with another unit is the user's own
            spark.conf.set(key, str(most))


#: Bytes of an Arrow batch (one row at least).
BATCH_BYTES = 16 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        return x


def seed64(*parts: int) -> np.uint64:
    return U64(xxhash.xxh3_64_intdigest(",".join(map(str, parts)).encode()))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of all n consecutive entries of ``h``; len(h) - n + 1 of them."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(count, U64)
        for i in range(n):
            out = (out ^ (h[i : i + count] * U64(0x9E3779B97F4A7C15))) * U64(0xC2B2AE3D27D4EB4F)
            out ^= out >> U64(29)
    return mix64(out)


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space and bytes 9 to 13), unchanged, as UTF-8."""
    return text.encode().split() if text else []


def lowered_words(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased and nothing else."""
    return text.encode().lower().split() if text else []


_HELD: dict = {}


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def release_memory() -> None:
    """At the start of a task: drop what earlier operators held in this worker, so that a reused worker starts small."""
    _HELD.clear()
    trim()


def tidy(run):
    """``run`` for mapInArrow, in a worker that starts small and is left small: idle workers keep what they have."""

    def whole(batches):
        release_memory()
        yield from run(batches)
        trim()

    return whole


def tidy_group(make):
    """The same for applyInArrow over groups."""

    def one(table: pa.Table) -> pa.Table:
        out = make(table)
        trim()
        return out

    return one


def held(name: str, value, make):
    """A worker's state made from a broadcast ``value``: made once for it, and anew when another comes. A worker holds
    one such state at a time, so that what an earlier operator needed doesn't stay in memory."""
    got = _HELD.get(name)
    if got is None or got[0] is not value:
        release_memory()
        got = _HELD[name] = (value, make(value))
    return got[1]
