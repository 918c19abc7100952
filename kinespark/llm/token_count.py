"""Token counts by a two-tier, map-side lookup.

Tier one is a broadcast hash table of the lengths of the most frequent pre-tokens, of a fixed number
of entries; tier two is each worker's bounded cache of what it had to encode itself. No pre-token is
ever shuffled; only the per-task candidates for tier one are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches
from .units import Generations, Split, at_spaces, frequent, slices


class PieceCounter:
    """Counts pieces of a sentencepiece model unit by unit where that is exact, else text by text. A text that holds the library's own space mark is encoded whole.

    Units are exact when the model keeps white space and has a dummy prefix (a probe of the model tests both), has no
    pieces that cross a unit's start (tested on all pieces) and rewrites characters each on its own.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size()) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        crossing = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        probe = " a\n  b Åﬁ\t"
        kept = "".join(p for p in self.library.encode(probe, out_type=str) if not p.startswith("<0x"))
        self.exact = not crossing and kept.startswith("▁▁a") and "▁▁b" in kept

    def units(self, found: list[str]) -> list[int]:
        """Lengths of units. A unit that starts with a space is encoded after the dummy prefix instead of that space."""
        texts = [u[1:] if u[0] == " " else u for u in found]
        lengths = [len(x) for x in self.library.encode(texts, out_type=int, num_threads=1)]
        for i, u in enumerate(found):
            if u == " ":
                lengths[i] = self.alone("a ") - self.alone("a")
            elif u[0] == "\n":  # the text "a" + unit: the newline parts what is before it
                lengths[i] = self.alone("a" + u) - self.alone("a")
        return lengths

    def alone(self, text: str) -> int:
        return len(self.library.encode(text, out_type=int, num_threads=1))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 4096, tier_one: int = 65_536, cache: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens (no begin or end token) and
    over_limit (n_tokens > ``limit``).

    A null text counts as empty; rows that repeat are returned each; other columns are ignored. The model file is read on the driver; its bytes are sent to the workers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    counter = PieceCounter(model)
    table: dict[str, int] = {}
    if counter.exact:
        top = [u for u, _ in frequent(docs, text_col, tier_one)]
        table = dict(zip(top, counter.units(top), strict=True)) if top else {}
    shared = spark.sparkContext.broadcast((model, table))

    def run(batches):
        own, missed = held("pieces", shared.value, lambda v: (PieceCounter(v[0]), Generations(cache)))
        first = shared.value[1]
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                n_bytes = [len(t.encode()) if t else 0 for t in texts]
                n_tokens = count_batch(own, first, missed, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def _odd(own: PieceCounter):
    return lambda text: not own.exact or "▁" in text or text[0] == " " or text[-1] == " " or "  " in text


def count_batch(own: PieceCounter, first: dict, missed: Generations, texts: list) -> list[int]:
    """Tokens of each text: the sum of its units' lengths, the dummy prefix being the first unit's space."""
    split = Split(texts, at_spaces, _odd(own))
    units = [f" {w}" for w in split.words]
    lengths = list(map(first.get, units))
    rest = [u for u, n in zip(units, lengths, strict=True) if n is None]
    more = iter(missed.look_up(rest, own.units, [c > 1 for c, n in zip(split.counts().tolist(), lengths, strict=True) if n is None]))
    sizes = np.array([next(more) if n is None else n for n in lengths], np.int64)
    before = split.spread(sizes) if len(sizes) else np.zeros(1, np.int64)
    ends = before[split.offsets].tolist()
    return [own.alone(t) if odd else b - a if t else 0 for t, odd, a, b in zip(texts, split.odd, ends, ends[1:], strict=False)]
