"""Benchmark decontamination with one Aho-Corasick automaton.

Items are normalised to lower-cased words of digits, a-z and non-ASCII characters; each run of
``window`` words (or the whole item, if shorter) is a pattern " w1 w2 ... ". The automaton of all
patterns scans each normalised document once; hits map back to words and to character offsets of
the original text. Patterns are broadcast only up to a size; beyond it the same rows are scanned again by the next block's.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, no_clash, small_batches, write_shared
from .units import slices

#: The bytes that separate words (all ASCII but digits and letters), and A-Z to a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normalised(text: str | None) -> str:
    """Words joined by one space, or '' without words."""
    return b" ".join(text.encode().translate(_TABLE).split()).decode() if text else ""


def patterns(items: list[tuple], window: int) -> dict[str, list]:
    """Pattern (with a space on both sides) -> ids of the items that hold it. ``items``: (id, text)."""
    out: dict[str, set] = {}
    for item, text in items:
        words = normalised(text).split(" ")
        if words == [""]:
            continue
        for i in range(max(1, len(words) - window + 1)):
            out.setdefault(f" {' '.join(words[i : i + window])} ", set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


def automaton(found: dict[str, list]):
    machine = ahocorasick.Automaton()
    for pattern, items in found.items():
        machine.add_word(pattern, (len(pattern), items))
    machine.make_automaton()
    return machine


def scan(machine, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """(words of the document, hit word ranges [first, last] united, item ids)."""
    body = normalised(text)
    if not body:
        return 0, [], set()
    padded = f" {body} "
    items: set = set()
    ranges: list[tuple[int, int]] = []
    for end, (length, ids) in machine.iter(padded):
        ranges.append((end - length + 1, end))
        items.update(ids)
    n_words = body.count(" ") + 1
    if not ranges:
        return n_words, [], items
    spaces = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 32)
    return n_words, united([(int(np.searchsorted(spaces, a)), int(np.searchsorted(spaces, b)) - 1) for a, b in ranges]), items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [first, last] of words, in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_pattern_bytes: int, window: int):
    """Items in blocks whose patterns take at most ``max_pattern_bytes`` (one item at least). The driver holds one block."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        need = len(row[1].encode()) * window
        if block and size + need > max_pattern_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += need
    yield block


#: What decontaminate adds to a row.
OUTPUTS = ("n_words", "n_hit", "items", "spans")
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, window: int = 10, max_pattern_bytes: int = 8 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, the columns named in ``keep``, n_words, n_hit (words
    inside any occurrence of a window), items (ids of items with occurring windows, sorted as strings) and
    spans (start, end offsets in characters of the original text).

    Null and empty texts have no words and no hits; null or wordless items have no window; rows that
    repeat are returned each; kept columns may not be named like the operator's own. An empty benchmark gives no
    hits.

    The automaton (some 40 bytes of memory for a byte of the patterns) travels with the tasks, so it is of patterns of at
    most ``max_pattern_bytes``. A larger benchmark is scanned block by block: what each block hits is added to the
    rows, which are written to the shared folder in between, and the result is the same.
    """
    spark = docs.sparkSession
    no_clash((id_col, *keep), OUTPUTS)
    small_batches(spark)
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(dict(benchmark.dtypes)[item_id], pa.string())
    base = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], F.col(text_col).alias("__text"))
    blocks = _blocks(benchmark, item_id, item_text, max_pattern_bytes, window)
    block, table = next(blocks), None
    for after in blocks:
        step = write_shared(_scanned(base, block, window, kind, False), "hits")
        if table is not None:
            table.drop()
        base, block, table = step.df, after, step
    return _scanned(base, block, window, kind, True)


def _scanned(base: DataFrame, block: list, window: int, kind: pa.DataType, last: bool) -> DataFrame:
    """``base`` with the word ranges and items that ``block`` hits added to the columns __ranges and __items; if it is the
    ``last``, with the OUTPUTS in place of these and the text."""
    shared = base.sparkSession.sparkContext.broadcast(patterns(block, window))
    item = {pa.int64(): "bigint", pa.int32(): "int"}.get(kind, "string")
    own = [f for f in base.schema if not f.name.startswith("__")]
    more = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>" if last else f"__text string, __ranges array<struct<a:int,b:int>>, __items array<{item}>"

    def run(batches):
        machine = held("automaton", shared.value, automaton)
        usable = len(shared.value) > 0
        for whole in batches:
            at = whole.schema.get_field_index("__text")
            for batch in slices(whole, at):
                names = batch.schema.names
                texts = batch.column(at).to_pylist()
                before = batch.column(names.index("__ranges")).to_pylist() if "__ranges" in names else [[]] * len(texts)
                known = batch.column(names.index("__items")).to_pylist() if "__items" in names else [[]] * len(texts)
                n, ranges, items = [], [], []
                for text, old, ids in zip(texts, before, known, strict=True):
                    count, found, new = scan(machine, text) if usable else (len(normalised(text).split()), [], set())
                    n.append(count)
                    ranges.append(united([*found, *((r["a"], r["b"]) for r in old)]))
                    items.append(new.union(ids))
                kept = [batch.column(names.index(f.name)) for f in own]
                if not last:
                    columns = [batch.column(at), pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], _RANGES), pa.array([sorted(i) for i in items], pa.list_(kind))]
                    yield pa.RecordBatch.from_arrays([*kept, *columns], [*[f.name for f in own], "__text", "__ranges", "__items"])
                    continue
                spans = []
                for text, found in zip(texts, ranges, strict=True):
                    where = [m.span() for m in WORD.finditer(text.translate(_LOWER))] if found else []
                    spans.append([{"start": where[a][0], "end": where[b][1]} for a, b in found])
                hit = [sum(b - a + 1 for a, b in r) for r in ranges]
                columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(map(str, i)) for i in items], pa.list_(pa.string())), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*[f.name for f in own], *OUTPUTS])

    return base.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], more]))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the character ranges."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])
