"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one space. An item of n characters
matches a document that has a substring within k = n * error_rate (rounded down) edits of
it. The item is split into k + 1 pieces as even as may be; k edits leave one of them whole, so
each match has an exact hit of a piece, at most k characters from its place. An Aho-Corasick
automaton over all pieces finds the hits in one scan of the document, and Myers' bit-parallel
distance over the window around a hit verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxlake.llm.tables import by_place

ERROR_RATE = 0.05
#: An automaton is built for so many characters of items; documents are scanned once for each such share.
SHARE_CHARS = 8 << 20


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, error_rate: float = ERROR_RATE) -> int:
    return int(len(item) * error_rate)


def pieces(item: str, count: int) -> list[tuple[int, str]]:
    """(offset, piece) of count pieces whose lengths differ by one at most."""
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(item: str, text: str) -> int:
    """Least edit distance of item to any substring of text."""
    size = len(item)
    if not size:
        return 0
    full, high = (1 << size) - 1, 1 << (size - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | (1 << i)
    up, down, score = full, 0, size
    best = size
    for c in text:
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = (ph << 1) & full
        up = ((mh << 1) & full) | (full & ~(xv | ph))
        down = ph & xv
    return best


class Matcher:
    """All items of a share, given as (item_id, text)."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float = ERROR_RATE) -> None:
        self.items = [(i, t, budget(t, error_rate)) for i, t in ((i, normal(t)) for i, t in items) if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k + 1):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def matches(self, text: str, first_only: bool = False) -> dict[int, int]:
        """Least distance of each item that the text holds; one item is enough for first_only."""
        if not self.any:
            return {}
        text = normal(text)
        best: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                start = end + 1 - size - offset
                if best.get(n) == 0 or (n, start) in seen:
                    continue
                seen.add((n, start))
                _, item, k = self.items[n]
                if start >= 0 and text.startswith(item, start):
                    distance = 0
                elif k:
                    distance = myers(item, text[max(0, start - k) : start + len(item) + k])
                else:
                    continue
                if distance <= k and distance < best.get(n, k + 1):
                    best[n] = distance
                    if first_only:
                        return best
        return best


def shares(benchmark: DataFrame, id_col: str, text_col: str, limit: int = SHARE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, without null texts, in lists of about limit characters."""
    own, size = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct().toLocalIterator():
        own.append((row.i, row.t))
        size += len(row.t)
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance) of each document and item that it holds; distance is the least.

    Null and blank texts and items match nothing; a row of docs with a null id gives rows with a null
    doc_id, and so for an item without an id. Rows that repeat an id are one document: the least distance of them. Two items with
    one text are both reported. Very long texts are scanned whole. Ids may be of any type; other columns, whatever their
    names, are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_id].dataType), T.StructField("distance", T.IntegerType())])
    item_kind = to_arrow_type(benchmark.schema[item_id].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for items in shares(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, error_rate)
            for batch in batches:
                rows = [(k, m.items[n][0], d) for k, t in enumerate(batch.column(1)) for n, d in m.matches(t.as_py()).items()]
                a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a, pa.int64())), pa.array(b, item_kind), pa.array(c, pa.int32())], ["doc_id", "item_id", "distance"])

        out = out.unionByName(rows.mapInArrow(find, schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """Rows of docs, with all their columns, whatever their names, that hold no item. Null and blank texts hold none.

    Repeated rows are judged each. An empty table of either kind loses nothing.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    docs = by_place(docs)
    for items in shares(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, error_rate)
            for batch in batches:
                texts = batch.column(at)
                yield batch.filter(pa.array([t is None or not m.matches(t, True) for t in (x.as_py() for x in texts)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
