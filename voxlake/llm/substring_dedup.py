"""Passages that repeat in a corpus, from suffix trees partitioned by variable-length prefixes.

A passage repeats if its `words` words (50 or more) occur at two places, of one document or of two.
The result covers a word exactly if some run of `words` words that holds it occurs elsewhere too.

Suffixes start at anchors: of every `words - PREFIX + 1` neighbouring places, the one whose run of PREFIX
words hashes least. All copies of a repeated run have the same anchors, at least one each, so that a
suffix at every 13th word or so finds what suffixes at all words would. A suffix's prefix is its
first PREFIX words; prefixes that occur once are dropped before anything else is read. A prefix with more than `MOST`
suffixes is lengthened by `STEP` words at a time until its suffixes fit. Prefixes are packed into groups of about
`GROUP` suffixes, and a group's tree is built in one task: its suffixes are sorted, and the runs that agree in d more words
are the tree's nodes at that depth. In a node the suffixes are compared by the words before them; where those agree far
enough, the passage reaches from there to the node's depth. What a lengthened prefix parts are nodes less deep than it
reaches; a passage of such a node is told by as many more words before the prefix, and its places are gathered by these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxlake.llm.arrow_text import grams, mix, slices, words
from voxlake.llm.tables import long_ids
from voxlake.operators.components import cut

WORDS, PREFIX = 50, 25
GROUP, MOST, STEP = 20_000, 400_000, 5


def anchors(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """(gram, doc_id, pos) of each document's anchors."""
    window = length - prefix + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                w = words(batch.column(1))
                hashes, where = grams(w, prefix)
                at = np.zeros(0, np.int64)
                if len(hashes) >= window:
                    starts = np.flatnonzero(w.row[where[: len(hashes) - window + 1]] == w.row[where[window - 1 :]])
                    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
                    at = np.unique(np.concatenate([starts[k : k + 65536] + view[starts[k : k + 65536]].argmin(axis=1) for k in range(0, len(starts), 65536)] or [at]))
                row = w.row[where[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), batch.column(0).take(pa.array(row)), pa.array((where[at] - w.first[row]).astype(np.int32))],
                    ["gram", "doc_id", "pos"],
                )

    return docs.mapInArrow(find, "gram long, doc_id long, pos int")


def contexts(docs: DataFrame, length: int, prefix: int) -> DataFrame:
    """(gram, doc_id, pos, left, right, hot) of documents with (doc_id, text, places).

    left and right are the words before and behind the prefix, nearest first, in 4 bytes each.
    """
    reach = length - prefix

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                w = words(batch.column(1))
                places = batch.column(2)
                count = np.diff(places.offsets.to_numpy())
                flat = places.flatten()
                pos, hot = flat.field("pos").to_numpy(), flat.field("hot")
                row = np.repeat(np.arange(len(count)), count)
                first, size = w.first[row], np.diff(w.first)[row]
                good = np.flatnonzero(pos + prefix <= size)
                pos, row, first, size = pos[good], row[good], first[good], size[good]
                gram = np.zeros(len(pos), np.uint64)
                for k in range(prefix):
                    gram = mix(gram + w.hashes[first + pos + k])
                short = np.append((w.hashes >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.uint32))
                lefts, rights = np.minimum(pos, reach), np.minimum(size - pos - prefix, reach)
                step = np.arange(reach)
                left = short[np.maximum((first + pos - 1)[:, None] - step, 0)]
                right = short[np.minimum((first + pos + prefix)[:, None] + step, len(short) - 1)]
                left = [r[:n].tobytes() for r, n in zip(left, lefts.tolist(), strict=True)]
                right = [r[:n].tobytes() for r, n in zip(right, rights.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), hot.take(pa.array(good))],
                    ["gram", "doc_id", "pos", "left", "right", "hot"],
                )

    return docs.mapInArrow(read, "gram long, doc_id long, pos int, left binary, right binary, hot boolean")


def matrix(column: pa.ChunkedArray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Words [rows, reach] and how many of them a row has."""
    rows = column.to_pylist()
    size = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
    return np.frombuffer(b"".join(r.ljust(4 * reach, b"\0") for r in rows), np.uint32).reshape(len(rows), reach), size


def agreeing(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many first words rows of a and b share."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(size_a, size_b))


def tree_reach(gram: np.ndarray, left: np.ndarray, lefts: np.ndarray, right: np.ndarray, rights: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(words before, words behind) that each suffix's repeated passages reach to; -1 where it has none.

    need is how many words, before and behind together, a passage has beside the prefix.
    """
    n, reach = left.shape
    before, behind = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return before, behind
    order = np.lexsort((rights, *right.T[::-1], gram))
    gram, left, lefts, right, rights = gram[order], left[order], lefts[order], right[order], rights[order]
    shared = np.where(gram[1:] == gram[:-1], agreeing(right[1:], right[:-1], rights[1:], rights[:-1]), -1)
    by_left = np.lexsort((lefts, *left.T[::-1]))
    for depth in range(reach, -1, -1):
        joined = shared >= depth
        if not joined.any():
            continue
        node = np.concatenate([[0], np.cumsum(~joined)])
        inside = np.zeros(n, bool)
        inside[1:] |= joined
        inside[:-1] |= joined
        chosen = by_left[inside[by_left]]
        chosen = chosen[np.argsort(node[chosen], kind="stable")]
        x, y = chosen[:-1], chosen[1:]
        same = node[x] == node[y]
        x, y = x[same], y[same]
        alike = agreeing(left[x], left[y], lefts[x], lefts[y])
        enough = alike >= need - depth
        for side in (x[enough], y[enough]):
            np.maximum.at(before, order[side], alike[enough])
            np.maximum.at(behind, order[side], depth)
    return before, behind


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WORDS, prefix: int = PREFIX, group: int = GROUP, most: int = MOST, step: int = STEP) -> DataFrame:
    """(doc_id, start_word, n_words): the maximal runs of words of each document that repeated passages cover.

    Words are separated by ASCII white space and compared as they are. A row with a null id or text, or with
    fewer than length words, has none. Rows that repeat an id are one document, whose places are told apart
    by their position alone. Passages may overlap themselves; all copies of one are reported, of equal rank. Very long texts are read
    whole. Ids may be of any type that has an order. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    need = length - prefix
    rows, restored = long_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id")
    rows = rows.where("doc_id is not null and text is not null")
    found = anchors(rows, length, prefix)
    # counts are combined within tasks, so that a prefix that is everywhere isn't gathered to be counted
    place = F.struct("doc_id", "pos")
    known = found.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n")).where("low <> high")
    found = cut(found.join(known.select("gram", (F.col("n") > most).alias("hot")), "gram").select("doc_id", "pos", "hot"))
    n, hot = found.agg(F.count("*"), F.count_if("hot")).first()
    places = found.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "hot")).alias("places"))
    suffixes = contexts(rows.join(places, "doc_id").select("doc_id", "text", "places"), length, prefix).withColumn("prefix", F.col("gram"))
    if hot:
        suffixes = cut(suffixes)
    parts = [(suffixes.where("not hot"), n - hot)]
    passages = None
    if hot:
        passages, longer = _lengthened(suffixes.where("hot"), need, prefix, most, step)
        parts += longer

    def tree(table: pa.Table) -> pa.Table:
        doc, pos = table.column("doc_id").to_numpy(), table.column("pos").to_numpy().astype(np.int64)
        _, one = np.unique(np.stack([doc, pos, table.column("gram").to_numpy()]), axis=1, return_index=True)
        table, doc, pos = table.take(pa.array(one)), doc[one], pos[one]
        left, lefts = matrix(table.column("left"), need)
        right, rights = matrix(table.column("right"), need)
        before, behind = tree_reach(table.column("gram").to_numpy(), left, lefts, right, rights, need)
        hit = before >= 0
        return pa.table({"doc_id": doc[hit], "low": (pos - before)[hit], "high": (pos + prefix + behind)[hit]})

    for part, size in parts:
        groups = part.select("gram", "doc_id", "pos", "left", "right", F.pmod(F.xxhash64("prefix"), F.lit(max(1, -(-size // group)))).alias("group"))
        own = groups.groupBy("group").applyInArrow(tree, "doc_id long, low long, high long")
        passages = own if passages is None else passages.union(own)
    order = W.partitionBy("doc_id").orderBy("low")
    islands = passages.select("*", F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("reached"))
    islands = islands.select("*", F.sum(F.when(F.col("low") <= F.col("reached"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("island"))
    return restored(islands.groupBy("doc_id", "island").agg(F.min("low").alias("start_word"), (F.max("high") - F.min("low")).alias("n_words")).drop("island"), ["doc_id"])


def _lengthened(suffixes: DataFrame, need: int, prefix: int, most: int, step: int) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """(passages, [(suffixes, how many)]): prefixes lengthened until their suffixes fit a tree.

    A suffix goes into a tree at the first length at which its prefix has at most `most` suffixes, and nowhere if it has but one
    place. Passages are those of nodes that are less deep than their prefixes are long, and of prefixes that reach the full length.
    """
    two = lambda keyed: keyed.groupBy("key").agg(F.min(F.struct("doc_id", "low")).alias("a"), F.max(F.struct("doc_id", "low")).alias("b"), F.count("*").alias("n")).where("a <> b")
    words_ = lambda c, k: F.substring(c, 1, 4 * k)
    passages, parts, left = None, [], suffixes
    for reach in range(step, need + step, step):
        reach, low = min(reach, need), reach - step
        # nodes of depth low to reach - 1, each with the words before that make up the full length
        backs = F.explode(F.array(*[F.struct(F.lit(need - d).alias("back"), F.xxhash64("gram", words_("left", need - d), words_("right", d), F.lit(d)).alias("key"), ((F.octet_length("left") >= 4 * (need - d)) & (F.octet_length("right") >= 4 * d)).alias("fits")) for d in range(low, reach)]))
        exact = left.select("doc_id", "pos", backs.alias("k")).where("k.fits").select("doc_id", (F.col("pos") - F.col("k.back")).cast("long").alias("low"), "k.key")
        exact = exact.join(two(exact).select("key"), "key").select("doc_id", "low", (F.col("low") + need + prefix).alias("high"))
        passages = exact if passages is None else passages.union(exact)
        longer = left.where(F.octet_length("right") >= 4 * reach).withColumn("prefix", F.xxhash64("gram", words_("right", reach)))
        known = two(longer.select(F.col("prefix").alias("key"), "doc_id", F.col("pos").cast("long").alias("low"))).select(F.col("key").alias("prefix"), (F.col("n") > most).alias("many"))
        longer = cut(longer.join(known, "prefix"))
        if reach == need:
            return passages.union(longer.select("doc_id", F.col("pos").cast("long").alias("low"), (F.col("pos") + prefix + need).cast("long").alias("high"))), parts
        n, many = longer.agg(F.count("*"), F.count_if("many")).first()
        if n > many:
            parts.append((longer.where("not many"), n - many))
        if not many:
            return passages, parts
        left = longer.where("many").drop("many", "prefix")
    return passages, parts
