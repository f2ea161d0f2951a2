"""Near-duplicate groups by MinHash, with odd sketches to verify banded candidates.

Shingles are runs of three words, lower-cased. A document's MinHash has `permutations`
values; `bands` runs of `rows` of them are the candidate keys. All the values are folded into
an odd sketch: a bitmap in which the value at place i flips the bit at hash(i, value). For two
sketches that differ in d of n bits the number of MinHash places that differ is estimated
as -(n / 4) ln(1 - 2 d / n), hence the similarity as 1 + n / (4 k) ln(1 - 2 d / n).

Within one candidate bucket, documents that are linked by a chain of verified pairs get
links to one of them. Chains are followed, each document that is reached being compared with
those not yet reached, so that a bucket of m copies costs m comparisons and no bucket is cut
off. A bucket of more than `SHARE` documents is dealt out in shares, and each two of them are compared in a
task of their own. Connected components over all buckets' links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.arrow_text import grams, lists, mix, slices, words
from voxlake.llm.tables import long_ids
from voxlake.operators.components import connected_components, cut

SHINGLE, PERMUTATIONS, BANDS, ROWS, BITS, THRESHOLD = 3, 128, 32, 3, 512, 0.45
#: Documents of a bucket that one task compares with as many others, or with each other.
SHARE = 4096


def shingles(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles, row after row, and how many a row has.

    A row with fewer than n words has one shingle, all its words; one without words has none.
    """
    w = words(pc.utf8_lower(column))
    size = np.diff(w.first)
    hashes, where = grams(w, n)
    rows = w.row[where]
    for short in range(1, n):
        if len(chosen := np.flatnonzero(size == short)):
            h = np.zeros(len(chosen), np.uint64)
            for k in range(short):
                h = mix(h + w.hashes[w.first[chosen] + k])
            hashes, rows = np.concatenate([hashes, h]), np.concatenate([rows, chosen])
    order = np.argsort(rows, kind="stable")
    return hashes[order], np.bincount(rows, minlength=len(column))


def minhash(hashes: np.ndarray, counts: np.ndarray, permutations: int = PERMUTATIONS, seed: int = 1) -> np.ndarray:
    """uint32 [rows with shingles, permutations]: the least value of each permutation."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 62, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = counts[counts > 0]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    out = np.empty((len(counts), permutations), np.uint32)
    if not len(counts):
        return out
    # a multiplication's upper half depends on all lower bits of a mixed hash
    for k, a in enumerate(factors):
        out[:, k] = np.minimum.reduceat(((hashes * a) >> np.uint64(32)).astype(np.uint32), first)
    return out


def odd_sketch(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """uint64 [rows, bits / 64]: parities of the hashed places and values."""
    rows, k = values.shape
    at = (mix((np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))[None, :] + values) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount((np.arange(rows)[:, None] * bits + at).ravel(), minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little").view(np.uint64)


def similarity(differing: np.ndarray, permutations: int = PERMUTATIONS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of sketches that differ in so many bits."""
    left = np.maximum(1 - 2 * np.asarray(differing) / bits, 1e-9)
    return 1 + bits / (4 * permutations) * np.log(left)


def most_differing(threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, bits: int = BITS) -> int:
    """The most bits that may differ at an estimate of threshold or more."""
    return int(np.flatnonzero(similarity(np.arange(bits + 1), permutations, bits) >= threshold).max())


def links(sketches: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(reached from first, index) along verified pairs; every linked row is in one chain."""
    left, out = np.arange(len(sketches)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(sketches[left] ^ sketches[x]).sum(axis=1) <= most
            queue += (found := left[near].tolist())
            out += [(root, y) for y in found]
            left = left[~near]
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """(id, whole, bands, sketch) of each row (id, text) that has words and an id."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                hashes, counts = shingles(batch.column(1))
                values = minhash(hashes, counts)
                whole = np.zeros(len(values), np.uint64)
                for k in range(values.shape[1]):
                    whole = mix(whole + values[:, k])
                bands = np.empty((len(values), BANDS), np.uint64)
                for b in range(BANDS):
                    h = np.full(len(values), b + 1, np.uint64)
                    for k in range(b * ROWS, b * ROWS + ROWS):
                        h = mix(h + values[:, k])
                    bands[:, b] = h
                sketch = odd_sketch(values) if len(values) else np.zeros((0, BITS // 64), np.uint64)
                ids = batch.column(0).filter(pa.array(counts > 0))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(whole.view(np.int64)), lists(bands.ravel().view(np.int64), np.full(len(values), BANDS)), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["id", "whole", "bands", "sketch"],
                )

    return rows.where("id is not null and text is not null").mapInArrow(sign, "id long, whole long, bands array<long>, sketch binary")


def verified_links(signed: DataFrame, threshold: float, share: int = SHARE) -> DataFrame:
    """(src, dst) from the buckets of documents that agree in a band.

    Buckets are counted before sketches are sent anywhere: those with one document are most, and send none.
    """
    most = most_differing(threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            ids, sketches = batch.column(0), batch.column(1)
            at = ids.offsets.to_numpy()
            flat_ids = ids.values.to_numpy()
            flat = np.frombuffer(b"".join(sketches.values[int(at[0]) : int(at[-1])].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            low = int(at[0])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = flat_ids[a:b]
                if b - a == 2:
                    pairs = [(0, 1)] if int(np.bitwise_count(flat[a - low] ^ flat[a + 1 - low]).sum()) <= most else []
                else:
                    pairs = links(flat[a - low : b - low], most)
                for x, y in pairs:
                    src.append(own[x])
                    dst.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    each = signed.select("id", F.explode("bands").alias("bucket"))
    met = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / share).alias("shares"))
    members = each.join(met, "bucket")
    # a document of share i is in the tasks (i, j) and (j, i) of all shares j, so that every two documents meet
    own = F.pmod(F.xxhash64("id"), F.col("shares"))
    tasks = members.select("id", "bucket", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("j"))
    tasks = tasks.select("id", "bucket", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    buckets = tasks.join(signed.select("id", "sketch"), "id").groupBy("bucket", "i", "j").agg(F.collect_list("id").alias("ids"), F.collect_list("sketch").alias("sketches"))
    return buckets.where("size(ids) > 1").select("ids", "sketches").mapInArrow(verify, "src long, dst long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, share: int = SHARE) -> DataFrame:
    """(doc_id, group_id, is_kept) of each document that has a near duplicate; group_id is the least id.

    Rows with a null id or null text, and texts without words, are in no group. Rows that repeat
    an id count as one document, of the text that hashes least. Very long texts are signed whole; a similarity of the
    threshold itself is enough. Ids may be of any type that has an order. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    rows, restored = long_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    signed = cut(signatures(rows).groupBy("id").agg(F.min(F.struct("whole", "bands", "sketch")).alias("s")).select("id", "s.*"))
    # documents with the same MinHash throughout are linked at once, and one of them goes on
    alike = signed.groupBy("whole").agg(F.min(F.struct("id", "bands", "sketch")).alias("s"))
    copies = signed.select("whole", "id").join(alike.select("whole", F.col("s.id").alias("src")), "whole").where("id <> src").select("src", F.col("id").alias("dst"))
    edges = cut(copies.union(verified_links(alike.select("s.id", "s.bands", "s.sketch"), threshold, share)).distinct())
    found = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("is_kept"))
    return restored(found, ["doc_id", "group_id"])
