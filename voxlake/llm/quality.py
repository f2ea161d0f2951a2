"""Quality selection by importance resampling over hashed n-grams.

Two generative models are bags of hashed word n-grams (n = 1, 2): the target's, counted over
a bounded sample of labelled good documents, and the raw text's, counted over every document.
A document's log weight is the log ratio of its probability under the two. Adding Gumbel noise
and keeping the k largest sums samples k documents without replacement, in proportion to
their weights. k is the share of good documents among all labelled ones, times the documents.

An n-gram counts once a document in both models, so that one text that says a word a thousand
times doesn't fill a bucket; in a document's weight it counts as often as it occurs. The raw counts are brought to the target's scale by the ratio that
the median target n-gram has; a weight is thereby free of a document's length. The log ratio
is smoothed, and 0 where it is less than `EFFECT` or within `SIGMAS` standard errors: the ratios of
n-grams that are merely rare would else add up to more than those which tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.arrow_text import grams, raw, words
from voxlake.operators.components import cut

BUCKETS = 1 << 18
#: At most so many labelled good documents fit the target's model: those whose ids hash least.
TARGET_DOCUMENTS = 20_000
PRIOR, EFFECT, SIGMAS = 1.0, 2.0, 4.0
SEED = 17
#: A word said so often on end is an n-gram of its own.
RUN = 5


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, how often) of each row's words and pairs of words.

    Runs of punctuation are words. Where a word is said RUN times on end, its pair with
    itself is one and the same pair whatever the word is.
    """
    w = words(pc.utf8_lower(column), punctuation=True)
    two, where = grams(w, 2)
    if len(two) > RUN - 2:
        same = np.logical_and.reduce([two[: len(two) - RUN + 2] == two[k : len(two) - RUN + 2 + k] for k in range(1, RUN - 1)])
        two[np.flatnonzero(same)] = 0
    half = np.uint64(buckets // 2)
    ids = np.concatenate([w.hashes % half, two % half + half]).astype(np.int64)
    key, n = np.unique(np.concatenate([w.row, w.row[where]]) * buckets + ids, return_counts=True)
    return key // buckets, key % buckets, n


def parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    _, at = raw(column)
    low = 0
    while low < len(column):
        high = min(max(int(np.searchsorted(at, at[low] + limit, "right")) - 1, low + 1), len(column))
        yield column.slice(low, high - low)
        low = high


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """In how many rows of a one-column table of texts each bucket is.

    A task sends one row for each bucket that it met; the driver gets at most `buckets` rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts(batch.column(0)):
                total += np.bincount(features(part, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, everything: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, where it tells; words and pairs are two models."""
    out = np.zeros(len(target))
    for half in (slice(0, len(target) // 2), slice(len(target) // 2, None)):
        t, r = target[half], everything[half]
        if not t.sum():
            continue
        ratio = t / np.maximum(r, 1)
        order = np.argsort(ratio)
        mass = np.cumsum(t[order])
        expected = r * ratio[order][np.searchsorted(mass, mass[-1] / 2)]
        found = np.log((t + PRIOR) / (expected + PRIOR))
        found[(np.abs(found) < EFFECT) | (np.abs(t - expected) < SIGMAS * np.sqrt(expected + 1))] = 0
        out[half] = found
    return out


def weights(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The log weight of each row: a sum over its features, each as often as it occurs; 0 without words."""
    out = [np.zeros(0)]
    for part in parts(column):
        row, ids, n = features(part, len(ratio))
        out.append(np.bincount(row, n * ratio[ids], minlength=len(part)))
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1 and toxic = 0", target_documents: int = TARGET_DOCUMENTS) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, share of good documents among the labelled ones).

    Without a good labelled document nothing can be told: all ratios are 0 and the share is 1.
    A label with a null id, quality or toxic counts for nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.expr(good).alias("good")).where("id is not null and good is not null")
    share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    if not share:
        return np.zeros(BUCKETS), 1.0
    sample = known.where("good").select("id").distinct().orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(target_documents)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    target = texts.join(F.broadcast(sample), texts["__id"] == F.col("id"), "left_semi").select("text")
    return log_ratio(counts(target), counts(texts.select("text"))), float(share)


def gumbel(id_col: str, seed: int = SEED):
    """Standard Gumbel noise that depends on the id and the seed alone."""
    unit = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def weight_column(text_col: str, ratio: np.ndarray, spark):
    """The log weight as a column; the ratios, of a fixed size, are broadcast."""
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        return pa.array(weights(texts, shared.value))

    return weight(F.col(text_col).cast("string"))


def kth_largest(keys: DataFrame, k: int, column: str = "key", small: int = 20_000) -> float:
    """The k-th largest value of a column without nulls, exactly.

    Each round counts rows in 1024 ranges of what is left and goes on in the range that holds
    the k-th; at most `small` values are brought to the driver, unless they are all alike.
    """
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float(low)
    above = 0
    while True:
        inside = keys.where(F.col(column).between(low, high))
        if low == high:
            return float(low)
        if n <= small:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            return float(values[k - above - 1])
        width = (high - low) / 1024
        if width == 0 or low + width == low:
            width = np.spacing(high) * 4
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(1023))
        found = sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min(column), F.max(column)).collect(), reverse=True)
        for _, size, least, most in found:
            if above + size >= k:
                low, high, n = least, most, size
                break
            above += size


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(docs' id and log_weight and key, the key that the last selected document has)."""
    ratio, share = fit(docs, labels, id_col, text_col)
    spark = docs.sparkSession
    keys = docs.select(F.col(id_col).alias("doc_id"), weight_column(text_col, ratio, spark).alias("log_weight"))
    keys = cut(keys.withColumn("key", F.col("log_weight") + gumbel("doc_id")))
    n = keys.count()
    if not n:
        return keys, 0.0
    return keys, kth_largest(keys, max(1, round(share * n)))


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, key, is_selected) of every row of docs.

    A null text has no n-grams, as an empty one has: its log weight is 0. A null id is an id like
    others. Rows that repeat an id have one noise value and so, with one text, one key; rows whose key
    ties with the last selected one are all selected. Very long texts are read whole. Other columns are ignored, whatever their
    names. An empty table gives no rows; without labels all rows are selected.
    """
    keys, least = scored(docs, labels, id_col, text_col)
    return keys.withColumn("is_selected", F.col("key") >= F.lit(least))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, that importance_resample selects."""
    ratio, share = fit(docs, labels, id_col, text_col)
    key = weight_column(text_col, ratio, docs.sparkSession) + gumbel(id_col)
    keys = cut(docs.select(key.alias("key")))
    n = keys.count()
    least = kth_largest(keys, max(1, round(share * n))) if n else 0.0
    # the key is worked out again, so that the texts needn't be shuffled to join it
    return docs.where(key >= F.lit(least))
