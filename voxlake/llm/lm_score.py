"""Language-model scores as marginal probabilities over a lattice of subword pieces.

A text's probability is the sum, over all of its segmentations into vocabulary pieces, of the
product of the pieces' probabilities. The vocabulary's scores order its pieces; their first
probabilities fall off with that rank. One expectation step over every document, weighted by
these, gives each piece's expected count in the corpus, and so the probabilities that score.
The step needs the corpus's distinct units and how often each occurs: they are shuffled.

No piece holds white space but leading `▁`, hence a text's lattice falls apart into units: runs of
`▁` with the word behind them, and line breaks. Its marginal is the product of its units', and
a unit that occurs again needs no second recursion. Recursions are in log space, many units at
a time. A character that the vocabulary lacks is spelled in its byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.arrow_text import mix, powers, raw, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, BREAK = 0x2581, 10
OFFSET = 10.0
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)
_FLUSH = 10_000_000
_GROUP = 600_000


class Vocabulary(NamedTuple):
    """Pieces as code points in one array; of bytes 0 .. 255 the piece's number."""

    body: np.ndarray
    size: np.ndarray
    bytes_: np.ndarray
    first: np.ndarray  # log probability by rank


def load(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    pieces, bytes_ = [], np.full(256, -1, np.int64)
    rank = np.full(n, float(n))
    for i in range(n):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            bytes_[int(piece[1:-1], 16)] = i
            pieces.append("")
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            pieces.append("")
        else:
            if "▁" in piece.lstrip("▁") or "\n" in piece or " " in piece:
                raise ValueError(f"piece {i} crosses the end of a unit")
            pieces.append(piece)
            rank[i] = min(-p.get_score(i), n)
    if (bytes_ < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    used = np.array([bool(x) for x in pieces])
    used[bytes_] = True
    weight = np.where(used, 1 / (OFFSET + rank), 0)
    with np.errstate(divide="ignore"):
        first = np.log(weight / weight.sum())
    return Vocabulary(np.array([ord(c) for x in pieces for c in x], np.uint32), np.array([len(x) for x in pieces]), bytes_, first)


class Lattice:
    def __init__(self, v: Vocabulary, log_p: np.ndarray | None = None) -> None:
        self.v = v
        self.log_p = np.append(v.first if log_p is None else log_p, -np.inf)
        self.longest = int(v.size.max())
        at = np.concatenate([[0], np.cumsum(v.size)])
        has = np.flatnonzero(v.size)
        keys = self.hashes(v.body, at[has], v.size[has])
        self.some = np.zeros(1 << 20, bool)  # small enough to stay near the processor
        self.some[(keys >> np.uint64(44)).astype(np.int64)] = True
        bits = 18
        while True:
            self.shift = np.uint64(64 - bits)
            self.keys, self.ids = np.zeros((2, 1 << bits), np.uint64), np.full((2, 1 << bits), -1, np.int32)
            slot = (keys >> self.shift).astype(np.int64)
            _, one = np.unique(slot, return_index=True)
            rest = np.setdiff1d(np.arange(len(keys)), one)
            second = (keys[rest] & np.uint64((1 << bits) - 1)).astype(np.int64)
            if len(np.unique(second)) == len(rest):
                break
            bits += 1
        self.mask = np.uint64((1 << bits) - 1)
        self.keys[0, slot[one]], self.ids[0, slot[one]] = keys[one], has[one]
        self.keys[1, second], self.ids[1, second] = keys[rest], has[rest]

    @staticmethod
    def hashes(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = len(body)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        return mix((total[start + size] - total[start]) * powers(_INV, n + 1)[start] + np.asarray(size).astype(np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        some = np.flatnonzero(self.some[(keys >> np.uint64(44)).astype(np.int64)])
        keys = keys[some]
        for table, slot in enumerate(((keys >> self.shift).astype(np.int64), (keys & self.mask).astype(np.int64))):
            hit = self.keys[table, slot] == keys
            out[some[hit]] = self.ids[table, slot[hit]]
        return out

    def edges(self, body: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, scores) [characters, longest] of units that lie one after another, and the
        characters that are spelled in bytes. A row's last column is the piece of one character that
        ends there, the column before it the piece of two."""
        n, k = len(body), self.longest
        ids = np.full((n, k), -1, np.int32)
        inside = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
        inverse = powers(_INV, n + 1)
        for length in range(1, k + 1):
            end = np.flatnonzero(inside >= length - 1)
            if not len(end):
                break
            start = end + 1 - length
            ids[end, k - length] = self.find(mix((total[end + 1] - total[start]) * inverse[start] + np.uint64(length)))
        score = self.log_p[ids]
        spelled = np.flatnonzero(ids[:, k - 1] < 0)
        if len(spelled):
            letters, which = np.unique(body[spelled], return_inverse=True)
            price = np.array([self.log_p[self.spell(c)].sum() for c in letters.tolist()])
            score[spelled, k - 1] = price[which]
        return ids, score, spelled

    def spell(self, code: int) -> np.ndarray:
        return self.v.bytes_[np.frombuffer(chr(code).encode("utf-8", "surrogatepass"), np.uint8)]

    def forward(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[units, longest + 1 + characters]; column longest + j sums what ends after j. Sizes descend."""
        k, most = self.longest, int(size[0])
        first = np.cumsum(size) - size
        a = np.full((len(size), k + 1 + most), -np.inf)
        a[:, k] = 0
        live = np.searchsorted(-size, -np.arange(most + 1), "right")
        for j in range(1, most + 1):
            n = live[j]
            x = a[:n, j : j + k] + score[first[:n] + j - 1]
            top = x.max(axis=1)
            a[:n, j + k] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return a

    def marginals(self, body: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probability of each unit; sizes descend."""
        out = np.empty(len(size))
        for low, high, own in groups(body, size):
            a = self.forward(self.edges(own, size[low:high])[1], size[low:high])
            out[low:high] = a[np.arange(high - low), self.longest + size[low:high]]
        return out

    def expected(self, body: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected count of each piece in units that occur count times; sizes descend."""
        total = np.zeros(len(self.v.size) + 1)
        k = self.longest
        for low, high, own in groups(body, size):
            s, c = size[low:high], count[low:high]
            ids, score, spelled = self.edges(own, s)
            a = self.forward(score, s)
            first, most = np.cumsum(s) - s, int(s[0])
            each = np.arange(len(s))
            z = a[each, k + s]
            # the same scores by where a piece starts: a column for each length
            start = np.full(score.shape, -np.inf)
            for length in range(1, k + 1):
                start[: len(own) + 1 - length, length - 1] = score[length - 1 :, k - length]
            b = np.full((len(s), most + k + 1), -np.inf)
            b[each, s] = 0
            live = np.searchsorted(-s, -np.arange(most + 1), "left")
            for j in range(most - 1, -1, -1):
                n = live[j]
                x = start[first[:n] + j] + b[:n, j + 1 : j + 1 + k]
                top = x.max(axis=1)
                b[:n, j] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            valid = ids >= 0
            valid[spelled, k - 1] = True
            end, column = np.nonzero(valid)
            unit = np.repeat(each, s)[end]
            inside = end - first[unit]
            share = np.exp(a[unit, inside + 1 + column] + score[end, column] + b[unit, inside + 1] - z[unit]) * c[unit]
            ids = ids[end, column]
            if len(spelled):
                letters, which = np.unique(own[spelled], return_inverse=True)
                for code, n in zip(letters.tolist(), np.bincount(which, share[ids < 0]), strict=True):
                    np.add.at(total, self.spell(code), n)
            total += np.bincount(np.where(ids < 0, len(self.v.size), ids), share, minlength=len(total))
        return total[:-1]


def groups(body: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of units with a bounded table of recursion values."""
    at = np.concatenate([[0], np.cumsum(size)])
    low = 0
    while low < len(size):
        high = min(len(size), low + max(1, _GROUP // int(size[low] + 17)))
        yield low, high, body[at[low] : at[high]]
        low = high


class Units(NamedTuple):
    body: np.ndarray
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray
    row: np.ndarray


def units(texts: list[str]) -> Units:
    """The units of texts; each text has a `▁` in front, as the vocabulary's words have."""
    each = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    body = np.concatenate([*each, np.zeros(0, np.uint32)])
    body[body == 32] = SPACE
    space, line = body == SPACE, body == BREAK
    begins = np.zeros(len(body) + 1, bool)
    begins[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begins[at[:-1]] = True
    start = np.flatnonzero(begins[:-1])
    size = np.diff(np.append(start, len(body)))
    return Units(body, start, size, Lattice.hashes(body, start, size), np.searchsorted(at, start, "right") - 1)


def pack(u: Units, chosen: np.ndarray, by_size: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, characters, sizes) of chosen units, the longest first or in the order given."""
    order = chosen[np.argsort(-u.size[chosen], kind="stable")] if by_size else chosen
    size = u.size[order]
    at = np.repeat(u.start[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return order, u.body[at], size


class Scorer:
    """Marginals of texts, with the units met lately kept in a direct-mapped table."""

    def __init__(self, v: Vocabulary, log_p: np.ndarray, bits: int = 20) -> None:
        self.lattice = Lattice(v, log_p)
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)

    def score(self, texts: list[str]) -> np.ndarray:
        u = units(texts)
        keys, first, which = np.unique(u.key, return_index=True, return_inverse=True)
        slot = (keys >> self.shift).astype(np.int64)
        values = np.where(self.keys[slot] == keys, self.values[slot], np.nan)
        new = np.flatnonzero(np.isnan(values))
        if len(new):
            by_size = new[np.argsort(-u.size[first[new]], kind="stable")]
            _, body, size = pack(u, first[by_size])
            values[by_size] = self.lattice.marginals(body, size)
            self.keys[slot[new]], self.values[slot[new]] = keys[new], values[new]
        return np.bincount(u.row, values[which], minlength=len(texts))


def as_strings(body: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """Units that lie one after another as strings."""
    wide = 1 + (body > 0x7F).astype(np.int64) + (body > 0x7FF) + (body > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(size)])]
    data = body.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data))


def from_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters and sizes of strings, in their order."""
    data, at = raw(column)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), np.diff(heads[at])


def unit_counts(texts: DataFrame) -> DataFrame:
    """(unit, n): how often each unit is in all rows of a one-column table of texts.

    A task sends each unit that it met once a few million characters, so what is shuffled follows the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            body, size, key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            _, body, size = pack(Units(body, np.cumsum(size) - size, size, key, key), first, by_size=False)
            return pa.RecordBatch.from_arrays([as_strings(body, size), pa.array(np.bincount(which, n).astype(np.int64))], ["unit", "n"])

        for big in batches:
            for batch in slices(big, "text"):
                u = units([t for t in batch.column(0).to_pylist() if t is not None])
                keys, first, n = np.unique(u.key, return_index=True, return_counts=True)
                if len(keys):
                    _, body, size = pack(u, first, by_size=False)
                    kept.append((body, size, keys, n))
                    held += len(body)
                if held > _FLUSH:
                    held = 0
                    yield flush()
        if kept:
            yield flush()

    return texts.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def expected_counts(texts: DataFrame, v: Vocabulary) -> np.ndarray:
    """Expected count of each piece over all rows of a one-column table of texts.

    The recursions run once for each distinct unit of the corpus. The driver gets as many rows as the
    vocabulary has pieces.
    """
    shared = texts.sparkSession.sparkContext.broadcast(v)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        total = np.zeros(len(shared.value.size))
        for batch in batches:
            body, size = from_strings(batch.column(0))
            u = Units(body, np.cumsum(size) - size, size, size, size)
            order, body, size = pack(u, np.arange(len(size)))
            total += lattice.expected(body, size, batch.column(1).to_numpy()[order])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["piece", "n"])

    rows = unit_counts(texts).mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(v.size))
    out[rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
    return out


def corpus_log_p(v: Vocabulary, counts: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts, with one count a piece spread as the first ones are."""
    known = np.isfinite(v.first)
    p = counts + known.sum() * np.exp(v.first)
    with np.errstate(divide="ignore"):
        return np.log(p / p.sum())


def lattice_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, corpus: bool = True) -> DataFrame:
    """(doc_id, log_prob, bits_per_byte) of every row of docs.

    log_prob is natural. A null text has nulls; an empty one has the log probability of its lone `▁` and
    null bits_per_byte. Very long texts and units are scored whole, in double precision. Rows are independent but for
    what the corpus makes of the pieces, so that ids may repeat or be null; repeated rows count again in it. Other
    columns, whatever their names, are left out. No rows give none. Unless `corpus`, the vocabulary's own scores
    weight the pieces, and a document's score depends on nothing else.
    """
    v = load(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((v, corpus_log_p(v, expected_counts(rows.select("text"), v)) if corpus else v.first))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for big in batches:
            for batch in slices(big, "text"):
                texts = batch.column(1).to_pylist()
                null = np.array([t is None for t in texts], bool)
                log_p = scorer.score([t or "" for t in texts])
                size = np.diff(raw(batch.column(1))[1])
                bits = -log_p / np.log(2) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_p, mask=null), pa.array(bits, mask=size == 0)], ["doc_id", "log_prob", "bits_per_byte"])

    schema = rows.select("doc_id").schema.simpleString()[7:-1].replace(":", " ", 1)
    return rows.mapInArrow(score, f"{schema}, log_prob double, bits_per_byte double")
