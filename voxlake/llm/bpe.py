"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A pretoken's leaves are its byte positions. A live position's leaf holds the rank of the pair
that it forms with the next live position, joined with the position itself, so that the root is
the leftmost minimum. A merge writes the joined symbol at the left position, takes the right one
out of the list of live neighbours, and repairs three root paths: the pair's own, the dead
position's and the left neighbour's. Pretokens of up to `WIDE` bytes are done many at a time as
rows of arrays; a longer one has a tree of its own. A merge costs O(log n) either way.

Ids are the ranks of the vocabulary file. Its contents are broadcast: their size is fixed.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxlake.llm.arrow_text import lists, raw, slices
from voxlake.llm.tables import by_place, col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = 64
#: Between batches, pretokens of up to WIDE bytes are kept, so many at most; longer ones aren't.
KEPT = 300_000
_NONE = np.int32(np.iinfo(np.int32).max)


class Codec:
    """Encoder and decoder of one vocabulary, given as the bytes of a rank file."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.body = np.frombuffer(b"".join(pieces), np.uint8)
        pairs = {(ranks[p[:k]] << 32) | ranks[p[k:]]: r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
        self.pairs = pairs
        size = 1 << max(8, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, _NONE, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values(), strict=True):
            while self.keys[slot] != -1:
                slot += 1
            self.keys[slot], self.values[slot] = key, value
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or the largest int32 where they don't merge."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], _NONE)
        left_over = np.flatnonzero((have != keys) & (have != -1))
        while len(left_over):
            slot[left_over] += 1
            have = self.keys[slot[left_over]]
            hit = have == keys[left_over]
            out[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (have != -1)]
        return out

    def many(self, tokens: list[bytes], width: int) -> list[bytes]:
        """Ids, as int32 bytes, of pretokens of up to width bytes; width is a power of two."""
        n, bits = len(tokens), np.int32(width.bit_length() - 1)
        size = np.fromiter(map(len, tokens), np.int64, n)
        grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(n, width)
        place = np.arange(width)
        live = place[None, :] < size[:, None]
        symbol = self.of_byte[grid]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int32)
        paired = live[:, 1:]
        r = np.full((n, width - 1), _NONE, np.int32)
        r[paired] = self.rank(symbol[:, :-1][paired], symbol[:, 1:][paired])
        tree[:, width : 2 * width - 1] = np.where(r == _NONE, _NONE, (r << bits) | place[:-1].astype(np.int32))
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        flat_tree, flat_symbol, flat_after, flat_before, flat_live = (x.reshape(-1) for x in (tree, symbol, after, before, live))
        act = np.flatnonzero(tree[:, 1] != _NONE)
        while len(act):
            root, base = flat_tree[act * (2 * width) + 1], act * width
            at = (root & (width - 1)).astype(np.int64)
            joined = root >> bits
            dead = flat_after[base + at]
            flat_symbol[base + at] = joined
            flat_live[base + dead] = False
            follow = flat_after[base + dead]
            flat_after[base + at] = follow
            has_next = follow < size[act]
            flat_before[(base + follow)[has_next]] = at[has_next]
            prior = flat_before[base + at]
            has_prior = prior >= 0
            leaf = act * (2 * width) + width
            flat_tree[leaf + dead] = _NONE
            own = np.full(len(act), _NONE, np.int32)
            k = np.flatnonzero(has_next)
            r = self.rank(joined[k], flat_symbol[(base + follow)[k]])
            own[k] = np.where(r == _NONE, _NONE, (r << bits) | at[k].astype(np.int32))
            flat_tree[leaf + at] = own
            k = np.flatnonzero(has_prior)
            r = self.rank(flat_symbol[(base + prior)[k]], joined[k])
            flat_tree[(leaf + prior)[k]] = np.where(r == _NONE, _NONE, (r << bits) | prior[k].astype(np.int32))
            rows = np.concatenate([act, act, act[k]]) * (2 * width)
            node = np.concatenate([at, dead, prior[k]]) + width
            while node[0] > 1:
                node >>= 1
                two = rows + 2 * node
                flat_tree[rows + node] = np.minimum(flat_tree[two], flat_tree[two + 1])
            act = act[flat_tree[act * (2 * width) + 1] != _NONE]
        ids, ends = symbol[live].tobytes(), np.cumsum(live.sum(axis=1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def one(self, token: bytes) -> bytes:
        """Ids, as int32 bytes, of a pretoken of any length."""
        n = len(token)
        width, none = 1 << max(1, (n - 1).bit_length()), 1 << 62
        bits = width.bit_length()
        pairs, symbol = self.pairs.get, self.of_byte[np.frombuffer(token, np.uint8)].tolist()
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        tree = [none] * (2 * width)
        for k in range(n - 1):
            if (r := pairs((symbol[k] << 32) | symbol[k + 1])) is not None:
                tree[width + k] = (r << bits) | k
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(place: int, rank: int | None) -> None:
            node = width + place
            tree[node] = none if rank is None else (rank << bits) | place
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while (root := tree[1]) != none:
            at, joined = root & ((1 << bits) - 1), root >> bits
            dead = after[at]
            follow = after[dead]
            symbol[at], live[dead], after[at] = joined, False, follow
            put(dead, None)
            put(at, None if follow >= n else pairs((joined << 32) | symbol[follow]))
            if follow < n:
                before[follow] = at
            if (prior := before[at]) >= 0:
                put(prior, pairs((symbol[prior] << 32) | joined))
        return np.array([s for s, a in zip(symbol, live, strict=True) if a], np.int32).tobytes()

    def add(self, tokens: Iterable[str]) -> None:
        """Encode pretokens that aren't in the cache, into it."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for t in tokens:
            b = t.encode("utf-8", "surrogatepass")
            if len(b) > WIDE:
                self.cache[t] = self.one(b)
                self.long.append(t)
            else:
                by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((t, b))
        for width, own in by_width.items():
            for low in range(0, len(own), 1 << 14):
                part = own[low : low + (1 << 14)]
                self.cache.update(zip((t for t, _ in part), self.many([b for _, b in part], width), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text, as int32 bytes; None for None."""
        if len(self.cache) > KEPT:
            self.cache.clear()
        cut = [self.split(t) if t is not None else None for t in texts]
        wanted: set[str] = set().union(*(c for c in cut if c))
        self.add(wanted.difference(self.cache))
        of = self.cache.__getitem__
        out = [None if c is None else b"".join(map(of, c)) for c in cut]
        for t in self.long:
            self.cache.pop(t, None)
        self.long.clear()
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        size = self.length[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.body[np.arange(total) + np.repeat(self.at[ids] - end + size, size)]


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(ranks_file: bytes, pattern: str = PATTERN) -> Codec:
    """The codec of a file's contents, built once a process."""
    key = (hashlib.sha1(ranks_file).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with tokens, n_tokens and round_trip.

    round_trip says whether decoding the tokens gives the text's bytes again. A null text has
    null in all three, an empty text no tokens; a very long one is encoded whole. Columns of docs that have one of the three
    names are replaced; others may have any name. Rows are independent: repeated rows and ids give repeated
    results, and an empty table none. Of pairs with one rank the leftmost merges first.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    made = {"tokens", "n_tokens", "round_trip"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = by_place(docs.select(*map(col, names), col(text_col).cast("string")))
    text = rows.columns[-1]
    schema = T.StructType(docs.select(*map(col, names)).schema.fields).add("tokens", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("round_trip", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for big in batches:
            for batch in slices(big, text):
                texts = batch.column(batch.num_columns - 1)
                ids = c.encode(texts.to_pylist())
                null = np.array([x is None for x in ids], bool)
                flat = np.frombuffer(b"".join(x for x in ids if x), np.int32)
                counts = np.array([len(x) // 4 if x is not None else 0 for x in ids], np.int64)
                body, at = raw(texts)
                sizes = np.concatenate([[0], np.cumsum(c.length[flat])])[np.concatenate([[0], np.cumsum(counts)])]
                back = c.decode(flat)
                if np.array_equal(sizes, at):
                    wrong = np.concatenate([[0], np.cumsum(back != body)])
                    same = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    same = np.array([back[a:b].tobytes() == body[x:y].tobytes() for a, b, x, y in zip(sizes[:-1], sizes[1:], at[:-1], at[1:], strict=True)], bool)
                made = lists(flat, counts)
                if null.any():
                    made = pa.ListArray.from_arrays(pa.array(made.offsets.to_pylist()[:-1] + [len(flat)], pa.int32(), mask=np.append(null, False)), made.values)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], made, pa.array(counts.astype(np.int32), mask=null), pa.array(same, mask=null)],
                    [*names, "tokens", "n_tokens", "round_trip"],
                )

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, tokens_col: str = "tokens", vocabulary: str = VOCABULARY, out_col: str = "text") -> DataFrame:
    """df with out_col, the text of its tokens; bytes that aren't UTF-8 become U+FFFD, and null tokens null text.

    An id that the vocabulary lacks, or a null id, is an error.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in df.columns if c != out_col]
    rows = by_place(df.select(*map(col, names), col(tokens_col).cast("array<int>")))
    schema = T.StructType(df.select(*map(col, names)).schema.fields).add(out_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else c.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, out_col])

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, n_tokens, round_trip) of every document."""
    return encode(docs, text_col, vocabulary, keep=[id_col])
