"""The palette block codec for one chunk of labels, and codecs for raw and npz chunks.

A chunk is uint32 or uint64, with x fastest, in one channel after another. A channel has two 32-bit words for each
block: where its palette begins, with the index width in the top byte, and where its indices begin.
Palettes ascend as they are written; equal ones are stored once; indices of 0, 1, 2, 4, 8, 16 or 32 bits never cross words.
"""

from __future__ import annotations

import gzip
import io
import lzma
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.geometry import floor_div

WIDTHS = (0, 1, 2, 4, 8, 16, 32)


def width_for(n: int) -> int:
    return next(w for w in WIDTHS if n <= 1 << w)


def _grid(shape: Sequence[int], block: Sequence[int]) -> list[int]:
    return [-(-n // b) for n, b in zip(shape, block, strict=True)]


def compress(data: np.ndarray, block: Sequence[int] = (8, 8, 8)) -> bytes:
    """data is [x, y, z] or [x, y, z, channel] of uint32 or uint64."""
    if data.dtype.name not in ("uint32", "uint64"):
        raise TypeError(f"labels are uint32 or uint64, not {data.dtype}")
    data = data[..., None] if data.ndim == 3 else data
    channels = [_channel(data[..., c], block) for c in range(data.shape[3])]
    starts = np.cumsum([len(channels)] + [len(c) for c in channels[:-1]])
    return np.concatenate([starts.astype(np.uint32), *channels]).astype("<u4").tobytes()


def _channel(data: np.ndarray, block: Sequence[int]) -> np.ndarray:
    rows, edge = _cubes(data, block)
    if edge.any():  # what is beyond the edge has the block's first label
        first = np.where(edge, np.iinfo(data.dtype).max, rows).min(axis=1)
        rows = np.where(edge, first[:, None], rows)
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, axis=1)
    fresh = np.zeros(rows.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    rank = np.cumsum(fresh, axis=1, dtype=np.uint32)
    index = np.empty_like(rank)
    np.put_along_axis(index, order, rank, axis=1)
    fresh[:, 0] = True
    counts = fresh.sum(axis=1)
    ends, palettes = np.cumsum(counts), ordered[fresh]
    wide = np.array([width_for(c) for c in range(int(counts.max()) + 1)] if counts.max() < 4096 else [width_for(int(c)) for c in counts])
    widths = wide[counts] if counts.max() < 4096 else wide
    words: list = [None] * len(rows)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        if w:
            for k, packed in zip(own.tolist(), pack(index[own], w), strict=True):
                words[k] = packed
    headers = np.zeros((len(rows), 2), np.uint64)
    out, used, tables = [], 2 * len(headers), {}
    for n in range(len(rows)):
        palette, values_at = palettes[ends[n] - counts[n] : ends[n]], used
        if words[n] is not None:
            out.append(words[n])
            used += len(words[n])
        key = palette.tobytes()
        if key not in tables:
            tables[key] = used
            out.append(palette.view(np.uint32) if palette.dtype == np.uint64 else palette)
            used += len(out[-1])
        if tables[key] >= 1 << 24:
            raise OverflowError("a palette lies beyond what 24 bits can point to")
        headers[n] = tables[key] | int(widths[n]) << 24, values_at
    return np.concatenate([headers.astype(np.uint32).ravel(), *out])


def _cubes(data: np.ndarray, block: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(labels, whether beyond the edge) of a channel [x, y, z] as [blocks, voxels], x fastest in both."""
    grid = _grid(data.shape, block)
    full = np.zeros([g * b for g, b in zip(grid, block, strict=True)], data.dtype)
    edge = np.ones(full.shape, bool)
    inside = tuple(slice(0, n) for n in data.shape)
    full[inside], edge[inside] = data, False
    split = lambda a: a.reshape(grid[0], block[0], grid[1], block[1], grid[2], block[2]).transpose(4, 2, 0, 5, 3, 1).reshape(grid[0] * grid[1] * grid[2], -1)
    return split(full), split(edge)


def pack(index: np.ndarray, width: int) -> np.ndarray:
    """uint32 [rows, words] of indices [rows, n] of so many bits."""
    per = 32 // width
    flat = np.pad(index.astype(np.uint64), ((0, 0), (0, -index.shape[1] % per))).reshape(len(index), -1, per)
    return (flat << (np.arange(per, dtype=np.uint64) * np.uint64(width))).sum(axis=2, dtype=np.uint64).astype(np.uint32)


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """uint32 indices [rows, n] of words [rows, words]."""
    index = (words[:, :, None] >> (np.arange(32 // width, dtype=np.uint32) * np.uint32(width))) & np.uint32((1 << width) - 1 if width < 32 else 0xFFFFFFFF)
    return index.reshape(len(words), -1)[:, :n]


def indices(own: np.ndarray, widths: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """uint32 [blocks, size] of the blocks whose index widths and places are given; own is a channel's words."""
    out = np.zeros((len(widths), size), np.uint32)
    for w in np.unique(widths).tolist():
        if w:
            chosen = np.flatnonzero(widths == w)
            out[chosen] = unpack(own[values[chosen][:, None] + np.arange(-(-size * w // 32))], w, size)
    return out


def _entries(own: np.ndarray, at: np.ndarray, stride: int, dtype: np.dtype) -> np.ndarray:
    """Palette entries that begin at words at."""
    if stride == 1:
        return own[at].astype(dtype, copy=False)
    return own[at].astype(np.uint64) | own[at + 1].astype(np.uint64) << np.uint64(32)


class Headers(NamedTuple):
    tables: np.ndarray  # where palettes begin, in words of the channel
    widths: np.ndarray
    values: np.ndarray  # where indices begin


def headers(own: np.ndarray, grid: Sequence[int]) -> Headers:
    """Of all blocks of a channel, x fastest."""
    pairs = own[: 2 * grid[0] * grid[1] * grid[2]].astype(np.int64).reshape(-1, 2)
    return Headers(pairs[:, 0] & 0xFFFFFF, pairs[:, 0] >> 24, pairs[:, 1])


def palette_ends(own: np.ndarray, h: Headers, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each distinct palette, in words, without looking at an index.

    Whatever is stored next, a palette or a block's indices, ends a palette.
    """
    starts = np.unique(h.tables)
    places = np.unique(np.concatenate([starts, h.values[h.widths > 0], [end]]))
    return starts, places[np.searchsorted(places, starts, "right")]


def channel_words(words: np.ndarray, channels: int) -> list[tuple[np.ndarray, int, int]]:
    """(words, start, length) of each channel."""
    starts = words[:channels].astype(np.int64).tolist()
    return [(words[a:b], a, b - a) for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]


def decompress(body: bytes, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8), low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> np.ndarray:
    """[x, y, z, channel] of a chunk of this shape, or of the box [low, high) of it; only blocks that the box meets are read."""
    dtype = np.dtype(dtype)
    shape = tuple(shape) + (1,) if len(shape) == 3 else tuple(shape)
    low, high = tuple(low or (0, 0, 0)), tuple(high or shape[:3])
    words = np.frombuffer(body, "<u4")
    out = np.zeros([max(0, h - a) for a, h in zip(low, high, strict=True)] + [shape[3]], dtype, order="F")
    if 0 in out.shape:
        return out
    grid = _grid(shape[:3], block)
    size, stride = block[0] * block[1] * block[2], dtype.itemsize // 4
    first = [lo // b for lo, b in zip(low, block, strict=True)]
    met = [-(-hi // b) - f for hi, b, f in zip(high, block, first, strict=True)]
    x, y, z = (np.arange(m) + f for m, f in zip(met, first, strict=True))
    chosen = (x[None, None, :] + grid[0] * (y[None, :, None] + grid[1] * z[:, None, None])).ravel()
    inner = tuple(slice(lo - f * b, hi - f * b) for lo, hi, f, b in zip(low, high, first, block, strict=True))
    for c in range(shape[3]):
        own = words[int(words[c]) :]
        h = Headers(*(a[chosen] for a in headers(own, grid)))
        index = indices(own, h.widths, h.values, size)
        cubes = _entries(own, h.tables[:, None] + index.astype(np.int64) * stride, stride, dtype)
        whole = cubes.reshape(met[2], met[1], met[0], block[2], block[1], block[0]).transpose(2, 5, 1, 4, 0, 3)
        out[..., c] = whole.reshape([m * b for m, b in zip(met, block, strict=True)])[inner]
    return out


class Block(NamedTuple):
    """A block that a scan met: its first voxel and extent within the chunk, its palette and each voxel's place in it, x fastest."""

    low: tuple[int, ...]
    size: tuple[int, ...]
    channel: int
    palette: np.ndarray
    bits: int
    index: np.ndarray


def scan_blocks(body: bytes, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8), low: Sequence[int] | None = None, high: Sequence[int] | None = None, wanted: Sequence[int] | None = None) -> Iterator[Block]:
    """Blocks of a chunk that meet the box and, if labels are wanted, have one of them within it.

    Headers and palettes decide which blocks' indices are unpacked at all. A block that the box cuts keeps only what is inside:
    its palette and indices are made anew. Blocks of background alone are left out.
    """
    dtype = np.dtype(dtype)
    shape = tuple(shape) + (1,) if len(shape) == 3 else tuple(shape)
    low, high = tuple(low or (0, 0, 0)), tuple(high or shape[:3])
    if any(h <= a for a, h in zip(low, high, strict=True)):
        return
    words, grid, stride, size = np.frombuffer(body, "<u4"), _grid(shape[:3], block), dtype.itemsize // 4, block[0] * block[1] * block[2]
    seek = None if wanted is None else np.array([w % (1 << 64) for w in wanted], np.uint64).astype(dtype)
    spans = [np.arange(lo // b, -(-hi // b)) for lo, hi, b in zip(low, high, block, strict=True)]
    chosen = (spans[0][None, None, :] + grid[0] * (spans[1][None, :, None] + grid[1] * spans[2][:, None, None])).ravel()
    for c, (own, _, length) in enumerate(channel_words(words, shape[3])):
        every = headers(own, grid)
        starts, ends = palette_ends(own, every, length)
        palettes = [_entries(own, np.arange(a, b, stride), stride, dtype) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        useful = np.array([bool(np.isin(p, seek).any()) if seek is not None else bool(p.any()) for p in palettes])
        which = np.searchsorted(starts, every.tables[chosen])
        hit = np.flatnonzero(useful[which])
        met = chosen[hit]
        index = indices(own, every.widths[met], every.values[met], size)
        for k, n in enumerate(met.tolist()):
            at = (n % grid[0], n // grid[0] % grid[1], n // (grid[0] * grid[1]))
            a = [max(lo, p * b) for lo, p, b in zip(low, at, block, strict=True)]
            e = [min(hi, (p + 1) * b, s) for hi, p, b, s in zip(high, at, block, shape[:3], strict=True)]
            palette, own_index, extent = palettes[which[hit[k]]], index[k], tuple(q - p for p, q in zip(a, e, strict=True))
            if extent != tuple(block):
                cube = own_index.reshape(block[::-1])
                own_index = cube[tuple(slice(p - g * b, q - g * b) for p, q, g, b in reversed(list(zip(a, e, at, block, strict=True))))].ravel()
                used, own_index = np.unique(palette[own_index], return_inverse=True)
                palette = used
                if not palette.any() or seek is not None and not np.isin(palette, seek).any():
                    continue
            yield Block(tuple(a), extent, c, palette, width_for(len(palette)), own_index.astype(np.int32))


def labels(body: bytes, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8)) -> np.ndarray:
    """Distinct labels, from headers and palettes alone: no index is unpacked."""
    dtype = np.dtype(dtype)
    shape = tuple(shape) + (1,) if len(shape) == 3 else tuple(shape)
    words, grid, stride, found = np.frombuffer(body, "<u4"), _grid(shape[:3], block), dtype.itemsize // 4, [np.zeros(0, dtype)]
    if 0 in shape:
        return found[0]
    for own, _, length in channel_words(words, shape[3]):
        for a, b in zip(*(x.tolist() for x in palette_ends(own, headers(own, grid), length)), strict=True):
            found.append(_entries(own, np.arange(a, b, stride), stride, dtype))
    return np.unique(np.concatenate(found))


def read_voxel(body: bytes, point: Sequence[int], shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8)):
    if any(p < 0 or p >= n for p, n in zip(point, shape, strict=False)):
        raise IndexError(f"{tuple(point)} is outside of {tuple(shape)}")
    return decompress(body, shape, dtype, block, point, [p + 1 for p in point])[0, 0, 0]


def remap(body: bytes, mapping: dict, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8), preserve_missing: bool = False) -> bytes:
    """The chunk with its labels mapped; a label without a target stays or is a KeyError.

    Only palettes are rewritten, at their places: headers and indices stay as they are, so that a palette may be
    out of order or name a label twice afterwards.
    """
    dtype = np.dtype(dtype)
    shape = tuple(shape) + (1,) if len(shape) == 3 else tuple(shape)
    words, grid, stride = np.frombuffer(body, "<u4").copy(), _grid(shape[:3], block), dtype.itemsize // 4
    if 0 in shape:
        return body
    for own, start, length in channel_words(words, shape[3]):
        for a, b in zip(*(x.tolist() for x in palette_ends(own, headers(own, grid), length)), strict=True):
            old = _entries(own, np.arange(a, b, stride), stride, dtype).tolist()
            new = np.array([mapping.get(k, k) if preserve_missing else mapping[k] for k in old], dtype)
            words[start + a : start + b] = new.view(np.uint32)
    return words.tobytes()


def encode(data: np.ndarray, encoding: str, block: Sequence[int] = (8, 8, 8)) -> bytes:
    """data is [x, y, z, channel]."""
    if encoding == "raw":
        return data.tobytes("F")
    if encoding == "npz":
        out = io.BytesIO()
        np.savez_compressed(out, data)
        return out.getvalue()
    if encoding == "palette":
        return compress(data, block)
    raise ValueError(f"no codec for {encoding}")


def decode(body: bytes, encoding: str, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8)) -> np.ndarray:
    if encoding == "raw":
        return np.frombuffer(body, dtype).reshape(shape, order="F")
    if encoding == "npz":
        return np.load(io.BytesIO(body))["arr_0"].reshape(shape)
    if encoding == "palette":
        return decompress(body, shape, dtype, block)
    raise ValueError(f"no codec for {encoding}")


def encoded_labels(body: bytes, encoding: str, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8)) -> np.ndarray:
    """Distinct labels of a chunk in any encoding; palettes answer where there are some."""
    return labels(body, shape, dtype, block) if encoding == "palette" else np.unique(decode(body, encoding, shape, dtype, block))


def encoded_remap(body: bytes, encoding: str, mapping: dict, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8), preserve_missing: bool = False) -> bytes:
    if encoding == "palette":
        return remap(body, mapping, shape, dtype, block, preserve_missing)
    found, index = np.unique(data := decode(body, encoding, shape, dtype, block), return_inverse=True)
    new = np.array([mapping.get(k, k) if preserve_missing else mapping[k] for k in found.tolist()], dtype)
    return encode(new[index.reshape(data.shape)], encoding, block)


def encoded_voxel(body: bytes, encoding: str, point: Sequence[int], shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8)):
    """All channels of one voxel; one block is decoded where there are blocks."""
    return read_voxel(body, point, shape, dtype, block) if encoding == "palette" else decode(body, encoding, shape, dtype, block)[tuple(point)]


def encoded_contains(body: bytes, encoding: str, label: int, shape: Sequence[int], dtype, block: Sequence[int] = (8, 8, 8)) -> bool:
    return bool((encoded_labels(body, encoding, shape, dtype, block) == label).any())


def squeeze(body: bytes, compression: str | None) -> bytes:
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(body)
    return gzip.compress(body, mtime=0) if compression == "gzip" else lzma.compress(body) if compression == "xz" else body


def expand(body: bytes) -> bytes:
    """A stored file's content, whichever of gzip, xz and zstd it is in."""
    if body[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else lzma.decompress(body) if body[:6] == b"\xfd7zXZ\x00" else body


def chunk_bodies(v: DataFrame, size: Sequence[int], dtype: str = "uint64", encoding: str = "palette", block: Sequence[int] = (8, 8, 8)) -> DataFrame:
    """(gx, gy, gz, content) of a volume's chunks, each encoded in the task that has its voxels."""
    keys = [floor_div(F.col(a), n).alias(f"g{a}") for a, n in zip("xyz", size, strict=True)]

    def make(table: pa.Table) -> pa.Table:
        data = np.zeros((*size, 1), dtype)
        at = [np.asarray(table.column(a)) % n for a, n in zip("xyz", size, strict=True)]
        data[at[0], at[1], at[2], 0] = np.asarray(table.column("label")).astype(dtype)
        return pa.table({f"g{a}": table.column(f"g{a}").slice(0, 1) for a in "xyz"} | {"content": pa.array([encode(data, encoding, block)], pa.binary())})

    return v.select("x", "y", "z", "label", *keys).groupBy("gx", "gy", "gz").applyInArrow(make, "gx long, gy long, gz long, content binary")


def chunk_voxels(chunks: DataFrame, size: Sequence[int], dtype: str = "uint64", encoding: str = "palette", block: Sequence[int] = (8, 8, 8)) -> DataFrame:
    """The voxels of encoded chunks, without background."""

    def read(batches):
        for batch in batches:
            for gx, gy, gz, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = decode(body, encoding, (*size, 1), dtype, block)[..., 0]
                x, y, z = np.nonzero(data)
                yield pa.RecordBatch.from_arrays([pa.array(c + g * n) for c, g, n in zip((x, y, z), (gx, gy, gz), size, strict=True)] + [pa.array(data[x, y, z].astype(np.int64))], ["x", "y", "z", "label"])

    return chunks.select("gx", "gy", "gz", "content").mapInArrow(read, "x long, y long, z long, label long")


def roundtrip(v: DataFrame, size: Sequence[int]) -> DataFrame:
    return chunk_voxels(chunk_bodies(v, size), size)
