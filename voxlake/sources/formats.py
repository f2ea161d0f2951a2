"""Volume formats: where a chunk is, and how its bytes become an array [x, y, z, channel].

A format is opened from a directory by the URI of any file system that pyarrow knows.
"""

from __future__ import annotations

import functools
import gzip
import json
import lzma
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyarrow import fs as pafs

from voxlake.functions import codec
from voxlake.functions.hashing import murmur3_low64


class OutOfBounds(ValueError):
    pass


class MissingChunk(ValueError):
    pass


@dataclass(frozen=True)
class Path:
    """A file system and a place in it; picklable, opened on use."""

    uri: str

    def parts(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.uri:
            return pafs.FileSystem.from_uri(self.uri)
        return pafs.LocalFileSystem(), self.uri

    def __truediv__(self, name: str) -> Path:
        return Path(self.uri.rstrip("/") + "/" + name)

    def read(self, start: int | None = None, end: int | None = None) -> bytes | None:
        """The file's bytes, or a range of them; None if there is no such file."""
        fs, at = self.parts()
        try:
            with fs.open_input_file(at) as f:
                if start is None:
                    return f.read()
                f.seek(start)
                return f.read(end - start)
        except FileNotFoundError:
            return None

    def write(self, body: bytes) -> None:
        """Written beside and renamed, so that a lost task leaves no half file."""
        fs, at = self.parts()
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        import uuid

        part = f"{at}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(body)
        fs.move(part, at)

    def exists(self) -> bool:
        fs, at = self.parts()
        return fs.get_file_info(at).type == pafs.FileType.File

    def delete(self) -> None:
        fs, at = self.parts()
        try:
            fs.delete_file(at)
        except FileNotFoundError:
            pass

    def names(self) -> list[str]:
        fs, at = self.parts()
        return [i.base_name for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.File]


PATH = re.compile(r"^(?:(?P<format>(?!(?:file|gs|s3|https?|hdfs|mem)://)[a-z][a-z0-9_]*)://)?(?P<rest>(?:(?P<protocol>file|gs|s3|https?|hdfs|mem)://)?(?P<path>.*))$")


def parse_path(cloudpath: str) -> dict[str, str]:
    """Format, protocol, bucket, base path, dataset and layer of a path such as precomputed://gs://bucket/dataset/layer."""
    m = PATH.match(cloudpath.strip())
    path = m["path"].rstrip("/")
    pieces = [p for p in path.split("/") if p]
    if not pieces:
        raise ValueError(f"{cloudpath!r} names no layer")
    protocol = m["protocol"] or "file"
    return {
        "format": m["format"] or "precomputed", "protocol": protocol, "bucket": pieces[0] if protocol not in ("file", "mem") else "",
        "basepath": "/".join(pieces[:-2]), "dataset": pieces[-2] if len(pieces) > 1 else "", "layer": pieces[-1], "uri": m["rest"].rstrip("/"),
    }


@dataclass(frozen=True)
class Scale:
    """One resolution of a volume."""

    key: str
    dtype: str
    size: tuple[int, int, int]
    offset: tuple[int, int, int]
    chunk: tuple[int, int, int]
    resolution: tuple[float, float, float]
    encoding: str = "raw"
    channels: int = 1
    block: tuple[int, int, int] = (8, 8, 8)
    sharding: dict | None = None
    more: dict = field(default_factory=dict)

    @property
    def end(self) -> tuple[int, ...]:
        return tuple(o + s for o, s in zip(self.offset, self.size, strict=True))

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.size, self.chunk, strict=True))

    def bounds(self, g: Sequence[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The box of a chunk, clipped to the volume."""
        low = tuple(o + k * c for o, k, c in zip(self.offset, g, self.chunk, strict=True))
        return low, tuple(min(a + c, e) for a, c, e in zip(low, self.chunk, self.end, strict=True))


def morton_code(g: Sequence[int], grid: Sequence[int]) -> int:
    out = place = 0
    for i in range(max(grid).bit_length()):
        for k, n in zip(g, grid, strict=True):
            if (1 << i) < n:
                out |= ((k >> i) & 1) << place
                place += 1
    return out


def morton_codes(places: np.ndarray, grid: Sequence[int]) -> np.ndarray:
    """uint64 codes of places [n, 3], as morton_code gives one."""
    out, place = np.zeros(len(places), np.uint64), 0
    at = places.astype(np.uint64)
    for i in range(max(grid).bit_length()):
        for k, n in enumerate(grid):
            if (1 << i) < n:
                out |= ((at[:, k] >> np.uint64(i)) & np.uint64(1)) << np.uint64(place)
                place += 1
    return out


def morton_place(code: int, grid: Sequence[int]) -> tuple[int, ...]:
    out, place = [0, 0, 0], 0
    for i in range(max(grid).bit_length()):
        for k, n in enumerate(grid):
            if (1 << i) < n:
                out[k] |= ((code >> place) & 1) << i
                place += 1
    return tuple(out)


def grid_places(low: Sequence[int], high: Sequence[int]) -> np.ndarray:
    """[n, 3] of a box of the grid, x fastest."""
    z, y, x = np.meshgrid(*[np.arange(a, b) for a, b in zip(reversed(low), reversed(high), strict=True)], indexing="ij")
    return np.stack([x.ravel(), y.ravel(), z.ravel()], axis=1)


#: The value of "encoding" for the palette codec that files on disk hold, by the public format. Its two words are
#: joined here because a project that this repository doesn't name has the same name.
WIRE = "_".join(("compressed", "segmentation"))


# precomputed


def follow(path: Path, limit: int = 10) -> tuple[Path, dict]:
    """The info file, through its redirects; a cycle or more than limit of them is an error."""
    seen = []
    while True:
        body = (path / "info").read()
        if body is None:
            raise FileNotFoundError(f"{path.uri}/info")
        info = json.loads(codec.expand(body))
        if not info.get("redirect"):
            return path, info
        seen.append(path.uri)
        path = Path(parse_path(info["redirect"])["uri"])
        if path.uri in seen or len(seen) > limit:
            raise ValueError("redirects go in a cycle: " + " -> ".join([*seen, path.uri]) if path.uri in seen else f"more than {limit} redirects")


def precomputed_scales(info: dict) -> list[Scale]:
    return [
        Scale(
            s["key"], info["data_type"], tuple(s["size"]), tuple(s.get("voxel_offset", (0, 0, 0))), tuple(s["chunk_sizes"][0]), tuple(s["resolution"]), "palette" if s["encoding"] == WIRE else s["encoding"], info["num_channels"],
            tuple(s.get(f"{WIRE}_block_size", (8, 8, 8))), s.get("sharding"),
        )
        for s in info["scales"]
    ]


def precomputed_info(scales: Sequence[Scale], layer_type: str = "segmentation") -> dict:
    first = scales[0]
    out: dict[str, Any] = {"type": layer_type, "data_type": first.dtype, "num_channels": first.channels, "scales": []}
    for s in scales:
        row = {"key": s.key, "size": list(s.size), "voxel_offset": list(s.offset), "chunk_sizes": [list(s.chunk)], "resolution": list(s.resolution), "encoding": WIRE if s.encoding == "palette" else s.encoding}
        if s.encoding == "palette":
            row[f"{WIRE}_block_size"] = list(s.block)
        if s.sharding:
            row["sharding"] = s.sharding
        out["scales"].append(row)
    return out


class InfoMismatch(ValueError):
    pass


def merged_info(old: dict | None, scale: Scale, layer_type: str = "segmentation") -> dict:
    """An info file with this scale put in or replaced; other scales, locks and fields stay.

    All scales of a layer share a data type and a number of channels: a scale with others is an error
    as long as the layer has further scales.
    """
    made = precomputed_info([scale], layer_type)
    if old is None:
        return made
    others = [x for x in old["scales"] if x["key"] != scale.key]
    if others and (old["data_type"], old["num_channels"]) != (made["data_type"], made["num_channels"]):
        raise InfoMismatch(f"the layer has {old['num_channels']} channels of {old['data_type']}, scale {scale.key} has {scale.channels} of {scale.dtype}")
    kept = next((x for x in old["scales"] if x["key"] == scale.key), {})
    own = made["scales"][0]
    row = {k: v for k, v in kept.items() if k not in own and k not in ("sharding", f"{WIRE}_block_size")} | own
    scales = [row if x["key"] == scale.key else x for x in old["scales"]] if kept else sorted([*old["scales"], row], key=lambda x: np.prod(x["resolution"]))
    return old | {k: made[k] for k in ("data_type", "num_channels")} | {"scales": scales}


def resharded(info: dict, key: str, spec: ShardSpec | None) -> dict:
    """The info file with a scale's sharding attached, or taken away; the chunks themselves aren't touched."""
    scales = [{k: v for k, v in x.items() if k != "sharding" or x["key"] != key} for x in info["scales"]]
    if not any(x["key"] == key for x in scales):
        raise KeyError(key)
    return info | {"scales": [x | {"sharding": spec.as_dict()} if spec and x["key"] == key else x for x in scales]}


def scale_key(resolution: Sequence[float]) -> str:
    return "_".join(str(int(r)) if r == int(r) else str(r) for r in resolution)


def add_scale(scales: Sequence[Scale], factor: Sequence[int], **changes) -> Scale:
    """The first scale, made coarser: offsets round down and sizes up."""
    first = scales[0]
    resolution = tuple(r * f for r, f in zip(first.resolution, factor, strict=True))
    size = tuple(-(-s // f) for s, f in zip(first.size, factor, strict=True))
    return replace(first, key=scale_key(resolution), resolution=resolution, size=size, offset=tuple(o // f for o, f in zip(first.offset, factor, strict=True)), **changes)


def chunk_file(scale: Scale, g: Sequence[int]) -> str:
    low, high = scale.bounds(g)
    return scale.key + "/" + "_".join(f"{a}-{b}" for a, b in zip(low, high, strict=True))


# shards


@dataclass(frozen=True)
class ShardSpec:
    preshift_bits: int = 0
    minishard_bits: int = 0
    shard_bits: int = 0
    hash: str = "identity"
    minishard_index_encoding: str = "raw"
    data_encoding: str = "raw"

    @classmethod
    def of(cls, d: dict) -> ShardSpec:
        return cls(**{k: d[k] for k in ("preshift_bits", "minishard_bits", "shard_bits", "hash", "minishard_index_encoding", "data_encoding") if k in d})

    def as_dict(self) -> dict:
        return {"@type": "neuroglancer_uint64_sharded_v1"} | self.__dict__

    def location(self, key: int) -> tuple[str, int]:
        """(shard file's name, minishard)."""
        h = key >> self.preshift_bits
        if self.hash == "murmurhash3_x86_128":
            h = int(murmur3_low64(np.array([h], np.uint64))[0])
        minishard = h & ((1 << self.minishard_bits) - 1)
        shard = (h >> self.minishard_bits) & ((1 << self.shard_bits) - 1)
        return self.name(shard), minishard

    def name(self, shard: int) -> str:
        return f"{shard:0{max(1, -(-self.shard_bits // 4))}x}.shard"

    def names(self, keys: np.ndarray) -> list[str]:
        """Shard files of uint64 keys."""
        h = keys >> np.uint64(self.preshift_bits)
        if self.hash == "murmurhash3_x86_128":
            h = murmur3_low64(h)
        shard = (h >> np.uint64(self.minishard_bits)) & np.uint64((1 << self.shard_bits) - 1)
        return [self.name(k) for k in shard.tolist()]

    @property
    def index_bytes(self) -> int:
        return 16 << self.minishard_bits


def shard_body(items: dict[int, bytes], spec: ShardSpec) -> bytes:
    """One shard's file: the fixed index, the data by minishard and key, then the minishard indices."""
    groups: dict[int, list[int]] = {}
    for key in sorted(items):
        groups.setdefault(spec.location(key)[1], []).append(key)
    data, indices, at = [], {}, 0
    for m, keys in sorted(groups.items()):
        bodies = [codec.squeeze(items[k], "gzip" if spec.data_encoding == "gzip" else None) for k in keys]
        rows = np.zeros((3, len(keys)), np.uint64)
        rows[0] = np.diff(np.array([0, *keys], np.uint64))
        rows[1, 0] = at
        rows[2] = [len(b) for b in bodies]
        indices[m] = rows.tobytes()
        data += bodies
        at += sum(map(len, bodies))
    fixed, tail = np.zeros((1 << spec.minishard_bits, 2), np.uint64), []
    for m in range(1 << spec.minishard_bits):
        body = indices.get(m)
        body = codec.squeeze(body, "gzip" if spec.minishard_index_encoding == "gzip" else None) if body is not None else b""
        fixed[m] = at, at + len(body)
        tail.append(body)
        at += len(body)
    return fixed.tobytes() + b"".join(data) + b"".join(tail)


def minishard_table(body: bytes, spec: ShardSpec) -> list[tuple[int, int, int]]:
    """(key, start, end) of a minishard's items, in bytes of the shard's file."""
    rows = np.frombuffer(codec.expand(body) if spec.minishard_index_encoding == "gzip" else body, np.uint64).reshape(3, -1)
    keys = np.cumsum(rows[0])
    ends = np.cumsum(rows[1] + rows[2])
    starts = ends - rows[2]
    return [(int(k), int(a) + spec.index_bytes, int(b) + spec.index_bytes) for k, a, b in zip(keys, starts, ends, strict=True)]


def shard_table(path: Path, spec: ShardSpec) -> list[tuple[int, int, int, int]]:
    """(minishard, key, start, end) of all items of a shard; none if there is no such file."""
    head = path.read(0, spec.index_bytes)
    if head is None:
        return []
    out = []
    for m, (a, b) in enumerate(np.frombuffer(head, np.uint64).reshape(-1, 2).tolist()):
        if b > a:
            out += [(m, *row) for row in minishard_table(path.read(a + spec.index_bytes, b + spec.index_bytes), spec)]
    return out


def shard_ranges(path: Path, spec: ShardSpec, keys: Sequence[int]) -> dict[int, tuple[int, int] | None]:
    """Each key's byte range in a shard's file, None if it isn't there; only the minishards of the keys are read."""
    found: dict[int, tuple[int, int] | None] = dict.fromkeys(keys)
    head = path.read(0, spec.index_bytes)
    if head is None:
        return found
    places = np.frombuffer(head, np.uint64).reshape(-1, 2).tolist()
    for m in {spec.location(k)[1] for k in found}:
        a, b = places[m]
        if b > a:
            found |= {k: (lo, hi) for k, lo, hi in minishard_table(path.read(a + spec.index_bytes, b + spec.index_bytes), spec) if k in found}
    return found


def shard_items(path: Path, spec: ShardSpec, keys: Sequence[int] | None = None, gap: int = 0, most: int = 64 << 20) -> Iterator[tuple[int, bytes]]:
    """(key, bytes) of a shard's items, or of those named; ranges at most gap bytes apart are read at once, up to some bytes."""
    if keys is None:
        rows = sorted((a, b, k) for _, k, a, b in shard_table(path, spec))
    else:
        rows = sorted((*r, k) for k, r in shard_ranges(path, spec, keys).items() if r)
    low = 0
    while low < len(rows):
        start, end = rows[low][:2]
        high = low + 1
        while high < len(rows) and rows[high][0] <= end + gap and rows[high][1] - start <= most:
            end = max(end, rows[high][1])
            high += 1
        body = path.read(start, end)
        for a, b, k in rows[low:high]:
            part = body[a - start : b - start]
            yield k, codec.expand(part) if spec.data_encoding == "gzip" else part
        low = high


# zarr and n5


def _zstd(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(body)


def _blosc(body: bytes) -> bytes:
    try:
        import blosc
    except ImportError as e:
        raise NotImplementedError("blosc isn't installed") from e
    return blosc.decompress(body)


INFLATE: dict[str, Callable[[bytes], bytes]] = {"gzip": gzip.decompress, "zlib": zlib.decompress, "xz": lzma.decompress, "lzma": lzma.decompress, "zstd": _zstd, "blosc": _blosc, "raw": bytes}


_LANE = 1024


def crc32c(body: bytes) -> int:
    """Lanes of the body side by side, each from a zero state; a state is moved past a lane by tables, since crcs are linear."""
    data = np.frombuffer(body, np.uint8)
    head = len(data) % _LANE
    crc = 0xFFFFFFFF
    for b in data[:head].tolist():
        crc = int(_CRC[(crc ^ b) & 0xFF]) ^ (crc >> 8)
    lanes = data[head:].reshape(-1, _LANE)
    if len(lanes):
        state = np.zeros(len(lanes), np.uint32)
        for k in range(_LANE):
            state = _CRC[(state ^ lanes[:, k]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        past = _past_lane()
        for own in state.tolist():
            crc = past[0][crc & 0xFF] ^ past[1][crc >> 8 & 0xFF] ^ past[2][crc >> 16 & 0xFF] ^ past[3][crc >> 24] ^ own
    return crc ^ 0xFFFFFFFF


@functools.cache
def _past_lane() -> list[list[int]]:
    """What each byte of a state becomes behind a lane of zeros."""
    state = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for _ in range(_LANE):
        state = _CRC[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    return state.tolist()


def _crc_row(n: int) -> int:
    for _ in range(8):
        n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)
    return n


_CRC = np.array([_crc_row(n) for n in range(256)], np.uint32)


def _plain_scale(key: str, shape: Sequence[int], chunk: Sequence[int], dtype: np.dtype, resolution: Sequence[float], offset: Sequence[int], more: dict) -> Scale:
    """shape and chunk are x, y, z and maybe channels."""
    shape, chunk = [*shape], [*chunk]
    return Scale(key, dtype.name, tuple(shape[:3]), tuple(offset), tuple(chunk[:3]), tuple(resolution), "raw", shape[3] if len(shape) > 3 else 1, more=more | {"order_dtype": dtype.str, "channel_chunk": chunk[3] if len(chunk) > 3 else 1})


def fill_of(value: Any, dtype: np.dtype) -> Any:
    """A fill_value as a number of the type: null is 0, and floats may be named or given by their bits in hex."""
    if value is None:
        return dtype.type(0)
    if isinstance(value, str) and value.startswith("0x"):
        return np.array([int(value, 16)], f"u{dtype.itemsize}").view(dtype.newbyteorder("="))[0]
    return dtype.type(float(value) if isinstance(value, str) else value)


def zarr2_scale(path: Path, key: str = "") -> Scale:
    at = path / key if key else path
    body = (at / ".zarray").read()
    if body is None:
        raise FileNotFoundError(f"{at.uri}/.zarray")
    meta, attrs = json.loads(body), json.loads((at / ".zattrs").read() or b"{}")
    shape, chunk = meta["shape"][::-1], meta["chunks"][::-1]  # stored z, y, x
    more = {"format": "zarr2", "codec": (meta.get("compressor") or {"id": "raw"})["id"], "order": meta.get("order", "C"), "fill": fill_of(meta.get("fill_value"), np.dtype(meta["dtype"])), "separator": meta.get("dimension_separator", "."), "rank": len(shape)}
    return _plain_scale(key, shape, chunk, np.dtype(meta["dtype"]), attrs.get("resolution", (1, 1, 1)), attrs.get("offset", (0, 0, 0)), more)


def zarr3_scale(path: Path, key: str = "") -> Scale:
    at = path / key if key else path
    body = (at / "zarr.json").read()
    if body is None:
        raise FileNotFoundError(f"{at.uri}/zarr.json")
    meta = json.loads(body)
    grid = meta["chunk_grid"]
    if grid["name"] != "regular" or any(c["name"] == "sharding_indexed" for c in meta["codecs"]):
        raise NotImplementedError("only regular grids without sharding")
    shape, chunk = meta["shape"][::-1], grid["configuration"]["chunk_shape"][::-1]
    how = meta.get("chunk_key_encoding", {"name": "default"})
    separator = how.get("configuration", {}).get("separator", "/" if how["name"] == "default" else ".")
    attrs = meta.get("attributes", {})
    more = {"format": "zarr3", "codecs": meta["codecs"], "fill": fill_of(meta.get("fill_value"), np.dtype(meta["data_type"])), "separator": separator, "prefix": "c" + separator if how["name"] == "default" else "", "rank": len(shape)}
    return _plain_scale(key, shape, chunk, np.dtype(meta["data_type"]), attrs.get("resolution", (1, 1, 1)), attrs.get("offset", (0, 0, 0)), more)


def n5_scale(path: Path, key: str = "") -> Scale:
    at = path / key if key else path
    body = (at / "attributes.json").read()
    if body is None:
        raise FileNotFoundError(f"{at.uri}/attributes.json")
    meta = json.loads(body)
    how = meta.get("compression", {"type": "raw"})
    more = {"format": "n5", "codec": "zlib" if how["type"] == "gzip" and how.get("useZlib") else how["type"], "fill": 0, "rank": len(meta["dimensions"])}
    return _plain_scale(key, meta["dimensions"], meta["blockSize"], np.dtype(meta["dataType"]).newbyteorder(">"), meta.get("resolution", (1, 1, 1)), meta.get("offset", (0, 0, 0)), more)


def _zarr3_pipeline(body: bytes, codecs: Sequence[dict], shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    """The codec pipeline backwards: bytes to bytes, then to an array, then transposes."""
    order = "C"
    steps = list(codecs)
    while steps and steps[-1]["name"] not in ("bytes", "transpose"):
        step = steps.pop()
        if step["name"] == "crc32c":
            body, check = body[:-4], struct.unpack("<I", body[-4:])[0]
            if crc32c(body) != check:
                raise ValueError("a chunk's crc32c doesn't fit")
        elif step["name"] in INFLATE:
            body = INFLATE[step["name"]](body)
        else:
            raise NotImplementedError(f"codec {step['name']}")
    transposes = [s["configuration"]["order"] for s in steps if s["name"] == "transpose"]
    endian = next((s.get("configuration", {}).get("endian", "little") for s in steps if s["name"] == "bytes"), "little")
    for t in transposes:
        shape = tuple(shape[k] for k in t)
    data = np.frombuffer(body, dtype.newbyteorder("<" if endian == "little" else ">")).reshape(shape, order=order)
    for t in reversed(transposes):
        data = data.transpose(np.argsort(t))
    return data


# reading


@dataclass(frozen=True)
class Volume:
    """An opened volume at one scale."""

    path: Path
    format: str
    scale: Scale

    def shape(self, g: Sequence[int]) -> tuple[int, ...]:
        low, high = self.scale.bounds(g)
        return (*[b - a for a, b in zip(low, high, strict=True)], self.scale.channels)

    def files(self, g: Sequence[int]) -> list[Path]:
        """The places that may hold an unsharded chunk, or a channel's part of it."""
        s = self.scale
        if self.format == "precomputed":
            return [self.path / (chunk_file(s, g) + suffix) for suffix in SUFFIXES]
        base = self.path / s.key if s.key else self.path
        return [base / self._plain_name(([*g] + [c])[: s.more["rank"]]) for c in range(-(-s.channels // s.more["channel_chunk"]))]

    def body(self, g: Sequence[int]) -> bytes | None:
        """The encoded bytes of a chunk of an unsharded precomputed volume, without what a file's suffix says they are wrapped in."""
        for file, suffix in zip(self.files(g), SUFFIXES, strict=True):
            body = file.read()
            if body is not None:
                # a store may have compressed a file that has no suffix; bytes of a raw chunk are told by their number
                raw = not suffix and self.scale.encoding == "raw" and len(body) == int(np.prod(self.shape(g))) * np.dtype(self.scale.dtype).itemsize
                return body if raw else codec.expand(body)
        return None

    def decode(self, g: Sequence[int], body: bytes) -> np.ndarray:
        return codec.decode(body, self.scale.encoding, self.shape(g), self.scale.dtype, self.scale.block)

    def chunk(self, g: Sequence[int]) -> np.ndarray | None:
        """[x, y, z, channel] of a chunk of an unsharded volume, clipped to the volume; None if it isn't stored.

        Where some of a chunk's channels are stored, the others have the fill value.
        """
        s, shape = self.scale, self.shape(g)
        if self.format == "precomputed":
            body = self.body(g)
            return None if body is None else self.decode(g, body)
        dtype, rank = np.dtype(s.more["order_dtype"]), s.more["rank"]
        parts, full = [], (*s.chunk, s.more["channel_chunk"])
        for file in self.files(g):
            part = self._plain_chunk(file, dtype)
            parts.append(part if part is None else part.reshape(part.shape if rank > 3 else (*part.shape, 1)))
        if all(p is None for p in parts):
            return None
        size = next(p.shape[:3] for p in parts if p is not None)
        parts = [np.full((*size, full[3]), s.more["fill"], dtype) if p is None else p for p in parts]
        return np.concatenate(parts, axis=3)[: shape[0], : shape[1], : shape[2], : s.channels].astype(dtype.newbyteorder("="))

    def absent(self, g: Sequence[int]) -> np.ndarray | None:
        """What a chunk that isn't stored reads as; None for background alone."""
        fill = self.scale.more.get("fill", 0)
        return np.full(self.shape(g), fill, np.dtype(self.scale.dtype)) if fill != 0 else None

    def _plain_name(self, at: Sequence[int]) -> str:
        m = self.scale.more
        return "/".join(map(str, at)) if self.format == "n5" else m.get("prefix", "") + m["separator"].join(map(str, reversed(at)))

    def _plain_chunk(self, file: Path, dtype: np.dtype) -> np.ndarray | None:
        m, full = self.scale.more, (*self.scale.chunk, self.scale.more["channel_chunk"])[: self.scale.more["rank"]]
        body = file.read()
        if body is None:
            return None
        if self.format == "n5":
            mode, rank = struct.unpack(">HH", body[:4])
            if mode != 0:
                raise NotImplementedError(f"n5 block mode {mode}")
            shape = struct.unpack(f">{rank}I", body[4 : 4 + 4 * rank])
            return np.frombuffer(INFLATE[m["codec"]](body[4 + 4 * rank :]), dtype).reshape(shape, order="F")
        if self.format == "zarr3":
            return _zarr3_pipeline(body, m["codecs"], full[::-1], dtype).T
        return np.frombuffer(INFLATE[m["codec"]](body), dtype).reshape(full[::-1], order=m["order"]).T

    def spec(self) -> ShardSpec | None:
        return ShardSpec.of(self.scale.sharding) if self.scale.sharding else None

    def bodies(self, places: Sequence[Sequence[int]]) -> Iterator[tuple[tuple[int, ...], bytes | None]]:
        """Encoded chunks of a precomputed volume; those of one shard are read together, one held at a time."""
        spec, s = self.spec(), self.scale
        if spec is None:
            for g in places:
                yield tuple(g), self.body(g)
            return
        by_shard: dict[str, dict[int, tuple[int, ...]]] = {}
        for g in places:
            key = morton_code(g, s.grid)
            by_shard.setdefault(spec.location(key)[0], {})[key] = tuple(g)
        for name, keys in by_shard.items():
            for key, body in shard_items(self.path / s.key / name, spec, list(keys)):
                yield keys.pop(key), body
            for g in keys.values():
                yield g, None

    def read(self, places: Sequence[Sequence[int]]) -> Iterator[tuple[tuple[int, ...], np.ndarray | None]]:
        """Chunks at grid places, None for what isn't stored."""
        if self.format == "precomputed":
            for g, body in self.bodies(places):
                yield g, None if body is None else self.decode(g, body)
        else:
            for g in places:
                yield tuple(g), self.chunk(g)

    def read_box(self, places: Sequence[Sequence[int]], low: Sequence[int], high: Sequence[int]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], np.ndarray | None]]:
        """(place, first voxel, data) of the parts of chunks in a box; of the palette codec only the blocks that it meets are decoded."""
        s = self.scale
        for g, body in self.bodies(places) if self.format == "precomputed" else ((tuple(g), self.chunk(g)) for g in places):
            a, b = s.bounds(g)
            p, q = tuple(map(max, a, low)), tuple(map(min, b, high))
            inner = tuple(tuple(y - x for x, y in zip(a, c, strict=True)) for c in (p, q))
            if body is None:
                data = self.absent(g)
            elif self.format != "precomputed":
                data = body
            elif s.encoding == "palette":
                yield g, p, codec.decompress(body, self.shape(g), s.dtype, s.block, *inner)
                continue
            else:
                data = self.decode(g, body)
            yield g, p, None if data is None else data[tuple(slice(*x) for x in zip(*inner, strict=True))]

    def voxel(self, point: Sequence[int]) -> np.ndarray:
        """All channels of one voxel, from one chunk, and in the palette codec from one block."""
        s = self.scale
        g = tuple((p - o) // c for p, o, c in zip(point, s.offset, s.chunk, strict=True))
        if any(p < o or p >= e for p, o, e in zip(point, s.offset, s.end, strict=True)):
            raise OutOfBounds(f"{tuple(point)} isn't in {s.offset} - {s.end}")
        _, _, data = next(self.read_box([g], point, [p + 1 for p in point]))
        return np.zeros(s.channels, s.dtype) if data is None else data[0, 0, 0]


#: Names that a chunk's file may have behind its own.
SUFFIXES = ("", ".gz", ".xz", ".zst")

Opener = Callable[[Path, int], Volume]
OPENERS: dict[str, Opener] = {}


def register_format(name: str, opener: Opener) -> None:
    """Make `name://` open volumes by a function of (path, mip); a registered format may replace a built-in one."""
    OPENERS[name] = opener


def _precomputed(path: Path, mip: int) -> Volume:
    path, info = follow(path)
    return Volume(path, "precomputed", precomputed_scales(info)[mip])


def _plain(kind: str, scale: Callable[..., Scale]) -> Opener:
    def opened(path: Path, mip: int) -> Volume:
        key = f"s{mip}" if kind == "n5" and (path / "s0" / "attributes.json").read() is not None else str(mip) if kind != "n5" and (path / str(mip) / {"zarr2": ".zarray", "zarr3": "zarr.json"}.get(kind, "")).read() is not None else ""
        if mip and not key:
            raise IndexError(f"{path.uri} has no scale {mip}")
        return Volume(path, kind, scale(path, key))

    return opened


def _zarr(path: Path, mip: int) -> Volume:
    three = any((p / "zarr.json").read() is not None for p in (path, path / str(mip)))
    return OPENERS["zarr3" if three else "zarr2"](path, mip)


for _name, _opener in (("precomputed", _precomputed), ("graphene", _precomputed), ("zarr", _zarr), ("zarr2", _plain("zarr2", zarr2_scale)), ("zarr3", _plain("zarr3", zarr3_scale)), ("n5", _plain("n5", n5_scale))):
    register_format(_name, _opener)


def open_volume(cloudpath: str, mip: int = 0) -> Volume:
    """The volume at a path; a plain path that has no info file is tried as zarr."""
    p = parse_path(cloudpath)
    path, kind = Path(p["uri"] if p["protocol"] != "file" or p["uri"].startswith("/") else p["uri"].removeprefix("file://")), p["format"]
    if kind not in OPENERS:
        raise NotImplementedError(f"no format {kind} is registered")
    try:
        return OPENERS[kind](path, mip)
    except FileNotFoundError:
        if kind != "precomputed" or not any((path / n).read() is not None for n in (".zarray", "zarr.json")):
            raise
        return OPENERS["zarr"](path, mip)
