"""Formats, shards, the data source and the writer: round trips and goldens."""

import gzip
import itertools
import json
import struct
import time

import numpy as np
import pytest

from voxlake.functions import codec
from voxlake.functions.hashing import murmur3_low64
from voxlake.sources import formats, volume
from voxlake.sources.formats import Path, Scale, ShardSpec


def random_labels(shape, n=9, dtype=np.uint32, seed=0):
    return np.random.default_rng(seed).integers(0, n, shape).astype(dtype)


@pytest.mark.parametrize("block", [(8, 8, 8), (4, 4, 4), (2, 3, 5)])
@pytest.mark.parametrize("dtype", [np.uint64, np.uint32])
@pytest.mark.parametrize("shape,n", [((8, 8, 8), 1), ((9, 17, 5), 2), ((16, 8, 20), 40), ((13, 11, 12), 3000), ((1, 1, 1), 5)])
def test_codec_round_trip(dtype, block, shape, n):
    data = random_labels(shape, n, dtype)
    body = codec.compress(data, block)
    assert np.array_equal(codec.decompress(body, shape, dtype, block)[..., 0], data)
    assert np.array_equal(codec.labels(body, shape, dtype, block), np.unique(data))
    r = np.random.default_rng(1)
    for _ in range(5):
        low = [int(r.integers(0, s)) for s in shape]
        high = [int(r.integers(a + 1, s + 1)) for a, s in zip(low, shape)]
        part = codec.decompress(body, shape, dtype, block, low, high)[..., 0]
        assert np.array_equal(part, data[tuple(slice(a, b) for a, b in zip(low, high))])
        assert codec.read_voxel(body, low, shape, dtype, block) == data[tuple(low)]
    with pytest.raises(IndexError):
        codec.read_voxel(body, shape, shape, dtype, block)


def test_codec_layout_and_errors():
    body = codec.compress(np.full((8, 8, 8), 7, np.uint32))
    assert np.frombuffer(body, "<u4").tolist() == [1, 2, 2, 7]  # one channel; palette at 2 with no index bits; one label
    body = codec.compress(np.where(np.arange(512).reshape(8, 8, 8, order="F") % 2, 9, 4).astype(np.uint32))
    words = np.frombuffer(body, "<u4")
    assert words[1] >> 24 == 1 and words[3] == 0xAAAAAAAA and words[-2:].tolist() == [4, 9]
    with pytest.raises(TypeError):
        codec.compress(np.zeros((2, 2, 2), np.int32))
    two = random_labels((9, 9, 9, 2), 50)
    assert np.array_equal(codec.decompress(codec.compress(two), two.shape, np.uint32), two)


def test_codec_remap():
    data = random_labels((61, 33, 20), 15)
    body = codec.compress(data)
    new = codec.remap(body, {k: k + 20 for k in range(15)}, data.shape, np.uint32)
    assert np.array_equal(codec.decompress(new, data.shape, np.uint32)[..., 0], data + 20)
    with pytest.raises(KeyError):
        codec.remap(body, {0: 1}, data.shape, np.uint32)
    kept = codec.remap(body, {0: 77}, data.shape, np.uint32, preserve_missing=True)
    assert np.array_equal(codec.decompress(kept, data.shape, np.uint32)[..., 0], np.where(data == 0, 77, data))


def test_murmur3_against_a_plain_version():
    def plain(key):
        m = 0xFFFFFFFF
        rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m

        def fmix(h):
            h ^= h >> 16
            h = h * 0x85EBCA6B & m
            h ^= h >> 13
            h = h * 0xC2B2AE35 & m
            return h ^ h >> 16

        a, b = key & m, key >> 32
        h = [0, 0, 0, 0]
        h[1] ^= rot(b * 0xAB0E9789 & m, 16) * 0x38B34AE5 & m
        h[0] ^= rot(a * 0x239B961B & m, 15) * 0xAB0E9789 & m
        h = [x ^ 8 for x in h]
        h[0] = sum(h) & m
        h = [h[0], *[(x + h[0]) & m for x in h[1:]]]
        h = [fmix(x) for x in h]
        h[0] = sum(h) & m
        h = [h[0], *[(x + h[0]) & m for x in h[1:]]]
        return h[0] | h[1] << 32

    keys = np.array([0, 1, 12345, (1 << 63) + 5, (1 << 64) - 1], np.uint64)
    assert murmur3_low64(keys).tolist() == [plain(int(k)) for k in keys]


@pytest.mark.parametrize("how", ["gzip", "raw"])
def test_shard_round_trip(tmp_path, how):
    spec = ShardSpec(1, 2, 0, "identity", how, how)
    items = {k: bytes([k]) * (k % 5 + 1) for k in (0, 3, 9, 10, 200, 77)}
    path = Path(str(tmp_path / "0.shard"))
    path.write(formats.shard_body(items, spec))
    assert dict(formats.shard_items(path, spec)) == items
    assert dict(formats.shard_items(path, spec, [9, 77, 5], gap=100)) == {9: items[9], 77: items[77]}
    assert sorted(k for _, k, _, _ in formats.shard_table(path, spec)) == sorted(items)
    assert list(formats.shard_items(Path(str(tmp_path / "none")), spec)) == []


def test_shard_names_and_paths():
    assert ShardSpec(9, 6, 16).location(0x458D << 15 | 5 << 9 | 7) == ("458d.shard", 5)
    assert formats.parse_path("precomputed://gs://bucket/a/data/layer/")["layer"] == "layer"
    p = formats.parse_path("/data/set/layer")
    assert (p["format"], p["protocol"], p["dataset"], p["uri"]) == ("precomputed", "file", "set", "/data/set/layer")
    with pytest.raises(ValueError):
        formats.parse_path("zarr://")
    assert formats.crc32c(b"123456789") == 0xE3069283


def test_redirects(tmp_path):
    for name, to in (("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "info").write_text(json.dumps({"redirect": str(tmp_path / to)}))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "info").write_text(json.dumps({"scales": []}))
    assert formats.follow(Path(str(tmp_path / "a")))[0].uri.endswith("/c")
    with pytest.raises(ValueError, match="cycle"):
        formats.follow(Path(str(tmp_path / "x")))


SCALE = Scale("4_4_40", "uint32", (40, 33, 20), (-5, 7, 0), (16, 16, 8), (4, 4, 40), "palette")


def voxels_of(data, offset):
    at = np.argwhere(data)
    return [(*(int(a) + o for a, o in zip(p, offset)), int(data[tuple(p)])) for p in at]


@pytest.mark.parametrize("changes", [{}, {"encoding": "raw"}, {"encoding": "npz", "dtype": "uint64"}, {"sharding": ShardSpec(1, 1, 2).as_dict()}, {"sharding": ShardSpec(0, 2, 1, "murmurhash3_x86_128", "gzip", "gzip").as_dict()}])
def test_write_and_read(spark, tmp_path, changes):
    from dataclasses import replace

    scale = replace(SCALE, **changes)
    data = random_labels(scale.size, 5)
    data[16:32, :16] = 0
    frame = spark.createDataFrame(voxels_of(data, scale.offset), "x long, y long, z long, label long")
    path = str(tmp_path / "layer")
    assert volume.write_volume(frame, path, scale).count() >= 2
    back = volume.read_volume(spark, path)
    assert {tuple(r) for r in back.select("x", "y", "z", "label").collect()} == set(voxels_of(data, scale.offset))
    low, high = (0, 10, 3), (20, 30, 11)
    want = {v for v in voxels_of(data, scale.offset) if all(a <= p < b for a, p, b in zip(low, v, high))}
    assert {tuple(r) for r in volume.read_volume(spark, path, low=low, high=high).select("x", "y", "z", "label").collect()} == want
    with pytest.raises(volume.OutOfBounds):
        volume.read_volume(spark, path, low=(-6, 7, 0), high=(0, 10, 5))
    new = spark.createDataFrame([(1, 11, 4, 99)], "x long, y long, z long, label long")
    volume.write_volume(new, path, scale, low=low, high=high)
    kept = set(voxels_of(data, scale.offset)) - want
    assert {tuple(r) for r in volume.read_volume(spark, path).select("x", "y", "z", "label").collect()} == kept | {(1, 11, 4, 99)}


def test_pushdown_prunes_chunks():
    class Reader(volume.VolumeReader):
        def __init__(self):
            self.volume, self.fill, self.task_voxels = formats.Volume(Path("/nowhere"), "precomputed", SCALE), True, 1
            self.low, self.high = list(SCALE.offset), list(SCALE.end)

    r = Reader()
    assert len(r.partitions()) == 3 * 3 * 3
    list(r.pushFilters([volume.GreaterThanOrEqual(("x",), 11), volume.LessThan(("y",), 23), volume.EqualTo(("z",), 9)]))
    assert [r.places(c) for c in r.partitions()] == [[(1, 0, 1)], [(2, 0, 1)]]


@pytest.mark.parametrize("sharding", [None, ShardSpec(2, 1, 3), ShardSpec(1, 2, 3, "murmurhash3_x86_128")])
def test_partitions_cover_the_box_once(sharding):
    from dataclasses import replace

    class Reader(volume.VolumeReader):
        def __init__(self, task):
            self.volume, self.fill, self.task_voxels = formats.Volume(Path("/nowhere"), "precomputed", replace(SCALE, size=(150, 90, 60), sharding=sharding and sharding.as_dict())), False, task
            self.low, self.high = [0, 10, 3], [101, 64, 41]

    for task in (1, 10_000, 10**9):
        r = Reader(task)
        found = [g for p in r.partitions() for g in r.places(p)]
        low, high = r.span()
        assert sorted(found) == sorted(itertools.product(*map(range, low, high)))


def test_partitions_of_a_large_grid():
    class Reader(volume.VolumeReader):
        def __init__(self):
            s = Scale("k", "uint64", (300_000, 200_000, 20_000), (0, 0, 0), (64, 64, 64), (4, 4, 40))
            self.volume, self.fill, self.task_voxels, self.low, self.high = formats.Volume(Path("/nowhere"), "precomputed", s), True, volume.TASK_VOXELS, [0, 0, 0], list(s.end)

    began = time.time()
    parts = Reader().partitions()
    assert 10_000 < len(parts) <= volume.MOST_TASKS and time.time() - began < 5


def test_missing_chunks(spark, tmp_path):
    frame = spark.createDataFrame([(0, 8, 1, 3)], "x long, y long, z long, label long")
    path = str(tmp_path / "layer")
    volume.write_volume(frame, path, SCALE)
    assert volume.read_volume(spark, path).count() == 1
    with pytest.raises(Exception, match="isn't stored"):
        volume.read_volume(spark, path, fill_missing=False).count()
    assert volume.delete_box(spark, path, (-5, 7, 0), (11, 23, 8)) == 1 and volume.read_volume(spark, path).count() == 0


def test_transfer(spark, tmp_path):
    data = random_labels(SCALE.size, 5)
    volume.write_volume(spark.createDataFrame(voxels_of(data, SCALE.offset), "x long, y long, z long, label long"), str(tmp_path / "a"), SCALE)
    volume.transfer(spark, str(tmp_path / "a"), str(tmp_path / "b"), chunk=(8, 8, 8), sharding=ShardSpec(1, 1, 1).as_dict())
    assert {tuple(r) for r in volume.read_volume(spark, str(tmp_path / "b")).select("x", "y", "z", "label").collect()} == set(voxels_of(data, SCALE.offset))


def zarr_chunks(data, chunk):
    """(place, chunk as stored, z first and filled up) of data [x, y, z]."""
    for g in np.ndindex(*[-(-s // c) for s, c in zip(data.shape, chunk)]):
        part = data[tuple(slice(k * c, (k + 1) * c) for k, c in zip(g, chunk))]
        full = np.zeros(chunk, data.dtype)
        full[tuple(slice(0, s) for s in part.shape)] = part
        yield g, part, full.T


def test_zarr_and_n5(spark, tmp_path):
    data, chunk = random_labels((10, 9, 7), 5, np.uint16), (4, 5, 3)
    want = set(voxels_of(data, (0, 0, 0)))
    z2, z3, n5 = (tmp_path / n for n in ("z2", "z3", "n5"))
    for p in (z2, z3, n5):
        p.mkdir()
    (z2 / ".zarray").write_text(json.dumps({"shape": [7, 9, 10], "chunks": [3, 5, 4], "dtype": ">u2", "compressor": {"id": "gzip"}, "order": "F", "fill_value": 0, "zarr_format": 2}))
    codecs = [{"name": "transpose", "configuration": {"order": [2, 0, 1]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {}}, {"name": "crc32c"}]
    (z3 / "zarr.json").write_text(json.dumps({"shape": [7, 9, 10], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3, 5, 4]}}, "codecs": codecs, "chunk_key_encoding": dict(name="default"), "fill_value": 0}))
    (n5 / "attributes.json").write_text(json.dumps({"dimensions": [10, 9, 7], "blockSize": [4, 5, 3], "dataType": "uint16", "compression": {"type": "gzip"}}))
    for g, part, full in zarr_chunks(data, chunk):
        (z2 / ".".join(map(str, g[::-1]))).write_bytes(gzip.compress(full.astype(">u2").tobytes("F")))
        body = gzip.compress(full.transpose(2, 0, 1).astype(">u2").tobytes())
        at = z3 / "c" / "/".join(map(str, g[::-1]))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body + struct.pack("<I", formats.crc32c(body)))
        at = n5 / "/".join(map(str, g))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(struct.pack(">HHIII", 0, 3, *part.shape) + gzip.compress(part.astype(">u2").tobytes("F")))
    for path in (f"zarr2://{z2}", f"zarr3://{z3}", f"n5://{n5}", f"zarr://{z3}", str(z2)):
        assert {tuple(r) for r in volume.read_volume(spark, path).select("x", "y", "z", "label").collect()} == want, path
    at.write_bytes(struct.pack(">HHIII", 1, 3, *part.shape))
    with pytest.raises(Exception, match="block mode"):
        volume.read_volume(spark, f"n5://{n5}").count()


def test_scales():
    s = formats.add_scale([SCALE], (2, 2, 1))
    assert (s.key, s.size, s.offset) == ("8_8_40", (20, 17, 20), (-3, 3, 0))
    assert formats.precomputed_scales(formats.precomputed_info([SCALE, s])) == [SCALE, s]


def test_locked_scales(spark, tmp_path):
    frame, path = spark.createDataFrame([(0, 8, 1, 3)], "x long, y long, z long, label long"), str(tmp_path / "layer")
    volume.write_volume(frame, path, SCALE)
    volume.set_locked(path, [SCALE.key])
    with pytest.raises(volume.LockedScale):
        volume.write_volume(frame, path, SCALE)
    volume.set_locked(path, [SCALE.key], False)
    volume.write_volume(frame, path, SCALE)


def test_image_shards():
    from voxlake.operators.shards import image_parameters, shard_shape

    assert image_parameters((1, 1, 1)) == (0, 0, 0) and image_parameters((64, 64, 32)) == (10, 7, 0) and image_parameters((4096, 4096, 512)) == (10, 9, 14)
    grid = (8, 16, 3)
    for bits in range(10):
        first = [p for p in np.ndindex(*grid) if formats.morton_code(p, grid) < 1 << bits]
        shape = shard_shape(grid, bits)
        assert all(max(p[k] for p in first) < shape[k] for k in range(3))


def stored(spark, path, **more):
    return {tuple(r) for r in volume.read_volume(spark, path, **more).select("x", "y", "z", "label").collect()}


V = "x long, y long, z long, label long"


def test_rewrites_leave_nothing(spark, tmp_path):
    from dataclasses import replace

    data = random_labels(SCALE.size, 5)
    full = spark.createDataFrame(voxels_of(data, SCALE.offset), V)
    one = spark.createDataFrame([(0, 8, 1, 3)], V)
    for k, sharding in enumerate((None, ShardSpec(1, 1, 2).as_dict())):
        scale, path = replace(SCALE, sharding=sharding), str(tmp_path / f"v{k}")
        volume.write_volume(full, path, scale)
        low, high = (-5, 7, 0), (11, 23, 8)
        volume.write_volume(full.where("false"), path, scale, low=low, high=high)
        outside = {v for v in voxels_of(data, scale.offset) if not all(a <= p < b for a, p, b in zip(low, v, high))}
        assert stored(spark, path) == outside
        volume.write_volume(one, path, scale)
        assert stored(spark, path) == {(0, 8, 1, 3)}
        volume.write_volume(one.where("false"), path, scale)
        assert stored(spark, path) == set() and not list((tmp_path / f"v{k}" / SCALE.key).iterdir())
        volume.write_volume(one, path, scale, delete_black=False)
        assert volume.read_volume(spark, path, fill_missing=False).count() == 1
    with pytest.raises(volume.OutOfBounds):
        volume.write_volume(one, str(tmp_path / "v0"), SCALE, low=(-6, 7, 0), high=(0, 10, 5))


def test_info_is_merged(spark, tmp_path):
    from dataclasses import replace

    one, path = spark.createDataFrame([(0, 8, 1, 3)], V), str(tmp_path / "layer")
    volume.write_volume(one, path, SCALE)
    info = json.loads((tmp_path / "layer" / "info").read_text())
    (tmp_path / "layer" / "info").write_text(json.dumps(info | {"mesh": "mesh", "skeletons": "s", "odd": [1]}))
    volume.set_locked(path, [SCALE.key])
    coarse = formats.add_scale([SCALE], (2, 2, 1))
    volume.write_volume(one, path, coarse)
    info = json.loads((tmp_path / "layer" / "info").read_text())
    assert [s["key"] for s in info["scales"]] == [SCALE.key, coarse.key] and info["scales"][0]["locked"] and (info["mesh"], info["odd"]) == ("mesh", [1])
    with pytest.raises(volume.LockedScale):
        volume.write_volume(one, path, SCALE)
    with pytest.raises(volume.LockedScale):
        volume.delete_box(spark, path, (-5, 7, 0), (11, 23, 8))
    with pytest.raises(formats.InfoMismatch):
        volume.write_volume(one, path, replace(coarse, dtype="uint64"))
    assert stored(spark, path) == {(0, 8, 1, 3)}
    spec = ShardSpec(1, 1, 2)
    volume.set_sharding(path, coarse.key, spec)
    assert formats.open_volume(path, 1).spec() == spec
    volume.set_sharding(path, coarse.key, None)
    assert formats.open_volume(path, 1).spec() is None and formats.open_volume(path, 1).scale == coarse


@pytest.mark.parametrize("encoding,dtype", [("palette", np.uint64), ("raw", np.uint8), ("raw", np.float32), ("npz", np.uint16)])
def test_from_numpy_and_voxels(spark, tmp_path, encoding, dtype):
    data = (random_labels((20, 17, 9, 2), 7) * (0.5 if dtype is np.float32 else 1)).astype(dtype)
    path = str(tmp_path / "layer")
    made = volume.from_numpy(spark, data, path, (4, 4, 40), (3, -2, 1), (8, 8, 8), encoding)
    assert made.scale == formats.open_volume(path).scale
    got = {tuple(r) for r in volume.read_volume(spark, path).collect()}
    assert got == {(int(x) + 3, int(y) - 2, int(z) + 1, int(c), data[x, y, z, c].item()) for x, y, z, c in np.argwhere(data)}
    assert np.array_equal(volume.read_voxel(path, (10, 5, 6)), data[7, 7, 5])
    with pytest.raises(formats.OutOfBounds):
        volume.read_voxel(path, (23, 0, 1))
    low, high = (5, 1, 2), (14, 12, 9)
    if dtype is not np.float32:
        b = volume.read_blocks(spark, path, low=low, high=high)
        assert {tuple(r) for r in volume.block_voxels(b).collect()} == {r for r in got if all(a <= p < e for a, p, e in zip(low, r, high))}
    assert volume.unique_stored(spark, path).count() == len(np.unique(data)) if dtype is not np.float32 else True


def test_only_hit_blocks_are_unpacked(monkeypatch):
    data = np.zeros((32, 32, 32), np.uint64)
    data[3, 4, 5], data[20:24, 9, 9], data[31, 31, 31] = 7, 8, (1 << 63) + 5
    body, unpacked = codec.compress(data), []
    keep = codec.indices
    monkeypatch.setattr(codec, "indices", lambda own, widths, values, size: unpacked.append(len(widths)) or keep(own, widths, values, size))
    assert [b.low for b in codec.scan_blocks(body, data.shape, np.uint64, wanted=[7])] == [(0, 0, 0)] and sum(unpacked) == 1
    found = list(codec.scan_blocks(body, data.shape, np.uint64, wanted=[5 - (1 << 63), 8]))
    assert [b.low for b in found] == [(16, 8, 8), (24, 24, 24)] and sum(unpacked) == 3
    assert list(codec.scan_blocks(body, data.shape, np.uint64, low=(4, 0, 0), high=(32, 8, 8), wanted=[7])) == []
    cut = list(codec.scan_blocks(body, data.shape, np.uint64, low=(22, 9, 9), high=(30, 10, 10)))
    assert [(b.low, b.size, b.palette.tolist(), b.index.tolist()) for b in cut] == [((22, 9, 9), (2, 1, 1), [8], [0, 0])]
    del unpacked[:]
    assert codec.labels(body, data.shape, np.uint64).tolist() == [0, 7, 8, (1 << 63) + 5] and codec.remap(body, {7: 9}, data.shape, np.uint64, preserve_missing=True) != body and not unpacked


def test_stored_odds(spark, tmp_path):
    # a raw chunk whose first bytes are those of a gzip file is no gzip file
    data = np.full((8, 8, 8), 0x8B1F, np.uint16)
    volume.from_numpy(spark, data, str(tmp_path / "a"), chunk=(8, 8, 8), compress=None)
    assert volume.read_volume(spark, str(tmp_path / "a")).count() == 512
    for compress in ("xz", "zstd"):
        volume.from_numpy(spark, data, str(tmp_path / compress), chunk=(8, 8, 8), compress=compress)
        assert volume.read_volume(spark, str(tmp_path / compress)).count() == 512
    body = bytes(np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8))
    crc = 0xFFFFFFFF
    for b in body:
        crc = int(formats._CRC[(crc ^ b) & 0xFF]) ^ (crc >> 8)
    assert formats.crc32c(body) == crc ^ 0xFFFFFFFF
    spec = ShardSpec(0, 2, 0)
    items = {k: b"x" * (k % 7) for k in range(3000)}
    (tmp_path / "0.shard").write_bytes(formats.shard_body(items, spec))
    began = time.time()
    assert dict(formats.shard_items(Path(str(tmp_path / "0.shard")), spec, list(items))) == items and time.time() - began < 5
    ranges = formats.shard_ranges(Path(str(tmp_path / "0.shard")), spec, [5, 9999])
    assert ranges[9999] is None and ranges[5][1] - ranges[5][0] == 5
    assert formats.fill_of("NaN", np.dtype("f4")) != formats.fill_of("NaN", np.dtype("f4")) and formats.fill_of("0x3f800000", np.dtype("f4")) == 1 and formats.fill_of(None, np.dtype("u2")) == 0


def test_registered_format(spark, tmp_path):
    volume.from_numpy(spark, np.full((4, 4, 4), 6, np.uint8), str(tmp_path / "a"), chunk=(4, 4, 4))
    formats.register_format("mine", lambda path, mip: formats.open_volume(str(tmp_path / path.uri), mip))
    assert formats.open_volume("mine://a").scale.size == (4, 4, 4)
    with pytest.raises(NotImplementedError):
        formats.open_volume("none://a")
    del formats.OPENERS["mine"]


def test_transfer_strategies():
    from dataclasses import replace

    v = formats.Volume(Path("/nowhere"), "precomputed", SCALE)
    shards = ShardSpec(1, 1, 1).as_dict()
    assert [volume.transfer_strategy(v, replace(SCALE, **c)) for c in ({}, {"sharding": shards}, {"encoding": "raw"}, {"chunk": (8, 8, 8)})] == ["copy", "copy", "transcode", "render"]
    assert volume.transfer_strategy(v, SCALE, (-5, 7, 0), (11, 23, 8)) == "copy" and volume.transfer_strategy(v, SCALE, (-5, 7, 0), (10, 23, 8)) == "render"
