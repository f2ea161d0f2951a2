"""Reading and writing volumes as relations of voxels, blocks or encoded chunks, by Spark data sources and chunk-wise writers."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from voxlake.functions import codec
from voxlake.functions.geometry import floor_div, in_box
from voxlake.operators.components import cut
from voxlake.operators.grid import chunks as grid_chunks
from voxlake.operators.shards import shard_shape
from voxlake.sources.formats import SUFFIXES, MissingChunk, OutOfBounds, Path, Scale, ShardSpec, Volume, chunk_file, follow, grid_places, merged_info, morton_code, morton_codes, morton_place, open_volume, resharded, shard_body, shard_table

#: A read task has about so many voxels.
TASK_VOXELS = 8 << 20
#: A scan has at most about so many tasks; they grow beyond it.
MOST_TASKS = 50_000
#: Boxes of at most so many chunks of a hashed sharding are looked up one by one.
FEW_CHUNKS = 100_000


class Tile(InputPartition):
    """A box of the chunk grid."""

    def __init__(self, low: Sequence[int], high: Sequence[int]) -> None:
        self.low, self.high = tuple(low), tuple(high)

    def places(self, volume: Volume, low: Sequence[int], high: Sequence[int]) -> list[tuple[int, ...]]:
        return list(map(tuple, grid_places(self.low, self.high).tolist()))


class Shard(InputPartition):
    """The chunks of one shard's file that are in a box of the chunk grid, named if they were looked up."""

    def __init__(self, name: str, named: list[tuple[int, ...]] | None = None) -> None:
        self.name, self.named = name, named

    def places(self, volume: Volume, low: Sequence[int], high: Sequence[int]) -> list[tuple[int, ...]]:
        if self.named is not None:
            return self.named
        stored = (morton_place(k, volume.scale.grid) for _, k, _, _ in shard_table(volume.path / volume.scale.key / self.name, volume.spec()))
        return [g for g in stored if all(a <= p < b for p, a, b in zip(g, low, high, strict=True))]


class ChunkReader(DataSourceReader):
    """What the readers of voxels, blocks and encoded chunks have in common: which chunks a task reads.

    Comparisons of the axes' columns with numbers are pushed down: chunks outside of them are never read. The driver
    never lists chunks: it deals out tiles of the grid, which are whole shards if the volume is sharded, so that each index
    is read once.
    """

    axes = ("x", "y", "z")
    #: Whether a row's column is where a chunk's part begins, so that it says nothing on where the part ends.
    begins = False

    def __init__(self, options: dict[str, str]) -> None:
        self.volume = open_volume(options["path"], int(options.get("mip", "0")))
        self.fill = options.get("fill_missing", "true").lower() == "true"
        self.low, self.high = list(self.volume.scale.offset), list(self.volume.scale.end)
        self.task_voxels = int(options.get("task_voxels", str(TASK_VOXELS)))
        for side, pick in (("low", max), ("high", min)):
            if options.get(side):
                own = [int(x) for x in options[side].split(",")]
                setattr(self, side, [pick(a, b) for a, b in zip(getattr(self, side), own, strict=True)])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            axis = self.axes.index(f.attribute[0]) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute[0] in self.axes else -1
            if axis >= 0 and isinstance(f.value, int):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) and not self.begins:
                    self.low[axis] = max(self.low[axis], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.limit(axis, f.value + (not isinstance(f, LessThan)))
            yield f  # Spark filters the rows of the chunks at the border

    def limit(self, axis: int, high: int) -> None:
        self.high[axis] = min(self.high[axis], high)

    def span(self) -> tuple[list[int], list[int]]:
        """The box of the chunk grid that is read."""
        s = self.volume.scale
        return [(a - o) // c for a, o, c in zip(self.low, s.offset, s.chunk, strict=True)], [-((o - b) // c) for b, o, c in zip(self.high, s.offset, s.chunk, strict=True)]

    def partitions(self) -> Sequence[InputPartition]:
        s, spec = self.volume.scale, self.volume.spec()
        if any(b <= a for a, b in zip(self.low, self.high, strict=True)):
            return []
        low, high = self.span()
        if spec and spec.hash != "identity":
            if int(np.prod([b - a for a, b in zip(low, high, strict=True)])) > FEW_CHUNKS and self.fill:
                return [Shard(spec.name(k)) for k in range(1 << spec.shard_bits)]
            named: dict[str, list] = {}
            places = grid_places(low, high)
            for name, g in zip(spec.names(morton_codes(places, s.grid)), places.tolist(), strict=True):
                named.setdefault(name, []).append(tuple(g))
            return [Shard(*x) for x in named.items()]
        bits = spec.preshift_bits + spec.minishard_bits if spec else max(1, self.task_voxels // int(np.prod(s.chunk))).bit_length() - 1
        while True:
            shape = shard_shape(s.grid, bits)
            first, last = [a // n for a, n in zip(low, shape, strict=True)], [-(-b // n) for b, n in zip(high, shape, strict=True)]
            if int(np.prod([b - a for a, b in zip(first, last, strict=True)])) <= MOST_TASKS or all(n >= g for n, g in zip(shape, s.grid, strict=True)):
                break
            bits += 1
        out = []
        for t in itertools.product(*(range(a, b) for a, b in zip(reversed(first), reversed(last), strict=True))):
            at = [k * n for k, n in zip(reversed(t), shape, strict=True)]
            out.append(Tile([max(a, lo) for a, lo in zip(at, low, strict=True)], [min(a + n, hi) for a, n, hi in zip(at, shape, high, strict=True)]))
        return out

    def places(self, partition: InputPartition) -> list[tuple[int, ...]]:
        return partition.places(self.volume, *self.span())

    def missing(self, g: Sequence[int]) -> None:
        if not self.fill:
            raise MissingChunk(f"{chunk_file(self.volume.scale, g)} isn't stored")


def as_long(labels: np.ndarray) -> np.ndarray:
    """Labels as a BIGINT column has them: of 2**63 and above their bit patterns."""
    return labels.view(np.int64) if labels.dtype == np.uint64 else labels.astype(np.int64)


def is_float(scale: Scale) -> bool:
    return np.dtype(scale.dtype).kind == "f"


class VolumeReader(ChunkReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        float_ = is_float(self.volume.scale)
        for g, low, data in self.volume.read_box(self.places(partition), self.low, self.high):
            if data is None:
                self.missing(g)
                continue
            x, y, z, c = np.nonzero(data)
            labels = data[x, y, z, c]
            yield pa.RecordBatch.from_arrays([pa.array(x + low[0]), pa.array(y + low[1]), pa.array(z + low[2]), pa.array(c.astype(np.int32)), pa.array(labels.astype(np.float64) if float_ else as_long(labels))], ["x", "y", "z", "c", "label"])


class VolumeSource(DataSource):
    """spark.read.format("volume").option("path", ...).option("mip", ...).load()

    path may begin with precomputed://, zarr2://, zarr3://, zarr://, n5:// or another registered format. With fill_missing
    false, a chunk that isn't stored is an error; else it has the format's fill value, 0 if it has none. A volume of
    floats has a label of type double, others of type long; labels of 2**63 and above are their bit patterns.
    """

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        kind = "double" if is_float(open_volume(self.options["path"], int(self.options.get("mip", "0"))).scale) else "long"
        return f"x long, y long, z long, c int, label {kind}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VolumeReader(self.options)


class BlockReader(ChunkReader):
    axes = ("x0", "y0", "z0")
    begins = True

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.labels = [int(x) for x in options["labels"].split(",")] if options.get("labels") else None
        self.box = list(self.low), list(self.high)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        s, v = self.volume.scale, self.volume
        places = self.places(partition)
        for g, body in v.bodies(places) if v.format == "precomputed" else v.read(places):
            if body is None and (body := v.absent(g)) is None:
                self.missing(g)
                continue
            if not isinstance(body, bytes) or s.encoding != "palette":
                data = body if isinstance(body, np.ndarray) else v.decode(g, body)
                body = codec.compress(data.astype(np.uint32 if s.dtype == "uint32" else np.uint64), s.block)
            a, b = s.bounds(g)
            inner = [[max(p, lo) - p for p, lo in zip(a, self.box[0], strict=True)], [min(q, hi) - p for p, q, hi in zip(a, b, self.box[1], strict=True)]]
            found = list(codec.scan_blocks(body, v.shape(g), "uint32" if s.dtype == "uint32" else "uint64", s.block, *inner, self.labels))
            if not found:
                continue
            per = [-(-n // k) for n, k in zip(s.chunk, s.block, strict=True)]
            columns = [[f.low[k] // s.block[k] + g[k] * per[k] for f in found] for k in range(3)] + [[f.low[k] + a[k] for f in found] for k in range(3)]
            sizes = [[f.size[k] for f in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in columns), *(pa.array(x, pa.int32()) for x in sizes), pa.array([f.channel for f in found], pa.int32()), pa.array([as_long(f.palette) for f in found], pa.list_(pa.int64())), pa.array([f.bits for f in found], pa.int64()), pa.array([f.index for f in found], pa.list_(pa.int32()))],
                ["bx", "by", "bz", "x0", "y0", "z0", "nx", "ny", "nz", "c", "palette", "bits", "idx"],
            )


class BlockSource(DataSource):
    """spark.read.format("volume_blocks").option("path", ...).option("labels", "7,9").option("low", "0,0,0").option("high", ...).load()

    A row is a block of the palette codec: (bx, by, bz) counts blocks from the volume's corner, (x0, y0, z0) is its first voxel and
    (nx, ny, nz) its extent; palette and idx, x fastest, are as the operators of blocks have them. With labels, only blocks that have one
    of them, by their palettes, are unpacked at all. Blocks that the box cuts are made anew from what is inside, and
    blocks of background alone are left out. Volumes in other encodings are cut into blocks when they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "volume_blocks"

    def schema(self) -> str:
        return "bx long, by long, bz long, x0 long, y0 long, z0 long, nx int, ny int, nz int, c int, palette array<long>, bits long, idx array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(self.options)


class BodyReader(ChunkReader):
    axes = ("gx", "gy", "gz")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from filters

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for g, body in self.volume.bodies(self.places(partition)):
            if body is None:
                self.missing(g)
                continue
            yield pa.RecordBatch.from_arrays([*(pa.array([k]) for k in g), pa.array([chunk_file(self.volume.scale, g)]), pa.array([body], pa.large_binary()).cast(pa.binary())], ["gx", "gy", "gz", "name", "content"])


class BodySource(DataSource):
    """spark.read.format("volume_chunks"): (gx, gy, gz, name, content) of stored chunks of a precomputed volume, as they are encoded."""

    @classmethod
    def name(cls) -> str:
        return "volume_chunks"

    def schema(self) -> str:
        return "gx long, gy long, gz long, name string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        reader = BodyReader(self.options)
        if reader.volume.format != "precomputed":
            raise ValueError("only precomputed volumes have encoded chunks")
        return reader


def register(spark: SparkSession) -> None:
    for source in (VolumeSource, BlockSource, BodySource):
        spark.dataSource.register(source)
    # a Python source gets its filters pushed down only if this is on
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _triple(t: Sequence[int]) -> str:
    return ",".join(str(int(x)) for x in t)


def _checked(path: str, mip: int, low: Sequence[int] | None, high: Sequence[int] | None, bounded: bool = True) -> Scale:
    scale = open_volume(path, mip).scale
    if low is not None and bounded and any(a < o or b > e or a > b for a, b, o, e in zip(low, high, scale.offset, scale.end, strict=True)):
        raise OutOfBounds(f"{tuple(low)} - {tuple(high)} isn't in {scale.offset} - {scale.end}")
    return scale


def _source(spark: SparkSession, kind: str, path: str, mip: int, low: Sequence[int] | None, high: Sequence[int] | None, **options: str) -> DataFrame:
    register(spark)
    box = {} if low is None else {"low": _triple(low), "high": _triple(high)}
    return spark.read.format(kind).options(path=path, mip=str(mip), **box, **options).load()


def read_volume(spark: SparkSession, path: str, mip: int = 0, low: Sequence[int] | None = None, high: Sequence[int] | None = None, bounded: bool = True, fill_missing: bool = True) -> DataFrame:
    """Voxels of a volume, or of a box of it. A box beyond the volume is an error if bounded, else cut off."""
    _checked(path, mip, low, high, bounded)
    return _source(spark, "volume", path, mip, low, high, fill_missing=str(fill_missing))


def read_blocks(spark: SparkSession, path: str, mip: int = 0, low: Sequence[int] | None = None, high: Sequence[int] | None = None, labels: Sequence[int] | None = None, bounded: bool = True) -> DataFrame:
    """Blocks of a volume, or of a box, that have one of the labels if some are named; see BlockSource."""
    _checked(path, mip, low, high, bounded)
    return _source(spark, "volume_blocks", path, mip, low, high, **({"labels": ",".join(str(int(k)) for k in labels)} if labels is not None else {}))


def block_voxels(b: DataFrame) -> DataFrame:
    """The voxels (x, y, z, c, label) of rows of read_blocks, without background."""
    rows = b.select("x0", "y0", "z0", "nx", "ny", "c", "palette", F.posexplode("idx").alias("p", "i")).select("*", F.element_at("palette", F.col("i") + 1).alias("label")).where("label <> 0")
    return rows.selectExpr("x0 + p % nx as x", "y0 + floor(p / nx) % ny as y", "z0 + floor(p / (nx * ny)) as z", "c", "label")


def read_chunks(spark: SparkSession, path: str, mip: int = 0, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> DataFrame:
    """Stored chunks that meet a box, as they are encoded; see BodySource."""
    _checked(path, mip, low, high)
    return _source(spark, "volume_chunks", path, mip, low, high)


def unique_stored(spark: SparkSession, path: str, mip: int = 0) -> DataFrame:
    """Distinct labels of a stored precomputed volume, background too where a chunk holds it: palettes answer without decoding."""
    v = open_volume(path, mip)
    s = v.scale

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gx, gy, gz, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(codec.encoded_labels(body, s.encoding, v.shape((gx, gy, gz)), s.dtype, s.block)))], ["label"])

    return read_chunks(spark, path, mip).select("gx", "gy", "gz", "content").mapInArrow(found, "label long").distinct()


def read_voxel(path: str, point: Sequence[int], mip: int = 0) -> np.ndarray:
    """All channels of one voxel, by one chunk's file or range."""
    return open_volume(path, mip).voxel(point)


def aligned(low: Sequence[int], high: Sequence[int], scale: Scale) -> bool:
    """Whether a box is whole chunks, but for the volume's end."""
    return all((a - o) % c == 0 and ((b - o) % c == 0 or b == e) for a, b, o, c, e in zip(low, high, scale.offset, scale.chunk, scale.end, strict=True))


class LockedScale(ValueError):
    pass


def read_info(base: Path) -> dict | None:
    body = (base / "info").read()
    return json.loads(codec.expand(body)) if body else None


def locked_scales(base: Path) -> set[str]:
    """Keys of the scales that mustn't be written."""
    return {s["key"] for s in (read_info(base) or {"scales": []})["scales"] if s.get("locked")}


def set_locked(path: str, keys: Sequence[str], locked: bool = True) -> None:
    """Lock scales against writing, or unlock them."""
    base = Path(path)
    info = read_info(base)
    for s in info["scales"]:
        if s["key"] in keys:
            s["locked"] = locked
    (base / "info").write(json.dumps(info).encode())


def write_info(path: str, scale: Scale, layer_type: str = "segmentation") -> None:
    """Put a scale into a layer's info file, beside the others; a locked one is an error."""
    base = Path(path)
    if scale.key in locked_scales(base):
        raise LockedScale(f"{scale.key} of {path} is locked")
    (base / "info").write(json.dumps(merged_info(read_info(base), scale, layer_type)).encode())


def set_sharding(path: str, key: str, spec: ShardSpec | None) -> None:
    """Attach sharding to a scale's metadata, or take it away; what is stored stays as it is."""
    base, info = follow(Path(path))
    if key in locked_scales(base):
        raise LockedScale(f"{key} of {path} is locked")
    (base / "info").write(json.dumps(resharded(info, key, spec)).encode())


CHUNK = "gx long, gy long, gz long, n_voxels long, content binary"
WRITTEN = "name string, n_voxels long"


def _whole(scale: Scale, g: Sequence[int]) -> np.ndarray:
    low, high = scale.bounds(g)
    return np.zeros((*[q - p for p, q in zip(low, high, strict=True)], scale.channels), scale.dtype, order="F")


def encoded_chunks(v: DataFrame, volume: Volume, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """(gx, gy, gz, n_voxels, content) of every chunk of the grid that meets the box, whether v has a voxel in it or not.

    A chunk that the box covers in part keeps what it has outside of it. Each is encoded by the task that has its voxels.
    """
    s = volume.scale
    edited = not aligned(low, high, s)
    kind = "double" if is_float(s) else "long"
    rows = v.select("x", "y", "z", F.col("c").cast("int") if "c" in v.columns else F.lit(0).alias("c"), F.col("label").cast(kind).alias("label")).where(in_box(low, high))
    rows = rows.select(*[floor_div(F.col(a) - o, c).alias(f"g{a}") for a, o, c in zip("xyz", s.offset, s.chunk, strict=True)], "x", "y", "z", "c", "label")
    # a row without a voxel for each chunk of the box: what isn't in v any more has to be written or deleted too
    every = grid_chunks(v.sparkSession, low, high, s.chunk, s.offset).select("gx", "gy", "gz", *[F.lit(None).cast("long").alias(a) for a in "xyz"], F.lit(None).cast("int").alias("c"), F.lit(None).cast(kind).alias("label"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        g = tuple(int(k.as_py()) for k in key)
        a, b = s.bounds(g)
        data = _whole(s, g)
        if edited and (old := dict(volume.read([g]))[g]) is not None:
            data[...] = old
            data[tuple(slice(max(p, lo) - p, max(0, min(q, hi) - p)) for p, q, lo, hi in zip(a, b, low, high, strict=True))] = 0
        table = table.filter(table.column("x").is_valid())
        if table.num_rows:
            at = [np.asarray(table.column(n)) - o for n, o in zip("xyz", a, strict=True)]
            values = np.asarray(table.column("label"))
            data[at[0], at[1], at[2], np.asarray(table.column("c"))] = values.view(np.uint64) if s.dtype == "uint64" else values.astype(s.dtype)
        n = int(np.count_nonzero(data))
        content = codec.encode(data, s.encoding, s.block) if volume.format == "precomputed" else plain_body(data, s, volume.format)
        return pa.table({f"g{k}": [x] for k, x in zip("xyz", g, strict=True)} | {"n_voxels": [n], "content": pa.array([content], pa.binary())})

    return rows.unionByName(every).groupBy("gx", "gy", "gz").applyInArrow(one, CHUNK)


def store_chunks(chunks: DataFrame, volume: Volume, compress: str | None = "gzip", delete_black: bool = True, keep: bool = True) -> DataFrame:
    """Store encoded chunks; returns (name, n_voxels) of the files written.

    A chunk without voxels is deleted if delete_black. Files are written beside and renamed into place, so that a task may run
    again on another executor. Of a shard, chunks that aren't among those given stay if keep.
    """
    s, spec, base = volume.scale, volume.spec(), volume.path
    if spec is None:
        suffix = {"gzip": ".gz", "xz": ".xz", "zstd": ".zst"}.get(compress or "", "") if volume.format == "precomputed" else ""

        def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, counts = [], []
                for gx, gy, gz, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    places = volume.files((gx, gy, gz))
                    stays = n or not delete_black
                    for file, other in zip(places, SUFFIXES if volume.format == "precomputed" else [""], strict=False):
                        if not stays or other != suffix:
                            file.delete()
                    if stays:
                        places[SUFFIXES.index(suffix)].write(codec.squeeze(body, compress) if volume.format == "precomputed" else body)
                        names.append(chunk_file(s, (gx, gy, gz)) if volume.format == "precomputed" else places[0].uri.removeprefix(base.uri).lstrip("/"))
                        counts.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["name", "n_voxels"])

        return cut(chunks.select("gx", "gy", "gz", "n_voxels", "content").mapInArrow(files, WRITTEN))

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        name, items = key[0].as_py(), {}
        if keep:
            from voxlake.sources.formats import shard_items

            items = dict(shard_items(base / s.key / name, spec))
        total = 0
        for gx, gy, gz, n, body in zip(*(table.column(c).to_pylist() for c in ("gx", "gy", "gz", "n_voxels", "content")), strict=True):
            code = morton_code((gx, gy, gz), s.grid)
            items.pop(code, None)
            if n or not delete_black:
                items[code] = body
                total += n
        if not items:
            (base / s.key / name).delete()
            return pa.table({"name": pa.array([], pa.string()), "n_voxels": pa.array([], pa.int64())})
        (base / s.key / name).write(shard_body(items, spec))
        return pa.table({"name": [name], "n_voxels": [total]})

    @F.arrow_udf("string")
    def names(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        return pa.array(spec.names(morton_codes(np.stack([np.asarray(a) for a in (x, y, z)], axis=1), s.grid)))

    return cut(chunks.withColumn("shard", names("gx", "gy", "gz")).groupBy("shard").applyInArrow(shard, WRITTEN))


def write_volume(v: DataFrame, path: str, scale: Scale, layer_type: str = "segmentation", compress: str | None = "gzip", delete_black: bool = True, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> DataFrame:
    """Write voxels (x, y, z, label[, c]) as a scale of a precomputed volume; returns (name, n_voxels) of the files written.

    Without a box the whole scale is made anew. With one, the box is: voxels that v lacks are background in it, and chunks that it covers in
    part keep what they have outside. Chunks left without a voxel are deleted if delete_black. Other scales of the layer, and
    the fields of its info file that this one doesn't set, stay.
    """
    if low is not None and any(a < o or b > e or a > b for a, b, o, e in zip(low, high, scale.offset, scale.end, strict=True)):
        raise OutOfBounds(f"{tuple(low)} - {tuple(high)} isn't in {scale.offset} - {scale.end}")
    write_info(path, scale, layer_type)
    volume = Volume(Path(path), "precomputed", scale)
    return store_chunks(encoded_chunks(v, volume, low or scale.offset, high or scale.end), volume, compress, delete_black, keep=low is not None)


def fill_box(spark: SparkSession, path: str, low: Sequence[int], high: Sequence[int], label: int, mip: int = 0, channel: int = 0, **options) -> DataFrame:
    """Give all voxels of a box one label, 0 for background."""
    scale = open_volume(path, mip).scale
    nx, ny, nz = (b - a for a, b in zip(low, high, strict=True))
    n = nx * ny * nz if label else 0
    at = spark.range(n).selectExpr(f"id % {max(nx, 1)} + {low[0]} as x", f"floor(id / {max(nx, 1)}) % {max(ny, 1)} + {low[1]} as y", f"floor(id / {max(nx * ny, 1)}) + {low[2]} as z", f"{channel} as c", f"{label} as label")
    return write_volume(at, path, scale, low=low, high=high, **options)


# zarr


def plain_body(data: np.ndarray, scale: Scale, kind: str) -> bytes:
    """A chunk as zarr stores it: filled up to the chunk's size, z first."""
    import gzip

    full = np.full(scale.chunk, scale.more["fill"], scale.dtype)
    full[tuple(slice(0, n) for n in data.shape[:3])] = data[..., 0]
    body = np.ascontiguousarray(full.T).astype(np.dtype(scale.dtype).newbyteorder("<")).tobytes()
    return gzip.compress(body, mtime=0) if scale.more["gzip"] else body


def zarr_scale(scale: Scale, version: int = 2, gzip: bool = True, fill: float = 0) -> Scale:
    """A scale of one channel as a zarr array stores it."""
    if scale.channels != 1:
        raise ValueError("zarr arrays are written with one channel")
    dtype = np.dtype(scale.dtype)
    more = {"format": f"zarr{version}", "fill": dtype.type(fill), "gzip": gzip, "rank": 3, "order_dtype": dtype.newbyteorder("<").str, "channel_chunk": 1}
    if version == 2:
        more |= {"codec": "gzip" if gzip else "raw", "order": "C", "separator": "."}
    else:
        more |= {"codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": "gzip", "configuration": {"level": 9}}] if gzip else [])], "separator": "/", "prefix": "c/"}
    return replace(scale, encoding="raw", sharding=None, more=more)


def write_zarr(v: DataFrame, path: str, scale: Scale, version: int = 2, gzip: bool = True, fill: float = 0, low: Sequence[int] | None = None, high: Sequence[int] | None = None, delete_black: bool = True) -> DataFrame:
    """Write voxels as a zarr array, or a box of one; as write_volume does otherwise. With a fill value other than 0 all chunks are stored."""
    base, s = Path(path), zarr_scale(scale, version, gzip, fill)
    at = base / s.key if s.key else base
    attrs = {"resolution": list(s.resolution), "offset": list(s.offset)}
    number = s.more["fill"].item()
    if version == 2:
        (at / ".zarray").write(json.dumps({"zarr_format": 2, "shape": list(s.size[::-1]), "chunks": list(s.chunk[::-1]), "dtype": s.more["order_dtype"], "compressor": {"id": "gzip", "level": 9} if gzip else None, "fill_value": number, "order": "C", "filters": None}).encode())
        (at / ".zattrs").write(json.dumps(attrs).encode())
    else:
        grid = {"name": "regular", "configuration": {"chunk_shape": list(s.chunk[::-1])}}
        (at / "zarr.json").write(json.dumps({"zarr_format": 3, "node_type": "array", "shape": list(s.size[::-1]), "data_type": np.dtype(s.dtype).name, "chunk_grid": grid, "chunk_key_encoding": {"name": "default"}, "codecs": s.more["codecs"], "fill_value": number, "attributes": attrs}).encode())
    volume = Volume(base, f"zarr{version}", s)
    return store_chunks(encoded_chunks(v, volume, low or s.offset, high or s.end), volume, None, delete_black and fill == 0)


def from_numpy(spark: SparkSession, data: np.ndarray, path: str, resolution: Sequence[float] = (1, 1, 1), offset: Sequence[int] = (0, 0, 0), chunk: Sequence[int] = (64, 64, 64), encoding: str = "raw", layer_type: str | None = None, compress: str | None = "gzip", **more) -> Volume:
    """A precomputed volume of an array [x, y, z] or [x, y, z, channel] of the driver."""
    from voxlake.sources.formats import scale_key

    data = data[..., None] if data.ndim == 3 else data
    scale = Scale(scale_key(resolution), data.dtype.name, data.shape[:3], tuple(offset), tuple(chunk), tuple(resolution), encoding, data.shape[3], **more)
    write_info(path, scale, layer_type or ("segmentation" if data.dtype.kind == "u" and data.dtype.itemsize > 2 else "image"))
    volume = Volume(Path(path), "precomputed", scale)
    rows = []
    for g in grid_places((0, 0, 0), scale.grid).tolist():
        a, b = scale.bounds(g)
        part = data[tuple(slice(p - o, q - o) for p, q, o in zip(a, b, offset, strict=True))]
        rows.append((*g, int(np.count_nonzero(part)), codec.encode(np.asfortranarray(part), encoding, scale.block)))
    store_chunks(spark.createDataFrame(rows, CHUNK), volume, compress, keep=False)
    return volume


# what is stored


def stored_chunks(spark: SparkSession, path: str, mip: int = 0, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> DataFrame:
    """(gx, gy, gz, name, stored) of the chunks that meet a box, all of an unsharded volume's files being looked for by tasks."""
    v = open_volume(path, mip)
    s = v.scale
    if v.spec():
        raise ValueError("only unsharded volumes; see shard_ranges")
    places = grid_chunks(spark, low or s.offset, high or s.end, s.chunk, s.offset).select("gx", "gy", "gz")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([chunk_file(s, g) for g in at], pa.string()), pa.array([any(f.exists() for f in v.files(g)) for g in at], pa.bool_())], ["gx", "gy", "gz", "name", "stored"])

    return places.mapInArrow(look, "gx long, gy long, gz long, name string, stored boolean")


def delete_box(spark: SparkSession, path: str, low: Sequence[int], high: Sequence[int], mip: int = 0) -> int:
    """Delete the chunk files of an aligned box of an unsharded volume; how many grid places that were."""
    v = open_volume(path, mip)
    s = v.scale
    if v.spec() or not aligned(low, high, s):
        raise ValueError("only whole chunks of an unsharded volume")
    if s.key in locked_scales(v.path):
        raise LockedScale(f"{s.key} of {path} is locked")
    places = grid_chunks(spark, low, high, s.chunk, s.offset).select("gx", "gy", "gz")

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for file in v.files(g):
                    file.delete()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return places.mapInArrow(gone, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def transfer_strategy(source: Volume, new: Scale, low: Sequence[int] | None = None, high: Sequence[int] | None = None) -> str:
    """How a transfer is done: `copy` of encoded chunks, `transcode` chunk by chunk, or `render` by voxels.

    Chunks are copied or transcoded where both grids are the same and the box is whole chunks. Sharding on either side makes
    no difference: chunks leave a shard, or gather in one, as they are.
    """
    s = source.scale
    same = all(getattr(s, k) == getattr(new, k) for k in ("dtype", "size", "offset", "chunk", "channels"))
    if source.format != "precomputed" or not same or low is not None and not aligned(low, high, s):
        return "render"
    return "copy" if s.encoding == new.encoding and (s.encoding != "palette" or s.block == new.block) else "transcode"


def transfer(spark: SparkSession, source: str, target: str, mip: int = 0, low: Sequence[int] | None = None, high: Sequence[int] | None = None, compress: str | None = "gzip", **changes) -> DataFrame:
    """Copy a volume, or a box of it, into a precomputed one whose scale is the source's with changes: encoding, chunk, sharding, ...

    The volume is neither decoded nor shuffled as voxels where transfer_strategy finds another way.
    """
    v = open_volume(source, mip)
    scale = v.scale
    new = replace(scale, **({"key": scale.key or "1_1_1", "more": {}} | changes))
    how = transfer_strategy(v, new, low, high)
    if how == "render":
        return write_volume(read_volume(spark, source, mip, low, high), target, new, compress=compress, low=low, high=high)
    write_info(target, new)
    rows = read_chunks(spark, source, mip, low, high).select("gx", "gy", "gz", "content")

    def transcoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            bodies = batch.column(3).to_pylist()
            if how == "transcode":
                bodies = [codec.encode(v.decode(g, b), new.encoding, new.block) for g, b in zip(places, bodies, strict=True)]
            # what is stored counts as having voxels: it isn't looked into
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([1] * len(bodies), pa.int64()), pa.array(bodies, pa.binary())], ["gx", "gy", "gz", "n_voxels", "content"])

    return store_chunks(rows.mapInArrow(transcoded, CHUNK), Volume(Path(target), "precomputed", new), compress, keep=low is not None).select("name")


def remap_stored(spark: SparkSession, source: str, target: str, mapping: dict[int, int], mip: int = 0, preserve_missing: bool = True, compress: str | None = "gzip") -> DataFrame:
    """Copy a precomputed volume with its labels mapped; of palettes only the palettes are rewritten. Returns the names written.

    A label without a target stays, or is an error. The mapping goes to every task: it is the driver's own table.
    """
    v = open_volume(source, mip)
    s = v.scale
    write_info(target, s)
    shared = spark.sparkContext.broadcast(mapping)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            bodies = [codec.encoded_remap(b, s.encoding, shared.value, v.shape(g), s.dtype, s.block, preserve_missing) for g, b in zip(places, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([1] * len(bodies), pa.int64()), pa.array(bodies, pa.binary())], ["gx", "gy", "gz", "n_voxels", "content"])

    rows = read_chunks(spark, source, mip).select("gx", "gy", "gz", "content").mapInArrow(mapped, CHUNK)
    return store_chunks(rows, Volume(Path(target), "precomputed", s), compress, keep=False).select("name")
