"""Candidate lists, mesh files, skeleton files and provenance as relations."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.sources.formats import Path


def candidates(spark: SparkSession, path: str, grid: float = 4.0) -> DataFrame:
    """(case_id, i1, i2, cx, cy, cz) of a CSV with i1, i2 and f_vector "x,y,z" or "[x, y, z]"; points go to the nearest multiple of grid, an even one if two are as near."""
    rows = spark.read.schema("i1 long, i2 long, f_vector string, placeholder1 int, placeholder2 int").option("header", True).csv(path)
    part = F.split(F.regexp_replace("f_vector", r"[\[\]\s]", ""), ",")
    return rows.select(F.monotonically_increasing_id().alias("case_id"), "i1", "i2", *[(F.rint(part[k].cast("double") / grid) * grid).cast("long").alias(n) for k, n in enumerate(("cx", "cy", "cz"))])


def mesh_bytes(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A legacy mesh fragment: the number of vertices, their coordinates, the faces."""
    return struct.pack("<I", len(vertices)) + vertices.astype("<f4").tobytes() + faces.astype("<u4").tobytes()


def mesh_arrays(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack("<I", body[:4])[0]
    if len(body) < 4 + 12 * n or (len(body) - 4 - 12 * n) % 12:
        raise ValueError("a mesh fragment is cut off")
    return np.frombuffer(body, "<f4", 3 * n, 4).reshape(n, 3), np.frombuffer(body, "<u4", offset=4 + 12 * n).reshape(-1, 3)


def obj_text(vertices: np.ndarray, faces: np.ndarray) -> str:
    return "".join(f"v {x:g} {y:g} {z:g}\n" for x, y, z in vertices.tolist()) + "".join(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in faces.tolist())


def obj_arrays(text: str) -> tuple[np.ndarray, np.ndarray]:
    v, f = [], []
    for line in text.splitlines():
        p = line.split()
        if p[:1] == ["v"]:
            v.append([float(x) for x in p[1:4]])
        elif p[:1] == ["f"]:
            f.append([int(x.split("/")[0]) - 1 for x in p[1:4]])
    return np.array(v, np.float32).reshape(-1, 3), np.array(f, np.uint32).reshape(-1, 3)


_MESH_ROWS = "path string, kind string, id long, a double, b double, c double"


def _mesh_rows(path: str, body: bytes) -> Iterator[pa.RecordBatch]:
    v, f = obj_arrays(body.decode()) if path.endswith(".obj") else ply_arrays(body) if path.endswith(".ply") else mesh_arrays(body)
    for kind, rows in (("vertex", v), ("face", f)):
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(np.arange(n)), *[pa.array(rows[:, k].astype(np.float64)) for k in range(3)]], ["path", "kind", "id", "a", "b", "c"])


def read_meshes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, kind, id, a, b, c) of mesh fragments, obj and ply files: vertices with coordinates, faces with corners."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _mesh_rows(path, body)

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(parse, _MESH_ROWS)


def read_label_meshes(path: str, labels: DataFrame, lod: int = 0) -> DataFrame:
    """(path, kind, id, a, b, c) of all fragments of labels (label), found by their manifests; labels without one have none.

    Fragments' names may hold colons, which Spark's own file sources can't read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in mesh_fragments(path, batch.column(0).to_pylist(), lod).values():
                for name in names or []:
                    yield from _mesh_rows(name, (Path(path) / name).read())

    return labels.select(F.col("label").cast("long")).distinct().mapInArrow(read, _MESH_ROWS)


def ply_bytes(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """Binary little-endian PLY."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(len(faces), [("n", "u1"), ("v", "<i4", 3)])
    rows["n"], rows["v"] = 3, faces
    return head.encode() + vertices.astype("<f4").tobytes() + rows.tobytes()


def ply_arrays(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of PLY as ply_bytes writes it, or in ASCII with triangles."""
    head, _, rest = body.partition(b"end_header\n")
    lines = head.decode().splitlines()
    n, m = (next(int(x.split()[2]) for x in lines if x.startswith(f"element {k} ")) for k in ("vertex", "face"))
    if any("ascii" in x for x in lines[:2]):
        rows = rest.decode().split("\n")
        return np.array([x.split()[:3] for x in rows[:n]], np.float32).reshape(-1, 3), np.array([x.split()[1:4] for x in rows[n : n + m]], np.uint32).reshape(-1, 3)
    faces = np.frombuffer(rest, [("n", "u1"), ("v", "<i4", 3)], m, 12 * n)
    if (faces["n"] != 3).any():
        raise ValueError("only triangles")
    return np.frombuffer(rest, "<f4", 3 * n).reshape(n, 3), faces["v"].astype(np.uint32)


def put_mesh(path: str, label: int, parts: list[tuple[np.ndarray, np.ndarray]], lod: int = 0) -> list[str]:
    """Store a label's fragments and its manifest in a folder of meshes; returns the fragments' names."""
    names = [f"{label}:{lod}:{k}" for k in range(len(parts))]
    for name, (v, f) in zip(names, parts, strict=True):
        (Path(path) / name).write(mesh_bytes(v, f))
    (Path(path) / f"{label}:{lod}").write(json.dumps({"fragments": names}).encode())
    return names


def mesh_fragments(path: str, labels: list[int], lod: int = 0) -> dict[int, list[str] | None]:
    """Each label's fragments by its manifest, None where it has none."""
    found = {k: (Path(path) / f"{k}:{lod}").read() for k in labels}
    return {k: None if b is None else json.loads(b)["fragments"] for k, b in found.items()}


def delete_mesh(path: str, label: int, lod: int = 0) -> None:
    for name in mesh_fragments(path, [label], lod)[label] or []:
        (Path(path) / name).delete()
    (Path(path) / f"{label}:{lod}").delete()


def swc_arrays(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, edges, radii, types) of SWC text; nodes are numbered in the order that they come in."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    place = {int(r[0]): k for k, r in enumerate(rows)}
    edges = [(place[int(r[0])], place[int(r[6])]) for r in rows if int(r[6]) != -1]
    return np.array([[float(x) for x in r[2:5]] for r in rows], np.float32).reshape(-1, 3), np.array(edges, np.uint32).reshape(-1, 2), np.array([float(r[5]) for r in rows], np.float32), np.array([int(r[1]) for r in rows], np.uint8)


def swc_text(vertices: np.ndarray, edges: np.ndarray, radii: np.ndarray | None = None, types: np.ndarray | None = None) -> str:
    """SWC text: each tree from its first vertex; loops are an error, since a node has one parent."""
    around: dict[int, list[int]] = {}
    for a, b in edges.tolist():
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    parent: dict[int, int] = {}
    order = []
    for root in range(len(vertices)):
        if root in parent:
            continue
        parent[root], todo = -1, [root]
        while todo:
            x = todo.pop()
            order.append(x)
            for y in sorted(around.get(x, ()), reverse=True):
                if y == parent[x]:
                    continue
                if y in parent:
                    raise ValueError("the skeleton has a loop")
                parent[y] = x
                todo.append(y)
    new = {x: k + 1 for k, x in enumerate(order)}
    line = lambda x: f"{new[x]} {0 if types is None else int(types[x])} {' '.join(f'{c:g}' for c in vertices[x].tolist())} {-1 if radii is None else float(radii[x]):g} {new.get(parent[x], -1)}"
    return "\n".join(map(line, order)) + "\n" if order else ""


def skeleton_bytes(vertices: np.ndarray, edges: np.ndarray) -> bytes:
    return struct.pack("<II", len(vertices), len(edges)) + vertices.astype("<f4").tobytes() + edges.astype("<u4").tobytes()


def skeleton_arrays(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = struct.unpack("<II", body[:8])
    if len(body) < 8 + 12 * n + 8 * m:
        raise ValueError("a skeleton is cut off")
    return np.frombuffer(body, "<f4", 3 * n, 8).reshape(n, 3), np.frombuffer(body, "<u4", 2 * m, 8 + 12 * n).reshape(m, 2)


def read_spatial_index(spark: SparkSession, glob: str) -> DataFrame:
    """(name, label, box) of .spatial files."""
    from voxlake.operators.spatial import from_json

    files = spark.read.format("binaryFile").load(glob)
    return from_json(files.select(F.regexp_extract("path", r"([^/]+)\.spatial$", 1).alias("name"), F.decode("content", "utf-8").alias("content")))


PROVENANCE = ("description", "owners", "processing", "sources")


def write_provenance(path: str, description: str = "", owners: list[str] | None = None, processing: list[dict] | None = None, sources: list[str] | None = None) -> None:
    (Path(path) / "provenance").write(json.dumps(dict(zip(PROVENANCE, (description, owners or [], processing or [], sources or []), strict=True))).encode())


def read_provenance(path: str) -> dict:
    body = (Path(path) / "provenance").read()
    return json.loads(body) if body else {k: [] if k != "description" else "" for k in PROVENANCE}
