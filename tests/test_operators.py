"""Voxel, block, mesh, graph and shard operators against plain Python on small volumes, and goldens."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import api, cli
from voxlake.functions import geometry
from voxlake.operators import blocks, components, graph, mesh, shards, spatial, voxels
from voxlake.sources import tables

V = "x long, y long, z long, label long"


@pytest.fixture(scope="module")
def cube(spark):
    data = np.random.default_rng(3).integers(0, 4, (14, 11, 9)) * (np.random.default_rng(4).random((14, 11, 9)) < 0.5)
    rows = [(*map(int, p), int(data[tuple(p)])) for p in np.argwhere(data)]
    return data, spark.createDataFrame(rows, V).cache()


def rows(df):
    return {tuple(r) for r in df.collect()}


def flood(cells, seed):
    out, todo = set(), [seed]
    while todo:
        p = todo.pop()
        if p in cells and p not in out:
            out.add(p)
            todo += [tuple(a + d for a, d in zip(p, o)) for o in itertools.product((-1, 0, 1), repeat=3)]
    return out


def test_components_agree_with_flood_fill(cube):
    data, v = cube
    cells = {tuple(map(int, p)) for p in np.argwhere(data == 2)}
    got = {}
    for r in voxels.components(v.where("label = 2")).collect():
        got.setdefault(r.component, set()).add((r.x, r.y, r.z))
    want, left = set(), set(cells)
    while left:
        c = flood(cells, min(left))
        want.add(frozenset(c))
        left -= c
    assert {frozenset(c) for c in got.values()} == want
    xyz = np.array(sorted(cells))
    root = voxels.label_26(xyz)
    assert {frozenset(map(tuple, xyz[root == k].tolist())) for k in set(root)} == want


def test_components_of_odd_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    e = spark.createDataFrame([(1, 2), (2, 1), (5, 5), (None, 3), (4, None)] + [(k, k + 1) for k in range(100, 160)], "src long, dst long")
    assert rows(components.connected_components(e)) == {(1, 1), (2, 1), (5, 5)} | {(k, 100) for k in range(100, 161)}


@pytest.mark.parametrize("tie", ["block", "c"])
def test_nearest(cube, tie):
    data, v = cube
    center = (6, 5, 4)
    cells = [tuple(map(int, p)) for p in np.argwhere(data == 1) if tuple(p) != center]
    d2 = lambda p: sum((a - b) ** 2 for a, b in zip(p, center))
    order = (lambda p: (d2(p), [c // 8 for c in p[::-1]], [c % 8 for c in p[::-1]])) if tie == "block" else (lambda p: (d2(p), p))
    best = min(cells, key=order)
    r = voxels.nearest(v.where("label = 1"), center, tie=tie).first()
    assert (r.x, r.y, r.z) == best and r.n_nearest == sum(d2(p) == d2(best) for p in cells)
    assert voxels.nearest(v.where("false"), center).collect() == []


def test_boundary_and_clouds(spark, cube):
    data, v = cube
    cells = {tuple(map(int, p)) for p in np.argwhere(data)}
    edge = lambda c: {p for p in c if any((p[0] + a, p[1] + b, p[2]) not in c for a, b in voxels.PLANE)}
    assert rows(voxels.boundary(v).select("x", "y", "z")) == edge(cells)
    cases = spark.createDataFrame([(1, 1, 2, 6, 5, 4), (2, 3, 3, 2, 2, 2), (3, 9, 1, 0, 0, 0)], "case_id long, seg1 long, seg2 long, cx long, cy long, cz long")
    want = set()
    for case, s1, s2, *c in cases.collect():
        for leg, seg in ((0, s1), (1, s2)):
            own = {tuple(map(int, p)) for p in np.argwhere(data == seg) if all(k - h <= a < k + h for a, k, h in zip(p, c, (4, 3, 5)))}
            near = sorted((p for p in own if list(p) != c), key=lambda p: (sum((a - b) ** 2 for a, b in zip(p, c)), [k // 8 for k in p[::-1]], [k % 8 for k in p[::-1]]))
            if near:
                want |= {(case, p[0] * 4, p[1] * 4, p[2] * 40, leg) for p in edge(flood(own, near[0]))}
    assert rows(voxels.pairwise_clouds(v, cases, (4, 3, 5))) == want and want


def test_blocks(spark, cube):
    data, v = cube
    b = blocks.encode(v, 4).cache()
    assert rows(blocks.decode(b, 4)) == rows(v)
    assert rows(blocks.labels(b)) == {(k,) for k in range(4)}
    assert rows(blocks.unique(v, blocks.palettes(v, 4), (1, 1, 1), (10, 9, 8), 4)) == {(int(k),) for k in np.unique(data[1:10, 1:9, 1:8]) if k}
    points = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (13, 10, 8), (99, 0, 0)], "x long, y long, z long")
    assert rows(blocks.at(b, points, 4)) == rows(voxels.points(v, points)) == {(1, 2, 3, int(data[1, 2, 3])), (13, 10, 8, int(data[13, 10, 8])), (99, 0, 0, 0)}
    m = spark.createDataFrame([(1, 10), (2, 20)], "label long, root long")
    assert rows(blocks.decode(blocks.remap(b, m), 4)) == rows(voxels.remap(v, m))
    with pytest.raises(Exception, match="no root"):
        voxels.remap(v, m, strict=True).collect()
    widths = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 16, 17, 256, 257, 65536, 65537)], "n long").select(blocks.bits_for(F.col("n"))).collect()
    assert [r[0] for r in widths] == [0, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32]


def test_overlays(spark, cube):
    _, v = cube
    new = spark.createDataFrame([(0, 0, 0, 9), (5, 5, 5, 9), (50, 0, 0, 9)], V)
    old = {(r[0], r[1], r[2]): r[3] for r in v.collect()}
    assert rows(voxels.overlay(v, new)) == {(*k, n) for k, n in (old | {(0, 0, 0): 9, (5, 5, 5): 9, (50, 0, 0): 9}).items()}
    low, high = (4, 4, 4), (7, 7, 7)
    inside = lambda p: all(4 <= a < 7 for a in p)
    assert rows(voxels.replaced(v, new, low, high)) == {(*k, n) for k, n in old.items() if not inside(k)} | {(5, 5, 5, 9)}


def test_volume_front(spark, cube, tmp_path):
    data, v = cube
    vol = api.Volume(v)
    assert rows(vol[2:9:2, 1:8, 0:9:3].df) == {r for r in rows(v) if 2 <= r[0] < 9 and (r[0] - 2) % 2 == 0 and 1 <= r[1] < 8 and r[2] % 3 == 0}
    with pytest.raises(ValueError):
        vol[0:5:-1, 0:1, 0:1]
    with pytest.raises(ValueError):
        vol[:, 0:1, 0:1]
    assert rows(vol.where(3).renumber().unique()) == {(1,)}
    want = {}
    for x, y, z, k in rows(v):
        want.setdefault((x // 2, y // 2, z // 2), []).append(k)
    assert rows(vol.downsample((2, 2, 2)).df.select("x", "y", "z", "label")) == {(*p, min(c, key=lambda k: (-c.count(k), k))) for p, c in want.items()}
    np.save(tmp_path / "a.npy", data.astype(np.uint64))
    assert cli.main(["compress", str(tmp_path / "a.npy")]) == 0 == cli.main(["decompress", str(tmp_path / "a.npy.pal"), "--shape", "14,11,9"])
    assert np.array_equal(np.load(tmp_path / "a.npy")[..., 0], data)


def test_morton(spark):
    grid = (5, 9, 3)
    places = list(itertools.product(*map(range, grid)))
    df = spark.createDataFrame(places, "x long, y long, z long").withColumn("code", geometry.morton([F.col(a) for a in "xyz"], grid))
    back = df.select("x", "y", "z", "code", *[c.alias(f"b{k}") for k, c in enumerate(geometry.morton_inverse(F.col("code"), grid))]).collect()
    from voxlake.sources.formats import morton_code

    assert all((r.x, r.y, r.z) == (r.b0, r.b1, r.b2) and r.code == morton_code((r.x, r.y, r.z), grid) for r in back) and len({r.code for r in back}) == len(places)
    with pytest.raises(Exception, match="beyond the grid"):
        spark.createDataFrame([(5, 0, 0)], "x long, y long, z long").select(geometry.morton([F.col(a) for a in "xyz"], grid)).collect()


def test_box_rounding(spark):
    df = spark.createDataFrame([(-9, 9), (0, 8), (4, 12), (5, 6), (-4, 3)], "a long, b long")
    e, s = geometry.expanded(F.col("a"), F.col("b"), 8), geometry.shrunk(F.col("a"), F.col("b"), 8)
    got = df.select(*e, *s, geometry.rounded(F.col("a"), 8)).collect()
    assert [tuple(r) for r in got] == [(-16, 16, -8, 8, -8), (0, 8, 0, 8, 0), (0, 16, 8, 8, 0), (0, 8, 0, 0, 8), (-8, 8, 0, 0, 0)]
    assert geometry.closest_divisor((100, 64, 7), (64, 64, 4)) == (50, 64, 1)


def test_graph_labels(spark):
    golden = graph.LabelSpec(8, 10)
    fields = {"layer": 5, "x": 1, "y": 2, "z": 3, "segid": 10}
    label = 5 << 56 | 1 << 46 | 2 << 36 | 3 << 26 | 10
    df = spark.createDataFrame([(label,), ((200 << 56) - (1 << 64),)], "l long")
    first = df.select(*[c.alias(k) for k, c in graph.decode(F.col("l"), golden).items()]).collect()
    assert first[0].asDict() == fields and first[1].layer == 200
    assert spark.range(1).select(graph.encode({k: F.lit(n) for k, n in fields.items()}, golden)).first()[0] == label
    with pytest.raises(Exception, match="doesn't fit"):
        spark.range(1).select(graph.encode({k: F.lit(n) for k, n in (fields | {"x": 1024}).items()}, golden)).collect()


def test_roots_at_a_time(spark):
    e = spark.createDataFrame([(1, 1, 10, 0), (1, 1, 11, 50), (2, 10, 100, 0), (2, 11, 101, 0)], "layer long, child long, parent long, valid_from long")
    ids = spark.createDataFrame([(1,), (0,), (7,)], "id long")
    assert rows(graph.roots(e, ids, 2, at=20)) == {(1, 100), (0, 0), (7, 7)}
    assert rows(graph.roots(e, ids, 2, at=60)) == {(1, 101), (0, 0), (7, 7)}
    assert rows(graph.roots(e, ids, 2, stop_layer=2, at=60)) == {(1, 11), (0, 0), (7, 7)}


def test_ranges_and_indices(spark):
    r = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 20, 30), ("a", 22, 24), ("b", 1, 2)], "p string, s long, e long")
    assert rows(shards.coalesced_ranges(r, "p", "s", "e")) == {("a", 0, 9, 2), ("a", 20, 30, 2), ("b", 1, 2, 1)}
    assert rows(shards.coalesced_ranges(r, "p", "s", "e", gap=11)) == {("a", 0, 30, 4), ("b", 1, 2, 1)}
    assert shards.hashed_parameters(0) == (0, 0) and shards.hashed_parameters(10**6) == (4, 6)


def test_meshes(spark, tmp_path):
    v = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 1, 0, 0), (4, 5, 5, 5), (5, 4, 1, 1), (6, 4, 1, 1), (7, 4, 1, 1)], "vid long, x long, y long, z long")
    f = spark.createDataFrame([(0, 1, 2), (0, 3, 2), (4, 5, 6)], "v0 long, v1 long, v2 long")
    m = api.Mesh(v, f)
    c = m.consolidate()
    assert c.vertices.count() == 5 and rows(c.faces) == {(0, 2, 1), (4, 3, 3)}
    assert rows(m.dedupe_boundary(4).faces) == {(0, 1, 2), (4, 5, 6)}
    assert rows(m.crop((0, 0, 0), (1, 1, 0)).faces) == {(0, 1, 2), (0, 3, 2)}
    assert m.edges().count() == 9 and m.triangles().count() == 3
    assert rows(m.transform(((2, 0, 0, 1), (0, 1, 0, 0), (0, 0, 1, 0))).vertices.where("vid = 1")) == {(1, 3.0, 0.0, 0.0)}
    vertices, faces = np.array([[0, 0, 0], [1, 2, 3], [4, 5, 6.5]], np.float32), np.array([[0, 1, 2]], np.uint32)
    (tmp_path / "1_0").write_bytes(tables.mesh_bytes(vertices, faces))
    (tmp_path / "2.obj").write_text(tables.obj_text(vertices, faces))
    got = tables.read_meshes(spark, str(tmp_path)).groupBy("kind", "id", "a", "b", "c").count().collect()
    assert len(got) == 4 and all(r["count"] == 2 for r in got)
    with pytest.raises(ValueError):
        tables.mesh_arrays(tables.mesh_bytes(vertices, faces)[:-3])
    sv, se = tables.skeleton_arrays(tables.skeleton_bytes(vertices, faces[:, :2]))
    assert np.array_equal(sv, vertices) and se.tolist() == [[0, 1]]


def test_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text('i1,i2,f_vector,placeholder1,placeholder2\n5,6,"[10, 14.1,-3]",0,0\n7,8,"1,2,6",0,0\n')
    assert [tuple(r)[1:] for r in tables.candidates(spark, str(tmp_path / "c.csv")).collect()] == [(5, 6, 8, 16, -4), (7, 8, 0, 0, 8)]
    (tmp_path / "0-16_0-16_0-16.spatial").write_text('{"5": [0, 0, 0, 4, 4, 4], "18446744073709551615": [1, 1, 1, 2, 2, 2]}'.replace("18446744073709551615", "9"))
    index = tables.read_spatial_index(spark, str(tmp_path / "*.spatial"))
    assert rows(index.select("name", "label", "x1")) == {("0-16_0-16_0-16", 5, 4), ("0-16_0-16_0-16", 9, 2)}
    assert rows(spatial.label_box(index.where("label = 5"))) == {(5, 0, 0, 0, 4, 4, 4)}
    tables.write_provenance(str(tmp_path), "d", ["o"])
    assert tables.read_provenance(str(tmp_path))["owners"] == ["o"] and tables.read_provenance(str(tmp_path / "no"))["sources"] == []


def test_cable_length(spark):
    v = spark.createDataFrame([(0, 0, 0, 0), (1, 3, 4, 0), (2, 3, 4, 12)], "vid long, x long, y long, z long")
    e = spark.createDataFrame([(0, 1), (1, 2), (1, 2)], "a long, b long")
    assert mesh.cable_length(v, e).first().length == 17.0
    assert rows(mesh.skeleton_components(v.union(spark.createDataFrame([(9, 0, 0, 0)], v.schema)), e)) == {(0, 0), (1, 0), (2, 0), (9, 9)}


def test_components_across_chunks(spark, cube):
    data, v = cube
    cells = {tuple(map(int, p)) for p in np.argwhere(data == 2)}
    whole = rows(voxels.components(v.where("label = 2")))
    assert rows(voxels.components(v.where("label = 2"), chunk=3)) == whole and whole
    seed = spark.createDataFrame([min(cells)], "x long, y long, z long")
    want = {(*p, 2) for p in flood(cells, min(cells))}
    assert rows(voxels.component_at(v.where("label = 2"), seed)) == want
    assert rows(voxels.component_at(v.where("label = 2"), seed, rows=10)) == want
    assert rows(voxels.component_at(v.where("label = 2"), seed.where("false"))) == set()
    assert rows(voxels.components(v.where("false"))) == set()
    with pytest.raises(Exception, match="beyond"):
        spark.createDataFrame([(1 << 20, 0, 0, 1)], V).select(voxels.linear(None)).collect()


def test_numbers_without_a_global_window(spark):
    df = spark.createDataFrame([(k * 37 % 1000,) for k in range(1000)], "k long").repartition(7)
    assert rows(components.numbered(df, ["k"], "n")) == {(k, k) for k in range(1000)}
    assert rows(components.numbered(df.where("false"), ["k"], "n")) == set()


def test_large_mappings_of_blocks(spark, cube):
    _, v = cube
    m = spark.createDataFrame([(1, 10), (2, 20)], "label long, root long")
    b = blocks.encode(v, 4)
    assert rows(blocks.decode(blocks.remap(b, m, rows=1), 4)) == rows(voxels.remap(v, m))
    with pytest.raises(Exception, match="no root"):
        blocks.remap(b, m, strict=True, rows=1).collect()
    one = blocks.bitstream(b, 3)
    assert rows(blocks.decode(one, 4)) == rows(v.where("label = 3")) and {tuple(r.palette) for r in one.collect()} == {(0, 3)}


def traced(image):
    """How often border following passes each pixel of a 2-d image, by following every border."""
    f = np.pad(image.astype(int), 1)
    turn = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]  # counterclockwise, rows down
    count, border = np.zeros(f.shape, int), 1
    for i, j in itertools.product(range(1, f.shape[0] - 1), range(1, f.shape[1] - 1)):
        if f[i, j] == 1 and f[i, j - 1] == 0:
            at = 4
        elif f[i, j] >= 1 and f[i, j + 1] == 0:
            at = 0
        else:
            continue
        border += 1
        first = next((k for k in ((at - n) % 8 for n in range(8)) if f[i + turn[k][0], j + turn[k][1]]), None)
        if first is None:
            f[i, j] = -border
            count[i, j] += 1
            continue
        start, here, back = (i + turn[first][0], j + turn[first][1]), (i, j), first
        while True:
            east = False
            for n in range(1, 9):
                k = (back + n) % 8
                to = (here[0] + turn[k][0], here[1] + turn[k][1])
                if f[to]:
                    break
                east |= k == 0
            count[here] += 1
            if east:
                f[here] = -border
            elif f[here] == 1:
                f[here] = border
            if to == (i, j) and here == start:
                break
            here, back = to, (k + 4) % 8
    return count[1:-1, 1:-1]


def test_contours_equal_tracing(spark):
    r = np.random.default_rng(8)
    data = (r.random((18, 15, 6)) < np.array([0.1, 0.35, 0.5, 0.65, 0.85, 0.97])).astype(int)
    v = spark.createDataFrame([(*map(int, p), 1) for p in np.argwhere(data)], V)
    got = {(r.x, r.y, r.z): r.n for r in voxels.contours(v).collect()}
    want = {(*map(int, p), z): int(n) for z in range(6) for p, n in np.ndenumerate(traced(data[:, :, z])) if n}
    assert got == want and max(want.values()) >= 3
    assert set(got) == {tuple(r)[:3] for r in voxels.boundary(v).collect()}


def test_slices(spark, cube):
    from voxlake.sources.formats import OutOfBounds, Scale

    data, v = cube
    vol = api.Volume(v, Scale("k", "uint64", (14, 11, 9), (0, 0, 0), (4, 4, 4), (1, 1, 1)))
    for given, want in (((3,), data[3:4]), ((slice(2, 9, 3), ...), data[2:9:3]), ((..., slice(1, 4)), data[:, :, 1:4]), ((slice(None), 5, slice(None)), data[:, 5:6])):
        assert vol[given if len(given) > 1 else given[0]].df.count() == np.count_nonzero(want)
    with pytest.raises(OutOfBounds):
        vol[0:15, 0:1, 0:1]
    assert vol.slices((slice(-3, 99), slice(0, 2)), bounded=False) == ([0, 0, 0], [14, 2, 9], [1, 1, 1])
    with pytest.raises(IndexError):
        vol[1, 2, 3, 4]
    part = vol.cutout((2, 2, 2), (9, 9, 9))
    assert part.scale.offset == (2, 2, 2) and part[2:9].df.count() == np.count_nonzero(data[2:9, 2:9, 2:9])


S = "vid long, x long, y long, z long"


def places(skeleton):
    v, e = skeleton
    at = {r.vid: (r.x, r.y, r.z) for r in v.collect()}
    return set(at.values()), {frozenset((at[r.a], at[r.b])) for r in e.collect()}


def test_skeletons(spark):
    at = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 3), (2, 1, 3), (2, 2, 3)]
    v = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], S)
    e = spark.createDataFrame([(1, 0), (1, 2), (2, 3), (3, 4), (5, 4)], "a long, b long")
    for factor, kept in ((1, range(6)), (2, (0, 2, 4, 5)), (3, (0, 3, 5)), (99, (0, 5))):
        kept = [at[k] for k in kept]
        assert places(mesh.downsampled_skeleton(v, e, factor)) == (set(kept), {frozenset(p) for p in itertools.pairwise(kept)}), factor
    with pytest.raises(ValueError):
        mesh.downsampled_skeleton(v, e, 0)
    branched = spark.createDataFrame([(k, k, 0, 0) for k in range(12)], S)
    fork = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (6, 7), (7, 3), (8, 9), (9, 10), (10, 8)], "a long, b long")
    got = places(mesh.downsampled_skeleton(branched, fork, 2))[1]
    assert {tuple(sorted(p[0] for p in x)) for x in got} == {(0, 2), (2, 3), (3, 4), (3, 6), (8, 10)}
    assert mesh.equivalent((v, e), (v.withColumn("vid", 10 - F.col("vid")), e.select((10 - F.col("b")).alias("a"), (10 - F.col("a")).alias("b"))))
    assert not mesh.equivalent((v, e), (v, e.where("a <> 5")))
    both = mesh.merged_skeletons([(v, e), (v.withColumn("x", F.col("x") + 1), e)])
    assert len(places(both)[1]) == 10 and places(both)[0] == set(at) | {(x + 1, y, z) for x, y, z in at}
    assert places(mesh.connected_vertices(branched, fork))[0] == {(k, 0, 0) for k in range(11)}
    text = "# made\n1 1 0 0 0 1 -1\n5 0 1 2 3 2.5 1\n3 0 4 5 6 1 5\n9 2 7 7 7 1 1\n"
    sv, se, radii, types = tables.swc_arrays(text)
    assert sv.tolist()[1] == [1, 2, 3] and se.tolist() == [[1, 0], [2, 1], [3, 0]] and radii[1] == 2.5 and types.tolist() == [1, 0, 0, 2]
    again = tables.swc_arrays(tables.swc_text(sv, se, radii, types))
    assert sorted(again[0].tolist()) == sorted(sv.tolist()) and len(again[1]) == 3
    with pytest.raises(ValueError, match="loop"):
        tables.swc_text(sv[:3], np.array([[0, 1], [1, 2], [2, 0]]))


def test_mesh_files(spark, tmp_path):
    vertices, faces = np.array([[0, 0, 0], [1, 2, 3], [4, 5, 6.5]], np.float32), np.array([[0, 1, 2], [2, 1, 0]], np.uint32)
    back = tables.ply_arrays(tables.ply_bytes(vertices, faces))
    assert np.array_equal(back[0], vertices) and np.array_equal(back[1], faces)
    ascii_ = b"ply\nformat ascii 1.0\nelement vertex 3\nelement face 1\nend_header\n0 0 0\n1 2 3\n4 5 6.5\n3 0 1 2\n"
    assert np.array_equal(tables.ply_arrays(ascii_)[0], vertices) and tables.ply_arrays(ascii_)[1].tolist() == [[0, 1, 2]]
    names = tables.put_mesh(str(tmp_path), 7, [(vertices, faces), (vertices, faces[:1])])
    assert tables.mesh_fragments(str(tmp_path), [7, 8]) == {7: names, 8: None}
    labels = spark.createDataFrame([(7,), (8,), (7,)], "label long")
    assert tables.read_label_meshes(str(tmp_path), labels).where("kind = 'face'").count() == 3
    tables.delete_mesh(str(tmp_path), 7)
    assert list(tmp_path.iterdir()) == []


def test_hash_of_bytes():
    from voxlake.functions.hashing import murmur3_low64, murmur3_x86_128

    # published values of the public algorithm, and agreement with the vectorised version
    assert murmur3_x86_128(b"") == 0
    keys = np.array([0, 1, 77, (1 << 64) - 1], np.uint64)
    assert [murmur3_x86_128(int(k).to_bytes(8, "little")) & ((1 << 64) - 1) for k in keys] == murmur3_low64(keys).tolist()
    assert len({murmur3_x86_128(b"x" * n) for n in range(40)}) == 40 and murmur3_x86_128(b"a", 1) != murmur3_x86_128(b"a")


def test_segments_and_averages(spark):
    from voxlake.operators import series

    e = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 11)], "layer long, child long, parent long")
    v = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 2), (2, 0, 0, 3), (3, 0, 0, 4)], V)
    chosen = spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "ordinal long, id long")
    assert rows(graph.segments(v, e, chosen, 1)) == {(0, 0, 0, 10), (1, 0, 0, 10), (2, 0, 0, 11)}
    assert (3, 0, 0, (1 << 32) - 1) in rows(graph.segments(v, e, chosen, 1, preserve_zeros=True))
    t = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate([4, 8, 1])] + [(2, 0, 5.0)], "g long, t long, v double")
    for n in (1, 2, 5):
        a = np.array([4.0, 8, 1])
        padded = np.pad(a, (n, 0), "symmetric")
        want = [padded[k + 1 : k + n + 1].mean() for k in range(3)]
        got = {(r.g, r.t): r.average for r in series.moving_average(t, ["g"], "t", "v", n).collect()}
        assert [got[1, k] for k in range(3)] == pytest.approx(want) and got[2, 0] == 5.0
    with pytest.raises(ValueError):
        series.moving_average(t, ["g"], "t", "v", 0)
