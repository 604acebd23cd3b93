"""Renders against a raster that looks at one pixel and one triangle at a time."""

import json
import math
import zlib

import numpy as np

from quillon.operators import geometry, render

ELEMENTS = [
    ("sphere", {"radius_cm": 4}), ("ellipsoid", {"radius_x_cm": 3, "radius_y_cm": 5, "radius_z_cm": 2}), ("box", {"size_x_cm": 6, "size_y_cm": 4, "size_z_cm": 3}), ("cylinder", {"radius_cm": 2, "height_cm": 7}),
    ("cone", {"radius_cm": 3, "height_cm": 6}), ("torus", {"major_radius_cm": 5, "minor_radius_cm": 1}), ("capsule", {"radius_cm": 2, "height_cm": 5}), ("plane", {}), ("sheet", {"size_x_cm": 5, "size_y_cm": 5, "thickness_cm": 0.2}),
    ("wedge", {"size_x_cm": 4, "size_y_cm": 6, "size_z_cm": 3}), ("prism", {"size_x_cm": 4, "size_y_cm": 6, "num_sides": 5}), ("pyramid", {"base_size_x_cm": 4, "base_size_y_cm": 4, "height_cm": 5}), ("hemisphere", {"radius_cm": 3}),
    ("frustum", {"bottom_radius_cm": 3, "top_radius_cm": 1, "height_cm": 4}),
]


def volume(t):
    return abs(np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum()) / 6


def test_meshes_have_the_extent_and_area_of_their_solids():
    area = lambda t: np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum() / 2
    meshes = {kind: render.mesh({"element_type": kind, "parameters": p}) for kind, p in ELEMENTS}
    assert all(len(m) and area(m) > 0 for m in meshes.values())
    assert area(meshes["box"]) == 2 * (24 + 18 + 12) and len(meshes["plane"]) == 2
    assert math.isclose(area(meshes["sphere"]), 4 * math.pi * 16, rel_tol=0.03)
    assert math.isclose(area(meshes["torus"]), 4 * math.pi**2 * 5, rel_tol=0.03)
    assert math.isclose(area(meshes["cylinder"]), 2 * math.pi * 2 * 9, rel_tol=0.02)
    assert math.isclose(area(meshes["capsule"]), 4 * math.pi * 4 + 2 * math.pi * 2 * 5, rel_tol=0.03)
    assert meshes["hemisphere"][:, :, 2].min() == 0 and math.isclose(meshes["capsule"][:, :, 2].max(), 4.5)
    areas = np.linalg.norm(np.cross(meshes["cone"][:, 1] - meshes["cone"][:, 0], meshes["cone"][:, 2] - meshes["cone"][:, 0]), axis=1)
    assert (areas > 1e-9).all()
    assert len(render.mesh({"element_type": "nothing"})) == 0 == len(render.mesh({"element_type": "box", "parameters": {}}))


def test_clips_cut_at_planes():
    box = {"element_type": "box", "parameters": {"size_x_cm": 4, "size_y_cm": 4, "size_z_cm": 4}}
    half = render.mesh(box | {"clips": [{"point": [1, 0, 0], "normal": [2, 0, 0]}, {"point": [0, 0, 0], "normal": [0, 0, 0]}]})
    assert half[:, :, 0].max() == 1 and half[:, :, 0].min() == -2
    area = np.linalg.norm(np.cross(half[:, 1] - half[:, 0], half[:, 2] - half[:, 0]), axis=1).sum() / 2
    assert math.isclose(area, 16 + 4 * 12)
    assert len(render.mesh(box | {"clips": [{"point": [-3, 0, 0], "normal": [1, 0, 0]}]})) == 0
    corner = render.mesh(box | {"clips": [{"point": [0, 0, 0], "normal": [1, 1, 1]}]})
    assert all(p.sum() <= 1e-9 for t in corner for p in t)


def scene(seed):
    rng = np.random.default_rng(seed)
    objects = []
    for i, (kind, p) in enumerate(ELEMENTS):
        turn = rng.normal(size=4)
        t = {"translation": rng.uniform(-12, 12, 3).tolist(), "rotation": (turn / np.linalg.norm(turn)).tolist(), "scale": [1, 1.5, 1]}
        objects.append({"object_id": f"o{i}", "parent_object_id": f"o{i - 1}" if i % 5 == 4 else None, "transform": t, "material": {"color": ["Red", "dark gold", 7, None][i % 4]}, "elements": [{"element_type": kind, "parameters": p or {"size_x_cm": 8, "size_y_cm": 8}, "transform": {"translation": [1, 0, 0]}}]})
    objects[3]["metadata"] = {"clips": [{"point": [0, 0, 1], "normal": [0, 0, 1]}]}
    return json.dumps({"objects": objects})


def plain(triangles, eye, target, width, height):
    m = render.projection(np.array(eye), np.array(target), np.array([0.0, 0, 1]), width, height)
    best = {}
    for t in sorted(triangles, key=lambda t: (t.object_ix, t.element_ix, t.triangle_ix)):
        p = [m @ np.append(t.v[3 * i : 3 * i + 3], 1.0) for i in range(3)]
        if any(c[3] <= 1e-6 for c in p):
            continue
        (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = (((c[0] / c[3] + 1) / 2 * width, (1 - c[1] / c[3]) / 2 * height, c[2] / c[3]) for c in p)
        area = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
        for y in range(height) if abs(area) >= 1e-12 else ():
            for x in range(width):
                a = ((y1 - y2) * (x + 0.5 - x2) + (x2 - x1) * (y + 0.5 - y2)) / area
                b = ((y2 - y0) * (x + 0.5 - x2) + (x0 - x2) * (y + 0.5 - y2)) / area
                if a >= 0 and b >= 0 and 1 - a - b >= 0:
                    depth = a * z0 + b * z1 + (1 - a - b) * z2
                    if depth < best.get((x, y), (np.inf,))[0]:
                        best[x, y] = depth, t.object_id, tuple(int(255 * c) for c in t.rgb)
    return best


def test_pixels_and_pictures(spark, monkeypatch):
    monkeypatch.setattr(render, "TILES", 3)
    width, height = 40, 36
    scenes = spark.createDataFrame([("a", scene(1)), ("b", scene(2)), ("none", json.dumps({"objects": []}))], "scene_id string, scene string")
    found = render.triangles(render.elements(scenes))
    cameras = {r.scene_id: r for r in render.auto_cameras(found).collect()}
    got = render.render(scenes, width=width, height=height)
    rows = got.collect()
    assert {r.scene_id for r in rows} == {"a", "b"} == set(cameras)
    for name, camera in cameras.items():
        want = plain([t for t in found.collect() if t.scene_id == name], camera.eye, camera.target, width, height)
        have = {(r.x, r.y): (r.depth, r.object_id, (r.r, r.g, r.b)) for r in rows if r.scene_id == name}
        off = [k for k in want.keys() | have.keys() if k not in want or k not in have or want[k][1:] != have[k][1:] or not math.isclose(want[k][0], have[k][0], rel_tol=1e-9)]
        assert len(off) <= 1 and len(want) > 60, off  # a pixel's middle may lie on an edge
    file = bytes(render.images(got, width, height).where("scene_id = 'a'").first().png)
    assert file[:8] == b"\x89PNG\r\n\x1a\n" and file[16:24] == width.to_bytes(4, "big") + height.to_bytes(4, "big")
    start = file.index(b"IDAT")
    lines = zlib.decompress(file[start + 4 : start + 4 + int.from_bytes(file[start - 4 : start], "big")])
    picture = np.frombuffer(lines, np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)
    assert all(tuple(picture[r.y, r.x]) == (r.r, r.g, r.b) for r in rows if r.scene_id == "a") and tuple(picture[0, 0]) in {(247, 247, 247), *((r.r, r.g, r.b) for r in rows)}


def test_what_is_behind_the_camera_is_not_seen(spark):
    box = {"object_id": "o", "elements": [{"element_type": "box", "parameters": {"size_x_cm": 2, "size_y_cm": 2, "size_z_cm": 2}}]}
    scenes = spark.createDataFrame([("s", json.dumps({"objects": [box]}))], "scene_id string, scene string")
    away = spark.createDataFrame([("s", [0.0, -10.0, 0.0], [0.0, -20.0, 0.0])], "scene_id string, eye array<double>, target array<double>")
    assert render.render(scenes, away, 8, 8).count() == 0
    near = spark.createDataFrame([("s", [0.0, -4.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "scene_id string, eye array<double>, target array<double>, up array<double>")
    assert render.render(scenes, near, 8, 8).count() > 30


def test_covered_pixels_of_many_triangles_at_once(monkeypatch):
    """Against each pixel by itself, in pieces of a few lines; triangles outside, flat ones and one over the whole picture."""
    rng = np.random.default_rng(4)
    x, y, z = (rng.uniform(-8, 24, (60, 3)) for _ in range(3))
    x[0], y[0] = (-50, 80, -50), (-50, -50, 80)
    x[1] = x[1, 0]
    monkeypatch.setattr(render, "PIXELS_AT_ONCE", 64)
    pieces = list(render.covered(x, y, z, 16, 12))
    assert len(pieces) > 20 and max(len(t) for t, *_ in pieces) <= 64
    got = [tuple(map(float, r)) for piece in pieces for r in zip(*piece, strict=True)]
    want = []
    for t, (p, q, d) in enumerate(zip(x, y, z, strict=True)):
        area = (q[1] - q[2]) * (p[0] - p[2]) + (p[2] - p[1]) * (q[0] - q[2])
        for row in range(12) if abs(area) >= 1e-12 else ():
            for column in range(16):
                a = ((q[1] - q[2]) * (column + 0.5 - p[2]) + (p[2] - p[1]) * (row + 0.5 - q[2])) / area
                b = ((q[2] - q[0]) * (column + 0.5 - p[2]) + (p[0] - p[2]) * (row + 0.5 - q[2])) / area
                if min(a, b, 1.0 - a - b) >= 0:
                    want.append((t, column, row, a * d[0] + b * d[1] + (1.0 - a - b) * d[2]))
    assert got == [tuple(map(float, r)) for r in want]


def test_boxes_left_out_are_not_measured(spark):
    """An object that can't be measured does no harm where it is left out."""
    box = {"element_type": "box", "parameters": {f"size_{a}_cm": 2.0 for a in "xyz"}}
    text = json.dumps({"objects": {"a": {"elements": [box]}, "a_b": {"elements": [{"parameters": {}}]}}})
    found = geometry.scene_boxes(spark.createDataFrame([("s", text)], "scene_id string, scene string"), without="_").collect()
    assert [(r.object_id, r.box.hi) for r in found] == [("a", [1.0, 1.0, 1.0])]
