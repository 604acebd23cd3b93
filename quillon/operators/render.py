"""Renders of scenes: triangle meshes, half-space clipping, a camera, and a z-buffer as a minimum per pixel.

A scene is parsed once into rows of elements, which are dealt over the cluster whatever scene they are of. Elements become
triangles, triangles pixels, many at a time: a task emits the nearest triangle of each pixel of a bounded number of pixels, so
triangles that hide one another are reduced before the shuffle, and the minimum per pixel over all tasks is the image. No
task holds a whole image or a whole scene's geometry.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.geometry import matrix, unwrapped, worlds
from quillon.operators.scan import joined
from quillon.session import stored

# Colours by name, the light and the camera of the scene format's renderer.
COLOURS = {
    "red": (0.85, 0.20, 0.20), "green": (0.30, 0.75, 0.30), "blue": (0.25, 0.45, 0.85), "yellow": (0.95, 0.85, 0.20), "orange": (0.95, 0.55, 0.20), "orange_yellow": (0.95, 0.65, 0.25),
    "silver": (0.75, 0.75, 0.78), "gray": (0.55, 0.55, 0.55), "grey": (0.55, 0.55, 0.55), "black": (0.12, 0.12, 0.12), "white": (0.95, 0.95, 0.95), "brown": (0.55, 0.35, 0.20), "wood": (0.72, 0.55, 0.35),
    "flesh": (0.92, 0.78, 0.70), "cream": (0.96, 0.92, 0.82), "pale_white": (0.95, 0.94, 0.90), "steel": (0.65, 0.68, 0.72), "clear_yellowish": (0.95, 0.92, 0.70), "gold": (0.85, 0.70, 0.25),
}
PLAIN, BACKGROUND = (0.6, 0.6, 0.6), (0.97, 0.97, 0.97)
AMBIENT, DIFFUSE, LIGHT = 0.35, 0.65, (0.3, -0.5, 0.8)
ELEVATION, AZIMUTH, DISTANCE, FIELD, NEAR, FAR = 22.0, -50.0, 2.5, 45.0, 0.1, 100000.0
WIDTH, HEIGHT = 1000, 800
#: Triangles that are placed together, and pixels that are compared before the nearest are emitted.
TILES, PIXELS_AT_ONCE = 1 << 16, 1 << 20


def colour(material: object) -> tuple[float, float, float]:
    """The colour that a material names; a name that holds or is held by a known one counts as the first such."""
    name = (material.get("color") or material.get("colour")) if isinstance(material, dict) else None
    if not isinstance(name, str):
        return PLAIN
    key = name.strip().lower().replace(" ", "_")
    return COLOURS.get(key) or next((v for k, v in COLOURS.items() if k in key or key in k), PLAIN)


def _fans(corners: np.ndarray, faces: list[tuple[int, ...]]) -> np.ndarray:
    """Triangles (n, 3, 3) of convex faces."""
    return np.array([[corners[f[0]], corners[f[k]], corners[f[k + 1]]] for f in faces for k in range(1, len(f) - 1)], float)


def _turned(profile: list[tuple[float, float]], sides: int = 24) -> np.ndarray:
    """The surface that a profile of (radius, height) points sweeps around the z axis; what has no area is left out."""
    angle = 2 * np.pi * np.arange(sides + 1) / sides
    rings = np.array([[(r * np.cos(a), r * np.sin(a), z) for a in angle] for r, z in profile])
    out = []
    for low, high, (r0, _), (r1, _) in zip(rings[:-1], rings[1:], profile[:-1], profile[1:], strict=True):
        for j in range(sides):
            out += [(low[j], low[j + 1], high[j + 1])] if r0 else []
            out += [(low[j], high[j + 1], high[j])] if r1 else []
    return np.array(out, float).reshape(-1, 3, 3)


def _arc(radius: float, height: float, start: float, stop: float, steps: int, reach: float = 0.0) -> list[tuple[float, float]]:
    """Points of a profile on a circle, by the angle from the z axis; poles are on it exactly."""
    turn = np.pi * np.linspace(start, stop, steps + 1)
    across = radius * np.sin(turn)
    if not reach:
        across[np.isin(np.linspace(start, stop, steps + 1), (0.0, 1.0))] = 0.0
    return [(reach + x, height + radius * np.cos(t)) for x, t in zip(across, turn, strict=True)]


_BOX = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]


def _box(x: float, y: float, z: float) -> np.ndarray:
    return _fans(np.array(list(product((-x / 2, x / 2), (-y / 2, y / 2), (-z / 2, z / 2)))), _BOX)


def _drum(low: float, high: float, h: float, sides: int = 24) -> np.ndarray:
    return _turned([(0, -h / 2), (low, -h / 2), (high, h / 2), (0, h / 2)], sides)


def mesh(element: dict) -> np.ndarray:
    """Triangles of an element in its own frame, cut by its clips; none of an unknown type or one that lacks parameters."""
    p = element.get("parameters") or {}
    try:
        out = _solid(element.get("element_type"), p)
    except (KeyError, TypeError, ValueError):
        return np.zeros((0, 3, 3))
    return clipped(out, element.get("clips") or [])


def _solid(kind: str | None, p: dict) -> np.ndarray:
    if kind in ("box", "sheet"):
        return _box(p["size_x_cm"], p["size_y_cm"], p["size_z_cm" if kind == "box" else "thickness_cm"])
    if kind == "plane":
        x, y = ((p.get(f"size_{a}_cm") or 100.0) / 2 for a in "xy")
        return _fans(np.array([(-x, -y, 0), (x, -y, 0), (x, y, 0), (-x, y, 0)]), [(0, 1, 2, 3)])
    if kind == "wedge":  # a roof: the ridge runs along x
        x, y, z = (p[f"size_{a}_cm"] / 2 for a in "xyz")
        return _fans(np.array([(-x, -y, -z), (x, -y, -z), (x, y, -z), (-x, y, -z), (-x, 0, z), (x, 0, z)]), [(0, 1, 2, 3), (0, 1, 5, 4), (2, 3, 4, 5), (0, 4, 3), (1, 2, 5)])
    if kind == "pyramid":
        x, y, z = p["base_size_x_cm"] / 2, p["base_size_y_cm"] / 2, p["height_cm"] / 2
        return _fans(np.array([(-x, -y, -z), (x, -y, -z), (x, y, -z), (-x, y, -z), (0, 0, z)]), [(0, 1, 2, 3), *((k, (k + 1) % 4, 4) for k in range(4))])
    if kind == "sphere":
        return _turned(_arc(p["radius_cm"], 0, 0, 1, 12))
    if kind == "ellipsoid":
        return _turned(_arc(1.0, 0, 0, 1, 12)) * np.array([p[f"radius_{a}_cm"] for a in "xyz"])
    if kind == "cylinder":
        return _drum(p["radius_cm"], p["radius_cm"], p["height_cm"])
    if kind == "cone":
        return _drum(p["radius_cm"], 0, p["height_cm"])
    if kind == "frustum":
        return _drum(p["bottom_radius_cm"], p["top_radius_cm"], p["height_cm"])
    if kind == "prism":
        r = max(p["size_x_cm"], p["size_y_cm"]) / 2
        return _drum(r, r, p["size_y_cm"], int(p["num_sides"]))
    if kind == "torus":
        return _turned(_arc(p["minor_radius_cm"], 0, 0, 2, 16, p["major_radius_cm"]), 32)
    if kind == "capsule":
        r, h = p["radius_cm"], p["height_cm"]
        return _turned(_arc(r, h / 2, 0, 0.5, 8) + _arc(r, -h / 2, 0.5, 1, 8))
    if kind == "hemisphere":
        return _turned([*_arc(p["radius_cm"], 0, 0, 0.5, 12), (0, 0)])
    raise ValueError(kind)


def clipped(triangles: np.ndarray, clips: list[dict]) -> np.ndarray:
    """What of the triangles is behind every clip's plane (a point on it and a normal to the side that goes)."""
    planes = [(np.asarray(c.get("point", (0, 0, 0)), float), np.asarray(c.get("normal", (0, 0, 1)), float)) for c in clips if isinstance(c, dict)]
    planes = [(p, n / np.linalg.norm(n)) for p, n in planes if np.linalg.norm(n)]
    out = []
    for t in triangles if planes else ():
        polygon = t
        for p, n in planes:
            d = (polygon - p) @ n
            kept = []
            for k in range(len(polygon)):
                a, b, da, db = polygon[k - 1], polygon[k], d[k - 1], d[k]
                if (da <= 0) != (db <= 0) and abs(da - db) >= 1e-12:
                    kept.append(a + da / (da - db) * (b - a))
                if db <= 0:
                    kept.append(b)
            polygon = np.array(kept)
            if len(kept) < 3:
                break
        else:
            out += [(polygon[0], polygon[k], polygon[k + 1]) for k in range(1, len(polygon) - 1)]
    return np.array(out, float).reshape(-1, 3, 3) if planes else triangles


ELEMENTS = "scene_id string, object_ix int, element_ix int, object_id string, element string, frame array<double>, rgb array<double>"


def elements(scenes: DataFrame) -> DataFrame:
    """ELEMENTS of (scene_id, scene JSON) rows: each element with the 4 x 4 that leads to the world and its colour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for scene_id, text in zip(pdf["scene_id"], pdf["scene"], strict=True):
                objects = unwrapped(text)["objects"]
                at = worlds(objects)
                for i, (name, o) in enumerate(objects.items()):
                    for k, e in enumerate(o.get("elements") or []):
                        frame = at[name] @ matrix(e.get("transform"))
                        rows.append((scene_id, i, k, name, json.dumps({x: e.get(x) for x in ("element_type", "parameters", "clips")}), frame.ravel().tolist(), colour(e.get("material_override") or o.get("material"))))
            yield pd.DataFrame(rows, columns=["scene_id", "object_ix", "element_ix", "object_id", "element", "frame", "rgb"])

    return scenes.select("scene_id", "scene").mapInPandas(run, ELEMENTS)


def moved(m: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, row: int) -> np.ndarray:
    """One coordinate of points under a 4 x 4 (as 16 numbers), term by term, so equal input gives equal bits anywhere."""
    return m[4 * row] * x + m[4 * row + 1] * y + m[4 * row + 2] * z + m[4 * row + 3]


def shades(v: np.ndarray, light: tuple[float, float, float] = LIGHT) -> np.ndarray:
    """The brightness of triangles (n, 9) by how they face the light, on either side."""
    size = float(np.sqrt(light[0] * light[0] + light[1] * light[1] + light[2] * light[2])) or 1.0
    lx, ly, lz = (c / size for c in light)
    ax, ay, az, bx, by, bz = (v[:, k + 3 * i] - v[:, k] for i in (1, 2) for k in range(3))
    nx, ny, nz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    length = np.sqrt(nx * nx + ny * ny + nz * nz)
    flat = length < 1e-12
    length = np.where(flat, 1.0, length)
    return AMBIENT + DIFFUSE * np.where(flat, 0.0, np.abs(nx / length * lx + ny / length * ly + nz / length * lz))


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt by element to a stated number of tasks: few bytes can be much work, so small partitions aren't put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id", "object_ix", "element_ix")


TRIANGLES = "scene_id string, object_ix int, element_ix int, triangle_ix int, object_id string, v array<double>, rgb array<double>"


def triangles(parts: DataFrame, light: tuple[float, float, float] = LIGHT) -> DataFrame:
    """TRIANGLES of ELEMENTS: nine world coordinates and a shaded colour each. Elements are dealt to all tasks first."""

    def place(batch: pa.RecordBatch, rows: np.ndarray, meshes: list[np.ndarray]) -> pa.RecordBatch:
        counts = [len(x) for x in meshes]
        of, own = np.repeat(rows, counts), np.concatenate(meshes)
        each = lambda name, n: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[of]
        m, x, y, z = each("frame", 16).T[:, :, None], own[:, :, 0], own[:, :, 1], own[:, :, 2]
        v = np.stack([moved(m, x, y, z, k) for k in range(3)], axis=2).reshape(-1, 9)
        lit = np.minimum(1.0, shades(v, light)[:, None] * each("rgb", 3))
        listed = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        taken = {c: batch.column(c).take(pa.array(of)) for c in ("scene_id", "object_ix", "element_ix", "object_id")}
        found = taken | {"triangle_ix": pa.array(nth.astype(np.int32)), "v": listed(v), "rgb": listed(lit)}
        names = [c.split()[0] for c in TRIANGLES.split(", ")]
        return pa.RecordBatch.from_arrays([found[c] for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = lru_cache(1024)(lambda text: mesh(json.loads(text)))  # many elements are alike
        for batch in batches:
            rows, meshes, n = [], [], 0
            for i, text in enumerate(batch.column("element").to_pylist()):
                rows.append(i)
                meshes.append(shape(text))
                n += len(meshes[-1])
                if n >= TILES:
                    yield place(batch, np.array(rows), meshes)
                    rows, meshes, n = [], [], 0
            if n:
                yield place(batch, np.array(rows), meshes)

    return dealt(parts).mapInArrow(run, TRIANGLES)


def projection(eye: np.ndarray, target: np.ndarray, up: np.ndarray, width: int, height: int, field: float = FIELD) -> np.ndarray:
    """The 4 x 4 from the world to clip space of a camera."""
    unit = lambda v, other: v / np.linalg.norm(v) if np.linalg.norm(v) >= 1e-9 else np.asarray(other, float)
    ahead = unit(np.asarray(target, float) - eye, (0, 0, -1))
    right = unit(np.cross(ahead, up), (1, 0, 0))
    axes = np.stack([right, np.cross(right, ahead), -ahead])
    view = np.eye(4)
    view[:3, :3], view[:3, 3] = axes, -axes @ eye
    f = 1 / np.tan(np.radians(field) / 2)
    lens = np.array([[f * height / width, 0, 0, 0], [0, f, 0, 0], [0, 0, (FAR + NEAR) / (NEAR - FAR), 2 * FAR * NEAR / (NEAR - FAR)], [0, 0, -1, 0]])
    return lens @ view


def auto_cameras(found: DataFrame) -> DataFrame:
    """(scene_id, eye, target) from which all of a scene's TRIANGLES are seen."""
    at = lambda k: [F.col("v")[3 * i + k] for i in range(3)]
    aggs = [a for k in range(3) for a in (F.sum(sum(at(k))).alias(f"s{k}"), F.min(F.least(*at(k))).alias(f"lo{k}"), F.max(F.greatest(*at(k))).alias(f"hi{k}"))]
    per = found.groupBy("scene_id").agg(F.count("*").alias("n"), *aggs)
    size = F.greatest(*(F.col(f"hi{k}") - F.col(f"lo{k}") for k in range(3)))
    reach = F.when(size > 0, size).otherwise(10.0) * DISTANCE
    e, a = np.radians(ELEVATION), np.radians(AZIMUTH)
    way = (np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e))
    centre = [F.col(f"s{k}") / (3 * F.col("n")) for k in range(3)]
    return per.select("scene_id", F.array(*(c + reach * float(w) for c, w in zip(centre, way, strict=True))).alias("eye"), F.array(*centre).alias("target"))


PIXELS = "scene_id string, x int, y int, depth double, object_ix int, element_ix int, triangle_ix int, object_id string, r int, g int, b int"


def seen(m: np.ndarray, v: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, x, y, depth) of triangles (n, 9) on the screen; those that reach behind the camera or lie outside what it sees are not kept."""
    x, y, z = v[:, 0::3], v[:, 1::3], v[:, 2::3]
    w = moved(m, x, y, z, 3)
    kept = (w > 1e-6).all(axis=1)
    w = np.where(w > 1e-6, w, 1.0)
    nx, ny, nz = (moved(m, x, y, z, k) / w for k in range(3))
    for n, edge in ((nx, 1.2), (ny, 1.2), (nz, 1.0)):
        kept &= ~((n < -edge).all(axis=1) | (n > edge).all(axis=1))
    return kept, (nx + 1.0) * 0.5 * width, (1.0 - ny) * 0.5 * height, nz


def covered(x: np.ndarray, y: np.ndarray, z: np.ndarray, width: int, height: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(triangle, column, row, depth) of the pixels that triangles (n, 3) cover, some at a time in order of triangle; a pixel counts by its middle."""
    low = lambda c, n: np.clip(np.floor(c.min(axis=1)), 0, n).astype(np.int64)
    high = lambda c, n: np.clip(np.ceil(c.max(axis=1)), -1, n - 1).astype(np.int64)
    area = (y[:, 1] - y[:, 2]) * (x[:, 0] - x[:, 2]) + (x[:, 2] - x[:, 1]) * (y[:, 0] - y[:, 2])
    top, left, wide = low(y, height), low(x, width), np.maximum(high(x, width) - low(x, width) + 1, 0)
    lines = np.where((np.abs(area) >= 1e-12) & (wide > 0), np.maximum(high(y, height) - top + 1, 0), 0)
    ends = np.cumsum(lines)
    step = max(1, PIXELS_AT_ONCE // width)
    for start in range(0, int(ends[-1]) if len(ends) else 0, step):
        line = np.arange(start, min(start + step, int(ends[-1])))  # a line of a triangle's box
        of = np.searchsorted(ends, line, side="right")
        rows, count = top[of] + line - (ends[of] - lines[of]), wide[of]
        t, row = np.repeat(of, count), np.repeat(rows, count)
        column = np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count) + left[t]
        px, py = column + 0.5, row + 0.5
        x0, x1, x2, y0, y1, y2 = (c[t, k] for c in (x, y) for k in range(3))
        a = ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / area[t]
        b = ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / area[t]
        c = 1.0 - a - b
        inside = (a >= 0) & (b >= 0) & (c >= 0)
        t = t[inside]
        yield t, column[inside], row[inside], a[inside] * z[t, 0] + b[inside] * z[t, 1] + c[inside] * z[t, 2]


def pixels(found: DataFrame, cameras: DataFrame, width: int = WIDTH, height: int = HEIGHT, field: float = FIELD) -> DataFrame:
    """PIXELS: of every pixel that something covers the nearest triangle; of equal depths the first in order.

    found: TRIANGLES; cameras: scene_id, eye, target and perhaps up.
    """
    up = F.col("up") if "up" in cameras.columns else F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    sizes = found.groupBy("scene_id").agg(F.count("*").alias("_n"))
    told = cameras.select("scene_id", "eye", "target", up.alias("up")).join(sizes, "scene_id")
    total = sizes.agg(F.sum("_n")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIXELS.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            ints = {c: batch.column(c).to_numpy() for c in ("object_ix", "element_ix", "triangle_ix")}
            order = np.lexsort([ints["triangle_ix"], ints["element_ix"], ints["object_ix"]])
            numbers = lambda name, n: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)[order]  # noqa: B023, E731
            views, which = np.unique(np.concatenate([numbers(c, 3) for c in ("eye", "target", "up")], axis=1), axis=0, return_inverse=True)
            m = np.stack([projection(v[:3], v[3:6], v[6:], width, height, field).ravel() for v in views])[which.ravel()]
            kept, x, y, z = seen(m.T[:, :, None], numbers("v", 9), width, height)
            kept = np.flatnonzero(kept)
            scene = batch.column("scene_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[order]
            rgb = (numbers("rgb", 3) * 255).astype(np.int32)
            for t, column, row, depth in covered(x[kept], y[kept], z[kept], width, height):
                t = kept[t]
                pixel = (scene[t] * height + row) * width + column
                nearest = np.lexsort([t, depth, pixel])
                nearest = nearest[np.r_[True, np.diff(pixel[nearest]) != 0][: len(nearest)]]
                t = t[nearest]
                at = pa.array(order[t])
                found = {c: batch.column(c).take(at) for c in ("scene_id", "object_ix", "element_ix", "triangle_ix", "object_id")} | {c: pa.array(rgb[t, k]) for k, c in enumerate("rgb")}
                found |= {"x": pa.array(column[nearest].astype(np.int32)), "y": pa.array(row[nearest].astype(np.int32)), "depth": pa.array(depth[nearest])}
                yield pa.RecordBatch.from_arrays([found[c] for c in names], names=names)

    some = dealt(joined(found, told, ["scene_id"], "_n", total)).mapInArrow(run, PIXELS)
    rest = [c.split()[0] for c in PIXELS.split(", ")][3:]
    return some.groupBy("scene_id", "x", "y").agg(F.min(F.struct(*rest)).alias("p")).select("scene_id", "x", "y", "p.*")


def png(rows: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) bytes."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, _ = rows.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def images(found: DataFrame, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(scene_id, png) of PIXELS: one picture a group, so a task holds width times height pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((height, width, 3), [int(c * 255) for c in BACKGROUND], np.uint8)
        out[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]]
        return pd.DataFrame({"scene_id": [pdf["scene_id"].iloc[0]], "png": [png(out)]})

    return found.select("scene_id", "x", "y", "r", "g", "b").groupBy("scene_id").applyInPandas(run, "scene_id string, png binary")


def render(scenes: DataFrame, cameras: DataFrame | None = None, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """PIXELS of (scene_id, scene JSON) rows, by given cameras or by one that sees all of a scene."""
    found = stored(triangles(elements(scenes)))
    return pixels(found, auto_cameras(found) if cameras is None else cameras, width, height)
