"""Shapes as point clouds: surface samples, alignment, Chamfer similarity."""

from __future__ import annotations

import hashlib
import json
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

SAMPLES = 512
DECAY = 3.0


def chamfer(a: np.ndarray, b: np.ndarray, block: int = 1024) -> float:
    """Mean distance to the nearest point of the other cloud, both ways added."""

    to_b, to_a = [], np.full(len(b), np.inf)
    for k in range(0, len(a), block):
        x = a[k : k + block]
        squares = sum((x[:, None, c] - b[None, :, c]) ** 2 for c in range(a.shape[1]))
        to_b.append(squares.min(axis=1))
        to_a = np.minimum(to_a, squares.min(axis=0))
    return float(np.sqrt(np.concatenate(to_b)).mean()) + float(np.sqrt(to_a).mean())


#: Points of a cell on either side.
CELL = 4096


def chamfer_groups(points: DataFrame) -> DataFrame:
    """(left, right, chamfer) of every pair of the groups of (g, p) points.

    Equal points of a group are one point that counts as often. Each group is dealt into parts of about CELL points; a cell finds
    the squared distance from each point of one part to the nearest of another group's part, the least over all parts is the
    point's distance, and these are averaged. The nearest is found by inner products, its distance by differences.
    """
    rows = cut(points.groupBy("g", "p").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    dealt = rows.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = sizes.select(F.col("g").alias("h"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    mine = sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = mine.join(cells, F.col("g") != F.col("h"))  # stated groups, by their parts
    left = dealt.select("g", "part", "id", "n", "p").join(pairs, ["g", "part"]).groupBy("g", "part", "h", "other")
    right = dealt.select(F.col("g").alias("h"), F.col("part").alias("other"), F.col("p").alias("q")).join(pairs, ["h", "other"]).groupBy("g", "part", "h", "other")
    kind = points.schema["g"].dataType.simpleString()

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y = np.stack(b["q"].to_numpy())
            half = (y * y).sum(axis=1) / 2
            for at in range(0, len(a), 512):
                x = np.stack(a["p"].to_numpy()[at : at + 512])
                out.append(((x - y[(half - x @ y.T).argmin(axis=1)]) ** 2).sum(axis=1))
        found = np.concatenate(out) if out else np.empty(0)
        ids, times = (a[c].to_numpy()[: len(found)] if len(found) else np.empty(0, np.int64) for c in ("id", "n"))
        return pd.DataFrame({"g": [key[0]] * len(found), "h": [key[2]] * len(found), "id": ids, "n": times, "d": found})

    near = left.cogroup(right).applyInPandas(run, f"g {kind}, h {kind}, id long, n long, d double")
    least = near.groupBy("g", "h", "id").agg(F.first("n").alias("n"), F.min("d").alias("d"))
    mean = least.groupBy("g", "h").agg((F.sum(F.col("n") * F.sqrt("d")) / F.sum("n")).alias("m"))
    both = mean.withColumns({"left": F.least("g", "h"), "right": F.greatest("g", "h")})
    return both.groupBy("left", "right").agg(F.sum("m").alias("chamfer"))


def geometry_hash(element: dict) -> str:
    """A stable name of an element's geometry, its own transform included."""
    return hashlib.sha256(json.dumps({k: element.get(k) for k in ("element_type", "parameters", "clips", "transform")}, sort_keys=True).encode()).hexdigest()


def _sphere(rng, n, rx, ry, rz):
    d = rng.normal(size=(n, 3))
    return d / np.linalg.norm(d, axis=1, keepdims=True) * [rx, ry, rz]


def _box(rng, n, sx, sy, sz):
    areas = np.array([sy * sz, sx * sz, sx * sy])
    axis = rng.choice(3, size=n, p=areas / areas.sum())
    out = (rng.random((n, 3)) - 0.5) * [sx, sy, sz]
    out[np.arange(n), axis] = np.where(rng.random(n) < 0.5, -0.5, 0.5) * np.array([sx, sy, sz])[axis]
    return out


def _round(rng, n, r0, r1, h):
    """Side and caps of a frustum of height h, its axis along z."""
    slant = np.hypot(r0 - r1, h)
    areas = np.array([np.pi * (r0 + r1) * slant, np.pi * r0 * r0, np.pi * r1 * r1]) + 1e-12
    part, angle, u = rng.choice(3, size=n, p=areas / areas.sum()), rng.random(n) * 2 * np.pi, rng.random(n)
    if abs(r0 - r1) > 1e-9:  # further out there is more side
        t = (r0 - np.sqrt(r0 * r0 + u * (r1 * r1 - r0 * r0))) / (r0 - r1)
    else:
        t = u
    radius = np.choose(part, [r0 + (r1 - r0) * t, r0 * np.sqrt(u), r1 * np.sqrt(u)])
    z = np.choose(part, [t * h - h / 2, np.full(n, -h / 2), np.full(n, h / 2)])
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle), z])


def _torus(rng, n, major, minor):
    v = np.empty(0)
    while len(v) < n:  # the outer half has more surface
        x = rng.random(2 * n) * 2 * np.pi
        v = np.concatenate([v, x[rng.random(2 * n) < (major + minor * np.cos(x)) / (major + minor)]])
    v, u = v[:n], rng.random(n) * 2 * np.pi
    ring = major + minor * np.cos(v)
    return np.column_stack([ring * np.cos(u), ring * np.sin(u), minor * np.sin(v)])


def _capsule(rng, n, r, h):
    side = h / (h + 2 * r)
    out = _sphere(rng, n, r, r, r)
    out[:, 2] += np.where(out[:, 2] >= 0, h / 2, -h / 2)
    on_side = rng.random(n) < side
    angle = rng.random(n) * 2 * np.pi
    return np.where(on_side[:, None], np.column_stack([r * np.cos(angle), r * np.sin(angle), (rng.random(n) - 0.5) * h]), out)


def _hull(rng, n, corners, faces):
    """Area-weighted points on triangles."""
    tri = np.array([[corners[i] for i in f] for f in faces], dtype=float)
    area = np.linalg.norm(np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]), axis=1)
    pick = tri[rng.choice(len(tri), size=n, p=area / area.sum())]
    u, v = rng.random((2, n, 1))
    u, v = np.where(u + v > 1, 1 - u, u), np.where(u + v > 1, 1 - v, v)
    return pick[:, 0] + u * (pick[:, 1] - pick[:, 0]) + v * (pick[:, 2] - pick[:, 0])


def _pyramid(rng, n, x, y, h):
    c = [(-x / 2, -y / 2, -h / 2), (x / 2, -y / 2, -h / 2), (x / 2, y / 2, -h / 2), (-x / 2, y / 2, -h / 2), (0, 0, h / 2)]
    return _hull(rng, n, c, [(0, 1, 2), (0, 2, 3), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)])


def _wedge(rng, n, x, y, z):
    c = [(-x / 2, -y / 2, -z / 2), (x / 2, -y / 2, -z / 2), (x / 2, y / 2, -z / 2), (-x / 2, y / 2, -z / 2), (-x / 2, -y / 2, z / 2), (-x / 2, y / 2, z / 2)]
    return _hull(rng, n, c, [(0, 1, 2), (0, 2, 3), (0, 3, 5), (0, 5, 4), (1, 2, 5), (1, 5, 4), (0, 1, 4), (3, 2, 5)])


def _prism(rng, n, r, h, sides=6):
    ring = [(r * np.cos(2 * np.pi * k / sides), r * np.sin(2 * np.pi * k / sides)) for k in range(sides)]
    c = [(x, y, -h / 2) for x, y in ring] + [(x, y, h / 2) for x, y in ring]
    faces = [(0, k, k + 1) for k in range(1, sides - 1)] + [(sides, sides + k, sides + k + 1) for k in range(1, sides - 1)]
    for k in range(sides):
        m = (k + 1) % sides
        faces += [(k, m, sides + m), (k, sides + m, sides + k)]
    return _hull(rng, n, c, faces)


def _half(rng, n, r):
    out = _sphere(rng, n, r, r, r)
    out[:, 2] = np.abs(out[:, 2])
    flat = rng.random(n) < 1 / 3
    angle, radius = rng.random(n) * 2 * np.pi, r * np.sqrt(rng.random(n))
    return np.where(flat[:, None], np.column_stack([radius * np.cos(angle), radius * np.sin(angle), np.zeros(n)]), out)


#: element type -> points on its surface, from a generator, a count and its parameters
SAMPLERS = {
    "sphere": lambda g, n, p: _sphere(g, n, *[p["radius_cm"]] * 3),
    "ellipsoid": lambda g, n, p: _sphere(g, n, p["radius_x_cm"], p["radius_y_cm"], p["radius_z_cm"]),
    "box": lambda g, n, p: _box(g, n, p["size_x_cm"], p["size_y_cm"], p["size_z_cm"]),
    "cylinder": lambda g, n, p: _round(g, n, p["radius_cm"], p["radius_cm"], p["height_cm"]),
    "cone": lambda g, n, p: _round(g, n, p["radius_cm"], 0.0, p["height_cm"]),
    "torus": lambda g, n, p: _torus(g, n, p["major_radius_cm"], p["minor_radius_cm"]),
    "capsule": lambda g, n, p: _capsule(g, n, p["radius_cm"], p["height_cm"]),
    "plane": lambda g, n, p: (g.random((n, 3)) - 0.5) * [p.get("size_x_cm") or 100.0, p.get("size_y_cm") or 100.0, 0.0],
    "sheet": lambda g, n, p: _box(g, n, p["size_x_cm"], p["size_y_cm"], p["thickness_cm"]),
    "wedge": lambda g, n, p: _wedge(g, n, p["size_x_cm"], p["size_y_cm"], p["size_z_cm"]),
    "prism": lambda g, n, p: _prism(g, n, max(p["size_x_cm"], p["size_y_cm"]) / 2, p["size_y_cm"], int(p.get("num_sides") or 6)),
    "pyramid": lambda g, n, p: _pyramid(g, n, p["base_size_x_cm"], p["base_size_y_cm"], p["height_cm"]),
    "hemisphere": lambda g, n, p: _half(g, n, p["radius_cm"]),
    "frustum": lambda g, n, p: _round(g, n, p["bottom_radius_cm"], p["top_radius_cm"], p["height_cm"]),
}


def sample(element: dict, n: int = SAMPLES) -> np.ndarray:
    """n surface points of an element, the same each time; points cut off by its clip planes are left out."""
    seed = int(geometry_hash(element)[:8], 16)
    points = SAMPLERS[element["element_type"]](np.random.default_rng(seed), n, element.get("parameters") or {})
    for clip in element.get("clips") or []:
        normal, point = np.asarray(clip["normal"], float), np.asarray(clip["point"], float)
        points = points[(points - point) @ normal <= 0]
    return points


def aligned(points: np.ndarray) -> np.ndarray:
    """Centred, scaled to a mean radius of 1, and turned to the principal axes."""
    x = points - points.mean(axis=0)
    size = np.sqrt((x * x).sum(axis=1)).mean()
    x = x / size if size > 0 else x
    return x @ np.linalg.svd(x, full_matrices=False)[2].T if len(x) > 2 else x


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 / (1 + 3 * Chamfer), the best over the flips that keep the handedness of the axes."""
    x, y = aligned(a), aligned(b)
    flips = [np.array(s) for s in product((1, -1), repeat=3) if np.prod(s) == 1]
    return max(1 / (1 + DECAY * chamfer(x * f, y)) for f in flips)


def cloud(elements: list[dict], n: int = SAMPLES) -> np.ndarray:
    """n points of a shape, dealt evenly over its elements, each where its element's transform puts it."""
    from quillon.operators.geometry import matrix  # which takes samples from here

    out = []
    for k, e in enumerate(elements):
        m = matrix(e.get("transform"))
        share = max(1, n // len(elements)) + (k < n - max(1, n // len(elements)) * len(elements))
        out.append(sample(e, share) @ m[:3, :3].T + m[:3, 3])
    return np.concatenate(out)


def shape_hash(elements: list[dict], n: int = SAMPLES) -> str:
    """A stable name of a shape's cloud: of its elements' geometry in order, and of the number of points."""
    return hashlib.sha256(f"{n}|{'|'.join(map(geometry_hash, elements))}".encode()).hexdigest()


def clouds(elements: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(shape_id, points, cloud_key) of (shape_id, element JSON) rows; the elements of one shape are one cloud."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [json.loads(e) for e in sorted(pdf["element"])]
        return pd.DataFrame({"shape_id": [pdf["shape_id"].iloc[0]], "points": [cloud(parts, n).ravel().tolist()], "cloud_key": [shape_hash(parts, n)]})

    return elements.groupBy("shape_id").applyInPandas(run, "shape_id string, points array<double>, cloud_key string")


def kept_clouds(elements: DataFrame, folder: str, n: int = SAMPLES) -> DataFrame:
    """clouds, with those already in folder (Parquet, in storage that all executors share) read and the others added to it."""
    spark = elements.sparkSession

    @F.pandas_udf("string")
    def key(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: shape_hash([json.loads(e) for e in x], n))

    wanted = elements.groupBy("shape_id").agg(F.array_sort(F.collect_list("element")).alias("es")).select("shape_id", key("es").alias("cloud_key"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = wanted.join(spark.read.parquet(folder), "cloud_key", "left_anti")
    else:
        new = wanted
    fresh = clouds(elements.join(new.groupBy("cloud_key").agg(F.min("shape_id").alias("shape_id")), "shape_id", "left_semi"), n)
    fresh.select("cloud_key", "points").write.mode("append").parquet(folder)
    kept = spark.read.parquet(folder).dropDuplicates(["cloud_key"])  # two writers may have added the same cloud
    return wanted.join(kept, "cloud_key").select("shape_id", "points", "cloud_key")


def shape_similarities(elements: DataFrame, pairs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(left, right, similarity) of the stated pairs of shape ids."""
    known = clouds(elements, n)
    both = pairs.join(known.select(F.col("shape_id").alias("left"), F.col("points").alias("a")), "left").join(known.select(F.col("shape_id").alias("right"), F.col("points").alias("b")), "right")

    def run(batches):
        for pdf in batches:
            pdf["similarity"] = [similarity(np.reshape(a, (-1, 3)), np.reshape(b, (-1, 3))) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[["left", "right", "similarity"]]

    return both.select("left", "right", "a", "b").mapInPandas(run, "left string, right string, similarity double")
