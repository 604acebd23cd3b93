"""Renders over the driver's tables: eight parts in a row are the boxes of a scene, all scenes are seen by one stated camera."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import geometry, render, scene
from quillon.plans.registry import query
from quillon.session import table

WIDTH, HEIGHT = 32, 24
EYE, TARGET = (70.0, -90.0, 60.0), (18.0, 8.0, 4.0)
MATERIALS = ("red", "dark wood", "blue", None)


def scenes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, scene): a scene's parts stand in two rows of four, each a box."""
    k, size = F.col("p_partkey"), F.col("p_size")
    at = (k % 4 * 12).cast("double"), (F.floor(k / 4) % 2 * 15).cast("double"), (size / 4).cast("double")
    sides = (size % 7 + 3).cast("double"), (size % 5 + 4).cast("double"), (size % 11 + 2).cast("double")
    element = F.struct(F.lit("box").alias("element_type"), F.struct(*(c.alias(f"size_{a}_cm") for a, c in zip("xyz", sides, strict=True))).alias("parameters"))
    named = F.element_at(F.array(*map(F.lit, MATERIALS)), (k % 4 + 1).cast("int"))
    obj = F.struct(F.lpad(k.cast("string"), 10, "0").alias("object_id"), F.struct(F.array(*at).alias("translation")).alias("transform"), F.struct(named.alias("color")).alias("material"), F.array(element).alias("elements"))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 8).cast("string").alias("scene_id"), obj.alias("o"))
    return rows.groupBy("scene_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("o")).alias("objects"))).alias("scene"))  # eight parts


def _sql() -> str:
    m = [repr(float(x)) + "::DOUBLE" for x in render.projection(np.array(EYE), np.array(TARGET), np.array([0.0, 0.0, 1.0]), WIDTH, HEIGHT).ravel()]
    signs = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    corners = [[signs[i] for i in (f[0], f[k], f[k + 1])] for f in render._BOX for k in (1, 2)]
    faces = ", ".join(f"({i}, {', '.join(str(c) for corner in t for c in corner)})" for i, t in enumerate(corners))
    names = ", ".join(f"{a}{i}" for i in range(3) for a in "pqr")
    light = float(np.sqrt(sum(c * c for c in render.LIGHT)))
    lx, ly, lz = (repr(c / light) + "::DOUBLE" for c in render.LIGHT)
    colours = [render.colour({"color": c}) for c in MATERIALS]
    rgb = ", ".join(f"CASE p_partkey % 4 {' '.join(f'WHEN {i} THEN {c[k]!r}::DOUBLE' for i, c in enumerate(colours))} END AS {name}" for k, name in enumerate(("cr", "cg", "cb")))
    world = ", ".join(f"tx + {p}{i} * (sx / 2) AS x{i}, ty + {q}{i} * (sy / 2) AS y{i}, tz + {r}{i} * (sz / 2) AS z{i}" for i in range(3) for p, q, r in ["pqr"])
    row = lambda k, i: f"({m[4 * k]} * x{i} + {m[4 * k + 1]} * y{i} + {m[4 * k + 2]} * z{i} + {m[4 * k + 3]})"
    clip = ", ".join(f"{row(k, i)} AS {n}{i}" for i in range(3) for k, n in enumerate(("cx", "cy", "cz", "w")))
    screen = ", ".join(f"(cx{i} / w{i} + 1.0::DOUBLE) * 0.5::DOUBLE * {WIDTH} AS u{i}, (1.0::DOUBLE - cy{i} / w{i}) * 0.5::DOUBLE * {HEIGHT} AS v{i}, cz{i} / w{i} AS d{i}" for i in range(3))
    return f"""WITH b AS (SELECT p_partkey, (p_partkey % 4 * 12)::DOUBLE AS tx, (p_partkey // 4 % 2 * 15)::DOUBLE AS ty, p_size::DOUBLE / 4 AS tz, (p_size % 7 + 3)::DOUBLE AS sx, (p_size % 5 + 4)::DOUBLE AS sy, (p_size % 11 + 2)::DOUBLE AS sz, {rgb} FROM part),
t AS (SELECT p_partkey, tri, cr, cg, cb, {world} FROM b, (VALUES {faces}) f(tri, {names})),
e AS (SELECT *, y1 - y0 AS ay, z1 - z0 AS az, x1 - x0 AS ax, x2 - x0 AS bx, y2 - y0 AS by_, z2 - z0 AS bz FROM t),
n AS (SELECT *, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM e),
s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM n),
c AS (SELECT p_partkey, tri, cr, cg, cb, {render.AMBIENT}::DOUBLE + {render.DIFFUSE}::DOUBLE * abs(nx / len * {lx} + ny / len * {ly} + nz / len * {lz}) AS lit, {clip} FROM s),
g AS (SELECT p_partkey, tri, floor(255 * least(1.0::DOUBLE, lit * cr))::INT AS r, floor(255 * least(1.0::DOUBLE, lit * cg))::INT AS g, floor(255 * least(1.0::DOUBLE, lit * cb))::INT AS b, {screen} FROM c),
a AS (SELECT *, (v1 - v2) * (u0 - u2) + (u2 - u1) * (v0 - v2) AS area FROM g),
p AS (SELECT *, unnest(range(greatest(0, floor(least(u0, u1, u2))::BIGINT), least({WIDTH - 1}, ceil(greatest(u0, u1, u2))::BIGINT) + 1)) AS x FROM a),
q AS (SELECT *, unnest(range(greatest(0, floor(least(v0, v1, v2))::BIGINT), least({HEIGHT - 1}, ceil(greatest(v0, v1, v2))::BIGINT) + 1)) AS y FROM p),
k AS (SELECT *, ((v1 - v2) * (x + 0.5::DOUBLE - u2) + (u2 - u1) * (y + 0.5::DOUBLE - v2)) / area AS l0, ((v2 - v0) * (x + 0.5::DOUBLE - u2) + (u0 - u2) * (y + 0.5::DOUBLE - v2)) / area AS l1 FROM q WHERE abs(area) >= 1e-12),
h AS (SELECT *, 1.0::DOUBLE - l0 - l1 AS l2 FROM k),
z AS (SELECT p_partkey // 8 AS scene, x, y, p_partkey, tri, r, g, b, l0 * d0 + l1 * d1 + l2 * d2 AS depth FROM h WHERE l0 >= 0 AND l1 >= 0 AND l2 >= 0)
SELECT scene::VARCHAR AS scene_id, x::INT AS x, y::INT AS y, round(depth, 9) AS depth, lpad(p_partkey::VARCHAR, 10, '0') AS object_id, r, g, b FROM z QUALIFY row_number() OVER (PARTITION BY scene, x, y ORDER BY depth, p_partkey, tri) = 1"""


@query(_sql())
def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of every scene's picture."""
    point = lambda p: F.array(*map(F.lit, p))
    scenes = scenes_of(spark, sf_dir)
    cameras = scenes.select("scene_id", point(EYE).alias("eye"), point(TARGET).alias("target"))
    return render.render(scenes, cameras, WIDTH, HEIGHT).select("scene_id", "x", "y", F.round("depth", 9).alias("depth"), "object_id", "r", "g", "b")


_STOOD_SQL = """b AS (SELECT p_partkey // 8 AS s, p_partkey % 8 AS i, lpad(p_partkey::VARCHAR, 10, '0') AS id, (p_partkey % 4 * 12)::DOUBLE AS x, (p_partkey // 4 % 2 * 15)::DOUBLE AS y, p_size::DOUBLE / 4 AS z, (p_size % 7 + 3)::DOUBLE / 2 AS a, (p_size % 5 + 4)::DOUBLE / 2 AS b, (p_size % 11 + 2)::DOUBLE / 2 AS c FROM part),
w AS (SELECT s FROM b GROUP BY s HAVING count(*) = 8),
e AS (SELECT * FROM b JOIN w USING (s)),
m AS (
  SELECT s, id, x + CASE i WHEN 0 THEN 6 ELSE 5 END AS x, y, z, a, b, c FROM e WHERE i < 2 UNION ALL SELECT s, id, x, y, z, 2 * a, b, c FROM e WHERE i = 2 UNION ALL SELECT s, id, x, y, z, b, a, c FROM e WHERE i = 3
  UNION ALL SELECT s, 'new', 1, 2, 3, 1, 1, 1 FROM w),
l AS (SELECT s, id, [x - a, y - b, z - c, x + a, y + b, z + c] AS box FROM m UNION ALL SELECT s, 'whole', [min(x - a), min(y - b), min(z - c), max(x + a), max(y + b), max(z + c)] FROM e WHERE i IN (4, 5) GROUP BY s)"""


def _operations(scenes: DataFrame) -> DataFrame:
    """(scene_id, op_ix, op): what is done to the eight boxes of a scene."""
    ids = F.from_json(F.get_json_object("scene", "$.objects[*].object_id"), "array<string>")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else ids[p] for p in parts))
    ops = [
        text('{"op":"attach","object_id":"', 1, '","parent_id":"', 0, '"}'), text('{"op":"move","object_id":"', 0, '","delta":[5,0,0]}'), text('{"op":"detach","object_id":"', 1, '"}'), text('{"op":"move","object_id":"', 0, '","delta":[1,0,0]}'),
        text('{"op":"compound","operations":[{"op":"scale","object_id":"', 2, '","factor":[2,1,1]},{"op":"rotate","object_id":"', 3, '","rotation":[0,0,0.7071067811865476,0.7071067811865476]}]}'),
        text('{"op":"merge","object_ids":["', 4, '","', 5, '"],"new_id":"whole"}'), text('{"op":"chain_split","object_id":"', 6, '","axis":[1,0,0],"range":[20,28],"count":4}'),
        text('{"op":"add_object","object":{"object_id":"new","transform":{"translation":[1,2,3]},"elements":[]}}'), text('{"op":"add_element","object_id":"new","element":{"element_type":"box","parameters":{"size_x_cm":2,"size_y_cm":2,"size_z_cm":2}}}'),
        text('{"op":"remove_object","object_id":"', 7, '"}'), text('{"op":"change_properties","object_id":"', 0, '","properties":{"color":"green"}}'), text('{"op":"wait","duration":2.5}'), text('{"op":"emit_event","event":"done"}'), text('{"op":"detach","object_id":"nobody"}'),
    ]
    return scenes.select("scene_id", F.posexplode(F.array(*ops)).alias("op_ix", "op"))


def _operated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = scenes_of(spark, sf_dir).where(F.size(F.from_json(F.get_json_object("scene", "$.objects[*].object_id"), "array<string>")) == 8)
    return scene.replay(scenes, _operations(scenes))


@query(f"WITH {_STOOD_SQL} SELECT CAST(s AS VARCHAR) AS scene_id, id AS object_id, list_transform(box, lambda v: round(v, 6)) AS box FROM l")
def scene_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world boxes of what was attached, moved, detached, scaled, turned, merged and added."""
    found = geometry.scene_boxes(_operated(spark, sf_dir).select("scene_id", "scene"), without="_")  # slabs are measured by samples
    return found.select("scene_id", "object_id", F.transform(F.concat("box.lo", "box.hi"), lambda v: F.round(v, 6) + 0.0).alias("box"))
