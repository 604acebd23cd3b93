"""Scene graphs: transforms, bounding boxes of elements and objects, validation."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import hierarchy
from quillon.operators.shapes import sample

SURFACE_SAMPLES = 2048
# Required parameters of each element type.
PARAMETERS = {
    "sphere": ["radius_cm"], "ellipsoid": ["radius_x_cm", "radius_y_cm", "radius_z_cm"], "box": ["size_x_cm", "size_y_cm", "size_z_cm"], "cylinder": ["radius_cm", "height_cm"], "cone": ["radius_cm", "height_cm"],
    "torus": ["major_radius_cm", "minor_radius_cm"], "capsule": ["radius_cm", "height_cm"], "plane": [], "sheet": ["size_x_cm", "size_y_cm", "thickness_cm"], "wedge": ["size_x_cm", "size_y_cm", "size_z_cm"],
    "prism": ["size_x_cm", "size_y_cm"], "pyramid": ["base_size_x_cm", "base_size_y_cm", "height_cm"], "hemisphere": ["radius_cm"], "frustum": ["bottom_radius_cm", "top_radius_cm", "height_cm"],
}


def half_extents(kind: Column, parameters: Column) -> Column:
    """struct<lo, hi> of an element in its own frame; parameters: map<string, double>. Unknown types have no extent."""
    p = lambda name: F.try_element_at(parameters, F.lit(name))
    sym = lambda x, y, z: F.struct(F.array(-x, -y, -z).alias("lo"), F.array(x, y, z).alias("hi"))
    r, h, zero = p("radius_cm"), p("height_cm"), F.lit(0.0)
    out = F.when(kind == "sphere", sym(r, r, r)).when(kind == "ellipsoid", sym(p("radius_x_cm"), p("radius_y_cm"), p("radius_z_cm")))
    out = out.when(kind.isin("box", "wedge"), sym(p("size_x_cm") / 2, p("size_y_cm") / 2, p("size_z_cm") / 2)).when(kind.isin("cylinder", "cone"), sym(r, r, h / 2))
    major, minor = p("major_radius_cm"), p("minor_radius_cm")
    out = out.when(kind == "torus", sym(major + minor, major + minor, minor)).when(kind == "capsule", sym(r, r, h / 2 + r))
    wide = lambda name: F.coalesce(F.when(p(name) != 0, p(name)), F.lit(100.0)) / 2
    out = out.when(kind == "plane", sym(wide("size_x_cm"), wide("size_y_cm"), zero)).when(kind == "sheet", sym(p("size_x_cm") / 2, p("size_y_cm") / 2, p("thickness_cm") / 2))
    side = F.greatest(p("size_x_cm"), p("size_y_cm")) / 2
    out = out.when(kind == "prism", sym(side, side, p("size_y_cm") / 2)).when(kind == "pyramid", sym(p("base_size_x_cm") / 2, p("base_size_y_cm") / 2, h / 2))
    foot = F.greatest(p("bottom_radius_cm"), p("top_radius_cm"))
    out = out.when(kind == "hemisphere", F.struct(F.array(-r, -r, zero).alias("lo"), F.array(r, r, r).alias("hi"))).when(kind == "frustum", sym(foot, foot, h / 2))
    return out.otherwise(sym(zero, zero, zero))


def rotation(q: np.ndarray) -> np.ndarray:
    """3 x 3 of a quaternion [x, y, z, w]."""
    x, y, z, w = q / (np.linalg.norm(q) or 1.0)
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


def matrix(transform: dict | list | None) -> np.ndarray:
    """4 x 4 that scales, then rotates, then translates; a 4 x 4 itself stays."""
    if isinstance(transform, list):
        return np.asarray(transform, float)
    t = transform or {}
    out = np.eye(4)
    out[:3, :3] = rotation(np.asarray(t.get("rotation") or [0, 0, 0, 1], float)) * np.asarray(t.get("scale") or [1, 1, 1], float)
    out[:3, 3] = t.get("translation") or [0, 0, 0]
    return out


def within(m: np.ndarray, point: np.ndarray, normal: np.ndarray) -> tuple[list[float], list[float]]:
    """A plane of the outer frame (a point, a normal) in the frame that m leads out of."""
    n = m[:3, :3].T @ normal
    return (np.linalg.inv(m) @ np.append(point, 1.0))[:3].tolist(), (n / np.linalg.norm(n)).tolist()


def quaternion(r: np.ndarray) -> list[float]:
    """[x, y, z, w] of a rotation matrix: the eigenvector of its quaternion form."""
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0], [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]],
    ]) / 3
    v = np.linalg.eigh(k)[1][:, -1]
    return [float(x) for x in (v if v[3] >= 0 else -v)]


def parts(m: np.ndarray) -> tuple[dict, float]:
    """A matrix as translation, rotation and scale, and what shear that leaves."""
    a = m[:3, :3]
    scale = np.linalg.norm(a, axis=0)
    u, _, vt = np.linalg.svd(a / np.where(scale > 0, scale, 1))
    r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
    return {"translation": [float(x) for x in m[:3, 3]], "rotation": quaternion(r), "scale": [float(x) for x in scale]}, float(np.abs(a - r * scale).max())


def worlds(objects: dict[str, dict]) -> dict[str, np.ndarray]:
    """World matrices by object id: the parents' times one's own; a world override wins. Cycles end at their second visit."""
    done: dict[str, np.ndarray] = {}
    for start in objects:
        way, k = [], start
        while k in objects and k not in done and k not in way:
            way.append(k)
            k = objects[k].get("parent_object_id")
        for k in reversed(way):
            own = objects[k]
            if own.get("world_override"):
                done[k] = matrix(own["world_override"])
            else:
                done[k] = done.get(own.get("parent_object_id"), np.eye(4)) @ matrix(own.get("transform"))
    return done


def world_box(obj: dict, world: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axis-aligned box of an object: the corners of its elements, or samples of the surface where an element is clipped."""
    points = []
    for e in obj.get("elements") or []:
        m = world @ matrix(e.get("transform"))
        if e.get("clips"):
            x = sample(e, SURFACE_SAMPLES)
        else:
            lo, hi = _extent(e)
            x = np.array([[(lo, hi)[i >> k & 1][k] for k in range(3)] for i in range(8)])
        if len(x):
            points.append(x @ m[:3, :3].T + m[:3, 3])
    if not points:
        return world[:3, 3], world[:3, 3]
    x = np.concatenate(points)
    return x.min(axis=0), x.max(axis=0)


def _extent(e: dict) -> tuple[np.ndarray, np.ndarray]:
    p, kind = e.get("parameters") or {}, e["element_type"]
    r, h = p.get("radius_cm", 0.0), p.get("height_cm", 0.0)
    wide = lambda n: (p.get(n) or 100.0) / 2
    side = max(p.get("size_x_cm", 0.0), p.get("size_y_cm", 0.0)) / 2
    foot = max(p.get("bottom_radius_cm", 0.0), p.get("top_radius_cm", 0.0))
    third = lambda *n: [p.get(x, 0.0) / 2 for x in n]
    half = {
        "sphere": [r, r, r], "ellipsoid": [p.get(f"radius_{a}_cm", 0.0) for a in "xyz"], "box": third("size_x_cm", "size_y_cm", "size_z_cm"), "wedge": third("size_x_cm", "size_y_cm", "size_z_cm"),
        "cylinder": [r, r, h / 2], "cone": [r, r, h / 2], "torus": [p.get("major_radius_cm", 0.0) + p.get("minor_radius_cm", 0.0)] * 2 + [p.get("minor_radius_cm", 0.0)], "capsule": [r, r, h / 2 + r],
        "plane": [wide("size_x_cm"), wide("size_y_cm"), 0.0], "sheet": third("size_x_cm", "size_y_cm", "thickness_cm"), "prism": [side, side, p.get("size_y_cm", 0.0) / 2],
        "pyramid": third("base_size_x_cm", "base_size_y_cm", "height_cm"), "hemisphere": [r, r, r], "frustum": [foot, foot, h / 2],
    }.get(kind, [0.0, 0.0, 0.0])
    hi = np.array(half, float)
    lo = -hi
    if kind == "hemisphere":
        lo[2] = 0.0
    return lo, hi


BOXES = "scene_id string, object_id string, template string, parent string, box struct<lo:array<double>,hi:array<double>>"


def scene_boxes(scenes: DataFrame, without: str | None = None) -> DataFrame:
    """BOXES of every object of (scene_id, scene JSON) rows. A scene is {objects: {id: {...}}}, perhaps in a `3d_assembly` envelope.

    Objects whose id holds the text `without` are left out, and nothing of them is measured.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for scene_id, text in zip(pdf["scene_id"], pdf["scene"], strict=True):
                objects = unwrapped(text)["objects"]
                at = worlds(objects)
                for k, o in objects.items():
                    if without is not None and without in k:
                        continue
                    lo, hi = world_box(o, at[k])
                    rows.append((scene_id, k, o.get("template"), o.get("parent_object_id"), {"lo": lo.tolist(), "hi": hi.tolist()}))
            yield pd.DataFrame(rows, columns=["scene_id", "object_id", "template", "parent", "box"])

    return scenes.select("scene_id", "scene").mapInPandas(run, BOXES)


# Names of the scene format, and the engine's own for them.
NAMES = {"template_name": "template", "object_transform": "transform", "mass_grams": "mass", "world_matrix_override": "world_override"}
TRANSFORM_NAMES = {"translate": "translation", "rotate": "rotation"}
CONTACT_NAMES = {"object_a": "a", "object_b": "b"}


def renamed(fields: dict, names: dict[str, str]) -> dict:
    return {names.get(k, k): v for k, v in fields.items()}


def own_transform(t: object) -> object:
    return renamed(t, TRANSFORM_NAMES) if isinstance(t, dict) else t


def own_element(e: dict) -> dict:
    return e | {"transform": own_transform(e["transform"])} if e.get("transform") else e


def own_object(obj: dict) -> dict:
    """An object of the scene format under the engine's names; cuts of the whole object become cuts of its elements."""
    out = renamed(obj, NAMES)
    for field in ("transform", "world_override"):
        if out.get(field):
            out[field] = own_transform(out[field])
    elements = [own_element(e) for e in out.get("elements") or []]
    clips = (out.get("metadata") or {}).get("clips") or []
    for e in elements if clips else []:
        m = matrix(e.get("transform"))
        cuts = [dict(zip(("point", "normal"), within(m, np.asarray(c["point"], float), np.asarray(c["normal"], float)), strict=True)) for c in clips]
        e["clips"] = [*(e.get("clips") or []), *cuts]
    if clips:
        out["metadata"] = {k: v for k, v in out["metadata"].items() if k != "clips"}
    return out | {"elements": elements}


def unwrapped(text: str) -> dict:
    """A scene under the engine's names, from its own format or the scene format, perhaps in a `3d_assembly` envelope."""
    scene = json.loads(text)
    scene = scene.get("3d_assembly", scene)
    objects = scene.get("objects") or {}
    each = objects.values() if isinstance(objects, dict) else objects
    keys = objects.keys() if isinstance(objects, dict) else (o["object_id"] for o in objects)
    scene["objects"] = {k: own_object(o) for k, o in zip(keys, each, strict=True)}
    scene["contacts"] = [renamed(c, CONTACT_NAMES) for c in scene.get("contacts") or []]
    return scene


def wrapped(scene: dict) -> str:
    """The scene format of a scene, in its envelope: read again, it is the same scene."""
    back = lambda names: {v: k for k, v in names.items()}
    outer = lambda t: renamed(t, back(TRANSFORM_NAMES)) if isinstance(t, dict) else t
    objects = []
    for o in scene["objects"].values():
        elements = [e | {"transform": outer(e["transform"])} if e.get("transform") else e for e in o.get("elements") or []]
        fields = o | {f: outer(o[f]) for f in ("transform", "world_override") if o.get(f)}
        objects.append(renamed(fields | {"elements": elements}, back(NAMES)))
    return json.dumps({"3d_assembly": scene | {"objects": objects, "contacts": [renamed(c, back(CONTACT_NAMES)) for c in scene.get("contacts") or []]}}, sort_keys=True)


ISSUES = "scene_id string, object_id string, issue string"


def validate(scenes: DataFrame) -> DataFrame:
    """ISSUES: unknown element types, missing or non-positive parameters, missing parents, cycles, contacts with unknown objects."""

    def check(scene: dict):
        objects = scene["objects"]
        for k, o in objects.items():
            for e in o.get("elements") or []:
                kind = e.get("element_type")
                if kind not in PARAMETERS:
                    yield k, f"unknown element type {kind}"
                    continue
                for name in PARAMETERS[kind]:
                    v = (e.get("parameters") or {}).get(name)
                    if not isinstance(v, int | float) or v <= 0:
                        if not (kind == "frustum" and v == 0):
                            yield k, f"{kind} lacks a positive {name}"
            parent = o.get("parent_object_id")
            if parent is not None and parent not in objects:
                yield k, f"unknown parent {parent}"
            seen, p = {k}, parent
            while p in objects and p not in seen:
                seen.add(p)
                p = objects[p].get("parent_object_id")
            if p == k and parent is not None:
                yield k, "its own ancestor"
        for c in scene.get("contacts") or []:
            for end in (c.get("a"), c.get("b")):
                if end not in objects:
                    yield str(end), "contact with an unknown object"

    def run(batches):
        for pdf in batches:
            rows = [(i, *x) for i, text in zip(pdf["scene_id"], pdf["scene"], strict=True) for x in check(unwrapped(text))]
            yield pd.DataFrame(rows, columns=["scene_id", "object_id", "issue"])

    return scenes.select("scene_id", "scene").mapInPandas(run, ISSUES)


def largest_dimension(elements: Column) -> Column:
    """The length that stands for an object without dimensions: of its greatest element; elements: array<struct<element_type, parameters: map>>."""

    def one(e: Column) -> Column:
        kind = e["element_type"]
        p = lambda name: F.coalesce(F.try_element_at(e["parameters"], F.lit(name)), F.lit(0.0))
        size = F.when(kind == "sphere", 2 * p("radius_cm")).when(kind == "box", F.greatest(p("size_x_cm"), p("size_y_cm"), p("size_z_cm"))).when(kind == "cylinder", F.greatest(2 * p("radius_cm"), p("height_cm")))
        size = size.when(kind == "capsule", 2 * p("radius_cm") + p("height_cm")).when(kind == "frustum", F.greatest(2 * p("bottom_radius_cm"), 2 * p("top_radius_cm"), p("height_cm")))
        return size.otherwise(F.coalesce(F.array_max(F.map_values(e["parameters"])), F.lit(0.0)))

    size = F.array_max(F.transform(elements, one))
    return F.when(size > 0, size)


PLACEHOLDER = "array<struct<element_type:string,parameters:map<string,double>>>"


def built(specs: DataFrame, elements: DataFrame, side_cm: float = 10.0) -> DataFrame:
    """specs (scene_id, obj_id, template, parent_object_id) with elements and is_placeholder: those of the template, a box where it has none."""
    known = elements.select("template", "elements")
    box = F.array(F.struct(F.lit("box").alias("element_type"), F.create_map(*(F.lit(x) for a in "xyz" for x in (f"size_{a}_cm", side_cm))).alias("parameters"))).cast(PLACEHOLDER)
    joined = specs.join(known, "template", "left")
    empty = F.coalesce(F.size("elements") < 1, F.lit(True))
    return joined.withColumn("is_placeholder", empty).withColumn("elements", F.when(empty, box).otherwise(F.col("elements")))


def linked_composites(specs: DataFrame, composites: DataFrame) -> DataFrame:
    """specs with parent_object_id filled in: an object without a parent hangs from the first object of its scene whose template is composed of its own.

    composites: template, child_template. specs need place, an object's order in its scene.
    """
    free = specs.where("parent_object_id is null").select("scene_id", "obj_id", F.col("template").alias("child_template"))
    owners = specs.select("scene_id", F.col("obj_id").alias("owner"), "template", F.col("place").alias("owner_place"))
    near = free.join(composites, "child_template").join(owners, ["scene_id", "template"]).where("owner <> obj_id")
    first = near.groupBy("scene_id", "obj_id").agg(F.min_by("owner", F.struct("owner_place", "owner")).alias("_owner"))
    return specs.join(first, ["scene_id", "obj_id"], "left").withColumn("parent_object_id", F.coalesce("parent_object_id", "_owner")).drop("_owner")


def placement_order(specs: DataFrame) -> DataFrame:
    """(scene_id, obj_id, depth): parents before children; what hangs from nothing known is a root, what only hangs from itself has no depth."""
    return hierarchy.rooted(specs, ["scene_id"], "obj_id", "parent_object_id").select("scene_id", "obj_id", F.col("depth").cast("int").alias("depth"))


def descendants(specs: DataFrame) -> DataFrame:
    """(scene_id, obj_id, below, depth): each object with all that hang from it, children at depth 1; on a cycle each pair once, no object under itself."""
    found = hierarchy.ancestors(specs, ["scene_id"], "obj_id", "parent_object_id")
    return found.select("scene_id", F.col("above").alias("obj_id"), F.col("obj_id").alias("below"), F.col("steps").cast("int").alias("depth"))


def world_matrices(placed: DataFrame) -> DataFrame:
    """(scene_id, obj_id, depth, world): the 4 x 4 of each object, sixteen numbers by rows, that leads to the world.

    placed: scene_id, obj_id, parent_object_id, local (sixteen numbers) and perhaps override, which takes the place of all above. On a cycle there is none.
    """
    over = F.col("override") if "override" in placed.columns else F.lit(None).cast("array<double>")
    free = placed.select("scene_id", "obj_id", F.when(over.isNull(), F.col("parent_object_id")).alias("parent_object_id"), F.coalesce(over, F.col("local")).alias("local"))
    return hierarchy.rooted(free, ["scene_id"], "obj_id", "parent_object_id", {"world": (F.col("local"), hierarchy.product)}).drop("root")


def contacts_of(contacts: DataFrame, obj: str | Column) -> DataFrame:
    """The contacts (a, b) that an object is in."""
    return contacts.where((F.col("a") == obj) | (F.col("b") == obj))


def in_contact(contacts: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """The contacts of two objects, either way round."""
    return contacts.where(((F.col("a") == a) & (F.col("b") == b)) | ((F.col("a") == b) & (F.col("b") == a)))
