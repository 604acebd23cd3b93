"""Scene operations: pure steps from an old scene to a new one with events, folded in order for each scene."""

from __future__ import annotations

import copy
import json
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.geometry import CONTACT_NAMES, matrix, own_element, own_object, own_transform, parts, renamed, rotation, unwrapped, within, worlds

Step = Callable[[dict, dict, list], None]
STEPS: dict[str, Step] = {}


# Field names of the operation format, and the engine's own for them.
FIELDS = {
    "add_object": {"object_transform": "world_transform"}, "set_transform": {"world_transform": "transform"}, "remove_element": {"element_index": "index"}, "rotate": {"quaternion": "rotation"}, "attach": {"child_id": "object_id"}, "detach": {"child_id": "object_id"},
    "split": {"source_id": "object_id", "new_object_ids": "new_ids", "cut_point_world": "point", "cut_normal_world": "normal"}, "merge": {"new_object_id": "new_id"}, "contact": CONTACT_NAMES, "release": CONTACT_NAMES,
}


class Invalid(ValueError):
    """An operation that can't be applied to the scene."""


def step(name: str) -> Callable[[Step], Step]:
    def add(f: Step) -> Step:
        STEPS[name] = f
        return f

    return add


def _object(scene: dict, op: dict, field: str = "object_id") -> dict:
    key = op.get(field)
    if key not in scene["objects"]:
        raise Invalid(f"{op.get('op')}: unknown object {key}")
    return scene["objects"][key]


def _vector(op: dict, field: str, n: int = 3) -> np.ndarray:
    v = op.get(field)
    if not isinstance(v, list) or len(v) != n:
        raise Invalid(f"{op.get('op')}: {field} needs {n} numbers")
    return np.asarray(v, float)


def _transform(obj: dict) -> dict:
    return obj.setdefault("transform", {"translation": [0.0, 0.0, 0.0], "rotation": [0.0, 0.0, 0.0, 1.0], "scale": [1.0, 1.0, 1.0]})


def _place(scene: dict, key: str, world: np.ndarray) -> None:
    """Give an object a world matrix through its parent's inverse."""
    obj = scene["objects"][key]
    above = worlds(scene["objects"]).get(obj.get("parent_object_id"), np.eye(4))
    obj["transform"] = parts(np.linalg.inv(above) @ world)[0]


def _times(a: list[float], b: list[float]) -> list[float]:
    (x1, y1, z1, w1), (x2, y2, z2, w2) = a, b
    return [w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2, w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2, w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2, w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2]


def _drop(scene: dict, key: str) -> None:
    del scene["objects"][key]
    for o in scene["objects"].values():
        if o.get("parent_object_id") == key:
            o["parent_object_id"] = None
    scene["contacts"] = [c for c in scene.get("contacts") or [] if key not in (c.get("a"), c.get("b"))]
    scene["timeline"] = [k for k in scene.get("timeline") or [] if k.get("object_id") != key]


@step("add_object")
def _add_object(scene: dict, op: dict, events: list) -> None:
    given = op.get("object") or {k: v for k, v in op.items() if k not in ("op", "world_transform")}
    obj = own_object(copy.deepcopy(given))
    key = obj.get("object_id") or op.get("object_id")
    if not key or key in scene["objects"]:
        raise Invalid(f"add_object: {key} is missing or there already")
    obj["object_id"] = key
    scene["objects"][key] = obj
    if op.get("world_transform"):
        _place(scene, key, matrix(own_transform(op["world_transform"])))


@step("remove_object")
def _remove_object(scene: dict, op: dict, events: list) -> None:
    _object(scene, op)
    _drop(scene, op["object_id"])


@step("add_element")
def _add_element(scene: dict, op: dict, events: list) -> None:
    _object(scene, op).setdefault("elements", []).append(own_element(copy.deepcopy(op["element"])))


@step("remove_element")
def _remove_element(scene: dict, op: dict, events: list) -> None:
    held = _object(scene, op).get("elements") or []
    if not 0 <= op.get("index", -1) < len(held):
        raise Invalid("remove_element: no such element")
    held.pop(op["index"])


@step("move")
def _move(scene: dict, op: dict, events: list) -> None:
    t = _transform(_object(scene, op))
    t["translation"] = (np.asarray(t.get("translation") or [0, 0, 0], float) + _vector(op, "delta")).tolist()


@step("rotate")
def _rotate(scene: dict, op: dict, events: list) -> None:
    t = _transform(_object(scene, op))
    t["rotation"] = _times(_vector(op, "rotation", 4).tolist(), t.get("rotation") or [0, 0, 0, 1])


@step("scale")
def _scale(scene: dict, op: dict, events: list) -> None:
    t = _transform(_object(scene, op))
    t["scale"] = (np.asarray(t.get("scale") or [1, 1, 1], float) * _vector(op, "factor")).tolist()


@step("set_transform")
def _set_transform(scene: dict, op: dict, events: list) -> None:
    _object(scene, op)
    _place(scene, op["object_id"], matrix(own_transform(op.get("transform"))))


@step("reach_arm_rotate")
def _reach(scene: dict, op: dict, events: list) -> None:
    """Turn the arm's local -Z toward the target, where it stands."""
    _object(scene, op)
    at = worlds(scene["objects"])
    here = at[op["object_id"]]
    there = at[op["target_id"]][:3, 3] if op.get("target_id") in at else _vector(op, "target")
    way = there - here[:3, 3]
    if np.linalg.norm(way) < 1e-9:
        return
    way = way / np.linalg.norm(way)
    start = np.array([0.0, 0.0, -1.0])
    axis, cos = np.cross(start, way), float(start @ way)
    q = np.array([1.0, 0.0, 0.0, 0.0]) if cos < -1 + 1e-9 else np.append(axis, 1 + cos)
    scale = np.linalg.norm(here[:3, :3], axis=0)
    world = here.copy()
    world[:3, :3] = rotation(q) * scale
    _place(scene, op["object_id"], world)


@step("attach")
def _attach(scene: dict, op: dict, events: list) -> None:
    """A new parent; the place in the world stays, or snaps to the parent."""
    child, key, parent = _object(scene, op), op["object_id"], op.get("parent_id")
    _object(scene, op, "parent_id")
    p = parent
    while p is not None:
        if p == key:
            raise Invalid("attach: an object can't be its own ancestor")
        p = scene["objects"].get(p, {}).get("parent_object_id")
    world = worlds(scene["objects"])[parent if op.get("snap") else key]
    child["parent_object_id"] = parent
    _place(scene, key, world)


@step("detach")
def _detach(scene: dict, op: dict, events: list) -> None:
    child = _object(scene, op)
    world = worlds(scene["objects"])[op["object_id"]]
    child["parent_object_id"] = None
    _place(scene, op["object_id"], world)


def _halves(obj: dict, names: list[str], world: np.ndarray, point: np.ndarray, normal: np.ndarray) -> list[dict]:
    """obj on either side of a plane of the world: each element is cut where the plane meets its own frame."""
    out = []
    for k, (name, side) in enumerate(zip(names, (1, -1), strict=True)):
        half = copy.deepcopy(obj) | {"object_id": name}
        for e in half.get("elements") or []:
            p, n = within(world @ matrix(e.get("transform")), point, side * normal)
            e.setdefault("clips", []).append({"normal": n, "point": p})
        if isinstance(half.get("mass"), int | float):
            half["mass"] = half["mass"] / 2
        half["metadata"] = (half.get("metadata") or {}) | {"split_from": obj["object_id"], "split_index": k}
        out.append(half)
    return out


@step("split")
def _split(scene: dict, op: dict, events: list) -> None:
    """Two halves at a plane of the world, half the mass each. Children go where they are assigned, else to the first; so do contacts."""
    obj, key = _object(scene, op), op["object_id"]
    names = op.get("new_ids") or [f"{key}_a", f"{key}_b"]
    if len(names) != 2 or any(n in scene["objects"] for n in names):
        raise Invalid("split: needs two new ids")
    normal = _vector(op, "normal")
    if not np.linalg.norm(normal) > 0:
        raise Invalid("split: the normal has no direction")
    world = worlds(scene["objects"])[key]
    for half in _halves(obj | {"object_id": key}, names, world, np.asarray(op.get("point") or [0, 0, 0], float), normal):
        scene["objects"][half["object_id"]] = half
    assigned = op.get("children_assignment") or {}
    for k, o in scene["objects"].items():
        if o.get("parent_object_id") == key:
            o["parent_object_id"] = assigned[k] if assigned.get(k) in names else names[0]
    scene["contacts"] = [c | {end: names[0] for end in ("a", "b") if c.get(end) == key} for c in scene.get("contacts") or []]
    _drop(scene, key)


@step("chain_split")
def _chain_split(scene: dict, op: dict, events: list) -> None:
    """2^n slabs along an axis of the world, by splitting again and again."""
    count = int(op.get("count", 2))
    if count < 2 or count & (count - 1):
        raise Invalid("chain_split: count must be a power of two")
    lo, hi = (float(x) for x in op["range"])
    axis = _vector(op, "axis")

    def cut(key: str, a: float, b: float, n: int) -> None:
        if n == 1:
            return
        mid = (a + b) / 2
        names = [f"{key}_a", f"{key}_b"]
        _split(scene, {"op": "split", "object_id": key, "new_ids": names, "normal": axis.tolist(), "point": (axis * mid).tolist()}, events)
        cut(names[0], a, mid, n // 2)
        cut(names[1], mid, b, n // 2)

    _object(scene, op)
    cut(op["object_id"], lo, hi, count)


@step("merge")
def _merge(scene: dict, op: dict, events: list) -> None:
    """One object of all elements, with the masses summed; children follow."""
    keys = op.get("object_ids") or []
    held = [_object(scene, {"op": "merge", "object_id": k}) for k in keys]
    if len(held) < 2:
        raise Invalid("merge: needs two objects")
    at = worlds(scene["objects"])
    name = op.get("new_id") or keys[0]
    elements = []
    for k, o in zip(keys, held, strict=True):
        for e in o.get("elements") or []:
            inside = parts(np.linalg.inv(at[keys[0]]) @ at[k] @ matrix(e.get("transform")))[0]
            elements.append(copy.deepcopy(e) | {"transform": inside})
    whole = copy.deepcopy(held[0]) | {"object_id": name, "elements": elements}
    masses = [o["mass"] for o in held if isinstance(o.get("mass"), int | float)]
    if masses:
        whole["mass"] = sum(masses)
    orphans = [k for k, o in scene["objects"].items() if o.get("parent_object_id") in keys and k not in keys]
    for k in keys:
        _drop(scene, k)
    scene["objects"][name] = whole
    for k in orphans:
        scene["objects"][k]["parent_object_id"] = name


@step("change_properties")
def _change_properties(scene: dict, op: dict, events: list) -> None:
    obj = _object(scene, op)
    given = op.get("properties") or {}
    obj["material"] = dict(given) if op.get("replace") else (obj.get("material") or {}) | given


@step("contact")
def _contact(scene: dict, op: dict, events: list) -> None:
    pair = {"a": op.get("a"), "b": op.get("b")}
    for end in pair.values():
        _object(scene, {"op": "contact", "object_id": end})
    rest = [c for c in scene.get("contacts") or [] if (c.get("a"), c.get("b")) != (pair["a"], pair["b"])]
    scene["contacts"] = [*rest, pair | {k: v for k, v in op.items() if k not in ("op", "a", "b")}]


@step("release")
def _release(scene: dict, op: dict, events: list) -> None:
    scene["contacts"] = [c for c in scene.get("contacts") or [] if (c.get("a"), c.get("b")) != (op.get("a"), op.get("b"))]


@step("label")
def _label(scene: dict, op: dict, events: list) -> None:
    _object(scene, op).setdefault("labels", {})[op["label"]] = op.get("value", True)


@step("unlabel")
def _unlabel(scene: dict, op: dict, events: list) -> None:
    (_object(scene, op).get("labels") or {}).pop(op["label"], None)


@step("wait")
def _wait(scene: dict, op: dict, events: list) -> None:
    events.append({"event": "wait", "duration": op.get("duration", 0.0)})


@step("emit_event")
def _emit(scene: dict, op: dict, events: list) -> None:
    events.append({"event": op.get("event"), "data": op.get("data")})


@step("compound")
def _compound(scene: dict, op: dict, events: list) -> None:
    for inner in op.get("operations") or []:
        _apply(scene, inner, events)


def _apply(scene: dict, op: dict, events: list) -> None:
    name = op.get("op")
    if name not in STEPS:
        raise Invalid(f"unknown operation {name}")
    STEPS[name](scene, renamed(op, FIELDS.get(name, {})), events)


def apply(scene: dict, op: dict) -> tuple[dict, list[dict]]:
    """A new scene and the events of one operation; an invalid one leaves the scene and is an event itself."""
    new, events = pickle.loads(pickle.dumps(scene)), []  # a deep copy of plain values, at a fraction of the time
    try:
        _apply(new, op, events)
    except (Invalid, KeyError, TypeError, np.linalg.LinAlgError) as e:
        return scene, [{"event": "invalid", "op": op.get("op"), "why": str(e)}]
    return new, [*events, {"event": "applied", "op": op.get("op")}]


FRAMES = "scene_id string, frame int, n_objects int, events string, scene string"


def replay(scenes: DataFrame, operations: DataFrame, frames: bool = False) -> DataFrame:
    """FRAMES: the scene after each operation, or after the last one only. operations: scene_id, op_ix, op (JSON)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for scene_id, text in zip(left["scene_id"], left["scene"], strict=True):
            scene, all_events = unwrapped(text), []
            for op in right.sort_values("op_ix")["op"]:
                scene, events = apply(scene, json.loads(op))
                all_events += events
                if frames:
                    rows.append((scene_id, len(rows), len(scene["objects"]), json.dumps(events), json.dumps(scene, sort_keys=True)))
            if not frames:
                rows.append((scene_id, len(right), len(scene["objects"]), json.dumps(all_events), json.dumps(scene, sort_keys=True)))
        return pd.DataFrame(rows, columns=["scene_id", "frame", "n_objects", "events", "scene"])

    left = scenes.select(F.col("scene_id").cast("string").alias("scene_id"), "scene").groupBy("scene_id")
    return left.cogroup(operations.select(F.col("scene_id").cast("string").alias("scene_id"), "op_ix", "op").groupBy("scene_id")).applyInPandas(run, FRAMES)
