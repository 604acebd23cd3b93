"""Nested documents to rows: JSON leaves, condition paths, action trees."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import hierarchy

LEAVES = "array<struct<path:array<string>,value:string,kind:string>>"


def _text(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


def _kind(value: object) -> str:
    return "null" if value is None else "bool" if isinstance(value, bool) else "num" if isinstance(value, int | float) else "str"


def leaves(node: object, indexed: bool = False, measures: bool = True) -> list[tuple[list[str], str | None, str]]:
    """(path, value, kind) of every leaf. A {value, unit} pair is one leaf; list items share their list's path unless indexed."""
    out: list[tuple[list[str], str | None, str]] = []
    stack: list[tuple[list[str], object]] = [([], node)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict):
            if measures and path and "value" in x and set(x) <= {"value", "unit"}:
                out.append((path, f"{_text(x['value'])}{x.get('unit') or ''}", "str"))
            else:
                stack.extend((path + [str(k)], v) for k, v in reversed(x.items()))
        elif isinstance(x, list):
            stack.extend((path + [str(i)] if indexed else path, v) for i, v in reversed(list(enumerate(x))))
        elif path:
            out.append((path, _text(x), _kind(x)))
    return out


def flatten_json(indexed: bool = False, measures: bool = True):
    """A function of a JSON column that gives LEAVES; text that is no JSON has none."""

    @F.pandas_udf(LEAVES)
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            try:
                return [{"path": p, "value": v, "kind": k} for p, v, k in leaves(json.loads(text), indexed, measures)] if text else []
            except ValueError:
                return []

        return texts.map(one)

    return run


def _keys(node: object, out: list[str]) -> None:
    if isinstance(node, str):
        out.append(node)
    elif isinstance(node, dict):
        for k, v in node.items():
            out.append(str(k))
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict):
                    _keys(x, out)
    elif isinstance(node, list):
        for x in node:
            if isinstance(x, str | dict):
                _keys(x, out)


def condition_path(split_dots: bool = True):
    """A function of the JSON of an aspect and an attribute (each a string, a list or a dict) that gives the path."""

    @F.pandas_udf("array<string>")
    def run(aspects: pd.Series, attributes: pd.Series) -> pd.Series:
        def one(*parts: str | None) -> list[str]:
            out: list[str] = []
            for text in parts:
                if text:
                    try:
                        _keys(json.loads(text), out)
                    except ValueError:
                        out.append(text)
            return [c for p in out for c in (p.split(".") if split_dots else [p]) if c]

        known = {pair: one(*pair) for pair in set(zip(aspects, attributes, strict=True))}  # conditions say the same few
        return pd.Series([known[pair] for pair in zip(aspects, attributes, strict=True)])

    return run


def path_variants(path: Column) -> Column:
    """array<array<string>>: a path with each dotted component kept whole or split, in all combinations (2^k for k dotted ones)."""
    start = F.array(F.array().cast("array<string>"))

    def grow(acc: Column, part: Column) -> Column:
        whole = F.transform(acc, lambda p: F.array_append(p, part))
        parted = F.transform(acc, lambda p: F.concat(p, F.split(part, r"\.")))
        return F.when(part.contains("."), F.concat(whole, parted)).otherwise(whole)

    return F.aggregate(path, start, grow)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, depth) of (id, parent) rows, from the roots down; path joins the ids of the way by dots. Nodes on or under a cycle have neither."""
    path = {"path": (F.col("id").cast("string"), lambda upper, lower: F.concat_ws(".", upper, lower))}
    found = hierarchy.rooted(nodes.select("id", "parent"), [], "id", "parent", path)
    return found.select("id", "path", F.col("depth").cast("int").alias("depth"))


def walk(node: dict, child: str, path: str, depth: int = 0, parent: str | None = None) -> Iterator[tuple[str, str | None, int, int, dict]]:
    """(path, parent path, depth, index, node) of a nested dict and all below it, depth first."""
    stack: list[tuple[dict, str, int, str | None, int]] = [(node, path, depth, parent, int(path.rsplit(".", 1)[-1]) if path.rsplit(".", 1)[-1].isdigit() else 0)]
    while stack:
        x, at, deep, above, ix = stack.pop()
        yield at, above, deep, ix, x
        below = [c for c in x.get(child) or [] if isinstance(c, dict)]
        stack.extend((c, f"{at}.{child}.{i}", deep + 1, at, i) for i, c in reversed(list(enumerate(below))))


#: Rows of a batch that Python hands over, however many its input's memories make.
ROWS = 2000
ACTION = "memory_id string, instance_id string, parent_id string, depth int, child_ix int, seq long, template string, body string"


def action_trees(memories: DataFrame) -> DataFrame:
    """ACTION rows of (memory_id, actions JSON) memories: every action and sub-action, depth first; body is the action's JSON without its sub-actions."""

    kinds = {"depth": pa.int32(), "child_ix": pa.int32(), "seq": pa.int64()}
    fields = [(part.split()[0], kinds.get(part.split()[0], pa.string())) for part in ACTION.split(", ")]

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for memory, text in zip(batch.column(0), batch.column(1), strict=True):
                memory, text = memory.as_py(), text.as_py()
                try:
                    roots = json.loads(text) if text else []
                except ValueError:
                    roots = []
                seq = 0
                for i, root in enumerate(x for x in roots or [] if isinstance(x, dict)):
                    for at, above, depth, ix, x in walk(root, "sub_actions", f"{memory}.memory.actions.{i}"):
                        rows.append((memory, at, above, depth, ix, seq, _text(x.get("template")), json.dumps({k: v for k, v in x.items() if k != "sub_actions"})))
                        seq += 1
                        if len(rows) == ROWS:
                            yield handed(rows)
                            rows = []
            yield handed(rows)

    return memories.select(F.col("memory_id").cast("string"), "actions").mapInArrow(run, ACTION)


def merged(defaults: Column, overrides: Column) -> Column:
    """Two maps as one: overrides win on their top-level keys."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(overrides), k)), overrides)
