"""Own columns beside a caller's: whatever names the caller uses, none can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... and the new name of each old one. Own columns start with another letter."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {name: f"c{i}" for i, name in enumerate(df.columns)}


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of a row's columns; columns with maps in them, which have no hash, are hashed as their JSON."""

    def whole(field) -> Column:
        return F.to_json(F.struct(F.col(field.name))) if "map<" in field.dataType.simpleString() else F.col(field.name)

    return F.xxhash64(F.lit(seed), *(whole(f) for f in df.schema))
