"""Measurements: parsing, quantities, conversion to base units, values in normal form."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import let
from quillon.functions.vocabulary import UNITS

MEASUREMENT = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z^0-9%]*)\s*$"


def number_of(text: Column) -> Column:
    return F.regexp_extract(text, MEASUREMENT, 1).try_cast("double")


def unit_of(text: Column) -> Column:
    return F.when(text.rlike(MEASUREMENT), F.lower(F.regexp_extract(text, MEASUREMENT, 2)))


def _table(entries: dict, kind: str) -> Column:
    """A fixed map as one literal."""
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{kind}>")


def quantity_of(unit: Column) -> Column:
    """The quantity that a unit measures, 'unknown' for any other unit."""
    known = _table({u: quantity for quantity, table in reversed(UNITS.items()) for u in table}, "string")
    return F.coalesce(F.try_element_at(known, unit), F.lit("unknown"))


def celsius(value: Column, unit: Column) -> Column:
    return F.when(unit.isin("f", "fahrenheit"), (value - 32) * 5.0 / 9.0).when(unit.isin("k", "kelvin"), value - 273.15).otherwise(value)


def in_base_unit(value: Column, unit: Column, quantity: Column) -> Column:
    """value in the base unit of quantity; unchanged where the unit isn't one of it."""
    factors = _table({f"{name} {u}": f for name, table in UNITS.items() if name != "temperature" for u, f in table.items()}, "double")
    factor = F.try_element_at(factors, F.concat(quantity, F.lit(" "), unit))
    return F.when(quantity == "temperature", celsius(value, unit)).otherwise(value * F.coalesce(factor, F.lit(1.0)))


def volume_of(length: Column, width: Column, height: Column) -> Column:
    """cm^3 from three measurement strings; null unless all three can be read."""
    cm = [in_base_unit(number_of(x), unit_of(x), F.lit("length")) for x in (length, width, height)]
    return cm[0] * cm[1] * cm[2]


def normal_value(raw: Column) -> Column:
    """struct<kind, num, str>: 'bool', 'null', 'num' (in the base unit where the unit is known) or 'str'; quotes are stripped."""
    quoted = F.trim(raw)
    text = F.when(quoted.rlike("""^(['"]).*\\1$""") & (F.length(quoted) >= 2), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)

    def normal(t: Column) -> Column:
        low, unit = F.lower(t), unit_of(t)
        kind = F.when(t.isNull() | low.isin("null", "none"), "null").when(low.isin("true", "false"), "bool").when(t.rlike(MEASUREMENT), "num").otherwise("str")
        number = F.when(t.rlike(MEASUREMENT), in_base_unit(number_of(t), unit, quantity_of(unit)))
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "num", number).alias("num"), F.when(k == "bool", low).when(k == "str", t).alias("str")))

    return let(text, normal)


def rounded(x: Column, digits: int) -> Column:
    """F.round of doubles, to the last bit, without its detour over decimal digits where the value is plainly nearer to one side."""
    scaled = x * 10.0**digits
    whole = F.rint(scaled)
    plain = (F.abs(x) < 1e6) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, (whole + 0.0) / 10.0**digits).otherwise(F.round(x, digits))
