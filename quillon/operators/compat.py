"""Compatibility of objects: equal, alias, similar name, or enough shared attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import scoring
from quillon.functions.units import in_base_unit, number_of, unit_of
from quillon.functions.vocabulary import FUZZY_THRESHOLD, GENERIC_CATEGORIES

# Of the attribute tier.
CEILING, SIGNALS, LEAST_SIGNALS, INSTANCE_WEIGHT, INSTANCES_PER_SIGNAL = 0.9, 6, 2, 0.3, 2


def attribute_tier(signals: dict[str, Column], instance_matches: Column | None = None) -> tuple[Column, Column, Column]:
    """(number of signals, whether the gate passes, score). Two signals pass, or category or materials alone; two matching attributes count as one signal for the gate."""
    instance_matches = F.lit(0) if instance_matches is None else instance_matches
    held = {name: F.coalesce(c, F.lit(False)) for name, c in signals.items()}
    n = sum((c.cast("int") for c in held.values()), F.lit(0))
    passes = n + F.floor(instance_matches / INSTANCES_PER_SIGNAL) >= LEAST_SIGNALS
    for alone in ("category", "materials"):
        if alone in held:
            passes = passes | held[alone]
    return n, passes, F.least(F.lit(CEILING), (n + INSTANCE_WEIGHT * instance_matches) / SIGNALS * CEILING)


def common(a: Column, b: Column, without: tuple[str, ...] = ()) -> Column:
    drop = F.array(*(F.lit(x) for x in without)) if without else F.array().cast("array<string>")
    return F.coalesce(F.arrays_overlap(F.array_except(a, drop), F.array_except(b, drop)), F.lit(False))


def dimensions_match(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """At least two of length, width, height and volume of a within half and one and a half of b's. Values are measurement strings."""
    cm = lambda x: in_base_unit(number_of(x), unit_of(x), F.lit("length"))
    names = ("length", "width", "height_thickness")
    left, right = [cm(a[n]) for n in names], [cm(b[n]) for n in names]
    left.append(left[0] * left[1] * left[2])
    right.append(right[0] * right[1] * right[2])
    fits = [F.coalesce(x.between(0.5 * y, 1.5 * y), F.lit(False)).cast("int") for x, y in zip(left, right, strict=True)]
    return sum(fits, F.lit(0)) >= 2


def position_match(a_to: Column, b_to: Column, a_restricted: Column, b_restricted: Column, a_relation: Column, b_relation: Column, similar: Column | None = None) -> Column:
    """A common or similar reference object, and the same relation in either wording."""
    similar = scoring.no_similarities() if similar is None else similar
    to = F.exists(a_to, lambda x: F.exists(b_to, lambda y: (x == y) | (scoring.similarity(x, y, similar) >= FUZZY_THRESHOLD)))
    return F.coalesce(to & ((a_restricted == b_restricted) | (a_relation == b_relation)), F.lit(False))


#: Columns of an object: obj_id, template, categories, functions, materials (arrays), shape, length, width,
#: height_thickness (measurement strings), relation, relationr, relative_to (array), attributes (map).
def compatibility(pairs: DataFrame, aliases: Column | None = None, names: Column | None = None, values: Column | None = None) -> DataFrame:
    """pairs of q_ and c_ columns with tier and score; names and values hold similarities of names and of values."""
    aliases, names, values = scoring.no_aliases() if aliases is None else aliases, scoring.no_similarities() if names is None else names, scoring.no_similarities() if values is None else values
    q, c = (lambda x: F.col(f"q_{x}")), (lambda x: F.col(f"c_{x}"))
    alike = lambda x, y: (x == y) | (scoring.similarity(x, y, values) > 0)
    dims = ("length", "width", "height_thickness")
    signals = {
        "category": common(q("categories"), c("categories"), GENERIC_CATEGORIES),
        "materials": common(q("materials"), c("materials")),
        "shape": alike(q("shape"), c("shape")) & (q("shape") != ""),
        "dimensions": dimensions_match({d: q(d) for d in dims}, {d: c(d) for d in dims}),
        "position": position_match(q("relative_to"), c("relative_to"), q("relationr"), c("relationr"), q("relation"), c("relation"), values),
        "functions": F.exists(q("functions"), lambda x: F.exists(c("functions"), lambda y: alike(x, y))),
    }
    same = F.size(F.filter(F.map_keys(q("attributes")), lambda k: F.coalesce(scoring.value_match(F.try_element_at(q("attributes"), k), F.try_element_at(c("attributes"), k)) > 0, F.lit(False)) & F.array_contains(F.map_keys(c("attributes")), k)))
    n, passes, score = attribute_tier(signals, F.coalesce(same, F.lit(0)))
    own = lambda p: F.coalesce(F.when(p("obj_id") != "", p("obj_id")), p("template"))
    exact = (own(q) == own(c)) | (q("template") == c("template"))
    alias = scoring.are_aliases(q("template"), c("template"), aliases)
    fuzzy = scoring.similarity(q("template"), c("template"), names) > 0
    tier = F.when(exact, "exact").when(alias, "alias").when(fuzzy, "fuzzy_name").when(passes, "attribute").otherwise("rejected")
    out = pairs.withColumn("tier", tier).withColumn("n_signals", n)
    return out.withColumn("score", F.when(F.col("tier") == "exact", 1.0).when(F.col("tier").isin("alias", "fuzzy_name"), 0.9).when(F.col("tier") == "attribute", score).otherwise(0.0))


def substitutes(scored: DataFrame, query: str = "q_obj_id", candidate: str = "c_obj_id", n: int = 20, above: float = 0.0) -> DataFrame:
    """The n best candidates of each query object with a score above the threshold: ranked first, capped then."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), candidate))
    return scored.where(F.col("score") > above).withColumn("place", place).where(F.col("place") <= n)


def participant_score(scored: DataFrame, action: str, query: str = "q_obj_id") -> DataFrame:
    """(action, score): the best participant for each query object, summed."""
    return scored.groupBy(action, query).agg(F.max("score").alias("best")).groupBy(action).agg(F.sum("best").alias("score"))


def telling(categories: Column, generic: tuple[str, ...] = GENERIC_CATEGORIES) -> Column:
    """Categories without those that are too general to tell anything."""
    return F.filter(categories, lambda c: ~F.lower(c).isin(*generic))
