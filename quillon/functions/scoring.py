"""Scores of one query item against one index item, as column expressions.

Aliases come as a map<string, array<string>> column (a name to its aliases), similarities as a
map<string, double> column keyed by `pair(a, b)` that holds the pairs at or above the threshold only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import vocabulary as V
from quillon.functions.text import let
from quillon.functions.units import normal_value


def no_aliases() -> Column:
    return F.create_map().cast("map<string,array<string>>")


def no_similarities() -> Column:
    return F.create_map().cast("map<string,double>")


def pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("\u0001"), b)


def are_aliases(a: Column, b: Column, aliases: Column) -> Column:
    one = lambda x, y: F.coalesce(F.array_contains(F.try_element_at(aliases, x), y), F.lit(False))
    return one(a, b) | one(b, a)


def similarity(a: Column, b: Column, similar: Column) -> Column:
    return F.coalesce(F.try_element_at(similar, pair(a, b)), F.lit(0.0))


def contiguous(small: Column, large: Column) -> Column:
    """Whether small is a run of large."""
    n, m = F.size(small), F.size(large)
    return F.when((n > 0) & (n <= m), F.exists(F.sequence(F.lit(1), m - n + 1), lambda i: F.slice(large, i, n) == small)).otherwise(False)


def path_match(query: Column, entry: Column, aliases: Column | None = None, similar: Column | None = None) -> Column:
    """struct<score, alias> of a query path against an entry's path."""
    aliases, similar = no_aliases() if aliases is None else aliases, no_similarities() if similar is None else similar

    def best(q: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            linked = are_aliases(q, e, aliases)
            score = F.when((q == e) | linked, F.lit(1.0)).otherwise(similarity(q, e, similar))
            return F.struct(score.alias("score"), (-i).alias("back"), ((q != e) & linked).alias("alias"))

        return F.array_max(F.transform(entry, one))

    def graded(found: Column) -> Column:
        n, n_q, n_e = F.size(found), F.size(query), F.size(entry)
        alias = F.exists(found, lambda m: m["alias"])
        fuzzy = F.exists(found, lambda m: ~m["alias"] & (m["score"] < 1.0))
        places = F.transform(found, lambda m: -m["back"])
        together = F.array_max(places) - F.array_min(places) == n_q - 1
        part = n / n_e * F.when(fuzzy, 0.8).otherwise(1.0)
        whole = F.when(together, F.when(fuzzy, 0.9).otherwise(1.0)).otherwise(F.when(fuzzy, 0.8).otherwise(0.9))
        score = F.when(n < n_q, part).otherwise(whole) * F.when(alias, V.ALIAS_PENALTY).otherwise(1.0)
        return F.struct(F.when(n == 0, 0.0).otherwise(score).alias("score"), (alias & (n > 0)).alias("alias"))

    plain = lambda s: F.struct(F.lit(s).alias("score"), F.lit(False).alias("alias"))
    empty = (F.size(query) == 0) | (F.size(entry) == 0)
    loose = let(F.filter(F.transform(query, best), lambda m: m["score"] > 0), graded)
    return F.when(empty, plain(0.0)).when(contiguous(query, entry), plain(1.0)).when(F.forall(query, lambda p: F.array_contains(entry, p)), plain(0.9)).otherwise(loose)


def value_match(query: Column, entry: Column, aliases: Column | None = None, similar: Column | None = None, query_items: Column | None = None, entry_items: Column | None = None) -> Column:
    """Score of a query value against an entry's value; items are given for values that are lists."""
    aliases, similar = no_aliases() if aliases is None else aliases, no_similarities() if similar is None else similar
    of = lambda x: F.coalesce(F.try_element_at(aliases, x), F.array().cast("array<string>"))
    through = F.exists(of(query), lambda a: similarity(a, entry, similar) > 0) | F.exists(of(entry), lambda a: similarity(query, a, similar) > 0)

    def scalar(v: Column) -> Column:
        q, e = v["q"], v["e"]
        near = (q["kind"] == "num") & (e["kind"] == "num") & (e["num"] != 0) & (F.abs(q["num"] - e["num"]) <= V.NUMBER_TOLERANCE * F.abs(e["num"]))
        score = (
            F.when(q == e, 1.0)
            .when(near, V.NUMBER_NEAR_SCORE)
            .when(are_aliases(query, entry, aliases), V.ALIAS_PENALTY)
            .when(similarity(query, entry, similar) > 0, 0.9)
            .when(through, 0.9 * V.ALIAS_PENALTY)
            .otherwise(0.0)
        )
        return F.coalesce(score, F.lit(0.0))

    score = let(F.struct(normal_value(query).alias("q"), normal_value(entry).alias("e")), scalar)
    if entry_items is None:
        return score
    in_list = (
        F.when(let(normal_value(query), lambda q: F.exists(entry_items, lambda x: normal_value(x) == q)), 0.7)
        .when(F.exists(entry_items, lambda x: are_aliases(query, x, aliases)), 0.6 * V.ALIAS_PENALTY)
        .when(F.exists(entry_items, lambda x: similarity(query, x, similar) > 0), 0.6)
        .otherwise(0.0)
    )
    if query_items is None:
        return F.when(entry_items.isNotNull(), in_list).otherwise(score)
    common = F.size(F.filter(entry_items, lambda x: F.array_contains(query_items, x)))
    lists = F.when(common == F.size(entry_items), 1.0).when(common > 0, 0.7).otherwise(0.0)
    return F.when(query_items.isNotNull() & entry_items.isNotNull(), lists).when(entry_items.isNotNull(), in_list).otherwise(score)


def op_match(query: Column, entry: Column) -> Column:
    return F.when(query == entry, 1.0).when((query == "!=") | (entry == "!="), 0.5).otherwise(0.8)


def core_match(q_path: Column, q_op: Column, q_value: Column, e_path: Column, e_op: Column, e_value: Column, banned: Column, aliases: Column | None = None, similar: Column | None = None, value_aliases: Column | None = None, value_similar: Column | None = None, query_items: Column | None = None, entry_items: Column | None = None) -> Column:
    """struct<score, alias> of path, value and operator. A value that doesn't match leaves a fifth of the path's score, on components that say something."""
    value = value_match(q_value, e_value, value_aliases, value_similar, query_items, entry_items)
    kept = lambda p: F.filter(p, lambda c: ~F.array_contains(banned, c))
    path = path_match(q_path, e_path, aliases, similar)
    rest = path_match(kept(q_path), kept(e_path), aliases, similar)
    op = op_match(q_op, e_op)
    scaled = lambda m, factor: F.struct((m["score"] * factor * op).alias("score"), (m["alias"] & (m["score"] > 0)).alias("alias"))
    return let(value, lambda v: F.when(v > 0, let(path, lambda m: scaled(m, v))).otherwise(let(rest, lambda m: scaled(m, F.lit(V.VALUE_MISS)))))


def name_factor(query: Column, entry: Column, aliases: Column | None = None, similar: Column | None = None) -> Column:
    """Multiplier of an object's or action's name: 2.0 equal, 1.8 alias, 1.6 similar, 1.44 similar through an alias, 1.0 otherwise or if either is null."""
    aliases, similar = no_aliases() if aliases is None else aliases, no_similarities() if similar is None else similar
    of = lambda x: F.coalesce(F.try_element_at(aliases, x), F.array().cast("array<string>"))
    through = F.exists(of(entry), lambda a: similarity(query, a, similar) > 0) | F.exists(of(query), lambda a: similarity(a, entry, similar) > 0)
    score = (
        F.when(query == entry, V.NAME_EXACT)
        .when(are_aliases(query, entry, aliases), V.NAME_EXACT * V.ALIAS_PENALTY)
        .when(similarity(query, entry, similar) > 0, V.NAME_FUZZY)
        .when(through, V.NAME_FUZZY * V.ALIAS_PENALTY)
        .otherwise(1.0)
    )
    return F.when(query.isNull() | entry.isNull(), 1.0).otherwise(score)


def goal_factor(query_is_goal: Column, entry_is_goal: Column) -> Column:
    return F.when(query_is_goal & entry_is_goal, V.GOAL_FACTOR**2).when(query_is_goal | entry_is_goal, V.GOAL_FACTOR).otherwise(1.0)


def type_multiplier(table: dict[tuple[bool, bool], float], exact: Column, same: Column) -> Column:
    return F.when(exact & same, table[True, True]).when(exact, table[True, False]).when(same, table[False, True]).otherwise(table[False, False])


def position_score(q_to: Column, e_to: Column, q_restricted: Column, e_restricted: Column, q_relation: Column, e_relation: Column, to_similar: Column | None = None) -> Column:
    """Position units: nothing without the same or a similar reference object."""
    to = q_to == e_to
    if to_similar is not None:
        to = to | to_similar
    score = F.when(q_restricted == e_restricted, 1.0).otherwise(0.5) * F.when(q_relation == e_relation, 1.0).otherwise(0.8)
    return F.when(F.coalesce(to, F.lit(False)), score).otherwise(0.0)


def compare(actual: Column, op: Column, wanted: Column) -> Column:
    """Whether an actual value satisfies an operator and a wanted value; unknown operators compare for equality, += never holds."""
    a, w = normal_value(actual), normal_value(wanted)
    number = (a["kind"] == "num") & (w["kind"] == "num")
    ordered = lambda f: F.coalesce(F.when(number, f), F.lit(False))
    equal = F.coalesce(a == w, F.lit(False))
    listed = F.exists(F.split(F.regexp_replace(wanted, r"[\[\]\s'\"]", ""), ","), lambda x: F.coalesce(normal_value(x) == a, F.lit(False)))
    return (
        F.when(op.isin("ne", "!="), ~equal)
        .when(op.isin("gt", ">"), ordered(a["num"] > w["num"]))
        .when(op.isin("gte", ">="), ordered(a["num"] >= w["num"]))
        .when(op.isin("lt", "<"), ordered(a["num"] < w["num"]))
        .when(op.isin("lte", "<="), ordered(a["num"] <= w["num"]))
        .when(op == "in", listed)
        .when(op == "+=", False)
        .otherwise(equal)
    )


def category_chain_overlap(left: Column, right: Column) -> Column:
    """Overlap of two category chains, earlier (more specific) categories of left weighing 1, 1/2, 1/3, ..."""
    weigh = lambda keep: F.aggregate(F.transform(left, lambda c, i: F.when(keep(c), 1.0 / (i + 1)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    whole = weigh(lambda c: F.lit(True))
    return F.when(whole > 0, weigh(lambda c: F.array_contains(right, c)) / whole).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
