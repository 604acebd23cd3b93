"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a domain - language - source tree. At every node the children share it by weight; a
child that can't use its share (its tokens times MAX_EPOCHS) gets what it can use, and the shortage goes to its
siblings by weight. Since a node never gets more than its whole subtree can use, a shortage reaches other
branches only when all siblings are full. A leaf's budget becomes whole seeded epochs and a prefix of one more:
its documents in the order of a seeded hash, up to the token where the budget ends.

The tree is a parameter; sources, languages and domains outside it are pooled under "*", so the number of leaves
is bounded by the tree and the leaf table is small by construction. Prefixes need no sorted leaf: tokens are
summed in 4096 hash ranges per leaf, only the range where the budget ends is ordered, and the selection itself
is a filter of each row against its leaf's end.

Defined cases: null texts have no tokens and are never selected by a prefix (a token-less row goes with whole epochs);
very long texts are whole documents, of which the last of a prefix may be taken in part; null sources and languages go to
"*"; rows equal in id and text stand at the same place and are taken one by one, in the order of a hash of their other
columns, up to the token where the budget ends; shares that tie for a remainder are served by name; an empty table gives
an empty result; further input columns, whatever their names, are kept by `select_rows` and ignored by `mix`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.columns import row_hash, shielded
from quillon.session import cut

OTHER = "*"
_RANGE_BITS = 12


@dataclass(frozen=True)
class Plan:
    """What a mix is asked for. Weights need not sum to 1; a name outside a mapping is pooled under OTHER."""

    domains: Mapping[str, float]
    languages: Mapping[str, float]
    sources: Mapping[str, float]
    domain_of: Mapping[str, str]  # of each source
    share: float = 0.6  # of all tokens, as the budget, unless tokens is given
    tokens: int | None = None
    max_epochs: int = 4
    seed: int = 17


def _sources(n: int = 20) -> list[str]:
    return [f"src{k}" for k in range(n)]


PRODUCTION = Plan(
    domains={"web": 0.45, "books": 0.25, "reference": 0.2, "forums": 0.1},
    languages={"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1},
    sources={s: (3.0, 2.0, 2.0, 1.0, 1.0)[k // 4] for k, s in enumerate(_sources())},  # within a domain, the earlier ones weigh more
    domain_of={s: ("web", "books", "reference", "forums")[k % 4] for k, s in enumerate(_sources())},
)


def split_budget(budget: int, children: list[tuple[str, float, int]]) -> dict[str, int]:
    """budget among (name, weight, capacity), by weight, no child over its capacity, shortages to its siblings."""
    got, left, open_ = {name: 0 for name, *_ in children}, min(budget, sum(c for _, w, c in children if w > 0)), [x for x in sorted(children) if x[1] > 0 and x[2] > 0]
    while open_ and left > 0:
        total = sum(Fraction(w) for _, w, _ in open_)
        full = [x for x in open_ if x[2] <= left * Fraction(x[1]) / total]
        if not full:
            exact = {name: left * Fraction(w) / total for name, w, _ in open_}
            got |= {name: int(v) for name, v in exact.items()}
            rest = left - sum(got[name] for name in exact)
            for name in sorted(exact, key=lambda n: (int(exact[n]) - exact[n], n))[:rest]:  # greatest remainders first
                got[name] += 1
            break
        for name, _, capacity in full:
            got[name] = capacity
            left -= capacity
        open_ = [x for x in open_ if x not in full]
    return got


@dataclass
class _Node:
    weight: float
    capacity: int = 0
    children: dict[str, _Node] = field(default_factory=dict)


def budgets(available: Mapping[tuple[str, str, str], int], plan: Plan) -> dict[tuple[str, str, str], int]:
    """Tokens for each (domain, language, source) leaf with so many tokens available."""
    root = _Node(1.0)
    least = lambda weights: min((w for w in weights.values() if w > 0), default=1.0)  # noqa: E731  of names outside the tree
    for path, tokens in sorted(available.items()):
        node = root
        node.capacity += tokens * plan.max_epochs
        for name, weights in zip(path, (plan.domains, plan.languages, plan.sources), strict=True):
            node = node.children.setdefault(name, _Node(weights.get(name, least(weights))))
            node.capacity += tokens * plan.max_epochs
    out: dict[tuple[str, str, str], int] = {}

    def go(node: _Node, budget: int, path: tuple[str, ...]) -> None:
        if not node.children:
            out[path] = budget
            return
        for name, share in split_budget(budget, [(n, c.weight, c.capacity) for n, c in node.children.items()]).items():
            go(node.children[name], share, (*path, name))

    whole = sum(available.values())
    go(root, min(root.capacity, int(Fraction(plan.share) * whole) if plan.tokens is None else plan.tokens), ())
    return out


def token_count(text_col: str = "text") -> Column:
    """Tokens of a text as this operator budgets them: one for every four bytes or part of them."""
    return F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4).cast("long")


def _placed(docs: DataFrame, plan: Plan, id_col: str, text_col: str, lang_col: str, source_col: str, tokens: Column | None) -> dict[str, Column]:
    """Columns that place a row: its leaf, its tokens and the hash of its text."""
    known = lambda col, names: F.when(F.col(col).isin(*names), F.col(col)).otherwise(F.lit(OTHER))
    source = known(source_col, plan.sources)
    domain_of = F.create_map(*(F.lit(x) for pair in plan.domain_of.items() for x in pair))
    domain = F.coalesce(F.try_element_at(domain_of, F.coalesce(source_col, F.lit(OTHER))), F.lit(OTHER))
    leaf = F.concat_ws("/", domain, known(lang_col, plan.languages), source)
    return {"_leaf": leaf, "_tokens": token_count(text_col) if tokens is None else tokens, "_text": F.xxhash64(F.coalesce(text_col, F.lit("")))}


def _order(id_col: str, seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col(id_col), F.col("_text"))


_ENDS = T.StructType([T.StructField("_leaf", T.StringType()), T.StructField("_full", T.IntegerType()), T.StructField("_end", T.LongType()), T.StructField("_end_text", T.LongType()), T.StructField("_end_tokens", T.LongType()), T.StructField("_present", T.LongType()), T.StructField("_copies", T.LongType()), T.StructField("_last", T.LongType())])


def leaf_ends(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """A row for each leaf of the tree: its whole epochs, and where the prefix of the next one ends.

    _end, _end_text and _end_tokens are the place of the last row in the prefix (null without one), _present the rows
    at this place, _copies how many of them are in the prefix, _last the tokens of the last of these in it.
    """
    slim = cut(docs.select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in _placed(docs, plan, id_col, text_col, lang_col, source_col, tokens).items())))
    spark = docs.sparkSession
    available = {tuple(r._leaf.split("/")): r.n for r in slim.groupBy("_leaf").agg(F.sum("_tokens").alias("n")).collect()}  # as many rows as the tree has leaves at most
    share = budgets(available, plan)
    wholes = {"/".join(p): (divmod(share[p], n) if n else (0, 0)) for p, n in available.items()}
    leaves = spark.createDataFrame([(k, int(full), int(rest)) for k, (full, rest) in wholes.items()], "_leaf string, _full int, _rest long")
    ranged = slim.join(F.broadcast(leaves), "_leaf").where("_rest > 0 and _tokens > 0").withColumn("_h", _order("_id", plan.seed, F.col("_full"))).withColumn("_r", F.shiftright("_h", 64 - _RANGE_BITS))
    sums = ranged.groupBy("_leaf", "_r").agg(F.sum("_tokens").alias("n"), F.first("_rest").alias("_rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_leaf").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows a leaf at most
    at = [r for r in sums.withColumn("before", before).where("before < _rest and before + n >= _rest").select("_leaf", "_r", "before").collect()]  # a row a leaf
    border = spark.createDataFrame([(r._leaf, int(r._r), int(r.before)) for r in at], "_leaf string, _r long, before long")
    one = ranged.join(F.broadcast(border), ["_leaf", "_r"]).groupBy("_leaf", "_h", "_text", "_tokens", "before", "_rest").agg(F.count("*").alias("m"))  # copies are one row
    w = Window.partitionBy("_leaf").orderBy("_h", "_text", "_tokens")
    running = one.withColumn("after", F.col("before") + F.sum(F.col("_tokens") * F.col("m")).over(w))
    ends = running.where("after >= _rest").groupBy("_leaf").agg(F.min(F.struct("_h", "_text", "_tokens", "after", "m", "_rest")).alias("e")).collect()
    found = {}
    for leaf, e in ends:
        left = e._rest - (e.after - e._tokens * e.m)  # for the copies at this place
        copies = -(-left // e._tokens)
        found[leaf] = (e._h, e._text, e._tokens, e.m, copies, left - (copies - 1) * e._tokens)
    return spark.createDataFrame([(k, int(full), *found.get(k, (None,) * 6)) for k, (full, _) in wholes.items()], _ENDS)


MIXED = ("leaf", "tokens", "epoch", "taken")


def _selected(docs: DataFrame, plan: Plan, id_col: str, text_col: str, lang_col: str, source_col: str, tokens: Column | None) -> tuple[DataFrame, list[str]]:
    """A row for each epoch that a row of docs is in: its columns under other names (the list), then MIXED."""
    inner, name = shielded(docs)
    if tokens is not None:
        inner = docs.select("*", tokens).toDF(*inner.columns, "given")
    args = (*(name[c] for c in (id_col, text_col, lang_col, source_col)), None if tokens is None else F.col("given"))
    ends = leaf_ends(inner, plan, *args)
    placed = inner.withColumns(_placed(inner, plan, *args)).join(F.broadcast(ends), "_leaf")
    h = _order(args[0], plan.seed, F.col("_full"))
    at_text = (h == F.col("_end")) & (F.col("_text") == F.col("_end_text"))
    within = (F.col("_tokens") > 0) & ((h < F.col("_end")) | ((h == F.col("_end")) & (F.col("_text") < F.col("_end_text"))) | (at_text & (F.col("_tokens") <= F.col("_end_tokens"))))
    times = F.col("_full") + F.when(within, 1).otherwise(0)
    rows = placed.withColumn("_h", h).withColumn("_times", times).where("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    place = (F.col("_epoch") == F.col("_full")) & (F.col("_h") == F.col("_end")) & (F.col("_text") == F.col("_end_text")) & (F.col("_tokens") == F.col("_end_tokens"))
    at_end = F.coalesce(place, F.lit(False))
    own = list(name.values())
    out = [*own, "_leaf", "_tokens", "_epoch"]
    named = lambda df: df.select(*own, *(F.col(f"_{c}").alias(c) for c in MIXED))
    taken = rows.withColumn("_taken", F.when(at_end, F.col("_last")).otherwise(F.col("_tokens")))
    if ends.where("_present > 1").isEmpty():
        return named(taken), own
    tied = at_end & (F.col("_present") > 1)
    # rows equal in all columns are counted before the shuffle; those left of a place differ beyond id and text
    maps = [c for c in own if "map<" in rows.schema[c].dataType.simpleString()]  # have no order to group by
    keys = [c for c in out if c not in maps] + [f"_map{k}" for k in range(len(maps))]
    tied_rows = rows.where(tied).withColumns({f"_map{k}": F.to_json(F.struct(c)) for k, c in enumerate(maps)})
    counted = tied_rows.groupBy(*keys, "_copies", "_last").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in maps))
    whole = row_hash(counted.select(*own))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_leaf").orderBy(whole).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counted.withColumn("_before", before).where("_before < _copies").withColumn("_k", F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("_n"), "_copies"))))
    copies = each.withColumn("_taken", F.when(F.col("_k") == F.col("_copies"), F.col("_last")).otherwise(F.col("_tokens")))
    return named(taken.where(~tied)).unionByName(named(copies)), own


def select_rows(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """The rows of docs in the mix, with the columns of docs: as many times as there are epochs that they are in."""
    rows, own = _selected(docs, plan, id_col, text_col, lang_col, source_col, tokens)
    return rows.select(*own).toDF(*docs.columns)


def mix(docs: DataFrame, plan: Plan = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, domain, language, source, epoch, tokens, taken): every selected row of every epoch."""
    slim = docs.select(*dict.fromkeys((id_col, text_col, lang_col, source_col)))
    rows, own = _selected(slim, plan, id_col, text_col, lang_col, source_col, None)
    parts = F.split("leaf", "/")
    return rows.select(F.col(own[0]).alias("doc_id"), parts[0].alias("domain"), parts[1].alias("language"), parts[2].alias("source"), "epoch", "tokens", "taken")
