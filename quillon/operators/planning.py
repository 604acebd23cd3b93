"""Plan search over actions: candidates by relations, backward chaining and simulation by small folds.

Which action may serve which subgoal is found relationally (state.candidates). `seed_plans` reaches subgoals round by round for all
queries at once and reads plans back by joins; `search_plans` makes the depth-first choice for one query with its candidates
in one group, whose size the caps bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from itertools import groupby, islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.scoring import compare
from quillon.operators.state import coverage_group, plan_score
from quillon.session import removed, stored, stored_folder

# Limits of the search.
DEPTH, TARGET_VERBS, CONTEXT_VERBS, SEEDS, PLANS_PER_ACTION, COMBINATIONS = 60, 20, 10, 10, 3, 20
CATEGORY_BONUS = 0.3


def seeds(verb_hits: DataFrame, participants: DataFrame, n: int = TARGET_VERBS) -> DataFrame:
    """(query_id, action_id, score, place): an action's best verb score plus its participants' and its category's.

    verb_hits: query_id, action_id, verb_score, same_category; participants: query_id, action_id, object_score.
    """
    best = verb_hits.groupBy("query_id", "action_id").agg(F.max("verb_score").alias("v"), F.max(F.col("same_category").cast("int")).alias("c"))
    joined = best.join(participants.groupBy("query_id", "action_id").agg(F.sum("object_score").alias("o")), ["query_id", "action_id"], "left")
    scored = joined.select("query_id", "action_id", (F.col("v") + F.coalesce("o", F.lit(0.0)) + CATEGORY_BONUS * F.col("c")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "action_id"))
    return scored.withColumn("place", place).where(F.col("place") <= n)


def chain(goals: Sequence[str], edges: Mapping[str, Sequence[str]], needs: Mapping[str, Sequence[str]], effects: Mapping[str, Sequence[str]], holds: frozenset[str] | set[str], depth: int = DEPTH, sound: bool = True) -> tuple[list[str], bool]:
    """(actions in order, whether all goals are met) by backward chaining with backtracking.

    edges: a subgoal's actions, best first; needs: an action's subgoals; effects: what holds after it. The sound
    mode undoes what a failed branch had taken for solved, and adds all effects of a chosen action to the state;
    the other mode keeps visited subgoals as if solved and adds the subgoal alone.
    """
    visited: set[str] = set()

    def reach(wanted: Sequence[str], state: frozenset[str], way: frozenset[str], left: int) -> tuple[list[str], frozenset[str]] | None:
        plan: list[str] = []
        for g in wanted:
            if g in state:
                continue
            if sound:
                if g in way or left <= 0:
                    return None
            elif g in visited or left <= 0:
                if left <= 0:
                    return None
                continue
            visited.add(g)
            for a in edges.get(g, ()):
                below = reach(needs.get(a, ()), state, way | {g}, left - 1)
                if below is not None:
                    steps, state = below
                    plan += [*steps, a]
                    state = state | {g} | (frozenset(effects.get(a, ())) if sound else frozenset())
                    break
            else:
                return None
        return plan, state

    done = reach(list(goals), frozenset(holds), frozenset(), depth)
    if done is None:
        return [], False
    order = list(dict.fromkeys(done[0]))
    return order, True


PLAN = "query_id string, step int, action_id string, reached boolean"


def search_plans(goals: DataFrame, edges: DataFrame, needs: DataFrame, effects: DataFrame, holds: DataFrame, depth: int = DEPTH, sound: bool = True) -> DataFrame:
    """PLAN rows of each query. All inputs carry query_id: goals (subgoal_id, place), edges (subgoal_id, action_id, place), needs and effects (action_id, subgoal_id), holds (subgoal_id)."""
    tag = lambda df, kind, a, b, place: df.select(F.col("query_id").cast("string").alias("query_id"), F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), place.cast("long").alias("place"))
    rows = tag(goals, "goal", "subgoal_id", "subgoal_id", F.col("place"))
    rows = rows.unionByName(tag(edges, "edge", "subgoal_id", "action_id", F.col("place"))).unionByName(tag(needs, "need", "action_id", "subgoal_id", F.lit(0))).unionByName(tag(effects, "effect", "action_id", "subgoal_id", F.lit(0))).unionByName(tag(holds, "hold", "subgoal_id", "subgoal_id", F.lit(0)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "a", "b"])
        lists = lambda kind: {k: list(g) for k, g in pdf[pdf["kind"] == kind].groupby("a")["b"]}
        of = lambda kind: list(pdf[pdf["kind"] == kind]["a"])
        plan, reached = chain(of("goal"), lists("edge"), lists("need"), lists("effect"), set(of("hold")), depth, sound)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "step": range(max(1, len(plan))), "action_id": plan or [None], "reached": reached})

    return rows.groupBy("query_id").applyInPandas(solve, PLAN)


def combine(plans: Sequence[Sequence[Sequence[str]]], most: int = COMBINATIONS, each: int = PLANS_PER_ACTION) -> list[list[str]]:
    """Plans for several target actions together: the first combinations of the first plans of each, actions once."""
    return [list(dict.fromkeys(a for plan in combo for a in plan)) for combo in islice(product(*(p[:each] for p in plans)), most)]


def combined(plans: DataFrame, most: int = COMBINATIONS, each: int = PLANS_PER_ACTION) -> DataFrame:
    """(query_id, place, score, plan_ids): the best plans for all of a query's target actions together, by the sum of their scores.

    plans: query_id, target (a number, from the first action on), plan_id, score; each: the plans of a target that are looked at.
    Targets are taken one by one, and only the `most` best beginnings are carried on: a beginning that is behind so many
    others stays behind them whatever follows, so no product is formed. Ties by the ids of the plans in order.
    """
    first = Window.partitionBy("query_id", "target").orderBy(F.desc("score"), "plan_id")
    numbered = plans.select("query_id", "target", "plan_id", "score").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each)
    lists = stored(numbered.withColumn("_k", F.dense_rank().over(Window.partitionBy("query_id").orderBy("target"))).drop("_n"))
    last = lists.groupBy("query_id").agg(F.max("_k").alias("_last"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "plan_ids")
    now = lists.where("_k = 1").select("query_id", "score", F.array("plan_id").alias("plan_ids"))
    for k in range(2, (lists.agg(F.max("_k")).first()[0] or 0) + 1):  # as many rounds as a query has target actions
        more = lists.where(F.col("_k") == k).select("query_id", "plan_id", F.col("score").alias("_score"))
        longer = now.join(more, "query_id").select("query_id", (F.col("score") + F.col("_score")).alias("score"), F.array_append("plan_ids", F.col("plan_id")).alias("plan_ids"))
        kept = longer.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")
        done = now.join(last.where(F.col("_last") < k).select("query_id"), "query_id", "left_semi")
        now = stored(done.unionByName(kept))
    return now.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("query_id", "place", "score", "plan_ids")


def combined_steps(combinations: DataFrame, steps: DataFrame) -> DataFrame:
    """(query_id, place, step, action_id): the actions of combined plans, plan after plan, each action once, where it comes first. steps: plan_id, step, action_id."""
    plans = combinations.select("query_id", "place", F.posexplode("plan_ids").alias("_p", "plan_id"))
    each = plans.join(steps.select("plan_id", F.col("step").alias("_s"), "action_id"), "plan_id")
    once = each.groupBy("query_id", "place", "action_id").agg(F.min(F.struct("_p", "_s")).alias("_at"))
    return once.withColumn("step", F.row_number().over(Window.partitionBy("query_id", "place").orderBy("_at", "action_id")) - 1).select("query_id", "place", "step", "action_id")


SIMULATED = "plan_id string, n_steps int, n_violations int, satisfaction double, final string"


#: What an action asks for or changes.
CONDITION = "struct<state_type:string,guard:string,object:string,path:string,op:string,value:string>"

#: Steps that are folded together, whole plans at a time.
AT_ONCE = 1 << 16


def simulate(plans: DataFrame, conditions: DataFrame, initial: DataFrame, goals: DataFrame, final: bool = True) -> DataFrame:
    """SIMULATED of each plan: its steps' changes applied in order, broken preconditions counted, goals checked at the end.

    plans: plan_id, step, action_id; conditions as in state (with guard for conditional ones), or gathered: action_id and an
    array `conditions` of CONDITION; initial and goals: plan_id, object, path, op, value. Changes apply even where a precondition is
    broken; += adds numbers. Without final the final worlds aren't written out, and the column is null.
    """
    plan_id, none = F.col("plan_id").cast("string").alias("plan_id"), F.lit(None).cast("string")
    condition = lambda *extra: F.struct(*extra, "object", "path", "op", "value")
    if "conditions" not in conditions.columns:
        guard = F.col("guard") if "guard" in conditions.columns else none
        each = condition("state_type", guard.alias("guard")).alias("c")
        conditions = conditions.select("action_id", each).groupBy("action_id").agg(F.collect_list("c").alias("conditions"))
    rows = plans.select(plan_id, "step", "action_id").join(conditions, "action_id", "left").select("plan_id", F.lit("step").alias("kind"), "step", F.col("conditions").cast(f"array<{CONDITION}>").alias("conditions"))
    for df, kind in ((initial, "initial"), (goals, "goal")):
        one = F.array(condition(none.alias("state_type"), none.alias("guard"))).cast(f"array<{CONDITION}>")
        rows = rows.unionByName(df.select(plan_id, F.lit(kind).alias("kind"), F.lit(-1).alias("step"), one.alias("conditions")))
    dealt = rows.repartition("plan_id").sortWithinPartitions("plan_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, AT_ONCE
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(_starts(_plan_codes(whole))[-1])  # the last plan may go on
                if cut:
                    yield _folded(whole.slice(0, cut), final)
                held, n = [whole.slice(cut)], whole.num_rows - cut
                most = AT_ONCE if cut else 2 * n
        if n:
            yield _folded(pa.Table.from_batches(held).combine_chunks().to_batches()[0], final)

    return dealt.mapInArrow(run, SIMULATED)


_ROW = ("step", "kind", "object", "path", "value", "state_type", "op", "guard")


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """(codes, words) of a column, in order of the words' bytes; null is -1."""
    found = column.dictionary_encode()
    words = found.dictionary.to_pylist()
    order = sorted(range(len(words)), key=lambda i: words[i].encode() if isinstance(words[i], str) else words[i])
    rank = np.full(len(words) + 1, -1)
    rank[order] = np.arange(len(words))
    return rank[found.indices.fill_null(-1).to_numpy(zero_copy_only=False)], [words[i] for i in order]


def _plan_codes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("plan_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _starts(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _folded(batch: pa.RecordBatch, final: bool = True) -> pa.RecordBatch:
    """SIMULATED of whole plans, whose rows (plan_id, kind, step, conditions) stand together: what `_run_plan` finds, for all plans at once.

    A slot is an object's path in a plan. Changes of a slot in order are its versions, of which preconditions and goals look up
    theirs. Sums run over all slots side by side, so there are as many rounds as one slot has changes. Texts are compared once for
    each combination. A plan with guards, by which slots depend on one another, is folded by itself.
    """
    ids = _plan_codes(batch)
    starts = _starts(ids)
    numbered = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
    lists = batch.column("conditions")
    within = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    columns = {f.name: column for f, column in zip(flat.type, flat.flatten(), strict=True)} | {c: batch.column(c).take(pa.array(within)) for c in ("step", "kind")}
    plan, coded = numbered[within], {c: _codes(columns[c]) for c in _ROW}
    place = np.lexsort([*(coded[c][0] for c in reversed(_ROW)), plan])
    coded = {c: (codes[place], words) for c, (codes, words) in coded.items()}
    among = lambda c, *words: np.isin(coded[c][0], [i for i, w in enumerate(coded[c][1]) if w in words])
    rank, last = coded["step"][0] + 1, len(coded["step"][1]) + 1
    (objects, object_words), (paths, path_words), (value, words), (op, ops) = (coded[c] for c in ("object", "path", "value", "op"))
    keys = (objects + 1) * (len(path_words) + 1) + paths + 1
    slots, slot = np.unique(plan * (len(object_words) + 1) * (len(path_words) + 1) + keys, return_inverse=True)
    is_step, is_goal, is_initial = among("kind", "step"), np.flatnonzero(among("kind", "goal")), np.flatnonzero(among("kind", "initial"))

    texts, numbers = list(words), np.array([*map(_number, words), 0.0])  # of null: 0
    begin = np.full(len(slots), -1)
    begin[slot[is_initial]] = value[is_initial]
    set_ = np.zeros(len(slots), bool)
    set_[slot[is_initial]] = True
    change = np.flatnonzero(is_step & among("state_type", "new", "conditional_new"))
    change = change[np.argsort(slot[change], kind="stable")]
    of = slot[change]
    set_[of] = True
    after, adds = value[change], among("op", "+=")[change]
    if adds.any():
        summed = np.zeros(len(slots), bool)
        summed[of[adds]] = True
        rows = np.flatnonzero(summed[of])
        first = _starts(of[rows])
        nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        rows = rows[np.argsort(nth, kind="stable")]
        now, sums = numbers[begin], np.zeros(len(change))
        with np.errstate(all="ignore"):
            for i in np.split(rows, np.cumsum(np.bincount(nth))[:-1]):
                more = numbers[value[change[i]]]
                sums[i] = now[of[i]] = np.where(adds[i], now[of[i]] + more, more)
        found, which = np.unique(sums[adds].view(np.int64), return_inverse=True)
        after[adds] = len(texts) + which
        texts += [str(x) for x in found.view(np.float64).tolist()]
    versions = of * (last + 1) + rank[change]

    def at(slots: np.ndarray, ranks: np.ndarray | int) -> np.ndarray:
        """The values of slots before the steps of these ranks."""
        if not len(change):
            return begin[slots]
        i = np.searchsorted(versions, slots * (last + 1) + ranks) - 1
        return np.where((i >= 0) & (of[i] == slots), after[i], begin[slots])

    def met(rows: np.ndarray, actual: np.ndarray) -> np.ndarray:
        text = lambda words, i: None if i < 0 else words[i]
        asked, which = np.unique(((actual + 1) * (len(ops) + 1) + op[rows] + 1) * (len(words) + 1) + value[rows] + 1, return_inverse=True)
        told = []
        for x in asked.tolist():
            x, v = divmod(x, len(words) + 1)
            a, o = divmod(x, len(ops) + 1)
            told.append(holds(text(texts, a - 1), text(ops, o - 1), text(words, v - 1)))
        return np.array(told, bool)[which]

    n = len(starts)
    asked = np.flatnonzero(is_step & among("state_type", "precondition"))
    broken = np.bincount(plan[asked], ~met(asked, at(slot[asked], rank[asked])), n).astype(np.int64)
    wanted, fine = np.bincount(plan[is_goal], minlength=n), np.bincount(plan[is_goal], met(is_goal, at(slot[is_goal], last)), n)
    satisfied = np.where(wanted > 0, fine / np.maximum(wanted, 1), 1.0)
    (kinds, kind_words), (step, _) = _codes(batch.column("kind")), _codes(batch.column("step"))
    steps = np.unique(((numbered * (step.max() + 2)) + step + 1)[np.isin(kinds, [i for i, w in enumerate(kind_words) if w == "step"])])
    n_steps = np.bincount(steps // (step.max() + 2), minlength=n)
    ends: list[str | None] = [None] * n
    if final:
        lists: list[list] = [[] for _ in range(n)]
        for s, a in zip(slots[set_].tolist(), at(np.flatnonzero(set_), last).tolist(), strict=True):
            s, path = divmod(s, len(path_words) + 1)
            k, obj = divmod(s, len(object_words) + 1)
            lists[k].append([object_words[obj - 1] if obj else None, path_words[path - 1] if path else None, texts[a] if a >= 0 else None])
        ends = [json.dumps(sorted(x)) for x in lists]
    guard_words = coded["guard"][1]
    guarded = is_step & among("state_type", "conditional_new") & among("guard", *(w for w in guard_words if w))
    for k in np.unique(plan[guarded]).tolist():
        own = pa.array(place[plan == k])
        _, broken[k], satisfied[k], end = _run_plan(list(zip(*(columns[c].take(own).to_pylist() for c in _ROW), strict=True)))
        ends[k] = end if final else None
    out = [batch.column("plan_id").take(pa.array(starts)), pa.array(n_steps, pa.int32()), pa.array(broken, pa.int32()), pa.array(satisfied, pa.float64()), pa.array(ends, pa.string())]
    return pa.RecordBatch.from_arrays(out, names=["plan_id", "n_steps", "n_violations", "satisfaction", "final"])


def _run_plan(rows: list[tuple]) -> tuple[int, int, float, str]:
    """Steps, broken preconditions, satisfaction and final world of one plan's rows (_ROW), which are in order of step."""
    world = {(obj, path): value for _, kind, obj, path, value, *_ in rows if kind == "initial"}
    broken, numbers = 0, set()
    for number, group in groupby((r for r in rows if r[1] == "step"), key=lambda r: r[0]):
        step = list(group)
        numbers.add(number)
        broken += sum(not holds(world.get((obj, path)), op, value) for _, _, obj, path, value, kind, op, _ in step if kind == "precondition")
        for _, _, obj, path, value, kind, op, guard in step:
            if kind not in ("new", "conditional_new"):
                continue
            if kind == "conditional_new" and guard:
                g = json.loads(guard)
                if not holds(world.get((g.get("object"), g.get("path"))), g.get("op", "eq"), g.get("value")):
                    continue
            world[obj, path] = str(_number(world.get((obj, path))) + _number(value)) if op == "+=" else value
    met = [holds(world.get((obj, path)), op, value) for _, kind, obj, path, value, _, op, _ in rows if kind == "goal"]
    return len(numbers), broken, sum(met) / len(met) if met else 1.0, json.dumps(sorted([o, p, v] for (o, p), v in world.items()))


def _number(value: object) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def holds(actual: str | None, op: str | None, wanted: str | None) -> bool:
    """Whether a value satisfies an operator and a wanted value."""
    a, w = _plain(actual), _plain(wanted)
    if op in ("ne", "!="):
        return a != w
    if op in ("gt", ">", "gte", ">=", "lt", "<", "lte", "<="):
        if not isinstance(a, float) or not isinstance(w, float):
            return False
        return {"gt": a > w, ">": a > w, "gte": a >= w, ">=": a >= w, "lt": a < w, "<": a < w, "lte": a <= w, "<=": a <= w}[op]
    if op == "in":
        return a in [_plain(x) for x in str(wanted).strip("[]").replace('"', "").replace("'", "").split(",")]
    return op != "+=" and a == w


@lru_cache(1 << 16)
def _plain(value: object) -> object:
    if value is None or (isinstance(value, float) and value != value):
        return None
    text = str(value).strip().strip("'\"")
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", "null"):
        return None
    try:
        return float(text)
    except ValueError:
        return text


STAGES = (("top10", 10), ("all", None))


def staged(results: DataFrame, stages: Sequence[tuple[str, int | None]] = STAGES) -> DataFrame:
    """(query_id, stage, memory_id): the memories of each stage, the best of a search and all of it. results: query_id, memory_id, score."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    placed = results.select("query_id", "memory_id", place.alias("_n"))
    taken = F.array(*(F.struct(F.lit(name).alias("stage"), (F.lit(True) if most is None else F.col("_n") <= most).alias("in")) for name, most in stages))
    return placed.select("query_id", "memory_id", F.explode(taken).alias("s")).where("s.in").select("query_id", "s.stage", "memory_id")


def subgoal(prefix: str = "") -> Column:
    """A condition's name as a subgoal."""
    return F.concat_ws("|", *(F.coalesce(F.col(f"{prefix}{c}").cast("string"), F.lit("")) for c in ("object", "path", "op", "value")))


def _unmet(needs: DataFrame, initial: DataFrame) -> DataFrame:
    """needs (query_id, ..., object, path, op, value) without those that their query's initial conditions fulfil."""
    actual = initial.select("query_id", "object", "path", F.col("value").alias("_actual"))
    met = needs.join(actual, ["query_id", "object", "path"]).where(compare(F.col("_actual"), F.coalesce("op", F.lit("eq")), F.col("value")))
    keys = [c for c in needs.columns]
    return needs.join(met.select(*keys).distinct(), keys, "left_anti")


def seed_subgoals(chosen: DataFrame, conditions: DataFrame, initial: DataFrame) -> DataFrame:
    """(query_id, stage, seed, object, path, op, value): what a seed needs, as preconditions and old states, that does not hold yet."""
    needed = conditions.where(F.col("state_type").isin("precondition", "old")).select(F.col("action_id").alias("seed"), "object", "path", "op", "value")
    needed = needed.join(chosen.select(F.col("action_id").alias("seed")).distinct(), "seed", "left_semi").distinct()
    wanted = chosen.select("query_id", "stage", F.col("action_id").alias("seed")).join(needed, "seed")
    return _unmet(wanted.select("query_id", "stage", "seed", "object", "path", "op", "value"), initial)


STAGE = ["query_id", "stage"]


def derivations(edges: DataFrame, wants: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, stage, subgoal_id, action_id, height) of every subgoal that can be reached: the action that gives it, and how many actions' needs lie under it.

    edges: query_id, stage, subgoal_id, action_id, place: which actions give a subgoal, in order; wants: query_id, stage,
    action_id, subgoal_id: what an action needs that does not hold. From the actions that need nothing, each round reaches the
    subgoals of actions all of whose needs were reached before, the first of them in order. Only what the last round reached is
    looked at; it ends when that is nothing. What a round finds is stored before it meets edges, wants or what was reached, so the
    optimiser knows how small it is and shuffles none of these for it. An action that only leads around a cycle, or to what nothing gives, is never ready.
    """
    spark = edges.sparkSession
    edges, wants = stored(edges), stored(wants)
    ready = stored(edges.select(*STAGE, "action_id").distinct().join(wants, [*STAGE, "action_id"], "left_anti"))
    folder, reached, new = None, None, None
    for height in range(depth + 1):
        given = stored(edges.join(ready, [*STAGE, "action_id"]))
        fresh = given
        if reached is not None:
            before = reached.join(given.select(*STAGE, "subgoal_id"), [*STAGE, "subgoal_id"], "left_semi")
            fresh = given.join(before.select(*STAGE, "subgoal_id"), [*STAGE, "subgoal_id"], "left_anti")
        found = fresh.groupBy(*STAGE, "subgoal_id").agg(F.min_by("action_id", F.struct("place", "action_id")).alias("action_id")).withColumn("height", F.lit(height))
        folder = folder or stored_folder(spark)
        found.write.parquet(f"{folder}/round-{height}")
        new = spark.read.schema(found.schema).parquet(f"{folder}/round-{height}")
        removed(given, ready)
        if new.isEmpty():
            break
        reached = spark.read.schema(found.schema).parquet(*(f"{folder}/round-{k}" for k in range(height + 1)))
        touched = stored(wants.join(new.select(*STAGE, "subgoal_id"), [*STAGE, "subgoal_id"], "left_semi").select(*STAGE, "action_id").distinct())
        checked = stored(wants.join(touched, [*STAGE, "action_id"]))
        held = reached.join(checked.select(*STAGE, "subgoal_id"), [*STAGE, "subgoal_id"], "left_semi").select(*STAGE, "subgoal_id", F.lit(1).alias("_met"))
        met = checked.join(held, [*STAGE, "subgoal_id"], "left")
        ready = stored(met.groupBy(*STAGE, "action_id").agg(F.count("*").alias("_n"), F.count("_met").alias("_m")).where("_n = _m").select(*STAGE, "action_id"))
        removed(touched, checked)
    return new if reached is None else reached


def _under(starts: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, subgoal_id) of all subgoals that links (query_id, stage, subgoal_id, want) lead to from starts, by doubling: links of 1, 2, 4, ... steps are taken from the longest down."""
    jumps = [stored(links.distinct())]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        further = last.select(*STAGE, F.col("subgoal_id").alias("want"), F.col("want").alias("_next"))
        jumps.append(stored(last.join(further, [*STAGE, "want"]).select(*STAGE, "subgoal_id", F.col("_next").alias("want")).distinct()))
    found = starts.select(*keys, "subgoal_id").distinct()
    for jump in reversed(jumps[:-1]):
        found = stored(found.unionByName(found.join(jump, [*STAGE, "subgoal_id"]).select(*keys, F.col("want").alias("subgoal_id"))).distinct())
    return found


#: Steps back from the goals in which only what they ask for is looked at.
NEAR = 4


def _asked_for(goals: DataFrame, allowed: DataFrame, effects: DataFrame, needs: DataFrame, initial: DataFrame, n: int) -> tuple[DataFrame, DataFrame] | None:
    """(edges, wants) as `derivations` takes them, of what goals (query_id, stage, subgoal_id) lead back to in NEAR steps; None if they lead further.

    All that a subgoal's reaching depends on is what it leads back to, so nothing else needs to be worked out.
    """
    frontier = goals.select(*STAGE, "subgoal_id").distinct()
    seen, all_edges, all_wants = stored(frontier), [], []
    frontier = seen
    first = Window.partitionBy(*STAGE, "subgoal_id").orderBy("action_id")
    for _ in range(NEAR):
        giving = stored(effects.join(frontier.select("subgoal_id").distinct(), "subgoal_id", "left_semi"))
        served = giving.join(frontier, "subgoal_id").join(allowed, [*STAGE, "memory_id"], "left_semi").select(*STAGE, "subgoal_id", "action_id").distinct()
        edges = stored(served.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n))
        asked = stored(needs.join(edges.select("action_id").distinct(), "action_id", "left_semi").distinct())
        open_ = stored(edges.select(*STAGE, "action_id").distinct().join(asked, "action_id").select(*STAGE, "action_id", "object", "path", "op", "value"))
        wants = stored(_unmet(open_, initial).select(*STAGE, "action_id", subgoal().alias("subgoal_id")).distinct())
        all_edges.append(edges)
        all_wants.append(wants)
        frontier = stored(wants.select(*STAGE, "subgoal_id").distinct().join(seen, [*STAGE, "subgoal_id"], "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, all_edges), reduce(DataFrame.unionByName, all_wants).distinct()
        seen = stored(seen.unionByName(frontier))
    return None


def _all_served(chosen: DataFrame, allowed: DataFrame, effects: DataFrame, needs: DataFrame, initial: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(edges, wants) as `derivations` takes them, of all allowed memories."""
    served = allowed.join(chosen.select(*STAGE).distinct(), STAGE, "left_semi").join(effects, "memory_id").select(*STAGE, "subgoal_id", "action_id").distinct()
    first = Window.partitionBy(*STAGE, "subgoal_id").orderBy("action_id")
    edges = stored(served.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n))
    wants = _unmet(edges.select(*STAGE, "action_id").distinct().join(needs, "action_id").select(*STAGE, "action_id", "object", "path", "op", "value"), initial)
    return edges, stored(wants.select(*STAGE, "action_id", subgoal().alias("subgoal_id")).distinct())


def seed_plans(chosen: DataFrame, allowed: DataFrame, conditions: DataFrame, initial: DataFrame, n: int = SEEDS, depth: int = DEPTH) -> DataFrame:
    """(query_id, stage, seed, step, action_id): for each seed the actions that fulfil what it needs, each after those that fulfil its own needs, then the seed itself.

    chosen: query_id, stage, action_id; allowed: query_id, stage, memory_id; conditions as in state, with memory_id; initial:
    query_id, object, path, value. Only actions of allowed memories serve, the n least of each subgoal. Subgoals are reached for all
    queries and stages at once, as far as depth; of the actions for one the first that is ready earliest is taken. Seeds
    with a need that is not reached have no plan. Where the seeds' needs lead back NEAR steps at most, only what they lead to is looked at.
    """
    chosen, allowed, conditions, initial = (stored(df) for df in (chosen.select(*STAGE, "action_id"), allowed.select(*STAGE, "memory_id").distinct(), conditions, initial))
    effects = conditions.where("state_type = 'new'").select("memory_id", "action_id", subgoal().alias("subgoal_id"))
    needs = conditions.where(F.col("state_type").isin("precondition", "old")).select("action_id", "object", "path", "op", "value")
    keys = [*STAGE, "seed"]
    goals = stored(seed_subgoals(chosen, conditions, initial).select(*keys, subgoal().alias("subgoal_id")).distinct())
    found = _asked_for(goals, allowed, effects, needs, initial, n)
    edges, wants = found or _all_served(chosen, allowed, effects, needs.distinct(), initial, n)
    ways = derivations(edges, wants, depth)

    lost = goals.join(ways, [*STAGE, "subgoal_id"], "left_anti").select(*keys).distinct()
    links = ways.select(*STAGE, "subgoal_id", "action_id").join(wants.withColumnRenamed("subgoal_id", "want"), [*STAGE, "action_id"]).select(*STAGE, "subgoal_id", "want")
    needed = _under(goals.join(lost, keys, "left_anti"), links, keys)
    steps = needed.join(ways, [*STAGE, "subgoal_id"]).groupBy(*keys, "action_id").agg(F.min("height").alias("height"))
    order = Window.partitionBy(*keys).orderBy("height", "action_id")
    steps = stored(steps.withColumn("step", F.row_number().over(order) - 1).select(*keys, "step", "action_id"))
    alive = chosen.select(*STAGE, F.col("action_id").alias("seed")).distinct().join(lost, keys, "left_anti")
    last = alive.join(steps.groupBy(*keys).agg(F.max("step").alias("_last")), keys, "left").select(*keys, (F.coalesce("_last", F.lit(-1)) + 1).alias("step"), F.col("seed").alias("action_id"))
    both = steps.unionByName(last)
    return both.select(*(F.col(c).cast("int" if c == "step" else "string").alias(c) for c in both.columns))


def resolved_in_state(wanted: DataFrame, objects: DataFrame, scored: DataFrame) -> DataFrame:
    """wanted (name) with obj_id and how: a state's object of that id, else the first of that template, else the most compatible one; null where none is.

    objects: obj_id, template; scored: name, obj_id, score of those that may stand in.
    """
    by_id = objects.select(F.col("obj_id").alias("name"), F.col("obj_id").alias("_id"))
    by_template = objects.groupBy(F.col("template").alias("name")).agg(F.min("obj_id").alias("_template"))
    by_likeness = scored.where("score > 0").groupBy("name").agg(F.min_by("obj_id", F.struct(-F.col("score"), F.col("obj_id"))).alias("_like"))
    out = wanted.join(by_id, "name", "left").join(by_template, "name", "left").join(by_likeness, "name", "left")
    how = F.when(F.col("_id").isNotNull(), "id").when(F.col("_template").isNotNull(), "template").when(F.col("_like").isNotNull(), "compatible")
    return out.withColumn("obj_id", F.coalesce("_id", "_template", "_like")).withColumn("how", how).drop("_id", "_template", "_like")


def substitutions(resolved: DataFrame) -> DataFrame:
    """(name, obj_id, score) of the names that another object stands in for."""
    return resolved.where("how = 'compatible'").drop("how")


def traces(plans: DataFrame, steps: DataFrame, n: int = 10, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """(group, place, plan_id, score, trace): the n best plans of each group with their steps in order as one line of text.

    plans: plan_id, score and the group's columns; steps: plan_id, step, action_id. Only the steps of the best plans are gathered.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "plan_id"))
    best = plans.withColumn("place", place).where(F.col("place") <= n).select(*group, "place", "plan_id", "score")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action_id"))), lambda x: F.concat(x["step"].cast("string"), F.lit(":"), x["action_id"])), " > ")
    told = steps.join(best.select("plan_id"), "plan_id", "left_semi").groupBy("plan_id").agg(line.alias("trace"))
    return best.join(told, "plan_id", "left").select(*group, "place", "plan_id", "score", "trace")


def ranked(plans: DataFrame, threshold: float = 0.0) -> DataFrame:
    """plans with score, coverage and place. plans: verb_score, object_score, satisfaction, n_met, n_goals, n_actions, n_errors, has_seed."""
    ratio: Column = F.when(F.col("n_goals") > 0, F.col("n_met") / F.col("n_goals")).otherwise(1.0)
    score = plan_score(F.col("verb_score"), F.col("object_score"), F.col("satisfaction"), ratio, F.col("n_actions"), F.col("n_errors"))
    out = plans.withColumn("score", F.round(score, 6)).withColumn("coverage", coverage_group(F.col("n_met"), F.col("n_goals"), F.col("has_seed"))).where(F.col("score") >= threshold)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "plan_id")))


def shortest_above(plans: DataFrame, least: int) -> DataFrame:
    """Of each query the shortest plan of more than `least` actions; ties by a seeded hash."""
    order = Window.partitionBy("query_id").orderBy("n_actions", F.xxhash64(F.lit(11), "plan_id"))
    return plans.where(F.col("n_actions") > least).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
