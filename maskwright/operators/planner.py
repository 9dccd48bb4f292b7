"""Goals to actions: scoring and ranking of elements, decisions, runs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import token_counts
from ..functions.text import intent, subgoals, words

# Weights of the score, and the least score that grounds a goal.
COVERAGE, CLICKABLE, TYPEABLE, NOT_TYPEABLE, SENSITIVE, BLANK, LEAST = 2.4, 0.45, 0.6, -0.7, -0.25, -0.5, 0.75
CLICK_ROLES = ("button", "a", "link", "tab", "summary", "menuitem")


def element_words(label: Column, role: Column, type_: Column) -> Column:
    return F.concat(words(label), words(role), words(type_))


#: Ratios of word pairs kept per Python process, over batches and tasks.
KEPT = 500_000
_ratios: dict[tuple[str, str], float] = {}


@F.pandas_udf(T.DoubleType())
def fuzzy(targets: pd.Series, own: pd.Series) -> pd.Series:
    """Mean over the target words of the best Ratcliff-Obershelp ratio with an
    element's words; there is no built-in function of it."""
    if len(_ratios) > KEPT:
        _ratios.clear()

    def best(w: str, es: list) -> float:
        top = 0.0
        for e in es:
            if w == e:
                return 1.0
            r = _ratios.get((w, e))
            if r is None:
                m = difflib.SequenceMatcher(None, w, e)
                r = m.ratio() if m.real_quick_ratio() > top else 0.0
                if r:
                    _ratios[w, e] = r
            top = max(top, r)
        return top

    return pd.Series([sum(best(w, list(e)) for w in t) / len(t) if len(t) else 0.0 for t, e in zip(targets, own, strict=True)])


def exact_share(targets: Column, own: Column) -> Column:
    """Share of the target words that an element has; the fuzzy ratio's lower bound."""
    return F.size(F.filter(targets, lambda w: F.array_contains(own, w))) / F.size(targets)


def score(op: Column, targets: Column, label: Column, role: Column, type_: Column, sensitive: Column, similar: Column) -> Column:
    """Score of an element for target words; ``similar`` is ``fuzzy`` or ``exact_share``."""
    role = F.lower(F.coalesce(role, F.lit("")))
    own = element_words(label, role, type_)
    field = role.isin("input", "textarea")
    writable = field & ~F.coalesce(type_.isin("submit", "button", "checkbox"), F.lit(False))
    total = exact_share(targets, own) * COVERAGE + similar
    total = total + F.when((op == "click") & role.isin(*CLICK_ROLES), CLICKABLE).otherwise(0.0)
    total = total + F.when((op == "type") & writable, TYPEABLE).otherwise(0.0) + F.when((op == "type") & ~field, NOT_TYPEABLE).otherwise(0.0)
    total = total + F.when(F.coalesce(sensitive, F.lit(False)) & (op == "click"), SENSITIVE).otherwise(0.0)
    total = total + F.when(F.btrim(F.coalesce(label, F.lit(""))) == "", BLANK).otherwise(0.0)
    return F.when(F.size(targets) == 0, 0.0).otherwise(total)


def confidence(total: Column) -> Column:
    return F.bround(F.least(F.lit(0.97), F.lit(0.45) + total / 5), 2)


def ranked(goals: DataFrame, elements: DataFrame, keys: list[str], *, exact: bool = False) -> DataFrame:
    """Every unused element of a goal's frame with its score and rank. ``goals``:
    keys, goal_id, subgoal; ``elements``: keys, seq, ref, label, role, type,
    sensitive. Goals meet only their own frame's elements, at most 250 by S3's limit."""
    g = goals.withColumn("i", intent(F.col("subgoal"))).withColumn("targets", words(F.col("i.target")))
    pairs = g.join(elements, keys)
    own = element_words(F.col("label"), F.col("role"), F.col("type"))
    similar = exact_share(F.col("targets"), own) if exact else fuzzy(F.col("targets"), own)
    total = score(F.col("i.op"), F.col("targets"), F.col("label"), F.col("role"), F.col("type"), F.col("sensitive"), similar)
    order = Window.partitionBy(*keys, "goal_id").orderBy(F.desc("score"), "seq")
    return pairs.withColumn("score", total).withColumn("rank", F.row_number().over(order))


def decided(goals: DataFrame, elements: DataFrame, keys: list[str], used: DataFrame | None = None, *, exact: bool = False) -> DataFrame:
    """One decision a goal: goals (keys, goal_id, goal, done_count) to op, ref,
    text, dy, confidence, done. Elements in ``used`` (keys, goal_id, ref) are
    passed over. A goal without any element left ends ungrounded like one
    without a good one."""
    parts = goals.withColumn("parts", subgoals(F.col("goal"))).withColumn("n", F.size("parts"))
    parts = parts.withColumn("subgoal", F.when(F.col("done_count") < F.col("n"), F.get("parts", F.col("done_count"))))
    live = parts.where("subgoal IS NOT NULL")
    some = ranked(live.select(*keys, "goal_id", "subgoal"), elements, keys, exact=exact)
    if used is not None:
        some = some.join(used, [*keys, "goal_id", "ref"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "goal_id").orderBy(F.desc("score"), "seq")))
    top = some.where("rank = 1").select(*keys, "goal_id", "ref", "score")
    d = parts.join(top, [*keys, "goal_id"], "left").withColumn("i", intent(F.col("subgoal")))
    over, scrolls = F.col("subgoal").isNull(), F.col("i.op") == "scroll"
    grounded = F.coalesce(F.col("score") >= LEAST, F.lit(False))
    return d.select(
        *keys, "goal_id",
        F.when(over, "noop").when(scrolls, "scroll").when(grounded, F.col("i.op")).otherwise("noop").alias("op"),
        F.when(~over & ~scrolls & grounded, F.col("ref")).alias("ref"),
        F.when(~over & grounded & (F.col("i.op") == "type"), F.coalesce("i.value", F.lit(""))).alias("text"),
        F.when(~over & scrolls, 500).alias("dy"),
        F.when(over, 0.9).when(scrolls, 0.8).when(grounded, confidence(F.col("score"))).otherwise(0.3).alias("confidence"),
        (over | (~scrolls & ~grounded)).alias("done"),
    )


def plan_steps(goals: DataFrame, elements: DataFrame, keys: list[str], *, steps: int = 8, exact: bool = False) -> DataFrame:
    """Decisions of whole runs, every action taken as done well, at most
    ``steps`` of them: goals (keys, goal_id, goal) to step, op, ref, text, dy,
    confidence, done. Every subgoal's ranking is made once; a fold over a run's
    subgoals then takes each one's best element that no earlier one took. A
    run's state is at most ``steps`` elements for each of ``steps`` subgoals."""
    parts = goals.select(*keys, "goal_id", F.posexplode_outer(F.slice(subgoals(F.col("goal")), 1, steps)).alias("n", "subgoal"), F.size(subgoals(F.col("goal"))).alias("all"))
    live = parts.where("subgoal IS NOT NULL").select(*keys, F.struct("goal_id", "n").alias("goal_id"), "subgoal")
    # A run takes at most ``steps`` elements, so no subgoal needs more of its best ones.
    some = ranked(live, elements, keys, exact=exact).where(F.col("rank") <= steps).groupBy(*keys, "goal_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref", "score"))).alias("c"))
    some = some.select(*keys, F.col("goal_id.goal_id").alias("goal_id"), F.col("goal_id.n").alias("n"), "c")
    per = parts.join(some, [*keys, "goal_id", "n"], "left").withColumn("i", intent(F.col("subgoal")))
    runs = per.groupBy(*keys, "goal_id").agg(F.first("all").alias("all"), F.array_sort(F.collect_list(F.when(F.col("subgoal").isNotNull(), F.struct("n", "i", F.coalesce("c", F.array().cast("array<struct<rank:int,ref:string,score:double>>")).alias("c"))))).alias("s"))
    made = "struct<op:string,ref:string,text:string,dy:int,confidence:double,done:boolean>"

    def decision(x: Column, pick: Column) -> Column:
        scrolls, grounded = x["i"]["op"] == "scroll", F.coalesce(pick["score"] >= LEAST, F.lit(False))
        return F.struct(
            F.when(scrolls, "scroll").when(grounded, x["i"]["op"]).otherwise("noop").alias("op"),
            F.when(~scrolls & grounded, pick["ref"]).alias("ref"),
            F.when(grounded & (x["i"]["op"] == "type"), F.coalesce(x["i"]["value"], F.lit(""))).alias("text"),
            F.when(scrolls, 500).alias("dy"),
            F.when(scrolls, 0.8).when(grounded, confidence(pick["score"])).otherwise(0.3).alias("confidence"),
            (~scrolls & ~grounded).alias("done"),
        ).cast(made)

    def step(a: Column, x: Column) -> Column:
        taken = F.transform(a, lambda d: d["ref"])
        pick = F.get(F.filter(x["c"], lambda c: ~F.coalesce(F.array_contains(taken, c["ref"]), F.lit(False))), F.lit(0))
        return F.when(F.coalesce(F.try_element_at(a, F.lit(-1))["done"], F.lit(False)), a).otherwise(F.concat(a, F.array(decision(x, pick))))

    folded = F.aggregate("s", F.array().cast(f"array<{made}>"), step)
    over = F.struct(F.lit("noop").alias("op"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("dy"), F.lit(0.9).alias("confidence"), F.lit(True).alias("done"))
    d = runs.select(*keys, "goal_id", "all", folded.alias("d"))
    ended = F.coalesce(F.try_element_at("d", F.lit(-1))["done"], F.lit(False))
    d = d.withColumn("d", F.when(~ended & (F.col("all") < steps), F.concat("d", F.array(over.cast(made)))).otherwise(F.col("d")))
    return d.select(*keys, "goal_id", F.posexplode("d").alias("p", "x")).select(*keys, "goal_id", (F.col("p") + 1).alias("step"), "x.*")


def rationale(number: Column, count: Column, subgoal: Column, op: Column, best: Column, elements: Column, tokens: Column) -> Column:
    """The sentence that explains a decision. ``number`` counts subgoals from 1;
    ``best``: struct of role, label, sensitive, box and score of the best
    element left, or null; ``elements``: how many the frame carries; ``tokens``:
    the tokens of its masked regions."""
    # The sentences.
    seen = F.format_string("frame carries %d actionable elements; redactions: %s", elements, token_counts(tokens))
    note = F.when(best["sensitive"], " Target is a masked field — I can see its token and coordinates but not its contents, and the client will refuse any write to a severity-3 field.").otherwise("")
    unfounded = F.format_string("Could not ground “%s” on this frame (best candidate “%s” scored %s if any). ", subgoal, F.coalesce(best["label"], F.lit("—")), F.when(best["score"].isNull(), "0.00").otherwise(F.format_string("%.2f", best["score"])))
    grounded = F.format_string("Sub-goal %d/%d: “%s”. Grounded to <%s> “%s” at %d,%d (score %.2f).", number, count, subgoal, best["role"], best["label"], best["box"]["x"], best["box"]["y"], best["score"])
    said = (
        F.when(number > count, F.format_string("All %d sub-goal(s) satisfied. ", count))
        .when(op == "scroll", F.format_string("Sub-goal %d/%d is a scroll. ", number, count))
        .when(F.coalesce(best["score"] < LEAST, F.lit(True)), unfounded)
        .otherwise(F.concat(grounded, note, F.lit(" ")))
    )
    return F.concat(said, seen, F.lit("."))


def outcome(decision: Column, error: Column, planner: str) -> Column:
    """struct<status, error> of a back end's answer: 502 where it failed, so that
    a dead model doesn't look like a privacy failure, else 200."""
    failed = error.isNotNull() | decision.isNull()
    return F.struct(F.when(failed, 502).otherwise(200).alias("status"), F.when(failed, F.concat(F.lit(f"{planner} back end failed: "), F.coalesce(error, F.lit("no decision")))).alias("error"))
