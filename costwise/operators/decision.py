"""Expected-cost decision.

The service searches a one-step tree of three actions for the cheapest;
that is an argmin over three column expressions per row. It stays
row-local (no group-by on the transaction id, which is not unique).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACTIONS, DEFAULT_FALSE_POSITIVE_COST, DEFAULT_FRAUD_LOSS, DEFAULT_REVIEW_COST


@dataclass(frozen=True)
class CostParams:
    """Cost of letting fraud through, of blocking a good payment, of a review."""

    fraud_loss: float = DEFAULT_FRAUD_LOSS
    false_positive_cost: float = DEFAULT_FALSE_POSITIVE_COST
    review_cost: float = DEFAULT_REVIEW_COST

    def __call__(self, p: Column, action: str) -> Column:
        """Expected cost of ``action`` at fraud probability ``p``."""
        if action == "approve":
            return p * F.lit(self.fraud_loss)
        if action == "block":
            return (F.lit(1.0) - p) * F.lit(self.false_positive_cost)
        if action == "review":
            return F.lit(self.review_cost).cast("double")
        raise ValueError(f"no cost is defined for the action {action!r}")


CostFn = Callable[[Column, str], Column]


def cost_of(p: Column, action: Column, cost: CostFn = CostParams(), actions=ACTIONS) -> Column:
    """P9 with the action as data: an action without a cost fails the job."""
    expr = F.when(F.lit(False), F.lit(None).cast("double"))
    for a in actions:
        expr = expr.when(action == a, cost(p, a))
    return expr.otherwise(F.raise_error(F.concat(F.lit("no cost is defined for the action "), F.coalesce(action.cast("string"), F.lit("null")))))


def action_costs(df: DataFrame, p: str = "fraud_probability", cost: CostFn = CostParams(), actions=ACTIONS) -> DataFrame:
    """D2 for every action, as ``cost_<action>`` columns."""
    return df.withColumns({f"cost_{a}": cost(F.col(p), a).cast("double") for a in actions})


def _guarded(p: Column) -> Column:
    """A probability that is null or NaN has no decision."""
    return F.when(p.isNull() | F.isnan(p), F.raise_error(F.lit("undecidable row: its fraud probability is missing or not a number"))).otherwise(p)


def cheapest(p: Column, cost: CostFn = CostParams(), actions=ACTIONS) -> Column:
    """The cheapest action; ties go to the earlier action in ``actions``."""
    g = _guarded(p)
    options = F.array(*[F.struct(cost(g, a).cast("double").alias("cost"), F.lit(i).alias("rank"), F.lit(a).alias("action")) for i, a in enumerate(actions)])
    return F.array_min(options)["action"]


def choose_action(
    df: DataFrame,
    p: str = "fraud_probability",
    cost: CostFn = CostParams(),
    actions=ACTIONS,
    out: str = "decision",
    with_costs: bool = False,
) -> DataFrame:
    """D3: add the decision; ``with_costs`` also adds the A7 best-cost map."""
    df = df.withColumn(out, cheapest(F.col(p), cost, actions))
    if with_costs:
        df = df.withColumn(
            "costs", F.map_from_arrays(F.array(*[F.lit(a) for a in actions]), F.array(*[cost(F.col(p), a).cast("double") for a in actions]))
        )
    return df


def action_options(df: DataFrame, p: str = "fraud_probability", cost: CostFn = CostParams(), actions=ACTIONS, keep=("transaction_id",)) -> DataFrame:
    """J1 long form: one row per (transaction, action) with its cost and rank.

    A generator over a three-literal array: the fan-out is fixed at three, so
    it is an explode inside the same stage, not a join.
    """
    opts = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(a).alias("action"), cost(F.col(p), a).cast("double").alias("cost")) for i, a in enumerate(actions)])
    return df.select(*keep, p, F.inline(opts))


def is_terminal(action: Column) -> Column:
    """P5: an action has been chosen."""
    return action.isNotNull()


# ---------------------------------------------------------------- undecidable rows
def undecidable(p: Column) -> Column:
    """D4 as data: why a row can have no decision, null if it can."""
    return (
        F.when(p.isNull(), F.lit("fraud probability is null"))
        .when(F.isnan(p), F.lit("fraud probability is not a number"))
        .when((p < 0.0) | (p > 1.0), F.concat(F.lit("fraud probability is outside [0, 1]: "), p.cast("string")))
    )


def decide_or_reject(df: DataFrame, p: str = "fraud_probability", cost: CostFn = CostParams(), actions=ACTIONS, out: str = "decision", reason: str = "reject_reason") -> DataFrame:
    """D3 + D4 without a failing job: the decision, or null and the reason why there is none. Row-local."""
    why = undecidable(F.col(p))
    safe = F.when(why.isNull(), F.col(p)).otherwise(F.lit(0.0))  # the guard of ``cheapest`` never meets a bad value
    return df.withColumns({out: F.when(why.isNull(), cheapest(safe, cost, actions)), reason: why})


# ---------------------------------------------------------------- costs as data
#: Cost rows up to this many (about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_COSTS = 100_000
#: Columns of a cost table: expected cost = p * if_fraud + (1 - p) * if_clean + fixed.
COST_COLUMNS = ("segment", "action", "rank", "if_fraud", "if_clean", "fixed")


def cost_options(costs: DataFrame) -> DataFrame:
    """(segment, options): a segment's cost rows as one array; the group is as small as its proposals.

    Several rows may propose one action (each is an offer of its own); ties
    between costs go to the smaller ``rank``, then to the earlier action name.
    """
    offer = F.struct(F.col("rank").cast("int").alias("rank"), "action", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in COST_COLUMNS[3:]])
    return costs.filter("action IS NOT NULL").groupBy("segment").agg(F.array_sort(F.collect_set(offer)).alias("_offers"))


def choose_by_table(df: DataFrame, costs: DataFrame, segment: str = "segment", p: str = "fraud_probability", out: str = "decision", broadcast_rows: int = BROADCAST_COSTS) -> DataFrame:
    """D1-D3, A7, A8, J1 with actions and costs as data: adds ``out``, ``best_cost`` and ``costs``.

    ``costs`` holds ``COST_COLUMNS``. Each row meets the offers of its segment
    (a null segment those of the null segment), by a broadcast while the cost
    table is small (checked), else by a join on the segment. The rest is
    row-local, so repeated ids stay separate rows: ``costs`` maps each
    proposed action to the cheapest of its offers, ``out`` is the cheapest
    action. A row whose segment has no offer has a null decision; a
    probability that is null or NaN fails the job (``decide_or_reject`` tells such
    rows apart).
    """
    options = cost_options(costs)
    if costs.count() <= broadcast_rows:
        options = F.broadcast(options)
    joined = df.join(options.withColumnRenamed("segment", "_segment"), F.col(segment).eqNullSafe(F.col("_segment")), "left")
    g = _guarded(F.col(p))
    priced = F.transform("_offers", lambda o: F.struct((g * o["if_fraud"] + (F.lit(1.0) - g) * o["if_clean"] + o["fixed"]).alias("cost"), o["rank"].alias("rank"), o["action"].alias("action")))
    joined = joined.withColumn("_priced", priced)
    best = F.array_min("_priced")
    names = F.array_distinct(F.transform("_priced", lambda o: o["action"]))
    cheapest_of = lambda a: F.array_min(F.filter("_priced", lambda o: o["action"] == a))["cost"]
    return joined.withColumns({out: best["action"], "best_cost": best["cost"], "costs": F.map_from_arrays(names, F.transform(names, cheapest_of))}).drop("_segment", "_offers", "_priced")


def cheapest_proposals(proposals: DataFrame, key: tuple[str, ...], cost: str = "cost", action: str = "action", rank: str = "rank") -> DataFrame:
    """A7 + A8 over a long table of proposals: per key the best cost of each action and the cheapest action.

    Two groupings whose minima are combined where the rows are read: first the
    cheapest proposal of each (key, action), so a key that holds many proposals
    moves as one row per task and action, then the cheapest action of a key.
    Ties go to the smaller rank, then the earlier name; proposals without a
    cost or an action count for nothing.
    """
    known = proposals.filter(F.col(cost).isNotNull() & ~F.isnan(F.col(cost).cast("double")) & F.col(action).isNotNull())
    per_action = known.groupBy(*key, action).agg(F.min(F.struct(F.col(cost).cast("double").alias("cost"), F.col(rank).alias("rank"))).alias("_best"))
    offer = F.struct(F.col("_best.cost").alias("cost"), F.col("_best.rank").alias("rank"), F.col(action).alias("action"))
    return (
        per_action.groupBy(*key)
        .agg(F.min(offer).alias("_least"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(action), F.col("_best.cost"))))).alias("costs"))
        .select(*key, F.col("_least.action").alias("decision"), F.col("_least.cost").alias("best_cost"), "costs")
    )
