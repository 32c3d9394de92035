"""Weights of query routes: route 0 is the original wording, the others are rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, by which results are compared.
RRF_K = 60
ORIGINAL_WEIGHT = 1.0
REWRITE_WEIGHT = 0.15
REWRITE_BUDGET = 0.60
REWRITE_DAMPEN = 0.35
MAX_REWRITES = 4


def build_weights(n_variants: int, weights: list[float] | None = None, *, original: float = ORIGINAL_WEIGHT, rewrite: float = REWRITE_WEIGHT, share_budget: bool = True, budget: float = REWRITE_BUDGET) -> list[float]:
    """A weight for each route. Explicit weights must be one for all, or one for each route."""
    routes = n_variants + 1
    if weights is not None:
        if len(weights) not in (1, routes):
            raise ValueError(f"{len(weights)} weights for {routes} routes")
        return weights * routes if len(weights) == 1 else list(weights)
    each = budget / n_variants if share_budget and n_variants else rewrite
    return [original] + [each] * n_variants


def route_weight(route: Column, n_variants: Column, *, weights: list[float] | None = None, original: float = ORIGINAL_WEIGHT, rewrite: float = REWRITE_WEIGHT, share_budget: bool = True, budget: float = REWRITE_BUDGET) -> Column:
    """The weight as an expression of the route's number and its query's number of rewrites, by the rules of build_weights."""
    if weights is not None:
        if not weights:
            raise ValueError("no weights")
        if len(weights) == 1:
            return F.lit(float(weights[0]))
        each = F.get(F.array(*[F.lit(float(w)) for w in weights]), route.cast("int"))
        return F.when(n_variants + 1 == len(weights), each).otherwise(F.raise_error(F.lit(f"{len(weights)} weights don't fit the number of routes")).cast("double"))
    each = F.lit(budget) / n_variants if share_budget else F.lit(rewrite)
    return F.when(route == 0, F.lit(original)).otherwise(each)


def route_label(route: Column) -> Column:
    return F.when(route == 0, F.lit("original")).otherwise(F.concat(F.lit("rewrite "), route.cast("string")))


def contribution(weight: Column, rank: Column, k: int = RRF_K) -> Column:
    """What a route adds to a document's score, before damping; 0 where the route lacks it."""
    return F.coalesce(weight / (k + rank), F.lit(0.0))


def parse_weights(text: str | None) -> list[float] | None:
    """ "1.0,0.15" as numbers; blank parts are skipped, nothing is None."""
    parts = [float(x) for x in (text or "").split(",") if x.strip()]
    return parts or None
