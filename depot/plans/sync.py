"""Cache sync: ranked feed -> budget -> new state -> plan."""

from pyspark.sql import DataFrame

from depot.operators.cache import new_state, plan_sync
from depot.operators.ranking import budget_prefix


def plan_cache(
    feed: DataFrame, old: DataFrame, present: DataFrame, budget: int
) -> tuple[DataFrame, DataFrame]:
    """Plan and new state for a feed ``(rank, url, size, etag)`` within ``budget`` bytes.

    A URL listed twice is charged twice but stored once, as the last of the two.
    """
    chosen = budget_prefix(feed.select("rank", "url", "size", "etag"), ["rank", "url"], "size", budget)
    state = new_state(chosen)
    return plan_sync(present, old, state), state
