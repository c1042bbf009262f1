"""All queries over the given tables: name -> (query, SQL of the same rows)."""

from depot.workloads import caches, diffs, inventories, matrices, streams


def all_queries() -> dict:
    found = {}
    for module in (streams, diffs, matrices, caches, inventories):
        found.update(module.QUERIES)
    return found
