"""Connected components over written tables: alternating large-star and small-star steps.

Nothing of the graph comes to the driver but the number of edges that changed.
Each step is a minimum per node (partial aggregation) and a join of two plain
tables, so a node with very many neighbours is split between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, tables: Tables, name: str, most: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the smallest node of its component."""
    e = tables.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    last = f"{name}-0"
    for step in range(1, most + 1):
        # large star: every larger neighbour of u moves to the smallest one around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tables.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{step}a")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tables.save(large.where("u <> v").distinct(), f"{name}-{step}b")
        # small star: the smaller neighbours of u, and u, move to the smallest of them
        low = tables.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}c")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        new = tables.save(small.where("u <> v").distinct(), f"{name}-{step}")
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count()
        tables.drop(last, f"{name}-{step}a", f"{name}-{step}b", f"{name}-{step}c")
        e, last = new, f"{name}-{step}"
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
