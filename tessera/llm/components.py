"""Connected components of a link table, by random hooking and contraction.

In each round every node hooks onto the neighbour with the smallest hash (or
stays, if its own is smaller), and the links are rewritten between what is left;
a constant share of the nodes goes each time, whatever the shape, and a star is
gone after two or three rounds.  The hashes change with the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, release


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 80) -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable) for every linked node.

    Links are never gathered on the driver; each round is written to the shared
    folder, so a lost executor costs one round at most.  A node with very many
    links is pre-aggregated before it is shuffled, and joins on it can be split.
    Self-links and nulls are ignored; no links give an empty table.
    """
    edges = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    labels, spent = None, []
    for k in range(rounds):
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy("src").agg(F.min(F.xxhash64("dst", F.lit(k))).alias("h"), F.min_by("dst", F.xxhash64("dst", F.lit(k))).alias("n"))
        to = F.when(F.col("h") < F.xxhash64("src", F.lit(k)), F.col("n")).otherwise(F.col("src"))
        hooks = materialize(hooks.select(F.col("src").alias("node"), to.alias("root")), "hooks")
        spent.append(hooks)
        if labels is None:
            labels = hooks
        else:
            moved = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        left = edges.join(hooks.select(F.col("node").alias("src"), F.col("root").alias("x")), "src")
        left = left.join(hooks.select(F.col("node").alias("dst"), F.col("root").alias("y")), "dst").where("x <> y")
        edges = materialize(left.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct(), "links")
        spent.append(edges)
        if edges.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = materialize(labels, "labels")
    release(*spent)
    low = materialize(labels.groupBy("root").agg(F.min("node").alias("component")), "lows")
    return labels.join(low, "root").select("node", "component")
