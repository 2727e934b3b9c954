"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import shared_folder, written


def components(links: DataFrame, base: str | None = None) -> DataFrame:
    """(node, root) for every node that occurs in (a, b); root is the smallest node of its component.

    In each round every node points to its smallest neighbour or itself; pointers
    are followed four steps, links are drawn between the ends of pointers, and
    links within one end vanish.  All nodes but local minima go, so rounds grow
    with the logarithm of a component's length.  A null end, or a link from a node
    to itself, links nothing; no links give no rows.
    """
    base = base or shared_folder(links.sparkSession)
    real = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(real.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links0", base)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    turn = 0
    while edges.limit(1).count():
        turn += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        for jump in range(2):
            step = written(step, f"step{turn}_{jump}", base)
            further = step.select(F.col("node").alias("to"), F.col("to").alias("end"))
            step = step.join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        step = written(step, f"step{turn}_2", base)
        drawn = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = written(drawn.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links{turn}", base)
        roots = written(roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"roots{turn}", base)
    return roots
