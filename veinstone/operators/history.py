"""What commits were brought in by: walks over a whole commit graph as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.operators.lineage import written


def brought_in(commits: DataFrame, heads: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, number) of every commit that heads(node) reach in commits(node, parents, own, merges): its own number, else that of the innermost merge that
    brought it in, else null.

    parents: array, first parent first; own: the number that the commit's subject names; merges: whether it is the merge of that number. A
    commit is claimed by the walk that takes first parents before others: along a first parent the number stays, to another parent of a merge goes the merge's own. In a graph
    without cycles that walk reaches each commit by the least of its paths, parents compared in order; so each commit's least path is sought, as the lengths of
    its runs along first parents and the parents turned to between them.

    A round takes what changed along first parents, in strides of 1, 2, 4, ... that are tabled once, and then one turn further; there are as many rounds as merges lie
    within merges. All steps are joins by commit, so no line of history has to fit one task. Parents that are not in the table are left out, as are null ones. Repeated rows count once.
    """
    known_nodes = commits.where("node is not null").groupBy("node").agg(F.max("own").alias("own"), F.max(F.coalesce("merges", F.lit(False))).alias("merges"))
    known_nodes = written(known_nodes)
    edges = commits.select("node", F.posexplode("parents").alias("n", "parent")).where("parent is not null and node is not null").distinct()
    edges = written(edges.join(known_nodes.select(F.col("node").alias("parent")), "parent", "left_semi"))
    strides = [written(edges.where("n = 0").groupBy("node").agg(F.min("parent").alias("to")))]
    while not strides[-1].isEmpty():
        if len(strides) > 60:
            raise ValueError("the commits' first parents lead in a circle")
        last = strides[-1]
        strides.append(written(last.join(last.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to"))))
    turns = edges.where("n > 0").join(known_nodes, "node").select("node", "n", "parent", F.when(F.col("merges"), F.col("own")).alias("brings"), F.coalesce(F.col("merges") & F.col("own").isNotNull(), F.lit(False)).alias("new"))
    turns = written(turns)

    def least(paths: DataFrame) -> DataFrame:
        return paths.groupBy("node").agg(F.min(F.struct("path", "number")).alias("m")).select("node", "m.path", "m.number")

    # longer runs come first, so they count downwards
    start = heads.join(known_nodes, "node", "left_semi").select("node", F.array(F.lit(0).cast("long")).alias("path"), F.lit(None).cast(known_nodes.schema["own"].dataType).alias("number"))
    fresh = written(least(start))
    known = fresh.limit(0)
    for _ in range(max_rounds):
        for k, stride in enumerate(strides[:-1]):
            size = F.size("path")
            longer = F.concat(F.slice("path", F.lit(1), size - 1), F.array(F.element_at("path", -1) - F.lit(2**k)))
            fresh = least(fresh.union(fresh.join(stride, "node").select(F.col("to").alias("node"), longer.alias("path"), "number")))
        old = known.select("node", F.col("path").alias("old"))
        better = written(fresh.join(old, "node", "left").where("old is null or path < old").drop("old"))
        if better.isEmpty():
            break
        known = written(least(known.union(better)))
        fresh = better.join(turns, "node").select(F.col("parent").alias("node"), F.concat("path", F.array(F.col("n").cast("long"), F.lit(0).cast("long"))).alias("path"), F.when(F.col("new"), F.col("brings")).otherwise(F.col("number")).alias("number"))
        fresh = written(least(fresh))
    else:
        raise RuntimeError(f"merges lie more than {max_rounds} deep")
    return known.join(known_nodes, "node").select("node", F.coalesce("own", "number").alias("number"))
