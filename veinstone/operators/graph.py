"""Graph operators over edge tables: components, closures, redirects, weighted file graphs, communities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veinstone.functions.numbers import rounded
from veinstone.operators import moving
from veinstone.operators.cochange import grouped_items, paired
from veinstone.operators.lineage import written
from veinstone.operators.spreading import TASK_ROWS, spread


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes: every node hangs its larger neighbours, then its
    smaller ones, on the smallest it knows. Each round is one minimum by node (partially computed
    before the shuffle) and one join back; the pairs never grow. Loops and nulls are left out.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    pairs = written(pairs)
    before = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).union(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        two = F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))
        pairs = written(large.join(least, "v").select(F.explode(two).alias("e")).select("e.v", "e.u").where("v <> u").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).union(pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def ancestors(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, ancestor) for all proper ancestors, from edges(node, parent). Path lengths double each round, diamonds count
    once, cycles are harmless.

    Pairs carry the length of their shortest path. One longer than n begins with a shortest path of n, so a round joins only the pairs n apart with
    those known, not all with all."""
    reach = written(edges.select("node", F.col("parent").alias("ancestor")).where("node is not null and parent is not null").distinct().withColumn("_far", F.lit(1).cast("long")))
    n = 1
    for _ in range(max_rounds):
        last = reach.where(F.col("_far") == n)
        rows = reach.count()
        step = last.select("node", F.col("ancestor").alias("mid")).join(spread(reach.select(F.col("node").alias("mid"), "ancestor", "_far"), rows, "mid"), "mid").select("node", "ancestor", (F.col("_far") + n).alias("_far"))
        step = written(step)
        if step.isEmpty():
            return reach.select("node", "ancestor")
        reach = written(spread(reach.union(step), rows + step.count(), "node", "ancestor").groupBy("node", "ancestor").agg(F.min("_far").alias("_far")))
        n *= 2
    raise RuntimeError(f"closure did not settle in {max_rounds} rounds")


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node) reachable from starts(node), themselves included: a frontier join a round, each node once."""
    known = frontier = written(starts.select("node").where("node is not null").distinct())
    hops = edges.select(F.col("node").alias("at"), F.col("parent").alias("node")).where("at is not null and node is not null")
    for _ in range(max_rounds):
        frontier = written(frontier.select(F.col("node").alias("at")).join(hops, "at").select("node").distinct().join(known, "node", "left_anti"))
        if frontier.isEmpty():
            return known
        known = written(known.union(frontier))
    raise RuntimeError(f"no end within {max_rounds} rounds")


def final_targets(pointers: DataFrame, max_rounds: int = 12) -> DataFrame:
    """(id, target, state) from redirects(id, target): where each chain ends; state is done, or cycle where it never does.

    Pointer jumping: a round doubles the hops. A target that redirects nowhere is an end."""
    now = written(pointers.where("id is not null and target is not null").groupBy("id").agg(F.min("target").alias("target")))
    for _ in range(max_rounds):
        ahead = now.select(F.col("id").alias("target"), F.col("target").alias("next"))
        jumped = written(now.join(ahead, "target", "left").select("id", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.select("id", "target", F.lit("done").alias("state"))
        now = jumped.drop("moved")
    loop = now.join(now.select(F.col("id").alias("target")).distinct().withColumn("goes_on", F.lit(True)), "target", "left")
    return loop.select("id", "target", F.when(F.col("goes_on"), "cycle").otherwise("done").alias("state"))


class FileGraph:
    """The weighted graph of files without the pairs that only share a folder, which are told by their folders.

    near(a, b, signals, weight), a < b: every pair that anything but one folder speaks for; weight adds the shared folders' part to signals. inside(a, b, dir): those of them
    that share a folder. folders(dir, path, w): w is what each pair of that folder gets. Its size grows with the input, not with the pairs of a folder."""

    def __init__(self, near: DataFrame, inside: DataFrame, folders: DataFrame):
        self.near, self.inside, self.folders = near, inside, folders


def signals(files: DataFrame, imports: DataFrame, changes: DataFrame, sweep: int = 50, import_w: float = 1.0, change_w: float = 2.0, min_changes: int = 2, hub: int = 4) -> DataFrame:
    """(a, b, w), a < b, of imports and common changes, as in file_graph(); a pair may have two rows of either and one of the other."""
    known, n = files.select("path").distinct(), imports.count()
    edges = spread(imports.select("src", "dst").where("src <> dst"), n, "src", "dst").distinct()
    edges = spread(edges, n, "src").join(known.withColumnRenamed("path", "src"), "src", "left_semi")
    edges = spread(edges, n, "dst").join(known.withColumnRenamed("path", "dst"), "dst", "left_semi")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("deg"))
    one = edges.join(into, "dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (import_w * F.least(F.lit(1.0), hub / F.col("deg"))).alias("w"))
    seen = grouped_items(changes, sweep).select("grp", F.explode("items").alias("path"))
    seen = written(spread(seen, changes.count(), "path").join(known, "path", "left_semi"))
    per = seen.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    both = paired(spread(seen, seen.count(), "grp").groupBy("grp").agg(F.sort_array(F.collect_list("path")).alias("items"))).where(F.col("n_shared") >= min_changes)
    both = written(both)
    m = both.count()
    both = spread(spread(both, m, "a").join(per.toDF("a", "na"), "a"), m, "b").join(per.toDF("b", "nb"), "b")
    two = both.select("a", "b", (change_w * F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared"))).alias("w"))
    return one.union(two)


def folders_of(files: DataFrame, dir_w: float = 0.3) -> DataFrame:
    """(dir, path, w) of files(path, dir): w is dir_w over the other files of the folder. Folders of one file are left out."""
    told = files.where(F.col("dir").isNotNull() & F.col("path").isNotNull()).select("dir", "path").distinct()
    w = told.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("dir", (dir_w / (F.col("n") - 1)).alias("w"))
    return told.join(w, "dir").select("dir", "path", "w")


def compact_file_graph(files: DataFrame, imports: DataFrame, changes: DataFrame, sweep: int = 50, import_w: float = 1.0, change_w: float = 2.0, dir_w: float = 0.3, min_changes: int = 2, hub: int = 4) -> FileGraph:
    """The graph of file_graph() with its pairs of one folder left to the folders."""
    folders = written(folders_of(files, dir_w))
    told = signals(files, imports, changes, sweep, import_w, change_w, min_changes, hub)
    # two files that are each in several folders may share more than one
    several = folders.join(folders.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path"), "path", "left_semi")
    twice = several.select("dir", F.col("path").alias("a")).join(several.select("dir", F.col("path").alias("b")), "dir").where("a < b").select("a", "b", F.lit(0.0).alias("w"))
    pairs = written(told.union(twice))
    n = pairs.count()
    pairs = written(spread(pairs, n, "a", "b").groupBy("a", "b").agg(F.sum("w").alias("signals")))
    placed = lambda name: folders.select("dir", F.col("path").alias(name))
    some = written(spread(pairs.select("a", "b"), n, "b").join(placed("b").select("b").distinct(), "b", "left_semi"))
    some = written(spread(some, some.count(), "a").join(folders.select("dir", F.col("path").alias("a"), "w"), "a"))
    inside = written(spread(some, some.count(), "dir", "b").join(placed("b"), ["dir", "b"]))
    extra = spread(inside, inside.count(), "a", "b").groupBy("a", "b").agg(F.sum("w").alias("_w"))
    near = spread(pairs, n, "a", "b").join(extra, ["a", "b"], "left").select("a", "b", "signals", (F.col("signals") + F.coalesce("_w", F.lit(0.0))).alias("weight"))
    return FileGraph(written(near), inside.select("a", "b", "dir"), folders)


def file_graph(files: DataFrame, imports: DataFrame, changes: DataFrame, sweep: int = 50, import_w: float = 1.0, change_w: float = 2.0, dir_w: float = 0.3, min_changes: int = 2, hub: int = 4) -> DataFrame:
    """(a, b, weight), a < b, over files(path, dir), imports(src, dst), changes(grp, item).

    Three signals add up: an import counts import_w, less into hubs (times hub over the target's
    in-degree, at most 1); files changed together at least min_changes times change_w times the
    Jaccard share; files of one directory dir_w over the other files there, for each pair.

    The pairs of a folder are what is asked for; they come from a join by folder, and those that other signals speak for too are left out there, so pairs are
    neither shuffled nor aggregated. Pairs are counted by folder first; a large folder's files are dealt to parts, each two of which make at most some TASK_ROWS pairs,
    and these are dealt to tasks of one size.
    """
    g = compact_file_graph(files, imports, changes, sweep, import_w, change_w, dir_w, min_changes, hub)
    return g.near.select("a", "b", "weight").union(_folder_pairs(g))


def _folder_pairs(g: FileGraph) -> DataFrame:
    """(a, b, weight), a < b, of the pairs that only one folder speaks for."""
    n = F.count(F.lit(1))
    per = written(g.folders.groupBy("dir").agg(n.alias("_n")))
    pairs = per.agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2)).first()[0] or 0
    parts = per.select("dir", F.ceil(F.col("_n") / math.isqrt(TASK_ROWS)).alias("_parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_parts"))
    here = g.folders.join(parts, "dir").withColumn("_part", part("path"))
    both = g.inside.select("dir", "a", "b").union(g.inside.select("dir", F.col("b").alias("a"), F.col("a").alias("b")))
    told = both.join(parts, "dir").where(part("a") <= part("b")).groupBy("dir", "a", part("b").alias("_y")).agg(F.collect_list("b").alias("_told"))
    left = here.select("dir", F.col("path").alias("a"), "w", F.col("_part").alias("_x"), F.explode(F.sequence("_part", F.col("_parts") - 1)).alias("_y"))
    right = here.select("dir", F.col("path").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "_part")).alias("_x"), F.col("_part").alias("_y"))
    # few rows make many pairs, so the number of tasks goes by pairs, and is given
    tasks, cell = max(1, -(-int(pairs) // TASK_ROWS)), ["dir", "_x", "_y"]
    met = left.join(told, ["dir", "a", "_y"], "left").repartition(tasks, *cell).join(right.repartition(tasks, *cell), cell)
    met = met.where("(_x < _y or a < b) and (_told is null or not array_contains(_told, b))")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").alias("weight"))


def _both_ways(edges: DataFrame, one: str, two: str) -> DataFrame:
    return edges.select(F.col("a").alias(one), F.col("b").alias(two), "weight").union(edges.select(F.col("b").alias(one), F.col("a").alias(two), "weight"))


def top_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """(node, neighbour, weight, rank): each node's k heaviest neighbours, ties by the smaller neighbour."""
    w = W.partitionBy("node").orderBy(F.col("weight").desc(), "neighbour")
    return _both_ways(edges, "node", "neighbour").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_files(g: FileGraph, k: int = 5, places: int = 6) -> DataFrame:
    """top_neighbours() of the whole graph, weights rounded to so many places.

    Of those that a node shares only a folder with all weigh the same, so the k first by name are enough; one of these that other signals speak for too weighs more
    than its folder's part, so a pair met both ways has its larger weight."""
    near = g.near.select("a", "b", rounded(F.col("weight"), places).alias("weight"))
    w = W.partitionBy("node").orderBy(F.col("weight").desc(), "neighbour")
    best = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    told = best(spread(_both_ways(near, "node", "neighbour"), 2 * near.count(), "node")).drop("rank")
    first = g.folders.withColumn("_n", F.row_number().over(W.partitionBy("dir").orderBy("path"))).where(F.col("_n") <= k + 1)
    mates = g.folders.select("dir", F.col("path").alias("node"), rounded(F.col("w"), places).alias("weight")).join(first.select("dir", F.col("path").alias("neighbour")), "dir").where("node <> neighbour")
    both = written(told.union(mates.select("node", "neighbour", "weight")))
    return best(spread(both, both.count(), "node").groupBy("node", "neighbour").agg(F.max("weight").alias("weight")))


def rolled_up_files(told: DataFrame, folders: DataFrame, membership: DataFrame) -> DataFrame:
    """rolled_up() of the whole graph of signals() told(a, b, w) and folders_of(): what two groups share by a folder is the product of how many
    files each has there."""
    m = membership.select("path", "feature")
    there = folders.join(m, "path")
    held = there.groupBy("dir", "w", "feature").agg(F.count(F.lit(1)).alias("n"))
    by_folder = held.select("dir", "w", F.col("feature").alias("src"), F.col("n").alias("n1")).join(held.select("dir", F.col("feature").alias("dst"), F.col("n").alias("n2")), "dir").where("src <> dst")
    by_folder = by_folder.select("src", "dst", (F.col("n1") * F.col("n2") * F.col("w")).alias("weight"))
    # a file of two groups is no pair
    own = there.withColumnRenamed("feature", "src").join(m.withColumnRenamed("feature", "dst"), "path").where("src <> dst").select("src", "dst", (-F.col("w")).alias("weight"))
    shared = by_folder.union(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 1e-9")
    told = written(told.select("a", "b", F.col("w").alias("weight")))
    n = told.count()
    named = spread(told, n, "a").join(m.toDF("a", "src"), "a").groupBy("src", "b").agg(F.sum("weight").alias("weight"))
    named = spread(named, n, "b").join(m.toDF("b", "dst"), "b").where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = named.union(named.select("dst", "src", "weight")).union(shared)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rolled_up(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src, dst, weight) between groups, both directions, from edges(a, b, weight) and membership(path, feature)."""
    m = membership.select("path", "feature")
    one = edges.join(m.toDF("a", "fa"), "a").join(m.toDF("b", "fb"), "b").where("fa <> fb")
    return one.select(F.explode(F.array(F.struct(F.col("fa").alias("src"), F.col("fb").alias("dst")), F.struct(F.col("fb").alias("src"), F.col("fa").alias("dst")))).alias("e"), "weight").groupBy("e.src", "e.dst").agg(F.sum("weight").alias("weight"))


def ordered_ids(names: DataFrame) -> DataFrame:
    """(node, id): the distinct names(node) numbered from 0 in their order, in ranges of one size."""
    names = written(names.where("node is not null").select("node").distinct())
    ranges = max(1, -(-names.count() // TASK_ROWS))
    dealt = written(names.repartitionByRange(ranges, "node").withColumn("_range", F.spark_partition_id()))
    per = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    place = F.row_number().over(W.partitionBy("_range").orderBy("node"))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").select("node", (F.col("_before") + F.col("_place") - 1).alias("id"))


def louvain(edges: DataFrame, resolution: float = 1.0, tolerance: float = 0.01, max_turns: int = 12, max_levels: int = 12) -> DataFrame:
    """(node, community) by Louvain's method on edges(a, b, weight); community is the smallest node in it.

    Local moving runs in turns, half of the nodes a turn, over links packed in blocks (operators/moving.py); only communities travel in a turn. A level ends when in
    two turns, in which each node had its own, no more than the share `tolerance` of its nodes move each; if modularity grew, communities then become nodes, with
    the summed weights as edges, until a level brings nothing. Each turn is written to the shared folder. No node's neighbours, component or
    community have to fit one task. The same edges give the same communities. Null ends and weights not above 0 are left out.
    Nodes are numbered in their order first.
    """
    clean = written(edges.where("a is not null and b is not null and weight > 0").select("a", "b", F.col("weight").cast("double").alias("w")))
    ends = F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other")), F.struct(F.col("y").alias("node"), F.col("x").alias("other"))))
    n, ids = clean.count(), written(ordered_ids(clean.select(F.explode(F.array("a", "b")).alias("node"))))
    clean = spread(spread(clean, n, "a").join(ids.toDF("a", "x"), "a"), n, "b").join(ids.toDF("b", "y"), "b")
    links = written(clean.select(ends.alias("e"), "w").select("e.*", "w"))  # loops twice
    return named(_communities(links, _degrees(links), resolution, tolerance, max_turns, max_levels), ids)


def louvain_of_groups(groups: DataFrame, resolution: float = 1.0, tolerance: float = 0.01, max_turns: int = 12, max_levels: int = 12) -> DataFrame:
    """louvain() where the weight of two nodes is how many of groups(items) hold both; items are arrays of distinct whole numbers from 0 on. Pairs are made inside the blocks
    only, from a row for each item with its group's array."""
    links = groups.where("size(items) > 1").select(F.explode("items").alias("node"), "items")
    met = links.select("node", (F.size("items") - 1).cast("long").alias("n"))
    per = written(spread(met, met.count(), "node").groupBy("node").agg(F.sum("n").cast("double").alias("degree"), F.sum("n").alias("n")))
    return _communities(links, per, resolution, tolerance, max_turns, max_levels)


def _degrees(links: DataFrame) -> DataFrame:
    return written(spread(links, links.count(), "node").groupBy("node").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("n")))


def _communities(links: DataFrame, per: DataFrame, resolution: float, tolerance: float, max_turns: int, max_levels: int) -> DataFrame:
    total, names, before = per.agg(F.sum("degree")).first()[0] or 0.0, None, None
    for step in range(max_levels + 1):
        per = per if names is None else _degrees(links)
        quality = _quality(links, per, total, resolution)
        if names is None:
            names = per.select("node", F.col("node").alias("community"))
        elif quality <= before:
            break
        else:
            names = written(names.join(to.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")))
        if step == max_levels:
            break
        level, before, idle = moving.pack(links, per), quality, 0
        state = per.select("node", "degree", F.col("node").alias("community"))
        for turn in range(max_turns):
            moves = moving.moves(level, state, total, resolution, step * max_turns + turn)
            state = written(state.join(moves, "node", "left").select("node", "degree", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")))
            idle = idle + 1 if state.where("moved").count() <= tolerance * level.nodes else 0
            state = state.drop("moved")
            if idle >= 2 and turn % 2:
                break
        # named by the smallest node of each community
        to = written(state.join(state.groupBy("community").agg(F.min("node").alias("to")), "community").select("node", F.col("to").alias("community")))
        links = moving.merged(level, to)
    return names


def named(communities: DataFrame, ids: DataFrame) -> DataFrame:
    """communities(node, community) of numbers by their names ids(node, id)."""
    out = communities.join(ids.toDF("_name", "node"), "node").select(F.col("_name").alias("node"), "community")
    return out.join(ids.toDF("_name", "community"), "community").select("node", F.col("_name").alias("community"))


def _quality(links: DataFrame, per: DataFrame, total: float, resolution: float) -> float:
    """Modularity where each node of per(node, degree) is a community of its own."""
    inside = 0.0 if "items" in links.columns else links.where("node = other").agg(F.sum("w")).first()[0] or 0.0
    squares = per.agg(F.sum(F.col("degree") * F.col("degree"))).first()[0] or 0.0
    return inside / total - resolution * squares / (total * total) if total else 0.0


def absorbed(clusters: DataFrame, edges: DataFrame, least: int = 5, max_rounds: int = 30) -> DataFrame:
    """(node, community) of clusters(node, community), nodes being paths, once those of fewer than `least` nodes have joined others.

    A small cluster joins the one with most edge weight to it, then the one with the deepest folder shared, then the larger,
    then the smaller name. In a round those move that are smaller than a small target and whose target stays; after it all is weighed anew. Folders meet by
    their prefixes, so no files are compared pair by pair. community becomes the smallest node."""
    now = written(clusters.select("node", "community"))
    for _ in range(max_rounds):
        sizes = written(now.groupBy("community").agg(F.count(F.lit(1)).alias("size")))
        small = sizes.where(F.col("size") < least)
        if small.isEmpty() or sizes.limit(2).count() < 2:
            break
        c = now.select("node", "community")
        e = edges.join(c.toDF("a", "x"), "a").join(c.toDF("b", "y"), "b").where("x <> y")
        both = e.select(F.col("x").alias("community"), F.col("y").alias("to"), "weight").union(e.select(F.col("y").alias("community"), F.col("x").alias("to"), "weight"))
        weight = both.join(small.select("community"), "community", "left_semi").groupBy("community", "to").agg(F.sum("weight").alias("weight"))
        folders = F.slice(F.split("node", "/"), F.lit(1), F.size(F.split("node", "/")) - 1)
        prefix = F.transform(F.sequence(F.lit(1), F.size("f")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("f", F.lit(1), n), "/").alias("prefix")))
        deep = now.withColumn("f", folders).where("size(f) > 0").select("community", F.explode(prefix).alias("p")).select("community", "p.*").distinct()
        depth = deep.join(small.select("community"), "community", "left_semi").join(deep.select(F.col("community").alias("to"), "prefix"), "prefix").where("community <> to").groupBy("community", "to").agg(F.max("depth").alias("depth"))
        largest = sizes.orderBy(F.col("size").desc(), "community").limit(2).select(F.col("community").alias("to"))
        # where nothing is shared the largest is a choice too; two, as one may be the cluster itself
        some = small.select("community").crossJoin(F.broadcast(largest)).where("community <> to")  # two rows on the right
        pairs = weight.join(depth, ["community", "to"], "full_outer").join(some.withColumn("any", F.lit(1)), ["community", "to"], "full_outer")
        told = pairs.join(sizes.toDF("to", "to_size"), "to").join(small, "community")
        best = told.groupBy("community", "size").agg(F.min(F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), (-F.coalesce("depth", F.lit(0))).alias("d"), (-F.col("to_size")).alias("s"), "to", "to_size")).alias("m"))
        moves = best.select("community", "size", "m.to", "m.to_size").where((F.col("to_size") >= least) | (F.struct("size", "community") < F.struct(F.col("to_size").alias("size"), F.col("to").alias("community"))))
        moves = written(moves)
        moves = moves.join(moves.select(F.col("community").alias("to")), "to", "left_anti").select("community", "to")
        now = written(now.join(moves, "community", "left").select("node", F.coalesce("to", "community").alias("community")))
    else:
        raise RuntimeError(f"clusters were not absorbed in {max_rounds} rounds")
    first = now.groupBy("community").agg(F.min("node").alias("first"))
    return now.join(first, "community").select("node", F.col("first").alias("community"))


def numbered(clusters: DataFrame) -> DataFrame:
    """(community, id, size): clusters(node, community) as c01, c02, ... by size, then smallest node. There are few clusters."""
    per = clusters.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    n = per.withColumn("n", F.row_number().over(W.orderBy(F.col("size").desc(), "first"))).withColumn("all", F.count(F.lit(1)).over(W.partitionBy()))
    return n.select("community", F.concat(F.lit("c"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(2), F.length(F.col("all").cast("string"))), F.lit("0"))).alias("id"), "size")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of communities(node, community) on edges(a, b, weight)."""
    c = communities.select("node", "community")
    e = edges.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b")
    inside = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("within"))
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inside.crossJoin(ends).select((F.col("within") / F.col("m") - resolution * F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def entry_points(edges: DataFrame) -> DataFrame:
    """(node) that imports something and that nothing imports, from edges(src, dst)."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
