"""Trees and graphs: nodes (id, parent, ...) with parent -1 at a root, and undirected edges (u, v).

Paths are walked by pointer doubling: after k rounds every node knows its ancestor
2^k steps up, so a tree of depth d takes log2(d) joins, however many trees there
are.  A parent id that isn't there makes its child a root.  A cycle of parents is no
tree: where a walk takes more rounds than any tree of so many nodes could, it raises
ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.functions.boxes import AXES, all_of, half_open
from voxstrata.functions.ranked import best_of
from voxstrata.functions.shared import materialised
from voxstrata.operators.cc import graph_components


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent) with -1 for parents that don't exist.  Nodes aren't broadcast, however small two columns of them seem."""
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known")).hint("merge")
    return nodes.select("id", "parent").join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).otherwise(F.lit(-1)).cast("int").alias("parent"))


def roots(nodes: DataFrame) -> DataFrame:
    return parents(nodes).where("parent = -1").select("id")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.select("id").join(nodes.select(F.col("parent").alias("id")).distinct().hint("merge"), "id", "left_anti")


def branch_points(nodes: DataFrame) -> DataFrame:
    """id, children of nodes with more than one child."""
    return nodes.where("parent <> -1").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children")).where("children > 1")


def compartments(nodes: DataFrame) -> DataFrame:
    """(parent, child) pairs of existing nodes."""
    return parents(nodes).where("parent <> -1").select("parent", F.col("id").alias("child"))


def _rounds(df: DataFrame):
    """Counts rounds of doubling; raises where they are more than a tree of all the rows can take."""
    for k in range(df.count().bit_length() + 2):
        yield k
    raise ValueError("parents form a cycle")


def jumps(nodes: DataFrame):
    """Yields (id, up) where up is the ancestor 1, 2, 4, ... steps above, -1 past the root; stops when all are past it."""
    up = materialised(parents(nodes).withColumnRenamed("parent", "up"), "jump")
    for _ in _rounds(up):
        yield up
        if up.where("up <> -1").isEmpty():
            return
        above = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
        up = materialised(up.join(above, "up", "left").select("id", F.coalesce("next", F.lit(-1)).cast("int").alias("up")), "jump")


def nearest_above(nodes: DataFrame, stop) -> DataFrame:
    """id, at, steps: the first of a node and its ancestors where the column stop is true, or else the root."""
    own = nodes.select("id", F.coalesce(stop, F.lit(False)).alias("stop")).join(parents(nodes), "id")
    here = F.col("stop") | (F.col("parent") == -1)
    state = materialised(own.select("id", F.when(here, F.col("id")).otherwise(F.col("parent")).alias("at"), (~here).cast("int").alias("steps")), "roots")
    for _ in _rounds(state):
        above = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        new = materialised(state.join(above, "at").select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "roots")
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state


def root_depth(nodes: DataFrame) -> DataFrame:
    """id, root, depth (0 at the root) of every node."""
    return nearest_above(nodes, F.lit(False)).select("id", F.col("at").alias("root"), F.col("steps").alias("depth"))


def ancestors(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id, steps of every ancestor of seeds (column id), themselves included."""
    found = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("steps"))
    step = 1
    for up in jumps(nodes):
        higher = found.join(up, "id").where("up <> -1").select("seed", F.col("up").alias("id"), (F.col("steps") + step).alias("steps"))
        found = found.unionByName(materialised(higher, "ancestors"))  # what was found before isn't written again
        step *= 2
    return found


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """id, size: nodes in the subtree, itself included.

    S(2n) of a node is S(n) plus S(n) of the nodes n steps below, S(n) counting those fewer than n steps below."""
    size = materialised(nodes.select("id", F.lit(1).cast("long").alias("size")), "sizes")
    for up in jumps(nodes):
        below = up.where("up <> -1").join(size, "id").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        size = materialised(size.join(below, "id", "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    return size


def bfs(nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, id, depth of the nodes at most `depth` levels below seeds (column id)."""
    kids = compartments(nodes)
    front = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    out = front
    for k in range(1, depth + 1):
        front = front.join(kids.withColumnRenamed("parent", "id"), "id").select("seed", F.col("child").alias("id"), F.lit(k).alias("depth"))
        out = out.unionByName(front)
    return out


def split_branches(nodes: DataFrame, tree: str, least: int) -> DataFrame:
    """id, parent, root: every child of a branch point becomes a root; trees and parts of fewer than `least` nodes are dropped."""
    big = nodes.groupBy(tree).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(tree)
    kept = nodes.join(big, tree, "left_semi")
    cut = kept.join(branch_points(kept).select(F.col("id").alias("parent"), F.lit(True).alias("cut")), "parent", "left")
    cut = cut.select("id", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("parent")).cast("int").alias("parent"))
    placed = cut.join(root_depth(cut).select("id", "root"), "id")
    size = placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("root")
    return placed.join(size, "root", "left_semi").select("id", "parent", "root")


def prune_twigs(nodes: DataFrame, least: int) -> DataFrame:
    """id, parent of what is left when the subtrees of fewer than `least` nodes that hang on branch points are taken off."""
    sizes = subtree_sizes(nodes)
    twig = nodes.select("id", "parent").join(branch_points(nodes).select(F.col("id").alias("parent")), "parent", "left_semi").join(sizes, "id").where(F.col("size") < least).select("id")
    gone = ancestors_of_any(nodes, twig)
    return nodes.select("id", "parent").join(gone, "id", "left_anti")


def ancestors_of_any(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """ids of nodes with a marked ancestor or that are marked: marks spread down by doubling."""
    mark = materialised(nodes.select("id").join(marked.select("id", F.lit(True).alias("on")).distinct(), "id", "left").select("id", F.coalesce("on", F.lit(False)).alias("on")), "marks")
    for up in jumps(nodes):
        above = mark.select(F.col("id").alias("up"), F.col("on").alias("over"))
        mark = materialised(mark.join(up, "id").join(above, "up", "left").select("id", (F.col("on") | F.coalesce("over", F.lit(False))).alias("on")), "marks")
    return mark.where("on").select("id")


def dfs_renumber(nodes: DataFrame, tree: str) -> DataFrame:
    """id, new_id, new_parent: pre-order numbers, 1.. in each tree, children by id.

    A node's number is 1 plus, along its path to the root, one per step and the sizes of earlier siblings' subtrees."""
    sizes = subtree_sizes(nodes)
    p = parents(nodes).join(sizes, "id")
    older = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    offs = p.where("parent <> -1").withColumn("off", 1 + F.coalesce(F.sum("size").over(older), F.lit(0))).select("id", "off")
    sums = materialised(nodes.select("id").join(offs, "id", "left").select("id", F.coalesce("off", F.lit(0)).alias("s")), "offsets")
    for up in jumps(nodes):
        above = sums.select(F.col("id").alias("up"), F.col("s").alias("t"))
        sums = materialised(sums.join(up, "id").join(above, "up", "left").select("id", (F.col("s") + F.coalesce("t", F.lit(0))).alias("s")), "offsets")
    number = sums.select("id", (F.col("s") + 1).cast("int").alias("new_id"))
    return parents(nodes).join(number, "id").join(number.select(F.col("id").alias("parent"), F.col("new_id").alias("new_parent")), "parent", "left").select("id", "new_id", F.coalesce("new_parent", F.lit(-1)).alias("new_parent"))


def reroot(nodes: DataFrame, new_root: int) -> DataFrame:
    """id, parent with the path from new_root to its old root turned round; other nodes stay."""
    seed = nodes.where(F.col("id") == new_root).select("id")
    path = ancestors(nodes, seed).select("id", "steps")
    turned = path.join(path.select((F.col("steps") + 1).alias("steps"), F.col("id").alias("below")), "steps", "left").select("id", F.coalesce("below", F.lit(-1)).cast("int").alias("new"))
    return nodes.select("id", "parent").join(turned, "id", "left").select("id", F.coalesce("new", "parent").alias("parent"))


def connect(nodes: DataFrame, a: int, b: int) -> DataFrame:
    """id, parent with the tree of b turned so that b is its root, and hung on a; unchanged where both are of one tree, as that would be a loop."""
    tops = nearest_above(nodes, F.lit(False)).where(F.col("id").isin(a, b)).select("id", "at").collect()  # two rows
    if len(tops) < 2 or tops[0]["at"] == tops[1]["at"]:
        return nodes.select("id", "parent")
    return reroot(nodes, b).select("id", F.when(F.col("id") == b, F.lit(a)).otherwise(F.col("parent")).cast("int").alias("parent"))


def concat(nodes: DataFrame, file: str) -> DataFrame:
    """file, id, new_id, new_parent: files in order, each one's ids moved behind those before; roots keep -1.

    The running sum is taken within ranges of files, and over one row a range."""
    spark = nodes.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = nodes.groupBy(file).agg(F.count("*").alias("n"), F.min("id").alias("low"))
    sizes = materialised(sizes.repartitionByRange(ranges, file).withColumn("range", F.spark_partition_id()), "ranges")
    sums = sizes.groupBy("range").agg(F.sum("n").alias("held"))
    ahead = sums.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("range").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.join(F.broadcast(ahead), "range").withColumn("off", F.col("ahead") + F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low") + 1)
    moved = lambda c: (F.col(c) + F.col("off")).cast("int")
    return nodes.join(offs.select(file, "off"), file).select(file, "id", moved("id").alias("new_id"), F.when(F.col("parent") == -1, F.lit(-1)).otherwise(moved("parent")).alias("new_parent"))


def cable_length(nodes: DataFrame, tree: str) -> DataFrame:
    """tree, length: sum of the distances of nodes to their parents."""
    up = nodes.select(F.col("id").alias("parent"), *[F.col(a).alias(f"p_{a}") for a in AXES])
    d = F.sqrt(sum([(F.col(a) - F.col(f"p_{a}")) * (F.col(a) - F.col(f"p_{a}")) for a in AXES], F.lit(0)))
    return nodes.join(up, "parent", "left").groupBy(tree).agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("length"))


def break_branches(nodes: DataFrame, tree: str, least: int) -> DataFrame:
    """tree, fragment (its smallest node), n, largest: parts of a skeleton when nodes of more than two edges are taken out.

    Parts of fewer than `least` nodes are dropped; a skeleton without branches stays whole; nodes left without an edge go.
    The largest part keeps the skeleton's id, ties to the smaller node."""
    edges = compartments(nodes).select(F.col("parent").alias("u"), F.col("child").alias("v"))
    degree = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    branch = degree.where("d > 2").select("id")
    kept = edges.join(branch.withColumnRenamed("id", "u"), "u", "left_anti").join(branch.withColumnRenamed("id", "v"), "v", "left_anti")
    parts = graph_components(kept.select(F.col("u").alias("a"), F.col("v").alias("b"))).join(nodes.select(F.col("id").alias("node"), tree), "node")
    sized = parts.groupBy(tree, F.col("component").alias("fragment")).agg(F.count("*").alias("n"))
    whole = nodes.select(tree, "id").join(branch, "id", "left_semi").select(tree).distinct()
    best = sized.groupBy(tree).agg(F.max_by("fragment", F.struct("n", -F.col("fragment"))).alias("first"))
    cut = sized.join(whole, tree, "left_semi").where(F.col("n") >= least)
    alone = nodes.join(whole, tree, "left_anti").groupBy(tree).agg(F.min("id").alias("fragment"), F.count("*").alias("n"))
    return cut.unionByName(alone).join(best, tree, "left").select(tree, "fragment", "n", (F.coalesce("first", "fragment") == F.col("fragment")).alias("largest"))


def crop(nodes: DataFrame, edges: DataFrame, lo, hi) -> tuple[DataFrame, DataFrame]:
    """Nodes in the half-open box and those beyond that an edge ties to it (dangling true); edges with an end inside."""
    inner = nodes.where(half_open(lo, hi))
    ends = inner.select("id")
    touching = edges.join(ends.withColumnRenamed("id", "u"), "u", "left_semi").unionByName(edges.join(ends.withColumnRenamed("id", "v"), "v", "left_semi")).distinct()
    out = touching.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(ends, "id", "left_anti")
    return inner.withColumn("dangling", F.lit(False)).unionByName(nodes.join(out, "id", "left_semi").withColumn("dangling", F.lit(True))), touching


def trim(nodes: DataFrame, edges: DataFrame, lo, hi) -> DataFrame:
    """u, v, x, y, z: for each edge that leaves the half-open box, where it crosses its face; u lies inside."""
    at = lambda p, k: nodes.select(F.col("id").alias(k), *[F.col(a).cast("double").alias(f"{p}{a}") for a in AXES])
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(at("a", "u"), "u").join(at("b", "v"), "v")
    box = lambda p: all_of((F.col(p + a) >= low) & (F.col(p + a) < high) for a, low, high in zip(AXES, lo, hi))
    cross = both.where(box("a") & ~box("b"))
    share = [F.when(F.col(f"b{a}") < low, (low - F.col(f"a{a}")) / (F.col(f"b{a}") - F.col(f"a{a}"))).when(F.col(f"b{a}") >= high, (high - F.col(f"a{a}")) / (F.col(f"b{a}") - F.col(f"a{a}"))).otherwise(F.lit(1.0)) for a, low, high in zip(AXES, lo, hi)]
    t = F.least(*share)
    return cross.withColumn("t", t).select("u", "v", *[(F.col(f"a{a}") + (F.col(f"b{a}") - F.col(f"a{a}")) * F.col("t")).alias(a) for a in AXES])


def dedupe_pairs(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The best pair of each left end, then of those the best of each right end; ties to the smaller other end."""
    return best_of(best_of(pairs, [left], score, right), [right], score, left)


def merge_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """component, members, n_pairs of the groups that pairs tie together."""
    e = materialised(pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b"), "ties")
    found = graph_components(e)
    n = e.join(found.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("n_pairs"))
    return found.groupBy("component").agg(F.count("*").alias("members")).join(n, "component")
