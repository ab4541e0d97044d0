"""Links and connected components with DataFrame operations only.

``components`` contracts a graph: each node moves to the neighbour, itself
included, of the smallest hash; edges follow, and rounds go on until none is
left.  Hashes make the order random, so a chain shrinks by a constant factor a
round whatever its ids.  Each round is written to the shared folder.

``block_links`` finds all links among rows that share a block key without
emitting all pairs of a block: first every member against its block's leader;
then, by the components that these links give, only those pairs of members that
aren't connected yet.  A pair that's already connected can add nothing to the
components.  Where rows have sketches, these rule pairs out before they are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import written

#: A side of at most so many bytes, by its counted rows and its columns' types, is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
_WIDTHS = {"bigint": 8, "int": 4, "double": 8, "boolean": 1}


#: Members of a block that one task's key holds in the search for links between members.
CHUNK = 1000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if its counted rows are few for their width.  Its columns are numbers, digests and the like."""
    width = 16 + sum(_WIDTHS.get(kind, 32) for _, kind in df.dtypes)
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the smallest node that links reach."""
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kind = links.schema["a"].dataType.simpleString()
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        move = both.groupBy("a").agg(F.min(best("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", best("a"))["v"].alias("to"))
        moves.append(move := written(move, "moves"))
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = written(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    # from the last round to the first: a round's nodes, which get fewer by the round, are placed once, and not all nodes in every round
    at = moves[-1]
    for move in reversed(moves[:-1]):
        at = move.join(at.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    at = written(at, "roots")
    # written on its own: a large component's rows can then be split among tasks in the join
    least = written(at.groupBy("to").agg(F.min("node").alias("component")), "least")
    return written(at.join(sized(least, least.count()), "to").select("node", "component"), "components")


def block_links(blocks: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column], prepare: Callable[[DataFrame], None] | None = None, sketch: Callable[[DataFrame], DataFrame] | None = None, near: Callable[[str, str], Column] | None = None, most: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect whatever verified pairs within blocks connect.

    blocks: key, node, rank (the leader has the smallest) and more columns; fits(x, y) is a cheap condition on a pair's
    rows, given the prefixes of their columns; verify(pairs (a, b)), called at most twice, keeps the links.
    prepare gets the nodes that share a key first.  In blocks of more than `most` members that their leader doesn't
    connect, sketch(nodes) gives further columns by node, by which near(x, y), a condition that all links meet, rules
    pairs out before they are made.
    """
    rest = [c for c in blocks.columns if c != "key"]
    side = lambda p: [F.col(c).alias(p + c) for c in rest]
    # most keys have one row: they are told by a narrow count before any row is moved
    keys = written(blocks.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "keys")
    shared = written(blocks.join(sized(keys, keys.count()), "key"), "shared")
    if prepare:
        prepare(shared.select("node").distinct())
    leaders = shared.groupBy("key").agg(F.min(F.struct("rank", "node", *[c for c in rest if c not in ("rank", "node")])).alias("l"))
    held = written(shared.select("key", "size", *side("x_")).join(leaders.select("key", *[F.col(f"l.{c}").alias("l_" + c) for c in rest]), "key"), "blocks")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = held.where((F.col("x_node") != F.col("l_node")) & fits("x_", "l_")).select(*pair("x_node", "l_node")).distinct()
    links = written(verify(written(first, "pairs")), "links")
    found = components(links)
    n = found.count()
    of = lambda name: sized(found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c")), n)
    placed = held.join(of("x_node"), "x_node", "left").join(of("l_node"), "l_node", "left")
    placed = placed.withColumns({f"{p}_node_c": F.coalesce(f"{p}_node_c", f"{p}_node") for p in ("x", "l")}).withColumn("x_led", F.col("x_node_c") == F.col("l_node_c"))
    # blocks that their leader connects are done
    open_keys = placed.where("not x_led").groupBy("key").agg(F.max("size").alias("most")).select("key", F.ceil(F.col("most") / chunk).cast("int").alias("parts"))
    open_keys = written(open_keys, "open")
    if open_keys.isEmpty():
        return links
    placed = placed.join(sized(open_keys, open_keys.count()), "key").select("key", "size", "parts", *[f"x_{c}" for c in rest], "x_node_c", "x_led")
    told = []
    if sketch:
        placed = written(placed, "open-blocks")
        sketches = sketch(placed.where(F.col("size") > most).select(F.col("x_node").alias("node")).distinct())
        told = [c for c in sketches.columns if c != "node"]
        placed = placed.join(sketches.select(F.col("node").alias("x_node"), *[F.col(c).alias("x_" + c) for c in told]), "x_node", "left")
    placed = written(placed, "open-blocks")
    # a large block's members are dealt to parts, each of which the open ones meet on its own: no task holds a block
    y = placed.select("key", F.pmod(F.xxhash64("x_node"), "parts").cast("int").alias("part"), *[F.col(f"x_{c}").alias(f"y_{c}") for c in [*rest, *told]], F.col("x_node_c").alias("y_node_c"), F.col("x_led").alias("y_led"))
    x = placed.where("not x_led").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "x_led")
    alike = (F.col("size") <= most) | near("x_", "y_") if sketch else F.lit(True)
    second = x.join(y, ["key", "part"]).where((F.col("x_node_c") != F.col("y_node_c")) & (F.col("y_led") | (F.col("x_node") < F.col("y_node"))) & fits("x_", "y_") & alike)
    more = verify(written(second.select(*pair("x_node", "y_node")).distinct(), "pairs"))
    return written(links.unionByName(more), "links")


def nodes_of(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The distinct nodes of pairs (a, b), and their number."""
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    return nodes, nodes.count()
