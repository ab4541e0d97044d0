"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Queries and candidates are cut into groups; each pair of groups meets in one task,
which holds a query group's vectors and gets the candidates block by block.  Every
block of at most ``block_rows`` vectors has a cover tree.  A node of level i covers its
points within 2 ** i of its centre; its children are nodes of a lower level j whose
centres are more than 2 ** j apart, and its own centre is one of them.  Levels at which
nothing would change are skipped; points that are alone on their level are kept as
rows of their parent.  The trees are walked together.  A pair of nodes is dropped when
no inner product in it can reach the worst kth score that its queries have so far:

    q . p <= cq . cp + |cq| rp + |cp| rq + rq rp

for centres c and radii r, the distances of the farthest points.  The children of a
candidate node are bounded all at once, for a query node or for its single rows.

The k best of each group pair are merged by a window per query.  Neither side
passes the driver or a broadcast: blocks of packed vectors are shuffled, each to the
groups of the other side, whose numbers follow from the counted bytes.

Vectors far apart from each other in all directions, as random ones of many
dimensions, are single rows below the root: there the bound is the score itself, and
nothing can be dropped.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows with a null id; only vectors of equal length
are compared; a query's own row is told by its id; repeated ids are rows of their
own, and all of them are left out for the query of that id; a query id that repeats
has the k best of its rows' results together; ties go to the
smaller id, fewer than k candidates give fewer rows; empty tables give no rows; other
columns are ignored.  Scores are exact as far as a double holds whole numbers, 2 ** 53.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.llm.common import written

#: A node of so few points isn't divided further; rows that the greedy net looks at together.
LEAF, STEP = 8, 512


@dataclass
class Node:
    centre: np.ndarray
    level: int
    radius: float  # of its points about the centre
    rows: np.ndarray  # of all points
    own: np.ndarray  # of the points that are no node
    children: list["Node"] = field(default_factory=list)

    def close(self, x: np.ndarray) -> "Node":
        """Centres, norms and radii of the own points and the children, side by side."""
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.parts = np.concatenate([x[self.own], *[c.centre[None] for c in self.children]]) if self.children else x[self.own]
        self.radii = np.array([0.0] * len(self.own) + [c.radius for c in self.children])
        self.norms = np.sqrt((self.parts**2).sum(1))
        return self


def net(x: np.ndarray, sq: np.ndarray, rows: np.ndarray, reach: float) -> list[np.ndarray]:
    """Greedy net: groups of rows within reach of their first one, the first ones more than reach apart."""
    centres = np.empty(0, np.int64)
    groups: list[list[np.ndarray]] = []
    far = reach * reach
    for at in range(0, len(rows), STEP):
        part = rows[at : at + STEP]
        if len(centres):
            d = sq[part][:, None] + sq[centres] - 2 * (x[part] @ x[centres].T)
            near = d.argmin(1)
            covered = d[np.arange(len(part)), near] <= far
            for k in np.unique(near[covered]):
                groups[k].append(part[covered & (near == k)])
            part = part[~covered]
        d = sq[part][:, None] + sq[part] - 2 * (x[part] @ x[part].T)
        free = np.ones(len(part), bool)
        new = []
        for k in range(len(part)):
            if free[k]:
                mine = free & (d[k] <= far)
                mine[k] = True
                free &= ~mine
                new.append(part[k])
                groups.append([part[k : k + 1], part[mine & (np.arange(len(part)) != k)]])
        centres = np.concatenate([centres, np.array(new, np.int64)])
    return [np.concatenate(g) for g in groups]


def build(x: np.ndarray, rows: np.ndarray | None = None, sq: np.ndarray | None = None) -> Node:
    """Cover tree of the rows of x, about the first of them."""
    rows = np.arange(len(x)) if rows is None else rows
    sq = (x**2).sum(1) if sq is None else sq
    c = x[rows[0]]
    d = np.sqrt(np.maximum(((x[rows] - c) ** 2).sum(1), 0))
    radius = float(d.max())
    level = int(np.ceil(np.log2(radius))) if radius > 0 else -1
    if len(rows) <= LEAF or radius == 0:
        return Node(c, level, radius, rows, rows).close(x)
    # the centre's own group is what lies within the next level of it; a level is skipped while that is all
    low = level - 1
    while len(groups := net(x, sq, rows, 2.0**low)) == 1:
        low -= 1
    node = Node(c, level, radius, rows, np.array([g[0] for g in groups if len(g) == 1], np.int64))
    node.children = [build(x, g, sq) for g in groups if len(g) > 1]
    return node.close(x)


class Best:
    """The k best (score, id) of each query of a block, and how many inner products that took."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.products = ids, k, 0
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return self.score[rows, -1]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.ids[rows][:, None] == ids[None, :], -np.inf, scores)
        if scores.shape[1] > self.k:  # all that tie with the kth stay in
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            use = (scores >= np.maximum(kth, self.score[rows, -1])[:, None]).any(0)
            scores, ids = scores[:, use], ids[use]
        s = np.concatenate([self.score[rows], scores], 1)
        f = np.concatenate([self.found[rows], np.broadcast_to(ids, scores.shape)], 1)
        o = np.lexsort((f, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, o, 1)
        self.found[rows] = np.where(np.isneginf(self.score[rows]), np.iinfo(np.int64).max, np.take_along_axis(f, o, 1))


#: What rounding may take off a bound.
_SLACK = 1e-9


def search(q: Node, qx: np.ndarray, p: Node, px: np.ndarray, pids: np.ndarray, best: Best) -> None:
    """Walks two trees together; queries that are single rows take candidate nodes on their own."""
    lone: list[tuple[np.ndarray, Node]] = []
    pairs = [(q, p)]
    while pairs or lone:
        if lone:  # first, as these make the bounds tight
            rows, b = lone.pop()
            x = qx[rows]
            best.products += len(rows) * len(b.parts)
            s = x @ b.parts.T
            bound = s + np.sqrt((x**2).sum(1))[:, None] * b.radii * (1 + _SLACK) + 1e-6
            if n := len(b.own):
                best.offer(rows, s[:, :n], pids[b.own])
            hit = bound[:, n:] >= best.worst(rows)[:, None]
            for k in np.argsort(bound[:, n:].max(0)) if hit.any() else ():  # the most promising is taken first
                if hit[:, k].any():
                    lone.append((rows[hit[:, k]], b.children[k]))
            continue
        a, b = pairs.pop()
        worst = best.worst(a.rows).min()
        best.products += 1
        if a.centre @ b.centre + (a.norm * b.radius + b.norm * a.radius + a.radius * b.radius) * (1 + _SLACK) + 1e-6 < worst:
            continue
        lone += [(a.own[at : at + 256], b) for at in range(0, len(a.own), 256)]
        if a.children:
            pairs += _meet(a, b, best)


def _meet(a: Node, b: Node, best: Best) -> list[tuple[Node, Node]]:
    """Pairs of the children of a with b; or, where a's bound leaves only few children of b, with these."""
    best.products += len(b.parts)
    bound = b.parts @ a.centre + (a.norm * b.radii + b.norms * a.radius + a.radius * b.radii) * (1 + _SLACK) + 1e-6
    left = bound >= best.worst(a.rows).min()
    n = len(b.own)
    if left[:n].any() or left.sum() > 8:
        return [(c, b) for c in a.children]
    return [(c, b.children[k]) for k in np.nonzero(left[n:])[0] for c in a.children]


def _matrix(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.int64).reshape(-1, dim).astype(np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, block_rows: int = 4096, group_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(scale * component) vectors."""
    spark = vectors.sparkSession

    def usable(df):
        e = F.transform(F.col(embedding), lambda v: v.cast("double"))
        fine = F.col(vec_id).isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.where(fine).select(F.col(vec_id).cast("long").alias("id"), F.transform(e, lambda v: F.floor(v * scale)).alias("v"))

    def packed(batches):
        """Blocks of vectors of one length, as bytes."""
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            ids, vs = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vs)], pa.binary())], ["dim", "n", "ids", "vs"])

        for b in batches:
            v = b.column(1)
            flat, ends = v.values.to_numpy(zero_copy_only=False).astype(np.int64), v.offsets.to_numpy()
            for i, one in enumerate(b.column(0).to_pylist()):
                part = flat[ends[i] : ends[i + 1]]
                ids, vs = held.setdefault(len(part), ([], []))
                ids.append(one)
                vs.append(part.tobytes())
                if len(ids) >= block_rows:
                    yield block(len(part))
        for dim in list(held):
            yield block(dim)

    schema = "dim int, n long, ids binary, vs binary"
    blocks = [written(usable(df).mapInArrow(packed, schema), "blocks") for df in (queries, vectors)]
    sizes = [b.agg(F.sum(F.length("vs")).alias("bytes"), F.count("*").alias("n")).first() for b in blocks]
    if not all(s.n for s in sizes):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a task holds a group of queries; the other side has as many groups as keep the cluster busy
    groups = [max(1, -(-s.bytes // group_bytes)) for s in sizes]
    groups[1] = min(sizes[1].n, max(groups[1], -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups[0])))
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = blocks[0].select(own(groups[0]).alias("g"), every(groups[1]).alias("h"), F.lit(0).alias("side"), "dim", "ids", "vs")
    p = blocks[1].select(every(groups[0]).alias("g"), own(groups[1]).alias("h"), F.lit(1).alias("side"), "dim", "ids", "vs")
    met = q.unionByName(p).repartition(groups[0] * groups[1], "g", "h").sortWithinPartitions("g", "h", "side")

    def results(held):
        for _, _, _, best in held:
            i, j = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[i], pa.int64()), pa.array(best.found[i, j], pa.int64()), pa.array(best.score[i, j].astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])

    def run(batches):
        cell, held = None, []
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if cell != (r["g"], r["h"]):
                    yield from results(held)
                    cell, held = (r["g"], r["h"]), []
                x, ids = _matrix([r["vs"]], r["dim"]), np.frombuffer(r["ids"], np.int64)
                if not r["side"]:
                    held.append((r["dim"], x, build(x), Best(ids, k)))
                elif any(t[0] == r["dim"] for t in held):
                    tree = build(x)
                    for d, qx, q, best in held:
                        if d == r["dim"]:
                            search(q, qx, tree, x, ids, best)
        yield from results(held)

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir) -> DataFrame:
    from voxstrata.llm.common import table

    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND len(q.e) = len(p.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
"""
