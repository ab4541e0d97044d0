"""Spatial tables derived from the driver's tables, by integer SQL that DuckDB runs as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOXELS = """SELECT x, y, z, max(v) AS v FROM (SELECT CAST(l_orderkey % 32 AS int) AS x, CAST(l_partkey % 32 AS int) AS y,
  CAST((l_linenumber * 5 + l_suppkey) % 32 AS int) AS z, CAST(floor(l_extendedprice) % 256 AS int) AS v FROM lineitem) GROUP BY x, y, z"""

NODES = """SELECT id, CASE WHEN id % 97 = 1 THEN -1 WHEN id % 11 = 0 AND id % 97 > 5 THEN id - 3 ELSE id - 1 END AS parent, tree_id, x, y, z, radius FROM
  (SELECT CAST(o_orderkey + 1 AS int) AS id, CAST(floor(o_orderkey / 97.0) AS int) AS tree_id, CAST(o_custkey % 64 AS int) AS x,
   CAST((o_orderkey + 1) % 64 AS int) AS y, CAST(floor(o_totalprice) % 64 AS int) AS z, CAST(1 + (o_orderkey + 1) % 5 AS int) AS radius FROM orders)"""

POINTS = """SELECT CAST(c_custkey AS int) AS id, CAST((c_custkey * 37) % 101 AS int) AS x, CAST((c_custkey * 53) % 103 AS int) AS y,
  CAST((c_custkey * 71) % 107 AS int) AS z, CAST(c_nationkey AS int) AS g FROM customer"""

_ALONG = ", ".join(f"({x})" for x in range(37))
#: Rods along x, six apart, of five voxels in cross-section; some are tied to the next one by a bridge, and some of those by a second one, a loop.
RODS = f"""SELECT x, CAST(6 * (k % 64) + 2 + dy AS int) AS y, CAST(6 * floor(k / 64.0) + 2 + dz AS int) AS z, k AS rod FROM
  (SELECT CAST(c_custkey AS int) AS k, 12 + c_nationkey AS last FROM customer) c JOIN (VALUES {_ALONG}) a(x) ON x <= last, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dz)
  UNION ALL SELECT x, CAST(6 * (k % 64) + 4 + dy AS int), CAST(6 * floor(k / 64.0) + 2 AS int), k FROM
  (SELECT CAST(c_custkey AS int) AS k FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 64 < 63 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)) c
  JOIN (VALUES (4), (9)) b(x) ON x = 4 OR k % 4 = 0, (VALUES (0), (1), (2)) o(dy)"""

#: Voxels of a cross-section of 32 x 32, whose depth grows with the table.
DEEP = """SELECT x, y, z, max(v) AS v FROM (SELECT CAST(l_partkey % 32 AS int) AS x, CAST((l_linenumber * 5 + l_suppkey) % 32 AS int) AS y,
  CAST(floor(l_orderkey / 64.0) AS int) AS z, CAST(floor(l_extendedprice) % 256 AS int) AS v FROM lineitem) GROUP BY x, y, z"""

#: Side of the voxel grid.
SIDE = 32

#: Side of a cube that holds the rods of 5 million customers.
ROD_SIDE = 1 << 19


def _derived(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, v: sparse voxels, a missing one is zero."""
    return _derived(spark, sf_dir, "lineitem", VOXELS)


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, v: as voxels, but with a depth along z that grows with the table."""
    return _derived(spark, sf_dir, "lineitem", DEEP)


def swc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent (-1 at a root), tree_id, x, y, z, radius."""
    return _derived(spark, sf_dir, "orders", NODES)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, g."""
    return _derived(spark, sf_dir, "customer", POINTS)


def rods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, rod: voxels of rods and bridges; their number and extent grow with the table."""
    return spark.sql(RODS.replace("FROM customer", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/customer.parquet"))
