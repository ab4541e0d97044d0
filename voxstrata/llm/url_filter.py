"""URL filter [native]: blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed canonical URL is ``host/path-prefix`` with a verdict; it fits its host,
all subdomains, and every path that starts with its own; the longest fit wins.
A page's candidates are its host's suffixes joined with its path's prefixes (of as
many labels, and of the lengths, that the list has).  They are made once for each
host and path, however many pages have it.  A blocked Bloom filter of the list, one 64-bit
word a block and ``probes`` bits in it, drops nearly all candidates that aren't
listed; the exact join removes the false positives that remain.

The filter is broadcast only as its number of blocks is a bounded parameter; the
list itself is joined by hash or sort as its size asks.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits nothing; repeated rows each give a row; a null or repeated rule counts once
(the smallest verdict if they differ); an empty list leaves the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import written

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, probes: int) -> Column:
    mask = F.lit(0).cast("long")
    for k in range(probes):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({k}, __key), 64) as int))"))
    return mask


def blocked_bloom(keys: DataFrame, blocks: int, probes: int) -> DataFrame:
    """(block, word) of a one-column DataFrame `__key`: at most `blocks` rows of 16 bytes."""
    return keys.select(_block(F.col("__key"), blocks).alias("__block"), _mask(F.col("__key"), probes).alias("__word")).groupBy("__block").agg(F.bit_or("__word").alias("__word"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", blocks: int = 65_536, probes: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    rules: columns rule (``host/path-prefix``) and verdict.
    """
    listed = (
        rules.where(F.col("rule").isNotNull() & (F.instr("rule", "/") > 0))
        .groupBy(ascii_lower(F.substring_index("rule", "/", 1)).alias("__h"), F.expr("substring(rule, instr(rule, '/'))").alias("__p"))
        .agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict"))
        .select(F.concat("__h", "__p").alias("__key"), "rule", "verdict", F.length(F.concat("__h", "__p")).alias("__len"), F.length("__p").alias("__plen"))
    )
    # one row: the distinct prefix lengths of the list, bounded by the longest url, and its hosts' most labels
    bounds = listed.agg(F.sort_array(F.collect_set("__plen")).alias("l"), F.max(F.size(F.split(F.substring_index("__key", "/", 1), r"\."))).alias("labels")).first()
    lengths, most = bounds["l"] or [], bounds["labels"] or 1
    host, path = split_url(F.col(url))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.filter(F.array(*[F.when(F.length("path") >= n, F.expr(f"substring(path, 1, {n})")) for n in lengths]).cast("array<string>"), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    candidates = base.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(keys)).alias("__key"))
    bloom = blocked_bloom(listed.select("__key"), blocks, probes)
    possible = (
        candidates.withColumn("__block", _block(F.col("__key"), blocks))
        .join(F.broadcast(bloom), "__block")
        .where(F.col("__word").bitwiseAND(_mask(F.col("__key"), probes)) == _mask(F.col("__key"), probes))
        .select("host", "path", "__key")
    )
    hits = possible.join(listed, "__key").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("__len", "__key")).alias("__hit"))
    # written on its own: the pages of a host and path that very many have can then be split among tasks in the join
    hits = written(hits, "hits")
    return base.join(hits, ["host", "path"], "left").select("page_id", "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))


#: The query's rules.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def query(spark, sf_dir):
    from voxstrata.llm.common import table

    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rule, verdict, h, q) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
