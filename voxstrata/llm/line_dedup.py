"""Fuzzy line dedup by MinHash [native].

Equal lines are one node, keyed by their MD5.  The distinct lines' shingles of
``shingle`` characters are hashed by place and aggregated to ``bands`` x ``rows``
minima a line: minimum k is that of the hashes after an XOR with a constant of its
own.  The minima of a band make its key, and lines that share one are candidates.
Long lines have shingles enough for a share of them: of kind k, whose hashes are in a
range that holds 1 in 4 ** k.  A line has the minima of each kind that its length is in
``KINDS`` for; these lengths overlap, so two similar lines have a kind in common.
Exact Jaccard similarity of the lines' sets of ``gram`` characters verifies candidates.

A band's lines are first tried against its commonest line, then those that this
doesn't connect against the others.  Each candidate has a sketch of a quarter
of its set, by hash, with a bit for each cell of a table: two sets differ by no less than
their sketches do, so sets are compared only for pairs that these don't rule out.  In bands of more than
``most`` lines, as a passage that many lines hold makes them, sketches of whole sets rule
pairs out before these are made.  Such bands are dealt to blocks of at most ``chunk``
lines a side; no pair is left out for the size of its band.  The links' components
(distributed union-find by contraction) are the groups, and the first line of a
group, by doc_id and place, is kept.

Lines of fewer than ``least_chars`` characters, blanks at their ends aside, are
never compared nor removed: blank lines and single words repeat by chance.

Defined cases: a null text has no lines; an empty text is one empty line, kept;
rows that share a doc_id and hold the same line at the same place count as one;
a null doc_id sorts first; ties go to the smaller doc_id, then place; other
columns are ignored; an empty table gives no rows.  Very long lines are as others:
their shingles are rows that are aggregated as they come.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import free_name, written
from voxstrata.llm.components import block_links, components, sized


#: Kinds of minima: the lengths of the lines that have them, in characters.  Each has some 25 shingles or more.
KINDS = ((0, 125), (100, 500), (400, 1 << 31))
#: Of a long line's shingles, so many are used whatever their hashes, for lines that repeat a few shingles.
HEAD = 40
#: Words of 64 bits in the sketch of a line's set, a power of two.
SKETCH = 32


def shingle_rows(lines: DataFrame, size: int, *keep: str) -> DataFrame:
    """keep, chars (of the line), at, g: a row for the hash of every run of `size` characters of lines (line, ...)."""
    # four bytes a character, so that a shingle is cut without a walk along the line
    coded = lines.select(*keep, F.length("line").alias("chars"), F.encode("line", "UTF-32").alias("code"))
    spread = coded.select(*keep, "chars", "code", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.col("chars") - size, F.lit(0)))).alias("at"))
    return spread.select(*keep, "chars", "at", F.xxhash64(F.substring("code", F.col("at") * 4 + 1, F.lit(4 * size))).alias("g"))


def band_keys(lines: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """node, rank, keys of distinct lines (node, rank, line); a row for each of the line's kinds.  Where lines are dealt out by node, nothing is shuffled."""
    n = F.length("line")
    kinds = F.array_compact(F.array(*[F.when(n.between(*ends), F.lit(k)) for k, ends in enumerate(KINDS)]))
    spread = shingle_rows(lines.select("node", "rank", "line", F.explode_outer(kinds).alias("kind")), shingle, "node", "rank", "kind")
    g, kind = F.col("g"), F.col("kind")
    # the ranges: the upper bits of hashes that kind 1, or 2, goes by
    two, four = F.shiftrightunsigned(g, 62) == 1, F.shiftrightunsigned(g, 60) == 7
    used = spread.where((kind == 0) | (two & ((kind == 1) | four)) | (F.col("at") < HEAD))
    # all are spread over the range of kind 2, which the constants are made for: its hashes come first; what isn't in its kind's range comes after
    rest, top = F.shiftrightunsigned(g, 4), F.lit(7 << 60)
    brought = F.when(kind == 0, rest.bitwiseOR(top)).when((kind == 1) & two, F.shiftrightunsigned(g.bitwiseAND(F.lit((1 << 62) - 1)), 2).bitwiseOR(top)).when(four, g).otherwise(rest)
    hashed = used.select("node", "rank", "kind", brought.alias("g"))
    draw = random.Random(1)
    constants = [draw.getrandbits(60) - (1 << 60) for _ in range(bands * rows)]  # the four upper bits set
    minima = hashed.groupBy("node", "kind").agg(F.first("rank").alias("rank"), *[F.min(F.col("g").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(constants)])
    return minima.select("node", "rank", F.array(*[F.xxhash64("kind", F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)]).alias("keys"))


def sketched(lines: DataFrame, gram: int, quarters: int = 4) -> DataFrame:
    """node, line, n (the size of its set of `gram` characters' hashes), bits of lines (node, line): SKETCH words, or the first `quarters` of four, of a bit for each of 64 cells, set where an odd number of the set's hashes are in the cell."""
    quarter = SKETCH // 4
    word = lambda g: F.shiftrightunsigned(g, 32).bitwiseAND(F.lit(SKETCH - 1)).cast("int")
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), g.bitwiseAND(F.lit(63)).cast("int"))
    none = F.lit(0).cast("long")
    words = lambda s, q: F.transform(F.sequence(q * quarter, q * quarter + (quarter - 1)), lambda k: F.aggregate(s, none, lambda was, g: F.when(word(g) == k, was.bitwiseXOR(bit(g))).otherwise(was)))
    bits = lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(quarters - 1)), lambda q: _once(F.filter(s, lambda g: word(g).between(q * quarter, q * quarter + (quarter - 1))), lambda part: words(part, q))))
    told = _once(F.array_distinct(grams(F.col("line"), gram)), lambda s: F.struct(F.size(s).alias("n"), bits(s).alias("bits")))
    return lines.select("node", "line", told.alias("told")).select("node", "line", "told.n", "told.bits")


def may_link(x: str, y: str, similarity: float, quarters: int = 4) -> Column:
    """By the first `quarters` of four of the sketches: false only for pairs of less than `similarity`.  Hashes that both sets have cancel each other, so the sets differ by no fewer hashes than their sketches, or a part of them, by bits."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    apart = lambda words: sum((F.bit_count(F.col(f"{x}bits")[k].bitwiseXOR(F.col(f"{y}bits")[k])) for k in words), F.lit(0))
    # both share similarity / (1 + similarity) of the sum of their sizes at least
    within = lambda words: apart(words) * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6
    # most pairs fail by the first quarter already
    out = (F.least(n, m) + 1e-9 >= similarity * F.greatest(n, m)) & within(range(SKETCH // 4))
    return out & within(range(quarters * SKETCH // 4)) if quarters > 1 else out


def _once(c: Column, f) -> Column:
    """f(c), with c made once: it is bound to a lambda's variable."""
    return F.transform(F.array(c), f)[0]


def grams(line: Column, gram: int) -> Column:
    """Hashes of the line's runs of `gram` characters, by place."""
    return _once(F.encode(line, "UTF-32"), lambda code: F.transform(F.sequence(F.lit(0), F.greatest((F.length(code) / 4).cast("int") - gram, F.lit(0))), lambda i: F.xxhash64(F.substring(code, i * 4 + 1, F.lit(4 * gram)))))


def _lines(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "line")).where("line is not null")
    return rows.withColumn("node", F.when(F.length(F.trim("line")) >= least_chars, F.unhex(F.md5(F.col("line").cast("binary")))))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, gram: int = 5, shingle: int = 10, bands: int = 12, rows: int = 3, least_chars: int = 24, most: int = 64, chunk: int = 1000) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no (of its group's kept line), kept, of every line."""
    lines = _lines(docs, doc_id, text, least_chars)
    long = lines.where(F.col("node").isNotNull())
    signed = written(lines.select("doc_id", "line_no", "node"), "lines")
    distinct = long.groupBy("node").agg(F.first("line").alias("line"), (-F.count("*")).alias("rank"))
    keyed = written(band_keys(distinct, shingle, bands, rows), "bands")
    blocks = keyed.select("node", "rank", F.explode("keys").alias("key"))

    candidates: list[DataFrame] = []

    def prepare(nodes: DataFrame) -> None:
        """The texts of all lines that share a band, once: the documents aren't read again for pairs."""
        nodes = written(nodes, "nodes")
        texts = long.join(sized(nodes, nodes.count()), "node", "left_semi").select("node", "line").dropDuplicates(["node"])
        candidates.append(written(sketched(texts, gram, 1), "candidates"))

    def sketch(nodes: DataFrame) -> DataFrame:
        nodes = written(nodes, "large")
        return written(sketched(candidates[0].select("node", "line").join(sized(nodes, nodes.count()), "node", "left_semi"), gram).drop("line"), "sketches")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs of `similarity` or more.  Of those that sketches don't rule out, the sets are made."""
        of = lambda c: candidates[0].select(F.col("node").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("line", "n", "bits")])
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        common = F.size(F.array_intersect(grams(F.col("a_line"), gram), grams(F.col("b_line"), gram)))
        alike = _once(common, lambda c: c / (F.col("a_n") + F.col("b_n") - c) + 1e-12 >= similarity)
        return both.where(may_link("a_", "b_", similarity, 1) & alike).select("a", "b")

    links = block_links(blocks, verify, lambda x, y: F.lit(True), prepare, sketch, lambda x, y: may_link(x, y, similarity), most, chunk)
    found = components(links)
    grouped = signed.join(sized(found, found.count()), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    here = F.struct("doc_id", "line_no")
    # written on its own, so that a common line's rows can be split among tasks in the join
    first = written(grouped.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return grouped.join(first, "group", "left").select(
        "doc_id", "line_no", *[F.when(F.col("first").isNull(), F.col(c)).otherwise(F.col(f"first.{c}")).alias(f"first_{c}") for c in ("doc_id", "line_no")], (F.col("first").isNull() | here.eqNullSafe(F.col("first"))).alias("kept")
    )


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with duplicate lines taken out of the text; rows that lose every line that isn't blank are dropped.  doc_id tells rows apart."""
    lost = free_name(docs, "gone")
    gone = written(dedup_lines(docs, doc_id, text, **options).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias(lost)), "gone")
    n = gone.agg(F.sum(1 + F.size(lost) / 8)).first()[0] or 0
    joined = docs.join(sized(gone.withColumnRenamed("doc_id", doc_id), int(n)), doc_id, "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, k: ~F.array_contains(lost, k)), "\n")
    out = joined.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(rest))
    return out.where(F.col(lost).isNull() | (F.trim(F.translate(text, "\n", " ")) != "")).select(docs.columns)
