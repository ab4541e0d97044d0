"""N-gram Jaccard join by multiple-global-order filtering.

Texts with the same set of shingles are one class, found by a 128-bit digest of
the set.  For the others, a document's tokens are its shingles, and a global
order makes its prefix: any two sets that link share a token of both prefixes.
Three orders are used, each a function of a shingle alone.  All put shingles last
that a count sketch over all documents shows to be common; among the others the
first goes by the rarity of all its words, the second by that in coarse steps,
the third by its rarest word, and each has its own hash among equals.  Prefix tokens
under the first order are joined; a position bound drops pairs; the candidates
that are left must share a prefix token under each of the other orders too; only
then the whole sets are intersected.  Pairs within a block are dealt with by
``components.block_links``, so a group of copies costs one pair per member.

Defined cases: null and empty texts have no shingles and link with nothing; a
text with fewer words than a shingle is one shingle; rows that share a doc_id are
one node, each row gives one row; a null doc_id links with nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import small_batches, written
from voxstrata.llm.components import block_links, components, nodes_of, sized
from voxstrata.llm.words import WordHashes, mix, shingles_at, words

#: The count sketch has twice 2 ** BITS counters, sent in CHUNKS pieces: 4 MB in the driver, whatever the input.
BITS, CHUNKS = 18, 16
#: Buckets of a set's counts in the bound on intersections; bits of the filter of tokens that go behind all others (1 MB).
BUCKETS, HEAVY_BITS = 128, 23
_SEEDS = tuple(np.uint64(x) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D))


class Tokens:
    """A text's shingles: sorted distinct hashes, and the rarity of each (of all words, of the rarest), in eighths of a power of two."""

    def __init__(self, size: int, rarity: np.ndarray | None = None):
        self.size, self.rarity, self.hashes = size, rarity, WordHashes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.array([self.hashes[w] for w in words(text)], dtype=np.uint64)
        s = shingles_at(h, self.size)
        if self.rarity is None or not len(s):
            return np.unique(s), h, h
        s, first = np.unique(s, return_index=True)
        r = self.rarity[_buckets(h)]
        runs = np.lib.stride_tricks.sliding_window_view(r, min(self.size, len(r)))[first]
        return s, runs.sum(1), runs.min(1)


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


class Sketch:
    """Counts of all documents' words and shingles by bucket of their hash, and what the orders make of them."""

    #: one bit for each hash by its top bits: tokens that go behind all others in the first order
    heavy: np.ndarray | None = None

    def __init__(self, counts: np.ndarray):
        of_words, of_shingles = counts
        self.rarity = np.round(8 * np.log2(np.maximum(of_words, 1))).astype(np.int64)
        mean = of_shingles.mean()
        # a bucket this far over the mean holds a shingle that is common itself
        common = of_shingles > mean + 6 * np.sqrt(mean) + 2
        self.common = np.where(common, np.round(8 * np.log2(np.maximum(of_shingles, 1))), 0).astype(np.int64)


def sketch(docs: DataFrame, size: int, text: str = "text") -> Sketch:
    """One pass over all documents; 2 ** BITS counters for words and as many for shingles, summed in CHUNKS pieces."""

    def count(batches):
        total, tokens = np.zeros((2, 1 << BITS), np.int64), Tokens(size)
        for b in batches:
            for t in b.column(0).to_pylist():
                s, h, _ = tokens.of(t)
                np.add.at(total[0], _buckets(h), 1)
                np.add.at(total[1], _buckets(s), 1)
        parts = [zlib.compress(p.tobytes(), 1) for p in total.reshape(CHUNKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(zlib.decompress(c), np.int64)
                held[k] = held[k] + c if k in held else c
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in held.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = docs.select(text).mapInArrow(count, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema)
    out = np.zeros((CHUNKS, (2 << BITS) // CHUNKS), np.int64)
    for r in summed.collect():
        out[r.chunk] += np.frombuffer(zlib.decompress(r.counts), np.int64)
    return Sketch(out.reshape(2, -1))


def prefix_length(n: int, per_cent: int) -> int:
    """Of a set of n tokens: any set that links shares one of the first so many, under any global order."""
    return n - -(-per_cent * n // 100) + 1 if n else 0


def prefix(tokens: tuple[np.ndarray, np.ndarray, np.ndarray], counts: Sketch, order: int, per_cent: int) -> np.ndarray:
    """The set's first tokens under one of the orders."""
    s, all_words, rarest = tokens
    by = (all_words, all_words // 32, rarest)[order]
    keys = [mix(s ^ _SEEDS[order]), by, counts.common[_buckets(s)]]
    if order == 0 and counts.heavy is not None:
        at = s >> np.uint64(64 - HEAVY_BITS)
        keys.append(counts.heavy[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
    return s[np.lexsort(keys)][: prefix_length(len(s), per_cent)]


def _filter_place(key: Column) -> tuple[Column, Column]:
    """A token's word of the filter, and its bit there as a mask."""
    return F.shiftrightunsigned(key, 64 - HEAVY_BITS + 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 64 - HEAVY_BITS).bitwiseAND(F.lit(63)).cast("int"))


def heavy_words(keys: DataFrame) -> DataFrame:
    """(word, bits) of the filter of tokens `key`: at most 2 ** (HEAVY_BITS - 6) rows, however many tokens there are."""
    word, mask = _filter_place(F.col("key"))
    return keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def heavy_filter(words_: DataFrame) -> np.ndarray:
    got = words_.toArrow()
    out = np.zeros(1 << HEAVY_BITS - 6, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_filter(tokens: DataFrame, words_: DataFrame) -> DataFrame:
    """The rows whose token `key` the filter holds, by the filter's own bits: tokens that it holds by chance are moved like the heavy ones."""
    word, mask = _filter_place(F.col("key"))
    met = tokens.withColumn("word", word).join(F.broadcast(words_), "word")  # of bounded size, see heavy_words
    return met.where(F.col("bits").bitwiseAND(mask) != 0).drop("word", "bits")


def _lists(arrays: list[np.ndarray], kind=np.uint64) -> pa.Array:
    """Lists of the hashes as signed numbers; as 32-bit ones their low halves, enough for a filter."""
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.dtype(f"i{flat.itemsize}"))))


def link_documents(docs: DataFrame, size: int, per_cent: int, doc_id: str = "doc_id", text: str = "text", most: int = 64) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), n_links (of the class, to others it was verified with), component_id.

    Two documents link when 100 * intersection >= per_cent * union of their sets of word shingles."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        return _linked(docs, size, per_cent, most)


def _linked(docs: DataFrame, size: int, per_cent: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    orders = sketch(docs, size)
    counts = spark.sparkContext.broadcast(orders)

    def signatures(shipped):
        def run(batches):
            tokens = Tokens(size, shipped.value.rarity)
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    found = [tokens.of(t) for t in part.column(1).to_pylist()]
                    sets = [f[0] for f in found]
                    with np.errstate(over="ignore"):
                        d = [(int(mix(s).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ _SEEDS[2])).view(np.int64))) if len(s) else (0, 0) for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), _lists([prefix(f, shipped.value, 0, per_cent) for f in found])],
                        ["doc_id", "n", "d1", "d2", "p"],
                    )

        return run

    signed_schema = "doc_id long, n long, d1 long, d2 long, p array<long>"
    signed = written(docs.mapInArrow(signatures(counts), signed_schema), "signatures")
    named = signed.where("n > 0 and doc_id is not null")
    classes = written(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    prefixes = named.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "p")

    # the first order mended: a document whose prefix holds no token of the filter keeps its prefix, which is that of the mended order too
    spread = lambda df: df.select("node", F.explode("p").alias("key"))
    heavy = written(spread(prefixes).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key"), "heavy")
    if not heavy.isEmpty():
        bits = written(heavy_words(heavy), "heavy-words")
        orders.heavy = heavy_filter(bits)
        mended = spark.sparkContext.broadcast(orders)
        moved = written(in_filter(spread(prefixes), bits).select("node").distinct(), "moved")
        some = sized(moved, moved.count())
        again = docs.join(some.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(signatures(mended), signed_schema)
        again = written(again.where("n > 0").select(F.col("doc_id").alias("node"), "n", "p"), "mended")
        prefixes = prefixes.join(some, "node", "left_anti").unionByName(again)
    blocks = prefixes.select("node", "n", F.posexplode("p").alias("rank", "key"))

    def tokens_of(columns, out):
        """Rows (doc_id, text) to their node and columns(tokens of a text)."""

        def run(batches):
            tokens = Tokens(size, counts.value.rarity)
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns([tokens.of(t) for t in part.column(1).to_pylist()])], ["node", *out])

        return run

    def filters(found):
        c = [np.bincount((f[0] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes() for f in found]
        return [*[_lists([prefix(f, counts.value, k, per_cent) for f in found], np.uint32) for k in (1, 2)], pa.array(c, pa.binary())]

    def roomy(batches):
        """Pairs whose counts by bucket leave room for the intersection that a link needs."""
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(-1, BUCKETS).astype(np.int64) for k in (2, 3))
            both = np.minimum(x, y).sum(1)
            yield b.select(["a", "b"]).filter(pa.array(100 * both >= per_cent * (x.sum(1) + y.sum(1) - both)))

    def check(batches):
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= per_cent * (len(x) + len(y) - both):
                    keep.append(k)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    def texts(pairs: DataFrame) -> DataFrame:
        nodes, n = nodes_of(pairs)
        return docs.join(sized(nodes.withColumnRenamed("node", "doc_id"), n), "doc_id", "left_semi")

    def verify(pairs: DataFrame) -> DataFrame:
        narrow = written(texts(pairs).mapInArrow(tokens_of(filters, ["p1", "p2", "c"]), "node long, p1 array<int>, p2 array<int>, c binary"), "filters")
        of = lambda df, c, *cols: df.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols])
        met = pairs.join(of(narrow, "a", "p1", "p2", "c"), "a").join(of(narrow, "b", "p1", "p2", "c"), "b").where(F.arrays_overlap("a_p1", "b_p1") & F.arrays_overlap("a_p2", "b_p2"))
        passed = written(met.select("a", "b", "a_c", "b_c").mapInArrow(roomy, "a long, b long").distinct(), "passed")
        # whole sets only of what passed all filters
        sets = written(texts(passed).mapInArrow(tokens_of(lambda found: [pa.array([f[0].tobytes() for f in found], pa.binary())], ["tokens"]), "node long, tokens binary"), "sets")
        both = passed.join(of(sets, "a", "tokens"), "a").join(of(sets, "b", "tokens"), "b")
        return both.select("a", "b", "a_tokens", "b_tokens").mapInArrow(check, "a long, b long").distinct()

    def fits(x: str, y: str) -> Column:
        n = F.col(f"{x}n") + F.col(f"{y}n")
        room = F.least(F.col(f"{x}n") - F.col(f"{x}rank"), F.col(f"{y}n") - F.col(f"{y}rank"))  # ranks count from 0: this token and those after it
        return (100 + per_cent) * room >= per_cent * n

    links = block_links(blocks, verify, fits)
    found = components(links)
    degrees = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    placed = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").join(degrees, "class_id", "left")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), F.when(F.col("n") > 0, F.col("d2")).alias("d2"))
    out = rows.join(placed, ["n", "d1", "d2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "class_id")).alias("component_id"))


#: Pairs are found by an inverted list of all shingles here: quadratic in a shingle's documents, for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) END AS sh FROM w),
k AS (SELECT sh, min(doc_id) AS class_id FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
t AS (SELECT class_id, len(sh) AS n, unnest(sh) AS g FROM k),
p AS (SELECT x.class_id AS a, y.class_id AS b FROM t x JOIN t y ON x.g = y.g AND x.class_id < y.class_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
      GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT class_id, class_id FROM k UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
m AS (SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(k.class_id, s.doc_id) AS class_id FROM s LEFT JOIN k ON list_sort(s.sh) = k.sh AND len(s.sh) > 0)
SELECT doc_id, n_shingles, class_id, coalesce(component_id, class_id) AS component_id FROM m LEFT JOIN c ON m.class_id = c.node
"""
