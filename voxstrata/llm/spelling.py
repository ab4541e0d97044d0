"""Groups of spelling variants: words one edit apart, found by two-dimensional range reporting.

A word of M letters in the dictionary is near a word w, by an edit at place j, if it
starts with w's first j letters and ends with w's last M - 1 - j: w has M letters then
(replacement) or M - 1 (insertion).  In the forward order of the dictionary's words of
M letters the first condition is an interval, in the order of the reversed words the
second one; a wavelet tree over the reverse ranks, in forward order, reports the points
of both intervals.  Deletions are insertions seen from the other word.

Spark deals the dictionary by length and by half of the word: an edit in the second
half leaves the first half as it is, so both words meet under it; an edit in the first
half leaves the second.  A bucket of such keys is one task's group, of a bounded
number of letters.  A key with more words than ``per_key`` is dealt to parts by hash;
each pair of a part of dictionary words and a part of asking words is a key then.

Defined cases: null and empty texts have no words; a null id counts as the text "null"
where ids are used; repeated rows count each; other columns are ignored; empty tables
give no rows; words may be of any length; ties go to the smaller word in code point
order.  Words don't hold U+0000.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import written
from voxstrata.llm.components import sized

#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000


def dropped_letter(doc_id, word: str) -> str:
    """The word without one letter if 31 divides the crc32 of `<doc_id>:<word>`."""
    h = crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
    k = h % len(word)
    return word if h % 31 else word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = 7, least: int = 2, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """word, n: maximal runs `[A-Za-z\\u00C0-\\u00FF]+` with A-Z in lower case, of at least `letters` code points and `least` occurrences.

    change(doc_id, word), if given, never lengthens a word, and its result is counted in place of the word."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def run(batches):
        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter[str] = Counter()
        for b in batches:
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py()
                if not t:
                    continue
                here = Counter(pattern.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if change:
                    i = b.column(0)[k].as_py()
                    for word, n in here.items():
                        seen[change(i, word)] += n
                else:
                    seen.update(here)
                if len(seen) > COUNTED:
                    yield told()
                    seen.clear()
        yield told()

    counts = docs.select(doc_id, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.length("word") >= letters) & (F.col("n") >= least))


class WaveletTree:
    """A permutation's values, by bits from the highest: each level keeps its zeros before its ones, and counts of zeros up to each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            values = np.concatenate([values[~one], values[one]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in c..d - 1 at places a..b - 1, of many queries at once."""
        q = np.flatnonzero((a < b) & (c < d))
        a, b = a[q], b[q]
        low = np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            a0, b0, n = zeros[a], zeros[b], zeros[-1]
            q, low = np.concatenate([q, q]), np.concatenate([low, low + width])
            a, b = np.concatenate([a0, n + a - a0]), np.concatenate([b0, n + b - b0])
            kept = (a < b) & (low < d[q]) & (low + width > c[q])
            q, low, a, b = q[kept], low[kept], a[kept], b[kept]
        return q, low


def _order(words: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' order, and how many letters each shares with the one before it, -1 for the first."""
    order = np.argsort(words, kind="stable")
    codes = np.ascontiguousarray(words[order]).view(np.uint32).reshape(len(words), letters)
    differ = codes[1:] != codes[:-1]
    common = np.where(differ.any(1), differ.argmax(1), letters)
    return order, np.r_[-1, common]


def _intervals(common: np.ndarray, length: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an order the interval of held words that share its first `length` letters; held counts them up to each place."""
    starts = np.flatnonzero(common < length)
    group = np.cumsum(common < length) - 1
    return held[starts][group], held[np.r_[starts[1:], len(common)]][group]


def near_pairs(words: list[str], held: np.ndarray, asks: np.ndarray, letters: int, places: range) -> tuple[np.ndarray, np.ndarray]:
    """(asking, found) row pairs: the found one is held, has `letters` letters, and comes from one that asks by an edit at one of the places."""
    forward = np.array(words, dtype=f"U{letters}")
    back = np.array([w[::-1] for w in words], dtype=f"U{letters}")
    f_order, f_common = _order(forward, letters)
    r_order, r_common = _order(back, letters)
    n = len(words)
    f_held, r_held = np.r_[0, np.cumsum(held[f_order])], np.r_[0, np.cumsum(held[r_order])]
    r_place = np.empty(n, np.int64)
    r_place[r_order] = np.arange(n)
    r_rank = r_held[r_place]  # of held rows, among the held ones
    in_f = f_order[held[f_order]]
    tree = WaveletTree(r_rank[in_f])
    in_r = r_order[held[r_order]]
    own = held.astype(np.int64)[f_order]  # a held word is in its own intervals
    pairs = []
    # where no two words share so many letters, no interval holds another word
    f_most, r_most = int(f_common.max()), int(r_common.max())
    for j in places:
        if j > f_most or letters - 1 - j > r_most:
            continue
        a, b = _intervals(f_common, j, f_held)
        c, d = _intervals(r_common, letters - 1 - j, r_held)
        c, d = c[r_place[f_order]], d[r_place[f_order]]
        ask = np.flatnonzero(asks[f_order] & (b - a > own) & (d - c > own))
        if len(ask):
            q, value = tree.report(a[ask], b[ask], c[ask], d[ask])
            pairs.append(f_order[ask[q]] * n + in_r[value])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(pairs))
    asking, found = both // n, both % n
    other = forward[asking] != forward[found]  # a word may stand in several cells of a bucket
    return asking[other], found[other]


def near_words(words: DataFrame, bucket_letters: int = 4 << 20, per_key: int = 200_000) -> DataFrame:
    """word, near, near_n: every pair of words (word, n) that differ by exactly one inserted, deleted or replaced code point, both ways."""
    size = F.length("word")
    half = lambda m: F.floor(m / 2).cast("int")
    # as dictionary word, whose neighbours have as many letters; and as asking word, for neighbours of one letter more
    of = lambda m, side, held: F.struct(m.alias("m"), F.lit(side).alias("side"), (F.substring("word", F.lit(1), half(m)) if not side else F.when(m > half(m), F.substring("word", F.length("word") - (m - half(m)) + 1, m - half(m))).otherwise("")).alias("key"), F.lit(held).alias("held"))
    rows = words.select("word", "n", F.inline(F.array(of(size, 0, True), of(size, 1, True), of(size + 1, 0, False), of(size + 1, 1, False))))
    per = rows.groupBy("m", "side", "key").agg(F.count("*").alias("rows"), F.max("held").alias("any_held"), F.sum("m").alias("letters"))
    # a key with one row, or without a dictionary word, can give no pair
    keys = written(per.where("rows > 1 and any_held").select("m", "side", "key", "letters", F.ceil(F.col("rows") / per_key).cast("int").alias("parts")), "keys")
    n_keys, letters = keys.agg(F.count("*"), F.sum(F.col("letters") * (2 * F.col("parts") - 1))).first()
    buckets = max(1, math.ceil((letters or 0) / bucket_letters))
    dealt = rows.join(sized(keys.drop("letters"), n_keys), ["m", "side", "key"])
    own, every = F.pmod(F.xxhash64("word"), "parts").cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j: F.struct(i.alias("of"), j.alias("by"))
    cells = F.array_distinct(F.concat(F.transform(every, lambda k: cell(own, k)), F.transform(every, lambda k: cell(k, own))))
    dealt = dealt.withColumn("cell", F.explode(cells)).withColumns({"held": F.col("held") & (own == F.col("cell.of")), "asks": own == F.col("cell.by")}).where("held or asks")
    dealt = dealt.select("word", "n", "m", "side", "held", "asks", F.pmod(F.xxhash64("m", "side", "key", "cell"), F.lit(buckets)).alias("bucket"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (m, side), g in pdf.groupby(["m", "side"], sort=False):
            w, n = g["word"].tolist(), g["n"].to_numpy()
            places = range(m // 2) if side else range(m // 2, m)
            x, y = near_pairs(w, g["held"].to_numpy(), g["asks"].to_numpy(), m, places)
            w = np.array(w, dtype=object)
            out.append(pd.DataFrame({"word": w[x], "near": w[y], "near_n": n[y]}))
            longer = np.array([len(w[k]) < m for k in x.tolist()], bool)
            x, y = x[longer], y[longer]
            out.append(pd.DataFrame({"word": w[y], "near": w[x], "near_n": n[x]}))
        return pd.concat(out)

    found = dealt.groupBy("bucket").applyInPandas(lambda pdf: run(pdf), "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame, share: int = 10, bucket_letters: int = 4 << 20, per_key: int = 200_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): the form is the near word of largest n if that is at least `share` times the word's own."""
    words = written(words.select("word", "n"), "words")
    near = near_words(words, bucket_letters, per_key).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    fits = -F.col("best.n") >= F.col("n") * share
    out = words.join(near, "word", "left").select("word", F.when(fits, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, -F.col("best.n")).alias("form_n"))
    out = written(out, "forms")
    # counts grow by `share` from form to form: a chain has few steps, and each round doubles what is walked
    most = out.where("form is not null").agg(F.max("form_n")).first()[0]
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, math.log(max(most or 1, 1), max(share, 2)) + 1)))):
        roots = written(roots, "roots")
        roots = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
