"""Maximal periodic runs of words, by a suffix tree and its branching tandem repeats.

A batch's texts lie one after the other, each with word numbers and an end mark of its
own, so that one suffix tree serves them all and no two texts share a node.  The tree is
kept as a suffix order and its common prefix lengths: a node is an interval of the
order, and a word sequence w stands at place i exactly if i's rank lies in w's interval.

Stoye and Gusfield: with w a node's whole path, ww at i is a branching tandem repeat
(the word after it differs from w's first) if i and i + |w| are leaves below different
children; one of the two lies outside the node's largest child, so only the leaves of
the other children are looked at, O(n log n) in all.  A branching repeat can't be
rotated to the right, so its end is a run's end; rotating it to the left while words
|w| apart are equal gives the run's start.  Repeats of one run are merged, the smallest
period stays.

A run of `exponent` periods holds w that often in a row: nodes with fewer leaves can't
give one, their part of the tree isn't unfolded, and a repeat whose w doesn't stand
often enough to the left of its end isn't rotated.  That loses no run.

Defined cases: a null, empty or blank text has no words and no runs, and collapses to
the empty text; ids may be null or repeat, each row gives one row; other columns are
ignored, whatever their names; an empty table gives no rows; a text of any length is
taken whole, in a batch of its own if it is long.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of texts that share a tree; a longer text has its own.
TREE_WORDS = 400_000


def suffix_order(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, common): places whose word occurs at least `least` times, in the order of their suffixes, and the length
    of the prefix that each shares with the one before it.

    By doubling; groups of fewer than `least` suffixes with a common prefix stay as they are, in any order.
    s ends in a value that occurs once, as do the ends of the texts in it."""
    times = np.bincount(s)
    places = np.flatnonzero(times[s] >= least)
    m = len(places)
    if not m:
        return places, np.zeros(0, np.int64)
    places = places[np.argsort(s[places], kind="stable")]
    first = np.r_[True, s[places[1:]] != s[places[:-1]]]
    # a suffix outside gets a rank of its own, beyond all others
    rank = np.arange(m, m + len(s), dtype=np.int64)
    rank[places] = np.maximum.accumulate(np.where(first, np.arange(m), 0))
    common = np.where(first, 0, -1)  # -1: not known yet
    open_, h = np.arange(m), 1
    while True:
        # groups of at least `least` suffixes that share h words
        heads = np.flatnonzero(np.r_[True, rank[places[open_[1:]]] != rank[places[open_[:-1]]]])
        sizes = np.diff(np.r_[heads, len(open_)])
        kept = np.repeat(sizes >= least, sizes)
        small = open_[~kept]
        common[small[common[small] == -1]] = h  # at least that, and no node with enough leaves is deeper
        open_ = open_[kept]
        if not len(open_):
            break
        at = places[open_]
        own, next_ = rank[at], rank[np.minimum(at + h, len(s) - 1)]
        order = np.argsort(own * (m + len(s)) + next_, kind="stable")  # by place within a group, so that lengths chain
        at, next_ = at[order], next_[order]
        places[open_] = at
        new = np.r_[True, (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])]  # own is sorted already
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        split = open_[new]
        common[split[common[split] == -1]] = -2  # shares h words or more, fewer than 2 h
        h *= 2
    # lengths of the open ones: one word less than at the place before where both suffixes are one word shorter there
    ask = np.flatnonzero(common == -2)
    if not len(ask):
        return places, common
    a, b = places[ask], places[ask - 1]
    by = np.argsort(a)
    a, b, ask = a[by], b[by], ask[by]
    chained = np.r_[False, (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)]
    starts = np.flatnonzero(~chained)
    found = np.zeros(len(a), np.int64)
    found[starts] = _same(s, a[starts], b[starts])
    head = starts[np.cumsum(~chained) - 1]
    common[ask] = found[head] - (np.arange(len(a)) - head)
    return places, common


def _same(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in common from a and from b on, which differ before the end mark."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    step = 0
    while len(left) > 32:
        left = left[s[a[left] + step] == s[b[left] + step]]
        out[left] += 1
        step += 1
    for k in left.tolist():
        x, y, n, c = int(a[k]) + step, int(b[k]) + step, len(s), 64
        while True:
            c = min(c, n - max(x, y))
            differs = np.flatnonzero(s[x : x + c] != s[y : y + c])
            if len(differs):
                out[k] = x + int(differs[0]) - int(a[k])
                break
            x, y, c = x + c, y + c, c * 4
    return out


def _nearest_below(v: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 where there is none; values are 0 or more."""
    v = np.r_[-1, v]
    at = np.arange(len(v)) - 1
    left = np.arange(1, len(v))
    while len(left := left[v[at[left]] >= v[left]]):
        at[left] = at[at[left]]
    return at[1:] - 1


def branching_repeats(s: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of the branching tandem repeats whose w stands `exponent` times in a row up to end."""
    none = np.zeros(0, np.int64)
    places, common = suffix_order(s, exponent)
    m = len(places)
    if m < exponent:
        return none, none
    rank = np.full(len(s), -1, np.int64)
    rank[places] = np.arange(m)
    # the border between suffixes k - 1 and k belongs to the node low..high as deep as their common prefix
    v = common[1:]
    k = np.flatnonzero(v >= 1)
    low, high, depth = _nearest_below(v)[k] + 1, len(v) - 1 - _nearest_below(v[::-1])[::-1][k], v[k]
    k = k + 1
    big = high - low + 1 >= exponent
    k, low, high, depth = k[big], low[big], high[big], depth[big]
    if not len(k):
        return none, none
    by = np.lexsort((k, depth, low))
    k, low, high, depth = k[by], low[by], high[by], depth[by]
    new = np.r_[True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])]
    node = np.cumsum(new) - 1
    n_low, n_high, n_depth = low[new], high[new], depth[new]
    # a node's children: from low to the first border, and from each border to the next or to high
    c_node = np.r_[np.arange(len(n_low)), node]
    c_from = np.r_[n_low, k]
    by = np.lexsort((c_from, c_node))
    c_node, c_from = c_node[by], c_from[by]
    last = np.r_[c_node[1:] != c_node[:-1], True]
    c_size = np.where(last, n_high[c_node] + 1, np.r_[c_from[1:], 0]) - c_from
    largest = np.lexsort((c_size, c_node))[last]  # the last of each node, by size
    small = np.ones(len(c_node), bool)
    small[largest] = False
    c_node, c_from, c_size = c_node[small], c_from[small], c_size[small]
    leaf = np.repeat(c_from - np.r_[0, np.cumsum(c_size)[:-1]], c_size) + np.arange(c_size.sum())
    of = np.repeat(c_node, c_size)
    i, d, lo, hi = places[leaf], n_depth[of], n_low[of], n_high[of]
    ends, periods = [], []
    for t, other in ((i, i + d), (i - d, i - d)):  # the leaf is the first or the second w of the repeat at t
        ok = (t >= 0) & (t + 2 * d < len(s))
        ok[ok] = (rank[other[ok]] >= lo[ok]) & (rank[other[ok]] <= hi[ok])
        ok[ok] = s[t[ok] + d[ok]] != s[t[ok] + 2 * d[ok]]
        for back in range(1, exponent - 1):
            w = t - back * d
            ok &= w >= 0
            ok[ok] = (rank[w[ok]] >= lo[ok]) & (rank[w[ok]] <= hi[ok])
        ends.append(t[ok] + 2 * d[ok])
        periods.append(d[ok])
    return np.concatenate(ends), np.concatenate(periods)


def _rotate(s: np.ndarray, start: int, period: int) -> int:
    """How far to the left words `period` apart stay equal."""
    c = 16
    while start:
        c = min(c, start)
        differs = np.flatnonzero(s[start - c : start] != s[start - c + period : start + period])
        if len(differs):
            return start - c + int(differs[-1]) + 1
        start, c = start - c, c * 4
    return 0


def runs_of(s: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `exponent` (2 or more) periods and `least` words, by start and period.

    s: word numbers; the last one, and one at the end of each text, occur once."""
    end, period = branching_repeats(s, exponent)
    out, here, seen = [], -1, []
    for k in np.lexsort((period, end)).tolist():
        e, p = int(end[k]), int(period[k])
        if e != here:
            here, seen = e, []
        # a repeat inside a found run of a period that divides its own is that run's
        if any(p % q == 0 and b <= e - 2 * p for b, q in seen):
            continue
        b = _rotate(s, e - exponent * p, p)
        seen.append((b, p))
        if e - b >= least:
            out.append((b, e - b, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Word numbers of the texts, each text's own, with an end mark after each."""
    total, parts = 0, []
    for words in texts:
        number = defaultdict()
        number.default_factory = lambda number=number, total=total: total + len(number)
        parts += [np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.array([total + len(number)])]
        total += len(number) + 1
    return np.concatenate(parts)


def collapse(texts: list[list[bytes]], exponent: int, least: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Each text's runs, and its words without those that repeat a run's first period."""
    if not any(len(w) >= max(exponent, least) for w in texts):
        return [([], b" ".join(w)) for w in texts]
    found = runs_of(_numbered(texts), exponent, least)
    out, at, base = [], 0, 0
    for words in texts:
        own = []
        while at < len(found) and found[at][0] < base + len(words):
            own.append((found[at][0] - base, *found[at][1:]))
            at += 1
        if own:
            kept = np.ones(len(words), bool)
            for start, length, period in own:
                kept[start + period : start + length] = False
            words = [words[k] for k in np.flatnonzero(kept).tolist()] if own else words
        out.append((own, b" ".join(words)))
        base += (len(kept) if own else len(words)) + 1
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, runs array<start, length, period> (by start, then period), collapsed (words kept, one space between) of each row.

    Words are `[^\\x20\\x09-\\x0D]+`; a run is a maximal stretch whose words `period`, its smallest period, apart are
    identical, of at least `exponent` periods and `least` words."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(ids, texts):
        got = collapse(texts, exponent, least)
        runs = [[{"start": x, "length": n, "period": p} for x, n, p in r] for r, _ in got]
        return pa.RecordBatch.from_arrays([ids, pa.array(runs, kinds), pa.array([c.decode("utf-8", "surrogatepass") for _, c in got], pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            held, size, first = [], 0, 0
            for k in range(b.num_rows):
                t = b.column(1)[k].as_py()
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                if held and size + len(words) > TREE_WORDS:
                    yield done(b.column(0).slice(first, len(held)), held)
                    held, size, first = [], 0, k
                held.append(words)
                size += len(words)
            if held:
                yield done(b.column(0).slice(first, len(held)), held)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: with h the crc32 of the id in decimal, the words from place a on of every tenth text repeat with a period of p.

    a = floor(h / 10) % n, p = 1 + floor((n - a) / (3 + floor(h / 10) % 8)) for n words; other texts, also those without an id or words, stay."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    turned = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    rows = rows.withColumn("words", words).withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return rows.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """One row per document: number of runs, the one of greatest exponent, and digests of all runs and of the collapsed text."""
    beats: Column = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * r["period"], r).otherwise(best),
    )
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), beats.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(F.col("b.length") * 1000 / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
