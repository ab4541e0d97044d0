"""Language-model scores from an Elias-Fano n-gram trie.

Counting is a Spark aggregation per order: words by their 64-bit hash, then
n-grams as (position of their context in the level below, word id), each order
counting only what the order below kept (an n-gram seen ``least`` times holds
n-grams seen as often).  A level is sorted by (context, word), cut into shards
by range, and each shard is one file in the shared folder:

    pointers  Elias-Fano, from a context to its children's first place
    words     children's word ids, ascending within a context
    codes     log10 probabilities, quantised to 256 values, and backoff weights likewise
    counts    of the children, for the next order

Texts are split and looked up in the vocabulary once: orders from 2 and scores go by
their ids.  A context's n-grams are in one shard, which sums them, unless the context
is so frequent that they may be many; only such a context's sum is a join.

Workers map the files into memory and look n-grams up by successor search within
the context's children.  Nothing of the trie passes the driver but one manifest
row per shard.

Probabilities: absolute discounting, interpolated with the next lower order; the
lowest order is (c + 1) / (N + V + 1).  N-grams below ``least`` count as unseen
and their mass goes to the backoff weight.

Defined cases: null and empty texts are one token, the end; unknown words have
the lowest order's unseen probability; without training rows N and V are 0; rows
may repeat, each gives one row; other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from voxstrata.llm.common import new_path, small_batches, written
from voxstrata.llm.components import sized
from voxstrata.llm.words import words

#: A word can't hold a space, so this is none.
END = b" "


# --- Elias-Fano -----------------------------------------------------------------------------------


def ef_build(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence: low bits packed, high parts as unary gaps with a rank sample per 16 bits."""
    values = values.astype(np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    at = np.arange(n, dtype=np.uint64)
    packed = np.zeros(n * low // 64 + 2, np.uint64)
    if low:
        bits = values & np.uint64((1 << low) - 1)
        place = at * np.uint64(low)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        np.bitwise_or.at(packed, word, bits << shift)
        over = shift + np.uint64(low) > 64
        np.bitwise_or.at(packed, word[over] + 1, bits[over] >> (np.uint64(64) - shift[over]))
    marks = ((values >> np.uint64(low)) + at).astype(np.int64)
    high = np.zeros((int(marks[-1]) // 16 + 1 if n else 0) * 16, np.uint8)
    high[marks] = 1
    ones = high.reshape(-1, 16).sum(1, dtype=np.int64)
    return {"low": packed, "high": np.packbits(high, bitorder="little").view("<u2"), "rank": np.cumsum(ones) - ones, "meta": np.array([n, low], np.int64)}


@cache
def _select() -> np.ndarray:
    """Where the k-th set bit of each 16-bit word lies."""
    bits = np.unpackbits(np.arange(1 << 16, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    row, col = np.nonzero(bits)
    out = np.zeros((1 << 16, 16), np.uint8)
    out[row, np.cumsum(bits, axis=1)[row, col] - 1] = col
    return out


def ef_get(ef: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Values at the places `at`."""
    low = int(ef["meta"][1])
    word = np.searchsorted(ef["rank"], at, side="right") - 1
    high = word * 16 + _select()[ef["high"][word], at - ef["rank"][word]] - at
    if not low:
        return high
    place = at.astype(np.uint64) * np.uint64(low)
    w, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
    v = ef["low"][w] >> shift
    over = shift + np.uint64(low) > 64
    v[over] |= ef["low"][w[over] + 1] << (np.uint64(64) - shift[over])
    return (high << low) | (v & np.uint64((1 << low) - 1)).astype(np.int64)


# --- files ----------------------------------------------------------------------------------------


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    head, at, parts = {}, 0, []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[k] = (at, a.dtype.str, len(a))
        pad = -a.nbytes % 64
        parts += [a.tobytes(), b"\0" * pad]
        at += a.nbytes + pad
    meta = json.dumps(head).encode()
    meta += b" " * (-(len(meta) + 8) % 64)
    fs, where = pafs.FileSystem.from_uri(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(where, compression=None) as f:
        f.write(len(meta).to_bytes(8, "little") + meta)
        for p in parts:
            f.write(p)


_OPEN: dict[str, dict[str, np.ndarray]] = {}


def load(path: str) -> dict[str, np.ndarray]:
    """Arrays of a file, mapped into memory.  A file of a store that can't be mapped is copied to an unnamed temporary file first."""
    if path not in _OPEN:
        if len(_OPEN) > 4096:
            _OPEN.clear()
        fs, where = pafs.FileSystem.from_uri(path)
        if isinstance(fs, pafs.LocalFileSystem):
            f = open(where, "rb")  # noqa: SIM115
        else:
            f = tempfile.TemporaryFile()  # noqa: SIM115
            with fs.open_input_stream(where, compression=None) as g:
                while part := g.read(1 << 22):
                    f.write(part)
            f.flush()
        with f:
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(m[:8], "little")
        _OPEN[path] = {k: np.frombuffer(m, np.dtype(t), c, 8 + n + at) for k, (at, t, c) in json.loads(m[8 : 8 + n]).items()}
    return _OPEN[path]


# --- levels ---------------------------------------------------------------------------------------


@dataclass
class Shard:
    path: str
    first: tuple[int, int]
    last: tuple[int, int]
    offset: int
    size: int


def _cuts(ctx: np.ndarray, w: np.ndarray, shards: list[Shard]) -> np.ndarray:
    """Where the keys of each shard begin in keys sorted by (ctx, w)."""
    at = [0]
    for s in shards[1:]:
        lo, hi = np.searchsorted(ctx, s.first[0], "left"), np.searchsorted(ctx, s.first[0], "right")
        at.append(int(lo + np.searchsorted(w[lo:hi], s.first[1], "left")))
    return np.array([*at, len(ctx)])


def _gathered(shards: list[Shard], name: str, at: np.ndarray) -> np.ndarray:
    """The shards' values at places, whose order is free; 0 for places below 0."""
    out = np.zeros(len(at), np.int64)
    if len(shards) == 1:
        inside = at >= 0
        out[inside] = load(shards[0].path)[name][at[inside]]
        return out
    order = np.argsort(at)
    cuts = np.searchsorted(at, [s.offset for s in shards] + [s.offset + s.size for s in shards[-1:]], sorter=order)
    for k, s in enumerate(shards):
        if cuts[k] < cuts[k + 1]:
            here = order[cuts[k] : cuts[k + 1]]
            out[here] = load(s.path)[name][at[here] - s.offset]
    return out


class Vocabulary:
    """Word hash -> id and count, over shards sorted by hash."""

    def __init__(self, shards: list[Shard], tokens: int):
        self.shards, self.tokens, self.size = shards, tokens, sum(s.size for s in shards)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cuts = np.append(np.searchsorted(h, [s.first[0] for s in self.shards]), len(h))
        for k, s in enumerate(self.shards):
            part = slice(cuts[k], cuts[k + 1])
            if part.start < part.stop:
                a = load(s.path)
                at = np.minimum(np.searchsorted(a["hashes"], h[part]), s.size - 1)
                hit = a["hashes"][at] == h[part]
                ids[part] = np.where(hit, at + s.offset, -1)
                counts[part] = np.where(hit, a["counts"][at], 0)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return ids[back], counts[back]

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        return _gathered(self.shards, "counts", ids)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.size + 1))


class Level:
    """n-grams by (context, word), over shards sorted by that key."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards

    def find(self, ctx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of keys in any order: position (-1 where there is none), log10 probability, log10 backoff weight of the context."""
        pos, prob, back = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx)), np.zeros(len(ctx))
        if not self.shards or not len(ctx):
            return pos, prob, back
        top = int(w.max()) + 1
        order = np.argsort(ctx * top + w) if int(ctx.max()) * top < 2**62 else np.lexsort((w, ctx))
        c, x = ctx[order], w[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1])
        uc, ux = c[new], x[new]
        got = np.full(len(uc), -1, np.int64), np.zeros(len(uc)), np.zeros(len(uc))
        cuts = _cuts(uc, ux, self.shards)
        for k, s in enumerate(self.shards):
            part = slice(cuts[k], cuts[k + 1])
            if part.start < part.stop:
                self._search(s, uc[part], ux[part], *(g[part] for g in got))
        # the backoff of a context whose children begin in a later shard than the key
        for k, s in enumerate(self.shards[1:], 1):
            lo, hi = np.searchsorted(uc, s.first[0], "left"), cuts[k]
            if lo < hi:
                a = load(s.path)
                got[2][lo:hi] = a["back_book"][a["back"][0]]
        each = np.cumsum(new) - 1
        for out, g in zip((pos, prob, back), got):
            out[order] = g[each]
        return pos, prob, back

    @staticmethod
    def _search(s: Shard, ctx, w, pos, prob, back) -> None:
        a = load(s.path)
        base = s.first[0]
        inside = np.nonzero((ctx >= base) & (ctx <= s.last[0]))[0]
        if not len(inside):
            return
        local = ctx[inside] - base
        new = np.ones(len(local), bool)  # contexts come in order
        new[1:] = local[1:] != local[:-1]
        uniq, inv = local[new], np.cumsum(new) - 1
        ef = {k: a[k] for k in ("low", "high", "rank", "meta")}
        lo, hi = ef_get(ef, uniq)[inv], ef_get(ef, uniq + 1)[inv]
        back[inside] = np.where(hi > lo, a["back_book"][a["back"][local]], 0.0)
        end, want, children = hi.copy(), w[inside], a["words"]
        while (live := np.nonzero(lo < hi)[0]).size:
            mid = (lo[live] + hi[live]) >> 1
            less = children[mid] < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        hit = (lo < end) & (children[np.minimum(lo, s.size - 1)] == want)
        at = lo[hit]
        pos[inside[hit]] = at + s.offset
        prob[inside[hit]] = a["prob_book"][a["probs"][at]]

    def counts_of(self, pos: np.ndarray) -> np.ndarray:
        return self._of(pos, "counts")

    def words_of(self, pos: np.ndarray) -> np.ndarray:
        """The last words of the n-grams at the positions."""
        return self._of(pos, "words")

    def _of(self, pos: np.ndarray, name: str) -> np.ndarray:
        return _gathered(self.shards, name, pos)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and a book of at most 256 values, the means of equally large groups."""
    values, inv = np.unique(x, return_inverse=True)
    if len(values) > 256:
        weight = np.bincount(inv)
        group = np.minimum((np.cumsum(weight) - weight) * 256 // len(x), 255)
        book = np.bincount(group, values * weight, 256) / np.maximum(np.bincount(group, weight, 256), 1)
        return group[inv].astype(np.uint8), book
    return inv.astype(np.uint8), np.append(values, np.zeros(256 - len(values)))


@dataclass
class Trie:
    vocabulary: Vocabulary
    levels: list[Level]
    starts: int  # training texts: the count of the start as a context


class Codes(dict):
    """Word -> code, with each code's id and count in the vocabulary; a worker's memory of the words it has met."""

    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        self.vocabulary, self.most = vocabulary, most
        self.ids = self.counts = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k

    def of(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of a run of words."""
        if len(self) > self.most:
            self.clear()
            self.ids = self.counts = np.empty(0, np.int64)
        code = np.fromiter(map(self.__getitem__, run), np.int64, len(run))
        if new := len(self) - len(self.ids):
            added = list(islice(reversed(self), new))[::-1]
            ids, counts = self.vocabulary.find(np.array([xxh3_64_intdigest(w) for w in added], np.uint64).view(np.int64))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return self.ids[code], self.counts[code]


def _id_kind(vocabulary: Vocabulary) -> np.dtype:
    return np.dtype(np.int32 if vocabulary.size < 2**31 - 1 else np.int64)


def encoded(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, ids of every row.  ids: each token's id, or -1 - its count if that is below `least`."""
    kind = _id_kind(vocabulary)

    def run(batches):
        codes = Codes(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                flat, n = [], part.num_rows
                lengths = np.zeros(n, np.int64)
                for k, t in enumerate(part.column(1).to_pylist()):
                    ws = words(t)
                    flat += ws
                    flat.append(END)
                    lengths[k] = len(ws) + 1
                ids, counts = codes.of(flat)
                doc = np.repeat(np.arange(n), lengths)
                data = np.where(counts >= least, ids, -1 - counts).astype(kind).tobytes()
                ends = np.cumsum(lengths) * kind.itemsize
                rows = [data[e - m : e] for e, m in zip(ends.tolist(), (lengths * kind.itemsize).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths), pa.array(np.bincount(doc, counts > 0, n).astype(np.int64)), pa.array(np.bincount(doc, vocabulary.log10(counts), n)), pa.array(rows, pa.binary())],
                    ["doc_id", "n_tokens", "n_known", "base_score", "ids"],
                )

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, n_known long, base_score double, ids binary")


class _Batch:
    """Texts as runs of word ids: the start (id V), the words, the end.  Words below `least` have ids below 0."""

    def __init__(self, rows: pa.Array, trie: Trie, least: int):
        kind = _id_kind(trie.vocabulary)
        held = rows.to_pylist()
        self.lengths = np.array([len(x) // kind.itemsize for x in held], np.int64)
        self.ids = np.frombuffer(b"".join(held), kind).astype(np.int64)
        self.often = self.ids >= 0
        self.doc = np.repeat(np.arange(len(held)), self.lengths)
        first = np.zeros(len(self.ids), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        self.first = first
        self.before = np.where(first, trie.vocabulary.size, np.roll(self.ids, 1))
        self.led = np.where(first, trie.starts >= least, self.before >= 0)

    def walk(self, trie: Trie):
        """For each order from 2: (places looked up, context, position, log10 probability, backoff)."""
        use = np.nonzero(self.often & self.led)[0]
        ctx = self.before[use]
        for level in trie.levels:
            pos, prob, back = level.find(ctx, self.ids[use])
            yield use, ctx, pos, prob, back
            at = np.full(len(self.ids), -1, np.int64)
            at[use] = pos
            # the n-gram that ends before a place is its context in the next order
            longer = np.roll(at, 1)
            use = np.nonzero((longer >= 0) & ~self.first & self.often)[0]
            ctx = longer[use]
        self.next = use, ctx


def score_batch(b: _Batch, trie: Trie) -> np.ndarray:
    logs = trie.vocabulary.log10(np.where(b.often, trie.vocabulary.counts_of(b.ids), -1 - b.ids))
    # contexts that are known but whose word is too rare to be a child still back off
    for k, (use, _, pos, prob, back) in enumerate(b.walk(trie)):
        logs[use] = np.where(pos >= 0, prob, back + logs[use])
        if not k:
            rare = np.nonzero(~b.often & b.led)[0]
            _, _, lone = trie.levels[0].find(b.before[rare], np.full(len(rare), trie.vocabulary.size + 1))
            logs[rare] += lone
    return logs


def _manifest(rows: DataFrame) -> list[Shard]:
    out, at = [], 0
    for r in sorted(written(rows, "manifest").collect(), key=lambda r: (r.c0, r.w0)):
        out.append(Shard(r.path, (r.c0, r.w0), (r.c1, r.w1), at, r.n))
        at += r.n
    return out


_MANIFEST = "path string, c0 long, w0 long, c1 long, w1 long, n long"


def _shards(rows: DataFrame, n: int, keys: list[str], columns: list[str], per_shard: int, writer) -> list[Shard]:
    """Of the n rows, those of equal keys are in one shard; the writer gets the columns, in any order of rows, and sorts what it holds anyway."""
    parts = max(1, -(-n // per_shard))
    if not n:
        return []
    return _manifest(rows.repartitionByRange(parts, *keys).select(*columns).mapInArrow(writer, _MANIFEST))


def _told(path: str, c: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    row = [path, int(c[0]), int(w[0]), int(c[-1]), int(w[-1]), len(c)]
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "c0", "w0", "c1", "w1", "n"])


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in 32 bits where all of a shard's fit, else in 64."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 2**32 else counts.astype(np.int64)


def _columns(batches) -> list[np.ndarray]:
    held = list(batches)
    return [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(held[0].num_columns)] if held else []


def train(docs: DataFrame, text: str = "text", order: int = 3, least: int = 2, discount: float = 0.7, per_shard: int = 1_000_000) -> Trie:
    """Counts and builds the trie of the texts of docs, of n-grams of up to `order` words (1 to 3)."""
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    with small_batches(docs.sparkSession):
        root = new_path(docs.sparkSession, "trie")
        trie = _counted(docs.select(text), per_shard, root)
        ids = written(encoded(docs.select(F.lit(0).alias("doc_id"), text), trie.vocabulary, "doc_id", text, least).select("ids"), "ids")
        return _grown(trie, ids, order, least, discount, per_shard, root)


def _counted(docs: DataFrame, per_shard: int, root: str) -> Trie:
    """The trie of the words of docs (text), without levels."""

    def count_words(batches):
        seen: Counter = Counter()

        def out():
            h = np.fromiter(map(xxh3_64_intdigest, seen.keys()), np.uint64, len(seen)).view(np.int64)
            r = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["h", "c"])
            seen.clear()
            return r

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(words(t))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield out()
        yield out()

    counted = written(docs.mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    tokens = counted.agg(F.sum("c")).first()[0] or 0

    def write_words(batches):
        cols = _columns(batches)
        if cols and len(cols[0]):
            o = np.argsort(cols[0])
            cols = [x[o] for x in cols]
            save(path := f"{root}/words-{uuid.uuid4().hex}", {"hashes": cols[0], "counts": cols[1]})
            yield _told(path, cols[0], np.zeros(len(cols[0]), np.int64))

    vocabulary = Vocabulary(_shards(counted, counted.count(), ["h"], ["h", "c"], per_shard, write_words), tokens)
    end_hash = int(np.array([xxh3_64_intdigest(END)], np.uint64).view(np.int64)[0])
    starts = counted.where(F.col("h") == end_hash).agg(F.sum("c")).first()[0] or 0
    return Trie(vocabulary, [], starts)


def _grown(trie: Trie, ids: DataFrame, order: int, least: int, discount: float, per_shard: int, root: str) -> Trie:
    for k in range(1, order):
        trie.levels.append(_level(ids, trie, k, least, discount, per_shard, root))
    return trie


#: An odd factor deals numbers out by their upper bits; its inverse brings them back.
_DEAL = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_DEAL), -1, 1 << 64))


def packed(keys: np.ndarray, parts: int) -> pa.RecordBatch:
    """part, keys, counts: the distinct keys, times _DEAL, that are in each of `parts` ranges, ascending, and how often each is there."""
    keys, counts = np.unique(keys * _DEAL, return_counts=True)
    counts = counts.astype(np.uint32)
    ends = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, ends), [len(keys)]])
    full = np.nonzero(cuts[1:] > cuts[:-1])[0]
    runs = [slice(cuts[k], cuts[k + 1]) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.array([x[r].tobytes() for r in runs], pa.binary()) for x in (keys, counts)]], ["part", "keys", "counts"])


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The keys, still times _DEAL, and counts of packed rows."""
    keys, counts = (b"".join(b.column(k).to_pylist()) for k in (1, 2))
    return np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)


def summed(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, brought back, of `least` or more in all, with their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    at = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else order
    n = np.add.reduceat(counts, at) if len(at) else counts
    often = n >= least
    return (keys[at][often] * _BACK).view(np.int64), n[often]


def _level(docs: DataFrame, trie: Trie, k: int, least: int, discount: float, per_shard: int, root: str) -> Level:
    """Counts and writes the n-grams of order k + 1 of docs (ids)."""

    def seen(ctx: np.ndarray) -> np.ndarray:
        """The counts of contexts."""
        if k > 1:
            return trie.levels[k - 2].counts_of(ctx)
        return np.where(ctx == trie.vocabulary.size, trie.starts, trie.vocabulary.counts_of(np.where(ctx == trie.vocabulary.size, -1, ctx)))

    def cut(ctx: np.ndarray, w: np.ndarray) -> np.ndarray:
        """w where the context's n-grams may be many, so that shards can divide them; else -1.  m n-grams make a context's count m * least or more."""
        return np.where(seen(ctx) >= least * max(1, per_shard // 8), w, -1)

    def marked(batches):
        for b in batches:
            ctx, w = (b.column(j).to_numpy() for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cut(ctx, w))], [*names, "cut"])

    def count(batches):
        held, n = [], 0

        def merged():
            """Equal keys summed."""
            c, w = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            o = np.lexsort((w, c))
            c, w = c[o], w[o]
            at = np.nonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])))[0] if len(c) else o
            return [c[at], w[at], np.diff(np.append(at, len(c)))]

        def out():
            if wide:
                return pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names)
            c, w = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            return packed((c * span + w).view(np.uint64), parts)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                t = _Batch(b.column(0).slice(at, 500), trie, least)
                if k == 1:
                    use = np.nonzero(t.often & t.led)[0]
                    ctx = t.before[use]
                else:
                    for last, _, pos, _, _ in t.walk(trie):
                        kept = last[pos >= 0]
                    use, ctx = t.next
                    inside = np.isin(use, kept, assume_unique=True)
                    use, ctx = use[inside], ctx[inside]
                held.append((ctx, t.ids[use]))
                n += len(use)
                if n > 1_500_000:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def total(batches):
        held = [unpacked(b) for b in batches]
        if held:
            keys, n = summed(*(np.concatenate(x) for x in zip(*held)), least)
            ctx, w = keys // span, keys % span
            for at in range(0, len(keys), 200_000):
                here = [x[at : at + 200_000] for x in (ctx, w, n)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*here, cut(*here[:2]))], [*names, "cut"])

    names = ["ctx", "w", "c"]
    kinds = ", ".join(f"{x} long" for x in [*names, "cut"])
    parts = 8 * max(1, -(-trie.vocabulary.tokens // 1_500_000))
    span = trie.vocabulary.size + 1
    wide = (trie.vocabulary.size if k == 1 else sum(s.size for s in trie.levels[-1].shards)) * span >= 2**63  # then keys don't fit one number
    if wide:
        grams = docs.mapInArrow(count, ", ".join(f"{x} long" for x in names)).groupBy("ctx", "w").agg(F.sum("c").alias("c")).where(F.col("c") >= least).mapInArrow(marked, kinds)
    else:
        # most n-grams are seen once: they go to where they are counted in runs of many to a row
        grams = docs.mapInArrow(count, "part int, keys binary, counts binary").repartition(-(-parts // 8), "part").mapInArrow(total, kinds)
    kept = written(grams, f"grams{k + 1}")
    many = written(kept.where("cut >= 0").groupBy("ctx").agg((F.sum("c") - F.count("*") * discount).alias("mass")), "mass")
    rows = kept.join(sized(many, many.count()), "ctx", "left").select("ctx", "w", "c", "mass", "cut")

    def write(batches):
        cols = _columns(batches)
        if not cols or not len(cols[0]):
            return
        o = np.lexsort(cols[1::-1])
        ctx, w, c, mass = (x[o] for x in cols)
        total = np.maximum(seen(ctx), 1)
        at = np.nonzero(np.append(True, ctx[1:] != ctx[:-1]))[0]
        size = np.diff(np.append(at, len(ctx)))
        mass = np.where(np.isnan(mass.astype(float)), np.repeat(np.add.reduceat(c, at) - size * discount, size), mass.astype(float))
        rest = np.maximum(1 - mass / total, 1e-6)
        lower = trie.vocabulary.log10(trie.vocabulary.counts_of(w))
        if k > 1:  # of the same word after the context without its first word; that n-gram was kept too
            pos, prob, back = trie.levels[0].find(trie.levels[0].words_of(ctx), w)
            lower = np.where(pos >= 0, prob, back + lower)
        prob = np.log10((c - discount) / total + rest * 10.0**lower)
        base, span = int(ctx[0]), int(ctx[-1] - ctx[0]) + 1
        places = np.searchsorted(ctx, np.arange(base, base + span + 1))
        first = places[:-1]
        backs = np.where(places[1:] > first, np.log10(rest[np.minimum(first, len(ctx) - 1)]), 0.0)
        probs, prob_book = quantised(prob)
        back, back_book = quantised(backs)
        kind = np.uint32 if trie.vocabulary.size < 2**32 else np.int64
        save(path := f"{root}/level{k}-{uuid.uuid4().hex}", ef_build(places) | {"words": w.astype(kind), "probs": probs, "prob_book": prob_book, "back": back, "back_book": back_book, "counts": narrow(c)})
        yield _told(path, ctx, w)

    return Level(_shards(rows, kept.count(), ["ctx", "cut"], ["ctx", "w", "c", "mass"], per_shard, write))


def score(docs: DataFrame, trie: Trie, doc_id: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return _scored(encoded(docs, trie.vocabulary, doc_id, text, least), trie, least)


def _scored(rows: DataFrame, trie: Trie, least: int) -> DataFrame:
    """The scores of encoded rows."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, base = part.num_rows, part.column(3)
                full = base
                if trie.levels:
                    t = _Batch(part.column(4), trie, least)
                    full = pa.array(np.bincount(t.doc, score_batch(t, trie), n))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(n, trie.vocabulary.tokens, np.int64)), base, full], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.select("doc_id", "n_tokens", "n_known", "base_score", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Remainder 2 of crc32(doc_id as text) mod 7: never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, order: int = 3, least: int = 2, discount: float = 0.7, per_shard: int = 1_000_000) -> DataFrame:
    root = new_path(docs.sparkSession, "trie")
    with small_batches(docs.sparkSession):
        trie = _counted(docs.where(~held_out()).select("text"), per_shard, root)
        rows = written(encoded(docs, trie.vocabulary, least=least), "ids")
        _grown(trie, rows.where(~held_out()).select("ids"), order, least, discount, per_shard, root)
    return _scored(rows, trie, least).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
