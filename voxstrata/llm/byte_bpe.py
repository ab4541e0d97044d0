"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Each adjacent pair that the vocabulary
can merge waits in the bucket of its rank, as the position of its left part.
A two-level bitmap tells which buckets hold positions: the first set bit of the
summary names a word, the first set bit of that word names the lowest rank.
A merge changes at most two pairs; positions whose pair has changed since are
stale and are skipped when they come up.  A pre-token of n bytes takes O(n) queue
steps; a bucket hands out its leftmost position first, so that a step may cost
O(log n) where very many positions share a rank.

Defined cases: a null text counts as empty, an empty text gives no ids; ids of
rows may be null or repeat, each row gives one row; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_BITS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merges the leftmost pair of the lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts at i ends
    before = list(range(-1, n))  # where the part before it starts
    rank_at = [-1] * n  # the rank that the pair at i waits under
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    summary = 0
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            rank_at[i] = r
            if r in buckets:
                buckets[r].append(i)  # ascending, thus a heap
            else:
                buckets[r] = [i]
                w = r // _BITS
                low[w] = low.get(w, 0) | 1 << r % _BITS
                summary |= 1 << w
    while summary:
        w = (summary & -summary).bit_length() - 1
        bits = low[w]
        r = w * _BITS + (bits & -bits).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            low[w] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
        if rank_at[i] != r:
            continue  # stale
        j = end[i]
        k = end[i] = end[j]
        rank_at[j] = -1
        if k < n:
            before[k] = i
        left = before[i]
        for a, z in ((i, end[k] if k < n else 0), (left, k)):
            if a < 0:
                continue
            new = get(piece[a:z]) if z else None
            if new is None:
                rank_at[a] = -1
                continue
            rank_at[a] = new
            if new in buckets:
                heappush(buckets[new], a)
            else:
                buckets[new] = [a]
                x = new // _BITS
                low[x] = low.get(x, 0) | 1 << new % _BITS
                summary |= 1 << x
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def splitter(pattern: str):
    """The pattern as the tiktoken library reads it: there \\s is Unicode's White_Space, without U+001C to U+001F."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class Encoder:
    """Text -> ids as little-endian 32-bit integers.  Pre-tokens are cached in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 300_000, longest: int = 64):
        self.ranks, self.find, self.most, self.longest = ranks, splitter(pattern).findall, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.vocabulary = {i: b for b, i in ranks.items()}

    def _miss(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = merge_ids(piece.encode("utf-8"), self.ranks)
            ids = b"".join([i.to_bytes(4, "little") for i in found])
        if len(piece) <= self.longest:
            if len(self.young) >= self.most:
                self.young, self.old = {}, self.young
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out = []
        for p in self.find(text):
            ids = self.young.get(p)
            out.append(ids if ids is not None else self._miss(p))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker; its cache outlives a task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), ids_sha256, decoded, decoded_sha256 of every row; digests_only leaves ids and decoded out."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids array<int>, decoded string")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ([] if digests_only else ["ids", "decoded"])

    def run(batches):
        enc = encoder(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):  # bounds what a batch of long texts holds
                part = b.slice(at, 500)
                ids = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                back = [enc.decode(x) for x in ids]
                out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, back), pa.string())]
                if not digests_only:
                    out += [pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in back], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of rows with token ids; null ids give an empty text."""
    kind = rows.schema[doc_id].dataType.simpleString()

    def run(batches):
        of = encoder(ranks_path, pattern).vocabulary.__getitem__
        for b in batches:
            texts = [b"".join(map(of, x or [])).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(doc_id, ids).mapInArrow(run, f"doc_id {kind}, text string")
