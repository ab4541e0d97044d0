"""Token counts by a map-side two-tier lookup.

No piece of the vocabulary crosses a word's start or a line feed, so a text's
count is the sum of its pre-tokens' counts.  The first tier is a compact table
of the corpus's most frequent pre-tokens and their lengths, broadcast to all
workers; what it lacks is encoded once and kept in each worker's bounded cache.
No pre-token is shuffled: the table comes from one compact table of each partition,
of its own most frequent pre-tokens, at most ``per_partition`` of them; these tables
are merged in ``MERGERS`` tasks and then in the driver, which gets at most
``MERGERS * entries`` entries.

Defined cases: a null text counts as empty, an empty text has 0 tokens; ids may
be null or repeat, each row gives one row; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SPACE = "▁"
#: Tasks that merge the partitions' tables.
MERGERS = 16
_PARTS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each with its leading spaces or line feed; the first gets the space that the model puts before a text."""
    return _PARTS.findall(" " + text.replace(SPACE, " ")) if text else []


class Lengths(dict):
    """Pre-token -> number of tokens, a bounded cache over the model and the broadcast table."""

    def __init__(self, model_path: str, frequent: dict[str, int], most: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in map(model.id_to_piece, range(model.get_piece_size()))):
            raise ValueError("a piece of this model crosses a word's start or a line feed")
        self.model, self.frequent, self.most = model, frequent, most

    def __missing__(self, part: str) -> int:
        n = self.frequent.get(part)
        if n is None:
            if part == " ":
                n = 1
            elif part[0] == " ":
                n = len(self.model.encode(part[1:], num_threads=1))
            else:  # without the space that the model puts before a text
                n = len(self.model.encode(part, num_threads=1)) - 1
        if len(self) >= self.most:
            self.clear()
        self[part] = n
        return n


class Frequent(Counter):
    """Counts of the most frequent keys; the rest is dropped when there are too many."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def add(self, counts) -> None:
        self.update(counts)
        if len(self) > 40 * self.most:
            kept = self.most_common(10 * self.most)
            self.clear()
            self.update(dict(kept))

    def batch(self, chunk: int) -> pa.RecordBatch:
        """One row: the compact table."""
        top = sorted(self.items(), key=lambda x: (-x[1], x[0]))[: self.most]
        lists = pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[v for _, v in top]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *lists], ["chunk", "parts", "n"])


def frequent_lengths(docs: DataFrame, model_path: str, text: str = "text", entries: int = 50_000, per_partition: int = 10_000) -> dict[str, int]:
    """Lengths of about the `entries` most frequent pre-tokens of all documents."""
    schema = "chunk int, parts array<string>, n array<long>"

    def count(batches):
        seen = Frequent(per_partition)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.add(pretokens(t))
        yield seen.batch(TaskContext.get().partitionId() % MERGERS)

    def merge(batches):
        seen = Frequent(entries)
        for b in batches:
            for parts, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                seen.add(dict(zip(parts, n)))
        if seen:
            yield seen.batch(0)

    whole = Frequent(entries)
    for r in docs.select(text).mapInArrow(count, schema).repartition(MERGERS, "chunk").mapInArrow(merge, schema).collect():
        whole.add(dict(zip(r.parts, r.n)))
    of = Lengths(model_path, {})
    top = sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:entries]
    return {k: of[k] for k, _ in top if len(k) <= 64}


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, entries: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model_path, text, entries))

    def run(batches):
        of = Lengths(model_path, frequent.value).__getitem__
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [sum(map(of, pretokens(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
