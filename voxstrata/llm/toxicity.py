"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents; the CRF needs labelled tokens.  Tokens of a bounded
sample of labelled rows (at most ``sample_docs`` of them and ``sample_bytes`` of text, by hash of the id) get label 1 where
the token's odds of lying in a toxic document are high and it is in at least
``least_share`` of the toxic ones, near copies counted once.  Weights of tokens, bias and transitions are
fitted on the sample's lines; forward-backward gives each token's marginal.  A
document's score is a logistic function of its largest marginal and of the sum
of its marginals, fitted on the same sample; offending tokens are those whose
marginal is at least ``span_at``, with character offsets.

Every whole text is scored in the tasks; only the fitted weights are shipped,
at most ``features`` of them.

Defined cases: null and empty texts have no tokens and get the score of a text
without marginals; a null label is no label; a doc_id with several labels counts
as toxic if any says so; without labels of both kinds every score is 0; rows may
repeat, each gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.llm.common import small_batches, with_key, written
from voxstrata.llm.components import sized
from voxstrata.llm.words import shingles_at

_EDGE = b".,;:!?\"'()[]{}<>*#%&|-_/"


def token(word: bytes) -> bytes:
    return word.strip(_EDGE)


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    steps: np.ndarray  # steps[i, j]: score of going from tag i to tag j
    link: tuple[float, float, float]  # of the score: intercept, largest marginal, log1p of their sum
    fitted: bool = True


class Weights(dict):
    def __init__(self, model: Model, most: int = 500_000):
        self.of, self.bias, self.most = model.weights, model.bias, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        w = self[word] = self.of.get(token(word), 0.0) + self.bias
        return w


def messages(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each token of many chains, laid end to end; scores: of tag 1 against tag 0.

    Both keep the log ratio of the two tags; all chains that still have tokens move a step at a time.
    """
    if not len(scores):
        return scores, scores
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    forth, back = np.empty_like(scores), np.zeros_like(scores)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # chains longer than t
    at = starts[: live[0]]
    a = forth[at] = scores[at]
    for t in range(1, lengths[0]):
        n = live[t]
        at, a = starts[:n] + t, a[:n]
        a = scores[at] + np.logaddexp(steps[0, 1], steps[1, 1] + a) - np.logaddexp(steps[0, 0], steps[1, 0] + a)
        forth[at] = a
    for t in range(lengths[0] - 2, -1, -1):
        n = live[t + 1]
        nxt = starts[:n] + (t + 1)
        x = scores[nxt] + back[nxt]
        back[nxt - 1] = np.logaddexp(steps[1, 0], steps[1, 1] + x) - np.logaddexp(steps[0, 0], steps[0, 1] + x)
    return forth, back


def marginals(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """P(tag 1) of each token."""
    forth, back = messages(scores, lengths, steps)
    return 1 / (1 + np.exp(-(forth + back)))


def pair_marginals(scores: np.ndarray, forth: np.ndarray, back: np.ndarray, steps: np.ndarray, at: np.ndarray) -> np.ndarray:
    """P(tag i, then tag j) of the tokens at `at` and their successors: rows 00, 01, 10, 11."""
    a, x = forth[at], scores[at + 1] + back[at + 1]
    e = np.stack([np.full(len(at), steps[0, 0]), steps[0, 1] + x, steps[1, 0] + a, steps[1, 1] + a + x])
    e = np.exp(e - e.max(0))
    return e / e.sum(0)


def chains(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each line with any, and the text that each line is of."""
    lines, owner = [], []
    for k, t in enumerate(texts):
        for line in (t or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
            if w := line.split():
                lines.append(w)
                owner.append(k)
    return lines, np.array(owner, dtype=np.int64)


def _summed(p: np.ndarray, lengths: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and sum of the marginals of each of n texts."""
    most, total = np.zeros(n), np.zeros(n)
    if len(p):
        doc = np.repeat(owner, lengths)
        np.maximum.at(most, doc, p)
        total = np.bincount(doc, p, n)
    return most, total


def _apart(cols: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of texts as word numbers: which have none before them, of the same label, with one of four minima of three-word shingles in common."""
    seen: set[tuple] = set()
    out = np.ones(len(cols), bool)
    for k, col in enumerate(cols):
        if not len(col):
            continue
        h = shingles_at(col.astype(np.uint64), 3)
        keys = {(j, int(y[k]), int((h ^ np.uint64(seed)).min())) for j, seed in enumerate((0, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA, 0x3333333333333333))}
        out[k] = not keys & seen
        seen |= keys
    return out


def fit(texts: list[str], toxic: list[int], features: int = 50_000, least_share: float = 0.02, odds: float = 20.0, rounds: int = 40) -> Model:
    """Fits the model to a sample of texts with labels; numpy only, in the driver, on a bounded sample."""
    y = np.array(toxic)
    if len(set(toxic)) < 2:  # also without any rows
        return Model({}, 0.0, np.zeros((2, 2)), (0.0, 0.0, 0.0), False)
    ids: dict[bytes, int] = {}
    cols, owners, sizes = [], [], []
    for k, t in enumerate(texts):  # one text's words at a time: only numbers are kept
        lines, _ = chains([t])
        sizes += [len(x) for x in lines]
        owners += [k] * len(lines)
        cols.append(np.array([ids.setdefault(token(w), len(ids)) for x in lines for w in x], dtype=np.int64))
    col, owner, lengths = np.concatenate(cols), np.array(owners, np.int64), np.array(sizes, np.int64)
    docs = np.repeat(owner, lengths)
    pair = np.unique(docs * len(ids) + col)
    pair = pair[_apart(cols, y)[pair // len(ids)]]  # a group of near copies counts once
    d, c = pair // len(ids), pair % len(ids)
    bad, good = np.bincount(c, y[d], len(ids)), np.bincount(c, 1 - y[d], len(ids))
    toxic_docs = len(np.unique(d[y[d] == 1]))
    share = (bad + 0.5) / (toxic_docs + 1) / ((good + 0.5) / (len(np.unique(d)) - toxic_docs + 1))
    listed = (share >= odds) & (bad >= max(3, least_share * toxic_docs))
    tags = listed[col] & (y[docs] == 1)
    # weights only of the most frequent tokens and the listed ones
    rank = np.argsort(-(bad + good + 1e9 * listed), kind="stable")[:features]
    slot = np.full(len(ids), -1)
    slot[rank] = np.arange(len(rank))
    f = slot[col]
    known = f >= 0
    x = np.zeros(len(rank) + 4)  # weights, bias, steps 01, 10, 11 (00 is 0)
    x[-4] = -3.0
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    ends = np.cumsum(lengths)
    inner = np.ones(len(col), bool)
    inner[ends - 1] = False
    here = np.nonzero(inner)[0]
    for k in range(1, rounds + 1):
        steps = np.array([[0, x[-3]], [x[-2], x[-1]]])
        s = np.where(known, x[f], 0.0) + x[-4]
        forth, back = messages(s, lengths, steps)
        g = 1 / (1 + np.exp(-(forth + back))) - tags
        grad = np.concatenate([np.bincount(f[known], g[known], len(rank)), [g.sum(), 0, 0, 0]])
        t0, t1 = tags[here], tags[here + 1]
        grad[-3:] = pair_marginals(s, forth, back, steps, here)[1:].sum(1) - [(~t0 & t1).sum(), (t0 & ~t1).sum(), (t0 & t1).sum()]
        grad += 0.01 * x
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        x -= 0.5 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-6)
    steps = np.array([[0, x[-3]], [x[-2], x[-1]]])
    p = marginals(np.where(known, x[f], 0.0) + x[-4], lengths, steps)
    most, total = _summed(p, lengths, owner, len(texts))
    z = np.stack([np.ones(len(y)), most, np.log1p(total)], 1)
    w = np.zeros(3)
    for _ in range(30):  # Newton
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (q * (1 - q) + 1e-6)) @ z + 0.05 * np.eye(3), z.T @ (q - y) + 0.05 * w)
    back = {i: w for w, i in ids.items()}
    return Model({back[i]: float(x[slot[i]]) for i in rank.tolist()}, float(x[-4]), steps, tuple(map(float, w)))


def fit_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample_docs: int = 2000, sample_bytes: int = 32 << 20, **options) -> Model:
    """Fits on at most sample_docs labelled rows, up to half of them toxic, chosen by hash of the id, and as many as sample_bytes of text allow."""
    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("__y"))
    pick = lambda y, n: one.where(F.col("__y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(n)
    chosen = pick(1, sample_docs // 2).unionByName(pick(0, sample_docs // 2))
    rows = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    order = [F.xxhash64(doc_id), F.col(doc_id), F.xxhash64(text)]
    sizes = rows.select(F.xxhash64(doc_id, text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"), *[c.alias(f"o{k}") for k, c in enumerate(order)]).orderBy("o0", "o1", "o2").limit(sample_docs).select("h", "n").collect()
    within = [r.h for r, total in zip(sizes, accumulate(r.n for r in sizes)) if total <= sample_bytes]
    if not within:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame([(h,) for h in set(within)], "__h long")  # at most sample_docs numbers
    got = rows.withColumn("__h", F.xxhash64(doc_id, text)).join(F.broadcast(ids), "__h", "left_semi").orderBy(*order).limit(len(within)).collect()
    return fit([r[text] or "" for r in got], [int(r["__y"]) for r in got], **options)


class Scorer:
    """Scores of texts by a model; keeps the weights of the words met lately."""

    def __init__(self, model: Model):
        self.model, self.of = model, Weights(model).__getitem__

    def __call__(self, texts: list[str | None]):
        """Scores; and of all tokens laid end to end the lines' owners, their lengths and the marginals."""
        lines, owner = chains(texts)
        lengths = np.array([len(x) for x in lines], dtype=np.int64)
        s = np.fromiter((self.of(w) for x in lines for w in x), np.float64, int(lengths.sum()))
        p = marginals(s, lengths, self.model.steps)
        most, total = _summed(p, lengths, owner, len(texts))
        c = self.model.link
        q = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * most + c[2] * np.log1p(total), -30, 30))) if self.model.fitted else np.zeros(len(texts))
        return q, owner, lengths, p


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", span_at: float = 0.5, spans: bool = True) -> DataFrame:
    """doc_id, score, predicted, and (spans) the offending tokens as array of (start, end, token, p), of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("p", pa.float64())]))

    def run(batches):
        scorer = Scorer(shipped.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column(1).to_pylist()
                q, owner, lengths, p = scorer(texts)
                out = [part.column(0), pa.array(q, pa.float64()), pa.array((q >= 0.5).astype(np.int32), pa.int32())]
                if spans:
                    out.append(pa.array(_spans(texts, owner, lengths, p, span_at), span))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted", "spans"][: len(out)])

    schema = f"doc_id {kind}, score double, predicted int" + ", spans array<struct<start:int,end:int,token:string,p:double>>" * spans
    return docs.select(doc_id, text).mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs whose own text scores under 0.5; learns from rows that aren't held out only.

    Only the keys of the others are written, and joined back: as a broadcast where they are few."""
    model = fit_sample(docs, labels.where(~held_out(doc_id)), doc_id, text, label)
    keyed, key = with_key(docs, doc_id)
    with small_batches(docs.sparkSession):
        bad = written(score(keyed, model, key, text, spans=False).where("predicted = 1").select(F.col("doc_id").alias(key)), "toxic")
    return keyed.join(sized(bad, bad.count()), key, "left_anti").select(docs.columns)


def _spans(texts, owner, lengths, p, span_at):
    """Character offsets of the tokens whose marginal is at least span_at."""
    out: list[list[dict]] = [[] for _ in texts]
    hit = np.nonzero(p >= span_at)[0]
    if not len(hit):
        return out
    docs = np.repeat(owner, lengths)
    first = np.searchsorted(docs, np.arange(len(texts)))
    for k in np.unique(docs[hit]).tolist():
        raw = texts[k].encode("utf-8", "surrogatepass")
        want = {int(i) - int(first[k]): float(p[i]) for i in hit[docs[hit] == k]}
        at, last, chars = 0, max(want), 0
        done = 0
        for i, w in enumerate(raw.split()):
            at = raw.index(w, at)
            if i in want:
                chars += len(raw[done:at].decode("utf-8", "replace"))
                done = at
                n = len(w.decode("utf-8", "replace"))
                out[k].append({"start": chars, "end": chars + n, "token": w.decode("utf-8", "replace"), "p": want[i]})
            at += len(w)
            if i == last:
                break
    return out


def held_out(doc_id: str = "doc_id"):
    """Remainder 0 of crc32(doc_id as text) mod 5: never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from rows that aren't held out only."""
    model = fit_sample(docs, labels.where(~held_out()), "doc_id", "text", "toxic")
    got = score(docs, model, spans=spans)
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted", *["spans"] * spans)
