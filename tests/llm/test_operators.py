"""The ten operators against brute force, and their defined cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.llm import byte_bpe, components, cover_tree, decontaminate, line_dedup, lm_trie, ngram_join, token_counts, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, n long, links string, key long"


def docs(spark, texts, ids=None):
    """A table with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in zip(ids, texts)], SCHEMA)


def sample(n=60, seed=0, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n // 3)]
    for t in list(texts):
        for _ in range(2):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    return texts + [texts[0], texts[0], "", None, "one two", "ONE two", "Ä ä"]


def brute_classes(texts, size, per_cent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size,per_cent,seed", [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_ngram_join_equals_brute_force(spark, size, per_cent, seed):
    texts = sample(90, seed)
    got = {r.doc_id: r for r in ngram_join.link_documents(docs(spark, texts), size, per_cent).collect()}
    want, n = brute_classes(texts, size, per_cent)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == n


def test_ngram_join_defined_cases(spark):
    assert ngram_join.link_documents(docs(spark, []), 3, 90).count() == 0
    t = "a b c d e f"
    got = ngram_join.link_documents(docs(spark, [t, t, t, "", None], [None, 4, 4, 8, 9]), 3, 90).collect()
    assert sorted((r.doc_id is None, r.component_id or 0) for r in got) == [(False, 4), (False, 4), (False, 8), (False, 9), (True, 0)]


def test_ngram_join_of_passages_and_groups(spark):
    """A passage that all hold, a large group of near copies, a long text: whatever the blocks' sizes, groups equal brute force."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, base = " ".join(word() for _ in range(30)), [word() for _ in range(60)]
    texts = [passage + " " + " ".join(word() for _ in range(25)) for _ in range(40)]
    for _ in range(40):
        w = list(base)
        for k in range(rng.randrange(3)):
            w[k * 20 + rng.randrange(20)] = word()
        texts.append(" ".join(w))
    long = [word() for _ in range(20_000)]
    texts += [" ".join(long), " ".join(long[:-300]), " ".join(long[:10_000])]
    for most in (2, 64):
        got = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs(spark, texts), 3, 80, most=most).collect()}
        assert [got[i] for i in range(len(texts))] == brute_classes(texts, 3, 80)[0]


def test_components_of_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(200, 300)], "a long, b long")
    assert {r.node: r.component for r in components.components(e).collect()} == {i: 0 for i in range(81)} | {200: 200, 300: 200}


def test_url_filter_rules_and_false_positives(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/?q", "http://x.com", "http://x.com/", "http://notexample.com/en/x", "http://b.net/es/1#f", "http://b.net/esx", None, "nothing", "ftp://example.com/en/a?b#c", "http://net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    again = pages.unionByName(pages).withColumn("page_id", F.when(F.col("page_id") != 3, F.col("page_id")))  # rows that repeat, a null id, a very long host
    long = spark.createDataFrame([(50, "http://" + "a." * 5000 + "net/es/" + "x" * 9000)], "page_id long, url string")
    got = url_filter.filter_urls(again.select("page_id", "url").unionByName(long), spark.createDataFrame(url_filter.RULES, "rule string, verdict string")).collect()
    assert len(got) == 2 * len(urls) + 1 and [(r.rule, r.verdict) for r in got if r.page_id == 50] == [("net/es/", "block")]
    assert [(r.rule, r.verdict) for r in got if r.page_id is None] == [("com/", "allow")] * 2 and len([r for r in got if r.page_id == 0]) == 2
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    for blocks in (1, 64):  # one block: the Bloom filter passes nearly all, the join must still be exact
        got = {r.page_id: r for r in url_filter.filter_urls(pages, rules, blocks=blocks).collect()}
        assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
            ("www.example.com/en/", "allow"), ("example.com/en/", "block"), (None, "allow"), ("com/", "allow"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/en/", "block"), ("net/fr/", "block"),
        ]
        assert (got[7].host, got[7].path, got[0].host) == ("", "", "www.example.com")
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cover_tree_is_exact(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 12))
    x = centres[rng.integers(0, 5, 700)] + spread * rng.normal(size=(700, 12))
    x[600:650] = x[:50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 12), (903, []), (None, [1.0] * 12), (904, [2.0] * 3), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    df = df.withColumns({c: F.lit(1) for c in ("ids", "vs", "side", "g", "score")})
    for r in cover_tree.top_k(df, df.where("vec_id % 50 = 0"), 5, block_rows=200, group_bytes=1000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    got.pop(50)  # the id that repeats
    q = np.floor(256 * x).astype(int)
    for i in set(range(0, 700, 50)) - {50}:
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in [*range(700), 50] if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -m) for k, (m, j) in enumerate(best)]
    assert set(got) == set(range(0, 700, 50)) - {50}
    assert cover_tree.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(3)
    centres = 1000 * rng.normal(size=(40, 64))
    x = np.floor(np.repeat(centres, 100, 0) + 20 * rng.normal(size=(4000, 64)))[rng.permutation(4000)]
    x[:30] = x[30]  # rows that repeat
    tree, seen = cover_tree.build(x), 0
    todo = [tree]
    while todo:
        n = todo.pop()
        seen += len(n.own)
        d = np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1))
        assert d.max() <= 2.0**n.level * (1 + 1e-9) and np.isclose(d.max(), n.radius)
        assert sorted(n.rows) == sorted(np.concatenate([n.own, *[c.rows for c in n.children]]))
        if n.children:  # covering, separation and nesting
            assert any((c == n.centre).all() for c in n.parts)
            top = 2.0 ** max(c.level for c in n.children)
            apart = np.sqrt(((n.parts[:, None] - n.parts) ** 2).sum(2))
            np.fill_diagonal(apart, np.inf)
            assert apart.min() > max(c.radius for c in n.children) / 2 and top < 2.0 ** (n.level + 1)
            todo += n.children
    assert seen == 4000
    ids = np.arange(4000)
    best = cover_tree.Best(ids[::50], 5)
    qx = x[::50]
    cover_tree.search(cover_tree.build(qx), qx, tree, x, ids, best)
    s = qx @ x.T
    s[np.arange(80), ids[::50]] = -np.inf
    assert (best.score == -np.sort(-s, 1)[:, :5]).all()
    assert best.products < 0.25 * s.size  # whole clusters are dropped by their bounds


def test_crf_messages_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, steps = rng.normal(size=7), rng.normal(size=(2, 2))
    lengths = np.array([4, 1, 2])
    got, at = toxicity.marginals(scores, lengths, steps), 0
    for n in lengths:
        mass, total = np.zeros(n), 0.0
        for bits in range(2**n):
            y = [bits >> k & 1 for k in range(n)]
            e = math.exp(sum(scores[at + k] for k in range(n) if y[k]) + sum(steps[a, b] for a, b in zip(y, y[1:])))
            mass += np.array(y) * e
            total += e
        assert np.allclose(got[at : at + n], mass / total)
        at += n


def test_toxicity_scores_and_spans(spark):
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(300):
        w = [rng.choice(clean) for _ in range(30)]
        if i % 3 == 0:
            for _ in range(2):
                w[rng.randrange(30)] = rng.choice(["Idiot!", "scum"])
        texts.append(" ".join(w[:15]) + "\n" + "é " + " ".join(w[15:]))
        labels.append((i, int(i % 3 == 0)))
    df = docs(spark, texts + ["", None], list(range(302)))
    lab = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, lab, spans=True).collect()}
    for i in range(300):
        assert got[i].predicted == int(i % 3 == 0)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        for s in got[i].spans:
            assert texts[i][s.start : s.end] == s.token and s.token in ("Idiot!", "scum")
    assert got[300].predicted == got[301].predicted == 0 and got[300].score == got[301].score
    assert {r.score for r in toxicity.score_documents(df, lab.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_documents(df.limit(0), lab).count() == 0
    # each row by its own text: ids that repeat or are null, a very long text and a very long line
    odd = docs(spark, [texts[0], texts[1], texts[1], texts[0], "w1 " * 40_000, "w1\n" * 5000 + "scum scum"], [7, 7, 7, None, 8, 9]).unionByName(df.where("doc_id is not null"))
    left = toxicity.clean(odd, lab)
    assert left.columns == odd.columns and sorted(r.text or "" for r in left.collect()) == sorted([texts[1], texts[1], "w1 " * 40_000, "", ""] + [t for i, t in enumerate(texts) if i % 3])


def test_toxicity_on_held_out_labels(spark):
    """Of documents whose labels weren't learnt from: the share of pairs of a toxic and a clean one that the scores put in order.

    Some labels are at odds with the texts: a few documents labelled toxic hold no offensive word."""
    t = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{t}/labels.parquet").collect()}
    got = [r for r in toxicity.score_documents(spark.read.parquet(f"{t}/documents.parquet"), spark.read.parquet(f"{t}/labels.parquet")).collect() if r.held_out and r.doc_id in labels]
    bad, good = ([r.score for r in got if labels[r.doc_id] == y] for y in (1, 0))
    assert len(bad) >= 3 and len(good) >= 30
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.8


@pytest.mark.parametrize("order", [2, 3])
def test_trie_equals_direct_counts(spark, order):
    texts = [t for t in sample(60, 5, 25)]
    df = docs(spark, texts)
    trie = lm_trie.train(df.where(~lm_trie.held_out()), order=order, per_shard=70)
    got = {r.doc_id: r for r in lm_trie.score(df, trie).collect()}
    runs = [[*(t or "").encode().lower().split(), b"</s>"] for t in texts]
    train = [r for i, r in enumerate(runs) if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for r in train for w in r)
    n, v, d = sum(one.values()), len(one), 0.7
    grams = {k: Counter(tuple((["<s>"] + r)[i : i + k]) for r in train for i in range(len(r) + 2 - k)) for k in (2, 3)}
    kept = {2: {g: c for g, c in grams[2].items() if c >= 2}, 3: {g: c for g, c in grams[3].items() if c >= 2}}
    of = lambda g: (len(train) if g == ("<s>",) else one[g[0]]) if len(g) == 1 else kept[2].get(g, 0)
    mass = {k: Counter() for k in (2, 3)}
    for k in (2, 3):
        for g, c in kept[k].items():
            mass[k][g[:-1]] += c - d
    base = lambda w: (one[w] + 1) / (n + v + 1)

    def p(ctx, w):
        if not ctx:
            return base(w)
        k, lower = len(ctx) + 1, p(ctx[1:], w)
        if not mass[k][ctx]:
            return lower
        rest = max(1 - mass[k][ctx] / of(ctx), 1e-6)
        g = (*ctx, w)
        return (kept[k][g] - d) / of(ctx) + rest * lower if g in kept[k] else rest * lower

    for i, r in enumerate(runs):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(r), sum(one[w] > 0 for w in r), n)
        assert abs(got[i].base_score - sum(math.log10(base(w)) for w in r)) < 1e-9
        full = ["<s>", *r]
        want = sum(math.log10(p(tuple(full[max(0, j - order + 1) : j]), full[j])) for j in range(1, len(full)))
        assert abs(got[i].score - want) < 0.02 * len(r) + 0.02  # what the quantisation leaves
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_trie_packs_its_ngrams():
    """N-grams reach the shuffle in runs, and come out of it with all their counts."""
    keys = np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64)
    seen = [np.concatenate([keys[a:b], keys[a:b:3]]) for a, b in ((0, 3000), (1000, 5000), (2000, 2600))]
    rows = [lm_trie.packed(x, 7) for x in seen]
    assert all(r.num_rows == 7 for r in rows)
    want = {k: c for k, c in Counter(np.concatenate(seen).tolist()).items() if c >= 2}
    got = {}
    for part in range(7):
        k, n = lm_trie.summed(*(np.concatenate(x) for x in zip(*[lm_trie.unpacked(r.slice(part, 1)) for r in rows])), 2)
        assert not got.keys() & set(k.tolist())
        got |= dict(zip(k.tolist(), n.tolist()))
    assert got == want
    assert [len(x) for x in lm_trie.summed(*lm_trie.unpacked(lm_trie.packed(keys[:0], 7)), 2)] == [0, 0]


def test_trie_splits_texts_once_and_sums_contexts_in_shards(spark, monkeypatch):
    """Texts are split for the words' counts and for their ids, not again for each order or the scores; only frequent contexts are summed by a join."""
    texts = sample(40, 5, 25)
    df = docs(spark, texts)
    writes, write = {}, lm_trie.written
    monkeypatch.setattr(lm_trie, "written", lambda df, tag: writes.setdefault(tag, []).append((plan := df._jdf.queryExecution().executedPlan().toString(), out := write(df, tag))) or out)
    got = {r.doc_id: r for r in lm_trie.score_documents(df, per_shard=70).collect()}
    assert len(writes["ids"]) == 1 and all("text" not in plan for tag in ("grams2", "grams3") for plan, _ in writes[tag])
    kept, many = writes["grams2"][0][1], writes["mass"][0][1]
    assert 0 < many.count() < kept.select("ctx").distinct().count() / 4
    # the same scores as by the general way, and with shards that hold all
    trie = lm_trie.train(df.where(~lm_trie.held_out()))
    for r in lm_trie.score(df, trie).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (got[r.doc_id].n_tokens, got[r.doc_id].n_known, got[r.doc_id].train_tokens, got[r.doc_id].base_score)
        assert abs(r.score - got[r.doc_id].score) < 0.02 * r.n_tokens + 0.02


def test_trie_without_training_rows(spark):
    df = docs(spark, ["a b", "", None])
    trie = lm_trie.train(df.limit(0))
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in lm_trie.score(df, trie).orderBy("doc_id").collect()] == [(3, 0, 0), (1, 0, 0), (1, 0, 0)]


@pytest.mark.parametrize("n,top", [(1, 0), (5, 3), (1000, 10), (1000, 10**7), (3, 2**40)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    assert (lm_trie.ef_get(lm_trie.ef_build(v), np.arange(n)) == v).all()


def warc_rows(pages):
    """What the contract asks of rows (page_id, url, html), by brute force."""
    out = []
    for page, _, html in pages:
        b = (html or "").encode()
        top = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        revisit = top is not None and (page is None or page < top)
        out.append((page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, True))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    rng = random.Random(3)
    html = ["", None, "x" * 50_000, "é" * 9000, "".join(rng.choice("ab\r\n\0") for _ in range(40_000)), "same", "same", "", "same"]
    rows = [(i, f"http://a/{i}\r\nX: y", h) for i, h in enumerate(html)]
    # rows that repeat, an id with other payloads, nulls in every column
    rows += [rows[6], rows[6], rows[8], (2, None, "a"), (2, "a", None), (2, "b", "x" * 50_000), (1, "c", "x" * 50_000), (None, None, None), (None, "u", "same"), (None, "u", "alone"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "page", "payload", "top", "row", "segment")})
    got = warc.roundtrip(pages, segment_bytes=4096, archive_bytes=30_000).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.valid) for r in got), key=str) == warc_rows(rows)
    least = warc.roundtrip(pages, least_bytes=5).where("record_type = 'revisit'").collect()
    assert {r.payload_bytes for r in least} == {50_000}
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_warc_faults():
    block = warc.HEAD + warc.chunked(b"hello" * 9, 7)
    parts = [(1, None, block[:50]), (3, len(block), block[90:]), (2, None, block[50:90])]
    assert warc.assemble(parts) == b"hello" * 9
    for bad in (parts[:2], [*parts, parts[2]], [parts[0], parts[2], (3, len(block) + 1, block[90:])], [(1, None, warc.HEAD + b"5\r\nab\r\n0\r\n\r\n")]):
        with pytest.raises(ValueError):
            warc.assemble(bad)


def gram_jaccard(a, b, n=5):
    x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("most", [2, 256])
def test_line_dedup_finds_near_lines(spark, most):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(25)) for _ in range(40)]
    near = []
    for line in base:
        w = line.split()
        w[rng.randrange(len(w))] = "zz"
        near.append(" ".join(w))
    texts = ["\n".join(base[i : i + 4]) for i in range(0, 40, 4)] + ["\n".join(["Short", "", *near[i : i + 4], "Short"]) for i in range(0, 40, 4)]
    got = line_dedup.dedup_lines(docs(spark, texts + [None, ""]), most=most).collect()
    kept = {(r.doc_id, r.line_no): r for r in got}
    assert len(kept) == sum(len(t.split("\n")) for t in texts) + 1
    want = [(gram_jaccard(a, b) >= 0.8) for a, b in zip(base, near)]
    found = [not kept[10 + i // 4, 2 + i % 4].kept for i in range(40)]
    assert sum(want) > 30 and sum(w and f for w, f in zip(want, found)) >= 0.95 * sum(want)
    assert not any(f and not w for w, f in zip(want, found))
    assert all(kept[i, k].kept for i in range(10) for k in range(4)) and all(kept[10 + i, k].kept for i in range(10) for k in (0, 1, 6))


def test_line_dedup_texts(spark):
    clash = docs(spark, ["a line that is long enough to be looked at\n" * 2, "x"]).withColumns({"gone": F.lit(1), "_gone": F.lit(2), "line_no": F.lit(3)})
    assert sorted(map(tuple, line_dedup.without_duplicates(clash).select("doc_id", "text", "gone", "_gone", "line_no").collect())) == [(0, "a line that is long enough to be looked at\n", 1, 2, 3), (1, "x", 1, 2, 3)]
    a, b = "this line is long enough to be looked at here", "another line that is long enough to be looked at"
    got = line_dedup.without_duplicates(docs(spark, [a + "\n\n" + b, "x\n" + a, b + "\n" + b, None, "", "Short"]))
    assert {r.doc_id: r.text for r in got.collect()} == {0: a + "\n\n" + b, 1: "x", 3: None, 4: "", 5: "Short"}
    assert got.columns == docs(spark, []).columns and line_dedup.dedup_lines(docs(spark, [])).count() == 0


def edited(rng, line, edits):
    """The line with words changed, apart from each other."""
    w = line.split()
    for k in rng.sample(range(len(w)), min(edits, len(w))):
        w[k] = "".join(rng.choice("klmnopq") for _ in range(len(w[k])))
    return " ".join(w)


@pytest.mark.parametrize("low,high", [(24, 36), (36, 72), (72, 140), (90, 400), (380, 900)])
def test_line_dedup_recall_by_length(spark, low, high):
    rng = random.Random(low)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    lines = []
    while len(lines) < 240:
        line = " ".join(word() for _ in range(high // 4))[: rng.randint(low, high - 2)].strip()
        near = line[:-1] + "x" if len(line) < 36 else edited(rng, line, rng.randint(1, max(1, len(line) // 60)))
        if low <= len(line) < high and gram_jaccard(line, near) >= 0.8:
            lines += [line, near]
    got = {r.doc_id: r.first_doc_id for r in line_dedup.dedup_lines(docs(spark, lines)).collect()}
    assert sum(got[i + 1] == i for i in range(0, 240, 2)) >= 0.98 * 120 and all(got[i] == i for i in range(0, 240, 2))


@pytest.mark.parametrize("chunk", [3, 1000])
def test_line_dedup_large_bands(spark, chunk):
    """A passage that all lines hold, chains of lines where only neighbours are alike, near copies: groups equal brute force, whatever the bands' size."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    passage, lines = " ".join(word() for _ in range(12)), []
    for _ in range(8):
        w = [word() for _ in range(7)]
        for k in range(4):
            w[k] = word()
            lines.append(passage + " " + " ".join(w))
    for _ in range(12):
        w = passage.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        lines.append(" ".join(w))
    lines += ["=" * 300, "=" * 290, "ab " * 200, "=" * 90 + " " + "=" * 90, "ab " * 230]
    up = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if gram_jaccard(lines[i], lines[j]) >= 0.8 and up[i] != up[j]:
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert 8 <= len(set(up)) < 30
    got = {r.doc_id: r.first_doc_id for r in line_dedup.dedup_lines(docs(spark, lines), most=2, chunk=chunk).collect()}
    assert [got[i] for i in range(len(lines))] == up


def test_line_dedup_pairs_of_large_bands(spark, monkeypatch):
    """Lines that the group of a band's leader is nearly like, but not like enough, don't meet all of that group."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(60)]

    def changed(n):
        w = list(base)
        for k in rng.sample(range(60), n):
            w[k] = word()
        return " ".join(w)

    lines = [changed(2) for _ in range(100)] + [changed(9) for _ in range(100)]
    assert all(gram_jaccard(" ".join(base), x) < 0.8 for x in lines[100:])
    pairs, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, tag: (out := write(df, tag), tag == "pairs" and pairs.append(out.count()))[0])
    got = {r.doc_id: r.first_doc_id for r in line_dedup.dedup_lines(docs(spark, lines)).collect()}
    up = list(range(200))
    alike = [(i, j) for i in range(200) for j in range(i) if gram_jaccard(lines[i], lines[j]) >= 0.8]
    for i, j in alike:
        up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    assert [got[i] for i in range(200)] == up and sum(pairs) < 200 * 12 + len(alike)


def test_line_dedup_compares_sets_only_where_sketches_agree(spark):
    """The quarter sketches that all candidates have rule out pairs of unlike lines, whatever their length, and no pair that is alike."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    lines = []
    for n in (6, 12, 40, 90):
        for _ in range(10):
            line = " ".join(word() for _ in range(n))
            lines += [line, edited(rng, line, 1), edited(rng, line, 1 + n // 30)]
    lines += ["=" * 200, "=" * 190, "ab " * 40]
    rows = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    made = line_dedup.sketched(rows, 5, 1)
    assert {(len(r.bits), r.n) for r in made.collect()} == {(line_dedup.SKETCH // 4, n) for n in {len({t[i : i + 5] for i in range(len(t) - 4)}) for t in lines}}
    x, y = (made.select(*[F.col(c).alias(p + c) for c in made.columns]) for p in "xy")
    got = {(r.xnode, r.ynode) for r in x.crossJoin(y).where("xnode < ynode").where(line_dedup.may_link("x", "y", 0.8, 1)).collect()}
    alike = {(i, j) for j in range(len(lines)) for i in range(j) if gram_jaccard(lines[i], lines[j]) >= 0.8}
    assert len(alike) > 40 and alike <= got and len(got) < 3 * len(alike)


def made_rows(df):
    """Rows that each join of a plan gave when it ran, and what the exchanges wrote, over all of the session's last queries."""
    store = df.sparkSession._jsparkSession.sharedState().statusStore()
    out = []
    runs = store.executionsList()
    for k in range(runs.size()):
        one = runs.apply(k)
        metrics = store.executionMetrics(one.executionId())
        nodes = store.planGraph(one.executionId()).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for j in range(node.metrics().size()):
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                    out.append((one.executionId(), node.name(), int(metrics.apply(m.accumulatorId()).replace(",", ""))))
    return out


def test_components_place_each_node_once(spark):
    n = 3000
    chain = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    before = max((k for k, _, _ in made_rows(chain)), default=-1)
    got = components.components(chain)
    assert got.where("component = 0").count() == n
    by_run = {}
    for k, name, rows in made_rows(chain):
        if k > before and "Join" in name:
            by_run.setdefault(k, []).append(rows)
    # the run that composes the rounds has a join for each; together they give fewer rows than three times the nodes
    longest = max(by_run.values(), key=len)
    assert len(longest) > 4 and sum(longest) < 3 * n


def test_decontamination_catches_other_parameters(spark):
    item = "A train leaves Berlin at 14:30 and covers 120 km before it meets the other train from Paris near the bridge. How far is Berlin from there?"
    same = item.replace("Berlin", "Oslo").replace("120", "75.5").replace("Paris", "Rome")
    mixed = item.replace("leaves Berlin", "leaves Oslo").replace("120", "99").replace("far is Berlin", "far is Vienna")
    filler = " ".join(f"word{chr(97 + i % 26)}" for i in range(60))
    b = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "completely different words about nothing in particular today")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, [filler, f"{filler} {item} {filler}", f"{filler}\n{same} {filler}", f"{filler} {mixed}", None, "", filler + " A train leaves Berlin at 14:30"]), b).collect()}
    assert set(got) == {(1, 1), (2, 1)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised and got[2, 1].n_slots > 0
    assert decontaminate.clean(docs(spark, [filler, item]), b).count() == 1
    assert decontaminate.contaminated(docs(spark, []), b).count() == 0 and decontaminate.contaminated(docs(spark, [item]), b.limit(0)).count() == 0


def test_decontamination_whatever_the_letter_case(spark):
    item = "which of those rivers, lakes, seas, bays, ponds, brooks, creeks, or canals lies 30 km north of the town"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = ["so " + item.upper(), item.upper().replace("30", "41"), item.upper().replace("RIVERS, LAKES, SEAS, BAYS", "a b c d"), "So " + item.title(), item]
    got = {r.doc_id: r for r in decontaminate.contaminated(docs(spark, texts), b).collect()}
    assert set(got) == {0, 1, 3, 4} and got[1].reparameterised and not got[0].reparameterised


def test_decontamination_with_names_and_units_of_other_lengths(spark):
    item = "every day the ferry to Berlin carries 40 tons of salt over 120 km of open water, and then Paris gets half of what Berlin has got"
    b = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    sub = lambda *pairs: __import__("functools").reduce(lambda t, p: t.replace(*p), pairs, item)
    texts = [
        sub(("Berlin", "New York"), ("40", "1,500")),
        sub(("Berlin", "Rio de Janeiro"[:3])),
        sub(("Berlin", "San Francisco Bay Area"), ("Paris", "Le Havre"), ("120 km", "75km per hour")),
        sub(("to Berlin", "to New York"), ("what Berlin", "what San Diego")),  # one name for two
        "<p> <n> 3 " + sub(("Berlin", "Oslo")),
        item.replace("over", "under some bridges and over").replace("what Berlin", "what Madrid"),  # two alignments that contradict each other
        "word " * 30_000 + sub(("Berlin", "Oslo")),
        None,
        "",
    ]
    rows = docs(spark, texts + [texts[0]], [*range(9), 0]).withColumns({c: F.lit(1) for c in ("form", "item_id", "hash", "shift")})
    got = {r.doc_id: r for r in decontaminate.contaminated(rows, b).collect()}
    assert set(got) == {0, 1, 2, 4, 6} and all(r.reparameterised for r in got.values())


def test_decontamination_of_long_runs(spark):
    item = "which of those rivers, lakes, seas, bays, ponds, brooks, creeks, or canals lies 30 km north of the town"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    runs = ["so " + "Aa " * 40_000, "at " + "1." * 40_000 + "1 ", "is 5 " + "km " * 40_000, "is 5 km" + " per h/s" * 20_000 + " ", "so 7 " + "1;" * 40_000 + " "]
    texts = [run + "and " + part for run in runs for part in (item.replace("30", "41"), "no more")]
    got = {(r.doc_id, r.coverage) for r in decontaminate.contaminated(docs(spark, texts), b).collect()}
    assert got == {(i, 1.0) for i in range(0, len(texts), 2)}
    # a run of units ends with the last whole one
    one = docs(spark, ["so 5 km m2 and 6 m/s/sx", "so 5 km per h per day by 7 percent"])
    assert [r.t for r in one.select("doc_id", decontaminate.template(F.col("text")).alias("t")).orderBy("doc_id").collect()] == ["so <n> <u> m<n> and <n> <u>/sx", "so <n> <u> by <n> <u>"]


def brute_leaks(documents, items, window=5, similarity=0.8):
    """(doc_id, item_id) by a walk over all pairs: templates, windows by place, slots by place, alignments one by one."""
    import regex

    unit = "(?:" + "|".join(sorted(decontaminate.UNITS, key=len, reverse=True)) + ")"
    units = unit + "(?:(?: per |[ /])" + unit + r")*(?![\p{L}\p{N}])"
    name = r"\p{Lu}\p{L}[\p{L}'’-]*"

    def words(text, names):
        """Template words, each with its values."""
        text = (text if names else text.lower()).replace("<", " ").replace(">", " ")
        found = [(m.start(), m.end(), m.lastgroup) for m in regex.finditer(rf"(?<n>[0-9]+(?:[.,:/][0-9]+)*)|(?<=[0-9])(?<u> ?{units})" + rf"|(?<=[\p{{Ll}}0-9,;%] )(?<p>{name}(?: {name})*)" * names, text)]
        out, at, values = "", 0, []
        for a, z, kind in found:
            out += text[at:a] + (" <u>" if kind == "u" else f"<{kind}>")
            values.append(regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", text[a:z].lower()))
            at = z
        out = (out + text[at:]).lower()
        out = regex.sub(r"""(?<=[\p{L}\p{N}>])[.,;:!?"')\]]+(?!\S)|(?<!\S)["'(\[]+(?=[\p{L}\p{N}<])""", "", out)
        values, res = iter(values), []
        for w in regex.split("[ \t\n\r\x0b\x0c]+", out.strip(" \t\n\r\x0b\x0c")):
            res.append((w, [next(values) for _ in range(w.count("<"))]))
        return res if res != [("", [])] else []

    numbers = lambda w, values: tuple(v for kind, v in zip(regex.findall("<(.)>", w), values) if kind == "n")
    # windows of placeholders alone keep their numbers
    key = lambda ws: tuple((w, numbers(w, v) if all("<" in x[:2] for x, _ in ws) else ()) for w, v in ws)
    cut = lambda ws: [key(ws[i : i + window]) for i in range(max(1, len(ws) - window + 1))] if ws else []
    out = set()
    for names in (True, False):
        its = {i: words(t, names) for i, t in items if t}
        where = {}
        for i, ws in its.items():
            for k, x in enumerate(cut(ws)):
                where.setdefault(x, []).append((i, k))
        for d, t in documents:
            ws, met = words(t or "", names), {}
            for at, x in enumerate(cut(ws)):
                for i, k in where.get(x, ()):
                    met.setdefault(i, {}).setdefault(at - k, {})[k] = x
            for i, shifts in met.items():
                maps = {}
                for s, hit in shifts.items():
                    one = {}
                    for k in {k + j for k in hit for j in range(window) if k + j < len(its[i])}:
                        for a, b in zip(its[i][k][1], ws[k + s][1]):
                            one.setdefault(a, set()).add(b)
                    if all(len(v) == 1 for v in one.values()):
                        maps[s] = one
                if not maps:
                    continue
                top = maps[max(maps, key=lambda s: (len(set(shifts[s].values())), -s))]
                have = {x for s, one in maps.items() if all(top.get(a, v) == v for a, v in one.items()) for x in shifts[s].values()}
                if len(have) >= similarity * len(set(cut(its[i]))):
                    out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    t = "/root/testdata/sf0.001"
    documents, items = spark.read.parquet(f"{t}/documents.parquet"), spark.read.parquet(f"{t}/benchmark.parquet")
    # every item once more with other numbers and names, some in capitals
    more = [(10_000 + r.item_id, "so " + (r.text.upper() if r.item_id % 3 else r.text.replace("1", "7").replace("2", "85")) + " and more") for r in items.collect()]
    documents = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_leaks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, items).collect()}
    assert got == want and len(got) > 40


WEIRD = ["", None, " ", "\n", "a  b\n\nc", "▁ x ▁", "don't we'll", "\x1c\x1d\x85 ​　x", "日本語 テキスト", "😀😀", "a" * 30_000, " " * 5000 + "x", "\x00y", "<s> </s> <|endoftext|>"]


def test_decontamination_looks_windows_up_by_one_number(spark, monkeypatch):
    """The join that all documents' windows go through has one key, and texts aren't translated character by character."""
    plans, write = {}, decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, tag: (plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString()), write(df, tag))[1])
    item = "how many apples does the farmer sell each day at the market"
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    texts = [item.replace(" ", gap) for gap in (" ", "\t", " \n", "\r\n", "\x0b\x0c")] + [f"\n\t {item} \x0c", f"<{item}>", item.upper(), "\t \n", ""]
    assert {r.doc_id for r in decontaminate.contaminated(docs(spark, texts), b).collect()} == set(range(8))
    joins = [line for line in plans["hits"].split("\n") if "BroadcastHashJoin" in line]
    assert len(joins) == 2 and all("Join [hash" in line and "form" not in line for line in joins) and "translate(" not in plans["hits"]
    words = spark.createDataFrame([(" a\tb \x0b\x0cc\n",), ("",), ("\n ",), ("d\u00a0e f",)], "t string")
    assert [r.w for r in words.select(decontaminate.word_list(F.col("t")).alias("w")).collect()] == [["a", "b", "c"], [""], [""], ["d\u00a0e", "f"]]


def test_byte_bpe_equals_the_library(spark):
    tiktoken, vocabularies = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    out = byte_bpe.encode(docs(spark, WEIRD), path, vocabularies.PATTERN)
    for r in out.collect():
        t = WEIRD[r.doc_id] or ""
        want = ref.encode_ordinary(t)
        assert r.ids == want and r.decoded == t
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert [r.text for r in byte_bpe.decode(out, path, vocabularies.PATTERN).orderBy("doc_id").collect()] == [t or "" for t in WEIRD]


def test_merge_order_of_arbitrary_ranks():
    rng = random.Random(2)
    for _ in range(300):
        ranks = {bytes([c]): c for c in b"abc"}
        for _ in range(40):
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            ranks.setdefault(a + b, 300 + rng.randrange(10**6))
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
        parts = [bytes([c]) for c in piece]
        while piece not in ranks:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merge_ids(piece, ranks) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_token_counts_equal_the_library(spark):
    sentencepiece, vocabularies = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = vocabularies.path("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=path)
    for entries in (3, 50_000):
        for r in token_counts.count_tokens(docs(spark, WEIRD), path, entries=entries).collect():
            t = WEIRD[r.doc_id] or ""
            n = len(ref.encode(t, num_threads=1))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096)


def odd_rows(spark):
    """Rows that repeat, null ids and texts, an empty and a very long text, and columns with the operators' own names."""
    return docs(spark, ["a b c d", "a b c d", None, "", "w x " * 40_000, "a b c d"], [1, 1, None, 4, 5, 6]).withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "score", "ctx", "w", "c", "parts", "chunk", "node", "rank", "line", "kind", "first")})


def test_language_model_on_odd_rows(spark):
    df = odd_rows(spark)
    got = sorted(((r.doc_id or 0, r.n_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm_trie.score_documents(df).collect()), key=str)
    assert [(g[0], g[1]) for g in got] == [(0, 1), (1, 5), (1, 5), (4, 1), (5, 80_001), (6, 5)] and got[1] == got[2] and got[1][2:] == got[5][2:]
    assert lm_trie.score_documents(df.limit(0)).count() == 0


def test_encoders_on_odd_rows(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    df = odd_rows(spark)
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in byte_bpe.encode(df, path, vocabularies.PATTERN, digests_only=True).collect())
    assert [g[0] for g in got] == [0, 1, 1, 4, 5, 6] and got[0][1] == got[3][1] == 0 and got[1] == got[2] and got[4][1] >= 40_000
    assert byte_bpe.encode(df.limit(0), path, vocabularies.PATTERN).count() == 0
    path = vocabularies.path("piece_bpe_32k.model")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, path).collect())
    assert [g[0] for g in got] == [0, 1, 1, 4, 5, 6] and got[0][1:] == got[3][1:] == (0, 0, False) and got[1] == got[2] and got[4][1] == 160_000 and got[4][3]
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_lines_of_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9000))
    near = long[:30_000] + "zzz" + long[30_000:]
    other = "here is one more line that is long enough"
    df = odd_rows(spark).select("doc_id", "text", "node", "rank", "line", "kind", "first").unionByName(docs(spark, [long, near + "\n" + other, other], [10, 11, None]).withColumns({c: F.lit(1) for c in ("node", "rank", "line", "kind", "first")}).select("doc_id", "text", "node", "rank", "line", "kind", "first"))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.dedup_lines(df).collect()}
    assert got[11, 0] == (10, 0, False) and got[10, 0][2] and got[None, 0] == (None, 0, True) and got[11, 1] == (None, 0, False)
    assert got[1, 0] == (1, 0, True) and got[6, 0] == (6, 0, True)  # too short to be compared


def test_decontamination_needs_words_not_placeholders(spark):
    table_ = " ".join(map(str, range(2000)))
    items = [(1, " ".join(str(7 * k) for k in range(60))), (2, "The rows are 1 2 3 4 5 6 7 8 9 10 11 12"), (3, "2 4 8"), (4, "41 42 43 44 45 46 47 48 49")]
    b = spark.createDataFrame(items, "item_id long, text string")
    texts = [table_, "2 4 8 16 32 64 128", items[0][1], items[1][1].replace("12", "13"), "3 4 8", "2 4 8", "x " * 6 + items[0][1]]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), b).collect()}
    assert got == {(0, 4), (2, 1), (3, 2), (5, 3), (6, 1)}
    assert got == brute_leaks(list(enumerate(texts)), items)


def test_ngram_join_has_one_first_order_whatever_the_filter_hits(spark, monkeypatch):
    """A document left with its old prefix has the same one under the mended order, also where the filter holds tokens by chance."""
    monkeypatch.setattr(ngram_join, "HEAVY_BITS", 12)
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    heavy = pool[:253]
    bits = ngram_join.heavy_words(spark.createDataFrame([(int(k),) for k in heavy.view(np.int64)], "key long"))
    before = ngram_join.Sketch(np.zeros((2, 1 << ngram_join.BITS), np.int64))
    after = ngram_join.Sketch(np.zeros((2, 1 << ngram_join.BITS), np.int64))
    after.heavy = ngram_join.heavy_filter(bits)
    sets = [np.unique(rng.choice(pool, 40)) for _ in range(600)]
    tokens = [(s, (s >> np.uint64(50)) & np.uint64(255), s & np.uint64(7)) for s in sets]
    old, new = ([ngram_join.prefix(t, c, 0, 90) for t in tokens] for c in (before, after))
    rows = [(n, int(k)) for n, p in enumerate(old) for k in p.view(np.int64)]
    moved = {r.node for r in ngram_join.in_filter(spark.createDataFrame(rows, "node int, key long"), bits).select("node").distinct().collect()}
    assert 0 < len(moved) < len(sets)
    assert all(n in moved or np.array_equal(old[n], new[n]) for n in range(len(sets)))
    assert any(n in moved and not np.isin(old[n], heavy).any() for n in range(len(sets)))  # chance hits


def test_trie_keeps_counts_beyond_32_bits(tmp_path):
    counts = np.array([5, 2**32 - 1, 2**32, 6 * 10**9])
    paths = [f"file://{tmp_path}/{k}" for k in range(2)]
    for path, c in zip(paths, (counts, counts[:2])):
        lm_trie.save(path, {"counts": lm_trie.narrow(c)})
    level = lm_trie.Level([lm_trie.Shard(paths[0], (0, 0), (0, 3), 0, 4), lm_trie.Shard(paths[1], (0, 4), (0, 5), 4, 2)])
    assert level.counts_of(np.arange(6)).tolist() == [*counts.tolist(), 5, 2**32 - 1]
    assert lm_trie.load(paths[1])["counts"].dtype == np.uint32
