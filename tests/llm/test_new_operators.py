"""Operators 11 to 13, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from voxstrata.llm import license_scan, periodic_runs, queries, spelling
from voxstrata.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t\x0b"), (None, "one two one two one two one two"), (None, None), (7, "a " * 50_000), (7, "a " * 50_000), (8, "naïve   word x 😀")]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "doc_id as runs", "text as collapsed", "1 as n", "'x' as word", "2 as h", "3 as words", "4 as p", "5 as places") if extra else df


# ---- 11


def brute_runs(w, exponent=4, least=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        texts, exponent = [], rng.choice([2, 3, 4, 5])
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 50), rng.choice([1, 2, 2, 3, 5])
            w = [b"%d" % rng.randrange(letters) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                p, a = rng.randint(1, 6), rng.randrange(n)
                w = [w[min(a + (i - a) % p, n - 1)] if i >= a else w[i] for i in range(n)]
            texts.append(w)
        for w, (runs, collapsed) in zip(texts, periodic_runs.collapse(texts, exponent, 6)):
            assert runs == brute_runs(w, exponent)
            lost = {k for s, n, q in runs for k in range(s + q, s + n)}
            assert collapsed == b" ".join(x for k, x in enumerate(w) if k not in lost)


def test_runs_of_long_texts():
    assert periodic_runs.collapse([[b"a"] * 300_000], 4, 6)[0] == ([(0, 300_000, 1)], b"a")
    runs, _ = periodic_runs.collapse([([b"a"] * 6 + [b"b"]) * 5000], 4, 6)[0]
    assert len(runs) == 5001 and (0, 35_000, 7) in runs
    w = [b"%d" % random.Random(1).randrange(3000) for _ in range(5)] + [b"%d" % k for k in range(9000)] * 6
    assert (5, 54_000, 9000) in periodic_runs.collapse([w], 4, 6)[0][0]


def test_common_prefixes_of_the_suffix_order():
    rng = random.Random(3)
    for _ in range(300):
        s = np.array([rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 30))] + [9])
        places, common = periodic_runs.suffix_order(s, 2)
        for k in range(1, len(places)):
            a, b, n = int(places[k]), int(places[k - 1]), 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert common[k] == n


def expected_runs(i, text):
    w = (text or "").encode().split()
    n, h = len(w), crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w) if len(w) < 3000 else [r for r, in [[(0, len(w), 1)]]]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lost = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *tail, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in lost)))


def test_op11(spark):
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = {r[0]: tuple(r) for r in got.collect()}
    assert len(found) == len(short)
    for i, t in short:
        if len((t or "").split()) < 700:
            assert found[i] == expected_runs(i, t)


def test_op11_odd_rows(spark):
    d = docs(spark, ODD, extra=True)
    got = sorted(map(tuple, periodic_runs.report(periodic_runs.periodic_runs(periodic_runs.planted(d))).collect()), key=str)
    assert got == sorted((expected_runs(i, t) for i, t in ODD), key=str)
    assert periodic_runs.report(periodic_runs.periodic_runs(d.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(d, exponent=1)


# ---- 12


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if abs(len(v) - len(w)) <= 1 and near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * n else None, n, len(close))
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, k, out[form][1] if form else None))
    return sorted(rows)


@pytest.mark.parametrize("per_key, bucket", [(200_000, 4 << 20), (20, 4 << 20), (50, 400)])
def test_variants_equal_brute_force(spark, per_key, bucket):
    rng = random.Random(per_key)
    counts = {}
    for _ in range(150):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 11)))
        for _ in range(4):
            counts[w] = rng.choice([2, 3, 30, 400, 5000])
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :] or "a", w[:k] + rng.choice("abé😀") + w[k:], w[:k] + "b" + w[k + 1 :]])
    for k in range(60):  # one key holds a third of all words
        counts["aaaaaaa" + "".join(rng.choice("ab") for _ in range(6))] = k + 2
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), per_key=per_key, bucket_letters=bucket)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(counts)


def test_chains_of_forms(spark):
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    rows = [(w, 2 * 10**k) for k, w in enumerate(words)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {"aaabbbbb"}


def test_wavelet_tree_reports_every_point():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        v = rng.permutation(n)
        a, c = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        b, d = rng.integers(0, n + 1, 50), rng.integers(0, n + 1, 50)
        q, value = spelling.WaveletTree(v).report(a, b, c, d)
        want = sorted((k, x) for k in range(50) for x in v[a[k] : b[k]].tolist() if c[k] <= x < d[k])
        assert sorted(zip(q.tolist(), value.tolist())) == want


def words_of(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = crc32(f"{'null' if i is None else i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def deletion_variants(counts):
    """The same result by the words' deletion neighbourhoods, fit for whole tables."""
    met = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            met[(k, w[:k] + w[k + 1 :])].add(w)
    close = defaultdict(set)
    for (_, cut), ws in met.items():
        for a, b in itertools.permutations(ws, 2):
            close[a].add(b)
        if cut in counts:
            for w in ws:
                close[w].add(cut)
                close[cut].add(w)
    out = {w: min(close[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    out = {w: f if f is not None and counts[f] >= 10 * counts[w] else None for w, f in out.items()}
    rows = []
    for w, f in out.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.append((w, f, root, counts[w], len(close[w]), counts.get(f)))
    return sorted(rows)


def test_op12(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    counts = words_of(rows)
    got = sorted(map(tuple, queries.op12_spelling(spark, SF).collect()))
    assert got == deletion_variants(counts) and any(r[1] for r in got)


def test_op12_odd_rows(spark):
    rows = [*ODD, (4, "Straßenbahn STRASSENBAHN Straßenbahn strassenbahn"), (None, "Ébauche-ébauche ébauche×÷ xyébauche"), (5, "q" * 3000 + " " + "q" * 3000)]
    got = spelling.variants(spelling.count_words(docs(spark, rows, extra=True), change=spelling.dropped_letter))
    assert sorted(map(tuple, got.collect())) == brute_variants(words_of(rows))
    assert spelling.variants(spelling.count_words(docs(spark, rows).limit(0))).count() == 0


# ---- 13


def base_of(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENCES = [
    (1, "MIT License mit\nlicense MIT-license mit licenses amit license"),
    (2, "GNU General Public License, general public license apache license"),
    (3, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */\nint x;"),
    (4, "# spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0\n# SPDX-License-Identifier: MIT OR"),
    (5, "Licensed under CC BY-NC-SA 4.0."),
    (6, "mit license " * 20_000),
    (7, "the GNU Lesser General Public License, é mit license mit license"),
    (8, "SPDX-License-Identifier: Nobody-Knows-1.0"),
]


def test_op13(spark):
    got = {r.doc_id: r for r in queries.op13_license_scan(spark, SF).collect()}
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op13_odd_rows_and_labels(spark):
    rows = [*ODD, *LICENCES]
    got = license_scan.report(license_scan.scan_licenses(docs(spark, rows, extra=True)))
    told = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()), key=str)
    assert told == sorted(((i, *base_of(t)) for i, t in rows), key=str)
    r = {r.doc_id: r for r in license_scan.report(license_scan.scan_licenses(docs(spark, LICENCES))).collect()}
    assert [r[k].labels for k in range(1, 9)] == ["mit", "apache,gpl", "apache,bsd,mit", "gpl", "cc-by-nc-sa", "mit", "gpl,lgpl,mit", ""]
    assert [r[k].kind for k in (3, 4, 5, 8)] == ["permissive", "weak copyleft", "restricted", None]
    assert r[3].score == 1 and r[8].score == 0 and r[1].score == pytest.approx(2 / 3)
    assert license_scan.report(license_scan.scan_licenses(docs(spark, ODD).limit(0))).count() == 0


def brute_value(tree):
    if isinstance(tree, str):
        return frozenset([license_scan.family(tree)]), license_scan._KIND[license_scan.family(tree)]
    op, a, b = tree
    x = brute_value(a)
    if op == "with":
        return x[0], 1 if x[1] == 2 else x[1]
    y = brute_value(b)
    return x[0] | y[0], (max if op == "and" else min)(x[1], y[1])


def test_expressions_equal_their_trees():
    rng = random.Random(4)

    def make(depth):
        if not depth or rng.random() < 0.3:
            leaf = rng.choice(["mit", "gpl-2.0-only", "apache-2.0", "cc-by-nc-4.0", "lgpl-2.1+", "bsd-3-clause"])
            return (("with", leaf, "llvm-exception"), f"{leaf} with llvm-exception", 3) if rng.random() < 0.3 else (leaf, leaf, 4)
        op, binds = rng.choice([("or", 1), ("and", 2)])
        (a, s, p), (b, t, q) = make(depth - 1), make(depth - 1)
        s, t = (s if p >= binds else f"({s})"), (t if q > binds else f"( {t} )")
        return (op, a, b), f"{s} {op} {t}", binds

    for _ in range(500):
        tree, text, _ = make(4)
        assert license_scan.evaluate(text) == brute_value(tree), text
    for bad in ["", "or", "mit or", "(mit", "mit)", "mit mit", "mit with gpl-2.0", "llvm-exception", "()", "mit or or gpl", "mit with", "(mit and llvm-exception)", "mit / gpl", "( (mit) with llvm-exception ) )"]:
        assert license_scan.evaluate(bad) is None, bad
    assert license_scan.evaluate("((mit))") == (frozenset(["mit"]), 0)
    assert license_scan.evaluate("(" * 50_000 + "mit" + ")" * 50_000) == (frozenset(["mit"]), 0)


def test_no_shuffle_in_scans(spark):
    for q in (queries.op11_periodic_runs, queries.op13_license_scan):
        assert "Exchange" not in q(spark, SF)._jdf.queryExecution().executedPlan().toString()
