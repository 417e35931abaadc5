"""Operators 11 to 13 against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and further columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import merkle, quality, runs

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
#: Further columns bear the names of results and of what the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, leaf string, root string, tree string, at long, path string, n long, key string, words string, n_runs long, start long, period long, y int, held_out int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "l", "r", "t", 1, "p", 2, "k", "w", 3, 4, 5, 6, 7) for r in rows], DOCS)


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- 11 ------------------------------------------------------------------------------------------

MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """All trees built whole; each row's version folded from its leaf and siblings."""

    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            first = i - i % 3
            yield "".join(level[first:i]), "".join(level[i + 1 : first + 3])
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: levels([leaf(r, r[1]) for r in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = [*siblings(trees[s], i), *siblings(top, k)]
            changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[1].replace("\n", "") if changed else r[1])
            for left, right in steps:
                node = digest(left + node + right)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def leaves(n, seed=3):
    """Rows of many sizes of sources: one with most rows, one of a single row, one without a name, one with an empty name."""
    rng = random.Random(seed)
    names = ["big"] * 12 + ["b", "é", "ä", "z\U0001f600", "", None]
    rows = [(i, rng.choice([None, "", "one\ntwo\n", "no feed", "é\n" * 30]), rng.choice(["en", None]), rng.choice(names), rng.choice([None, 5])) for i in range(n)]
    return [*rows, (n, "alone", "en", "single", 1), (None, "a\nb", None, "big", None), (None, None, None, None, None), rows[7], (rows[8][0], "other", *rows[8][2:]), (2**63 - 1, "x" * 300_000 + "\n", "en", "big", 1), (-5, "\n", "en", "big", 1)]


@pytest.mark.parametrize("n,block", [(0, 6), (1, 6), (3, 6), (60, 1), (200, 1), (400, 2), (900, 6)])
def test_manifest_by_brute_force(spark, monkeypatch, n, block):
    """Blocks of 3, 9 and 729 leaves: several levels of distributed trees, and one."""
    monkeypatch.setattr(merkle, "LEVELS", block)
    monkeypatch.setattr(merkle, "BLOCK", 3**block)
    rows = leaves(n) if n > 8 else [(i, "a\nb", "en", "s", 3) for i in range(n)]
    got = result(merkle.manifest(frame(spark, rows)), *MANIFEST)
    assert got == brute_manifest(rows)
    assert n < 60 or {r[-1] for r in got} == {True, False}


def test_manifest_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert result(merkle.manifest(docs), *MANIFEST) == brute_manifest(rows)


def test_versions_share_what_is_untouched():
    tree = merkle.Tree([digest(str(i)) for i in range(50)])
    version = tree.with_leaf(17, digest("tampered"))
    fresh = merkle.Tree([digest("tampered") if i == 17 else digest(str(i)) for i in range(50)])
    assert version.root == fresh.root != tree.root and len(version.copied) == len(tree.levels)
    for k, level in enumerate(tree.levels):
        for i, node in enumerate(level):
            assert version.node(k, i) == fresh.levels[k][i]
            assert (version.node(k, i) is node) == (i != 17 // 3**k)
    assert [len(x) for x in merkle.Tree(["a"], 2).levels] == [1, 1, 1] and len(merkle.Tree(["a"]).levels) == 1


# --- 12 ------------------------------------------------------------------------------------------

RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_described(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if w and h % 10 == 0:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), hashlib.sha256(kept).hexdigest())


def periodic(rng, n):
    w = []
    while len(w) < n:
        part = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 31]))]
        w += part * rng.choice([1, 1, 1, 2, 3, 4, 5, 8]) + part[: rng.randrange(len(part))]
    return w[:n]


def test_runs_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(runs, "STRIP", 40)  # so that runs lie in several strips and are put together again
    rng = random.Random(12)
    texts = [" ".join(periodic(rng, n)) for n in [*range(12), *[60, 200, 700] * 25]]
    texts += [None, "", " \n\t", "ha " * 500, "a b " * 3, "a b " * 4, "a " * 5, "a " * 6, ("x y z\x0b" * 90) + "x y", "a\x1ca a\x85a é é é é é é", "w\x0c" * 7]
    rows = [(i * 7, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(None, "ha " * 9, "en", "s", 1), (None, None, None, None, None), rows[40], rows[40], (rows[41][0], "b " * 8, "en", "s", 1)]
    got = result(runs.digests(frame(spark, rows)), *RUNS)
    assert got == sorted((brute_described(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 1 for r in got) > 20
    assert runs.digests(frame(spark, [])).count() == 0


def test_runs_of_a_long_text(spark):
    """Periods of many octaves, among them one of a quarter of the text, over a million words."""
    rng = random.Random(4)
    w = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    w = w * 4 + ["sep"] + ["ha"] * 300_000 + w[:20_000] + w[:777] * 500
    rows = [(3, " ".join(w), "en", "s", 1)]
    assert zlib.crc32(b"3") % 10
    (got,) = runs.digests(frame(spark, rows)).collect()
    want = [(0, 240_000, 60_000), (240_001, 300_000, 1), (560_001, 388_500, 777)]
    assert got.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in want)) and (got.start, got.length, got.period) == want[2]
    assert got.collapsed_sha256 == hashlib.sha256(" ".join([*w[:60_000], "sep", "ha", *w[540_001:560_001], *w[560_001:560_778]]).encode()).hexdigest()


def test_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 12000")
    assert result(runs.digests(docs), *RUNS) == sorted((brute_described(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)


def test_sieve_lets_every_run_through():
    rng = random.Random(6)
    for _ in range(300):
        w = periodic(rng, rng.choice([6, 20, 90]))
        first = {}
        found = {(q, s, e) for octave, at, part, bounds in runs.strips(np.array([first.setdefault(x, i) for i, x in enumerate(w)], np.int32)) for q, s, e in runs.solved(part, bounds.tolist(), 1 << octave, at, len(w))}
        assert {(q, s, s + n) for s, n, q in brute_runs(w)} <= found  # one strip holds such a short text


# --- 13 ------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    d = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.judged(docs, labels)
    x = got.join(labels, "doc_id").where("held_out").collect()
    assert len(x) > 40 and sum(r.predicted == r.quality for r in x) / len(x) > 0.95
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def marked(n=80):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    return [(i, " ".join(w if i % 2 else w.upper() + "!!" for w in (word() for _ in range(rng.randrange(20, 60)))), "en", "s", 1) for i in range(n)]


def scores(spark, rows, labels):
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string, y int, score double")
    return quality.judged(frame(spark, rows), df)


def test_quality_of_odd_rows(spark):
    rows = marked()
    labels = [(r[0], int(r[0] % 2), 0, "x", 1, 1.0) for r in rows] + [(None, 0, 0, "x", 1, 1.0), (1, None, 0, "x", 1, 1.0), (3, 1, 1, "x", 1, 1.0), (9999, 0, 0, "x", 1, 1.0)]
    odd = [(500, None, None, None, None), (501, "", "en", "s", 1), (502, " \n", "en", "s", 1), (None, rows[1][1], "en", "s", 1), (503, rows[1][1] + " " + "x" * 3_000_000, "en", "s", 1), rows[0], rows[0], (rows[1][0], "ZZZ!! " * 30, "en", "s", 1)]
    got = scores(spark, rows + odd, labels).collect()
    assert len(got) == len(rows + odd) and {r.score for r in got if r.doc_id in (500, 501, 502)} == {0.0}
    plain = {r.doc_id: r.predicted for r in got}
    assert all(plain[r[0]] == r[0] % 2 for r in rows if r[0] > 1) and [r.predicted for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    again = scores(spark, (rows + odd)[::-1], labels[::-1]).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in got) == sorted((r.doc_id or -1, round(r.score, 9)) for r in again)


def test_quality_learns_from_no_held_out_label(spark):
    rows = marked()
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    labels = [(r[0], int(r[0] % 2), 0, "x", 1, 1.0) for r in rows]
    swapped = [(i, 1 - q if i in held else q, *rest) for i, q, *rest in labels]
    get = lambda of: sorted((r.doc_id, r.score) for r in scores(spark, rows, of).collect())
    assert held and get(labels) == get(swapped)


def test_quality_without_labels(spark):
    rows = marked(6)
    assert min(r.score for r in scores(spark, rows, [(1, 1, 0, "x", 1, 1.0), (3, 1, 0, "x", 1, 1.0)]).collect()) > 0.99
    assert max(r.score for r in scores(spark, rows, [(2, 0, 0, "x", 1, 1.0)]).collect()) < 0.01
    assert min(r.score for r in scores(spark, rows, []).collect()) > 0.99
    assert scores(spark, [], [(1, 1, 0, "x", 1, 1.0)]).count() == 0


def test_ranking_is_that_of_bradley_and_terry():
    """At the optimum the gradient of the logistic loss on differences vanishes, and the quantile parts the shares."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (40, 3)), rng.normal(-0.5, 1, (25, 3))
    first, second = quality.pairs_of(40, 25)
    assert len(first) == 40 * quality.PARTNERS and len(set(zip(first.tolist(), second.tolist(), strict=True))) == len(first)
    d = good[first] - bad[second]
    w = quality.train(d, ridge=0.5)
    assert np.allclose(d.T @ (1 / (1 + np.exp(d @ w))), 0.5 * w, atol=1e-5)
    assert quality.quantile(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert [len(x) for x in quality.pairs_of(2, 5)] == [10, 10]


def test_quality_learns_from_all_labels(spark, monkeypatch):
    """6,000 labelled rows, a thirtieth of them bad: mean, weights and threshold are those of all rows, in one group and in several."""
    rng = random.Random(4)
    rows = [(i, " ".join(("A!" if i % 30 == 0 and rng.random() < 0.9 else "b") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30)))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 30 > 0).cast("int").alias("quality"))
    used = [(r, t) for r, t in rows if zlib.crc32(str(r).encode()) % 5]
    x, y = np.stack([quality.features(t) for _, t in used]), np.array([r % 30 > 0 for r, _ in used])
    monkeypatch.setattr(quality, "STRENGTHS", 100)
    for group in (10_000, 500):
        monkeypatch.setattr(quality, "GROUP", group)
        m = quality.fit(docs, labels)
        assert np.allclose(m.mean, x.mean(axis=0), atol=1e-5) and np.allclose(m.spread, np.maximum(x.std(axis=0), 1e-3), atol=1e-5)
        s = m.strength(x.astype(np.float32))
        assert m.threshold == pytest.approx(quality.quantile(np.round(s, 9), np.ones(len(s)), 1 - y.mean()), abs=1e-6)
        assert ((s > m.threshold) == y).mean() > 0.97
        if group == 10_000:
            z = (x.astype(np.float32) - m.mean) / m.spread
            first, second = quality.pairs_of(int(y.sum()), int((~y).sum()))
            assert np.allclose(m.weights, quality.train(z[y][first] - z[~y][second]), atol=1e-4)


def test_features_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abXY9é|!\n", k=rng.randrange(1, 9))) for _ in range(3000))
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PART", 1000)
    assert np.allclose(whole, quality.features(text), atol=1e-9) and len(whole) == quality.N_FEATURES
    assert quality.features("x" * 5000) is not None and quality.features(" ") is None is quality.features(None)


def test_all_rows_of_the_tables(spark):
    from sessionloom.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.queries()["op13_quality"](spark, DATA)
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and got.count() == docs.count()
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert got.where(F.isnan("score") | F.isnull("score")).isEmpty()
