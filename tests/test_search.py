"""The kept index against a fresh one, folding, and claims that many make."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import index, linking, search
from sessionloom.operators.index import Index

WORDS = ["the", "of", "Thé", "naïve", "ab", "x1", "ÉTÉ", "straße", "a"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, more string")


def brute(rows, query):
    """Documents with the number of places where the tokens of a query follow each other, in each field."""
    import re
    import unicodedata

    fold = lambda s: [t for t in re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if not "̀" <= c <= "ͯ"))]
    wanted, out = fold(query), set()
    for i, *fields in rows:
        for name, text in zip(("text", "more"), fields, strict=True):
            t = fold(text)
            if n := sum(t[k : k + len(wanted)] == wanted for k in range(len(t))) if wanted else 0:
                out.add((i, name, n))
    return out


def random_rows(rng, ids):
    some = lambda: rng.choice([None, "", " - ".join(rng.choices(WORDS, k=rng.randrange(9))), "a a a a"])
    return [(i, some(), some()) for i in ids]


QUERIES = ["the", "THÉ of", "naive ab", "ete", "a a", "strasse", "straße", "", "nowhere", "été"]


def hits(df):
    return {tuple(r) for r in df.select("doc", "field", "n").collect()}


def test_phrases_without_an_index(spark):
    rows = random_rows(random.Random(3), range(60))
    for q in QUERIES:
        assert hits(search.phrases(docs(spark, rows), "id", ["text", "more"], q)) == brute(rows, q), q
        assert hits(search.phrase(search.postings(docs(spark, rows), "id", ["text", "more"]), q)) == brute(rows, q), q


def test_an_index_that_is_added_to_is_like_a_fresh_one(spark, tmp_path, monkeypatch):
    """Rows come, change, go and come back; only new and changed ones are taken apart; segments are merged."""
    monkeypatch.setattr(index, "MOST", 3)
    rng, kept, now = random.Random(5), Index(spark, str(tmp_path / "index")), {}
    assert kept.phrase("the").count() == 0 and kept.lengths().count() == 0
    taken = []
    plain = search.postings
    monkeypatch.setattr(search, "postings", lambda rows, *a: taken.append(rows.count()) or plain(rows, *a))
    for wave in range(5):
        changed = {i: r for i, *r in random_rows(rng, rng.sample(range(30), 8))}
        new = {i for i, r in changed.items() if now.get(i) != r}
        now |= changed
        if wave == 2:
            now = {i: r for i, r in now.items() if i % 5}
        rows = [(i, *r) for i, r in now.items()]
        n = kept.add(docs(spark, rows), "id", ["text", "more"], whole=True)
        assert n == len(new & now.keys()) == taken[-1]
        assert {(r.doc, r.length) for r in kept.lengths().collect()} == {(r.doc, r.length) for r in search.lengths(docs(spark, rows), "id", ["text", "more"]).collect()}
        for q in QUERIES[:5]:
            assert hits(kept.phrase(q)) == brute(rows, q), (wave, q)
    assert len(kept.segments()) <= 3 and kept.add(docs(spark, rows), "id", ["text", "more"], whole=True) == 0
    kept.add(docs(spark, [(999, "the", None)]), "id", ["text", "more"])  # without whole nothing is taken out
    assert hits(kept.phrase("the")) == brute([*rows, (999, "the", None)], "the")
    (tmp_path / "index/segment-broken/tokens").mkdir(parents=True)  # of a call that failed
    assert hits(kept.phrase("of")) == brute([*rows, (999, "the", None)], "of")


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_a_text_is_taken_apart_once_and_kept_in_pages(spark, tmp_path, monkeypatch, block):
    """The token table has a row for each bucket of a block of documents, not one for each place; blocks of any size give the same."""
    monkeypatch.setattr(search, "BLOCK", block)
    calls, plain = [], search.tokens_of
    monkeypatch.setattr(search, "tokens_of", lambda text: calls.append(1) or plain(text))
    rng, kept = random.Random(block), Index(spark, str(tmp_path / "index"))
    rows = [*random_rows(rng, range(12)), (12, "the of " * 5000, "a a a"), (13, "of", None), (14, None, None), (15, "", " - ")]
    assert kept.add(docs(spark, rows).coalesce(1), "id", ["text", "more"]) == len(rows)
    assert len(calls) == 2  # once a field
    table = spark.read.parquet(f"{kept.path}/{kept.segments()[0][1]}/tokens")
    assert table.count() <= table.where("bucket = -1").count() * (2 * len(WORDS) + 1) < 10_000
    found = {(r.doc, r.length) for r in kept.lengths().collect()}
    assert found == {(r.doc, r.length) for r in search.lengths(docs(spark, rows), "id", ["text", "more"]).collect()} and len(found) == len(rows)
    for q in QUERIES[:5]:
        assert hits(kept.phrase(q)) == brute(rows, q), q


def test_a_row_without_id_is_found(spark, tmp_path):
    kept, rows = Index(spark, str(tmp_path / "index")), [(1, "the", None), (None, "of the the", "a")]
    kept.add(docs(spark, rows[:1]), "id", ["text", "more"])
    kept.add(docs(spark, rows), "id", ["text", "more"], whole=True)
    assert hits(kept.phrase("the")) == brute(rows, "the") and hits(kept.phrase("a")) == {(None, "more", 1)}


def test_snippets_find_any_spelling(spark):
    df = spark.createDataFrame([("one LE THÉ two",), ("le thé",), ("les thes",)], "t string")
    assert [r[0] for r in df.select(search.snippet(F.col("t"), "le thé")).collect()] == ["one [LE THÉ] two", "[le thé]", None]


def test_claims_of_one_value_take_linear_work(spark):
    """A million sessions claim and bear one value: each sees the others, none is paired with them."""
    n = 1_000_000
    ids = spark.range(n)
    claims = ids.select("id", F.col("id").alias("session"), F.lit("v").alias("claimed")).unionByName(spark.createDataFrame([(n, n, "w"), (n + 1, n + 1, "w"), (n + 2, n + 2, "x"), (n + 3, n + 3, "y"), (n + 4, n + 4, None)], "id long, session long, claimed string"))
    candidates = ids.select(F.lit("v").alias("claimed"), F.col("id").alias("candidate")).unionByName(spark.createDataFrame([("w", n), ("w", n + 1), ("w", n + 1), ("x", n + 2), ("y", 7), ("y", None), (None, 1)], "claimed string, candidate long"))
    got = linking.resolve(claims, candidates)
    few = {r.id: (r.hits, r.status, r.match) for r in got.where(F.col("id") >= n - 1).collect()}
    assert few == {n - 1: (n - 1, "ambiguous", None), n: (1, "matched", n + 1), n + 1: (1, "matched", n), n + 2: (0, "unmatched", None), n + 3: (1, "matched", 7), n + 4: (0, "unmatched", None)}
    assert got.groupBy("status").count().orderBy("status").collect()[0]["count"] == n


@pytest.mark.parametrize("seed", range(2))
def test_claims_by_brute_force(spark, seed):
    rng = random.Random(seed)
    claims = [(i, rng.randrange(6), rng.choice("abcd")) for i in range(40)]
    bears = [(rng.choice("abc"), rng.randrange(6)) for _ in range(9)]
    got = {r.id: (r.hits, r.match) for r in linking.resolve(spark.createDataFrame(claims, "id long, session long, claimed string"), spark.createDataFrame(bears, "claimed string, candidate long")).collect()}
    want = {}
    for i, s, c in claims:
        others = {x for k, x in bears if k == c and x != s}
        want[i] = (len(others), min(others) if len(others) == 1 else None)
    assert got == want
