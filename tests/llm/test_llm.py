"""The operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and further columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bpe, common, decontaminate, html, licences, lmscore, neardup, neighbours, pii, queries, substrings, toxicity

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, matches string, pii string, token_ids string"


def corpus(seed=1):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage, base = some(60), some(120)
    texts = [None, "", "   \n", "one", "Two words", some(20000), some(30) + " " + passage + "\t" + some(20), passage + " " + some(5), some(9) + "\n" + passage.upper(), base, base, base.upper()]
    for k in (1, 2, 4, 8, 16):
        w = base.split()
        for i in rng.sample(range(len(w)), k):
            w[i] = "edit"
        texts.append(" ".join(w))
    texts += [some(rng.randrange(1, 40)) for _ in range(60)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k]) for i, k in enumerate(order)]


def frame(spark, rows, repeat=True):
    rows = [*rows, rows[-1]] if repeat else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1.0, "m", "p", "t") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 7 -------------------------------------------------------------------------------------------


def brute_substrings(rows, n=13):
    words = [(2**63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), (j, w) in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < j:
                gone[k : k + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark):
    rows = [*corpus(), (None, corpus()[0][1]), (None, None)]
    df = frame(spark, rows)
    got = sorted((tuple(r) for r in substrings.digests(df).collect()), key=repr)
    assert got == brute_substrings([*rows, rows[-1]])
    assert sum(r[2] for r in got) > 100
    assert substrings.digests(empty(spark)).count() == 0


def test_substrings_small_chunks(spark):
    rows = corpus(5)
    got = substrings.deduplicate(frame(spark, rows, False), chunk_bytes=2000, bucket_bytes=2000).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_substrings(rows)


def test_substrings_common_to_all(spark):
    """One passage in every document, and one row many times: what a bucket of windows gets is an entry a chunk."""
    rng = random.Random(16)
    passage, some = " ".join(rng.choices(WORDS, k=50)), lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [(i, f"{some(rng.randrange(9))} {passage} {some(20)}") for i in range(300)] + [(7, f"{passage} again {passage}")] * 30 + [(None, passage)] * 5
    got = substrings.deduplicate(frame(spark, rows, False), chunk_bytes=9000, bucket_bytes=9000).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((None if i == 2**63 else i, *x) for i, *x in brute_substrings(rows)), key=repr)
    few = substrings._given_out(spark.createDataFrame([(1, 25), (2, 1)], "doc_id long, copies long"), 10)
    assert sorted(r.doc_id for r in few.collect()) == [1] * 25 + [2]


def test_substrings_of_extreme_ids(spark):
    """The largest id is a number like any other, also beside null ids, which come after it."""
    passage = " ".join(WORDS[:40])
    rows = [(2**63 - 1, passage), (None, passage), (None, f"x {passage} y"), (-(2**63), "a b"), (5, f"{passage} z"), (2**63 - 1, passage)]
    for some in (rows, rows[1:], [rows[0], *rows[3:]], [*rows[:4], rows[5]]):
        got = sorted((tuple(r) for r in substrings.digests(frame(spark, some, False)).collect()), key=repr)
        assert got == brute_substrings(some)


def test_cover():
    for shift in range(substrings.PERIOD):
        assert any((a - b) % substrings.PERIOD == shift for a in substrings.COVER for b in substrings.COVER)


def test_words_are_those_of_split():
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"ab \t\n\x0b\x0c\r\x1c\x85\xc3\xa9AB") for _ in range(rng.randrange(40)))
        starts, ends, h = common.words(data)
        assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split()
        same = {}
        for w, x in zip(data.split(), h, strict=True):
            assert same.setdefault(w, x) == x
        assert len(set(same.values())) == len(same)
    long = b"x" * 300_000 + b" " + b"y " * 300_000
    (_, counts, h), = common.hashed([long])
    assert counts[0] == len(h) == 300_001


# --- 8 -------------------------------------------------------------------------------------------


def brute_neardup(rows, s=85, n=5):
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(sets[i] & sets[j]) >= s * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = [a if x == b else x for x in part]
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(((i, len(x), least[p] if i is not None else None, i is None or i == least[p]) for (i, _), x, p in zip(rows, sets, part, strict=True)), key=repr)


def test_near_duplicates(spark):
    rows = [*corpus(), (None, "w1 w2 w3"), (None, None)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == brute_neardup([*rows, rows[-1]])
    assert sum(not r[3] for r in got) >= 3
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(14)
    base = rng.choices(WORDS, k=150)
    near, other = [*base[:149], "edit"], rng.choices(WORDS, k=90)
    rows = [(1, " ".join(base)), (5, " ".join(near)), (5, " ".join(other)), (7, " ".join([*other[:89], "edit"])), (5, " ".join(other))]
    want = brute_neardup(rows)
    assert (5, len(set(zip(near, near[1:], near[2:], near[3:], near[4:]))), 1, False) in want  # noqa: B905
    for order in ([0, 1, 2, 3, 4], [0, 2, 1, 3, 4], [4, 3, 2, 1, 0]):
        assert sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, [rows[k] for k in order], False)).collect()), key=repr) == want


def test_near_duplicates_with_a_template_and_a_hub(spark):
    """A template in every document makes buckets whose members stay apart; near copies of one text make a hub."""
    rng = random.Random(15)
    some = lambda n: rng.choices(WORDS, k=n)
    template, base = some(70), some(160)
    rows = [(i, [*template, *some(25)]) for i in range(150)]
    rows += [(200 + i, [*w[:90], "edit", *w[91:]]) for i, (_, w) in enumerate(rows[:20])]
    rows += [(300 + i, [*base[:k], f"edit{i}", *base[k + 1 :]]) for i, k in enumerate(rng.sample(range(160), 60))]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in rows]
    # few members a bucket and few pairs a hub, so that rare shingles and salts do the work
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows, False), bucket=4, hub=8).collect()), key=repr)
    assert got == brute_neardup(rows) == sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows, False)).collect()), key=repr)
    assert sum(not r[3] for r in got) >= 20 + 59


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**64, 400, dtype=np.uint64)]))
    s = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a)]), 1024)
    assert abs((s[0] == s[1]).mean() - 600 / 1400) < 0.06


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    part = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                part[a] = part[b] = min(part[a], part[b])
    assert got == part


# --- 10 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary())


def test_bpe(spark, library):
    rng = random.Random(6)
    odd = ["<|endoftext|>", " <|endoftext|>x", "don't I'LL 12½ ²x\x1c\x85 \xa0é日本語࢏\U0001f600", "a" * 5000, " " * 300 + "x", "\r\n\r\n \t", "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x4000), rng.randrange(0xE000, 0x110000)])) for _ in range(3000))]
    rows = [*corpus(), *((1000 + i, t) for i, t in enumerate(odd)), (None, "null id")]
    df = frame(spark, rows)
    want = []
    for i, t in [*rows, rows[-1]]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert text == (t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.digests(df, queries.vocabulary()).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(empty(spark), queries.vocabulary()).count() == 0
    assert dict(bpe.encode(df, queries.vocabulary()).dtypes)["token_ids"] == "array<int>"


def test_long_pieces(library):
    """Pieces without a break, window by window, give what the library gives; memory stays small beside the piece."""
    import tracemalloc

    coder = bpe.Encoder(bpe.Vocabulary(queries.vocabulary()))
    rng = random.Random(27)
    for s in ("a" * 3000, "".join(rng.choices("abcdefghij", k=3000)), "thequickbrownfoxjumpsoverthelazydog" * 60, "é" * 999, "=" * 2500):
        want = library.encode(s, add_special_tokens=False).ids
        for window in (7, 64, 1 << 14):
            assert list(coder.piece(s, window)) == want
    piece = "".join(rng.choices("etaoinshrdlu", k=400_000))
    coder.piece(piece)  # the table of pairs, whose size is bounded, fills
    tracemalloc.start()
    ids = coder.piece(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert coder.decode(np.array(ids, np.int32)) == piece.encode() and peak < (16 << 20) + 15 * len(piece)


# --- 1 -------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5, 80)))) for i in range(600)]
    bad = {i for i in range(0, 600, 4)}
    rows = [(i, t + " " + rng.choice(["zorgul", "blaxxit"]) + " " + t[:20] if i in bad else t) for i, t in rows]
    labels = spark.createDataFrame([*((i, 0, int(i in bad)) for i, _ in rows), (None, 0, 1), (5, 0, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    extra = [(700, None), (701, ""), (None, "w1"), (702, "w1 " * 50000 + "zorgul")]
    got = {r[0]: r for r in toxicity.judged(frame(spark, [*rows, *extra]), labels).collect()}
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i in held) and sum(r.held_out for r in got.values() if r.doc_id is not None and r.doc_id < 600) == len(held)
    assert np.mean([got[i].predicted == (i in bad) for i in held]) > 0.95 and got[702].predicted == 1
    assert got[700].score == got[701].score
    same = {r[0]: r.score for r in toxicity.judged(frame(spark, rows), labels.where("doc_id is not null").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()}
    assert all(abs(same[i] - got[i].score) < 1e-9 for i, _ in rows)  # held-out labels change nothing
    none = toxicity.judged(frame(spark, rows[:5]), labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and toxicity.judged(empty(spark), labels).count() == 0


def test_toxicity_scores_by_brute_force(spark):
    """The score of a text, from its n-grams one by one, and the fitted scale from counts one by one."""
    rng = random.Random(25)
    rows = [(i, " ".join(rng.choices(WORDS[:60], k=25)) + (rng.choice([" zorgul", "\tBLAXXIT é"]) if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows, False), labels)

    def slots(text):
        raw, out = re.sub(rb"[ \t-\r]+", b" ", b" " + text.lower().encode() + b" "), set()
        for n in toxicity.NGRAMS:
            for k in range(len(raw) - n + 1):
                x = sum((c + 1) * int(f) for c, f in zip(raw[k : k + n], toxicity._BY, strict=False)) % 2**64
                out.add(((x ^ x >> 29) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS))
        return out

    learned = [(i, slots(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = sum(i % 3 == 0 for i, _ in learned)
    counts = {}
    for i, found in learned:
        for x in found:
            counts.setdefault(x, [0, 0])[i % 3 == 0] += 1
    used = set()
    for x, (c, t) in counts.items():
        ratio, error = toxicity._ratio(t, c, toxic, len(learned) - toxic, 1.0, np.log, np.sqrt)
        if c + t >= 3 and abs(ratio) > 3.5 * error:
            used.add(x)
    assert used and set(np.flatnonzero(model.weights)) <= used and len(np.flatnonzero(model.weights)) > 0.9 * len(used)
    for text in [t for _, t in rows[:40]] + ["", " \n ", "zor", "Zorgul  zorgul"]:
        x = sum(float(model.weights[k]) for k in slots(text)) + model.intercept
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-6)


# --- 5 -------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[100:700] = x[100]
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(4000, None), (4050, [0.0] * 16), (4100, [float("nan")] + [1.0] * 15), (4150, [None] + [1.0] * 15), (4200, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    hits = 0
    assert sorted(by) == list(range(0, 3000, 50))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        s = y @ y[q]
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all(abs(s[r.vec_id] - r.score) < 1e-12 and r.vec_id != q for r in found)
        s[q] = -9
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]))
    assert hits / 5 / len(by) >= 0.9
    few = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"leaf": F.lit(1), "rank": F.lit("r"), "page": F.lit(2)}), block=100)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, got))  # small blocks, clashing names
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def test_neighbours_of_unusual_vectors(spark):
    """Vectors in a narrow cone, and vectors of which some have far nearer neighbours than the usual ones: as brute force finds them."""
    rng = np.random.default_rng(28)
    mixed = rng.standard_normal((4000, 24))
    close = rng.random(4000) < 0.6
    mixed[close] = (rng.standard_normal((20, 24))[rng.integers(0, 20, 4000)] + 0.02 * rng.standard_normal((4000, 24)))[close]
    for x in (rng.standard_normal((4000, 24)) + 4, mixed):
        x = x.astype(np.float32)
        got = neighbours.nearest(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>"), block=1000).collect()
        y = x.astype(np.float64)
        y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
        found = {(r.query_id, r["rank"]): r.vec_id for r in got}
        for q in range(0, 4000, 50):
            s = y @ y[q]
            s[q] = -9
            assert [found[q, r] for r in range(1, 6)] == np.argsort(-s)[:5].tolist()


def test_leaves_are_left_out_only_where_they_hold_nothing_nearer():
    widest, cosines = np.cos([0.2, 0.2, 0.9]), np.cos([[0.5, 1.2, 1.2]])
    assert neighbours.possible(cosines, np.array([*widest[:2], 2.0]), np.cos([0.6])).tolist() == [[True, False, False]]
    assert neighbours.possible(cosines, widest, np.array([-2.0])).all() and neighbours.possible(cosines, widest, np.cos([0.31])).tolist() == [[True, False, True]]


def test_forest_search_is_sure_enough():
    """Recall against brute force and the share of vectors that are compared: clustered vectors need few, random directions many."""
    rng = np.random.default_rng(18)
    heads = rng.standard_normal((200, 32))
    for x, most in ((heads[rng.integers(0, 200, 12_000)] + 0.4 * rng.standard_normal((12_000, 32)), 0.1), (rng.standard_normal((12_000, 16)), 0.35), (rng.standard_normal((12_000, 64)), 0.8)):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        forest = neighbours.Forest(x[:5000], 9, 8, 5, len(x))
        leaves, hits, seen = forest.leaves(x), 0, 0.0
        for q in range(60):
            s = x @ x[q]
            s[q] = -9
            wanted = np.zeros(8 << 9, bool)
            wanted[forest.search(x[q])] = True
            met = wanted[leaves].any(axis=1)
            hits, seen = hits + met[np.argsort(-s)[:5]].sum(), seen + met.mean()
        assert hits / 300 >= 0.9 and seen / 60 <= most, (hits / 300, seen / 60)


# --- 2 -------------------------------------------------------------------------------------------


def brute_occurs(item, text, most):
    """Whether item is at most `most` edits from some stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) <= most


def edited(w, edits, rng):
    w = list(w)
    for _ in range(edits):
        at, op = rng.randrange(len(w)), rng.random()
        w[at : at + (op < 0.7)] = [] if op < 0.3 else [f"zz{rng.randrange(99)}"]
    return w


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([3, 7, 20, 40, 55])] + [(7, None), (8, ""), (9, "Mono stereo!"), (10, "quadro"), (11, "机器学习的模型"), (None, "w1 w2 w3 w4")]
    docs = []
    for i in range(60):
        w = items[i % 5][1].split()
        w = edited(w, decontaminate.allowed(len(w)) if i % 2 else 0, rng)
        docs.append((i, " ".join(rng.choices(WORDS, k=30)) + " " + ", ".join(w).upper() + "! " + " ".join(rng.choices(WORDS, k=rng.randrange(30)))))
    docs += [(i, " ".join(rng.choices(WORDS, k=200))) for i in range(60, 90)] + [(90, None), (91, ""), (93, "a mono  STEREO b"), (94, "mono b stereo quadro"), (95, "这是机器学习的模型。"), (96, "这是机学的模型。"), (97, "mono")]
    table = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, [*docs, (92, "w " * 70000 + items[3][1])])
    got = {r.doc_id: r for r in decontaminate.judged(df, table).collect()}
    words = lambda t: re.findall(r"[\u4e00-\u9fff]|[a-z0-9]+", (t or "").lower())
    want = {i: [k for k, x in items if k is not None and words(x) and brute_occurs(words(x), words(t), decontaminate.allowed(len(words(x))))] for i, t in docs}
    assert all(set(got[i].item_ids) <= set(want[i]) for i in want) and got[92].item_ids == [3]
    assert sum(len(got[i].item_ids) for i in want) >= sum(map(len, want.values())) - 1
    assert want[93] == [9] and want[94] == [10] and want[95] == [11] and want[96] == want[97] == []
    assert {r.doc_id: len(r.matches) for r in decontaminate.find(frame(spark, docs, False), table, block_bytes=200).collect()} == {i: got[i].n_matches for i in want}
    assert decontaminate.judged(empty(spark), table).count() == 0 and decontaminate.judged(df, table.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_items_with_a_common_stem():
    """Thousands of items that share most of their words cost a text that holds only the stem time in proportion to their number, and bounded memory; those that are there are found."""
    import time
    import tracemalloc

    rng = random.Random(7)
    word = lambda: f"q{rng.randrange(10**6)}"
    stem = [word() for _ in range(14)]
    items = [" ".join(stem + [word() for _ in range(8)]) for _ in range(10_000)]
    texts = [" ".join([word() for _ in range(20)] + stem + [word() for _ in range(20)]) for _ in range(64)]
    small, all_ = (decontaminate.Items(list(range(n)), items[:n]) for n in (1000, 10_000))
    took = []
    for searched in (small, all_):
        began = time.process_time()
        assert not any(searched.search(texts))
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 2
    tracemalloc.start()
    all_.search(texts[:8])
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    held = [f"{texts[i]} {' '.join(edited(items[i * 150].split(), 4, rng))} {word()}" for i in range(60)]
    found = [any(m[0] == i * 150 for m in f) for i, f in enumerate(all_.search(held))]
    assert sum(found) >= 58


def test_decontamination_words_that_lack_take_an_edit_each(monkeypatch):
    """What is left out where a window has many items would not have matched: results are equal without it."""
    rng = random.Random(9)
    stem = rng.choices(WORDS, k=12)
    items = [" ".join(stem + rng.choices(WORDS, k=6)) for _ in range(80)]
    texts = [" ".join(rng.choices(WORDS, k=10) + edited(items[i].split(), i % 5, rng) + rng.choices(WORDS, k=10)) for i in range(80)]
    one = decontaminate.Items(list(range(80)), items).search(texts)
    monkeypatch.setattr(decontaminate, "MANY", 10**9)
    monkeypatch.setattr(decontaminate, "EXPANDED", 500)
    assert one == decontaminate.Items(list(range(80)), items).search(texts) and sum(map(len, one)) >= 60


def test_decontamination_recall_at_all_edits():
    """Windows of whole texts through the keys alone, against brute force; and leaving out windows that can hold no item changes nothing."""
    rng = random.Random(19)
    common = [f"w{int(rng.paretovariate(0.8)) % 2000}" for _ in range(4000)]
    found = total = 0
    for n in (6, 11, 18, 30, 50):
        e = decontaminate.allowed(n)
        items = [" ".join(rng.choices(common, k=n)) for _ in range(60)]
        texts = [" ".join([*rng.choices(common, k=40), *edited(x.split(), e, rng), *rng.choices(common, k=40)]) for x in items]
        sifted, whole = (decontaminate.Items(list(range(60)), items, sift=sift).search(texts) for sift in (True, False))
        assert sifted == whole
        for k, (x, t) in enumerate(zip(items, texts, strict=True)):
            assert all(brute_occurs(items[m[0]].split(), t.split()[m[1] : m[2]], m[3]) and m[3] <= e for m in whole[k])
            total += brute_occurs(x.split(), t.split(), e)
            found += any(m[0] == k for m in whole[k])
    assert total == 300 and found >= 0.97 * total


def test_candidates_come_from_keys(monkeypatch):
    items = decontaminate.Items([1], [" ".join(WORDS[:20])])
    assert items.search([" ".join(WORDS[:30])])[0]
    monkeypatch.setattr(decontaminate, "keys", lambda x, repeats, sampled: np.full((len(x), repeats), 7, np.uint64))
    assert not items.search([" ".join(WORDS[:30])])[0]


def test_edit_distance():
    rng = random.Random(10)
    for _ in range(60):
        n, most = rng.randrange(1, 9), rng.randrange(0, 4)
        a = np.array([[rng.randrange(3) for _ in range(n)] for _ in range(5)], np.uint64)
        b = np.array([[rng.randrange(3) for _ in range(n + most)] for _ in range(5)], np.uint64)
        edits, ends = decontaminate.distances(a, b, most)
        for x, y, got, end in zip(a, b, edits, ends, strict=True):
            d = np.arange(len(y) + 1)
            for i, u in enumerate(x, 1):
                new = [i]
                for j, v in enumerate(y, 1):
                    new.append(min(new[-1] + 1, d[j] + 1, d[j - 1] + (u != v)))
                d = np.array(new)
            assert got == min(d.min(), most + 1) and (got > most or d[end] == got)


# --- 9 -------------------------------------------------------------------------------------------


def test_pii(spark):
    text = "Mail Jo.Doe7@mail.example.com or call +1 (212) 555-0187; card 4111 1111 1111 1111, not 4111 1111 1111 1112; born 1984-02-29, ip 10.1.2.3 not 10.1.2.333, ssn 123-45-6789, DE89370400440532013000, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    rows = [(1, text), (2, None), (3, ""), (4, "again JO.DOE7@mail.example.com 4111111111111111"), (5, "w " * 60000 + "10.1.2.3"), (None, "no id 10.1.2.3")]
    df = frame(spark, rows)
    done = pii.pseudonymise(df, b"k")
    got = {r.doc_id: r for r in done.collect()}
    assert [p.kind for p in got[1].pii] == ["mail", "phone", "card", "date", "ip", "ssn", "iban", "secret"] and got[2].text is None and got[3].text == ""
    new = got[1].text
    for old in ("Jo.Doe7", "555-0187", "4111 1111 1111 1111,", "1984-02-29", "10.1.2.3 ", "123-45-6789", "DE89370400440532013000", "04dbebab"):
        assert old not in new
    assert "4111 1111 1111 1112" in new and "10.1.2.333" in new and re.sub(r"[A-Za-z0-9]", "x", new).replace("x", "") == re.sub(r"[A-Za-z0-9]", "x", text).replace("x", "")
    card = re.search(r"card ([\d ]{19})", new)[1]
    assert card.replace(" ", "") == re.search(r"\d{16}", got[4].text)[0] and pii.luhn(card.replace(" ", "")[:-1]) == int(card[-1])
    assert re.search(r"Mail (\S+)", new)[1].lower() == re.search(r"again (\S+)", got[4].text)[1].lower()
    back = {r.doc_id: r.text for r in pii.pseudonymise(done, b"k", back=True).collect()}
    assert back == dict(rows) and pii.pseudonymise(empty(spark)).count() == 0


def test_feistel_permutes():
    f = pii.Feistel(b"k")
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(f.permute(x, n, "t") for x in range(n)) == list(range(n)) and all(f.undo(f.permute(x, n, "t"), n, "t") == x for x in range(n))


def test_pii_key(spark):
    df = spark.createDataFrame([(1, "call 10.1.2.3 on 1984-02-29T10:00:00Z")], "doc_id long, text string")
    text = lambda *key: pii.pseudonymise(df, *key).first().text
    assert text() == text() != text(b"a") != text(b"b") and "1984-02-29" not in text() and text().endswith("T10:00:00Z")
    spark.conf.set(pii.SECRET, "a")
    assert text() == text(b"a")
    spark.conf.unset(pii.SECRET)


def test_pseudonyms_permute_whole_formats():
    """Every date, and many values of the other formats: pseudonyms are valid, differ, and lead back."""
    import datetime

    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    days = [datetime.date.fromordinal(n).isoformat() for n in range(pii._DAYS[0], pii._DAYS[1] + 1, 7)]
    new = [there.date(d) for d in days]
    assert len(set(new)) == len(days) and all(datetime.date.fromisoformat(x) and back.date(x) == d for d, x in zip(days, new, strict=True))
    rng, made = random.Random(23), {"card": set(), "iban": set(), "ssn": set(), "ip": set()}
    while len(made["card"]) < 300:
        d = "".join(rng.choices("0123456789", k=15))
        made["card"].add(d + str(pii.luhn(d)))
        body = "".join(rng.choices("0123456789", k=18))
        made["iban"].add(f"DE{98 - int(body + '131400') % 97:02d}{body}")
        made["ssn"].add(f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}")
        made["ip"].add(".".join(str(rng.randrange(256)) for _ in range(4)))
    for kind, values in made.items():
        new = {getattr(there, kind)(v) for v in values}
        assert len(new) == len(values) and None not in new and {getattr(back, kind)(v) for v in new} == values
        for v in new:
            if kind == "card":
                assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(v))) % 10 == 0
            elif kind == "iban":
                assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_pii_spans_by_brute_force():
    """Values planted in words, against the places that they were put at; near misses stay."""
    rng, names = random.Random(24), pii.Pseudonyms(b"k")
    good = [("mail", "a.b@ex.org"), ("card", "4111111111111111"), ("ssn", "123-45-6789"), ("ip", "10.20.30.40"), ("date", "2001-12-31"), ("date", "31/12/2001"), ("phone", "+1 212 555 0187"), ("phone", "(212) 555-0187"), ("iban", "DE89370400440532013000")]
    bad = ["4111111111111112", "000-45-6789", "10.20.30.400", "2001-13-31", "31/31/2001", "DE89370400440532013001", "a@", "@b", "12", "1.2.3"]
    for _ in range(200):
        text, want = "", []
        for _ in range(rng.randrange(1, 12)):
            if rng.random() < 0.5:
                kind, value = rng.choice(good)
                want.append((kind, len(text), len(text) + len(value)))
            else:
                value = rng.choice([*bad, *WORDS[:20]])
            text += value + rng.choice([", ", " ; ", "\n", " and "])
        new, spans = names.apply(text)
        assert spans == want
        at = 0
        for _, b, e in want:
            assert text[at:b] == new[at:b] and text[b:e] != new[b:e]  # a few values change their length: dates without leading zeros and addresses
            if len(new) != len(text):
                break
            at = e


# --- 3, 4, 6 -------------------------------------------------------------------------------------


def test_licences(spark):
    s = licences.SENTENCES
    rows = [(1, "x\n" + s["mit-released"].upper() + "\n"), (2, None), (3, ""), (4, " ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"))), (5, s["bsd-binary"] + " " + s["bsd-grant"]), (6, "word. " * 50000 + s["cc0-1.0"]), (7, " ".join(s[k] for k in ("apache-2.0-grant-may", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see")) + " Odd one. " + s["mit-released"])]
    got = {r.doc_id: r.licences for r in licences.licensed(frame(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: [], 3: [], 4: ["BSD-3-Clause"], 5: [], 6: ["CC0-1.0"], 7: ["Apache-2.0", "MIT"]}
    assert licences.licensed(empty(spark)).count() == 0


def test_wrapped_licences():
    import textwrap

    s, rules = licences.SENTENCES, licences.Rules()
    wanted = {
        "MIT": ("mit-grant", "mit-notice", "mit-as-is"), "GPL-3.0-or-later": ("gpl-free", "gpl-hope", "gpl-see"), "BSD-3-Clause": ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"),
        "Apache-2.0": ("apache-2.0-grant-may", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see"), "ISC": ("isc-grant",), "AGPL-3.0-or-later": ("agpl-free",),
    }
    for name, parts in wanted.items():
        for mark in ("", "# ", " * ", "// ", ";; "):
            for gap in (" ", "\n\n"):
                wrapped = [x for p in gap.join(s[k] for k in parts).replace("<holder>", "the copyright holder").split("\n\n") for x in [*textwrap.wrap(p, 70), ""]]
                text = "\n".join((mark + x).rstrip() for x in ["Some heading", "", *wrapped, "def f():"])
                assert [x[0] for x in rules.licences(text)] == [name], (name, mark, gap)
    apache = s["apache-2.0-grant-may"] + "\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + s["apache-2.0-as-is"] + "\n"
    assert [x[1] for x in rules.sentences(apache)] == ["apache-2.0-grant-may", "apache-2.0-copy", "apache-2.0-as-is"]
    assert rules.licences("not " + s["mit-grant"].replace(" ", "\n")) == [] and rules.licences(s["mit-released"][:-1] + " or another one") == []


LICENCE_TEXTS = {
    "MIT": """MIT License

Copyright (c) 2019 Jane Q. Public

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.""",
    "BSD-3-Clause": """Copyright (c) 2009, Example Widgets, Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of Example Widgets, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "Zlib": """Copyright (C) 2001 Some Body

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>

 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


@pytest.mark.parametrize("name", sorted(LICENCE_TEXTS))
def test_licence_texts_as_they_stand_in_files(name):
    import textwrap

    rules = licences.Rules()
    for width in (72, 80):
        body = "\n".join("\n".join(textwrap.wrap(x, width) if not x.startswith(" ") else [x]) for x in LICENCE_TEXTS[name].split("\n"))
        for text in (body, *("\n".join((mark + x).rstrip() for x in body.split("\n")) for mark in ("# ", "// ")), "/*\n" + "\n".join((" * " + x).rstrip() for x in body.split("\n")) + "\n */"):
            assert [x[0] for x in rules.licences(text + "\n\nint main() { return 0; }\n")] == [name]


def test_licences_by_brute_force():
    """Sequences of identifiers, drawn at random, against trying every choice of places for every rule."""
    rng = random.Random(22)
    names = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "mit-grant", "mit-notice", "mit-as-is", "cc0-1.0", "gpl-free", "gpl-hope", "gpl-see"]
    rules = licences.Rules()
    for _ in range(150):
        kinds = [rng.choice([*names, None]) for _ in range(rng.randrange(12))]
        text = "\n\n".join(licences.SENTENCES[k].replace("<holder>", "Some Body") if k else "Odd one." for k in kinds)
        assert [x[1] for x in rules.sentences(text)] == [k for k in kinds if k]
        free, want = [True] * len(kinds), []
        for licence, parts in sorted(licences.RULES, key=lambda r: -len(r[1])):
            for start in range(len(kinds)):
                picked = [start]
                while free[start] and kinds[picked[-1]] == parts[len(picked) - 1] and len(picked) < len(parts):
                    step = next((k for k in range(picked[-1] + 1, len(kinds)) if free[k] and kinds[k] == parts[len(picked)]), None)
                    if step is None or sum(kinds[k] is None for k in range(picked[-1], step)) > rules.gap:
                        break
                    picked.append(step)
                if free[start] and len(picked) == len(parts) and kinds[picked[-1]] == parts[-1]:
                    want.append((licence, picked[0], picked[-1]))
                    for k in picked:
                        free[k] = False
        assert rules.licences(text) == sorted(want, key=lambda x: (x[1], x[2], x[0]))


def test_lm_scoring(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"] if i % 2 else ["delta", "omega", "sigma"], k=30))) for i in range(200)] + [(500, None), (501, ""), (None, "alpha")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    got = {r.doc_id: r for r in lmscore.scored(df, labels).collect()}
    assert all((got[i].difference < 0) == (i % 2 == 1) for i in range(100, 200)) and got[500].difference is None and got[500].n_tokens == 0
    target, background = lmscore.count(df, labels)
    assert target[lmscore._AT1 :].sum() == sum(len(t) for i, t in rows[:100] if i % 2) and (background + target)[lmscore._AT1 :].sum() == sum(len(t or "") for _, t in [*rows, rows[-1]])
    from collections import Counter

    pairs = Counter()
    for _, t in [*rows, rows[-1]]:
        b = b"\n" + (t or "").encode()
        pairs.update(zip(b, b[1:], strict=False))
    assert all((background + target)[lmscore._AT2 + 256 * a + b] == n for (a, b), n in pairs.items())
    assert lmscore.scored(empty(spark), labels).count() == 0 and lmscore.scored(df, labels.limit(0)).count() == 204


def test_lm_losses_are_exact(spark):
    from collections import Counter
    from math import log2

    rng = random.Random(21)
    # many scripts: far more distinct sequences than any table of fixed size would keep apart
    some = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    rows = [(i, some(2400) if i % 3 else some(300)) for i in range(400)] + [(500, "x" * 300000), (501, None), (502, ""), (None, some(9))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    grams = [Counter(), Counter()]
    for i, t in rows:
        b = b"\n\n\n" + (t or "").encode()
        found = [b[k - 3 : k + 1] for k in range(3, len(b))]
        grams[1 - (i is not None and i < 100 and i % 2)].update(found)
    assert len(grams[1]) > 1 << 20
    tables, size = [], [sum(g.values()) for g in grams]
    for v, g in enumerate(grams):
        g = {x: c * min(1, size[1 - v] / size[v]) for x, c in g.items()}  # the larger corpus counts as much as the smaller
        n, ctx = [Counter() for _ in range(5)], [Counter() for _ in range(5)]
        for x, c in g.items():
            for k in (1, 2, 3, 4):
                n[k][x[4 - k :]] += c
                ctx[k][x[4 - k : 3]] += c
        tables.append((n, ctx))

    def loss(v, x):
        n, ctx = tables[v]
        p = (n[1][x[3:]] + 1) / (ctx[1][b""] + 256)
        for k in (2, 3, 4):
            p = (n[k][x[4 - k :]] + lmscore.SMOOTH * p) / (ctx[k][x[4 - k : 3]] + lmscore.SMOOTH)
        return -log2(p)

    got = {r.doc_id: r for r in lmscore.scored(frame(spark, rows, False), labels).collect()}
    assert len(got) == len(rows) and got[501].difference is None and got[502].n_tokens == 0
    for i, t in [*rows[:3], *rows[200:203], rows[400], rows[403]]:
        b = b"\n\n\n" + t.encode()
        for v, name in enumerate(("target_loss", "background_loss")):
            want = sum(loss(v, b[k - 3 : k + 1]) for k in range(3, len(b))) / (len(b) - 3)
            assert got[i][name] == pytest.approx(want, rel=1e-9)
    # the probabilities of what may follow a context add up to 1
    for context in (rows[0][1].encode()[:3], b"xxx", b"\xff\xfe\xfd"):
        for v in (0, 1):
            assert sum(2 ** -loss(v, context + bytes([d])) for d in range(256)) == pytest.approx(1)


PAGES = [
    ("<p>a<p>b", "a\n\nb"), ("x <b>y</b>  z", "x y z"), ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c".replace("  1", "  1")), ("<table><tr><th>Name<th>N<tr><td>pear<td>10</table>", "Name  N\npear  10"),
    ("<style>p{}</style><script>'</p>'</script>t<!-- c --><p hidden>h</p><p style='display: none'>n", "t"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<pre>\n a\n  b</pre>", " a\n  b"), ("&lt;&amp;&eacute; 1 < 2", "<&é 1 < 2"),
    ("<svg><title>t</title><text>label</text></svg><math><mi>x</mi><annotation>no</annotation></math>", "labelx"), ("<p style='visibility:hidden'>a<b style='visibility: visible'>b</b>c", "b"), ("<p style=display:none>a<b style='visibility:visible'>b</b>", ""),
    ("<table><tr><td rowspan=2>r<td>a<td>b<tr><td>c<td>d</table>", "r  a  b\n   c  d"), ("<table><tr><td>a<td rowspan=3 colspan=2>r<td>b<tr><td>c<td>d<tr><td>e<td>f</table>", "a  r    b\nc       d\ne       f"),
    ("<a title='x>y'>k</a", "k"), ("<table><tr><td colspan=2>w<td>e<tr><td>aa<td>bb<td>c</table>", "w       e\naa  bb  c"), ("</p></div>t</b>", "t"), (None, None), ("", ""), ("<div>" * 20000 + "deep", "deep"), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
]


def test_html_tables_stay_in_proportion():
    """One long cell, wide rows of empty cells, and columns that are spanned do not make a page's text many times the page."""
    row = "<tr><td>{}<td>b<td>c\n"
    pages = [
        "<table>" + row.format("x" * 20_000) + row.format("a") * 3000 + "</table>",
        "<table><tr>" + "<td>" * 1000 + "end" + "".join("<tr>" + "<td>" * 1000 + "z" for _ in range(100)) + "</table>",
        "<table>" + "<tr><td colspan=100><td colspan=100>y<td>" + "q" * 150 + "</table>" + "<table>" + "<tr><td colspan=100 rowspan=9>w<td>v" * 500 + "</table>",
        "<table>" + "".join("<tr>" + "<td>" * k + "m" for k in range(500)) + "</table>",
    ]
    for page in pages:
        assert len(html.render(page)) <= 20 * len(page)
    text = html.render(pages[0]).split("\n")
    assert text[0] == "x" * 20_000 + "  b  c" and set(text[1:]) == {"a  b  c"}
    assert html.render("<table><tr><td>long one<td>2<tr><td>s<td>3<tr><td><td>4</table>") == "long one  2\ns         3\n          4"
    assert html.render("<table><tr><td>a<td><td>c<tr><td>b<td colspan=2>d</table>") == "a     c\nb  d"


@pytest.mark.parametrize("page,text", PAGES)
def test_html(page, text):
    assert html.render(page) == text


def test_html_by_brute_force():
    """Random trees, drawn with and without the end tags that may be left out, against their visible words in order."""
    rng = random.Random(26)

    def draw(depth):
        kind = rng.choice(["word", "word", "b", "div", "p", "ul", "hide", "gone", "comment", "table"] if depth < 4 else ["word"])
        inside = lambda: [draw(depth + 1) for _ in range(rng.randrange(3))]
        join = lambda parts: (" ".join(x for x, _ in parts), [w for _, ws in parts for w in ws])
        if kind == "word":
            w = f"w{rng.randrange(10**6)}"
            return f"{w} ", [w]
        if kind == "comment":
            return "<!-- <p>c</p> -->", []
        if kind == "ul":
            items = [join(inside()) for _ in range(rng.randrange(3))]
            return "<ul>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x, _ in items) + "</ul>", [w for _, ws in items for w in ws]
        if kind == "table":
            cells = [f"w{rng.randrange(10**6)}" for _ in range(4)]
            return "<table><tr><td>{}<td>{}</td><tr><th>{}</th><td>{}</table>".format(*cells), cells
        html_, words = join(inside())
        if kind == "p":
            inline = [f"w{rng.randrange(10**6)}" for _ in range(2)]
            return f"<p>{inline[0]} <i>{inline[1]}</i>" + rng.choice(["", "</p>"]), inline
        if kind == "hide":
            return f"<div hidden>{html_}</div>", []
        if kind == "gone":
            return f"<script>if (a < b) {{ '{rng.randrange(9)}' }}</script>", []
        return f"<{kind}>{html_}</{kind}>", words

    for _ in range(300):
        parts = [draw(0) for _ in range(4)]
        got = [x for x in (html.render(" ".join(x for x, _ in parts)) or "").split() if x != "-"]
        assert got == [w for _, ws in parts for w in ws]


def test_html_frame(spark):
    df = spark.createDataFrame([(i, "u", p, "old") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html.extracted(df.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, library):
    import corpus_pipeline

    rng = random.Random(12)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    item = some(30)
    rows = [(i, some(60) + (" zorgul" if i % 5 == 0 else "")) for i in range(200)]
    rows += [(300, rows[1][1]), (301, some(20) + " " + item + " " + some(9)), (302, some(20) + " 10.1.2.3"), (303, None), (304, "")]
    frame(spark, rows, False).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i for i, _ in rows if not (i < 200 and i % 5 == 0) and i not in (300, 301)}
    assert set(got) == want
    texts = dict(rows)
    assert all(library.decode(r.token_ids, skip_special_tokens=False) == (texts[i] or "") for i, r in got.items() if i != 302)
    assert "10.1.2.3" not in library.decode(got[302].token_ids, skip_special_tokens=False)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, repeated rows, a very long text, clashing columns."""
    import corpus_pipeline

    def written(name, rows):
        at = tmp_path / name
        frame(spark, rows, False).write.parquet(str(at / "documents.parquet"))  # with columns named score, matches, pii and token_ids
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        return str(at)

    assert corpus_pipeline.run(spark, written("none", [])).count() == 0
    rng = random.Random(28)
    a, b, c = (" ".join(rng.choices(WORDS, k=60)) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (None, c), (None, c), (8, None), (9, ""), (10, "w1 w2 " * 40_000)]
    got = sorted(((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, written("odd", rows)).collect()), key=repr)
    assert sorted((i for i, _ in got), key=repr) == [1, 10, 5, 8, 9, None, None] and dict(got)[10] > 40_000 and dict(got)[8] == 0


def test_pipeline_drops_near_duplicates_from_80_on(spark):
    import corpus_pipeline

    rng = random.Random(31)
    rows = []
    for i in range(20):
        base = [f"d{i}x{k}" for k in range(250)]
        for copy, changed in ((1, 5), (2, 7)):  # 221 of 271 shingles are common (0.82), and 211 of 281 (0.75)
            w = list(base)
            for k in range(changed):
                w[20 + 30 * k] = f"edit{i}x{copy}x{k}"
            rows.append((10 * i + copy, " ".join(w)))
        rows.append((10 * i, " ".join(base)))
    rng.shuffle(rows)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows, False), "").collect()}
    want = {d for d, kept in ((d, k) for d, _, _, k in brute_neardup(rows, s=80)) if kept}
    assert got == want and not any(10 * i + 1 in got for i in range(20)) and all(10 * i + 2 in got for i in range(20))
