"""Full-text search: tokens, phrases within one field, BM25, snippets.

Tokens are runs of letters and digits of the folded text. Folding makes letters small, gives a letter that Unicode takes apart into a base and marks
as its base, and drops combining marks; letters without such parts (ß, ø) stay. Queries are folded in the same way. Without a kept index (see `index`) a search looks for
the query's tokens as plain text first and takes only texts that hold them all apart.
"""

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Tokens of a block of documents, which ends with the document that brings it to so many; pages of a block by hash of the token, and the mark of the page that lists its documents.
BLOCK, BUCKETS, WHOLE = 1 << 18, 64, -1
#: A page: the places of some tokens in a field of a block. ends: of each token the end of its places among all.
PAGE = "bucket int, field string, token array<string>, ends array<int>, doc array<{doc}>, pos array<int>"


@functools.cache
def folds() -> dict[str, str]:
    """Small letters of the basic plane with their base, and combining marks with nothing."""
    marks = [chr(c) for c in [*range(0x300, 0x370), 0x3099, 0x309A]]
    out = dict.fromkeys(marks, "")
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0xFFFF)]):
        base, *rest = unicodedata.normalize("NFD", c)
        if rest and c == c.lower() and all(unicodedata.category(m) == "Mn" for m in rest):
            out[c] = base
    return out


def folded(text):
    """A text as it is searched."""
    whole = sorted(folds(), key=lambda c: folds()[c] == "")  # those without a base last: translate drops what has no partner
    plain = F.octet_length(text) == F.char_length(text)  # ASCII has nothing to fold but capitals
    return F.when(plain, F.lower(text)).otherwise(F.translate(F.lower(text), "".join(whole), "".join(folds()[c] for c in whole)))


def tokens_of(text):
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), 0)


def postings(docs: DataFrame, key: str, fields: list[str], beside: tuple[str, ...] = ()) -> DataFrame:
    """The token table of several fields as pages, in one pass over the documents.

    The page WHOLE of a block has no tokens: it lists all the documents, those without tokens too, with the number of tokens of each as pos and the columns beside as further lists."""
    rows = docs.select(F.col(key).alias("doc"), *beside, *(F.coalesce(tokens_of(F.col(f).cast("string")), F.array().cast("array<string>")).alias(f"_tokens {i}") for i, f in enumerate(fields)))
    of = {c: rows.schema[c].dataType.simpleString() for c in ("doc", *beside)}

    def run(batches):
        for batch in batches:
            lists = [batch.column(f"_tokens {i}") for i in range(len(fields))]
            sizes = [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]
            all_ = np.sum(sizes, axis=0, dtype=np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(all_) // BLOCK)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(all_)], strict=True):
                doc, more = batch.column("doc").slice(start, end - start), {c: batch.column(c).slice(start, end - start) for c in beside}
                if len(doc):
                    yield _pages([WHOLE], None, pa.array([], pa.string()), [], [0, 0], doc, all_[start:end], [0, len(doc)], more)
                for field, tokens, size in zip(fields, lists, sizes, strict=True):
                    n = size[start:end]
                    row = np.repeat(np.arange(len(n)), n)
                    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    yield pages(field, tokens.slice(start, end - start).flatten(), doc.take(pa.array(row)), pos, {c: x.slice(0, 0) for c, x in more.items()})

    return rows.mapInArrow(run, PAGE.format(doc=of["doc"]) + "".join(f", `{c}` array<{of[c]}>" for c in beside))


def pages(field: str, tokens: pa.Array, doc: pa.Array, pos: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The pages of some places in a field, one for each bucket: places grouped by token, else in their order."""
    words = tokens.dictionary_encode()
    bucket = np.array([zlib.crc32(t) for t in words.dictionary.cast(pa.binary()).to_pylist()], np.int64) % BUCKETS
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty_like(by_bucket)
    rank[by_bucket] = np.arange(len(by_bucket))
    code = rank[words.indices.to_numpy()]
    order = np.argsort(code, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(rank)))])
    some, first = np.unique(bucket[by_bucket], return_index=True)
    cuts = np.append(first, len(rank))  # of the tokens, between buckets
    within = ends[1:] - np.repeat(ends[cuts[:-1]], np.diff(cuts))
    return _pages(some, field, words.dictionary.take(pa.array(by_bucket)), within, cuts, doc.take(pa.array(order)), pos[order], ends[cuts], more)


def _pages(buckets, field: str | None, tokens: pa.Array, ends, cuts, doc: pa.Array, pos, doc_cuts, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """Pages from their lists end to end; cuts and doc_cuts are where those of tokens and of documents begin and end. More is for a single page, or empty."""
    lists = {"token": (tokens, cuts), "ends": (pa.array(ends, pa.int32()), cuts), "doc": (doc, doc_cuts), "pos": (pa.array(pos, pa.int32()), doc_cuts)}
    lists |= {c: (x, np.linspace(0, len(x), len(buckets) + 1)) for c, x in more.items()}
    columns = {"bucket": pa.array(buckets, pa.int32()), "field": pa.array([field] * len(buckets), pa.string())}
    return pa.RecordBatch.from_pydict(columns | {c: pa.ListArray.from_arrays(pa.array(np.asarray(at, np.int32)), x) for c, (x, at) in lists.items()})


def places(table: DataFrame, wanted: list[str] | None, *keep: str) -> DataFrame:
    """A row for each place in a token table: token, field, doc, pos and what else is to be kept; of the tokens that are wanted."""
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    size = lambda i: F.get("ends", i) - start(i)
    of = lambda t, i: F.struct(t.alias("token"), F.slice("doc", start(i) + 1, size(i)).alias("doc"), F.slice("pos", start(i) + 1, size(i)).alias("pos"))
    rows = table.where(F.col("bucket") != WHOLE)
    if wanted is not None:
        rows = rows.where(F.col("bucket").isin(*{zlib.crc32(t.encode()) % BUCKETS for t in wanted}))
    each = F.transform("token", lambda t, i: of(t, i) if wanted is None else F.when(t.isin(*set(wanted)), of(t, i)))
    return rows.select(*keep, "field", F.inline(F.filter(each, lambda x: x.isNotNull()))).select(*keep, "token", "field", F.inline(F.arrays_zip("doc", "pos")))


def lengths(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """doc, length: the number of tokens of each document, also of those without any."""
    n = sum((F.coalesce(F.size(tokens_of(F.col(f).cast("string"))), F.lit(0)) for f in fields[1:]), F.coalesce(F.size(tokens_of(F.col(fields[0]).cast("string"))), F.lit(0)))
    return docs.select(F.col(key).alias("doc"), F.greatest(n, F.lit(0)).cast("long").alias("length"))


def ranked(hits: DataFrame, lengths_: DataFrame) -> DataFrame:
    """doc, n, score of the documents that hold a phrase, from its hits (doc, field, n): BM25 of the phrase as one term, over all its fields. Statistics over all documents; a phrase in half of them or more counts for next to nothing, but not below it."""
    found = hits.groupBy("doc").agg(F.sum("n").alias("n"))
    stats = lengths_.agg(F.count("*").alias("all"), F.avg("length").alias("mean")).crossJoin(F.broadcast(found.agg(F.count("*").alias("having"))))  # one row each
    idf = F.greatest(F.log((F.col("all") - F.col("having") + 0.5) / (F.col("having") + 0.5)), F.lit(1e-6))
    score = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return found.join(lengths_, "doc").crossJoin(F.broadcast(stats)).select("doc", "n", score.alias("score"))


def query_tokens(query: str) -> list[str]:
    return re.findall(r"[^\W_]+", "".join(folds().get(c, c) for c in query.lower()))


def phrases(docs: DataFrame, key: str, fields: list[str], query: str) -> DataFrame:
    """doc, field, n: how often the query's tokens follow each other in each field of some documents; no token table. Texts that lack one of the tokens are not taken apart; places are counted within the row."""
    wanted = query_tokens(query)
    if not wanted:
        return docs.sparkSession.createDataFrame([], "doc long, field string, n long")
    texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))
    holds = functools.reduce(lambda x, y: x & y, (F.contains("f", F.lit(t)) for t in sorted(set(wanted))))
    rows = docs.select(F.col(key).alias("doc"), F.explode(texts).alias("x")).select("doc", "x.field", folded(F.col("x.text")).alias("f")).where(holds)
    first, rest = wanted[0], "".join(f" {t}" for t in wanted[1:])
    joined = F.concat(F.lit(" "), F.regexp_replace("f", r"[^\p{L}\p{N}]+", " "), F.lit(" "))  # with what follows looked at only, so that places may overlap
    n = F.regexp_count(joined, F.lit(f"(?<= ){first}(?={rest} )")).cast("long")
    return rows.select("doc", "field", F.explode(F.array(n)).alias("n")).where("n > 0")  # as a generator, so that the count is not made twice, for the filter too


def phrase(index_: DataFrame, query: str) -> DataFrame:
    """doc, field, n: from a token table, where the query's tokens follow each other."""
    return adjacent(places(index_, query_tokens(query)), query)


def adjacent(found: DataFrame, query: str) -> DataFrame:
    """doc, field, n: from the places of a query's tokens, where they follow each other. One pass: a hit of token i at place p votes for a start at p - i."""
    wanted = query_tokens(query)
    if not wanted:
        return found.sparkSession.createDataFrame([], "doc long, field string, n long")
    votes = F.filter(F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(wanted))), lambda x: F.when(x["t"] == F.col("token"), F.col("pos") - x["i"])), lambda x: x.isNotNull())
    starts = found.select("doc", "field", F.explode(votes).alias("start")).groupBy("doc", "field", "start").count().where(F.col("count") == len(wanted))
    return starts.groupBy("doc", "field").agg(F.count("*").alias("n"))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """doc, score of all documents that hold a token of the query; statistics over all documents. Texts are taken apart once: what is kept of each is its length and the number of each of the query's tokens."""
    wanted = sorted(set(query_tokens(query)))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    counted = docs.select(F.col(key).alias("doc"), tokens_of(F.col(text)).alias("t")).select("doc", F.size("t").alias("length"), *(times(w).alias(f"f{i}") for i, w in enumerate(wanted)))
    counted = cut(counted)
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(wanted))))
    scored = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.select("doc", score.alias("score")).where("score > 0")


@functools.cache
def _spellings() -> dict[str, str]:
    """Of each base the letters that fold to it."""
    out: dict[str, str] = {}
    for c, base in folds().items():
        if base:
            out[base] = out.get(base, "") + c
    return out


def _any_spelling(token: str) -> str:
    """A pattern of the ways in which a folded token can be written."""
    return "".join(f"[{c}{_spellings()[c]}][\u0300-\u036f]*" if c in _spellings() else c for c in token)


def top(scored: DataFrame, limit: int = 200) -> DataFrame:
    """The best hits; the limit is a feature and held between 1 and 1000."""
    return scored.orderBy(F.desc("score"), "doc").limit(max(1, min(limit, 1000)))


def snippet(text, query: str, width: int = 12):
    """Some tokens around the first place of the query as a phrase, which stands in brackets, with the marks between them as they are; null where it does not occur."""
    wanted = query_tokens(query)
    if not wanted:
        return F.lit(None).cast("string")
    token, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    lead = max(0, (width - len(wanted)) // 2)
    rest = max(0, width - len(wanted) - lead)
    pattern = rf"(?s)^((?:.*?[^\p{{L}}\p{{N}}])??)((?:{token}{gap}){{0,{lead}}}?)((?iu:{gap.join(map(_any_spelling, wanted))}))((?:{gap}{token}){{0,{rest}}})((?:[^\p{{L}}\p{{N}}].*)?)$"
    mark = "\x01"  # parts what the one pass of the pattern finds; taken out of the text before
    parts = F.split(F.regexp_replace(F.translate(text, mark, " "), pattern, rf"$1{mark}$2[$3]$4{mark}$5"), mark)
    bare = lambda c: ~c.rlike(r"[\p{L}\p{N}]")
    return F.when(F.size(parts) == 3, F.concat(F.when(bare(parts[0]), parts[0]).otherwise("…"), parts[1], F.when(bare(parts[2]), parts[2]).otherwise("…")))
