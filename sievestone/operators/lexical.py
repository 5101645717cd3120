"""BM25 over token arrays or over postings.

scan(): one pass over documents that hold their token arrays; occurrences are counted inside each row, the corpus
statistics are observed as rows pass, and only the matching rows' ids and counts are stored to be scored. search(): the same scores from postings sorted by term, which
read only the matching terms. Both give a phrase f = sum over columns of weight * occurrences,
idf = ln((N - n + .5) / (n + .5)), 1e-6 if not positive, and
score = sum over phrases of idf * f * 2.2 / (f + 1.2 * (.25 + .75 * |D| / avgdl)), |D| over all columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut
from .parsing import Phrase

K1, B = 1.2, 0.75
WEIGHTS = {"body": 1.0, "path": 0.4, "ids": 0.8}


def occurrences(tokens: Column, phrase: Phrase) -> Column:
    """How often a phrase stands in an array of tokens; tokens must be a column or variable, not an expression to repeat."""
    first, rest = phrase.terms[0], phrase.terms[1:]
    if phrase.prefix:
        return F.size(F.filter(tokens, lambda x: x.startswith(first)))
    if not rest:
        return F.size(F.filter(tokens, lambda x: x == first))

    def hit(x: Column, i: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.coalesce(F.get(tokens, i + F.lit(k)) == t, F.lit(False)) for k, t in enumerate(rest, 1)), x == first)

    return F.size(F.filter(tokens, hit))


def idf(total: Column, having: Column) -> Column:
    x = F.log((total - having + 0.5) / (having + 0.5))
    return F.when(x > 0, x).otherwise(F.lit(1e-6))


def _score(f: Column, idf_: Column, dl: Column, avgdl: Column) -> Column:
    return idf_ * (f * (K1 + 1)) / (f + K1 * (1 - B + B * dl / avgdl))


def frequencies(docs: DataFrame, phrases: list[Phrase], weights: dict[str, float], keep: list[str]) -> DataFrame:
    """keep columns, __dl (tokens in all arrays) and __f0, __f1, ... (weighted occurrences of each phrase) of every row.

    The arrays are bound once for each row, as one element of an array that is exploded: neither the counts nor a filter
    on them can be moved below it by the optimizer, which would make the tokens anew for each use.
    """
    arrays = F.struct(*(F.col(c).alias(f"a{i}") for i, c in enumerate(weights)))

    def counted(x: Column) -> Column:
        own = [x.getField(f"a{i}") for i in range(len(weights))]
        f = [reduce(lambda a, b: a + b, (F.lit(w) * occurrences(t, p) for t, w in zip(own, weights.values(), strict=True))).alias(f"__f{i}") for i, p in enumerate(phrases)]
        return F.struct(reduce(lambda a, b: a + b, map(F.size, own)).alias("__dl"), *f)

    return docs.select(*keep, F.inline(F.transform(F.array(arrays), counted)))


def scan(docs: DataFrame, phrases: list[Phrase], weights: dict[str, float], keep: list[str]) -> DataFrame:
    """keep columns and score of the rows of docs (with the token arrays that weights names) that match every phrase."""
    if not phrases:
        return docs.limit(0).select(*keep, F.lit(0.0).alias("score"))
    rows, stats, n = frequencies(docs, phrases, weights, keep), Observation(), range(len(phrases))
    seen = rows.observe(stats, F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avg"), *(F.count_if(F.col(f"__f{i}") > 0).alias(f"df{i}") for i in n))
    hits = cut(seen.filter(reduce(lambda a, b: a & b, (F.col(f"__f{i}") > 0 for i in n))))
    of = stats.get
    score = reduce(lambda a, b: a + b, (_score(F.col(f"__f{i}"), idf(F.lit(float(of["n"])), F.lit(float(of[f"df{i}"]))), F.col("__dl"), F.lit(of["avg"])) for i in n))
    return hits.select(*keep, score.alias("score"))


def postings(docs: DataFrame, key: str, columns: dict[str, str], phrases: list[Phrase] | None = None, stats: Observation | None = None) -> DataFrame:
    """term, col, key, positions, dl (tokens in all arrays): one row for each term in each token array; columns: name of the
    posting column by array.

    phrases: only terms that these need, filtered before anything is grouped. stats: observes n (how many docs there are) and
    avg (their mean dl, those with a null array left out) in the same pass.

    As in frequencies(), the arrays are bound once for each row, so that they are made once and docs are read once.
    """

    def bound(x: Column) -> Column:
        own = [x.getField(f"a{i}") for i in range(len(columns))]
        dl = reduce(lambda a, b: a + b, (F.coalesce(F.greatest(F.size(a), F.lit(0)), F.lit(0)) for a in own)).alias("dl")
        parts = F.array(*(F.struct(F.lit(name).alias("col"), a.alias("tokens")) for a, name in zip(own, columns.values(), strict=True)))
        return F.struct(dl, reduce(lambda a, b: a + b, map(F.size, own)).alias("size"), parts.alias("parts"))

    arrays = F.struct(*(F.col(c).alias(f"a{i}") for i, c in enumerate(columns)))
    rows = docs.select(key, F.inline(F.transform(F.array(arrays), bound)))
    if stats is not None:
        rows = rows.observe(stats, F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"))
    places = rows.select(key, "dl", F.inline("parts")).select(key, "dl", "col", F.posexplode("tokens").alias("pos", "term"))
    if phrases is not None:
        whole = sorted({t for p in phrases if not p.prefix for t in p.terms})
        places = places.filter(reduce(lambda a, b: a | b, (F.col("term").startswith(p.terms[0]) for p in phrases if p.prefix), F.col("term").isin(whole)))
    return places.groupBy("term", "col", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.first("dl").alias("dl"))


def search(posts: DataFrame, corpus: tuple[int, float], phrases: list[Phrase], key: str, weights: dict[str, float]) -> DataFrame:
    """key, score from postings and corpus (how many keys there are, and their mean dl)."""
    if not phrases:
        return posts.limit(0).select(key, F.lit(0.0).alias("score"))
    weight = reduce(lambda w, c: w.when(F.col("col") == c, weights[c]), weights, F.when(F.lit(False), 0.0))
    parts = []
    for i, p in enumerate(phrases):
        if p.prefix:
            rows = posts.filter(F.col("term").startswith(p.terms[0])).select(key, "col", "dl", F.size("positions").alias("n"))
        elif len(p.terms) == 1:
            rows = posts.filter(F.col("term") == p.terms[0]).select(key, "col", "dl", F.size("positions").alias("n"))
        else:  # a place where the phrase starts is met once for each of its terms
            own = [posts.filter(F.col("term") == t).select(key, "col", "dl", F.explode("positions").alias("at")).select(key, "col", "dl", (F.col("at") - k).alias("at"), F.lit(k).alias("k")) for k, t in enumerate(p.terms)]
            rows = reduce(DataFrame.unionByName, own).groupBy(key, "col", "at").agg(F.count("*").alias("m"), F.first("dl").alias("dl")).filter(F.col("m") == len(p.terms)).select(key, "col", "dl", F.lit(1).alias("n"))
        parts.append(rows.select(key, "dl", F.lit(i).alias("p"), (weight * F.col("n")).alias("f")))
    found = reduce(DataFrame.unionByName, parts).groupBy(key, "p").agg(F.sum("f").alias("f"), F.first("dl").alias("dl"))
    having = found.groupBy("p").agg(F.count("*").alias("df"))  # a row for each phrase of the query
    rows = found.join(F.broadcast(having), "p")
    rows = rows.withColumn("s", _score(F.col("f"), idf(F.lit(float(corpus[0])), F.col("df")), F.col("dl"), F.lit(float(corpus[1]))))
    return rows.groupBy(key).agg(F.sum("s").alias("score"), F.count("*").alias("m")).filter(F.col("m") == len(phrases)).select(key, "score")


def top(hits: DataFrame, k: int, *order: str, by: str = "score", ascending: bool = False) -> DataFrame:
    """The first k hits in a total order, without a full sort."""
    return hits.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), *order).limit(k)
