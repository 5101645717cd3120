import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.operators import fusion, lexical, postprocess
from sievestone.operators.parsing import parse_query, to_match


@pytest.mark.parametrize("q", ["aa", "aa bb", "aa aa", "a*", '"aa bb"', '"bb cc" a*', "zz", '"aa aa"'])
def test_bm25_equals_fts5(spark, q):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(body, path, ids)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    rng = random.Random(7)
    words = ["aa", "bb", "cc", "dd", "ab", "ee", "ff", "gg"]
    rows = [(i, *(" ".join(rng.choices(words, k=rng.randint(1, n))) for n in (12, 3, 4))) for i in range(40)]
    db.executemany("insert into t(rowid, body, path, ids) values (?, ?, ?, ?)", rows)
    want = {r: -s for r, s in db.execute("select rowid, bm25(t, 1.0, 0.4, 0.8) from t where t match ?", [to_match(parse_query(q, False))])}
    docs = spark.createDataFrame(rows, "id int, b string, p string, i string").select("id", *(T.tokens(F.col(c)).alias(n) for c, n in zip("bpi", ("body", "path", "ids"), strict=True)))
    got = {r.id: r.score for r in lexical.scan(docs, parse_query(q, False), lexical.WEIGHTS, ["id"]).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    posts = lexical.postings(docs, "id", {"body": "body", "path": "path", "ids": "ids"})
    corpus = docs.agg(F.count("*"), F.avg(F.size("body") + F.size("path") + F.size("ids"))).first()
    again = {r.id: r.score for r in lexical.search(posts, tuple(corpus), parse_query(q, False), "id", lexical.WEIGHTS).collect()}
    assert again == pytest.approx(want, abs=1e-12)


def test_empty_query(spark):
    docs = spark.createDataFrame([(1, ["a"])], "id int, body array<string>")
    assert lexical.scan(docs, parse_query("!!!"), {"body": 1.0}, ["id"]).count() == 0


def test_rrf(spark):
    mk = lambda rows: spark.createDataFrame([(p, s, i + 1) for i, (p, s) in enumerate(rows)], "path string, seq int, rank int")
    got = fusion.rrf([mk([("A", 0), ("both", 0)]), mk([("B", 0), ("both", 0)])], ["path", "seq"]).collect()
    assert got[0].path == "both"
    got = fusion.rrf([mk([("/b", 1)]), mk([("/a", 2)]), mk([("/a", 1)])], ["path", "seq"]).collect()
    assert [(r.path, r.seq) for r in got] == [("/a", 1), ("/a", 2), ("/b", 1)]


@pytest.mark.parametrize("k,filtered,want", [(10, False, 10), (3, True, 100), (50, True, 500)])
def test_pool(k, filtered, want):
    assert fusion.pool_size(k, filtered) == want


@pytest.mark.parametrize("rows,want", [([("p", 3, 50, 71), ("p", 9, 71, 90), ("p", 1, 5, 49), ("p", 2, 49, 49)], [1, 3]), ([("p", 4, 7, 9), ("r", 4, 7, 9)], [1, 2]), ([("p", 2, 0, 0), ("p", 4, 0, 0), ("p", 3, 0, 0), ("p", 1, 0, 0)], [1, 2]), ([("p", 2, 10, 12), ("p", 3, 0, 0)], [1])])
def test_dedupe(spark, rows, want):
    df = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "path string, seq int, line_start int, line_end int, rank int")
    assert sorted(r["rank"] for r in postprocess.dedupe(df).collect()) == want


def test_snippet(spark):
    df = spark.createDataFrame([("x" * 50 + " Searching here " + "y" * 50,), ("short",), ("z" * 60,)], "text string")
    got = [r.text for r in postprocess.snippets(df, "search", 30).collect()]
    assert got[0].startswith("...") and "Searching" in got[0] and len(got[0]) == 36
    assert got[1] == "short" and got[2] == "z" * 30 + "..."


def analysed(spark, text, stemmed=False):
    docs = spark.createDataFrame([(i, f"one of the two of the {i}") for i in range(50)], "id int, t string").repartition(3)
    words = T.tokens(F.col("t"))
    return lexical.frequencies(docs.select("id", (T.stems(words) if stemmed else words).alias("body")), parse_query(text, stemmed), {"body": 1.0}, ["id"])


@pytest.mark.parametrize("text", ['"of the"', "of the", "tw*", '"of the" two one*'])
def test_a_text_is_tokenised_once(spark, text):
    rows = analysed(spark, text).filter("__f0 > 0")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("Relation") + plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1


def test_statistics_and_hits_are_one_scan(spark):
    docs = spark.range(100).select("id", F.split(F.concat_ws(" ", F.lit("a"), F.when(F.col("id") % 4 == 0, "b")), " ").alias("body"))
    got = lexical.scan(docs, parse_query("a b", False), {"body": 1.0}, ["id"])
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Range" not in plan and got.count() == 25  # what is left of the scan is the stored hits
    assert lexical.scan(docs.filter("id < 0"), parse_query("a", False), {"body": 1.0}, ["id"]).count() == 0
    assert lexical.scan(docs, parse_query("zz", False), {"body": 1.0}, ["id"]).count() == 0


def test_postings_of_a_query(spark):
    docs = spark.createDataFrame([(1, ["aa", "bb", "cc"]), (2, ["bb", "bbx", "aa"])], "id int, body array<string>")
    got = {r.term for r in lexical.postings(docs, "id", {"body": "body"}, parse_query('"aa bb" bbx*', False)).collect()}
    assert got == {"aa", "bb", "bbx"}


def test_postings_and_statistics_in_one_pass(spark):
    from pyspark.sql import Observation

    rows = [(1, ["aa", "bb", "aa"], ["bb"]), (2, None, ["aa"]), (3, [], None), (4, ["cc"], [])]
    docs = spark.createDataFrame(rows, "id int, b array<string>, p array<string>")
    stats = Observation()
    posts = lexical.postings(docs, "id", {"b": "body", "p": "path"}, parse_query("aa c*", False), stats)
    assert "Union" not in posts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, posts.select("id", "col", "term", "positions", "dl").collect())) == [(1, "body", "aa", [0, 2], 4), (2, "path", "aa", [0], 1), (4, "body", "cc", [0], 1)]
    assert stats.get == {"n": 4, "avg": 2.5}
