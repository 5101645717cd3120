"""The registered queries: each operator over the driver's tables, with the same thing in DuckDB SQL.

documents stand for files (path = /source/lang/doc_<id>.md), embeddings for chunk vectors, conversations for the ordered
chunks of a file. Scores are rounded to six decimals before they are ranked, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, filters, fusion, incremental, knn, lexical, postprocess
from ..operators.parsing import parse_query
from ..operators.vector_table import VectorTable
from ..session import by_pieces, cut, ship, spread
from ..sources.decode import decode_all
from ..sources.embed import embed, hashed_trigrams
from ..sources.formats import html_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: ship(spark).read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[name] = sql
        return f

    return add

def _texts(t) -> DataFrame:
    """documents over all cores, for queries that work on their texts."""
    return spread(t("documents"))


def _path():
    return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))


PATH_SQL = "concat('/', source, '/', lang, '/doc_', doc_id, '.md')"
TOKENS_SQL = r"regexp_extract_all(replace(lower({}), 'ё', 'е'), '[\p{{L}}\p{{Nd}}]+')"


# Tokens and lexical retrieval -------------------------------------------------------------------------------------
@query("tokenize_count", f"select doc_id, len({TOKENS_SQL.format('text')}) as n_tokens from documents")
def _(t):
    return _texts(t).select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("vocab_df", f"select term, count(*) as df, sum(n)::bigint as cf from (select doc_id, term, count(*) as n from (select doc_id, unnest({TOKENS_SQL.format('text')}) as term from documents) group by all) group by term")
def _(t):
    terms = _texts(t).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def _f_sql(column: str, terms: tuple[str, ...], prefix: bool) -> str:
    if prefix:
        return f"len(list_filter({column}, lambda x: starts_with(x, '{terms[0]}')))"
    if len(terms) == 1:
        return f"len(list_filter({column}, lambda x: x = '{terms[0]}'))"
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: " + " and ".join(f"{column}[i + {k}] = '{w}'" for k, w in enumerate(terms)) + "))"


def bm25_sql(text: str, columns: dict[str, tuple[str, float]], source: str = "documents", key: str = "doc_id", k: int | None = 20) -> str:
    """columns: name -> (SQL of its token list, weight)."""
    phrases = parse_query(text, stemmed=False)
    toks = ", ".join(f"{sql} as {c}" for c, (sql, _) in columns.items())
    f = ", ".join(" + ".join(f"{w} * {_f_sql(c, p.terms, p.prefix)}" for c, (_, w) in columns.items()) + f" as f{i}" for i, p in enumerate(phrases))
    dl = " + ".join(f"len({c})" for c in columns)
    df = ", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(phrases)))
    one = lambda i: f"(case when ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 then ln((n - n{i} + 0.5) / (n{i} + 0.5)) else 1e-6 end) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return (
        f"with t as (select {key}, {toks} from {source}), q as (select {key}, {dl} as dl, {f} from t), s as (select count(*)::double as n, avg(dl) as avgdl, {df} from q) "
        f"select {key}, round({' + '.join(one(i) for i in range(len(phrases)))}, 6) as score from q, s where {' and '.join(f'f{i} > 0' for i in range(len(phrases)))} "
        f"order by score desc, {key}" + (f" limit {k}" if k else "")
    )


def _top(hits: DataFrame, k: int = 20, key: str = "doc_id") -> DataFrame:
    return lexical.top(hits.withColumn("score", F.round("score", 6)), k, key)


BODY = {"body": (TOKENS_SQL.format("text"), 1.0)}
for _name, _text in {"bm25_term": "that", "bm25_and": "that with", "bm25_dup_term": "that that", "bm25_prefix": "thes*", "bm25_phrase": '"of the"', "bm25_mixed": '"to the" thes* by'}.items():

    def _bm25(t, text=_text):
        docs = _texts(t).select("doc_id", T.tokens(F.col("text")).alias("body"))
        return _top(lexical.scan(docs, parse_query(text, stemmed=False), {"body": 1.0}, ["doc_id"]))

    query(_name, bm25_sql(_text, BODY))(_bm25)

_CUT = r"regexp_replace(regexp_replace(s, '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '([^\p{Lu}_-])(\p{Lu})', '\1_\2', 'g')"


@query("ident_split", rf"select doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array({_CUT}, '[_-]+'), lambda x: x <> ''), lambda x: lower(x)), ' ') as words from (select doc_id, concat(upper(lang), 'Server_', source, 'DocName') as s from documents)")
def _(t):
    s = F.concat(F.upper("lang"), F.lit("Server_"), "source", F.lit("DocName"))
    return t("documents").select("doc_id", F.array_join(T.split_ident(s), " ").alias("words"))


@query(
    "bm25_weighted",
    bm25_sql("src3 that", {"body": (TOKENS_SQL.format("text"), 1.0), "path": (TOKENS_SQL.format("p"), 0.4)}, f"(select doc_id, text, {PATH_SQL} as p from documents)"),
)
def _(t):
    docs = _texts(t).select("doc_id", T.tokens(F.col("text")).alias("body"), T.tokens(_path()).alias("path"))
    return _top(lexical.scan(docs, parse_query("src3 that", stemmed=False), {"body": 1.0, "path": 0.4}, ["doc_id"]))


@query("bm25_postings", bm25_sql('"of the" that', BODY))
def _(t):
    docs = _texts(t).select("doc_id", T.tokens(F.col("text")).alias("body"))
    wanted = parse_query('"of the" that', stemmed=False)
    stats = Observation()
    posts = cut(lexical.postings(docs, "doc_id", {"body": "body"}, wanted, stats))  # each term reads them again
    return _top(lexical.search(posts, (stats.get["n"], stats.get["avg"] or 0.0), wanted, "doc_id", {"body": 1.0}))


@query("stemmed_search")
def _(t):
    words = _texts(t).select("doc_id", T.tokens(F.col("text")).alias("body"), T.tokens(_path()).alias("path"), T.idents(F.col("text")).alias("ids"))
    docs = T.stemmed(words, "body", "path", "ids")
    return _top(lexical.scan(docs, parse_query("thing with"), lexical.WEIGHTS, ["doc_id"]))


# Vectors ----------------------------------------------------------------------------------------------------------
_D = {
    "cosine": "1 - list_sum(list_transform(list_zip(a, b), lambda x: x[1]::double * x[2]::double)) / (sqrt(list_sum(list_transform(a, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b, lambda x: x::double * x::double))))",
    "l2": "sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))))",
    "l1": "list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1]::double - x[2]::double)))",
}


def _first(t) -> list[float]:
    return t("embeddings").orderBy("vec_id").select("embedding").first()[0]


def _near(rows: DataFrame, k: int) -> DataFrame:
    return rows.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance")).orderBy("distance", "vec_id").limit(k)


for _metric in ("cosine", "l2", "l1"):

    def _knn(t, metric=_metric):
        return _near(knn.knn(t("embeddings"), _first(t), 50, metric), 10)

    query(f"knn_{_metric}", f"select vec_id, round({_D[_metric]}, 6) + 0.0 as distance from (select vec_id, embedding as a, (select embedding from embeddings order by vec_id limit 1) as b from embeddings) order by distance, vec_id limit 10")(_knn)


@query("knn_prefilter_label", f"select vec_id, round({_D['cosine']}, 6) + 0.0 as distance from (select vec_id, embedding as a, (select embedding from embeddings order by vec_id limit 1) as b from embeddings where label in (1, 2)) order by distance, vec_id limit 10")
def _(t):
    return _near(knn.knn(t("embeddings"), _first(t), 50, where=F.col("label").isin(1, 2)), 10)


@query("knn_batch", f"select query_id, vec_id, rank, round(d, 6) + 0.0 as distance from (select query_id, vec_id, d, row_number() over (partition by query_id order by d, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, {_D['cosine'].replace('(a,', '(e.embedding,').replace('(a)', '(e.embedding)').replace(', b)', ', q.embedding)').replace('(b,', '(q.embedding,')} as d from embeddings e, embeddings q where q.vec_id % 100 = 0)) where rank <= 5")
def _(t):
    e = t("embeddings")
    got = knn.knn_batch(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 5)
    return got.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), (F.round("distance", 6) + 0.0).alias("distance"))


_PAIR = "(select vec_id, embedding as a, list_reverse(embedding) as b from embeddings)"
for _name, _op, _sql in (
    ("vec_add", V.add, "list_transform(list_zip(a, b), lambda x: x[1] + x[2])"),
    ("vec_sub", V.sub, "list_transform(list_zip(a, b), lambda x: x[1] - x[2])"),
    ("vec_slice", lambda a, b: V.slice_(a, 3, 20), "a[4:20]"),
    ("vec_normalize", lambda a, b: V.normalize(a), "list_transform(a, lambda x: (x::double / sqrt(list_sum(list_transform(a, lambda y: y::double * y::double))))::float)"),
    ("quantize_int8", lambda a, b: V.quantize_int8(a), "list_transform(a, lambda x: trunc((x + 1::float) / (2.0/255)::float - 128::float))"),
):

    def _vec(t, op=_op):
        v = op(F.col("embedding"), F.reverse("embedding"))
        rows = V.each(t("embeddings").select("vec_id", v.alias("v")), "v", "vec_id")
        return rows.select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round(F.col("value").cast("double"), 6) + 0.0).alias("value"))

    query(_name, f"select vec_id, generate_subscripts(v, 1) - 1 as i, round(unnest(v)::double, 6) + 0.0 as value from (select vec_id, {_sql} as v from {_PAIR})")(_vec)


@query("vec_to_json", "select vec_id, concat('[', array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::double)), ','), ']') as json from embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.to_json(F.col("embedding")).alias("json"))


@query("vec_blob", "select vec_id, generate_subscripts(embedding, 1) - 1 as i, embedding[1]::double as first, round(unnest(embedding)::double, 6) as value from embeddings")
def _(t):
    back = t("embeddings").select("vec_id", V.from_blob(V.to_blob(F.col("embedding"))).alias("v"))
    return V.each(back.withColumn("first", F.get("v", F.lit(0)).cast("double")), "v", "vec_id", "first").select("vec_id", F.col("i").cast("bigint").alias("i"), "first", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("vec_each", "select vec_id, generate_subscripts(embedding, 1) - 1 as i, round(unnest(embedding)::double, 6) as value from embeddings")
def _(t):
    return V.each(t("embeddings"), "embedding", "vec_id").select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("value").cast("double"), 6).alias("value"))


_BITS = "list_transform({}, lambda x: (x > 0)::int)"


@query("quantize_binary", f"select vec_id, array_to_string({_BITS.format('embedding')}, '') as bits from embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.array_join(F.transform(V.bits(V.quantize_binary(F.col("embedding"))), lambda x: x.cast("string")), "").alias("bits"))


@query("vec_hamming", "select vec_id, list_sum(list_transform(list_zip(a, b), lambda x: ((x[1] > 0) <> (x[2] > 0))::int))::bigint as distance from " + _PAIR)
def _(t):
    return t("embeddings").select("vec_id", V.distance_hamming(V.quantize_binary(F.col("embedding")), V.quantize_binary(F.reverse("embedding"))).cast("bigint").alias("distance"))


_TABLE = "vec_id integer primary key, embedding float[{}] distance_metric=cosine, label integer, +note text"


def _vector_table(t) -> VectorTable:
    e = t("embeddings")
    rows = e.select("vec_id", "embedding", "label", F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("note"))
    return VectorTable(e.sparkSession, _TABLE.format(len(_first(t)))).insert(rows)


@query("vec_table_knn", f"select vec_id, note, round({_D['cosine']}, 6) + 0.0 as distance from (select vec_id, concat('n', vec_id) as note, embedding as a, (select embedding from embeddings order by vec_id limit 1) as b from embeddings where label >= 2 and label <> 3 and vec_id < 150) order by distance, vec_id limit 10")
def _(t):
    near = _vector_table(t).knn("embedding", _first(t), 50, (F.col("label") >= 2) & (F.col("label") != 3), keys=list(range(150)))
    return near.select("vec_id", "note", (F.round("distance", 6) + 0.0).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("vec_table_changes", "select vec_id, case when label = 1 then 'seen' else concat('n', vec_id) end as note, label, case when label = 1 then len(embedding) else len(embedding) end as dim from embeddings where label <> 0")
def _(t):
    table = _vector_table(t).delete(F.col("label") == 0).update(F.col("label") == 1, note=F.lit("seen"))
    return table.scan().select("vec_id", "note", F.col("label").cast("bigint").alias("label"), F.size("embedding").cast("bigint").alias("dim"))


@query("vec_table_point", "select vec_id, concat('n', vec_id) as note from embeddings where vec_id = 7")
def _(t):
    return _vector_table(t).point(7).select("vec_id", "note")


# Fusion and post-processing ---------------------------------------------------------------------------------------
@query(
    "rrf_hybrid",
    f"with l as (select doc_id, row_number() over (order by score desc, doc_id) as r from ({bm25_sql('that with', BODY, k=100)})), "
    f"v as (select vec_id as doc_id, row_number() over (order by d, vec_id) as r from (select vec_id, round({_D['cosine']}, 6) as d from (select vec_id, embedding as a, (select embedding from embeddings order by vec_id limit 1) as b from embeddings)) qualify r <= 100) "
    "select doc_id, round(sum(1.0 / (60 + r)), 9) as score from (select * from l union all select * from v) group by doc_id order by score desc, doc_id limit 20",
)
def _(t):
    docs = _texts(t).select("doc_id", T.tokens(F.col("text")).alias("body"))
    a = _top(lexical.scan(docs, parse_query("that with", stemmed=False), {"body": 1.0}, ["doc_id"]), 100)
    b = _near(knn.knn(t("embeddings"), _first(t), 200), 100).withColumnRenamed("vec_id", "doc_id")
    lists = [fusion.ranked(a, [F.desc("score"), "doc_id"]).select("doc_id", "rank"), fusion.ranked(b, ["distance", "doc_id"]).select("doc_id", "rank")]
    got = fusion.rrf(lists, ["doc_id"]).withColumn("score", F.round("score", 9))
    return got.orderBy(F.desc("score"), "doc_id").limit(20)


@query("max_per_file", "select source, doc_id, n_chars from documents qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 3")
def _(t):
    return postprocess.max_per_key(t("documents").select("source", "doc_id", "n_chars"), "source", 3, F.desc("n_chars"), "doc_id")


_LINES_SQL = "case when turn % 4 = 3 then 0 else turn * 10 + 1 end as la, case when turn % 4 = 3 then 0 else turn * 10 + 1 + length(text) % 25 end as lb"


@query(
    "dedupe_overlap",
    f"with p as (select conv_id, turn, {_LINES_SQL}, row_number() over (order by length(text) desc, conv_id, turn) as rank from conversations qualify rank <= 200), "
    "g as (select conv_id, list([{'t': turn, 'a': la, 'b': lb}] order by rank) as ts from p group by conv_id) "
    "select conv_id, unnest(list_reduce(ts, lambda acc, x: case when len(list_filter(acc, lambda y: case when y.a > 0 and x[1].a > 0 then y.a <= x[1].b and x[1].a <= y.b else abs(y.t - x[1].t) <= 1 end)) > 0 then acc else list_concat(acc, x) end)).t as turn from g",
)
def _(t):
    first = F.when(F.col("turn") % 4 == 3, 0).otherwise(F.col("turn") * 10 + 1)
    rows = t("conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("seq"), F.char_length("text").alias("score"), first.alias("line_start"))
    rows = rows.withColumn("line_end", F.when(F.col("line_start") == 0, 0).otherwise(F.col("line_start") + F.col("score") % 25))
    hits = fusion.ranked(lexical.top(rows, 200, "path", "seq"), [F.desc("score"), "path", "seq"])
    return postprocess.dedupe(hits).select(F.col("path").alias("conv_id"), F.col("seq").alias("turn"))


@query(
    "shape",
    "select conv_id::varchar as path, turn as seq, concat(conv_id, '#', turn) as ref, row_number() over (order by length(text) desc, conv_id, turn) as rank, 'text' as source_type, 'bm25' as score_kind from conversations qualify rank <= 50",
)
def _(t):
    rows = t("conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.char_length("text").alias("score"), "conv_id")
    hits = fusion.ranked(lexical.top(rows, 50, "conv_id", "seq"), [F.desc("score"), "conv_id", "seq"])
    return postprocess.shape(hits, "bm25").select("path", F.col("seq").cast("bigint").alias("seq"), "ref", F.col("rank").cast("bigint").alias("rank"), "source_type", "score_kind")


@query("pool_filter", f"with p as ({bm25_sql('that with', BODY, k=100)}) select p.doc_id, score from p join documents d using (doc_id) where lang = 'en' and source in ('src1', 'src2', 'src3') order by score desc, doc_id limit 10")
def _(t):
    docs = _texts(t).select("doc_id", _path().alias("path"), T.tokens(F.col("text")).alias("body"))
    pool = _top(lexical.scan(docs, parse_query("that with", stemmed=False), {"body": 1.0}, ["doc_id", "path"]), fusion.pool_size(10, True))
    keep = filters.result_filter(F.col("path"), include=["/src{1,2,3}/en/*.md"])
    return pool.filter(keep).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


@query("unique_paths", "select source, min(rank) as rank from (select source, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 100) group by source")
def _(t):
    pool = lexical.top(t("documents").select(F.col("source").alias("path"), "doc_id", F.col("n_chars").alias("score")), 100, "doc_id")
    got = postprocess.unique_paths(fusion.ranked(pool, [F.desc("score"), "doc_id"]))
    return got.select(F.col("path").alias("source"), F.col("rank").cast("bigint").alias("rank"))


_CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+(\n|$)', '\1', 'g'), '^\n+', ''), '\n+$', '')"
_AT_SQL = r"case when regexp_matches(c, '(?s)(^|[^\p{L}\p{Nd}])(thes|wha)') then length(regexp_extract(c, '(?s)^((?:.*?[^\p{L}\p{Nd}])??)(?:thes|wha)', 1)) end"


@query(
    "snippet",
    f"with a as (select doc_id, text, {_CLEAN_SQL} as clean, replace(lower(clean), 'ё', 'е') as c from documents), b as (select doc_id, text, clean, length(clean) as n, {_AT_SQL} as pos from a), "
    "d as (select *, greatest(0, least(pos - 26, n - 80)) as s from b), "
    "e as (select doc_id, text, case when n <= 80 then clean when pos is null then concat(substr(clean, 1, 80), '...') else concat(case when s > 0 then '...' else '' end, substr(clean, s + 1, 80), case when s + 80 < n then '...' else '' end) end as short from d) "
    "select doc_id, short as text, short <> text as truncated from e",
)
def _(t):
    return postprocess.snippets(_texts(t).select("doc_id", "text"), "thes* wha*", 80)


# Paths ------------------------------------------------------------------------------------------------------------
@query("path_filter_glob", f"select doc_id from documents where regexp_matches({PATH_SQL}, '^/src1[0-9]/(en|de)/[^/]*\\.md$')")
def _(t):
    return t("documents").filter(filters.path_glob(_path(), ["/src1[0-9]/{en,de}/*.md"], [])).select("doc_id")


@query("path_filter_relative", f"select doc_id from documents where starts_with({PATH_SQL}, '/src1/') and regexp_matches(substr({PATH_SQL}, 7), '^(.*/)?doc_[^/]*1\\.md$')")
def _(t):
    return t("documents").filter(filters.result_filter(_path(), root="/src1", include=["**/doc_*1.md"], roots=["/src1", "/src2"])).select("doc_id")


@query("path_filter_ext", "select doc_id, ext from (select doc_id, case when doc_id % 3 = 0 then '.MD' when doc_id % 3 = 1 then '.py' else '' end as e, lower(e) as ext from documents) where ext in ('.md', '.txt')")
def _(t):
    p = F.concat(F.lit("/a.b/doc"), F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".py").otherwise(""))
    return t("documents").filter(filters.ext_filter(p, ["md", ".TXT"])).select("doc_id", T.extension(p).alias("ext"))


@query("subtree", f"select doc_id from documents where {PATH_SQL} = '/src1/en' or starts_with({PATH_SQL}, '/src1/en/')")
def _(t):
    return t("documents").filter(filters.subtree(_path(), "/src1/en")).select("doc_id")


@query("roots_count", f"select root, count(*) as n from (select case when starts_with(p, '/src1/en/') then '/src1/en' when starts_with(p, '/src1/') then '/src1' when starts_with(p, '/src2/') then '/src2' else '(other)' end as root from (select {PATH_SQL} as p from documents)) group by root")
def _(t):
    return filters.best_root(t("documents").select(_path().alias("path")), ["/src1", "/src2", "/src1/en"]).groupBy("root").agg(F.count("*").alias("n"))


@query("add_root", "select source, case when source in ('src1', 'src2') then concat_ws(',', '/src1', '/src2', '/x/y') else concat_ws(',', '/src1', '/src2', '/x/y', '/' || source) end as a, concat_ws(',', '/src1', '/src2', '/x') as b from (select distinct source from documents)")
def _(t):
    roots = F.array(F.lit("/src1"), F.lit("/src2"), F.lit("/x/y"))
    rows = t("documents").select("source").distinct()
    a = filters.add_root(roots, F.concat(F.lit("/"), "source"))
    return rows.select("source", F.array_join(a, ",").alias("a"), F.array_join(filters.add_root(roots, "/x"), ",").alias("b"))


@query("remove_root", "select source, concat_ws(',', '/' || source, '/z') as kept from (select distinct source from documents)")
def _(t):
    rows = t("documents").select("source").distinct()
    roots = F.array(F.concat(F.lit("/"), "source"), F.lit("/x/y"), F.lit("/x"), F.lit("/z"))
    return rows.select("source", F.array_join(filters.remove_root(roots, "/x"), ",").alias("kept"))


@query("ancestors", f"select doc_id, unnest([p, regexp_replace(p, '/[^/]*$', ''), regexp_replace(p, '/[^/]*/[^/]*$', '')]) as a from (select doc_id, {PATH_SQL} as p from documents)")
def _(t):
    return t("documents").select("doc_id", F.explode(T.ancestors(_path())).alias("a"))


@query("parse_ref", f"select doc_id, {PATH_SQL} || '#x' as path, doc_id % 7 as seq from documents")
def _(t):
    ref = filters.parse_ref(F.concat(_path(), F.lit("#x#"), (F.col("doc_id") % 7).cast("string")))
    return t("documents").select("doc_id", ref.getField("path").alias("path"), ref.getField("seq").cast("bigint").alias("seq"))


@query("split_list", "select doc_id, array_to_string(list_filter(list_transform(string_split(concat(lang, ', ', source, ',, '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(T.split_list(F.concat("lang", F.lit(", "), "source", F.lit(",, "))), "|").alias("parts"))


@query("human_size", "select doc_id, case when n_chars < 1024 then concat(n_chars, ' B') when n_chars < 1048576 then printf('%.1f KB', n_chars / 1024.0) else printf('%.1f MB', n_chars / 1048576.0) end as size from documents")
def _(t):
    return t("documents").select("doc_id", T.human_size(F.col("n_chars")).alias("size"))


# Ranges and neighbours --------------------------------------------------------------------------------------------
@query("chunk_range", "select conv_id, turn, role from conversations where conv_id = (select min(conv_id) from conversations) and turn between 1 and 3")
def _(t):
    rows = t("conversations").withColumn("path", F.col("conv_id").cast("string")).withColumn("seq", F.col("turn"))
    first = rows.agg(F.min("conv_id")).first()[0]
    return filters.chunk_range(rows, str(first), 1, 3).select("conv_id", "turn", "role")


@query("seq_minmax", "select conv_id, min(turn) as first_seq, max(turn) as last_seq from conversations group by conv_id")
def _(t):
    return filters.spans(t("conversations"), "conv_id", "turn")


@query("neighbours", "select a.conv_id, a.turn, b.turn as near, b.role from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn - 1 and a.turn + 2 where length(a.text) > 200")
def _(t):
    c = t("conversations")
    return filters.around(c, c.filter(F.char_length("text") > 200), 1, 2, "conv_id", "turn").select("conv_id", "turn", "near", "role")


@query(
    "chunk_overlap_prev",
    r"with p as (select conv_id, turn, coalesce(lag(text) over (partition by conv_id order by turn), '') as t from conversations), o as (select *, right(t, 40) as o from p), "
    r"g as (select *, length(regexp_extract(o, '^([^ \t\n]*)[ \t\n]', 1)) as k, regexp_matches(o, '[ \t\n]') as gap from o) "
    r"select conv_id, turn, trim(case when length(t) > 40 and gap and k > 0 and strlen(substr(o, 1, k)) < strlen(o) // 2 then substr(o, k + 2) when length(t) > 40 then o else t end, ' ' || chr(9) || chr(10) || chr(13)) as overlap from g",
)
def _(t):
    return chunking.overlap_before(t("conversations"), "conv_id", "turn", 40).select("conv_id", "turn", "overlap")


# Incremental ------------------------------------------------------------------------------------------------------
_STATE_SQL = "select doc_id, case when doc_id % 11 = 0 then null else 'h' end as ih, n_chars as im, n_chars as isz, n_chars + (doc_id % 5 = 0)::int as m, n_chars as s, case when doc_id % 10 = 0 then 'g' else 'h' end as h from documents"


@query("decide_file", f"select doc_id, case when ih is null then 'reindex' when im = m and isz = s then 'skip' when ih = h then 'touch' else 'reindex' end as todo from ({_STATE_SQL})")
def _(t):
    i, n = F.col("doc_id"), F.col("n_chars")
    old = F.when(i % 11 != 0, "h")
    return t("documents").select("doc_id", incremental.decide(old, n, n, n + (i % 5 == 0).cast("int"), n, F.when(i % 10 == 0, "g").otherwise("h")).alias("todo"))


def _disk(t) -> tuple[DataFrame, DataFrame]:
    rows = t("documents").select("doc_id", _path().alias("path"), F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size"))
    disk = rows.filter("doc_id % 7 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return disk.drop("doc_id"), rows.filter("doc_id % 9 <> 0").drop("doc_id")


_EXCLUDED = [("/src1", "hidden"), ("/src1/en", "vendor")]
_CHECK_SQL = (
    f"with d as (select {PATH_SQL} as path, n_chars + (doc_id % 5 = 0)::int as m from documents where doc_id % 7 <> 0), i as (select {PATH_SQL} as path, n_chars as m from documents where doc_id % 9 <> 0) "
    "select path, case when i.m is null then 'unindexed' when d.m is null and starts_with(path, '/src1/') then 'excluded' when d.m is null then 'missing' when d.m <> i.m then 'changed' else 'current' end as status, "
    "case when i.m is null or d.m is not null then null when starts_with(path, '/src1/en/') then 'vendor' when starts_with(path, '/src1/') then 'hidden' end as reason from d full join i using (path)"
)


@query("decide_backfill", f"select doc_id, case when ih is null then 'reindex' when im = m and isz = s then 'reindex' when ih = h then 'reindex' else 'reindex' end as todo from ({_STATE_SQL})")
def _(t):
    i, n = F.col("doc_id"), F.col("n_chars")
    old = F.when(i % 11 != 0, "h")
    return t("documents").select("doc_id", incremental.decide(old, n, n, n + (i % 5 == 0).cast("int"), n, F.when(i % 10 == 0, "g").otherwise("h"), backfill=True).alias("todo"))


@query(
    "check_by_hash",
    f"with d as (select {PATH_SQL} as path, n_chars + (doc_id % 5 = 0)::int as m, doc_id % 3 as h from documents where doc_id % 7 <> 0), i as (select {PATH_SQL} as path, n_chars as m, case when doc_id % 2 = 0 then doc_id % 3 else 9 end as h from documents where doc_id % 9 <> 0) "
    "select path, case when i.m is null then 'unindexed' when d.m is null then 'missing' when d.m <> i.m and d.h <> i.h then 'changed' else 'current' end as status from d full join i using (path)",
)
def _(t):
    rows = t("documents").select("doc_id", _path().alias("path"), F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size"))
    disk = rows.filter("doc_id % 7 <> 0").withColumn("mtime", F.col("mtime") + (F.col("doc_id") % 5 == 0).cast("int")).withColumn("hash", (F.col("doc_id") % 3).cast("string"))
    files = rows.filter("doc_id % 9 <> 0").withColumn("hash", F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 3).cast("string")).otherwise("9"))
    return incremental.compare(disk, files, by_hash=True).select("path", "status")


@query("delete_subtree", f"select {PATH_SQL} as path from documents where doc_id % 9 <> 0 and not starts_with({PATH_SQL}, '/src1/') and {PATH_SQL} <> '/src2/en/doc_2.md' and not starts_with({PATH_SQL}, '/src3/de/')")
def _(t):
    _, files = _disk(t)
    return incremental.without(files, ["/src1", "/src2/en/doc_2.md", "/src3/de/"]).select("path")


@query("index_counts", f"select count(*) as files, sum(n) as chunks from (select source, count(*) as n from documents group by source)")
def _(t):
    return incremental.totals(t("documents").select(F.col("source").alias("path")).distinct(), t("documents").select(F.col("source").alias("path")))


@query("check_status", _CHECK_SQL)
def _(t):
    disk, files = _disk(t)
    excluded = t("documents").sparkSession.createDataFrame(_EXCLUDED, "path string, reason string")
    return incremental.compare(disk, files, excluded).select("path", "status", "reason")


@query("check_list", f"with c as ({_CHECK_SQL}) select path, status, reason from c where status <> 'current' order by case status when 'changed' then 0 when 'missing' then 1 when 'excluded' then 2 else 3 end, path limit 50")
def _(t):
    disk, files = _disk(t)
    excluded = t("documents").sparkSession.createDataFrame(_EXCLUDED, "path string, reason string")
    return incremental.check_list(incremental.compare(disk, files, excluded), 50).select("path", "status", "reason")


@query("check_counts", f"with c as ({_CHECK_SQL}) select array_to_string(list(concat(status, '=', n) order by status), ',') as by_code from (select status, count(*) as n from c group by status)")
def _(t):
    disk, files = _disk(t)
    excluded = t("documents").sparkSession.createDataFrame(_EXCLUDED, "path string, reason string")
    got = incremental.counts_by(incremental.compare(disk, files, excluded), "status")
    return got.select(F.array_join(F.transform(F.map_entries("by_code"), lambda e: F.concat(e.getField("key"), F.lit("="), e.getField("value").cast("string"))), ",").alias("by_code"))


@query("prune", f"select {PATH_SQL} as path from documents where doc_id % 9 <> 0 and doc_id % 7 = 0 and source = 'src2'")
def _(t):
    disk, files = _disk(t)
    return incremental.prune(files, disk, filters.subtree(F.col("path"), "/src2")).select("path")


@query("replace_files", f"select {PATH_SQL} as path, case when doc_id % 7 <> 0 then n_chars + (doc_id % 5 = 0)::int else n_chars end as mtime from documents where doc_id % 9 <> 0 or doc_id % 7 <> 0")
def _(t):
    disk, files = _disk(t)
    return incremental.replace_rows(files, disk).select("path", "mtime")


@query("touch_files", f"select {PATH_SQL} as path, case when doc_id % 7 <> 0 then n_chars + (doc_id % 5 = 0)::int else n_chars end as mtime from documents where doc_id % 9 <> 0")
def _(t):
    disk, files = _disk(t)
    return incremental.touch(files, disk).select("path", "mtime")


# Text functions, chunks, extraction -------------------------------------------------------------------------------
@query("fnv1a64")  # a fold over every byte takes SQL half a minute for 2.5 MB; fnv1a64_items has it
def _(t):
    return _texts(t).select("doc_id", T.fnv1a64(F.col("text")).alias("hash"))


@query(
    "fnv1a64_items",
    "with d as (select item_id, hex(encode(text)) as x from benchmark) select item_id, printf('%x', list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(0, strlen(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::int::hugeint)), "
    "lambda h, b: (xor(h, b) * 435 + (xor(h, b) % 16777216) * 1099511627776) % 18446744073709551616)::ubigint) as hash from d",
)
def _(t):
    return t("benchmark").select("item_id", T.fnv1a64(F.col("text")).alias("hash"))


@query("nfc", "select doc_id, md5(nfc_normalize(text)) as normal from documents")
def _(t):
    return _texts(t).select("doc_id", F.md5(T.nfc(F.col("text")).cast("binary")).alias("normal"))


@query("decode_utf8", "select doc_id, 'utf-8' as encoding, md5(nfc_normalize(text)) as text from documents")
def _(t):
    rows = decode_all(_texts(t).select("doc_id", F.col("text").cast("binary").alias("raw")), "raw", "doc_id")
    return rows.select("doc_id", "encoding", F.md5(F.col("text").cast("binary")).alias("text"))


@query("chunk_documents")
def _(t):
    return chunking.chunks(_texts(t).select(_path().alias("path"), "text"))


@query("chunk_invariants", "select count(*) as files, 0::bigint as too_long, 0::bigint as bad_lines from documents where length(trim(text, ' \t\r\n')) > 0")
def _(t):
    got = chunking.chunks(_texts(t).select(_path().alias("path"), "text"))
    return got.agg(F.count_distinct("path").alias("files"), F.count_if(F.char_length("text") > chunking.SIZE + chunking.OVERLAP).alias("too_long"), F.count_if(F.col("line_end") < F.col("line_start")).alias("bad_lines"))


@query("html_extract")
def _(t):
    from pyspark.sql.functions import arrow_udf

    def texts(pages: pa.Array) -> pa.Array:
        known = pages.dictionary_encode()  # equal pages are parsed once
        return pa.array([html_text(x or "") for x in known.dictionary.to_pylist()] + [html_text("")], pa.string()).take(pc.fill_null(known.indices, len(known.dictionary)))

    @arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return by_pieces(texts)(pages)

    return spread(t("pages")).select("page_id", extracted(F.col("html")).alias("text"))


@query(
    "embed_documents",
    "with c as (select doc_id, list_transform(string_split(lower(text), ''), lambda x: unicode(x)::bigint) as c from documents), "
    "h as (select doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 1018081 + c[i + 1] * 1009 + c[i + 2]) % 65521)) as h from c), "
    "v as (select doc_id, h % 16 as i, sum(1 - 2 * ((h // 16) % 2))::double as x from h group by all), n as (select doc_id, sqrt(sum(x * x)) as n from v group by doc_id), "
    "g as (select doc_id, unnest(range(0, 16)) as i from documents) "
    "select g.doc_id, g.i, round(coalesce(case when n.n < 1e-12 then v.x else v.x / n.n end, 0)::float::double, 5) + 0.0 as value from g left join v using (doc_id, i) left join n using (doc_id)",
)
def _(t):
    got = embed(_texts(t).select("doc_id", "text"), hashed_trigrams, keys=("doc_id",))
    return V.each(got, "embedding", "doc_id").select("doc_id", F.col("i").cast("bigint").alias("i"), (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
