import math
import struct

import pytest
from pyspark.sql import functions as F

from sievestone.functions import vectors as V
from sievestone.operators import knn


def one(spark, column, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, v)
    return df.select(column.alias("v")).first()[0]


def floats(*x):
    return F.array(*map(F.lit, map(float, x))).cast("array<float>")


def bytes_(*x):
    return F.array(*map(F.lit, x)).cast("array<tinyint>")


def test_distances(spark):
    a, b = floats(1, 0, 0), floats(0, 1, 0)
    assert one(spark, V.distance_cosine(a, b)) == pytest.approx(1)
    assert one(spark, V.distance_l2(a, b)) == pytest.approx(2**0.5)
    assert one(spark, V.distance_l1(a, b)) == pytest.approx(2)
    assert one(spark, V.distance_cosine(floats(0, 0), floats(1, 0))) is None
    assert one(spark, V.distance_hamming(bytes_(-1, 0), bytes_(0, 1))) == 9
    with pytest.raises(Exception, match="dimensions differ"):
        one(spark, V.distance_l2(a, floats(1)))


def test_arithmetic(spark):
    assert one(spark, V.add(floats(1, 2), floats(3, 4))) == [4, 6]
    assert one(spark, V.add_int8(bytes_(127), bytes_(1))) == [-128]
    assert one(spark, V.sub_int8(bytes_(-128), bytes_(1))) == [127]
    assert one(spark, V.slice_(floats(1, 2, 3), 1, 3)) == [2, 3]
    assert one(spark, V.normalize_index(floats(0, 0))) == [0, 0]
    assert one(spark, V.to_json(floats(1, 2.5))) == "[1.000000,2.500000]"
    assert one(spark, V.quantize_int8(floats(-1, 0, 0.5))) == [-128, 0, 63]


def test_bits(spark):
    v = floats(1, -1, 1, -1, -1, -1, -1, -1)
    assert one(spark, V.quantize_binary(v)) == [5]
    assert one(spark, V.to_json_bit(bytes_(5))) == "[1,0,1,0,0,0,0,0]"
    assert one(spark, V.bits(bytes_(5), msb_first=True)) == [0, 0, 0, 0, 0, 1, 0, 1]


def test_blob(spark):
    raw = [0.0, 1.0, -2.5, 1e-40, 3.4e38]
    df = spark.createDataFrame([(bytearray(struct.pack("<5f", *raw)),)], "b binary")
    assert df.select(V.from_blob(F.col("b"))).first()[0] == pytest.approx(list(struct.unpack("<5f", struct.pack("<5f", *raw))))


def test_knn(spark):
    rows = [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0, 0.0]), ("c", [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    assert [r.vec_id for r in knn.knn(df, [1, 0, 0, 0], 3).collect()] == ["a", "b", "c"]
    assert [r.vec_id for r in knn.knn(df, [1, 0, 0, 0], 1, where=F.col("vec_id") != "a").collect()] == ["b"]
    with pytest.raises(ValueError):
        knn.knn(df, [], 3)


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
def test_batch_equals_single(spark, metric):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(100, [0.0] * 5), (7, [1.0] * 5), (8, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0] * 5), (2, [0.5, -1.0, 0.0, 2.0, 1.0])], "query_id bigint, q array<float>")
    got = knn.knn_batch(df, queries, 6, metric).orderBy("query_id", "rank").collect()
    for q in queries.collect():
        want = knn.knn(df, list(q.q), 6, metric).collect()
        mine = [r for r in got if r.query_id == q.query_id]
        assert [r.distance for r in mine] == pytest.approx([r.distance for r in want], abs=1e-6)
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5, 6]
    assert knn.knn_batch(df.limit(0), queries, 6, metric).count() == 0
    blocks = knn.knn_batch(df, queries, 6, metric, block=1).orderBy("query_id", "rank").collect()
    assert blocks == got
    assert knn.knn_batch(df, queries.limit(0), 6, metric).count() == 0
    odd = df.unionByName(spark.createDataFrame([(200, None)], df.schema))
    some = queries.unionByName(spark.createDataFrame([(3, None)], queries.schema))
    assert knn.knn_batch(odd, some, 6, metric).orderBy("query_id", "rank").collect() == got
    assert 200 not in {r.vec_id for r in knn.knn(odd, [1.0] * 5, 99, metric).collect()}
    named = df.withColumn("vec_id", F.concat(F.lit("k"), F.col("vec_id").cast("string")))
    same = knn.knn_batch(named, queries.withColumn("query_id", F.concat(F.lit("q"), "query_id")), 6, metric)
    assert [r.distance for r in same.orderBy("query_id", "rank").collect()] == [r.distance for r in got]


def test_bytes_of_vectors(spark):
    raw = [0.0, -0.0, 1.0, -2.5, 1e-40, -1e-45, 3.4028235e38, 0.1, 2.0**-126, 123456.789, float("inf"), float("-inf")]
    import random

    rng = random.Random(2)
    raw += [rng.gauss(0, 1) * 10 ** rng.randint(-38, 37) for _ in range(300)]
    df = spark.createDataFrame([(raw,)], "v array<float>")
    assert bytes(df.select(V.to_blob(F.col("v"))).first()[0]) == struct.pack(f"<{len(raw)}f", *raw)
    assert math.isnan(spark.sql("select array(float('nan')) as v").select(V.from_blob(V.to_blob(F.col("v")))).first()[0][0])
    df = spark.createDataFrame([("[1,-128,127]", bytearray(b"\x00\xff\x80\x7f")), ("[200]", bytearray())], "s string, b binary")
    assert [r[0] for r in df.select(V.int8_vector(F.col("s"))).collect()] == [[1, -128, 127], None]
    assert [r[0] for r in df.select(V.int8_blob(F.col("b"))).collect()] == [r[0] for r in df.select(V.bit_blob(F.col("b"))).collect()] == [[0, -1, -128, 127], []]


def test_quantize_int8_rounds_each_step_to_floats(spark):
    import duckdb

    raw = [-0.0980391725897789, -0.13725484907627106, 0.2627451419830322, 0.027451012283563614, -1.0, 1.0]
    sql = "select list_transform($1::float[], lambda x: trunc((x + 1::float) / (2.0/255)::float - 128::float))"
    assert one(spark, V.quantize_int8(floats(*raw))) == duckdb.execute(sql, [raw]).fetchone()[0] == [-13, -18, 33, 3, -128, 126]


def test_to_json_rounds_as_c_does(spark):
    raw = [0.0703125, -0.0078125, 0.0234375, 1 / 3, -1e-9, 2.0**53, 1e7 + 1, math.inf, -math.inf]
    assert one(spark, V.to_json(floats(*raw, math.nan))) == "[" + ",".join("%.6f" % x for x in struct.unpack("9f", struct.pack("9f", *raw))) + ",null]"
    assert one(spark, V.to_json(F.array(F.lit(0.1234565), F.lit(0.1234575)))) == "[%.6f,%.6f]" % (0.1234565, 0.1234575)
