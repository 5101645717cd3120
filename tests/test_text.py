import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.functions.stemming import english, russian, stem
from sievestone.operators.parsing import parse_query, to_match


def test_fold_and_tokens(spark):
    df = spark.createDataFrame([("Мёд",), ("ÇA VA",), ("сад—огород; 7 яблок №3/Б x_y",)], "s string")
    got = df.select(T.fold(F.col("s")), T.tokens(F.col("s"))).collect()
    assert [r[0] for r in got][:2] == ["мед", "ça va"]
    assert got[2][1] == ["сад", "огород", "7", "яблок", "3", "б", "x", "y"]


@pytest.mark.parametrize("same", [("деревьями", "деревьям"), ("красивая", "красивую"), ("painting", "painted", "paints"), ("libraries", "library")])
def test_equal_stems(same):
    assert len({stem(w) for w in same}) == 1


@pytest.mark.parametrize("word,want", [("dogs", "dog"), ("caresses", "caress"), ("plastered", "plaster"), ("motoring", "motor"), ("sized", "size"), ("tanned", "tan"), ("falling", "fall"), ("happy", "happi"), ("by", "by"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("formalize", "formal"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("dying", "die"), ("gently", "gentl"), ("cosmos", "cosmos"), ("proceed", "proceed")])
def test_english(word, want):
    assert english(word) == want


@pytest.mark.parametrize("word,want", [("книгами", "книг"), ("столом", "стол"), ("синего", "син"), ("читавшие", "чита"), ("бежит", "беж"), ("окно", "окн"), ("милосердие", "милосерд")])
def test_russian(word, want):
    assert russian(word) == want


@pytest.mark.parametrize("word,want", [("OpenDoor", "open door opendoor"), ("open_door", "open door opendoor"), ("open-door", "open door opendoor"), ("XMLParser", "xml parser xmlparser"), ("base64Text", "base64 text base64text"), ("слово", ""), ("plain words only", ""), ("RowBatch of row_group", "row batch rowbatch row group rowgroup")])
def test_idents(spark, word, want):
    assert T.py_idents(word) == want
    got = spark.createDataFrame([(word,)], "s string").select(F.array_join(T.stems(T.idents(F.col("s"))), " ")).first()[0]
    assert got == want


def test_idents_are_found_by_the_cheap_test(spark):
    import random

    rng = random.Random(3)
    rows = [("".join(rng.choices("aBcDß_-9Щж ", k=rng.randint(1, 14))),) for _ in range(500)]
    got = spark.createDataFrame(rows, "s string").select("s", F.array_join(T.stems(T.idents(F.col("s"))), " ").alias("i")).collect()
    assert all(r.i == T.py_idents(r.s) for r in got)


@pytest.mark.parametrize("q,want", [("зимние сады", '"зимн" "сад"'), ('"зимние сады"', '"зимн сад"'), ("зим*", '"зим"*'), ("[садами]", '"сад"'), ("?;.", ""), ('зима "садом', '"зим" "сад"'), ("xy*zw", '"xy"* "zw"'), ("p * q", '"p" "q"')])
def test_query(q, want):
    assert to_match(parse_query(q)) == want


@pytest.mark.parametrize("word,want", [("café", "cafe"), ("ñandú", "nandu"), ("łódź", "łodz"), ("ß", "ß"), ("й", "й"), ("ἄ", "ἄ")])
def test_diacritics(word, want):
    assert T.strip_latin(word) == want


def test_hash_and_sizes(spark):
    assert T.fnv1a64_text(b"") == "cbf29ce484222325" and T.fnv1a64_text(b"a") == "af63dc4c8601ec8c"
    df = spark.createDataFrame([(1000,), (2560,), (3 << 20,), (7 << 30,)], "n bigint")
    assert [r[0] for r in df.select(T.human_size(F.col("n"))).collect()] == ["1000 B", "2.5 KB", "3.0 MB", "7.0 GB"]


def test_hashes_of_batches(spark):
    import random

    rng = random.Random(5)
    texts = [None, "", "é", "x" * 5000, "y" * 4999] + ["".join(rng.choices("abcé漢 ", k=rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").repartition(3)
    got = {r.i: (r.h, r.n) for r in df.select("i", T.fnv1a64(F.col("s")).alias("h"), T.nfc(F.concat("s", F.lit("e\u0301"))).alias("n")).collect()}
    assert got == {i: (None, None) if t is None else (T.fnv1a64_text(t.encode()), unicodedata.normalize("NFC", t + "e\u0301")) for i, t in enumerate(texts)}
    assert T.fnv1a64_all(pa.array(texts).slice(3, 4)) == [T.fnv1a64_text(t.encode()) for t in texts[3:7]] and T.fnv1a64_all(pa.array([], pa.string())) == []


def test_a_large_batch_is_stemmed_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    lists = [["running", "thés", None, "работали"] * n for n in (1, 30, 0, 100_000)] * 20 + [None]
    df = spark.createDataFrame([(1, ["running", None, "thés"], None), (2, None, []), (3, [], ["cats"])], "id long, a array<string>, b array<string>")
    want = df.select("id", T.stems("a").alias("a"), T.stems("b").alias("b")).collect()
    assert sorted(T.stemmed(df, "a", "b").collect()) == sorted(want) and want[0].a == ["run", None, "thes"]
    monkeypatch.setattr(T, "map_arrow", lambda rows, fn, schema: fn)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists)], ["id", "a"])
    out = list(T.stemmed(df.select("id", "a"), "a")(iter([batch])))
    got = [r["a"] for b in out for r in b.to_pylist()]
    assert [r["id"] for b in out for r in b.to_pylist()] == list(range(len(lists))) and got[0] == ["run", "thes", None, "работа"] and got[-1] is None
    assert [g and len(g) for g in got] == [x and len(x) for x in lists]
    assert max(b.nbytes for b in out) < 16 << 20 < batch.nbytes
