import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sievestone import cli
from sievestone.operators.vector_table import VectorTable, declare
from sievestone.sources.embed import EmbedError, HttpEmbedder, hashed_trigrams, read_blob, read_npy


@pytest.mark.parametrize("bad", ["x text", "v float[0]", "v bit[12]", "v bit[8] distance_metric=l1", "v float[4], chunk_size=12", "v float[9000]", "v float[4] distance_metric=dot", "v float[4], " + ", ".join(f"p{i} text partition key" for i in range(5)), "v float[4], k float primary key"])
def test_bad_declarations(bad):
    with pytest.raises(ValueError):
        declare(bad)


def test_vector_table(spark):
    t = VectorTable(spark, "id integer primary key, v float[2] distance_metric=cosine, label integer partition key, name text, +note text")
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1, "a", "x"), (2, [0.9, 0.1], 1, "b", "y"), (3, [0.0, 1.0], 2, "c", "z")], "id int, v array<double>, label int, name string, note string")
    t = t.insert(rows)
    assert [r.id for r in t.knn("v", [1, 0], 2).collect()] == [1, 2]
    assert [r.id for r in t.knn("v", [1, 0], 2, (F.col("label") == 1) & (F.col("name") != "a")).collect()] == [2]
    assert [r.id for r in t.knn("v", [1, 0], 2, keys=[3]).collect()] == [3]
    assert t.point(3).first().name == "c" and t.delete(F.col("id") == 3).scan().count() == 2
    assert t.update(F.col("id") == 3, v=F.array(F.lit(1.0), F.lit(0.0))).knn("v", [1, 0], 3).filter("distance < 1e-6").count() == 2
    with pytest.raises(ValueError):
        t.update(F.col("id") == 3, label=F.lit(1))
    with pytest.raises(ValueError):
        t.insert(rows)
    with pytest.raises(ValueError):
        t.knn("v", [1, 0, 0], 1)
    with pytest.raises(Exception, match="needs 2 dimensions"):
        t.insert(spark.createDataFrame([(9, [1.0], 1, "a", "x")], rows.schema)).scan().collect()


def serve(answers):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = answers.pop(0) if answers else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"embeddings": hashed_trigrams(body["input"])}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


@pytest.mark.parametrize("answers,works", [([], True), ([500, 503], True), ([500] * 3, False), ([404], False)])
def test_embedding_client(answers, works):
    server, url = serve(answers)
    try:
        client = HttpEmbedder(url, "m", wait=0.0)
        if works:
            assert client(["ab", "c"]) == hashed_trigrams(["ab", "c"])
        else:
            with pytest.raises(EmbedError):
                client(["ab"])
    finally:
        server.shutdown()


def test_npy(spark, tmp_path):
    import numpy as np

    m = np.arange(46, dtype=np.float32).reshape(23, 2)
    np.save(tmp_path / "v.npy", m)
    for got in (read_npy(spark, str(tmp_path / "v.npy"), block=5), read_npy(spark, f"file://{tmp_path}/v.npy"), read_npy(spark, (tmp_path / "v.npy").read_bytes())):
        rows = got.orderBy("vec_id").collect()
        assert [r.vec_id for r in rows] == list(range(23)) and [list(r.embedding) for r in rows] == m.tolist()
    np.save(tmp_path / "bad.npy", m.astype(np.float64))
    with pytest.raises(ValueError):
        read_npy(spark, str(tmp_path / "bad.npy"))
    np.save(tmp_path / "none.npy", m[:0])
    assert read_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_static_blob(spark):
    import struct

    got = read_blob(spark, struct.pack("<6f", *range(6)), 3).orderBy("vec_id").collect()
    assert [list(r.embedding) for r in got] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        read_blob(spark, b"1234", 3)


def test_filters_follow_types(spark):
    t = VectorTable(spark, "v float[1], part text partition key, n integer, x float, ok boolean, s text, +note text")
    rows = [(i, [float(i)], "ab"[i % 2], i, i / 2, i > 1, f"s{i}", "n") for i in range(5)]
    t = t.insert(spark.createDataFrame(rows, "rowid int, v array<double>, part string, n int, x double, ok boolean, s string, note string"))
    near = lambda *f: sorted(r.rowid for r in t.knn("v", [0.0], 9, t.where(*f)).collect())
    assert near(("part", "=", "a"), ("n", ">=", 2)) == [2, 4] and near(("n", "in", [1, 3]), ("ok", "!=", True)) == [1]
    assert near(("x", "<", 1)) == [0, 1] and near(("s", "in", ["s2"])) == [2] and near() == [0, 1, 2, 3, 4]
    for bad in (("note", "=", "n"), ("v", "=", 1), ("zz", "=", 1), ("ok", "<", True), ("x", "in", [1.0]), ("n", "like", 1), ("n", "=", "1"), ("n", "=", True), ("ok", "=", 1), ("s", "=", 3)):
        with pytest.raises(ValueError):
            t.where(bad)


def test_hashed_trigrams():
    a, b, c = hashed_trigrams(["Some text", "some TEXT", "xy"])
    assert a == b and any(a) and not any(c) and sum(map(abs, a)) <= 7


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    monkeypatch.setenv("SIEVESTONE_LANG", "en")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("# Title\n\nsome words here\n")
    go = lambda *a: (cli.main(list(a)), capsys.readouterr())
    assert go("version")[0] == 0 and go("status")[0] == 1 and go("check")[0] == 3
    code, said = go("index", ".")
    assert code == 0 and "indexed 1" in said.out
    code, said = go("search", "--format", "paths", "words")
    assert code == 0 and said.out.strip() == os.path.realpath(tmp_path / "a.md")
    assert json.loads(go("search", "--format", "json", "words")[1].out)["count"] == 1
    assert json.loads(go("show", "--format", "json", os.path.realpath(tmp_path / "a.md") + "#0")[1].out)["warnings"] == []
    assert go("index", "--quiet", "--no-prune", "--noisy", ".")[1].out == "" and go("index", "--concurrency", "0", ".")[0] == 2
    assert go("check", "--embed")[0] == 3
    assert "Title" in go("show", os.path.realpath(tmp_path / "a.md") + "#0")[1].out
    assert go("search", "--mode", "semantic", "x")[0] == 1 and go("search", "-k", "0", "x")[0] == 2
    assert go("check")[0] == 0 and json.loads(go("status", "--format", "json")[1].out)["files"] == 1 and "files 1" in go("status")[1].out
    assert go("rm", str(tmp_path))[0] == 0
