import io
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievestone.api import Engine
from sievestone.plans.index import IndexError_
from sievestone.sources import decode as decoding
from sievestone.sources import formats
from sievestone.sources.decode import decode
from sievestone.sources.embed import hashed_trigrams
from sievestone.sources.listing import Ignore, Rules, scan, walk


def make(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())


RUSSIAN = "Поиск файлов по содержимому работает быстро и находит нужные документы в большом дереве каталогов. "


@pytest.mark.parametrize("codec,name", [("cp1251", "windows-1251"), ("koi8_r", "koi8-r"), ("cp866", "ibm866")])
def test_decode(codec, name):
    assert decode(RUSSIAN.encode(codec)) == (RUSSIAN, name)


def test_decode_binary():
    assert decode(b"a\x00b") is None and decode(b"\xff\xfe\xfd\xfc" * 16) is None
    assert decode(b"a" * 9000 + b"\x00")[1] == "utf-8"
    assert decode("й".encode())[0] == "й"




def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_formats():
    w = 'xmlns:w="w"'
    assert formats.docx(archive({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>"})) == "a\tb\nc"
    sheet = "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row/></sheetData></worksheet>"
    assert formats.xlsx(archive({"xl/sharedStrings.xml": "<sst><si><t>A</t></si><si><r><t>C</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})) == "A\t\tC"
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    assert formats.pptx(archive({"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two")})) == "two\n\nten"
    odt = '<d xmlns:t="t" xmlns:b="b"><b:table><b:table-row><b:table-cell><t:p>x</t:p><t:p>y</t:p></b:table-cell><b:table-cell><t:p>z</t:p></b:table-cell></b:table-row></b:table><t:h>h<t:s t:c="3"/>i</t:h></d>'
    assert formats.opendocument(archive({"content.xml": odt})) == "x y\tz\nh   i"
    assert formats.rtf(rb"{\rtf1\ansi\ansicpg1251 \'cf\'f0\'e8\'e2\'e5\'f2}") == "Привет"
    u = ("\\" + "u1055").encode()  # a code unit in decimal
    assert formats.rtf(b"{\\rtf1\\ansi" + u + b"?}") == "П" and formats.rtf(b"{\\rtf1\\ansi\\uc0" + u + b" X}") == "ПX"
    assert formats.rtf(rb"{\rtf1{\fonttbl Arial;}{\*\x y}a\par b}") == "a\nb"
    assert formats.fb2("<F><description>no</description><body><p>один</p><p>два</p></body></F>".encode()) == "один\nдва"
    assert formats.ipynb(json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "raw", "source": "r"}, {"cell_type": "markdown", "source": "c"}]}).encode()) == "a\nb\n\nc"
    opf = '<package><manifest><item id="a" href="a%20b.xhtml#x" media-type="application/xhtml+xml"/><item id="n" properties="nav" href="n.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/></spine></package>'
    page = "<html><head><style>x</style></head><body><h1>Réglages</h1><table><tr><td>port</td><td>8080</td></tr><tr><th>hôte</th><td>a<br/>b</td></tr></table><p>x &lt; y&#33;</p></body></html>"
    book = archive({"META-INF/container.xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS/p.opf": opf, "OPS/a b.xhtml": page, "OPS/n.xhtml": "<p>nav</p>"})
    told = formats.epub(book)
    assert told.startswith("Réglages\n") and "port\t8080\n" in told and told.endswith("x < y!") and "nav" not in told and "style" not in told
    assert "hôte\ta" in told


def test_walk(tmp_path):
    make(tmp_path, {"a.go": "x", "notes.md": "x", ".env": "x", "server.key": "x", "empty.go": "", "yarn.lock": "x", "node_modules/b.go": "x", "sub/.gitignore": "*.go\n!keep.go\n", "sub/c.go": "x", "sub/keep.go": "x", ".git/x.go": "x"})
    got = {rel: reason for _, rel, _, _, _, reason, _ in walk(str(tmp_path), Rules(ext=["go"]))}
    assert got["a.go"] is None and got["sub/keep.go"] is None
    assert {k: got[k] for k in ("notes.md", ".env", "server.key", "empty.go", "yarn.lock", "node_modules", "sub/c.go", ".git")} == {
        "notes.md": "ext", ".env": "hidden", "server.key": "secret", "empty.go": "empty", "yarn.lock": "noisy", "node_modules": "vendor", "sub/c.go": "gitignore", ".git": "hard_excluded",
    }
    got = {rel: reason for _, rel, _, _, _, reason, _ in walk(str(tmp_path), Rules(include_hidden=[".env"]))}
    assert got[".env"] is None
    got = {rel: reason for _, rel, _, _, _, reason, _ in walk(str(tmp_path), Rules(include_noisy=["yarn.*"]))}
    assert got["yarn.lock"] is None and {rel: r for _, rel, _, _, _, r, _ in walk(str(tmp_path), Rules(noisy=[]))}["yarn.lock"] is None
    assert Ignore("/a\nb/\n**/c\n").ignores("a", False) and not Ignore("/a").ignores("x/a", False) and not Ignore("b/").ignores("b", False)


def test_scan_shares_out_folders(spark, tmp_path):
    files = {f"d{i}/s{j}/f{k}.md": "x" for i in range(4) for j in range(3) for k in range(2)}
    make(tmp_path, files | {"d1/.gitignore": "s2/\nf1.md\n!/s0/f1.md\n", "d2/s1/.gitignore": "*.md", "top.md": "x", "d3/node_modules/y.md": "x"})
    want = sorted(map(str, walk(str(tmp_path))))
    for share in (1, 3, 8, 256):
        got = scan(spark, str(tmp_path), share=share)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert next(iter(walk(str(tmp_path / "none"))))[5] == "walk_failed"


@pytest.fixture
def engine(spark, tmp_path):
    src = tmp_path / "src"
    make(src, {"docs/guide.md": "# Guide\n\nHow to replace files and search them.\n\n## Setup\n\nInstall it.\n", "internal/store.go": "package store\n\n// ReplaceFile writes.\nfunc ReplaceFile(path string) error { return nil }\n", "notes.txt": "Локальный поиск по файлам\n"})
    return Engine(spark, str(tmp_path / "ix"), hashed_trigrams, "letters"), src


def test_cycle(engine):
    e, src = engine
    first = e.index(str(src))
    assert (first["indexed"], first["failed"], first["exit_code"]) == (3, [], 0)
    assert e.index(str(src))["unchanged"] == 3
    assert e.check()["exit_code"] == 0
    for q, want in {"поиск": "notes.txt", "файл": "notes.txt", "ReplaceFile": "store.go", "replace_file": "store.go", "поис*": "notes.txt", "setup": "guide.md"}.items():
        assert os.path.basename(e.search(q).first().path) == want, q
    assert e.search("!!!").count() == 0
    assert {os.path.basename(r.path) for r in e.search("replace file", exts=["md"]).collect()} == {"guide.md"}
    with pytest.raises(IndexError_) as err:
        e.search("x", mode="semantic")
    assert err.value.code == "no_vectors"
    make(src, {"notes.txt": "Совсем другой текст\n", "new.md": "fresh words\n"})
    os.remove(src / "docs/guide.md")
    checked = e.check()
    assert checked["counts"] == {"changed": 1, "missing": 1, "unindexed": 1, "current": 1} and checked["exit_code"] == 3
    again = e.index(str(src), with_vectors=True)
    assert (again["updated"], again["indexed"], again["deleted"]) == (2, 1, 1)
    assert e.status()["vectors"] == e.status()["chunks"] == 3
    assert e.search("fresh words", mode="semantic").count() == 3
    assert os.path.basename(e.search("fresh words", mode="hybrid", dedupe=True, max_per_file=1).first().path) == "new.md"
    ref = e.search("fresh").first().ref
    assert e.show(ref).count() == 1 and json.loads(e.search_json("fresh"))["count"] == 1
    assert e.rm(str(src / "internal")) == 1 and e.status()["files"] == 2
    with pytest.raises(IndexError_):
        e.index(str(src), size=99)


def stored(ix):
    return sorted((r.path, r.text) for r in ix.table("chunks").collect())


def test_stream(spark, tmp_path):
    from sievestone.plans.index import Index
    from sievestone.streaming.ingest import SCHEMA, documents_stream, merge, run

    ix = Index(spark, f"file://{tmp_path}/ix")
    put = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("/a", "one two", 1), ("/b", "three", 1))
    run(ix, documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    put(("/a", "old", 2), ("/a", "four five", 3), (None, "x", 1), ("/c", None, 1))
    run(ix, documents_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert stored(ix) == [("/a", "four five"), ("/b", "three")]
    m = ix.manifest()
    assert len(m["segments"]) == 2 and m["stats"]["files"] == 3 and m["stats"]["chunks"] == 2  # the first segment is as it was
    again = spark.createDataFrame([("/a", "four five", 3)], SCHEMA)
    merge(ix, again)
    assert stored(ix) == [("/a", "four five"), ("/b", "three")] and ix.manifest()["stats"] == m["stats"]


def test_segments_and_compaction(spark, tmp_path):
    from sievestone.plans import index as plans
    from sievestone.streaming.ingest import SCHEMA, merge

    ix, want = plans.Index(spark, str(tmp_path / "ix")), {}
    for i in range(plans.MOST_SEGMENTS + 3):
        rows = {f"/f{i % 4}": f"text number {i} here", f"/only{i}": "apart"}
        want |= rows
        merge(ix, spark.createDataFrame([(p, t, 1) for p, t in rows.items()], SCHEMA))
        assert stored(ix) == sorted(want.items())
        m = ix.manifest()
        lengths = [r.dl for r in ix.table("lengths").collect()]
        assert m["stats"] == {"files": len(want), "chunks": len(lengths), "dl": sum(lengths)}
        assert sorted({(r.path, r.dl) for r in ix.table("postings").collect()}) == sorted((r.path, r.dl) for r in ix.table("lengths").collect())
    assert len(m["segments"]) <= 4 and plans.delete(ix, F.col("path").startswith("/only")) == plans.MOST_SEGMENTS + 3
    assert stored(ix) == sorted((p, t) for p, t in want.items() if p.startswith("/f")) and ix.manifest()["stats"]["files"] == 4


def test_one_writer(spark, tmp_path):
    from sievestone.plans.index import Index

    ix = Index(spark, str(tmp_path / "ix"))
    with ix.locked(), pytest.raises(IndexError_) as err, ix.locked():
        pass
    assert err.value.code == "locked"
    with ix.locked():
        pass


def test_touch_prune_stop_and_vectors(engine):
    e, src = engine
    e.index(str(src))
    os.utime(src / "notes.txt", (1, 1))
    again = e.index(str(src))
    assert again["unchanged"] == 3 and again["updated"] == 0 and e.check()["exit_code"] == 0
    assert e.search("поиск").count() == 1 and e.status()["files"] == 3
    os.remove(src / "notes.txt")
    assert e.index(str(src), prune=False)["deleted"] == 0 and e.status()["files"] == 3
    halted = e.index(str(src), stop=lambda: True)
    assert halted["interrupted"] and halted["deleted"] == 0 and e.status()["files"] == 3
    assert e.index(str(src))["deleted"] == 1 and e.search("поиск").count() == 0
    assert e.check(with_vectors=True)["issues"] == ["vectors_missing"]
    e.index(str(src), with_vectors=True, concurrency=1)
    assert e.status()["vectors"] == e.status()["chunks"] and e.check(with_vectors=True)["issues"] == []
    make(src, {"docs/guide.md": "# New\n\nQuite other words.\n"})
    e.index(str(src), with_vectors=True)
    assert e.status()["vectors"] == e.status()["chunks"] == e.ix.table("vectors").join(e.ix.table("chunks"), ["path", "seq"]).count()


def test_json_answers(engine):
    e, src = engine
    e.index(str(src))
    got = json.loads(e.search_json("replace files", k=3, exts=["md"]))
    assert got["schema"] == 2 and got["query"]["text"] == "replace files" and got["parameters"]["k"] == 3 and got["parameters"]["pool"] == 100 and got["count"] == 1
    ref = got["results"][0]["ref"]
    make(src, {"docs/guide.md": "# Changed in the meantime\n"})
    shown = json.loads(e.show_json(ref))
    assert [w["code"] for w in shown["warnings"]] == ["modified"] and len(shown["chunks"]) == 1


def test_a_large_batch_is_decoded_in_pieces(monkeypatch):
    schema = {"id": T.StructField("id", T.LongType())}
    monkeypatch.setattr(decoding, "map_arrow", lambda df, fn, kinds: (fn, kinds))
    run, kinds = decoding.decode_all(type("Rows", (), {"select": lambda self, *c: self, "schema": schema})(), "raw", "id")
    raw = [b"plain " * 100_000, None, b"\x00\x01", "é".encode() * 9, "Привет, как дела".encode("cp1251")] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(raw, pa.binary())], ["id", "raw"])
    out = list(run(iter([batch])))
    assert kinds == "id bigint, encoding string, text string"
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, *(decode(x or b"") or (None, None))[::-1]) for i, x in enumerate(raw)]
    assert max(b.nbytes for b in out) < 4 << 20 < batch.nbytes
