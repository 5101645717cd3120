import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievestone import session
from sievestone.operators import chunking
from sievestone.operators.chunking import split, starts


def test_short_paragraphs_stay_together():
    text = "one\n\ntwo\n\nthree"
    assert split("a.txt", text, 100, 0) == [(text, 1, 5)]


def test_hard_cut():
    got = split("a.txt", "x" * 250, 100, 0)
    assert len(got) == 3 and "".join(c[0] for c in got) == "x" * 250


def test_lines():
    text = "\n".join(["aaaaaaaaaa", "bbbbbbbbbb", "", "cccccccccc", "dddddddddd"])
    assert [c[1:] for c in split("a.txt", text, 10, 0)] == [(1, 1), (2, 2), (4, 4), (5, 5)]


def test_overlap():
    got = split("a.txt", "слово " * 100, 50, 10)
    assert len(got) > 2 and all(len(c[0]) <= 60 for c in got)
    plain = split("a.txt", "слово " * 100, 50, 0)
    for (a, *_), (b, *_), (c, *_) in zip(plain, plain[1:], got[1:], strict=False):
        carried, rest = c.split("\n")
        assert rest == b and a.strip().endswith(carried)


@pytest.mark.parametrize("text,size", [("", 100), (" \n\n ", 100), ("a", 0)])
def test_nothing(text, size):
    assert split("a.txt", text, size, 0) == []


def test_markdown_starts():
    text = "# A\n\ntext\n\n## B\n\n```\n# not\n## not\n```\n\n### C\n"
    lines = [text[:p].count("\n") + 1 for p in starts("x.md", text)]
    assert lines == [5, 12]


def test_small_functions_stay_together():
    assert len(split("a.go", "package a\n\n" + "func f() {}\n" * 8, 1200, 0)) == 1


def test_declarations_take_their_comments():
    text = "import os\n\n# about f\n@d\ndef f():\n    pass\n"
    assert [text[p:].split("\n")[0] for p in starts("a.py", text)] == ["# about f"]


def test_json_and_yaml():
    text = '{\n  "a": {\n    "b": 1\n  },\n  "c": "}"\n}\n'
    assert [text[p:].strip().split("\n")[0] for p in starts("a.json", text)] == ['"a": {', '"c": "}"']
    assert starts("a.yml", "# c\na: 1\n# d\nb:\n  c: 2\n") == [9]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#й", max_size=400), st.sampled_from([5, 20, 60]), st.sampled_from([0, 3, 10]))
def test_invariants(text, size, overlap):
    lines = text.split("\n")
    for body, a, b in split("x.md", text, size, overlap):
        assert len(body) <= size + overlap + 1 and 1 <= a <= b <= len(lines) + 1 and body.strip()


def test_pieces_are_bounded_and_in_order():
    texts = pa.array(["x" * 1000 * (k % 7) for k in range(300)] + [None, "y" * 50_000])
    batch = pa.RecordBatch.from_arrays([texts, pa.array([[t] * 3 for t in texts.to_pylist()])], ["text", "more"])
    for rows in (texts, batch, batch.slice(5, 90)):
        got = list(session.pieces(rows, 20_000))
        assert [r for g in got for r in g.to_pylist()] == rows.to_pylist() and len(got) > 9
        assert all(len(g) == 1 or g.nbytes <= 20_000 for g in got)
    assert session.by_pieces(lambda a: a)(texts).equals(texts) and len(session.by_pieces(lambda a: a)(texts.slice(0, 0))) == 0


def test_a_large_batch_of_files_is_chunked_in_pieces(monkeypatch):
    monkeypatch.setattr(chunking, "map_arrow", lambda df, fn, schema: fn)
    texts = ["word " * n for n in (0, 1, 5000, 200_000)] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(["/a.md"] * len(texts)), pa.array(texts)], ["path", "text"])
    out = list(chunking.chunks(type("Files", (), {"select": lambda self, *c: self})())(iter([batch])))
    assert sum(b.num_rows for b in out) == 20 * sum(len(split("/a.md", t)) for t in texts[:4])
    assert max(b.nbytes for b in out) < 4 << 20 < batch.nbytes
