import os
import re

import pytest

from oracle import DATA, compare
from sievestone.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_imports_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "sievestone")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"\bllm\b", f.read()), n


def test_hashes_of_documents(spark):
    from sievestone.functions.text import fnv1a64_text

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.hash for r in catalog.queries()["fnv1a64"](spark, DATA).collect()}
    assert got == {i: None if t is None else fnv1a64_text(t.encode()) for i, t in texts.items()}
