import os

import pytest

from oracle import DATA, compare
from sievestone.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


COLUMNS = {
    "op1_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_quality": "doc_id held_out score predicted",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_token_counts": "doc_id n_tokens",
    "op10_lm": "doc_id n_tokens target_loss background_loss score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
