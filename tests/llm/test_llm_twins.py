import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from twins import SF_DIR, assert_equal, connection

from redactica.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no shared tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    assert_equal(spark, connection(), queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op2_simhash", "op3_records", "op4_packing", "op5_toxicity", "op7_quality", "op9_sharding"])
def test_one_row_per_document_at_least(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert queries.queries()[name](spark, SF_DIR).select("doc_id").distinct().count() == docs
