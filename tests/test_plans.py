import pyarrow.parquet as pq
import pytest

from tarnflow.queries import ORACLES, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).collect()


def test_vector_literal_multiplies_single_floats(spark, tmp_path):
    """0.29 as a single float, times 100, is 29 in single and 28.999999 in double arithmetic."""
    rows = spark.range(1, 60).selectExpr("id AS vec_id", "transform(sequence(-50, 50), i -> cast((i + id) / 100 AS float)) AS embedding", "1 AS label")
    pq.write_table(rows.toArrow(), f"{tmp_path}/embeddings.parquet")
    got = assert_same(QUERIES["vector_literal"](spark, str(tmp_path)), ORACLES["vector_literal"], tmp_path)
    assert any(",29," in literal for _, literal in got if literal)
