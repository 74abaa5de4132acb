import pytest

from tests.compare import connect, rows
from wavecrest.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = connect(SF).execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["cosine_blocks", "bessel_samples"])
def test_every_sample_is_read(spark, name):
    n = connect(SF).execute("SELECT sum(ceil(len(embedding) / 16) * 16)::BIGINT FROM embeddings" if name == "cosine_blocks" else "SELECT sum(len(embedding))::BIGINT FROM embeddings").fetchone()[0]
    assert catalogue.QUERIES[name](spark, SF).count() == n
