import pytest
from test_queries import duck, plain  # noqa: F401

from skein.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, duck, name):  # noqa: F811
    df = q.QUERIES[name](spark, sf)
    got = df.toPandas()
    assert list(got.columns) == df.columns
    if name in q.SQL:
        assert plain(got) == plain(duck.sql(q.SQL[name]).df())
