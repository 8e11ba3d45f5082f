import pytest

from tessera.llm.queries import oracle_sql, queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    assert compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) is None


def test_registered():
    names = list(queries())
    assert [n for n in names if n.startswith("op")] == sorted(names[:-1], key=lambda n: int(n[2:].split("_")[0])) and names[-1] == "pipeline" and len(names) == 14
