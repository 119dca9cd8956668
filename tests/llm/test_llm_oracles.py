import pytest
from compare import FOLDER, check

from codeskein import llm

CASES = [(m, n) for m in llm.MODULES for n in m.SQL]
OTHERS = [(m, n) for m in llm.MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_gives_what_sql_gives(spark, module, name):
    check(spark, module, name)


@pytest.mark.parametrize("module,name", OTHERS, ids=[n for _, n in OTHERS])
def test_query_without_sql_runs(spark, module, name):
    assert module.QUERIES[name](spark, FOLDER).limit(5).collect() is not None
