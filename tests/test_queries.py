import itertools
import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
from kodagraf.plans import catalog
from tests import oracle_check

SF = "/root/testdata/sf0.001"


def test_registry():
    """Every query has SQL but those that its catalogue names, with the reason beside them."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.SQL) == set(catalog.WITHOUT_SQL)
    if entry.llm:
        assert set(entry.llm.QUERIES) - set(entry.llm.SQL) == set(entry.llm.WITHOUT_SQL)
    assert set(entry.queries()) == set(catalog.QUERIES) | set(entry.llm.QUERIES if entry.llm else ())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["lookup_exact", "search_tiers", "call_edges", "budget_allocate", "query_symbols", "debounce_changes", "skeleton_file"])
def test_query_agrees_with_its_sql(spark, name):
    ok, note = oracle_check.compare(spark, oracle_check.connect(SF), name, SF)
    assert ok, note


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_order_files_keep_their_partitions(spark):
    """Adaptive execution does not put the small partitions together before Python reads them."""
    files = catalog.order_files(spark, SF)
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_module_cycles_all_lists_every_elementary_cycle(spark, tmp_path):
    """Of five modules, not only a shortest one through each edge."""
    rng, sf = random.Random(3), str(tmp_path)
    part = [(k, 1 + k % 50, "t", "b", "red box", 1.0) for k in range(5 * 128)]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_type string, p_brand string, p_name string, p_retailprice double").write.parquet(f"{sf}/part.parquet")
    lines = [(rng.randrange(999), rng.randrange(640), rng.randrange(99), 1) for _ in range(22)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{sf}/lineitem.parquet")
    have = {tuple(r) for r in catalog.QUERIES["module_edges"](spark, sf).collect()}
    nodes = sorted({n for e in have for n in e})
    paths = (p for k in range(2, 6) for p in itertools.permutations(nodes, k))
    want = sorted(" > ".join(p) for p in paths if p[0] == min(p) and all(e in have for e in zip(p, (*p[1:], p[0]))))
    assert any(w.count(">") == 4 for w in want)
    assert sorted(r.cycle for r in catalog.QUERIES["module_cycles_all"](spark, sf).collect()) == want
