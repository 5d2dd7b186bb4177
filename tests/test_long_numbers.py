"""Queries against their SQL where numbers have five digits: padding to four digits then cuts them, so names repeat and lie."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from onomast import queries as Q
from onomast.operators import cluster, model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Customers of eight spellings each; those of 1000, 10000 and 10003 share p1000-b02, those of 10001 and 10004 p1000-b03, a group of its own."""
    path = str(tmp_path_factory.mktemp("long"))
    keys = [8 * n + v for n in (0, 1, 2, 999, 1000, 1049, 10000, 10001, 10003, 10004, 10496) for v in range(8)] + [8 * 10005]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{path}/customer.parquet")
    return path


def rows_of_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{folder}/customer.parquet/*.parquet'")
    con.execute(f"create view part as select * from '{SF}/part.parquet'")
    cursor = con.execute(Q.oracle_sql()[name])
    order = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    return Counter(tuple(r[i] for i in order) for r in cursor.fetchall())


def rows_of_spark(name, spark, folder):
    frame = Q.queries()[name](spark, folder)
    return Counter(tuple(r) for r in frame.select(*(F.col(f"`{c}`") for c in sorted(frame.columns))).collect())


def test_model_guard(spark, folder):
    assert rows_of_spark("model_guard", spark, folder) == rows_of_sql("model_guard", folder)


def test_a_name_answered_twice_is_one_row(spark):
    names = cluster.with_features(spark.createDataFrame([("p1_b1",), ("patient1_batch1",)], "name string")).select("name", *cluster.FEATURES)
    said = [("p1_b1", "patient1_batch1"), ("p1_b1", "patient1_batch1"), ("p1_b1", "q1_b1"), ("patient1_batch1", "patient1_batch1")]
    out = model.guard(names, spark.createDataFrame(said, "name string, canonical string")).select("name", "group", "proposed")
    assert sorted(map(tuple, out.collect())) == [("p1_b1", "p1_b1", "patient1_batch1"), ("patient1_batch1", "p1_b1", "patient1_batch1")]


def test_group_rules(spark, folder):
    assert rows_of_spark("group_rules", spark, folder) == rows_of_sql("group_rules", folder)


def test_match_predicate(spark, folder):
    assert rows_of_spark("match_predicate", spark, folder) == rows_of_sql("match_predicate", folder)


def test_qc_counts_sum_the_group_table(spark, folder):
    """Not the SQL of qc_counts, which groups by the number that a name was made from and not by the one it holds."""
    table = rows_of_sql("group_table", folder)
    sizes = [len(members.split("|")) for _, _, members, *_ in table]
    ((merges, names, _, samples), _), = rows_of_spark("qc_counts", spark, folder).items()
    assert (names, samples, merges) == (sum(sizes), len(sizes), sum(n > 1 for n in sizes))


def test_qc_sizes_are_those_of_the_group_table(spark, folder):
    table = rows_of_sql("group_table", folder)
    shown = Counter((i, final, len(members.split("|")), rows) for final, i, members, _, _, _, rows, _ in table if "|" in members)
    assert rows_of_spark("qc_sizes", spark, folder) == Counter({(i, label, rows, n): k for (i, label, n, rows), k in shown.items()})
