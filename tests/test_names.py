"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from onomast.functions import distance as D
from onomast.functions import names as N

NORM = {"#111_b2": "111_batch2", "CTRL_rep1_b1": "control_replicate1_batch1", "Sample_1": "sample1", "s_1_2": "sample1_2", "sample001a": "sample1a", "S1-B1": "sample1_batch1", "wt1": "wt1", "Patient.007": "patient7", "": "", "#": "", "samp": "sample", "ctl+": "ctl+", "p0": "patient0", "sample１": "sample1"}
SIGNATURE = {"p111-batch03": ["111", "3"], "sample_9a": ["9a"], "p1b1": ["1", "1"], "control+_batch1": ["1", "0control+"], "ctrl+_batch1": ["1", "0control+"], "control_batch1+": ["1", "1+"], "sample²_1": ["1", "0sample²"], "cd4−": ["4", "1-"], "x00": ["0"], "sample_9α": ["9α"]}
SKELETON = {"Patient-111_BatchA": "patientbatcha", "İ1": "i", "": ""}


def test_normal_forms(spark):
    got = dict(spark.createDataFrame([(n,) for n in NORM], "n string").select("n", N.normalise(F.col("n"))).collect())
    assert got == NORM


def test_signatures(spark):
    got = dict(spark.createDataFrame([(n,) for n in SIGNATURE], "n string").select("n", N.signature(F.col("n"))).collect())
    assert got == SIGNATURE


def test_skeletons_and_canonical(spark):
    got = dict(spark.createDataFrame([(n,) for n in SKELETON], "n string").select("n", N.skeleton(F.col("n"))).collect())
    assert got == SKELETON
    flags = dict(spark.createDataFrame([(n,) for n in ("a_1", "_", "A", "", "é")], "n string").select("n", N.is_canonical(F.col("n"))).collect())
    assert flags == {"a_1": True, "_": False, "A": False, "": False, "é": False}


@pytest.mark.parametrize("a,b,osa,kind", [("ca", "abc", 3, D.UNRELATED), ("patient", "patietn", 1, D.SWAP), ("abc", "abd", 1, D.SUBSTITUTION), ("abc", "ab", 1, D.INDEL), ("", "a", 1, D.INDEL), ("same", "same", 0, D.UNRELATED), ("ab", "ba", 1, D.SWAP), ("abcd", "badc", 2, D.UNRELATED)])
def test_distances(spark, a, b, osa, kind):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(D.osa()(F.col("a"), F.col("b")), D.classify(F.col("a"), F.col("b")), D.hamming(F.col("a"), F.col("b")), D.similarity(F.col("a"), F.col("b"), "hamming")).first()
    assert (row[0], row[1]) == (osa, kind)
    assert (row[2] is None) == (len(a) != len(b))


def test_osa_against_the_full_grid():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def grid(a, b):
        d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    @settings(max_examples=300, deadline=None)
    @given(st.text("abc", max_size=8), st.text("abc", max_size=8))
    def check(a, b):
        assert D._osa(a, b) == grid(a, b)

    check()
