"""What each operator must do in full: cases that a cap, a window or a support rule would lose."""

import math
import random
import re

import numpy as np
import pytest

from onomast.llm import binary_codes, disclosure, near_dup


@pytest.mark.parametrize("shared,start,own", [(64, 9, 11), (71, 3, 10)])
def test_isolated_links_inside_a_large_family(spark, monkeypatch, shared, start, own):
    """Backgrounds of 60 / 100 and 67 / 93, pairs at 69 / 91 and 70 / 90."""
    monkeypatch.setattr(near_dup, "REGION", 2)  # a family of hundreds is then as deep as one of thousands
    rng = random.Random(21)
    word = lambda: f"u{rng.randrange(10**9)}"
    template = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(150):
        both = [word() for _ in range(start)]
        for j in range(2):
            tail = both if i < 40 else [word() for _ in range(start)]
            rows.append((2 * i + j, " ".join(template + tail + [word() for _ in range(own)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in near_dup.near_duplicates(frame).collect())
    want = sorted(near_dup.brute_force(rows))
    assert sum(not r[3] for r in want) == 40 and got == want


def test_vectors_with_a_common_mean(spark, monkeypatch):
    monkeypatch.setattr(binary_codes, "BUCKET", 0.125)  # the bits of many vectors
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = np.eye(64)[:1]
    apart = lambda x: unit(x - (x @ mean.T) * mean)
    a = 0.9**0.5 * mean + 0.1**0.5 * apart(rng.normal(size=(60, 64)))
    e = rng.normal(size=a.shape)
    b = 0.955 * a + (1 - 0.955**2) ** 0.5 * unit(e - (e * a).sum(1, keepdims=True) * a)
    vectors = np.concatenate([a, b]).tolist()
    got = binary_codes.near_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    links = sum(w[1] for w in binary_codes.brute_force(list(range(120)), vectors))
    assert links >= 120 and 0.97 * links <= sum(r["n_links"] for r in got) <= links


def letters(extra):
    """Documents of common words, and ``extra`` from number 1000 on."""
    rng = random.Random(5)
    common = ["alpha", "beta", "gamma", "delta", "omega"]
    return [(i, " ".join(rng.choices(common, k=30))) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(extra)]


def test_entities_in_one_or_two_documents(spark):
    rows = letters(["alpha Zorblax bob@x.org beta", "alpha Quimby amy@x.org beta", "gamma Quimby amy@x.org delta"])
    found = disclosure.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["term"], r["certain"]) for r in found if r["term"] not in ("bob", "amy")} == {("zorblax", True), ("quimby", True)}


def test_terms_far_from_their_entity(spark):
    far = "alpha " * 40
    rows = letters([f"Zorblax {far} 12 34 {far} bob@x.org", f"bob@x.org {far} Zorblax", f"Quimby {far} amy@x.org cid@x.org", f"amy@x.org {far} Quimby Quimby", "quimby alpha"])
    rows += [rows[-1]] * 2
    for alpha in (0.95, 0.5):
        got = {r["term"]: r["certain"] for r in disclosure.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), alpha).collect()}
        assert got == brute_terms([t for _, t in rows], alpha) and got["zorblax"] and ("quimby" in got) == (alpha == 0.5)


def brute_terms(texts, alpha):
    sets = [(set(re.findall(r"[a-z]+@[a-z.]+", t.lower())), set(re.findall(r"[a-z]{3,}", t.lower()))) for t in texts]
    out = {}
    for c in set().union(*(e for e, _ in sets)):
        n_c = sum(c in e for e, _ in sets)
        for t in set().union(*(w for e, w in sets if c in e)):
            n, n_t = sum(c in e and t in w for e, w in sets), sum(t in w for _, w in sets)
            if math.log2(n / n_t * len(sets) / n_c) >= alpha * math.log2(len(sets) / n_c):
                out[t] = out.get(t, False) or n == n_t
    return out
