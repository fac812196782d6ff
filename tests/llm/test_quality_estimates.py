"""The robust estimates of operator 10 against a plain minimum-covariance-determinant search."""

import numpy as np
import pytest

from lectern.llm import quality

P = quality.P


def covariance(x):
    return quality.CONSISTENT * np.cov(x.T, bias=True) + np.diag(quality.FLOOR)


def plain_search(x, starts=300, seed=0):
    """Least log determinant over many random starts, each concentrated until it stands still, and the half-sample that gives it."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(quality.SHARE * len(x))), (np.inf, None)
    for _ in range(starts):
        near = x[rng.choice(len(x), P + 1, replace=False)]
        centre, cov, last = near.mean(0), np.cov(near.T, bias=True) + np.diag(quality.FLOOR), np.inf
        while True:
            far = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(far, kind="stable")[:h]]
            centre, cov = near.mean(0), covariance(near)
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-12:
                break
            last = det
        if last < best[0]:
            best = (last, centre)
    return best


def groups():
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(P, P))
    bulk = rng.normal(size=(240, P)) @ mixed
    cluster = bulk.mean(0) + 15 + rng.normal(size=(60, P)) * 0.1
    two = np.vstack([rng.normal(size=(160, P)), rng.normal(size=(60, P)) * 3 + 6])
    return {
        "plain": rng.normal(size=(200, P)) * [1, 2, 3, 4] + 10, "correlated": bulk, "planted": np.vstack([bulk, cluster]), "two crowds": two,
        "flat": np.vstack([np.tile([4.0, 0, 0, 0], (90, 1)), rng.normal(size=(10, P)) + 5]),
    }


def estimates(spark, found, parts=3):
    rows = [(name, *map(float, v)) for name, x in found.items() for v in x]
    vectors = spark.createDataFrame(rows, "group string, " + ", ".join(f"x{i} double" for i in range(P))).repartition(parts)
    return {r.group: r for r in quality.robust_estimates(vectors, len(found)).collect()}


@pytest.fixture(scope="module")
def own(spark):
    return estimates(spark, groups() | FEW)


FEW = {"one": np.ones((1, P)), "equal": np.ones((60, P)) * 2}


def matrix(row):
    return np.array([[row[f"s{max(i, j)}{min(i, j)}"] for j in range(P)] for i in range(P)])


def test_determinants_reach_those_of_a_plain_search(own):
    found = groups()
    assert set(own) == set(found) | set(FEW)
    for name, x in found.items():
        least, centre = plain_search(x)
        row, cov = own[name], matrix(own[name])
        assert np.isclose(row.determinant, np.linalg.slogdet(cov)[1])
        assert row.determinant <= least + 0.02, name
        assert np.allclose([row[f"m{i}"] for i in range(P)], centre, atol=0.25 * np.sqrt(np.diag(cov)).max()), name


def test_planted_cluster_is_beyond_the_cutoff(own):
    x, row = groups()["planted"], own["planted"]
    away = x - [row[f"m{i}"] for i in range(P)]
    far = np.einsum("ni,ij,nj->n", away, np.linalg.inv(matrix(row)), away)
    assert (far[240:] > quality.CUTOFF).all() and (far[:240] <= quality.CUTOFF).all()


def test_estimates_do_not_depend_on_partitions(spark, own):
    again = estimates(spark, groups() | FEW, 7)
    for name, row in own.items():
        assert np.allclose([float(v) for v in row[1:]], [float(v) for v in again[name][1:]], rtol=1e-6, atol=1e-9)


def test_few_and_equal_vectors(own):
    assert [own["one"][f"m{i}"] for i in range(P)] == [1.0] * P and np.isclose(own["equal"].determinant, np.log(quality.FLOOR).sum())
