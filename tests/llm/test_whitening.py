import numpy as np
import pytest
from docassay.llm import queries, whitening


def brute(vectors):
    """n, sums, covariance of the different integer vectors, in Python's integers."""
    own = sorted({tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors})
    n, d = len(own), len(own[0])
    sums = [sum(x[j] for x in own) for j in range(d)]
    y = np.array([[n * x[j] - sums[j] for j in range(d)] for x in own], object)
    return n, sums, (y.T @ y).astype(float) / n**3


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, sums, v = brute([e for _, e in rows])
    e, x = np.linalg.eigh(v)
    e, x = e[::-1][:16], x[:, ::-1][:, :16]
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, sf_dir).collect()}
    assert len(got) == 16 * len(rows)
    sign = None
    for i, c in rows:
        y = np.array([int(np.floor(64 * float(a))) + 1_000_000 for a in c])
        own = [got[i, k] for k in range(1, 17)]
        assert {r.n for r in own} == {n}
        assert {r.deviation for r in own} == {sum((n * int(a) - s) ** 2 for a, s in zip(y, sums))}
        want = np.array([float(n * int(a) - s) / n for a, s in zip(y, sums)]) @ x / np.sqrt(e)
        found = np.array([r.whitened for r in own])
        sign = np.sign(want * found) if sign is None else sign
        assert np.abs(found * sign - want).max() < 1e-9
        assert np.abs(np.array([r.explained for r in own]) / (e / np.trace(v)) - 1).max() < 1e-9
        assert all(r.identity_error < 1e-8 for r in own)


def symmetric(e, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(e), len(e))))[0]
    return (q * e) @ q.T


@pytest.mark.parametrize(
    "e",
    [
        np.linspace(1, 2, 40),
        np.r_[1.0, 1 + 1e-9, 1 + 2e-9, 2, 3, 3, 3, 4],  # clusters below float32, and equal ones
        np.r_[np.full(20, 5.0), 7, 7 + 1e-12],
        np.geomspace(1e-9, 1e6, 30),
        np.zeros(5),
        np.r_[0, 0, 0, 1, 2.0],
        np.array([3.0]),
        1 + np.arange(24) * 3e-8,  # a chain of neighbours that float32 cannot part
    ],
)
def test_refinement_reaches_double_precision(e):
    v = symmetric(np.asarray(e, float), 3)
    v = (v + v.T) / 2
    found, x = whitening.refined(v)
    size = np.abs(v).max() or 1
    assert np.abs(x.T @ x - np.eye(len(v))).max() < 1e-14
    assert np.abs(v @ x - x * found).max() < 1e-14 * max(size, 1e-300) * len(v)
    assert np.abs(found - np.linalg.eigvalsh(v)).max() < 1e-13 * size
    assert (np.diff(found) >= 0).all()


def test_float32_alone_is_not_enough():
    v = symmetric(np.linspace(1, 2, 40), 3)
    x = np.linalg.eigh(v.astype(np.float32))[1].astype(float)
    assert np.abs(x.T @ x - np.eye(40)).max() > 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2], 1), (2, [0.5, -0.2], 1), (3, [0.1, 0.9], 1), (3, [0.1, 0.2], 1), (None, [0.3, 0.3], 1), (4, None, 1), (5, [], 1), (6, [None, 0.1], 1), (7, [nan, 0.1], 1),
        (8, [inf, 0.1], 1), (9, [0.1, 0.2, 0.3], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0) for r in got) == sorted([0, 1, 2, 3, 3] * 2)
    n, sums, _ = brute([v for _, v, _ in rows[:5]])
    assert {r.n for r in got} == {4} == {n}
    equal = [r for r in got if r.vec_id in (1, 3) and r.component == 1]
    assert len({r.deviation for r in equal}) == 2
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 1 or vec_id = 4")).count() == 0  # one vector has no direction


def test_large_entries_and_flat_directions(spark):
    rows = [(1, [1e300, 1.0, 5.0]), (2, [-1e300, 2.0, 5.0]), (3, [0.0, 3.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got if r.vec_id == 1} == {None}
    assert all(np.isfinite(r.whitened) for r in got)
    flat = [(i, [float(i % 3), 5.0, 2.0 * (i % 3)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and {r.n for r in got} == {3}
    assert abs(sum(r.whitened**2 for r in got) / 9 - 1) < 1e-9


def test_negative_zero_and_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.25, -0.0, 0.0, 1.0, 2.0, 3.0]) for i in range(200)]
    one, many = (whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(k)).collect() for k in (1, 7))
    n, _, v = brute([e for _, e in rows])
    assert {r.n for r in one} == {n} == {301}
    a, b = ({(r.vec_id, r.component): r.whitened for r in x} for x in (one, many))
    flip = {k: np.sign(a[0, k] * b[0, k]) for k in range(1, 7)}
    assert max(abs(a[i, k] - flip[k] * b[i, k]) for i, k in a) < 1e-9
