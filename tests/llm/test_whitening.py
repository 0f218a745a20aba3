import numpy as np
import pytest

from rankloom.llm import whitening as W


@pytest.mark.parametrize("dim, rows, kind", [(6, 40, "wide"), (8, 3, "few"), (5, 200, "twin"), (24, 150, "plain"), (4, 60, "equal")])
def test_rank_one_updates_give_the_spectrum(dim, rows, kind):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.normal(size=(rows, dim)) * 30 * (np.linspace(1, 4, dim) if kind == "wide" else 1))
    if kind == "twin":
        x[:, 2] = x[:, 1]
    if kind == "equal":  # repeated eigenvalues at every step
        x = np.tile(np.vstack([np.eye(dim), -np.eye(dim)]), (8, 1)) * 3
    d, q = np.zeros(dim), np.eye(dim)
    for v in x - x.mean(0):
        d, q = W.update(d, q, v)
    whole = (x - x.mean(0)).T @ (x - x.mean(0))
    e = np.linalg.eigvalsh(whole)
    assert np.abs(d - e).max() < 1e-12 * e[-1]
    assert np.abs(q.T @ q - np.eye(dim)).max() < 1e-12
    assert np.abs((q * d) @ q.T - whole).max() < 1e-12 * e[-1]


def rows_of(spark, vectors):
    return spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, n string")


def test_whitening_equals_the_direct_computation(spark, monkeypatch):
    monkeypatch.setattr(W, "FIT_ROWS", 16)   # several spectra, combined in two rounds
    monkeypatch.setattr(W, "FAN", 3)
    rng = np.random.default_rng(3)
    c = rng.normal(size=(150, 7)).astype(np.float32) * np.linspace(.2, 2, 7, dtype=np.float32)
    c[20:60] = c[20]
    odd = [None, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [], [1.0] * 3, [None] + [0.0] * 6]
    got = W.whiten(rows_of(spark, c.tolist() + odd)).toPandas()
    x = np.floor(256 * c.astype(np.float64)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    assert len(got) == 4 * 150 and set(got.n) == {n} and got.identity_error.max() < 1e-12
    p = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(150)].to_numpy()
    want = (x - s / n) @ q / np.sqrt(e)
    assert np.abs(p - want * np.sign((p * want).sum(0))).max() < 1e-10
    one = got[got.component == 1].set_index("vec_id").loc[range(150)]
    assert (one.deviation.to_numpy() == ((n * x - s) ** 2).sum(1)).all()
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(v), rtol=1e-12)


def test_degenerate_tables(spark):
    assert W.whiten(rows_of(spark, [[1.0, 2.0]]).limit(0)).count() == 0
    assert W.whiten(rows_of(spark, [None, [float("nan")]])).count() == 0
    assert W.whiten(rows_of(spark, [[1.0, 2.0]] * 3)).count() == 0              # no direction varies
    line = W.whiten(rows_of(spark, [[float(k), 2.0 * k, 0.0] for k in range(5)])).collect()
    assert sorted({r.component for r in line}) == [1] and abs(line[0].explained - 1) < 1e-12
    huge = W.whiten(rows_of(spark, [[1e30, 0.0], [-1e30, 1.0], [0.5, 0.5]])).collect()
    assert len(huge) >= 3 and all(r.deviation is None or r.deviation >= 0 for r in huge)
