"""Exact search and whitening against brute force, with ties, copies, odd lengths and unusable vectors."""

import numpy as np
import pytest

DIR = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def crowd(seed, n, dim, copies):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dim))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, 0.2, (n, dim))
    x[:copies] = x[0]  # a hot group of equal vectors
    return np.round(x, 3)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    rows = [(100 * i if i % 10 == 0 else 7 * i + 1, x.tolist(), "a", 1, "s") for i, x in enumerate(crowd(1, 1200, 6, 400))]
    rows += [(100, rng.normal(size=6).round(2).tolist(), "b", 2, "t"), (100, rows[0][1], "b", 2, "t"), (0, rows[0][1], "c", 3, "u"), (0, rows[0][1], "c", 3, "u")]  # ids that repeat, with equal and other vectors
    rows += [(None, rows[5][1], "d", 4, "v"), (-300, rows[7][1], "d", 4, "v"), (400, None, "e", 5, "w"), (500, [1.0, None], "e", 5, "w"), (600, [NAN, 1.0], "e", 5, "w"), (700, [INF, 1.0], "e", 5, "w")]
    rows += [(900, [], "f", 6, "x"), (901, [], "f", 6, "x"), (800, [2.5, -1.0], "g", 7, "y"), (801, [0.0, 0.0], "g", 7, "y"), (802, [-3.0, 4e9], "g", 7, "y"), (1000, [1e30, 2.0], "g", 7, "y")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int, slot string"), rows


def plain_search(rows, k=10, scale=1024):
    kept = [(i, r[0], [int(np.floor(scale * c)) for c in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    out = []
    for i, q, v in kept:
        if q is None or q % 100:
            continue
        scored = sorted(((-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63) + 1), c is None, c or 0) for j, c, w in kept if j != i and len(w) == len(v)))
        out += [(q, p + 1, None if null else c, -s) for p, (s, null, c) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, mixed, monkeypatch):
    from gristmill.llm import kd_search

    monkeypatch.setattr(kd_search, "BLOCK", 32)  # several blocks of queries and stretches of boxes
    monkeypatch.setattr(kd_search, "LEAF_ROWS", 16)
    df, rows = mixed
    got = sorted((tuple(r) for r in kd_search.nearest_rows(df.repartition(5)).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == plain_search(rows)


def test_search_in_several_shards(spark, monkeypatch):
    from gristmill.llm import kd_search

    monkeypatch.setattr(kd_search, "SHARD_VALUES", 256)
    x = crowd(2, 3000, 4, 900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = sorted((tuple(r) for r in kd_search.nearest_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()), key=str)
    single = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert got == plain_search(single)


def test_search_prunes_and_bounds_hold(spark):
    from gristmill.llm import kd_search as kd

    x = np.floor(crowd(4, 5000, 8, 0) * 1024)
    tree = kd.grow(x, np.arange(5000), np.zeros(5000, bool))
    q = x[::500]
    for low, high in zip(tree.low, tree.high):
        step = len(tree.low[0]) // len(low)
        starts = np.append(tree.starts[::step], len(x))
        bound = kd.reach_bound(q, low, high)
        assert all((q @ tree.x[s:e].T).max() <= bound[:, i].max() for i, (s, e) in enumerate(zip(starts, starts[1:])))
    who, score, ids, _ = kd.search(tree, q, np.full(len(q), kd.NONE), 11)
    assert [sorted(score[who == i].tolist()) == sorted((q[i] @ x.T).tolist())[-11:] for i in range(len(q))] == [True] * len(q)
    # a floor that only the best row reaches leaves that row alone
    top = (q @ x.T).max(axis=1).astype(np.int64)
    who, score, _, _ = kd.search(tree, q, top, 11)
    assert set(score.tolist()) <= set(top.tolist()) and set(who.tolist()) == set(range(len(q)))


def test_search_of_nothing(spark, mixed):
    from gristmill.llm.kd_search import nearest_rows

    df, _ = mixed
    assert nearest_rows(df.where("false")).count() == 0
    assert nearest_rows(df.where("vec_id = 801")).count() == 0
    assert [tuple(r) for r in nearest_rows(df.where("vec_id in (800, 801)")).collect()] == [(800, 1, 801, 0)]


def test_whitening_against_eigenvectors(spark):
    from gristmill.llm.queries import QUERIES

    got = QUERIES["op12_whitening"](spark, DIR).toPandas()
    v = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()
    x = np.floor(np.array(v["embedding"].tolist(), float) * 64) + 1_000_000
    n, whole = len(x), x.astype(np.int64)
    centred = x - x.mean(axis=0)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    shown = got.pivot(index="vec_id", columns="component", values="whitened").loc[v["vec_id"]].to_numpy()
    want = centred @ axes[:, :32] / np.sqrt(e[:32])
    signs = np.sign((shown * want).sum(axis=0))
    assert np.abs(shown * signs - want).max() < 1e-6
    first = got[got["component"] == 1].set_index("vec_id").loc[v["vec_id"]]
    assert (first["deviation"].to_numpy() == ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)).all() and (got["n"] == n).all()
    assert np.allclose(got[got["vec_id"] == v["vec_id"][0]].sort_values("component")["explained"], e[:32] / e.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and abs(got["identity_error"][0] - np.abs(np.cov(shown.T, bias=True) - np.eye(32)).max()) < 1e-9


def test_whitening_of_nearly_dependent_columns(spark):
    """A condition number near 1e9 of the rows, whose square a single Cholesky factor of the Gram matrix would not survive."""
    from gristmill.llm.whitening import whiten

    rng = np.random.default_rng(8)
    x = rng.integers(-(10**9), 10**9, (400, 4)).astype(float)
    x[:, 3] = x[:, 2] + rng.integers(-1, 2, 400)
    rows = [(i, (r / 64).tolist()) for i, r in enumerate(x)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 1600 and got["identity_error"].max() < 1e-6 and not got["whitened"].isna().any()


def test_whitening_edges(spark, mixed):
    from gristmill.llm.whitening import whiten

    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [3.0, 4.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [NAN, 1.0, 1.0]), (5, []), (6, [1.0]), (7, [2.0, 9.0, 0.5]), (8, [1e30, 1.0, 1.0])]
    got = whiten(spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, n int, component string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 6, None: 3, 7: 3, 6: 1}
    assert all(r["n"] == 4 and (r["whitened"] is None) == (r["component"] == 3) for k in (1, None, 7) for r in by[k]) and by[6][0]["n"] == 1 and by[6][0]["whitened"] is None
    assert all(r["identity_error"] < 1e-9 for k in (1, None, 7) for r in by[k])
    assert whiten(mixed[0].where("false")).count() == 0
