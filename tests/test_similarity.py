import numpy as np

from crisismap.operators import similarity as SIM


def test_blocks_and_salts_give_all_hits(spark, monkeypatch):
    rng = np.random.default_rng(0)
    t, q = rng.normal(size=(40, 4)), rng.normal(size=(11, 4))
    t[3] = q[2] = 0.0
    texts = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(t)] + [(99, None)], "k long, v array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    norms = np.linalg.norm(t, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
    want = np.divide(t @ q.T, norms, out=np.zeros((40, 11)), where=norms > 0)

    def check():
        got = {(r.k, r.qid): r.sim for r in SIM.similarities(texts, queries, "k", "v", threshold=0.25).collect()}
        assert set(got) == set(zip(*(a.tolist() for a in np.nonzero(want > 0.25))))
        assert all(abs(want[k] - s) < 1e-12 for k, s in got.items())
        best = {r.k: r.prediction for r in SIM.best_match(texts, queries, "k", "v", threshold=0.25).collect()}
        assert len(best) == 41 and all(best[i] == (int(want[i].argmax()) if want[i].max() > 0.25 else -1) for i in range(40))
        return got

    one = check()
    monkeypatch.setattr(SIM, "MAX_QUERIES_PER_BLOCK", 3)
    assert check() == one
    monkeypatch.setattr(SIM, "maybe_broadcast", lambda df: (df, False))
    plan = SIM.similarities(texts, queries, "k", "v")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert check() == one
