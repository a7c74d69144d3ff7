import numpy as np
import pyarrow as pa

from strandmill.llm import ann


def brute(ids, x, every, k=10):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            out[i] = sorted((float(a), int(j)) for a, j in zip(d, ids, strict=True) if j != i)[:k]
    return out


def run(spark, rows, every=100):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where(f"vec_id % {every} = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(d, i) for _, d, i in sorted(v)] for q, v in got.items()}


def test_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[500:900] = x[499]
    ids = np.arange(3000)
    rows = [(int(i), [float(a) for a in v], "s") for i, v in zip(ids, x, strict=True)]
    bad = [(3000, None, ""), (3100, [0.0] * 32, ""), (3200, [float("nan")] * 32, ""), (3300, [1.0, None], ""), (None, [1.0] * 32, ""), (3400, [1.0], "")]
    got = run(spark, rows + bad + rows[:5])
    want = brute(ids, x.astype(np.float64), 100)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    assert got[500] == want[500] and got[800] == want[800]
    exact = {q: {i: d for d, i in v} for q, v in brute(ids, x.astype(np.float64), 100, 3000).items()}
    assert all(exact[q][i] == d for q, v in got.items() for d, i in v)


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.5, 0.0], ""), (2, [0.0, 3.0], "")]
    assert run(spark, rows) == {0: [(0.5, 1), (float(np.sqrt(10.0)), 2)]}
    assert run(spark, []) == {} and run(spark, [(0, None, "")]) == {}


def test_parallel_residual_is_smaller_than_without_weight():
    rng = np.random.default_rng(1)
    x = ann.polar(rng.normal(size=(2000, 15)), np.zeros(15))[0]
    unit = x

    def along(weight):
        z = ann.Quantiser(parallel=weight).fit(x)
        back = z.centres[np.arange(8)[None], z.encode(x)].reshape(len(x), -1)
        return float((((x - back) * unit).sum(1) ** 2).mean())

    assert along(4.0) < along(1.0)


def test_recall_on_data_that_is_shifted_uneven_or_clustered(spark):
    rng = np.random.default_rng(6)
    n, d = 20_000, 64
    normal = rng.normal(size=(n, d))
    centres = rng.normal(size=(20, d)) * 5
    sets = {
        "normal": normal,
        "uneven norms": normal * rng.lognormal(0, 1, size=(n, 1)),
        "shifted": normal + 50,
        "clusters": centres[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, d)),
    }
    for name, x in sets.items():
        x = x.astype(np.float32)
        frame = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})).repartition(6)
        got = {}
        for r in ann.nearest(frame, frame.where("vec_id % 400 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = {i: set(np.argsort(((x.astype(np.float64) - x[i]) ** 2).sum(1), kind="stable")[1:11].tolist()) for i in range(0, n, 400)}
        found = [len(got[i] & want[i]) / 10 for i in want]
        assert np.mean(found) >= 0.9 and min(found) >= 0.5, (name, np.mean(found), min(found))
