import zlib

import numpy as np

from meshwork.llm.quality import BANDS, CUT, MEASURES, fit, keep_good, measures, score_quality

GOOD = "The river runs past the old mill, and people walk there. It was built long ago.\n"


def corpus():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        ws = rng.choice(GOOD.split(), 60).tolist()
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in ws) if bad and i % 2 else " ".join(w + "###" for w in ws) if bad else " ".join(ws)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_learns_the_labels(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 5.0) for r in [*rows, (None, None), (1000, "")]], "doc_id long, text string, score double")
    truth = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_quality(docs, truth).collect()}
    assert len(got) == 602
    quality = {i: q for i, q, _ in labels}
    held = [i for i in quality if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in quality)
    assert np.mean([got[i].predicted == quality[i] for i in held]) > 0.97
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= CUT)
    assert got[None].score == got[1000].score


def test_labels_of_the_fold_are_not_used(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (sorted(map(tuple, score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flip))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in score_quality(docs, none).collect()] == [1, 1]
    assert score_quality(docs.limit(0), none).collect() == []
    assert len(measures("x")) == len(measures("")) == MEASURES
    assert fit(np.zeros((4, MEASURES)), np.zeros(4)).score(np.zeros((1, MEASURES)))[0] < CUT
    same = fit(np.ones((6, MEASURES)), np.array([0, 1, 0, 1, 1, 1]))
    assert 0 <= same.score(np.ones((1, MEASURES)))[0] <= 1


def test_all_pairs_are_fitted_up_to_the_bound():
    rng = np.random.default_rng(3)
    x, y = rng.random((620, MEASURES)), np.arange(620) % 2
    x[:, 0] += y * 0.3
    one, two = (fit(x, y, seed=s).weights for s in (1, 2))  # 96,100 pairs
    assert np.array_equal(one, two)
    assert not np.array_equal(one, fit(x, y, pairs=1_000).weights)


def test_fit_minimises_the_pairwise_loss():
    """Gradient descent on all pairs, written out one by one, finds no lower loss, and the cut is the quantile."""
    rng = np.random.default_rng(5)
    x, y = rng.random((40, MEASURES)), (np.arange(40) % 3 > 0).astype(int)
    x[:, 1] += 0.4 * y
    model = fit(x, y)

    def indicator(v, edges):
        return [min(max((v - a) / (b - a), 0), 1) if b > a else float(v > a) for a, b in zip(edges, edges[1:])]

    edges = np.quantile(x, np.linspace(0, 1, BANDS + 1), axis=0)
    f = np.array([[t for j in range(MEASURES) for t in indicator(row[j], edges[:, j])] for row in x])
    pairs = [(i, k) for i in range(40) if y[i] for k in range(40) if not y[k]]
    d = np.array([f[i] - f[k] for i, k in pairs])
    ridge = 2e-3 * len(pairs)
    loss = lambda w: np.log1p(np.exp(-d @ w)).sum() + ridge / 2 * (w @ w)
    w = np.zeros(f.shape[1])
    for _ in range(4000):
        w -= 0.5 / len(pairs) * (ridge * w - d.T @ (1 / (1 + np.exp(d @ w))))
    assert loss(model.weights) <= loss(w) + 1e-6 and np.abs(model.weights - w).max() < 0.05
    assert np.isclose(model.cut, np.quantile(f @ model.weights, 1 - y.mean()))


def test_filter_keeps_rows_as_they_are(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, [i], "s") for i, r in enumerate([*rows, (None, None), (7, rows[7][1])])], "doc_id long, text string, score array<int>, predicted string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = keep_good(docs, truth)
    good = {r.doc_id for r in score_quality(docs, truth).where("predicted = 1").collect()}
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == good
    assert set(map(str, kept.collect())) <= set(map(str, docs.collect())) and keep_good(docs.limit(0), truth).count() == 0
