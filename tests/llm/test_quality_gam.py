"""The quality model: features against plain counts, held-out accuracy, odd tables."""

import numpy as np

from querywarden.llm import quality_gam as gam


def auc(y, s):
    rank = np.argsort(np.argsort(s))
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def test_features_of_plain_texts():
    x = gam.features([b"", b"One two two\nOne two two", b"A | b | c!!", "é é".encode()])
    at = {n: i for i, n in enumerate(gam.FEATURES)}
    assert (x[0] == 0).all()
    assert x[1, at["distinct_words"]] == 2 / 6 and x[1, at["repeated_words"]] == 2 / 6 and x[1, at["repeated_lines"]] == 0.5
    assert x[2, at["pipes"]] == 2 / 5 and x[2, at["odd_ends"]] == 3 / 5 and x[3, at["wide"]] == 1.0
    assert gam.features([]).shape == (0, len(gam.FEATURES))


def test_learns_steps_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(gam.FEATURES)))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.8)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs and auc(y[3000:], model.score(x[3000:])) > 0.97


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = gam.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.97 and held[held.quality == 0].predicted.mean() < 0.3
    assert set(got.predicted) <= {0, 1} and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "word " * 9000, None), (2, " \n", "z")], "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in gam.quality_scores(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (7, 0)], "doc_id long, quality int")
    got = gam.quality_scores(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert gam.quality_scores(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    x, y = gam.training_rows(gam.measured(docs), labels, sample=20)
    assert 5 <= len(x) == len(y) <= 40
