import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators.detectors import autoencoder, sequence, store


def on_circle(spark, n, seed, radius=1.0):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, 2 * np.pi, n)
    x = np.stack([np.cos(at), np.sin(at)], 1) * radius + rng.normal(0, 0.02, (n, 2))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n bigint, sequence array<double>")


def test_gradient_is_the_derivative():
    layers = autoencoder.shapes(5, 4, 2)
    flat, rng = autoencoder.started(layers, 1), np.random.default_rng(2)
    x = rng.normal(size=(7, 5))
    loss = lambda w: ((autoencoder.rebuilt(x, autoencoder.unpacked(w, layers))[0] - x) ** 2).mean()
    found = autoencoder.gradient(x, autoencoder.unpacked(flat, layers))
    for i in rng.integers(0, len(flat), 25):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert np.isclose((loss(flat + step) - loss(flat - step)) / 2e-6, found[i], atol=1e-6)


def test_a_break_that_the_linear_one_misses(spark, tmp_path, monkeypatch):
    """Points of a circle need a curved code of one number; its middle is where a linear code errs least."""
    monkeypatch.setattr(autoencoder, "SHARE", 1500)  # three workers
    train = on_circle(spark, 4000, 1)
    fitted = [autoencoder.fit(train, 2, hidden=32, code=1, rounds=8, passes=16, rate=1e-2) for _ in range(2)]
    assert np.array_equal(fitted[0].weights, fitted[1].weights)  # repeatable
    path = store.save(fitted[0], spark, str(tmp_path / "model"))
    model, linear = store.load(spark, path), sequence.fit(train, 2, hidden=1)
    usual, odd = on_circle(spark, 300, 2), on_circle(spark, 60, 3, radius=0.1)

    def separation(m):
        a, b = (m.transform(d).agg(F.percentile_approx("score", q)).first()[0] for d, q in ((usual, 0.9), (odd, 0.5)))
        return b / a

    assert separation(model) > 3 and separation(linear) < 1
    assert model.transform(usual.limit(0)).count() == 0
