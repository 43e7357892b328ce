"""Order statistics from sketches against sorting."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pixelweave.operators import normalize


def test_percentiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(61)
    groups = [rng.normal(size=5000), np.append(rng.random(3000), 1e300), rng.integers(0, 3, 4001).astype(float), np.array([4.0]), np.array([1.0, 2.0]),
              np.zeros(77), rng.random(33), np.exp(rng.normal(size=900) * 50), np.repeat(rng.random(7), rng.integers(1, 500, 7))]
    rows = pd.DataFrame({"image_id": np.repeat(np.arange(len(groups)), [len(g) for g in groups]), "channel": 0, "v": np.concatenate(groups)}).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows).repartition(7)
    df = df.union(df.select("image_id", "channel", F.lit(None).cast("double").alias("v")).limit(50))
    for accuracy in (10000, 200):  # with the second, brackets hold a small part of the larger groups
        monkeypatch.setattr(normalize, "ACCURACY", accuracy)
        for q in (0.0, 0.01, 0.37, 0.5, 0.99, 1.0):
            got = {r.image_id: r for r in normalize.percentiles(df, ["image_id"], "v", {"p": q}).collect()}
            near = {r.image_id: r.value for r in normalize.percentile_nearest(df, 100 * q).collect()}
            for k, g in enumerate(groups):
                s = np.sort(g)
                h = (len(s) - 1) * q
                a = int(np.floor(h))
                assert got[k].p == s[a] + (s[min(a + 1, len(s) - 1)] - s[a]) * (h - a), (accuracy, q, k)
                assert got[k].varies == (s[0] < s[-1])
                assert near[k] == s[round(0.01 * (100 * q) * (len(s) - 1))], (accuracy, q, k)
