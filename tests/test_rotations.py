"""The nearest rotation: Newton steps only for matrices that are none yet."""

import numpy as np

from scenetables.functions import mat


def test_nearest_rotation_steps_only_where_needed(spark):
    rng = np.random.default_rng(4)
    given = []
    for k in range(60):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = q + (rng.normal(size=(3, 3)) * (0, 1e-7, 0.1)[k % 3]), rng.normal(size=3)
        given.append(m)
    rows = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(given)], "k int, m array<double>")
    for r in rows.select("k", mat.nearest_rotation("m").alias("r")).collect():
        m, out = given[r.k], np.array(r.r).reshape(4, 4)
        u, _, v = np.linalg.svd(m[:3, :3])
        assert np.allclose(out[:3, :3], u @ v, atol=1e-9) and np.array_equal(out[:3, 3], m[:3, 3])
        assert r.k % 3 or np.array_equal(out, m)  # a rotation comes back as it is
