"""Scene queries against their SQL on tables made for it: odd rows, and places where small tables hide a difference."""

import random

import duckdb

from scenetables.plans import registry


def same_as_sql(spark, folder, name, **tables):
    """The query's rows, which must be those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(2).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rows = registry.QUERIES[name](spark, str(folder)).collect()
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == sorted(repr(tuple(r)) for r in cur.fetchall())
    return rows


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_cut_embeddings_in_single_precision(spark, tmp_path):
    near = [k / 1000 for k in range(-999, 1000)]
    rows = [(k, near[k * 7 % 1992 : k * 7 % 1992 + 7], 0) for k in range(1, 2000)]
    odd = [(2007, None, 0), (2015, [0.5, None, 0.25], 1), (2023, [None] * 8, 1), (2031, [3e6, -7e9, 1e30] + [0.5] * 5, 2), (2039, [float("nan")] + [0.5] * 7, 2), (2047, [float("inf")] + [-0.0001] * 7, None)]
    out = {r.vec_id: r.total for r in same_as_sql(spark, tmp_path, "embedding_cut", embeddings=vectors(spark, rows + odd))}
    assert out[2007] == 0 and out[2015] == 750


def test_signs_are_aligned_along_whole_labels(spark, tmp_path):
    """A label is one track, whatever its length, through gaps of many blocks of frames; null is a label too."""
    rng = random.Random(5)
    rows = [(k * 701, [rng.uniform(-1, 1) for _ in range(5)], rng.choice([0, 1, None])) for k in range(900)] + [(7_000_000, None, 1), (7_000_001, [-1e-8, 1.0, 0.0, 1e-8], 0)]
    out = same_as_sql(spark, tmp_path, "sign_align", embeddings=vectors(spark, rows))
    assert len({r.clip_id for r in out}) == 3
