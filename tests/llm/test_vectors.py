"""Centroid clustering and vector codes against plain Python integers, and against their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from scenetables.llm import pivot_clusters, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def kept(rows, scale, dimension=None):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and dimension in (None, len(r[1]))]
    return [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in ok]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, entries):
    return min(range(len(entries)), key=lambda c: (apart(v, entries[c]), c))


def means(vectors, entries):
    of = [nearest(v, entries) for v in vectors]
    out = []
    for c, old in enumerate(entries):
        mine = [v for v, x in zip(vectors, of) if x == c]
        out.append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
    return out


def plain_clusters(rows, k=16, rounds=3):
    r = kept(rows, 64, 64)
    starts = sorted((x for x in r if x[0] is not None), key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    c = [x[1] for x in starts]
    if not c:
        return []
    for _ in range(rounds):
        c = means([x[1] for x in r], c)
    of = [(x[0], nearest(x[1], c)) for x in r]
    d = [apart(x[1], c[o[1]]) for x, o in zip(r, of)]
    by = {j: sum(y for y, o in zip(d, of) if o[1] == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, j, y, by[j], sum(d), sha[j]) for (i, j), y in zip(of, d)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    r = kept(rows, 4096)
    dimension = parts * max(1, math.ceil(max((len(x[1]) for x in r), default=0) / parts))
    r = [(i, v + [0] * (dimension - len(v)), label) for i, v, label in r]
    w = dimension // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(x[1])[p] for x in sorted((x for x in r if x[0] is not None), key=lambda x: x[:2])[:entries]] for p in range(parts)]
    if not books[0]:
        return []
    for _ in range(rounds):
        books = [means([cut(x[1])[p] for x in r], books[p]) for p in range(parts)]
    code = [[nearest(cut(x[1])[p], books[p]) for p in range(parts)] for x in r]
    error = [sum(apart(cut(x[1])[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(r, code)]
    by = {label: sum(e for e, x in zip(error, r) if x[2] == label) for label in {x[2] for x in r}}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(x[0], "".join(f"{y:02x}" for y in c), e, by[x[2]], sha) for x, c, e in zip(r, code, error)]


def mixed(seed=0, n=150, d=64):
    """Vectors around a few centres, with repeated rows and ids, ties, nulls and unusable vectors."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    rows = [(i, (centres[i % 5] + r.normal(size=d) * 0.2).tolist(), i % 3 if i % 7 else None) for i in range(n)]
    rows += [rows[3]] * 20 + [(3, rows[4][1], 1), (None, rows[5][1], None), (900, [0.0] * d, 1), (901, [-0.0] * d, 1)]
    rows += [(902, None, 1), (903, [math.nan] * d, 1), (904, [math.inf] + [0.0] * (d - 1), 1), (905, [None] + [0.0] * (d - 1), 1)]
    return rows


def ordered(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("rows", [mixed(), mixed(1, 9), mixed(2)[:1], [(1, None, 1)], [], [(None, [0.5] * 64, 1)], mixed(3, 40) + [(910, [1.0] * 63, 1), (911, [], 1)]])
def test_clusters(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(pivot_clusters.clusters(df).collect()) == ordered(plain_clusters(rows))


@pytest.mark.parametrize("rows", [mixed(), mixed(1, 9), mixed(2)[:1], [(1, None, 1)], [], [(None, [0.5] * 64, 1)], mixed(3, 40, 20) + [(910, [1.0] * 13, 1), (911, [], 1)], [(1, [], None)]])
def test_codes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(vector_codes.codes(df).collect()) == ordered(plain_codes(rows))


def test_other_columns(spark):
    """Columns of clashing names do no harm, and ids may be of another type."""
    rows = mixed(4, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "v", "w", "far", "cluster", "distance", "code", "error", "of", "label_error"):
        df = df.selectExpr("*", f"'x' AS {c}")
    assert ordered(pivot_clusters.clusters(df).collect()) == ordered(plain_clusters(rows))
    assert ordered(vector_codes.codes(df).collect()) == ordered(plain_codes(rows))
    named = df.selectExpr("'n' || vec_id AS name", "embedding", "label")
    assert vector_codes.codes(named, id_col="name").columns[0] == "name"
    assert pivot_clusters.clusters(named, id_col="name").count() == len(plain_clusters(rows))


def test_beyond_64_bits(spark):
    """Far components are exact while sums fit, and null where a long cannot hold a distance."""
    rows = [(i, [float(i * 2**22)] + [0.25] * 63, 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ordered(pivot_clusters.clusters(df).collect()) == ordered(plain_clusters(rows))
    far = spark.createDataFrame(rows + [(99, [1e300] * 64, 2), (98, [-1e300] * 64, 2)], SCHEMA)
    by_id = {r["vec_id"]: r for r in pivot_clusters.clusters(far, k=1).collect()}
    assert by_id[99]["distance"] is None and by_id[0]["inertia"] is None
    by_id = {r["vec_id"]: r for r in vector_codes.codes(far, entries=1).collect()}
    assert by_id[99]["error"] is None and by_id[99]["label_error"] is None


def test_pivots_save_distances(spark):
    """On vectors around centres most exact distances are saved."""
    rows = [r for r in mixed(5, 400) if r[0] is not None and r[0] < 400]
    v = np.array([x[1] for x in kept(rows, 64)])
    c = v[:16]
    p = pivot_clusters.chosen_pivots(c, 8)
    best, d, tested = pivot_clusters.nearest(v, pivot_clusters.to_pivots(v, p), c, pivot_clusters.to_pivots(c, p))
    assert best.tolist() == [nearest(x, c.tolist()) for x in v.tolist()] and d.tolist() == [apart(x, c[b].tolist()) for x, b in zip(v.tolist(), best)]
    assert tested.mean() < 8 and tested.min() >= 1


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13])
def test_transform(width):
    """Distances keep their size factor, signs change row by row, and the way back is exact."""
    h = vector_codes.sequency_hadamard(vector_codes.padded_size(width))
    assert [(row[1:] != row[:-1]).sum() for row in h] == list(range(len(h)))
    x = np.random.default_rng(width).integers(-5000, 5000, (60, width))
    y = vector_codes.transformed(x, h)
    assert (vector_codes.restored(y, h, width) == x).all()
    entry, d, looked = vector_codes.nearest_entries(y, y[:16])
    assert entry.tolist() == [nearest(a, x[:16].tolist()) for a in x.tolist()]
    assert d.tolist() == [len(h) * apart(a, x[e].tolist()) for a, e in zip(x.tolist(), entry)]
    assert width < 5 or looked.mean() < 16 * len(h) * 0.8


def test_sql(spark, tmp_path):
    rows = mixed(6, 120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for query, sql in ((pivot_clusters.op11_centroid_clusters, pivot_clusters.OP11_SQL), (vector_codes.op12_vector_codes, vector_codes.OP12_SQL)):
        df = query(spark, str(tmp_path))
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        assert names == df.columns and ordered(df.collect()) == ordered(cur.fetchall())
