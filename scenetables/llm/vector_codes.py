"""Compression of vectors to codes: a codebook for each part of a vector, fitted and applied exactly in integers.

Parts and codebook entries are padded with zeros to a power of two and carried over by the Walsh-Hadamard transform, which keeps squared
distances up to the factor of its size. Coefficients lie in sequency order, by the number of sign changes, so that the slow ones, which tend to
hold most of a vector, come first. Scaled squared differences are summed coefficient by coefficient; an entry leaves as soon as its
sum is above the whole distance of a first guess. What is left to the end has its exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetables.llm.common import discard, materialize, small_batches, table
from scenetables.llm.vectors import as_longs, exact, matrix, scaled, usable, whole_sum

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_CHUNK = 4096  # vectors that a task compares at a time
_MOST = 1 << 62  # of a coefficient
_SUM = pa.decimal128(38, 0)


def sequency_hadamard(size: int) -> np.ndarray:
    """The +-1 matrix of a power of two, its rows by rising number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def padded_size(width: int) -> int:
    return 1 << (width - 1).bit_length()


def transformed(parts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Coefficients of integer parts (..., width), padded to the matrix's size."""
    return parts @ h[:, : parts.shape[-1]].T


def restored(coefficients: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """The parts again, exactly: the transform is its own inverse but for its size."""
    return (coefficients @ h // len(h))[..., :width]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index in ties), scaled squared distance, and coefficients looked at, for the coefficients of parts and of
    entries. The guess is the entry nearest in the first coefficient."""
    x, e = exact(parts.shape[1], parts, entries)
    n, k = len(x), len(e)
    if not n:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    first = (x[:, :1] - e[:, 0]) ** 2
    guess = e[first.argmin(axis=1)]
    most = ((x - guess) ** 2).sum(axis=1)
    row, entry = np.nonzero((first <= most[:, None]).astype(bool))
    total = first[row, entry]
    looked = np.full(n, k)
    for c in range(1, x.shape[1]):
        looked += np.bincount(row, minlength=n)
        total = total + (x[row, c] - e[entry, c]) ** 2
        stay = (total <= most[row]).astype(bool)
        row, entry, total = row[stay], entry[stay], total[stay]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # the guess is still there, so every row is
    least = np.minimum.reduceat(total, starts)
    at = np.flatnonzero((total == least[row]).astype(bool))
    at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
    return entry[at], least, looked


def coefficient_table(vectors: DataFrame, parts: int, dimension: int) -> DataFrame:
    """(id, label, w): the coefficients of the parts of vectors (id, label, v: array of longs of one length, a multiple of the parts), stored in the
    scratch folder."""
    width = dimension // parts
    h = sequency_hadamard(padded_size(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = transformed(matrix(b.column("v"), dimension).reshape(-1, parts, width), h).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(list(c), pa.list_(pa.int64()))], ["id", "label", "w"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "label")]
    return materialize(small_batches(vectors.select("id", "label", "v")).mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, w array<long>"), "coefficients")


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Chunks of the table with their coefficients, by part, and what nearest_entries() finds for each part. books: parts, entries, coefficients."""
    for b in batches:
        for k in range(0, b.num_rows, _CHUNK):
            chunk = b.slice(k, _CHUNK)
            x = matrix(chunk.column("w"), books.shape[0] * books.shape[2]).reshape(-1, books.shape[0], books.shape[2])
            yield chunk, x, [nearest_entries(x[:, p], book) for p, book in enumerate(books)]


def fitted(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after a round: floors of the means of their parts; unused entries stay. A task sends a row of sums for
    each entry; sums of coefficients are transformed sums of parts."""
    width = books.shape[2]
    h = sequency_hadamard(padded_size(width))
    at = transformed(books, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(at.shape[:2], dtype=int), np.zeros(at.shape, dtype=object)
        for _, x, found in _blocks(batches, at):
            x = exact(len(x) ** 2, x)[0]
            for p, (entry, _, _) in enumerate(found):
                for e in np.unique(entry):
                    mine = x[entry == e, p]
                    n[p, e] += len(mine)
                    sums[p, e] += mine.sum(axis=0).astype(object)
        used = np.argwhere(n)
        rows = [[Decimal(int(s)) for s in sums[p, e]] for p, e in used]
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[n > 0], pa.int64()), pa.array(rows, pa.list_(_SUM))], ["p", "e", "n", "s"])

    part = small_batches(stored).select("w").mapInArrow(run, "p int, e int, n long, s array<decimal(38,0)>")
    new = books.copy()
    for r in part.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(len(h)))).alias("s")).collect():
        new[r["p"], r["e"]] = [int(x) // r["n"] for x in restored(np.array([int(x) for x in r["s"]], dtype=object), h, width)]
    return new


def coded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error)."""
    at = transformed(books, sequency_hadamard(padded_size(books.shape[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, found in _blocks(batches, at):
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] // at.shape[2] for f in found)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), chunk.column("label"), pa.array([bytes(c).hex() for c in code], pa.string()), as_longs(error)], ["id", "label", "code", "error"])

    id_kind, label_kind = (stored.schema[c].dataType.simpleString() for c in ("id", "label"))
    return small_batches(stored).mapInArrow(run, f"id {id_kind}, label {label_kind}, code string, error long")


def _first(vectors: DataFrame, n: int) -> np.ndarray:
    """The n vectors of the smallest ids, in their order; equal ids by their components. A null id starts no codebook."""
    rows = vectors.filter("id IS NOT NULL").orderBy("id", "v").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): one row per kept vector, repeated rows too.

    Vectors that are null or have null, NaN or infinite components are left out. Vectors of unequal lengths are padded with zeros to the longest, and that to a
    multiple of the parts. Fewer vectors than entries give fewer entries; without any, or without an id among them, the result is empty. Only the three columns
    are read, so others may have any names. Components are held where their coefficients fit in a long; an error or a sum that does not fit in one is null.
    Tasks hold a chunk of vectors and the codebooks, and send a row of sums for each entry; sums by label are joined back, as labels may be many."""
    if entries > 256:
        raise ValueError("two hex digits a part hold 256 entries")
    kept = vectors.filter(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(vector_col, scale).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    dimension = parts * max(1, -(-(longest or 0) // parts))
    most = _MOST // padded_size(dimension // parts)
    held = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)))
    kept = kept.select("id", "label", F.concat(held, F.array_repeat(F.lit(0).cast("long"), F.lit(dimension) - F.size("v"))).alias("v"))
    first = _first(kept, entries)
    if not len(first):
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    stored = coefficient_table(kept, parts, dimension)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = fitted(stored, books)
    found = materialize(coded(stored, books), "codes")
    discard(stored)
    sha = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    sums = found.groupBy(F.col("label").alias("of")).agg(whole_sum("error").alias("label_error"))
    out = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept vector of embeddings."""
    return codes(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """SQL of the assignment to the codebooks k, and of the codebooks after it, by all distances of the parts themselves."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e
  FROM (SELECT rid, part, e, sum((x - y) * (x - y)) AS d FROM comps JOIN b{k} USING (part, pos) GROUP BY rid, part, e) GROUP BY rid, part),
m{k} AS (SELECT part, e, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM comps JOIN a{k} USING (rid, part) GROUP BY part, e, pos),
b{k + 1} AS MATERIALIZED (SELECT part, e, pos, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM b{k} LEFT JOIN m{k} USING (part, e, pos)),"""


#: The same by all distances of each round.
OP12_SQL = f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
width AS (SELECT greatest(1, ceil(max(len(v)) / {PARTS}.0)::BIGINT) AS w FROM whole),
kept AS MATERIALIZED (SELECT * REPLACE (list_resize(v, {PARTS} * w, 0::HUGEINT) AS v) FROM whole, width),
flat AS (SELECT rid, w, unnest(v) AS x, unnest(range({PARTS} * w)) AS k FROM kept),
comps AS MATERIALIZED (SELECT rid, x, k // w AS part, k % w AS pos FROM flat),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL QUALIFY e < {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, e, pos, x AS y FROM comps JOIN firsts USING (rid)),
{"".join(map(_round, range(ROUNDS + 1)))}
sha AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT rid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), sha
"""
