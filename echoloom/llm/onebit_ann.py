"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 8).

Vectors are centred, rotated by one random orthogonal matrix and kept as the packed signs of
their coordinates, with two correction scalars: the norm, and the inner product of the
unit vector with its own code.  Codes are computed once and stored.  A query's inner product with a
code, divided by the latter scalar, estimates its inner product with the vector without bias; how far
the estimate may be off is bounded with a probability that ``BOUND`` sets.  Vectors
whose lower bound of the distance beats what a query already has are reranked: by distances up to
rounding, as one product of matrices, and those that remain by exact ones.

Queries are a table too: the rows that ask, with the distance beyond which each need not look (the
k-th exact distance within a bounded sample of the candidates), stored in files of at most
``BLOCK`` rows.  All rows are scanned once, some ``CHUNK`` bytes at a time, and each chunk
meets every file of queries, which its task reads from the shared folder; so neither the driver nor a
broadcast holds queries, and a chunk gives at most k candidates of each.

Codes are made of vectors times a power of two that brings the sample near 1.  A bound that
is not a number, as after an overflow, rules nothing out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from echoloom.llm.shared_files import opened
from echoloom.scratch import stored

BLOCK = 2048  #: most queries of a file
SAMPLE = 4096  #: candidates of the first bound
BOUND = 4.5  #: standard deviations of the estimate that the error bound allows
TILE = 1024
CHUNK = 1 << 25  #: bytes of vectors, as doubles, that meet a file of queries at a time
HELD = 1 << 26  #: most bytes of all queries for which a task keeps them between chunks
SLACK = 1e-5  #: of inner products of unit vectors in single precision
FOUND = "query_row long, query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix that follows from the seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def row_norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms in double precision, components added in order, without overflow or underflow on the way."""
    if not vectors.size:
        return np.zeros(len(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.add.accumulate(vectors**2, axis=1)[:, -1]
        out = np.sqrt(squares)
        odd = np.flatnonzero(~((squares > 1e-200) & (squares < 1e200)))
        if len(odd):  # once more, times a power of two
            top = np.abs(vectors[odd]).max(1)
            shift = np.where(np.isfinite(top), np.frexp(np.where(np.isfinite(top), top, 1.0))[1], 0)
            parts = np.ldexp(vectors[odd], -shift[:, None]) ** 2
            out[odd] = np.ldexp(np.sqrt(np.add.accumulate(parts, axis=1)[:, -1]), shift)
    return out


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances; infinite where beyond double precision."""
    with np.errstate(over="ignore"):
        return row_norms(vectors - query)


class Frame:
    """The scale, centre and rotation that all codes share."""

    def __init__(self, scale: int, centre: np.ndarray, turn: np.ndarray) -> None:
        self.scale, self.centre, self.turn = scale, centre, turn

    @classmethod
    def of_sample(cls, sample: np.ndarray, dim: int) -> Frame:
        norms = row_norms(sample)
        norms = norms[np.isfinite(norms) & (norms > 0)]
        scale = -int(np.frexp(np.median(norms))[1]) if len(norms) else 0
        near = np.ldexp(sample, scale)
        near = near[(np.abs(near) <= 1e3).all(1)] if len(near) else near  # outliers would move the centre away from all others
        return cls(scale, near.mean(0) if len(near) else np.zeros(dim), rotation(dim))

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.ldexp(vectors, self.scale) - self.centre

    def moved(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return self.centred(vectors) @ self.turn

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, norms, and inner products of unit vectors with their own codes."""
        moved = self.moved(vectors)
        norm = row_norms(moved)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            match = np.abs(moved / norm[:, None]).sum(1) / np.sqrt(moved.shape[1])
        return np.packbits(moved > 0, axis=1), norm, np.where(norm > 0, match, 1.0)


class Queries:
    """A block of queries, turned to unit length, with the distances beyond which each need not look."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, limits: np.ndarray, frame: Frame) -> None:
        self.rows, self.ids, self.vectors, self.limits = rows, ids, vectors, limits
        self.centred, moved = frame.centred(vectors), frame.moved(vectors)
        self.length = row_norms(moved)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self.unit = np.where(self.length[:, None] > 0, moved / self.length[:, None], 0.0).astype(np.float32)

    def lower_bounds(self, signs: np.ndarray, norm: np.ndarray, match: np.ndarray) -> np.ndarray:
        """Squared scaled distances that vectors have at least (but for rare errors), by query and vector; maybe not numbers."""
        dim = signs.shape[1]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            inner = (self.unit @ signs.T) / np.float32(np.sqrt(dim))
            error = np.sqrt(np.maximum(1 - match**2, 0)) / match * BOUND / np.sqrt(max(dim - 1, 1)) + SLACK / match
            cosine = np.minimum(inner / match[None, :] + error[None, :], 1.0)
            rounding = 1e-20 * (norm[None, :] ** 2 + self.length[:, None] ** 2)
            return (norm[None, :] - self.length[:, None]) ** 2 + 2 * norm[None, :] * self.length[:, None] * (1 - cosine) - rounding

    def squares(self, centred: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared scaled distances less what rounding may add to them, by query and vector; maybe not numbers."""
        with np.errstate(over="ignore", invalid="ignore"):
            both = norm[None, :] ** 2 + self.length[:, None] ** 2
            return both * (1 - 1e-11) - 2 * (self.centred @ centred.T)


def signs_of(bits: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _coder(shared) -> Callable:  # noqa: ANN001  a broadcast of a Frame
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                bits, norm, match = shared.value.codes(_matrix(part.column(2)))
                packed = pa.array([b.tobytes() for b in bits], pa.binary())
                yield pa.record_batch([*part.columns, packed, pa.array(norm), pa.array(match)], [*part.schema.names, "bits", "norm", "match"])

    return code


def _limiter(shared, k: int) -> Callable:  # noqa: ANN001  a broadcast of the sample's vectors
    def limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = shared.value
        for batch in batches:
            limits = np.full(batch.num_rows, np.inf)
            if len(sample) > k:  # a query may itself be in the sample, so one more than k
                limits[:] = [np.partition(distances(q, sample), k)[k] for q in _matrix(batch.column(2))]
            yield pa.record_batch([*batch.columns, pa.array(limits)], [*batch.schema.names, "most"])

    return limit


def _read(path: str, frame: Frame) -> Iterator[Queries]:
    import pyarrow.parquet as pq

    with opened(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(BLOCK, columns=["vec_id", "row", "v", "most"]):
            if batch.num_rows:
                yield Queries(batch.column(1).to_numpy(), batch.column(0).to_numpy(), _matrix(batch.column(2)), batch.column(3).to_numpy(), frame)


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[list]:
    """(ids, rows, vectors, bits, norm, match) of some CHUNK bytes of vectors."""
    held, size = [], 0
    most = max(TILE, CHUNK // (8 * dim))
    for batch in batches:
        for low in range(0, batch.num_rows, most):
            part = batch.slice(low, most)
            bits = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)), bits, part.column(4).to_numpy(), part.column(5).to_numpy()))
            size += part.num_rows
            if size >= most:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _search(shared, paths: list[str], kept: bool, dim: int, k: int) -> Callable:  # noqa: ANN001  a broadcast of a Frame
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = shared.value
        few = [block for path in paths for block in _read(path, frame)] if kept else None
        for ids, rows, vectors, bits, norm, match in _chunks(batches, dim):
            centred = frame.centred(vectors)
            for block in few if kept else (block for path in paths for block in _read(path, frame)):
                best = block.limits.copy()
                held: list[list] = [[] for _ in best]
                for low in range(0, len(ids), TILE):
                    part = slice(low, low + TILE)
                    bounds = block.lower_bounds(signs_of(bits[part], dim), norm[part], match[part])
                    with np.errstate(over="ignore", invalid="ignore"):
                        reach = np.ldexp(best, frame.scale) ** 2 * (1 + 1e-6) + 1e-12
                        near = ~(bounds > reach[:, None])  # what is not a number is looked at
                        at = np.flatnonzero(near.any(0))
                        near[:, at] &= ~(block.squares(centred[part][at], norm[part][at]) > reach[:, None])
                    for q in np.flatnonzero(near.any(1)).tolist():
                        at = low + np.flatnonzero(near[q])
                        at = at[rows[at] != block.rows[q]]
                        d = distances(block.vectors[q], vectors[at])
                        keep = d <= best[q]
                        held[q] += zip(d[keep].tolist(), ids[at[keep]].tolist(), strict=True)
                        if len(held[q]) > k:
                            held[q] = sorted(held[q])[:k]
                            best[q] = min(best[q], held[q][-1][0])
                found = [(block.rows[q], block.ids[q], v, d) for q, x in enumerate(held) for d, v in sorted(x)[:k]]
                if found:
                    r, q, v, d = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(r, pa.int64()), pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["query_row", "query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """The k nearest rows, by Euclidean distance, of every row for which ``queries`` holds.

    ``vectors`` has ``vec_id`` and an array column; other columns are only read by ``queries``.
    Candidates are all rows but the query's own row.  Returns ``query_id``, ``rank``
    (from 1), ``vec_id`` and ``score`` (the exact distance), ties to the smaller vec_id.

    Null vectors, zero vectors, vectors with null or non-finite components, vectors of another length
    than most have and rows without vec_id take no part.  With fewer than k candidates a query
    gets all of them.  Finite vectors of any magnitude take part; distances beyond
    double precision are infinite and equal.  Rows that repeat a vec_id are separate rows: each is a
    query, and a candidate of the others.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c")).where("n > 0").orderBy(F.desc("c"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, v = sizes["n"], F.col(vector).cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where(good)
    found = _candidates(marked, int(sizes["c"]), dim, k)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _candidates(rows: DataFrame, total: int, dim: int, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score): from each chunk of the rows, what may be among the k nearest."""
    drawn = rows.where(F.rand(3) < SAMPLE / max(total, 1)).select("v").limit(2 * SAMPLE).collect()  # some SAMPLE rows
    sample = np.array([r["v"] for r in drawn], float).reshape(len(drawn), dim)
    context = rows.sparkSession.sparkContext
    shared, known = context.broadcast(Frame.of_sample(sample, dim)), context.broadcast(sample)
    own = f"vec_id long, row long, v {rows.schema['v'].dataType.simpleString()}"
    numbered = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "v", "asked")
    coded = stored(numbered.mapInArrow(_coder(shared), f"{own}, asked boolean, bits binary, norm double, match double"), "ann-codes")  # fixes the row numbers
    asked = coded.where("asked").select("vec_id", "row", "v")
    n = asked.count()
    limited = asked.mapInArrow(_limiter(known, k), f"{own}, most double")
    paths = stored(limited.repartition(max(1, -(-n // BLOCK)), F.xxhash64("row")), "ann-queries").inputFiles()  # files of some BLOCK queries
    return coded.drop("asked").mapInArrow(_search(shared, paths, n * dim * 12 <= HELD, dim, k), FOUND)
