"""Exact top-k inner products over norm-sorted vectors.

Vectors are turned to the singular directions of the whole table, so that a few leading
parts hold most of an inner product, and sorted by descending length. Queries meet them in
that order: by Cauchy-Schwarz no later vector can reach more than the product of lengths,
and after each group of directions none can reach more than its partial sum plus the
product of the residual lengths. What might still be among the best k is scored exactly,
in integers.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablesense.llm.common import broadcast_value, stored
from tablesense.operators.indexing import dense_index

#: Queries sent to all tasks at once; more queries take more passes over the vectors.
PASS = 16384
#: Queries and vectors whose products are held at once in a task.
QUERIES, VECTORS = 1024, 2048
#: Pairs scored exactly at once.
PAIRS = 1 << 16
#: The longest vectors, which give every query a first floor; also bounds what is sent.
LONGEST = 1024
#: Leading directions summed before each residual bound.
CUTS = (8, 24)
#: Components are multiplied by this and rounded down.
SCALE = 256


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * component) as longs.

    Vectors that are null or hold a null or non-finite component are left out, as are
    vectors without an id.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(
            x.cast("double") * float(scale)).cast("long")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of longs; vectors shorter than `width` are filled up with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, :len(v)] = v
    return out


def directions(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows, by descending singular value.

    Tasks add up width * width products; only those sums reach the driver.
    """
    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({
            "at": pa.array(range(width * width), pa.int32()), "x": pa.array(total.ravel())})

    sums = rows.select("v").mapInArrow(products, "at int, x double").groupBy("at").agg(
        F.sum("x").alias("x")).collect()
    gram = np.zeros(width * width)
    for r in sums:
        gram[r["at"]] = r["x"]
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products of long vectors; in doubles where those are exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if largest * a.shape[-1] < 2 ** 53:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    return np.einsum("ij,ij->i", a, b)


class Found:
    """The k best (score, id) so far of each query, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, dtype=np.int64)
        self.ids, self.scores = self.query.copy(), self.query.copy()
        self.floors = np.full(queries, -np.inf)

    def add(self, query, ids, scores):
        """Merge more scored rows; a floor is the k-th best score that is known."""
        query = np.concatenate([self.query, query])
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]
        full = place == self.k - 1
        self.floors[query[full]] = np.maximum(self.floors[query[full]], scores[full])


def _residuals(turned: np.ndarray) -> np.ndarray:
    """Lengths of what is left of each row from each direction on, none at the end."""
    squares = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(turned), 1))], axis=1))


def search(found: Found, queries, query_ids, rows, row_ids, turn: np.ndarray) -> None:
    """Add the rows that may be among a query's best; rows come by descending length."""
    q_turned, r_turned = queries @ turn, rows @ turn
    q_rest, r_rest = _residuals(q_turned), _residuals(r_turned)
    width = rows.shape[1]
    for q0 in range(0, len(queries), QUERIES):
        some = slice(q0, q0 + QUERIES)
        q, rest = q_turned[some], q_rest[some]
        # Sums of doubles may be a little off: no bound is trusted closer than this.
        floors = found.floors[some]
        floors = floors - 1e-9 * (np.abs(floors) + rest[:, 0] * r_rest[0, 0]) - 1
        floors = np.where(np.isnan(floors), -np.inf, floors)
        reach = (rest[:, :1] * r_rest[None, :, 0] >= floors[:, None]).any(0)
        last = int(np.flatnonzero(reach)[-1]) + 1 if reach.any() else 0
        partial, done, alive = np.zeros((len(q), last)), 0, None
        for cut in (*[c for c in CUTS if c < width], width):
            if alive is None:
                partial += q[:, done:cut] @ r_turned[:last, done:cut].T
                if cut == width and last >= found.k:
                    # k rows reach this, none of the query's own id, so no lower one matters.
                    partial[query_ids[some][:, None] == row_ids[None, :last]] = -np.inf
                    reached = np.partition(partial, last - found.k, axis=1)[:, -found.k]
                    slack = 1e-9 * (np.abs(reached) + rest[:, 0] * r_rest[0, 0]) + 1
                    floors = np.maximum(floors, reached - slack)
                stay = partial + rest[:, cut, None] * r_rest[None, :last, cut] >= floors[:, None]
                if cut == width or stay.mean() < 0.05:
                    alive = np.nonzero(stay)
                    partial = partial[alive]
            else:
                i, j = alive
                partial = partial + np.einsum("nd,nd->n", q[i, done:cut], r_turned[j, done:cut])
                stay = partial + rest[i, cut] * r_rest[j, cut] >= floors[i]
                alive, partial = (i[stay], j[stay]), partial[stay]
            done = cut
        i, j = alive
        other = query_ids[some][i] != row_ids[j]
        i, j = i[other], j[other]
        for at in range(0, len(i), PAIRS):
            some_i, some_j = q0 + i[at:at + PAIRS], j[at:at + PAIRS]
            found.add(some_i, row_ids[some_j], _exact(queries[some_i], rows[some_j]))


def _best_of_vectors(sent, width: int, k: int):
    """Each task's k best vectors of every query of a pass."""
    def run(batches):
        query_ids, queries, seed_ids, seeds, turn = sent.value
        first = Found(len(queries), k)
        search(first, queries, query_ids, seeds, seed_ids, turn)
        found = Found(len(queries), k)
        found.floors = first.floors.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                search(found, queries, query_ids, _matrix(part.column("v"), width),
                       part.column("vec_id").to_numpy(), turn)
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(query_ids[found.query], pa.int64()),
            "vec_id": pa.array(found.ids, pa.int64()),
            "score": pa.array(found.scores, pa.int64())})
    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Queries are rows whose vec_id is divisible by `every`; candidates are all rows but
    those of the query's own id. Components count as floor(256 * x); the score is the
    integer inner product, ties go to the smaller vec_id. A query has fewer rows if there
    are fewer candidates. Null vectors, vectors with null or non-finite components, and
    null ids take no part; shorter vectors count as filled up with zeros. Repeated
    candidate rows each count, a repeated query row is one query. An empty table gives an
    empty result. Other columns are ignored.

    Every pass sends PASS queries to all tasks and reads the sorted vectors once; a task
    returns k rows per query at most, and vectors are never shuffled for a query.
    """
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    rows = stored(whole_vectors(vectors).withColumn("less", -square).repartitionByRange(
        "less", "vec_id").sortWithinPartitions("less", "vec_id"), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    turn = directions(rows, width)
    # First how long the longest are, from one number a row; then only those rows.
    least = [r[0] for r in rows.select("less").orderBy("less").limit(LONGEST).tail(1)]
    seeds = rows.where(F.col("less") <= F.lit(least[0] if least else 0.0)).orderBy(
        "less", "vec_id").limit(LONGEST).select("vec_id", "v").toArrow()
    seeds = (seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v"), width))
    asked = dense_index(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct(),
                        ["vec_id"], name="place")
    passes = -(-asked.count() // PASS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for number in range(max(1, passes)):
        own = asked.where(F.floor(F.col("place") / PASS) == number).select("vec_id", "v").toArrow()
        sent = broadcast_value(rows, (own.column("vec_id").to_numpy(),
                                      _matrix(own.column("v"), width), *seeds, turn))
        found = rows.select("vec_id", "v").mapInArrow(
            _best_of_vectors(sent, width, k), "query_id long, vec_id long, score long")
        out = found if out is None else out.union(found)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
