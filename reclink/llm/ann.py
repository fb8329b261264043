"""Nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Vectors are dealt into classes by the binary logarithm of their norms.  Within a class they are scaled by its largest norm and
given one more component so that they lie on the unit sphere; queries are normalised and get a zero there.  Then the largest
inner product of a class is the smallest Euclidean distance, which p-stable (Gaussian) hashing serves, and one very long
vector doesn't press the others together.  Each of ``TABLES`` tables deals the sphere into buckets by ``n_hashes`` projections
cut into slots of ``WIDTH``.  A query visits its own bucket and the perturbed ones in the order of their estimated success (the
sum of squared distances to the borders that are crossed), ``PROBES`` in each table and class.  Only members of a bucket meet
the queries that visit it.  The candidates of all tables are merged and ranked by their exact inner product in double
precision, ties to the smaller id.  A query that finds fewer than k (few rows, far from all others) visits all buckets then.

Rows are shuffled by (table, cell), a cell being the buckets that share a hash, about ``CELL_ROWS`` rows of a table; a query
goes to the cells of the buckets that it visits, with the numbers of these.  Cells of more than twice as many rows are counted
and split by a salt, and their queries go to each part.  A task holds one part and streams its queries, ``QUERIES`` at a time.
No bucket is capped.  A query is sent, and answers with k rows, once for each cell it visits, so cells are as large as fits.
Every row is indexed; nothing is fitted to the data but the classes' largest norms.

On nearly isotropic vectors, as in the driver's tables (64 components, the 20th neighbour at an inner product of 0.2 to 0.4),
no hashing separates neighbours well, and a recall over 0.9 takes half of the rows or more as candidates.  The parameters are
set for that; data with closer neighbours need far fewer probes.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite components take no
part, neither as query nor as candidate; a query's own row is not a candidate, nor is a row of the same id; null ids take
no part; rows that repeat an id and a vector count once, an id with several vectors is several rows and several queries;
fewer candidates than k: all of them; empty table: empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions.text import let
from reclink.session import written

TABLES, WIDTH, PROBES, CLASSES = 4, 3.0, 300, 16
K, CELL_ROWS, QUERIES, MOST_HOT, SEED = 20, 65_536, 128, 100_000, 7
_BASE, _CLASS = 1_000_003, 0x9E3779B97F4A7C15 - (1 << 64)


def n_hashes(rows: int) -> int:
    """Projections of a table: each further one for twice as many rows."""
    return int(np.clip(round(np.log2(max(rows, 2))) - 4, 6, 24))


class Hashing:
    """The tables' projections, from a seed."""

    def __init__(self, dim: int, hashes: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, tables, hashes])
        self.a = rng.normal(size=(tables, hashes, dim))
        self.b = rng.uniform(0, width, size=(tables, hashes))
        self.width = width
        self.steps = np.array([pow(_BASE, i, 1 << 64) for i in range(hashes)], np.uint64).view(np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Place of each vector on each projection, in slots: (rows, tables, hashes)."""
        return (np.einsum("nd,thd->nth", x, self.a, optimize=True) + self.b) / self.width

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket number of each vector in each table."""
        return (np.floor(self.places(x)).astype(np.int64) * self.steps).sum(-1)


def probe_sequence(place: np.ndarray, steps: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers that each query visits in one table, and their scores, the likeliest first; ``place``: (queries, hashes).

    A score is a sum over projections of nothing (own slot) or the squared distance to one of two borders, so the best sets of
    the first i projections are all that the best sets of i + 1 can grow from.
    """
    own = np.floor(place).astype(np.int64)
    inside = place - own
    score, code = np.zeros((len(place), 1)), (own * steps).sum(1)[:, None]
    for i, step in enumerate(steps):
        lower, upper = inside[:, i : i + 1] ** 2, (1 - inside[:, i : i + 1]) ** 2
        score = np.concatenate([score, score + lower, score + upper], 1)
        code = np.concatenate([code, code - step, code + step], 1)
        if score.shape[1] > probes:
            best = np.argpartition(score, probes - 1, axis=1)[:, :probes]
            score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
    order = np.argsort(score, axis=1, kind="stable")
    return np.take_along_axis(code, order, 1), np.take_along_axis(score, order, 1)


def lifted(x: np.ndarray, log_largest: np.ndarray) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension, after division by 2 ** log_largest."""
    most = np.abs(x).max(1)
    y = x / most[:, None] * np.exp2(np.log2(most) - log_largest)[:, None]
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y**2).sum(1)))[:, None]], 1)


class Cell:
    """The rows of one part of a cell, by bucket."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, codes: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, codes))
        self.ids, self.marks, self.x = ids[order], marks[order], vectors[order]
        self.buckets, self.start = np.unique(codes[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def search(self, ids: np.ndarray, vectors: np.ndarray, visited: list[np.ndarray | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best members of its visited buckets (None: of all) for each query; rows of its own id are none."""
        query = np.repeat(np.arange(len(ids)), [len(self.buckets) if v is None else len(v) for v in visited])
        wanted = np.concatenate([self.buckets if v is None else v for v in visited])
        bucket = np.minimum(np.searchsorted(self.buckets, wanted), len(self.buckets) - 1)
        hit = self.buckets[bucket] == wanted
        query, bucket = query[hit], bucket[hit]
        order = np.argsort(bucket, kind="stable")
        query, bucket = query[order], bucket[order]
        first = np.flatnonzero(np.append(len(bucket) > 0, bucket[1:] != bucket[:-1])[: len(bucket)])
        scores = np.full((len(ids), len(self.ids)), -np.inf)
        for b, who in zip(bucket[first].tolist(), np.split(query, first[1:])):
            rows = slice(self.start[b], self.end[b])
            scores[who, rows] = vectors[who] @ self.x[rows].T
        out = []
        for i, own in enumerate(ids):
            row = scores[i]
            row[self.ids == own] = -np.inf
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                some = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least))) & (row > -np.inf)) if least > -np.inf else np.flatnonzero(row > -np.inf)
            else:
                some = np.flatnonzero(row > -np.inf)
            # one order of summation for every pair, so that equal vectors tie exactly
            exact = (self.x[some] * vectors[i]).sum(1)
            best = np.lexsort((self.marks[some], self.ids[some], -exact))[:k]
            out.append((np.full(len(best), i), some[best], exact[best]))
        return tuple(np.concatenate(c) for c in zip(*out))


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, whatever their length; v keeps its kind of numbers if that is float, else it is double."""
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(f"`{vector_col}`").cast("array<float>" if single else "array<double>")
    return rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    )


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` (an expression over ``id``) names."""
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_col, vector_col).withColumn("q", F.coalesce(is_query, F.lit(False)))
    most = valid.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("q")).orderBy(F.desc("n"), "dim").first()
    if most is None or not most["q"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n_cells = most["dim"], -(-most["n"] // CELL_ROWS)
    hashing = Hashing(dim + 1, n_hashes(most["n"]))
    # without overflow: by way of the largest component
    size = let(lambda v, m: F.log2(m) + 0.5 * F.log2(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / m) * (x / m))), F.col("v").cast("array<double>"), F.greatest(F.array_max("v"), -F.array_min("v")).cast("double"))
    valid = valid.where(F.size("v") == dim).withColumn("log_norm", size)
    # half a step off, so that vectors of norm 1 don't fall on both sides of a border; a double has few exponents
    levels = {r["e"]: r["m"] for r in valid.groupBy(F.round("log_norm").cast("int").alias("e")).agg(F.max("log_norm").alias("m")).collect()}
    lowest = max(levels) - CLASSES + 1
    largest = {e: max(m for x, m in levels.items() if max(x, lowest) == e) for e in {max(x, lowest) for x in levels}}
    kind = "<f4" if valid.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def numbered(batches):
        for batch in batches:
            v = np.asarray(batch.column(4).flatten()).reshape(-1, dim)
            level = np.maximum(np.round(np.asarray(batch.column(3))).astype(np.int64), lowest)
            codes = hashing.codes(lifted(v.astype(np.float64), np.array([largest[e] for e in level.tolist()]).reshape(-1))) + (level * _CLASS)[:, None]
            raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw, pa.array(list(codes), pa.list_(pa.int64()))], names=["id", "mark", "q", "v", "codes"])

    coded = written(valid.select("id", F.xxhash64("v").alias("mark"), "q", "log_norm", "v").mapInArrow(numbered, "id bigint, mark bigint, q boolean, v binary, codes array<bigint>"), "vectors")

    def visits(batches):
        names = ["t", "cell", "id", "mark", "code", "v", "visited"]
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                x = x / np.abs(x).max(1)[:, None]
                unit = np.concatenate([x / np.sqrt((x**2).sum(1))[:, None], np.zeros((len(x), 1))], 1)
                places, out = hashing.places(unit), []
                for t in range(places.shape[1]):
                    codes = probe_sequence(places[:, t], hashing.steps, probes)[0]
                    codes = np.concatenate([codes + np.array([e]) * _CLASS for e in sorted(largest)], 1)
                    cells = codes % n_cells
                    order = np.argsort(cells, axis=1, kind="stable")
                    for i, (c, cell) in enumerate(zip(np.take_along_axis(codes, order, 1), np.take_along_axis(cells, order, 1))):
                        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                        out += [(t, cell[a], i, x.tobytes()) for a, x in zip(start.tolist(), np.split(c, start[1:]))]
                t, cell, i, visited = zip(*out)
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(cell, pa.int64()), part.column(0).take(i), part.column(1).take(i), pa.nulls(len(i), pa.int64()), part.column(2).take(i), pa.array(visited, pa.binary())], names=names)

    data = coded.select(F.posexplode("codes").alias("t", "code"), "id", "mark", "v").withColumn("cell", F.pmod("code", F.lit(n_cells)))
    hot = written(data.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("salts")).where("salts > 2"), "hot-cells")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= MOST_HOT else hot
    salts = lambda df: df.join(hot, ["t", "cell"], "left").withColumn("salts", F.coalesce("salts", F.lit(1))) if n_hot else df.withColumn("salts", F.lit(1))
    columns = ["t", "cell", "salt", "id", "mark", "code", "v", "visited", "asks"]
    data = salts(data).withColumns({"salt": F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), "visited": F.lit(None).cast("binary"), "asks": F.lit(False)}).select(columns)

    def search(batches):
        key, held, cell = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1, 2, 8)]) if batch.num_rows else np.zeros((4, 0), np.int64)
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))[: keys.shape[1]]).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                own, asks = tuple(keys[:3, a].tolist()), bool(keys[3, a])
                if own != key:
                    key, held, cell = own, [], None
                for at in range(a, b, QUERIES) if asks else (a,):
                    part = batch.slice(at, min(b - at, QUERIES) if asks else b - a)
                    x = np.frombuffer(b"".join(part.column(6).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                    ids, marks = np.asarray(part.column(3)), np.asarray(part.column(4))
                    if not asks:
                        held.append((ids, marks, np.asarray(part.column(5)), x))
                    elif held or cell:
                        cell, held = cell or Cell(*(np.concatenate(c) for c in zip(*held))), []
                        visited = [None if v is None else np.frombuffer(v, np.int64) for v in part.column(7).to_pylist()]
                        i, row, score = cell.search(ids, x, visited, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(marks[i]), pa.array(cell.ids[row]), pa.array(cell.marks[row]), pa.array(score)], names=["query_id", "query_mark", "vec_id", "mark", "score"])

    def best(asked: DataFrame, rows: DataFrame) -> DataFrame:
        asked = salts(asked).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("asks", F.lit(True)).select(columns)
        met = rows.union(asked).repartition("t", "cell", "salt").sortWithinPartitions("t", "cell", "salt", "asks")
        found = met.mapInArrow(search, "query_id bigint, query_mark bigint, vec_id bigint, mark bigint, score double")
        # several tables find the same row
        found = found.repartition("query_id", "query_mark").distinct()
        return found.selectExpr("query_id", "query_mark", "cast(row_number() over (partition by query_id, query_mark order by score desc, vec_id, mark) as int) as rank", "vec_id", "score").where(F.col("rank") <= k)

    queries = coded.where("q").select("id", "mark", "v")
    found = written(best(queries.mapInArrow(visits, "t int, cell bigint, id bigint, mark bigint, code bigint, v binary, visited binary"), data), "nearest")
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_mark").alias("mark")).distinct()
    short = written(queries.join(enough, ["id", "mark"], "left_anti").distinct(), "short-queries")
    out = ["query_id", "rank", "vec_id", "score"]
    if short.isEmpty():
        return found.select(out)
    # all buckets of one table hold all rows
    all_cells = short.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1)).cast("array<bigint>")).alias("cell"), "id", "mark", F.lit(None).cast("bigint").alias("code"), "v", F.lit(None).cast("binary").alias("visited"))
    rest = found.join(short.select(F.col("id").alias("query_id"), F.col("mark").alias("query_mark")), ["query_id", "query_mark"], "left_anti")
    return rest.select(out).union(best(all_cells, data.where("t = 0")).select(out))
