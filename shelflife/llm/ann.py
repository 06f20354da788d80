"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and fast Hadamard transforms; the nearest signed axis
is a vector's cell. A query looks, in every table, into the cells of its ``PROBES`` nearest signed axes. Every
vector is in the index. What the probed cells hold is ranked by exact cosine in double precision.

A cell meets its queries in blocks: cells of more than ``CELL_ROWS`` vectors are dealt out to several groups,
and so are cells of more than ``CELL_QUERIES`` queries, so no group grows with a hot cell. A group returns at
most ``k`` neighbours for each of its queries. Queries that found fewer than there are to find look into all cells
of one table.

Cosine is (q*d).sum() / (|q| |d|), each sum over one pair of rows alone, so equal vectors have equal scores
wherever they lie; ties go to the smaller id.

Defined cases: rows without an id, and vectors that are null, zero, or hold a null or non-finite component, take
no part; vectors meet only vectors of their dimension; a row never finds its own id; repeated rows count once;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.llm.common import written

TABLES = 8
PROBES = 16
#: More cells than a table has.
EVERY = 1 << 30
SEED = 8
CELL_ROWS = 16_384
CELL_QUERIES = 2_048
#: Scores of one matrix product held at a time.
SCORES = 1 << 22
#: More than the rounding of a matrix product of unit vectors.
MARGIN = 1e-9


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; their length is a power of two."""
    n, size, half = len(rows), rows.shape[1], 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return rows / np.sqrt(size)


def turned(rows: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Unit rows after the pseudo-rotation of a table, padded to a power of two."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), size))
    out[:, : rows.shape[1]] = rows
    signs = np.random.default_rng([seed, table, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        out = hadamard(out * s)
    return out


def nearest_axes(rows: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest signed axes of each row, the nearest first: axis k is k, its negative size + k."""
    both = np.concatenate([rows, -rows], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & some).select(
        F.col(vec_id).alias("vec_id"), v.alias("v")
    )


def _matrices(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors by dimension."""
    column = batch["v"].combine_chunks() if isinstance(batch, pa.Table) else batch["v"]
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cells(rows: DataFrame, count: int, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """(vec_id, v) with dim, table and cell: for each table the ``count`` nearest signed axes."""
    kinds = dict(rows.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for numbers, vectors in _matrices(part):
                    own, n = _unit(vectors), len(numbers)
                    for table in range(tables):
                        axes = nearest_axes(turned(own, table, seed), count)
                        taken = part.take(pa.array(np.repeat(numbers, axes.shape[1])))
                        size = n * axes.shape[1]
                        columns = [np.full(size, vectors.shape[1], np.int32), np.full(size, table, np.int32), axes.ravel().astype(np.int32)]
                        yield pa.RecordBatch.from_arrays(
                            [taken["vec_id"], taken["v"], *map(pa.array, columns)], ["vec_id", "v", "dim", "table", "cell"]
                        )

    return rows.mapInArrow(place, f"vec_id {kinds['vec_id']}, v {kinds['v']}, dim int, table int, cell int")


def _split(number: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), "vec_id"), F.lit(1 << 30))


def _within_cells(stored: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest of each part of each probed cell."""
    # How many parts each cell and its queries are dealt to: one row for each cell in use, whatever the input.
    key = ["dim", "table", "cell"]
    sizes = stored.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()
    asks = {(r["dim"], r["table"], r["cell"]): r["n"] for r in probed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [
        (*cell, -(-r["n"] // CELL_ROWS), -(-asks[cell] // CELL_QUERIES))
        for r in sizes
        if (cell := (r["dim"], r["table"], r["cell"])) in asks
    ]
    parts = F.broadcast(stored.sparkSession.createDataFrame(plan, "dim int, table int, cell int, row_parts int, query_parts int"))
    one_of = lambda column, salt: F.pmod(_split(salt), F.col(column)).cast("int")
    each_of = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    left = stored.join(parts, key).select("vec_id", "v", *key, one_of("row_parts", 1).alias("row_part"), each_of("query_parts").alias("query_part"))
    right = probed.join(parts, key).select("vec_id", "v", *key, one_of("query_parts", 2).alias("query_part"), each_of("row_parts").alias("row_part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (_, data), (_, queries) = next(_matrices(left)), next(_matrices(right))
            found = nearest(data, left["vec_id"].to_numpy(), queries, right["vec_id"].to_numpy(), k)
        columns = list(zip(*found)) or [(), (), ()]
        ids = left.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(columns[0], ids), "vec_id": pa.array(columns[1], ids), "score": pa.array(columns[2], pa.float64())})

    group = [*key, "row_part", "query_part"]
    id_type = dict(stored.dtypes)["vec_id"]
    return left.groupBy(group).cogroup(right.groupBy(group)).applyInArrow(compare, f"query_id {id_type}, vec_id {id_type}, score double")


def search(
    vectors: DataFrame, is_query: Column, vec_id="vec_id", embedding="embedding", k=5, tables=TABLES, probes=PROBES, seed=SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found to every row for which ``is_query`` holds."""
    rows = usable(vectors, vec_id, embedding)
    asked = usable(vectors.where(is_query), vec_id, embedding)
    found = written(_within_cells(cells(rows, 1, tables, seed), cells(asked, probes, tables, seed), k), "nearest")

    # A query has as many to find as there are other ids with its dimension.
    there = rows.groupBy(F.size("v").alias("dim")).agg((F.count_distinct("vec_id") - 1).alias("others"))
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count_distinct("vec_id").alias("n"))
    lacking = F.coalesce("n", F.lit(0)) < F.least(F.col("others"), F.lit(k))
    short = asked.withColumn("dim", F.size("v")).join(there, "dim").join(counts, "vec_id", "left").where(lacking)
    short = written(short.select("vec_id", "v"), "short")
    if not short.isEmpty():
        found = found.union(_within_cells(cells(rows, 1, 1, seed), cells(short, EVERY, 1, seed), k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple]:
    """(query id, id, cosine) of the ``k`` best rows of ``data`` for each query, other than its own id."""
    order = np.argsort(ids, kind="stable")
    data, ids = data[order], ids[order]
    # Equal vectors are ranked once; a query needs at most the k + 1 smallest ids of each.
    _, first, which = np.unique(data.view([("", data.dtype)] * data.shape[1]).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[members], np.arange(len(first) + 1))
    distinct = data[first]
    unit = _unit(distinct)
    norms, query_norms = (np.sqrt((x * x).sum(axis=1)) for x in (distinct, queries))
    out, step = [], max(1, SCORES // len(distinct))
    for at in range(0, len(queries), step):
        rough = _unit(queries[at : at + step]) @ unit.T
        for n, row in enumerate(rough, at):
            most = min(k + 1, len(row))
            limit = np.partition(row, len(row) - most)[len(row) - most] - MARGIN
            found = []
            near = np.flatnonzero(row >= limit)
            exact = (distinct[near] * queries[n]).sum(axis=1) / (query_norms[n] * norms[near])
            for c, score in zip(near, exact):
                own = np.unique(ids[members[begins[c] : begins[c + 1]]])[: k + 1]
                found += [(-score, i) for i in own.tolist() if i != query_ids[n]]
            out += [(query_ids[n], i, -score) for score, i in sorted(found)[:k]]
    return out
