"""Exact top-k inner products with an impact-ordered index, processed score at a time.

Rows are dealt into blocks of bounded size. In a block each dimension has a posting
list of its rows in order of their values, cut into segments. A segment's impact for a
query is the largest product, positive or negative, that its values have with the
query's component. Segments are processed by descending quantised impact: each posting
adds its exact product to its row's sum, and takes its share off what is left of the
row's and of the query's length. Segments that are not needed are never read.

What a row's sum can still change by is at most the product of the two lengths that are
left (Cauchy and Schwarz), and the rows that lead are scored exactly at each look. A
query stops in a block when that proves all rows but a part of them not to be among its
best; those rows are scored exactly.

A task takes a cell: some blocks and some packs of queries. Blocks go to the cells of
their row and queries to those of their column, so pairs of a block and a pack are not
dealt, and there are no more tasks than MOST_TASKS. In a cell a query goes from block to
block, and what it has found bounds what it looks for in the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiepoint.llm.common import bound_batches, materialise

#: Rows of a block, and queries of a pack, on average.
BLOCK, PACK = 4096, 512
#: A small table is cut into this many blocks all the same.
LEAST_BLOCKS = 12
#: Segments of a posting list.
SEGMENTS = 16
#: Steps into which the largest impact of a query is quantised.
STEPS = 64
#: Shares of a block's segments after which a query looks whether it can stop.
LOOKS = (0.08, 0.16, 0.24, 0.32, 0.4, 0.5, 0.6, 0.8)
#: A query stops when this share of the rows, or this many times k of them, are left to be scored exactly.
LEFT, LEFT_K = 0.4, 16
#: So many times k rows that lead are scored at each look.
LEADERS = 4
SCALE = 256
#: A table that is large enough is cut into about so many cells, of bounded bytes of blocks and of queries.
CELLS, CELL_BLOCKS, CELL_QUERIES = 128, 64 << 20, 32 << 20
#: Beyond, a task takes several cells, one after another.
MOST_TASKS = 4096


def _padded(rows: list[list[float]]) -> np.ndarray:
    """floor(256 x) of each component, as doubles, which hold it exactly; shorter vectors get zeros."""
    out = np.zeros((len(rows), max([len(r) for r in rows], default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.floor(SCALE * out)


def exactly(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, of any size where doubles and longs do not hold them."""
    if not len(rows) or float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2**53:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    out = np.empty(len(rows), object)
    out[:] = [sum(int(x) * y for x, y in zip(r, q, strict=True)) for r in rows]
    return out


def sortable(score: int) -> bytes:
    """Bytes in the order of the numbers."""
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + raw if score >= 0 else b"\0" + bytes(255 - b for b in raw)


class Block:
    """The index of one block: its rows, and in ``order`` each dimension's rows by value."""

    def __init__(self, rows: np.ndarray, order: np.ndarray):
        self.rows = rows
        n, d = rows.shape
        values = np.take_along_axis(rows.T, order, axis=1)
        parts = min(SEGMENTS, max(1, n))
        long = -(-n // parts)
        # segments of equal length; the last ones are filled with a row n that does not exist
        self.order = np.full((d, parts * long), n, np.int32)
        self.order[:, :n] = order
        self.order = self.order.reshape(d, parts, long)
        self.values = np.zeros((d, parts * long))
        self.values[:, :n] = values
        self.values = self.values.reshape(d, parts, long)
        self.squares = self.values**2
        self.lengths = (rows**2).sum(axis=1)
        starts = np.arange(parts) * long
        self.empty = starts >= n
        self.left, self.right = values[:, np.minimum(starts, n - 1)], values[:, np.minimum(starts + long, n) - 1]

    @staticmethod
    def order_of(rows: np.ndarray) -> np.ndarray:
        return np.argsort(rows.T, axis=1, kind="stable")

    def possible(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> np.ndarray:
        """Rows, other than ``own``, of which the k best ones for the query that score ``least`` or more are proven to be part."""
        n = len(self.rows)
        everything = np.delete(np.arange(n), own) if own >= 0 else np.arange(n)
        if n <= LEFT_K * k or not self.rows.shape[1]:
            return everything
        length = float((query**2).sum())
        longest = float(self.lengths.max())
        if not 0 < length * longest < 1e300:
            return everything
        impact = np.abs(query)[:, None] * np.maximum(np.abs(self.left), np.abs(self.right))
        level = np.ceil(impact / max(float(impact.max()), 1e-300) * STEPS)
        level[:, self.empty] = -1
        turn = np.argsort(-level, axis=None, kind="stable")
        dims, parts = np.divmod(turn, impact.shape[1])
        sums, taken, asked = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
        error = 1e-12 * (length * longest) ** 0.5
        at = 0
        for share in LOOKS:
            to = int(share * len(turn))
            if to <= at:
                continue
            x, y = dims[at:to], parts[at:to]
            who = self.order[x, y].ravel()
            sums += np.bincount(who, (self.values[x, y] * query[x, None]).ravel(), n + 1)
            taken += np.bincount(who, self.squares[x, y].ravel(), n + 1)
            asked += np.bincount(who, np.repeat(query[x] ** 2, self.order.shape[2]), n + 1)
            at = to
            rest = np.maximum(self.lengths - taken[:n], 0) + 1e-12 * longest
            bound = sums[:n] + np.sqrt(rest * (np.maximum(length - asked[:n], 0) + 1e-12 * length))
            if own >= 0:
                bound[own] = -np.inf
            # the k-th best score is at least that of the k-th best among the rows that lead
            leaders = np.argpartition(bound, n - LEADERS * k)[n - LEADERS * k :]
            kth = np.sort(self.rows[leaders] @ query)[(LEADERS - 1) * k]
            left = bound >= max(kth, least) - error
            if np.count_nonzero(left) <= max(LEFT * n, LEFT_K * k):
                return np.nonzero(left)[0]
        return everything

    def search(self, keys: np.ndarray, own: int, query: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """``(score, position)`` of the k best rows that score ``least`` or more, and perhaps others; ``keys`` are ranks that settle ties."""
        at = self.possible(query, own, k, least)
        found = exactly(self.rows[at], query)
        if len(at) > k:
            best = found >= np.sort(found)[-k]
            at, found = at[best], found[best]
        return sorted(zip(found.tolist(), at.tolist(), strict=True), key=lambda x: (-x[0], keys[x[1]]))[:k]


def _narrow(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them all."""
    most = float(np.abs(whole).max(initial=0))
    return whole.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _gather(rows: DataFrame, blocks: int, name: str, index: bool) -> DataFrame:
    """The rows of a block as one row of bytes, with the index where asked for."""

    def gather(table: pa.Table) -> pa.Table:
        found = _padded(table.column("v").to_pylist())
        small = _narrow(found)
        data = {name: pa.array([table.column(name)[0].as_py()], pa.int32()), "rows": pa.array([table.column("row").to_pylist()], pa.list_(pa.int64())), "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), "dims": pa.array([found.shape[1]], pa.int32()), "kind": pa.array([small.dtype.str]), "data": pa.array([small.tobytes()], pa.binary())}
        if index:
            data["lists"] = pa.array([Block.order_of(found).astype(_places(len(found))).tobytes()], pa.binary())
        return pa.table(data)

    keyed = rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return keyed.groupBy(name).applyInArrow(gather, f"{name} int, rows array<long>, ids array<long>, dims int, kind string, data binary" + ", lists binary" * index)


def _places(n: int) -> type:
    """The type of places among n rows."""
    return np.uint16 if n <= 2**16 else np.int32


def _cells(blocks: int, packs: int, dims: int) -> tuple[int, int]:
    """Rows and columns of cells: about CELLS of them, or as many as keep a cell within its bytes."""
    by_row = min(-(-blocks // CELLS), max(1, CELL_BLOCKS // (BLOCK * max(1, dims) * 10)))
    down = -(-blocks // by_row)
    by_column = min(-(-packs * down // CELLS), max(1, CELL_QUERIES // (PACK * max(1, dims) * 8)))
    return down, -(-packs // by_column)


def _matrix(r: dict) -> np.ndarray:
    return np.frombuffer(r["data"], r["kind"]).reshape(len(r["rows"]), r["dims"])


def _least(best: list[tuple], k: int) -> float:
    """What a row must score to be among the k best."""
    return float(max(-(10**300), min(10**300, -best[k - 1][0]))) if len(best) == k else -np.inf


def _searched(blocks: pa.Table, packs: pa.Table, k: int) -> pa.Table:
    """The k best rows of a cell's blocks for each query of its packs."""
    queries = [{n: packs.column(n)[i].as_py() for n in ("rows", "ids", "dims", "kind", "data")} for i in range(packs.num_rows)]
    best: list[list[list[tuple]]] = [[[] for _ in q["rows"]] for q in queries]
    for i in range(blocks.num_rows if queries else 0):
        r = {n: blocks.column(n)[i].as_py() for n in ("rows", "ids", "dims", "kind", "data", "lists")}
        x = _matrix(r).astype(np.float64)
        lists = np.frombuffer(r["lists"], _places(len(x))).reshape(x.shape[::-1])
        place = {row: at for at, row in enumerate(r["rows"])}
        keys = [(y is None, y or 0, row) for y, row in zip(r["ids"], r["rows"], strict=True)]
        block = None
        for q, found in zip(queries, best, strict=True):
            # a component beyond the other side's width meets zeros
            d = min(r["dims"], q["dims"])
            if block is None or block.rows.shape[1] != d:
                block = Block(np.ascontiguousarray(x[:, :d]), lists[:d])
            for n, (row, query) in enumerate(zip(q["rows"], _matrix(q)[:, :d].astype(np.float64), strict=True)):
                new = block.search(keys, place.get(row, -1), query, k, _least(found[n], k))
                found[n] = sorted([*found[n], *((-score, keys[at], r["ids"][at]) for score, at in new)])[:k]
    out = [(row, vec_id, key[2], found_id, max(-(1 << 63), min((1 << 63) - 1, -score)), sortable(-score)) for q, found in zip(queries, best, strict=True) for row, vec_id, b in zip(q["rows"], q["ids"], found, strict=True) for score, key, found_id in b]
    cols = list(zip(*out, strict=True)) or [()] * 6
    return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["query_row", "query_id", "row", "vec_id", "score", "key"])


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query`` holds, its k best other rows.

    Only the query's own row is left out: rows with a repeated id are candidates and
    queries of their own, and so are rows without id. Ties go to the smaller id, null
    last, then to the earlier row. Vectors that are null or hold a null, NaN or infinite
    component (or one whose 256-fold is infinite) take no part. Shorter vectors count as
    padded with zeros. Scores are exact whole numbers; one beyond the range of a long is
    given as the nearest long, at its true rank. An empty table, or one without queries,
    gives no rows.
    """
    bound_batches(vectors.sparkSession)
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(SCALE * x) == F.lit(float("inf"))))
    rows = materialise(named.where(F.col("v").isNotNull() & ~bad).withColumn("row", F.monotonically_increasing_id()))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("dims")).first()
    blocks, packs = max(LEAST_BLOCKS, -(-counts["n"] // BLOCK)), max(1, -(-counts["q"] // PACK))
    down, across = _cells(blocks, packs, counts["dims"] or 0)
    # a block goes to all cells of its row and a pack to all of its column, of which there are few; neither side of a cogroup is broadcast
    placed = lambda df, row, column: df.withColumn("cell", (row * across + column).cast("int")).repartition(min(down * across, MOST_TASKS), "cell").groupBy("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexed = _gather(rows.select("row", "vec_id", "v"), blocks, "block", True).withColumn("column", every(across))
    asked = _gather(rows.where("asks").select("row", "vec_id", "v"), packs, "pack", False).withColumn("place", every(down))
    met = placed(indexed, F.col("block") % down, F.col("column")).cogroup(placed(asked, F.col("place"), F.col("pack") % across))
    found = met.applyInArrow(lambda x, y: _searched(x, y, k), "query_row long, query_id long, row long, vec_id long, score long, key binary")
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("key"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 5, every: int = 50) -> str:
    """The same over ``embeddings`` in DuckDB's SQL."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""
