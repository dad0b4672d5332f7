"""Approximate nearest neighbours by inner product, over balanced posting lists.

Vectors get one more component that makes all of them equally long, so that the largest inner product is the smallest
distance. A bounded sample is halved again and again at the middle of its two means' difference, which gives equally large cells;
the cells' means are the centroids. A graph over the centroids, held in every task's memory, is searched for a vector's
nearest ones: the vector goes to the list of the nearest and, near a boundary, to those of up to `copies` whose distance is at
most `boundary` times as large. A query reads every list whose centroid is at most `probe` times as far as its nearest; how
many lists that makes isn't limited. Where the lists read hold fewer vectors than asked for, the next ones are read too.

Lists that lie next to each other in the tree form groups, so that a query is sent once a group and not once a list. A group of many
vectors is dealt in blocks, as are its queries, and each cell of two blocks is one task's step; candidates are scored in double
precision, in the order of the components, and a task keeps the best of each query.

Equal vectors are one class, searched once, of which the `most + 1` smallest ids can be anyone's result: more could never
be. So a third of all rows may be one vector.

Vectors that are null or zero or hold null or non-finite components take no part, nor do rows with a null vec_id. Rows that repeat count once; of
different vectors with one vec_id the smallest counts. Components that a shorter vector lacks count as zero. Ties go to the smaller vec_id. Other columns,
whatever their names, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MOST = 20
EVERY = 20
#: Vectors that a list should have, besides copies.
LIST = 100
#: The graph of this many centroids is a broadcast of some 5 MB at 64 components; more vectors make longer lists.
MOST_LISTS = 16_384
#: The sample that centroids are fitted on.
FIT_ROWS, FIT_BYTES = 65_536, 64 << 20
BOUNDARY, COPIES = 1.02, 4
PROBE = 1.16
#: How far beyond what is asked for the walk over the graph goes on.
WALK = 1.05
LINKS, SEEDS = 16, 32
#: Lists in a group; vectors and queries in a block; candidates that a task holds.
GROUP, BLOCK, HELD = 8, 2_000, 500_000


def matrix(column: pa.Array, size: int = 0) -> np.ndarray:
    """The vectors of a list column as rows of doubles, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), max(size, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Space:
    """size: components; scale: the largest component; longest: the largest length of a vector, after division by scale."""

    size: int
    scale: float
    longest: float

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32)

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return np.concatenate([x * (self.longest / np.maximum(length, 1e-300)), np.zeros((len(x), 1))], 1).astype(np.float32)


def halved(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of `cells` (a power of two) cells with equally many rows of x, in the order of the tree."""
    rng, parts = np.random.default_rng(1), [np.arange(len(x))]
    while len(parts) < cells:
        halves = []
        for ids in parts:
            own, (a, b) = x[ids], x[ids[rng.choice(len(ids), 2, replace=False)]]
            for _ in range(6):
                order = np.argsort(own @ (b - a), kind="stable")
                low, high = order[: len(ids) // 2], order[len(ids) // 2 :]
                a, b = own[low].mean(0), own[high].mean(0)
            halves += [ids[low], ids[high]]
        parts = halves
    return np.array([x[ids].mean(0) for ids in parts], np.float32)


class Graph:
    """Centroids, each linked to its nearest ones and to its neighbours in the tree."""

    def __init__(self, centroids: np.ndarray, links: int = LINKS, seeds: int = SEEDS) -> None:
        self.centroids, n = centroids, len(centroids)
        self.lengths = (centroids * centroids).sum(1)
        near = []
        for low in range(0, n, 1024):
            apart = self.lengths - 2 * centroids[low : low + 1024] @ centroids.T
            most = min(links + 1, n)
            near.append(np.argpartition(apart, most - 1, axis=1)[:, :most])
        at = np.arange(n)
        self.links = np.concatenate([*[np.concatenate(near)], *[((at + step) % n)[:, None] for step in (1, -1)]], 1).astype(np.int32)
        self.seeds = np.unique(np.linspace(0, n - 1, min(seeds, n)).astype(np.int64))

    def search(self, x: np.ndarray, ratio: float, walk: float = WALK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance) of the centroids found at most `ratio` times as far as a row's nearest; by row, nearest first.

        All rows walk together: in each step every row opens what it has seen, not opened, and what lies within `ratio * walk` of its best.
        """
        n = len(self.centroids)
        apart = np.full((len(x), n), np.inf, np.float32)
        opened = np.zeros(apart.shape, bool)
        own = (x * x).sum(1)
        apart[:, self.seeds] = np.sqrt(np.maximum(0, own[:, None] + self.lengths[self.seeds] - 2 * x @ self.centroids[self.seeds].T))
        bound = ratio * walk
        while True:
            rows, cells = np.nonzero((apart <= bound * apart.min(1, keepdims=True)) & ~opened)
            if not len(rows):
                break
            opened[rows, cells] = True
            seen = np.zeros(apart.shape, bool)
            seen[np.repeat(rows, self.links.shape[1]), self.links[cells].ravel()] = True
            rows, cells = np.nonzero(seen & np.isinf(apart))
            for low in range(0, len(rows), 1 << 16):
                r, c = rows[low : low + (1 << 16)], cells[low : low + (1 << 16)]
                apart[r, c] = np.sqrt(np.maximum(0, own[r] + self.lengths[c] - 2 * np.einsum("ij,ij->i", x[r], self.centroids[c])))
        rows, cells = np.nonzero(apart <= ratio * apart.min(1, keepdims=True))
        order = np.lexsort((cells, apart[rows, cells], rows))
        return rows[order], cells[order], apart[rows, cells][order]


def _valid(vectors: DataFrame) -> DataFrame:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("embedding").isNotNull() & F.coalesce(~F.exists("embedding", odd), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & good)


def classes(rows: DataFrame, most: int) -> DataFrame:
    """embedding, cls (smallest id) and ids (the most + 1 smallest) of every distinct vector of rows(vec_id, embedding). A written table."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most + 1)
    ids = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return common.settle(ids.select("embedding", F.col("ids")[0].alias("cls"), "ids"), "vectors")


def fit(table: DataFrame, per_list: int = LIST, most_lists: int = MOST_LISTS, fit_rows: int = FIT_ROWS) -> tuple[Space, Graph] | None:
    """The space of classes(embedding, cls) and the graph of its centroids."""
    size, scale, n = table.agg(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x)))), F.count("*")).first()
    if not n:
        return None
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / float(scale)) * (x.cast("double") / float(scale))))
    space = Space(size, float(scale), table.agg(F.max(length)).first()[0])
    take = min(fit_rows, max(1, FIT_BYTES // (8 * size)))
    sample = matrix(table.orderBy(F.xxhash64("cls"), "cls").select("embedding").limit(take).toArrow().column(0).combine_chunks(), size)
    x = space.vectors(sample)
    cells = 1
    while 2 * cells * per_list <= n and 2 * cells <= most_lists and 4 * cells <= len(x):
        cells *= 2
    return space, Graph(halved(x, cells))


def posted(table: DataFrame, index, boundary: float = BOUNDARY, copies: int = COPIES) -> DataFrame:
    """list, first (whether it is the nearest), cls, ids and embedding: classes in their lists. A written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, graph = index.value
        for batch in _cut(batches, len(graph.centroids)):
            rows, cells, _ = graph.search(space.vectors(matrix(batch.column(2), space.size)), boundary)
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cells, first = rows[nth < copies], cells[nth < copies], nth[nth < copies] == 0
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(first), *taken.columns], names=["list", "first", *taken.schema.names])

    kind = table.schema["embedding"].dataType.simpleString()
    return common.settle(common.in_arrow(table.select("cls", "ids", "embedding"), work, f"list int, first boolean, cls long, ids array<long>, embedding {kind}"), "posted")


def _cut(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    step = max(1, (16 << 20) // max(1, cells))  # a search holds a few tables of rows x centroids
    for batch in batches:
        for low in range(0, len(batch), step):
            yield batch.slice(low, step)


def probed(asked: DataFrame, index, held: dict[int, int], least: int, probe: float = PROBE) -> DataFrame:
    """team, cls, embedding and lists: a row for each group of lists that a query reads. held: vectors of each list, copies left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, graph = index.value
        n = np.array([held.get(k, 0) for k in range(len(graph.centroids))])
        for batch in _cut(batches, len(graph.centroids)):
            x = space.queries(matrix(batch.column(1), space.size))
            rows, cells, _ = graph.search(x, probe)
            few = np.flatnonzero(np.bincount(rows, n[cells], minlength=len(x)) < least)
            if len(few):  # all lists by distance, as many as it takes
                order = np.argsort(graph.lengths - 2 * x[few] @ graph.centroids.T, axis=1, kind="stable")
                short = np.cumsum(n[order], 1) - n[order] < least
                more = np.concatenate([np.stack([np.repeat(few, short.sum(1)), order[short]], 1), np.stack([rows, cells], 1)])
                rows, cells = np.unique(more, axis=0).T
            order = np.lexsort((cells, rows))
            rows, cells = rows[order], cells[order]
            new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (cells[1:] // GROUP != cells[:-1] // GROUP)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(rows)).astype(np.int32)), pa.array(cells.astype(np.int32)))
            taken = batch.take(pa.array(rows[new]))
            yield pa.RecordBatch.from_arrays([pa.array((cells[new] // GROUP).astype(np.int32)), *taken.columns, lists], names=["team", "cls", "embedding", "lists"])

    kind = asked.schema["embedding"].dataType.simpleString()
    return common.settle(common.in_arrow(asked.select("cls", "embedding"), work, f"team int, cls long, embedding {kind}, lists array<int>"), "probed")


def in_order(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, component by component: equal vectors give equal sums, wherever they stand."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * v[:, k]
    return total


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's `most` best: largest score first, then smallest id, each id once."""
    order = np.lexsort((ids, -score, query))
    q, s, i = query[order], score[order], ids[order]
    order = order[np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]))] if len(order) else order
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < most]


def _cell(rows: list[pa.RecordBatch], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id): the best candidates of a cell's queries among the vectors of the lists they read."""
    table = pa.Table.from_batches(rows).combine_chunks()
    asks = table.column("asks").to_numpy()
    v, q = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
    size = max(1, *(int(max(x.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False), default=0)) for x in (v, q)))
    x, y = (matrix(t.column("embedding").combine_chunks(), size) for t in (q, v))
    reads = np.zeros((len(x), GROUP), bool)
    lists = q.column("lists").combine_chunks()
    reads[np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy() % GROUP] = True
    slot = np.array(v.column("lists").combine_chunks().flatten()) % GROUP
    slack = 4 * size * np.finfo(float).eps * np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1).max(initial=0))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(GROUP):
        rows_q, rows_v = np.flatnonzero(reads[:, k]), np.flatnonzero(slot == k)
        if len(rows_q) and len(rows_v):
            about = x[rows_q] @ y[rows_v].T
            nth = min(most, len(rows_v))
            enough = np.partition(about, len(rows_v) - nth, axis=1)[:, len(rows_v) - nth]
            a, b = np.nonzero(about >= (enough - slack[rows_q])[:, None])
            found.append((rows_q[a], rows_v[b]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    score = in_order(x[a], y[b])
    ids = v.column("ids").combine_chunks()
    n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n) - n
    take = np.repeat(starts[b], n[b]) + np.arange(int(n[b].sum())) - np.repeat(np.cumsum(n[b]) - n[b], n[b])
    query = np.repeat(q.column("cls").to_numpy()[a], n[b])
    score, ids = np.repeat(score, n[b]), ids.flatten().to_numpy()[take]
    kept = best(query, score, ids, most)
    return query[kept], score[kept], ids[kept]


def scanned(postings: DataFrame, probes: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """query (class), score and vec_id: the best `most` ids that each task found for a query."""
    team = F.floor(F.col("list") / GROUP).cast("int")
    blocks = lambda rows, name: rows.groupBy("team").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    vectors = postings.withColumn("team", team)
    sizes = F.broadcast(blocks(vectors, "v_blocks").join(blocks(probes, "q_blocks"), "team"))  # a row a group of lists
    dealt = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.join(sizes, "team").select("team", dealt("v_blocks").alias("v_block"), every("q_blocks").alias("q_block"), F.lit(False).alias("asks"), "cls", F.array("list").alias("lists"), "ids", "embedding")
    right = probes.join(sizes, "team").select("team", every("v_blocks").alias("v_block"), dealt("q_blocks").alias("q_block"), F.lit(True).alias("asks"), "cls", "lists", F.array().cast("array<long>").alias("ids"), "embedding")
    cell = ["team", "v_block", "q_block"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows: list[pa.RecordBatch] = []
        now = None

        def out(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if sum(len(h[0]) for h in held) > (0 if full else HELD):
                query, score, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
                kept = best(query, score, ids, most)
                held = [(query[kept], score[kept], ids[kept])]
                if full or len(kept) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in held[0]], names=["query", "score", "vec_id"])
                    held = []

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                key = tuple(keys[low]) if high > low else now
                if rows and key != now:
                    held.append(_cell(rows, most))
                    rows = []
                    yield from out(False)
                now = key
                rows.append(batch.slice(low, high - low))
        if rows:
            held.append(_cell(rows, most))
        yield from out(True)

    dealt_rows = left.unionByName(right).repartition(common.tasks(postings), *cell).sortWithinPartitions(*cell)
    return common.in_arrow(dealt_rows, work, "query long, score double, vec_id long")


def nearest(vectors: DataFrame, asks: Column, most: int = MOST, probe: float = PROBE, boundary: float = BOUNDARY, copies: int = COPIES, per_list: int = LIST, most_lists: int = MOST_LISTS, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: of each row of vectors(vec_id, embedding) that `asks` holds for, the `most` nearest others found."""
    spark = vectors.sparkSession
    rows = common.settle(_valid(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "valid")
    table = classes(rows, most)
    fitted = fit(table, per_list, most_lists, fit_rows)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = spark.sparkContext.broadcast(fitted)
    postings = posted(table, index, boundary, copies)
    held = dict(postings.where("first").groupBy("list").count().collect())  # a row a list
    members = common.settle(rows.where(asks).join(table.select("embedding", "cls"), "embedding").select(F.col("vec_id").alias("query_id"), "cls"), "queries")
    probes = probed(table.join(members.select("cls").distinct(), "cls", "left_semi"), index, held, most + 1, probe)
    # Tasks' best meet in a window that is cut within each task first; copies in several lists share their place.
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = scanned(postings, probes, most + 1, block).withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= most + 1).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    others = members.join(found.withColumnRenamed("query", "cls"), "cls").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return others.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


#: The index is approximate; tests/llm measures its recall against brute force.
QUERY = ("op12_nearest_neighbours", query, None)
