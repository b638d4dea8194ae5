"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripgrid.functions.lineage import cut_lineage

SAMPLE = 65_536
MOST_LISTS = 4_096
LIST_ROWS = 128
EDGES = 24
BLOCK = 4_096
QUERY_BLOCK = 512
REPLICAS = 4
BOUNDARY = 1.1
RATIO = 1.25


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ centres.T)))


def balanced_centres(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Directions of clusters of distinct sample vectors; a cluster over twice the mean size is cut in two."""
    points = unit_rows(np.unique(sample, axis=0))
    draw = np.random.default_rng(seed)
    centres = points[draw.choice(len(points), min(lists, len(points)), replace=False)]
    limit = 2 * max(1, len(points) // max(1, lists))
    for turn in range(10):
        nearest = np.concatenate([(points[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(points), 8192)])
        new = []
        for k in range(len(centres)):
            members = points[nearest == k]
            if not len(members):
                continue
            halves = [members]
            if len(members) > limit and turn < 9 and len(centres) + len(new) < MOST_LISTS:
                side = (members - members.mean(0)) @ (members[0] - members.mean(0)) > 0
                halves = [x for x in (members[side], members[~side]) if len(x)]
            new += [x.mean(0) if np.linalg.norm(x.mean(0)) > 1e-12 else x[0] for x in halves]
        centres = unit_rows(np.array(new))
    return centres


class CentreGraph:
    """Centres with edges to their nearest others; searched best first from the centre nearest to a fixed few."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        near = np.argsort(distances(centres, centres), axis=1, kind="stable")[:, 1 : EDGES + 1]
        edges = [set(row.tolist()) for row in near]
        for a, row in enumerate(near):  # both ways, and a ring, so that every centre can be reached
            for b in row:
                edges[b].add(a)
            edges[a] |= {(a + 1) % len(centres), (a - 1) % len(centres)}
        self.edges = [np.array(sorted(x - {a}), dtype=np.int64) for a, x in enumerate(edges)]
        self.entry = np.unique(np.linspace(0, len(centres) - 1, min(16, len(centres))).astype(np.int64))

    def search(self, query: np.ndarray, ratio: float, enough: int, sizes: np.ndarray) -> list[int]:
        """Centres within ``ratio`` x the nearest distance, nearest first, and more until their lists hold ``enough``."""
        far = dict(zip(self.entry.tolist(), distances(query[None], self.centres[self.entry])[0].tolist()))
        queue = [(d, c) for c, d in far.items()]
        heapq.heapify(queue)
        best, held, chosen = min(far.values()), 0, []
        while queue:
            d, centre = heapq.heappop(queue)
            if d > ratio * best + 1e-12 and held >= enough:
                break
            chosen.append((d, centre))
            held += int(sizes[centre])
            new = [c for c in self.edges[centre].tolist() if c not in far]
            if new:
                found = distances(query[None], self.centres[new])[0].tolist()
                far.update(zip(new, found))
                best = min(best, min(found))
                for x in zip(found, new):
                    heapq.heappush(queue, x)
        chosen.sort()
        kept, held = [], 0
        for d, centre in chosen:
            if d > ratio * best + 1e-12 and held >= enough:
                break
            kept.append(centre)
            held += int(sizes[centre])
        return kept


def valid_vectors(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector as doubles) of the rows whose vector is not null, not zero and has finite components only.

    The dimension is that of most rows; rows with another take no part.
    """
    rows = frame.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("key").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    dimension = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (dimension["n"] if dimension else 0))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def nearest(
    queries: DataFrame, frame: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", seed: int = 0
) -> DataFrame:
    """The k rows of ``frame`` with the largest cosine for each row of ``queries``: (query_id, rank, vec_id, score).

    Rows that agree in key and vector are one row. The index is fitted on about ``SAMPLE`` of these, drawn by a hash of both: up to ``MOST_LISTS`` centres, one per
    ``LIST_ROWS`` rows. Every row is put in its nearest list, and in up to ``REPLICAS`` lists whose distance is within
    ``BOUNDARY`` x the nearest. A query takes the lists that a search of the centres' graph finds within ``RATIO`` x the nearest distance,
    and more lists while those hold too few rows. Long lists are cut in blocks of ``BLOCK`` rows and the queries of a
    list in blocks of ``QUERY_BLOCK``, so a vector that fills a third of the table is spread over tasks; every row of
    a chosen list is scored.

    Scores are cosines of the original vectors in double precision; ties go to the smaller key. A query is never its own
    answer; rows with the same key count once, with their best score. Null, zero and non-finite vectors, and rows
    with a null key, take no part on either side. With fewer than k candidates, all that are found are returned; empty tables give no rows.
    """
    rows = cut_lineage(valid_vectors(frame, key, vector).distinct())
    asked = valid_vectors(queries, key, vector)
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return frame.sparkSession.createDataFrame([], empty)
    share = F.pmod(F.xxhash64("key", "vector", F.lit(seed)), F.lit(1_000_000)) < min(1.0, SAMPLE / n) * 1_000_000
    sample = rows.where(share).select("vector").toArrow()["vector"].combine_chunks()
    if not len(sample):
        sample = rows.limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    dimension = len(sample[0])
    centres = balanced_centres(matrix(sample, dimension), max(1, min(MOST_LISTS, n // LIST_ROWS)), seed)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(1), dimension)
            far = distances(unit_rows(points), centres)
            order = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
            taken = np.take_along_axis(far, order, 1) <= BOUNDARY * far.min(1, keepdims=True) + 1e-12
            row, at = np.nonzero(taken)
            vectors = [points[i].tobytes() for i in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order[row, at].astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(vectors, pa.binary())],
                names=["list", "key", "vector"],
            )

    lists = cut_lineage(rows.mapInArrow(post, "list int, key long, vector binary"))
    # One number per list: MOST_LISTS at most.
    sizes = np.zeros(len(centres), np.int64)
    for name, size in lists.groupBy("list").count().collect():
        sizes[name] = size
    graph = CentreGraph(centres)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, keys = matrix(batch.column(1), dimension), batch.column(0).to_pylist()
            found = [graph.search(x, RATIO, 4 * REPLICAS * (k + 1), sizes) for x in unit_rows(points)]
            pairs = [(c, keys[i], points[i].tobytes()) for i, cs in enumerate(found) for c in cs]
            arrays = [pa.array([x[c] for x in pairs], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["list", "key", "vector"])

    probes = cut_lineage(asked.mapInArrow(probe, "list int, key long, vector binary"))
    spark = frame.sparkSession
    counts = probes.groupBy("list").count().withColumnRenamed("count", "queries")
    cuts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "list int, rows long").join(counts, "list")
    cuts = cuts.selectExpr("list", f"cast(ceil(rows / {BLOCK}) as int) blocks", f"cast(ceil(queries / {QUERY_BLOCK}) as int) parts")
    left = lists.join(F.broadcast(cuts), "list").select(
        "list",
        F.expr("cast(pmod(xxhash64(key, vector), blocks) as int)").alias("block"),
        F.explode(F.expr("sequence(0, parts - 1)")).alias("part"),
        "key",
        "vector",
    )
    right = probes.join(F.broadcast(cuts), "list").select(
        "list",
        F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        F.expr("cast(pmod(xxhash64(key, vector), parts) as int)").alias("part"),
        "key",
        "vector",
    )

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            side = lambda t: np.frombuffer(b"".join(t["vector"].to_pylist())).reshape(-1, dimension)
            points, wanted = side(rows), side(queries)
            keys, names = rows["key"].to_numpy(), queries["key"].to_numpy()
            lengths = np.sqrt((points * points).sum(1))
            rough = unit_rows(wanted) @ (points / lengths[:, None]).T
            for i, name in enumerate(names):
                near = np.nonzero(keys != name)[0]
                _, of = np.unique(keys[near], return_inverse=True)
                tops = np.full(of.max(initial=-1) + 1, -np.inf)  # the best score of each key
                np.maximum.at(tops, of, rough[i, near])
                if len(tops) > k:
                    least = np.partition(tops, len(tops) - k)[len(tops) - k]
                    near = near[rough[i, near] >= least - 1e-9]
                exact = (points[near] * wanted[i]).sum(1) / (lengths[near] * np.sqrt((wanted[i] * wanted[i]).sum()))
                best = np.lexsort((keys[near], -exact))
                taken: dict[int, float] = {}
                for j in best:
                    taken.setdefault(int(keys[near[j]]), float(exact[j]))
                    if len(taken) == k:
                        break
                out += [(int(name), key_, value) for key_, value in taken.items()]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    scored = (
        left.groupBy("list", "block", "part")
        .cogroup(right.groupBy("list", "block", "part"))
        .applyInArrow(score, "query_id long, vec_id long, score double")
    )
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
