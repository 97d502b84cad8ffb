"""Approximate nearest neighbours with learned partitions.

1. A bounded sample of the vectors gets its exact neighbour graph, and the
   graph is cut into balanced partitions: median splits along principal
   directions first, then moves of single vectors to the partition that holds
   most of their neighbours, as long as it has room.
2. A small network learns from the sample which partitions hold a vector's
   neighbours.
3. Every distinct vector of the table goes to its most probable partition.
4. A query goes to its several most probable partitions, and all that they
   hold is ranked by the exact cosine. How many partitions it takes to find
   ``recall`` of the true neighbours is measured: for a few queries the whole
   table is scanned, in blocks.

Copies of a vector are one entry that lists the few smallest identifiers that a
result can need, gathered per task first, so a vector that fills a third of the
table is one row. Partitions and their queries are dealt to tasks in pieces of
bounded size.

Defined cases: vectors that are null, all zero, of another length than the most
common one, or hold a null or a non-finite number take no part, neither as
queries nor as candidates; null identifiers neither; rows that repeat both
identifier and vector count once; with fewer candidates than asked for all are
returned; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Approximate cosines closer than this may be equal, or in another order, exactly.
TIE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row of a sample of unit vectors."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for begin in range(0, len(x), 1024):
        near = x[begin : begin + 1024] @ x.T
        near[np.arange(len(near)), np.arange(begin, begin + len(near))] = -np.inf
        out[begin : begin + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, *, slack: float = 1.1, rounds: int = 8) -> np.ndarray:
    """A partition of the graph: none has over ``slack`` times its share, and moves keep neighbours together."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        label[rows] = first
        if n > 1 and len(rows) > 1:
            own = x[rows] - x[rows].mean(axis=0)
            order = np.argsort(own @ np.linalg.svd(own[:2000], full_matrices=False)[2][0], kind="stable")
            cut = len(rows) * (n // 2) // n
            todo += [(rows[order[:cut]], first, n // 2), (rows[order[cut:]], first + n // 2, n - n // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        held = affinity(label, graph, parts)
        here = held[np.arange(len(x)), label]
        best = held.argmax(axis=1)
        gain = held[np.arange(len(x)), best] - here
        size = np.bincount(label, minlength=parts)
        moved = 0
        for k in np.argsort(-gain, kind="stable"):
            if gain[k] <= 0:
                break
            if size[best[k]] < room:
                size[label[k]] -= 1
                size[best[k]] += 1
                label[k] = best[k]
                moved += 1
        if not moved:
            break
    return label


def affinity(label: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """How many neighbours of each vector are in each partition."""
    held = np.zeros((len(label), parts))
    np.add.at(held, (np.repeat(np.arange(len(label)), graph.shape[1]), label[graph].ravel()), 1)
    return held


@dataclass
class Router:
    """Two layers: vector -> probability of each partition."""

    hidden: np.ndarray
    output: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        logits = _one(np.maximum(_one(x) @ self.hidden, 0)) @ self.output
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def train_router(x: np.ndarray, wanted: np.ndarray, *, width: int = 128, epochs: int = 30, rate: float = 5e-3, seed: int = 3) -> Router:
    """Adam on the cross entropy with the shares that each partition has of a vector's neighbours."""
    dice = np.random.default_rng(seed)
    net = Router(dice.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1] + 1, width)), dice.normal(0, width**-0.5, (width + 1, wanted.shape[1])))
    mean, square, step = [0.0, 0.0], [0.0, 0.0], 0
    scale = x.shape[1] ** 0.5
    for _ in range(epochs):
        order = dice.permutation(len(x))
        for begin in range(0, len(x), 128):
            rows = order[begin : begin + 128]
            inner = _one(x[rows] * scale) @ net.hidden
            active = _one(np.maximum(inner, 0))
            logits = active @ net.output
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (e / e.sum(axis=1, keepdims=True) - wanted[rows]) / len(rows)
            slopes = [_one(x[rows] * scale).T @ ((error @ net.output[:-1].T) * (inner > 0)), active.T @ error]
            step += 1
            for k, weights in enumerate((net.hidden, net.output)):
                mean[k] = 0.9 * mean[k] + 0.1 * slopes[k]
                square[k] = 0.999 * square[k] + 0.001 * slopes[k] ** 2
                weights -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    net.hidden[:-1] *= scale
    return net


def exact_cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Double-precision cosines, each by the same order of operations wherever the row stands."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _usable(column: str, dim: int) -> Column:
    every = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(column) == dim) & every & F.exists(column, lambda x: x != 0)


def _local_classes(every: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple, list] = {}
            ids, dim = b.column("vec_id").to_pylist(), None
            vectors = b.column("v")
            dim = len(vectors[0]) if len(ids) else 1
            rows = vectors_of(vectors, dim) + 0.0  # no negative zero
            for k, i in enumerate(ids):
                entry = held.setdefault(rows[k].tobytes(), [k, set(), False])
                entry[2] |= i % every == 0
                entry[1].add(i)
                if len(entry[1]) > 4 * keep:
                    entry[1] = set(sorted(entry[1])[:keep])
            first = [e[0] for e in held.values()]
            yield pa.record_batch([pa.array([rows[k].tolist() for k in first], pa.list_(pa.float64())), pa.array([sorted(e[1])[:keep] for e in held.values()], pa.list_(pa.int64())), pa.array([e[2] for e in held.values()], pa.bool_())], ["v", "ids", "asked"])

    return run


def _sampled(rows: DataFrame, count: int, most: int, seed: int) -> list:
    """``most`` rows at most, those with the smallest hashes of their class."""
    draw = F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 30))
    few = rows.where(draw < int(min(1.0, 1.5 * most / max(count, 1)) * (1 << 30))).orderBy(draw, "class").limit(most)
    return sorted(few.collect(), key=lambda r: r["class"])


def nearest(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, recall: float = 0.97, sample_rows: int = 4096, part_rows: int = 2000, most_parts: int = 64, graph_degree: int = 16, tuning_queries: int = 64, piece_rows: int = 8192, query_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest of each query.

    Queries are the rows whose identifier is divisible by ``every``; candidates
    are all rows but the query's own. ``sample_rows`` bounds what the index is
    fitted on, ``tuning_queries`` the queries that are compared with brute force.
    """
    spark = embeddings.sparkSession
    vector, keep = F.col(f"`{vector_col}`"), k + 1
    raw = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    lengths = raw.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None or not lengths["n"]:
        return spark.createDataFrame([], result)
    dim = lengths["n"]
    valid = raw.where(_usable("v", dim))
    local = valid.mapInArrow(_local_classes(every, keep), "v array<double>, ids array<long>, asked boolean")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    classes = staged(local.groupBy("v").agg(ids.alias("ids"), F.max("asked").alias("asked")).select(F.monotonically_increasing_id().alias("class"), "v", "ids", "asked"), "classes")
    count = classes.count()
    if not count:
        return spark.createDataFrame([], result)

    sample = unit(np.array([r.v for r in _sampled(classes.select("class", "v"), count, sample_rows, 1)] or [classes.first().v]))
    parts = max(1, min(most_parts, count // part_rows + 1, len(sample) // 32 + 1))
    graph = neighbour_graph(sample, graph_degree) if len(sample) > 1 else np.zeros((1, 0), np.int64)
    label = balanced_parts(sample, graph, parts)
    wanted = affinity(label, graph, parts) + np.eye(parts)[label]
    router = train_router(sample, wanted / wanted.sum(axis=1, keepdims=True))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router(unit(vectors_of(b.column("v"), dim))).argmax(axis=1) if b.num_rows else np.zeros(0)
            yield pa.record_batch([*b.columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    index = staged(classes.mapInArrow(place, "class long, v array<double>, ids array<long>, asked boolean, part int"), "index")
    asked = index.where("asked")
    probes = _probes(index, asked, router, dim, parts, keep, recall, tuning_queries)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = np.argsort(-router(unit(vectors_of(b.column("v"), dim))), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, probes))
            yield pa.record_batch([b.column("class"), b.column("v"), pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["class", "v", "parts"])

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            x, ids = vectors_of(rows.column("v").combine_chunks(), dim), rows.column("ids").to_pylist()
            sure, q = unit(x), vectors_of(queries.column("v").combine_chunks(), dim)
            names = queries.column("class").to_pylist()
            for begin in range(0, len(q), 256):
                near = unit(q[begin : begin + 256]) @ sure.T
                cut = -np.partition(-near, min(keep, len(x)) - 1, axis=1)[:, min(keep, len(x)) - 1]
                for at, row in enumerate(near):
                    top = np.flatnonzero(row >= cut[at] - TIE)  # all of them, as ties are settled by identifier
                    scores = exact_cosines(q[begin + at], x[top])
                    found = sorted((-s, i) for s, row in zip(scores.tolist(), top) for i in ids[row])[:keep]
                    out[0].append(names[begin + at])
                    out[1].append([-s for s, _ in found])
                    out[2].append([i for _, i in found])
        return pa.table({"class": pa.array(out[0], pa.int64()), "scores": pa.array(out[1], pa.list_(pa.float64())), "found": pa.array(out[2], pa.list_(pa.int64()))})

    pieces = max(1, -(-count // (parts * piece_rows)))
    batches = max(1, -(-asked.count() * probes // (parts * query_rows)))
    questions = asked.mapInArrow(routed, "class long, v array<double>, parts array<int>").select("class", "v", F.explode("parts").alias("part"), F.pmod(F.xxhash64("class"), F.lit(batches)).alias("batch"))
    questions = questions.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    held = index.select("v", "ids", "part", F.pmod(F.xxhash64("class"), F.lit(pieces)).alias("piece")).withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    keys = ["part", "piece", "batch"]
    found = questions.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, "class long, scores array<double>, found array<long>")
    # A query class has one row for each partition and piece that it asked, of k + 1 entries each.
    merged = found.groupBy("class").agg(F.flatten(F.collect_list(F.expr("zip_with(scores, found, (s, i) -> struct(-s AS far, i AS vec_id))"))).alias("near"))
    best = merged.select("class", F.slice(F.array_sort("near"), 1, keep).alias("near"))
    answers = asked.select("class", "v").join(best, "class").select("v", "near")
    questions_by_id = valid.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    own = questions_by_id.withColumnRenamed("vec_id", "query_id").join(answers, "v")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("rank", "near"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), (-F.col("near.far")).alias("score"))


def _probes(index: DataFrame, asked: DataFrame, router: Router, dim: int, parts: int, keep: int, recall: float, tuning: int) -> int:
    """How many partitions hold ``recall`` of the true neighbours of some of the queries, by brute force over all rows."""
    few = _sampled(asked.select("class", "v"), asked.count(), tuning, 2)[:tuning]
    if not few or parts == 1:
        return parts
    q = unit(np.array([r.v for r in few]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = q @ unit(vectors_of(b.column("v"), dim)).T
                top = np.argpartition(-near, min(keep, b.num_rows) - 1, axis=1)[:, :keep]
                part = b.column("part").to_numpy()[top]
                score = np.take_along_axis(near, top, axis=1)
                who = np.repeat(np.arange(len(q)), top.shape[1])
                yield pa.record_batch([pa.array(who, pa.int32()), pa.array(score.ravel()), pa.array(part.ravel(), pa.int32())], ["q", "score", "part"])

    rows = index.select("v", "part").mapInArrow(scan, "q int, score double, part int")
    order = np.argsort(np.argsort(-router(q), axis=1, kind="stable"), axis=1)
    best: dict[int, list[tuple[float, int]]] = {}
    for r in rows.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "part")))), 1, keep).alias("near")).collect():
        best[r.q] = [(x.score, x.part) for x in r.near]
    places = sorted(int(order[k, part]) for k, near in best.items() for _, part in near[1:])  # the first is the query itself
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))))] + 1 if places else parts
