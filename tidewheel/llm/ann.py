"""Nearest neighbours by learned partitions.

A bounded sample of vectors (Settings.sample rows) gives a graph of near
neighbours, which recursive bisection cuts into parts of equal size: each half
starts from a spectral order and is refined by swaps that save cut edges. A
small network learns the part from the vector. It then routes every vector to
its most probable part, and every query to its most probable parts. How much
probability these parts have to hold is measured on sampled vectors that
training does not see: as much as finds the share Settings.recall of their
neighbours. Where vectors have little structure that is most of the parts, and
a search is near to brute force; where they have much it is few.

Parts grow in number with the table: a part of more than Settings.leaf vectors
is sampled and split again by a network of its own, level by level, and routed
likewise; the networks of a level are fitted in parallel, one part in a task.
In the last parts exact distances rerank all vectors.

Of equal vectors only those of the k + 1 smallest ids are indexed, as ties go
to the smaller id: no others can be among anyone's k nearest. So copies fill
no part. A part that cannot be split is dealt to shards of bounded size, and a
query goes to each of its shards; a part is repeated only where more than
Settings.queries queries visit it. Each meeting keeps the nearest ones, and a
window over a query's few survivors gives the answer. One network, and whether
any part is too large, is all that comes to the driver.

Cases: vectors that are null, empty, all zero, of another length than most
(the smallest of the most frequent lengths), or that hold null or non-finite
components take no part, as queries or candidates; repeated vectors are
candidates of their own and ties go to the smaller id; rows of a query's own
id are no candidates; repeated rows ask once, and an id with several vectors
asks with each; null ids take no part; with fewer candidates than asked for all
found are returned; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import remove, written, written_at


@dataclass(frozen=True)
class Settings:
    #: Bound on the vectors that the partition is learned from.
    sample: int = 4096
    #: Sampled vectors of a part.
    part: int = 128
    neighbours: int = 10
    hidden: int = 64
    epochs: int = 40
    rate: float = 0.01
    #: Share of neighbours that a query's parts should hold, and the least number of parts.
    recall: float = 0.97
    least: int = 2
    #: Vectors of a part that is not split again, queries that meet a part at once, and the most levels of parts.
    leaf: int = 1 << 15
    queries: int = 1 << 15
    levels: int = 10
    seed: int = 5


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each row's k nearest other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    norms = (x * x).sum(axis=1)
    for low in range(0, len(x), 512):
        d = norms[None] - 2 * x[low : low + 512] @ x.T
        d[np.arange(len(d)), low + np.arange(len(d))] = np.inf
        out[low : low + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def _halves(edges: np.ndarray, n: int, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A mask of half of n nodes with few cut edges (pairs of nodes)."""
    a, b = edges
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    v = (x - x.mean(axis=0)) @ rng.normal(size=x.shape[1])
    for _ in range(60):
        v = v - (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * (np.bincount(a, v[b], minlength=n) + np.bincount(b, v[a], minlength=n)) / degree
        v /= np.abs(v).max() + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v, kind="stable")[: n // 2]] = True
    for _ in range(12):
        same = side[a] == side[b]
        gain = np.bincount(a, np.where(same, -1, 1), minlength=n) + np.bincount(b, np.where(same, -1, 1), minlength=n)
        here, there = np.flatnonzero(side), np.flatnonzero(~side)
        here, there = here[np.argsort(-gain[here], kind="stable")], there[np.argsort(-gain[there], kind="stable")]
        m = min(len(here), len(there), max(1, n // 50))
        good = gain[here[:m]] + gain[there[:m]] > 2
        if not good.any():
            break
        moved = side.copy()
        moved[here[:m][good]], moved[there[:m][good]] = False, True
        if (moved[a] != moved[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = moved
    return side


def balanced_parts(x: np.ndarray, parts: int, k: int, seed: int) -> np.ndarray:
    """A part for each row: parts (a power of two) of equal size, by bisection of the neighbour graph."""
    rng = np.random.default_rng(seed)
    near = graph(x, k)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    label = np.zeros(len(x), dtype=np.int64)
    count = 1
    while count < parts:
        new = label * 2
        for p in range(count):
            mine = np.flatnonzero(label == p)
            if len(mine) > 1:
                place = np.full(len(x), -1)
                place[mine] = np.arange(len(mine))
                inside = (label[a] == p) & (label[b] == p)
                side = _halves(np.stack([place[a[inside]], place[b[inside]]]), len(mine), x[mine], rng)
                new[mine[side]] += 1
        label, count = new, count * 2
    return label


class Router:
    """A network of one hidden layer from vector to part."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.dim, self.parts, self.settings, self.mass = x.shape[1], parts, s, 1.0
        self.mean, self.scale = x.mean(axis=0), float(x.std()) + 1e-12
        shapes = [(self.dim, s.hidden), (s.hidden,), (s.hidden, parts), (parts,)]
        self.w = [rng.normal(0, 1 / np.sqrt(n[0]), n) if len(n) == 2 else np.zeros(n) for n in shapes]
        moments = [(np.zeros(n), np.zeros(n)) for n in shapes]
        z, step = (x - self.mean) / self.scale, 0
        for _ in range(s.epochs if parts > 1 else 0):
            order = rng.permutation(len(z))
            for low in range(0, len(z), 128):
                rows = order[low : low + 128]
                step += 1
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                g = _softmax(h @ self.w[2] + self.w[3])
                g[np.arange(len(rows)), label[rows]] -= 1
                g /= len(rows)
                gh = (g @ self.w[2].T) * (h > 0)
                for p, d, (m, v) in zip(self.w, (z[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)), moments, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= s.rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-4 * p)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return _softmax(h @ self.w[2] + self.w[3])

    def calibrate(self, queries: np.ndarray, x: np.ndarray) -> None:
        """Set mass, the probability that a query's parts have to hold."""
        self.mass, s = 1.0, self.settings
        if self.parts == 1 or not len(queries):
            return
        part = self.probabilities(x).argmax(axis=1)
        near = np.argsort((x * x).sum(axis=1)[None] - 2 * queries @ x.T, axis=1, kind="stable")[:, : s.neighbours]
        p = self.probabilities(queries)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        place = np.argsort(order, axis=1)[np.arange(len(queries))[:, None], part[near]]
        self.mass = min(1.0, float(np.quantile(np.take_along_axis(before, place, axis=1), s.recall)) + 1e-9)

    def route(self, x: np.ndarray, mass: float, least: int) -> list[list[int]]:
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        n = np.minimum(np.maximum((held < min(mass, 1 - 1e-12)).sum(axis=1) + 1, least), self.parts)
        return [o[:k].tolist() for o, k in zip(order, n, strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def valid(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of vectors of one length without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def learn(x: np.ndarray, s: Settings = Settings()) -> Router:
    """The router learned from sampled vectors; of one part where they are too few."""
    x = np.unique(x, axis=0)  # copies of one vector would fill parts of their own
    parts = 1
    while 2 * parts * s.part <= len(x) and 2 * parts < FAN:
        parts *= 2
    order = np.random.default_rng(s.seed).permutation(len(x))
    held, used = x[order[: len(x) // 8]], x[order[len(x) // 8 :]]
    router = Router(used, balanced_parts(used, parts, s.neighbours, s.seed), parts, s)
    router.calibrate(held, used)
    return router


#: Parts have number FAN * (number of the part that they split) + 1 + place.
FAN = 64
POINTS = "id long, mark long, times long, asks boolean, embedding array<double>, node long, done boolean"
ROUTERS = "node long, router binary"
NEAREST = "query_id long, mark long, vec_id long, score double, met long"


def _fit(s: Settings) -> Callable[[pa.Table], pa.Table]:
    def fit(group: pa.Table) -> pa.Table:
        chosen = group.sort_by([("place", "ascending"), ("id", "ascending")]).slice(0, s.sample)
        router = learn(_matrix(chosen["embedding"]), s)
        raw = pickle.dumps(router) if router.parts > 1 else None
        return pa.table({"node": pa.array([group["node"][0].as_py()], pa.int64()), "router": pa.array([raw], pa.binary())})

    return fit


def _route(points: pa.Table, router: Router, s: Settings) -> pa.Table:
    """Points in their parts: a vector in its most probable one, a query in as many as hold the router's mass."""
    if not points.num_rows:
        return points
    x, asks = _matrix(points["embedding"]), points["asks"].to_numpy()
    parts = [[int(p)] for p in router.probabilities(x).argmax(axis=1)]
    asking = np.flatnonzero(asks)
    for i, found in zip(asking.tolist(), router.route(x[asking], router.mass, s.least) if len(asking) else [], strict=True):
        parts[i] = found
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    node = points["node"].to_numpy()[rows] * FAN + 1 + np.concatenate(parts)
    out = points.select(["id", "mark", "times", "asks", "embedding"]).take(pa.array(rows))
    return out.append_column("node", pa.array(node, pa.int64())).append_column("done", pa.array(np.zeros(len(rows), dtype=bool)))


def _split(points: DataFrame, large: DataFrame, routers: DataFrame, s: Settings) -> DataFrame:
    """Points of parts that have a router, in the parts of the next level; dealt to groups of bounded size."""
    salts = large.select("node", F.greatest(F.ceil(F.col("points") / s.leaf), F.lit(1)).cast("long").alias("salts"))
    routers = routers.join(salts, "node").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    dealt = points.join(salts, "node").withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.col("salts")))
    names = [c.split()[0] for c in POINTS.split(", ")]

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left.select(names).slice(0, 0)
        return _route(left.select(names), pickle.loads(right["router"][0].as_py()), s).select(names)

    return dealt.select(*names, "salt").groupBy("node", "salt").cogroup(routers.select("node", "salt", "router").toDF("node", "salt", "router").groupBy("node", "salt")).applyInArrow(split, POINTS)


def _split_root(points: DataFrame, raw: bytes, s: Settings) -> DataFrame:
    """Points in the parts of the first level; one router is sent to all tasks and nothing is shuffled."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = pickle.loads(raw)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                yield from _route(pa.Table.from_batches([batch.slice(low, 4096)]), router, s).combine_chunks().to_batches()

    return points.mapInArrow(split, POINTS)


def partition(points: DataFrame, s: Settings = Settings()) -> DataFrame:
    """points (columns of POINTS, all in part 0) in their last parts, written."""
    points, path = written_at(points, "ann-points")
    for level in range(s.levels):
        sizes = points.where("not done").groupBy("node").agg(F.count(F.lit(1)).alias("points"), F.count_if(~F.col("asks")).alias("n"))
        large = sizes.where(F.col("n") > (s.leaf if level else 0))
        place = F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(1 << 30)).alias("place")
        drawn = points.where("not asks and not done").join(large, "node").select("node", "id", place, "embedding", "n")
        drawn = drawn.where(F.col("place") < F.lit(1.25 * s.sample * (1 << 30)) / F.col("n")).drop("n")
        routers = written(drawn.groupBy("node").applyInArrow(_fit(s), ROUTERS).where("router is not null"), "ann-routers")
        first = routers.first()
        if first is None:
            break
        if level == 0:
            moved = _split_root(points, first["router"], s)
        else:
            stay = points.join(routers.select("node"), "node", "left_anti").withColumn("done", F.lit(True))
            moved = stay.select(*points.columns).unionByName(_split(points, large, routers, s))
        (points, path), old = written_at(moved, "ann-points"), path
        remove(points.sparkSession, old)
    return points


def _meet(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest candidates of each query that meets them; the first of a query's rows has the number that it met."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            times = np.minimum(left["times"].to_numpy(), k)
            ids, x = np.repeat(left["id"].to_numpy(), times), np.repeat(_matrix(left["embedding"]), times, axis=0)
            queries, marks, y = right["id"].to_numpy(), right["mark"].to_numpy(), _matrix(right["embedding"])
            norms = (x * x).sum(axis=1)
            step = max(1, (1 << 21) // len(ids))
            for low in range(0, len(queries), step):
                part = y[low : low + step]
                rough = norms[None] - 2 * part @ x.T
                for j, q in enumerate(part):
                    query, near = int(queries[low + j]), np.flatnonzero(ids != queries[low + j])
                    if len(near) > 2 * k:
                        slack = 1e-9 * (float(norms.max()) + float(q @ q))
                        others = rough[j][near]
                        near = near[others <= np.partition(others, k)[k] + slack]
                    exact = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
                    for n, i in enumerate(np.lexsort((ids[near], exact))[:k].tolist()):
                        row = query, int(marks[low + j]), int(ids[near[i]]), float(exact[i]), 0 if n else len(ids)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
        names = [c.split() for c in NEAREST.split(", ")]
        return pa.table({n: pa.array(v, pa.float64() if t == "double" else pa.int64()) for (n, t), v in zip(names, out, strict=True)})

    return nearest


def search(vectors: DataFrame, queries: Column, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """For each valid row for which queries holds, its k nearest other rows: query_id, rank, vec_id, score, and scanned, the vectors that it met."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    rows = rows.where(F.size("embedding") == (length["dim"] if length else 0))
    rows = rows.select("id", F.transform("embedding", lambda v: v + 0.0).alias("embedding"), "asks")
    once = rows.groupBy("id", "embedding").agg(F.count(F.lit(1)).alias("times"), F.max("asks").alias("asks"))
    once, path = written_at(once.select("id", F.xxhash64("embedding").alias("mark"), "times", "asks", "embedding"), "ann-vectors")
    least = F.row_number().over(W.partitionBy("mark", "embedding").orderBy("id"))
    index = once.withColumn("least", least).where(F.col("least") <= k + 1).drop("least").withColumn("asks", F.lit(False))
    points = index.unionByName(once.where("asks")).select(*once.columns, F.lit(0).cast("long").alias("node"), F.lit(False).alias("done"))
    points = partition(points, s)
    index, asked = points.where("not asks"), points.where("asks")
    found, _ = written_at(_nearest(index, asked, k, s), "ann-found")
    short = _short(once, found, k)
    if short.isEmpty():
        remove(points.sparkSession, path)
        return found.drop("mark")
    # A query whose parts hold too few goes to all parts, in the same blocks.
    parts = index.select("node").distinct().agg(F.collect_list("node").alias("nodes"))
    again = short.join(F.broadcast(parts)).select("id", "mark", "times", F.lit(True).alias("asks"), "embedding", F.explode("nodes").alias("node"), F.lit(True).alias("done"))
    wide = _nearest(index, again.select(*index.columns), k, s)
    gone = short.select(F.col("id").alias("query_id"), "mark")
    return found.join(gone, ["query_id", "mark"], "left_anti").unionByName(wide.select(*found.columns)).drop("mark")


def _short(once: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The asking vectors that have fewer than k neighbours though there are more rows of other ids."""
    of_ids = once.groupBy("id").agg(F.sum("times").alias("own"))
    total = once.agg(F.sum("times").alias("total"))
    counts = found.groupBy(F.col("query_id").alias("id"), "mark").agg(F.count(F.lit(1)).alias("n"))
    rows = once.where("asks").join(counts, ["id", "mark"], "left").where(F.coalesce("n", F.lit(0)) < k)
    rows = rows.join(of_ids, "id").join(F.broadcast(total))  # one row
    return rows.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.col("total") - F.col("own"))).select("id", "mark", "times", "embedding")


def _nearest(index: DataFrame, asked: DataFrame, k: int, s: Settings) -> DataFrame:
    """query_id, mark, rank, vec_id, score, scanned: for each asking vector the nearest of the index in the parts that it is in."""
    held = index.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    leaves = held.join(asked.groupBy("node").agg(F.count(F.lit(1)).alias("q")), "node")

    def groups(of: str, size: int) -> Column:
        return F.greatest(F.ceil(F.col(of) / size), F.lit(1)).cast("long")

    leaves = leaves.select("node", groups("n", 2 * s.leaf).alias("shards"), groups("q", s.queries).alias("desks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("desks") - 1)).alias("desk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    dealt = F.xxhash64("id", "mark", F.lit(s.seed))
    candidates = index.join(leaves, "node").select("node", F.pmod(dealt, F.col("shards")).alias("shard"), every[0], "id", "times", "embedding")
    visits = asked.join(leaves, "node").select("node", every[1], F.pmod(dealt, F.col("desks")).alias("desk"), "id", "mark", "embedding")
    keys = ["node", "shard", "desk"]
    visits = visits.toDF(*visits.columns)  # columns of its own, as both sides come from one table
    met = candidates.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_meet(k), NEAREST)
    mine = W.partitionBy("query_id", "mark")
    ranked = met.withColumn("scanned", F.sum("met").over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "mark", "rank", "vec_id", "score", "scanned")
