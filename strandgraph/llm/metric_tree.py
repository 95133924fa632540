"""Exact top-k inner products by best-first search in M-trees.

Integer vectors x are lifted to (x, sqrt(M - |x|^2)) with M the largest squared norm; a query is lifted with
0. Then dist(q, x)^2 = |q|^2 + M - 2 <q, x>, a metric whose nearest points are the largest inner products, and
squared distances stay integers. The table is cut into shards: every vector goes to its nearest of a bounded
sample of pivots, a crowded pivot's vectors being spread over several shards. A shard holds an M-tree of paged
nodes; an entry of a page has its distance to the page's routing object (parent distance), and an inner entry a
covering radius as well.

The search of a shard is best first, for a block of queries at once: pages wait in a queue under the least
distance they could hold for any query of the block, max(0, d(q, routing) - radius); a page's entries are passed over without computing a distance when
|d(q, parent) - d(parent, entry)| - radius already exceeds the k-th best. A query first searches the shard with
the nearest pivot, which bounds its k-th best; then only shards that their pivot's radius cannot rule out. Bounds
are loosened by a rounding margin and scores are integers, so the result is exact, ties to the smaller id.

Identical vectors of a shard are one entry with its k + 1 smallest ids, which is all a query can use.

Edge cases: null vectors and vectors with null or non-finite components take no part, as queries or candidates;
vectors of different lengths are compared as if filled up with zeros; a null id takes no part; repeated rows are
candidates as often as they occur, except that rows with the query's own id never answer it; fewer candidates
than k give fewer rows; an empty table gives none. Other columns are not read.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

PAGE = 64
SHARD_ROWS, QUERY_BLOCK = 20_000, 1_024
MOST_PIVOTS, ROWS_PER_PIVOT = 256, 4_096


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(`id`, `vec`): floor(scale * x) of every component, for vectors without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = table.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(~odd)
    return whole.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


class MTree:
    """A tree over integer points with squared norms filled up to `most`; bulk built by balanced splits."""

    def __init__(self, points: np.ndarray, most: int):
        self.points = points
        self.lift = np.sqrt(np.maximum(most - (points * points).sum(axis=1), 0).astype(np.float64))
        self.flat = points.astype(np.float64)
        self.computed, self.margin = 0, 1e-6 * (1 + float(np.sqrt(max(most, 0))))
        self.root = self._build(np.arange(len(points))) if len(points) else None

    def distances(self, routing: int, rows: np.ndarray) -> np.ndarray:
        delta = self.flat[rows] - self.flat[routing]
        return np.sqrt((delta * delta).sum(axis=1) + (self.lift[rows] - self.lift[routing]) ** 2)

    def _build(self, rows: np.ndarray) -> dict:
        """A page: its routing object, the entries' rows (leaf) or child pages, parent distances, radii."""
        middle = self.flat[rows].mean(axis=0)
        routing = int(rows[np.argmin(((self.flat[rows] - middle) ** 2).sum(axis=1))])
        apart = self.distances(routing, rows)
        if len(rows) <= PAGE:
            return {"routing": routing, "radius": float(apart.max()), "rows": rows, "parent": apart, "children": None}
        parts, queue = [], [rows]
        while len(queue) + len(parts) < PAGE and queue:
            queue.sort(key=len)
            big = queue.pop()
            if len(big) <= PAGE:
                parts.append(big)
                continue
            a = int(big[np.argmax(self.distances(int(big[0]), big))])
            far = self.distances(a, big)
            b = int(big[np.argmax(far)])
            order = np.argsort(far - self.distances(b, big), kind="stable")
            queue += [big[order[: len(big) // 2]], big[order[len(big) // 2 :]]]
        children = [self._build(part) for part in parts + queue]
        heads = np.array([c["routing"] for c in children])
        return {"routing": routing, "radius": float(apart.max()), "rows": heads, "parent": self.distances(routing, heads),
                "radii": np.array([c["radius"] for c in children]), "children": children}

    def search(self, queries: np.ndarray, worst: np.ndarray, answer) -> None:
        """Best-first search for a block of queries. `worst` holds each query's k-th best distance so far;
        answer(asked, rows, distances) takes leaf rows for some of the queries and lowers it."""
        if self.root is None:
            return
        flat = queries.astype(np.float64)
        norms = (flat * flat).sum(axis=1)
        most = self.lift**2 + (self.flat * self.flat).sum(axis=1)

        def to(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
            self.computed += len(asked) * len(rows)
            square = norms[asked, None] + most[rows][None] - 2 * (flat[asked] @ self.flat[rows].T)
            return np.sqrt(np.maximum(square, 0))

        everyone = np.arange(len(queries))
        near = to(everyone, np.array([self.root["routing"]]))[:, 0]
        least = np.maximum(near - self.root["radius"], 0)
        waiting, count = [(float(least.min()), 0, everyone, near, least, self.root)], 1
        while waiting:
            _, _, asked, near, least, page = heapq.heappop(waiting)
            live = least <= worst[asked] + self.margin
            asked, near = asked[live], near[live]
            radii = page["radii"] if page["children"] else 0.0
            open_ = np.abs(near[:, None] - page["parent"][None]) - radii <= worst[asked][:, None] + self.margin
            some, entries = open_.any(axis=1), np.flatnonzero(open_.any(axis=0))
            asked, open_ = asked[some], open_[some][:, entries]
            if not len(asked):
                continue
            found = np.where(open_, to(asked, page["rows"][entries]), np.inf)
            if page["children"] is None:
                answer(asked, page["rows"][entries], found)
                continue
            for i, entry in enumerate(entries.tolist()):
                child = page["children"][entry]
                least = np.maximum(found[:, i] - child["radius"], 0)
                ok = least <= worst[asked] + self.margin
                if ok.any():
                    heapq.heappush(waiting, (float(least[ok].min()), count, asked[ok], found[ok, i], least[ok], child))
                    count += 1


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats only where they are exact."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _search_shard(k: int, width: int, most: int):
    def search(_key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        vectors, inverse = np.unique(_padded(points["vec"].tolist(), width), axis=0, return_inverse=True)
        ids = points["id"].to_numpy()
        order = np.lexsort((ids, inverse.ravel()))
        groups = np.split(ids[order], np.searchsorted(inverse.ravel()[order], np.arange(1, len(vectors))))
        tree, out = MTree(vectors, most), []
        for start in range(0, len(asked), QUERY_BLOCK):
            out += _search_block(tree, groups, asked.iloc[start : start + QUERY_BLOCK], k, width, most)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def _search_block(tree: MTree, groups: list, asked: pd.DataFrame, k: int, width: int, most: int) -> list[tuple[int, int, int]]:
    queries, names = _padded(asked["vec"].tolist(), width), asked["id"].tolist()
    norms = (queries * queries).sum(axis=1)
    known = asked["bound"].to_numpy(dtype=np.float64, na_value=np.nan)
    kth = np.where(np.isnan(known), -np.inf, known)
    distance = lambda rows: np.where(np.isinf(kth[rows]), np.inf, np.sqrt(np.maximum(norms[rows] + most - 2 * kth[rows], 0)))
    worst = distance(np.arange(len(queries)))
    best: list[list[tuple[int, int]]] = [[] for _ in names]  # heaps of (score, -id)

    def answer(rows: np.ndarray, points: np.ndarray, found: np.ndarray) -> None:
        scores = _exact_scores(tree.points[points], queries[rows])
        changed = set()
        for a, b in zip(*(x.tolist() for x in np.nonzero((scores >= kth[rows][:, None]) & np.isfinite(found)))):
            q, score, taken = int(rows[a]), int(scores[a, b]), 0
            for x in groups[points[b]].tolist():
                if x == names[q]:
                    continue
                if len(best[q]) < k:
                    heapq.heappush(best[q], (score, -x))
                elif (score, -x) > best[q][0]:
                    heapq.heapreplace(best[q], (score, -x))
                else:
                    break
                taken += 1
                if taken == k:
                    break
            if len(best[q]) == k and best[q][0][0] > kth[q]:
                kth[q] = best[q][0][0]
                changed.add(q)
        if changed:
            rows = np.array(sorted(changed))
            worst[rows] = distance(rows)

    tree.search(queries, worst, answer)
    return [(name, -x, score) for name, own in zip(names, best) for score, x in own]


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Per query its k best: at most k rows a shard meet here."""
    best = rows.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(`query_id`, `rank`, `vec_id`, `score`) from (`id`, `vec`) integer vectors; every row is a candidate,
    rows where `is_query` holds are queries."""
    vectors = cut(vectors, "vectors")
    norm = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(norm), F.lit(0)).alias("most"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width")).first()
    # a bounded sample of routing objects: any choice gives exact results
    chosen = vectors.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(min(MOST_PIVOTS, int(size.n) // ROWS_PER_PIVOT + 1)).collect()
    pivots, most, width = _padded([r.vec for r in chosen], max(size.width, 1)), int(size.most), max(size.width, 1)
    pivot_norm = (pivots * pivots).sum(axis=1)
    lift, margin = np.sqrt(np.maximum(most - pivot_norm, 0)), 1e-6 * (1 + most**0.5)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column("vec").to_pylist(), width)
            norms = (x * x).sum(axis=1)
            own_lift = np.sqrt(np.maximum(most - norms, 0))
            square = norms[:, None] + pivot_norm[None] - 2 * (x.astype(np.float64) @ pivots.T) + (own_lift[:, None] - lift[None]) ** 2
            near = square.argmin(axis=1) if len(pivots) else np.zeros(len(x), np.int64)
            apart = np.sqrt(np.maximum(square[np.arange(len(x)), near], 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(near.astype(np.int32)), pa.array(apart)], ["id", "vec", "pivot", "apart"])

    placed = cut(vectors.mapInArrow(assign, "id long, vec array<long>, pivot int, apart double"), "placed")
    cells = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).withColumn(
        "parts", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    radius = {r.pivot: (r.radius, r.parts) for r in cells.collect()}  # at most MOST_PIVOTS rows
    shards = placed.join(F.broadcast(cells.select("pivot", "parts")), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own = [F.col(c).alias(c) for c in ("id", "vec")]  # columns of their own, apart from the candidates'
    asked = placed.filter(is_query).select(*own, F.col("pivot").alias("home"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards a query still needs: those whose nearest possible point beats its k-th best."""
        for batch in batches:
            q = _padded(batch.column("vec").to_pylist(), width)
            norms = (q * q).sum(axis=1)
            far = np.sqrt(np.maximum(norms[:, None] + most - 2 * (q.astype(np.float64) @ pivots.T), 0))
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            worst = np.where(np.isnan(bound), np.inf, np.sqrt(np.maximum(norms + most - 2 * bound, 0)))
            rows = [(i, p, part) for p, (r, parts) in radius.items()
                    for i in np.flatnonzero((far[:, p] - r <= worst + margin) & (batch.column("home").to_numpy() != p)).tolist() for part in range(parts)]
            index = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(index) for c in ("id", "vec", "bound")] + [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                ["id", "vec", "bound", "pivot", "part"])

    fields, search = "query_id long, vec_id long, score long", _search_shard(k, width, most)
    grouped = shards.select("id", "vec", "pivot", "part").groupBy("pivot", "part")
    home = asked.join(F.broadcast(cells.select(F.col("pivot").alias("home"), "parts")), "home").select(
        "id", "vec", F.lit(None).cast("long").alias("bound"), F.col("home").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = cut(grouped.cogroup(home.groupBy("pivot", "part")).applyInPandas(search, fields), "first")
    bounds = _top(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    rest = asked.join(bounds, "id", "left").select("id", "vec", "home", "bound").mapInArrow(
        route, "id long, vec array<long>, bound long, pivot int, part int")
    second = grouped.cogroup(rest.groupBy("pivot", "part")).applyInPandas(search, fields)
    return _top(first.unionByName(second), k)
