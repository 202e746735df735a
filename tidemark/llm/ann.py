"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is put into the leaf that it descends to.  A query visits
leaves best bin first: a priority queue holds nodes by the query's inner product with their centroids.  How
many leaves are visited is widened until queries of a calibration set, whose true neighbours are found against
all rows, have reached the wanted recall.

Leaves are small, as that is what tells near from far; they are dealt to parts of bounded size, a leaf of many
vectors to several.  A query goes once to each part that holds leaves that it visits, with their numbers, and is
compared with those leaves only; the lists of its parts are merged.  Leaves grow with the table once it has more
vectors than the sample; on data without clusters the share of vectors that is visited falls slowly with their
number, so that the work grows nearly with the square of the table.

Equal vectors are indexed once, with their smallest ids (as many as can be asked for), and equal queries are
searched once, so a vector that many rows share costs as much as any other.

Defined results: vectors that are null or zero, or hold null or non-finite components, or have another length
than most (of equally common lengths the longer) take no part; a null id takes no part; repeated rows (id and
vector) count once; a query's own id is never found, also where other rows carry it; ties go to the smaller id;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: The most vectors that the tree is fitted on, and the most numbers in them.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
BRANCHES, LEAF_ROWS, ROUNDS = 16, 16, 8
#: More than the units of a leaf.
UNITS = 1 << 32
CALIBRATION_QUERIES, WANTED_RECALL = 200, 0.95
#: The most vectors and queries that meet in one group.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
#: Pairs that a group holds before it keeps the best only.
HELD_PAIRS = 400_000


class Tree:
    """Nodes in arrays: centroids, children (lists of node numbers, empty at leaves)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.centroids: list[np.ndarray] = [x.mean(0)]
        self.children: list[list[int]] = [[]]
        rng, work = np.random.default_rng(seed), [(0, x)]
        while work:
            node, rows = work.pop()
            if len(rows) <= LEAF_ROWS:
                continue
            parts = self._split(rows, rng)
            if len(parts) < 2:
                continue
            for c, own in parts:
                self.children[node].append(len(self.centroids))
                self.centroids.append(c)
                self.children.append([])
                work.append((len(self.centroids) - 1, own))
        self.leaves = [k for k, c in enumerate(self.children) if not c]
        self.number = {k: n for n, k in enumerate(self.leaves)}
        self.matrix = np.array(self.centroids)

    @staticmethod
    def _split(rows: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        k = min(BRANCHES, max(2, len(rows) // LEAF_ROWS + 1))
        c = rows[rng.choice(len(rows), k, replace=False)]
        for _ in range(ROUNDS):
            at = ((c * c).sum(1) - 2 * rows @ c.T).argmin(1)
            c = np.array([rows[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        at = ((c * c).sum(1) - 2 * rows @ c.T).argmin(1)
        return [(c[j], rows[at == j]) for j in range(k) if (at == j).any()]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf that each row descends to."""
        out, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if not (own := self.children[node]):
                out[rows] = self.number[node]
                continue
            c = self.matrix[own]
            at = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            work += [(child, rows[at == j]) for j, child in enumerate(own)]
        return out

    def visits(self, q: np.ndarray, most: int | None = None) -> list[int]:
        """Numbers of leaves in the order in which the query q visits them, best bin first."""
        heap, out = [(0.0, 0)], []
        while heap and (most is None or len(out) < most):
            _, node = heapq.heappop(heap)
            if own := self.children[node]:
                for score, child in zip((self.matrix[own] @ q).tolist(), own):
                    heapq.heappush(heap, (-score, child))
            else:
                out.append(self.number[node])
        return out


def usable(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v: the rows that take part, each once."""
    d = vectors.select(F.col(vec).cast("long").alias("id"), F.col(embedding).alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    lengths = d.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return d.where(F.size("v") == (lengths["n"] if lengths else 0)).distinct()


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64)


def _top(scores: np.ndarray, ids: list, k: int) -> tuple[list[float], list[int]]:
    """Of one query's scores of distinct vectors, each with its sorted ids: the k best ids."""
    if len(scores) > k:  # all that tie with the k-th
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    found = sorted((-float(scores[j]), int(i)) for j in keep for i in ids[j])[:k]
    return [-s for s, _ in found], [i for _, i in found]


def best_pairs(q: np.ndarray, v: np.ndarray, visits: dict[int, np.ndarray], unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors, ties with the k-th included, sorted by query.  visits:
    the queries that visit a unit; unit: the unit of each vector, sorted.  A pair's score does not depend on what
    else is compared with it."""
    least, held, size = np.full(len(q), -np.inf), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0

    def best() -> None:
        nonlocal held, size
        a, b, s = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        start = np.flatnonzero(np.diff(a, prepend=-1))
        count = np.diff(np.append(start, len(a)))
        place = np.arange(len(a)) - np.repeat(start, count)
        full = count >= k
        least[a[start[full]]] = s[start[full] + k - 1]
        keep = (place < k) | (s >= least[a])
        held, size = [(a[keep], b[keep], s[keep])], int(keep.sum())

    edge = np.flatnonzero(np.diff(unit, prepend=-1))
    for x, y in zip(edge, np.append(edge[1:], len(unit))):
        own = visits.get(int(unit[x]))
        if own is None:
            continue
        # rounding may move a score by a little: what is near the least is looked at exactly
        i, j = np.nonzero(q[own] @ v[x:y].T >= least[own][:, None] - 1e-9 * (1 + np.abs(least[own][:, None])))
        i, j = own[i], j + x
        held.append((i, j, (q[i] * v[j]).sum(1)))
        size += len(i)
        if size > HELD_PAIRS:
            best()
    best()
    return held[0]


_FOUND = "scores array<double>, ids array<bigint>"


def merge_lists(found: DataFrame, key: str, k: int) -> DataFrame:
    """key, top: array of struct(neg, id), the best k of all lists of a key."""
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("neg"), F.col("ids").alias("id"))
    return found.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("top"))


def search(vectors: DataFrame, is_query, k: int = 20, vec: str = "vec_id", embedding: str = "embedding", recall: float = WANTED_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score.  is_query: a condition on the column id."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, vec, embedding), "ann-rows")
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    entries = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    queries = rows.where(is_query)

    dim = rows.select(F.size("v")).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim[0]))
    distinct = entries.select("v")
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(most).toPandas()
    tree = spark.sparkContext.broadcast(Tree(_matrix(sample["v"])))

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            yield d.assign(leaf=tree.value.leaf(_matrix(d["v"]))) if len(d) else d.assign(leaf=pd.Series(dtype=np.int64))

    kind = rows.schema["v"].dataType.simpleString()
    index = written(entries.mapInPandas(put, f"v {kind}, ids array<bigint>, leaf long"), "ann-index")
    # one row per distinct query vector; two hashes name it
    asked = queries.select("v").distinct().select(F.xxhash64("v", F.lit(1)).alias("q1"), F.xxhash64("v", F.lit(2)).alias("q2"), "v")
    asked = written(asked.select(F.struct("q1", "q2").alias("q"), "v"), "ann-queries")

    visits = calibrated(index, asked, tree, k, recall)

    # a leaf's vectors are cut into units by hash, units are dealt to parts; queries are cut by hash, too
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # a row per leaf of the tree
    units = {leaf: -(-n // BLOCK_ROWS) for leaf, n in counts.items()}
    n_parts = -(-sum(counts.values()) // BLOCK_ROWS)
    n_blocks = -(-asked.count() // BLOCK_QUERIES) or 1

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            out = [(q["q1"], q["q2"], v, part, own) for q, v in zip(d["q"], d["v"]) for part, own in route(v).items()]
            yield pd.DataFrame(out, columns=["q1", "q2", "v", "part", "units"])

    def route(v) -> dict[int, list[int]]:
        """part -> the units in it that a query visits."""
        out: dict[int, list[int]] = {}
        for leaf in tree.value.visits(np.asarray(v, np.float64), visits):
            for u in range(units.get(leaf, 0)):
                out.setdefault((leaf + u) % n_parts, []).append(leaf * UNITS + u)
        return out

    routed = asked.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "q").mapInPandas(dealt, f"q1 long, q2 long, v {kind}, part long, units array<bigint>")
    left = routed.withColumn("bq", F.pmod("q1", F.lit(n_blocks)).cast("int"))
    small = spark.createDataFrame([(leaf, n) for leaf, n in units.items()], "leaf long, nv int")
    right = index.join(F.broadcast(small), "leaf").withColumn("u", F.pmod(F.xxhash64("v"), "nv")).withColumn("part", F.pmod(F.col("leaf") + F.col("u"), F.lit(n_parts)))
    right = right.withColumn("unit", F.col("leaf") * UNITS + F.col("u")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["q1", "q2", "scores", "ids"])
        b = b.sort_values("unit", ignore_index=True)
        flat = np.concatenate([np.asarray(u, np.int64) for u in a["units"]])
        query = np.repeat(np.arange(len(a)), a["units"].map(len).to_numpy())
        order = np.argsort(flat, kind="stable")
        edge = np.flatnonzero(np.diff(flat[order], prepend=-1))
        visiting = {int(flat[order[x]]): query[order[x:y]] for x, y in zip(edge, np.append(edge[1:], len(flat)))}
        i, j, score = best_pairs(_matrix(a["v"]), _matrix(b["v"]), visiting, b["unit"].to_numpy(), k + 1)
        ids, out = b["ids"].tolist(), []
        edge = np.flatnonzero(np.diff(i, prepend=-1))
        for x, y in zip(edge, np.append(edge[1:], len(i))):
            out.append((a["q1"].iat[i[x]], a["q2"].iat[i[x]], *_top(score[x:y], [ids[t] for t in j[x:y]], k + 1)))
        return pd.DataFrame(out, columns=["q1", "q2", "scores", "ids"])

    group = ["part", "bq"]
    met = left.select(*group, "q1", "q2", "v", "units").groupBy(*group).cogroup(right.select(*group, "unit", "v", "ids").groupBy(*group)).applyInPandas(meet, f"q1 long, q2 long, {_FOUND}")
    top = merge_lists(met.withColumn("q", F.struct("q1", "q2")), "q", k + 1)
    out = queries.select(F.col("id").alias("query_id"), F.struct(F.xxhash64("v", F.lit(1)).alias("q1"), F.xxhash64("v", F.lit(2)).alias("q2")).alias("q")).join(top, "q")
    kept = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(kept).alias("r", "x")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.neg")).alias("score"))


def calibrated(index: DataFrame, asked: DataFrame, tree, k: int, recall: float) -> int:
    """How many leaves must be visited for the wanted recall over the calibration queries."""
    cal = asked.orderBy("q").limit(CALIBRATION_QUERIES).toPandas()
    if not len(cal):
        return 1
    sent = index.sparkSession.sparkContext.broadcast(_matrix(cal["v"]))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            if len(d):
                found = [_top(s, [[x] for x in d["leaf"]], k) for s in sent.value @ _matrix(d["v"]).T]
                yield pd.DataFrame({"c": range(len(found)), "scores": [f[0] for f in found], "ids": [f[1] for f in found]})

    top = merge_lists(index.select("v", "leaf").mapInPandas(best, f"c long, {_FOUND}"), "c", k).collect()
    ranks = []
    for r in top:
        order = {leaf: n for n, leaf in enumerate(tree.value.visits(sent.value[r["c"]]))}
        ranks += [order[x["id"]] + 1 for x in r["top"]]
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)
