"""Approximate nearest neighbours through learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts (recursive bisection,
refined by swapping vertices that lower the cut). A small network learns to predict in which
parts a vector's neighbours lie. Every row is then stored under its most probable part, every
query is sent to its several most probable parts, and what is found there is reranked with the
exact measure on the original vectors. The number of visited parts is the least that finds the
asked share of neighbours in the sample, where vectors the network has not seen stand for the
queries that are not in the sample. Parts lie on shelves of a bounded number of rows; a task
holds one shelf while the queries sent to it stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import map_batches, stored

#: Vectors that the partitions are learned on, at most; neighbours of each in the graph; units of the hidden layer.
SAMPLE_ROWS, GRAPH, HIDDEN = 8192, 10, 64
#: Vectors of the sample in a part at least, least parts that a query visits, the recall that the number of visits is set for.
PART_ROWS, LEAST_VISITS, RECALL = 8, 2, 0.925
#: Rows of a shelf, and queries compared at one go.
SHELF_ROWS, TURN = 8192, 512


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other rows by inner product, a row each."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vertex; the parts' sizes differ by at most a few. ``parts`` is a power of two."""
    part, sets = np.zeros(len(x), np.int64), [np.arange(len(x))]
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.reshape(-1)
    while len(sets) < parts:
        halves = []
        for own in sets:
            side = np.full(len(x), -1, np.int8)
            centred = x[own] - x[own].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            side[own] = 0
            side[own[np.argsort(centred @ axis, kind="stable")[len(own) // 2 :]]] = 1
            inner = (side[a] >= 0) & (side[b] >= 0)
            u, v = np.r_[a[inner], b[inner]], np.r_[b[inner], a[inner]]
            for _ in range(12):
                across = side[u] != side[v]
                gain = np.bincount(u, np.where(across, 1.0, -1.0), len(x))
                best = [own[side[own] == i] for i in (0, 1)]
                best = [s[np.argsort(-gain[s], kind="stable")] for s in best]
                m = min(len(best[0]), len(best[1]))
                wins = int(((gain[best[0][:m]] + gain[best[1][:m]]) > 0).sum()) // 2
                if not wins:
                    break
                cut, was = int(across.sum()), side.copy()
                side[best[0][:wins]], side[best[1][:wins]] = 1, 0
                if int((side[u] != side[v]).sum()) >= cut:
                    side = was
                    break
            halves += [own[side[own] == 0], own[side[own] == 1]]
        sets = halves
    for i, own in enumerate(sets):
        part[own] = i
    return part


class Router:
    """One hidden layer and a softmax over the parts, for vectors of length one."""

    def __init__(self, width: int, parts: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.parts = parts
        self.p = {
            "w": rng.normal(0, 2 * width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN),
            "direct": np.zeros((width, parts)), "out": rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), "bias": np.zeros(parts),
        }

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.maximum(x @ p["w"] + p["b"], 0) @ p["out"] + x @ p["direct"] + p["bias"]

    def train(self, x: np.ndarray, near: np.ndarray, steps: int = 900, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Router:
        """Adam on the cross entropy. near: the parts in which each vector and its neighbours lie."""
        rng, step, p = np.random.default_rng(seed), 0, self.p
        m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
        for _ in range(-(-steps // -(-len(x) // batch))):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                step += 1
                own = order[at : at + batch]
                hidden = np.maximum(x[own] @ p["w"] + p["b"], 0)
                z = hidden @ p["out"] + x[own] @ p["direct"] + p["bias"]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = e / e.sum(axis=1, keepdims=True)
                np.subtract.at(d, (np.arange(len(own))[:, None], near[own]), 1 / near.shape[1])
                d /= len(own)
                back = (d @ p["out"].T) * (hidden > 0)
                g = {"w": x[own].T @ back, "b": back.sum(axis=0), "direct": x[own].T @ d, "out": hidden.T @ d, "bias": d.sum(axis=0)}
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def route(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The most probable parts of each row, best first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :visits]


def parts_for(sample: int) -> int:
    """A power of two, as many as leave ``PART_ROWS`` vectors of the sample in each."""
    return 1 << (max(1, sample // PART_ROWS).bit_length() - 1)


def fit_router(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    graph = neighbour_graph(x, GRAPH)
    part = balanced_parts(x, graph, parts)
    return Router(x.shape[1], parts, seed).train(x, np.concatenate([part[:, None], part[graph]], axis=1), seed=seed)


def visits_for(router: Router, x: np.ndarray, held: np.ndarray, k: int, recall: float, known: float) -> int:
    """Fewest visits that find ``recall`` of the ``k`` nearest, where ``known`` of the queries are among the vectors ``x`` the router has seen and the rest is like ``held``.

    Neighbours in a sample lie further away than those in the whole table, so this errs on the
    side of more visits.
    """
    k = min(k, len(x) - 1)
    home = router.route(x, 1)[:, 0]

    def ranks(asked: np.ndarray, near: np.ndarray) -> np.ndarray:
        place = np.argsort(router.route(asked, router.parts), axis=1)
        return np.sort(place[np.arange(len(asked))[:, None], home[near]].reshape(-1))

    groups = [(ranks(x, neighbour_graph(x, k)), known if len(held) else 1.0)]
    if len(held):
        groups.append((ranks(held, np.argpartition(-(held @ x.T), k - 1, axis=1)[:, :k]), 1 - known))
    share = lambda v: sum(w * np.searchsorted(r, v, "left") / len(r) for r, w in groups) / sum(w for _, w in groups)
    return next((v for v in range(1, router.parts) if share(v) >= recall), router.parts)


def shelves_of(sizes: dict[int, int], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First shelf of each part, and how many it has: small parts share one, large parts have several."""
    first, number, shelf, held = np.zeros(parts, np.int64), np.ones(parts, np.int64), 0, 0
    for part in range(parts):
        n = sizes.get(part, 0)
        if held and held + n > SHELF_ROWS:
            shelf, held = shelf + 1, 0
        first[part], number[part] = shelf, max(1, -(-n // SHELF_ROWS))
        shelf, held = shelf + number[part] - 1, held + n if n <= SHELF_ROWS else SHELF_ROWS
    return first, number


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that have a length: not null, not zero, all components finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of the rows of two matrices, pair by pair, in double precision; powers of two keep the squares in range."""
    q, x = (np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) for m in (q, x))
    return np.einsum("ij,ij->i", q, x) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


def best_of(q: np.ndarray, visits: np.ndarray, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query its ``k`` best rows in the parts it visits: index of the query, id, score; and how many rows were scored.

    ``visits``: queries by parts, whether visited; ``bounds``: where the rows of each part begin.
    """
    uq, ux = _unit(q), _unit(x)
    rows, cols, scored = [], [], 0
    for part, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        own = np.flatnonzero(visits[:, part])
        if b == a or not len(own):
            continue
        s = uq[own] @ ux[a:b].T
        scored += s.size
        kth = np.partition(s, -min(k, b - a), axis=1)[:, -min(k, b - a)]
        i, j = np.nonzero(s >= (kth - 1e-9)[:, None])
        rows.append(own[i])
        cols.append(a + j)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), scored
    i, j = np.concatenate(rows), np.concatenate(cols)
    score = cosines(q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], ids[j[top]], score[top], scored


def _searched(k: int, counter: Accumulator | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In order of ``shelf, kind, part``: the rows of a shelf come first, then the queries sent to it, in as many batches as they take."""
        shelf, held, ready = None, [], None
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1, len(of)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                piece = batch.slice(a, b - a)
                if of[a] != shelf:
                    shelf, held, ready = of[a], [], None
                if kind[a] == 0:
                    held.append((piece.column(2).to_numpy(), piece.column(3).to_numpy(), _matrix(piece.column(4))))
                elif held:
                    if ready is None:
                        part, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
                        known, starts = np.unique(part, return_index=True)
                        ready = known, np.r_[starts, len(part)], ids, x
                    known, bounds, ids, x = ready
                    q, keys = _matrix(piece.column(4)), piece.column(3).to_numpy()
                    to = piece.column(5)
                    visits = np.zeros((len(q), len(known)), bool)
                    wanted, who = to.flatten().to_numpy(), np.repeat(np.arange(len(q)), to.value_lengths().to_numpy())
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    here = known[at] == wanted
                    visits[who[here], at[here]] = True
                    for t in range(0, len(q), TURN):
                        i, found, score, scored = best_of(q[t : t + TURN], visits[t : t + TURN], x, ids, bounds, k)
                        if counter is not None:
                            counter.add(scored)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[t + i]), pa.array(found), pa.array(score)], names=["qkey", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 5, query_mod: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, seed: int = 7, counter: Accumulator | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest others of every row whose id is divisible by ``query_mod``.

    Nearness is the cosine in double precision; ties go to the smaller id. Null ids and vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do
    vectors of another length than the most common one. Rows that repeat an id count once, with
    the smallest of their vectors. Equal vectors are held once for the search: of a group only
    the ``k + 1`` smallest ids can be among the nearest of any query. The router is learned on
    at most ``SAMPLE_ROWS`` vectors drawn by a hash of the id; every row is indexed. Under
    ``2 * PART_ROWS`` vectors are one part. ``counter`` is raised by each pair that is scored. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    spark = vectors.sparkSession
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.where(F.size("v") == width[0]).withColumn("same", F.xxhash64("v")), "vectors")
    by_vector = Window.partitionBy("same", "v").orderBy("vec_id")
    held = stored(rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1), "held")
    count = held.count()
    sample = np.array([r[0] for r in rows.where("vec_id is not null").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE_ROWS).select("v").toLocalIterator()])
    sample = np.random.default_rng(seed).permutation(_unit(np.unique(sample, axis=0)))
    apart = len(sample) // 16 if len(sample) < count else 0  # none where the sample is the table, so that all queries are known
    held_back, seen = sample[:apart], sample[apart:]
    asked = rows.where(F.pmod("vec_id", F.lit(query_mod)) == 0)
    parts = parts_for(len(seen))
    router = fit_router(seen, parts, seed) if parts > 1 else Router(width[0], 1, seed)
    queries = stored(asked.groupBy("same", "v").agg(F.min("vec_id").alias("qkey")), "queries")
    spread = (recall * (1 - recall) / (k * max(1, queries.count()))) ** 0.5  # with few queries, chance alone lowers what they find
    visits = max(min(parts, LEAST_VISITS), visits_for(router, seen, held_back, k, min(0.97, recall + 2 * spread), min(1.0, len(seen) / count))) if parts > 1 else 1

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        to = router.route(_unit(_matrix(batch.column(1))), 1)[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column(0), batch.column(1)], names=["part", "vec_id", "v"])

    index = stored(map_batches(held.select("vec_id", "v"), home, "part int, vec_id long, v array<double>"), "index")
    first, number = shelves_of({r[0]: r[1] for r in index.groupBy("part").count().collect()}, parts)

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        shelf = first[part] + (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % number[part]
        none = pa.nulls(len(part), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(shelf), pa.array(np.zeros(len(part), np.int32)), *batch.columns, none], names=names)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TURN):
                batch = whole.slice(at, TURN)
                to = router.route(_unit(_matrix(batch.column(1))), visits)
                who, part = np.repeat(np.arange(len(to)), to.shape[1]), to.reshape(-1)
                more = number[part]
                who, part = np.repeat(who, more), np.repeat(part, more)
                shelf = first[part] + np.arange(len(part)) - np.repeat(np.cumsum(more) - more, more)
                order = np.lexsort((part, shelf, who))
                who, part, shelf = who[order], part[order], shelf[order]
                starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (shelf[1:] != shelf[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(part)], pa.int32()), pa.array(part.astype(np.int32)))
                n, q = len(starts), pa.array(who[starts])
                yield pa.RecordBatch.from_arrays([pa.array(shelf[starts]), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), batch.column(0).take(q), batch.column(1).take(q), lists], names=names)

    schema = "shelf long, kind int, part int, id long, v array<double>, parts array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    both = map_batches(index, placed, schema).unionByName(queries.select("qkey", "v").mapInArrow(sent, schema))
    dealt = both.repartition("shelf").sortWithinPartitions("shelf", "kind", "part")
    found = dealt.mapInArrow(_searched(k + 1, counter), "qkey long, vec_id long, score double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    who = asked.select(F.col("vec_id").alias("query_id"), "same", "v").join(queries, ["same", "v"]).select("query_id", "qkey")
    answers = who.join(best.select("qkey", "vec_id", "score"), "qkey").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
