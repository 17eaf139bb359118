"""Approximate nearest neighbours: balanced posting lists (operator 6).

Centroids are fitted on a bounded sample and linked into a graph, which is held in memory. Every vector goes to its
nearest centroid's posting list, and also to a further list whose centroid is nearly as near (boundary replicas). A
query walks the graph to its nearest centroids and takes those of a number of lists whose distance is within a ratio of
the nearest; both are set so that the sample's own neighbours, found by brute force, reach the target recall at the
least cost. There are about two lists for each unit of the number of vectors' square root. Neighbouring lists share a
bucket of bounded size; a longer list is cut into several, and so are the queries of a bucket that very many take, so
that a task holds a bounded part of either. A bucket reports the k + 1 best of each query.

Equal vectors are searched once: a class keeps its smallest vec_ids, as many as a result can hold and one more.
Nearness is the inner product in double precision, summed from the first component to the last. Lists are chosen by
Euclidean distance between unit vectors' directions, with the norm as a further component if norms differ.

Vectors that are null, empty, all zero, hold null or non-finite components, or have no vec_id take no part. A vec_id on
several rows counts each; ties go to the smaller vec_id. Vectors of differing length are compared within their own
length, and each length has an index of its own. A length of at most 4 * (k + 1) distinct vectors is one list: any fewer
than k + 1 to each of four lists could not even fill a result. An empty table gives an
empty result. Further columns, whatever their names, have no effect.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.runtime import Scratch, partitions

HITS = "qid long, vid long, first long, score double"


class Centroids:
    """Centroids in a k-nearest-neighbour graph that a best-first walk searches."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, replicas: int, boundary: float, target: float, degree: int = 24, rounds: int = 8, trials: int = 512, seed: int = 7):
        rng = np.random.default_rng(seed)
        lists = max(1, min(lists, len(sample)))
        c = sample[rng.choice(len(sample), lists, replace=False)].copy()
        for _ in range(rounds):
            near = self.nearest(sample, c)
            sums = np.zeros_like(c)
            np.add.at(sums, near, sample)
            n = np.bincount(near, minlength=lists)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
            empty = np.flatnonzero(n == 0)
            if len(empty):  # an empty list takes a member of the largest, which keeps lists balanced
                crowd = np.flatnonzero(near == n.argmax())
                c[empty] = sample[rng.choice(crowd, len(empty))]
        self.points = c = c[self.along(c)]
        d = self.distances(c, c)
        np.fill_diagonal(d, np.inf)
        near = np.zeros((lists, lists), bool)
        np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, : min(degree, lists - 1)], True, axis=1)
        self.links = [np.flatnonzero(x) for x in near | near.T]  # both ways, else what is no one's neighbour is out of reach
        self.entries = rng.choice(lists, min(lists, 8), replace=False)
        self.replicas, self.boundary = min(replicas, lists), boundary
        # by the sample's true neighbours: the ratio of list distances and the number of lists that reach the target share
        # of them at the least cost
        chosen = rng.choice(len(sample), min(trials, len(sample)), replace=False)
        d = self.distances(sample[chosen], c)
        ratios, ranks = d / np.maximum(d.min(1, keepdims=True), 1e-12), d.argsort(1, kind="stable").argsort(1, kind="stable")
        rows, places = self.assign(sample)
        far, late = [], []
        for at, ratio, rank in zip(chosen, ratios, ranks, strict=True):
            score = (sample * sample[at]).sum(1)
            score[at] = -np.inf
            top = np.argpartition(-score, min(k, len(score) - 1))[:k]
            nearest = np.full(len(sample), lists)
            np.minimum.at(nearest, rows, rank[places])
            late.append(nearest[top])
            far.append(ratio[np.argsort(rank)][nearest[top]])
        far, late = np.concatenate(far), np.concatenate(late)
        best = np.inf
        for share in np.linspace(target, 1, 6):
            keep = int(np.quantile(late, share, method="higher")) + 1
            held = np.where(late < keep, far, np.inf)
            ratio = float(np.partition(held, int(target * (len(held) - 1)))[int(target * (len(held) - 1))]) + 1e-9
            cost = ((ratios <= ratio) & (ranks < keep)).sum()
            if cost < best:
                best, self.ratio, self.keep = cost, ratio, keep

    @classmethod
    def along(cls, c: np.ndarray) -> np.ndarray:
        """An order of centroids in which neighbours are close: halved again and again across the widest direction."""
        out, open_ = [], [np.arange(len(c))]
        while open_:
            part = open_.pop()
            if len(part) <= 2:
                out.append(part)
                continue
            x = c[part] - c[part].mean(0)
            turn = np.argsort(x @ x[(x**2).sum(1).argmax()], kind="stable")
            open_ += [part[turn[len(part) // 2 :]], part[turn[: len(part) // 2]]]
        return np.concatenate(out)

    @staticmethod
    def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]).clip(0))

    @classmethod
    def nearest(cls, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([cls.distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and a list of each: the nearest, and those within `boundary` of its distance, `replicas` at most."""
        rows, places = [], []
        for i in range(0, len(x), 2048):
            d = self.distances(x[i : i + 2048], self.points)
            near = np.argpartition(d, self.replicas - 1, axis=1)[:, : self.replicas]
            dist = np.take_along_axis(d, near, 1)
            r, j = np.nonzero(dist <= self.boundary * dist.min(1, keepdims=True))
            rows.append(i + r)
            places.append(near[r, j])
        return np.concatenate(rows), np.concatenate(places)

    def walk(self, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """The `keep` nearest centroids that a best-first walk finds, nearest first, with their distances."""
        met = set(self.entries.tolist())
        open_ = sorted(zip(np.sqrt(((self.points[list(met)] - x) ** 2).sum(1)).tolist(), met, strict=True))
        found = [(-d, -i) for d, i in open_]  # a heap whose first is the farthest of the `keep` nearest
        heapq.heapify(found)
        while open_:
            d, i = heapq.heappop(open_)
            if len(found) >= keep and d > -found[0][0]:
                break
            new = [j for j in self.links[i].tolist() if j not in met]
            met.update(new)
            for e, j in zip(np.sqrt(((self.points[new] - x) ** 2).sum(1)).tolist(), new, strict=True):
                if len(found) < keep or e <= -found[0][0]:
                    heapq.heappush(open_, (e, j))
                    heapq.heappush(found, (-e, -j))
                    if len(found) > keep:
                        heapq.heappop(found)
        found = sorted((-d, -i) for d, i in found)[:keep]
        return np.array([i for _, i in found]), np.array([d for d, _ in found])

    def lists_of(self, x: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
        """The lists to search: by the distance ratio, and further ones until they hold `least` distinct vectors.

        `held`: the lists' sizes. A vector is in at most `replicas` lists.
        """
        keep = max(2 * self.keep, 64)  # a walk that looks further than it has to misses less
        while True:
            at, d = self.walk(x, keep)
            n = max(int((d[: self.keep] <= self.ratio * d[0] + 1e-12).sum()), int(np.searchsorted(np.cumsum(held[at]), self.replicas * least)) + 1)
            if n <= len(at):
                return at[:n]
            if keep >= len(self.points):  # the walk has no more: all lists by their distance
                return np.arange(len(self.points))
            keep *= 2


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, each summed from the first component to the last, whatever its place in the arrays."""
    out = np.zeros((len(q), len(v)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * v[None, :, d]
    return out


def direction(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors as points whose Euclidean order follows the inner product: with the missing norm as a last component."""
    return np.column_stack([v, np.sqrt((largest**2 - (v**2).sum(1)).clip(0))])


class Buckets:
    """Lists dealt to buckets of at most `rows` postings, in the order of centroids; longer lists have several segments."""

    def __init__(self, held: np.ndarray, rows: int):
        self.of, self.segments, filled = np.zeros(len(held), np.int32), [], rows + 1
        for i, n in enumerate(held.tolist()):
            if filled + n > rows:
                self.segments.append(max(1, -(-n // rows)))
                filled = 0
            filled += n
            self.of[i] = len(self.segments) - 1
        self.segments = np.array(self.segments, np.int32)


def scanner(dim: int | None, k: int):
    """A function (queries, vectors) of a bucket's segment -> each query's k + 1 best in its lists, ties by the first id."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        take = lambda t, n: t.column(n).combine_chunks()
        size = dim or len(right.column("v")[0])
        q, qid = take(left, "v").flatten().to_numpy().reshape(-1, size), take(left, "qid").to_numpy()
        vid, at, of = np.unique(take(right, "vid").to_numpy(), return_index=True, return_inverse=True)  # replicas once
        v, first = take(right, "v").flatten().to_numpy().reshape(-1, size)[at], take(right, "first").to_numpy()[at]
        posted, asked = take(right, "list").to_numpy(), take(left, "lists")
        asked_row, asked_list = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
        members = {x: np.unique(of[posted == x]) for x in np.unique(posted).tolist()}
        m, out = min(k + 1, len(v)), []
        rows = max(1, min(256, (1 << 22) // len(v)))
        for i in range(0, len(q), rows):
            part = q[i : i + rows]
            s = np.full((len(part), len(v)), -np.inf)
            low, high = np.searchsorted(asked_row, (i, i + len(part)))
            order = np.argsort(asked_list[low:high], kind="stable") + low
            for x, own in ((asked_list[g[0]], asked_row[g] - i) for g in np.split(order, np.flatnonzero(np.diff(asked_list[order])) + 1) if len(g)):
                if x in members:
                    s[np.ix_(own, members[x])] = inner(part[own], v[members[x]])
            least = np.partition(s, len(v) - m, axis=1)[:, len(v) - m]
            r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            turn = np.lexsort((first[c], -s[r, c], r))
            r, c = r[turn], c[turn]
            good = np.arange(len(r)) - np.searchsorted(r, r) <= k  # of more ties the first
            out.append((qid[i + r[good]], vid[c[good]], first[c[good]], s[r[good], c[good]]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    return scan


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), dim and a key of equal vectors, without those that take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0


def classes(rows: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """v, dim, ids: distinct vectors with their `keep` smallest vec_ids (kept by salted part first, then in all)."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    part = Window.partitionBy("v", "salt").orderBy("vec_id")
    first = salted.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= keep)
    return first.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids")).withColumn("dim", F.size("v"))


def sample_index(own: DataFrame, dim: int, total: int, k: int, sample_rows: int, max_lists: int, boundary: float, replicas: int, target: float) -> tuple[Centroids, float]:
    """Centroids fitted by one task on at most `sample_rows` vectors, and the largest norm of all."""
    largest = own.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    lists = max(1, min(max_lists, int(2 * total**0.5)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for b in batches if b.num_rows]
        if parts:
            made = Centroids(direction(np.concatenate(parts), largest), lists, k, replicas, boundary, target)
            yield pa.record_batch([pa.array([pickle.dumps(made)], pa.binary())], names=["index"])

    sample = own.orderBy(F.xxhash64("vid"), "vid").limit(sample_rows).select("v").coalesce(1)
    return pickle.loads(sample.mapInArrow(fit, "index binary").first()["index"]), largest


def indexed(own: DataFrame, mine: DataFrame, dim: int, total: int, k: int, scratch: Scratch, bucket_rows: int, bucket_bytes: int, query_rows: int, **fitted) -> DataFrame:
    """The hits of the queries `mine` among the vectors `own`, all of `dim` components."""
    tasks = partitions(own.sparkSession)  # a number that is kept: little data is much work here
    made, largest = sample_index(own, dim, total, k, **fitted)
    context = own.sparkSession.sparkContext
    index = context.broadcast(made)  # `max_lists` centroids at most

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i in range(0, len(v), 2048):
                rows, places = index.value.assign(direction(v[i : i + 2048], largest))
                part = batch.slice(i, 2048).take(pa.array(rows))
                yield pa.record_batch([*part.columns, pa.array(places.astype(np.int32))], names=["v", "vid", "first", "list"])

    posted = scratch.write(own.select("v", "vid", F.col("ids")[0].alias("first")).mapInArrow(post, "v array<double>, vid long, first long, list int"), "postings")
    held = np.zeros(len(made.points), np.int64)
    for r in posted.groupBy("list").count().collect():  # `max_lists` rows at most
        held[r["list"]] = r["count"]
    # a bucket a task, as far as its size allows: each reports hits of its own
    buckets = Buckets(held, min(max(-(-int(held.sum()) // tasks), bucket_rows), max(bucket_bytes // (8 * dim), 1)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = np.column_stack([v * (largest / np.sqrt((v**2).sum(1)))[:, None], np.zeros(len(v))])
            rows, dealt, lists = [], [], []
            for r in range(len(x)):
                taken = index.value.lists_of(x[r], held, k + 1).astype(np.int32)
                at = buckets.of[taken]
                for bucket in np.unique(at).tolist():
                    rows.append(r)
                    dealt.append(bucket)
                    lists.append(taken[at == bucket])
            yield pa.record_batch([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(dealt, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["v", "qid", "bucket", "lists"])

    routed = scratch.write(mine.select("v", "qid").repartition(tasks, "qid").mapInArrow(probe, "v array<double>, qid long, bucket int, lists array<int>"), "routed")
    asked = np.ones(len(buckets.segments), np.int64)
    for r in routed.groupBy("bucket").count().collect():  # as many as lists at most
        asked[r["bucket"]] = r["count"]
    parts = -(-asked // query_rows)
    index.unpersist()
    of = lambda values, at: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)
    if buckets.segments.max() == 1 and parts.max() == 1:
        left, right = routed.withColumn("part", F.lit(0)), posted.withColumn("bucket", of(buckets.of, F.col("list"))).withColumn("part", F.lit(0))
    else:  # every part of the queries meets every segment of the vectors
        cuts = own.sparkSession.createDataFrame([(i, int(s), int(p)) for i, (s, p) in enumerate(zip(buckets.segments, parts, strict=True))], "bucket int, segments int, parts int")
        left = routed.join(F.broadcast(cuts), "bucket")
        left = left.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("segments") - 1), lambda s: s * F.col("parts") + F.pmod(F.hash("qid"), F.col("parts")))))
        right = posted.withColumn("bucket", of(buckets.of, F.col("list"))).join(F.broadcast(cuts), "bucket")
        right = right.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.pmod(F.hash("vid"), F.col("segments")) * F.col("parts") + p)))
    left = left.select("v", "qid", "lists", "bucket", "part").repartition(tasks, "bucket", "part")
    right = right.select("v", "vid", "first", "list", "bucket", "part").repartition(tasks, "bucket", "part")
    return left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInArrow(scanner(dim, k), HITS)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 20_000, max_lists: int = 4096, boundary: float = 1.03, replicas: int = 2, target: float = 0.94, bucket_rows: int = 1024, bucket_bytes: int = 64 << 20, query_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row of `queries` (rows of `vectors`), but itself.

    The sample of at most `sample_rows` distinct vectors fits `max_lists` centroids at most; every vector is indexed.
    A bucket holds from `bucket_rows` vectors to `bucket_bytes` of them, and meets `query_rows` queries at a time.
    """
    scratch = Scratch(vectors.sparkSession)
    base = scratch.write(classes(usable(vectors), k + 1).withColumn("vid", F.xxhash64("v")), "vectors")
    asked_rows = scratch.write(usable(queries).withColumn("qid", F.xxhash64("v")), "queries")
    asked = asked_rows.select("v", "qid").distinct().withColumn("dim", F.size("v"))
    sizes = base.groupBy("dim").agg(F.count("*").alias("n"))
    large = [(r["dim"], r["n"]) for r in sizes.filter(F.col("n") > 4 * (k + 1)).orderBy("dim").collect()]  # a list would be a handful of vectors
    rest = ~F.col("dim").isin([d for d, _ in large])
    few = asked.filter(rest).select("v", "qid", F.array(F.lit(0)).alias("lists"), "dim")
    hits = few.groupBy("dim").cogroup(base.filter(rest).select("v", "vid", F.col("ids")[0].alias("first"), F.lit(0).alias("list"), "dim").groupBy("dim")).applyInArrow(scanner(None, k), HITS)
    for dim, total in large:
        own, mine = base.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim)
        hits = hits.unionByName(indexed(own, mine, dim, total, k, scratch, bucket_rows, bucket_bytes, query_rows, sample_rows=sample_rows, max_lists=max_lists, boundary=boundary, replicas=replicas, target=target))
    # k + 1 rows hold every query's own k best, as only its own row is left out; as every class has a row that comes
    # before those of later classes, k + 1 classes hold these rows
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first")
    hits = hits.distinct().withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    named = hits.join(base.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    named = named.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    each = asked_rows.select("qid", F.col("vec_id").alias("query_id")).join(named, "qid").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
