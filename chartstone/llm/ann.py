"""Approximate nearest neighbours by an adaptive dimension scan.

Index: unit vectors are rotated by one random orthogonal matrix and dealt to the inverted list of their nearest centre. There are
LISTS_BY_ROOT * sqrt(rows) lists, MOST_LISTS at most, so a list and the centres that a row is held against grow with the root of the rows
only. The centres, and the number of lists to probe, are fitted on a bounded sample (SAMPLE_BY_LIST rows a list, FIT_ROWS at least): the
smallest number of lists that hold TARGET of the sample's own nearest neighbours. Every row is indexed. A query probes on
beyond that number until the lists it has hold more than k rows, so it gets k neighbours whenever there are as many.

Scan, in two passes: first each query's own list, then the others that it probes, less those that can't hold a nearer row (the
distance to the centre less the list's radius is beyond the k-th best distance of the first pass). A list is held in blocks of
columns. Partial distances grow block by block; after d of D rotated dimensions a candidate is abandoned if its partial distance,
scaled by D/d, exceeds the k-th best distance so far by the factor (1 + EPSILON/sqrt(d))^2: the hypothesis that its full
distance is below that is then rejected. The k-th best distance is carried from the first pass to the second and falls with
every STEP_ROWS candidates. Survivors are scored by cosine in double precision on the original vectors.

Scale: equal vectors are one class in the index, with the K+1 smallest ids of its members, so a vector that a
third of the rows share costs one row. Lists are cut into parts of PART_ROWS rows by hash and the
queries of a part into blocks of QUERY_ROWS; (list, part, block) is the unit of work, so no task sees a
whole hot list. Row counts and radii by list, and the fitted centres, are all that reaches the driver.

Defined results: vectors null, zero, or with null or non-finite components take no part, as query or
candidate; a query with fewer than k candidates returns them all; ties go to the smaller vec_id; rows that repeat an id and a vector
are candidates as often as they stand there, but never of their own id; an empty table gives no rows. A null id takes no part. Vectors
of another length than the most frequent one (of equal counts: the smaller) take no part. Only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartstone.llm.common import remove, written

K = 5
EVERY = 50
#: Lists by the root of the rows, and their bounds.
LISTS_BY_ROOT, LEAST_LISTS, MOST_LISTS = 0.5, 16, 4096
#: Rows on which centres and the number of probes are fitted: so many a list, and so many at least.
SAMPLE_BY_LIST, FIT_ROWS = 16, 16384
FIT_QUERIES = 400
TARGET = 0.97
EPSILON = 2.1
BLOCK = 16
PART_ROWS = 4096
QUERY_ROWS = 512
#: Candidates between two looks at the k-th best distance; share of live pairs below which pairs are followed one by one.
STEP_ROWS, SPARSE = 1024, 0.05


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dims: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def list_count(rows: int) -> int:
    """Lists for so many rows."""
    return int(min(MOST_LISTS, max(LEAST_LISTS, LISTS_BY_ROOT * math.sqrt(rows))))


def fit(sample: np.ndarray, lists: int, target: float = TARGET, seed: int = 42) -> tuple[np.ndarray, int]:
    """Spherical k-means centres, and how many nearest lists hold ``target`` of the true neighbours in the sample."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample) // 8))
    centres = sample[rng.choice(len(sample), lists, replace=False)]

    def nearest_centre() -> np.ndarray:
        return np.concatenate([(sample[a : a + 8192] @ centres.T).argmax(1) for a in range(0, len(sample), 8192)])

    for _ in range(8):
        near = nearest_centre()
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    near = nearest_centre()
    picked = rng.choice(len(sample), min(FIT_QUERIES, len(sample)), replace=False)
    sims = sample[picked] @ sample.T
    sims[np.arange(len(picked)), picked] = -2
    k = min(K, len(sample) - 1)
    if k < 1:
        return centres, lists
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(sample[picked] @ centres.T), axis=1), axis=1)  # rank of each list for each query
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel()) + 1
    return centres, int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])


def scan_part(q: np.ndarray, p: np.ndarray, bound: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row of p) that survive.

    q and p are rotated unit vectors, ``bound`` the best such distances known so far (infinite: none). What survives holds the
    ``keep`` nearest rows of each query that are within its bound, up to the test's error.
    """
    dims = p.shape[1]
    kth = np.array(bound, np.float64)
    found_q, found_p, found_d = [], [], []
    for at in range(0, len(p), STEP_ROWS):
        part = p[at : at + STEP_ROWS]
        rows = np.arange(len(part))
        partial = np.zeros((len(q), len(part)))
        alive = np.ones((len(q), len(part)), bool)
        pairs = None  # (query, row, partial) once few pairs are alive
        for a in range(0, dims, BLOCK):
            d = min(a + BLOCK, dims)
            qb = q[:, a:d]
            factor = (1 + EPSILON / math.sqrt(d)) ** 2 * d / dims if d < dims else 1 + 1e-9
            limit = kth * factor + 1e-12
            if pairs is None:
                pb = part[rows, a:d]
                partial += (qb * qb).sum(1)[:, None] + (pb * pb).sum(1)[None, :] - 2 * (qb @ pb.T)
                alive &= partial <= limit[:, None]
                live = np.count_nonzero(alive)
                if live < SPARSE * alive.size:
                    i, j = np.nonzero(alive)
                    pairs = (i, rows[j], partial[i, j])
                else:
                    some = alive.any(axis=0)
                    if not some.all():  # rows that every query has abandoned
                        rows, partial, alive = rows[some], partial[:, some], alive[:, some]
            else:
                i, j, x = pairs
                x = x + ((qb[i] - part[j, a:d]) ** 2).sum(1)
                stay = x <= limit[i]
                pairs = (i[stay], j[stay], x[stay])
        if pairs is None:
            i, j = np.nonzero(alive)
            pairs = (i, rows[j], partial[i, j])
        i, j, x = pairs
        found_q.append(i)
        found_p.append(j + at)
        found_d.append(x)
        # each query's smallest ``keep`` of these, by places in a table of as many columns
        order = np.lexsort((x, i))
        i, x = i[order], x[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        few = place < keep
        new = np.full((len(q), keep), np.inf)
        new[i[few], place[few]] = x[few]
        if at == 0:
            own = np.sort(new, axis=1)
        else:
            own = np.sort(np.concatenate([own, new], axis=1), axis=1)[:, :keep]
        kth = np.minimum(bound, own[:, -1])
    i, j, x = (np.concatenate(f) for f in (found_q, found_p, found_d))
    stay = x <= kth[i] * (1 + 1e-9) + 1e-12
    return i[stay], j[stay]


def _in_range(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither vanish nor overflow; exact, and without effect on a cosine."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def paired_cosine(q: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine in double precision, on the vectors as they are, of the pairs (q[i], p[j])."""
    out = np.empty(len(i))
    for a in range(0, len(i), 4096):
        x, y = _in_range(q[i[a : a + 4096]]), _in_range(p[j[a : a + 4096]])
        out[a : a + 4096] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return out


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    head = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if head is None:
        return spark.createDataFrame([], result)
    dims = head["n"]
    rows = rows.filter(F.size("v") == dims)
    is_query = F.col("id") % every == 0

    # equal vectors are one class: its k+1 smallest ids, and those of them that ask
    by_id = Window.partitionBy("v").orderBy("id")
    smallest = rows.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    classes = smallest.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members"))
    asked = rows.filter(is_query).select("v").distinct().withColumn("asks", F.lit(True))
    classes = classes.join(asked, "v", "left").select(F.element_at("members", 1).alias("class"), "v", "members", F.coalesce("asks", F.lit(False)).alias("asks"))
    classes = written(classes, "classes")

    total = classes.count()
    sample_rows = max(FIT_ROWS, SAMPLE_BY_LIST * list_count(total))
    share = int(min(1.0, 1.3 * sample_rows / max(1, total)) * (1 << 20))
    sampled = classes.select("class", "v").filter(F.pmod(F.xxhash64("class"), 1 << 20) <= share)
    sampled = sampled.orderBy(F.xxhash64("class"), "class").limit(sample_rows).toPandas()
    centres, probes = fit(unit(np.stack(sampled["v"].to_numpy())), list_count(total))
    rotate = rotation(dims)

    def deal(batches):
        for batch in batches:
            sims = unit(np.stack(batch["v"].to_numpy())) @ centres.T
            near = sims.argmax(axis=1)
            batch["list"] = near.astype(np.int32)
            batch["far"] = np.sqrt(np.maximum(0.0, 2 - 2 * sims[np.arange(len(near)), near]))
            yield batch[["class", "v", "asks", "list", "far"]]

    dealt = classes.select("class", "v", "asks").mapInPandas(deal, "class long, v array<double>, asks boolean, list int, far double")
    dealt = written(dealt, "dealt")
    held, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        held[r["list"]], radius[r["list"]] = r["n"], r["far"]
    parts = -(-held // PART_ROWS)
    keep = k + 1

    def scanned(asking: DataFrame) -> DataFrame:
        """(query, class, score) of a written table (class, v, list, bound) of queries and the lists they probe."""
        counts = np.zeros(len(centres), np.int64)
        for r in asking.groupBy("list").count().collect():
            counts[r["list"]] = r["count"]
        blocks = -(-counts // QUERY_ROWS)
        # a row a list, MOST_LISTS at most
        lists = [(i, int(parts[i]), int(blocks[i])) for i in range(len(centres)) if parts[i] and blocks[i]]
        units = F.broadcast(spark.createDataFrame(lists, "list int, parts int, blocks int"))
        spread = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
        # a candidate goes to its part, once for each block of queries; a query to its block, once for each part
        cand = dealt.select("class", "v", "list").join(units, "list").withColumn("part", spread("parts"))
        cand = cand.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        quer = asking.join(units, "list").withColumn("block", spread("blocks"))
        quer = quer.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def scan(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            if len(q) and len(c):
                qv, cv = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy())
                qid, cid = q["class"].to_numpy(), c["class"].to_numpy()
                i, j = scan_part(unit(qv) @ rotate, unit(cv) @ rotate, q["bound"].to_numpy(), keep)
                score = paired_cosine(qv, cv, i, j)
                order = np.lexsort((cid[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                few = np.arange(len(i)) - np.searchsorted(i, i, side="left") < keep
                out = [qid[i[few]], cid[j[few]], score[few]]
            return pd.DataFrame(dict(zip(["query", "class", "score"], out)))

        work = ["list", "part", "block"]
        left, right = quer.select(*work, "class", "v", "bound"), cand.select(*work, "class", "v")
        hits = left.groupBy(*work).cogroup(right.groupBy(*work)).applyInPandas(scan, "query long, class long, score double")
        return written(hits, "hits")

    none = F.lit(float("inf"))
    own = written(dealt.filter("asks").select("class", "v", "list", none.alias("bound")), "own")
    if own.isEmpty():
        return spark.createDataFrame([], result)
    first = scanned(own)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    kth = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == keep)
    kth = kth.select(F.col("query").alias("_q"), (2 - 2 * F.col("score")).alias("_b"))
    bounded = own.select("class", "v", "list").join(kth, F.col("class") == F.col("_q"), "left")
    bounded = bounded.select("class", "v", "list", F.greatest(F.coalesce("_b", none), F.lit(0.0)).alias("bound"))

    def probe(batches):
        for batch in batches:
            sims = unit(np.stack(batch["v"].to_numpy())) @ centres.T
            near = np.argsort(-sims, axis=1, kind="stable")
            sofar = np.cumsum(held[near], axis=1)
            rank = np.arange(near.shape[1])[None, :]
            # the fitted number of lists, and on until more than k rows are held by those before
            wanted = (rank < probes) | (np.concatenate([np.zeros((len(near), 1), np.int64), sofar[:, :-1]], axis=1) < keep)
            to_centre = np.sqrt(np.maximum(0.0, 2 - 2 * np.take_along_axis(sims, near, 1)))
            bound = batch["bound"].to_numpy()[:, None]
            wanted &= (to_centre - radius[near] <= np.sqrt(bound) * (1 + 1e-9) + 1e-9) & (near != batch["list"].to_numpy()[:, None]) & (held[near] > 0)
            i, j = np.nonzero(wanted)
            for a in range(0, len(i), 4096):  # a vector is copied for each list that it probes
                x, y = i[a : a + 4096], j[a : a + 4096]
                yield batch[["class", "v", "bound"]].iloc[x].assign(list=near[x, y].astype(np.int32))[["class", "v", "list", "bound"]]

    others = written(bounded.mapInPandas(probe, "class long, v array<double>, list int, bound double"), "others")
    hits = first if others.isEmpty() else first.unionByName(scanned(others))
    top = hits.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= keep)
    members = classes.select(F.col("class").alias("c"), "members")
    found = top.join(members, top["class"] == members["c"]).select("query", F.transform("members", lambda m: F.struct((-F.col("score")).alias("s"), m.alias("id"))).alias("found"))
    found = found.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, (k + 1) * (k + 1)).alias("found"))
    found = written(found.withColumnRenamed("query", "class"), "found")

    # each asking row gets its class's neighbours, less itself
    named = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    answered = classes.filter("asks").select("class", "v").join(found, "class")
    answered = written(answered.select("v", "found"), "answered")
    joined = named.join(answered, named["qv"] == answered["v"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = joined.select("query_id", F.posexplode(others).alias("n", "hit"))
    return ranked.select("query_id", (F.col("n") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
