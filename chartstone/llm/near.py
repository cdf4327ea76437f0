"""Near copies by shingle similarity: every pair of texts with a Jaccard similarity of at least 4/5.

Shingles: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, the set of a text's 5-word shingles (fewer words: the whole
sequence) as XXH64 with seed 42. Texts link if |A n B| / |A u B| >= 4/5, counted in integers.

Search, by SimHash: each set's fingerprint holds the bits that are set in over half of its hashes; fingerprints that link by their
deletion variants (``simhash.links``) are compared set against set, and what similar ones join needs no further comparison. At this similarity
fingerprints differ in about ten bits, so that finds the closest copies alone.

The rest, exact by prefixes: two sets of n and m shingles that link share at least 4/5 of either, so under any one order of
all shingles their first n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1 have one in common. The order is by hash,
but shingles that are common in a sample come last; the sample moves work, not results. Pairs that meet are
compared set against set, unless the counts of their shingles by low bits already differ too much.

Scale: equal sets are one node. Where many meet at a shingle, each is compared with HUBS of them first; what these links join
needs no further comparison, so a large group of near copies costs a few rows a member, even if not every two of it link. The nodes of
a shingle that are still in different components are then held against each other, in blocks of bounded size, and leave as a pair at the
first shingle they share, if their sizes, the places of the shingle and their sketches allow the similarity. Quadratic is only this
comparison, among what shares a shingle that the sample shows to be rare, and the pairs that come close to the similarity.

Defined results: null and empty texts are equal; repeated shingles count once; repeated rows are in one group; a very long text is one
set; an empty table gives no rows; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartstone.llm.common import growing, majority, release, remove, written
from chartstone.llm.components import components

SHINGLE = 5
SEED = 42
#: Least similarity as a fraction.
LEAST = (4, 5)
#: Texts in the sample for common shingles, and how many of them a common one stands in; at most so many are put last.
SAMPLE, COMMON, MOST_COMMON = 20_000, 10, 100_000
#: Members of a shingle's group that all others are compared with first.
HUBS = 8
#: Places of a sketch at least and at most, and of the one that goes with each shingle of a set, powers of two.
LEAST_PLACES, MOST_PLACES, GROUP_PLACES = 32, 16384, 128
#: First shared shingles of a set that go with each of them: a pair that shares an earlier one of these is left to that one.
EARLIER = 8
#: About so many members of a shingle's group are held against as many others in one piece.
BLOCK = 4096
#: Shingles to a place of the sketch that all pairs are held against, and of the one for those that this lets through.
COARSE, FINE = 8, 2


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space alone
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
    k = min(SHINGLE, len(words))
    ends = [e - 1 for e in starts[k:]]
    parts = (joined[a:b] for a, b in zip(starts, ends))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(ends)).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, by hash with those in ``common`` (sorted) last."""
    n = len(s)
    if not n:
        return s
    keep = n - -(-LEAST[0] * n // LEAST[1]) + 1
    if not len(common):
        return s[:keep]
    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~last], s[last]])[:keep]


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, node, fp, shingles) of each row; th is the text's hash, node that of the set, fp its fingerprint, shingles its 64-bit hashes."""

    def run(batches):
        import xxhash

        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(2)]
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            sets = [s.tobytes() for s in sets]
            nodes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", "fp", "shingles"])

    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, node long, fp long, shingles binary")


def _common(sets: DataFrame, rows: int) -> np.ndarray:
    """The shingles that very many texts of a sample hold."""

    def run(batches):
        for batch in batches:
            for s in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_py(), np.int64))], names=["h"])

    sample = sets.select("shingles") if rows <= SAMPLE else sets.select("shingles").sample(SAMPLE / rows, 1)
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], np.int64))


def _prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, node, n, at): the first shingles of each set, its size and their places from 0."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for node, s in zip(batch.column(0), batch.column(1)):
                s = np.frombuffer(s.as_py(), np.int64)
                first = prefix(s, shared.value)
                k = len(first)
                columns = [pa.array(first), pa.array(np.full(k, node.as_py(), np.int64)), pa.array(np.full(k, len(s), np.int32)), pa.array(np.arange(k, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "n", "at"])

    return sets.select("node", "shingles").mapInArrow(run, "key long, node long, n int, at int")


def sketch(s: np.ndarray, shingles: int) -> bytes:
    """How many shingles fall on each place, up to 255; the places are a power of two, about one for ``shingles``."""
    places = min(MOST_PLACES, max(LEAST_PLACES, 1 << max(0, (len(s) // shingles).bit_length() - 1)))
    return np.minimum(np.bincount(s & (places - 1), minlength=places), 255).astype(np.uint8).tobytes()


def group_sketch(s: np.ndarray) -> bytes:
    """A sketch of GROUP_PLACES whatever the size of the set."""
    return np.minimum(np.bincount(s & (GROUP_PLACES - 1), minlength=GROUP_PLACES), 255).astype(np.uint8).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound on the shingles that only one of two sets holds, from their sketches; the larger is folded to the smaller."""
    x, y = (np.frombuffer(k, np.uint8).astype(np.int32) for k in (a, b))
    p = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, p).sum(axis=0) - y.reshape(-1, p).sum(axis=0)).sum())


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, n, small, coarse, fine), a row for each node."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(s.as_py(), np.int64) for s in batch.column(1)]
            coarse, fine = ([sketch(s, k) for s in found] for k in (COARSE, FINE))
            kinds = [pa.array(k, pa.binary()) for k in (map(group_sketch, found), coarse, fine)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int32()), *kinds], names=["node", "n", "small", "coarse", "fine"])

    schema = "node long, n int, small binary, coarse binary, fine binary"
    return sets.select("node", "shingles").mapInArrow(run, schema).dropDuplicates(["node"])


def _possible(pairs: DataFrame, sketches: DataFrame, kind: str) -> DataFrame:
    """The pairs (u, v) whose sketches don't rule the similarity out."""
    a = sketches.select(F.col("node").alias("_a"), F.col("n").alias("na"), F.col(kind).alias("ka"))
    b = sketches.select(F.col("node").alias("_b"), F.col("n").alias("nb"), F.col(kind).alias("kb"))
    p, q = LEAST

    def run(batches):
        for batch in batches:
            n = (batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()).tolist()
            # d shingles in one set alone: p/q is reached if (p + q) d <= (q - p) n
            keep = pa.array([(p + q) * apart(x, y) <= (q - p) * m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), n)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    joined = pairs.join(a, F.col("u") == F.col("_a")).join(b, F.col("v") == F.col("_b")).select("u", "v", "na", "nb", "ka", "kb")
    return written(joined.mapInArrow(run, "u long, v long"), "possible")


def _verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets link."""
    spark = sets.sparkSession
    coarse = _possible(pairs, sketches, "coarse")
    pairs = _possible(coarse, sketches, "fine")
    remove(spark, coarse.written_to)
    ends = pairs.select(F.col("u").alias("_n")).unionByName(pairs.select(F.col("v").alias("_n"))).distinct()
    found = sets.join(ends, F.col("node") == F.col("_n"), "left_semi").select("node", "shingles").dropDuplicates(["node"])
    found = written(found, "sets")
    a = found.select(F.col("node").alias("_a"), F.col("shingles").alias("sa"))
    b = found.select(F.col("node").alias("_b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(s.as_py(), np.int64) for s in batch.column(i)] for i in (2, 3))
            keep = pa.array([similar(p, q) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    joined = pairs.join(a, F.col("u") == F.col("_a")).join(b, F.col("v") == F.col("_b")).select("u", "v", "sa", "sb")
    out = written(joined.mapInArrow(run, "u long, v long"), "verified")
    remove(spark, found.written_to)
    remove(spark, pairs.written_to)
    return out


def _across(groups: DataFrame) -> DataFrame:
    """(u, v) of each group's nodes in different components whose sizes, places and sketches allow the similarity, at the first shingle they share.

    groups (key, cross, x: structs to, node, n, at, block, small, first): with ``cross`` nodes of one block are left to its own group.
    """
    p, q = LEAST

    def run(batches):
        for batch in batches:
            keys, crosses, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            offsets, items = lists.offsets.to_numpy(), lists.values
            to, node, n, at, block = (items.field(c).to_numpy().astype(np.int64) for c in ("to", "node", "n", "at", "block"))
            small = np.frombuffer(b"".join(items.field("small").to_pylist()), np.uint8).reshape(-1, GROUP_PLACES).astype(np.int16)
            sizes = items.field("first").value_lengths().to_numpy()
            first = np.zeros((len(items), EARLIER), np.int64)
            first[np.arange(EARLIER) < sizes[:, None]] = items.field("first").flatten().to_numpy()
            for key, cross, a, b in zip(keys, crosses, offsets[:-1].tolist(), offsets[1:].tolist()):
                # the shingles before this one; the others' places hold this one, which is not before itself
                here = first[a:b] == key
                before = np.where(here.any(axis=1), here.argmax(axis=1), sizes[a:b])
                earlier = np.where(np.arange(EARLIER) < before[:, None], first[a:b], key)
                for i in range(a, b - 1):
                    rest = slice(i + 1, b)
                    m, k = n[rest], at[rest]
                    # this shingle and all that may follow it; a shared one before it would only lead to the same pair earlier
                    most = np.minimum(np.minimum(n[i], m), np.minimum(at[i], k) + 1 + np.minimum(n[i] - at[i] - 1, m - k - 1))
                    fits = (to[rest] != to[i]) & ((p + q) * most >= p * (n[i] + m))
                    if cross:
                        fits &= block[rest] != block[i]
                    found = np.flatnonzero(fits) + i + 1
                    if not len(found):
                        continue
                    d = np.abs(small[found] - small[i]).sum(axis=1)
                    found = found[(p + q) * d <= (q - p) * (n[i] + n[found])]
                    found = found[~np.isin(earlier[found - a], first[i, : before[i - a]]).any(axis=1)]
                    if len(found):
                        u, v = np.minimum(node[found], node[i]), np.maximum(node[found], node[i])
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return groups.select("key", "cross", "x").mapInArrow(run, "u long, v long")


def _blocks(named: DataFrame, sketches: DataFrame) -> DataFrame:
    """The groups that ``_across`` takes: the nodes (key, node, n, at, to) of each key in several components, every two of its blocks together."""
    sizes = named.groupBy("key").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.count("*").alias("c")).filter("a < b")
    sizes = sizes.select(F.col("key").alias("_key"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    members = named.join(sizes, F.col("key") == F.col("_key")).select("key", "node", "n", "at", "to", "blocks")
    in_order = F.array_sort(F.collect_list(F.struct("at", "key")))
    first = members.groupBy(F.col("node").alias("_of")).agg(F.transform(F.slice(in_order, 1, EARLIER), lambda x: x["key"]).alias("first"))
    small = sketches.select(F.col("node").alias("_node"), "small")
    members = members.join(small, F.col("node") == F.col("_node")).join(first, F.col("node") == F.col("_of"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("to", "node", "n", "at", "block", "small", "first")
    groups = members.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(member).alias("x"))
    return groups.select("key", (F.col("low") < F.col("high")).alias("cross"), "x")


def _by_fingerprint(sets: DataFrame, sketches: DataFrame, fingerprint_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (u, v) between similar nodes whose fingerprints are equal or link; a fingerprint's smallest node stands for it."""
    spark = sets.sparkSession
    nodes = written(sets.select("node", "fp").distinct(), "nodes")
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least")
    near = fingerprint_links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(f"_f{k}"), F.col("least").alias(k)) for k in ("u", "v"))
    same = nodes.join(growing(a), F.col("fp") == F.col("_fu")).select("u", F.col("node").alias("v")).filter("u <> v")
    other = near.select(F.col("u").alias("_p"), F.col("v").alias("_q")).join(growing(a), F.col("_p") == F.col("_fu")).join(growing(b), F.col("_q") == F.col("_fv")).select("u", "v")
    pairs = written(same.unionByName(other).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    for old in (nodes, least, near):
        remove(spark, old.written_to)
    out = _verified(pairs, sets, sketches)
    remove(spark, pairs.written_to)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) that ``roots`` (id, to) don't join."""
    a, b = (roots.select(F.col("id").alias(f"_{k}"), F.col("to").alias(f"_to_{k}")) for k in ("u", "v"))
    joined = pairs.join(growing(a), F.col("u") == F.col("_u"), "left").join(growing(b), F.col("v") == F.col("_v"), "left")
    return joined.filter(F.coalesce("_to_u", "u") != F.coalesce("_to_v", "v")).select("u", "v")


def links(sets: DataFrame, rows: int, fingerprint_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (u, v) between different nodes of a written table of ``shingle_sets``: their components are those of all similar pairs."""
    spark = sets.sparkSession
    sketches = written(_sketches(sets), "sketches")
    closest = _by_fingerprint(sets, sketches, fingerprint_links)
    joined = components(closest)
    release(spark)
    prefixes = _prefixes(sets, _common(sets, rows))
    ends = F.min("node").alias("low"), F.max("node").alias("high")
    shared = written(prefixes.groupBy("key").agg(*ends).filter("low < high").select(F.col("key").alias("_key")), "shared")
    hits = prefixes.join(shared, F.col("key") == F.col("_key"), "left_semi").distinct()
    hits = written(hits, "hits")
    remove(spark, shared.written_to)
    place = F.struct("node", "n", "at")
    of_key = hits.groupBy("key").agg(*[F.min(F.when(F.pmod("node", F.lit(HUBS)) == i, place)).alias(f"h{i}") for i in range(HUBS)])
    of_key = written(of_key.select(F.col("key").alias("_key"), F.array_compact(F.array(*[f"h{i}" for i in range(HUBS)])).alias("hubs")), "hubs")
    stars = hits.join(of_key, F.col("key") == F.col("_key")).select("node", "n", "at", F.explode("hubs").alias("h"))
    n, at, m, k = F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at")
    # this shingle and all that may follow it; a shared one before it would only lead to the same pair earlier
    most = F.least(n, m, F.least(at, k) + 1 + F.least(n - at, m - k) - 1)
    stars = stars.filter((F.col("node") != F.col("h.node")) & ((LEAST[0] + LEAST[1]) * most >= LEAST[0] * (n + m)))
    stars = stars.select(F.least("node", "h.node").alias("u"), F.greatest("node", "h.node").alias("v")).distinct()
    near = written(_apart(stars, joined), "near")
    remove(spark, of_key.written_to)
    first = closest.unionByName(_verified(near, sets, sketches))

    roots = components(first)
    named = hits.join(roots, F.col("node") == F.col("id"), "left").select("key", "node", "n", "at", F.coalesce("to", "node").alias("to"))
    named = written(named, "named")
    pairs = written(_across(_blocks(named, sketches)).distinct().join(near, ["u", "v"], "left_anti"), "pairs")
    second = _verified(pairs, sets, sketches)
    for old in (hits, near, named, pairs, sketches):
        remove(spark, old.written_to)
    return first.unionByName(second)


def near_copies(df: DataFrame, fingerprint_links: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, component), a row for each row of df; th is the text's hash (xxhash64), component a node of the group.

    ``fingerprint_links`` takes different fingerprints (fp) and gives a written table (u, v) of links between them.
    """
    sets = written(shingle_sets(df, id_col, text_col), "shingles")
    found = links(sets, sets.count(), fingerprint_links)
    roots = components(found)
    # both sides come straight from files, so adaptive execution may split a set that very many share
    named = written(roots.select(F.col("id").alias("_id"), F.col("to")), "components")
    out = written(sets.select("doc_id", "th", "node").join(named, F.col("node") == F.col("_id"), "left").select("doc_id", "th", F.coalesce("to", "node").alias("component")), "near_copies")
    remove(df.sparkSession, sets.written_to)
    return out
