"""SimHash near-duplicates with deletion-variant signatures.

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles (repeats included; fewer words:
the whole sequence), XXH64 with seed 42 of each; a bit is 1 if set in over half of them. Two
fingerprints link if at most 4 of 64 bits differ.

Search: the 64 bits are cut into 3 segments. Of 4 differing bits at most one falls into some segment, so
each fingerprint is indexed under its one-wildcard segment variants: for each bit position, the
position and its segment without that bit. Equal variants are joined and verified. A pair
meets in each variant that hides its difference and is reported in one alone: the first segment with
at most one differing bit, at that bit, or at the segment's first bit if none differs.

Scale: exact duplicates of a fingerprint collapse before the join, so groups of copies cost one row;
pairs are verified inside the join, and only links leave it. Each variant's members are held against its smallest one first, and
only what that leaves in different components is paired, so dense groups are stars. Components come from ``components``. No join
is broadcast, so the driver holds nothing that grows.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows share a component; a row with a
null doc_id gets the smallest id of its component, null if no row of it has an id; rows that share a doc_id but not the text
go by their own fingerprints; a very long text is hashed in parts of 32,768 shingles; an empty table gives no rows; only the id and text
columns are read, so others may have any name, and ``keep_first`` returns them untouched.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartstone.llm.common import free_names, growing, own_columns, remove, written
from chartstone.llm.components import components
from chartstone.llm.near import near_copies

SHINGLE = 4
SEED = 42
BITS = 64
MAX_DIFFERENT = 4
#: Segments as (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda a, n: a + n + 1, initial=0))
    k = min(SHINGLE, len(words))
    ends = [e - 1 for e in starts[k:]]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, 1 << 15):  # a very long text goes in parts
        part = [joined[a:b] for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])]
        h = np.fromiter(map(digest, part, repeat(SEED)), np.uint64, len(part))
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of whole texts; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fp: Column) -> Column:
    """The keys of the 64 one-wildcard segment variants, in the order of their wildcard bits."""
    keys = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [segment.bitwiseAND(F.lit(~(1 << b) & ((1 << bits) - 1))).bitwiseOR(F.lit((first + b) << 32)) for b in range(bits)]
    return F.array(*keys)


def _reported_at(a: Column, b: Column) -> Column:
    """The wildcard bit at which the pair is reported."""
    x = a.bitwiseXOR(b)
    out = F.lit(-1)
    for first, bits in reversed(SEGMENTS):
        part = F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << bits) - 1))
        # with one bit set, the bits below it count to its place
        place = F.when(part == 0, F.lit(first)).otherwise(F.lit(first) + F.bit_count(part - 1))
        out = F.when(F.bit_count(part) <= 1, place).otherwise(out)
    return out


def _verified(max_different: int) -> Column:
    """Whether a.fp and b.fp link."""
    return F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_different


def links(prints: DataFrame, max_different: int = MAX_DIFFERENT) -> DataFrame:
    """A written table (u, v) of links between different fingerprints (fp), within ``max_different`` bits: its components are those of all such pairs.

    First every fingerprint is held against the smallest that shares a variant with it. What these links join needs no further
    comparison, so a dense group of m fingerprints costs 64 m rows, not m * m pairs. Then only the members of a variant that are still in
    different components are paired.
    """
    spark = prints.sparkSession
    index = prints.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    hubs = index.groupBy("key").agg(F.min("fp").alias("fp"), F.max("fp").alias("most")).filter("fp < most").select("key", "fp")
    hubs = written(hubs, "hubs")
    a, b = hubs.alias("a"), index.alias("b")
    star = a.join(growing(b), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _verified(max_different))
    star = written(star.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct(), "star")
    roots = components(star)
    placed = written(prints.join(growing(roots), F.col("fp") == F.col("id"), "left").select("fp", F.coalesce("to", "fp").alias("to")), "placed")
    placed_index = placed.select("fp", "to", F.explode(variants(F.col("fp"))).alias("key"))
    a, b = placed_index.alias("a"), placed_index.alias("b")
    fa, fb = F.col("a.fp"), F.col("b.fp")
    on = (
        (F.col("a.key") == F.col("b.key"))
        & (fa < fb)
        & (F.col("a.to") != F.col("b.to"))
        & _verified(max_different)
        & (F.shiftright(F.col("a.key"), 32) == _reported_at(fa, fb))
    )
    across = a.join(growing(b), on).select(fa.alias("u"), fb.alias("v"))
    out = written(star.unionByName(across), "links")
    for old in (hubs, star, placed):
        remove(spark, old.written_to)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each document."""
    spark = df.sparkSession
    prints = written(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = links(nodes.select("fp"))
    roots = components(edges)
    remove(spark, edges.written_to)
    placed = nodes.join(growing(roots), nodes["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("to", "fp").alias("root"))
    placed = written(placed, "placed")
    # the vertices are fingerprints, so one that null ids alone hold is a vertex too
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = placed.join(growing(named), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    named = written(named, "named")
    for old in (nodes, placed):
        remove(spark, old.written_to)
    # both sides come straight from files, so adaptive execution may split a fingerprint that very many share
    return prints.join(growing(named), prints["fp"] == named["_fp"], "left").select("doc_id", "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with the columns of df: ``links`` between fingerprints of five-word shingles, checked and completed by ``near``.

    It is the row with the smallest id, nulls last, then text hash, then hash of the whole row: rows that share an id are told apart by
    their texts, and of rows that share both one stays.
    """
    spark = df.sparkSession
    found = near_copies(df, links, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    first = written(found.groupBy(F.col("component").alias("_c")).agg(F.min(place).alias("first")), "first")
    key, gone_key, row = free_names(df, "key", "gone", "row")
    gone = found.join(growing(first), F.col("component") == F.col("_c")).filter(place != F.col("first"))
    gone = written(gone.select(place.alias(gone_key)).distinct(), "gone")
    remove(spark, first.written_to)
    remove(spark, found.written_to)
    doc = F.col(id_col).cast("long")
    keyed = df.withColumn(key, F.struct(doc.isNull().alias("unnamed"), doc.alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th")))
    # repeated rows first: the limit by group works before the shuffle, so a row that very many repeat is no hot key
    hashed = [c for c, (_, kind) in zip(own_columns(df), df.dtypes) if "map<" not in kind and "variant" not in kind]
    by_key = Window.partitionBy(key).orderBy(F.xxhash64(*hashed))
    single = keyed.withColumn(row, F.row_number().over(by_key)).filter(F.col(row) == 1)
    # by shuffle at every size: the list grows with the corpus
    left = single.join(gone.hint("shuffle_hash"), F.col(key) == F.col(gone_key), "left_anti")
    return left.select(*own_columns(df))


def simhash_table(df: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)."""
    found = near_duplicates(df)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
