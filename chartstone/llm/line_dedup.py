"""Line dedup by a suffix array over line-ID sequences.

A document is the sequence of the ids (64-bit hashes) of its lines, without white space at their ends; lines
without a word are left out. A line that stands once in the corpus is in no repeated run, so the
suffixes kept are those that begin at a line that stands at least twice.

Prefix doubling: ranks of depth 1 are the sorted line ids, numbered. A round sorts the distinct pairs
(rank(i), rank(i + depth)) over the cluster and numbers them in order: the order of the suffixes by twice
as many lines. Suffixes of equal rank are an interval of the suffix array whose common prefix is that long;
intervals of one suffix drop out. A run is deleted if it holds more than MIN_WORDS words, and each line of
it holds one at least, so doubling ends once two intervals overlap to cover MIN_WORDS + 1 lines, or when no interval is left.

Runs: from each suffix, the shortest prefix with more than MIN_WORDS words, and at each line the shortest such
run that ends there. A run of m lines is the pair of intervals of the largest depth that fits, at its start and at
its end; runs of equal pairs share a common prefix, and all but the first of them, by (doc_id, text hash, line), are
later copies. Every maximal repeated run of more than MIN_WORDS words is the union of such runs inside it: a line
before which the run holds more than MIN_WORDS words is in the one that ends there, any other in the one that starts the run.
So what is deleted is exactly the lines of the maximal repeated runs, but for their first copies.

Where a run overlaps a later copy of itself, its lines count as that copy's. Deleted lines go with their line
break; if no line with a word is left, the text becomes empty.

Defined results: null and empty texts stay as they are; rows without an id stay as they are; rows equal in id
and text are one document; rows that share an id alone are documents of their own; an empty table gives no rows; a very long text is
one row of line ids; other columns pass through ``dedup_lines`` untouched, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartstone.llm.common import free_names, own_columns, remove, written

#: A repeated run is deleted if it holds more words than this.
MIN_WORDS = 50
SPACE = r"\x20\x09-\x0D"
ENDS = " \t\n\x0b\x0c\r"


def key_of(id_col: Column, text_col: Column) -> Column:
    """A row's key: its id and the hash of its text."""
    return F.struct(id_col.cast("long").alias("doc"), F.xxhash64(text_col).alias("th"))


def lines_of(text: Column) -> Column:
    """Structs (h: line id, w: words) of the lines that hold a word, in order."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.transform(F.array_remove(trimmed, ""), lambda t: F.struct(F.xxhash64(t).alias("h"), F.size(F.split(t, f"[{SPACE}]+")).alias("w")))


def _numbered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups with a number r in the order of keys."""
    return groups.sort(*keys).withColumn("r", F.monotonically_increasing_id())


def _suffixes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, p, w, r): the lines that stand at least twice; p counts a document's lines with words, r is the rank of depth 1."""
    docs = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    docs = docs.select(key_of(F.col(id_col), F.col(text_col)).alias("k"), lines_of(F.col(text_col)).alias("lines"))
    docs = written(docs.groupBy("k").agg(F.first("lines").alias("lines")), "lines")
    counts = docs.select(F.explode("lines.h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    ranked = written(_numbered(counts, ["h"]).select(F.col("h").alias("_h"), "r"), "rank")
    flat = docs.select("k", F.posexplode("lines").alias("p", "x")).select("k", "p", "x.w", "x.h")
    out = written(flat.join(ranked, F.col("h") == F.col("_h")).select("k", "p", "w", "r"), "suffixes")
    remove(df.sparkSession, docs.written_to)
    remove(df.sparkSession, ranked.written_to)
    return out


def _doubled(level: DataFrame, depth: int) -> DataFrame:
    """Ranks (k, p, r) of twice the depth, for the suffixes that share them."""
    places = level.groupBy("k").agg(F.collect_list(F.struct("p", "r")).alias("x"))

    def pair(batches):
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(5)]
            for doc, th, items in zip(*[c.to_pylist() for c in batch.columns]):
                at = {x["p"]: x["r"] for x in items}
                for p, r1 in at.items():
                    r2 = at.get(p + depth)
                    if r2 is not None:
                        for to, value in zip(out, (doc, th, p, r1, r2)):
                            to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc", "th", "p", "r1", "r2"])

    pairs = places.select("k.doc", "k.th", "x").mapInArrow(pair, "doc long, th long, p int, r1 long, r2 long")
    pairs = written(pairs.select(F.struct("doc", "th").alias("k"), "p", "r1", "r2"), "pairs")
    shared = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2")
    ranked = written(_numbered(shared, ["r1", "r2"]).select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), "r"), "rank")
    out = written(pairs.join(ranked, (F.col("r1") == F.col("_r1")) & (F.col("r2") == F.col("_r2"))).select("k", "p", "r"), "ranks")
    remove(level.sparkSession, pairs.written_to)
    remove(level.sparkSession, ranked.written_to)
    return out


def shortest_runs(words: dict[int, int], ranks: list[dict[int, int]], min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, lines, interval at the start, interval at the end) of the runs to compare in one document.

    words: of each kept line by place; ranks: for each depth 1, 2, 4, ... the rank by place.
    """
    found: set[tuple[int, int, int, int]] = set()
    place = sorted(words)

    def add(start: int, m: int) -> None:
        t = m.bit_length() - 1
        if t < len(ranks):
            a, b = ranks[t].get(start), ranks[t].get(start + m - (1 << t))
            if a is not None and b is not None:
                found.add((start, m, a, b))

    start, total = 0, 0  # window place[start..i] of consecutive lines; the shortest run that ends at i
    for i, p in enumerate(place):
        if i and place[i - 1] != p - 1:
            start, total = i, 0
        total += words[p]
        while total - words[place[start]] > min_words:
            total -= words[place[start]]
            start += 1
        if total > min_words:
            add(place[start], i - start + 1)
    # the shortest run from each line: the same walk from the end
    end, total = len(place) - 1, 0
    for i in range(len(place) - 1, -1, -1):
        p = place[i]
        if i < len(place) - 1 and place[i + 1] != p + 1:
            end, total = i, 0
        total += words[p]
        while total - words[place[end]] > min_words:
            total -= words[place[end]]
            end -= 1
        if total > min_words:
            add(p, end - i + 1)
    return sorted(found)


def removable(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(k, gone array<int>): the lines with words to delete, counted from 0, for each document that has any."""
    spark = df.sparkSession
    levels = [_suffixes(df, id_col, text_col)]
    while 2 << (len(levels) - 1) <= min_words + 1:
        depth = 1 << (len(levels) - 1)
        after = _doubled(levels[-1].select("k", "p", "r"), depth)
        if after.isEmpty():
            break
        levels.append(after)

    every = levels[0].select("k", F.lit(0).alias("t"), "p", "r", "w")
    for t, level in enumerate(levels[1:], 1):
        every = every.unionByName(level.select("k", F.lit(t).alias("t"), "p", "r", F.lit(0).alias("w")))
    rows = every.groupBy("k").agg(F.collect_list(F.struct("t", "p", "r", "w")).alias("x"))
    rows = rows.select(F.col("k.doc").alias("doc"), F.col("k.th").alias("th"), "x")
    depths = len(levels)

    def run(batches):
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for doc, th, items in zip(*[c.to_pylist() for c in batch.columns]):
                words = {x["p"]: x["w"] for x in items if x["t"] == 0}
                ranks: list[dict[int, int]] = [{} for _ in range(depths)]
                for x in items:
                    ranks[x["t"]][x["p"]] = x["r"]
                for found in shortest_runs(words, ranks, min_words):
                    for to, value in zip(out, (doc, th, *found)):
                        to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc", "th", "p", "m", "a", "b"])

    runs = written(rows.mapInArrow(run, "doc long, th long, p int, m int, a long, b long"), "runs")
    for level in levels:
        remove(spark, level.written_to)
    here = F.struct("doc", "th", "p")
    first = runs.groupBy("m", "a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select(F.col("m").alias("_m"), F.col("a").alias("_a"), F.col("b").alias("_b"), "first"), "first")
    copies = runs.join(first, (F.col("m") == F.col("_m")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).filter(here != F.col("first"))
    lines = copies.select(F.struct("doc", "th").alias("k"), F.explode(F.sequence(F.col("p"), F.col("p") + F.col("m") - 1)).alias("p"))
    gone = written(lines.groupBy("k").agg(F.sort_array(F.collect_set("p")).alias("gone")), "gone")
    remove(spark, runs.written_to)
    remove(spark, first.written_to)
    return gone


def without_lines(text: str, gone: set[int]) -> str:
    """text less the lines with words whose places are in ``gone``; empty if no word is left."""
    out, p, some = [], 0, False
    for line in text.split("\n"):
        if not line.strip(ENDS):
            out.append(line)
            continue
        if p not in gone:
            out.append(line)
            some = True
        p += 1
    return "\n".join(out) if some else ""


def with_clean_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, str, str]:
    """df with two columns more, and their names: the text less later copies, and how many lines went."""
    key, other, lines, cleaned, count = free_names(df, "key", "other", "lines", "cleaned", "count")
    gone = removable(df, id_col, text_col, min_words).select(F.col("k").alias(other), F.col("gone").alias(lines))
    keyed = df.withColumn(key, key_of(F.col(id_col), F.col(text_col)))
    # by shuffle at every size: the lines to delete grow with the corpus, and texts are not sorted for it
    joined = keyed.join(gone.hint("shuffle_hash"), F.col(key) == F.col(other), "left")

    @F.pandas_udf("string")
    def clean(text, lines):
        import pandas as pd

        return pd.Series([t if x is None else without_lines(t, set(x.tolist())) for t, x in zip(text, lines)], dtype=object)

    changed = F.col(lines).isNotNull()
    text = F.when(changed, clean(F.when(changed, F.col(text_col)), F.col(lines))).otherwise(F.col(text_col))
    out = joined.withColumns({cleaned: text, count: F.coalesce(F.size(lines), F.lit(0))}).drop(key, other, lines)
    return out, cleaned, count


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents less the later copies of repeated runs, with the columns of df; ``length_col`` follows the text if it is there."""
    out, cleaned, count = with_clean_text(df, id_col, text_col)
    columns = []
    for name, column in zip(df.columns, own_columns(df)):
        if name == text_col:
            column = F.col(cleaned).alias(name)
        elif name == length_col:
            column = F.when(F.col(count) > 0, F.char_length(cleaned).cast(df.schema[name].dataType)).otherwise(column).alias(name)
        columns.append(column)
    return out.select(*columns)


def line_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars_left, text_md5) for each document."""
    out, cleaned, count = with_clean_text(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    return out.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.col(count).cast("long").alias("n_removed"),
        F.char_length(cleaned).cast("long").alias("n_chars_left"),
        F.md5(F.col(cleaned).cast("binary")).alias("text_md5"),
    )


def oracle(source: str = "documents", min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL of ``line_table`` for unique ids: equal lines are paired with earlier ones and runs are islands on their diagonals."""
    return rf"""
WITH l AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {source} WHERE text IS NOT NULL)),
t AS (SELECT doc_id, i, lines[i] AS line, regexp_replace(lines[i], '^[ 	-
]+|[ 	-
]+$', '', 'g') AS t FROM l),
p AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, len(regexp_extract_all(t, '[^ 	-
]+')) AS words FROM t WHERE t <> ''),
pair AS (SELECT a.doc_id, a.p, a.words, b.doc_id AS other, a.p - b.p AS diagonal FROM p a JOIN p b ON a.t = b.t AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.p < a.p))),
island AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY p) AS g FROM pair),
run AS (SELECT doc_id, min(p) AS low, max(p) AS high FROM island GROUP BY doc_id, other, diagonal, g HAVING sum(words) > {min_words}),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS p FROM (SELECT DISTINCT * FROM run)),
kept AS (SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.i) AS text, count(p.p) AS words_left FROM t LEFT JOIN p ON p.doc_id = t.doc_id AND p.i = t.i LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p WHERE gone.p IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
r AS (SELECT d.doc_id, d.text IS NULL AS missing, CASE WHEN n_removed IS NULL THEN d.text WHEN coalesce(words_left, 0) = 0 THEN '' ELSE kept.text END AS text, coalesce(n_removed, 0) AS n_removed, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines
  FROM {source} d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(text)::BIGINT AS n_chars_left, md5(text) AS text_md5 FROM r"""
