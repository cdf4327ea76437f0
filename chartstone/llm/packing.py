"""Best-fit packing by sums of squares.

Token pieces go into sequences of ``capacity``. With N(g) open bins of residual gap g, each piece is
placed in the open bin after which the sum of N(g)^2 over all gaps is smallest; of places that tie, the
smallest gap wins. A new bin opens only for a piece that no open bin takes, and a block places its
pieces by falling length: both lower the number of sequences (32,768 pieces of 15,137.5 sequences'
tokens fill 15,153; with new bins among the choices 15,336, in random order 15,417).
Full pieces take a sequence each.

Scale: the pieces are dealt out by hash into blocks that hold tens of thousands each, and each block
is packed by itself, so no task and no driver sees all pieces. A block's state is 1,024 counts and its
open bins; what it can lose against one packing of everything is its last open bins. Sequence
numbers are (block << 40) + number in the block.

Defined results: a null text is the empty text, whose piece is the end id alone; an empty table gives
no rows; repeated rows are packed once each, and go to different blocks; a very long text gives as many pieces as it needs;
only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartstone.llm.common import written
from chartstone.llm.token_files import encoder

CAPACITY = 1024
#: Pieces that one block packs, about.
BLOCK_PIECES = 1 << 15


class SumOfSquares:
    """Streaming packer: ``place(length)`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by gap; index 0 stays 0: full bins are closed
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, length: int) -> tuple[int, int]:
        c = self.capacity
        if not 0 < length <= c:
            raise ValueError(f"a piece has 1 to {c} tokens, not {length}")
        fits = np.flatnonzero(self.count[length:])
        if len(fits) == 0:
            gap, number, offset = c, self.bins, 0
            self.bins += 1
        else:
            # change of the sum of squares: leaving gap g gives 1-2N(g); arriving at gap g-length 2N(g-length)+1, at 0 none
            arrive = 2 * self.count[: c - length + 1][fits] + 1
            arrive[fits == 0] = 0
            gap = length + int(fits[np.argmin(1 - 2 * self.count[length:][fits] + arrive)])
            number, offset = self.open[gap].pop(), c - gap
            self.count[gap] -= 1
        rest = gap - length
        if rest:
            self.open[rest].append(number)
            self.count[rest] += 1
        return number, offset


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, memo_bytes: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, cut only if longer than ``capacity``.

    Then all pieces but the first hold exactly ``capacity``. One pass over the texts, no shuffle.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        enc = encoder(tokenizer, memo_bytes)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, data in zip(batch.column(0).to_pylist(), map(enc, batch.column(1).to_pylist())):
                ids = np.frombuffer(data + end, enc.dtype)
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for to, x in zip(rows, (doc, piece, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces with sequence_id and offset added. ``pieces`` should be a written table: it is read twice."""
    blocks = max(1, round(pieces.count() / block_pieces))
    # a row number is in the hash, so that repeated rows and null ids spread too; the written pieces give the same one on every attempt
    dealt = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", F.xxhash64("doc_id", "piece", "start", "_row"))
    dealt = dealt.repartition(blocks, "_block").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches):
        packer, block = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(3).to_pylist()]
            seq = pa.array([block + b for b, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, seq, pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, memo_bytes: int | None = None) -> DataFrame:
    """Documents to packed pieces; the pieces are written once, so their texts are encoded once.

    ``memo_bytes`` bounds a generation of the workers' memos, for workers that hold other stages' data too.
    """
    return pack(written(token_pieces(df, tokenizer, end_id=end_id, capacity=capacity, memo_bytes=memo_bytes), "pieces"), capacity)
