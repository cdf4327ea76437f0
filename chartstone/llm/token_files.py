"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A token table is a folder of shards. Shard k holds, as little-endian flat arrays without headers,

    <name>.tok  the ids of its documents, one after the other (uint16 if the vocabulary fits, else uint32)
    <name>.off  int64, where each document starts in the shard, and the shard's length last
    <name>.ids  int64, the documents' ids (a null id: the smallest int64)

and ``manifest.json`` names the shards in order with the base of each: the exclusive prefix sum of the
tokens of those before it. Documents are dealt out by ranges of doc_id, so that ascending shards
hold ascending ids; the manifest has a row for each shard, never one for each document.

A task writes under a name of its own attempt and only the attempt that Spark accepts enters the
manifest, so that a lost executor or a second attempt leaves the table whole.

Texts are dealt out and then encoded, once: ids of two bytes take as much room as compressed texts, so nothing would be saved by
shuffling ids, and writing them twice would cost more.

Defined results: a null text is the empty text; an empty table has no shards; repeated ids and repeated rows stay
apart, in the order of their texts' hashes; a very long text is encoded in parts of about CHUNK characters, with the
result of the whole; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartstone.llm.common import new_path, shuffle_partitions

NULL_ID = -(2**63)
#: Characters on whose class two regular expression libraries may differ: such texts go to the tokenizer whole.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-ԯḀ-῿‐-‧‰-⁞₠-₿←-⋿぀-ヿ一-龥가-힣]")
CONTROL = re.compile("[\x1c-\x1f]")
#: Runs of white space.
RUNS = re.compile(r"(\s\s+)")
#: Bytes that one generation of a worker's memos may hold, about; longer words are not remembered.
MEMO_BYTES, MEMO_WORD = 96 << 20, 64
CHUNK = 1 << 20

class Memo(dict):
    """What ``make`` gives for a key, remembered in two generations of at most ``limit`` bytes each.

    When the younger is full it becomes the older; what is asked for again moves back, so frequent keys stay.
    """

    def __init__(self, make, cost, limit: int) -> None:
        super().__init__()
        self.make, self.cost, self.limit, self.held, self.old = make, cost, limit, 0, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= MEMO_WORD:
            self.held += len(key) + self.cost(found)
            if self.held > self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = found
        return found


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it shows, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class TextEncoder:
    """Texts to id bytes with the tokenizers library.

    A byte-level tokenizer never joins across pre-split words, and white space is pre-split like this: a single space goes with what
    follows, any other single character is a word; of a longer run the last character is treated so and the rest is one word, but at the
    text's end all of the run. So texts are cut into units: what stands between two single white space characters, with the space
    ("unit") or the line break ("\\nunit") before it. A unit is looked up; on a miss, letters alone are one word for the library's model,
    letters with one other character behind them are two, and all else is for the library as it stands. A text that holds a
    special token's string or an odd character goes to the library whole.
    """

    def __init__(self, path: str, memo_bytes: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # the settings only: the whole file as Python objects would stay in the worker's memory
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.gap = re.compile(r"(?<=\S) (?=\S)")
        self.line_break = self.whole("\n")
        self.space = byte_symbols()[ord(" ")]
        self.symbols = dict(enumerate(byte_symbols()))
        self.model = self.tokenizer.model
        self.units = Memo(self._unit, lambda ids: len(ids) + 170, memo_bytes or MEMO_BYTES)  # two objects and a slot
        self.runs = Memo(self.whole, lambda ids: len(ids) + 170, 1 << 20)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, symbols: str) -> bytes:
        return array(self.dtype.char, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        head = unit[:1] == "\n"
        word = unit[1:] if head else unit
        if word.isalpha():
            symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
            return self.line_break + self._word(symbols) if head else self._word(self.space + symbols)
        if word[:-1].isalpha():
            return self.units[unit[:-1]] + self.runs[unit[-1]]
        return self.whole(unit if head else " " + unit)

    def chunks(self, text: str):
        """text cut before single spaces between words, where the pre-split cuts anyway."""
        at = 0
        while len(text) - at > CHUNK:
            m = self.gap.search(text, at + CHUNK)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def parts(self, text: str) -> list[tuple[str, bool, list[str]]]:
        """(run of white space that comes first, whether its last character goes with the first unit, units) in order."""
        out, run, pieces = [], "", RUNS.split(text)
        for k in range(0, len(pieces), 2):
            if k:
                run = pieces[k - 1]
            piece = pieces[k]
            if not k and piece[:1].isspace() and piece[0] not in " \n":
                out.append((piece[0], True, []))
                piece = piece[1:]
            if piece:
                units = piece.replace("\n", " \n").split(" ")
                spaced = run[-1:] == " "
                if not spaced and units[0][:1] != "\n":
                    units[0] = "\n" + units[0]  # what stands behind a line break stands without a space; the break is taken off again
                elif not spaced:
                    units[:1] = []
                out.append((run[:-1] if spaced else run, spaced, units))
            elif run and k == len(pieces) - 1:
                out.append((run, True, []))
        return out

    def _joined(self, parts: list[tuple[str, bool, list[str]]]) -> bytes:
        found = []
        for run, spaced, units in parts:
            if run:
                # of a run that no space ends, the last character is a word of its own unless the text ends there
                found.append(self.runs[run] if spaced else self.runs[run[:-1]] + self.runs[run[-1]])
            ids = b"".join(map(self.units.__getitem__, units))
            found.append(ids if spaced else ids[len(self.line_break) :])
        return b"".join(found)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(s in text for s in self.special) or not (text.isascii() and not CONTROL.search(text) or not ODD.search(text)):
            return self.whole(text)
        return b"".join([self._joined(self.parts(part)) for part in self.chunks(text)])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str, memo_bytes: int | None = None) -> TextEncoder:
    """One encoder for a worker process; its memo serves all the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path, memo_bytes)
    return _ENCODERS[path]


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store behind a URI, as executors see it."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), parsed.path
    return pyarrow.fs.FileSystem.from_uri(uri)


def mapped(uri: str, dtype) -> np.ndarray:
    """The flat array of a file: memory-mapped where the store is a file system, else read."""
    fs, path = file_system(uri)
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def write_token_files(df: DataFrame, id_col: str, text_col: str, tokenizer: str, out: str, end_id: int | None = None, partitions: int | None = None) -> dict:
    """Encode df into a token table at ``out`` (a URI that all executors reach); returns its manifest."""
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    dealt = (
        df.select(key.alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
        .repartitionByRange(n, "id", "h")
        .sortWithinPartitions("id", "h")
    )

    def run(batches):
        enc, task = encoder(tokenizer), TaskContext.get()
        itemsize = enc.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, folder = file_system(out)
        files, at, docs = None, 0, 0
        try:
            for batch in batches:
                if files is None:
                    fs.create_dir(folder, recursive=True)
                    files = [fs.open_output_stream(f"{folder}/{name}.{x}") for x in ("tok", "off", "ids")]
                ids = [enc(t) + end for t in batch.column(1).to_pylist()]
                ends = np.cumsum([len(x) for x in ids]) // itemsize
                files[0].write(b"".join(ids))
                files[1].write(np.concatenate([[at], at + ends[:-1]]).astype("<i8").tobytes())
                files[2].write(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                at, docs = at + int(ends[-1]), docs + len(ids)
            if files:
                files[1].write(np.array([at], "<i8").tobytes())
        finally:
            for f in files or ():
                f.close()
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [docs], "tokens": [at], "itemsize": [itemsize]})

    rows = dealt.mapInArrow(run, "part long, name string, docs long, tokens long, itemsize long").collect()
    shards, base, docs = [], 0, 0
    for r in sorted(rows, key=lambda r: r.part):
        shards.append({"name": r.name, "base": base, "first": docs, "docs": r.docs, "tokens": r.tokens})
        base, docs = base + r.tokens, docs + r.docs
    manifest = {"dtype": "<u2" if rows and rows[0].itemsize == 2 else "<u4", "tokens": base, "docs": docs, "shards": shards}
    fs, folder = file_system(out)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), a row for each document of the table at ``out``.

    Each shard is a task; its files are mapped and read a document at a time.
    """
    fs, folder = file_system(out)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    shards, dtype = manifest["shards"], manifest["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = shards[k]
                at = f"{out}/{shard['name']}"
                tokens, offsets, ids = mapped(at + ".tok", dtype), mapped(at + ".off", "<i8"), mapped(at + ".ids", "<i8")
                for a in range(0, len(ids), 4096):
                    part = np.array(ids[a : a + 4096])
                    off = np.array(offsets[a : a + len(part) + 1])
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(off[:-1], off[1:])]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(part, pa.int64(), mask=part == NULL_ID),
                            "start": off[:-1] + shard["base"],
                            "n_tokens": np.diff(off),
                            "ids_crc32": np.array(crc, np.int64),
                        }
                    )

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)


def document_tokens(out: str, manifest: dict, position: int) -> np.ndarray:
    """Ids of the document at a position in the whole table, for training loaders."""
    k = int(np.searchsorted([s["first"] for s in manifest["shards"]], position, side="right")) - 1
    shard = manifest["shards"][k]
    offsets = mapped(f"{out}/{shard['name']}.off", "<i8")
    i = position - shard["first"]
    return mapped(f"{out}/{shard['name']}.tok", manifest["dtype"])[offsets[i] : offsets[i + 1]]


def token_table(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """Write df as a token table in the shared folder, and read the table back."""
    spark = df.sparkSession
    out = new_path(spark, "tokens")
    write_token_files(df, id_col, text_col, tokenizer, out, end_id)
    return read_token_files(spark, out)
