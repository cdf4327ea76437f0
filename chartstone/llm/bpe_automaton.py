"""BPE encoding and decoding by a tokenization automaton.

Compilation: the automaton starts with one state and an arc for each base symbol. Each merge (u, v) -> uv, in
order, adds its gadget: wherever an arc u is followed by an arc v, the u arc is led to a copy of its
target without the v arc, and an arc uv goes straight to where v led. The result is deterministic and accepts exactly
the token sequences that BPE produces. Written out, tens of thousands of copies with as many arcs each would
not fit in memory, so a gadget is kept as what it changes - the new arc with its two parts, and the
merge that cut the old one - and a state's row of the transition table is filled where it is visited:
after token s an arc t is there unless some merge cut it, that is, unless a token that once ended s and
one that once began t were merged while both were still current. Of equal merges the left one goes first.

Encoding: over a pre-split word, arcs whose labels spell the word are followed, the longest label first; every prefix has
exactly one accepted path, so each place of the word has one state, a place that leads no further is never entered
again, and the path that comes to the end is the encoding. Decoding emits the labels of the path's arcs, as the
library's decode does for a tokenizer without a decoder: joined by spaces.

Normalising and pre-splitting follow the tokenizer file (a fixed pattern); texts with characters on
whose class libraries may differ are split by the tokenizer's own normaliser and pre-tokenizer.

Defined results: a null or empty text has no tokens, and the digests of the empty string; an empty table
gives no rows; repeated rows give a row each; a very long text is encoded in parts of about CHUNK characters, with the result
of the whole; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartstone.llm.token_files import ODD, Memo, byte_symbols

#: The pre-split of the word-level vocabulary, as its tokenizer file names it (a fixed pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that one generation of a worker's memos may hold, about.
MEMO_BYTES = 128 << 20
MEMO_ARCS = 2_000_000
CHUNK = 1 << 20
NEVER = 1 << 60


class MergeAutomaton:
    """Deterministic automaton of a merge list; its tokens are the labels of its arcs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        size = max(vocab.values()) + 1
        self.label = [""] * size
        for token, i in vocab.items():
            self.label[i] = token
        self.born = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.cut: dict[int, int] = {}
        self.size = size
        for rank, (u, v) in enumerate(merges):
            self.add_gadget(rank, vocab[u], vocab[v], vocab[u + v])
        # spelling of labels in base symbols, as a trie: a node leads from a symbol to the next node, and from -1 to the longest
        # label that ends at it or above it
        self.root: dict[int, dict | int] = {}
        self.length = [0] * size
        spelled: dict[int, list[int]] = {}
        for i in sorted(vocab.values(), key=lambda i: self.born[i]):
            p = self.parts[i]
            spelled[i] = [i] if p is None else spelled[p[0]] + spelled[p[1]]
            node = self.root
            for s in spelled[i]:
                node = node.setdefault(s, {})
            node[-1] = i
            self.length[i] = len(spelled[i])
        self.depth = max(self.length)
        # of each label, the longest other label that it begins with
        self.shorter = [-1] * size
        nodes = [(self.root, -1)]
        while nodes:
            node, above = nodes.pop()
            i = node.setdefault(-1, above)
            if i != above:
                self.shorter[i] = above
            nodes += [(below, i) for s, below in node.items() if s >= 0]
        self.arcs: dict[int, bool] = {}

    def add_gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        """The merge (u, v): a new arc uv from where both stood, and the v arc cut behind u."""
        if self.parts[uv] is not None:
            raise ValueError(f"two merges give {self.label[uv]!r}")
        self.parts[uv], self.born[uv] = (u, v), rank
        self.cut[u * self.size + v] = rank

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at an end of ``token`` in turn, each with the merge that took it up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            p = self.parts[token]
            if p is None:
                return out
            until, token = self.born[token], p[side]

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow the token ``state``: one cell of the transition table."""
        key = state * self.size + token
        known = self.arcs.get(key)
        if known is None:
            known = True
            heads = self._spine(token, 0)
            for u, u_until in self._spine(state, 1):
                for v, v_until in heads:
                    at = self.cut.get(u * self.size + v)
                    if at is not None and at < u_until and at <= v_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) >= MEMO_ARCS:
                self.arcs.clear()
            self.arcs[key] = known
        return known

    def encode(self, symbols: list[int]) -> list[int]:
        """The accepted path that spells ``symbols`` (base symbol ids)."""
        n, size, depth, root, length, shorter, arcs = len(symbols), self.size, self.depth, self.root, self.length, self.shorter, self.arcs
        path, dead, at, state = [], set(), 0, -1
        while at < n:
            node = root
            for s in symbols[at : at + depth]:
                below = node.get(s)
                if below is None:
                    break
                node = below
            token = node[-1]
            while True:
                while token >= 0:
                    if at + length[token] not in dead:
                        if state < 0:
                            break
                        known = arcs.get(state * size + token)
                        if self.arc(state, token) if known is None else known:
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                if not path:
                    raise ValueError("no path: the automaton is not one of a merge list")
                dead.add(at)
                token = path.pop()
                at -= length[token]
                state, token = path[-1] if path else -1, shorter[token]
            path.append(token)
            at, state = at + length[token], token
        return path


class WordTokenizer:
    """Whole texts to ids and back, for a tokenizer file of the BPE kind with word ends and no decoder."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, suffix)
        symbols = byte_symbols()
        self.inner = [model["vocab"][c] for c in symbols]
        self.last = [model["vocab"][c + suffix] for c in symbols]
        self.of_symbol = {c: b for b, c in enumerate(symbols)}
        self.added = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.cutter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(SPLIT).findall
        self.gap = re.compile(r"(?<=\S) (?=\S)")
        self.name = [str(i) for i in range(self.automaton.size)]
        cost = lambda found: len(found[0]) + len(found[1]) + 340  # noqa: E731 - four objects and a slot
        self.word = Memo(self._word, cost, MEMO_BYTES // 3).__getitem__
        self.unit = Memo(self._unit, cost, MEMO_BYTES - MEMO_BYTES // 3).__getitem__

    def ids(self, word: str) -> list[int]:
        data = word.encode()
        symbols = list(map(self.inner.__getitem__, data))
        symbols[-1] = self.last[data[-1]]
        return self.automaton.encode(symbols)

    def _word(self, word: str) -> tuple[str, str]:
        """(ids as text, labels as text) of a pre-split word."""
        ids, name, label = self.ids(word), self.name, self.automaton.label
        return " ".join([name[i] for i in ids]), " ".join([label[i] for i in ids])

    def _unit(self, unit: str) -> tuple[str, str]:
        """The same of all words of what stands between two spaces, at which the pre-split cuts and nothing normalises across."""
        words = self.plain_words(unit)
        if len(words) == 1:
            return self.word(words[0])
        a, b = zip(*map(self.word, words))
        return " ".join(a), " ".join(b)

    def words(self, text: str) -> list[str]:
        """Normalised and pre-split words."""
        if ODD.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.of_symbol[c] for c in piece).decode() for piece, _ in pieces]
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        """The same of a text without odd characters."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if text.isalpha():
            return [text]
        if text[:-1].isalpha() and not text[-1].isspace():  # letters, and one character that is none
            return [text[:-1], text[-1]]
        return self.split(text)

    def pieces(self, text: str):
        """(added token or None, text) in order."""
        parts = self.cutter.split(text) if self.cutter else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part, ""
                continue
            at = 0
            while len(part) - at > CHUNK:
                m = self.gap.search(part, at + CHUNK)
                if not m:
                    break
                yield None, part[at : m.start()]
                at = m.start()
            if part[at:]:
                yield None, part[at:]

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, sha256 of the ids, sha256 of the decoded text)."""
        ids, labels, n, begun = hashlib.sha256(), hashlib.sha256(), 0, False
        for added, part in self.pieces(text or ""):
            if added:
                found = [(str(self.added[added]), added)]
            elif ODD.search(part):
                found = list(map(self.word, self.words(part)))
            else:
                found = list(map(self.unit, part.split()))  # white space alone is in no word, so it cuts
            if not found:
                continue
            a, b = map(" ".join, zip(*found))
            joint = " " if begun else ""
            ids.update((joint + a).encode())
            labels.update((joint + b).encode())
            n, begun = n + a.count(" ") + 1, True
        return n, ids.hexdigest(), labels.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for added, part in self.pieces(text or ""):
            out += [self.added[added]] if added else [i for w in self.words(part) for i in self.ids(w)]
        return out

    def decode(self, ids: list[int]) -> str:
        names = {i: t for t, i in self.added.items()}
        return " ".join(names[i] if i in names else self.automaton.label[i] for i in ids)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One automaton for a worker process; what it has filled in serves all the tasks that follow."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array, decoded): the token ids and the decoded text themselves."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            ids = [tok.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([tok.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of whole texts; one pass, no shuffle."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            found = [tok.digests(t.as_py()) for t in batch.column(1)]
            n, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
