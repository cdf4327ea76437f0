import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chartstone.llm import bpe_automaton, packing, token_files

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world!  It's 2024 and they'll go.\n\n\tTabs  and   runs ",
    "naïve Éclair ÑANDÚ straße ΑΣ Σ İstanbul ﬁne Ĳ ½²①",
    "a<|endoftext|>b <|startoftext|>",
    "日本語 テスト 🎉🎉 \u200b\u180e\x1c\x1f\x85\u2028 end",
    "é combining",
    " ",
    "",
    None,
    "x" * 3000,
    "-=" * 500 + "!!!" * 77,
    "'s 't're 'LL don't",
    ("word " * 30 + "\n") * 50,
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "f") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "f"), (None, "no id", "f")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_byte_encoder_equals_library():
    enc, lib = token_files.TextEncoder(BYTE), Tokenizer.from_file(BYTE)
    for t in TEXTS:
        assert np.frombuffer(enc(t), enc.dtype).tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_byte_encoder_in_chunks(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 50)
    test_byte_encoder_equals_library()


def test_token_table(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    got = [tuple(r) for r in token_files.token_table(docs, BYTE).collect()]
    at, want = 0, []
    for i, t in sorted([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])], key=lambda x: x[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted(want)
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == np.concatenate([[0], np.cumsum([r[2] for r in ordered])[:-1]]).tolist()
    ids_in_order = [r[0] for r in ordered if r[0] is not None]
    assert ids_in_order == sorted(ids_in_order)
    assert token_files.token_table(docs.limit(0), BYTE).count() == 0


def test_random_access(spark, docs, tmp_path):
    manifest = token_files.write_token_files(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "text", BYTE, f"file://{tmp_path}/t")
    lib = Tokenizer.from_file(BYTE)
    for k, t in enumerate(TEXTS):
        assert token_files.document_tokens(f"file://{tmp_path}/t", manifest, k).tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_automaton_equals_library():
    tok = bpe_automaton.tokenizer(WORD)
    rng = random.Random(3)
    more = ["".join(rng.choice("abetinghor's1! éß") for _ in range(200)) for _ in range(60)]
    for t in TEXTS + more:
        ids = tok.library.encode(t or "", add_special_tokens=False).ids
        assert tok.encode(t) == ids
        text = tok.library.decode(ids, skip_special_tokens=False)
        assert tok.decode(ids) == text
        assert tok.digests(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_automaton_accepts_exactly_bpe():
    """Over a tiny alphabet: an arc is there exactly if merging the two tokens' symbols gives the two back."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "ba"), ("aa", "aa"), ("aab", "a")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    auto = bpe_automaton.MergeAutomaton(vocab, merges)

    def bpe(symbols):
        symbols = list(symbols)
        while True:
            found = [(merges.index(p), i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
            if not found:
                return symbols
            _, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    for s in vocab:
        for t in vocab:
            if bpe(s) == [s] and bpe(t) == [t]:
                assert auto.arc(vocab[s], vocab[t]) == (bpe(s + t) == [s, t]), (s, t)
    rng = random.Random(1)
    for _ in range(500):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        assert [auto.label[i] for i in auto.encode([vocab[c] for c in w])] == bpe(w)


def test_automaton_looks_up_few_arcs():
    """Invented and long words, with the library's ids, for less than two cells of the transition table a token: only arcs on the way are looked up."""

    class Counted(dict):
        looked_up = 0

        def get(self, key):
            self.looked_up += 1
            return super().get(key)

    tok, rng = bpe_automaton.WordTokenizer(WORD), random.Random(5)
    tok.automaton.arcs = Counted()
    parts = ["th", "er", "in", "ou", "sh", "bl", "ed", "ti", "on", "an", "ly", "é", "ß", "ción", "ver", "q", "z"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 7))) for _ in range(2000)]
    words += ["".join(rng.choice(parts) for _ in range(9000)), "a" * 20000]
    found = [tok.ids(w) for w in words]
    assert tok.automaton.arcs.looked_up < 2 * sum(map(len, found))
    for w, ids in [*zip(words, found), (last := "ab" * 9000 + "z", tok.ids(last))]:  # the last goes wrong at its end and back to its start
        assert ids == tok.library.encode(w, add_special_tokens=False).ids, w[:80]
    with pytest.raises(ValueError):
        tok.automaton.encode([tok.inner[97], tok.automaton.size])


def test_encoding_table(spark, docs):
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r.n_tokens for r in bpe_automaton.encoding_table(docs, WORD).collect() if r.doc_id is not None}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert bpe_automaton.encoding_table(docs.limit(0), WORD).count() == 0


def test_sum_of_squares_fills_bins():
    rng = np.random.default_rng(0)
    lengths = -np.sort(-rng.integers(1, 101, 3000))
    p = packing.SumOfSquares(100)
    placed = [p.place(int(n)) for n in lengths]
    filled: dict[int, int] = {}
    for (b, o), n in zip(placed, lengths):
        assert filled.get(b, 0) == o
        filled[b] = o + int(n)
    assert max(filled.values()) <= 100
    assert p.bins <= lengths.sum() / 100 * 1.02 + 2
    with pytest.raises(ValueError):
        p.place(0)


def test_pack_documents(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(docs.filter("doc_id is not null"), BYTE).toPandas()
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist()
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and g.length.sum() <= 1024
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_encoders_on_runs_of_white_space():
    enc, lib, word = token_files.encoder(BYTE), Tokenizer.from_file(BYTE), bpe_automaton.tokenizer(WORD)
    rng = random.Random(9)
    for _ in range(6000):
        t = "".join(rng.choice(["a", "B1", "'s", "'", ",", "é", "½", "7", "ªµ", "İ", " ", " ", "  ", "\n", "\n", "\t", "\xa0", "\r\n"]) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(enc(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t
        ids = word.library.encode(t, add_special_tokens=False).ids
        assert word.digests(t)[:2] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), t


def test_memos_turn_when_full(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_BYTES", 3000)
    monkeypatch.setattr(bpe_automaton, "MEMO_BYTES", 3000)
    enc, tok, lib = token_files.TextEncoder(BYTE), bpe_automaton.WordTokenizer(WORD), Tokenizer.from_file(BYTE)
    for _ in range(3):
        for t in TEXTS[:6] + [" ".join(f"word{i}" for i in range(200)), "a " + "b" * 500 + " c"]:
            assert np.frombuffer(enc(t), enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
            assert tok.digests(t)[0] == len(tok.library.encode(t, add_special_tokens=False).ids)
    assert 0 < len(enc.units) < 250 and enc.units.old


def test_sum_of_squares_takes_the_best_gap():
    """Every placement is the one after which the sum of squares is smallest, by trying all open bins."""
    rng = np.random.default_rng(4)
    for capacity in (7, 20, 50):
        p, gaps = packing.SumOfSquares(capacity), {}
        for n in rng.integers(1, capacity + 1, 400).tolist():
            fits = {}
            for b, g in gaps.items():
                if g >= n:
                    after = [h for c, h in gaps.items() if c != b and h] + ([g - n] if g > n else [])
                    fits[b] = sum(k * k for k in np.unique(after, return_counts=True)[1].tolist())
            b, offset = p.place(n)
            if not fits:
                assert b not in gaps and offset == 0
                gaps[b] = capacity - n
                continue
            least = min(fits.values())
            assert fits[b] == least and gaps[b] == min(gaps[c] for c in fits if fits[c] == least) and offset == capacity - gaps[b]
            gaps[b] -= n


def test_equal_rows_go_to_different_blocks(spark):
    rows = [(None if i % 2 else 7, 0, 0, 900, 5) for i in range(4000)]
    pieces = packing.written(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    got = packing.pack(pieces, block_pieces=500).toPandas()
    sizes = got.groupby(got.sequence_id // (1 << 40)).size()
    assert len(got) == 4000 and len(sizes) == 8 and sizes.max() < 1000 and got.sequence_id.nunique() == 4000
