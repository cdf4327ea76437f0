import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from chartstone.llm import ann, components, langid, licenses, line_dedup, near, quality, simhash

SCHEMA = "doc_id long, text string, lang string, words string, n_chars long"
EDGES = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one"),
    (4, "one two three"),
    (5, "a b c d e f g h i j " * 400),
    (6, "1234 5678 !!"),
    (7, "Line of words\n" * 20),
    (8, "Line of words\n" * 20),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, None if i in (1, 3, 5, 7) else "en", "x", 1) for i, t in EDGES + [(4, "one two three"), (None, "no id at all")]], SCHEMA)


# --- SimHash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprint():
    for _, t in EDGES + [(0, "ÀB cD éF GH ÌJ"), (0, "a b c d e"), (0, "x " * 9)]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_find_every_pair(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                g ^= 1 << b
            prints.add(g)
    prints = sorted(prints)
    def signed(f):
        return f - (1 << 64) if f >> 63 else f

    def groups(pairs):
        parent = list(range(len(prints)))
        for i, j in pairs:
            a, b = parent[i], parent[j]
            parent = [min(a, b) if x in (a, b) else x for x in parent]
        return parent

    place = {signed(f): i for i, f in enumerate(prints)}
    got = [tuple(sorted((place[r.u], place[r.v]))) for r in simhash.links(spark.createDataFrame([(f,) for f in place], "fp long")).collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert set(got) <= set(want) and groups(got) == groups(want) and len(set(groups(want))) > 60


def test_dense_groups_are_stars(spark):
    """All fingerprints within two bits of one: every pair links, the links written are few."""
    prints = [0] + [(1 << i) for i in range(63)] + [(1 << i) | (1 << j) for i in range(63) for j in range(i)]
    found = simhash.links(spark.createDataFrame([(f,) for f in prints], "fp long"))
    assert found.count() < 8 * len(prints)
    assert {r.to for r in components.components(found).collect()} == {0}


def test_simhash_broadcasts_nothing(spark, edges, monkeypatch):
    """Files of fingerprints are many times as large in the driver's memory, so no size of theirs may lead to a broadcast."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return line_dedup.written(df, name)

    monkeypatch.setattr(simhash, "written", written)
    monkeypatch.setattr(components, "written", written)
    near_text = " ".join(f"w{i}" for i in range(300))
    df = edges.select("doc_id", "text").unionByName(spark.createDataFrame([(50, near_text), (51, near_text + " end")], "doc_id long, text string"))
    written(simhash.near_duplicates(df), "out")
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 6 and not [p for p in joins if "Broadcast" in p]


def test_simhash_table(spark, edges):
    got = {r.doc_id: r for r in simhash.simhash_table(edges).collect() if r.doc_id is not None}
    assert got[0].fingerprint == got[1].fingerprint == got[2].fingerprint == "0" * 16
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert got[8].component_id == got[7].component_id == 7
    assert simhash.simhash_table(edges).count() == edges.count()
    assert simhash.simhash_table(edges.limit(0)).count() == 0
    kept = simhash.keep_first(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [0, 3, 4, 5, 6, 7, None]
    assert simhash.keep_first(edges.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(300)]
    far = " ".join(f"x{i}" for i in range(300))

    def text(*changed):
        return " ".join("other" if i in changed else w for i, w in enumerate(base))

    rows = [(None, text()), (None, text(5)), (9, text(7)), (9, far), (9, far), (3, far), (None, "alone here now"), (None, "alone here now")]
    df = spark.createDataFrame([(i, t, "gone", "key") for i, t in rows], "doc_id long, text string, gone string, `key` string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_first(df).collect()), key=str)
    assert kept == sorted([(9, text(7)), (3, far), (None, "alone here now")], key=str)
    # a fingerprint that null ids alone hold joins two others
    prints = [0b0, 0b1111, 0b11111111]
    table = spark.createDataFrame([(1, prints[0]), (None, prints[1]), (5, prints[2]), (None, 1 << 40 | 0xFFFFF << 10)], "doc_id long, fp long")
    simhash_fingerprints = simhash.fingerprints
    simhash.fingerprints = lambda df, *_: df
    try:
        got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(table).collect()}
    finally:
        simhash.fingerprints = simhash_fingerprints
    assert got == {(1, 0): 1, (None, 15): 1, (5, 255): 1, (None, 1 << 40 | 0xFFFFF << 10): None}


def test_fingerprint_of_a_long_text(monkeypatch):
    rng = random.Random(6)
    long = " ".join(rng.choice(["a", "b", "cc", "ddd"]) + str(rng.randrange(50)) for _ in range(70_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    got = {r.id: r.to for r in components.components(spark.createDataFrame(edges + [(None, 3)], "u long, v long")).collect()}
    assert {k: got[k] for k in want} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- quality


def plain_figures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_figures(spark, edges):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bb", "c#", "d|e", "é", "x\ny", "x \n"]) for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    df = edges.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = df.join(quality.quality_table(df).withColumnRenamed("doc_id", "id"), df["doc_id"].eqNullSafe(quality.F.col("id"))).collect()
    assert len(rows) >= df.count()
    for r in rows:
        n = plain_figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality_table(df.limit(0)).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark, edges):
    clean = "The committee met on Monday and agreed to publish the report that had been delayed since spring."
    junk = ["SHOUTING LOUDLY " + " ".join(f"WORD{c}" for c in "ABCDEFGHIJKLM"), " ".join(f"w{c} ###" for c in "abcdefghijklm"), " ".join(f"{i}{i}{i}{i}" for i in range(10, 40))]
    df = spark.createDataFrame([(0, clean, "en", "x", 1)] + [(i + 1, t, "en", "x", 1) for i, t in enumerate(junk)], SCHEMA)
    kept = quality.keep_quality(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [0]
    order = quality.estimate(df)
    assert sorted(r.name for r, _, _ in order) == sorted(r.name for r in quality.BASE_RULES + quality.RULES)
    # conditional shares: each document is rejected once at most, so nothing is left for the rules behind
    left = 1.0
    for _, cost, share in order:
        assert cost > 0 and 0 <= share <= 1
        left *= 1 - share
    assert abs(left - 0.25) < 1e-9
    clash = df.withColumns({"words": quality.F.lit(7), "f": quality.F.lit("x"), "_q_n_words": quality.F.lit(9)})
    assert [(r.words, r.f, r._q_n_words) for r in quality.keep_quality(clash).collect()] == [(7, "x", 9)]


def test_cascade_spares_what_it_does_not_reach(spark):
    """A figure behind the first rejection is not computed: raise_error would end the query."""
    F = quality.F
    bomb = quality.Rule("bomb", ("words",), lambda v: F.raise_error(F.lit("reached")).cast("boolean"), "")
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    have = {"text": F.col("text")}
    assert df.select(quality.cascade([quality.BASE_RULES[0], bomb], have).alias("k")).collect()[0].k is False
    with pytest.raises(Exception, match="reached"):
        df.select(quality.cascade([bomb, quality.BASE_RULES[0]], have).alias("k")).collect()


def test_keep_quality_equals_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in quality.quality_table(docs).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_quality(docs).collect()} == want and 0 < len(want) < docs.count()


# --- licenses


def plain_base(text):
    words = licenses.split_words(text or "")
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    ("Released under the MIT License.", "mit"),
    ("x mit license mit-license MIT LICENSE y\nApache License", "apache,mit"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Some prose. Licensed under the Apache License, Version 2.0. More prose", "apache,apache-2.0"),
    ("intro words " * 50 + licenses.TEMPLATES[1][1] + " outro", "mit-text"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("the license of the work is under a general version of the public", ""),
    ("mit. É license général public license", ""),
]


def test_license_scan(spark, edges):
    df = spark.createDataFrame([(100 + i, t, "en", "x", 1) for i, (t, _) in enumerate(LICENSED)], SCHEMA).union(edges)
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    for i, r in rows.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[i])
        assert 0 <= r.score <= 1
    assert [rows[100 + i].labels for i in range(len(LICENSED))] == [x for _, x in LICENSED]
    assert licenses.scan(df.limit(0)).count() == 0


def plain_labels(texts, items):
    """(labels, score) of each text by the rule in plain code, template by template."""
    index = licenses.templates(items)
    split = [licenses.split_words(t or "") for t in texts]
    vocabulary = {w for t in index for w in t.words} | {w for t in index for p in t.phrases for w in p.split()}
    n = {w: sum(w in set(words) for words in split) for w in vocabulary}
    rare = lambda w: (n[w], w)
    lead = {min(p.split(), key=rare) for t in index for p in t.phrases}
    out = []
    for text, words in zip(texts, split):
        held = sorted(vocabulary & set(words), key=rare)
        looked = set(held[: licenses.LOOKED_UP]) | (lead & set(held))
        labels, share = set(), 0.0
        for t in index:
            own = looked & set(t.words)
            if not own or not any(f" {p} " in f" {' '.join(words)} " for p in t.phrases):
                continue
            votes = Counter(i - p for i, w in enumerate(words) if w in own for p, v in enumerate(t.words) if v == w)
            best = max(votes.values())
            if 100 * best >= licenses.ALIGNED_PERCENT * len(own):
                labels.add(t.label)
                share = max(share, min(1.0, best / len(own)))
        base = plain_base(text)
        out.append((",".join(sorted(labels | set(filter(None, base[4].split(","))))), 1.0 if base[1] else share))
    return out


def scanned(spark, texts, items):
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return [(r.labels, r.score) for r in licenses.scan(df, items=items).orderBy("doc_id").collect()]


def test_license_scan_equals_plain_code(spark):
    pick = random.Random(3)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    pool = sorted({w for text in notices for w in licenses.split_words(text)}) + ["prose"] * 60
    texts = [None, "", " . "]
    for i in range(160):
        words = []
        for _ in range(pick.randrange(1, 4)):
            words += pick.choices(pool, k=pick.randrange(30))
            part = licenses.split_words(pick.choice(notices))
            words += [w for w in part if pick.random() > (0, 0.05, 0.3)[i % 3]]
        texts.append(" ".join(words))
    got, want = scanned(spark, texts, licenses.TEMPLATES), plain_labels(texts, licenses.TEMPLATES)
    assert got == want and len({x for x, _ in got}) > 8


def test_license_index_of_hundreds_of_whole_licenses(spark):
    pick = random.Random(4)
    words = [f"term{i}" for i in range(900)]
    items = []
    for k in range(300):
        body = pick.choices(words, k=200)
        items.append((f"license-{k:03}", " ".join(body), (" ".join(body[50:56]),)))
    copied = [pick.sample(range(300), 2) for _ in range(12)]
    texts = [f"{items[a][1]} some prose {' '.join(pick.choices(words, k=300))} {items[b][1]}" for a, b in copied]
    got = scanned(spark, [*texts, " ".join(words)], tuple(items))
    assert [labels for labels, _ in got] == [",".join(sorted({items[a][0], items[b][0]})) for a, b in copied] + [""]


# --- language


def test_language(spark, edges):
    rng = random.Random(0)
    vocab = {"xx": ["aba", "bab", "abba", "baba"], "yy": ["oxo", "xox", "xoxo", "oxxo"], "zz": ["éné", "nén", "nééné"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randrange(5, 300))), k, "x", 1) for i, k in enumerate(rng.choice(list(vocab)) for _ in range(400))]
    df = spark.createDataFrame(rows, SCHEMA)
    truth = {r[0]: r[2] for r in rows}
    got = langid.language_table(df.unionByName(edges.filter("doc_id is null"))).collect()
    unseen = [r for r in got if r.held_out]
    assert {r.doc_id for r in unseen} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, edges):
    got = {r.doc_id: r for r in langid.language_table(edges).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4
    assert langid.language_table(edges.limit(0)).count() == 0
    none = edges.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_table(none).collect()} == {"und"}
    kept = langid.keep_identified(edges)
    assert kept.columns == edges.columns and {0, 1, 2, 6}.isdisjoint({r.doc_id for r in kept.collect()})


def test_tables_are_the_convolution():
    model = langid.ByteCNN.start(["a", "b"], seed=1)
    x = np.random.default_rng(0).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    fast, _ = model.pooled(x, model.tables())
    e = model.embed[x]
    slow = [sum(e[:, k : langid.WINDOW - w + 1 + k] @ kernel[k] for k in range(w)).max(1) for w, kernel in zip(langid.WIDTHS, model.conv)]
    assert np.allclose(fast, np.concatenate(slow, 1), atol=1e-4)


# --- nearest neighbours


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-float(v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w))), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(1500)]
    rows += [(1500 + i, rows[3][1]) for i in range(40)] + [(1600, rows[50][1]), (1650, rows[3][1]), (1700, None), (1750, [0.0] * 16), (1800, [float("nan")] * 16), (1850, [None] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [j for j, _ in got[1650]] == [3, 1500, 1501, 1502, 1503]
    exact = {(q, j): s for q, found in brute_nearest(rows, 2000).items() for j, s in found}
    assert all(abs(exact[q, j] - s) < 1e-12 for q, found in got.items() for j, s in found)


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], schema)).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 2), (0, 2, 1)]


# --- line dedup


def plain_line_dedup(docs, min_words=50):
    """The same result for unique ids by comparing every pair of places."""
    kept = [(i, t) for i, t in sorted(docs, key=lambda x: x[0]) if t is not None]
    lines = {i: [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] for i, t in kept}
    count = {i: [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in ls] for i, ls in lines.items()}
    places = [(i, p) for i in lines for p in range(len(lines[i]))]
    by_line: dict = {}
    for i, p in places:
        by_line.setdefault(lines[i][p], []).append((i, p))
    gone: dict = {i: set() for i in lines}
    for i, p in places:
        best = 0
        for j, q in by_line[lines[i][p]]:
            if (j, q) >= (i, p):
                break
            n = 0
            while p + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][p + n] == lines[j][q + n]:
                n += 1
            best = max(best, n)
        if sum(count[i][p : p + best]) > min_words:
            gone[i].update(range(p, p + best))
    return {i: t if t is None or not gone[i] else line_dedup.without_lines(t, gone[i]) for i, t in docs}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    vocab = [" ".join([f"w{k}"] * n) for k, n in enumerate([60, 30, 20, 10, 5, 3, 1, 12, 26, 25, 51, 50, 17])]
    docs: list = []
    for i in range(150):
        lines = [rng.choice(vocab[:4] if i % 3 else vocab) + ("" if rng.random() < 0.9 else "  ") if rng.random() < 0.95 else "" for _ in range(rng.randrange(0, 40))]
        text = "\n".join(lines)
        if docs and rng.random() < 0.3:
            text += "\n" + "\n".join(rng.choice(docs)[1].split("\n")[rng.randrange(5) :])
        docs.append((i, text))
    docs += [(1000, None), (1001, "")]
    clashing = spark.createDataFrame([(*d, i, "zz") for i, d in enumerate(docs)], "doc_id long, text string, count int, cleaned string")
    rows = line_dedup.dedup_lines(clashing).collect()
    assert {r.doc_id: r.text for r in rows} == plain_line_dedup(docs)
    assert all(r["cleaned"] == "zz" and docs[r["count"]][0] == r.doc_id for r in rows)


def test_line_dedup_edges(spark, edges):
    out = line_dedup.dedup_lines(edges)
    assert out.columns == edges.columns and out.schema["n_chars"].dataType == edges.schema["n_chars"].dataType
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[8].text == "" and rows[8].n_chars == 0 and rows[0].text is None and rows[None].text == "no id at all"
    assert out.count() == edges.count()
    assert line_dedup.dedup_lines(edges.limit(0)).count() == 0
    assert line_dedup.line_table(edges).count() == edges.count()


def plain_shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_sketches_never_overstate():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300, 3000, 40_000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for share in (0.0, 0.5, 0.95, 1.0):
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(-(2**63), 2**63 - 1, n // 7)]))
            assert all(near.apart(near.sketch(a, k), near.sketch(b, k)) <= len(np.setxor1d(a, b)) for k in (near.COARSE, near.FINE))
            assert near.apart(near.group_sketch(a), near.group_sketch(b)) <= len(np.setxor1d(a, b))
    a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, 5000)) for _ in range(2))
    assert 9 * near.apart(near.sketch(a, near.COARSE), near.sketch(b, near.COARSE)) > len(a) + len(b)  # unlike sets are ruled out whatever their size


def test_near_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    line = [f"c{i}" for i in range(12)]  # a line that many texts hold
    texts = []
    for i in range(40):
        base = rng.choices(words, k=rng.choice((3, 5, 20, 30, 60, 120, 250))) + (line if i % 2 else [])
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[: len(copy) - rng.randrange(0, 3)]))
    rng.shuffle(texts)
    docs = list(enumerate(texts)) + [(len(texts), None), (len(texts) + 1, "")]
    sets = {i: plain_shingles(t) for i, t in docs}
    root, far = {i: i for i in sets}, 0
    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                far += (simhash.fingerprint(docs[i][1]) ^ simhash.fingerprint(docs[j][1])).bit_count() > 4
                x, y = root[i], root[j]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    assert far > 20  # pairs that four bits miss
    want = sorted(set(root.values()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for common, hubs, block in ((10, 8, 4096), (10**9, 8, 4096), (10**9, 1, 2)):  # neither the order of the shingles nor hubs nor blocks move a result
        for name, value in (("COMMON", common), ("HUBS", hubs), ("BLOCK", block)):
            monkeypatch.setattr(near, name, value)
        assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == want


def test_near_copies_are_found_by_fingerprints_first(spark, monkeypatch):
    """The stage links fingerprints by their variants, checks them, and prefixes are left with what these don't join."""
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[:150] + ["x"] * 200), "one two three four five six"]
    prints = {near.majority(near.shingle_set(t)) for t in texts}
    seen, compared = [], []

    def links(df, *_):
        seen.extend(r.fp % 2**64 for r in df.collect())
        return found(df)

    def verified(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    found, verify = simhash.links, near._verified
    monkeypatch.setattr(simhash, "links", links)
    monkeypatch.setattr(near, "_verified", verified)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == [0, 2, 3]
    assert set(seen) == prints and len(seen) == len(prints) and compared == [1, 0, 0]


# --- pipeline


def plain_kept(text):
    n_words, chars, symbols, dup, repeat = plain_figures(text)
    text = text or ""
    lines = len([x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)])
    upper, digits = len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text))
    ellipsis = len(re.findall("(?:[.][.][.]|\u2026)[ \t\r]*(?:\n|$)", text))
    return not (
        n_words < 10 or 100 * repeat > 20 * n_words or 10 * symbols > n_words or chars < 3 * n_words or chars > 10 * n_words
        or 10 * dup > 3 * lines or 10 * upper > 4 * chars or 10 * digits > 4 * chars or 10 * ellipsis > 3 * lines
    )


def plain_first_of_groups(docs):
    """The smallest id of each group of texts whose 5-word shingles have a similarity of 0.8 or more."""
    sets = {i: plain_shingles(t) for i, t in docs.items()}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return set(root.values())


def test_pipeline(spark):
    """Each stage against plain code, by equality, on what the stage before kept."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns, name
        out = line_dedup.written(out, name)
        return out, {r.doc_id: r.text for r in out.collect()}

    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.train(docs)
    tables = model.tables()
    docs, kept = after("language_id", docs)
    best = {i: model.predict([t], tables)[0] for i, t in texts.items()}
    assert kept == {i: t for i, t in texts.items() if best[i][0] != "und" and best[i][1] >= 0.6}
    texts = kept
    docs, kept = after("quality_rules", docs)
    assert kept == {i: t for i, t in texts.items() if plain_kept(t)} and len(kept) < len(texts)
    texts = kept
    docs, kept = after("line_dedup", docs)
    assert kept == plain_line_dedup(list(texts.items()))
    texts = kept
    docs, kept = after("simhash_near_dedup", docs)
    first = plain_first_of_groups(texts)
    assert kept == {i: t for i, t in texts.items() if i in first} and len(kept) < len(texts)
    packed = stages["best_fit_packing"](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == set(kept) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_on_edges(spark, edges):
    import corpus_pipeline

    for docs in (edges.limit(0), edges):
        for name, stage in corpus_pipeline.STAGES:
            docs = line_dedup.written(stage(spark, docs, ""), name)
    assert docs.count() == 0  # nothing of the edge rows is clean


def test_scan_holds_the_nearest(monkeypatch):
    """Against plain distances: with the test's error out of the way nothing near is lost, whatever the bound; with it, hardly any."""
    rng = np.random.default_rng(8)
    for clustered in (False, True):
        p = rng.standard_normal((3000, 64))
        if clustered:
            p = 0.3 * p + rng.standard_normal((20, 64))[rng.integers(0, 20, 3000)]
        p, rotate = ann.unit(p), ann.rotation(64)
        q = p[::60]
        d = ((q[:, None] - p[None]) ** 2).sum(2)
        want = np.argsort(d, axis=1, kind="stable")[:, :6]
        for known in (np.inf, 1.0001 * np.take_along_axis(d, want, 1)[:, 5], 0.0):
            bound = np.full(len(q), known) if np.isscalar(known) else known
            monkeypatch.setattr(ann, "EPSILON", 1e9)
            i, j = ann.scan_part(q @ rotate, p @ rotate, bound, 6)
            got = set(zip(i.tolist(), j.tolist()))
            assert all((a, b) in got for a in range(len(q)) for b in want[a] if d[a, b] <= bound[a])
            monkeypatch.setattr(ann, "EPSILON", 2.1)
            i, j = ann.scan_part(q @ rotate, p @ rotate, bound, 6)
            got = set(zip(i.tolist(), j.tolist()))
            near = [(a, b) in got for a in range(len(q)) for b in want[a] if d[a, b] <= bound[a]]
            assert np.mean(near) > 0.98 and len(got) < 0.2 * d.size


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_nearest_in_small_skewed_clusters(spark, spread):
    """Lists of few rows, one huge cluster: every query gets five neighbours, and mixed lengths don't decide by file order."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 12))
    rows = [(0, [1.0, 2.0])]
    for i in range(1, 900):
        c = 0 if i % 3 == 0 else 1 + i % 39
        rows.append((i, (centres[c] + spread * rng.standard_normal(12)).tolist()))
    rows += [(1000, (10 * centres[5]).tolist()), (1050, (-centres[0]).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got: dict = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest([r for r in rows if len(r[1]) == 12])
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert np.mean([j in got[q] for q in want for j, _ in want[q]]) > 0.95


def test_letters():
    assert langid.has_letter("1 é") and langid.has_letter("中") and not any(map(langid.has_letter, ["½ ² ① Ⅷ 12", "", None, " \n_-"]))


def test_prediction_in_batches():
    model = langid.ByteCNN.start(["a", "b", "c"], seed=3)
    tables = model.tables()
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([1, 5, 255, 256, 257, 3000, 60_000]))) for _ in range(40)] + [None, "", "12"]
    together = model.predict(texts, tables)
    for t, (lang, score) in zip(texts, together):
        assert model.predict([t], tables)[0][0] == lang and abs(model.predict([t], tables)[0][1] - score) < 1e-5
        if not langid.has_letter(t):
            assert (lang, score) == ("und", 0.0)
            continue
        data = t.encode()
        logs, weights = [], []
        for a in range(0, len(data), langid.WINDOW):  # window by window
            x = langid.windows_of(data[a : a + langid.WINDOW])
            logs.append(model.log_probabilities(x, tables)[0])
            weights.append(min(langid.WINDOW, len(data) - a))
        mean = np.average(logs, axis=0, weights=weights)
        p = np.exp(mean) / np.exp(mean).sum()
        assert abs(p.max() - score) < 1e-5
