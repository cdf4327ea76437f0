"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window of WINDOW bytes and
classified by a softmax. A text is cut into such windows over its whole length; the prediction is the
language with the largest mean log-probability over its windows, weighted by their bytes.

Training uses a documented bound: TRAIN_DOCS documents a language, chosen by a hash of doc_id, and
TRAIN_WINDOWS windows of each; the driver receives those windows alone. Inference compiles
embedding and filters into tables over byte pairs (a convolution is a sum of one row a byte), so it needs a
lookup and a maximum for each position.

Inputs of a prediction are the text's bytes alone. Defined results: a null text, or one without a
letter, is ``und`` with score 0; without any labelled row everything is ``und``; an empty table gives no rows;
repeated rows get the same prediction, up to rounding; of equal scores the first label wins; a very long text goes through all its windows
in slices; other columns pass through ``keep_identified`` whatever their names, and the other results read only those named.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
EMBED = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
TRAIN_DOCS = 300
TRAIN_WINDOWS = 4
EPOCHS = 8
BATCH = 64
UNKNOWN = "und"
#: Windows that go through the tables at once.
SLICE = 64
#: Languages that are learned, the most frequent ones: what bounds the labels that the driver holds.
MOST_LANGUAGES = 1000


def held_out(doc_id: Column) -> Column:
    """The fold of the contract: crc32 of the id's digits mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter (Unicode category L)."""
    return bool(text) and any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes over the whole text, the last row padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteCNN:
    labels: list[str]
    embed: np.ndarray  # (256, EMBED)
    conv: list[np.ndarray]  # for each width (width, EMBED, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, labels)
    out_bias: np.ndarray

    @classmethod
    def start(cls, labels: list[str], seed: int = 42) -> ByteCNN:
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        pooled = len(WIDTHS) * FILTERS
        return cls(
            labels,
            f32(256, EMBED, scale=0.5),
            [f32(w, EMBED, FILTERS, scale=1 / np.sqrt(w * EMBED)) for w in WIDTHS],
            np.zeros(pooled, np.float32),
            f32(pooled, len(labels), scale=0.1),
            np.zeros(len(labels), np.float32),
        )

    def tables(self) -> list[list[np.ndarray]]:
        """For each width its lookup tables: over byte pairs, then over a single byte if the width is odd."""
        found = []
        for w, kernel in zip(WIDTHS, self.conv):
            rows = [self.embed @ kernel[k] for k in range(w)]  # (256, FILTERS)
            pairs = [(rows[k][:, None, :] + rows[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            found.append(pairs + ([rows[-1]] if w % 2 else []))
        return found

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]], places: bool = False):
        """Max over positions of every filter, (n, pooled), and where it stands."""
        code = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best, at = [], []
        for w, parts in zip(WIDTHS, tables):
            n = WINDOW - w + 1
            total = parts[0][code[:, :n]]
            for k, part in enumerate(parts[1:], 1):
                total += part[code[:, 2 * k : 2 * k + n]] if len(part) == 65536 else part[x[:, 2 * k : 2 * k + n]]
            if places:
                p = total.argmax(axis=1)
                at.append(p)
                best.append(np.take_along_axis(total, p[:, None, :], 1)[:, 0])
            else:
                best.append(total.max(axis=1))
        return np.concatenate(best, 1) + self.bias, at

    def log_probabilities(self, x: np.ndarray, tables) -> np.ndarray:
        z = np.maximum(self.pooled(x, tables)[0], 0) @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the cross entropy; windows are cut short at random so that short texts are learned too."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.conv, self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                i = order[a : a + BATCH]
                xb, yb = x[i].copy(), y[i]
                keep = np.where(rng.random(len(i)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(i)))
                xb[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
                grads = self._gradients(xb, yb)
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for k, (p, g) in enumerate(zip(params, grads)):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        raw, at = self.pooled(x, self.tables(), places=True)
        hidden = np.maximum(raw, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_hidden = (p @ self.out.T) * (raw > 0)
        d_embed = np.zeros_like(self.embed)
        d_conv = []
        for k, (w, kernel, places) in enumerate(zip(WIDTHS, self.conv, at)):
            d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            d_kernel = np.zeros_like(kernel)
            for j in range(w):
                b = np.take_along_axis(x, places + j, 1)  # (n, FILTERS): the byte under each filter's best place
                d_kernel[j] = np.einsum("nf,nfe->ef", d, self.embed[b])
                np.add.at(d_embed, b.ravel(), (d[:, :, None] * kernel[j].T[None]).reshape(-1, EMBED))
            d_conv.append(d_kernel)
        return [d_embed, *d_conv, d_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def predict(self, texts: list[str | None], tables) -> list[tuple[str, float]]:
        """(language, score) of each text.

        The windows of all texts stand end to end and go through the tables in slices of SLICE, whatever the texts' lengths.
        """
        out = [(UNKNOWN, 0.0)] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.labels and has_letter(t)]
        if not rows:
            return out
        data = [texts[i].encode() for i in rows]
        size = np.array([len(d) for d in data], np.int64)
        count = -(-size // WINDOW)
        ends = np.cumsum(count)
        total = np.zeros((len(rows), len(self.labels)))
        held, first, done = [], 0, 0  # texts not yet through, the first of them, windows that are through
        for k, d in enumerate(data):
            held.append(d)
            if ends[k] - done < 8 * SLICE and k < len(data) - 1:
                continue
            x = np.concatenate([windows_of(h) for h in held])
            owner = np.repeat(np.arange(first, k + 1), count[first : k + 1])
            weight = np.full(len(x), WINDOW, np.float64)
            last = ends[first : k + 1] - done - 1
            weight[last] = size[first : k + 1] - (count[first : k + 1] - 1) * WINDOW
            for a in range(0, len(x), SLICE):
                part = self.log_probabilities(x[a : a + SLICE], tables) * weight[a : a + SLICE, None]
                own = owner[a : a + SLICE]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[starts]] += np.add.reduceat(part, starts, axis=0)
            held, first, done = [], k + 1, int(ends[k])
        mean = total / size[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, k, score in zip(rows, best, p[np.arange(len(rows)), best]):
            out[i] = (self.labels[k], float(score))
        return out


def spark_shares(df: DataFrame, shares: dict[str, int]) -> DataFrame:
    """(_lang, _share), a row for each learned language: MOST_LANGUAGES at most."""
    return df.sparkSession.createDataFrame(list(shares.items()), "_lang string, _share int")


def training_windows(df: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and labels of the bounded sample; held-out rows never enter."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    by_lang = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r.lang: r["count"] for r in by_lang.collect()}
    labels = sorted(counts)
    if not labels:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    hashed = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    share = spark_shares(df, {k: int(min(1.0, 1.3 * docs / counts[k]) * 1_000_000) for k in labels})
    chosen = rows.join(F.broadcast(share), rows["lang"] == share["_lang"]).filter(hashed < F.col("_share")).select("id", "text", "lang")

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"id": [], "lang": [], "w": []}
            for i, text, lang in zip(*[c.to_pylist() for c in batch.columns]):
                x = windows_of(text.encode())
                if len(x) > 1:
                    x = x[:-1]  # a last window is mostly padding
                for k in np.linspace(0, len(x) - 1, min(TRAIN_WINDOWS, len(x))).astype(int):
                    out["id"].append(i)
                    out["lang"].append(lang)
                    out["w"].append(x[k].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("lang", pa.string()), ("w", pa.binary())]))

    got = chosen.select(F.col("id").cast("long"), "text", "lang").mapInArrow(cut, "id long, lang string, w binary")
    # repeated ids could make a hash range hold any number of rows: the first by (hash, id, window) of each language stay
    least = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "w")
    got = got.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= docs * TRAIN_WINDOWS)
    got = got.select("id", "lang", "w").toPandas().sort_values(["lang", "id", "w"])
    x = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, WINDOW)
    return x, np.array([labels.index(k) for k in got["lang"]], np.int64), labels


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN:
    x, y, labels = training_windows(df, id_col, text_col, lang_col)
    model = ByteCNN.start(labels)
    if len(x):
        model.train(x, y)
    return model


def predict(df: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) over whole texts; one pass, no shuffle. The model is some 30 kB."""

    def run(batches):
        tables = model.tables()
        for batch in batches:
            found = model.predict(batch.column(2).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_table(df: DataFrame) -> DataFrame:
    return predict(df, train(df))


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least ``least``, with the columns of df; in one pass over the rows."""
    model = train(df, id_col, text_col, lang_col)
    names = df.columns

    def run(batches):
        tables = model.tables()
        for batch in batches:
            found = model.predict(batch.column(names.index(text_col)).to_pylist(), tables)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
