"""Readers: pictures, masks, detections, text blocks, templates."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PICTURES = ("png", "jpg", "jpeg", "bmp", "gif")
DETECTION_KEYS = ("detections", "obstacles", "results", "data", "confirmed", "circles")
IMAGE_SCHEMA = "chart_id string, height int, width int, channels int, data binary"


def file_kind(path: Column) -> Column:
    """'image' or 'pdf' by suffix; anything else is an error when the row is used."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    bad = F.raise_error(F.concat(F.lit("unsupported file type: "), path))
    return F.when(suffix.isin(*PICTURES, "tif", "tiff"), "image").when(suffix == "pdf", "pdf").otherwise(bad.cast("string"))


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(chart_id, height, width, channels, data) in RGB order with Spark's own decoder; chart_id is the file's stem."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    plain = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))  # the source gives a URI
    stem = F.regexp_extract(plain, r"([^/]+?)(?:\.[^./]+)?$", 1)

    def to_rgb(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if r.height <= 0:
                    raise ValueError(f"not a picture: {r.chart_id}")
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                if r.nChannels >= 3:
                    a = a[..., [2, 1, 0]]
                rows.append((r.chart_id, r.height, r.width, a.shape[2], np.ascontiguousarray(a).tobytes()))
            yield pd.DataFrame(rows, columns=["chart_id", "height", "width", "channels", "data"])

    return raw.select(stem.alias("chart_id"), "height", "width", "nChannels", "data").mapInPandas(to_rgb, IMAGE_SCHEMA)


def read_pdf(spark: SparkSession, path: str, render=None, dpi: int = 300, page: int = 0) -> DataFrame:
    """Pages of PDF files through ``render(bytes, dpi, page) -> RGB array``; there is no renderer of our own."""
    if render is None:
        raise NotImplementedError("pass render=: a function that rasterises a PDF page (none is bundled)")
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("chart_id"), "content")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a = render(r.content, dpi, page)
                rows.append((r.chart_id, a.shape[0], a.shape[1], a.shape[2], np.ascontiguousarray(a).tobytes()))
            yield pd.DataFrame(rows, columns=["chart_id", "height", "width", "channels", "data"])

    return raw.mapInPandas(run, IMAGE_SCHEMA)


def fit_pictures(images: DataFrame, height: int, width: int) -> DataFrame:
    """Pictures at a common size, nearest neighbour."""

    def run(batches):
        ys, xs = lambda h: np.arange(height) * h // height, lambda w: np.arange(width) * w // width
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows.append((r.chart_id, height, width, r.channels, np.ascontiguousarray(a[ys(r.height)[:, None], xs(r.width)[None]]).tobytes()))
            yield pd.DataFrame(rows, columns=["chart_id", "height", "width", "channels", "data"])

    return images.mapInPandas(run, IMAGE_SCHEMA)


def read_detections(spark: SparkSession, path: str, schema: str = "pixel_x long, pixel_y long, tri_overlap double, dot_overlap double, blob_area_px2 long, solidity double") -> DataFrame:
    """Detections of JSON documents: the first known key that is present (even if empty), else the first list of objects.

    A document without any list of objects is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("doc"))
    return explode_detections(text, "doc", schema)


def explode_detections(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df's JSON documents exploded: df's other columns and the fields of ``schema``."""
    doc = F.col(column)
    known = F.coalesce(*[F.when(F.json_array_length(F.get_json_object(doc, f"$.{k}")).isNotNull(), F.get_json_object(doc, f"$.{k}")) for k in DETECTION_KEYS])
    keys = F.json_object_keys(doc)
    values = F.map_values(F.from_json(doc, "map<string,string>"))
    lists = F.filter(values, lambda v: F.coalesce(F.json_array_length(v) > 0, F.lit(False)) & v.rlike(r"^\s*\[\s*\{"))
    top = F.when(F.json_array_length(doc).isNotNull(), doc)
    found = F.coalesce(top, known, F.when(keys.isNotNull(), F.get(lists, 0)))
    found = F.when(found.isNull(), F.raise_error(F.lit("no list of detections in document")).cast("string")).otherwise(found)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.from_json(found, f"array<struct<{_struct(schema)}>>")).alias("_d")).select(*rest, "_d.*")


def _struct(schema: str) -> str:
    return ",".join(":".join(f.strip().split(None, 1)) for f in schema.split(","))


def read_detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as a CSV of detections has no types."""
    return spark.read.csv(path, header=True)


def read_templates(spark: SparkSession, path: str, ink_below: int = 200) -> dict[str, np.ndarray]:
    """Template pictures by stem as masks: a small library for kernels, a few kilobytes each."""
    out = {}
    for r in read_pictures(spark, path).toLocalIterator():
        a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
        out[r.chart_id] = a[..., : min(3, r.channels)].mean(2) < ink_below
    return out


def keep_readable_pages(blocks: DataFrame, least_share: float = 0.5, least_blocks: int = 5) -> DataFrame:
    """Text blocks (page_id, text, ...) with enough printable ASCII, of pages that keep at least ``least_blocks`` of them."""
    from chartstone.functions.text import printable_share

    good = blocks.filter(printable_share(F.col("text")) >= least_share)
    enough = good.groupBy("page_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_blocks).select("page_id")
    return good.join(enough, "page_id", "left_semi")


def read_vector_paths(spark: SparkSession, path: str) -> DataFrame:
    """Vector drawings (JSON lines: page_id, items of {op, x, y}) as point lists; only moves and lines count."""
    raw = spark.read.schema("page_id string, items array<struct<op:string,x:double,y:double>>, line_width double").json(path)
    lines = F.filter("items", lambda i: i["op"].isin("m", "l"))
    return raw.select("page_id", F.transform(lines, lambda i: F.struct(i["x"].alias("x"), i["y"].alias("y"))).alias("points"), "line_width").filter(F.size("points") > 0)


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA PNG to an array: for tests and small assets."""
    at, idat, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    w, h, depth, colour = head[:4]
    c = {0: 1, 2: 3, 6: 4}[colour]
    if depth != 8 or head[6]:
        raise ValueError("only 8-bit PNG without interlace")
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(w * c, int)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + up
        else:
            for i in range(w * c):
                a, b = (int(out[y, i - c]) if i >= c else 0), int(up[i])
                d = int(up[i - c]) if i >= c else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - d
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - d), 2, d))[2]
                out[y, i] = (line[i] + p) % 256
    return out.reshape(h, w, c)
