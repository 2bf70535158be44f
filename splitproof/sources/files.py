"""Scans: trees of files, class folders, checked tables, documents, series and sounds."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from math import gcd
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

#: Suffixes of images, and names of path parts that name a split.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
SPLITS = ("train", "test", "val", "validation")


def _relative(path: Column, root: str) -> Column:
    """A file's path below the root, whatever scheme the reader shows."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.substring_index(path, bare + "/", -1), "^/+", "")


def file_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGES, labels: DataFrame | None = None, least_depth: int = 1) -> DataFrame:
    """(rel, tree, split, label, sha256, stem) of the files below ``root`` with one of the suffixes, in any case.

    The label is the last folder, the tree the first part, the split the first part that names one (else ``unsplit``). ``labels``
    (label, name) maps folders to labels and drops the others. Bytes are read once, to be hashed where they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = _relative(F.col("path"), root)
    parts = F.split("rel", "/")
    rows = files.select(rel.alias("rel"), F.sha2("content", 256).alias("sha256")).where(F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1)).isin(*suffixes))
    rows = rows.withColumn("parts", parts).where(F.size("parts") > least_depth)
    folder = F.element_at("parts", -2)
    split = F.get(F.filter(F.transform("parts", lambda p: F.lower(p)), lambda p: p.isin(*SPLITS)), F.lit(0))
    name = F.regexp_replace(F.element_at("parts", -1), r"\.[^.]+$", "")
    out = rows.select("rel", F.get("parts", F.lit(0)).alias("tree"), F.coalesce(split, F.lit("unsplit")).alias("split"), F.lower(folder).alias("label"), "sha256", name.alias("stem"))
    if labels is None:
        return out
    mapped = out.join(F.broadcast(labels.select(F.lower("label").alias("label"), F.col("name").alias("__name"))), "label")
    return mapped.select("rel", "tree", "split", F.col("__name").alias("label"), "sha256", "stem")


def class_folders(spark: SparkSession, root: str, labels: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """S3: (sample_id, rel, split, label, zone) of ``root/split/class/file``; a class that ``labels`` (label, zone) doesn't know raises when rows are read."""
    rows = file_tree(spark, root, least_depth=2).where(~F.col("label").isin(*excluded) if excluded else F.lit(True))
    known = rows.join(F.broadcast(labels.withColumn("__known", F.lit(True))), "label", "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown class "), F.col("label")))).otherwise(F.col("label"))
    return known.select(F.substring(F.sha2("rel", 256), 1, 20).alias("sample_id"), "rel", F.col("tree").alias("split"), checked.alias("label"), "zone")


def indexed_classes(rows: DataFrame) -> DataFrame:
    """Adds the zero-based alphabetical index of each label; the labels are a small dimension."""
    names = rows.agg(F.array_sort(F.collect_set("label")).alias("names"))
    return rows.join(F.broadcast(names)).withColumn("class_index", F.array_position("names", F.col("label")) - 1).drop("names")


def checked_csv(spark: SparkSession, path: str, schema: StructType, sha256: str | None = None, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV whose bytes, header, rows and values are what they should be; raises ValueError if not."""
    if sha256:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
        if found is None or found[0] != sha256:
            raise ValueError(f"{path}: other bytes than expected")
    header = spark.read.text(path).first()
    if header is None or {c.strip() for c in header[0].split(",")} != set(schema.names) or len(header[0].split(",")) != len(schema.names):
        raise ValueError(f"{path}: other columns than {schema.names}")
    names = [c.strip() for c in header[0].split(",")]
    rows = spark.read.csv(path, header=True, schema=StructType([schema[n] for n in names]), mode="FAILFAST", enforceSchema=False)
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    for column, allowed in (domains or {}).items():
        if not rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).isEmpty():
            raise ValueError(f"{path}: {column} has values beyond {allowed}")
    return rows


def manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with a header and a schema."""
    return spark.read.csv(path, header=True, schema=schema)


def channels(rows: DataFrame, pattern: str) -> DataFrame:
    """the columns whose names match."""
    return rows.select(rows.colRegex(f"`{pattern}`"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of any layout."""
    return spark.read.json(path, multiLine=True)


def vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """Stored vectors by key."""
    return spark.read.parquet(path).select(key, vector)


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that raises ValueError unless both sides have the same keys."""
    ids = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    if not ids.where("l IS NULL OR r IS NULL").isEmpty():
        raise ValueError(f"the sides differ in {key}")
    return left.join(right, key)


def series_catalogue(spark: SparkSession, root: str, labels: DataFrame, rate: float = 25.0) -> DataFrame:
    """(path, emotion, person, fps, zone) of ``root/emotion/.../*.csv`` for the emotions in ``labels`` (emotion, zone).

    The person is the last part like Person_7, else a match in the name; the rate the number that ends the name, else ``rate``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select(_relative(F.col("path"), root).alias("path"))
    parts = F.split("path", "/")
    people = F.filter(parts, lambda p: p.rlike("^Person_[0-9]+$"))
    in_name = F.regexp_extract(F.element_at(parts, -1), "(Person_[0-9]+)", 1)
    person = F.when(F.size(people) > 0, F.element_at(people, -1)).when(in_name != "", in_name).otherwise("unknown")
    fps = F.coalesce(F.expr("try_cast(regexp_extract(path, '_([0-9]+(?:[.][0-9]+)?)[.]csv$', 1) AS double)"), F.lit(rate))
    rows = files.select("path", F.lower(F.get(parts, F.lit(0))).alias("emotion"), person.alias("person"), fps.alias("fps"))
    return rows.join(F.broadcast(labels), "emotion")


def features(rows: DataFrame, stored: DataFrame, path: str, label: str, classes: int) -> DataFrame:
    """Rows with the stored feature of their file's stem, and their label as a one-hot array."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == F.col(label), 1.0).otherwise(0.0))
    return rows.withColumn("stem", stem).join(stored, "stem").withColumn("one_hot", hot)


def wave_samples(content: bytes) -> tuple[int, np.ndarray]:
    """The rate and the mono samples (float32, -1 to 1) of a RIFF WAVE file: whole numbers of 8 to 32 bits or floats of 32 or 64."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, lanes, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            form = (struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE else kind, lanes, rate, bits // 8)
        elif name == b"data" and form:
            kind, lanes, rate, width = form
            if kind == 3:
                x = np.frombuffer(body, f"<f{width}").astype(np.float32)
            elif width == 1:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            else:  # the bytes become the upper ones of 32 bits
                wide = np.zeros((len(body) // width, 4), np.uint8)
                wide[:, 4 - width :] = np.frombuffer(body, np.uint8).reshape(-1, width)
                x = wide.view("<i4").ravel().astype(np.float32) / np.float32(1 << 31)
            return rate, x.reshape(-1, lanes).mean(1, dtype=np.float32)
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


def resampled_sound(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase resampling by target / rate with a Kaiser-windowed low-pass of ten zero crossings a side; equal rates change nothing."""
    step = gcd(rate, target)
    up, down = target // step, rate // step
    if up == down or not len(x):
        return x
    most = max(up, down)
    side = 10 * most
    taps = np.sinc(np.arange(-side, side + 1) / most) * np.kaiser(2 * side + 1, 5.0)
    taps *= up / taps.sum()
    out = np.zeros(-(-len(x) * up // down))
    places = np.arange(len(out)) * down + side  # in the stretched input, where every up-th place holds a sample
    padded = np.r_[np.zeros(2 * side // up + 1), x, np.zeros(2 * side // up + 1)]
    for k in range(2 * side // up + 1):
        tap = places % up + k * up
        inside = tap <= 2 * side
        out[inside] += taps[tap[inside]] * padded[places[inside] // up - k + 2 * side // up + 1]
    return out.astype(np.float32)


def sounds(spark: SparkSession, root: str, target: int | None = None) -> DataFrame:
    """(path, rate, samples) of WAVE files: mono, from -1 to 1, at the rate ``target`` if one is given."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select(_relative(F.col("path"), root).alias("path"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                rate, x = wave_samples(content)
                out.append((path, target or rate, resampled_sound(x, rate, target or rate).tolist()))
            yield pd.DataFrame(out, columns=["path", "rate", "samples"])

    return files.mapInPandas(run, "path string, rate int, samples array<float>")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The first sheet of an Office Open XML workbook: a row of texts for each row, numbers as they are written, null where a cell is empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        sheet = ElementTree.fromstring(z.read(min(names, key=lambda n: (len(n), n))))
    out = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{_SHEET}c"):
            at = 0
            for letter in re.sub("[^A-Z]", "", c.get("r", "")):
                at = 26 * at + ord(letter) - 64
            cells += [None] * (at - 1 - len(cells))
            value = c.find(f"{_SHEET}v")
            inline = c.find(f"{_SHEET}is")
            text = "".join(t.text or "" for t in inline.iter(f"{_SHEET}t")) if inline is not None else value.text if value is not None else None
            cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
        out.append(cells)
    return out


def sheets(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of the first sheets of the workbooks (.xlsx) below ``root``. The first row names the columns; those of ``schema`` are read, all texts."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(root).select("content")
    names = StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                head, *rows = sheet_rows(content) or [[]]
                if missing := [n for n in names if n not in head]:
                    raise ValueError(f"a sheet without {missing}")
                at = [head.index(n) for n in names]
                yield pd.DataFrame([[r[i] if i < len(r) else None for i in at] for r in rows], columns=names, dtype=object)

    return files.mapInPandas(run, ", ".join(f"`{n}` string" for n in names))


def video_frames(content: bytes) -> Iterator[bytes]:
    """The frames of a YUV4MPEG2 stream with 8 bits: their planes, one behind another."""
    head, _, rest = content.partition(b"\n")
    marks = {m[:1]: m[1:].decode() for m in head.split(b" ")[1:]}
    if not head.startswith(b"YUV4MPEG2") or b"W" not in marks or b"H" not in marks:
        raise ValueError("not a YUV4MPEG2 stream")
    width, height, layout = int(marks[b"W"]), int(marks[b"H"]), marks.get(b"C", "420")
    chroma = {"mono": 0, "444": 2 * width * height, "422": 2 * ((width + 1) // 2) * height}.get(layout, 2 * ((width + 1) // 2) * ((height + 1) // 2))
    at = 0
    while at < len(rest):
        start = rest.index(b"\n", at) + 1
        if not rest.startswith(b"FRAME", at):
            raise ValueError("a stream without its frame mark")
        at = start + width * height + chroma
        yield rest[start:at]


def frames(spark: SparkSession, root: str) -> DataFrame:
    """(path, frame, content) of every frame, from 0, of the uncompressed videos (.y4m) below ``root``. Compressed ones need a decoder, which isn't here."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.y4m").load(root).select(_relative(F.col("path"), root).alias("path"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            for path, content in zip(f["path"], f["content"], strict=True):
                for i, frame in enumerate(video_frames(content)):
                    yield pd.DataFrame({"path": [path], "frame": [i], "content": [frame]})

    return files.mapInPandas(run, "path string, frame long, content binary")


def session_key(path: Column) -> Column:
    """what a file's name has before its first hyphen, without the last three characters."""
    first = F.substring_index(F.element_at(F.split(path, "/"), -1), "-", 1)
    return F.substring(first, F.lit(1), F.greatest(F.char_length(first) - 3, F.lit(0)))


def speech_share(intervals: Column, samples: Column) -> Column:
    """the share of samples inside (start, end) intervals."""
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda a, t: a + t["end"] - t["start"]) / samples


def decoded(text: Column) -> Column:
    """the bytes of base64, with or without a data prefix."""
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*,", ""))
