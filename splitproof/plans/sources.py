"""Sources and sinks: tables are written to the shared folder in each layout, and read back by the operator under test."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import audit, metrics
from ..session import scratch
from ..sources import files, sinks
from .catalog import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark: SparkSession, sf_dir: str, rel: str, content: str = "n_name") -> tuple[DataFrame, str]:
    """A file for each nation, placed below a new root: its table (k, rel, content) and the root. Nations are a table of fixed size."""
    rows = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_nationkey").alias("k"), "n_name", "r_name")
    rows = rows.select("k", F.expr(rel).alias("rel"), F.expr(content).cast("binary").alias("content"))
    root = scratch(spark, "files")
    sinks.placed(rows, root)
    return rows, root


_TREE = "concat(lower(r_name), '/', CASE WHEN k % 5 < 3 THEN 'train' WHEN k % 5 = 3 THEN 'Test' ELSE 'other' END, '/Class_', k % 3, '/', n_name, '_aug_', k, CASE WHEN k % 6 = 5 THEN '.txt' ELSE '.PNG' END)"
_N = "n AS (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_N} SELECT {_TREE} AS rel, lower(r_name) AS tree, CASE WHEN k % 5 < 3 THEN 'train' WHEN k % 5 = 3 THEN 'test' ELSE 'unsplit' END AS split, 'class_' || k % 3 AS label, sha256(n_name) AS sha256, n_name || '_aug_' || k AS stem FROM n WHERE k % 6 <> 5""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by suffix, with what their paths say."""
    return files.file_tree(spark, _nations(spark, sf_dir, _TREE)[1])


_FOLDERS = "concat(CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END, '/Class_', k % 3, '/', n_name, '.jpg')"


@query(f"""WITH {_N} SELECT substr(sha256({_FOLDERS}), 1, 20) AS sample_id, {_FOLDERS} AS rel, CASE WHEN k % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'class_' || k % 3 AS label, k % 3 AS zone, (k % 3)::BIGINT AS class_index FROM n WHERE k % 3 < 2""")
def class_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of splits and classes, one class excluded, with alphabetical class numbers."""
    labels = spark.createDataFrame([("class_0", 0), ("class_1", 1)], "label string, zone int")
    rows = files.class_folders(spark, _nations(spark, sf_dir, _FOLDERS)[1], labels, ("class_2",))
    return files.indexed_classes(rows).withColumn("class_index", F.col("class_index").cast("long"))


_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "manifest")
    sinks.manifest(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path)
    return path


@query("SELECT c_mktsegment AS segment, count(*) AS n, sum(c_custkey)::BIGINT AS keys, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ALL")
def checked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV written and read with its header, rows and values checked."""
    segments = sorted(r[0] for r in _table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect())
    rows = files.checked_csv(spark, _manifest(spark, sf_dir), StructType.fromDDL(_CUSTOMER), domains={"c_mktsegment": segments})
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_nationkey, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY c_nationkey")
def csv_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a CSV's columns those whose names match."""
    rows = files.channels(files.manifest(spark, _manifest(spark, sf_dir), StructType.fromDDL(_CUSTOMER)), "c_.*key")
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT vec_id, label, len(embedding) AS d, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written compressed, and joined to a manifest that must have the same keys."""
    e, path = _table(spark, sf_dir, "embeddings"), scratch(spark, "vectors")
    sinks.table(e.select("vec_id", "embedding"), path)
    rows = files.matched(e.select("vec_id", "label"), files.vectors(spark, path, "vec_id", "embedding"), "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "label", F.size("embedding").cast("long").alias("d"), F.round(total, 5).alias("total"))


@query("SELECT role, count(*) AS n, max(turn) AS last FROM conversations GROUP BY role")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as an ordered JSON document, read again."""
    rows = _table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    root = scratch(spark, "json")
    sinks.placed(spark.createDataFrame([("result.json", sinks.document(rows).encode())], "rel string, content binary"), root)
    return files.documents(spark, root).select("role", "n", "last")


_SERIES = "concat(CASE k % 3 WHEN 0 THEN concat('Happy/Person_', k, '/clip_', 20 + k) WHEN 1 THEN concat('Sad/x_Person_', k, '_b') ELSE concat('Odd/y_', k) END, '.csv')"


@query(f"""WITH {_N} SELECT {_SERIES} AS path, CASE k % 3 WHEN 0 THEN 'happy' ELSE 'sad' END AS emotion, 'Person_' || k AS person, CASE k % 3 WHEN 0 THEN (20 + k)::DOUBLE ELSE 25.0::DOUBLE END AS fps, CASE k % 3 WHEN 0 THEN 2 ELSE 3 END AS zone FROM n WHERE k % 3 < 2""")
def series_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person and rate from the paths of series files; folders that the labels don't know are dropped."""
    zones = spark.createDataFrame([("happy", 2), ("sad", 3)], "emotion string, zone int")
    return files.series_catalogue(spark, _nations(spark, sf_dir, _SERIES)[1], zones).select("path", "emotion", "person", "fps", "zone")


def _wave(k: int) -> bytes:
    """A WAVE file whose samples every format holds exactly: format by k % 5, channels by k % 2."""
    lanes, rate = 1 + k % 2, 16_000 if k % 3 else 8_000
    i, c = np.arange(100 + k)[:, None], np.arange(lanes)[None, :]
    v = (((i * (k + 1) + c) % 64 - 32) / 128).ravel()
    kind, width, body = (
        (1, 1, (v * 128 + 128).astype(np.uint8).tobytes()),
        (1, 2, (v * 2**15).astype("<i2").tobytes()),
        (1, 3, (v * 2**31).astype("<i4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()),
        (1, 4, (v * 2**31).astype("<i4").tobytes()),
        (3, 4, v.astype("<f4").tobytes()),
    )[k % 5]
    form = struct.pack("<HHIIHH", kind, lanes, rate, rate * lanes * width, lanes * width, 8 * width)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@query(f"""WITH {_N} SELECT n_name || '.wav' AS path, CASE WHEN k % 3 > 0 THEN 16000 ELSE 8000 END AS rate, (100 + k)::BIGINT AS n,
  round(list_sum(list_transform(range(100 + k), lambda i: (((i * (k + 1)) % 64 - 32) / 128.0::DOUBLE + ((i * (k + 1) + k % 2) % 64 - 32) / 128.0::DOUBLE) / 2)), 6) AS total FROM n""")
def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAVE files of 8, 16, 24 and 32 bits and of floats, one channel or two, as mono samples."""
    names = [(f"{r.n_name}.wav", _wave(r.n_nationkey)) for r in _table(spark, sf_dir, "nation").collect()]
    root = scratch(spark, "sounds")
    sinks.placed(spark.createDataFrame(names, "rel string, content binary"), root)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return files.sounds(spark, root).select("path", "rate", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"))


def _workbook(rows: list[tuple]) -> bytes:
    """A workbook whose texts are shared strings and whose numbers are plain, as spreadsheets write them."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    texts = sorted({v for row in rows for v in row if isinstance(v, str)})
    cell = lambda v, at: f'<c r="{at}" t="s"><v>{texts.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>' if v is not None else ""
    body = "".join(f'<row r="{i}">' + "".join(cell(v, f"{chr(65 + j)}{i}") for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("SELECT n_name AS subject, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey END AS file, CASE n_nationkey % 3 WHEN 0 THEN 'joy' WHEN 1 THEN 'fear & awe' ELSE 'other' END AS emotion FROM nation")
def spreadsheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's rows, some cells empty."""
    rows = [("Filename", "Emotion", "Unused", "Subject")]
    for r in _table(spark, sf_dir, "nation").collect():
        rows.append((r.n_nationkey if r.n_nationkey % 4 else None, ("joy", "fear & awe", "other")[r.n_nationkey % 3], 1, r.n_name))
    root = scratch(spark, "sheets")
    sinks.placed(spark.createDataFrame([("codes.xlsx", _workbook(rows))], "rel string, content binary"), root)
    out = files.sheets(spark, root, "Subject string, Filename string, Emotion string")
    return out.select(F.col("Subject").alias("subject"), F.col("Filename").cast("int").alias("file"), F.col("Emotion").alias("emotion"))


@query("""WITH f AS (SELECT n_name || '.y4m' AS path, n_nationkey AS k, unnest(range(28 + n_nationkey)) AS frame FROM nation)
SELECT path, count(*) AS frames, coalesce(max(CASE WHEN frame = 30 THEN (k * 7 + 30) % 256 END), -1)::INT AS thirtieth FROM f GROUP BY path""")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames a video has, and the first grey value of frame 30 (-1 if it ends before)."""
    videos = []
    for r in _table(spark, sf_dir, "nation").collect():
        body = b"".join(b"FRAME\n" + bytes([(r.n_nationkey * 7 + i) % 256]) * 6 for i in range(28 + r.n_nationkey))
        videos.append((f"{r.n_name}.y4m", b"YUV4MPEG2 W2 H2 F25:1 C420\n" + body))
    root = scratch(spark, "videos")
    sinks.placed(spark.createDataFrame(videos, "rel string, content binary"), root)
    at = F.conv(F.hex(F.substring("content", 1, 1)), 16, 10).cast("int")
    return files.frames(spark, root).groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.max(F.when(F.col("frame") == 30, at)), F.lit(-1)).alias("thirtieth"))


@query("""SELECT c_custkey, c_name AS stem, round(c_acctbal / 2, 6) AS feature, c_nationkey % 4 AS hot_at FROM customer WHERE c_custkey % 3 > 0""")
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the feature stored for their file's stem, and their label as a one-hot array."""
    c = _table(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 3 > 0").select(F.col("c_name").alias("stem"), F.array((F.col("c_acctbal") / 2).cast("double")).alias("feature"))
    rows = c.select("c_custkey", F.concat(F.lit("audio/"), "c_name", F.lit(".wav")).alias("path"), (F.col("c_nationkey") % 4).alias("label"))
    out = files.features(rows, stored, "path", "label", 4)
    return out.select("c_custkey", "stem", F.round(F.get("feature", F.lit(0)), 6).alias("feature"), (F.array_position("one_hot", F.lit(1.0)) - 1).cast("int").alias("hot_at"))


@query("""WITH p AS (SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN '-b-' || c_custkey || '.wav' ELSE '-a' END AS name FROM customer), f AS (SELECT split_part(name, '-', 1) AS first FROM p)
SELECT left(first, greatest(length(first) - 3, 0)::BIGINT) AS session, count(*) AS n FROM f GROUP BY session""")
def session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17."""
    path = F.concat(F.lit("a/b/"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("-b-"), F.col("c_custkey").cast("string"), F.lit(".wav"))).otherwise("-a"))
    return _table(spark, sf_dir, "customer").groupBy(files.session_key(path).alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def decoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bytes in base64, with a data prefix or without one."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    sent = docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "data:text/plain;base64,").otherwise(""), F.base64(F.col("text").cast("binary"))).alias("payload"))
    return sent.select("doc_id", F.sha2(files.decoded(F.col("payload")), 256).alias("sha256"))


@query("SELECT (doc_id % 5)::BIGINT AS kind, round((doc_id % 5 + 1) * 12 / 100.0::DOUBLE, 9) AS share, (doc_id % 5 + 1) * 12 >= 40 AS spoken, count(*) AS n FROM documents GROUP BY ALL")
def speech_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the share of 100 samples inside intervals, and whether it is 0.4 or more."""
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 5), lambda i: F.struct((i * 20).alias("start"), (i * 20 + 12).alias("end")))
    share = files.speech_share(at, F.lit(100))
    return _table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 5).alias("kind"), F.round(share, 9).alias("share"), (share >= 0.4).alias("spoken")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_N} SELECT CASE WHEN k % 7 = 4 THEN '../' ELSE '' END || n_name AS path, CASE k % 7 WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' WHEN 3 THEN 'extra' WHEN 4 THEN 'unsafe' ELSE 'same' END AS state FROM n""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of hashes and paths against the files that are there."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.when(F.col("n_nationkey") % 7 == 4, "../").otherwise(""), "n_name").alias("path"))
    line = F.concat(F.sha2(F.concat("path", F.when(F.col("k") % 7 == 1, "x").otherwise("")), 256), F.lit("  "), "path")
    there = n.where("k % 7 <> 2").select("path", F.sha2("path", 256).alias("sha256"))
    return sinks.listed(n.where("k % 7 <> 3").select(line.alias("line")), there)


@query(r"""WITH v AS (SELECT n_nationkey AS k, count(c_custkey) * 1234 + n_nationkey / 4.0::DOUBLE AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
m AS (SELECT 'Nation' || chr(65 + k) AS name, CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT) ELSE format('{:,.3f}', v) END AS value FROM v)
SELECT name, value, (SELECT sha256(string_agg('\newcommand{\' || name || '}{' || value || '}', chr(10) ORDER BY name) || chr(10)) FROM m) AS source FROM m""")
def macro_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, K8: numbers as text macros in one file, read back by name with the file's hash."""
    counts = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    rows = counts.select(F.concat(F.lit("Nation"), F.char(F.col("n_nationkey") + 65)).alias("name"), (F.col("n") * 1234 + F.col("n_nationkey") / 4.0).alias("value"))
    text = rows.join(sinks.macros(rows, "name", "value").select("line", F.regexp_extract("line", r"\{\\([A-Za-z]+)\}", 1).alias("name")), "name").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    root = scratch(spark, "macros")
    sinks.placed(text.select(F.lit("numbers.tex").alias("rel"), F.concat(F.array_join("lines", "\n"), F.lit("\n")).cast("binary").alias("content")), root)
    return sinks.ledger(spark.read.text(root, wholetext=True))


@query("SELECT side, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer, (VALUES ('new'), ('frozen')) s(side) WHERE c_custkey % 50 = 0 GROUP BY side")
def frozen_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result against what was frozen, of which every fiftieth row was changed."""
    c, path = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch(spark, "frozen")
    sinks.table(c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 50 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))), path)
    return sinks.differences(c, spark.read.parquet(path)).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT count(*) FILTER (c_custkey % 2 = 0) AS first, count(*) FILTER (c_custkey % 2 <> 0) AS second, 0::BIGINT AS third, count(*) AS stored, count(DISTINCT c_mktsegment) AS folders FROM customer")
def partitioned_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows into folders by class; a later run writes what is missing, and the next one nothing."""
    c, path = _table(spark, sf_dir, "customer"), scratch(spark, "partitioned")
    wrote = [sinks.partitioned(rows, path, "c_custkey", "c_mktsegment") for rows in (c.where("c_custkey % 2 = 0"), c, c)]
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("c_mktsegment").alias("folders"))
    return stored.select(*[F.lit(n).cast("long").alias(name) for n, name in zip(wrote, ("first", "second", "third"), strict=True)], "stored", "folders")


@query("SELECT CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'neutral' END AS label, count(*) AS n FROM conversations WHERE turn % 7 <> 6 GROUP BY label")
def repaired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose prediction failed go; predictions beyond the known ones become the fallback."""
    rows = _table(spark, sf_dir, "conversations").withColumn("pred", F.when(F.col("turn") % 7 == 6, "error").otherwise(F.col("role")))
    return metrics.repaired(rows, "pred", ["user", "assistant"], "neutral").groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang = 'en' GROUP BY ALL")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first row under a composite key, in which null is a value."""
    counts = _table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    least = _table(spark, sf_dir, "documents").agg(F.min("source")).scalar()
    return audit.lookup(counts, {"lang": F.lit("en"), "source": least}, "n")


@query("SELECT source, row_number() OVER (ORDER BY source) - 1 AS place FROM (SELECT DISTINCT source FROM documents) ORDER BY source LIMIT 10")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct values, the first ten with their places. Sources are a dimension."""
    return audit.sorted_distinct(_table(spark, sf_dir, "documents"), "source").limit(10)
