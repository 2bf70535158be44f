"""Feature pipelines over ``events``: each user is a series, ordered by time and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import series as op
from .catalog import query

FRAMED = "framed AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events)"


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value", "event_type")
    return op.framed(events, "user_id", ["ts", "event_id"]).select("user_id", "frame", "value", "event_type")


DIFFS = f"""{FRAMED}, diffs AS (SELECT user_id, frame, value, value - coalesce(lag(value) OVER w, value) AS d1, coalesce(lead(value) OVER w, value) - 2 * value + coalesce(lag(value) OVER w, value) AS d2 FROM framed WINDOW w AS (PARTITION BY user_id ORDER BY frame))"""


@query(f"WITH {DIFFS} SELECT user_id, frame, round(d1, 9) AS d1, round(d2, 9) AS d2 FROM diffs")
def series_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2, V5."""
    out = op.differences(framed(spark, sf_dir), "user_id")
    return out.select("user_id", "frame", F.round("d1", 9).alias("d1"), F.round("d2", 9).alias("d2"))


@query(f"""WITH {DIFFS} SELECT user_id, frame, round((value - avg(value) OVER s) / (stddev_pop(value) OVER s + 1e-6), 6) AS value, round((d1 - avg(d1) OVER s) / (stddev_pop(d1) OVER s + 1e-6), 6) AS d1 FROM diffs WINDOW s AS (PARTITION BY user_id)""")
def series_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, after the differences."""
    out = op.scaled(op.differences(framed(spark, sf_dir), "user_id"), "user_id", ["value", "d1"])
    return out.select("user_id", "frame", F.round("value", 6).alias("value"), F.round("d1", 6).alias("d1"))


@query(f"""WITH {FRAMED}, w AS (SELECT user_id, frame AS start, sum(value) OVER x AS total, count(*) OVER x AS n, first(value) OVER x AS head, last(value) OVER x AS tail FROM framed WINDOW x AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
SELECT user_id, start, round(total, 6) AS total, round(head, 9) AS head, round(tail, 9) AS tail FROM w WHERE n = 15 AND start % 5 = 0""")
def series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: full windows of 15 frames, 5 apart."""
    out = op.windows(framed(spark, sf_dir), "user_id", ["value"])
    return out.select("user_id", "start", F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("value", F.lit(0)), 9).alias("head"), F.round(F.get("value", F.lit(14)), 9).alias("tail"))


@query(f"""WITH {FRAMED}, l AS (SELECT user_id, max(frame) AS last FROM framed GROUP BY user_id), g AS (SELECT user_id, unnest(range(ceil(last / 30.0::DOUBLE * 25.0 - 1e-9)::BIGINT)) AS frame FROM l),
a AS (SELECT user_id, frame, floor(frame * 30.0::DOUBLE / 25.0 + 1e-9)::BIGINT AS at, greatest(frame * 30.0::DOUBLE / 25.0 - floor(frame * 30.0::DOUBLE / 25.0 + 1e-9), 0) AS w FROM g)
SELECT a.user_id, a.frame, round(x.value + w * (coalesce(y.value, x.value) - x.value), 6) AS value FROM a JOIN framed x ON x.user_id = a.user_id AND x.frame = a.at LEFT JOIN framed y ON y.user_id = a.user_id AND y.frame = a.at + 1""")
def series_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty frames a second to twenty-five."""
    out = op.resampled(framed(spark, sf_dir), "user_id", 30.0, 25.0)
    return out.select("user_id", "frame", F.round("value", 6).alias("value"))


@query(f"""WITH {FRAMED}, k AS (SELECT user_id FROM framed GROUP BY user_id HAVING avg((value > 10)::INT) >= 0.7 AND count(*) >= 15)
SELECT user_id, count(*) AS frames FROM framed JOIN k USING (user_id) GROUP BY user_id""")
def usable_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11."""
    return op.usable(framed(spark, sf_dir), "user_id", F.col("value") > 10).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"))


@query(f"""WITH {FRAMED}, k AS (SELECT event_type FROM framed GROUP BY event_type HAVING count(*) >= 30) SELECT event_type, count(*) AS n FROM framed JOIN k USING (event_type) GROUP BY event_type""")
def supported_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return op.supported(framed(spark, sf_dir), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FRAMED}, p AS (SELECT user_id % 5 AS person, event_type, value FROM framed) SELECT f.fold, CASE WHEN p.person = f.fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(value), 6) AS mean FROM p, (SELECT DISTINCT person AS fold FROM p) f GROUP BY ALL""")
def leave_one_person_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10."""
    rows = framed(spark, sf_dir).withColumn("person", F.col("user_id") % 5)
    return op.fold_totals(rows, "person", "value").select("fold", "role", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query("""WITH p AS (SELECT user_id % 3 AS person, event_id FROM events) SELECT f.fold, CASE WHEN p.person = f.fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(event_id)::BIGINT AS ids FROM p, (SELECT DISTINCT person AS fold FROM p) f GROUP BY ALL""")
def leave_one_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, as a table of every row in every fold."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 3).alias("person"))
    return op.leave_one_out(rows, "person").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substr(md5('0|' || event_id), 1, 13))::BIGINT, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), m AS (SELECT max(n) AS most FROM r),
o AS (SELECT event_id, event_type, unnest(range((most - 1 - i) // n + 1)) AS copy FROM r, m) SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS id_sum, max(copy) AS copies FROM o GROUP BY event_type""")
def balanced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type repeated up to the most frequent one's size."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return op.oversampled(rows, "event_type", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"), F.max("copy").alias("copies"))


@query("""SELECT doc_id, list_transform(list_sort(list_transform(list_zip(embedding, range(64)), lambda p: {'v': -p[1], 'i': p[2]}))[1:3], lambda s: s.i::INT).array_to_string(',') AS top FROM (SELECT vec_id AS doc_id, embedding FROM embeddings)""")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the three largest of each vector's values."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = F.transform("embedding", lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return e.select(F.col("vec_id").alias("doc_id"), F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda s: s["i"].cast("string")), ",").alias("top"))


@query("""WITH p AS (SELECT vec_id, unnest(list_zip(embedding, range(64))) AS z FROM embeddings), s AS (SELECT vec_id, z[2] // 8 AS class, exp(z[1]::DOUBLE) AS e FROM p), q AS (SELECT vec_id, class, sum(e) AS e FROM s GROUP BY vec_id, class)
SELECT vec_id, arg_max(class, (e, -class)) AS best, round(max(e) / sum(e), 6) AS probability FROM q GROUP BY vec_id""")
def remapped_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """softmax of all values, summed under a map to eight classes, and the best; ties to the first class. Each row is worked on where it is read."""
    part = lambda c: F.aggregate(F.slice("embedding", c * 8 + 1, 8), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.struct(part(c).alias("e"), (-c).alias("c")))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", sums.alias("sums"))
    best, total = F.array_max("sums"), F.aggregate("sums", F.lit(0.0), lambda a, x: a + x["e"])
    return e.select("vec_id", (-best["c"]).cast("long").alias("best"), F.round(best["e"] / total, 6).alias("probability"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS largest, array_to_string((list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1:5], ',') AS top5 FROM orders GROUP BY o_custkey""")
def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest item of each group, and its first five."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    nth = o.withColumn("i", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("i <= 5")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o_orderkey"))), lambda s: s["o_orderkey"].cast("string")), ",")
    return nth.groupBy("o_custkey").agg(F.max_by("o_orderkey", -F.col("i")).alias("largest"), top.alias("top5"))


#: Clamped boxes: an order's price and key stand in for a place in an image of 1000 by 1000, grown by a fifth.
@query("""WITH b AS (SELECT o_orderkey, o_orderkey % 1000 AS x, o_custkey % 1000 AS y, 50 + o_orderkey % 97 AS w, 50 + o_custkey % 89 AS h FROM orders)
SELECT o_orderkey, greatest(0, x - round_even(0.2 * w, 0))::BIGINT AS x0, greatest(0, y - round_even(0.2 * h, 0))::BIGINT AS y0, least(1000, x + w + round_even(0.2 * w, 0))::BIGINT AS x1, least(1000, y + h + round_even(0.2 * h, 0))::BIGINT AS y1 FROM b""")
def grown_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes grown by a fifth of their sides, halves to even, and cut at the edges."""
    x, y, w, h = F.col("o_orderkey") % 1000, F.col("o_custkey") % 1000, 50 + F.col("o_orderkey") % 97, 50 + F.col("o_custkey") % 89
    grow = lambda side: F.bround(side.cast("decimal(9,1)") * F.lit("0.2").cast("decimal(2,1)"), 0).cast("long")
    low = lambda at, side: F.greatest(F.lit(0), at - grow(side)).cast("long")
    high = lambda at, side: F.least(F.lit(1000), at + side + grow(side)).cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", low(x, w).alias("x0"), low(y, h).alias("y0"), high(x, w).alias("x1"), high(y, h).alias("y1"))
