"""Operator 2, document fingerprints by Order MinHash.

A text's k-mers of KMER code points are numbered by occurrence, so that repeats differ. For each of HASHES hash functions the
TUPLE least numbered k-mers are selected, put back into text order and hashed as a tuple. Two texts agree at a place of their
signatures if they share the least k-mers and their order, which becomes rarer as their edit distance grows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

KMER, HASHES, TUPLE = 8, 64, 2
_BLOCK = 1024
_WORST = np.uint32(0xFFFFFFFF)
_seeds = np.random.Generator(np.random.PCG64(20240229))
_FLIP = _seeds.integers(0, 1 << 32, (HASHES, 1), np.uint32)
_TIMES = _seeds.integers(0, 1 << 32, (HASHES, 1), np.uint32) | np.uint32(1)
_ROWS = np.arange(HASHES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def numbered_kmers(points: np.ndarray) -> np.ndarray:
    """A hash (uint32) of each k-mer with its occurrence number, in text order. A text shorter than a k-mer is one; the empty text has none."""
    if not len(points):
        return np.empty(0, np.uint32)
    h, width = points.astype(np.uint64) + np.uint64(1), 1
    if len(h) < KMER:
        h = np.r_[h, np.zeros(KMER - len(h), np.uint64)]
    base = 0x9E3779B97F4A7C15
    while width < KMER:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    n = len(h)
    h >>= np.uint64(24)  # 40 bits stand for a k-mer; below them its place, as far as it fits, makes one fast sort stable
    if n < 1 << 24:
        order = np.sort(h << np.uint64(24) | np.arange(n, dtype=np.uint64))
        where = (order & np.uint64((1 << 24) - 1)).astype(np.int64)
        order >>= np.uint64(24)
    else:
        where = np.argsort(h, kind="stable")
        order = h[where]
    place = np.arange(n)
    first = np.zeros(n, np.int64)
    new = order[1:] != order[:-1]
    first[1:][new] = place[1:][new]
    x = (order + (place - np.maximum.accumulate(first)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(28)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.empty(n, np.uint32)
    out[where] = (x >> np.uint64(32)).astype(np.uint32)
    return out


Least = tuple[np.ndarray, np.ndarray, np.ndarray]  # order values, k-mer hashes and places, each HASHES x TUPLE, least first
_NONE: Least = (np.full((HASHES, TUPLE), _WORST), np.zeros((HASHES, TUPLE), np.uint32), np.full((HASHES, TUPLE), np.iinfo(np.int64).max))


def _merged(a: Least, b: Least) -> Least:
    value, kmer, place = (np.concatenate(x, 1) for x in zip(a, b, strict=True))
    order = np.lexsort((place, value))[:, :TUPLE]
    return np.take_along_axis(value, order, 1), np.take_along_axis(kmer, order, 1), np.take_along_axis(place, order, 1)


def least(x: np.ndarray, start: int = 0) -> Least:
    """For each hash function the TUPLE least of the k-mers ``x``, which stand in the text from ``start`` on."""
    found = _NONE
    for at in range(0, len(x), _BLOCK):
        part = x[at : at + _BLOCK]
        y = (part ^ _FLIP) * _TIMES
        value, kmer, place = (a.copy() for a in _NONE)
        for t in range(min(TUPLE, len(part))):
            where = y.argmin(1)
            value[:, t], kmer[:, t], place[:, t] = y[_ROWS, where], part[where], where + start + at
            y[_ROWS, where] = _WORST
        found = (value, kmer, place) if found is _NONE else _merged(found, (value, kmer, place))
    return found


def signature(found: Least) -> np.ndarray:
    """HASHES hashes (uint32) of the selected k-mers in text order; none selected: no hashes."""
    _, kmer, place = found
    if place.min() == np.iinfo(np.int64).max:
        return np.empty(0, np.uint32)
    kmer = np.take_along_axis(kmer, np.argsort(place, 1, kind="stable"), 1).astype(np.uint64)
    h = np.full(HASHES, np.uint64((found[2] < np.iinfo(np.int64).max).sum(1).max()), np.uint64)
    for t in range(TUPLE):
        h = (h ^ kmer[:, t]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(16)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of places where two signatures agree; 1 for two empty texts, 0 for one."""
    return float(len(a) == len(b)) if not (len(a) and len(b)) else float((a == b).mean())


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    """The signature of a text, 8 hexadecimal digits for each hash function (the empty text: none)."""
    return _hex(signature(least(numbered_kmers(code_points(text)))))


class _Document:
    """A text, its k-mers and its signature; ``common`` is what the k-mers before the place of the edit give, searched once for both texts."""

    def __init__(self, text: str):
        self.text, points = text, code_points(text)
        self.n_chars, self.half = len(points), len(points) // 2
        kmers = numbered_kmers(points)
        self.shared = max(0, self.n_chars - self.half - KMER + 1)
        self.common = least(kmers[: self.shared])
        self.signature = signature(_merged(self.common, least(kmers[self.shared :], self.shared)))

    def edited(self, follow: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by the start of another, and that text's signature."""
        text = self.text[: self.n_chars - self.half] + follow[: self.half]
        return text, signature(_merged(self.common, least(numbered_kmers(code_points(text))[self.shared :], self.shared)))


def _dealt(bounds: list[tuple[int, int]]):
    """Adds to each row (doc_id, text, key, h) the range it belongs to, and sends the first document of a range to the one before it as well (tail 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # one copy of a first document from each task is enough
        for batch in batches:
            at = list(zip(batch["key"].to_pylist(), batch["h"].to_pylist(), strict=True))
            part = [bisect_right(bounds, x) - 1 for x in at]
            extra = []
            for i, (p, x) in enumerate(zip(part, at, strict=True)):
                if x == bounds[p] and p not in sent:
                    sent.add(p)
                    extra.append(i)
            for rows, to, tail in ((batch, part, 0), (batch.take(pa.array(extra, pa.int64())), [(part[i] - 1) % len(bounds) for i in extra], 1)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int32()), pa.array([tail] * len(to), pa.int32())], [*rows.schema.names, "part", "tail"])

    return run


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of (doc_id, text).

    doc_id is an integer. A null text counts as the empty text. The next document is the one with the next doc_id (after the last:
    the first, so a single document is followed by itself); rows without a doc_id come before all others, and rows that repeat a
    doc_id follow each other in the order of a hash of their texts. Empty texts have empty fingerprints, and are alike. An empty
    table gives no rows.

    Texts are shuffled once, into ranges of (doc_id, hash of the text), so that rows that share a doc_id, or have none, spread too.
    The ranges' bounds, one for each shuffle partition at most, come from ids and hashes alone and reach the workers as data; the
    first document of a range is also sent to the range before it. Each task streams its range and holds two documents; rows that
    repeat both doc_id and text cost no second fingerprint.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("key")).withColumn("h", F.xxhash64("text"))
    ranges = rows.select("key", "h").repartitionByRange(parts, "key", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "h")).alias("first"))
    bounds = sorted((r.first.key, r.first.h) for r in ranges.collect())
    kind = dict(rows.dtypes)["doc_id"]
    dealt = rows.mapInArrow(_dealt(bounds), f"doc_id {kind}, text string, key long, h long, part int, tail int")
    dealt = dealt.repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("part", "tail", "key", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whose, before, row = None, None, None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for part, tail, doc_id, text in zip(*(batch[n].to_pylist() for n in ("part", "tail", "doc_id", "text")), strict=True):
                if last is None:
                    if not tail:
                        last, whose = _Document(text), (part, doc_id)
                    continue
                now = last if text == last.text else _Document(text)
                if before is None or before[0] is not last or before[1] is not now:
                    edited, its = last.edited(text)
                    row = (last.n_chars, hashlib.sha256(edited.encode()).hexdigest(), _hex(last.signature), _hex(its), likeness(last.signature, its), likeness(last.signature, now.signature))
                    before = (last, now)
                for n, v in zip(out, (whose[1], *row), strict=True):
                    out[n].append(v)
                last, whose = (now, (part, doc_id)) if not tail else (None, None)
            yield pa.record_batch({"doc_id": pa.array(out.pop("doc_id"), batch["doc_id"].type), **{n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)}})

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
