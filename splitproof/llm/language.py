"""Operator 5, language ID by language-bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that its documents commonly use. The filters share their hash functions and are
bit-sliced: one table holds, at each position, a bit for every language, and the AND of a n-gram's positions names all languages
that contain it. A text's n-grams are looked up, each language's hits counted, the hits that its filter gives by chance taken off
(its false-positive rate is known from its fill), and the language with most hits left is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, pick

#: Letters in a n-gram, positions of the table (a power of two), positions that each n-gram sets.
GRAM, POSITIONS, HASHES = 4, 1 << 18, 3
#: The classifier is fitted on at most so many documents of each language, those of the least hashes of doc_id.
SAMPLE_PER_LANGUAGE = 2_000
#: So many languages are learned at most, those that have most documents; rarer values of a dirty ``lang`` column are not.
MOST_LANGUAGES = 1_024
#: A n-gram enters a language's filter if this share of the language's sample documents use it.
COMMON = 0.01
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray | None:
    """Hashes (uint64) of all n-grams of a lower-cased text in which each run of other characters is one space; None: no letter."""
    low = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[low]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.r_[np.uint32(32), np.where(letter, low, np.uint32(32))[keep], np.uint32(32)].astype(np.uint64)
    c = np.r_[c, np.full(max(0, GRAM - len(c)), 32, np.uint64)]
    x = np.zeros(len(c) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        x = x * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(x)]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _positions(x: np.ndarray) -> list[np.ndarray]:
    bits = POSITIONS.bit_length() - 1
    return [(x >> np.uint64(k * bits)) & np.uint64(POSITIONS - 1) for k in range(HASHES)]


class Filters:
    """The bit-sliced table: a row of bytes for each position, a bit for each language."""

    def __init__(self, languages: list[str], rows: list[tuple[int, int, int]], usual: int = 0):
        """rows: (position, word, mask of the 32 languages from 32 x word on); usual: the language that has most documents."""
        self.languages, self.usual = languages, usual
        words = np.zeros((POSITIONS, max(1, -(-len(languages) // 32))), "<u4")
        for position, word, mask in rows:
            words[position, word] = mask
        self.slices = np.ascontiguousarray(words.view(np.uint8).T[: max(1, -(-len(languages) // 8))])
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        self.bits = bits
        fill = np.concatenate([np.bincount(s, minlength=256) @ bits for s in self.slices])[: len(languages)] / POSITIONS
        self.chance = np.minimum(fill**HASHES, 0.999)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, its share of all languages' hits, the share of the n-grams that it knows)."""
        x = grams(text) if text and self.languages else None
        if x is None:
            return UNDETERMINED, 0.0, 0.0
        a, *rest = _positions(x)
        hits = []
        for s in self.slices:
            mask = s[a]
            for b in rest:
                mask &= s[b]
            hits.append(np.bincount(mask, minlength=256) @ self.bits)
        n = len(x)
        real = np.clip((np.concatenate(hits)[: len(self.languages)] - n * self.chance) / (1 - self.chance), 0, n)
        if not real.any():
            return self.languages[self.usual], 0.0, 0.0
        best = int(real.argmax())
        return self.languages[best], float(real[best] / real.sum()), float(real[best] / n)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Filters:
    """Filters from the documents (doc_id, text, lang) that aren't held out and whose text and lang aren't null.

    What reaches the driver is bounded: a count for each of MOST_LANGUAGES languages, and a row for each position and 32 languages.
    """
    known = pick(docs, doc_id="doc_id", text="text", lang="lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = dict(sorted((r.lang, r["count"]) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()))
    if not counts:
        return Filters([], [])
    languages, span = list(counts), 1 << 40
    learned = F.broadcast(docs.sparkSession.createDataFrame([(lang, i, int(min(1.0, 1.1 * SAMPLE_PER_LANGUAGE / n) * span), COMMON * min(n, SAMPLE_PER_LANGUAGE)) for i, (lang, n) in enumerate(counts.items())], "lang string, i int, cut long, least double"))
    order = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(span))
    some = known.withColumn("__h", order).join(learned, "lang").where(F.col("__h") < F.col("cut"))
    some = some.withColumn("__n", F.row_number().over(W.partitionBy("lang").orderBy("__h", "doc_id"))).where(F.col("__n") <= SAMPLE_PER_LANGUAGE).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                x = grams(text)
                if x is not None:
                    own.setdefault(lang, []).append(np.unique(x))
            for lang, found in own.items():
                x, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(x), pa.string()), "gram": x.view(np.int64), "n": n})

    used = some.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bits = POSITIONS.bit_length() - 1
    at = F.array(*[F.shiftrightunsigned("gram", k * bits).bitwiseAND(F.lit(POSITIONS - 1).cast("long")) for k in range(HASHES)])
    common = used.join(learned, "lang").where(F.col("n") >= F.col("least"))
    rows = common.select(F.explode(at).alias("position"), (F.col("i") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, i % 32)").alias("mask")).groupBy("position", "word").agg(F.bit_or("mask").alias("mask"))
    return Filters(languages, [tuple(r) for r in rows.collect()], max(range(len(languages)), key=lambda i: counts[languages[i]]))


def _predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` (columns numbered) with __lang, __score, __known."""
    rows = numbered(docs).withColumn("__text", F.col(f"__c{docs.columns.index('text')}"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, known = zip(*[sent.value.predict(t) for t in batch["__text"].to_pylist()], strict=True) if batch.num_rows else ((), (), ())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], [*names, "__lang", "__score", "__known"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("__lang", "string").add("__score", "double").add("__known", "double"))


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known for every row of ``docs`` (doc_id, text, lang).

    ``filters``: None fits them on ``docs``. lang_pred is a learned language, or ``und`` where the text is null or has no letter,
    or nothing could be learned. Score is the language's share of all languages' corrected hits, known the share of the text's
    n-grams that it contains. Ties go to the language that sorts first; a text of which no language knows anything gets the
    language that has most documents, score 0. A null doc_id isn't held out. Rows that repeat come out alike.
    """
    slim = pick(docs, doc_id="doc_id", text="text")
    rows = _predicted(slim, filters or fit(docs))
    return rows.select(F.col("__c0").alias("doc_id"), held_out(F.col("__c0")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__known").alias("known"))


def keep_identified(docs: DataFrame, least_known: float = 0.0, filters: Filters | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is determined and, where ``least_known`` is above 0, whose language knows over that share of their n-grams.

    At 0 only ``und`` goes: a text with letters stays even if no language knows any of its n-grams.
    """
    rows = _predicted(docs, filters or fit(docs)).where(F.col("__lang") != UNDETERMINED)
    if least_known > 0:
        rows = rows.where(F.col("__known") > least_known)
    return rows.select(*[f"__c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
