"""Operator 4, benchmark decontamination by training suffix arrays.

A slice of documents of some megabytes is a shard. Its words become numbers, and the suffixes of the whole shard are sorted by
prefix doubling, as deep as the longest item of the benchmark is: the shard's suffix array. Each suffix of the benchmark's items
that has room for a window is binary-searched in it, one word deeper at a time, until no training suffix goes on like it. So its
longest verbatim matches come out with their places, and at WINDOW words the places of all occurrences of the window it starts.
The benchmark reaches the workers in blocks of bounded size, one held at a time; the documents are read once and never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, pick

WINDOW = 13
#: Bytes of benchmark text in a block at most (an item is never divided, so one longer item is a block of its own), and of text in a shard (or one document).
BLOCK_BYTES, SHARD_BYTES = 1 << 22, 1 << 22

_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MATCHES = "array<struct<start:int,length:int,item:string,item_start:int>>"
_ARROW_MATCHES = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_SPACE).split() if text else []


class Block:
    """Some items of the benchmark: their words as numbers, and the suffixes to be searched for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        split = [(name, w) for name, t in items if (w := words(t))]
        self.names = [name for name, _ in split]
        self.vocabulary = sorted({w for _, ws in split for w in ws})
        ids = {w: i for i, w in enumerate(self.vocabulary)}
        size = np.array([len(ws) for _, ws in split], np.int64)
        self.numbers = np.fromiter((ids[w] for _, ws in split for w in ws), np.int64, size.sum())
        #: Of each suffix: its item, where it starts there, its words, and how many of them make a window.
        self.item = np.repeat(np.arange(len(split)), size)
        self.start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.length = np.repeat(size, size) - self.start
        self.need = np.repeat(np.minimum(size, window), size)
        self.place = np.flatnonzero(self.length >= self.need)
        self.item, self.start, self.length, self.need = (x[self.place] for x in (self.item, self.start, self.length, self.need))
        self.longest = int(size.max()) if len(size) else 0


def suffix_array(numbers: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(the places of ``numbers``, each below 2 ** 31, in the order of what follows there, to ``depth`` or more numbers; the first two numbers at each).

    Places whose first ``width`` numbers agree share a rank, the slot of the first of them; only they are sorted again, by the
    ranks ``width`` further on.
    """
    two = numbers << 32 | np.r_[numbers[1:] + 1, 0]
    order = np.argsort(two)
    first = two[order]
    slots = np.arange(len(numbers))
    new, rank, width = np.r_[True, first[1:] != first[:-1]][: len(numbers)], np.zeros(len(numbers) + 1, np.int64), 2
    rank[-1] = -1
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    among, begins = slots, new
    while width < depth:
        shared = ~(begins & np.r_[begins[1:], True])
        among, width = among[shared], width * 2
        if not len(among):
            break
        here = order[among]
        value = rank[here] << 32 | rank[np.minimum(here + width // 2, len(numbers))] + 1
        by = np.argsort(value)
        here, value = here[by], value[by]
        order[among] = here
        begins = np.r_[True, value[1:] != value[:-1]]
        rank[here] = np.maximum.accumulate(np.where(begins, among, 0))
    return order, first


class Shard:
    """The suffix array of some documents, parted by numbers that no word has, and what the benchmark's blocks find there."""

    def __init__(self, texts: list[str | None], depth: int):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        split = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        numbers = np.fromiter((i for w in split for i in map(ids.__getitem__, w)), np.int64, self.sizes.sum())
        self.ids = dict(ids)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.numbers = np.insert(numbers, np.cumsum(self.sizes), len(ids) + np.arange(len(texts)))
        self.order, self.first = suffix_array(self.numbers, depth)
        n = len(self.numbers)
        #: The longest match at each place (0: none) and what it matches.
        self.best, self.item, self.start = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.names: list[str] = []
        self.found: list[set[str]] = [set() for _ in texts]

    def search(self, block: Block) -> None:
        known = np.fromiter((self.ids.get(w, -1) for w in block.vocabulary), np.int64, len(block.vocabulary))
        item = np.r_[known[block.numbers], -1]
        here, after = item[block.place], np.where(block.length > 1, item[np.minimum(block.place + 1, len(item) - 1)], -1)
        alone = block.length == 1
        low = np.searchsorted(self.first, here << 32 | np.where(alone, 0, after + 1))
        high = np.searchsorted(self.first, here << 32 | np.where(alone, (1 << 32) - 1, after + 1), "right")
        live = np.flatnonzero((here >= 0) & (alone | (after >= 0)) & (low < high))
        low, high, k = low[live], high[live], 2
        got, ranges = [], []  # (suffix, low, high, words): places that match so many words; the places of the suffixes' windows
        while len(live):
            length, need = block.length[live], block.need[live]
            depth = np.minimum(length, k)
            ranges.append(np.stack([live, low, high])[:, depth == need])
            go = length > k
            next_low, next_high = low.copy(), high.copy()
            next_low[go], next_high[go] = self._narrowed(k, item[block.place[live[go]] + k], low[go], high[go])
            leave = (depth >= need) & (~go | (next_low != low) | (next_high != high))
            got.append(_distinct(np.stack([live, low, high, depth])[:, leave]))
            stay = go & (next_low < next_high)
            live, low, high, k = live[stay], next_low[stay], next_high[stay], k + 1
        if got:
            self._keep(block, np.concatenate(got, 1), np.concatenate(ranges, 1))

    def _narrowed(self, k: int, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within each range of the suffix array, whose suffixes agree before, where the word at depth k is ``word``."""
        end, ends = len(self.order) - 1, []
        for right in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                here = self.numbers[np.minimum(self.order[np.minimum(mid, end)] + k, end)]
                less = (here <= word) if right else (here < word)
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            ends.append(a)
        return ends[0], ends[1]

    def _keep(self, block: Block, got: np.ndarray, ranges: np.ndarray) -> None:
        """Notes the longest match at each place, and for each document the items whose windows occur in it."""
        if not got.shape[1]:
            return
        slots, which = _innermost(*got[1:])
        places, suffix, words_ = self.order[slots], got[0, which], got[3, which]
        better = words_ > self.best[places]
        places, suffix = places[better], suffix[better]
        self.best[places], self.item[places], self.start[places] = words_[better], block.item[suffix] + len(self.names), block.start[suffix]
        self.names += block.names
        # a window's places are one range, whatever suffixes start with it
        spans, of = np.unique(ranges[1] << 32 | ranges[2], return_inverse=True)
        low, size = spans >> 32, (spans & 0xFFFFFFFF) - (spans >> 32)
        at = self.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
        documents = np.unique(np.repeat(np.arange(len(spans)), size) << 32 | np.searchsorted(self.starts, at, "right") - 1)
        items = np.unique(of.ravel() << 32 | block.item[ranges[0]])
        cuts = np.searchsorted(items, np.arange(len(spans) + 1) << 32).tolist()
        names = [block.names[i] for i in (items & 0xFFFFFFFF).tolist()]
        for span, document in zip((documents >> 32).tolist(), (documents & 0xFFFFFFFF).tolist(), strict=True):
            self.found[document].update(names[cuts[span] : cuts[span + 1]])

    def results(self) -> tuple[list[int], list[int], list[list[str]], list[list[dict]]]:
        """For each document: its words, those that are hit, the items found in it, and the longest matches that no other one holds."""
        at = np.flatnonzero(self.best)
        ends, n = at + self.best[at], len(self.numbers)
        inside = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0
        hit = np.add.reduceat(inside, self.starts, dtype=np.int64)
        reach = np.maximum.accumulate(ends)
        at = at[np.r_[True, ends[1:] > reach[:-1]]] if len(at) else at
        document = np.searchsorted(self.starts, at, "right") - 1
        matches: list[list[dict]] = [[] for _ in self.sizes]
        for d, a, length, item, start in zip(document.tolist(), (at - self.starts[document]).tolist(), self.best[at].tolist(), self.item[at].tolist(), self.start[at].tolist(), strict=True):
            matches[d].append({"start": a, "length": length, "item": self.names[item], "item_start": start})
        return self.sizes.tolist(), hit.tolist(), [sorted(x) for x in self.found], matches


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The first of the rows (suffix, low, high, words) of each range."""
    return rows[:, np.unique(rows[1] << 32 | rows[2], return_index=True)[1]]


def _innermost(low: np.ndarray, high: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots in any of the ranges [low, high), which are nested or apart, and the innermost range (of equal ones that of most words) around each."""
    edges, owner, around = [], [], []
    lows, highs = low.tolist(), high.tolist()

    def leave() -> None:
        edges.append(highs[around.pop()])
        owner.append(around[-1] if around else -1)

    for i in np.lexsort((words_, -high, low)).tolist():
        while around and highs[around[-1]] <= lows[i]:
            leave()
        edges.append(lows[i])
        owner.append(i)
        around.append(i)
    while around:
        leave()
    size = np.diff(edges)
    which = np.repeat(np.array(owner[:-1], np.int64), size)
    slots = edges[0] + np.arange(len(which))
    return slots[which >= 0], which[which >= 0]


def _search(blocks: list[Broadcast], depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces a batch's ``__text`` by the results for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _shards(whole):
                shard = Shard(batch["__text"].to_pylist(), depth)
                for sent in blocks:
                    shard.search(sent.value)
                    if len(blocks) > 1:
                        sent.__dict__.pop("_value", None)  # the worker reads it again from its file; one block is held at a time
                n, hit, items, matches = shard.results()
                names = [x for x in batch.schema.names if x != "__text"]
                made = (pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(matches, _ARROW_MATCHES))
                yield pa.RecordBatch.from_arrays([*[batch[x] for x in names], *made], [*names, "__words", "__hit", "__items", "__found"])

    return run


def _shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with SHARD_BYTES of text or a single row."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch["__text"]), 0))
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > SHARD_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``docs`` (columns numbered) with ``__words`` (their number), ``__hit`` (those covered), ``__items`` (sorted names) and ``__found`` (longest matches)."""
    spark = docs.sparkSession
    items = pick(benchmark, item_id="item_id", text="text").where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, sent, depth = max(1, -(-size // BLOCK_BYTES)), [], 2
    for k in range(count):  # the driver holds one block at a time
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        block = Block(sorted({(r.item_id, r.text) for r in mine}), window)
        depth = max(depth, block.longest)
        if block.names:
            sent.append(spark.sparkContext.broadcast(block))
    rows = numbered(docs)
    made = rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (("__words", "long"), ("__hit", "long"), ("__items", "array<string>"), ("__found", _MATCHES))]).schema
    return rows.withColumn("__text", F.col(f"__c{docs.columns.index('text')}")).mapInArrow(_search(sent, depth), made)


def _contaminated() -> Column:
    return (F.col("__hit") > 0) & (20 * F.col("__hit") >= F.col("__words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated, matches for every row of ``docs`` (doc_id, text).

    Windows are ``window`` consecutive words of an item of ``benchmark`` (item_id, text); a shorter item, if it has words, is one
    window. A word inside any occurrence is hit. ``contaminated``: some word is hit, and at least a twentieth of the words are.
    ``matches`` are longest verbatim matches: at each place where a window begins the longest that any item has there, without
    those that lie within another: start and length in the document, item and start in it, in words; of several items that match
    as long the first by name. Items whose text is null or without words match nothing, a null item_id is named by the empty
    string, items that repeat an item_id count once. Documents without words give zeros and false. Rows that repeat give repeated
    rows. Empty tables give no rows, or no hits.

    A shard's work grows with its words, the benchmark's, and the documents in which windows occur, not with occurrences times items.
    """
    rows = _found(pick(docs, doc_id="doc_id", text="text"), benchmark, window)
    return rows.select(F.col("__c0").alias("doc_id"), F.col("__words").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("item_ids"), _contaminated().alias("contaminated"), F.col("__found").alias("matches"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns kept, that ``contamination`` doesn't call contaminated."""
    rows = _found(docs, benchmark, window).where(~_contaminated())
    return rows.select(*[f"__c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
