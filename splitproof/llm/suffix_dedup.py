"""Operator 8, suffix-array dedup by prefix-free parsing, in shards.

Parse: a rolling hash of GRAIN bytes picks triggers: of the grains in each ``length``-byte string the one of least hash, the
leftmost of equals. Equal strings pick equal triggers at equal places, wherever they stand. Triggers cut the texts into phrases,
each with the strings that start there: those that pick its trigger. A phrase with the context that these strings reach into is a
word. The parse has a row for each word: its trigger, its name, its document and its place, which is corpus order.

Dictionary: the distinct words. Where a word occurs again, all its strings do, so only the first occurrence of each word, in the
order of the parse, enters the dictionary, and that only if other words share its trigger: no string of the others can occur in
another word. The dictionary is dealt out by trigger, so that equal strings meet in one shard, and each shard builds the suffix
array of its words byte by byte, by prefix doubling to the depth of a string (words hold the context of their strings, so no
suffix goes on in the next phrase). Suffixes that agree to that depth stand together; parse and suffix array combine into corpus
order, and of each such run all but the first repeat.

Words are named by their trigger's 64-bit hash and 64 bits of a hash of their own; a document is its doc_id and 64 bits of its text's hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

GRAIN = 32
#: Bytes that are searched for triggers at once, and the bits of a place in them; longer texts are cut (their strings are not).
_PIECE, _PLACE = 1 << 19, 22
#: A trigger is hot if a sample of SAMPLE documents or so has it at least HOT times; there are at most HOTTEST of them. Their words are dealt out by name as well.
SAMPLE, HOT, HOTTEST, SALTS = 2_000, 20, 20_000, 64
#: Words of one trigger that a shard sorts together at most. Those of a trigger with more are compared string by string, by 128-bit hashes.
CROWD = 4_096
#: Strings of such triggers that are settled among themselves before they are shuffled.
_SETTLE = 100_000
_NULL = -(1 << 63)
_ROW = "h long, c long, key long, mark long, at long"
_STRING = "g long, d long, key long, mark long, x long, blob binary"


def _grains(data: np.ndarray) -> np.ndarray:
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAIN:
        h = h[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def phrases(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger's place, trigger's hash) of the runs of ``length``-byte strings that pick one trigger.

    ``data``: texts (uint8) one behind another, at most 2 ** _PLACE bytes; ``ends``: where each ends.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = _grains(data)
    low = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, length - GRAIN + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    valid = np.ones(len(low), bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    place = (low[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return starts[new], starts[np.r_[new[1:], len(starts)] - 1], place[new], h[place[new]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _packed(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One non-negative long that sorts by a trigger's place, with how far before it the strings start (7 + 7 bits)."""
    return (place << 14) | (left << 7) | right


def _text_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [start, end), both sorted by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, starts[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return starts[first], reach[np.r_[first[1:], len(starts)] - 1]


def _batch_texts(batch: pa.RecordBatch) -> list[bytes]:
    return pa.compute.fill_null(batch["text"], "").cast(pa.binary()).to_pylist()


def _cut(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Pieces of the texts: (bytes, [(text, offset in it, end in the piece)]). Parts of a long text overlap by length - 1 bytes."""
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, max(1, len(t) - length + 1), _PIECE):
            part = t[a : a + _PIECE + length - 1]
            if total and total + len(part) > _PIECE:
                yield _joined(held)
                held, total = [], 0
            held.append((i, a, part))
            total += len(part)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    ends = np.cumsum([len(p) for _, _, p in held]).tolist()
    return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), [(i, a, e) for (i, a, _), e in zip(held, ends, strict=True)]


def _words(length: int, hot: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to the parse: (h trigger, c name, key and mark document, at place).

    What a batch repeats itself is settled there: only a word's first occurrence is passed on; the others become rows whose ``at``
    is negative and whose c holds an interval of starts that repeat. ``hot`` None: only the triggers, for the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = _batch_texts(batch), batch["key"].to_numpy()
            marks = np.array([_text_hash(t) for t in texts], np.int64)
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for data, parts in _cut(texts, length):
                ends = np.array([e for *_, e in parts])
                lo, hi, place, h = phrases(data, ends, length)
                if hot is None:
                    cols[0].append(h.view(np.int64))
                    continue
                raw = data.tobytes()
                digest = xxhash.xxh3_64_intdigest
                c = np.array([digest(raw[a:b], s) for a, b, s in zip(lo.tolist(), (hi + length).tolist(), (place - lo).tolist(), strict=True)], np.uint64)
                part = np.searchsorted(ends, place, "right")
                doc = np.array([i for i, *_ in parts])[part]
                back = np.array([a for _, a, _ in parts]) - np.r_[0, ends[:-1]]
                h &= ~np.uint64(1)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    burns = hot[at] == h
                    h[burns] = _mix(h[burns] + c[burns] % np.uint64(SALTS)) | np.uint64(1)
                for x, col in zip((h.view(np.int64), c.view(np.int64), keys[doc], marks[doc], _packed(place + back[part], place - lo, place - hi)), cols, strict=True):
                    col.append(x)
            if not cols[0]:
                continue
            if hot is None:
                yield pa.record_batch({"h": np.concatenate(cols[0]) & ~np.int64(1)})
            else:
                yield _settled(np.stack([np.concatenate(x) for x in cols]))

    return run


def _settled(rows: np.ndarray) -> pa.RecordBatch:
    """A batch's rows (h, c, key, mark, at) with only the first occurrence of each word, and intervals for the others."""
    c = rows[1]
    order = np.argsort(c)
    again = c[order][1:] == c[order][:-1]
    some = order[np.r_[False, again] | np.r_[again, False]] if len(again) else order[:0]
    h, c, key, mark, at = rows[:, some]
    some = some[np.lexsort((at, mark, key, c, h))]
    new, twin = _steps(rows[:, some], None)
    gone = np.zeros(rows.shape[1], bool)
    gone[some[~new]] = True
    intervals = _covered(*rows[2:, some[~new & ~twin]])  # a twin is the row above read again: its interval is known, or it is the first occurrence itself
    key, mark, a, b = intervals
    spread = _mix(key.view(np.uint64) ^ mark.view(np.uint64) ^ a.view(np.uint64)).view(np.int64)
    made = np.concatenate([rows[:, ~gone], np.stack([spread, (a << 32) | b, key, mark, np.full(len(a), -1)])], 1)
    return pa.record_batch(dict(zip(("h", "c", "key", "mark", "at"), made, strict=True)))


def _steps(rows: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (h, c, key, mark, at) in that order, ``last`` before them: where a new word begins, and where a row is the one before it again."""
    if not rows.shape[1]:
        return np.zeros(0, bool), np.zeros(0, bool)
    same = rows[:, 1:] == rows[:, :-1]
    first = np.zeros(5, bool) if last is None else rows[:, 0] == last
    same = np.concatenate([first[:, None], same], 1)
    new = ~(same[0] & same[1])
    return new, same.all(0)


def _covered(key: np.ndarray, mark: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, mark, first start, end of starts) of the intervals that the phrases ``at`` cover, joined where they touch."""
    order = np.lexsort((at, mark, key))
    key, mark, at = key[order], mark[order], at[order]
    place = at >> 14
    return _runs(key, mark, place - ((at >> 7) & 127), place - (at & 127) + 1)


def _runs(key: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts, sorted by document and start and disjoint but for repeats, joined where they touch."""
    if not len(key):
        return key, mark, a, b
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (a[1:] > b[:-1])])
    return key[new], mark[new], a[new], b[np.r_[new[1:], len(key)] - 1]


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the parse sorted by (h, c, key, mark, at): later occurrences of a word are intervals that repeat (kind 1: x start, y
    end); a first occurrence enters the dictionary (kind 2: x at) if another word has its trigger. Words of triggers that are hot
    or have more than CROWD rows are of kind 3. At most CROWD rows and a batch are held."""
    held, last = np.empty((5, 0), np.int64), None  # rows of a trigger that may go on, or the last row of one that is crowded
    for batch in batches:
        rows = np.stack([batch[n].to_numpy() for n in ("h", "c", "key", "mark", "at")])
        done = rows[:, rows[4] < 0]
        out = [(done[2], done[3], np.full(done.shape[1], 1), done[1] >> 32, done[1] & 0xFFFFFFFF)]
        rows = np.concatenate([held, rows[:, rows[4] >= 0]], 1)
        if rows.shape[1]:
            if last is not None:  # a crowded trigger goes on
                n = int(np.searchsorted(rows[0], last[0], "right"))
                out += _first_words(rows[:, :n], last, True)
                last, rows = (rows[:, n - 1] if n else last) if n == rows.shape[1] else None, rows[:, n:]
            cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            out += _first_words(rows[:, :cut], None, False)
            held = rows[:, cut:]
            if held.shape[1] > CROWD:
                out += _first_words(held, None, True)
                held, last = held[:, :0], held[:, -1]
        yield _sifted_batch(out)
    yield _sifted_batch(_first_words(held, None, False))


def _first_words(rows: np.ndarray, last: np.ndarray | None, crowded: bool) -> list[tuple[np.ndarray, ...]]:
    if not rows.shape[1]:
        return []
    new, twin = _steps(rows, last)
    group = np.cumsum(np.r_[True, rows[0, 1:] != rows[0, :-1]]) - 1
    several = np.bincount(group[new], minlength=group[-1] + 1) > 1
    hot = (rows[0] & 1) == 1
    close = np.flatnonzero(new & (several[group] | hot | crowded))
    kind = np.where(hot[close] | crowded, 3, 2)
    key, mark, a, b = _covered(*rows[2:, ~new & ~twin])
    return [(rows[2, close], rows[3, close], kind, rows[4, close], np.zeros(len(close))), (key, mark, np.full(len(key), 1), a, b)]


def _sifted_batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.record_batch({n: np.concatenate([np.asarray(o[i], np.int64) for o in out] or [np.empty(0, np.int64)]) for i, n in enumerate(("key", "mark", "kind", "x", "y"))})


def _looked_at(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with their rows to what is compared: the dictionary's words (g trigger, even; x at; blob: the word's bytes), the
    strings of crowded triggers (g odd and d: the string's hash; x at), and intervals known to repeat (x -1, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, out, strings = zstandard.ZstdDecompressor(), [], []
        for batch in batches:
            for key, mark, blob, rows in zip(*(batch[n].to_pylist() for n in ("key", "mark", "blob", "rows")), strict=True):
                if not rows:
                    continue
                known = sorted((r["x"], r["y"]) for r in rows if r["kind"] == 1)
                if known:
                    a, b = _intervals(*np.array(known, np.int64).T)
                    out.append((key ^ mark, 0, key, mark, -1, np.stack([a, b], 1).astype("<i8").tobytes()))
                text = zstd.decompress(blob)
                for r in rows:
                    if r["kind"] == 1:
                        continue
                    x = r["x"]
                    place, left, right = x >> 14, (x >> 7) & 127, x & 127
                    if r["kind"] == 2:
                        g = xxhash.xxh3_64_intdigest(text[place : place + GRAIN])
                        out.append(((g - (1 << 63)) & ~1, 0, key, mark, x, text[place - left : place - right + length]))
                        continue
                    for f in range(left, right - 1, -1):
                        g = xxhash.xxh3_128_intdigest(text[place - f : place - f + length])
                        strings.append(((g >> 64) - (1 << 63) | 1, (g & ((1 << 64) - 1)) - (1 << 63), key, mark, place - f))
                if len(strings) >= _SETTLE:
                    out += _settled_strings(strings)
                    strings = []
                if len(out) >= 4096:
                    yield _compared_batch(out)
                    out = []
        out += _settled_strings(strings)
        if out:
            yield _compared_batch(out)

    return run


def _settled_strings(strings: list[tuple[int, ...]]) -> list[tuple]:
    """Of equal strings only the first is passed on; the others become intervals that repeat."""
    if not strings:
        return []
    rows = np.array(strings, np.int64).T
    rows = rows[:, np.lexsort(rows[::-1])]
    new, twin = _steps(rows, None)
    out = [(g, d, key, mark, x, None) for g, d, key, mark, x in rows[:, new].T.tolist()]
    later = rows[2:, ~new & ~twin]
    key, mark, x = later[:, np.lexsort(later[::-1])]
    for k, m, a, b in zip(*(v.tolist() for v in _runs(key, mark, x, x + 1)), strict=True):
        out.append((k ^ m, 0, k, m, -1, np.array([a, b], "<i8").tobytes()))
    return out


def _compared_batch(out: list[tuple]) -> pa.RecordBatch:
    *longs, blob = zip(*out, strict=True)
    return pa.record_batch({**{n: pa.array(v, pa.int64()) for n, v in zip(("g", "d", "key", "mark", "x"), longs, strict=True)}, "blob": pa.array(blob, pa.binary())})


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of the suffix at each place of ``data`` (uint8) among all, by their first ``length`` (8 or more) bytes: equal where these are. Zeros stand behind the end.

    Prefix doubling: the ranks by 8 bytes are those of whole numbers, and ranks by w bytes at a place and w (or fewer) further on
    make ranks by up to 2 w.
    """
    n = len(data)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data
    value = np.zeros(n, np.uint64)
    for k in range(8):
        value = value << np.uint64(8) | wide[k : k + n]
    width = 8
    while True:
        order = np.argsort(value)
        steps = np.r_[False, value[order[1:]] != value[order[:-1]]]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(steps, dtype=np.uint64) + np.uint64(1)
        if width >= length:
            return rank
        step = min(width, length - width)
        further = np.zeros(n, np.uint64)
        further[: n - step] = rank[step:]
        value = rank << np.uint64(32) | further
        width += step


def _ordered(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams what is compared, sorted by (g, d, key, mark, x), to (key, mark, blob): intervals that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last = None
        for batch in batches:
            g, x = batch["g"].to_numpy(), batch["x"].to_numpy()
            yield batch.filter(pa.array(x < 0)).select(["key", "mark", "blob"])
            strings = np.stack([batch[n].to_numpy() for n in ("g", "d", "key", "mark", "x")])[:, (x >= 0) & (g & 1 == 1)]
            if strings.shape[1]:
                new, twin = _steps(strings, last)
                last = strings[:, -1]
                again = strings[2:, ~new & ~twin]
                key, mark, start = again[:, np.lexsort(again[::-1])]
                yield _interval_batch(*_runs(key, mark, start, start + 1))
            words = batch.filter(pa.array((x >= 0) & (g & 1 == 0)))
            if held is not None and held.num_rows:
                words = pa.Table.from_batches([held, words]).combine_chunks().to_batches()[0]
            if words.num_rows:
                g = words["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                held = words.slice(cut)
                if cut:
                    yield _repeats(words.slice(0, cut), length)
        if held is not None and held.num_rows:
            yield _repeats(held, length)

    return run


def _repeats(words: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The strings of a shard's dictionary (words of whole triggers, in the order of triggers and of the corpus) that have occurred before."""
    g, key, mark, x = (words[n].to_numpy() for n in ("g", "key", "mark", "x"))
    twin = np.r_[False, (g[1:] == g[:-1]) & (key[1:] == key[:-1]) & (mark[1:] == mark[:-1]) & (x[1:] == x[:-1])]
    key, mark, x = key[~twin], mark[~twin], x[~twin]
    blobs = words["blob"].filter(pa.array(~twin)).to_pylist()
    strings = ((x >> 7) & 127) - (x & 127) + 1
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    ranks = suffix_ranks(np.frombuffer(b"".join(blobs), np.uint8), length)
    row = np.repeat(np.arange(len(blobs)), strings)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    rank = ranks[inner + np.repeat(np.cumsum(size) - size, strings)]
    # strings stand in corpus order, so the first of a run of the suffix array is the one of least number
    order = np.argsort(rank)
    runs = np.flatnonzero(np.r_[True, rank[order[1:]] != rank[order[:-1]]])
    again = np.ones(len(row), bool)
    again[np.minimum.reduceat(order, runs)] = False
    row, start = row[again], ((x >> 14) - ((x >> 7) & 127))[row[again]] + inner[again]
    pick_ = np.lexsort((start, mark[row], key[row]))
    row, start = row[pick_], start[pick_]
    return _interval_batch(*_runs(key[row], mark[row], start, start + 1))


def _interval_batch(key: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"key": key, "mark": mark, "blob": pa.array([r.tobytes() for r in np.stack([a, b], 1).astype("<i8")], pa.binary())})


def _removed(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for doc_id, blob, blobs in zip(*(batch.slice(at, 512)[n].to_pylist() for n in ("doc_id", "blob", "blobs")), strict=True):
                    text = zstd.decompress(blob)
                    flat = np.frombuffer(b"".join(blobs or ()), "<i8").reshape(-1, 2)
                    flat = flat[np.argsort(flat[:, 0], kind="stable")]
                    starts, ends = _intervals(flat[:, 0], flat[:, 1] + length - 1)
                    kept, done = [], 0
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                        kept.append(text[done:s])
                        done = e
                    kept.append(text[done:])
                    spans = [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    out.append((doc_id, len(text), int((ends - starts).sum()), len(starts), spans, b"".join(kept)))
                yield pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out, strict=True), strict=True)})

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept for every row of ``docs`` (doc_id an integer, text).

    Removed is each byte covered by a ``length``-byte string (GRAIN to 128 + GRAIN bytes) that also starts earlier: in a document
    with a smaller doc_id, or further left in the same one. Strings are judged on the input and never cross documents. ``spans``
    are the removed runs in bytes, ``kept`` the remaining bytes (not always whole UTF-8 characters). A null text counts as the
    empty text; a null doc_id comes before all others. Rows that repeat doc_id and text are one document and each get its result;
    texts that share a doc_id stand in the order of a hash. An empty table gives no rows, and a text without repeats comes back whole.

    Words, strings and intervals are dealt out by hash, and what a batch of rows repeats is settled before it is shuffled. Hot
    triggers are dealt out by word and by string. Texts, compressed, are shuffled once. Every task streams sorted rows and holds
    a batch and CROWD words at most.
    """
    if not GRAIN <= length < 128 + GRAIN:
        raise ValueError("length must be at least a grain, and its grains fewer than 128")
    sc = docs.sparkSession.sparkContext
    slim = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("key"), "text")
    share = min(1.0, SAMPLE / max(1, slim.count()))
    sample = slim.where(F.pmod(F.xxhash64(F.lit("hot"), "key"), F.lit(1 << 40)) < share * (1 << 40)).mapInArrow(_words(length, None), "h long")
    seen = sample.groupBy("h").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "h").limit(HOTTEST).collect()
    hot = sc.broadcast(np.sort(np.array([r.h for r in seen], np.int64).view(np.uint64)))

    parse = slim.select("key", "text").mapInArrow(lambda it: _words(length, hot.value)(it), _ROW)
    sifted = parse.repartition("h").sortWithinPartitions("h", "c", "key", "mark", "at").mapInArrow(_sifted, "key long, mark long, kind long, x long, y long")
    # both joins have the same left side, so its exchange is made once and read twice
    texts = slim.mapInArrow(_compressed, "key long, mark long, doc_id long, blob binary")
    marks = sifted.groupBy(F.col("key").alias("k"), F.col("mark").alias("m")).agg(F.collect_list(F.struct("kind", "x", "y")).alias("rows"))
    looked = texts.join(marks, (texts["key"] == marks["k"]) & (texts["mark"] == marks["m"]), "left").mapInArrow(_looked_at(length), _STRING)
    found = looked.repartition("g").sortWithinPartitions("g", "d", "key", "mark", "x").mapInArrow(_ordered(length), "key long, mark long, blob binary")
    blobs = found.groupBy(F.col("key").alias("k"), F.col("mark").alias("m")).agg(F.collect_list("blob").alias("blobs"))
    last = texts.join(blobs, (texts["key"] == blobs["k"]) & (texts["mark"] == blobs["m"]), "left")
    return last.mapInArrow(_removed(length), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = _batch_texts(batch)
        marks = pa.array([_text_hash(t) for t in texts], pa.int64())
        yield pa.record_batch({"key": batch["key"], "mark": marks, "doc_id": batch["doc_id"], "blob": pa.array([zstd.compress(t) for t in texts], pa.binary())})
