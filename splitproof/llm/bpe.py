"""Operators 7 and 9, byte-level BPE: a backtracking encoder, a decoder by offset table, and token counts by two-tier lookup.

The encoder takes the longest token that matches next (an Aho-Corasick automaton gives, for each place, the tokens that start
there) and keeps it if the pair it makes with the token before it is one that the merges would leave as it is; if not, it tries
the token's next shorter prefix, and steps back when none is left. Places once found to lead nowhere are not tried again, so the
work is linear. The result is the one that applying the merges in order gives.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice, pairwise
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import numbered, pick

#: The splitting pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache: so many used lately, and at most as many before those.
CACHE_ENTRIES = 120_000
#: Operator 9: documents that frequent pre-tokens are counted in at most, pre-tokens in the broadcast table, and their longest bytes. They affect speed alone.
SAMPLE_DOCUMENTS, FREQUENT, FREQUENT_BYTES = 2_000, 50_000, 24


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where it prints, else the next free code point from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(c): b for c, b in [*zip(prints, prints, strict=True), *((256 + i, b) for i, b in enumerate(rest))]}


class Vocabulary:
    """The tables of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        alphabet = _byte_alphabet()
        octets = {t: bytes(alphabet[c] for c in t) for t in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.special_re = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in model["vocab"].items():
            self.token[i] = octets[t]
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.id = {octets[t]: i for t, i in model["vocab"].items()}
        #: A merge's rank by its pair; the pair that made a token, and that merge's rank (single bytes: none, -1).
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        self.born = [-1] * size
        for r, m in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = self.id[self.token[a] + self.token[b]]
            self.rank[a, b] = r
            if whole not in self.made:
                self.made[whole], self.born[whole] = (a, b), r
        #: Tokens that encoding can give: bytes, and those that their own merges give back.
        self.automaton = ahocorasick.Automaton()
        self.length = [len(t) for t in self.token]
        sound = {i for t, i in self.id.items() if len(t) == 1}
        for i, (a, b) in sorted(self.made.items(), key=lambda x: self.born[x[0]]):
            if a in sound and b in sound and self._apart(a, b, self.born[i]):
                sound.add(i)
        reachable = sorted(sound)
        for i in reachable:
            self.automaton.add_word(self.token[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.most = max(self.length)
        self.sound = {self.token[i]: i for i in reachable}
        self.prefix = [next((self.sound[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.sound), -1) for t in self.token]
        self._fits = Fits(self)
        self._known = Pieces(lambda p: array("I", self.encode_piece(p.encode())).tobytes())
        self.offsets = np.cumsum([0, *self.length])
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)

    def _apart(self, left: int, right: int, end: float = float("inf")) -> bool:
        """Whether nothing is merged across the border of two tokens before the merge of rank ``end``.

        Merges are undone from the last to the first, which shows each pair that stood at the border and the merges that took
        its left or right side away. A merge of the pair itself would have come first if its rank is below the left one's (which
        stands further left and so wins a tie) and not above the right one's.
        """
        left_goes = right_goes = end
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < left_goes and rank <= right_goes and rank < end:
                return False
            a, b = self.born[left], self.born[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left_goes, left = a, self.made[left][1]
            else:
                right_goes, right = b, self.made[right][0]

    def _longest(self, spelled: str, piece: bytes, at: int) -> int:
        """The longest token that starts at a place: the automaton's longest path from there, cut back to a token."""
        n = self.automaton.longest_prefix(spelled[at : at + self.most])
        while (found := self.sound.get(piece[at : at + n])) is None:
            n -= 1
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.sound.get(piece)
        if whole is not None:
            return [whole]
        spelled, n, length, fits = piece.decode("latin-1"), len(piece), self.length, self._fits
        out = [i for _, i in self.automaton.iter_long(spelled)]  # longest match after longest match: mostly right as it is
        good = 1
        for left, right in pairwise(out):
            if not fits[left << 24 | right]:
                break
            good += 1
        else:
            return out
        # the first token that doesn't go with the one before it gives way to its prefixes
        out, nxt = out[:good], self.prefix[out[good]]
        dead, at = bytearray(n + 1), sum(map(length.__getitem__, out))
        while True:
            while nxt >= 0:
                end = at + length[nxt]
                if not dead[end] and (not out or fits[out[-1] << 24 | nxt]):
                    break
                nxt = self.prefix[nxt]
            if nxt >= 0:
                out.append(nxt)
                at = end
                if at == n:
                    return out
                nxt = self._longest(spelled, piece, at)
            elif out:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                nxt = self.prefix[last]
            else:
                raise ValueError("the vocabulary can't spell this text")

    def encode(self, text: str) -> bytes:
        """The tokens of a text without special tokens in it, 32 bits each."""
        return b"".join(map(self._known.__getitem__, _split(text)))

    def encode_word(self, piece: str) -> bytes:
        """The tokens of a space and a piece; words, alone or before a point or comma, are pre-tokens as they are."""
        if piece.isalpha():
            return self._known[" " + piece]
        if piece[-1:] in (".", ",") and piece[:-1].isalpha():
            return self._known[" " + piece[:-1]] + self._known[piece[-1]]
        return self.encode(" " + piece)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some tokens: their bytes are gathered through the offset table; what isn't UTF-8 becomes U+FFFD."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - ends + size, size)].tobytes().decode("utf-8", "replace")


class Fits(dict):
    """Of a pair of tokens (left << 24 | right): whether the merges leave them as they are when they stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[pair] = self.vocabulary._apart(pair >> 24, pair & 0xFFFFFF)
        return value


_SPLIT = regex.compile(PATTERN)
#: White space, a space and more white space (or the end): where a text can't be cut before each space that follows a word.
_RUN = regex.compile(r"\s (?:\s|$)")


def _split(text: str) -> list[str]:
    """Pre-tokens. The regex module may know letters that are newer than the tokenizer; what unicodedata calls unassigned is none."""
    if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in text):
        return _SPLIT.findall(text)
    plain = "".join("\uffff" if unicodedata.category(c) == "Cn" else c for c in text)
    return [text[slice(*m.span())] for m in _SPLIT.finditer(plain)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces(dict):
    """Looks up what ``make`` gives for a piece. When CACHE_ENTRIES are held they become the old ones, which are kept only as they are used."""

    def __init__(self, make: Callable[[str], Any]):
        self.make, self.old = make, {}

    def forget(self) -> None:
        self.old = {}
        self.clear()

    def __missing__(self, piece: str) -> Any:
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


def pieces(text: str) -> Iterator[list[str]]:
    """Cuts a text into lists of pieces whose tokens don't depend on each other; a piece is the first of its list or stands behind a space.

    The cuts are the single spaces before a word, where pre-tokens always part. Texts in which white space meets at a space are
    cut by the pattern itself, in short lists.
    """
    if _RUN.search(text):
        for p in _split(text):
            yield [p]
    else:
        yield text.split(" ")


#: What ``_RUN`` matches, and some more, for Arrow's matcher, whose white space is ASCII only.
_SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Bytes of text whose pieces are looked up together.
_TOGETHER = 1 << 22


class Batch:
    """The pieces of some texts, each distinct one once: ``pieces``, and of each text the numbers of its pieces (``which``, from ``bounds``).

    Texts that can't be cut at spaces, or hold special strings, are ``odd``.
    """

    def __init__(self, texts: pa.Array, special: list[str]):
        odd = pa.compute.match_substring_regex(texts, f"{_SPACES} (?:{_SPACES}|$)")
        for s in special:
            odd = pa.compute.or_(odd, pa.compute.match_substring(texts, s))
        self.texts, self.odd = texts, np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = pa.compute.split_pattern(pa.compute.if_else(odd, "", texts), " ")
        coded = cut.flatten().dictionary_encode()
        self.pieces, self.which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.bounds = np.r_[0, np.cumsum(pa.compute.list_value_length(cut).to_numpy())].astype(np.int64)

    def firsts(self) -> np.ndarray:
        """Of each text the number of its first piece, which no space precedes."""
        return self.which[self.bounds[:-1]]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with _TOGETHER bytes of ``__text`` or a single row."""
    ends = np.cumsum(pa.compute.binary_length(batch["__text"]).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _TOGETHER, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Encoder:
    """Token ids (uint32) of texts as the file's tokenizer gives them without adding special tokens; with bounded caches."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.first, self.later = Pieces(self.v.encode), Pieces(self.v.encode_word)

    def __call__(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for k, part in enumerate(self.v.special_re.split(text) if self.v.special_re else [text]):
            if k % 2:
                out.append(np.array([self.v.special[part]], np.uint32).tobytes())
            elif part:
                for group in pieces(part):
                    out.append(self.first[group[0]])
                    if len(group) > 1:
                        out.append(b"".join(map(self.later.__getitem__, group[1:])))
        return np.frombuffer(b"".join(out), np.uint32)

    def forget(self) -> None:
        """Empties the caches, some hundred MB that a worker would else hold through the tasks of other stages."""
        for cache_ in (self.first, self.later, self.v._known):
            cache_.forget()
        self.v._fits.clear()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has). Each distinct piece is looked up once; the texts' ids are gathered from those of their pieces."""
        cut = Batch(texts, list(self.v.special))
        firsts = cut.firsts()
        coded = [self.later[p] for p in cut.pieces] + [self.first[cut.pieces[i]] for i in np.unique(firsts)]
        odd = [self(texts[int(i)].as_py()).tobytes() for i in cut.odd]
        which = cut.which.astype(np.int64)
        which[cut.bounds[:-1]] = len(cut.pieces) + np.searchsorted(np.unique(firsts), firsts)
        which[cut.bounds[cut.odd]] = len(coded) + np.arange(len(odd))  # an odd text has one, empty, piece
        coded += odd
        size = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
        start = np.cumsum(size) - size
        n = size[which]
        flat = np.frombuffer(b"".join(coded), np.uint32)
        ids = flat[np.arange(n.sum()) + np.repeat(start[which] - np.cumsum(n) + n, n)]
        return ids.astype(np.int32), np.add.reduceat(n, cut.bounds[:-1]) if len(texts) else n


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decoded(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of tokens, ``counts`` of them each: all bytes are gathered at once through the offset table, and checked to be UTF-8 once."""
    size = v.offsets[ids + 1] - v.offsets[ids]
    ends = np.cumsum(size)
    raw = v.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(v.offsets[ids] - ends + size, size)]
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    try:
        raw.tobytes().decode()
        whole = not ((raw[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole:
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
    return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def with_tokens(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """``docs``, all columns kept, with ``n_tokens`` (long), ``ids`` (array<int>) and ``decoded`` (string) after its own.

    A null text counts as the empty text, which has no tokens. Special strings inside a text become their special tokens.
    Rows that repeat come out alike; an empty table gives no rows. No shuffle: each row is encoded where it is read, and pieces
    that texts of some megabytes share are looked up once. ``keep``: whether workers keep their caches after each of these lookups;
    if not, encoding takes more time, and less memory during and after it.
    """
    rows = numbered(docs).withColumn("__text", F.coalesce(F.col(f"__c{docs.columns.index('text')}"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, v = encoder(path), vocabulary(path)
        for whole in batches:
            for batch in slices(whole):
                ids, counts = encode.batch(batch["__text"])
                if not keep:
                    encode.forget()
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(ids))
                own = [batch[n] for n in batch.schema.names[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), lists, decoded(v, ids, counts)], [*batch.schema.names[:-1], "__n", "__ids", "__decoded"])

    schema = rows.drop("__text").schema.add("__n", "long").add("__ids", ArrayType(IntegerType())).add("__decoded", "string")
    return rows.mapInArrow(run, schema).toDF(*docs.columns, "n_tokens", "ids", "decoded")


class Frequent(dict):
    """The first tier, pre-tokens and their numbers of tokens from the broadcast table; what it misses goes to the worker's cache."""

    def __init__(self, packed: bytes, misses: Pieces):
        table = pa.ipc.open_stream(packed).read_all()
        super().__init__(zip(table["piece"].to_pylist(), table["n"].to_pylist(), strict=True))
        self.misses = misses

    def __missing__(self, piece: str) -> int:
        return self.misses[piece]


def frequent_pieces(docs: DataFrame, path: str) -> bytes:
    """The compact table of the first tier: pre-tokens that are frequent in a sample, and their numbers of tokens.

    The sample is the first rows of each partition, or of some partitions where there are many, SAMPLE_DOCUMENTS rows or so in all, so
    that little is read for it. The table has FREQUENT entries of FREQUENT_BYTES characters at most. It affects speed, never a count.
    """
    slim = pick(docs, text="text")
    parts = max(1, slim.rdd.getNumPartitions())
    each, every = max(1, SAMPLE_DOCUMENTS // parts), max(1, parts // SAMPLE_DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        if TaskContext.get().partitionId() % every == 0:
            texts = (t for batch in batches for t in batch["text"].slice(0, each).to_pylist() if t)
            for text in islice(texts, each):
                seen.update(p for p in _split(text) if len(p) <= FREQUENT_BYTES)
        best = seen.most_common(FREQUENT)
        yield pa.record_batch({"piece": pa.array([p for p, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    top = slim.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()
    v, out = vocabulary(path), pa.BufferOutputStream()
    table = pa.record_batch({"piece": pa.array([r.piece for r in top], pa.string()), "n": pa.array([len(v.encode_piece(r.piece.encode())) for r in top], pa.uint16())})
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_batch(table)
    return out.getvalue().to_pybytes()


class Counted:
    """Numbers of tokens of texts. A text's pieces are told apart once for each batch; their pre-tokens are looked up in both tiers."""

    def __init__(self, path: str, packed: bytes):
        self.v = vocabulary(path)
        self.lengths = Frequent(packed, Pieces(lambda p: len(self.v.encode_piece(p.encode()))))

    def of(self, text: str) -> int:
        return sum(map(self.lengths.__getitem__, _split(text)))

    def whole(self, text: str) -> int:
        parts = self.v.special_re.split(text) if self.v.special_re else [text]
        return sum(1 if k % 2 else self.of(part) for k, part in enumerate(parts))

    def batch(self, texts: pa.Array) -> np.ndarray:
        cut = Batch(texts, list(self.v.special))
        n = np.fromiter((self.of(" " + p) for p in cut.pieces), np.int64, len(cut.pieces))[cut.which]
        firsts, at = np.unique(cut.firsts(), return_inverse=True)
        n[cut.bounds[:-1]] = np.array([self.of(cut.pieces[i]) for i in firsts], np.int64)[at]
        n[cut.bounds[cut.odd]] = [self.whole(texts[int(i)].as_py()) for i in cut.odd]
        return np.add.reduceat(n, cut.bounds[:-1]) if len(texts) else n


@cache
def _counter(path: str, packed: bytes) -> Counted:
    return Counted(path, packed)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of ``docs`` (doc_id, text).

    Counts are those of the file's tokenizer, without added special tokens; special strings inside a text count as their special
    tokens. A null text counts as the empty text. Rows that repeat come out alike; an empty table gives no rows. Pre-tokens are
    looked up where the text is read, first in the broadcast table, then in the worker's cache, once for each distinct piece of
    some megabytes of text; nothing is shuffled but the counts of the sample that the table is made from.
    """
    slim = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, table.value)
        for whole in batches:
            for batch in slices(whole):
                n = count.batch(batch["__text"])
                size = pa.compute.binary_length(batch["__text"]).cast(pa.int64())
                yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit, pa.bool_())})

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
