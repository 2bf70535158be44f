"""Fingerprints, languages, pseudonyms, repeats, contamination and the pipeline against plain implementations."""

from __future__ import annotations

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from plain_pii import Plain
from pyspark.sql import functions as F
from test_brute_force import Q, contaminated, deduplicated, low, repeats, sha, words
from test_near_copies import reached
from tokenizers import Tokenizer

import corpus_pipeline
from awkward import AWKWARD
from splitproof.llm import decontaminate, language, line_dedup, order_minhash, queries, suffix_dedup
from splitproof.llm.pii import pseudonymise

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


def numbered(text):
    """A 32-bit number for each k-mer of 8 code points and its occurrence: a polynomial hash, mixed, with the occurrence mixed in."""
    points = [ord(c) + 1 for c in text]
    points += [0] * (8 - len(points)) if points else []
    seen, out = defaultdict(int), []
    for i in range(len(points) - 7 if points else 0):
        h = 0
        for p in points[i : i + 8]:
            h = (h * 0x9E3779B97F4A7C15 + p) & M64
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93 & M64) >> 24
        x = (h + seen[h] * 0xC2B2AE3D27D4EB4F) * 0x9FB21C651E98DF25 & M64
        seen[h] += 1
        out.append((x ^ x >> 28) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 32)
    return out


def order_min_hash(text):
    kmers, out = numbered(text), ""
    for flip, times in zip(order_minhash._FLIP.ravel().tolist(), order_minhash._TIMES.ravel().tolist(), strict=True):
        least = sorted(sorted(range(len(kmers)), key=lambda i: ((kmers[i] ^ flip) * times & M32, i))[:2])
        if not least:
            return ""
        h = len(least)
        for k in [*[kmers[i] for i in least], 0][:2]:
            h = (h ^ k) * 0x9E3779B97F4A7C15 & M64
            h ^= h >> 29
        out += f"{h >> 16 & M32:08x}"
    return out


@pytest.mark.parametrize("parts", ["1", "5"])
def test_order_min_hash(spark, parts):
    rng = random.Random(int(parts))
    texts = [None, "", "short", "exactly8", "abababababababab abababab", "ünïcödé 你好 words 😀" * 3] + [" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randint(3, 60))) for _ in range(8)]
    docs = [(i * 3 if i % 5 else None, t) for i, t in enumerate(texts)] + [(9, texts[8]), (9, "another"), (9, "another"), (9, "another")]
    order = spark.createDataFrame([(t or "",) for _, t in docs], "t string").select(F.xxhash64("t")).collect()
    ranked = sorted(((-(1 << 63) if d is None else d, h[0], t or "", d) for (d, t), h in zip(docs, order, strict=True)))
    like = lambda a, b: float(a == b) if not (a and b) else sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 512, 8)) / 64
    want = []
    for i, (_, _, t, d) in enumerate(ranked):
        follow = ranked[(i + 1) % len(ranked)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        a, b, c = map(order_min_hash, (t, edited, follow))
        want.append((d, len(t), sha(edited), a, b, like(a, b), like(a, c)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in order_minhash.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == sorted(want, key=str)


def grams(text):
    out, plain = "", text.lower()
    for i, c in enumerate(plain):
        if c.isalpha():
            out += c
        elif i and plain[i - 1].isalpha():
            out += " "
    out = (" " + out + " ").ljust(4)
    found = []
    for i in range(len(out) - 3):
        x = 0
        for c in out[i : i + 4]:
            x = (x * 0x9E3779B97F4A7C15 + ord(c)) & M64
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & M64
        x ^= x >> 29
        found.append(tuple(x >> 18 * k & (1 << 18) - 1 for k in range(3)))
    return found


def test_languages(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in docs}
    train, table = defaultdict(list), {}
    for d, t, lang in docs:
        if not held[d] and t is not None and lang is not None:
            train[lang].append(set(grams(t)) if any(c.isalpha() for c in t) else set())
    for lang, found in train.items():
        counts = defaultdict(int)
        for g in found:
            for x in g:
                counts[x] += 1
        table[lang] = {p for x, n in counts.items() if n >= 0.01 * len(found) for p in x}
    want = {}
    for d, t, _ in docs:
        if t is None or not any(c.isalpha() for c in t):
            want[d] = (held[d], "und", 0.0)
            continue
        g, real = grams(t), {}
        for lang in sorted(table):
            chance = min((len(table[lang]) / (1 << 18)) ** 3, 0.999)
            real[lang] = min(max((sum(all(p in table[lang] for p in x) for x in g) - len(g) * chance) / (1 - chance), 0), len(g))
        best = max(sorted(real), key=real.get)
        want[d] = (held[d], best, round(real[best] / sum(real.values()), 9)) if sum(real.values()) else (held[d], max(sorted(train), key=lambda x: len(train[x])), 0.0)
    assert {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9)) for r in Q["op5"][1](spark, sf).collect()} == want


def test_dirty_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "words of one tongue", "aa") for i in range(40)] + [(100 + i, "mots dune autre langue", "bb") for i in range(30)] + [(200 + i, "noise", f"x{i}") for i in range(20)], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["aa", "bb"]


def test_pseudonyms_of_all_documents(spark, sf):
    plain = Plain(queries.PSEUDONYM_KEY)
    for folder in (sf, sf.replace("sf0.001", "sf0.01")):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        got = {r.doc_id: (r.text, r.n_found, r.n_replaced, r.kinds) for r in Q["op10"][1](spark, folder).collect()}
        assert got == {d: plain.text(t) for d, t in docs.items()}
        assert sum(x[2] for x in got.values()) > 10


def test_pseudonyms_of_every_kind(spark):
    texts = ["a.b+c@x-y.example.co.uk, A@b.cd", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 GB00 WEST 1234 5698 7654 32", "10.0.0.1 255.255.255.255 256.1.1.1", "2024-02-29 1799-12-31 2199-12-31 0000-01-01 2023-02-29T10:00", "12/31/1999 31/12/1999 05/06/1800 13/13/2000", "29.02.2024 31.04.2024", "+44 20 7946 0958 +1 (644) 555-7859 +12 34 5", "(644) 555-7859 644.555.7859", "123-45-6789 666-12-1234 900-11-1111 667-01-0001 899-99-9999", "4539148803436467 4539 1488 0343 6467 3782-822463-10005 4539148803436468", "", "nothing", None, "digits 7 only"]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k" * 200).collect()
    plain = Plain("k" * 200)
    assert {r.doc_id: (r.text, r.n_found, r.n_replaced, r.kinds) for r in rows} == {i: plain.text(t) for i, t in enumerate(texts)}


def test_pseudonyms_of_very_long_texts(spark):
    n = 1 << 20
    parts = ["a@" + "b." * (n // 2) + "com", "a" * n + "@b.com", "1" * n, "1-" * (n // 2), "12.34." * (n // 6), "GB82 WEST 1234 " * (n // 15), "+44 20 " * (n // 7), "2024-01-" * (n // 8), "a@b." * (n // 4), "(644) " * (n // 6), "AB12" * (n // 4), "@" * n, "4539 1488 " * (n // 10)]
    plain = Plain("key")
    got = {r.doc_id: (r.text, r.n_found, r.n_replaced) for r in pseudonymise(spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string"), "key").collect()}
    assert got == {i: plain.text(t)[:3] for i, t in enumerate(parts)}


def test_the_key_is_not_in_the_plan(spark, capsys):
    out = pseudonymise(spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string"), "very secret key")
    out.collect()
    out.explain("extended")
    shown = capsys.readouterr().out
    inner = bytes(b ^ 0x36 for b in b"very secret key")
    assert "very secret" not in shown and inner.decode("latin-1") not in shown and inner.hex()[:16] not in shown.lower() and "scalar-subquery" in shown


def sorted_repeats(docs, length):
    """Every row's result, documents in corpus order: null ids first, texts of an id by the operator's hash; equal rows are one document."""
    order = sorted(set(docs), key=lambda x: (-(1 << 63) if x[0] is None else x[0], suffix_dedup._text_hash((x[1] or "").encode())))
    found = repeats([(i, t) for i, (_, t) in enumerate(order)], length)
    by = {row: found[i] for i, row in enumerate(order)}
    return sorted(((d, *by[d, t]) for d, t in docs), key=str)


def removed(spark, docs, length=100, parts=5):
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in rows), key=str)


def test_texts_without_repeats(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abcdefghij klm") for _ in range(300))) for i in range(3)]
    assert removed(spark, docs, parts=3) == sorted_repeats(docs, 100)
    assert all(r[2] == 0 for r in removed(spark, docs))


def test_texts_that_share_an_id(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij") for _ in range(150))
    docs = [(0, passage), (5, passage), (5, "".join(rng.choice("klmnop") for _ in range(150)))]
    docs += [(None, "".join(rng.choice("abcdefghij") for _ in range(200)) + passage) for _ in range(300)] + [(5, passage), (7, None), (8, "")]
    assert removed(spark, docs) == sorted_repeats(docs, 100)


@pytest.mark.parametrize("hot,crowd,settle", [(20, 4096, 100_000), (1, 4096, 100_000), (20, 3, 10), (1, 2, 5)])
def test_repeats_of_crowded_triggers(spark, monkeypatch, hot, crowd, settle):
    for name, value in (("HOT", hot), ("CROWD", crowd), ("_SETTLE", settle)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(hot + crowd)
    passage = "".join(rng.choice("abcdefghij") for _ in range(140))
    docs = [(i, "".join(rng.choice("klmnop") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 20) : rng.randint(110, 140)] + "".join(rng.choice("klmnop") for _ in range(rng.randint(0, 90)))) for i in range(80)]
    docs += [(100 + i, "ab" * rng.randint(0, 200)) for i in range(10)] + [(200 + i, passage) for i in range(20)]
    assert removed(spark, docs) == sorted_repeats(docs, 100)


def test_suffix_ranks():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(300)) + b"abab" * 60
    for length in (8, 20, 32, 100):
        ranks = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), length).tolist()
        keys = [data[i : i + length].ljust(length, b"\0") for i in range(len(data))]
        assert sorted(range(len(data)), key=lambda i: (ranks[i], i)) == sorted(range(len(data)), key=lambda i: (keys[i], i))
        assert len(set(ranks)) == len(set(keys))


@pytest.mark.parametrize("block,shard", [(1 << 22, 1 << 22), (60, 300)])
def test_decontamination_of_repetitive_texts(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["aa", "bb"] if n % 2 else ["aa", "bb", "cc", "dd"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 90))) for i in range(40)] + [(50, "xx " * 400), (51, None), (52, "xx " * 14)]
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(30, "xx " * 60), (31, "aa bb aa"), (32, "xx")]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, sha(",".join(r.item_ids)), r.contaminated) for r in found], key=str) == contaminated(docs, items)
    for r in found:
        w, covered = words(dict(docs)[r.doc_id]), set()
        for m in r.matches:
            at, item = m["start"], words(dict(items)[int(m["item"])])
            covered |= set(range(at, at + m["length"]))
            assert item[m["item_start"] : m["item_start"] + m["length"]] == w[at : at + m["length"]]
            longest = max(next((k for k in range(min(len(x) - s, len(w) - at) + 1) if k == min(len(x) - s, len(w) - at) or x[s + k] != w[at + k])) for _, t in items for x in [words(t)] for s in range(len(x)) if min(len(x) - s, len(w) - at) >= min(13, len(x)) and x[s : s + min(13, len(x))] == w[at : at + min(13, len(x))])
            assert m["length"] == longest
        assert len(covered) == r.n_hit


def test_a_long_text_of_one_word_is_cheap():
    began = time.time()
    shard = decontaminate.Shard(["xx " * 200_000], 2_000)
    shard.search(decontaminate.Block([("1", "xx " * 2_000)]))
    n, hit, items, matches = shard.results()
    assert (n, hit, items) == ([200_000], [200_000], [["1"]]) and time.time() - began < 60


def test_heavy_lines_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_SHARE", 0.05)
    docs = [(1, "often\n" * 500 + "own"), (2, "often\nother"), *[(10 + i, f"shared {i % 3}\nown {i}\nEVERY") for i in range(12)], (None, "every\nevery")]
    rows = line_dedup.drop_frequent_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 4).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in rows], key=str) == deduplicated(docs, 4)


def pipeline(docs, items, tokenizer):
    """(doc_id, text, ids) of what stays, by plain means."""
    docs = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    seen, strip = defaultdict(set), " \t\n\x0b\x0c\r"
    key = lambda line: low(line.strip(strip))
    for d, t in docs:
        for line in t.split("\n"):
            seen[key(line)].add(d)
    docs = [(d, "\n".join(x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 10)) for d, t in docs]
    roots = reached(docs)
    docs = [(d, t) for d, t in docs if roots[d] == d]
    bad = {r[0] for r in contaminated(docs, items) if r[5]}
    return {d: (t, tokenizer.encode(t, add_special_tokens=False).ids) for d, t in docs if d not in bad}


def test_pipeline(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = pipeline(docs, items, Tokenizer.from_file(queries.TOKENIZER))
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.text, r.ids) for r in got} == want and len(got) == len(want) < len(docs)
    assert all(r.n_tokens == len(r.ids) and r.round_trip and r.n_chars == len(r.text) for r in got)


def test_stages_with_clashing_columns(spark, sf):
    rows = [(i, "KEY", d, 0.5, t, "n", lang, "x", len(t or "")) for i, (d, t, lang, _) in enumerate(AWKWARD)]
    now = spark.createDataFrame(rows, "a long, b string, c long, d double, e string, f string, g string, h string, i long").toDF("line", "key", "doc_id", "score", "text", "n_tokens", "lang", "Text", "n_chars")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert now.columns[: len(columns)] == columns and (name == "tokens" or now.columns == columns)
    assert now.count() > 0
