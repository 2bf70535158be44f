"""Operators against plain implementations, on the smallest tables and on small awkward ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
import xxhash
from tokenizers import Tokenizer

from awkward import AWKWARD, LONG
from splitproof.llm import bpe, order_minhash, suffix_dedup
from splitproof.llm.queries import ORACLES, QUERIES, TOKENIZER

Q = {n.split("_")[0]: (n, f) for n, f in QUERIES.items()}


def low(t):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def got(spark, sf):
    def run(op, *columns):
        return {r.doc_id: tuple(r[c] for c in columns) for r in Q[op][1](spark, sf).collect()}

    return run


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    index = {d[0]: i for i, d in enumerate(want.description)}
    rows = sorted(tuple(r[index[k]] for k in columns) for r in want.fetchall())
    out = QUERIES[name](spark, sf)
    assert sorted(out.columns) == columns
    assert sorted(tuple(r) for r in out.select(*columns).collect()) == rows


def test_sharding_law(docs, got):
    rows = got("op1", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    for d, t in docs:
        data = (t or "").encode()
        assert rows[d][:3] == (len(data) + 1, zlib.crc32(data), "key")
        assert rows[d][5] in (rows[d][3], 16) and 0 <= rows[d][3] < 16
    slots = defaultdict(list)
    for r in rows.values():
        slots[r[3]].append(r[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_order_minhash(docs, got):
    rows = got("op2", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def like(a, b):
        return float(a == b) if not (a and b) else sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / (len(a) // 8)

    ordered = sorted(docs)
    for i, (d, t) in enumerate(ordered):
        follow, t = ordered[(i + 1) % len(ordered)][1] or "", t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        a, b, c = (order_minhash.fingerprint(x) for x in (t, edited, follow))
        assert rows[d] == (len(t), sha(edited), a, b, like(a, b), like(a, c))
    assert sum(r[4] for r in rows.values()) > 10 * sum(r[5] for r in rows.values())


def test_order_matters_to_fingerprints():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(2000))
    near = order_minhash.fingerprint(a[:990] + "x" + a[990:])
    swapped = order_minhash.fingerprint(a[1000:] + a[:1000])
    count = lambda x, y: sum(x[i : i + 8] == y[i : i + 8] for i in range(0, len(x), 8)) / 64
    full = order_minhash.fingerprint(a)
    assert count(full, near) > 0.9 > count(full, swapped) > 0.2


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(points, most=3):
    up = {d: d for d in points}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(points)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (points[a] ^ points[b]).bit_count() <= most:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in points}


def test_simhash(docs, got):
    points = {d: simhash(t) for d, t in docs}
    roots = reached(points)
    assert got("op3", "fingerprint", "component_id") == {d: (f"{points[d]:016x}", roots[d]) for d in points}


@pytest.mark.parametrize("crowd", [4096, 3])
def test_multi_index_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    from splitproof.llm import components, simhash as s

    monkeypatch.setattr(s, "CROWD", crowd)
    rng = random.Random(7)
    points = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    linked = s.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    pairs = linked.collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in pairs)
    roots = {r.node: r.root for r in components.components(linked).collect()}
    want = reached(dict(zip(signed, points, strict=True)))
    assert {p: roots.get(p, p) for p in signed} == want


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))


def contaminated(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if s := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(docs, got, spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = got("op4", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted([(d, *r) for d, r in rows.items()], key=str) == contaminated(docs, items)


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_decontamination_of_awkward_items(spark, awkward, monkeypatch, block):
    from splitproof.llm import decontaminate as d

    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    items = [(1, "four FIVE"), (2, "shared line"), (3, None), (4, ""), (5, LONG[:400]), (6, "..."), (6, "row"), (7, "nowhere at all")]
    found = d.contamination(awkward, spark.createDataFrame(items, "item_id long, text string")).collect()
    rows = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, sha(",".join(r.item_ids)), r.contaminated) for r in found], key=str)
    assert rows == contaminated([(x[0], x[1]) for x in AWKWARD], items)
    for r in found:
        w = next(words(x[1]) for x in AWKWARD if x[0] == r.doc_id and len(words(x[1])) == r.n_words)
        for m in r.matches:
            item = next(words(t) for i, t in items if str(i) == m["item"] and words(t)[m["item_start"] : m["item_start"] + m["length"]] == w[m["start"] : m["start"] + m["length"]])
            assert item


def test_language(spark, sf):
    rows = Q["op5"][1](spark, sf.replace("sf0.001", "sf0.01")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)


def deduplicated(docs, least=10):
    strip, seen = " \t\n\x0b\x0c\r", defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            seen[low(line.strip(strip))].add(d)
    gone = {k for k, v in seen.items() if len(k) >= 1 and len(v) >= least}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x.strip(strip)) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [1e-4, 0.3])
def test_line_dedup_of_awkward_rows(spark, awkward, monkeypatch, share):
    from splitproof.llm import line_dedup as m

    monkeypatch.setattr(m, "HEAVY_SHARE", share)
    rows = m.drop_frequent_lines(awkward, 3).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in rows], key=str) == deduplicated([(x[0], x[1]) for x in AWKWARD], 3)


def test_bpe(docs, got):
    t = Tokenizer.from_file(TOKENIZER)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in docs}
    assert got("op7", "n_tokens", "ids_sha256", "decoded_sha256") == {d: (len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for d, i in ids.items()}
    assert got("op9", "n_bytes", "n_tokens", "over_limit") == {d: (len((x or "").encode()), len(ids[d]), len(ids[d]) > 512) for d, x in docs}


def test_encoder_on_odd_texts():
    t, encode, v = Tokenizer.from_file(TOKENIZER), bpe.encoder(TOKENIZER), bpe.vocabulary(TOKENIZER)
    rng = random.Random(3)
    parts = ["a", "ab", "  ", " ", "\n", "\t", "é", "ß", "'s", "'LL", "12", "!!", "中", "😀", " ", "\x1c", "\x85", "ing", "aaaa", "<|endoftext|>", "<|", "İ", "_", "\r\n", "²", "Ⅷ", "՘", "　", "‍"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = t.encode(s, add_special_tokens=False).ids
        assert encode(s).tolist() == want, s
        assert v.decode(encode(s).astype("i8")) == t.decode(want, skip_special_tokens=False)
    for _ in range(3000):
        s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 3, 26])]) for _ in range(rng.randint(1, 40)))
        assert encode(s).tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    cache = bpe.Pieces(len)
    assert [cache["x" * (i % 9)] for i in range(100)] == [i % 9 for i in range(100)]
    assert len(cache) <= 5 and len(cache.old) <= 5


def repeats(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if (x := b[p : p + length]) in seen:
                m[p : p + length] = b"\1" * length
            else:
                seen.add(x)
        out[d] = (len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), sha(bytes(y for y, z in zip(b, m, strict=True) if not z)))
    return out


def test_repeats(docs, got):
    assert got("op8", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(docs, 100)


@pytest.mark.parametrize("seed,hot", [(0, 20), (1, 1)])
def test_repeats_in_repetitive_texts(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)] + ["a" * 50, "é" * 30]
    docs = [(i * 3 - 5, "".join(rng.choice(base)[: rng.randint(1, 60)] for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(1000, None)]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 33).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in rows} == repeats(docs, 33)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    from splitproof.llm.pii import pseudonymise

    cards = ["4539148803436467", "4111111111111111", "4012888888881881"]
    rows = [(i, f"card {c} and {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}") for i, c in enumerate(cards)]
    rows += [(10, "bad 4539148803436468 300.1.1.1 2023-02-29 666-12-1234"), (11, "ip 10.0.0.1 day 2024-02-29, 123-45-6789, GB82 WEST 1234 5698 7654 32 +1 (644) 555-7859 or 644-555-7859")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonymise(df, "key").collect()}
    new = set()
    for i, c in enumerate(cards):
        a, b = re.match(r"card (\d{16}) and ((?:\d{4} ?){4})$", out[i].text).groups()
        assert a == b.replace(" ", "") != c and luhn(a) and out[i].n_replaced == 2
        new.add(a)
    assert len(new) == 3
    assert out[10].text == rows[3][1] and out[10].n_replaced == 0
    m = re.match(r"ip (\S+) day (\d{4}-\d\d-\d\d), (\d{3}-\d\d-\d{4}), (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d) \+1 \((\d{3})\) (\d{3}-\d{4}) or (\S+)$", out[11].text)
    assert m and m[7] == f"{m[5]}-{m[6]}" and all(0 <= int(x) < 256 for x in m[1].split("."))
    iban = m[4].replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert {r.doc_id: r for r in pseudonymise(df.repartition(3), "key").collect()} == out
    other = {r.doc_id: r.text for r in pseudonymise(df, "another").collect()}
    assert other[0] != out[0].text


def test_pseudonyms_permute_a_whole_domain(spark):
    """Over every date of some years no two pseudonyms agree."""
    from pyspark.sql import functions as F

    from splitproof.llm.pii import pseudonymise

    days = spark.range(3000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r.text for r in pseudonymise(days, "key").collect()]
    assert len(set(out)) == 3000 and all(re.match(r"\d{4}-\d\d-\d\d$", x) for x in out)


def test_grams_of_a_language():
    from splitproof.llm.language import Filters, grams

    assert grams("12 !") is None and len(grams("a")) == 1 and len(grams("Abc, def")) == 6
    f = Filters(["de", "en"], [], 1)
    assert f.predict("words") == ("en", 0.0, 0.0) and f.predict(None)[0] == "und" and Filters([], []).predict("words")[0] == "und"


def test_only_undetermined_texts_are_rejected(spark):
    from splitproof.llm.language import Filters, keep_identified

    docs = spark.createDataFrame([(1, "letters that no filter knows"), (2, "A."), (3, "12 !"), (4, ""), (5, None)], "doc_id long, text string")
    kept = lambda *least: sorted(r.doc_id for r in keep_identified(docs, *least, filters=Filters(["de", "en"], [], 1)).collect())
    assert kept() == [1, 2] and kept(0.1) == []


def test_dates_before_times_and_day_first(spark):
    from splitproof.llm.pii import pseudonymise

    texts = ["2024-05-01T10:00:00Z", "2024-05-01", "31/12/1999", "12/11/1999", "30/02/2001"]
    out = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert out[0] == out[1] + "T10:00:00Z" and out[1] != texts[1]
    assert re.match(r"(1[3-9]|2\d|3[01])/(0\d|1[0-2])/\d{4}$", out[2]) and out[2] != texts[2] and out[3] != texts[3] and out[4] == texts[4]


def test_phone_numbers_keep_their_link_across_separators(spark):
    from splitproof.llm.pii import pseudonymise

    texts = ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+353 1234 5678", "+35312345678", "+1 644 555 7859", "644-555-7859"]
    out = {r.doc_id: r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    digits = [re.sub(r"\D", "", out[i]) for i in range(len(texts))]
    assert digits[0] == digits[1] == digits[2] != "442079460958" and digits[0][:2] == "44" and out[0][3] == " " and out[2][3] == "-"
    assert digits[3] == digits[4] != "35312345678" and digits[3][:3] == "353" and digits[5] == "1" + digits[6] != "16445557859"
