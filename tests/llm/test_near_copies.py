"""The pipeline's near copies against all pairs."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from splitproof.llm import near_copies as m


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def reached(docs):
    sets, up = {d: grams(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(docs_of, rng, vocabulary):
    out = []
    for _ in range(docs_of):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 60, 150, 400]))]
        out.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(rng.choice(out[-3:]))
            for _ in range(max(1, len(copy) * rng.randint(0, 5) // 100)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("often", [4, 2])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, often):
    monkeypatch.setattr(m, "OFTEN", often)
    rng = random.Random(often)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = edited(60, rng, [f"w{i}" for i in range(3000)])
    docs = [(d, f"{t} {passage}" if d % 3 == 0 else t) for d, t in docs] + [(1000, None), (1001, " \n"), (1002, docs[0][1].upper())]
    got = {r.doc_id: r.component_id for r in m.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = reached(docs)
    assert got == want and len(set(want.values())) < len(docs) - 40


def test_the_stage_drops_copies_of_similarity_0_8(spark, sf):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    copy = [w if i % 60 != 30 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    a, b = grams(" ".join(words)), grams(" ".join(copy))
    assert 0.8 <= len(a & b) / len(a | b) < 0.9
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == [1, 3]


def test_groups_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in m.near_copy_groups(docs).collect()}
    assert got == reached([tuple(r) for r in docs.collect()])
