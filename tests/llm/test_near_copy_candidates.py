"""Where the candidates of the pipeline's near copies come from, and how many there are."""

from __future__ import annotations

import random

import numpy as np

from splitproof.llm import near_copies as m


def changed(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**9)}"
    return out


def test_parities_differ_in_no_more_cells_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    for n, more in ((0, 1), (3, 0), (100, 40), (127, 2), (500, 130), (3000, 9000)):
        every = np.unique(rng.integers(0, 2**63, n + more, np.int64).view(np.uint64))
        x, y = rng.permutation(every)[:n], rng.permutation(every)
        apart = len(np.setxor1d(x, y))
        assert m._apart(m._parity(x), m._parity(y)) <= apart and m._apart(m._parity(y), m._parity(x)) <= apart
        assert m._apart(m._parity(x), m._parity(x)) == 0


def test_the_multi_index_links_without_the_prefixes(spark, monkeypatch):
    rng, docs = random.Random(3), []
    while len(docs) < 8:
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts = " ".join(words), " ".join(changed(words, rng, 1))
        bits = [m._simhash(m.shingles(t)) for t in texts]
        if 0 < ((bits[0] ^ bits[1]) & (2**64 - 1)).bit_count() <= 3:
            docs += [(len(docs), texts[0]), (len(docs) + 1, texts[1])]
    monkeypatch.setattr(m, "_prefix", lambda x, frequent, counts: x[:0])
    got = {r.doc_id: r.component_id for r in m.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(8)}


def test_a_family_that_is_not_alike_gives_few_candidates(spark, monkeypatch):
    rng, asked, verified = random.Random(4), [], m._verified
    words = [f"w{i}" for i in range(600)]
    docs = [(i, " ".join(changed(words, rng, 10))) for i in range(30)]
    sets = [m.shingles(t) for _, t in docs]
    assert not any(m.alike(x, y) for i, x in enumerate(sets) for y in sets[:i])

    def seen(pairs, nodes, docs):
        asked.append(pairs.distinct().count())
        return verified(pairs, nodes, docs)

    monkeypatch.setattr(m, "_verified", seen)
    assert m.near_copy_groups(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id <> component_id").count() == 0
    assert len(asked) == 2 and asked[1] <= 20  # of 435 pairs
