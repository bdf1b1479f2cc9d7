"""Block-Max WAND against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from undula.llm import blockmax, ranked_search
from undula.llm.shared import scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the definition; documents without id come last among equals."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, bag in bags:
            score = 0
            for w, times in asked.items():
                if tf := bag[w]:
                    m = 75 + 25 * sum(bag.values()) * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, partitions=3, k=20):
    table = spark.createDataFrame(spark.sparkContext.parallelize([(t, i, 1.5, "q") for i, t in docs], partitions), "text string, doc_id long, score double, query string")
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, terms int")
    with scratch(spark):
        found = ranked_search.search(spark, ranked_search.build(spark, table), asked, k)
        assert [f"{a} {b}" for a, b in found.dtypes] == ["item_id bigint", "rank int", "doc_id bigint", "score bigint"]
        return sorted(map(tuple, found.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    pick = lambda n: " ".join(vocab[min(int(rnd.paretovariate(0.6)) - 1, 399)] for _ in range(n))
    docs = [(i, pick(rnd.choice([1, 3, 20, 80, 300]))) for i in range(700)]
    docs += [(700, None), (701, ""), (702, " -- !"), (703, "w3," * 5000), (None, "w1 w2 w3 w390"), (705, docs[5][1]), (5, docs[5][1]), (6, "other w7é")]
    items = [(k, pick(rnd.choice([1, 2, 5, 30]))) for k in range(25)] + [(90, None), (91, "?"), (92, "nowhere"), (93, "w3 w3 W3 w390"), (93, "w390"), (94, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_search(spark, corpus, partitions):
    docs, items = corpus
    assert searched(spark, docs, items, partitions) == ranked(docs, items)


def test_small_shards_bundles_and_strides(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(ranked_search, "SHARD", 5000)
    monkeypatch.setattr(ranked_search, "BUNDLE", 40)
    assert searched(spark, docs, items, 2, 3) == ranked(docs, items, 3)


def test_every_row_twice_and_empty_tables(spark, corpus):
    docs, items = corpus
    assert searched(spark, docs[:60] * 2, items[:4], 5) == ranked(docs[:60] * 2, items[:4])
    assert searched(spark, docs[:10], []) == [] == searched(spark, [], items) == searched(spark, [(1, None), (2, "..")], items)


def shard_of(docs, total=None):
    bags = [Counter(terms(t)) for t in docs]
    names = sorted({w for b in bags for w in b})
    rows = [(names.index(w), d, n) for d, b in enumerate(bags) for w, n in b.items()]
    term, doc, tf = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    m = np.array([75 + sum(b.values()) for b in bags])
    raw = blockmax.encode(np.arange(len(docs)), np.zeros(len(docs), bool), m, term.astype(np.uint64), doc, tf)
    return names, bags, m, blockmax.Shard(raw)


def test_blocks_round_trip(corpus):
    names, bags, m, shard = shard_of([t for _, t in corpus[0]])
    shard.decompress(np.arange(len(shard.last)))
    for t, name in enumerate(names):
        a, b = shard.posting[shard.block[t]], shard.posting[shard.block[t + 1]]
        want = [(d, bag[name]) for d, bag in enumerate(bags) if name in bag]
        assert shard.doc[a:b].tolist() == [d for d, _ in want] and shard.df[t] == len(want)
        assert shard.impact[a:b].tolist() == [1000000000 * tf // (1000 * tf + 12 * int(m[d])) for d, tf in want]
        for block in range(shard.block[t], shard.block[t + 1]):
            a, b = shard.posting[block], shard.posting[block + 1]
            assert shard.peak[block] == shard.impact[a:b].max() and shard.last[block] == shard.doc[b - 1]


def test_blocks_below_the_threshold_stay_compressed(monkeypatch):
    """Long runs of documents that can't reach the best ones are passed over without decompression."""
    monkeypatch.setattr(blockmax, "STRIDE", 4)
    docs = ["common " + "filler " * 200] * 20000 + ["common rare " * 3] * 30 + ["common " + "filler " * 200] * 20000
    names, _, _, shard = shard_of(docs)
    doc, score = shard.search(np.array([names.index("common"), names.index("rare")], np.uint64), np.array([10, 900]), 20)
    assert sorted(doc.tolist()) == list(range(20000, 20030)) and len(set(score.tolist())) == 1
    t = names.index("common")
    assert shard.ready[shard.block[t] : shard.block[t + 1]].mean() < 0.05
