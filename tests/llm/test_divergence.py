"""Divergences of sources against their definition, term by term."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.llm import divergence
from undula.llm.shared import scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least=3, ranks=200):
    """rows (text, lang, source)."""
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        holds, total, of = Counter(), Counter(), defaultdict(Counter)
        for own, source, words in docs:
            if own == lang:
                holds.update(set(words))
                total.update(words)
                of[source].update(words)
        kept = sorted(w for w in holds if holds[w] >= least)
        p_of = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // q
        q, p = p_of(total), {s: p_of(c) for s, c in of.items()}
        for s in of:
            best = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in of if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(best, 1)]
            best = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if of[s][w] and p[s][w] > q[w])
            out += [(lang, s, "term", w, -v, r) for r, (v, _, w) in enumerate(best[:ranks], 1)]
    return sorted(out)


def found(spark, rows, partitions=3, **options):
    table = spark.createDataFrame(spark.sparkContext.parallelize([(k, *r, "x") for k, r in enumerate(rows)], partitions), "doc_id long, text string, lang string, source string, term string")
    with scratch(spark):
        got = divergence.divergences(spark, table, **options)
        assert [f"{a} {b}" for a, b in got.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
        return sorted(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("abcdéß") for _ in range(rnd.randint(1, 4))) for _ in range(150)]
    out = []
    for k in range(160):
        lang = "en" if k % 3 else rnd.choice(["de", "fr"])
        words = [vocab[min(int(rnd.paretovariate(0.8)) - 1, 149)] for _ in range(rnd.randint(0, 60))]
        out.append((" ".join(words).title() if k % 5 == 0 else "1".join(words), lang, f"s{rnd.randint(0, 9)}"))
    out += [(None, "en", "s0"), ("", None, None), ("a b", "", "only"), ("12 34", "en", "no terms"), (None, "xx", "one"), ("rare words", "xx", "two"), ("ab " * 4000, "en", "s1"), ("é" * 3000, "en", "s2")]
    return out + [out[3]] * 40


@pytest.mark.parametrize("partitions", [1, 50])
def test_divergences(spark, rows, partitions):
    assert found(spark, rows, partitions) == expected(rows)


def test_every_row_twice_few_ranks_and_none(spark, rows):
    assert found(spark, rows + rows, 4, least=5, ranks=7) == expected(rows + rows, 5, 7)
    assert found(spark, []) == []


def test_tallies_in_small_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence, "SLICE", 100)
    assert found(spark, rows[:80]) == expected(rows[:80])


def test_weights_beyond_64_bits(spark):
    """Counts that no small table has: p is exact where the product leaves 64 bits."""
    cases = [(0, 5, 3), (8_999_999_999, 10**12, 10**6), (9_000_000_000, 10**12, 10**6), (10**13, 10**13 + 5, 7), (10**14, 10**17, 10**9)]
    table = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r.p for r in table.select(divergence.weight(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]
    assert np.all(np.array(got) > 0)
