"""Context-tree weighting against its definition, with dictionaries and plain recursion."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from undula.llm import context_tree, lm_score, textops
from undula.llm.shared import scratch


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower(text)).split(" ") if w]


def sequence(text):
    return list(lower(text).encode()) + [255]


class Tree:
    """Counts of every context and decision; Pw by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for text in texts:
            for nearest, symbol in self.places(text):
                for d in range(depth + 1):
                    for node, bit in self.decisions(symbol):
                        self.n[nearest[:d], node][bit] += 1
        self.longer = defaultdict(list)
        for context, node in self.n:
            if context:
                self.longer[context[:-1], node].append(context)
        self.memo = {}

    def places(self, text):
        past = [255] * self.depth
        for symbol in sequence(text):
            yield tuple(past[::-1][: self.depth]), symbol
            past.append(symbol)

    @staticmethod
    def decisions(symbol):
        for k in range(8):
            yield (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1

    def log_kt(self, key):
        a, b = self.n[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def log_pw(self, context, node):
        key = context, node
        if key not in self.memo:
            own = self.log_kt(key)
            if len(context) < self.depth:
                deeper = sum(self.log_pw(c, node) for c in self.longer[key])
                top = max(own, deeper)
                own = top + math.log(math.exp(own - top) / 2 + math.exp(deeper - top) / 2)
            self.memo[key] = own
        return self.memo[key]

    def log10(self, text):
        total = 0.0
        for nearest, symbol in self.places(text):
            for node, bit in self.decisions(symbol):
                p, mixed, left = 0.5, 0.0, 1.0
                for d in range(self.depth + 1):
                    key = nearest[:d], node
                    if key not in self.n:
                        break
                    own = (self.n[key][bit] + 0.5) / (sum(self.n[key]) + 1)
                    p = mixed + left * own
                    share = 1.0 if d == self.depth else math.exp(min(0.0, self.log_kt(key) - math.log(2) - self.log_pw(*key)))
                    mixed, left = mixed + left * share * own, left * (1 - share)
                total += math.log10(p)
        return total


def base(train, text):
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    own = [*words(text), None]
    return len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25))) for _ in range(40)]
    texts += ["", None, "A", "Ab  aB\n", "日本 語", "zzzz qqqq", texts[0], texts[0].upper(), "x" * 500, "\x00\x7f é"]
    return [*enumerate(texts), (3, "another text of id 3"), (None, "text without id")]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def check(spark, rows, partitions, **options):
    train = [t for i, t in rows if not held(i)]
    tree = Tree(train, options.get("depth", lm_score.DEPTH))
    want = sorted((i is None, i or 0, held(i), *base(train, t), tree.log10(t)) for i, t in rows)
    table = spark.createDataFrame(spark.sparkContext.parallelize([(t, i, "junk", 1) for i, t in rows], partitions), "text string, doc_id long, score string, `key` int")
    with scratch(spark):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score(spark, table, **options).collect())
    assert [r[:6] for r in got] == [r[:6] for r in want]
    np.testing.assert_allclose([r[6:] for r in got], [r[6:] for r in want], rtol=1e-9, atol=1e-9)
    assert any(r[2] for r in want) and any(not r[2] for r in want)


@pytest.mark.parametrize("partitions, options", [(1, {}), (7, {"frequent": 0, "words": 0}), (60, {"depth": 3, "frequent": 40, "words": 5})])
def test_scores(spark, rows, partitions, options):
    check(spark, rows, partitions, **options)


def test_every_row_twice(spark, rows):
    check(spark, rows + rows, 3)


def test_nothing_to_learn_from(spark):
    with scratch(spark):
        table = spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")
        got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score(spark, table).collect())
        assert got == [(1, 0, 0, 0.0, pytest.approx(-8 * math.log10(2))), (2, 0, 0, 0.0, pytest.approx(-24 * math.log10(2)))]
        assert lm_score.score(spark, table.limit(0)).count() == 0


def test_runs_in_small_batches_and_long_texts(spark, rows, monkeypatch):
    """Runs that cross batches, tallies that overflow, texts over the stretch of positions."""
    monkeypatch.setattr(context_tree, "STRETCH", 97)
    monkeypatch.setattr(lm_score, "ROWS", 50)
    monkeypatch.setattr(lm_score, "HELD", 64)
    buf = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len((t or "").encode()) for _, t in rows]))
    parts = list(context_tree.keys(buf, offsets, 3))
    key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    places = [c + (x,) for _, t in rows for c, x in Tree([], 3).places(t)]
    assert len(key) == len(places) == len(buf) + len(rows) and (np.bincount(row) == np.diff(offsets) + 1).all()
    small = [int.from_bytes(bytes(p), "big") for p in places]
    lowered = np.concatenate([k for k, _ in context_tree.keys(textops.LOWER[buf], offsets, 3)])
    assert lowered.tolist() == small
    whole = list(context_tree.keys(buf, offsets, 3))
    monkeypatch.setattr(context_tree, "STRETCH", 1 << 20)
    assert (np.concatenate([k for k, _ in whole]) == next(context_tree.keys(buf, offsets, 3))[0]).all()


def test_probabilities_sum_to_one():
    """Over the 256 bytes that may follow a context, seen or not."""
    rnd = np.random.default_rng(1)
    text = bytes(rnd.choice([97, 98, 99, 32], 400).tolist())
    key, _ = next(context_tree.keys(np.frombuffer(text, np.uint8), np.array([0, 400]), 4))
    key, n = context_tree.summed(key.astype(np.int64), np.ones(len(key), np.int64))
    for context in (key[0] >> 8, key[-1] >> 8, 0x6162637A, 0x7A616263, 0x61627A63):
        every = (int(context) << 8) + np.arange(256)
        both, count = context_tree.summed(np.concatenate([key, every]), np.concatenate([n, np.zeros(256, np.int64)]))
        parts = [context_tree.levels(both, count, 4, d)[0].shorter() for d in range(8)]
        mixture = context_tree.Mixture(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        p = 10 ** context_tree.log10_probabilities(both, count, 4, mixture)
        assert p[np.isin(both, every)].sum() == pytest.approx(1.0)


def test_counts_of_large_sequences():
    """The table and the series of log gamma meet."""
    for a, b in ((0, 0), (63, 1), (64, 64), (65, 0), (1000, 3), (10**9, 12)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        assert context_tree.log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(want, rel=1e-9, abs=1e-14 * (1 + a + b) * 30)
