"""Secret scanning with a random forest that removes false positives.

Words of any length are cut at quotes, = : , ; & and where other than ASCII characters begin; every piece
of LEAST characters or more is a candidate (keys, hashes, addresses, numbers, plain words alike), and so
is a web address up to its parameters, and a whole word that holds : , ; but no quote, = or &.  Its
features are the value's length and character classes, character transitions under a bigram model of
the corpus's words, the share of it that dictionary words cover, where it was found (the path), and the
words around it: two before and one after, within 80 characters.  A random forest trained by Spark on
labelled findings scores each candidate; those under the threshold are dropped as false positives.

Labelled findings are any table (features, label).  Without one they are candidates of documents made by
rule (made_findings.py), which know their own secrets and hold hard negatives; no form or name test makes a
label.  Word counts are exact and the forest learns from rows in a set order, so scores don't depend on
how rows are partitioned.

Defined cases: null and empty texts have no candidates; words of any length are cut and measured whole;
a null path, or a table without that column, counts as an empty one; a score equal to the threshold is
kept; rows that share a doc_id are scanned each; if the labelled findings hold one label only, that label
decides; of overlapping secrets the text from the first start to the last end is replaced by one mark;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import made_findings, textops
from .shared import kept, scratch, unused

LEAST = 12
#: Labelled findings for training: about so many at most.
SAMPLE = 20_000
#: A dictionary word is one letter run in so many, and comes twice at least.
RARE = 100_000
#: Distinct words a task counts before it hands them on.
WORDS = 1 << 17
CANDIDATE = "doc_id long, path string, start long, end long, value string, before string, after string, features array<double>"

# Names that credentials are assigned to.
CREDENTIALS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "bearer")
# Names of what looks like a key and is none.
HARMLESS = ("checksum", "sha", "md5", "commit", "etag", "digest", "revision", "uuid", "hash", "build", "image", "_id", "base64", " id")
# Endings of files that settings stand in.
SETTINGS = ("env", "yml", "yaml", "json", "conf", "ini", "toml", "tf", "properties")

_QUOTES, _ENDS = "\"'`", ")]}>,;.:!?#$%&*"
_PIECE = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://[^\x00-\x20\x7f-\xff"'`=,;&?#]+|[^\x00-\x20\x7f-\xff"'`=:,;&]+(?:={1,2}(?=$|["'`:,;&)\]}>]|[^\x21-\x7e]))?""")
_WHOLE = re.compile(r"[!-~]+")
_NAME = re.compile(r"([A-Za-z][\w.\-]{0,40})[\"'`]*(=|:=|:)[\"'`(\[{<]*$", re.ASCII)


def word_counts(spark: SparkSession, docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(dictionary words, 27 x 27 counts of neighbouring characters) of the letter runs of all texts."""
    letter = np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            # pairs as rows without a word
            pairs = np.zeros(27 * 27, np.int64)
            if total:
                code = np.frombuffer("".join(f" {w} " for w in total).encode("utf-32-le"), np.uint32).astype(np.int64)
                at = np.where((code >= 97) & (code <= 122), code - 96, 0)
                lens = np.array([len(w) + 1 for w in total])
                left = textops.spans(np.cumsum(lens + 1) - (lens + 1), lens)
                np.add.at(pairs, at[left] * 27 + at[left + 1], np.repeat(np.array(list(total.values()), np.int64), lens))
            known = {w: n for w, n in total.items() if 3 <= len(w) <= 16}
            words = [None] * len(pairs) + list(known)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*range(len(pairs)), *[-1] * len(known)], pa.int32()), pa.array([*pairs.tolist(), *known.values()], pa.int64())], names=["word", "pair", "n"])

        for batch in batches:
            for _, _, buf, offsets in textops.slices(batch.column(0)):
                starts, ends, _ = textops.words(buf, offsets, letter)
                _, at, times = np.unique(textops.hashes(buf, starts, ends), return_index=True, return_counts=True)
                raw = buf.tobytes()
                for a, b, n in zip(starts[at].tolist(), ends[at].tolist(), times.tolist(), strict=True):
                    w = raw[a:b].decode("utf-8", "replace").lower()
                    if w.isalpha():
                        total[w] += n
                if len(total) > WORDS:
                    yield hand_on()
                    total.clear()
        yield hand_on()

    counted = docs.select("text").mapInArrow(textops.tidied(count), "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    counted = kept(spark, counted, "words")
    pairs = np.zeros(27 * 27, np.int64)
    for r in counted.where("word is null").collect():  # 729 rows
        pairs[r.pair] = r.n
    pairs = pairs.reshape(27, 27)
    # a count of all runs that no order of the rows changes
    runs = counted.where("word is not null").agg(F.sum("n")).first()[0] or 0
    # at most RARE words are so frequent
    words = [r.word for r in counted.where(F.col("word").isNotNull() & (F.col("n") >= max(2, -(-runs // RARE)))).select("word").collect()]
    return sorted(words), pairs


class Measures:
    """Features of candidates: small tables of the corpus's words."""

    def __init__(self, words: list[str], pairs: np.ndarray):
        self.shapes: dict[str, list[float]] = {}
        self.dictionary = set(words)
        self.pairs = np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True))

    def coverage(self, low: str) -> float:
        """Share of characters that dictionary words cover, longest first from the left."""
        i = covered = 0
        while i < len(low):
            for k in range(min(16, len(low) - i), 2, -1):
                if low[i : i + k] in self.dictionary:
                    covered += k
                    i += k
                    break
            else:
                i += 1
        return covered / max(1, len(low))

    def shape(self, value: str) -> list[float]:
        """Features of the value itself; words come again and again."""
        got = self.shapes.get(value)
        if got is None:
            got = self._shape(value)
            if len(value) <= 64 and len(self.shapes) < 50_000:
                self.shapes[value] = got
        return got

    def _shape(self, value: str) -> list[float]:
        n, low = max(1, len(value)), value.lower()
        kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
        count = {c: value.count(c) for c in set(value)}
        at = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in low]
        return [
            float(len(value)),
            kind.count("d") / n, kind.count("u") / n, kind.count("l") / n, kind.count("s") / n,
            sum(a != b for a, b in zip(kind[:-1], kind[1:], strict=True)) / n,
            sum(c in "0123456789abcdef" for c in low) / n,
            -sum(k / n * log2(k / n) for k in count.values()),
            len(count) / n,
            float(np.mean(self.pairs[at[:-1], at[1:]])) if len(at) > 1 else 0.0,
            self.coverage(low),
        ]

    def features(self, value: str, name: str, before: str, after: str, path: str) -> list[float]:
        near = f" {before} {name}".lower()
        ending = path.rpartition(".")[2].lower() if "." in path else ""
        return [
            *self.shape(value),
            float(any(x in near for x in CREDENTIALS)), float(any(x in near for x in HARMLESS)), float(bool(name) or near.endswith(("=", ":"))),
            float(len(before)), float(len(after)), float(sum(c.isdigit() for c in before + after)),
            float(path.count("/")), float(bool(ending)), float(ending in SETTINGS),
        ]


def _text(raw: np.ndarray) -> str:
    return raw.tobytes().decode("utf-8", "replace")


def pieces(raw: str) -> list[tuple[int, int]]:
    """Places of the values in a word, one character a byte."""
    found = [m.span() for m in _PIECE.finditer(raw)]
    if not any(c in raw for c in "\"'`=&"):
        found += [m.span() for m in _WHOLE.finditer(raw)]
    out = set()
    for a, b in found:
        a += len(raw[a:b]) - len(raw[a:b].lstrip("([{<,;:"))
        b = a + len(raw[a:b].rstrip(_ENDS))
        if b - a >= LEAST:
            out.add((a, b))
    return sorted(out)


def measured(spark: SparkSession, docs: DataFrame):
    """The corpus's word tables, as a broadcast: at most RARE words and 729 counts."""
    with scratch(spark):
        return spark.sparkContext.broadcast(Measures(*word_counts(spark, docs)))


def candidates(spark: SparkSession, docs: DataFrame, path: str = "source", shared=None) -> DataFrame:
    """Rows of CANDIDATE; start and end are places in the UTF-8 text.  Measures are those of docs, if
    not given."""
    shared = shared or measured(spark, docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = shared.value
        for batch in batches:
            ids, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, _, buf, offsets in textops.slices(batch.column(2)):
                starts, ends, first = textops.words(buf, offsets)
                long = np.flatnonzero(ends - starts >= LEAST)
                rows = np.searchsorted(first, long, "right") - 1
                out: list[tuple] = []
                for w, r in zip(long.tolist(), rows.tolist(), strict=True):
                    raw = buf[starts[w] : ends[w]].tobytes().decode("latin-1")
                    spans = pieces(raw)
                    if not spans:
                        continue
                    begin = max(first[r], w - 2)
                    before = _text(buf[max(starts[begin], ends[w - 1] - 320) : ends[w - 1]])[-80:] if w > begin else ""
                    after = _text(buf[starts[w + 1] : min(ends[w + 1], starts[w + 1] + 320)])[:80] if w + 1 < first[r + 1] else ""
                    at, place = int(starts[w] - offsets[r]), paths[lo + r] or ""
                    for a, b in spans:
                        m = _NAME.search(raw[max(0, a - 64) : a])
                        name, sign, value = m[1] if m else "", m[2] if m else "", raw[a:b]
                        out.append((ids[lo + r], place, at + a, at + b, value, f"{before} {name}{sign}".strip(), after, measures.features(value, name, before, after, place)))
                if out:
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "path", "start", "end", "value", "before", "after", "features"])
        measures.shapes.clear()  # workers outlive tasks

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    return docs.select("doc_id", where.alias("path"), "text").mapInArrow(textops.tidied(work), CANDIDATE)


def labelled_findings(spark: SparkSession, shared) -> DataFrame:
    """Candidates of the documents made by rule, with label 1 where the value is a secret of its document;
    those that only share text with one have no label."""
    made = kept(spark, made_findings.documents(spark), "made")
    found = candidates(spark, made, "path", shared).join(made.select("doc_id", "secrets"), "doc_id")
    label = F.expr("case when array_contains(secrets, value) then 1 when not exists(secrets, s -> contains(s, value) or contains(value, s)) then 0 end")
    return found.withColumn("label", label).drop("secrets")


def train(labelled: DataFrame, seed: int = 5):
    """A forest from labelled findings (features, label); None if they hold fewer than two labels,
    with the label that there is.  Each label has its part of at most SAMPLE rows, chosen by hash."""
    labelled = labelled.where("label is not null")
    labels = sorted(r.label for r in labelled.select("label").distinct().collect())
    if len(labels) < 2:
        return None, float(next(iter(labels), 0))
    keys = [c for c in ("value", "doc_id", "start") if c in labelled.columns]
    parts = [labelled.where(F.col("label") == y).orderBy(F.xxhash64(*keys, "features"), "features").limit(SAMPLE // len(labels)).select("label", "features") for y in labels]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.union(part)
    # bounded by SAMPLE: one partition, in a set order, or the forest would depend on the partitioning
    ordered = sample.coalesce(1).sortWithinPartitions("label", "features")
    forest = RandomForestClassifier(numTrees=32, maxDepth=8, seed=seed, featuresCol="vector", labelCol="y")
    return forest.fit(ordered.select(F.col("label").cast("double").alias("y"), array_to_vector("features").alias("vector"))), 0.0


def findings(spark: SparkSession, docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """All candidates with their score and whether they are kept: (doc_id, path, start, end, value,
    before, after, score, is_secret)."""
    shared = measured(spark, docs)
    with scratch(spark):
        known = kept(spark, labelled_findings(spark, shared), "labelled") if labelled is None else labelled
        model, only = train(known)
    found = candidates(spark, docs, path, shared)
    if model is None:
        scored = found.withColumn("score", F.lit(only))
    else:
        # the forest is small and is part of the plan's transformer
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "path", "start", "end", "value", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, secrets: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret (doc_id, start, end) in its text replaced by mark; all columns stay."""
    own = unused(docs, "_spans")
    spans = secrets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(own))
    schema = docs.select("doc_id", *[c for c in docs.columns if c != "doc_id"]).schema
    text = schema.fieldNames().index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(schema))
            column = batch.column(text)
            if spans.null_count < len(batch):
                out = []
                for value, own in zip(column, spans, strict=True):
                    raw = value.as_py()
                    if own.is_valid and raw is not None:
                        raw, done, parts = raw.encode(), 0, []
                        for s in own.as_py():
                            if s["start"] >= done:
                                parts += [raw[done : s["start"]], mark.encode()]
                            done = max(done, s["end"])
                        raw = b"".join([*parts, raw[done:]]).decode("utf-8", "replace")
                    out.append(raw)
                column = pa.array(out, column.type)
            columns = [column if i == text else batch.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.join(spans, "doc_id", "left").select(*schema.fieldNames(), own).mapInArrow(textops.tidied(work), schema).select(*docs.columns)
