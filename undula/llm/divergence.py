"""How the sources of a language differ: exact divergences by joint count histograms.

Terms are runs of letters (`[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased).  A language keeps the
V terms that at least `least` of its documents hold.  A group (lang, source), and each language, gives a
kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N the sum of its counts.  f(p, q) =
floor((p - q)^2 / q) is a term's part in the divergence of p from q.

1. tasks count words of whole texts by slice (n occurrences, in how many documents); Spark sums them by
   (lang, source, term), then gathers a term's sources, which gives one vector of counts for each term;
2. terms with equal vectors become one row with a multiplicity.  Each pair of sources in a vector is a
   combination (count, count), tallied in the task before the exchange;
3. the cells with a zero follow from the margins: a combination (a, b) that m terms have takes m from
   (a, 0) and (0, b) and gives m back to (0, 0), which starts with all V terms; one aggregate by
   (pair, count, count) sums it all, and f is evaluated once for each combination, times its multiplicity.

No term is compared with another one, and the exchanges carry counts by term and combinations by pair.
A pair is one row of the result, so what grows with the square of the sources is the result itself.

Defined cases: null text, lang and source read as ''; a group whose texts hold no term takes part with
counts of zero; a language that keeps no term has pairs of value 0 and no terms; rows that repeat count
each time; terms of any length count whole; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .shared import kept

#: In how many documents of its language a kept term is at least; ranks of terms to report.
LEAST, RANKS = 3, 200
SLICE = 1 << 22
#: Pairs of counts that a task tallies at once.
PAIRS = 1 << 21

#: Bytes of a term: letters and all that isn't ASCII.
LETTER = textops.ALNUM_WORD.copy()
LETTER[0x30:0x3A] = False


def group_columns(docs: DataFrame) -> DataFrame:
    """(lang, source, text) of rows, nulls as ''."""
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) of group_columns rows: occurrences, and documents with the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textops.slices(batch.column(2), SLICE):
                starts, ends, first = textops.words(buf, offsets, LETTER)
                if not len(starts):
                    continue
                small = textops.LOWER[buf]
                at, which = textops.distinct_words(small, starts, ends)
                number: dict[tuple[str, str], int] = {}
                group = np.array([number.setdefault(own, len(number)) for own in zip(*(batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 1)), strict=True)])
                row_of = np.unique(group, return_index=True)[1]
                # once for each (document, term) with its occurrences, then for each (group, term)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                both, n = np.unique(row * len(at) + which, return_counts=True)
                key = group[both // len(at)] * len(at) + both % len(at)
                order = np.argsort(key, kind="stable")
                key = key[order]
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                total = np.add.reduceat(n[order], begin)
                documents = np.diff(np.append(begin, len(key)))
                raw = small.tobytes()
                words = pa.array([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
                rows = pa.array(lo + row_of[key[begin] // len(at)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), words.take(pa.array(key[begin] % len(at))), pa.array(total.astype(np.int64)), pa.array(documents.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    rows = docs.mapInArrow(textops.tidied(count), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (lang, term, total, counts): the terms that a language keeps, with their sources in order."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.where(F.col("docs") >= least).select("lang", "term", "total", "counts")


def weight(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; exact beyond 64 bits as well."""
    wide = F.expr("1000000000BD") * (count + 1).cast("decimal(20,0)")
    small = F.call_function("div", F.lit(1_000_000_000) * (count + 1), total + terms)
    return F.lit(1) + F.when(count < 9_000_000_000, small).otherwise(F.floor(wide / (total + terms).cast("decimal(20,0)")).cast("long"))


def part(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _tallied(vectors: DataFrame) -> DataFrame:
    """Rows (lang, a, b, x, y, m): of vectors (lang, counts, m), combinations of positive counts of sources
    a < b, summed within a task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        number: dict[str, int] = {}
        held: list[np.ndarray] = []  # rows lang, a, b, x, y, m

        def coded(column: pa.Array) -> np.ndarray:
            own = pc.unique(column).to_pylist()
            for v in own:
                if v not in number:
                    number[v] = len(names)
                    names.append(v)
            table = np.array([number[v] for v in own], np.int64)
            return table[pc.index_in(column, pa.array(own, pa.string())).to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held, 1)
            held.clear()
            order = np.lexsort(rows[:5])
            rows = rows[:, order]
            begin = np.flatnonzero(np.append(True, (rows[:5, 1:] != rows[:5, :-1]).any(0)))
            m = np.add.reduceat(rows[5], begin)
            rows = rows[:, begin]
            text = pa.array(names, pa.string())
            return pa.RecordBatch.from_arrays([*(text.take(pa.array(rows[k])) for k in range(3)), pa.array(rows[3]), pa.array(rows[4]), pa.array(m)], names=["lang", "a", "b", "x", "y", "m"])

        for batch in batches:
            lists = batch.column(1)
            lang, m = coded(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            flat = lists.flatten()
            source, n = coded(flat.field(0)), flat.field(1).to_numpy(zero_copy_only=False)
            for k in np.unique(size[size > 1]).tolist():
                rows = np.flatnonzero(size == k)
                # a row's pairs in stretches, rows in stretches, so that PAIRS pairs are held at most
                one, two = np.triu_indices(k, 1)
                for lo in range(0, len(one), PAIRS):
                    i, j = one[lo : lo + PAIRS], two[lo : lo + PAIRS]
                    step = max(1, PAIRS // len(i))
                    for r in range(0, len(rows), step):
                        own = rows[r : r + step]
                        s, t = first[own][:, None] + i, first[own][:, None] + j
                        held.append(np.stack([np.repeat(lang[own], len(i)), source[s].ravel(), source[t].ravel(), n[s].ravel(), n[t].ravel(), np.repeat(m[own], len(i))]))
                        if sum(x.shape[1] for x in held) >= PAIRS:
                            yield flush()
        if held:
            yield flush()

    return vectors.mapInArrow(textops.tidied(tally), "lang string, a string, b string, x long, y long, m long")


def divergences(spark: SparkSession, docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): `pair`, the divergence of a group from each other source
    of its language, and `term`, the terms that stand out most in a group."""
    docs = group_columns(docs)
    terms = kept(spark, kept_terms(term_counts(docs), least), "terms", stays=True)
    flat = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = flat.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("held"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0)
    groups = kept(spark, groups, "groups", stays=True)

    # cells of pairs a < b: combinations of positive counts, what they leave of the margins, and all V terms
    one = groups.select("lang", "v", F.col("source").alias("a"), F.col("group_n").alias("n_a"), F.col("held").alias("held_a"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("group_n").alias("n_b"), F.col("held").alias("held_b"))
    pairs = one.join(two, "lang").where("a < b")
    vectors = terms.groupBy("lang", "counts").agg(F.count("*").alias("m"))
    cell = lambda x, y, m: F.struct(F.lit(x).cast("long").alias("x") if isinstance(x, int) else x.alias("x"), F.lit(y).cast("long").alias("y") if isinstance(y, int) else y.alias("y"), m.alias("m"))
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    joint = _tallied(vectors).select("lang", "a", "b", F.explode(F.array(cell(x, y, m), cell(x, 0, -m), cell(0, y, -m), cell(0, 0, m))).alias("c"))
    margin = flat.groupBy("lang", "source", F.col("n").alias("x")).agg(F.count("*").alias("m"))
    left = pairs.select("lang", "a", "b").join(margin.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", cell(x, 0, m).alias("c"))
    right = pairs.select("lang", "a", "b").join(margin.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", cell(0, x, m).alias("c"))
    rest = pairs.select("lang", "a", "b", cell(0, 0, F.col("v") - F.col("held_a") - F.col("held_b")).alias("c"))
    cells = joint.unionByName(left).unionByName(right).unionByName(rest).groupBy("lang", "a", "b", "c.x", "c.y").agg(F.sum("c.m").alias("m"))

    p, q = weight(x, F.col("n_a"), F.col("v")), weight(y, F.col("n_b"), F.col("v"))
    valued = cells.where("m <> 0").join(pairs, ["lang", "a", "b"]).select("lang", "a", "b", "m", p.alias("p"), q.alias("q"))
    value = valued.groupBy("lang", "a", "b").agg(F.sum(part(F.col("p"), F.col("q")) * F.col("m")).alias("there"), F.sum(part(F.col("q"), F.col("p")) * F.col("m")).alias("back"))
    both = pairs.select("lang", "a", "b").join(value, ["lang", "a", "b"], "left").na.fill(0)
    by_pair = both.selectExpr("lang", "stack(2, a, b, there, b, a, back) as (source, item, value)").withColumn("part", F.lit("pair"))

    p, q = weight(F.col("n"), F.col("group_n"), F.col("v")), weight(F.col("total"), F.col("lang_n"), F.col("v"))
    by_term = flat.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    by_term = by_term.select("lang", "source", "item", part(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    best = ranked(by_term).where(F.col("rank") <= ranks)  # tasks keep `ranks` of a group before the exchange
    return ranked(by_pair).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
