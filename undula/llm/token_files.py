"""Token-id files: documents in ascending doc_id order, grammar-compressed by shard.

Documents are range-partitioned and sorted by doc_id.  A task encodes its range and writes one file of
shards; a shard has about SHARD ids, its Re-Pair rules, the expansion lengths of the nonterminals, the
symbols, and for each document its id, first symbol and first token.  The manifest names each file that
a finished attempt wrote, with its shards' places; first tokens of files are sums over the manifest,
one row for each task.

Any token is found without decoding what precedes it: the document index gives its symbols' range, and
expansion lengths the symbol that holds the token (`token_at`).

Defined cases: a null text is an empty one, which leaves the end id alone; further columns are
ignored; an empty table gives no files and an empty table.  Texts have any length.  doc_id must be unique (rows
that share one follow each other, in no set order); rows without one are left out.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh
from . import bytebpe, repair, textops
from .bpe import vocabulary
from .shared import kept, open_store

MAGIC = b"RPTOK01\n"
HEAD = struct.Struct("<8sIIQQ")  # magic, terminals, rules, symbols, documents
SHARD = 2 << 20
END_ID = 0
SLICE = 4 << 20
#: Distinct pretokens whose ids a worker keeps.
KEPT_WORDS, KEPT_BYTES = 400_000, 1 << 23


class Library:
    """The tokenizers library, asked once for each distinct pretoken."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        self.terminals = whole.get_vocab_size()
        self.special = whole.token_to_id(bytebpe.SPECIAL.decode())
        # the file's model alone: it gets pretokens, in its alphabet of bytes
        self.model, self.alphabet = Tokenizer(whole.model), np.array(list(map(ord, bytebpe.alphabet())), "<u4")
        self.lengths = np.zeros(self.terminals, np.int64)  # bytes of each id
        for piece, i in whole.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(piece)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size, self.count, self.bytes = [], 0, 0
        self.pool: list[np.ndarray] = []

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct pretokens, all of them in one call."""
        total = np.cumsum([len(w) for w in words])
        text, at = self.alphabet[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le"), [0, *total.tolist()]
        cut = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        ids = np.array(self.model.encode_batch_fast([cut], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        # no byte is lost, so the bytes of the ids tell where each word ends
        ends = np.cumsum(self.lengths[ids])
        last = np.searchsorted(ends, total)
        if not np.array_equal(ends[last], total):
            raise AssertionError("a pretoken's ids don't end where it does")
        sizes = np.diff(last, prepend=-1)
        if self.special is not None and bytebpe.SPECIAL in words:
            i = words.index(bytebpe.SPECIAL)
            ids[last[i]] = self.special
            ids, sizes[i] = np.delete(ids, np.arange(last[i] - sizes[i] + 1, last[i])), 1
        return ids, sizes

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) of a slice of documents."""
        starts, _, first = bytebpe.pretokens(buf, offsets)
        if len(self.known) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.clear()
        # pretokens follow each other without a gap; Arrow compares their bytes
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, *map(pa.py_buffer, (np.append(starts, len(buf)), np.ascontiguousarray(buf)))]).dictionary_encode()
        words, back = found.dictionary.to_pylist(), found.indices.to_numpy()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, sizes = self.ids_of(fresh)
            number[new] = self.count + np.arange(len(new))
            self.bytes += sum(map(len, fresh))
            self.known.update(zip(fresh, number[new].tolist(), strict=True))
            self.count += len(new)
            self.pool.append(ids)
            self.size.append(sizes)
        self.pool, self.size = [np.concatenate(self.pool)] if self.pool else [], [np.concatenate(self.size)] if self.size else []
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size = self.size[0]
        begin = np.cumsum(size) - size
        n = size[number][back]
        return self.pool[0][textops.spans(begin[number][back], n)], np.concatenate([[0], np.cumsum(n)])[first]


@cache
def library(path: str) -> Library:
    return Library(path)


def pack(doc_ids: np.ndarray, ids: np.ndarray, first: np.ndarray, terminals: int) -> bytes:
    """One shard."""
    seq, at, rules = repair.compress(ids, first, terminals)
    lengths = repair.expansions(rules, terminals)[terminals:]
    wide = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
    index = np.stack([doc_ids, at[:-1], first[:-1] - first[0]], 1).astype("<i8")
    tail = np.array([at[-1], first[-1] - first[0], int(wide == "<u4")], "<i8")
    return HEAD.pack(MAGIC, terminals, len(rules), len(seq), len(doc_ids)) + tail.tobytes() + index.tobytes() + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + seq.astype(wide).tobytes()


class Shard:
    """A shard as read: its document index, rules, expansion lengths and symbols."""

    def __init__(self, raw: bytes):
        magic, self.terminals, rules, symbols, docs = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        last_symbol, last_token, wide = np.frombuffer(raw, "<i8", 3, at).tolist()
        at += 24
        index = np.frombuffer(raw, "<i8", 3 * docs, at).reshape(-1, 3)
        at += 24 * docs
        self.doc_ids = index[:, 0]
        self.symbol, self.token = np.append(index[:, 1], last_symbol), np.append(index[:, 2], last_token)
        self.rules = np.frombuffer(raw, "<u4", 2 * rules, at).reshape(-1, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(raw, "<u4", rules, at)
        at += 4 * rules
        self.seq = np.frombuffer(raw, "<u4" if wide else "<u2", symbols, at)

    def document(self, i: int) -> np.ndarray:
        return repair.expand(self.seq[self.symbol[i] : self.symbol[i + 1]], self.rules, self.terminals, self.lengths)

    def token_at(self, i: int, k: int) -> int:
        """Token k of document i: only the symbol that holds it is expanded."""
        seq = self.seq[self.symbol[i] : self.symbol[i + 1]].astype(np.int64)
        size = np.where(seq < self.terminals, 1, self.lengths[np.maximum(seq - self.terminals, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        s = int(np.searchsorted(ends, k, "right"))
        return int(repair.expand(seq[s : s + 1], self.rules, self.terminals, self.lengths)[k - (ends[s] - size[s])])


def write(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files; the manifest, rows (file, first_doc, tokens, places)."""
    path = path or vocabulary()
    folder = fresh(spark, "tokens")
    ordered = docs.where("doc_id is not null").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(path)
        out = name = first_doc = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        places, size, tokens = [], 0, 0

        def flush() -> None:
            nonlocal size, tokens
            docs_, ids, lens = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            raw = pack(docs_, ids, np.concatenate([[0], np.cumsum(lens)]), encoder.terminals)
            out.write(raw)
            places.append({"start": size, "size": len(raw), "before": tokens})
            size += len(raw)
            tokens += len(ids)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in textops.slices(batch.column(1), SLICE):
                if out is None:
                    first_doc, name = int(keys[0]), f"{folder}/{uuid.uuid4().hex}.tokens"
                    store, at = open_store(name)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at)
                ids, first = encoder.encode(buf, offsets)
                held.append((keys[lo:hi], np.insert(ids, first[1:], END_ID), np.diff(first) + 1))
                if sum(len(x[1]) for x in held) >= SHARD:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first_doc], pa.int64()), pa.array([tokens], pa.int64()), pa.array([places], pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("before", pa.int64())])))], names=["file", "first_doc", "tokens", "places"])

    return kept(spark, ordered.mapInArrow(textops.tidied(work), "file string, first_doc long, tokens long, places array<struct<start: long, size: long, before: long>>"), "manifest")


def shards(manifest: DataFrame) -> DataFrame:
    """Rows (file, start, size, base): every shard and the tokens before it."""
    # one row for each writing task, so this window is small
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("first_doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = manifest.withColumn("base", before).select("file", "base", F.explode("places").alias("p"))
    return based.select("file", F.col("p.start").alias("start"), F.col("p.size").alias("size"), (F.col("base") + F.col("p.before")).alias("base"))


def read(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), decoded from the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                store, at = open_store(file)
                with store.open_input_file(at) as f:
                    shard = Shard(f.read_at(size, start))
                ids = repair.expand(shard.seq, shard.rules, shard.terminals, shard.lengths).astype("<u4").tobytes()
                n = np.diff(shard.token)
                crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(shard.token[:-1], shard.token[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids), pa.array(base + shard.token[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # an explicit number of partitions: rows are few and small, what they name is not
    at_once = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards(manifest).repartition(at_once, "file", "start").mapInArrow(textops.tidied(work), "doc_id long, start long, n_tokens long, ids_crc32 long")
