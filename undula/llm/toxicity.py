"""Toxicity scores of texts after noisy-channel deobfuscation.

Obfuscated tokens (digits and signs for letters, repeated letters, letters apart by spaces or points)
become a lattice: each observed character may stand for itself, for the letters it imitates, for any
letter if it is a mask, or for nothing where it repeats the one before or separates letters.  Viterbi
decoding under a character trigram model picks the restored word.  Words that show no such sign stay
as they are.  Runs of spaced letters, and words with signs or unseen characters between letters, are decoded
further: each gap is closed or ends a word.  What comes of that, the words and the whole without gaps, is
added, and so is a word with the one look-alike that stands at an edge of it, where it may be punctuation
as well.  Runs and words may have any length.

Each distinct restored word of a document gives hashed features (the word, and its first four, five
and six characters); an L1 logistic regression trained by Spark on labelled rows scores a document by the sum
of their weights.

The character model counts the words of every whole text.  The regression reads a bounded sample of
labelled rows (SAMPLE, chosen by hash over all of them); scoring reads every whole text.

Defined cases: null and empty texts have no features and get the score of the intercept; texts of any
length are scored whole; null labels aren't used; a document with several labels teaches each of them;
rows that share a doc_id are scored each; if the training rows hold one label only, every score is that label's share; further
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import bounded_batches, kept, scratch

FEATURE_BITS = 18
PREFIXES = (4, 5, 6)
#: Labelled rows for the regression: about so many at most.
SAMPLE = 20_000
#: Distinct words a task counts before it hands on their trigrams.
WORDS = 1 << 17
#: Bytes of text whose features are made at once: dozens of arrays are as long.
SLICE = 1 << 18
THRESHOLD = 0.3

# Letters that other characters imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
MASKS = "*#%_"
APART = " .-_*|/"
#: What parts letters within a word: signs that stand for no letter, and characters that aren't seen.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
PARTS = ".-/,:;~=&^`\"<>[]{}\\?)"
GAP = re.compile("[" + re.escape(PARTS) + UNSEEN + "]+")
UNDOUBTED = re.compile(r"[.\-/" + UNSEEN + "]")
_FILL = "".join(c for c in APART if c not in MASKS and c not in IMITATES)

LOOKALIKE = np.zeros(256, bool)
LOOKALIKE[[ord(c) for c in "0123456789@$!|+(*#%_"]] = True
#: Those that aren't ASCII, as numbers of their bytes.
LOOKALIKE_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in IMITATES if not c.isascii()], np.uint32)
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: What stands for no letter at a word's edge.
CUT_PLAIN = ~(LETTER | LOOKALIKE)
#: What is cut from the start and from the end of a word; a leading $ or @ may stand for a letter.
CUT_START = ~(LETTER | LOOKALIKE)
CUT_START[[ord(c) for c in "!*#%|_(+"]] = True
CUT_END = CUT_START.copy()
CUT_END[[ord(c) for c in "$@"]] = True


class CharModel:
    """Character trigrams of words, with add-one smoothing over the letters seen.

    Sorted arrays of packed trigrams, since there may be millions; tasks remember the steps they take.
    """

    def __init__(self, counts: dict[str, int] | tuple[np.ndarray, np.ndarray]):
        if isinstance(counts, dict):
            counts = np.array([_pack(*gram) for gram in counts], np.int64), np.array(list(counts.values()), np.int64)
        order = np.argsort(counts[0])
        self.grams, n = counts[0][order], counts[1][order].astype(float)
        pairs = self.grams >> 21
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        self.pairs, total = pairs[first], np.add.reduceat(n, first) if len(n) else n
        letters = textops.distinct(np.concatenate([(self.grams >> k) & 0x1FFFFF for k in (42, 21, 0)]))
        self.letters = [c for c in map(chr, letters.tolist()) if c not in "^."] or list("abcdefghijklmnopqrstuvwxyz")
        size = len(self.letters) + 1
        self.cost = -np.log((n + 0.1) / (np.repeat(total, np.diff(first, append=len(n))) + 0.1 * size)).astype(np.float32)
        self.other = -np.log(0.1 / (total + 0.1 * size)).astype(np.float32)
        self.unseen = log(size)
        self.ascii_letters = [c for c in self.letters if c.isascii()]
        self.tensors: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}
        self.steps: dict[tuple[str, str, str], float] = {}

    def step(self, a: str, b: str, c: str) -> float:
        got = self.steps.get((a, b, c))
        if got is None:
            if len(self.steps) > 200_000:
                self.steps.clear()
            got = self.steps[a, b, c] = self._step(_pack(a, b, c))
        return got

    def tensor(self, letters: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(cost of c after a, b as [a, b, c]; of a word's end after a, b)."""
        got = self.tensors.get(letters)
        if got is None:
            if len(self.tensors) > 64:
                self.tensors.clear()
            code = np.array([ord(c) for c in (*letters, ".")], np.int64)
            gram = (code[:-1, None, None] << 42) | (code[None, :-1, None] << 21) | code
            cost = np.full(gram.shape, self.unseen, np.float32)
            for known, price, key in ((self.pairs, self.other, gram >> 21), (self.grams, self.cost, gram)):
                if len(known):
                    i = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    cost = np.where(known[i] == key, price[i], cost)
            got = self.tensors[letters] = (cost[:, :, :-1], cost[:, :, -1])
        return got

    def forget(self) -> None:
        """Drops what a task has remembered; workers outlive tasks."""
        self.steps.clear()
        self.tensors.clear()

    def _step(self, gram: int) -> float:
        for known, cost, key in ((self.grams, self.cost, gram), (self.pairs, self.other, gram >> 21)):
            i = int(np.searchsorted(known, key))
            if i < len(known) and known[i] == key:
                return float(cost[i])
        return self.unseen


def _pack(a: str, b: str, c: str) -> int:
    return ord(a) << 42 | ord(b) << 21 | ord(c)


#: Channel costs: keeping a character, reading a letter out of a sign, a mask, or dropping a character.
KEEP, IMITATE, MASKED, REPEATED, DROPPED = 0.0, 0.7, 2.0, 0.4, 1.5


#: More equal characters in a row than any word has are as many.
REPEATS = re.compile(r"([^*#%_])\1{3,}", re.DOTALL)


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind an obfuscated token (lower case)."""
    return "".join(restore_words([token], model)) or token


def restore_words(chunks: list[str], model: CharModel) -> list[str]:
    """The likeliest words behind obfuscated chunks (lower case): a word may end where a chunk does.

    Exact: all states (last two letters) stay.  Masks stand for any letter, so tokens with masks, whose
    states are many, are decoded on arrays.
    """
    token = REPEATS.sub(r"\1\1\1", "\n".join(chunks))
    word = _restore_masked(token, model) if any(c in MASKS for c in token) else _restore_plain(token, model)
    return chunks if word is None else word.split("\n") if word else []


def _options(seen: str, last: str, model: CharModel) -> tuple[list[tuple[str, float]], float | None]:
    """(letters a character may stand for, with their costs; the cost of leaving it out, or None)."""
    options = [(seen, KEEP)] if seen.isalpha() else [(c, IMITATE) for c in IMITATES.get(seen, "")]
    if seen in MASKS:
        options += [(c, MASKED) for c in model.ascii_letters]
    repeated = last != "" and (seen == last or seen in IMITATES.get(last, "") or last in IMITATES.get(seen, ""))
    return options, REPEATED if repeated else None if seen.isalpha() or seen in IMITATES else DROPPED


def _restore_plain(token: str, model: CharModel) -> str | None:
    start = ("^", "^")
    #: (last two letters) -> (cost, the characters so far, as a chain from the last one)
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {start: (0.0, None)}
    last = ""
    for seen in token:
        if seen == "\n":
            for (a, b), (cost, word) in list(states.items()):
                total = cost + model.step(a, b, ".")
                if b != "^" and states.get(start, (1e18,))[0] > total:
                    states[start] = (total, (word, "\n"))
            continue
        ahead: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        options, drop = _options(seen, last, model)
        last = seen
        for (a, b), (cost, word) in states.items():
            if drop is not None and ahead.get((a, b), (1e18,))[0] > cost + drop:
                ahead[a, b] = (cost + drop, word)
            for c, channel in options:
                total = cost + channel + model.step(a, b, c)
                if ahead.get((b, c), (1e18,))[0] > total:
                    ahead[b, c] = (total, (word, c))
        if not ahead:
            return None
        states = ahead
    ends = [(cost + (0.0 if b == "^" and word else model.step(a, b, ".")), word) for (a, b), (cost, word) in states.items()]
    at, out = min(ends, key=lambda x: x[0])[1], []
    while at:
        at, c = at
        out.append(c)
    return "".join(reversed(out))


#: Characters of a masked token whose back pointers are held at once.
SEGMENT = 2048


def _restore_masked(token: str, model: CharModel) -> str | None:
    """The same over a matrix of states [a, b].  Only states between segments are kept on the way
    forward; each segment's back pointers are made again on the way back."""
    seen, last = [], ""
    for c in token:
        seen.append(_options(c, last, model) if c != "\n" else ([], None))
        last = last if c == "\n" else c
    letters = ["^", *sorted({c for options, _ in seen for c, _ in options})]
    number = {c: i for i, c in enumerate(letters)}
    step, end = model.tensor(tuple(letters))
    n = len(letters)
    grid = np.arange(n)

    def run(states: np.ndarray, lo: int, hi: int, keep: bool) -> tuple[np.ndarray, list[np.ndarray | int]]:
        back: list = []  # for each character: -1 where it was left out, else the letter two places back
        for i in range(lo, hi):
            if token[i] == "\n":
                closed = states + end
                closed[:, 0] = np.inf
                best = int(closed.argmin())
                ends_here = bool(closed.flat[best] < states[0, 0])
                if ends_here:
                    states = states.copy()
                    states[0, 0] = closed.flat[best]
                back.append(best if ends_here else None)
                continue
            options, drop = seen[i]
            ahead = np.full((n, n), np.inf, np.float32) if drop is None else states + np.float32(drop)
            came = np.full((n, n), -1, np.int16)
            if options:
                c = [number[x] for x, _ in options]
                total = states[:, :, None] + step[:, :, c] + np.array([x for _, x in options], np.float32)
                a = total.argmin(0)
                least = total[a, grid[:, None], np.arange(len(c))]
                better = least < ahead[:, c]
                ahead[:, c] = np.where(better, least, ahead[:, c])
                came[:, c] = np.where(better, a, -1)
            states = ahead
            back.append(came if keep else None)
        return states, back

    states = np.full((n, n), np.inf, np.float32)
    states[0, 0] = 0.0
    cuts = [*range(0, len(token), SEGMENT), len(token)]
    held = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        held.append(states)
        states, _ = run(states, lo, hi, False)
        if not np.isfinite(states).any():
            return None
    final = states + end
    if "\n" in token:
        final[0, 0] = states[0, 0]  # the last word ended with its chunk
    a, b = divmod(int(final.argmin()), n)
    out = []
    for k in range(len(held) - 1, -1, -1):
        _, back = run(held[k], cuts[k], cuts[k + 1], True)
        for came in reversed(back):
            if came is None:
                continue
            if isinstance(came, int):  # a word's end
                if (a, b) == (0, 0):
                    a, b = divmod(came, n)
                    out.append("\n")
            elif came[a, b] >= 0:
                out.append(letters[b])
                a, b = int(came[a, b]), a
    return "".join(reversed(out))


def _characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the UTF-8 characters start, and the end; how many start before each byte, and the end)."""
    starts = (buf & 0xC0) != 0x80
    return np.append(np.flatnonzero(starts), len(buf)), np.concatenate([np.zeros(1, np.int32), np.cumsum(starts, dtype=np.int32)])


def _suspicious(buf: np.ndarray, places: np.ndarray, number: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words (edges cut) with a look-alike among letters, or a letter three times in a row."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    looks, letters = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x[buf], dtype=np.int32)]) for x in (LOOKALIKE, LETTER))
    # characters as numbers of their bytes
    code, size = textops.LOWER[buf[places[:-1]]].astype(np.uint32), np.diff(places)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << np.uint32(8) | buf[places[more] + k]
    wide = np.concatenate([[0], np.cumsum(np.isin(code, LOOKALIKE_WIDE))])
    triple = np.zeros(len(code) + 1, np.int64)
    if len(code) > 2:
        triple[3:] = np.cumsum((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & LETTER[buf[places[2:-1]]])
    i, j = number[starts], number[ends]
    signs = (looks[ends] > looks[starts]) | ((wide[j] > wide[i]) & (j - i > 1))
    return (signs & (letters[ends] > letters[starts])) | (triple[j] > triple[np.minimum(i + 2, j)])


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words (edges cut) with signs or unseen characters inside that may part letters."""
    sign = np.zeros(256, bool)
    sign[[ord(c) for c in PARTS]] = True
    found = sign[buf]
    for c in UNSEEN:
        raw = c.encode()
        own = np.ones(max(0, len(buf) - len(raw) + 1), bool)
        for k, b in enumerate(raw):
            own &= buf[k : k + len(own)] == b
        found[: len(own)] |= own
    signs, letters = (np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)]) for x in (found, LETTER[buf]))
    return (signs[ends] > signs[starts]) & (letters[ends] > letters[starts])


class Features:
    """The hashed features of slices of documents (inside a task)."""

    def __init__(self, model: CharModel):
        self.model = model
        self.restored: dict[bytes, bytes] = {}

    def _known(self, key, make):
        got = self.restored.get(key)
        if got is None:
            if len(self.restored) > 50_000:
                self.restored.clear()
            got = make()
            if len(key) <= 256:
                self.restored[key] = got
        return got

    def word(self, raw: bytes) -> bytes:
        token = lambda: "".join(c for c in raw.decode("utf-8", "replace").lower() if c not in _FILL)
        return self._known(raw, lambda: restore(token(), self.model).encode())

    def words(self, chunks: tuple[str, ...]) -> list[bytes]:
        """The words behind letters or parts of words that are kept apart, and all of them as one."""

        def make() -> list[bytes]:
            parts = ["".join(c for c in x.lower() if c not in _FILL) for x in chunks]
            return sorted({x.encode() for x in (restore("".join(parts), self.model), *restore_words(parts, self.model)) if x})

        return self._known(chunks, make)

    def slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, words, slots): occurrences of words in rows, and the features slots[w] of word w."""
        none = np.zeros(0, np.int64)
        starts, ends, first = textops.words(buf, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        head, tail = np.flatnonzero(~CUT_START[buf]), np.flatnonzero(~CUT_END[buf])
        if not len(tail) or not len(starts):
            return none, none, none.reshape(0, 1 + len(PREFIXES))
        a = head[np.minimum(np.searchsorted(head, starts), len(head) - 1)]
        b = tail[np.maximum(np.searchsorted(tail, ends) - 1, 0)] + 1
        whole = (a >= starts) & (b <= ends) & (a < b)
        plain = np.flatnonzero(~CUT_PLAIN[buf])
        wide = plain[np.searchsorted(plain, starts[whole])], plain[np.searchsorted(plain, ends[whole]) - 1] + 1
        starts, ends, row = a[whole], b[whole], row[whole]
        h, at, back = np.unique(textops.hashes(buf, starts, ends, lower=True), return_index=True, return_inverse=True)
        word_start, word_end = starts[at], ends[at]
        places, number = _characters(buf)
        extra: dict[bytes, int] = {}
        extra_rows, extra_which = [none], [none]

        def add(rows: np.ndarray, words: list[bytes]) -> None:
            for w in words:
                extra_rows.append(rows)
                extra_which.append(np.full(len(rows), len(h) + extra.setdefault(w, len(extra)), np.int64))

        # signs at the edges that may stand for letters
        seen = np.append(0, np.cumsum(LETTER[buf], dtype=np.int32))
        left, right = starts - wide[0] == 1, wide[1] - ends == 1  # rows of signs are ornament
        for begin, end, edged in ((wide[0], ends, left), (starts, wide[1], right), (*wide, left & right)):
            own = np.flatnonzero(edged & (seen[ends] > seen[starts]))
            one, which = textops.distinct_words(buf, begin[own], end[own])
            order = np.argsort(which, kind="stable")
            for rows, x, y in zip(np.split(row[own][order], np.cumsum(np.bincount(which))[:-1]), begin[own][one], end[own][one], strict=True) if len(own) else ():
                made = self.word(buf[x:y].tobytes())
                if made:
                    add(rows, [made])
        # letters apart by spaces: runs of three or more one-letter words
        one = number[ends] - number[starts] == 1
        single = np.flatnonzero(one & (LETTER[buf[starts]] | LOOKALIKE[buf[starts]]))
        if len(single):
            cut = np.flatnonzero((np.diff(single) > 1) | (np.diff(row[single]) > 0)) + 1
            for run in np.split(single, cut):
                if len(run) >= 3:
                    chunks = tuple(buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in run.tolist())
                    if len(set(chunks)) > 1 and any(c.isalpha() for c in chunks):
                        add(row[run[:1]], self.words(chunks))
        # letters apart by other signs
        joined = np.flatnonzero(_joined(buf, word_start, word_end))
        if len(joined):
            order = np.argsort(back, kind="stable")
            lo, hi = np.searchsorted(back[order], joined), np.searchsorted(back[order], joined, "right")
            for w, x, y in zip(joined.tolist(), lo.tolist(), hi.tolist(), strict=True):
                chunks = tuple(c for c in GAP.split(buf[word_start[w] : word_end[w]].tobytes().decode("utf-8", "replace")) if c)
                # signs that often stand between whole words part letters only
                if len(chunks) > 1 and (max(map(len, chunks)) <= 2 or UNDOUBTED.search(buf[word_start[w] : word_end[w]].tobytes().decode("utf-8", "replace"))):
                    add(row[order[x:y]], self.words(chunks))
        odd = np.flatnonzero(_suspicious(buf, places, number, word_start, word_end))
        changed = [self.word(buf[x:y].tobytes()) for x, y in zip(word_start[odd], word_end[odd], strict=True)]
        # restored words replace the observed ones
        plain = np.ones(len(h), bool)
        plain[odd] = False
        slots = np.zeros((len(h) + len(extra), 1 + len(PREFIXES)), np.int64)
        order = np.flatnonzero(plain)
        order = order[np.argsort(word_start[order])]
        slots[order] = self._slots(buf, word_start[order], word_end[order])
        made = [*changed, *extra]
        if made:
            text = np.frombuffer(b"\n".join(made) + b"\n", np.uint8)
            lens = np.array([len(x) for x in made])
            begin = np.cumsum(lens + 1) - (lens + 1)
            good = np.flatnonzero(lens > 0)
            target = np.concatenate([odd, len(h) + np.arange(len(extra))]).astype(np.int64)
            slots[target[good]] = self._slots(text, begin[good], begin[good] + lens[good])
        return np.concatenate([row, *extra_rows]), np.concatenate([back, *extra_which]), slots

    @staticmethod
    def _slots(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        places, number = _characters(buf)
        at = number[starts]
        parts = [textops.hashes(buf, starts, ends, lower=True)]
        parts += [textops.mix(textops.hashes(buf, starts, np.minimum(ends, places[np.minimum(at + k, len(places) - 1)]), lower=True) + np.uint64(k)) for k in PREFIXES]
        return np.stack([(p >> np.uint64(64 - FEATURE_BITS)).astype(np.int64) for p in parts], 1)


def _sampled(df: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """About `most` of n rows at most, by hash."""
    return df if n <= most else df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))


def _trigrams(words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams, occurrences) of words that occur so often."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"^^{w}." for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lens = np.array([len(w) + 1 for w in words])
    at = textops.spans(np.cumsum(lens + 2) - (lens + 2), lens)
    grams, back = np.unique(code[at] << 42 | code[at + 1] << 21 | code[at + 2], return_inverse=True)
    n = np.zeros(len(grams), np.int64)
    np.add.at(n, back, np.repeat(np.array(list(words.values()), np.int64), lens))
    return grams, n


def char_model(texts: DataFrame) -> CharModel:
    """Trigrams of the words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        hand_on = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _trigrams(words)], names=["gram", "n"])
        for batch in batches:
            for _, _, buf, offsets in textops.slices(batch.column(0)):
                starts, ends, _ = textops.words(buf, offsets)
                _, at, times = np.unique(textops.hashes(buf, starts, ends), return_index=True, return_counts=True)
                raw = buf.tobytes()
                for a, b, n in zip(starts[at].tolist(), ends[at].tolist(), times.tolist(), strict=True):
                    for w in raw[a:b].decode("utf-8", "replace").split():
                        w = w.strip(".,;:!?\"'()").lower()
                        if w.isalpha():
                            words[w] += n
                if len(words) > WORDS:
                    yield hand_on()
                    words.clear()
        yield hand_on()

    rows = texts.select("text").mapInArrow(textops.tidied(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharModel((rows["gram"].to_numpy(), rows["n"].to_numpy()))


class Model:
    """A trained scorer: small, and sent to tasks whole."""

    def __init__(self, chars: CharModel, weights: np.ndarray, intercept: float):
        self.chars, self.weights, self.intercept = chars, weights, intercept


def train(docs: DataFrame, labels: DataFrame, seed: int = 11) -> Model:
    """Learns from labels (doc_id, toxic) whose texts are in docs."""
    spark = bounded_batches(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("double").alias("label"))
    known = labels.groupBy("label").count().collect()
    total = sum(r["count"] for r in known)
    share = sum(r["label"] * r["count"] for r in known) / total if total else 0.0
    sample = F.broadcast(_sampled(labels, "doc_id", total, SAMPLE))  # bounded by SAMPLE
    text = docs.select("doc_id", "text").join(sample, "doc_id")
    chars = char_model(docs)
    if len(known) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(chars, np.zeros(1 << FEATURE_BITS), log(p / (1 - p)))

    shared = spark.sparkContext.broadcast(chars)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(shared.value)
        for batch in batches:
            for lo, hi, buf, offsets in textops.slices(batch.column(1), SLICE):
                rows, which, slots = make.slice(buf, offsets)
                pair = textops.distinct(rows << 32 | which)
                pair, times = np.unique(np.repeat(pair >> 32, slots.shape[1]) << 32 | slots[pair & 0xFFFFFFFF].ravel(), return_counts=True)
                first = pa.array(np.searchsorted(pair >> 32, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x, t)) for x, t in ((pair & 0xFFFFFFFF, pa.int32()), (times, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["label", "slots", "times"])
        shared.value.forget()

    with scratch(spark):
        # Files cut the lineage, so that the regression's many small jobs carry no model along.
        rows = kept(spark, text.select("label", "text").mapInArrow(textops.tidied(features), "label double, slots array<int>, times array<double>"), "features")
        # features of several positive rows; at most 2 ** FEATURE_BITS
        seen = rows.where("label > 0").select(F.explode("slots").alias("slot")).groupBy("slot").count().where("count > 1").select("slot").toArrow()
        used = np.sort(seen["slot"].to_numpy().astype(np.int64)) if len(seen) else np.zeros(1, np.int64)

        def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(batch)), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(used, slots), len(used) - 1)
                own = used[at] == slots
                first = pa.array(np.searchsorted(row[own], np.arange(len(batch) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x[own], t)) for x, t in ((at, pa.int32()), (batch.column(2).flatten().to_numpy(zero_copy_only=False), pa.float64()))]
                same = lambda v, t: pa.array(np.full(len(batch), v), t)
                vector = pa.StructArray.from_arrays([same(0, pa.int8()), same(len(used), pa.int32()), *lists], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([batch.column(0), vector], names=["label", "features"])

        # a sparse vector's stored form, read back as vectors
        made = rows.mapInArrow(textops.tidied(sparse), "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
        vectors = kept(spark, made, "vectors", schema=T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]))
        fitted = LogisticRegression(maxIter=60, regParam=0.0004, elasticNetParam=1.0, standardization=False).fit(vectors)
    shared.destroy()
    weights = np.zeros(1 << FEATURE_BITS)
    weights[used] = fitted.coefficients.toArray()
    return Model(chars, weights, fitted.intercept)


def score(spark: SparkSession, docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the score; a column of that name is replaced."""
    docs = docs.drop(name)
    shared = bounded_batches(spark).sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        make = Features(model.chars)
        for batch in batches:
            parts = []
            for _, _, buf, offsets in textops.slices(batch.column(text), SLICE):
                rows, which, slots = make.slice(buf, offsets)
                weight = model.weights[slots].sum(1)
                own = weight[which] != 0
                pair = textops.distinct(rows[own] << 32 | which[own])
                parts.append(np.bincount(pair >> 32, weight[pair & 0xFFFFFFFF], len(offsets) - 1))
            z = np.clip(np.concatenate([*parts, np.zeros(0)]) + model.intercept, -500, 500)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names, name])
        model.chars.forget()

    return docs.mapInArrow(textops.tidied(work), T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2
