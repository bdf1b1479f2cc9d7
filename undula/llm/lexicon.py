"""A minimal acyclic transducer from words to token ids, kept in one file for memory mapping.

Words are compiled in sorted order into an automaton whose states share equal suffixes.  Arcs carry
the number of words that precede those behind them, so the sum along a path is a word's number in
sorted order (its output); the ids of word w are ids[first[w]:first[w + 1]].  A lookup walks all
words of a batch together, one byte a step.
"""

from __future__ import annotations

import json

import numpy as np

_ARRAYS = ("key", "target", "skip", "final", "first", "ids")


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The automaton of distinct words: arcs by (state << 8 | byte), and final marks."""
    words = sorted(words)
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of registered states: ((byte, target), ...)
    final: list[bool] = []
    #: the path of the previous word: per depth [is final, [(byte, state), ...]]
    path: list[list] = [[False, []]]

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(key[1])
            final.append(key[0])
        return state

    last = b""
    for word in [*words, b""]:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        if not word:
            break
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    root = freeze(path[0])
    below = np.zeros(len(arcs), np.int64)  # words from each state on; targets precede sources
    key, target, skip = [], [], []
    for state, own in enumerate(arcs):
        n = int(final[state])
        for byte, to in own:
            key.append(state << 8 | byte)
            target.append(to)
            skip.append(n)
            n += below[to]
        below[state] = n
    return {"key": np.array(key, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32), "final": np.array(final, bool), "root": root}


def write(path: str, words: list[bytes], ids: list[np.ndarray]) -> None:
    """Compiles words, ids[i] being those of sorted(words)[i], into a file."""
    parts = compile_words(words)
    parts |= {"first": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), "ids": np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)}
    head: dict = {"root": parts["root"], "longest": max(map(len, words), default=0), "arrays": {}}
    at = 0
    for name in _ARRAYS:
        a = parts[name]
        head["arrays"][name] = (str(a.dtype), len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    base = -(-(len(text) + 8) // 64) * 64
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for name in _ARRAYS:
            f.seek(base + head["arrays"][name][2])
            f.write(parts[name].tobytes())
        f.truncate(base + at)


class Lexicon:
    """A written transducer, memory-mapped: the workers of a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        base = -(-(n + 8) // 64) * 64
        self.root, self.longest = head["root"], head["longest"]
        raw = np.memmap(path, np.uint8, "r")
        for name, (dtype, count, at) in head["arrays"].items():
            setattr(self, name, raw[base + at : base + at + count * np.dtype(dtype).itemsize].view(dtype))

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each byte range among the words, or -1."""
        out = np.full(len(starts), -1, np.int64)
        lens = ends - starts
        order = np.flatnonzero((lens > 0) & (lens <= self.longest))
        if not len(order) or not len(self.key):
            return out
        state, number = np.full(len(order), self.root, np.int64), np.zeros(len(order), np.int64)
        step = 0
        while len(order):
            key = state << 8 | buf[starts[order] + step]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            good = self.key[arc] == key
            order, arc, number = order[good], arc[good], number[good]
            state, number = self.target[arc].astype(np.int64), number + self.skip[arc]
            step += 1
            ended = lens[order] == step
            hit = ended & self.final[state]
            out[order[hit]] = number[hit]
            order, state, number = order[~ended], state[~ended], number[~ended]
        return out
