"""Re-Pair grammar compression of one shard of token ids, on arrays.

Pairs of neighbours are counted and frequent ones become rules, whose places become the new symbol,
until no pair is left with LEAST places: fewer would not pay for a rule, which is stored in 12 bytes
where a place saves 2 or 4.  Pairs come in order of frequency by halves: a round replaces those with at
least half the places of the most frequent one, and each next one takes pairs half as frequent as well.
The last rounds go on until they find none.  They look only at places that the round before left over or
touched: elsewhere pairs are too rare, and pairs that are there never become more frequent.  Where places of chosen pairs overlap, the more frequent pair takes the place, and in a run
of equal symbols every other place.  A pair whose places shrink below LEAST by that waits.

No rule crosses a document's end, so a document is a range of the compressed sequence.  Every symbol's
expansion length is kept: a cumulative sum over a document's symbols finds the symbol that holds any
token.
"""

from __future__ import annotations

import numpy as np

#: Least places of a rule, and counters of the first, coarse count.
LEAST, COARSE_BITS = 4, 20
_SHIFT = np.uint64(32)


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The counters of pairs in the coarse count."""
    return (((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - COARSE_BITS)).astype(np.intp)


def _grouped(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs in order, which of them each one is, how often each occurs): np.unique's, by one sort of a pair's
    symbols and its number in one word where they fit, since a sort of values is many times faster than one of places."""
    left, right = pair >> _SHIFT, pair & np.uint64(0xFFFFFFFF)
    bits = int(max(left.max(initial=0), right.max(initial=0))).bit_length()
    number = len(pair).bit_length()
    if 2 * bits + number > 64:
        return np.unique(pair, return_inverse=True, return_counts=True)
    word = (left << np.uint64(bits) | right) << np.uint64(number)
    word |= np.arange(len(pair), dtype=np.uint64)
    word.sort()
    place = (word & np.uint64((1 << number) - 1)).astype(np.intp)
    word >>= np.uint64(number)
    new = np.ones(len(word), bool)
    np.not_equal(word[1:], word[:-1], out=new[1:])
    which = np.empty(len(word), np.intp)
    which[place] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return pair[place[begin]], which, np.diff(begin, append=len(word))


def _chosen(pair: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places to replace, their pairs as numbers, the numbered pairs, all places of those pairs) among places
    `at` of pairs: pairs of at least `least` places, no two places overlapping."""
    values, which, count = _grouped(pair)
    good = count >= least
    keep = good[which]
    at, which = at[keep], (np.cumsum(good) - 1)[which[keep]]
    whole = at
    values, count = values[good], count[good]
    # rank 0 is the most frequent pair; of equally frequent ones, the smaller
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(values))
    while len(at):
        own = rank[which]
        # a place stands if its neighbours, which it would overlap, are of rarer pairs
        before = np.append(False, (at[1:] == at[:-1] + 1))
        after = np.append(before[1:], False)
        same = np.append(False, before[1:] & (own[1:] == own[:-1]))
        # place in a run of one pair (x x x): every other one
        head = np.flatnonzero(~same)
        odd = (np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 1
        beaten = odd.copy()
        beaten[1:] |= before[1:] & (own[:-1] < own[1:])
        beaten[:-1] |= after[:-1] & (own[1:] < own[:-1])
        won, won_which = at[~beaten], which[~beaten]
        count = np.bincount(won_which, minlength=len(values))
        enough = (count >= LEAST)[won_which]
        if enough.any():
            return won[enough], won_which[enough], values, whole
        # every winner is short of places: without them others may stand
        lost = (count > 0)[which]
        at, which = at[~lost], which[~lost]
    return at, which, values, whole


def _around(at: np.ndarray, n: int) -> np.ndarray:
    """A mask of n places: those `at` and the ones before them."""
    out = np.zeros(n + 1, bool)
    out[at] = True
    out[at - 1] = True  # place -1 is the one past the end
    return out[:n]


def compress(ids: np.ndarray, first: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, rules): document i is symbols[first[i]:first[i + 1]]; rules[k] are the two
    symbols of nonterminal terminals + k."""
    seq = ids.astype(np.uint32)
    head = np.zeros(len(seq) + 1, bool)
    head[first] = True
    rules: list[np.ndarray] = []
    size, least = terminals, 1 << 40
    places: np.ndarray | None = None  # at the last threshold, where a pair may still have LEAST places
    # the coarse count of all pairs is kept up as places change; the last symbol starts no pair
    none = 1 << COARSE_BITS
    slot = np.append(_slots(seq[:-1], seq[1:]), np.full(min(len(seq), 1), none, np.intp))
    total = np.bincount(slot, minlength=none + 1)
    while len(seq) > 1:
        at = places
        if at is None:
            # a pair is no more frequent than its slot; pairs over a document's end only add to slots
            hot = total >= min(least, len(seq))
            hot[none] = False
            at = np.flatnonzero(hot.take(slot, mode="clip"))
        at = at[~head[at + 1]]
        if least > LEAST and not len(at):
            least = max(LEAST, min(least, int(total[:none].max())) // 2)
            continue
        last = least <= LEAST
        at, which, values, whole = _chosen(seq[at].astype(np.uint64) << _SHIFT | seq[at + 1].astype(np.uint64), at, least)
        if not len(at) and last:
            break
        least = max(LEAST, least // 2)
        if not len(at):
            continue
        used = np.bincount(which, minlength=len(values)) > 0
        new = values[used]
        seq[at] = (size - 1 + np.cumsum(used)[which]).astype(np.uint32)
        rules.append(np.stack([new >> _SHIFT, new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        size += len(new)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        if not last:
            total -= np.bincount(slot[_around(at, len(seq)) | ~keep], minlength=none + 1)
            slot = slot[keep]
        seq, head = seq[keep], np.append(head[:-1][keep], True)
        touched = _around(at - np.arange(len(at)), len(seq))
        if last:
            whole = whole[keep[whole]]
            touched[whole - np.searchsorted(at + 1, whole)] = True
            places = np.flatnonzero(touched[:-1])
            continue
        touched = np.flatnonzero(touched)
        left = touched[touched < len(seq) - 1]
        slot[left] = _slots(seq[left], seq[left + 1])
        slot[-1] = none
        total += np.bincount(slot[touched], minlength=none + 1)
    # empty documents share a place with the next one, so ends are counted, not read from the marks
    ends = np.cumsum(expansions(rules, terminals)[seq]) if len(seq) else np.zeros(0, np.int64)
    return seq, np.searchsorted(ends, first - first[0], "right") if len(seq) else np.zeros(len(first), np.int64), np.concatenate([*rules, np.zeros((0, 2), np.uint32)])


def expansions(rules: list[np.ndarray] | np.ndarray, terminals: int) -> np.ndarray:
    """The number of terminals each symbol stands for."""
    total = np.concatenate([*(rules if isinstance(rules, list) else [rules]), np.zeros((0, 2), np.uint32)]).astype(np.int64)
    out = np.ones(terminals + len(total), np.int64)
    reach = np.maximum.accumulate(total.max(1)) if len(total) else np.zeros(0, np.int64)
    done = 0
    while done < len(total):  # the rules that only use symbols known so far come together
        n = int(np.searchsorted(reach, terminals + done, "left"))
        out[terminals + done : terminals + n] = out[total[done:n, 0]] + out[total[done:n, 1]]
        done = n
    return out


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The terminals of a range of symbols; lengths are the nonterminals' expansion lengths."""
    size = np.append(np.ones(terminals, np.int64), lengths) if lengths is not None else expansions(rules, terminals)
    symbol = seq.astype(np.int64)
    own = size[symbol]
    place = np.cumsum(own) - own
    out = np.empty(int(own.sum()), np.uint32)
    while len(symbol):  # one step down all derivations, each token is written once
        done = symbol < terminals
        out[place[done]] = symbol[done]
        symbol, place = symbol[~done], place[~done]
        pair = rules[symbol - terminals].astype(np.int64)
        place = np.concatenate([place, place + size[pair[:, 0]]])
        symbol = pair.T.ravel()
    return out
