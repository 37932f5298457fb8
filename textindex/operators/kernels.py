"""Index construction for many texts at once with numpy: the work of one task on one batch.

The texts of a batch stand one behind the other. All arrays are over the whole batch; a text's
slots in the suffix array are its own positions, so ranks of different texts never mix.
"""

from __future__ import annotations

import numpy as np


class Batch:
    """Texts one behind the other, with each position's text end."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.n = len(self.data)
        self.end = np.repeat(self.ends, self.sizes)
        self.start = np.repeat(self.starts, self.sizes)

    def words(self) -> np.ndarray:
        """The eight bytes from each position on, the first in the lowest bits."""
        if not hasattr(self, "_words"):
            wide = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.uint64)
            w = wide[: self.n].copy()
            for j in range(1, 8):
                w |= wide[j : self.n + j] << np.uint64(8 * j)
            self._words = w
        return self._words


def suffix_array(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(sa, isa) over the batch: slot -> position and position -> slot. A shorter suffix comes before those it begins.

    First seven bytes and the length so far decide, text by text; then only suffixes that are
    still tied are sorted, by the ranks 7, 14, 28, ... positions on.
    """
    n = b.n
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left = b.end - np.arange(n)
    key = b.words().byteswap()
    short = left < 8
    cut = (np.uint64(8) * (np.uint64(8) - np.minimum(left[short], 7).astype(np.uint64)))
    key[short] = key[short] >> cut << cut
    key = (key & ~np.uint64(0xFF)) | np.minimum(left, 8).astype(np.uint64)
    sa = np.empty(n, np.int64)
    for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
        sa[s:e] = np.argsort(key[s:e], kind="stable")
        sa[s:e] += s
    ordered = key[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    head[b.starts[b.sizes > 0]] = True
    slot = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, slot, 0)) + 1
    rank[n] = 0
    tied = ~(head & np.append(head[1:], True))
    slots = np.flatnonzero(tied)
    k = 7
    while len(slots):
        at = sa[slots]
        ahead = at + k
        second = np.where(ahead < b.end[at], rank[np.minimum(ahead, n)], 0)
        both = rank[at] << 32 | second
        order = np.argsort(both, kind="stable")
        both, at = both[order], at[order]
        sa[slots] = at
        head = np.ones(len(slots), bool)
        head[1:] = both[1:] != both[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + 1
        slots = slots[~(head & np.append(head[1:], True))]
        k *= 2
    return sa, rank[:n] - 1


def _triples(s: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """One number for the three values from each of these positions on, in their order; values are below base."""
    if base**3 < 1 << 62:
        return (s[at] * base + s[at + 1]) * base + s[at + 2]
    return np.unique(s[at] * base + s[at + 1], return_inverse=True)[1] * base + s[at + 2]


def _by_thirds(s: np.ndarray) -> np.ndarray:
    """The suffix array of numbers above 0, by the positions that 3 doesn't divide first (skew algorithm).

    Those are sorted by their triples, where these repeat by the suffix array of the triples' names; the others by their
    number and the rank behind it. Of each of the others it is counted how many of the first come before it.
    """
    n = len(s)
    if n < 4:
        v = s.tolist()
        return np.array(sorted(range(n), key=lambda i: v[i:]), np.int64)
    base = int(s.max()) + 1
    s = np.concatenate([s, np.zeros(3, np.int64)])
    m = n + (n % 3 == 1)  # a position past the end keeps the two runs of triples apart
    at = np.concatenate([np.arange(1, m, 3), np.arange(2, m, 3)])
    key = _triples(s, at, base)
    order = np.argsort(key)
    key = key[order]
    name = np.empty(len(at), np.int64)
    name[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
    if name.max() < len(at):
        order = _by_thirds(name)
    first = at[order]
    rank = np.zeros(n + 4, np.int64)
    rank[first] = np.arange(1, len(at) + 1)
    first, above = first[first < n], len(at) + 1
    rest = np.arange(0, n, 3)
    key = s[rest] * above + rank[rest + 1]
    order = np.argsort(key)
    rest, key = rest[order], key[order]
    one, two = first[first % 3 == 1], first[first % 3 == 2]
    slot = np.arange(len(rest)) + np.searchsorted(s[one] * above + rank[one + 1], key)
    pair = s[:-1] * base + s[1:]
    if base * base * above >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    slot += np.searchsorted(pair[two] * above + rank[two + 2], pair[rest] * above + rank[rest + 2])
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[slot], free[slot] = rest, False
    out[free] = first
    return out


def skew(b: Batch) -> np.ndarray:
    """sa as suffix_array() has it, by another method: the texts' one suffix array by thirds, each text with an end of its own, smaller than any byte."""
    many = len(b.texts)
    ends = b.ends + np.arange(many)
    s = np.empty(b.n + many, np.int64)
    s[ends] = np.arange(1, many + 1)
    s[np.arange(b.n) + np.repeat(np.arange(many), b.sizes)] = b.data.astype(np.int64) + many + 1
    sa = _by_thirds(s)
    sa = sa[s[sa] > many]
    text = np.searchsorted(ends, sa)
    order = np.argsort(text.astype(np.uint16) if many < 1 << 16 else text, kind="stable")
    return (sa - text)[order]


def same(b: Batch, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each text whether two suffix arrays are equal there, element by element."""
    out = np.ones(len(b.texts), bool)
    out[np.searchsorted(b.ends, np.flatnonzero(one != other), side="right")] = False
    return out


def smaller(b: Batch, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the slots of the previous and of the next smaller position in the same text; -1 for none.

    Every slot points to its neighbour first. While it points to a larger position it takes
    over what that one points to, all slots at once.
    """
    n = b.n
    value = np.append(sa, -1)  # slot n stands for none
    slot = np.arange(n)
    found = []
    for step, bound in ((-1, b.start), (1, b.end - 1)):
        to = np.append(np.where(slot == bound, n, slot + step), n)
        todo = slot
        while len(todo):
            todo = todo[value[to[todo]] > value[todo]]
            to[todo] = to[to[todo]]
        found.append(np.where(to[:n] == n, -1, to[:n]))
    return found[0], found[1]


def _to_text(sa: np.ndarray, neighbour: np.ndarray) -> np.ndarray:
    """Slots of neighbours in slot order -> their positions in text order."""
    out = np.empty(len(sa), np.int64)
    out[sa] = np.where(neighbour >= 0, sa[neighbour], -1)
    return out


ROUNDS = 32


def common(b: Batch, other: np.ndarray, every: bool = False) -> np.ndarray:
    """Bytes that the text has in common from each position and from the other one (an earlier one, or -1: 0).

    Eight bytes are compared at a time. What is still equal after ROUNDS comes out as -1 (to be
    found when needed), or with `every` is found here.
    """
    n = b.n
    w = np.append(b.words(), np.zeros(1, np.uint64))
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(other >= 0)
    for _ in range(ROUNDS):
        if not len(todo):
            break
        i, j = todo + out[todo], other[todo] + out[todo]
        x = w[np.minimum(i, n)] ^ w[np.minimum(j, n)]
        same = x == 0
        differ = x[~same]
        lowest = (differ & (~differ + np.uint64(1))).astype(np.float64)
        at = todo[~same]
        out[at] += (np.frexp(lowest)[1] - 1) >> 3
        todo = todo[same]
        out[todo] += 8
        todo = todo[out[todo] < b.end[todo] - todo]
    out = np.minimum(out, b.end - np.arange(n))
    if every:
        whole = b.data.tobytes()
        for i in todo.tolist():
            out[i] = extend(whole, i, int(other[i]), int(out[i]), int(b.end[i]))
    else:
        out[todo] = -1
    return out


def extend(data: bytes, i: int, j: int, have: int, end: int) -> int:
    """The common length of the suffixes at i > j of one text that ends at `end`, at least `have`."""
    step = 64
    while i + have < end:
        m = min(step, end - i - have)
        if data[i + have : i + have + m] == data[j + have : j + have + m]:
            have += m
            step *= 2
        elif m <= 8:
            while data[i + have] == data[j + have]:
                have += 1
            return have
        else:
            step = m // 2
    return have


def adjacent(b: Batch, sa: np.ndarray) -> np.ndarray:
    """For each slot the bytes that its suffix has in common with the one before; 0 for a text's first."""
    n = b.n
    out = np.zeros(n, np.int64)
    slot = np.flatnonzero(np.arange(n) != b.start)
    here, before = sa[slot], sa[slot - 1]
    for swap in (False, True):  # common() wants the earlier position second; each position is in one pair of either kind
        own = (here < before) == swap
        other = np.full(n, -1)
        late, early = (before, here) if swap else (here, before)
        other[late[own]] = early[own]
        out[slot[own]] = common(b, other, True)[late[own]]
    return out


def candidates(b: Batch, every: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """psv, nsv (positions in text order, -1 for none) and the common lengths with both."""
    sa, _ = suffix_array(b)
    before, after = smaller(b, sa)
    psv, nsv = _to_text(sa, before), _to_text(sa, after)
    return psv, nsv, common(b, psv, every), common(b, nsv, every)


def choose(b: Batch, psv, nsv, lp, ln) -> tuple[np.ndarray, np.ndarray]:
    """(source, length) of the factor at each position: the longer candidate, the next smaller value on ties; a literal's source is its byte."""
    length = np.maximum(lp, ln)
    previous = (nsv < 0) | (lp > ln)
    source = np.where(length == 0, b.data, np.where(previous, psv, nsv) - b.start)
    return source, length


def factors(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, source, length) of all factors of the greedy parse, in order."""
    if not b.n:
        return (np.empty(0, np.int64),) * 4
    psv, nsv, lp, ln = candidates(b, every=False)
    open_ = (lp < 0) | (ln < 0)
    step = np.maximum(1, np.maximum(lp, ln))
    step[open_] = 0  # unknown yet
    steps, starts = step.tolist(), []
    data = None
    for s, e in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
        i = s
        while i < e:
            m = steps[i]
            if not m:
                data = data or b.data.tobytes()
                for found, to in ((lp, psv), (ln, nsv)):
                    if found[i] < 0:
                        found[i] = extend(data, i, int(to[i]), 0, e)
                m = max(1, int(lp[i]), int(ln[i]))
            starts.append(i)
            i += m
    at = np.array(starts, np.int64)
    source, length = choose_at(b, psv, nsv, lp, ln, at)
    text = np.searchsorted(b.ends, at, side="right")
    return text, at - b.starts[text], source, length


def choose_at(b: Batch, psv, nsv, lp, ln, at) -> tuple[np.ndarray, np.ndarray]:
    lp, ln, nsv_at = lp[at], ln[at], nsv[at]
    length = np.maximum(lp, ln)
    source = np.where(length == 0, b.data[at], np.where((nsv_at < 0) | (lp > ln), psv[at], nsv_at) - b.start[at])
    return source, length


def decode(source: list[int], length: list[int]) -> bytes:
    """The text of a factor list."""
    out = bytearray()
    for s, m in zip(source, length, strict=True):
        if not m:
            out.append(s)
        elif s + m <= len(out):
            out += out[s : s + m]
        else:  # the source overlaps what it makes
            run = bytes(out[s:])
            out += (run * (m // len(run) + 1))[:m]
    return bytes(out)


def bwt(b: Batch, sa: np.ndarray, isa: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The transform of each text (end marker's row removed) and its primary index; nothing for empty texts."""
    out, primary = [], np.zeros(len(b.texts), np.int64)
    for k, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist(), strict=True)):
        if s == e:
            out.append(b"")
            continue
        own = sa[s:e]
        last = b.data[own[own != s] - 1]
        out.append(bytes([b.data[e - 1]]) + last.tobytes())
        primary[k] = isa[s] - s + 1
    return out, primary


def unbwt(transform: bytes, primary: int) -> bytes:
    """The text of a transform and its primary index.

    The end marker's row is put back at the primary index; the stable order of the column leads from
    each row to that of the next position, and pointer doubling follows all rows at once.
    """
    n = len(transform)
    if not n:
        return b""
    column = np.empty(n + 1, np.int64)
    raw = np.frombuffer(transform, np.uint8).astype(np.int64) + 1
    column[:primary], column[primary], column[primary + 1 :] = raw[:primary], 0, raw[primary:]
    first = np.argsort(column, kind="stable")  # row -> row of the suffix one on
    order = np.empty(n + 1, np.int64)
    # follow the rows from the end marker's: split into chains that are walked side by side
    order[0] = first[0]
    have, jump = 1, first
    while have < n + 1:
        m = min(have, n + 1 - have)
        order[have : have + m] = jump[order[:m]]
        have += m
        jump = jump[jump]
    return (np.sort(column)[order[:n]] - 1).astype(np.uint8).tobytes()
