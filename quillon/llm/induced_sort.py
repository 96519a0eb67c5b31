"""Suffix and common-prefix arrays by induced sorting with queues on disk.

The text is a string of small integers ending in 0.  Leftmost-S suffixes are
named by their substrings; where names repeat, the string of names is sorted
by the same procedure, names beyond a bucket limit being written as two digits
(which keeps their order), until they fit ``memory`` and are sorted there by
prefix doubling.  From the sorted leftmost-S suffixes the L suffixes
and then the S suffixes follow: a scan in order pushes the predecessor of each
suffix, with the length of the prefix it shares with the one pushed before it,
into the queue of its first symbol.  Keys come out in order, so the priority
queue is one first-in-first-out run a symbol; a run's arrays go to disk once
the queue holds more than its memory, and come back in order, or in reverse.

Every array that is as long as the text, or as its leftmost-S suffixes, is a
file mapped to memory beyond ``memory`` entries, in the folder Spark spills to,
and all steps go over them in blocks, so what a worker holds is bounded by
``memory`` and the alphabet, however long the text is.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries that a queue, an array or a step of a sort may hold in memory.
MEMORY = 1 << 20
BLOCK = 1 << 15
_FAR = np.iinfo(np.int32).max
#: The level of items that are known to be equal.
_EQUAL = -1


def scratch() -> str | None:
    """Where Spark spills on this machine; task-private files there vanish with the task."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None


def array(n: int, kind, memory: int = MEMORY) -> np.ndarray:
    """An array of n zeros: a file mapped to memory beyond ``memory`` entries."""
    if n <= memory:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(dir=scratch()), kind, "w+", shape=(n,))


def blocks(n: int, size: int) -> list[tuple[int, int]]:
    """Borders of the blocks of a range."""
    return [(lo, min(n, lo + size)) for lo in range(0, n, size)]


class DiskQueue:
    """A monotone priority queue of (position, common prefix) by symbol, in order of arrival within one."""

    def __init__(self, symbols: int, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.next = [0] * symbols
        self.memory, self.held, self.file, self.size = memory, 0, None, 0

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """Writes all that is in memory, run after run, those of a symbol as one."""
        self.file = self.file or tempfile.TemporaryFile(dir=scratch())
        self.file.seek(self.size)
        for symbol, part in enumerate(self.parts):
            k = next((i for i in range(self.next[symbol], len(part)) if len(part[i]) == 2), None)
            if k is None:
                continue
            both = np.concatenate([np.stack(x, 1) for x in part[k:]])
            self.file.write(both.tobytes())
            part[k:] = [(self.size, len(both), None)]
            self.size += 16 * len(both)
        self.held = 0

    def _read(self, start: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(start + 16 * lo)
        x = np.frombuffer(self.file.read(16 * (hi - lo)), np.int64).reshape(-1, 2)
        return x[:, 0], x[:, 1]

    def pop(self, symbol: int):
        """Yields what is queued for the symbol in order of arrival, in pieces, with what is pushed meanwhile."""
        part = self.parts[symbol]
        limit = max(1, self.memory // 4)
        while self.next[symbol] < len(part):
            k = self.next[symbol]
            x = part[k]
            part[k] = None
            self.next[symbol] += 1
            if len(x) == 3:
                for lo, hi in blocks(x[1], limit):
                    yield self._read(x[0], lo, hi)
            else:
                got, size = [x], len(x[0])
                while (k := self.next[symbol]) < len(part) and len(part[k]) == 2 and size < limit:
                    got.append(part[k])
                    size += len(part[k][0])
                    part[k] = None
                    self.next[symbol] += 1
                self.held -= size
                yield got[0] if len(got) == 1 else tuple(np.concatenate(z) for z in zip(*got))

    def pop_back(self, symbol: int):
        """Yields all that is queued for the symbol in pieces, the last first; each piece is in order of arrival."""
        part, limit = self.parts[symbol], max(1, self.memory // 4)
        while part:
            x = part.pop()
            if len(x) == 3:
                for lo, hi in reversed(blocks(x[1], limit)):
                    yield self._read(x[0], lo, hi)
            else:
                self.held -= len(x[0])
                yield x


class Scan:
    """One induction: feeds sorted suffixes, pushes their predecessors."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, want: bool, symbols: int, memory: int):
        self.text, self.kind, self.want = text, kind, want
        self.queue = DiskQueue(symbols, memory)
        self.since = np.full(symbols, -1, np.int64)  # least common prefix since the last push of a symbol; -1: none yet

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        """The next suffixes in order; lcp[k] is shared with the one before."""
        for lo in range(0, len(pos), BLOCK):
            self._block(pos[lo : lo + BLOCK], lcp[lo : lo + BLOCK])

    def _block(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        m = len(pos)
        before = pos - 1
        ok = (before >= 0) & (self.kind[before] == self.want)
        i = np.flatnonzero(ok)
        if not len(i):
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        p = before[i]
        c = self.text[p].astype(np.int64)
        order = np.argsort(c, kind="stable")
        i, p, c = i[order], p[order], c[order]
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        lo = np.where(new, 0, np.concatenate([[0], i[:-1] + 1]))
        # Sparse table of range minima
        span = i - lo + 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        least = np.empty(len(i), np.int64)
        table, k = lcp, 0
        top = int(level.max())
        while True:
            at = np.flatnonzero(level == k)
            if len(at):
                least[at] = np.minimum(table[lo[at]], table[i[at] - (1 << k) + 1])
            if k == top:
                break
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
            k += 1
        first = np.flatnonzero(new)
        syms = c[first]
        least[first] = np.minimum(least[first], self.since[syms])
        ends = np.append(first[1:], len(c))
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        np.minimum(self.since, tail[0], out=self.since)
        last = i[ends - 1] + 1
        self.since[syms] = np.where(last < m, tail[np.minimum(last, m - 1)], _FAR)
        least += 1
        for s, a, b in zip(syms.tolist(), first.tolist(), ends.tolist()):
            self.queue.push(s, p[a:b], least[a:b])


def ranks(n: int, key, memory: int = MEMORY) -> tuple[np.ndarray, int]:
    """The rank of each of n items among the distinct ones, from 0, and how many there are.

    ``key(items, level)`` gives the items' 64-bit keys of that level, compared
    level after level, and whether each item has more levels.  Items are
    distributed to files by ranges of the key until a range fits ``memory``.
    """
    out = array(n, np.int64, memory)
    count = 0
    rng = np.random.default_rng(5)
    # Ranges still to be sorted, the least last: items (None: all), and the level to look at.
    todo: list[tuple[np.ndarray | None, int]] = [(None, 0)]
    while todo:
        items, level = todo.pop()
        size = n if items is None else len(items)
        if level == _EQUAL:
            for lo, hi in blocks(size, memory):
                out[items[lo:hi]] = count
            count += 1
            continue
        if size <= memory:
            count += _small_ranks(np.arange(n) if items is None else np.asarray(items), key, level, out, count)
            continue
        some = rng.integers(0, size, 4096)
        some = some if items is None else np.sort(np.asarray(items[np.sort(some)]))
        k, _ = key(some, level)
        borders = np.unique(np.sort(k)[:: max(1, len(k) * memory // (4 * size))])
        # Between borders, and the borders themselves apart, as one key may be most of all.
        files = [tempfile.TemporaryFile(dir=scratch()) for _ in range(2 * len(borders) + 1)]
        for lo, hi in blocks(size, memory):
            part = np.arange(lo, hi) if items is None else np.asarray(items[lo:hi])
            k, more = key(part, level)
            at = np.searchsorted(borders, k)
            same = (at < len(borders)) & (borders[np.minimum(at, len(borders) - 1)] == k)
            at = 2 * at + same
            order = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[order], np.arange(len(files) + 1))
            for f, a, b in zip(files, cut[:-1], cut[1:]):
                if b > a:
                    f.write((2 * part[order[a:b]] + more[order[a:b]]).tobytes())
        new = []
        for j, f in enumerate(files):
            f.flush()
            m = f.tell() // 8
            if not m:
                continue
            both = np.memmap(f, np.int64, "r", shape=(m,))
            if j % 2 == 0:
                own = array(m, np.int64, memory)
                for lo, hi in blocks(m, memory):
                    own[lo:hi] = both[lo:hi] >> 1
                new.append((own, level))
                continue
            # One key: the items that end here are equal and come first, the others go on.
            ended = int(sum(np.count_nonzero(both[lo:hi] & 1 == 0) for lo, hi in blocks(m, memory)))
            for rest in (False, True):
                size = m - ended if rest else ended
                if size:
                    own, w = array(size, np.int64, memory), 0
                    for lo, hi in blocks(m, memory):
                        x = np.asarray(both[lo:hi])
                        x = x[(x & 1) == rest] >> 1
                        own[w : w + len(x)] = x
                        w += len(x)
                    new.append((own, level + 1 if rest else _EQUAL))
        todo += reversed(new)
    return out, count


def _small_ranks(items: np.ndarray, key, level: int, out: np.ndarray, start: int) -> int:
    """Ranks of items in memory, written from ``start`` on; how many are distinct."""
    rank = np.zeros(len(items), np.int64)
    live = np.arange(len(items))
    while len(live):
        k, more = key(items[live], level)
        order = np.lexsort((more, k, rank[live]))
        t, k_, m_, b_ = live[order], k[order], more[order], rank[live][order]
        group = np.ones(len(t), bool)
        group[1:] = b_[1:] != b_[:-1]
        new = group.copy()
        new[1:] |= (k_[1:] != k_[:-1]) | (m_[1:] != m_[:-1])
        idx = np.arange(len(t))
        rank[t] = b_ + np.maximum.accumulate(np.where(new, idx, 0)) - np.maximum.accumulate(np.where(group, idx, 0))
        several = np.diff(np.append(np.flatnonzero(new), len(t)))
        live = t[(np.repeat(several, several) > 1) & m_]
        level += 1
    distinct, dense = np.unique(rank, return_inverse=True)
    out[items] = start + dense
    return len(distinct)


def _names(text: np.ndarray, kind: np.ndarray, at: np.ndarray, memory: int) -> tuple[np.ndarray, int]:
    """Rank of each leftmost-S substring among the distinct ones, and how many there are."""
    n, m = len(text), len(at)

    def key(items: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        begin = at[items]
        size = np.where(items + 1 < m, at[np.minimum(items + 1, m - 1)] - begin + 1, 1)
        k = np.zeros(len(items), np.uint64)
        for off in range(4 * level, 4 * level + 4):
            q = np.minimum(begin + off, n - 1)
            k = (k << np.uint64(16)) | (2 * text[q].astype(np.uint64) + kind[q].astype(np.uint64) + np.uint64(1)) * (off < size)
        return k, size > 4 * level + 4

    return ranks(m, key, memory)


def _doubled(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a string of names in order, and how many names each shares with the one before it, in memory.

    The last name is the least and occurs once, so names that two suffixes share end before it.
    """
    m = len(name)

    def groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first of each one's group, and the members of groups of several."""
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)), np.flatnonzero(~new | np.append(~new[1:], False))

    order, shared = np.argsort(name, kind="stable"), np.zeros(m, np.int64)
    first, live = groups(np.diff(name[order], prepend=-1) != 0)
    rank = np.empty(m, np.int32)
    rank[order] = first
    levels = [rank]  # at i: the first place of those that share 2^i names with a suffix
    while len(live):  # places of suffixes that share h names with others
        h, p = 1 << (len(levels) - 1), order[live]
        k = rank[p].astype(np.int64) * m + rank[p + h]
        by = np.argsort(k)
        order[live] = p = p[by]
        new = np.diff(k[by], prepend=-1) != 0
        cut = np.flatnonzero(new[1:] & (rank[p[1:]] == rank[p[:-1]])) + 1
        a, b = p[cut - 1] + h, p[cut] + h
        for i in range(len(levels) - 2, -1, -1):
            same = (levels[i][a] == levels[i][b]).astype(np.int64) << i
            a += same
            b += same
        shared[live[cut]] = a - p[cut - 1]
        first, several = groups(new)
        rank = rank.copy()
        rank[p] = live[first]
        levels.append(rank)
        live = live[several]
    return order, shared


def _min_between(lcp: np.ndarray, even: np.ndarray, memory: int) -> np.ndarray:
    """Least of lcp after each chosen place up to the next."""
    out = array(max(0, len(even) - 1), np.int64, memory)
    for lo, hi in blocks(len(out), memory // 4 or 1):
        a, b = int(even[lo]) + 1, int(even[hi]) + 1
        cuts = np.asarray(even[lo:hi]) + 1 - a
        if b - a <= memory:
            out[lo:hi] = np.minimum.reduceat(np.asarray(lcp[a:b]), cuts)
        else:  # few places far apart
            for k in range(lo, hi):
                s, e = int(even[k]) + 1, int(even[k + 1]) + 1
                out[k] = min(int(lcp[x:y].min()) for x, y in ((s + p, s + q) for p, q in blocks(e - s, memory)))
    return out


def suffix_array(text: np.ndarray, symbols: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes in order, and the length of the prefix each shares with the one before it.

    ``text`` ends in 0, no symbol is negative or reaches ``symbols`` (at most
    2^15), and the symbol before the last is not 0.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    # The next position that differs decides whether a suffix is S (True) or L; from the end, block by block.
    nxt, kind = array(n, np.int64, memory), array(n, bool, memory)
    follow, m = n, 0
    for lo, hi in reversed(blocks(n, memory)):
        here, after = np.asarray(text[lo:hi]), np.asarray(text[lo + 1 : hi + 1])
        edge = np.flatnonzero(here[: len(after)] != after) + lo + 1
        where = np.searchsorted(edge, np.arange(lo, hi), "right")
        nxt[lo:hi] = np.append(edge, follow)[where]
        follow = int(edge[0]) if len(edge) else follow
        kind[lo:hi] = here < text[np.minimum(nxt[lo:hi], n - 1)]
    kind[n - 1] = True

    def leftmost():
        for lo, hi in blocks(n - 1, memory):
            yield np.flatnonzero(kind[lo + 1 : hi + 1] & ~kind[lo:hi]) + lo + 1

    m = sum(len(x) for x in leftmost())
    at, w = array(m, np.int64, memory), 0
    border = np.zeros(symbols + 1, np.int64)
    for x in leftmost():
        at[w : w + len(x)] = x
        w += len(x)
        border[1:] += np.bincount(text[x], minlength=symbols)
    border = np.cumsum(border)

    # Sort the leftmost-S suffixes
    name, top = _names(text, kind, at, memory)
    order, shared = array(m, np.int64, memory), array(m, np.int64, memory)
    if top == m:
        for lo, hi in blocks(m, memory):
            order[name[lo:hi]] = np.arange(lo, hi)
    elif m <= memory:
        order, shared = _doubled(name)
    elif top <= max(256, min(1 << 14, m // 256)):
        small = array(m, np.int32, memory)
        for lo, hi in blocks(m, memory):
            small[lo:hi] = name[lo:hi]
        order, shared = suffix_array(small, top, memory)
    else:
        radix = int(np.ceil(np.sqrt(top)))
        digits = array(2 * m + 1, np.int32, memory)
        for lo, hi in blocks(m, memory):
            digits[2 * lo : 2 * hi : 2], digits[2 * lo + 1 : 2 * hi : 2] = name[lo:hi] // radix + 1, name[lo:hi] % radix + 1
        sa, lcp = suffix_array(digits, radix + 1, memory)
        even, w = array(m, np.int64, memory), 0
        for lo, hi in blocks(len(sa), memory):
            x = np.asarray(sa[lo:hi])
            k = np.flatnonzero((x % 2 == 0) & (x < 2 * m))
            even[w : w + len(k)], order[w : w + len(k)] = k + lo, x[k] // 2
            w += len(k)
        least = _min_between(lcp, even, memory)
        for lo, hi in blocks(m - 1, memory):
            shared[lo + 1 : hi + 1] = least[lo:hi] // 2
        del sa, lcp, even, digits
    shared[0] = 0
    star, lcp = array(m, np.int64, memory), array(m, np.int64, memory)
    for lo, hi in blocks(m, memory):
        star[lo:hi] = at[order[lo:hi]]
    for lo, hi in blocks(m - 1, memory):  # names shared, then symbols of the first substrings that differ
        more = shared[lo + 1 : hi + 1]
        a, b = at[order[lo:hi] + more], at[order[lo + 1 : hi + 1] + more]
        full = a - star[lo:hi]
        live = np.arange(hi - lo)
        while len(live):
            live = live[np.maximum(a[live], b[live]) < n]
            live = live[text[a[live]] == text[b[live]]]
            full[live] += 1
            a[live] += 1
            b[live] += 1
        lcp[lo + 1 : hi + 1] = full
    del name, order, shared

    # L suffixes, in ascending order of symbols
    scan = Scan(text, kind, False, symbols, memory)
    left = DiskQueue(symbols, memory)
    for c in range(symbols):
        last = None
        for p, l in scan.queue.pop(c):
            left.push(c, p, l)
            if last is None:
                l = l.copy()
                l[0] = 0
            last = int(p[-1])
            scan.feed(p, l)
        for a, b in ((border[c] + x, border[c] + y) for x, y in blocks(int(border[c + 1] - border[c]), memory)):
            p, l = np.asarray(star[a:b]), np.array(lcp[a:b])
            if a == border[c]:
                l[0] = 0 if last is None else min(nxt[last] - last, nxt[p[0]] - p[0])
            scan.feed(p, l)

    # S suffixes, in descending order; the L suffixes of a symbol come before its S suffixes
    scan = Scan(text, kind, True, symbols, memory)
    sa, out = array(n, np.int64, memory), array(n, np.int64, memory)
    end = n
    for c in range(symbols - 1, -1, -1):
        done, lowest = end, None
        for p, l in scan.queue.pop(c):
            k = len(p)
            l = l.copy()
            if lowest is None:
                l[0] = 0
            sa[done - k : done] = p[::-1]
            # What the j-th shares with the one above it belongs to that one's place.
            skip = lowest is None
            out[done - k + 1 : done + (not skip)] = l[skip:][::-1]
            done, lowest = done - k, int(p[-1])
            scan.feed(p, l)
        if c == 0:
            if lowest is not None:
                out[done] = 1
            p = np.array([n - 1])
            scan.feed(p, np.array([0 if lowest is None else 1]))
            done, lowest = done - 1, n - 1
            sa[done] = n - 1
        seam, above = 0, None
        for p, l in left.pop_back(c):
            k = len(p)
            if above is None:
                seam = min(nxt[p[-1]] - p[-1], nxt[lowest] - lowest) if lowest is not None else 0
                above = seam
                if lowest is not None:
                    out[done] = seam
            down = np.empty(k, np.int64)
            down[0], down[1:] = above, l[:0:-1]
            scan.feed(p[::-1], down)
            sa[done - k : done], out[done - k : done] = p, l
            done, above = done - k, int(l[0])
        if done < end:
            out[done] = 0
        end = done
    return sa, out
