"""Induced suffix sorting with common-prefix values and a queue that spills.

The text of a shard, its types and the order of its S* suffixes lie in memory, an estimated 30 bytes for every byte of text; only the
queue is bounded and spills. So callers keep texts small: see `suffixdedup` for the bound of a shard. Suffixes are induced as in SA-IS: the suffixes at local minima (S*) are
sorted first, by naming the substrings between them and sorting the string of names, which recurses; then one
rising pass induces all L-type suffixes and one falling pass all S-type suffixes.

Both passes are driven by a priority queue over first symbols. Its entries are suffix tuples: position and length of the
prefix shared with the entry before. A symbol's entries come out in the order in which they went in, so the queue keeps a FIFO
of arrays per symbol and a heap of symbols; arrays beyond the memory bound lie in an unnamed spill file that ends with the
queue. The common prefix of two induced neighbours is one more than the smallest value between the suffixes that induced them.

Values stop at `cap`: the caller only asks whether neighbours share that many symbols.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

MEMORY = 64 << 20  # bytes of queue entries kept in memory
IN_MEMORY_NAMES = 1 << 24  # strings of names up to this length are sorted in memory, longer ones recurse
ENTRY = np.dtype([("at", np.int64), ("lcp", np.int32)])


class DiskQueue:
    """Priority queue of suffix tuples by symbol, FIFO within a symbol; rising, or falling with ``sign=-1``."""

    def __init__(self, memory: int, sign: int = 1) -> None:
        self.memory, self.sign = memory, sign
        self.heap: list[int] = []
        self.parts: dict[int, list] = {}
        self.held = self.spilled = 0
        self.file = None

    def push(self, symbol: int, entries: np.ndarray) -> None:
        own = self.parts.get(symbol)
        if own is None:
            own = self.parts[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        if self.held + entries.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            place = self.file.seek(0, 2)
            self.file.write(entries.tobytes())
            self.spilled += len(entries)
            own.append((place, len(entries)))
        else:
            self.held += entries.nbytes
            own.append(entries)

    def next(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, symbol: int) -> np.ndarray | None:
        """All entries of the symbol so far; more may be pushed for it afterwards."""
        own = self.parts.pop(symbol, None)
        if own is None:
            return None
        heapq.heappop(self.heap)
        arrays = []
        for part in own:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                arrays.append(np.frombuffer(self.file.read(part[1] * ENTRY.itemsize), ENTRY))
            else:
                self.held -= part.nbytes
                arrays.append(part)
        return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def entries_of(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), ENTRY)
    out["at"], out["lcp"] = at, lcp
    return out


def run_lengths(text: np.ndarray) -> np.ndarray:
    """How often the symbol at each place is repeated from there on."""
    ends = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text)) + 1


def smaller_types(text: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """True for S-type places: the suffix is smaller than the one after it. The last place is S-type."""
    after = np.arange(len(text)) + runs
    last = after >= len(text)
    after[last] = len(text) - 1
    return last | (text < text[after])


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of ``values[low..high]`` for every pair."""
    table = [values]
    width = 1
    longest = int((high - low).max(initial=0)) + 1
    while 2 * width <= longest:
        before = table[-1]
        table.append(np.minimum(before[:-width], before[width:]))
        width *= 2
    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << int(k)) + 1])
    return out


class _Carry:
    """Shared prefix of an induced suffix with the one induced before it into the same symbol."""

    def __init__(self, symbols: int, cap: int) -> None:
        self.cap = cap
        self.since = np.full(symbols if cap else 0, -1, np.int32)  # smallest value since the last one; -1: none yet

    def induce(self, queue: DiskQueue, text: np.ndarray, batch: np.ndarray, wanted: np.ndarray) -> None:
        """Push the predecessors of the ``wanted`` entries of a batch in scan order."""
        lcp = batch["lcp"]
        places = np.flatnonzero(wanted)
        whole = int(lcp.min(initial=self.cap))
        if not len(places):
            if self.cap:
                np.minimum(self.since, whole, out=self.since)
            return
        at = batch["at"][places] - 1
        symbol = text[at]
        order = np.argsort(symbol, kind="stable")  # of short integers by counting
        symbol, places, at = symbol[order].astype(np.int64), places[order], at[order]
        if not self.cap:
            begins = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(symbol)]):
                queue.push(int(symbol[a]), entries_of(at[a:b], np.zeros(b - a, np.int32)))
            return
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        low = np.where(first, 0, np.concatenate([[0], places[:-1] + 1]))
        least = _range_min(lcp, low, places)
        begins = np.flatnonzero(first)
        names = symbol[begins]
        known = self.since[names]
        least[begins] = np.where(known < 0, -1, np.minimum(known, least[begins]))
        value = np.minimum(least + 1, self.cap).astype(np.int32)
        ends = np.append(begins[1:], len(symbol))
        lasts = places[ends - 1]
        np.minimum(self.since, whole, out=self.since)
        tails = np.minimum.accumulate(lcp[::-1])[::-1]
        inside = lasts + 1 < len(lcp)
        fresh = np.full(len(names), self.cap, np.int32)
        fresh[inside] = tails[lasts[inside] + 1]
        self.since[names] = fresh
        for name, a, b in zip(names.tolist(), begins.tolist(), ends.tolist()):
            queue.push(name, entries_of(at[a:b], value[a:b]))


def _star_order(text: np.ndarray, small: np.ndarray, stars: np.ndarray, memory: int, names_in_memory: int) -> np.ndarray:
    """The S* places in the order of their suffixes."""
    if len(stars) < 2:
        return stars
    length = np.append(np.diff(stars), len(text) - stars[-1] - 1) + 1
    kinds = 2 * text.astype(np.int64) + small
    bits = int(kinds.max() + 1).bit_length()
    width = max(1, 63 // bits)
    order = np.arange(len(stars))
    rank = np.zeros(len(stars), np.int64)
    pending = order  # places of `stars` whose substring is not yet told apart
    depth = 0
    while len(pending):
        key = np.zeros(len(pending), np.int64)
        for step in range(depth, depth + width):
            inside = step < length[pending]
            symbol = kinds[np.minimum(stars[pending] + step, len(text) - 1)] + 1
            key = key << bits | np.where(inside, symbol, 0)
        by = np.lexsort((key, rank[pending])) if depth else np.argsort(key, kind="stable")
        pending, key = pending[by], key[by]
        group = rank[pending]
        change = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        head = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(pending))
        # a name is the number of substrings before its first equal one
        rank[pending] = group + place[np.maximum.accumulate(np.where(change, place, 0))] \
            - place[np.maximum.accumulate(np.where(head, place, 0))]
        depth += width
        sizes = np.diff(np.append(np.flatnonzero(change), len(pending)))
        pending = pending[np.repeat(sizes > 1, sizes) & (length[pending] > depth)]
    distinct = np.unique(rank)
    if len(distinct) == len(stars):
        return stars[np.argsort(rank)]
    names = np.searchsorted(distinct, rank)
    if len(names) <= names_in_memory:
        return stars[_doubled(names)]
    return stars[induced_order(names + 1, memory, names_in_memory)]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string in memory, by doubling the compared length of those not yet told apart.

    A rank is the number of suffixes before the first of its group, so the ranks of finished suffixes stay.
    """
    size, step = len(names), 1
    order = np.argsort(names, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], names[order[1:]] != names[order[:-1]]]))
    sizes = np.diff(np.append(heads, size))
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(heads, sizes)
    pending = order[np.repeat(sizes > 1, sizes)]
    while len(pending):
        after = np.where(pending + step < size, rank[np.minimum(pending + step, size - 1)], -1)
        group = rank[pending]
        by = np.lexsort((after, group))
        pending, after, group = pending[by], after[by], group[by]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        change = head | np.concatenate([[True], after[1:] != after[:-1]])
        place = np.arange(len(pending))
        rank[pending] = group + place[np.maximum.accumulate(np.where(change, place, 0))] \
            - place[np.maximum.accumulate(np.where(head, place, 0))]
        sizes = np.diff(np.append(np.flatnonzero(change), len(pending)))
        pending = pending[np.repeat(sizes > 1, sizes)]
        step *= 2
    order[rank] = np.arange(size)
    return order


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of suffixes ``a`` and ``b``, at most ``cap``."""
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    last = len(text) - 1
    for depth in range(cap):
        x, y = a[live] + depth, b[live] + depth
        same = (x <= last) & (y <= last)
        same &= text[np.minimum(x, last)] == text[np.minimum(y, last)]
        live = live[same]
        if not len(live):
            break
        out[live] = depth + 1
    return out


def induced(text: np.ndarray, cap: int, memory: int = MEMORY, names_in_memory: int = IN_MEMORY_NAMES):
    """Yield the suffixes of ``text`` from the largest to the smallest, as arrays of (position, prefix shared with the
    suffix yielded before). Symbols are whole numbers from 0; the last one must be the only smallest one."""
    size = len(text)
    if not size:
        return
    runs = run_lengths(text)
    small = smaller_types(text, runs)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    symbols = int(text.max()) + 1
    ordered = _star_order(text, small, stars, memory, names_in_memory)
    shared = np.zeros(len(ordered), np.int32)
    if cap and len(ordered):
        shared[1:] = _shared(text, ordered[:-1], ordered[1:], cap)
    star_symbol = text[ordered].astype(np.int64)

    def by_symbol(symbol: int) -> np.ndarray:
        a, b = np.searchsorted(star_symbol, [symbol, symbol + 1])
        return entries_of(ordered[a:b], shared[a:b])

    # Rising pass: L-type suffixes from S* and L-type ones. The last place is an S* place.
    rising, larger, carry = DiskQueue(memory), DiskQueue(memory, -1), _Carry(symbols, cap)
    star_names = np.unique(star_symbol).tolist()[::-1]
    while True:
        upcoming = [x for x in (rising.next(), star_names[-1] if star_names else None) if x is not None]
        if not upcoming:
            break
        symbol, last = min(upcoming), None
        while (batch := rising.pop(symbol)) is not None:
            larger.push(symbol, batch)
            last = batch["at"][-1]
            carry.induce(rising, text, batch, _before(small, batch["at"], False))
        if star_names and star_names[-1] == symbol:
            star_names.pop()
            batch = by_symbol(symbol)
            batch["lcp"][0] = 0 if last is None else min(cap, runs[last], runs[batch["at"][0]])
            carry.induce(rising, text, batch, _before(small, batch["at"], False))
    rising.close()

    # Falling pass: S-type suffixes from everything larger; the finished order streams out.
    falling, carry = DiskQueue(memory, -1), _Carry(symbols, cap)
    falling.push(int(text[size - 1]), entries_of(np.array([size - 1]), np.array([0])))
    while True:
        upcoming = [x for x in (falling.next(), larger.next()) if x is not None]
        if not upcoming:
            break
        symbol, last = max(upcoming), None
        while (batch := falling.pop(symbol)) is not None:
            last = batch["at"][-1]
            yield batch
            carry.induce(falling, text, batch, _before(small, batch["at"], True))
        if larger.next() == symbol:
            stored = larger.pop(symbol)[::-1]
            batch = stored.copy()
            batch["lcp"][1:] = stored["lcp"][:-1]  # values belong to the gap before; the order is reversed
            batch["lcp"][0] = 0 if last is None else min(cap, runs[last], runs[batch["at"][0]])
            yield batch
            carry.induce(falling, text, batch, _before(small, batch["at"], True))
    falling.close()
    larger.close()


def _before(small: np.ndarray, at: np.ndarray, kind: bool) -> np.ndarray:
    """Whether a place precedes ``at`` and has the wanted type."""
    return (at > 0) & (small[at - 1] == kind)


def induced_order(text: np.ndarray, memory: int = MEMORY, names_in_memory: int = IN_MEMORY_NAMES) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes."""
    parts = [batch["at"] for batch in induced(text, 0, memory, names_in_memory)]
    return np.concatenate(parts)[::-1] if parts else np.zeros(0, np.int64)
