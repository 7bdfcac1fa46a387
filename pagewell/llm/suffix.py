"""Suffix order and common prefixes of a shard of bytes by recursive induced sorting, with queues on disk."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

# Suffix tuples that the queues of one induction keep in memory; the rest is in the task's scratch file.
QUEUE_TUPLES = 1 << 18
_READ = 1 << 18
# A queue's tuple is a position and, in the low bits, its common prefix with the tuple before it.
_PREFIX_BITS = 24
_LONGEST = (1 << _PREFIX_BITS) - 1
# Names that are symbols of the shorter string as they are; more of them become two digits each.
# Symbols have 16 bits.
_SYMBOLS = 4096
# Names that are ranked in memory, where recursion ends.
MEMORY_NAMES = 1 << 20

Block = tuple[np.ndarray, np.ndarray]


def scratch_array(n: int, dtype) -> np.ndarray:
    """Zeros in an unnamed file of the task, so that memory holds only the pages in use."""
    if n == 0:
        return np.zeros(0, dtype=dtype)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(dtype).itemsize)
    return np.memmap(file, dtype=dtype, mode="r+", shape=(n,))


class _Queues:
    """First-in, first-out queues of suffix tuples, one per symbol, as runs that are sorted by symbol.

    Induction reaches the suffixes of a bucket in their final order, so a tuple's priority is its
    bucket and its turn there. What is pushed is gathered and becomes a run; beyond ``limit`` tuples in
    memory, runs go to one unnamed scratch file and are read back in blocks.
    """

    def __init__(self, symbols: int, limit: int) -> None:
        self._bounds = np.arange(symbols + 1)
        self._limit, self._held, self._gathered, self._file = limit, 0, 0, None
        self._pushed: list[Block] = []
        # Where each symbol begins in a run, and its tuples or their place in the file. Runs in memory come last.
        self._runs: list[tuple[np.ndarray, np.ndarray | int]] = []

    def push(self, symbol: np.ndarray, tuples: np.ndarray) -> None:
        """Tuples that are sorted by ``symbol``."""
        if len(tuples):
            self._pushed.append((symbol, tuples))
            self._gathered += len(tuples)
            if self._gathered > self._limit:
                self._settle()
                self._spill()

    def _settle(self) -> None:
        if self._pushed:
            symbol, tuples = self._pushed[0]
            if len(self._pushed) > 1:
                symbol, tuples = (np.concatenate(c) for c in zip(*self._pushed))
                order = np.argsort(symbol, kind="stable")
                symbol, tuples = symbol[order], tuples[order]
            self._runs.append((np.searchsorted(symbol, self._bounds), tuples))
            self._held += len(tuples)
            self._pushed, self._gathered = [], 0

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        at = self._file.seek(0, 2)
        for i, (bounds, tuples) in enumerate(self._runs):
            if isinstance(tuples, np.ndarray):
                self._file.write(tuples.tobytes())
                self._runs[i] = (bounds, at)
                at += 8 * len(tuples)
        self._held = 0

    def _merge(self) -> None:
        """The runs in memory become one."""
        first = next((i for i, run in enumerate(self._runs) if isinstance(run[1], np.ndarray)), len(self._runs))
        part = self._runs[first:]
        if len(part) > 1:
            symbol = np.concatenate([np.repeat(self._bounds[:-1].astype(np.uint16), np.diff(bounds)) for bounds, _ in part])
            order = np.argsort(symbol, kind="stable")
            tuples = np.concatenate([t for _, t in part])[order]
            self._runs[first:] = [(np.searchsorted(symbol[order], self._bounds), tuples)]

    def _parts(self, symbol: int, first: int, step: int = 1) -> Iterator[np.ndarray]:
        held, n = [], 0
        for bounds, tuples in self._runs[first:][::step]:
            a, b = int(bounds[symbol]), int(bounds[symbol + 1])
            for begin in range(a, b, _READ)[::step]:
                end = min(b, begin + _READ)
                if isinstance(tuples, np.ndarray):
                    block = tuples[begin:end]
                else:
                    self._file.seek(tuples + 8 * begin)
                    block = np.frombuffer(self._file.read(8 * (end - begin)), np.int64)
                held.append(block[::step])
                n += len(block)
                if n >= _READ:
                    yield np.concatenate(held)
                    held, n = [], 0
        if held:
            yield np.concatenate(held)

    def taken(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of a queue in order; what is pushed meanwhile comes last."""
        self._settle()
        if self._held > self._limit:
            self._merge()
            self._spill()
        first = 0
        while first < len(self._runs):
            now = len(self._runs)
            yield from self._parts(symbol, first)
            self._settle()
            first = now

    def backwards(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of a queue that takes no more, from its end."""
        self._settle()
        yield from self._parts(symbol, 0, -1)


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first..last]`` of each pair; only one width of spans is held at a time."""
    if len(values) == 1:
        return values[first]
    out = np.empty(len(first), dtype=values.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    for k in range(len(cuts) - 1):
        if k:
            half = 1 << (k - 1)
            values = np.minimum(values[:-half], values[half:])
        at = order[cuts[k] : cuts[k + 1]]
        out[at] = np.minimum(values[first[at]], values[last[at] - (1 << k) + 1])
    return out


def _heads(symbol: np.ndarray) -> np.ndarray:
    """Where the runs of sorted symbols begin."""
    new = np.empty(len(symbol), dtype=bool)
    new[0] = True
    np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
    return np.flatnonzero(new)


class _Passed:
    """Common prefixes of the tuples that one scan pushes.

    Two suffixes pushed to one queue have the symbol in common and whatever the suffixes behind them have: the least
    prefix met in the scan between these. ``_least`` holds the falling-out minima of the blocks since any of them.
    """

    def __init__(self, symbols: int) -> None:
        self._tail = np.zeros(symbols, dtype=np.int64)
        self._since = np.full(symbols, -1, dtype=np.int64)
        self._least: list[tuple[int, int]] = []
        self._block = 0

    def prefixes(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of the tuples pushed from places ``at`` of a block, in the order of ``symbol`` and place."""
        got = np.zeros(len(at), dtype=np.int64)
        if len(at):
            heads = _heads(symbol)
            first = np.empty_like(at)
            first[1:] = at[:-1] + 1
            first[heads] = 0
            got = range_minima(lcp, first, at) + 1
            own = symbol[heads]
            before = self._tail[own]
            if self._least:
                blocks, minima = np.array(self._least).T
                near = np.searchsorted(blocks, self._since[own], side="right")
                before = np.minimum(before, np.append(minima, _LONGEST)[near])
            got[heads] = np.where(self._since[own] < 0, 0, np.minimum(got[heads], before + 1))
            tails = np.append(np.minimum.accumulate(lcp[::-1])[::-1], _LONGEST)
            self._tail[own] = tails[at[np.append(heads[1:], len(at)) - 1] + 1]
            self._since[own] = self._block
        low = int(lcp.min())
        while self._least and self._least[-1][1] >= low:
            self._least.pop()
        self._least.append((self._block, low))
        self._block += 1
        return np.minimum(got, _LONGEST)


def _smaller(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where a suffix is smaller than the next one, and the length of each run of one symbol.

    The last symbol is a single least one.
    """
    n = len(text)
    small, run = scratch_array(n, bool), scratch_array(n, np.int32)
    small[-1], run[-1] = True, 1
    if n > 1:
        at = np.where(text[1:] != text[:-1], np.arange(n - 1), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        small[:-1] = text[nearest + 1] > text[nearest]
        run[:-1] = nearest + 1 - np.arange(n - 1)
    return small, run


class _Text:
    """A string of symbols, its kinds of suffixes and runs, and the induction over it."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, limit: int, memory: int) -> None:
        self.text, self.symbols, self.depth, self.limit, self.memory = text, symbols, depth, limit, memory
        self.small, self.run = _smaller(text)
        self.seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        if len(self.seeds) == 0:
            self.seeds = np.array([len(text) - 1])

    def _meeting(self, a: int | None, b: int) -> int:
        """Common prefix of two suffixes of different kind with one first symbol, 0 without the first."""
        return 0 if a is None else min(int(self.run[a]), int(self.run[b]), _LONGEST)

    def _against(self, blocks: Iterator[np.ndarray], near: int | None) -> Iterator[Block]:
        """A queue from its end: prefixes are those with the suffix read before, at first with ``near``."""
        carried = None
        for block in blocks:
            at, lcp = block >> _PREFIX_BITS, block & _LONGEST
            if carried is None:
                carried = self._meeting(near, int(at[0]))
            shifted = np.empty_like(lcp)
            shifted[0], shifted[1:] = carried, lcp[:-1]
            yield at, shifted
            carried = int(lcp[-1])

    def induced(self, seeds: np.ndarray, prefixes: np.ndarray | None) -> Iterator[Block]:
        """All suffixes and their common prefixes in the order that the order of ``seeds`` induces."""
        text, small = self.text, self.small
        large_queues, small_queues = (_Queues(self.symbols, self.limit) for _ in range(2))
        passed = [_Passed(self.symbols) for _ in range(2)] if prefixes is not None else None

        def pass_on(block: np.ndarray, lcp: np.ndarray, want_small: bool) -> None:
            at = np.flatnonzero(block > 0)
            before = block[at] - 1
            fits = small[before] == want_small
            at, before = at[fits], before[fits]
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            at, before, symbol = at[order], before[order], symbol[order]
            tuples = before << _PREFIX_BITS
            if passed is not None:
                tuples |= passed[want_small].prefixes(lcp, at, symbol)
            (small_queues if want_small else large_queues).push(symbol, tuples)

        symbol = text[seeds]
        order = np.argsort(symbol, kind="stable")
        ends = np.searchsorted(symbol[order], np.arange(self.symbols + 1))
        for c in range(self.symbols):
            last = None
            for block in large_queues.taken(c):
                at = block >> _PREFIX_BITS
                pass_on(at, block & _LONGEST, False)
                last = int(at[-1])
            own = order[ends[c] : ends[c + 1]]
            if len(own):
                lcp = np.zeros(len(own), dtype=np.int64) if prefixes is None else prefixes[own]
                lcp[0] = self._meeting(last, int(seeds[own[0]]))
                pass_on(seeds[own], lcp, False)
        small_queues.push(text[-1:], np.array([(len(text) - 1) << _PREFIX_BITS]))
        for c in reversed(range(self.symbols)):
            last = None
            for block in small_queues.taken(c):
                at = block >> _PREFIX_BITS
                pass_on(at, block & _LONGEST, True)
                last = int(at[-1])
            for at, lcp in self._against(large_queues.backwards(c), last):
                pass_on(at, lcp, True)
        for c in range(self.symbols):
            last = None
            for block in large_queues.taken(c):
                at = block >> _PREFIX_BITS
                yield at, block & _LONGEST
                last = int(at[-1])
            yield from self._against(small_queues.backwards(c), last)

    def substrings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the substrings from seed to seed, their order, and what neighbours have in common by kind and symbol."""
        seeds, n = self.seeds, len(self.seeds)
        is_seed = np.zeros(len(self.text), dtype=bool)
        is_seed[seeds] = True
        found = np.concatenate([b[is_seed[b]] for b, _ in self.induced(seeds, None)])
        by_order = np.searchsorted(seeds, found)
        size = np.r_[np.diff(seeds) + 1, 1]
        both = self.text.astype(np.int64) * 2 + self.small
        common = np.zeros(n, dtype=np.int64)
        shorter = np.minimum(size[by_order[1:]], size[by_order[:-1]])
        pair, at = np.arange(n - 1), 0
        while len(pair):
            pair = pair[both[found[pair] + at] == both[found[pair + 1] + at]]
            at += 1
            common[pair + 1] = at
            pair = pair[shorter[pair] > at]
        # No substring is the beginning of another one, so equal as far as the shorter reaches is equal.
        new = np.r_[True, common[1:] < shorter]
        names = np.empty(n, dtype=np.int64)
        names[by_order] = np.cumsum(new) - 1
        return names, by_order, common[new]

    def sorted_seeds(self) -> Block:
        """The seeds in suffix order, with their common prefixes."""
        seeds = self.seeds
        names, order, common = self.substrings()
        if len(common) == len(names):
            same = np.zeros(len(names) - 1, dtype=np.int64)
        else:
            # Two neighbouring seeds are at least two symbols apart.
            order, same = _sorted_names(names, len(common), self.depth // 2 + 2, self.limit, self.memory)
        # Behind the names that two neighbours share, two names differ: by a symbol, or by a kind of suffix.
        a, b = order[:-1], order[1:]
        below, above = names[a + same], names[b + same]
        known = below < above  # else the two agree beyond the depth
        lcp = seeds[a + same] - seeds[a]
        lcp[known] += range_minima(common, below[known] + 1, above[known])
        x, y = seeds[a] + lcp, seeds[b] + lcp
        lcp += np.where(self.text[x] == self.text[y], np.minimum(self.run[x], self.run[y]), 0)
        return seeds[order], np.minimum(np.r_[0, lcp], _LONGEST)


def _ranked_names(names: np.ndarray, depth: int) -> Block:
    """As :func:`_sorted_names`, by ranks of doubled spans in memory."""
    ranks, span = [names.astype(np.int32)], 1
    while span < depth and ranks[-1].max() + 1 < len(names):
        rank, then = ranks[-1], np.zeros(len(names), dtype=np.int64)
        then[:-span] = rank[span:] + 1
        key = rank * np.int64(len(names) + 2) + then
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        ranks.append(rank)
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(ranks))):
        equal = ranks[k][a] == ranks[k][b]
        same[equal] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
    return order, same


def _sorted_names(names: np.ndarray, known: int, depth: int, limit: int, memory: int) -> Block:
    """Places of ``names`` in suffix order, and how many names neighbours have in common; the last name is a single 0."""
    n = len(names)
    if n <= memory:
        return _ranked_names(names, depth)
    if known <= _SYMBOLS:
        digits, symbols = 1, known
        string = names
    else:
        digits, radix = 2, int(np.ceil(np.sqrt(known)))
        symbols = radix + 1
        string = np.r_[np.stack([names[:-1] // radix + 1, names[:-1] % radix + 1], axis=1).ravel(), 0]
    order, same = scratch_array(n, np.int64), scratch_array(n, np.int64)
    done, low = 0, _LONGEST
    for at, lcp in suffix_blocks(string.astype(np.uint16), symbols, digits * depth, limit, memory):
        kept = np.flatnonzero(at % digits == 0)
        if len(kept):
            least = np.minimum.reduceat(lcp[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
            least[0] = min(least[0], low)
            order[done : done + len(kept)] = at[kept] // digits
            same[done : done + len(kept)] = least // digits
            done += len(kept)
            low = int(lcp[kept[-1] + 1 :].min(initial=_LONGEST))
        else:
            low = min(low, int(lcp.min()))
    return order, same[1:]


def suffix_blocks(
    text: np.ndarray, symbols: int, depth: int, limit: int = QUEUE_TUPLES, memory: int = MEMORY_NAMES
) -> Iterator[Block]:
    """Positions of all suffixes of ``text``, each with its common prefix with the one before it.

    They are ordered by their first ``depth`` symbols at least, and a common prefix is exact up to there.

    ``text`` ends in a single 0, and its symbols are below ``symbols``. The leftmost small suffixes of
    each rise are sorted first: one induction orders the substrings between them, their names form
    a shorter string that is sorted likewise, and a second induction carries order and prefixes to all.
    """
    whole = _Text(text, symbols, depth, limit, memory)
    yield from whole.induced(*whole.sorted_seeds())


def repeated_starts(
    segments: list[bytes], width: int, limit: int = QUEUE_TUPLES, memory: int = MEMORY_NAMES
) -> list[np.ndarray]:
    """For each segment the starts of its strings of ``width`` bytes that start elsewhere too.

    Two such strings are neighbours in suffix order, with at least ``width`` bytes in common.
    """
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    text = scratch_array(int(sizes.sum()) + len(segments), np.uint16)
    valid, hit = scratch_array(len(text), bool), scratch_array(len(text), bool)
    for at, segment in zip(begin.tolist(), segments):
        text[at : at + len(segment)] = np.frombuffer(segment, dtype=np.uint8)
        text[at : at + len(segment)] += 2
        text[at + len(segment)] = 1
        valid[at : at + max(0, len(segment) - width + 1)] = True
    text[-1] = 0
    last, low = None, 0
    for at, lcp in suffix_blocks(text, 258, width, limit, memory):
        kept = np.flatnonzero(valid[at])
        if len(kept):
            least = np.minimum.reduceat(lcp[: kept[-1] + 1], np.r_[0, kept[:-1] + 1])
            least[0] = min(least[0], low)
            again = least >= width
            own = at[kept]
            hit[own[again]] = True
            hit[np.r_[own[0] if last is None else last, own[:-1]][again]] = True
            last, low = own[-1], int(lcp[kept[-1] + 1 :].min(initial=_LONGEST))
        else:
            low = min(low, int(lcp.min()))
    at = np.flatnonzero(hit)
    owner = np.searchsorted(begin, at, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(1, len(segments)))
    return [part - begin[i] for i, part in enumerate(np.split(at, cuts))]
