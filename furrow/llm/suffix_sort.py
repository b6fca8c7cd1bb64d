"""Suffix order with common-prefix values by induced sorting.

The text is a sequence of pieces, each closed by a separator; separators are smaller than all characters and ordered by
place, so no common prefix crosses one. Suffixes of the kind that starts a rise after a fall (seeds) are ordered first:
their substrings up to the next seed are named, and the string of names is ordered in turn, by recursion while it is
long. All other suffixes are induced from sorted ones: what precedes a suffix is put into a queue under its own first
character, with its common prefix with what was put there before. Queues hold runs of tuples per first character,
in order, and move runs to disk beyond a memory budget.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR = 0
RECURSE_ABOVE = 1 << 22
QUEUE_BYTES = 128 << 20


class RunQueue:
    """Monotone priority queue of (position, common prefix) tuples in runs per symbol."""

    def __init__(self, descending: bool = False, memory: int = 0):
        self.sign = -1 if descending else 1
        self.memory = memory or QUEUE_BYTES
        self.runs: dict[int, list] = {}
        self.heap: list[int] = []
        self.held = 0
        self.file = None

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        if symbol not in self.runs:
            self.runs[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        run = np.stack([position, common])
        self.runs[symbol].append(run)
        self.held += run.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        """Move the runs that are wanted last to disk until half of the budget is free."""
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffix-queue-")
        for symbol in sorted(self.runs, key=lambda s: self.sign * s, reverse=True):
            for i, run in enumerate(self.runs[symbol]):
                if isinstance(run, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(run.tobytes())
                    self.runs[symbol][i] = (at, run.shape[1])
                    self.held -= run.nbytes
            if self.held <= self.memory // 2:
                return

    def least(self) -> int | None:
        """The symbol whose runs come next."""
        while self.heap and self.sign * self.heap[0] not in self.runs:
            heapq.heappop(self.heap)
        return self.sign * self.heap[0] if self.heap else None

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of a symbol, in the order they were put."""
        runs = self.runs.pop(symbol, None)
        if not runs:
            return None
        loaded = []
        for run in runs:
            if isinstance(run, tuple):
                self.file.seek(run[0])
                loaded.append(np.frombuffer(self.file.read(run[1] * 16), np.int64).reshape(2, -1))
            else:
                self.held -= run.nbytes
                loaded.append(run)
        both = loaded[0] if len(loaded) == 1 else np.concatenate(loaded, axis=1)
        return both[0], both[1]


class _Inducer:
    """Puts what precedes scanned suffixes into a queue, with common prefixes up to ``cap`` (none if 0)."""

    def __init__(self, text: np.ndarray, rises: np.ndarray, descending: bool, cap: int):
        self.text, self.rises, self.descending, self.cap = text, rises, descending, cap
        self.queue = RunQueue(descending)
        # Least common prefix of the suffixes scanned since the last one put under each character.
        self.since = np.full(256, cap, np.int64) if cap else None

    def put(self, position: np.ndarray, common: np.ndarray) -> None:
        """``common`` is between each suffix and the one scanned before it."""
        before = position - 1
        wanted = self.rises[before] == self.descending
        wanted &= position > 0
        if self.descending:
            wanted &= self.text[before] != SEPARATOR
        places = np.flatnonzero(wanted)
        if not len(places):
            if self.cap:
                np.minimum(self.since, common.min(), out=self.since)
            return
        symbols = self.text[before[places]]
        order = np.argsort(symbols, kind="stable")
        ordered = symbols[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        ends = np.r_[starts[1:], len(ordered)]
        after = np.minimum(self.since, common.min()) if self.cap else None
        for start, end in zip(starts, ends):
            symbol, chosen = int(ordered[start]), places[order[start:end]]
            prefix = np.zeros(len(chosen), np.int64)
            if self.cap:
                least = np.minimum.reduceat(common[: chosen[-1] + 1], np.r_[0, chosen[:-1] + 1])
                least[0] = min(least[0], self.since[symbol])
                prefix = np.minimum(least + 1, self.cap)
                rest = common[chosen[-1] + 1 :]
                after[symbol] = rest.min() if len(rest) else self.cap
            self.queue.push(symbol, before[chosen], prefix)
        if self.cap:
            self.since = after


def _shape(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every position the length of its run of one symbol, and whether the suffix rises after it."""
    n = len(text)
    change = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    ends = np.repeat(change, np.diff(np.r_[-1, change]))
    follows = np.minimum(ends + 1, n - 1)
    rises = text < text[follows]
    rises[ends == n - 1] = True
    return ends + 1 - np.arange(n), rises


def _refined(names: np.ndarray, chosen: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the groups of ``chosen`` by ``key``; a name is the number of elements before its group.

    Returns those of ``chosen`` whose group still has several members.
    """
    order = np.lexsort((key, names[chosen]))
    chosen, key, group = chosen[order], key[order], names[chosen[order]]
    new_group = np.r_[True, group[1:] != group[:-1]]
    new = new_group | np.r_[True, key[1:] != key[:-1]]
    at = np.arange(len(chosen))
    group_start = np.maximum.accumulate(np.where(new_group, at, 0))
    start = np.maximum.accumulate(np.where(new, at, 0))
    names[chosen] = group + start - group_start
    alone = new & np.r_[new[1:], True]
    return chosen[~alone]


def _seed_names(text: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the substrings from each seed to the next, in their order; and the seeds that share a name.

    A substring that ends sorts after one that goes on, so the end is filled with the greatest symbol.
    """
    sizes = np.diff(seeds, append=seeds[-1]) + 1
    wide = text.dtype != np.uint8
    step = 1 if wide else 8
    padded = np.concatenate([text, np.zeros(8, text.dtype)])

    def word(chosen: np.ndarray, r: int) -> np.ndarray:
        left = sizes[chosen] - r * step
        at = np.minimum(seeds[chosen] + r * step, len(text) - 1)
        if wide:
            return np.where(left > 0, text[at], np.iinfo(np.int64).max)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        key = np.ascontiguousarray(windows[at]).view(">u8").ravel().astype(np.uint64)
        missing = (8 * np.clip(8 - left, 0, 8)).astype(np.uint64)
        fill = np.where(missing >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (missing % np.uint64(64))) - np.uint64(1))
        return key | fill

    every = np.arange(len(seeds))
    names = np.zeros(len(seeds), np.int64)
    shared = _refined(names, every, word(every, 0))
    ended = text[seeds] == SEPARATOR if not wide else np.zeros(len(seeds), bool)
    if ended.any():
        # Separators are ordered by place.
        names[ended] = np.arange(ended.sum())
        shared = shared[~ended[shared]]
    r, open_groups = 1, shared
    while len(open_groups):
        longer = np.unique(names[open_groups[sizes[open_groups] > r * step]])
        if not len(longer):
            break
        open_groups = open_groups[np.isin(names[open_groups], longer)]
        open_groups = _refined(names, open_groups, word(open_groups, r))
        r += 1
    counts = np.bincount(names, minlength=len(names))
    return names, every[counts[names] > 1]


def seed_ranks(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Rank of every seed's suffix among seeds."""
    names, shared = _seed_names(text, seeds)
    if not len(shared):
        return names
    if len(seeds) > RECURSE_ABOVE:
        reduced = np.concatenate([names + 1, [0]])
        ranks = np.empty(len(reduced), np.int64)
        ranks[np.concatenate([p for p, _ in suffixes(reduced, 0)])] = np.arange(len(reduced))
        return ranks[:-1] - 1
    ranks, reach = names, 1
    while len(shared):
        beyond = shared + reach
        key = np.where(beyond < len(ranks), ranks[np.minimum(beyond, len(ranks) - 1)], -1)
        shared = _refined(ranks, shared, key)
        reach *= 2
    return ranks


def _matching(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Number of equal characters from positions a and b on, up to ``cap``; whole separators may match."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.full(len(a), cap, np.int64)
    left = np.arange(len(a))
    for at in range(0, cap, 8):
        x, y = np.minimum(a[left] + at, len(text)), np.minimum(b[left] + at, len(text))
        differ = windows[x] != windows[y]
        some = differ.any(axis=1)
        out[left[some]] = np.minimum(at + differ[some].argmax(axis=1), cap)
        left = left[~some]
        if not len(left):
            break
    return out


def suffixes(text: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` in order: positions and common prefixes with the suffix before, up to ``cap``.

    Blocks of one first symbol come in ascending order if ``cap`` is 0 (common prefixes are then 0), else in descending
    order; within a block suffixes ascend. ``text`` is bytes with 0 as separator, ending in one, or
    numbers ending in the only 0.
    """
    run, rises = _shape(text)
    position = np.arange(len(text))
    seeds = np.flatnonzero(rises & np.r_[False, ~rises[:-1]])
    if not len(seeds):
        seeds = np.array([len(text) - 1])
    ranks = seed_ranks(text, seeds)
    ordered = np.empty_like(seeds)
    ordered[ranks] = seeds
    common = np.zeros(len(ordered), np.int64)
    if cap:
        stops = np.flatnonzero(text == SEPARATOR)
        to_stop = stops[np.searchsorted(stops, ordered)] - ordered
        common[1:] = _matching(text, ordered[:-1], ordered[1:], cap)
        common[1:] = np.minimum(common[1:], np.minimum(to_stop[:-1], to_stop[1:]))
    del position
    first = text[ordered]
    bounds = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    blocks = {int(first[b]): slice(b, e) for b, e in zip(bounds, np.r_[bounds[1:], len(ordered)])}

    def meeting(a: int, b: int) -> int:
        return int(min(run[a], run[b], cap))

    # Falling suffixes, from the least first symbol up.
    falling, done = RunQueue(), _Inducer(text, rises, False, cap)
    pending = sorted(blocks, reverse=True)
    while True:
        options = [s for s in (done.queue.least(), pending[-1] if pending else None) if s is not None]
        if not options:
            break
        symbol, last, begun = min(options), None, False
        while (batch := done.queue.take(symbol)) is not None:
            at, shared = batch
            if not begun:
                shared = np.r_[0, shared[1:]]
                begun = True
            falling.push(symbol, at, shared)
            done.put(at, shared)
            last = at[-1]
        if pending and pending[-1] == symbol:
            block = blocks[pending.pop()]
            shared = common[block].copy()
            shared[0] = meeting(last, ordered[block.start]) if last is not None and cap else 0
            done.put(ordered[block], shared)
    # Rising suffixes, from the greatest first symbol down.
    rising, symbols = _Inducer(text, rises, True, cap), sorted(falling.runs)
    results = []
    while True:
        options = [s for s in (rising.queue.least(), symbols[-1] if symbols else None) if s is not None]
        if not options:
            break
        symbol, parts = max(options), []
        while (batch := rising.queue.take(symbol)) is not None:
            at, shared = batch
            if not parts:
                shared = np.r_[0, shared[1:]]
            parts.append((at, shared))
            rising.put(at, shared)
        up = np.concatenate([p[0] for p in parts])[::-1] if parts else np.array([], np.int64)
        up_shared = np.concatenate([p[1] for p in parts])[::-1] if parts else np.array([], np.int64)
        # Going down, a value is with the greater neighbour; going up, with the smaller one.
        up_shared = np.r_[0, up_shared[:-1]] if len(up) else up_shared
        down, down_shared = np.array([], np.int64), np.array([], np.int64)
        if symbols and symbols[-1] == symbol:
            symbols.pop()
            down, down_shared = falling.take(symbol)
            joint = meeting(down[-1], up[0]) if len(up) and cap else 0
            rising.put(down[::-1], np.r_[joint, down_shared[:0:-1]])
            if len(up):
                up_shared[0] = joint
        block = np.concatenate([down, up]), np.concatenate([down_shared, up_shared])
        if cap:
            yield block
        else:
            results.append(block)
    if not cap:
        yield np.array([len(text) - 1]), np.array([0])
        yield from reversed(results)


def repeated(pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose string of ``size`` bytes also starts at an earlier place of ``pieces``.

    Returns piece numbers and offsets, in order. Bytes are UTF-8, which has no byte over 0xFD.
    """
    if not pieces:
        return np.array([], np.int64), np.array([], np.int64)
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    text = joined + np.uint8(1)
    marked = []
    for at, shared in suffixes(text, size):
        same = shared >= size
        if not same.any():
            continue
        start = np.flatnonzero(~same)
        least = np.minimum.reduceat(at, start)
        counts = np.diff(np.r_[start, len(at)])
        earliest = np.repeat(least, counts)
        member = same | np.r_[same[1:], False]
        marked.append(at[member & (at != earliest)])
    places = np.sort(np.concatenate(marked)) if marked else np.array([], np.int64)
    stops = np.flatnonzero(text == SEPARATOR)
    number = np.searchsorted(stops, places)
    return number, places - np.r_[0, stops[:-1] + 1][number]
