"""Range coder for token ids whose predictions of three orders are mixed.

The last two ids and the last one each point at an entry that names the id seen there before and how often in a row it
was right. Order 0 predicts every id by its count in the block so far, and new ids by a fixed rule, under which shares fall
off with the id, as tokenizers number frequent tokens first; the counts take effect whenever the block has doubled. The
range is shared out by weights: per block and confidence, the weights of orders 2 and 1 follow how often such predictions
were right, order 0 has the rest, and new ids get the more of that the more the block has had. An id that several
predictions name is coded by the widest of its slices.

Blocks start from the same model each, which holds nothing of any text, so a block is decoded from its own bytes. They are
coded in lockstep, one lane per block, so every step is a few array operations over all lanes; a block's bytes do not
depend on the other lanes. All arithmetic is on integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

IDS = 1 << 16
SLOTS = 1 << 10
TOTAL_BITS = 30
TOTAL = 1 << TOTAL_BITS
COUNT_BITS = 19
MOST_SURE = 7
SURE_BITS = 3
RATE = 5
RENEW = np.uint64(1 << 32)
LOW_WORD = np.uint64(0xFFFFFFFF)
BITS32 = np.uint64(32)
# First weights of a prediction by confidence, and the most and least a weight may be.
FIRST_WEIGHTS = np.array([TOTAL * (c + 1) // (2 * c + 24) for c in range(MOST_SURE + 1)], np.int64)
# What a weight tends to after wrong and after right predictions.
LIMITS = np.array([TOTAL >> 9, TOTAL - (TOTAL >> 4)], np.int64)

# Order 0 of new ids: shares of 2^19, at least 1 for every id.
NEW_SUMS = np.concatenate([[0], np.cumsum((1 << 24) // (np.arange(IDS) + 64))])
NEW_SUMS = np.arange(IDS + 1) + ((1 << COUNT_BITS) - IDS) * NEW_SUMS // NEW_SUMS[-1]
NEW_ID_AT = np.repeat(np.arange(IDS, dtype=np.int32), np.diff(NEW_SUMS))
# Counts take effect at steps of these powers of two. Order 0's share of known ids is of 2^8, within bounds.
FIRST_RENEWAL, LAST_RENEWAL = 5, 15
SHARE_BITS = 8
LEAST_KNOWN, MOST_KNOWN = 32, 224
LANES_AT_ONCE = 64


def renewals(steps: int) -> Iterator[tuple[int, int, int]]:
    """Spans of steps with one state of order 0: first step, last but one, and bits of the number of ids counted."""
    for bits in range(FIRST_RENEWAL, LAST_RENEWAL + 1):
        if 1 << bits < steps:
            yield 1 << bits, steps if bits == LAST_RENEWAL else min(steps, 2 << bits), bits


def known_share(distinct: np.ndarray, bits: int) -> np.ndarray:
    """Order 0's share of known ids, of 2^8: half as many new ones are awaited as there were."""
    share = (1 << SHARE_BITS) - ((distinct << SHARE_BITS) >> (bits + 1))
    return np.clip(share, LEAST_KNOWN, MOST_KNOWN)


class History:
    """The sorted ids counted of all lanes, and the places of equal ones."""

    def __init__(self, ids: np.ndarray, bits: int):
        lanes, n = ids.shape[1], 1 << bits
        # Of every place the id, the first place of its equals, and the one after their last.
        rows = np.zeros((lanes, n, 4), np.uint16)
        self.share = np.empty(lanes, np.int64)
        place = np.arange(n, dtype=np.uint16)
        for lane in range(0, lanes, LANES_AT_ONCE):
            some = slice(lane, lane + LANES_AT_ONCE)
            ordered = np.sort(ids[:n, some].T, axis=1, kind="stable")
            new = np.ones((len(ordered), n + 1), bool)
            new[:, 1:-1] = ordered[:, 1:] != ordered[:, :-1]
            rows[some, :, 0] = ordered
            rows[some, :, 1] = np.maximum.accumulate(place * new[:, :-1], axis=1)
            ends = np.where(new[:, 1:], place + np.uint16(1), np.uint16(n))
            rows[some, :, 2] = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]
            self.share[some] = known_share(new[:, :-1].sum(axis=1), bits)
        self.rows = rows.view(np.uint64).ravel()

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids and their first and last places, in columns."""
        return self.rows.take(places, mode="clip").view(np.uint16).reshape(-1, 4)


class LaneModel:
    """Predictions of all lanes for their next id. Pairs of rows are of orders 1 and 2."""

    def __init__(self, lanes: int):
        lane = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.entries = np.zeros(2 * lanes * SLOTS, np.int32)
        self.weights = np.tile(FIRST_WEIGHTS, 2 * lanes)
        self.slot_row, self.weight_row = lane * SLOTS, lane << SURE_BITS
        self.at = np.empty((2, lanes), np.int64)
        self.last = self.before = np.zeros(lanes, np.int64)
        self.share = np.zeros(lanes, np.int64)
        self.bits = 0

    def predict(self) -> None:
        """Set the predicted ids and the widths of all orders."""
        at = self.at
        np.multiply(self.last, 40503, out=at[0])
        np.add(at[0], self.before * 31337, out=at[1])
        at >>= 5
        at &= SLOTS - 1
        at += self.slot_row
        self.found = self.entries.take(at, mode="clip")
        self.guess, self.sure = self.found >> SURE_BITS, self.found & MOST_SURE
        self.by = self.weight_row + self.sure
        self.weight = self.weights.take(self.by, mode="clip")
        self.two = self.weight[1]
        self.one = TOTAL - self.two
        self.one *= self.weight[0]
        self.one >>= TOTAL_BITS
        # Slices lie in this order: what order 2, order 1, order 0's counts and order 0's rule predict.
        self.begin_known = self.two + self.one
        self.known = TOTAL - self.begin_known
        self.known *= self.share
        self.known >>= SHARE_BITS
        self.begin_new = self.begin_known + self.known

    def _known_slice(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the slice of counts between two rows of places."""
        cuts = self.known * places
        cuts >>= self.bits
        start, width = cuts
        width -= start
        start += self.begin_known
        return start, width

    def _set_new_slices(self, lanes: np.ndarray, ids: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        after = self.begin_new[lanes]
        new = TOTAL - after
        begin = (new * NEW_SUMS.take(ids)) >> COUNT_BITS
        start[lanes] = after + begin
        width[lanes] = ((new * NEW_SUMS.take(ids + 1)) >> COUNT_BITS) - begin

    def slice_of(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the widest slice of each id, which takes these places among the ids counted (none: new)."""
        self.right = self.guess == ids
        start, width = self._known_slice(places)
        lanes = np.flatnonzero(places[1] == 0)
        self._set_new_slices(lanes, ids[lanes], start, width)
        one = self.right[0] & (self.one > width)
        np.copyto(start, self.two, where=one)
        np.copyto(width, self.one, where=one)
        two = self.right[1] & (self.two > width)
        np.copyto(start, 0, where=two)
        np.copyto(width, self.two, where=two)
        return start, width

    def id_of(self, value: np.ndarray, history: History | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose slice holds each value, and the slice."""
        if history is None:
            found, start, width = np.zeros(len(value), np.int32), *np.zeros((2, len(value)), np.int64)
        else:
            # The last place that starts at or before the value; what other slices make of it is set right after.
            place = value - self.begin_known
            place += 1
            place <<= self.bits
            place -= 1
            # Below 2^53, so the quotient of doubles is exact enough to be cut.
            place = (place / self.known).astype(np.int64)
            place = np.minimum(np.maximum(place, 0), (1 << self.bits) - 1)
            place += self.history_row
            rows = history.at(place)
            found = rows[:, 0].astype(np.int32)
            start, width = self._known_slice(rows.T[1:3])
        lanes = np.flatnonzero(value >= self.begin_new)
        after = self.begin_new[lanes]
        place = (((value[lanes] - after + 1) << COUNT_BITS) - 1) // (TOTAL - after)
        found[lanes] = NEW_ID_AT.take(place, mode="clip")
        self._set_new_slices(lanes, found[lanes], start, width)
        one, two = value < self.begin_known, value < self.two
        for slot, by_one, by_two in ((found, *self.guess), (start, self.two, 0), (width, self.one, self.two)):
            np.copyto(slot, by_one, where=one)
            np.copyto(slot, by_two, where=two)
        self.right = self.guess == found
        return found, start, width

    def learn(self, ids: np.ndarray) -> None:
        """Enter the ids that came (32-bit)."""
        self.entries[self.at] = np.where(self.right, self.found + (self.sure < MOST_SURE), (ids << SURE_BITS) + 1)
        step = np.where(self.right, LIMITS[1], LIMITS[0])
        step -= self.weight
        step >>= RATE
        step += self.weight
        self.weights[self.by] = step
        self.before, self.last = self.last, ids.astype(np.int64)


def ranks_in_lanes(ids: np.ndarray) -> np.ndarray:
    """Place of every id among the distinct ids of its lane."""
    steps, lanes = ids.shape
    kind, low_bits = (np.uint32, 16) if steps <= 1 << 16 else (np.int64, 32)
    keys = ids.T.astype(kind) << kind(low_bits)
    keys |= np.arange(steps, dtype=kind)
    keys.sort(axis=1)
    values = keys >> kind(low_bits)
    ranks = np.zeros(keys.shape, np.int32)
    np.cumsum(values[:, 1:] != values[:, :-1], axis=1, dtype=np.int32, out=ranks[:, 1:])
    keys &= kind((1 << low_bits) - 1)
    at = keys + np.arange(lanes, dtype=np.int64)[:, None] * steps
    out = np.empty(keys.size, np.int32)
    out[at.ravel()] = ranks.ravel()
    return np.ascontiguousarray(out.reshape(lanes, steps).T)


def counted_places(ids: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For every step and lane, where its id stands among the sorted ids counted: first place and the one after its last.

    Also order 0's share of known ids at every renewal. Nothing is counted at first.
    """
    steps, n_lanes = ids.shape
    places = np.zeros((steps, 2, n_lanes), np.uint16)
    shares = {begin: np.empty(n_lanes, np.int64) for begin, _, _ in renewals(steps)}
    for lane in range(0, n_lanes if shares else 0, LANES_AT_ONCE):
        lanes = slice(lane, lane + LANES_AT_ONCE)
        ranks = ranks_in_lanes(ids[:, lanes])
        # A lane's row of counts begins with a zero, so sums up to a rank are of the smaller ones.
        count, width = ranks.shape[1], int(ranks.max()) + 2
        at = ranks + np.arange(count) * width
        counts, done = np.zeros((count, width), np.int64), 0
        for begin, end, bits in renewals(steps):
            counts += np.bincount(at[done:begin].ravel() + 1, minlength=counts.size).reshape(counts.shape)
            done = begin
            shares[begin][lanes] = known_share((counts > 0).sum(axis=1), bits)
            upto = np.cumsum(counts, axis=1).astype(np.uint16).ravel()
            asked = at[begin:end]
            first, stop = upto.take(asked, mode="clip"), upto.take(asked + 1, mode="clip")
            # Ids that are not counted have no places.
            stop *= first != stop
            places[begin:end, 0, lanes], places[begin:end, 1, lanes] = first, stop
    return places, shares


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Bytes of each block of ids (0 to 65535), coded side by side.

    Shorter blocks are filled up with id 0; a decoder stops before those.
    """
    if not blocks:
        return []
    steps, lanes = max(map(len, blocks)), len(blocks)
    ids = np.zeros((steps, lanes), np.int32)
    for lane, block in enumerate(blocks):
        ids[: len(block), lane] = block
    places, shares = counted_places(ids)
    model = LaneModel(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out_lanes, out_words = [], []
    shift = np.uint64(TOTAL_BITS)
    for step in range(steps):
        x = ids[step]
        if step in shares:
            model.share, model.bits = shares[step], step.bit_length() - 1
        model.predict()
        start, width = model.slice_of(x, places[step])
        unit = span >> shift
        low += unit * start.view(np.uint64)
        span = unit * width.view(np.uint64)
        small = np.flatnonzero(span < RENEW)
        if len(small):
            l, s = low[small], span[small]
            over = (l >> BITS32) != ((l + s - np.uint64(1)) >> BITS32)
            s = np.where(over, RENEW - (l & LOW_WORD), s)
            out_lanes.append(small)
            out_words.append((l >> BITS32).astype(np.uint32))
            low[small], span[small] = l << BITS32, s << BITS32
        model.learn(x)
    for word in (low >> BITS32, low & LOW_WORD):
        out_lanes.append(np.arange(lanes))
        out_words.append(word.astype(np.uint32))
    lane_of, words = np.concatenate(out_lanes), np.concatenate(out_words)
    order = np.argsort(lane_of.astype(np.uint16 if lanes < 65536 else np.int64), kind="stable")
    words, counts = words[order].astype("<u4"), np.bincount(lane_of, minlength=lanes)
    ends = np.cumsum(counts)
    return [words[end - n : end].tobytes() for end, n in zip(ends, counts)]


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of each block from its bytes and its number of ids."""
    if not payloads:
        return []
    lanes, steps = len(payloads), max(sizes)
    words = np.frombuffer(b"".join(payloads) + bytes(16), "<u4").astype(np.uint64)
    at = np.cumsum([0, *[len(p) // 4 for p in payloads[:-1]]])
    limit = len(words) - 1
    code = (words[at] << BITS32) | words[np.minimum(at + 1, limit)]
    at = at + 2
    model = LaneModel(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = np.zeros((steps, lanes), np.uint16)
    shift, most = np.uint64(TOTAL_BITS), np.uint64(TOTAL - 1)
    bits_at = {begin: bits for begin, _, bits in renewals(steps)}
    history = None
    for step in range(steps):
        if step in bits_at:
            history = History(out, bits_at[step])
            model.share, model.bits = history.share, bits_at[step]
            model.history_row = np.arange(lanes, dtype=np.int64) << model.bits
        model.predict()
        unit = span >> shift
        value = np.minimum((code - low) // unit, most).view(np.int64)
        x, start, width = model.id_of(value, history)
        low += unit * start.view(np.uint64)
        span = unit * width.view(np.uint64)
        small = np.flatnonzero(span < RENEW)
        if len(small):
            l, s = low[small], span[small]
            over = (l >> BITS32) != ((l + s - np.uint64(1)) >> BITS32)
            s = np.where(over, RENEW - (l & LOW_WORD), s)
            low[small], span[small] = l << BITS32, s << BITS32
            code[small] = (code[small] << BITS32) | words[np.minimum(at[small], limit)]
            at[small] += 1
        out[step] = x
        model.learn(x)
    return [out[:n, lane] for lane, n in enumerate(sizes)]


def checksum(payload: bytes, size: int) -> int:
    return zlib.crc32(payload, size & 0xFFFFFFFF)
