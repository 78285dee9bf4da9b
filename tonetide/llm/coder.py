"""An adaptive range coder for token ids, run over many independent blocks in step.

A block starts with an empty model. For each id, the last successors of the two ids before
(order 2) and of the one before (order 1) are predictions with a confidence; order 0 is the
adaptive distribution of magnitudes. Which of the three gives the id is coded with frequencies
that mix two adaptive tables, one chosen by the confidence of order 2, one by that of order 1
and whether both agree. An id that neither context predicts is coded as its magnitude (number
of binary digits, adaptive) and its lower digits.

numpy handles step t of all blocks at once, so the cost of Python is shared by as many blocks
as there are. Only integers are used: every machine decodes what any other encoded.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
SLOTS = 2048
#: Ids have at most this many binary digits.
DIGITS = 20
#: Frequencies are out of 2 ** SCALE, and worked out anew after so many steps.
SCALE = 12
REFRESH = 32
_U = np.uint64
_FULL, _HALF, _LOW, _ONE = _U(0xFFFFFFFFFFFFFFFF), _U(32), _U(0xFFFFFFFF), _U(1)
_SCALE = _U(SCALE)
_MAGNITUDE = np.array([n.bit_length() for n in range(1 << DIGITS)])
#: Confidence (0 to 3) after a miss and after a hit.
_SURE = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32)


class _Frequencies:
    """Adaptive cumulative frequencies of ``kinds`` outcomes, for many rows."""

    def __init__(self, rows: int, kinds: int, total: int):
        self.counts = np.ones((rows, kinds), np.int64)
        self.flat = self.counts.reshape(-1)
        self.kinds, self.total = kinds, total
        self.refresh()

    def refresh(self) -> None:
        share = self.counts * (self.total - self.kinds)
        share //= self.counts.sum(axis=1, keepdims=True)
        share += 1
        ends = np.cumsum(share, axis=1)
        ends[:, -1] = self.total
        #: by outcome, contiguous over rows: where it ends
        self.ends = np.ascontiguousarray(ends.T).astype(_U)
        self.counts -= self.counts >> 2


class _Model:
    """What all lanes (blocks) have learned so far."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes) * SLOTS
        self.lane4, self.lane8 = np.arange(lanes) * 4, np.arange(lanes) * 8
        self.lanes_sizes = np.arange(lanes) * (DIGITS + 1)
        #: last successor of a context and, in the two lowest digits, the confidence in it
        self.next2, self.next1 = (np.zeros(lanes * SLOTS, np.int32) for _ in range(2))
        half = 1 << (SCALE - 1)
        self.by_two = _Frequencies(lanes * 4, 3, half)
        self.by_one = _Frequencies(lanes * 8, 3, half)
        self.sizes = _Frequencies(lanes, DIGITS + 1, 1 << SCALE)
        self.steps = 0

    def predict(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the outcomes "order 2" and "order 1" end, out of 2 ** SCALE, after ids a, b."""
        h = a * 40503 + b * 30011
        h ^= h >> 9
        self.two = self.base + (h & (SLOTS - 1))
        self.one = self.base + ((b ^ (b >> 11)) & (SLOTS - 1))
        seen2, seen1 = self.next2.take(self.two), self.next1.take(self.one)
        self.guess2, self.guess1 = seen2 >> 2, seen1 >> 2
        self.was2, self.was1 = seen2 & 3, seen1 & 3
        self.row2 = self.lane4 + self.was2
        self.row1 = self.lane8 + self.was1
        self.row1 += (self.guess1 == self.guess2) * 4
        first = self.by_two.ends[0].take(self.row2) + self.by_one.ends[0].take(self.row1)
        second = self.by_two.ends[1].take(self.row2) + self.by_one.ends[1].take(self.row1)
        return first, second

    def learn(self, x: np.ndarray, event: np.ndarray) -> None:
        self.by_two.flat[self.row2 * 3 + event] += 8
        self.by_one.flat[self.row1 * 3 + event] += 8
        x = x.astype(np.int32)
        for table, slot, guess, was in (
            (self.next2, self.two, self.guess2, self.was2),
            (self.next1, self.one, self.guess1, self.was1),
        ):
            sure = _SURE.take((guess == x) * 4 + was)
            table[slot] = (np.where(was > 1, guess, x) << 2) | sure
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in (4, 8, 16):
            self.by_two.refresh()
            self.by_one.refresh()
            self.sizes.refresh()

    def learn_size(self, lanes: np.ndarray, digits: np.ndarray) -> None:
        self.sizes.flat[self.lanes_sizes[lanes] + digits] += 8


def _settled(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes whose range has a settled top half; small ranges over a border are cut to one side."""
    small = np.flatnonzero(width <= _LOW)
    if len(small):
        below = low[small]
        over = ((below ^ (below + width[small] - _ONE)) >> _HALF) != 0
        cut = small[over]
        width[cut] = (~low[cut] + _ONE) & _LOW
    return small


class _Writer:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _FULL)
        self.words = np.zeros((lanes, 2 * BLOCK + 4), np.uint32)
        self.used = np.zeros(lanes, np.int64)

    def shift(self, lanes, low, width):
        """Ranges below 2 ** 32 hand out their top half."""
        full = _settled(low, width)
        if len(full):
            some = full if lanes is None else lanes[full]
            self.words[some, self.used[some]] = low[full] >> _HALF
            self.used[some] += 1
            low[full] <<= _HALF
            width[full] <<= _HALF

    def end(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for part in (self.low >> _HALF, self.low & _LOW):
            self.words[lanes, self.used] = part
            self.used += 1
        return [w[:n].astype("<u4").tobytes() for w, n in zip(self.words, self.used)]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        size = max(len(p) for p in payloads) // 4 + 2
        self.words = np.zeros((len(payloads), size), _U)
        for row, p in zip(self.words, payloads):
            row[: len(p) // 4] = np.frombuffer(p, "<u4")
        self.low, self.range = np.zeros(len(payloads), _U), np.full(len(payloads), _FULL)
        self.code = (self.words[:, 0] << _HALF) | self.words[:, 1]
        self.used = np.full(len(payloads), 2, np.int64)

    def shift(self, lanes, low, width):
        full = _settled(low, width)
        if len(full):
            some = full if lanes is None else lanes[full]
            self.code[some] = (self.code[some] << _HALF) | self.words[some, self.used[some]]
            self.used[some] += 1
            low[full] <<= _HALF
            width[full] <<= _HALF


_TOP = _U(1 << SCALE)
_ZERO = _U(0)


def _interval(event, first, second):
    start = np.where(event == 0, _ZERO, np.where(event == 1, first, second))
    end = np.where(event == 0, first, np.where(event == 1, second, _TOP))
    return start, end - start


def _put_event(coder, start, size) -> None:
    unit = coder.range >> _SCALE
    coder.low += unit * start
    coder.range = unit * size
    coder.shift(None, coder.low, coder.range)


def _put_new(coder, lanes, low, unit, rest, value) -> None:
    """The lower digits of a new id, after its magnitude has left ``unit`` of the range."""
    unit = unit >> rest
    low += unit * value
    coder.shift(lanes, low, unit)
    coder.low[lanes], coder.range[lanes] = low, unit


def _encode(blocks: np.ndarray) -> list[bytes]:
    model, out = _Model(len(blocks)), _Writer(len(blocks))
    a = b = np.zeros(len(blocks), np.int64)
    for x in np.ascontiguousarray(blocks.T):
        first, second = model.predict(a, b)
        event = np.where(model.guess2 == x, 0, np.where(model.guess1 == x, 1, 2))
        _put_event(out, *_interval(event, first, second))
        new = np.flatnonzero(event == 2)
        if len(new):
            value = x[new]
            digits = _MAGNITUDE[value]
            end = model.sizes.ends[digits, new]
            start = np.where(digits > 0, model.sizes.ends[digits - 1, new], _ZERO)
            unit = out.range[new] >> _SCALE
            low = out.low[new] + unit * start
            rest = np.maximum(digits - 1, 0).astype(_U)
            lower = (value - ((1 << digits) >> 1)).astype(_U)
            _put_new(out, new, low, unit * (end - start), rest, lower)
            model.learn_size(new, digits)
        model.learn(x, event)
        a, b = b, x
    return out.end()


def _decode(payloads: list[bytes], length: int) -> np.ndarray:
    model, code = _Model(len(payloads)), _Reader(payloads)
    blocks = np.zeros((length, len(payloads)), np.int64)
    a = b = np.zeros(len(payloads), np.int64)
    for t in range(length):
        first, second = model.predict(a, b)
        place = (code.code - code.low) // (code.range >> _SCALE)
        event = (place >= first).astype(np.int64) + (place >= second)
        _put_event(code, *_interval(event, first, second))
        x = np.where(event == 0, model.guess2, model.guess1).astype(np.int64)
        new = np.flatnonzero(event == 2)
        if len(new):
            low = code.low[new]
            unit = code.range[new] >> _SCALE
            place = (code.code[new] - low) // unit
            digits = (model.sizes.ends[:-1, new] <= place).sum(axis=0)
            end = model.sizes.ends[digits, new]
            start = np.where(digits > 0, model.sizes.ends[digits - 1, new], _ZERO)
            low += unit * start
            unit *= end - start
            rest = np.maximum(digits - 1, 0).astype(_U)
            # the lower digits; a code in the rounding remainder belongs to none
            lower = (code.code[new] - low) // (unit >> rest)
            _put_new(code, new, low, unit, rest, lower)
            model.learn_size(new, digits)
            x[new] = lower.astype(np.int64) + ((1 << digits) >> 1)
        model.learn(x, event)
        blocks[t] = x
        a, b = b, x
    return blocks.T


def encode(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Coded blocks of ``BLOCK`` ids (the last one shorter) and the checksum of each."""
    if not len(ids):
        return [], []
    if int(ids.max()) >> DIGITS:
        raise ValueError(f"ids of more than {DIGITS} binary digits")
    count = -(-len(ids) // BLOCK)
    length = min(BLOCK, len(ids))
    padded = np.zeros(count * length, np.int64)
    padded[: len(ids)] = ids
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[i : i + BLOCK].tobytes()) for i in range(0, len(ids), BLOCK)]
    return _encode(padded.reshape(count, length)), sums


def decode(payloads: list[bytes], sums: list[int], total: int) -> np.ndarray:
    """The ids again; a block that does not match its checksum is an error."""
    if not payloads:
        return np.empty(0, "<u4")
    ids = _decode(payloads, min(BLOCK, total)).reshape(-1)[:total].astype("<u4")
    for n, expected in enumerate(sums):
        if zlib.crc32(ids[n * BLOCK : (n + 1) * BLOCK].tobytes()) != expected:
            raise ValueError(f"block {n} is damaged")
    return ids
