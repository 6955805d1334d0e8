"""A context-mixing coder: bits predicted from the bytes before them, mixed logistically, and coded arithmetically.

A payload is cut into lanes of equal length that are coded in step, one bit of every lane at a time, so that each step is a few array
operations. The lanes share the model: for each order from 0 to 4 a table of bit probabilities under a hash of the bytes before and the bits of
this byte, and for each bit position a set of mixing weights; and each lane follows the last place where its four bytes stood before, as long as
that predicts well. Encoder and decoder make the same steps, so the model needs no table of its own
in the payload. All of the model is in whole numbers, so both come to the same predictions on any machine.
"""

from __future__ import annotations

import math

import numpy as np

ORDERS = 5
MATCH_BITS = 12
LONGEST = 31
TABLE_BITS = 18
MAX_LANES = 64
LANE_BYTES = 512
MOST_SEEN = 30
#: Log odds of a probability in 4,096 parts, in 256 parts each; and back again, in 65,536 parts.
STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], "i8").clip(-2047, 2047)
SQUASH = np.array([round(65536 / (1 + math.exp(-i / 256))) for i in range(-2047, 2048)], "i8").clip(32, 65504)


def lanes_for(n: int) -> int:
    return max(1, min(MAX_LANES, n // LANE_BYTES))


class _Model:
    def __init__(self, lanes: int, steps: int):
        self.p = np.full((ORDERS, 1 << TABLE_BITS), 32768, "i4")
        self.seen = np.zeros((ORDERS, 1 << TABLE_BITS), "i1")
        self.weights = np.full((8, ORDERS + 1), 23000, "i8")  # in 65,536 parts
        self.last = np.zeros((ORDERS, lanes), "u8")  # hashes of the last k bytes
        self.rows, self.lanes = np.arange(ORDERS)[:, None], np.arange(lanes)
        self.stretched = np.zeros((ORDERS + 1, lanes), "i8")
        self.history, self.step = np.zeros((lanes, steps), "u1"), 0
        self.places = np.full((lanes, 1 << MATCH_BITS), -1, "i4")  # what followed the last four bytes with a hash
        self.follows, self.length = np.full(lanes, -1, "i8"), np.zeros(lanes, "i8")
        self.hit = np.full(LONGEST + 1, 49152, "i8")  # how often a match of a length is right, in 65,536 parts

    def begin(self) -> None:
        """A new byte in every lane."""
        self.partial = np.ones(len(self.lanes), "u8")
        self.guess = np.where(self.follows >= 0, self.history[self.lanes, self.follows], 0).astype("u8") | np.uint64(256)

    def predict(self, bit: int) -> np.ndarray:
        """The chance of a one in each lane, in 65,536 parts."""
        h = (self.last + self.partial[None] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        self.at = (h >> np.uint64(64 - TABLE_BITS)).astype("i8")
        self.each = self.p[self.rows, self.at].astype("i8")
        self.sure = self.seen[self.rows, self.at].astype("i8")
        self.stretched[:ORDERS] = STRETCH[self.each >> 4] * (self.sure > 0)
        self.matches = (self.follows >= 0) & (self.guess >> np.uint64(8 - bit) == self.partial)
        self.expected = (self.guess >> np.uint64(7 - bit) & np.uint64(1)).astype("i8")
        self.stretched[ORDERS] = STRETCH[self.hit[self.length] >> 4] * np.where(self.matches, 2 * self.expected - 1, 0)
        self.bit = bit
        self.mixed = SQUASH[(self.weights[bit] @ self.stretched >> 16).clip(-2047, 2047) + 2047]
        return self.mixed.astype("u8")

    def learn(self, bits: np.ndarray) -> None:
        ones = bits.astype("i8") << 16
        self.weights[self.bit] += (self.stretched @ (ones - self.mixed)) * 5 >> 16
        step = 2 * (ones[None] - self.each) // (2 * self.sure + 3)
        self.p[self.rows, self.at] = (self.each + step).clip(16, 65519)
        self.seen[self.rows, self.at] = np.minimum(self.sure + 1, MOST_SEEN)
        of = self.length[self.matches]
        right = (bits.astype("i8") == self.expected)[self.matches]
        self.hit[of] = (self.hit[of] + ((right * 65535 - self.hit[of]) >> 5)).clip(32, 65503)
        self.partial = self.partial << np.uint64(1) | bits.astype("u8")

    def end(self, values: np.ndarray) -> None:
        """The byte of each lane is known; longer contexts take it up."""
        for k in range(ORDERS - 1, 0, -1):
            before = self.last[k - 1] if k > 1 else np.zeros_like(self.last[0])
            self.last[k] = (before + values.astype("u8") + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(k)
        self.history[:, self.step] = values
        self.step += 1
        goes_on = (self.follows >= 0) & (self.guess == (values.astype("u8") | np.uint64(256)))
        place = (self.last[ORDERS - 1] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MATCH_BITS)).astype("i8")
        found = self.places[self.lanes, place].astype("i8")
        self.length = np.where(goes_on, np.minimum(self.length + 1, LONGEST), 0)
        self.follows = np.where(goes_on, self.follows + 1, found)
        self.places[self.lanes, place] = self.step


def mixing_encode(data: bytes) -> bytes:
    """Length, then the lanes' lengths in bytes, then their code."""
    n = len(data)
    if not n:
        return b""
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    a = np.frombuffer(data.ljust(steps * lanes, b"\0"), "u1").reshape(lanes, steps)
    model, low, high = _Model(lanes, steps), np.zeros(lanes, "u8"), np.full(lanes, 0xFFFFFFFF, "u8")
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []
    for t in range(steps):
        model.begin()
        for b in range(8):
            mid = low + ((high - low) * model.predict(b) >> np.uint64(16))
            bits = (a[:, t] >> (7 - b)) & 1
            one = bits.astype(bool)
            high = np.where(one, mid, high)
            low = np.where(one, low, mid + np.uint64(1))
            model.learn(bits)
            while (done := (low ^ high) < 1 << 24).any():
                lane = np.flatnonzero(done)
                who.append(lane)
                what.append((high[lane] >> np.uint64(24)).astype("u1"))
                low[lane] = low[lane] << np.uint64(8) & np.uint64(0xFFFFFFFF)
                high[lane] = high[lane] << np.uint64(8) & np.uint64(0xFFFFFFFF) | np.uint64(255)
        model.end(a[:, t])
    for k in range(4):
        who.append(np.arange(lanes))
        what.append((high >> np.uint64(24 - 8 * k) & np.uint64(255)).astype("u1"))
    lane, code = np.concatenate(who), np.concatenate(what)
    order = np.argsort(lane, kind="stable")
    return np.concatenate(([n], np.bincount(lane, minlength=lanes))).astype("<u4").tobytes() + code[order].tobytes()


def mixing_decode(data: bytes) -> bytes:
    if not data:
        return b""
    n = int.from_bytes(data[:4], "little")
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    sizes = np.frombuffer(data, "<u4", lanes, 4).astype("i8")
    code = np.concatenate((np.frombuffer(data, "u1", offset=4 + 4 * lanes), np.zeros(8, "u1"))).astype("u8")
    if sizes.sum() + 8 != len(code):
        raise ValueError("the lanes do not add up")
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = np.zeros(lanes, "u8")
    for _ in range(4):
        x = x << np.uint64(8) | code[at]
        at += 1
    a = np.zeros((lanes, steps), "u1")
    model, low, high = _Model(lanes, steps), np.zeros(lanes, "u8"), np.full(lanes, 0xFFFFFFFF, "u8")
    for t in range(steps):
        model.begin()
        for b in range(8):
            mid = low + ((high - low) * model.predict(b) >> np.uint64(16))
            one = x <= mid
            high = np.where(one, mid, high)
            low = np.where(one, low, mid + np.uint64(1))
            model.learn(one)
            while (done := (low ^ high) < 1 << 24).any():
                lane = np.flatnonzero(done)
                low[lane] = low[lane] << np.uint64(8) & np.uint64(0xFFFFFFFF)
                high[lane] = high[lane] << np.uint64(8) & np.uint64(0xFFFFFFFF) | np.uint64(255)
                x[lane] = x[lane] << np.uint64(8) & np.uint64(0xFFFFFFFF) | code[at[lane]]
                at[lane] += 1
        a[:, t] = (model.partial & np.uint64(255)).astype("u1")
        model.end(a[:, t])
    return a.tobytes()[:n]
