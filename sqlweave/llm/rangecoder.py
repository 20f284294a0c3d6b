"""Range coder for token ids with adaptive mixing of order-0 to order-2 predictions.

A block is coded on its own, from a blank model. Before each id the model has two guesses: the id
that last followed the two ids before (order 2), and the one before (order 1). Their weights depend
on how often each guess held lately; what they leave belongs to the order-0 prediction, adaptive
frequencies of magnitude classes with equal shares inside a class. The three make one distribution,
and one step of the range coder codes the id, with a second step for its place inside the class.

Blocks are coded side by side: every numpy operation below moves all blocks of a frame on by one id.
All arithmetic is on integers, so that the decoder repeats the encoder's model exactly.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np

BLOCK_IDS = 2048
MAGIC = b"TKM1"
HEADER = struct.Struct("<4sIIII")  # magic, classes, ids, 16-bit words, crc32 of the ids

_TOTAL_BITS, _CDF_BITS = 16, 14
_TOP, _LOW_BITS, _WORD = 48, 32, 16
_TABLE_1, _TABLE_2 = 10, 11  # bits of the slots of the order-1 and order-2 tables
_FLOOR, _RATE, _MOST = 64, 4, 62000  # least share of a class, rate of adaptation, most that guesses get together


def classes_for(vocabulary: int) -> int:
    return max(1, int(vocabulary).bit_length())


def _kinds(classes: int) -> np.ndarray:
    """The magnitude class of every id: the bit length of id + 1, less one."""
    return np.frexp((np.arange(1 << classes) + 1).astype(float))[1].astype(np.int64) - 1


class _Model:
    """The models of all blocks of a frame; `a` is the number of blocks still going on."""

    def __init__(self, lanes: int, classes: int) -> None:
        lane = np.arange(lanes, dtype=np.int64)
        self.base_1, self.base_2, self.base_w = lane << _TABLE_1, lane << _TABLE_2, lane * 16
        self.table_1 = np.zeros(lanes << _TABLE_1, np.int32)
        self.table_2 = np.zeros(lanes << _TABLE_2, np.int32)
        self.weight_1 = np.full(lanes * 16, 4096, np.int32)
        self.weight_2 = np.full(lanes * 16, 8192, np.int32)
        self.classes = classes
        # Cumulative shares of the classes, a row for each bound and a column for each block.
        steps = np.arange(classes + 1, dtype=np.int16)
        self.cdf = np.tile(((steps.astype(np.int64) << _CDF_BITS) // classes).astype(np.int16)[:, None], lanes)
        self.change = np.empty_like(self.cdf)
        self.steps, self.low = steps[:, None], (steps * _FLOOR)[:, None]
        self.gap = np.int16((1 << _CDF_BITS) - classes * _FLOOR)
        self.lane = lane
        self.lanes = lanes
        self.last_1 = np.zeros(lanes, np.int64)
        self.last_2 = np.zeros(lanes, np.int64)

    def guess(self, a: int) -> tuple[np.ndarray, ...]:
        """Guesses of order 2 and 1, and the shares of both and of order 0."""
        p1, p2 = self.last_1[:a], self.last_2[:a]
        self.slot_1 = self.base_1[:a] + (p1 * 40503 >> 3 & (1 << _TABLE_1) - 1)
        self.slot_2 = self.base_2[:a] + ((p1 * 40503 + p2 * 60493) >> 4 & (1 << _TABLE_2) - 1)
        self.entry_1, self.entry_2 = self.table_1[self.slot_1], self.table_2[self.slot_2]
        g1, g2 = self.entry_1 >> 2, self.entry_2 >> 2
        self.context = self.base_w[:a] + ((self.entry_2 & 3) << 2) + (self.entry_1 & 3)
        self.w1, self.w2 = self.weight_1[self.context], self.weight_2[self.context]
        same = g1 == g2
        s1 = np.where(same, 0, self.w1).astype(np.int64)
        s2 = np.where(same, self.w1 + self.w2, self.w2).astype(np.int64)
        return g1, g2, s1, s2, (1 << _TOTAL_BITS) - s1 - s2

    def bounds(self, a: int, kind: np.ndarray, s0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of the classes `kind` begin and end within the share of order 0."""
        at, flat = kind * self.lanes + self.lane[:a], self.cdf.reshape(-1)
        return s0 * flat[at] >> _CDF_BITS, s0 * flat[at + self.lanes] >> _CDF_BITS

    def class_at(self, a: int, place: np.ndarray, s0: np.ndarray) -> np.ndarray:
        """The class in whose bounds a place within the share of order 0 lies."""
        limit = np.clip(((place + 1 << _CDF_BITS) - 1) // s0, 0, (1 << _CDF_BITS) - 1).astype(np.int16)
        return (self.cdf[1:, :a] <= limit).view(np.int8).sum(0, dtype=np.int8).astype(np.int64)

    def learn(self, a: int, ids: np.ndarray, kind: np.ndarray, hit_1: np.ndarray, hit_2: np.ndarray) -> None:
        for entry, slot, hit, table in ((self.entry_1, self.slot_1, hit_1, self.table_1), (self.entry_2, self.slot_2, hit_2, self.table_2)):
            sure = entry & 3
            fresh = (ids << 2 | 1).astype(np.int32)
            table[slot] = np.where(hit, entry + (sure < 3), np.where(sure > 1, entry - 1, fresh))
        first = hit_1 & ~hit_2
        self.weight_2[self.context] = self.w2 + np.where(hit_2, _MOST - self.w2 >> _RATE, -(self.w2 >> _RATE))
        self.weight_1[self.context] = self.w1 + np.where(first, _MOST - self.w1 >> _RATE, -(self.w1 >> _RATE))
        # Towards all shares but the least ones in the class that came.
        cdf, change = self.cdf[:, :a], self.change[:, :a]
        np.multiply(self.steps > kind.astype(np.int16), self.gap, out=change)
        change += self.low
        change -= cdf
        change >>= _RATE
        cdf += change
        self.last_2[:a] = self.last_1[:a]
        self.last_1[:a] = ids


def encode(ids: np.ndarray, vocabulary: int, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Blocks of `ids`, each with a header, in order."""
    n, classes = len(ids), classes_for(vocabulary)
    lanes = -(-n // block_ids)
    if not lanes:
        return []
    padded = np.zeros(lanes * block_ids, np.uint32)
    padded[:n] = ids
    steps = np.ascontiguousarray(padded.reshape(lanes, block_ids).T)
    del padded
    sizes = np.full(lanes, block_ids)
    sizes[-1] = n - (lanes - 1) * block_ids
    kinds = _kinds(classes)
    model = _Model(lanes, classes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << _TOP, np.uint64)
    room = block_ids * 2 + 4
    out, used = np.zeros((lanes, room), np.uint32), np.zeros(lanes, np.int64)

    def settle(a: int) -> None:
        due = np.flatnonzero(span[:a] < (1 << _LOW_BITS))
        if len(due):
            out[due, used[due]] = low[due] >> np.uint64(_LOW_BITS)
            used[due] += 1
            low[due] = (low[due] & np.uint64((1 << _LOW_BITS) - 1)) << np.uint64(_WORD)
            span[due] <<= np.uint64(_WORD)

    for t in range(int(sizes[0])):
        a = lanes if t < sizes[-1] else lanes - 1
        x = steps[t, :a].astype(np.int64)
        g1, g2, s1, s2, s0 = model.guess(a)
        hit_1, hit_2 = x == g1, x == g2
        kind = kinds[x]
        begin, end = model.bounds(a, kind, s0)
        begin += s1 + s2
        end += s1 + s2
        first = hit_1 & ~hit_2
        begin = np.where(hit_2, 0, np.where(first, s2, begin))
        end = np.where(hit_2, s2, np.where(first, s2 + s1, end))
        unit = span[:a] >> np.uint64(_TOTAL_BITS)
        low[:a] += unit * begin.astype(np.uint64)
        span[:a] = unit * (end - begin).astype(np.uint64)
        settle(a)
        bits = np.where(hit_1 | hit_2, 0, kind).astype(np.uint64)
        place = np.where(bits > 0, x + 1 - (1 << kind), 0).astype(np.uint64)
        span[:a] >>= bits
        low[:a] += span[:a] * place
        settle(a)
        model.learn(a, x, kind, hit_1, hit_2)
    for shift in (_LOW_BITS, _WORD, 0):
        out[np.arange(lanes), used] = (low >> np.uint64(shift)).astype(np.uint64) & np.uint64((1 << 17) - 1 if shift == _LOW_BITS else (1 << _WORD) - 1)
        used += 1
    # Words may have a 17th bit, which is a carry into the word before.
    carry = np.zeros(lanes, np.uint32)
    for j in range(int(used.max()) - 1, -1, -1):
        word = out[:, j] + carry
        carry = word >> np.uint32(_WORD)
        out[:, j] = word & np.uint32((1 << _WORD) - 1)
    blocks, stored = [], np.asarray(ids).astype("<u4")
    for lane in range(lanes):
        words = out[lane, : used[lane]].astype("<u2").tobytes()
        own = stored[lane * block_ids : (lane + 1) * block_ids].tobytes()
        blocks.append(HEADER.pack(MAGIC, classes, int(sizes[lane]), int(used[lane]), crc32(own)) + words)
    return blocks


def split(data: bytes) -> list[bytes]:
    """Blocks of a frame that are stored one behind the other."""
    blocks, at = [], 0
    while at < len(data):
        if len(data) < at + HEADER.size or data[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        end = at + HEADER.size + 2 * HEADER.unpack_from(data, at)[3]
        if end > len(data):
            raise ValueError(f"the block at byte {at} is cut off")
        blocks.append(data[at:end])
        at = end
    return blocks


def decode(blocks: list[bytes]) -> np.ndarray:
    """Ids of blocks of one frame; a block whose checksum does not fit raises ValueError.

    Blocks may be taken out of a frame and decoded alone or in another order.
    """
    if not blocks:
        return np.empty(0, np.int32)
    heads = [HEADER.unpack_from(b) for b in blocks]
    if len({h[1] for h in heads}) > 1:
        raise ValueError("blocks of different vocabularies")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][2])  # longer blocks first: those still going on stand together
    lanes, classes = len(blocks), heads[0][1]
    sizes = np.array([heads[i][2] for i in order])
    words = np.zeros((lanes, max(h[3] for h in heads) + 4), np.uint16)
    for lane, i in enumerate(order):
        words[lane, : heads[i][3]] = np.frombuffer(blocks[i], "<u2", heads[i][3], HEADER.size)
    shifts = [np.uint64(s) for s in (_LOW_BITS, _WORD, 0)]
    head = words[:, :3].astype(np.uint64)
    code = (head[:, 0] << shifts[0]) | (head[:, 1] << shifts[1]) | head[:, 2]
    used, span = np.full(lanes, 3, np.int64), np.full(lanes, 1 << _TOP, np.uint64)
    model, kinds = _Model(lanes, classes), _kinds(classes)
    out = np.zeros((int(sizes[0]), lanes), np.int32)

    def settle(a: int) -> None:
        due = np.flatnonzero(span[:a] < (1 << _LOW_BITS))
        if len(due):
            code[due] = code[due] << np.uint64(_WORD) | words[due, used[due]]
            used[due] += 1
            span[due] <<= np.uint64(_WORD)

    for t in range(int(sizes[0])):
        a = int(np.searchsorted(-sizes, -t, side="left"))
        g1, g2, s1, s2, s0 = model.guess(a)
        unit = span[:a] >> np.uint64(_TOTAL_BITS)
        value = np.minimum(code[:a] // unit, np.uint64((1 << _TOTAL_BITS) - 1)).astype(np.int64)
        in_2, in_12 = value < s2, value < s2 + s1
        kind = model.class_at(a, value - s1 - s2, s0)
        begin, end = model.bounds(a, kind, s0)
        begin = np.where(in_2, 0, np.where(in_12, s2, begin + s1 + s2))
        end = np.where(in_2, s2, np.where(in_12, s2 + s1, end + s1 + s2))
        code[:a] -= unit * begin.astype(np.uint64)
        span[:a] = unit * (end - begin).astype(np.uint64)
        settle(a)
        bits = np.where(in_12, 0, kind).astype(np.uint64)
        span[:a] >>= bits
        place = np.where(bits > 0, code[:a] // span[:a], np.uint64(0))
        place = np.minimum(place, (np.uint64(1) << bits) - np.uint64(1))
        code[:a] -= span[:a] * place
        settle(a)
        x = np.where(in_2, g2, np.where(in_12, g1, (1 << kind) - 1 + place.astype(np.int64))).astype(np.int64)
        model.learn(a, x, kinds[x], x == g1, x == g2)
        out[t, :a] = x
    found: list[np.ndarray] = [np.empty(0)] * lanes
    for lane, i in enumerate(order):
        ids = out[: sizes[lane], lane]
        if crc32(ids.astype("<u4").tobytes()) != heads[i][4]:
            raise ValueError("a block's checksum does not fit its ids")
        found[i] = ids
    return np.concatenate(found)
