"""Adaptive context-mixing range coder for blocks of token ids.

Each block is coded on its own: its model starts afresh, and a checksum of its ids goes with it. An id is first
guessed from the two ids before it and from the one before it (the id that last followed them, with a confidence);
whether a guess holds is a bit whose probability mixes, with learned weights, what the order-2 confidence, the order-1
confidence and the recent luck of guesses say. Ids that no guess hits are spelled as four digits of four bits under adaptive order-0
distributions, each in the context of the digits before it. All arithmetic is in integers, so blocks can be read on
any machine.

Blocks lie side by side as lanes of numpy arrays: one step codes the next id of every block.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"NCM1"
BLOCK = 4096
_HEAD = struct.Struct("<4sIII")  # magic, ids, crc32 of the ids as little-endian 32-bit numbers, bytes of payload
_SLOTS = 1024
#: Rows of an order-0 model: contexts of the first to the fourth digit.
_FIRST = (0, 1, 17, 273)
_TREE = 529
_RATE = 4
_LOW = np.uint64(0xFFFFFFFF)
_32, _12, _15 = np.uint64(32), np.uint64(12), np.uint64(15)
#: Where the lower bounds of a digit's distribution move when a digit is seen.
_TOWARDS = np.array([[i if i <= s else 32752 + i for i in range(16)] for s in range(16)], dtype=np.int16)


def _squash_table() -> np.ndarray:
    return np.array([min(4032, max(64, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], dtype=np.int64)


_SQUASH = _squash_table()
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], dtype=np.int64)


class _Lanes:
    """Coder and model of some blocks. source: None to encode, else the words to decode, a row for each lane."""

    def __init__(self, n: int, words: int, source: np.ndarray | None = None):
        self.n = n
        self.low, self.range = np.zeros(n, dtype=np.uint64), np.full(n, np.uint64((1 << 64) - 1))
        self.words = source if source is not None else np.zeros((n, words), dtype=np.uint32)
        self.at = np.zeros(n, dtype=np.int64)
        self.code = None
        if source is not None:
            self.code = source[:, 0].astype(np.uint64) << _32 | source[:, 1].astype(np.uint64)
            self.at += 2
        self.tree = np.tile(np.arange(0, 32768, 2048, dtype=np.int16), (n * _TREE, 1))
        self.guess = [np.zeros(n * _SLOTS, dtype=np.uint16) for _ in range(2)]  # after one id, after two
        self.sure = [np.zeros(n * _SLOTS, dtype=np.uint8) for _ in range(2)]
        self.p = [np.full(n * 16, 1024, dtype=np.int64) for _ in range(3)]
        self.second = np.full(n * 8, 512, dtype=np.int64)
        self.weight = np.full((3, n), 26000, dtype=np.int64)
        self.luck = np.zeros(n, dtype=np.int64)
        self.last, self.last2 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def _bit(self, lane, low, rng, code, p: np.ndarray, bit):
        """Codes one bit a lane, where p of 4096 is the probability of a one."""
        r = (rng >> _12) * p.astype(np.uint64)
        if bit is None:
            bit = code - low < r
        low = np.where(bit, low, low + r)
        return low, np.where(bit, r, rng - r), bit

    def _shift(self, lane, low, rng, code):
        """Moves out the words that are settled; cuts a range that straddles two words short."""
        k = np.flatnonzero(rng <= _LOW)
        if len(k):
            lo, rg = low[k], rng[k]
            across = (lo ^ (lo + rg)) >> _32 != 0
            rg = np.where(across, (~lo + np.uint64(1)) & _LOW, rg)
            at = self.at[lane[k]]
            if code is None:
                if at.max() >= self.words.shape[1]:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
                self.words[lane[k], at] = (lo >> _32).astype(np.uint32)
            else:
                code[k] = code[k] << _32 | self.words[lane[k], np.minimum(at, self.words.shape[1] - 1)].astype(np.uint64)
            self.at[lane[k]] = at + 1
            low[k], rng[k] = lo << _32, rg << _32
        return low, rng, code

    def step(self, n: int, ids: np.ndarray | None) -> np.ndarray:
        """Codes one id in each of the first n lanes."""
        lane = np.arange(n)
        low, rng = self.low[:n], self.range[:n]
        code = None if self.code is None else self.code[:n]
        last, last2 = self.last[:n], self.last2[:n]
        slot = [lane * _SLOTS + (last * 40503 >> 6) % _SLOTS, lane * _SLOTS + ((last * 31153 + last2 * 50077) >> 5) % _SLOTS]
        g1, g2 = (self.guess[k][slot[k]].astype(np.int64) for k in (0, 1))
        s1, s2 = (self.sure[k][slot[k]].astype(np.int64) for k in (0, 1))
        first = np.where(s2 > 0, g2, g1)
        agree = (g1 == g2).astype(np.int64)
        index = [lane * 16 + s2 * 2 + agree, lane * 16 + s1 * 2 + agree, lane * 16 + self.luck[:n]]
        q = [p[i] for p, i in zip(self.p, index, strict=True)]
        st = np.stack([_STRETCH[x] for x in q])
        mixed = _SQUASH[np.clip((self.weight[:, :n] * st).sum(axis=0) >> 16, -2047, 2047) + 2047]
        low, rng, hit = self._bit(lane, low, rng, code, mixed, None if ids is None else ids == first)
        one = hit.astype(np.int64) * 4095
        self.weight[:, :n] += (st * ((one - mixed) * 7) + 32768) >> 16
        for p, i, x in zip(self.p, index, q, strict=True):
            p[i] = x + ((one - x) >> 5)
        self.luck[:n] = (self.luck[:n] * 2 + hit) & 15
        out = first.copy()
        m = np.flatnonzero(~hit & (g1 != first))  # the order-1 guess, where it is another one
        if len(m):
            c = None if code is None else code[m]
            at = m * 8 + s1[m]
            p = self.second[at]
            low[m], rng[m], second = self._bit(m, low[m], rng[m], c, np.clip(p, 64, 4032), None if ids is None else ids[m] == g1[m])
            self.second[at] = p + ((second.astype(np.int64) * 4095 - p) >> 4)
            out[m[second]] = g1[m[second]]
            hit[m] = second
        low, rng, code = self._shift(lane, low, rng, code)
        m = np.flatnonzero(~hit)
        if len(m):
            lo, rg, c = low[m], rng[m], None if code is None else code[m]
            want = None if ids is None else ids[m]
            base = m * _TREE
            every = np.arange(len(m))
            digits: list[np.ndarray] = []
            for k in range(4):
                context = 0 if k == 0 else digits[-1] if k == 1 else digits[-2] * 16 + digits[-1]
                row = base + _FIRST[k] + context
                bounds = self.tree[row]
                r = rg >> _15
                if want is None:
                    v = np.minimum((c - lo) // r, np.uint64(32767)).astype(np.int16)
                    d = (bounds <= v[:, None]).sum(axis=1) - 1
                else:
                    d = want >> (12 - 4 * k) & 15
                below = bounds[every, d].astype(np.uint64)
                above = np.where(d < 15, bounds[every, np.minimum(d + 1, 15)].astype(np.uint64), np.uint64(32768))
                lo, rg = lo + r * below, r * (above - below)
                self.tree[row] = bounds + ((_TOWARDS[d] - bounds) >> _RATE)
                digits.append(d)
                if k % 2:
                    lo, rg, c = self._shift(m, lo, rg, c)
            out[m] = ((digits[0] * 16 + digits[1]) * 16 + digits[2]) * 16 + digits[3]
            low[m], rng[m] = lo, rg
            if code is not None:
                code[m] = c
        self.low[:n], self.range[:n] = low, rng
        if code is not None:
            self.code[:n] = code
        for k, (g, s) in enumerate(((g1, s1), (g2, s2))):
            right = g == out
            self.sure[k][slot[k]] = np.where(right, np.minimum(s + 1, 7), s >> 1)
            self.guess[k][slot[k]] = np.where(right | (s > 1), g, out)
            fresh = ~right & (s <= 1)
            self.sure[k][slot[k][fresh]] = 1
        self.last2[:n], self.last[:n] = last, out
        return out


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Blocks of up to `block` ids (each below 65,536), each with its header."""
    ids = np.asarray(ids)
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be below 65536")
    n = -(-len(ids) // block)
    lanes = _Lanes(n, block // 2 + 16)
    grid = np.zeros((n, block), dtype=np.uint16)
    grid.ravel()[: len(ids)] = ids
    tail = len(ids) - (n - 1) * block if n else 0
    for t in range(block if n else 0):
        active = n if t < tail else n - 1
        if not active:
            break
        lanes.step(active, grid[:active, t].astype(np.int64))
    out = []
    for k in range(n):
        end = int(lanes.at[k])
        words = np.concatenate([lanes.words[k, :end], np.array([lanes.low[k] >> _32, lanes.low[k] & _LOW], dtype=np.uint32)]).astype("<u4").tobytes()
        own = ids[k * block : (k + 1) * block].astype("<u4").tobytes()
        out.append(_HEAD.pack(MAGIC, len(own) // 4, zlib.crc32(own), len(words)) + words)
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, in any order of blocks; a block whose checksum doesn't hold is an error."""
    heads = [_HEAD.unpack_from(b) for b in blocks]
    for magic, _, _, size in heads:
        if magic != MAGIC or size % 4:
            raise ValueError("not a block of this format")
    order = sorted(range(len(blocks)), key=lambda k: -heads[k][1])
    if not order:
        return []
    width = max(h[3] for h in heads) // 4 + 2
    words = np.zeros((len(blocks), width), dtype=np.uint32)
    for lane, k in enumerate(order):
        w = np.frombuffer(blocks[k], dtype="<u4", offset=_HEAD.size, count=heads[k][3] // 4)
        words[lane, : len(w)] = w
    lens = np.array([heads[k][1] for k in order])
    lanes = _Lanes(len(order), 0, words)
    got = np.zeros((len(order), lens[0]), dtype=np.uint32)
    for t in range(lens[0]):
        active = int((lens > t).sum())
        got[:active, t] = lanes.step(active, None)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(blocks)
    for lane, k in enumerate(order):
        own = got[lane, : lens[lane]].astype("<u4")
        if zlib.crc32(own.tobytes()) != heads[k][2]:
            raise ValueError("checksum of a block doesn't hold")
        out[k] = own
    return out
