"""Lossless WebP images: a reader of the whole format and a writer.

read() decodes any lossless file: prefix codes (one group or many), back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. write() makes such files with any of these. Pixels are uint32,
alpha, red, green, blue from the top byte down. See webp_many for many images at once.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ALPHABETS = (280, 256, 256, 256, 40)
CACHE_MUL = 0x1E35A7BD
OPAQUE = 0xFF000000


# ---------------------------------------------------------------- bits and prefix codes


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        p = self.at >> 3
        v = int.from_bytes(self.data[p : p + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return v


class Code:
    """A canonical prefix code as a table over the next `width` bits: symbol, and length above bit 16."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # a single symbol takes no bits
            self.width, self.table = 0, np.array([used[0] if len(used) else 0], dtype=np.int32)
            return
        self.width = int(lengths.max())
        if (1 << (self.width - lengths[used])).sum() != 1 << self.width:
            raise ValueError("not a complete prefix code")
        order = used[np.lexsort((used, lengths[used]))]
        each = lengths[order]
        self.table = np.repeat((order | each << 16).astype(np.int32), 1 << (self.width - each))[turned(self.width)]

    def next(self, bits: Bits) -> int:
        at = bits.at
        k = int(self.table[bits.read(self.width)])
        bits.at = at + (k >> 16)
        return k & 0xFFFF


@lru_cache(maxsize=16)
def turned(width: int) -> np.ndarray:
    """All numbers of so many bits with their bits in reverse."""
    k, out = np.arange(1 << width), np.zeros(1 << width, dtype=np.int64)
    for b in range(width):
        out |= (k >> b & 1) << (width - 1 - b)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The codes of a canonical prefix code, first bit lowest."""
    lengths = np.asarray(lengths, dtype=np.int64)
    used, out = np.flatnonzero(lengths), np.zeros(len(lengths), dtype=np.int64)
    if len(used):
        order = used[np.lexsort((used, lengths[used]))]
        width = int(lengths.max())
        room = 1 << (width - lengths[order])
        out[order] = turned(width)[np.cumsum(room) - room]
    return out


def shannon(weights: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code of at most `most` bits, from the logarithms of the shares: near huffman(), but quick."""
    w = np.asarray(weights, dtype=np.int64)
    used = np.flatnonzero(w)
    lengths = np.zeros(len(w), dtype=np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(-w[used], kind="stable")]
    n = np.clip(np.ceil(np.log2(w.sum() / w[used]) - 0.2).astype(np.int64), 1, most).tolist()
    left = (1 << most) - sum(1 << (most - x) for x in n)
    k = len(n) - 1
    while left < 0:  # longer codes for the rarest that can have them
        if n[k] < most:
            n[k] += 1
            left += 1 << (most - n[k])
        k = k - 1 if k else len(n) - 1
    while left:  # shorter ones for the commonest that still fit
        for k, x in enumerate(n):
            if x > 1 and 1 << (most - x) <= left:
                n[k] = x - 1
                left -= 1 << (most - x)
                if not left:
                    break
    lengths[used] = n
    return lengths


def huffman(weights: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code of at most `most` bits for the symbols with weight."""
    w = np.asarray(weights, dtype=np.int64).copy()
    used = np.flatnonzero(w)
    lengths = np.zeros(len(w), dtype=np.int64)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) <= 1:
        return lengths
    while True:
        heap = [(int(w[s]), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(map(int, used), 0)
        while len(heap) > 1:
            (a, x, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                depth[s] += 1
            heapq.heappush(heap, (a + b, x, left + right))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                lengths[s] = n
            return lengths
        w[used] = w[used] // 2 + 1


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, number of extra bits and extra bits of a length or distance of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), high - 1, v & ((1 << (high - 1)) - 1)


def _unprefix(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    first = np.zeros(19, dtype=np.int64)
    for k in range(4 + bits.read(4)):
        first[CODE_ORDER[k]] = bits.read(3)
    reader = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, mask = reader.table.tolist(), (1 << reader.width) - 1
    data, at, out, before = bits.data, bits.at, [], 8
    while len(out) < size and left:
        left -= 1
        v = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)
        s = table[v & mask]
        n, s = s >> 16, s & 0xFFFF
        at += n
        v >>= n
        if s < 16:
            out.append(s)
            before = s or before
        elif s == 16:
            out += [before] * (3 + (v & 3))
            at += 2
        elif s == 17:
            out += [0] * (3 + (v & 7))
            at += 3
        else:
            out += [0] * (11 + (v & 127))
            at += 7
    bits.at = at
    if len(out) > size:
        raise ValueError("code lengths run over")
    lengths[: len(out)] = out
    return Code(lengths)


# ---------------------------------------------------------------- reading


@dataclass
class Header:
    """What stands before the pixels of the main image."""

    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)
    coded_width: int = 0
    cache_bits: int = 0
    tile_bits: int = 0
    tiles: np.ndarray | None = None
    groups: list[list[Code]] = field(default_factory=list)
    at: int = 0  # first bit of the pixels
    start: tuple = ()


def _tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _payload(data: bytes) -> tuple[int, int]:
    """Start and end of the lossless chunk's content in a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return at + 8, at + 8 + size
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def read_header(data: bytes) -> Header:
    start, _ = _payload(data)
    bits = Bits(data, start * 8)
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    h = Header(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    h.coded_width = h.width
    while bits.read(1):
        kind = bits.read(2)
        if any(t[0] == kind for t in h.transforms):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            w, rows = _tiles(h.coded_width, size), _tiles(h.height, size)
            h.transforms.append((kind, h.coded_width, size, _read_image(bits, w, rows).reshape(rows, w)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _read_image(bits, n, 1).view(np.uint8).reshape(n, 4)
            table = np.cumsum(steps, axis=0, dtype=np.uint8).copy().view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            h.transforms.append((kind, h.coded_width, pack, table))
            h.coded_width = _tiles(h.coded_width, pack)
        else:
            h.transforms.append((kind, h.coded_width, 0, None))
    h.cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        h.tile_bits = bits.read(3) + 2
        w, rows = _tiles(h.coded_width, h.tile_bits), _tiles(h.height, h.tile_bits)
        h.tiles = (_read_image(bits, w, rows) >> 8 & 0xFFFF).reshape(rows, w).astype(np.int64)
    _read_groups(bits, h)
    h.at = bits.at
    return h


def _read_groups(bits: Bits, h: Header) -> None:
    n = int(h.tiles.max()) + 1 if h.tiles is not None else 1
    extra = 1 << h.cache_bits if h.cache_bits else 0
    h.groups = [[_read_code(bits, size + (extra if k == 0 else 0)) for k, size in enumerate(ALPHABETS)] for _ in range(n)]


def _read_image(bits: Bits, width: int, height: int) -> np.ndarray:
    """An image within the header: one group of codes, no transforms."""
    h = Header(width, height, coded_width=width, cache_bits=bits.read(4) if bits.read(1) else 0)
    _read_groups(bits, h)
    return _read_pixels(bits, h)


def _read_pixels(bits: Bits, h: Header) -> np.ndarray:
    width, n = h.coded_width, h.coded_width * h.height
    out, at, seen = [0] * n, 0, 0
    cache, shift = [0] * (1 << h.cache_bits), 32 - h.cache_bits
    while at < n:
        group = h.groups[h.tiles[(at // width) >> h.tile_bits, (at % width) >> h.tile_bits]] if h.tiles is not None else h.groups[0]
        s = group[0].next(bits)
        if s < 256:
            red, blue, alpha = (group[k].next(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _unprefix(s - 256, bits)
            d = _unprefix(group[4].next(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > n:
                raise ValueError("a back-reference points outside the image")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            while seen < at:
                cache[out[seen] * CACHE_MUL % (1 << 32) >> shift] = out[seen]
                seen += 1
            out[at] = cache[s - 280]
            at += 1
        if h.cache_bits:
            while seen < at:
                cache[out[seen] * CACHE_MUL % (1 << 32) >> shift] = out[seen]
                seen += 1
    return np.array(out, dtype=np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    """uint32 pixels as int channels: blue, green, red, alpha."""
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((c & 255).astype(np.uint8)).view(np.uint32)[..., 0]


def _predict(mode: int, left, top, right, corner):
    """The predicted channels; right and corner are those above."""
    def mean(a, b):
        return (a + b) >> 1
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    a = mean(left, top)
    d = a - corner
    return np.clip(a + (np.abs(d) >> 1) * np.sign(d), 0, 255)


def _predictor(c: np.ndarray, modes: np.ndarray, size: int, forward: bool) -> np.ndarray:
    """Residuals of an image (forward), or the image of residuals."""
    height, width, _ = c.shape
    out = c.copy()
    if width and height and modes.size and modes.min() == modes.max() and modes.flat[0] in (1, 2):  # all from the left, or all from above
        rest = 1 if modes.flat[0] == 1 else 0  # the first column, or row, runs the other way
        if forward:
            edge = np.diff(np.take(c, 0, axis=rest), axis=0, prepend=np.array([[0, 0, 0, 255]]))
            out = np.concatenate([np.expand_dims(edge, rest), np.diff(c, axis=rest)], axis=rest)
        else:
            edge = np.take(c, 0, axis=rest).copy()
            edge[0] += np.array([0, 0, 0, 255])
            out = np.cumsum(np.concatenate([np.expand_dims(np.cumsum(edge, axis=0), rest), np.delete(c, 0, axis=rest)], axis=rest), axis=rest)
        return out & 255
    seen = c if forward else out
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = seen[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                p = seen[y - 1, 0]
            else:
                right = seen[y - 1, x + 1] if x + 1 < width else seen[y, 0]
                p = _predict(int(modes[y >> size, x >> size]), seen[y, x - 1], seen[y - 1, x], right, seen[y - 1, x - 1])
            out[y, x] = (c[y, x] - p if forward else c[y, x] + p) & 255
    return out


def _cross(c: np.ndarray, elements: np.ndarray, size: int, forward: bool) -> np.ndarray:
    height, width, _ = c.shape
    y, x = np.mgrid[:height, :width]
    e = _split(elements).astype(np.int8).astype(np.int32)[y >> size, x >> size]
    to_red, to_blue, red_to_blue = e[..., 0], e[..., 1], e[..., 2]

    def signed(v):
        return v.astype(np.int8).astype(np.int32)
    out = c.copy()
    green, sign = signed(c[..., 1]), -1 if forward else 1
    red = (c[..., 2] + sign * (to_red * green >> 5)) & 255
    out[..., 2] = red
    out[..., 0] = (c[..., 0] + sign * ((to_blue * green >> 5) + (red_to_blue * signed(c[..., 2] if forward else red) >> 5))) & 255
    return out


def read(data: bytes) -> np.ndarray:
    """The pixels of a lossless file, height x width."""
    h = read_header(data)
    return _finish(h, _read_pixels(Bits(data, h.at), h))


def _finish(h: Header, flat: np.ndarray) -> np.ndarray:
    """Inverts the transforms, the last one first."""
    p = flat.reshape(h.height, h.coded_width)
    for kind, width, size, extra in reversed(h.transforms):
        if kind == PREDICTOR:
            p = _join(_predictor(_split(p), extra >> 8 & 15, size, False))
        elif kind == CROSS_COLOUR:
            p = _join(_cross(_split(p), extra, size, False))
        elif kind == SUBTRACT_GREEN:
            c = _split(p)
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
            p = _join(c)
        else:
            each = 8 >> size
            packed = (p >> 8 & 255).astype(np.uint32)
            index = np.stack([packed >> (each * k) & ((1 << each) - 1) for k in range(1 << size)], axis=2).reshape(h.height, -1)[:, :width]
            table = np.zeros(256, dtype=np.uint32)
            table[: len(extra)] = extra
            p = table[index]
    return p


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.values.append(value)
            self.sizes.append(n)

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code's description."""
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and (not len(used) or used.max() < 256):
            first = int(used[0]) if len(used) else 0
            self.put(1, 1)
            self.put(int(len(used) == 2), 1)
            self.put(int(first > 1), 1)
            self.put(first, 8 if first > 1 else 1)
            if len(used) == 2:
                self.put(int(used[1]), 8)
            return
        edge = np.flatnonzero(np.diff(lengths, prepend=-1))
        symbols, extra, more = [], [], []
        for v, n in zip(lengths[edge].tolist(), np.diff(edge, append=len(lengths)).tolist(), strict=True):
            while n:
                k = min(n, 138) if v == 0 and n >= 3 else min(n - 1, 6) if n >= 4 else 1
                if k == 1:
                    symbols.append(v)
                    extra.append(0)
                    more.append(0)
                elif v:  # once, and again k times
                    symbols += (v, 16)
                    extra += (0, k - 3)
                    more += (0, 2)
                    n -= 1
                else:
                    symbols.append(18 if k >= 11 else 17)
                    extra.append(k - 11 if k >= 11 else k - 3)
                    more.append(7 if k >= 11 else 3)
                n -= k
        first = shannon(np.bincount(symbols, minlength=19), 7)
        last = max(k for k in range(19) if first[CODE_ORDER[k]])
        self.put(0, 1)
        self.put(max(0, last - 3), 4)
        for k in range(max(4, last + 1)):
            self.put(int(first[CODE_ORDER[k]]), 3)
        self.put(0, 1)
        own, sizes = codes(first).tolist(), (first if np.count_nonzero(first) > 1 else np.zeros_like(first)).tolist()
        self.values += [own[x] | e << sizes[x] for x, e in zip(symbols, extra, strict=True)]
        self.sizes += [sizes[x] + m for x, m in zip(symbols, more, strict=True)]

    def bits(self) -> int:
        """All that was put, as one number."""
        total, at = 0, 0
        for v, n in zip(self.values, self.sizes, strict=True):
            total |= v << at
            at += n
        return total

    def size(self) -> int:
        return sum(self.sizes)


def _container(payload: bytes) -> bytes:
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(payload) + pad, b"WEBP", b"VP8L", len(payload)) + payload + b"\0" * pad


def _symbols(flat: list[int], width: int, cache_bits: int, refer: bool) -> list[tuple]:
    """Literals, back-references and cache hits of an image: ('l', pixel), ('c', index) or ('r', length, distance code)."""
    out, at, where = [], 0, {}
    cache = [0] * (1 << cache_bits)
    far = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}

    def hashed(p: int) -> int:
        return p * CACHE_MUL % (1 << 32) >> (32 - cache_bits)
    while at < len(flat):
        n, d = 0, 0
        if refer:
            for back in {1, at - where.get(tuple(flat[at : at + 3]), at)}:
                if 0 < back <= at:
                    k = 0
                    while k < 4096 and at + k < len(flat) and flat[at + k] == flat[at + k - back]:
                        k += 1
                    if k > n:
                        n, d = k, back
        if n >= 3:
            out.append(("r", n, far.get(d, d + 120)))
        elif cache_bits and cache[hashed(flat[at])] == flat[at] and at:
            n = 1
            out.append(("c", hashed(flat[at])))
        else:
            n = 1
            out.append(("l", flat[at]))
        for k in range(at, at + n):
            where[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[hashed(flat[k])] = flat[k]
        at += n
    return out


def _put_image(w: Writer, p: np.ndarray, width: int, cache_bits: int = 0, refer: bool = False, main: bool = False) -> None:
    found = _symbols([int(x) for x in p.ravel()], width, cache_bits, refer)
    coded = []
    for s in found:
        if s[0] == "l":
            v = s[1]
            coded.append([(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)])
        elif s[0] == "c":
            coded.append([(0, 280 + s[1], 0, 0)])
        else:
            a, b = _prefix(s[1]), _prefix(s[2])
            coded.append([(0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2])])
    lengths = []
    for k, size in enumerate(ALPHABETS):
        size += (1 << cache_bits) if k == 0 and cache_bits else 0
        lengths.append(huffman(np.bincount([c[1] for one in coded for c in one if c[0] == k], minlength=size)))
    w.put(int(cache_bits > 0), 1)
    w.put(cache_bits, 4 if cache_bits else 0)
    if main:
        w.put(0, 1)
    for n in lengths:
        w.code(n)
    own = [codes(n) for n in lengths]
    free = [np.count_nonzero(n) <= 1 for n in lengths]
    for one in coded:
        for k, s, n, extra in one:
            w.put(int(own[k][s]), 0 if free[k] else int(lengths[k][s]))
            w.put(extra, n)


def write(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, refer: bool = True, modes: np.ndarray | None = None, elements: np.ndarray | None = None, size: int = 2) -> bytes:
    """A lossless file. transforms: kinds in the order in which they are applied; modes: predictor of each tile of
    2 ** size pixels; elements: cross-colour numbers of each tile, as pixels."""
    p = np.ascontiguousarray(pixels, dtype=np.uint32)
    height, width = p.shape
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        shape = (_tiles(height, size), _tiles(p.shape[1], size))
        if kind == PREDICTOR:
            m = np.resize(np.arange(14) if modes is None else modes, shape).astype(np.uint32)
            w.put(size - 2, 3)
            _put_image(w, OPAQUE | m << 8, shape[1])
            p = _join(_predictor(_split(p), m, size, True))
        elif kind == CROSS_COLOUR:
            e = np.resize(np.array([0xFF102030], dtype=np.uint32) if elements is None else elements, shape).astype(np.uint32)
            w.put(size - 2, 3)
            _put_image(w, e, shape[1])
            p = _join(_cross(_split(p), e, size, True))
        elif kind == SUBTRACT_GREEN:
            c = _split(p)
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            p = _join(c)
        else:
            table, index = np.unique(p, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette has 256 colours at most")
            w.put(len(table) - 1, 8)
            steps = np.diff(_split(table), axis=0, prepend=np.zeros((1, 4), dtype=np.int32))
            _put_image(w, _join(steps), len(table))
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            each, wide = 8 >> pack, _tiles(p.shape[1], pack)
            index = np.pad(index.reshape(p.shape), ((0, 0), (0, (wide << pack) - p.shape[1]))).reshape(height, wide, 1 << pack)
            p = (OPAQUE | (sum(index[..., k] << (each * k) for k in range(1 << pack)) << 8)).astype(np.uint32)
    w.put(0, 1)
    _put_image(w, p, p.shape[1], cache_bits, refer, main=True)
    return _container(w.bits().to_bytes((w.size() + 7) // 8, "little"))
