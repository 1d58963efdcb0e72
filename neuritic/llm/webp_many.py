"""Many lossless WebP images of bytes at once: rows of RGB pixels.

Writing chooses for each image, by the size it expects, one of: no transform, subtract-green, a predictor from the left
or from above, cross-colour with slopes fitted to the image, or a palette; then back-references wherever three pixels
stand in the image before, and a colour cache if that is shorter. An image takes the prefix codes that a fixed sample of prose
gives under the same transform, or such as are fitted to itself where that is far shorter; so a file follows from its
payload alone, whatever is written beside it. Reading parses every distinct header, decodes the pixels of images side by side (the next pixel of
every image at a step, each with its codes, cache and back-references), and inverts the transforms. What only other
writers make, such as several groups of codes, is left to webp.read().
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from . import webp
from .webp import CACHE_MUL, CROSS_COLOUR, NEAR, OPAQUE, PALETTE, PREDICTOR, SUBTRACT_GREEN, Bits, Header, Writer

#: Bytes in a row of pixels; a payload has whole rows.
ROW = 576
_WIDTH = ROW // 3
#: Rows of an image; longer payloads become several files, one after the other, which can be decoded side by side.
ROWS = 32
CACHE_BITS = 8
#: Longest codes of green (with lengths and cache), red and blue, alpha, distances.
_MOST = (11, 10, 10, 8, 8)
#: Side of a transform's tiles, as a power of two: one tile a row of them.
_TILE = 9
_LONGEST = 4096
#: Codes of an image's own are taken where they make it shorter than this share.
OWN = 0.6
_NEAR = {x + y * _WIDTH: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * _WIDTH >= 1}


_SHARE = np.arange(1 << 14) * np.log2(np.maximum(np.arange(1 << 14), 1))


def _cost(*histograms: np.ndarray) -> float:
    """Bits that codes for these symbols take, descriptions of the codes included."""
    total = 0.0
    for h in histograms:
        used, n = int(np.count_nonzero(h)), int(h.sum())
        if used > 1:
            total += n * math.log2(n) - float(_SHARE[h].sum()) + 3.2 * used + 60
    return total


def _counts(*channels: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(c, minlength=256) for c in channels]


def _slope(x: np.ndarray, y: np.ndarray) -> int:
    """The element of a cross-colour transform that takes most of x out of y."""
    x, y = x.view(np.int8).astype(np.float32), y.view(np.int8).astype(np.float32)
    x -= x.mean()
    v = float(x @ x)
    return int(np.clip(round(32 * float(x @ (y - y.mean())) / v), -128, 127)) if v else 0


def _transformed(c: np.ndarray, only: tuple | None = None) -> tuple[list[tuple], np.ndarray, int]:
    """The transforms that make an image's literals shortest, what is coded then, and its width.

    only: the one kind of transform that may be chosen, if it can be. c: red, green and blue of each pixel. Sizes are compared on the channels; only the best is carried out.
    """
    r, g, b = (np.ascontiguousarray(c[:, k]) for k in range(3))
    wide = c.astype(np.uint32)
    p = OPAQUE | wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]
    rows, tiles = p.reshape(-1, _WIDTH), webp._tiles(len(p) // _WIDTH, _TILE)
    sizes: list[tuple] = [(_cost(*_counts(g, r, b)),)]
    table = np.unique(p)
    if 1 < len(table) <= 256:
        sizes.append((_cost(np.unique(p, return_counts=True)[1]) + 60 + 20.0 * len(table), PALETTE))
    if len(table) > 1:
        sizes.append((_cost(*_counts(g, r - g, b - g)), SUBTRACT_GREEN))
        sizes.append((_cost(*_counts(*(np.diff(x) for x in (g, r, b)))) + 40, PREDICTOR, 1))
        if len(rows) > 1:
            sizes.append((_cost(*_counts(*(x[_WIDTH:] - x[:-_WIDTH] for x in (g, r, b)))) * len(rows) / (len(rows) - 1) + 40, PREDICTOR, 2))
        to_red, to_blue = _slope(g, r), _slope(g, b)
        x = g.view(np.int8).astype(np.int32)
        if max(abs(to_red), abs(to_blue)) > 4:  # below an eighth of green it takes nothing away
            sizes.append((_cost(*_counts(g, (r - (to_red * x >> 5)).astype(np.uint8), (b - (to_blue * x >> 5)).astype(np.uint8))) + 60, CROSS_COLOUR))
    _, *kind = min([z for z in sizes if z[1:] == only] or sizes)
    if not kind:
        return [], p, _WIDTH
    if kind[0] == PALETTE:
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        each, short = 8 >> pack, webp._tiles(_WIDTH, pack)
        index = np.pad(np.searchsorted(table, p).reshape(rows.shape), ((0, 0), (0, (short << pack) - _WIDTH))).reshape(len(rows), short, 1 << pack)
        return [(PALETTE, table)], (OPAQUE | sum(index[..., k] << (each * k) for k in range(1 << pack)) << 8).astype(np.uint32).ravel(), short
    if kind[0] == PREDICTOR:
        data = np.full(tiles, OPAQUE | kind[1] << 8, dtype=np.uint32)
        coded = webp._predictor(webp._split(rows), np.full((1, 1), kind[1]), _TILE, True)
    elif kind[0] == CROSS_COLOUR:
        data = np.full(tiles, OPAQUE | (to_blue & 255) << 8 | (to_red & 255), dtype=np.uint32)
        coded = webp._cross(webp._split(rows), data[:, None], _TILE, True)
    else:
        data, coded = None, webp._split(rows)
        coded[..., 0] -= coded[..., 1]
        coded[..., 2] -= coded[..., 1]
    return [(kind[0], data)], webp._join(coded).ravel(), _WIDTH


def _before(keys: np.ndarray) -> np.ndarray:
    """For each place the last place before it with the same key, or -1. Keys of one or two bytes are sorted fastest."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out = np.full(len(keys), -1)
    out[order[same + 1]] = order[same]
    return out


def _references(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of back-references of three pixels and more."""
    if len(p) < 4:
        return (np.zeros(0, dtype=np.int64),) * 3
    x = p.astype(np.uint64)
    key = x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2:] * np.uint64(0x165667B19E3779F9)
    back = _before((key >> np.uint64(48)).astype(np.uint16))
    at, found = 0, []
    places = np.flatnonzero(back >= 0)
    places = places[key[places] == key[back[places]]]
    for t, b in zip(places.tolist(), back[places].tolist(), strict=True):
        if t < at:
            continue
        n, step = 0, 16
        while n < _LONGEST and t + n < len(p):
            step = min(step * 4, _LONGEST - n, len(p) - t - n)
            equal = p[t + n : t + n + step] == p[b + n : b + n + step]
            if not equal.all():
                n += int(equal.argmin())
                break
            n += step
        if n >= 3:
            found.append((t, n, t - b))
            at = t + n
    return tuple(np.array(found, dtype=np.int64).reshape(-1, 3).T)


def _prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, numbers of extra bits and extra bits of lengths or distances."""
    if not len(v):
        return v, v, v
    v = v - 1
    high = np.frexp(np.maximum(v, 1))[1].astype(np.int64) - 1
    small = v < 4
    symbol = np.where(small, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    extra = np.where(small, 0, high - 1)
    return symbol, extra, v & ((1 << np.maximum(extra, 0)) - 1)


#: Where the symbols of the five codes stand in an image's counts.
_AT = (0, 280 + (1 << CACHE_BITS), 536 + (1 << CACHE_BITS), 792 + (1 << CACHE_BITS), 1048 + (1 << CACHE_BITS), 1088 + (1 << CACHE_BITS))
#: Fixed value: prose that common codes are fitted to.
_PROSE = (
    "The first part of the work was to find out what people had written, and when. It was not long before most of it came to light: "
    "letters, lists and notes, 27 in all, from the years 1843 to 1909. Some of these were in other hands; a few could not be read.\n"
    "Die meisten der Briefe sind in einer kleinen, festen Schrift geschrieben, und nur wenige tragen ein Datum oder den Namen eines Ortes. "
    "Para la gente de la ciudad, los papeles eran una cosa sin valor, pero en la casa nadie los quiso quemar. "
    "Les autres documents ont été trouvés dans une boîte, sous le toit, avec des livres et une carte de la région.\n"
)


@dataclass
class _Image:
    """An image as symbols, before it has codes. start, ls, ln, lv, ds, dn, dv: back-references and their symbols."""

    rows: int
    transforms: list[tuple]
    p: np.ndarray
    cache: bool
    whole: np.ndarray
    cached: np.ndarray
    key: np.ndarray
    start: np.ndarray
    references: tuple
    counts: np.ndarray
    own: float  # bits with codes of its own
    kind: tuple = ()


@dataclass
class _Codes:
    lengths: list[np.ndarray]
    cache: bool
    head: Writer = field(default_factory=Writer)

    def __post_init__(self):
        self.code = [webp.codes(n).astype(np.uint64) for n in self.lengths]
        self.size = [n if np.count_nonzero(n) > 1 else np.zeros_like(n) for n in self.lengths]
        w = self.head
        w.put(0, 1)
        w.put(int(self.cache), 1)
        w.put(CACHE_BITS if self.cache else 0, 4 if self.cache else 0)
        w.put(0, 1)
        for k, n in enumerate(self.lengths):
            w.code(n if k or self.cache else n[:280])
        self.bits = w.bits(), w.size()
        self.all_sizes = np.concatenate(self.size)

    @staticmethod
    def fitted(counts: np.ndarray, cache: bool) -> _Codes:
        return _Codes([webp.shannon(counts[a:b], most) for a, b, most in zip(_AT, _AT[1:], _MOST, strict=False)], cache)


def _image(payload: bytes, only: tuple | None = None) -> _Image:
    transforms, p, width = _transformed(np.frombuffer(payload, dtype=np.uint8).reshape(-1, 3), only)
    start, length, far = _references(p)
    literal = np.ones(len(p), dtype=bool)
    for t, n in zip(start.tolist(), length.tolist(), strict=True):
        literal[t : t + n] = False
    places = np.flatnonzero(literal)
    key = ((p * np.uint64(CACHE_MUL) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
    last = _before(key.astype(np.uint8))
    hit = ((last >= 0) & (p[last] == p))[places]
    near = _NEAR if width == _WIDTH else {}
    ls, ln, lv = _prefixes(length)
    ds, dn, dv = _prefixes(np.array([near.get(d, d + 120) for d in far.tolist()], dtype=np.int64))
    options = []
    for cache in (False, True):
        whole, cached = (places[~hit], places[hit]) if cache else (places, places[:0])
        x = p[whole]
        counts = np.zeros(_AT[-1], dtype=np.int64)
        counts[:256] = np.bincount(x >> 8 & 255, minlength=256)
        counts[256:280] = np.bincount(ls, minlength=24)
        counts[280 : _AT[1]] = np.bincount(key[cached], minlength=1 << CACHE_BITS)
        counts[_AT[1] : _AT[2]] = np.bincount(x >> 16 & 255, minlength=256)
        counts[_AT[2] : _AT[3]] = np.bincount(x & 255, minlength=256)
        counts[_AT[3] + (int(x[0]) >> 24)] = len(x)
        counts[_AT[4] :] = np.bincount(ds, minlength=40)
        options.append((_cost(*(counts[a:b] for a, b in zip(_AT, _AT[1:], strict=False))), cache, whole, cached, counts))
        if not hit.any():
            break
    own, cache, whole, cached, counts = min(options, key=lambda o: o[0])
    return _Image(len(payload) // ROW, transforms, p, cache, whole, cached, key, start, (ls, ln, lv, ds, dn, dv), counts, own, _kind(transforms))


def _kind(transforms: list[tuple]) -> tuple:
    """The kind of a list of transforms: none, one, or a predictor and its mode."""
    return tuple((kind, int(data.flat[0]) >> 8 & 255) if kind == PREDICTOR else (kind,) for kind, data in transforms)[0] if transforms else ()


@lru_cache(maxsize=64)
def _common(kind: tuple, cache: bool, alpha: int) -> _Codes:
    """Codes for all images of a kind, with every symbol that may come up and one alpha value."""
    prose = (_PROSE * 3).encode()
    sample = _image(prose[: len(prose) // ROW * ROW], kind)
    of = sample if sample.kind == kind else _image(prose[: len(prose) // ROW * ROW], ())
    literal = of.p
    counts = np.zeros(_AT[-1], dtype=np.int64)
    for a, shift in ((0, 8), (_AT[1], 16), (_AT[2], 0)):
        counts[a : a + 256] = np.bincount(literal >> shift & 255, minlength=256) * 8 + 1
    counts[256:280] = len(literal) // 24  # an eighth of all are back-references
    counts[256 + 12 : 280] = 1
    if cache:
        counts[280 : _AT[1]] = 1 + len(literal) * 2 >> CACHE_BITS
    counts[_AT[3] + alpha] = 1
    counts[_AT[4] :] = np.arange(40) + 1
    return _Codes.fitted(counts, cache)


def _file(image: _Image, codes: _Codes) -> bytes:
    w = Writer()
    for v, n in ((0x2F, 8), (_WIDTH - 1, 14), (image.rows - 1, 14), (0, 1), (0, 3)):
        w.put(v, n)
    for kind, data in image.transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(_TILE - 2, 3)
            webp._put_image(w, data, 1)
        elif kind == PALETTE:
            w.put(len(data) - 1, 8)
            webp._put_image(w, webp._join(np.diff(webp._split(data), axis=0, prepend=np.zeros((1, 4), dtype=np.int32))), len(data))
    head, first = w.bits() | codes.bits[0] << w.size(), w.size() + codes.bits[1]
    ls, ln, lv, ds, dn, dv = image.references
    x = image.p[image.whole]
    g, r, b = x >> 8 & 255, x >> 16 & 255, x & 255
    k = image.key[image.cached] + 280
    code, size = codes.code, codes.size
    gs, rs = size[0][g], size[1][r]
    value = [code[0][g] | code[1][r] << gs.astype(np.uint64) | code[2][b] << (gs + rs).astype(np.uint64), code[0][k]]
    bits = [gs + rs + size[2][b], size[0][k]]
    at, part = size[0][256 + ls], code[0][256 + ls]
    for v, n in ((lv, ln), (code[4][ds], size[4][ds]), (dv, dn)):
        part = part | v.astype(np.uint64) << at.astype(np.uint64)
        at = at + n
    value, bits = np.concatenate([*value, part]), np.concatenate([*bits, at])
    order = np.argsort(np.concatenate([image.whole, image.cached, image.start]), kind="stable")
    return webp._container(_joined(head, first, value[order], bits[order]))


def _joined(head: int, first: int, value: np.ndarray, size: np.ndarray) -> bytes:
    """The header's bits and then these values of so many bits each."""
    ends = first + np.cumsum(size)
    last = int(ends[-1])
    keep = size > 0
    value, at, size = value[keep], (ends - size)[keep], size[keep]
    out = np.zeros((last >> 6) + 2, dtype=np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    if len(at):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(value << shift, starts)
        over = np.flatnonzero((at & 63) + size > 64)  # at most one a word
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    h = np.frombuffer(head.to_bytes(((first >> 6) + 1) * 8, "little"), dtype=np.uint64)
    out[: len(h)] |= h
    return out.astype("<u8").tobytes()[: (last + 7) // 8]


def _images(payload: bytes) -> list[bytes]:
    return [payload[k : k + ROW * ROWS] for k in range(0, len(payload), ROW * ROWS)]


def write_many(payloads: list[bytes]) -> list[bytes]:
    """Lossless files for payloads of whole rows of bytes; equal ones are written once."""
    done: dict[bytes, bytes] = {}
    for x in {x for p in payloads for x in _images(p)}:
        image = _image(x)
        codes = _common(image.kind, image.cache, int(image.counts[_AT[3] : _AT[4]].argmax()))
        if image.own < OWN * (image.counts @ codes.all_sizes + codes.bits[1]):
            codes = _Codes.fitted(image.counts, image.cache)
        done[x] = _file(image, codes)
    return [b"".join(done[x] for x in _images(p)) for p in payloads]


def _files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


def read_many(media: list[bytes], together: int = 4096) -> list[bytes]:
    """The payloads of files that write_many() made, or of any lossless files with three bytes a pixel."""
    files = [(k, f) for k, m in enumerate(media) for f in _files(m)]
    done: list[bytes] = [b""] * len(files)
    seen: dict[bytes, int] = {}
    known: dict[bytes, list[Header]] = {}
    again, mine = [], []
    for i, (_, f) in enumerate(files):
        if seen.setdefault(f, i) != i:
            again.append(i)
            continue
        h = _header(f, known)
        if h.tiles is None and h.groups[0][3].width == 0:
            mine.append((i, h))
        else:
            done[i] = _rgb(webp.read(f))
    mine.sort(key=lambda m: -m[1].coded_width * m[1].height)
    for lo in range(0, len(mine), together):
        part = mine[lo : lo + together]
        for (i, h), flat in zip(part, _lanes([h for _, h in part], [files[i][1] for i, _ in part]), strict=True):
            done[i] = _rgb(webp._finish(h, flat))
    for i in again:
        done[i] = done[seen[files[i][1]]]
    out = [b""] * len(media)
    for (k, _), b in zip(files, done, strict=True):
        out[k] += b
    return out


def _header(f: bytes, known: dict[bytes, list[Header]]) -> Header:
    """The file's header, parsed only if no image before had the same but for its height."""
    if f[12:16] != b"VP8L":
        return webp.read_header(f)
    height = ((f[22] >> 6) | f[23] << 2 | (f[24] & 0xF) << 10) + 1
    for h, head, tail, mask in known.get(f[25:57], ()):
        if f.startswith(head, 25) and f[25 + len(head)] & mask == tail and (f[24] >> 4, f[21], f[22] & 63) == h.start:
            same = Header(h.width, height, h.transforms, h.coded_width, h.cache_bits, h.tile_bits, h.tiles, h.groups, h.at)
            return same
    h = webp.read_header(f)
    if all(t[0] in (SUBTRACT_GREEN, PALETTE) for t in h.transforms) and h.tiles is None and h.at < 8 * len(f) - 8:  # nothing in it follows from the height
        h.start = f[24] >> 4, f[21], f[22] & 63
        mask = (1 << (h.at & 7)) - 1
        known.setdefault(f[25:57], []).append((h, f[25 : h.at >> 3], f[h.at >> 3] & mask, mask))
    return h


def _rgb(p: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(p, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1]).tobytes()


def _lanes(heads: list[Header], files: list[bytes]) -> list[np.ndarray]:
    """The coded pixels of images, decoded side by side; those with most pixels first."""
    lanes = len(heads)
    count = np.array([h.coded_width * h.height for h in heads])
    sizes = np.array([len(f) for f in files])
    base = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(files) + b"\0" * 16, dtype=np.uint8)
    wide = np.ndarray((len(raw) - 8,), dtype="<u8", buffer=raw, strides=(1,))  # eight bytes from any place
    pos = base * 8 + np.array([h.at for h in heads])
    tables: list[np.ndarray] = []
    where, mask = np.zeros((3, lanes), dtype=np.int64), np.zeros((3, lanes), dtype=np.int64)
    used, stand = 0, {}
    for lane, h in enumerate(heads):
        for k in range(3):
            code = h.groups[0][k]
            if id(code) not in stand:
                stand[id(code)] = used
                tables.append(code.table)
                used += len(code.table)
            where[k, lane], mask[k, lane] = stand[id(code)], (1 << code.width) - 1
    table = np.concatenate(tables)
    alpha = np.array([int(h.groups[0][3].table[0]) for h in heads], dtype=np.int64) << 24
    cache_bits = np.array([h.cache_bits for h in heads])
    cached = bool(cache_bits.any())
    slots = 1 << cache_bits
    slot = np.cumsum(slots) - slots
    cache, shift = np.zeros(int(slots.sum()), dtype=np.int64), 32 - cache_bits
    off = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.int64)
    copy, back = np.zeros(lanes, dtype=np.int64), np.ones(lanes, dtype=np.int64)
    copying, n = False, lanes
    for t in range(int(count[0])):
        while count[n - 1] <= t:
            n -= 1
        p = pos[:n]
        v = (wide[p >> 3] >> (p & 7).astype(np.uint64)).astype(np.int64)
        g = table[where[0, :n] + (v & mask[0, :n])]
        s, total = g & 0xFFFF, (g >> 16).astype(np.int64)
        v >>= total
        r = table[where[1, :n] + (v & mask[1, :n])]
        lr = r >> 16
        b = table[where[2, :n] + (v >> lr & mask[2, :n])]
        pixel = alpha[:n] | (r & 0xFFFF).astype(np.int64) << 16 | s << 8 | b & 0xFFFF
        start = p + total
        ends = start + lr + (b >> 16)
        odd = np.flatnonzero(s > 255)
        if len(odd):
            ends[odd] = start[odd]
            what = s[odd]
            if cached:
                k = odd[what >= 280]
                pixel[k] = cache[np.minimum(slot[k] + s[k] - 280, len(cache) - 1)]
            odd = odd[what < 280]
        if len(odd) or copying:
            for k in odd[copy[odd] == 0]:  # back-references that start
                bits = Bits(raw[int(p[k] >> 3) : int(p[k] >> 3) + 24].tobytes(), int(p[k] & 7) + int(total[k]))
                copy[k] = webp._unprefix(int(s[k]) - 256, bits)
                d = webp._unprefix(heads[k].groups[0][4].next(bits), bits)
                back[k] = d - 120 if d > 120 else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * heads[k].coded_width)
                if back[k] > t or t + copy[k] > count[k]:
                    raise ValueError("a back-reference points outside the image")
                p[k] = (p[k] >> 3) * 8 + bits.at
            k = np.flatnonzero(copy[:n])
            pixel[k] = out[off[k] + t - back[k]]
            ends[k] = p[k]
            copy[k] -= 1
            copying = bool(len(k))
        pos[:n] = ends
        out[off[:n] + t] = pixel
        if cached:
            cache[slot[:n] + ((pixel * CACHE_MUL & 0xFFFFFFFF) >> shift[:n])] = pixel
    return [out[a : a + c].astype(np.uint32) for a, c in zip(off.tolist(), count.tolist(), strict=True)]
