"""Lossless WebP (VP8L) and the media columns made of it.

decode() reads any lossless WebP file: simple and normal prefix codes, several code groups, back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms. decode_many() reads many files
in step, one code length and then one pixel of each at a time as array operations; what is left when few files still have pixels, and
files of several code groups, is read pixel by pixel.

encode_many() writes such files, again many at a time. For each image it takes the transform (none, subtract green, predictor from the
left or from above, palette) whose channels have the least entropy; repeated runs of pixels become back-references, repeated single
pixels go through a colour cache where that pays; channels, lengths and distances have Huffman codes of their own.

Defined results of the columns: null text is empty; an empty text is one padded block; equal texts give equal
media; repeated rows and null ids keep their rows; an empty table gives an empty result; other columns are ignored; a text is held
in memory with about 100 bytes a pixel of three, and one of more than 16384 * 16384 pixels raises ValueError, as the format has no larger images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import steps, texts_of

BLOCK = 192
SIDE = 64
#: Of each column the one left of it, of the first the last.
_LEFT = np.arange(-1, SIDE - 1)
_MOST = 16384
#: With fewer images than this in step, pixel by pixel is faster.
IN_STEP = 128
# Fixed values of the format: order of code length codes, the multiplier of the colour cache, and sizes of the five alphabets without cache.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CACHE_HASH = 0x1E35A7BD
_SIZES = (280, 256, 256, 256, 40)
#: The near distances: by distance, then by how far aside, right before left.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: The longest back-reference, and the farthest.
_LONGEST, _FARTHEST = 4096, (1 << 20) - 120
_TOP = 15
#: Bytes of texts that are coded at a time, and that are read back at a time.
CODED, READ = 1 << 20, 12 << 20
_U = np.uint64
_REV = np.zeros(1 << _TOP, np.int64)
for _k in range(_TOP):
    _REV |= ((np.arange(1 << _TOP) >> _k) & 1) << (_TOP - 1 - _k)
_REVS = _REV.tolist()


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 16, 0, 8 * len(data)

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the file ends early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


class _Code:
    """A canonical prefix code by its symbols in order and their lengths; a code of one symbol takes no bits."""

    __slots__ = ("symbols", "lengths", "_table", "shift")

    def __init__(self, symbols: list[int] | np.ndarray, lengths: list[int] | np.ndarray):
        self.symbols, self.lengths = symbols, lengths
        self._table: list[int] | None = None
        self.shift = _TOP

    def table(self) -> list[int]:
        """By the next _TOP bits, first bit highest, less the lowest `shift` ones: the symbol and below it in four bits its length."""
        if self._table is None and len(self.symbols) == 1:
            self._table = [int(self.symbols[0]) << 4]
        elif self._table is None:
            t, at = _tables([self])
            self._table, self.shift = t.tolist(), _TOP - int(max(self.lengths))
        return self._table


def _tables(codes: list[_Code]) -> tuple[np.ndarray, np.ndarray]:
    """The tables of many codes end to end, and where each begins, with the end of the last."""
    each = np.array([len(c.symbols) for c in codes])
    symbols = np.concatenate([c.symbols for c in codes], dtype=np.int64)
    n = np.concatenate([c.lengths for c in codes], dtype=np.int64)
    of = np.repeat(np.arange(len(codes)), each)
    n[(each == 1)[of]] = 0
    order = np.argsort(of << 4 | n, kind="stable")
    most = np.maximum.reduceat(n, _sums_before(each)) if len(n) else n
    wide = 1 << (most[of] - n)
    if (np.bincount(of, wide, minlength=len(codes)).astype(np.int64) != 1 << most).any():
        raise ValueError("a prefix code isn't complete")
    return np.repeat((symbols << 4 | n).astype(np.uint16)[order], wide[order]), np.concatenate([[0], np.cumsum(1 << most)])


_REV_7 = (_REV[:128] >> 8).tolist()
#: Extra bits and the shortest runs of symbols 16 to 18 of code length codes.
_MORE, _LEAST = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])


def _read_code(r: _Reader, size: int) -> _Code:
    if r.bits(1):
        two = r.bits(1)
        first = r.bits(8 if r.bits(1) else 1)
        if not two:
            return _Code([first], [1])
        second = r.bits(8)
        return _Code(sorted({first, second}), [1] * len({first, second}))
    given = 4 + r.bits(4)
    x = r.bits(3 * given)
    small: list[list[int]] = [[] for _ in range(8)]
    for k in range(given):
        small[(x >> 3 * k) & 7].append(_LENGTH_ORDER[k])
    used = sum(map(len, small[1:]))
    if used <= 1:
        table = [next((s << 3 for own in small[1:] for s in own), 0)] * 128
    else:
        flat = [s << 3 | n for n in range(1, 8) for s in sorted(small[n]) for _ in range(1 << (7 - n))]
        if len(flat) != 128:
            raise ValueError("a prefix code isn't complete")
        table = [flat[k] for k in _REV_7]
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    data, p, symbols, lengths, last, at = r.data, r.at, [], [], 8, 0
    x, have = 0, 0
    while at < size and left:
        left -= 1
        if have < 14:
            x, have = int.from_bytes(data[p >> 3 : (p >> 3) + 32], "little") >> (p & 7), 248
        e = table[x & 127]
        n, s = e & 7, e >> 3
        if s > 15:
            x >>= n
            if s == 18:
                at, more = at + 11 + (x & 127), 7
            elif s == 17:
                at, more = at + 3 + (x & 7), 3
            else:
                run, more = 3 + (x & 3), 2
                symbols += range(at, at + run)
                lengths += [last] * run
                at += run
            x >>= more
            p += n + more
            have -= n + more
            continue
        if s:
            symbols.append(at)
            lengths.append(s)
            last = s
        at += 1
        x >>= n
        p += n
        have -= n
    if at > size:
        raise ValueError("too many code lengths")
    if p > r.end:
        raise ValueError("the file ends early")
    r.at = p
    return _Code(symbols or [0], lengths or [1])


class _Image:
    """An entropy-coded image up to its pixels, or if it waits and has one code group, up to its codes."""

    def __init__(self, r: _Reader, width: int, height: int, top: bool, waits: bool = False):
        self.r, self.width, self.n = r, width, width * height
        self.cache_bits = r.bits(4) if r.bits(1) else 0
        if self.cache_bits > 11:
            raise ValueError("colour cache too large")
        self.tile = self.across = 0
        self.which: list[int] | None = None
        groups = 1
        if top and r.bits(1):
            self.tile = r.bits(3) + 2
            self.across = -(-width >> self.tile)
            meta = _Image(r, self.across, -(-height >> self.tile), False).pixels()
            self.which = ((meta >> 8) & 0xFFFF).tolist()
            groups = max(self.which) + 1
        self.sizes = (_SIZES[0] + (1 << self.cache_bits if self.cache_bits else 0), *_SIZES[1:])
        self.groups: list[list[_Code]] = []
        if not waits or self.which is not None:
            self.read_codes(groups)

    def read_codes(self, groups: int = 1) -> None:
        self.groups = [[_read_code(self.r, size) for size in self.sizes] for _ in range(groups)]

    def pixels(self, done: np.ndarray | None = None, left: int = 0, far: int = 0, cache: list[int] | None = None) -> np.ndarray:
        """All pixels as 0xAARRGGBB, one after the other, from where those that are done end."""
        n, width, bits = self.n, self.width, self.cache_bits
        out: list[int] = [] if done is None else done.tolist()
        cache = [0] * (1 << bits) if cache is None else cache
        data, p, end = self.r.data, self.r.at, self.r.end
        padded = data + b"\0" * 8
        v = np.ndarray(len(data), "<u8", padded, 0, (1,))[p >> 3 :].tolist()
        first = p >> 3 << 3
        rev = _REVS
        groups = [[(c.table(), c.shift) for c in g] for g in self.groups]
        which, tile, across = self.which, self.tile, self.across
        (tg, sg), (tr, sr), (tb, sb), (ta, sa), (td, sd) = groups[0]

        def prefixed(s: int) -> int:
            nonlocal p
            if s < 4:
                return s + 1
            more = (s - 2) >> 1
            x = (v[(p - first) >> 3] >> (p & 7)) & ((1 << more) - 1)
            p += more
            return ((2 + (s & 1)) << more) + x + 1

        def again(length: int, far: int) -> None:
            at = len(out)
            if far > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            new = out[at - far : at - far + length]
            while len(new) < length:
                new += new[: length - len(new)]
            out.extend(new)
            if bits:
                for x in new:
                    cache[(_CACHE_HASH * x & 0xFFFFFFFF) >> (32 - bits)] = x

        if left:
            again(left, far)
        at = len(out)
        while at < n:
            if p > end:
                raise ValueError("the file ends early")
            if which is not None:
                (tg, sg), (tr, sr), (tb, sb), (ta, sa), (td, sd) = groups[which[(at // width >> tile) * across + (at % width >> tile)]]
            x = v[(p - first) >> 3] >> (p & 7)
            e = tg[rev[x & 0x7FFF] >> sg]
            k = e & 15
            s = e >> 4
            if s < 256:
                x >>= k
                e = tr[rev[x & 0x7FFF] >> sr]
                x >>= e & 15
                k += e & 15
                f = tb[rev[x & 0x7FFF] >> sb]
                k += f & 15
                if sa == _TOP:
                    g = ta[0]
                else:
                    y = v[(p + k - first) >> 3] >> ((p + k) & 7)
                    g = ta[rev[y & 0x7FFF] >> sa]
                    k += g & 15
                p += k
                x = (g >> 4) << 24 | (e >> 4) << 16 | s << 8 | f >> 4
            elif s < 280:
                p += k
                length = prefixed(s - 256)
                e = td[rev[(v[(p - first) >> 3] >> (p & 7)) & 0x7FFF] >> sd]
                p += e & 15
                again(length, _distance(prefixed(e >> 4), width))
                at += length
                continue
            else:
                p += k
                x = cache[s - 280]
            out.append(x)
            at += 1
            if bits:
                cache[(_CACHE_HASH * x & 0xFFFFFFFF) >> (32 - bits)] = x
        if p > end:
            raise ValueError("the file ends early")
        self.r.at = p
        return np.array(out, np.uint32)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


def _read_codes(images: list[_Image]) -> None:
    """The codes of images that wait for them, a code length of every image at a time; as _read_code reads them."""
    data = b"".join(i.r.data for i in images) + b"\0" * 16
    v = np.ndarray(len(data) - 8, "<u8", data, 0, (1,))
    sizes = np.cumsum([0] + [len(i.r.data) for i in images])
    p = sizes[:-1] * 8 + np.array([i.r.at for i in images])
    # a broken file stays inside its own padding; that it ended early shows at the end
    stop = sizes[1:] * 8 - 64
    every = np.arange(len(images))
    window = lambda p: (v[p >> 3] >> (p & 7).astype(_U)).view(np.int64)
    for k in range(len(_SIZES)):
        size = np.array([i.sizes[k] for i in images])
        own = np.zeros((len(images), max(256, int(size.max()))), np.uint8)
        x = window(p)
        simple = (x & 1) > 0
        i, y = every[simple], x[simple] >> 1
        two, first_bits = y & 1, np.where(y & 2, 8, 1)
        own[i, y >> 2 & ((1 << first_bits) - 1)] = 1
        second = y >> (2 + first_bits) & 255
        own[i[two > 0], second[two > 0]] = 1
        p[i] += 3 + first_bits + 8 * two

        i = every[~simple]
        given = 4 + (x[i] >> 1 & 15)
        y = window(p[i] + 5)
        lengths = np.zeros((len(i), 19), np.int64)
        for j, symbol in enumerate(_LENGTH_ORDER):
            lengths[:, symbol] = np.where(j < given, y >> 3 * j & 7, 0)
        p[i] += 5 + 3 * given
        table = _short_tables(lengths).ravel()
        x = window(p[i])
        bits = np.where(x & 1, 2 + 2 * (x >> 1 & 7), 0)
        left = np.where(x & 1, 2 + (x >> 4 & ((1 << bits) - 1)), size[i])
        p[i] += np.where(x & 1, 4 + bits, 1)

        q, last, at, to, until, begin = np.minimum(p[i], stop[i]), np.full(len(i), 8), np.zeros(len(i), np.int64), size[i], stop[i], np.arange(len(i)) * 128
        while len(i):
            x = window(q)
            e = table[begin + (x & 127)]
            n, s = e & 7, e >> 3
            q += n
            plain = s < 16
            own[i, at] = np.where(plain, s, 0)
            at += 1
            c = np.flatnonzero(~plain)
            if len(c):
                more = _MORE[s[c]]
                run = _LEAST[s[c]] + (x[c] >> n[c] & ((1 << more) - 1))
                for j in np.flatnonzero(s[c] == 16).tolist():
                    a = int(at[c[j]]) - 1
                    own[i[c[j]], a : a + int(run[j])] = last[c[j]]
                q[c] += more
                at[c] += run - 1
            last = np.where(plain & (s > 0), s, last)
            left -= 1
            q = np.minimum(q, until)
            on = (at < to) & (left > 0)
            if not on.all():
                p[i[~on]] = q[~on]
                if (at > to).any():
                    raise ValueError("too many code lengths")
                i, q, last, at, to, until, begin, left = (a[on] for a in (i, q, last, at, to, until, begin, left))
        p = np.minimum(p, stop)
        own[~own.any(1), 0] = 1
        row, symbol = np.nonzero(own)
        length = own[row, symbol]
        bounds = np.searchsorted(row, np.arange(len(images) + 1)).tolist()
        for image, a, b in zip(images, bounds, bounds[1:], strict=False):
            image.groups = image.groups or [[]]
            image.groups[0].append(_Code(symbol[a:b], length[a:b]))
    for image, at in zip(images, (p - sizes[:-1] * 8).tolist(), strict=True):
        image.r.at = at
        if at > image.r.end:
            raise ValueError("the file ends early")


def _short_tables(lengths: np.ndarray) -> np.ndarray:
    """Of each row of lengths of code length codes, by the next 7 bits: the symbol and below it in three bits its length."""
    used = lengths > 0
    lone = used.sum(1) <= 1
    weight = np.where(used, 128 >> lengths, 0)
    weight[lone] = 0
    weight[lone, lengths[lone].argmax(1)] = 128
    if (weight.sum(1) != 128).any():
        raise ValueError("a prefix code isn't complete")
    symbol = np.arange(19)
    entry = symbol << 3 | np.where(lone[:, None], 0, lengths)
    order = np.argsort(lengths << 5 | symbol, 1)
    flat = np.repeat(np.take_along_axis(entry, order, 1).ravel(), np.take_along_axis(weight, order, 1).ravel())
    return flat.reshape(-1, 128)[:, _REV_7]


def _in_step(images: list[_Image]) -> list[np.ndarray]:
    """Pixels of images of one code group each, a pixel of every image at a time while there are IN_STEP that have one."""
    order = sorted(range(len(images)), key=lambda k: -images[k].n)
    own = [images[k] for k in order]
    n = np.array([i.n for i in own])
    base = np.concatenate([[0], np.cumsum(n)])
    data = b"".join(i.r.data for i in own) + b"\0" * 16
    v = np.ndarray(len(data) - 8, "<i8", data, 0, (1,))  # shifts repeat the sign, so 57 bits count
    sizes = np.cumsum([0] + [len(i.r.data) for i in own])
    p = sizes[:-1] * 8 + np.array([i.r.at for i in own])
    # a broken file stays inside its own padding; that it ended early shows at the end
    last = sizes[1:] * 8 - 64
    codes = [c for i in own for c in i.groups[0]]
    t, at = _tables(codes)
    shift = (_TOP + 1 - np.frexp(np.diff(at).astype(np.float64))[1]).reshape(-1, 5).T.copy()
    at = at[:-1].reshape(-1, 5).T.copy()
    alpha = bool((shift[3] < _TOP).any())
    opaque = t[at[3]].astype(np.int64) >> 4 << 24
    bits = np.array([i.cache_bits for i in own])
    cached = bool(bits.any())
    slots = np.concatenate([[0], np.cumsum(1 << bits)])
    cache = np.zeros(slots[-1], np.int64)
    down = 32 - bits
    near = {w: np.array([0] + [_distance(k, w) for k in range(1, 121)]) for w in {i.width for i in own}}
    aside = np.array([near[i.width] for i in own])
    left, far = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    out = np.zeros(base[-1], np.uint32)
    until = int(n[IN_STEP - 1]) if len(own) >= IN_STEP else 0
    alive = len(n) - np.searchsorted(n[::-1], np.arange(until), side="right")
    busy = False

    def window(p: np.ndarray) -> np.ndarray:
        return v[p >> 3] >> (p & 7)

    def prefixed(s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = s.astype(np.int64)
        more = np.where(s < 4, 0, (s - 2) >> 1)
        x = window(p) & ((1 << more) - 1)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << more) + x + 1), p + more

    for step in range(until):
        k = int(alive[step])
        here = p[:k]
        x = window(here)
        e = t[at[0, :k] + (_REV[x & 0x7FFF] >> shift[0, :k])]
        first = e & 15
        s = e >> 4
        x >>= first
        e = t[at[1, :k] + (_REV[x & 0x7FFF] >> shift[1, :k])]
        f = e & 15
        x >>= f
        used = first + f
        g = t[at[2, :k] + (_REV[x & 0x7FFF] >> shift[2, :k])]
        used += g & 15
        pixel = np.left_shift(e >> 4, 16, dtype=np.int64) | (s << 8 | g >> 4) | opaque[:k]
        if alpha:
            h = t[at[3, :k] + (_REV[window(here + used) & 0x7FFF] >> shift[3, :k])]
            used += h & 15
            pixel = (pixel & 0xFFFFFF) | (h.astype(np.int64) >> 4 << 24)
        now = here + used
        if busy:  # what goes on copying reads nothing
            c = left[:k].nonzero()[0]
            s[c] = 0
            now[c] = here[c]
        i = (s > 255).nonzero()[0]
        if len(i):
            so = s[i]
            q = here[i] + first[i]
            now[i] = q
            hit = so >= 280
            c = hit.nonzero()[0]
            if len(c):
                h = i[c]
                pixel[h] = cache[slots[h] + so[c] - 280]
            c = (~hit).nonzero()[0]
            if len(c):
                i = i[c]
                length, q = prefixed(so[c] - 256, q[c])
                e = t[at[4, i] + (_REV[window(q) & 0x7FFF] >> shift[4, i])]
                code, q = prefixed(e >> 4, q + (e & 15))
                d = np.where(code > 120, code - 120, aside[i, np.minimum(code, 120)])
                if ((d > step) | (length > n[i] - step)).any():
                    raise ValueError("a back-reference leaves the image")
                now[i] = q
                left[i], far[i] = length, d
                busy = True
        p[:k] = np.minimum(now, last[:k])
        if busy:
            c = left[:k].nonzero()[0]
            pixel[c] = out[base[c] + step - far[c]]
            rest = left[c] - 1
            left[c] = rest
            busy = bool(rest.any())
        out[base[:k] + step] = pixel
        if cached:
            cache[slots[:k] + ((pixel * _CACHE_HASH & 0xFFFFFFFF) >> down[:k])] = pixel
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(images)
    for k, i in enumerate(own):
        i.r.at = int(p[k] - sizes[k] * 8)
        if i.r.at > i.r.end:
            raise ValueError("the file ends early")
        done = out[base[k] : base[k] + min(until, i.n)].copy()
        result[order[k]] = done if i.n <= until else i.pixels(done, int(left[k]), int(far[k]), cache[slots[k] : slots[k + 1]].tolist())
    return result


def _unpredict(pixels: np.ndarray, modes: np.ndarray, width: int, height: int, tile: int) -> np.ndarray:
    """A row at a time: guesses from the row above are arrays, those from the left alone a running sum, the others pixel by pixel."""
    across = -(-width >> tile)
    rest = pixels.reshape(height, width, 4).astype(np.int64)
    p = np.zeros((height, width + 1, 4), np.int64)
    half = lambda a, b: (a + b) >> 1
    black = np.array([0, 0, 0, 255])
    p[0, :width] = np.cumsum(rest[0] + np.concatenate([black[None], np.zeros((width - 1, 4), np.int64)]), 0) & 255
    for y in range(1, height):
        # the pixel right of the last is the first of this row
        p[y - 1, width] = p[y, 0] = (rest[y, 0] + p[y - 1, 0]) & 255
        for cell in range(across):
            a, b = max(1, cell << tile), min(width, (cell + 1) << tile)
            m = int(modes[(y >> tile) * across + cell]) & 15
            up, right, corner = p[y - 1, a:b], p[y - 1, a + 1 : b + 1], p[y - 1, a - 1 : b - 1]
            given = {0: black, 14: black, 15: black, 2: up, 3: right, 4: corner}.get(m)
            if m in (8, 9):
                given = half(corner if m == 8 else right, up)
            if given is not None:
                p[y, a:b] = (rest[y, a:b] + given) & 255
            elif m == 1:
                p[y, a:b] = (np.cumsum(rest[y, a:b], 0) + p[y, a - 1]) & 255
            else:
                left = p[y, a - 1]
                for x in range(b - a):
                    u, c = up[x], corner[x]
                    if m == 5:
                        guess = half(half(left, right[x]), u)
                    elif m == 6:
                        guess = half(left, c)
                    elif m == 7:
                        guess = half(left, u)
                    elif m == 10:
                        guess = half(half(left, c), half(u, right[x]))
                    elif m == 11:
                        guess = left if np.abs(u - c).sum() < np.abs(left - c).sum() else u
                    elif m == 12:
                        guess = np.clip(left + u - c, 0, 255)
                    else:
                        middle = half(left, u)
                        guess = np.clip(middle + np.fix((middle - c) / 2).astype(np.int64), 0, 255)
                    left = p[y, a + x] = (rest[y, a + x] + guess) & 255
    return p[:, :width].reshape(-1, 4).astype(np.uint8)


def _uncross(pixels: np.ndarray, cells: np.ndarray, width: int, height: int, tile: int) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    c = cells[(y >> tile) * -(-width >> tile) + (x >> tile)].view(np.int8).astype(int)
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(int)
    p = pixels.astype(int)
    green = signed(p[:, 1])
    red = p[:, 0] + ((c[:, 2] * green) >> 5)
    blue = p[:, 2] + ((c[:, 1] * green) >> 5) + ((c[:, 0] * signed(red)) >> 5)
    return np.stack([red & 255, p[:, 1], blue & 255, p[:, 3]], 1).astype(np.uint8)


class _File(NamedTuple):
    width: int
    height: int
    alpha: int
    transforms: list[tuple]
    image: _Image


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) RGBA bytes of 0xAARRGGBB."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]


def _open(data: bytes, waits: bool = False) -> _File:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    r = _Reader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.bits(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    alpha = r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (x[0] for x in transforms):
            raise ValueError("a transform occurs twice")
        if kind < 2:
            tile = r.bits(3) + 2
            transforms.append((kind, now, tile, _bytes(_Image(r, -(-now >> tile), -(-height >> tile), False).pixels())))
        elif kind == 2:
            transforms.append((kind, now, 0, None))
        else:
            size = r.bits(8) + 1
            palette = np.cumsum(_bytes(_Image(r, size, 1, False).pixels()).astype(int), 0).astype(np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, now, packed, palette))
            now = -(-now >> packed)
    return _File(width, height, alpha, transforms, _Image(r, now, height, True, waits))


def _undo(file: _File, pixels: np.ndarray) -> np.ndarray:
    pixels = _bytes(pixels)
    for kind, w, bits, extra in reversed(file.transforms):
        if kind == 0:
            pixels = _unpredict(pixels, extra[:, 1], w, file.height, bits)
        elif kind == 1:
            pixels = _uncross(pixels, extra, w, file.height, bits)
        elif kind == 2:
            pixels[:, 0] += pixels[:, 1]
            pixels[:, 2] += pixels[:, 1]
        else:
            x = np.arange(w)
            each = 8 >> bits
            index = pixels[:, 1].reshape(file.height, -1)[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each).astype(np.uint8) & ((1 << each) - 1)
            known = np.zeros((256, 4), np.uint8)
            known[: len(extra)] = extra
            pixels = known[index.ravel()]
    pixels = pixels.reshape(file.height, file.width, 4)
    if not file.alpha:
        pixels[:, :, 3] = 255
    return pixels


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """(height, width, 4) RGBA bytes of each lossless WebP file."""
    opened = [_open(data, True) for data in files]
    waiting = [f.image for f in opened if not f.image.groups]
    if len(waiting) >= IN_STEP:
        _read_codes(waiting)
    else:
        for image in waiting:
            image.read_codes()
    one = [k for k, f in enumerate(opened) if f.image.which is None]
    pixels = dict(zip(one, _in_step([opened[k].image for k in one]), strict=True)) if one else {}
    return [_undo(f, pixels[k] if k in pixels else f.image.pixels()) for k, f in enumerate(opened)]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) RGBA bytes of a lossless WebP file."""
    return decode_many([data])[0]


def _sums_before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)[:-1]]) if len(x) else np.zeros(0, np.int64)


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """Bits that each row's symbols take at their entropy, and about five more for each symbol that occurs."""
    n = counts.sum(1)
    logs = np.log2(np.maximum(counts, 1))
    return n * np.log2(np.maximum(n, 1)) - np.einsum("ij,ij->i", counts, logs) + 5 * (counts > 0).sum(1)


def _histograms(rows: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(rows * size + values, minlength=n * size).reshape(n, size)


def _depths(row: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Huffman code lengths of symbols given by row and count, for all n rows in step: of a row's leaves and joined nodes, both in order of weight, the two lightest are joined each time."""
    order = np.lexsort((count, row))
    each = np.bincount(row, minlength=n)
    by = np.argsort(-each, kind="stable")  # rows with the most symbols first, so that those still at work are the first
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    each = each[by]
    most = int(each[0]) if n else 0
    first = _sums_before(np.bincount(row, minlength=n))
    place = np.arange(len(row)) - first[row[order]]
    far = np.iinfo(np.int64).max // 4
    wide = most + 2
    leaf, node = np.full(n * wide, far), np.full(n * wide, far)
    leaf[rank[row[order]] * wide + place] = count[order]
    li, ni = np.arange(n) * wide, np.arange(n) * wide
    leaves = np.zeros((n, max(most - 1, 0)), np.int64)  # how many of the two are leaves
    at_work = np.searchsorted(-each, -np.arange(1, most), side="left").tolist()
    for t, k in enumerate(at_work):
        i, j = li[:k], ni[:k]
        a, b, c, d = leaf[i], leaf[i + 1], node[j], node[j + 1]
        both, none = b <= c, d < a
        node[t : k * wide : wide] = np.where(both, a + b, np.where(none, c + d, a + c))
        taken = 1 + both - none
        leaves[:k, t] = taken
        i += taken
        j += 2 - taken
    # leaves and nodes are taken in order
    up = np.zeros((n, 2 * most + 1), np.int64)
    step = np.broadcast_to(np.arange(leaves.shape[1]), leaves.shape)
    joined = step < each[:, None] - 1
    for first_of, times in ((0, leaves[joined]), (most, 2 - leaves[joined])):
        of = np.repeat(np.nonzero(joined)[0], times)
        up[of, first_of + np.arange(len(of)) - _sums_before(np.bincount(of, minlength=n))[of]] = np.repeat(step[joined], times)
    deep = np.zeros((n, most + 1), np.int64)
    every = np.arange(n)
    for t in range(most - 3, -1, -1):
        k = at_work[t + 1]
        deep[:k, t] = deep[every[:k], up[:k, most + t]] + 1
    out = np.empty(len(row), np.int64)
    rr = rank[row[order]]
    out[order] = deep[rr, up[rr, place]] + 1
    return out


def _lengths(tables: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """Code lengths of at most `limit` for each row of tables of counts, all rows in step; 0 for what doesn't occur, 1 for a symbol that is alone."""
    out = [np.zeros(t.shape, np.int64) for t in tables]
    first = np.cumsum([0] + [len(t) for t in tables])
    found = [np.nonzero(t) for t in tables]
    table = np.repeat(np.arange(len(tables)), [len(f[0]) for f in found])
    row = np.concatenate([f[0] + k for f, k in zip(found, first, strict=False)])
    symbol = np.concatenate([f[1] for f in found])
    count = np.concatenate([t[f] for t, f in zip(tables, found, strict=True)])
    while len(row):
        depth = _depths(row, count, int(first[-1]))
        long = np.zeros(first[-1], bool)
        long[row[depth > limit]] = True
        fine = ~long[row]
        for k, own in enumerate(out):
            i = np.flatnonzero(fine & (table == k))
            own[row[i] - first[k], symbol[i]] = depth[i]
        # flatter counts give shorter codes
        table, row, symbol, count = table[~fine], row[~fine], symbol[~fine], (count[~fine] + 3) // 2
    for own, t in zip(out, tables, strict=True):
        alone = np.flatnonzero((t > 0).sum(1) == 1)
        own[alone, t[alone].argmax(1)] = 1
    return out


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes, first bit lowest, and the bits that they take: none where a symbol is alone."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.lexsort((symbol, n, row))
    alone = (lengths > 0).sum(1) == 1
    part = np.where(alone[row], 1 << _TOP, 1 << (_TOP - n))[order]
    code = np.zeros(lengths.shape, np.int64)
    code[row[order], symbol[order]] = _REV[_sums_before(part) & ((1 << _TOP) - 1)]
    return code, np.where(alone[:, None], 0, lengths)


class _Entries:
    """Values and their numbers of bits for rows of a batch, kept in the order in which they were added for each row."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, rows: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        for own, x in ((self.rows, rows), (self.values, values), (self.sizes, sizes)):
            own.append(np.broadcast_to(x, len(rows)).astype(np.int64))

    def write(self, n: int) -> list[tuple[bytes, int]]:
        """The bits of each row, and how many."""
        rows = np.concatenate(self.rows)
        order = np.argsort(rows, kind="stable") if len(self.rows) > 1 else slice(None)
        rows, values, sizes = rows[order], np.concatenate(self.values)[order], np.concatenate(self.sizes)[order]
        total = np.bincount(rows, sizes, minlength=n).astype(np.int64)
        words = total // 64 + 2
        begin = _sums_before(words)
        at = _sums_before(sizes) - _sums_before(total)[rows] + begin[rows] * 64
        word, inside = at >> 6, (at & 63).astype(_U)
        values = values.astype(_U)
        out = np.zeros(int(words.sum()), _U)
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[new]] = np.bitwise_or.reduceat(values << inside, new)
        over = np.flatnonzero((at & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (_U(64) - inside[over])
        raw = out.tobytes()
        return [(raw[8 * b : 8 * (b + w)], int(t)) for b, w, t in zip(begin, words, total, strict=True)]


def _put_codes(to: _Entries, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for each row of counts, by its lengths, and gives the codes and their bits."""
    used = (counts > 0).sum(1)
    # one or two low symbols have a short form; a symbol that is alone and high gets a neighbour
    high = np.flatnonzero((used == 1) & (counts[:, 256:].sum(1) > 0))
    lengths[high, counts[high].argmax(1) - 1] = 1
    used[high] = 2
    simple = (used <= 2) & ((lengths[:, 256:] > 0).sum(1) == 0)
    one, two = np.flatnonzero(simple & (used < 2)), np.flatnonzero(simple & (used == 2))
    s = lengths[one].argmax(1)
    to.add(one, np.where(s > 1, 0b101 | s << 3, 0b001 | s << 3), np.where(s > 1, 11, 4))
    a = lengths[two].argmax(1)
    b = lengths.shape[1] - 1 - lengths[two, ::-1].argmax(1)
    to.add(two, 0b111 | a << 3 | b << 11, 19)
    normal = np.flatnonzero(~simple)
    if len(normal):
        own = lengths[normal]
        size = own.shape[1]
        flat = own.ravel()
        begin = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (np.arange(1, len(flat)) % size == 0)]))
        run, value, row = np.diff(np.concatenate([begin, [len(flat)]])), flat[begin], begin // size
        # runs of zeros: 138 at a time, then what is left by one token or each by itself; other lengths each by itself
        many = np.where(value == 0, run // 138, 0)
        left = np.where(value == 0, run % 138, run)
        rest = np.where((value == 0) & (left > 2), 1, left)
        tokens = np.repeat(np.arange(len(run)), many + rest)
        nth = np.arange(len(tokens)) - np.repeat(_sums_before(many + rest), many + rest)
        whole, short = nth < many[tokens], (value == 0) & (left > 2)
        short = short[tokens] & ~whole
        token = np.where(whole, 18, np.where(short, np.where(left[tokens] > 10, 18, 17), value[tokens]))
        extra = np.where(whole, 127, np.where(short, left[tokens] - np.where(left[tokens] > 10, 11, 3), 0))
        extra_bits = np.where(token == 18, 7, np.where(token == 17, 3, 0))
        of = row[tokens]
        seen = _histograms(of, token, len(normal), 19)
        lone = np.flatnonzero((seen > 0).sum(1) == 1)
        seen[lone, np.where(seen[lone].argmax(1) == 0, 1, 0)] = 1
        small = _lengths([seen], 7)[0]
        code, bits = _codes(small)
        head = np.full(len(normal), 15 << 1, np.int64)
        for k, s in enumerate(_LENGTH_ORDER):
            head |= small[:, s] << (5 + 3 * k)
        to.add(normal, head, 63)
        to.add(normal[of], code[of, token] | extra << bits[of, token], bits[of, token] + extra_bits)
    return _codes(lengths)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number, of lengths and distance codes from 1."""
    v = value - 1
    n = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2, 0)
    low = value <= 4
    return np.where(low, v, 2 * n + 2 + ((v >> n) & 1)), np.where(low, 0, v & ((1 << n) - 1)), np.where(low, 0, n)


def _repeats(pixels: np.ndarray, doc: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of runs of three pixels or more that occurred before in the same image, without overlaps."""
    p = pixels.astype(_U)
    bits = max(21, int(len(p)).bit_length())
    whole = np.flatnonzero(left >= 3)
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3
    key = (p[whole] * _U(0x9E3779B97F4A7C15)) ^ (p[whole + 1] * _U(0xC2B2AE3D27D4EB4F)) ^ (p[whole + 2] * _U(0x165667B19E3779F9)) ^ (doc[whole].astype(_U) * _U(0xD6E8FEB86659FD93))
    key ^= key >> _U(29)
    key *= _U(0xBF58476D1CE4E5B9)
    packed = np.sort(key >> _U(bits) << _U(bits) | whole.astype(_U))
    same = np.flatnonzero(packed[1:] >> _U(bits) == packed[:-1] >> _U(bits))
    mask = _U((1 << bits) - 1)
    a, b = (packed[same] & mask).astype(np.int64), (packed[same + 1] & mask).astype(np.int64)
    true = (doc[a] == doc[b]) & (pixels[a] == pixels[b]) & (pixels[a + 1] == pixels[b + 1]) & (pixels[a + 2] == pixels[b + 2]) & (b - a <= _FARTHEST)
    order = np.argsort(b[true], kind="stable")
    at, far = b[true][order], (b - a)[true][order]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (far[1:] != far[:-1]))
    starts, ends = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 3
    out, now = [], 0
    for s, e, d in zip(starts.tolist(), ends.tolist(), far[np.concatenate([[0], cut + 1])].tolist(), strict=True):
        s = max(s, now)
        while e - s >= 3:
            now = min(e, s + _LONGEST)
            out.append((s, now - s, d))
            s = now
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _code_images(images: list[np.ndarray], widths: list[int], top: bool) -> list[tuple[bytes, int]]:
    """The bits of each entropy-coded image of 0xAARRGGBB pixels, in one code group."""
    n = len(images)
    size = np.array([len(i) for i in images])
    pixels = np.concatenate(images).astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(pixels))
    at, length, far = _repeats(pixels, doc, left)
    covered = np.zeros(len(pixels) + 1, np.int64)
    covered[at] += 1
    np.subtract.at(covered, at + length, 1)
    inside = np.cumsum(covered[:-1]) > 0
    alone = np.flatnonzero(~inside)

    # a cache as large as about a quarter of the pixels, where it pays
    bits = np.clip(np.frexp(size.astype(np.float64))[1] - 3, 1, 10)
    key = (pixels * _CACHE_HASH & 0xFFFFFFFF) >> (32 - bits[doc])
    place = max(21, int(len(pixels)).bit_length())
    packed = np.sort((doc * 2048 + key) << place | np.arange(len(pixels)))
    here, before = packed[1:] & ((1 << place) - 1), packed[:-1] & ((1 << place) - 1)
    hit = np.zeros(len(pixels), bool)
    hit[here] = (packed[1:] >> place == packed[:-1] >> place) & (pixels[here] == pixels[before])
    channel = lambda i, k: (pixels[i] >> k) & 255
    lit, hits = alone[~hit[alone]], alone[hit[alone]]
    without = sum(_bits_of(_histograms(doc[alone], channel(alone, k), n, 256)) for k in (0, 8, 16))
    green = np.concatenate([channel(lit, 8), 280 + key[hits]])
    owner = np.concatenate([doc[lit], doc[hits]])
    cached = _bits_of(_histograms(owner, green, n, 280 + 1024)) + sum(_bits_of(_histograms(doc[lit], channel(lit, k), n, 256)) for k in (0, 16))
    bits = np.where(cached < without, bits, 0)

    hit &= bits[doc] > 0
    start = np.zeros(len(pixels), bool)
    start[at] = True
    tokens = np.flatnonzero(~inside | start)
    of = doc[tokens]
    copied, known = start[tokens], hit[tokens] & ~start[tokens]
    literal = ~copied & ~known
    # a near distance has the first code that names it
    codes = np.zeros(len(at), np.int64)
    for w in set(widths):
        table = np.arange(8 * w + 16) + 120
        for k in range(120, 0, -1):
            table[_distance(k, w)] = k
        own = np.array(widths)[doc[at]] == w
        codes[own] = np.where(far[own] < len(table), table[np.minimum(far[own], len(table) - 1)], far[own] + 120)
    ls, le, ln = _prefix(length)
    ds, de, dn = _prefix(codes)
    symbol = np.where(known, 280 + key[tokens], channel(tokens, 8))
    symbol[copied] = 256 + ls
    values = [symbol, channel(tokens, 16), channel(tokens, 0), channel(tokens, 24)]
    to = _Entries()
    every = np.arange(n)
    to.add(every, np.where(bits > 0, 1 | bits << 1, 0), np.where(bits > 0, 5, 1))
    if top:
        to.add(every, np.zeros(n), np.ones(n))
    counts = [_histograms(of, values[0], n, 280 + (1 << int(bits.max()) if bits.any() else 0)), *(_histograms(of[literal], v[literal], n, 256) for v in values[1:]), _histograms(doc[at], ds, n, 256)]
    # alphabets end with the image's own cache
    books = []
    lengths = _lengths(counts, _TOP)
    for k, count in enumerate(counts):
        if k == 0:
            code, used = np.zeros(count.shape, np.int64), np.zeros(count.shape, np.int64)
            for b in np.unique(bits):
                own = np.flatnonzero(bits == b)
                part = _Entries()
                wide = 280 + (1 << int(b) if b else 0)
                code[own, :wide], used[own, :wide] = _put_codes(part, count[own, :wide], lengths[0][own, :wide])
                for r, v, m in zip(part.rows, part.values, part.sizes, strict=True):
                    to.add(own[r], v, m)
        else:
            code, used = _put_codes(to, count[:, : _SIZES[k]], lengths[k][:, : _SIZES[k]])
        books.append((code, used))
    value, number = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for k, (code, used) in enumerate(books[:4]):
        if not used.any():  # symbols that are alone take no bits
            continue
        both = (code << 4 | used).ravel()[of * code.shape[1] + values[k]]
        if k:
            both *= literal
        value |= both >> 4 << number
        number += both & 15
    c = np.flatnonzero(copied)
    value[c] |= le << number[c]
    number[c] += ln
    more, m = books[4][0][doc[at], ds], books[4][1][doc[at], ds]
    value[c] |= (more | de << m) << number[c]
    number[c] += m + dn
    to.add(of, value, number)
    return to.write(n)


class _Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _argb(rgb: np.ndarray) -> np.ndarray:
    x = rgb.astype(np.uint32)
    return x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2] | np.uint32(0xFF000000)


def encode_many(pictures: list[np.ndarray]) -> list[bytes]:
    """A lossless WebP file of each (height, width, 3) bytes."""
    n = len(pictures)
    if not n:
        return []
    shape = [x.shape[:2] for x in pictures]
    size = np.array([h * w for h, w in shape])
    first = _sums_before(size)
    doc = np.repeat(np.arange(n), size)
    rgb = np.concatenate([x.reshape(-1, 3) for x in pictures])
    place = np.arange(len(rgb)) - first[doc]
    width = np.array([w for _, w in shape])
    left = np.concatenate([np.zeros((1, 3), np.uint8), rgb[:-1]])
    left[first] = 0
    above = rgb[np.maximum(np.arange(len(rgb)) - width[doc], 0)]
    top_row, first_column = place < width[doc], place % width[doc] == 0
    green = rgb.copy()
    green[:, 0] -= rgb[:, 1]
    green[:, 2] -= rgb[:, 1]
    # as the format has it, the first row is told from the left and the first column from above
    kinds = [rgb, green, rgb - np.where((first_column & ~top_row)[:, None], above, left), rgb - np.where(top_row[:, None], left, above)]
    cost = [sum(_bits_of(_histograms(doc, x[:, k].astype(np.int64), n, 256)) for k in range(3)) + (0, 3, 50, 50)[j] for j, x in enumerate(kinds)]
    packed = np.sort(doc << 24 | _argb(rgb).astype(np.int64) & 0xFFFFFF)
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    colours = np.bincount((packed[new] >> 24), minlength=n)
    few = np.flatnonzero(colours <= 256)
    at = np.flatnonzero(new)
    each = np.diff(np.concatenate([at, [len(packed)]]))
    of = packed[at] >> 24
    entropy = size * np.log2(size) - np.bincount(of, each * np.log2(each), minlength=n)
    paletted = np.full(n, np.inf)
    paletted[few] = entropy[few] + 22 * colours[few] + 40
    choice = np.argmin(np.stack([*cost, paletted]), 0)

    final, main_width = rgb.copy(), [w for _, w in shape]
    for j in (1, 2, 3):
        own = choice[doc] == j
        final[own] = kinds[j][own]
    argb = _argb(final)
    # the first pixel's alpha is told from opaque black, all others' from opaque ones
    argb[(choice[doc] == 2) | (choice[doc] == 3)] &= 0xFFFFFF
    images = [argb[f : f + s] for f, s in zip(first, size, strict=True)]
    palettes: dict[int, np.ndarray] = {}
    for k in np.flatnonzero(choice == 4).tolist():
        h, w = shape[k]
        found, index = np.unique(images[k], return_inverse=True)
        fold = 3 if len(found) <= 2 else 2 if len(found) <= 4 else 1 if len(found) <= 16 else 0
        narrow, per = -(-w >> fold), 8 >> fold
        wide = np.zeros((h, narrow << fold), np.uint32)
        wide[:, :w] = index.reshape(h, w)
        folded = (wide.reshape(h, narrow, 1 << fold) << (np.arange(1 << fold, dtype=np.uint32) * np.uint32(per))).sum(2, dtype=np.uint32)
        images[k], main_width[k] = folded.ravel() << np.uint32(8) | np.uint32(0xFF000000), narrow
        steps_ = np.diff(_bytes(found).astype(np.int64), axis=0, prepend=0) & 255
        palettes[k] = (steps_[:, 3] << 24 | steps_[:, 0] << 16 | steps_[:, 1] << 8 | steps_[:, 2]).astype(np.uint32)
    mains = _code_images(images, main_width, True)
    coded = dict(zip(palettes, _code_images(list(palettes.values()), [len(x) for x in palettes.values()], False), strict=True)) if palettes else {}
    out = []
    for k, (h, w) in enumerate(shape):
        put = _Writer()
        put.bits(0x2F | w - 1 << 8 | h - 1 << 22, 40)
        if choice[k] == 1:
            put.bits(0b101, 3)
        elif choice[k] in (2, 3):
            put.bits(0b001 | 7 << 3, 6)
            # one mode for all tiles: each channel's code has one symbol
            put.bits(0, 1)
            put.bits(0b101 | (int(choice[k]) - 1) << 3 if choice[k] == 3 else 0b001 | 1 << 3, 11 if choice[k] == 3 else 4)
            for _ in range(4):
                put.bits(0b001, 4)
        elif choice[k] == 4:
            put.bits(0b111 | len(palettes[k]) - 1 << 3, 11)
            put.bits(int.from_bytes(coded[k][0], "little"), coded[k][1])
        put.bits(0, 1)
        put.bits(int.from_bytes(mains[k][0], "little"), mains[k][1])
        body = put.value.to_bytes((put.n + 7) // 8, "little")
        padded = body + b"\0" * (len(body) % 2)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded)
    return out


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of (height, width, 3) bytes."""
    return encode_many([rgb])[0]


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of BLOCK."""
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def picture(data: bytes) -> np.ndarray:
    """A payload as an image, SIDE pixels wide or as many times that as its height limit asks for; the last row is filled with spaces."""
    rows = len(data) // (3 * SIDE)
    wide = -(-rows // _MOST)
    high = -(-rows // wide)
    if wide * SIDE > _MOST:
        raise ValueError("the payload is too large for one image")
    data += b" " * (3 * SIDE * wide * high - len(data))
    return np.frombuffer(data, np.uint8).reshape(high, SIDE * wide, 3)


def store_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads as lossless WebP files; equal ones are coded once."""
    known = dict.fromkeys(payloads)
    files = dict(zip(known, encode_many([picture(x) for x in known]), strict=True))
    return [files[x] for x in payloads]


def store(data: bytes) -> bytes:
    return store_many([data])[0]


def features(pixels: np.ndarray) -> str:
    """Size, channel means in 1/256, spread in 1/256 and a 64-bit pattern of neighbouring row means."""
    rgb = pixels[:, :, :3]
    n = rgb.shape[0] * rgb.shape[1]
    exact = rgb.astype(np.float64)  # sums are below 2 ** 53
    down = exact.sum(0)
    total = down.sum(0).astype(np.int64).tolist()
    squares = np.einsum("ijk,ijk->k", exact, exact).astype(np.int64).tolist()
    columns = down[:SIDE].sum(1)
    pattern = np.packbits(columns > columns[_LEFT]).tobytes().hex()
    means = [t * 256 // n for t in total]
    spread = [(q * n - t**2) // (n * n) for q, t in zip(squares, total, strict=True)]
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean={means};var={spread};cols={pattern}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = texts_of(batch.column("text")).cast(pa.large_binary())
        for a, b in steps(text, CODED):
            raw = text[a:b].to_pylist()
            padded = [payload(x) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x) for x in padded], pa.int64()), pa.array(store_many(padded), pa.binary())],
                ["doc_id", "n_bytes", "payload_bytes", "media"],
            )


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about READ bytes of payload."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        wide = batch.column("payload_bytes")
        for a, b in steps(batch.column("media"), READ):
            held.append(batch.slice(a, b - a))
            size += pa.compute.sum(wide[a:b]).as_py() or 0
            if size >= READ:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    for batch in _together(batches):
        rows = []
        stored = batch.column("media").to_pylist()
        for size, media, pixels in zip(batch.column("payload_bytes").to_pylist(), stored, decode_many(stored), strict=True):
            back = np.ascontiguousarray(pixels[:, :, :3]).tobytes()[:size]
            rows.append((hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pixels)))
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in ("doc_id", "n_bytes", "payload_bytes")), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", *kinds],
        )


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, payload_bytes, media): a column of lossless WebP files."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_stored, "doc_id long, n_bytes long, payload_bytes long, media binary")


def examine(media: DataFrame) -> DataFrame:
    """Reads the media column back: digests of what it holds, and features of the pixels."""
    return media.mapInArrow(_examined, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
