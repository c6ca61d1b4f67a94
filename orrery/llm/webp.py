"""Lossless WebP images: a decoder of the whole VP8L format and an encoder for samples.

The decoder reads prefix codes, back-references, the colour cache and groups of
codes, and inverts the predictor, cross-colour, subtract-green and palette
transforms. An image of one group of codes without a colour cache is decoded in
numpy: what a code word that began at any bit would say and where the next one
would begin are looked up for all bits at once, and only the chain of beginnings
is followed one by one.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of the format: the order of code-length codes, the cache's hash factor, and the (dx, dy) of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def peek(self) -> int:
        """The next 32 bits or more."""
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data) - 64:
            raise ValueError("the image is cut short")
        return out


REVERSED = np.zeros(1 << 15, np.int64)  # 15 bits, back to front
for _k in range(15):
    REVERSED |= ((np.arange(1 << 15) >> _k) & 1) << (14 - _k)


def canonical(lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols in the order of their codes, their lengths, their codes in the high bits of 15)."""
    size = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(size)
    used = used[np.argsort(size[used], kind="stable")]
    n = size[used].astype(np.int64)
    share = 1 << (15 - n)
    return used, n, np.cumsum(share) - share


@lru_cache(1 << 12)
def reverse_codes(lengths: bytes) -> np.ndarray:
    """The canonical prefix code of each symbol, first bit lowest."""
    used, _, start = canonical(lengths)
    out = np.zeros(len(lengths), np.int64)
    out[used] = REVERSED[start & 0x7FFF]
    return out


class Code:
    """A prefix code: a table from the next `bits` bits to symbol << 4 | length."""

    def __init__(self, lengths: bytes):
        used, size, start = canonical(lengths)
        self.only = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        if self.only is not None:
            self.bits, self.table, self.last = 0, np.array([self.only << 4], np.int32), self.only
            return
        if start[-1] + (1 << (15 - size[-1])) != 1 << 15:
            raise ValueError("a prefix code isn't complete")
        self.bits, self.last = int(size[-1]), int(used.max())
        self.table = np.repeat((used << 4 | size).astype(np.int32), 1 << (self.bits - size))[REVERSED[: 1 << self.bits] >> (15 - self.bits)]

    def read(self, r: Reader) -> int:
        found = int(self.table[r.peek() & ((1 << self.bits) - 1)])
        r.at += found & 15
        return found >> 4


code_of = lru_cache(1 << 10)(Code)


def read_code(r: Reader, alphabet: int) -> Code:
    lengths = bytearray(alphabet)
    if r.take(1):
        two, wide = r.take(1), r.take(1)
        lengths[r.take(8 if wide else 1)] = 1
        if two:
            lengths[r.take(8)] = 1
        return code_of(bytes(lengths))
    first = bytearray(19)
    for k in range(4 + r.take(4)):
        first[LENGTH_ORDER[k]] = r.take(3)
    code = code_of(bytes(first))
    left = 2 + r.take(2 + 2 * r.take(3)) if r.take(1) else alphabet
    k, last = 0, 8
    while k < alphabet and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
            continue
        n = 3 + r.take(2) if s == 16 else 3 + r.take(3) if s == 17 else 11 + r.take(7)
        if k + n > alphabet:
            raise ValueError("too many code lengths")
        if s == 16:
            lengths[k : k + n] = bytes([last]) * n
        k += n
    return code_of(bytes(lengths))


def prefix_value(symbol: int, r: Reader) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.take(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (height, width) of an entropy-coded image, before transforms are inverted."""
    cache_bits = r.take(4) if r.take(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    bits, group = 0, None
    if main and r.take(1):
        bits = 2 + r.take(3)
        group = (read_image(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False) >> 8) & 0xFFFF
    green = 280 + (1 << cache_bits if cache_bits else 0)
    groups = [[read_code(r, n) for n in (green, 256, 256, 256, 40)] for _ in range(int(group.max()) + 1 if group is not None else 1)]
    if group is None and not cache_bits:
        return _read_all(r, width, height, groups[0])
    return _read_each(r, width, height, groups, group, bits, cache_bits)


def _read_each(r: Reader, width: int, height: int, groups: list, group: np.ndarray | None, bits: int, cache_bits: int) -> np.ndarray:
    total, out, cache, told = width * height, [], [0] * (1 << cache_bits), 0
    own = groups[0]
    while len(out) < total:
        if group is not None:
            own = groups[int(group[(len(out) // width) >> bits, (len(out) % width) >> bits])]
        g = own[0].read(r)
        if g < 256:
            red, blue, alpha = own[1].read(r), own[2].read(r), own[3].read(r)
            out.append(alpha << 24 | red << 16 | g << 8 | blue)
        elif g < 280:
            n = prefix_value(g - 256, r)
            d = distance(prefix_value(own[4].read(r), r), width)
            if d > len(out):
                raise ValueError("a reference to before the image")
            for _ in range(min(n, total - len(out))):
                out.append(out[-d])
        else:
            for p in out[told:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            told = len(out)
            out.append(cache[g - 280])
    if r.at > 8 * len(r.data) - 64:
        raise ValueError("the image is cut short")
    return np.array(out, np.uint32).reshape(height, width)


def _one_code(r: Reader, b: np.ndarray, base: int, total: int, code: Code) -> np.ndarray:
    """The symbols of total code words of one code in a row, from the bytes b that start at base."""
    words = b[:-2] | b[1:-1] << np.uint32(8) | (np.append(b[2:-1], np.uint32(0)) << np.uint32(16))
    window = np.empty((len(words), 8), np.uint16)
    for k in range(8):
        window[:, k] = (words >> np.uint32(k)) & np.uint32((1 << code.bits) - 1)
    window = window.ravel()
    n = len(window)
    one = np.arange(n, dtype=np.int32)
    one += (code.table & 15).astype(np.int8)[window]
    np.minimum(one, n - 1, out=one)
    two = one[one]
    four = memoryview(two[two])  # the chain is followed in steps of four words
    p, quarter = r.at - 8 * base, []
    add = quarter.append
    for _ in range((total + 3) // 4):
        add(p)
        p = four[p]
    at = np.empty((len(quarter), 4), np.int32)
    at[:, 0] = quarter
    at[:, 1] = one[at[:, 0]]
    at[:, 2] = two[at[:, 0]]
    at[:, 3] = one[at[:, 2]]
    at = at.ravel()[:total]
    r.at = 8 * base + int(one[at[-1]])
    if r.at > 8 * len(r.data) - 64:
        raise ValueError("the image is cut short")
    return (code.table >> 4).astype(np.uint16)[window[at]]


def _read_all(r: Reader, width: int, height: int, codes: list[Code]) -> np.ndarray:
    total = width * height
    if all(c.only is not None for c in codes[:4]) and codes[0].only < 256:
        g, red, blue, alpha = (c.only for c in codes[:4])
        return np.full((height, width), alpha << 24 | red << 16 | g << 8 | blue, np.uint32)
    base = r.at >> 3
    most = min(len(r.data) - 8, base + 64 + total * sum(c.bits for c in codes[:4]) // 8 + 64)
    b = np.frombuffer(r.data, np.uint8, most - base + 8, base).astype(np.uint32)
    if codes[0].last < 256 and codes[0].only is None and all(c.only is not None for c in codes[1:4]):
        red, blue, alpha = (c.only for c in codes[1:4])
        return (_one_code(r, b, base, total, codes[0]).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)).reshape(height, width)
    words = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16)
    window = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    n = len(window)
    found = [c.table[window & np.uint32((1 << c.bits) - 1)] if c.only is None else None for c in codes[:4]]
    place = np.arange(n, dtype=np.int32)

    def after(at: np.ndarray, k: int) -> np.ndarray:
        return at if found[k] is None else at + (found[k][np.minimum(at, n - 1)] & 15)

    following = after(place, 0)
    for k in (1, 2, 3):
        following = after(following, k)
    green = found[0] >> 4 if found[0] is not None else np.full(n, codes[0].only, np.int32)
    copies: dict[int, tuple[int, int]] = {}
    far = green >= 256
    nxt = memoryview(np.where(far, -1, following) if far.any() else following)
    p, limit, chain, out_at, out = r.at - 8 * base, n, [], [], 0
    add = chain.append
    while out < total:
        if p >= limit:
            raise ValueError("the image is cut short")
        q = nxt[p]
        add(p)
        if q < 0:
            r.at = 8 * base + p + (int(found[0][p]) & 15 if found[0] is not None else 0)
            length = prefix_value(int(green[p]) - 256, r)
            d = distance(prefix_value(codes[4].read(r), r), width)
            length = min(length, total - out)
            if d > out:
                raise ValueError("a reference to before the image")
            copies[len(chain) - 1] = (length, d)
            q = r.at - 8 * base
            out += length
        else:
            out += 1
        p = q
    r.at = 8 * base + p
    if r.at > 8 * len(r.data) - 64:
        raise ValueError("the image is cut short")
    at = np.array(chain, np.int64)
    values = [np.take(green, at)]
    where = at if found[0] is None else at + (found[0][at] & 15)
    for k in (1, 2, 3):
        where = np.minimum(where, n - 1)
        values.append(np.full(len(at), codes[k].only, np.int64) if found[k] is None else found[k][where] >> 4)
        where = where if found[k] is None else where + (found[k][where] & 15)
    g, red, blue, alpha = (v.astype(np.uint32) for v in values)
    pixel = alpha << np.uint32(24) | red << np.uint32(16) | g << np.uint32(8) | blue
    if copies:
        last, done, pixels = 0, 0, np.zeros(total, np.uint32)
        for k, (length, d) in copies.items():
            pixels[done : done + k - last] = pixel[last:k]
            done += k - last
            last = k + 1
            if d >= length:
                pixels[done : done + length] = pixels[done - d : done - d + length]
            else:
                pixels[done : done + length] = np.resize(pixels[done - d : done], length)
            done += length
        pixels[done:] = pixel[last:]
        pixel = pixels
    return pixel.reshape(height, width)


def channels(argb: np.ndarray) -> np.ndarray:
    """(height, width, 4): blue, green, red, alpha."""
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def whole(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c).view("<u4")[..., 0].astype(np.uint32)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _select(left, top, corner):
    to_left = sum(abs(t - c) for t, c in zip(top, corner))
    to_top = sum(abs(x - c) for x, c in zip(left, corner))
    return left if to_left < to_top else top


def _clip(x):
    return 0 if x < 0 else 255 if x > 255 else x


def _half(a, b):
    """(a - b) / 2, towards zero."""
    d = a - b
    return d // 2 if d >= 0 else -(-d // 2)


def predicted(mode: int, left, top, corner, right):
    """The prediction of a pixel from its neighbours, each four channels. right: above and to the right."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return [_clip(a + b - c) for a, b, c in zip(left, top, corner)]
        case 13:
            return [_clip(m + _half(m, c)) for m, c in zip(_average(left, top), corner)]
    return [0, 0, 0, 255]


def predict(c: np.ndarray, modes: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """c with each pixel's prediction added (sign 1: c has residuals) or taken off (-1: c has pixels)."""
    h, w, _ = c.shape
    out, top = np.empty_like(c), []
    for y in range(h):
        row, done = c[y].tolist(), []
        seen, own = row if sign < 0 else done, modes[y >> bits].tolist()
        for x in range(w):
            if y == 0:
                p = seen[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                p = top[0]
            else:
                p = predicted(own[x >> bits], seen[x - 1], top[x], top[x - 1], top[x + 1] if x + 1 < w else seen[0])
            done.append([(v + sign * q) & 255 for v, q in zip(row[x], p)])
        out[y], top = done, seen
    return out


def cross(c: np.ndarray, table: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """c with what green tells of red and blue, and red of blue, added (sign 1) or taken off (-1). table: channels of the transform's image."""
    h, w, _ = c.shape
    t = np.repeat(np.repeat(table, 1 << bits, 0), 1 << bits, 1)[:h, :w].view(np.int8).astype(np.int64)
    s = c.view(np.int8).astype(np.int64)
    red = s[..., 2] + sign * (t[..., 0] * s[..., 1] >> 5)
    known = (red if sign > 0 else s[..., 2]).astype(np.uint8).view(np.int8).astype(np.int64)
    blue = s[..., 0] + sign * ((t[..., 1] * s[..., 1] >> 5) + (t[..., 2] * known >> 5))
    out = c.copy()
    out[..., 2], out[..., 0] = red.astype(np.uint8), blue.astype(np.uint8)
    return out


def bundle(size: int) -> int:
    """log2 of the palette indices that share a pixel."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a lossless WebP file, alpha in the highest byte, then red, green, blue. ValueError if it isn't a whole one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= min(end, len(data)):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            if at + 8 + size > len(data):
                raise ValueError("the image is cut short")
            return _decode(Reader(data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    raise ValueError("no lossless image")


def _decode(r: Reader) -> np.ndarray:
    if r.take(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height, _, version = r.take(14) + 1, r.take(14) + 1, r.take(1), r.take(3)
    if version:
        raise ValueError("an unknown version")
    transforms, full = [], width
    while r.take(1):
        kind = r.take(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = 2 + r.take(3)
            transforms.append((kind, bits, read_image(r, (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False), width))
        elif kind == PALETTE:
            size = r.take(8) + 1
            colours = whole(np.cumsum(channels(read_image(r, size, 1, False)), axis=1, dtype=np.uint8))[0]
            transforms.append((kind, bundle(size), colours, width))
            width = (width + (1 << bundle(size)) - 1) >> bundle(size)
        else:
            transforms.append((kind, 0, None, width))
    pixels = read_image(r, width, height, True)
    for kind, bits, table, own in reversed(transforms):
        if kind == PREDICTOR:
            pixels = whole(predict(channels(pixels), (table >> 8) & 15, bits, 1))
        elif kind == CROSS_COLOUR:
            pixels = whole(cross(channels(pixels), channels(table), bits, 1))
        elif kind == SUBTRACT_GREEN:
            green = (pixels >> np.uint32(8)) & np.uint32(0xFF)
            pixels = (pixels & np.uint32(0xFF00FF00)) | ((pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green) & np.uint32(0x00FF00FF))
        else:
            index = (pixels >> np.uint32(8)) & np.uint32(0xFF)
            if bits:
                each = 8 >> bits
                index = ((index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :own]
            pixels = np.append(table, np.zeros(256, np.uint32))[index]
    assert pixels.shape == (height, full)
    return pixels


class Writer:
    """Bits, lowest first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def packed(self, values: np.ndarray, sizes: np.ndarray) -> bytes:
        """All bits so far, then the values of these sizes (32 at most)."""
        head = self.n & 63
        start = np.cumsum(sizes, dtype=np.int64)
        total = head + int(start[-1])
        start += head
        start -= sizes
        values = values.astype(np.uint64)
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        out = np.zeros((total >> 6) + 2, np.uint64)
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[at]] = np.bitwise_or.reduceat(values << shift, at)
        out[0] |= np.uint64(self.value >> (self.n - head))
        over = at[1:] - 1 if len(at) > 1 else at[:0]  # the last value of each word
        over = np.append(over, len(values) - 1)
        over = over[shift[over].astype(np.int64) + sizes[over] > 64]
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        head = (self.value & ((1 << (self.n - (self.n & 63))) - 1)).to_bytes((self.n - (self.n & 63)) // 8, "little")
        return head + out.tobytes()[: (total + 7) // 8]


def code_lengths(counts: np.ndarray, most: int) -> bytes:
    """Length of each symbol in an optimal prefix code, none above `most`."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out.tobytes()
    weight = counts[used].astype(np.int64)
    while True:
        heap = sorted((int(w), k) for k, w in enumerate(weight))
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heap[0]
            parent[i] = parent[j] = n
            heapq.heapreplace(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= most:
            out[used] = depth[: len(used)]
            return out.tobytes()
        weight = (weight + 1) // 2 + weight.max() // 4096


def write_code(w: Writer, lengths: bytes) -> bytes:
    """Write a code; the lengths that data is to be written with (none for a single symbol)."""
    few = len(lengths) - lengths.count(0)
    used = [256] if few > 2 else [len(lengths) - len(lengths.lstrip(b"\0")), len(lengths.rstrip(b"\0")) - 1][:few]
    if len(used) <= 2 and max(used, default=0) < 256:
        a, b = used[0] if used else 0, used[1] if len(used) > 1 else None
        wide = int(a > 1)
        w.put(1 | int(b is not None) << 1 | wide << 2 | a << 3, 11 if wide else 4)
        if b is not None:
            w.put(b, 8)
        return lengths if b is not None else bytes(len(lengths))
    w.put(0, 1)
    tokens: list[tuple[int, int, int]] = []
    for size, own in groupby(lengths):
        left = len(list(own))
        if size == 0:
            while left >= 3:
                run = min(left, 138)
                tokens.append((18, run - 11, 7) if run > 10 else (17, run - 3, 3))
                left -= run
        else:
            tokens.append((size, 0, 0))
            left -= 1
            while left >= 3:
                run = min(left, 6)
                tokens.append((16, run - 3, 2))
                left -= run
        tokens += [(size, 0, 0)] * left
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    told = max(4, 1 + max(LENGTH_ORDER.index(s) for s, n in enumerate(first) if n))
    w.put(told - 4, 4)
    for s in LENGTH_ORDER[:told]:
        w.put(first[s], 3)
    w.put(0, 1)
    codes, silent = reverse_codes(first).tolist(), len(first) - first.count(0) == 1
    value = n = 0
    for s, extra, m in tokens:
        size = 0 if silent else first[s]
        value |= (codes[s] | extra << size if size else extra) << n
        n += size + m
    w.put(value, n)
    return bytes(len(lengths)) if len(lengths) - lengths.count(0) == 1 else lengths


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def runs(pixels: np.ndarray, width: int, least: int = 128) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that repeat the pixel before or the row above, apart from each other."""
    found: list[tuple[int, int, int]] = []
    for d in dict.fromkeys((1, width)):
        if len(pixels) > d:
            edge = np.diff(np.concatenate([[False], pixels[d:] == pixels[:-d], [False]]).astype(np.int8))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = b - a >= least
            found += [(int(x) + d, int(y - x), d) for x, y in zip(a[long], b[long])]
    out, end = [], 0
    for start, n, d in sorted(found):
        skip = max(0, end - start)
        while n - skip >= least:
            take = min(n - skip, 4096)
            out.append((start + skip, take, d))
            end = start + skip + take
            skip += take
    return out


def reference_bits(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """About what references of these lengths and distances take: two symbols and their extra bits."""
    return 10 + np.maximum(np.frexp(n - 0.5)[1] - 2, 0) + np.frexp(d + 119.5)[1] - 2


def matches(pixels: np.ndarray, bits: float, least: int = 6, worth: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of stretches that came before, apart from each other, each shorter by `worth` bits as a reference than pixel by pixel.

    bits: what a pixel takes. The latest place with the same `least` pixels counts;
    places in a row with one distance are one stretch. pixels are below 256.
    """
    n = max(len(pixels) - least + 1, 0)
    wide = pixels.astype(np.uint64)
    two = wide[:-1] | wide[1:] << np.uint64(8)
    key = two[:n] | two[2 : n + 2] << np.uint64(16) | two[4 : n + 4] << np.uint64(32)
    low = n.bit_length()
    sort = np.sort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(low) << np.uint64(low)) | np.arange(n, dtype=np.uint64))
    place = (sort & np.uint64((1 << low) - 1)).astype(np.int64)
    near = np.flatnonzero(sort[1:] ^ sort[:-1] < np.uint64(1 << low))
    at, before = place[1:][near], place[:-1][near]
    same = (key[at] == key[before]) & (at - before <= (1 << 20) - 120)
    past = np.zeros(n, np.int64)
    past[at[same]] = at[same] - before[same]
    edge = np.flatnonzero(np.diff(past, prepend=0, append=0))
    start, end = edge[:-1], edge[1:]
    found = past[start] > 0
    start, end = start[found], end[found] + least - 1
    past = past[start]
    start = np.maximum(start, np.concatenate([[0], end[:-1]])[: len(start)])
    again = np.maximum(-(-(end - start) // 4096), 0)  # a reference has that length at most
    k = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
    start, end, past = np.repeat(start, again) + 4096 * k, np.repeat(end, again), np.repeat(past, again)
    size = np.minimum(end - start, 4096)
    own = size * bits - reference_bits(size, past) >= worth
    return start[own], size[own], past[own]


def entropy(counts: np.ndarray) -> float:
    """Bits that all symbols of these counts take together."""
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def neighbours(samples: np.ndarray) -> list[np.ndarray]:
    """The 14 predictions of grey samples (height, width), those of the first row and column aside."""
    s = samples.astype(np.int16)
    left, top, corner = s[1:, :-1], s[:-1, 1:], s[:-1, :-1]
    right = np.concatenate([s[:-1, 2:], s[1:, :1]], 1)
    half = top - corner  # red, green and blue are alike, so that the sums over channels compare as these do
    mean = (left + top) >> 1
    d = mean - corner
    return [np.zeros_like(left), left, top, right, corner, (((left + right) >> 1) + top) >> 1, (left + corner) >> 1, mean, (corner + top) >> 1, (top + right) >> 1, (((left + corner) >> 1) + ((top + right) >> 1)) >> 1, np.where(np.abs(half) < np.abs(left - corner), left, top), np.clip(left + half, 0, 255), np.clip(mean + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)]


def best_modes(samples: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(mode of the least residuals of each block, residuals) of grey samples, with two rows and columns or more."""
    h, w = samples.shape
    rest = np.stack([(samples[1:, 1:] - p).astype(np.uint8) for p in neighbours(samples)])
    size = np.minimum(rest, -rest).astype(np.int64)
    rows, columns = (np.maximum(np.arange(0, n, 1 << bits) - 1, 0) for n in (h, w))
    rows, columns = rows[rows < h - 1], columns[columns < w - 1]
    modes = np.zeros(((h + (1 << bits) - 1) >> bits, (w + (1 << bits) - 1) >> bits), np.int64)
    modes[: len(rows), : len(columns)] = np.add.reduceat(np.add.reduceat(size, rows, 1), columns, 2).argmin(0)
    own = np.repeat(np.repeat(modes, 1 << bits, 0), 1 << bits, 1)[1:h, 1:w]
    return modes, np.take_along_axis(rest, own[None], 0)[0]


def cached(samples: np.ndarray, bits: int) -> np.ndarray:
    """Which samples a colour cache of that size holds when they come, and the places that all have in it."""
    place = ((np.arange(256, dtype=np.uint32) * np.uint32(0x000100) | np.uint32(0xFF000000)) * np.uint32(CACHE_FACTOR) >> np.uint32(32 - bits))[samples].astype(np.int64)
    sort = np.sort(place << 32 | np.arange(len(samples)))
    at = sort & 0xFFFFFFFF
    hit = np.zeros(len(samples), bool)
    hit[at[1:]] = (sort[1:] >> 32 == sort[:-1] >> 32) & (samples[at[1:]] == samples[at[:-1]])
    return np.where(hit, 280 + place, samples)


def chosen(samples: np.ndarray, gain: float = 0.1) -> dict:
    """How encode() should write grey samples (height, width): by the entropy of what each way leaves.

    Subtract-green is the rule, as it leaves nothing of red and blue, and so
    nothing that the cross-colour transform could take off. A palette is taken
    where up to 16 samples share pixels; with more colours it would only rename
    them. The predictor is tried where differences to the left or above have a
    lower entropy, then with the best of its 14 modes for each block; the colour
    cache where a sixth of the samples equal one of the two before. These ways and
    references take effort to read, so they have to save the share `gain` of the size.
    """
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    if np.count_nonzero(counts) <= 16:
        return {"transforms": (PALETTE,)}
    size = plain = entropy(counts)
    out: dict = {"transforms": (SUBTRACT_GREEN,), "copies": []}
    h, w = samples.shape
    if h > 1 and min(entropy(np.bincount(flat[d:] - flat[:-d], minlength=256)) for d in (1, w)) < plain * (1 - gain):
        modes, rest = best_modes(samples, 3)
        guess = entropy(np.bincount(rest.ravel(), minlength=256)) + 8 * (h + w) + entropy(np.bincount(modes.ravel()))
        if guess < plain * (1 - gain):
            size, out = guess, {"transforms": (SUBTRACT_GREEN, PREDICTOR), "modes": modes}
    start, n, d = matches(flat, plain / len(flat))
    cover = np.zeros(len(flat) + 1, np.int8)
    cover[start] += 1
    cover[start + n] -= 1
    guess = float(reference_bits(n, d).sum()) + 150 + entropy(np.bincount(flat[np.cumsum(cover, dtype=np.int8)[:-1] == 0], minlength=256)) if len(start) else plain
    if guess < min(size, plain * (1 - gain)):
        size, out = guess, {"transforms": (SUBTRACT_GREEN,), "copies": list(zip(start.tolist(), n.tolist(), d.tolist()))}
    for bits in (1, 5) if 6 * ((flat[2:] == flat[1:-1]) | (flat[2:] == flat[:-2])).sum() > len(flat) else ():
        guess = entropy(np.bincount(cached(flat, bits)))
        if guess < min(size, plain * (1 - gain)):
            size, out = guess, {"transforms": (SUBTRACT_GREEN,), "cache_bits": bits}
    return out


def write_image(w: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, group_bits: int = 0, copies: list[tuple[int, int, int]] | None = None) -> bytes | None:
    """Write the pixels (height, width), with these stretches as references (none given: long runs). The main image comes last, so its bytes are returned, with all before them."""
    height, width = argb.shape
    px = argb.ravel()
    px = px if px.dtype == np.uint32 else px.astype(np.uint32)
    w.put(int(cache_bits > 0), 1)
    copies = runs(px, width) if copies is None else copies
    rest = int(px[0]) & 0xFFFF00FF
    if main and not cache_bits and not group_bits and not copies and not ((px ^ np.uint32(rest)) & np.uint32(0xFFFF00FF)).any():
        w.put(0, 1)  # one group, and green alone tells the pixels apart
        kind = (px >> np.uint32(8)).astype(np.uint8)
        told = write_code(w, code_lengths(np.bincount(kind, minlength=280), 12))
        for value in (rest >> 16 & 255, rest & 255, rest >> 24):
            write_code(w, bytes(value) + b"\x01" + bytes(255 - value))
        write_code(w, bytes(40))
        return w.packed(reverse_codes(told)[kind], np.frombuffer(told, np.uint8)[kind])
    if cache_bits:
        w.put(cache_bits, 4)
    group = np.zeros(len(px), np.int64)
    if main:
        w.put(int(group_bits > 0), 1)
        if group_bits:  # rows of blocks take turns at two groups of codes
            w.put(group_bits - 2, 3)
            blocks = (height + (1 << group_bits) - 1) >> group_bits, (width + (1 << group_bits) - 1) >> group_bits
            write_image(w, np.repeat((np.arange(blocks[0]) % 2 << 8)[:, None], blocks[1], 1), False)
            group = (np.arange(len(px)) // width >> group_bits) % 2
    green, sizes = 280 + (1 << cache_bits if cache_bits else 0), (256, 256, 256, 40)
    start, kinds = np.ones(len(px), bool), np.array((px >> np.uint32(8)) & np.uint32(255), np.int64)
    for a, n, _ in copies:
        start[a : a + n] = False
        start[a] = True
    refs = {}
    for a, n, d in copies:
        far = NEAR.index((0, 1)) + 1 if d == width else NEAR.index((1, 0)) + 1 if d == 1 else d + 120
        refs[a] = (prefix_symbol(n), prefix_symbol(far))
        kinds[a] = 256 + refs[a][0][0]
    if cache_bits:
        key = (px * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        last: dict[int, int] = {}
        for i, (k, p) in enumerate(zip(key.tolist(), px.tolist())):
            if start[i] and i not in refs and last.get(k) == p:
                kinds[i] = 280 + k
            last[k] = p
    at = np.flatnonzero(start)
    kind, own = kinds[at], group[at]
    plain = kind < 256
    parts = [(px[at] >> np.uint32(s)).astype(np.int64) & 255 for s in (16, 0, 24)]
    values, widths = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)
    spot = dict(zip(refs, np.searchsorted(at, list(refs)).tolist()))
    for g in range(int(group.max()) + 1):
        mine = own == g
        told = write_code(w, code_lengths(np.bincount(kind[mine], minlength=green), 12))
        values[mine, 0], widths[mine, 0] = reverse_codes(told)[kind[mine]], np.frombuffer(told, np.uint8)[kind[mine]]
        for k, (part, size) in enumerate(zip(parts, sizes), 1):
            lit = mine & plain
            told = write_code(w, code_lengths(np.bincount(part[lit], minlength=size), 12))
            values[lit, k], widths[lit, k] = reverse_codes(told)[part[lit]], np.frombuffer(told, np.uint8)[part[lit]]
        used = [(k, *refs[a]) for a, k in spot.items() if mine[k]]
        told = write_code(w, code_lengths(np.bincount([f[0] for _, _, f in used], minlength=40) if used else np.zeros(40, np.int64), 12))
        for k, (_, extra, n), (s, more, m) in used:
            values[k, 1], widths[k, 1] = extra, n
            values[k, 2], widths[k, 2] = reverse_codes(told)[s], told[s]
            values[k, 3], widths[k, 3] = more, m
    if not widths[:, 1:].any():
        values, widths = values[:, 0], widths[:, 0]
    values, widths = values.ravel(), widths.ravel()
    if main:
        return w.packed(values, widths)
    for v, n in zip(values.tolist(), widths.tolist()):
        w.put(v, n)
    return None


def encode(argb: np.ndarray, transforms: tuple[int, ...] = (SUBTRACT_GREEN,), cache_bits: int = 0, group_bits: int = 0, block_bits: int = 3, modes: np.ndarray | None = None, copies: list[tuple[int, int, int]] | None = None) -> bytes:
    """A lossless WebP file of the pixels (height, width), each at most 16,384.

    transforms are applied in order. modes: the predictor's mode of each block, and
    copies: the stretches that become references, both as chosen() finds them for
    grey samples; without modes, these follow a fixed pattern, as the cross-colour
    factors of blocks do. A palette has to suffice (256 colours) and comes last.
    """
    height, width = argb.shape
    pixels, w = argb.astype(np.uint32), Writer()
    alpha = bool((pixels >> np.uint32(24) != 255).any())
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        w.put(value, n)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        blocks = (pixels.shape[0] + (1 << block_bits) - 1) >> block_bits, (pixels.shape[1] + (1 << block_bits) - 1) >> block_bits
        turn = np.arange(blocks[0] * blocks[1], dtype=np.uint32).reshape(blocks)
        if kind == PREDICTOR:
            w.put(block_bits - 2, 3)
            own = turn % np.uint32(14) if modes is None else modes.astype(np.uint32)
            write_image(w, np.uint32(0xFF000000) | own << np.uint32(8), False)
            pixels = whole(predict(channels(pixels), own, block_bits, -1))
        elif kind == CROSS_COLOUR:
            w.put(block_bits - 2, 3)
            table = np.uint32(0xFF000000) | (turn * np.uint32(37) % np.uint32(256)) << np.uint32(16) | (turn * np.uint32(11) % np.uint32(256)) << np.uint32(8) | turn * np.uint32(91) % np.uint32(256)
            write_image(w, table, False)
            pixels = whole(cross(channels(pixels), channels(table), block_bits, -1))
        elif kind == SUBTRACT_GREEN:
            green = (pixels >> np.uint32(8)) & np.uint32(0xFF)
            pixels = (pixels & np.uint32(0xFF00FF00)) | ((pixels | np.uint32(0xFF00FF00)) - (green << np.uint32(16) | green) & np.uint32(0x00FF00FF))
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(colours) - 1, 8)
            c = channels(colours[None])
            write_image(w, whole(np.concatenate([c[:, :1], np.diff(c, axis=1)], axis=1)), False)
            bits = bundle(len(colours))
            index = index.reshape(height, -1).astype(np.uint32)
            if bits:
                index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << bits))))
                index = (index.reshape(height, -1, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(2, dtype=np.uint32)
            pixels = np.uint32(0xFF000000) | index << np.uint32(8)
    w.put(0, 1)
    data = write_image(w, pixels, True, cache_bits, group_bits, copies)
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def grey(samples: np.ndarray) -> np.ndarray:
    """Opaque grey pixels of 8-bit samples (height, width)."""
    return samples.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
