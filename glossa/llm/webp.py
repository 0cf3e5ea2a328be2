"""Lossless WebP: a decoder and an encoder for media columns.

The decoder follows the published bitstream specification: RIFF container, VP8L header,
prefix codes (simple and normal, with entropy images), LZ77 back-references with the
two-dimensional distance map, colour cache, and the inverse predictor, cross-colour,
subtract-green and colour-indexing transforms. A prefix code is a table over its longest
code's bits. Where only green varies, array operations look up every bit of the stream as
the begin of a token, and the chain from the first one tells the tokens; elsewhere a pixel
takes one look at nine bytes of the stream.

The encoder writes Huffman codes of at most 15 bits, references to the last place of the
same four pixels, and cache hits. ``plan`` chooses for each image by entropies: cross-colour
that takes green from red and blue, the predictor with a mode per tile before it, a
palette, or a colour cache.

Bytes are stored as grey samples: red, green and blue of an opaque pixel are equal, and
``ROW`` of them are a row; payloads beyond ``MAX_ROWS`` rows take several files, one after
the other.

Defined cases: a null text counts as empty; equal texts give equal stored bytes; repeated
rows give equal rows; very long texts are stored whole, in several files; an empty table
gives an empty result; further columns are not read, so any names may stand there; broken
streams raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import log2
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm.batches import small_batches

ROW = 576
MAX_ROWS = 1 << 8
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = range(4)

# Fixed values of the bitstream: the order of code-length codes, the first offsets of the
# two-dimensional distance map.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


#: Longest code that the encoder gives, and that the format allows.
LONGEST, ALLOWED = 10, 15
_BACK = np.zeros(1 << ALLOWED, np.int64)  # the bits of each number from the other end
for _k in range(ALLOWED):
    _BACK |= (np.arange(1 << ALLOWED) >> _k & 1) << (ALLOWED - 1 - _k)


# ---------------------------------------------------------------- prefix codes


class Prefix:
    """A canonical prefix code, read with the first code bit in the lowest bit: symbols in
    order of their codes, and the codes' lengths (0 where there is one symbol only)."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.single = len(symbols) == 1
        if self.single:
            self.symbols, self.lengths, self.depth = symbols, np.zeros(1, np.int64), 0
            return
        order = np.lexsort((symbols, lengths))
        self.symbols = symbols[order]
        self.lengths = lengths[order]
        if int((1 << (ALLOWED - self.lengths)).sum()) != 1 << ALLOWED:
            raise ValueError("prefix code is not complete")
        self.depth = int(self.lengths[-1])

    def table(self, shift: int = 0) -> list[int]:
        """(symbol << shift) * 16 + length for each value of the next ``depth`` bits."""
        return self.ahead(shift).tolist()

    def ahead(self, shift: int = 0) -> np.ndarray:
        if self.single:
            return self.symbols[:1] << shift + 4
        ahead = np.repeat((self.symbols << shift) << 4 | self.lengths, 1 << (self.depth - self.lengths))
        return ahead[_BACK[: 1 << self.depth] >> (ALLOWED - self.depth)]

    def arrays(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Code and length of each symbol."""
        code, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        widths = 1 << (ALLOWED - self.lengths)
        code[self.symbols] = _BACK[(np.cumsum(widths) - widths) & ((1 << ALLOWED) - 1)]
        length[self.symbols] = self.lengths
        return code, length


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def look(self) -> int:
        """The next 65 bits or more; zeros behind the end."""
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 9], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        got = self.look() & ((1 << n) - 1)
        self.skip(n)
        return got

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers, each in so many bits (less than 64)."""
        if len(sizes):
            self.put(*_packed(values, sizes, np.array([len(sizes)]))[0])

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _packed(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Numbers, each in so many bits (less than 64), that meet in words of 64 bits: as many
    streams as ``counts``, which has each one's numbers; a stream as a number, and its bits."""
    ends = np.cumsum(sizes)
    last = np.append(0, ends)[np.cumsum(counts)]
    bits = np.diff(last, prepend=0)
    room = (bits >> 6) + 2
    begin = np.cumsum(room) - room
    ends += np.repeat((begin << 6) - (last - bits), counts)
    starts = ends - sizes
    word, shift, values = starts >> 6, (starts & 63).astype(np.uint64), values.astype(np.uint64)
    words = np.zeros(int(room.sum()), np.uint64)
    first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
    words[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(ends > (word + 1) << 6)  # at most one number for each word
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    data = words.astype("<u8").tobytes()
    return [(int.from_bytes(data[8 * k : 8 * (k + r)], "little"), n) for k, r, n in zip(begin.tolist(), room.tolist(), bits.tolist(), strict=True)]


#: Codes of one symbol, which take no bits.
ONE = [Prefix(np.array([_k]), np.zeros(1, np.int64)) for _k in range(256)]


@lru_cache(4096)
def _lengths_table(some: tuple) -> tuple[list[int], int]:
    """A code of code lengths, (symbol, length) each, as a table, and the mask of its look."""
    coder = Prefix(*np.array(some, np.int64).T)
    return coder.table(), (1 << coder.depth) - 1


@lru_cache(4096)
def _lengths_code(used: tuple) -> tuple[int, int, dict[int, tuple[int, int]]]:
    """What precedes code lengths of these symbols, its bits, and each symbol's code and length."""
    depth = max(1, (len(used) - 1).bit_length())
    short = (1 << depth) - len(used)  # this many symbols take one bit less, in pairs of one
    coder = Prefix(np.array(used), np.where(np.arange(len(used)) < short, depth - 1, depth) if len(used) > 1 else np.ones(1, np.int64))
    own = dict(zip(coder.symbols.tolist(), coder.lengths.tolist() if not coder.single else [1], strict=True))
    count = max(4, max(CODE_LENGTH_ORDER.index(s) for s in own) + 1)
    head = (count - 4) << 1 | sum(own.get(s, 0) << 5 + 3 * k for k, s in enumerate(CODE_LENGTH_ORDER[:count]))
    code, bits = (x.tolist() for x in coder.arrays(19))
    return head, 5 + 3 * count, {s: (code[s], bits[s]) for s in used}


def read_prefix(bits: Reader, size: int) -> Prefix:
    x = bits.look()
    if x & 1:  # one or two symbols: their number, the first one's width, the symbols
        wide = 8 if x >> 2 & 1 else 1
        first, second = x >> 3 & ((1 << wide) - 1), x >> 3 + wide & 255
        bits.skip(3 + wide + (8 if x & 2 else 0))
        if not x & 2 or first == second:
            return ONE[first]
        return Prefix(np.array([min(first, second), max(first, second)]), np.ones(2, np.int64))
    count = 4 + (x >> 1 & 15)
    x = x >> 5 & (1 << 3 * count) - 1
    bits.skip(5 + 3 * count)
    some = tuple((CODE_LENGTH_ORDER[i], n) for i in range(count) if (n := x >> 3 * i & 7))
    if not some:
        raise ValueError("prefix code is not complete")
    table, mask = _lengths_table(some)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    symbols: list[int] = []
    lengths: list[int] = []
    at, before, x, have = 0, 8, 0, 0
    while at < size and left:
        left -= 1
        if have < 16:
            x, have = bits.look(), 64
        got = table[x & mask]
        symbol, used = got >> 4, got & 15
        x >>= used
        if symbol < 16:
            if symbol:
                symbols.append(at)
                lengths.append(symbol)
                before = symbol
            at += 1
        elif symbol == 16:
            n = 3 + (x & 3)
            symbols += range(at, at + n)
            lengths += [before] * n
            at += n
            used += 2
            x >>= 2
        elif symbol == 17:
            at += 3 + (x & 7)
            used += 3
            x >>= 3
        else:
            at += 11 + (x & 127)
            used += 7
            x >>= 7
        bits.at += used
        have -= used
    if at > size or bits.at > 8 * len(bits.data):
        raise ValueError("too many code lengths")
    if not symbols:
        raise ValueError("prefix code is not complete")
    return Prefix(np.array(symbols), np.array(lengths))


def write_prefix(w: Writer, prefix: Prefix, size: int) -> None:
    symbols = sorted(prefix.symbols.tolist())
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1 | (len(symbols) - 1) << 1 | 1 << 2 | symbols[0] << 3 | (symbols[1] << 11 if len(symbols) > 1 else 0), 3 + 8 * len(symbols))
        return
    length = symbols[-1] + 1
    runs: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    done = 0
    own = prefix.symbols.tolist()
    for k, long in sorted(zip(own, prefix.lengths.tolist(), strict=True)):
        n = k - done
        done = k + 1
        while n >= 11:
            runs.append((18, min(n, 138) - 11, 7))
            n -= min(n, 138)
        if n >= 3:
            runs.append((17, n - 3, 3))
        elif n > 0:
            runs += [(0, 0, 0)] * n
        runs.append((long, 0, 0))
    if len(runs) < 2 or length == size:  # no shorter than all lengths
        runs += [(0, 0, 0)] * (size - length)
    head, size_of, codes = _lengths_code(tuple(sorted({x[0] for x in runs})))
    w.put(head, size_of)
    if len(runs) >= 2 and length < size:
        n = max(1, ((len(runs) - 2).bit_length() + 1) // 2)
        w.put(1 | (n - 1) << 1 | (len(runs) - 2) << 4, 4 + 2 * n)
    else:
        w.put(0, 1)
    value = n = 0
    for name, extra, more in runs:
        code, bits = codes[name]
        value |= (code | extra << bits) << n
        n += bits + more
    w.put(value, n)


# ---------------------------------------------------------------- decoding


def _stretch(symbol: int, x: int) -> tuple[int, int]:
    """The length or distance code of a prefix symbol and the bits that follow, and their number."""
    if symbol < 4:
        return symbol + 1, 0
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + (x & ((1 << n) - 1)) + 1, n


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _parts(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


#: Bits of streams that one step of ``_read_green`` looks at, for one stream at most.
LOOK = 1 << 17
#: Tokens from one head of a chain to the next, as a power of two.
HEADS = 4
# The least value of each length or distance symbol, and its number of extra bits.
_LEAST, _MORE = np.array([_stretch(_k, 0) for _k in range(40)], np.int64).T


def _read_green(streams: list[tuple[Reader, list[Prefix], int, int]]) -> list[np.ndarray]:
    """Pixels of images (stream, codes, width, pixels) without a cache of which only green has a
    code of several symbols, in steps over several streams or a part of one."""
    out, tables = [bytearray() for _ in streams], []
    for _, group, _, _ in streams:
        if group[0].single:  # a reference, and nothing before it
            raise ValueError("a reference leaves the image")
        if int(group[0].symbols.max()) > 255 and int(group[4].symbols.max()) >= len(_LEAST):
            raise ValueError("no distance has this symbol")
        tables.append((group[0].ahead().astype(np.uint16), group[4].ahead()))
    left = range(len(streams))
    while left:
        chosen, total = [], 0
        for i in left:
            bits, group, _, n = streams[i]
            if bits.at >= 8 * len(bits.data):
                raise ValueError("the stream ends early")
            size = min(LOOK, group[0].depth * (n - len(out[i])), 8 * len(bits.data) - bits.at)  # places where a token may begin
            chosen.append((*streams[i], *tables[i], out[i], size))
            total += size
            if total >= LOOK:
                break
        _read_step(chosen)
        left = [i for i in left if len(out[i]) < streams[i][3]]
    pixels = []
    for (bits, group, _, _), values in zip(streams, out, strict=True):
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
        red, blue, alpha = (int(p.symbols[0]) for p in group[1:4])
        pixels.append(np.frombuffer(bytes(values), np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue))
    return pixels


def _read_step(chosen: list[tuple]) -> None:
    """Extend each stream's pixels by the tokens that begin in its next bits. Every bit is looked
    up as if a token began there, which gives the next one's place; the tokens are those that
    the first one's chain of places meets. Streams stand one after the other, each before
    bytes without tokens, where its chain ends."""
    raws, begins, ends, room = [], [], [], 0
    for bits, *_, size in chosen:
        first, after = bits.at >> 3, bits.at + size >> 3
        raw = bits.data[first : after + 16]
        raws.append(raw + bytes(after - first + 24 - len(raw)))  # a token that begins here takes less than 8 bytes
        begins.append(8 * room + (bits.at & 7))
        ends.append(begins[-1] + size)
        room += len(raws[-1])
    joined = b"".join([*raws, bytes(8)])
    green, far = [c[4] for c in chosen], [c[5] for c in chosen]
    lengths = [len(x) for x in raws]
    masks, bases = (np.repeat(np.array(x, np.uint32), lengths) for x in zip(*_bases(green), strict=True))
    here = np.ndarray(room, "<u4", joined, strides=(1,)) >> np.arange(8, dtype=np.uint32)[:, None]
    here &= masks
    here += bases
    got = np.concatenate(green).take(here.T.astype(np.intp, order="C").ravel())
    edge = 0
    for begin, end in zip(begins, ends, strict=True):
        got[edge:begin] = 0
        edge = end
    got[edge:] = 0
    following = np.arange(len(got)) + (got & 15)
    place = np.flatnonzero(got >= 256 << 4)
    if len(place):
        words = np.ndarray(room, "<u8", joined, strides=(1,))

        def window(at):
            return (words[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64)

        masks, bases = (np.array(x)[np.searchsorted(ends, place, "right")] for x in zip(*_bases(far), strict=True))
        symbol, next_ = (got[place] >> 4).astype(np.int64) - 256, following[place]
        length = _LEAST[symbol] + (window(next_) & (1 << _MORE[symbol]) - 1)
        next_ += _MORE[symbol]
        distance = np.concatenate(far)[bases + (window(next_) & masks)]
        next_ += distance & 15
        distance >>= 4
        code = _LEAST[distance] + (window(next_) & (1 << _MORE[distance]) - 1)
        following[place] = next_ + _MORE[distance]
    jump = following
    for _ in range(HEADS):
        jump = jump.take(jump)
    heads, ahead = [], memoryview(jump)
    for k, end in zip(begins, ends, strict=True):
        while k < end:
            heads.append(k)
            k = ahead[k]
    chain = np.empty((1 << HEADS, len(heads)), np.int64)
    chain[0] = heads
    for k in range(1, 1 << HEADS):
        chain[k] = following.take(chain[k - 1])
    path = chain.T.ravel()
    token = got[path]
    path, token = path[token > 0], token[token > 0] >> 4
    literal, refer = token.astype(np.uint8).tobytes(), np.flatnonzero(token > 255)
    of = np.searchsorted(place, path[refer])
    copies = list(zip(refer.tolist(), length[of].tolist(), code[of].tolist(), strict=True)) if len(refer) else []
    stops = np.searchsorted(path, ends)
    parts = zip(chosen, begins, stops.tolist(), np.searchsorted(refer, stops).tolist(), strict=True)
    done = i = 0
    for (bits, _, width, n, _, _, out, _), begin, stop, last in parts:
        for k, many, distance in copies[i:last]:
            if k - done >= n - len(out):
                break
            out += literal[done:k]
            done = k + 1
            back = _distance(distance, width)
            if back > len(out) or len(out) + many > n:
                raise ValueError("a reference leaves the image")
            piece = out[len(out) - back : len(out) - back + many]
            out += piece if back >= many else (piece * (many // back + 1))[:many]
        read = min(stop, done + n - len(out))
        out += literal[done:read]
        bits.at += int(following[path[read - 1]]) - begin
        done, i = stop, last


def _bases(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """For tables one after the other, the mask of each one's numbers and its first place."""
    out, at = [], 0
    for table in tables:
        out.append((len(table) - 1, at))
        at += len(table)
    return out


def _read_image(bits: Reader, width: int, height: int, main: bool) -> np.ndarray | tuple:
    """Entropy-coded pixels, as a flat array of ARGB numbers; of a main image of which only
    green varies, what ``_read_green`` takes."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache of too many bits")
    cache, shift = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits
    entropy, tile = None, 0
    if main and bits.take(1):
        tile = bits.take(3) + 2
        image = _read_image(bits, _parts(width, tile), _parts(height, tile), False)
        entropy = ((image >> 8) & 0xFFFF).tolist()
    sizes = (256 + 24 + len(cache), 256, 256, 256, 40)
    groups = [[read_prefix(bits, s) for s in sizes] for _ in range(max(entropy) + 1 if entropy else 1)]
    n = width * height
    if len(groups) == 1 and all(p.single for p in groups[0][:4]) and groups[0][0].symbols[0] < 256:  # pixels take no bits
        return np.full(n, sum(int(p.symbols[0]) << place for p, place in zip(groups[0], (8, 16, 0, 24), strict=False)), np.uint32)
    if not cache and len(groups) == 1 and all(p.single for p in groups[0][1:4]):
        green = (bits, groups[0], width, n)
        return green if main else _read_green([green])[0]
    across = _parts(width, tile) if entropy else 0
    # Symbols stand where their channel stands in a pixel, but green ones, which are compared.
    look = [[(p.table(place), (1 << p.depth) - 1) for p, place in zip(g, (0, 16, 0, 24, 0), strict=True)] for g in groups]
    (green, g), (red, r), (blue, b), (alpha, a), (far, f) = look[0]
    opaque = alpha[0] >> 4 if not a else None
    data, end, fetch = bits.data, 8 * len(bits.data), int.from_bytes
    out: list[int] = []
    add = out.append
    i = kept = 0
    at = bits.at >> 3
    x = fetch(data[at : at + 16], "little") >> (bits.at & 7)
    at += 16
    have = 128 - (bits.at & 7)
    while i < n:
        if have < 64:
            x |= fetch(data[at : at + 16], "little") << have
            at += 16
            have += 128
        if entropy:
            (green, g), (red, r), (blue, b), (alpha, a), (far, f) = look[entropy[(i // width >> tile) * across + (i % width >> tile)]]
            opaque = alpha[0] >> 4 if not a else None
        got = green[x & g]
        used = got & 15
        x >>= used
        have -= used
        got >>= 4
        if got < 256:
            got_red = red[x & r]
            used = got_red & 15
            x >>= used
            got_blue = blue[x & b]
            last = got_blue & 15
            x >>= last
            have -= used + last
            if opaque is None:
                got_alpha = alpha[x & a]
                x >>= got_alpha & 15
                have -= got_alpha & 15
                add(got_alpha >> 4 | got_red >> 4 | got << 8 | got_blue >> 4)
            else:
                add(opaque | got_red >> 4 | got << 8 | got_blue >> 4)
            i += 1
        elif got < 280:
            length, used = _stretch(got - 256, x)
            x >>= used
            got = far[x & f]
            x >>= got & 15
            code, more = _stretch(got >> 4, x)
            x >>= more
            have -= used + (got & 15) + more
            back = _distance(code, width)
            if back > i or i + length > n:
                raise ValueError("a reference leaves the image")
            piece = out[i - back : i - back + length]
            out += piece if back >= length else (piece * (length // back + 1))[:length]
            i += length
        else:
            for v in out[kept:]:
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> shift] = v
            kept = i
            add(cache[got - 280])
            i += 1
    bits.at = 8 * at - have
    if bits.at > end:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as one more axis of int32."""
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _argb(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, left_top, right_top):
    """The prediction of a pixel from its neighbours, each a sequence of four channels."""
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 0:
        return [255, 0, 0, 0]
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right_top
    if mode == 4:
        return left_top
    if mode == 5:
        return average(average(left, right_top), top)
    if mode == 6:
        return average(left, left_top)
    if mode == 7:
        return average(left, top)
    if mode == 8:
        return average(left_top, top)
    if mode == 9:
        return average(top, right_top)
    if mode == 10:
        return average(average(left, left_top), average(top, right_top))
    if mode == 11:
        far_left = sum(abs(t - c) for t, c in zip(top, left_top, strict=True))
        far_top = sum(abs(x - c) for x, c in zip(left, left_top, strict=True))
        return left if far_left < far_top else top
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(left, top, left_top, strict=True)]
    if mode == 13:
        halves = [(m, m - c) for m, c in zip(average(left, top), left_top, strict=True)]
        return [min(255, max(0, m + (d // 2 if d >= 0 else -(-d // 2)))) for m, d in halves]
    raise ValueError(f"no predictor {mode}")


def _edges(modes: np.ndarray, tile: int, width: int, height: int) -> np.ndarray:
    """The mode of each pixel; the first row looks left and the first column up."""
    grid = np.repeat(np.repeat(modes.reshape(_parts(height, tile), -1), 1 << tile, axis=0), 1 << tile, axis=1)[:height, :width].copy()
    grid[0, :], grid[:, 0] = 1, 2
    return grid


def _restore(rest: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Undo the predictor: rests (height, width, 4) and modes to channels."""
    height, width, _ = rest.shape
    out = np.zeros((height, width, 4), np.int32)
    out[0] = np.cumsum(np.vstack([rest[:1, 0] + np.array([[255, 0, 0, 0]]), rest[0, 1:]]), axis=0) & 255
    for y in range(1, height):
        edges = [0, *(np.flatnonzero(np.diff(grid[y])) + 1).tolist(), width]
        # The pixel right above the last of a row is the first of its own row.
        out[y, 0] = (rest[y, 0] + out[y - 1, 0]) & 255
        above = np.vstack([out[y - 1], out[y, :1]])
        for x0, x1 in zip(edges, edges[1:], strict=False):
            mode = int(grid[y, x0])
            x0 = max(x0, 1)
            if x0 >= x1:
                continue
            if mode == 1:
                out[y, x0:x1] = np.cumsum(np.vstack([out[y, x0 - 1 : x0], rest[y, x0:x1]]), axis=0)[1:] & 255
            elif mode in (0, 2, 3, 4, 8, 9):
                guess = _predict(mode, None, *([c[..., k] for k in range(4)] for c in (above[x0:x1], above[x0 - 1 : x1 - 1], above[x0 + 1 : x1 + 1])))
                out[y, x0:x1] = (rest[y, x0:x1] + np.stack(np.broadcast_arrays(*guess), axis=-1)) & 255
            else:
                left, row, up = out[y, x0 - 1].tolist(), rest[y, x0:x1].tolist(), above[x0 - 1 : x1 + 1].tolist()
                for k, item in enumerate(row):
                    left = row[k] = [(a + b) & 255 for a, b in zip(item, _predict(mode, left, up[k + 1], up[k], up[k + 2]), strict=True)]
                out[y, x0:x1] = row
    return out


def _guess(image: np.ndarray, mode: int) -> np.ndarray:
    """What a mode predicts for each pixel of a known image (height, width, 4)."""
    height, width, _ = image.shape
    c = np.zeros((height + 1, width + 2, 4), np.int32)
    c[1:, 1:-1] = image
    c[:-1, -1] = image[:, 0]
    left, top, left_top, right_top = ([x[..., k] for k in range(4)] for x in (c[1:, :-2], c[:-1, 1:-1], c[:-1, :-2], c[:-1, 2:]))
    if mode == 11:
        far_left = sum(abs(t - x) for t, x in zip(top, left_top, strict=True))
        far_top = sum(abs(t - x) for t, x in zip(left, left_top, strict=True))
        guess = [np.where(far_left < far_top, a, b) for a, b in zip(left, top, strict=True)]
    elif mode == 12:
        guess = [np.clip(a + b - x, 0, 255) for a, b, x in zip(left, top, left_top, strict=True)]
    elif mode == 13:
        halves = [((a + b) >> 1, x) for a, b, x in zip(left, top, left_top, strict=True)]
        guess = [np.clip(m + (m - x + (m < x)) // 2, 0, 255) for m, x in halves]
    else:
        guess = _predict(mode, left, top, left_top, right_top)
    return np.stack(np.broadcast_arrays(*guess, left[0])[:4], axis=-1)


def _rests(image: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """What the modes of ``grid`` leave of an image."""
    out = np.zeros_like(image)
    for mode in np.unique(grid).tolist():
        at = grid == mode
        out[at] = (image - _guess(image, mode))[at] & 255
    out[0, 0] = (image[0, 0] - np.array([255, 0, 0, 0])) & 255
    return out


def _cross(argb: np.ndarray, width: int, parts: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """Add (or take away) the cross-colour deltas of the tiles' numbers ``parts``."""
    if (parts == parts.flat[0]).all():
        k = parts.flat[0]
    else:
        grid = np.repeat(np.repeat(parts.reshape(-1, _parts(width, tile)), 1 << tile, axis=0), 1 << tile, axis=1)
        k = grid[: len(argb) // width, :width].ravel()
    if sign < 0 and np.ndim(k) == 0 and int(k) & 0xFFFFFF == GREY and not ((argb ^ argb >> np.uint32(8)) & np.uint32(0xFFFF)).any():
        return argb & np.uint32(0xFF00FF00)  # a grey image: red and blue less green
    if sign > 0 and np.ndim(k) == 0 and int(k) & 0xFFFFFF == GREY and not (argb & np.uint32(0xFF00FF)).any():
        green = argb & np.uint32(0xFF00)
        return argb | green << np.uint32(8) | green >> np.uint32(8)
    # Bytes are signed numbers here.
    green_to_red, green_to_blue, red_to_blue = (np.asarray(k >> np.uint32(s)).astype(np.int8).astype(np.int16) for s in (0, 8, 16))
    red, green, blue = ((argb >> np.uint32(s)).astype(np.int8).astype(np.int16) for s in (16, 8, 0))
    new = red + sign * (green_to_red * green >> 5)
    blue = blue + sign * (green_to_blue * green >> 5)
    if red_to_blue.any():
        known = (new if sign > 0 else red).astype(np.int8).astype(np.int16)
        blue = blue + sign * (red_to_blue * known >> 5)
    rest = argb & np.uint32(0xFF00FF00)
    return rest | (new & 255).astype(np.uint32) << np.uint32(16) | (blue & 255).astype(np.uint32)


def _index_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """One file to an array of ARGB numbers (height, width)."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """Files to arrays of ARGB numbers; images of which only green varies are read together."""
    opened = [_open(x) for x in files]
    green = iter(_read_green([x[-1] for x in opened if isinstance(x[-1], tuple)]))
    return [_undo(*x, next(green) if isinstance(out, tuple) else out) for *x, out in opened]


def _open(data: bytes) -> tuple:
    """Height, transforms and main image of a file, as far as ``_read_image`` goes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        (n,) = struct.unpack_from("<I", data, at + 4)
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + n]
            break
        at += 8 + n + (n & 1)
    if body is None or body[:1] != b"\x2f":
        raise ValueError("no lossless image")
    bits = Reader(body)
    bits.at = 8
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    transforms = []
    w = width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.take(3) + 2
            transforms.append((kind, w, tile, _read_image(bits, _parts(w, tile), _parts(height, tile), False)))
        elif kind == COLOUR_INDEXING:
            n = bits.take(8) + 1
            palette = _argb(np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0))
            transforms.append((kind, w, _index_bits(n), palette))
            w = _parts(w, _index_bits(n))
        else:
            transforms.append((kind, w, 0, None))
    return height, transforms, _read_image(bits, w, height, True)


def _undo(height: int, transforms: list[tuple], out: np.ndarray) -> np.ndarray:
    for kind, w, tile, extra in reversed(transforms):
        if kind == SUBTRACT_GREEN:
            c = _channels(out)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            out = _argb(c)
        elif kind == COLOUR_INDEXING:
            index = (out >> 8) & 255
            if tile:
                per, depth = 1 << tile, 8 >> tile
                index = ((index[:, None] >> (np.arange(per, dtype=np.uint32) * depth)) & ((1 << depth) - 1)).reshape(height, -1)[:, :w].ravel()
            palette = np.zeros(256, np.uint32)
            palette[: len(extra)] = extra
            out = palette[index]
        elif kind == CROSS_COLOUR:
            out = _cross(out, w, extra, tile, 1)
        else:
            modes = ((extra >> 8) & 15).astype(np.int64)
            out = _argb(_restore(_channels(out).reshape(height, w, 4), _edges(modes, tile, w, height))).ravel()
    return out.reshape(height, -1)


# ---------------------------------------------------------------- encoding


def huffman(counts: np.ndarray) -> Prefix:
    """The shortest code for symbols that occur; weights are evened until it is short enough."""
    used = np.flatnonzero(counts)
    if len(used) < 2:
        only = int(used[0]) if len(used) else 0
        return ONE[only] if only < 256 else Prefix(np.array([0, only]), np.ones(2, np.int64))
    weights, n = counts[used], len(used)
    while True:
        order = np.argsort(weights, kind="stable")
        # Leaves by weight, then joined nodes, which come by weight too.
        heavy = weights[order].tolist()
        heavy += [heavy[-1] + heavy[-2] + sum(heavy)] * n
        parents, i, j = [0] * (2 * n), 0, n
        for node in range(n, 2 * n - 1):
            if i < n and (j >= node or heavy[i] <= heavy[j]):
                a, i = i, i + 1
            else:
                a, j = j, j + 1
            if i < n and (j >= node or heavy[i] <= heavy[j]):
                b, i = i, i + 1
            else:
                b, j = j, j + 1
            heavy[node] = heavy[a] + heavy[b]
            parents[a] = parents[b] = node
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parents[node]] + 1
        if max(depth) <= LONGEST:
            return Prefix(used[order], np.array(depth[:n], np.int64))
        weights = (weights + 1) // 2


def _slots(flat: np.ndarray, cache_bits: int) -> np.ndarray:
    return (flat * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)


def _last(keys: np.ndarray) -> np.ndarray:
    """The last place before of each key, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def _hits(flat: np.ndarray, cache_bits: int) -> np.ndarray:
    """Whether the cache holds each pixel when it comes: the last of its slot is equal."""
    last = _last(_slots(flat, cache_bits))
    return (last >= 0) & (flat[last] == flat)


def _order(keys: np.ndarray) -> np.ndarray:
    """Places by key, equal ones by place; numbers of 16 bits sort in two passes."""
    low = np.argsort(keys.astype(np.uint16), kind="stable")
    return low[np.argsort((keys >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def _copies(flat: np.ndarray, images: list[tuple[int, int]], least: int = 10) -> np.ndarray:
    """(start, length, distance) of references within images, which are from one place of
    ``flat`` to another each; shorter ones cost more time than they save."""
    images = [(a, b) for a, b in images if b - a >= 8]
    if not images:
        return np.zeros((0, 3), np.int64)
    mixed = flat ^ flat >> np.uint32(15)
    keys = ((mixed[:-3] * np.uint32(0x9E3779B1) ^ mixed[1:-2]) * np.uint32(0x85EBCA6B) ^ mixed[2:-1]) * np.uint32(0xC2B2AE35) ^ mixed[3:]
    orders = []
    for a, b in images:
        own = keys[a : b - 3]
        if b - a < 1 << 13:  # short numbers sort faster; two that meet by chance are told apart below
            short = (own ^ own >> np.uint32(16)).astype(np.uint16)
            own[:] = short
            orders.append(np.argsort(short, kind="stable") + a)
        else:
            orders.append(_order(own) + a)
    order = np.concatenate(orders)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    same[np.cumsum([len(x) for x in orders[:-1]], dtype=np.int64) - 1] = False  # the first of an image has none before
    same = np.flatnonzero(same)
    at, from_ = order[same + 1], order[same]
    two = np.ndarray(len(flat) - 1, "<u8", flat, strides=(4,)).copy()
    alike = (two[at] == two[from_]) & (two[at + 2] == two[from_ + 2])
    back = np.zeros(len(flat), np.int64)
    back[at[alike]] = (at - from_)[alike]
    edges = np.flatnonzero(back[1:] != back[:-1]) + 1  # an image's first and last three pixels have none before
    ends = np.append(edges[1:], len(flat))[: len(edges)]
    run = np.flatnonzero(ends - edges >= least - 3)
    run = run[back[edges[run]] > 0]
    out, free = [], 0
    for begin, end, distance in zip(edges[run].tolist(), ends[run].tolist(), back[edges[run]].tolist(), strict=True):
        begin = max(begin, free)
        while begin < end:
            length = min(end - begin + 3, 4096)
            out.append((begin, length, distance))
            free = begin = begin + length
    return np.array(out, np.int64).reshape(-1, 3)


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes."""
    v = values - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    small = v < 4
    n = np.where(small, 0, top - 1)
    return np.where(small, v, 2 * top + ((v >> n) & 1)), np.where(small, 0, v & ((1 << n) - 1)), n


def _write_image(w: Writer, flat: np.ndarray, width: int, cache_bits: int = 0, references: bool = False, main: bool = False) -> None:
    """Entropy-coded pixels: literals, cache hits and references by Huffman codes."""
    n = len(flat)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of codes
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    if not cache_bits and (flat == flat[0]).all():  # pixels take no bits
        w.put(*_one_colour(int(flat[0])))
        return
    copies = _copies(flat, [(0, n)] if references else [])
    single = np.arange(n)
    if len(copies):
        cover = np.zeros(n + 1, np.int64)
        cover[copies[:, 0]] += 1
        cover[copies[:, 0] + copies[:, 1]] -= 1  # a copy may begin where another ends
        single = np.flatnonzero(np.cumsum(cover)[:n] == 0)
    pixels = flat[single]
    green = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    lit = slice(None)
    if cache_bits:
        hit = _hits(flat, cache_bits)[single]
        green = np.where(hit, 280 + _slots(pixels, cache_bits).astype(np.int64), green)
        lit = np.flatnonzero(~hit)
    length = distance = np.zeros(0, np.int64)
    if len(copies):
        length, more, more_n = _symbols(copies[:, 1])
        near = _near_codes(width)
        distance, far, far_n = _symbols(np.array([near.get(d, d + len(NEAR)) for d in copies[:, 2].tolist()], np.int64))
    symbols = [np.concatenate([green, 256 + length]) if len(length) else green]
    others = [((pixels[lit] >> np.uint32(s)) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
    group = [huffman(np.bincount(x, minlength=size)) for x, size in zip(others, sizes[1:4], strict=True)]
    group = [huffman(np.bincount(x, minlength=size)) for x, size in zip(symbols, sizes, strict=False)] + group + [huffman(np.bincount(distance, minlength=40))]
    for p, size in zip(group, sizes, strict=True):
        write_prefix(w, p, size)
    # One number per token: its codes and extra bits, the first ones lowest.
    code, bits = (table[symbols[0]] for table in group[0].arrays(sizes[0]))
    k = len(single)
    for p, size, x in zip(group[1:4], sizes[1:4], others, strict=True):
        if not p.single:
            own, own_n = p.arrays(size)
            code[:k][lit] |= own[x] << bits[:k][lit]
            bits[:k][lit] += own_n[x]
    if len(copies):
        own, own_n = group[4].arrays(sizes[4])
        for value, number in ((more, more_n), (own[distance], own_n[distance]), (far, far_n)):
            code[k:] |= value << bits[k:]
            bits[k:] += number
        at = np.searchsorted(single, copies[:, 0]) + np.arange(len(copies))
        rest = np.ones(len(code), bool)
        rest[at] = False
        order = np.empty(len(code), np.int64)
        order[at], order[rest] = np.arange(k, len(code)), np.arange(k)
        code, bits = code[order], bits[order]
    w.add(code, bits)


@lru_cache(4096)
def _one_colour(pixel: int) -> tuple[int, int]:
    """The codes of an image of one pixel's colour, and their bits."""
    w = Writer()
    for s in (8, 16, 0, 24):
        write_prefix(w, ONE[pixel >> s & 255], 256)
    write_prefix(w, ONE[0], 40)
    return w.value, w.n


def _write_green(images: list[tuple[Writer, np.ndarray, int, bool]]) -> None:
    """Main images (writer, pixels, width, whether by references) without a cache of which only
    green varies: all are searched and coded at once, each by its own codes."""
    ends = np.cumsum([len(x[1]) for x in images])
    flat, spans = np.concatenate([x[1] for x in images]), zip([0, *ends.tolist()], ends.tolist(), strict=False)
    start, length, distance = _copies(flat, [s for s, x in zip(spans, images, strict=True) if x[3]]).T
    begins = np.ones(len(flat), bool)  # of tokens: a pixel, or a reference
    for a, b in zip((start + 1).tolist(), (start + length).tolist(), strict=True):
        begins[a:b] = False
    place = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(place, ends), prepend=0)
    symbol, of = (flat >> np.uint32(8)).astype(np.uint8)[place].astype(np.int64), np.repeat(np.arange(len(images)), counts)
    at = np.searchsorted(place, start)
    far_of, near = of[at], [_near_codes(x[2]) for x in images]
    length, more, more_n = _symbols(length)
    codes = [near[i].get(d, d + len(NEAR)) for i, d in zip(far_of.tolist(), distance.tolist(), strict=True)]
    distance, far, far_n = _symbols(np.array(codes, np.int64))
    symbol[at] = 256 + length
    symbol += 280 * of
    distance += 40 * far_of
    groups = []
    for (w, pixels, _, _), own, own_far in zip(images, np.bincount(symbol, minlength=280 * len(images)).reshape(-1, 280), np.bincount(distance, minlength=40 * len(images)).reshape(-1, 40), strict=True):
        first = int(pixels[0])
        groups.append([huffman(own), *(ONE[first >> s & 255] for s in (16, 0, 24)), huffman(own_far)])
        w.put(0, 2)  # no cache, one group of codes
        for p, size in zip(groups[-1], (280, 256, 256, 256, 40), strict=True):
            write_prefix(w, p, size)
    # One number per token: its codes and extra bits, the first ones lowest.
    code, bits = (np.concatenate(x)[symbol] for x in zip(*(g[0].arrays(280) for g in groups), strict=True))
    own, own_n = (np.concatenate(x)[distance] for x in zip(*(g[4].arrays(40) for g in groups), strict=True))
    for value, number in ((more, more_n), (own, own_n), (far, far_n)):
        code[at] |= value << bits[at]
        bits[at] += number
    for (w, *_), stream in zip(images, _packed(code, bits, counts), strict=True):
        w.put(*stream)


_NEAR_CODES: dict[int, dict[int, int]] = {}


def _near_codes(width: int) -> dict[int, int]:
    """Distance to its code in the two-dimensional map, the first one."""
    if width not in _NEAR_CODES:
        if len(_NEAR_CODES) > 64:
            _NEAR_CODES.clear()
        _NEAR_CODES[width] = {_distance(c, width): c for c in range(len(NEAR), 0, -1)}
    return _NEAR_CODES[width]


def encode(argb: np.ndarray, *how, **more) -> bytes:
    """An array of ARGB numbers (height, width) to one file, without loss: arguments as ``begin``."""
    return finish([begin(argb, *how, **more)])[0]


def begin(argb: np.ndarray, transforms=(), cache_bits: int = 0, references: bool = False, tile: int = 2, mode: int = 11, modes=None, cross: int = 0xFFFF05) -> tuple:
    """What ``finish`` makes a file of: the stream up to the main image, its pixels and their
    width, bits of the cache, whether by references.

    ``transforms`` are applied in order. The predictor's ``modes`` by tile, or else modes
    from ``mode`` on in turn; ``cross`` has red-to-blue, green-to-blue, green-to-red as
    bytes of one number."""
    height, width = argb.shape
    head = Writer()
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(1, 1)
    head.put(0, 3)
    flat, w = argb.astype(np.uint32).ravel(), width
    for kind in transforms:
        head.put(1, 1)
        head.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            c = _channels(flat)
            c[:, 1] -= c[:, 2]
            c[:, 3] -= c[:, 2]
            flat = _argb(c)
        elif kind == COLOUR_INDEXING:
            palette = np.unique(flat)
            if len(palette) > 256:
                raise ValueError("more than 256 colours")
            head.put(len(palette) - 1, 8)
            _write_image(head, _argb(np.diff(_channels(palette), axis=0, prepend=np.zeros((1, 4), np.int32))), len(palette))
            index, bits = np.searchsorted(palette, flat).reshape(height, w), _index_bits(len(palette))
            new = _parts(w, bits)
            padded = np.zeros((height, new << bits), np.uint32)
            padded[:, :w] = index
            packed = (padded.reshape(height, new, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * (8 >> bits))).sum(axis=2)
            flat, w = (packed.astype(np.uint32) << 8 | 0xFF000000).astype(np.uint32).ravel(), new
        elif kind == CROSS_COLOUR:
            head.put(tile - 2, 3)
            parts = np.full(_parts(height, tile) * _parts(w, tile), 0xFF000000 | cross, np.uint32)
            _write_image(head, parts, _parts(w, tile))
            flat = _cross(flat, w, parts, tile, -1)
        else:
            head.put(tile - 2, 3)
            n = _parts(height, tile) * _parts(w, tile)
            chosen = np.array([(mode + k) % 14 for k in range(n)] if modes is None else modes, np.uint32)
            _write_image(head, chosen << 8 | np.uint32(0xFF000000), _parts(w, tile))
            flat = _argb(_rests(_channels(flat).reshape(height, w, 4), _edges(chosen.astype(np.int64), tile, w, height))).ravel()
    head.put(0, 1)
    return head, flat, w, cache_bits, references


def finish(begun: list[tuple]) -> list[bytes]:
    """Files of images; those of which only green varies are written together."""
    green = []
    for head, flat, w, cache_bits, references in begun:
        varies = flat ^ flat[0]
        if cache_bits or (varies & np.uint32(0xFFFF00FF)).any() or not varies.any():
            _write_image(head, flat, w, cache_bits, references, True)
        else:
            green.append((head, flat, w, references))
    if green:
        _write_green(green)
    out = []
    for head, *_ in begun:
        stream = b"\x2f" + head.bytes()
        pad = b"\0" * (len(stream) & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad)
    return out


def _entropy(counts: np.ndarray) -> float:
    """Bits that a value takes on average, by how often each occurs."""
    some = counts[counts > 0].tolist()
    total = sum(some)
    return log2(total) - sum(map(mul, some, map(log2, some))) / total if total else 0.0


#: Bits of the cache, of a palette's colour and of a tile of transform data, and the tile,
#: by which plans are compared.
CACHE_BITS, COLOUR_COST, TILE_COST, TILE = 8, 20, 6, 5
#: Predictor modes that a tile may have.
MODES = (1, 2, 7, 11, 12)
#: Cross-colour deltas that take green from red and blue as it is.
GREY = 0x002020


def plan(grey: np.ndarray) -> dict:
    """Transforms and cache that promise the fewest bits for samples (height, width) as a
    grey image, as arguments of ``encode``."""
    height, width = grey.shape
    flat = grey.ravel()
    n, counts = grey.size, np.bincount(flat, minlength=256)
    up = width if height > 1 else n
    own, left, top = _entropy(counts), _entropy(np.bincount(flat[1:] - flat[:-1])), _entropy(np.bincount(flat[up:] - flat[:-up]))
    colours = int((counts > 0).sum())
    packed = _index_bits(colours)
    costs = {
        # Red and blue vanish; the deltas are one small image.
        "cross": n * own + 4 * TILE_COST,
        # Few colours share a pixel, and runs of them a symbol.
        "palette": n * own * (0.9 if packed else 1) + colours * COLOUR_COST,
        # A colour's first pixel takes three symbols, all others a hit.
        "cache": n * own + colours * 8,
        "predictor": n * min(left, top if height > 1 else left) + (_parts(height, TILE) * _parts(width, TILE) + 4) * TILE_COST,
    }
    best = min(costs, key=costs.get)
    out = {"references": True, "tile": TILE}
    if best == "palette":
        return out | {"transforms": (COLOUR_INDEXING,)}
    if best == "cache":
        return out | {"cache_bits": CACHE_BITS}
    if best == "predictor":
        return out | {"transforms": (PREDICTOR, CROSS_COLOUR), "modes": _modes(_grey(grey)), "cross": GREY}
    return out | {"transforms": (CROSS_COLOUR,), "cross": GREY}


def _grey(samples: np.ndarray) -> np.ndarray:
    return samples.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)


def _modes(argb: np.ndarray) -> np.ndarray:
    """For each tile the predictor mode that leaves the smallest rests."""
    height, width = argb.shape
    image, costs = _channels(argb), []
    for mode in MODES:
        rest = abs(((image - _guess(image, mode) + 128) & 255) - 128).sum(axis=-1)
        padded = np.pad(rest, ((0, -height % (1 << TILE)), (0, -width % (1 << TILE))))
        costs.append(padded.reshape(_parts(height, TILE), 1 << TILE, -1, 1 << TILE).sum(axis=(1, 3)))
    return np.array(MODES)[np.argmin(costs, axis=0)].ravel()


# ---------------------------------------------------------------- media columns


#: Samples that are written or read together.
STEP = 1 << 17


def _steps(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of items of about ``limit`` together, one item at least."""
    out, begin, total = [], 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= limit or k + 1 == len(sizes):
            out.append((begin, k + 1))
            begin, total = k + 1, 0
    return out


def store(payload: bytes, row: int = ROW) -> bytes:
    """Bytes (whole rows) as grey samples of one or more files."""
    return store_all([payload], row)[0]


def store_all(payloads: list[bytes], row: int = ROW) -> list[bytes]:
    """Payloads to stored files, several at once."""
    samples = [np.frombuffer(x, np.uint8).reshape(-1, row) for x in payloads]
    images = [(i, x[k : k + MAX_ROWS]) for i, x in enumerate(samples) for k in range(0, len(x), MAX_ROWS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _steps([x.size for _, x in images], STEP):
        for (i, _), file in zip(images[a:b], finish([begin(_grey(x), **plan(x)) for _, x in images[a:b]]), strict=True):
            out[i].append(file)
    return [b"".join(x) for x in out]


def load(stored: bytes) -> np.ndarray:
    """Stored files to samples (rows, row)."""
    return load_all([stored])[0]


def load_all(stored: list[bytes]) -> list[np.ndarray]:
    """Stored files to samples, several at once."""
    files = []
    for i, x in enumerate(stored):
        at = 0
        while at < len(x):
            n = 8 + struct.unpack_from("<I", x, at + 4)[0]
            files.append((i, x[at : at + n]))
            at += n
    out: list[list[np.ndarray]] = [[] for _ in stored]
    for a, b in _steps([len(x) for _, x in files], STEP // 2):
        for (i, _), image in zip(files[a:b], decode_all([x for _, x in files[a:b]]), strict=True):
            out[i].append((image >> np.uint32(8)).astype(np.uint8))
    return [x[0] if len(x) == 1 else np.vstack(x) for x in out]


def feature(samples: np.ndarray) -> str:
    """A 64-bit difference hash of row-block means, with mean and spread of the samples."""
    h, w = samples.shape
    sums = samples.sum(axis=0, dtype=np.int64)
    columns = sums.reshape(64, -1).sum(axis=1) if w % 64 == 0 else sums
    bits = "".join("1" if b else "0" for b in (columns > np.append(columns[-1:], columns[:-1])).tolist())
    mean = sums.sum() / samples.size
    return f"{int(bits, 2):016x}:{mean:.4f}"


def media_row(text: str | None) -> tuple:
    """The columns of one text, from the bytes read back."""
    return media_rows([text])[0]


def media_rows(texts: list[str | None]) -> list[tuple]:
    """The columns of texts, from the bytes read back; no text's depend on the others."""
    raws = [(t or "").encode() for t in texts]
    stored = store_all([x + b"\xff" * (-len(x) % ROW or (0 if x else ROW)) for x in raws])
    rows = []
    for raw, media, samples in zip(raws, stored, load_all(stored), strict=True):
        back = samples.tobytes()
        rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
    return rows


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text as stored media, read back: one row per document."""
    kind = dict(docs.dtypes)[doc_id]
    columns = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches):
        known: dict = {}  # of the task's last texts, by digest
        for batch in batches:
            if len(known) >= 20_000:
                known.clear()
            texts = batch.column(1).to_pylist()
            names = [hashlib.sha256((t or "").encode()).digest() for t in texts]
            new = {name: t for name, t in zip(names, texts, strict=True) if name not in known}
            known.update(zip(new, media_rows(list(new.values())), strict=True))
            rows = [known[name] for name in names]
            values = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in columns[1:]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(values, types, strict=True))], columns)

    small_batches(docs.sparkSession, 256)
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
