"""Progressive JPEG (8 bit, one or three components of any sampling and size) on numpy, for many images at once.

Entropy-coded data cannot be cut up without markers, so scans carry restart
intervals, and the decoder walks all intervals of all images of a batch in
lockstep: each step decodes one symbol of every interval with array operations.
Scans fill coefficient arrays bit by bit (spectral selection and successive
approximation, DC and AC, first and refining); the inverse transform, chroma
upsampling and colour conversion are exact integer arithmetic, so equal files
give equal pixels in whatever batch they come. A file without restart markers is
one interval: it is as many images a batch that make it fast then.

A component's blocks that its own scans cover come first, row by row, and the blocks
that only fill up the last MCUs of interleaved scans after them.
"""

from __future__ import annotations

import functools
import re
import struct
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

from .common import expand

INTERVAL = 4  # MCUs in a restart interval
PER_ROW = 256  # MCUs in a row of a wide image
# fixed values: zigzag order of ITU T.81
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
#: Components, first and last coefficient, high and low bit of each scan that encode() writes.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 5, 1, 0) for c in range(3))]
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = [*(16 * r for r in range(16)), *(16 * r + s for r in range(16) for s in range(1, 11))]


def canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as a DHT segment defines them."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code += 1
            at += 1
        code <<= 1
    return out


# 4-bit codes for DC; for AC 6 bits for short runs of common sizes, 9 bits for the rest
_AC_FIRST = [0x00, *(s for s in range(1, 9)), *(0x10 + s for s in range(1, 9))]
AC_ORDER = [*_AC_FIRST, *(s for s in AC_SYMBOLS if s not in _AC_FIRST)]
DC_COUNTS = [0, 0, 0, 12] + [0] * 12
AC_COUNTS = [0] * 5 + [len(_AC_FIRST), 0, 0, len(AC_ORDER) - len(_AC_FIRST)] + [0] * 7
DC_CODES, AC_CODES = canonical(DC_COUNTS, DC_SYMBOLS), canonical(AC_COUNTS, AC_ORDER)


def _table(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


def _lookup(codes: dict[int, tuple[int, int]]) -> np.ndarray:
    """For each 16 bits ahead: 256 * length + symbol."""
    out = np.zeros(1 << 16, np.int64)
    for s, (c, n) in codes.items():
        out[c << (16 - n) : (c + 1) << (16 - n)] = 256 * n + s
    return out


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


@dataclass(frozen=True)
class Shape:
    """MCU grid of an image, its pixels (whole MCUs where not given), and horizontal and vertical sampling of each component."""

    across: int
    down: int
    height: int = 0
    width: int = 0
    sampling: tuple = ((2, 2), (1, 1), (1, 1))

    @property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.sampling), max(v for _, v in self.sampling)

    @property
    def size(self) -> tuple[int, int]:
        """Height and width in pixels."""
        h, v = self.most
        return self.height or 8 * v * self.down, self.width or 8 * h * self.across

    @property
    def blocks(self) -> tuple[int, ...]:
        return tuple(self.across * self.down * h * v for h, v in self.sampling)

    @property
    def own(self) -> tuple[tuple[int, int], ...]:
        """Rows and columns of each component's blocks that hold pixels."""
        (hm, vm), (height, width) = self.most, self.size
        return tuple((-(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)) for h, v in self.sampling)

    @property
    def pattern(self) -> tuple[int, ...]:
        """The component of each block of an interleaved MCU."""
        return tuple(c for c, (h, v) in enumerate(self.sampling) for _ in range(h * v))


def shape_of(height: int, width: int, sampling: tuple) -> Shape:
    h, v = max(x for x, _ in sampling), max(x for _, x in sampling)
    return Shape(-(-width // (8 * h)), -(-height // (8 * v)), height, width, sampling)


def shape_for(blocks: int) -> Shape:
    """A 4:2:0 grid that has room for so many blocks."""
    mcus = max(1, -(-blocks // 6))
    across = min(mcus, PER_ROW)
    return Shape(across, -(-mcus // across))


def places(s: Shape, c: int) -> np.ndarray:
    """Where the blocks of a component's grid, filling ones included, are stored."""
    h, v = s.sampling[c]
    rows, cols = s.own[c]
    inside = np.zeros((s.down * v, s.across * h), bool)
    inside[:rows, :cols] = True
    out = np.empty(inside.shape, np.int64)
    out[inside] = np.arange(rows * cols)
    out[~inside] = np.arange(rows * cols, inside.size)
    return out


def _mcu_rows(s: Shape) -> np.ndarray:
    my, mx = np.divmod(np.arange(s.across * s.down), s.across)
    grids = [places(s, c) for c in range(len(s.sampling))]
    return np.stack([g[v * my + j, h * mx + i] for g, (h, v) in zip(grids, s.sampling) for j in range(v) for i in range(h)], 1)


_small_mcu_rows = functools.lru_cache(maxsize=512)(_mcu_rows)


def mcu_rows(s: Shape) -> np.ndarray:
    """(MCUs, blocks of one): in MCU order the places of its blocks in their components."""
    return (_small_mcu_rows if s.across * s.down <= 4096 else _mcu_rows)(s)


def _bases(shapes: list[Shape]) -> list[np.ndarray]:
    """For three components (none have no blocks) where each image's blocks start, end to end."""
    return [np.append(0, np.cumsum([s.blocks[c] if c < len(s.sampling) else 0 for s in shapes], dtype=np.int64)) for c in range(3)]


def _units(shapes: list[Shape]) -> list[np.ndarray]:
    """For three components the blocks of each image that the component's own scans cover."""
    return [np.asarray([s.own[c][0] * s.own[c][1] if c < len(s.sampling) else 0 for s in shapes], np.int64) for c in range(3)]


# encoding


def _pack(interval: np.ndarray, bits: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings in order, each interval filled up with ones to whole bytes. Bytes and n + 1 offsets."""
    total = np.bincount(interval, length, n).astype(np.int64)
    pad = -total % 8
    size = (total + pad) // 8
    off = np.append(0, np.cumsum(size))
    first = np.searchsorted(interval, np.arange(n))
    run = np.append(0, np.cumsum(length))
    pos = run[:-1] - run[first][interval] + 8 * off[interval]
    pos = np.concatenate([pos, 8 * off[:-1] + total])
    bits = np.concatenate([bits, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)])
    length = np.concatenate([length, pad])
    word = pos >> 5
    x = bits << (64 - (pos & 31) - length).astype(np.uint64) if len(bits) else bits
    x[length == 0] = 0
    m = int(off[-1]) // 4 + 3
    words = np.bincount(word, (x >> np.uint64(32)).astype(np.float64), m) + np.bincount(word + 1, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), m)
    return np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: off[-1]], off


def _framed(data: np.ndarray, off: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero bytes after 255, and restart markers after all intervals but an image's last."""
    full = data == 255
    before = np.append(0, np.cumsum(full))
    stuffed = np.repeat(data, 1 + full)
    at = np.flatnonzero(full)
    stuffed[at + np.arange(len(at)) + 1] = 0
    size = np.diff(off) + np.diff(before[off])
    room = size + 2 * ~last
    where = np.append(0, np.cumsum(room))
    out = np.zeros(where[-1], np.uint8)
    out[expand(where[:-1], size)] = stuffed
    mark = where[1:][~last]
    out[mark - 2], out[mark - 1] = 255, 0xD0 + number[~last] % 8
    return out, where


def _intervals(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of images with so many MCUs: image, number in it, whether its last, and MCUs of each interval."""
    per = -(-counts // INTERVAL)
    image = np.repeat(np.arange(len(counts)), per)
    number = expand(np.zeros(len(counts), np.int64), per)
    last = number == per[image] - 1
    return image, number, last, np.where(last, counts[image] - number * INTERVAL, INTERVAL)


def _ac_first(c: np.ndarray, lo: int, hi: int, al: int):
    code, width = _table(AC_CODES)
    v = c[:, lo : hi + 1].astype(np.int64)
    v = np.sign(v) * (np.abs(v) >> al)
    row, k = np.nonzero(v)
    w = v[row, k]
    prev = np.where(np.append(True, row[1:] != row[:-1])[: len(row)], -1, np.append(0, k[:-1])[: len(k)])
    run = k - prev - 1
    size = _size(w)
    sym = 16 * (run & 15) + size
    key = (row * 65 + k) * 2 + 1
    bits = (code[sym] << size.astype(np.uint64)) | _extra(w, size)
    length = width[sym] + size
    long = np.flatnonzero(run > 15)
    zrl = np.repeat(long, run[long] >> 4)
    end = np.full(len(v), -1)
    end[row] = k
    eob = np.flatnonzero(end < hi - lo)
    rows = np.concatenate([row, row[zrl], eob])
    keys = np.concatenate([key, key[zrl] - 1, (eob * 65 + 64) * 2])
    order = np.argsort(keys, kind="stable")
    ones = lambda n, s: (np.full(n, code[s], np.uint64), np.full(n, width[s]))
    (zb, zl), (eb, el) = ones(len(zrl), 0xF0), ones(len(eob), 0)
    return rows[order], np.concatenate([bits, zb, eb])[order], np.concatenate([length, zl, el])[order]


def _ac_refine(c: np.ndarray, lo: int, hi: int, al: int):
    """Bands of at most 15 coefficients."""
    code, width = _table(AC_CODES)
    v = c[:, lo : hi + 1].astype(np.int64)
    n, m = v.shape
    a = np.abs(v) >> al
    new, old, zero = a == 1, a > 1, a == 0
    # zeros since the last new coefficient, and the next new one (m where none follows)
    run, last = np.zeros((n, m), np.int64), np.zeros(n, np.int64)
    for k in range(m):
        run[:, k] = last
        last = np.where(new[:, k], 0, last + zero[:, k])
    nxt, cur = np.full((n, m), m), np.full(n, m)
    for k in range(m - 1, -1, -1):
        nxt[:, k] = cur
        cur = np.where(new[:, k], k, cur)
    row, k = np.nonzero(new)
    sym = 16 * run[row, k] + 1
    bits, length = (code[sym] << np.uint64(1)) | (v[row, k] > 0).astype(np.uint64), width[sym] + 1
    orow, ok = np.nonzero(old)
    end = np.full(n, -1)
    end[row] = k
    eob = np.flatnonzero(end < m - 1)
    span = m + 1
    keys = np.concatenate([(row * span + k) * span * 2, (orow * span + nxt[orow, ok]) * span * 2 + 1 + ok, (eob * span + m) * span * 2])
    order = np.argsort(keys, kind="stable")
    rows = np.concatenate([row, orow, eob])[order]
    allbits = np.concatenate([bits, (a[orow, ok] & 1).astype(np.uint64), np.full(len(eob), code[0], np.uint64)])[order]
    return rows, allbits, np.concatenate([length, np.ones(len(orow), np.int64), np.full(len(eob), width[0])])[order]


def _dht(kind: int, counts: list[int], symbols: list[int]) -> bytes:
    return struct.pack(">HHB16B", 0xFFC4, 19 + len(symbols), kind, *counts) + bytes(symbols)


_TABLES = struct.pack(">HHB64B", 0xFFDB, 67, 0, *([1] * 64)) + _dht(0x00, DC_COUNTS, DC_SYMBOLS) + _dht(0x10, AC_COUNTS, AC_ORDER) + struct.pack(">HHH", 0xFFDD, 4, INTERVAL)


def encode(shapes: list[Shape], coefs: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """Files for images of one sampling whose quantised coefficients (component by component, all images' blocks end to end, zigzag order) are given."""
    if len({s.sampling for s in shapes}) != 1:
        raise ValueError("images of one sampling are written at a time")
    sampling, pattern = shapes[0].sampling, shapes[0].pattern
    frame = b"".join(bytes([c + 1, 16 * h + v, 0]) for c, (h, v) in enumerate(sampling))
    files = [[b"\xff\xd8" + struct.pack(">HH", 0xFFFE, 2 + len(t)) + t + _TABLES + struct.pack(">HHBHHB", 0xFFC2, 8 + len(frame), 8, *s.size, len(sampling)) + frame] for s, t in zip(shapes, comments)]
    bases, units = _bases(shapes), _units(shapes)
    own = [expand(b[:-1], u) if u.sum() < b[-1] else None for b, u in zip(bases, units)]
    mcus = np.asarray([s.across * s.down for s in shapes], np.int64)
    order = [mcu_rows(s) for s in shapes]
    for comps, lo, hi, ah, al in SCANS:
        comps = comps[: len(sampling)] if lo == 0 else comps
        if comps[0] >= len(sampling):
            continue
        c = comps[0]
        image, number, last, n = _intervals(mcus if len(comps) > 1 else units[c])
        unit_iv = np.repeat(np.arange(len(image)), n)
        if lo == 0:
            cols = pattern if len(comps) > 1 else comps
            if len(comps) > 1:
                rows = np.concatenate([o + np.asarray([bases[x][i] for x in pattern]) for i, o in enumerate(order)])
            else:
                rows = (np.arange(bases[c][-1]) if own[c] is None else own[c])[:, None]
            vals = np.stack([coefs[x][rows[:, j], 0].astype(np.int64) for j, x in enumerate(cols)], 1)
            iv = np.repeat(unit_iv, len(cols))
            if ah:
                bits, length = ((vals >> al) & 1).ravel().astype(np.uint64), np.ones(vals.size, np.int64)
            else:
                code, width = _table(DC_CODES)
                vals >>= al
                new = np.append(True, unit_iv[1:] != unit_iv[:-1])
                diff = np.empty_like(vals)
                for x in comps:
                    at = [j for j, p in enumerate(cols) if p == x]
                    seq = vals[:, at]
                    prev = np.concatenate([[0], seq.ravel()[:-1]]).reshape(seq.shape)
                    prev[new, 0] = 0
                    diff[:, at] = seq - prev
                d = diff.ravel()
                size = _size(d)
                bits, length = (code[size] << size.astype(np.uint64)) | _extra(d, size), width[size] + size
        else:
            row, bits, length = (_ac_refine if ah else _ac_first)(coefs[c] if own[c] is None else coefs[c][own[c]], lo, hi, al)
            iv = unit_iv[row]
        data, off = _pack(iv, bits, length, len(image))
        data, off = _framed(data, off, last, number)
        raw = data.tobytes()
        head = struct.pack(">HHB", 0xFFDA, 6 + 2 * len(comps), len(comps)) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([lo, hi, 16 * ah + al])
        ends = off[1:][last].tolist()
        for f, a, z in zip(files, [0, *ends], ends):
            f.append(head)
            f.append(raw[a:z])
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


# decoding


@dataclass
class Header:
    shape: Shape = None
    quant: dict = field(default_factory=dict)
    comment: bytes = b""
    comp_quant: list = field(default_factory=list)
    transformed: bool = True  # luma and chroma, not red, green and blue
    scans: list = field(default_factory=list)  # (comps, lo, hi, ah, al, interval, tables, start, end)


_NEXT = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)


def parse(data: bytes) -> Header:
    """Marker segments of a progressive file of one or three components; ValueError for anything else."""
    try:
        return _parse(data)
    except (IndexError, KeyError, AttributeError, TypeError, struct.error) as e:
        raise ValueError("broken JPEG file") from e


def _parse(data: bytes) -> Header:
    h, at, tables, interval, names, adobe = Header(), 2, {}, 0, [], None
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        mark = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("broken JPEG file")
        if mark == 0xD9:
            if h.shape is None or any(q not in h.quant for q in h.comp_quant):
                raise ValueError("no frame, or no quantisation table of it")
            h.transformed = adobe != 0 if adobe is not None else names != [82, 71, 66]
            return h
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) < size - 2:
            raise ValueError("broken JPEG file")
        at += 2 + size
        if mark == 0xFE:
            h.comment = body
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                h.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark == 0xDD:
            interval = int.from_bytes(body, "big")
        elif mark == 0xC2:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            sampling = tuple((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n))
            if bits != 8 or n not in (1, 3) or not height or not width or not all(a and b for a, b in sampling):
                raise ValueError("only 8-bit frames of one or three components and a stated size are read here")
            if n == 1:
                sampling = ((1, 1),)  # factors mean nothing where there is nothing to compare with
            if any(max(x[k] for x in sampling) % y[k] for y in sampling for k in (0, 1)):
                raise ValueError("sampling factors that do not divide the largest")
            h.shape = shape_of(height, width, sampling)
            names = [body[6 + 3 * i] for i in range(n)]
            h.comp_quant = [body[8 + 3 * i] for i in range(n)]
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not a progressive Huffman file")
        elif mark == 0xDA:
            n = body[0]
            comps = tuple(names.index(body[1 + 2 * i]) for i in range(n))
            sel = [body[2 + 2 * i] for i in range(n)]
            lo, hi, ahl = body[1 + 2 * n : 4 + 2 * n]
            if hi > 63 or lo > hi or (lo > 0 and n > 1) or list(comps) != sorted(set(comps)) or (lo == 0 and hi > 0):
                raise ValueError("a scan that progressive files cannot have")
            end = _NEXT.search(data, at).start()
            used = tuple(None if lo == 0 and ahl >> 4 else tables[s >> 4 if lo == 0 else 0x10 | (s & 15)] for s in sel)
            h.scans.append((comps, lo, hi, ahl >> 4, ahl & 15, interval, used, at, end))
            at = end


class Bits:
    """Streams without stuffing, end to end; each has a bit position."""

    def __init__(self, parts: list[bytes]):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        keep = np.ones(len(raw), bool)
        keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 255))
        mark = np.zeros(len(raw), bool)  # restart markers
        mark[:-1] = (raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)
        keep[mark] = False
        keep[1:] &= ~mark[:-1]
        place = np.append(0, np.cumsum(keep))
        at = np.flatnonzero(mark)
        part_starts = np.cumsum(size) - size
        starts = np.sort(np.concatenate([part_starts, at + 2]))
        self.part = np.searchsorted(part_starts, starts, "right") - 1
        self.starts = 8 * place[starts]
        data = np.concatenate([raw[keep], np.full(16, 255, np.uint8)])
        self.ahead = np.ndarray((len(data) - 8,), ">u8", data.tobytes(), 0, (1,)).astype(np.uint64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The 57 bits or more that follow, at the top of 64."""
        return self.ahead[pos >> 3] << (pos & 7).astype(np.uint64)


def _value(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value whose `size` extra bits are at the top of x."""
    e = ((x >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where((e >> np.maximum(size - 1, 0)) == 0, e - (1 << size) + 1, e)


def _decode_dc(b: Bits, rows: np.ndarray, count: np.ndarray, pattern, coefs, luts, ah: int, al: int) -> None:
    """rows: (streams, MCUs, blocks of an MCU); count: MCUs of each stream."""
    pos = b.starts.copy()
    pred = np.zeros((len(pos), 3), np.int64)
    for m in range(rows.shape[1]):
        live = np.flatnonzero(count > m)
        for j, c in enumerate(pattern):
            x = b.peek(pos[live])
            at = rows[live, m, j]
            if ah:
                coefs[c][at, 0] |= ((x >> np.uint64(63)).astype(np.int64) << al).astype(coefs[c].dtype)
                pos[live] += 1
                continue
            hit = luts[c][(x >> np.uint64(48)).astype(np.int64)]
            width, size = hit >> 8, hit & 255
            diff = np.where(size > 0, _value(x << width.astype(np.uint64), size), 0)
            pred[live, c] += diff
            coefs[c][at, 0] = pred[live, c] << al
            pos[live] += width + size


def _decode_ac_first(b: Bits, row: np.ndarray, count: np.ndarray, out: np.ndarray, lut: np.ndarray, lo: int, hi: int, al: int) -> None:
    """row: first block of each stream; count: its blocks."""
    pos, stop = b.starts.copy(), row + count
    row = row.copy()
    k = np.full(len(pos), lo)
    flat = out.reshape(-1)
    while len(pos):
        x = b.peek(pos)
        hit = lut[(x >> np.uint64(48)).astype(np.int64)]
        width, run, size = hit >> 8, (hit >> 4) & 15, hit & 15
        x <<= width.astype(np.uint64)
        coded = size > 0
        k += np.where(coded | (run == 15), run, 0)
        v = _value(x, size) << al
        at = np.flatnonzero(coded) if not coded.all() else slice(None)
        flat[row[at] * 64 + k[at]] = v[at]
        pos += width + size
        k += 1
        ended = k > hi
        eob = np.flatnonzero(~coded & (run < 15))
        if len(eob):
            r = run[eob]
            more = ((x[eob] >> np.uint64(1)) >> (63 - r).astype(np.uint64)).astype(np.int64)
            row[eob] += (1 << r) + more - 1
            pos[eob] += r
            ended[eob] = True
        row += ended
        k[ended] = lo
        live = row < stop
        if not live.all():
            pos, row, stop, k = pos[live], row[live], stop[live], k[live]


def _decode_ac_refine(b: Bits, row: np.ndarray, count: np.ndarray, out: np.ndarray, lut: np.ndarray, lo: int, hi: int, al: int) -> None:
    pos, stop = b.starts.copy(), row + count
    row = row.copy()
    k = np.full(len(pos), lo)
    run, fresh, eob = (np.zeros(len(pos), np.int64) for _ in range(3))
    ask = np.ones(len(pos), bool)
    flat = out.reshape(-1)
    while len(pos):
        at = np.flatnonzero(ask)
        if len(at):
            x = b.peek(pos[at])
            hit = lut[(x >> np.uint64(48)).astype(np.int64)]
            width, r, s = hit >> 8, (hit >> 4) & 15, hit & 15
            x <<= width.astype(np.uint64)
            ends = (s == 0) & (r < 15)
            more = ((x >> np.uint64(1)) >> (63 - r).astype(np.uint64)).astype(np.int64)
            eob[at] = np.where(ends, (1 << r) + more, 0)
            fresh[at] = np.where(s > 0, np.where(x >> np.uint64(63), 1, -1), 0)
            run[at] = r
            pos[at] += width + np.where(ends, r, np.where(s > 0, 1, 0))
            ask[at] = False
        cell = row * 64 + k
        now = flat[cell].astype(np.int64)
        old = now != 0
        bit = (b.peek(pos) >> np.uint64(63)).astype(np.int64)
        pos += old
        place = ~old & (eob == 0) & (run == 0)
        flat[cell] = np.where(old, now + np.sign(now) * (bit << al), np.where(place, fresh << al, 0))
        ask |= place
        run -= ~old & (eob == 0) & ~place
        k += 1
        done = k > hi
        row += done
        k[done] = lo
        was = eob > 0
        eob -= done & was
        ask |= done & (eob == 0)
        live = row < stop
        if not live.all():
            pos, row, stop, k, run, fresh, eob, ask = (a[live] for a in (pos, row, stop, k, run, fresh, eob, ask))


def decode(files: list[bytes]) -> tuple[list[Header], list[np.ndarray], list[np.ndarray]]:
    """Headers, three coefficient arrays of all images end to end, and each image's n + 1 offsets in them (grey ones have no blocks in two)."""
    heads = [parse(f) for f in files]
    shapes = [h.shape for h in heads]
    mcus = np.asarray([s.across * s.down for s in shapes], np.int64)
    bases, own = _bases(shapes), _units(shapes)
    coefs = [np.zeros((int(x[-1]) + 1, 64), np.int16) for x in bases]
    for turn in range(max((len(h.scans) for h in heads), default=0)):
        groups = defaultdict(list)
        for i, h in enumerate(heads):
            if turn < len(h.scans):
                groups[(*h.scans[turn][:7], h.shape.pattern)].append(i)
        for (comps, lo, hi, ah, al, interval, tables, blocks), who in groups.items():
            b = Bits([files[i][heads[i].scans[turn][7] : heads[i].scans[turn][8]] for i in who])
            luts = {c: _lookup(canonical(list(t[0]), list(t[1]))) if t else None for c, t in zip(comps, tables)}
            ids = np.asarray(who)
            image = ids[b.part]
            first = np.searchsorted(b.part, np.arange(len(who)))
            number = np.arange(len(b.part)) - first[b.part]
            units = mcus if len(comps) > 1 else own[comps[0]]
            step = interval or int(units[ids].max())
            count = np.minimum(step, units[image] - number * step)
            if count.min() <= 0:
                raise ValueError("more restart markers than intervals")
            if lo == 0:
                pattern = [c for c in blocks if c in comps] if len(comps) > 1 else list(comps)
                if len(comps) > 1:
                    cols = [j for j, c in enumerate(blocks) if c in comps]
                    grid = np.concatenate([mcu_rows(heads[i].shape)[:, cols] + np.asarray([bases[c][i] for c in pattern]) for i in who])
                    start = (np.cumsum(mcus[ids]) - mcus[ids])[b.part] + number * step
                else:
                    grid, start = np.arange(len(coefs[comps[0]]))[:, None], bases[comps[0]][image] + number * step
                most = int(count.max())
                rows = grid[np.minimum(start[:, None] + np.arange(most), len(grid) - 1)]
                _decode_dc(b, rows, count, pattern, coefs, luts, ah, al)
            else:
                c = comps[0]
                row = bases[c][image] + number * step
                (_decode_ac_refine if ah else _decode_ac_first)(b, row, count, coefs[c], luts[c], lo, hi, al)
    return heads, [c[:-1] for c in coefs], bases


_BITS = 12
_BASIS = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * (1 << _BITS))


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples of 0 to 255. The basis is scaled to integers, and float64 holds all sums of them exactly."""
    c = np.zeros((len(coefs), 64))
    c[:, ZIGZAG] = coefs.astype(np.int64) * quant
    s = _BASIS.T @ c.reshape(-1, 8, 8) @ _BASIS
    return np.clip(np.floor(s / (1 << 2 * _BITS) + 0.5) + 128, 0, 255).astype(np.uint8)


def plane(blocks: np.ndarray, across: int) -> np.ndarray:
    down = len(blocks) // across
    return blocks.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)


def rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB from planes of full resolution, in 16-bit fixed point."""
    y = y.astype(np.int32) << 16
    u, v = (p.astype(np.int32) - 128 for p in (cb, cr))
    half = 1 << 15
    # fixed values: JFIF's conversion, times 65536
    return np.clip(np.stack([y + 91881 * v, y - 22554 * u - 46802 * v, y + 116130 * u], 2) + half >> 16, 0, 255).astype(np.uint8)


def pixels(heads: list[Header], coefs: list[np.ndarray], bases: list[np.ndarray]) -> list[np.ndarray]:
    """Each image's RGB tensor in full resolution: components of lower sampling are repeated; a grey one is three equal channels."""
    out = []
    same = all(np.array_equal(h.quant[q], heads[0].quant[heads[0].comp_quant[0]]) for h in heads for q in h.comp_quant)
    whole = [samples(c, heads[0].quant[heads[0].comp_quant[0]]) for c in coefs] if same and heads else None
    for i, h in enumerate(heads):
        p, (hm, vm), (height, width) = [], h.shape.most, h.shape.size
        for c, ((rows, cols), (x, y)) in enumerate(zip(h.shape.own, h.shape.sampling)):
            a = bases[c][i]
            z = a + rows * cols
            full = plane(whole[c][a:z] if same else samples(coefs[c][a:z], h.quant[h.comp_quant[c]]), cols)
            p.append(full.repeat(vm // y, 0).repeat(hm // x, 1)[:height, :width])
        out.append(rgb(*p) if len(p) == 3 and h.transformed else np.stack(p if len(p) == 3 else p * 3, 2))
    return out
