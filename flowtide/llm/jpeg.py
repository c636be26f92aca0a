"""Progressive JPEG in numpy: many small images are written and read in lockstep.

An image holds three components (luma twice as wide and high as chroma). Its coefficients are sent in scans: spectral selection
cuts a block's 64 coefficients into bands, successive approximation sends their high bits first and refines them later. The
decoder accumulates all scans into coefficient arrays, inverse-transforms them by one exact integer matrix product, upsamples
chroma and converts to RGB. Restart intervals are lanes that advance together, one numpy operation for all lanes of a group of
images, so entropy decoding costs no Python step per symbol. Any Huffman tables, bands, restart intervals and end-of-band runs
are read; the encoder writes a restart interval of one unit, which keeps all lanes short.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: Blocks of one coded unit: four of luma, one of each chroma.
UNIT = 6
MAX_UNITS_HIGH = 4095
#: Scans written for each image: (first, last coefficient, high bit before, low bit); None: all components interleaved.
SCRIPT = [(0, 0, 0, 1, None), *[(1, 5, 0, 1, c) for c in range(3)], *[(6, 63, 0, 0, c) for c in range(3)], *[(1, 5, 1, 0, c) for c in range(3)], (0, 0, 1, 0, None)]
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


@cache
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    return np.array(order)


@cache
def idct_matrix() -> np.ndarray:
    """[zigzag coefficient, pixel], scaled by 2^14 to whole numbers, so that products are exact in any order."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)  # [pixel, frequency]
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return np.round(full[zigzag()] * 2**14)


def canonical(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each of 256 symbols from a table's counts by length."""
    code, at = 0, 0
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            codes[s], lengths[s] = code, n
            code += 1
        at += count
        code <<= 1
    return codes, lengths


@cache
def lookup(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each 16-bit prefix."""
    codes, lengths = canonical(spec[:16], spec[16:])
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s in spec[16:]:
        n = int(lengths[s])
        lo = int(codes[s]) << (16 - n)
        symbol[lo : lo + (1 << (16 - n))] = s
        length[lo : lo + (1 << (16 - n))] = n
    return symbol, length


def _table(by_length: dict[int, list[int]]) -> bytes:
    return bytes(len(by_length.get(n, ())) for n in range(1, 17)) + b"".join(bytes(by_length[n]) for n in sorted(by_length))


#: Tables of the encoder: 4-bit codes for differences; short codes for the sizes that text bytes have.
DC_TABLE = _table({4: list(range(12))})
_SHORT = {2: [0x06, 0x07], 4: [0x05], 5: [0x08], 6: [0x00]}
AC_TABLE = _table({**_SHORT, 9: [r << 4 | s for r in range(16) for s in range(11) if r << 4 | s not in {x for v in _SHORT.values() for x in v} and (s or r in (0, 15))]})


def bit_size(a: np.ndarray) -> np.ndarray:
    """Bits of non-negative whole numbers."""
    return np.ceil(np.log2(a + 1.0)).astype(np.int64)


class _Writer:
    """Bits of many lanes at once."""

    def __init__(self, lanes: int, most_bits: int) -> None:
        self.width = most_bits // 8 + 4
        self.buffer = np.zeros(lanes * self.width, np.uint8)
        self.base = np.arange(lanes) * self.width
        self.at = np.zeros(lanes, np.int64)

    def put(self, value: np.ndarray, length: np.ndarray, lanes: np.ndarray | slice = slice(None)) -> None:
        """Append ``length`` (at most 17) bits to each lane."""
        at = self.at[lanes]
        v = value << (24 - length - (at & 7))
        place = self.base[lanes] + (at >> 3)
        for k, shift in enumerate((16, 8, 0)):
            self.buffer[place + k] |= ((v >> shift) & 255).astype(np.uint8)
        self.at[lanes] = at + length

    def done(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stuffed bytes with restart marks, and where each lane starts in them. first: number of each lane in its scan."""
        pad = -self.at & 7
        self.put((1 << pad) - 1, pad)
        sizes = self.at >> 3
        flat = self.buffer.reshape(-1, self.width)[np.arange(self.width) < sizes[:, None]]
        lane_end = np.cumsum(sizes)
        grow = 1 + (flat == 255)
        marks = (first > 0).astype(np.int64) * 2  # a mark stands before each lane but a scan's first
        start_of = np.repeat(np.cumsum(marks), sizes)
        place = np.cumsum(grow) - grow + start_of
        total = int(grow.sum() + marks.sum())
        out = np.zeros(total, np.uint8)
        out[place] = flat
        grown = np.concatenate([[0], np.cumsum(grow)])
        lane_start = grown[lane_end - sizes] + np.cumsum(marks) - marks
        marked = np.flatnonzero(marks)
        out[lane_start[marked]] = 255
        out[lane_start[marked] + 1] = 0xD0 + (first[marked] - 1) % 8
        return out, np.append(lane_start, total)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _write_dc(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = canonical(DC_TABLE[:16], DC_TABLE[16:])
    w = _Writer(len(values), UNIT * 16)
    for j in range(UNIT):
        diff = values[:, j] - (values[:, j - 1] if j in (1, 2, 3) else 0)
        size = bit_size(np.abs(diff))
        w.put(codes[size] << size | _extra(diff, size), lengths[size] + size)
    return w.done(first)


def _write_dc_bits(bits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = _Writer(len(bits), UNIT)
    for j in range(UNIT):
        w.put(bits[:, j], np.ones(len(bits), np.int64))
    return w.done(first)


def _write_ac(c: np.ndarray, lo: int, hi: int, low: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = canonical(AC_TABLE[:16], AC_TABLE[16:])
    w = _Writer(len(c), (hi - lo + 2) * 17)
    run = np.zeros(len(c), np.int64)
    for k in range(lo, hi + 1):
        v = c[:, k].astype(np.int64)
        a = np.abs(v) >> low
        some = a > 0
        while (far := np.flatnonzero(some & (run > 15))).size:
            w.put(np.full(far.size, codes[0xF0]), np.full(far.size, lengths[0xF0]), far)
            run[far] -= 16
        size = bit_size(a)
        symbol = (run & 15) << 4 | size
        value = codes[symbol] << size | _extra(np.sign(v) * a, size)
        w.put(np.where(some, value, 0), np.where(some, lengths[symbol] + size, 0))
        run = np.where(some, 0, run + 1)
    w.put(np.where(run > 0, codes[0], 0), np.where(run > 0, lengths[0], 0))
    return w.done(first)


def _write_ac_bits(c: np.ndarray, lo: int, hi: int, low: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if hi - lo > 6:
        raise ValueError("refined bands hold 7 coefficients at most")
    codes, lengths = canonical(AC_TABLE[:16], AC_TABLE[16:])
    w = _Writer(len(c), (hi - lo + 2) * 17)
    zero = np.zeros(len(c), np.int64)
    run, late, n_late = zero, zero, zero
    for k in range(lo, hi + 1):
        v = c[:, k].astype(np.int64)
        a = np.abs(v) >> low
        old, new = a > 1, a == 1
        late, n_late = np.where(old, late << 1 | (a & 1), late), n_late + old
        symbol = run << 4 | 1
        value = ((codes[symbol] << 1 | (v > 0)) << n_late) | late
        w.put(np.where(new, value, 0), np.where(new, lengths[symbol] + 1 + n_late, 0))
        run = np.where(new, 0, run + ~old)
        late, n_late = np.where(new, 0, late), np.where(new, 0, n_late)
    end = (run > 0) | (n_late > 0)
    w.put(np.where(end, codes[0] << n_late | late, 0), np.where(end, lengths[0] + n_late, 0))
    return w.done(first)


def shape_of(n_blocks: int) -> tuple[int, int]:
    """Units across and down of an image with room for so many blocks."""
    units = max(1, -(-n_blocks // UNIT))
    across = -(-units // MAX_UNITS_HIGH)
    return across, -(-units // across)


def _lanes(across: int, down: int) -> list[np.ndarray]:
    """For each component, the number (in unit order) of its blocks in raster order."""
    y, x = np.divmod(np.arange(across * down * 4), across * 2)
    luma = ((y // 2) * across + x // 2) * UNIT + (y % 2) * 2 + x % 2
    units = np.arange(across * down) * UNIT
    return [luma, units + 4, units + 5]


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([255, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(across: int, down: int, note: bytes) -> bytes:
    parts = [b"\xff\xd8", _segment(0xFE, note), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    frame = b"\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
    parts += [_segment(0xC2, frame), _segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE), _segment(0xDD, b"\x00\x01")]
    return b"".join(parts)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG file for each payload (a positive multiple of 64 bytes): its bytes are the quantized coefficients."""
    shapes = [shape_of(len(p) // 64) for p in payloads]
    units = np.array([a * d for a, d in shapes])
    blocks = np.zeros((int(units.sum()) * UNIT, 64), np.int8)
    start = np.concatenate([[0], np.cumsum(units)])
    for p, s in zip(payloads, start, strict=False):
        blocks[s * UNIT : s * UNIT + len(p) // 64] = np.frombuffer(p, np.int8).reshape(-1, 64)
    per = [[lane + s * UNIT for lane in _lanes(*shape)] for shape, s in zip(shapes, start, strict=False)]
    groups = [x for doc in per for x in doc]  # three to an image
    order = np.concatenate(groups)
    lane_at = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    number = np.arange(len(order)) - np.repeat(lane_at[:-1], np.diff(lane_at))
    unit_number = np.arange(int(start[-1])) - np.repeat(start[:-1], units)
    c = blocks[order]
    dc = blocks[:, 0].astype(np.int64).reshape(-1, UNIT)
    made: dict[tuple, tuple[bytes, np.ndarray]] = {}
    for lo, hi, before, low, component in SCRIPT:
        if (lo, hi, before, low) not in made:
            if component is None:
                out, at = _write_dc_bits(dc >> low & 1, unit_number) if before else _write_dc(dc >> low, unit_number)
            else:
                out, at = (_write_ac_bits if before else _write_ac)(c, lo, hi, low, number)
            made[lo, hi, before, low] = out.tobytes(), at
    files = []
    for i, (p, shape) in enumerate(zip(payloads, shapes, strict=True)):
        parts = [_head(*shape, b"payload %d" % len(p))]
        for lo, hi, before, low, component in SCRIPT:
            out, at = made[lo, hi, before, low]
            if component is None:
                parts.append(_segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00" + bytes([lo, hi, before << 4 | low])))
                parts.append(out[at[start[i]] : at[start[i + 1]]])
            else:
                parts.append(_segment(0xDA, bytes([1, component + 1, 0, lo, hi, before << 4 | low])))
                parts.append(out[at[lane_at[i * 3 + component]] : at[lane_at[i * 3 + component + 1]]])
        files.append(b"".join([*parts, b"\xff\xd9"]))
    return files


@dataclass
class _Image:
    """What a file's headers say, and its scans."""

    note: bytes = b""
    across: int = 0
    down: int = 0
    scans: list[tuple] = field(default_factory=list)


def _parse(data: bytes) -> _Image:
    image, at, tables, interval = _Image(), 2, {}, 0
    while data[at + 1] != 0xD9:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xFE:
            image.note = body
        elif mark == 0xC2:
            high, wide = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[5] != 3 or body[7] != 0x22 or body[10] != 0x11 or body[13] != 0x11 or high % 16 or wide % 16:
                raise ValueError("only whole 4:2:0 units are read")
            image.across, image.down = wide // 16, high // 16
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif mark == 0xDD:
            interval = int.from_bytes(body, "big")
        elif mark == 0xDB and body[1:] != b"\x01" * 64:
            raise ValueError("only steps of 1 are read")
        elif mark == 0xDA:
            n = body[0]
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            component = None if n == 3 else body[1] - 1
            spec = tables.get(body[2] >> 4 if lo == 0 else 0x10 | body[2] & 15, b"")
            end = _MARKER.search(data, at).start()
            image.scans.append(((lo, hi, approx >> 4, approx & 15, component, spec, interval), data[at:end]))
            at = end
    return image


class _Reader:
    """Bits of many lanes at once."""

    def __init__(self, segments: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(segments), np.uint8)
        after = np.zeros(len(raw), bool)
        after[1:] = raw[:-1] == 255
        mark = after & (raw >= 0xD0) & (raw <= 0xD7)
        drop = (after & (raw == 0)) | mark
        drop[:-1] |= mark[1:]
        kept = np.cumsum(~drop)
        sizes = np.array([len(s) for s in segments])
        heads = np.cumsum(sizes) - sizes
        begins = np.sort(np.concatenate([heads, np.flatnonzero(mark) + 1]))
        self.lanes_of = np.bincount(np.searchsorted(heads, begins, side="right") - 1, minlength=len(segments))
        data = np.append(raw[~drop], np.zeros(8, np.uint8)).astype(np.uint32)
        self.window = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).astype(np.uint64)
        self.at = np.where(begins > 0, kept[np.maximum(begins - 1, 0)], 0).astype(np.int64) * 8

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next bits, at least 25, at the top of 32."""
        return (self.window[at >> 3].astype(np.int64) << (at & 7)) & 0xFFFFFFFF

    def bits(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self.peek(self.at[lanes]) >> (32 - n)
        self.at[lanes] += n
        return out

    def symbols(self, lanes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        prefix = self.peek(self.at[lanes]) >> 16
        self.at[lanes] += table[1][prefix]
        return table[0][prefix]


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _read_dc(r: _Reader, c: np.ndarray, rows: np.ndarray, counts: np.ndarray, heads: np.ndarray, before: int, low: int, spec: bytes) -> None:
    """rows: block numbers in coding order; lane i has counts[i] units from heads[i]."""
    table = lookup(spec) if not before else None
    last = np.zeros((len(counts), 3), np.int64)
    for j in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > j)
        for b in range(UNIT):
            block = rows[(heads[live] + j) * UNIT + b]
            if before:
                c[block, 0] |= (r.bits(live, np.ones(len(live), np.int64)) << low).astype(c.dtype)
                continue
            size = r.symbols(live, table)
            component = max(0, b - 3)
            last[live, component] += _signed(r.bits(live, size), size)
            c[block, 0] = last[live, component] << low


def _read_ac(r: _Reader, c: np.ndarray, rows: np.ndarray, counts: np.ndarray, heads: np.ndarray, lo: int, hi: int, low: int, spec: bytes) -> None:
    symbol_of, length_of = lookup(spec)
    skip = np.zeros(len(counts), np.int64)
    flat = c.reshape(-1)
    for j in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > j)
        idle = skip[live] > 0
        skip[live[idle]] -= 1
        live = live[~idle]
        place = rows[heads[live] + j] * 64
        k = np.full(len(live), lo, np.int64)
        at = r.at[live]
        while len(live):
            top = r.peek(at)
            prefix = top >> 16
            n = length_of[prefix]
            rs = symbol_of[prefix]
            size, run = rs & 15, rs >> 4
            total = n + size
            if total.max() > 25:
                v = r.peek(at + n) >> (32 - size)
            else:
                v = (top >> (32 - total)) & ((1 << size) - 1)
            at = at + total
            if size.min() > 0:  # the common case: a coefficient in each lane
                k += run
                flat[place + k] = _signed(v, size) << low
                k += 1
                on = k <= hi
            else:
                some = size > 0
                k += run
                where = np.flatnonzero(some)
                flat[place[where] + k[where]] = _signed(v[where], size[where]) << low
                k += 1
                end = ~some & (run < 15)
                if end.any():
                    stop = np.flatnonzero(end)
                    more = run[stop]
                    skip[live[stop]] = (1 << more) - 1 + (r.peek(at[stop]) >> (32 - more))
                    at[stop] += more
                on = ~end & (k <= hi)
            if not on.all():
                r.at[live] = at
                live, place, k, at = live[on], place[on], k[on], at[on]


def _read_ac_bits(r: _Reader, c: np.ndarray, rows: np.ndarray, counts: np.ndarray, heads: np.ndarray, lo: int, hi: int, low: int, spec: bytes) -> None:
    table = lookup(spec)
    skip = np.zeros(len(counts), np.int64)
    flat = c.reshape(-1)
    one = 1 << low
    for j in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > j)
        place = rows[heads[live] + j] * 64
        k = np.full(len(live), lo, np.int64)
        ending = skip[live] > 0
        reading = ~ending  # needs a symbol
        run, value = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        while len(live):
            ask = np.flatnonzero(reading)
            if len(ask):
                rs = r.symbols(live[ask], table)
                size, zeros = rs & 15, rs >> 4
                new = ask[size > 0]
                value[ask] = 0
                value[new] = np.where(r.bits(live[new], np.ones(len(new), np.int64)) > 0, one, -one)
                run[ask] = zeros
                stop = (size == 0) & (zeros < 15)
                over = ask[stop]
                skip[live[over]] = (1 << zeros[stop]) + r.bits(live[over], zeros[stop])
                ending[over] = True
                reading[ask] = False
            now = flat[place + k]
            old = np.flatnonzero(now != 0)
            bit = r.bits(live[old], np.ones(len(old), np.int64))
            v = now[old].astype(np.int64)
            flat[place[old] + k[old]] = np.where((bit > 0) & ((np.abs(v) & one) == 0), v + np.sign(v) * one, v)
            empty = (now == 0) & ~ending
            hit = np.flatnonzero(empty & (run == 0))
            flat[place[hit] + k[hit]] = value[hit]
            reading[hit] = True
            run -= empty & (run > 0)
            k += 1
            on = k <= hi
            if not on.all():
                gone = live[~on & ending]
                skip[gone] -= 1
                live, place, k, ending, reading, run, value = (x[on] for x in (live, place, k, ending, reading, run, value))


@dataclass
class Coefficients:
    """Decoded coefficients of some images: blocks in unit order, zigzag order within a block."""

    blocks: np.ndarray
    starts: np.ndarray  # first unit of each image
    shapes: list[tuple[int, int]]
    notes: list[bytes]


def decode(files: list[bytes]) -> Coefficients:
    """Read all scans of the files, scan by scan over all files that share a scan's kind."""
    images = [_parse(f) for f in files]
    shapes = [(i.across, i.down) for i in images]
    units = np.array([a * d for a, d in shapes])
    starts = np.concatenate([[0], np.cumsum(units)])
    c = np.zeros((int(starts[-1]) * UNIT, 64), np.int16)
    lanes = [_lanes(*s) for s in shapes]
    for step in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for i, image in enumerate(images):
            if step < len(image.scans):
                kinds.setdefault(image.scans[step][0], []).append(i)
        for (lo, hi, before, low, component, spec, interval), members in kinds.items():
            r = _Reader([images[i].scans[step][1] for i in members])
            if component is None:
                rows = np.concatenate([np.arange(units[i] * UNIT) + starts[i] * UNIT for i in members])
                totals = units[members]
            else:
                rows = np.concatenate([lanes[i][component] + starts[i] * UNIT for i in members])
                totals = np.array([len(lanes[i][component]) for i in members])
            # each image's coded units, cut into restart intervals
            number = np.concatenate([np.arange(n) for n in r.lanes_of])
            step_of = np.repeat(np.where(interval > 0, interval, totals), r.lanes_of)
            left = np.repeat(totals, r.lanes_of) - number * step_of
            counts = np.minimum(left, step_of)
            heads = np.cumsum(counts) - counts
            if lo == 0:
                _read_dc(r, c, rows, counts, heads, before, low, spec)
            elif before:
                _read_ac_bits(r, c, rows, counts, heads, lo, hi, low, spec)
            else:
                _read_ac(r, c, rows, counts, heads, lo, hi, low, spec)
    return Coefficients(c, starts, shapes, [i.note for i in images])


def payloads(c: Coefficients) -> list[bytes]:
    """The bytes that :func:`encode` stored."""
    flat = c.blocks.astype(np.int8).tobytes()
    return [flat[s * UNIT * 64 : s * UNIT * 64 + int(note.split()[1])] for s, note in zip(c.starts, c.notes, strict=False)]


def rgb(c: Coefficients) -> list[np.ndarray]:
    """Full-resolution [height, width, 3] tensors of 8-bit RGB."""
    pixels = np.clip(np.floor(c.blocks.astype(np.float64) @ idct_matrix() / 2**14 + 0.5) + 128, 0, 255).astype(np.int32).reshape(-1, UNIT, 8, 8)
    units = len(pixels)
    luma = pixels[:, :4].reshape(units, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(units, 16, 16)
    cb, cr = (pixels[:, b].repeat(2, axis=1).repeat(2, axis=2) - 128 for b in (4, 5))
    # fixed-point factors of the JFIF colour transform
    out = np.empty((units, 16, 16, 3), np.uint8)
    out[..., 0] = np.clip(luma + (91881 * cr + 32768 >> 16), 0, 255)
    out[..., 1] = np.clip(luma - (22554 * cb + 46802 * cr + 32768 >> 16), 0, 255)
    out[..., 2] = np.clip(luma + (116130 * cb + 32768 >> 16), 0, 255)
    tensors = []
    for (across, down), s in zip(c.shapes, c.starts, strict=False):
        own = out[s : s + across * down]
        tensors.append(own.reshape(down, across, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(down * 16, across * 16, 3))
    return tensors
