"""A progressive JPEG decoder by plain loops over symbols and bits, written from the format alone: it shares no code with the package."""

import math

ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


class Bits:
    def __init__(self, data):
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        assert self.at <= len(self.text)
        return int(self.text[self.at - n : self.at] or "0", 2)

    def symbol(self, table):
        code = ""
        while code not in table:
            code += self.text[self.at]
            self.at += 1
        return table[code]

    def signed(self, size):
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def huffman(counts, symbols):
    table, code, rest = {}, 0, list(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[f"{code:0{length}b}"] = rest.pop(0)
            code += 1
        code *= 2
    return table


def segments_of(data, at):
    """Entropy-coded bytes from ``at`` on, cut at restart marks and without stuffing, and where they end."""
    out = [bytearray()]
    while True:
        if data[at] != 0xFF:
            out[-1].append(data[at])
            at += 1
        elif data[at + 1] == 0:
            out[-1].append(0xFF)
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(bytearray())
            at += 2
        else:
            return out, at


def ac_first(bits, block, lo, hi, low, table, run):
    if run:
        return run - 1
    k = lo
    while k <= hi:
        zeros, size = divmod(bits.symbol(table), 16)
        if not size and zeros < 15:
            return (1 << zeros) - 1 + bits.take(zeros)
        k += zeros
        if size:
            block[k] = bits.signed(size) * (1 << low)
        k += 1
    return 0


def ac_more(bits, block, lo, hi, low, table, run):
    def refine(k):
        if bits.take(1):
            block[k] += (1 << low) * (1 if block[k] > 0 else -1)

    k = lo
    while not run and k <= hi:
        zeros, size = divmod(bits.symbol(table), 16)
        if not size and zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        new = (1 if bits.take(1) else -1) * (1 << low) if size else 0
        while k <= hi:
            if block[k]:
                refine(k)
            elif zeros:
                zeros -= 1
            else:
                block[k] = new
                k += 1
                break
            k += 1
    if run:
        for j in range(k, hi + 1):
            if block[j]:
                refine(j)
        run -= 1
    return run


def read(data):
    """Height, width, and for each component its factors, quantization table and blocks by (row, column), in zigzag order."""
    assert data[:2] == b"\xff\xd8"
    at, tables, quant, parts, every = 2, {}, {}, {}, 0
    height = width = 0
    while data[at : at + 2] != b"\xff\xd9":
        assert data[at] == 0xFF
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                assert body[0] < 16  # 8-bit entries
                quant[body[0]], body = list(body[1:65]), body[65:]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark == 0xDD:
            every = int.from_bytes(body)
        elif mark == 0xC2:
            assert body[0] == 8
            height, width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            for k in range(body[5]):
                c, factors, q = body[6 + 3 * k : 9 + 3 * k]
                parts[c] = {"h": factors >> 4, "v": factors & 15, "q": q, "blocks": {}}
            most_h, most_v = max(p["h"] for p in parts.values()), max(p["v"] for p in parts.values())
            across, down = math.ceil(width / 8 / most_h), math.ceil(height / 8 / most_v)
            for p in parts.values():
                p["blocks"] = {(y, x): [0] * 64 for y in range(down * p["v"]) for x in range(across * p["h"])}
        elif mark == 0xDA:
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            lo, hi, approx = body[-3:]
            before, low = approx >> 4, approx & 15
            segments, at = segments_of(data, at)
            if len(chosen) > 1:
                units = [
                    [(c, t, (my * parts[c]["v"] + v, mx * parts[c]["h"] + h)) for c, t in chosen for v in range(parts[c]["v"]) for h in range(parts[c]["h"])]
                    for my in range(down) for mx in range(across)
                ]
            else:
                (c, t), p = chosen[0], parts[chosen[0][0]]
                rows, columns = math.ceil(math.ceil(height * p["v"] / most_v) / 8), math.ceil(math.ceil(width * p["h"] / most_h) / 8)
                units = [[(c, t, (y, x))] for y in range(rows) for x in range(columns)]
            each = every or len(units)
            assert len(segments) == math.ceil(len(units) / each)
            for n, segment in enumerate(segments):
                bits, last, run = Bits(segment), dict.fromkeys(parts, 0), 0
                for c, t, place in (x for unit in units[n * each : (n + 1) * each] for x in unit):
                    block = parts[c]["blocks"][place]
                    if lo:
                        run = (ac_more if before else ac_first)(bits, block, lo, hi, low, tables[0x10 | t & 15], run)
                    elif before:
                        block[0] |= bits.take(1) << low
                    else:
                        last[c] += bits.signed(bits.symbol(tables[t >> 4]))
                        block[0] = last[c] * (1 << low)
                rest = bits.text[bits.at :]
                assert len(rest) < 8 and "0" not in rest  # nothing is left but the padding
    return height, width, [{**p, "q": quant[p["q"]]} for p in parts.values()]


def samples(block, quant):
    """The 8 x 8 samples of a block, by the formula."""
    f = {ZIGZAG[k]: v * quant[k] for k, v in enumerate(block) if v}
    root = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    wave = lambda x, u: math.cos((2 * x + 1) * u * math.pi / 16)
    return [[128 + sum(root(v) * root(u) * c * wave(y, v) * wave(x, u) for (v, u), c in f.items()) / 4 for x in range(8)] for y in range(8)]


def pixels(data):
    """Rows of (R, G, B), chroma samples repeated."""
    height, width, parts = read(data)
    planes = [{place: samples(b, p["q"]) for place, b in p["blocks"].items()} for p in parts]
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)

    def sample(k, y, x):
        y, x = y * parts[k]["v"] // most_v, x * parts[k]["h"] // most_h
        return min(255, max(0, planes[k][y // 8, x // 8][y % 8][x % 8]))

    clip = lambda v: min(255.0, max(0.0, v))
    out = []
    for y in range(height):
        row = []
        for x in range(width):
            luma, cb, cr = sample(0, y, x), sample(1, y, x) - 128, sample(2, y, x) - 128
            row.append((clip(luma + 1.402 * cr), clip(luma - 0.344136 * cb - 0.714136 * cr), clip(luma + 1.772 * cb)))
        out.append(row)
    return out
