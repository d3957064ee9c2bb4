"""Baseline JPEG frames in numpy: many frames are decoded in lock step.

Entropy-coded data has no structure that one frame's numpy code could share, but
frames (and the restart intervals of a frame) are independent: each is a lane with
its own bit position, and a step takes one Huffman symbol in every lane by a look-up
of 16 bits. Coefficients of all lanes then go through one matrix product (the inverse
DCT). Frames without Huffman tables get the standard ones, as motion JPEG allows.

Cases: progressive, lossless and 12-bit frames, and broken data, are errors of their
frame alone and don't touch the others.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

ZIGZAG = np.array([int(v) for v in "0 1 8 16 9 2 3 10 17 24 32 25 18 11 4 5 12 19 26 33 40 48 41 34 27 20 13 6 7 14 21 28 35 42 49 56 57 50 43 36 29 22 15 23 30 37 44 51 58 59 52 45 38 31 39 46 53 60 61 54 47 55 62 63".split()])
_K = np.arange(8)
_BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(0.5), 1) / 2
DCT = np.kron(_BASIS, _BASIS).astype(np.float32)  # coefficients of rows x columns from pixels
QUANT = (np.array("16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99".split(), np.int64))


def _table(counts: str, symbols: str) -> bytes:
    return bytes(map(int, counts.split())) + bytes.fromhex(symbols)


# tables K.3 to K.6 of the standard
_DC0 = _table("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "000102030405060708090a0b")
_DC1 = _table("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "000102030405060708090a0b")
_AC0 = _table(
    "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
)
_AC1 = _table(
    "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
)
STANDARD = {(0, 0): _DC0, (0, 1): _DC1, (1, 0): _AC0, (1, 1): _AC1}


def codes(table: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a Huffman table as it stands in a frame."""
    out, code, at = [], 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            out.append((table[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """bits << 8 | symbol for the next 16 bits; 0 where no code begins so."""
    if table not in _LOOKUPS:
        out = np.zeros(1 << 16, np.int32)
        for symbol, code, bits in codes(table):
            out[code << 16 - bits : (code + 1) << 16 - bits] = bits << 8 | symbol
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


@dataclass(frozen=True)
class Header:
    """What stands before a frame's entropy-coded data."""

    width: int
    height: int
    factors: tuple[tuple[int, int], ...]
    quant: tuple[tuple[int, ...], ...]
    huffman: tuple[tuple[bytes, bytes], ...]
    restart: int
    size: int

    @property
    def shape(self) -> tuple:
        return self.width, self.height, self.factors

    def layout(self) -> tuple[np.ndarray, int, int, int, int]:
        """Components of an MCU's blocks, MCUs across and down, and an MCU's width and height in blocks."""
        if len(self.factors) == 1:
            return np.zeros(1, np.int64), -(-self.width // 8), -(-self.height // 8), 1, 1
        h, v = max(a for a, _ in self.factors), max(b for _, b in self.factors)
        return np.repeat(np.arange(len(self.factors)), [a * b for a, b in self.factors]), -(-self.width // (8 * h)), -(-self.height // (8 * v)), h, v


def parse_header(data: bytes) -> Header:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quant, tables, restart, frame = 2, {}, dict(STANDARD), 0, None
    while True:
        if at + 4 > len(data):
            raise ValueError("frame is cut short")
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 129 if wide else 65
                quant[body[0] & 15] = tuple(struct.unpack(">64H" if wide else "64B", body[1:n]))
                body = body[n:]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of 12 bits")
            height, width, count = struct.unpack_from(">HHB", body, 1)
            if not width or not height:
                raise ValueError("frame without a size")
            frame = width, height, {body[6 + 3 * i]: ((body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15), body[8 + 3 * i]) for i in range(count)}
        elif kind in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and kind != 0xCC:
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif kind == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise ValueError("components in several scans")
            parts = [(frame[2][body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            return Header(frame[0], frame[1], tuple(p[0][0] for p in parts), tuple(quant[p[0][1]] for p in parts), tuple((tables[0, p[1] >> 4], tables[1, p[1] & 15]) for p in parts), restart, at)


_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


_HALF, _FULL = np.array([0, *(1 << n for n in range(15))]), np.array([(1 << n) - 1 for n in range(16)])


def decode_frames(frames: list[bytes], planes: int = 4) -> list[list[np.ndarray] | str]:
    """For each frame the first ``planes`` of its components (uint8, at their own resolution), or what is wrong with it."""
    out: list = [None] * len(frames)
    by_shape: dict[tuple, list[tuple[int, Header]]] = {}
    last, header = None, None
    for i, data in enumerate(frames):
        try:
            if last is None or not data.startswith(last):
                header = parse_header(data)
                last = data[: header.size]
            by_shape.setdefault(header.shape, []).append((i, header))
        except (ValueError, KeyError, IndexError, struct.error) as error:
            out[i], last = f"{type(error).__name__}: {error}", None
    for group in by_shape.values():
        _decode_group(frames, group, out, planes)
    return out


def _decode_group(frames: list[bytes], group: list[tuple[int, Header]], out: list, planes: int) -> None:
    component, across, down, mh, mv = group[0][1].layout()
    per = len(component)
    mcus = across * down
    total = mcus * per
    counts = len(group[0][1].factors)
    tables: dict[bytes, int] = {}
    pieces, frame_of, first, last, dc, ac = [], [], [], [], [], []
    for n, (i, header) in enumerate(group):
        data = frames[i][header.size :]
        end = data.rfind(b"\xff\xd9")
        data = data if end < 0 else data[:end]
        parts = _RESTART.split(data) if header.restart else [data]
        step = (header.restart or mcus) * per
        own = [[tables.setdefault(t, len(tables)) for t in pair] for pair in header.huffman]
        for k, part in enumerate(parts[: -(-total // step)]):
            pieces.append(part.replace(b"\xff\x00", b"\xff"))
            frame_of.append(n)
            first.append(n * total + k * step)
            last.append(n * total + min(total, (k + 1) * step))
            dc.append([a for a, _ in own])
            ac.append([b for _, b in own])
    lut = np.stack([lookup(t) for t in tables])
    sizes = np.array([len(p) for p in pieces], np.int64)
    at = np.cumsum(sizes + 8) - sizes - 8
    flat = np.frombuffer(b"".join([*(p + b"\xff" * 8 for p in pieces), b"\xff" * 8]), np.uint8)
    word = np.lib.stride_tricks.sliding_window_view(flat, 8).copy().view(">u8").ravel().astype(np.uint64)  # eight bytes from each place on
    coef = np.zeros((len(group) * total, 64), np.int16)
    bad = np.zeros(len(group), bool)
    reached = np.zeros(len(group), np.int64)
    frame_of, block, stop = np.array(frame_of), np.array(first), np.array(last)
    pos, limit = at * 8, (at + sizes) * 8
    own_tables = np.stack([np.array(dc), np.array(ac)], 1).reshape(len(pieces), 2 * counts)
    lane = np.arange(len(pieces))
    same = own_tables[0] if len(own_tables) and (own_tables == own_tables[0]).all() else None
    k = np.zeros(len(pieces), np.int64)
    pred = np.zeros((len(pieces), counts), np.int64)
    while len(lane):
        comp = component[block % per] if per > 1 else np.zeros(len(lane), np.int64)
        is_dc = k == 0
        which = comp + counts * ~is_dc
        ahead = word[pos >> 3] << (pos & 7).astype(np.uint64)
        v = lut[same[which] if same is not None else own_tables[lane, which], (ahead >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        bits, symbol = v >> 8, v & 255
        size = symbol & 15
        raw = (ahead << bits.astype(np.uint64) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = raw - (raw < _HALF[size]) * _FULL[size]
        pos = pos + bits + size
        run = (symbol >> 4) * ~is_dc
        end = ~is_dc & (size == 0) & (run < 15)
        place = k + run
        wrong = (bits == 0) | (pos > limit) | (~end & (place > 63))
        write = ~end & ~wrong & (is_dc | (size > 0))
        if is_dc.any():
            d = np.flatnonzero(is_dc)
            pred[lane[d], comp[d]] += value[d]
            value[d] = pred[lane[d], comp[d]]
        coef.ravel()[(block * 64 + place)[write]] = value[write]
        k = np.where(end, 64, place + 1)
        over = k > 63
        block = block + over
        k[over] = 0
        finished = over & (block >= stop)
        gone = finished | wrong
        if gone.any():
            bad[frame_of[lane[wrong]]] = True
            np.add.at(reached, frame_of[lane[finished & ~wrong]], 1)
            stay = ~gone
            lane, pos, limit, block, stop, k = lane[stay], pos[stay], limit[stay], block[stay], stop[stay], k[stay]
    needed = np.array([-(-mcus // h.restart) if h.restart else 1 for _, h in group])
    bad |= reached < needed
    blocks = coef.reshape(len(group), mcus, per, 64)
    for c in range(min(counts, planes)):
        h, v = group[0][1].factors[c] if counts > 1 else (1, 1)
        quant = np.array([g[1].quant[c] for g in group], np.float32)
        pixels = np.empty((len(group), mcus, h * v, 64), np.float32)
        pixels[..., ZIGZAG] = blocks[:, :, component == c] * quant[:, None, None, :]
        pixels = np.clip(np.rint(pixels @ DCT + 128), 0, 255).astype(np.uint8)
        plane = pixels.reshape(len(group), down, across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(group), down * v * 8, across * h * 8)
        plane = plane[:, : -(-group[0][1].height * v // mv), : -(-group[0][1].width * h // mh)]
        for n, (i, _) in enumerate(group):
            if bad[n]:
                out[i] = "ValueError: broken entropy-coded data"
            elif c == 0:
                out[i] = [plane[n]]
            else:
                out[i].append(plane[n])


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit length and the bits of signed values as JPEG writes them."""
    size = np.where(values == 0, 0, np.floor(np.log2(np.maximum(np.abs(values), 1))).astype(np.int64) + 1)
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def encode_frames(planes: list[np.ndarray], factors: tuple[tuple[int, int], ...] = ((1, 1),), quality: int = 75, restart: int = 0, tables: bool = True) -> list[bytes]:
    """Frames of like size; each plane is frames x rows x columns at its own resolution, the first at the frame's."""
    n, height, width = planes[0].shape
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((QUANT * scale + 50) // 100, 1, 255).astype(np.int64)[ZIGZAG]
    header = Header(width, height, factors, (), (), restart, 0)
    component, across, down, mh, mv = header.layout()
    coef = np.zeros((n, across * down, len(component), 64), np.int16)
    for c, plane in enumerate(planes):
        h, v = factors[c] if len(factors) > 1 else (1, 1)
        rows, cols = down * v * 8, across * h * 8
        full = np.pad(plane, ((0, 0), (0, rows - plane.shape[1]), (0, cols - plane.shape[2])), mode="edge").astype(np.float32) - 128
        blocks = full.reshape(n, down, v, 8, across, h, 8).transpose(0, 1, 4, 2, 5, 3, 6).reshape(n, across * down, h * v, 64)
        coef[:, :, component == c] = np.rint((blocks @ DCT.T)[..., ZIGZAG] / quant.astype(np.float32))
    per, interval = len(component), (restart or across * down) * len(component)
    coef = coef.reshape(n, -1, 64)
    total = coef.shape[1]
    comp = np.tile(component, across * down)
    diff = np.empty((n, total), np.int64)
    part = np.arange(total) // interval
    for c in range(len(planes)):
        own = np.flatnonzero(comp == c)
        d = coef[:, own, 0].astype(np.int64)
        before = np.concatenate([np.zeros((n, 1), np.int64), d[:, :-1]], 1)
        before[:, np.r_[True, part[own][1:] != part[own][:-1]]] = 0
        diff[:, own] = d - before
    code = np.zeros((2, 2, 256), np.int64)
    length = np.zeros((2, 2, 256), np.int64)
    for (kind, which), t in STANDARD.items():
        for symbol, value, bits in codes(t):
            code[kind, which, symbol], length[kind, which, symbol] = value, bits
    which = np.minimum(comp, 1)
    flat = np.arange(n * total)
    tab = np.tile(which, n)
    size, bits = _numbers(diff.ravel())
    events = [(flat * 256, code[0, tab, size] << size | bits, length[0, tab, size] + size)]
    ac = coef.reshape(-1, 64).copy()
    ac[:, 0] = 0
    spot = np.flatnonzero(ac)
    blk, k = spot >> 6, spot & 63
    prev = np.where(np.r_[True, blk[1:] != blk[:-1]], 0, np.r_[0, k[:-1]]) if len(blk) else k
    run = k - prev - 1
    size, bits = _numbers(ac.ravel()[spot].astype(np.int64))
    symbol = (run % 16) << 4 | size
    events.append((blk * 256 + 3 * k + 2, code[1, tab[blk], symbol] << size | bits, length[1, tab[blk], symbol] + size))
    for z in range(3):  # runs of 16 zeros
        more = run // 16 > z
        events.append((blk[more] * 256 + 3 * k[more] - 2 + z, code[1, tab[blk[more]], 0xF0], length[1, tab[blk[more]], 0xF0]))
    open_end = np.flatnonzero(ac[:, 63] == 0)
    events.append((open_end * 256 + 255, code[1, tab[open_end], 0], length[1, tab[open_end], 0]))
    key, value, size = (np.concatenate(x) for x in zip(*events, strict=True))
    order = np.argsort(key, kind="stable")
    key, value, size = key[order], value[order], size[order]
    lanes = -(-total // interval)
    lane = (key // 256) // total * lanes + (key // 256) % total // interval
    used = np.bincount(lane, weights=size, minlength=n * lanes).astype(np.int64)
    whole = -(-used // 8) * 8
    start = np.cumsum(whole) - whole
    bits = np.ones(int(whole.sum()), np.uint8)  # the last byte is filled with ones
    inside = np.cumsum(size) - size - (np.cumsum(used) - used)[lane]
    spot = np.repeat(start[lane] + inside, size)
    nth = np.arange(len(spot)) - np.repeat(np.cumsum(size) - size, size)
    bits[spot + nth] = (np.repeat(value, size) >> (np.repeat(size, size) - 1 - nth)) & 1
    data = np.packbits(bits).tobytes()
    many = len(planes)
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(quant.tolist())
    head += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * many, 8, height, width, many) + b"".join(bytes([c + 1, factors[c][0] << 4 | factors[c][1], 0]) for c in range(many))
    if tables:
        head += b"".join(b"\xff\xc4" + struct.pack(">HB", 3 + len(t), kind << 4 | w) + t for (kind, w), t in STANDARD.items())
    if restart:
        head += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    head += b"\xff\xda" + struct.pack(">HB", 6 + 2 * many, many) + b"".join(bytes([c + 1, min(c, 1) * 17]) for c in range(many)) + b"\x00\x3f\x00"
    out, byte = [], np.concatenate([start, [len(bits)]]) // 8
    for f in range(n):
        parts = [data[byte[f * lanes + i] : byte[f * lanes + i + 1]].replace(b"\xff", b"\xff\x00") for i in range(lanes)]
        body = parts[0] + b"".join(b"\xff" + bytes([0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
        out.append(head + body + b"\xff\xd9")
    return out
