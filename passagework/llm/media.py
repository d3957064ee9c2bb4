"""Media columns: AVI files with motion JPEG to timed clip rows.

A binary column holds AVI files. Their RIFF chunks are parsed: the stream header for
the time base, then the frames' places by the OpenDML index (``indx`` and its ``ix``
chunks), the old index (``idx1``, with offsets from the file's or the list's begin), or
a walk through the lists where there is none. Frames are decoded in bounded groups,
those of many files together. A shot ends where the histogram of luma differs from the
frame before by more than an adaptive bound: twice the median of the differences around
plus ``SPREAD`` times their median deviation, and ``FLOOR`` at least. A pixel counts for
the two bins next to it, so a slight change of light moves little. As JPEG rounds the mean
of a block, slowly changing light moves in steps, of a whole picture at once where it is
flat; so the difference must pass the bound with the frame before made lighter or darker
by up to such a step too. Each shot is a row.

The plan is narrow: files are decoded where they are read, in groups of at most ``FRAMES``
frames and ``PIXELS`` pixels (a larger frame is a group of its own), of which only the
differences stay. Cases: null media gives no row; what isn't an AVI file with a
video stream, or has no frame, gives one row without times and with its error. A frame of size zero repeats
the one before; one that can't be decoded is counted in bad_frames and does the
same. A file of one frame is one clip. Rows are treated one by one, so repeated rows
give repeated clips; other columns are not read.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import mix64
from passagework.llm.jpeg import decode_frames, encode_frames, parse_header

BINS = 32
AROUND = 8
SPREAD = 5.0
FLOOR = 0.2
FRAMES = 4096
PIXELS = 1 << 22  # decoded at once
BYTES = 64 << 20  # of files held for a group
_CENTRES = (np.arange(BINS) + 0.5) * 256 / BINS
_SOFT = np.maximum(0, 1 - np.abs(np.clip(np.arange(256)[:, None], _CENTRES[0], _CENTRES[-1]) - _CENTRES[None, :]) * BINS / 256)
_STEP = 256 // BINS  # no step of light counts as larger than a bin
_LIGHTER = {s: _SOFT[np.clip(np.arange(256) + s, 0, 255)] for s in range(-_STEP, _STEP + 1)}
_LISTS = (b"RIFF", b"LIST")

# ---- AVI


def write_avi(frames: list[bytes], width: int, height: int, rate: int = 10, scale: int = 1, index: str = "idx1") -> bytes:
    """An AVI file; ``index`` is "idx1", "absolute" (the same with offsets in the file), "opendml" or "none"."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 * scale // rate, 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, scale, rate, 0, len(frames), most, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    places, at = [], 4
    for f in frames:
        places.append(at)
        at += 8 + len(f) + (len(f) & 1)
    body = b"movi" + b"".join(chunk(b"00dc", f) for f in frames)

    def head(strl_more: bytes) -> bytes:
        strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + strl_more)
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)

    more = b""
    if index == "opendml":
        base = 12 + len(head(chunk(b"indx", bytes(40)))) + 8  # of the movi list's type
        ix = struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", base, 0) + b"".join(struct.pack("<II", p + 8, len(f)) for p, f in zip(places, frames, strict=True))
        more = chunk(b"indx", struct.pack("<HBBI4s12xQII", 4, 0, 0, 1, b"00dc", base + len(body), 8 + len(ix), len(frames)))
        body += chunk(b"ix00", ix)
    start = head(more)
    shift = 12 + len(start) + 8 if index == "absolute" else 0
    tail = chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, p + shift, len(f)) for p, f in zip(places, frames, strict=True))) if index in ("idx1", "absolute") else b""
    return chunk(b"RIFF", b"AVI " + start + chunk(b"LIST", body) + tail)


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, list type, begin and end of the body) of the chunks in a range; one that is cut short ends with the file."""
    while at + 8 <= end:
        name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
        begin, stop = at + 8, min(at + 8 + size, end)
        if name in _LISTS:
            yield name, data[begin : begin + 4], begin + 4, stop
        else:
            yield name, b"", begin, stop
        at = begin + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds of a frame, and begin and end of each frame's bytes (equal: the frame before again)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    stream, seconds, supers, movi, old = -1, 0.0, [], [], None
    for _, kind, a, b in chunks(data, 0, len(data)):
        if kind not in (b"AVI ", b"AVIX"):
            continue
        for name, kind2, c, d in chunks(data, a, b):
            if kind2 == b"movi":
                movi.append((c, d))
            elif name == b"idx1":
                old = c, d
            elif kind2 == b"hdrl":
                lists = [(x, y) for _, k, x, y in chunks(data, c, d) if k == b"strl"]
                for number, (x, y) in enumerate(lists):
                    parts = {n: (p, q) for n, _, p, q in chunks(data, x, y)}
                    p, q = parts.get(b"strh", (0, 0))
                    if stream < 0 and data[p : p + 4] == b"vids" and q - p >= 28:
                        scale, rate = struct.unpack_from("<II", data, p + 20)
                        if not scale or not rate:
                            raise ValueError("stream without a rate")
                        stream, seconds = number, scale / rate
                        supers = [parts[b"indx"]] if b"indx" in parts else []
    if stream < 0:
        raise ValueError("no video stream")
    if not movi:
        raise ValueError("no movi list")
    tags = (b"%02ddc" % stream, b"%02ddb" % stream)
    frames: list[tuple[int, int]] = []
    for p, _ in supers:
        width, _, kind, count = struct.unpack_from("<HBBI", data, p)
        where = [struct.unpack_from("<QI", data, p + 24 + 16 * i)[0] + 8 for i in range(count)] if kind == 0 else [p]
        for x in where:
            width, _, kind, count = struct.unpack_from("<HBBI", data, x)
            (base,) = struct.unpack_from("<Q", data, x + 12)
            for offset, size in struct.iter_unpack("<II", data[x + 24 : x + 24 + 8 * count]) if kind == 1 and width == 2 else ():
                frames.append((base + offset, base + offset + (size & 0x7FFFFFFF)))
    if not frames and old:
        entries = [(t, o, s) for t, _, o, s in struct.iter_unpack("<4sIII", data[old[0] : old[1] - (old[1] - old[0]) % 16]) if t in tags]
        list_at = movi[0][0] - 4
        shift = list_at if entries and data[list_at + entries[0][1] : list_at + entries[0][1] + 4] == entries[0][0] else 0
        frames = [(shift + o + 8, shift + o + 8 + s) for _, o, s in entries]
    if not frames:
        todo = movi[::-1]
        while todo:
            for name, kind, c, d in chunks(data, *todo.pop()):
                if kind == b"rec ":
                    frames += [(x, y) for n, _, x, y in chunks(data, c, d) if n in tags]
                elif name in tags:
                    frames.append((c, d))
    if not frames:
        raise ValueError("no frames")
    if any(b > len(data) for _, b in frames):
        raise ValueError("an index points beyond the file")
    return seconds, frames


# ---- shots


def groups(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of frames that are decoded together; sizes are read from the frame headers."""
    begin, total = 0, 0
    for i, f in enumerate(frames):
        at = max(f.find(b"\xff\xc0"), f.find(b"\xff\xc1")) if len(f) > 9 else -1
        size = int.from_bytes(f[at + 5 : at + 7], "big") * int.from_bytes(f[at + 7 : at + 9], "big") if at >= 0 else 0
        if i > begin and (i - begin == FRAMES or total + size > PIXELS):
            yield begin, i
            begin, total = i, 0
        total += size
    if frames:
        yield begin, len(frames)


def histograms(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the levels of luma, a row a frame, and the levels in a step of its blocks' mean; -1 where it can't be decoded or is empty."""
    out, step = np.zeros((len(frames), 256)), np.full(len(frames), -1)
    full = [i for i, f in enumerate(frames) if f]
    planes = decode_frames([frames[i] for i in full], planes=1)
    shapes: dict[tuple, list[int]] = {}
    last, levels = None, 0
    for n, p in enumerate(planes):
        if not isinstance(p, str):
            shapes.setdefault(p[0].shape, []).append(n)
            data = frames[full[n]]
            if last is None or not data.startswith(last):
                header = parse_header(data)
                last, levels = data[: header.size], min(-(-header.quant[0][0] // 8), _STEP)
            step[full[n]] = levels
    for own in shapes.values():
        luma = np.stack([planes[n][0] for n in own]).reshape(len(own), -1)
        for i in range(0, len(own), 256):
            part = luma[i : i + 256]
            counts = np.bincount((part + np.arange(len(part))[:, None] * 256).ravel(), minlength=len(part) * 256)
            out[[full[n] for n in own[i : i + 256]]] = counts.reshape(len(part), 256) / luma.shape[1]
    return out, step


def differences(frames: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a frame differs from the last one before that its film has, the same past a step of light, and whether it is lost.

    Both are 0 where either frame is missing. Up to ``FLOOR`` the second is the first, as neither is a cut then.
    """
    diff, past, lost = np.zeros(len(frames)), np.zeros(len(frames)), np.zeros(len(frames), bool)
    kept = np.zeros((1, 256)), np.array([-1]), np.array([-1])  # the last frame known: its histogram, its step, its film
    for a, b in groups(frames):
        hist, step, film = (np.concatenate(x) for x in zip(kept, (*histograms(frames[a:b]), owner[a:b]), strict=True))
        known = step >= 0
        lost[a:b] = ~known[1:]
        last = np.maximum.accumulate(np.where(known, np.arange(len(hist)), 0))
        now = 1 + np.flatnonzero(known[1:])
        now = now[film[last[now - 1]] == film[now]]
        before = last[now - 1]
        soft = hist @ _SOFT
        plain = np.abs(soft[now] - soft[before]).sum(1) / 2
        least, far = plain.copy(), np.flatnonzero(plain > FLOOR)
        free = np.maximum(step[now[far]], step[before[far]])
        for s in range(1, free.max(initial=0) + 1):
            own = far[free >= s]
            for lighter in (_LIGHTER[s], _LIGHTER[-s]):
                least[own] = np.minimum(least[own], np.abs(soft[now[own]] - hist[before[own]] @ lighter).sum(1) / 2)
        diff[a - 1 + now], past[a - 1 + now] = plain, least
        at = last[-1]
        kept = hist[at : at + 1].copy(), step[at : at + 1], film[at : at + 1]
    return diff, past, lost


def cuts(diff: np.ndarray, past: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where shots begin. ``diff[i]`` is frame i against the one before, and sets the bound that ``past[i]`` must pass; ``owner`` is sorted, its first rows' diffs don't count."""
    n = len(diff)
    first = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    shift = np.r_[np.arange(-AROUND, 0), np.arange(1, AROUND + 1)]
    at = np.arange(n)[:, None] + shift[None, :]
    inside = (at >= 0) & (at < n)
    at = np.clip(at, 0, max(n - 1, 0))
    inside &= (owner[at] == owner[:, None]) & ~first[at]
    near = np.where(inside, diff[at], np.inf)
    count = inside.sum(1)

    def median(values: np.ndarray) -> np.ndarray:
        got = np.sort(values, axis=1)[np.arange(n), np.maximum(count - 1, 0) // 2]
        return np.where(count > 0, got, 0)

    middle = median(near)
    with np.errstate(invalid="ignore"):
        deviation = median(np.where(inside, np.abs(near - middle[:, None]), np.inf))
    return first | (past > np.maximum(FLOOR, 2 * middle + SPREAD * deviation))


def find_clips(videos: list[list[bytes]]) -> list[tuple[list[int], list[int]]]:
    """For each video the first frames of its shots, and the undecodable frames of each shot."""
    sizes = np.array([len(v) for v in videos], np.int64)
    flat = [f for v in videos for f in v]
    owner = np.repeat(np.arange(len(videos)), sizes)
    diff, past, lost = differences(flat, owner)
    broken = lost & np.array([bool(f) for f in flat], bool)
    head = np.cumsum(sizes) - sizes
    start = cuts(diff, past, owner)
    out, shot = [], np.cumsum(start) - 1
    bad = np.bincount(shot, weights=broken, minlength=int(start.sum())).astype(int) if len(flat) else np.zeros(0, int)
    at = np.flatnonzero(start)
    mine = owner[at]
    for v in range(len(videos)):
        a, b = np.searchsorted(mine, v), np.searchsorted(mine, v, "right")
        out.append(((at[a:b] - head[v]).tolist(), bad[a:b].tolist()))
    return out


def clips(rows: DataFrame, key: str = "page_id", media: str = "media") -> DataFrame:
    """(key, clip, start_frame, end_frame, start_s, end_s, bad_frames, error); end_frame is exclusive."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "clip", "start_frame", "end_frame", "start_s", "end_s", "bad_frames", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # key, seconds of a frame, frames, error
        count = size = 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            out: list[tuple] = []
            for (k, seconds, frames, error), (starts, bad) in zip(held, find_clips([h[2] for h in held]), strict=True):
                if error:
                    out.append((k, None, None, None, None, None, None, error))
                for n, (a, b) in enumerate(itertools.pairwise([*starts, len(frames)])):
                    out.append((k, n, a, b, a * seconds, b * seconds, bad[n], None))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        target = None
        for batch in batches:
            target = batch.schema.field(0).type
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                blob = data.as_py()
                if blob is None:
                    continue
                try:
                    seconds, places = parse_avi(blob)
                    held.append((k.as_py(), seconds, [blob[a:b] for a, b in places], None))
                    count, size = count + len(places), size + len(blob)
                except (ValueError, struct.error, IndexError) as error:
                    held.append((k.as_py(), 0.0, [], f"{type(error).__name__}: {error}"))
                if count >= FRAMES or size >= BYTES:
                    yield flush(target)
                    held, count, size = [], 0, 0
        if held:
            yield flush(target)

    return rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{media}`").cast("binary").alias(media)).mapInArrow(run, f"`{key}` {kind}, clip int, start_frame int, end_frame int, start_s double, end_s double, bad_frames int, error string")


# ---- a media column for tables that have none

WIDTH, HEIGHT, RATE = 32, 24, 10
LEVELS = np.array([30, 90, 150, 210])
INDEXES = ("idx1", "absolute", "opendml", "none")


def scenes(size: int) -> list[int]:
    """Frames of the scenes of the film of a text of so many bytes: longer texts have longer films."""
    return [5 + size // (s + 1) % 4 for s in range(1 + size % 4 + size // 4096)]


def films(texts: list[bytes]) -> list[bytes]:
    """A film of each text: its length gives the scenes, the index, the size and the colour, and all its bytes the looks.

    Pictures move, and brighten slowly within a scene.
    """
    out: list[bytes] = [b""] * len(texts)
    kinds: dict[tuple[int, bool], list[int]] = {}
    for i, t in enumerate(texts):
        kinds.setdefault((1 + (len(t) % 5 == 0), len(t) % 3 == 0), []).append(i)
    for (scale, colour), own in kinds.items():
        height, width = HEIGHT * scale, WIDTH * scale
        lengths = [scenes(len(texts[i])) for i in own]
        sizes = np.array([sum(x) for x in lengths], np.int64)
        owner = np.repeat(np.arange(len(own)), sizes)
        frame = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        scene = np.concatenate([np.repeat(np.arange(len(x)), x) for x in lengths])
        inside = np.concatenate([np.arange(n) for x in lengths for n in x])
        look = np.array([zlib.crc32(texts[i]) for i in own], np.uint64)
        cells = (mix64(look[:, None] * np.uint64(64) + np.arange(12, dtype=np.uint64)) % np.uint64(17)).astype(np.int16) - 8
        texture = np.repeat(np.repeat(cells.reshape(-1, 3, 4), height // 3, axis=1), width // 4, axis=2)
        level = LEVELS[(look[owner] % np.uint64(4)).astype(np.int64) + scene & 3] + inside
        pixels = np.empty((len(frame), height, width), np.uint8)
        for shift in range(0, width, 4):
            own_frames = np.flatnonzero(4 * frame % width == shift)
            moved = np.roll(texture, -shift, axis=2)
            pixels[own_frames] = moved[owner[own_frames]] + level[own_frames, None, None].astype(np.int16)
        planes = [pixels]
        if colour:
            tint = (look[owner] >> np.uint64(8) & np.uint64(63)).astype(np.uint8)
            planes += [np.broadcast_to(c[:, None, None], (len(frame), height // 2, width // 2)) for c in (96 + tint, 160 - tint)]
        coded = encode_frames(planes, ((2, 2), (1, 1), (1, 1)) if colour else ((1, 1),), quality=50, tables=colour)
        for i, e, n in zip(own, np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            out[i] = write_avi(coded[e - n : e], width, height, RATE, index=INDEXES[len(texts[i]) // 4 % 4])
    return out


def with_films(rows: DataFrame, key: str = "page_id", text: str = "html", media: str = "media") -> DataFrame:
    """(key, media): an AVI file made from each text; a null text has none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else x.encode() for x in part.column(1).to_pylist()]
                made = iter(films([t for t in texts if t is not None]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else next(made) for t in texts], pa.binary())], [key, media])

    return rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, `{media}` binary")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL),
s AS (SELECT page_id, unnest(range(0, 1 + n % 4 + n // 4096))::INT AS clip, n FROM p),
f AS (SELECT page_id, clip, 5 + (n // (clip + 1)) % 4 AS frames FROM s),
e AS (SELECT page_id, clip, frames, sum(frames) OVER (PARTITION BY page_id ORDER BY clip) AS stop FROM f)
SELECT page_id, clip, (stop - frames)::INT AS start_frame, stop::INT AS end_frame,
  round((stop - frames) * 0.1, 6)::DOUBLE AS start_s, round(stop * 0.1, 6)::DOUBLE AS end_s, 0::INT AS bad_frames, NULL::VARCHAR AS error
FROM e
"""
