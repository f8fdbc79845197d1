"""Media columns: payload bytes as baseline JPEG, and DC-only thumbnails read back from such files.

``store`` writes each text as grey baseline JPEGs in which every 8 x 8 block is flat: one byte of the payload is the
block's DC value, 64 blocks are one row, and a restart marker ends each row. ``describe`` parses markers, decodes the
Huffman-coded scans of any baseline file (several components, any sampling, with or without restart markers) and
rebuilds the luminance thumbnail from the DC values alone. All restart intervals of a batch are decoded side by side
in numpy: one step reads one block of each.

Defined results: a null text counts as empty; an empty text has a payload of 64 zero bytes; equal texts give equal
media; a file that can't be parsed gives null dimensions and a message in ``error``; a null file gives nulls. Rows are
dealt with one by one, so repeated rows, ties and other columns (which stay, whatever their names) make no difference.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, whole_text

UNIT = 64  # bytes of the payload in a row of blocks
MOST_ROWS = 65535 // 8  # a file is at most 65,535 pixels high; longer payloads go on in another file

# Fixed values of the JPEG standard: code lengths of the luminance DC table, and a table with the end of block alone.
DC_LENGTHS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_LENGTHS, AC_VALUES = (1, *[0] * 15), (0,)


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


# ---- writing


@lru_cache(1)
def _words() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255 the bits of its DC code, its magnitude and the end of block."""
    codes, code = {}, 0
    it = iter(DC_VALUES)
    for n, count in enumerate(DC_LENGTHS, 1):
        for _ in range(count):
            codes[next(it)] = (code, n)
            code += 1
        code <<= 1
    bits, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        low = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], lengths[d + 255] = ((code << size) | low) << 1, n + size + 1
    return bits, lengths


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    frame = struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0])
    tables = bytes([0x00, *DC_LENGTHS, *DC_VALUES, 0x10, *AC_LENGTHS, *AC_VALUES])
    return b"\xff\xd8" + _segment(0xDB, bytes([0, *[8] * 64])) + _segment(0xC0, frame) + _segment(0xC4, tables) + _segment(0xDD, struct.pack(">H", UNIT)) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as one JPEG file or several, one behind the other."""
    if not payloads:
        return []
    counts = [len(p) // UNIT for p in payloads]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT).astype(np.int16)
    rows -= 128
    diff = np.empty_like(rows)
    diff[:, 0], diff[:, 1:] = rows[:, 0], rows[:, 1:] - rows[:, :-1]
    diff = np.ascontiguousarray(diff.T) + 255
    words, lengths = _words()
    n, wide = len(rows), UNIT * 15 // 8 + 4
    out, at, base = np.zeros(n * wide, np.uint8), np.zeros(n, np.int64), np.arange(n, dtype=np.int64) * wide
    for j in range(UNIT):
        d = diff[j]
        size = lengths[d]
        v = words[d] << (24 - (at & 7) - size)
        k = base + (at >> 3)
        out[k] |= (v >> 16).astype(np.uint8)
        out[k + 1] |= ((v >> 8) & 255).astype(np.uint8)
        out[k + 2] |= (v & 255).astype(np.uint8)
        at += size
    rest = -at & 7  # ones fill the last byte
    out[base + ((at - 1) >> 3)] |= ((1 << rest) - 1).astype(np.uint8)
    used = (at + 7) >> 3
    body = out.reshape(n, wide)[np.arange(wide)[None, :] < used[:, None]]
    # A zero goes behind each byte 255, and a restart marker behind each row.
    row = np.repeat(np.arange(n), used)
    full = body == 255
    place = np.arange(len(body)) + np.cumsum(full) - full + 2 * row
    data = np.zeros(len(body) + int(full.sum()) + 2 * n, np.uint8)
    data[place] = body
    ends = np.cumsum(used + np.add.reduceat(full.astype(np.int64), np.cumsum(used) - used)) + 2 * np.arange(n)
    data[ends] = 255
    first = np.repeat(np.cumsum(counts) - counts, counts)
    data[ends + 1] = 0xD0 + (np.arange(n) - first) % MOST_ROWS % 8
    raw, files, r = data.tobytes(), [], 0
    for count in counts:
        file = []
        for a in range(r, r + count, MOST_ROWS):
            b = min(a + MOST_ROWS, r + count)
            file += [_head(b - a), raw[(ends[a - 1] + 2 if a else 0) : ends[b - 1]], b"\xff\xd9"]
        files.append(b"".join(file))
        r += count
    return files


# ---- reading


class Broken(ValueError):
    pass


class Frame:
    """What the markers of one baseline file say, and its scan."""

    width = height = 0
    restart = 0

    def __init__(self):
        self.quant: dict[int, int] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal and vertical sampling, table of quantisation
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.scan: list[tuple[int, int, int]] = []  # part, DC table, AC table
        self.data = b""

    def key(self) -> tuple:
        used = sorted({t for _, dc, ac in self.scan for t in (dc, 16 + ac)})
        return (tuple(p[:3] for p in self.parts), tuple(self.scan), tuple((t, self.tables[t]) for t in used))


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def frames(file: bytes) -> list[Frame]:
    """The files that stand one behind the other in `file`."""
    found, at = [], 0
    try:
        while at < len(file):
            if file[at : at + 2] != b"\xff\xd8":
                raise Broken("no start of image")
            frame, at = Frame(), at + 2
            while True:
                if file[at] != 0xFF:
                    raise Broken("no marker")
                while file[at + 1] == 0xFF:
                    at += 1
                marker, at = file[at + 1], at + 2
                if marker == 0xD9:
                    break
                size = int.from_bytes(file[at : at + 2], "big")
                body, at = file[at + 2 : at + size], at + size
                if marker == 0xDB:
                    while body:
                        wide = body[0] >> 4
                        frame.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                        body = body[1 + 64 * (1 + wide) :]
                elif marker == 0xC4:
                    while body:
                        n = sum(body[1:17])
                        frame.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                        body = body[17 + n :]
                elif marker in (0xC0, 0xC1):
                    _, frame.height, frame.width, n = struct.unpack(">BHHB", body[:6])
                    frame.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
                elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                    raise Broken("not a baseline file")
                elif marker == 0xDD:
                    frame.restart = int.from_bytes(body[:2], "big")
                elif marker == 0xDA:
                    ids = [p[0] for p in frame.parts]
                    frame.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                    if len(frame.scan) != len(frame.parts):
                        raise Broken("components in several scans")
                    end = _END.search(file, at)
                    if not end:
                        raise Broken("no end of image")
                    frame.data, at = file[at : end.start()], end.start()
            if not frame.scan or not frame.width or not frame.height:
                raise Broken("no frame or scan")
            found.append(frame)
    except (IndexError, struct.error, KeyError) as e:
        raise Broken("cut short") from e
    if not found:
        raise Broken("empty")
    return found


@lru_cache(64)
def _lookup(lengths: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits: length of the code that begins them, times 256, and its value. Zero: no such code."""
    out, code, i = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | values[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


def luminance(group: list[Frame]) -> list[np.ndarray]:
    """DC-only thumbnails of the first component, a pixel for each block. The frames have equal tables and sampling."""
    one = group[0]
    single = len(one.parts) == 1
    high, wide = (1, 1) if single else (max(p[2] for p in one.parts), max(p[1] for p in one.parts))
    grid = [(-(-f.height // (8 * high)), -(-f.width // (8 * wide))) for f in group]
    total = np.array([a * b for a, b in grid])
    # Segments between restart markers, without the zeros behind 255.
    raw = np.frombuffer(b"".join(f.data + b"\xff\xd0" for f in group) + bytes(2), np.uint8)
    mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
    drop = np.zeros(len(raw), bool)
    drop[mark], drop[mark + 1] = True, True
    drop[np.flatnonzero((raw[:-1] == 255) & (raw[1:] == 0)) + 1] = True
    drop[-2:] = True
    kept = np.cumsum(~drop)
    stop = kept[mark]
    start = np.concatenate([[0], stop[:-1]])
    size = np.cumsum([len(f.data) + 2 for f in group])
    owner = np.searchsorted(size, mark, side="right")
    step = np.array([f.restart or t for f, t in zip(group, total)])
    order = np.arange(len(mark)) - np.searchsorted(owner, owner, side="left")
    count = np.minimum(step[owner], total[owner] - order * step[owner])
    need = -(-total // step)
    if (np.bincount(owner, minlength=len(group)) != need).any():
        raise Broken("restart markers missing")
    data = np.concatenate([raw[~drop], np.full(16, 255, np.uint8)])
    window = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        window = (window << np.uint64(8)) | data[i : len(data) - 8 + i]
    blocks = [(part, dc, ac) for part, dc, ac in one.scan for _ in range(1 if single else one.parts[part][1] * one.parts[part][2])]
    luma = sum(b[0] == one.scan[0][0] for b in blocks)
    dc = {b[1]: _lookup(*one.tables[b[1]]) for b in blocks}
    ac = {b[2]: _lookup(*one.tables[16 + b[2]]) for b in blocks}
    out = np.zeros((int(count.max(initial=0)), luma, len(mark)), np.int32)
    at = start * 8
    last = np.zeros((len(one.parts), len(mark)), np.int64)
    everyone = np.arange(len(mark))
    fast = len(mark) and (count == count[0]).all()
    limit = len(window) - 1
    for m in range(int(count.max(initial=0))):
        live = slice(None) if fast else everyone[count > m]
        seen = 0
        for part, d, a in blocks:
            p = at[live].copy()
            w = window[np.minimum(p >> 3, limit)] << (p & 7).astype(np.uint64)
            got = dc[d][(w >> np.uint64(48)).astype(np.int64)]
            n, s = got >> 8, got & 255
            if not n.all() or (s > 11).any():
                raise Broken("bad code")
            low = ((w << n.astype(np.uint64)) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
            value = np.where(low < (1 << s >> 1), low - (1 << s) + 1, low)
            p = p + n + s
            last[part, live] += value
            if part == one.scan[0][0]:
                out[m, seen, live] = last[part, live]
                seen += 1
            code = ac[a][((w << (n + s).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
            p += code >> 8
            if not (code >> 8).all():
                raise Broken("bad code")
            more, k = np.flatnonzero(code & 255), None
            if len(more):
                k, c = np.ones(len(more), np.int64), code[more]
                while len(more):
                    rs = c & 255
                    k += (rs >> 4) + 1
                    p[more] += rs & 15
                    go = (k < 64) & ((rs & 15 > 0) | (rs >> 4 == 15))
                    more, k = more[go], k[go]
                    q = p[more]
                    w = window[np.minimum(q >> 3, limit)] << (q & 7).astype(np.uint64)
                    c = ac[a][(w >> np.uint64(48)).astype(np.int64)]
                    if not (c >> 8).all():
                        raise Broken("bad code")
                    p[more] += c >> 8
                    go = (c & 255) != 0
                    more, k, c = more[go], k[go], c[go]
            at[live] = p
    if (at > stop * 8).any():
        raise Broken("scan cut short")
    out = np.ascontiguousarray(out.transpose(2, 0, 1))
    thumbs, first = [], np.searchsorted(owner, np.arange(len(group)), side="left")
    for i, (f, (rows, cols)) in enumerate(zip(group, grid)):
        own = slice(first[i], first[i] + need[i])
        flat = out[own].reshape(-1, luma)[: rows * cols] if fast else np.concatenate([out[j, : count[j]] for j in range(own.start, own.stop)])
        h, v = (1, 1) if single else (f.parts[f.scan[0][0]][1], f.parts[f.scan[0][0]][2])
        image = flat.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
        q = f.quant[f.parts[f.scan[0][0]][3]]
        pixel = np.clip(np.floor(image * q / 8 + 128.5), 0, 255).astype(np.uint8)
        thumbs.append(pixel[: -(-f.height * v // (8 * high)), : -(-f.width * h // (8 * wide))])
    return thumbs


def read(files: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | str | None]:
    """For each file its frames as (width, height, thumbnail), or why it can't be read; None for None."""
    out: list = [None] * len(files)
    groups: dict[tuple, list[tuple[int, int, Frame]]] = {}
    for i, file in enumerate(files):
        if file is None:
            continue
        try:
            found = frames(file)
            out[i] = [None] * len(found)
            for j, f in enumerate(found):
                groups.setdefault((*f.key(), f.restart), []).append((i, j, f))
        except (Broken, ValueError) as e:
            out[i] = str(e)
    for group in groups.values():
        try:
            done = luminance([f for *_, f in group])
        except (Broken, IndexError, KeyError, ValueError):
            done = []
            for *_, f in group:  # one by one, to find those that are broken
                try:
                    done += luminance([f])
                except (Broken, IndexError, KeyError, ValueError) as e:
                    done.append(str(e) or "broken")
        for (i, j, f), thumb in zip(group, done):
            if isinstance(thumb, str):
                out[i] = thumb
            elif isinstance(out[i], list):
                out[i][j] = (f.width, f.height, thumb)
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: the means of 8 x 8 fields against their middle value."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    summed = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    summed[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    top, left = np.minimum(rows[:-1], thumb.shape[0] - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    area = (low - top)[:, None] * (right - left)[None, :]
    field = (summed[np.ix_(low, right)] - summed[np.ix_(top, right)] - summed[np.ix_(low, left)] + summed[np.ix_(top, left)]) / area
    return np.packbits((field > np.median(field)).ravel()).tobytes().hex()


# ---- columns


def store(df: DataFrame, column: str = "text", into: str = "media") -> DataFrame:
    """df without `column`, and with its texts stored in binary column `into`; `n_bytes`: bytes of the text itself. Columns of these two names are replaced."""
    rest = [c for c in df.columns if c not in (column, into, "n_bytes")]
    held = df.select(*[F.col(f"`{c}`") for c in rest], whole_text(column).alias(fresh(df.columns, "_text")[0]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        files = encode([payload(t) for t in texts])
        sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, pa.array(files, pa.binary())], [*rest, "n_bytes", into])

    return map_arrow(held, write, ", ".join(filter(None, [kinds, f"n_bytes long, `{into}` binary"])))


def describe(df: DataFrame, column: str = "media") -> DataFrame:
    """df without `column`, and with what the stored files hold: payload digest, dimensions, thumbnail hash, error."""
    made = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "n_files": "int", "width": "int", "height": "int", "feature": "string", "error": "string"}
    rest = [c for c in df.columns if c != column and c not in made]
    held = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias(fresh(df.columns, "_media")[0]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(batch.num_columns - 1).to_pylist()
        rows = []
        for file, got in zip(files, read(files)):
            sizes = (None, None) if file is None else (len(file), hashlib.sha256(file).hexdigest())
            if not isinstance(got, list):
                rows.append((None, None, None, *sizes, None, None, None, None, got))
                continue
            data = b"".join(t.tobytes() for *_, t in got)
            width, height = max(w for w, *_ in got), sum(h for _, h, _ in got)
            mark = thumbnail_hash(got[0][2] if len(got) == 1 else np.concatenate([t[:, : min(x.shape[1] for *_, x in got)] for *_, t in got]))
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), *sizes, len(got), width, height, f"{width}x{height}:{mark}", None))
        kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        new = [pa.array(x, kind[k]) for x, k in zip(zip(*rows), made.values())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*rest, *made])

    return map_arrow(held, look, ", ".join(filter(None, [kinds, ", ".join(f"{k} {v}" for k, v in made.items())])))
