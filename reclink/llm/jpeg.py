"""Baseline JPEG as a media column: a decoder in numpy, DC-only luminance thumbnails, and a lossless carrier for bytes.

Decoder: markers are parsed (SOF0, DHT, DQT, DRI, SOS, APPn), stuffed bytes are taken out, and the entropy-coded scans of
many images are Huffman-decoded together: every restart interval is a lane, and each step decodes the next symbol of all
lanes with array operations.  The DC coefficients of the luminance blocks, dequantised, are the thumbnail (one pixel for
8x8); its dimensions, SHA-1 and average hash are the features.

Carrier: a payload whose length is a multiple of 192 is stored as the quantised coefficients of a three-component 4:4:4
image with quantiser 1; a payload byte b is the coefficient b - ``OFFSET``.  A minimum coded unit is three blocks, 192
bytes, and a restart interval, so units decode independently.  The length is in an APP9 segment.  Any baseline decoder can
open the file; its picture has no meaning, but its coefficients are the payload without loss.

Defined cases: null text: empty; an empty payload is padded to one unit; any length is taken whole; equal texts have equal
files; a file that isn't a baseline JPEG raises ``ValueError`` in the decoder, with the reason; extra columns are not read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from hashlib import sha1, sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192
OFFSET = 96
#: Payload bytes whose lanes are coded or decoded together.
CHUNK = 1 << 20
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])


# -- Huffman tables ---------------------------------------------------------------------------------------------------


def huffman_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) by length, as the standard numbers them."""
    out, code, at = [], 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            out.append((symbols[at], code, bits))
            at, code = at + 1, code + 1
        code <<= 1
    return out


def lookup_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For the next 16 bits: symbol << 8 | bits of its code; 0 where there is none."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, bits in huffman_codes(counts, symbols):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = symbol << 8 | bits
    return table


def _lengths(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """Counts and symbols of a Huffman code for these weights, with no code of ones alone and at most 16 bits."""
    import heapq

    heap = [(w, i, (s,)) for i, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*weights, 256], 0)
    n = len(heap)
    while len(heap) > 1:
        (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        n += 1
        heapq.heappush(heap, (wa + wb, n, a + b))
    counts = [0] * 40
    for d in depth.values():
        counts[d] += 1
    for d in range(39, 16, -1):  # the standard's way to shorten codes
        while counts[d]:
            j = d - 2
            while not counts[j]:
                j -= 1
            counts[d] -= 2
            counts[d - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    counts[max(d for d in range(40) if counts[d])] -= 1  # the reserved symbol
    order = sorted(weights, key=lambda s: (depth[s], s))
    return bytes(counts[1:17]), bytes(order)


def _size_weight(size: int) -> float:
    """How often a coefficient of text has this many bits."""
    return {0: 0.02, 1: 0.06, 2: 0.1, 3: 0.2, 4: 0.35, 5: 0.12, 6: 0.06, 7: 0.18}.get(size, 0.004)


#: One table for DC sizes and one for AC run/size pairs serve every file of the carrier.
DC_TABLE = _lengths({s: _size_weight(s) for s in range(12)})
AC_TABLE = _lengths({r << 4 | s: _size_weight(s) * 0.004**r + 1e-9 for r in range(16) for s in range(1, 11)} | {0: 0.01, 0xF0: 1e-6})


# -- carrier: coefficients to files -----------------------------------------------------------------------------------


def _code_arrays(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, c, b in huffman_codes(*table):
        code[s], bits[s] = c, b
    return code, bits


def _bit_size(x: np.ndarray) -> np.ndarray:
    """Bits of the magnitude of each coefficient."""
    return np.ceil(np.log2(np.abs(x) + 1.0)).astype(np.int64)


def encode_units(coefficients: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each minimum coded unit of three blocks: ``coefficients`` is (units, 3, 64) in zigzag order."""
    n = len(coefficients)
    flat = coefficients.reshape(n * 3, 64).astype(np.int64)
    dc_code, dc_bits = _code_arrays(DC_TABLE)
    ac_code, ac_bits = _code_arrays(AC_TABLE)
    block, k = np.nonzero(np.concatenate([np.ones((n * 3, 1), bool), flat[:, 1:] != 0], 1))
    value = flat[block, k]
    size = _bit_size(value)
    gap = np.diff(k, prepend=0) - 1
    gap[k == 0] = 0
    symbol = np.where(k == 0, size, (gap & 15) << 4 | size)
    code = np.where(k == 0, dc_code[symbol], ac_code[symbol])
    bits = np.where(k == 0, dc_bits[symbol], ac_bits[symbol])
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    word, width, place = code << size | extra, bits + size, block * 130 + k * 2 + 1
    # runs of 16 zeros before a coefficient, and the end of a block whose last coefficients are zero
    zrl = gap >> 4
    if zrl.any():
        which = np.repeat(np.flatnonzero(zrl), zrl[zrl > 0])
        word = np.append(word, np.full(len(which), ac_code[0xF0]))
        width = np.append(width, np.full(len(which), ac_bits[0xF0]))
        place = np.append(place, block[which] * 130 + k[which] * 2)
    ends = np.flatnonzero(k[np.append(np.flatnonzero(np.diff(block)), len(block) - 1)] < 63)
    if len(ends):
        word, width, place = np.append(word, np.full(len(ends), ac_code[0])), np.append(width, np.full(len(ends), ac_bits[0])), np.append(place, ends * 130 + 129)
    if len(place) > len(block):
        order = np.argsort(place, kind="stable")
        word, width, place = word[order], width[order], place[order]
    unit = place // 390
    # pad each unit with ones to whole bytes
    total = np.bincount(unit, width, n).astype(np.int64)
    sizes = -(-total // 8)
    start = (np.cumsum(sizes) - sizes) * 8
    at = np.cumsum(width) - width
    at += (start - (np.cumsum(total) - total))[unit]
    out = np.zeros(int(sizes.sum()) + 8, np.uint8)
    pad = sizes * 8 - total
    word, width, at = np.append(word, (1 << pad) - 1), np.append(width, pad), np.append(at, start + total)
    # a code has 26 bits at most, so it lies in 5 bytes
    shifted = word << (40 - width - (at & 7))
    for i in range(5):
        byte = (shifted >> (32 - 8 * i)) & 255
        some = byte != 0
        # codes overlap in bytes but not in bits
        np.add.at(out, (at[some] >> 3) + i, byte[some].astype(np.uint8))
    data = out[: int(sizes.sum())]
    stuffed = data == 255
    ends = np.cumsum(sizes)
    if stuffed.any():
        data = np.insert(data, np.flatnonzero(stuffed) + 1, 0)
        ends = ends + np.cumsum(stuffed)[ends - 1]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def carrier_size(units: int) -> tuple[int, int]:
    """Width and height in blocks."""
    width = min(units, 8_191, max(1, int(np.ceil(np.sqrt(units)))))
    return width, -(-units // width)


def carrier_head(units: int, n_bytes: int) -> bytes:
    w, h = carrier_size(units)
    frame = struct.pack(">BHHB", 8, h * 8, w * 8, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    return b"".join([
        b"\xff\xd8", _segment(0xE9, b"payload\0" + struct.pack(">QQ", n_bytes, units)), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, frame),
        _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]), _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]), _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\3" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\0\x3f\0"),
    ])


def padded(text: bytes) -> bytes:
    """The payload: spaces are appended up to a positive multiple of a unit."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload of whole units."""
    counts = [len(p) // UNIT for p in payloads]
    fill = [carrier_size(n)[0] * carrier_size(n)[1] - n for n in counts]
    joined = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, 3, 64) - OFFSET
    coded = [u for a in range(0, len(joined), CHUNK // UNIT) for u in encode_units(joined[a : a + CHUNK // UNIT])]
    blank = encode_units(np.zeros((1, 3, 64), np.int16))[0]
    marks = [bytes([255, 0xD0 + i]) for i in range(8)]
    out, at = [], 0
    for payload, n, extra in zip(payloads, counts, fill):
        units = coded[at : at + n] + [blank] * extra
        at += n
        parts = [carrier_head(n, len(payload))]
        for i, unit in enumerate(units):
            parts += [unit, marks[i & 7]]
        parts[-1] = b"\xff\xd9"
        out.append(b"".join(parts))
    return out


# -- decoder ----------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers of a baseline JPEG say, and its scans."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[dict] = field(default_factory=list)
    application: dict[int, bytes] = field(default_factory=dict)


def parse(data: bytes) -> Image:
    """Markers and entropy-coded segments of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, tables, interval, at = Image(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 255:
            at += 1
            continue
        if marker == 0xD9:
            break
        if marker in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, where = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                image.quantisers[where] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.width or not image.height:
                raise ValueError("not an 8-bit image of known size")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif 0xE0 <= marker <= 0xEF:
            image.application[marker - 0xE0] = body
        elif marker == 0xDA:
            if not image.components:
                raise ValueError("a scan before the frame")
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            raw = np.frombuffer(data, np.uint8, offset=at)
            stops = np.flatnonzero(raw[:-1] == 255)
            after = raw[stops + 1]
            real = stops[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            end = int(real[0]) if len(real) else len(raw)
            restarts = stops[(after >= 0xD0) & (after <= 0xD7)]
            restarts = restarts[restarts < end]
            image.scans.append({"components": chosen, "tables": dict(tables), "interval": interval, "data": raw[:end], "restarts": restarts})
            at += end
    if not image.components or not image.scans:
        raise ValueError("no image data")
    return image


def _layout(image: Image, scan: dict) -> tuple[list[tuple[int, int, int]], int]:
    """(component, row of the block in its unit, column) for each block of a unit, and the number of units."""
    by_id = {c[0]: i for i, c in enumerate(image.components)}
    high, wide = max(c[2] for c in image.components), max(c[1] for c in image.components)
    which = [by_id[c[0]] for c in scan["components"]]
    if len(which) == 1:
        _, h, v, _ = image.components[which[0]]
        across, down = -(-(-(-image.width * h // wide)) // 8), -(-(-(-image.height * v // high)) // 8)
        return [(which[0], 0, 0)], across * down
    across, down = -(-image.width // (8 * wide)), -(-image.height // (8 * high))
    return [(c, y, x) for c in which for y in range(image.components[c][2]) for x in range(image.components[c][1])], across * down


def _decode_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, units: np.ndarray, block_tables: list[tuple[int, int, int]], tables: dict[int, np.ndarray]) -> np.ndarray:
    """Coefficients (lane, unit, block, 64), zigzag order, of entropy-coded lanes without stuffing; DC values are predicted within a lane.

    ``block_tables``: (component, DC table, AC table) of each block of a unit.
    """
    lanes, most, per_unit = len(starts), int(units.max()), len(block_tables)
    out = np.zeros((lanes, most * per_unit * 64), np.int16)
    bits = np.concatenate([data, np.zeros(8, np.uint8)])
    window = bits[:-7].astype(np.int64) << 32 | bits[1:-6].astype(np.int64) << 24 | bits[2:-5].astype(np.int64) << 16 | bits[3:-4].astype(np.int64) << 8 | bits[4:-3]
    names = sorted({t for _, d, a in block_tables for t in (d, 16 + a)})
    stack = np.concatenate([tables[t] for t in names])
    dc_table = np.array([names.index(d) << 16 for _, d, _ in block_tables])
    ac_table = np.array([names.index(16 + a) << 16 for _, _, a in block_tables])
    component = np.array([c for c, _, _ in block_tables])
    lane = np.arange(lanes)
    bit = starts.astype(np.int64) * 8
    limit = ends.astype(np.int64) * 8
    last = units * per_unit
    block, k = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    before = np.zeros((lanes, int(component.max()) + 1), np.int64)
    while len(lane):
        kind = block % per_unit if per_unit > 1 else np.zeros(len(lane), np.int64)
        value = window[np.minimum(bit >> 3, len(window) - 1)]
        shift = bit & 7
        first = k == 0
        code = stack[np.where(first, dc_table[kind], ac_table[kind]) + ((value >> (24 - shift)) & 0xFFFF)].astype(np.int64)
        used, symbol = code & 255, code >> 8
        if (used == 0).any() or (bit >= limit).any():
            raise ValueError("broken entropy-coded data")
        size = symbol & 15
        bit += used
        raw = (window[np.minimum(bit >> 3, len(window) - 1)] >> (40 - (bit & 7) - size)) & ((1 << size) - 1)
        bit += size
        coefficient = np.where(raw < (1 << size) >> 1, raw - (1 << size) + 1, raw)
        k = np.where(first, 0, k + (symbol >> 4))
        if (k > 63).any():
            raise ValueError("a block has too many coefficients")
        if first.any():
            at, c = lane[first], component[kind[first]]
            before[at, c] += coefficient[first]
            coefficient[first] = before[at, c]
        some = (size > 0) | first
        out[lane[some], block[some] * 64 + k[some]] = coefficient[some]
        # a symbol without bits ends the block, or skips 16 coefficients
        over = ((k == 63) | ((size == 0) & (symbol != 0xF0))) & ~first
        k = np.where(over, 0, k + 1)
        block += over
        going = block < last[lane]
        if not going.all():
            lane, bit, limit, block, k = lane[going], bit[going], limit[going], block[going], k[going]
    return out.reshape(lanes, most, per_unit, 64)


def _unstuffed(scan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data without stuffed bytes and restart markers, and the lanes' borders."""
    data, restarts = scan["data"], scan["restarts"]
    drop = np.zeros(len(data), bool)
    if len(data) > 1:
        drop[1:] = (data[:-1] == 255) & (data[1:] == 0)
    drop[restarts] = drop[restarts + 1] = True
    place = np.arange(len(data) + 1)
    place[1:] -= np.cumsum(drop)
    starts = place[np.append(0, restarts + 2)]
    ends = place[np.append(restarts, len(data))]
    return data[~drop], starts, ends


def decode_coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and scan: quantised coefficients (units, blocks of a unit, 64) in zigzag order.  Scans with equal tables decode together."""
    jobs: dict[tuple, list] = {}
    out: list[list[np.ndarray]] = [[None] * len(i.scans) for i in images]
    for n, image in enumerate(images):
        for m, scan in enumerate(image.scans):
            blocks, units = _layout(image, scan)
            chosen = {image.components.index(next(c for c in image.components if c[0] == i)): (d, a) for i, d, a in scan["components"]}
            block_tables = tuple((c, *chosen[c]) for c, _, _ in blocks)
            used = sorted({t for _, d, a in block_tables for t in (d, 16 + a)})
            if any(t not in scan["tables"] for t in used):
                raise ValueError("a scan names a Huffman table that isn't there")
            jobs.setdefault((block_tables, tuple((t, scan["tables"][t]) for t in used)), []).append((n, m, scan, units))
    for (block_tables, tables), scans in jobs.items():
        lookup = {t: lookup_table(*x) for t, x in tables}
        for group in _batches(scans):
            parts, starts, ends, units, owner, base = [], [], [], [], [], 0
            for j, (_, _, scan, total) in enumerate(group):
                data, a, b = _unstuffed(scan)
                step = scan["interval"] or total
                if len(a) != -(-total // step):
                    raise ValueError("restart markers don't fit the interval")
                parts.append(data)
                starts.append(a + base)
                ends.append(b + base)
                units.append(np.minimum(step, total - np.arange(len(a)) * step))
                owner.append(np.full(len(a), j))
                base += len(data)
            units_of = np.concatenate(units)
            decoded = _decode_lanes(np.concatenate(parts), np.concatenate(starts), np.concatenate(ends), units_of, list(block_tables), lookup)
            valid = np.arange(decoded.shape[1]) < units_of[:, None]
            flat, cuts = decoded[valid], np.cumsum(np.bincount(np.concatenate(owner), units_of, len(group)).astype(np.int64))
            for (n, m, _, _), x in zip(group, np.split(flat, cuts[:-1])):
                out[n][m] = x
    return out


def _batches(scans: list):
    batch, size = [], 0
    for x in scans:
        if batch and size + len(x[2]["data"]) > CHUNK:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += len(x[2]["data"])
    yield batch


def thumbnail(image: Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """DC-only luminance: one pixel (0 to 255) for each 8x8 block of the first component."""
    for scan, data in zip(image.scans, coefficients):
        blocks, _ = _layout(image, scan)
        own = [i for i, (c, _, _) in enumerate(blocks) if c == 0]
        if not own:
            continue
        _, h, v, q = image.components[0]
        wide, high = max(c[1] for c in image.components), max(c[2] for c in image.components)
        across = -(-(-(-image.width * h // wide)) // 8)
        down = -(-(-(-image.height * v // high)) // 8)
        dc = data[:, own, 0].astype(np.float64) * image.quantisers[q][0] / 8 + 128
        if len(blocks) == 1:
            grid = dc.reshape(-1, across)
        else:
            units = -(-image.width // (8 * wide))
            grid = dc.reshape(-1, units, v, h).transpose(0, 2, 1, 3).reshape(-1, units * h)
        return np.clip(np.rint(grid[:down, :across]), 0, 255).astype(np.uint8)
    raise ValueError("no luminance scan")


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: which of 8x8 cells of the thumbnail are, on average over their pixels, over the mean of all cells."""
    rows, cols = (np.arange(8) * n // 8 for n in pixels.shape)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), rows, 0), cols, 1)
    # a side of fewer than 8 pixels has cells of one pixel each, some of them the same
    high, wide = (np.maximum(1, np.diff(np.append(at, n))) for at, n in zip((rows, cols), pixels.shape))
    cells = sums / np.outer(high, wide)
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def read_payload(image: Image, coefficients: list[np.ndarray]) -> tuple[int, bytes]:
    """The payload's bytes from a carrier's coefficients."""
    tag = image.application.get(9, b"")
    if tag[:8] != b"payload\0":
        raise ValueError("not a carrier")
    n_bytes, units = struct.unpack(">QQ", tag[8:24])
    values = coefficients[0][:units].astype(np.int64).reshape(units, 3, 64)
    # restart intervals of one unit: DC values are not differences
    data = (values + OFFSET).astype(np.uint8).tobytes()
    if len(data) != n_bytes:
        raise ValueError("the payload's length doesn't fit")
    return n_bytes, data


# -- columns ----------------------------------------------------------------------------------------------------------


def _groups(values: list[bytes], most: int = CHUNK):
    batch, size = [], 0
    for v in values:
        if batch and size + len(v) > most:
            yield batch
            batch, size = [], 0
        batch.append(v)
        size += len(v)
    if batch:
        yield batch


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): every whole text as a carrier JPEG in a binary column."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                media = [m for g in _groups([padded(t) for t in texts]) for m in write_payloads(g)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of (id_col, n_bytes, media): what reading the stored files back gives."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for group in _groups(part.column(2).to_pylist()):
                    images = [parse(x) for x in group]
                    for raw, image, coefficients in zip(group, images, decode_coefficients(images)):
                        _, payload = read_payload(image, coefficients)
                        small = thumbnail(image, coefficients)
                        feature = f"{image.width}x{image.height} {small.shape[1]}x{small.shape[0]} {sha1(small.tobytes()).hexdigest()} {average_hash(small):016x}"
                        rows.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-16:]), len(raw), sha256(raw).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds[2:]))], names=names)

    return media.select(F.col(f"`{id_col}`"), "n_bytes", "media").mapInArrow(run, ", ".join(f"`{n}` {'string' if k == pa.string() else 'bigint'}" for n, k in zip(names, kinds)))
