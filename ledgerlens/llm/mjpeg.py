"""Media columns: AVI motion-JPEG in plain numpy.

Writer: each payload byte is one flat 8x8 block of a grey baseline JPEG (DC quantiser 8, so the decoded sample is the
byte itself); a block row holds 64 bytes and is one restart interval; a frame holds ``ROWS`` block rows. A JPEG comment
says how many block rows of the frame are payload. Reader: parses RIFF chunks and the idx1 index, decodes baseline grey
JPEG frames of any content (Huffman, restart intervals, AC coefficients and inverse DCT), rebuilds samples, and splits
the clip into shots where the histogram difference leaves the range of the differences before it.

Decoding runs in lock step over all restart intervals of a batch: one numpy step reads one symbol from every interval.
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

from ledgerlens.llm.common import by_batch, text_bytes

UNIT = 64  # payload bytes of a block row
ROWS = 16  # block rows of a frame
FPS = 25
#: Text bytes that are coded and decoded together; bounds a worker's memory.
GROUP_BYTES = 1 << 19

# Fixed values of the JPEG format: code lengths (count per length 1..16) and symbols of the tables written here.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


def canonical_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as the format assigns codes: counting up within a length, doubling between lengths."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit peek: code length * 256 + symbol (0 where no code fits)."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, length) in canonical_codes(list(counts), list(symbols)).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + s
    return table


@lru_cache(maxsize=1)
def dct_basis() -> np.ndarray:
    """64x64: coefficients in natural order times this give samples (less 128)."""
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    return np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    return np.array(order)


# --- writer -----------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def _frame_head() -> bytes:
    quant = bytes([0]) + bytes([8] + [1] * 63)
    return b"".join(
        (
            _segment(0xDB, quant),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, UNIT * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
            _segment(0xDD, struct.pack(">H", UNIT)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


@lru_cache(maxsize=1)
def _bit_rows() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each DC difference -255..255 with the end-of-block code after it: its bits (16 cells), which cells count, how many.
    Rows 511 + n are n one-bits, which fill a restart interval's last byte."""
    dc, eob = canonical_codes(DC_COUNTS, DC_SYMBOLS), canonical_codes(AC_COUNTS, AC_SYMBOLS)[0]
    words = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        extra = f"{d if d >= 0 else d + (1 << size) - 1:0{size}b}" if size else ""
        words.append(f"{code:0{length}b}{extra}{eob[0]:0{eob[1]}b}")
    words += ["1" * n for n in range(8)]
    bits = np.array([[c == "1" for c in w.ljust(16, "0")] for w in words], np.uint8)
    count = np.array([len(w) for w in words])
    return bits, np.arange(16)[None] < count[:, None], count


def _code_rows(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes (stuffed) of each row of UNIT samples."""
    bits, counts_in, count = _bit_rows()
    which = np.empty((len(samples), UNIT + 1), np.int16)
    which[:, :UNIT] = np.diff(samples.astype(np.int16) - 128, axis=1, prepend=0) + 255
    total = count[which[:, :UNIT]].sum(axis=1)
    which[:, UNIT] = 511 + (-total & 7)
    data = np.packbits(bits[which][counts_in[which]]).tobytes()
    cut = np.concatenate(([0], np.cumsum((total + 7) >> 3))).tolist()
    return [data[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip(cut, cut[1:], strict=False)]


@lru_cache(maxsize=1)
def _filler() -> bytes:
    return _code_rows(np.full((1, UNIT), 128, np.uint8))[0]


def _avi(frames: list[bytes]) -> bytes:
    width, height = UNIT * 8, ROWS * 8
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)

    def chunk(tag: bytes, body: bytes) -> bytes:
        return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    body, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    movi = chunk(b"LIST", b"movi" + b"".join(body))
    return chunk(b"RIFF", b"AVI " + head + movi + chunk(b"idx1", b"".join(index)))


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of UNIT bytes)."""
    rows = _code_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))
    rst = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    out, at = [], 0
    for p in payloads:
        own = rows[at : at + len(p) // UNIT]
        at += len(own)
        frames = []
        for i in range(0, len(own), ROWS):
            part = own[i : i + ROWS]
            used = len(part)
            part = part + [_filler()] * (ROWS - used)
            scan = part[0] + b"".join(rst[k % 8] + x for k, x in enumerate(part[1:]))
            frames.append(b"\xff\xd8" + _segment(0xFE, b"rows=%d" % used) + _frame_head() + scan + b"\xff\xd9")
        out.append(_avi(frames))
    return out


# --- reader -----------------------------------------------------------------------------------------------------


def frames_of(avi: bytes) -> tuple[list[bytes], int]:
    """The frames by the idx1 index (or, without one, by walking movi) and microseconds a frame."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, movi, index = 1_000_000 // FPS, None, None
    at, end = 12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0])
    while at + 8 <= end:
        tag, n = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        kind = avi[at + 8 : at + 12]
        if tag == b"LIST" and kind == b"hdrl":
            k = avi.find(b"avih", at + 12, at + 8 + n)
            if k >= 0:
                micros = struct.unpack_from("<I", avi, k + 8)[0]
        elif tag == b"LIST" and kind == b"movi":
            movi = (at + 8, at + 8 + n)
        elif tag == b"idx1":
            index = avi[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no movi list")
    out = []
    if index is not None:
        entries = list(struct.iter_unpack("<4sIII", index))
        start = movi[0]
        if entries and avi[start + entries[0][2] : start + entries[0][2] + 4] != entries[0][0]:
            start = 0  # some writers count from the file's start
        for tag, _, off, n in entries:
            if tag[2:] in (b"dc", b"db"):
                out.append(avi[start + off + 8 : start + off + 8 + n])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            tag, n = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
            if tag[2:] in (b"dc", b"db"):
                out.append(avi[at + 8 : at + 8 + n])
            at += 8 + n + (n & 1)
    return out, micros


_RST = re.compile(rb"\xff[\xd0-\xd7]")


def parse_jpeg(frame: bytes) -> dict:
    """Markers of a baseline grey JPEG: size, tables, restart interval, comment, unstuffed restart segments."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    x: dict = {"dc": None, "ac": None, "every": 0, "comment": b"", "quant": {}}
    tables, at = {}, 2
    while True:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC0:
            depth, x["height"], x["width"], parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only 8-bit grey frames")
            x["q"] = body[8]
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                m = sum(counts)
                tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + m]))
                k += 17 + m
        elif marker == 0xDB:
            for k in range(0, len(body), 65):
                x["quant"][body[k] & 15] = bytes(body[k + 1 : k + 65])
        elif marker == 0xDD:
            x["every"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            x["comment"] = body
        elif marker == 0xDA:
            x["dc"], x["ac"] = tables[body[2] >> 4], tables[0x10 | (body[2] & 15)]
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames")
    end = frame.rfind(b"\xff\xd9")
    scan = frame[at : end if end >= at else len(frame)]
    x["segments"] = [s.replace(b"\xff\x00", b"\xff") for s in (_RST.split(scan) if x["every"] else [scan])]
    rows = used_rows(x)  # filler after the payload needs no decoding
    x["decode"] = rows if x["every"] else None
    x["blocks"] = ((x["height"] + 7) // 8) * ((x["width"] + 7) // 8)
    return x


@lru_cache(maxsize=64)
def flat_lookup(dc: tuple, ac: tuple) -> np.ndarray:
    """For each 16-bit peek that starts with the whole of a flat block (DC code, its bits, end of block): bits << 16 | difference + 32768; else 0."""
    peek = np.arange(1 << 16, dtype=np.int64)
    first = lookup(*dc)
    length, size = first >> 8, first & 255
    used = length + size
    extra = ((peek << length) & 0xFFFF) >> (16 - np.minimum(size, 16))
    value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
    after = lookup(*ac)[(peek << np.minimum(used, 16)) & 0xFFFF]
    whole = used + (after >> 8)
    good = (length > 0) & (after > 0) & (after & 255 == 0) & (whole <= 16)
    return np.where(good, whole << 16 | (value + 32768), 0)


def decode_flat(segments: list[bytes], blocks: int, dc: tuple, ac: tuple) -> np.ndarray | None:
    """DC of every block of segments with ``blocks`` blocks each, or None if some block isn't flat or is coded longer."""
    table = flat_lookup(dc, ac)
    raw = np.frombuffer(b"".join(segments) + b"\xff" * 4, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 16) | (raw[1:-2] << 8) | raw[2:-1]
    pos = np.cumsum([0, *map(len, segments[:-1])]) * 8
    out = np.empty((blocks, len(segments)), np.int32)
    for k in range(blocks):
        at = pos >> 3
        if k and at.max() >= len(window):
            return None
        found = table[(window[at] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF]
        if not found.all():
            return None
        out[k] = found & 0xFFFF
        pos = pos + (found >> 16)
    out -= 32768
    return np.cumsum(out, axis=0, dtype=np.int32).T.ravel()


def decode_segments(segments: list[bytes], blocks: np.ndarray, dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of all segments in lock step: DC of every block, and (block, place in zigzag order, value) of the others."""
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    raw = np.frombuffer(b"\xff".join(segments) + b"\xff" * 9, np.uint8).astype(np.uint64)
    window = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        window |= raw[k : k + len(window)] << np.uint64(56 - 8 * k)
    codes = np.concatenate((lookup(*dc), lookup(*ac)))
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(first[-1]), np.int32)
    acs: list[tuple] = []
    live = np.flatnonzero(blocks > 0)
    pos, block, last = starts[live] * 8, first[live].copy(), first[live + 1]
    k, pred = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    while len(live):
        w = window[pos >> 3] << (pos & 7).astype(np.uint64)
        sym = codes[(w >> np.uint64(48)).astype(np.int64) + ((k > 0) << 16)]
        length, sym = sym >> 8, sym & 255
        if not length.all():
            raise ValueError("bad Huffman code")
        size, run = sym & 15, sym >> 4
        # two shifts: a shift by 64 is undefined where the size is 0
        extra = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        pos = pos + length + size
        is_dc = k == 0
        pred = np.where(is_dc, pred + value, pred)
        out[block[is_dc]] = pred[is_dc]
        if not is_dc.all():
            put = ~is_dc & (size > 0)
            if put.any():
                acs.append((block[put], (k + run)[put], value[put]))
            ended = ~is_dc & (sym == 0)
            k = np.where(is_dc, 1, np.where(ended, 64, k + run + 1))
        else:
            k = np.ones_like(k)
        over = k >= 64
        if over.any():
            block = block + over
            k = np.where(over, 0, k)
            stay = block < last
            if not stay.all():
                live, pos, block, last, k, pred = live[stay], pos[stay], block[stay], last[stay], k[stay], pred[stay]
    where = np.concatenate([x[0] for x in acs]) if acs else np.zeros(0, np.int64)
    place = np.concatenate([x[1] for x in acs]) if acs else np.zeros(0, np.int64)
    what = np.concatenate([x[2] for x in acs]) if acs else np.zeros(0, np.int64)
    return out, where, place, what


def block_samples(frames: list[dict]) -> list[np.ndarray]:
    """Decoded samples of each frame: (blocks, 64), or (blocks, 1) where every block is flat."""
    out: list = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(frames):
        groups.setdefault((x["dc"], x["ac"], x["quant"][x["q"]]), []).append(i)
    for (dc, ac, quant), own in groups.items():
        segments, counts = [], []
        for i in own:
            x = frames[i]
            every = x["every"] or x["blocks"]
            n = [min(every, x["blocks"] - j) for j in range(0, x["blocks"], every)][: x["decode"]]
            segments += x["segments"][: len(n)]
            counts += n
        flat = decode_flat(segments, counts[0], dc, ac) if min(counts) == max(counts) else None
        where = place = what = np.zeros(0, np.int64)
        if flat is None:
            flat, where, place, what = decode_segments(segments, np.array(counts), dc, ac)
        q = np.frombuffer(quant, np.uint8).astype(np.int64)
        if len(where):
            coefs = np.zeros((len(flat), 64))
            coefs[:, 0] = flat * q[0]
            coefs[where, zigzag()[place]] = what * q[place]
            samples = coefs @ dct_basis() + 128
        else:
            samples = (flat[:, None] * q[0]) / 8.0 + 128
        samples = np.clip(np.rint(samples), 0, 255).astype(np.uint8)
        at = 0
        for i in own:
            every = frames[i]["every"] or frames[i]["blocks"]
            n = frames[i]["blocks"] if frames[i]["decode"] is None else min(frames[i]["blocks"], frames[i]["decode"] * every)
            out[i] = samples[at : at + n]
            at += n
    return out


def used_rows(frame: dict) -> int | None:
    m = re.fullmatch(rb"rows=(\d+)", frame["comment"])
    return int(m[1]) if m else None


def shots(histograms: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.15) -> list[int]:
    """First frames of shots. A cut is where half the L1 distance of neighbouring histograms is at least ``least`` and
    above mean + ``factor`` deviations of the differences since the last cut (the last ``window`` of them)."""
    cuts, recent = [0], []
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    steps = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    for t, d in enumerate(steps.tolist(), 1):
        if recent:
            mean = sum(recent) / len(recent)
            spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5
        else:
            mean = spread = 0.0
        if d >= least and d > mean + factor * spread:
            cuts.append(t)
            recent = []
        else:
            recent = [*recent[-(window - 1) :], d]
    return cuts


def decode(files: list[bytes]) -> list[dict]:
    """Of each AVI file: payload (bytes read back, of files written here), frame count, microseconds a frame, histograms (32 bins), first frames of shots."""
    parsed, spans, out = [], [], []
    for f in files:
        frames, micros = frames_of(f)
        spans.append((len(parsed), len(parsed) + len(frames), micros))
        parsed += [parse_jpeg(x) for x in frames]
    pixels = block_samples(parsed)
    for i, j, micros in spans:
        parts, hist = [], np.zeros((j - i, 32), np.int64)
        for k in range(i, j):
            rows, p = used_rows(parsed[k]), pixels[k]
            if rows is not None:
                p = p[: rows * ((parsed[k]["width"] + 7) // 8)]
                parts.append(p[:, 0].tobytes())
            hist[k - i] = np.bincount(p.ravel() >> 3, minlength=32)
        out.append({"payload": b"".join(parts), "frames": j - i, "micros": micros, "histograms": hist, "shots": shots(hist) if j > i else []})
    return out


def feature(x: dict) -> str:
    """Frames, shots, their first frames (as a crc32) and the clip's coarse histogram, in whole numbers only."""
    total = x["histograms"].sum(axis=0)
    cuts = zlib.crc32(",".join(map(str, x["shots"])).encode())
    return f"frames={x['frames']};shots={len(x['shots'])};cuts={cuts:08x};hist=" + ".".join(map(str, total.reshape(8, 4).sum(axis=1).tolist()))


def _grouped(payloads: list[bytes]):
    at, size = 0, 0
    for i, p in enumerate(payloads):
        if size and size + len(p) > GROUP_BYTES:
            yield at, i
            at, size = i, 0
        size += len(p)
    if at < len(payloads):
        yield at, len(payloads)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each whole text as a motion-JPEG clip, reads it back and returns its digest row.

    Null texts count as empty; an empty text is one unit of zero bytes. Repeated rows give equal rows. Other columns
    are ignored, so clashing names do no harm. An empty table gives no rows. A row per document; no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column(1))
        payloads = [padded(t) for t in texts]
        rows: list[tuple] = []
        for i, j in _grouped(payloads):
            files = encode(payloads[i:j])
            for media, x in zip(files, decode(files), strict=True):
                back = x["payload"]
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(x)))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch(
            [batch.column(0), pa.array(map(len, texts), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    kind = dict(docs.dtypes)[key]
    return by_batch(docs.select(key, text), run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clip_rows(media: DataFrame, key: str, column: str) -> DataFrame:
    """Timed clip rows of AVI files in a binary column: key, shot, start_ms, end_ms, n_frames. Null files give no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, rows = batch.column(0).to_pylist(), []
        for k, f in zip(keys, batch.column(1).to_pylist(), strict=True):
            if f is None:
                continue
            x = decode([f])[0]
            ends = [*x["shots"][1:], x["frames"]]
            rows += [(k, i, s * x["micros"] / 1000, e * x["micros"] / 1000, e - s) for i, (s, e) in enumerate(zip(x["shots"], ends, strict=True))]
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(c[0], batch.schema.field(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.int32())], names=[key, "shot", "start_ms", "end_ms", "n_frames"])

    return by_batch(media.select(key, column), run, f"`{key}` {dict(media.dtypes)[key]}, shot int, start_ms double, end_ms double, n_frames int")
