"""Bounded-space online packing of token sequences.

Each input partition keeps a fixed number of open windows. A document's full windows are emitted at once; what is left
goes to the open window with the least room that still takes it (best fit); when none takes it, the fullest window is
emitted and a new one opened. What is open at a partition's end is merged: windows are dealt to bounded groups and
put together best fit decreasing, whole windows only. Token ids never leave the task that made them; only piece rows do.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, small_batches

SIZE = 1024
OPEN = 128  # windows that a partition keeps open
GROUP = 4096  # open windows, about, that one task merges
END = 0  # id after each document
MERGED = 1 << 62  # sequence ids of merged windows start here
SPACES = 20_000  # runs of white space from this length are cut off before the vocabulary's pattern, whose matcher fails on very long ones
#: The characters that the pattern takes for white space.
_WHITE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{SPACES},}}+")


@lru_cache(maxsize=2)
def encoder(ranks_path: str | None = None):
    """Text -> uint32 ids of the public byte-level vocabulary, as ``tokenizers`` gives them for byte_bpe_50k.json.

    The same vocabulary as ranks in tiktoken gives equal ids (held against each other in tests) at a fifth of the CPU
    time; the special token's string in a text becomes that token in both.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if len(text) < SPACES or not (runs := list(_SPACES.finditer(text))):
            return enc.encode_to_numpy(text, allowed_special="all")
        out, at = [], 0
        for m in runs:
            # the pattern makes one piece of a run of spaces, without its last one where something else follows
            end = m.end() - (m.end() < len(text))
            out += [enc.encode_to_numpy(text[at : m.start()], allowed_special="all"), np.array(enc._core_bpe.encode_single_piece(text[m.start() : end].encode()), np.uint32)]
            at = end
        return np.concatenate([*out, enc.encode_to_numpy(text[at:], allowed_special="all")])

    return encode


class Windows:
    """Open windows by room. ``place`` returns (window, offset there); windows that were emitted are in ``closed``."""

    def __init__(self, first_id: int, most: int = OPEN, size: int = SIZE):
        self.most, self.size, self.next = most, size, first_id
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.closed: list[int] = []

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        i = bisect.bisect_left(self.rooms, (n, -1))
        if i < len(self.rooms):
            room, w = self.rooms.pop(i)
        else:
            if len(self.rooms) >= self.most:
                self.closed.append(self.rooms.pop(0)[1])  # least room: the fullest
            room, w = self.size, self.fresh()
        if room > n:
            bisect.insort(self.rooms, (room - n, w))
        else:
            self.closed.append(w)
        return w, self.size - room


def merge(fills: list[tuple[int, int]], size: int = SIZE) -> list[tuple[int, int, int]]:
    """(window, fill) put together best fit decreasing: (window, bin, offset). Bins count from 0."""
    rooms: list[tuple[int, int]] = []
    out, bins = [], 0
    for fill, w in sorted(((f, w) for w, f in fills), key=lambda x: (-x[0], x[1])):
        i = bisect.bisect_left(rooms, (fill, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            room, b, bins = size, bins, bins + 1
        out.append((w, b, size - room))
        if room > fill:
            bisect.insort(rooms, (room - fill, b))
    return out


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Pieces with the window each lies in: ``left`` is null for emitted windows, else what the open window holds."""
    kind = dict(docs.dtypes)[key]
    small_batches(docs.sparkSession)
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "window", "offset"]

    def run(batches):
        encode = encoder(ranks_path)
        windows = Windows(TaskContext.get().partitionId() << 32)
        waiting: dict[int, list[tuple]] = {}  # rows of open windows
        key_type = pa.int64()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(c[0], key_type), *(pa.array(x, pa.int64()) for x in c[1:])], names=[*names, "left"])

        for b in batches:
            key_type = b.schema.field(0).type
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(t or ""), np.uint32(END)).astype("<u4")
                total, raw = len(ids), memoryview(ids.tobytes())
                for at in range(0, total, SIZE):
                    n = min(SIZE, total - at)
                    crc = zlib.crc32(raw[4 * at : 4 * (at + n)])
                    if n == SIZE:
                        rows.append((k, at, n, crc, total, windows.fresh(), 0, None))
                    else:
                        w, offset = windows.place(n)
                        waiting.setdefault(w, []).append((k, at, n, crc, total, w, offset, None))
                for w in windows.closed:
                    rows += waiting.pop(w)
                windows.closed.clear()
            if rows:
                yield table(rows)
        room_of = {w: room for room, w in windows.rooms}
        if waiting:
            yield table([(*r[:-1], SIZE - room_of[w]) for w, own in waiting.items() for r in own])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, left long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most 1024 ids: a row per piece.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur. Columns other than the
    two named are not read; an empty table gives no rows. Padding is up to 1024, none where a sequence's length is a
    power of two.
    """
    made, _ = materialise(pieces(docs, key, text, ranks_path), "pieces")
    open_ones = made.where("left is not null")
    windows = open_ones.where("offset = 0").select("window", "left")  # every window has one piece at 0
    groups = max(1, -(-windows.count() // GROUP))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        out = merge(list(zip(pdf["window"].tolist(), pdf["left"].tolist(), strict=True)))
        return pd.DataFrame([(w, MERGED + (g << 32) + b, o) for w, b, o in out], columns=["window", "sequence_id", "base"])

    merged = windows.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(groups))).groupBy("g").applyInPandas(together, "window long, sequence_id long, base long")
    same = [key, "start", "length", "ids_crc32", "doc_tokens"]
    whole = made.where("left is null").select(*same, F.col("window").alias("sequence_id"), "offset")
    joined = open_ones.join(merged, "window").select(*same, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return whole.unionByName(joined)
