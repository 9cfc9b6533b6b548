"""Media columns of MPEG audio.

write_stream() stores bytes losslessly in a variable-bitrate MPEG-1 Layer III stream: a tag,
a frame with the variable-bitrate table, then frames whose main data (8-bit units) carry the
payload while the side information says silence. read_stream() reads any stream of MPEG-1, 2
or 2.5, Layers I to III: it skips and parses tags, finds the first frame header, follows
frame lengths, resynchronises behind junk, parses the variable-bitrate table (Xing, Info or
VBRI), verifies the frame checksums of all layers, and gives the exact duration (samples over
rate, as a fraction) and each frame's byte offset.

Null and empty texts are stored as 64 zero bytes. Damaged streams give what can be read:
junk bytes and failing checksums are counted. A null stream has null features. Repeated
rows are answered one by one; an empty table gives an empty result; other columns are left
out.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrand.llm.common import arrow_map, documents, id_and_text

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and header index 1..14, sample rates by version.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    """What a frame's four header bytes say."""

    length: int
    samples: int
    rate: int
    kbits: int
    layer: int
    mono: bool
    one: bool  # MPEG-1
    protected: bool
    bound: int = 32  # the first subband whose allocation both channels share

    @property
    def widths(self) -> tuple[int, ...]:
        """Bits of each subband's allocation in Layers I and II."""
        if self.layer == 1:
            return (4,) * 32
        if not self.one:
            return (4,) * 4 + (3,) * 7 + (2,) * 19
        each = self.kbits if self.mono else self.kbits // 2
        if each <= 48:
            return (4,) * 2 + (3,) * (10 if self.rate == 32000 else 6)
        return (4,) * 11 + (3,) * 12 + (2,) * (4 if self.rate == 48000 or each <= 80 else 7)

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return ((17 if self.mono else 32) if self.one else (9 if self.mono else 17)) if self.layer == 3 else 0


@cache
def header(word: int) -> Header | None:
    """Parses four header bytes as an integer; None where they are none (free-format frames are not supported)."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    one, hertz, pad = version == 3, RATES[version][rate], word >> 9 & 1
    kbits = KBITS[one, layer][index - 1]
    if layer == 1:
        length, samples = (12_000 * kbits // hertz + pad) * 4, 384
    else:
        samples = 1152 if one or layer == 2 else 576
        length = samples // 8 * 1000 * kbits // hertz + pad
    return Header(length, samples, hertz, kbits, layer, word >> 6 & 3 == 3, one, not word >> 16 & 1, 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32)


def _table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return tuple(out)


_CRC = _table()


@cache
def checksum(protected: bytes) -> int:
    """The format's CRC-16 over header bytes 2 and 3 and the side information."""
    x = 0xFFFF
    for b in protected:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ b]
    return x


def _bit_checksum(bits: str) -> int:
    x = 0xFFFF
    for b in bits:
        x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15) ^ (b == "1") else 0)
    return x


def frame_checksum(data: bytes, at: int, h: Header) -> int:
    """What the checksum of the protected frame at `at` should be: over header bytes 2 and 3, and the side information (Layer III), the allocation (I), or the allocation and the scale factor selection (II)."""
    body = at + 6
    if h.layer == 3:
        return checksum(data[at + 2 : at + 4] + data[body : body + h.side])
    bits = "".join(f"{b:08b}" for b in data[body : min(at + h.length, body + 72)])
    place, used = 0, 0  # allocated subbands, counted by channel
    channels = 1 if h.mono else 2
    for k, width in enumerate(h.widths):
        for _ in range(1 if k >= h.bound else channels):
            if "1" in bits[place : place + width]:
                used += channels if k >= h.bound else 1
            place += width
    if h.layer == 2:
        place += 2 * used
    return _bit_checksum("".join(f"{b:08b}" for b in data[at + 2 : at + 4]) + bits[:place])


# MPEG-1 Layer III, checksum present, 32 kHz, mono: the frames that write_stream() uses.
_OVER = 4 + 2 + 17


@cache
def _frames() -> tuple[tuple[int, int], ...]:
    """(frame length, header word) from the shortest, without padding bit."""
    words = [0xFFFA08C0 | k << 12 for k in range(1, 15)]
    return tuple(sorted((header(w).length, w) for w in words))


@cache
def _head(word: int) -> bytes:
    """Header, checksum and silent side information."""
    first = struct.pack(">I", word)
    side = bytes(17)
    return first + struct.pack(">H", checksum(first[2:] + side)) + side


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _text_frame(name: bytes, value: str) -> bytes:
    body = b"\x03" + value.encode()
    return name + _syncsafe(len(body)) + b"\0\0" + body


def write_stream(payload: bytes, notes: dict[str, str]) -> bytes:
    """The payload as a stream; notes go into the tag as user text frames."""
    sizes = _frames()
    longest, word = sizes[-1]
    room, frames, at = longest - _OVER, [], 0
    while len(payload) - at > room:
        frames.append(_head(word) + payload[at : at + room])
        at += room
    length, word = next(x for x in sizes if x[0] - _OVER >= len(payload) - at)
    frames.append((_head(word) + payload[at:]).ljust(length, b"\0"))
    table_length, table_word = next(x for x in sizes if x[0] - _OVER >= 120)
    total = table_length + sum(map(len, frames))
    ends, place = [], table_length
    for f in frames:
        ends.append(place)
        place += len(f)
    seek = bytes(ends[i * len(frames) // 100] * 256 // total for i in range(100))
    table = (_head(table_word) + b"Xing" + struct.pack(">III", 15, len(frames), total) + seek + bytes(4)).ljust(table_length, b"\0")
    tag = b"".join(_text_frame(b"TXXX", f"{k}\0{v}") for k, v in notes.items())
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + table + b"".join(frames)


@dataclass
class Stream:
    """What read_stream() found."""

    notes: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    seconds: dict[int, int] = field(default_factory=dict)  # samples by rate
    kbits: dict[int, int] = field(default_factory=dict)
    bad_checksums: int = 0
    unprotected: int = 0
    resyncs: int = 0
    junk: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    table_right: bool | None = None
    main: list[bytes] = field(default_factory=list)


def _tag(data: bytes, out: Stream) -> int:
    """Parses an ID3v2 tag (2.2 to 2.4, with extended header and unsynchronisation) at the start; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, flags = data[3], data[5]
    end = min(10 + safe(data[6:10]), len(data))
    held, at = data[10:end], 0
    if flags & 128 and version < 4:
        held = held.replace(b"\xff\0", b"\xff")
    if flags & 64 and version > 2 and len(held) >= 4:  # of 2.3 its size leaves the size field out
        at = safe(held[:4]) if version >= 4 else 4 + int.from_bytes(held[:4], "big")
    head, letters = (6, 3) if version == 2 else (10, 4)
    while at + head <= len(held) and held[at : at + letters].strip(b"\0"):
        name = held[at : at + letters].decode("latin-1")
        size = int.from_bytes(held[at + 3 : at + 6], "big") if version == 2 else safe(held[at + 4 : at + 8]) if version >= 4 else int.from_bytes(held[at + 4 : at + 8], "big")
        body = held[at + head : at + head + size]
        if version >= 4 and held[at + 9] & 2:
            body = body[4 if held[at + 9] & 1 else 0 :].replace(b"\xff\0", b"\xff")
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
            key, _, value = text.partition("\0")
            own = name in ("TXXX", "TXX")
            out.notes[key if own else name] = value.rstrip("\0") if own else key
        at += head + size
    return end + (10 if flags & 16 else 0)


def _at(data: bytes, at: int, end: int, tag: int) -> Header | None:
    """The header at `at`; a frame over what may be a closing tag counts if the stream ends there or another frame follows."""
    if at + 4 > end:
        return None
    h = header(int.from_bytes(data[at : at + 4], "big"))
    if h is None or at + h.length > end:
        return None
    over = at < tag < at + h.length < end
    return None if over and _at(data, at + h.length, end, end) is None else h


def read_stream(data: bytes) -> Stream:
    """Reads a stream; frames that don't follow one another are searched for behind the junk."""
    out = Stream()
    at, end = _tag(data, out), len(data)
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end  # a closing tag only if no frame holds these bytes
    start, first, seek, steps = at, True, b"", None
    while at < end:
        h = _at(data, at, end, tag)
        if h is None:
            seen, stop = at, tag if at <= tag else end
            while (at := data.find(b"\xff", at + 1, stop)) >= 0:  # a header counts if another follows its frame or the stream ends there
                h = _at(data, at, end, tag)
                if h and (at + h.length in (tag, end) or _at(data, at + h.length, end, tag)):
                    break
            if at < 0:
                out.junk += stop - seen
                end = stop
                break
            out.junk += at - seen
            out.resyncs += 1
        body = at + (6 if h.protected else 4)
        if not h.protected:
            out.unprotected += 1
        elif frame_checksum(data, at, h) != int.from_bytes(data[at + 4 : at + 6], "big"):
            out.bad_checksums += 1
        main = body + h.side
        if first and data[main : main + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[main + 4 : main + 8], "big"), main + 8
            if flags & 1:
                out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            seek, start = data[p : p + 100] if flags & 4 else b"", at
        elif first and data[at + 36 : at + 40] == b"VBRI" and at + 62 <= end:
            out.table_bytes, out.table_frames = struct.unpack(">II", data[at + 46 : at + 54])
            many, scale, width, each = struct.unpack(">HHHH", data[at + 54 : at + 62])
            cells = [int.from_bytes(data[p : p + width], "big") * scale for p in range(at + 62, min(at + 62 + many * width, at + h.length), max(width, 1))]
            seek, start, steps = b"", at, (cells, each)
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.seconds[h.rate] = out.seconds.get(h.rate, 0) + h.samples
            out.rate = out.rate or h.rate
            out.kbits[h.kbits] = out.kbits.get(h.kbits, 0) + 1
            out.main.append(data[main : at + h.length])
        first = False
        at += h.length
    if end < len(data):
        out.notes.setdefault("TIT2", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip())
    if steps is not None:
        cells, each = steps  # each cell has the bytes of so many frames; the frame with the table may be counted or not
        place, ends = start, set(out.offsets) | {end, start}
        n, fits = len(out.offsets), True
        for cell in cells:
            place += cell
            fits &= place in ends or place >= end
        out.table_right = fits and out.table_frames in (n, n + 1) and out.table_bytes == end - start
    elif out.table_frames is not None:
        n = len(out.offsets)
        right = n == out.table_frames and out.table_bytes in (None, end - start)
        out.table_right = right and (not seek or seek == bytes((out.offsets[i * n // 100] - start) * 256 // (end - start) for i in range(100)))
    return out


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """Columns id and media: each text's UTF-8 bytes, filled up with zero bytes to a positive multiple of `unit`, as a stream."""

    def each(batch: pa.RecordBatch) -> dict[str, object]:
        made = []
        for x in batch.column(1).cast(pa.binary()).to_pylist():
            x = x or b""
            size = max(unit, -(-len(x) // unit) * unit)
            made.append(write_stream(x.ljust(size, b"\0"), {"text_bytes": str(len(x)), "payload_bytes": str(size)}))
        return {"id": batch.column(0), "media": made}

    return arrow_map(id_and_text(df, id_col, text_col), each, "id long, media binary")


FEATURES = (
    "struct<tags: map<string, string>, frames: int, samples: long, rate: int, duration: struct<numerator: long, denominator: long>, duration_us: long, kbits: map<int, int>, bad_checksums: int, "
    "unprotected: int, resyncs: int, junk_bytes: long, table_frames: int, table_right: boolean, seek_offsets: array<long>>"
)


def _features(s: Stream) -> dict[str, object]:
    seconds = sum((Fraction(n, rate) for rate, n in s.seconds.items()), Fraction(0))
    return {
        "tags": list(s.notes.items()), "frames": len(s.offsets), "samples": s.samples, "rate": s.rate,
        "duration": {"numerator": seconds.numerator, "denominator": seconds.denominator}, "duration_us": int(seconds * 1_000_000), "kbits": sorted(s.kbits.items()), "bad_checksums": s.bad_checksums,
        "unprotected": s.unprotected, "resyncs": s.resyncs, "junk_bytes": s.junk, "table_frames": s.table_frames, "table_right": s.table_right, "seek_offsets": s.offsets,
    }


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns of `df`, payload and features (duration is exact, in seconds as a fraction in lowest terms; duration_us is rounded down).

    Columns of `df` that are named payload or features give way to the new ones.
    """
    names = [c for c in df.columns if c not in (media_col, "payload", "features")]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("payload", T.BinaryType()), *T.StructType.fromDDL(f"features {FEATURES}")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                part = whole.slice(lo, 500)
                payloads, rows = [], []
                for data in part.column(len(names)).to_pylist():
                    s = None if data is None else read_stream(data)
                    main = s and b"".join(s.main)
                    size = s.notes.get("payload_bytes", "") if s else ""
                    payloads.append(main[: int(size)] if size.isdigit() else main)
                    rows.append(s and _features(s))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(payloads, pa.binary()), pa.array(rows, arrow.field("features").type)], schema=arrow)

    return df.select(*names, media_col).mapInArrow(run, schema)


def op1_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns: all documents stored as streams, and read back from the stored bytes."""
    media = to_media(documents(spark, sf_dir))
    back = read_media(media.select("id", F.octet_length("media").cast("long").alias("bytes"), F.sha2("media", 256).alias("sha"), "media"))
    f = F.col("features")
    join = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("x", e["key"].cast("string"), e["value"].cast("string"))), ",")
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), f["frames"]), F.concat(F.lit("samples="), f["samples"]), F.concat(F.lit("rate="), f["rate"]), F.concat(F.lit("kbits="), join(f["kbits"])),
        F.concat(F.lit("bad="), f["bad_checksums"]), F.concat(F.lit("junk="), f["junk_bytes"]), F.concat(F.lit("table="), f["table_right"].cast("string")),
        F.concat(F.lit("seek="), F.crc32(F.array_join(f["seek_offsets"].cast("array<string>"), ","))),
    )
    return back.select(
        F.col("id").alias("doc_id"), f["tags"]["text_bytes"].cast("long").alias("n_bytes"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.col("bytes").alias("media_bytes"), F.col("sha").alias("media_sha256"), feature.alias("feature"),
        f["duration_us"].alias("duration_us"), f["seek_offsets"].alias("seek_offsets"),
    )
