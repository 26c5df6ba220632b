"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

``inspect`` reads any MPEG 1, 2 or 2.5 audio stream of layers I to III: it skips and reads ID3v2 tags,
finds frame headers again after damage or foreign bytes, reads Xing, Info and VBRI tables and the
encoder's delay and padding, verifies the 16-bit checksums of all layers, and gives durations as whole
samples and the byte offset of every frame. Tags are ID3v2.2 to 2.4 (with extended headers and footers),
APE and ID3v1. Free-format frames (no bitrate in the header) count as foreign bytes.

``store`` puts any bytes into a valid layer III stream without loss: silent frames of 672 bytes
(224 kbit/s at 48 kHz, with checksum), each of which carries 576 bytes as ancillary data, an Info
table, an ID3v2 tag that says how many bytes count, and an ID3v1 tag.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from lodegrid.llm.common import cut, fields, free_name, table, tidied, with_text

UNIT = 576
#: Fixed values of ISO 11172-3 and 13818-3: kbit/s by (version 1?, layer) and index, and Hz by version and index.
_KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Header:
    """What four header bytes say."""

    __slots__ = ("layer", "rate", "kbits", "size", "samples", "side", "checked", "kind", "channels", "bound", "first")


@functools.lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The header of a frame, or None if the bytes are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, hertz = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or hertz == 3 or four[3] & 3 == 2:
        return None
    h, first = Header(), version == 3
    h.layer, h.rate, h.kbits = layer, _HERTZ[version][hertz], _KBITS[first, layer][index]
    pad, mono = four[2] >> 1 & 1, four[3] >> 6 == 3
    h.samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    h.size = (12000 * h.kbits // h.rate + pad) * 4 if layer == 1 else h.samples // 8 * 1000 * h.kbits // h.rate + pad
    h.side = (17 if mono else 32) if first else (9 if mono else 17)
    h.checked = not four[1] & 1
    h.kind = (version, layer, hertz)
    h.first, h.channels = first, 1 if mono else 2
    # from this subband on both channels share their allocation (joint stereo)
    h.bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32
    return h


@functools.lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


@functools.lru_cache(4096)
def crc16(data: bytes, bits: int = 0) -> int:
    """The frame checksum of ``data`` and of its first ``bits`` bits where given: polynomial 0x8005, start
    0xFFFF, high bit first."""
    crc, steps = 0xFFFF, _crc_table()
    whole = bits // 8 if bits else len(data)
    for byte in data[:whole]:
        crc = (crc << 8 & 0xFFFF) ^ steps[crc >> 8 ^ byte]
    for i in range(bits % 8 if bits else 0):
        one = crc >> 15 ^ data[whole] >> 7 - i & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if one else 0)
    return crc


#: Fixed values of ISO 11172-3 and 13818-3: bits of a layer II allocation by table, as (subbands from 0 on, bits).
_ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: Header) -> list[int]:
    """The bits of each subband's allocation in a layer II frame."""
    each = h.kbits // h.channels
    if not h.first:
        kind = "low"
    elif each <= 48:
        kind = "d" if h.rate == 32000 else "c"
    else:
        kind = "a" if h.rate == 48000 or each <= 80 else "b"
    return [bits for n, bits in _ALLOCATION[kind] for _ in range(n)]


def protected(frame: bytes, h: Header) -> int:
    """How many bits after the checksum it covers (it begins with the header's last two bytes)."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        shared = min(h.bound, 32) if h.channels == 2 else 32
        return 4 * (shared * h.channels + 32 - shared)
    value, at, selected = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 512, 0
    for band, bits in enumerate(_allocation(h)):
        for _ in range(h.channels if band < h.bound else 1):
            at -= bits
            if value >> at & (1 << bits) - 1:
                selected += 1 if band < h.bound else h.channels
    return 512 - at + 2 * selected


def checksum_holds(frame: bytes, h: Header) -> bool:
    bits = protected(frame, h)
    covered = frame[2:4] + frame[6 : 6 + -(-bits // 8)]
    return 16 + bits <= 8 * len(covered) and crc16(covered, 16 + bits) == int.from_bytes(frame[4:6], "big")


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, bytes]]:
    """The end of an ID3v2 tag at ``at`` (``at`` itself without one) and its frames."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    version, flags = data[at + 3], data[at + 5]
    end = min(len(data), at + 10 + _synchsafe(data[at + 6 : at + 10]))
    found, pos = {}, at + 10
    if flags & 0x40 and version >= 3 and pos + 4 <= end:  # an extended header; version 3 does not count its size field
        pos += _synchsafe(data[pos : pos + 4]) if version >= 4 else 4 + int.from_bytes(data[pos : pos + 4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while pos + head <= end and data[pos : pos + name].isalnum():
        four = data[pos + name : pos + head][: 3 if version == 2 else 4]
        size = _synchsafe(four) if version >= 4 else int.from_bytes(four, "big")
        if pos + head + size > end:
            break
        found[data[pos : pos + name].decode("latin-1")] = data[pos + head : pos + head + size]
        pos += head + size
    footer = 10 if version >= 4 and flags & 0x10 and data[end : end + 3] == b"3DI" else 0
    return end + footer, found


def ape(data: bytes, end: int) -> tuple[int, dict[str, bytes]]:
    """The start of an APE tag that ends at ``end`` (``end`` itself without one) and its items."""
    foot = data[end - 32 : end] if end >= 32 else b""
    if foot[:8] != b"APETAGEX":
        return end, {}
    _, size, count, flags = struct.unpack("<IIII", foot[8:24])
    start = end - size - (32 if flags >> 31 else 0)
    if size < 32 or start < 0:
        return end, {}
    found, pos, last = {}, end - size, end - 32
    for _ in range(count):
        stop = data.find(b"\0", pos + 8, last)
        if stop < 0:
            break
        length = int.from_bytes(data[pos : pos + 4], "little")
        if stop + 1 + length > last:
            break
        found[data[pos + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + length]
        pos = stop + 1 + length
    return start, found


def variable_table(frame: bytes, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in a frame: kind, frames, bytes, the seek table, delay and padding."""
    at = 4 + 2 * h.checked + h.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0}
        flags, pos = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                value, pos = frame[pos : pos + size], pos + size
                if name in ("frames", "bytes"):
                    out[name] = int.from_bytes(value, "big")
                elif name == "toc":
                    out[name] = list(value)
        if frame[pos : pos + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= pos + 24:
            three = frame[pos + 21 : pos + 24]
            out["delay"], out["padding"] = three[0] << 4 | three[1] >> 4, (three[1] & 15) << 8 | three[2]
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        toc = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "delay": 0, "padding": 0}
    return None


def inspect(data: bytes) -> dict:
    """All that the module reads from a stream; empty or foreign bytes give zero frames."""
    size = len(data)
    end = size - 128 if data[-128:-125] == b"TAG" and size >= 128 else size
    has_id3v1 = end < size
    end, items = ape(data, end)
    at, tags = id3v2(data, 0)
    offsets: list[int] = []
    samples = checked = right = skipped = 0
    kinds: set[tuple] = set()
    rates: set[int] = set()
    table_, rate, synced = None, 0, False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= end
        if fits and not synced:
            # after foreign bytes a header counts only if another of its kind, or the end, follows
            follower = header(data[at + h.size : at + h.size + 4])
            fits = at + h.size == end or follower is not None and follower.kind == h.kind
        if not fits:
            jump, more = id3v2(data, at)
            if jump > at:
                tags, at = more | tags, jump
                continue
            synced = False
            found = data.find(b"\xff", at + 1, end)
            skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        synced = True
        if h.checked:
            checked += 1
            right += checksum_holds(data[at : at + min(h.size, 70)], h)
        if not offsets and table_ is None and h.layer == 3 and (table_ := variable_table(data[at : at + h.size], h)):
            table_["offset"] = at
        else:
            offsets.append(at)
            samples += h.samples
            kinds.add(h.kind)
            rates.add(h.kbits)
            rate = rate or h.rate
        at += h.size
    skipped += max(0, end - at)
    cut_ = (table_["delay"] + table_["padding"]) if table_ else 0
    return {
        "tags": tags,
        "ape": items,
        "id3v1": has_id3v1,
        "table": table_,
        "offsets": offsets,
        "samples": max(0, samples - cut_),
        "rate": rate,
        "kbits": sorted(rates),
        "uniform": len(kinds) <= 1,
        "checked": checked,
        "right": right,
        "skipped": skipped,
    }


_HEAD = b"\xff\xfa\xc4\x00"
_SIDE = bytes(32)
_FRAME, _START = 672, 4 + 2 + 32


def _frame(body: bytes) -> bytes:
    return _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2, "big") + _SIDE + body.ljust(_FRAME - _START, b"\0")


def store(data: bytes) -> bytes:
    """``data``, filled with bytes 255 to a positive multiple of 576, as an MPEG audio stream."""
    n = len(data)
    payload = data.ljust(max(UNIT, -(-n // UNIT) * UNIT), b"\xff")
    frames = len(payload) // UNIT
    text = b"\x00bytes\x00" + str(n).encode()
    tag = b"TXXX" + bytes([0, 0, len(text) >> 7, len(text) & 127]) + b"\0\0" + text
    size = len(tag)
    lead = b"ID3\x04\x00\x00" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag
    toc = bytes(min(255, i * 256 // 100) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, frames, (frames + 1) * _FRAME) + toc
    body = [_frame(payload[i : i + UNIT]) for i in range(0, len(payload), UNIT)]
    return b"".join([lead, _frame(info), *body, b"TAG".ljust(128, b"\0")])


def payload(media: bytes, seen: dict | None = None) -> bytes:
    """The bytes that ``store`` put in, filled up, read from the frames by their offsets."""
    offsets = (seen or inspect(media))["offsets"]
    return b"".join([media[o + _START : o + _START + UNIT] for o in offsets])


def unpadded(seen: dict) -> int:
    return int(seen["tags"]["TXXX"].rpartition(b"\0")[2])


def text_to_media(df: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """``df`` with each whole text (null: empty) as a stored stream; ``out_col`` replaces a column of that name."""
    name = free_name(df, "_media")
    made = with_text(df, text_col, lambda texts: [pa.array([store((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], f"{name} binary")
    return made.drop(out_col).withColumnRenamed(name, out_col)


AUDIO = fields("duration_samples long", "sample_rate int", "frames long", "kbits array<int>", "table string", "checked long", "checked_right long", "skipped_bytes long", "has_id3v2 boolean", "has_id3v1 boolean", "frame_offsets array<long>")


def with_audio(df: DataFrame, media_col: str = "media", out_col: str = "audio") -> DataFrame:
    """``df`` and what each stream holds, as a struct; null media give null. ``out_col`` replaces a column of that name."""
    name = free_name(df, "_audio")

    def run(streams: list[bytes | None]) -> list[pa.Array]:
        rows = []
        for data in streams:
            s = None if data is None else inspect(data)
            rows.append(
                s
                and {
                    "duration_samples": s["samples"],
                    "sample_rate": s["rate"],
                    "frames": len(s["offsets"]),
                    "kbits": s["kbits"],
                    "table": s["table"] and s["table"]["kind"],
                    "checked": s["checked"],
                    "checked_right": s["right"],
                    "skipped_bytes": s["skipped"],
                    "has_id3v2": bool(s["tags"]),
                    "has_id3v1": s["id3v1"],
                    "frame_offsets": s["offsets"],
                }
            )
        return [pa.array(rows, to_arrow_type(AUDIO))]

    made = with_text(df, media_col, run, T.StructField(name, AUDIO))
    return made.drop(out_col).withColumnRenamed(name, out_col)


_DIGEST = fields("doc_id long", "n_bytes long", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long", "media_sha256 string", "feature string")


def _summary(media: bytes) -> tuple:
    """The digest columns of one stream, all read from its bytes."""
    s = inspect(media)
    p = payload(media, s)
    seek = zlib.crc32(struct.pack(f"<{len(s['offsets'])}q", *s["offsets"]))
    feature = f"samples={s['samples']};rate={s['rate']};frames={len(s['offsets'])};table={s['table']['kind']}:{s['table']['frames']};crc={s['right']}/{s['checked']};skipped={s['skipped']};seek={seek:08x}"
    return unpadded(s), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, media) to the digest columns."""
    kinds = [f.type for f in to_arrow_schema(_DIGEST)][1:]
    for whole in batches:
        for batch in cut(whole, 1):
            rows = [_summary(media) for media in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=_DIGEST.names)


def digest(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)
    from (doc_id, media): everything is read from the stored bytes."""
    return df.select(F.col("doc_id").cast("long"), "media").mapInArrow(tidied(_digests), _DIGEST)


def text_digest(df: DataFrame) -> DataFrame:
    """The same from (doc_id, text): each slice of texts is stored as streams and read back in one worker,
    so a task needs one Python process and holds the streams of one slice."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, 1, 2 << 20):
                media = [store((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(lambda batches: _digests(stored(batches))), _DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every text of ``documents``."""
    return text_digest(table(spark, sf_dir, "documents"))
