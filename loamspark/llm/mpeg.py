"""Media columns of MPEG audio: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, durations and seek offsets."""

from __future__ import annotations

import functools
import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.common import read, with_arrow_columns

# Fixed values of the format: kbit/s by version group and layer, sample rates by version, samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

PAD = 64


@functools.lru_cache(4096)
def header(raw: bytes) -> tuple | None:
    """(frame bytes, samples, sample rate, kbit/s, has checksum, side-information bytes, layer) of four header bytes, or None."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    rate_at, bit_at = raw[2] >> 2 & 3, raw[2] >> 4
    if version is None or layer == 4 or rate_at == 3 or bit_at in (0, 15) or raw[3] & 3 == 2:
        return None
    group = 1 if version == 1.0 else 2
    rate, kbit, pad = RATES[version][rate_at], BITRATES[group, layer][bit_at], raw[2] >> 1 & 1
    samples = SAMPLES[group, layer]
    size = (12000 * kbit // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + pad
    mono = raw[3] >> 6 == 3
    side = 0 if layer != 3 else ((17 if mono else 32) if group == 1 else (9 if mono else 17))
    return size, samples, rate, kbit, not raw[1] & 1, side, layer


@functools.lru_cache(4096)
def checksum(data: bytes, bits: int | None = None) -> int:
    """The format's 16-bit checksum (polynomial 8005, start FFFF) of the first bits (all by default)."""
    crc, bits = 0xFFFF, 8 * len(data) if bits is None else bits
    for k in range(bits):
        top = (crc >> 15) ^ (data[k >> 3] >> 7 - (k & 7) & 1)
        crc = (crc << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return crc


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _synchsafe(raw: bytes) -> int:
    return functools.reduce(lambda a, b: a << 7 | b & 0x7F, raw, 0)


def _text(body: bytes) -> str:
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
    return body[1:].decode(coding, "replace").rstrip("\0")


def _id3v2(data: bytes, tags: dict[str, str]) -> None:
    """The text frames of a version 2.2, 2.3 or 2.4 tag, unsynchronised and extended headers included."""
    major, flags = data[3], data[5]
    body = data[10 : 10 + _synchsafe(data[6:10])]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and major >= 3 and len(body) >= 4:
        at = _synchsafe(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    wide = 3 if major < 3 else 4  # bytes of a frame's name and of its length
    head = 6 if major < 3 else 10
    while at + head <= len(body) and body[at : at + wide].strip(b"\0"):
        name, raw = body[at : at + wide].decode("latin-1"), body[at + wide : at + 2 * wide]
        length = _synchsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        value = body[at + head : at + head + length]
        if major >= 4 and body[at + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and value:
            own, (key, _, rest) = name in ("TXXX", "TXX"), _text(value).partition("\0")
            tags[f"TXXX:{key}" if own else name] = rest if own else _text(value)
        at += head + length


def _ape(data: bytes, end: int, tags: dict[str, str]) -> int:
    """The start of an APE tag that ends at end (its items in tags), or end if there is none."""
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end
    size, items, flags = struct.unpack("<III", data[end - 20 : end - 8])
    at = end - size
    if at < 0:
        return end
    start = max(0, at - 32 if flags & 0x80000000 else at)
    for _ in range(items):
        if at + 8 >= end - 32:
            break
        length, kind = struct.unpack("<II", data[at : at + 8])
        stop = data.find(b"\0", at + 8, end - 32)
        if stop < 0:
            break
        if not kind >> 1 & 3:
            tags.setdefault(f"ape:{data[at + 8 : stop].decode('latin-1')}", data[stop + 1 : stop + 1 + length].decode("utf-8", "replace"))
        at = stop + 1 + length
    return start


def read_tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(start, end) of the audio between tags at either end, and the text frames of the tags (ID3 1 and 2, APE)."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size = _synchsafe(data[start + 6 : start + 10])
        _id3v2(data[start : start + 10 + size], tags)
        start = min(end, start + 10 + size + (10 if data[start + 5] & 0x10 else 0))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(f"id3v1:{key}", value)
    return start, max(start, _ape(data, end, tags)), tags


def read_vbr(data: bytes, at: int, h: tuple) -> dict | None:
    """The variable-bitrate table in the frame at at: stated frames and bytes, and the byte places (from the frame on) of equal shares of the duration."""
    size, side, crc = h[0], h[5], 2 * h[4]
    tag = at + 4 + crc + side
    if data[tag : tag + 4] in (b"Xing", b"Info") and tag + 8 <= at + size:
        flags, pos, out = int.from_bytes(data[tag + 4 : tag + 8], "big"), tag + 8, {"kind": data[tag : tag + 4].decode(), "frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
        if flags & 4 and out["bytes"]:
            out["toc"] = [x * out["bytes"] // 256 for x in data[pos : min(pos + 100, at + size)]]
        return out
    tag = at + 36
    if data[tag : tag + 4] == b"VBRI" and tag + 26 <= at + size:
        size_, frames, entries, scale, width = struct.unpack(">IIHHH", data[tag + 10 : tag + 24])
        raw, toc, place = data[tag + 26 : min(at + size, tag + 26 + entries * width)], [], size
        for k in range(len(raw) // width if width else 0):
            toc.append(place)
            place += int.from_bytes(raw[k * width : (k + 1) * width], "big") * scale
        return {"kind": "VBRI", "frames": frames, "bytes": size_, "toc": toc}
    return None


# Fixed values of the format: bits of a subband's allocation in Layer II, as (subbands, bits), by table.
ALLOCATION = {
    "high": ((11, 4), (12, 3), (4, 2)),
    "higher": ((11, 4), (12, 3), (7, 2)),
    "low48": ((2, 4), (6, 3)),
    "low32": ((2, 4), (10, 3)),
    "half": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(version_1: bool, rate: int, kbit: int, channels: int) -> list[int]:
    if not version_1:
        name = "half"
    elif kbit // channels <= 48:
        name = "low32" if rate == 32000 else "low48"
    else:
        name = "high" if rate == 48000 or kbit // channels <= 80 else "higher"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def _bits(data: bytes, n: int) -> int:
    return int.from_bytes(data[: -(-n // 8)], "big") >> -n % 8


def protected(frame_: bytes, h: tuple) -> tuple[bytes, int] | None:
    """The bytes that a frame's checksum covers and how many bits of them: header, then side information or allocation."""
    rate, kbit, side, layer = h[2], h[3], h[5], h[6]
    body = frame_[6:]
    if layer == 3:
        n = 8 * side
    else:
        mode, channels = frame_[3] >> 6, 1 if frame_[3] >> 6 == 3 else 2
        table = [4] * 32 if layer == 1 else _allocation(frame_[1] >> 3 & 3 == 3, rate, kbit, channels)
        joint = min(len(table), 4 * ((frame_[3] >> 4 & 3) + 1)) if mode == 1 else len(table)
        widths = [w for k, w in enumerate(table) for _ in range(channels if k < joint else 1)]
        n = sum(widths)
        if len(body) * 8 < n:
            return None
        if layer == 2:
            # Two bits for each channel of a subband with an allocation follow.
            at, extra, value = 0, 0, _bits(body, n)
            for k, w in enumerate(widths):
                at += w
                used = value >> n - at & (1 << w) - 1
                extra += 2 * (channels if used and k >= joint * channels else 1) if used else 0
            n += extra
    if len(body) * 8 < n:
        return None
    return frame_[2:4] + body[: -(-n // 8)], 16 + n


def parse(data: bytes) -> dict:
    """Everything the frames, tags and tables of data say; offsets are exact byte places of the audio frames.

    Bytes that are no frame are skipped to the next header whose frame is followed by another header of the same
    version, layer and rate, or by the end. A frame cut off at the end counts as skipped.
    """
    start, end, tags = read_tags(data)
    out = {"tags": tags, "vbr": None, "offsets": [], "samples": 0, "rate": 0, "crc_ok": 0, "crc_bad": 0, "skipped": 0, "bitrates": {}, "bodies": [], "duration_us": 0}
    at, synced, seconds = start, False, {}
    while at < end:
        h = header(data[at : at + 4])
        good = h is not None and at + h[0] <= end
        if good and not synced:
            after = data[at + h[0] : min(end, at + h[0] + 4)]
            follow = header(after)
            good = at + h[0] == end or follow is not None and (follow[2], follow[6]) == (h[2], h[6]) and after[1] & 0x18 == data[at + 1] & 0x18
        if not good:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["skipped"] += found - at
            at, synced = found, False
            continue
        synced = True
        size, samples, rate, kbit, crc, side, layer = h
        body = at + 4 + 2 * crc + side
        if crc:
            covered = protected(data[at : min(at + size, at + 96)], h)
            ok = covered is not None and checksum(*covered) == int.from_bytes(data[at + 4 : at + 6], "big")
            out["crc_ok" if ok else "crc_bad"] += 1
        if not out["offsets"] and out["vbr"] is None and (vbr := read_vbr(data, at, h)):
            out["vbr"] = vbr
        else:
            out["offsets"].append(at)
            out["bodies"].append(data[body : at + size])
            out["samples"] += samples
            seconds[rate] = seconds.get(rate, 0) + samples
            out["rate"] = out["rate"] or rate
            out["bitrates"][kbit] = out["bitrates"].get(kbit, 0) + 1
        at += size
    out["duration_us"] = sum(n * 1_000_000 // rate for rate, n in sorted(seconds.items()))
    return out


def seek(found: dict, microseconds: int) -> int | None:
    """The byte offset of the frame that plays at that time (of a constant sample rate)."""
    if not found["offsets"] or found["duration_us"] <= microseconds or microseconds < 0:
        return None
    each = found["samples"] // len(found["offsets"])
    return found["offsets"][min(len(found["offsets"]) - 1, microseconds * found["rate"] // 1_000_000 // each)]


RATE, SIDE = 32000, 17
#: Header bytes and body bytes of a mono Layer III frame with a checksum, by rising bitrate.
FRAMES = [(bytes([0xFF, 0xFA, i << 4 | 2 << 2, 0xC0]), 144000 * k // RATE - 4 - 2 - SIDE) for i, k in enumerate(BITRATES[1, 3]) if i]


def frame(kind: int, body: bytes) -> bytes:
    """A silent frame: empty side information with its checksum, body as ancillary data, filled with zeros."""
    head, room = FRAMES[kind]
    return head + checksum(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) + body.ljust(room, b"\0")


def padded(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of 64 bytes."""
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")


def write(payload: bytes) -> bytes:
    """An MPEG-1 Layer III stream that holds payload losslessly as ancillary data: tag, variable-bitrate table, frames.

    Full frames have the highest bitrate, the last the lowest that holds the rest; the tag states the payload's length.
    """
    room = FRAMES[-1][1]
    parts = [payload[i : i + room] for i in range(0, len(payload), room)]
    frames = [frame(len(FRAMES) - 1 if len(p) == room else next(k for k, f in enumerate(FRAMES) if f[1] >= len(p)), p) for p in parts]
    table = next(k for k, f in enumerate(FRAMES) if f[1] >= 116)
    first = len(frame(table, b""))
    offsets, at = [], first
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * offsets[len(frames) * i // 100] // at) for i in range(100))
    vbr = frame(table, b"Xing" + struct.pack(">III", 7, len(frames), at) + toc)
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\x03\0\0" + synchsafe(len(tag)) + tag + vbr + b"".join(frames)


def payload_of(found: dict) -> bytes:
    """The ancillary bytes of a stream made by write(); empty for other streams."""
    n = found["tags"].get("TXXX:payload_bytes", "")
    return b"".join(found["bodies"])[: int(n)] if n.isascii() and n.isdigit() else b""


def store_audio(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media (binary): each whole text as UTF-8 (null: empty), padded, in an MPEG audio stream.

    A column media is replaced, others pass through; equal texts give equal streams, repeated rows stay, an empty table stays empty.
    """

    def make():
        return lambda texts: [[write(padded((x or "").encode("utf-8", "replace"))) for x in texts]]

    return with_arrow_columns(docs, text, [T.StructField("media", T.BinaryType())], make)


AUDIO = T.StructType(
    [
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("samples", T.LongType()),
        T.StructField("duration_us", T.LongType()),
        T.StructField("frame_offsets", T.ArrayType(T.LongType())),
        T.StructField("bitrates", T.MapType(T.IntegerType(), T.LongType())),
        T.StructField("crc_ok", T.LongType()),
        T.StructField("crc_bad", T.LongType()),
        T.StructField("skipped_bytes", T.LongType()),
        T.StructField("vbr_kind", T.StringType()),
        T.StructField("vbr_frames", T.LongType()),
        T.StructField("seek_table", T.ArrayType(T.LongType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _row(found: dict) -> dict:
    vbr = found["vbr"] or {}
    return {
        "sample_rate": found["rate"], "samples": found["samples"], "duration_us": found["duration_us"], "frame_offsets": found["offsets"],
        "bitrates": sorted(found["bitrates"].items()), "crc_ok": found["crc_ok"], "crc_bad": found["crc_bad"], "skipped_bytes": found["skipped"],
        "vbr_kind": vbr.get("kind"), "vbr_frames": vbr.get("frames"), "seek_table": vbr.get("toc", []), "tags": sorted(found["tags"].items()),
    }


def read_audio(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """df with audio (see AUDIO), parsed from a binary column of MPEG audio; null or foreign bytes give no frames.

    With payload, also the ancillary payload of streams made by store_audio (empty for others). Columns of these names are
    replaced, others pass through; repeated rows stay; an empty table stays empty.
    """
    fields = [T.StructField("audio", AUDIO)] + [T.StructField("payload", T.BinaryType())] * payload

    def make():
        def work(values: list) -> list:
            rows, payloads = [], []
            for x in values:
                found = parse(x or b"")
                rows.append(_row(found))
                if payload:
                    payloads.append(payload_of(found))
            return [rows] + [payloads] * payload

        return work

    return with_arrow_columns(df, media, fields, make)


def store_and_read(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media, audio and payload: what store_audio and then read_audio of its stored bytes give, in one pass.

    One pass holds one text's stream at a time and needs one worker for a core. Columns and rows as in the two functions.
    """
    fields = [T.StructField("media", T.BinaryType()), T.StructField("audio", AUDIO), T.StructField("payload", T.BinaryType())]

    def make():
        def work(texts: list) -> list:
            out = [], [], []
            for x in texts:
                media = write(padded((x or "").encode("utf-8", "replace")))
                found = parse(media)
                for column, value in zip(out, (media, _row(found), payload_of(found)), strict=True):
                    column.append(value)
            return list(out)

        return work

    return with_arrow_columns(docs, text, fields, make)


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = store_and_read(read(spark, sf_dir, "documents").select("doc_id", "text"))
    a = F.col("audio")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), F.size(a["frame_offsets"])),
        F.concat(F.lit("samples="), a["samples"]),
        F.concat(F.lit("duration_us="), a["duration_us"]),
        F.concat(F.lit("crc_ok="), a["crc_ok"]),
        F.concat(F.lit("crc_bad="), a["crc_bad"]),
        F.concat(F.lit("skipped="), a["skipped_bytes"]),
        F.concat(F.lit("vbr_frames="), a["vbr_frames"]),
        F.concat(F.lit("seek_sha256="), F.sha2(F.array_join(F.transform(a["frame_offsets"], lambda x: x.cast("string")), ","), 256)),
    )
    return back.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
