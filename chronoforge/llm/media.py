"""Media columns: texts as 8-bit PCM audio in Matroska, parsed back into packet tables.

``mux`` writes a Matroska file: EBML header, segment, info, one PCM track, clusters of laced simple
blocks, cues. ``demux`` reads any Matroska bytes: variable-length element ids and sizes (unknown
sizes too), clusters, simple blocks and block groups, all four lacings (none, Xiph, fixed, EBML)
and cues, and yields one packet row per frame: track, timestamp, byte range. ``packet_table`` is that
as a DataFrame. The frames of a lace follow each other by the block's duration, else by the track's default
duration, else, for PCM, by the samples before them; where the file says none of these, they share the block's time. The payload is what the frames of the track say when they are read back, and the features
are computed from those bytes.

Cases: null or empty text is a payload of 64 zero bytes; texts of any length are cut into frames;
equal texts give equal bytes; repeated rows are repeated; an empty table gives no rows; bytes that
are cut off or malformed raise ValueError in ``demux`` and are one row with an error in ``packet_table``; null media
give no packets; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Matroska element ids.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, TRACKS = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B
TRACK, TRACK_NUMBER, TRACK_TYPE, CODEC = 0xAE, 0xD7, 0x83, 0x86
AUDIO, RATE, CHANNELS, BITS = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
#: Elements that end a cluster, or a segment's other part, of unknown size.
TOP = {CLUSTER, CUES, TRACKS, INFO}

SAMPLES_A_SECOND = 8000
FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 1024, 8, 4


# -- writing


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    """A difference of lace sizes."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return vint(n + (1 << 7 * width - 1) - 1, width)


def element(id_: int, data: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, time: int, frames: list[bytes], lacing: str) -> bytes:
    """A block's content; lacing: none, xiph, fixed or ebml."""
    kind = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}[lacing]
    head = vint(track) + struct.pack(">hB", time, 0x80 | kind << 1)
    sizes = [len(f) for f in frames]
    if lacing != "none":
        head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == "ebml":
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """The payload as 8-bit samples of one PCM track."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks = [frames[i : i + FRAMES_A_BLOCK] for i in range(0, len(frames), FRAMES_A_BLOCK)]
    audio = element(RATE, struct.pack(">d", SAMPLES_A_SECOND)) + number(CHANNELS, 1) + number(BITS, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    body = element(INFO, number(SCALE, 1_000_000)) + element(TRACKS, element(TRACK, track))
    cues, frame_ms = b"", FRAME * 1000 // SAMPLES_A_SECOND
    for k in range(0, len(blocks), BLOCKS_A_CLUSTER):
        time = k * FRAMES_A_BLOCK * frame_ms
        cues += element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, len(body))))
        inner = number(CLUSTER_TIME, time)
        for j, laced in enumerate(blocks[k : k + BLOCKS_A_CLUSTER]):
            lacing = "none" if len(laced) == 1 else "fixed" if len({*map(len, laced)}) == 1 else "ebml" if len(laced) > 2 else "xiph"
            inner += element(SIMPLE_BLOCK, block(1, j * FRAMES_A_BLOCK * frame_ms, laced, lacing))
        body += element(CLUSTER, inner)
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, body + element(CUES, cues))


# -- reading


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """Value and end of a variable-length integer; None: all value bits set, an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements in a range; one of unknown size ends where its parent's next one starts."""
    while at < end:
        id_, body = read_vint(data, at, keep_mark=True)
        size, body = read_vint(data, body)
        if size is None:
            stop = end
            if id_ == CLUSTER:
                at2 = body
                while at2 < end:
                    inner, b2 = read_vint(data, at2, keep_mark=True)
                    if inner in TOP:
                        stop = at2
                        break
                    n2, b2 = read_vint(data, b2)
                    if n2 is None:
                        raise ValueError(f"an element of unknown size in a cluster at byte {at2}")
                    at2 = b2 + n2
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element at byte {at} ends after its parent")
        yield id_, body, stop
        at = stop


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(first byte, size) of the frames of a block."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        sizes = [(end - at) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        size = 0
        for k in range(n - 1):
            start = at
            v, at = read_vint(data, at)
            v = (1 << 7 * (at - start)) - 1 if v is None else v
            size = v if k == 0 else size + v - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or sum(sizes) != end - at:
        raise ValueError(f"lace sizes don't fit the block that ends at byte {end}")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes, strict=True))


def _uint(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise ValueError(f"a number of {b - a} bytes at byte {a}")
    return int.from_bytes(data[a:b], "big")


def _held(*numbers: int) -> None:
    """ValueError unless a table can hold the numbers."""
    if not all(-(1 << 63) <= n < 1 << 63 for n in numbers):
        raise ValueError("a number that 64 bits don't hold")


def demux(data: bytes) -> tuple[list[tuple], list[tuple], dict]:
    """(packets, cues, info); ValueError for malformed bytes.

    packets: (cluster, block, frame, track, timestamp in ns, first byte, size, lacing, key frame);
    cues: (time in ns, track, first byte of the cluster element).
    """
    try:
        return _demux(data)
    except (IndexError, struct.error, UnicodeDecodeError, ArithmeticError) as e:
        raise ValueError(f"cut off or malformed: {e}") from e


def _track(data: bytes, at: int, end: int) -> tuple[int, dict]:
    """Number of a track, and what times its frames."""
    track, out = 0, {"codec": "", "rate": 0.0, "frame_ns": 0, "sample_bytes": 1}
    for e, p, q in elements(data, at, end):
        if e == TRACK_NUMBER:
            track = _uint(data, p, q)
        elif e == CODEC:
            out["codec"] = data[p:q].decode()
        elif e == DEFAULT_DURATION:
            out["frame_ns"] = _uint(data, p, q)
        elif e == AUDIO:
            inner = {k: (r, s) for k, r, s in elements(data, p, q)}
            if RATE in inner:
                r, s = inner[RATE]
                out["rate"] = struct.unpack(">d" if s - r == 8 else ">f", data[r:s])[0]
            channels, bits = (_uint(data, *inner[k]) if k in inner else n for k, n in ((CHANNELS, 1), (BITS, 8)))
            out["sample_bytes"] = max(1, channels * bits // 8)
    return track, out


def _late(frames: list[tuple[int, int]], k: int, track: dict, duration_ns: int) -> int:
    """Nanoseconds from a block's time to its k-th frame."""
    if duration_ns:
        return duration_ns * k // len(frames)
    if track.get("frame_ns"):
        return track["frame_ns"] * k
    if track.get("codec", "").startswith("A_PCM") and track["rate"]:
        return int(sum(size for _, size in frames[:k]) // track["sample_bytes"] * 1_000_000_000 / track["rate"])
    return 0


def _demux(data: bytes) -> tuple[list[tuple], list[tuple], dict]:
    packets, cues, info, tracks = [], [], {"scale": 1_000_000, "codec": "", "rate": 0.0}, {}
    n_cluster = n_block = -1
    for top, a, b in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for id_, c, d in elements(data, a, b, SEGMENT):
            if id_ == INFO:
                info |= {"scale": _uint(data, x, y) for e, x, y in elements(data, c, d) if e == SCALE}
            elif id_ == TRACKS:
                tracks |= dict(_track(data, x, y) for t, x, y in elements(data, c, d) if t == TRACK)
                info |= {k: next(iter(tracks.values()), info)[k] for k in ("codec", "rate")}
            elif id_ == CUES:
                for e, x, y in elements(data, c, d):
                    time, track, where = 0, 0, 0
                    for k, p, q in elements(data, x, y) if e == CUE_POINT else ():
                        if k == CUE_TIME:
                            time = _uint(data, p, q)
                        elif k == CUE_POSITIONS:
                            inner = {m: _uint(data, r, s) for m, r, s in elements(data, p, q)}
                            track, where = inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)
                    cues.append((time * info["scale"], track, a + where))
                    _held(*cues[-1])
            elif id_ == CLUSTER:
                n_cluster, base = n_cluster + 1, 0
                for e, x, y in elements(data, c, d):
                    if e == CLUSTER_TIME:
                        base = _uint(data, x, y)
                    group = list(elements(data, x, y)) if e == BLOCK_GROUP else []
                    lasts = sum(_uint(data, p, q) for k, p, q in group if k == BLOCK_DURATION) * info["scale"]
                    inner = [(x, y)] if e == SIMPLE_BLOCK else [(p, q) for k, p, q in group if k == BLOCK]
                    for p, q in inner:
                        n_block += 1
                        track, at = read_vint(data, p)
                        time, flags = struct.unpack(">hB", data[at : at + 3])
                        kind = flags >> 1 & 3
                        stamp = (base + time) * info["scale"]
                        frames = lace(data, at + 3, q, kind)
                        if track is None:
                            raise ValueError(f"a block of no track at byte {p}")
                        for k, (start, size) in enumerate(frames):
                            late = stamp + _late(frames, k, tracks.get(track, {}), lasts)
                            _held(track, late)
                            packets.append((n_cluster, n_block, k, track, late, start, size, kind, bool(flags & 0x80) or e == BLOCK_GROUP))
    return packets, cues, info


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(payload: bytes, packets: list[tuple], cues: list[tuple]) -> str:
    """What the samples and the packets say, as text."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero(np.diff(s >= 128)))
    return (
        f"packets={len(packets)};clusters={len({p[0] for p in packets})};cues={len(cues)};"
        f"laced={sum(p[7] > 0 for p in packets)};last_ns={packets[-1][4] if packets else 0};"
        f"sum={int(s.sum())};energy={int((s * s).sum())};crossings={crossings};peak={int(s.max(initial=0))}"
    )


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; media if asked."""
    fields = {
        "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    }
    if with_media:
        fields["media"] = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                rows: dict[str, list] = {k: [] for k in fields}
                for text in b.column(1).to_pylist():
                    n, payload = padded(text)
                    media = mux(payload)
                    packets, cues, _ = demux(media)
                    back = b"".join([media[p[5] : p[5] + p[6]] for p in packets])
                    values = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, packets, cues), media)
                    for k, v in zip(fields, values, strict=False):
                        rows[k].append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, fields[k]) for k, v in rows.items())], ["doc_id", *fields])

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    schema = "doc_id long, " + ", ".join(f"{k} {kinds[str(t)]}" for k, t in fields.items())
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def packet_table(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of the Matroska bytes in a column; malformed bytes give one row, with error and no packet."""
    names = ["cluster", "block", "frame", "track", "timestamp_ns", "byte_start", "byte_size", "lacing", "key_frame", "error"]
    kinds = [pa.int64()] * 8 + [pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    packets = [(*p, None) for p in demux(data)[0]] if data is not None else []
                except ValueError as e:
                    packets = [(*[None] * 9, str(e))]
                if packets:
                    cols = list(zip(*packets, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(packets), b.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *names])

    id_type = media.schema[id_column].dataType.simpleString()
    schema = f"id {id_type}, " + ", ".join(f"{n} { {'key_frame': 'boolean', 'error': 'string'}.get(n, 'long')}" for n in names)
    return media.select(id_column, column).mapInArrow(run, schema).withColumnRenamed("id", id_column)
