"""AVI motion-JPEG columns: parse RIFF indexes, decode intra frames, detect shots.

A media value is an AVI file as bytes: ``RIFF/AVI`` with ``hdrl``, ``movi`` and
``idx1``.  Each ``00dc`` chunk that the writer makes is one intra frame, a grey JPEG
of the lossless process (SOF3, left predictor), so 8-bit samples come back exactly.
The reader finds frames through ``idx1``, and by walking ``movi`` where there is
none; it reads these frames and baseline DCT ones (``dct``), grey or in colour.

The writer's Huffman table gives difference category ``s`` a code of ``9 - s``
bits; with its ``s`` extra bits each sample takes nine bits, so both directions
are table lookups over whole arrays.  Lossless frames with any other table are
decoded bit by bit.  Other JPEG processes (progressive, arithmetic) are refused.

Shots: a cut stands where the histogram difference of neighbouring frames is
above ``floor`` and above mean + ``factor`` x deviation of the differences
within ``reach`` frames around it.  Each shot is a clip with its times.

Edge cases: null or empty text stores one block of zeros; equal texts give equal
files; a null media value has no clips; a file that is broken, cut off, without
frames or of another kind gives one row without a clip, and its status says why;
frames of length 0 repeat the one before; rows are independent, so ties, repeated
rows and further columns change nothing, and an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dct, tokens

WIDTH, HEIGHT, RATE = 64, 64, 25

# Nine-bit words by difference + 255, and back (unused words: 0).
_WORD = np.zeros(511, np.uint16)
_DIFF = np.zeros(512, np.int16)
for _d in range(-255, 256):
    _s = abs(_d).bit_length()
    _w = (((1 << (8 - _s)) - 1) << (_s + 1)) | (_d if _d >= 0 else _d + (1 << _s) - 1)
    _WORD[_d + 255], _DIFF[_w] = _w, _d
_DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 17 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


def _pack(words: np.ndarray) -> np.ndarray:
    """Eight nine-bit words a row, as nine bytes a row."""
    out = np.zeros((len(words), 9), np.uint8)
    for k in range(8):
        out[:, k] |= (words[:, k] >> (k + 1)).astype(np.uint8)
        out[:, k + 1] |= (words[:, k] << (7 - k)).astype(np.uint8)
    return out


def _unpack(data: np.ndarray) -> np.ndarray:
    """The reverse of ``_pack``."""
    pairs = data.astype(np.uint16)
    return np.stack([(pairs[:, k] << (k + 1) | pairs[:, k + 1] >> (7 - k)) & 511 for k in range(8)], axis=1)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEGs of rows of WIDTH samples, HEIGHT rows a frame."""
    d = samples.astype(np.int16)
    first = np.full(len(d), 128, np.int16)
    first[1:] = d[:-1, 0]
    first[::HEIGHT] = 128
    d[:, 1:] -= d[:, :-1].copy()
    d[:, 0] -= first
    rows = _pack(_WORD[d + 255].reshape(-1, 8)).reshape(len(d), -1)
    out = []
    for i in range(0, len(d), HEIGHT):
        part = rows[i : i + HEIGHT]
        frame = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, len(part), WIDTH, 1, 1, 0x11, 0)
        out.append(b"\xff\xd8" + _DHT + frame + _SOS + part.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _bitwise(data: bytes, n: int, lengths: bytes, symbols: bytes) -> np.ndarray:
    """Differences by a general Huffman table, bit by bit."""
    codes, code, k = {}, 0, 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[size, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = iter(np.unpackbits(np.frombuffer(data, np.uint8)).tolist())
    out = np.zeros(n, np.int64)
    for i in range(n):
        size = code = 0
        while (size, code) not in codes:
            if size > 16:
                raise ValueError("broken JPEG data")
            size, code = size + 1, code << 1 | next(bits)
        s, v = codes[size, code], 0
        if s == 16:
            out[i] = 32768
            continue
        for _ in range(s):
            v = v << 1 | next(bits)
        out[i] = v if not s or v >> (s - 1) else v - (1 << s) + 1
    return out


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples of a grey lossless JPEG with predictor 1, or of a baseline DCT JPEG; colours have a third axis.

    Anything else, broken data included, is a ``ValueError``.
    """
    try:
        return _lossless(jpeg) if _process(jpeg) == 0xC3 else dct.decode(jpeg)
    except (ArithmeticError, LookupError, TypeError, StopIteration, RuntimeError, struct.error) as e:
        raise ValueError("broken JPEG data") from e


def _process(jpeg: bytes) -> int:
    """The marker of a JPEG's frame header."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(jpeg):
        mark = jpeg[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return mark
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4]) if mark != 0xFF else 1
    raise ValueError("no frame header")


def _lossless(jpeg: bytes) -> np.ndarray:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, shape, table = 2, None, None
    while True:
        mark, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4])
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xC4:
            table = body[1:17], body[17:]
        elif mark == 0xC3:
            precision, high, wide, parts = struct.unpack(">BHHB", body[:6])
            if (precision, parts) != (8, 1):
                raise ValueError("only 8-bit grey frames are read")
            shape = high, wide
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process SOF{mark - 0xC0} is not read")
        elif mark == 0xDA:
            if body[3:6] != b"\x01\x00\x00":
                raise ValueError("only the left predictor is read")
            break
    end = jpeg.rindex(b"\xff\xd9")
    data = jpeg[at:end].replace(b"\xff\x00", b"\xff")
    n = shape[0] * shape[1]
    if n > 8 * len(jpeg):  # a sample takes a bit at least
        raise ValueError("JPEG data end early")
    if n % 8 == 0 and _DHT.endswith(table[0] + table[1]):
        d = _DIFF[_unpack(np.frombuffer(data, np.uint8, n // 8 * 9).reshape(-1, 9))].astype(np.int32)
    else:
        d = _bitwise(data, n, *table)
    d = d.reshape(shape)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 0xFFFF).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(payload: bytes, rate: int = RATE) -> bytes:
    """Store bytes, a multiple of WIDTH of them, as frames of an AVI file."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = encode_frames(samples)
    high, most = min(HEIGHT, len(samples)), max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, WIDTH, high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, high)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, high, 1, 8, b"MJPG", WIDTH * high, 0, 0, 256, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    movie, index, at = [b"movi"], [], 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(media: bytes) -> tuple[list[tuple[int, int]], float]:
    """Offsets and sizes of the video frames, and seconds a frame."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, walked, seconds, movie = [], [], 1 / RATE, None
    stack = [(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            body = at + 8
            at = body + size + (size & 1)
            if name == b"LIST":
                if media[body : body + 4] == b"movi":
                    movie = body
                stack.append((at, end))
                at, end = body + 4, min(end, body + size)
            elif name == b"avih":
                seconds = int.from_bytes(media[body : body + 4], "little") / 1e6
            elif name == b"idx1":
                entries = [struct.unpack_from("<4sIII", media, i) for i in range(body, body + size - 15, 16)]
                # Offsets count from the list's name, or in some files from the file's start.
                base = movie if movie is not None and entries and media[movie + entries[0][2] :][:4] == entries[0][0] else 0
                frames = [(base + o + 8, n) for kind, _, o, n in entries if kind[2:] in (b"dc", b"db")]
            elif name[2:] in (b"dc", b"db"):
                walked.append((body, size))
    return frames or walked, seconds


def read_frames(media: bytes) -> tuple[list[np.ndarray], float]:
    """All frames, and seconds a frame; a file without any, or with a broken one, is a ``ValueError``."""
    try:
        places, seconds = parse_avi(media)
    except (IndexError, struct.error) as e:
        raise ValueError("broken AVI file") from e
    frames: list[np.ndarray] = []
    for o, n in places:
        if n == 0 and frames:
            frames.append(frames[-1])
        elif n:
            frames.append(decode_frame(media[o : o + n]))
    if not frames:
        raise ValueError("no frames")
    return frames, seconds


def differences(frames: list[np.ndarray], bins: int = 16) -> np.ndarray:
    """Half the L1 distance of neighbouring frames' histograms, 0 to 1."""
    grey = [dct.luminance(f) for f in frames]
    h = np.array([np.bincount(f.ravel() // (256 // bins), minlength=bins) / max(1, f.size) for f in grey])
    return np.abs(np.diff(h, axis=0)).sum(1) / 2 if len(frames) > 1 else np.zeros(0)


def cuts(d: np.ndarray, reach: int = 8, factor: float = 3.0, floor: float = 0.1) -> list[int]:
    """Frames that begin a shot, besides the first."""
    out = []
    for t, x in enumerate(d):
        near = np.concatenate([d[max(0, t - reach) : t], d[t + 1 : t + 1 + reach]])
        if x > floor and (not near.size or x > near.mean() + factor * near.std()):
            out.append(t + 1)
    return out


def shots(media: bytes) -> tuple[list[tuple], str]:
    """(clip, first frame, last frame, start, end) of each shot, and "ok" or why there are none."""
    try:
        frames, seconds = read_frames(media)
    except ValueError as e:
        return [(None,) * 5], str(e) or "broken"
    edges = [0, *cuts(differences(frames)), len(frames)]
    return [(k, x, y - 1, x * seconds, y * seconds) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False))], "ok"


def clips(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",), status: str | None = None) -> DataFrame:
    """A row for each shot: ``keep``, clip, first_frame, last_frame, start_s, end_s, and a column named ``status``, if asked for.

    A value that cannot be read has one row, whose clip is null.
    """
    chosen = media.select(*keep, F.col(column).alias("__media"))
    names = ["clip", "first_frame", "last_frame", "start_s", "end_s", *([status] if status else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", clip int, first_frame long, last_frame long, start_s double, end_s double" + (f", `{status}` string" if status else "")

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, m in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if m is None:
                    continue
                found, says = shots(m)
                at += [i] * len(found)
                rows += [(*r, says) for r in found]
            taken = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()][: len(names)])]
            yield pa.RecordBatch.from_arrays([*taken, *made], [*b.schema.names[:-1], *names])

    return chosen.mapInArrow(run, schema)


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with the text's bytes as an AVI column, media."""
    chosen = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", media binary"

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                made = pa.array([write_avi(padded(t or b"")) for t in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], [*b.schema.names[:-1], "media"])

    return chosen.mapInArrow(run, schema)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def describe(media: bytes) -> tuple[bytes, str]:
    """The payload read back from a stored file, and its features."""
    frames, seconds = read_frames(media)
    payload = b"".join(f.tobytes() for f in frames)
    d = differences(frames)
    edges = cuts(d)
    mean = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) / len(payload)
    return payload, f"frames={len(frames)};seconds={len(frames) * seconds:.2f};shots={len(edges) + 1};cuts={','.join(map(str, edges))};mean={mean:.3f};change={d.max() if d.size else 0:.3f}"


def op9_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens.small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                media = write_avi(padded(text or b""))
                payload, feature = describe(media)
                rows.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of all documents, stored as media."""
    tokens.small_batches(spark)
    return clips(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), status="status")


QUERIES = {"op9_media_avi": op9_media_avi, "media_clips": media_clips}
ORACLES: dict[str, str] = {}
