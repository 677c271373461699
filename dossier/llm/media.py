"""Bytes as images in binary columns: PNG files of 8-bit samples, and hashes of what is in them.

encode() pads a text's UTF-8 bytes with zeros to a positive multiple of WIDTH and stores them as the samples of a grey image of WIDTH columns, losslessly. decode() reads any non-interlaced PNG of 8-bit samples (grey, colour,
palette, with or without alpha): signature, length and CRC-32 of every chunk, the stream's Adler-32 and the number of rows are tested, and the five row filters are undone with numpy. The hash is taken from the
64 lowest frequencies of a cosine transform in whole numbers, so equal samples have equal hashes on every machine.

A null text is an empty one, an empty one an image of one row of zeros. Any length is one image of as many rows as it takes. Repeated rows and equal texts have equal values; an empty table gives no rows; further columns are
ignored. Media that can't be read give null features and a text in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stored

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the format
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # samples a pixel by colour type, fixed by the format
#: Bytes of compressed data in one chunk.
CHUNK = 1 << 20

SIDE, LOW = 32, 8
#: The lowest cosines, as whole numbers.
_COSINES = np.rint(4096 * np.cos(np.pi * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None] / SIDE)).astype(np.int64)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Rows of grey samples, each after the number of its filter. A row keeps its samples unless differences to the left or to the row above sum to less than an eighth: letters are packed better as they are."""
    height, width = rows.shape
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    sizes = [np.abs(x.view(np.int8).astype(np.int32)).sum(1) for x in (rows, left, up)]
    kind = np.where(8 * np.minimum(sizes[1], sizes[2]) < sizes[0], np.where(sizes[1] < sizes[2], 1, 2), 0)
    out = np.empty((height, width + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where(kind[:, None] == 1, left, np.where(kind[:, None] == 2, up, rows))
    return out


def encode(payload: bytes) -> bytes:
    """A PNG file with the bytes, a positive multiple of WIDTH of them, as grey samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    data = zlib.compress(filtered(rows).tobytes())
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)) + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, data) of all chunks up to the end, tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(png):
            raise ValueError("cut off within a chunk")
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png):
            raise ValueError("cut off within a chunk")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"wrong checksum of {kind.decode('latin-1')}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + n


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """The samples of filtered rows. step: bytes a pixel.

    Without averages and Paeth rows, sums along rows and columns do. With them, all rows go on together, each a pixel behind the one above: what a sample needs is then known.
    """
    height, width = rows.shape
    if not len(rows) or not kinds.any():
        return rows.copy()
    if kinds.max() > 4:
        raise ValueError("unknown filter")
    pixels = rows.reshape(height, width // step, step)
    if kinds.max() <= 2:
        out = pixels.copy()
        out[kinds == 1] = np.cumsum(pixels[kinds == 1], axis=1, dtype=np.uint8)
        ups = np.flatnonzero(kinds == 2)
        for run in np.split(ups, np.flatnonzero(np.diff(ups) > 1) + 1) if len(ups) else []:  # stretches of rows that build on the one before
            first = max(run[0] - 1, 0)
            whole = np.cumsum(out[first : run[-1] + 1], axis=0, dtype=np.uint8)
            out[run] = whole[run - first]
        return out.reshape(height, width)
    out = np.zeros((height + 1, width // step + 1, step), np.int16)  # with a row above and a column to the left of zeros
    y = np.arange(height)
    for d in range(height + width // step - 1):
        r = y[max(0, d - width // step + 1) : d + 1]
        c = d - r
        a, b, ab, k = out[r + 1, c], out[r, c + 1], out[r, c], kinds[r, None]
        p = a + b - ab
        pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - ab)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, ab))
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [a, b, (a + b) >> 1, paeth], 0)
        out[r + 1, c + 1] = (pixels[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width)


def decode(png: bytes) -> np.ndarray:
    """The samples of a PNG file: rows of bytes. ValueError if a test fails."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            if len(body) != 13:
                raise ValueError("wrong header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[0] == 0 or head[1] == 0:
        raise ValueError("no header")
    width, height, depth, colour, packing, filtering, interlaced = head
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlaced:
        raise ValueError("not of 8-bit samples, row by row")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(data))  # tests the Adler-32
    except zlib.error as e:
        raise ValueError(f"broken stream: {e}") from e
    if len(raw) != height * (width * step + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width * step + 1)
    return unfilter(rows[:, 0], rows[:, 1:], step)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: whether each of the lowest frequencies of the image, brought to SIDE x SIDE means, is above their median."""
    grid = samples.astype(np.int64)
    for axis in (0, 1):  # means of parts as even as may be; a side with fewer samples repeats them
        n = grid.shape[axis]
        at = np.arange(SIDE + 1) * n // SIDE
        lo, hi = at[:-1], np.maximum(at[1:], at[:-1] + 1)
        sums = np.concatenate([np.zeros_like(grid.take([0], axis)), np.cumsum(grid, axis)], axis)
        many = (hi - lo).reshape((-1, 1) if axis == 0 else (1, -1))
        grid = (sums.take(hi, axis) - sums.take(lo, axis)) * 16 // many
    low = _COSINES @ grid @ _COSINES.T
    rest = np.sort(low.ravel()[1:])  # the first is the mean brightness
    return np.packbits(low.ravel() > rest[len(rest) // 2]).tobytes()


def distance(a, b):
    """Bits in which two hash columns differ."""
    half = lambda x, i: F.conv(F.substring(F.hex(x), i, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, padded, as a PNG file in a binary column."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                texts = as_bytes(piece.column(1))
                media = [encode(t + bytes(max(WIDTH, -(-len(t) // WIDTH) * WIDTH) - len(t))) for t in texts]
                yield pa.record_batch([piece.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary, width int, height int, error string"


def read(media: DataFrame) -> DataFrame:
    """media (media and more) with FEATURES of what the stored bytes hold. Null media have null features without an error."""
    import pyarrow as pa

    names = [x.split()[0] for x in FEATURES.split(", ")]
    keep = [c for c in media.columns if c != "media"]
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")

    def row(png):
        if png is None:
            return (None,) * len(names)
        size = len(png), hashlib.sha256(png).hexdigest()
        try:
            samples = decode(png)
        except ValueError as e:
            return None, None, None, *size, None, None, None, str(e)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), *size, cosine_hash(samples), samples.shape[1], samples.shape[0], None

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            got = list(zip(*[row(x.as_py()) for x in batch.column("media")], strict=True)) or [()] * len(names)
            yield pa.record_batch([*[batch.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(got, kinds, strict=True)]], [*keep, *names])

    return media.select(*[f"`{c}`" for c in keep], "media").mapInArrow(run, f"{given}, {FEATURES}" if given else FEATURES)


def digest(docs: DataFrame) -> DataFrame:
    """What the stored images of all texts hold, read back: one row a document. feature is the hash in hex."""
    got = read(stored(store(docs), "media"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"), "error")
