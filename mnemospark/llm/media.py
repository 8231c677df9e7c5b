"""Media columns (5): Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles and difference hashes."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

WIDTH = 64


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey uint8 image as binary Netpbm (P5)."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey uint8 image as an uncompressed 8-bit BMP with a grey palette."""
    h, w = image.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 256)
    return head + palette.tobytes() + rows.tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """So many numbers after the magic of a Netpbm file, comments skipped, and where the samples begin."""
    numbers, at = [], 2
    while len(numbers) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("Netpbm: a number was expected")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 (or uint16 above 255), rows x columns, x 3 for colour; bitmaps as 0 (black) and 255."""
    kind = data[:2]
    colour = kind in (b"P3", b"P6")
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        if kind == b"P4":
            bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-w // 8) * h, at).reshape(h, -1), axis=1)[:, :w]
        else:
            bits = np.array([x == 49 for x in data[at - 1 :] if x in (48, 49)][: w * h], np.uint8).reshape(h, w)
        return (1 - bits) * np.uint8(255)
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("no Netpbm file")
    (w, h, top), at = _header(data, 3)
    shape = (h, w, 3) if colour else (h, w)
    if not 0 < top < 65536:
        raise ValueError("Netpbm: the largest value is 1 to 65535")
    n = h * w * (3 if colour else 1)
    if kind in (b"P2", b"P3"):
        out = np.array(data[at:].split()[:n], np.int64)
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    return out.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-, 24- and 32-bit BMP; 8-bit grey palettes give one channel, others RGB."""
    if data[:2] != b"BM":
        raise ValueError("no BMP file")
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("BMP: only uncompressed 8, 24 and 32 bits")
    step = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)
    rows = rows[::-1] if h > 0 else rows
    if bits > 8:
        return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return palette[rows[:, :w], 0] if grey else palette[rows[:, :w]][:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples of a file; an image of no rows or columns is an error."""
    image = decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    if not image.size:
        raise ValueError("an image without samples")
    return image


def largest_value(data: bytes) -> int:
    """The value that stands for white."""
    return _header(data, 3)[0][2] if data[:2] in (b"P2", b"P3", b"P5", b"P6") else 255


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional positions of the borders of so many equal parts of n."""
    at = np.arange(parts + 1) * n
    return at // parts, (at % parts) / parts


def area_resize(image: np.ndarray, rows: int, cols: int, strip: int = 1 << 16) -> np.ndarray:
    """Means over the cells of a rows x cols grid, from integral images read between samples at fractional borders.

    Strips of image rows are integrated one after the other, so memory doesn't grow with the image's height.
    """
    h, w = image.shape
    x, fx = _edges(w, cols)
    y, fy = _edges(h, rows)
    at_edges = np.zeros((rows + 1, cols))
    total = np.zeros(cols)
    for a in range(0, h, strip):
        part = image[a : a + strip]
        across = np.zeros((len(part), w + 1))
        np.cumsum(part, 1, out=across[:, 1:])
        at = across[:, x] + fx * np.pad(part, ((0, 0), (0, 1)))[:, np.minimum(x, w)]
        cells = at[:, 1:] - at[:, :-1]
        down = np.zeros((len(part) + 1, cols))
        np.cumsum(cells, 0, out=down[1:])
        own = np.flatnonzero((y >= a) & (y < a + len(part)))
        at_edges[own] = total + down[y[own] - a] + fy[own, None] * cells[y[own] - a]
        total += down[-1]
    at_edges[y == h] = total
    return (at_edges[1:] - at_edges[:-1]) * (rows * cols / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: is each of 8 x 8 cells darker than its right neighbour, in an 8 x 9 area-resized grid."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """A side x side uint8 tile of the image in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(np.round(area_resize(image, side, side), 6)), 0, 255).astype(np.uint8))
    return out.getvalue()


def to_media(text: bytes, form: str = "pgm") -> bytes:
    """UTF-8 bytes, padded with 0 to a positive multiple of 64, as the samples of an image 64 wide."""
    payload = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(image) if form == "pgm" else encode_bmp(image)


def describe(media: bytes) -> dict:
    """Decoded payload's size, hash and checksum, and the features of an image column's value."""
    image = decode(media)
    grey = image if image.ndim == 2 else np.round(image.mean(2)).astype(image.dtype)
    payload, top = image.tobytes(), largest_value(media)
    if top != 255:
        grey = np.minimum(grey, top) * (255 / top)
    tile = npy_tile(grey)
    dhash = difference_hash(grey)
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{image.shape[0]}x{image.shape[1]};dhash={dhash};tile={zlib.crc32(tile):08x}", "dhash": dhash, "tile_npy": tile,
    }


_FIELDS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_SQL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id and features of a binary column of Netpbm or BMP files: payload figures, dhash and tile_npy. Null media give nulls;
    files that can't be decoded, that end early or have no samples, have their reason in `error`. Samples count by the file's
    largest value, so 16-bit images aren't clipped. A map over rows: repeated rows give equal rows, an empty table an empty
    one; ties of neighbouring cells are a 0 in dhash; further columns aren't taken."""
    fields = [*_FIELDS, ("dhash", pa.string()), ("tile_npy", pa.binary()), ("error", pa.string())]

    def run(batches):
        for batch in slices(batches):
            found = []
            for x in batch.column("m").to_pylist():
                try:
                    found.append({} if x is None else describe(x))
                except (ValueError, IndexError, struct.error) as e:
                    found.append({"error": str(e)})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x.get(k) for x in found], t) for k, t in fields)], names=["doc_id", *(k for k, _ in fields)])

    return df.selectExpr("doc_id", f"`{media}` AS m").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {_SQL}, dhash string, tile_npy binary, error string")


def encode_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id and media: each text (null: empty) as a grey image 64 samples wide in form 'pgm' or 'bmp'."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([to_media(x, form) for x in texts_of(batch.column("text"))], pa.binary())], names=["doc_id", "media"])

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def _round_trip(form: str):
    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            found = [describe(to_media(x, form)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), *(pa.array([x[k] for x in found], t) for k, t in _FIELDS)], names=["doc_id", "n_bytes", *(k for k, _ in _FIELDS)])

    return run


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """Store each text as an image, read the stored bytes back and describe them; a map over rows, equal texts give equal values.

    A null or empty text is 64 zero bytes; repeated rows give equal rows, an empty table an empty one, and other columns are not
    taken. A long text is one image, resized in strips of bounded size.
    """
    return docs.selectExpr("CAST(doc_id AS long) doc_id", "text").mapInArrow(_round_trip(form), f"doc_id long, n_bytes long, {_SQL}")


def op5(spark, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
