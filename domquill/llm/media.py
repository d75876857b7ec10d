"""TIFF columns: image directories, PackBits, LZW and deflate, strips and tiles, predictors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

# Fixed values of the TIFF 6.0 format: tag numbers, field types and their sizes, codecs.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Codecs of encoded payloads: LZW and PackBits run in Python, so most payloads are deflated.
CODECS = (LZW, PACKBITS, *[DEFLATE] * 6)
LZW_CLEAR, LZW_END = 256, 257

#: Most rows of an encoded page: pages of a long payload stay small, and are read one at a time.
PAGE_ROWS = 8192
#: Samples in a row of an encoded page.
ROW = 576
#: Bytes that a byte of a segment decodes to at most: LZW has words of up to 4096 bytes and codes of
#: 9 bits, deflate and PackBits gain less.
MOST_GAIN = 4096


class TiffError(ValueError):
    """A file that isn't TIFF, or whose directories, segments or codes are wrong."""


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # (height, width, samples)


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of equal bytes, and literal stretches, of at most 128 each."""
    out, i, n = bytearray(), 0, len(data)
    x = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if n else np.zeros(0, int)
    lengths = np.diff(np.append(starts, n))
    literal = bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for i, length in zip(starts.tolist(), lengths.tolist()):
        if length < 3:
            literal += data[i : i + length]
            continue
        flush()
        for k in range(0, length, 128):
            part = min(128, length - k)
            out += bytes((257 - part & 255, data[i])) if part > 1 else bytes((0, data[i]))
    flush()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        code = data[i]
        if code < 128:
            out += data[i + 1 : i + 2 + code]
            i += 2 + code
        elif code > 128:
            out += data[i + 1 : i + 2] * (257 - code)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """LZW of TIFF: most significant bit first, codes widen one entry early."""
    bits = [(LZW_CLEAR, 9)]
    table, width, prefix = {bytes((b,)): b for b in range(256)}, 9, b""
    following = 258
    for b in data:
        longer = prefix + bytes((b,))
        if longer in table:
            prefix = longer
            continue
        bits.append((table[prefix], width))
        table[longer] = following
        following += 1
        if following == 4094:
            bits.append((LZW_CLEAR, width))
            table, width, following = {bytes((c,)): c for c in range(256)}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
        prefix = bytes((b,))
    if prefix:
        bits.append((table[prefix], width))
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    bits.append((LZW_END, width))
    value = total = 0
    out = bytearray()
    for code, n in bits:
        value, total = value << n | code, total + n
        while total >= 8:
            total -= 8
            out.append(value >> total)
            value &= (1 << total) - 1
    if total:
        out.append(value << (8 - total))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    made, at, total = 0, 0, len(data) * 8
    table: list[bytes] = []
    width, last = 9, None
    padded = data + b"\0\0\0"
    while at + width <= total and made < size:
        byte = at >> 3
        code = (int.from_bytes(padded[byte : byte + 4], "big") >> (32 - width - (at & 7))) & ((1 << width) - 1)
        at += width
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = [bytes((b,)) for b in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if code > 255 or not table:
                raise TiffError("an LZW stream doesn't begin with a clear code")
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise TiffError("an LZW code isn't in the table yet")
        out.append(word)
        made += len(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _decoded(data: bytes, compression: int, size: int) -> bytes:
    if compression == RAW:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"a deflate segment can't be read: {e}") from e
    else:
        raise TiffError(f"compression {compression} isn't read here")
    if len(out) < size:
        raise TiffError(f"a segment has {len(out)} of {size} bytes")
    return out[:size]


def _encoded(data: bytes, compression: int) -> bytes:
    return {RAW: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[compression](data)


def read_pages(data: bytes) -> Iterator[Page]:
    """Walk the chain of image directories and decode a page at a time.

    Either byte order; 8 or 16 bits a sample, any number of samples, interleaved; strips or tiles;
    no compression, PackBits, LZW or deflate; predictor 1 or 2. Anything else, and a chain that
    comes back on itself, raises TiffError.
    """
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("not a TIFF file")
    end = "<" if data[:1] == b"I" else ">"
    seen, number = set(), 0
    try:
        (at,) = struct.unpack_from(f"{end}I", data, 4)
        while at:
            if at in seen:
                raise TiffError("the chain of directories is a circle")
            seen.add(at)
            (entries,) = struct.unpack_from(f"{end}H", data, at)
            tags = {}
            for k in range(entries):
                tag, kind, count = struct.unpack_from(f"{end}HHI", data, at + 2 + 12 * k)
                if kind in FIELD:
                    size = struct.calcsize(FIELD[kind]) * count
                    place = at + 10 + 12 * k
                    if not count:
                        raise TiffError(f"field {tag} has no value")
                    if size > 4:
                        (place,) = struct.unpack_from(f"{end}I", data, place)
                    tags[tag] = struct.unpack_from(f"{end}{count}{FIELD[kind]}", data, place)
            yield _page(data, end, tags, number)
            number += 1
            (at,) = struct.unpack_from(f"{end}I", data, at + 2 + 12 * entries)
    except (struct.error, KeyError) as e:
        raise TiffError(f"a directory is cut short or lacks a field: {e}") from e


def _page(data: bytes, end: str, tags: dict, number: int) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, RAW), one(PREDICTOR, 1)
    if bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1 or one(SAMPLE_FORMAT, 1) != 1 or (one(PLANAR, 1) != 1 and samples > 1) or predictor not in (1, 2):
        raise TiffError("samples of this layout aren't read here")
    kind = np.dtype(f"{end}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        w, h, offsets, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        w, h, offsets, sizes = width, min(one(ROWS_PER_STRIP, height), height) or 1, tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if min(width, height, w, h, samples) < 1:
        raise TiffError("a page, or its segments, have no samples")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down or len(sizes) < across * down:
        raise TiffError("segments are missing")
    if width * height * samples * kind.itemsize > MOST_GAIN * sum(len(data[a : a + n]) for a, n in zip(offsets[: across * down], sizes)):
        raise TiffError("a page is larger than its segments can hold")
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        raw = data[offsets[k] : offsets[k] + sizes[k]]
        block = np.frombuffer(_decoded(raw, compression, rows * w * samples * kind.itemsize), kind).reshape(rows, w, samples).astype(out.dtype, copy=False)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + h, x : x + w] = block[: height - y, : width - x]
    return Page(number, width, height, samples, bits, compression, predictor, tiled, out)


def write_tiff(pages: list[tuple[np.ndarray, int, int, bool]]) -> bytes:
    """A little-endian file of (8-bit rows by columns, compression, predictor, tiled) pages."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, compression, predictor, tiled in pages:
        height, width = image.shape
        w, h = (64, 64) if tiled else (width, 128)
        offsets, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if tiled and block.shape != (h, w):
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1])), mode="edge")
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                part = _encoded(block.tobytes(), compression)
                offsets.append(len(out))
                sizes.append(len(part))
                out += part
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 3, [w]), (TILE_HEIGHT, 3, [h]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_BYTES, 4, sizes)]
        directory = struct.pack("<H", len(fields))
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(packed) > 4:
                place, packed = len(out), packed
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", place)
            directory += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0"
    return bytes(out)


def encode_payload(payload: bytes) -> bytes:
    """A payload whose length is a multiple of ROW as pages of at most PAGE_ROWS rows. The codec
    follows from the payload's checksum; pages take turns: strips with the horizontal predictor,
    then tiles without."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    codec = CODECS[zlib.crc32(payload) % len(CODECS)]
    return write_tiff([(rows[k : k + PAGE_ROWS], codec, 1 if n % 2 else 2, bool(n % 2)) for n, k in enumerate(range(0, len(rows), PAGE_ROWS))])


def padded(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, then bytes 255 up to a positive multiple of ROW; and the bare length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def tiff_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text, whole, as a TIFF file. Null and empty texts are one row of
    samples 255; equal texts give equal files, repeated rows a row each, an empty table none. Other
    columns are left out, and keys may be null."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [padded(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_payload(p) for p, _ in made], pa.binary())], [key, "n_bytes", "media"])

    return in_arrow(docs.select(key, text), write, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary", 128)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per page: (key, page, width, height, samples, bits, compression, predictor, tiled,
    pixels, error).

    ``pixels`` are the samples in rows, in this machine's byte order. A file that can't be read
    gives its pages up to the fault, then a row with the reason in ``error``; a null file one row
    with page null and error "null"; a file without directories no row. Repeated rows are read as
    often as they stand there; extra columns are left out. A page is in memory at a time.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *[f.split()[0] for f in PAGE_FIELDS.split(", ")]]
        kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                def row(*values, k=k):
                    return pa.record_batch([pa.array([k], batch.schema.field(0).type), *[pa.array([v], t) for v, t in zip(values, kinds)]], names)

                done = None
                try:
                    if blob.as_py() is None:
                        raise TiffError("null")
                    for p in read_pages(blob.as_py()):
                        done = p.page
                        yield row(p.page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None)
                except TiffError as e:
                    yield row(None if str(e) == "null" else (-1 if done is None else done) + 1, *[None] * 8, str(e))

    return in_arrow(df.select(key, media), walk, f"`{key}` {df.schema[key].dataType.simpleString()}, {PAGE_FIELDS}", 128)


def _features(data: bytes | None) -> tuple:
    if data is None:
        raise TiffError("null")
    sha, size, tail, pages = hashlib.sha256(), 0, b"", 0
    counts, equal, pairs = np.zeros(256, np.int64), 0, 0
    for p in read_pages(data):
        raw = p.pixels.tobytes()
        sha.update(raw)
        size, tail, pages = size + len(raw), (tail + raw[-32:])[-32:], pages + 1
        found = np.bincount(p.pixels.reshape(-1), minlength=len(counts))
        counts = found + np.pad(counts, (0, len(found) - len(counts)))
        flat = p.pixels.reshape(p.height, -1)
        equal += int(np.count_nonzero(flat[:, 1:] == flat[:, :-1]))
        pairs += p.height * (flat.shape[1] - 1)
    samples, value = max(int(counts.sum()), 1), np.arange(len(counts))
    share = counts[counts > 0] / samples
    mean = float(counts @ value) / samples
    spread = float(counts @ (value - mean) ** 2 / samples) ** 0.5
    feature = f"pages={pages};mean={mean:.4f};sd={spread:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};equal={equal / max(pairs, 1):.4f}"
    return size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, pages


def tiff_features(df: DataFrame, key: str, media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """A row per file, from the same walk over its pages: sizes, digests of the samples read back
    (in this machine's byte order) and of the file, and a feature string (pages, mean, deviation and
    entropy of the samples, and the share of rows' neighbours that are equal).

    A null file, and one that can't be read to its end, has nulls instead, and the reason in
    ``error``; a file without pages has no samples. Equal files give equal values, repeated rows a
    row each, an empty table none; a page is in memory at a time. Other columns are left out.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    rows.append((k, n, *_features(blob.as_py()), None))
                except TiffError as e:
                    rows.append((k, n, *[None] * 7, str(e)))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pages", "error"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 10, kinds)], names)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, error string"
    return in_arrow(df.select(key, n_bytes, media), digest, schema, 128)
