"""TIFF columns: image directories, strips and tiles, PackBits, LZW and deflate, predictors.

``tiff_pages`` takes a column of files and gives one row for each page. ``encode`` writes the
same family of files; ``op3`` uses both to store texts as 8-bit samples and read them back.

A null or empty file has no pages and gives no row; a file that is damaged gives the pages
before the damage and one row whose ``error`` names it. Directory loops end the walk. Nothing is
allocated on a file's word alone: an image is as large as its blocks can unpack to at most, and
a block is unpacked no further than it is needed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_slices, table

# Fixed values of the format: tags, field types, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
#: Bytes that one packed byte unpacks to at most: runs of 128 in two bytes, deflate's 258 in two
#: bits, and LZW's strings of up to 3838 in 12 bits.
MOST = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 2560}
#: A page's blocks may name the same bytes, up to so many times the file in all.
SHARED = 16
WHOLE_NUMBERS = frozenset("BHIQ")


class Damaged(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: bytes = field(repr=False)


def unpack_bits(data: bytes, need: int | None = None) -> bytes:
    out, at, end, made = [], 0, len(data), 0
    while at < end and (need is None or made < need):
        n = data[at]
        at += 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
            made += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
            made += 257 - n
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end:
        run = at + 1
        while run < end and run - at < 128 and data[run] == data[at]:
            run += 1
        if run - at > 1:
            out += bytes((257 - (run - at), data[at]))
            at = run
            continue
        stop = at + 1
        while stop < end and stop - at < 128 and not (stop + 1 < end and data[stop] == data[stop + 1]):
            stop += 1
        out.append(stop - at - 1)
        out += data[at:stop]
        at = stop
    return bytes(out)


def unpack_lzw(data: bytes, need: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widths grow one code early."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, out, was = list(first), [], b""
    bits = held = at = made = 0
    width = 9
    while need is None or made < need:
        while held < width:
            if at >= len(data):
                return b"".join(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFFFF
            at += 1
            held += 8
        code = bits >> held - width & (1 << width) - 1
        held -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            known, was, width = list(first), b"", 9
            continue
        if code < len(known):
            entry = known[code]
        elif code == len(known) and was:
            entry = was + was[:1]
        else:
            raise Damaged(f"LZW code {code} of {len(known)}")
        out.append(entry)
        made += len(entry)
        if was and len(known) < 4096:
            known.append(was + entry[:1])
        was = entry
        if len(known) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits = (bits & (1 << held) - 1) << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)

    put(256)
    known = {bytes((i,)): i for i in range(256)}
    count, run = 258, b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in known:
            run = longer
            continue
        put(known[run])
        known[longer] = count
        count += 1
        if count + 1 > 1 << width and width < 12:
            width += 1
        if count >= 4094:
            put(256)
            known = {bytes((i,)): i for i in range(256)}
            count, width = 258, 9
        run = data[i : i + 1]
    if run:
        put(known[run])
        count += 1
        if count + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def _unpacked(data: bytes, compression: int, need: int) -> bytes:
    """At least ``need`` bytes, if the block has them."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, need)
    if compression == LZW:
        return unpack_lzw(data, need)
    try:
        return zlib.decompressobj().decompress(data, need)
    except zlib.error as e:
        raise Damaged(str(e)) from e


def _summed(block: bytes, rows: int, columns: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """A block's rows as native samples, horizontal or floating-point differences undone."""
    if predictor == 3:
        size = bits // 8
        raw = np.frombuffer(block, np.uint8, rows * columns * samples * size).reshape(rows, -1)
        raw = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f">f{size}").astype(f"<f{size}").reshape(rows, columns, samples)
    kind = np.dtype(f"{order}u{bits // 8}")
    grid = np.frombuffer(block, kind, rows * columns * samples).reshape(rows, columns, samples).astype(kind.newbyteorder("<"))
    return np.cumsum(grid, axis=1, dtype=grid.dtype) if predictor == 2 else grid


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[str, list]], int]:
    try:
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags: dict[int, tuple[str, list]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            size = struct.calcsize(TYPES[kind]) * count
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(f"{order}I", data, where)
            if where + size > len(data):
                raise Damaged(f"tag {tag} lies outside the file")
            tags[tag] = TYPES[kind], list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where))
        return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise Damaged(f"directory at {at}: {e}") from e


def _numbers(tags: dict[int, tuple[str, list]], tag: int, default: list[int]) -> list[int]:
    """The whole numbers of a tag: signed, real or textual values, or none at all, are damage."""
    kind, values = tags.get(tag, ("I", default))
    if kind not in WHOLE_NUMBERS or not values and tag in tags:
        raise Damaged(f"tag {tag} has no whole numbers")
    return values


def _page(data: bytes, tags: dict[int, tuple[str, list]], order: str) -> Page:
    one = lambda tag, default: _numbers(tags, tag, [default])[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planes = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or not samples:
        raise Damaged("no width, height or samples")
    if compression not in MOST:
        raise Damaged(f"compression {compression}")
    if predictor not in (1, 2, 3) or predictor == 3 and bits not in (16, 32, 64):
        raise Damaged(f"predictor {predictor} of {bits} bits")
    if bits not in (1, 8, 16, 32, 64) or bits == 1 and (samples != 1 or predictor != 1) or set(_numbers(tags, BITS, [bits])) != {bits}:
        raise Damaged(f"{bits} bits a sample")
    tiled = TILE_OFFSETS in tags
    if tiled:
        across, down = one(TILE_WIDTH, width), one(TILE_HEIGHT, height)
        offsets, counts = _numbers(tags, TILE_OFFSETS, []), _numbers(tags, TILE_COUNTS, [])
    else:
        across, down = width, min(height, one(ROWS_PER_STRIP, height))
        offsets, counts = _numbers(tags, STRIP_OFFSETS, []), _numbers(tags, STRIP_COUNTS, [])
    if not across or not down or len(offsets) != len(counts):
        raise Damaged("blocks have no size")
    columns, rows = -(-width // across), -(-height // down)
    layers, each = (samples, 1) if planes == 2 else (1, samples)
    if len(offsets) < columns * rows * layers:
        raise Damaged(f"{len(offsets)} of {columns * rows * layers} blocks")
    size = max(1, bits // 8)
    block_bytes = across * each * size if bits > 1 else -(-across // 8)
    if sum(counts) > SHARED * len(data):
        raise Damaged(f"blocks of {sum(counts)} bytes in {len(data)}")
    tall_of = lambda i: down if tiled else min(down, height - i // columns % rows * down)
    for i in range(columns * rows * layers):
        if offsets[i] + counts[i] > len(data):
            raise Damaged(f"block {i} lies outside the file")
        if tall_of(i) * block_bytes > MOST[compression] * counts[i]:
            raise Damaged(f"block {i} is short")
    kind = np.dtype("u1") if bits == 1 else np.dtype(f"<f{bits // 8}" if predictor == 3 else f"<u{bits // 8}")
    image = np.zeros((height, width, samples), kind)
    for i in range(columns * rows * layers):
        layer, y, x = i // (columns * rows), i // columns % rows * down, i % columns * across
        tall = tall_of(i)
        need = tall * block_bytes
        block = _unpacked(data[offsets[i] : offsets[i] + counts[i]], compression, need)
        if len(block) < need:
            raise Damaged(f"block {i} is short")
        if bits == 1:
            grid = np.unpackbits(np.frombuffer(block, np.uint8, need).reshape(tall, -1), axis=1)[:, :across, None]
        else:
            grid = _summed(block, tall, across, each, bits, order, predictor)
        grid = grid[: height - y, : width - x]
        image[y : y + grid.shape[0], x : x + grid.shape[1], layer : layer + each] = grid
    return Page(width, height, samples, bits, NAMES[compression], predictor, tiled, image.tobytes())


def pages(data: bytes) -> Iterator[Page]:
    """The file's pages in the order of its directories; Damaged where it cannot be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise Damaged("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order)


def encode(images: list[tuple[bytes, int, int]], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """(8-bit samples, width, height) pages as one file, in strips or in square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    pack = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1)}[compression]
    for samples, width, height in images:
        grid = np.frombuffer(samples, np.uint8).reshape(height, width)
        if tile:
            whole = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            whole[:height, :width] = grid
            blocks = [whole[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            blocks = [grid[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            packed = pack(block.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        fields = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack(f"{order}I", where)
            fields += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        link = len(out) + 2 + len(fields)
        out += struct.pack(f"{order}H", len(tags)) + fields + b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row for each page of each file: ``id``, page number, geometry, samples row by row
    (little end first, channels together)."""

    def work(c: dict[str, list]) -> dict[str, list]:
        rows = []
        for key, data in zip(c["id"], c["content"], strict=True):
            n = 0
            try:
                for p in pages(bytes(data)) if data else ():
                    rows.append((key, n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None))
                    n += 1
            except Damaged as e:
                rows.append((key, n, *[None] * 8, str(e)))
        names = ["id", *[x.split()[0] for x in PAGE_SCHEMA.split(", ")]]
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")), work, f"id {kind}, {PAGE_SCHEMA}")


#: op3 stores 64 samples a row and so many rows a page, deflated in strips after differencing.
ROW, PAGE_ROWS = 64, 4096


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0")


def store(data: bytes) -> bytes:
    size = ROW * PAGE_ROWS
    return encode([(data[at : at + size], ROW, len(data[at : at + size]) // ROW) for at in range(0, len(data), size)], DEFLATE, predictor=2)


def feature(data: bytes) -> str:
    """A coarse histogram (16 bins in 1/255) and a difference hash of 8 x 8 cells."""
    a = np.frombuffer(data, np.uint8)
    bins = np.bincount(a >> 4, minlength=16) * 255 // len(a)
    cells = np.add.reduceat(a.astype(np.int64), np.arange(72) * len(a) // 72).reshape(8, 9) if len(a) >= 72 else np.resize(a, 72).astype(np.int64).reshape(8, 9)
    marks = np.packbits(cells[:, 1:] > cells[:, :-1])
    return bins.astype(np.uint8).tobytes().hex() + ":" + marks.tobytes().hex()


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF file and back; what is told comes from the bytes that were read."""

    def work(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pages", "feature")}
        for doc, text in zip(c["doc_id"], c["text"], strict=True):
            n, data = payload(text)
            media = store(data)
            read = list(pages(media))
            back = b"".join(p.pixels for p in read)
            for name, value in zip(out, (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(read), feature(back)), strict=True):
                out[name].append(value)
        return out

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(docs, work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pages long, feature string")
