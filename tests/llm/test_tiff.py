import hashlib
import random
import struct
import zlib

import pytest

from tidemark.llm import tiff


def data(n, seed=0):
    r = random.Random(seed)
    return bytes(r.choice((0, 0, 0, 7, r.randrange(256))) for _ in range(n))


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_round_trip(compression, predictor, tile, order):
    images = [(data(70 * 41, 1), 70, 41), (data(64, 2), 64, 1), (data(20000, 3), 100, 200)]
    back = list(tiff.pages(tiff.encode(images, compression, predictor, 16, tile, order)))
    assert [(p.pixels, p.width, p.height) for p in back] == images
    assert {p.compression for p in back} == {tiff.NAMES[compression]} and {p.tiled for p in back} == {bool(tile)}


@pytest.mark.parametrize("n", [0, 1, 2, 255, 4000, 70000])
def test_codecs(n):
    for seed, d in enumerate((data(n), bytes(n), random.Random(n).randbytes(n), b"ab" * (n // 2))):
        assert tiff.unpack_lzw(tiff.pack_lzw(d)) == d, seed
        assert tiff.unpack_bits(tiff.pack_bits(d)) == d


def test_packbits_of_the_standard():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_damage():
    good = tiff.encode([(bytes(64), 64, 1)])
    for bad in (b"", b"II", b"PNG.....", good[:12], good[:-20]):
        with pytest.raises(tiff.Damaged):
            list(tiff.pages(bad))
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    assert len(list(tiff.pages(bytes(loop)))) == 1


def file_of(tags, data=b"", order="<"):
    """A file of one directory, (tag, type, count, value or offset) as they are given."""
    fields = b"".join(struct.pack(f"{order}HHI", t, k, n) + (v if isinstance(v, bytes) else struct.pack(f"{order}I", v)) for t, k, n, v in tags)
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, len(tags)) + fields + bytes(4) + data


def grey(width, height, packed, *more, compression=1):
    """A grey page in one strip; ``more`` tags replace or go beside its own."""
    n = 10 + 12 * (8 + sum(t[0] in (317, 339) for t in more)) + 4
    own = {256: (4, 1, width), 257: (4, 1, height), 258: (3, 1, 8), 259: (3, 1, compression), 273: (4, 1, n), 277: (3, 1, 1), 278: (4, 1, height), 279: (4, 1, len(packed))}
    own |= {t: tuple(x) for t, *x in more}
    return file_of([(t, *x) for t, x in sorted(own.items())], packed)


def test_lzw_of_the_standard():
    """The worked example of the format's specification: codes of nine bits."""
    codes = (256, 7, 258, 8, 8, 258, 6, 6, 257)
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.unpack_lzw(packed) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    (page,) = tiff.pages(grey(3, 3, packed, compression=5))
    assert page.pixels == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and page.compression == "lzw"
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    (page,) = tiff.pages(grey(24, 1, packed, compression=32773))
    assert page.pixels == tiff.unpack_bits(packed)


BROKEN = {
    "no count": grey(4, 4, bytes(16), (256, 4, 0, 4)),
    "huge": grey(2**31, 2**31, bytes(16)),
    "huge deflate": grey(2**20, 2**20, zlib.compress(bytes(64)), compression=8),
    "predictor 3 of bytes": grey(4, 4, bytes(16), (317, 3, 1, 3)),
    "predictor 9": grey(4, 4, bytes(16), (317, 3, 1, 9)),
    "negative": grey(4, 4, bytes(16), (256, 9, 1, struct.pack("<i", -4))),
    "real": grey(4, 4, bytes(16), (256, 11, 1, struct.pack("<f", 4.0))),
    "real rows": grey(4, 4, bytes(16), (278, 11, 1, struct.pack("<f", 1.5))),
    "no samples": grey(4, 4, bytes(16), (277, 3, 1, 0)),
    "text": grey(4, 4, bytes(16), (257, 2, 1, 4)),
    "bits": grey(4, 4, bytes(16), (258, 3, 1, 7)),
    "many samples": grey(4, 4, bytes(16), (277, 3, 1, 60000)),
    "unknown": grey(4, 4, bytes(16), compression=7),
    "lzw": grey(4, 4, bytes.fromhex("ffffffff"), compression=5),
    "short": grey(4, 4, bytes(15)),
    "outside": grey(4, 4, bytes(16), (273, 4, 1, 4000)),
    "many fields": b"II*\0\x08\0\0\0\xff\xff" + bytes(20),
}


def test_every_damage_is_a_row(spark):
    files = [(i, bytearray(f)) for i, f in enumerate(BROKEN.values())] + [(99, bytearray(grey(4, 4, bytes(range(16)))))]
    rows = {r["id"]: r for r in tiff.tiff_pages(spark.createDataFrame(files, "file long, content binary"), "file", "content").collect()}
    assert rows[99]["error"] is None and bytes(rows[99]["pixels"]) == bytes(range(16))
    assert {n: rows[i]["error"] for i, n in enumerate(BROKEN) if not rows[i]["error"]} == {}


def test_any_byte_may_be_wrong():
    """Flipped, cut and repeated bytes of good files give pages or damage, nothing else."""
    r = random.Random(12)
    good = [tiff.encode([(data(64 * 9, 1), 64, 9), (data(40, 2), 8, 5)], c, p, 4, t, o) for c in (1, 5, 8, 32773) for p in (1, 2) for t in (0, 16) for o in "<>"]
    for _ in range(3000):
        f = bytearray(r.choice(good))
        for _ in range(r.randint(1, 4)):
            f[r.randrange(len(f))] = r.randrange(256)
        f = bytes(f[: r.randint(1, len(f))]) if r.random() < 0.2 else bytes(f)
        try:
            list(tiff.pages(f))
        except tiff.Damaged:
            pass


def test_pages_operator(spark):
    files = [(1, tiff.encode([(bytes(64), 64, 1), (data(128), 64, 2)], tiff.LZW)), (2, None), (3, b"junk"), (4, b""), (None, tiff.encode([(data(64), 8, 8)], tiff.PACKBITS, 2, tile=16))]
    df = spark.createDataFrame(files, "file long, content binary")
    rows = sorted(tiff.tiff_pages(df, "file", "content").collect(), key=str)
    got = {(r["id"], r["page"]): (r["height"], r["error"]) for r in rows}
    assert got == {(1, 0): (1, None), (1, 1): (2, None), (3, 0): (None, "not a TIFF file"), (None, 0): (8, None)}


def plain_pages(media):
    """The pages of a stored text, read by the letter: strips, deflate, differences undone."""
    out, at = [], struct.unpack_from("<I", media, 4)[0]
    while at:
        (n,) = struct.unpack_from("<H", media, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from("<HHI", media, at + 2 + 12 * i)
            where = at + 10 + 12 * i
            if count * {3: 2, 4: 4}[kind] > 4:
                (where,) = struct.unpack_from("<I", media, where)
            tags[tag] = struct.unpack_from(f"<{count}{ {3: 'H', 4: 'I'}[kind] }", media, where)
        page = bytearray()
        for start, size in zip(tags[273], tags[279], strict=True):
            block = zlib.decompress(media[start : start + size])
            for row in range(0, len(block), tags[256][0]):
                was = 0
                for b in block[row : row + tags[256][0]]:
                    was = (was + b) % 256
                    page.append(was)
        out.append(bytes(page))
        (at,) = struct.unpack_from("<I", media, at + 2 + 12 * n)
    return out


def plain_feature(full):
    n = len(full)
    bins = [255 * sum(b >> 4 == k for b in full) // n for k in range(16)]
    edges = [k * n // 72 for k in range(73)]
    cells = [sum(full[a:b]) for a, b in zip(edges, edges[1:], strict=False)] if n >= 72 else [full[k % n] for k in range(72)]
    marks = "".join(str(int(cells[9 * y + x + 1] > cells[9 * y + x])) for y in range(8) for x in range(8))
    return bytes(bins).hex() + ":" + int(marks, 2).to_bytes(8, "big").hex()


def test_op3(spark, docs_dir):
    rows = {r["doc_id"]: r for r in tiff.op3_tiff(spark, docs_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for k, t in texts.items():
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-64:])
        media = tiff.store(full)
        assert r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["media_bytes"] == len(media)
        assert b"".join(plain_pages(media)) == full and r["n_pages"] == len(plain_pages(media))
        assert r["feature"] == plain_feature(full)
