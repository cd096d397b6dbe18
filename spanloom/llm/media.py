"""Operator 7: media columns and signature sniffing.

:func:`store` keeps text losslessly as 8-bit samples of WAVE files in a media column, with the declared type beside it, written as a table to the shared folder
and read back. :func:`sniff` looks into any binary column: one
Aho-Corasick automaton finds all magic bytes in one pass, a validator for each format confirms structure and lengths (chunk checksums, block and page
chains, directory offsets), the declared type is corrected by what starts at offset 0, and complete media inside or behind it are found. :func:`carve`
gives their bytes as rows, with the media that lie inside them in turn.

Rows: null text is stored as empty text, null bytes have null results; bytes with no valid medium at offset 0 are
``application/octet-stream`` with length null; equal bytes give equal results; an empty table gives no row. Of overlapping
embedded media the first to start counts. A very long text is one file, held in memory as a whole together with its payload; beyond 4 GB, which the lengths of the format
cannot say, storing it is an error. Names of the added columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.staging import staged

#: Magic bytes of public formats, and how far behind the start of the medium they stand.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "application/riff": (b"RIFF", 0),
    "application/ogg": (b"OggS", 0),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
}
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
BLOCK = 64
RATE = 8000
#: A gzip member is decompressed to check it, in pieces of this size.
PIECE = 1 << 20

SNIFFED = "media_type string, media_length long, corrected boolean, embedded array<struct<type:string,offset:long,length:long>>"


def png(b: bytes, at: int):
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first and (kind, n) != (b"IHDR", 13):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return "image/png", i - at
    return None


def jpeg(b: bytes, at: int):
    i = at + 2
    scanned = False
    while i + 4 <= len(b) and b[i] == 0xFF:
        mark = b[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or mark < 0xC0 or 0xD0 <= mark <= 0xD9:
            break
        i += 2 + n
        if mark == 0xDA:
            scanned = True
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return ("image/jpeg", i + 2 - at) if scanned and b[i : i + 2] == b"\xff\xd9" else None


def gif(b: bytes, at: int):
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while i < len(b):
        if b[i] == 0x3B:
            return "image/gif", i + 1 - at
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 <= len(b):
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0)
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def bmp(b: bytes, at: int):
    if at + 26 > len(b):
        return None
    n, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", n) if header in (12, 40, 52, 56, 64, 108, 124) and not spare and 14 + header <= start <= n <= len(b) - at else None


def riff(b: bytes, at: int):
    if at + 12 > len(b):
        return None
    n, form = struct.unpack_from("<I4s", b, at + 4)
    end, i = at + 8 + n, at + 12
    if form not in RIFF_FORMS or end > len(b):
        return None
    chunks = 0
    while i + 8 <= end:
        i += 8 + (size := struct.unpack_from("<I", b, i + 4)[0]) + (size & 1)
        chunks += 1
    return (RIFF_FORMS[form], end - at) if i == end and chunks else None


def ogg(b: bytes, at: int):
    i = at
    last = False
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b):
        n = b[i + 26]
        last = bool(b[i + 5] & 4)
        i += 27 + n + sum(b[i + 27 : i + 27 + n])
        if last:
            break
    return ("application/ogg", i - at) if last and i <= len(b) else None


def pdf(b: bytes, at: int):
    if not b[at + 5 : at + 6].isdigit():
        return None
    after = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, after if after > 0 else len(b))
    return ("application/pdf", end + 5 - at) if end > 0 and b.rfind(b"startxref", at, end) > 0 else None


def zipped(b: bytes, at: int):
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        n, offset, comment = struct.unpack_from("<IIH", b, end + 12)
        if offset + n == end - at and b[at + offset : at + offset + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
            return ("application/zip", end + 22 + comment - at) if end + 22 + comment <= len(b) else None
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def gzipped(b: bytes, at: int):
    d, i = zlib.decompressobj(31), at
    try:
        rest = b[i : i + PIECE]
        while not d.eof and (rest or d.unconsumed_tail):
            d.decompress(d.unconsumed_tail or rest, PIECE)
            if not d.unconsumed_tail and not d.eof:
                i += PIECE
                rest = b[i : i + PIECE]
    except zlib.error:
        return None
    return ("application/gzip", min(len(b), i + PIECE) - len(d.unused_data) - at) if d.eof else None


VALIDATORS = {"image/png": png, "image/jpeg": jpeg, "image/gif": gif, "image/bmp": bmp, "application/riff": riff, "application/ogg": ogg, "application/pdf": pdf, "application/zip": zipped, "application/gzip": gzipped}


def automaton():
    """Finds every magic string in one pass over a Latin-1 view of the bytes."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, (magic, back) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) + back))
    found.make_automaton()
    return found


def look(b: bytes, finder) -> tuple[str, int | None, list[dict]]:
    """(type, length, embedded) of some bytes."""
    kind, length, embedded, free = "application/octet-stream", None, [], 0
    for last, (name, span) in finder.iter(b.decode("latin-1")):
        at = last + 1 - span
        if at < free or at == 0 and length is not None:
            continue
        if valid := VALIDATORS[name](b, at):
            if at == 0:
                kind, length = valid
            else:
                embedded.append({"type": valid[0], "offset": at, "length": valid[1]})
                free = at + valid[1]
    return kind, length, embedded


def sniff(df: DataFrame, column: str, declared: str | None = None) -> DataFrame:
    """``df`` with media_type, media_length, corrected and embedded for a binary column; ``declared`` names a column of types."""

    @F.pandas_udf(SNIFFED)
    def judge(data, said):
        import pandas as pd

        finder, rows = automaton(), []
        for b, d in zip(data, said, strict=True):
            if b is None:
                rows.append((None, None, None, None))
                continue
            kind, length, embedded = look(bytes(b), finder)
            rows.append((kind, length, d is not None and d != kind, embedded))
        found = pd.DataFrame(rows, columns=["media_type", "media_length", "corrected", "embedded"])
        return found.astype({"media_length": "Int64"})

    said = F.col(declared) if declared else F.lit(None).cast("string")
    names = ["media_type", "media_length", "corrected", "embedded"]
    plain = df.drop(*names)
    return plain.withColumn("sniffed__", judge(F.col(column), said)).select(*plain.columns, *[F.col(f"sniffed__.{n}") for n in names])


def carve(df: DataFrame, column: str, deepest: int = 3) -> DataFrame:
    """A row for each medium embedded in the bytes of a column of ``df``, and in those carved, up to ``deepest`` levels.

    Keeps the columns of ``df`` but the bytes; adds depth (from 1), offset (in what it was carved from), media and what :func:`sniff` says of them.
    """
    level = sniff(df, column).withColumn("depth", F.lit(0))
    plain = [c for c in df.columns if c not in (column, "media", "depth", "offset")]
    found = None
    for depth in range(1, deepest + 1):
        rows = level.select(*plain, F.col(column if depth == 1 else "media").alias("whole__"), F.explode("embedded").alias("e__"))
        part = F.substring("whole__", (F.col("e__.offset") + 1).cast("int"), F.col("e__.length").cast("int"))
        rows = rows.select(*plain, F.lit(depth).alias("depth"), F.col("e__.offset").alias("offset"), part.alias("media"))
        level = sniff(rows, "media").drop("corrected")
        found = level if found is None else found.unionByName(level)
    return found


def wave(payload: bytes) -> bytes:
    """A mono WAVE file of 8-bit samples."""
    if len(payload) > (1 << 32) - 64:
        raise ValueError("too long for the lengths of a WAVE file")
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(b: bytes) -> bytes:
    """The samples of the first data chunk."""
    i = 12
    while i + 8 <= len(b):
        name, n = struct.unpack_from("<4sI", b, i)
        if name == b"data":
            return b[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def stored(text: str | None) -> bytes:
    """Text as UTF-8, padded with 0 to a positive multiple of ``BLOCK``, as the samples of a WAVE file."""
    raw = (text or "").encode()
    return wave(raw + b"\0" * ((-len(raw)) % BLOCK or (0 if raw else BLOCK)))


def to_wave(text: Column) -> Column:
    """:func:`stored` of a string column."""
    return F.pandas_udf(lambda texts: texts.map(stored), "binary", F.PandasUDFType.SCALAR)(text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, mean long, crossings long, peak long"


def wave_features(media: Column) -> Column:
    """What the stored bytes hold, read back from the file: sizes, digests, and the samples' mean, zero crossings and peak about 128."""
    return F.pandas_udf(_features, FEATURES, F.PandasUDFType.SCALAR)(media)


def _features(media):
    import numpy as np
    import pandas as pd

    rows = []
    for b in media:
        payload = samples(bytes(b))
        x = np.frombuffer(payload, np.uint8)
        above = x >= 128
        digests = (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(b), hashlib.sha256(b).hexdigest())
        shape = (int(x.sum(dtype=np.int64)) // max(1, len(x)), int((above[1:] != above[:-1]).sum()), int(x.max(initial=0)))
        rows.append((len(payload), *digests, *shape))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "mean", "crossings", "peak"])


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes, media and declared: written to the shared folder, and read back from there."""
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    plain = [c for c in docs.columns if c not in (text, "n_bytes", "media", "declared")]
    return staged(docs.select(*plain, n_bytes, to_wave(F.col(text)).alias("media"), F.lit("audio/wav").alias("declared")), "media")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_media: every document stored as samples in a media column, read back and sniffed."""
    stored = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    seen = sniff(stored, "media", "declared").withColumn("f", wave_features(F.col("media")))
    embedded = F.transform("embedded", lambda e: F.concat_ws(":", e["type"], e["offset"].cast("string"), e["length"].cast("string")))
    values = ["media_type", "media_length", F.col("corrected").cast("string"), F.concat_ws(",", embedded), "f.mean", "f.crossings", "f.peak"]
    feature = F.format_string("%s;length=%d;corrected=%s;embedded=%s;mean=%d;crossings=%d;peak=%d", *values)
    return seen.select("doc_id", "n_bytes", "f.payload_bytes", "f.payload_sha256", "f.tail_crc32", "f.media_bytes", "f.media_sha256", feature.alias("feature"))
