"""Operator 1: token ids in sorted-string-table shards.

A shard is one immutable file of (key, value) entries in key order::

    block*  index  bloom  meta  footer

block   entries ``varint shared, varint unshared, varint value_len, key suffix, value``, where ``shared`` bytes of the key
        are those of the entry before it; every ``RESTART``-th entry shares nothing. After the entries: their restart
        offsets (u32 each), the number of restarts (u32) and the CRC-32 of all before it (u32).
index   an entry per block, sparse: u32 offset pairs, entries before it, and the block's last key.
bloom   ``BITS_PER_KEY`` bits a key, double hashing of one xxh64.
meta    JSON: id width, end id, entries, tokens, first and last key.
footer  u64 offset and u32 length of index, bloom and meta, CRC-32 of those three, magic.

Keys are order-preserving: a null id is ``00``, an integer ``01`` and 8 big-endian bytes with the sign bit flipped. Values are
little-endian ids, 2 bytes wide where the vocabulary allows. Point lookup asks the Bloom filter, searches the index and then
the block's restarts, each by halving.

A shard ends at ``shard_bytes``, so one task may write several, and its writer holds a block, the sparse index and 8 bytes a key.

Rows: a null text is empty (its entry holds the end id alone); a null doc_id sorts first; repeated ids are separate entries with
one key, ordered by a hash of the text; strings of special tokens in a text get the ids that the tokenizer gives them; very long texts are encoded
whole; an empty table gives no shard and no row; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.shared_fs import open_fs
from spanloom.llm.worker import tidy
from spanloom.staging import new_path

MAGIC = b"SPLSST01"
RESTART = 16
BITS_PER_KEY = 10
FOOTER = "<QIQIQII8s"
MANIFEST = "task int, shard int, path string, n_docs long, n_tokens long, first_key binary, last_key binary"
ENCODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def unpack_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key)


def bloom_bits(h: int, n_bits: int) -> list[int]:
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) % n_bits for i in range(7)]


class SSTableWriter:
    """Streams sorted entries to an open binary file; holds one block, the index and a hash of each key."""

    def __init__(self, out, id_width: int, end_id: int, block_bytes: int = 1 << 16):
        self.out, self.id_width, self.end_id, self.block_bytes = out, id_width, end_id, block_bytes
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""
        self.at, self.index, self.hashes = 0, [], array("Q")
        self.n = self.tokens = self.before = 0
        self.first: bytes | None = None

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            shared = len(os.path.commonprefix([self.last, key]))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if self.first is None:
            self.first = key
        if self.n == 0 or key != self.last:
            self.hashes.append(key_hash(key))
        self.last = key
        self.in_block += 1
        self.n += 1
        self.tokens += len(value) // self.id_width
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        body = bytes(self.block) + b"".join(struct.pack("<I", r) for r in self.restarts) + struct.pack("<I", len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append((self.at, len(body), self.before, self.last))
        self._put(body)
        self.before = self.n
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<QIQH", *entry[:3], len(entry[3])) + entry[3] for entry in self.index)
        n_bits = max(64, len(self.hashes) * BITS_PER_KEY + 7 & ~7)
        bits = bytearray(n_bits // 8)
        for h in self.hashes:
            for b in bloom_bits(h, n_bits):
                bits[b >> 3] |= 1 << (b & 7)
        meta = json.dumps({"id_width": self.id_width, "end_id": self.end_id, "entries": self.n, "tokens": self.tokens, "first": (self.first or b"").hex(), "last": self.last.hex()}).encode()
        parts, places = [index, bytes(bits), meta], []
        for part in parts:
            places += [self.at, len(part)]
            self._put(part)
        self._put(struct.pack(FOOTER, *places, zlib.crc32(b"".join(parts)), MAGIC))
        self.out.close()


class SSTable:
    """Random access to one shard: ``source`` is a readable, seekable binary file."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        *places, crc, magic = struct.unpack(FOOTER, self._read(end - (size := struct.calcsize(FOOTER)), size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index, self.bloom, meta = (self._read(places[i], places[i + 1]) for i in (0, 2, 4))
        if zlib.crc32(index + self.bloom + meta) != crc:
            raise ValueError("damaged index")
        self.meta = json.loads(meta)
        self.index, at = [], 0
        while at < len(index):
            offset, length, before, n = struct.unpack_from("<QIQH", index, at)
            at += 22
            self.index.append((offset, length, before, index[at : at + n]))
            at += n

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        body = self._read(*self.index[i][:2])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged block")
        n = struct.unpack("<I", body[-8:-4])[0]
        entries = len(body) - 8 - 4 * n
        return body[:entries], list(struct.unpack(f"<{n}I", body[entries:-8]))

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = read_varint(body, at)
            unshared, at = read_varint(body, at)
            size, at = read_varint(body, at)
            key = key[:shared] + body[at : at + unshared]
            at += unshared
            yield key, body[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._entries(self._block(i)[0])

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values under an id, in file order; [] if it isn't there."""
        key = pack_key(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key_hash(key), len(self.bloom) * 8)):
            return []
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][3] < key else (low, mid)
        found: list[bytes] = []
        for i in range(low, len(self.index)):
            body, restarts = self._block(i)
            a, b = 0, len(restarts)
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if next(self._entries(body, restarts[mid]))[0] < key else (a, mid)
            for k, value in self._entries(body, restarts[max(0, a - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
        return found


class UnitEncoder:
    """Ids of whole texts through the tokenizers library.

    The usual splitting rule of byte-level tokenizers starts a new piece at each space that follows a non-space, so texts cut there encode
    part by part. Units of plain Latin letters, digits and signs are cut again where letters begin or end and at single line ends, which are borders under
    that rule as well. Arrow cuts and numbers the parts of a batch; each distinct one is encoded once, and up to ``most`` are remembered, as two Arrow arrays. Parts
    without inner white space go to the tokenizer ``TOGETHER`` at a time with line ends between them, which are pieces of their own there.
    Texts with white space before a space, where the rule looks ahead, with the characters 0 and 1, which mark first units and cuts here, or with the string of an added
    token, and texts for other tokenizers are encoded whole.
    """

    LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    SPACE = r"\s\x0b\x{85}\p{Z}\x1c-\x1f\x{180e}"
    TOGETHER = 64

    def __init__(self, definition: str, most: int = 300_000):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        added = [t["content"] for t in parts.get("added_tokens") or []]
        self.odd = "|".join([rf"[{self.SPACE}] ", r"[\x00\x01]", *map(re.escape, added)])
        pre = parts.get("pre_tokenizer") or {}
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not parts.get("normalizer")
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 and not any("\n" in t for t in added) else None
        self.most, self.known, self.known_ids = most, pa.array([], pa.string()), pa.array([], pa.binary())
        plain = f"!-&(-~{self.LETTER[6:]}"
        self.plain = rf"^[{plain}]+(\n[{plain}]+)*$"
        self.cuts = [(rf"([{self.LETTER}])([^{self.LETTER}])", "\\1\x01\\2"), (rf"([^{self.LETTER} \x01])([{self.LETTER}])", "\\1\x01\\2"), (r"([^\x01])\n", "\\1\x01\n"), (r"\n([^\x01])", "\n\x01\\1")]
        self.solid = rf"^ ?[^{self.SPACE}]+$"

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, parts):
        """Ids of distinct parts without inner white space, as a binary array."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(parts)
        if self.line_end is None or not n:
            return pa.array(self.whole(parts.to_pylist()), pa.binary())
        starts = np.append(np.arange(0, n, self.TOGETHER, dtype=np.int32), np.int32(n))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), parts), "\n").to_pylist()
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.array([*x, self.line_end], self.dtype) for x in lists])
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != n:
            raise ValueError("a part holds a line end")
        kept = np.delete(ids, ends)
        offsets = np.zeros(n + 1, np.int32)
        offsets[1:] = (ends - np.arange(n)) * ids.itemsize
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])

    def learn(self, parts):
        """Ids of distinct parts, as (binary array, where in it each part's ids are)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(parts, value_set=self.known)
        new = parts.filter(pc.is_null(at))
        solid = pc.match_substring_regex(new, self.solid)
        rest = new.filter(pc.invert(solid))
        new = pa.concat_arrays([new.filter(solid), rest])
        pool = pa.concat_arrays([self.known_ids, self.together(new[: len(new) - len(rest)]), pa.array(self.whole(rest.to_pylist()), pa.binary())])
        names = pa.concat_arrays([self.known, new])
        place = pc.if_else(pc.is_null(at), pc.add(pc.index_in(parts, value_set=new), len(self.known)), at)
        if len(names) > self.most:
            used = pa.array(np.sort(place.to_numpy())[: self.most])
            self.known, self.known_ids = names.take(used), pool.take(used)
        else:
            self.known, self.known_ids = names, pool
        return pool, place

    @staticmethod
    def lots(batch, rows: int = 1024, most_bytes: int = 1 << 22):
        """Slices of a batch whose second column, of texts, has at most ``most_bytes`` in ``rows`` rows; a longer text is one by itself."""
        import numpy as np

        ends, i = UnitEncoder.offsets(batch.column(1)), 0
        while i < batch.num_rows:
            j = int(np.searchsorted(ends, int(ends[i]) + most_bytes, "right")) - 1
            j = min(max(j, i + 1), i + rows, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j

    @staticmethod
    def offsets(x):
        import numpy as np

        return np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4)

    def encode(self, texts) -> list[bytes]:
        """Ids of a string array's texts, as bytes."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_unit:
            return self.whole(texts.to_pylist())
        is_odd = pc.match_substring_regex(texts, self.odd)
        marked = pc.binary_join_element_wise("\0", pc.if_else(is_odd, "", texts), "")
        pieces = pc.split_pattern(marked, " ")
        coded = pc.list_flatten(pieces).dictionary_encode()
        first = pc.starts_with(coded.dictionary, "\0")
        body = pc.if_else(first, pc.utf8_slice_codeunits(coded.dictionary, 1), coded.dictionary)
        units = cut = pc.binary_join_element_wise(pc.if_else(first, "", " "), body, "")
        for border, by in self.cuts:
            cut = pc.replace_substring_regex(cut, border, by)
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(body, self.plain), cut, units), "\x01")
        distinct = pc.list_flatten(parts).dictionary_encode()
        pool, place = self.learn(distinct.dictionary)
        of_parts = pool.take(place.take(distinct.indices))
        bounds = self.offsets(of_parts)[self.offsets(parts)]
        of_units = pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(bounds), of_parts.buffers()[2]])
        taken = of_units.take(coded.indices)
        data = memoryview(taken.buffers()[2] or b"")
        bounds = self.offsets(taken)[self.offsets(pieces)].tolist()
        return [self.whole([texts[i].as_py()])[0] if odd else bytes(data[bounds[i] : bounds[i + 1]]) for i, odd in enumerate(is_odd.to_pylist())]


_KEPT: dict[str, UnitEncoder] = {}


def kept_encoder(definition: str) -> UnitEncoder:
    """The worker process's encoder for a tokenizer, with the parts that earlier tasks have met."""
    if definition not in _KEPT:
        _KEPT.clear()
        _KEPT[definition] = UnitEncoder(definition)
    return _KEPT[definition]


def write_sstables(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int = 2, block_bytes: int = 1 << 16, shard_bytes: int = 1 << 28) -> DataFrame:
    """Encode ``text`` of ``docs`` and write it to shards in ``folder`` by ascending ``doc_id``; returns the manifest, a row per shard.

    One range shuffle moves the texts; each task streams shards of about ``shard_bytes``, so memory holds a batch, a block and a shard's index, whatever a task is
    dealt. A task that runs again writes other files, and the manifest, itself a table in ``folder``, names those that count.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(tokenizer_json)
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)

    def shards(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, shard, writer, at = TaskContext.get().partitionId(), 0, None, ""

        def entry():
            writer.close()
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [at], "n_docs": [writer.n], "n_tokens": [writer.tokens], "first_key": pa.array([writer.first], pa.binary()), "last_key": pa.array([writer.last], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = kept_encoder(definition.value)
            end = end_id.to_bytes(2 if encoder.dtype == "<u2" else 4, "little")
            for part in encoder.lots(batch):
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    if writer is not None and writer.at >= shard_bytes:
                        yield entry()
                        writer, shard = None, shard + 1
                    if writer is None:
                        at = f"{folder}/{task:06d}-{shard:04d}-{uuid.uuid4().hex}.sst"
                        fs, path = open_fs(at)
                        writer = SSTableWriter(fs.open_output_stream(path), len(end), end_id, block_bytes)
                    writer.add(pack_key(doc_id), ids + end)
        if writer is not None:
            yield entry()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ranged.mapInArrow(tidy(shards), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_sstables(manifest: DataFrame) -> DataFrame:
    """A row per document of the shards in a manifest: doc_id, start, n_tokens and ids_crc32, from the files alone.

    ``start`` counts the ids of all documents before it: the shards' totals are summed over the manifest, which has a row per shard.
    """
    order = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("task", "shard", "path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def documents(batches):
        import numpy as np
        import pyarrow as pa

        def batch(rows):
            ids, starts, counts, crcs = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

        for shards in batches:
            for at, start in zip(shards.column(2).to_pylist(), shards.column(3).to_pylist(), strict=True):
                fs, path = open_fs(at)
                rows = []
                with fs.open_input_file(path) as source:
                    table = SSTable(source)
                    dtype = f"<u{table.meta['id_width']}"
                    for key, value in table:
                        ids = np.frombuffer(value, dtype)
                        rows.append((unpack_key(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return placed.repartitionByRange(max(1, manifest.count()), "task", "shard").mapInArrow(tidy(documents), ENCODED)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back."""
    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return read_sstables(write_sstables(docs, new_path(docs.sparkSession, "sstables"), definition, end_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_sstable: every document's place, length and checksum of ids in the shards."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
