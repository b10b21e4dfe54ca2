"""Token ids as sorted-string-table files, one for each range of document ids.

A file holds the documents of one id range in ascending order:

    data block*  index  filter  footer

Every part ends with the 16 bytes of MARK, which Spark's text writer puts there
as its line separator; the rest of a file is binary.  Spark's text reader, told
of the same separator, gives the parts one by one, so a file is split among
tasks and never held whole.  All integers are little-endian.

* data block: the letter D, a byte that is added to every byte of the body (0,
  or else what keeps MARK out of it), the file's number (4), ids of the file
  before this block (8), crc32 of the body (4), then the body: entries.  An entry
  is varint shared, varint unshared, varint value length, the key's last
  ``unshared`` bytes, the value.  A key shares its first ``shared`` bytes with the
  key before it; a block's first key shares none.
* index: the letter I, then for each block its offset (8), its length without
  MARK (4), its first key's length (2) and that key.
* filter: the letter F, number of probes (4), then the bits of a Bloom filter
  over the keys.
* footer, 64 bytes: "LDSSTAB2", index offset and length, filter offset and
  length, documents, ids in all (8 each), value width (4), crc32 of all before
  it in the footer (4).

A key is 0x00 for a null id, else 0x01 and the id as 8 big-endian bytes with
the sign bit turned, so bytes sort as ids do.  A value is the ids, 2 bytes each
while every id of the file is below 65,536, else 4.

Spark's own writer writes the files, so any store it knows will do, a task that
is lost or repeated leaves no half-written file, and no executor needs a path of
its own.  A lookup (``Folder.get``) finds the file by binary search over first
keys, then reads its footer, its filter and, by binary search over the index,
one data block, through the store's positioned reads.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, materialize, scratch
from .tokens import END_ID, default_path, encoder, vocabulary_size

MAGIC, FOOTER, BLOCK = b"LDSSTAB2", struct.Struct("<8s6QII"), struct.Struct("<cBIQI")
MARK = b"\x1eLDSST-part-end\n"
BLOCK_BYTES, BITS_PER_KEY, PROBES = 65_536, 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit numbers, PROBES for each key."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def turned(body: bytes, by: int) -> bytes:
    return bytes(body) if not by else (np.frombuffer(body, np.uint8) + np.uint8(by)).tobytes()


class Writer:
    """Takes documents in ascending order; gives the file's parts one by one."""

    def __init__(self, width: int, file: int = 0):
        self.width, self.file, self.offset = width, file, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[int, int, bytes]] = []
        self.keys: list[bytes] = []
        self.ids = self.before = 0

    def part(self, data: bytes) -> bytes:
        self.offset += len(data) + len(MARK)
        return data

    def add(self, doc_id: int | None, value: bytes) -> Iterator[bytes]:
        """value: ids of ``width`` bytes each, little-endian."""
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("documents out of order")
        if len(self.block) >= BLOCK_BYTES:
            yield self.flush()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width

    def flush(self) -> bytes:
        for by in range(256):
            body = turned(self.block, by)
            data = BLOCK.pack(b"D", by, self.file, self.before, zlib.crc32(body)) + body
            if MARK not in data + MARK[:-1]:
                break
        self.index.append((self.offset, len(data), self.first))
        self.block.clear()
        self.before = self.ids
        return self.part(data)

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self.flush()
        index_at = self.offset
        index = b"I" + b"".join(struct.pack("<QIH", at, n, len(k)) + k for at, n, k in self.index)
        yield self.part(index)
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        filled = np.zeros(bits, np.uint8)
        for a in range(0, len(self.keys), 10_000):
            filled[probes(self.keys[a : a + 10_000], bits).ravel()] = 1
        bloom_at, bloom = self.offset, b"F" + struct.pack("<I", PROBES) + np.packbits(filled, bitorder="little").tobytes()
        yield self.part(bloom)
        footer = FOOTER.pack(MAGIC, index_at, len(index), bloom_at, len(bloom), len(self.keys), self.ids, self.width, 0)[:-4]
        yield self.part(footer + struct.pack("<I", zlib.crc32(footer)))


def entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a data block."""
    _, by, _, _, crc = BLOCK.unpack_from(block)
    body = block[BLOCK.size :]
    if zlib.crc32(body) != crc:
        raise ValueError("a data block is damaged")
    data, at, key = turned(body, -by % 256), 0, b""
    while at < len(data):
        shared, at = read_varint(data, at)
        unshared, at = read_varint(data, at)
        size, at = read_varint(data, at)
        key = key[:shared] + data[at : at + unshared]
        at += unshared
        yield key, data[at : at + size]
        at += size


def place_of(block: bytes) -> tuple[int, int]:
    """(file, ids of the file before the block)."""
    return BLOCK.unpack_from(block)[2:4]


def four_bytes(value: bytes, width: int) -> bytes:
    return value if width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()


class Table:
    """One file, read through ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        at = size - FOOTER.size - len(MARK)
        footer = read(at, FOOTER.size) if at >= 0 else b""
        if len(footer) != FOOTER.size or footer[:8] != MAGIC or zlib.crc32(footer[:-4]) != struct.unpack("<I", footer[-4:])[0]:
            raise ValueError("not a whole table file")
        _, index_at, index_len, self.bloom_at, self.bloom_len, self.documents, self.ids, self.width, _ = FOOTER.unpack(footer)
        self.bits = b""
        self.blocks: list[tuple[int, int]] = []
        self.firsts: list[bytes] = []
        index, at = read(index_at, index_len), 1
        while at < len(index):
            offset, n, k = struct.unpack_from("<QIH", index, at)
            self.blocks.append((offset, n))
            self.firsts.append(index[at + 14 : at + 14 + k])
            at += 14 + k

    @classmethod
    def of(cls, data: bytes) -> Table:
        return cls(lambda at, n: data[at : at + n], len(data))

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for at, n in self.blocks:
            for key, value in entries(self.read(at, n)):
                yield id_of(key), four_bytes(value, self.width)

    def may_hold(self, key: bytes) -> bool:
        self.bits = self.bits or self.read(self.bloom_at + 5, self.bloom_len - 5)
        return all(self.bits[b >> 3] >> (b & 7) & 1 for b in probes([key], 8 * len(self.bits))[0].tolist())

    def get(self, key: bytes) -> list[bytes]:
        """Ids of every document of this key, in the file's order."""
        if not self.blocks or not self.may_hold(key):
            return []
        k, out = max(0, bisect_left(self.firsts, key) - 1), []  # repeated ids may begin in the block before
        for at, n in self.blocks[k : bisect_right(self.firsts, key)]:
            out += [four_bytes(value, self.width) for found, value in entries(self.read(at, n)) if found == key]
        return out


class Folder:
    """Table files under a path that Spark's file systems know; looked up from the driver without a job."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        folder = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [(s.getPath(), s.getLen()) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("part-") and s.getLen()]
        self.files = sorted(found, key=lambda f: int(f[0].getName().split("-")[1]))
        self.known: dict[int, Table] = {}

    def table(self, k: int) -> Table:
        if k not in self.known:
            path, size = self.files[k]

            def read(at: int, n: int) -> bytes:
                stream = self.fs.open(path)
                try:
                    stream.seek(at)
                    return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
                finally:
                    stream.close()

            self.known[k] = Table(read, size)
        return self.known[k]

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids (4 bytes each) of every document of this id; opens as many files as binary search needs."""
        key = key_of(doc_id)
        k = max(0, bisect_left(range(len(self.files)), key, key=lambda i: self.table(i).firsts[0]) - 1)
        out: list[bytes] = []
        while k < len(self.files) and self.table(k).firsts[0] <= key:
            out += self.table(k).get(key)
            k += 1
        return out


SAMPLE_ROWS = 1_000_000


def range_ends(docs: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Last (id, text hash) of each file's range but the last: about ``shard_bytes`` of text between two.

    Found on a sample of one row in 64 (10,000 rows at least) of at most about
    SAMPLE_ROWS rows, as Spark's own range partitioning does it.
    """
    n = docs.count()
    wanted = min(SAMPLE_ROWS, max(10_000, n // 64))
    some = docs.sample(min(1.0, wanted / max(1, n)), seed=1).select("id", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n"))
    some = some.toArrow().to_pandas().sort_values(["id", "h"])  # a bounded sample
    if not len(some):
        return []
    total = some["n"].cumsum().to_numpy() * (n / len(some))
    files = max(1, -(-int(total[-1]) // shard_bytes))
    at = np.unique(np.searchsorted(total, np.arange(1, files) * (total[-1] / files)))
    return list(dict.fromkeys(zip(some["id"].to_numpy()[at].tolist(), some["h"].to_numpy()[at].tolist(), strict=True)))


def write_tables(docs: DataFrame, path: str, tokenizer: str | None = None, shard_bytes: int = 64 << 20, lead: bool = False) -> None:
    """Encode whole texts and write table files under path, part numbers in id order.

    docs: doc_id and text; further columns are ignored.  A null or empty text
    is the end id alone; null ids come first; repeated rows are all kept, ties
    by text, and rows of one id may fill several files.  A text may be longer
    than a block, which then holds it alone.  An empty table writes no table.

    Texts are encoded where they are read; only ids are dealt to the files.
    """
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    keyed = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "text")
    ends = range_ends(keyed, shard_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(ends, [("id", np.int64), ("h", np.int64)]))  # 16 bytes a file, of a bounded sample
    width = 2 if vocabulary_size(tokenizer) <= 65_536 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer, lead), shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = np.array(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)), last.dtype)
                values = [value + END_ID for value in enc.batch([t or "" for t in part.column(3).to_pylist()])]
                if width == 2:
                    values = [np.frombuffer(v, "<u4").astype("<u2").tobytes() for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(last, rows).astype(np.int32)), part.column(0), part.column(2), pa.array(values, pa.binary())], names=["file", "doc_id", "h", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(width, TaskContext.get().partitionId())
        row = lambda part: pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, doc in enumerate(ids):
                for part in out.add(doc, batch.column(1)[k].as_py()):
                    yield row(part)
        if out.keys:
            for part in out.finish():
                yield row(part)

    encoded = keyed.mapInArrow(encode, "file int, doc_id bigint, h bigint, ids binary")
    ordered = encoded.repartitionById(len(ends) + 1, "file").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    parts = ordered.mapInArrow(write, "part binary").select(F.col("part").cast("string").alias("value"))
    parts.write.option("compression", "none").option("lineSep", MARK.decode()).text(path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, local_start, n_tokens, ids_crc32) of every document in the files, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0):
                block = part.as_py()
                if block[:1] != b"D":
                    continue
                file, start = place_of(block)
                rows = []
                for key, value in entries(block):
                    value = four_bytes(value, width)
                    rows.append((file, id_of(key), start, len(value) // 4, zlib.crc32(value)))
                    start += len(value) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = Folder(spark, path)
    width = files.table(0).width if files.files else 4
    return spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary")).mapInArrow(run, "file bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_before(rows: DataFrame, together: int = 4096) -> DataFrame:
    """(file, before): ids of all files before each.  Sums of ``together`` files come first, so that no task gets all files."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids")).withColumn("run", F.floor(F.col("file") / together))
    upto = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = totals.groupBy("run").agg(F.sum("ids").alias("ids")).select("run", upto(Window.orderBy("run")).alias("runs_before"))
    return totals.select("file", "run", upto(Window.partitionBy("run").orderBy("file")).alias("in_run")).join(runs, "run").select("file", (F.col("runs_before") + F.col("in_run")).alias("before"))


def token_tables(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, lead: bool = False) -> DataFrame:
    """Write the files, read them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Files under a given path stay; without one they are deleted when read.
    """
    spark = docs.sparkSession
    folder = path or scratch(spark, "token-tables")
    write_tables(docs, folder, tokenizer, lead=lead)
    rows = materialize(read_tables(spark, folder), "token-digest")
    if path is None:
        delete(spark, folder)
    return rows.join(materialize(ids_before(rows), "token-files"), "file").select("doc_id", (F.col("before") + F.col("local_start")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")
