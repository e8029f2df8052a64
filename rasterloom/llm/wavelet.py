"""Token ids in wavelet-matrix shard files.

A shard holds the ids of consecutive documents (ascending ``doc_id``) in segments of ``SEGMENT`` ids,
each a wavelet matrix of its own: bit ``k`` of every id, from the highest, forms one plane; before each
further plane the ids are parted stably, zeros first. A plane is a zstd frame: the number of ones before
every ``BLOCK`` bits, then the bits. So rank is one count and the ones of part of a block, select a
binary search over counts and a look into one block, and access, counting and lookup of occurrences
read the header and a frame a plane of one file (``WaveletShard.open`` reads no more than these).

File: ``WVM2``, u32 header length, JSON header (counts, frame offsets and zeros by segment and
plane), then the compressed document table and the frames.

Defined results: null text is an empty document (end id only); a null ``doc_id`` sorts first;
repeated doc_ids stay separate documents, ordered by a hash of the text and their ids, and are spread
over ranges if they are many (equal rows stay together); an empty table gives no shard.
Columns other than ``doc_id`` and ``text`` are ignored."""
from __future__ import annotations

import bisect
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import word_tokenizer

MAGIC = b"WVM2"
SEGMENT, BLOCK = 1 << 16, 512
SHARD_TOKENS = 1 << 22
NULL_PLACE = -1e300  # where a null doc_id stands in the order


def _plane_bytes(ones: np.ndarray) -> bytes:
    """Ones before each block (u16), then the bits."""
    bits = np.packbits(ones)
    blocks = -(-len(ones) // BLOCK)
    words = np.zeros(blocks * BLOCK // 64, np.uint64)
    words.view(np.uint8)[: len(bits)] = bits
    per = np.bitwise_count(words).reshape(blocks, -1).sum(axis=1, dtype=np.int64)
    return (np.cumsum(per) - per).astype("<u2").tobytes() + bits.tobytes()


def build(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], bits: int) -> bytes:
    """The file of one shard: ``ids`` of documents of the given lengths."""
    press = zstandard.ZstdCompressor(level=1)
    docs = press.compress(np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + lengths.astype("<i8").tobytes())
    zeros, offsets, parts, at = [], [], [docs], len(docs)
    dtype = np.uint16 if bits <= 16 else np.uint32
    for a in range(0, len(ids), SEGMENT):
        seq = ids[a : a + SEGMENT].astype(dtype)
        z, o = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (seq & dtype(1 << bit)).astype(bool)
            parts.append(press.compress(_plane_bytes(ones)))
            o.append(at)
            at += len(parts[-1])
            low = np.flatnonzero(~ones)
            z.append(len(low))
            seq = seq.take(np.concatenate([low, np.flatnonzero(ones)]))
        zeros.append(z)
        offsets.append([*o, at])
    header = json.dumps({"n": len(ids), "docs": len(doc_ids), "doc_bytes": len(docs), "bits": bits, "segment": SEGMENT, "zeros": zeros, "offsets": offsets}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


class Plane:
    """One bit-plane of a segment of ``n`` ids with its counts."""

    def __init__(self, raw: bytes, n: int, zeros: int):
        blocks = -(-n // BLOCK)
        self.bits, self.n, self.zeros = raw[2 * blocks :], n, zeros
        self.before = [*np.frombuffer(raw, "<u2", blocks).tolist(), n - zeros]

    def __getitem__(self, i: int) -> int:
        return self.bits[i >> 3] >> (7 - (i & 7)) & 1

    def rank(self, i: int) -> int:
        """Ones at positions below ``i``."""
        if i == self.n:
            return self.n - self.zeros
        block = i // BLOCK
        a, z = block * BLOCK // 8, (i + 7) >> 3
        return self.before[block] + (int.from_bytes(self.bits[a:z], "big") >> 8 * z - i).bit_count()

    def down(self, one: int, i: int) -> int:
        """Where the next plane continues position ``i`` of this one."""
        ones = self.rank(i)
        return self.zeros + ones if one else i - ones

    def up(self, one: int, i: int) -> int:
        """The position that the next plane continues at ``i`` (select)."""
        if one:
            i -= self.zeros
            block = bisect.bisect_right(self.before, i, 0, len(self.before) - 1) - 1
            i -= self.before[block]
        else:
            block = bisect.bisect_right(range(len(self.before) - 1), i, key=lambda b: b * BLOCK - self.before[b]) - 1
            i -= block * BLOCK - self.before[block]
        a = block * BLOCK // 8
        bits = np.unpackbits(np.frombuffer(self.bits, np.uint8, min(BLOCK // 8, len(self.bits) - a), a))
        return block * BLOCK + int(np.flatnonzero(bits == one)[i])

    def unpack(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.bits, "u1"), count=self.n).view(bool)


class WaveletShard:
    """Random access into one shard file. Planes are read when they are first needed."""

    def __init__(self, data: bytes, read: Callable[[int, int], bytes] | None = None):
        """``data`` is the file, or its first eight bytes with ``read`` (from, to) for the rest."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        self._read = read or (lambda a, z: data[a:z])
        (n,) = struct.unpack_from("<I", data, 4)
        self.h, self.body = json.loads(self._read(8, 8 + n)), 8 + n
        self.n, self.bits, self.zeros, self.segment = self.h["n"], self.h["bits"], self.h["zeros"], self.h["segment"]
        self._planes: dict[tuple[int, int], Plane] = {}
        self._zstd = zstandard.ZstdDecompressor()
        raw = self._zstd.decompress(self._read(self.body, self.body + self.h["doc_bytes"]))
        d = self.h["docs"]
        ids, null = np.frombuffer(raw, "<i8", d), np.frombuffer(raw, "u1", d, 8 * d)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.lengths = np.frombuffer(raw, "<i8", d, 9 * d)

    @classmethod
    def open(cls, uri: str) -> WaveletShard:
        """A shard of which only header, document table and the planes in use are read."""
        system, path = common.open_fs(uri)
        file = system.open_input_file(path)
        return cls(file.read_at(8, 0), lambda a, z: file.read_at(z - a, a))

    def _size(self, seg: int) -> int:
        return min(self.segment, self.n - seg * self.segment)

    def _load(self, seg: int, level: int) -> Plane:
        a, z = self.h["offsets"][seg][level : level + 2]
        return Plane(self._zstd.decompress(self._read(self.body + a, self.body + z)), self._size(seg), self.zeros[seg][level])

    def _plane(self, seg: int, level: int) -> Plane:
        if (seg, level) not in self._planes:
            self._planes[seg, level] = self._load(seg, level)
        return self._planes[seg, level]

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        seg, i = divmod(i, self.segment)
        value = 0
        for level in range(self.bits):
            plane = self._plane(seg, level)
            one = plane[i]
            value, i = value << 1 | one, plane.down(one, i)
        return value

    def _range(self, token: int, seg: int, lo: int, hi: int) -> tuple[int, int]:
        """The stretch behind the last plane that holds a token of positions lo to hi - 1."""
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for level in range(self.bits):
            plane, one = self._plane(seg, level), token >> (self.bits - 1 - level) & 1
            lo, hi = plane.down(one, lo), plane.down(one, hi)
            if lo == hi:
                break
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token at positions lo to hi - 1."""
        total, hi = 0, self.n if hi is None else hi
        for seg in range(lo // self.segment, -(-hi // self.segment)):
            at = seg * self.segment
            a, b = self._range(token, seg, max(lo - at, 0), min(hi - at, self._size(seg)))
            total += b - a
        return total

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, j: int) -> int:
        """Position of the ``j``-th occurrence, from 0."""
        if j < 0:
            raise IndexError(j)
        for seg in range(len(self.zeros)):
            lo, hi = self._range(token, seg, 0, self._size(seg))
            if j >= hi - lo:
                j -= hi - lo
                continue
            i = lo + j
            for level in range(self.bits - 1, -1, -1):
                i = self._plane(seg, level).up(token >> (self.bits - 1 - level) & 1, i)
            return seg * self.segment + i
        raise IndexError(j)

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, ascending; those of a segment go up the planes together."""
        out = [np.zeros(0, np.int64)]
        for seg in range(len(self.zeros)):
            lo, hi = self._range(token, seg, 0, self._size(seg))
            if lo == hi:
                continue
            at = np.arange(lo, hi)
            for level in range(self.bits - 1, -1, -1):
                plane, one = self._plane(seg, level), token >> (self.bits - 1 - level) & 1
                at = np.flatnonzero(plane.unpack() == one)[at - plane.zeros if one else at]
            out.append(at + seg * self.segment)
        return np.concatenate(out)

    def decode(self) -> np.ndarray:
        """All ids in order: undo the partings from the last plane to the first."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        out = np.empty(self.n, dtype)
        for seg in range(len(self.zeros)):
            seq = np.zeros(self._size(seg), dtype)
            for level in range(self.bits - 1, -1, -1):
                ones, z = self._load(seg, level).unpack(), self.zeros[seg][level]
                prior = np.empty_like(seq)
                prior[np.flatnonzero(~ones)] = seq[:z]
                prior[np.flatnonzero(ones)] = seq[z:] | dtype(1 << (self.bits - 1 - level))
                seq = prior
            out[seg * self.segment : seg * self.segment + len(seq)] = seq
        return out


def encode(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write shard files in ascending doc_id order.

    Returns the manifest (part, seq, path, n_docs, n_tokens, n_bytes, start), one row a file.
    Documents move once, as packed ids, to the range of doc_id that they belong to; the ranges are
    quantiles of doc_id. Rows of one doc_id that fill several ranges (or null ones, which sort first) go
    to these by a hash of the text. A task writes as many files as its range needs, each bounded by
    ``shard_tokens`` and one document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = docs.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(NULL_PLACE)).alias("d"))
    bounds = np.array(sorted(place.approxQuantile("d", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []), "f8")
    t = word_tokenizer(tokenizer)
    dtype, bits = t.dtype, max(1, int(t.size - 1).bit_length())
    folder = common.new_path(spark, "wavelet")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(tokenizer)
        end = np.array([end_id], t.dtype).tobytes()
        for b in common.slices(batches, "text"):
            keys, texts = b.column("doc_id"), [x or "" for x in b.column("text").to_pylist()]
            d = keys.cast(pa.float64(), safe=False).fill_null(NULL_PLACE).to_numpy(zero_copy_only=False)
            part, last = (np.searchsorted(bounds, d, side=s) for s in ("left", "right"))
            mix = np.zeros(len(texts), np.int64)
            for k in np.flatnonzero(last > part):  # this doc_id stands at a bound, or fills a range
                mix[k] = xxhash.xxh64_intdigest(texts[k].encode()) >> 32
            part += mix * (last - part + 1) >> 32
            out = [x + end for x in t.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), keys, pa.array(mix), pa.array(out, pa.binary())], ["part", "doc_id", "mix", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        size, seq, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // dtype.itemsize for _, x in held], np.int64)
            data = build(np.frombuffer(b"".join(x for _, x in held), dtype), lengths, [k for k, _ in held], bits)
            path = f"{folder}/shard-{part:06d}-{seq:05d}.wvm"
            common.write_file(path, data)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(held), "n_tokens": int(lengths.sum()), "n_bytes": len(data)}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
        for b in batches:
            for p, key, ids in zip(*(c.to_pylist() for c in b.columns)):
                part = p
                held.append((key, ids))
                size += len(ids) // dtype.itemsize
                if size >= shard_tokens:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    made = docs.mapInArrow(tokenize, "part int, doc_id long, mix long, ids binary")
    made = made.repartitionById(n, F.col("part")).sortWithinPartitions("doc_id", "mix", "ids").select("part", "doc_id", "ids")
    manifest = common.materialize(made.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"), "wavelet-manifest")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # One row a part in one task, then the files of each part.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("from"))
    return manifest.withColumn("within", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select(*manifest.columns, (F.col("from") + F.col("within")).alias("start"))


def read_documents(manifest: DataFrame, with_ids: bool = True, end_id: int = 2) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32, n_end_ids (occurrences of
    ``end_id``, looked up in the planes) and, if asked for, ids (little-endian u32)."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                shard = WaveletShard(common.read_file(path))
                ids = shard.decode().astype("<u4")
                found = shard.occurrences(end_id)
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                met = np.searchsorted(found, ends) - np.searchsorted(found, begins)
                for at in range(0, len(ends), 2000):
                    s = slice(at, at + 2000)
                    pieces = [ids[a:z].tobytes() for a, z in zip(begins[s], ends[s])]
                    columns = {"doc_id": pa.array(shard.doc_ids[s], pa.int64()), "start": pa.array(begins[s] + start, pa.int64()), "n_tokens": pa.array(shard.lengths[s], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()), "n_end_ids": pa.array(met[s], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(pieces, pa.binary())} if with_ids else {}))

    return manifest.select("path", "start").repartition(min(files, 10_000)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long" + ", ids binary" * with_ids)
