"""SentencePiece-style unigram encoding: Viterbi over a double-array trie of scored pieces.

White space becomes the marker U+2581 and one marker is put in front of a text. No piece of a
usable vocabulary has the marker after another character, so the best path of a text is the best
paths of its chunks (markers plus what follows up to the next marker): chunks are cached per
Python worker, and new ones are segmented together, all start positions walking the trie at once.
A character without a piece of its own costs ten below the lowest score and is written as byte
pieces. Ties go to the path whose last piece starts first.

Public vocabularies of this kind come with merge ranks instead of log scores, and tokenizers are not
trained here, so ``log_scores`` maps the rank of a piece to the logarithm of its share by the law of Zipf
and Mandelbrot: share 1 / (rank + 2.7), over all pieces 1. Pass ``ranked=False`` for a vocabulary
whose scores are logarithms already.

Defined results: null or empty text has no pieces; a text that holds U+2581 itself decodes to a
space there (``exact`` is false); repeated rows give equal rows; other columns are not touched."""
from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
OFFSET = 2.7
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def load_pieces(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a serialized model."""
    out = []
    for field, value in _fields(data):
        if field == 1:
            d = dict(_fields(value))
            out.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
    return out


def log_scores(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Logarithm of the share of each normal piece by its rank (the highest score first, ties in order
    of ids); 0 for others."""
    normal = np.array([i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL], np.int64)
    out = np.zeros(len(pieces))
    if len(normal):
        order = normal[np.argsort([-pieces[i][1] for i in normal], kind="stable")]
        share = 1 / (np.arange(1, len(order) + 1) + OFFSET)
        out[order] = np.log(share / share.sum())
    return out


class DoubleArray:
    """Trie over byte strings: from state s byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = hint = 300  # below, some slots could never be filled
        stack = [(0, 0, len(order), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            while lo < hi and len(keys[order[lo]]) == depth:
                value[state] = order[lo]
                lo += 1
            children, at = [], lo
            while at < hi:
                c, to = keys[order[at]][depth], at
                while to < hi and keys[order[to]][depth] == c:
                    to += 1
                children.append((c, at, to))
                at = to
            if not children:
                continue
            while check[free] >= 0:
                free += 1
            first = b = max((free if len(children) == 1 else max(free, hint)) - children[0][0] - 1, 1)
            while True:
                if b + 300 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[b + c + 1] < 0 for c, _, _ in children):
                    break
                b += 1
            if b - first > 32:  # this stretch is nearly full
                hint = b
            base[state] = b
            for c, x, y in children:
                check[b + c + 1] = state
                stack.append((b + c + 1, x, y, depth + 1))
        used = max(i for i, x in enumerate(check) if x >= 0) + 300
        self.base, self.check, self.value = (np.array(x[:used], np.int32) for x in (base, check, value))


class Unigram:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]], max_chunks: int = 300_000, ranked: bool = True):
        self.pieces = pieces
        normal = [i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL]
        if any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError("a piece spans words")
        self.trie = DoubleArray([pieces[i][0].encode() for i in normal])
        self.ids = np.array(normal, np.int32)
        self.scores = log_scores(pieces) if ranked else np.array([s for _, s, _ in pieces], np.float64)
        self.unknown_score = min((self.scores[i] for i in normal), default=0.0) - 10.0
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = np.full(256, -1, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])
        spelled = []
        for p, _, kind in pieces:
            spelled.append(bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        self.spelled = spelled
        self.max_chunks, self.cache = max_chunks, {}

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk by its best path."""
        if not chunks:
            return []
        raw = [c.encode() for c in chunks]
        sizes = np.array([len(x) for x in raw])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        text = np.frombuffer(b"\xff".join(raw) + b"\xff" * 2, np.uint8)  # 0xff is never in UTF-8
        inner = np.ones(len(text), bool)
        inner[starts + sizes] = False
        inner[len(text) - 2 :] = False
        heads = np.flatnonzero(inner & ((text & 0xC0) != 0x80))
        lead = text[heads]
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        pos, at, state = heads, heads, np.zeros(len(heads), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(text) + 1, bool)
        while len(pos):
            to = base[state] + text[at] + 1
            ok = check[to] == state
            pos, at, state = pos[ok], at[ok] + 1, to[ok]
            v = value[state]
            hit = v >= 0
            if hit.any():
                found.append((pos[hit], at[hit], self.ids[v[hit]]))
        src = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        dst = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        pid = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int32)
        end_of = np.zeros(len(text) + 1, np.int64)
        end_of[heads] = heads + width
        single[src[dst == end_of[src]]] = True
        lone = heads[~single[heads]]
        src, dst = np.concatenate([src, lone]), np.concatenate([dst, end_of[lone]])
        pid = np.concatenate([pid, np.full(len(lone), -1, np.int32)])
        cost = np.where(pid >= 0, self.scores[pid], self.unknown_score)
        owner = np.repeat(np.arange(len(raw)), sizes + 1)
        rel = src - starts[owner[src]]
        order = np.lexsort((dst, rel))
        src, dst, pid, cost, rel = src[order], dst[order], pid[order], cost[order], rel[order]
        best = np.full(len(text) + 1, -np.inf)
        best[starts] = 0.0
        via, back = np.zeros(len(text) + 1, np.int32), np.zeros(len(text) + 1, np.int64)
        cuts = np.searchsorted(rel, np.unique(rel))
        for a, b in zip(cuts, [*cuts[1:], len(rel)]):
            s, d = src[a:b], dst[a:b]
            c = best[s] + cost[a:b]
            better = c > best[d]
            d = d[better]
            best[d], via[d], back[d] = c[better], pid[a:b][better], s[better]
        cur, who = starts + sizes, np.arange(len(raw))
        live = sizes > 0
        cur, who = cur[live], who[live]
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(cur):
            prior = back[cur]
            spans.append((prior, cur, via[cur]))
            on = prior > starts[who]
            cur, who = prior[on], who[on]
        if not spans:
            return [np.zeros(0, np.int32) for _ in raw]
        s, e, p = (np.concatenate([x[i] for x in spans]) for i in range(3))
        order = np.argsort(s)
        s, e, p = s[order], e[order], p[order]
        n = np.where(p >= 0, 1, e - s)
        flat = np.repeat(p, n)
        if (p < 0).any():
            gaps = np.flatnonzero(flat < 0)
            within = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            flat[gaps] = self.bytes[text[(np.repeat(s, n) + within)[gaps]]]
            flat[flat < 0] = self.unknown
        per = np.bincount(owner[s], weights=n, minlength=len(raw)).astype(np.int64)
        return np.split(flat, np.cumsum(per)[:-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each as little-endian u32."""
        chunks: list[list[str]] = []
        for t in texts:
            if not t:
                chunks.append([])
            elif "  " in t or MARK in t or t[0] == " ":
                chunks.append(_CHUNK.findall(MARK + t.replace(" ", MARK)))
            else:
                chunks.append([MARK + w for w in t.split(" ")])
        if len(self.cache) > self.max_chunks:
            self.cache = {}
        missing = list({c for cs in chunks for c in cs} - self.cache.keys())
        own: dict[str, bytes] = {}
        short = [c for c in missing if len(c) <= 64]
        for at in range(0, len(short), 20_000):
            self.cache.update(zip(short[at : at + 20_000], (x.astype("<u4").tobytes() for x in self.segment(short[at : at + 20_000]))))
        for c in missing:
            if len(c) > 64:
                own[c] = self.segment([c])[0].astype("<u4").tobytes()
        get = self.cache.__getitem__
        return [b"".join([own[c] if c in own else get(c) for c in cs]) if own else b"".join(map(get, cs)) for cs in chunks]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Text of ids: byte pieces join to characters, markers become spaces, the first goes."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        data = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_workers: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    if path not in _workers:
        with open(path, "rb") as f:
            _workers[path] = Unigram(load_pieces(f.read()))
    return _workers[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, pieces (ids, little-endian u32, binary), one row per document, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unigram(model)
        for b in common.slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(u.encode([x or "" for x in b.column("text").to_pylist()]), pa.binary())], ["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, pieces binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unigram(model)
        for b in common.slices(batches, "pieces"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([u.decode(x or b"") for x in b.column("pieces").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_pieces, n_byte_pieces, ids_crc32,
    decoded_sha256 and whether decoding gave the text back (null text counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unigram(model)
        for b in common.slices(batches, "text", 1 << 20):
            rows = []
            texts = [x or "" for x in b.column("text").to_pylist()]
            for key, t, ids in zip(b.column("doc_id").to_pylist(), texts, u.encode(texts)):
                a, back = np.frombuffer(ids, "<u4"), u.decode(ids)
                rows.append((key, len(a), int(u.is_byte[a].sum()), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == t))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "exact"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean")
