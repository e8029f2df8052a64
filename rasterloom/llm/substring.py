"""Repeated passages: remove every word of a 20-word window that also starts earlier.

1. *Anchors.* The least hash of the 8-word runs in a window is the same in every equal window. Anchors
   are counted over the corpus; only windows whose anchor occurs twice can repeat.
2. *Windows.* The hashes of those windows are sorted; the first of each group becomes reference, later
   ones become candidates that point at it.
3. *Automata.* Reference passages form shards (a stretch of a document). For each shard a suffix
   automaton over words is built; the candidates that point at the shard stream through it, and their
   matching statistics tell on the words themselves which windows occur there earlier. Hashes
   only choose what is compared, so a collision removes nothing.
4. *Spans.* Maximal removed spans go back to their documents.

The automata are not broadcast: together they grow with the corpus. Candidates travel to their shard,
whose automaton is bounded by ``CHUNK`` windows. Equal anchors or windows met by one task collapse
there (the rest point at the task's first one), so a passage that a third of all documents share sends
one row a task, not one a document.

Defined results: null or empty text has no words; documents with a null doc_id are returned whole and
are no reference; rows that share a doc_id are versions of one document (equal starts are not earlier);
an empty table gives no rows; texts of any length are treated whole."""
from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, ANCHOR = 20, 8
CHUNK = 4096  # windows of a reference shard
FLUSH = 1 << 20  # rows that a task collapses at a time
_MUL = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n values."""
    with np.errstate(over="ignore"):
        return _mix(_rolled(h, n))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial of every run of n values, by doubling."""
    out, have, power, base, size, scale = None, 0, _MUL, h, 1, _MUL
    while True:
        if n & size:
            if out is None:
                out, have, power = base, size, scale
            else:
                m = len(h) - have - size + 1
                out, have, power = out[:m] * scale + base[have : have + m], have + size, power * scale
        size *= 2
        if size > n:
            return out
        m = len(base) - size // 2
        base, scale = base[:m] * scale + base[size // 2 : size // 2 + m], scale * scale


def _slide(h: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over every n values."""
    size, out = 1, h
    while 2 * size <= n:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(h) - n + 1], out[n - size : n - size + len(h) - n + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def window_anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor value of every window, and the anchor values of positions that serve one."""
    grams = _runs(h, anchor)
    w = window - anchor + 1
    least = _slide(grams, w, np.minimum)
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return least, grams[_slide(wide, w, np.maximum) == grams]


class SuffixAutomaton:
    """Suffix automaton over hashable symbols; ``first`` is the least end position of a state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first, self.last, self.size = [-1], [0], [-1], 0, 0

    def extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        self.first.append(self.size)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                self.first.append(self.first[q])
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        self.size += 1

    def matches(self, symbols: list, window: int) -> Iterator[tuple[int, int]]:
        """(i, e): the ``window`` symbols that end at i occur, first with end e."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v = n = 0
        for i, c in enumerate(symbols):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
                while length[link[v]] >= window:
                    v = link[v]
                    n = length[v]
                if n >= window:
                    yield i, first[v]
            else:
                n = 0


def _repeated_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, value): anchors of a document that occur at least twice in the corpus."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            value = np.concatenate([v for v, _ in held])
            doc = np.repeat(np.array([d for _, d in held], np.int64), [len(v) for v, _ in held])
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            new = np.concatenate([[True], value[1:] != value[:-1]])
            many = np.diff(np.append(np.flatnonzero(new), len(value)))[np.cumsum(new) - 1] > 1
            own = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
            # kind 0: met once here; 1: met more often here (no document); 2: known to repeat
            for kind, pick in ((0, ~many), (1, many & new), (2, many & own)):
                v, d = value[pick].view(np.int64), doc[pick]
                route = v if kind < 2 else _mix(d.view(np.uint64)).view(np.int64)
                for a in range(0, len(v), 100_000):
                    s = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(route[s]), pa.array(v[s]), pa.array(d[s]), pa.array(np.full(len(v[s]), kind, np.int8))], ["route", "value", "doc_id", "kind"])

        for b in common.slices(batches, "text"):
            for key, text in zip(b.column("doc_id").to_pylist(), common.texts_of(b)):
                words = text.split()
                if len(words) >= window:
                    held.append((window_anchors(word_hashes(words), window, anchor)[1], key))
                    size += len(held[-1][0])
                    if size >= FLUSH:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("value", pa.int64())])
        keep: tuple | None = None  # the last row, not yet known to repeat or to be alone

        for b in batches:
            route, value, doc, kind = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if keep is not None:
                route, value, doc, kind = (np.concatenate([[k], x]) for k, x in zip(keep[:4], (route, value, doc, kind)))
            tail = keep[4] if keep is not None else False
            probe = kind < 2
            same = np.zeros(len(value), bool)
            same[1:] = (value[1:] == value[:-1]) & probe[1:] & probe[:-1]
            hit = same.copy()
            hit[:-1] |= same[1:]
            hit[0] |= tail
            hit |= kind == 2
            hit &= kind != 1
            last = len(value) - 1
            known = bool(same[last] or (last == 0 and tail))
            # The last row stays: what follows may equal it. If it is known already, it is told later.
            hit[last] = False
            keep = (route[last], value[last], doc[last], kind[last], known)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(value[hit])], schema=schema)
        if keep is not None and keep[3] != 1 and (keep[4] or keep[3] == 2):
            yield pa.RecordBatch.from_arrays([pa.array([int(keep[2])], pa.int64()), pa.array([int(keep[1])], pa.int64())], schema=schema)

    sent = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(emit, "route long, value long, doc_id long, kind byte")
    return sent.repartition(n, "route").sortWithinPartitions("route", "value", F.col("kind") == 2).mapInArrow(meet, "doc_id long, value long")


def _window_roles(docs: DataFrame, anchors: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, start, rdoc, rstart): windows that repeat; rdoc null marks a reference."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_doc = anchors.groupBy("doc_id").agg(F.collect_set("value").alias("values"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x for x, _, _ in held])
            start = np.concatenate([s for _, s, _ in held])
            doc = np.repeat(np.array([d for _, _, d in held], np.int64), [len(x) for x, _, _ in held])
            order = np.lexsort((start, doc, h))
            h, start, doc = h[order].view(np.int64), start[order], doc[order]
            own = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
            h, start, doc = h[own], start[own], doc[own]  # a repeated row says nothing new
            new = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            many = np.diff(np.append(at, len(h)))[group] > 1
            head = at[group]
            # kind 0: once here; 1: first of several here; 2: a later one, which points at that first
            kind = np.where(~many, 0, np.where(new, 1, 2)).astype(np.int8)
            route = np.where(kind == 2, _mix(doc.view(np.uint64)).view(np.int64), h)
            for a in range(0, len(h), 100_000):
                s = slice(a, a + 100_000)
                late = kind[s] < 2
                yield pa.RecordBatch.from_arrays([pa.array(route[s]), pa.array(h[s]), pa.array(doc[s]), pa.array(start[s]), pa.array(kind[s]), pa.array(doc[head[s]], mask=late), pa.array(start[head[s]], mask=late)], ["route", "h", "doc_id", "start", "kind", "rdoc", "rstart"])

        for b in common.slices(batches, "text"):
            values = b.column("values")
            for key, text, known in zip(b.column("doc_id").to_pylist(), common.texts_of(b), (v.values.to_numpy() for v in values)):
                words = text.split()
                if len(words) < window:
                    continue
                h = word_hashes(words)
                least, _ = window_anchors(h, window, anchor)
                start = np.flatnonzero(np.isin(least.view(np.int64), known))
                if len(start):
                    held.append((_runs(h, window)[start], start.astype(np.int32), key))
                    size += len(start)
                    if size >= FLUSH:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of h, doc_id, start. The first of a group is held until a second tells
        that it is a reference."""
        head: tuple | None = None  # h, doc, start, told
        for b in batches:
            h, doc, start, kind = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            out_doc, out_start, out_rd, out_rs = [], [], [], []
            known = kind == 2
            if known.any():
                sub = b.filter(pa.array(known))
                yield pa.RecordBatch.from_arrays([sub.column(k) for k in (2, 3, 5, 6)], names)
            h, doc, start, kind = (x[~known] for x in (h, doc, start, kind))
            if not len(h):
                continue
            if head is not None:
                h, doc, start, kind = np.concatenate([[head[0]], h]), np.concatenate([[head[1]], doc]), np.concatenate([[head[2]], start]), np.concatenate([[head[4]], kind])
            new = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            size = np.diff(np.append(at, len(h)))
            told = np.zeros(len(h), bool)
            if head is not None:
                told[0] = head[3]
            reference = (new & (size[group] > 1) | (kind == 1)) & ~told
            later = ~new
            if later.any():
                r = at[group[later]]
                later_ok = (doc[later] != doc[r]) | (start[later] != start[r])
                pick = np.flatnonzero(later)[later_ok]
                out_doc, out_start = doc[pick], start[pick]
                out_rd, out_rs = doc[r[later_ok]], start[r[later_ok]]
                yield pa.RecordBatch.from_arrays([pa.array(out_doc, pa.int64()), pa.array(out_start, pa.int32()), pa.array(out_rd, pa.int64()), pa.array(out_rs, pa.int32())], names)
            if reference.any():
                nulls = int(reference.sum())
                yield pa.RecordBatch.from_arrays([pa.array(doc[reference], pa.int64()), pa.array(start[reference], pa.int32()), pa.nulls(nulls, pa.int64()), pa.nulls(nulls, pa.int32())], names)
            a = at[-1]
            head = (h[a], doc[a], start[a], bool(told[a] or reference[a]), 0)

    names = ["doc_id", "start", "rdoc", "rstart"]
    near = docs.where("doc_id is not null").select("doc_id", "text").join(per_doc, "doc_id")
    sent = near.mapInArrow(emit, "route long, h long, doc_id long, start int, kind byte, rdoc long, rstart int")
    return sent.repartition(n, "route").sortWithinPartitions("h", "doc_id", "start").mapInArrow(meet, "doc_id long, start int, rdoc long, rstart int")


def _stretches(*breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the stretches that are not parted by a break before a row."""
    at = np.flatnonzero(np.logical_or.reduce(breaks))
    return zip([0, *(at + 1).tolist()], [*at.tolist(), len(breaks[0])])


def _pieces(words: list[bytes], start: np.ndarray, rdoc: np.ndarray, rstart: np.ndarray, reference: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(kind, shard doc, shard chunk, start, words) of a document: runs of reference windows (kind 0,
    shard doc 0) and of candidates (kind 1), each within one shard."""
    inside = start <= len(words) - window
    refs = np.unique(start[reference & inside])
    if len(refs):
        for a, z in _stretches(np.diff(refs) != 1, np.diff(refs // CHUNK) != 0):
            yield 0, 0, int(refs[a]) // CHUNK, int(refs[a]), b" ".join(words[refs[a] : refs[z] + window])
    pick = ~reference & inside
    if pick.any():
        s, d, r = start[pick], rdoc[pick], rstart[pick]
        order = np.lexsort((s, r - s, d))
        s, d, r = s[order], d[order], r[order]
        for a, z in _stretches(np.diff(d) != 0, np.diff(r - s) != 0, np.diff(s) > 1, np.diff(r // CHUNK) != 0):
            yield 1, int(d[a]), int(r[a]) // CHUNK, int(s[a]), b" ".join(words[s[a] : s[z] + window])


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, spans): sorted, disjoint, maximal [from, to) word ranges to remove."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchors = common.materialize(_repeated_anchors(docs, window, anchor), "anchors")
    roles = common.materialize(_window_roles(docs, anchors, window, anchor), "windows")
    common.discard(anchors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            rows = []
            roles = b.column("roles")
            ends, flat = roles.offsets.to_numpy().tolist(), roles.values
            start, rdoc, rstart = (flat.field(k) for k in range(3))
            reference = rdoc.is_null().to_numpy(zero_copy_only=False)
            start, rdoc, rstart = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (start, rdoc, rstart))
            for k, (key, mark, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), common.texts_of(b))):
                own = slice(ends[k], ends[k + 1])
                for kind, shard_doc, chunk, at, piece in _pieces(text.split(), start[own], rdoc[own], rstart[own], reference[own], window):
                    rows.append((shard_doc if kind else key, chunk, kind, key, at, mark, piece))
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 20_000]), (pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["shard", "chunk", "kind", "doc_id", "start", "text_hash", "words"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, begins, origin = None, None, [], []
        for b in batches:
            rows = []
            for sdoc, chunk, kind, doc, start, mark, piece in zip(*(c.to_pylist() for c in b.columns)):
                if shard != (sdoc, chunk):
                    shard, automaton, begins, origin = (sdoc, chunk), SuffixAutomaton(), [], []
                words = piece.split(b" ")
                if kind == 0:
                    if begins:
                        automaton.extend(-len(begins))  # no word: matches end here
                    begins.append(automaton.size)
                    origin.append((doc, start))
                    for w in words:
                        automaton.extend(w)
                    continue
                lo = hi = -1
                for i, end in automaton.matches(words, window):
                    k = bisect.bisect_right(begins, end) - 1
                    at = (origin[k][0], origin[k][1] + end - window + 1 - begins[k])
                    own = start + i - window + 1
                    if at < (doc, own):
                        if own > hi:
                            if hi >= 0:
                                rows.append((doc, mark, lo, hi))
                            lo = own
                        hi = own + window
                if hi >= 0:
                    rows.append((doc, mark, lo, hi))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "text_hash", "a", "z"])

    per_doc = roles.groupBy("doc_id").agg(F.collect_list(F.struct("start", "rdoc", "rstart")).alias("roles"))
    pieces = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(per_doc, "doc_id").mapInArrow(cut, "shard long, chunk int, kind byte, doc_id long, start int, text_hash long, words binary")
    dealt = pieces.repartition(n, "shard", "chunk").sortWithinPartitions("shard", "chunk", "kind", "doc_id", "start")
    found = dealt.mapInArrow(match, "doc_id long, text_hash long, a int, z int").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("spans"))
    found = common.materialize(found, "spans")
    common.discard(roles)
    return found


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["z"]))
        else:
            out.append((s["a"], s["z"]))
    return out


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("spans").alias("_spans"))
    return docs.join(spans, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left").drop("_d", "_h")


def digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            rows = []
            for key, text, spans in zip(b.column("doc_id").to_pylist(), common.texts_of(b), b.column("_spans").to_pylist()):
                words = text.split()
                kept, at = [], 0
                for a, z in _merge(spans):
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                rows.append((key, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs, repeated_spans(docs, window, anchor)).select("doc_id", "text", "_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and the white space before each of them."""
    if not spans:
        return text
    out, at, word, place = [], 0, 0, 0
    words = text.split()
    for a, z in spans:
        while word < a:
            place = text.index(words[word], place) + len(words[word])
            word += 1
        out.append(text[at:place])
        while word < z:
            place = text.index(words[word], place) + len(words[word])
            word += 1
        at = place
    out.append(text[at:])
    return b"".join(out)


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with its own columns, ``text`` without the repeated spans and ``n_chars`` to match."""
    columns = docs.columns
    rest = [c for c in columns if c not in ("text", "n_chars")]
    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")), repeated_spans(docs, window, anchor)).select("text", "_rest", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            texts = [t if t is None else cut_words(t, _merge(s)).decode() for t, s in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_rest"), pa.array(texts, pa.string())], ["_rest", "text"])

    out = joined.mapInArrow(run, T.StructType([joined.schema["_rest"], T.StructField("text", T.StringType())]))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col(f"_rest.`{c}`").alias(c) for c in columns))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM d),
word AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS x FROM w WHERE len(ws) > 0),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
