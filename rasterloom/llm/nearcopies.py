"""Near copies by SimHash: documents with a Jaccard similarity of at least 0.8 of their five-word
shingles are linked, and of each connected group one document stays.

At similarity 0.8 the cosine of the shingle sets is 8/9, so some 15 % of the bits of two fingerprints
differ, 9.7 of 64: too many for op5's ball. So the fingerprint is long, ``WORDS`` words of 32 bits, and a
ball is hashed in each word, as in :mod:`simhash`: a word is shuffled under its upper byte, the receiving
task unfolds the variants of the other ``OPEN`` bits within one flip, half the radius, and words that
share a variant are within two bits. Of those that meet, the 64 bits of the next two words must be within
``NEAR``. At 0.8 a word finds a pair with probability 0.074, so 128 words miss it with 5e-5; sets of up
to ``SHORT`` shingles, of which more bits differ, are sent under the flips of the byte too. Who meets is
only a candidate; the shingle sets decide.

Pairs are not listed. A block is all that is linked by meetings in one word, and each of its members is
compared with ``ANCHORS`` members, which are picked alike in all blocks, so most of a large group falls into
one component at a number of comparisons that is linear in it. What is left are blocks whose other members
lie in several components. Such blocks are joined to groups, so that two members meet once and not once
a word: the members outside a group's largest component meet all others, in cells of ``CELL`` by ``CELL``
shingle sets whose sizes of intersection are a matrix product. No candidate pair across components stays
undecided.

Defined results: documents with equal shingle sets are copies, also those without words (null text);
texts under five words have one shingle; words are split at ASCII white space, ASCII letters folded."""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SHINGLE = 5
WORDS, OPEN = 128, 24
#: Bits of the next two words that may differ; members of a variant up to which pairs are held to that.
NEAR, LISTED = 16, 16
SHORT = 5
#: Rows that a task unfolds at a time.
LOCAL = 1 << 17
ANCHORS, CELL = 3, 256
#: Shingles that a cell multiplies at a time.
COLUMNS = 2048
BITS = 24
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, WORDS, np.uint64) << np.uint64(1) | np.uint64(1)
_FLIPS = np.concatenate([np.zeros(1, np.int64), np.int64(1) << np.arange(OPEN)])
_PICK = _RNG.integers(-(1 << 63), (1 << 63) - 1, ANCHORS, np.int64)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 (seed 42) of the shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    begin = [0, *ends[: n - width].tolist()]
    stop = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(begin, stop)], np.uint64))


def signature(own: np.ndarray) -> int:
    """A signed long that names a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """``WORDS`` words: a bit is set if it is set in over half of the hashes that a word has of the shingles."""
    ones = np.zeros(WORDS * 32, np.int64)
    for a in range(0, len(own), 128):
        h = (own[a : a + 128, None] * _MUL >> np.uint64(32)).astype("<u4")
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view("<u4")


def keys_of(own: np.ndarray) -> np.ndarray:
    """The words of the fingerprint, each below its number; none for an empty set."""
    return np.arange(WORDS if len(own) else 0) << 32 | (fingerprint(own) if len(own) else own.astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(r.view(np.int64) for r in rows)])))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, sig, n (shingles) of every row; keys, which a task names once per sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in common.slices(batches, "text"):
            sig, n, keys = [], [], []
            for t in common.texts_of(b):
                own = shingles(t)
                sig.append(signature(own))
                n.append(len(own))
                keys.append(own[:0] if sig[-1] in seen else keys_of(own))
                seen.add(sig[-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.int64()), pa.array(n, pa.int32()), _lists(keys)], ["doc_id", "sig", "n", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, sig long, n int, keys array<long>")


class Ids:
    """A bit for each doc_id of a table modulo 2^BITS: bounded whatever the rows, never misses one."""

    def __init__(self, ids: DataFrame):
        at = F.pmod(F.col("doc_id"), F.lit(1 << BITS))
        words = ids.where("doc_id is not null").groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(doc_id, {1 << BITS}) & 63 as int))")).alias("b")).collect()
        self.bits = np.zeros(1 << BITS - 6, np.int64)
        for w, b in words:
            self.bits[w] = b

    def may_hold(self, doc_id: int | None) -> bool:
        return doc_id is None or bool(int(self.bits[doc_id % (1 << BITS) >> 6]) >> (doc_id & 63) & 1)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """sig and grams (the shingle set), one row per sig, of the documents in ``ids`` at least."""
    held = docs.sparkSession.sparkContext.broadcast(Ids(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in common.slices(batches, "text"):
            sigs, sets = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), common.texts_of(b)):
                if held.value.may_hold(d):
                    own = shingles(t)
                    if (s := signature(own)) not in seen:
                        seen.add(s)
                        sigs.append(s)
                        sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), _lists(sets)], ["sig", "grams"])

    return _texts(docs).mapInArrow(run, "sig long, grams array<long>").dropDuplicates(["sig"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of which the shingle sets have a Jaccard similarity of at least 0.8."""
    of = lambda k: sets.select(F.col("sig").alias(k), F.col("grams").alias(f"g{k}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    shared, total = F.size(F.array_intersect("gu", "gv")), F.size("gu") + F.size("gv")
    return both.where(9 * shared >= 4 * total).select("u", "v")


def shared_shingles(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``rows`` with all ``columns`` (arrays of different values)."""
    r, c = np.concatenate(rows), np.concatenate(columns)
    both = np.intersect1d(r, c)
    out = np.zeros((len(rows), len(columns)), np.float32)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        own, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return own[order], at[order]

    if len(both):
        (ro, ra), (co, ca) = places(r, rows), places(c, columns)
        for a in range(0, len(both), COLUMNS):
            left, right = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(columns), COLUMNS), np.float32)
            for m, o, k in ((left, ro, ra), (right, co, ca)):
                s = slice(*np.searchsorted(k, [a, a + COLUMNS]))
                m[o[s], k[s] - a] = 1
            out += left @ right.T
    return out.astype(np.int64)


def _decide(cells: DataFrame) -> DataFrame:
    """From (key, i, j, inner, c, grams), sorted by cell, links (u, v) of components: in each cell those of
    rows that are not ``inner`` with all ``inner`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def links() -> pa.RecordBatch:
            (rows, cr), (columns, cc) = (([g for g, _ in h], np.array([c for _, c in h], np.int64)) for h in held)
            found = np.zeros((0, 2), np.int64)
            if rows and columns:
                sizes = [np.array([len(g) for g in x]) for x in (rows, columns)]
                ok = (9 * shared_shingles(rows, columns) >= 4 * (sizes[0][:, None] + sizes[1])) & (cr[:, None] != cc)
                a, b = np.nonzero(ok)
                found = np.unique(np.stack([cr[a], cc[b]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for b in batches:
            grams = b.column("grams")
            values, ends = grams.values.to_numpy(), grams.offsets.to_numpy().tolist()
            for k, (cell, inner, c) in enumerate(zip(zip(*(b.column(x).to_pylist() for x in ("key", "i", "j"))), b.column("inner").to_pylist(), b.column("c").to_pylist())):
                if cell != now:
                    if now is not None:
                        yield links()
                    now, held = cell, ([], [])
                held[inner].append((values[ends[k] : ends[k + 1]].copy(), c))
        if now is not None:
            yield links()

    return cells.select("key", "i", "j", "inner", "c", "grams").mapInArrow(run, "u long, v long")


def _rest(blocks: DataFrame, comp: DataFrame | None, sets: DataFrame) -> DataFrame:
    """Links between components that share a block, by cells. Blocks that share a component are one group
    here, so two members meet once, in however many words they did."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = blocks.select("sig", F.col("anchors")[0].alias("a")).distinct()
    if comp is None:
        held = held.select("sig", "a", F.col("sig").alias("c"), F.col("a").alias("d"))
    else:
        of = lambda k, c: comp.select(F.col("node").alias(k), F.col("component").alias(c))
        held = held.join(of("sig", "c"), "sig", "left").join(of("a", "d"), "a", "left")
        held = held.select("sig", "a", F.coalesce("c", "sig").alias("c"), F.coalesce("d", "a").alias("d"))
    held = common.materialize(held, "block-members")
    touch = common.materialize(held.where("c <> d").select(F.col("c").alias("u"), F.col("d").alias("v")).distinct(), "open-components")
    n = touch.count()
    if not n:
        return touch
    group = common.materialize(components(touch).select(F.col("node").alias("c"), F.col("component").alias("key")), "open-groups", 2 * n)
    others = common.materialize(held.select("sig", "c").distinct().join(group, "c"), "open-members")
    common.discard(held, touch, group)
    sizes = others.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("top"))
    sizes = sizes.select("key", F.col("top.c").alias("largest"), F.ceil(F.col("m") / CELL).cast("int").alias("js"), F.ceil((F.col("m") - F.col("top.k")) / CELL).cast("int").alias("is"))
    open_ = others.join(common.materialize(sizes, "open-blocks"), "key")
    h = F.xxhash64("sig")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = open_.where("c <> largest").select("key", F.pmod(h, "is").cast("int").alias("i"), all_of("js").alias("j"), F.lit(False).alias("inner"), "sig", "c")
    columns = open_.select("key", all_of("is").alias("i"), F.pmod(h, "js").cast("int").alias("j"), F.lit(True).alias("inner"), "sig", "c")
    cells = rows.unionByName(columns).join(sets, "sig").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return common.materialize(_decide(cells).distinct(), "late-links")


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, near (the next two words) and sig for every word."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            sig, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "n"))
            key = part.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(sig), -1)
            word = key & 0xFFFFFFFF
            near = np.roll(word, -1, axis=1) | np.roll(word, -2, axis=1) << 32
            sig = np.broadcast_to(sig[:, None], key.shape)
            out, short = [(key, near, sig)], n <= SHORT
            if short.any():
                out += [(key[short] ^ (1 << k), near[short], sig[short]) for k in range(OPEN, 32)]
            columns = (np.concatenate([np.ravel(x[c]) for x in out]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "near", "sig"])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of all (a, b) in ``root``, which names the least member of each."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root[:] = up


def balls(key: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of words under whole bytes, sorted, the least place of those that each is linked with: they share a
    variant within one flip, and the next words are near or the variant has over ``LISTED`` words."""
    n = len(key)
    route = key >> OPEN
    group = np.cumsum(np.concatenate([[False], route[1:] != route[:-1]])) << OPEN | (key & (1 << OPEN) - 1)
    shift = n.bit_length()
    parts = -(-n // LOCAL)
    root = np.arange(n)
    for p in range(parts):
        found = []
        for a in range(0, n, LOCAL):
            v = (group[a : a + LOCAL, None] ^ _FLIPS).ravel()
            row = np.repeat(np.arange(a, min(a + LOCAL, n)), len(_FLIPS))
            if parts > 1:
                mine = (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == p
                v, row = v[mine], row[mine]
            found.append(v << shift | row)
        met = np.sort(np.concatenate(found))
        v = met >> shift
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])[: len(v)])
        size = np.diff(np.append(first, len(v)))
        first, size = first[size > 1], size[size > 1]
        row = lambda at: met[at] & (1 << shift) - 1
        many = size > LISTED
        f, s = first[~many], size[~many]
        for gap in range(1, LISTED):
            f, s = f[s > gap], s[s > gap]
            at = np.repeat(f, s - gap) + _within(s - gap)
            x, y = row(at), row(at + gap)
            ok = np.bitwise_count((near[x] ^ near[y]).view(np.uint64)) <= NEAR
            _unite(root, x[ok], y[ok])
        f, s = first[many], size[many]
        _unite(root, row(np.repeat(f, s)), row(np.repeat(f, s) + _within(s)))
    return root


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, near, sig), sorted by key and with all of a byte's words, the blocks."""

    def join(key: np.ndarray, near: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((sig, key))
        key, near, sig = key[order], near[order], sig[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
        key, near, sig = key[new], near[new], sig[new]
        root = balls(key, near)
        row = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        row = row[np.argsort(root[row], kind="stable")]
        own, sig = root[row], sig[row]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
        size = np.diff(np.append(first, len(own)))
        anchors = np.zeros((len(own), ANCHORS), np.int64)
        name = own
        if len(own):
            for k, c in enumerate(_PICK):
                anchors[:, k] = np.repeat(np.minimum.reduceat(sig ^ c, first) ^ c, size)
            # A word and a member name a block.
            name = (key[own] >> OPEN).view(np.uint64) * _MUL[0] ^ anchors[:, 0].view(np.uint64) * _MUL[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * ANCHORS), pa.array(anchors.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(sig), lists], ["key", "sig", "anchors"])

    def cut(rows: np.ndarray, end: bool) -> Iterator[int]:
        """Ends of pieces of whole bytes, each of at most LOCAL rows or one byte; unless at the ``end``, the
        last byte may go on."""
        route = rows[0] >> OPEN
        ends = [*(np.flatnonzero(route[1:] != route[:-1]) + 1).tolist(), *([len(route)] if end else [])]
        at = 0
        for k, x in enumerate(ends):
            if k + 1 == len(ends) or ends[k + 1] - at > LOCAL:
                yield x
                at = x

    held: list[np.ndarray] = []
    size, limit = 0, LOCAL
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            size += b.num_rows
        if size and (b is None or size >= limit):
            rows, at = np.concatenate(held, axis=1), 0
            for x in cut(rows, b is None):
                yield join(*rows[:, at:x])
                at = x
            held, size = [rows[:, at:]], size - at
            limit = max(LOCAL, 2 * size)


def meetings(rows: DataFrame) -> DataFrame:
    """key, sig, anchors: blocks of sigs whose fingerprints meet in a word."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.where(F.size("keys") > 0).select("sig", "n", "keys").mapInArrow(_send, "key long, near long, sig long")
    sent = sent.repartition(parts, F.shiftright("key", OPEN)).sortWithinPartitions("key")
    return sent.mapInArrow(_meet, "key long, sig long, anchors array<long>")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """node, component over sigs: those of 'similarity of at least 0.8', found in ``rows`` of keyed()."""
    blocks = common.materialize(meetings(rows), "blocks")
    needed = blocks.select("sig").distinct()
    sets = common.materialize(sets_of(docs, rows.where(F.size("keys") > 0).join(needed, "sig", "left_semi").select("doc_id")).join(needed, "sig", "left_semi"), "shingle-sets")
    pairs = blocks.select("sig", F.explode("anchors").alias("a")).where("a <> sig").select(F.least("sig", "a").alias("u"), F.greatest("sig", "a").alias("v")).distinct()
    found = common.materialize(_alike(pairs, sets), "links")
    n = found.count()
    comp = common.materialize(components(found), "first-components", 2 * n) if n else None
    late = _rest(blocks, comp, sets)
    common.discard(blocks, sets, found)
    if late.isEmpty():
        return comp
    return components(late if comp is None else late.unionByName(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns: one row of each group of near copies, of the document with the
    least doc_id (null after all others; of several shingle sets and rows with it, one)."""
    rows = common.materialize(keyed(docs), "shingles")
    comp = links(docs, rows)
    sizes = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("w"))
    if comp is None:
        few = sizes.where("n > 1").withColumn("c", F.col("sig"))
    else:
        few = sizes.join(comp, sizes["sig"] == comp["node"], "left").where("n > 1 or component is not null").withColumn("c", F.coalesce("component", "sig"))
    few = common.materialize(few.select("sig", "c", "w"), "groups")
    best = few.groupBy("c").agg(F.min(F.struct("w.none", "w.doc_id", "sig")).alias("best"))
    # A row that stays is named too if it has repeats: one of them comes back below.
    names = rows.groupBy("doc_id", "sig").agg(F.count("*").alias("n")).join(few.join(best, "c").select("sig", "best"), "sig")
    names = names.withColumn("stays", F.expr("sig = best.sig and doc_id <=> best.doc_id")).where("not stays or n > 1")
    names = common.materialize(names.select(F.col("doc_id").alias("_d"), F.col("sig").alias("_s"), "stays"), "copies")
    common.discard(rows, few)
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_sig") == F.col("_s"))
    kept = with_signature(docs, names.select(F.col("_d").alias("doc_id"))).join(names, same, "left_anti").select("_doc")
    many = names.where("stays")
    if not many.isEmpty():
        again = with_signature(docs, many.select(F.col("_d").alias("doc_id"))).where("_sig is not null").join(many, same, "left_semi")
        # Partial minimums: a task sends one row, however many repeats it has.
        one = again.groupBy("_id", "_sig").agg(F.min_by("_doc", F.xxhash64(F.to_json("_doc"))).alias("_doc"))
        kept = kept.union(one.select("_doc"))
    return kept.select("_doc.*").select(*(F.col(f"`{c}`") for c in docs.columns))


def with_signature(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """_doc (all columns of ``docs``), _id and _sig, which is null for documents that are not in ``ids``."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(Ids(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            sigs = [signature(shingles(t)) if held.value.may_hold(d) else None for d, t in zip(b.column("_id").to_pylist(), common.texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("_doc"), b.column("_id"), pa.array(sigs, pa.int64())], ["_doc", "_id", "_sig"])

    return packed.mapInArrow(run, T.StructType([packed.schema["_doc"], T.StructField("_id", T.LongType()), T.StructField("_sig", T.LongType())]))
