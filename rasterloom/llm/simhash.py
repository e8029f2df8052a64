"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A pair of fingerprints that differ in at most three bits shares a variant that one of them reaches
by at most one flip and the other by at most two flips in one half of the word (of three bits two
lie in one half). So every fingerprint stands at

* role b: itself and its 64 one-flip variants,
* role a: its 992 two-flip variants inside a half.

Fingerprints of role b at one variant are within two bits of each other, and any of role a there
is within three bits of any of role b: if a variant has a b, all of its fingerprints are linked, and
linking each to one b keeps every component with a number of links that is linear in the variants,
however large a group of near copies is. Two a's without a b say nothing.

Shuffling 1,057 variants of each fingerprint would take some 20 KB a document. Variants with two
flips in one half share the other half, so the shuffle key is a half: a fingerprint is sent under each
of its two halves and under their 64 one-flip variants (66 rows), and the receiving task unfolds the
variants of the half that the key leaves open. Each task joins its fingerprints in a union-find of
bounded chunks and returns links to the group's least, checked to be true paths; the components of
all links are found by star rounds.

Equal fingerprints are merged before any of this, so copies never meet as pairs.

Defined results: null text or text without words has fingerprint 0, linked like any other; null
doc_ids are kept out of the numbering: they get the component of their fingerprint (null if no other
document has it); repeated rows share a fingerprint; an empty table gives no rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .nearcopies import keep_first  # noqa: F401  the pipeline's stage, by five-word similarity

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
LOCAL = 1 << 22  # variants that a task holds at a time


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits: bit k is set if it is set in over half of the XXH64 (seed 42) of the shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    begin = [0, *ends[: n - width].tolist()]
    stop = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(begin, stop)], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[2 * ones > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in common.texts_of(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shuffle keys of fingerprints: side (bit 32) and half, with at most one flip."""
    low, high = fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)
    flips = np.concatenate([np.zeros(1, np.uint64), _BIT[:32]])
    keys = np.concatenate([high[:, None] ^ flips, (low[:, None] ^ flips) | np.uint64(1 << 32)], axis=1)
    return keys.ravel().astype(np.int64), np.repeat(np.arange(len(fps)), 66)


_PAIRS = np.array([(1 << i) | (1 << j) for i in range(32) for j in range(i)], np.uint64)


def _unfold(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Open halves of the variants at each key, the row they come from, and whether in role b."""
    side = key >> 32
    own = np.where(side == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
    free = np.where(side == 0, fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))
    exact = np.flatnonzero(own == (key & 0xFFFFFFFF).astype(np.uint64))
    every = np.arange(len(key))
    one = free[exact][:, None] ^ _BIT[:32]
    two = free[exact][:, None] ^ _PAIRS
    v = np.concatenate([free, one.ravel(), two.ravel()])
    row = np.concatenate([every, np.repeat(exact, 32), np.repeat(exact, len(_PAIRS))])
    return v, row, np.arange(len(v)) < len(free) + one.size


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.setdefault(root, root) != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def links(fps: DataFrame) -> DataFrame:
    """From (fp, rep), one row per distinct fingerprint, links (u, v) between reps whose
    components are those of 'differs in at most three bits'."""
    spark = fps.sparkSession

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp, rep = (b.column(k).slice(at, 4096).to_numpy(zero_copy_only=False) for k in (0, 1))
                key, row = _keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(rep[row])], ["key", "fp", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def join(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> None:
            """Rows of whole keys. Parts by the open half keep one part's variants in bounds."""
            parts = -(-32 * len(key) // LOCAL) if len(key) > LOCAL // 1024 else 1
            ids = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            for p in range(parts):
                found = []
                step = max(1, LOCAL // 1024)
                for a in range(0, len(key), step):
                    v, row, near = _unfold(key[a : a + step], fp[a : a + step])
                    if parts > 1:
                        mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == p
                        v, row, near = v[mine], row[mine], near[mine]
                    found.append((ids[a + row] << np.uint64(32) | v, row + a, near))
                v, row, near = (np.concatenate([f[i] for f in found]) for i in range(3))
                order = np.argsort(v, kind="stable")
                s = v[order]
                same = s[1:] == s[:-1]
                if not same.any():
                    continue
                inside = np.zeros(len(s), bool)
                inside[1:] |= same
                inside[:-1] |= same
                picked = order[inside]
                group = np.cumsum(np.concatenate([[True], v[picked][1:] != v[picked][:-1]])) - 1
                b = near[picked]
                anchor = np.full(group[-1] + 1, -1, np.int64)
                anchor[group[b]] = row[picked][b]
                a_row, g_row = row[picked], anchor[group]
                ok = (g_row >= 0) & (fp[a_row] != fp[np.maximum(g_row, 0)])
                pairs = np.unique(np.stack([rep[a_row[ok]], rep[g_row[ok]]], axis=1), axis=0)
                if len(pairs):
                    gap = np.bitwise_count(fp[a_row[ok]] ^ fp[g_row[ok]])
                    if (gap > 3).any():
                        raise AssertionError("linked fingerprints differ in more than three bits")
                for x, y in pairs.tolist():
                    x, y = _find(parent, x), _find(parent, y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            size += b.num_rows
            if size >= LOCAL // 32:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
                if cut:
                    join(rows[0, :cut], rows[1, :cut].view(np.uint64), rows[2, :cut])
                    held, size = [rows[:, cut:]], rows.shape[1] - cut
                else:
                    held = [rows]
        if size:
            rows = np.concatenate(held, axis=1)
            join(rows[0], np.ascontiguousarray(rows[1]).view(np.uint64), rows[2])
        out = [(x, r) for x in list(parent) if (r := _find(parent, x)) != x]
        for at in range(0, len(out), 50_000):
            u, v = zip(*out[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = fps.select("fp", "rep").mapInArrow(emit, "key long, fp long, rep long")
    return sent.repartition(n, "key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links, itself included)."""
    spark = docs.sparkSession
    fps = common.materialize(fingerprints(docs), "fingerprints")
    reps = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "representatives")
    found = common.materialize(links(reps.where("rep is not null")).distinct(), "links")
    linked = components(found)
    # Only fingerprints with several documents or links need a lookup.
    comp = reps.join(linked, reps["rep"] == linked["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), (F.col("n") > 1).alias("many"), F.col("component").isNotNull().alias("linked"))
    comp = common.materialize(comp.where("many or linked").select("fp", "component_id"), "components")
    return fps.join(comp, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
