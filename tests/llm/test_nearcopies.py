"""The pipeline's near-copy stage against all pairs."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, nearcopies, simhash

rng = random.Random(11)


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def slow_kept(rows):
    """Of (doc_id, text) the least doc_id of each component of 'similarity of at least 0.8'."""
    ids = sorted(rows)
    sets = [grams(rows[i]) for i in ids]
    root = list(range(len(ids)))
    for j in range(len(ids)):
        for i in range(j):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return sorted({ids[r] for r in root})


def edited(text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("cell", [nearcopies.CELL, 4])
def test_keep_first_takes_similarity_of_five_words(spark, docs_of, monkeypatch, cell):
    """Groups with scattered edits around the bound, chains, a large group, copies and short texts."""
    monkeypatch.setattr(nearcopies, "CELL", cell)
    pool = [f"tok{i}" for i in range(4000)]
    texts = []
    for size in (2, 3, 3, 4, 5, 5, 40):
        base = now = " ".join(rng.choice(pool) for _ in range(rng.randint(120, 240)))
        texts.append(base)
        for _ in range(size):
            texts.append(edited(base, rng.randint(0, 6)))
            now = edited(now, rng.randint(1, 5))
            texts.append(now)
    texts += ["", None, "one two", "ONE two", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    rows = dict(enumerate(texts))
    sets = [grams(t) for t in texts]
    wide = [1 for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j]) and bin(simhash.fingerprint((texts[i] or "").encode()) ^ simhash.fingerprint((texts[j] or "").encode())).count("1") > 3]
    assert len(wide) > 20
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs_of(texts)).collect()) == slow_kept(rows)


def test_shared_shingles(monkeypatch):
    monkeypatch.setattr(nearcopies, "COLUMNS", 5)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 20))), np.int64) for _ in range(12)] + [np.array([99], np.int64)]
    got = nearcopies.shared_shingles(sets[:7], sets)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets[:7]]
    assert nearcopies.shared_shingles(sets[:1], sets[-1:]).tolist() == [[0]]


def test_no_pair_of_a_block_stays_undecided(spark, docs_of, monkeypatch):
    """Every text lies in one block, so all but its anchors are decided in cells."""
    monkeypatch.setattr(nearcopies, "CELL", 8)
    pool = [f"tok{i}" for i in range(900)]
    bases = [" ".join(rng.choice(pool) for _ in range(80)) for _ in range(12)]
    texts = [edited(rng.choice(bases), rng.randint(0, 5)) for _ in range(90)]
    docs = docs_of(texts)
    rows = common.materialize(nearcopies.keyed(docs).withColumn("keys", F.array(F.lit(5).cast("long"))), "one-block")
    component = {r["node"]: r["component"] for r in nearcopies.links(docs, rows).collect()}
    first = {}
    for r in sorted(rows.collect()):
        first.setdefault(component.get(r["sig"], r["sig"]), r["doc_id"])
    assert sorted(first.values()) == slow_kept(dict(enumerate(texts)))
    assert 12 <= len(first) < 80


def test_one_row_of_each_group_stays(spark, odd, docs_of):
    """Repeated rows, copies under null ids only, and one doc_id with several texts; rows are counted."""
    word = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    row = lambda i, t, k=0: (i, t, "en", "s", None, k)
    docs = docs_of([row(1, word("a"))] * 5 + [row(None, word("b"), k) for k in range(4)] + [row(2, word("c")), row(2, word("d")), row(2, word("c"))] + [row(3, word("e")), row(None, word("e")), row(None, word("e"))] + [row(7, word("f")), row(6, word("f")), row(6, word("f"), 1)] + [row(None, None), row(None, ""), row(None, word("g"))])
    kept = simhash.keep_first(docs.repartition(3)).collect()
    want = [(1, "a"), (2, "c"), (2, "d"), (3, "e"), (6, "f"), (None, ""), (None, "b"), (None, "g")]
    assert Counter((r["doc_id"], (r["text"] or "")[:1]) for r in kept) == Counter(want)
    kept = simhash.keep_first(odd).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 3, 4, 9, 10, 11]


def test_ids_hold_every_id(spark):
    ids = [0, 1, 63, 64, -1, -64, (1 << 62) + 5, -(1 << 63), (1 << 24) - 1, None]
    held = nearcopies.Ids(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert all(held.may_hold(i) for i in ids) and not held.may_hold(2)


def near_sets(n, edits):
    own = np.random.default_rng(rng.getrandbits(32)).integers(0, 1 << 63, n + edits, np.uint64)
    return np.sort(own[:n]), np.sort(own[edits:])


def test_fingerprints_of_near_copies_meet_in_a_word():
    """The candidates come from long SimHash fingerprints: bits by majority, about 15 % apart at 0.8."""
    own = near_sets(300, 0)[0]
    h = [[int(x) * int(m) % (1 << 64) >> 32 for m in nearcopies._MUL[:3]] for x in own]
    want = [sum(1 << b for b in range(32) if 2 * sum(r[j] >> b & 1 for r in h) > 300) for j in range(3)]
    assert nearcopies.fingerprint(own)[:3].tolist() == want
    apart = [np.bitwise_count(nearcopies.fingerprint(a) ^ nearcopies.fingerprint(b)).sum() / (32 * nearcopies.WORDS) for a, b in (near_sets(180, 20) for _ in range(40))]
    assert 0.13 < np.mean(apart) < 0.165


def test_balls_link_variants_within_half_the_radius(monkeypatch):
    """Against all pairs; in parts, and with variants of many words."""
    words = [w ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 4))) for w in (rng.getrandbits(26) for _ in range(60)) for _ in range(4)]
    key = np.sort(np.array(words + [7] * 30, np.int64))
    near = np.array([rng.choice([0, 0, 0xFFFF, -1, 0x1FFFF]) for _ in key], np.int64)
    gap = lambda a, b: bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1")

    def slow(listed):
        root = list(range(len(key)))
        for j in range(len(key)):
            for i in range(j):
                if key[i] >> 24 == key[j] >> 24 and gap(key[i], key[j]) <= 2 and (gap(near[i], near[j]) <= nearcopies.NEAR or not listed and key[i] == key[j] == 7):
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
        return root

    assert nearcopies.balls(key, near).tolist() == slow(False)
    monkeypatch.setattr(nearcopies, "LISTED", 1000)
    assert nearcopies.balls(key, near).tolist() == slow(True)
    monkeypatch.setattr(nearcopies, "LOCAL", 50)
    assert nearcopies.balls(key, near).tolist() == slow(True)


def test_near_copies_meet_whatever_the_pieces(spark, monkeypatch):
    """Pairs at the bound of 0.8, and of four and five shingles, share a block."""
    pairs = [near_sets(180, 20) for _ in range(150)] + [(own, own[:4]) for own in (near_sets(5, 0)[0] for _ in range(60))]
    rows = [(2 * k + j, len(x), nearcopies.keys_of(x).tolist()) for k, p in enumerate(pairs) for j, x in enumerate(p)]
    table = spark.createDataFrame(rows, "sig long, n int, keys array<long>")

    def groups(blocks):
        met = {}
        for key, sig, anchors in blocks:
            met.setdefault(key, (set(), anchors))[0].add(sig)
            assert anchors == met[key][1]
        assert all(len(b) > 1 and set(anchors) <= b for b, anchors in met.values())
        return Counter(frozenset(b) for b, _ in met.values())

    got = groups(nearcopies.meetings(table).collect())
    own = {frozenset((2 * k, 2 * k + 1)) for k in range(len(pairs))}
    assert own <= set(got) and len(got) < len(own) + 5
    sig, n, keys = zip(*rows)
    sent = pa.Table.from_batches(nearcopies._send([pa.record_batch([pa.array(sig), pa.array(n, pa.int32()), pa.array(keys)], ["sig", "n", "keys"])])).sort_by("key")
    for local in (50, 3000):
        monkeypatch.setattr(nearcopies, "LOCAL", local)
        made = pa.Table.from_batches(nearcopies._meet(sent.to_batches(max_chunksize=37))).to_pylist()
        assert groups((r["key"], r["sig"], r["anchors"]) for r in made) == got


def test_members_of_many_blocks_meet_once(spark, docs_of, monkeypatch):
    """A group of texts a little under 0.8 that share blocks in many words: rows of cells are counted."""
    texts = [" ".join(f"new{k}x{i}" if i in (20, 50, 80, 110) else f"tok{i}" for i in range(150)) for k in range(30)]
    sets = [grams(t) for t in texts]
    decide, made = nearcopies._decide, []

    def counted(cells):
        made.append(cells.count())
        return decide(cells)

    monkeypatch.setattr(nearcopies, "_decide", counted)
    assert sum(alike(a, b) for a in sets for b in sets) == 30
    kept = sorted(r["doc_id"] for r in nearcopies.keep_first(docs_of(texts)).collect())
    assert kept == slow_kept(dict(enumerate(texts)))
    assert made and sum(made) <= 2 * len(texts)
