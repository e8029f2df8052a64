"""Every operator against an independent brute-force version, and on odd rows."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import components, jpeg, langid, outliers, packing, queries, shards, simhash, substring, tokens, unigram, urls, wavelet

rng = random.Random(11)
WORDS = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta's", "eta!", "theta", "iota", "kappa", "12", "x&y", "lambda?", "mu", "nu"]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORDS)
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- 1


def test_word_cache_equals_the_library():
    alphabet = list("abcXYZ  ..,,!?'’\"|()-_09éÉßçñÖØ×ΣİıſŉĲ½²\t\n\r\x0b\x1c\x85\xa0 <|>漢字🙂́̈")
    pieces = ["<|endoftext|>", "'s", "'re", " 'LL", "don't", "<|StartOfText|>", "Ａ", "ﬁ", ". ", ",", "... ", "!. "]
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.9 else rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["x" * 300 + " y"]
    t = tokens.WordTokenizer(queries.WORDS, max_words=500)  # the cache is emptied on the way
    out = []
    for k in range(0, len(texts), 100):
        out += t.encode(texts[k : k + 100])
    assert [np.frombuffer(x, t.dtype).tolist() for x in out] == library_ids(texts)


def test_wavelet_shard_answers():
    a = np.array([rng.choice([0, 1, 5, 5, 5, 300, 49407]) for _ in range(150_000)], np.uint16)
    w = wavelet.WaveletShard(wavelet.build(a, np.array([100_000, 50_000]), [4, None], 16))
    assert (w.decode() == a).all() and w.doc_ids == [4, None]
    for i in (0, 65_535, 65_536, 149_999):
        assert w.access(i) == a[i]
    for token in (5, 300, 77):
        where = np.flatnonzero(a == token)
        assert w.count(token) == len(where) and w.count(token, 60_000, 70_001) == ((where >= 60_000) & (where < 70_001)).sum()
        assert w.rank(token, 70_000) == (where < 70_000).sum()
        assert [w.select(token, j) for j in range(0, len(where), 499)] == where[::499].tolist()
        assert w.occurrences(token).tolist() == where.tolist()
    for i in (*range(0, 1100, 7), *range(65_000, 66_000, 11), 149_999):
        assert w.access(i) == a[i] and w.rank(5, i) == (a[:i] == 5).sum()
    with pytest.raises(IndexError):
        w.select(77, 0)
    with pytest.raises(IndexError):
        w.access(150_000)


def test_op1(spark, docs_of):
    texts = [sentence(rng.randint(0, 80)) for _ in range(60)] + [None, "", "<|endoftext|> x"]
    rows = wavelet.read_documents(wavelet.encode(docs_of(texts), queries.WORDS, 2, shard_tokens=300)).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(rows, library_ids([t or "" for t in texts])):
        ids = ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids), crc(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(rows) == len(texts)


def test_shard_is_read_in_parts(tmp_path):
    a = np.array([rng.randint(0, 40_000) for _ in range(70_000)], np.uint16)
    path = str(tmp_path / "x.wvm")
    with open(path, "wb") as f:
        f.write(data := wavelet.build(a, np.array([70_000]), [1], 16))
    w = wavelet.WaveletShard.open(path)
    read = []
    w._read = lambda x, z, r=w._read: read.append(z - x) or r(x, z)
    assert w.access(65_540) == a[65_540] and sum(read) < len(data) / 10
    n = int(a[7])
    assert w.select(n, w.rank(n, 7)) == 7 and w.occurrences(n).tolist() == np.flatnonzero(a == n).tolist()


def test_plane_against_bits():
    for n in (1, 511, 512, 513, 3000, 1 << 16):
        bits = np.array([rng.random() < 0.3 for _ in range(n)])
        p = wavelet.Plane(wavelet._plane_bytes(bits), n, int((~bits).sum()))
        assert [p.rank(i) for i in range(0, n + 1, 97)] == [int(bits[:i].sum()) for i in range(0, n + 1, 97)] and p.rank(n) == bits.sum()
        for i in range(0, n, 53):
            assert p[i] == bits[i] and p.up(int(bits[i]), p.down(int(bits[i]), i)) == i


def test_op1_odd(spark, odd, docs_of):
    rows = wavelet.read_documents(wavelet.encode(odd, queries.WORDS)).collect()
    assert len(rows) == odd.count() and sum(r["n_tokens"] == 1 for r in rows) == 4
    assert wavelet.read_documents(wavelet.encode(docs_of([]), queries.WORDS)).collect() == []


def test_op1_one_doc_id_on_most_rows(spark):
    """Its texts are spread over ranges; every id is found where ``start`` says."""
    rows = [(7, f"{sentence(3)} {k} # #") for k in range(300)] + [(None, f"null {k}") for k in range(150)] + [(k, sentence(2)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = wavelet.encode(docs, queries.WORDS, shard_tokens=900)
    most = max(r["n_docs"] for r in manifest.groupBy("part").agg(F.sum("n_docs").alias("n_docs")).collect())
    assert most < 250
    got = sorted(wavelet.read_documents(manifest).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = Counter((d, crc([*i, 2]), i.count(2) + 1) for (d, _), i in zip(rows, library_ids([t for _, t in rows])))
    assert Counter((r["doc_id"], r["ids_crc32"], r["n_end_ids"]) for r in got) == want


# --- 2


@pytest.fixture(scope="module")
def pieces():
    return unigram.unigram(queries.PIECES)


def test_viterbi_is_best(pieces):
    score = {p: s for (p, _, kind), s in zip(pieces.pieces, pieces.scores) if kind == unigram.NORMAL}
    assert max(score.values()) < 0 and sum(map(np.exp, score.values())) == pytest.approx(1)

    def best(chunk):
        top = [0.0] + [-np.inf] * len(chunk)
        for e in range(1, len(chunk) + 1):
            for s in range(e):
                piece = chunk[s:e]
                if piece in score:
                    top[e] = max(top[e], top[s] + score[piece])
                elif e == s + 1:
                    top[e] = max(top[e], top[s] + pieces.unknown_score)
        return top[-1]

    for t in [sentence(5) for _ in range(30)] + ["漢字 ꙮ x", "  two  spaces "]:
        ids = np.frombuffer(pieces.encode([t])[0], "<u4")
        got = 0.0
        run = 0
        for i in ids:  # bytes of one unknown character cost once
            if pieces.is_byte[i]:
                run += 1
            else:
                got += pieces.scores[i]
        want = sum(best(c) for c in unigram._CHUNK.findall(unigram.MARK + t.replace(" ", unigram.MARK)))
        unknown = sum(1 for ch in t.replace(" ", unigram.MARK) if ch not in score) if run else 0
        assert got + unknown * pieces.unknown_score == pytest.approx(want)
        assert pieces.decode(ids) == t


def test_unigram_equals_the_library(pieces):
    """The library's own unigram encoder, given a model file with our log scores in it."""
    import struct

    import sentencepiece

    data = bytearray(open(queries.PIECES, "rb").read())
    at = data.index(b"\x18\x02\x20", data.index(b"tok_v0"))
    data[at + 1] = 1  # the model's type
    place = 0
    for (p, s, kind), own in zip(pieces.pieces, pieces.scores):
        old = p.encode() + b"\x15" + struct.pack("<f", s)
        place = data.index(old, place) + len(old) - 4
        data[place : place + 4] = struct.pack("<f", own)
    sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    same = 0
    texts = [sentence(4) for _ in range(40)] + ["des pour dans überheit señor", "漢字 x"]
    for t in texts:
        ours, theirs = np.frombuffer(pieces.encode([t])[0], "<u4"), np.array(sp.encode(t))
        assert pieces.scores[ours].sum() == pytest.approx(pieces.scores[theirs].sum(), abs=1e-3)
        assert pieces.decode(theirs) == t
        same += ours.tolist() == theirs.tolist()
    assert same >= 0.9 * len(texts)  # the rest are ties


def test_op2_odd(spark, odd, docs_of):
    rows = unigram.report(odd, queries.PIECES).collect()
    assert len(rows) == odd.count() and all(r["exact"] for r in rows)
    got = unigram.decode(unigram.encode(odd, queries.PIECES), queries.PIECES).collect()
    assert Counter(r["text"] for r in got) == Counter((r["text"] or "") for r in odd.collect())
    assert unigram.report(docs_of([]), queries.PIECES).collect() == []


# --- 3


def base(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    hit = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def mcd(vectors, groups):
    """Squared distances by numpy: starts, steps, pulls and grid as documented. Groups are (p, g)."""
    x, k = np.array(vectors), outliers.PRIOR
    langs, own = np.array([p for p, _ in groups]), np.array([f"{p} {g}" for p, g in groups])

    def pulled(value, n, parent):
        return (n * value + k * parent) / (n + k)

    def median(v):
        cell = np.sort(np.floor(v / outliers.GRID))
        at = cell[int(np.ceil(0.5 * len(v))) - 1]
        return (at + (0.5 * len(v) - (cell < at).sum()) / (cell == at).sum()) * outliers.GRID

    def medians(v):
        out = np.empty_like(v)
        for i in range(outliers.P):
            top = sum((langs == p).sum() * median(v[langs == p, i]) for p in set(langs)) / len(v)
            for g in set(own):
                of_lang = langs == langs[own == g][0]
                lang = pulled(median(v[of_lang, i]), of_lang.sum(), top)
                out[own == g, i] = pulled(median(v[own == g, i]), (own == g).sum(), lang)
        return out

    def moments(z, inside):
        """Per row, mean and covariance of its group."""
        both = np.concatenate([z, np.einsum("ni,nj->nij", z, z).reshape(len(z), -1)], axis=1)
        unit = np.concatenate([np.zeros(outliers.P), np.eye(outliers.P).ravel()])
        out = np.empty_like(both)
        mean = lambda pick, to: (both[pick].sum(axis=0) + k * to) / (pick.sum() + k)
        top = mean(inside, unit)
        for g in set(own):
            lang = mean(inside & (langs == langs[own == g][0]), top)
            out[own == g] = mean(inside & (own == g), lang)
        m = out[:, : outliers.P]
        return m, out[:, outliers.P :].reshape(-1, outliers.P, outliers.P) - np.einsum("ni,nj->nij", m, m)

    b = medians(x)
    s = np.maximum(1.4826 * medians(np.abs(x - b)), outliers.FLOORS)
    z, every, ridge = (x - b) / s, np.ones(len(x), bool), np.eye(outliers.P) * outliers.RIDGE
    _, cov = moments(np.tanh(z), every)
    var = np.einsum("nii->ni", cov)
    cor = cov / np.sqrt(np.maximum(np.einsum("ni,nj->nij", var, var), 1e-6))
    cor[:, np.arange(outliers.P), np.arange(outliers.P)] = 1
    distance = lambda m, c: np.einsum("ni,nij,nj->n", z - m, np.linalg.inv(c), z - m)
    found = []
    for c in (np.broadcast_to(np.eye(outliers.P), cor.shape), cor):
        m, c = np.zeros_like(z), c + ridge
        for _ in range(outliers.STEPS):
            cell = np.floor(np.log1p(distance(m, c)) / outliers.STEP)
            inside = np.zeros(len(z), bool)
            for g in set(own):
                mine = own == g
                inside |= mine & (cell <= np.sort(cell[mine])[int(np.ceil(outliers.SHARE * mine.sum())) - 1])
            m, c = moments(z, inside)
            c = c / outliers.FACTOR + ridge
        found.append((np.linalg.slogdet(c)[1], distance(m, c)))
    return np.where(found[0][0] <= found[1][0], found[0][1], found[1][1])


def vector(b, lines):
    n, chars, symbols, dup, rep = b
    return [np.log(n), np.log(chars / n), np.sqrt(symbols / n), np.sqrt(rep / n), np.sqrt(dup / max(lines, 1))]


def test_op3_against_numpy(spark):
    """Groups from one row to 200, null names, junk; the verdicts and distances of every row."""
    pool = [f"word{i}" for i in range(3000)]
    kinds = [("en", "a")] * 200 + [("en", "b")] * 40 + [("en", None)] * 9 + [("fr", "a")] * 20 + [(None, "z")]
    clean = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(8, 14))) for _ in range(rng.randint(8, 30))) for _ in kinds]
    junk = ["\n".join(["### $$$ buy | now | %%%"] * 20) + " " + " ".join(rng.choice(pool) for _ in range(60)) for _ in range(9)]
    texts = clean + junk + ["short", None, "", "a b c " * 40]
    kinds += [("en", "a")] * 6 + [("en", "b"), ("fr", "a"), ("xx", "only junk")] + [("en", "a"), ("en", "failed"), (None, None), ("en", "a")]
    docs = spark.createDataFrame([(i, t, lang, src) for i, (t, (lang, src)) in enumerate(zip(texts, kinds))], "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in outliers.rules(docs).collect()}
    assert len(rows) == len(texts)
    fit, of = [], []
    for i, t in enumerate(texts):
        r, b = rows[i], base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert r["base_failed"] == failed
        if failed:
            assert not r["kept"]
        else:
            lines = len([x for x in t.split("\n") if x.strip()])
            fit.append(vector(b, lines))
            of.append(i)
    d2 = mcd(fit, [kinds[i] for i in of])
    assert np.allclose(d2, [rows[i]["d2"] for i in of], rtol=1e-3, atol=1e-3)
    limit = outliers.chi2_quantile(1 - outliers.TAIL, outliers.P)
    assert [rows[i]["kept"] for i in of] == (d2 <= limit).tolist()
    n = len(clean)
    assert all(rows[i]["kept"] for i in range(n)) and not any(rows[i]["kept"] for i in range(n, n + 9))


def test_op3_odd_and_keep(spark, odd, docs_of):
    assert outliers.rules(odd).count() == odd.count()
    assert outliers.rules(docs_of([])).count() == 0
    kept = outliers.keep(odd)
    assert kept.columns == odd.columns and {r["text"] for r in kept.collect()} == {r["text"] for r in odd.collect() if base(r["text"])[0] >= 50 and 100 * base(r["text"])[4] <= 50 * base(r["text"])[0]}


def test_chi2():
    assert outliers.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


# --- 4


def test_op4_round_trip(spark, odd, docs_of):
    rows = jpeg.inspect(jpeg.store(odd)).collect()
    assert len(rows) == odd.count()
    want = Counter()
    for r in odd.collect():
        t = (r["text"] or "").encode()
        p = t + b" " * (-len(t) % 192 or 192 * (not t))
        want[len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    by = defaultdict(set)
    for r in rows:
        by[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert jpeg.inspect(jpeg.store(docs_of([]))).collect() == []


def slow_decode(data):
    """One symbol at a time, without numpy lanes."""
    h = jpeg.Header(data)
    codes = {}
    for k, spec in h.huff.items():
        code, at, out = 0, 16, {}
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                out[n, code] = spec[at]
                code, at = code + 1, at + 1
            code <<= 1
        codes[k] = out
    units, body = [], data[h.scan : -2]
    at = 0
    while len(units) < h.units:
        bits = ""
        while at < len(body) and not (body[at] == 0xFF and 0xD0 <= body[at + 1] <= 0xD7):
            bits += f"{body[at]:08b}"
            at += 2 if body[at] == 0xFF else 1
        at += 2
        i, dc = 0, [0] * len(h.parts)

        def symbol(table):
            nonlocal i
            n, code = 0, 0
            while (n, code) not in table:
                code, n, i = code << 1 | int(bits[i]), n + 1, i + 1
            size = table[n, code] & 15
            v = int(bits[i : i + size] or "0", 2)
            i += size
            return table[n, code], v if not size or v >= 1 << (size - 1) else v - (1 << size) + 1

        for _ in range(h.interval or h.units):
            unit = []
            for part in h.blocks:
                block = [0] * 64
                _, v = symbol(codes[h.parts[part][3]])
                dc[part] += v
                block[0], k = dc[part], 1
                while k < 64:
                    s, v = symbol(codes[h.parts[part][4]])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = v
                    k += 1
                unit.append(block)
            units.append(unit)
    return np.array(units)


def test_jpeg_decoder_against_slow_one():
    texts = [bytes(rng.randrange(256) for _ in range(192 * n)) for n in (1, 2, 3, 5, 7)]
    files = jpeg.payloads_to_jpegs(texts, [len(t) for t in texts])
    for data, (h, c), t in zip(files, jpeg.decode(files), texts):
        assert (c == slow_decode(data)).all()
        assert jpeg.stored_payload(h, c) == (t, len(t))
        assert jpeg.thumbnail(h, c).shape == (h.rows, h.cols)


def test_jpeg_predicted_dc_and_runs():
    """A hand-made gray file without restarts: DC differences, a zero run and end of block."""
    dht = bytes([0x00, 0, 2, 1, *[0] * 13, 0, 3, 4]) + bytes([0x10, 0, 2, 1, *[0] * 13, 0, 0x21, 0xF0])
    m = jpeg._marker
    bits = "01" + "101" + "01" + "1" + "00" + "01" + "010" + "00"  # +5, run 2 value 1, end; -5, end
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    data = b"\xff\xd8" + m(0xDB, bytes([0] + [2] * 64)) + m(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + m(0xC4, dht) + m(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"
    (h, c), = jpeg.decode([data])
    assert c[0, 0, 0] == 5 and c[0, 0, 3] == 1 and c[1, 0, 0] == 0 and np.count_nonzero(c) == 2
    assert (c == slow_decode(data)).all()
    assert jpeg.thumbnail(h, c).tolist() == [[129, 128]]
    with pytest.raises(ValueError):
        jpeg.decode([b"no"])


# --- 5


def slow_fingerprint(text):
    t = (text or "").encode()
    t = bytes(c + 32 if 65 <= c <= 90 else c for c in t).split()
    if not t:
        return 0
    grams = [b" ".join(t[i : i + 3]) for i in range(len(t) - 2)] or [b" ".join(t)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark, docs_of):
    texts = [sentence(rng.randint(0, 9)) for _ in range(50)] + [None, "", "ÀÉ a A", "one two", "one two three"]
    rows = simhash.fingerprints(docs_of(texts)).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


def test_links_find_every_component(spark):
    """Chains and clusters at distances 0 to 4, over all bit positions."""
    fps = []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
    for flips in ((0, 1, 2), (0, 1, 40), (33, 40, 63), (5, 33, 40)):
        x = rng.getrandbits(64)
        fps += [x, x ^ sum(1 << b for b in flips)]
    own = {}
    for i, f in enumerate(fps):
        own.setdefault(f, i)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in own.items()], "fp long, rep long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(table)).collect()}
    want = slow_components(fps)
    assert [got.get(own[f], own[f]) for f in fps] == want


def test_op5_odd(spark, odd, docs_of):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    ids = [(r["doc_id"], r["fp"]) for r in rows]
    fps = [f % (1 << 64) for _, f in ids]
    for r, root in zip(rows, slow_components(fps)):
        group = [i for (i, _), x in zip(ids, slow_components(fps)) if x == root and i is not None]
        assert r["component_id"] == (min(group) if group else None)
    assert simhash.near_duplicates(docs_of([])).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert len({r["doc_id"] for r in kept.collect()}) == len({r["component_id"] for r in rows})


def test_components_of_star_chain_and_loop(spark):
    edges = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(2, 200)) and all(got[i] == 1000 for i in range(1000, 1101)) and 5000 not in got


# --- 6


def spark_hash(*values):
    """Spark's xxhash64 of ints (as numpy types) in a row; null leaves the hash as it is."""
    h = 42
    for v in values:
        h = h if v is None else xxhash.xxh64_intdigest(v.tobytes(), h)
    return h


def mersenne_shuffle(n, seed):
    """Fisher-Yates inside out, with a Mersenne Twister seeded by the two halves of a long."""
    draw = np.random.RandomState(np.array([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF], np.uint32))

    def below(k):
        while True:
            bits = int(draw.randint(0, 1 << 32, dtype=np.uint32)) >> 1
            if k & (k - 1) == 0:
                return k * bits >> 31
            if bits - bits % k + k - 1 < 1 << 31:
                return bits % k

    out = []
    for i in range(n):
        j = below(i + 1)
        out.append(out[j] if j < i else i)
        out[j] = i
    return out


def slow_shards(rows, number, seed, bucket_bytes):
    """(shard, slot, doc_id, text) by scatter and permutation."""
    total = sum(len((t or "").encode()) + shards.ROW for _, t in rows)
    buckets = max(1, -(-total // bucket_bytes))
    held = [[] for _ in range(buckets)]
    for d, t in rows:
        h = spark_hash(np.int32(seed), None if d is None else np.int64(d), np.int64(zlib.crc32((t or "").encode())))
        h -= (h >> 63) << 64
        held[h % buckets].append((h, -(1 << 63) if d is None else d, d, t))
    g, out = 0, []
    for b, own in enumerate(held):
        own.sort(key=lambda x: x[:2])
        for (_, _, d, t), new in zip(own, mersenne_shuffle(len(own), seed + b)):
            place = g + new
            shard = place * number // len(rows)
            out.append((shard, place - -(-shard * len(rows) // number), d, t))
        g += len(own)
    return out


def test_op6(spark, odd, docs_of):
    docs = docs_of([sentence(rng.randint(0, 30)) for _ in range(203)]).unionByName(odd)
    for size in (8000, 400_000):
        placed = shards.shuffle_to_shards(docs.repartition(3), bucket_bytes=size)
        got = Counter((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in placed.collect())
        assert got == Counter(slow_shards([(r["doc_id"], r["text"]) for r in docs.collect()], 8, shards.SEED, size))
    rows = shards.digest(placed).collect()
    n = docs.count()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert len(rows) == n and Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert shards.shuffle_to_shards(docs_of([])).count() == 0
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert order != sorted(order)


def test_op6_equal_rows_are_spread(spark, tmp_path):
    """Half of the rows are equal: they lie in many buckets, files keep slot order, slots have no gaps."""
    rows = [(1, "same text", "x")] * 3000 + [(i, f"text {i}", "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards.write_shards(docs, str(tmp_path / "out"), shards=3, bucket_bytes=8000)
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) > 20
    for f in files:
        slots = [r["slot"] for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len(slots) < 1000
    back = shards.read_shards(spark, str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t) for d, t, _ in rows)
    assert sorted((r["shard"], r["slot"]) for r in back) == [(s, k) for s in range(3) for k in range(2000)]


# --- 7


def test_op7_learns(spark, docs_of):
    pool = {"en": "the of and to with that this".split(), "fr": "le la les des que pour à".split(), "de": "der die und nicht für ist ö".split()}
    rows = [(i, " ".join(rng.choice(pool[k]) for _ in range(40)), k, "s", None, 1) for i, k in enumerate(rng.choice(list(pool)) for _ in range(300))]
    rows += [(300, None, "en", "s", None, 1), (301, "12 !?", "en", "s", None, 1), (None, rows[0][1], None, None, None, None), (302, "the of and", None, "s", None, 1)]
    got = langid.identify(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(303))
    held = [(by[i]["lang_pred"], k) for i, _, k, *_ in rows[:300] if by[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert by[300]["lang_pred"] == by[301]["lang_pred"] == "und" and by[300]["rejected"] and by[300]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for i, r in by.items() if i is not None and i < 300)


def test_op7_odd(spark, odd, docs_of):
    assert langid.identify(odd).count() == odd.count()
    assert {r["lang_pred"] for r in langid.identify(docs_of([(1, "a b", None, None, None, None)])).collect()} == {"und"}
    assert langid.identify(docs_of([])).count() == 0 and langid.keep(odd).columns == odd.columns


def slow_gram(data):
    """Bucket of one gram of 2 to 4 bytes, on Python integers."""
    h = data[0]
    for c in data[1:]:
        h = (h * 0x01000193 + c) % 2**32
    return ((h ^ ((len(data) - 1) * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32 >> 16) % langid.BUCKETS


def slow_score(m, text):
    """Label and score of a text, gram by gram."""
    t = langid.fold(text)
    picked = [m.table[slow_gram(t[i : i + n])].astype(float) for n in (2, 3, 4) for i in range(len(t) - n + 1)]
    z = (sum(picked) / len(picked) + m.bias) / m.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    k = int(p[: len(m.labels)].argmax())
    return k, p[k]


def test_langid_scores_gram_by_gram(monkeypatch):
    """Whole texts, whatever their neighbours in a batch are, and longer than a piece."""
    m = langid.train([w * 30 for w in ("abc ", "xyz ")] * 20, ["a", "b"] * 20)
    texts = ["a", "", "abc xyz", "é", "Xyz-abc " * 30, "12a", "漢字", "q"]
    best, score = m.predict([langid.fold(t) for t in texts])
    assert [slow_score(m, t)[0] for t in texts] == best.tolist()
    assert np.allclose([slow_score(m, t)[1] for t in texts], score, atol=1e-6)
    long = [langid.fold("abc " * 200_000), langid.fold("xyz " * 10)]
    apart = np.stack([m.logits([t])[0] for t in long])
    assert np.allclose(m.logits(long), apart, atol=1e-6)


def test_langid_rejects_what_it_does_not_know():
    """A language left out of training, and noise that training has not seen; known texts stay."""
    import pyarrow.parquet as pq

    docs = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist() if r["text"] and r["lang"] and len(r["text"]) > 100]
    for foreign in ("es", "de"):
        known = [r for r in docs if r["lang"] != foreign]
        m = langid.train([r["text"] for r in known[::2]], [r["lang"] for r in known[::2]])
        rate = lambda texts: np.mean(m.predict([langid.fold(t) for t in texts])[1] < m.floor)
        tested = [r["text"] for r in known[1::2]]
        best, _ = m.predict([langid.fold(t) for t in tested])
        assert np.mean([m.labels[k] == r["lang"] for k, r in zip(best, known[1::2])]) >= 0.99
        assert rate(tested) <= 0.01
        assert rate(langid.noise(tested, np.random.default_rng(99))) >= 0.98
        assert rate([r["text"] for r in docs if r["lang"] == foreign]) >= 0.9


def test_op7_learns_a_rare_label(spark, docs_of):
    """A label with one row in a hundred is sampled by itself; one document on many rows counts once."""
    pool = {"en": "the of and to with that this".split(), "zz": "zuk zak zir zot zemm".split()}
    rows = [(i, " ".join(rng.choice(pool["zz" if i % 100 == 0 else "en"]) for _ in range(40)), "zz" if i % 100 == 0 else "en", "s", None, 1) for i in range(3000)]
    rows += [(1, rows[1][1], "en", "s", None, 1)] * 1000
    m = langid.fit(docs_of(rows), per_label=60)
    best, score = m.predict([langid.fold(r[1]) for r in rows])
    assert [m.labels[k] for k in best] == [r[2] for r in rows] and np.mean(score >= m.floor) > 0.99


# --- 8


def slow_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_op8(spark):
    made = [None, "", "no", "http://", "http://ORG/", "https://a.b.example.org/es/x?y#z", "http://example.org/en/17", "http://notexample.org/es/", "http://x.com/fr/", "http://com/de/?q", "ftp://x.com#/de/", "http://org?/", "http://x.com/de", "a://b://c/", "http://.org/", "http://org./", "http://é.com/fr/é"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made * 2)] + [(None, "http://a.org/", None)], "page_id long, url string, rule string")
    rows = urls.judge(pages, urls.standing_rules(spark)).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == Counter((p["page_id"], *slow_rule(p["url"], urls.RULES)) for p in pages.collect())
    none = urls.judge(pages, urls.standing_rules(spark).where("false"), "block").collect()
    assert len(none) == pages.count() and {r["verdict"] for r in none} == {"block"}
    assert urls.judge(pages.where("false"), urls.standing_rules(spark)).count() == 0


# --- 9


def check_pieces(rows, texts, length=2048):
    ids = {k: np.array([*x, 1], "<u4") for (k, _), x in zip(texts.items(), library_ids([t or "" for t in texts.values()]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for k, x in ids.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(x)
    sizes = []
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        sizes.append(at)
    return sizes


def test_op9(spark, docs_of):
    texts = [sentence(rng.choice([0, 3, 50, 400, 3000])) for _ in range(120)] + [None]
    docs = docs_of(texts).repartition(3)
    for windows in (64, 4):
        rows = packing.digest(packing.pack(docs, queries.WORDS, 1, open_windows=windows), queries.WORDS).collect()
        sizes = check_pieces(rows, dict(enumerate(texts)))
        assert sum(sizes) >= 0.9 * 2048 * len(sizes)


def test_open_windows_best_fit():
    w = packing.OpenWindows(10, 2)
    assert w.place((1, 0, 6, b"", 0)) is None and w.place((2, 0, 7, b"", 0)) is None
    assert w.place((3, 0, 4, b"", 0)) == [(1, 0, 6, b"", 0), (3, 0, 4, b"", 0)]  # fills the first
    assert w.place((4, 0, 8, b"", 0)) is None
    assert w.place((5, 0, 5, b"", 0)) == [(4, 0, 8, b"", 0)]  # the fullest goes


def test_op9_odd(spark, odd, docs_of):
    rows = packing.pack(odd, queries.WORDS).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in library_ids([r["text"] or "" for r in odd.collect()]))
    assert packing.pack(docs_of([]), queries.WORDS).count() == 0


# --- 10


def slow_removal(docs, window=20):
    seen, out = {}, {}
    for k, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen and seen[key] < (k, i):
                gone[i : i + window] = [True] * window
            seen.setdefault(key, (k, i))
        out[k] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def passage_docs(n=120):
    pool = [f"w{i}" for i in range(5000)]
    some = lambda k: [rng.choice(pool) for _ in range(k)]
    shared = [some(rng.choice([19, 20, 21, 60, 300])) for _ in range(12)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += some(rng.randint(0, 40)) + (rng.choice(shared) if rng.random() < 0.6 else [])
        out.append(" ".join(w))
    periodic = ["ab cd " * 50, "ab cd " * 10, "x " * 200, " ".join(["p q r s t"] * 12)]
    return out + periodic + [out[3], out[5] + "\n" + out[3]] + [" ".join(shared[k]) for k in range(12)]


def test_op10_against_brute_force(spark, docs_of):
    texts = passage_docs()
    rows = substring.digest(docs_of(texts).repartition(4)).collect()
    want = slow_removal(list(enumerate(texts)))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want


def test_op10_small_flushes_and_shards(spark, docs_of, monkeypatch):
    """Collapsing in small flushes and shards of a few windows changes nothing."""
    texts = passage_docs(40)
    monkeypatch.setattr(substring, "FLUSH", 50)
    monkeypatch.setattr(substring, "CHUNK", 7)
    h = substring.word_hashes([b"a", b"b", b"a", b"b", b"a", b"b", b"a", b"b", b"a", b"b"])
    assert len(set(substring._runs(h, 4).tolist())) == 2
    rows = substring.digest(docs_of(texts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == slow_removal(list(enumerate(texts)))


def test_suffix_automaton():
    for _ in range(60):
        ref = [rng.choice("ab") for _ in range(rng.randint(1, 40))]
        a = substring.SuffixAutomaton()
        for c in ref:
            a.extend(c)
        query = [rng.choice("abc") for _ in range(60)]
        for n in (1, 3, 5):
            want = []
            for i in range(n - 1, len(query)):
                at = next((e for e in range(n - 1, len(ref)) if ref[e - n + 1 : e + 1] == query[i - n + 1 : i + 1]), None)
                if at is not None:
                    want.append((i, at))
            assert list(a.matches(query, n)) == want


def test_op10_odd(spark, odd, docs_of):
    rows = substring.digest(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["n_words"] == 60]
    # doc 4 twice (one document), doc 5 a later copy, one without an id
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in same) == [(False, 0), (False, 0), (False, 60), (True, 0)]
    out = substring.remove(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["text"] for r in out.collect() if r["doc_id"] == 5} == {""}
    assert substring.digest(docs_of([])).count() == 0


def test_cut_words_keeps_the_rest():
    assert substring.cut_words(b" a b\n c  d e", [(1, 3)]) == b" a  d e"
    assert substring.cut_words(b"a b", [(0, 2)]) == b"" and substring.cut_words(b" a", []) == b" a"


CLASHING = ["_doc", "_id", "_d", "_f", "_rest", "_spans", "_h", "fp", "ids", "part", "bucket", "key", "rows", "kept", "d2", "g", "z0", "x0", "n_words", "base_failed", "score", "lang_pred", "rejected", "value", "values", "roles", "text_hash", "media", "open", "shard", "slot", "component_id", "rep", "n", "a.b"]


def test_extra_columns_with_clashing_names(spark, odd):
    from pyspark.sql import functions as F

    docs = odd.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    n = odd.count()
    for made in (wavelet.read_documents(wavelet.encode(docs, queries.WORDS)), unigram.report(docs, queries.PIECES), outliers.rules(docs), jpeg.inspect(jpeg.store(docs)), simhash.near_duplicates(docs), shards.digest(shards.shuffle_to_shards(docs)), langid.identify(docs), substring.digest(docs)):
        assert made.count() == n
    assert packing.pack(docs, queries.WORDS).count() >= n
    for stage in (outliers.keep, langid.keep, simhash.keep_first, substring.remove):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {r["a.b"] for r in out.collect()} <= {len(CLASHING) - 1}
