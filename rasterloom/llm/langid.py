"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte 2-, 3- and 4-grams of the lower-cased text (ASCII other than letters counts as a word edge) hash
into ``BUCKETS`` embeddings; their mean goes through a linear softmax. Both are trained with
mini-batch stochastic gradient descent in numpy on a bounded sample: about ``per_label`` documents of
every label (all of a rarer one) of at most ``sample_bytes`` bytes, chosen by a hash, whole and cut into
snippets. Predictions read whole texts; averaging being linear, embeddings and softmax weights fold
into one score table that is broadcast (``BUCKETS`` x languages, bounded).

*Rejection.* The softmax has one class more, of noise made from the sample: letters shuffled within a
text, letters replaced one for one (an unknown language with the shape of a known one), random letters,
and words of other scripts. A prediction's score is the calibrated probability of the best label among
labels and noise. A tenth of sample and noise is held back: one temperature by likelihood, and as
threshold the largest score that at most ``REJECT_SHARE`` of the clean texts fall below, but not over
the score that leaves ``NOISE_SHARE`` of the noise.

Defined results: null text or text without a letter is ``und`` with score 0 and rejected; with nothing
to learn from, every document is; null doc_ids are predicted but never learned from (held_out is
false); repeated rows get equal predictions; other columns are not touched."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS, DIM = 1 << 16, 16
PER_LABEL, SAMPLE_BYTES = 400, 20_000
SNIPPET = 240  # bytes, about 40 words
REJECT_SHARE, NOISE_SHARE = 0.002, 0.001
#: Letters of other scripts, for noise: Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Kana, Han, Hangul.
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 2-, 3- and 4-gram that starts at each byte (fewer at the end)."""
    a = data.astype(np.uint32)
    out, h = [], a
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            h = h[:-1] * np.uint32(0x01000193) + a[n:]
            out.append(((h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64) % BUCKETS)
    return out


def inner_grams(joined: bytes, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For texts of ``n`` bytes in a row, the 2-, 3- and 4-gram at each byte, and where these reach out of
    their text."""
    ends = np.cumsum(n)
    out = []
    for k, g in enumerate(grams(np.frombuffer(joined + b"   ", np.uint8)), 1):
        across = np.concatenate([(ends - back)[n >= back] for back in range(1, k + 1)])
        out.append((g[: len(joined)], across))
    return out


def fold(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_FOLD) + b" "


class Model:
    """Labels, score table, temperature and the score below which predictions are rejected."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.labels, self.table, self.bias, self.temperature, self.floor = labels, table, bias, temperature, floor

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean table rows of folded texts, a few MB at a time and whole. Only grams that lie inside a
        text count, so neighbours in a batch do not show."""
        sums, counts = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        lengths = np.array([len(t) for t in texts], np.int64)
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) < 1 << 18:
                size += len(texts[to])
                to += 1
            if to - at == 1:
                for a in range(0, size, 1 << 18):
                    for g in grams(np.frombuffer(texts[at][a : a + (1 << 18) + 3], np.uint8)):
                        g = g[: 1 << 18]
                        sums[at] += self.table[g].sum(axis=0, dtype=np.float64)
                        counts[at] += len(g)
            else:
                n = lengths[at:to]
                for k, (g, across) in enumerate(inner_grams(b"".join(texts[at:to]), n), 1):
                    rows = self.table[g]
                    rows[across] = 0
                    sums[at:to] += np.add.reduceat(rows, np.cumsum(n) - n, axis=0, dtype=np.float64)
                    counts[at:to] += np.maximum(n - k, 0)
            at = to
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest label and its calibrated probability."""
        z = self.logits(texts) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p[:, : len(self.labels)].argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def noise(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts of no known language, made from every text in turn in one of four ways."""
    out = []
    for k, text in enumerate(texts):
        words = text.lower().split(" ")
        if k % 4 == 0:  # the text's letters in any order
            letters = "".join(words)
            mixed, at = "".join(letters[i] for i in rng.permutation(len(letters))), np.cumsum([0, *map(len, words)])
            words = [mixed[a:z] for a, z in zip(at[:-1], at[1:])]
        elif k % 4 == 1:  # one letter for another
            own = sorted({c for c in text.lower() if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz"))
            to = str.maketrans(dict(zip(own, (own[i] for i in rng.permutation(len(own))))))
            words = [w.translate(to) for w in words]
        elif k % 4 == 2:
            words = ["".join(map(chr, rng.integers(97, 123, len(w)))) for w in words]
        else:
            a, z = SCRIPTS[rng.integers(len(SCRIPTS))]
            words = ["".join(map(chr, rng.integers(a, z + 1, len(w)))) for w in words]
        out.append(" ".join(words))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 3, rate: float = 2.0, batch: int = 128, seed: int = 7) -> Model | None:
    """Fit on whole texts and on noise made from them; every tenth text only calibrates."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    own = {n: i for i, n in enumerate(names)}
    base = rng.permutation(len(texts))[: max(40, len(texts) // len(names))]
    folded = [fold(t) for t in [*texts, *noise([texts[i] for i in base], rng)]]
    y = np.array([own[x] for x in labels] + [len(names)] * len(base))
    held = np.concatenate([np.arange(n) % 10 == 9 for n in (len(texts), len(base))])
    snippets, target = [], []
    for t, c, h in zip(folded, y, held):
        if not h:
            cuts = [t[a : a + SNIPPET] for a in range(0, max(1, len(t) - SNIPPET // 2), SNIPPET)]
            snippets += cuts
            target += [c] * len(cuts)
    target = np.array(target)
    classes = len(names) + 1
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (classes, DIM)).astype(np.float32), np.zeros(classes, np.float32)
    steps, done = max(1, epochs * -(-len(target) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            n = np.array([len(snippets[i]) for i in pick])
            parts = inner_grams(b"".join([snippets[i] for i in pick]), n)
            count = np.maximum(1, sum(np.maximum(n - k, 0) for k in range(1, 4)))[:, None]
            sums = np.zeros((len(pick), DIM), np.float32)
            for index, across in parts:
                rows = emb[index]
                rows[across] = 0
                sums += np.add.reduceat(rows, np.cumsum(n) - n, axis=0)
            mean = sums / count
            z = mean @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), target[pick]] -= 1
            lr = rate * (1 - done / steps)
            index = np.concatenate([g for g, _ in parts])
            inside = np.ones(len(index), bool)
            for k, (_, across) in enumerate(parts):
                inside[across + k * int(n.sum())] = False
            index, own = index[inside], np.tile(np.repeat(np.arange(len(pick)), n), 3)[inside]
            down = (p @ weights / count * lr).T
            for k in range(DIM):
                emb[:, k] -= np.bincount(index, down[k][own], BUCKETS).astype(np.float32)
            weights -= lr / len(pick) * (p.T @ mean).astype(np.float32)
            bias -= lr / len(pick) * p.sum(axis=0).astype(np.float32)
            done += 1
    model = Model(names, emb @ weights.T, bias)
    check = np.flatnonzero(held)
    if len(check):
        z = model.logits([folded[i] for i in check])
        best = (np.inf, 1.0)
        for t in np.geomspace(0.5, 20, 60):  # on texts without an error the likelihood alone has no bound
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(check)), y[check]]).mean()) + 1e-3 * abs(np.log(t))
            best = min(best, (loss, float(t)))
        model.temperature = best[1]
        _, score = model.predict([folded[i] for i in check])
        clean, other = score[y[check] < len(names)], score[y[check] == len(names)]
        model.floor = float(min(np.quantile(clean, REJECT_SHARE) if len(clean) else 1.0, max(0.5, np.quantile(other, 1 - NOISE_SHARE) if len(other) else 0.0)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_label: int = PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Train on the bounded sample of labelled documents that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= sample_bytes) & (F.octet_length("text") > 0))
    # Of every label the rows whose hash is in its lowest share: about per_label of them, at any number
    # of tasks. Equal rows are one row, so copies of a document cannot crowd the sample.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 40, int((1 << 40) * per_label / n)))))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < share[F.col("lang")])
    rows = picked.groupBy(*picked.columns).agg(F.lit(1)).select(*picked.columns).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    rows = [r for r in rows if _LETTER.search(r["text"])]
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (one struct column ``_doc`` and ``text``) with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in common.slices(batches, "text", 1 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            some = [i for i, t in enumerate(texts) if m is not None and _LETTER.search(t)]
            name, score = ["und"] * len(texts), np.zeros(len(texts))
            if some:
                best, p = m.predict([fold(texts[i]) for i in some])
                for i, k in zip(some, best):
                    name[i] = m.labels[k]
                score[some] = p
            out = np.array([n == "und" for n in name]) | (score < (m.floor if m else 0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(name), pa.array(score), pa.array(out)], [*kept, "lang_pred", "score", "rejected"])

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema if f.name != "text"), *made]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = predict(rows, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with their own columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("text").cast("string").alias("text"))
    return predict(packed, fit(docs)).where("not rejected").select("_doc.*")
