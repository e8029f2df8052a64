"""Robust multivariate quality rules with DataFrame functions only.

Base statistics of every whole text give a vector of five transformed values. Per language and
source a deterministic minimum-covariance-determinant estimate is fitted: vectors are centred and
scaled by median and absolute deviation, two starts (unit scatter, scatter of tanh scores) each
take concentration steps onto the ``share`` of rows with the least distance, and the start with the
smaller determinant wins. Documents whose squared Mahalanobis distance is beyond the chi-square
quantile are rejected.

Groups of every size are estimated alike: a group's medians, deviations and moments count with its
rows, those of its language with ``PRIOR`` rows more, which in turn count those of all languages together
with ``PRIOR`` rows (and these, for the moments, a unit normal distribution). A source of ten documents is judged mostly by
its language, one of ten thousand by itself, and nothing changes at a size.

Every quantile comes from counts on a fixed grid, so it covers all rows, is the same at every
partitioning and needs no more than a partial count per task; groups of any size (a third of all
rows) only send sums.

Constants: ``RIDGE`` is the variance, in units of the scales, that every value has besides its
scatter (so that a constant value, such as no repeated lines, keeps a spread); it is added after the
scatter of the closest share is made consistent. ``TAIL`` is the share of a normal distribution that
the cut rejects: far smaller than usual, since text statistics have heavier tails than that.

Defined results: null or empty text has no words and fails the base rules; null lang and source are
groups of their own; repeated rows are judged alike; an empty table gives no rows; columns of other
names, clashing ones included, are not looked at."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

P = 5
STEPS = 4
SHARE = 0.75
PRIOR = 100
TAIL = 1e-9
GRID = 0.01
STEP = 0.005
#: Smallest scale of each value: below it, differences say nothing about quality.
FLOORS = (0.5, 0.1, 0.15, 0.15, 0.15)
RIDGE = 0.3
SYMBOLS = "#*$%&|<>"
_WS = "[ \\t-\\r]+"


def _gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(p / 2, mid / 2) < q else (lo, mid)
    return lo


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_columns(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def repeated(ws: Column) -> Column:
        def covered(hs: Column) -> Column:
            pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def of_pairs(ps: Column) -> Column:
                same = lambda x, j: F.coalesce(F.get(ps, j)["h"] == x["h"], F.lit(False))
                starts = F.sort_array(F.transform(F.filter(ps, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
                first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
                step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
                return F.aggregate(starts, first, step)["n"]

            return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(_let(pairs, of_pairs))

        n = F.size(ws)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(hashes, covered))

    trimmed = F.btrim(text, F.lit(common.SPACE))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS))
    lines = F.filter(F.split(text, "\\n"), lambda x: F.length(F.btrim(x, F.lit(common.SPACE))) > 0)
    symbols = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s))) for s in SYMBOLS), F.lit(0)).cast("long")
    of_words = _let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated(ws).alias("n_repeat_words")))
    of_lines = _let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The base statistics and verdict of every document, its group ``g`` (language and source), the
    group's language ``p``, and the vector x0..x4; one narrow pass."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    df = docs.select(*keep, F.concat(name("lang"), F.lit("\x01"), name("source")).alias("g"), name("lang").alias("p"), base_columns(F.col("text")).alias("_b"))
    df = df.select(*keep, "g", "p", "_b.w.n_words", "_b.w.word_chars", "_b.n_symbols", "_b.l.n_dup_lines", "_b.w.n_repeat_words", "_b.l.n_lines")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    values = [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))]
    return df.select("*", *(v.cast("double").alias(f"x{i}") for i, v in enumerate(values)))


_IJ = [(i, j) for i in range(P) for j in range(i + 1)]
_L = [f"l_{i}_{j}" for i, j in _IJ]
_M = [f"m{i}" for i in range(P)]
_Z = [f"z{i}" for i in range(P)]
#: A normal distribution is this much wider than its share closest to the centre.
FACTOR = SHARE / _gamma_p((P + 2) / 2, chi2_quantile(SHARE, P) / 2)


def _cut(cells: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Per key, of (keys, cell, n) the cell in which the quantile lies, with ``upto`` and ``all`` counts."""
    w = Window.partitionBy(*keys)
    cells = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    return cells.where((F.col("upto") >= q * F.col("all")) & (F.col("upto") - F.col("n") < q * F.col("all")))


def _median(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """(g, name0, name1, ...): per group the medians of the values, pulled to those of its language, and
    these to the mean over languages. A median lies within its cell of width ``GRID`` as if the cell
    were evenly filled."""
    tall = rows.select("g", "p", F.posexplode(F.array(*values)).alias("i", "v"))
    cells = tall.groupBy("g", "p", "i", F.floor(F.col("v") / GRID).alias("cell")).agg(F.count("*").alias("n"))

    def level(keys: list[str], tag: str) -> DataFrame:
        summed = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
        inside = (0.5 * F.col("all") - F.col("upto") + F.col("n")) / F.col("n")
        return _cut(summed, keys, 0.5).select(*keys, ((F.col("cell") + inside) * GRID).alias(f"v_{tag}"), F.col("all").alias(f"n_{tag}"))

    every = Window.partitionBy("i")  # one row a language
    mean = F.sum(F.col("n_p") * F.col("v_p")).over(every) / F.sum("n_p").over(every)
    langs = level(["p", "i"], "p").select("p", "i", ((F.col("n_p") * F.col("v_p") + PRIOR * mean) / (F.col("n_p") + PRIOR)).alias("of_p"))
    df = level(["g", "p", "i"], "g").join(langs, ["p", "i"])
    of_g = F.round((F.col("n_g") * F.col("v_g") + PRIOR * F.col("of_p")) / (F.col("n_g") + PRIOR), 9)
    return df.groupBy("g").agg(*(F.max(F.when(F.col("i") == i, of_g)).alias(f"{name}{i}") for i in range(P)))


def _moments(rows: DataFrame, values: list[str], start: Column) -> DataFrame:
    """(g, start, m_i, c_i_j): mean and covariance of each group's rows, with those of its language and of
    all rows at the weight of ``PRIOR`` rows. Rounded, so that the order of additions does not show."""
    names = ["n", *(f"s{i}" for i in range(P)), *(f"q_{i}_{j}" for i, j in _IJ)]
    terms = [F.lit(1.0), *(F.col(v) for v in values), *(F.col(values[i]) * F.col(values[j]) for i, j in _IJ)]
    unit = [1.0, *[0.0] * P, *(1.0 if i == j else 0.0 for i, j in _IJ)]
    own = rows.select("g", "p", start.alias("start"), *(t.alias(k) for k, t in zip(names, terms))).groupBy("g", "p", "start").agg(*(F.sum(k).alias(k) for k in names))
    langs = own.groupBy("p", "start").agg(*(F.sum(k).alias(k) for k in names))
    every = Window.partitionBy("start")  # one row a language
    langs = langs.select("*", *(F.sum(k).over(every).alias(f"all_{k}") for k in names))

    def pulled(value: Column, n: str, to: Column) -> Column:
        return (value + PRIOR * to) / (F.col(n) + PRIOR)

    langs = langs.select("p", "start", *(pulled(F.col(k), "n", pulled(F.col(f"all_{k}"), "all_n", F.lit(u))).alias(f"_{k}") for k, u in zip(names, unit)))
    df = own.join(langs, ["p", "start"]).select("g", "start", *(pulled(F.col(k), "n", F.col(f"_{k}")).alias(k) for k in names[1:]))
    r = lambda c: F.round(c, 9)
    return df.select("g", "start", *(r(F.col(f"s{i}")).alias(f"m{i}") for i in range(P)), *(r(F.col(f"q_{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c_{i}_{j}") for i, j in _IJ))


def _cholesky(df: DataFrame, factor: float) -> DataFrame:
    """(g, start, m_i, l_i_j, logdet): the lower factor of c_i_j / factor plus the ridge. Columns refer to
    those before them in the one projection."""
    factors = []
    for i, j in _IJ:
        v = F.col(f"c_{i}_{j}") / factor + F.lit(RIDGE if i == j else 0.0)
        for k in range(j):
            v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        factors.append((F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
    return df.select("g", "start", *_M, *factors, sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(P)), F.lit(0.0)).alias("logdet"))


def _distance(df: DataFrame, keep: list[str]) -> DataFrame:
    """d2 of z against m and l by forward substitution, in one projection."""
    steps = []
    for i in range(P):
        v = F.col(f"z{i}") - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l_{i}_{j}") * F.col(f"y{j}")
        steps.append((v / F.col(f"l_{i}_{i}")).alias(f"y{i}"))
    return df.select(*keep, *steps, sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0)).alias("d2")).drop(*(f"y{i}" for i in range(P)))


def _scores(df: DataFrame) -> list[Column]:
    return [((F.col(f"x{i}") - F.col(f"b{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)]


def fit(stats: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """One row per group with survivors of the base rules: its centre and scale (b_i, s_i) and its
    estimate (m_i, l_i_j) in those units. ``stats`` should be a written table: it is read three times,
    and the scores of its rows twice a step."""
    rows = stats.where(~F.col("base_failed")).select("g", "p", *(f"x{i}" for i in range(P)))
    mid = common.materialize(_median(rows, [F.col(f"x{i}") for i in range(P)], "b"), "mcd-centre")
    groups = mid.count()
    away = rows.join(mid, "g")
    dev = _median(away, [F.abs(F.col(f"x{i}") - F.col(f"b{i}")) for i in range(P)], "d")
    scale = mid.join(dev, "g").select("g", *(f"b{i}" for i in range(P)), *(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(f)).alias(f"s{i}") for i, f in enumerate(FLOORS)))
    scale = common.materialize(scale, "mcd-scale", groups)
    z = common.materialize(rows.join(scale, "g").select("g", "p", *_scores(rows)), "mcd-z")
    # Starts: unit scatter, and the correlation of tanh scores.
    tanh = _moments(z.select("g", "p", *(F.tanh(k).alias(k) for k in _Z)), _Z, F.lit(1))
    cor = {(i, j): F.lit(1.0) if i == j else F.col(f"c_{i}_{j}") / F.sqrt(F.greatest(F.col(f"c_{i}_{i}") * F.col(f"c_{j}_{j}"), F.lit(1e-6))) for i, j in _IJ}
    unit = {(i, j): F.lit(1.0 if i == j else 0.0) for i, j in _IJ}
    both = tanh.select("g", F.explode(F.array(*(F.struct(F.lit(k).alias("start"), *(c.alias(f"c_{i}_{j}") for (i, j), c in cov.items())) for k, cov in enumerate((unit, cor))))).alias("e"))
    est = common.materialize(_cholesky(both.select("g", "e.*", *(F.lit(0.0).alias(m) for m in _M)), 1.0), "mcd-start", 2 * groups)
    for _ in range(steps):
        d = _distance(z.join(est, "g"), ["g", "p", "start", *_Z]).withColumn("cell", F.floor(F.log1p("d2") / STEP))
        cells = d.groupBy("g", "start", "cell").agg(F.count("*").alias("n"))
        cut = common.materialize(_cut(cells, ["g", "start"], share).select("g", "start", F.col("cell").alias("last")), "mcd-cut", 2 * groups)
        inside = d.join(cut, ["g", "start"]).where("cell <= last")
        est = common.materialize(_cholesky(_moments(inside, _Z, F.col("start")), FACTOR), "mcd-step", 2 * groups)
    best = est.groupBy("g").agg(F.min_by(F.struct(*_M, *_L), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    return common.materialize(scale.join(best, "g"), "mcd-estimate", groups)


def judge(stats: DataFrame, estimate: DataFrame, tail: float = TAIL) -> DataFrame:
    """``stats`` with d2 (squared distance, null where the whole group failed the base rules) and kept."""
    limit = chi2_quantile(1 - tail, P)
    df = stats.join(estimate, "g", "left").select(*stats.columns, *_scores(stats), *_M, *_L)
    df = _distance(df, stats.columns).withColumn("d2", F.round("d2", 6))
    return df.select(*stats.columns, "d2", (~F.col("base_failed") & ~F.coalesce(F.col("d2") > limit, F.lit(False))).alias("kept"))


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed, d2 and kept of every document."""
    stats = common.materialize(statistics(docs), "mcd-statistics")
    out = judge(stats, fit(stats))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Documents and statistics are written side by
    side: the estimate reads the statistics alone, and the verdict needs neither a key nor a shuffle."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *(F.col(c) for c in ("text", "lang", "source")))
    stats = common.materialize(statistics(packed, ("_doc",)), "mcd-statistics")
    return judge(stats, fit(stats)).where("kept").select("_doc.*")
