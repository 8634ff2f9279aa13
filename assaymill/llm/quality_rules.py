"""Quality rules: Gopher-style counts, then robust multivariate outliers by minimum covariance determinant.

The counts of a text become a vector of four transformed statistics. Per cell (language and source)
the location and scatter of the half of the rows that lie closest together are estimated by
STEPS concentration steps from the coordinatewise median and MAD; of a cell's steps the one with the
least determinant of the scatter counts. It is reweighted once, and a row whose squared Mahalanobis
distance exceeds the chi-square ``quantile`` is rejected.

A concentration step is one aggregation: rows fall into narrow bins of the logarithm of their
distance, counts and moments are summed per cell and bin, and the cell keeps whole bins until its
share of rows is reached. So no group is sorted or gathered, however many rows a cell holds.
Statistics are whole multiples of 1/1024, which makes the sums exact in any order.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaymill.storage import lookup, materialize

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SCALE = 1024
P = 4
#: Least standard deviation of each statistic: none is so regular that smaller deviations count.
FLOOR = (0.10, 0.30, 0.15, 0.10)
BINS = 32
STEPS = 6
RAW_SHARE, CUT = 0.5, 0.975


def chi_square(x: float, even: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, even // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_quantile(q: float, even: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, even) < q else (low, mid)
    return low


def consistency(share: float) -> float:
    """Factor that makes the scatter of the innermost ``share`` consistent under normality."""
    return share / chi_square(chi_square_quantile(share, P), P + 2)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of the whole text (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(F.col("_text"), F.lit(SPACES))
    out = docs.withColumn("_text", text).withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)))
    n = F.size("_words")
    spans = F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(8))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumns({"_spans": spans, "_lines": lines})
    pairs = F.sort_array(F.transform("_spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), F.isnotnull))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda x, j: F.least(F.lit(8), F.coalesce(F.get(starts, j + 1) - x, F.lit(8)))), F.lit(0), lambda a, b: a + b)

    # One-element arrays bind a value once; named columns could be inlined into the lambdas and computed per element.
    found = F.transform(F.transform(F.array(pairs), repeated), covered)[0]
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_spans")) == F.size("_spans"), F.lit(0)).otherwise(found).cast("long"),
    })
    return out.drop("_text", "_words", "_spans", "_lines")


def statistics() -> list[Column]:
    """The transformed statistics as whole multiples of 1/SCALE; only for rows with a word."""
    per_word = F.ln(F.col("word_chars") / F.col("n_words"))
    symbols = F.ln(1 + 100 * F.col("n_symbols") / F.col("word_chars"))
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeats = F.col("n_repeat_words") / F.col("n_words")
    return [F.round(x * SCALE).cast("double") for x in (per_word, symbols, lines, repeats)]


def _median(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """Lower median of each value per cell, from counts of equal values."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), v.alias("v")) for j, v in enumerate(values)]))
    counts = rows.select("cell", each.alias("e")).groupBy("cell", "e.j", "e.v").count()
    w = Window.partitionBy("cell", "j")
    upto = F.sum("count").over(w.orderBy("v"))
    middle = counts.withColumns({"upto": upto, "all": F.sum("count").over(w)}).where(2 * F.col("upto") >= F.col("all")).groupBy("cell", "j").agg(F.min("v").alias("v"))
    return middle.groupBy("cell").agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(n) for j, n in enumerate(names)])


def _root(cells: DataFrame, factor: float) -> DataFrame:
    """(cell, n, s*, ss*) moments to (cell, m*, l*): mean and Cholesky root of the scatter, times ``factor``, plus the floors."""
    out = cells.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    for i in range(P):
        for j in range(i + 1):
            cov = factor * (F.col(f"ss{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + (FLOOR[i] * SCALE) ** 2
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1.0))) if i == j else cov / F.col(f"l{j}{j}"))
    return out.select("cell", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def _distance(rows: DataFrame, estimates: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance from their cell's estimate; null without one."""
    out = lookup(rows, estimates.join(sizes, "cell"), ["cell"], "cell_rows")
    for i in range(P):
        z = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return out.select(*rows.columns, sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)).alias("d2"))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"ss{i}{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.count("*").cast("double").alias("n"), *sums, *products)


def robust_outliers(rows: DataFrame, quantile: float = 0.9999, min_rows: int = 50) -> DataFrame:
    """``rows`` (gid, lid, use, x0..x3) with ``d2``: squared distance from the robust estimate of the row's cell.

    ``gid`` names the finest cell and ``lid`` the coarser one around it; a cell is used where it has
    ``min_rows`` rows, then the coarser one, then all rows together. Only rows with ``use`` shape the
    estimates. ``d2`` is null where even all rows are too few.
    """
    fine = rows.where("use").groupBy("gid", "lid").agg(F.count("*").alias("fine"))
    fine = fine.withColumns({"coarse": F.sum("fine").over(Window.partitionBy("lid"))})
    total = rows.where("use").count()
    cell = F.when(F.col("fine") >= min_rows, F.col("gid")).when(F.col("coarse") >= min_rows, F.col("lid")).when(F.lit(total >= min_rows), F.lit(0))
    fine = materialize(fine.withColumn("cell", cell), "cells")
    rows = materialize(lookup(rows, fine.select("gid", "cell", "fine"), ["gid"], "fine"), "vectors")
    inner = rows.where("use and cell is not null")
    sizes = materialize(inner.groupBy("cell").agg(F.count("*").alias("cell_rows")), "sizes")
    x = [F.col(f"x{i}") for i in range(P)]
    middle = materialize(_median(inner, x, [f"m{i}" for i in range(P)]), "medians")
    away = lookup(inner, middle.join(sizes, "cell"), ["cell"], "cell_rows")
    spread = _median(away, [F.abs(x[i] - F.col(f"m{i}")) for i in range(P)], [f"d{i}" for i in range(P)])
    estimate = middle.join(spread, "cell").withColumns({f"l{i}{j}": F.sqrt((F.col(f"d{i}") * 1.4826) ** 2 + (FLOOR[i] * SCALE) ** 2) if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)})
    estimate = materialize(estimate.drop(*[f"d{i}" for i in range(P)]), "estimate")
    names = ["n", *[f"s{i}" for i in range(P)], *[f"ss{i}{j}" for i in range(P) for j in range(i + 1)]]
    steps = []
    for step in range(STEPS):
        bins = _distance(inner, estimate, sizes).withColumn("bin", F.floor(BINS * F.ln(F.col("d2") + 1e-6)))
        bins = _moments(bins, "cell", "bin")
        w = Window.partitionBy("cell")
        bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
        kept = bins.where(F.col("upto") - F.col("n") < RAW_SHARE * F.col("all")).groupBy("cell").agg(*[F.sum(c).alias(c) for c in names])
        estimate = materialize(_root(kept, consistency(RAW_SHARE)), "estimate")
        # The determinant of the scatter is the squared product of its root's diagonal; equal ones go to the earlier step.
        root = sum(F.ln(f"l{i}{i}") for i in range(P))
        steps.append(estimate.withColumn("rank", F.struct(F.round(root, 6).alias("root"), F.lit(step).alias("step"))))
    value = [c for c in estimate.columns if c != "cell"]
    least = reduce(DataFrame.union, steps).groupBy("cell").agg(F.min_by(F.struct(*value), "rank").alias("e"))
    estimate = materialize(least.select("cell", "e.*"), "estimate")
    good = _distance(inner, estimate, sizes).where(F.col("d2") <= chi_square_quantile(CUT, P))
    estimate = materialize(_root(_moments(good, "cell"), consistency(CUT)), "estimate")
    return _distance(rows, estimate, sizes).withColumn("outlier", F.coalesce(F.col("d2") > chi_square_quantile(quantile, P), F.lit(False)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = 0.9999, min_rows: int = 50) -> DataFrame:
    """Counts and verdicts of every row: ``doc_id``, the counts, ``base_failed, kept, distance``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word windows. ``kept`` is
    false then, and for outliers of the row's language and source (null is a value of its own); cells of
    under ``min_rows`` rows borrow their language's estimate, then the whole table's, and with fewer
    rows in all nothing is an outlier. Null text counts as empty. Repeated rows each get their row.
    Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lid = F.xxhash64(F.lit("lang"), F.col("lang"), F.col("lang").isNull())
    gid = F.xxhash64(F.lit("cell"), F.col("lang"), F.col("lang").isNull(), F.col("source"), F.col("source").isNull())
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = word_counts(docs).select("doc_id", *counts, gid.alias("gid"), lid.alias("lid"), base.alias("base_failed"), (~base).alias("use"), *[F.when(F.col("n_words") > 0, x).alias(f"x{i}") for i, x in enumerate(statistics())])
    rows = materialize(rows, "statistics")
    out = robust_outliers(rows, quantile, min_rows)
    return out.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), F.sqrt("d2").alias("distance"))
