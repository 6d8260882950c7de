"""Quality rules: base counts, and robust multivariate outliers by the minimum covariance determinant.

DataFrame functions only. Per language and source, the statistic vectors' centre and scatter are estimated on the
MCD_SHARE of documents of least distance: concentration steps from several starts (medians and MADs, means and covariances,
and the greatest deviation of any statistic) until no determinant falls any more, then the start of the least
determinant. A document whose squared Mahalanobis distance exceeds CUTOFF is rejected. Groups are only ever aggregated,
so their size does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, release, small_side

_WHITE = r"[\x20\x09-\x0D]+"
_WORDY = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
#: Share of a group's documents that the scatter is estimated on, and the factor that makes it consistent for four
#: normal variables: share / P(chi2 with 6 degrees <= the share's quantile of chi2 with 4).
MCD_SHARE, CONSISTENCY = 0.75, 1.485
#: Starts of the search. Concentration steps never raise a determinant; they end where the logarithms of all fall by less
#: than SETTLED, after STEPS at most.
STARTS, STEPS, SETTLED = 3, 10, 0.01
#: Squared distance beyond which a document is an outlier; chi2 with 4 degrees exceeds it once in 20,000.
CUTOFF = 25.0
#: Statistics and the least standard deviation that each is given, so that a feature that is constant in a group
#: doesn't reject small differences.
FEATURES = {"f_length": 0.08, "f_symbols": 0.5, "f_lines": 0.6, "f_repeats": 0.6}


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) from the whole text; null is empty.

    The repeated three-word windows are found by sorting 64-bit window hashes with their positions and comparing neighbours.
    """
    own = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = own.withColumn("_w", F.filter(F.split("_t", _WHITE), lambda x: x != ""))
    own = own.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(_WORDY)))
    own = own.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", _SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
    })
    keep = [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    own = own.select(*[f"`{c}`" for c in dict.fromkeys(keep)], "_h")
    places = F.transform(F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda x: x["i"])
    own = own.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), places))

    def twice(p: Column, j: Column) -> Column:
        here = F.get("_h", p)
        return here.eqNullSafe(F.get("_h", F.get("_p", j - 1))) | here.eqNullSafe(F.get("_h", F.get("_p", j + 1)))

    own = own.withColumn("_d", F.filter("_p", twice))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_d", lambda p: F.array(p, p + 1, p + 2)))))
    return own.withColumn("n_repeat_words", F.when(F.col("_d").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("_h", "_p", "_d")


def _vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics that the outlier rule looks at."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "f_symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f_lines": F.log1p(100 * F.col("n_dup_lines") / words),
        "f_repeats": F.log1p(100 * F.col("n_repeat_words") / words),
    })


def _square(x: Column) -> Column:
    return x * x


def _estimate(rows: DataFrame) -> DataFrame:
    """Per group and start: the centre, the Cholesky factor and the logarithm of the determinant on the MCD_SHARE of rows of
    least distance. rows has _g, the features and _d2_k for each start k."""
    names, n = list(FEATURES), len(FEATURES)
    share = F.lit(MCD_SHARE)
    limit = small_side(rows.groupBy("_g").agg(*[F.percentile_approx(f"_d2_{k}", share, F.lit(1000)).alias(f"_limit_{k}") for k in range(STARTS)]), "limits")
    core = rows.join(limit, "_g")
    sums = []
    for k in range(STARTS):
        inside = F.col(f"_d2_{k}") <= F.col(f"_limit_{k}")
        sums += [F.avg(F.when(inside, F.col(x))).alias(f"m{k}_{i}") for i, x in enumerate(names)]
        sums += [F.covar_pop(F.when(inside, F.col(x)), F.when(inside, F.col(y))).alias(f"c{k}_{i}{j}") for i, x in enumerate(names) for j, y in enumerate(names) if j <= i]
    found = core.groupBy("_g").agg(*sums)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    for k in range(STARTS):
        found = found.withColumns({f"c{k}_{i}{j}": CONSISTENCY * F.coalesce(f"c{k}_{i}{j}", F.lit(0.0)) + (F.lit(FEATURES[names[i]] ** 2) if i == j else F.lit(0.0)) for i, j in pairs})
    for i, j in pairs:  # one entry at a time, so that no expression repeats another
        step = {}
        for k in range(STARTS):
            rest = F.col(f"c{k}_{i}{j}")
            for m in range(j):
                rest = rest - F.col(f"l{k}_{i}{m}") * F.col(f"l{k}_{j}{m}")
            step[f"l{k}_{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{k}_{j}{j}")
        found = found.withColumns(step)
    logs = [sum((2 * F.log(f"l{k}_{i}{i}") for i in range(n)), F.lit(0.0)).alias(f"det_{k}") for k in range(STARTS)]
    return small_side(found.select("_g", *[f"m{k}_{i}" for k in range(STARTS) for i in range(n)], *[f"l{k}_{i}{j}" for k in range(STARTS) for i, j in pairs], *logs), "estimates")


def _distances(rows: DataFrame, estimate: DataFrame, starts: tuple[str, ...]) -> DataFrame:
    """rows with _d2_k, the squared Mahalanobis distance by each start's estimate, by forward substitution."""
    names = list(FEATURES)
    kept = [c for c in rows.columns if not c.startswith("_d2_")]
    out = rows.select(*kept).join(estimate, "_g", "left")
    for i, x in enumerate(names):
        step = {}
        for k in starts:
            rest = F.col(x) - F.col(f"m{k}_{i}")
            for m in range(i):
                rest = rest - F.col(f"l{k}_{i}{m}") * F.col(f"_z{k}_{m}")
            step[f"_z{k}_{i}"] = rest / F.col(f"l{k}_{i}{i}")
        out = out.withColumns(step)
    return out.select(*kept, *[sum((_square(F.col(f"_z{k}_{i}")) for i in range(len(names))), F.lit(0.0)).alias(f"_d2_{k}") for k in starts])


def _least(estimate: DataFrame) -> DataFrame:
    """The estimate of the least determinant of each group, as start 0; the first of equals."""
    n = len(FEATURES)
    columns = [f"m{{}}_{i}" for i in range(n)] + [f"l{{}}_{i}{j}" for i in range(n) for j in range(i + 1)]
    best = F.least(*[f"det_{k}" for k in range(STARTS)])

    def chosen(name: str):
        out = F.col(name.format(STARTS - 1))
        for k in reversed(range(STARTS - 1)):
            out = F.when(F.col(f"det_{k}") == best, F.col(name.format(k))).otherwise(out)
        return out.alias(name.format(0))

    return estimate.select("_g", *map(chosen, columns))


def _starts(rows: DataFrame) -> DataFrame:
    """rows (_g, features) with the distances of the starts: by medians and MADs, by means and variances, and by the
    greatest deviation of any feature."""
    half = F.lit(0.5)
    stats = [F.percentile_approx(x, half, F.lit(1000)).alias(f"m{i}") for i, x in enumerate(FEATURES)]
    stats += [F.avg(x).alias(f"a{i}") for i, x in enumerate(FEATURES)] + [F.stddev_pop(x).alias(f"v{i}") for i, x in enumerate(FEATURES)]
    centres = small_side(rows.groupBy("_g").agg(*stats), "centres")
    near = rows.join(centres, "_g")
    spread = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), half, F.lit(1000)).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    spread = small_side(near.groupBy("_g").agg(*spread), "spread")
    by = near.join(spread, "_g")
    items = list(enumerate(FEATURES.items()))
    mad = sum((_square((F.col(x) - F.col(f"m{i}")) / (1.4826 * F.col(f"s{i}") + least)) for i, (x, least) in items), F.lit(0.0))
    mean = sum((_square((F.col(x) - F.col(f"a{i}")) / (F.col(f"v{i}") + least)) for i, (x, least) in items), F.lit(0.0))
    inner = F.greatest(*[F.abs(F.col(x) - F.col(f"m{i}")) / (F.col(f"s{i}") + least / 2) for i, (x, least) in items])
    return by.select("_g", *FEATURES, *[d.alias(f"_d2_{k}") for k, d in enumerate((mad, mean, inner))])


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(_g, m0_i, l0_ij): the minimum-covariance-determinant estimate of each group of rows (_g, features)."""
    now, before = materialize(_starts(rows), "distances"), None
    for _ in range(STEPS):
        estimate = _estimate(now)
        total = estimate.select(*[F.sum(f"det_{k}").alias(f"d{k}") for k in range(STARTS)], F.count("*").alias("n")).first()
        after = [total[f"d{k}"] or 0.0 for k in range(STARTS)]
        if before is not None and all(abs(a - b) <= SETTLED for a, b in zip(before, after, strict=True)):
            break
        past, before = now, after
        now = materialize(_distances(now, estimate, tuple(map(str, range(STARTS)))), "distances")
        release(past)
    return small_side(_least(estimate), "estimate")


def quality_rules(docs: DataFrame, *, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept) per row of docs
    (doc_id, text, lang, source; other columns are ignored).

    base_failed: under 50 words, or over half of the words in repeated three-word windows; such rows, null and empty
    texts among them, are not kept and take no part in the estimates (distance2 is null). Null languages and sources are
    groups of their own. A group of one document keeps it. Texts of any length are counted whole.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    group = F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit("\0")), F.coalesce(F.col("source").cast("string"), F.lit("\0")))
    stats = base_counts(docs.select("doc_id", "text", group.alias("_g"))).select("doc_id", "_g", *names)
    stats = stats.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    stats = materialize(_vector(stats), "statistics")
    estimate = robust_estimates(stats.where("not base_failed").select("_g", *FEATURES))
    final = _distances(stats, estimate, ("0",))
    passed = ~F.col("base_failed")
    return final.select("doc_id", *names, "base_failed", F.when(passed, F.col("_d2_0")).alias("distance2"), (passed & F.coalesce(F.col("_d2_0") <= cutoff, F.lit(True))).alias("kept"))
