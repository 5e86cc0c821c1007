"""Quality rules: robust multivariate outliers per language and source.

Method: minimum covariance determinant.  Each text gives a vector of transformed
statistics.  For each (language, source) there are three starts: medians and median
deviations; mean and covariance of all rows; and those of the half that lies in the
smallest box around the medians.  From each, concentration steps take mean and
covariance of the ``SHARE`` rows nearest to the last estimate until no determinant
falls any more, and the start that ends with the least one is the estimate.  The same
is done for each language and for all texts.  A group's centre and precision (inverse
scatter) are a mean of its own and its language's, which leans on all texts in the same
way; the own share is n / (n + ``PRIOR_ROWS``), n being the rows beyond those that a
scatter needs to have full rank.  It grows smoothly, so no size turns one estimate into
another, and a few wild rows can't widen what is above them.  A text whose Mahalanobis distance passes ``CUTOFF`` is rejected.  The vectors are
integers (thousandths), so sums and percentiles are exact, the same for any
partitioning, and combined before the shuffle; a group of any size comes down to one
row for each start, and leaves the rounds once it has settled.  DataFrame functions only.

Results for odd input: a null or empty text has no words and fails the base rules;
a null language or source counts as the empty one; a group of one text is judged
nearly as its language has it; of starts with one determinant the first counts; repeated
rows each have a result; a null id is kept; very long texts are taken whole; an empty
table gives an empty one; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import saved

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: The part of a group's rows that an estimate is taken from, and how its covariance then grows to fit a normal law with four values.
SHARE, CONSISTENCY = 0.75, 1.485
#: Concentration goes on while a determinant's logarithm falls by more than FALL; each step lowers it, and STEPS ends a circle of ties.
FALL, STEPS = 1e-3, 50
#: The starts, in the order in which ties are settled.
STARTS = ("medians", "means", "box")
#: Squared Mahalanobis distance: the chi-square law with four degrees of freedom passes it once in 1e9.
CUTOFF = 50.0
#: A table with a row for each group is broadcast up to this many rows, which are counted first.
BROADCAST_GROUPS = 20_000
#: A ridge: the standard deviation, in thousandths, whose square is added to each value's variance, so that a group of equal rows has an estimate.
FLOORS = (60, 100, 100, 100)
D = len(FLOORS)
#: The rows that the estimate above a group counts for: as many as an estimate has values.
PRIOR_ROWS = D + D * (D + 1) // 2
#: Stands for every source, or every language, in the keys of an estimate above groups; own keys are marked, so that none is taken for it.
EVERY, MARK = "*", "="


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of its whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_t", text)
    out = out.withColumns({
        "_words": F.filter(F.split("_t", SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace("_t", SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    })
    # the windows of one text in order of their hash: equal ones are neighbours
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda j: F.get(F.col("_sorted"), j)["h"]
    repeats = F.filter("_sorted", lambda x, j: F.coalesce(near(j - 1) == x["h"], F.lit(False)) | F.coalesce(near(j + 1) == x["h"], F.lit(False)))
    out = out.withColumn("_at", F.array_sort(F.transform(repeats, lambda x: x["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("_t", "_words", "_lines", "_hashes", "_sorted", "_at")


def vector(stats: DataFrame) -> DataFrame:
    """x0 to x3, in thousandths: log of the mean word length, roots of the shares of symbols, repeated lines and repeated words."""
    part = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), part("n_symbols", "n_words"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"))
    return stats.withColumns({f"x{i}": F.round(v * 1000).cast("long") for i, v in enumerate(values)})


def factor(center: list[Column], cov: dict[tuple[int, int], Column]) -> tuple[dict[str, Column], list[dict[str, Column]]]:
    """Columns of the centre, and then, step by step, of the Cholesky factor of the covariance."""
    steps: list[dict[str, Column]] = []
    for j in range(D):
        inner = cov[j, j]
        for k in range(j):
            inner = inner - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        steps.append({f"l{j}{j}": F.sqrt(F.greatest(inner, F.lit(1.0)))})
        below = {}
        for i in range(j + 1, D):
            inner = cov[i, j]
            for k in range(j):
                inner = inner - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = inner / F.col(f"l{j}{j}")
        if below:
            steps.append(below)
    return {f"m{i}": c for i, c in enumerate(center)}, steps


KEYS = ["_lang", "_source"]
PARAMETERS = [*KEYS, "rows", *(f"m{i}" for i in range(D)), *(f"l{i}{j}" for i in range(D) for j in range(i + 1))]


def with_form(df: DataFrame, low: str = "l") -> tuple[DataFrame, Column]:
    """df with columns for it, and the squared length of x less m by the Cholesky factor whose columns begin with ``low``."""
    for i in range(D):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"{low}{i}{k}") * F.col(f"_y{low}{k}")
        df = df.withColumn(f"_y{low}{i}", y / F.col(f"{low}{i}{i}"))
    return df, sum((F.col(f"_y{low}{i}") * F.col(f"_y{low}{i}") for i in range(1, D)), F.col(f"_y{low}0") * F.col(f"_y{low}0"))


def with_distance(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """vectors with the squared Mahalanobis distance d2 from their group's estimate."""
    out, form = with_form(vectors.join(estimate, KEYS))
    return out.withColumn("d2", form)


def per_group(df: DataFrame) -> DataFrame:
    """df, a row for each group, computed; to be broadcast if it is small, so that a hot group stays where it is."""
    df = saved(df)
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def fitted(rows: DataFrame, consistency: float) -> DataFrame:
    """PARAMETERS, start and the determinant's logarithm of the rows of each group and start, by exact sums."""
    wide = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")  # noqa: E731  sums of any number of rows
    x = [F.col(f"x{i}") for i in range(D)]
    sums = rows.groupBy(*KEYS, "start").agg(F.first("rows").alias("rows"), F.count("*").alias("n"), *(wide(x[i]).alias(f"s{i}") for i in range(D)), *(wide(x[i] * x[j]).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)))
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    cov = {(i, j): (F.col(f"s{i}{j}") / F.col("n") - mean(i) * mean(j)) * consistency + (float(FLOORS[i] ** 2) if i == j else 0.0) for i in range(D) for j in range(i + 1)}
    center, then = factor([mean(i) for i in range(D)], cov)
    out = sums.withColumns(center)
    for columns in then:
        out = out.withColumns(columns)
    return with_determinant(out)


def with_determinant(estimate: DataFrame) -> DataFrame:
    return estimate.select(*PARAMETERS, "start", sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")).alias("det"))


def nearest(rows: DataFrame, share: float, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of each group and start the share of rows with the least step."""
    reach = rows.groupBy(*KEYS, "start").agg(F.percentile("step", F.lit(share)).alias("reach"))
    return rows.join(hint(reach), [*KEYS, "start"]).where(F.col("step") <= F.ceil("reach"))


def started(vectors: DataFrame, starts: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The first estimate of each group for each start, and whether such a table is broadcast: a function that marks it so if its rows, counted here, are few."""
    names = [f"m{i}" for i in range(D)]
    medians = saved(vectors.groupBy(*KEYS).agg(F.count("*").alias("rows"), *(F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(D))))
    hint = F.broadcast if medians.count() * len(starts) <= BROADCAST_GROUPS else lambda df: df
    off = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(D)]
    spread = vectors.join(hint(medians), KEYS).groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in ("rows", *names)), *(F.percentile(off[i], F.lit(0.5)).alias(f"a{i}") for i in range(D)))
    scale = [F.greatest(F.col(f"a{i}") * 1.4826, F.lit(float(FLOORS[i]))) for i in range(D)]
    spread = saved(spread.select(*KEYS, "rows", *names, *(scale[i].alias(f"a{i}") for i in range(D))))
    out = []
    for n, start in enumerate(starts):
        if start == "medians":
            diagonal = [(F.col(f"a{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(D) for j in range(i + 1)]
            out.append(with_determinant(spread.select(*KEYS, "rows", *names, *diagonal, F.lit(n).alias("start"))))
        else:
            step = F.floor(F.greatest(*(off[i] / F.col(f"a{i}") for i in range(D))) * 1000)
            rows = vectors.join(hint(spread), KEYS).withColumns({"start": F.lit(n), "step": step})
            out.append(fitted(rows if start == "means" else nearest(rows, 0.5, hint), 1.0))
    return saved(reduce(DataFrame.union, out)), hint


def estimates(vectors: DataFrame, steps: int = STEPS, starts: tuple[str, ...] = STARTS[:1]) -> DataFrame:
    """A row of PARAMETERS for each group: centre and Cholesky factor of the scatter with the least determinant that the starts lead to."""
    (moving, hint), group, ended = started(vectors, starts), [*KEYS, "start"], []
    for _ in range(steps):
        far = with_distance(vectors, hint(moving)).withColumn("step", F.floor(F.log1p("d2") * 1000))
        after = fitted(nearest(far, SHARE, hint), CONSISTENCY).join(hint(moving.select(*group, F.col("det").alias("_before"))), group)
        after = saved(after.withColumn("_moves", F.abs(F.col("_before") - F.col("det")) > FALL).drop("_before"))
        ended.append(after.where(~F.col("_moves")).drop("_moves"))
        moving = after.where("_moves").drop("_moves")
        if moving.isEmpty():
            break
    found = saved(reduce(DataFrame.union, [*ended, moving]))
    best = found.groupBy(*KEYS).agg(F.min(F.struct("det", "start")).alias("best")).select(*KEYS, "best.start")
    return saved(found.join(hint(best), group).select(*PARAMETERS))


def with_pools(vectors: DataFrame) -> DataFrame:
    """Each vector three times: under its marked keys, under its language and under all texts."""
    lang, source = (F.concat(F.lit(MARK), F.col(k)) for k in KEYS)
    keys = lambda *of: F.struct(*(c.alias(k) for c, k in zip(of, KEYS)))
    return vectors.select(F.inline(F.array(keys(lang, source), keys(lang, F.lit(EVERY)), keys(F.lit(EVERY), F.lit(EVERY)))), *(f"x{i}" for i in range(D)))


def share_of(rows: Column, prior: float) -> Column:
    """What a group's own estimate counts for."""
    beyond = F.greatest(rows - (D + 1), F.lit(0))
    return beyond / (beyond + prior)


def every_estimate(vectors: DataFrame, prior: float = PRIOR_ROWS) -> DataFrame:
    """A row for each group: its centre m, and three Cholesky factors (own, lang and every) with the weights of their precisions."""
    found = estimates(with_pools(vectors), starts=STARTS)
    every = F.col(KEYS[0]) == EVERY
    named = lambda df, name, *keys: df.select(*keys, F.col("rows").alias(f"{name}n"), *(F.col(c).alias(f"{name}{c[1:]}" if c[0] == "l" else f"{name}{c}") for c in PARAMETERS[len(KEYS) + 1 :]))
    own = named(found.where(F.col(KEYS[1]) != EVERY), "own", *KEYS)
    langs = named(found.where(~every & (F.col(KEYS[1]) == EVERY)), "lang", KEYS[0])
    whole = named(found.where(every), "every", F.lit(EVERY).alias("_every"))
    out = own.join(per_group(langs), KEYS[0]).withColumn("_every", F.lit(EVERY)).join(F.broadcast(whole), "_every")  # one row
    first, second = share_of(F.col("ownn"), prior), share_of(F.col("langn"), prior)
    weights = {"own": first, "lang": (1 - first) * second, "every": (1 - first) * (1 - second)}
    centre = {f"m{i}": sum((w * F.col(f"{name}m{i}") for name, w in weights.items()), F.lit(0.0)) for i in range(D)}
    out = out.withColumns(centre | {f"{name}w": w for name, w in weights.items()})
    keys = [F.expr(f"substr({k}, {len(MARK) + 1})").alias(k) for k in KEYS]
    return out.select(*keys, *centre, *(f"{name}{c}" for name in weights for c in ("w", *(f"{i}{j}" for i in range(D) for j in range(i + 1)))))


def quality_rules(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",), prior: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """The columns ``keep`` of df with its statistics, base_failed, distance2 (null only where the base rules leave no text of its group) and kept."""
    own = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), F.col(text_col).alias("_text"))
    stats = statistics(own, "_text").drop("_text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    vectors = saved(vector(stats.withColumn("base_failed", failed)))
    passed = vectors.where(~F.col("base_failed")).select(*KEYS, *(f"x{i}" for i in range(D)))
    judged, d2 = vectors.join(per_group(every_estimate(passed, prior)), KEYS, "left"), F.lit(0.0)
    for name in ("own", "lang", "every"):
        judged, form = with_form(judged, name)
        d2 = d2 + F.col(f"{name}w") * form
    judged = judged.withColumn("d2", d2)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("d2", 3).alias("distance2"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
