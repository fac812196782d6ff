"""Operator 10: quality rules and robust multivariate outliers. DataFrame functions only.

Base rules: a text fails with under 50 words, or with over half of its words in 3-word windows found twice or more.

The method: each text's statistics become a vector (mean word length, log symbols per 100 words, share of repeated lines,
share of repeated words).  For each language and source a minimum-covariance-determinant estimate of its centre and
covariance comes from the texts that pass the base rules.  Several starts are tried in each group: the medians with the scaled absolute
deviations, and ``RANDOM_STARTS`` sets of ``P + 1`` texts picked by seeded hashes of their vectors.  A concentration step takes the 75 %
nearest by Mahalanobis distance and works out their mean and covariance; ``FIRST_STEPS`` of them go from every start, then the
``KEPT_STARTS`` with the least determinants go on until none falls any more, and the least of all is the estimate (at most ``MOST_STEPS`` steps, a bound on rounds, not on texts).  Every step reads
all vectors.  A text beyond ``CUTOFF`` is rejected.

Groups with fewer than ``LEAST`` texts are pooled by language, and pools that are still smaller together; where even that
is smaller, nothing is rejected.  ``FLOOR`` is a least variance for each statistic, without which statistics that are
zero in almost all texts would make every other text an outlier.

A text's vector is never shuffled by its group while there are ``BROADCAST_GROUPS`` groups at most: the groups' estimates (about 200 bytes
each) are broadcast, and sums and quantile sketches are combined before the shuffle, so a source with a third of all texts is as many
rows as any other.  With more groups, texts and estimates meet by group and one of ``SALTS`` salts.

Windows are compared by 64-bit hashes of their three words.

Edge cases: null, empty and blank texts have zero counts and fail the base rules; null languages and sources are groups of
their own; repeated rows are judged each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACE_CLASS, WORD, Scratch, materialised

LEAST_WORDS, MOST_REPEATED = 50, 50
NAMES = ("word_length", "symbols", "dup_lines", "repeats")
FLOOR = (0.25**2, 0.25**2, 0.1**2, 0.06**2)
LEAST, SHARE, RANDOM_STARTS, FIRST_STEPS, KEPT_STARTS, MOST_STEPS, FALLS = 50, 0.75, 10, 2, 3, 20, 1e-9
BROADCAST_GROUPS, SALTS = 50_000, 32
P = len(NAMES)


def _chi2(x: float, df: int) -> float:
    """Distribution function of chi-square for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, df) < q else (lo, mid)
    return lo


#: Makes the half-sample's covariance that of the whole, for normal data.
CONSISTENT = SHARE / _chi2(_chi2_quantile(SHARE, P), P + 2)
#: Squared distance beyond which a text is rejected: the point that one in a hundred million normal texts exceeds.
CUTOFF = _chi2_quantile(1 - 1e-8, P)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more: sort the windows' hashes with their places, keep those equal
    to a neighbour, and count the words that they cover."""

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == F.get(s, j)["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda j: F.sequence(F.get(s, j)["i"], F.get(s, j)["i"] + 2)))))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(F.sort_array(hashes), covered))

    return _let(words, windows)


def text_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Per row: id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split("text", SPACE_CLASS), lambda w: w != "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    lined = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    spaces, symbols = F.length(F.regexp_replace("text", WORD, "")), F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))
    out = read.select("id", "lang", "source", counted.alias("c"), lined.alias("l"), (F.length("text") - spaces).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"))
    return out.select("id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "l.n_lines", "c.n_repeat_words")


def _factored(estimate: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l00, l10, l11, ... of s00, s10, s11, ... and the log determinant, column by column, so that a vector meets
    numbers that are worked out once for its group."""
    for j in range(P):
        rest = lambda i, j=j: sum((-F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.col(f"s{i}{j}"))
        estimate = estimate.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-12))))
        estimate = estimate.withColumns({f"l{i}{j}": rest(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return estimate.withColumn("determinant", 2 * sum((F.ln(f"l{j}{j}") for j in range(1, P)), F.ln("l00")))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the factor l00, l10, l11, ..."""
    solved: list = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    total = F.pow(solved[0], F.lit(2))
    for z in solved[1:]:
        total = total + F.pow(z, F.lit(2))
    return total


def _moments(near: DataFrame) -> DataFrame:
    """Centre, covariance (with the floor) and log determinant of each group and start; moments are about the former centre, so that no
    digits go.  With a floor on the variances a concentration step still never raises the determinant, as it is the same for all sets."""
    about = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    sums = [F.avg(a).alias(f"a{i}") for i, a in enumerate(about)] + [F.avg(about[i] * about[j]).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)] + [F.first(f"m{i}").alias(f"o{i}") for i in range(P)]
    cov = [(F.lit(CONSISTENT) * (F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) + F.lit(FLOOR[i] if i == j else 0.0)).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    out = near.groupBy("group", "start").agg(*sums).select("group", "start", *((F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(P)), *cov)
    return _factored(out)


def _starts(vectors: DataFrame, number: int) -> DataFrame:
    """Of each group the starts (start, m0.., s00..): 0 by medians and deviations, then sets of texts by hashes.  A set takes the vector with the
    least hash in each of ``P + 1`` parts of the hashes, so partial minima are shuffled and equal vectors count once."""
    middle = vectors.groupBy("group").agg(*(F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in range(P)))
    away = beside(vectors, middle, ["group"], number).groupBy("group").agg(*(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i in range(P)))
    spread = [F.lit(0.0).alias(f"s{i}{j}") if i != j else (F.col(f"d{i}") * F.col(f"d{i}") * F.lit(1.4826**2) + F.lit(FLOOR[i])).alias(f"s{i}{i}") for i in range(P) for j in range(i + 1)]
    out = middle.join(away, "group").select("group", F.lit(0).alias("start"), *(f"m{i}" for i in range(P)), *spread)

    hashes = {start: F.xxhash64(*(f"x{i}" for i in range(P)), F.lit(start)) for start in range(1, RANDOM_STARTS + 1)}
    least = [F.min(F.when(F.pmod(h, F.lit(P + 1)) == part, F.struct(h.alias("h"), *(F.col(f"x{i}") for i in range(P))))).alias(f"p{start}_{part}") for start, h in hashes.items() for part in range(P + 1)]
    picked = vectors.groupBy("group").agg(*least)
    sets = [F.struct(F.lit(start).alias("start"), F.filter(F.array(*(f"p{start}_{part}" for part in range(P + 1))), lambda x: x.isNotNull()).alias("set")) for start in hashes]
    total = lambda value: F.aggregate("set", F.lit(0.0), lambda acc, x: acc + value(x)) / F.size("set")
    rows = picked.select("group", F.explode(F.array(*sets)).alias("s")).select("group", "s.start", "s.set")
    rows = rows.select("*", *(total(lambda x, i=i: x[f"x{i}"]).alias(f"m{i}") for i in range(P)))
    about = lambda x, i: x[f"x{i}"] - F.col(f"m{i}")
    cov = [(total(lambda x, i=i, j=j: about(x, i) * about(x, j)) + F.lit(FLOOR[i] if i == j else 0.0)).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    return _factored(out.unionByName(rows.select("group", "start", *(f"m{i}" for i in range(P)), *cov)))


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], number: int, how: str = "inner", most: int = BROADCAST_GROUPS) -> DataFrame:
    """The rows with the columns of their group (``number`` rows, nulls are equal); the rows stay where they are, or are salted."""
    named = groups.toDF(*(f"{c}_" if c in keys else c for c in groups.columns))
    if number > most:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(P))), F.lit(SALTS)))
        named = named.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = [*keys, "salt"]
    else:
        named = F.broadcast(named)
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}_"))
        on = same if on is None else on & same
    return rows.join(named, on, how).drop(*(f"{k}_" for k in keys), *(["salt"] if "salt" in keys else []))


def _concentrated(vectors: DataFrame, estimate: DataFrame, number: int) -> DataFrame:
    """One concentration step of each group and start."""
    far = beside(vectors, estimate, ["group"], number).withColumn("far", _distance())
    bound = far.groupBy("group", "start").agg(F.percentile_approx("far", SHARE, 10_000).alias("bound"))
    return _moments(beside(far, bound, ["group", "start"], number).where("far <= bound"))


def robust_estimates(vectors: DataFrame, number: int) -> DataFrame:
    """Per group: m0.., s00.., their factor l00.. and log determinant of its minimum-covariance-determinant estimate, from (group, x0, ...) of ``number`` groups."""
    scratch = Scratch(vectors.sparkSession)
    names = ["start", *(f"m{i}" for i in range(P)), *(f"{c}{i}{j}" for c in "sl" for i in range(P) for j in range(i + 1)), "determinant"]
    estimate = scratch.write(_starts(vectors, number), "mcd-start")
    for step in range(FIRST_STEPS):
        estimate = scratch.write(_concentrated(vectors, estimate, number * (RANDOM_STARTS + 1)), f"mcd-first-{step}")
        scratch.clear(keep=1)
    place = F.row_number().over(Window.partitionBy("group").orderBy("determinant", "start"))
    best = estimate.withColumns({"place": place, "falls": F.lit(True)}).where(F.col("place") <= KEPT_STARTS).drop("place")
    best = scratch.write(best, "mcd-best")
    scratch.clear(keep=1)
    for step in range(MOST_STEPS):
        new = _concentrated(vectors, best.drop("determinant", "falls"), number * KEPT_STARTS).select("group", "start", F.struct(*names).alias("n"))
        both = best.join(new, ["group", "start"])
        fallen = F.col("n.determinant") < F.col("determinant") - FALLS
        best = scratch.write(both.select("group", *(F.when(fallen, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in names), fallen.alias("falls")), f"mcd-{step}")
        scratch.clear(keep=1)
        if best.where("falls").isEmpty():
            break
    return best.groupBy("group").agg(F.min_by(F.struct(*names[1:]), F.struct("determinant", "start")).alias("b")).select("group", "b.*")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    stats = text_statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    n, lines = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("n_lines", F.lit(1))
    vector = (F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n), F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n)
    stats = materialised(stats.select("*", failed.alias("base_failed"), *(v.alias(f"x{i}") for i, v in enumerate(vector))), "statistics")

    passed = stats.where("not base_failed")
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("k"))
    by_lang = sizes.where(F.col("k") < LEAST).groupBy("lang").agg(F.sum("k").alias("pool"))
    on = F.col("s.lang").eqNullSafe(F.col("p.lang"))
    name = lambda *c: F.to_json(F.array(*c), {"ignoreNullFields": "false"})
    group = F.when(F.col("k") >= LEAST, name("s.lang", "s.source")).when(F.col("pool") >= LEAST, name("s.lang")).otherwise("[]")
    groups = materialised(sizes.alias("s").join(by_lang.alias("p"), on, "left").select("s.lang", "s.source", group.alias("group"), "k"), "groups")
    large = groups.groupBy("group").agg(F.sum("k").alias("total")).where(F.col("total") >= LEAST).select("group")
    number = groups.count()
    known = groups.join(large, "group", "left_semi").select("lang", "source", "group")
    vectors = beside(stats.where("not base_failed"), known, ["lang", "source"], number).select("group", *(f"x{i}" for i in range(P)))
    estimate = known.join(robust_estimates(materialised(vectors, "mcd-vectors"), number), "group").drop("group", "determinant")

    judged = beside(stats, estimate, ["lang", "source"], number, "left").select(*stats.columns, _distance().alias("distance"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
