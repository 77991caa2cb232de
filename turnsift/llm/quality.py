"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares a share of a text with a cutoff in percent.  Which cutoffs apply is decided per stratum (language) by a labelled
holdout and exact binomial tests: with probability ``1 - error`` no stratum loses more than ``max_false_rejection`` of its good
documents to all rules together.  There are two ways:

* ``certified_rule_sets``, which the query and the pipeline use, tests sets of rules whole, in sequences from the mildest cutoffs
  down.  Each test of a sequence is made only if the one before it passed, so a sequence has one price however long it is; the
  sequences of all strata share the error evenly.  About 300 good labels are enough for four languages.
* ``certified_cutoffs`` tests every cutoff of every rule at an even share of the false rejection, under Holm's correction for all
  of them.  A stratum needs about 1,500 good labels.

Null texts and texts without words have zero counts; they fail the base rule.  A null language is a stratum of its own.  Rows that share a
``doc_id`` are judged one by one, but in the holdout a ``doc_id`` counts once, with its smallest row: as good if any label says
so, as bad otherwise.  Repeated labels prove nothing.  Without labels only the base rule rejects.  Texts have any length.  Of cutoffs or
sets that separate equally well the mildest is used.  An empty table gives no rows.  Columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
#: Share of each rule: numerator and denominator columns.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
CUTOFFS = (10, 20, 30, 50, 75)
MAX_FALSE_REJECTION = 0.02
ERROR = 0.05
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, characters, ""))).cast("bigint")


def _repeated(windows: Column) -> Column:
    """Positions, ascending, of sorted (hash, position) windows whose hash occurs again."""
    after = F.slice(windows, F.lit(2), F.size(windows))
    before = F.concat(F.array(F.lit(None)), windows)
    marked = F.zip_with(
        F.zip_with(windows, after, lambda a, b: F.struct(a.alias("own"), (a.h == b.h).alias("again"))),
        before,
        lambda x, c: F.when(x.again | (x.own.h == c.h), x.own.p),
    )
    return F.array_sort(F.array_compact(marked))


def _covered(places: Column) -> Column:
    """Words in the windows that begin at ``places``."""
    after = F.slice(places, F.lit(2), F.size(places))
    steps = F.zip_with(places, after, lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)


def text_facts(documents: DataFrame) -> DataFrame:
    """``documents`` with the counts of their texts; windows are compared by the 64-bit hash of their words."""
    text = F.col("_text")
    rows = documents.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns({
        "_words": F.array_remove(F.split(text, f"{SPACE}+"), ""),
        "_lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": _count(text, r"[#*$%&|<>]"),
        "n_capitals": _count(text, r"\p{Lu}"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_windows": F.sort_array(F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
                lambda i: F.struct(F.xxhash64(F.slice("_words", i, F.lit(WINDOW))).alias("h"), i.alias("p")),
            ),
        ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))),
    })
    rows = rows.withColumn("_places", _repeated(F.col("_windows")))
    rows = rows.withColumn("n_repeat_words", _covered(F.col("_places")))
    return rows.drop("_text", "_words", "_lines", "_windows", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _exceeds(rule: str, cutoff: Column) -> Column:
    part, whole = RULES[rule]
    return 100 * F.col(part) > cutoff * F.col(whole)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, carried back; the error stays below 1e-10."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(n: Column, k: Column, p: float, terms: int = 4000) -> Column:
    """P(at most k of n) at rate ``p``, or a little more, never less.

    From term k downwards; what more than ``terms`` terms would add is bounded by a geometric series. Counts at or
    above the mean are given as 1, which no test takes for evidence.
    """
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(
        _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    start = F.struct(first.alias("total"), first.alias("term"))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))

    def step(s: Column, i: Column) -> Column:
        j = k - i + 1  # i = 0 is the first term itself
        term = F.when(i == 0, s.term).otherwise(s.term * j * (1 - p) / ((n - j + 1) * p))
        return F.struct(F.when(i == 0, s.total).otherwise(s.total + term).alias("total"), term.alias("term"))

    left = F.greatest(k - terms, F.lit(0.0))
    ratio = left * (1 - p) / ((n - left + 1) * p)
    total = F.aggregate(steps, start, step, lambda s: s.total + s.term * ratio / (1 - ratio))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def _holdout(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that pass the base rule, each ``doc_id`` once, with ``good``."""
    rated = labels.where("quality in (0, 1)").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    rows = facts.where(~base_failed()).join(rated, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("stratum", *FACTS, "good")).alias("row"))
    return one.select("row.*")


def certified_cutoffs(
    facts: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR,
    cutoffs: tuple[int, ...] = CUTOFFS,
) -> DataFrame:
    """``stratum`` and one column per rule with the cutoff in use, null if there is none."""
    holdout = _holdout(facts, labels)
    good = F.col("good")
    tried = [(rule, c) for rule in RULES for c in cutoffs]
    failing = {(rule, c): _exceeds(rule, F.lit(c)) for rule, c in tried}
    counted = holdout.groupBy("stratum").agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("n_bad"),
        *[F.count_if(good & failing[t]).alias(f"{t[0]}_{t[1]}") for t in tried],
        *[F.count_if(~good & failing[t]).alias(f"bad_{t[0]}_{t[1]}") for t in tried],
    )
    tests = counted.select("stratum", "n", "n_bad", F.inline(F.array(*[
        F.struct(
            F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{c}").alias("k"),
            F.col(f"bad_{rule}_{c}").alias("k_bad"),
        )
        for rule, c in tried
    ])))
    tests = tests.withColumn("p", binomial_tail(F.col("n"), F.col("k"), max_false_rejection / len(RULES)))
    # One row per stratum, rule and cutoff: Holm's correction ranks them all.
    ranked = tests.selectExpr(
        "*", "row_number() over (order by p, stratum, rule, cutoff) as place", "count(*) over () as tests"
    )
    failed = ranked.selectExpr("*", f"p > {error!r} / (tests - place + 1) as fails")
    holm = failed.selectExpr("*", "max(fails) over (order by place rows unbounded preceding) as stopped")
    gain = F.col("k_bad") * F.col("n") - F.col("k") * F.col("n_bad")
    return holm.where(~F.col("stopped") & (gain > 0)).groupBy("stratum").agg(
        *[F.max_by("cutoff", F.when(F.col("rule") == rule, F.struct(gain, "cutoff"))).alias(f"_{rule}") for rule in RULES]
    )


def certified_rule_sets(
    facts: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR,
    cutoffs: tuple[int, ...] = CUTOFFS,
) -> DataFrame:
    """Like ``certified_cutoffs``, but sets of rules are tested whole, so a stratum needs far fewer labels.

    A stratum has one sequence of sets per rule: that rule alone from its mildest cutoff down, then with it all others, from
    their mildest cutoff down.  Each set rejects what the set before it rejects, so a sequence is tested in order at one price, and
    its tests end by themselves where the false rejection of the whole set is not shown to be below ``max_false_rejection``.  The
    sequences of all strata share ``error`` evenly; strata that could pass no test at any number of strata, or have no bad
    documents, take no part.  The set that separates bad from good best is used, with every rule at the mildest cutoff that
    rejects the same labelled documents: a milder set keeps the promise of the set it is part of.
    """
    holdout = _holdout(facts, labels)
    good = F.col("good")
    falling = sorted(cutoffs, reverse=True)
    alone = [{rule: c} for rule in RULES for c in falling]
    joined = [{rule: falling[-1]} | {other: c for other in RULES if other != rule} for rule in RULES for c in falling]

    def rejects(rules: dict[str, int]) -> Column:
        fails = F.lit(False)
        for rule, c in rules.items():
            fails = fails | _exceeds(rule, F.lit(c))
        return fails

    sets = alone + joined
    counted = holdout.groupBy("stratum").agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("n_bad"),
        *[F.count_if(good & rejects(x)).alias(f"k_{i}") for i, x in enumerate(sets)],
        *[F.count_if(~good & rejects(x)).alias(f"bad_{i}") for i, x in enumerate(sets)],
    )
    least = math.log(error / len(RULES)) / math.log1p(-max_false_rejection)
    counted = counted.where((F.col("n_bad") > 0) & (F.col("n") >= least)).withColumn("strata", F.expr("count(*) over ()"))

    def mildest(rule: str, c: int) -> Column:
        """The mildest cutoff with the counts of ``c``; as sets are nested, equal counts are equal sets."""
        at = {x: alone.index({rule: x}) for x in falling}
        chosen = F.when((F.col(f"k_{at[c]}") == 0) & (F.col(f"bad_{at[c]}") == 0), F.lit(None).cast("int"))
        for x in falling:
            same = (F.col(f"k_{at[x]}") == F.col(f"k_{at[c]}")) & (F.col(f"bad_{at[x]}") == F.col(f"bad_{at[c]}"))
            chosen = chosen.when(same, F.lit(x))
        return chosen

    tests = counted.select("stratum", "n", "n_bad", "strata", F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("place"), F.col(f"k_{i}").alias("k"), F.col(f"bad_{i}").alias("k_bad"),
            *[(mildest(r, x[r]) if r in x else F.lit(None).cast("int")).alias(f"_{r}") for r in RULES],
        )
        for i, x in enumerate(sets)
    ])))
    # The p values of a sequence never fall, so one that passes has passed all before it.
    passed = binomial_tail(F.col("n"), F.col("k"), max_false_rejection) <= error / (len(RULES) * F.col("strata"))
    gain = F.col("k_bad") * F.col("n") - F.col("k") * F.col("n_bad")
    best = tests.where(passed & (gain > 0)).groupBy("stratum").agg(
        F.max_by(F.struct(*[f"_{r}" for r in RULES]), F.struct(gain, -F.col("place"))).alias("best")
    )
    return best.select("stratum", "best.*")


def with_stratum(documents: DataFrame) -> DataFrame:
    return documents.withColumn("stratum", F.coalesce(F.col("lang").cast("string"), F.lit("")))


def judge(facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    own, cut = facts.drop("base_failed", "kept").alias("f"), cutoffs.alias("c")
    rows = own.join(cut, F.col("f.stratum") == F.col("c.stratum"), "left")
    fails = F.lit(False)
    for rule in RULES:
        fails = fails | F.coalesce(_exceeds(rule, F.col(f"c._{rule}")), F.lit(False))
    failed = base_failed()
    return rows.select("f.*", failed.alias("base_failed"), (~failed & ~fails).alias("kept"))
