"""Quality rules whose cut-offs come with a guarantee against rejecting good documents.

Every rule compares one figure of a document with a cut-off. The cut-offs of a rule are a fixed list from lenient
to strict. Documents labelled good are the holdout: within a stratum (language and length class), a cut-off is
certified if the exact binomial probability of as few false rejections as were seen, were the true rate ``rate``
or more, is at most ``risk`` divided by the number of rules times strata (Bonferroni). The cut-offs of one rule in
one stratum are tested from lenient to strict and the first that fails ends the test (fixed sequence), so they
need no further division. With probability 1 - ``risk``, then, no rule rejects more than ``rate`` of the good
documents of any stratum, and all rules together no more than ``rate`` times their number. Among certified cut-offs
the one with the largest lead of rejected bad over rejected good documents is taken; a rule without one is off.

Nothing here leaves the DataFrame functions: texts are read by higher-order functions, counts are partial
aggregates, the binomial sum is an expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from docweave.llm.registry import query
from docweave.runtime import BROADCAST_LIMIT_BYTES, estimated_bytes, materialize, salted_join

RATE = 0.005
RISK = 0.05
LENGTH_CLASSES = (100, 1000)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """``fails`` of a cut-off; every document that fails a cut-off fails the later, stricter ones of ``cutoffs``."""
    name: str
    fails: Callable[[Column], Column]
    cutoffs: tuple[int, ...]


def above(figure: str, of: str) -> Callable[[Column], Column]:
    """More than ``cutoff`` thousandths."""
    return lambda cutoff: F.col(figure) * 1000 > cutoff * F.col(of)


RULES = (
    Rule("symbols", above("n_symbols", "n_words"), (500, 200, 100, 50, 20)),
    Rule("repeated_lines", above("n_dup_lines", "n_lines"), (500, 300, 200, 100, 50)),
    Rule("repeated_words", above("n_repeat_words", "n_words"), (180, 150, 100, 50, 20)),
    Rule("short_words", lambda cutoff: F.col("word_chars") * 1000 < cutoff * F.col("n_words"), (2000, 2500, 3000, 3500, 4000)),
    Rule("long_words", above("word_chars", "n_words"), (15000, 12000, 10000, 8000, 7000)),
    Rule("few_words", lambda cutoff: F.col("n_words") < cutoff, (12, 15, 20, 30, 50)),
)


def bind(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Places of five equal words: the hash proposes, the words decide. Texts without two equal hashes stop at the first test.
_EQUAL_NEIGHBOUR = "filter({0}, (x, k) -> (k > 0 AND {0}[k - 1].h = x.h) OR (k < size({0}) - 1 AND {0}[k + 1].h = x.h))"
_COVERED = """aggregate(sort_array(transform(same, x -> x.p)), named_struct('words', 0L, 'upto', 0),
    (a, p) -> named_struct('words', a.words + p + 5 - greatest(p, a.upto), 'upto', p + 5), a -> a.words)"""
_REPEATED = "IF(size(ws) < 6, 0L, " + bind("transform(ws, w -> xxhash64(w))", "hs", bind(
    "transform(sequence(0, size(ws) - 5), i -> xxhash64(hs[i], hs[i + 1], hs[i + 2], hs[i + 3], hs[i + 4]))", "fives",
    "IF(size(array_distinct(fives)) = size(fives), 0L, " + bind(
        "sort_array(transform(fives, (h, p) -> named_struct('h', h, 'p', p)))", "marks", bind(
            f"transform({_EQUAL_NEIGHBOUR.format('marks')}, x -> named_struct('h', array_join(slice(ws, x.p + 1, 5), ' '), 'p', x.p))", "likely", bind(
                "sort_array(likely)", "texts", bind(_EQUAL_NEIGHBOUR.format("texts"), "same", _COVERED)))) + ")")) + ")"
_FIGURES = bind(r"filter(split(txt, '[\\x20\\x09-\\x0D]+'), w -> w <> '')", "ws", bind(r"filter(split(txt, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')", "ls", f"""named_struct(
    'n_words', bigint(size(ws)), 'word_chars', aggregate(ws, 0L, (a, w) -> a + length(w)), 'n_symbols', bigint(length(regexp_replace(txt, '[^#*$%&|<>]+', ''))),
    'n_dup_lines', bigint(size(ls) - size(array_distinct(ls))), 'n_repeat_words', {_REPEATED}, 'n_lines', bigint(size(ls)))"""))


def figures(documents: DataFrame) -> DataFrame:
    """(doc_id, stratum, base_failed) and ``FIGURES`` of every whole text; a null text has no words.

    ``inline`` keeps the optimizer from copying the work into each column.
    """
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("txt"))
    counted = read.select("doc_id", "lang", F.expr(f"inline(array({_FIGURES}))"))
    length = F.lit(0)
    for bound in LENGTH_CLASSES:
        length = length + (F.col("n_words") >= bound).cast("int")
    stratum = F.concat(F.coalesce(F.concat(F.lit("lang "), "lang"), F.lit("no lang")), F.lit(", length "), length.cast("string"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", stratum.alias("stratum"), base.alias("base_failed"), *FIGURES)


def log_gamma(z: Column) -> Column:
    """Natural logarithm of the gamma function for z >= 1: Stirling's series seven places up."""
    up = z + 7.0
    product = F.lit(1.0)
    for k in range(7):
        product = product * (z + float(k))
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3.0))) + 1 / (1260 * F.pow(up, F.lit(5.0))) - 1 / (1680 * F.pow(up, F.lit(7.0)))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(failed: str, of: str, rate: float) -> Column:
    """Probability of at most ``failed`` among ``of`` at this rate, 1.0 where ``failed`` is not below the mean.

    The largest term comes from ``log_gamma``, the smaller ones from it by ratios; forty standard deviations below
    it they no longer change the sum.
    """
    x, n = F.col(failed).cast("double"), F.col(of).cast("double")
    largest = F.exp(log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + x * math.log(rate) + (n - x) * math.log1p(-rate))
    terms = F.least(F.col(failed), (40 * F.sqrt(x + 1) + 50).cast("long"))
    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))

    def add(held: Column, step: Column) -> Column:
        term = held["term"] * (x - step + 1) * (1 - rate) / ((n - x + step) * rate)
        return F.struct((held["total"] + term).alias("total"), term.alias("term"))

    ratio_sum = F.aggregate(steps, F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term")), add, lambda held: held["total"])
    return F.when(x < n * rate, largest * ratio_sum).otherwise(F.lit(1.0))


def marked(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a 0/1 quality label that pass the base rules. Labelled twice, a document takes the larger label."""
    good = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.max("quality").cast("int").alias("good")))
    return measured.where("NOT base_failed").join(good, "doc_id")


def cells(holdout: DataFrame) -> DataFrame:
    """(stratum, good, bad, rule, level, cutoff, good_failed, bad_failed): one partial aggregate over the holdout."""
    sums = [F.sum("good").cast("long").alias("good"), F.sum(1 - F.col("good")).cast("long").alias("bad")]
    rows = []
    for rule in RULES:
        for level, cutoff in enumerate(rule.cutoffs):
            fails = rule.fails(F.lit(cutoff))
            names = [f"{kind}_{rule.name}_{level}" for kind in ("good", "bad")]
            for name, label in zip(names, (1, 0)):
                sums.append(F.count(F.when(fails & (F.col("good") == label), 1)).alias(name))
            rows.append(F.struct(F.lit(rule.name).alias("rule"), F.lit(level).alias("level"), F.lit(cutoff).alias("cutoff"),
                                 F.col(names[0]).alias("good_failed"), F.col(names[1]).alias("bad_failed")))
    return holdout.groupBy("stratum").agg(*sums).select("stratum", "good", "bad", F.inline(F.array(*rows)))


def certified(counts: DataFrame, strata: int, rate: float = RATE, risk: float = RISK) -> DataFrame:
    """``cells`` with ``tail`` and ``certified``, which holds while all cut-offs up to it pass their test."""
    order = Window.partitionBy("stratum", "rule").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    allowed = risk / (max(1, strata) * len(RULES))
    tested = counts.withColumn("tail", binomial_tail("good_failed", "good", rate))
    return tested.withColumn("certified", F.min(F.col("tail") <= allowed).over(order))


def chosen(tested: DataFrame) -> DataFrame:
    """One row per stratum with a column per rule: its cut-off, null where the rule is off."""
    lead = (F.col("bad_failed").cast("decimal(19,0)") * F.col("good").cast("decimal(19,0)")
            - F.col("good_failed").cast("decimal(19,0)") * F.col("bad").cast("decimal(19,0)"))
    ranked = tested.where("certified").withColumn("lead", lead).where("lead > 0")
    best = ranked.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("lead", -F.col("level"))).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule.name, F.col("cutoff"))).alias(f"cut_{rule.name}") for rule in RULES])


def cutoffs(measured: DataFrame, labels: DataFrame, rate: float = RATE, risk: float = RISK) -> DataFrame:
    """Cut-offs per stratum. Without labelled documents, or with too few in every stratum, there are none."""
    counts = materialize(cells(marked(measured, labels)))
    strata = counts.where("level = 0 AND good > 0").select("stratum").distinct().count()
    return chosen(certified(counts, strata, rate, risk))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``failed_rules``, the names of the rules a document fails, and ``kept``."""
    limits = materialize(limits)
    if estimated_bytes(limits, *limits.columns) <= BROADCAST_LIMIT_BYTES:
        joined = measured.join(F.broadcast(limits), "stratum", "left")
    else:
        joined = salted_join(measured, limits, ["stratum"], "left", "doc_id")
    failed = F.array_compact(F.array(*[F.when(rule.fails(F.col(f"cut_{rule.name}")), F.lit(rule.name)) for rule in RULES]))
    return (joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
            .drop(*[f"cut_{rule.name}" for rule in RULES]))


def quality_rules(documents: DataFrame, labels: DataFrame, rate: float = RATE, risk: float = RISK) -> DataFrame:
    """(doc_id, stratum, base_failed, figures, failed_rules, kept), one row per document.

    A null or empty text has no words and fails the base rules. A null language is a stratum of its own. Rows with
    one id are judged each; rows without an id are judged, but never labelled. Other columns are not kept. The
    figures are written once and read for the cut-offs and for the verdicts.
    """
    measured = materialize(figures(documents))
    return judge(measured, cutoffs(measured, labels, rate, risk))


def _sql() -> str:
    """The same rows by another way: windows unnested, the whole binomial sum by ``lgamma``."""
    tests = {"symbols": "1000 * n_symbols > c * n_words", "repeated_lines": "1000 * n_dup_lines > c * n_lines", "repeated_words": "1000 * n_repeat_words > c * n_words",
             "short_words": "1000 * word_chars < c * n_words", "long_words": "1000 * word_chars > c * n_words", "few_words": "n_words < c"}
    grid = ", ".join(f"('{r.name}', {level}, {cut})" for r in RULES for level, cut in enumerate(r.cutoffs))
    fails = "CASE rule " + " ".join(f"WHEN '{name}' THEN {test}" for name, test in tests.items()) + " END"
    classes = " + ".join(f"(n_words >= {bound})::INT" for bound in LENGTH_CLASSES)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    fives AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS times FROM (
        SELECT r, p, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5))),
    covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS k FROM fives WHERE times > 1) GROUP BY r),
    f AS (SELECT w.r, doc_id, lang, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                 coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered c ON c.r = w.r),
    m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce('lang ' || lang, 'no lang') || ({classes}) AS s FROM f),
    rules(rule, level, c) AS (VALUES {grid}),
    l AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
    h AS (SELECT m.*, good FROM m JOIN l USING (doc_id) WHERE NOT base_failed),
    cell AS (SELECT s, rule, level, c, count(*) FILTER (WHERE good = 1) AS n, count(*) FILTER (WHERE good = 0) AS b, count(*) FILTER (WHERE good = 1 AND {fails}) AS x,
                    count(*) FILTER (WHERE good = 0 AND {fails}) AS y FROM h CROSS JOIN rules GROUP BY s, rule, level, c),
    tested AS (SELECT *, list_sum(list_transform(range(0, x + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RATE}) + (n - j) * ln(1 - {RATE}))))
                    <= {RISK} / ({len(RULES)} * (SELECT count(DISTINCT s) FROM cell WHERE n > 0)) AND x < n * {RATE} AS good_enough FROM cell),
    held AS (SELECT *, bool_and(good_enough) OVER (PARTITION BY s, rule ORDER BY level) AS certified, CAST(y AS HUGEINT) * n - CAST(x AS HUGEINT) * b AS lead FROM tested),
    cut AS (SELECT s, rule, c FROM held WHERE certified AND lead > 0 QUALIFY row_number() OVER (PARTITION BY s, rule ORDER BY lead DESC, level) = 1),
    out AS (SELECT m.r FROM m JOIN cut USING (s) WHERE {fails} GROUP BY m.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM out) AS kept FROM m"""


@query("op12_quality_rules", sql=_sql())
def op12_quality_rules(spark, sf_dir):
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
