"""Corpus analytics: eligibility, coverage, recovery, confusion, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def rate(hits: Column, total: Column, empty: float | None = 0.0, scale: float = 1.0) -> Column:
    """A quotient; ``empty`` where the total is 0."""
    return F.when(total > 0, hits / total * scale).otherwise(F.lit(empty).cast("double"))


def wilson(hits: Column, total: Column) -> Column:
    """AGG25: proportion with its Wilson interval; null without cases."""
    p, z2 = hits / total, Z95 * Z95
    centre = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = Z95 * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    ok = total > 0
    return F.struct(F.when(ok, p).alias("estimate"), F.when(ok, F.greatest(F.lit(0.0), centre - half)).alias("low"), F.when(ok, F.least(F.lit(1.0), centre + half)).alias("high"))


def title_eligibility(df: DataFrame, title: str, language: str, order: list[str], wanted: str = "fa") -> DataFrame:
    """FLT1: the first reason against a title; only eligible ones count for the duplicate test, the last of all."""
    trimmed = T.unicode_trim(F.col(title))
    norm = T.unicode_trim(T.normalize_text(trimmed))
    out = df.withColumn("normalized", norm).withColumn("_s", T.script_counts(F.col("normalized")))
    arabic, latin, words = F.col("_s.arabic"), F.col("_s.latin"), F.col("_s.tokens")
    reason = (
        F.when(F.coalesce(trimmed, F.lit("")) == "", "EMPTY_TITLE")
        .when(~F.col(language).eqNullSafe(F.lit(wanted)), "NOT_LANGUAGE_FA")
        .when(arabic == 0, "ONLY_PUNCTUATION_OR_NUMBERS")
        .when(latin > arabic * 0.5, "PRIMARY_LATIN_METADATA")
        .when(arabic < 4, "INSUFFICIENT_ARABIC_SCRIPT")
        .when(words < 2, "FEWER_THAN_TWO_PERSIAN_TOKENS")
    )
    out = out.withColumn("reason", reason)
    first = out.where("reason IS NULL").groupBy("normalized").agg(F.min(F.struct(*order)).alias("_first"))
    out = out.join(first, "normalized", "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.struct(*order) != F.col("_first"), "DUPLICATE_NORMALIZED_TITLE"))).drop("_s", "_first")


def length_bucket(n: Column) -> Column:
    """AGG17"""
    return F.when(n <= 1, "0-1").when(n <= 4, "2-4").when(n <= 8, "5-8").when(n <= 15, "9-15").otherwise("16+")


def token_coverage(tokens: DataFrame, by: list[str], form: str, covered: str, case: str) -> DataFrame:
    """AGG15/17/18: rates of tokens, distinct forms and fully covered cases, in percent.

    Aggregated in two steps (form and case first), so that no step holds a set of forms.
    """
    forms = tokens.groupBy(*by, form).agg(F.count("*").alias("n"), F.max(F.col(covered).cast("int")).alias("c"), F.sum(F.col(covered).cast("long")).alias("k"))
    words = forms.groupBy(*by).agg(F.sum("n").alias("tokens"), F.sum("k").alias("covered_tokens"), F.count("*").alias("forms"), F.sum("c").cast("long").alias("covered_forms"))
    cases = tokens.groupBy(*by, case).agg(F.min(F.col(covered).cast("int")).alias("c")).groupBy(*by).agg(F.count("*").alias("cases"), F.sum("c").cast("long").alias("covered_cases"))
    out = words.join(cases, by)
    for unit in ("tokens", "forms", "cases"):
        out = out.withColumn(f"{unit[:-1]}_rate", F.round(rate(F.col(f"covered_{unit}"), F.col(unit), scale=100.0), 6))
    return out


def miss_recovery(baseline: DataFrame, experiment: DataFrame, keys: list[str], form: str) -> DataFrame:
    """JON28/AGG16: tokens and forms that only the experiment covers, of those the baseline misses.

    Tokens are counted by keys and form before they meet the experiment, of which only the keys that it covers are
    needed; with ``form`` among the keys nothing is shuffled a second time.
    """
    missed = baseline.where(~F.col("covered")).groupBy(*dict.fromkeys([*keys, form])).agg(F.count("*").alias("n"))
    both = missed.join(experiment.where("covered").select(*keys).distinct().withColumn("_now", F.lit(True)), keys, "left")
    forms = both.groupBy(form).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_now"), F.col("n")).otherwise(0)).alias("r"))
    return forms.agg(F.sum("n").alias("missed_tokens"), F.sum("r").alias("recovered_tokens"), F.count("*").alias("missed_forms"), F.count_if(F.col("r") > 0).alias("recovered_forms"))


CLASSES = ("CORRECT_AUTHORITATIVE", "FALSE_AUTHORITATIVE", "CORRECT_REVIEW_REQUIRED", "CORRECT_UNRESOLVED", "OVER_BLOCKED", "UNDER_BLOCKED", "ISSUE_TYPE_MISMATCH", "INVALID_GOLD_CASE")
SAFE = ("CORRECT_AUTHORITATIVE", "CORRECT_REVIEW_REQUIRED", "CORRECT_UNRESOLVED", "OVER_BLOCKED")


def classify_case(expected: Column, actual: Column, matches: Column, required: Column, forbidden: Column, issues: Column, gold_ok: Column) -> Column:
    """AGG21: one of eight classes."""
    issue_ok = (F.size(F.array_except(required, issues)) == 0) & ~F.arrays_overlap(forbidden, issues)
    return (
        F.when(~gold_ok, "INVALID_GOLD_CASE")
        .when((expected == "FINAL") & (actual == "FINAL"), F.when(matches, "CORRECT_AUTHORITATIVE").otherwise("FALSE_AUTHORITATIVE"))
        .when(expected == "FINAL", "OVER_BLOCKED")
        .when(actual == "FINAL", "UNDER_BLOCKED")
        .when(~F.coalesce(issue_ok, F.lit(True)), "ISSUE_TYPE_MISMATCH")
        .when(expected == "REVIEW_REQUIRED", "CORRECT_REVIEW_REQUIRED")
        .otherwise("CORRECT_UNRESOLVED")
    )


def confusion_metrics(cases: DataFrame, by: list[str], outcome: str, expected_final: Column) -> DataFrame:
    """AGG19/20: counts by class, the safe rate (0 when empty) and the exact-match rate (null when empty)."""
    counts = [F.count_if(F.col(outcome) == c).alias(c.lower()) for c in CLASSES]
    out = cases.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(expected_final).alias("authoritative_cases"), F.count_if(F.col(outcome).isin(*SAFE)).alias("safe"), *counts)
    out = out.withColumn("safe_rate", F.round(rate(F.col("safe"), F.col("total")), 9))
    return out.withColumn("exact_rate", F.round(rate(F.col("correct_authoritative"), F.col("authoritative_cases"), None), 9))


def metric_views(cases: DataFrame, dims: list[str], outcome: str, expected_final: Column) -> DataFrame:
    """AGG19: overall and by each dimension in one pass of grouping sets."""
    sets = cases.groupingSets([[], *([d] for d in dims)], *dims)
    return sets.agg(F.count("*").alias("total"), F.count_if(F.col(outcome).isin(*SAFE)).alias("safe"), F.count_if(expected_final).alias("authoritative_cases"))


def release_gate(metrics: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """AGG23: a row for each threshold, with whether it is met."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("minimum")) for k, v in minimums.items())))
    return metrics.select(rows.alias("g")).select("g.*").withColumn("met", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)))


def zero_filled(df: DataFrame, column: str, values: list[str], missing: str | None = None) -> DataFrame:
    """AGG26/36: counts of all ``values``, those that do not occur too; null counts as ``missing``."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return wanted.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def split_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """AGG35: groups with rows in several splits."""
    return df.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b"), F.count("*").alias("n")).where("a <> b")


def worklist(tokens: DataFrame, form: str, n: int = 100) -> DataFrame:
    """SRT5: most frequent forms, ties by form."""
    from textloom.operators.selection import top_n

    counts = tokens.groupBy(form).agg(F.count("*").alias("n"))
    return top_n(counts, n, F.desc("n"), F.asc(form))


def blocker_shares(tokens: DataFrame, category: str, form: str) -> DataFrame:
    """AGG14/42: tokens, forms and token share of each category."""
    from textloom.operators.selection import with_share

    forms = tokens.groupBy(category, form).agg(F.count("*").alias("n"))
    return with_share(forms.groupBy(category).agg(F.sum("n").alias("tokens"), F.count("*").alias("forms")), "tokens")


def accuracy(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """AGG24/JON26: exact, alternative and normalised agreement of cases, with intervals."""
    both = references.join(predictions, "case_id", "left")
    exact = F.col("proposal") == F.col("canonical")
    alternative = F.coalesce(F.array_contains("alternatives", F.col("proposal")), F.lit(False))
    normal = lambda c: F.lower(T.normalize_text(c))
    out = both.agg(
        F.count("*").alias("cases"), F.count("proposal").alias("answered"), F.count_if(exact).alias("exact"), F.count_if(exact | alternative).alias("accepted"),
        F.count_if(normal(F.col("proposal")) == normal(F.col("canonical"))).alias("normalized"),
    )
    return out.withColumn("exact_interval", wilson(F.col("exact"), F.col("cases")))


def dominant(counts: DataFrame, category: str, value: str) -> DataFrame:
    """AGG42: the category with the greatest value, ties to the least name; ``counts`` is already aggregated."""
    return counts.select(category, value).orderBy(F.desc(value), F.asc(category)).limit(1)


def frozen_baseline(cases: DataFrame, ident: str, outcome: str) -> DataFrame:
    """MSC9: for each class its number of cases and their ids in order (a benchmark's cases, not a corpus's)."""
    return cases.groupBy(outcome).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(ident)).alias("cases"))


def before_and_after(tokens: DataFrame, covered: str, also: Column) -> DataFrame:
    """MSC12: tokens that are covered before and after a change."""
    return tokens.agg(F.count("*").alias("tokens"), F.count_if(F.col(covered)).alias("before"), F.count_if(also).alias("after"))
