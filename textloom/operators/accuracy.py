"""AGG24: what predictions are worth against reviewed references, case by case and layer by layer.

One join of cases with their predictions; every case makes the few counters that it adds to
(``part, name, measure, n``), which are summed before they are shuffled, so a report is
one pass whatever its number of parts. Cases that are not scorable are counted and left out.

* ``flow``: a scorable case is a missing prediction, a provider failure, a timeout, an invalid prediction, or it is
  aligned; of these a case with a token that has no reading for its place and surface is unalignable, the
  others are evaluated.
* ``phrase``: exact; accepted (primary or alternative); normalised (after NFC, trimming and single spaces); case_only and
  unicode_only for proposals that are not accepted but would be without case or composition.
* ``token``: correct, incorrect, unalignable; of failed predictions all tokens are unsuccessful.
* ``feature``, by kind: correct, incorrect, unevaluable.
* ``validator``, by layer: a sparse confusion matrix of what its signals flag (severities above INFO) against the
  reviewed truth, uncertain where there is no truth or no prediction, and signals by severity.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textloom.functions import text as T

LAYERS = ("STRUCTURAL", "DETERMINISTIC_CONSISTENCY", "IJMES_POLICY", "LINGUISTIC_REVIEW")
FAILURES = {"PROVIDER_FAILURE": "provider_failure", "TIMEOUT": "timeout"}


@F.pandas_udf(ArrayType(StringType()))
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda values: None if values is None else [None if v is None else unicodedata.normalize("NFC", v) for v in values])


def _plain(c: Column) -> Column:
    return F.regexp_replace(T.unicode_trim(c), r"\s+", " ")


def _rows(part: str, name: Column | str, measure: Column | str, n: Column | int = 1) -> Column:
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(part).alias("part"), text(name).alias("name"), text(measure).alias("measure"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"))


def counters(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """``part, name, measure, n`` over all cases.

    ``cases``: case_id, scorable, canonical, alternatives, tokens (array of idx, surface, canonical), features (array of id, kind,
    expected), truth (map of layer to boolean). ``predictions``: case_id (once each), class, valid, proposal, tokens (idx, surface,
    canonical), features (map of id to value), signals (array of layer, severity).
    """
    given = predictions.select("case_id", F.lit(True).alias("_there"), "class", "valid", "proposal", F.col("tokens").alias("_tokens"), F.col("features").alias("_features"), F.col("signals").alias("_signals"))
    both = cases.join(given, "case_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    failure = (
        F.when(F.col("_there").isNull(), "missing_prediction")
        .when(F.col("class") == "PROVIDER_FAILURE", FAILURES["PROVIDER_FAILURE"])
        .when(F.col("class") == "TIMEOUT", FAILURES["TIMEOUT"])
        .when(~yes(F.col("valid")) | (F.coalesce("proposal", F.lit("")) == ""), "invalid_prediction")
    )
    both = both.withColumn("_failed", failure)
    accepted = F.concat(F.array("canonical"), F.coalesce("alternatives", F.array().cast("array<string>")))
    both = both.withColumn("_accepted", accepted).withColumn("_nfc", _composed(F.concat(F.array("proposal"), accepted)))
    rest = F.slice("_nfc", F.lit(2), F.size("_accepted"))
    among = lambda change: F.exists(rest, lambda a: change(a) == change(F.col("_nfc")[0]))
    taken = F.array_contains("_accepted", F.col("proposal"))
    reading = lambda t: F.try_element_at(F.filter("_tokens", lambda p: (p["idx"] == t["idx"]) & (p["surface"] == t["surface"])), F.lit(1))
    judged = F.transform("tokens", lambda t: F.when(reading(t).isNull(), "unalignable").when(reading(t)["canonical"].eqNullSafe(t["canonical"]), "correct").otherwise("incorrect"))
    both = both.withColumn("_judged", F.when(F.col("_failed").isNull(), judged))

    flow = F.when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.array_contains("_judged", "unalignable"), "unalignable").otherwise("evaluated")
    fine = F.col("_failed").isNull()
    phrase = [
        F.when(fine & (F.col("proposal") == F.col("canonical")), _rows("phrase", "", "exact")),
        F.when(fine & taken, _rows("phrase", "", "accepted")),
        F.when(fine & among(_plain), _rows("phrase", "", "normalized")),
        F.when(fine & ~taken & among(lambda c: F.lower(_plain(c))), _rows("phrase", "", "case_only")),
        F.when(fine & ~taken & among(lambda c: c), _rows("phrase", "", "unicode_only")),
    ]
    tokens = [_token_count(fine, m) for m in ("correct", "incorrect", "unalignable")]
    tokens += [_rows("token", "", "eligible", F.size("tokens")), F.when(~fine, _rows("token", "", "unsuccessful", F.size("tokens")))]
    value = lambda f: F.try_element_at(F.col("_features"), f["id"])
    outcome = lambda f: F.when(~fine | value(f).isNull(), "unevaluable").when(value(f) == f["expected"], "correct").otherwise("incorrect")
    features = F.transform(F.coalesce("features", F.array().cast(dict(cases.dtypes)["features"])), lambda f: _rows("feature", f["kind"], outcome(f)))
    layers = []
    for layer in LAYERS:
        truth, flagged = F.try_element_at(F.col("truth"), F.lit(layer)), _flagged(layer)
        cell = F.when(~fine | truth.isNull(), "uncertain").when(truth & flagged, "detected").when(truth, "missed").when(flagged, "false_warning").otherwise("unflagged")
        layers.append(_rows("validator", layer, cell))
    signals = F.when(fine, F.transform("_signals", lambda s: _rows("validator", s["layer"], F.concat(F.lit("signal_"), F.lower(s["severity"])))))
    some = F.array(_rows("flow", "", flow), *phrase, *tokens, *layers)
    every = F.filter(F.concat(some, features, F.coalesce(signals, F.array().cast("array<struct<part:string,name:string,measure:string,n:bigint>>"))), lambda r: r.isNotNull())
    scored = both.where(yes(F.col("scorable"))).select(F.explode(every).alias("r")).select("r.*")
    left_out = cases.where(~yes(F.col("scorable"))).select(F.lit("flow").alias("part"), F.lit("").alias("name"), F.lit("excluded").alias("measure"), F.lit(1).cast("long").alias("n"))
    return scored.unionByName(left_out).groupBy("part", "name", "measure").agg(F.sum("n").alias("n")).where("n > 0")


def _token_count(fine: Column, measure: str) -> Column:
    return F.when(fine, _rows("token", "", measure, F.size(F.filter("_judged", lambda j: j == measure))))


def _flagged(layer: str) -> Column:
    return F.coalesce(F.exists("_signals", lambda s: (s["layer"] == layer) & (s["severity"] != "INFO")), F.lit(False))


def validator_matrices(counts: DataFrame) -> DataFrame:
    """A row for each layer of :func:`counters`: its matrix, whether it is measurable, precision and recall."""
    cells = ("detected", "missed", "false_warning", "unflagged", "uncertain")
    wide = counts.where("part = 'validator'").groupBy(F.col("name").alias("layer")).agg(*(F.coalesce(F.sum(F.when(F.col("measure") == c, F.col("n"))), F.lit(0)).alias(c) for c in cells))
    share = lambda of, rest: F.when(F.col(of) + F.col(rest) > 0, F.col(of) / (F.col(of) + F.col(rest)))
    return wide.withColumns({"measurable": F.col("detected") + F.col("missed") + F.col("false_warning") + F.col("unflagged") > 0, "precision": share("detected", "false_warning"), "recall": share("detected", "missed")})
