"""Scores of predictions: thresholds, curves, classes, factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FLAG_PHRASES
from ..functions.values import safe_div
from .ranking import running_totals
from .reports import class_report

# Class names and the factor categories of the metric document.
BINARY = {0: "non_irrigated", 1: "irrigated"}
CATEGORY_CLASSES = {0: "non_irrigated", 1: "small-scale", 2: "tree_crop", 3: "industrial", 4: "lawn", 5: "covered"}
UNCERTAINTY = {flag: phrase.replace(" ", "_") for flag, phrase in FLAG_PHRASES.items()}
MONTHS = {6: "june", 7: "july", 8: "august", 9: "september", 10: "october"}
YEARS = range(2016, 2026)
EPS = 1e-8


def _counts(truth: str, guess: str) -> list[Column]:
    t, g = F.col(truth) == 1, F.col(guess) == 1
    return [F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn")]


def _prf() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score")]


def binary_metrics(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class."""
    c = df.groupBy(*keys).agg(*_counts(truth, guess))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(*keys, safe_div(F.col("tp") + F.col("tn"), n).alias("accuracy"), *_prf())


def factor_rows(truth: str, guess: str) -> tuple[Column, list[tuple[str, str]]]:
    """Array of (factor, category) a row counts for, and every category that must appear."""
    def one(factor, category, cond):
        return F.when(cond, F.struct(F.lit(factor).alias("factor"), (category if isinstance(category, Column) else F.lit(category)).alias("category")))

    parts = [one("overall", "overall", F.lit(True))]
    cats = [("overall", "overall")]
    for col, name in UNCERTAINTY.items():
        parts.append(one("per_uncertainty_explanation", name, F.col(col) == 1))
        cats.append(("per_uncertainty_explanation", name))
    parts.append(one("per_uncertainty_score", "low_certainty", F.col("certainty") <= 3))
    parts.append(one("per_uncertainty_score", "high_certainty", F.col("certainty") > 3))
    cats += [("per_uncertainty_score", "low_certainty"), ("per_uncertainty_score", "high_certainty")]
    for m, name in MONTHS.items():
        parts.append(one("per_month", name, F.col("month") == m))
        cats.append(("per_month", name))
    parts.append(one("per_year", F.col("year").cast("string"), F.col("year").between(YEARS[0], YEARS[-1])))
    cats += [("per_year", str(y)) for y in YEARS]
    parts.append(one("water_source", "water_source_present", F.col("water_source") == "true"))
    parts.append(one("water_source", "water_source_absent", F.col("water_source") == "false"))
    cats += [("water_source", "water_source_present"), ("water_source", "water_source_absent")]
    return F.array_compact(F.array(*parts)), cats


FACTOR_COLUMNS = [*UNCERTAINTY, "certainty", "month", "year", "water_source"]


def metrics_by_factor(rows: DataFrame, truth: str, guess: str, classes: Mapping[int, str] = BINARY) -> DataFrame:
    """Class report per factor and category; empty categories show zeros. ``classes`` names the codes, two or more.

    Rows are counted per combination of factor columns first, so the explode runs
    over some thousands of combinations instead of every pixel.
    """
    combos = rows.groupBy(*FACTOR_COLUMNS, truth, guess).agg(F.count("*").alias("__n"))
    which, cats = factor_rows(truth, guess)
    long = combos.select(F.explode(which).alias("f"), truth, guess, "__n").select("f.factor", "f.category", truth, guess, "__n")
    got = class_report(long, ["factor", "category"], truth, guess, classes, "__n")
    options = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(c).alias("category"), F.lit(k).alias("class")) for f, c in cats for k in classes.values()])
    grid = rows.sparkSession.range(1).select(F.explode(options).alias("g")).select("g.*")
    return grid.join(got, ["factor", "category", "class"], "left").fillna(0)


def class_presence(px: DataFrame, keys: Sequence[str], truth: str, guess: str, thresholds: Mapping[int, tuple[int, int]] | None = None,
                   classes: Mapping[int, str] = BINARY) -> DataFrame:
    """Image-level presence of each class (at least n pixels, truth and guess) and its metrics."""
    th = thresholds or {c: (1, 1) for c in classes}
    per = px.groupBy(*keys).agg(*[
        F.array(F.count_if(F.col(truth) == c) >= a, F.count_if(F.col(guess) == c) >= b).alias(f"__{c}") for c, (a, b) in th.items()])
    long = per.select(F.explode(F.array(*[
        F.struct(F.lit(classes[c]).alias("class"), F.col(f"__{c}")[0].cast("int").alias("t"), F.col(f"__{c}")[1].cast("int").alias("g")) for c in th])).alias("x")).select("x.*")
    c = long.groupBy("class").agg(*_counts("t", "g"))
    return c.select("class", *_prf(), (F.col("tp") + F.col("fn")).alias("support"))


def fraction_error(px: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """MAE, MSE and RMSE of the positive fraction per image."""
    per = px.groupBy(*keys).agg((F.avg((F.col(truth) > 0).cast("double")) - F.avg((F.col(guess) > 0).cast("double"))).alias("e"))
    mse = F.avg(F.col("e") * F.col("e"))
    return per.agg(F.avg(F.abs("e")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def fold_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population std of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return folds.agg(*aggs, F.count("*").alias("n_folds"))


def label_importances(pos: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Position -> band and 1-based step for a time-major feature vector."""
    n = len(bands)
    names = F.array(*[F.lit(b) for b in bands])
    return pos.select("pos", F.element_at(names, (F.col("pos") % n + 1).cast("int")).alias("band"),
                      (F.floor(F.col("pos") / n) + 1).cast("int").alias("time_step"), "importance")


def importance_totals(imp: DataFrame, by: str) -> DataFrame:
    return imp.groupBy(by).agg(F.sum("importance").alias("importance"))


def importance_matrix(imp: DataFrame, bands: Sequence[str], steps: int) -> DataFrame:
    """Band by step, zero where the model has no such feature."""
    grid = imp.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"))
    wide = imp.groupBy("band").agg(*[F.max(F.when(F.col("time_step") == t, F.col("importance"))).alias(f"t{t}") for t in range(1, steps + 1)])
    return grid.join(wide, "band", "left").fillna(0.0)


def score_curve(scored: DataFrame, truth: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: positives and all rows at or above it.

    Equal scores are merged before anything is ordered.
    """
    per = scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).cast("long").alias("pos"), F.count("*").alias("n"))
    cum = running_totals(per, keys, "threshold", {"tp": "pos", "flagged": "n"}, descending=True)
    if keys:
        tot = per.groupBy(*keys).agg(F.sum("pos").alias("total_pos"), F.sum("n").alias("total"))
        return cum.join(tot, list(keys))
    tot = per.agg(F.struct(F.sum("pos").alias("total_pos"), F.sum("n").alias("total"))).scalar()
    return cum.withColumn("__t", tot).select("*", "__t.*").drop("__t")


def with_precision_recall(curve: DataFrame) -> DataFrame:
    p, r = safe_div("tp", "flagged"), safe_div("tp", "total_pos")
    return curve.withColumns({"precision": p, "recall": r, "f1": 2 * p * r / (p + r + EPS)})


def best_threshold(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold of the best F1; the lowest one wins ties, as a left-to-right scan would."""
    c = with_precision_recall(curve)
    return c.groupBy(*keys).agg(F.min_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")).select(*keys, "b.*")


def _ranking_sums() -> list[Column]:
    """Step sum of precision, and negatives beaten by the positives above them, ties counting half."""
    beaten = (F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0)
    return [
        F.sum(F.col("tp") / F.col("flagged") * F.col("pos")).alias("__ap"), F.sum(beaten).alias("__auc"),
        F.max("total_pos").alias("n_pos"), F.max("total").alias("n")]


def _ranking_metrics() -> list[Column]:
    return [
        safe_div("__ap", "n_pos").alias("average_precision"),
        F.try_divide(F.col("__auc"), F.col("n_pos") * (F.col("n") - F.col("n_pos")).cast("double")).alias("roc_auc")]


def curve_metrics(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision by steps and ROC AUC with tied ranks."""
    return curve.groupBy(*keys).agg(*_ranking_sums()).select(*keys, *_ranking_metrics(), "n", "n_pos")


def best_split_metrics(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every metric at the best-F1 threshold (strictly above it), from the curve alone.

    The curve row of the threshold already holds the counts at or above it, so
    the scores are read once however many metrics are wanted.
    """
    c = with_precision_recall(curve)
    best = F.min_by(F.struct("threshold", "tp", "flagged", "pos", "n"), F.struct(-F.col("f1"), F.col("threshold")))
    a = c.groupBy(*keys).agg(best.alias("__b"), *_ranking_sums())
    tp = F.col("__b.tp") - F.col("__b.pos")
    flagged = F.col("__b.flagged") - F.col("__b.n")
    a = a.withColumns({"tp": tp, "fp": flagged - tp, "fn": F.col("n_pos") - tp, "tn": F.col("n") - F.col("n_pos") - flagged + tp})
    return a.select(*keys, F.col("__b.threshold").alias("threshold"), *_hard(), *_ranking_metrics(), (F.col("n_pos") / F.col("n")).alias("positive_ratio"))


def _hard() -> list:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    mcc = safe_div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    bal = (safe_div(tp, tp + fn) + safe_div(tn, tn + fp)) / 2.0
    return ["tp", "fp", "fn", "tn", safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), *_prf(), mcc.alias("mcc"), bal.alias("balanced_accuracy")]


def hard_metrics(df: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with MCC, balanced accuracy and the rest."""
    return df.groupBy(*keys).agg(*_counts(truth, guess)).select(*keys, *_hard())


def metrics_at(scored: DataFrame, truth: str, score: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 at a threshold (>=) with average precision and ROC AUC, all from one curve."""
    curve = score_curve(scored, truth, score, keys)
    hit = F.col("threshold") >= threshold
    tp = F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0))
    flagged = F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))
    a = curve.groupBy(*keys).agg(tp.alias("tp"), flagged.alias("__flagged"), *_ranking_sums())
    a = a.withColumns({"fp": F.col("__flagged") - F.col("tp"), "fn": F.col("n_pos") - F.col("tp")})
    return a.select(*keys, *_prf(), *_ranking_metrics())


def stratum_thresholds(scored: DataFrame, stratum: str, truth: str, score: str, strata: Sequence[str], steps: int = 19) -> DataFrame:
    """Best F1 threshold of each stratum out of a fixed ladder, on its positives and all negatives.

    Rows are first counted by stratum and by the highest ladder step they reach,
    so the ladder is walked over a table of strata x steps. Ties keep the lower step.
    """
    ladder = [round(0.05 + 0.05 * i, 2) for i in range(steps)]
    reach = F.size(F.filter(F.array(*[F.lit(t) for t in ladder]), lambda t: F.col(score) >= t))
    small = scored.groupBy(stratum, F.col(truth).alias("__y"), reach.alias("__k")).agg(F.count("*").alias("__n"))
    target = F.when(F.col("__y") == 0, F.array(*[F.lit(s) for s in strata])).otherwise(F.array(F.col(stratum)))
    rows = small.select(F.explode(target).alias("stratum"), "__y", "__k", "__n").filter(F.col("stratum").isin(*strata))
    present = scored.filter(F.col(stratum).isin(*strata)).select(F.col(stratum).alias("stratum")).distinct()
    rows = rows.join(present, "stratum", "left_semi")
    step = F.posexplode(F.array(*[F.lit(t) for t in ladder])).alias("__i", "threshold")
    full = rows.select("*", step)
    hit = F.col("__k") > F.col("__i")
    pos = F.col("__y") == 1
    c = full.groupBy("stratum", "threshold").agg(
        F.sum(F.when(hit & pos, F.col("__n")).otherwise(0)).alias("tp"), F.sum(F.when(hit & ~pos, F.col("__n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & pos, F.col("__n")).otherwise(0)).alias("fn"))
    f1 = safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.withColumn("f1", f1).groupBy("stratum").agg(
        F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")).select("stratum", "b.*")


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, stratum: str, score: str, default: float = 0.5) -> DataFrame:
    """Per-row guess by the threshold of its stratum; other strata use the default."""
    t = thresholds.select(F.col("stratum").alias(stratum), F.col("threshold").alias("__t"))
    return scored.join(t, stratum, "left").withColumn("guess", (F.col(score) >= F.coalesce("__t", F.lit(default))).cast("int")).drop("__t")


def lift_over(results: DataFrame, baseline: str, metrics: Sequence[str], name: str = "label") -> DataFrame:
    """Difference of each row to the baseline row."""
    base = results.filter(F.col(name) == baseline).select(F.struct(*metrics)).scalar()
    return results.withColumn("__b", base).select("*", *[(F.col(m) - F.col(f"__b.{m}")).alias(f"lift_{m}") for m in metrics]).drop("__b")
