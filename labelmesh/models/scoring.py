"""Scoring of new items with fixed parameters, and the Naive Bayes baseline."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from labelmesh.functions import arrays
from labelmesh.functions.special import digamma, digamma_value
from labelmesh.models.variational import Fit, machine_scores, prior_scores, vocab_weights
from labelmesh.operators import counts, joins, votes
from labelmesh.priors import Priors
from labelmesh.runtime import cut, scalars
from labelmesh.skew import ROWS_PER_SPLIT, Spread


@dataclass
class PointModel:
    """Point estimates: log theta, log confusion per (annotator_id, label), log word weights, log mu."""

    n_labels: int
    log_theta: list[float]
    labels: DataFrame
    unknown: list[list[float]]
    words: DataFrame | None = None
    log_mu: list[list[float]] | None = None
    spread: Spread | None = None


@dataclass
class ClassifierModel:
    """Coefficients by feature with intercepts, and log confusion per (annotator_id, label) unless annotations are features."""

    n_labels: int
    intercepts: list[float]
    weights: DataFrame
    labels: DataFrame | None
    unknown: list[list[float]]
    spread: Spread | None = None


def training_spread(soft: DataFrame, n_labels: int, rows_per_split: int | None = None) -> Spread:
    """Split of the (annotator, label) keys that are hot in the training annotations, from their soft counts.

    A stream cannot be counted before it runs, so its join with the model takes this plan.
    """
    limit = rows_per_split or ROWS_PER_SPLIT
    sized = soft.select("annotator_id", "label", F.expr(arrays.total(arrays.cells("c", n_labels))).alias("_rows"))
    hot = cut(sized.filter(F.col("_rows") > limit).select(
        "annotator_id", "label", F.ceil(F.col("_rows") / limit).cast("int").alias("_splits")), "hot_keys")
    rows = hot.count()
    return Spread(["annotator_id", "label"], ["item_id"], hot if rows else None, rows)


def log_confusion(confusion: DataFrame, n_labels: int) -> DataFrame:
    """(annotator_id, label, w): log of the row-normalised confusion, one entry per true class."""
    norm = counts.normalize_rows(confusion)
    w = arrays.array([f"max(CASE WHEN truth = {k} THEN ln(value) END)" for k in range(n_labels)])
    return norm.groupBy("annotator_id", "label").agg(F.expr(w).alias("w"))


def log_words(vocab: DataFrame, n_labels: int, n_features: int, priors: Priors) -> DataFrame:
    one = vocab.agg(arrays.sum_arrays("c", n_labels).alias("t"))
    totals = [math.log(t + n_features * priors.b_phi) for t in scalars(one, "t", n_labels)]
    b = arrays.num(priors.b_phi)
    w = [f"ln({c} + {b}) - {arrays.num(t)}" for c, t in zip(arrays.cells("c", n_labels), totals)]
    return vocab.select("feature", F.expr(arrays.array(w)).alias("w"))


def point_model(fit: Fit) -> PointModel:
    k = fit.n_labels
    total = sum(fit.class_prior)
    labels = cut(log_confusion(fit.confusion(), k), "label_weights")
    model = PointModel(k, [math.log(v / total) for v in fit.class_prior], labels, _log_rows(fit.priors, k, math.log), spread=training_spread(fit.soft, k))
    if fit.vocab is not None:
        model.words = log_words(fit.vocab, k, fit.n_features, fit.priors)
    if fit.machine_cells is not None:
        rows = [fit.machine_cells[a * k:(a + 1) * k] for a in range(k)]
        model.log_mu = [[math.log(v / sum(r)) for v in r] for r in rows]
    return model


def expected_model(fit: Fit) -> PointModel:
    """Like :func:`point_model` with expected log parameters under the variational posterior."""
    k = fit.n_labels
    labels = cut(_expected_log_confusion(fit.confusion(), k), "label_weights")
    model = PointModel(k, prior_scores(fit.class_prior), labels, _log_rows(fit.priors, k, digamma_value), spread=training_spread(fit.soft, k))
    if fit.vocab is not None:
        model.words = vocab_weights(fit.vocab, k, fit.n_features, fit.priors)
    if fit.machine_cells is not None:
        model.log_mu = machine_scores(fit.machine_cells, k)
    return model


def _log_rows(priors: Priors, k: int, log) -> list[list[float]]:
    """Rows by label, entries by truth, of the prior confusion's ``log``."""
    diag, off = priors.annotator_cell(k)
    row = log(diag + (k - 1) * off)
    return [[log(diag if t == a else off) - row for t in range(k)] for a in range(k)]


def _expected_log_confusion(grid: DataFrame, k: int) -> DataFrame:
    """(annotator_id, label, w): digamma of the cell less that of its row, by truth."""
    staged = grid.withColumn("t", F.expr("sum(value) OVER (PARTITION BY annotator_id, truth)"))
    logs = staged.withColumn("v", F.expr(f"{digamma('value')} - {digamma('t')}"))
    return logs.groupBy("annotator_id", "label").agg(F.expr(arrays.array([f"max(CASE WHEN truth = {c} THEN v END)" for c in range(k)])).alias("w"))


def classifier_model(fit) -> ClassifierModel:
    """What a classifier-backed fit (:class:`labelmesh.models.loglinear.LogLinearFit`) says about items it has not seen."""
    from labelmesh.models import loglinear

    k, labels, unknown = fit.n_labels, None, []
    if fit.kind == loglinear.EXPECTED:
        labels, unknown = cut(_expected_log_confusion(fit.confusion, k), "label_weights"), _log_rows(fit.priors, k, digamma_value)
    elif fit.kind == loglinear.POINT:
        labels, unknown = cut(log_confusion(fit.confusion, k), "label_weights"), _log_rows(fit.priors, k, math.log)
    return ClassifierModel(k, fit.intercepts, fit.weights, labels, unknown, training_spread(fit.soft, k))


def feature_scores(features: DataFrame, model: ClassifierModel) -> DataFrame:
    """Per feature row (item_id, e): its sparse product with the coefficients. Features the model lacks are skipped."""
    k, rows = model.n_labels, model.weights.count()
    if joins.fits_broadcast(rows, 8 * k + 64):
        joined = features.join(F.broadcast(model.weights), "feature")
    elif features.isStreaming:
        joined = features.join(model.weights, "feature")
    else:
        joined = Spread.plan(features, ["feature"], ["item_id"]).join(features, model.weights)
    return joined.select("item_id", arrays.scaled("w", "value", k).alias("e"))


def evidence_rows(model: PointModel | ClassifierModel, annotations: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """(item_id, e) rows, in batch or arriving, whose sums per item are added to :func:`offsets`."""
    from labelmesh.models.loglinear import all_features, annotation_features

    parts = []
    if isinstance(model, PointModel):
        if model.log_mu is not None:
            raise ValueError("a model with two classes has no additive evidence: use score_items")
        if features is not None and model.words is not None:
            parts.append(joins.feature_terms(features, model.words, model.n_labels))
    elif model.labels is None:
        every = all_features(annotations, features) if annotations is not None and features is not None else None
        words = every if every is not None else annotation_features(annotations) if features is None else features.withColumn(
            "feature", F.concat(F.lit("word:"), F.col("feature").cast("string")))
        return feature_scores(words, model)
    elif features is not None:
        parts.append(feature_scores(features, model))
    if annotations is not None:
        parts.append(annotation_scores(annotations, model))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def offsets(model: PointModel | ClassifierModel) -> list[float]:
    """Log weight of each class before any evidence."""
    return model.log_theta if isinstance(model, PointModel) else model.intercepts


def score_evidence(summed: DataFrame, model: PointModel | ClassifierModel) -> DataFrame:
    """(item_id, p) from (item_id, evidence)."""
    k = model.n_labels
    scores = [f"{arrays.num(t)} + coalesce({e}, 0D)" for t, e in zip(offsets(model), arrays.cells("evidence", k))]
    return arrays.softmax(summed.select("item_id", F.expr(arrays.array(scores)).alias("_s")), "_s", "p", k)


def score_items_classifier(features: DataFrame, model: ClassifierModel, items: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """(item_id, p) of new items under a classifier-backed model; an item with neither features nor annotations gets the
    intercepts alone, one without annotations the classifier alone."""
    summed = joins.sum_terms(evidence_rows(model, annotations, features), model.n_labels)
    return score_evidence(items.select("item_id").distinct().join(summed, "item_id", "left"), model)


#: alternations between the two classes of a new item (fixed value)
ALTERNATIONS = 10


def score_items_expected(annotations: DataFrame, fit: Fit, items: DataFrame | None = None,
                         features: DataFrame | None = None) -> DataFrame:
    """(item_id, p): posterior of new items with the variational parameters held fixed.

    With a second class the item's two posteriors are refined in turn, starting from unnormalised ones.
    """
    model = expected_model(fit)
    if model.log_mu is None:
        return score_items(annotations, model, items, features)
    k, num = model.n_labels, arrays.num
    now = _item_evidence(annotations, model, items, features)
    if k <= arrays.UNROLLED_CLASSES:
        g = arrays.array([
            arrays.total([num(model.log_theta[a]), f"ye[{a}]", *[f"_s.h[{m}] * {num(model.log_mu[a][m])}" for m in range(k)]])
            for a in range(k)
        ])
        h = arrays.array([
            arrays.total([f"me[{m}]", *[f"_g[{a}] * {num(model.log_mu[a][m])}" for a in range(k)]]) for m in range(k)
        ])
    else:
        theta = arrays.array([num(v) for v in model.log_theta])
        g = f"transform({arrays.times(model.log_mu, '_s.h')}, (x, i) -> {theta}[i] + ye[i] + x)"
        h = f"transform({arrays.times([list(c) for c in zip(*model.log_mu)], '_g')}, (x, i) -> me[i] + x)"
    both = f"named_struct('g', _g, 'h', {arrays.softmax_text(h)})"
    start = f"named_struct('g', {arrays.zeros(k)}, 'h', {arrays.array([num(math.e)] * k)})"
    turns = f"aggregate(sequence(1, {ALTERNATIONS}), {start}, (_s, i) -> {arrays.let(arrays.softmax_text(g), '_g', both)})"
    return now.select("item_id", F.expr(f"{turns}.g").alias("p"))


def annotation_scores(annotations: DataFrame, model: PointModel | ClassifierModel) -> DataFrame:
    """Per annotation row (item_id, e). Annotators the model has not seen count with the prior confusion."""
    k = model.n_labels
    rows = model.labels.count()
    prior = "CASE " + " ".join(
        f"WHEN label = {a} THEN {arrays.array([arrays.num(v) for v in model.unknown[a]])}" for a in range(k)
    ) + " END"
    if joins.fits_broadcast(rows, 8 * k + 64):
        joined = annotations.join(F.broadcast(model.labels), ["annotator_id", "label"], "left")
    elif annotations.isStreaming:
        spread = model.spread or Spread(["annotator_id", "label"], ["item_id"], None)
        joined = spread.join(annotations, model.labels, "left")
    else:
        joined = Spread.plan(annotations, ["annotator_id", "label"], ["item_id"]).join(annotations, model.labels, "left")
    weighted = joined.withColumn("w", F.expr(f"coalesce(w, {prior})"))
    return weighted.select("item_id", arrays.scaled("w", "n", k).alias("e"))


def _item_evidence(annotations: DataFrame, model: PointModel, items: DataFrame | None, features: DataFrame | None) -> DataFrame:
    """(item_id, ye, me): annotation and word evidence, zero where there is none."""
    k, zero = model.n_labels, arrays.zeros(model.n_labels)
    y = joins.sum_terms(annotation_scores(annotations, model), k).withColumnRenamed("evidence", "ye")
    base = y if items is None else items.select("item_id").join(y, "item_id", "left")
    if features is not None and model.words is not None:
        m = joins.feature_evidence(features, model.words, k).withColumnRenamed("evidence", "me")
        base = base.join(m, "item_id", "left")
    else:
        base = base.withColumn("me", F.lit(None).cast("array<double>"))
    return base.withColumn("ye", F.expr(f"coalesce(ye, {zero})")).withColumn("me", F.expr(f"coalesce(me, {zero})"))


def score_items(annotations: DataFrame, model: PointModel, items: DataFrame | None = None,
                features: DataFrame | None = None) -> DataFrame:
    """(item_id, p): label distribution of each item under fixed parameters, with m summed out."""
    k, num = model.n_labels, arrays.num
    base = _item_evidence(annotations, model, items, features)
    if model.log_mu is None:
        scores = [arrays.total([num(model.log_theta[c]), f"ye[{c}]", f"me[{c}]"]) for c in range(k)]
    else:
        base = base.withColumn("_top", F.expr(arrays.largest(arrays.cells("me", k))))
        if k <= arrays.UNROLLED_CLASSES:
            inner = [arrays.total([f"exp({num(model.log_mu[c][d])} + me[{d}] - _top)" for d in range(k)]) for c in range(k)]
        else:
            mu = [[math.exp(v) for v in row] for row in model.log_mu]
            base = base.withColumn("_in", F.expr(arrays.times(mu, "transform(me, v -> exp(v - _top))")))
            inner = arrays.cells("_in", k)
        scores = [arrays.total([num(model.log_theta[c]), f"ye[{c}]", f"ln({inner[c]})"]) for c in range(k)]
    scored = base.select("item_id", F.expr(arrays.array(scores)).alias("_s"))
    return arrays.softmax(scored, "_s", "p", k)


def naive_bayes(features: DataFrame, labels: DataFrame, items: DataFrame, n_labels: int,
                label_all: bool = False) -> DataFrame:
    """Multinomial Naive Bayes with add-one smoothing trained on ``labels`` (item_id, label).

    Labelled items keep their label unless ``label_all``; the rest get the classifier's.
    """
    k = n_labels
    features, labels = cut(features, "features"), cut(labels, "labels")
    hard = joins.one_hot(labels, k)
    vocab = cut(joins.soft_vocab_counts(features, hard, k, Spread.plan(features, ["item_id"], ["feature"])), "vocab")
    n_features = features.select("feature").distinct().count()
    sizes = scalars(joins.class_sums(hard, k), "c", k)
    log_prior = [math.log((s + 1.0) / (sum(sizes) + k)) for s in sizes]
    weights = log_words(vocab, k, n_features, Priors(b_phi=1.0))
    unseen = scalars(vocab.agg(arrays.sum_arrays("c", k).alias("t")), "t", k)
    base = [-math.log(t + n_features) for t in unseen]
    # words that occur only outside the training items still count with their smoothed weight
    only_new = features.select("feature").distinct().join(vocab.select("feature"), "feature", "left_anti")
    flat = F.expr(arrays.array([arrays.num(b) for b in base]))
    weights = weights.unionByName(only_new.select("feature", flat.alias("w")))
    evidence = items.select("item_id").join(joins.feature_evidence(features, weights, k), "item_id", "left")
    evidence = evidence.withColumn("evidence", F.expr(f"coalesce(evidence, {arrays.zeros(k)})"))
    scores = [f"{arrays.num(p)} + {e}" for p, e in zip(log_prior, arrays.cells("evidence", k))]
    guess = evidence.select("item_id", F.expr(arrays.array(scores)).alias("s"))
    out = guess.select("item_id", arrays.argmax("s").alias("guess"), "s")
    if label_all:
        return out.select("item_id", F.col("guess").alias("label"), "s")
    return out.join(labels.select("item_id", "label"), "item_id", "left").select(
        "item_id", F.coalesce("label", "guess").alias("label"), "s"
    )


def naive_bayes_baseline(annotations: DataFrame, features: DataFrame, items: DataFrame, n_labels: int,
                         label_all: bool = False) -> DataFrame:
    return naive_bayes(features, votes.majority_vote(annotations), items, n_labels, label_all)
