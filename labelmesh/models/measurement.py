"""Variational model of measurements with one Gaussian noise level per annotator.

Every step refits class weights, then annotator noise, then item posteriors. Annotations decouple over
items and are exact; words, locations and proportions couple items, so all items move together, damped by
``rho`` and optionally one hashed half at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from labelmesh.functions import arrays, rand
from labelmesh.functions.special import digamma, lgamma
from labelmesh.models import bounds
from labelmesh.models.variational import prior_scores
from labelmesh.operators import joins, measurements as ms
from labelmesh.operators.votes import log_vote
from labelmesh.priors import Priors
from labelmesh.runtime import Rolling, cut, scalars
from labelmesh.skew import Spread

#: inverse-gamma prior of the trusted annotator (fixed values)
TRUSTED_ALPHA, TRUSTED_BETA = 1e6, 1.1


#: a measurement kind: (its measurements, items) -> (targets, ranges)
Kind = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class MeasurementModel:
    n_labels: int
    priors: Priors
    items: DataFrame
    n_items: int
    counts: DataFrame
    n_annotators: int
    own: DataFrame
    coupled: DataFrame | None
    proportions: DataFrame | None
    by_item: Spread
    by_item_coupled: Spread | None
    trusted: object = None
    rolling: Rolling = field(default_factory=lambda: Rolling("measured"))
    expectations: Rolling = field(default_factory=lambda: Rolling("expectations", keep=1))
    meetings: Rolling = field(default_factory=lambda: Rolling("meetings", keep=1))
    noises: Rolling = field(default_factory=lambda: Rolling("noise"))
    noise: DataFrame | None = None
    theta: list[float] | None = None

    @classmethod
    def build(cls, measurements: DataFrame, items: DataFrame, n_labels: int, features: DataFrame | None = None,
              priors: Priors = Priors(), trusted=None, pre_scaled: bool = False,
              more_kinds: dict[str, Kind] | None = None) -> "MeasurementModel":
        """``trusted``: annotator id with a fixed, very small noise; None for no such annotator.

        ``more_kinds``: for every further kind a function of its measurements and the items that gives its
        targets (meas_id, item_id, sigma) and ranges (meas_id, range).
        """
        kinds = {r["kind"] for r in measurements.select("kind").distinct().collect()}
        base = cut(items.select("item_id").distinct(), "items")
        n_items = base.count()
        counts = cut(ms.measurement_counts(measurements), "measurement_counts")
        own = cut(
            measurements.filter(F.col("kind") == ms.ANNOTATION).select("item_id", "annotator_id", "label", F.col("value").alias("tau")),
            "own",
        )
        coupled = props = by_coupled = None
        if kinds & {ms.PREDICATE, ms.LOCATION}:
            rest = measurements.filter(F.col("kind").isin(ms.PREDICATE, ms.LOCATION))
            words = features if ms.PREDICATE in kinds else None
            targets = cut(ms.measurement_targets(rest, items, words), "targets")
            scaled = ms.scale_measurements(targets, rest, ms.measurement_ranges(targets, rest, words), pre_scaled)
            coupled = cut(scaled.select("meas_id", "annotator_id", "label", "item_id", "sigma", "tau"), "coupled")
        for name, kind in (more_kinds or {}).items():
            mine = measurements.filter(F.col("kind") == name)
            targets, ranges = kind(mine, items)
            head = mine.select("meas_id", "annotator_id", "label")
            scaled = ms.scale_measurements(joins.attach(targets, head, ["meas_id"], ["item_id"], 4), mine, ranges, pre_scaled)
            part = scaled.select("meas_id", "annotator_id", "label", "item_id", "sigma", "tau")
            coupled = cut(part if coupled is None else coupled.unionByName(part), "coupled")
        if coupled is not None:
            by_coupled = Spread.plan(coupled, ["item_id"], ["meas_id"])
        if ms.PROPORTION in kinds:
            tau = F.col("value") if pre_scaled else F.col("value") / n_items
            props = cut(measurements.filter(F.col("kind") == ms.PROPORTION).select("annotator_id", "label", tau.alias("tau")), "props")
        model = cls(n_labels, priors, base, n_items, counts, counts.count(), own, coupled, props,
                    Spread.plan(own, ["item_id"], ["annotator_id", "label"]), by_coupled, trusted)
        votes = own.select("item_id", "label", F.col("tau").alias("value"))
        model.rolling.push(log_vote(votes, base, n_labels))
        return model

    @property
    def posterior(self) -> DataFrame:
        return self.rolling.last

    # -- one step -------------------------------------------------------------------------------

    def _expectations(self, joined: DataFrame) -> DataFrame:
        """Coupled measurements: (meas_id, annotator_id, tau, e, err), summed over their targets."""
        sums = joined.groupBy("meas_id", "annotator_id", "tau").agg(
            F.sum("sp").alias("e"), F.sum(F.expr("sp * sp")).alias("q"), F.sum(F.expr("sigma * sp")).alias("s")
        )
        return sums.withColumn("err", F.expr("tau * tau - 2D * tau * e + e * e - q + s"))

    def _fit_noise(self, errors: DataFrame) -> DataFrame:
        """(annotator_id, alpha, beta) of the inverse gamma."""
        alpha0, beta0 = self._noise_prior()
        total = errors.groupBy("annotator_id").agg(F.sum("err").alias("err"))
        return self.counts.join(total, "annotator_id", "left").select(
            "annotator_id", F.expr(f"n / 2D + {alpha0}").alias("alpha"),
            F.expr(f"{beta0} + 0.5D * coalesce(err, 0D)").alias("beta"),
        )

    def _by_label(self, rows: DataFrame, value: str) -> DataFrame:
        """(item_id, e): the row's value in the slot of its label."""
        slots = [f"CASE WHEN label = {c} THEN {value} ELSE 0D END" for c in range(self.n_labels)]
        return rows.select("item_id", F.expr(arrays.array(slots)).alias("e"))

    def _look(self, p: DataFrame) -> dict:
        """Everything a posterior implies for the measurements: class sums, expectations, squared errors."""
        k = self.n_labels
        sums = scalars(joins.class_sums(p, k), "c", k)
        own = self.by_item.join(self.own, p).withColumn("_p", F.expr("p[label]"))
        errors = own.select("annotator_id", F.expr("tau * tau - 2D * tau * _p + _p").alias("err"))
        per_meas = joined = shares = None
        if self.coupled is not None:
            # stored: the expectations and then the items' terms read it
            joined = self.meetings.push(self.by_item_coupled.join(self.coupled, p).select(
                "meas_id", "annotator_id", "label", "item_id", "sigma", "tau", F.expr("sigma * p[label]").alias("sp")))
            per_meas = self.expectations.push(self._expectations(joined))
            errors = errors.unionByName(per_meas.select("annotator_id", "err"))
        if self.proportions is not None:
            squares = scalars(p.agg(F.expr(arrays.array([f"sum({c} * {c})" for c in arrays.cells("p", k)])).alias("c")), "c", k)
            n = arrays.num(self.n_items)
            totals, second = (arrays.array([arrays.num(v) for v in vs]) for vs in (sums, squares))
            shares = self.proportions.withColumn("e", F.expr(f"{totals}[label] / {n}")).withColumn(
                "err", F.expr(f"tau * tau - 2D * tau * e + e * e - {second}[label] / ({n} * {n}) + e / {n}")
            )
            errors = errors.unionByName(shares.select("annotator_id", "err"))
        return {"sums": sums, "errors": errors, "per_meas": per_meas, "joined": joined, "shares": shares}

    def _noise_prior(self) -> tuple[str, str]:
        """SQL text of each annotator's prior shape and scale."""
        a0, b0 = arrays.num(self.priors.b_gamma), arrays.num(self.priors.c_gamma)
        if self.trusted is None:
            return a0, b0
        own = f"annotator_id = {self.trusted!r}"
        return (f"CASE WHEN {own} THEN {TRUSTED_ALPHA!r}D ELSE {a0} END",
                f"CASE WHEN {own} THEN {TRUSTED_BETA!r}D ELSE {b0} END")

    def bound(self) -> float:
        """Lower bound of the current class weights, noise and posterior."""
        k, p = self.n_labels, self.posterior
        seen = self._look(p)
        expected = prior_scores(self.theta)
        b = self.priors.b_theta
        value = bounds._log_beta(self.theta) - bounds._log_beta([b] * k)
        value += sum(e * (b + s - t) for e, s, t in zip(expected, seen["sums"], self.theta))
        errors = seen["errors"].groupBy("annotator_id").agg(F.sum("err").alias("err"))
        a0, b0 = self._noise_prior()
        rows = self.noise.join(self.counts, "annotator_id").join(errors, "annotator_id", "left").select(
            "alpha", "beta", "n", F.expr("coalesce(err, 0D)").alias("err"), F.expr(a0).alias("a0"), F.expr(b0).alias("b0")
        ).withColumn("psi", F.expr(digamma("alpha")))
        per = (
            f"a0 * ln(b0) - {lgamma('a0')} - n / 2D * ln(2D * pi()) - (a0 + n / 2D + 1D) * (ln(beta) - psi) "
            f"- alpha / beta * (b0 + 0.5D * err) + {lgamma('alpha')} - psi * (alpha + 1D) + ln(beta) + alpha"
        )
        return value + bounds._one(rows, f"sum({per})") + bounds.entropy(p, "p", k)

    def step(self, rho: float | None = None, half: int | None = None) -> "MeasurementModel":
        k, p = self.n_labels, self.posterior
        if rho is None:
            rho = 1.0 if self.coupled is None and self.proportions is None else 0.5
        seen = self._look(p)
        sums, per_meas, joined, shares = seen["sums"], seen["per_meas"], seen["joined"], seen["shares"]
        self.theta = [self.priors.b_theta + v for v in sums]
        self.noise = self.noises.push(self._fit_noise(seen["errors"]))

        weight = self.noise.select("annotator_id", F.expr("alpha / (2D * beta)").alias("w"))
        rows = self._attach_noise(self.own, weight, ["item_id"])
        terms = self._by_label(rows, "w * (2D * tau - 1D)")
        if self.coupled is not None:
            expected = self._attach_noise(per_meas.select("meas_id", "annotator_id", "e"), weight, ["meas_id"]).select("meas_id", "e", "w")
            full = joins.attach(joined.drop("annotator_id"), expected, ["meas_id"], ["item_id"], 2)
            terms = terms.unionByName(self._by_label(full, "w * (2D * tau * sigma - sigma * sigma - 2D * sigma * (e - sp))"))
        flat, slope = [0.0] * k, [0.0] * k
        if self.proportions is not None:
            n = arrays.num(self.n_items)
            weighted = self._attach_noise(shares, weight, ["label"])
            per = weighted.agg(
                arrays.count_by_class("label", f"w * (2D * tau / {n} - 1D / ({n} * {n}) - 2D * e / {n})", k).alias("c"),
                arrays.count_by_class("label", f"w * 2D / ({n} * {n})", k).alias("d"),
            )
            flat, slope = scalars(per, "c", k), scalars(per, "d", k)
        summed = joins.sum_terms(terms, k)
        base = p.join(summed, "item_id", "left").withColumn("evidence", F.expr(f"coalesce(evidence, {arrays.zeros(k)})"))
        num, offsets = arrays.num, prior_scores(self.theta)
        fresh = [f"({num(offsets[c] + flat[c])} + {num(slope[c])} * p[{c}] + evidence[{c}])" for c in range(k)]
        if rho != 1.0:
            # p can underflow to zero; its log is then taken at the smallest normal double
            old = [f"ln(greatest(p[{c}], 2.2250738585072014E-308D))" for c in range(k)]
            top = arrays.largest(fresh)
            fresh = [f"({num(1.0 - rho)} * {o} + {num(rho)} * ({f} - {top}))" for o, f in zip(old, fresh)]
        scored = base.select("item_id", F.col("p").alias("old"), F.expr(arrays.array(fresh)).alias("s"))
        moved = arrays.softmax(scored, "s", "p", k)
        if half is not None:
            mine = f"{rand.hash_text('measure-half', 'item_id')} % 2 = {half}"
            moved = moved.withColumn("p", F.expr(f"CASE WHEN {mine} THEN p ELSE old END"))
        self.rolling.push(moved.select("item_id", "p"))
        return self

    def _attach_noise(self, rows: DataFrame, weight: DataFrame, by: list[str]) -> DataFrame:
        return joins.attach(rows, weight, ["annotator_id"], by, 2, self.n_annotators)

    # -- results --------------------------------------------------------------------------------

    def annotator_variance(self) -> DataFrame:
        """Mean of each annotator's noise: beta / (alpha - 1); lower is better."""
        return annotator_variance(self.noise)

    def class_ranking(self) -> list[int]:
        """Label order for items outside the corpus: by class weight."""
        return sorted(range(self.n_labels), key=lambda c: (-self.theta[c], c))


def annotator_variance(noise: DataFrame) -> DataFrame:
    return noise.select("annotator_id", F.expr("CASE WHEN alpha > 1 THEN beta / (alpha - 1) END").alias("variance"))


def measurement_vb(measurements: DataFrame, items: DataFrame, n_labels: int, features: DataFrame | None = None,
                   priors: Priors = Priors(), iterations: int = 10, rho: float | None = None, trusted=None,
                   pre_scaled: bool = False, halves: bool = False) -> MeasurementModel:
    model = MeasurementModel.build(measurements, items, n_labels, features, priors, trusted, pre_scaled)
    for _ in range(iterations):
        if halves:
            model.step(rho, 0).step(rho, 1)
        else:
            model.step(rho)
    return model
