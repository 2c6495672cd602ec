"""Mean-field label models: labels only, with a bag of words, and with a second latent class.

Every step is a join of the laid-out corpus with small parameter tables, an aggregation per item and an
aggregation per annotator (or word). Only arrays of one number per class come back to the driver. Each
generation of the posterior is written to the shared folder, so plans stay flat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from labelmesh.functions import arrays
from labelmesh.functions.special import digamma, digamma_value
from labelmesh.models.corpus import Corpus, laid_by_item
from labelmesh.operators import counts, joins
from labelmesh.priors import Priors
from labelmesh.runtime import Rolling, cut, scalars


@dataclass
class Fit:
    """A fitted model: item posteriors and the parameters that go with them."""

    n_labels: int
    priors: Priors
    posterior: DataFrame
    class_prior: list[float]
    soft: DataFrame
    annotators: DataFrame
    vocab: DataFrame | None = None
    n_features: int = 0
    machine: DataFrame | None = None
    machine_cells: list[float] | None = None

    def confusion(self) -> DataFrame:
        """Unnormalised confusion (annotator_id, truth, label, value) on the full grid."""
        cell = self.priors.annotator_cell(self.n_labels)
        return counts.confusion_grid(self.soft, self.annotators, self.n_labels, *cell)

    def class_table(self) -> DataFrame:
        spark = self.posterior.sparkSession
        return spark.createDataFrame(list(enumerate(self.class_prior)), "truth int, value double")

    def machine_table(self) -> DataFrame:
        spark = self.posterior.sparkSession
        k = self.n_labels
        rows = [(i // k, i % k, v) for i, v in enumerate(self.machine_cells)]
        return spark.createDataFrame(rows, "truth int, m int, value double")

    def annotator_accuracy(self) -> DataFrame:
        return counts.annotator_accuracy(counts.normalize_rows(self.confusion()), self.class_table())

    def machine_accuracy(self) -> DataFrame:
        """Class-prior weighted diagonal of the row-normalised machine confusion."""
        norm = Window.partitionBy("truth")
        table = self.machine_table().withColumn("value", F.col("value") / F.sum("value").over(norm))
        return counts.machine_accuracy(table, self.class_table())

    def weights(self) -> DataFrame:
        """Expected log confusion per (annotator_id, label), one entry per true class."""
        return confusion_weights(self.soft, self.n_labels, self.priors)


def confusion_weights(soft: DataFrame, n_labels: int, priors: Priors) -> DataFrame:
    """psi(cell) - psi(row total) for every seen (annotator_id, label) and true class."""
    diag, off = priors.annotator_cell(n_labels)
    cells = arrays.cells("c", n_labels)
    prior_row = arrays.num(diag + (n_labels - 1) * off)
    totals = [f"sum({c}) OVER (PARTITION BY annotator_id) + {prior_row}" for c in cells]
    priored = [f"{c} + CASE WHEN label = {k} THEN {arrays.num(diag)} ELSE {arrays.num(off)} END" for k, c in enumerate(cells)]
    staged = soft.select(
        "annotator_id", "label", F.expr(arrays.array(priored)).alias("v"), F.expr(arrays.array(totals)).alias("t")
    )
    w = [f"{digamma(v)} - {digamma(t)}" for v, t in zip(arrays.cells("v", n_labels), arrays.cells("t", n_labels))]
    return staged.select("annotator_id", "label", F.expr(arrays.array(w)).alias("w"))


def vocab_weights(vocab: DataFrame, n_labels: int, n_features: int, priors: Priors) -> DataFrame:
    """psi(b_phi + count) - psi(total) per word and class."""
    one = vocab.agg(arrays.sum_arrays("c", n_labels).alias("t"))
    totals = [digamma_value(t + n_features * priors.b_phi) for t in scalars(one, "t", n_labels)]
    b_phi = arrays.num(priors.b_phi)
    w = [f"{digamma(f'({c} + {b_phi})')} - {arrays.num(t)}" for c, t in zip(arrays.cells("c", n_labels), totals)]
    return vocab.select("feature", F.expr(arrays.array(w)).alias("w"))


def class_prior(posterior: DataFrame, n_labels: int, priors: Priors) -> list[float]:
    return [priors.b_theta + v for v in scalars(joins.class_sums(posterior, n_labels), "c", n_labels)]


def prior_scores(pi: list[float]) -> list[float]:
    """psi(pi_k) - psi(sum pi)."""
    top = digamma_value(sum(pi))
    return [digamma_value(v) - top for v in pi]


def _posterior(evidence: DataFrame, offsets: list[float], n_labels: int) -> DataFrame:
    scores = [f"{arrays.num(o)} + {e}" for o, e in zip(offsets, arrays.cells("evidence", n_labels))]
    scored = evidence.select("item_id", F.expr(arrays.array(scores)).alias("_s"))
    return arrays.softmax(scored, "_s", "p", n_labels)


def item_resp_vb(annotations: DataFrame, items: DataFrame, n_labels: int, priors: Priors = Priors(),
                 iterations: int = 10, rows_per_split: int | None = None, tune=None) -> Fit:
    """Label-only model. One iteration = parameters from the posterior, then the posterior from them."""
    return _fit(annotations, items, n_labels, priors, iterations, None, rows_per_split, tune)


def mom_resp_vb(annotations: DataFrame, features: DataFrame, items: DataFrame, n_labels: int,
                priors: Priors = Priors(), iterations: int = 10, rows_per_split: int | None = None,
                tune=None) -> Fit:
    """Labels plus a per-class multinomial over words (negative values are rescaled to 0..100 first)."""
    from labelmesh.operators.prep import rescale_features

    stored = Rolling("features")
    bag = features if laid_by_item(features) else stored.push(features.select("item_id", "feature", "value"))
    if not bag.filter("value < 0").isEmpty():
        bag = stored.push(rescale_features(bag))
    fit = _fit(annotations, items, n_labels, priors, iterations, bag, rows_per_split, tune, written=True)
    stored.drop()
    return fit


def unit_concentration(priors: Priors) -> Priors:
    """The variational models start from annotator confusion rows of total mass one."""
    return priors.with_(c_gamma=1.0)


def _fit(annotations, items, n_labels, priors, iterations, features, rows_per_split, tune, written=False) -> Fit:
    priors = unit_concentration(priors)
    corpus = Corpus.build(annotations, items, n_labels, features, rows_per_split, written)
    posteriors, vocabs = Rolling("posterior"), Rolling("vocab", keep=1)
    posteriors.push(corpus.vote_start())
    for _ in range(iterations):
        p = posteriors.last
        pi = class_prior(p, n_labels, priors)
        soft = corpus.soft_confusion(p)
        terms = [corpus.annotation_terms(confusion_weights(soft, n_labels, priors))]
        if corpus.features is not None:
            vocab = vocabs.push(corpus.soft_vocab(p))
            terms.append(corpus.feature_terms(vocab_weights(vocab, n_labels, corpus.n_features, priors)))
        evidence = corpus.item_evidence(*terms)
        posteriors.push(_posterior(evidence, prior_scores(pi), n_labels))
        if tune is not None:
            priors = tune(corpus, posteriors.last, priors)
    fit = _finish(corpus, posteriors.last, priors)
    corpus.release()
    return fit


def _finish(corpus: Corpus, posterior: DataFrame, priors: Priors, machine: DataFrame | None = None) -> Fit:
    """Parameters that match the final posterior, cut so the fit can be used and saved cheaply."""
    k = corpus.n_labels
    fit = Fit(k, priors, posterior, class_prior(posterior, k, priors),
              cut(corpus.soft_confusion(posterior), "soft"), cut(corpus.annotators(), "annotators"))
    if corpus.features is not None:
        fit.vocab = cut(corpus.soft_vocab(posterior if machine is None else machine.select(
            "item_id", F.col("h").alias("p"))), "vocab")
        fit.n_features = corpus.n_features
    return fit


def multi_resp_vb(annotations: DataFrame, features: DataFrame, items: DataFrame, n_labels: int,
                  start: DataFrame, priors: Priors = Priors(), iterations: int = 10,
                  rows_per_split: int | None = None, tune=None) -> Fit:
    """Adds a second latent class per item (posterior ``h``) that explains the words.

    ``start`` gives the initial h as (item_id, h). Both posteriors of an iteration are computed from the
    previous iteration's posteriors and from parameters one generation older, as in a double buffer.
    """
    priors = unit_concentration(priors)
    corpus = Corpus.build(annotations, items, n_labels, features, rows_per_split)
    k = n_labels
    state, vocabs = Rolling("posterior_pair", keep=3), Rolling("vocab", keep=1)
    state.push(corpus.vote_start().join(start.select("item_id", "h"), "item_id"))
    for _ in range(iterations):
        now = state.last
        older = state.generations[-2][0] if len(state.generations) > 1 else now
        state.push(_pair_step(corpus, now, older, priors, vocabs))
        if tune is not None:
            priors = tune(corpus, state.last.select("item_id", "p"), priors)
    pair = state.last
    fit = _finish(corpus, pair.select("item_id", "p"), priors, pair.select("item_id", "h"))
    fit.machine = pair.select("item_id", "h")
    fit.machine_cells = machine_cells(pair, k, priors)
    corpus.release()
    return fit


def machine_cells(pair: DataFrame, k: int, priors: Priors) -> list[float]:
    diag, off = priors.machine_cell(k)
    seen = scalars(joins.soft_machine_confusion(pair, k), "c", k * k)
    return [v + (diag if i // k == i % k else off) for i, v in enumerate(seen)]


def machine_scores(cells: list[float], k: int) -> list[list[float]]:
    """psi(tau_km) - psi(row sum)."""
    rows = [cells[a * k:(a + 1) * k] for a in range(k)]
    return [[digamma_value(v) - digamma_value(sum(row)) for v in row] for row in rows]


def _pair_step(corpus: Corpus, now: DataFrame, older: DataFrame, priors: Priors, vocabs: Rolling) -> DataFrame:
    k = corpus.n_labels
    p_old = older.select("item_id", "p")
    h_old = older.select("item_id", F.col("h").alias("p"))
    pi = class_prior(p_old, k, priors)
    tau = machine_scores(machine_cells(older, k, priors), k)
    vocab = vocabs.push(corpus.soft_vocab(h_old))
    y_evidence = joins.sum_terms(
        corpus.annotation_terms(confusion_weights(corpus.soft_confusion(p_old), k, priors)), k
    ).withColumnRenamed("evidence", "ye")
    m_evidence = joins.sum_terms(
        corpus.feature_terms(vocab_weights(vocab, k, corpus.n_features, priors)), k
    ).withColumnRenamed("evidence", "me")
    both = now.join(y_evidence, "item_id", "left").join(m_evidence, "item_id", "left")
    zero = arrays.zeros(k)
    both = both.withColumn("ye", F.expr(f"coalesce(ye, {zero})")).withColumn("me", F.expr(f"coalesce(me, {zero})"))
    prior, num = prior_scores(pi), arrays.num
    if k <= arrays.UNROLLED_CLASSES:
        g, h = arrays.cells("p", k), arrays.cells("h", k)
        gs = arrays.array([arrays.total([num(prior[a]), f"ye[{a}]", *[f"{h[m]} * {num(tau[a][m])}" for m in range(k)]]) for a in range(k)])
        hs = arrays.array([arrays.total([f"me[{m}]", *[f"{g[a]} * {num(tau[a][m])}" for a in range(k)]]) for m in range(k)])
    else:
        flat = arrays.array([num(v) for v in prior])
        gs = f"transform({arrays.times(tau, 'h')}, (x, i) -> {flat}[i] + ye[i] + x)"
        hs = f"transform({arrays.times([list(c) for c in zip(*tau)], 'p')}, (x, i) -> me[i] + x)"
    scored = both.select("item_id", F.expr(gs).alias("_g"), F.expr(hs).alias("_h"))
    scored = arrays.softmax(arrays.softmax(scored, "_g", "p", k), "_h", "h", k)
    return scored.select("item_id", "p", "h")


def random_simplex(items: DataFrame, n_labels: int, seed: int) -> DataFrame:
    """(item_id, h): a uniform Dirichlet draw per item, from hashed exponentials."""
    from labelmesh.functions import rand

    draws = arrays.array([f"-ln({rand.uniform_text(seed, 'item_id', str(c))})" for c in range(n_labels)])
    return items.select("item_id", F.expr(draws).alias("_e")).select(
        "item_id", arrays.normalized("_e", n_labels).alias("h")
    )


def argmax_labels(posterior: DataFrame, digits: int = 9) -> DataFrame:
    """(item_id, label): the best class, the lowest among those equal to ``digits`` places."""
    return posterior.withColumn("_r", F.expr(f"transform(p, v -> round(v, {digits}))")).select(
        "item_id", arrays.argmax("_r").alias("label")
    )
