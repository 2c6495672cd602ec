"""Synchronous sweeps over hard assignments: sampling and greedy maximisation of collapsed label models.

Counts are aggregated once per sweep; every item takes its own contribution out of them exactly, evaluates
its conditional by joins and picks a value by arg-max, with hashed Gumbel noise when sampling. All items
(or one hashed half of them) move together, so a run differs from a chain that visits items one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmesh.functions import arrays, rand
from labelmesh.functions.special import lgamma_ratio
from labelmesh.models import bounds, tuning
from labelmesh.models.corpus import Corpus, laid_by_item
from labelmesh.models.scoring import PointModel, log_confusion, log_words
from labelmesh.operators import counts, joins
from labelmesh.priors import Priors
from labelmesh.runtime import Rolling, cut, scalars

ITEM, MOM, MULTI = "item", "mom", "multi"


#: Longest vector whose entries are written out one by one; larger ones would outgrow a generated method.
UNROLLED = 16


def _ratios(df: DataFrame, vector: str, own: str, step: str, size: int, out: str, only: str | None = None) -> DataFrame:
    """Adds ``out``, the array of ln Gamma(v+step) - ln Gamma(v), the item's own amount taken out of its current class.

    ``only``: a condition for rows that need it; others get NULL.
    """
    if size <= UNROLLED:
        base = arrays.array([f"{vector}[{i}] - CASE WHEN cur = {i} THEN {own} ELSE 0D END" for i in range(size)])
        value = arrays.array([lgamma_ratio(f"_b[{i}]", step) for i in range(size)])
    else:
        base = f"transform({vector}, (v, k) -> v - CASE WHEN k = cur THEN {own} ELSE 0D END)"
        value = f"transform(_b, b -> {lgamma_ratio('b', step)})"
    value = f"CASE WHEN {only} THEN {value} END" if only else value
    return df.withColumn("_b", F.expr(base)).withColumn(out, F.expr(value)).drop("_b")


@dataclass
class Sweeper:
    """State of a run. ``kind``: labels only, words tied to y, or words through a second class m."""

    kind: str
    corpus: Corpus
    priors: Priors
    state: DataFrame
    seed: int = 0
    sweeps: int = 0
    temperature: float = 1.0
    rolling: Rolling = field(default_factory=lambda: Rolling("sweep"))
    machine_seen: list[list[float]] = field(default_factory=list)
    vocabs: Rolling = field(default_factory=lambda: Rolling("vocab", keep=1))
    counted: DataFrame | None = None  # the state whose words ``vocabs`` counts

    @classmethod
    def start(cls, kind: str, annotations: DataFrame, assignment: DataFrame, n_labels: int, priors: Priors = Priors(),
              features: DataFrame | None = None, items: DataFrame | None = None, seed: int = 0,
              rows_per_split: int | None = None) -> "Sweeper":
        """``assignment``: (item_id, y[, m]) for every item; ``items`` may add weight and observed_label."""
        pair = Window.partitionBy("item_id", "annotator_id")
        rows = annotations.select("item_id", "annotator_id", "label", "n").withColumn(
            "n_pair", F.sum("n").over(pair)
        ).withColumn("lead", F.row_number().over(pair.orderBy("label")) == 1)
        if features is not None and not laid_by_item(features):
            features = cut(features.select("item_id", "feature", "value"), "features")
        assignment = cut(assignment, "assignment")
        corpus = Corpus.build(rows, assignment, n_labels, features, rows_per_split, written=True)
        state = assignment if "m" in assignment.columns else assignment.withColumn("m", F.col("y"))
        extra = ["weight", "observed_label"]
        if items is not None:
            state = state.join(items.select("item_id", *[c for c in extra if c in items.columns]), "item_id", "left")
        if "weight" not in state.columns:
            state = state.withColumn("weight", F.lit(1.0))
        if "observed_label" not in state.columns:
            state = state.withColumn("observed_label", F.lit(None).cast("int"))
        if features is not None:
            size = features.groupBy("item_id").agg(F.sum("value").alias("size"))
            state = state.join(size, "item_id", "left").withColumn("size", F.coalesce("size", F.lit(0.0)))
        else:
            state = state.withColumn("size", F.lit(0.0))
        zeros = F.array_repeat(F.lit(0).cast("bigint"), n_labels)
        run = cls(kind, corpus, priors, state, seed)
        run.state = run.rolling.push(
            state.select("item_id", "y", "m", "weight", "observed_label", "size", zeros.alias("y_seen"), zeros.alias("m_seen"))
        )
        return run

    # -- counts ---------------------------------------------------------------------------------

    def _hard(self, column: str) -> DataFrame:
        return joins.one_hot(self.state, self.corpus.n_labels, column, "weight")

    def _label_counts(self) -> DataFrame:
        """(annotator_id, label, v, t): prior + counts and their row totals, one entry per class."""
        k = self.corpus.n_labels
        diag, off = self.priors.annotator_cell(k)
        cells, num = arrays.cells("c", k), arrays.num
        v = [f"{c} + CASE WHEN label = {i} THEN {num(diag)} ELSE {num(off)} END" for i, c in enumerate(cells)]
        t = [f"sum({c}) OVER (PARTITION BY annotator_id) + {num(diag + (k - 1) * off)}" for c in cells]
        return self.corpus.soft_confusion(self._hard("y")).select(
            "annotator_id", "label", F.expr(arrays.array(v)).alias("v"), F.expr(arrays.array(t)).alias("t")
        )

    def _vocab(self) -> DataFrame:
        """(feature, c): words by the class they are tied to, counted once until an item's class moves."""
        if self.counted is not self.state:
            self.vocabs.push(self.corpus.soft_vocab(self._hard("y" if self.kind == MOM else "m")))
            self.counted = self.state
        return self.vocabs.last

    def _move(self, state: DataFrame, *variables: str) -> None:
        """The next state, in which only ``variables`` may have other values."""
        same = self.counted is self.state and ("y" if self.kind == MOM else "m") not in variables
        self.state = self.rolling.push(state)
        self.counted = self.state if same else None

    def class_counts(self) -> list[float]:
        return [self.priors.b_theta + c for c in scalars(joins.class_sums(self._hard("y"), self.corpus.n_labels), "c",
                                                         self.corpus.n_labels)]

    def machine_cells(self) -> list[float]:
        k = self.corpus.n_labels
        diag, off = self.priors.machine_cell(k)
        seen = [0.0] * (k * k)
        for r in self.state.groupBy("y", "m").agg(F.sum("weight").alias("n")).collect():  # K*K rows at most
            seen[r["y"] * k + r["m"]] += r["n"]
        return [v + (diag if i // k == i % k else off) for i, v in enumerate(seen)]

    # -- conditionals ---------------------------------------------------------------------------

    def _y_evidence(self) -> DataFrame:
        """Per item: annotation part of the y conditional."""
        c = self.corpus
        now = self.state.select("item_id", F.col("y").alias("cur"), "weight")
        rows = c.annotations.join(c.by_item.small(now).hint("shuffle_hash"), c.by_item.on).drop("_split")
        joined = joins.attach(rows, self._label_counts(), ["annotator_id", "label"], ["item_id"], 2 * c.n_labels,
                              c.cells, c.by_cell)
        staged = _ratios(joined, "v", "weight * n", "cast(n AS double)", c.n_labels, "a")
        staged = _ratios(staged, "t", "weight * n_pair", "cast(n_pair AS double)", c.n_labels, "b", "lead")
        e = [f"a[{i}] - CASE WHEN lead THEN b[{i}] ELSE 0D END" for i in range(c.n_labels)]
        return joins.sum_terms(staged.select("item_id", F.expr(arrays.array(e)).alias("e")), c.n_labels)

    def _m_evidence(self) -> DataFrame:
        """Per item: word part of the m conditional, without the doc-length term."""
        c, k = self.corpus, self.corpus.n_labels
        column = "y" if self.kind == MOM else "m"
        vocab = self._vocab()
        totals = [t + c.n_features * self.priors.b_phi
                  for t in scalars(vocab.agg(arrays.sum_arrays("c", k).alias("t")), "t", k)]
        b = arrays.num(self.priors.b_phi)
        table = vocab.select("feature", F.expr(f"transform(c, x -> x + {b})").alias("v"))
        now = self.state.select("item_id", F.col(column).alias("cur"), "weight", "size")
        rows = c.features.join(c.by_item_features.small(now).hint("shuffle_hash"), c.by_item_features.on).drop("_split")
        joined = joins.attach(rows, table, ["feature"], ["item_id"], k, c.n_features, c.by_feature)
        terms = _ratios(joined, "v", "weight * value", "(weight * value)", k, "e").select("item_id", "e")
        both = now.join(joins.sum_terms(terms, k), "item_id").withColumn("_t", F.expr(arrays.array([arrays.num(t) for t in totals])))
        return _ratios(both, "_t", "weight * size", "(weight * size)", k, "_len").select(
            "item_id", F.expr(arrays.array([f"evidence[{i}] - _len[{i}]" for i in range(k)])).alias("me")
        )

    def conditional(self, class_scores: DataFrame | None = None) -> DataFrame:
        """State plus ``s``: the unnormalised log conditional, K entries, or K*K (y-major) for MULTI.

        An impossible value (another label than the observed one) is a NULL entry. ``class_scores``
        (item_id, lp) takes the place of the class prior where a classifier gives one.
        """
        k, kind, num = self.corpus.n_labels, self.kind, arrays.num
        both = self.state.join(self._y_evidence().withColumnRenamed("evidence", "ye"), "item_id", "left")
        both = both.withColumn("ye", F.expr(f"coalesce(ye, {arrays.zeros(k)})"))
        both = both.withColumn("cur", F.col("y"))
        if class_scores is None:
            theta = arrays.array([num(c) for c in self.class_counts()])
            both = _ratios(both.withColumn("_t", F.expr(theta)), "_t", "weight", "weight", k, "_p").drop("_t")
        else:
            both = both.join(class_scores.withColumnRenamed("lp", "_p"), "item_id")
        ys = [
            f"CASE WHEN observed_label IS NULL THEN _p[{c}] + ye[{c}] WHEN observed_label = {c} THEN 0D END" for c in range(k)
        ]
        both = both.withColumn("ys", F.expr(arrays.array(ys))).drop("_p", "ye", "cur")
        if kind == ITEM:
            return both.withColumnRenamed("ys", "s")
        both = both.join(self._m_evidence(), "item_id", "left")
        both = both.withColumn("me", F.expr(f"coalesce(me, {arrays.zeros(k)})"))
        if kind == MOM:
            return both.withColumn("s", F.expr(arrays.array([f"ys[{c}] + me[{c}]" for c in range(k)]))).drop("ys", "me")
        mu = self.machine_cells()
        pair = arrays.array([num(v) for v in mu])
        rows = arrays.array([num(sum(mu[a * k:(a + 1) * k])) for a in range(k)])
        both = _ratios(both.withColumn("cur", F.expr(f"y * {k} + m")).withColumn("_t", F.expr(pair)), "_t", "weight", "weight", k * k, "_pair")
        both = _ratios(both.withColumn("cur", F.col("y")).withColumn("_t", F.expr(rows)), "_t", "weight", "weight", k, "_row").drop("_t")
        if k <= arrays.UNROLLED_CLASSES:
            block = arrays.array([f"ys[{a}] + me[{d}] + _pair[{a * k + d}] - _row[{a}]" for a in range(k) for d in range(k)])
        else:
            block = f"flatten(transform(ys, (y, a) -> transform(_w, (w, d) -> y + w + _pr[a * {k} + d] - _rw[a])))"
            for column, name in (("me", "_w"), ("_pair", "_pr"), ("_row", "_rw")):  # bound: a lambda would compute them each time
                block = arrays.let(column, name, block)
        return both.withColumn("s", F.expr(block)).drop("ys", "me", "_pair", "_row", "cur")

    # -- moves ----------------------------------------------------------------------------------

    def set_temperature(self, temperature: float) -> None:
        """A new temperature also restarts the marginal tallies, from the current state."""
        if temperature == self.temperature:
            return
        self.temperature = temperature
        self.machine_seen.clear()
        self._move(self.state.withColumns({f"{v}_seen": self._one_more(v, fresh=True) for v in ("y", "m")}))

    def restart_tallies(self) -> None:
        """Marginal tallies start at nothing again."""
        self.machine_seen.clear()
        nothing = F.expr(arrays.array(["0L"] * self.corpus.n_labels))
        self._move(self.state.withColumns({"y_seen": nothing, "m_seen": nothing}))

    def changed(self, *variables: str) -> int:
        """Items whose last sweep gave them another value."""
        before = self.rolling.generations[-2][0].select("item_id", *(F.col(v).alias(f"_{v}") for v in variables))
        other = " OR ".join(f"{v} <> _{v}" for v in variables)
        return self.state.join(before, "item_id").filter(other).count()

    def _one_more(self, variable: str, fresh: bool = False) -> Column:
        """The tallies of y or m with the current value counted once more (or alone)."""
        before = "0L" if fresh else "{0}_seen[{1}]"
        cells = [f"{before.format(variable, c)} + CASE WHEN {variable} = {c} THEN 1L ELSE 0L END" for c in range(self.corpus.n_labels)]
        return F.expr(arrays.array(cells))

    def sweep(self, variable: str = "all", sample: bool = True, half: int | None = None,
              class_scores: DataFrame | None = None) -> "Sweeper":
        """Move y, m or both. ``half`` (0 or 1) moves only that hashed half of the items."""
        k = self.corpus.n_labels
        scored = self.conditional(class_scores)
        # a greedy move picks the largest coefficient; only sampling is annealed
        scale = arrays.num(self.temperature) if sample else "1D"
        scored = scored.withColumn("s", F.expr(f"transform(s, x -> x / {scale})"))
        size = k * k if self.kind == MULTI else k
        if self.kind == MULTI and variable in ("y", "m"):
            scored = scored.withColumn("_top", F.expr("array_max(s)"))
            if k <= arrays.UNROLLED_CLASSES:
                groups = [[f"s[{c * k + d}]" if variable == "y" else f"s[{d * k + c}]" for d in range(k)] for c in range(k)]
                sums = arrays.array([f"ln({' + '.join(f'coalesce(exp({t} - _top), 0D)' for t in g)})" for g in groups])
            else:
                place = f"c * {k} + d" if variable == "y" else f"d * {k} + c"
                each = f"aggregate(sequence(0, {k - 1}), 0D, (acc, d) -> acc + coalesce(exp(_v[{place}] - _most), 0D))"
                sums = arrays.let("s", "_v", arrays.let("array_max(_v)", "_most", f"transform(sequence(0, {k - 1}), c -> ln({each}))"))
            scored = scored.withColumn("s", F.expr(sums)).drop("_top")
            size = k
        low, drawn = "-1.7976931348623157E308D", f"{self.seed}-{self.sweeps}"
        if size <= arrays.UNROLLED_CLASSES ** 2:
            noise = [f"s[{i}] + {rand.gumbel_text(drawn, 'item_id', str(i))}" if sample else f"round(s[{i}], 9)" for i in range(size)]
            noise = arrays.array([f"coalesce({x}, {low})" for x in noise])
        else:
            noise = f"x + {rand.gumbel_text(drawn, 'item_id', 'i')}" if sample else "round(x, 9)"
            noise = f"transform(s, (x, i) -> coalesce({noise}, {low}))"
        scored = scored.withColumn("_n", F.expr(noise))
        scored = scored.withColumn("_pick", arrays.argmax("_n"))
        if self.kind == MULTI and variable == "all":
            y, m = f"cast(floor(_pick / {k}) AS int)", f"cast(_pick % {k} AS int)"
        else:
            y = "_pick" if variable in ("y", "all") else "y"
            m = "_pick" if variable in ("m", "all") or self.kind != MULTI else "m"
        if half is not None:
            mine = f"({rand.hash_text(f'{self.seed}-half', 'item_id')} % 2 = {half})"
            y, m = f"CASE WHEN {mine} THEN {y} ELSE y END", f"CASE WHEN {mine} THEN {m} ELSE m END"
        moved = scored.select("item_id", F.expr(y).alias("y"), F.expr(m).alias("m"), "weight", "observed_label", "size",
                              "y_seen", "m_seen")
        if sample:
            moved = moved.withColumns({f"{v}_seen": self._one_more(v) for v in ("y", "m")})
        self._move(moved, *(("y", "m") if self.kind != MULTI or variable == "all" else (variable,)))
        self.sweeps += 1
        if self.kind == MULTI and sample:
            self.machine_seen.append(self.machine_cells())
        return self

    def release(self) -> None:
        """Give up the laid-out corpus; the state stays."""
        self.corpus.release()

    # -- results --------------------------------------------------------------------------------

    def marginal(self) -> DataFrame:
        """(item_id, y, m): the values sampled most often since the tallies were restarted, the current ones if none was."""
        return self.state.select("item_id", *(self._mode(v).alias(v) for v in ("y", "m")))

    @staticmethod
    def _mode(variable: str) -> Column:
        return F.when(F.expr(f"array_max({variable}_seen) > 0"), arrays.argmax(f"{variable}_seen")).otherwise(F.col(variable))

    def mean_machine(self) -> list[float]:
        """Machine confusion averaged over the tallied sweeps, rows normalised."""
        k, seen = self.corpus.n_labels, self.machine_seen or [self.machine_cells()]
        mean = [sum(cells[i] for cells in seen) for i in range(k * k)]
        return [v / sum(mean[i // k * k:(i // k + 1) * k]) for i, v in enumerate(mean)]

    def point_model(self) -> PointModel:
        """Point estimates at the marginal modes (the current state before any sweep), for scoring items anew.

        Training items get their final labels this way too.
        """
        c, k = self.corpus, self.corpus.n_labels
        modes = self.state
        if self.sweeps:
            modes = cut(modes.withColumns({v: self._mode(v) for v in ("y", "m")}), "modes")
        at = replace(self, state=modes)
        theta = at.class_counts()
        diag, off = self.priors.annotator_cell(k)
        unknown = [[math.log((diag if t == a else off) / (diag + (k - 1) * off)) for t in range(k)] for a in range(k)]
        model = PointModel(k, [math.log(v / sum(theta)) for v in theta], cut(log_confusion(at.confusion(), k), "label_weights"), unknown)
        if self.kind != ITEM:
            vocab = cut(c.soft_vocab(at._hard("y" if self.kind == MOM else "m")), "modes_vocab")
            model.words = log_words(vocab, k, c.n_features, self.priors)
        if self.kind == MULTI:
            mean = self.mean_machine()
            model.log_mu = [[math.log(v) for v in mean[a * k:(a + 1) * k]] for a in range(k)]
        return model

    def hard_confusion(self) -> DataFrame:
        """(annotator_id, label, c): weighted counts by the items' current labels, without prior."""
        return self.corpus.soft_confusion(self._hard("y"))

    def tune(self) -> None:
        """Re-estimates b_theta, (b_gamma, c_gamma) and, with words, b_phi from the current counts."""
        c, k = self.corpus, self.corpus.n_labels
        tuned = tuning.with_confusion(self.priors, k, self.hard_confusion())
        tuned = tuned.with_(b_theta=tuning.symmetric(joins.class_sums(self._hard("y"), k), k, self.priors.b_theta))
        if self.kind != ITEM:
            vocab = cut(c.soft_vocab(self._hard("y" if self.kind == MOM else "m")), "tuning_vocab")
            tuned = tuned.with_(b_phi=tuning.vocabulary(vocab, k, c.n_features, self.priors.b_phi))
        self.priors = tuned

    def confusion(self) -> DataFrame:
        c = self.corpus
        soft = self.hard_confusion()
        return counts.confusion_grid(soft, c.annotators(), c.n_labels, *self.priors.annotator_cell(c.n_labels))

    def log_joint(self) -> float:
        vocab, cells = None, None
        if self.kind != ITEM:
            vocab = self._vocab()
        if self.kind == MULTI:
            cells = self.machine_cells()
        return bounds.log_joint(self.class_counts(), self.confusion(), vocab, self.corpus.n_features, cells, self.priors)


@dataclass(frozen=True)
class Step:
    """One entry of a training schedule."""

    operation: str
    variable: str = "all"
    iterations: int = 1
    temperature: float = 1.0

    def __post_init__(self):
        if self.operation not in ("sample", "maximize"):
            raise ValueError(f"cannot {self.operation}: an operation is sample or maximize")
        if self.variable not in ("y", "m", "z", "b", "all"):
            raise ValueError(f"no variable {self.variable}: a step moves y, m, z (topics), b (their classifier) or all")


#: the log joint is reported every this many sampling sweeps (fixed value)
JOINT_EVERY = 25


def train(run: Sweeper, schedule: list[Step], tune_every: int = 0) -> list[dict]:
    """Run the schedule; returns the log joint trace. ``tune_every``: sweeps after which priors are re-estimated (0: never)."""
    trace = []
    for step in schedule:
        if step.variable in ("z", "b"):
            raise ValueError(f"no variable {step.variable} here: label models have y, m or all")
        if step.operation == "sample":
            run.set_temperature(step.temperature)
        for i in range(step.iterations):
            run.sweep(step.variable, sample=step.operation == "sample")
            if tune_every and run.sweeps % tune_every == 0:
                run.tune()
            if step.operation == "maximize" or i % JOINT_EVERY == 0:
                trace.append({"step": step.operation, "variable": step.variable, "iteration": i, "log_joint": run.log_joint()})
    return trace
