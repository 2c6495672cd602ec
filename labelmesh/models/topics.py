"""Topic models whose topic proportions explain the labels that annotators see.

Tokens are rows. A sweep joins every token with its document's and its word's topic counts, takes the token's
own count out, and draws a topic by hashed Gumbel arg-max; all tokens move together and the counts are
aggregated again. No document or word is ever gathered into one place, so neither can be too large.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from labelmesh.functions import arrays, rand
from labelmesh.functions.special import lgamma
from labelmesh.models import bounds, classifier, tuning
from labelmesh.models.corpus import LaidRolling
from labelmesh.models.sweeps import ITEM, JOINT_EVERY, Step, Sweeper
from labelmesh.operators import joins, prep
from labelmesh.operators.votes import majority_vote
from labelmesh.priors import Priors
from labelmesh.runtime import Rolling, cut, scalars
from labelmesh.skew import Spread


def start_topics(tokens: DataFrame, n_topics: int, seed: int) -> DataFrame:
    """(item_id, pos, word) plus a uniform random topic z."""
    z = F.expr(f"cast({rand.hash_text(seed, 'item_id', 'pos')} % {n_topics} AS int)")
    return tokens.select("item_id", "pos", "word", z.alias("z"))


def topic_counts(tokens: DataFrame, n_topics: int, key: str) -> DataFrame:
    return tokens.groupBy(key).agg(arrays.count_by_class("z", "1", n_topics).alias("c"))


def topic_proportions(tokens: DataFrame, items: DataFrame, n_topics: int) -> DataFrame:
    """(item_id, zbar, size): topic shares and a constant one at the end; empty documents have zero shares."""
    counted = items.select("item_id").join(topic_counts(tokens, n_topics, "item_id"), "item_id", "left")
    counted = counted.withColumn("c", F.expr(f"coalesce(c, {arrays.zeros(n_topics)})"))
    size = arrays.total(arrays.cells("c", n_topics))
    shares = [f"{c} / greatest({size}, 1D)" for c in arrays.cells("c", n_topics)]
    return counted.select("item_id", F.expr(arrays.array([*shares, "1D"])).alias("zbar"), F.expr(size).alias("size"))


def top_words(tokens: DataFrame, n: int) -> DataFrame:
    """(z, word, n, rank): the most frequent words of every topic (ties: alphabetical)."""
    counted = tokens.groupBy("z", "word").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("z").orderBy(F.desc("n"), F.asc("word"))
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


@dataclass
class TopicLabelModel:
    """Topics z of tokens, labels y of annotated documents and a classifier b from topic shares to labels.

    Each is moved by itself. A move of z leaves the counts of words and documents stale, one of y those of annotators;
    only stale counts are aggregated again, once, when a move, a score or the objective needs them. With ``labelled``
    off (the pipelined form) topics never see labels.
    """

    n_labels: int
    n_topics: int
    priors: Priors
    alpha: float
    items: DataFrame
    labels: Sweeper
    vocabulary: int
    by_item: Spread
    by_word: Spread
    seed: int = 0
    labelled: bool = True
    sweeps: int = 0
    eta: classifier.Classifier | None = None
    rolling: LaidRolling | None = None
    words: Rolling = field(default_factory=lambda: Rolling("topic_words", keep=1))
    documents: Rolling = field(default_factory=lambda: Rolling("topic_docs", keep=1))
    counted_at: dict[str, int] = field(default_factory=dict)

    @classmethod
    def start(cls, tokens: DataFrame, annotations: DataFrame, items: DataFrame, n_labels: int, n_topics: int,
              priors: Priors = Priors(), alpha: float = 0.5, seed: int = 0, labelled: bool = True,
              topics: DataFrame | None = None, dealt: int = 0) -> "TopicLabelModel":
        """``topics`` (item_id, pos, z) continues a saved run; tokens it lacks start at random. ``dealt``: the tasks that the
        tokens are dealt to by item, as :func:`prep.tokenize` leaves them; without it they are dealt here."""
        first = start_topics(tokens, n_topics, seed)
        if topics is not None:
            saved = topics.select("item_id", "pos", F.col("z").cast("int").alias("_z"))
            first = first.join(saved, ["item_id", "pos"], "left").select("item_id", "pos", "word", F.coalesce("_z", "z").alias("z"))
        # tokens lie in buckets by item, so that only documents' counts move to them
        spark, parts = tokens.sparkSession, dealt if topics is None else 0
        first = first.withColumn("was", F.col("z"))
        if not parts:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
            first = first.repartition(parts, "item_id")
        rolling = LaidRolling("tokens", parts)
        first = rolling.push(first)
        by_word = Spread.with_counts(first, ["word"], ["item_id", "pos"])
        vocabulary = by_word.counts.count()
        y = majority_vote(annotations).withColumnRenamed("label", "y")
        model = cls(n_labels, n_topics, priors, alpha, cut(items.select("item_id").distinct(), "items"),
                    Sweeper.start(ITEM, annotations, y, n_labels, priors, seed=seed), vocabulary,
                    Spread.plan(first, ["item_id"], ["pos"]), by_word, seed, labelled, rolling=rolling)
        return model

    @property
    def tokens(self) -> DataFrame:
        """(item_id, pos, word, z)."""
        return self.rolling.last.drop("was")

    # -- counts ---------------------------------------------------------------------------------

    def word_counts(self) -> DataFrame:
        """(word, c): tokens of each word by topic."""
        return self._fresh(self.words, lambda: topic_counts(self.tokens, self.n_topics, "word"))

    def document_counts(self) -> DataFrame:
        """(item_id, d, size): tokens of each document by topic and in all; documents without tokens too."""
        def count():
            d = self.items.join(topic_counts(self.tokens, self.n_topics, "item_id"), "item_id", "left")
            d = d.withColumn("c", F.expr(f"coalesce(c, {arrays.zeros(self.n_topics)})"))
            return d.select("item_id", F.col("c").alias("d"), F.expr(arrays.total(arrays.cells("c", self.n_topics))).alias("size"))

        return self._fresh(self.documents, count)

    def _fresh(self, kept: Rolling, count) -> DataFrame:
        """The kept table; counted again first if topics have moved since."""
        if self.counted_at.get(kept.name) != self.sweeps:
            kept.push(count())
            self.counted_at[kept.name] = self.sweeps
        return kept.last

    def proportions(self) -> DataFrame:
        """(item_id, zbar, size), as :func:`topic_proportions` of the current topics."""
        shares = [f"{c} / greatest(size, 1D)" for c in arrays.cells("d", self.n_topics)]
        return self.document_counts().select("item_id", F.expr(arrays.array([*shares, "1D"])).alias("zbar"), "size")

    # -- b --------------------------------------------------------------------------------------

    def fit_eta(self) -> None:
        """Classifier from topic shares to the current labels, on annotated documents only."""
        shares = cut(self.proportions().select("item_id", F.slice("zbar", 1, self.n_topics).alias("x")), "zbar")
        design = classifier.dense_design(shares, "x", self.n_labels)
        hard = joins.one_hot(self.labels.state, self.n_labels, "y")
        self.eta = classifier.fit(design, hard, self.priors)

    def _eta_rows(self) -> list[list[float]]:
        """Coefficients of each class, its intercept last."""
        return [[*w, b] for w, b in zip(self.eta.coefficients, self.eta.intercepts)]

    def _logits(self, shares: str) -> list[str]:
        return [arrays.total([f"{arrays.num(w)} * {shares}[{i}]" for i, w in enumerate(row)]) for row in self._eta_rows()]

    def class_scores(self) -> DataFrame:
        """(item_id, lp): log probability of every class from the current topics under the current classifier."""
        staged = self.proportions().select("item_id", F.expr(arrays.array(self._logits("zbar"))).alias("raw"))
        return classifier.log_softmax(staged, "raw", self.n_labels)

    # -- z --------------------------------------------------------------------------------------

    def _document_terms(self) -> DataFrame:
        """Per document: topic counts and the label's log weight for every topic (zero without annotations)."""
        t, num = self.n_topics, arrays.num
        eta = self._eta_rows()
        docs = self.document_counts().join(self.proportions().select("item_id", "zbar"), "item_id").join(
            self.labels.state.select("item_id", "y"), "item_id", "left")
        docs = docs.withColumn("_l", F.expr(arrays.array(self._logits("zbar"))))
        docs = docs.withColumn("_e", F.expr(arrays.array([arrays.array([num(w) for w in row[:t]]) for row in eta])))
        per_topic = []
        for i in range(t):
            shifted = [f"(_l[{c}] + _e[{c}][{i}] / size)" for c in range(len(eta))]
            top = arrays.largest(shifted)
            norm = arrays.total([f"exp({s} - {top})" for s in shifted])
            per_topic.append(f"_e[y][{i}] / size - {top} - ln({norm})")
        known = f"y IS NOT NULL AND y < {len(eta)} AND size > 0"
        meta = f"CASE WHEN {known} THEN {arrays.array(per_topic)} ELSE {arrays.zeros(t)} END"
        return docs.select("item_id", "d", F.expr(meta).alias("meta"))

    def move_topics(self, sample: bool = True, temperature: float = 1.0) -> None:
        """Move every token: draw its topic (annealed by ``temperature``) or take the best one.

        One hashed number a token picks from the topics' weights, so a draw depends on the token alone.
        """
        t, num, b = self.n_topics, arrays.num, self.priors.b_phi
        if self.labelled and self.eta is None:
            self.fit_eta()
        words = self.word_counts()
        totals = scalars(words.agg(arrays.sum_arrays("c", t).alias("t")), "t", t)
        if self.labelled:
            docs = self._document_terms().withColumn("_top", F.expr(arrays.largest(arrays.cells("meta", t))))
            docs = docs.select("item_id", "d", F.expr(arrays.array([f"exp({m} - _top)" for m in arrays.cells("meta", t)])).alias("f"))
        else:
            docs = self.document_counts().select("item_id", "d")
        rows = self.by_item.join(self.tokens, docs.hint("shuffle_hash") if self.by_item.hot is None else docs)
        back = (self.rolling.parts, "item_id")
        joined = joins.attach(rows, words, ["word"], ["item_id", "pos"], t, self.vocabulary, self.by_word, back)
        if self.by_item.hot is not None:
            joined = joined.repartition(*back)
        weights = []
        for i in range(t):
            own = f"CASE WHEN z = {i} THEN 1D ELSE 0D END"
            weight = f"(d[{i}] - {own} + {num(self.alpha)}) * (c[{i}] - {own} + {num(b)}) / ({num(totals[i] + self.vocabulary * b)} - {own})"
            weights.append(weight + (f" * f[{i}]" if self.labelled else ""))
        if sample and temperature != 1.0:
            weights = [f"pow({w}, {num(1.0 / temperature)})" for w in weights]
        drawn = joined.withColumn("_w", F.expr(arrays.array(weights)))
        if sample:
            drawn = arrays.draw(drawn, "_w", rand.uniform_text(f"{self.seed}-z{self.sweeps}", "item_id", "pos"), t, "_pick")
        else:
            drawn = drawn.withColumn("_r", F.expr(arrays.array([f"round(ln({w}), 9)" for w in arrays.cells("_w", t)])))
            drawn = drawn.withColumn("_pick", arrays.argmax("_r"))
        self.rolling.push(drawn.select("item_id", "pos", "word", F.col("_pick").alias("z"), F.col("z").alias("was")))
        self.sweeps += 1

    def topics_changed(self) -> int:
        """Tokens that the last move gave another topic."""
        return self.rolling.last.filter("z <> was").count()

    # -- y --------------------------------------------------------------------------------------

    def move_labels(self, sample: bool = True, temperature: float = 1.0) -> None:
        """Labels of annotated documents from their topics and annotations."""
        if self.eta is None:
            self.fit_eta()
        if sample:
            self.labels.set_temperature(temperature)
        self.labels.sweep("y", sample, class_scores=self.class_scores())

    def sweep(self, sample: bool = True, temperature: float = 1.0) -> "TopicLabelModel":
        """Classifier, labels and topics in turn; a greedy sweep moves topics before labels."""
        self.fit_eta()
        moves = [self.move_labels, self.move_topics]
        for move in moves if sample else reversed(moves):
            move(sample, temperature)
        return self

    # -- priors ---------------------------------------------------------------------------------

    def tune(self, *names: str) -> None:
        """Re-estimates the named prior strengths from the current counts: theta (topics of documents), phi (words of
        topics), gamma (annotators)."""
        t, k = self.n_topics, self.n_labels
        if "theta" in names:
            self.alpha = tuning.symmetric(self.document_counts().select(F.col("d").alias("c")), t, self.alpha)
        if "phi" in names:
            b_phi = tuning.vocabulary(self.word_counts(), t, self.vocabulary, self.priors.b_phi)
            self.priors = self.priors.with_(b_phi=b_phi)
        if "gamma" in names:
            self.priors = tuning.with_confusion(self.priors, k, self.labels.hard_confusion())
        self.labels.priors = self.labels.priors.with_(b_gamma=self.priors.b_gamma, c_gamma=self.priors.c_gamma)

    # -- results --------------------------------------------------------------------------------

    def predictions(self) -> DataFrame:
        """(item_id, label): the label sampled most often of annotated documents, the classifier's for the rest."""
        guess = self.class_scores().select("item_id", F.expr("transform(lp, v -> round(v, 9))").alias("lp")).select("item_id", arrays.argmax("lp").alias("guess"))
        return guess.join(self.labels.marginal().select("item_id", "y"), "item_id", "left").select(
            "item_id", F.coalesce("y", "guess").alias("label")
        )

    def annotator_accuracy(self) -> DataFrame:
        """Diagonal weighted by the share of every inferred label."""
        from labelmesh.operators import counts

        share = self.labels.state.groupBy(F.col("y").alias("truth")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        return counts.annotator_accuracy(counts.normalize_rows(self.labels.confusion()), share)

    def log_joint(self) -> float:
        """Topics given documents, words given topics, labels given topics, annotations given labels, eta prior."""
        t, v, a = self.n_topics, self.vocabulary, self.alpha
        docs = self.document_counts().filter("size > 0")
        per_doc = arrays.total([lgamma(f"({c} + {arrays.num(a)})") for c in arrays.cells("d", t)])
        total = f"{per_doc} - {lgamma(f'(size + {arrays.num(t * a)})')}"
        value = bounds._one(docs, f"sum({total})") - docs.count() * (t * math.lgamma(a) - math.lgamma(t * a))
        words = self.word_counts()
        flat = v * math.lgamma(self.priors.b_phi) - math.lgamma(v * self.priors.b_phi)
        value += bounds.vocab_beta(words, t, v, self.priors) - t * flat
        picked = self.class_scores().join(self.labels.state.select("item_id", "y"), "item_id")
        value += bounds._one(picked, "sum(lp[y])")
        k = self.n_labels
        diag, off = self.priors.annotator_cell(k)
        value += bounds.confusion_beta(self.labels.confusion())
        value -= self.labels.corpus.n_annotators * k * bounds._log_beta([diag] + [off] * (k - 1))
        return value - sum(w * w for row in self.eta.coefficients for w in row) / (2 * self.priors.eta_variance)


def train(model: TopicLabelModel, schedule: list[Step], tune: bool = False) -> list[dict]:
    """Runs the schedule over z, y, b or all of them; returns its trace.

    Every step restarts the tallies of labels. Sampling refits the classifier (with "all" in every sweep, else) every
    ``JOINT_EVERY`` sweeps and then reports the objective, after priors were tuned if ``tune``. Maximising always tunes
    the priors of what it moved and reports how many tokens and labels have changed since the step began.
    """
    trace = []
    strengths = {"all": ("theta", "phi", "gamma"), "y": ("gamma",), "z": ("theta", "phi"), "b": ()}
    for step in schedule:
        if step.variable not in strengths:
            raise ValueError(f"no variable {step.variable} here: topics have z, y, b or all")
        if step.operation == "sample" and step.variable == "b":
            raise ValueError("the classifier b is only maximized")
        model.labels.restart_tallies()
        sample, changed = step.operation == "sample", 0
        for i in range(step.iterations):
            if step.variable == "b":
                model.fit_eta()
            elif step.variable == "all":
                model.sweep(sample, step.temperature)
            else:
                move = model.move_topics if step.variable == "z" else model.move_labels
                move(sample, step.temperature)
            entry = {"step": step.operation, "variable": step.variable, "iteration": i}
            if sample and i % JOINT_EVERY == 0:
                if step.variable != "all":
                    model.fit_eta()
                if tune:
                    model.tune(*strengths[step.variable])
                trace.append(entry | {"log_joint": model.log_joint()})
            elif not sample:
                if step.variable in ("z", "all"):
                    changed += model.topics_changed()
                if step.variable in ("y", "all"):
                    changed += model.labels.changed("y")
                model.tune(*strengths[step.variable])
                trace.append(entry | {"changes": changed})
    return trace


def topic_label_model(tokens: DataFrame, annotations: DataFrame, items: DataFrame, n_labels: int, n_topics: int,
                      priors: Priors = Priors(), sample_sweeps: int = 25, maximize_sweeps: int = 0, seed: int = 0,
                      dealt: int = 0) -> TopicLabelModel:
    model = TopicLabelModel.start(tokens, annotations, items, n_labels, n_topics, priors, seed=seed, dealt=dealt)
    for _ in range(sample_sweeps):
        model.sweep(True)
    for _ in range(maximize_sweeps):
        model.sweep(False)
    return model


def topic_then_label(tokens: DataFrame, annotations: DataFrame, items: DataFrame, n_labels: int, n_topics: int,
                     priors: Priors = Priors(), sample_sweeps: int = 25, maximize_sweeps: int = 1, seed: int = 0,
                     dealt: int = 0) -> DataFrame:
    """Pipelined variant: topics never see the labels. Returns (item_id, label).

    The same token sweeps over every token find the topics. A classifier over topic shares is trained on the vote shares; its log probabilities and the annotations
    under smoothed confusions then decide each item.
    """
    from labelmesh.models.scoring import log_confusion
    from labelmesh.operators import counts
    from labelmesh.operators.votes import soft_majority

    k = n_labels
    model = TopicLabelModel.start(tokens, annotations, items, n_labels, n_topics, priors, seed=seed, labelled=False, dealt=dealt)
    for sample in [True] * sample_sweeps + [False] * maximize_sweeps:
        model.move_topics(sample)
    shares = model.proportions().select("item_id", F.slice("zbar", 1, n_topics).alias("x"))
    design = classifier.dense_design(cut(shares, "zbar"), "x", k)
    soft = cut(soft_majority(annotations, items, k).filter(F.col("p").isNotNull()), "soft_labels")
    scores = classifier.fit(design, soft, priors).scores
    cells = joins.soft_confusion(annotations, soft, k, Spread.plan(annotations, ["item_id"], ["annotator_id", "label"]))
    annotators = annotations.select("annotator_id").distinct()
    grid = counts.confusion_grid(cells, annotators, k, *priors.annotator_cell(k))
    evidence = joins.annotation_evidence(annotations, cut(log_confusion(grid, k), "weights"), k)
    both = scores.join(evidence, "item_id", "left").withColumn("evidence", F.expr(f"coalesce(evidence, {arrays.zeros(k)})"))
    total = arrays.array([f"round(lp[{c}] + evidence[{c}], 9)" for c in range(k)])
    return both.select("item_id", F.expr(total).alias("_s")).select("item_id", arrays.argmax("_s").alias("label"))
