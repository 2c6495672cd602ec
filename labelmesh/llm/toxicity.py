"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelmesh.llm.automata import Transducer, best_path, compose
from labelmesh.llm.shipping import ship
from labelmesh.llm.tokens import forget
from labelmesh.runtime import cut

#: labelled rows of each class that the model is fitted on
SAMPLE_ROWS = 2000
#: an insult is learned if so many toxic rows have it and its log-likelihood ratio is so high
LEAST_ROWS, LEAST_RATIO = 5, 25.0
#: besides whole words, beginnings of words of these lengths
STEMS = (4, 5, 6, 7, 8)
CLAUSE = re.compile(r"[.!?;:\n]+")
#: words of letters; a contracted negation is one word
TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+")

# Words of the grammar's classes in English, German, French and Spanish; stems of verbs take any ending.
NEGATION = frozenset("not never no nor cannot nicht kein keine keinen keiner nie pas jamais ni nunca jamás".split())
REPORTED = frozenset("said says say quoted quotes claims claimed alleged allegedly reportedly sagte sagt angeblich dit affirme dijo dice afirma".split())
CONTRAST = frozenset("but however aber sondern mais pero sino".split())
SELF = frozenset("i we ich wir je nous yo nosotros".split())
YOU = frozenset("you your u du dein dir dich ihr euch tu toi te vous votre tú ti usted ustedes vosotros".split())
THEY = frozenset("he she they him her them his their er sie ihn ihnen il elle ils elles él ella ellos ellas".split())
MODAL = frozenset("will shall would must gonna going to ll want werde werden wollen will vais allons voy vamos a".split())
THREAT = ("kill", "destroy", "hurt", "beat", "burn", "murder", "töte", "zerstör", "schlag", "verletz", "tuer", "détrui", "frapp", "brûl", "matar", "destru", "golpe", "quem")

#: words that a negation reaches, a target is near, a subject waits for its verb, and a verb for its target
NEGATION_REACH, TARGET_REACH, SUBJECT_REACH, OBJECT_REACH = 4, 4, 4, 2
#: weights of the marks that a path prefers to write, and what a threat weighs in a clause
TARGETED, THREATENED, THREAT_WEIGHT = 1.0, 2.0, 2.0
CONTEXTS = ("plain", "negated", "reported", "targeted", "threat")
FEATURES = (*CONTEXTS, "clauses", "density", "strongest")

CLASSES = ("insult", "verb", "self", "you", "they", "modal", "negation", "report", "contrast", "word")


def negation() -> Transducer:
    """Insults and verbs within reach of a negation are negated, to the end of the clause part."""
    out = Transducer(final=set(range(NEGATION_REACH + 1)))
    for left in range(NEGATION_REACH + 1):  # words that are still reached
        for read in CLASSES:
            to = NEGATION_REACH if read == "negation" else 0 if read == "contrast" else max(0, left - 1)
            out.add(left, read, to, f"{read} negated" if left and read in ("insult", "verb") else None)
    return out


_NEGATED = (*CLASSES, "insult negated", "verb negated")


def reported() -> Transducer:
    """What follows a verb of saying is reported, until a contrast."""
    out = Transducer(final={0, 1})
    for read in _NEGATED:
        out.add(0, read, 1 if read == "report" else 0)
        kind = read.split()[0]
        out.add(1, read, 0 if read == "contrast" else 1, f"{kind} reported" if kind in ("insult", "verb") else None)
    return out


_REPORTED = (*_NEGATED, "insult reported", "verb reported")


def threat() -> Transducer:
    """A verb of harm is a threat if its subject, the speaker, stands before it or nobody does, and its target after it.

    States: the clause part's beginning, another subject, words in which a subject still waits for its verb, and words in
    which a verb's target must come: the listener, or anyone if the speaker is named.
    """
    begin, other = 0, 1
    waits = lambda n: 1 + n  # noqa: E731  n = 1..SUBJECT_REACH
    owes = lambda n, named: 1 + SUBJECT_REACH + n + named * OBJECT_REACH  # noqa: E731  n = 1..OBJECT_REACH
    out = Transducer(final={begin, other, *map(waits, range(1, SUBJECT_REACH + 1))})
    for read in _REPORTED:
        kind, *how = read.split()
        plain = "word" if kind == "verb" else read
        mark = " ".join(["threat", *how])
        states = [(begin, False), (other, None)] + [(waits(n), True) for n in range(1, SUBJECT_REACH + 1)]
        for state, named in states:
            following = other if state <= other or state == waits(1) else state - 1
            if kind == "contrast":
                to = begin
            elif kind == "self":
                to = waits(SUBJECT_REACH)
            elif kind in ("modal", "negation", "report") and state != other:
                to = state
            else:
                to = following
            out.add(state, read, to, plain)
            if kind == "verb" and named is not None:
                out.add(state, read, owes(OBJECT_REACH, named), mark, THREATENED)
        for named in (False, True):
            for n in range(1, OBJECT_REACH + 1):
                if kind == "you" or kind == "they" and named:
                    out.add(owes(n, named), read, other, plain)
                elif n > 1 and kind != "contrast":
                    out.add(owes(n, named), read, owes(n - 1, named), plain)
    return out


_THREAT = (*(r for r in _REPORTED if r.split()[0] != "verb"), "threat", "threat negated", "threat reported")


def target() -> Transducer:
    """An insult is targeted if a pronoun stands near it, before or after."""
    owes = lambda n: TARGET_REACH + n  # noqa: E731  n = 1..TARGET_REACH
    out = Transducer(final=set(range(TARGET_REACH + 1)))
    for read in _THREAT:
        pays = read in ("you", "they")
        for near in range(TARGET_REACH + 1):  # words in which the last pronoun is still near
            to = TARGET_REACH if pays else max(0, near - 1)
            if read != "insult":
                out.add(near, read, to)
            elif near:
                out.add(near, read, to, "insult targeted", TARGETED)
            else:
                out.add(near, read, to)
                out.add(near, read, owes(TARGET_REACH), "insult targeted", TARGETED)
        for n in range(1, TARGET_REACH + 1):
            to = TARGET_REACH if pays else owes(n - 1) if n > 1 else None
            if to is not None:
                out.add(owes(n), read, to, "insult targeted" if read == "insult" else None, TARGETED if read == "insult" else 0.0)
    return out


#: the whole grammar over word classes: negation, then reported speech, threats and targets
MACHINE = compose(compose(compose(negation(), reported()), threat()), target())
_CONTEXT = {"insult": "plain", "insult negated": "negated", "insult reported": "reported", "insult targeted": "targeted",
            "threat": "threat", "threat negated": "negated", "threat reported": "reported"}


@dataclass
class Grammar:
    """The lexical transducer: learned insults with their weights, whole words and stems that any ending may follow."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        stem = lambda s: re.escape(s) + r"[^\W\d_]*"
        parts = [*map(re.escape, sorted(self.words)), *map(stem, sorted(self.stems)), *map(stem, THREAT)]
        self.any = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(parts)})(?![^\W\d_])")

    def insult(self, token: str) -> float:
        found = self.words.get(token, 0.0)
        return max([found, *(self.stems.get(token[:n], 0.0) for n in self.lengths if n <= len(token))])

    def symbols(self, clause: str) -> list[tuple[str, float]]:
        """A class and a weight for each word of a clause."""
        out = []
        for token in TOKEN.findall(clause):
            weight = self.insult(token)
            kind = ("insult" if weight else "negation" if token in NEGATION or token.endswith(("n't", "n’t")) else "self" if token in SELF
                    else "you" if token in YOU else "they" if token in THEY else "modal" if token in MODAL else "report" if token in REPORTED
                    else "contrast" if token in CONTRAST else "verb" if token.startswith(THREAT) else "word")
            out.append((kind, weight or THREAT_WEIGHT * (kind == "verb")))
        return out

    def matches(self, clause: str) -> list[tuple[str, float]]:
        """Contexts and weights of the clause's matches, as the best path through the grammar writes them."""
        symbols = self.symbols(clause)
        _, written = best_path(MACHINE, [kind for kind, _ in symbols])
        return [(_CONTEXT[mark], weight) for mark, (_, weight) in zip(written, symbols) if mark in _CONTEXT]

    def features(self, text: str) -> list[float]:
        """Sums of match weights by context (log), share of clauses with a match, matches per 100 words, best clause."""
        text = text.lower()
        sums = dict.fromkeys(CONTEXTS, 0.0)
        if not self.any.search(text):
            return [0.0] * len(FEATURES)
        clauses = hit = matched = 0
        best = 0.0
        for clause in CLAUSE.split(text):
            if not clause or clause.isspace():
                continue
            clauses += 1
            if not self.any.search(clause):
                continue
            found = self.matches(clause)
            hit += bool(found)
            matched += len(found)
            best = max(best, sum(w for _, w in found))
            for context, weight in found:
                sums[context] += weight
        words = max(1, len(text.split()))
        return [*(math.log1p(sums[c]) for c in CONTEXTS), hit / max(1, clauses), min(10.0, 100 * matched / words), math.log1p(best)]


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray  # bias last
    scale: np.ndarray

    def score(self, text: str | None) -> float:
        x = np.array(self.grammar.features(text or "")) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights[:-1] + self.weights[-1]))))))


def logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton steps on the penalised likelihood; the bias, last, is not penalised."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (sample_weight * (p - y)) + penalty * w
        hessian = (x * (sample_weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _patterns(text: str) -> set[str]:
    """Whole words as they are, beginnings with a star."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)}


def _ratio(a: float, b: float, toxic: float, clean: float) -> float:
    """Log-likelihood ratio of a pattern in ``a`` of ``toxic`` and ``b`` of ``clean`` rows."""
    part = lambda k, e: k * math.log(k / e) if k > 0 else 0.0
    p = (a + b) / (toxic + clean)
    return 2 * (part(a, toxic * p) + part(b, clean * p) + part(toxic - a, toxic * (1 - p)) + part(clean - b, clean * (1 - p)))


def candidates(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the patterns that are frequent among ``toxic`` rows and telling; ``counts``: toxic and clean rows with each."""
    odds = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    return {p: odds(a, b) for p, (a, b) in counts.items() if a >= LEAST_ROWS and odds(a, b) > 2 and _ratio(a, b, toxic, clean) >= LEAST_RATIO}


def choose_insults(where: dict[str, set[int]], counts: dict[str, tuple[int, int]], weights: dict[str, float], toxic: int, clean: int) -> Grammar:
    """Insults that explain toxic rows, best first, each from the toxic rows that those before it leave unexplained.

    ``where``: toxic rows of each candidate. The ratio alone ends the choice.
    """
    where, chosen, left = dict(where), {}, set().union(*where.values()) if where else set()
    unexplained = toxic
    while where:
        gain = {p: len(rows & left) for p, rows in where.items()}
        best = max(where, key=lambda p: (_ratio(gain[p], counts[p][1], max(1, unexplained), clean), -counts[p][1], len(p), p))
        if gain[best] < LEAST_ROWS or _ratio(gain[best], counts[best][1], unexplained, clean) < LEAST_RATIO:
            break
        chosen[best] = weights[best]
        left -= where.pop(best)
        unexplained -= gain[best]
    # words as strong as the chosen ones explain rows that others explained already
    for pattern, rows in where.items():
        if counts[pattern][1] <= 0.02 * len(rows) and not pattern.endswith("*") and not any(pattern.startswith(c[:-1]) for c in chosen if c.endswith("*")):
            chosen[pattern] = weights[pattern]
    return Grammar({p: w for p, w in chosen.items() if not p.endswith("*")}, {p[:-1]: w for p, w in chosen.items() if p.endswith("*")})


def fit_features(grammar: Grammar, x: np.ndarray, y: np.ndarray, weight_of: tuple[float, float] = (1.0, 1.0)) -> Model:
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(FEATURES))
    if len(set(y.tolist())) < 2:  # nothing to tell apart: leave every text below one half
        return Model(grammar, np.concatenate((np.zeros(len(FEATURES)), [-3.0])), np.ones(len(FEATURES)))
    return Model(grammar, logistic(x / scale, y, np.where(y == 1, weight_of[1], weight_of[0])), scale)


def held_out(key: Column) -> Column:
    """Rows that no model may learn from: the CRC-32 of the key as text is divisible by 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def _learn(sample: DataFrame) -> Grammar:
    """Learns from the sample (nth, y, text). Patterns are found and counted in tasks; the driver gets those that are
    frequent among toxic rows and telling, and the numbers of the toxic rows with them, no texts."""
    def spread(batches):
        forget()
        for batch in batches:
            for nth, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = sorted(_patterns(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([nth] * len(found), pa.int64()), pa.array([y] * len(found), pa.int32()), pa.array(found, pa.string())],
                                                 names=["nth", "y", "pattern"])

    rows = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = rows.get(1, 0), rows.get(0, 0)
    if not toxic or not clean:
        return Grammar()
    patterns = cut(sample.mapInArrow(spread, "nth long, y int, pattern string"), "toxic-patterns")
    counted = patterns.groupBy("pattern").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).filter(F.col("toxic") >= LEAST_ROWS)
    lift = (F.col("toxic") + 0.5) / (toxic + 1) > (F.col("clean") + 0.5) / (clean + 1) * math.exp(2)
    counts = {r.pattern: (r.toxic, r.clean) for r in counted.filter(lift).collect()}
    weights = candidates(counts, toxic, clean)
    telling = sample.sparkSession.createDataFrame([(p,) for p in weights], "pattern string")
    where = defaultdict(set)
    for r in patterns.filter("y = 1").join(F.broadcast(telling), "pattern").select("pattern", "nth").collect():
        where[r.pattern].add(r.nth)
    return choose_insults(where, counts, weights, toxic, clean)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on about ``sample_rows`` labelled rows of each class, drawn by hash; the ids of the draw (bounded by it) are
    broadcast to find their texts. Rows equal in key, text and label count once."""
    ship(docs.sparkSession)
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter(
        F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key"))).groupBy("key").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, sample_rows / n) for y, n in sizes.items()}
    order = F.xxhash64(F.lit("toxicity"), "key")
    draw = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    picked = marked.filter(draw < F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))).limit(4 * sample_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    found = texts.join(F.broadcast(picked), "key").select(F.xxhash64(F.lit("toxicity"), "key", "text").alias("nth"), "y", "text")
    sample = cut(found.dropDuplicates(["nth", "y"]).orderBy("nth", "y").limit(4 * sample_rows), "toxic-sample")
    grammar = _learn(sample)

    def measure(batches):
        forget()
        for batch in batches:
            x = [grammar.features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["nth", "y", "x"])

    rows = sample.mapInArrow(measure, "nth long, y int, x array<double>").orderBy("nth", "y").toArrow()
    return fit_features(grammar, np.array(rows.column("x").to_pylist()).reshape(-1, len(FEATURES)), rows.column("y").to_numpy().astype(float),
                        tuple(1 / share.get(y, 1.0) for y in (0, 1)))


def toxic_score(text: Column, model: Model, spark) -> Column:
    """Score of each whole text; null counts as empty. The model, a few hundred words, travels with the function."""
    ship(spark)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``held_out``, ``score`` and ``predicted``; no shuffle but for the fit.

    Labels of held-out rows are never read into the model; scores depend on the whole text alone. Null and empty texts
    get the score of a text without a match; repeated rows and null keys are scored row by row; without labels of both
    classes every score is below one half; other columns are not read; an empty table gives no rows.
    """
    model = model or fit(docs, labels, key=key, text=text)
    rows = docs.select(F.col(key).alias("key"), toxic_score(F.col(text), model, docs.sparkSession).alias("score"))
    return rows.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
