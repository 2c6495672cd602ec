"""Quality rules from counts and from the distance of a text's histograms to those of its language. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelmesh.runtime import cut

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8

# Frequent function words of each language that has a reference of its own.
COMMON = {
    "de": ("der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "auf", "für", "im", "dem", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
}
WORDS = tuple(sorted({word for words in COMMON.values() for word in words}))
#: one letter for each common word, in the same order, and one for all other words
LETTERS = tuple(chr(0x100 + i) for i in range(len(WORDS)))
OTHER = "-"
LONGEST = max(map(len, WORDS))

#: characters that are removed one class after the other; what is left over is the last class
CLASSES = (("lower", "[a-z]+"), ("space", SPACES), ("upper", "[A-Z]+"), ("stop", "[.,;:!?'\"()-]+"), ("symbol", "[#*$%&|<>]+"), ("digit", "[0-9]+"))

# A histogram is compared only if it counts as many things as this, and fails beyond this distance.
LEAST_CHARS, LEAST_WORDS = 100, 30
CLASS_LIMIT, WORD_LIMIT = 0.35, 0.45


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts and histograms of every whole text, one row per document, no shuffle.

    Repeated windows: only texts whose window hashes are not all different sort them; words are then counted where
    windows that have an equal cover them.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("words", _words(F.col("text")))
    rows = rows.withColumn("hashes", F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))))
    rows = rows.withColumn("windows", F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    lines = F.filter(F.split("text", "\n"), lambda line: F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) != "")
    common = F.array_join(F.transform("words", lambda w: F.when(F.length(w) > LONGEST, OTHER).otherwise(F.element_at(
        F.array(F.lit(OTHER), *map(F.lit, LETTERS)), F.array_position(F.array(*map(F.lit, WORDS)), F.lower(w)).cast("int") + 1))), "")
    rows = rows.select(
        "key", "lang", "text", F.size("words").cast("long").alias("n_words"), lines.alias("lines"), common.alias("common"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda p, at: F.coalesce(p["h"] == F.get("sorted", at)["h"], F.lit(False))
    rows = rows.withColumn("spots", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(
        F.filter("sorted", lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p["i"]))))
    covered = F.aggregate(F.transform("spots", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("spots", i + 1) - p, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, b: a + b)
    left = F.col("text")
    for name, pattern in CLASSES:
        rows = rows.withColumn(f"after_{name}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"after_{name}")
    before = ["text", *(f"after_{name}" for name, _ in CLASSES)]
    counts = [F.length(a) - F.length(b) for a, b in zip(before, before[1:])]
    histogram = F.array(*counts, F.length(before[-1])).cast("array<long>")
    word_histogram = F.array(*(F.length("common") - F.length(F.replace("common", F.lit(c), F.lit(""))) for c in (*LETTERS, OTHER))).cast("array<long>")
    rows = rows.select(
        "key", "lang", "n_words", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), histogram.alias("classes"), word_histogram.alias("common"))
    space, symbol = (1 + [name for name, _ in CLASSES].index(n) for n in ("space", "symbol"))
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.withColumn("word_chars", total - F.element_at("classes", space)).withColumn("n_symbols", F.element_at("classes", symbol))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)


def _shares(rows: DataFrame, **counts: str) -> DataFrame:
    """Adds columns of counts as shares; nothing counted gives zeros. Each total is a column of its own, summed once."""
    totals = rows.withColumns({f"_{name}_total": _total(F.col(column)) for name, column in counts.items()})
    share = lambda name: lambda c: F.when(F.col(f"_{name}_total") > 0, c / F.col(f"_{name}_total")).otherwise(0.0)
    return totals.withColumns({name: F.transform(F.col(column).cast("array<double>"), share(name)) for name, column in counts.items()})


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def _totals(column: str, size: int) -> Column:
    return F.array(*(F.sum(F.get(column, i)).cast("double") for i in range(size)))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances to the language's reference and the verdict, one row per document.

    References are the sums of all documents of a language that pass the base rules; languages without a list of
    common words, and null, share one (at most five rows, which is why they are broadcast). A document fails if the
    base rules fail or a histogram with enough entries is too far from its reference; a language none of whose
    documents passes the base rules has no reference, and no distance is then held against them. Null texts count as
    empty, repeated rows are judged one by one, null keys stay, other columns are not read, an empty table gives none.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    group = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("")
    rows = cut(base_counts(docs, key, text, lang).withColumn("base_failed", failed).withColumn("group", group), "quality-counts")
    references = rows.filter(~F.col("base_failed")).groupBy("group").agg(
        _totals("classes", len(CLASSES) + 1).alias("class_sums"), _totals("common", len(WORDS) + 1).alias("word_sums"))
    references = _shares(references, class_reference="class_sums", word_reference="word_sums").select("group", "class_reference", "word_reference")
    judged = _shares(rows, class_shares="classes", word_shares="common").join(F.broadcast(references), "group", "left")
    judged = judged.withColumn("class_distance", F.when(F.col("_class_shares_total") >= LEAST_CHARS, distance(F.col("class_shares"), F.col("class_reference")))
                               ).withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("word_shares"), F.col("word_reference"))))
    far = F.coalesce(F.col("class_distance") > CLASS_LIMIT, F.lit(False)) | F.coalesce(F.col("word_distance") > WORD_LIMIT, F.lit(False))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")
