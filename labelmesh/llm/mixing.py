"""Mixing sources to target weights by thresholds on a hash, found from nested histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelmesh.runtime import cut, fits_broadcast

WEIGHTS = (5, 2, 1)
#: bits of a document's hash, and of each histogram level
HASH_BITS, LEVEL_BITS = 60, 12
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words (runs without white space) of the whole text; null has 0."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    """60 bits of the md5 of key and text, the same in any engine; null counts as the empty string.

    Rows that share a key, or have none, are told apart by their texts.
    """
    both = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


@dataclass
class Mix:
    """``sizes``: one row per document; ``sources``: one per source with its target and threshold."""

    sizes: DataFrame
    sources: DataFrame


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, take the weights in turn.

    A source at its limit stays there and its excess is shared by weight among the others, until none is above. Only
    sums over sources reach the driver.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = cut(totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)), "mix-weights")
    whole = table.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    amount, weight, full, rate = share * float(whole.n or 0), whole.w or 0, 0, 0.0
    while weight:
        rate = (amount - full) / weight
        above = F.col("weight") * F.lit(rate) > limit * F.col("source_size")
        row = table.agg(F.sum(F.when(above, limit * F.col("source_size"))).alias("full"),
                        F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.sum(F.when(above, F.col("weight"))).alias("gone")).first()
        if (row.weight or 0) == weight:
            break
        full, weight = row.full or 0.0, row.weight or 0
    above = F.col("weight") * F.lit(rate) > limit * F.col("source_size")
    target = F.when(above, limit * F.col("source_size")).otherwise(F.col("weight") * F.lit(rate)).cast("double")
    return table.select("source", "source_size", target.alias("target"))


def spend(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (source, budget, more columns) with ``below``, ``whole`` and ``part``: what a source's budget buys.

    Rows of ``sizes`` (source, hash, size) with a hash under ``below`` are bought. Each level sums sizes by the next bits of
    the hash, only inside the bucket where the budget ends. After the last bit the rows of one hash value are left; they
    are equal, so ``part`` of the ``whole`` of them come nearest to what is left of the budget.
    """
    state = cut(budgets.withColumn("below", F.lit(0).cast("long")).withColumn("open", F.lit(True)).withColumn(
        "whole", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long")), "mix-state")
    kept = [c for c in budgets.columns if c != "budget"]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        ends = state.filter("open").select(F.col("source").alias("_source"), F.col("below").alias("_below"), "budget")
        inside = sizes.join(ends, sizes["source"].eqNullSafe(F.col("_source")) & (
            F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("_below", shift + LEVEL_BITS)))
        histogram = inside.groupBy("_source", "budget", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        running = Window.partitionBy("_source").orderBy("bucket")
        over = histogram.withColumn("_upto", F.sum("n").over(running)).filter(F.col("_upto") > F.col("budget"))
        # the first bucket that the budget does not cover, and what is left for it
        found = over.groupBy("_source").agg(F.min(F.struct("bucket", "_upto", "n", "rows")).alias("_at")).select(
            "_source", F.shiftleft("_at.bucket", shift).alias("_start"), (F.col("_at._upto") - F.col("_at.n")).alias("_spent"),
            F.col("_at.n").alias("_size"), F.col("_at.rows").alias("_rows"))
        joined = state.join(found, state["source"].eqNullSafe(found["_source"]), "left")
        left = F.col("budget") - F.col("_spent")
        hit = F.col("open") & F.col("_start").isNotNull()
        last = F.lit(shift == 0)
        each = F.col("_size") / F.col("_rows")
        full = F.floor(left / each)
        rest = left - full * each
        part = (full + F.when(each - rest < rest, 1).otherwise(0)).cast("long")
        # without such a bucket the budget covers the whole bucket of the level before, or the whole source
        covered = F.lit(1 << HASH_BITS) if shift == HASH_BITS - LEVEL_BITS else F.col("below") + F.lit(1 << (shift + LEVEL_BITS))
        state = cut(joined.select(
            *kept, F.when(hit, left).otherwise(F.col("budget")).alias("budget"),
            F.when(hit, F.col("_start")).when(F.col("open"), covered).otherwise(F.col("below")).alias("below"), (hit & ~last).alias("open"),
            F.when(hit & last, F.col("_rows")).otherwise(F.col("whole")).alias("whole"),
            F.when(hit & last, part).otherwise(F.col("part")).alias("part")), "mix-state")
    return state.select(*kept, "below", "whole", "part")


def thresholds(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``rounds`` (whole passes over the source) and what :func:`spend` says about one pass more."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    once = sources.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    return spend(sizes, once)


#: rows that one step makes of a counted row at most
REPEAT = 100_000


def _repeated(counted: DataFrame, count: str) -> DataFrame:
    """Each row as often as its ``count`` says, in pieces that are dealt out."""
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / REPEAT).cast("long"))
    dealt = counted.filter(F.col(count) > 0).withColumn("_piece", F.explode(pieces))
    dealt = dealt.withColumn("_n", F.least(F.lit(REPEAT).cast("long"), F.col(count) - F.col("_piece") * REPEAT))
    if not counted.filter(F.col(count) > REPEAT).isEmpty():
        dealt = dealt.repartition("_piece")
    return dealt.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("_piece", "_n", "_row", count)


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0, key: str = "doc_id",
    source: str = "source", text: str = "text",
) -> Mix:
    sizes = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                            hash_of(F.col(key), F.col(text)).alias("hash")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return Mix(sizes, thresholds(sizes, targets(totals, weights, share, limit)))


def _split_sources(mix: Mix) -> DataFrame:
    """Sources that take some, but not all, of the equal rows at their threshold."""
    return mix.sources.filter("part > 0 AND part < whole")


def mix_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, ``size``, ``source_size``, ``target`` of its source and ``taken`` words.

    Documents are taken whole, ``rounds`` times or once more where the hash of their key and text is below the source's
    threshold, so reruns agree and nothing is sorted by document. Of rows equal in key and text as many are taken as come
    nearest to the target; which of them cannot be told. Null texts have size 0, null sources form the last source, null
    keys are documents too; other columns are not read; an empty table gives no rows.
    """
    mix = plan_mix(docs, key=key, **options)
    sources = mix.sources.withColumnRenamed("source", "_source")
    rows = mix.sizes.join(sources, mix.sizes["source"].eqNullSafe(sources["_source"]))
    more = (F.col("hash") < F.col("below")) | (F.col("hash") == F.col("below")) & (F.col("part") > 0) & (F.col("part") == F.col("whole"))
    out = lambda df, extra: df.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * (F.col("rounds") + extra)).alias("taken"))
    if _split_sources(mix).isEmpty():
        return out(rows, more.cast("long"))
    edge = (F.col("hash") == F.col("below")) & (F.col("part") > 0) & (F.col("part") < F.col("whole"))
    groups = rows.filter(edge).groupBy("_source", "key", "size", "source_size", "target", "rounds", "part", "whole").agg(F.count(F.lit(1)).alias("_rows"))
    taken = _repeated(groups.withColumn("_take", F.least("part", "_rows")), "_take")
    left = _repeated(groups.withColumn("_leave", F.col("_rows") - F.least("part", "_rows")), "_leave")
    return out(rows.filter(~edge), more.cast("long")).unionByName(out(taken, F.lit(1))).unionByName(out(left, F.lit(0)))


def repeat_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept.

    Rows at a source's threshold that are equal in key and text are taken by a hash of all columns, in the same way; rows
    equal in all columns are counted, and the counts repeated.
    """
    prefix = "_mix"
    while any(column.lower().startswith(prefix) for column in docs.columns):
        prefix += "_"
    mix = plan_mix(docs, key=key, source=source, text=text, **options)
    name = lambda column: f"{prefix}{column}"
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
        sources = sources.select(*(F.col(c).alias(name(c)) for c in sources.columns))
        sources = F.broadcast(sources) if fits_broadcast(sources.count(), 100) else sources
        return rows.join(sources, rows[source].eqNullSafe(F.col(name("source"))))

    def copies(rows: DataFrame, often: Column) -> DataFrame:
        return rows.withColumn(name("copy"), F.explode(F.array_repeat(F.lit(0), often.cast("int")))).select(*columns)

    hashed = placed(docs, mix.sources).withColumn(name("hash"), hash_of(docs[key], docs[text]))
    at, below, part, whole, rounds = (F.col(name(c)) for c in ("hash", "below", "part", "whole", "rounds"))
    edge = (at == below) & (part > 0) & (part < whole)
    more = (at < below) | (at == below) & (part > 0) & (part == whole)
    split = _split_sources(mix)
    if split.isEmpty():
        return copies(hashed, rounds + more.cast("long"))
    rest = cut(hashed.filter(edge).select(*columns, rounds), "mix-edge")
    fine = F.pmod(F.xxhash64(*(c.cast("string") for c in columns)), F.lit(1 << HASH_BITS))
    again = spend(rest.select(F.col(f"`{source}`").alias("source"), fine.alias("hash"), F.lit(1).cast("long").alias("size")),
                  split.select("source", F.col("part").cast("double").alias("budget")))
    again = again.select("source", F.col("below").alias("fine_below"), F.col("whole").alias("fine_whole"), F.col("part").alias("fine_part"))
    near = placed(rest, again).withColumn(name("fine"), fine)
    at, below, part, whole = (F.col(name(c)) for c in ("fine", "fine_below", "fine_part", "fine_whole"))
    equal = (at == below) & (part > 0) & (part < whole)
    taken = (at < below) | (at == below) & (part > 0) & (part == whole)
    groups = near.filter(equal).groupBy(*columns, rounds, part).agg(F.count(F.lit(1)).alias(name("rows")))
    first = F.least(part, F.col(name("rows")))
    once = _repeated(groups.withColumn(name("n"), first * (rounds + 1)), name("n")).select(*columns)
    others = _repeated(groups.withColumn(name("n"), (F.col(name("rows")) - first) * rounds), name("n")).select(*columns)
    return copies(hashed.filter(~edge), rounds + more.cast("long")).unionByName(
        copies(near.filter(~equal), rounds + taken.cast("long"))).unionByName(once).unionByName(others)
