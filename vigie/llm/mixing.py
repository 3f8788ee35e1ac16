"""Mixing sources to target weights by entropy balancing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigie.session import stored

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 60
CLOSE = 1e-10
# Sub-buckets per factor of two in the order in which extra copies are given out.
STEPS = 256
# Parts into which each source's rows are dealt where they meet its one row of results.
SALTS = 32


def word_count(text: str | Column) -> Column:
    """Words of a text, split at ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source (rows of ``skey``, ``source``, ``source_size``) its ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes. A target
    stops at ``most`` times its source's size; the excess is shared again by weight. In the
    order of cap over weight the stopped sources come first, so the common level of the others
    is the largest of all trial levels. One row per source is sorted, no document.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "skey")
    below = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    trial = weighed.withColumn("trial", (total - below) / rest)
    level = F.max("trial").over(everything)
    return trial.withColumn(
        "target", F.least(F.col("cap").cast("double"), F.col("weight") * level)
    ).select("skey", "source", "source_size", "target")


def tilts(counts: DataFrame, goals: DataFrame, most: int = 3) -> DataFrame:
    """Per source the ``tilt`` with which document rates meet the target, and ``mean`` size.

    The rates closest in entropy to one each, given the token total and the bound ``most``,
    are ``min(most, exp(tilt * size / mean))``. The dual is convex in the tilt; its Newton step
    (on the logarithm of the total, which is nearly straight) is kept inside the known bracket.
    A round sums the histogram ``counts`` (``skey``, ``size``, ``n``) per source; the state is one
    row per source and is stored each round, and only the largest error comes to the driver.
    """
    shape = counts.groupBy("skey").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    full = F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))
    state = stored(
        goals.filter("target > 0").join(shape, "skey").select(
            "skey", "target", "mean", full.alias("full"), F.lit(0.0).alias("tilt"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.lit(1.0).alias("error"),
        ),
        "tilts",
    )
    z = F.col("size") / F.col("mean")
    rate = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
    tokens = F.col("n") * F.col("size")
    for _ in range(ROUNDS):
        sums = (
            counts.join(state.filter("not full").select("skey", "mean", "tilt"), "skey")
            .groupBy("skey")
            .agg(
                F.sum(tokens * F.least(rate, F.lit(float(most)))).alias("got"),
                F.sum(F.when(rate < most, tokens * rate * z).otherwise(0.0)).alias("slope"),
            )
        )
        joined = state.join(sums, "skey", "left").withColumn(
            "error", F.coalesce(F.abs(F.col("got") / F.col("target") - 1), F.lit(0.0)))
        over = F.col("got") > F.col("target")
        done = F.col("full") | F.col("got").isNull() | (F.col("error") <= CLOSE)
        low = F.when(~over, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        outside = (
            F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
            .when(high.isNull(), F.greatest(low * 2, low + 1))
            .otherwise(F.least(high * 2, high - 1))
        )
        state = stored(
            joined.select(
                "skey", "target", "mean", "full",
                F.when(done, F.col("tilt")).when(inside, step).otherwise(outside).alias("tilt"),
                F.when(done, F.col("low")).otherwise(low).alias("low"),
                F.when(done, F.col("high")).otherwise(high).alias("high"),
                "error",
            ),
            "tilts",
        )
        if (state.agg(F.max("error")).first()[0] or 0.0) <= CLOSE:
            break
    return state.select("skey", "mean", "full", F.round("tilt", 11).alias("tilt"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, carry: str | None = None,
) -> DataFrame:
    """Per row: key, source, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``, and ``carry``.

    ``carry`` may name a small column, as a row's number, that decides nothing and comes back.

    Rates are rounded down to whole copies; what a source still lacks goes to documents in the
    order of a fixed random number over the fraction of their rate (sequential Poisson
    sampling), one more copy each, until the target is met to the word: the last one so chosen
    gives the first words of a copy only. ``taken`` counts words with repeats, ``copies`` begun
    copies. Sums run per source and bucket of that order; rows are sorted only inside the one
    bucket where a source's target is met, so a hot source is never in one task.

    Null texts and texts without words have size 0 and rate 0. Null sources are one source, the
    last. Repeated rows are rows. Random numbers come from key and text, so reruns agree.
    """
    sized = stored(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
            F.xxhash64(F.col(key), F.col(text)).alias("hash"), *([F.col(carry).alias("carried")] if carry else []),
        ).withColumn("skey", _source_key("source")),
        "sizes",
    )
    counts = stored(sized.groupBy("skey", "source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("skey", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = stored(targets(sizes, weights, most).drop("source"), "targets")
    tilted = tilts(counts.filter("size > 0").select("skey", "size", "n"), goals, most)
    solved = goals.join(tilted, "skey", "left")

    rate = (
        F.when((F.col("size") == 0) | F.col("mean").isNull(), 0.0)
        .when(F.col("full"), float(most))
        .otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))),
                           F.lit(float(most))))
    )
    # The same rate for the same size: whole copies per source come from the histogram.
    rates = (
        counts.join(solved, "skey")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate").cast("long"))
    )
    lacking = rates.groupBy("skey").agg(
        (F.round(F.first("target")).cast("long") - F.sum(F.col("n") * F.col("size") * F.col("whole"))).alias("lacking")
    )
    known = solved.join(lacking, "skey")
    uniform = (F.shiftrightunsigned("hash", 11).cast("double") + 0.5) / float(1 << 53)
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = (
        sized.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
        .join(spread, ["skey", "salt"])
        .drop("salt")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("turn", F.when(F.col("part") > 0, uniform / F.col("part")))
        .withColumn("bucket", F.floor(F.log2("turn") * STEPS).cast("long"))
    )
    by_bucket = Window.partitionBy("skey").orderBy("bucket")
    buckets = stored(
        rows.filter("turn is not null")
        .groupBy("skey", "bucket")
        .agg(F.sum("size").alias("held"), F.first("lacking").alias("lacking"))
        .withColumn("before", F.sum("held").over(by_bucket) - F.col("held"))
        .select("skey", "bucket", "before",
                F.when(F.col("before") + F.col("held") <= F.col("lacking"), "all")
                .when(F.col("before") >= F.col("lacking"), "none").otherwise("some").alias("given")),
        "buckets",
    )
    dealt = rows.join(buckets, ["skey", "bucket"], "left")
    in_turn = Window.partitionBy("skey", "bucket").orderBy("turn", "hash", "key", "size")
    whole = dealt.filter("given is null or given <> 'some'").withColumn(
        "extra", F.when(F.col("given") == "all", F.col("size")).otherwise(F.lit(0)).cast("long"))
    some = dealt.filter("given = 'some'").withColumn(
        "ahead", F.col("before") + F.sum("size").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("lacking") - F.col("ahead"))).cast("long")
    ).drop("ahead")
    return whole.unionByName(some).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "rate",
        (F.col("whole") + (F.col("extra") > 0).cast("long")).alias("copies"),
        (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"),
        *([F.col("carried").alias(carry)] if carry else []),
    )
