"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1.  Targets.  Sources share the wanted words by weight; none may exceed ``most_epochs``
    times what it has, and what it can't give is shared by weight among the others.
2.  Blocks.  A block is one pass over one document.  A source whose target is ``e`` epochs
    and a remainder gives ``e`` blocks of each document, and of one more pass those that
    come first in a permuted order, the last of them cut so that the words are exact.  The
    number of blocks of each source is its quota.
3.  Splitting tree.  The quotas are divided among the output shards by halving the set of
    shards again and again: how many blocks of each source go left is drawn from the
    multivariate hypergeometric law (source after source, each from the univariate law
    given what is left; of very many sources first part after part), so that shards get equal numbers of blocks and any assignment of
    blocks is as likely as if all blocks had been dealt at random, though nothing but
    quotas is touched.
4.  Drawing.  A source's blocks in permuted order are cut at the shards' quotas: shards
    draw disjoint blocks.  Within a shard blocks are shuffled by a hash.

Permuted orders are those of a seeded hash.  No task ranks a whole source: rows fall into
ranges of the hash (more of them where there are more rows), the totals of ranges are summed
up, and ranks are taken within a range.
Tables with a row for each source, or for each source and range, are all that grows no
faster than the number of sources; they are aggregated before they are shuffled.

Only DataFrame functions run here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, range_bits, unit, word_count, written

SEED = 90_210
#: Sources that are drawn one after the other; of more, first how many each part of them gets.
WIDTH = 128
#: Standard deviations on each side of the mean that a draw can reach.
REACH = 9


def source_targets(sizes: DataFrame, most_epochs: int = 3) -> DataFrame:
    """Targets of sources.

    ``sizes`` has ``source`` and ``size``.  Returns ``source``, ``place`` (from 0, by code
    point, null last), ``weight`` (1, 2, 3, repeating), ``source_size`` and ``target``.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = by.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = placed.withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    # Sources reach their caps in the order of cap / weight.  With the k first of them at
    # their caps, the others get ``rate`` for each unit of weight.
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rated = weighed.withColumn(
        "rate",
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    loose = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("rate"))))
    final = rated.withColumn("final", loose.over(everything)["rate"])
    target = F.least(F.col("cap"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"))
    return final.select("source", "place", "weight", "source_size", target.alias("target"))


def _ranked(rows: DataFrame, group: str, hash_: str, order: list[Column], value: Column, name: str, bits: int) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows before, by ``hash_`` (in ranges of its leading ``bits``) within ``group``."""
    bucket = F.shiftrightunsigned(F.col(hash_), 64 - bits).cast("int")
    dealt = rows.withColumn("__b", bucket).withColumn("__v", value)
    totals = dealt.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__c")).agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__g", "__c", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(group, "__b").orderBy(hash_, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("__r", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(starts, (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__c")))
        .withColumn(name, F.col("__s") + F.col("__r"))
        .drop("__b", "__v", "__g", "__c", "__s", "__r")
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drawn(population: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """A hypergeometric draw: how many of ``draws`` from ``population`` are among its ``good``.

    Inverts the distribution function: probabilities relative to the mode's are multiplied
    up by their ratios, values going from the mode upwards and then downwards.  A draw takes
    time in proportion to the standard deviation, and constant memory.
    """

    def f(c: Column) -> Column:
        return c.cast("double")

    def ends(g: Column) -> Column:
        n, k, m = g["population"], g["good"], g["draws"]
        least, most = F.greatest(F.lit(0).cast("long"), m + k - n), F.least(m, k)
        mode = F.greatest(least, F.least(most, F.floor(f(m + 1) * f(k + 1) / f(n + 2)).cast("long")))
        share = f(k) / F.greatest(f(n), F.lit(1.0))
        reach = (F.lit(8) + F.lit(float(REACH)) * F.sqrt(f(m) * share * (F.lit(1.0) - share))).cast("long")
        return F.struct(n.alias("n"), k.alias("good"), m.alias("m"), g["u"].alias("u"), least.alias("least"), most.alias("most"), mode.alias("mode"), reach.alias("reach"))

    def ratio(e: Column, k: Column, up: bool) -> Column:
        """The probability of ``k`` relative to that of the value before it."""
        at = k if up else k + 1
        odds = f(e["good"] - at + 1) * f(e["m"] - at + 1) / (f(at) * f(e["n"] - e["good"] - e["m"] + at))
        return odds if up else F.lit(1.0) / odds

    def steps(e: Column, up: bool) -> Column:
        none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
        if up:
            return F.when(e["most"] > e["mode"], F.sequence(e["mode"] + 1, F.least(e["most"], e["mode"] + e["reach"]))).otherwise(none)
        return F.when(e["least"] < e["mode"], F.sequence(e["mode"] - 1, F.greatest(e["least"], e["mode"] - e["reach"]), F.lit(-1).cast("long"))).otherwise(none)

    def mass(e: Column, up: bool) -> Column:
        return F.aggregate(
            steps(e, up),
            F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
            lambda a, k: _let(a["p"] * ratio(e, k, up), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum"))),
            lambda a: a["sum"],
        )

    def reached(e: Column, up: bool, left: Column) -> Column:
        return F.aggregate(
            steps(e, up),
            F.struct(F.lit(1.0).alias("p"), left.alias("left"), e["mode"].alias("k")),
            lambda a, k: F.when(a["left"] < 0, a).otherwise(_let(a["p"] * ratio(e, k, up), lambda p: F.struct(p.alias("p"), (a["left"] - p).alias("left"), k.alias("k")))),
            lambda a: a["k"],
        )

    def pick(e: Column) -> Column:
        sums = F.struct(mass(e, True).alias("above"), mass(e, False).alias("below"))
        inside = _let(
            sums,
            lambda s: _let(
                e["u"] * (F.lit(1.0) + s["above"] + s["below"]) - F.lit(1.0),
                lambda left: F.when(left < 0, e["mode"]).when(left < s["above"], reached(e, True, left)).otherwise(reached(e, False, left - s["above"])),
            ),
        )
        return F.when(e["most"] <= e["least"], e["least"]).otherwise(inside)

    given = F.struct(population.alias("population"), good.alias("good"), draws.alias("draws"), uniform.alias("u"))
    return _let(given, lambda g: _let(ends(g), pick))


def _dealt(draws: Column, seed: int) -> Column:
    """``sources`` (``place``, ``k``) of a node (``lo``, ``hi``) with ``left``: how many of each are among so many ``draws`` of all.

    The multivariate hypergeometric law, source after source.
    """
    start = F.struct(
        F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["k"]).alias("population"),
        draws.cast("long").alias("draws"),
        F.expr("CAST(array() AS ARRAY<STRUCT<place: INT, k: BIGINT, left: BIGINT>>)").alias("out"),
    )

    def step(acc, s):
        u = unit(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), s["place"]))
        return _let(
            _drawn(acc["population"], s["k"], acc["draws"], u),
            lambda n: F.struct(
                (acc["population"] - s["k"]).alias("population"),
                (acc["draws"] - n).alias("draws"),
                F.array_append(acc["out"], F.struct(s["place"].alias("place"), s["k"].alias("k"), n.alias("left"))).alias("out"),
            ),
        )

    return F.aggregate("sources", start, step)["out"]


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Divides quotas among ``shards`` shards.

    ``quotas`` has ``place`` and ``quota`` (blocks) for each source.  Returns ``place``,
    ``shard``, ``blocks`` and ``before`` (blocks of the source in lower shards).  Shards'
    totals differ by one at most.
    """
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "place", F.col("quota").cast("long").alias("k"))
    # Blocks before shard j of all: floor(total * j / shards); fixed by the whole.
    nodes = nodes.withColumn("all", F.sum("k").over(Window.partitionBy()))
    edge = lambda shard: F.floor(F.col("all") * shard / F.lit(shards)).cast("long")
    node = ["lo", "hi", "all"]
    widest = shards
    while widest > 1:
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = nodes.withColumn("part", F.floor(F.col("place") / WIDTH).cast("int"))
        packed = parts.groupBy(*node, "part").agg(F.sort_array(F.collect_list(F.struct("place", "k"))).alias("sources"), F.sum("k").alias("sum"))
        # first how many blocks of each part of the sources go left, then, given that, of each source in it
        whole = packed.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("place"), F.col("sum").alias("k")))).alias("sources"))
        dealt = whole.select(*node, F.explode(_dealt(edge(half) - edge(F.col("lo")), seed + 3)).alias("d")).select(*[F.col(c).alias(f"__{c}") for c in node], F.col("d.place").alias("__part"), F.col("d.left").alias("draws"))
        same = F.col("part") == F.col("__part")
        for c in node:
            same = same & (F.col(c) == F.col(f"__{c}"))
        drawn = packed.join(dealt, same).select(*[F.col(c) for c in node], F.explode(_dealt(F.col("draws"), seed)).alias("d")).select(*node, "d.place", "d.k", "d.left")
        left, right = F.col("left"), F.col("k") - F.col("left")
        halves = F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi"), left.alias("k")), F.struct(half.alias("lo"), F.col("hi").alias("hi"), right.alias("k")))
        children = F.when(F.col("hi") - F.col("lo") <= 1, F.array(F.struct("lo", "hi", "k"))).otherwise(halves)
        # a table for each level, so that no plan holds more than one
        nodes = written(drawn.select("all", "place", F.explode(children).alias("c")).select("all", "c.lo", "c.hi", "place", "c.k"), "mix-tree")
        widest = -(-widest // 2)
    earlier = Window.partitionBy("place").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("place", F.col("lo").alias("shard"), F.col("k").alias("blocks"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, most_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The blocks of the mix.

    A row for each document and pass: ``id_col``, ``source``, ``size`` (words),
    ``source_size``, ``target``, ``epoch`` (from 0), ``take`` (words; below ``size`` only
    for the block that is cut), and for a block with words ``shard`` and ``position`` (its
    order in the shard).  Each document has one row at least, with ``take`` 0 if the mix
    takes nothing of it.  The words of a source add up to its target rounded.

    Null texts are empty and have no words.  Null is a source like the others, the last.
    Repeated rows are documents of their own, told apart by ``nth``.  An empty table gives an empty result; in a
    table without any words every target is 0.  Other columns are not read.
    """
    equal = Window.partitionBy("id", "source", "size", "crc").orderBy("crc")
    docs = written(
        df.select(
            F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), F.crc32(F.col(f"`{text_col}`")).alias("crc")
        ).withColumn("nth", F.row_number().over(equal)),
        "mix-sizes",
    )
    bits = range_bits(docs.count() * most_epochs)
    targets = source_targets(docs, most_epochs)
    words = F.round("target").cast("long")
    targets = targets.withColumn("words", words).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
    targets = written(targets, "mix-targets")
    placed = docs.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    hashed = placed.withColumn("h", F.xxhash64(F.lit(seed), "id", "crc", "size"))
    tie = [F.col("id"), F.col("size"), F.col("crc"), F.col("nth")]
    ordered = _ranked(hashed, "place", "h", tie, F.col("size"), "words_before", bits)
    extra = F.least(F.greatest(F.col("rest") - F.col("words_before"), F.lit(0)), F.col("size"))
    blocks = ordered.withColumn("extra", extra).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("full") - F.when(F.col("extra") > 0, 0).otherwise(1), F.lit(0)))))
    blocks = written(
        blocks.withColumn("take", F.when(F.col("epoch") < F.col("full"), F.col("size")).otherwise(F.col("extra"))).withColumn("h", F.xxhash64(F.lit(seed + 1), "h", "epoch")).drop("full", "rest", "words", "words_before", "extra", "weight"),
        "mix-blocks",
    )
    taken = blocks.filter(F.col("take") > 0)
    quotas = taken.groupBy("place").agg(F.count(F.lit(1)).alias("quota"))
    cuts = split_quotas(quotas, shards, seed).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("before", "shard", "blocks"))).alias("cuts"))
    ranked = _ranked(taken, "place", "h", [F.col("id"), F.col("epoch"), F.col("size"), F.col("crc"), F.col("nth")], F.lit(1).cast("long"), "rank", bits)
    dealt = ranked.join(cuts, "place").withColumn("shard", F.filter("cuts", lambda c: (c["before"] <= F.col("rank")) & (F.col("rank") < c["before"] + c["blocks"]))[0]["shard"])
    shuffled = dealt.withColumn("g", F.xxhash64(F.lit(seed + 2), "h"))
    located = _ranked(shuffled, "shard", "g", [F.col("h"), F.col("id"), F.col("epoch"), F.col("nth")], F.lit(1).cast("long"), "position", bits)
    columns = [F.col("id").alias(id_col), "source", "size", "source_size", "target", "crc", "nth", "epoch", "take"]
    return located.select(*columns, "shard", "position").unionByName(blocks.filter(F.col("take") <= 0).select(*columns), allowMissingColumns=True)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, once for each pass, with ``df``'s columns.

    The text of a block that is cut is its first words, joined by single spaces.  Options
    are those of :func:`mix`, and so are the rules: rows without words are never taken, rows
    alike in identifier, source and text are documents of their own, each with its own passes,
    and an empty table gives an empty result.
    """
    key = ["__id", "__source", "__crc", "__size", "__nth"]
    blocks = mix(df, id_col, text_col, source_col, **options).filter("take > 0")
    takes = blocks.groupBy(F.col(f"`{id_col}`").alias("__id"), F.col("source").alias("__source"), F.col("crc").alias("__crc"), F.col("size").alias("__size"), F.col("nth").alias("__nth"))
    takes = takes.agg(F.collect_list("take").alias("__takes")).select(*[F.col(c).alias(f"{c}_of") for c in key], "__takes")
    text = F.col(f"`{text_col}`")
    equal = Window.partitionBy("__id", "__source", "__size", "__crc").orderBy("__crc")
    keyed = df.withColumns({"__id": F.col(f"`{id_col}`"), "__source": F.col(f"`{source_col}`"), "__crc": F.crc32(text), "__size": word_count(text)}).withColumn("__nth", F.row_number().over(equal))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of")) if c in ("__id", "__source") else F.col(c) == F.col(f"{c}_of") for c in key]
    taken = keyed.join(takes, reduce(lambda a, b: a & b, on)).withColumn("__take", F.explode("__takes"))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    cut = F.when(F.col("__take") < F.col("__size"), F.array_join(F.slice(words, F.lit(1), F.col("__take").cast("int")), " ")).otherwise(text)
    return taken.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in df.columns])
