"""Mixing sources to target weights by entropy balancing; DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialise, shielded, word_array

#: Newton steps at most; bisection inside the bracket makes each at least halve it.
ROUNDS = 60
#: Documents of one source and size whose extra copies one task places.
GROUP = 256
#: Rows alike that come out of one row of their list.
BLOCK = 4096


def cycle_weights(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, weight): weights repeating over sources in order of code points, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight).

    share times all sizes is split by weight; a target stops at cap times its source's size, and what
    is over goes to the others by weight. So a target is the lesser of cap * size and weight * level,
    one level for all, found by ordering sources by the level at which they stop. One row a source.
    """
    limit = F.lit(cap) * F.col("source_size")
    stop = F.when(F.col("weight") > 0, limit / F.col("weight")).otherwise(F.lit(float("inf")))
    w = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    x = sources.withColumns({"limit": limit, "stop": stop})
    x = x.withColumns({"budget": F.lit(share) * F.sum("source_size").over(every), "weights": F.sum("weight").over(every), "full": F.coalesce(F.sum("limit").over(w), F.lit(0.0)), "full_weight": F.coalesce(F.sum("weight").over(w), F.lit(0.0))})
    # The level if exactly the sources before this one stop. The true one is the greatest that does not stop its own source.
    level = F.when(F.col("weights") > F.col("full_weight"), (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("full_weight")))
    x = x.withColumn("level", F.max(F.when(level <= F.col("stop"), level)).over(every))
    return x.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level"))).alias("target"))


def rate(lam: Column, size: Column, scale: Column, cap: float) -> Column:
    """min(cap, exp(lam * size / scale)): the rate that minimises relative entropy to one copy of each document."""
    return F.least(F.lit(cap), F.exp(F.least(lam * size / scale, F.lit(700.0))))


def balance(sizes: DataFrame, goals: DataFrame, cap: float, rounds: int = ROUNDS) -> DataFrame:
    """(source, lam, scale, full) for goals (source, source_size, target) over sizes (source, size, n).

    Minimise the relative entropy of document rates to 1 subject to each source's rates times sizes
    making its target and no rate above cap. The dual is convex with one multiplier a source, whose
    gradient is sum(n size rate) - target. Each step is one distributed aggregation over the table
    of sizes and one Newton step for all sources, kept inside a bracket that shrinks each time.
    full marks sources whose target is cap times their size: the multiplier is infinite there.
    """
    n_docs = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"))
    own = goals.join(n_docs, goals["source"].eqNullSafe(n_docs["source"])).drop(n_docs["source"])
    state = own.select("source", "target", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)).alias("scale"), (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("miss"))

    def step(state: DataFrame) -> DataFrame:
        s = state.select(F.col("source").alias("s"), "lam", "scale")
        each = sizes.join(s, sizes["source"].eqNullSafe(s["s"]))
        r = rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        tokens = F.col("n") * F.col("size")
        sums = each.groupBy("s").agg(F.sum(tokens * r).alias("made"), F.sum(F.when(r < cap, tokens * r * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        x = state.join(sums, state["source"].eqNullSafe(sums["s"])).withColumn("over", F.col("made") - F.col("target"))
        x = x.withColumns({"low": F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(F.col("over") >= 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - F.try_divide(F.col("over"), F.col("slope"))
        inside = newton.isNotNull() & (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        middle = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        # A step away from the bracket's far side is limited, since the gradient is exponential there.
        moved = F.when(inside & (F.abs(newton) <= 4 * F.abs(F.col("lam")) + 4), newton).otherwise(middle)
        done = F.col("full") | (F.abs("over") <= F.lit(1e-8) * F.greatest(F.col("target"), F.lit(1.0)))
        return x.select("source", "target", "scale", "full", F.when(done, F.col("lam")).otherwise(moved).alias("lam"), "low", "high", F.when(done, 0.0).otherwise(F.abs("over") / F.greatest(F.col("target"), F.lit(1.0))).alias("miss"))

    state = materialise(state, "multipliers")
    for _ in range(rounds // 2):
        state = materialise(step(step(state)), "multipliers")  # two steps to a written table
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= 1e-7:
            break
    else:
        raise RuntimeError(f"multipliers did not settle in {rounds} steps")
    return state.select("source", "lam", "scale", "full")


def whole_copies(classes: DataFrame, cap: int) -> DataFrame:
    """(source, size, n, copies): whole copies for each class of documents of one source and size.

    classes has source, size, n, wanted (real copies for the class) and target. Running sums of
    wanted over falling sizes are rounded, so copies follow the rates; the few words that the source
    then lacks or has too many are made up from the largest sizes down, each class giving or taking
    as many whole documents as fit, then one more where that comes nearer, three times. Windows and lists here have one entry for each source and size.
    """
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    classes = classes.withColumn("sum", F.sum("wanted").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.floor(F.col("sum") + 0.5) - F.floor(F.coalesce(F.lag("sum").over(falling), F.lit(0.0)) + 0.5)
    classes = classes.withColumn("k", F.least(F.greatest(k, F.lit(0)), F.col("n") * cap).cast("long"))
    entry = F.struct((-F.col("size")).alias("key"), "size", "n", "k")
    x = classes.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("list"), F.max("target").alias("target"))
    made = F.aggregate("list", F.lit(0).cast("long"), lambda a, c: a + c["size"] * c["k"])
    x = x.withColumn("lack", F.round("target").cast("long") - made)

    def moved_by(moved: Column, size: Column) -> Column:
        return F.aggregate(F.filter(moved, lambda m: m["size"] == size), F.lit(0).cast("long"), lambda a, m: a + m["by"])

    def room(a: Column, c: Column) -> Column:
        now = c["k"] + moved_by(a["moved"], c["size"])
        return F.when(c["size"] <= 0, F.lit(0).cast("long")).when(a["lack"] > 0, c["n"] * cap - now).otherwise(now)

    def move(a: Column, size: Column, many: Column) -> Column:
        by = F.when(a["lack"] > 0, many).otherwise(-many)
        moved = F.when(many > 0, F.concat(a["moved"], F.array(F.struct(size.alias("size"), by.alias("by"))))).otherwise(a["moved"])
        return F.struct((a["lack"] - by * size).alias("lack"), moved.alias("moved"))

    def fill(a: Column, c: Column) -> Column:
        fits = F.when(c["size"] > 0, F.floor(F.abs(a["lack"]) / c["size"])).otherwise(0).cast("long")
        return F.when((a["lack"] == 0) | (fits == 0), a).otherwise(move(a, c["size"], F.least(room(a, c), fits)))

    def overshoot(a: Column) -> Column:
        """The one document whose move brings the sum nearest, if any brings it nearer."""
        found = F.array_min(F.transform(F.filter("list", lambda c: room(a, c) > 0), lambda c: F.struct(F.abs(F.abs(a["lack"]) - c["size"]).alias("off"), c["size"].alias("size"))))
        return let(found, lambda f: F.when(f["off"] < F.abs(a["lack"]), move(a, f["size"], F.lit(1).cast("long"))).otherwise(a))

    state = F.struct(F.col("lack").alias("lack"), F.expr("cast(array() as array<struct<size:bigint,by:bigint>>)").alias("moved"))
    for _ in range(3):
        state = let(F.aggregate("list", state, fill), overshoot)
    x = x.select("source", "list", state["moved"].alias("moved"))
    rows = x.select("source", "moved", F.explode("list").alias("c"))
    by = moved_by(F.col("moved"), F.col("c.size"))
    return rows.select("source", F.col("c.size").alias("size"), F.col("c.n").alias("n"), (F.col("c.k") + by).alias("copies"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] | DataFrame = (3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Rows (doc_id, source, size, text_hash, source_size, target, copies): how often the mix takes each document.

    A size is a text's number of words (null: 0). weights repeat over the sources by code point, or
    come as a table (source, weight). Rates exp(lam * size), capped, make each source's target; they
    depend on source and size alone, so all work but the last join is on a table of sizes. Copies
    are whole numbers up to cap; among documents of one source and size, a hash of the row picks
    which get one more, in groups of about GROUP rows, so no source or size gathers in one task. A
    source's words then miss its target by less than the smallest useful document can mend.

    A null source is one source; null and empty texts have size 0 and are taken as their rate of one
    copy says; texts of any length are counted whole; an empty table gives no rows; other columns,
    whatever their names, are ignored. Rows alike in all of doc_id, source and text count as one
    entry with a number of rows, so a text that makes up much of the corpus is one row to every
    window; its copies are dealt evenly among its rows. Runs agree as a multiset, however the table
    is split.
    """
    size = F.size(word_array(F.col("text").cast("string"))).cast("long")
    light = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")), "sizes")
    sizes = materialise(light.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
    else:
        w = cycle_weights(sources, weights).withColumnRenamed("source", "__s")
    weighed = sources.join(w, sources["source"].eqNullSafe(w["__s"]), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    goals = materialise(targets(weighed, share, float(cap)), "targets")
    lams = balance(sizes, goals, float(cap)).withColumnRenamed("source", "__s")
    g = goals.withColumnRenamed("source", "__g")
    tilted = sizes.join(lams, sizes["source"].eqNullSafe(lams["__s"])).join(g, sizes["source"].eqNullSafe(g["__g"]))
    wanted = F.col("n") * F.when(F.col("full"), F.lit(float(cap))).otherwise(rate(F.col("lam"), F.col("size"), F.col("scale"), float(cap)))
    classes = tilted.select("source", "size", "n", wanted.alias("wanted"), "target")
    got = whole_copies(classes, cap).select(F.col("source").alias("__s"), F.col("size").alias("__size"), "n", "copies")
    gg = goals.select(F.col("source").alias("__g"), "source_size", "target")
    got = got.join(gg, got["__s"].eqNullSafe(gg["__g"])).drop("__g")
    alike = light.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows"))
    x = alike.join(got, alike["source"].eqNullSafe(got["__s"]) & (alike["size"] == got["__size"])).drop("__s", "__size")
    # Groups split a class by hash; each owns its stretch of the class's documents in order of groups.
    groups = F.ceil(F.col("n") / GROUP)
    x = x.withColumn("pick", F.xxhash64("doc_id", "text_hash")).withColumn("group", F.pmod("pick", groups))
    counts = x.groupBy("source", "size", "group").agg(F.sum("rows").alias("in_group"))
    before = Window.partitionBy("source", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("__s"), F.col("size").alias("__size"), F.col("group").alias("__group"), F.coalesce(F.sum("in_group").over(before), F.lit(0)).alias("offset"))
    x = x.join(offsets, x["source"].eqNullSafe(offsets["__s"]) & (x["size"] == offsets["__size"]) & (x["group"] == offsets["__group"])).drop("__s", "__size", "__group")
    earlier = Window.partitionBy("source", "size", "group").orderBy("pick", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"place": F.col("offset") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)), "extra": F.pmod(F.col("copies"), F.col("n"))})
    # extra of n places, spread evenly: place i gets one more where i * extra / n passes a whole number.
    more = F.expr("((place + rows) * extra) div n - (place * extra) div n")
    x = x.withColumn("all", (F.col("rows") * F.floor(F.col("copies") / F.col("n")) + more).cast("long"))
    columns = ("doc_id", "source", "size", "text_hash", "source_size", "target")
    single = x.filter("rows = 1").select(*columns, F.col("all").alias("copies"))
    # Rows alike come out in blocks that are dealt anew, so many of them are no one task's work.
    part = lambda copies, rows: F.struct(copies.cast("long").alias("copies"), rows.cast("long").alias("rows"))
    least, above = F.expr("all div rows"), F.expr("all % rows")
    dealt = x.filter("rows > 1").select(*columns, F.explode(F.array(part(least + 1, above), part(least, F.col("rows") - above))).alias("part")).filter("part.rows > 0")
    blocks = dealt.select(*columns, "part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("part.rows") - 1), F.lit(BLOCK).cast("long"))).alias("at"))
    spread = blocks.repartition("doc_id", "text_hash", "at")
    several = spread.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.col("part.rows") - F.col("at"))))).select(*columns, F.col("part.copies").alias("copies"))
    return single.unionByName(several)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as many times as mix() says, columns unchanged whatever their names.

    Of rows alike in doc_id, source and text, which may differ in other columns, some get a copy more
    than others where mix() says so; their sum is that of mix(). An empty table gives an empty one.
    """
    own, back = shielded(docs, ("doc_id", "text", "source"))
    key = {"the id": F.col("doc_id").cast("long"), "the source": F.col("source").cast("string"), "the hash": F.xxhash64(F.col("text").cast("string"))}
    taken = mix(docs, **options).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("t id"), F.col("source").alias("t source"), F.col("text_hash").alias("t hash"), "copies", "rows")
    same = F.col("the id").eqNullSafe(F.col("t id")) & F.col("the source").eqNullSafe(F.col("t source")) & (F.col("the hash") == F.col("t hash"))
    x = own.withColumns(key).join(taken, same).drop("t id", "t source", "t hash")
    times = F.expr("cast(copies div rows as int)")
    even = x.filter("copies % rows = 0").withColumn("times", times).drop("the id", "the source", "the hash")
    # The others are written with a number; their place among rows alike is that in their file's part, after the parts before.
    odd = materialise(x.filter("copies % rows != 0").withColumn("row", F.monotonically_increasing_id()), "alike").withColumn("part", F.shiftright("row", 33))
    names = ["the id", "the source", "the hash"]
    counts = odd.groupBy(*names, "part").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(n).alias(f"o {n}") for n in names], F.col("part").alias("o part"), F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("offset"))
    same = F.col("part") == F.col("o part")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"o {n}"))
    placed = odd.join(offsets, same).withColumn("place", F.col("offset") + F.row_number().over(Window.partitionBy(*names, "part").orderBy("row")) - 1)
    odd = placed.withColumn("times", times + F.expr("cast(place < copies % rows as int)")).select(*even.columns)
    return back(even.unionByName(odd).filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))))
