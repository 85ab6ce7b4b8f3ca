"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document of size s in a source gets the rate min(3, exp(lambda * s / scale)), the rates nearest to 1 in relative
entropy under the source's token constraint sum(rate * s) = target and the bound of 3 copies. The dual has one variable
a source and is convex; distributed Newton steps solve it over the histogram of (source, size), each step one
aggregation. Rates become whole copies cell by cell, largest sizes first; a cell's rounding error is carried to the
next smaller size. Cells are rounded in chunks of ``CHUNK`` sizes, and what the chunks leave goes to the one with the
smallest sizes, so that a source misses its target by about half of its smallest document. Within a cell the copies
beyond the common number go to the rows that come first by hash, up to a cut-off, so reruns agree and texts are read
where they lie: only (source, size, hash) is dealt out.

Cases: null and empty texts have size 0 and are taken 0 times (``mix_rows`` leaves them as they are); null sources are
a source of their own, which sorts last; repeated rows are separate documents, of which as many as needed get the copy
more; an empty table gives no rows; own columns of any name are kept, also those named like an output of op10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
ROUNDS = 60
CHUNK = 256
#: Up to so many cells (28 MB) are sent to all; beyond that rows and cells are shuffled.
BROADCAST_CELLS = 500_000


def word_count(text: Column) -> Column:
    """Words are runs of characters other than space and 0x09 to 0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sharing by weight with caps is water filling: a source is capped if and only if cap / weight is below the level
    that the sources after it, by cap / weight, would share. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weighing", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("weighing"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return s.withColumn("at", level).select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("at", F.lit(0.0))).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve(cells: DataFrame, goal: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(source, lam, scale): the dual variables. cells: (source, size, n), sizes above 0; goal: (source, target, source_size).

    Newton's step is kept within a bracket and is replaced by the bracket's middle where it leaves it, so each round at
    least halves the bracket. Sources at their cap take the upper end: every document three times.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    scale = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    state = goal.alias("g").join(F.broadcast(scale.alias("s")), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.source", "target", "scale", F.when(F.col("target") >= MOST_COPIES * F.col("source_size") * (1 - 1e-12), True).otherwise(False).alias("full"), (F.lit(3.0) * F.col("scale") / F.col("least")).alias("hi"), (F.lit(-60.0) * F.col("scale") / F.col("least")).alias("lo"), F.lit(0.0).alias("lam"), F.lit(1.0).alias("off"))
    state = state.checkpoint()
    for k in range(rounds):
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), x)
        rows = cells.alias("c").join(F.broadcast(state.alias("t")), F.col("c.source").eqNullSafe(F.col("t.source"))).select("t.*", "size", "n")
        got = rows.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("have"), F.sum(F.when(rate < MOST_COPIES, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"), *(F.first(c).alias(c) for c in ("target", "scale", "full", "hi", "lo", "lam"))
        )
        over = F.col("have") > F.col("target")
        got = got.withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam")))
        step = F.col("lam") - (F.col("have") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        step = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        off = F.when(F.col("full") | (F.col("target") <= 0), 0.0).otherwise(F.abs(F.col("have") / F.col("target") - 1))
        state = got.select("source", "target", "scale", "full", "hi", "lo", F.when(off < 1e-9, F.col("lam")).otherwise(step).alias("lam"), off.alias("off")).checkpoint()
        if (state.agg(F.max("off")).first()[0] or 0) < 1e-9:
            break
    # sums of doubles differ in their last digits from run to run; rounded, the answer does not
    return state.select("source", F.when(F.col("full"), F.col("hi") + 1e6).otherwise(F.round("lam", 9)).alias("lam"), "scale")


def _null_safe(a: str, b: str, *more: str) -> Column:
    same = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for c in more:
        same &= F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return same


def cell_copies(cells: DataFrame, goal: DataFrame, duals: DataFrame) -> DataFrame:
    """(source, size, n, copies): whole copies for each cell, rounded in chunks of neighbouring sizes."""
    t = duals.alias("d").join(goal.alias("g"), _null_safe("d", "g")).select("d.source", "lam", "scale", "target")
    want = F.when(F.col("target") > 0, _rate(F.col("lam"), F.col("size") / F.col("scale"))).otherwise(0.0) * F.col("n")
    cell = F.struct((-F.col("size")).alias("order"), "size", "n", want.alias("want")).alias("cell")
    # chunk 0 has the smallest sizes
    chunk = F.floor((F.row_number().over(Window.partitionBy("t.source").orderBy("size")) - 1) / CHUNK).alias("chunk")
    rated = cells.alias("c").join(F.broadcast(t.alias("t")), _null_safe("c", "t")).select("t.source", cell, chunk)
    grouped = rated.groupBy("source", "chunk").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    whole = f"least({MOST_COPIES} * c.n, greatest(0, cast(round((a.carry + c.want * c.size) / c.size) as bigint)))"
    fold = f"""aggregate(cells, named_struct('carry', start, 'out', cast(array() as array<struct<size:bigint,n:bigint,copies:bigint>>)),
          (a, c) -> named_struct('carry', a.carry + c.want * c.size - {whole} * c.size, 'out', array_append(a.out, named_struct('size', c.size, 'n', c.n, 'copies', {whole}))))"""
    upper = C.written(grouped.where("chunk > 0").withColumn("start", F.lit(0.0)).select("source", F.expr(fold).alias("done")), "chunks")
    left = upper.groupBy("source").agg(F.sum("done.carry").alias("left"))
    lower = grouped.where("chunk = 0").alias("g").join(left.alias("l"), _null_safe("g", "l"), "left").select("g.source", "cells", F.coalesce("left", F.lit(0.0)).alias("start"))
    return upper.union(lower.select("source", F.expr(fold).alias("done"))).select("source", F.inline("done.out"))


def cell_plan(sized: DataFrame) -> DataFrame:
    """One row for each (source, size) of ``sized`` (source, size, h; a written table): source_size, target, and, for
    sizes above 0, common (copies of every row), cut, extra and same: rows with h below cut get one more, and so do
    ``extra`` of the ``same`` rows whose h is cut."""
    cells = C.written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))).checkpoint()
    filled = cells.where("size > 0")
    copies = cell_copies(filled, goal, solve(filled, goal))
    rest = copies.select("source", "size", F.floor(F.col("copies") / F.col("n")).alias("common"), (F.col("copies") % F.col("n")).alias("rest"))
    rest = C.written(rest, "rest")
    # the part of each cell, by the upper bits of h, in which the cut-off lies; only there rows are ordered
    part = F.shiftright("h", 54)
    parts = sized.where("size > 0").groupBy("source", "size", part.alias("part")).agg(F.count("*").alias("rows"))
    so_far = F.sum("rows").over(Window.partitionBy("source", "size").orderBy("part"))
    parts = parts.withColumn("upto", so_far).alias("p").join(rest.alias("r"), _null_safe("p", "r", "size")).where("rest > upto - rows and rest <= upto")
    parts = parts.select("p.source", "p.size", "part", (F.col("rest") - F.col("upto") + F.col("rows")).alias("within"))
    values = sized.where("size > 0").withColumn("part", part).alias("v").join(parts.alias("p"), _null_safe("v", "p", "size", "part")).groupBy("p.source", "p.size", "p.part", "h").agg(F.count("*").alias("same"), F.first("within").alias("within"))
    upto = F.sum("same").over(Window.partitionBy("source", "size", "part").orderBy("h"))
    cuts = values.withColumn("upto", upto).where("within > upto - same and within <= upto").select("source", "size", F.col("h").alias("cut"), "same", (F.col("within") - F.col("upto") + F.col("same")).alias("extra"))
    plan = cells.alias("c").join(F.broadcast(goal.alias("g")), _null_safe("c", "g")).select("c.source", "c.size", F.col("source_size").cast("long").alias("source_size"), "target")
    plan = plan.alias("p").join(rest.alias("r"), _null_safe("p", "r", "size"), "left").select("p.*", "common")
    plan = plan.alias("p").join(cuts.alias("k"), _null_safe("p", "k", "size"), "left").select("p.*", "cut", "same", "extra")
    return C.written(plan, "plan")


def with_copies(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, a struct of all columns of docs, or of ``keep``; size, source_size, target, copies). docs: source, text and any
    others. Texts are read twice where they are kept; else once, and what is kept is written in between."""
    C.shared_dir(docs.sparkSession)
    maps = [f.name for f in docs.schema if isinstance(f.dataType, T.MapType)]
    col = lambda c: F.col(f"`{c}`")
    plain = [F.array_sort(F.map_entries(col(c))).alias(c) if c in maps else col(c) for c in docs.columns]
    kept = [x for c, x in zip(docs.columns, plain) if keep is None or c in keep]
    rows = docs.select(F.struct(*kept).alias("row"), "source", word_count(F.col("text")).alias("size"), F.xxhash64(*plain).alias("h"))
    if keep is not None:
        rows = C.written(rows, "rows")
    plan = cell_plan(rows if keep is not None else C.written(rows.select("source", "size", "h"), "sizes"))
    met = rows.alias("r").join(F.broadcast(plan.alias("p")) if plan.count() <= BROADCAST_CELLS else plan.alias("p"), _null_safe("r", "p", "size"))
    known = met.select("row", "r.size", "source_size", "target", F.coalesce("common", F.lit(0)).alias("common"), "h", "cut", "same", "extra")
    tied = F.coalesce((F.col("h") == F.col("cut")) & (F.col("extra") < F.col("same")), F.lit(False))
    one_more = F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).cast("long")
    out = known.where(~tied).select("row", "size", "source_size", "target", (F.col("common") + one_more).cast("int").alias("copies"))
    if not plan.where("extra < same").isEmpty():
        # rows with one hash, mostly equal ones: counted, they share the copies that are left in the order of their values
        by = ["row", "size", "source_size", "target", "common", "h", "extra"]
        equal = known.where(tied).groupBy(*by).agg(F.count("*").alias("times"))
        before = F.coalesce(F.sum("times").over(Window.partitionBy("size", "source_size", "h", F.col("row.source")).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        more = equal.withColumn("more", F.greatest(F.lit(0), F.least("times", F.col("extra") - before))).select(*by, "more", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("k"))
        out = out.union(more.select("row", "size", "source_size", "target", (F.col("common") + (F.col("k") <= F.col("more")).cast("long")).cast("int")))
    if maps:
        names = [c for c in docs.columns if keep is None or c in keep]
        back = F.struct(*(F.map_from_entries(F.col("row").getField(c)).alias(c) if c in maps else F.col("row").getField(c).alias(c) for c in names))
        out = out.withColumn("row", back)
    return out


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = with_copies(docs, ["doc_id", "source"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it. Documents without words are left as they are."""
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    mixed = with_copies(docs).withColumn("times", times).where("times > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
