"""Mixing sources to target weights by temperature.

Source s with token share p_s gets weight p_s ** a / sum; the exponent a is bisected over [0, 1] to the largest value that
meets a target entropy, or that keeps every source's repetition (weighted budget over its tokens) within a limit. The
budget is `epochs` times all tokens, or, with `keep_all`, the smallest one under which no source is read less than once.

A source's documents are then read in passes. In pass e its blocks (BLOCK_DOCS documents on average, by hash of id, source and text) are
put in the order of a keyed hash of (seed, source, e, block), and so are the documents of a block. Whole passes repeat every
document; the last pass takes blocks while they fit the source's remaining tokens, and of the block where the budget
ends the documents that still fit. `plan` says how often each document is read, `schedule` lists every reading with its
pass, the rank of its block in the pass and its place in the block. No window covers a whole source: ranks and running
totals of blocks are taken within RANGES ranges of the keyed hash and added to those of the ranges before.

Cases: a null source is a source of its own; null and empty texts have no tokens (such documents follow their block);
a source without tokens gets weight 0 and no pass, or one with `keep_all`; repeated rows count each; rows with a null id
are dealt to blocks one by one, by where they are read, so that copies of one text do not fill a block; an empty table gives
no rows; extra columns are kept by `mixed`, whatever their names.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise, packed, quoted

BLOCK_DOCS = 512
SEED = 6
MAX_REPEAT = 1.25
GRID = 32
STEPS = 5
RANGES = 4096


def tokens(text: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))).cast("long")


def _at(sizes: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: sum of n ** a, sum of n ** a * ln(n ** a), and the largest n ** a / n. One row reaches the driver."""
    n = F.col("tokens").cast("double")
    power = lambda a: F.exp(F.log(n) * a)
    cells = []
    for k, a in enumerate(exponents):
        cells += [F.sum(power(a)).alias(f"z{k}"), F.sum(power(a) * F.log(n) * a).alias(f"l{k}"), F.max(power(a) / n).alias(f"m{k}")]
    row = sizes.where("tokens > 0").agg(*cells).first()
    return [(row[f"z{k}"], row[f"l{k}"], row[f"m{k}"]) for k in range(len(exponents))]


def solve_exponent(sizes: DataFrame, max_repeat: float | None = None, min_entropy: float | None = None, epochs: float = 1.0, keep_all: bool = False) -> tuple[float, float]:
    """(exponent, budget in tokens) for sizes (source, tokens): GRID-way bisection, one aggregation a step.

    Repetition is smallest at exponent 1 and grows as it falls; entropy grows as it falls. With a limit on repetition
    the smallest exponent within it is taken (the flattest mix allowed), with an entropy the largest that reaches it.
    An unreachable entropy gives exponent 0, an unreachable limit 1.
    """
    total = sizes.agg(F.sum("tokens").alias("n"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")).first()
    if not total.n:
        return 1.0, 0.0
    budget_of = lambda z, most, least: z / least if keep_all else epochs * total.n
    low, high = 0.0, 1.0
    found_budget = float(total.n)
    for _ in range(STEPS):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        stats = _at(sizes, grid)
        leasts = _least(sizes, grid) if keep_all else [1.0] * len(grid)
        good = []
        for (z, entropy_part, most), least in zip(stats, leasts, strict=True):
            budget = budget_of(z, most, least)
            if min_entropy is not None:
                good.append(log(z) - entropy_part / z >= min_entropy)
            else:
                good.append(most * budget / z <= (max_repeat or MAX_REPEAT) * (1 + 1e-12))
        if min_entropy is not None:  # good for small exponents
            k = max([k for k, ok in enumerate(good) if ok], default=0)
            low, high = grid[k], grid[min(k + 1, GRID)]
            pick = low
        else:  # good for large exponents
            k = min([k for k, ok in enumerate(good) if ok], default=GRID)
            low, high = grid[max(k - 1, 0)], grid[k]
            pick = high
        j = grid.index(pick)
        found_budget = budget_of(*stats[j][::2], leasts[j])
        if low == high:
            break
    return pick, found_budget


def _least(sizes: DataFrame, exponents: list[float]) -> list[float]:
    n = F.col("tokens").cast("double")
    row = sizes.where("tokens > 0").agg(*[F.min(F.exp(F.log(n) * a) / n).alias(f"m{k}") for k, a in enumerate(exponents)]).first()
    return [row[f"m{k}"] for k in range(len(exponents))]


def _order(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


def _mark(doc_id: Column, source: Column, text: Column) -> Column:
    """What rows equal in id, source and text share."""
    return _order(doc_id, source, text, F.lit("block"))


def _before(blocks: DataFrame, key: Column, group: list[str], size: Column, name: str) -> DataFrame:
    """blocks with the sum of `size` over those before it in its group, in order of key and then block.

    Two levels: totals of RANGES ranges of the key (few rows for each group), then the blocks within a range.
    """
    keyed = blocks.withColumn("key", key).withColumn("range", F.shiftright("key", 64 - RANGES.bit_length() + 1))
    totals = keyed.groupBy(*group, "range").agg(F.sum(size).alias("held"))
    prior = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(g).alias(f"of_{g}") for g in group], F.col("range").alias("of_range"), F.coalesce(F.sum("held").over(prior), F.lit(0)).alias("prior"))
    inner = Window.partitionBy(*group, "range").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.withColumn("inner", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    same = F.col("range") == F.col("of_range")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return running.join(totals, same).withColumn(name, F.col("prior") + F.col("inner")).drop("key", "range", "inner", "prior", "of_range", *[f"of_{g}" for g in group])


def plan(docs: DataFrame, max_repeat: float | None = MAX_REPEAT, min_entropy: float | None = None, epochs: float = 1.0, keep_all: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, mark (a hash of id, source and text), tokens, block, weight (of its source), copies."""
    doc_id, source, text = F.col(id_col), F.col(source_col).cast("string"), F.col(text_col)
    rows = docs.select(doc_id.alias("doc_id"), source.alias("source"), _mark(doc_id, source, text).alias("mark"), tokens(text).alias("tokens"))
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("spread", _order(F.col("mark"), apart)), "tokens")
    sizes = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    exponent, budget = solve_exponent(sizes, max_repeat, min_entropy, epochs, keep_all)
    power = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens").cast("double")) * exponent)).otherwise(0.0)
    norm = sizes.agg(F.sum(power)).first()[0] or 1.0
    wanted = F.floor(F.round(power / norm * budget, 6)).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(1 if keep_all else 0).cast("long")
    shares = sizes.withColumn("weight", power / norm).withColumn("wanted", wanted).withColumn("passes", passes)
    shares = shares.select("source", "weight", "passes", F.greatest(F.col("wanted") - F.col("passes") * F.col("tokens"), F.lit(0)).alias("rest"), F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(1)).cast("long").alias("blocks"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    dealt = rows.alias("d").join(shares.alias("s"), same("d", "s")).select("d.*", "s.weight", "s.passes", "s.rest", F.pmod("d.spread", "s.blocks").alias("block"))
    dealt = materialise(dealt, "dealt")
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"), F.first("passes").alias("pass"))
    placed = _before(blocks, _order(F.col("source"), F.col("pass"), F.col("block")), ["source"], F.col("size"), "before")
    placed = placed.select("source", "block", F.when(F.col("before") + F.col("size") <= F.col("rest"), "whole").when(F.col("before") < F.col("rest"), "cut").otherwise("none").alias("fate"), (F.col("rest") - F.col("before")).alias("room"))
    fated = dealt.alias("d").join(placed.alias("p"), same("d", "p") & (F.col("d.block") == F.col("p.block"))).select("d.*", F.when(F.col("rest") > 0, F.col("p.fate")).otherwise("none").alias("fate"), "p.room")
    inner = Window.partitionBy("source", "block").orderBy(_order(F.col("source"), F.col("passes"), F.col("doc_id")), "doc_id", "tokens")
    cut = fated.where("fate = 'cut'").withColumn("sum", F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = lambda extra: ("doc_id", "source", "mark", "tokens", "block", "weight", (F.col("passes") + extra.cast("long")).alias("copies"))
    return fated.where("fate <> 'cut'").select(*out(F.col("fate") == "whole")).unionByName(cut.select(*out(F.col("sum") <= F.col("room"))))


def schedule(docs: DataFrame, **options) -> DataFrame:
    """One row for each reading of a document: doc_id, source, tokens, weight, pass (from 0), block, block_rank, position.

    A source is read in order of pass, block_rank and position (both from 0, without gaps).
    """
    planned = materialise(plan(docs, **options), "plan")
    read = planned.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    blocks = read.groupBy("source", "pass", "block").agg(F.lit(1).cast("long").alias("one"))
    ranked = _before(blocks, _order(F.col("source"), F.col("pass"), F.col("block")), ["source", "pass"], F.col("one"), "block_rank")
    ranked = ranked.select(F.col("source").alias("of_source"), F.col("pass").alias("of_pass"), F.col("block").alias("of_block"), "block_rank")
    inner = Window.partitionBy("source", "pass", "block").orderBy(_order(F.col("source"), F.col("pass"), F.col("doc_id")), "doc_id", "tokens")
    placed = read.withColumn("position", F.row_number().over(inner).cast("long") - 1)
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("pass") == F.col("of_pass")) & (F.col("block") == F.col("of_block"))
    return placed.join(ranked, same).select("doc_id", "source", "tokens", "weight", "pass", "block", "block_rank", "position")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as its copies say, all columns. Rows equal in id, source and text share a copy count."""
    key = ("doc_id", "source", "mark")
    copies = plan(docs, **options).groupBy(*key).agg(F.max("copies").alias("copies")).where("copies > 0").select(*[F.col(c).alias(f"of_{c}") for c in key], "copies")
    doc_id, source = quoted(options.get("id_col", "doc_id")), quoted(options.get("source_col", "source")).cast("string")
    rows = packed(docs, doc_id=doc_id, source=source, mark=_mark(doc_id, source, quoted(options.get("text_col", "text"))))
    joined = rows.join(copies, (F.col("mark") == F.col("of_mark")) & F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mixing(spark, sf_dir):
    return schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def entropy_of(shares: list[float]) -> float:
    return -sum(p * log(p) for p in shares if p > 0)


def effective_sources(shares: list[float]) -> float:
    return exp(entropy_of(shares))


QUERIES = {"op6_mixing": op6_mixing}
