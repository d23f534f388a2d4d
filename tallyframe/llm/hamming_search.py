"""Exact top-k search by incremental multi-index hashing over binary codes.

A vector's code has one bit for each dimension (set where the value is above zero), 64 in all; dimensions beyond 64 are
added up by their index modulo 64 first. Codes are cut into SEGMENTS segments of 16 bits; the index has a row for each
(segment, value, code). A search grows the segments' radii one after the other: at radius
r it probes the values that differ from the query's segment in exactly r bits, and verifies what it meets by its whole
Hamming distance. With j of m segments at radius r and the others at r - 1, every code within m * r + j - 1 bits has
been met (pigeonhole), so only as many segments grow as the bound on the k-th distance asks for, and a query is
finished once that bound is covered. Radii end at the segment's width, when all codes have been met.

Equal codes are one row of the index with their k + 1 smallest ids, and equal queries are one search, so a vector that
holds a third of all rows costs no more than others. A bound from a fixed sample of codes, and later the k-th verified
distance, sits in the join's condition, so that what is too far never leaves the join.

Cases: a row is never its own neighbour, another row with the same vector is; ties go to the smaller id; null vectors and
null ids take no part; null elements count as 0; an id that repeats counts once for each distinct code; fewer than k
others give fewer rows; an empty table gives none; extra columns play no part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise

BITS = 64
K = 10
SEGMENTS = 4
SAMPLE = 512


def binary_code(vector: Column) -> Column:
    """64-bit code of an array of numbers."""
    value = lambda i: F.coalesce(F.get(vector, i), F.lit(0.0))
    folded = lambda b: F.when(F.size(vector) <= BITS, value(b)).otherwise(F.aggregate(F.sequence(b, F.greatest(F.size(vector) - 1, b), F.lit(BITS)), F.lit(0.0), lambda acc, i: acc + value(i)))
    bit = lambda b: F.when(folded(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.when(vector.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b))))


def _segments() -> list[tuple[int, int]]:
    """(shift, width) of each segment. At 16 bits a radius has at most 12,870 masks, whatever the number of codes."""
    return [(BITS // SEGMENTS * k, BITS // SEGMENTS) for k in range(SEGMENTS)]


def _value(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND((1 << width) - 1).cast("int")


def _flips(width: int, radius: int) -> Column:
    masks = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>") if masks else F.lit(None).cast("array<int>")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest codes of each query, and as `bound` the distance within which they hold k + 1 ids.

    A nearer code may hold many ids, but one of the k + 1 nearest ids never belongs to a code beyond the first k + 1.
    """
    order = Window.partitionBy("query").orderBy("distance", "first_id")
    nearest = pairs.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k + 1)
    counted = nearest.withColumn("__held", F.sum("members").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bound = F.coalesce(F.min(F.when(F.col("__held") > k, F.col("distance"))).over(Window.partitionBy("query")), F.lit(BITS))
    return counted.select("query", "code", "first_id", "members", "distance", bound.alias("bound"))


def top_k(base: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """base, queries: (id long, code long). Result: query_id, neighbor_id, distance, rank from 1."""
    spark = base.sparkSession
    by_id = Window.partitionBy("code").orderBy("id")
    small = base.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct().withColumn("__rank", F.row_number().over(by_id)).where(F.col("__rank") <= k + 1)
    codes = materialise(small.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    segments = _segments()
    index = codes.select("code", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("members"), F.posexplode(F.array(*[_value(F.col("code"), *s) for s in segments])).alias("segment", "value"))
    index = materialise(index, "segments")
    # At most SAMPLE codes reach the driver and the plan; they only give a first bound on the k-th distance.
    drawn = codes.select("code", F.size("ids").alias("members")).orderBy(F.xxhash64("code")).limit(SAMPLE).collect()
    literal = lambda name: F.split(F.lit(",".join(str(r[name]) for r in drawn)), ",").cast("array<long>")
    near = F.array_sort(F.zip_with(literal("code"), literal("members"), lambda c, n_: F.struct(_distance(c, F.col("query")).alias("d"), n_.cast("int").alias("n")))) if drawn else F.expr("cast(array() as array<struct<d:int,n:int>>)")
    within = F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(BITS).alias("d")), lambda acc, x: F.when(acc["n"] > k, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), x["d"].alias("d"))), lambda acc: F.when(acc["n"] > k, acc["d"]).otherwise(BITS))
    open_ = materialise(asked.select("query").distinct().select("query", within.alias("bound")), "open")
    found, radius = None, 0
    while True:
        # Open queries are few rows that grow to thousands of probes each, so they are dealt out by number first.
        dealt = open_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query")
        probes = None
        for width in sorted({w for _, w in segments}):
            own = [(k_, s) for k_, s in enumerate(segments) if s[1] == width and radius <= width]
            if own:
                values = F.explode(F.array(*[F.struct(F.lit(k_).alias("segment"), _value(F.col("query"), *s).alias("value")) for k_, s in own]))
                needed = F.col("v.segment") <= F.col("bound") - len(segments) * radius
                rows = dealt.select("query", "bound", values.alias("v")).where(needed).select("query", "bound", "v.segment", "v.value", F.explode(_flips(width, radius)).alias("flip"))
                rows = rows.select("query", "bound", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
                probes = rows if probes is None else probes.unionByName(rows)
        distance = _distance(F.col("p.query"), F.col("i.code"))
        # Probes are far larger than the table they are exploded from, so no estimate may broadcast them.
        met = probes.hint("merge").alias("p").join(index.hint("merge").alias("i"), (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value")) & (distance <= F.col("p.bound")))
        pairs = met.select("p.query", "i.code", "i.first_id", "i.members", distance.alias("distance"))
        if found is not None:
            pairs = pairs.unionByName(found.select(*pairs.columns))
        found = materialise(_best(pairs.dropDuplicates(["query", "code"]), k), "nearest")
        covered = len(segments) * (radius + 1) - 1
        reached = found.groupBy("query").agg(F.min("bound").alias("reached"))
        left = open_.join(reached, "query", "left").select("query", F.least("bound", F.coalesce("reached", F.lit(BITS))).alias("bound"))
        open_ = materialise(left.where(F.col("bound") > covered), "open")
        radius += 1
        if radius > max(w for _, w in segments) or open_.isEmpty():
            break
    answers = found.join(codes.select("code", "ids").hint("merge"), "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    paired = asked.join(answers, "query").where("query_id <> neighbor_id").groupBy("query_id", "neighbor_id").agg(F.min("distance").cast("int").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return paired.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op8_hamming_top_k(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), binary_code(F.col("embedding")).alias("code"))
    rows = materialise(rows, "vectors")
    return top_k(rows, rows.where("id % 20 = 0"))


QUERIES = {"op8_hamming_top_k": op8_hamming_top_k}
SQL = {
    "op8_hamming_top_k": """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id,
         CAST(list_sum([CASE WHEN (coalesce(q.embedding[i], 0) > 0) <> (coalesce(b.embedding[i], 0) > 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS INTEGER) AS distance
  FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS "rank" FROM d)
SELECT query_id, neighbor_id, distance, "rank" FROM r WHERE "rank" <= 10
"""
}
