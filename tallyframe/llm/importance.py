"""Target-distribution importance resampling over hashed n-grams from a position table.

Words of a text, A-Z lower-cased, become a table (row, place, word). A feature of order k is k consecutive words joined by
one space: lead() over a document's places fetches the words that follow. A feature's bucket is the crc32 of its UTF-8
bytes modulo BUCKETS. With S features of the corpus (s in the bucket) and T of the target (t), a bucket's gain is
floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))), and a document's weight the floored mean of its
features' gains. Its score adds Gumbel noise that depends on (seed, doc_id) alone, and the documents of highest score are
a sample without replacement with odds in proportion to the importance weights.

The table of (row, bucket) is written once; counts of buckets and sums of gains are read from it, combined where they are
read. Gains are at most BUCKETS rows, so their broadcast is bounded. Windows are taken over pieces of CHUNK places, each
with the next piece's first words, so a very long text is several groups. Ranks come from counts of equal scores (whole
numbers between the least gain and the largest noise, some ten thousands whatever the input) and a window within one score.

Cases: null and empty texts have no features and weight 0; a null doc_id draws its noise as an empty string and comes last
among equal scores; repeated rows are scored and drawn each, and among equal scores and ids the one with fewer features
comes first; documents of fewer than MIN_WORDS words are scored but never drawn; an empty target gives every bucket
t = T = 0; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import ascii_lower, materialise
from tallyframe.llm.spelling import _CRC_TABLE, crc_sql

BUCKETS = 10_000
ORDERS = 1
SHARE = 10
SEED = 2024
MIN_WORDS = 20
CHUNK = 1 << 16

#: What stands between words: the ASCII characters that are neither digits nor small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def position_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, place, word): a row for each word, or one with null place and word for a text without words."""
    found = F.filter(F.split(ascii_lower(F.col(text_col).cast("string")), BETWEEN), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), found.alias("words"))
    return rows.select("row", "id", F.posexplode_outer("words").alias("place", "word"))


def features(positions: DataFrame, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """(row, id, feature): the runs of 1 to `orders` words that begin at each place; null for a text without words."""
    if orders == 1:
        return positions.select("row", "id", F.col("word").alias("feature"))
    piece = F.floor(F.col("place") / chunk)
    # the first words of a piece are lent to the one before, where they end runs but begin none
    lent = positions.where((F.col("place") >= chunk) & (F.col("place") % chunk < orders - 1))
    dealt = positions.withColumn("piece", piece).withColumn("own", F.lit(True)).unionByName(lent.withColumn("piece", piece - 1).withColumn("own", F.lit(False)))
    order = Window.partitionBy("row", "piece").orderBy("place")
    following = [F.lead("word", k).over(order).alias(f"w{k}") for k in range(1, orders)]
    table = dealt.select("row", "id", "own", "word", *following).where("own")
    runs = [F.col("word")]
    for k in range(1, orders):
        runs.append(F.when(F.col(f"w{k}").isNotNull(), F.concat(runs[-1], F.lit(" "), F.col(f"w{k}"))))
    # of a text without words one row stays, as with single words
    made = F.when(F.col("word").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.array(*runs), lambda r: r.isNotNull()))
    return table.select("row", "id", F.explode(made).alias("feature"))


def bucketed(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, chunk: int = CHUNK, **columns) -> DataFrame:
    """(row, id, bucket) for every feature of docs."""
    rows = features(position_table(docs, **columns), orders, chunk)
    return rows.select("row", "id", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that corpus (bucket) shows, against target (bucket)."""
    s, t = (materialise(df.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(name)), "counts") for df, name in ((corpus, "s"), (target, "t")))
    S, T = s.agg(F.sum("s")).first()[0] or 0, t.agg(F.sum("t")).first()[0] or 0
    above = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(S + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(T + buckets))
    return s.join(t, "bucket", "left").select("bucket", F.floor(F.log(above / below) * 1000).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) for u from the first 32 bits of sha256('<seed>:<doc_id>')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def scores(rows: DataFrame, gains: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, id, n_features, weight, score) for rows (row, id, bucket); gains has at most a row for each bucket."""
    gained = rows.join(F.broadcast(gains), "bucket", "left")
    summed = gained.groupBy("row", "id").agg(F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weighed = summed.select("row", "id", F.col("n").alias("n_features"), F.expr("CASE WHEN n > 0 THEN (total - pmod(total, n)) DIV n ELSE 0L END").alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def drawn(scored: DataFrame, wanted: int, eligible: Column) -> DataFrame:
    """scored with `rank` (from 1) for the `wanted` rows of highest score among the eligible, null for the others."""
    counts = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # one row for each score that occurs, which are bounded by the gains' range
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.select("score", before.alias("before")).where(F.col("before") < wanted)
    marked = scored.withColumn("eligible", eligible).join(F.broadcast(reached), "score", "left")
    inside = F.col("eligible") & F.col("before").isNotNull()
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "row")
    ranked = marked.where(inside).withColumn("rank", F.col("before") + F.row_number().over(order))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = marked.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("eligible", "before")


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs: `share` per cent of those with min_words words are drawn."""
    corpus = materialise(bucketed(docs, orders, buckets, chunk, id_col=id_col, text_col=text_col), "buckets")
    wanted_buckets = bucketed(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), orders, buckets, chunk, id_col="id", text_col="text")
    scored = materialise(scores(corpus, bucket_gains(corpus, wanted_buckets, buckets), seed), "scores")
    # n words make n + (n - 1) + ... features of orders 1, 2, ...
    least = sum(max(min_words - k, 0) for k in range(orders))
    eligible = F.col("n_features") >= least
    wanted = scored.where(eligible).count() * share // 100
    return drawn(scored, wanted, eligible).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"))


QUERIES = {"op12_importance_resampling": op12_importance_resampling}

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op12_importance_resampling": rf"""
WITH tab AS ({_CRC_TABLE}),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest({_WORDS.format(text="coalesce(text, '')")}) AS w FROM benchmark),
vocabulary AS (SELECT w FROM dw UNION SELECT w FROM bw),
hashed AS (SELECT w, {crc_sql("w")} % 10000 AS b FROM vocabulary, tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY b),
gain AS (
  SELECT s.b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t ON t.b = s.b
),
weighed AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM dw JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT d.doc_id, d.r, coalesce(n, 0) AS n_features, CAST(CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN weighed ON weighed.r = d.r
),
placed AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, r) AS k FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN k END AS rank FROM placed
"""
}
