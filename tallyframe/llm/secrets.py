"""Secret scans with DataFrame functions only.

Base kinds are patterns. The method adds spans of kind `model`: runs of ALPHABET characters, at least MODEL_LENGTH long
and with a digit, that touch no base span and whose mean log-likelihood ratio per character, first-order Markov model
of random strings against that of ordinary identifiers, is over a threshold. Both models come from a labelled sample
(`labelled_sample` or any table of token and label); the threshold is the QUANTILE of the sample's ordinary tokens.

Offsets are code points, ends exclusive. They come from splitting a text at its matches: gaps and matches alternate.

Cases: null text counts as empty; a document without spans has empty lists and the digest of the empty text; repeated
rows are scanned alike; extra columns play no part; very long texts are scanned whole, in time that grows with their
length: no pattern tries a run twice, and offsets are summed in chunks of CHUNK matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "model")
#: The same matches as HEX and ACCESS after the length tests: their runs are maximal, so a short one holds no long one.
#: A run of the model that holds one of these two contains it whole, since its alphabet contains theirs.
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}", "model": r"[A-Za-z0-9+/_=-]{20,}"}
MODEL_LENGTH = 20
CHUNK = 256
LOW, WIDE = 43, 80  # '+' to 'z'
SAMPLE = 4000
QUANTILE = 0.999
FLOOR = 0.5
WORDS = """
get set user name file path list item count test case data load open read write time date page view index value config server
client request response handler version module package class method error message update delete create table column key map node tree image header static build
debug release main common local remote first next account action address agent allow argument array assert async await backup base batch block buffer button
cache call certificate channel check child close code collection command compare complete connection content context control convert copy current decode default depth derive device
directory display document domain edge element email enable encode engine entry event exception execute export extension external factory failed feature field filter finish flag
format frame function generate global graph group hash height history host import include inherit input insert install instance interface internal invoice iterator job join
label language layer length level library limit link lock login loop manager match maximum member memory merge metric minimum mobile model monitor network notification
number object offset option order output owner parameter parent parser password pattern payment permission pipeline plugin point policy position prefix process product
""".split()


def labelled_sample(spark: SparkSession, n: int = SAMPLE, salt: str = "sample") -> DataFrame:
    """n random strings (label 1) and n ordinary identifiers (label 0), made from SHA-256 of counters: token, label."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda k: F.conv(F.substring(h, 3 * k + 1, 3), 16, 10).cast("int")
    word = lambda k: F.element_at(F.split(F.lit(" ".join(WORDS)), " "), pick(k) % len(WORDS) + 1)
    number = F.when(pick(6) % 2 == 0, (pick(7) % 100).cast("string")).otherwise((2000 + pick(7) % 30).cast("string"))
    base = F.regexp_replace(F.base64(F.unhex(h)), "[+/]", "x")
    random = F.when(pick(0) % 3 == 0, F.substring(h, 1, 40)).when(pick(0) % 3 == 1, F.substring(F.base64(F.unhex(h)), 1, 32)).otherwise(F.substring(base, 3, 24))
    camel = F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), number)
    snake = F.concat_ws("_", word(1), word(2), word(3), number)
    path = F.concat_ws("/", word(1), F.concat_ws("-", word(2), word(3)), F.concat(word(4), number))
    styles = [snake, camel, path, F.upper(snake), F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.lit("_"), number), F.concat(F.lit("_"), word(1), word(2), F.lit("_"), word(3), number)]
    ordinary = F.element_at(F.array(*styles), pick(0) % len(styles) + 1)
    ids = spark.range(n)
    return ids.select(random.alias("token"), F.lit(1).alias("label")).unionByName(ids.select(ordinary.alias("token"), F.lit(0).alias("label")))


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - LOW)


def _pairs(codes: Column) -> Column:
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * WIDE + b)


class RandomnessModel:
    """ratio[a * WIDE + b]: log of P(b | a) under random strings over P(b | a) under ordinary identifiers."""

    def __init__(self, ratio: list[float], threshold: float) -> None:
        self.ratio, self.threshold = ratio, threshold

    def table(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratio)), ",").cast("array<double>")

    def mean_ratio(self, token: Column, table: Column) -> Column:
        pairs = _pairs(_codes(token))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.element_at(table, p + 1)) / F.greatest(F.size(pairs), F.lit(1))


def train(sample: DataFrame) -> RandomnessModel:
    """sample: token, label (1 random, 0 ordinary). What reaches the driver is bounded by the alphabet's pairs."""
    clean = sample.where(F.col("token").rlike("^[A-Za-z0-9+/_=-]{2,}$") & F.col("label").isNotNull())
    rows = clean.select("label", F.explode(_pairs(_codes(F.col("token")))).alias("pair")).groupBy("label", "pair").count().collect()
    counts = {(r["label"], r["pair"]): r["count"] for r in rows}
    ratio = []
    for a in range(WIDE):
        totals = [sum(counts.get((label, a * WIDE + b), 0) for b in range(WIDE)) for label in (0, 1)]
        for b in range(WIDE):
            p = [(counts.get((label, a * WIDE + b), 0) + 0.5) / (totals[label] + 0.5 * WIDE) for label in (0, 1)]
            ratio.append(math.log(p[1] / p[0]))
    model = RandomnessModel(ratio, FLOOR)
    tried = clean.where("label = 0").select("token", model.table().alias("table"))
    top = tried.select(model.mean_ratio(F.col("token"), F.col("table")).alias("x")).agg(F.percentile("x", QUANTILE).alias("q")).first().q
    model.threshold = max(FLOOR, top if top is not None else FLOOR)
    return model


def _spans(kind: str, text: str) -> Column:
    """Array of (start, rank, end, token) of a kind's matches in order, from m_<kind> (matches) and g_<kind> (gaps)."""
    rank = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,token:string>>)")
    lists = F.expr("cast(array() as array<array<struct<start:int,rank:int,end:int,token:string>>>)")
    matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")

    def step(acc: Column, i: Column) -> Column:
        token = F.get(matches, i)
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(token)
        good = F.length(F.regexp_extract(token, ASSIGN, 2)) >= 12 if kind == "assign" else F.lit(True)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), token.alias("token"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def chunk(acc: Column, c: Column) -> Column:
        places = F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, F.size(matches)) - 1)
        start = F.struct(acc["at"].alias("at"), empty.alias("found"))
        return F.aggregate(places, start, step, lambda own: F.struct(own["at"].alias("at"), F.array_append(acc["found"], own["found"]).alias("found")))

    begin = F.struct(F.lit(0).alias("at"), lists.alias("found"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int"))
    return F.when(F.size(matches) > 0, F.aggregate(chunks, begin, chunk, lambda acc: F.flatten(acc["found"]))).otherwise(empty)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["rank"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: RandomnessModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of start, rank, end, token) for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("doc_id", *[f"m_{k}" for k in KINDS], *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("doc_id", *[_spans(k, "text").alias(k) for k in KINDS])
    rows = rows.select("doc_id", F.concat("assign", "access", "hex").alias("base"), "model", model.table().alias("table"))
    plain = lambda s: s["token"].rlike("[0-9]") & ~s["token"].rlike(f"{PATTERNS['access']}|{PATTERNS['hex']}")
    odd = lambda s: model.mean_ratio(s["token"], F.col("table")) > model.threshold
    rows = rows.select("doc_id", "base", F.filter("model", lambda s: plain(s) & odd(s)).alias("model"))
    touching = lambda s: F.exists(F.filter("base", lambda b: b["rank"] == 0), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.select("doc_id", "base", F.filter("model", lambda s: ~touching(s)).alias("added"))


def op9_secret_scan(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_sample(spark)))
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
