"""URL verdicts: rules first, else logistic regression on hashed character n-grams of host and path.

All of it is SQL. The labelled table is small, so gradient descent runs in one row: the weights always are a
sum of the examples' features, and only the factors of that sum are updated. The result is one
array of weights, looked up by every URL's n-grams within its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most labelled URLs taken, by ascending url: the bounded sample that the classifier is fitted on.
MAX_LABELLED = 512
BUCKETS = 4096
GRAM = 3
STEPS, RATE, DECAY = 60, 1.0, 0.01
#: Weights are rounded to whole multiples of 1 / SCALE, so that sums of them are exact.
SCALE = 1_000_000

# The rules, host and path prefix and whether they allow or block.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

# Words of the labelled hosts, first those to block.
BLOCK_HOSTS = ("adult-x", "ads-track", "bet-big", "casino-win", "cheap-pills", "free-bets", "free-casino", "hot-adult", "pills-shop", "poker-win", "spam-farm", "track-ads", "win-bets", "xxx-cams")
ALLOW_HOSTS = ("books", "daily-news", "garden", "history", "library", "museum", "recipes", "science", "teaching", "orchard", "pottery", "sailing", "travel-notes", "weather")
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/12", "/fr/340/", "/de/77.html", "/es/5?page=2")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: (url, block), each host with one of the prefixes and paths."""
    rows = [
        (f"http://{PREFIXES[(i + k) % 4]}{host}.example.{('com', 'net')[k % 2]}{PATHS[(i + 2 * k) % 4]}", block)
        for block, hosts in ((1, BLOCK_HOSTS), (0, ALLOW_HOSTS))
        for i, host in enumerate(hosts)
        for k in range(4)
    ]
    return spark.createDataFrame(rows, "url string, block int")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Host after the first ``://``, its letters A to Z in lower case; empty for null or without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_parts(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, f"/{path}"


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits: host or a domain above it, and start of the path. Null without one."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, start = _rule_parts(rule)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, rule).otherwise(found)
    return found


def buckets_of(host: Column, path: Column, size: int = BUCKETS) -> Column:
    """Bucket of each character n-gram of host and path, which stand apart, with a mark at each end."""
    text = F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$"))
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.length(text)), lambda a, b: a * 131 + b)
    grams = F.zip_with(pairs, F.slice(codes, F.lit(3), F.length(text)), lambda ab, c: (ab * 131 + c) % size)
    return F.slice(grams, F.lit(1), F.length(text) - GRAM + 1)


def train(labelled: DataFrame, size: int = BUCKETS, most: int = MAX_LABELLED) -> DataFrame:
    """One row with the array of ``size`` weights, the last one the bias: (weights), in multiples of 1 / SCALE.

    ``labelled`` has url and block, 1 or 0. Rows with a null are left out; repeated rows count once. Without
    rows all weights are 0, which allows.
    """
    rows = labelled.select("url", F.col("block").cast("double").alias("y")).na.drop().distinct().orderBy("url", "y").limit(most)
    rows = rows.withColumn("x", F.array_distinct(buckets_of(host_of(F.col("url")), path_of(F.col("url")), size - 1)))
    rows = rows.withColumn("x", F.array_append("x", F.lit(size - 1).cast("bigint")))
    # One row of at most ``most`` examples; every feature of an example is worth 1 / sqrt(its features).
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "x"))).alias("e"))
    norm = lambda a: F.sqrt(F.size(a["x"]).cast("double"))
    alike = F.transform(
        "e", lambda a: F.transform("e", lambda b: F.size(F.array_intersect(a["x"], b["x"])) / (norm(a) * norm(b)))
    )
    one = one.withColumn("k", alike).withColumn("n", F.size("e").cast("double"))

    def step(factors: Column, _: Column) -> Column:
        scores = F.transform(
            "k", lambda row: F.aggregate(F.zip_with(row, factors, lambda k, f: k * f), F.lit(0.0), lambda s, v: s + v)
        )
        errors = F.zip_with("e", scores, lambda e, s: e["y"] - 1 / (1 + F.exp(-s)))
        return F.zip_with(factors, errors, lambda f, d: f * (1 - RATE * DECAY) + RATE * d)

    factors = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("e", lambda e: F.lit(0.0)), step)
    one = one.withColumn("f", factors)
    parts = one.select(F.explode(F.arrays_zip("e", "f")).alias("p")).select(
        F.explode("p.e.x").alias("bucket"), (F.col("p.f") / F.sqrt(F.size("p.e.x").cast("double"))).alias("w")
    )
    # Summed in a fixed order, so that the weights are the same on every run.
    sums = parts.groupBy("bucket").agg(F.aggregate(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda s, v: s + v).alias("w"))
    entries = sums.select(F.col("bucket"), F.round(F.col("w") * SCALE).cast("bigint").alias("w"))
    known = entries.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    return known.select(
        F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i.cast("bigint")], F.lit(0).cast("bigint"))).alias("weights")
    )


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Verdict on the url of each row: (page_id, host, path, rule, verdict, score).

    The longest fitting rule decides; without one, the classifier blocks where ``score``, the sum of the weights of the
    distinct n-grams and the bias, is positive. A null url has an empty host and path and is judged
    by the classifier. Every row of ``pages`` gives one row; other columns are ignored.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    # One row of a fixed size, computed once and put into the plan as a value.
    weighed = ruled.withColumn("weights", train(labelled).scalar())
    grams = F.array_distinct(buckets_of(F.col("host"), F.col("path"), BUCKETS - 1))
    score = F.aggregate(grams, F.get("weights", F.lit(BUCKETS - 1)), lambda s, b: s + F.get("weights", b.cast("int")))
    verdict = F.when(F.col("score") > 0, "block").otherwise("allow")
    for rule, kind in rules:
        verdict = F.when(F.col("rule") == rule, kind).otherwise(verdict)
    return weighed.withColumn("score", score).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _plain_weights() -> dict[int, int]:
    """The weights by the same descent in plain Python, for the SQL of the query and for tests."""
    import math

    def grams(url: str) -> list[int]:
        rest = url.split("://", 1)[1]
        host = rest.split("/", 1)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        codes = [ord(c) for c in f"^{host} {path}$"]
        found = [((a * 131 + b) * 131 + c) % (BUCKETS - 1) for a, b, c in zip(codes, codes[1:], codes[2:])]
        return [*dict.fromkeys(found), BUCKETS - 1]

    rows = []
    for block, hosts in ((1.0, BLOCK_HOSTS), (0.0, ALLOW_HOSTS)):
        for i, host in enumerate(hosts):
            for k in range(4):
                rows.append((f"http://{PREFIXES[(i + k) % 4]}{host}.example.{('com', 'net')[k % 2]}{PATHS[(i + 2 * k) % 4]}", block))
    rows = [(url, y, grams(url)) for url, y in sorted(set(rows))]
    sets = [set(x) for _, _, x in rows]
    norms = [math.sqrt(len(x)) for _, _, x in rows]
    alike = [[len(a & b) / (n * m) for b, m in zip(sets, norms)] for a, n in zip(sets, norms)]
    factors = [0.0] * len(rows)
    for _ in range(STEPS):
        scores = [sum(k * f for k, f in zip(row, factors)) for row in alike]
        factors = [f * (1 - RATE * DECAY) + RATE * (y - 1 / (1 + math.exp(-s))) for f, (_, y, _), s in zip(factors, rows, scores)]
    weights: dict[int, float] = {}
    for (_, _, x), f, norm in zip(rows, factors, norms):
        for bucket in x:
            weights[bucket] = weights.get(bucket, 0.0) + f / norm
    return {b: round(w * SCALE) for b, w in sorted(weights.items())}


def oracle() -> str:
    """The query as SQL, with the weights of the same training worked out in plain Python."""
    weights = _plain_weights()
    cases = []
    for rule, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, path = _rule_parts(rule)
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule}'")
    kinds = " ".join(f"WHEN '{rule}' THEN '{kind}'" for rule, kind in RULES)
    values = ", ".join(f"({b}, {w})" for b, w in weights.items() if b < BUCKETS - 1)
    return f"""
        WITH split AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id, row_number() OVER () AS k,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM split
        ), ruled AS (
            SELECT *, CASE {" ".join(cases)} END AS rule, '^' || host || ' ' || path || '$' AS body FROM parts
        ), grams AS (
            SELECT DISTINCT k, ((unicode(substr(body, i, 1)) * 131 + unicode(substr(body, i + 1, 1))) * 131
                                + unicode(substr(body, i + 2, 1))) % {BUCKETS - 1} AS bucket
            FROM (SELECT k, body, unnest(range(1, length(body) - {GRAM - 2})) AS i FROM ruled)
        ), weights(bucket, w) AS (VALUES {values}
        ), scores AS (
            SELECT k, sum(w) AS score FROM grams JOIN weights ON grams.bucket = weights.bucket GROUP BY k
        )
        SELECT page_id, host, path, rule,
               CASE rule {kinds} ELSE CASE WHEN coalesce(score, 0) + {weights[BUCKETS - 1]} > 0 THEN 'block' ELSE 'allow' END END AS verdict,
               (coalesce(score, 0) + {weights[BUCKETS - 1]})::BIGINT AS score
        FROM ruled LEFT JOIN scores ON ruled.k = scores.k
    """
