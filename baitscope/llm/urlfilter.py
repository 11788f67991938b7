"""Operator 6: URL filter by rules, then by a character language-model ratio.

Rules come first; the longest that fits wins.  A URL without a rule is judged by
two Markov models of its characters, one learned from accepted and one from
rejected URLs (those that a rule decides).  Each model mixes all orders from 0 to
``ORDER`` by Witten-Bell smoothing.  The score is the difference of the models'
log-likelihoods for each character; its threshold is calibrated on a fifth of the
rule-decided URLs, which the models are not learned from.  All of it is built from
DataFrame functions; counts are over all distinct URLs.

Edge cases: a null URL counts as empty, so host and path are empty; with no
accepted or no rejected URL to learn from, the method allows all; a score equal to
the threshold is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitscope.llm.common import stored

#: Characters of context; copies of the score table against hot n-grams.
ORDER, SALTS = 4, 16
START, END = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*+", 0)
    return F.translate(raw, UPPER, LOWER), path


def by_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as written, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """k1, k2, kind, gram: the ``order + 1`` characters that end at each character of each URL and at its end."""
    chars = F.split(F.concat(F.lit(START * order), F.col("url"), F.lit(END)), "")
    rows = urls.select(F.xxhash64("url").alias("k1"), F.xxhash64(F.lit("2"), "url").alias("k2"), "kind",
                       F.filter(chars, lambda x: x != "").alias("chars"))
    parts = F.transform(F.sequence(F.lit(0), F.size("chars") - order - 1),
                        lambda i: F.concat(*[F.get("chars", i + k) for k in range(order + 1)]))
    return rows.select("k1", "k2", "kind", F.explode(parts).alias("gram"))


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """gram, delta: log-probability of its last character after the others, accepted less rejected."""
    c = F.col
    counts = grams.groupBy("gram").agg(F.sum(F.when(c("kind") == 1, 1).otherwise(0)).alias("a"),
                                       F.sum(F.when(c("kind") == -1, 1).otherwise(0)).alias("r"))
    full = stored(counts, "url-grams")
    seen = full.where((c("a") > 0) | (c("r") > 0))
    # Counts of every order, from the counts of the longest.
    sizes = F.array(*[F.lit(n) for n in range(1, order + 2)])
    shorter = seen.select(F.explode(F.transform(sizes, lambda n: F.substring(c("gram"), F.lit(order + 2) - n, n))).alias("s"), "a", "r")
    tails = stored(shorter.groupBy("s").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url-tails")
    context = F.substring(c("s"), F.lit(1), F.length("s") - 1)
    contexts = tails.groupBy(context.alias("s")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"),
        F.sum((c("a") > 0).cast("long")).alias("ta"), F.sum((c("r") > 0).cast("long")).alias("tr"))
    # One row: the counts without context, and the number of characters met.
    total = contexts.where(c("s") == "").first()
    alphabet = 1 + tails.where(F.length("s") == 1).count()
    top = {k: int(total[k]) if total else 0 for k in ("na", "nr", "ta", "tr")}
    stats = (tails.select(F.concat(F.lit("g"), "s").alias("key"), c("a").alias("x"), c("r").alias("y"), F.lit(0).alias("u"), F.lit(0).alias("v"))
             .unionByName(contexts.where(c("s") != "").select(
                 F.concat(F.lit("c"), "s").alias("key"), c("na").alias("x"), c("nr").alias("y"), c("ta").alias("u"), c("tr").alias("v"))))
    keys = [(n, F.concat(F.lit("g"), F.substring(c("gram"), F.lit(order + 2 - n), F.lit(n)))) for n in range(1, order + 2)]
    keys += [(-n, F.concat(F.lit("c"), F.substring(c("gram"), F.lit(order + 1 - n), F.lit(n)))) for n in range(1, order + 1)]
    wanted = full.select("gram", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), k.alias("key")) for n, k in keys])).alias("w"))
    # Tables of n-grams have no size bound, whatever their files suggest, so none is broadcast.
    met = wanted.select("gram", "w.n", "w.key").join(stats.hint("merge"), "key")
    pick = lambda n, col: F.coalesce(F.max(F.when(c("n") == n, c(col))), F.lit(0))
    wide = met.groupBy("gram").agg(
        *[pick(n, col).alias(f"{col}{n}") for n in range(1, order + 2) for col in ("x", "y")],
        *[pick(-n, col).alias(f"{col}_{n}") for n in range(1, order + 1) for col in ("x", "y", "u", "v")])
    wide = full.select("gram").join(wide, "gram", "left").fillna(0)

    def smoothed(count: str, many: str, kinds: str, n0: int, t0: int, name: str, frame: DataFrame) -> DataFrame:
        p = (c(f"{count}1") + t0 / alphabet) / max(1, n0 + t0) if n0 else F.lit(1.0 / alphabet)
        frame = frame.withColumn(name, p)
        for n in range(1, order + 1):
            mixed = (c(f"{count}{n + 1}") + c(f"{kinds}_{n}") * c(name)) / (c(f"{many}_{n}") + c(f"{kinds}_{n}"))
            frame = frame.withColumn(name, F.when(c(f"{many}_{n}") > 0, mixed).otherwise(c(name)))
        return frame

    wide = smoothed("x", "x", "u", top["na"], top["ta"], "pa", wide)
    wide = smoothed("y", "y", "v", top["nr"], top["tr"], "pr", wide)
    return wide.select("gram", (F.ln("pa") - F.ln("pr")).alias("delta"))


def url_scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """k1, k2, kind, fold, ratio of distinct URLs (url, verdict or null): the log-likelihood difference by character."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(5)) == 0
    learned = F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", -1).otherwise(0)
    # 2 and -2: only for calibration.
    kind = F.when(fold, learned * 2).otherwise(learned)
    grams = stored(_grams(urls.select("url", kind.alias("kind")), order), "url-positions")
    deltas = gram_scores(grams, order)
    salted = deltas.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = grams.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["gram", "salt"])
    return rows.groupBy("k1", "k2", "kind").agg((F.sum("delta") / F.count("*")).alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """Where both classes' calibration scores lie equally many standard deviations away; 0 without one of them."""
    found = {r["kind"]: r for r in scores.where(F.abs("kind") == 2).groupBy("kind").agg(
        F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sd")).collect()}
    if 2 not in found or -2 not in found:
        return 0.0
    a, r = found[2], found[-2]
    spread = a["sd"] + r["sd"]
    return (a["mean"] * r["sd"] + r["mean"] * a["sd"]) / spread if spread else (a["mean"] + r["mean"]) / 2


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where a rule decides) of every row of ``pages`` (page_id, url)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decided": verdict})
    urls = rows.groupBy("url").agg(F.max("decided").alias("verdict"))
    # Each URL becomes a row for each character; dealt by count, as its bytes say nothing about that.
    urls = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("url"))
    scores = stored(url_scores(urls, order), "url-scores")
    classes = {r["sign"] for r in scores.where("kind != 0").select(F.signum("kind").alias("sign")).distinct().collect()}
    least = threshold(scores) if len(classes) == 2 else None
    rows = rows.withColumns({"k1": F.xxhash64("url"), "k2": F.xxhash64(F.lit("2"), "url")})
    judged = rows.where("decided IS NULL").join(scores.where("kind = 0").select("k1", "k2", "ratio").hint("merge"), ["k1", "k2"], "left")
    found = F.lit("allow") if least is None else F.when(F.col("ratio") >= least, "allow").otherwise("block")
    judged = judged.select("page_id", "host", "path", "rule", found.alias("verdict"), "ratio")
    ruled = rows.where("decided IS NOT NULL").select("page_id", "host", "path", "rule", F.col("decided").alias("verdict"),
                                                     F.lit(None).cast("double").alias("ratio"))
    return ruled.unionByName(judged)
