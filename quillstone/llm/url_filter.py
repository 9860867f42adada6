"""URL filters: an allow/block rule list, then logistic regression on hashed character n-grams.

Everything is DataFrame functions. The labelled table is small by contract, so the regression is
fitted in its dual form: one coefficient for each labelled URL, moved by gradient steps over the
labelled URLs' gram matrix inside a single higher-order aggregate. The primal weights follow from
one aggregation by bucket; at most `buckets` numbers reach the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host/path). A rule fits its host and all subdomains where the path starts with its path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

_GOOD = """https://www.city-library.org/catalog/search https://news.daily-herald.com/world/2021/05/report.html
https://blog.garden-notes.net/en/tomatoes https://docs.open-tools.org/manual/install https://m.weather.org/de/berlin
https://www.university.edu/courses/physics/101 https://wiki.history.org/fr/article/12 https://en.recipes.net/soup/lentil
https://www.museum.org/exhibits/egypt https://school.district.org/calendar https://blog.traveler.example.org/es/madrid
https://forum.astronomy.net/thread/445 https://www.theatre.org/en/program https://m.thether.example.org/en/471
https://blog.thorin.example.net/de/612 https://tionth.example.org/fr/414 https://thand.example.net/en/770
https://www.research-lab.edu/papers/2019 https://health.gov/topics/sleep https://www.parliament.gov/debates/77
https://data.science.org/sets/rivers.html https://m.thoring.example.net/en/25 https://www.therou.example.org/en/148.html
https://blog.tionand.example.org/de/853/ https://thent.example.org/en/334/ https://www.public-radio.org/shows/morning""".split()
_BAD = """http://www.cheap-pills.example.com/en/450?page=2 https://spam-farm.example.org/en/728 http://cheap-pills.shop/buy/now
https://spam-farm.example.net/de/3 http://casino-bonus.win/free/spins https://www.free-money.biz/click/here
http://win-prize-now.xyz/claim/123 https://hot-singles.example.net/chat http://viagra-online.shop/order/cheap
https://cheap-watches.store/replica/sale http://www.payday-loans.biz/apply/now https://adult-cams.xyz/live
http://spam-links.info/farm/12 https://bet-casino.example.org/poker/win http://pills-discount.com/cheap/pills
https://free-download-crack.xyz/keygen http://seo-backlinks.biz/buy/links https://cheap-meds.example.com/fr/2
http://click-bait-farm.info/top10 https://spam.cheap-followers.net/buy http://lottery-winner.win/claim
https://porn-tube.xxx/video/1 http://replica-bags.shop/cheap https://crypto-doubler.biz/invest/now""".split()


def labelled(spark: SparkSession) -> DataFrame:
    """The shipped table (url, label): label 1 asks for a block."""
    rows = ", ".join(f"('{u}', {y})" for y, urls in ((0, _GOOD), (1, _BAD)) for u in urls)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and for a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(host: Column, path: Column, buckets: int) -> Column:
    """Bucket numbers of the character 3- and 4-grams of host and path, each marked by its part."""

    def of(mark: str, text: Column, n: int) -> Column:
        size = F.length(text) - (n - 1)
        cut = lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, n)), F.lit(buckets)).cast("int")
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), cut)).otherwise(F.array().cast("array<int>"))

    h, p = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    return F.concat(*(of(m, t, n) for m, t in (("h", h), ("p", p)) for n in (3, 4)))


def train(labels: DataFrame, buckets: int = 2048, steps: int = 300, rate: float = 2.0, decay: float = 0.002) -> tuple[float, list[float]]:
    """(bias, weights) of the regression fitted to `labels` (url, label), a small table.

    Null urls and labels are left out; repeated rows count as often as they stand there. With no
    rows left all weights are 0.
    """
    host, path = host_and_path(F.col("url"))
    rows = labels.where("url IS NOT NULL AND label IS NOT NULL").select(F.col("label").cast("double").alias("y"), _grams(host, path, buckets).alias("g"))
    rows = rows.withColumn("i", F.monotonically_increasing_id())
    x = rows.select("i", F.explode("g").alias("b"), F.size("g").alias("n")).groupBy("i", "b").agg((F.count("*") / F.sqrt(F.first("n"))).alias("x"))
    gram = (
        x.join(x.select(F.col("i").alias("j"), "b", F.col("x").alias("z")), "b")
        .groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
        .groupBy("i").agg(F.collect_list(F.struct("j", "k")).alias("k"))
    )
    one = rows.select("i", "y").join(gram, "i").agg(F.array_sort(F.collect_list(F.struct("i", "y", "k"))).alias("r"))
    ids = F.transform("r", lambda r: r.i)
    one = one.select(
        F.transform("r", lambda r: r.y).alias("y"), ids.alias("ids"),
        F.transform("r", lambda r: F.transform(ids, lambda j: F.coalesce(F.element_at(F.map_from_entries(r.k), j), F.lit(0.0)) + 1.0)).alias("k"),
    )
    n = F.size("y").cast("double")

    def step(a: Column, _: Column) -> Column:
        def moved(row: Column, i: Column) -> Column:
            z = F.aggregate(F.zip_with(row, a, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
            return F.get(a, i) * (1 - rate * decay) + rate / n * (F.get(F.col("y"), i) - 1 / (1 + F.exp(-z)))

        return F.transform(F.col("k"), moved)

    alpha = one.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("y", lambda _: F.lit(0.0)), step)).alias("p", "a"), "ids").select(F.element_at("ids", F.col("p") + 1).alias("i"), "a")
    weight = x.join(alpha, "i").groupBy("b").agg(F.sum(F.col("a") * F.col("x")).alias("w"))
    found = weight.unionByName(alpha.select(F.lit(-1).alias("b"), F.col("a").alias("w"))).groupBy("b").agg(F.sum("w").alias("w")).collect()
    out = [0.0] * buckets
    bias = 0.0
    for r in found:
        if r.b < 0:
            bias = r.w
        else:
            out[r.b] = r.w
    return bias, out


def filter_urls(pages: DataFrame, model: tuple[float, list[float]], id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row for each row of `pages`: id, host, path, rule (null where none fits), verdict, score.

    Of the rules that fit, the longest wins; without one the regression decides. Only the two named
    columns are read, so extra columns can't clash. Null and empty urls have an empty host and path,
    fit no rule and get the score of an empty url. Repeated rows are judged alike.
    """
    bias, weights = model
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    grams = _grams(F.col("host"), F.col("path"), len(weights))
    table = F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, rest = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    df = df.select("*", rule.alias("rule"), verdict.alias("verdict"), (1 / (1 + F.exp(-(total + F.lit(bias))))).alias("score"))
    return df.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled(spark)))
