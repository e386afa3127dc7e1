"""Operator 6: URL filter by rules and gradient-boosted trees, in DataFrame functions.

Trees are trained on labelled URLs.  Lexical features become at most ``BINS``
bins; rows of equal bins are summed first, so training works on counted vectors
(fitted on at most ``MAX_VECTORS`` of them, the commonest).  Statistics of the
``MAX_SUFFIXES`` commonest suffixes of the training rows are learned; others count
as the average.  Each level of a tree is one
aggregation of gradients by (node, feature, bin); only those sums, bounded by the
tree's size, come to the driver.  The finished trees are nested CASE expressions,
so scoring is a narrow projection in generated code, without a shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by the trees on what text it has.  A host that is
empty fits no rule.  With no labelled rows every URL is allowed.  Repeated rows
give repeated results; an empty table gives none; other columns are not carried.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from masthead.llm.shared import materialize

BINS = 16
MAX_VECTORS = 20_000
#: Suffixes with a statistic of their own; this bounds the model.
MAX_SUFFIXES = 2_000
TREES, DEPTH, RATE, RIDGE = 12, 3, 0.3, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Words and endings that the labelled URLs are drawn from (fixed values).
BLOCK_WORDS = ["cheap", "pills", "free", "casino", "bets", "win", "money", "deals", "replica", "loan", "click", "bonus", "track", "ads", "farm", "promo", "viagra", "crypto", "prize", "xxx", "spam", "hot", "slots", "offer"]
ALLOW_WORDS = ["news", "library", "archive", "museum", "weather", "research", "city", "school", "wiki", "forum", "open", "data", "health", "garden", "river", "history", "science", "music", "north", "county", "press", "review", "maps", "green"]
BLOCK_ENDINGS = {"com": 30, "net": 20, "org": 8, "xyz": 12, "top": 10, "click": 8, "info": 8, "biz": 4}
ALLOW_ENDINGS = {"com": 30, "org": 30, "net": 14, "edu": 8, "gov": 5, "de": 5, "fr": 4, "info": 2, "uk": 2}
SYLLABLES = ["ba", "con", "der", "es", "in", "ki", "lo", "men", "na", "or", "per", "ra", "sen", "ti", "ul", "ver"]


def labelled_urls(n: int, seed: int) -> list[tuple[str, int]]:
    """(url, label) with label 1 for block, drawn at random from overlapping habits.

    Hosts of both kinds have hyphens, either scheme, subdomains, invented names and
    parameters, only more or fewer of them; no part alone gives the label away.
    """
    rng = random.Random(seed)
    some = lambda table: rng.choices(list(table), list(table.values()))[0]
    out = []
    for i in range(n):
        block = i % 2
        name = [rng.choice(BLOCK_WORDS if rng.random() < (0.85 if block else 0.04) else ALLOW_WORDS) for _ in range(rng.choice((1, 2, 2, 3) if block else (1, 1, 2, 2)))]
        if rng.random() < (0.1 if block else 0.5):
            name = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 5)))] + name[: rng.randrange(2)]
        if rng.random() < (0.35 if block else 0.05):
            name.append(str(rng.randrange(1, 1000)))
        host = ("-" if rng.random() < (0.75 if block else 0.25) else "").join(name)
        if rng.random() < 0.5:
            host = rng.choice(("www", "m", "blog", "shop", "go")) + "." + host
        if rng.random() < 0.4:
            host += ".example"
        path = ""
        for _ in range(rng.choice((0, 1, 1, 2, 4) if block else (0, 1, 2, 2, 3))):
            path += "/" + (f"{rng.getrandbits(48):x}" if rng.random() < (0.3 if block else 0.04) else rng.choice((rng.choice(ALLOW_WORDS), rng.choice(("en", "de", "fr", "es")), str(rng.randrange(1000)))))
        path += rng.choice(("", "/", ".html"))
        if rng.random() < (0.5 if block else 0.25):
            keys = rng.sample(("id", "ref", "aff", "utm_source", "utm_campaign", "page", "q", "sid", "clickid"), rng.choice((1, 2, 3, 4) if block else (1, 1, 2)))
            path += "?" + "&".join(f"{k}={rng.choice((str(rng.randrange(10**6)), rng.choice(ALLOW_WORDS), 'x'))}" for k in keys)
        path += rng.choice(("", "", "", "#top"))
        out.append((f"{'https' if rng.random() < (0.5 if block else 0.7) else 'http'}://{host}.{some(BLOCK_ENDINGS if block else ALLOW_ENDINGS)}{path}", block))
    return out


def seed_urls(spark: SparkSession, n: int = 4_000, seed: int = 20) -> DataFrame:
    """The labelled URLs that come with the operator, as (url, label)."""
    return spark.createDataFrame(labelled_urls(n, seed), "url string, label int")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def _count(text: Column, of: str) -> Column:
    return F.length(text) - F.length(F.translate(text, of, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in tenths of a bit."""
    chars, n = F.array_distinct(F.split(text, "")), F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(chars, F.lit(0.0), lambda total, c: total + F.when((c == "") | (share(c) <= 0), 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n == 0, 0).otherwise(F.floor(bits * 10 + 0.5)).cast("int")


def features(url: Column, suffix_rate: dict[str, int], prior: int) -> dict[str, Column]:
    """Whole-numbered lexical features."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    suffix = F.substring_index(host, ".", -1)
    rate = F.lit(prior)
    if suffix_rate:
        table = F.create_map(*[F.lit(x) for kv in suffix_rate.items() for x in kv])
        rate = F.coalesce(F.element_at(table, suffix), rate)
    return {
        "length": F.length(text),
        "depth": _count(path, "/"),
        "digits": F.when(F.length(text) == 0, 0).otherwise(F.floor(100 * _count(text, "0123456789") / F.length(text))).cast("int"),
        "entropy": _entropy(text),
        "parameters": _count(F.regexp_extract(text, r"(?s)\?([^#]*)", 1), "="),
        "labels": _count(host, "."),
        "hyphens": _count(host, "-"),
        "host_length": F.length(host),
        "suffix_rate": rate,
    }


@dataclass
class UrlModel:
    suffix_rate: dict[str, int]
    prior: int
    bias: float
    trees: list[dict]  # node -> (feature, threshold) or a leaf's value

    def score(self, url: Column) -> Column:
        """The probability of "block"."""
        if not self.trees:
            return F.lit(1 / (1 + math.exp(-self.bias)))
        values = features(url, self.suffix_rate, self.prior)
        names = list(values)
        row = F.struct(*[values[n].alias(n) for n in names])

        def tree(at: dict, node: int, x: Column) -> Column:
            if isinstance(at[node], float):
                return F.lit(at[node])
            name, threshold = at[node]
            return F.when(x[name] <= threshold, tree(at, 2 * node, x)).otherwise(tree(at, 2 * node + 1, x))

        def margin(x: Column) -> Column:
            total = F.lit(self.bias)
            for t in self.trees:
                total = total + tree(t, 1, x)
            return 1 / (1 + F.exp(-total))

        return F.element_at(F.transform(F.array(row), margin), 1)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train_urls(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Boosted trees for (url, label); rows with a null label are left out."""
    rows = labelled.filter("label is not null").select("url", F.col("label").cast("double").alias("label"))
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return UrlModel({}, 500, -20.0, [])
    prior = round(1000 * positive / n)
    suffixes = rows.groupBy(F.substring_index(host_of(F.col("url")), ".", -1).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("p")).orderBy(F.desc("n"), "s").limit(MAX_SUFFIXES).collect()
    rates = {r["s"]: round(1000 * (r["p"] + 1) / (r["n"] + 2)) for r in suffixes}
    values = features(F.col("url"), rates, prior)
    names = list(values)
    raw = rows.select("label", *[v.alias(k) for k, v in values.items()])
    marks = [i / BINS for i in range(1, BINS)]
    cuts = raw.agg(*[F.percentile_approx(k, marks, 10_000).alias(k) for k in names]).first()
    bounds = {k: sorted(set(cuts[k])) for k in names}

    def bin_of(k: str) -> Column:
        place = F.lit(len(bounds[k]))
        for i in reversed(range(len(bounds[k]))):
            place = F.when(F.col(k) <= bounds[k][i], i).otherwise(place)
        return place

    counted = raw.groupBy(*[bin_of(k).alias(k) for k in names]).agg(F.sum("label").alias("p"), F.count("*").cast("double").alias("n"))
    vectors = materialize(counted.orderBy(F.desc("n"), *names).limit(MAX_VECTORS), "url-vectors").coalesce(1)
    share = min(max(positive / n, 1e-3), 1 - 1e-3)
    bias = math.log(share / (1 - share))
    done: list[dict] = []

    def value(at: dict, node: int) -> Column:
        if isinstance(at[node], float):
            return F.lit(at[node])
        k, b = at[node]
        return F.when(F.col(k) <= b, value(at, 2 * node)).otherwise(value(at, 2 * node + 1))

    def place(at: dict, node: int, level: int) -> Column:
        """The node of this level that a row is in, 0 if it is in a leaf above."""
        if node >= 1 << level:
            return F.lit(node)
        if isinstance(at[node], float):
            return F.lit(0)
        k, b = at[node]
        return F.when(F.col(k) <= b, place(at, 2 * node, level)).otherwise(place(at, 2 * node + 1, level))

    # the margin so far is a column, so a level's expression has few trees, however many there are
    now = vectors.withColumn("margin", F.lit(bias))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in names])).alias("x")
    fresh: list[dict] = []  # trees that the column lacks yet
    for _ in range(trees):
        margin = F.col("margin")
        for t in fresh:
            margin = margin + value(t, 1)
        chance = _sigmoid(margin)
        grown: dict = {1: 0.0}
        for level in range(depth):
            sums = (
                now.select(place(grown, 1, level).alias("node"), (F.col("p") - F.col("n") * chance).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h"), pairs)
                .filter("node > 0").groupBy("node", "x.k", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )
            by: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
            for r in sums:
                by.setdefault(r["node"], {}).setdefault(r["k"], {})[r["b"]] = (r["g"], r["h"])
            split = False
            for node, of in by.items():
                some = next(iter(of.values()))
                g, h = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
                leaf = lambda g, h: float(RATE * g / (h + RIDGE))
                grown[node], most = leaf(g, h), 1e-6
                for k in names:
                    left_g = left_h = 0.0
                    for b in sorted(of[k])[:-1]:
                        left_g, left_h = left_g + of[k][b][0], left_h + of[k][b][1]
                        gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
                        if gain > most + 1e-9:
                            most, split = gain, True
                            grown[node], grown[2 * node], grown[2 * node + 1] = (k, b), leaf(left_g, left_h), leaf(g - left_g, h - left_h)
            if not split:
                break
        done.append(grown)
        fresh.append(grown)
        if len(fresh) == 4:
            for t in fresh:
                now = now.withColumn("margin", F.col("margin") + value(t, 1))
            now, fresh = materialize(now, "url-margins").coalesce(1), []
    raw_trees = [{node: v if isinstance(v, float) else (v[0], int(bounds[v[0]][v[1]])) for node, v in t.items()} for t in done]
    return UrlModel(rates, prior, bias, raw_trees)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a string, else null; rules: (host/path, verdict)."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of each row.

    rules: a short list (hundreds); it becomes part of the projection.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), model.score(url).alias("score"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
