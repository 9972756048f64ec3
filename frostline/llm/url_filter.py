"""URL filters: rules by host and path, and boosted trees for what they leave open.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
then up to `?`, `#` or the end. A rule names a host and the beginning of a path, as
`example.net/en/`; it fits its host and all subdomains, and of the rules that fit
the longest wins. Rules lie in one literal map by host, and a url looks up its own
host and what is left of it after each dot, so its cost does not grow with the
list.

Urls that no rule fits are judged by gradient-boosted trees on lexical features:
lengths of url, host and path, depth, labels, digits, hyphens, entropy of the
characters, parameters, escapes, scheme, and statistics of suffixes: the smoothed
share of blocked training urls with the same last label, last two labels, first
folder, and last label and first folder together. Statistics come from one half of
the training urls and the trees grow on the other half, so no url shows the trees
its own verdict. The labelled urls are those that a rule or a list has judged.

Training takes at most `TRAIN_URLS` distinct labelled urls by a hash of the url;
repeated urls count once, so a hot host or url does not fill the sample. Trees and
statistics are bounded by that sample. Every url is scored, by Spark functions and
the trees alone.

Edge cases: a null url or one without `://` has an empty host and path, fits no
rule, and is scored on what it has; a path is empty if nothing follows the host,
and then no rule fits it, as rules' paths begin with `/`; rules of equal length and
text but different verdicts block; repeated urls get equal verdicts; with labelled
urls of one verdict only, open urls get that verdict (`allow` without any labelled
url), and with too few for both halves the more frequent one; an empty table gives
no rows. `judge` carries all columns of pages; host, path, rule, score and verdict
replace columns of these names. Urls of any length are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm import common

TRAIN_URLS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 7
PRIOR = 4.0
ALLOW, BLOCK = "allow", "block"

_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that begin so."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: fixed values: the rules of the query
RULES = (
    Rule(BLOCK, "net", "/"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
)

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), *_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _suffixes(host: Column) -> Column:
    """The host, and what is left of it after each dot."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    by_host: dict[str, dict[str, str]] = {}
    for rule in rules:
        own = by_host.setdefault(rule.host, {})
        if own.get(rule.path) != BLOCK:
            own[rule.path] = rule.verdict
    if not by_host:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    entries = [
        (
            F.lit(name),
            F.array(*(F.struct(F.lit(name + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for p, v in own.items())),
        )
        for name, own in by_host.items()
    ]
    known = F.create_map(*(x for entry in entries for x in entry))
    near = F.flatten(F.transform(_suffixes(host), lambda s: F.coalesce(F.try_element_at(known, s), F.array())))
    fits = F.filter(near, lambda x: F.startswith(path, x["path"]))
    sized = F.transform(fits, lambda x: F.struct(F.length(x["rule"]).alias("size"), x["rule"].alias("rule"), x["verdict"].alias("verdict")))
    best = F.array_max(sized)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def judged_by_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """pages with host, path and rule (a struct, or null)."""
    parts = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))


# -- features ---------------------------------------------------------------------------
LEXICAL = (
    "url_length", "host_length", "path_length", "labels", "depth", "digits", "hyphens",
    "entropy", "parameters", "escapes", "secure", "fragment",
)
SUFFIXES = ("top", "registered", "folder", "place")


def _share_of(text: Column, kept: str) -> Column:
    size = F.length(text)
    return F.when(size > 0, (size - F.length(F.regexp_replace(text, kept, ""))) / size).otherwise(F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    distinct = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    shares = F.transform(distinct, lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    bits = F.aggregate(shares, F.lit(0.0), lambda total, x: total - x * F.log2(x))
    return F.when(size > 0, bits).otherwise(F.lit(0.0))


def described(rows: DataFrame) -> DataFrame:
    """rows (url, host, path) with a column per lexical feature and per suffix."""
    url, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    top = F.coalesce(F.get(labels, F.size(labels) - 1), F.lit(""))
    return rows.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "labels": F.size(labels).cast("double"),
            "depth": F.size(folders).cast("double"),
            "digits": _share_of(url, "[0-9]+"),
            "hyphens": _share_of(url, "[-_]+"),
            "entropy": _entropy(url),
            "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda x: x != "")).cast("double"),
            "escapes": _share_of(url, "%"),
            "secure": F.startswith(F.lower(url), F.lit("https:")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "top": top,
            "registered": F.concat_ws(".", F.get(labels, F.size(labels) - 2), top),
            "folder": F.coalesce(F.get(folders, F.lit(0)), F.lit("")),
        }
    ).withColumn("place", F.concat_ws("/", "top", "folder"))


@dataclass(frozen=True)
class Model:
    """Trees, and (blocked, all) training urls of each suffix. Without trees the
    default verdict holds."""

    trees: GBTClassificationModel | None
    suffixes: dict[str, dict[str, tuple[int, int]]]
    prior: float
    default: str = ALLOW


def _vectors(rows: DataFrame, model: Model) -> DataFrame:
    """rows with `x`. A suffix that training has not seen has the prior."""
    values = [F.col(x) for x in LEXICAL]
    for name in SUFFIXES:
        entries = [x for k, (b, n) in sorted(model.suffixes[name].items()) for x in (F.lit(k), F.lit((b + PRIOR * model.prior) / (n + PRIOR)))]
        rate = F.try_element_at(F.create_map(*entries), F.col(name)) if entries else F.lit(None)
        values.append(F.coalesce(rate, F.lit(model.prior)))
    return rows.withColumn("x", array_to_vector(F.array(*(v.cast("double") for v in values))))


def learn(labelled: DataFrame, train_urls: int = TRAIN_URLS) -> Model:
    """labelled: url, verdict. At most train_urls distinct urls, by hash."""
    urls = labelled.filter(F.col("url").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)).select("url", "verdict")
    count = urls.agg(F.approx_count_distinct("url").alias("n")).first()["n"]
    order = F.xxhash64("url")
    if count > train_urls:
        urls = urls.filter(F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * train_urls / count))
    # a url that two lists judge differently is blocked
    urls = urls.groupBy("url").agg(F.max("verdict").alias("verdict")).orderBy(order, "url").limit(train_urls)
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    blocked = (F.col("verdict") == BLOCK).cast("double")
    half = F.pmod(F.xxhash64("url", F.lit("half")), F.lit(2))
    rows = common.written(described(urls).withColumns({"blocked": blocked, "half": half}).repartition(4), "labelled-urls")
    # bounded by train_urls
    known = rows.select("blocked", "half", *SUFFIXES).collect()
    seen = Counter(r["blocked"] for r in known)
    if len(seen) < 2:
        return Model(None, {x: {} for x in SUFFIXES}, 0.0, BLOCK if seen.get(1.0) else ALLOW)
    suffixes: dict[str, dict[str, tuple[int, int]]] = {x: {} for x in SUFFIXES}
    for row in known:
        for name in SUFFIXES if row["half"] == 0 else ():
            b, n = suffixes[name].get(row[name], (0, 0))
            suffixes[name][row[name]] = (b + int(row["blocked"]), n + 1)
    model = Model(None, suffixes, seen[1.0] / len(known))
    if len({r["blocked"] for r in known if r["half"] == 1}) < 2:
        return Model(None, suffixes, model.prior, BLOCK if seen[1.0] > seen[0.0] else ALLOW)
    train = _vectors(rows.filter("half = 1"), model).select("x", "blocked")
    trainer = GBTClassifier(
        featuresCol="x", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=SEED
    )
    return Model(trainer.fit(train), suffixes, model.prior)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (url, host, path) with `score`, the probability of being blocked."""
    columns = [c for c in rows.columns if c != "score"]
    if model.trees is None:
        return rows.select(*columns, F.lit(1.0 if model.default == BLOCK else 0.0).alias("score"))
    kept = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("kept"), "url", "host", "path")
    trees = model.trees.setFeaturesCol("x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p")
    found = trees.transform(_vectors(described(kept), model).select("kept", "x"))
    return found.select("kept.*", vector_to_array("p")[1].alias("score"))


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model) -> DataFrame:
    """pages with host, path, rule (its text or null), score and verdict."""
    rows = scored(judged_by_rules(pages, rules), model)
    learned = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(F.col("rule.verdict"), learned)
    return rows.withColumn("verdict", verdict).withColumn("rule", F.col("rule.rule"))
