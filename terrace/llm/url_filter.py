"""URL filter: rules, and gradient-boosted trees on lexical features where no rule fits (native).

Features are DataFrame expressions over the url alone: lengths, depth, digit ratio, entropy,
counts of parameters and marks, and what the labelled urls say about the host's last label. The
trees are grown on the driver from a bounded sample of labelled feature rows and come back as one
SQL expression, so that judging a url is a projection: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.shared import ascii_lower, read, stored

#: (action, host, path)
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

LEXICAL = {
    "length": "length(u)",
    "host_length": "length(host)",
    "path_length": "length(path)",
    "depth": "length(path) - length(replace(path, '/', ''))",
    "labels": "length(host) - length(replace(host, '.', ''))",
    "hyphens": "length(host) - length(replace(host, '-', ''))",
    "digits": "length(u) - length(translate(u, '0123456789', ''))",
    "digit_ratio": "coalesce(try_divide(length(u) - length(translate(u, '0123456789', '')), length(u)), 0)",
    "parameters": "length(u) - length(replace(u, '=', ''))",
    "fragment": "if(contains(u, '#'), 1, 0)",
    "secure": "if(startswith(lower(u), 'https:'), 1, 0)",
    "host_entropy": "ENTROPY(host)",
    "path_entropy": "ENTROPY(path)",
}
_ENTROPY = (
    "if(length({c}) = 0, 0D, log2(length({c})) - aggregate(array_distinct(split({c}, '')), 0D, (sum, x) -> sum + if(x = '', 0D, "
    "(length({c}) - length(replace({c}, x, ''))) / length(x) * log2((length({c}) - length(replace({c}, x, ''))) / length(x)))) / length({c}))"
)


@dataclass
class Model:
    """rates: (block share, log of count) by the host's last label, for the labels that the sample
    knows; prior: for all others; trees: SQL expressions over the features; start: the margin before
    any tree. A margin above 0 blocks."""

    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    prior: float = 0.0
    trees: list[str] = field(default_factory=list)
    start: float = -1.0


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then
    up to `?`, `#` or the end. A null url, or one without `://`, has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, its action) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equally long
    rules the one listed first wins.
    """
    rule = action = F.lit(None).cast("string")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and `f_` columns with the lexical features; a null url counts as empty."""
    host, path = parts(F.col(url))
    known = urls.withColumns({"host": host, "path": path, "u": F.coalesce(F.col(url), F.lit(""))})
    made = {f"f_{k}": F.expr(_ENTROPY.format(c=e[8:-1]) if e.startswith("ENTROPY") else e).cast("double") for k, e in LEXICAL.items()}
    return known.withColumns(made).withColumn("suffix", F.substring_index("host", ".", -1)).drop("u")


def _with_suffix(df: DataFrame, model: Model) -> DataFrame:
    if model.rates:
        table = F.create_map(*[F.lit(x) for k, (a, b) in sorted(model.rates.items()) for x in (k, F.array(F.lit(a), F.lit(b)))])
        found = table[F.col("suffix")]
    else:
        found = F.lit(None).cast("array<double>")
    return df.withColumns({"f_suffix_rate": F.coalesce(found[0], F.lit(model.prior)), "f_suffix_count": F.coalesce(found[1], F.lit(0.0))})


def train(labelled: DataFrame, url: str = "url", label: str = "label", most: int = 10_000, suffixes: int = 256, **growth) -> Model:
    """Learns from labelled urls (label 1: block, 0: allow; others are left out).

    About `most` different urls of either class are used, chosen by a hash of the url: the bound on what
    the driver sees. A url of n rows weighs 1 + log(n), so that none is hot. Suffix statistics keep the `suffixes` commonest last labels of the sample. With one
    class only, that class is the verdict; without labels all is allowed.
    """
    known = labelled.filter(F.col(label).isin(0, 1) & F.col(url).isNotNull())
    known = stored(known.groupBy(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).agg((1 + F.log(F.count("*"))).alias("w")), "urls")
    share = {r[0]: min(1.0, most / r[1]) for r in known.groupBy("y").count().collect()}
    if len(share) < 2:
        return Model(start=1.0 if 1 in share else -1.0)
    limit = F.when(F.col("y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    rows = lexical(known.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < limit))
    rows = rows.select("y", "w", "suffix", *[c for c in rows.columns if c.startswith("f_")]).limit(4 * most).collect()
    rows.sort()
    y, w = np.array([r["y"] for r in rows], float), np.array([r["w"] for r in rows], float)
    if not len(y) or y.all() or not y.any():
        return Model(start=1.0 if len(y) and y.all() else -1.0)
    prior, seen = float(np.average(y, weights=w)), {}
    for r in rows:
        blocked, n = seen.get(r["suffix"], (0, 0))
        seen[r["suffix"]] = (blocked + r["w"] * r["y"], n + r["w"])
    common = sorted(seen, key=lambda k: (-seen[k][1], k))[:suffixes]
    rates = {k: ((seen[k][0] + 10 * prior) / (seen[k][1] + 10), math.log1p(seen[k][1])) for k in common}
    names = [c for c in rows[0].asDict() if c.startswith("f_")] + ["f_suffix_rate", "f_suffix_count"]
    x = np.array([[*r[3:], *rates.get(r["suffix"], (prior, 0.0))] for r in rows], float)
    start = math.log(prior / (1 - prior))
    return Model(rates, prior, boosted(x, y, w, names, start, **growth), start)


def boosted(x: np.ndarray, y: np.ndarray, w: np.ndarray, names: list[str], start: float, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 5.0) -> list[str]:
    """Trees by second-order boosting of the weighted logistic loss on binned features, as SQL."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin, out = np.full(len(y), start), []

    def grow(rows: np.ndarray, left: int, g: np.ndarray, h: np.ndarray) -> tuple[str, np.ndarray]:
        value = -rate * g[rows].sum() / (h[rows].sum() + 1)
        best = (1e-6, -1, -1)
        if left:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], k))[:-1]
                hr = h[rows].sum() - hl
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (hr + 1) - whole, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            return f"{value:.9e}D", np.full(len(rows), value)
        _, f, cut = best
        low = binned[rows, f] <= cut
        a, va = grow(rows[low], left - 1, g, h)
        b, vb = grow(rows[~low], left - 1, g, h)
        values = np.empty(len(rows))
        values[low], values[~low] = va, vb
        return f"if({names[f]} <= {float(cuts[f][cut])!r}D, {a}, {b})", values

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree, values = grow(np.arange(len(y)), depth, w * (p - y), w * p * (1 - p))
        margin += values
        out.append(tree)
    return out


def judge(urls: DataFrame, model: Model, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict (block or allow) and score, the trees' block probability.

    The longest rule decides, else the trees. Null and malformed urls have an empty host and path,
    fit no rule and are judged by their features. Columns of these names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in urls.columns if c not in added]
    made = _with_suffix(lexical(urls.select(*[F.col(c).alias(f"__{c}") for c in kept]), f"__{url}"), model)
    margin = F.expr(" + ".join([f"{model.start!r}D", *model.trees]))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    judged = made.withColumns({"rule": rule, "action": action, "margin": margin})
    verdict = F.coalesce("action", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return judged.select(*[F.col(f"__{c}").alias(c) for c in kept], "host", "path", "rule", verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("margin")))).alias("score"))


def labelled_by_rules(urls: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """(url, label) of the urls that a rule decides: the labelled urls of the query."""
    _, action = matched_rule(*parts(F.col(url)), rules)
    return urls.select(F.col(url).alias("url"), F.when(action == "block", 1).when(action == "allow", 0).alias("label")).filter("label is not null")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules, and by the fitted trees where no rule fits."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_by_rules(pages))).drop("url", "score")
