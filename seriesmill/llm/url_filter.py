"""URL filtering: a rule list, and gradient-boosted trees on lexical features where no rule fits.

Features are computed by Spark expressions; the fitted trees are compiled to one Spark expression too. What
is known of a suffix, the share of blocked URLs among those that rules decide, is counted out of fold for
the rows that trees are fitted on, so that no row's own label is in its features. Boosting starts from that
share, so trees explain what differs inside of suffixes, and the form of a suffix's URLs does not stand for
its rules: a suffix that no rule decides starts from the share over all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Labelled URLs that the trees are fitted on at most, chosen by a hash of the URL.
FIT_ROWS = 8_000
#: Parts by a hash of the URL that leave each other out of suffix statistics.
FOLDS = 4
#: Broadcast the statistics of so many suffixes at most: beyond it those of the common ones, of which there
#: can't be more, and shuffle the URLs of the others.
BROADCAST_SUFFIXES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_count", "suffix_block_rate")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a beginning of the path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, the first of equals; else null. For lists of up to some thousands."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    signs = F.split(text, "")
    share = F.transform(F.array_distinct(signs), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": size - F.length(F.replace(path, F.lit("/"), F.lit(""))) - (size - F.length(path)),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(size, F.lit(1)),
        "entropy": F.when(size > 0, F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "hyphens": F.length(F.regexp_replace(host, "[^-]", "")),
    }


@dataclass(frozen=True)
class Tree:
    """A node: a leaf has a value; others send x[feature] <= at to the left."""

    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.at, self.left.predict(x), self.right.predict(x))

    def column(self, names: tuple[str, ...]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(F.col(names[self.feature]) <= self.at, self.left.column(names)).otherwise(self.right.column(names))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> Tree:
    """The tree of greatest gain (second-order, ridge 1) on histograms of the rows given."""
    leaf = Tree(float(-grad.sum() / (hess.sum() + 1)))
    if depth == 0 or len(grad) < 2 * least:
        return leaf
    best = (1e-6, -1, 0)
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        g = np.cumsum(np.bincount(bins[:, f], weights=grad, minlength=len(e) + 1))[:-1]
        h = np.cumsum(np.bincount(bins[:, f], weights=hess, minlength=len(e) + 1))[:-1]
        n = np.cumsum(np.bincount(bins[:, f], minlength=len(e) + 1))[:-1]
        gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - whole
        gain[(n < least) | (len(grad) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return leaf
    _, f, k = best
    low = bins[:, f] <= k
    return Tree(0.0, f, float(edges[f][k]), _grow(x[low], bins[low], edges, grad[low], hess[low], depth - 1, least), _grow(x[~low], bins[~low], edges, grad[~low], hess[~low], depth - 1, least))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def boost(x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, least: int = 10) -> list[Tree]:
    """Trees that add to the log-odds `start` of y in 0 and 1; deterministic."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    score, trees = start.copy(), []
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, bins, edges, p - y, p * (1 - p), depth, least))
        score = score + rate * trees[-1].predict(x)
    return trees


def stopped(x: np.ndarray, y: np.ndarray, start: np.ndarray, group: np.ndarray, rounds: int = 25, rate: float = 0.3) -> list[Tree]:
    """boost with as many rounds as judge the rows of held-out groups best, then on all rows.

    Every fifth group (a host) is held out. Rules may say nothing that the form of a URL shows; then there
    are no trees.
    """
    held = group % 5 == 0
    best, keep = np.inf, 0
    if held.any() and not held.all():
        trees, score = boost(x[~held], y[~held], start[~held], rounds, rate=rate), start[held]
        for k in range(len(trees) + 1):
            loss = float(np.logaddexp(0, np.where(y[held] > 0, -score, score)).mean())
            if loss < best - 5e-3:
                best, keep = loss, k
            if k < len(trees):
                score = score + rate * trees[k].predict(x[held])
    return boost(x, y, start, keep, rate=rate)


def _split(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """pages(page_id, url) with host, path, the fitting rule as `fit`, suffix (the host's last label) and fold."""
    split = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    split = split.withColumns({"fit": longest_rule(F.col("host"), F.col("path"), rules), "suffix": F.substring_index("host", ".", -1)})
    return split.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))


@dataclass(frozen=True)
class Suffixes:
    """counts(suffix, n, b0.., d0..): URLs, blocked and decided ones by fold; over all: rate of blocked among decided ones."""

    counts: DataFrame
    rows: int
    total: int
    blocked: tuple[int, ...]
    decided: tuple[int, ...]

    def rate(self, without: int | None = None) -> float:
        b, d = (sum(x for k, x in enumerate(c) if k != without) for c in (self.blocked, self.decided))
        return (b + 1) / (d + 2)


def suffixes(split: DataFrame) -> Suffixes:
    """Counts over all URLs; partial ones come before the shuffle."""
    blocked, decided = F.col("fit.verdict") == "block", F.col("fit").isNotNull()
    parts = [F.count_if((F.col("fold") == k) & what).alias(f"{name}{k}") for name, what in (("b", blocked), ("d", decided)) for k in range(FOLDS)]
    counts = written(split.groupBy("suffix").agg(F.count("*").alias("n"), *parts), "suffixes")
    names = [f"{name}{k}" for name in "bd" for k in range(FOLDS)]
    rows, total, *sums = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), *(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()
    return Suffixes(counts, rows, total, tuple(sums[:FOLDS]), tuple(sums[FOLDS:]))


def with_features(split: DataFrame, known: Suffixes, fitting: bool = False) -> DataFrame:
    """split (as _split gives it) with FEATURES.

    suffix_count is the order of magnitude (in powers of 2, as a finer number would name the suffix) of
    the number of its URLs; suffix_block_rate is the share of
    blocked URLs among those of the suffix that a rule decides, drawn to the share over all suffixes, which
    it is where none is decided. When fitting, a row's own fold is left out of it.
    """
    if known.rows <= BROADCAST_SUFFIXES:
        joined = split.join(F.broadcast(known.counts), "suffix")
    else:
        common = known.counts.where(F.col("n") * BROADCAST_SUFFIXES > known.total)  # fewer than BROADCAST_SUFFIXES
        rest = split.join(F.broadcast(common.select("suffix")), "suffix", "left_anti")
        joined = split.join(F.broadcast(common), "suffix").unionByName(rest.join(known.counts, "suffix"))

    def rate(without: int | None) -> Column:
        b, d = (sum((F.col(f"{name}{k}") for k in range(FOLDS) if k != without), F.lit(0)) for name in "bd")
        p = known.rate(without)
        return (b + 2 * p) / (d + 2)

    share = rate(None)
    if fitting:
        for k in range(FOLDS):
            share = F.when(F.col("fold") == k, rate(k)).otherwise(share)
    full = joined.withColumns({**lexical(F.col("url"), F.col("host"), F.col("path")), "suffix_count": F.floor(F.log2("n")), "suffix_block_rate": share})
    return full.select("page_id", "url", "host", "path", "fit", *(F.col(c).cast("double").alias(c) for c in FEATURES))


def train(split: DataFrame, known: Suffixes, rows: int = FIT_ROWS) -> list[Tree]:
    """Trees from at most `rows` of the URLs that a rule decides; block is 1."""
    some = split.where("fit is not null").orderBy(F.xxhash64("url"), "url", "page_id").limit(rows)
    got = with_features(some, known, fitting=True).select("url", F.xxhash64("host").alias("group"), F.when(F.col("fit.verdict") == "block", 1.0).otherwise(0.0).alias("y"), *FEATURES).toPandas()
    got = got.sort_values(["url", "y"], kind="stable")  # the same trees whatever the order of rows
    x, y = got[list(FEATURES)].to_numpy(float).reshape(len(got), len(FEATURES)), got["y"].to_numpy(float)
    return stopped(x, y, log_odds(x[:, FEATURES.index("suffix_block_rate")]), got["group"].to_numpy(np.int64))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rate: float = 0.3) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of pages(page_id, url).

    rule: the longest rule that fits, else null; verdict: its verdict, else allow or block as the trees
    decide at one half; score: their probability of block. A null url, and one without ://, has an
    empty host and path and no rule; it is judged by its features like any other. Where rules decide no
    URL, or all alike, there are no trees and the score is the suffix's share. Repeated rows are judged alike.
    """
    split = _split(pages, rules)
    known = suffixes(split)
    featured = with_features(split, known)
    share = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("suffix_block_rate")))
    raw = F.log(share / (1 - share))
    for t in train(split, known):
        raw = raw + F.lit(rate) * t.column(FEATURES)
    scored = featured.withColumn("score", 1 / (1 + F.exp(-raw)))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")
