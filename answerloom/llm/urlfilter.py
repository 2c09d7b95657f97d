"""URL verdicts: explicit rules first, else logistic regression on hashed character n-grams of host and path.

The classifier is fitted on the driver to the small labelled table below, a constant of this module, and its
weights (DIMS numbers) go to the executors with the task.

Defined cases: a null url, or one without "://", has empty host and path and fits no rule; an empty url's verdict
is the classifier's for no n-grams, which is allow; repeated pages are judged row by row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

DIMS = 1 << 13
GRAMS = (3, 4, 5)

# Rules as (action, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"))

# The labelled table: hosts and paths of unwanted pages and of ordinary ones.
UNWANTED = (
    "spam-farm.example.org/en/1", "www.spam-links.org/list", "cheap-pills.example.net/en/20", "buy-pills-online.org/shop",
    "casino-win.example.net/en/7", "best-casino.org/bonus", "online-casino-games.net/play", "free-bets.example.net/de/3",
    "sports-bets.org/odds", "betting-tips.net/today", "adult-x.example.com/en/5", "adult-video.net/hot", "xxx-cams.org/live",
    "ads-track.example.com/en/9", "ad-tracker.net/click", "track-ads.org/pixel", "viagra-cheap.org/order", "replica-watches.net/buy",
    "payday-loans.org/apply", "quick-loans-now.net/cash", "poker-win.org/join", "slots-free.net/spin", "lottery-winner.org/claim",
    "click-farm.net/ads", "seo-links-farm.org/buy", "malware-free-download.net/exe", "warez-crack.org/keygen", "torrent-free.net/movie",
    "hot-singles.org/meet", "escort-ads.net/city", "cheap-meds.org/pharmacy", "win-prizes.net/free", "gambling-free-spins.org/win",
    "spam-mail-list.net/offers", "doorway-farm.org/links", "free-casino-bonus.net/win")
ORDINARY = (
    "tionsh.example.org/en/14", "www.ththth.example.org/de/685", "blog.therou.example.net/en/474.html", "m.ththan.example.org/en/960",
    "ththin.example.org/fr/671", "thertion.example.org/es/978", "ththed.example.net/en/453", "ththble.example.net/de/797",
    "news.city-herald.org/2021/05/council", "www.university.edu.org/research/physics", "library.museum.org/collections/maps",
    "docs.project.org/guide/install.html", "blog.garden.net/how-to-prune", "science-daily.org/articles/water", "recipes.kitchen.net/soup",
    "history.archive.org/war/1914", "travel.guide.net/italy/rome", "weather.service.org/forecast", "wiki.open.org/page/river",
    "schools.district.org/calendar", "music.review.net/album/12", "health.clinic.org/vaccines", "forum.linux.net/thread/99",
    "www.parliament.org/members", "sports.club.org/results", "math.notes.org/algebra/3", "poetry.house.net/poem/7",
    "birds.watch.org/species", "films.journal.net/review", "www.bookshop.org/title/88", "maps.trail.org/hike", "code.samples.net/python",
    "energy.report.org/solar", "painting.school.net/oil", "law.court.org/opinion/5", "chess.club.net/opening")


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s)(?:(?!://).)*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; null if none fits."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), a, h + p) for a, h, p in ranked]
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, a, text in reversed(fits):
        rule, action = F.when(fit, text).otherwise(rule), F.when(fit, a).otherwise(action)
    return rule, action


def features(host: str, path: str, dims: int = DIMS) -> np.ndarray:
    """Distinct hashed n-grams of the host, marked at both ends, and of the path without digits."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", "".join(c for c in path if not c.isdigit()))):
        for n in GRAMS:
            out.update(zlib.crc32(f"{kind}{text[i:i + n]}".encode()) % dims for i in range(len(text) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def fit(unwanted=UNWANTED, ordinary=ORDINARY, dims: int = DIMS, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, by full-batch gradient descent."""
    rows = [features(*_split(u), dims) for u in (*unwanted, *ordinary)]
    x = np.zeros((len(rows), dims + 1))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(len(r), 1))
    x[:, dims] = 1
    y = np.r_[np.ones(len(unwanted)), np.zeros(len(ordinary))]
    w = np.zeros(dims + 1)
    for _ in range(rounds):
        w -= rate * 10 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + decay * w)
    return w


def _split(url: str) -> tuple[str, str]:
    host, _, rest = url.partition("/")
    return host, f"/{rest}"


def score(weights: np.ndarray, host: str, path: str) -> float:
    """Probability that a page is unwanted."""
    dims = len(weights) - 1
    own = features(host, path, dims)
    z = weights[own].sum() / np.sqrt(len(own)) + weights[dims] if len(own) else -1.0
    return float(1 / (1 + np.exp(-z)))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the classifier's score of every url."""
    weights = fit()

    @F.pandas_udf("double")
    def unwanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([score(weights, h, p) for h, p in zip(hosts, paths, strict=True)])

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rated = parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), unwanted("host", "path").alias("score"))
    return rated.select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
