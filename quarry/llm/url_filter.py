"""URL filters: explicit host/path rules, and logistic regression on hashed character n-grams of host
and path for the rest.

Rules and parsing are column expressions; the classifier scores Arrow batches. The model is trained on the
driver from a small labelled table (``LABELLED_URLS`` by default) and shipped as one fixed-size vector of
``2**BITS`` weights, so nothing that is broadcast grows with the data.

Defined results: a null URL, or one without ``://``, has an empty host and path, matches no rule and, without any
feature, has score 0 and is allowed. Ports and user info belong to the host, as written. Rows with
equal ids or URLs are judged one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import missing, read_table

BITS = 16
#: Share of URLs to block before anything is known of them.
PRIOR = 0.25


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: A small labelled table, by hand: URLs to allow and to block. Hosts of both classes have plain paths too, pages to
#: allow speak of the subjects of those to block, and no ending of a host belongs to one class.
ALLOWED_URLS = """
https://www.cityherald.com/world/2021/05/river-flood  https://www.cityherald.com/opinion/casino-law-reform
https://news.harbourpost.net/en/12  https://news.harbourpost.net/sport/match-report  http://library.tulane-hill.edu/catalogue
http://library.tulane-hill.edu/history/poker-and-cards  https://docs.openfield.org/guide/start.html  https://docs.openfield.org/api/click-events
https://blog.maplecode.info/2020/04/sorting-lists  https://blog.maplecode.info/tags/python  http://www.lakeside-school.org/fr/345.html
https://museum.norden.info/de/77/  https://museum.norden.info/collection/nude-in-painting  https://journal.biolab.org/es/901
https://journal.biolab.org/article/viagra-trial-results  https://health.publicinfo.org/pills/side-effects  https://health.publicinfo.org/sex-education/teens
https://forum.gardenfriends.net/thread/4411  https://forum.gardenfriends.net/thread/free-seeds  https://recipes.kitchenbook.com/cheap-dinner
https://www.trainlines.biz/timetable  https://www.trainlines.biz/tickets/loan-cards  https://weather.skywatch.io/today
https://m.skywatch.io/en/474.html  https://wiki.stonebridge.club/about  https://wiki.stonebridge.club/torrent-river
https://shop.bookbarn.top/books/history  https://shop.bookbarn.top/en/9  https://www.parliament-watch.org/bills/gambling-act
https://www.dailyfinance.net/markets/crypto-crash  https://www.dailyfinance.net/advice/payday-loans-explained  http://unitown.ac/courses/2022
https://photos.hikers.win/alps  https://radio.bluehills.click/live  https://en.encyclo.org/wiki/Casino  https://en.encyclo.org/wiki/Pornography
https://dev.toolchain.io/release/crack-propagation  http://www.vicarage.co/contact  https://press.ministry.gov/speech/drug-policy
https://blog.greenfarm.org/en/31  https://www.adulteducation.net/fr/8/  http://m.alphabet-shop.org/es/77.html  https://www.freebird.net/en/5
https://blog.winterhill.org/de/6  https://www.racetrack.net/en/901  https://m.leadship.info/fr/12  https://blog.pillsbury-town.org/en/44
https://tionble.cafe.net/en/1185?page=2  https://m.thand.example.org/de/45/  https://www.athens-times.com/fr/880#top  http://smalltown.org/
""".split()
BLOCKED_URLS = """
https://ads.trackzone.biz/click?id=9  https://ads.trackzone.biz/banner/728x90  https://adserver.pixelhub.net/track/pixel.gif
https://adserver.pixelhub.net/en/12  https://casino-bonus.win/  https://casino-bonus.win/slots/free-spins  https://www.royal-casino.com/poker/bonus
https://www.royal-casino.com/about  https://bet-slots24.org/jackpot  https://bet-slots24.org/de/77/  https://xxx-videos.club/hot-cams
https://xxx-videos.club/en/9  https://www.freeporn-tube.com/teen/video123  https://www.freeporn-tube.com/contact  https://sexcams-live.net/adult/chat
https://sexcams-live.net/fr/345.html  https://cheap-pills.top/viagra-online  https://cheap-pills.top/today  https://pharma-discount-meds.info/buy-cialis
https://pharma-discount-meds.info/buy/tramadol-cheap  https://free-downloads.click/crack-keygen  https://free-downloads.click/torrent/full-crack
https://warez-world.io/serial-keys  https://warez-world.io/download/keygen.exe  https://payday-loans-fast.biz/apply-now  https://payday-loans-fast.biz/cash-loan
https://crypto-doubler.org/get-rich-quick  https://crypto-doubler.org/bitcoin-giveaway  https://winprize-now.club/claim-prize  https://winprize-now.club/promo/bonus-win
https://replica-watches-sale.net/cheap-rolex  https://replica-watches-sale.net/  https://hot-singles-dating.com/adult/meet  https://hot-singles-dating.com/escort-girls
https://blog.adult-movies.net/en/31  https://www.adult-shop24.org/fr/8/  http://m.betting-tips.org/es/77.html  https://www.free-spins-bet.net/en/5
https://blog.link-spam.org/de/6  https://www.spamdexing-links.net/en/901  https://m.seo-linkfarm.info/fr/12  https://blog.diet-pills-shop.org/en/44
https://m.online-casino24.org/de/3/  https://www.track-ads-server.org/en/68  https://ad-tracking.net/es/4  https://blog.lucky-win-casino.net/fr/60
https://clicktrack.promo-links.info/redirect?u=1  https://popunder.adsnetwork.co/pop.js  https://escort-paradise.net/girls  https://gambling-palace.top/roulette-bonus
""".split()
LABELLED_URLS = tuple([(u, 0) for u in ALLOWED_URLS] + [(u, 1) for u in BLOCKED_URLS])


def parse_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def parse_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, rule verdict) of the longest rule that fits, nulls if none does. Equal lengths: the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one wrapped is tested first.
    for _, r in sorted(enumerate(rules), key=lambda x: (len(x[1].text), -x[0])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _parts(url: str) -> tuple[str, str]:
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", "")


def grams(host: str, path: str, low: int = 2, high: int = 4) -> np.ndarray:
    """Hashed slots of the character n-grams of host and path, kept apart by a prefix."""
    out = []
    for kind, s in (("h", host), ("p", path)):
        s = f"^{s}$"
        out += [zlib.crc32(f"{kind}{s[i : i + n]}".encode("utf-8", "replace")) & ((1 << BITS) - 1) for n in range(low, high + 1) for i in range(len(s) - n + 1)] if len(s) > 2 else []
    return np.unique(np.array(out, dtype=np.int64))


def train(table: tuple[tuple[str, int], ...] = LABELLED_URLS, epochs: int = 300, rate: float = 5.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent: deterministic, driver-side, the table is small. The bias is
    held at an unknown host's odds of ``PRIOR``, so without evidence a URL is allowed."""
    rows = [(grams(*_parts(u)), y) for u, y in table]
    w, b = np.zeros(1 << BITS), math.log(PRIOR / (1 - PRIOR))
    for _ in range(epochs):
        g = l2 * w
        for x, y in rows:
            g[x] += (probability(w, b, x) - y) / len(rows) / max(1.0, np.sqrt(len(x)))
        w -= rate * g
    return w, b


def probability(w: np.ndarray, b: float, x: np.ndarray) -> float:
    """Of the class to block; 0 for a URL without host and path."""
    return float(1 / (1 + np.exp(-(w[x].sum() / max(1.0, np.sqrt(len(x))) + b)))) if len(x) else 0.0


@functools.lru_cache(maxsize=1)
def _default_model() -> tuple[np.ndarray, float]:
    return train()


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score): the rule's verdict where one fits (the score is null then: such URLs
    aren't scored), else block from score 0.5."""
    w, b = model or _default_model()
    weights = w.astype(np.float32)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if missing(h) else probability(weights, b, grams(h, p)) for h, p in zip(host, path, strict=True)], dtype="float64")

    host, path = F.col("host"), F.col("path")
    rule, verdict = matching_rule(host, path, rules)
    parsed = pages.select(F.col(id_col).alias(id_col), parse_host(F.col(url_col)).alias("host"), parse_path(F.col(url_col)).alias("path"))
    ruled = parsed.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    scored = ruled.withColumn("score", score(F.when(F.col("rule").isNull(), host), path))
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("fixed", learned).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
