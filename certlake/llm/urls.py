"""Verdicts on URLs: rules on hosts and paths, and a logistic regression on hashed character n-grams.

The regression learns from a small labelled table of URLs. Its features are the n-grams of the host
and, apart from them, of the path, over bytes with marks at both ends, hashed to BUCKETS. The n-grams of
either part weigh as much as the other's together, so a long path does not outvote its host.
A rule that fits a URL decides it, the longest first; all other URLs get the regression's verdict.

Rules and weights are small and fixed before the scan, which is one narrow stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.llm.common import lower_ascii, text_of

#: Lengths of the n-grams, buckets (a power of two), bytes that are hashed at once.
LENGTHS, BUCKETS, AT_ONCE = (3, 4, 5), 1 << 16, 1 << 20
#: Labelled URLs that a model may be trained from (it holds a dense matrix of them), rules that may be given: more are an error.
MOST_LABELLED, MOST_RULES = 2_000, 1_000
#: Steps and rate of the training, weight of the penalty, score from which on a URL is blocked.
STEPS, RATE, PENALTY, THRESHOLD = 400, 2.0, 3e-4, 0.6


class Rule(NamedTuple):
    """A verdict on the URLs of a host and its subdomains whose path starts with `path`."""

    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

#: The labelled URLs of the registered query: gambling, pills, adult, spam, trackers and traps.
BLOCKED = """
http://royal-casino.test/en/4471.html http://www.casino-royale-slots.test/bonus http://m.mega-casino.test/fr/12/
http://online-poker-room.test/join http://pokerstars-bonus.test/en/88 http://slots-jackpot.test/de/spin?ref=x
http://sports-bets.test/odds/ http://betting-tips.test/en/today.html http://www.bets-365-win.test/live
http://free-bet-offer.test/es/221 http://lucky-win.test/lottery http://blog.win-big-prizes.test/claim#top
http://winner-prize.test/en/5541.html http://you-win-iphone.test/fr/9 http://m.lotto-winners.test/de/771/
http://cheap-viagra.test/buy http://www.online-pills.test/en/33 http://discount-pharmacy-pills.test/cart
http://m.diet-pills-now.test/fr/1209.html http://buy-cialis-cheap.test/de/4 http://blog.cheap-meds.test/es/order
http://canadian-pharma.test/en/pills/ http://weight-loss-pill.test/en/71 http://cheap-replica-watches.test/shop
http://adult-video.test/en/44 http://www.adult-dating.test/fr/meet http://www.xxx-movies.test/watch?id=9
http://hot-sex-cams.test/live/ http://free-porn-tube.test/de/8812.html http://adults-only.test/en/enter
http://m.sexy-singles.test/es/5 http://live-xxx-chat.test/room/3 http://nude-x-pics.test/en/91#top
http://link-farm.test/en/1 http://www.linkfarm-seo.test/de/88.html http://spam-mail-list.test/fr/7
http://www.seo-spam.test/buy/links http://blog.spammy-content.test/en/992/ http://article-farm.test/es/614
http://content-farm-24.test/en/17 http://m.click-farm.test/de/go http://spam-comments.test/fr/40.html
http://ads-server.test/click?id=1 http://www.adserver-track.test/pixel http://track-clicks.test/en/7
http://adtracker.test/beacon http://popup-ads.test/de/9 http://tracking-pixel.test/en/55.html
http://ad-network-banner.test/fr/serve http://m.banner-ads.test/es/3/ http://clicktrack-affiliate.test/go?ref=x
http://free-money-now.test/en/661 http://blog.payday-loans-fast.test/apply http://www.quick-cash-loan.test/fr/12
http://make-money-fast.test/de/5.html http://work-at-home-cash.test/en/join http://crypto-doubler.test/es/send
http://m.free-gift-cards.test/en/8/ http://free-iphone-win.test/claim?utm_source=feed http://free-downloads-crack.test/de/19
http://warez-crack.test/en/keygen http://serial-keygen.test/fr/2 http://torrent-cracks.test/en/9001.html
http://fake-rolex-replica.test/es/77 http://phish-login-verify.test/account http://bank-verify-secure-login.test/en/3
"""
#: Ordinary ones: institutions, news, shops, invented names, and the same kinds of paths.
ALLOWED = """
http://university-library.test/en/4471.html http://www.daily-herald.test/news/2024 http://m.city-council.test/fr/12/
http://gardening-weekly.test/join http://open-source-tools.test/en/88 http://bakery-corner.test/de/menu?ref=x
http://national-museum.test/odds/ http://school-district.test/en/today.html http://www.weather-report.test/live
http://blog.therapist-notes.test/es/221 http://m.hiking-trails.test/maps http://children-books.test/read#top
http://m.astronomy-club.test/en/5541.html http://tea-and-cakes.test/fr/9 http://river-cruises.test/de/771/
http://art-gallery.test/buy http://www.furniture-makers.test/en/33 http://handmade-pottery.test/cart
http://local-history.test/fr/1209.html http://www.recipes-kitchen.test/de/4 http://train-timetables.test/es/order
http://mathematics-forum.test/en/proofs/ http://bird-watching.test/en/71 http://second-hand-books.test/shop
http://documentary-channel.test/en/44 http://www.village-theatre.test/fr/meet http://short-films.test/watch?id=9
http://concert-hall.test/live/ http://language-courses.test/de/8812.html http://science-journal.test/en/enter
http://m.travel-diary.test/es/5 http://community-radio.test/room/3 http://landscape-photos.test/en/91#top
http://thenation.test/en/1 http://www.information-office.test/de/88.html http://shetland-wool.test/fr/7
http://northern-lights.test/links http://thornton-press.test/en/992/ http://hampshire-herbs.test/es/614
http://education-ministry.test/en/17 http://theatre-tickets.test/de/go http://blog.weathering.test/fr/40.html
http://patient-support.test/click?id=1 http://www.station-master.test/pixel http://meteorology.test/en/7
http://wikipedia-reader.test/page http://research-notes.test/de/9 http://www.linguistics-department.test/en/55.html
http://health-service.test/fr/serve http://m.seaside-hotel.test/es/3/ http://other-stories.test/go?ref=x
http://tionale.test/en/661 http://theran.test/apply http://m.shenton.test/fr/12
http://ingther.test/de/5.html http://www.thandor.test/en/join http://lenreha.test/es/send
http://hathon.test/en/8/ http://blog.erinou.test/claim?utm_source=feed http://m.stonly.test/de/19
http://blog.tribune-letters.test/en/page http://lantern-works.test/fr/2 http://orchard-farmers.test/en/9001.html
http://winterthur-museum.test/es/77 http://alphabet-school.test/account http://river-bank-cafe.test/en/3
http://adventure-books.test/en/12 http://better-homes.test/de/30 http://roadside-assistance.test/fr/61.html
http://trackway-walks.test/en/4 http://window-makers.test/es/8 http://freedom-library.test/en/230/
"""


def labelled(spark: SparkSession) -> DataFrame:
    """(url, blocked): the labelled URLs above."""
    rows = [(url, True) for url in BLOCKED.split()] + [(url, False) for url in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, blocked boolean")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first `://` and the next `/`, `?` or `#`, with A-Z in lower case; then what comes before `?` or `#`."""
    url = text_of(url)
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return lower_ascii(host), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    Of equally long ones that with the longer host comes first, then a block before an allow. A
    host is looked up by its last labels only, as many as any rule has.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kind = "array<struct<size: int, host_size: int, block: boolean, path: string, rule: string, verdict: string>>"
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    entries = []
    for name, own in by_host.items():
        structs = [F.struct(*map(F.lit, (len(r.host + r.path), len(r.host), r.verdict == "block", r.path, r.host + r.path, r.verdict))) for r in own]
        entries += [F.lit(name), F.array(*structs).cast(kind)]
    known = F.create_map(*entries)
    depths = sorted({name.count(".") + 1 for name in by_host})
    met = [F.coalesce(F.try_element_at(known, F.substring_index(host, ".", -depth)), F.array().cast(kind)) for depth in depths]
    fits = F.filter(F.flatten(F.array(*met)), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


class Grams:
    """Hashed n-grams of many byte strings, a bounded piece at a time."""

    def __init__(self, texts: list[bytes], salt: int):
        self.data = np.frombuffer(b"".join(b"\x02" + t + b"\x03" for t in texts), np.uint8)
        self.sizes = np.array([len(t) + 2 for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.salt = salt

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, bucket) of every n-gram that lies within one text."""
        for at in range(0, len(self.data), AT_ONCE):
            stop = min(at + AT_ONCE, len(self.data))
            row = np.searchsorted(self.ends, np.arange(at, stop), side="right")
            data = self.data[at : stop + max(LENGTHS) - 1].astype(np.uint64)
            for n in LENGTHS:
                count = min(stop - at, len(data) - n + 1)
                if count <= 0:
                    continue
                hashed = np.full(count, self.salt * 64 + n, np.uint64)
                for j in range(n):
                    hashed = (hashed ^ data[j : j + count]) * np.uint64(0x9E3779B97F4A7C15)
                    hashed ^= hashed >> np.uint64(29)
                inside = np.arange(at, at + count) + n <= self.ends[row[:count]]
                yield row[:count][inside], (hashed[inside] & np.uint64(BUCKETS - 1)).astype(np.int64)

    def counts(self) -> np.ndarray:
        """n-grams of each text, at least 1."""
        return np.maximum(sum(np.maximum(self.sizes - n + 1, 0) for n in LENGTHS), 1)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each text's sum of weights, over the root of its count."""
        total = np.zeros(len(self.sizes))
        for row, bucket in self.pieces():
            total += np.bincount(row, weights[bucket], minlength=len(total))
        return total / np.sqrt(self.counts())


class Model(NamedTuple):
    host: np.ndarray
    path: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability of a block for each URL."""
        z = self.bias + Grams([h.encode() for h in hosts], 1).sums(self.host) + Grams([p.encode() for p in paths], 2).sums(self.path)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(table: DataFrame) -> Model:
    """A model from labelled URLs (url, blocked), at most MOST_LABELLED.

    Penalised logistic regression by whole-batch gradient steps with momentum; both labels weigh the
    same in all. Rows with a null url or label are left out; without rows of both labels, an error.
    """
    host, path = host_and_path(F.col("url"))
    own = table.where("url is not null and blocked is not null").select(host.alias("host"), path.alias("path"), F.col("blocked").cast("boolean").alias("blocked"))
    rows = own.limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    rows = sorted(rows)
    label = np.array([r["blocked"] for r in rows], bool)
    if label.all() or not label.any():
        raise ValueError("labelled URLs of both kinds are needed")
    parts = [Grams([r["host"].encode() for r in rows], 1), Grams([r["path"].encode() for r in rows], 2)]
    # (text, column, its value) over the n-grams that occur, each once a text
    columns, features = [], []
    for p in parts:
        row, bucket = (np.concatenate(c) for c in zip(*p.pieces()))
        seen, bucket = np.unique(bucket, return_inverse=True)
        x = np.zeros((len(rows), len(seen)))
        np.add.at(x, (row, bucket), 1 / np.sqrt(p.counts())[row])
        columns.append(seen)
        features.append(x)
    share = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum())
    sizes, x = [len(c) for c in columns], np.concatenate([*features, np.ones((len(rows), 1))], axis=1)
    weights, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 0
    for _ in range(STEPS):
        gap = (1 / (1 + np.exp(-(x @ weights))) - label) * share
        speed = 0.9 * speed - RATE * (gap @ x + penalty * weights)
        weights = weights + speed
    dense = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    dense[0][columns[0]], dense[1][columns[1]] = weights[: sizes[0]], weights[sizes[0] : -1]
    return Model(dense[0], dense[1], float(weights[-1]))


def judged(pages: DataFrame, model: Model, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `pages`, repeated ones too.

    `score` is the model's probability of a block; the verdict is the rule's where one fits, else
    block from THRESHOLD on. A null url, or one without `://`, has an empty host and path, which
    no rule fits and the model scores like any other. Other columns are not read, an empty
    table gives no rows, and a null page_id stays.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], ["page_id", "host", "path", "score"])

    kind = own.schema["page_id"].dataType.simpleString()
    scored = own.mapInArrow(score, f"page_id {kind}, host string, path string, score double")
    found = scored.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    own_verdict = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", own_verdict).alias("verdict"), "score")
