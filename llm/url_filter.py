"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest (operator 8).

The host runs from behind the first `://` to the next `/`, `?`, `#` or the end, with A-Z lower-cased; the path from there
to the next `?`, `#` or the end. A null url, or one without `://`, has an empty host and path. A rule fits its host and all
subdomains if the path starts with the rule's; of several the longest wins. Urls without a rule get the model's verdict;
the empty host and path are allowed. Repeated rows give repeated results; other columns are ignored.

The model is trained on the driver from a labelled table of at most MAX_LABELLED urls (more are an error), as a list or as a
DataFrame of url and label, and is WEIGHTS floats large. Without one it is the small table of this module.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import batch_of, chunks, table, with_ids
from llm.wordhash import mix

#: (verdict, host, path); production rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MAX_LABELLED = 20_000
WEIGHTS = 1 << 16
SIZES = (3, 4, 5)
#: A small labelled table: urls of ordinary sites, and ones that a corpus doesn't want (gambling, adult, pills, loans,
#: pirated files, fake shops, link farms, tracking). Written for this module, on reserved or made-up names.
FINE = """
https://www.rivertown-gazette.test/local/council-meeting-notes
https://docs.orchard-db.test/guide/transactions.html
http://biology.northlake.invalid/courses/genetics/week3
https://en.openalmanac.test/wiki/Tidal_island
https://blog.mapmaker.invalid/2021/05/projections-explained/
https://www.stadtbibliothek-altendorf.test/oeffnungszeiten
https://cuisine-de-saison.invalid/recettes/tarte-aux-poireaux
https://museo-del-mar.test/exposiciones/barcos
http://journal.soilscience.invalid/vol12/issue4/art7.pdf
https://forum.woodturners.test/thread/dull-gouge
https://www.weatherdesk.invalid/forecast/coast/tomorrow
https://help.paperplane-mail.test/articles/filters
https://archive.choral-society.invalid/programmes/1987
https://www.handelskammer.invalid/ausbildung/pruefungen
https://trains.lakeshore.test/timetable/line-4
https://lib.algebra.invalid/notes/rings.html
https://www.gardeners-club.test/seeds/beans
http://observatory.highfield.invalid/images/comet
https://radio.antenne-berg.test/sendungen/morgen
https://www.la-gaceta-del-valle.invalid/cultura/teatro
https://python-helpers.test/api/reference/strings
https://school.greenhill.invalid/calendar/spring
https://www.bergwacht.test/touren/huette
https://chess.endgames.invalid/rook-pawn
https://www.marche-paysan.test/producteurs/fromage
https://history.harbour.invalid/ships/1902/list
https://shop.bookbinder.test/paper/handmade
https://jobs.city-hospital.invalid/nursing
https://podcasts.language-lab.test/episode/41
https://www.cycling-routes.invalid/valley/loop
https://data.census-office.test/tables/households
https://kids.planetarium.invalid/quiz
https://www.photographers-guild.test/gallery/2019
https://law.review-quarterly.invalid/article/contract
https://www.ferienhof-mueller.test/anfahrt
https://news.science-desk.invalid/physics/neutrino
https://api.tide-tables.test/v2/stations
https://www.orchestra.invalid/season/tickets
https://wiki.homebrew-radio.test/antennas/dipole
https://essays.slow-reader.invalid/on-walking
https://www.farmhouse-bakery.test/bread
https://support.printer-works.invalid/drivers
https://people.maths.northlake.invalid/~anna/teaching
https://www.freight-union.test/members/news
https://www.freedom-library.invalid/catalogue
https://www.trackside-railway.test/models
https://www.clickclack-keyboards.invalid/switches
https://loan-museum.test/collections/manuscripts
https://www.adulteducation.invalid/evening-classes
https://www.playhouse.test/tickets/comedy
https://health.county.invalid/vaccines/schedule
https://www.tierheim.test/hunde/vermittlung
https://astronomia.invalid/cursos/telescopios
https://encyclopedie.test/article/volcan
https://www.betweenhills.invalid/inn/rooms
https://dev.compiler-notes.test/ssa/intro
https://www.essex-walks.invalid/route/12
https://www.therapists-register.test/find
https://elections.office.invalid/results/ward7
https://www.analog-audio.test/repair/tapedeck
"""
UNWANTED = """
http://casino-royal-bonus.test/slots/free-spins
https://www.lucky-poker.invalid/bonus?ref=77
http://best-online-casino.test/jackpot
https://freebets24.invalid/live-betting
http://sportsbets.test/odds/today
https://megaslots.invalid/play-now
http://roulette-win.test/register
https://bingo-cash.invalid/prize
http://cheap-pills.test/viagra
https://buy-viagra-now.invalid/order
http://cialis-discount.test/no-prescription
https://pharma-cheap.invalid/pills/buy
http://weightloss-miracle.test/pills
https://xxx-videos.invalid/hot
http://adult-cams.test/live
https://porn-tube.invalid/free
http://sexchat.test/girls
https://hot-singles.invalid/dating-adult
http://escort-adult.test/city
https://nude-pics.invalid/xxx
http://payday-loan-fast.test/apply
https://quick-loans.invalid/cash-now
http://easy-credit.test/no-check
https://loan-approval.invalid/instant
http://crypto-doubler.test/earn
https://forex-profit.invalid/signals
http://make-money-fast.test/join
https://getrich.invalid/secret
http://replica-watches.test/rolex
https://cheap-handbags.invalid/replica/gucci
http://fake-ids.test/order
https://discount-sneakers.invalid/sale/cheap
http://cracked-software.test/keygen
https://warez-download.invalid/full-crack
http://torrent-movies.test/free-download
https://serial-keys.invalid/crack
http://free-iphone.test/winner
https://you-won-prize.invalid/claim
http://survey-reward.test/gift-card
https://click-prize.invalid/win
http://link-farm.test/seo/backlinks
https://spam-links.invalid/directory
http://seo-spam.test/buy-backlinks
https://traffic-bot.invalid/clicks
http://ads-track.test/click?id=3
https://ad-server.invalid/track/pixel
http://popunder-ads.test/serve
https://tracker-click.invalid/redirect
http://adclick.test/banner
https://spamfarm.invalid/page/1
http://casino-spiele.test/bonus
https://apuestas-gratis.invalid/casino
http://pari-casino.test/gratuit
https://kredit-sofort.invalid/ohne-schufa
http://viagra-ohne-rezept.test/kaufen
https://pastillas-baratas.invalid/comprar
http://free-porn.test/xxx/videos
https://pokerbets.invalid/win-cash
http://slots-casino.test/free
https://cheapmeds.invalid/pills-online
"""


def labelled_urls() -> list[tuple[str, int]]:
    """The small table: urls and labels, 1 for unwanted."""
    return [(u, 0) for u in FINE.split()] + [(u, 1) for u in UNWANTED.split()]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_url(url: str | None) -> tuple[str, str]:
    """The same in Python, for the labelled table on the driver."""
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: int) -> Column:
    """The longest rule that fits (what 1) or its verdict (what 0), or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(h + p if what else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def site(host: str) -> str:
    """The host as the model sees it: www. and m. in front are other names of the same site."""
    return re.sub(r"^(?:www|m)\.", "", host)


def features(strings: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight index) of the character n-grams, counted over bytes, of strings that are framed by ^ and $."""
    rows, index = [], []
    for a, _, buf, off in chunks(strings):
        for k in SIZES:
            if len(buf) < k:
                continue
            value = np.zeros(len(buf) - k + 1, np.uint64)
            for i in range(k):
                value = value * np.uint64(257) + buf[i : len(buf) - k + 1 + i].astype(np.uint64)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(value)]
            whole = np.arange(len(value)) + k <= off[row + 1]
            rows.append(row[whole] + a)
            index.append((mix(value[whole] * np.uint64(16) + np.uint64(k * 2 + seed)) >> np.uint64(48)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(index)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def logits(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(hosts), bias)
    for seed, strings in enumerate(([site(h) for h in hosts], paths)):
        rows, index = features(pa.array([f"^{s}$" for s in strings], pa.string()), seed)
        count = np.bincount(rows, minlength=len(hosts))
        total += np.bincount(rows, weights[index], minlength=len(hosts)) / np.sqrt(np.maximum(count, 1))
    return total


def train(labelled: Sequence[tuple[str, int]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient descent; deterministic. One class alone gives a model of that class's verdict."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls train the model")
    if not labelled:
        return np.zeros(WEIGHTS), -1.0
    y = np.array([label for _, label in labelled], float)
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    parts = [features(pa.array([f"^{s}$" for s in strings], pa.string()), seed) for seed, strings in enumerate(([site(h) for h in hosts], paths))]
    rows, index = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    scale = np.concatenate([1 / np.sqrt(np.bincount(r, minlength=len(y)))[r] for r, _ in parts])
    weights, bias = np.zeros(WEIGHTS), 0.0
    for _ in range(rounds):
        z = np.bincount(rows, weights[index] * scale, minlength=len(y)) + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(index, error[rows] * scale, minlength=WEIGHTS) / len(y) * 20 + decay * weights)
        bias -= rate * error.mean()
    return weights, bias


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict and the model's score for every row of pages."""
    if isinstance(labelled, DataFrame):
        labelled = [(r["url"], int(r["label"])) for r in labelled.select("url", "label").limit(MAX_LABELLED + 1).collect()]
    model = pages.sparkSession.sparkContext.broadcast(train(labelled_urls() if labelled is None else labelled))
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            z = logits(hosts, paths, weights, bias)
            empty = np.array([not h and not p for h, p in zip(hosts, paths, strict=True)], bool)
            own = np.where((z > 0) & ~empty, "block", "allow")
            verdict = [v or w for v, w in zip(b.column(4).to_pylist(), own.tolist(), strict=True)]
            yield batch_of(schema, b.column(0), hosts, paths, b.column(3), verdict, np.round(1 / (1 + np.exp(-z)), 6))

    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = with_ids(pages, id_col, url_col).select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    split = split.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, 1), "ruled": rule_of(F.col("host"), F.col("path"), rules, 0)})
    return split.mapInArrow(run, "id long, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
