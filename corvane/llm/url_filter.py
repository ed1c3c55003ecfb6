"""URL filters: host and path rules first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, mix, utf8

# The labelled table: hosts, some with a path, sorted by label.
BLOCKED = """
1xbet-casino.com bet365bonus.net online-casino-slots.biz freespins-casino.info pokerstars-bonus.net royal-jackpot-casino.com
luckyslots777.com vegas-roulette.online betting-tips-vip.ru megabet88.com sportsbet-odds.xyz win-lottery-now.top mobile-casino.club
casino-poker.club/bonus best-online-slots.net/free-spins jackpot-city.bet/roulette lotto-winners.top/claim-prize 777slots.vip
xxx-tube.com freepornvideos.net hotsexcams.com adult-webcams.live porn-hd.xxx nudegirls.club sexchat.cam eroticmassage.biz
livejasmin-girls.com xvideo-free.net teensex.tube milf-dating.click escort-london.biz/girls adultfriend-hookup.com/sex xhamster-clips.top
buy-viagra-online.com cheap-cialis.biz pharmacy-no-prescription.net v1agra-store.com discount-pills24.top rx-meds-cheap.biz
canadian-pharma.ru/viagra tramadol-online.top/buy weight-loss-pills.click diet-miracle.club/keto-pills cheap-meds.info/cialis-generic
replica-watches.cc cheap-rolex.top fake-handbags.biz replica-shoes.ru louisvuitton-outlet.top buy-fake-diplomas.com cheap-jerseys.cn
payday-loans-fast.com quick-cash-advance.biz bad-credit-loan.top free-money-now.click get-rich-quick.club bitcoin-doubler.top
forex-profit-robot.biz earn-money-home.click crypto-giveaway.top/claim make-money-fast.info/join binary-options-signals.biz
buy-followers-cheap.com seo-backlinks.biz link-farm.top buy-instagram-likes.net spam-mailer.biz traffic-bot.top clickbait-news.click
spamfarm.info/links seo-spam.click doorway-pages.biz popunder-ads.top ad-tracker.click banner-clicks.top/adserver fake-reviews.biz
warez-download.ru cracked-software.top keygen-serial.biz torrent-cracks.net free-nulled-themes.top activator-crack.biz/keygen
serials-crack.info/download movies-torrent.top/warez full-crack.club/serial-key malware-download.top phishing-login.tk
secure-paypal-verify.tk account-update-bank.ml login-appleid-verify.ga free-iphone-winner.top/claim virus-removal-now.click/install
winner-prize.club/survey miracle-hair-loss.top belly-fat-trick.click psychic-love-spell.biz
""".split()
ALLOWED = """
en.wikipedia.org/wiki/Physics de.wikipedia.org/wiki/Berlin fr.wikipedia.org/wiki/Paris wikidata.org/entity/Q42 wiktionary.org/wiki/word
bbc.co.uk/news/world nytimes.com/2021/05/science theguardian.com/environment lemonde.fr/culture spiegel.de/politik elpais.com/deportes
reuters.com/markets apnews.com/article zeit.de/wissen sueddeutsche.de/kultur liberation.fr/planete nzz.ch/wirtschaft abc.es/viajes
github.com/apache/spark gitlab.com/explore python.org/doc docs.oracle.com/javase stackoverflow.com/questions/12345 developer.mozilla.org/docs
kernel.org/pub debian.org/distrib sourceforge.net/projects apache.org/licenses numpy.org/doc crates.io/crates npmjs.com/package/left-pad
nasa.gov/missions noaa.gov/weather nih.gov/health usgs.gov/faq europa.eu/press bund.de/service service-public.fr gob.es/tramites un.org/en
mit.edu/courses ox.ac.uk/research stanford.edu/class tum.de/studium sorbonne.fr/formation uam.es/ciencias ethz.ch/en/studies ens.fr
nature.com/articles sciencemag.org/news arxiv.org/abs/1706.03762 jstor.org/stable plos.org/article springer.com/book doi.org/10.1000/182
allrecipes.com/recipe/pancakes chefkoch.de/rezepte marmiton.org/recettes seriouseats.com/bread bonappetit.com/story gardeningknowhow.com
weather.com/today accuweather.com/forecast meteofrance.com dwd.de/wetter aemet.es/tiempo openstreetmap.org/relation maps.me/catalog
imdb.com/title goodreads.com/book gutenberg.org/ebooks archive.org/details librarything.com/work poetryfoundation.org/poems classicfm.com
amazon.com/books ebay.com/itm etsy.com/listing ikea.com/de/cat otto.de/schuhe fnac.com/livre zalando.es/zapatos lidl.de/angebote rei.com
espn.com/soccer uefa.com/match kicker.de/bundesliga lequipe.fr/tennis marca.com/baloncesto olympics.com/athletes fifa.com/ranking
tripadvisor.com/hotels lonelyplanet.com/italy bahn.de/fahrplan sncf-connect.com renfe.com/billetes airbnb.com/rooms booking.com/city
medium.com/story wordpress.org/plugins blogspot.com/2012/03/garden.html tumblr.com/post flickr.com/photos reddit.com/r/science
museum.org/exhibits library.org/catalog cityhall.gov/events school.edu/news hospital.org/doctors theatre.org/programme parks.org/trails
smith-family.net/holiday johnsbakery.com/menu oldmill-hotel.com/rooms green-valley.org/hiking riverside-school.org/calendar a1-plumbing.com
mueller-gmbh.de/kontakt boulangerie-dupont.fr casa-rural.es/reservas seaside-inn.co.uk chess-club.org/results photo-club.net/gallery
github.com/org/spam-filter docs.python.org/library security.org/phishing-awareness health.org/cialis-side-effects x.org t.co/abc
""".split()


# Words of hosts to block and to allow; each is put into every frame, so that the frames tell nothing.
BLOCKED_WORDS = """
casino poker slots betting bets jackpot roulette lottery gambling bingo viagra cialis pills pharma-discount cheap-meds adult adult-cams
xxx porn nude escort sex-chat hot-girls replica-watches payday-loan fast-cash free-money win-prize easy-profit spam link-farm spam-farm
clickbait malware phishing warez cracked keygen torrent-crack get-rich miracle-diet weight-loss fake-reviews buy-followers seo-links
ad-tracker ads-network track-clicks popunder doorway-page
""".split()
ALLOWED_WORDS = """
news weather wiki library museum school university science history garden recipes travel music sports health forum archive docs blog
photo journal review market events maps community council theatre books research language city river mountain kitchen family project
studio village harbour bakery bank cinema toys hotel forest planet theory mueller dupont garcia smith kowalski ross leman orten thiel
""".split()
FRAMES = "http://{}.com http://www.{}.net/index.html http://{}.org/en/about http://m.{}.info/de/12 http://my-{}.eu/fr http://{}.web-space.com/es/start http://blog.{}.sites.net/2020/05/post http://{}24.org/page.php?id=7".split()


def labelled_table() -> list[tuple[str, int]]:
    """The default labelled URLs (1: block): the ones listed, and the words in their frames."""
    listed = [(f"http://{u}", 1) for u in BLOCKED] + [(f"https://{u}", 0) for u in ALLOWED]
    return listed + [(f.format(w), label) for label, found in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)) for w in found for f in FRAMES]


def host(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From where the host ends up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(hosts: pa.Array, paths: pa.Array, bits: int, sizes: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram of `host>path<`, and the row that it is of."""
    text = pa.array([f"^{h}>{p}<" for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)], pa.string())
    data, off = utf8(text)
    owner = np.repeat(np.arange(len(text)), np.diff(off))
    code, found, rows = data.astype(U), [], []
    for n in sizes:
        if len(code) < n:
            continue
        key = np.zeros(len(code) - n + 1, U)
        for i in range(n):
            key = (key << U(8)) | code[i : len(code) - n + 1 + i]
        same = owner[: len(key)] == owner[n - 1 :]
        found.append((mix(key ^ U(n << 56)) & U((1 << bits) - 1)).astype(np.int64)[same])
        rows.append(owner[: len(key)][same])
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit(labelled: list[tuple[str, int]], bits: int = 16, rounds: int = 400, step: float = 20.0, decay: float = 1e-4, prior: float = 0.25) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; each URL's features have length 1.

    prior: what share of URLs is to be blocked, as the table need not show that; the two labels weigh so.
    """
    split = [u.split("://", 1)[1] if "://" in u else "" for u, _ in labelled]
    cut = [re.search("[/?#]|$", x).start() for x in split]
    hosts = pa.array([x[:i].lower() for x, i in zip(split, cut, strict=True)], pa.string())
    paths = pa.array([re.split("[?#]", x[i:])[0] for x, i in zip(split, cut, strict=True)], pa.string())
    y = np.array([float(v) for _, v in labelled])
    feature, row = grams(hosts, paths, bits)
    norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    weight, bias = np.zeros(1 << bits), 0.0
    importance = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(row, weight[feature], len(y)) * norm + bias
        g = (1 / (1 + np.exp(-z)) - y) * importance
        weight -= step * (np.bincount(feature, (g * norm)[row], 1 << bits) + decay * weight)
        bias -= g.sum()
    return weight, bias


def score(model: tuple[np.ndarray, float], hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    weight, bias = model
    feature, row = grams(hosts, paths, int(np.log2(len(weight))))
    norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
    return 1 / (1 + np.exp(-(np.bincount(row, weight[feature], len(hosts)) * norm + bias)))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every page.

    rules: (action, host and path), such as ("block", "net/de/"); the longest that fits decides. They and the model
    go to every task: rules are a list given by hand, the model has 2**16 weights. labelled: (url, 1 for block).
    A null url, or one without ://, has empty host and path; where no rule fits, empty ones too, the verdict is the model's.
    Repeated rows are judged alike; an empty table gives no rows; other columns are not looked at.
    """
    model = fit(labelled or labelled_table())
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        by_host.setdefault(h, []).append((f"/{p}", rule, action))

    def first(h: str, p: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while h:
            for prefix, rule, action in by_host.get(h, ()):
                if p.startswith(prefix) and len(rule) > len(best[0] or ""):
                    best = (rule, action)
                    break
            h = h.partition(".")[2]
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column("host"), b.column("path")
            p = score(model, hosts, paths)
            ruled = [first(h, x) for h, x in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            verdict = [a or ("block" if s >= threshold else "allow") for (_, a), s in zip(ruled, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), hosts, paths, pa.array([r for r, _ in ruled], pa.string()), pa.array(verdict, pa.string()), pa.array(p)],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
