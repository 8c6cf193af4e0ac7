"""URL filter: logistic regression over hashed character n-grams of host and path, below explicit rules."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIMENSIONS = 1 << 16
HOST_GRAMS, PATH_GRAMS = (3, 4, 5), (3, 4)
#: Length of a path's feature vector against the host's: paths say less.
PATH_SCALE = 0.4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Urls to block and to allow, without schemes: gambling, adult, drugs, loans, stolen software, attacks and link farms against the
#: rest of the web, with innocent hosts that hold a blocked word's letters.
BLOCKED_URLS = """
royal-casino.example casinoking77.com/bonus www.vegascasino.net online-casino-bonus.info/free-spins slotsmania.org/play luckyslots24.com megajackpot.net jackpot-city.org
betnow.com/odds superbet.net bet-and-win.com mybet24.de bet777.net/live www.livebetting.org/football betting-tips.info/odds sportbets.eu topbookmaker.com sports-wagers.net rouletteonline.fr pokerstarz.net/join poker-room.org holdem-poker.com bingobonus.net gambling365.org
freeporn.net/videos pornmovies.com porn-tube.org/watch hotporn.info/amateur bigporn.xxx www.sexcams.de sex-chat.org sexvideos.net/free livesex24.fr hotsexdating.net xxxmovies.es xxx-clips.net/hd xvids.org/teen nudegirls.info nude-cams.net webcamgirls.es
adultfriends.net adult-dating.info adultvids.com/tube escortservice.de escorts-city.org hookup-tonight.net milfdates.info hentaiworld.net eroticstories.org
cheapviagra.com buy-viagra-online.net/order viagra-pills.eu cialis-generic.info/order pillstore.net cheap-pills-online.org meds-without-prescription.net rxmeds.biz onlinemeds24.es/buy-cheap dietpills.de steroids-shop.net
paydayloans.net/apply fastpayday.org instant-loans-now.info badcredit-loans.eu getrichquick.com/secret earn-money-fast.org free-money-now.net
warezworld.net warez-download.info crackedsoftware.org/keygen keygen-crack.net serialkeys-cracks.de torrentking.eu/download free-torrents.net pirate-movies.org/stream nulled-scripts.net
paypal-login-verify.info/account secure-bank-login.net/update verify-account-update.com/signin appleid-confirm.org/login account-suspended-verify.net bank-secure-update.de/verify malware-host.org/payload.exe freevirus-download.net/setup.exe hack-facebook-password.info
linkfarm-directory.org seo-backlinks-cheap.net replicawatches.eu/rolex fake-rolex-replica.org popupads.net/click clicktracker.de/aff adserver-clicks.org/pop
""".split()
ALLOWED_URLS = """
en.wikipedia.example/wiki/River www.sussex.gov.uk/council wessex-railways.com visit-sussex.net/walks sextant.io/docs unisex-clothing.com sextet-music.net sexagesimal-clocks.com
alphabet.xyz/letters betty-bakes.com diabetes.org/research betterhomes.net/garden better-health.com elizabethan-history.com bethlehem.edu betaversion.net/docs tibetmuseum.com
nutcracker-ballet.com firecracker-press.com crackle-pottery.net crackers-and-cheese.com/recipes hackney.gov.uk/libraries hackathon.dev/schedule hackspace.com/projects thackeray-novels.net
medieval-history.net medium.example/science mediterranean-food.com medicine.edu/journal medlineplus.gov/diabetes pharmacology.edu pharmacist-society.org.uk pharmacy-school.com/admissions hospitalpharmacy.org landscape.com/gardens seascape-photos.net
virology.com/lab virus-research.net/papers antimalware.dev/docs computervirus-history.edu security-news.com/malware secure.nationalbank.com/help loginradius.dev/docs
camera-museum.com cambridge-books.com camping-france.fr/sites campus.university.edu cameroon-travel.info escorted-tours.com adulteducation.gov.uk adult-learning.com/courses
analytics.example.com/report analysis.edu cocktails-recipes.net cockpit-project.com hancock-county.gov dickens-museum.com scunthorpe.gov.uk essays-online.edu assessment-centre.com classic-music.com
slotcar-racing.com timeslots.dev poker-face-theatre.net bingohall-history.net lotteryfund.gov.uk/grants oddsandends.net vegas.gov/permits
student-loans.gov/repay libraryloans.com cashmere-knitting.com pillow-shop.com caterpillars.org spills-response.gov torrent-valley-hiking.es pirate-history.museum keystone.edu keyboards.net serial-novels.com
news.daily-herald.com/2023/10/12/politics weather.com/forecast recipes.kitchen.net/bread docs.python.example/3/library openstreetmap.example/map maps.city.gov/parks
school-district.k12.us/calendar parliament.uk/bills sports-news.com/football footballclub.net/fixtures chess-club.com museum.org/exhibits forum.bicycles.net/thread/44 blog.travel-notes.com/2021/05/lisbon shop.books.com/item/9 photo-gallery.net
maths.university.fr/cours gesundheit.de/ratgeber cocina.es/recetas marche-bio.fr wetter.de/berlin universidad.es/grado
example.org/en/3 example.com/de/8 site.example.net/fr/12 archive.com/details/texts data.gov/dataset linux-kernel.dev/docs
""".split()


#: Endings that each host of the table gets besides its own, so that they say nothing by themselves.
ENDINGS = ("com", "net", "org", "info")


def labelled() -> tuple[list[str], list[str]]:
    """Urls to block and to allow: the table, each host with its own ending and with those of ENDINGS."""

    def each(urls: Sequence[str]) -> list[str]:
        out = []
        for url in urls:
            host, slash, path = url.partition("/")
            name = host.rpartition(".")[0]
            out += [f"http://{h}{slash}{path}" for h in (host, *(f"{name}.{e}" for e in ENDINGS))]
        return out

    return each(BLOCKED_URLS), each(ALLOWED_URLS)


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def split_url(url: str | None) -> tuple[str, str]:
    """host_of and path_of of one url, for training."""
    _, found, rest = (url or "").partition("://")
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:].split("?")[0].split("#")[0]
    return rest[:end].translate(str.maketrans(UPPER, LOWER)) if found else "", path if found else ""


def grams(kind: str, text: str, sizes: Iterable[int]) -> np.ndarray:
    """Hashed n-grams of the text between bounds, each once."""
    framed = f"\x02{text}\x03"
    return np.fromiter({zlib.crc32(f"{kind}{framed[i : i + n]}".encode("utf-8", "replace")) % DIMENSIONS for n in sizes for i in range(len(framed) - n + 1)}, np.int64)


class Model(NamedTuple):
    bias: float
    weights: np.ndarray

    def part(self, kind: str, text: str) -> float:
        # N-grams that the table hasn't count as neutral, so that a host of such is told by the intercept.
        idx = grams(kind, text, HOST_GRAMS if kind == "h" else PATH_GRAMS)
        return float(self.weights[idx].sum() / np.sqrt(max(len(idx), 1))) * (PATH_SCALE if kind == "p" else 1.0)


def train(blocked: Sequence[str] = (), allowed: Sequence[str] = (), l2: float = 0.0005, rate: float = 0.5, epochs: int = 600, calm: float = 1.5) -> Model:
    """Full-batch gradient descent on the given urls, or on the table; an allowed one counts `calm` times, as most of the web is
    to be allowed. Host features are scaled to unit length, path features
    to PATH_SCALE."""
    if not blocked and not allowed:
        blocked, allowed = labelled()
    urls = [*blocked, *allowed]
    y = np.repeat([1.0, 0.0], [len(blocked), len(allowed)])
    row, column, value = [], [], []
    for i, url in enumerate(urls):
        host, path = split_url(url)
        for kind, text, sizes in (("h", host, HOST_GRAMS), ("p", path, PATH_GRAMS)):
            idx = grams(kind, text, sizes)
            row.append(np.full(len(idx), i))
            column.append(idx)
            value.append(np.full(len(idx), (PATH_SCALE if kind == "p" else 1.0) / np.sqrt(max(len(idx), 1))))
    used, at = np.unique(np.concatenate(column), return_inverse=True)
    x = np.zeros((len(urls), len(used)))
    np.add.at(x, (np.concatenate(row), at), np.concatenate(value))
    w, b = np.zeros(len(used)), 0.0
    for _ in range(epochs):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * np.where(y, 1.0, calm)
        w -= rate * (x.T @ error / len(y) * 10 + l2 * w)
        b -= rate * error.mean()
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return Model(b, weights)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], model: Model | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict, score) per row of pages.

    The longest rule that fits decides; the model decides the rest: block where its probability reaches the
    threshold. A null url, or one without "://", has an empty host and path and is scored as such; repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    model = train() if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    id_type = cut.schema["page_id"].dataType.simpleString()
    seen: dict[str, float] = {}

    def score(batch):
        m = shared.value
        out = []
        for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True):
            if (h := seen.get(host)) is None:
                if len(seen) > 100_000:
                    seen.clear()
                h = seen[host] = m.part("h", host)
            out.append(1 / (1 + np.exp(-np.clip(m.bias + h + m.part("p", path), -500, 500))))
        return {"page_id": batch["page_id"], "host": batch["host"], "path": batch["path"], "score": out}

    scored = map_batches(cut, score, f"page_id {id_type}, host string, path string, score double")
    hit = rule_of(F.col("host"), F.col("path"), rules)
    return scored.withColumn("hit", hit).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )
