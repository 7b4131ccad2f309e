"""URL filtering by host and path rules, and a logistic regression for the rest; DataFrame functions only.

The regression reads hashed character n-grams of host and path, each by its
share among all of them. It is trained on the driver from a small labelled table
(LABELLED) and enters the plan as one literal array of BUCKETS weights.

Of the rules that fit, the longest decides; of equally long ones that with the
longer host, and block before allow. Up to INLINE rules are expressions of the
plan; more of them are a table that is joined with each distinct URL's host
suffixes, so there is no bound on their number.

Edge cases: a null URL, or one without ://, has an empty host and path and is
judged by the regression's bias alone; repeated rows are judged alike; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
GRAM = 3
#: Rules that are put into the plan as expressions; more are joined.
INLINE = 200
#: A page goes where the odds are 3 to 2 against it: a wanted page lost costs more than an unwanted one kept.
THRESHOLD = 0.4

#: Labelled by hand: pages that a text corpus wants, and pages of pharmacy, betting, adult, scam and piracy sites (invented ones).
_WANTED = """
https://www.reuters.com/world/europe/ https://www.theguardian.com/science/2024/may/12/ocean-currents https://apnews.com/article/election-results
https://www.nature.com/articles/s41586-020-2649-2 https://arxiv.org/abs/1706.03762 https://www.science.org/doi/10.1126/science.1058040
https://docs.python.org/3/library/re.html https://developer.mozilla.org/en-US/docs/Web/HTML https://stackoverflow.com/questions/231767
https://www.gutenberg.org/ebooks/1342 https://archive.org/details/texts https://www.britannica.com/topic/history
https://fr.wikibooks.org/wiki/Accueil https://de.wikisource.org/wiki/Hauptseite https://es.wiktionary.org/wiki/palabra
https://www.lemonde.fr/planete/article/2023/04/02/climat.html https://www.zeit.de/kultur/2022-11/theater https://elpais.com/cultura/2021-03-05/libros.html
https://www.nasa.gov/missions/ https://www.who.int/news-room/fact-sheets https://www.nhs.uk/conditions/asthma/
https://www.loc.gov/collections/ https://www.bl.uk/catalogues https://www.metmuseum.org/art/collection
https://www.mit.edu/research/ https://www.ox.ac.uk/admissions https://www.uni-heidelberg.de/de/studium
https://www.cdc.gov/flu/about/index.html https://www.census.gov/data/tables.html https://europa.eu/european-union/index_en
https://www.allrecipes.com/recipe/10813/cookies/ https://www.bonappetit.com/recipe/lentil-soup https://www.seriouseats.com/bread-baking
https://www.gardenersworld.com/how-to/grow-plants/ https://www.rhs.org.uk/advice https://www.birdlife.org/news
https://www.lonelyplanet.com/italy/rome https://www.nationalgeographic.com/animals/mammals https://www.smithsonianmag.com/history/
https://medium.com/@writer/notes-on-testing https://blog.rust-lang.org/2024/02/08/release.html https://go.dev/doc/effective_go
https://www.postgresql.org/docs/current/sql.html https://spark.apache.org/docs/latest/ https://kubernetes.io/docs/concepts/
https://www.imdb.com/title/tt0111161/ https://www.goodreads.com/book/show/5107 https://www.poetryfoundation.org/poems/
https://www.economist.com/leaders/2020/06/11/ https://www.ft.com/content/markets https://hbr.org/2019/05/the-leaders
https://www.weather.gov/forecast https://www.metoffice.gov.uk/weather/learn-about https://earthquake.usgs.gov/earthquakes/map/
https://www.khanacademy.org/math/algebra https://www.coursera.org/learn/statistics https://openstax.org/details/books/biology
https://plato.stanford.edu/entries/kant/ https://iep.utm.edu/ethics/ https://mathworld.wolfram.com/Integral.html
https://www.mayoclinic.org/diseases-conditions/migraine https://medlineplus.gov/ency/article/000165.htm https://pubmed.ncbi.nlm.nih.gov/31978945/
https://www.cityofchicago.org/departments https://www.paris.fr/pages/transports https://www.berlin.de/kultur-und-tickets/
https://www.springer.com/journal/10994 https://www.jstor.org/stable/2331932 https://journals.plos.org/plosone/article
https://www.localnewspaper.net/2019/11/council-meeting https://www.villagechurch.org/sermons/2018 https://www.schooldistrict.org/parents/calendar
http://forum.woodworking.net/showthread.php http://www.astronomy-club.org/meetings.html https://www.riverhistory.net/mills/north.html
https://travelnotes.example.com/portugal/lisbon https://kitchen-diary.example.net/soups/leek https://www.museum-guide.example.org/rooms/12
"""
_UNWANTED = """
https://cheap-viagra-online.com/buy-now https://www.pills-without-prescription.net/order/cialis http://discount-pharmacy-meds.org/cheap/pills.html
https://buy-tramadol-overnight.com/checkout https://canadian-pharmacy-cheap.net/viagra http://generic-pills-shop.com/order-now
https://best-casino-bonus.com/free-spins https://www.online-slots-jackpot.net/play http://casino-royal-win.org/bonus/signup
https://free-bets-today.com/claim https://poker-bonus-cash.net/deposit-bonus https://www.bet-win-casino.com/slots/free
https://sexy-webcam-girls.com/live https://www.xxx-free-videos.net/watch/hot https://adult-dating-hookup.com/join-free
http://hot-cams-live.net/girls http://www.nude-pics-free.org/xxx https://porn-tube-clips.com/video/xxx
https://escort-girls-tonight.com/book https://adult-sex-chat.net/free-join https://xxx-adult-movies.org/porn
https://work-from-home-cash.com/earn-money-fast https://make-money-online-now.net/easy-cash http://free-iphone-winner.com/claim-prize
https://www.you-won-prize.net/claim/gift-card https://get-rich-quick-crypto.com/bonus https://double-your-bitcoin.net/deposit
https://payday-loans-instant.com/apply-now https://cheap-loans-no-credit.net/approved https://www.fast-cash-loans.org/apply
https://replica-watches-cheap.com/rolex https://www.fake-designer-bags.net/sale https://discount-luxury-replica.org/buy
https://free-movie-downloads.net/torrent/full-hd https://www.cracked-software-keygen.com/download https://warez-serial-keys.org/crack
http://download-free-mp3-now.com/torrent https://watch-movies-free-hd.net/stream https://keygen-crack-download.com/serial
https://seo-backlinks-cheap.com/buy-links https://www.link-farm-directory.net/add-url http://buy-followers-likes.com/cheap
https://spam-mailer-bulk.net/order https://free-traffic-clicks.com/signup https://www.article-spinner-links.org/seo
https://lose-weight-fast-pills.com/order https://miracle-diet-pills.net/free-trial https://www.fat-burner-cheap.org/buy-now
https://hot-singles-near-you.com/meet https://russian-brides-dating.net/join https://www.adult-friend-hookup.org/free
https://win-lottery-jackpot.com/claim https://lucky-winner-prizes.net/spin https://free-gift-cards-win.org/claim-now
http://casino-slots-free-bonus.net/spins http://bet-online-sports-win.com/odds/bonus https://www.gambling-jackpot-cash.org/play
https://viagra-cialis-cheap.net/pills https://www.hot-deals-replica.com/sale/cheap https://clickbait-free-money.com/now
https://earn-bitcoin-free.org/claim/bonus https://www.cheap-essays-buy.com/order-now https://hack-account-password.net/free-download
https://cams-adult-xxx.com/live/free https://bonus-codes-casino.net/free https://instant-cash-win.com/prize
https://www.sex-toys-discount.net/cheap https://pills-diet-buy.org/order https://porn-xxx-webcam.net/girls
https://torrent-crack-warez.com/download https://free-xxx-porn.org/tube https://loans-cash-approved.net/instant
https://followers-cheap-buy.net/order https://prize-claim-winner.org/free https://bets-casino-poker.com/free-bonus
"""
#: (url, blocked)
LABELLED: list[tuple[str, int]] = [(u, y) for urls, y in ((_WANTED, 0), (_UNWANTED, 1)) for u in urls.split()]


def bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % BUCKETS


def grams(url: str) -> list[int]:
    """Buckets of the n-grams of a URL's host and path."""
    host, slash, path = url.partition("://")[2].partition("?")[0].partition("#")[0].partition("/")
    s = host.lower() + slash + path
    return [bucket(s[i : i + GRAM]) for i in range(len(s) - GRAM + 1)]


@functools.cache
def train(labelled: tuple[tuple[str, int], ...] = tuple(LABELLED), rounds: int = 3000, rate: float = 20.0, decay: float = 3e-5) -> tuple[float, tuple[float, ...]]:
    """(bias, weights) by gradient descent on the mean log loss; the labelled table is small, so this runs on the driver."""
    x = np.zeros((len(labelled), BUCKETS))
    for k, (url, _) in enumerate(labelled):
        g = grams(url)
        for i in g:
            x[k, i] += 1 / len(g)
    used = np.flatnonzero(x.any(0))
    part, y = x[:, used], np.array([v for _, v in labelled], float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(part @ w + b))) - y) / len(y)
        w -= rate * (part.T @ g + decay * w)
        b -= rate / 20 * g.sum()
    out = np.zeros(BUCKETS)
    out[used] = np.round(w, 6)
    return round(float(b), 6), tuple(out.tolist())


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def logit(text: Column, bias: float, weights: tuple[float, ...]) -> Column:
    """The bias, and the mean weight of text's hashed n-grams."""
    w = F.lit(list(weights))

    def total(c: Column) -> Column:  # c is bound once: characters are not split again for each trigram
        gram = lambda i: F.concat(*[F.get(c, i + k) for k in range(GRAM)])
        one = lambda i: F.get(w, F.pmod(F.conv(F.substring(F.md5(gram(i)), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))
        mean = F.aggregate(F.sequence(F.lit(0), F.size(c) - GRAM), F.lit(0.0), lambda a, i: a + one(i)) / (F.size(c) - GRAM + 1)
        return F.lit(float(bias)) + F.when(F.size(c) >= GRAM, mean).otherwise(F.lit(0.0))

    return F.get(F.transform(F.array(F.split(text, "")), total), F.lit(0))


Rule = tuple[str, str, str]


def _first(rule: Rule) -> tuple:
    """Rules in the order in which they decide."""
    verdict, host, path = rule
    return -len(host + path), -len(host), verdict != "block"


def _inline(rules: list[Rule]) -> Column:
    fits = [F.when(((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=_first)]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rules(cut: DataFrame, rules: DataFrame) -> DataFrame:
    """cut (page_id, host, path) and the rule that decides, as struct<rule, verdict>; rules: a table (verdict, host, path) of any size."""
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    urls = cut.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("end"))
    r = rules.select(F.col("host").alias("end"), F.col("path").alias("rule_path"), "verdict")
    order = F.struct(F.length("end") + F.length("rule_path"), F.length("end"), F.col("verdict") == "block")
    best = urls.join(r, "end").filter(F.startswith("path", "rule_path")).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("end", "rule_path").alias("rule"), "verdict"), order).alias("fit"))
    return cut.join(best, ["host", "path"], "left").select("page_id", "host", "path", "fit")


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", labelled: tuple[tuple[str, int], ...] = tuple(LABELLED), threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, logit). rules: (verdict, host, path), as a list or a table of these columns."""
    host, path = host_path(F.col(url_col).cast("string"))
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and len(rules) > INLINE:
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    cut = cut.withColumn("fit", _inline(rules)) if isinstance(rules, list) else with_rules(cut, rules)
    bias, weights = train(labelled)
    judged = cut.select("*", logit(F.concat("host", "path"), bias, weights).alias("logit"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("logit") > threshold, "block").otherwise("allow")).alias("verdict"), "logit")


def oracle(rules: list[Rule]) -> str:
    """The same as DuckDB SQL over pages."""
    bias, weights = train()
    ordered = sorted(rules, key=_first)
    fit = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, h, p)}'" for v, h, p in ordered) + " END"
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    c AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    w AS (SELECT {list(weights)}::DOUBLE[] AS w),
    s AS (SELECT *, {bias} + coalesce(list_sum(list_transform(generate_series(1, length(host || path) - {GRAM - 1}), lambda i: w[1 + CAST(CAST('0x' || substr(md5(substr(host || path, i, {GRAM})), 1, 8) AS UBIGINT) % {BUCKETS} AS INTEGER)])) / (length(host || path) - {GRAM - 1}), 0) AS z FROM c, w)
    SELECT page_id, host, path, {fit(lambda v, h, p: h + p)} AS rule, coalesce({fit(lambda v, h, p: v)}, CASE WHEN z > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM s
    """
