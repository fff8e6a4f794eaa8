"""Operator 3: URL filter by rules and, where no rule fits, a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldaudit.llm.html_extract import host_of

#: Lengths of the n-grams and buckets of the hash.
GRAMS, BUCKETS = (3, 4, 5), 1 << 18
#: The rules of the query: the verdict, then the host, a slash and how the path goes on.
RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]
# The labelled table, public hosts with a path. Blocked: gambling, adult, pharmacy, loan and piracy sites, advertising and link trade
BLOCKED = """
https://www.bet365.com/sports/live  https://www.betfair.com/exchange/plus  https://www.betway.com/en/casino  https://www.unibet.com/betting/sports  https://1xbet.com/en/live  https://www.betvictor.com/en-gb/sports
https://www.betsson.com/en/casino  https://www.bets10.com/tr/  https://www.sportsbet.com.au/betting  https://www.sportingbet.com/en/sports  https://freebets.com/offers  https://www.oddschecker.com/free-bets
https://www.888casino.com/promotions  https://www.casino.com/games  https://www.casino.org/bonuses  https://www.slotscasino.com/play  https://www.adultvideos.info/xxx  https://www.adultsonly.biz/chat
https://winner.casino/bonus  https://www.casinowinner.com/welcome  https://www.bigwincasino.net/spin  https://www.luckyspins-casino.biz/slots  https://www.slotomania.com/free-slots  https://www.jackpotcity.com/slots
https://www.pokerstars.com/poker/room  https://www.partypoker.com/download  https://www.ggpoker.com/tournaments  https://www.bulkspam.info/lists  https://www.spamkings.biz/bulk  https://www.adultcams.biz/live
https://www.pornhub.com/video  https://www.xvideos.com/tags  https://www.xnxx.com/search/top  https://xhamster.com/channels  https://www.redtube.com/top  https://www.youporn.com/browse  https://www.tube8.com/porn
https://www.xxx.com/  https://www.sex.com/pics  https://www.xadult.biz/videos  https://www.livesexcams.biz/girls  https://www.myfreecams.com/  https://www.camsoda.com/  https://www.adultfriendfinder.com/go/page
https://www.adulttime.com/en/videos  https://www.adultempire.com/dvd  https://www.adultwork.com/escorts  https://www.eros.com/escorts  https://www.escortdirectory.com/  https://www.porntube.com/  https://www.freeporn.com/hd
https://www.viagraonline.biz/order  https://www.buyviagra.co/cheap  https://www.cialisonline.biz/buy  https://www.cheapmeds.biz/pills  https://www.canadianpharmacy24.biz/order  https://www.pillsbuy.net/no-prescription
https://www.dietpillsreview.info/buy  https://www.cheaptramadolpills.com/  https://www.rxpharmacy-discount.biz/  https://www.bestpills.biz/sale  https://www.cheap-rx-meds.info/pills  https://www.paydayloansonline.biz/apply
https://www.quickpaydaycash.com/loans  https://www.instantcashloans.biz/now  https://www.replicawatches.co/rolex  https://www.cheapreplicabags.biz/  https://www.torrentwarez.biz/top  https://www.crackedwarez.biz/keygen
https://www.warez-bb.org/index  https://www.keygens.biz/crack  https://ad.doubleclick.net/click  https://pagead2.googlesyndication.com/pagead/ads  https://www.googleadservices.com/pagead/aclk  https://ads.yahoo.com/clk
https://ib.adnxs.com/ttj  https://adserver.adtech.de/adlink  https://ads.pubmatic.com/AdServer/js  https://www.adcash.com/script  https://adfly.biz/ad  https://www.popads.net/pop.js  https://ads.trafficjunky.net/ads
https://track.adform.net/adfserve  https://tracking.admob.biz/click  https://adtrack.mobi/click  https://adtracker.biz/track/click  https://trk.clicktracker.biz/ads  https://www.propellerads.com/click  https://adsterra.biz/track
https://www.buybacklinks.biz/links  https://www.linkfarm.biz/spam  https://www.seolinkfarm.info/buy-links  https://www.spamlinks.biz/list  https://www.spambot.biz/farm  https://www.clickfarm.biz/likes
""".split()
# Allowed: press, science, education, government, reference, software, culture, shops; and everyday pages of unknown small hosts
ALLOWED = """
https://www.bbc.co.uk/news/world  https://www.nytimes.com/2021/05/12/science  https://www.theguardian.com/uk/culture  https://www.reuters.com/world/europe  https://apnews.com/hub/science  https://www.lemonde.fr/culture
https://www.spiegel.de/wissenschaft  https://elpais.com/ciencia  https://www.dw.com/en/top-stories  https://www.npr.org/sections/health  https://www.economist.com/finance  https://www.aljazeera.com/features
https://en.wikipedia.org/wiki/History  https://de.wikipedia.org/wiki/Physik  https://fr.wikipedia.org/wiki/Chimie  https://www.wiktionary.org/  https://www.britannica.com/topic/music  https://www.gutenberg.org/ebooks/84
https://archive.org/details/texts  https://www.loc.gov/collections  https://www.bl.uk/learning  https://www.nature.com/articles/s41586  https://www.science.org/journal/science  https://arxiv.org/abs/1706.03762
https://www.nasa.gov/missions  https://www.esa.int/Science  https://www.cern.ch/about  https://www.nih.gov/health-information  https://www.who.int/news-room  https://www.cdc.gov/flu/about  https://www.metoffice.gov.uk/weather
https://www.gov.uk/browse/education  https://www.essex.gov.uk/council  https://www.kent.gov.uk/libraries  https://www.europa.eu/policies  https://www.bundestag.de/parlament  https://www.senate.gov/legislative  https://www.usa.gov/benefits
https://www.mit.edu/research  https://www.harvard.edu/schools  https://www.ox.ac.uk/admissions  https://www.sussex.ac.uk/study  https://www.ethz.ch/en/studies  https://www.stanford.edu/courses  https://www.middlesex.edu/library
https://www.loansforstudents.edu/aid  https://www.sorbonne-universite.fr/en  https://docs.python.org/3/library  https://spark.apache.org/docs/latest  https://developer.mozilla.org/en-US/docs  https://stackoverflow.com/questions
https://github.com/apache/spark  https://www.kernel.org/doc/html  https://www.postgresql.org/docs/16  https://www.w3.org/TR/html5  https://www.debian.org/distrib  https://pypi.org/project/numpy  https://www.gnu.org/software
https://www.amazon.com/books  https://www.ikea.com/gb/en  https://www.etsy.com/market  https://www.ebay.de/b/buecher  https://www.imdb.com/title  https://www.metmuseum.org/art  https://www.louvre.fr/en  https://www.tate.org.uk/art
https://www.allrecipes.com/recipe/bread  https://www.bonappetit.com/recipes  https://www.nationalgeographic.com/animals  https://www.rspb.org.uk/birds  https://www.nhs.uk/conditions  https://www.mayoclinic.org/diseases
https://www.fifa.com/fixtures  https://www.olympics.com/en/sports  https://www.cricketworld.com/scores  https://www.runnersworld.com/training  https://www.lonelyplanet.com/italy  https://www.bahn.de/reiseauskunft
https://www.nationalrail.co.uk/stations  https://www.openstreetmap.org/about  https://www.weather.com/today  https://www.duolingo.com/learn  https://www.khanacademy.org/math  https://www.coursera.org/learn  https://www.ted.com/talks
https://www.goodreads.com/book/show  https://www.poetryfoundation.org/poems  https://www.spamhaus.org/faq  https://www.addthis.org/about  https://www.adobe.com/products  https://www.radiofrance.fr/  https://www.trackandfield.org/results
https://www.winchester.gov.uk/museum  https://www.freecodecamp.org/news  https://www.freesound.org/people  https://www.betterplace.org/en  https://www.alphabet-school.org/en/25  https://www.therese-garden.org/fr/11
http://blog.tonline.net/en/412  http://www.hearthstone-inn.org/de/37  https://m.theatre-lyon.net/fr/508.html  http://www.thornton-parish.org/en/77  https://www.eastend-bakery.net/es/241/  http://northern-trails.org/en/903
https://www.anderson-notes.org/en/66.html  http://m.rhine-walks.net/de/815  https://blog.santander-libros.org/es/19  http://www.thistle-house.net/en/380
""".split()


#: Ends of hosts and paths that are found on any kind of site.
ENDS = ("com", "net", "org", "co.uk", "de")
PLAIN_PATHS = ("", "en/12", "de/345", "index.html", "fr/67.html", "es/8/", "about", "page/3", "en/2024/05/", "it/90", "contact", "de/1.html", "2023/11/post", "en/754/", "fr/3")


def labelled_urls() -> list[tuple[str, float, str]]:
    """(url, 1 for block or 0 for allow, host): the table, and each of its hosts under other ends, with and without www and with plain paths.

    So neither an end nor www tells anything, and nor do paths of everyday shape, of which allowed hosts have more: where nothing is known
    of a host it is allowed. A url without host and path is allowed.
    """
    out = [("no-scheme", 0.0, "")]
    for table, y in ((BLOCKED, 1.0), (ALLOWED, 0.0)):
        for i, url in enumerate(table):
            host, path = url.split("://", 1)[1].split("/", 1)
            name = host.removeprefix("www.").rsplit(".", 1)[0]
            for k, end in enumerate(ENDS):
                out.append((f"https://{'www.' if (i + k) % 2 else ''}{name}.{end}/{path}", y, host))
                for plain in PLAIN_PATHS[(i + k) % 3 : len(PLAIN_PATHS) - (2 if y else 0) : 3]:
                    out.append((f"https://{name}.{end}/{plain}", y, host))
    return out


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; null or no ://: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url.substr(F.instr(url, "://") + 3, F.length(url)), r"^[^/?#]*(/[^?#]*)", 1)).otherwise(F.lit(""))
    return F.coalesce(rest, F.lit(""))


def by_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule whose host is this one or a domain above it and whose path begins this one; null if none. rules: a short list."""
    out = F.lit(None).cast("string")
    for rule in sorted({r.split(" ", 1)[1] for r in rules}, key=lambda r: (len(r), r)):
        name, rest = rule.split("/", 1)
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), F.lit(rule)).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each with a mark of its side; between ^ and $, so that short ones have some too."""

    def cuts(side: str, s: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.concat(F.lit(side), F.substring(s, i, F.lit(n))))
        return F.when(F.length(s) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(*(cuts(side, F.concat(F.lit("^"), s, F.lit("$")), n) for side, s in (("h", host), ("p", path)) for n in GRAMS))


def train(spark: SparkSession, labelled: list[tuple[str, float]] | None = None) -> LogisticRegressionModel:
    """A regression fitted to a small table of (url, 1 for block or 0 for allow), by default labelled_urls()."""
    labelled = [(url, y) for url, y, _ in labelled_urls()] if labelled is None else labelled
    rows = spark.createDataFrame(labelled, "url string, label double").coalesce(1)
    rows = rows.select("label", grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
    rows = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(rows)
    return LogisticRegression(maxIter=30, regParam=0.002, standardization=False).fit(rows)


def judge(pages: DataFrame, rules: list[str], model: LogisticRegressionModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row, alone: one pass over the url column, no shuffle.

    A null url or one without :// has an empty host and path and is judged on those. Repeated rows give equal verdicts, a url of any length
    is judged whole, an empty table gives no rows, and extra columns aren't read.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"rule": by_rule(F.col("host"), F.col("path"), rules), "grams": grams(F.col("host"), F.col("path"))})
    rows = model.transform(HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(rows))
    rows = rows.withColumn("p_block", F.get(vector_to_array("probability"), F.lit(1)))
    told = F.create_map(*(F.lit(x) for r in rules for x in reversed(r.split(" ", 1)))) if rules else F.create_map().cast("map<string,string>")
    verdict = F.coalesce(F.element_at(told, F.col("rule")), F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, train(spark))
