"""Sources on the network, behind a replaceable fetcher: encyclopedia, news feeds, papers.

A fetcher is a picklable callable (url, params) -> text or bytes; the default asks the network from the executors,
with a pause between requests of a partition. Failures are rows with an error. With an `AnswerCache`, searches are kept by
query and limit, pages and papers by their id or address, and are not asked for again.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkloom.cache import AnswerCache
from silkloom.functions.text import html_text, strip_search_tags

Fetch = Callable[[str, dict], "str | bytes"]
DOCUMENT = "paper_id string, title string, text string, source string"


def fetch(url: str, params: dict, timeout: float = 30.0) -> bytes:
    if params:
        url = f"{url}?{urllib.parse.urlencode(params)}"
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def _asked(requests: DataFrame, key: str, call: Callable[[str], object], schema: str, pause: float, cache: AnswerCache | None = None, kind: str = "") -> DataFrame:
    """For each key, the JSON of call(key) or an error. With a cache only the keys are asked that it does not hold under this
    kind of request, and their answers are kept, so that a fetch which broke off goes on where it stopped."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, k in enumerate(pdf[key]):
                if i and pause:
                    time.sleep(pause)
                try:
                    out.append((k, json.dumps(call(k), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001  a failed request is a row
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    chosen = requests.select(F.col(key).cast("string").alias(key))
    if cache is None:
        told = chosen.mapInPandas(run, f"{key} string, answer string, error string")
        return told.select(key, F.from_json("answer", schema).alias("a"), "error")

    def ask(rows: DataFrame) -> DataFrame:
        told = rows.select(key).mapInPandas(run, f"{key} string, answer string, error string")
        return told.select(_request(kind, F.col(key)).alias("key"), F.col("answer").alias("value"), "error")

    told = cache.through(chosen, ask, _request(kind, F.col(key)))
    return told.select(key, F.from_json("value", schema).alias("a"), "error")


def _request(kind: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), F.coalesce(key, F.lit("")))


class WikipediaSource:
    """Search and text of an encyclopedia through the MediaWiki API."""

    def __init__(self, language: str = "th", get: Fetch = fetch, pause: float = 1.0, cache: AnswerCache | None = None):
        self.url, self.language, self.get, self.pause, self.cache = f"https://{language}.wikipedia.org/w/api.php", language, get, pause, cache

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """query, page_id, title, snippet (without its tags), error."""
        url, get = self.url, self.get

        def call(q: str) -> object:
            return json.loads(get(url, {"action": "query", "list": "search", "srsearch": q, "srlimit": limit, "format": "json"}))

        found = _asked(queries, "query", call, "query struct<search:array<struct<pageid:bigint,title:string,snippet:string>>>", self.pause, self.cache, f"{self.url}|search|{limit}")
        rows = found.select("query", "error", F.explode_outer("a.query.search").alias("r"))
        return rows.select("query", F.col("r.pageid").alias("page_id"), "r.title", strip_search_tags("r.snippet").alias("snippet"), "error")

    def content(self, pages: DataFrame) -> DataFrame:
        """page_id, text, error."""
        url, get = self.url, self.get

        def call(page: str) -> object:
            return json.loads(get(url, {"action": "query", "prop": "extracts", "explaintext": 1, "pageids": page, "format": "json"}))

        found = _asked(pages, "page_id", call, "query struct<pages:map<string,struct<extract:string>>>", self.pause, self.cache, f"{self.url}|page")
        return found.select("page_id", F.get(F.map_values("a.query.pages"), 0)["extract"].alias("text"), "error")

    def documents(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        pages = self.search(queries, limit).where("page_id is not null").select(F.col("page_id").cast("string").alias("page_id"), "title").dropDuplicates(["page_id"])
        read = self.content(pages).where("text <> ''")
        return pages.join(read, "page_id").select(F.concat(F.lit("wiki_"), "page_id").alias("paper_id"), "title", "text", F.lit(f"wikipedia_{self.language}").alias("source"))


def filter_entries(entries: DataFrame, query: str, limit: int = 10, feed: str | None = None) -> DataFrame:
    """entries (feed, pos, title, description, link, published): of each feed's first `limit` entries those whose title
    or description holds the query in any case; `limit` in all, by feed and position."""
    needle = F.lit(query.lower())
    rows = entries if feed is None else entries.where(F.col("feed") == feed)
    hit = F.contains(F.lower("title"), needle) | F.contains(F.lower("description"), needle)
    return rows.where(F.col("pos") < limit).where(hit).orderBy("feed", "pos").limit(limit)


def news_id(link: Column) -> Column:
    return F.concat(F.lit("news_"), F.md5(link))


class NewsSource:
    """News from RSS feeds: name -> address."""

    def __init__(self, feeds: dict[str, str], get: Fetch = fetch, pause: float = 0.0, cache: AnswerCache | None = None):
        self.feeds, self.get, self.pause, self.cache = dict(feeds), get, pause, cache

    def entries(self, spark: SparkSession) -> DataFrame:
        feeds, get = self.feeds, self.get

        def call(name: str) -> object:
            body = get(feeds[name], {})
            items = ElementTree.fromstring(body).iter("item")
            text = lambda item, tag: (item.findtext(tag) or "").strip()
            return [{"pos": i, **{t: text(x, t) for t in ("title", "description", "link", "pubDate")}} for i, x in enumerate(items)]

        names = spark.createDataFrame([(n,) for n in feeds], "feed string")
        found = _asked(names, "feed", call, "array<struct<pos:int,title:string,description:string,link:string,pubDate:string>>", self.pause)
        return found.select("feed", F.explode("a").alias("e")).select("feed", "e.pos", "e.title", "e.description", "e.link", F.col("e.pubDate").alias("published"))

    def search(self, spark: SparkSession, query: str, limit: int = 10, feed: str | None = None) -> DataFrame:
        return filter_entries(self.entries(spark), query, limit, feed)

    def documents(self, spark: SparkSession, query: str, limit: int = 10) -> DataFrame:
        get = self.get

        def call(link: str) -> object:
            body = get(link, {})
            return {"html": body.decode("utf-8", "replace") if isinstance(body, bytes) else body}

        hits = self.search(spark, query, limit)
        read = _asked(hits.select("link").distinct(), "link", call, "html string", self.pause, self.cache, "news").where("error is null")
        joined = hits.join(read.select("link", html_text("a.html").alias("text")), "link").where("text <> ''")
        return joined.select(news_id(F.col("link")).alias("paper_id"), "title", "text", F.concat_ws("_", "feed", "published").alias("source"))


#: Corpora that a user may register a reader for; none is bundled.
CORPORA = {"tnc": "Thai National Corpus", "orchid": "ORCHID Corpus", "best": "BEST Corpus"}


class ArxivSource:
    """Papers through the arXiv API: metadata, and the text of their PDFs through a parser."""

    SCHEMA = "array<struct<title:string,authors:array<string>,summary:string,pdf_url:string,published:string,paper_id:string>>"

    def __init__(self, get: Fetch = fetch, pause: float = 3.0, cache: AnswerCache | None = None):
        self.url, self.get, self.pause, self.cache = "http://export.arxiv.org/api/query", get, pause, cache

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        url, get = self.url, self.get

        def call(q: str) -> object:
            a = "{http://www.w3.org/2005/Atom}"
            root = ElementTree.fromstring(get(url, {"search_query": q, "max_results": limit, "sortBy": "relevance"}))
            rows = []
            for e in root.iter(f"{a}entry"):
                name = (e.findtext(f"{a}id") or "").rsplit("/", 1)[-1]
                pdf = next((x.get("href") for x in e.iter(f"{a}link") if x.get("title") == "pdf"), None)
                rows.append({"title": re.sub(r"\s+", " ", e.findtext(f"{a}title") or ""), "authors": [x.findtext(f"{a}name") for x in e.iter(f"{a}author")], "summary": e.findtext(f"{a}summary"), "pdf_url": pdf, "published": e.findtext(f"{a}published"), "paper_id": name})
            return rows

        found = _asked(queries, "query", call, self.SCHEMA, self.pause, self.cache, f"{self.url}|{limit}")
        return found.select("query", F.explode("a").alias("p"), "error").select("query", "p.*", "error").withColumn("published", F.col("published").try_cast("timestamp"))

    def documents(self, queries: DataFrame, parse: Callable[[bytes], str], limit: int = 10) -> DataFrame:
        """Metadata with text; a PDF that cannot be fetched or read has an empty text. One that could not be fetched is not kept."""
        get = self.get

        def call(link: str) -> object:
            data = get(link, {})
            try:
                return {"text": parse(data)}
            except Exception:  # noqa: BLE001  no text is the defined result
                return {"text": ""}

        papers = self.search(queries, limit).where("pdf_url is not null").drop("error")
        read = _asked(papers.select("pdf_url").distinct(), "pdf_url", call, "text string", self.pause, self.cache, "paper")
        return papers.join(read.select("pdf_url", F.coalesce("a.text", F.lit("")).alias("text")), "pdf_url", "left")
