"""Network sources as Python data sources: paged JSON listings, and quotes with symbol fallback.

A source reads one listing or symbol in each partition, so listings are fetched side by side and pages of one follow each other.
Requests are repeated with growing waits; a listing that is forbidden ends at once. ``file:`` addresses work like any others, so
payloads that were stored can be read back by the same code.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Seconds to wait after "too many requests" and after other failures, times the attempt; rows of a page.
LIMITED, FAILED, PAGE = 15.0, 2.0, 100
#: Characters of payloads that a task holds before it hands them on.
HELD = 4 << 20
#: Endings of a symbol and those tried after it, in order.
ENDINGS = {".NS": (".NSE", ".BO", ".BSE"), ".NSE": (".NS", ".BO", ".BSE"), ".BO": (".BSE", ".NS", ".NSE"), ".BSE": (".BO", ".NS", ".NSE")}


def fetch(url: str) -> tuple[int, str]:
    """(status, body) of an address. Stored payloads are opened as files."""
    if url.startswith("file:///"):
        with open(urllib.request.url2pathname(url[len("file://") :]), encoding="utf-8", newline="") as f:
            return 200, f.read()
    try:
        with urllib.request.urlopen(url, timeout=10) as r:
            return getattr(r, "status", None) or 200, r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, ""


def patient(get: Callable[[str], tuple[int, str]], url: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The body, after up to ``tries`` requests; None if it is forbidden or never comes."""
    for attempt in range(1, tries + 1):
        try:
            status, body = get(url)
        except OSError:
            status, body = 0, ""
        if status == 200:
            return body
        if status == 403:
            return None
        if attempt < tries:
            sleep((LIMITED if status == 429 else FAILED) * attempt)
    return None


def pages(get: Callable[[str], tuple[int, str]], template: str, listing: str, limit: int, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """The pages of a listing, each naming the next one, until ``limit`` items were seen or no page follows."""
    seen, after = 0, ""
    while seen < limit:
        url = template.format(listing=urllib.parse.quote(listing), after=urllib.parse.quote(after), limit=min(PAGE, limit - seen))
        body = patient(get, url, sleep=sleep)
        data = json.loads(body)["data"] if body else {}
        if not data.get("children"):
            return
        yield body
        seen += len(data["children"])
        after = data.get("after") or ""
        if not after:
            return


def candidates(symbol: str) -> list[str]:
    """The symbol, then the same share's symbols at other exchanges."""
    symbol = symbol.strip().upper()
    end = next((e for e in ENDINGS if symbol.endswith(e)), None)
    return [symbol] if end is None else [symbol, *[symbol.replace(end, e) for e in ENDINGS[end]]]


def first_quote(get: Callable[[str], tuple[int, str]], template: str, symbol: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str] | None:
    """(symbol that answered, payload) of the first candidate with any rows."""
    for s in candidates(symbol):
        body = patient(get, template.format(symbol=urllib.parse.quote(s)), sleep=sleep)
        if body and json.loads(body).get("timestamp"):
            return s, body
    return None


def fetch_each(rows: DataFrame, template: str, tries: int = 3) -> DataFrame:
    """``rows`` and the body of each one's own address (``template`` with its columns in braces) as ``value``; rows without an
    answer go. Requests are made where the rows are, one after the other in a task."""
    schema = StructType([*rows.schema.fields, StructField("value", StringType())])

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            urls = [template.format(**{k: urllib.parse.quote(str(x)) for k, x in r.items()}) for r in b.to_dict("records")]
            yield b.assign(value=[patient(fetch, u, tries) for u in urls]).dropna(subset=["value"])

    return rows.mapInPandas(get, schema)


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows that end with a payload as batches of about ``most`` characters: Spark would hold ten thousand payloads at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PAGES = pa.schema([("listing", pa.string()), ("page", pa.int32()), ("value", pa.string())])
_QUOTES = pa.schema([("ticker", pa.string()), ("symbol", pa.string()), ("value", pa.string())])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str):
        self.options, self.kind = options, kind

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in json.loads(self.options["of"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return batches(self._rows(partition.value), _PAGES if self.kind == "listing" else _QUOTES)

    def _rows(self, one: str) -> Iterator[tuple]:
        if self.kind == "listing":
            for n, body in enumerate(pages(fetch, self.options["url"], one, int(self.options.get("limit", "100")))):
                yield one, n, body
        else:
            got = first_quote(fetch, self.options["url"], one)
            if got:
                yield one, *got


def place_of(item: dict) -> str:
    """What items of a listing are ordered by: their second, then their id."""
    data = item.get("data") or {}
    return f"{round(float(data.get('created_utc') or 0) * 1000):015d}|{data.get('id') or ''}"


class _Polls(DataSourceStreamReader):
    """Offsets are the newest item of every listing; a batch has the items after its start up to its end, so a batch that is run
    again has the same items, and none comes twice.

    A listing whose first page does not come stays where it is; before anything is known of it that is an error, as no offset
    would be right."""

    def __init__(self, options: dict[str, str], get: Callable[[str], tuple[int, str]] = fetch):
        self.url, self.of, self.get = options["url"], json.loads(options["of"]), get
        self.limit, self.tries = int(options.get("limit", "1000000000")), int(options.get("tries", "3"))
        self.known: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {x: "" for x in self.of}

    def latestOffset(self) -> dict:
        for x in self.of:
            url = self.url.format(listing=urllib.parse.quote(x), after="", limit=PAGE)
            body = patient(self.get, url, self.tries)
            if body is not None:
                self.known[x] = max([self.known.get(x, ""), *map(place_of, json.loads(body)["data"].get("children") or [])])
            elif x not in self.known:
                raise OSError(f"no page of {x}")
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for x, at in start.items():
            self.known[x] = max(at, self.known.get(x, ""))
        return [InputPartition((x, start.get(x, ""), at)) for x, at in end.items() if at > start.get(x, "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Pages from the newest item on, with the batch's items only, until a page is older than the start."""
        listing, start, end = partition.value
        for n, body in enumerate(pages(self.get, self.url, listing, self.limit)):
            page = json.loads(body)
            places = [(place_of(x), x) for x in page["data"]["children"]]
            own = [x for at, x in places if start < at <= end]
            if own:
                page["data"]["children"] = own
                yield listing, n, body if len(own) == len(places) else json.dumps(page)
            if all(at <= start for at, _ in places):
                return

    def commit(self, end: dict) -> None:
        pass


class _BatchedPolls(_Polls):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return batches(super().read(partition), _PAGES)


class PagedListing(DataSource):
    """``of``: a JSON list of listings; ``url``: an address with {listing}, {after}, {limit}; ``limit``: items of each listing. As a
    stream it polls listings that have their newest items first."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "listing string, page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), "listing")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _BatchedPolls(dict(self.options))


class Quotes(DataSource):
    """``of``: a JSON list of symbols; ``url``: an address with {symbol}. The ticker stays the symbol that was asked for."""

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return "ticker string, symbol string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), "quotes")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedListing)
    spark.dataSource.register(Quotes)
