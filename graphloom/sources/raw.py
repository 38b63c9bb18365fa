"""Raw responses and cards: bytes to text, card JSON to documents, page markup to documents."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from graphloom.functions import text as tx
from graphloom.sources import pages as pg

IMAGES = 12
FALLBACKS = ("utf-8", "gb18030")
RESPONSE = T.StructType([T.StructField("status", T.IntegerType()), T.StructField("charset", T.StringType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])
CARD = "errno int, key string, name string, desc string, abstract string, url string, link string, image string, pic string, card array<struct<key:string,name:string,value:array<string>>>"


def decode(raw: bytes, charset: str | None = None) -> str:
    """The text by the declared charset, else by the fallbacks, else as UTF-8 with replacement."""
    for name in ([charset] if charset else []) + list(FALLBACKS):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; what follows a broken length is dropped."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def response(raw: bytes | None) -> dict:
    """Status, charset and text of a raw HTTP response; a status from 400 on, or no response, is an error."""
    head, _, body = (raw or b"").partition(b"\r\n\r\n")
    first, *lines = head.decode("iso-8859-1").split("\r\n")
    status = int(first.split(" ")[1]) if first.count(" ") and first.split(" ")[1].isdigit() else 0
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if status >= 400 or not status:
        return {"status": status, "charset": None, "body": None, "error": f"status {status}"}
    try:
        body = unchunk(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body
        body = gzip.decompress(body) if "gzip" in headers.get("content-encoding", "").lower() else body
    except (OSError, EOFError, zlib.error) as e:
        return {"status": status, "charset": None, "body": None, "error": str(e)}
    charset = headers.get("content-type", "").lower().partition("charset=")[2].split(";")[0].strip(" \"'") or None
    return {"status": status, "charset": charset, "body": decode(body, charset), "error": None}


@pandas_udf(RESPONSE)
def parse_response(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([response(r) for r in raw], columns=RESPONSE.names)


def parse_card(card: Column) -> Column:
    """A card's document fields from its JSON text; null for an error card."""
    c = F.from_json(card, CARD)
    name = lambda e: tx.clean_text(F.coalesce(F.nullif(e["name"], F.lit("")), e["key"]))
    joined = lambda e: F.concat_ws("、", F.array_distinct(F.filter(F.transform(e["value"], lambda v: tx.clean_text(F.regexp_replace(v, "<[^>]*>", ""))), lambda v: v != "")))
    pairs = F.filter(F.transform(F.coalesce(c["card"], F.array()), lambda e: F.struct(name(e).alias("key"), joined(e).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    unique = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    document = F.struct(
        tx.clean_text(c["key"]).alias("title"),
        tx.clean_text(F.coalesce(F.nullif(c["abstract"], F.lit("")), c["desc"])).alias("summary"),
        unique.alias("basic_info"),
        F.coalesce(F.nullif(c["url"], F.lit("")), c["link"], F.lit("")).alias("source_url"),
        F.filter(F.array_distinct(F.transform(F.array(F.coalesce(F.nullif(c["image"], F.lit("")), c["pic"])), pg.absolute_url)), lambda i: i.isNotNull()).alias("images"),
        F.lit("card_api").alias("content_source"),
    )
    return F.when(F.coalesce(c["errno"], F.lit(0)) == 0, document)


def infobox(html: Column) -> Column:
    """Pairs of dt and dd texts in order, as far as both go; of equal names the last stays."""
    names = F.transform(F.regexp_extract_all(html, F.lit("(?is)<dt[^>]*>(.*?)</dt>"), F.lit(1)), lambda t: tx.strip(tx.clean_text(F.regexp_replace(t, "<[^>]*>", "")), ":： "))
    values = F.transform(F.regexp_extract_all(html, F.lit("(?is)<dd[^>]*>(.*?)</dd>"), F.lit(1)), lambda t: tx.clean_text(F.regexp_replace(t, "<[^>]*>", "")))
    pairs = F.slice(F.arrays_zip(names.alias("k"), values.alias("v")), F.lit(1), F.greatest(F.lit(0), F.least(F.size(names), F.size(values))))
    return F.aggregate(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")), F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))


def images(html: Column) -> Column:
    """The first distinct image addresses, absolute."""
    found = F.regexp_extract_all(html, F.lit("(?is)<img[^>]*?(?:data-src|src)=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, pg.absolute_url)), 1, IMAGES)


def html_or_card(html_doc: Column, card_doc: Column) -> Column:
    """The page's document, or the card's where there is none."""
    return F.coalesce(html_doc, card_doc)


def keywords(rows: DataFrame, column: str) -> DataFrame:
    """Trimmed keywords, blank ones left out."""
    return rows.select(F.trim(column).alias("keyword")).filter("keyword != ''")
