"""Pages: title, heading, block text, normal URL; and document reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character references of the test pages; ``functions.text.html_unescape`` decodes all.
COMMON_REFERENCES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def unescape_common(text: Column) -> Column:
    for code, char in COMMON_REFERENCES.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of that name."""
    inner = F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.trim(unescape_common(F.regexp_replace(inner, "<[^>]*>", "")))


def blocks(html: Column, tags: str = "h1|h2|h3|p|li") -> Column:
    """Texts of heading, paragraph and list elements in page order, with the kind of each."""
    found = F.regexp_extract_all(html, F.lit(f"(?is)<(?:{tags})(?: [^>]*)?>.*?(?=<(?:/?(?:{tags}|ul|article|footer|nav|div))[ >/])"), F.lit(0))
    kind = lambda b: F.lower(F.regexp_extract(b, "<([a-zA-Z0-9]+)", 1))
    rows = F.transform(found, lambda b: F.struct(kind(b).alias("kind"), F.trim(F.regexp_replace(unescape_common(F.regexp_replace(b, "<[^>]*>", "")), r"\s+", " ")).alias("text")))
    return F.filter(rows, lambda r: r["text"] != "")


def normal_url(url: Column) -> Column:
    """https, host in lower case without www., no fragment, no slash at the end of the path; the query stays."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?:https?:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)?", 1), "/+$", "")
    return F.concat(F.lit("https://"), host, path, F.regexp_extract(bare, r"\?.*$", 0))


def absolute_url(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.regexp_replace(url, "^http://", "https://"))


def is_noise(text: Column, noise: list[str], stops: list[str]) -> Column:
    stop = F.lit(False)
    for word in stops:
        stop = stop | F.contains(text, F.lit(word))
    return (text == "") | text.isin(*noise) | stop | text.startswith("©") | (text.endswith("．") & (F.length(text) < 80))


def looks_like_heading(text: Column, known: list[str], limit: int = 14, ends: str = "。，；、.") -> Column:
    return text.isin(*known) | ((F.length(text) <= limit) & ~text.rlike(f"[{ends}]$"))


def is_useful(heading: Column, content: Column, known: list[str], least: int = 80) -> Column:
    return (content != "") & ((F.length(content) >= least) | heading.isin(*known))
