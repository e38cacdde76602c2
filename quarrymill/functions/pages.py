"""Readable text of vendor pages, and how much of a site is read."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = {"script", "style", "iframe"}
NAVIGATION = {"nav", "footer", "header", "aside"}


class _Text(HTMLParser):
    def __init__(self, dropped: set[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.open, self.parts, self.mails = dropped, [], [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        href = (given.get("href") or "").strip() if tag == "a" else ""
        if href.lower().startswith("mailto:") and href[7:].split("?")[0]:
            self.mails.append(href[7:].split("?")[0])
        if given.get("data-email"):
            self.mails.append(given["data-email"].strip())
        if tag in self.dropped:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:  # what was left open inside ends with it
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.open:
            self.parts.append(data.strip())


def page_text(html: str | None, navigation: bool = False, mails: bool = False, least: int = 0) -> str | None:
    """Text without dropped elements, in single spaces; null if it is short or does not look like text."""
    if not html:
        return None
    parser = _Text(DROPPED if navigation else DROPPED | NAVIGATION)
    parser.feed(html)
    parser.close()
    text = " ".join(" ".join(parser.parts + (parser.mails if mails else [])).split())
    n = max(len(text), 1)
    printable = sum(map(str.isprintable, text)) - text.count(" ")
    good = printable / n >= 0.5 and text.count("�") / n <= 0.05 and len(text) > least
    return text if good else None


def readable(navigation: bool = False, mails: bool = False, least: int = 0):
    """A function from html to text with these options. It gets pages in lots of a hundred: an Arrow batch would hold ten thousand of them, whatever their
    size, in every Python worker."""
    return F.udf(lambda html: page_text(html, navigation, mails, least), "string", useArrow=False)


def site_text(pages: Column, most: int = 3000, after_first: int = 1000, after_second: int = 1500) -> Column:
    """Text of a site from its pages (structs of tier, ord, text, status): tier by tier in order, a tier only while
    what the earlier ones gave is short, until there is enough; a page that is forbidden ends it."""
    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("tier"), F.lit(0).alias("before"), F.lit(False).alias("stop"))

    def add(acc: Column, p: Column) -> Column:
        new_tier = p["tier"] != acc["tier"]
        before = F.when(new_tier, F.length(acc["text"]) - acc["n"]).otherwise(acc["before"])  # lengths without the separators
        short = F.when(p["tier"] == 2, before < after_first).when(p["tier"] == 3, before < after_second).otherwise(True)
        forbidden = p["status"] == 403
        piece = F.left(F.coalesce(p["text"], F.lit("")), F.lit(most))
        use = ~acc["stop"] & short & ~forbidden & (piece != "")
        text = F.when(use, F.concat(acc["text"], F.when(acc["text"] != "", "\n\n").otherwise(""), piece)).otherwise(acc["text"])
        gaps = F.when(use & (acc["text"] != ""), acc["n"] + 2).otherwise(acc["n"])
        stop = acc["stop"] | (short & forbidden) | (F.length(text) - gaps >= most)
        return F.struct(text.alias("text"), gaps.alias("n"), p["tier"].alias("tier"), before.alias("before"), stop.alias("stop"))

    return F.nullif(F.aggregate(F.array_sort(pages), none, add)["text"], F.lit(""))
