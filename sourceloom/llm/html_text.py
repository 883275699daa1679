"""HTML extraction with removal of site templates.

Every page is parsed once to hash its element subtrees (tag, class and text, bottom up).
Spark counts on how many pages of a host with different contents each subtree stands (copies
of a page count once); those on many are the site's template. A second parse deletes them, with what markup itself declares not to be
main text, and joins what is left. Text under ``article`` is never taken for a template,
however often it recurs, because articles are copied and quoted.

Templates are broadcast by host while they are few (in all and for each host, checked). Else
every page's subtrees meet the templates by host and hash, and a page gets those it has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.shared import kept
from sourceloom.llm.urls import host_and_path

MANY_PAGES = 5
BROADCAST_HASHES, HOST_HASHES = 500_000, 1_000

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element names of HTML by how they are parsed.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ENDS_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
NOT_TEXT = set("head nav footer aside form noscript template svg math button select dialog menu object video audio canvas".split())
MAIN = {"article", "main"}
WHOLE = {"html", "body", *MAIN}
# Class names and ids that declare boilerplate.
DECLARED = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices "
    "newsletter subscribe signup popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments "
    "disqus share sharing social related footer header masthead hidden".split()
)
HEADERS = {"header", "masthead"}
# How an element was declared not to be main text.
NO, BY_NAME, FIRMLY = 0, 1, 2
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class Element:
    __slots__ = ("tag", "mark", "dropped", "main", "article", "holds", "begin", "parts")

    def __init__(self, tag: str, mark: str, dropped: int, main: bool, article: bool, begin: int):
        self.tag, self.mark, self.dropped, self.main, self.article, self.begin = tag, mark, dropped, main, article, begin
        self.holds = False  # an article, which its hash does not cover
        self.parts: list[bytes] = []  # hashes of what is inside, in order


def declared(tag: str, attributes: str, in_main: bool) -> tuple[str, int]:
    """The class of an element, and whether its markup says that it is not main text.

    Class names and ids count whole; outside main text an id's last word does, too, unless it
    says what the element only has (``reader-comments``, but not ``page-with-sidebar``).
    """
    if tag in NOT_TEXT or (tag == "header" and not in_main):
        return "", FIRMLY
    if not attributes or attributes.isspace():
        return "", NO
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    mark = found.get("class", "")
    if tag in WHOLE:
        return mark, NO
    if found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return mark, FIRMLY
    names = {*mark.split(), found.get("id", "")}
    if in_main:
        names -= HEADERS
    else:
        words = re.findall("[a-z]+", found.get("id", ""))
        if not {"has", "no", "with", "without"} & set(words):
            names.update(words[-1:])
    if not names & DECLARED:
        return mark, NO
    return mark, FIRMLY if in_main else BY_NAME


class Page:
    """Parses one page. With ``template`` (hashes), ``out`` is the text; without, ``hashes``
    are the subtrees that could be a template."""

    def __init__(self, source: str, template: frozenset[int] | None = None):
        self.source, self.template = source, template
        self.hashes: set[int] = set()
        self.out: list[str] = []
        self.stack = [Element("", "", NO, False, False, 0)]
        self.parse()
        while len(self.stack) > 1:
            self.close()

    @property
    def text(self) -> str:
        return " ".join("".join(self.out).split())

    def close(self) -> None:
        element = self.stack.pop()
        if element.tag not in INLINE:
            self.out.append(" ")
        if element.article or element.holds:
            self.stack[-1].holds = True
        if element.parts and not element.article:
            digest = xxhash.xxh64(f"{element.tag} {element.mark}\0".encode() + b"".join(element.parts))
            self.stack[-1].parts.append(digest.digest())
            if element.tag not in WHOLE and not element.holds and not element.dropped:
                number = digest.intdigest() - (1 << 63)
                if self.template is None:
                    self.hashes.add(number)
                elif number in self.template:
                    del self.out[element.begin :]
                    self.out.append(" ")

    def close_to(self, tags: set[str], scope: set[str]) -> None:
        """Close up to the innermost open element of ``tags``, not beyond one of ``scope``."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    self.close()
                return
            if tag in scope:
                return

    def say(self, text: str) -> None:
        top = self.stack[-1]
        if "&" in text:
            text = html.unescape(text)
        if not top.article and (words := text.split()):
            top.parts.append(xxhash.xxh64(" ".join(words).encode("utf-8", "replace")).digest())
        if not top.dropped:
            self.out.append(text)

    def open(self, tag: str, attributes: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self.close_to({"p"}, {"article", "main", "div", "section", "td", "th", "li", "body", "button", "table"})
        if tag in ENDS_LIKE:
            self.close_to(*ENDS_LIKE[tag])
        if tag not in INLINE or tag == "wbr":
            self.out.append("" if tag == "wbr" else " ")
        if tag in VOID:
            return
        top = self.stack[-1]
        mark, dropped = declared(tag, attributes, top.main)
        main = (top.main or tag in MAIN) and not dropped
        article = (top.article or tag == "article") and not dropped
        dropped = max(dropped, top.dropped)
        if tag in MAIN and dropped == BY_NAME and DECLARED.isdisjoint(mark.split()):
            dropped = NO  # a wrapper's name does not speak for the article in it
        self.stack.append(Element(tag, mark, dropped, main, article, len(self.out)))

    def end(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.out.append(" ")
        elif tag in INLINE:
            self.close_to({tag}, {e.tag for e in self.stack if e.tag not in INLINE})
        else:
            self.close_to({tag}, set())

    def parse(self) -> None:
        source, at = self.source, 0
        while (found := source.find("<", at)) >= 0:
            after = source[found + 1 : found + 2]
            if after in ("!", "?"):
                stop = source.find("-->", found + 4) + 2 if source.startswith("<!--", found) else source.find(">", found)
                if at < found:
                    self.say(source[at:found])
                at = stop + 1 if stop > found else len(source)
                continue
            if not (after.isascii() and after.isalpha() or after == "/"):
                self.say(source[at : found + 1])
                at = found + 1
                continue
            if at < found:
                self.say(source[at:found])
            tag = TAG.match(source, found) or LOOSE_TAG.match(source, found)
            if tag is None:
                stop = source.find(">", found) if after == "/" and not source[found + 2 : found + 3].isalpha() else -1
                at = stop + 1 if stop > 0 else len(source)
                continue
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                self.end(name)
            elif name in RAW:
                stop = re.compile(f"</{re.escape(name)}[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else len(source)
            else:
                self.open(name, tag[3])
        if at < len(source):
            self.say(source[at:])


def subtree_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's subtrees, with a hash of its text before templates go (``content``)."""
    for batch in batches:
        pages = [Page(h or "") for h in batch.column("html").to_pylist()]
        sizes = [len(x.hashes) for x in pages]
        at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        flat = pa.array([h for x in pages for h in x.hashes], pa.int64())
        content = pa.array([xxhash.xxh64(x.text.encode("utf-8", "replace")).intdigest() - (1 << 63) for x in pages], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host").take(at), flat, content.take(at)], names=["host", "hash", "content"])


def page_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's subtrees, with its host and the digest of its html (``page``)."""
    for batch in batches:
        lists = [Page(h or "").hashes for h in batch.column("html").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        flat = pa.array([h for x in lists for h in x], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host").take(at), batch.column("page").take(at), flat], names=["host", "page", "hash"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist(), strict=True)
        out = [Page(h or "", frozenset(t or ())).text for h, t in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, many: int = MANY_PAGES) -> DataFrame:
    """Main text of each page (``page_id``, ``url``, ``html``).

    One row per input row: ``page_id, url, text``. Left out is what stands in navigation,
    footers, sidebars, forms and the like, by element name, role or whole class name or id
    (names do not speak for an ``article`` or ``main`` inside), and outside
    ``article`` every subtree that stands on at least ``many`` pages of the host with different
    texts, however many pages it has. White space becomes one space, also between blocks.

    Null and empty html give the empty text. Pages without a host share the empty host.
    Cut-off tags and comments at the end are dropped; unclosed elements end with their
    parent. Repeated rows and copies of a page count once; repeated rows are answered as often
    as they stand. Other columns are
    ignored, whatever their names.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    counted = rows.select("host", "html").mapInArrow(subtree_hashes, "host string, hash bigint, content bigint").groupBy("host", "hash").agg(F.count_distinct("content").alias("n"))
    template = kept(counted.where(F.col("n") >= many).select("host", "hash"))
    by_host = template.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    total, most = template.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if total <= BROADCAST_HASHES and most <= HOST_HASHES:
        joined = rows.join(F.broadcast(by_host), "host", "left")
    else:
        rows = rows.withColumn("page", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
        own = rows.select("host", "page", "html").mapInArrow(page_hashes, "host string, page string, hash bigint")
        found = own.join(template, ["host", "hash"], "left_semi").groupBy("host", "page").agg(F.collect_set("hash").alias("hashes"))
        joined = rows.join(found, ["host", "page"], "left")
    return joined.select("page_id", "url", "html", "hashes").mapInArrow(texts, "page_id bigint, url string, text string")
