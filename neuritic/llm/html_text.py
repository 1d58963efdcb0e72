"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of the blocks below them (less what stands in links), and the page
votes with its score for the generalised path of its best container: tags and classes from the root, without digits.
Spark adds up the votes for each host, and every page is extracted again with its host's winning path; a page that
lacks it uses its own best container.

Parts that are no article are told by their tags and by words in class, id and role (the lists below). These words don't count
in html, body, main and article; beside a class for content (`entry comments-open`) only such as stand alone do; and a
part left out by its words, or a form, is taken back if it holds `MOST` of the page's text, as forms around a whole page do.

Results in corner cases: null or empty html, and pages without text, give an empty text; pages without a host vote
among themselves; ties go to the smaller path; cut-off pages are read to their end; repeated rows give equal rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, pick, stored, table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "annotation", "annotation-xml", "object", "canvas", "select", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rb", "rp", "nobr", "math", "mi", "mo", "mn", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "mspace", "mfenced", "semantics"}
AWAY = {"nav", "header", "footer", "aside", "button", "fieldset", "dialog", "menu", "head", "legend"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: A start tag ends these open elements, if they are the innermost of their kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "body", "div", "article", "section", "main", "td", "th", "blockquote"}
#: Words in a class, id or role by which a part of a page is left out, always or unless a word for content stands beside it.
NEVER = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "comment", "comments", "disqus", "share", "sharing", "social", "related", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "popup", "modal", "promo", "pagination", "pager", "respond", "replies", "adsense"}
RARELY = {"nav", "navbar", "navigation", "menu", "sidebar", "aside", "header", "masthead", "footer", "banner", "notice", "alert", "toolbar", "widget", "login", "signup", "search", "complementary", "contentinfo", "tags", "meta", "recommended", "rail"}
CONTENT = {"content", "article", "main", "post", "entry", "story", "body", "text", "page"}
#: Elements that their class, id or role never leaves out.
FRAME = {"html", "body", "main", "article"}
#: Share of a page's text at which a part that its words or a form would leave out is the page itself.
MOST = 0.9


def _attributes(rest: str) -> tuple[list[str], set[str], list[set[str]], bool]:
    """Classes; the words in classes, id and role, in all and of each; whether it is hidden."""
    classes, words, each, hidden = [], set(), [], False
    for m in _ATTR.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names = value.lower().split()
            each += [{w for w in _SPLIT.split(n) if w} for n in names]
            if name == "class":
                classes = names
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    words.update(*each)
    return classes, words, each, hidden


def _left_out(words: set[str], each: list[set[str]]) -> bool:
    """Whether words in class, id and role say that an element is no part of the text."""
    if words & NEVER:
        content = any(w and w <= CONTENT for w in each)
        if not content or any(len(w) == 1 and w <= NEVER for w in each):
            return True
    return bool(words & RARELY) and not words & CONTENT


class Page:
    """blocks: (container number, text, characters in links). containers: (number of its path, parent, weight)."""

    def __init__(self, html: str | None):
        self.found: list[tuple[int, str, int, int]] = []
        self.containers: list[tuple[int, int, float]] = [(0, -1, 0.4)]
        #: Paths are numbers; a further part of a path leads from one to another.
        self.paths: dict[tuple[int, str], int] = {}
        self.parts: list[tuple[int, str]] = [(-1, "")]
        #: What may be left out: the one around it, whether for certain, whether the header of an article.
        self.out: list[tuple[int, bool, bool]] = []
        # open elements: tag, container number, number in out or -1
        self.stack: list[tuple[str, int, int]] = [("", 0, -1)]
        self.inline = 0
        self.text: list[str] = []
        self.in_link = self.link_chars = 0
        self._read(html or "")
        self.blocks = self._kept()

    def _flush(self) -> None:
        if self.text:
            t = " ".join(unescape("".join(self.text)).split())
            tag, where, out = self.stack[-1]
            if t:
                if tag in HEADINGS and out >= 0 and self.out[out][2] and self._title(out):
                    out = self.out[out][0]
                self.found.append((where, t, self.link_chars, out))
            self.text.clear()
        self.link_chars = 0

    def _title(self, out: int) -> bool:
        """A heading in an article's own header belongs to the text."""
        for tag, _, o in reversed(self.stack):
            if tag == "header" or o != out:
                return tag == "header"
            if tag not in HEADINGS and tag not in ("div", "p"):
                return False
        return False

    def _kept(self) -> list[tuple[int, str, int]]:
        certain = [False] * len(self.out)
        for k, (up, no, _) in enumerate(self.out):
            certain[k] = no or up >= 0 and certain[up]
        own, total = [0] * len(self.out), 0
        for _, t, _, out in self.found:
            if out < 0 or not certain[out]:
                total += len(t)
                if out >= 0:
                    own[out] += len(t)
        for k in range(len(own) - 1, -1, -1):  # what is inside stands later
            if self.out[k][0] >= 0:
                own[self.out[k][0]] += own[k]
        away = [False] * len(self.out)
        for k, (up, no, _) in enumerate(self.out):
            away[k] = no or own[k] < MOST * total or up >= 0 and away[up]
        return [(where, t, linked) for where, t, linked, out in self.found if out < 0 or not away[out]]

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self._add(html[at:])
                break
            self._add(html[at : m.start()])
            at = m.end()
            close, tag, rest = m[1] if m[2] else m[4], m[2] or m[5], m[3] if m[2] else m[6]
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            else:
                self._open(tag, rest or "")
        self._flush()

    def _add(self, t: str) -> None:
        if t and self.stack[-1][0] not in INLINE:  # only inline parts to leave out are on the stack
            self.text.append(t)
            if self.in_link:
                self.link_chars += len(t)

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "hr":
            self._flush()
        if tag in VOID:
            return
        classes, words, each, hidden = _attributes(rest) if "=" in rest or "hidden" in rest else ([], set(), [], False)
        no = bool(words) and tag not in FRAME and _left_out(words, each)
        if tag in INLINE:
            if tag == "a":
                self.in_link = 1
            if (no or hidden) and not rest.endswith("/"):
                self.stack.append((tag, self.stack[-1][1], self._leave_out(True, False)))
                self.inline += 1
            return
        self._flush()
        if self.stack[-1][0] == "p":
            self._cut(len(self.stack) - 1)
        if tag in CLOSES:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in CLOSES[tag]:
                    self._cut(k)
                    if tag != "tr":
                        break
                elif self.stack[k][0] in SCOPES - {"td", "th"} or self.stack[k][0] in SCOPES and tag not in ("td", "th", "tr"):
                    break
        _, where, out = self.stack[-1]
        if tag not in ("p", "li", "html", "pre", "blockquote", "ul", "ol", "dl", "dt", "dd", "tr", "tbody", "thead", "figure", "figcaption") and tag not in HEADINGS:
            kind = tag + "".join("." + g for g in sorted({re.sub(r"[\d/]+", "", c) for c in classes}) if g)
            weight = {"article": 1.6, "main": 1.5, "body": 0.6}.get(tag, 1.0) * (1.3 if words & CONTENT else 1.0)
            part = (self.containers[where][0], kind)
            if part not in self.paths:
                self.paths[part] = len(self.parts)
                self.parts.append(part)
            self.containers.append((self.paths[part], where, weight))
            where = len(self.containers) - 1
        if hidden or tag in AWAY:
            out = self._leave_out(True, tag == "header" and not hidden and any(t in ("article", "main") for t, _, _ in self.stack))
        elif no or tag == "form":
            out = self._leave_out(False, False)
        self.stack.append((tag, where, out))

    def _leave_out(self, certain: bool, title: bool) -> int:
        self.out.append((self.stack[-1][2], certain, title))
        return len(self.out) - 1

    def _cut(self, k: int) -> None:
        if self.inline:
            self.inline -= sum(t in INLINE for t, _, _ in self.stack[k:])
        del self.stack[k:]

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if tag in INLINE and not self.inline:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if tag not in INLINE:
                    self._flush()
                self._cut(k)
                return
        if tag == "p":
            self._flush()

    def best(self) -> tuple[str, float]:
        """Path and score of the best container; the score of a path is the sum over its containers; of a page without
        text the page itself."""
        own = [0.0] * len(self.containers)
        for where, t, linked in self.blocks:
            value = max(0.0, len(t) - 2.0 * linked)
            for share in (1.0, 0.5, 0.25):
                own[where] += share * value
                where = self.containers[where][1]
                if where < 0:
                    break
        by: dict[int, float] = {}
        for (path, _, weight), value in zip(self.containers, own, strict=True):
            by[path] = by.get(path, 0.0) + weight * value
        top = max(by.values())
        return min(self._spelled(p) for p in by if by[p] == top) if top > 0 else "", top

    def _spelled(self, path: int) -> str:
        out = []
        while path >= 0:
            path, part = self.parts[path]
            out.append(part)
        return "/".join(reversed(out))

    def _number(self, path: str) -> int:
        """The number of a path, -1 if the page has none such."""
        k = 0
        for part in path.split("/")[1:]:
            k = self.paths.get((k, part), -1)
        return k

    def extract(self, path: str | None) -> str:
        """Text of all containers with this path; of the best if there is none with text."""
        for want in (path, self.best()[0]):
            if want is None:
                continue
            inside, number = [False] * len(self.containers), self._number(want)
            for k, (p, up, _) in enumerate(self.containers):
                inside[k] = p == number or up >= 0 and inside[up]
            if got := [t for where, t, _ in self.blocks if inside[where]]:
                return "\n\n".join(got)
        return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's winning path) for every page."""
    arrow_batches(pages.sparkSession)
    pages = pick(pages, "page_id", "url", "html").withColumn("url", F.col("url").cast("string")).withColumn("html", F.col("html").cast("string"))
    pages = pages.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][-+.\w]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [Page(h).best() for h in pdf["html"]]
            yield pd.DataFrame({"host": pdf["host"], "path": [p for p, _ in got], "score": [s for _, s in got]})

    votes = pages.select("host", "html").mapInPandas(vote, "host string, path string, score double").filter("score > 0")
    # votes as integers, so that sums don't depend on their order
    sums = votes.groupBy("host", "path").agg(F.sum(F.round("score").cast("long")).alias("votes"))
    winners = stored(sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path")), "paths")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [Page(h).extract(p) for h, p in zip(pdf["html"], pdf["path"], strict=True)]
            yield pdf[["page_id", "url", "text", "path"]]

    kind = dict(pages.dtypes)["page_id"]
    joined = pages.join(winners, "host", "left").select("page_id", "url", "html", "path")
    out = joined.mapInPandas(again, f"page_id {kind}, url string, text string, path string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLE = {}
