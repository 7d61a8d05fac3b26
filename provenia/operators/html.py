"""HTML to text, headings, links and rendering mode, with the standard library's parser, Arrow-batched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.functions.urls import SKIP_EXTENSIONS

#: Elements without content, elements that are boilerplate, headings, mount points of client-side frameworks.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE = frozenset("script style nav header footer aside".split())
UNREAD = BOILERPLATE | {"template", "rt", "rp"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}
MOUNTS = frozenset({"app-root", "#root", "#app", "#__next", "#__nuxt"})
SCRIPT_MARKERS = ("ng-version", "enable javascript")
#: The elements that end, where they are the innermost, when one of a name begins.
_CELLS, _LINES = {"td", "th", "p", "span", "font", "a", "b", "u"}, {"p", "head"}
ENDED = {
    "p": {*_LINES, *HEADINGS, "h5", "h6", "b", "i", "u", "s", "tt", "big", "small", "strike"}, "li": {*_LINES, *HEADINGS, "h5", "h6", "dl", "pre", "address", "li"},
    "dt": {*_LINES, "dd"}, "dd": {*_LINES, "dt"}, "td": _CELLS, "th": _CELLS, "tr": {"td", "th", "tr", "caption", "p"}, "option": {"option"}, "a": {"a", "head"}, "body": {"head", "title"},
    "table": {*_LINES, *HEADINGS, "h5", "h6", "pre", "a"}, "tbody": {"td", "th", "tr", "caption", "thead", "tbody", "p"},
    **{h: {*_LINES, *HEADINGS, "h5", "h6"} - {h} for h in (*HEADINGS, "h5", "h6")}, **{t: _LINES for t in "div ul ol dl pre hr form blockquote address".split()},
}
#: Least characters of a page's text, of a link's title, most of its snippet.
LEAST_TEXT, LEAST_TITLE, SNIPPET = 200, 5, 500
_TURN = 128  # pages whose rows are held before they are sent


class _Open:
    """An element that is not at its end: its headings whose text goes on, and the name of the last link in it."""

    __slots__ = ("tag", "ident", "heading", "under", "named")

    def __init__(self, tag: str, ident: str = "", heading: dict | None = None):
        self.tag, self.ident, self.heading = tag, ident, heading
        self.under: list[dict] = []
        self.named = ""


class Page(HTMLParser):
    """One pass over a page: text, headings, links, embedded documents, empty mounts.

    The text of a heading is all that follows it in its parent, up to the next heading there of the same level or a
    higher one: lower headings belong to it with their text. Its anchor is its own id, else that of the nearest section or
    article around it, else the name of the last link before it in its parent. Boilerplate has no headings; comments beside a heading count as its text.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("")]
        self.text: list[str] = []
        self.body: list[str] = []
        self.headings: list[dict] = []
        self.links: list[dict] = []
        self.embedded: list[str] = []
        self.mounts: list[dict] = []
        self._link: dict | None = None
        self._run: list[str] = []
        self.feed(html)
        self.close()
        self._read()
        for h in self.headings:
            h["title"], h["text"] = "".join(h["title"]), " ".join(h["text"])

    def _within(self, tags: frozenset[str]) -> bool:
        return any(e.tag in tags for e in self.open)

    def _read(self) -> None:
        """Give the text since the last tag to the headings it stands in and below."""
        t = "".join(self._run).strip()
        self._run = []
        if t and not self._within(UNREAD):
            for e in self.open:
                if e.heading is not None:
                    e.heading["title"].append(t)
                for h in e.under:
                    h["text"].append(t)

    def _end(self, first: int) -> None:
        """End the open elements from one on. What follows a heading is its text from then on."""
        for around, e in zip(self.open[first - 1 :], self.open[first:], strict=False):
            if e.heading is not None:
                around.under.append(e.heading)
        del self.open[first:]
        for m in self.mounts:
            if m["on"] and len(self.open) <= m["depth"]:
                m["on"] = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._read()
        while self.open[-1].tag in ENDED.get(tag, ()):
            self._end(len(self.open) - 1)
        a = {k: v or "" for k, v in attrs}
        ident, around, heading = a.get("id", ""), self.open[-1], None
        if tag in HEADINGS and not self._within(BOILERPLATE):
            level, parent = HEADINGS[tag], next((e.ident for e in reversed(self.open) if e.tag in ("section", "article") and e.ident), "")
            around.under = [h for h in around.under if h["level"] < level]
            heading = {"level": level, "title": [], "anchor": ident or parent or around.named, "text": []}
            self.headings.append(heading)
        if tag == "a":
            around.named = a.get("name", "")
            if "href" in a:
                self._link = {"href": a["href"], "title": "", "after": len(self.text)}
                self.links.append(self._link)
        if tag in ("embed", "iframe", "object"):
            self.embedded += [a[k] for k in ("src", "data-src", "data", "href") if a.get(k)][:1]
        if tag in MOUNTS or f"#{ident}" in MOUNTS:
            self.mounts.append({"name": tag if tag in MOUNTS else f"#{ident}", "depth": len(self.open), "n": 0, "on": True})
        if tag not in VOID:
            self.open.append(_Open(tag, ident, heading))

    def handle_endtag(self, tag: str) -> None:
        self._read()
        if tag == "a":
            self._link = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._end(i)
                break

    def handle_comment(self, data: str) -> None:
        self._read()
        t = data.strip()
        if t and not self._within(UNREAD):
            for h in self.open[-1].under:
                h["text"].append(t)

    def handle_data(self, data: str) -> None:
        self._run.append(data)
        t = " ".join(data.split())
        tags = {e.tag for e in self.open}
        if not t or tags & {"script", "style"}:
            return
        for m in self.mounts:
            m["n"] += len(t) * m["on"]
        if "body" in tags:
            self.body.append(t)
        if self._link is not None:
            self._link["title"] = f"{self._link['title']} {t}".strip()
        if not tags & BOILERPLATE and "title" not in tags:
            self.text.append(t)

    def snippet(self, link: dict) -> str:
        return " ".join(self.text[link["after"] :][:60])[:SNIPPET]


def render_mode(page: Page, html: str) -> tuple[str, int, str]:
    """``mode, characters of the body, reason``: whether the text is in the markup or is drawn by a script."""
    n = sum(map(len, page.body))
    marks = [m for m in SCRIPT_MARKERS if m in html.lower()] + [m["name"] for m in page.mounts if m["n"] < 40]
    if not html.strip():
        return "spa", 0, "empty"
    return ("spa", n, "markers: " + ", ".join(marks)) if marks else ("spa", n, "bare shell") if n < LEAST_TEXT else ("ssr", n, "content in markup")


def real_response(page: Page, html: str, status: int) -> bool:
    enable = any(m in html for m in ("You need to enable JavaScript", "Please enable JavaScript"))
    return status not in (403, 429) and sum(map(len, page.body)) >= LEAST_TEXT and not enable


def pdf_link(page: Page, base: str) -> str | None:
    """The document a page stands for: an embedded one, else the first link to a PDF; a viewer's ``file`` parameter is unwrapped."""
    anchors = [x["href"] for x in page.links if urlparse(x["href"]).path.lower().endswith(".pdf")]
    for raw in [*page.embedded, *anchors]:
        inner = parse_qs(urlparse(raw).query).get("file", [raw])[0]
        return urljoin(base, inner).replace(" ", "%20")
    return None


def hierarchy(page: Page, base: str) -> list[tuple[int, int, str, str | None, str]]:
    """``seq, level, title, anchor, text`` of the headings; the anchor is a place of the page's URL, null if there is none."""
    return [(i, h["level"], h["title"], f"{base.rstrip('/')}#{h['anchor']}" if h["anchor"] else None, h["text"]) for i, h in enumerate(page.headings)]


def links(page: Page, base: str) -> list[tuple[str, str, str]]:
    """``url, title, snippet`` of the distinct links of the same host that are no assets and have a title."""
    out, seen, host = [], set(), urlparse(base).netloc
    for x in page.links:
        url = urljoin(base, x["href"]).partition("#")[0]
        path = urlparse(url)
        if path.netloc != host or path.path.lower().endswith(SKIP_EXTENSIONS) or url in seen or len(x["title"]) < LEAST_TITLE:
            continue
        seen.add(url)
        out.append((url, x["title"], page.snippet(x)))
    return out


def parse_pages(pages: DataFrame, rows: Callable[[Page, str, str], list[tuple]], schema: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of a function of ``page, url, html`` for every page, led by its id. A page that cannot be read gives what was read of it."""
    kind = dict(pages.dtypes)[id_col]
    columns = [id_col, *[c.strip().split()[0] for c in schema.split(",")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), _TURN):
                out = [(i, *r) for i, u, h in frame.iloc[at : at + _TURN].itertuples(index=False) for r in rows(Page(h or ""), u or "", h or "")]
                yield pd.DataFrame(out, columns=columns)

    return pages.select(id_col, F.col(url), F.col(html)).mapInPandas(run, f"{id_col} {kind}, {schema}")
