"""Main text of web pages by deduction of templates from equivalence classes.

A page is a sequence of tokens: tags and blocks of text, told apart by the path of elements that they stand in.  A
token's occurrence vector tells how often it occurs in each page of a host; tokens with the same vector form an
equivalence class.  The vector is carried as its sum and the XOR of a hash of (page, count), so it is gathered
by partial sums and no host's pages ever meet in one task.  Classes that occur in most of a host's pages are valid.
The elements of valid classes that occur once a page are the template's root; classes that occur more often are
nested in the root element around them.  What lies between template tokens are the slots, and an element's slot
text is what it holds in all pages but for blocks of text that are template tokens themselves, such as a notice in
every article.  The content is the root's article (or main) elements with slot text, else the innermost root element
with most of the slot text.  The main text is the text of the slots in the content, block by block.

Page furniture is never content: elements made for it (nav, footer, form ...), and those whose class, id or role is
made of words for it throughout ("ad-box", but not "search-results-explained").  A block needs SUPPORT pages to be a
template token, as a few pages can share a sentence; a page whose content is template text throughout, as a copy
among copies, keeps it.  Hosts of a single page, and pages without the host's content element, are read by the same
rules with the page as its own template.

Pages are read by one scan forward, linear in their length whatever is broken in them.

Defined results: null and empty pages have an empty text; a null url counts as a host of its own; pages that
are repeated are extracted each; broken markup is read on: an end tag without a start is skipped, elements that
are not closed end with the element around them, a tag that never ends is text, one whose quote takes the rest of
the page ends the page; columns of any names stay apart; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_small, table, written

#: A class is valid if it occurs in this share of a host's pages, and in two pages.
VALID_SHARE = 0.5
#: A block of text is of the template only if it occurs in so many of the host's pages.
SUPPORT = 5
#: Longer texts are tokens by their hash.
TEXT_TOKEN = 40
#: Without an article element: the innermost root element with this share of the host's text is the content.
CONTENT_SHARE = 0.8

#: Elements whose content is no text of the page.
RAW = {"script", "style", "template", "svg", "iframe", "object", "select", "textarea", "canvas", "video", "audio"}
FURNITURE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "header"}
CONTENT = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a block's text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements whose end tags are often left out; they are not put on the path.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "colgroup", "caption"}
#: Which elements that are still open a start tag ends.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}} | dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), {"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th", "p"})
#: Words in class, id or role that mark page furniture.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies",
    "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted",
    "recommended", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that stand beside these in a mark and tell nothing.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "drawer", "form", "global", "group", "holder", "icons", "inner", "inline", "items", "item", "js",
    "leaderboard", "left", "link", "links", "list", "main", "media", "mobile", "outer", "overlay", "page", "panel", "post", "posts", "primary", "rail", "right", "row", "secondary", "section", "site", "sticky", "slot", "text", "the",
    "thread", "title", "top", "unit", "user", "wrap", "wrapper", "stories", "articles", "more", "us", "up", "policy", "alert", "message",
}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"[\"'>]")
_DIGITS = re.compile(r"\d+")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in RAW}
#: Marks that tell nothing of a table's cells or of a run of words.
_PLAIN = {"header", "footer"}


def host_of(url):
    """The host of a url column, in lower case; null stays null."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _marks(attributes: str) -> dict[str, str]:
    return {k.lower(): (a or b or c).strip() for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}


def _is_furniture(marks: dict[str, str], plain: bool = False) -> bool:
    """Whether one of an element's marks is made of words for page furniture, and neutral ones, throughout."""
    for value in marks.values():
        for mark in value.split():
            words = [w for w in _SPLIT.split(_CAMEL.sub("-", mark).lower()) if w]
            known = [w for w in words if w in MARKS and not (plain and w in _PLAIN)]
            if known and all(w in MARKS or w in NEUTRAL for w in words):
                return True
    return False


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind "text" (rest: the raw text), "start" or "end" of an element (rest: its attributes);
    comments, declarations and the content of RAW elements are left out."""
    at, text_from, last, quotes = 0, 0, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            break
        c = page[at + 1 : at + 2]
        if c in ("!", "?"):
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                end = stop + 3 if stop >= 0 else len(page)
            elif page.startswith("<![CDATA[", at) and (stop := page.find("]]>", at)) >= 0:
                end = stop + 3
            else:
                end = page.find(">", at) + 1
            if at > text_from:
                yield "text", "", page[text_from:at]
            at = text_from = end
            continue
        closing = c == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m:
            at += 1
            continue
        end = m.end()
        while True:  # to the > that is not in quotes
            q = _QUOTE.search(page, end)
            if not q:
                end = len(page)
                break
            end = q.end()
            if q[0] == ">":
                break
            if quotes[q[0]] >= end:
                end = page.index(q[0], end) + 1
        if at > text_from:
            yield "text", "", page[text_from:at]
        name, rest = m[0].lower(), page[m.end() : end - 1]
        at = text_from = end
        if name in RAW and not closing and not rest.endswith("/"):
            stop = _RAW_END[name].search(page, at)
            at = text_from = stop.end() if stop else len(page)
        else:
            yield "end" if closing else "start", name, rest
    if text_from < len(page):
        yield "text", "", page[text_from:]


class _Element:
    __slots__ = ("content", "counts", "furniture", "kids", "name", "path", "plain", "pre", "soft")

    def __init__(self, name: str, path: str, plain: str, furniture: bool, content: bool, pre: bool):
        self.name, self.path, self.plain, self.furniture, self.content, self.pre = name, path, plain, furniture, content, pre
        self.kids: dict[str, int] = {}  # how many elements of a name with marks it has had
        self.soft: list[tuple[str, bool]] = []  # open elements in it that are not on the path: name, furniture
        self.counts: dict[str, int] = {}

    def leave(self, names) -> None:
        """Closes soft elements up to the outermost of these names."""
        while any(self.counts.get(n) for n in names):
            n, _ = self.soft.pop()
            self.counts[n] -= 1

    def leave_one(self, name: str) -> None:
        while self.counts.get(name):
            n, _ = self.soft.pop()
            self.counts[n] -= 1
            if n == name:
                return

    def enter(self, name: str, furniture: bool) -> None:
        self.soft.append((name, furniture))
        self.counts[name] = self.counts.get(name, 0) + 1

    def hidden(self) -> bool:
        return self.furniture or bool(self.soft and self.soft[-1][1])


def parse(page: str) -> Iterator[tuple[str, str, bool, object]]:
    """(kind, path, furniture, value) in page order.  kind: "open" or "close" of an element on the path (value: its
    name, its parent's path, its plain path), "break" (a block's border), "text" (value: the raw text).  path: a
    name for the elements around, with their marks but for numbers in them, and their number among the same in the
    element around (the plain path: without); furniture: inside page furniture."""
    path, opened = [_Element("", "", "", False, False, False)], {}
    for kind, name, rest in scan(page):
        top = path[-1]
        if kind == "text":
            yield "text", top.path, top.hidden(), rest
            continue
        closing = kind == "end"
        if name in LOOSE or (name in INLINE and name not in VOID):
            if closing:
                top.leave_one(name)
            else:
                if name in LOOSE:
                    top.leave(ENDS.get(name, {name}))
                within = bool(top.soft and top.soft[-1][1])
                bad = within or bool(rest and not (name in INLINE and top.pre) and _is_furniture(_marks(rest), plain=True))
                if name in LOOSE or bad:
                    top.enter(name, bad)
        if name in INLINE:
            continue
        if name in VOID or name in LOOSE:
            yield "break", top.path, top.furniture, name
            continue
        if closing:
            if not opened.get(name):
                yield "break", top.path, top.furniture, name
                continue
            while True:
                e = path.pop()
                opened[e.name] -= 1
                yield "close", e.path, e.furniture, (e.name, path[-1].path, e.plain)
                if e.name == name:
                    break
            continue
        top.leave({"p"})
        marks = _marks(rest)
        own = name + "".join(f".{k}={_DIGITS.sub('#', v.lower())}" for k, v in sorted(marks.items()))
        hidden = top.hidden() or (name in FURNITURE and not (name == "header" and top.content))
        bad = hidden or (name not in CONTENT and name not in ("html", "body") and bool(marks) and _is_furniture(marks) and not re.fullmatch("h[1-6]", name))
        top.kids[own] = k = top.kids.get(own, 0) + 1
        e = _Element(name, xxhash.xxh3_64_hexdigest(f"{top.path}/{own}/{k}"), xxhash.xxh3_64_hexdigest(f"{top.plain}/{own}"), bad, top.content or name in CONTENT, top.pre or name == "pre")
        yield "open", e.path, bad, (name, top.path, e.plain)
        if rest.endswith("/"):
            yield "close", e.path, bad, (name, top.path, e.plain)
        else:
            path.append(e)
            opened[name] = opened.get(name, 0) + 1


def blocks_of(events) -> Iterator[tuple[str, str]]:
    """(path, text) of the blocks of text that are not furniture, with single spaces, in page order."""
    block: list[str] = []
    at = ""
    for kind, path, bad, value in [*events, ("break", "", False, "")]:
        if kind == "text":
            if not bad:
                at = path
                block.append(value)
        elif block:
            if text := " ".join(_html.unescape("".join(block)).split()):
                yield at, text
            block = []


def block_token(path: str, text: str) -> str:
    return f"t{path}|{text}" if len(text) <= TEXT_TOKEN else f"h{path}|{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def occurrences(page: str | None) -> dict[str, list[int]]:
    """token -> how often it occurs, and the text in it: of an element what it holds itself outside of furniture, of
    a block its length.  Tokens: "<path name parent plain" and ">path" for elements, "-path name" for borders,
    texts by plain path."""
    count: dict[str, list[int]] = {}
    own: dict[str, int] = {}
    names: dict[str, str] = {}
    plain = {"": ""}
    events = list(parse(page or ""))

    def put(token: str, size: int = 0) -> None:
        c = count.setdefault(token, [0, 0])
        c[0] += 1
        c[1] += size

    for kind, path, bad, value in events:
        if kind == "open":
            # an element that is furniture can be no content
            names[path] = token = f"<{path} {'-' if bad else value[0]} {value[1]} {value[2]}"
            plain[path] = value[2]
            put(token)
        elif kind == "close":
            put(">" + path)
        elif kind == "break":
            put(f"-{path} {value}")
    for path, text in blocks_of(events):
        put(block_token(plain[path], text), len(text))
        own[path] = own.get(path, 0) + len(text)
    for path, size in own.items():
        if path in names:
            count[names[path]][1] += size
    return count


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, token, pages, total, vector, mass: pages with the token, its occurrences, the XOR of hashes of (page,
    count), and the text that it holds itself in all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for host, page, text in zip(*(c.to_pylist() for c in b.columns)):
                for token, (n, size) in occurrences(text).items():
                    s = sums.setdefault((host, token), [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] ^= xxhash.xxh3_64_intdigest(f"{page}:{n}".encode()) - (1 << 63)
                    s[3] += size
            cols = [[k[0] for k in sums], [k[1] for k in sums], *([s[j] for s in sums.values()] for j in range(4))]
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "token", "pages", "total", "vector", "mass"])

    found = pages.select("host", "page", "html").mapInArrow(run, "host string, token string, pages long, total long, vector long, mass long")
    return found.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total")], F.bit_xor("vector").alias("vector"), F.sum("mass").alias("mass"))


class Template:
    """The nested classes of a host's pages.  classes: (pages, total, tokens); a token: its name and its mass."""

    def __init__(self, classes, support: int = SUPPORT):
        self.parent: dict[str, str] = {}  # of every template element, and its name
        self.name: dict[str, str] = {}
        self.root: set[str] = set()  # elements that occur once a page
        self.nested: dict[str, list[str]] = {}  # root element -> elements of classes that repeat in it
        self.slot: dict[str, int] = {}  # text that an element holds itself in slots
        self.texts: list[str] = []  # blocks that are template tokens
        fixed: dict[str, int] = {}
        plain: dict[str, str] = {}
        for c in classes:
            for t in c["tokens"]:
                kind, rest = t["token"][0], t["token"][1:]
                if kind == "<":
                    path, name, parent, plain[path] = rest.split(" ")
                    self.parent[path], self.name[path], self.slot[path] = parent, name, t["mass"]
                    if c["pages"] == c["total"]:
                        self.root.add(path)
                elif kind in "th" and c["pages"] >= support:
                    self.texts.append(t["token"])
                    path = rest.partition("|")[0]
                    fixed[path] = fixed.get(path, 0) + t["mass"]
        for path, size in self.slot.items():
            less = min(size, fixed.get(plain[path], 0))
            if less:
                self.slot[path] -= less
                fixed[plain[path]] -= less
        for path in self.parent.keys() - self.root:
            self.nested.setdefault(self.around(path), []).append(path)

    def around(self, path: str) -> str:
        """The innermost root element at or around an element."""
        while path in self.parent and path not in self.root:
            path = self.parent[path]
        return path if path in self.root else ""

    def content(self) -> list[str]:
        """The root elements whose slots are the main text."""
        depth: dict[str, int] = {}
        for path in self.parent:
            chain = []
            while path in self.parent and path not in depth:
                chain.append(path)
                path = self.parent[path]
            for p in reversed(chain):
                depth[p] = depth.get(self.parent[p], 0) + 1
        held = dict(self.slot)
        for p in sorted(held, key=depth.__getitem__, reverse=True):
            if self.parent[p] in held:
                held[self.parent[p]] += held[p]
        good = [p for p in self.root if held.get(p, 0) > 0 and self.name[p] != "-"]
        for wanted in ("article", "main"):
            if found := sorted(p for p in good if self.name[p] == wanted):
                return found
        whole = sum(self.slot.values())
        full = [p for p in good if held[p] >= CONTENT_SHARE * whole]
        return [max(full, key=lambda p: (depth[p], p))] if full else []


def templates(pages: DataFrame, share: float = VALID_SHARE) -> DataFrame:
    """host, host_pages, content (paths of the content elements), template (blocks of text of valid classes)."""
    vectors = written(token_vectors(pages), "html-vectors")
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    valid = join_small(vectors, hosts, ["host"], "token").where((F.col("pages") >= 2) & (F.col("pages") >= share * F.col("host_pages")))
    # a class: equal vectors.  Its tokens are as many as a template has, whatever the host's number of pages
    classes = valid.groupBy("host", "host_pages", "pages", "total", "vector").agg(F.collect_list(F.struct("token", "mass")).alias("tokens"))
    hosts = classes.groupBy("host", "host_pages").agg(F.collect_list(F.struct("pages", "total", "tokens")).alias("classes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [Template(c) for c in pdf["classes"]]
            pdf = pdf.assign(content=[t.content() for t in found], template=[t.texts for t in found])
            yield pdf[["host", "host_pages", "content", "template"]]

    out = written(hosts.mapInPandas(run, "host string, host_pages long, content array<string>, template array<string>"), "html-templates")
    forget(pages.sparkSession, vectors)
    return out


def main_text(page: str | None, content: list[str] | None, template: list[str] | None = None) -> str:
    """The text of the slots in a page's content elements, block by block."""
    if not page:
        return ""
    events = list(parse(page))
    opened = {path: value for kind, path, _, value in events if kind == "open"}
    parent, plain = {p: v[1] for p, v in opened.items()}, {"": ""} | {p: v[2] for p, v in opened.items()}
    wanted = {p for p in content or () if p in parent}
    if not wanted:  # the page as its own template
        tokens = [{"token": t, "mass": mass} for t, (_, mass) in occurrences(page).items() if t[0] == "<"]
        wanted = set(Template([{"pages": 1, "total": 1, "tokens": tokens}]).content()) or {""}
    inside = {"": "" in wanted}
    for p in parent:  # elements come after those around them
        inside[p] = p in wanted or inside[parent[p]]
    blocks = [(p, t) for p, t in blocks_of(events) if inside[p]]
    known = set(template or ())
    own_text = [t for p, t in blocks if block_token(plain[p], t) not in known] if known else []
    return "\n".join(own_text or [t for _, t in blocks])


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", share: float = VALID_SHARE) -> DataFrame:
    """page_id, url, text, n_chars."""
    d = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    known = templates(d, share).select("host", "content", "template")
    kind = pages.schema[page].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), c.as_py(), t.as_py()) for h, c, t in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return join_small(d, known, ["host"], "page").select("page", "url", "html", "content", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
