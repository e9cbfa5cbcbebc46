"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: tags, told apart by their role (the path of elements that
leads to them), and runs of text at their path. Tokens of a host that occur equally often
on each of its pages form an equivalence class; classes that are frequent and large belong
to the site's template rather than to a page. Valid classes nest: an element is template
only where the element around it is. What the template leaves open are its slots, and the
article is what fills the slots below the template's content element.

Where content is marked (article, main, or a class that says so), the marks decide: all text
below them but noise is article, also what every page repeats. The template's texts are left
out only below an element that the text's share alone has chosen.

An occurrence vector has one entry per page of the host, so it is never built: each task
adds up a hash of (page, count) for every token, and equal sums mean equal vectors. All
that meets in one place for a host are its frequent tokens, whose number is bounded by
(tokens of a mean page) / ``MIN_SHARE``, however many pages the host has.

Elements whose name, class, id or role says menu, header, footer, sidebar, notice, advert,
form, script, style or reader comments are never article, nor is what they hold. Within
content, words of headings and inline elements say nothing: there they name the text.

Class and id words may also describe a layout ("with-sidebar", "menu-open", "widget"), and a
form may hold a whole page. So an article or main element that lies in such an element, and in
no content, is *wrapped*: it counts where the page or the template has no other mark and it
holds more text than all that lies outside noise. Below nav, header, footer or aside elements,
roles that say noise and reader comments nothing is wrapped.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept

MIN_SHARE = 0.5
MIN_PAGES = 5
HELD_TOKENS = 300_000
BROADCAST_TOKENS = 200_000
PATHS = 100_000  # remembered element paths per task
DEPTH = 60  # deeper elements count as the one around them, unless they are the first noise, content or link

# HTML elements by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = set(
    "head title nav footer aside form script style noscript template iframe object button select option textarea input "
    "dialog svg canvas menu fieldset".split()
)
NOISE_WORDS = set(
    "nav navbar navigation menu menubar header masthead topbar footer sidebar aside notice notices cookie cookies consent gdpr banner alert "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply replies discussion "
    "share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup popup modal overlay widget "
    "login search toolbar pagination pager skip form".split()
)
HEADS = set("header masthead".split())
COMMENT_WORDS = set("comment comments disqus respond reply replies discussion".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT_WORDS = set("article content post entry story main body text maincontent articlebody postbody".split())
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("article aside body div dl footer form header html main nav ol section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Element:
    """A role: the path of names (with classes and ids) from the root to an element."""

    __slots__ = ("name", "path", "key", "noise", "barred", "content", "wrapped", "within", "inline", "link", "depth", "children", "parent")

    def __init__(self, parent: Element | None, name: str, named: str):
        self.parent, self.name, self.children = parent, name, {}
        self.path = f"{parent.path}/{name}{named}" if parent else ""
        self.depth = parent.depth + 1 if parent else 0
        self.key = xxhash.xxh64_intdigest(self.path.encode("utf-8", "replace"), 1) >> 1
        words = set(_WORD.findall(named))
        above = parent or self
        inside = parent is not None and parent.content > 0
        if inside:
            words -= HEADS  # the head of an article is part of it
        if inside and (name in INLINE or name in HEADINGS):
            words = set()  # a slug or a style, not a part of the page
        said = words & NOISE_WORDS
        noise = name in NOISE_TAGS or (name == "header" and not inside) or bool(said) or bool("=role" in named and words & NOISE_ROLES)
        if name in ("html", "body", "article", "main"):
            noise = False
        # barred: noise for another reason than being a form or having a word that may describe a layout
        sure = noise and (name in NOISE_TAGS - {"form"} or name == "header" or bool("=role" in named and words & NOISE_ROLES) or bool(said & COMMENT_WORDS))
        self.within = parent is not None and (parent.within or parent.content > 0)  # below content, in noise too
        self.barred = parent is not None and (parent.barred or sure)
        rank = 3 if name == "article" else 2 if name == "main" or "main=role" in named else 1 if name in ("div", "section", "td") and words & CONTENT_WORDS else 0
        opens = parent is not None and parent.noise and rank > 1 and not noise and not self.barred and not self.within
        self.noise = parent is not None and not opens and (parent.noise or noise)
        self.wrapped = parent is not None and (parent.wrapped or opens)
        self.content = 0 if parent is None or self.noise else max(parent.content, rank)
        self.inline = name in INLINE
        self.link = parent is not None and (above.link or name == "a")

    def child(self, name: str, attributes: str) -> Element:
        named = ""
        if attributes and ("=" in attributes):
            found = _NAMED.findall(attributes)
            if found:
                named = "".join(f"[{v.strip(chr(34) + chr(39)).lower()}={k.lower()}]" for k, v in found)
        at = (name, named)
        got = self.children.get(at)
        if got is None:
            got = self.children[at] = Element(self, name, named)
        return got


class Parser:
    """Pages to events; roles are remembered from page to page."""

    def __init__(self):
        self.root, self.count = Element(None, "", ""), 0

    def events(self, page: str) -> list[tuple[int, Element, str]]:
        """``(0, element, "")`` per opened element, ``(1, element, text)`` per run of text, ``(2, ...)`` per block boundary."""
        self.count += 1
        if self.count % 1000 == 0:
            self.root = Element(None, "", "")  # also frees what odd pages left
        out, node, at = [], self.root, 0
        stack: list[tuple[str, Element]] = []  # open elements, as deep as the page goes
        places: dict[str, list[int]] = {}  # of each name in the stack
        scopes: list[int] = []  # places of names in SCOPES

        def close(place: int) -> Element:
            while len(stack) > place:
                gone = stack.pop()[0]
                places[gone].pop()
                if gone in SCOPES:
                    scopes.pop()
            return stack[-1][1] if stack else self.root

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                out.append((1, node, page[at : m.start()]))
            at = m.end()
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            if m.group(2):
                if places.get(name) and (name in SCOPES or not scopes or scopes[-1] < places[name][-1]):
                    node = close(places[name][-1])
                if name not in INLINE:
                    out.append((2, node, ""))
                continue
            if name in CLOSES_P or name in SIBLINGS:
                last = max((places[x][-1] for x in SIBLINGS.get(name, {"p"}) if places.get(x)), default=-1)
                if last > (scopes[-1] if scopes else -1):
                    node = close(last)
            if name not in INLINE:
                out.append((2, node, ""))
            opened = node.child(name, m.group(4))
            if node.depth >= DEPTH and (opened.noise, opened.barred, opened.content, opened.link) == (node.noise, node.barred, node.content, node.link):
                opened = node
            out.append((0, opened, ""))
            if name not in VOID and not m.group(4).endswith("/"):
                places.setdefault(name, []).append(len(stack))
                if name in SCOPES:
                    scopes.append(len(stack))
                stack.append((name, opened))
                node = opened
        if at < len(page):
            out.append((1, node, page[at:]))
        return out


def text_key(element: Element, text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "replace"), element.key) >> 1


def token_rows(pages: DataFrame) -> DataFrame:
    """``(host, token, path, pages, n, chars, vector)`` of ``pages(host, page, html)``, summed over each host.

    ``path`` is null for text; ``chars`` is the text outside links that an element holds directly.
    """
    schema = "host string, token bigint, path string, pages bigint, n bigint, chars bigint, vector decimal(20,0)"

    def run(batches):
        parser, held = Parser(), {}

        def flush():
            rows = [(h, k, *v) for (h, k), v in held.items()]
            held.clear()
            c = list(zip(*rows)) or [()] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(c, types)]
            arrays[6] = arrays[6].cast(pa.decimal128(20, 0))
            return pa.RecordBatch.from_arrays(arrays, ["host", "token", "path", "pages", "n", "chars", "vector"])

        for batch in batches:
            for host, page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own: dict[int, list] = {}
                for kind, element, text in parser.events(source.as_py() or ""):
                    if kind == 0:
                        got = own.setdefault(element.key, [element.path, 0, 0])
                        got[1] += 1
                    elif kind == 1 and not text.isspace():
                        own.setdefault(text_key(element, text), [None, 0, 0])[1] += 1
                        block = element
                        while block.inline and block.parent is not None:
                            block = block.parent
                        if not element.link and block.key in own:
                            own[block.key][2] += len(text)
                for key, (path, n, chars) in own.items():
                    mark = xxhash.xxh64_intdigest(b"%d:%d" % (page, n)) >> 4
                    got = held.get((host, key))
                    if got is None:
                        held[host, key] = [path, 1, n, chars, mark]
                    else:
                        got[1] += 1
                        got[2] += n
                        got[3] += chars
                        got[4] = (got[4] + mark) % (1 << 60)
                if len(held) > HELD_TOKENS:
                    yield flush()
        yield flush()

    sums = pages.select("host", "page", "html").mapInArrow(run, schema).groupBy("host", "token")
    return sums.agg(
        F.first("path", ignorenulls=True).alias("path"), F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        F.pmod(F.sum("vector"), F.lit(1 << 60)).cast("bigint").alias("vector"),
    )


def deduce(tokens: pd.DataFrame) -> tuple[list[str], list[int]]:
    """Content paths and template texts of a host from its frequent tokens.

    A class is kept if it is large (two tokens or more); of its tags only those nest whose
    parent is template too. Content: the template's best marked element (article, main, or a
    class that says so); without one, the smallest element with most of the host's text.
    """
    size = tokens.groupby("vector")["token"].transform("size")
    large = tokens[size >= 2]
    paths = set()
    tags = large[large["path"].notna()]
    for path in sorted(tags["path"], key=lambda p: p.count("/")):
        above = path.rpartition("/")[0]
        if not above or above in paths:
            paths.add(path)
    texts = large[large["path"].isna()]["token"].tolist()
    marked = {}
    for path in paths:
        element = element_of(path)
        if element.content and (element.parent is None or element.parent.content < element.content):
            marked.setdefault((not element.wrapped, element.content), []).append(path)
    if marked and max(marked)[0]:
        return sorted(marked[max(marked)]), texts
    chars, wrapped, outside = {}, 0, 0
    every = tokens[tokens["path"].notna()]
    for path, n in zip(every["path"], every["chars"]):
        element = element_of(path)
        if n and not element.noise:
            wrapped, outside = wrapped + n * element.wrapped, outside + n * (not element.wrapped)
            if element.wrapped:
                continue
            while path:  # also what fills a slot counts for the template around it
                if path in paths:
                    chars[path] = chars.get(path, 0) + n
                path = path.rpartition("/")[0]
    if marked and wrapped > outside:
        return sorted(marked[max(marked)]), texts
    whole = max(chars.values(), default=0)
    best = [p for p, n in chars.items() if whole and n >= 0.6 * whole]
    return ([max(best, key=lambda p: (p.count("/"), p))] if best else []), texts


def element_of(path: str) -> Element:
    """The role that a path names."""
    node = Element(None, "", "")
    for name in re.findall(r"/([^/\[]+)((?:\[[^\]]*\])*)", path):
        node = Element(node, *name)
    return node


def page_text(parser: Parser, source: str | None, roots: set[str], template: set[int]) -> str:
    """The article's blocks, one per line."""
    events = parser.events(source or "")
    opened = {e.path for kind, e, _ in events if kind == 0}
    roots = roots & opened
    if not roots:  # a page of another make than its host's others
        ranks = {e.path: (not e.wrapped, e.content) for kind, e, _ in events if kind == 0 and e.content and e.parent.content < e.content}
        best = max(ranks.values(), default=(False, 0))
        if not best[0]:  # wrapped articles only, or none
            sizes = [0, 0]
            for kind, e, text in events:
                if kind == 1 and not e.noise:
                    sizes[e.wrapped] += len(text.strip())
            if sizes[1] <= sizes[0]:
                ranks = {}
        roots = {p for p, rank in ranks.items() if rank == best} or {""}
    inside: dict[int, tuple[bool, bool]] = {}
    blocks, parts = [], []

    def place(element: Element) -> tuple[bool, bool]:
        """Whether an element lies below a root and is no noise; whether that root is marked as content."""
        got = inside.get(id(element))
        if got is None:
            if element.path in roots:
                got = (not element.noise, element.content > 0)
            elif element.parent is None:
                got = ("" in roots, False)
            else:
                above = place(element.parent)
                got = (above[0] and not element.noise, above[1])
            inside[id(element)] = got
        return got

    for kind, element, text in events:
        if kind == 1:
            taken, marked = place(element)
            if taken and (marked or not template or text_key(element, text) not in template):
                parts.append(text)
        elif kind == 2:
            if parts:
                blocks.append(parts)
                parts = []
        elif element.name == "br":
            parts.append(" ")
    blocks.append(parts)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(page_id, url, text)`` per row of ``pages``.

    Null and empty pages have an empty text. Pages without a readable url are a host of
    their own together. Hosts of fewer than ``min_pages`` pages have no template: only the
    marks on the page itself decide. Repeated rows stay repeated; an empty table gives an
    empty table; other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
        F.coalesce(F.regexp_extract(F.lower(url_col), _HOST, 1), F.lit("")).alias("host"),
    )
    tokens = token_rows(rows.select("host", F.xxhash64("page_id", "url").alias("page"), "html"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    frequent = tokens.where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") >= F.lit(min_share) * F.col("total"))

    def template(key, frame):
        roots, texts = deduce(frame)
        return pd.DataFrame({"host": [key[0]], "roots": [roots], "texts": [texts]})

    found = kept(frequent.groupBy("host").applyInPandas(template, "host string, roots array<string>, texts array<bigint>"), "templates")
    number = found.agg(F.sum(F.size("roots") + F.size("texts"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if number <= BROADCAST_TOKENS else found, "host", "left")

    def run(batches):
        parser = Parser()
        for batch in batches:
            texts = [
                page_text(parser, source.as_py(), set(roots or ()), set(texts or ()))
                for source, roots, texts in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "roots", "texts").mapInArrow(run, "page_id bigint, url string, text string")
