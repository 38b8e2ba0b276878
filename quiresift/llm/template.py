"""Main text of web pages, by template deduction from equivalence classes.

A page is a row of tokens: tags told apart by their path of elements (with
classes and ids), and whole text blocks. For each host, tokens with the same
occurrence vector over the host's pages form an equivalence class; the vector
is held as a random linear sketch that pages add to, so a host's pages never
meet in one task. A class is valid if it is on most pages and has several
members; valid classes nest by the paths of their tags and make the host's
template. Text blocks of valid classes are the template's own. What stands
between its tags are slots. Pages with an article give the slots inside it.
For others, the walk goes down the template's containers while one of them has
most of the prose (text that varies, without links) of the one around it; the
slots in the last give the main text. Furniture (menus, headers, adverts,
forms and the like) is left out by its elements; names that speak of it count
below the article or the chosen container only.

Hosts with few pages take the classes of all hosts together.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresift.llm.sizes import fits
from quiresift.scratch import keep

#: Pages from which a host has a template of its own.
LEAST_PAGES = 8
#: A class is valid if it is on this share of pages, and has so many members.
SUPPORT, LEAST_MEMBERS = 0.8, 2
#: A container is gone into if it has this share of the prose of the one around it.
MAIN_SHARE = 0.6
#: Rows of deduced templates up to which they are broadcast, if their bytes are few; beyond, pages are joined with them by a shuffle.
BROADCAST_ROWS = 100_000
#: Stands for all hosts together.
ALL_HOSTS = ""

#: Elements of HTML, by what they are to the text. Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "fieldset", "head", "svg", "object", "video", "audio", "canvas", "menuitem"} | RAW
MAIN = {"article", "main"}
#: Elements that hold blocks: the walk down a template stands on these.
CONTAINERS = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td"} | MAIN
BOXES = CONTAINERS | {"h1"}
#: How much more prose counts outside elements that are named like furniture.
UNNAMED = 10
#: Words of class, id or role that speak of furniture wherever they stand in a name. Fixed values.
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "topbar", "toolbar",
    "comments", "disqus", "cookie", "cookies", "gdpr", "popup", "modal", "newsletter", "pagination", "pager", "contentinfo", "copyright",
}
#: Words that do only in names of such words and PLAIN_WORDS: "comment-list", but not "side-by-side". Fixed values.
FURNITURE_NAMES = {
    "sponsor", "promo", "promotion", "banner", "menu", "side", "aside", "widget", "header", "comment", "reply", "replies", "respond", "consent", "notice", "overlay",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "tags", "legal", "search", "skip", "complementary", "alert",
}
PLAIN_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "form", "frame", "group", "info", "inner", "item", "items", "left", "link", "links", "list",
    "main", "message", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper",
}
#: Names with one of these tell what something has or lacks: "has-sidebar", "ad-free". Fixed values.
STATE_WORDS = {"has", "with", "no", "non", "without", "free", "less", "is", "hide", "hidden", "show"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def speaks_of_furniture(name: str) -> bool:
    """Whether a class, id or role names a menu, an advert, comments or the like."""
    words = {w for w in WORD.findall(CAMEL.sub("-", name).lower()) if len(w) > 1}
    if words & STATE_WORDS:
        return False
    return bool(words & FURNITURE_WORDS or words & FURNITURE_NAMES and words <= FURNITURE_WORDS | FURNITURE_NAMES | PLAIN_WORDS)


class Element:
    """An open element: its path, whether text in it is furniture by its elements, of the article or of a link, and the path of the nearest element that is named like furniture."""

    __slots__ = ("boxes", "furniture", "link", "main", "marked", "name", "path")

    def __init__(self, name: str, label: str, above: Element | None, furniture: bool, named: bool):
        self.name = name
        self.path = f"{above.path}/{label}" if above else label
        self.main = name in MAIN or bool(above and above.main)
        self.furniture = furniture or bool(above and above.furniture)
        self.link = name == "a" or bool(above and above.link)
        self.marked = self.path if named else above.marked if above and name not in MAIN else ""
        self.boxes = (*(above.boxes if above else ()), *([self.path] if name in BOXES else ()))


def element(name: str, attributes: str, above: Element | None) -> Element:
    found = [(k.lower(), v.strip("\"'")) for k, v in NAMED.findall(attributes)] if attributes else []
    furniture = name in FURNITURE
    named = name not in MAIN and any(speaks_of_furniture(part) for _, v in found for part in v.split())
    if name == "header" and not (above and above.main):
        furniture = True
    if name in ("html", "body"):
        named = False
    label = name + "".join(f".{v}" for k, v in found if k == "class") + "".join(f"#{v}" for k, v in found if k == "id" and not re.search(r"\d", v))
    return Element(name, label.replace("/", "|"), above, furniture, named)


#: Elements that end an open one of the same kind when they begin. Fixed values.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


def parse(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """Tokens in page order: ("tag", element, ""), ("text", element, characters) and ("break", element, "").

    Open inline elements end with the block around them; a tag cut off by the
    end of the page is none.
    """
    stack: list[Element] = []
    at = 0
    raw = ""
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if raw:
            raw = ""
        if m.start() > at:
            yield "text", stack[-1] if stack else None, page[at : m.start()]
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[4]:
            break  # cut off
        top = stack[-1] if stack else None
        if m[1]:
            if name not in INLINE:
                yield "break", top, ""
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break  # inline ends do not reach over a block
            continue
        if name in VOID:
            if name in ("br", "hr"):
                yield "break", top, ""
            continue
        if name not in INLINE:
            yield "break", top, ""
            ends = ENDS.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in ends:
                    del stack[k:]
                    break
                if stack[k].name not in INLINE and not (name in ("td", "th", "tr") and stack[k].name in ("td", "th")):
                    break
        made = element(name, m[3], stack[-1] if stack else None)
        yield "tag", made, ""
        if m[3].endswith("/") and name not in RAW:
            continue
        stack.append(made)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", made, page[at:stop]
            at = end.end() if end else len(page)
            stack.pop()
    if at < len(page) and not page[at:].startswith("<"):
        yield "text", stack[-1] if stack else None, page[at:]
    elif at < len(page) and not re.match(r"<[/!?a-zA-Z]", page[at:]):
        yield "text", stack[-1] if stack else None, page[at:]


def tidy(parts: list[str]) -> str:
    return SPACE.sub(" ", references.unescape("".join(parts)).replace("\0", "")).strip()


def blocks(page: str) -> Iterator[tuple[str, Element | None, int]]:
    """(text, element, prose) of each block, and ("", element, 0) of each tag; prose: weight of its characters outside links."""
    parts: list[str] = []
    holder: Element | None = None
    prose = 0
    for kind, where, text in parse(page):
        if kind == "text":
            if parts and holder is not None and where is not None and (holder.furniture != where.furniture or holder.main != where.main or holder.marked != where.marked):
                if block := tidy(parts):
                    yield block, holder, prose
                parts, prose = [], 0
            if not parts:
                holder = where
            parts.append(text)
            if not (where and (where.link or where.furniture)):
                prose += len(text.strip()) * (1 if where and where.marked else UNNAMED)
        elif kind == "break":
            if parts and (block := tidy(parts)):
                yield block, holder, prose
            parts, prose = [], 0
        elif where is not None and where.name not in INLINE:
            yield "", where, 0
    if parts and (block := tidy(parts)):
        yield block, holder, prose


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: str | None) -> str:
    found = re.match(HOST, url or "")
    return found[1].lower() if found else "-"


def host_column():
    """host_of() of the column url."""
    found = F.lower(F.regexp_extract("url", HOST, 1))
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit("-")).otherwise(found)


def tokens_of(page: str) -> dict[str, list]:
    """Of each token, "t path" of a tag or "b path text" of a block: occurrences, path, prose.

    Containers and first headings have their path and the prose of all that is
    in them; blocks the path of the innermost of those around them and their own prose.
    """
    out: dict[str, list] = {}
    around: dict[str, int] = {}
    for text, where, prose in blocks(page):
        path, boxes = (where.path, where.boxes) if where else ("", ())
        if text:
            row = out.setdefault(f"b {path} {text}", [0, boxes[-1] if boxes else None, 0])
            row[2] += prose
            for box in boxes if prose else ():
                around[box] = around.get(box, 0) + prose
        else:
            row = out.setdefault(f"t {path}", [0, path if boxes and boxes[-1] == path else None, 0])
        row[0] += 1
    for path, prose in around.items():
        if row := out.get(f"t {path}"):
            row[2] = prose
    return out


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, kind, n, page, path, holder, prose): a row for each token of each page, with the page's number; tokens and holders of blocks as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, page in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, number = host_of(url), f"{page_id}|{url}"
                rows += [(host, token, n, number, path, prose) for token, (n, path, prose) in tokens_of(page or "").items()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "token", "n", "page", "path", "prose"])

    found = pages.mapInArrow(run, "host string, token string, n long, page string, path string, prose long")
    kind = F.substring("token", 1, 1)
    return found.select(
        "host",
        F.xxhash64("token").alias("token"),
        kind.alias("kind"),
        "n",
        F.xxhash64("page").alias("page"),
        F.when(kind == "t", F.col("path")).alias("path"),
        F.when((kind == "b") & F.col("path").isNotNull(), F.xxhash64(F.concat(F.lit("t "), "path"))).alias("holder"),
        "prose",
    )


def walk(prose: dict[str, int]) -> str:
    """The container with the main text, of a template's containers and first headings with their prose, by path; "" for the whole page.

    A container that a heading with prose stands beside is not gone into.
    """
    is_head = lambda p: re.match(r"h1(?![^.#])", p.rsplit("/", 1)[-1]) is not None
    heads = [p for p, n in prose.items() if is_head(p) and n > 0]
    nodes = [p for p in prose if not is_head(p)]
    within = lambda p, q: not q or p.startswith(f"{q}/")
    at = ""
    while True:
        under = [p for p in nodes if within(p, at)]
        children = [p for p in under if not any(p != q and within(p, q) for q in under)]
        best = max(children, key=lambda p: (prose[p], p), default=None)
        whole = prose[at] if at else sum(prose[p] for p in children)
        if best is None or prose[best] <= 0 or prose[best] < MAIN_SHARE * whole or any(within(h, at) and not within(h, best) for h in heads):
            return at
        at = best


def vectors_of(seen: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, one, two, on_pages, times, path, holder, prose): a sketch of each token's occurrence vector, of rows as from occurrences() or of such sketches.

    one and two are sums over pages of 31 random bits that the page and the
    token's count on it give: they add up in any order and hold 2**32 pages.
    """
    if "one" not in seen.columns:
        draw = lambda salt: F.pmod(F.xxhash64("page", "n", F.lit(salt)), F.lit(1 << 31))
        seen = seen.select(*keys, "kind", draw(1).alias("one"), draw(2).alias("two"), F.lit(1).cast("long").alias("on_pages"), F.col("n").alias("times"), "path", "holder", "prose")
    return seen.groupBy(*keys, "kind").agg(*[F.sum(c).alias(c) for c in ("one", "two", "on_pages", "times", "prose")], *[F.min(c).alias(c) for c in ("path", "holder")])


def deduce(pages: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT, least_members: int = LEAST_MEMBERS) -> DataFrame:
    """(host, block, main) of each host, and of ALL_HOSTS for hosts with few pages: a row for each text block in valid classes, as a hash, and one row without block that has the path of the container with the main text."""
    per_host = vectors_of(occurrences(pages), "host", "token")
    per_host = keep(per_host, "page-tokens")
    sizes = pages.groupBy(host_column().alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    everywhere = vectors_of(per_host, "token")
    total = pages.count()
    vectors = per_host.join(sizes, "host").where(F.col("pages") >= least_pages)
    overall = everywhere.select(F.lit(ALL_HOSTS).alias("host"), *[c for c in vectors.columns if c not in ("host", "pages")], F.lit(total).alias("pages")).where(F.col("pages") >= least_pages)
    # Tokens of one page are no template's, of a host or of all.
    frequent = vectors.select(overall.columns).union(overall).where((F.col("on_pages") >= 2) & (F.col("on_pages") >= F.col("pages") * support))
    # No more than an average page has, divided by the support.
    classes = frequent.groupBy("host", "on_pages", "times", "one", "two").agg(F.count(F.lit(1)).alias("members"), F.collect_list(F.struct("kind", "token", "path", "holder", "prose")).alias("tokens"))
    valid = keep(classes.where(F.col("members") >= least_members).select("host", F.explode("tokens").alias("t")).select("host", "t.*"), "page-classes")

    @F.udf("string")
    def main_of(tokens):
        paths = {t["token"]: t["path"] for t in tokens if t["kind"] == "t" and t["path"]}
        varying = {t["path"]: t["prose"] for t in tokens if t["kind"] == "t" and t["path"]}
        for t in tokens:
            if t["kind"] == "b" and (holder := paths.get(t["holder"])):
                for path in varying:
                    if holder == path or holder.startswith(f"{path}/"):
                        varying[path] -= t["prose"]
        return walk(varying)

    mains = valid.groupBy("host").agg(F.collect_list(F.struct("kind", "token", "path", "holder", "prose")).alias("tokens")).select("host", F.lit(None).cast("long").alias("block"), main_of("tokens").alias("main"))
    own = valid.where("kind = 'b'").select("host", F.col("token").alias("block"), F.lit(None).cast("string").alias("main")).distinct()
    return own.union(mains)


def main_text(page: str, template: set[int], hash_of, main: str = "") -> str:
    """Text of the article's slots; without an article, of the slots in ``main``, or of all where the page has none; furniture left out."""
    found = [(text, where) for text, where, _ in blocks(page) if text and not (where and where.furniture)]
    plain = [(text, where) for text, where in found if not (where and where.marked)]
    if any(where is not None and where.main for _, where in plain):
        found = [(text, where) for text, where in plain if where is not None and where.main]
    else:
        inner = [(text, where) for text, where in found if main and where is not None and (where.path == main or where.path.startswith(f"{main}/"))]
        found = [(text, where) for text, where in inner if len(where.marked) <= len(main)] if inner else plain
    if template:
        found = [(text, where) for text, where in found if hash_of(f"b {where.path if where else ''} {text}") not in template]
    return " ".join(text for text, _ in found)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, support: float = SUPPORT) -> DataFrame:
    """One row a row of ``pages``: page_id, url, text, n_chars.

    Character references are decoded, white space in a block is one space,
    blocks are joined in page order by one space. Null and empty pages have no
    text. Pages without a URL, or with one that has no host, are one host.
    Rows that repeat are pages like others; ids may be null; other columns play
    no part; an empty table gives no rows.
    """
    import xxhash

    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    template = keep(deduce(base, least_pages, support), "templates")
    small = fits(template, BROADCAST_ROWS)
    # Blocks on most of all pages are no more than an average page has, divided by the support: those always go along.
    held_here = template if small else template.where(F.col("host") == ALL_HOSTS)
    sent = base.sparkSession.sparkContext.broadcast([(r["host"], r["block"], r["main"]) for r in held_here.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = lambda token: int.from_bytes(xxhash.xxh64(token.encode(), seed=42).digest(), "big", signed=True)  # noqa: E731  as Spark's xxhash64
        by_host: dict[str, set[int]] = {}
        mains: dict[str, str] = {}
        for host, block, main in sent.value:
            if block is None:
                mains[host] = main
            else:
                by_host.setdefault(host, set()).add(block)
        for batch in batches:
            names = batch.schema.names
            own, own_main = (batch.column(c).to_pylist() if c in names else [None] * batch.num_rows for c in ("template", "main"))
            texts = []
            for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                host = host_of(url)
                held = set(own[i] or ()) | by_host.get(host, set()) | by_host.get(ALL_HOSTS, set())
                main = own_main[i] if own_main[i] is not None else mains.get(host, mains.get(ALL_HOSTS, ""))
                texts.append(main_text(page or "", held, hash_of, main))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    if not small:
        listed = template.groupBy(F.col("host").alias("of")).agg(F.collect_list("block").alias("template"), F.max("main").alias("main"))
        base = base.withColumn("host", host_column()).join(listed, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "template", "main")
    kind = base.schema["page_id"].dataType.simpleString()
    return base.mapInArrow(run, f"page_id {kind}, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
