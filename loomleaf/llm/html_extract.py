"""Main text of web pages by site style trees.

Each page's DOM is reduced to text blocks; a block's node is the path of its block-level ancestors with their classes
(its presentation). The pages of a host, each different page once, are merged into a tree of such nodes. A node's
importance is the entropy of the contents that pages show there, against the entropy of as many different contents as
there are pages, and what its presentation adds: PRESENTED within an article or main element, less HINTED where an
element's tag, role or class names navigation, adverts, comments and the like. Branches of low importance are cut from
every page: menus and notices that say the same on each page whatever they are called, and hinted ones also where they
say something else each time (an advert). Nothing but what shows no text at all (scripts, styles, heads, controls,
hidden elements) is left out before.

A hint doesn't count for an element that holds the page's main element, or (other than site headers, menus and
footers) its first-level heading: what wraps the article isn't an advert, whatever its class.

Defined results: a null html counts as empty and gives an empty text; at nodes that fewer than FEWEST different pages
of the host have, entropy says nothing and presentation decides alone; null or odd URLs share one host ''; repeated
rows stay, each with its text; empty tables give empty results; columns named host, text or n_chars are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, stored

FEWEST, IMPORTANCE, PRESENTED, HINTED, SHARES = 5, 0.3, 0.2, 1.0, 16
#: So many branches (16 bytes each, and their hosts) are broadcast.
FEW = 100_000
#: Begins the path of a node that a hint speaks against.
MARK = "!"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("script style noscript template button select option textarea input iframe svg canvas object head title audio video".split())
HINTS = frozenset("nav footer aside form dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTENT = frozenset("article main body html h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMED = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menus?|side-?bar|ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|"
    r"notifications?|alerts?|pop-?ups?|modals?|overlays?|comments?|commentlist|disqus|replies|reviews|responses|respond|share|sharing|social|newsletter|subscribe|signup|"
    r"breadcrumbs?|footer|header|masthead|topbar|related|recommend(?:ed|ations)?|widgets?|pagination|pager|toolbar|skip-?links?|search(?:-?form|-?box)?|login)(?:$|[-_\s\d])",
    re.I,
)

#: Classes that only tell of a sidebar or the like, and headers of content.
NO_HINT = re.compile(r"^(?:no|has|with|without)[-_]|^(?:article|post|entry|page|content|section|story)[-_]+header$", re.I)
SITE_HEADER = re.compile(r"header|masthead|topbar|banner|nav|menu|footer", re.I)


def hinted(label: str) -> str:
    """The first of an element's classes and ids that names something else than main text, or an empty string."""
    return next((w for w in label.split() if NAMED.search(w) and not NO_HINT.search(w)), "")


class Page(HTMLParser):
    """Text blocks of a page: (path of the node, within an article, hints that speak against it, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, path, without text, within an article, numbers of the hints that speak against it.
        self.open: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
        #: Of each hint whether a first-level heading within makes it void; those that are void.
        self.hints: list[bool] = []
        self.void: set[int] = set()
        self.blocks: list[tuple[str, bool, tuple[int, ...], str]] = []
        self.text: list[str] = []

    def flush(self):
        if self.text:
            words = "".join(self.text).split()
            _, path, never, main, against = self.open[-1]
            if words and not never:
                self.blocks.append((path, main, against, " ".join(words)))
            self.text.clear()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        # Inline elements matter if they hide their content.
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        label = f"{named.get('class', '')} {named.get('id', '')}".strip()
        content = tag in CONTENT and not re.search("comment|repl", label, re.I)
        silent = tag in NEVER or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
        word = "" if content else hinted(label)
        hint = tag in HINTS or named.get("role", "").lower() in ROLES or bool(word)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        # Within a hidden inline element all inline elements are kept track of, so that its own end is found.
        if tag in INLINE and not silent and not hint and self.open[-1][0] not in INLINE:
            return
        self.flush()
        if tag in CLOSES_P:
            self.close_to(("p",), ("article", "section", "div", "td", "li", "blockquote", "main", "aside", "body", "button"))
        elif tag in SIBLINGS:
            self.close_to(SIBLINGS[tag], ("ul", "ol", "dl", "table", "select", "article", "main"))
        _, path, never, main, against = self.open[-1]
        if not hint and tag in ("main", "h1"):
            self.void.update(k for k in against if tag == "main" or self.hints[k])
        if hint or (tag == "header" and not main):
            self.hints.append(tag == "form" or (bool(word) and tag not in HINTS and (main or not SITE_HEADER.search(word))))
            against = (*against, len(self.hints) - 1)
        self.open.append((tag, f"{path}>{tag}{'.' + re.sub(r'[0-9]+', '', label) if label else ''}", never or silent, main or tag in ("article", "main"), against))

    def close_to(self, tags, stop):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag):
        if tag == "p" or tag not in INLINE:
            self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.flush()
                del self.open[k:]
                return

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.text.append(data)


def blocks(html: str) -> list[tuple[str, bool, str]]:
    """(path of the node, within an article, text) of a page's blocks; a path begins with MARK where a hint speaks against the node."""
    page = Page()
    page.feed(html)
    page.close()
    page.flush()
    return [(MARK + path if any(k not in page.void for k in against) else path, main, text) for path, main, against, text in page.blocks]


def extract(df: DataFrame, html: str = "html", url: str = "url", hint: float = HINTED, few: int = FEW) -> DataFrame:
    """df without `html`, with host, text and n_chars. hint: what a hint takes from a node's importance; few: up to how many cut branches are broadcast."""
    from xxhash import xxh64_intdigest

    rest = [c for c in df.columns if c not in (html, "host", "text", "n_chars")]
    page, nodes_, row, cut_, page_row = fresh(df.columns, "_html", "_blocks", "_row", "_cut", "_page_row")
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    held = df.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias(page))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    kind = pa.list_(pa.struct([("path", pa.int64()), ("content", pa.int64()), ("sure", pa.bool_()), ("hint", pa.bool_()), ("text", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        def signed(x: str) -> int:
            return xxh64_intdigest(x.encode()) - (1 << 63)

        rows = [[{"path": signed(p), "content": signed(t), "sure": s, "hint": p.startswith(MARK), "text": t} for p, s, t in blocks(h)] for h in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], [*rest, "host", nodes_])

    parsed = map_arrow(held, run, f"{kinds}, {nodes_} array<struct<path:long,content:long,sure:boolean,hint:boolean,text:string>>")
    parsed = stored(parsed.withColumn(row, F.monotonically_increasing_id()), "pages")
    # Copies of a page count once in the tree, as a single digest of its contents tells them apart.
    pages = parsed.select("host", F.transform(nodes_, lambda b: F.struct(b["path"], b["content"], b["sure"], b["hint"])).alias("nodes")).groupBy("host", F.xxhash64("nodes").alias("page")).agg(F.first("nodes").alias("nodes"))
    shown = pages.select("host", "page", F.inline("nodes")).toDF("host", "page", "path", "content", "sure", "hint")
    each = shown.distinct().groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("n"), F.max("sure").alias("sure"), F.max("hint").alias("hint"))
    nodes = each.groupBy("host", "path").agg(F.sum("n").alias("shown"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"), F.max("sure").alias("sure"), F.max("hint").alias("hint"))
    told = F.when(F.col("shown") >= FEWEST, F.col("entropy") / F.log("shown")).otherwise(1.0)
    importance = told + F.when(F.col("sure"), PRESENTED).otherwise(0.0) - F.when(F.col("hint"), hint).otherwise(0.0)
    low = nodes.where(importance < IMPORTANCE).select("host", "path")
    low = stored(low, "low")
    if low.limit(few + 1).count() <= few:
        # The tree's cut branches are few: they go to the pages, whose texts stay where they are.
        trimmed = parsed.join(F.broadcast(low.groupBy("host").agg(F.collect_set("path").alias(cut_))), "host", "left")
    else:
        # A node of a large host meets its pages in several groups.
        there = parsed.select(F.col(row).alias(page_row), "host", F.explode(F.array_distinct(F.transform(nodes_, lambda b: b["path"]))).alias("path")).withColumn("share", F.pmod(F.col(page_row), F.lit(SHARES)))
        dealt = low.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        cut = there.join(dealt, ["host", "path", "share"]).groupBy(page_row).agg(F.collect_set("path").alias(cut_))
        trimmed = parsed.join(cut, parsed[row] == cut[page_row], "left")
    left = F.when(F.col(cut_).isNull(), F.col(nodes_)).otherwise(F.filter(nodes_, lambda b: ~F.array_contains(cut_, b["path"])))
    text = F.array_join(F.transform(left, lambda b: b["text"]), " ")
    return trimmed.select(*[F.col(f"`{c}`") for c in rest], "host", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
