"""Pages as a table of nodes, and the site rules that pick an article's parts from it.

A page becomes one row per element: number in document order, number of its parent and of its last descendant, depth,
tag, id, classes, attributes and text. With these a rule is a filter: the block that holds the article is a predicate,
its content is a predicate on nodes whose numbers lie within the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions.text import split_lines
from lingualoom.session import materialise

NODES = "page_id long, node int, parent int, last int, depth int, tag string, id string, classes array<string>, attrs map<string,string>, text string, parent_tag string, parent_classes array<string>"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag of the same kind closes.
_ALONE = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())


class _Builder(HTMLParser):
    """Collects elements; unclosed ones end with what holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        # The page's text in pieces; an element's text is what lies between the ends it has in it.
        self.pieces: list[str] = []
        self.size = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _ALONE:
            for k in range(len(self.open) - 1, -1, -1):
                above = self.rows[self.open[k]][3]
                if above == tag:
                    self._close(k)
                    break
                if above in ("ul", "ol", "div", "section", "article", "main", "table", "body", "nav", "aside", "footer"):
                    break
        own = {k: v or "" for k, v in attrs}
        n = len(self.rows)
        self.rows.append([self.open[-1] if self.open else -1, n, len(self.open), tag, own, self.size, self.size])
        if tag not in _VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][3] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        self.size += len(data)

    def _close(self, k: int) -> None:
        for n in self.open[k:]:
            self.rows[n][1] = len(self.rows) - 1
            self.rows[n][6] = self.size
        del self.open[k:]

    def finish(self) -> list[list]:
        """[parent, last, depth, tag, attributes, text] of every element."""
        self.close()
        self._close(0)
        text = "".join(self.pieces)
        return [[*r[:5], text[r[5] : r[6]]] for r in self.rows]


#: Nodes that one batch holds about.
_AT_ONCE = 20_000


def _batch(keys: list, rows: list[list], above: list) -> pa.RecordBatch:
    """A batch of nodes; ``above``: each one's parent, or None."""
    classes = lambda r: r[4].get("class", "").split() if r else []
    columns = [
        pa.array(keys, pa.int64()), pa.array([r[6] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4].get("id") for r in rows], pa.string()),
        pa.array(map(classes, rows), pa.list_(pa.string())), pa.array([list(r[4].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r[5] for r in rows], pa.string()),
        pa.array([r[3] if r else None for r in above], pa.string()), pa.array(map(classes, above), pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in NODES.split(", ")])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows, above = [], [], []
        for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            builder = _Builder()
            builder.feed(source)
            own = builder.finish()
            keys += [key] * len(own)
            rows += [[*r, k] for k, r in enumerate(own)]
            above += [own[r[0]] if r[0] >= 0 else None for r in own]
            if len(rows) >= _AT_ONCE:
                yield _batch(keys, rows, above)
                keys, rows, above = [], [], []
        if rows:
            yield _batch(keys, rows, above)


def nodes(pages: DataFrame) -> DataFrame:
    """One row per element of each page (page_id, html); pages without any element have no rows."""
    return pages.filter(F.col("html").isNotNull()).select("page_id", "html").mapInArrow(_parsed, NODES)


@dataclass(frozen=True)
class SiteRule:
    """Where a site keeps an article: the block, what of it counts, and whether only the block's children do."""

    block: Column
    content: Column
    children_only: bool = False


def _has(*classes: str) -> Column:
    found = F.array_contains("classes", classes[0])
    for c in classes[1:]:
        found = found & F.array_contains("classes", c)
    return found


def site_rules() -> dict[str, SiteRule]:
    """Rules by kind of markup. Tags, classes and ids by which sites mark an article."""
    tag = lambda *t: F.col("tag").isin(*t)
    under = lambda c: F.array_contains("parent_classes", c)
    main = tag("main") & F.col("id").contains("inhalt") & (F.col("attrs")["role"] == "main")
    return {
        "detail_page": SiteRule(
            tag("div") & _has("section", "sectionDetailPage", "cssBoxContent"),
            (tag("p") & (_has("text") | _has("einleitung"))) | (tag("span") & _has("headline") & (F.col("parent_tag") == "h1")) | (tag("ul") & (F.col("parent_tag") == "div") & under("paragraph")),
        ),
        "inner_boxes": SiteRule(
            tag("div") & _has("artikel_details"),
            (under("inhalt") & tag("p")) | (tag("ul") & under("paragraph")) | (tag("div") & _has("box_big") & under("inhalt")),
        ),
        "accordion": SiteRule(main, tag("p", "h2", "h3", "ul") & (F.col("parent_tag") == "div") & (under("accordionhead") | under("accordionpanel") | under("tinyblock"))),
        "copy": SiteRule(tag("div") & _has("copy"), tag("h1", "h2", "ul") | (tag("p") & _has("text")) | (tag("p") & (F.size("classes") == 0)), True),
        "content": SiteRule(tag("div") & _has("content"), tag("h1", "p", "h2", "ul") & ~_has("autor") & ~_has("bild"), True),
        "details": SiteRule(tag("div") & _has("artikel_details"), tag("h1", "h2", "p", "ul") & ~_has("autor") & ~_has("bild")),
        "main": SiteRule(tag("main") & (F.col("id") == "inhalt") & (F.col("attrs")["role"] == "main"), tag("h1", "h2", "h3", "p", "ul") & ~_has("autor") & ~_has("bild")),
        "article": SiteRule(tag("article") & _has("sectbody") & (F.col("attrs")["itemprop"] == "articleBody"), tag("h1", "h2", "h3", "h6", "p", "ul") & ~_has("autor") & ~_has("bild") & ~F.col("text").rlike("─{18}")),
    }


def split_by_colour(table: DataFrame) -> DataFrame:
    """(page_id, node, easy, text): paragraphs of pages that print both levels in one; red ones are the simple side.

    Fixed values: the blocks' classes and the style of the red. On the standard side a raised dot stands for a hyphen.
    """
    blocks = table.filter((F.col("tag") == "section") & _has("textblock", "container")).select("page_id", F.col("node").alias("first"), F.col("last").alias("end"))
    parts = table.filter(F.col("tag") == "p").join(blocks, "page_id").filter(F.col("node").between(F.col("first") + 1, F.col("end")))
    red = table.filter((F.col("tag") == "span") & (F.regexp_replace(F.coalesce(F.col("attrs")["style"], F.lit("")), r"\s", "") == "color:#ff0000;"))
    inside = parts.join(red.select("page_id", F.col("node").alias("span")), "page_id").filter(F.col("span").between(F.col("node") + 1, F.col("last"))).select("page_id", "node").distinct()
    marked = parts.select("page_id", "node", "text").distinct().join(inside.withColumn("easy", F.lit(True)), ["page_id", "node"], "left")
    easy = F.coalesce("easy", F.lit(False))
    return marked.select("page_id", "node", easy.alias("easy"), F.when(easy, F.col("text")).otherwise(F.replace("text", F.lit("·"), F.lit("-"))).alias("text"))


def extract(table: DataFrame, rules: dict[str, SiteRule]) -> DataFrame:
    """(page_id, rule, node, tag, text): the parts that the rules keep; pages with none or several blocks of a rule have none by it.

    All rules are tried in one pass over the nodes, of which those that any of them names are written once.
    """
    fits = lambda pick: F.array_compact(F.array(*[F.when(pick(r), F.lit(name)) for name, r in rules.items()]))
    named = table.select("page_id", "node", "parent", "last", "tag", "text", fits(lambda r: r.block).alias("block_of"), fits(lambda r: r.content).alias("part_of"))
    # Only parts need their text.
    named = named.filter((F.size("block_of") > 0) | (F.size("part_of") > 0)).withColumn("text", F.when(F.size("part_of") > 0, F.col("text")))
    named = materialise(named, "named_nodes")
    blocks = named.select("page_id", "node", "last", F.explode("block_of").alias("rule")).groupBy("page_id", "rule")
    blocks = blocks.agg(F.count("*").alias("n"), F.min("node").alias("first"), F.min("last").alias("end")).filter("n = 1").drop("n")
    parts = named.select("page_id", "node", "parent", "tag", "text", F.explode("part_of").alias("rule")).join(blocks, ["page_id", "rule"])
    only = F.col("rule").isin(*[name for name, r in rules.items() if r.children_only])
    within = F.when(only, F.col("parent") == F.col("first")).otherwise(F.col("node").between(F.col("first") + 1, F.col("end")))
    return parts.filter(within).select("page_id", "rule", "node", "tag", "text")


def extracted_lines(parts: DataFrame) -> DataFrame:
    """(page_id, rule, node, k, line): sentence-like lines of the parts, in order."""
    cut = parts.select("page_id", "rule", "node", F.posexplode(split_lines(F.col("text"))).alias("k", "line"))
    return cut


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, href): the different links of each page, by pattern, without building nodes."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^<>]*href="([^"]*)"'), F.lit(1))
    return pages.filter(F.col("html").isNotNull()).select("page_id", F.explode(F.array_distinct(found)).alias("href"))


@dataclass(frozen=True)
class CounterpartRule:
    """How a site links an article to the same one in the other language level.

    ``link``: the link itself; ``box``: what it has to stand in, if anything; ``inner``: what else has to stand in that box; ``several``: whether more than the first link counts.
    """

    link: Column
    box: Column | None = None
    inner: Column | None = None
    several: bool = False


def counterpart_rules() -> dict[str, CounterpartRule]:
    """Rules by the way of linking. Texts, titles, languages, classes and boxes by which sites mark the link."""
    attribute = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    tag = lambda t: F.col("tag") == t
    switch = _has("c-language-switch__l", "c-language-switch__l--as") & attribute("title").rlike("(?i)Lesen Sie den Artikel .* in Alltagssprache")
    return {
        "teaser": CounterpartRule(F.col("text").rlike("(?i)auch in schwerer Sprache"), tag("div") & _has("con", "cssBoxTeaserStandard", "conInline")),
        "top_menu": CounterpartRule(attribute("title") == "Auf Alltags-Sprache umstellen", tag("div") & _has("modul") & (F.col("id") == "mod_menue_top")),
        "switch": CounterpartRule(switch & (F.trim("text") == "Alltagssprache")),
        "language": CounterpartRule((attribute("hreflang") == "de-DE") & _has("underline", "easy") & F.col("text").rlike("(?i)Standardsprache")),
        "sentence": CounterpartRule(F.col("text").rlike("(?i)Diese Seite in Alltags-Sprache lesen")),
        "paragraph": CounterpartRule(F.lit(True), tag("p") & (F.size("classes") > 0) & (F.col("attrs")["xmlns"] == ""), tag("em"), True),
        "here": CounterpartRule((attribute("title") == "hier") & ~attribute("href").contains("einfache-sprache")),
        "read_also": CounterpartRule(F.col("text").rlike("^(Lesen Sie auch|Read more|Read also|See also)"), several=True),
    }


def counterpart_links(table: DataFrame, rules: dict[str, CounterpartRule]) -> DataFrame:
    """(page_id, rule, node, href, text): links that by a rule lead to the article in the other language level, in one pass over the nodes."""
    fits = lambda pick: F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, r in rules.items() if (c := pick(r)) is not None])).cast("array<string>")
    anchor = (F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()
    named = table.select("page_id", "node", "last", F.col("attrs")["href"].alias("href"), "text", fits(lambda r: anchor & r.link).alias("link_of"), fits(lambda r: r.box).alias("box_of"), fits(lambda r: r.inner).alias("inner_of"))
    named = named.filter((F.size("link_of") > 0) | (F.size("box_of") > 0) | (F.size("inner_of") > 0)).withColumn("text", F.when(F.size("link_of") > 0, F.col("text")))
    named = materialise(named, "counterparts")
    links = named.select("page_id", "node", "href", "text", F.explode("link_of").alias("rule"))
    boxed = F.col("rule").isin(*[name for name, r in rules.items() if r.box is not None])
    boxes = named.select("page_id", F.explode("box_of").alias("rule"), F.col("node").alias("first"), "last")
    inner = named.select("page_id", F.explode("inner_of").alias("rule"), F.col("node").alias("at"))
    needs = F.col("rule").isin(*[name for name, r in rules.items() if r.inner is not None])
    held = boxes.filter(needs).join(inner, ["page_id", "rule"]).filter(F.col("at").between(F.col("first") + 1, F.col("last"))).select(*boxes.columns).distinct()
    inside = links.filter(boxed).join(boxes.filter(~needs).unionByName(held), ["page_id", "rule"]).filter(F.col("node").between(F.col("first") + 1, F.col("last")))
    found = links.filter(~boxed).unionByName(inside.select(*links.columns).distinct())
    # Of a rule that takes one link only, the first of the page.
    several = F.col("rule").isin(*[name for name, r in rules.items() if r.several])
    some = found.filter(~several).groupBy("page_id", "rule").agg(F.min(F.struct("node", "href", "text")).alias("f")).select("page_id", "rule", "f.*")
    return found.filter(several).select(*some.columns).unionByName(some)
