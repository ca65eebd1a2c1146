"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each block has its word count, its link density and those of the blocks
before and after it, and how it lies in the page: in an article, or in an element that its name calls a menu, a side bar and the like, how
sure that name is, and which share of the page's words and links that element holds. A decision tree fitted on a small table of
labelled pages says which blocks are main text; the tree is compiled into a Spark column expression that filters the block list.

No name decides by itself, and none counts if its element holds the main or the longest article. Attributes are read one by one; a quotation mark counts only
where a value begins. Text in a link is linked text also if the link holds whole blocks. Elements that are not shown (scripts, styles, hidden ones) give no text.

Null html is an empty page with an empty text. Null urls and ids and repeated rows are kept; other columns are ignored;
an empty table gives no rows. Pages that end inside a tag or leave elements open are read as far as they go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm.html_labelled import labelled_pages

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template svg title textarea iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article aside blockquote button center details dialog div dl fieldset figure footer form header main menu nav ol section select table ul p li h1 h2 h3 h4 h5 h6 dd dt tr td".split())
WHOLE_PAGE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph are block elements; these end one another as well.
SIBLINGS = {"li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")), "td": frozenset(("td",)), "tr": frozenset(("tr", "td"))}

# Elements and names of menus, headers, footers, side bars, notices, adverts, forms and reader comments.
ASIDES = frozenset("aside button dialog fieldset footer menu nav select".split())
#: Names that hardly mean anything else; a name of several words counts by its first and last one.
SURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe popup overlay modal sidebar sidebars rail widget widgets breadcrumb breadcrumbs "
    "menu menus nav navbar navigation toolbar pagination pager masthead footer colophon comment comments disqus complementary contentinfo paywall".split()
)
#: Names that may be the subject of a text as well.
OTHER_WORDS = frozenset("promotion notice notices notification alert subscription signup related recommended share sharing social header reply replies respond response responses discussion login register search skip form disclaimer posts".split())
#: Elements whose ids are made from their own words or are targets of links.
NAMED_BY_TEXT = HEADINGS | frozenset("p li dt dd".split())
ASIDE_HEADING = re.compile(
    r"[\W\d]*(?:comments?|(?:leave|post|write|add) (?:an? |your )?(?:reply|comment|response)|replies|responses|related(?: (?:articles|posts|stories|links|news|content|pages))?|you (?:may|might) also .*|recommended(?: .*)?|"
    r"most read|read (?:more|next)|share(?: (?:this|on) .*)?|(?:subscribe|sign up)(?: .*)?|newsletter|log ?in|register|advertisements?|sponsored(?: .*)?|navigation|menu)\W*", re.I
)
#: How sure the name of an element is: none, may be a subject, a name of several words or a form, an aside.
NO_NAME, SUBJECT, COMPOUND, SURE = range(4)

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "in_article", "page_has_article", "name", "name_share", "name_links", "name_says",
)


def attributes_at(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from behind its name on (the first of each name counts), and where the tag ends."""
    found: dict[str, str] = {}
    end = len(page)
    while at < end:
        if page[at] == ">":
            return found, at + 1
        if not (attribute := ATTRIBUTE.match(page, at)):
            # Only blanks and slashes are left before the end of the tag.
            close = page.find(">", at)
            return found, close + 1 if close >= 0 else end
        value = attribute[2] or ""
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        found.setdefault(attribute[1].lower(), html.unescape(value[1:-1] if quoted else value))
        at = attribute.end()
    return found, end


def name_level(name: str) -> int:
    """How surely one class, role or id names an aside."""
    if name in SURE_WORDS:
        return SURE
    words = re.split(r"[^a-z0-9]+", name)
    if words[0] in SURE_WORDS or words[-1] in SURE_WORDS:
        return COMPOUND
    return SUBJECT if any(word in SURE_WORDS or word in OTHER_WORDS for word in words) else NO_NAME


def element_level(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """How surely an element is an aside by its kind and its names."""
    if tag in WHOLE_PAGE and not (tag == "article" and "class" in attributes):
        return NO_NAME
    level = SURE if tag in ASIDES else COMPOUND if tag == "form" else NO_NAME
    names = [*attributes.get("class", "").lower().split(), *attributes.get("role", "").lower().split()] if tag not in HEADINGS else []
    header = tag == "header" or any(name == "header" or name.endswith("-header") for name in names) or attributes.get("id", "").lower().endswith("header") and tag not in NAMED_BY_TEXT
    if header and not in_article:
        level = max(level, SURE if tag == "header" else COMPOUND)
    for name in names:
        if not (name == "header" or name.endswith("-header")):
            level = max(level, name_level(name))
    if tag not in NAMED_BY_TEXT and (name := attributes.get("id", "").lower()) and not name.endswith("header"):
        by_id = name_level(name)
        # Sections are often called after their heading.
        level = max(level, min(by_id, SUBJECT) if tag == "section" and name not in ("comments", "comment") else by_id)
    if tag == "article":
        # An article is one unless it is called a comment and the like.
        return level if level == SURE else NO_NAME
    return level


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", "")


class Element:
    """An element that blocks may lie in: its place among the named elements around it, and what it holds."""

    __slots__ = ("above", "level", "words", "linked", "first", "is_article", "held")

    def __init__(self, above: Element | None, level: int, is_article: bool):
        self.above, self.level, self.is_article = above, level, is_article
        self.words, self.linked, self.first, self.held = 0, 0.0, None, False


def page_blocks(page: str | None) -> list[dict]:
    """Text blocks in page order with their features."""
    page = page or ""
    blocks: list[dict] = []
    # Tag, innermost element that matters, hidden or not.
    stack: list[tuple[str, Element | None, bool]] = []
    elements: list[Element] = []
    pieces: list[str] = []
    linked: list[str] = []
    link_depth, heading, at = -1, False, 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                in_link = " ".join(html.unescape("".join(linked)).split())
                blocks.append({"text": text, "words": len(text.split(" ")), "links": min(1.0, len(in_link) / len(text)), "heading": float(heading), "at": stack[-1][1] if stack else None})
            pieces.clear()
            linked.clear()

    def put(text: str) -> None:
        if not (stack and stack[-1][2]):
            pieces.append(text)
            if link_depth >= 0:
                linked.append(text)

    def close(depth: int) -> None:
        nonlocal link_depth
        del stack[depth:]
        if link_depth > depth:
            link_depth = -1

    while token := TOKEN.search(page, at):
        if token.start() > at:
            put(page[at : token.start()])
        at = token.end()
        closing, tag = token[1], (token[2] or "").lower()
        if not tag:
            continue
        attributes, at = attributes_at(page, at)
        if tag in RAW:
            if not closing and page[at - 2 : at] != "/>":
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            put(" ")
        if tag == "a":
            link_depth = len(stack) if not closing and "href" in attributes else -1
        if tag in HEADINGS:
            heading = not closing
        hidden = not closing and is_hidden(attributes)
        if tag not in CONTAINERS and not (tag == "span" and (closing or hidden)):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in BLOCKS or tag == "td":
            # A block element ends an open paragraph, an item ends the one before.
            while stack and (stack[-1][0] in ("p", "span") and tag in BLOCKS or stack[-1][0] in SIBLINGS.get(tag, ())):
                close(len(stack) - 1)
        _, above, was_hidden = stack[-1] if stack else ("", None, False)
        in_article = above is not None and above.held
        level = element_level(tag, attributes, in_article)
        is_article = tag in ("article", "main")
        if level or is_article:
            above = Element(above, level, is_article)
            above.held = is_article or in_article
            elements.append(above)
        stack.append((tag, above, was_hidden or hidden))
    put(page[at:])
    flush()
    return with_features(blocks, elements)


def with_features(blocks: list[dict], elements: list[Element]) -> list[dict]:
    total = sum(block["words"] for block in blocks)
    for block in blocks:
        around = block["at"]
        while around is not None:
            around.words += block["words"]
            around.linked += block["links"] * block["words"]
            around.first = around.first or block
            around = around.above
    # The longest article or main; names of elements around it mean the page.
    around = max((e for e in elements if e.is_article), key=lambda e: e.words, default=None)
    while around is not None:
        around.level = NO_NAME
        around = around.above
    for k, block in enumerate(blocks):
        before, after = (blocks[k - 1] if k else None), (blocks[k + 1] if k + 1 < len(blocks) else None)
        around, named = block.pop("at"), None
        block["in_article"] = float(around is not None and around.held)
        while around is not None:
            if around.level and (named is None or around.level >= named.level):
                named = around
            around = around.above
        says = named is not None and named.first is not None and ASIDE_HEADING.fullmatch(named.first["text"]) is not None
        block |= {
            "words_before": before["words"] if before else 0, "links_before": before["links"] if before else 0.0, "words_after": after["words"] if after else 0, "links_after": after["links"] if after else 0.0,
            "page_has_article": float(any(e.is_article for e in elements)), "name": float(named.level if named else NO_NAME), "name_share": named.words / total if named else 0.0,
            "name_links": named.linked / named.words if named and named.words else 0.0, "name_says": float(says),
        }
    return blocks


def tree_column(described: str, value) -> Column:
    """A fitted tree (its printed form) as a column expression over ``value(feature)``; true for class 1."""
    lines = [line for line in described.splitlines()[1:] if line.strip()]

    def node(k: int) -> tuple[Column, int]:
        if said := re.match(r"\s*Predict: ([\d.]+)", lines[k]):
            return F.lit(float(said[1]) == 1.0), k + 1
        said = re.match(r"\s*If \(feature (\d+) <= ([-+.\deE]+)\)", lines[k])
        left, k = node(k + 1)
        right, k = node(k + 1)
        return F.when(value(FEATURES[int(said[1])]) <= float(said[2]), left).otherwise(right), k

    return node(0)[0]


def fit_tree(spark: SparkSession, labelled: list[str] | None = None, depth: int = 10) -> str:
    """The printed form of the tree fitted on the labelled pages (``labelled_pages()`` unless given)."""
    pages = labelled_pages() if labelled is None else labelled
    rows = [tuple(float(b[f]) for f in FEATURES) + (float(b["text"].startswith("+")),) for page in pages for b in page_blocks(page)]
    table = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in (*FEATURES, "label"))).coalesce(1)
    learner = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=4, seed=7)
    return learner.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)).toDebugString


def list_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, url, blocks``: the block list of every page with its features."""
    numbers = [(f, pa.float64()) for f in FEATURES]
    kind = pa.list_(pa.struct([("text", pa.string()), *numbers]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                blocks = [[{"text": b["text"], **{f: float(b[f]) for f in FEATURES}} for b in page_blocks(p.as_py())] for p in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(blocks, kind)], ["page_id", "url", "blocks"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    fields = ", ".join(["text: string", *(f"{f}: double" for f in FEATURES)])
    return rows.mapInArrow(run, f"page_id bigint, url string, blocks array<struct<{fields}>>")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``."""
    tree = fit_tree(pages.sparkSession)
    kept = F.filter("blocks", lambda b: tree_column(tree, lambda f: b[f]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return list_blocks(pages).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
