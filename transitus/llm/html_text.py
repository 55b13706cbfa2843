"""Main text of web pages: a tree-structured graphical model over DOM blocks, solved by sum-product messages."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitus.llm.common import Shipped

# The model is trained on about so many pages, chosen by a hash of their id.
TRAIN_PAGES = 2_000
# Element names by their part in a page, and words of class, id and role that tell what a block is.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style head title noscript template svg math iframe object select textarea button canvas audio video".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br wbr img input area map".split()
)
KINDS = {
    "main": ["article", "main"],
    "aside": ["nav", "header", "footer", "aside", "form", "menu", "dialog"],
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6"],
    "paragraph": ["p", "blockquote", "pre", "figcaption", "dd", "dt"],
    "list": ["ul", "ol", "li", "dl"],
    "cell": ["table", "tbody", "thead", "tr", "td", "th"],
}
MAIN_WORDS = set("article main content post entry story articlebody hentry".split())
ASIDE_WORDS = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "contentinfo consent cookie cookies copyright disclaimer disqus footer gdpr header legal masthead menu nav navbar "
    "navigation newsletter notice pagination paywall popup promo promoted related reply respond replies search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
# What may stand in a head, and the start tags that end an unclosed svg or math element.
HEAD_TAGS = set("base basefont bgsound link meta title script style noscript noframes template".split())
FOREIGN = set("svg math".split())
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
# A class name that ends with one of these tells nothing, and one that starts with one of those says what is not there.
NEUTRAL = set("result results".split())
ABSENT = set("no not without has with hide hidden".split())
KIND_OF = {tag: kind for kind, tags in KINDS.items() for tag in tags}
# Evidence before any page is seen: counts (in the main text, outside) for values of a block's features.
PRIOR = {
    ("mark", "main"): (40, 1), ("mark", "aside"): (1, 40), ("mark", "none"): (4, 4),
    ("kind", "main"): (4, 1), ("kind", "aside"): (1, 4), ("kind", "heading"): (3, 2), ("kind", "paragraph"): (5, 2),
    ("kind", "list"): (2, 4), ("kind", "cell"): (2, 2), ("kind", "other"): (2, 2),
    ("links", 0): (6, 3), ("links", 1): (3, 3), ("links", 2): (1, 4), ("links", 3): (1, 8),
}
# How far one feature, and the tie between parent and child, may move the log odds.
MARK_LIMIT, FEATURE_LIMIT, TIE_LIMIT = 5.0, 1.2, 3.0
EXTRACTED = "text string, n_chars bigint"


class Block:
    __slots__ = ("chars", "kind", "linked", "mark", "parent", "pieces", "stops")

    def __init__(self, parent: int, kind: str, mark: str) -> None:
        self.parent, self.kind, self.mark = parent, kind, mark
        self.chars = self.linked = self.stops = 0
        self.pieces = 0


class Dom(HTMLParser):
    """Blocks of a page, parents first, and its text as (block, words) in page order.

    Inline elements belong to the block around them. A block ends an open paragraph; an end tag closes what is
    open inside its element, and is passed over where nothing of its name is open. What belongs into the body ends a
    head that is still open. Scripts, buttons and the like are left out of the text around them without parting it.
    Each tag is worked on once: time and memory go with the length of the page, however deep it is nested.
    """

    def __init__(self, html: str, plain: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.plain = plain
        self.blocks = [Block(-1, "other", "none")]
        self.open: list[tuple[str, int, bool]] = []  # name, block around it, whether its text is seen
        self.names: Counter[str] = Counter()  # how many of each name are open
        self.texts: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.block, self.seen, self.links = 0, True, 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        words = "".join(self.parts).split()
        self.parts.clear()
        if words:
            self.texts.append((self.block, " ".join(words)))
            self.blocks[self.block].pieces += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.names["head"] and not self.names["template"] and tag not in HEAD_TAGS and tag != "head":
            self.handle_endtag("head")
        if tag in BREAKOUT and not self.names["foreignobject"]:
            for name in FOREIGN:
                if self.names[name]:
                    self.handle_endtag(name)
        if not self.seen:
            # nothing in here is shown, so it makes no blocks
            if tag not in VOID:
                self.opened(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in UNSEEN:
            self.opened(tag)
            self.seen = False
            return
        if tag in INLINE:
            self.opened(tag)
            self.links += tag == "a"
            return
        self.flush()
        if self.names["p"]:
            self.handle_endtag("p")
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.handle_endtag("li")
        self.opened(tag)
        around = self.blocks[self.block]
        own = "none" if self.plain else self.mark_of(tag, attrs)
        kind = KIND_OF.get(tag, "other")
        if self.plain and kind in ("main", "aside"):
            kind = "other"
        self.blocks.append(Block(self.block, kind, own if own != "none" else around.mark))
        self.block = len(self.blocks) - 1

    def opened(self, tag: str) -> None:
        self.open.append((tag, self.block, self.seen))
        self.names[tag] += 1

    @staticmethod
    def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if KIND_OF.get(tag) == "aside":
            return "aside"
        votes = Counter()
        for name, value in attrs:
            # what is said of the whole page names none of its parts
            if name in ("class", "id", "role", "itemprop") and value and tag not in ("html", "body"):
                votes.update(Dom.part_of(token) for token in value.lower().split())
        if votes["aside"] != votes["main"]:
            return "aside" if votes["aside"] > votes["main"] else "main"
        return "main" if KIND_OF.get(tag) == "main" else "none"

    @staticmethod
    def part_of(token: str) -> str:
        """What a class name says: its last word first, then the words before, unless it says that they are absent."""
        words = [w for w in re.split(r"[^a-z]+", token) if w]
        if not words or words[0] in ABSENT or words[-1] in NEUTRAL:
            return "none"
        if words[-1] in ASIDE_WORDS or words[-1] in MAIN_WORDS:
            return "aside" if words[-1] in ASIDE_WORDS else "main"
        if any(w in ASIDE_WORDS for w in words):
            return "aside"
        return "main" if any(w in MAIN_WORDS for w in words) else "none"

    def handle_endtag(self, tag: str) -> None:
        if not self.names[tag]:
            return
        if self.seen and tag not in INLINE:
            self.flush()
        while self.open:
            name, around, seen = self.open.pop()
            self.names[name] -= 1
            if around != self.block:
                self.flush()
            self.block, self.seen = around, seen
            self.links -= name == "a" and seen
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.handle_endtag("head")
        if not self.seen:
            return
        self.parts.append(data)
        size = len(data) - data.count(" ")
        block = self.blocks[self.block]
        block.chars += size
        block.linked += size * (self.links > 0)
        block.stops += data.count(".") + data.count("!") + data.count("?")

    def unknown_decl(self, data: str) -> None:
        """Marked sections are markup."""


def described(dom: Dom) -> list[dict]:
    """For each block its features, from the text in it and below."""
    blocks = dom.blocks
    chars, linked, stops = ([getattr(b, name) for b in blocks] for name in ("chars", "linked", "stops"))
    for at in range(len(blocks) - 1, 0, -1):
        up = blocks[at].parent
        chars[up] += chars[at]
        linked[up] += linked[at]
        stops[up] += stops[at]
    return [
        {
            "mark": b.mark, "kind": b.kind,
            "links": 0 if not linked[k] else 1 + min(2, int(3 * linked[k] / max(1, chars[k]))),
            "size": min(12, chars[k].bit_length()),
            "stops": 0 if not stops[k] else 1 + min(3, int(100 * stops[k] / max(1, chars[k]))),
        }
        for k, b in enumerate(blocks)
    ]


class PageModel:
    """Log-odds of features and, by the child's kind, of the labels of parent and child."""

    def __init__(self, features: dict[tuple[str, object], tuple[float, float]], ties: dict[tuple[str, int, int], float]) -> None:
        counts = {key: list(value) for key, value in PRIOR.items()}
        for key, (inside, outside) in features.items():
            held = counts.setdefault(key, [1, 1])
            held[0] += inside
            held[1] += outside
        totals: dict[str, list[float]] = {}
        for (name, _), (inside, outside) in counts.items():
            total = totals.setdefault(name, [0.0, 0.0])
            total[0] += inside
            total[1] += outside
        self.odds = {}
        for (name, value), (inside, outside) in counts.items():
            limit = MARK_LIMIT if name == "mark" else FEATURE_LIMIT
            odds = np.log(inside / totals[name][0]) - np.log(outside / totals[name][1])
            self.odds[name, value] = float(np.clip(odds, -limit, limit))
        self.ties = {}
        for kind in [*KINDS, "other"]:
            for parent in (0, 1):
                same, change = (ties.get((kind, parent, child), 0.0) + 2 for child in (parent, 1 - parent))
                lean = float(np.clip(np.log(same / change), -TIE_LIMIT, TIE_LIMIT))
                stay = 1 / (1 + np.exp(-lean))
                self.ties[kind, parent] = (stay, 1 - stay) if parent == 0 else (1 - stay, stay)

    def marginals(self, dom: Dom) -> list[float]:
        """For each block the probability that its own text is main text: messages up to the root, then down."""
        blocks = dom.blocks
        own = []
        for features in described(dom):
            odds = sum(self.odds.get(item, 0.0) for item in features.items())
            p = 1 / (1 + np.exp(-odds))
            own.append((1 - p, p))
        belief = list(own)  # of a block and all below it
        message = [(1.0, 1.0)] * len(blocks)
        for at in range(len(blocks) - 1, 0, -1):
            block, (b0, b1) = blocks[at], belief[at]
            t0, t1 = self.ties[block.kind, 0], self.ties[block.kind, 1]
            m0, m1 = b0 * t0[0] + b1 * t0[1], b0 * t1[0] + b1 * t1[1]
            message[at] = (m0 / (m0 + m1), m1 / (m0 + m1))
            u0, u1 = belief[block.parent]
            u0, u1 = u0 * message[at][0], u1 * message[at][1]
            belief[block.parent] = (u0 / (u0 + u1), u1 / (u0 + u1))
        whole = list(belief)
        for at in range(1, len(blocks)):
            block = blocks[at]
            u0, u1 = (w / max(m, 1e-12) for w, m in zip(whole[block.parent], message[at], strict=True))
            t0, t1 = self.ties[block.kind, 0], self.ties[block.kind, 1]
            d0, d1 = belief[at][0] * (u0 * t0[0] + u1 * t1[0]), belief[at][1] * (u0 * t0[1] + u1 * t1[1])
            whole[at] = (d0 / (d0 + d1), d1 / (d0 + d1))
        return [w[1] for w in whole]

    def text(self, html: str) -> str:
        dom = Dom(html)
        inside = self.marginals(dom)
        return "\n".join(words for block, words in dom.texts if inside[block] >= 0.5)


def _labels(dom: Dom) -> list[int]:
    return [int(b.mark == "main") for b in dom.blocks]


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> PageModel:
    """Learns from pages that label themselves: those with a main or article block.

    Blocks under such a mark, and not under one of a menu, advert, form or the like, are main text. Every page
    counts twice, once with its marks hidden, so that what else tells main text from the rest is learned too.
    Counts by feature value and label are added up in Spark. Without a labelled page the prior evidence decides.
    """
    total = pages.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), "page_id"), F.lit(1_000_000)) < min(1.0, sample / max(total, 1)) * 1_000_000

    def count(batches):
        for batch in batches:
            sums: dict[tuple, int] = {}
            for html in batch["html"]:
                marked = Dom(html)
                labels = _labels(marked)
                if not any(labels):
                    continue
                for dom in (marked, Dom(html, plain=True)):
                    for block, label, features in zip(dom.blocks, labels, described(dom), strict=True):
                        for item in features.items():
                            sums["feature", *map(str, item), label] = sums.get(("feature", *map(str, item), label), 0) + 1
                        if block.parent >= 0:
                            tie = ("tie", block.kind, str(labels[block.parent]), label)
                            sums[tie] = sums.get(tie, 0) + 1
            yield pd.DataFrame([(*key, n) for key, n in sums.items()], columns=["what", "name", "value", "label", "n"])

    counted = (
        pages.filter(share & F.col("html").isNotNull()).select("html")
        .mapInPandas(count, "what string, name string, value string, label int, n bigint")
        .groupBy("what", "name", "value", "label").agg(F.sum("n").alias("n"))
    )
    features: dict[tuple[str, object], list[float]] = {}
    ties: dict[tuple[str, int, int], float] = {}
    for row in counted.collect():  # a few dozen feature values
        if row["what"] == "tie":
            ties[row["name"], int(row["value"]), row["label"]] = row["n"]
        else:
            value = int(row["value"]) if row["value"].isdigit() else row["value"]
            features.setdefault((row["name"], value), [0, 0])[1 - row["label"]] = row["n"]
    return PageModel({k: tuple(v) for k, v in features.items()}, ties)


def extractor(pages: DataFrame, model: PageModel):
    """A function from a column of html to a struct of `EXTRACTED`; a null html is empty."""
    held = Shipped(pages.sparkSession, model)

    @F.pandas_udf(EXTRACTED)
    def extract(htmls: pd.Series) -> pd.DataFrame:
        texts = [held.get().text(html or "") for html in htmls]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return extract


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    Blocks whose marginal is one half or more, each with its white space made single spaces, joined by newlines in
    page order. A null or empty html, or one without main text, gives an empty text; pages of any length and depth
    are read whole. Other columns are not looked at; an empty table gives an empty result.
    """
    found: Column = extractor(pages, train(pages))(F.col("html"))
    return pages.select("page_id", "url", found.alias("_found")).select("page_id", "url", "_found.*")
