"""Main-text extraction by consensus paths of each host.

1. Every page's containers are scored: a block of text gives its characters
   outside links to the container around it and half of them to the one above.
   The best container is the page's candidate, or the article or main element
   around it, or else the highest container above it whose text beside it is
   mostly outside links (the body only if that is a quarter of its text or more,
   for the lines of a page's frame are no article); its path is the chain of tags and classes from the root, with
   digits generalised.
2. Pages vote: Spark counts pages and characters per host and path; the path
   with the most pages wins its host (then characters, then the path's order).
3. Every page is read again and gives the text of the containers on its host's
   winning path, or of its own candidate where it has none of them.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out, by tag, role, class or id. A form, or an element
whose class or id has such a word, stays if it holds the page: a main element,
or articles with most of the text in articles. Without article and main it stays
if it holds most of the text (a form) or all elements of its word four fifths of
it; inside an article or main element, nine tenths. There a name speaks of a
box only if all its words do (``ad-box``, not ``ad-hoc-note``), or if half of the
element's text is links. Boxes of comments and related pages only stay if they
hold a main element. Blocks are joined by a space in page order; white space
inside a block becomes one space. A page without a body tag has one implied; a
page is read in one pass, in time linear in its length, and to any depth.

Defined results: a null page or one without text gives an empty text; a null or
odd URL belongs to the host ''. Pages are read one by one, so copies have equal
results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stage

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that start a block of text and end an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section td".split())
SKIPPED = frozenset("aside button canvas datalist dialog footer head menu nav object select svg template".split()) | RAW
SKIPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of classes and ids that name something other than the article.
SKIPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices notification paywall popup promo"
    " promoted promotion promotions recommended related replies reply respond share sharing sidebar signup social sponsor"
    " sponsored subscribe toolbar widget widgets".split()
)
#: Words that may stand beside them in the name of a box inside an article.
BOX_WORDS = frozenset(
    "area bar bars block body bottom box boxes btn button buttons card container content form footer group hidden icon icons inline inner item items"
    " left link links list main media module outer overlay panel post posts right row section slot small space text top unit wrap wrapper".split()
)
NAMES_OF_BOXES = SKIPPED_WORDS | BOX_WORDS
#: Of SKIPPED_WORDS, those of boxes that may hold articles of their own.
OTHER_ARTICLES = frozenset("comment comments disqus recommended related replies reply respond".split())
#: Start tags that may stand in a head; any other one ends it, and text does.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A class such as has-sidebar or comments-open speaks of the page, not of the element.
OF_PAGE_FIRST = frozenset("has is no not with without".split())
OF_PAGE_LAST = frozenset("closed disabled enabled off on open".split())
#: Open elements that an opening tag closes, up to the element that bounds the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
#: Labels told in a path; those above them are told by a digest.
PATH_LABELS = 24
MIN_BLOCK = 20

_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)""")
_unquoted = re.compile(r"""[^>"']*+""")
_attribute = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
ATTRIBUTES = frozenset("class id role hidden aria-hidden".split())
_words = re.compile(r"[a-z]+")
_comment_end = re.compile(r"--!?>")


class Element(NamedTuple):
    tag: str
    skipped: bool
    container: int  # the container this element is or stands in
    region: int  # the form or word-matched element this element is or stands in
    article: bool  # it is or stands in an article or main element of that region


class Region:
    """A form or word-matched element, and what stands in it."""

    def __init__(self, parent: int, words: frozenset[str], inside: bool):
        self.parent, self.words, self.inside = parent, words, inside  # inside an article of the parent
        self.main, self.chars, self.article_chars, self.link_chars = False, 0, 0, 0
        self.partly = False  # inside an article, named by other words too
        self.kept = True


class Tags:
    """Ends of the tags of a page, quoted values of any length included."""

    def __init__(self, html: str):
        self.html = html
        self.last = {q: html.rfind(q) for q in "\"'"}
        self.failed: set[int] = set()  # ends of values after which no tag ends, so that broken markup isn't read again

    def end(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at ``at``, or -1."""
        html, seen = self.html, []
        while True:
            at = _unquoted.match(html, at).end()
            if html.startswith(">", at):
                return at
            if at >= len(html) or self.last[html[at]] <= at:
                break
            at = html.find(html[at], at + 1) + 1
            if at in self.failed:
                break
            seen.append(at)
        self.failed.update(seen)
        return -1


class Page:
    """Containers and text blocks of one page."""

    def __init__(self, html: str):
        self.paths: list[str] = []  # of containers
        self.parents: list[int] = []
        self.tags: list[str] = []
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters outside links
        self._read(html)

    def _attributes(self, tag: str, raw: str) -> tuple[str, bool, set[str], bool]:
        """Label for the path; whether the element is left out; the words for
        which it is unless it holds the page; whether they stand among others in
        every name."""
        have = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _attribute.findall(raw) if k.lower() in ATTRIBUTES} if raw else {}
        skipped = tag in SKIPPED or "hidden" in have or have.get("aria-hidden") == "true" or have.get("role", "").lower() in SKIPPED_ROLES
        names = f"{have.get('class', '')} {have.get('id', '')}".lower()
        found: set[str] = set()
        partly = True
        if not skipped and tag not in ("body", "html", "article", "main"):
            for name in names.split():
                words = _words.findall(name)
                if words and words[0] not in OF_PAGE_FIRST and words[-1] not in OF_PAGE_LAST:
                    listed = SKIPPED_WORDS.intersection(words)
                    found |= listed
                    partly = partly and not (listed and NAMES_OF_BOXES.issuperset(words))
        classes = sorted(set(have.get("class", "").lower().split()))
        return ".".join([tag, *(re.sub(r"\d+", "#", c) for c in classes)]), skipped, found, partly

    def _read(self, html: str) -> None:
        stack: list[Element] = []
        labels: list[str] = []
        digests = [""]  # of all labels down to each depth, so that deep paths stay apart
        at_tag: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a tag
        at_block: list[int] = []  # and of those in BLOCK
        text: list[tuple[int, str, int]] = []  # of the open block: region, text, characters inside links
        links = 0
        raws: list[tuple[int, list[tuple[int, str, int]]]] = []  # container and text of each block
        regions = [Region(-1, frozenset(), False)]  # the first is the page
        end, at = len(html), 0
        tags = Tags(html)
        page = Element("", False, -1, 0, False)

        def close_block() -> None:
            if text:
                raws.append((stack[-1].container if stack else -1, text.copy()))
                text.clear()

        def pop(to: int) -> None:
            nonlocal links
            for e in stack[to:]:
                links -= e.tag == "a"
                at_tag[e.tag].pop()
                if e.tag in BLOCK:
                    at_block.pop()
            del stack[to:], labels[to:], digests[to + 1 :]

        def push(e: Element, label: str) -> None:
            nonlocal links
            links += e.tag == "a"
            at_tag[e.tag].append(len(stack))
            if e.tag in BLOCK:
                at_block.append(len(stack))
            stack.append(e)
            labels.append(label)
            digests.append(hashlib.md5(f"{digests[-1]}>{label}".encode("utf-8", "replace")).hexdigest())

        def last(names) -> int:
            return max((at_tag[t][-1] for t in names if at_tag[t]), default=-1)

        def contain(tag: str, parent: int) -> None:
            """The top of the stack becomes a container."""
            cut = [digests[-1 - PATH_LABELS]] if len(labels) > PATH_LABELS else []
            self.paths.append(">".join(cut + labels[-PATH_LABELS:]))
            self.parents.append(parent)
            self.tags.append(tag)
            stack[-1] = stack[-1]._replace(container=len(self.paths) - 1)

        def imply_body() -> None:
            """Text, and what may not stand in a head, stands in a body."""
            if not at_tag["html"]:
                push(Element("html", False, -1, 0, False), "html")
            push(Element("body", False, -1, 0, False), "body")
            contain("body", -1)

        def say(raw: str) -> None:
            if (not stack or stack[-1].tag in ("html", "head")) and raw.strip():
                if stack and stack[-1].tag == "head":
                    pop(len(stack) - 1)
                if not at_tag["body"]:
                    imply_body()
            here = stack[-1] if stack else page
            if not here.skipped:
                body = entities.unescape(raw)
                n = len(" ".join(body.split()))
                text.append((here.region, body, n if links else 0))
                regions[here.region].chars += n
                regions[here.region].link_chars += n if links else 0
                regions[here.region].article_chars += n * here.article

        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                say(html[at:])
                break
            if lt > at:
                say(html[at:lt])
            if html.startswith("<!--", lt):
                short = 1 if html.startswith(">", lt + 4) else 2 if html.startswith("->", lt + 4) else 0  # <!--> and <!--->
                stop = None if short else _comment_end.search(html, lt + 4)
                at = lt + 4 + short if short else stop.end() if stop else end
                continue
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
                continue
            if not (nxt.isascii() and nxt.isalpha() or nxt == "/" and html[lt + 2 : lt + 3].isalpha()):
                say("<")
                at = lt + 1
                continue
            name = _tag.match(html, lt)
            closing, tag = html[lt + 1 : lt + 2] == "/", name[2].lower() if name else ""
            stop = tags.end(name.end()) if name else -1
            if stop >= 0:
                raw, at = html[name.end() : stop], stop + 1
            else:
                stop = html.find(">", lt)
                raw, at = "", end if stop < 0 else stop + 1
            if closing:
                # What follows an end of body or html still belongs to the body; an
                # inline end tag doesn't close blocks.
                if tag in ("body", "html"):
                    close_block()
                elif at_tag[tag] and (tag in BLOCK or not at_block or at_block[-1] < at_tag[tag][-1]):
                    if tag in BLOCK:
                        close_block()
                    pop(at_tag[tag][-1])
                continue
            if stack and stack[-1].tag == "head" and tag not in IN_HEAD:
                pop(len(stack) - 1)
            if tag in ("html", "body") and at_tag[tag]:
                continue
            if tag not in ("html", "head", "body") and tag not in IN_HEAD and not at_tag["body"] and (not stack or stack[-1].tag == "html"):
                imply_body()
            if tag in VOID:
                if tag in ("br", "hr") and not (stack and stack[-1].skipped):
                    close_block() if tag == "hr" else text.append((stack[-1].region if stack else 0, " ", 0))
                continue
            if tag in BLOCK:
                close_block()
                # An open paragraph ends, unless a container lies between.
                if at_block and stack[at_block[-1]].tag == "p":
                    pop(at_block[-1])
                closes, bound = CLOSES.get(tag, ((), ()))
                if last(closes) > last(bound):
                    pop(last(closes))
            above = stack[-1] if stack else page
            label, skipped, words, partly = self._attributes(tag, raw)
            if tag == "header" and not skipped:
                skipped = not (at_tag["article"] or at_tag["main"])
            if tag in RAW:
                stop = RAW_ENDS[tag].search(html, at)
                at = stop.end() if stop else end
                continue
            if raw.endswith("/") and tag not in BLOCK:
                continue  # an empty element of SVG or MathML
            container = above.container
            skipped = skipped or above.skipped
            region, article = above.region, above.article or tag in ("article", "main")
            if not skipped and (words or tag == "form"):
                regions.append(Region(region, frozenset(words), article or regions[region].inside))
                regions[-1].partly = bool(words) and partly and regions[-1].inside
                region, article = len(regions) - 1, False
            if tag == "main" and not skipped:
                regions[region].main = True
            push(Element(tag, skipped, container, region, article), label)
            if tag in CONTAINER and not skipped:
                contain(tag, container)
        close_block()
        self._judge(regions)
        for c, pieces in raws:
            pieces = [x for x in pieces if regions[x[0]].kept]
            body = " ".join("".join([x for _, x, _ in pieces]).split())
            if body:
                self.blocks.append((c, body, max(0, len(body) - sum(n for _, _, n in pieces))))

    @staticmethod
    def _judge(regions: list[Region]) -> None:
        """Whether the text of each region stays."""
        alike: dict[frozenset[str], int] = {}  # characters in regions of the same words
        for r in reversed(regions[1:]):  # parents have lower numbers
            up = regions[r.parent]
            up.main = up.main or r.main
            up.link_chars += r.link_chars
            if r.main or r.partly or OTHER_ARTICLES.isdisjoint(r.words):
                up.chars += r.chars
                up.article_chars += r.chars if r.inside and not up.inside else r.article_chars
            if up.words != r.words or r.parent == 0:
                alike[r.words] = alike.get(r.words, 0) + r.chars
        whole = regions[0]
        for r in regions[1:]:
            if r.inside:
                holds = 10 * alike[r.words] > 9 * whole.chars
            elif whole.article_chars:
                holds = False
            else:
                holds = 2 * r.chars > whole.chars if not r.words else 5 * alike[r.words] > 4 * whole.chars
            if r.partly:
                holds = 2 * r.link_chars < r.chars
            holds = holds or 2 * r.article_chars > whole.article_chars
            r.kept = regions[r.parent].kept and (r.main or holds and (r.partly or OTHER_ARTICLES.isdisjoint(r.words)))

    def best(self) -> tuple[int, int]:
        """The candidate container and the characters of its text (-1, 0: none)."""
        scores = [0.0] * len(self.paths)
        for c, text, plain in self.blocks:
            if c >= 0 and len(text) >= MIN_BLOCK:
                scores[c] += plain
                if self.parents[c] >= 0:
                    scores[self.parents[c]] += plain / 2
        if not any(scores):
            return -1, 0
        top = max(range(len(scores)), key=lambda i: (scores[i], -i))
        at, named = top, -1
        while at >= 0:
            if self.tags[at] in ("article", "main"):
                named = at
            at = self.parents[at]
        top = named if named >= 0 else self._climb(top)
        inside = self._inside({top})
        return top, sum(len(t) for c, t, _ in self.blocks if c >= 0 and inside[c])

    def _climb(self, top: int) -> int:
        """The highest container above ``top`` to which only text outside links leads."""
        chars, plain = [0] * len(self.paths), [0] * len(self.paths)
        for c, text, n in self.blocks:
            if c >= 0:
                chars[c] += len(text)
                plain[c] += n
        for c in range(len(self.paths) - 1, 0, -1):  # parents have lower numbers
            if self.parents[c] >= 0:
                chars[self.parents[c]] += chars[c]
                plain[self.parents[c]] += plain[c]
        at = self.parents[top]
        while at >= 0:
            beside, unlinked = chars[at] - chars[top], plain[at] - plain[top]
            if 3 * unlinked < 2 * beside or self.tags[at] == "body" and 4 * beside < chars[at]:
                break
            if beside:
                top = at
            at = self.parents[at]
        return top

    def _inside(self, wanted: set[int]) -> list[bool]:
        """Whether each container is or stands in a wanted one."""
        # A container's answer follows from its parent's, which has a lower number.
        inside = [False] * len(self.paths)
        for c, parent in enumerate(self.parents):
            inside[c] = c in wanted or parent >= 0 and inside[parent]
        return inside

    def text_of(self, wanted: set[int]) -> str:
        inside = self._inside(wanted)
        return " ".join(t for c, t, _ in self.blocks if c >= 0 and inside[c])

    def extract(self, path: str | None) -> str:
        wanted = {c for c, p in enumerate(self.paths) if p == path}
        text = self.text_of(wanted) if wanted else ""
        if text:
            return text
        top, _ = self.best()
        return self.text_of({top}) if top >= 0 else " ".join(t for _, t, _ in self.blocks)


def host_of(url: Column) -> Column:
    """Lower-case host without www. and port; '' if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def candidates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, chars) of the candidate container of every page that has one."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, chars = [], [], []
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(value.as_py())
                top, n = page.best()
                if top >= 0:
                    hosts.append(host)
                    paths.append(page.paths[top])
                    chars.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], names=["host", "path", "chars"])

    return map_arrow(rows, run, "host string, path string, chars bigint")


def consensus(found: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host. Votes are combined on the
    map side, so a host of a third of all pages is no heavier than others."""
    votes = found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))
    return votes.groupBy("host").agg(F.max(F.struct("pages", "chars", "path")).alias("w")).select("host", F.col("w.path").alias("path"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns beside the main text of every page."""
    winners = stage(consensus(candidates(pages, url_col, html_col)), "host-paths")
    rows = pages.select(*keep, host_of(F.col(url_col)).alias("__host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"))
    # The staged winners are broadcast if their files are small; if not, Spark
    # splits the pages of hot hosts.
    rows = rows.join(winners.withColumnsRenamed({"host": "__whost", "path": "__path"}), F.col("__host") == F.col("__whost"), "left")
    rows = rows.select(*keep, "__html", "__path")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py()).extract(p.as_py()) for h, p in zip(batch.column(len(keep)), batch.column(len(keep) + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_arrow(rows, run, ddl)
