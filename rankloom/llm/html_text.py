"""Main text of pages, with removal of site templates (operator 8).

A page is parsed into blocks of text and into the subtrees of all its block elements, menus, footers and adverts among
them; only scripts, styles and other raw elements are skipped. A subtree has a hash of its tags and texts. A subtree
of links (nine tenths of its text) has a second hash, its frame: tags, names without digits, and which frames are within, but no text,
link or number, so that a varying menu still recurs. Spark counts, for each host, on how many different contents each
hash stands. A subtree on at least `share` of a host's different contents and on at least `least`, or a frame of links
outside articles on as many, belongs to the site's template and is deleted with all its blocks. Contents are the texts
outside named elements, so copies of one page count as one content, and a text isn't a template because its page is
copied.

Tags, roles and names that never hold main text (nav, footer, a comment's article, class="ad") go even where they don't
recur. A name counts only if a whole class or id is made of such words and of words about its place ("ad-box", but not
"banner-story"). Names that an article's own part may have, too ("related", "social") are no proof: such an element goes
if half of its text is links and its frame is on at least `frame_share` of the host's contents, one at least. Prose that doesn't
recur is never lost by them, on hosts of any size. Of what is left, the articles are the text, else main, else the body.

White space in a block becomes one space; blocks are joined by line feeds. Null html: empty text. Null url: host null,
of its own. Repeated rows are judged one by one. Broken markup: an element ends where its parent does, a paragraph
where a block begins; an end tag without a start is ignored. Deep nesting needs no recursion, very long pages take time
in proportion. Other columns, whatever their names, aren't read. Empty table: empty result. Rows meet their host's
templates by host, of which there are as many as a page has subtrees, divided by the shares.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .urls import split_url

_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul")
RAW = _words("script style textarea title noscript template iframe svg math object canvas noframes xmp")
SKIP = _words("head applet audio video") | RAW
LEFT_OUT = _words("nav aside footer form button select option input label dialog menu")
ROLES = _words("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form")
#: Names of what is never main text; names that a part of an article may have, too; what may stand beside either.
SURE = _words("ad ads advert adverts advertisement advertising sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus pagination pager")
DOUBTFUL = _words("sponsor menu share sharing social related recommended widget toolbar login search")
PLACES = _words("area bar block bottom box container inner item items left link links list main outer page right section site slot top unit wrap wrapper")
TOP = _words("html body main article")
#: What a start tag ends, if that is open and none of the second set is within.
ENDS = {"li": (_words("li"), _words("ul ol menu")), "dt": (_words("dt dd"), _words("dl")), "dd": (_words("dt dd"), _words("dl")), "tr": (_words("tr"), _words("table")), "td": (_words("td th"), _words("tr table")), "th": (_words("td th"), _words("tr table")), "option": (_words("option"), _words("select"))}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*+)(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAME = re.compile(r"[A-Za-z]+")


#: What an element is: part of the page, so called by doubtful names, never main text, never text; or, of a tree, links.
PLAIN, NAMED, APART, SKIPPED, LINKS = range(5)


def _named(tokens: list[str], within: bool) -> int:
    """What classes and ids say; a token says something if all its words do, or tell a place."""
    kind, sure = PLAIN, SURE if within else SURE | {"header"}
    for token in tokens:
        parts = set(NAME.findall(token))
        if parts <= sure | DOUBTFUL | PLACES:
            kind = max(kind, APART if parts & sure else NAMED if parts & DOUBTFUL else PLAIN)
    return kind


def _kind(tag: str, attributes: str, within: bool) -> tuple[int, str]:
    """What an element is, and its names without digits; within: inside an article or main."""
    if tag in SKIP:
        return SKIPPED, ""
    kind = APART if tag in LEFT_OUT or tag == "header" and not within else PLAIN
    if not attributes or tag in ("html", "body", "main"):
        return kind, ""
    values = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    both = f"{values.get('class', '')} {values.get('id', '')}".lower()
    told = " ".join(sorted(set(NAME.findall(both))))
    if "hidden" in values or values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true":
        return APART, told
    if tag == "article":
        return (APART if {"comment", "comments", "reply"} & set(both.split()) else kind), told
    return max(kind, _named(both.split(), within)), told


class _Open:
    """An element that hasn't ended."""

    __slots__ = ("tag", "kind", "names", "inside", "own", "frames", "first", "root", "chars", "linked", "links")

    def __init__(self, tag: str, kind: int, names: str, inside: int, first: int, root: int):
        #: inside: the most any element around it is, or itself; root: 2 in an article, 1 in main, else 0
        self.tag, self.kind, self.names, self.inside, self.first, self.root = tag, kind, names, inside, first, root
        self.own = blake2b(tag.encode(), digest_size=8)
        self.frames: set[bytes] = set()
        #: characters of its text, of those in links, and how many links
        self.chars = self.linked = self.links = 0

    def is_links(self, share: float) -> bool:
        return self.linked >= share * self.chars > 0


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


class _Page:
    """blocks: text, root, whether it's outside all named elements; trees: hash, first block, block after the last, kind."""

    def __init__(self, text: str):
        self.open: list[_Open] = [_Open("", PLAIN, "", PLAIN, 0, 0)]
        self.blocks: list[tuple[str, int, bool]] = []
        self.trees: list[tuple[int, int, int, int]] = []
        self.run: list[str] = []
        self.count: dict[str, int] = {}
        self.parse(text)

    def parse(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            m = TAG.search(text, at)
            if m is None:
                self.text(text[at:])
                break
            if m.start() > at:
                self.text(text[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self.text(m[1], False)
                continue
            closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self.end(tag)
            elif tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = end.end() if end else n
            else:
                self.start(tag, attributes)
        while len(self.open) > 1:
            self.pop()
        self.flush()

    def text(self, data: str, decode: bool = True) -> None:
        if self.open[-1].inside < SKIPPED:
            self.run.append(html.unescape(data) if decode and "&" in data else data)
            n = len(data.strip())
            self.open[-1].chars += n
            self.open[-1].linked += n if self.count.get("a") else 0

    def flush(self) -> None:
        if self.run:
            words = " ".join("".join(self.run).split())
            self.run = []
            if words:
                top = self.open[-1]
                self.blocks.append((words, top.root, top.inside == PLAIN))
                top.own.update(words.encode("utf-8", "replace") + b"\0")
                top.frames.add(b"text")

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and self.count.get("p"):
            self.end_within(_words("p"), BLOCK - _words("p"))
        if tag in ENDS:
            self.end_within(*ENDS[tag])
        if tag == "br":
            self.text(" ")
        if tag in BLOCK:
            self.flush()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        top = self.open[-1]
        root = 2 if tag == "article" or top.root == 2 else 1 if tag == "main" or top.root == 1 else 0
        kind, names = _kind(tag, attributes, top.root > 0)
        self.open.append(_Open(tag, kind, names, max(top.inside, kind), len(self.blocks), root))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> None:
        if self.open[-1].tag in BLOCK:
            self.flush()
        done = self.open.pop()
        self.count[done.tag] -= 1
        up, last = self.open[-1], len(self.blocks)
        if done.inside == SKIPPED:
            return
        up.chars, up.linked, up.links = up.chars + done.chars, up.linked + done.linked, up.links + done.links + (done.tag == "a")
        framed = done.kind in (NAMED, APART)
        if done.tag in BLOCK:
            digest = done.own.digest()
            up.own.update(digest)
            if done.tag not in TOP and last > done.first:
                self.trees.append((_number(digest), done.first, last, PLAIN))
        if done.tag in BLOCK or framed:
            frame = blake2b(f"{done.tag} {done.names} ".encode() + b"".join(sorted(done.frames)), digest_size=8).digest()
            up.frames.add(frame)
            if last == done.first:
                return
            if done.kind == APART or done.kind == NAMED and done.is_links(0.5):
                self.trees.append((_number(frame), done.first, last, done.kind))
            elif done.kind == PLAIN and done.root < 2 and done.tag not in TOP and done.links >= 3 and done.is_links(0.9):
                self.trees.append((_number(frame), done.first, last, LINKS))
        else:
            up.frames |= done.frames

    def end_within(self, tags: frozenset, stops: frozenset) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k].tag in stops:
                return

    def end(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                while len(self.open) > k:
                    self.pop()
                return
            if tag not in BLOCK and self.open[k].tag in BLOCK:
                return  # an inline end tag ends nothing outside its block

    def content(self) -> int:
        """A hash of the text outside named elements, of the articles, else of main, else of all."""
        best = max((root for _, root, plain in self.blocks if plain), default=0)
        texts = [text for text, root, plain in self.blocks if plain and root == best]
        return _number(blake2b("\0".join(texts).encode("utf-8", "replace"), digest_size=8).digest())


def main_text(blocks: list[tuple[str, int]], trees: list[tuple[int, int, int, int]], template: frozenset[int]) -> str:
    """What is left without the template."""
    change = [0] * (len(blocks) + 1)
    for number, first, after, kind in trees:
        if number in template or kind == APART:
            change[first] += 1
            change[after] -= 1
    kept, depth = [], 0
    for (text, root), step in zip(blocks, change, strict=False):
        depth += step
        if depth == 0:
            kept.append((text, root))
    best = max((root for _, root in kept), default=0)
    return "\n".join(text for text, root in kept if root == best)


def text_of(page: str) -> str:
    """The text of one page alone."""
    parsed = _Page(page)
    return main_text([b[:2] for b in parsed.blocks], parsed.trees, frozenset(h for h, _, _, kind in parsed.trees if kind == NAMED))


TREES = "array<struct<hash:long,first:int,after:int,kind:int>>"
BLOCKS = "array<struct<text:string,root:int>>"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks, trees, content."""
    host, _ = split_url(pages["url"])
    df = pages.select("page_id", "url", F.when(pages["url"].isNotNull(), host).alias("host"), "html")
    tree = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("after", pa.int32()), ("kind", pa.int32())]))
    block = pa.list_(pa.struct([("text", pa.string()), ("root", pa.int32())]))

    def make():
        def fn(batch):
            blocks, trees, contents = [], [], []
            for page in common.text_of(batch, "html").to_pylist():
                parsed = _Page(page)
                blocks.append([{"text": x.encode("utf-8", "replace").decode(), "root": r} for x, r, _ in parsed.blocks])
                trees.append([{"hash": h, "first": a, "after": b, "kind": k} for h, a, b, k in parsed.trees])
                contents.append(parsed.content())
            return [pa.array(blocks, block), pa.array(trees, tree), pa.array(contents, pa.int64())]

        return fn

    fields = [common.field("blocks", BLOCKS), common.field("trees", TREES), common.field("content", "long")]
    return common.map_arrow(df, make, fields, ["page_id", "url", "host"])


def templates(parsed: DataFrame, share: float = 0.5, frame_share: float = 0.02, least: int = 5) -> DataFrame:
    """host, contents, template (hashes of subtrees and frames that recur)."""
    counted = F.filter("trees", lambda t: t["kind"] != APART)
    own = F.array_distinct(F.transform(counted, lambda t: F.struct(t["hash"].alias("hash"), (t["kind"] == NAMED).alias("named"))))
    seen = parsed.select("host", "content", F.explode(own).alias("t")).select("host", "content", "t.*").distinct()
    seen = seen.groupBy("host", "hash", "named").agg(F.count(F.lit(1)).alias("on")).where(F.col("named") | (F.col("on") >= least))
    hosts = parsed.select("host", "content").distinct().groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("contents"))
    enough = F.col("on") >= F.when(F.col("named"), frame_share).otherwise(share) * F.col("contents")
    found = seen.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(enough).groupBy("host").agg(F.collect_set("hash").alias("template"))
    both = hosts.join(found, F.col("host").eqNullSafe(F.col("of")), "left")
    return both.select(F.col("of").alias("host"), "contents", F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def extract(pages: DataFrame, share: float = 0.5, frame_share: float = 0.02, least: int = 5) -> DataFrame:
    """page_id, url, text."""
    parsed = common.stage(parse(pages), "pages")
    found = common.stage(templates(parsed, share, frame_share, least), "template").withColumnRenamed("host", "of")
    rows = parsed.join(found, F.col("host").eqNullSafe(F.col("of")), "left").select("page_id", "url", "blocks", "trees", "template")

    def make():
        known: dict[tuple, frozenset] = {}

        def fn(batch):
            blocks, trees, template = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("blocks", "trees", "template"))
            texts = []
            for bs, ts, hashes in zip(blocks, trees, template, strict=True):
                if (key := tuple(hashes)) not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(key)
                texts.append(main_text([(b["text"], b["root"]) for b in bs], [(t["hash"], t["first"], t["after"], t["kind"]) for t in ts], known[key]))
            return [pa.array(texts, pa.string())]

        return fn

    return common.map_arrow(rows, make, [common.field("text", "string")], ["page_id", "url"])
