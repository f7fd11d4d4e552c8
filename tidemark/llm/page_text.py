"""Main text of web pages after removal of site templates.

Every element subtree (tag, text, child subtrees) has a hash.  Spark counts, per host, on how many pages each hash
occurs; subtrees on ``LEAST_PAGES`` pages of a host or more are its template, however large the host.  Template goes in two ways.
Link lists (``LINK_SHARE`` of the text in links or more) go everywhere, inside a content landmark (``article``, ``main``,
their roles) as whole blocks only.  Other template goes outside landmarks, and there only in runs shorter than ``PROSE``
characters: copies of main text recur too, and longer runs count as such (so does a longer notice without links).  Shared sentences
in a landmark stay, and a landmark never loses all its text for recurring.  What is left is read by the meaning of its
elements: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go, the landmark's
text stays, or all remaining text where there is no landmark.

Hosts have no list of their templates: the hashes of each page, one row a hash, are joined with the host's counts, and a page gets the
templates that it contains.  Pages are named by a digest of host and html, since equal pages have equal templates.

Defined cases: null html gives an empty text; a null url is a host of its own; broken markup is read as browsers do in the
common cases (unclosed elements, stray end tags, unfinished tags at the end); repeated rows count as pages of their own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

LEAST_PAGES = 5
LINK_SHARE = 0.5
PROSE = 400

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^a-z0-9]+")
_HOST = re.compile(r"\s*[a-zA-Z][\w+.-]*://([^/?#\s]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody
tfoot thead tr ul caption""".split())
#: What a start tag closes if it is open inside the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED_TAGS = frozenset("""head script style noscript template nav footer aside form iframe svg math button select option input textarea
dialog menu object applet video audio canvas map title""".split())
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall sidebar sidebars aside menu menus nav navbar
navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager share sharing social comment comments commentlist disqus
replies respond related recommended widget widgets login signup search skip""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset({"header", "topbar"})
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


class Element:
    __slots__ = ("tag", "first", "last", "parts", "dropped", "landmark", "marked", "parent", "words", "link", "digest")

    def __init__(self, tag: str, first: int, dropped: bool, landmark: bool, marked: bool = False, parent: Element | None = None):
        self.tag, self.first, self.last, self.parts = tag, first, first, []
        self.dropped, self.landmark, self.marked, self.parent, self.digest = dropped, landmark, marked, parent, 0
        self.words, self.link = False, tag == "a" or (parent is not None and parent.link)


def _is_dropped(tag: str, attributes: dict[str, str], landmark: bool) -> bool:
    if tag in DROPPED_TAGS or (tag == "header" and not landmark):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    if tag in ("html", "body"):
        return False
    words = set(_PART.split(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    return not words.isdisjoint(DROPPED_WORDS) or (not landmark and not words.isdisjoint(HEADER_WORDS))


class Page:
    """Text chunks of a page in order, and the elements that hold them."""

    def __init__(self, source: str | None):
        self.chunks: list[str] = []
        self.blocks: list[int] = []
        self.linked: list[bool] = []
        self.elements: list[Element] = []
        self._block = 0
        self._stack = [Element("", 0, False, False)]
        self._read(source or "")
        while self._stack:
            self._close()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            self._text(source[at:found.start() if found else len(source)])
            if not found:
                return
            at = found.end()
            if found[1]:
                self._end(found[1].lower())
            elif found[2] or found[4]:
                if found[4] and not found[0].endswith(">"):
                    return  # an unfinished tag at the end
                tag, raw = (found[2] or found[4]).lower(), found[3] if found[2] else found[5]
                self._start(tag, raw)
                if tag in RAW and not raw.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = close.end() if close else len(source)
                    self._end(tag)

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            top = self._stack[-1]
            top.parts.append(" ".join(text.split()))
            top.words = top.words or any(map(str.isalnum, text))
            self.linked.append(top.link)
            self.chunks.append(text)
            self.blocks.append(self._block)

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag in CLOSES:
            closed, inside = CLOSES[tag]
            self._pop_to(closed, inside)
        elif tag in BLOCK:
            self._pop_to({"p"}, {"button", "table", "td", "th", "object"})
        if tag in BLOCK:
            self._block += 1
        elif tag in ("td", "th"):
            self._text(" ")
        if tag in VOID:
            return
        top, attributes = self._stack[-1], _attributes(raw)
        marked = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        landmark = top.landmark or marked
        self._stack.append(Element(tag, len(self.chunks), top.dropped or _is_dropped(tag, attributes, landmark), landmark, marked, top))

    def _pop_to(self, tags: set[str], barrier: set[str]) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag in tags:
                while len(self._stack) > depth:
                    self._close()
                return
            if self._stack[depth].tag in barrier:
                return

    def _end(self, tag: str) -> None:
        inline = tag not in BLOCK and tag not in RAW
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth].tag == tag:
                while len(self._stack) > depth:
                    self._close()
                break
            if inline and self._stack[depth].tag in BLOCK:
                break  # a stray end of an inline element does not close blocks
        if tag in BLOCK:
            self._block += 1

    def _close(self) -> None:
        done = self._stack.pop()
        if done.tag in BLOCK:
            self._block += 1
        done.last = len(self.chunks)
        if any(done.parts):
            done.digest = xxhash.xxh64_intdigest("\x00".join([done.tag, *done.parts]).encode("utf-8", "surrogatepass"))
        if self._stack:
            if done.digest:
                self._stack[-1].parts.append(f"\x01{done.digest:x}")
            self.elements.append(done)

    def _sizes(self) -> np.ndarray:
        """Characters of all text and of link text before each chunk, white space apart."""
        size = np.fromiter((len("".join(c.split())) for c in self.chunks), np.int64, len(self.chunks))
        out = np.zeros((2, len(size) + 1), dtype=np.int64)
        np.cumsum([size, size * np.array(self.linked, dtype=np.int64)], axis=1, out=out[:, 1:])
        return out

    def _candidates(self) -> list[tuple[Element, bool]]:
        """Elements that go if they are template, and whether they are link lists."""
        whole, links = self._sizes().tolist()
        out = []
        for e in self.elements:
            if not e.digest or e.dropped or e.tag in ("html", "body"):
                continue
            block = e.tag in BLOCK or e.tag in ("td", "th")
            if not block and e.parent.words:
                continue  # part of a sentence
            dense = links[e.last] - links[e.first] >= LINK_SHARE * (whole[e.last] - whole[e.first])
            if not e.landmark or (dense and block and not e.marked and e.tag not in HEADINGS):
                out.append((e, dense))
        return out

    def countable(self) -> set[int]:
        """Hashes of the subtrees that go if they recur."""
        return {e.digest for e, _ in self._candidates()}

    def text(self, template: set[int]) -> str:
        """The main text without the subtrees in ``template``; a landmark inside one of them stays."""
        n = len(self.chunks)
        dropped, inside, lists, recurs = (np.zeros(n, dtype=bool) for _ in range(4))
        for e in self.elements:
            if e.dropped:
                dropped[e.first:e.last] = True
            elif e.landmark:
                inside[e.first:e.last] = True
        for e, dense in self._candidates() if template else ():
            if e.digest in template:
                part = lists if dense else recurs
                part[e.first:e.last] |= e.landmark | ~inside[e.first:e.last]
        gone = dropped | lists
        if recurs.any():
            # chunks that show something, in runs of the same kind; a run shorter than PROSE goes
            size = np.diff(self._sizes()[0])
            shown = np.flatnonzero(~gone & (size > 0))
            kind = recurs[shown] & ~inside[shown]
            run = np.cumsum(np.diff(kind, prepend=False))
            short = np.bincount(run, size[shown]) < PROSE if len(shown) else np.zeros(0, dtype=bool)
            gone[shown[kind & short[run]]] = True
        for left in (inside & ~gone, inside & ~dropped, ~gone):
            kept = np.flatnonzero(left)
            if any(self.chunks[i].strip() for i in kept):
                break
        out, block, parts = [], None, []
        for i in [*kept.tolist(), None]:
            now = None if i is None else self.blocks[i]
            if now != block:
                line = " ".join("".join(parts).split())
                if line:
                    out.append(line)
                block, parts = now, []
            if i is not None:
                parts.append(self.chunks[i])
        return "\n".join(out)


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def _key(host: str, source: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{host}\x00{source}".encode("utf-8", "surrogatepass"))


def page_digests(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: key, host, and the hashes of its subtrees that go if they recur."""
    def run(batches):
        for part in common.slices(batches, "html"):
            sources, hosts = part.column(1).to_pylist(), [host_of(u) for u in part.column(0).to_pylist()]
            found = [common.signed(np.array(sorted(Page(x).countable()), dtype=np.uint64)).tolist() for x in sources]
            yield pa.record_batch({"key": pa.array(map(_key, hosts, sources), pa.binary()), "host": pa.array(hosts, pa.string()),
                                   "digests": pa.array(found, pa.list_(pa.int64()))})
    return _rows(pages).select("url", "html").mapInArrow(run, "key binary, host string, digests array<long>")


def templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, digest``: the hashes that are on many pages of the host, from ``page_digests``."""
    return (found.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_pages).select("host", "digest"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    found = common.durable(page_digests(pages))
    known = common.durable(templates(found))
    own = found.select("key", "host", F.explode("digests").alias("digest")).join(known, ["host", "digest"])
    own = common.durable(own.groupBy("key").agg(F.collect_set("digest").alias("template")))

    def keyed(batches):
        for part in common.slices(batches, "html"):
            urls, sources = part.column(1).to_pylist(), part.column(2).to_pylist()
            yield pa.record_batch({"page_id": part.column(0), "url": part.column(1),
                                   "page_key": pa.array([_key(host_of(u), x) for u, x in zip(urls, sources)], pa.binary()),
                                   "body": pa.array([zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in sources], pa.binary())})
    rows = _rows(pages).mapInArrow(keyed, "page_id long, url string, page_key binary, body binary")
    joined = rows.join(own, rows["page_key"] == own["key"], "left").select("page_id", "url", "body", "template")

    def run(batches):
        for part in common.slices(batches, "body", common.SLICE_BYTES // 4):
            texts = []
            for body, template in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                texts.append(Page(zlib.decompress(body).decode("utf-8", "surrogatepass")).text({d & common.MASK for d in template or ()}))
            yield pa.record_batch({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
