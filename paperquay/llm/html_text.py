"""Main text of web pages by template deduction from equivalence classes.

Pages of one host are written by one template. A page is read as a tree of block elements, and
gives two sorts of tokens: element paths (tags with their class names) and whole text blocks with
their path. Pages of a host with the same texts outside menus and the like are copies of one
content, which counts once however many urls or ids it has. The occurrence vector of a token says
how often it occurs in each content of its host; tokens with equal vectors form an equivalence
class. Vectors are compared by a digest that is summed up with map-side combine, so no task sees
all pages of a host. A class is valid if it occurs in at least half of the host's contents (texts:
in more than two) and if it has company or is an element, whose span nests by itself. Valid classes are nested by their paths into the template:
texts in a valid class are the template's own words, and containers in a valid class are its slots.
A page's slot for the main text is the smallest one that holds all its text that is neither the
template's nor in menus and the like nor mostly links; where none does, as on a page of a rare
layout, it is the whole page. What a page has in this slot, without the template's words and menus,
is its main text. Menus and the like are known by their tags and names; headers of articles, figures with their
captions and formulas are main text, and the template's words are taken off them, too. Names don't count on a host
whose own words are nearly all in blocks with such names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from paperquay.llm.common import written

#: Elements whose content is no text of a page.
RAW = "script|style|template|noscript|iframe|svg|object|audio|video|canvas|textarea|title"
#: Elements that hold no main text.
APART = frozenset("nav header footer aside form menu dialog button select fieldset".split())
#: Classes, ids and roles of blocks without main text; such a word may also end a longer name.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion related replies reply respond search share sharing shoutbox sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Ends of names that say no more than that something is a part, and starts that say what a block has or is like.
PARTS = frozenset(
    "area areas bar block blocks bottom box button buttons col column container content form group inner item items left link links list "
    "outer panel post posts right section sections slot thread title top unit widget widgets wrap wrapper".split()
)
ABOUT = frozenset("has have hide hides is no not show shows with without".split())
#: Elements whose headers are headers of main text, and words of names that say so of a header by itself.
OWN_HEADERS = frozenset(("article", "main"))
OF_MAIN_TEXT = frozenset("article articles blog content entry news page post story".split())
#: Elements around main text, whatever their names.
NEVER_APART = frozenset("html body main article".split())
#: Part of a host's own words that must be outside blocks with names in APART_WORDS, or these names don't count.
LEAST_OUTSIDE = 0.1
#: Elements that are part of the line they stand in.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same set closes.
CLOSED_BY = {"p": frozenset({"p"}), "li": frozenset({"li"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"})} | {
    "th": frozenset({"td", "th"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"}),
}
#: Elements between which such an element isn't looked for.
SCOPE = frozenset("ul ol dl table article section div body".split())
#: Elements that may be the slot of the main text.
CONTAINERS = frozenset("article main section div td body html".split())
#: Headlines count as main text even if they are links.
HEADLINES = frozenset(("h1", "h2"))

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|(?=<body\b)|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_LABEL = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text between block tags."""

    path: tuple[str, ...]
    apart: bool  # by the tag of an element around it
    named: bool  # by the name of one
    text: str
    link_chars: int


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with the paths of the elements around them."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, tag with class names, apart by tag, by name
    held: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(Block(tuple(x[1] for x in stack), any(x[2] for x in stack), any(x[3] for x in stack), text, links))
        held.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            held.append(text)
            if in_link:
                links += len(text)
            continue
        if m["tag"] is None:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        if tag in INLINE:
            if tag == "a":
                in_link = not m["end"]
            if tag in ("br", "img", "wbr"):
                held.append(" ")
            elif not m["end"] and tag == "span" and _apart(rest, False):
                held.append(" ")
            continue
        flush()
        if m["end"]:
            in_link = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if closes := CLOSED_BY.get(tag):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE:
                    break
        label = _words(rest)
        name = ".".join([tag, *sorted(label)]) if label else tag
        if not rest.rstrip().endswith("/"):
            own = not OWN_HEADERS.isdisjoint(x[0] for x in stack)
            by_tag = tag in APART and not (tag == "header" and (own or not OF_MAIN_TEXT.isdisjoint(label)))
            stack.append((tag, name, by_tag, tag not in NEVER_APART and _apart(rest, own)))
    flush()
    return out


def _words(rest: str) -> frozenset[str]:
    """Words of an element's class, id and role."""
    if "=" not in rest:
        return frozenset()
    return frozenset(w for m in _LABEL.finditer(rest) for w in _WORD.findall(m[1].lower()))


def _apart(rest: str, own: bool) -> bool:
    """Whether a class, id or role of an element says that it holds no main text.

    A header does not if it is in an article (``own``), or if its name says that it is an article's.
    """
    if "=" not in rest:
        return False
    for m in _LABEL.finditer(rest):
        for name in m[1].strip("\"'").lower().split():
            words = _WORD.findall(name)
            if not words or words[0] in ABOUT:
                continue
            while len(words) > 1 and words[-1] in PARTS and words[-1] not in APART_WORDS:
                words.pop()
            if words[-1] == "header" and (own or not OF_MAIN_TEXT.isdisjoint(words)):
                continue
            if words[-1] in APART_WORDS:
                return True
    return False


def _outside(found: list[Block]) -> tuple[int, int]:
    """Characters outside links and menus: in blocks without a name in APART_WORDS, and in the others."""
    chars = [0, 0]
    for b in found:
        if not b.apart:
            chars[b.named] += max(0, len(b.text) - b.link_chars)
    return chars[0], chars[1]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _id(*parts: str) -> int:
    """Signed 64-bit name of a token."""
    value = xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _path_ids(path: tuple[str, ...]) -> list[int]:
    return [_id("e", *path[: i + 1]) for i in range(len(path))]


TOKENS = "host string, content long, token long, element boolean, fits boolean, count int, mark long, outside long, named long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each page with their counts; ``content`` digests its texts, ``mark`` that and the count."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(9)]
        for url, page in zip(*(batch.column(c).to_pylist() for c in ("url", "html")), strict=True):
            host, found = host_of(url), blocks(page or "")
            outside, named = _outside(found)
            few = outside < LEAST_OUTSIDE * (outside + named)
            content = _id("c", *(b.text for b in found if not b.apart and (few or not b.named)))
            seen: dict[int, list] = {_id("page"): [True, False, 1, outside, named]}
            for b in found:
                for x, name in zip(_path_ids(b.path), b.path, strict=True):
                    seen.setdefault(x, [True, name.split(".")[0] in CONTAINERS, 0, 0, 0])[2] += 1
                entry = seen.setdefault(_id("t", *b.path, b.text), [False, False, 0, 0, 0])
                entry[2] += 1
                if not b.apart:
                    entry[3 + b.named] += max(0, len(b.text) - b.link_chars)
            for token, (element, fits, count, outside, named) in seen.items():
                values = (host, content, token, element, fits, count, _id(str(content), str(count)), outside, named)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["host", "content", "token", "element", "fits", "count", "mark", "outside", "named"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)


def templates(pages: DataFrame) -> DataFrame:
    """``host, slots, texts, by_name``: the ids of each host's template containers and of the template's
    texts, and whether names tell its menus and the like.

    ``pages`` has url and html. The lists of a host are at most twice as long as its contents have
    containers and text blocks on average, since each of them is in half of the contents.
    """
    found = pages.select("url", "html").mapInArrow(_tokens, TOKENS)
    # Copies of a content count once; where their menus differ, the greatest values stand for them.
    parts = ("element", "fits", "count", "mark", "outside", "named")
    found = found.groupBy("host", "token", "content").agg(*(F.max(c).alias(c) for c in parts))
    tokens = found.groupBy("host", "token").agg(
        F.first("element").alias("element"), F.first("fits").alias("fits"), F.count(F.lit(1)).alias("pages"), F.bit_xor("mark").alias("vector"),
        F.sum("outside").alias("outside"), F.sum("named").alias("named"),
    )
    # Tokens in one content are in no valid class; the host's own token and its containers stay.
    tokens = written(tokens.filter("pages > 1 or element"), "html-tokens")
    hosts = tokens.filter(F.col("token") == _id("page")).select("host", F.col("pages").alias("all_pages"))
    classes = tokens.groupBy("host", "vector", "pages").agg(F.count(F.lit(1)).alias("company"))
    known = tokens.join(classes, ["host", "vector", "pages"]).join(hosts, "host")
    valid = known.filter((F.col("pages") * 2 >= F.col("all_pages")) & (F.col("element") | ((F.col("pages") > 2) & (F.col("company") > 1))))
    ids = lambda of: F.collect_list(F.when(of, F.col("token")))
    # The host's own token has the characters of all its contents; template texts are taken off.
    own = lambda chars: F.sum(F.when(F.col("token") == _id("page"), F.col(chars)).when(~F.col("element"), -F.col(chars)))
    by_name = own("outside") >= LEAST_OUTSIDE * (own("outside") + own("named"))
    lists = valid.groupBy("host").agg(ids(F.col("fits")).alias("slots"), ids(~F.col("element")).alias("texts"), by_name.alias("by_name"))
    return hosts.select("host").join(lists, "host", "left")


def extract(page: str, slots: frozenset[int], template_texts: frozenset[int], by_name: bool = True) -> str:
    """Main text of one page.

    Where template texts are all that is there, they are the page's content and stay.
    """
    found = [b for b in blocks(page) if not b.apart and not (by_name and b.named)]
    own = [b for b in found if _id("t", *b.path, b.text) not in template_texts]
    sure = [b.path for b in own if 2 * b.link_chars < len(b.text) or not HEADLINES.isdisjoint(x.split(".")[0] for x in b.path)]
    slot = _slot(sure, slots)
    return "\n".join(b.text for b in own or found if b.path[: len(slot)] == slot)


def _slot(paths: list[tuple[str, ...]], slots: frozenset[int]) -> tuple[str, ...]:
    """Path of the smallest of ``slots`` around all ``paths``; an empty one, which all are in, if there is none."""
    if not paths:
        return ()
    low, high = min(paths), max(paths)
    shared = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    ids = _path_ids(low[:shared])
    return low[: next((i for i in range(shared, 0, -1) if ids[i - 1] in slots), 0)]


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    A null html has an empty text. Pages whose url is null or names no host share a template. A
    host with one or two contents has no template texts. Rows
    repeat as they do in the input; other columns are not read; an empty table gives none.
    """
    plain = pages.select("page_id", "url", "html")
    found = written(templates(plain), "html-templates")
    named = plain.withColumn("host", _host_column())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, slots, ids, by_name in zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "texts", "by_name")), strict=True):
                texts.append(extract(page or "", frozenset(slots or ()), frozenset(ids or ()), by_name is not False))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = plain.schema["page_id"].dataType.simpleString()
    # Spark broadcasts the templates while their written size allows it, and splits a hot host otherwise.
    joined = named.join(found, "host", "left").select("page_id", "url", "html", "slots", "texts", "by_name")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def _host_column():
    @F.pandas_udf("string")
    def host(urls):
        return urls.map(host_of)

    return host(F.col("url"))
