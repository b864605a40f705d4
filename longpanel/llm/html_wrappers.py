"""Main text of web pages by wrappers inferred for each host.

Pages of a host are token streams of tags and texts. A wrapper is a union-free regular expression over such tokens. It
starts as one page's stream, repeats folded into groups, and is aligned with one page after another: where texts
differ stands a text slot; a run of tokens that one side lacks becomes an optional group; a run that repeats its
neighbour joins that repeated group. The wrapper then says which elements of the host hold main text: the first of its
article-like elements that has slots, else its body; without the elements that hold menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments. Every page of the host is read through this wrapper.

All pages of a host take part, a repeated page as often as it stands there, and every page is extracted from its whole
html. A host may hold any share of the rows: pages are folded where they are, those of a host with the same folded stream
are one shape whose texts and counts are added there first, and only shapes are shuffled. A host with more than ``FAN``
shapes has them aligned in blocks, then the wrappers of the blocks. Wrappers travel to the pages, as a broadcast while
their measured size is at most ``BROADCAST_BYTES``, else by a salted join.

NULL html is empty and gives empty text. A NULL url, or one without ``://``, has an empty host, whose pages share a
wrapper. Broken markup is read as far as it goes: an unclosed element ends with the one around it. Repeated pages are
extracted each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: Most shapes, or wrappers, of a host that a task aligns (about), and characters of shapes that one holds before it passes
#: them on.
FAN = 32
HELD = 8_000_000
BROADCAST_BYTES = 16_000_000
SALTS = 16
#: Longest repeated group, in tokens.
GROUP = 12

# Fixed values of HTML: elements by what they do.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr").split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul").split())
ASIDE_TAGS = frozenset(("head title nav header footer aside form button input dialog menu menuitem audio video canvas "
                        "map applet frame frameset noframes").split()) | frozenset(RAW)
MAIN_TAGS = ("article", "main")
MAIN_WORDS = ("article", "main", "content", "post", "entry", "story", "text")
ASIDE_WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav "
                         "navbar navigation menu menus topbar breadcrumb breadcrumbs header masthead footer foot sidebar side "
                         "aside widget widgets related recommended share sharing social subscribe subscription newsletter "
                         "signup login search form cookie cookies consent gdpr notice notices alert alerts popup modal overlay "
                         "disclaimer copyright comment comments commentlist reply replies respond disqus discussion pager "
                         "pagination toolbar skip").split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?[a-zA-Z](?:[^\"'>]|\"[^\"<]*\"|'[^'<]*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SIGNS: dict[str, tuple[str, str]] = {}


def _sign(tag: str) -> tuple[str, str]:
    """Name of a start tag, and the name with its classes, id and role."""
    known = _SIGNS.get(tag)
    if known is None:
        name = _NAME.match(tag)[1].lower()
        marks = sorted({w for m in _MARK.finditer(tag) for w in (m[1] or m[2] or m[3] or "").lower().split()})
        known = name, ".".join([name, *marks])
        if len(_SIGNS) < 50_000:
            _SIGNS[tag] = known
    return known


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...], bool]]:
    """(symbol, text, path of open elements, whether it ends a block) of a page, in order.

    A symbol is an element's signature, ``/name`` or ``#`` for text. Scripts, styles, comments and declarations are
    not tokens; what stands around them is one block only if an inline element would leave it one.
    """
    path: list[tuple[str, str]] = []
    signs: tuple[str, ...] = ()
    for m in _TOKEN.finditer(page):
        t = m[0]
        if t[0] != "<" or len(t) == 1:
            yield "#", t, signs, False
            continue
        if m["raw"] or t[1] in "!?":
            continue
        if t[1] == "/":
            name = _NAME.match(t)
            name = name[1].lower() if name else ""
            at = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == name), -1)
            # an inline end tag does not close a block element around it
            if at >= 0 and not (name in INLINE and any(n not in INLINE for n, _ in path[at + 1:])):
                del path[at:]
                signs = tuple(s for _, s in path)
            yield "/" + name, "", signs, name not in INLINE
            continue
        name, sign = _sign(t)
        if name in CLOSES_P:
            at = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == "p"), -1)
            if at >= 0 and all(n in INLINE for n, _ in path[at + 1:]):
                del path[at:]
        elif name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            if path and path[-1][0] == name:
                del path[-1]
        if name not in VOID and not t.endswith("/>"):
            path.append((name, sign))
        signs = tuple(s for _, s in path)
        yield sign, "", signs, name not in INLINE


# ------------------------------------------------------------------ inference


class Node:
    """A token of a wrapper: its symbol and path, its text if all pages agree on it, and the groups it belongs to."""

    __slots__ = ("symbol", "path", "text", "optional", "repeated", "chars")

    def __init__(self, symbol: str, path: tuple[str, ...], text: str | None, optional: int = 0, repeated: bool = False, chars: int = 0):
        self.symbol, self.path, self.text, self.optional, self.repeated, self.chars = symbol, path, text, optional, repeated, chars

    def also(self, other: Node) -> None:
        if self.text != other.text:
            self.text = None
        self.repeated |= other.repeated
        self.chars += other.chars


def folded(page: str) -> list[Node]:
    """The stream of a page with runs of equal groups of tokens folded into one repeated group."""
    out: list[Node] = []
    for symbol, text, path, _ in tokens(page):
        if symbol == "#":
            text = " ".join(text.split())
            if not text:
                continue
        out.append(Node(symbol, path, text, chars=len(text)))
        # does the stream end in a square? then its second half joins the first
        for g in range(1, min(GROUP, len(out) // 2) + 1):
            if out[-1 - g].symbol != symbol:
                continue
            if all(out[-g + i].symbol == out[-2 * g + i].symbol for i in range(g)) and out[-g].symbol[0] not in "/#":
                for i in range(g):
                    out[-2 * g + i].also(out[-g + i])
                    out[-2 * g + i].repeated = True
                del out[-g:]
                break
    return out


def aligned(wrapper: list[Node], page: list[Node]) -> list[Node]:
    """The wrapper widened so that it also generates ``page``, which may be a wrapper too."""
    group = max((n.optional for n in wrapper), default=0)
    for n in page:
        n.optional += group if n.optional else 0
    group = max((n.optional for n in page), default=0) or group
    out: list[Node] = []
    a, b = [n.symbol for n in wrapper], [n.symbol for n in page]
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(wrapper[i:j], page[k:m]):
                x.also(y)
                x.optional = x.optional or y.optional
                out.append(x)
            continue
        for side, spare in ((wrapper[i:j], a[i:j]), (page[k:m], b[k:m])):
            if not side:
                continue
            g = len(side)
            # a run that repeats what stands before it is one more round of that group
            if [n.symbol for n in out[-g:]] == spare and spare[0][0] not in "/#":
                for x, y in zip(out[-g:], side):
                    x.also(y)
                    x.repeated = True
                continue
            group += 1
            for n in side:
                n.optional = n.optional or group
                out.append(n)
    return out


def aside(sign: str) -> bool:
    """Whether an element holds what is not main text."""
    name, _, marks = sign.partition(".")
    if name in ASIDE_TAGS:
        return True
    return bool(marks) and name not in ("html", "body") and any(w in ASIDE_WORDS for w in _WORD.findall(marks))


def pattern(wrapper: list[Node]) -> str:
    """The wrapper as a regular expression over tokens, for reading."""
    out, optional, repeated = [], 0, False
    for n in [*wrapper, Node("", (), "")]:
        if repeated and (not n.repeated or n.optional != optional):
            out.append(")+")
            repeated = False
        if optional and n.optional != optional:
            out.append(")?")
            optional = 0
        if n.optional and n.optional != optional:
            out.append("(")
            optional = n.optional
        if n.repeated and not repeated:
            out.append("(")
            repeated = True
        out.append(n.symbol if n.symbol != "#" else "#text" if n.text is None else json.dumps(n.text))
    return " ".join(out).strip()


def infer(pages: list[str]) -> dict:
    """The wrapper of a host's pages: its pattern, and the path of the element that holds the main text."""
    wrapper: list[Node] = []
    for page in sorted(set(pages)):
        nodes = folded(page)
        wrapper = aligned(wrapper, nodes) if wrapper else nodes
    return {"main": main_element(wrapper), "pattern": pattern(wrapper)}


def main_element(wrapper: list[Node]) -> str:
    """Signature of the element that holds the main text; empty for the body."""
    slots: dict[tuple[str, ...], int] = {}
    for n in wrapper:
        if n.symbol == "#" and not any(aside(s) for s in n.path):
            for k in range(1, len(n.path) + 1):
                slots[n.path[:k]] = slots.get(n.path[:k], 0) + n.chars
    best: tuple[str, ...] = ()

    def widest(fits) -> tuple[str, ...]:
        """The element that fits and holds the most text; of equal ones the innermost."""
        return max((p for p in slots if fits(p[-1])), key=lambda p: (slots[p], len(p), p), default=())

    for fits in ([lambda s, t=t: s.partition(".")[0] == t for t in MAIN_TAGS]
                 + [lambda s, w=w: w in _WORD.findall(s.partition(".")[2]) and s.partition(".")[0] not in ("html", "body") for w in MAIN_WORDS]):
        best = widest(fits)
        # a tag's word is trusted; a class's only if most of the text stands there
        if best and (fits.__defaults__[0] in MAIN_TAGS or 2 * slots[best] >= max(slots.values())):
            break
        best = ()
    return best[-1] if best else ""


def extract(page: str, main: str) -> str:
    """Main text: all blocks in elements signed ``main`` (the whole body if none), in order, joined by a space."""
    for want in ([main, ""] if main else [""]):
        out: list[str] = []
        seen = want == ""
        last: tuple[str, ...] | None = None
        keep = False
        for symbol, text, path, ends in tokens(page):
            if symbol != "#":
                if ends or symbol == "br":
                    out.append(" ")
                continue
            if path is not last:
                inside = not want or want in path
                keep = inside and not any(_aside(s) for s in path)
                last = path
                seen |= inside
            if keep:
                out.append(entities.unescape(text) if "&" in text else text)
        if seen:
            return " ".join("".join(out).split())
    return ""


_ASIDE: dict[str, bool] = {}


def _aside(sign: str) -> bool:
    known = _ASIDE.get(sign)
    if known is None:
        known = aside(sign)
        if len(_ASIDE) < 50_000:
            _ASIDE[sign] = known
    return known


# ------------------------------------------------------------------ on Spark


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


_SHAPES = "host string, shape string, texts array<string>, chars array<bigint>"


def _packed(host: str, nodes: list[Node]) -> tuple:
    shape = json.dumps([(n.symbol, n.path, n.optional, n.repeated) for n in nodes])
    return host, shape, [n.text for n in nodes], [n.chars for n in nodes]


def _nodes(frame: pd.DataFrame) -> list[list[Node]]:
    """The shapes of a frame, in order of shape; rows of the same shape are added."""
    out: list[list[Node]] = []
    last = None
    for shape, texts, chars in frame.sort_values("shape")[["shape", "texts", "chars"]].itertuples(index=False):
        nodes = [Node(s, tuple(p), t, o, r, int(c)) for (s, p, o, r), t, c in zip(json.loads(shape), texts, chars)]
        if shape == last:
            for x, y in zip(out[-1], nodes):
                x.also(y)
        else:
            out.append(nodes)
        last = shape
    return out


def shapes(pages: DataFrame) -> DataFrame:
    """``host, shape, texts, chars``: the folded stream of every page, those of a host that are alike added within a task."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[Node]] = {}
        names, size = [c.split()[0] for c in _SHAPES.split(", ")], 0
        for frame in frames:
            for h, page in zip(frame["host"], frame["html"]):
                nodes = folded(page)
                key = h, tuple((n.symbol, n.path, n.repeated) for n in nodes)
                if key in held:
                    for x, y in zip(held[key], nodes):
                        x.also(y)
                else:
                    held[key] = nodes
                    size += len(page) + 1000
                if size >= HELD:
                    yield pd.DataFrame([_packed(h, n) for (h, _), n in held.items()], columns=names)
                    held.clear()
                    size = 0
        if held:
            yield pd.DataFrame([_packed(h, n) for (h, _), n in held.items()], columns=names)

    t = pages.where(F.col("html").isNotNull()).select(host(F.col("url")).alias("host"), "html")
    return t.mapInPandas(fold, _SHAPES)


def wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """``host``, ``main``, ``pattern``: the wrapper of every host, from all of its pages."""

    def widest(frame: pd.DataFrame) -> list[Node]:
        wrapper, *rest = _nodes(frame)
        for nodes in rest:
            wrapper = aligned(wrapper, nodes)
        return wrapper

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_packed(frame["host"].iloc[0], widest(frame))], columns=["host", "shape", "texts", "chars"])

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        w = widest(frame)
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "main": [main_element(w)], "pattern": [pattern(w)]})

    # tasks hand on a row for each shape they met: alike ones are one row before shapes are counted and aligned
    t = stage(shapes(pages).groupBy("host", "shape").applyInPandas(join, _SHAPES), "wrapper-shapes")
    while True:
        n = t.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        if (n.agg(F.max("_n")).first()[0] or 0) <= fan:
            return t.groupBy("host").applyInPandas(learn, "host string, main string, pattern string")
        block = F.pmod(F.xxhash64("shape"), F.ceil(F.col("_n") / fan)).alias("_k")
        t = t.join(n, "host").select(*t.columns, block)
        t = stage(t.groupBy("host", "_k").applyInPandas(join, _SHAPES), "wrapper-shapes")


def main_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long"
    known = stage(wrappers(pages), "wrappers")
    t = pages.select(F.col(key), "url", "html", host(F.col("url")).alias("host"))
    size = known.agg(F.sum(F.length("host") + F.length("main") + 100)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["main"] for r in known.select("host", "main").collect()})
        main = lambda frame: [shared.value.get(x, "") for x in frame["host"]]
    else:
        spread = known.select("host", "main").withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        t = t.withColumn("_salt", F.pmod(F.xxhash64(key, "url"), F.lit(SALTS)).cast("int")).join(spread, ["host", "_salt"], "left")
        main = lambda frame: [x if isinstance(x, str) else "" for x in frame["main"]]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                few = frame.iloc[at:at + 500]
                text = [extract(x, m) if isinstance(x, str) else "" for x, m in zip(few["html"], main(few))]
                yield pd.DataFrame({key: few[key], "url": few["url"], "text": text, "n_chars": [len(x) for x in text]})

    return t.mapInPandas(read, schema)
