"""Operator 8: HTML extraction by wrappers inferred per host.

A page becomes a stream of block tokens: start and end tags of block elements (with class and id) and text slots. Inline tags Repeated groups fold into one (`(p #T /p)+`), so pages made from one template give nearly equal streams. Streams of a host are
aligned one after the other: tokens that agree stay, mismatches become optional groups, and a text slot keeps the texts that all its
pages share. The result is a union-free regular expression, the wrapper of the host. Texts that enough different pages share at a slot
are template text. The main region is the deepest block that holds all other text, inside an article or main where the host has one.
Blocks marked as something else, by tag, role or class, are left out in any case. With these each page is read.

Streams are reduced to distinct ones inside each task, and hosts are aligned in two steps, first over salted parts, so a host with
a third of all pages is never in one task.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from spotweave.llm.common import bounded_batches, text_of
from spotweave.llm.url_reputation import url_parts
from spotweave.session import materialise

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
NOT_CONTENT = frozenset("nav header footer aside form dialog button menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = frozenset("article main".split())
BLOCKED = re.compile(
    r"(^|[-_\s])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|side|aside|"
    r"widget\w*|cookies?|consent|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|"
    r"comments?|comment-?list|commentlist|respond|replies|reply|disqus|related|recommended|pagination|pager|toolbar|skip-link)($|[-_\s])", re.I
)
# an element that ends where the next of its kind starts
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\s(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_DIGITS = re.compile(r"\d+")


class Block:
    """A start tag on the stack: its name, label with attributes, and whether the element itself is no content."""

    __slots__ = ("name", "label", "blocked", "main")

    def __init__(self, name: str, tag: str) -> None:
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(tag)} if len(tag) > len(name) + 2 else {}
        words = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "").lower()
        self.name = name
        self.main = name in MAIN or role == "main"
        self.blocked = name in NOT_CONTENT or role in ROLES or "hidden" in attrs or (name not in MAIN and name != "body" and bool(BLOCKED.search(words)))
        self.label = name + "".join("." + _DIGITS.sub("0", w) for w in sorted(words.split()))


def walk(page: str) -> Iterator[tuple[str, object]]:
    """("open", Block), ("close", Block), ("text", str) and ("break", None), with raw elements left out and open elements closed."""
    stack: list[Block] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        token, at = m.group(), m.end()
        if token[0] != "<" or token == "<":
            yield "text", token
            continue
        if token.startswith("<![CDATA["):
            yield "text", token[9:].removesuffix("]]>")
            continue
        found = _NAME.match(token)
        if not found:
            continue
        name = found.group(1).lower()
        if token[1] == "/":
            if name in INLINE:
                continue
            if name == "br":
                yield "break", None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    while len(stack) > i:
                        yield "close", stack.pop()
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            if not token.endswith("/>"):
                at = end.end() if end else n
            yield "break", None
            continue
        if name in INLINE:
            continue
        if name in VOID:
            yield "break", None
            continue
        if stack and stack[-1].name in CLOSES.get(name, ()) or stack and stack[-1].name == "p" and name in BLOCK_ENDS_P:
            yield "close", stack.pop()
        block = Block(name, token)
        stack.append(block)
        yield "open", block
    while stack:
        yield "close", stack.pop()


def fold(tokens: list, values: list) -> tuple[list, list]:
    """Repeated neighbouring groups once, marked by + on their first token. Groups are whole elements, inner ones first.

    `values` has a list per token; tokens that fold into one join theirs.
    """
    out: list = []
    held: list = []
    starts: list[int] = []
    for t, v in zip(tokens, values):
        if t[0] != "/":
            if t[0] != "#":
                starts.append(len(out))
            elif out and out[-1][0] == "#":
                held[-1].extend(v)
                continue
            out.append(t)
            held.append(v)
            continue
        out.append(t)
        held.append(v)
        a = starts.pop() if starts else 0
        group = out[a:]
        k = len(group)
        if a >= k and out[a - k + 0].rstrip("+") == group[0].rstrip("+") and [x.rstrip("+") for x in out[a - k : a]] == [x.rstrip("+") for x in group]:
            for old, new in zip(held[a - k : a], held[a:]):
                old.extend(new)
            del out[a:], held[a:]
            out[a - k] = group[0].rstrip("+") + "+"
    return out, held


def _key(label: str, text: str) -> int:
    """Names a text of a block."""
    return xxhash.xxh3_64_intdigest(f"{label}\0{text}") >> 1


def stream(page: str) -> tuple[list, list, list]:
    """Folded tokens of a page, and two values per token, 0 for tags.

    Of a text slot the first is [texts, pages, changed]: keys and lengths of its texts, a hash of the page's text, and whether its
    texts differ between pages; the second is [length, labels, blocked]: the blocks around it (those of a main part end in " @") and
    whether one of them is marked as no content.
    """
    tokens: list = []
    values: list = []
    around: list = []
    path: list[Block] = []
    current: list[str] = []
    whole = xxhash.xxh3_64()

    def flush() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocked = any(b.blocked and b.name not in ("html", "body") for b in path)
            if not blocked:
                whole.update(text + "\0")
            labels = [b.label + " @" * b.main for b in path]
            tokens.append("#")
            values.append([(_key(path[-1].label if path else "", text), len(text), labels, blocked)])

    for kind, x in walk(page):
        if kind == "text":
            current.append(x)
            continue
        if kind == "break":
            current.append(" ")
            continue
        flush()
        if kind == "open":
            path.append(x)
        elif path:
            path.pop()
        tokens.append(x.label if kind == "open" else "/" + x.name)
        values.append([])
    flush()
    names, held = fold(tokens, values)
    own = whole.intdigest() >> 1
    for v in held:
        around.append([sum(x[1] for x in v), v[0][2], v[0][3]] if v else 0)
    return names, [[[list(x) for x in {y[0]: y[:2] for y in v}.values()], [own], False] if v else 0 for v in held], around


def _shared(a, b):
    """The texts of two slots as one: -1 where they share none."""
    if a == 0 or b == 0 or a == -1 or b == -1:
        return -1 if -1 in (a, b) else 0
    there = {x[0] for x in b[0]}
    texts = [x for x in a[0] if x[0] in there]
    return [texts, sorted({*a[1], *b[1]})[:SURE_PAGES], a[2] or b[2] or len(texts) < max(len(a[0]), len(b[0]))] if texts else -1


def _around(a, b):
    return [a[0] + b[0], [x for x in a[1] if x in b[1]], a[2] and b[2]] if a and b else 0


def align(w: list, s: list) -> list:
    """Two aligned expressions as one. Nodes: [token, optional, texts, around, pages], values as in `stream`; texts -1: none is shared."""
    a, b = [x[0].rstrip("+") for x in w], [x[0].rstrip("+") for x in s]
    out: list = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(w[i:j], s[k:m]):
                token = x[0] if x[0].endswith("+") else y[0]
                out.append([token, x[1] or y[1], _shared(x[2], y[2]), _around(x[3], y[3]), x[4] + y[4]])
        else:
            out += [[x[0], True, *x[2:]] for x in w[i:j]] + [[y[0], True, *y[2:]] for y in s[k:m]]
    return out


def infer(parts: list[str]) -> str:
    """The wrapper of several aligned expressions (JSON), most pages first."""
    nodes = sorted((json.loads(p) for p in parts), key=lambda x: (-max((n[4] for n in x), default=0), json.dumps(x)))
    out = nodes[0]
    for x in nodes[1:]:
        out = align(out, x)
    return json.dumps(out)


LEAST_PAGES, SURE_PAGES = 3, 6


def template_texts(slots: list) -> list[int]:
    """Keys of the texts that the pages of a host repeat.

    A text is one if at least LEAST_PAGES different pages, and half of all pages, have the slot and all of these have the text. Where
    such texts are more than half of all text, the pages may be near copies of one another: SURE_PAGES different ones are asked for.
    Pages count as different by their text, so copies are one page.
    """
    pages = max((n[4] for n in slots), default=0)
    total = sum(n[3][0] for n in slots)

    def repeated(least: int) -> list:
        return [(n[4], x) for n in slots if n[2] != -1 and len(n[2][1]) >= least and 2 * n[4] >= pages for x in n[2][0]]

    found = repeated(LEAST_PAGES)
    if 2 * sum(k * x[1] for k, x in found) > total:
        found = repeated(SURE_PAGES)
    return sorted({x[0] for _, x in found})


def regions(wrapper: list) -> tuple[str, list[int]]:
    """The label of the main region and keys of template texts, from a wrapper.

    The region is the deepest block around all text that is neither template text nor in a block marked as something else; where there
    are articles or main elements, around all such text inside them, and itself one of them. An empty label: no single block does.
    """
    slots = [n for n in wrapper if n[0] == "#" and not n[3][2]]
    template = template_texts(slots)
    known = set(template)
    named = [n for n in slots if any(x.endswith(" @") for x in n[3][1])]
    told = [n for n in slots if n[2] == -1 or n[2][2] or any(x[0] not in known for x in n[2][0])]
    if named:
        told = [n for n in told if any(n is m for m in named)] or named
    paths = [n[3][1] for n in told]
    fits = (lambda x: x.endswith(" @")) if named else (lambda x: x.split(".")[0] in ("div", "section", "td", "body"))
    around = [x for x in (paths[0] if paths else []) if fits(x) and all(x in p for p in paths[1:])]
    return (around[-1].removesuffix(" @") if around else ""), template


def read(page: str, main: str, template: frozenset) -> str:
    """The text of the main region without template texts, blocks joined by one space.

    Pages that lack the region are read by their articles and main elements, and those that lack these as a whole.
    """
    for hit in [*([lambda b: b.label == main] if main else []), lambda b: b.main, None]:
        inside = 0 if hit else 1
        blocked = 0
        had = not hit
        current: list[str] = []
        blocks: list[str] = []
        path: list[str] = []

        def flush() -> None:
            raw = " ".join("".join(current).split())
            current.clear()
            if raw and _key(path[-1] if path else "", raw) not in template:
                blocks.append(" ".join(html.unescape(raw).split()))

        for kind, x in walk(page):
            if kind == "text" or kind == "break":
                if inside and not blocked:
                    current.append(x or " ")
                continue
            if inside and not blocked:
                flush()
            step = 1 if kind == "open" else -1
            if kind == "open":
                path.append(x.label)
            elif path:
                path.pop()
            if hit and hit(x):
                inside += step
                had = True
            elif x.blocked and x.name not in ("html", "body"):
                blocked += step
        if inside and not blocked:
            flush()
        if had:
            return " ".join(b for b in blocks if b)
    return ""


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, salt, part): distinct streams of a batch, as expressions with their counts."""
    for batch in batches:
        found: dict = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names, hashes, lengths = stream(page)
            key = (host, tuple(n.rstrip("+") for n in names))
            old = found.get(key)
            new = [[n, False, h, v, 1] for n, h, v in zip(names, hashes, lengths)]
            found[key] = align(old, new) if old else new
        rows = [(h, xxhash.xxh32_intdigest("\0".join(k)) % 64, json.dumps(v)) for (h, k), v in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))], names=["host", "salt", "part"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, main, template) from rows of host and html."""
    parts = pages.mapInArrow(_streams, "host string, salt int, part string")
    merge = lambda key, df: pd.DataFrame({"host": [key[0]], "part": [infer(list(df["part"]))]})
    some = parts.groupBy("host", "salt").applyInPandas(merge, "host string, part string")

    def whole(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        w = infer(list(df["part"]))
        main, template = regions(json.loads(w))
        return pd.DataFrame({"host": [key[0]], "wrapper": [w], "main": [main], "template": [template]})

    return some.groupBy("host").applyInPandas(whole, "host string, wrapper string, main string, template array<long>")


SALTS = 16


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id, url, text` for every row of `pages`.

    A null html is empty and gives an empty text; a null url belongs to the empty host. Repeated rows and null ids are kept; other
    columns do not take part. A host with a single page has a wrapper of that page alone.
    """
    host, _ = url_parts(F.col(url_col))
    d = bounded_batches(pages).select("page_id", F.col(url_col).alias("url"), host.alias("host"), text_of(html_col).alias("html"))
    known = materialise(wrappers(d.select("host", "html"))).select("host", "main", "template")

    @F.pandas_udf(T.StringType())
    def text_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html_s, main_s, template_s in batches:
            yield pd.Series([read(h, m or "", frozenset(t) if t is not None else frozenset()) for h, m, t in zip(html_s, main_s, template_s)], dtype=object)

    # hosts are dealt over salts, so pages of a large host spread; Spark broadcasts the wrappers where they are small
    salted = d.withColumn("_salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(known, ["host", "_salt"], "left").select("page_id", "url", text_udf("html", "main", "template").alias("text"))
