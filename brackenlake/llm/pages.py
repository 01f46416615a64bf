"""Main text of web pages (op3): markup to blocks, and a suffix array over the pages of a host for what repeats.

A page is parsed to blocks, each in a zone: content (article, main), chrome (menus, headers, footers,
asides, notices, adverts, forms, comments) or unmarked. The token streams of a host's pages outside
content are joined, and a suffix array finds long runs of tokens that stand in several distinct
pages, over block ends. Blocks that a page marks as content are kept and blocks that it marks as
chrome dropped, as articles may repeat passages and menus may be unique; of all unmarked blocks, on
any page, what lies in such a run is removed and the unique runs are kept.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Tokens of a run (a block's end is one), and distinct pages that it must stand in, to count as boilerplate.
RUN, RUN_PAGES = 10, 3
#: Pages and characters of a host that one task compares; of a larger host the runs are found by an aggregation.
HOST_PAGES, HOST_CHARS = 500, 48 << 20
#: Hosts of more pages than that up to which their hashes are sent to all executors; more are joined by shuffle.
SENT_HOSTS = 100_000

#: Element names of HTML and usual names of page parts.
_UNSEEN = {"script", "style", "noscript", "template"}
_CONTROLS = {"iframe", "select", "textarea", "button"}
_CHROME_TAGS = {"nav", "footer", "aside", "menu", "dialog", "head", "title"}
_CLOSERS = {"article", "main", "body", "section", "div", "p", "nav", "footer", "aside", "ul", "ol", "table", "h1", "h2", "h3", "form"}
_CLOSED = {"p", "title", "head", "option"}
_CONTENT_TAGS = {"article", "main"}
_CHROME_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
#: A tag without < in it, looked at no further than to the next one; and any tag by the rule of quotes.
_TAG = re.compile(r"</?[a-zA-Z](?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>")
_QUOTED_TAG = re.compile(r"</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _UNSEEN | _CONTROLS}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CONTENT, UNMARKED, CHROME = 2, 1, 0
#: Inside a form: chrome if the form has controls, and not around an article.
_FORM = -1
#: Parts of a class name that say that something is not there, or elsewhere.
_NOT = {"has", "no", "not", "with", "without", "hide", "show", "layout"}


def _names_chrome(value: str, whole: bool) -> bool:
    """Whether one of the class names is that of a page part, as a whole or (has-sidebar and the like aside) by a part of it."""
    for name in value.split():
        parts = set(re.split(r"[^a-z0-9]+", name))
        if name in _CHROME_NAMES or not whole and parts & _CHROME_NAMES and not parts & _NOT:
            return True
    return False


def _zone(name: str, tag: str, zone: int) -> int:
    """The zone inside an element that opens in a zone. An article or main part is content unless its whole class names chrome; it is so inside a form too."""
    own = name in _CONTENT_TAGS
    if zone == CHROME or zone == _FORM and not own:
        return zone
    if name == "form":
        return _FORM
    if name in _CHROME_TAGS or (name == "header" and zone != CONTENT):
        return CHROME
    if "=" in tag or "hidden" in tag:
        for m in _ATTR.finditer(tag):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "role" and value in _CHROME_ROLES:
                return CHROME
            if key in ("class", "id") and name not in ("body", "html") and _names_chrome(value, own):
                return CHROME
            if key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
                return CONTENT
    return CONTENT if own else zone


def _parts(page: str):
    """(text, tag) in page order; comments, scripts and controls are left out, each search runs over the page a bounded number of times.

    What is not closed ends early instead of taking the rest of the page along: a comment or a tag
    with an odd quote at the next >, a script at the next tag, a control at its own tag.
    """
    at, lost = 0, set()  # ends that are looked for no more, as none is left
    while m := _START.search(page, at):
        i = m.start()
        text = page[at:i]
        if page[i + 1] in "!?":
            end = page.find("-->", i + 2) if page.startswith("<!--", i) and "--" not in lost else -1
            if end < 0 and page.startswith("<!--", i):
                lost.add("--")
            at = end + 3 if end >= 0 else page.find(">", i) + 1
            tag = ""
        else:
            m = _TAG.match(page, i)
            if m is None and '"' not in lost:
                m = _QUOTED_TAG.match(page, i)
                if m is None:
                    lost.add('"')
            at = m.end() if m else page.find(">", i) + 1
            tag = page[i:at]
            name = _NAME.match(tag)[1].lower() if at else ""
            if name in _END and tag[1] != "/":
                end = _END[name].search(page, at) if name not in lost else None
                if end:
                    at, tag = end.end(), "<input>" if name in _CONTROLS else ""
                else:
                    lost.add(name)
                    if name in ("script", "style"):
                        n = _START.search(page, at)
                        at, tag = n.start() if n else len(page), ""
        if not at:  # no > is left
            yield page[i - len(text) :], ""
            return
        yield text, tag
    yield page[at:], ""


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order; references decoded, white space one space."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = UNMARKED
    controls, forms = 0, []  # of each open form: blocks and controls before it, the zone around

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((zone, text))
            held.clear()

    def leave(to: int):
        """Elements from a place on end; a form that had no controls is no form."""
        nonlocal zone
        zone = stack[to][1]
        gone = sum(n == "form" for n, _ in stack[to:])
        del stack[to:]
        for _ in range(min(gone, len(forms))):
            first, before, around = forms.pop()
            if before == controls:
                out[first:] = [(around if z == _FORM else z, t) for z, t in out[first:]]

    for text, part in _parts(page):
        if text:
            held.append(text)
        if not part:
            continue
        name = _NAME.match(part)[1].lower()
        if name in _INLINE and name not in ("label",):
            if name == "a" or "=" not in part:
                continue
            if part[1] != "/" and _zone(name, part, zone) == zone:
                stack.append((name, zone))
                continue
        if name == "br":
            held.append(" ")
            continue
        if name in _VOID:
            controls += name == "input"
            flush()
            continue
        if part[1] == "/":
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != name:
                k -= 1
            if name not in _INLINE or k >= 0 and stack[k][1] != zone:
                flush()
            if k >= 0:
                leave(k)
        else:
            flush()
            if name in _CLOSERS:
                while stack and stack[-1][0] in _CLOSED:  # a paragraph ends where a block begins
                    zone = stack.pop()[1]
            if name == "li" and stack and stack[-1][0] == "li":
                zone = stack.pop()[1]
            if not part.endswith("/>"):
                stack.append((name, zone))
                if name == "form":
                    forms.append((len(out), controls, zone))
                zone = _zone(name, part, zone)
    flush()
    if stack:
        leave(0)
    return [(CHROME if z == _FORM else z, t) for z, t in out]


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of s in order, and of each the length of what it shares with the one before.

    Ranks double in length until all differ; the kept ranks of each length give the shared lengths.
    """
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, h = [rank], 1
    while n and rank.max() < n - 1 and h < n:
        far = np.full(n, -1, np.int64)
        far[:-h] = rank[h:]
        both = (rank << 32) + far + 1
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        h *= 2
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same << k
        shared[1:] += step
        a, b = a + step, b + step
    return order, shared


_BLOCK_END = "\n"


def segments(page: list[tuple[int, str]]) -> list[list[str]]:
    """Tokens of a page's blocks outside content, with an end after each block; content parts segments."""
    out: list[list[str]] = [[]]
    for zone, text in page:
        if zone == CONTENT:
            out.append([])
        else:
            out[-1] += text.split(" ")
            out[-1].append(_BLOCK_END)
    return [x for x in out if x]


def _settled(any_: np.ndarray, inside: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What goes: blocks that runs cover whole, and of others the runs that lie in the block alone.

    So a run over block ends takes no words of the block in which it stops.
    """
    starts = np.concatenate(([0], np.flatnonzero(end)[:-1] + 1))
    whole = np.logical_and.reduceat(any_, starts)
    return inside | np.repeat(whole, np.diff(np.append(starts, len(end))))


def covered(streams: list[list[list[str]]], names: list) -> list[list[np.ndarray]]:
    """Of each page (segments of tokens) which tokens go, by runs of RUN tokens or more that RUN_PAGES distinct pages have.

    Pages of one name are one page; runs end with segments, but not with blocks.
    """
    parts = [b for x in streams for b in x]
    if not parts:
        return [[] for _ in streams]
    lengths = np.array([len(b) for b in parts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    s = np.empty(ends[-1] + 1, np.int64)
    inner = np.ones(len(s), bool)
    inner[ends] = False
    tokens = np.array([t for b in parts for t in b], object)
    s[inner] = pd.factorize(tokens)[0] + len(parts)
    s[ends] = np.arange(len(parts))  # an end that no other segment has
    name = np.unique(np.asarray(names), return_inverse=True)[1]
    page = np.repeat(np.repeat(name, [len(x) for x in streams]), lengths + 1)
    order, shared = suffix_array(s)
    group = np.cumsum(shared < RUN) - 1  # suffixes that share RUN tokens
    pairs = np.unique(group * len(streams) + page[order])
    often = np.bincount(pairs // len(streams), minlength=group.max() + 1) >= RUN_PAGES
    end = np.zeros(len(s), bool)
    end[inner] = tokens == _BLOCK_END
    ends_before = np.concatenate(([0], np.cumsum(end)))
    at = order[often[group]]
    gone = []
    for some in (at, at[ends_before[np.minimum(at + RUN, len(s))] == ends_before[at]]):
        step = np.zeros(len(s) + RUN + 1, np.int64)
        step[some] += 1
        step[some + RUN] -= 1
        gone.append((np.cumsum(step)[: len(s)] > 0)[inner])
    each = iter(np.split(_settled(*gone, end[inner]), np.cumsum(lengths)[:-1]))
    return [[next(each) for _ in x] for x in streams]


def _grams(stream: list[list[str]]) -> list[np.ndarray]:
    """Of each segment the 64-bit hashes of its RUN consecutive tokens."""
    return [np.array([xxhash.xxh64_intdigest(" ".join(b[i : i + RUN]).encode("utf-8", "surrogatepass")) - (1 << 63) for i in range(len(b) - RUN + 1)], np.int64) for b in stream]


def covered_by(stream: list[list[str]], often: np.ndarray) -> list[np.ndarray]:
    """Of each segment of a page which tokens go by these runs, as covered() tells for whole hosts."""
    out = []
    for b, g in zip(stream, _grams(stream)):
        end = np.array([t == _BLOCK_END for t in b])
        any_, inside = np.zeros(len(b), bool), np.zeros(len(b), bool)
        for k in np.flatnonzero(np.isin(g, often)):
            any_[k : k + RUN] = True
            if not end[k : k + RUN].any():
                inside[k : k + RUN] = True
        out.append(_settled(any_, inside, end))
    return out


def unique_text(page: list[tuple[int, str]], cover: list[np.ndarray]) -> str:
    """Content, and what of unmarked blocks is not covered, in page order."""
    gone, at, out = np.concatenate([np.empty(0, bool), *cover]), 0, []
    for zone, text in page:
        if zone == CONTENT:
            out.append(text)
            continue
        words = text.split(" ")
        if zone == UNMARKED:
            out += [w for w, g in zip(words, gone[at : at + len(words)]) if not g]
        at += len(words) + 1
    return " ".join(out)


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)"


def _plain(column: pd.Series) -> pd.Series:
    """A column as Python values, numbered from 0."""
    return pd.Series(column.tolist(), dtype=object if column.dtype != "int64" else "int64")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A page without unmarked blocks is done where it is parsed. What goes to the task of a host is
    the text outside content, and the content of pages with unmarked blocks. Of a host of more than
    HOST_PAGES pages or HOST_CHARS characters no task holds all: the suffixes are told apart by their first RUN tokens, over
    all tasks, and distinct pages are counted for each, which gives the same runs. Null or empty
    html has the text ''; a null or odd url belongs to the host ''; repeated rows come out each and
    count as one page (as do pages of equal html); other columns are left out.
    """
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))))
    html_ = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", host.alias("host"), html_.alias("html"), F.xxhash64(html_).alias("name"))

    def parse(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                yield pdf.iloc[at : at + 256], [blocks(x) for x in pdf["html"].iloc[at : at + 256]]

    done = "page_id string, url string, text string, n_chars long"

    def table(pdf, text: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"page_id": _plain(pdf["page_id"]), "url": _plain(pdf["url"]), "text": pd.Series(text, dtype=object), "n_chars": pd.Series(map(len, text), dtype="int64")})

    def plain(batches):
        for some, found in parse(batches):
            k = [i for i, b in enumerate(found) if all(z != UNMARKED for z, _ in b)]
            yield table(some.iloc[k], [" ".join(t for z, t in found[i] if z == CONTENT) for i in k])

    def others(batches):
        for some, found in parse(batches):
            todo = [any(z == UNMARKED for z, _ in b) for b in found]
            k = [i for i, b in enumerate(found) if any(z != CONTENT for z, _ in b)]
            yield pd.DataFrame({
                **{c: _plain(some[c].iloc[k]) for c in ("page_id", "url", "host", "name")},
                "todo": pd.Series([todo[i] for i in k], dtype=bool),
                "zones": pd.Series([[z for z, _ in found[i]] for i in k], dtype=object),
                "texts": pd.Series([[t if todo[i] or z != CONTENT else "" for z, t in found[i]] for i in k], dtype=object),
            })

    streams = "page_id string, url string, host long, name long, todo boolean, zones array<int>, texts array<string>"

    def pages_of(pdf: pd.DataFrame) -> list[list[tuple[int, str]]]:
        return [list(zip(z, t)) for z, t in zip(pdf["zones"], pdf["texts"])]

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pages_of(pdf)
        k = np.flatnonzero(pdf["todo"].to_numpy(bool))
        if not len(k):
            return table(pdf.iloc[:0], [])
        cover = covered([segments(x) for x in found], pdf["name"].tolist())
        return table(pdf.iloc[k], [unique_text(found[i], cover[i]) for i in k])

    def runs(batches):
        for pdf in batches:
            each = [np.unique(np.concatenate([np.empty(0, np.int64), *_grams(segments(x))])) for x in pages_of(pdf)]
            yield pd.DataFrame({"row": pdf["row"], "host": pdf["host"], "name": pdf["name"], "todo": pdf["todo"], "grams": each})

    def judge_rows(batches):
        for pdf in batches:
            text = [unique_text(x, covered_by(segments(x), np.array([] if o is None else o, np.int64))) for x, o in zip(pages_of(pdf), pdf["often"])]
            yield table(pdf, text)

    big = base.cut(p.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars")).where((F.col("n") > HOST_PAGES) | (F.col("chars") > HOST_CHARS)).select("host"))
    n_big = big.count()
    big = F.broadcast(big) if n_big <= SENT_HOSTS else big
    out = p.select("page_id", "url", "html").mapInPandas(plain, done)
    rest = p.join(big, "host", "left_anti").select(p.columns) if n_big else p
    out = out.unionByName(rest.mapInPandas(others, streams).groupBy("host").applyInPandas(judge, done))
    if n_big:
        hot = base.cut(p.join(big, "host", "left_semi").select(p.columns).mapInPandas(others, streams).withColumn("row", F.monotonically_increasing_id()))
        todo = hot.where("todo")
        if not todo.isEmpty():
            grams = hot.select("row", "host", "name", "todo", "zones", "texts").mapInPandas(runs, "row long, host long, name long, todo boolean, grams array<long>")
            grams = base.cut(grams.select("row", "name", "todo", "host", F.explode("grams").alias("key")))
            often = base.cut(grams.select("host", "key", "name").distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= RUN_PAGES).select("host", "key"))
            mine = base.cut(grams.where("todo").join(often, ["host", "key"]).groupBy("row").agg(F.collect_list("key").alias("often")))  # a page's own runs
            out = out.unionByName(todo.join(mine, "row", "left").select("page_id", "url", "zones", "texts", "often").mapInPandas(judge_rows, done))
    return out.withColumn("page_id", F.col("page_id").cast(dict(pages.dtypes)["page_id"]))
