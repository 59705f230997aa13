"""Main text of HTML pages: markup and structure first, then stretches that a host repeats, found with suffix arrays."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, discard, find_words, gram_hashes, materialise, member, mix, small_batches, slices, text_bytes, word_hashes
from .url_filter import url_parts

#: Words of a repeated stretch, at least, and different pages of the host that must have it outside articles, at least.
MIN_WORDS, MIN_PAGES = 10, 3
#: Repeated stretches that are sent to all executors (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST_RUNS = 2_000_000

#: Elements whose content is never text of the page.
RAW = frozenset("script style template iframe noembed noframes svg math textarea title noscript object select".split())
#: Elements that hold no article text, and words of class or id that say the same.
ASIDE = frozenset("nav footer aside form menu dialog button head fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted related respond "
    "share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget".split()
)
#: A class or id with one of these words may hold the article whatever else it names.
MAIN_NAMES = frozenset("article main content body entry post story with has page layout wrapper container".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
CONTAINERS = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table ul button head".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def is_aside(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether an element holds menus, notices, adverts, forms, comments and the like. A header counts only outside an article."""
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ASIDE_ROLES):
            return True
        if key in ("class", "id") and tag not in ("body", "html", "main", "article"):
            for name in value.split():
                words = set(re.split(r"[-_\d]+", name))
                if words & ASIDE_NAMES and not words & MAIN_NAMES:
                    return True
    return False


def tokens_of(html: str):
    """(text before, tag, attributes, whether it closes) of each tag, and the text after the last (tag None). Time is linear in the page.

    Quotes hide ``>`` inside a tag. Once quotes leave a tag open to the end of the page, all later tags end at the first ``>``. A
    ``<`` that starts no tag, or after which no ``>`` follows, is text. Comments and raw elements that never end reach to the end.
    """
    at = begin = 0
    last, strict = html.rfind(">"), True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            yield html[begin:at], "!", "", False
            begin = at = len(html) if end < 0 else end + 3
            continue
        if at > last:
            break
        closes = html.startswith("/", at + 1)
        name = NAME.match(html, at + 1 + closes)
        if name is None:
            if html.startswith(("!", "?"), at + 1):
                yield html[begin:at], "!", "", False
                begin = at = html.find(">", at) + 1
            else:
                at += 1
            continue
        end = name.end()
        while strict and not closes:
            stop = STOP.search(html, end)
            if stop is None:
                strict = False
            elif stop[0] == ">":
                end = stop.start()
                break
            elif (end := html.find(stop[0], stop.end()) + 1) == 0:
                strict = False
        if closes or not strict:
            end = html.find(">", name.end())
        tag, attributes = name[0].lower(), html[name.end() : end]
        yield html[begin:at], tag, attributes, closes
        begin = at = end + 1
        if tag in RAW and not closes and not attributes.endswith("/"):
            close = RAW_END[tag].search(html, at)
            end = html.find(">", close.end()) if close else -1
            begin = at = len(html) if end < 0 else end + 1
    yield html[begin:], None, "", False


def page_blocks(html: str) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order, character references decoded and white space made single blanks.

    Kind 2: inside an article or main element. 1: elsewhere. 0: in a menu, footer, notice, advert, form, comment or the like.
    """
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # container, kind outside it
    opened: Counter = Counter()
    kind, parts = 1, []

    def end_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((text, kind))
            parts.clear()

    for text, tag, raw, closes in tokens_of(html):
        if text:
            parts.append(text)
        if tag in BLOCKS:
            end_block()
        if closes:
            if opened[tag]:  # what is still open inside ends with it
                while True:
                    top, kind = stack.pop()
                    opened[top] -= 1
                    if top == tag:
                        break
        elif tag in CONTAINERS or tag in BLOCKS:
            if stack and stack[-1][0] == tag and tag not in CONTAINERS:  # a paragraph or item ends where the next begins
                kind = stack.pop()[1]
                opened[tag] -= 1
            found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in ATTRIBUTE.finditer(raw)] if raw else []
            aside = kind and is_aside(tag, found, kind == 2)
            if (tag in CONTAINERS and not raw.endswith("/")) or (aside and tag not in CONTAINERS and tag not in ("br", "hr")):
                stack.append((tag, kind))
                opened[tag] += 1
                if aside:
                    kind = 0
                elif kind == 1 and (tag in ("article", "main") or ("role", "main") in found):
                    kind = 2
    end_block()
    return blocks


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and how many tokens each has in common with the one before it (the first: 0).

    Ranks by the first 1, 2, 4 ... tokens until all differ; the common lengths are put together from those ranks, longest first.
    """
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, have = [rank.astype(np.int64)], 1
    while n and levels[-1].max() < n - 1:
        now = levels[-1]
        later = np.zeros(n, np.int64)
        later[: max(0, n - have)] = now[have:] + 1
        _, rank = np.unique(now * (n + 2) + later, return_inverse=True)
        levels.append(rank.astype(np.int64))
        have *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 2, -1, -1):
        fit = (a < n) & (b < n)
        fit[fit] = levels[k][a[fit]] == levels[k][b[fit]]
        a[fit] += 1 << k
        b[fit] += 1 << k
    common[1:] = a - order[1:]
    return order, common


class Streams:
    """The token streams of some pages: word hashes, the page, article flag and segment of each. A segment ends where a page, or its
    article, begins or ends; no stretch crosses that."""

    def __init__(self, pages: list[list[tuple[str, int]]]):
        data, offsets = text_bytes(pa.array([" ".join(t for t, _ in blocks) for blocks in pages], pa.large_string()))
        starts, ends, self.bounds = find_words(data, offsets, NOT_SPACE)
        self.words = word_hashes(data, starts, ends)
        self.page = np.repeat(np.arange(len(pages)), np.diff(self.bounds))
        kinds = [(k == 2, t.count(" ") + 1) for blocks in pages for t, k in blocks]
        self.article = np.repeat(np.array([k for k, _ in kinds], bool), np.array([n for _, n in kinds], np.int64))
        change = np.ones(len(self.words) + 1, bool)
        change[1:-1] = (self.page[1:] != self.page[:-1]) | (self.article[1:] != self.article[:-1])
        edge = np.flatnonzero(change)
        self.left = edge[np.searchsorted(edge, np.arange(len(self.words)), "right")] - np.arange(len(self.words)) if len(self.words) else np.zeros(0, np.int64)
        self.runs = gram_hashes(self.words, MIN_WORDS)
        self.starts = np.flatnonzero(self.left[: len(self.runs)] >= MIN_WORDS)

    def keys(self, at: np.ndarray, hosts: np.ndarray) -> np.ndarray:
        """The key of the MIN_WORDS words from each place on, at their host."""
        return mix(self.runs[at] ^ hosts[self.page[at]])


def host_hashes(hosts: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(hosts, pa.large_string()))
    filled = offsets[1:] > offsets[:-1]
    out = np.zeros(len(hosts), np.uint64)
    out[filled] = word_hashes(data, offsets[:-1][filled], offsets[1:][filled])
    return out


def repeated_runs(pages: list[list[tuple[str, int]]], hosts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, page) of stretches outside articles: for each stretch of MIN_WORDS words of a host, up to MIN_PAGES different pages.

    The streams of a host are laid end to end, each segment with an end of its own. An interval of the suffix array in which
    neighbours have MIN_WORDS words in common is one stretch. Pages of equal text are one page.
    """
    s, host = Streams(pages), host_hashes(hosts)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s.words + (np.arange(len(s.words)) - s.bounds[s.page]).astype(np.uint64)))])
    same = mix(total[s.bounds[1:]] - total[s.bounds[:-1]])
    keys, owners = [], []
    outside = np.flatnonzero(~s.article)
    for h in np.unique(host[s.page[outside]]):
        at = outside[host[s.page[outside]] == h]
        last = s.left[at] == 1
        place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(last)[:-1]])  # one free place after each segment
        _, flat = np.unique(s.words[at], return_inverse=True)
        tokens, source = np.arange(len(at) + last.sum(), dtype=np.int64) + len(at), np.full(len(at) + last.sum(), -1, np.int64)
        tokens[place], source[place] = flat, at
        order, common = suffix_array(tokens)
        interval = np.cumsum(common < MIN_WORDS)
        whole = source[order] >= 0
        whole[whole] = s.left[source[order][whole]] >= MIN_WORDS
        interval, where = interval[whole], source[order][whole]
        if not len(where):
            continue
        page = same[s.page[where]]
        sort = np.lexsort((page, interval))
        interval, where, page = interval[sort], where[sort], page[sort]
        new = np.concatenate([[True], (interval[1:] != interval[:-1]) | (page[1:] != page[:-1])])
        interval, where, page = interval[new], where[new], page[new]
        begin = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        few = np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where)))) < MIN_PAGES
        keys.append(s.keys(where[few], host))
        owners.append(page[few])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(keys + none), np.concatenate(owners + none)


def main_texts(pages: list[list[tuple[str, int]]], hosts: list[str], is_repeated) -> list[str]:
    """The main text of each page: the blocks inside its article or main element, or without one those in no menu or the like.

    Words outside articles in a stretch that ``is_repeated(keys, pages)`` knows are left out, unique runs stay.
    """
    s = Streams(pages)
    often = s.starts[is_repeated(s.keys(s.starts, host_hashes(hosts)), s.page[s.starts])]
    mark = np.zeros(len(s.words) + 1, np.int64)
    np.add.at(mark, often, 1)
    np.add.at(mark, often + MIN_WORDS, -1)
    covered = (np.cumsum(mark[:-1]) > 0) & ~s.article  # an article is wanted whole, though menus and teasers quote it
    hit = np.unique(s.page[covered])
    texts = []
    for i, blocks in enumerate(pages):
        wanted = 2 if any(k == 2 for _, k in blocks) else 1
        if i not in hit:
            texts.append(" ".join(t for t, k in blocks if k == wanted))
            continue
        at, kept = s.bounds[i], []
        for text, kind in blocks:
            words = text.split(" ")
            if kind == wanted:
                kept += [w for w, c in zip(words, covered[at : at + len(words)], strict=True) if not c]
            at += len(words)
        texts.append(" ".join(kept))
    return texts


def host_runs(base: DataFrame) -> DataFrame:
    """(key) of the stretches that MIN_PAGES different pages of a host have outside articles. ``base`` has _html and _host.

    Each task sends up to MIN_PAGES pages a stretch, so the count of different pages is right up to MIN_PAGES whatever the tasks.
    """

    def find(batches):
        for batch in batches:
            for part, texts in slices(batch, "_html"):
                key, page = repeated_runs([page_blocks(t) for t in texts.to_pylist()], part.column("_host").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(page.view(np.int64))], ["key", "page"])

    found = small_batches(base.select("_host", "_html")).mapInArrow(find, "key long, page long").distinct()
    return found.groupBy("key").count().where(F.col("count") >= MIN_PAGES).select("key")


def page_runs(base: DataFrame, runs: DataFrame) -> DataFrame:
    """(_page, _runs): the keys of ``runs`` that each page has. ``base`` has _page, _html and _host."""

    def find(batches):
        for batch in batches:
            for part, texts in slices(batch, "_html"):
                s = Streams([page_blocks(t) for t in texts.to_pylist()])
                keys = s.keys(s.starts, host_hashes(part.column("_host").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("_page").take(pa.array(s.page[s.starts])), pa.array(keys.view(np.int64))], ["_page", "key"])

    found = small_batches(base.select("_page", "_host", "_html").dropDuplicates(["_page"])).mapInArrow(find, "_page string, key long").distinct()
    return found.join(runs, "key").groupBy("_page").agg(F.collect_list("key").alias("_runs"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    The text is that of the page's article or main element, or without one that of all blocks in no menu, footer, notice, advert,
    form or the like. Of such blocks, stretches that MIN_PAGES different pages of the host repeat outside their articles are left out;
    articles come out whole, whatever quotes them.
    A null html is empty and gives an empty text; pages without a host are one host. Repeated rows give repeated results and count
    as one page. An empty table gives an empty result. Other columns of any name do not matter. Stretches are compared by 64-bit
    keys. Neither the order of rows nor their partitions change the result.
    """
    base = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"), url_parts(F.col(url_col))[0].alias("_host"))
    runs = materialise(host_runs(base), "runs")
    few = runs.count() <= MAX_BROADCAST_RUNS
    names, shared = [id_col, url_col], None
    if few:
        keys = runs.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
        shared = base.sparkSession.sparkContext.broadcast(np.sort(keys))
        discard(runs)
        dealt = base
    else:
        keyed = base.withColumn("_page", F.md5(F.concat_ws(" ", F.md5("_host"), F.coalesce("_html", F.lit("")))))
        dealt = keyed.join(page_runs(keyed, runs), "_page", "left").select(*names, "_html", "_host", "_runs")

    def choose(batches):
        for batch in batches:
            for part, texts in slices(batch, "_html"):
                if few:
                    known = lambda keys, page: member(keys, shared.value)
                else:
                    own = [np.sort(np.array(r or [], np.int64).view(np.uint64)) for r in part.column("_runs").to_pylist()]

                    def known(keys, page, own=own):
                        out = np.zeros(len(keys), bool)
                        for i in np.unique(page):
                            out[page == i] = member(keys[page == i], own[i])
                        return out

                found = main_texts([page_blocks(t) for t in texts.to_pylist()], part.column("_host").to_pylist(), known)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*names, "text", "n_chars"])

    ids = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in names)
    return small_batches(dealt).mapInArrow(choose, f"{ids}, text string, n_chars long")
