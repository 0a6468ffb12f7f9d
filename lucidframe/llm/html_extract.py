"""Main text of web pages: markup as evidence of a page's parts, and a suffix array over each host for what it repeats.

A page is read into blocks with a zone: `chrome` (menus, headers, footers, notices, adverts, reader comments, by element or role, or by a
class or id all of whose words say so), `frame` (forms, and parts called sidebar or widget: chrome, but they may stand round
the whole page, so an article or main inside leaves them, and where a page has no other text they are plain), `article` (inside
article, main or their role; main leaves all chrome) or `plain`. Scripts, styles, heads and hidden parts are no text at all. Candidates for the main text are the article blocks
of a page that names its article, and the plain blocks of any other, of which article blocks that hold less than
`TEASER` of the article and plain text are part.

Which tokens of the candidates are boilerplate is decided for every page by its host. Candidates are cut into units: a
block of RUN tokens or more, or neighbouring shorter blocks together. The token streams of a host's pages are put one after
the other and the suffixes that begin in units of the same place of the template (the nth unit from the page's nearer end) are
sorted; neighbours with RUN tokens in common are a repeated substring, and the distinct pages it stands on are counted among the
host's pages of its kind, with an article or without. Outside articles one is boilerplate on `PLACED` pages (all of a smaller
host's, two at least). Inside articles, where the markup speaks for it and stories quote each other, it must be the host's
template: on `PLACED` pages and more than half of them. Its tokens go; unique runs stay, and so does a passage that stories share in
different places or on fewer pages. Pages with equal candidates count as one, or copies would delete each other; an article of
whose tokens more than half are repeated is a copy of other articles, not template, and stays whole.

A host with more html than `HOST` is dealt out by places, and a place with more tokens than `CHUNK` by pages, whose counts then
add up by fingerprints of the substrings, so results don't depend on the dealing. Suffixes whose fingerprint is alone are not
sorted. If few pages lose anything, what they lose is broadcast and no html is shuffled.

Defined results: a null html is empty and gives an empty text; a null address belongs to a host of its own with other
null addresses; repeated rows each get a result; an empty table gives an empty result; an unclosed element ends with its
parent, an unclosed head with the first thing that can't stand in one; an unclosed comment or script, or a tag with nothing but attributes and one word more, at the end of a cut-off page runs to its end,
any other < that opens no tag is text; quotes in a tag only enclose a value behind =. Whole pages are read, however
long. Only the three columns named are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, bounded_broadcast, empty_text, has_columns, materialize, mix64, seeds64, small_batches
from lucidframe.shipping import ship

#: Tokens of a repeated substring; bytes of a host's html, and of a place's tokens at three bytes, that one task takes together.
RUN, HOST, CHUNK = 6, 4 << 20, 16 << 20
#: Suffixes that are sorted together.
SORTED = 1 << 20
#: Distinct pages of a host on which a substring stands in one place of the template to be boilerplate.
PLACED = 5
#: Part of a page's article and plain text below which its article blocks are teasers, read like plain ones.
TEASER = 0.2

# Elements by their part in a page.
SKIPPED = frozenset("script style noscript template iframe head title svg math object embed applet canvas audio video map select datalist option optgroup textarea noembed noframes xmp".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
CHROME = frozenset("nav header footer aside form dialog menu button fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ARTICLE = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead topbar footer sidebar sidebars aside related recommended widget widgets cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies disqus respond "
    "pagination pager toolbar header skip".split()
)
#: Words beside them that say nothing of what a part holds.
NEUTRAL_NAMES = frozenset("area articles bar block bottom box button buttons column container form group inner item items left links list outer posts right section sections site slot stories this top user users wrap wrapper".split())
#: Parts by readers, also beside words for what they are about; and what only lays a page out, so that an article inside is none the less one.
READERS = frozenset("comments commentlist disqus".split())
ABOUT = frozenset("article blog entry page post reader readers story".split())
LAYOUT = frozenset("form fieldset".split())
LAYOUT_NAMES = frozenset("sidebar sidebars widget widgets".split())
#: A new one of these ends an open one with the same parent.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table".split())
#: What can stand in a head; anything else ends an open one.
HEADED = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

# A quoted value only stands behind =, as in browsers; any other quote is a character like others.
_TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|(?P<other>[!?/])[^>]*+>)""")
_COMMENT = re.compile(r"-?>|.*?--!?>", re.S)
#: A tag that the end of a page cuts off: a name, then attributes.
_CUT = re.compile(r"""<(?:[/!?]|[a-zA-Z])[^\s<>"'=]*(?:\s+[^\s=<>"']+\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'<]*))*(?:\s+[^\s=<>"']+)?\s*\Z""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+")


def _zone(name: str, rest: str, outer: str) -> str:
    """The zone that an element opens inside another; '' is no text, `frame` is chrome that may only lay out what it encloses."""
    if outer == "" or outer == "chrome" and name != "main" and "main" not in rest.lower() and name not in SKIPPED:
        return outer
    if name in SKIPPED:
        return ""
    attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)} if rest.strip(" /") else {}
    style = re.sub(r"\s", "", attrs.get("style", "").lower())
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return ""
    role = attrs.get("role", "").lower().strip()
    main = name == "main" or role == "main"
    article = name in ARTICLE or role in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
    if outer == "chrome":
        return "article" if main else outer
    if outer == "frame" and not article:
        return "chrome" if name in CHROME - LAYOUT or role in CHROME_ROLES else outer
    if name in CHROME - LAYOUT or role in CHROME_ROLES - {"form"}:
        return "chrome"
    if name not in ("html", "body") and not (article and outer in ("plain", "frame") and name == "main"):
        for label in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
            words = [w for w in _NAME.findall(label) if not w.isdigit()]
            if READERS.intersection(words) and READERS.union(ABOUT, NEUTRAL_NAMES).issuperset(words):
                return "chrome"
            if CHROME_NAMES.intersection(words) and CHROME_NAMES.union(NEUTRAL_NAMES).issuperset(words):
                return "frame" if LAYOUT_NAMES.issuperset(CHROME_NAMES.intersection(words)) else "chrome"
    if name in LAYOUT or role == "form":
        return "frame"
    return "article" if article else outer


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page in order; white space as one space, character references decoded."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = [("", "plain")]
    open_: dict[str, int] = {}  # how many of each element the stack holds
    at, zone, ends = 0, "plain", page.rfind(">")  # no tag is whole behind the last >

    def cut(k: int) -> None:
        for name, _ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((zone, text))

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            lt = len(page)
        if stack[-1][0] == "head" and page[at:lt].strip():
            cut(len(stack) - 1)
            zone = stack[-1][1]
        if lt > at and zone:
            parts.append(page[at:lt])
        if lt == len(page):
            break
        m = _TAG.match(page, lt) if lt < ends else None
        if m is None:
            if _CUT.match(page, lt):
                break  # a tag that is cut off
            if zone:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m["comment"] is not None:
            end = _COMMENT.match(page, at)
            at = len(page) if end is None else end.end()
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if not open_.get(name):  # nothing to end
                if name not in INLINE:
                    close()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name not in INLINE or stack[k][1] != stack[k - 1][1]:
                        close()
                    cut(k)
                    zone = stack[-1][1]
                    break
            continue
        if stack[-1][0] == "head" and name not in HEADED:
            cut(len(stack) - 1)
            zone = stack[-1][1]
        if name in RAW and not m["rest"].rstrip().endswith("/"):
            if name not in INLINE:
                close()
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start())
            at = len(page) if at < 0 else min(at + 1, len(page))
            continue
        inner = _zone(name, m["rest"], zone)
        if name in INLINE and inner == zone:
            continue  # inline elements neither end a block nor need to be closed
        close()
        if name in VOID or name in INLINE and m["rest"].rstrip().endswith("/"):
            continue
        if name not in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS.get(name, ()) or stack[k][0] == "p":
                    cut(k)
                    break
                if stack[k][0] not in INLINE:
                    break
            zone = stack[-1][1]
            inner = _zone(name, m["rest"], zone)
        stack.append((name, inner))
        open_[name] = open_.get(name, 0) + 1
        zone = inner
    close()
    return out


def candidates(found: list[tuple[str, str]]) -> tuple[bool, list[list[str]]]:
    """Whether a page names its article, and the words of the blocks that may be its main text."""
    named, plain = (sum(len(t) for z, t in found if z == zone) for zone in ("article", "plain"))
    if not named and not plain:  # all of the page stands in a form or a layout's part
        found = [("plain" if z == "frame" else z, t) for z, t in found]
        plain = sum(len(t) for z, t in found if z == "plain")
    article = bool(named) and named >= TEASER * (named + plain)
    return article, [t.split(" ") for z, t in found if z == "article" or z == "plain" and not article]


def stream(blocks_: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token codes of a page's blocks, a 0 behind each; where its units begin, and their places: 2n or, from the end, 2n + 1."""
    code = xxhash.xxh32_intdigest
    codes, starts, short = [], [], False
    for words in blocks_:
        if len(words) >= RUN or not short:
            starts.append(len(codes))
        short = len(words) < RUN
        codes += [(code(w) & 0xFFFFFE) + 1 for w in words]
        codes.append(0)
    unit = np.arange(len(starts))
    back = unit[::-1]
    return np.array(codes, np.uint32), np.array(starts, np.int64), np.where(unit <= back, 2 * unit, 2 * back + 1)


def _packed(codes: np.ndarray) -> bytes:
    """24 bits for each token."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def suffix_order(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at some places, sorted by their first RUN tokens, and which of them differ from the one before in these."""
    keys = []
    for k in range(0, RUN, 2):  # two tokens of 24 bits in a number
        keys.append(codes[at + k].astype(np.uint64) << np.uint64(24) | (codes[at + k + 1] if k + 1 < RUN else np.uint64(0)))
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order, new


class Streams:
    """The streams of rows put one after the other, and the suffixes of RUN tokens that begin in each place."""

    def __init__(self, table: pa.Table):
        parts = [_unpacked(x) for x in table.column("codes").to_pylist()]
        self.codes = np.concatenate(parts)
        self.begin = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        self.rows = len(parts)
        starts = [np.frombuffer(x, np.int32) for x in table.column("starts").to_pylist()]
        self.unit_row = np.repeat(np.arange(self.rows), [len(x) for x in starts])
        # Units stand one after the other; a unit's tokens end where the next one's begin.
        self.unit_at = np.concatenate(starts).astype(np.int64) + self.begin[self.unit_row]
        self.unit_end = np.append(self.unit_at[1:], len(self.codes))
        self.unit_place = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("places").to_pylist()])
        same = table.column("same").to_numpy()
        self.same, first = np.unique(same, return_index=True)
        self.first = np.zeros(self.rows, bool)  # pages with equal candidates count once
        self.first[first] = True

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, their units) of about SORTED suffixes, each place whole in one."""
        count = np.maximum(self.unit_end - self.unit_at - RUN, 0)  # the last token of a unit is the mark behind its last block
        order = np.argsort(self.unit_place, kind="stable")
        total = np.cumsum(count[order])
        ends = np.flatnonzero(np.append(self.unit_place[order][1:] != self.unit_place[order][:-1], True)) + 1
        at = 0
        while at < len(order):
            enough = np.searchsorted(total, (total[at - 1] if at else 0) + SORTED)
            end = ends[min(np.searchsorted(ends, max(enough, at + 1)), len(ends) - 1)]
            units = order[at:end]
            n = count[units]
            unit = np.repeat(units, n)
            yield self.unit_at[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n), unit
            at = end

    def runs(self, alone: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(suffixes, the number of the substring in its place of each, distinct pages of each number, one suffix of each number).

        alone: with the substrings that can only stand once, too.
        """
        for at, unit in self.slices():
            if len(at) and not alone:
                slot = (self.prints(at, self.unit_place[unit]) >> np.uint64(42)).astype(np.int64)
                often = np.bincount(slot)[slot] > 1
                at, unit = at[often], unit[often]
            if not len(at):
                continue
            order, new = suffix_order(self.codes, at)
            number = np.empty(len(at), np.int64)
            number[order] = np.cumsum(new) - 1
            number = np.unique(number * (int(self.unit_place.max()) + 1) + self.unit_place[unit], return_inverse=True)[1]
            row = self.unit_row[unit]
            held = np.unique(number[self.first[row]] * self.rows + row[self.first[row]]) // self.rows
            one = np.empty(int(number.max()) + 1, np.int64)
            one[number] = np.arange(len(at))
            yield at, number, np.bincount(held, minlength=len(one)), one

    def prints(self, at: np.ndarray, unit_place: np.ndarray) -> np.ndarray:
        """A fingerprint of the substrings at some suffixes and their places."""
        total = mix64(unit_place.astype(np.uint64) + np.uint64(1))
        for k in range(RUN):
            total = mix64(total ^ (self.codes[at + k].astype(np.uint64) + _WEIGHTS[k]))
        return total

    def spans(self, hits: np.ndarray) -> list[np.ndarray]:
        """For each row, the stretches of its tokens that the substrings at some suffixes cover, as begin, end, begin, end ..."""
        edge = np.zeros(len(self.codes) + 1, np.int32)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + RUN, -1)
        covered = (np.cumsum(edge[:-1]) > 0).view(np.int8)
        turn = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
        row = np.searchsorted(self.begin, turn[::2], side="right") - 1
        pairs = np.column_stack((turn[::2] - self.begin[row], turn[1::2] - self.begin[row])).astype(np.int32)
        return np.split(pairs.ravel(), 2 * np.searchsorted(row, np.arange(1, self.rows)))


_WEIGHTS = seeds64(RUN, 9, odd=True)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url.cast("string")), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", host)


def main_words(found: list[list[str]], spans: np.ndarray | None) -> list[str]:
    """The words of candidate blocks without the stretches that the host repeats."""
    if spans is None or not len(spans):
        return [w for words in found for w in words]
    gone = np.zeros(sum(map(len, found)) + len(found), np.int8)
    for lo, hi in spans.reshape(-1, 2):
        gone[lo:hi] = 1
    out, at = [], 0
    for words in found:
        own = gone[at : at + len(words)].astype(bool)
        at += len(words) + 1
        if own.all():
            continue
        # A few tokens beside boilerplate that only happen to follow it everywhere are no run of their own.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        for lo, hi in zip(edge[::2], edge[1::2]):
            if hi - lo < RUN:
                own[lo:hi] = False
        out += [w for w, g in zip(words, own) if not g]
    return out


def _streams(by_place: bool):
    """(host, article, place, page, same, total, from, starts, places, codes) of each page's units: all together, or a row for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for host, page, text in zip(*(batch.slice(at, 512).column(k).to_pylist() for k in range(3))):
                    article, found = candidates(blocks(text))
                    codes, starts, places = stream(found)
                    if len(codes) <= RUN:
                        continue
                    same = xxhash.xxh64_intdigest(codes.tobytes()) - (1 << 63)
                    if not by_place:
                        rows.append((host, article, 0, page, same, len(codes), 0, starts.astype(np.int32).tobytes(), places.astype(np.int32).tobytes(), _packed(codes)))
                        continue
                    ends = np.append(starts[1:], len(codes))
                    for lo, hi, place in zip(starts.tolist(), ends.tolist(), places.tolist()):
                        if hi - lo > RUN:
                            rows.append((host, article, place, page, same, len(codes), lo, b"\0" * 4, np.int32(place).tobytes(), _packed(codes[lo:hi])))
                columns = zip(*rows) if rows else [[]] * len(_STREAM)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _STREAM.values())], list(_STREAM))

    return run


_STREAM = {"host": pa.int64(), "article": pa.bool_(), "place": pa.int64(), "page": pa.int64(), "same": pa.int64(), "total": pa.int64(), "from": pa.int64(), "starts": pa.binary(), "places": pa.binary(), "codes": pa.binary()}
_STREAM_SQL = "host bigint, article boolean, place bigint, page bigint, same bigint, total bigint, `from` bigint, starts binary, places binary, codes binary"
_SPANS_SQL = "page bigint, article boolean, total bigint, `from` bigint, covered bigint, spans binary"


def _spans_table(table: pa.Table, spans: list[np.ndarray]) -> pa.Table:
    kept = pa.array([k for k, x in enumerate(spans) if len(x)], pa.int64())
    covered = pa.array([int((x[1::2] - x[::2]).sum()) for x in spans if len(x)], pa.int64())
    return pa.table({**{c: table.column(c).take(kept) for c in ("page", "article", "total", "from")}, "covered": covered, "spans": pa.array([x.tobytes() for x in spans if len(x)], pa.binary())})


def _least(article: bool, pages: int) -> int:
    """On how many of a host's distinct pages of a kind a substring is boilerplate."""
    return max(PLACED, pages // 2 + 1) if article else min(PLACED, max(2, pages))


def _decide(table: pa.Table) -> pa.Table:
    """The boilerplate of rows that hold all places of their host's pages of a kind, or of one place, with the number of such pages."""
    streams = Streams(table)
    least = _least(table.column("article")[0].as_py(), table.column("pages")[0].as_py() if "pages" in table.column_names else len(streams.same))
    hits = [at[held[number] >= least] for at, number, held, _ in streams.runs()]
    return _spans_table(table, streams.spans(np.concatenate(hits) if hits else np.empty(0, np.int64)))


def _tellings(parts: int):
    """Of a part of a place's pages: its substrings' fingerprints and on how many pages each stands, dealt by fingerprint."""

    def run(table: pa.Table) -> pa.Table:
        streams = Streams(table)
        found = [(streams.prints(at[one], np.full(len(one), table.column("place")[0].as_py())), held.astype(np.uint32)) for at, _, held, one in streams.runs(alone=True)]
        prints, held = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), np.empty(0, np.uint32))
        bucket = prints % np.uint64(parts)
        chosen = [np.flatnonzero(bucket == k) for k in np.unique(bucket)]
        n = len(chosen)
        first = {c: [table.column(c)[0].as_py()] * n for c in ("host", "article", "place", "part", "pages")}
        return pa.table({**{c: pa.array(x, pa.bool_() if c == "article" else pa.int64()) for c, x in first.items()}, "bucket": pa.array([int(bucket[x[0]]) for x in chosen], pa.int64()), "prints": pa.array([prints[x].tobytes() for x in chosen], pa.binary()), "held": pa.array([held[x].tobytes() for x in chosen], pa.binary())})

    return run


def _tally(table: pa.Table) -> pa.Table:
    """The fingerprints of what is boilerplate by all parts together, for each part that has them."""
    least = _least(table.column("article")[0].as_py(), table.column("pages")[0].as_py())
    prints = [np.frombuffer(x, np.uint64) for x in table.column("prints").to_pylist()]
    name, which = np.unique(np.concatenate(prints), return_inverse=True)
    known = name[np.bincount(which, np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("held").to_pylist()])) >= least]
    own = [x[np.isin(x, known)] for x in prints]
    return table.select(["host", "article", "place", "part"]).append_column("known", pa.array([x.tobytes() for x in own], pa.binary()))


def _apply(table: pa.Table, known: pa.Table) -> pa.Table:
    """The boilerplate of a part, from the fingerprints that are known of it."""
    if not table.num_rows or not known.num_rows:
        return _spans_table(table.slice(0, 0), [])
    streams = Streams(table)
    names = np.frombuffer(b"".join(known.column("known").to_pylist()), np.uint64)
    hits = [at[np.isin(streams.prints(at, streams.unit_place[unit]), names)] for at, unit in streams.slices()]
    return _spans_table(table, streams.spans(np.concatenate(hits)))


def boilerplate(pages: DataFrame) -> DataFrame:
    """(page, spans: [{from, spans}], bytes) for (host, page, html) rows: the stretches of a page's candidate tokens that its host repeats. host, page: fingerprints."""
    hosts = pages.groupBy("host").agg(F.sum(F.length("html").cast("long")).alias("size"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    hosts = bounded_broadcast(materialize(hosts.select("host", (F.col("size") > HOST).alias("big")), "hosts"))
    marked = pages.join(hosts, "host")  # a page alone on its host repeats nothing
    key = ["host", "article"]
    small = marked.where("NOT big").select("host", "page", "html").mapInArrow(_streams(False), _STREAM_SQL).groupBy(*key).applyInArrow(_decide, _SPANS_SQL)
    big = materialize(marked.where("big").select("host", "page", "html").mapInArrow(_streams(True), _STREAM_SQL), "streams")
    kinds = big.groupBy(*key).agg(F.count_distinct("same").alias("pages"))
    key.append("place")
    sizes = big.groupBy(*key).agg(F.ceil(F.sum(F.length("codes")) / CHUNK).alias("parts")).join(kinds, ["host", "article"])
    sizes = bounded_broadcast(materialize(sizes, "places"))
    dealt = big.join(sizes, key).withColumn("part", F.pmod(F.col("same"), F.col("parts")))
    whole = dealt.where("parts = 1").drop("parts", "part").groupBy(*key).applyInArrow(_decide, _SPANS_SQL)
    found = small.unionByName(whole)
    most = sizes.agg(F.max("parts")).first()[0]
    if (most or 1) > 1:
        several = dealt.where("parts > 1").drop("parts")
        told = several.groupBy(*key, "part").applyInArrow(_tellings(most), "host bigint, article boolean, place bigint, part bigint, pages bigint, bucket bigint, prints binary, held binary")
        known = told.groupBy(*key, "bucket").applyInArrow(_tally, "host bigint, article boolean, place bigint, part bigint, known binary")
        found = found.unionByName(several.groupBy(*key, "part").cogroup(known.groupBy(*key, "part")).applyInArrow(_apply, _SPANS_SQL))
    held = found.groupBy("page").agg(F.collect_list(F.struct("from", "spans")).alias("spans"), F.sum("covered").alias("covered"), F.max("total").alias("total"), F.max("article").alias("article"))
    return held.where("NOT article OR 2 * covered <= total").select("page", "spans", (8 * F.size("spans") + F.expr("aggregate(spans, 0, (n, x) -> n + octet_length(x.spans))")).alias("bytes"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = []
            for page, known in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                spans = np.concatenate([np.frombuffer(x["spans"], np.int32) + x["from"] for x in known]) if known else None
                texts.append(" ".join(main_words(candidates(blocks(page))[1], spans)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars."""
    has_columns(df, id_col, url_col, html_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), empty_text(F.col(f"`{html_col}`")).alias("html"))
    host = F.xxhash64(F.coalesce(host_of(F.col("url")), F.lit("")))
    page = F.xxhash64(host, "html")
    spans = materialize(boilerplate(rows.select(host.alias("host"), page.alias("page"), "html")), "boilerplate")
    lost, size = spans.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if not lost:
        joined = rows.withColumn("spans", F.lit(None).cast("array<struct<from:bigint,spans:binary>>"))
    else:
        spans = spans.drop("bytes")
        joined = rows.withColumn("page", page).join(F.broadcast(spans) if lost <= BROADCAST_ROWS and size <= BROADCAST_BYTES else spans, "page", "left")
    found = joined.select("page_id", "url", "html", "spans").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
