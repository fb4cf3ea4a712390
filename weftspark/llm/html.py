"""Main text of web pages through wrappers that same-host token streams are aligned into.

A page is a stream of tags and texts. Streams of one host are aligned one after the other
into a wrapper: a union-free regular expression over tags and text slots. Where two streams
differ,
  * two texts become a text slot;
  * a part that repeats what stands before it becomes a repeated group;
  * a part that only one stream has becomes an optional group.
A page is matched to its host's wrapper, which tells the slot that each text fills. Slots are
judged by what fills them over the host's pages (whether it varies, whether the slot is
repeated, how much of it is links) and by the elements that the text stands in, and a
page's text is what fills the slots of the article.

Page streams are first folded (neighbouring equal groups become one repeated group), and
equal folded streams of a host are merged as they are read, so what is exchanged and aligned
are a host's different shapes, each with the evidence on its slots. They are aligned in a tree:
in as many groups as SALTS says first, then those groups' wrappers in fewer, then the host's.
So no task holds a host's pages or shapes.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import batches, partitions

#: Groups in which a host's shapes are aligned, level by level, before they meet; and the longest repeated group.
SALTS, LONGEST = (256, 16), 12
#: A host with a larger share of all pages than one in so many has its pages dealt to several places.
LARGE = 1000

#: Elements whose content is no page text, that stand beside an article, that have no end
#: tag, that begin a new block, and that are taken as the article when a page has one.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas head".split())
BESIDE = frozenset("nav header footer aside form menu dialog button select fieldset label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MAIN = ("article", "main")
#: Pages of a host from which content that never varies counts as the template's.
ENOUGH = 3
#: Words of a class, id or role that mark something beside the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice alert disclaimer "
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination sidebar side aside header masthead footer foot copyright legal comment comments respond reply replies "
    "disqus discussion related recommended share sharing social follow subscribe newsletter signup login search form widget toolbar skip complementary contentinfo".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|noscript|template|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*?)/?>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")

#: A text slot in a stream.
TEXT = "#"


def tokens(page: str) -> list[tuple[str, str]]:
    """(shape, text) of a page's tokens: a tag's name with what marks it, or TEXT with the decoded text."""
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(page):
        t = m[0]
        if m[1] or t.startswith(("<!", "<?")):
            continue
        tag = _TAG.fullmatch(t) if t[0] == "<" and len(t) > 1 else None
        if tag:
            name = tag[2].lower()
            if tag[1]:
                out.append((f"/{name}", ""))
                continue
            words = sorted({w for a in _ATTRIBUTE.finditer(tag[3]) for w in _SPLIT.split((a[2] or a[3] or a[4] or "").lower())} & MARKS) if "=" in tag[3] else []
            out.append((" ".join([name, *words]), ""))
        elif out and out[-1][0] == TEXT:
            out[-1] = (TEXT, out[-1][1] + t)
        else:
            out.append((TEXT, t))
    return [(s, html.unescape(x)) for s, x in out if s != TEXT or x.strip()]


# A wrapper is a list of items: a shape, or [mark, items] with mark "+" (once or more), "?" (at most once)
# or "*" (any number of times).
Items = list


def fold(items: Items, groups: list[Items] | None = None) -> Items:
    """The stream with neighbouring equal parts, up to LONGEST items, merged into repeated groups.

    A part that is a group's content elsewhere (in this stream, or in ``groups``) becomes
    that group too, as a repeated group may have one member.
    """
    known: list[Items] = [list(g) for g in groups or []]
    while True:
        out: Items = []
        for item in items:
            out.append(item)
            while _merge(out, known):
                pass
        if out == items:
            return simplify(out)
        items = out


def _merge(out: Items, known: list[Items]) -> bool:
    """One step on the end of a stream; whether anything was merged."""
    last = out[-1]
    if len(out) > 1 and last == out[-2] and isinstance(last, list):
        out.pop()
        return True
    for core in known:
        if core[-1] == last and len(core) > 1 and out[-len(core) :] == core:
            out[-len(core) :] = [["+", core]]
            return True
    for n in range(2, min(LONGEST, len(out) // 2) + 1):
        if out[-n - 1] == last and out[-2 * n : -n] == out[-n:] and not (isinstance(out[-n], str) and (out[-n][0] == "/" or out[-n] == TEXT)):
            core = out[-n:]
            out[-2 * n :] = [["+", core]]
            known.append(core)
            return True
    return False


def cores(items: Items) -> list[Items]:
    """The contents of all repeated groups, inner ones first."""
    out: list[Items] = []
    for i in items:
        if isinstance(i, list):
            out += cores(i[1])
            if i[0] in "+*":
                out.append(i[1])
    return out


def first(item: object) -> str:
    """The shape that an item begins with."""
    while isinstance(item, list):
        item = item[1][0]
    return item


def simplify(items: Items) -> Items:
    """The same wrapper, or a slightly wider one, without groups of one group and without like neighbours."""
    out: Items = []
    for item in items:
        if isinstance(item, list):
            inner = simplify(item[1])
            item = [item[0], inner]
            if len(inner) == 1 and isinstance(inner[0], list):
                item = [item[0] if item[0] == inner[0][0] else "*", inner[0][1]]
            if out and isinstance(out[-1], list) and first(out[-1]) == first(item):
                mark = "+" if "+" in (out[-1][0], item[0]) else "*"
                out[-1] = [mark, out[-1][1] if out[-1][1] == item[1] else align(out[-1][1], item[1])]
                continue
        out.append(item)
    return out


def _same(a: object, b: object) -> bool:
    """Whether two items are groups that begin alike."""
    return isinstance(a, list) and isinstance(b, list) and first(a) == first(b)


def align(a: Items, b: Items) -> Items:
    """A wrapper that matches all that either wrapper matches."""
    if a == b:
        return a
    a, b = fold(a, cores(b)), fold(b, cores(a))
    out: Items = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif _same(a[i], b[j]):
            out.append([a[i][0] if a[i][0] == b[j][0] else "*", align(a[i][1], b[j][1])])
            i, j = i + 1, j + 1
        elif isinstance(a[i], list) and b[j : j + len(a[i][1])] == a[i][1]:
            out.append(a[i])
            i, j = i + 1, j + len(a[i][1])
        elif isinstance(b[j], list) and a[i : i + len(b[j][1])] == b[j][1]:
            out.append(b[j])
            i, j = i + len(b[j][1]), j + 1
        else:
            # The nearest place where the streams meet again; what lies before it is optional.
            best = None
            for d in range(1, len(a) - i + len(b) - j):
                for x in range(max(0, d - (len(b) - j) + 1), min(d, len(a) - i - 1) + 1):
                    y = d - x
                    if a[i + x] == b[j + y] or _same(a[i + x], b[j + y]):
                        best = x, y
                        break
                if best:
                    break
            if best is None:
                break
            out += _optional(a[i : i + best[0]]) + _optional(b[j : j + best[1]])
            i, j = i + best[0], j + best[1]
    return simplify(out + _optional(a[i:]) + _optional(b[j:]))


def _optional(items: Items) -> Items:
    """The items, with what isn't optional yet in optional groups."""
    out: Items = []
    for i in items:
        if isinstance(i, list):
            out.append(["*" if i[0] == "+" else i[0], i[1]])
        elif out and out[-1][0] == "?" and out[-1] not in items:
            out[-1][1].append(i)
        else:
            out.append(["?", [i]])
    return out


class Path:
    """The elements that are open at a place in a stream."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def step(self, shape: str) -> None:
        name = shape.lstrip("/").split(" ")[0]
        if shape[0] == "/":
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].split(" ")[0] == name:
                    del self.open[k:]
                    return
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end one another without a tag
                for k in range(len(self.open) - 1, -1, -1):
                    above = self.open[k].split(" ")[0]
                    if above == name:
                        del self.open[k:]
                        break
                    if above in BLOCK:
                        break
            self.open.append(shape)


def in_article(path: tuple[str, ...], main: str | None) -> bool:
    """Whether a text slot under these elements is the article's."""
    inside = main is None
    for shape in path:
        name, *marks = shape.split(" ")
        if name == main:
            inside = True
        elif name in RAW or name in BESIDE or (marks and name not in ("body", "html", *MAIN)):
            return False
    return inside


class Matcher:
    """Tells which of a wrapper's slots each text of a stream fills.

    The wrapper is run as an automaton whose states are made as streams ask for them; groups
    are entered rather than passed by where both would do.
    """

    def __init__(self, items: Items) -> None:
        self.ops: list[tuple] = []
        self.slots = 0
        self._emit(items)
        self.ops.append(("end",))
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: list[dict[str, tuple[int, tuple[int, ...]]]] = []
        self.begin = self._state([(0, 0)])[0]

    def _emit(self, items: Items) -> None:
        for i in items:
            if isinstance(i, str):
                self.ops.append(("one", i, self.slots if i == TEXT else -1))
                self.slots += i == TEXT
                continue
            at = len(self.ops)
            if i[0] != "+":
                self.ops.append(())
            self._emit(i[1])
            if i[0] == "+":
                self.ops.append(("either", at, len(self.ops) + 1))
            else:
                if i[0] == "*":
                    self.ops.append(("either", at, at))
                self.ops[at] = ("either", at + 1, len(self.ops))

    def _state(self, starts: list[tuple[int, int]]) -> tuple[int, tuple[int, ...]]:
        """The state of all places that are reached from these, and which of these each is reached from."""
        found: dict[int, int] = {}
        seen: set[int] = set()
        stack = starts[::-1]
        while stack:
            at, parent = stack.pop()
            if at in seen:
                continue
            seen.add(at)
            op = self.ops[at]
            if op[0] == "either":
                stack += [(op[2], parent), (op[1], parent)]
            else:
                found[at] = parent
        key = tuple(found)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key], tuple(found.values())

    def fills(self, shapes: list[str]) -> list[int] | None:
        """The slot of each text; None if the wrapper doesn't match the stream."""
        now, trail = self.begin, []
        for shape in shapes:
            step = self.steps[now].get(shape)
            if step is None:
                step = self._state([(at + 1, k) for k, at in enumerate(self.states[now]) if self.ops[at][0] == "one" and self.ops[at][1] == shape])
                self.steps[now][shape] = step
            trail.append((now, step[1]))
            now = step[0]
            if not step[1]:
                return None
        end = len(self.ops) - 1
        if end not in self.states[now]:
            return None
        k, out = self.states[now].index(end), []
        for (state, parents), shape in zip(reversed(trail), reversed(shapes), strict=True):
            k = parents[k]
            if shape == TEXT:
                out.append(self.ops[self.states[state][k]][2])
        return out[::-1]


# Evidence on a slot: pages that fill it, and texts; characters of the blocks these stand in, and those in links;
# the least and greatest checksum of a page's blocks there, and of the longest text of a page that fills it.
NOTHING = [0, 0, 0, 0, 1 << 32, -1, 1 << 32, -1]


def add(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a[:4], b[:4], strict=True)] + [min(a[4], b[4]), max(a[5], b[5]), min(a[6], b[6]), max(a[7], b[7])]


def evidence(page: list[tuple[str, str]], slots: list[int]) -> dict[int, list[int]]:
    """What a page says on the slots that its texts fill."""
    long = zlib.crc32(max((t for s, t in page if s == TEXT), key=len, default="").strip().encode("utf-8", "replace"))
    out: dict[int, list[int]] = {}
    block: list[tuple[int, str]] = []
    links, linked, at = 0, False, 0

    def close() -> None:
        whole = "\n".join(t for _, t in block)
        data, chars = whole.encode("utf-8", "replace"), len(whole) - len(block) + 1
        for slot in {s for s, _ in block}:
            e = out.setdefault(slot, [1, 0, 0, 0, 0, 0, long, long])
            e[2] += chars
            e[3] += links
            e[4] = e[5] = zlib.crc32(data, e[4])
        for slot, _ in block:
            out[slot][1] += 1

    for shape, text in [*page, ("/body", "")]:
        if shape == TEXT:
            text = text.strip()
            block.append((slots[at], text))
            links += len(text) * linked
            at += 1
            continue
        name = shape.lstrip("/").split(" ")[0]
        if name == "a":
            linked = shape[0] != "/"
        elif name in BLOCK:
            close()
            block, links = [], 0
    return out


def once(items: Items) -> list[str]:
    """A stream that the wrapper matches and that fills each slot once."""
    return [x for i in items for x in (once(i[1]) if isinstance(i, list) else [i])]


def carried(items: Items, known: list[list[int]], matcher: Matcher, into: list[list[int]]) -> None:
    """Adds the evidence on a wrapper's slots to that on the slots of one it was aligned into."""
    for slot, e in zip(matcher.fills(once(items)) or [], known, strict=False):
        into[slot] = add(into[slot], e)


def points(known: list[list[int]]) -> list[int]:
    """What the host's pages say on each slot: below 0 for a template's or a menu's."""
    out = []
    for pages, texts, chars, links, low, high, least, most in known:
        same = pages >= ENOUGH and low == high and least != most  # copies of one page tell nothing
        menu = texts >= 2 * pages > 0 and 2 * links > chars
        out.append(-2 * same - 2 * menu)
    return out


class Wrapper:
    """A host's wrapper, with what the host's pages say on its slots (nothing, unless told)."""

    def __init__(self, items: Items, said: list[int] | None = None) -> None:
        self.items = items
        self.matcher = Matcher(items)
        self.said = said or [0] * self.matcher.slots
        self.kept: dict[tuple[tuple[str, ...], str | None, int], bool] = {}

    def _of(self, path: tuple[str, ...], main: str | None, said: int) -> bool:
        """Whether a text is the article's: an element beside an article outweighs all, an article's outweighs one point against it."""
        key = path, main, said
        kept = self.kept.get(key)
        if kept is None:
            if len(self.kept) > 1 << 16:
                self.kept.clear()
            kept = self.kept[key] = in_article(path, main) and said + 2 * (main is not None) >= 0
        return kept

    def text(self, page: list[tuple[str, str]]) -> str:
        """The page's blocks in the article's slots, one to a line; a page that the wrapper doesn't match is judged by its elements."""
        names = {s.split(" ")[0] for s, _ in page}
        main = next((m for m in MAIN if m in names), None)
        fills = iter(self.matcher.fills([s for s, _ in page]) or [])
        blocks, now, path = [], [], Path()
        for shape, text in page:
            if shape == TEXT:
                slot = next(fills, None)
                if self._of(tuple(path.open), main, 0 if slot is None else self.said[slot]):
                    now.append(text)
                continue
            name = shape.lstrip("/").split(" ")[0]
            if name in BLOCK and now:
                blocks.append("".join(now))
                now = []
            elif name == "br":
                now.append(" ")
            path.step(shape)
        blocks.append("".join(now))
        return "\n".join(b for b in (_SPACE.sub(" ", x).strip() for x in blocks) if b)


def wrappers(pages: DataFrame, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """A row for each host: ``host`` and its wrapper as JSON, items and then the points of their slots."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_column), r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")))

    def shapes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "html", 8 << 20):
            seen: dict[tuple[str, str], list[list[int]]] = {}
            known: dict[str, Matcher] = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stream = tokens(page or "")
                bare = [s for s, _ in stream]
                items = fold(bare)
                shape = json.dumps(items)
                matcher = known.get(shape) or known.setdefault(shape, Matcher(items))
                said = seen.setdefault((h, shape), [NOTHING] * matcher.slots)
                fills = matcher.fills(bare)
                for slot, e in (evidence(stream, fills) if fills else {}).items():
                    said[slot] = add(said[slot], e)
            rows = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)] + [pa.array([json.dumps(seen[r]) for r in rows], pa.string())], names=["host", "shape", "said"])

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        said, *others = (json.loads(t) for t in group.column("said").to_pylist())
        for other in others:
            said = [add(a, b) for a, b in zip(said, other, strict=True)]
        return pa.table({"host": group.column("host")[:1], "shape": group.column("shape")[:1], "said": pa.array([json.dumps(said)], pa.string())})

    def aligned(key: tuple, group: pa.Table) -> pa.Table:
        best: Items | None = None
        parts = sorted(((json.loads(s), json.loads(e)) for s, e in zip(group.column("shape").to_pylist(), group.column("said").to_pylist(), strict=True)), key=lambda x: (len(json.dumps(x[0])), json.dumps(x[0])))
        for items, _ in parts:
            best = items if best is None else align(best, items)
        matcher = Matcher(best)
        said = [NOTHING] * matcher.slots
        for items, known in parts:
            carried(items, known, matcher, said)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "shape": pa.array([json.dumps(best)], pa.string()), "said": pa.array([json.dumps(said)], pa.string())})

    def judged(key: tuple, group: pa.Table) -> pa.Table:
        t = aligned(key, group)
        items, said = (json.loads(t.column(c)[0].as_py()) for c in ("shape", "said"))
        return pa.table({"host": t.column("host"), "wrapper": pa.array([json.dumps([items, points(said)])], pa.string())})

    kind = "host string, shape string, said string"
    rows = pages.select(host.alias("host"), F.col(html_column).alias("html"))
    distinct = rows.mapInArrow(shapes, kind).groupBy("host", "shape").applyInArrow(merged, kind)
    partial = distinct.withColumn("salt", F.pmod(F.xxhash64("shape"), F.lit(SALTS[0])))
    for groups in (*SALTS[1:], 1):
        met = partial.groupBy("host", "salt").applyInArrow(lambda key, group: aligned(key, group).append_column("salt", pa.array([key[1].as_py()], pa.int64())), kind + ", salt long")
        partial = met.withColumn("salt", F.pmod("salt", F.lit(groups)))
    return partial.groupBy("host").applyInArrow(judged, "host string, wrapper string")


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: id, url, text ('' if none) and n_chars.

    A null page is empty; a page with no host shares a wrapper with the others that have
    none; pages that no wrapper reaches are judged by their own elements. Repeated rows are
    answered each; a very long page is read whole; an empty table gives no rows. Hosts are
    counted at once, the rest is lazy.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_column), r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host.alias("host"))
    # A host may hold a third of the pages: its wrapper is copied to several places, by its share, and its pages are dealt to them.
    spark = pages.sparkSession
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = counts.filter(F.col("n") * LARGE > total).collect()  # LARGE rows at most
    places = [(r.host, 1 + 4 * partitions(spark) * r.n // total) for r in large]
    few = pa.table({"host": pa.array([h for h, _ in places], pa.string()), "places": pa.array([n for _, n in places], pa.int64())})
    spread = F.broadcast(spark.createDataFrame(few, "host string, places long"))
    number = F.coalesce("places", F.lit(1))
    known = wrappers(pages, url_column=url_column, html_column=html_column).join(spread, "host", "left")
    copies = known.select("host", "wrapper", F.explode(F.sequence(F.lit(0), number - 1)).alias("place"))
    dealt = rows.join(spread, "host", "left").withColumn("place", F.pmod(F.xxhash64("id", "url"), number))
    joined = dealt.join(copies, ["host", "place"], "left").select("id", "url", "html", "wrapper")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches(source, "html", 8 << 20):
            texts = []
            for page, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = known.get(text or "[[], []]")
                if w is None:
                    if len(known) > 1024:
                        known.clear()
                    w = known[text or "[[], []]"] = Wrapper(*json.loads(text or "[[], []]"))
                texts.append(w.text(tokens(page or "")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_column].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
