"""Main text of web pages by template deduction from equivalence classes of tokens over same-host pages.

A page is read as a row of tokens: the elements that begin, named by their paths, and the blocks of text, named by path
and text.  Tokens that occur equally often in each page of a host share an occurrence vector and form a class.  Classes
of several tokens that enough pages have, whose tokens come in one order in every page and which don't interleave with
a class of more pages, nest in each other: they are the host's template.  Its texts are boilerplate, but for headings, and
not on pages of which they are much: there, pages repeat an article.  What varies stands in slots between the template's elements.  The slots to extract are those of one element
of the template, the region, which holds nearly all of the host's running text; tags and class names have a say only in
which elements count as running text, and in which of several such elements is the region.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: A class belongs to a template if this share of the host's different pages has it, and so many pages at least.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Texts of a template need so many pages; where they are this share of a page's region or more, the page is a copy of others, and they stay.
TEXT_PAGES, COPIED = 4, 0.4
#: The region holds this share of the running text, or, if its tag or role says that it is the article, MARKED of it.
REGION, MARKED = 0.8, 0.3
#: A form around so many characters, and REGION of the page's running text, is a wrapper.
WRAPPER = 500
#: Pages that repeat, up to this number, are told apart by a broadcast (some 150 bytes each); more by a shuffle.
BROADCAST_IDS = 1 << 18
#: What an element's tag, role and class say: nothing, an article, something else, a form, a name that is unsure, a part
#: of running text, such as a paragraph, which can't be the region.
NEUTRAL, MAIN, OUT, FORM, UNSURE, PART = range(6)

_MARKUP = re.compile(r"<(?:!--.*?(?:-->|--!>|\Z)|(/?)([a-zA-Z][^\s/>]*)|[!?/][^>]*(?:>|\Z))", re.S)
_GAP, _ATTRIBUTE, _BARE = re.compile(r"[\s/]*"), re.compile(r"([^\s/>][^\s/>=]*)\s*(=\s*)?"), re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML's elements by how they are parsed, and the roles and names that mark parts of pages.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("html head body caption dd dt li legend optgroup option summary tbody td tfoot th thead tr".split()) | {"p"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd pre blockquote figure figcaption caption address legend summary tr th thead tbody tfoot".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup caption figcaption legend summary dt th".split())
_OUT_TAGS = frozenset("nav footer aside script style noscript template iframe button select textarea svg math head title dialog menu object canvas audio video label search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_OUT_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidebars aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup comment comments disqus replies related recommended share sharing social login search toolbar pagination pager masthead skip".split())
_FRAME_WORDS = frozenset("site page main top bottom left right box bar block container content wrap wrapper inner outer area section list item items link links button buttons icon icons panel region row col column group holder header title widget widgets module global primary secondary fixed sticky overlay zone slot unit text form post posts article articles body thread author meta count reply policy message".split())


def _hash(*parts: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) - (1 << 63)


def _name_hint(names: str) -> int:
    """OUT if a class or id says nothing but that it is a menu, an advert and the like; UNSURE if it has such a word among others."""
    hint = NEUTRAL
    for name in names.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & _OUT_WORDS:
            if words <= _OUT_WORDS | _FRAME_WORDS:
                return OUT
            hint = UNSURE
    return hint


def _hint(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    if tag in ("html", "body"):
        return NEUTRAL
    role = attributes.get("role", "").lower()
    if tag in _OUT_TAGS or (role in _OUT_ROLES and tag != "form") or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return OUT
    if tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody":
        return MAIN
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if not in_main and (tag == "header" or any("header" in map(str.lower, _WORDS.findall(n)) for n in names.split())):
        return OUT
    return FORM if tag == "form" else (_name_hint(names) if names != " " else NEUTRAL) or (PART if tag in _PARTS else NEUTRAL)


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at at, and where it ends: HTML's states, in one go; -1 if the page ends before.

    A quote opens a value after = only.  One that nothing closes (last has each quote's last place) ends with the tag.
    """
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return found, -1
        if page[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(page, at)
        at, value = m.end(), ""
        if m[2] is not None:
            quote = page[at : at + 1]
            if quote in last and last[quote] > at:
                end = page.find(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            elif quote in last:
                end = page.find(">", at)
                value, at = page[at + 1 : end if end >= 0 else len(page)], end if end >= 0 else len(page)
            else:
                end = _BARE.match(page, at).end()
                value, at = page[at:end], end
        found.setdefault(m[1].lower(), value)


class Page:
    """A page's elements (by number: parent, token, hint, depth, place) and its blocks of text (element, text, characters in links, place).

    Inline elements belong to the block around them, but for those whose names say something.  Reading takes time in
    proportion to the page, whatever its markup.
    """

    def __init__(self, page: str) -> None:
        self.parent, self.token, self.hint, self.depth, self.place, self.heading = [-1], [0], [NEUTRAL], [0], [0], [False]
        self.blocks: list[tuple[int, str, int, int]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        open_: Counter[str] = Counter()
        held: list[str] = []
        last = {q: page.rfind(q) for q in "\"'"}
        at = place = linked = main = 0
        in_link = False

        def block() -> None:
            nonlocal linked, place
            text = " ".join(entities.unescape("".join(held)).split()) if held else ""
            if text:
                place += 1
                self.blocks.append((stack[-1][1], text, min(linked, len(text)), place))
            held.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            held.append(text)
            linked += len(text) if in_link else 0

        def cut(n: int) -> None:
            nonlocal main
            block()
            for tag, i in stack[n:]:
                open_[tag] -= 1
                main -= self.hint[i] == MAIN
            del stack[n:]

        while at < len(page):
            m = _MARKUP.search(page, at)
            if m is None:
                say(page[at:])
                break
            if m.start() > at:
                say(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            attributes, at = _attributes(page, at, last)
            if at < 0:
                break
            if tag == "br" or tag == "hr":
                say(" ") if tag == "br" else block()
                continue
            if tag == "a":
                in_link = not m[1]
            if m[1]:
                if open_[tag]:
                    for n in range(len(stack) - 1, 0, -1):
                        if stack[n][0] == tag:
                            cut(n)
                            break
                        if tag not in _BLOCK and stack[n][0] in _BLOCK:
                            break
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = len(page) if end is None else end.start()
                continue
            if tag in _VOID:
                continue
            if tag in _BLOCK:
                if tag in _ENDS_P and open_["p"]:
                    for n in range(len(stack) - 1, 0, -1):
                        if stack[n][0] == "p":
                            cut(n)
                            break
                        if stack[n][0] in _BLOCK:
                            break
                closes, scope = _IMPLIED.get(tag, ((), ()))
                if any(open_[c] for c in closes):
                    for n in range(len(stack) - 1, 0, -1):
                        if stack[n][0] in closes:
                            cut(n)
                            break
                        if stack[n][0] in scope:
                            break
            hint = _hint(tag, attributes, main > 0)
            if tag in _BLOCK or hint != NEUTRAL:
                block()
                up = stack[-1][1]
                name = re.sub(r"\d+", "0", f"{attributes.get('class', '')}#{attributes.get('id', '')}")
                place += 1
                self.parent.append(up)
                self.token.append(_hash(self.token[up], tag, name))
                self.hint.append(hint)
                self.depth.append(self.depth[up] + 1)
                self.place.append(place)
                self.heading.append(self.heading[up] or tag in _HEADINGS)
                main += hint == MAIN
                open_[tag] += 1
                stack.append((tag, len(self.token) - 1))
        block()

    def outside(self) -> list[bool]:
        """Whether each element is, or is within, one that isn't the article by what it says, links for the most part where that is unsure."""
        n = len(self.token)
        chars, linked, mass = [0] * n, [0] * n, [0] * n
        for i, text, links, _ in self.blocks:
            chars[i] += len(text)
            linked[i] += links
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        out = [False] * n
        for i in range(1, n):
            unsure = self.hint[i] == UNSURE and 2 * linked[i] > chars[i]
            out[i] = out[self.parent[i]] or self.hint[i] == OUT or unsure
        for i, text, _, _ in self.blocks:
            mass[i] += 0 if out[i] else len(text)
        for i in range(n - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
        for i in range(1, n):
            small = self.hint[i] == FORM and (mass[i] < WRAPPER or mass[i] < REGION * mass[0])
            out[i] = out[i] or out[self.parent[i]] or small
        return out

    def tokens(self) -> list[tuple[int, bool, int, int, int, int]]:
        """(token, whether a text, hint, depth, count, running text below it) of each different token, in order of first places."""
        out = self.outside()
        mass = [0] * len(self.token)
        for i, text, _, _ in self.blocks:
            mass[i] += 0 if out[i] else len(text)
        for i in range(len(mass) - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
        seen: dict[tuple[int, bool], list[int]] = {}
        for _, key, hint, depth, m in sorted(
            [(p, (t, False), OUT if o else h, d, m) for p, t, o, h, d, m in list(zip(self.place, self.token, out, self.hint, self.depth, mass, strict=True))[1:]]
            + [(p, (_hash(self.token[i], text), True), OUT if out[i] else NEUTRAL, self.depth[i] + 1, 0) for i, text, _, p in self.blocks]
        ):
            if key in seen:
                seen[key][2] += 1
                seen[key][3] += m
            else:
                seen[key] = [hint, depth, 1, m]
        return [(token, text, *rest) for (token, text), rest in seen.items()]

    def slots(self, region: int | None, texts: frozenset[int]) -> str:
        """The blocks in the region's slots: not the template's texts, nor within elements that are something else.

        A page without the region has the blocks of the elements that are marked as the article, if any, else all.
        Headings stay, whatever repeats them; and all texts do where the template's are COPIED of them or more: those are the
        article's, in copies of it.
        """
        out = self.outside()
        marked = [h == MAIN and not o for h, o in zip(self.hint, out, strict=True)]
        within = [token == region for token in self.token]
        if region is None or not any(within):
            within = marked if any(marked) else [True] * len(out)
        for i in range(1, len(within)):
            within[i] = within[i] or within[self.parent[i]]
        blocks = [(text, not self.heading[i] and bool(texts) and _hash(self.token[i], text) in texts) for i, text, _, _ in self.blocks if within[i] and not out[i]]
        known = sum(len(text) for text, again in blocks if again)
        copied = known >= COPIED * sum(len(text) for text, _ in blocks)
        return "\n".join(text for text, again in blocks if copied or not again)


def host_of(url: str) -> Column:
    """Host of a URL column, lower-case; the empty string where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


_TOKENS = {"token": pa.int64(), "is_text": pa.bool_(), "hint": pa.int32(), "depth": pa.int32(), "n": pa.int64(), "mass": pa.int64()}


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, row, tokens) of each page (_host, _row, _html), row being the page's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(value.as_py() or "").tokens() for value in batch.column(2)]
            columns = list(zip(*(t for page in found for t in page), strict=True)) or [()] * len(_TOKENS)
            values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _TOKENS.values(), strict=True)], list(_TOKENS))
            cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(cuts, values)], ["host", "row", "tokens"])

    return pages.select("_host", "_row", "_html").mapInArrow(run, "host string, row long, tokens array<struct<token:long,is_text:boolean,hint:int,depth:int,n:long,mass:long>>")


def token_classes(tokens: DataFrame) -> DataFrame:
    """(host, token, is_text, hint, depth, mass, once, support, pages, class) of the tokens in classes that enough pages have.

    tokens is as from page_tokens.  A token's occurrence vector is kept as the xor of 128 bits of hashes of (page, count),
    so classes are found by aggregation, with a host's pages split over tasks.  A class has an element and another token.
    """
    pages = tokens.groupBy("host").agg(F.count("*").alias("pages"))
    each = tokens.select("host", "row", F.inline("tokens"))
    vector = F.struct(*(F.bit_xor(F.xxhash64(F.lit(i), "row", "n")).alias(f"v{i}") for i in range(2)))
    each = each.groupBy("host", "token", "is_text").agg(F.count("*").alias("support"), vector.alias("class"), (F.max("n") == 1).alias("once"), F.sum("mass").alias("mass"), F.min("hint").alias("hint"), F.min("depth").alias("depth"))
    each = each.where(F.col("support") >= LEAST_PAGES).join(pages, "host").where(F.col("support") >= F.ceil(F.col("pages") * SUPPORT))
    sizes = each.groupBy("host", "class").agg(F.count("*").alias("_size"), F.max(~F.col("is_text")).alias("_framed")).where("_size > 1 and _framed").select("host", "class")
    return each.join(sizes, ["host", "class"])


def nested(places: dict[int, list[int]], support: dict[int, int]) -> dict[int, bool]:
    """Whether each class, of the places of its tokens in a page, doesn't interleave with one of more support (or as much and more tokens, or a lower number).

    Two classes nest if all of one stand between two neighbours of the other, or before or after it.
    """
    keys = sorted(places, key=lambda c: (-support[c], -len(places[c]), c))
    ok = {}
    for k, c in enumerate(keys):
        first, last = places[c][0], places[c][-1]

        def apart(o: int, c: int = c, first: int = first, last: int = last) -> bool:
            mine, other = np.searchsorted(places[o], [first, last]), np.searchsorted(places[c], [places[o][0], places[o][-1]])
            return bool(mine[0] == mine[1] or other[0] == other[1])

        ok[c] = all(apart(o) for o in keys[:k] if ok[o])
    return ok


def valid_classes(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """(host, class) of the classes that are in one order in every page that has them, and nest in every one."""
    lists = members.groupBy("host").agg(F.collect_list(F.struct("token", "is_text", F.xxhash64("class").alias("class"), "support")).alias("members"))
    joined = tokens.join(lists, "host").select("host", "tokens.token", "tokens.is_text", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for host, found, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = {(m["token"], m["is_text"]): (m["class"], m["support"]) for m in listed.as_py()}
                places: dict[int, list[int]] = {}
                order: dict[int, list[int]] = {}
                support = {}
                for i, t in enumerate(zip(found, text, strict=True)):
                    if t in known[host]:
                        c, support_ = known[host][t]
                        support[c] = support_
                        places.setdefault(c, []).append(i)
                        order.setdefault(c, []).append(t[0])
                rows += [(host, c, _hash(*order[c]), ok) for c, ok in nested(places, support).items()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["host", "class", "order", "nests"])

    checked = joined.mapInArrow(run, "host string, class long, order long, nests boolean").groupBy("host", "class")
    return checked.agg(F.min("order").alias("_a"), F.max("order").alias("_b"), F.min("nests").alias("_nests")).where("_a = _b and _nests").select("host", "class")


def deduce_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per host with a template: texts, the hashes of its texts, and region, the element that the article is in (null if none is).

    pages (_host, _row, _html) are different ones.  The region is an element of the template that each page has at most
    once: the deepest with REGION of the running text that any has, or of that in those marked as the article, if these
    have MARKED of it.  A host's template has at most 1 / SUPPORT times as many tokens as its mean page.
    """
    tokens = scratch.materialize(page_tokens(pages), "page-tokens")
    members = scratch.materialize(token_classes(tokens), "token-classes")
    valid = valid_classes(tokens, members)
    kept = scratch.materialize(members.withColumn("_class", F.xxhash64("class")).join(valid.withColumnRenamed("class", "_class"), ["host", "_class"]), "template-tokens")
    texts = kept.where(F.col("is_text") & (F.col("support") >= TEXT_PAGES)).groupBy("host").agg(F.collect_set("token").alias("texts"))
    places = kept.where(f"not is_text and once and hint not in ({OUT}, {PART})")
    most = places.groupBy("host").agg(F.max("mass").alias("_all"), F.max(F.when(F.col("hint") == MAIN, F.col("mass"))).alias("_marked"))
    marked = F.coalesce(F.col("_marked") >= MARKED * F.col("_all"), F.lit(False))
    able = F.when(marked, (F.col("hint") == MAIN) & (F.col("mass") >= REGION * F.col("_marked"))).otherwise(F.col("mass") >= REGION * F.col("_all"))
    regions = places.join(most, "host").where(able & (F.col("mass") > 0)).groupBy("host").agg(F.max_by("token", F.struct("depth", "mass", "token")).alias("region"))
    hosts = kept.select("host").distinct()
    return hosts.join(texts, "host", "left").join(regions, "host", "left").select("host", "region", F.coalesce("texts", F.array().cast("array<long>")).alias("texts"))


def different(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One of the pages of each host and content; only those that repeat are shuffled, and none where none does."""
    again = pages.groupBy("_host", "_row").agg(F.count("*").alias("_n")).where("_n > 1").select("_host", "_row")
    again = scratch.materialize(again, "repeated-pages")
    n = again.count()
    if not n:
        return pages
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    once = pages.join(again, ["_host", "_row"], "left_anti")
    return once.unionByName(pages.join(again, ["_host", "_row"], "left_semi").dropDuplicates(["_host", "_row"]))


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row.

    Hosts with fewer than LEAST_PAGES different pages have no template; their pages are judged by their own elements.  A text within
    the article goes as boilerplate only if it stands, in one place of the template, on half of the host's different pages and TEXT_PAGES at
    least, is no heading, and all such texts are less than COPIED of the page's region; so a notice without a telling name
    stays on a host of three pages, and what copies of one article share stays in all of them.
    A null or empty page has the empty text; a null url or one without a host belongs to the host ""; a null
    key is kept; repeated rows have one text and count once for the template; an empty table gives none; pages of any
    length and markup are read in time proportional to them; other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    scratch = Scratch(df.sparkSession)
    pages = df.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"), host_of(url).alias("_host"))
    contents = pages.select("_host", F.xxhash64("_html").alias("_row"), "_html")
    templates = materialize(deduce_templates(different(contents, scratch), scratch), "templates")
    scratch.drop()
    joined = pages.join(templates, F.col("_host") == F.col("host"), "left").select("_key", "_url", "_html", "region", "texts", "_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        for batch in batches:
            out = []
            for i, (value, region, host) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(batch.column(4)[i].as_py() or ())
                out.append(Page(value.as_py() or "").slots(region, known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [key, "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"`{key}` {kind}, url string, text string, n_chars long")
