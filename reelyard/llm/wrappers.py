"""Main text of web pages by union-free wrappers, inferred from the pages of a host.

A page is a stream of block tags and text runs; inline tags belong to the text around them.
A *wrapper* is a regular expression without unions over such streams: tags in order, each
with an expression for what it holds, where parts may be optional ``(...)?`` or repeated
``(...)+`` and text is a constant or a slot. The first page of a host is its first wrapper.
Every further one is aligned with it: equal tags are aligned inside in turn, text that differs
becomes a slot, tags that only one side has become optional, and tags that come back later
fold what lies between into one repeated group of optional parts. Wrappers are aligned with
each other by the same rule, so a host of any size is inferred in tasks over its pages, then
in rounds over a few wrappers at a time. A wrapper is as large as the template, not the host.

Each slot carries counts over all its pages. From these and its place in the template a slot
is main text or not, for the host as a whole; a page then gives the text of its main slots.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import packed, stored, unpacked

#: Wrappers that are aligned in one task.
FAN_IN = 32
#: Hosts whose wrappers a task holds at once.
HELD_HOSTS = 500
#: Blocks nested deeper than this belong to the block around them.
DEPTH = 80
#: Kinds of blocks inside one block before their attributes become a slot too.
KINDS = 150
#: Text that is equal on so many pages of a host, outside the article, is part of its template.
CONSTANT_PAGES = 5
#: Share of linked text from which a list is a menu, and its least number of entries.
MENU_LINKS, MENU_ENTRIES = 0.7, 3
#: Wrappers are broadcast up to this many bytes in all; beyond, they are joined.
BROADCAST_BYTES = 8 << 20

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br img wbr".split()
)
#: Blocks that an equal or related start tag closes, up to the block that bounds the search.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
PAGE_TAGS = {"html", "body"}
#: Tags that say nothing about what they hold.
PLAIN = {"div", "section", "td"}
#: Tags that are never main text; a header may be, inside an article.
ASIDE_TAGS = set(
    "head title nav aside footer form script style noscript template svg button select option textarea fieldset iframe "
    "object dialog menu canvas audio video".split()
)
#: Words of class, id and role that mark what is not the article.
ASIDE_NAMES = re.compile(
    r"(ads?|adsbygoogle|adv|adverts?|advertis\w*|sponsor\w*|promos?|promotion\w*|banner|nav|navbar|navigation|menu\w*|bread|"
    r"breadcrumbs?|crumbs?|masthead|footer\w*|sidebar\w*|aside|complementary|contentinfo|cookies?|cookiebar|consent|gdpr|notices?|"
    r"notification\w*|alert\w*|popup|modal|overlay|comment\w*|disqus|repl(?:y|ies)|respond|share|sharing|sharebar|social|related|"
    r"recommended|recommendations|newsletter|subscribe|subscription|login|signup|signin|search\w*|pagination|pager|paging|toolbar|"
    r"widgets?|copyright|disclaimer|tagcloud|form)\Z"
)
HEAD_NAMES = re.compile(r"(header|head|topbar)\Z")
MAIN_NAMES = re.compile(r"(articlebody|article|main|post|entry|content|story)\Z")

_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_NUMBER = re.compile(r"\d+")


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the ``>`` that ends a tag; a quote that is never closed does not hide it."""
    k = at
    while True:
        stop = _STOP.search(page, k)
        if not stop:
            return len(page)
        if stop.group() == ">":
            return stop.start()
        quote = stop.group()
        if last[quote] <= stop.start():
            end = page.find(">", at)
            return len(page) if end < 0 else end
        k = page.find(quote, stop.start() + 1) + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``("text", "", raw)``, ``("start", name, attributes)`` and ``("end", name, "")`` in order."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at < n:
        less = page.find("<", at)
        if less < 0:
            yield "text", "", page[at:]
            return
        if less > at:
            yield "text", "", page[at:less]
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        after = page[less + 1 : less + 2]
        if after in "!?" and after:
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, less + 1 + closing)
        if not name:
            if closing:
                end = page.find(">", less)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = less + 1
            continue
        end = tag_end(page, name.end(), last)
        tag = name.group().lower()
        at = end + 1
        if closing:
            yield "end", tag, ""
            continue
        yield "start", tag, page[name.end() : end]
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if not close:
                return
            at = page.find(">", close.end() - 1)
            at = n if at < 0 else at + 1
            yield "end", tag, ""


def label_of(tag: str, attributes: str) -> str:
    """Tag with its class, id, role and itemprop; numbers in them are slots."""
    if "=" not in attributes:
        return tag
    names = []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        names += [_NUMBER.sub("0", v) for v in entities.unescape("".join(values)).split()]
    return " ".join([tag, *sorted(set(names))]) if names else tag


def page_tree(page: str | None) -> list:
    """``[label, children]`` of a page; a child is such a list or a run ``(text, linked characters)``.

    Missing end tags are implied as browsers do; end tags that close nothing are ignored.
    """
    root = ["", []]
    stack, linked = [root], 0
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                links = sum(len(" ".join(p.split())) for p, is_link in parts if is_link)
                stack[-1][1].append((text, min(links, len(text))))
            parts.clear()

    def close(names: set, bounds: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i][0].split(" ", 1)[0]
            if tag in bounds:
                return
            if tag in names:
                del stack[i:]
                return

    deep: list[str] = []
    for kind, tag, rest in tokens(page or ""):
        if kind == "text":
            parts.append((entities.unescape(rest), linked > 0))
        elif tag in INLINE:
            if tag == "br":
                parts.append((" ", False))
            elif tag == "a":
                linked = 1 if kind == "start" else 0
        elif kind == "start":
            flush()
            linked = 0
            if tag in VOID or (tag in PAGE_TAGS and any(s[0].split(" ", 1)[0] == tag for s in stack)):
                continue
            close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in CLOSED_BY:
                names, bounds = CLOSED_BY[tag]
                for _ in names:
                    close(names, bounds)
            if len(stack) > DEPTH:
                deep.append(tag)
                continue
            node = [label_of(tag, rest), []]
            stack[-1][1].append(node)
            stack.append(node)
        else:
            flush()
            linked = 0
            if deep and tag in deep:
                del deep[len(deep) - 1 - deep[::-1].index(tag) :]
            elif tag not in PAGE_TAGS:
                close({tag}, {"td", "th", "table"} - {tag} if tag in ("p", "div", "span") else set())
                deep.clear()
    flush()
    hint(root)
    return root


def hint(node: list) -> None:
    """Blocks that only their place would tell apart also go by what they begin with."""
    for child in node[1]:
        if isinstance(child, list):
            hint(child)
            if child[0] in PLAIN:
                first = child[1][0] if child[1] else ("", 0)
                if isinstance(first, list):
                    child[0] += " ~" + first[0].split(" ", 1)[0]
                else:
                    child[0] += " ~link" if first[1] and first[1] >= len(first[0]) else " ~text"


# A wrapper node is {"c": occurrences, "s": segments, "k": {label: node}}; a segment is
# [labels, always present, repeated]. Text is a node "" of {"c", "x": characters, "a": linked
# characters, "t": digest and start of the text if it is always the same}.


def fold(labels: list[str]) -> list[list]:
    """Segments of one sequence: what comes back later closes a repeated group over what lies between."""
    out: list[list] = []
    place: dict[str, int] = {}
    for label in labels:
        i = place.get(label)
        if i is None:
            place[label] = len(out)
            out.append([[label], 1, 0])
        else:
            out[i:] = [joined(out[i:], 1)]
            for x in out[i][0]:
                place[x] = i
    return out


def joined(segments: list[list], many: int) -> list:
    """One repeated group of the parts of several segments, in order."""
    names = list(dict.fromkeys(x for s in segments for x in s[0]))
    return [names, max(s[1] for s in segments), int(many or len(names) > 1 or any(s[2] for s in segments))]


def align(left: list[list], right: list[list]) -> list[list]:
    """One sequence of segments for two; no label is in more than one segment of a sequence."""
    place = {x: i for i, s in enumerate(left) for x in s[0]}
    out: list[list] = []
    spot: dict[str, int] = {}
    cursor = 0

    def put(segment: list) -> None:
        for x in segment[0]:
            spot[x] = len(out)
        out.append(segment)

    for segment in right:
        known = [place[x] for x in segment[0] if x in place]
        back = [i for i in known if i < cursor]
        ahead = [i for i in known if i >= cursor]
        if not known:
            put([segment[0], 0, segment[2]])
            continue
        merged = segment
        if ahead:
            for s in left[cursor : min(ahead)]:
                put([s[0], 0, s[2]])
            met = left[min(ahead) : max(ahead) + 1]
            cursor = max(ahead) + 1
            both = joined([*met, segment], 0)
            merged = [both[0], int(segment[1] and any(s[1] for s in met)), both[2]]
        if back:  # it comes after what it came before on the other side
            i = min(spot[x] for x in segment[0] if x in spot)
            merged = joined([*out[i:], merged], 1)
            del out[i:]
        put(merged)
    for s in left[cursor:]:
        put([s[0], 0, s[2]])
    return out


def wrap(node: list) -> dict:
    """The wrapper of one block of a page."""
    kids: dict[str, dict] = {}
    labels = []
    for child in node[1]:
        if isinstance(child, tuple):
            text, links = child
            digest = blake2b(text.encode(), digest_size=8).hexdigest()
            label, one = "", {"c": 1, "x": len(text), "a": links, "t": [digest, text[:40]]}
        else:
            label, one = child[0], wrap(child)
        labels.append(label)
        if label in kids:
            absorb(kids[label], one)
        else:
            kids[label] = one
    return general({"c": 1, "s": fold(labels), "k": kids})


def absorb(left: dict, right: dict) -> dict:
    """Align the wrapper ``right`` with ``left``, which becomes the wrapper of both."""
    left["c"] += right["c"]
    if "k" not in left:
        left["x"] += right["x"]
        left["a"] += right["a"]
        if left["t"] and (not right["t"] or left["t"][0] != right["t"][0]):
            left["t"] = None
        return left
    for tag in {x[:-2] for n in (left, right) for x in n["k"] if x.endswith(" *")}:
        attributes_to_slot(left, tag)
        attributes_to_slot(right, tag)
    left["s"] = align(left["s"], right["s"])
    for label, node in right["k"].items():
        if label in left["k"]:
            absorb(left["k"][label], node)
        else:
            left["k"][label] = node
    return general(left)


def attributes_to_slot(node: dict, tag: str) -> None:
    """Blocks of a tag inside ``node`` become one kind, whatever their attributes."""
    some, name = [x for x in node["k"] if x == tag or x.startswith(tag + " ")], tag + " *"
    if not some or some == [name]:
        return
    kids = [node["k"].pop(x) for x in some]
    for kid in kids[1:]:
        absorb(kids[0], kid)
    node["k"][name] = kids[0]
    segments: list[list] = []
    at = None
    for names, always, many in node["s"]:
        new = list(dict.fromkeys(name if x in some else x for x in names))
        if name in new and at is not None:
            segments[at:] = [joined([*segments[at:], [new, always, many]], 1)]
        else:
            if name in new:
                at = len(segments)
            segments.append([new, always, int(many or len(new) < len(names))])
    node["s"] = segments


def general(node: dict) -> dict:
    while len(node["k"]) > KINDS:
        tags: dict[str, int] = {}
        for label in node["k"]:
            tag = label.split(" ", 1)[0]
            tags[tag] = tags.get(tag, 0) + 1
        tag = max(sorted(tags), key=tags.get)
        if tags[tag] < 2:
            break
        attributes_to_slot(node, tag)
    return node


def expression(node: dict) -> str:
    """The wrapper as a regular expression over tags and text; ``_`` is a slot."""
    parts = []
    for names, always, many in node["s"]:
        inner = []
        for label in names:
            kid = node["k"][label]
            if label:
                tag, _, rest = label.partition(" ")
                name = f"{tag}[{rest}]" if rest and rest[0] != "~" else tag
                inner.append(f"<{name}>{expression(kid)}</{tag}>")
            else:
                inner.append(re.escape(kid["t"][1]) if kid["t"] and kid["c"] > 1 else "_")
        if len(inner) > 1:
            inner = [f"({x})?" for x in inner]
        mark = {(1, 0): "", (0, 0): "?", (1, 1): "+", (0, 1): "*"}[always, many]
        parts.append(f"({''.join(inner)}){mark}" if mark else inner[0])
    return "".join(parts)


def names_of(label: str) -> tuple[str, list[str]]:
    tag, _, rest = label.partition(" ")
    return tag, [w.lower() for name in rest.split() if name[0] != "~" for w in _WORD.findall(name)]


def is_aside(label: str, in_main: bool) -> bool:
    """Whether tag or names say that a block is not main text."""
    tag, names = names_of(label)
    if tag in ASIDE_TAGS or any(ASIDE_NAMES.match(x) for x in names):
        return True
    return not in_main and (tag == "header" or any(HEAD_NAMES.match(x) for x in names))


def main_rank(label: str) -> int:
    """How surely a block holds the article: 3 for the tag, 2 for a main block, 1 for its name."""
    tag, names = names_of(label)
    if tag == "article":
        return 3
    if tag == "main" or tag in ("div", "section") and ("main" in names and "role" in names):
        return 2
    return 1 if tag in ("div", "section", "td") and any(MAIN_NAMES.match(x) for x in names) else 0


def weigh(node: dict) -> tuple[int, int, int]:
    """Characters, linked characters and text runs below a node."""
    if "k" not in node:
        return node["x"], node["a"], node["c"]
    sums = [weigh(k) for k in node["k"].values()]
    return tuple(map(sum, zip(*sums))) if sums else (0, 0, 0)


def holds_main(node: dict, rank: int) -> bool:
    return any(label and (main_rank(label) >= rank or holds_main(kid, rank)) for label, kid in node["k"].items())


def is_menu(label: str, node: dict) -> bool:
    """A list of which nearly all text is linked."""
    tag = label.split(" ", 1)[0]
    if tag not in ("ul", "ol", "div", "section", "table", "dl"):
        return False
    chars, links, runs = weigh(node)
    return runs >= MENU_ENTRIES * node["c"] and links >= MENU_LINKS * chars


def judge(wrapper: dict) -> dict:
    """What of a host's template is main text.

    ``rank`` is the kind of block that holds the article (0: none on this host), ``all`` the
    judgement of everything outside such blocks: per label 1 for main text, 0 for other text, or
    the judgement of what the block holds.
    """
    best: dict[int, int] = {}

    def seek(node: dict) -> None:
        for label, kid in node["k"].items():
            if label and not (is_aside(label, False) and not holds_main(kid, 3)):
                rank = main_rank(label)
                if rank:
                    best[rank] = best.get(rank, 0) + weigh(kid)[0]
                seek(kid)

    seek(wrapper)
    rank = next((r for r in (3, 2) if best.get(r)), 0)
    if not rank and best.get(1, 0) >= 0.5 * weigh(wrapper)[0]:
        rank = 1

    constant, varying = 0, 0

    def tally(node: dict) -> None:
        nonlocal constant, varying
        for kid in node["k"].values():
            if "k" in kid:
                tally(kid)
            elif kid["t"] and kid["c"] >= CONSTANT_PAGES:
                constant += kid["x"]
            else:
                varying += kid["x"]

    tally(wrapper)

    def mark(node: dict, in_main: bool) -> dict:
        out = {}
        for label, kid in node["k"].items():
            if not label:
                template = kid["t"] and kid["c"] >= CONSTANT_PAGES and not in_main and varying > constant
                out[label] = int(not template)
                continue
            own_rank = main_rank(label)
            inner = in_main or bool(rank and own_rank == rank)
            safe = label.split(" ", 1)[0] in PAGE_TAGS or own_rank >= 2 or (not in_main and rank and holds_main(kid, rank))
            if not safe and (is_aside(label, in_main) or is_menu(label, kid)):
                out[label] = 0
            else:
                out[label] = mark(kid, inner)
        return out

    return {"rank": rank, "all": mark(wrapper, False)}


def blocks_of(tree: list, rules: dict) -> list[str]:
    """The main text blocks of a page by the judgement of its host."""
    rank = rules["rank"]
    found: list[tuple[str, bool]] = []
    has_main = False

    def walk(node: list, rule: dict, in_main: bool) -> None:
        nonlocal has_main
        for child in node[1]:
            if isinstance(child, tuple):
                if rule.get("", 1):
                    found.append((child[0], in_main))
                continue
            label = child[0]
            tag = label.split(" ", 1)[0]
            inner = rule.get(label)
            if inner is None:
                inner = rule.get(tag + " *", {})
                if inner != 0 and is_aside(label, in_main) and tag not in PAGE_TAGS:
                    inner = 0
            if inner == 0:
                continue
            is_main = bool(rank and main_rank(label) == rank)
            has_main = has_main or is_main
            walk(child, inner, in_main or is_main)

    walk(tree, rules["all"], False)
    return [text for text, inside in found if inside or not has_main]


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PARTIAL = "host string, wrapper binary"
_PARTIAL = pa.schema([("host", pa.string()), ("wrapper", pa.binary())])


def host_of(url) -> F.Column:
    """Lower-case host of an address; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), HOST, 1))


def dump(wrapper: dict) -> bytes:
    return json.dumps(wrapper, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")


def load(data: bytes) -> dict:
    return json.loads(data.decode("utf-8", "surrogatepass"))


def host_wrappers(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``host, wrapper`` of ``pages(host, html)``: one wrapper per host, over all its pages."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def out() -> pa.RecordBatch:
            rows = [{"host": h, "wrapper": dump(w)} for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_PARTIAL)

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                one = wrap(page_tree(page.as_py()))
                if host in held:
                    absorb(held[host], one)
                else:
                    held[host] = one
                if len(held) > HELD_HOSTS:
                    yield out()
        if held:
            yield out()

    def reduce_wrappers(table: pa.Table) -> pa.Table:
        first, *others = (load(x) for x in sorted(table["wrapper"].to_pylist()))
        for other in others:
            absorb(first, other)
        return pa.Table.from_pylist([{"host": table["host"][0].as_py(), "wrapper": dump(first)}], schema=_PARTIAL)

    found = stored(pages.mapInArrow(infer, PARTIAL), "wrappers")
    while True:
        sizes = found.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / fan_in)).alias("part")
        dealt = found.join(sizes, "host").select("host", "wrapper", part)
        found = stored(dealt.groupBy("host", "part").applyInArrow(reduce_wrappers, PARTIAL), "wrappers")


def templates(wrappers: DataFrame) -> DataFrame:
    """``host, pages, expression`` of every wrapper, for people to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [load(x) for x in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([w["c"] for w in held], pa.int64()), pa.array([expression(w) for w in held], pa.string())],
                ["host", "pages", "expression"],
            )

    return wrappers.mapInArrow(run, "host string, pages long, expression string")


def main_text(pages: DataFrame, fan_in: int = FAN_IN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All rows and columns of ``pages`` with ``text``, the main text of ``html``, and ``n_chars``.

    Needs ``url`` (its host groups the pages; null and addresses without a host are one group)
    and ``html``. The article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and reader comments: blocks in page order, joined by ``\\n``, white
    space within a block one space, character references decoded. A null or empty page and one
    without main text have an empty text; a repeated row is extracted like its copy; an empty
    table gives no rows. Other columns pass through, but ``text`` and ``n_chars`` are replaced.
    """
    own = packed(pages, host_of("url").alias("host"), F.col("html").cast("string").alias("html"))
    wrappers = stored(host_wrappers(own.select("host", "html"), fan_in), "host-wrappers")

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [dump(judge(load(x))) for x in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(judged, pa.binary())], ["host", "rules"])

    judged = stored(wrappers.mapInArrow(rules, "host string, rules binary"), "host-rules")
    size = judged.agg(F.sum(F.octet_length("rules") + F.octet_length("host"))).first()[0] or 0
    side = F.broadcast(judged) if size <= broadcast_bytes else judged
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in keep]).alias("row")
    joined_rows = own.join(side, "host", "left").select(row, "html", "rules")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, dict] = {}
        for batch in batches:
            texts = []
            for page, data in zip(batch.column("html"), batch.column("rules").to_pylist()):
                if data not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[data] = load(data)
                texts.append("\n".join(blocks_of(page_tree(page.as_py()), known[data])))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kind = joined_rows.schema["row"].dataType.simpleString()
    done = joined_rows.mapInArrow(extract, f"row {kind}, text string")
    return done.select(*unpacked(keep), "text", F.length("text").cast("long").alias("n_chars"))


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The rows that the registered query returns."""
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
