"""Main text of pages by the paths that a host's pages agree on.

Each page scores its containers and names the best by a generalised path of
tags and classes; Spark counts the votes of a host's pages; every page is then
read again along the winning paths.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.llm.arrow import append
from tabloom.session import checkpoint

LONG = 25  # characters of a substantial block
REST = 0.2  # of a page's text that containers beside the best one need for the whole body to be voted for
WELL = 0.5  # of a page's text that the path with most votes needs to be read without a look at the others
SENT = 8 << 20  # bytes of all hosts' paths up to which they are broadcast
SALTS = 32
PATHS = 200  # paths of a host at most, which bounds a row of the smaller side; a page's own path is always another

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>"
                   r"|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?:\s|^)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")  # a value at the end of a tag; its slash does not close the element

# Fixed values of HTML: elements by how they are read.
RAW = frozenset("script style title textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head noscript template button select svg iframe object canvas audio video".split())
SIDE = frozenset("nav footer header aside form menu".split())  # dropped unless they are the wrapper of the article
DOUBTED = frozenset("label fieldset dialog".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
                  "h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul "
                  "aside dialog".split())
CONTAINER = frozenset("article main section div td body center".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_KIND = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
             "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body td".split())

# Words of class, id and role that mark what is not the article, and words before them that deny it or say it of a layout.
BOILER = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side widget ad ads advert "
                   "advertisement sponsor sponsored promo banner cookie cookies consent notice gdpr popup modal newsletter "
                   "subscribe share social related recommended comment comments replies reply respond disqus login signup "
                   "search pagination copyright legal toolbar complementary contentinfo".split())
DENIED = frozenset("no not non without has with".split())
# Words beside them in a compound that say where or how it stands on the page, never what a text is about.
LAYOUT = frozenset("site main global primary secondary top bottom left right mobile desktop sticky fixed floating box bar slot strip "
                   "wrapper wrap container inner outer block area unit panel section row col column list item items link links "
                   "button buttons icon icons overlay dialog message toggle trigger close posts articles stories".split())
BETWEEN = re.compile("[-_]+|(?<=[a-z])(?=[A-Z])")
NEVER = frozenset("body html article main".split())  # never dropped
PLAIN, DOUBTFUL, MARKED = range(3)
DOUBT = 0.3  # what a doubtful block's text is worth
MINOR = 0.5  # of the article's text that a doubtful element of links holds at most if it is left out


class Block:
    """A run of text between block borders: the containers around it, its characters and those inside links."""

    __slots__ = ("path", "nodes", "parts", "linked", "dropped", "doubts", "marks", "core", "title", "own")

    def __init__(self, path, nodes, dropped, doubts, marks, core, title, own):
        self.path, self.nodes, self.parts, self.linked, self.dropped = path, nodes, [], 0, dropped
        self.doubts, self.marks, self.core, self.title = doubts, marks, core, title
        self.own = own  # a paragraph's element that its class alone marks

    def unlinked(self) -> int:
        return max(0, len("".join(self.parts).strip()) - self.linked)

    def worth(self) -> float:
        size = len("".join(self.parts).strip())
        return max(0.0, size - 2.0 * self.linked) * (1.0 if size >= LONG else 0.3) * (DOUBT if self.doubts else 1.0)


@lru_cache(4096)
def kind_of(value: str) -> int:
    """Marked if a word of class, id or role is a boilerplate word or a compound of these, layout words and numbers.

    A compound that has such a word beside words of another kind (``post-share``, ``share-price``) is doubtful.
    """
    kind, before = PLAIN, ""
    for token in value.split():
        word = token.lower()
        if word in BOILER and before not in DENIED:
            return MARKED
        parts = [x.lower() for x in BETWEEN.split(token) if x]
        if len(parts) > 1 and any(x in BOILER and y not in DENIED for y, x in zip(["", *parts], parts)):
            if all(x in BOILER or x in LAYOUT or x.isdigit() for x in parts):
                return MARKED
            kind = DOUBTFUL
        before = word
    return kind


def generalised(tag: str, attributes: str) -> tuple[str, int]:
    """(tag with its first class, digits as 0; whether class, id or role mark it as no part of an article)."""
    name, kind = tag, PLAIN
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = entities.unescape(m[2] or m[3] or m[4] or "")
            kind = max(kind, kind_of(value))
            if m[1].lower() == "class" and value.split():
                name = f"{tag}.{re.sub('[0-9]+', '0', value.split()[0])}"
    return name, kind


def spare(found: list[Block], holders: set[int], forms: set[int]) -> None:
    """Drops the blocks in marked elements, but not those in one that is the article's wrapper.

    Such an element holds an article or main and more text than all of these
    outside marked elements, or, named by its class or a form, most of a page's
    text where no article or main outside has any. A paragraph of an article or
    main that nothing but its own class marks stays too if it is a sentence
    without links (``p.legal``).
    """
    for b in found:
        if b.core and b.own is not None and b.marks == [b.own] and not b.linked and b.unlinked() >= 2 * LONG:
            b.marks = []
    inside: dict[int, int] = {}
    core = total = 0
    for b in found:
        if b.dropped:
            continue
        size = b.unlinked()
        total += size
        core += size if b.core and not b.marks else 0
        for e in b.marks:
            inside[e] = inside.get(e, 0) + size
    spared = {e for e, n in inside.items() if e in holders and n > core or e in forms and 2 * n > total and not core}
    for b in found:
        if b.marks:
            b.dropped = b.dropped or not spared.issuperset(b.marks)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles, comments and markup are gone, references not yet decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int, int]] = []  # tag, generalised name, dropped, number of the element, its kind
    holders: set[int] = set()  # marked elements around an article or main
    forms: set[int] = set()  # marked elements that may hold a page without these
    current: Block | None = None
    links, number, at, size = 0, 0, 0, len(page)

    def text(piece):
        nonlocal current
        if not piece or (current is None and not piece.strip()):
            return
        if current is None:
            around = [s for s in stack if s[0] in CONTAINER]
            current = Block(tuple(s[1] for s in around if s[0] != "body"), tuple(s[3] for s in around),
                            any(s[2] for s in stack), frozenset(s[3] for s in stack if s[4] != PLAIN),
                            [s[3] for s in stack if s[4] == MARKED], any(s[0] in ("article", "main") for s in stack),
                            any(s[0] == "h1" for s in stack), next((s[3] for s in stack if s[0] == "p" and s[4] == MARKED), None))
            out.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def pop_to(depth):
        nonlocal links, current
        while len(stack) > depth:
            tag = stack.pop()[0]
            links -= tag == "a"
            if tag in BLOCK:
                current = None

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and (tag in BLOCK or not any(s[0] in BLOCK for s in stack[depth:])):
                pop_to(depth)
            if tag in BLOCK:
                current = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or size if end else size
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            current = None
            inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in SCOPE or stack[i][0] == "p"), None)
            if inner is not None and stack[inner][0] == "p":
                pop_to(inner)
        if tag in SAME_KIND:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_KIND[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        attributes = m[3] or m[6] or ""
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and not UNQUOTED.search(attributes):
            continue
        name, kind = generalised(tag, attributes)
        number += 1
        if tag in ("article", "main") and kind == PLAIN:
            holders.update(s[3] for s in stack if s[4] == MARKED)
        if tag in ("body", "html"):
            kind = PLAIN
        elif tag in NEVER or tag in DOUBTED:
            kind = min(kind, DOUBTFUL) if tag in NEVER else max(kind, DOUBTFUL)
        elif kind == MARKED and tag not in SIDE or tag == "form":
            kind = MARKED
            forms.add(number)
        elif tag in SIDE:
            kind = MARKED
        stack.append((tag, name, tag in DROPPED, number, kind))
        links += tag == "a"
    spare(out, holders, forms)
    return out


def cleaned(block: Block) -> str:
    return " ".join(entities.unescape("".join(block.parts)).split())


def totals(found: list[Block]) -> dict[tuple, float]:
    """What the text under each container's path is worth; () is the page."""
    total: dict[tuple, float] = {}
    for b in found:
        worth = b.worth()
        for depth in range(len(b.path) + 1):
            key = b.path[:depth]
            total[key] = total.get(key, 0.0) + worth
    return total


def enclosing(found: list[Block], total: dict[tuple, float]) -> tuple | None:
    """Path of the smallest container around the page's substantial blocks, or nothing.

    From the container with most text of its own the way goes up: to an article
    for any text, to another container for text of its own or a substantial
    block, and to the body for a title or substantial text of its own, or if the
    containers beside hold ``REST`` of the page's text.
    """
    direct: dict[tuple, float] = {}
    for b in found:
        direct[b.path] = direct.get(b.path, 0.0) + b.worth()
    best = max(sorted(direct), key=lambda k: direct[k], default=None)
    if best is None or direct[best] <= 0:
        return None
    trusted = max((b for b in found if b.path == best), key=Block.worth).doubts  # around the best text: no reason to doubt others

    shared: dict[int, list[Block]] = {}  # by how many containers a block has in common with the best one
    for b in found:
        n = next((i for i, (x, y) in enumerate(zip(b.path, best)) if x != y), min(len(b.path), len(best)))
        shared.setdefault(n, []).append(b)
    inside = next((i + 1 for i, name in enumerate(best) if name.split(".")[0] == "article"), len(best) + 1)

    def calls(b, depth):
        own, size = len(b.path) == depth, b.unlinked()
        if size <= b.linked or depth < inside and not b.doubts <= trusted:
            return False
        return depth >= inside or size >= LONG and (own or depth > 0) or own and (b.title or depth > 0)

    place = best
    for depth in range(len(best) - 1, -1, -1):
        outer = best[:depth]
        if any(calls(b, depth) for b in shared.get(depth, ())) or not outer and total[()] - total[place] >= REST * total[()]:
            place = outer
    return place


def containers(page: str | None) -> list[tuple[str, float]]:
    """(path, worth) of the container that the page votes for, or nothing."""
    return [(p, w) for p, w, won in votes_of(page) if won]


def votes_of(page: str | None) -> list[tuple[str, float, int]]:
    """(path, worth, 1) of the page's container, and (path, 0, 0) of each container beside it that has text."""
    found = [b for b in blocks(page or "") if not b.dropped]
    total = totals(found)
    place = enclosing(found, total)
    if place is None:
        return []
    beside = {key for b in found if b.path[:len(place)] != place for d in range(1, len(b.path) + 1)
              if (key := b.path[:d]) != place[:d] and total[key] > 0}
    return [(" > ".join(place), total[place], 1), *((" > ".join(k), 0.0, 0) for k in sorted(beside))]


def link_lists(kept: list[Block]) -> set[int]:
    """The doubtful elements that are mostly links and hold ``MINOR`` of the text of ``kept`` at most (``div.post-navigation``)."""
    total, sizes = 0, {}
    for b in kept:
        linked, unlinked = b.linked, b.unlinked()
        total += linked + unlinked
        for e in b.doubts.difference(b.marks):
            had = sizes.get(e, (0, 0))
            sizes[e] = had[0] + linked, had[1] + unlinked
    return {e for e, (linked, unlinked) in sizes.items() if linked > unlinked and linked + unlinked <= MINOR * total}


def extract(page: str | None, paths: list[str], refused: list[str] = ()) -> str:
    """Text of the blocks under the path that gives the page most.

    The choice is between the first of ``paths`` that covers the page well, or
    else that of them with most text, and the page's own container unless it is
    ``refused`` by the host's other pages.
    """
    found = [b for b in blocks(page or "") if not b.dropped]
    total = totals(found)
    present = [k for p in paths if (k := tuple(p.split(" > ")) if p else ()) in total]
    chosen = next((k for k in present if total[k] >= WELL * total[()]), max(present, key=lambda k: total[k], default=None))
    own = enclosing(found, total)
    if own is not None and (chosen is None or total[own] > total[chosen] and " > ".join(own) not in refused):
        chosen = own
    if chosen is None:
        return ""
    kept = [b for b in found if b.path[:len(chosen)] == chosen]
    away = link_lists(kept)
    return "\n\n".join(x for b in kept if away.isdisjoint(b.doubts) and (x := cleaned(b)))


def host_of(url: str):
    """The host in lower case, empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths, refused): each host's voted paths, most votes first, ties by the path.

    A path that lies beside a page's container more often than it is one is
    refused. A path with a single vote is only that page's own.
    """
    best = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType()),
                                     T.StructField("won", T.IntegerType())]))
    named = pages.select(host_of(url).alias("host"), F.col(html).alias("__html"))
    voted = append(named, ["__html"], [("best", best)], lambda: lambda rows: [[votes_of(h) for h in rows]])
    votes = voted.select("host", F.explode("best").alias("b")).groupBy("host", F.col("b.path").alias("path")).agg(
        F.sum("b.won").alias("votes"), F.sum(1 - F.col("b.won")).alias("lost"), F.sum("b.score").alias("score"))
    kinds = votes.withColumn("good", F.col("lost") <= F.col("votes")).filter(
        F.when(F.col("good"), F.col("votes") > 1).otherwise(F.col("votes") > 0))
    # a host's paths are bounded by its templates; one row a path comes here, whatever its number of pages
    ranked = kinds.withColumn("place", F.row_number().over(Window.partitionBy("host", "good").orderBy(
        F.desc(F.when(F.col("good"), F.col("votes")).otherwise(F.col("lost"))), F.desc("score"), "path")))
    listed = lambda which: F.transform(
        F.array_sort(F.collect_list(F.when(which, F.struct("place", "path")))), lambda s: s["path"])
    return ranked.filter(F.col("place") <= PATHS).groupBy("host").agg(
        listed(F.col("good")).alias("paths"), listed(~F.col("good")).alias("refused"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Adds each page's main text, blocks joined by an empty line.

    A null or empty html gives an empty text; a null url, or one without a
    host, votes with the others of its kind. Repeated rows vote as often as
    they occur. The hosts' paths are sent to all tasks if their size, which is
    summed up first, is small; otherwise each host's row is repeated for
    ``SALTS`` parts of its pages, so that no host's pages meet in one task.
    """
    winners = checkpoint(host_votes(pages, url, html).select(F.col("host").alias("__host"), F.col("paths").alias("__paths"),
                                                               F.col("refused").alias("__refused")))
    sent = [F.octet_length(F.array_join(c, " ")) + 16 * F.size(c) for c in ("__paths", "__refused")]
    size = winners.agg(F.sum(F.octet_length("__host") + sent[0] + sent[1] + 64).alias("n")).first()["n"]
    rows = pages.withColumn("__key", host_of(url))
    if (size or 0) <= SENT:
        met = rows.join(F.broadcast(winners), F.col("__key") == F.col("__host"), "left")
    else:
        salted = winners.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__own", F.pmod(F.xxhash64(url, F.substring(html, 1, 1000)), F.lit(SALTS)).cast("int"))
        met = rows.join(salted, (F.col("__key") == F.col("__host")) & (F.col("__own") == F.col("__part")), "left")
    met = met.drop("__host", "__key", "__own", "__part")
    made = append(met, [html, "__paths", "__refused"], [(text, T.StringType())], lambda: lambda rows, paths, refused: [
        [extract(h, p or [], r or []) for h, p, r in zip(rows, paths, refused)]])
    return made.drop("__paths", "__refused")
