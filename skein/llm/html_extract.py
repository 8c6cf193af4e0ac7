"""HTML extraction by consensus: pages score their containers and vote on generalised tag-class paths, hosts keep the paths
that win, and every page is cut to the blocks below winning paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.llm.url_filter import host_of
from skein.session import Scratch

#: Where markup may begin: a comment, a tag with its name, or something else that ends at the next >.
OPENING = re.compile(r"<(?:!--|(/?)([a-z][^\s/>]*+)|[!?/])", re.I)
#: The rest of a tag, in which a > between quotes doesn't end it.
ATTRS = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>")
#: Elements whose content is no markup, up to their own end tag.
RAW = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style noscript template textarea title iframe xmp noembed noframes".split()}
#: Tags of a page whose quotes may end nowhere before all tags end at the next >.
UNENDED = 4
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body div section article main td".split())
#: Elements that never hold main text, unless an article or main element stands in them.
DROPPED = frozenset("head nav footer aside button select menu dialog svg canvas object audio video map".split())
#: Elements that hold none if they are small beside the page.
DOUBTFUL = frozenset("header form fieldset".split())
#: A class, id or role names a part outside the main text if it is one of the nouns, maybe with words before and behind it.
#: Any other word makes it a state or a layout, such as has-sidebar or comments-open.
NOUNS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside complementary contentinfo banner notice notices alert alerts cookie cookies consent gdpr"
    " ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion popup modal newsletter subscribe subscription signup login form search share sharing social related recommended recommendations toolbar".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus".split())
BEFORE = frozenset("main site page global top bottom left right primary secondary sub post entry article blog user reader my the js wp".split())
BEHIND = frozenset("list area section box wrapper wrap container bar block widget panel inner links link notice banner form posts articles stories items item thread buttons button icons group region main primary secondary top bottom left right".split())
INSIDE = frozenset("article content main post entry story body text".split())
#: Which open elements a start tag ends, and the elements that keep it from reaching further out.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that an end tag of another element doesn't reach beyond, but for those of the second list.
TABLE = frozenset("td th table".split())
REACHING = frozenset("table body html tr tbody thead tfoot".split())
P_STOPS = CONTAINERS | {"table", "li", "blockquote"}
P_ENDS_AT = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


class Page(NamedTuple):
    """Elements in page order, the first a root without a tag, and blocks of text: the element of each, its text and how
    many of its characters are linked."""

    tags: list[str]
    paths: list[int]
    parents: list[int]
    marks: list[int]
    bonus: list[float]
    blocks: list[tuple[int, str, int]]


#: Marks of elements: nothing, a part that may be outside, one that always is, reader comments.
PLAIN, MAYBE, ALWAYS, READERS = range(4)


def marks_of(attrs: str) -> tuple[int, bool, str]:
    """The mark that class, id and role give, whether they name main text, and the generalised class: sorted names without
    digits."""
    mark, inside, name = PLAIN, False, ""
    for key, value in ATTRIBUTE.findall(attrs):
        names = unescape(value.strip("\"'")).split()
        for x in names:
            words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", x)]
            nouns = [w for w in words if w in NOUNS or w in COMMENTS]
            inside = inside or any(w in INSIDE for w in words)
            # The header of an entry holds its title.
            title = nouns == ["header"] and words[0] in ("article", "post", "entry")
            if nouns and not title and all(w in nouns or w in (BEFORE if i < words.index(nouns[0]) else BEHIND) for i, w in enumerate(words)):
                mark = max(mark, READERS if any(w in COMMENTS for w in nouns) else MAYBE)
        if key.lower() == "class":
            name = ".".join(sorted({y for x in names if (y := re.sub(r"\d+", "", x.lower()))}))
    return mark, inside, name


def markup(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it is an end tag, attributes) of each piece of markup; comments and raw elements have no tag.

    What isn't ended by a > is text. Goes forward only: what was searched for in vain isn't searched for again."""
    last, pos, unended = html.rfind(">"), 0, 0
    while m := OPENING.search(html, pos):
        start, tag, attrs, ends = m.start(), "", "", bool(m[1])
        if m[0] == "<!--":
            pos = html.find("-->", m.end()) + 3
            pos = pos if pos > 2 else len(html)
        elif start > last:
            # Only a comment may end with the page.
            pos = html.find("<!--", start)
            if pos < 0:
                return
            continue
        elif m[2] is None:
            pos = html.find(">", m.end()) + 1
        else:
            tag = m[2].lower()
            rest = ATTRS.match(html, m.end()) if unended < UNENDED else None
            if rest:
                attrs, pos = rest[0][:-1], rest.end()
            else:
                unended += 1
                pos = html.find(">", m.end()) + 1
            if rest and not ends and tag in RAW:
                tag, close = "", RAW[tag].search(html, pos)
                pos = close.end() if close else len(html)
        yield start, pos, tag, ends, attrs


def parse(html: str | None) -> Page:
    """Memory and time are in proportion to the page, however deep its elements are nested."""
    page = Page([""], [0], [-1], [PLAIN], [1.0], [])
    tags, paths, parents, marks, bonus, blocks = page
    stack, parts, linked, in_link = [0], [], 0, 0
    #: By tag, the places in the stack of its open elements.
    is_open: dict[str, list[int]] = {}
    known: dict[str, tuple[int, bool, str]] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1], text, linked))
            parts.clear()
        linked = 0

    def innermost(names) -> int:
        return max((places[-1] for t in names if (places := is_open.get(t))), default=0)

    def close(ends, stop) -> None:
        """End the innermost of the elements, and what is open inside it, unless a stop is nearer."""
        if (found := innermost(ends)) and found >= innermost(stop):
            for e in stack[found:]:
                is_open[tags[e]].pop()
            del stack[found:]

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            linked += len(raw) if in_link else 0

    at = 0
    html = html or ""
    for start, end, tag, ends, attrs in markup(html):
        text_of(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            text_of(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
        elif ends:
            flush()
            close((tag,), TABLE - {tag} if tag not in REACHING else ())
            in_link = 0
        else:
            flush()
            in_link = 0
            if tag in VOID:
                continue
            if tag in P_ENDS_AT:
                close(("p",), P_STOPS)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if (found := known.get(attrs)) is None:
                found = known[attrs] = marks_of(attrs) if attrs else (PLAIN, False, "")
            mark, inside, name = found
            main = tag in ("article", "main")
            if tag in DROPPED:
                mark = max(mark, ALWAYS)
            elif tag in DOUBTFUL:
                mark = max(mark, MAYBE)
            if tag in ("html", "body") or mark == MAYBE and (main or tag == "header" and (is_open.get("article") or is_open.get("main"))):
                mark = PLAIN
            tags.append(tag)
            parents.append(stack[-1])
            paths.append(xxhash.xxh64_intdigest(f"{tag}.{name}".encode("utf-8", "replace"), paths[stack[-1]]))
            marks.append(mark)
            bonus.append(2.0 if main else 1.5 if inside else 1.0)
            stack.append(len(tags) - 1)
            is_open.setdefault(tag, []).append(len(stack) - 1)
    text_of(html[at:])
    flush()
    return page


def outside(page: Page) -> list[bool]:
    """Which elements stand outside the main text.

    Marked as reader comments or always outside: unless an article or main element with text and without a mark stands in it.
    Marked as doubtful: if no such element stands in it, but one elsewhere on the page, or if it has at most half of the
    unlinked text of the article that it stands in, else of the page, or more linked than unlinked text.
    If nothing were left, nothing is outside but elements that always are.
    """
    n = len(page.tags)
    linked, plain, holds = [0] * n, [0] * n, [False] * n
    for element, text, link in page.blocks:
        linked[element] += link
        plain[element] += max(len(text) - link, 0)
    total = 0
    for i in range(n - 1, -1, -1):
        up = page.parents[i]
        hard = page.marks[i] >= ALWAYS and not holds[i]
        if up < 0:
            total = plain[i]
        elif not hard:
            linked[up] += linked[i]
            plain[up] += plain[i]
            holds[up] = holds[up] or holds[i] or (page.tags[i] in ("article", "main") and page.marks[i] == PLAIN and plain[i] > 0)
    #: The nearest article or main element around each.
    article = [0] * n
    for i in range(1, n):
        up = page.parents[i]
        article[i] = up if page.tags[up] in ("article", "main") and page.marks[up] == PLAIN else article[up]
    for least in (MAYBE, ALWAYS):
        out = [False] * n
        for i in range(1, n):
            mark = page.marks[i]
            small = 2 * plain[i] <= (plain[article[i]] if article[i] else total) or linked[i] > plain[i]
            off = mark >= least and not holds[i] and (mark >= ALWAYS or small or holds[0] and not article[i]) and not (least == ALWAYS and mark == READERS)
            out[i] = out[page.parents[i]] or off
        if any(not out[e] for e, _, _ in page.blocks):
            break
    return out


def main_blocks(page: Page) -> list[tuple[int, bool, str]]:
    """(path, main, text) of each block that isn't outside: the path of its nearest container and whether that is main text
    for this page alone.

    A block counts its unlinked characters fully for its nearest container and by half for each further one out; articles
    and containers named like content count more. The best container (the first of equals) is main text; if it stands in an
    article or main element, so is all of the outermost of these; else all below it, the text that stands directly in
    containers around it, and other containers with a heading of the first order, or whose own text is a tenth of the best
    one's and mostly unlinked.
    """
    out = outside(page)
    n = len(page.tags)
    nearest = [0] * n
    semantic = [0] * n
    for i in range(1, n):
        up = page.parents[i]
        nearest[i] = i if page.tags[i] in CONTAINERS else nearest[up]
        semantic[i] = semantic[up] or (i if page.tags[i] in ("article", "main") else 0)
    blocks = [(nearest[e], text, link) for e, text, link in page.blocks if not out[e]]
    if not blocks:
        return []
    scores: dict[int, float] = {}
    plain: dict[int, int] = {}
    linked: dict[int, int] = {}
    for at, text, link in blocks:
        value, weight = max(len(text) - 2 * link, 0) + 1, 1.0
        plain[at] = plain.get(at, 0) + max(len(text) - link, 0)
        linked[at] = linked.get(at, 0) + link
        while weight > 0.1:
            scores[at] = scores.get(at, 0.0) + value * weight * page.bonus[at]
            if not at:
                break
            weight *= 0.5
            at = nearest[page.parents[at]]
    best = max(scores, key=lambda i: (scores[i], -i))
    around, at = set(), best
    while at:
        around.add(at)
        at = page.parents[at]
    around.add(0)
    top = semantic[best] or best
    below = [False] * n
    for i in range(n):
        below[i] = i == top or (i > 0 and below[page.parents[i]])
    own = max(plain.get(best, 0), max((plain[i] for i in plain if below[i]), default=0))
    titled = {nearest[e] for e, _, _ in page.blocks if page.tags[e] == "h1"}
    main = {i: below[i] or (not semantic[best] and (i in around or i in titled or (10 * plain[i] >= own and linked[i] < plain[i]))) for i in plain}
    return [(page.paths[at], main[at], text) for at, text, _ in blocks]


def extract(pages: DataFrame, broadcast_rows: int = 20_000) -> DataFrame:
    """One row (page_id, url, text, n_chars) per row of pages(page_id, url, html).

    Each page is parsed once: its blocks are written with the generalised tag-class path of their containers, and it votes
    for the paths of those it takes for main text. A path that two pages of a host or more have text at wins there if at least
    half of them vote for it; ties win. A page's text is that of its blocks at winning paths and at those of its own votes that no other
    page knows, or at all paths it voted for where it has none. Null or empty html gives empty text and no vote; pages without a
    host form one host of their own; repeated rows vote and give results as often as they occur; other columns are ignored;
    no rows give no rows.

    Votes are counted before they are shuffled. Up to broadcast_rows judged (host, path) go to all tasks; if there are more,
    they are joined with the pages' paths, without the text, which then meets its page's paths. The result is written to the
    shared folder.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))

    def cut(batch):
        found = []
        for html in batch["html"]:
            found.append([{"path": p - (1 << 64) if p >> 63 else p, "main": m, "text": t} for p, m, t in main_blocks(parse(html.as_py()))])
        return {c: batch[c] for c in ("page_id", "url", "host")} | {"blocks": found}

    scratch = Scratch(pages.sparkSession)
    try:
        blocks = map_batches(keyed, cut, f"page_id {id_type}, url string, host string, blocks array<struct<path: long, main: boolean, text: string>>")
        cut_pages = scratch.write(blocks.withColumn("row", F.monotonically_increasing_id()), "blocks")
        # A path counts once per page: for it if any of its blocks is main text.
        paths = F.array_distinct(F.transform("blocks", lambda b: b["path"]))
        yes = F.array_distinct(F.transform(F.filter("blocks", lambda b: b["main"]), lambda b: b["path"]))
        votes = cut_pages.select("host", yes.alias("yes"), F.explode(paths).alias("path"))
        votes = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.array_contains("yes", F.col("path"))).alias("votes"))
        judged = scratch.write(votes.where("n > 1").select("host", "path", (2 * F.col("votes") >= F.col("n")).alias("wins")), "judged")
        won, lost = (F.collect_list(F.when(F.col("wins") == w, F.col("path"))).alias(c) for c, w in (("won", True), ("lost", False)))
        if judged.count() <= broadcast_rows:
            joined = cut_pages.join(F.broadcast(judged.groupBy("host").agg(won, lost)), "host", "left")
        else:
            known = cut_pages.select("row", "host", F.explode(paths).alias("path")).join(judged, ["host", "path"])
            joined = cut_pages.join(known.groupBy("row").agg(won, lost), "row", "left")
        has = lambda c, b: F.array_contains(F.coalesce(c, F.array().cast("array<bigint>")), b["path"])
        at_won = F.filter("blocks", lambda b: has("won", b) | (b["main"] & ~has("lost", b)))
        kept = F.when(F.size(at_won) > 0, at_won).otherwise(F.filter("blocks", lambda b: b["main"]))
        text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
        result = scratch.write(joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long")), "result")
    finally:
        scratch.close(keep="result")
    return result
