"""HTML extraction by tag-path ratios.

Every text node hangs on the path of tags from the root to it; inline elements
belong to the block around them. Per path, length outside links and punctuation
are averaged over its nodes, smoothed over paths next to it in page order and in
the tree, fused, and compared with a share of the page's best score. The text
nodes of the paths above it are selected. The article is the lowest element that
holds all of them, widened to an article or main element around it, or to parents
whose paragraphs and headings stand right beside it; under the body it runs from
the first selected child to the last. What lies between selected nodes belongs to it.

Elements such as nav and footer are left out, and places whose class, id or role
names them so. A name counts by its last telling word (``site-footer``,
``comment-list``), never with a modifier (``has-sidebar``), and not for a place
that holds the page's main element or all of its articles.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcols.llm.shipping import map_arrow

OPENING = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: the rest of a tag; a quote that isn't closed is an ordinary character
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no markup, without content, inline, of running text, never of the article
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in "script style textarea iframe title xmp noframes".split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = HEADINGS | set("p ul ol dl table pre blockquote figure".split())
APART = set("head nav footer aside form button select dialog menu option fieldset object audio video canvas noscript template svg math".split())
APART_ROLES = set("navigation complementary contentinfo banner search dialog alert alertdialog menu menubar form".split())
#: Words that name such places, words that may follow them, words that only modify another place
PLACES = set(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay nav navbar navigation menu menus menubar "
    "breadcrumb breadcrumbs sidebar sidebars side widget widgets footer foot masthead topbar comment comments disqus respond "
    "reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search pager pagination skip".split()
)
FOLLOWING = set(
    "area bar block body box button buttons card cards col column container content form group holder icons inner item items "
    "left link links list main message middle outer panel post posts primary region right row secondary section slot stories "
    "story text thread top bottom unit widget wrap wrapper".split()
)
MODIFIERS = set("has no not with without is hide hides hidden show shows toggle open closed below above under".split())
SITE_HEADERS = {("site", "header"), ("page", "header"), ("top", "header"), ("main", "header"), ("global", "header")}
PUNCTUATION = re.compile(r"[,.;:!?、。，！？…]")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: an opening of the first closes an open one of the second
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: ratios above these tell no more; share of the best score that selects a path; weight of a neighbour elsewhere in the tree
LONG, MARKS, SHARE, ELSEWHERE = 400, 6, 0.4, 0.25


class Page(NamedTuple):
    """Elements in page order (the first is the page itself), each after its parent, and text nodes."""

    tag: list[str]
    names: list[tuple[str, str]]
    parent: list[int]
    path: list[int]
    #: element, text, characters of it in links; a block's edge is a node of a blank
    nodes: list[tuple[int, str, bool]]


def parse(page: str) -> Page:
    """Elements and text nodes, in time linear in the length, whatever is left unclosed."""
    tags, names, parents, paths = ["#page"], [("", "")], [-1], [0]
    known: dict[tuple[int, str], int] = {}
    nodes: list[tuple[int, str, bool]] = []
    stack, opened = [0], Counter()
    link = 0  # depth of the stack where a link was opened
    at, quoted = 0, True

    def pop() -> None:
        nonlocal link
        opened[tags[stack.pop()]] -= 1
        if link > len(stack):
            link = 0

    def text(a: int, b: int) -> None:
        if b > a:
            nodes.append((stack[-1], html.unescape(page[a:b]), link > 0))

    seek = 0
    while True:
        start = page.find("<", seek)
        if start < 0:
            break
        if page.startswith("<!--", start):
            text(at, start)
            end = page.find("-->", start + 4)
            at = seek = len(page) if end < 0 else end + 3
            continue
        match = OPENING.match(page, start)
        other = page.startswith(("<!", "<?"), start)
        if not match and not other:
            seek = start + 1
            continue
        end = -1
        if match and quoted:
            end = REST.match(page, match.end()).end()
            if end == len(page):  # a quote swallowed the rest: from here on quotes don't count
                quoted, end = False, -1
        if end < 0:
            end = page.find(">", start)
        if end < 0:
            break
        text(at, start)
        at = seek = end + 1
        if other:
            continue
        tag = match.group(1).lower()
        closing = page[start + 1] == "/"
        if tag in RAW and not closing:
            found = RAW[tag].search(page, at)
            at = seek = found.end() if found else len(page)
            continue
        if tag == "a":
            link = 0 if closing else len(stack)
        if tag in INLINE:
            continue
        nodes.append((stack[-1], " ", False))
        if closing:
            if opened[tag]:
                while tags[stack[-1]] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tags[stack[-1]] == "p":
            pop()
        while tags[stack[-1]] in ENDS.get(tag, ()):
            pop()
        own, role = [], ""
        for m in ATTRIBUTE.finditer(page, match.end(), end):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if m.group(1).lower() == "role":
                role = value.strip().lower()
            else:
                own.append(value)
        label = f"{tag}.{' '.join(own)}"
        parents.append(stack[-1])
        paths.append(known.setdefault((paths[stack[-1]], label), len(known) + 1))
        stack.append(len(tags))
        tags.append(tag)
        names.append((" ".join(own), role))
        opened[tag] += 1
        if page[end - 1] == "/" and tag in ("svg", "math"):
            pop()
    text(at, len(page))
    return Page(tags, names, parents, paths, nodes)


def names_place(name: str) -> bool:
    """Whether a class or id names a place outside the article, by the last word that isn't merely descriptive."""
    words = [w.lower() for w in WORDS.findall(name.split("--")[0])]
    if not words or MODIFIERS & set(words):
        return False
    if tuple(words[-2:]) in SITE_HEADERS:
        return True
    while len(words) > 1 and (words[-1].isdigit() or words[-1] == "x" or words[-1] in FOLLOWING):
        words.pop()
    return words[-1] in PLACES


def apart(page: Page) -> list[bool]:
    """For every element whether it lies in a place that isn't part of the article."""
    many = len(page.tag)
    body = [t == "main" or r == "main" for t, (_, r) in zip(page.tag, page.names)]
    named = [
        t not in ("#page", "html", "body", "main") and (r in APART_ROLES or any(map(names_place, n.split())))
        for t, (n, r) in zip(page.tag, page.names)
    ]
    story = [int((t == "article" or r == "article") and not x) for t, (_, r), x in zip(page.tag, page.names, named)]
    heading = [t == "h1" for t in page.tag]
    within = [False] * many
    for e in range(1, many):
        within[e] = within[page.parent[e]] or body[e] or story[e] > 0
    own = story.copy()
    for e in range(many - 1, 0, -1):
        up = page.parent[e]
        story[up] += story[e]
        body[up] = body[up] or body[e]
        heading[up] = heading[up] or heading[e]
    total = story[0]
    out = [False] * many
    for e in range(1, many):
        tag = page.tag[e]
        cut = named[e] or tag in APART or (tag == "header" and not within[e])
        if cut and (body[e] or (total > own[e] and story[e] == total) or (total and own[e] == total)):
            cut = False
        if cut and tag == "form" and heading[e] and not named[e]:
            cut = False  # a form around the whole page
        out[e] = out[page.parent[e]] or cut
    return out


def path_scores(page: Page, left_out: list[bool]) -> dict[int, float]:
    """The fused, smoothed ratios of every tag path that has text."""
    sums: dict[int, list[float]] = {}
    above: dict[int, int] = {}
    last = None
    for e, text, link in page.nodes:
        bare = text.strip()
        if left_out[e] or not bare:
            last = None if not bare else last
            continue
        path = page.path[e]
        found = sums.setdefault(path, [0, 0, 0])
        above[path] = page.path[page.parent[e]] if page.parent[e] >= 0 else -1
        found[0] += 0 if link else len(bare)
        found[1] += 0 if link else len(PUNCTUATION.findall(bare))
        found[2] += last != e  # the parts of a block around inline elements are one node
        last = e
    if not sums:
        return {}
    order = list(sums)
    values = np.array([sums[p] for p in order])
    ratios = np.minimum(values[:, :2] / values[:, 2:], (LONG, MARKS))
    smooth, weight = ratios.copy(), np.ones(len(order))
    up = np.array([above[p] for p in order])
    at = np.array(order)
    for step in (1, 2):
        if step < len(order):
            near = (up[step:] == up[:-step]) | (up[step:] == at[:-step]) | (at[step:] == up[:-step])
            w = np.exp(-0.5 * (2 * step) ** 2) * np.where(near, 1, ELSEWHERE)
            smooth[step:] += w[:, None] * ratios[:-step]
            smooth[:-step] += w[:, None] * ratios[step:]
            weight[step:] += w
            weight[:-step] += w
    smooth /= weight[:, None]
    fused = np.log1p(smooth[:, 0]) * (0.5 + np.log1p(smooth[:, 1]))
    fused[values[:, 0] == 0] = 0  # all of it in links
    return dict(zip(order, fused.tolist()))


def main_text(page: str) -> str:
    """The article's text with single blanks; empty if there is none."""
    tree = parse(page)
    left_out = apart(tree)
    score = path_scores(tree, left_out)
    best = max(score.values(), default=0)
    if best <= 0:
        return ""
    chosen = {p for p, s in score.items() if s >= SHARE * best}
    many = len(tree.tag)
    nodes = [(e, text, link) for e, text, link in tree.nodes if not left_out[e]]
    solid = [bool(text.strip()) for _, text, _ in nodes]
    picked = [ok and tree.path[e] in chosen for (e, _, _), ok in zip(nodes, solid)]

    # below every element: selected nodes, characters, characters in links, links
    hits, chars, linked, links = ([0] * many for _ in range(4))
    for (e, text, link), ok, pick in zip(nodes, solid, picked):
        if ok:
            size = len(text.strip())
            hits[e] += pick
            chars[e] += size
            linked[e] += size * link
            links[e] += link
    flows = [0] * many  # children of running text with text outside links
    for e in range(many - 1, 0, -1):
        up = tree.parent[e]
        hits[up] += hits[e]
        chars[up] += chars[e]
        linked[up] += linked[e]
        links[up] += links[e]
        flows[up] += tree.tag[e] in FOLLOWING_TEXT and chars[e] > linked[e]
    menu = [links[e] >= 3 and linked[e] >= 0.8 * chars[e] and not hits[e] for e in range(many)]

    root = max(e for e in range(many) if hits[e] == hits[0])
    root = lifted(tree, root, flows)
    whole = tree.tag[root] not in ("#page", "html", "body")
    semantic = is_story(tree, root)
    # the child of the root that every element lies in, and whether it lies in a list of links
    unit, listed = [-1] * many, [False] * many
    for e in range(1, many):
        up = tree.parent[e]
        unit[e] = e if up == root else unit[up]
        listed[e] = not semantic and (menu[e] or listed[up]) and e != root
    if semantic:
        listed = [False] * many
    inside = lambda e: e == root or unit[e] >= 0
    kept = [inside(e) and not listed[e] for e, _, _ in nodes]
    at = [i for i, ok in enumerate(picked) if ok]
    if not whole:
        first, last = at[0], at[-1]
        while first > 0 and (not solid[first - 1] or beside(tree, nodes[first - 1][0], unit, unit[nodes[first][0]], listed)):
            first -= 1
        while last + 1 < len(nodes) and (not solid[last + 1] or beside(tree, nodes[last + 1][0], unit, unit[nodes[last][0]], listed)):
            last += 1
        kept = [ok and first <= i <= last for i, ok in enumerate(kept)]
    begin = kept.index(True)
    if not any(ok and tree.tag[e] == "h1" for (e, _, _), ok in zip(nodes, kept)):
        title = next((i for i in range(begin - 1, -1, -1) if solid[i] and tree.tag[nodes[i][0]] == "h1"), None)
        if title is not None:
            heading = nodes[title][0]
            for i in range(begin):
                e = nodes[i][0]
                kept[i] = kept[i] or e == heading or (i > title and tree.tag[e] in HEADINGS)
    # the characters of a node that is left out leave an edge behind
    return " ".join("".join(text if ok else " " for (_, text, _), ok in zip(nodes, kept)).split())


#: children that show that the text around them runs on
FOLLOWING_TEXT = HEADINGS | {"p", "blockquote"}


def is_story(page: Page, e: int) -> bool:
    return page.tag[e] in ("article", "main") or page.names[e][1] in ("article", "main")


def lifted(page: Page, root: int, flows: list[int]) -> int:
    """The article or main element around ``root``, else the highest parent in a row that has running text beside it."""
    around = root
    while around > 0:
        if is_story(page, around):
            return around
        around = page.parent[around]
    while root > 0 and (page.tag[root] in FLOW or flows[page.parent[root]] > 0):
        root = page.parent[root]
    return root


def beside(page: Page, e: int, unit: list[int], neighbour: int, listed: list[bool]) -> bool:
    """Whether the text of an element runs on from the selected child next to it: one child, or running text."""
    own = unit[e]
    return own == neighbour or (not listed[e] and (own < 0 or page.tag[own] in FLOW))


def extract(df: DataFrame, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``df``: key, url, ``text`` and ``n_chars``, its code points.

    Null and empty pages, and pages without text outside links, give an empty
    text. Repeated rows give repeated results; of equal scores all are selected;
    other columns are not looked at, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(t or "") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["k", "u", "text", "n_chars"],
                )

    kinds = (df.schema[c].dataType.simpleString() for c in (key, url))
    rows = map_arrow(
        df.select(F.col(key), F.col(url), F.col(page)), run, "k {}, u {}, text string, n_chars long".format(*kinds)
    )
    return rows.withColumnsRenamed({"k": key, "u": url})
