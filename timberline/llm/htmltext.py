"""Main text of a page by tag-path ratios.

Every text node has a path of tags from the root to its leaf. For each path the text length and the punctuation of its
nodes, and the number of its nodes, are summed over the page. The two ratios (length and punctuation per node) are
smoothed over neighbouring paths in page order, fused by their product, and a path is content if its fused ratio reaches
a share of the page's deviation. Nodes in content paths form the text. Of the rest, blocks between content, inside the
container that holds most of it, go with it, unless most of the block is link text; so do headings, lists, tables, quotes,
captions and code at the container's ends, and a lead under its heading. Of equal containers an article or main element
counts first.

Elements that never hold main text (scripts, styles, navigation, headers, footers, asides, forms, and containers whose
class or id names an advert, notice, sidebar, menu or comments) are left out before the ratios are taken. A class or id
counts as a whole, and inside an article or main element it only gives its blocks paths of their own, which the ratio
judges. Comments, notices and adverts named so inside an article, and articles inside it, as comments are marked up, are left
out by their place and size: where they are less than the story, or nothing of the story follows them. If nothing else is
left, names are ignored. An svg, iframe, object, select, noscript or template that isn't closed
ends with its parent.

Defined results: null or empty html, or html without content, gives an empty text. Ids and urls pass through as they are,
nulls too; extra columns are ignored; repeated rows are extracted each. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
#: Elements left out whole; one without an end tag ends with its parent.
HOLES = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)(noscript|template|select|svg|iframe|object)\b((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form head button label menu dialog noscript template select svg iframe object".split())
OUTSIDE_ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog|menu)", re.I)
NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent notice notices popup modal "
    "newsletter subscribe sidebar side menu nav navbar navigation breadcrumb breadcrumbs pager pagination header masthead footer comment "
    "comments reply replies respond share sharing social related recommended widget toolbar login search disclaimer copyright legal".split()
)
#: Of these, names of what is left out inside an article, too, if its place or size agrees.
INSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo banner cookie cookies consent notice notices popup modal newsletter subscribe comment comments reply replies respond".split()
)
#: Words that a name may have besides: ``site-footer`` names a footer, ``has-sidebar`` or ``related-work`` nothing.
BESIDE_NAMES = frozenset("site main top bottom left right primary secondary list box bar links buttons form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are text by what they mean, also at a story's ends.
MEANT = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption section hgroup details summary".split())
#: Tags whose opening closes an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、]")
SPACE = re.compile(r"\s+")


def _named(attributes: str, known: frozenset[str] = OUTSIDE_NAMES) -> bool:
    """Whether a class or an id, as a whole, is a name of what never holds main text."""
    for values in NAMES.findall(attributes):
        for name in "".join(values).lower().split():
            words = [w for w in re.split("[-_]+", name) if w]
            if any(w in known for w in words) and all(w in OUTSIDE_NAMES or w in BESIDE_NAMES for w in words):
                return True
    return False


def _holes(page: str) -> dict[int, int]:
    """Where each closed hole begins -> where it ends."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = defaultdict(list)
    for m in HOLES.finditer(page):
        tag = (m[3] or "").lower()
        if tag and m[2]:
            if open_[tag]:
                ends[open_[tag].pop()] = m.end()
        elif tag and not m[4].rstrip().endswith("/"):
            open_[tag].append(m.start())
    return ends


def blocks_of(page: str, names: bool = True) -> list[tuple[tuple[str, ...], str, float]]:
    """(tag path, text, share of link text) of the blocks outside the elements that never hold main text, in page order.

    A tag whose name would leave it out, but which stands in an article or main element, has ``!`` behind it in paths (``!!``
    for ``INSIDE_NAMES``); articles are numbered.
    """
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, bool, str]] = []  # (tag, whether it is outside, tag in paths)
    outside = links = homes = articles = 0
    parts: list[str] = []
    linked: list[int] = []
    holes = _holes(page)

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            text = SPACE.sub(" ", html.unescape(raw)).strip()
            if text:
                first = next((k for k, x in enumerate(stack) if x[1]), len(stack)) if outside else len(stack)
                out.append((tuple(x[2] for x in stack[:first] if x[0] in BLOCKS), text, sum(linked) / len(raw)))
            parts.clear()
            linked.clear()

    def pop_to(depth: int) -> None:
        nonlocal outside, links, homes
        if outside and not all(x[1] for x in stack[depth:][:1]) and any(x[1] for x in stack[depth:]):
            flush()  # an open hole ends with its parent
        while len(stack) > depth:
            tag, away, _ = stack.pop()
            outside -= away
            links -= tag == "a"
            homes -= tag in ("article", "main")

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        raw, closing, tag, attributes, text = m.groups()
        if text is not None:
            if not outside:
                parts.append(text)
                linked.append(len(text) if links else 0)
            continue
        if tag is None:
            if raw:  # a script or the like is a break inside its block
                parts.append(" ") if parts else None
            continue
        tag = tag.lower()
        if not closing and m.start() in holes:
            at = holes[m.start()]
            parts.append(" ") if parts else None
            continue
        block = tag in BLOCKS
        if block and not outside:
            flush()
        elif tag == "br" and parts:
            parts.append(" ")
        if closing:
            # Closes the nearest open element of that name; an inline end tag doesn't reach out of its block.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if not block and stack[k][0] in BLOCKS:
                    break
            continue
        if tag in VOID:
            continue
        if block:
            # Inline elements left open end with the block they are in.
            ends = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] != "p":
                    break
                if stack[k][0] == "p":
                    pop_to(k)
                    break
        if not attributes.rstrip().endswith("/") or block:
            away, label = False, tag
            if tag == "article":  # each has paths of its own, so that cards beside a story don't share its ratio
                articles += 1
                label = f"article~{articles}"
            if not outside:
                away = tag in OUTSIDE or bool(attributes and tag not in ("html", "body", "article", "main") and OUTSIDE_ROLES.search(attributes))
                if not away and names and attributes and tag not in ("html", "body", "article", "main") and _named(attributes):
                    away, label = not homes, label + ("!!" if _named(attributes, INSIDE_NAMES) else "!")
            if away and parts:
                flush() if block else parts.append(" ")
            stack.append((tag, away, label))
            outside += away
            links += tag == "a"
            homes += tag in ("article", "main")
    flush()
    return out


def _is_home(label: str) -> bool:
    return label == "main" or label.startswith("article~")


def _is_said(path: tuple[str, ...]) -> bool:
    """Whether a path leads through comments, notices or adverts inside an article."""
    return any(t.endswith("!!") for t in path)


def _is_foreign(path: tuple[str, ...], story: tuple[str, ...]) -> bool:
    """Whether a path inside the story leads through those, or through an article of its own inside an article."""
    rest = path[len(story) :] if path[: len(story)] == story else ()
    return _is_said(rest) or bool(story) and story[-1].startswith("article~") and any(t.startswith("article~") for t in rest)


def main_text(page: str | None, threshold: float = 0.5) -> str:
    if not page:
        return ""
    blocks = blocks_of(page) or blocks_of(page, names=False)
    if not blocks:
        return ""
    size: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for path, text, _ in blocks:
        s = size[path]
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    paths = list(size)  # in the order of their first block
    length, punctuation, nodes = (np.array([size[p][k] for p in paths], float) for k in range(3))
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: x if len(x) < 3 else np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")
    fused = (length / nodes + smooth(length / nodes)) / 2 * (1 + (punctuation / nodes + smooth(punctuation / nodes)) / 2)
    # The best path is always content, since the threshold never exceeds the largest value.
    chosen = {p for p, x in zip(paths, fused) if x >= min(threshold * fused.std(), fused.max())}
    # The container that holds most content text; an article or main element decides between equal ones.
    weight: dict[tuple[str, ...], int] = defaultdict(int)
    for path, text, _ in blocks:
        if path in chosen:
            weight[path[:-1]] += len(text)
    own = [p for p in weight if not _is_said(p)] or list(weight)
    top = max(own, key=lambda p: (weight[p], any(_is_home(t) for t in p), -len(p)))
    home = next((top[: k + 1] for k, t in enumerate(top) if _is_home(t)), top)
    story = next((top[: k + 1] for k in range(len(top) - 1, -1, -1) if _is_home(top[k])), top)
    kept = [path in chosen for path, _, _ in blocks]
    mine = [k for k, (path, _, _) in enumerate(blocks) if path[: len(home)] == home]
    content = [k for k in mine if kept[k] and not _is_foreign(blocks[k][0], story)] or [k for k in mine if kept[k]]
    within = lambda path: path[: len(story)] == story
    first_heading = next((k for k in mine if within(blocks[k][0]) and blocks[k][0][-1:] and blocks[k][0][-1] in HEADINGS), len(blocks))
    for k in mine:
        path, _, linked = blocks[k]
        if linked >= 0.5 or any(t.endswith("!") for t in path):
            continue
        inside = within(path)
        meant = inside and len(path) > len(story) and all(t in MEANT for t in path[len(story) :])
        lead = inside and first_heading < k < content[0]
        if content[0] < k < content[-1] and not _is_foreign(path, story) or meant or lead:
            kept[k] = True
    # What others say inside the article: less than the story, or behind its end.
    foreign = [k for k in mine if kept[k] and _is_foreign(blocks[k][0], story)]
    plain = [k for k in mine if kept[k] and not _is_foreign(blocks[k][0], story)]
    if plain and foreign:
        told = lambda ks: sum(len(blocks[k][1]) for k in ks)
        small = told(foreign) < told(plain)
        for k in foreign:
            kept[k] = kept[k] and not small and k < plain[-1]
    # A heading goes with what it stands before.
    for k in reversed(mine):
        path = blocks[k][0]
        if path[-1:] and path[-1] in HEADINGS and not any(t.endswith("!") for t in path) and not _is_foreign(path, story) and k + 1 < len(blocks) and kept[k + 1]:
            kept[k] = True
    return "\n\n".join(text for (_, text, _), yes in zip(blocks, kept) if yes)


def _extracted(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    pages = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return pages.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
