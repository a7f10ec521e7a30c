"""Main text of web pages by tree scoring.

A page becomes a tree of elements and text blocks. What is never article (scripts, styles,
menus, forms, site headers and footers, sidebars, notices, adverts, reader comments, by tag,
role or name) is left out. Within article and main, names of notices and of the like don't
count, and paragraphs, headings and list items are spared whatever their names. Each paragraph,
which is a block of text, passes points to the elements above it: one, one for each comma and one
for each hundred characters, in full to the nearest container, by half to the next and by less
further up, discounted by the share of its characters that stand in links. The container with
most points, again discounted by its link share, and tripled for article and main, is kept, and
with it those of its siblings that have a fifth of its points or are paragraphs of prose
themselves. All their blocks are returned, none is shortened.

White space in a block becomes one space (a line break counts as such), blocks are joined by
one newline in page order, character references are decoded. A null or empty page, or one
without text, gives the empty string. Repeated rows give the same text each. Unclosed and
crossing tags, however deep, are handled without recursion and in time in proportion to the
page. Memory: one page and one Arrow
batch. Other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag from its name on; a further < outside quotes ends the attempt, so no attempt is long.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title noembed noframes xmp".split())
DROP = RAW | frozenset("head nav footer aside form button select option dialog menu datalist fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table body html article section main div".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|sidebar|side|rail|aside|ads?|adv|adverts?|advertisements?|advertising|banner|promos?|sponsor(?:ed|s)?|cookies?|consent|notices?|gdpr|privacy|popup|modal|overlay|alert|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|discussion|disqus|respond|replies|reply|related|recommended|widgets?|pagination|pager|toolbar|skip|copyright|legal)(?:$|[\s_-])",
    re.I,
)
#: Names that count within article and main, too.
STRICT = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|ads?|adv|adverts?|advertisements?|advertising|promos?|sponsor(?:ed|s)?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|disqus|respond|replies|related|recommended|pagination|pager|toolbar)(?:$|[\s_-])", re.I)
SPARED = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
DECAY = (1, 2, 3, 6, 9, 12, 15)
BONUS = 3
NO_CONTAINER = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 pre li td dd blockquote".split())


class Tree:
    """Elements by number: parent, own tag; blocks: (element, text, linked characters)."""

    def __init__(self, page: str):
        self.parent, self.tag, self.blocks = [-1], ["#"], []
        self.parse(page)

    def parse(self, page: str) -> None:
        stack, parent, tags = [0], self.parent, self.tag
        text: list[str] = []
        linked = inside = drop = at = 0  # inside: open links; drop: depth of the stack under what is left out

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                if joined:
                    self.blocks.append((stack[-1] if not drop else 0, joined, min(linked, len(joined))))
                text.clear()
            linked = 0

        def pop(to: int) -> None:
            nonlocal inside, drop
            while len(stack) > to:
                t = tags[stack.pop()]
                held[t] -= 1
                inside -= t == "a"
            if drop and len(stack) < drop:
                drop = 0

        def push(name: str) -> None:
            parent.append(stack[-1])
            stack.append(len(tags))
            tags.append(name)
            held[name] = held.get(name, 0) + 1

        def say(s: str) -> None:
            nonlocal linked
            if s and not drop:
                text.append(s)
                if inside > 0:
                    linked += len(s.strip())

        n = len(page)
        held: dict[str, int] = {}  # open elements by name
        never: set[str] = set()  # names that have no further end tag
        while at < n:
            start = page.find("<", at)
            if start < 0:
                say(page[at:])
                break
            m = TAG.match(page, start)
            if not m:
                if page[start + 1 : start + 2] in ("!", "?", "/"):
                    say(page[at:start])
                    if page.startswith("<!--", start):
                        end = page.find("-->", start + 2)
                        at = end + 3 if end >= 0 else n
                    else:
                        end = page.find(">", start)
                        at = end + 1 if end >= 0 else n
                else:
                    say(page[at : start + 1])
                    at = start + 1
                continue
            say(page[at:start])
            at, name = m.end(), m[2].lower()
            if m[1]:
                if name in INLINE:
                    if name == "a" and inside > 0:
                        for k in range(len(stack) - 1, 0, -1):
                            if tags[stack[k]] == "a":
                                pop(k)
                                break
                    elif tags[stack[-1]] == name and len(stack) > 1:
                        pop(len(stack) - 1)  # only those left out stand on the stack
                    continue
                for k in range(len(stack) - 1, 0, -1) if held.get(name) else ():
                    if tags[stack[k]] == name:
                        flush()
                        pop(k)
                        break
                continue
            if name in RAW:
                if name in ("svg", "math") and m[3].rstrip().endswith("/"):
                    continue
                end = None if name in never else ENDS[name].search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style", "title", "textarea", "noscript", "xmp"):
                    at = n  # the rest of the page is its content
                else:
                    never.add(name)
                if name not in ("svg", "math"):
                    say(" ")
                continue
            if name == "br":
                say(" ")
                continue
            if name in INLINE:
                if name == "a" and not drop:
                    push("a")
                    inside += 1
                elif not drop and m[3] and self.left_out(name, m[3], bool(held.get("article") or held.get("main"))):
                    push(name)
                    drop = len(stack)
                continue
            flush()
            if name in CLOSES_P and held.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        pop(k)
                        break
                    if tags[stack[k]] not in INLINE:
                        break
            for k in range(len(stack) - 1, 0, -1) if name in SAME and any(held.get(t) for t in SAME[name]) else ():
                if tags[stack[k]] in SAME[name]:
                    pop(k)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                elif tags[stack[k]] in SCOPE or k < len(stack) - 64:
                    break  # what is that far up isn't closed by an omitted end tag
            if name in VOID or m[3].endswith("/") and name in ("path", "use"):
                continue
            within = bool(held.get("article") or held.get("main"))
            push(name)
            if not drop and self.left_out(name, m[3], within):
                drop = len(stack)
        flush()

    def left_out(self, name: str, attrs: str, within: bool) -> bool:
        """Whether an element goes; within: it stands in article or main."""
        if name in DROP:
            return True
        if name == "header":
            return not within
        if not attrs or name in ("body", "html", "article", "main"):
            return False
        for key, *values in ATTR.findall(attrs):
            value, key = next((v for v in values if v), ""), key.lower()
            named = key in ("class", "id") and not (within and name in SPARED) and (STRICT if within else NAMES).search(value)
            if named or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
        return False


def main_text(page: str | None) -> str:
    tree = Tree(page or "")
    parent, tags = tree.parent, tree.tag
    if not tree.blocks:
        return ""
    n = len(tags)
    points, chars, links, prose = [0.0] * n, [0] * n, [0] * n, [False] * n
    rising: list[list[float] | None] = [None] * n  # scores on their way up, by the containers passed
    for node, text, linked in tree.blocks:
        density = linked / len(text)
        score = (1 + text.count(",") + text.count("、") + text.count("，") + len(text) / 100) * (1 - density)
        chars[node] += len(text)
        links[node] += linked
        prose[node] |= density < 0.25 and len(text) > 80
        own = rising[node] = rising[node] or [0.0] * len(DECAY)
        own[0] += score
    for k in range(n - 1, -1, -1):  # parents have lower numbers
        own, up = rising[k], parent[k]
        if own:
            first = 0 if tags[k] not in NO_CONTAINER else 1
            points[k] = sum(own[i] / DECAY[i] for i in range(first, len(DECAY)))
            if up >= 0:
                above = rising[up] = rising[up] or [0.0] * len(DECAY)
                if first:
                    above[0] += own[0]
                for i in range(first, len(DECAY)):
                    above[min(i + 1, len(DECAY) - 1)] += own[i]
            rising[k] = None
        if up >= 0:
            chars[up] += chars[k]
            links[up] += links[k]
            prose[up] |= prose[k]
    final = [(BONUS if tags[k] in ("article", "main") else 1) * p * (1 - links[k] / chars[k]) if chars[k] else 0.0 for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (final[k], -k))
    if not final[best]:
        return ""
    kept = {best}
    for k in range(1, len(tags)):
        if parent[k] == parent[best] and k != best and chars[k]:
            if final[k] >= 0.2 * final[best] or tags[k] == "p" and prose[k] and links[k] < 0.25 * chars[k]:
                kept.add(k)
    within: dict[int, bool] = {-1: False}

    def inside(k: int) -> bool:
        path = []
        while k not in within and k not in kept:
            path.append(k)
            k = parent[k]
        got = k in kept or within[k]
        within.update(dict.fromkeys(path, got))
        return got

    return "\n".join(b[1] for b in tree.blocks if inside(b[0]))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (its code points) in place of any
    columns of these names."""
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html_col).cast("string").alias("__html")).mapInArrow(run, f"{kinds}{', ' * bool(rest)}text string, n_chars long")
