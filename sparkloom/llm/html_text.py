"""Main-text extraction by minimum-cut labelling of a page's text blocks.

A page is cut in blocks at block-level tags. A logistic classifier scores each block; the two costs of its labels
(content, boilerplate) are the terminal capacities, of which only the difference, the classifier's log odds, matters for the
cut. Blocks that follow each other and blocks near each other in the DOM are joined by smoothness edges. The minimum cut
separates content from boilerplate. A block whose log odds outweigh all its edges has the same label in every minimum cut, so
such blocks are settled first, again and again; maximum flow runs on what is left.

The log odds have two parts. PRIOR is what an element says about its kind (a menu, an article, ...). The other part is learned from the
texts of the blocks: words, links, punctuation. As pages have no labels, the blocks in articles and those in menus, notices and the
like are the labelled ones, on at most about FIT_PAGES pages, and what has neither is judged by what they have in common.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose text is never shown or never prose.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video select textarea button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""html head body main article section nav header footer aside form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
table thead tbody tfoot tr caption blockquote pre figure figcaption address details summary hr center dialog menu""".split())  # fmt: skip
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new element of the kind ends.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "p"}} | {t: {"p"} for t in BLOCK - {"p", "li", "dt", "dd", "tr"}}
#: Beyond these an implied end doesn't reach.
SCOPE = frozenset("ul ol dl table article section nav header footer aside form div main body blockquote".split())
BAD_TAGS = frozenset("nav footer aside form dialog menu head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
BAD_NAMES = frozenset("""nav navbar navigation menu submenu footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor
sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing comment
comments disqus reply replies respond discussion related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer form search skip""".split())  # fmt: skip
#: Bad only outside an article.
OUTER_TAGS, OUTER_NAMES = frozenset(["header"]), frozenset(["header", "masthead", "topbar", "hero"])
GOOD_NAMES = frozenset("article content post entry story main body text prose".split())
#: Log odds by the kind of element around a block.
PRIOR = {"bad": -5.0, "outer": -3.0, "article": 2.0, "good": 1.0}
#: Weights of a block's features where a table has too few labelled blocks to learn from: bias, words by ten, links, end of a sentence, list item, heading.
DEFAULT = (-1.0, 0.9, -5.0, 0.8, -1.5, 0.5)
#: What the learned part says at most, for either side.
MOST = 3.0
#: Pages that the classifier is fitted on, about.
FIT_PAGES = 2000
NEXT_SAME, NEXT_OTHER, SIBLING = 1.0, 0.3, 0.5


class Block:
    __slots__ = ("text", "bad", "outer", "article", "good", "tag", "link", "parent")

    def __init__(self, text: str, state: tuple, tag: str, link: int, parent: int):
        self.text, self.tag, self.link, self.parent = text, tag, link, parent
        self.bad, self.outer, self.article, self.good = state


def _state(above: tuple, tag: str, attributes: str) -> tuple:
    """(bad, outer, article, good) of an element in one with the state above."""
    bad, outer, article, good = above
    names: set[str] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names.update(w.lower() for w in _WORDS.findall(value))
            elif key == "role":
                bad = bad or value.strip().lower() in BAD_ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad = True
    if tag in ("body", "html"):
        return bad, outer, article, good
    bad = bad or tag in BAD_TAGS or not names.isdisjoint(BAD_NAMES)
    if tag in ("article", "main") and not bad:
        article, outer = True, False
    if not article:
        outer = outer or tag in OUTER_TAGS or not names.isdisjoint(OUTER_NAMES)
    return bad, outer, article, good or not names.isdisjoint(GOOD_NAMES)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, tuple, int]] = [("", (False, False, False, False), 0)]
    pieces: list[str] = []
    link = links = 0  # characters in links of this block; open links
    opened: Counter = Counter()  # open elements by tag
    count = at = 0

    def close(k: int) -> None:
        """End the elements from k on."""
        opened.subtract(tag for tag, _, _ in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag, state, node = stack[-1]
                found.append(Block(text, state, tag, link, node))
            pieces.clear()
        link = 0

    def say(raw: str) -> None:
        nonlocal link
        if "&" in raw:
            raw = html.unescape(raw)
        pieces.append(raw)
        if links:
            link += len(raw)

    low = None
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        ends = (m[1] or m[4]) == "/"
        if tag in RAW:
            if not ends and not (m[3] or m[6] or "").endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != n:  # lower() of a few characters is longer
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else n
                else:
                    end = low.find(f"</{tag}", at)
                    stop = page.find(">", end) if end >= 0 else -1
                    at = stop + 1 if stop >= 0 else n
        elif tag == "a":
            links = 0 if ends else 1
        elif tag in ("br", "td", "th"):
            pieces.append(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            if ends:
                if opened[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            else:
                ended = CLOSES[tag]
                for k in range(len(stack) - 1 if any(opened[t] for t in ended) else 0, 0, -1):
                    if stack[k][0] in ended:
                        close(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
                if tag not in VOID:
                    count += 1
                    opened[tag] += 1
                    stack.append((tag, _state(stack[-1][1], tag, m[3] or m[6] or ""), count))
    flush()
    # DOM proximity is between blocks that are children of one element.
    return found


def features(b: Block) -> tuple[float, ...]:
    words = b.text.count(" ") + 1
    return 1.0, min(words, 50) / 10, min(1.0, b.link / len(b.text)), float(b.text[-1] in ".!?:;\u3002\u2026\"\u201d"), float(b.tag in ("li", "td")), float(b.tag in HEADING)


def log_odds(b: Block, weights: tuple[float, ...] = DEFAULT) -> float:
    learned = sum(w * x for w, x in zip(weights, features(b)))
    kind = PRIOR["bad"] if b.bad else PRIOR["outer"] * b.outer + PRIOR["article"] * b.article + PRIOR["good"] * b.good
    return kind + max(-MOST, min(MOST, learned))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, both classes weighing the same, by Newton steps."""
    each = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * (y - p)) - ridge * w
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> tuple[float, ...]:
    """The weights, learned from the blocks of about fit_pages pages, chosen by a hash; DEFAULT where either class has under 50 blocks."""
    n = pages.count()
    share = 1_000_000 if n <= fit_pages else round(1_000_000 * fit_pages / n)
    chosen = pages.select(F.col(html_col).alias("html")).where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            count: Counter = Counter()
            for page in batch.column(0):
                for b in blocks(page.as_py() or ""):
                    if b.bad or b.article:
                        # Links in tenths, so that equal rows are counted together.
                        x = features(b)
                        count[(round(10 * x[1]), round(10 * x[2]), int(x[3]), int(x[4]), int(x[5]), int(not b.bad))] += 1
            yield {c: pa.array([k[i] for k in count], pa.int32()) for i, c in enumerate("abcdey")} | {"n": pa.array(list(count.values()), pa.int64())}

    counted = map_arrow(chosen, step, "a int, b int, c int, d int, e int, y int, n bigint", ["html"]).groupBy(*"abcdey").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in counted.collect())  # at most 50 x 11 x 2 x 2 x 2 x 2
    for y in (0, 1):
        if sum(r[6] for r in rows if r[5] == y) < 50:
            return DEFAULT
    got = np.array(rows, float)
    x = np.column_stack((np.ones(len(got)), got[:, 0] / 10, got[:, 1] / 10, got[:, 2:5]))
    weight = np.repeat(np.arange(len(got)), np.maximum(1, np.round(got[:, 6] * min(1.0, 20_000 / got[:, 6].sum()))).astype(int))
    return tuple(float(v) for v in logistic(x[weight], got[weight, 5]))


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: |odds| for a label against its sign, an edge's weight where labels differ."""
    n = len(odds)
    z = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) > sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                z[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        for i, side in zip(rest, _flow_cut([z[i] for i in rest], [[(place[j], w) for j, w in near[i].items()] for i in rest])):
            label[i] = side
    return [bool(x) for x in label]


def _flow_cut(z: list[float], near: list[list[tuple[int, float]]]) -> list[bool]:
    """Maximum flow by blocking flows from the source (content) to the sink (boilerplate); whom the source still reaches is content."""
    n = len(z)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [dict(x) for x in near] + [{}, {}]
    for i, x in enumerate(z):
        if x > 0:
            room[source][i] = x
            room[i].setdefault(source, 0.0)
        elif x < 0:
            room[i][sink] = -x
            room[sink].setdefault(i, 0.0)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return [i in level for i in range(n)]
        # A blocking flow: each node tries its edges once, from where it stopped.
        trials = {i: iter([j for j in room[i] if level.get(j) == level[i] + 1]) for i in level}
        held: dict[int, int | None] = {}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                first = None
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                    if first is None and room[a][b] <= 1e-9:
                        first = k
                del path[first + 1 :]  # back to where the path is full
                continue
            j = held.get(i)
            if j is None or room[i][j] <= 1e-9:
                j = held[i] = next((x for x in trials[i] if room[i][x] > 1e-9), None)
            if j is not None:
                path.append(j)
                continue
            path.pop()
            if path:
                held[path[-1]] = None  # a dead end: its next rival is tried


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            out.append((i - 1, i, NEXT_SAME if (a.bad, a.outer, a.article) == (b.bad, b.outer, b.article) else NEXT_OTHER))
        if b.parent in last and last[b.parent] < i - 1:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def main_text(page: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    """The main text: its blocks in page order, joined by a newline."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, min_cut([log_odds(b, weights) for b in found], edges_of(found))) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages. weights: those of fit, which is called where they are not given.

    Defined cases: null, empty and text-free pages have empty text; broken markup is read as far as it goes, an open comment,
    tag or script hides the rest; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """

    weights = fit(pages, html_col) if weights is None else weights

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    kind = dict(pages.dtypes)[id_col]
    return map_arrow(pages, step, f"page_id {kind}, url string, text string, n_chars bigint", [id_col, url_col, html_col])
