"""Main text of web pages by the consensus of each host's pages.

Every page's containers (articles, sections, divisions, table cells, the body) are scored by the
share of the page's plain text that they hold, links not counted; of those that hold as much the
innermost is best, so a container wins over its parent only where it leaves out links and skipped parts. A
container votes for its generalised path, the tags from the root with their classes, digits left
out. Votes are summed by host and path in Spark; each host's winning path then says which containers
of a page hold its text. A page without such a container uses its own best one.

Within a container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out, by tag and by class or id: a name counts if its words are all in the list or
neutral, with one of the list; ids count for structural tags alone. A form that holds most of the text is
the page's frame and stays. A tag that never ends reaches to the next ``>``. Text is cut into blocks at
block-level tags; character references are decoded, white space becomes single spaces, blocks are
joined by one line break.

Null or empty html gives empty text. A null url counts as the host "". Rows that repeat vote each and
are each returned; a tie of votes goes to the path that sorts last. Whole pages are read; other
columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math textarea title object canvas".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body div main section td".split())
SKIP_TAGS = RAW | set("head nav menu header footer aside form button select dialog fieldset".split())
#: Words of class, id and role that mark what is not the article.
SKIP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar aside rail widget widgets comment comments discussion replies reply disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer copyright legal newsletter subscribe subscription signup login search share sharing social related recommended toolbar skip form".split()
)
#: Words that may stand beside those in one name.
NEUTRAL = set("site main left right top bottom upper lower list box block area wrap wrapper container inner outer slot bar links link item items unit".split())
#: Tags whose id counts as their class does.
STRUCTURAL = set("div section ul ol dl table td".split())
#: Tags that end an open paragraph.
CLOSES_P = BLOCKS - {"caption", "head", "html", "body", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Start tag -> open tags that it ends, and the tags that shield those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>", re.DOTALL)
#: One attribute; a quote shields ``>`` only as a value.
ATTRIBUTE = re.compile(r"[\s/]*(?:=?[^\s/>=]+|=)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?")
MARKS = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
#: Bytes of winning paths that may be sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Levels of a path, counted from the container upwards.
LEVELS = 8


def names_skipped(tag: str, marks: dict[str, str]) -> bool:
    """Whether class, role or id name a part that is not the article."""
    for kind, value in marks.items():
        if kind != "id" or tag in STRUCTURAL:
            for name in value.lower().split():
                words = set(WORD.findall(name))
                if not words.isdisjoint(SKIP_WORDS) and words <= SKIP_WORDS | NEUTRAL:
                    return True
    return False


class Page:
    """Blocks of a page and the tree of its containers, read in one pass.

    blocks: (text, innermost container or -1, whether it is a link); for each container, in the order of
    their starts: its parent, path, depth, and whether no container around it has the same path."""

    def __init__(self, page: str, forms: bool = False):
        self.blocks: list[tuple[str, int, bool]] = []
        self.parent: list[int] = []
        self.path: list[str] = []
        self.depth: list[int] = []
        self.outer: list[bool] = []
        #: Characters within forms that nothing else leaves out.
        self.in_forms = 0
        self._read(page, forms)

    def _read(self, page: str, forms: bool) -> None:
        # Open elements: tag, container, why left out (1 only as a form, 2 else), whether a link.
        stack: list[tuple[str, int, int, bool]] = []
        names: list[str] = []  # of the open block-level elements
        count: dict[str, int] = defaultdict(int)  # open elements of a tag
        taken: dict[str, int] = defaultdict(int)  # open containers of a path
        held: list[tuple[str, bool]] = []

        def flush():
            if held:
                text = " ".join(html.unescape("".join(t for t, _ in held)).split())
                if text:
                    links = sum(len(t) for t, link in held if link)
                    self.blocks.append((text, stack[-1][1] if stack else -1, 2 * links > sum(len(t) for t, _ in held)))
                held.clear()

        def close(n):
            if any(e[0] in BLOCKS for e in stack[n:]):
                flush()
            while len(stack) > n:
                tag, box, _, _ = stack.pop()
                count[tag] -= 1
                if tag in BLOCKS:
                    names.pop()
                if box >= 0 and box != (stack[-1][1] if stack else -1):
                    taken[self.path[box]] -= 1

        at, end, strict = 0, len(page), True
        while at < end:
            found = TOKEN.search(page, at)
            text = page[at : found.start() if found else end]
            if text:
                why = stack[-1][2] if stack else 0
                if not why:
                    held.append((text, bool(stack) and stack[-1][3]))
                elif why == 1:
                    self.in_forms += len(text.strip())
            if not found:
                break
            at = found.end()
            tag = found[2]
            if not tag:
                continue
            tag = tag.lower()
            stop = at
            while strict and (more := ATTRIBUTE.match(page, stop)):
                stop = more.end()
            stop = page.find(">", stop)
            if stop < 0 and strict:
                strict = False
                stop = page.find(">", at)
            if stop < 0:
                if not (stack and stack[-1][2]):
                    held.append((page[found.start() :], False))
                break
            attributes, at = page[at:stop], stop + 1
            if found[1]:
                if count[tag]:
                    close(next(n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == tag))
                elif tag == "p":
                    flush()
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    ends = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                    after = page.find(">", ends.start()) if ends else -1
                    at = after + 1 if after >= 0 else end
                continue
            ends, shields = ENDS.get(tag, (set(), set()))
            if any(count[e] for e in ends) or (tag in CLOSES_P and count["p"]):
                for n in range(len(stack) - 1, -1, -1):
                    name = stack[n][0]
                    if name in ends or (name == "p" and tag in CLOSES_P):
                        close(n)
                        if name != "p":
                            break
                    elif name in shields or (name in BLOCKS and not ends):
                        break
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                held.append((" ", False))
            if tag in VOID or attributes.endswith("/"):
                continue
            marks: dict[str, str] = {}
            for m in MARKS.finditer(attributes):
                marks.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            _, box, why, link = stack[-1] if stack else ("", -1, 0, False)
            if tag == "form" and not forms:
                why = max(why, 1)
            elif tag in SKIP_TAGS - {"form"} or (tag not in ("html", "body", "article", "main", "form") and names_skipped(tag, marks)):
                why = 2
            if tag in BLOCKS:
                names.append(".".join((tag, *sorted(set(WORD.findall(marks.get("class", "").lower()))))))
            if tag in CONTAINERS and not why:
                path = ">".join(names[-LEVELS:])
                self.parent.append(box)
                self.depth.append(self.depth[box] + 1 if box >= 0 else 0)
                self.path.append(path)
                self.outer.append(not taken[path])
                taken[path] += 1
                box = len(self.parent) - 1
            count[tag] += 1
            stack.append((tag, box, why, link or tag == "a"))
        flush()


def read(page: str) -> Page:
    out = Page(page)
    # A form around most of the text is no part of the page but its frame.
    return Page(page, forms=True) if out.in_forms > sum(len(t) for t, _, _ in out.blocks) else out


def votes(page: Page) -> dict[str, int]:
    """Points of each container path of a page: a thousand millions for all plain text, one more for each level."""
    held = [0] * len(page.parent)
    total = 0
    for text, box, link in page.blocks:
        if box >= 0 and not link:
            held[box] += len(text)
        total += 0 if link else len(text)
    for box in range(len(held) - 1, -1, -1):
        if page.parent[box] >= 0:
            held[page.parent[box]] += held[box]
    size: dict[str, int] = defaultdict(int)
    depth: dict[str, int] = {}
    for box, path in enumerate(page.path):
        if page.outer[box] and held[box]:
            size[path] += held[box]
            depth[path] = min(page.depth[box], depth.get(path, page.depth[box]))
    out = {}
    for path, n in size.items():
        # The page says itself that these hold its article.
        lift = 1.2 if path.rpartition(">")[2].partition(".")[0] in ("article", "main") else 1
        out[path] = round(1e9 * lift * n / total) + min(depth[path], 1000)
    return out


def main_text(page: Page, path: str | None) -> str:
    """Text of the blocks within the path's containers, or within those of the page's own best path."""
    within: list[bool] = []

    def mark():
        within.clear()
        for box, parent in enumerate(page.parent):
            within.append(page.path[box] == path or (parent >= 0 and within[parent]))

    mark()
    if not any(box >= 0 and within[box] for _, box, _ in page.blocks):
        own = votes(page)
        path = max(own, key=lambda p: (own[p], p)) if own else None
        mark()
    return "\n".join(t for t, box, _ in page.blocks if path is None or (box >= 0 and within[box]))


def host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's path with the most votes, of pages with columns host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            sums: dict[tuple[str, str], int] = defaultdict(int)
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for path, points in votes(read(page or "")).items():
                    sums[name, path] += points
            rows = list(sums.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], ["host", "path", "points"])

    sums = pages.select("host", "html").mapInArrow(run, "host string, path string, points long").groupBy("host", "path").agg(F.sum("points").alias("points"))
    return sums.groupBy("host").agg(F.max(F.struct("points", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of each page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    paths = stored(winning_paths(rows), "paths")
    # A row for each host: sent to all executors up to a bound of bytes, else joined.
    size = paths.select(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0]
    small = (size or 0) <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(paths) if small else paths, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(read(page or ""), path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.select("id", "url", "html", "path").mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
