"""Main text of web pages by nearest-URL page differencing (operator 7).

Pages are cut into lines (text of one block, white space as single spaces).
Within each host, pages are ordered by URL path and each is paired with its
nearest neighbour, the one beside it with the longer common path prefix. The
pair's lines are aligned by longest common subsequence; shared lines are the
site's frame and go. Markup decides where it can: lines of menus, headers,
footers, sidebars, notices, adverts, forms and comments always go, and in a page with an
article (or main) element exactly its other lines stay, shared or not, since
two pages of one site may quote the same text. Only in pages without such an
element do shared lines decide; when the neighbour shares all lines (a copy of
the page), they stay.

Only line hashes are ordered by URL; a host of any size is spread over tasks,
and neighbours across the borders of tasks are found through the border rows.

Defined cases: null html is empty and gives the empty text; a null or odd url
counts as an empty host and path; repeated rows are neighbours of each other
(copies); pages without a neighbour lose no shared lines; tags that are cut off end
the page; an ``article`` named as a comment or an advert is one; where all articles stand in an
element named as an advert or notice that is never closed, they are the main text; extra columns are not read.
Pages may be of any length: the alignment of two pages holds at most ROW_BITS bits of rows and MASKS bit masks at once.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import lean, stored

# Element names and words of class, id and role attributes.
NO_TEXT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video",
           "select", "textarea", "button", "title"}
RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li",
         "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul"}
SPACE = {"br", "td", "th"}
FRAME_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
               "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "login", "masthead", "menu", "modal", "nav",
               "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "replies",
               "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
COMMENT_WORDS = {"comment", "comments", "disqus", "related", "replies"}
OPTIONAL_END = {"dd", "dt", "li", "p", "td", "th", "tr"}
FRAME_ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")


#: Alignments of more than so many bits of rows are halved first.
ROW_BITS = 1 << 26
#: Lines that stand in more than one of so many places of a page keep their bit mask.
MASKS = 256


def _frame_words(name: str, attrs: str) -> set[str] | None:
    """The words that make an element part of the page's frame (none: it is no part; empty: its name or role does)."""
    if name in FRAME:
        return set()
    if not attrs or name in ("html", "body", "main"):
        return None
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.lower()
        words = set(WORD.findall(value))
        if name in MAIN and key in ("class", "id"):  # whole names: "with-sidebar" says nothing of an article
            names = value.strip("\"'").split()
            words = set(names) | {w for w in words if key == "id" and any(n.startswith(("comment-", "comment_")) for n in names)}
        if key == "hidden" or key == "role" and words & FRAME_ROLES:
            return set()
        if key in ("class", "id") and words & FRAME_WORDS:
            return words & FRAME_WORDS
    return None


def page_lines(page: str) -> tuple[list[str], str]:
    """(lines, kinds): kind m inside an article or main element, f in the page's frame, u neither."""
    lines, kinds, held = [], [], []
    # open elements: name, kind of their text, kind of an article inside a frame known by its class only, whether that frame is this element
    stack: list[tuple[str, str, str, bool]] = []
    kind, held_kind, mark, at = "u", "u", "", 0  # kind of the next text and of the text held for the block
    unclosed: set[str] = set()

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            lines.append(text)
            kinds.append(held_kind)

    while True:
        tag = TAG.search(page, at)
        text = page[at : tag.start() if tag else len(page)]
        if text and kind != "x":
            if kind != held_kind:
                flush()
                held_kind = kind
            held.append(entities.unescape(text) if "&" in text else text)
        if not tag:
            break
        at = tag.end()
        name = tag["name"]
        if not name:
            continue
        name = name.lower()
        if name in SPACE:
            held.append(" ")
        if name in BLOCK:
            flush()
        if tag["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    unclosed.update(m for _, _, m, own in stack[k + 1 :] if own)
                    del stack[k:]
                    kind, mark = stack[-1][1:3] if stack else ("u", "")
                    break
        elif name not in VOID and not tag["attrs"].endswith("/"):
            new, inner, own = kind, mark, False
            if kind != "x":
                words = _frame_words(name, tag["attrs"]) if kind != "f" or mark else None
                if name in NO_TEXT:
                    new = "x"
                elif words is not None:
                    own = bool(words) and not words & COMMENT_WORDS and name not in OPTIONAL_END
                    new, inner = "f", f"?{at}" if own else ""
                elif name in MAIN or "role" in tag["attrs"] and re.search(r"role\s*=\s*[\"']?main\b", tag["attrs"], re.I):
                    new = "m" if kind == "u" else mark if kind == "f" and mark else kind
            if name in RAW_TEXT:  # its content is no markup
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            stack.append((name, new, inner, own))
            kind, mark = new, inner
    flush()
    unclosed.update(m for _, _, m, own in stack if own)
    if "m" in kinds:
        unclosed = set()
    return lines, "".join(k if len(k) == 1 else "m" if k in unclosed else "f" for k in kinds)


def _masks(a: list[int]):
    """Function that gives the bits of the places of a line in ``a``. Only masks of frequent lines are held."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)

    def mask(places: list[int]) -> int:
        bits = bytearray(places[-1] // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    frequent = {x: mask(places) for x, places in where.items() if len(places) * MASKS > len(a)}
    return lambda x: frequent[x] if x in frequent else mask(where[x]) if x in where else 0


def _states(a: list[int], b: list[int]):
    """After each element of ``b``, the bits of ``a`` where the common subsequence does not grow."""
    mask, full = _masks(a), (1 << len(a)) - 1
    state = full
    for x in b:
        hit = state & mask(x)
        state = ((state + hit) | (state - hit)) & full
        yield state


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` with each beginning of ``a``."""
    state = 0
    for state in _states(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list[int], b: list[int]) -> list[bool]:
    if not a or not b:
        return [False] * len(a)
    if len(a) * len(b) > ROW_BITS and len(b) > 1:
        half = len(b) // 2
        cut = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
        return _common(a[:cut], b[:half]) + _common(a[cut:], b[half:])
    rows = list(_states(a, b))
    out = [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out[i] = True
    return out


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """For each element of ``a``: whether it is part of a longest common subsequence with ``b``.

    Equal beginnings and ends are taken first; the rest is aligned bit-parallel, in halves of ``b`` while it is large.
    """
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return [True] * head + _common(a[head : len(a) - tail], b[head : len(b) - tail]) + [True] * tail


URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")


def url_key(url: str | None) -> tuple[str, str]:
    """Host (lower case) and path of a URL."""
    found = URL.match(url or "")
    return (found[1].lower(), found[2].rstrip("/")) if found else ("", url or "")


KEY = "content long, name long"


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Columns content and name (hashes that tell rows apart, but for equal rows), page_id, url and html."""
    row = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return row.select(F.xxhash64("html").alias("content"), F.xxhash64("url", "page_id").alias("name"), "page_id", "url", "html")


def _per_part(batches, rows: int = 256):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def line_hashes(keyed: DataFrame) -> DataFrame:
    """content, name, host, path and the hashes of the page's lines."""

    def run(batches):
        for part in _per_part(batches):
            hosts = [url_key(u) for u in part.column(2).to_pylist()]
            hashes = [
                [int.from_bytes(hashlib.blake2b(x.encode(errors="replace"), digest_size=8).digest(), "little", signed=True) for x in page_lines(page or "")[0]]
                for page in part.column(3).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([h for h, _ in hosts], pa.string()), pa.array([p for _, p in hosts], pa.string()),
                 pa.array(hashes, pa.list_(pa.int64()))],
                ["content", "name", "host", "path", "hashes"],
            )

    return keyed.select("content", "name", "url", "html").mapInArrow(lean(run), f"{KEY}, host string, path string, hashes array<long>")


def line_texts(keyed: DataFrame) -> DataFrame:
    """content, name, page_id, url, the lines as one text and a letter for the kind of each."""

    def run(batches):
        for part in _per_part(batches):
            pages = [page_lines(page or "") for page in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(k) for k in range(4)), pa.array(["\n".join(lines) for lines, _ in pages], pa.string()), pa.array([k for _, k in pages], pa.string())],
                ["content", "name", "page_id", "url", "body", "kinds"],
            )

    return keyed.mapInArrow(lean(run), f"{KEY}, page_id long, url string, body string, kinds string")


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


#: Pages in one run of neighbours handled by one call.
RUN_ROWS = 2_000


def shared_with_neighbour(lines: DataFrame) -> DataFrame:
    """(content, name, shared): for each page a text of 0 and 1, 1 where the nearest page shares the line.

    The ordered rows are written once;
    runs of rows are compared in order, and the first and the last row of a run
    are also sent to the runs beside it.
    """
    ordered = stored(lines.repartitionByRange("host", "path", "content", "name").sortWithinPartitions("host", "path", "content", "name"), "by-url")
    ordered = ordered.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("at"))
    ordered = ordered.withColumn("run", F.floor(F.col("at") / RUN_ROWS).cast("long"))
    runs = stored(ordered.groupBy("part", "run").agg(F.min("at").alias("first"), F.max("at").alias("last")), "runs")
    numbered = runs.withColumn("no", F.row_number().over(Window.orderBy("part", "run")))  # one row per RUN_ROWS pages
    placed = ordered.join(numbered, ["part", "run"])
    copies = F.filter(
        F.array(
            F.col("no"),
            F.when(F.col("at") == F.col("first"), F.col("no") - 1),
            F.when(F.col("at") == F.col("last"), F.col("no") + 1),
        ),
        lambda x: x.isNotNull(),
    )
    sent = placed.select("content", "name", "host", "path", "hashes", "no", "at", F.explode(copies).alias("to"))

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["no"], r["at"]))
        out = []
        for k, page in enumerate(rows):
            if page["no"] != page["to"]:
                continue
            beside = [rows[i] for i in (k - 1, k + 1) if 0 <= i < len(rows) and rows[i]["host"] == page["host"]]
            shared = "0" * len(page["hashes"])
            if beside:
                nearest = max(beside, key=lambda r: _common_prefix(page["path"], r["path"]))
                shared = "".join("1" if s else "0" for s in common_lines(page["hashes"], nearest["hashes"]))
            out.append((page["content"], page["name"], shared))
        content, name, flags = zip(*out) if out else ((), (), ())
        return pa.table({"content": pa.array(content, pa.int64()), "name": pa.array(name, pa.int64()), "shared": pa.array(flags, pa.string())})

    return sent.groupBy("to").applyInArrow(compare, f"{KEY}, shared string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    keyed = _keyed(pages, id_col, url_col, html_col)
    found = shared_with_neighbour(stored(line_hashes(keyed), "page-lines"))
    shared = stored(found.groupBy("content", "name").agg(F.max("shared").alias("shared")), "shared-lines", release=True)
    both = line_texts(keyed).join(shared, ["content", "name"])
    each = F.arrays_zip(F.split("body", "\n").alias("line"), F.split("kinds", "").alias("kind"), F.split("shared", "").alias("shared"))
    lines_where = lambda keep: F.transform(F.filter(each, keep), lambda x: x["line"])
    has_main = F.instr("kinds", "m") > 0
    undecided = lines_where(lambda x: x["kind"] == "u")
    own = lines_where(lambda x: (x["kind"] == "u") & (x["shared"] == "0"))
    kept = F.when(has_main, lines_where(lambda x: x["kind"] == "m")).when(F.size(own) > 0, own).otherwise(undecided)
    text = F.when(F.col("kinds") == "", F.lit("")).otherwise(F.array_join(kept, "\n"))
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
