"""Main text of web pages, with templates deduced from the pages of a host.

Tokens of a page are its block tags, told apart by their path, and its runs of text. Tokens with the
same occurrence vector over the pages of a host, the number of times they occur on each page, form an
equivalence class. Vectors are not stored: they are compared by their number of pages and two sums of
hashes of (page, count), which are combined before the shuffle, so a host with a third of all pages is no
burden. Copies of a page count once. Large and frequent classes whose tokens keep their order are nested into the host's template:
a class is valid if all of it lies in one gap of the classes above it. On a page, what stands between
template tokens are the slots. Text that is part of the template is no content; the article is what is left
in article elements, else in main elements, else on the page.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are told by element, role and the
words of class and id, so pages of hosts too small for a template are read as well.

Defined results: null or empty html has the empty text; a null url belongs to no host; pages that repeat
are pages of their own; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.common import area_for, prepare, read_table, rows_of
from chatterloom.sources.staging import StagingArea

#: A class is frequent on at least so many pages and this share of its host's, and large from so many tokens.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.5, 3
#: Template tokens of all hosts up to which they are broadcast; beyond, pages are joined by host and salt.
BROADCAST_TOKENS, SALTS = 200_000, 32

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul caption".split()
)
#: What an opening tag closes, if open in the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("thead", "tbody")}
_CONTAINERS = frozenset("ul ol dl table menu div section article body".split())
#: Elements and roles that never hold the article.
BOILERPLATE_TAGS = frozenset(
    "head nav footer aside form button select option dialog menu noscript template svg math canvas object audio video "
    "script style textarea title iframe noembed noframes search".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of class and id that mark what is not the article.
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar banner footer colophon copyright legal "
    "sidebar aside rail widget widgets related recommended recommendations trending popular share sharing social follow "
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login search form comment comments commentlist disqus discussion replies respond pagination pager skip toolbar".split()
)
_NEGATED = frozenset("with has no without".split())
MAIN_WORDS = frozenset("content article post entry story main maincontent articlebody body text".split())

_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(?P<loose>/?[A-Za-z][^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))""", re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hash(*parts: object) -> int:
    """63 bits of a hash."""
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) >> 1


@functools.lru_cache(maxsize=20_000)
def _attributes(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """What tells an element apart (its classes), whether it is boilerplate, whether it is so for no more
    than being a header, and whether it names the main part."""
    found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attrs)}
    label = html_entities.unescape(f"{found.get('class', '')} {found.get('id', '')}")
    words = [word.lower() for word in _NAME_WORDS.findall(label)]
    told = {word for i, word in enumerate(words) if not (i and words[i - 1] in _NEGATED)}
    role = (found.get("role") or "").lower()
    hidden = (
        "hidden" in found or found.get("aria-hidden") == "true"
        or "display:none" in re.sub(r"\s", "", found.get("style") or "").lower()
    )
    boilerplate = hidden or tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES
    header = not boilerplate and told & BOILERPLATE_WORDS == {"header"}
    if tag not in ("html", "body", "main", "article"):
        boilerplate = boilerplate or bool(told & BOILERPLATE_WORDS)
    elif tag == "article":
        boilerplate = boilerplate or bool(told & {"comment", "comments", "related", "ad", "promo", "sponsored"})
    main = tag == "main" or role == "main" or found.get("itemprop") == "articleBody" or (
        tag in ("div", "section", "td") and bool(told & MAIN_WORDS)
    )
    return " ".join(sorted((found.get("class") or "").split())), boilerplate, header, main


@dataclass(slots=True)
class _Element:
    tag: str
    path: int
    boilerplate: bool
    article: int  # number of the outermost article or 0
    main: int  # number of the outermost main element or 0


@dataclass(slots=True)
class Run:
    """Text between block tags."""
    text: str
    token: int
    boilerplate: bool
    article: int
    main: int
    at: int  # tokens before it


@dataclass(slots=True)
class Page:
    tokens: list[int] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)


def _open(stack: list[_Element], tag: str, attrs: str, number: int) -> _Element:
    """The new element on the stack; closes what the tag implies."""
    if tag in BLOCK:
        _pop(stack, ("p",), _CONTAINERS | {"td", "li", "blockquote", "figure", "form"})
    if tag in CLOSES:
        _pop(stack, CLOSES[tag], _CONTAINERS)
    above = stack[-1]
    if not attrs and tag not in BOILERPLATE_TAGS and tag not in ("main", "article", "header"):
        label, boilerplate, header, main = "", False, False, False
    else:
        label, boilerplate, header, main = _attributes(tag, attrs)
    # The header of an article is part of it, that of a page is not.
    if above.article and header:
        boilerplate = False
    elif tag == "header" and not above.article:
        boilerplate = True
    path = _hash(above.path, tag, label) if tag in BLOCK else above.path
    article = above.article or (number if tag == "article" and not (boilerplate or above.boilerplate) else 0)
    element = _Element(tag, path, above.boilerplate or boilerplate, article, above.main or (number if main else 0))
    stack.append(element)
    return element


def _pop(stack: list[_Element], tags: tuple[str, ...], stops: frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in stops:
            return


def _close(stack: list[_Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            if tag in BLOCK or not any(element.tag in BLOCK for element in stack[i + 1:]):
                del stack[i:]
            else:
                del stack[i]
            return
        if tag not in BLOCK and stack[i].tag in _CONTAINERS:
            return


def parse(source: str) -> Page:
    """Tokens and runs of text of a page, however broken its markup."""
    page, stack = Page(), [_Element("", 0, False, 0, 0)]
    pending: list[str] = []
    at = number = 0

    def flush() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            top = stack[-1]
            token = _hash(top.path, "text", text)
            page.runs.append(Run(text, token, top.boilerplate, top.article, top.main, len(page.tokens)))
            page.tokens.append(token)

    while match := _TAG.search(source, at):
        if match.start() > at:
            pending.append(html_entities.unescape(source[at:match.start()]))
        at = match.end()
        name = match["name"] or (re.match(r"/?([A-Za-z][^\s/>]*)", match["loose"])[1] if match["loose"] else None)
        if name is None:
            continue
        tag = name.lower()
        closing = match["close"] or (match["loose"] or "").startswith("/")
        if tag == "br":
            pending.append(" ")
        elif closing:
            if tag in BLOCK:
                flush()
            _close(stack, tag)
        else:
            if tag in BLOCK:
                flush()
            attrs = (match["attrs"] or "").strip()
            if tag in RAW_TEXT:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in VOID:
                continue
            number += 1
            element = _open(stack, tag, attrs, number)
            if tag in BLOCK:
                page.tokens.append(element.path)
            if attrs.endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
                stack.pop()
    pending.append(html_entities.unescape(source[at:]))
    flush()
    return page


class Template:
    """Valid nested classes of a host: its tokens in template order."""

    def __init__(self, entries: list[tuple[int, int, int, float]]):
        """`entries`: (token, class, pages, mean position)."""
        classes: dict[int, list[tuple[float, int]]] = {}
        support: dict[int, int] = {}
        for token, group, pages, position in entries:
            classes.setdefault(group, []).append((position, token))
            support[group] = pages
        placed: list[tuple[float, int]] = []
        # The most frequent classes come first; others must fit into one gap of what is placed.
        for group in sorted(classes, key=lambda g: (-support[g], -len(classes[g]), g)):
            held = sorted(classes[group])
            below = {sum(p < position for p, _ in placed) for position, _ in held}
            if not placed or len(below) == 1:
                placed = sorted([*placed, *held])
        self.order = {token: i for i, (_, token) in enumerate(placed)}

    def slots(self, page: Page) -> dict[int, int]:
        """Template tokens of a page by their place in it, those left out that break the order."""
        found, last = {}, -1
        for place, token in enumerate(page.tokens):
            rank = self.order.get(token)
            if rank is not None and rank > last:
                found[place], last = rank, rank
        return found


def main_text(page: Page, template: Template | None) -> str:
    """The article of a page: its runs of text joined by blank lines."""
    slots = template.slots(page) if template else {}
    runs = [run for run in page.runs if not run.boilerplate]
    chosen = [run for run in runs if run.article] or [run for run in runs if run.main] or runs
    # If every run recurs, these are copies of one page, not a template.
    content = [run for run in chosen if slots.get(run.at) is None] or chosen
    return "\n\n".join(run.text for run in content)


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """`(host, token, pages, a, b, position)` from (host, page_id, html): sums that stand for the vector.

    Token 0 counts the pages of a host.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            sums: dict[tuple[str, int], list] = {}
            for host, key, source in zip(*(column.to_pylist() for column in batch.columns)):
                page = parse(source or "")
                counts = Counter(page.tokens)
                first: dict[int, int] = {}
                for place, token in enumerate(page.tokens):
                    first.setdefault(token, place)
                counts[0] = 1
                for token, count in counts.items():
                    vector = _hash(key, count)
                    entry = sums.setdefault((host, token), [0, 0, 0, 0.0])
                    entry[0] += 1
                    entry[1] += vector & 0x7FFFFFFF
                    entry[2] += vector >> 31 & 0x7FFFFFFF
                    entry[3] += first.get(token, 0)
            keys, values = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([host for host, _ in keys], pa.string()), pa.array([token for _, token in keys], pa.int64()),
                    *(pa.array([value[i] for value in values], pa.int64()) for i in range(3)),
                    pa.array([value[3] for value in values], pa.float64()),
                ],
                names=["host", "token", "pages", "a", "b", "position"],
            )

    found = pages.mapInArrow(run, "host string, token bigint, pages bigint, a bigint, b bigint, position double")
    return found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("a").alias("a"), F.sum("b").alias("b"),
        (F.sum("position") / F.sum("pages")).alias("position"),
    )


def _copies(pages: DataFrame, area: StagingArea) -> DataFrame:
    """`(host, page_id)` of the pages whose html another page of the host has too, of which one is left out."""
    each = pages.where("page_id IS NOT NULL").select("host", "page_id", F.md5("html").alias("digest"))
    each = area.stage(each, "digests")
    first = each.groupBy("host", "digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    return area.stage(
        each.join(first, ["host", "digest"]).where("page_id <> first").select("host", "page_id").distinct(), "copies"
    )


def deduced(pages: DataFrame, area: StagingArea) -> DataFrame:
    """`(host, template)`: arrays of (token, class, pages, position), of hosts that have any.

    A template token is on at least MIN_SHARE of the pages, so an array is no longer than a page.
    """
    pages = pages.join(_copies(pages, area), ["host", "page_id"], "left_anti").select("host", "page_id", "html")
    vectors = area.stage(occurrences(pages).where(F.col("pages") >= MIN_PAGES), "vectors")
    hosts = vectors.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    frequent = vectors.where("token <> 0").join(hosts, "host").where(F.col("pages") >= MIN_SHARE * F.col("all_pages"))
    members = frequent.groupBy("host", "pages", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("token", "position")).alias("tokens")
    ).where(F.col("n") >= MIN_TOKENS)
    entries = members.select("host", "pages", F.xxhash64("pages", "a", "b").alias("class"), F.explode("tokens").alias("t"))
    return area.stage(entries.groupBy("host").agg(
        F.collect_list(F.struct("t.token", "class", "pages", "t.position")).alias("template")
    ), "templates")


def extract(
    df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", area: StagingArea | None = None
) -> DataFrame:
    """`(key, url, text, n_chars)`: the main text of every page."""
    prepare(df.sparkSession)
    area = area_for(df, area)
    pages = df.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"),
        host_of(F.col(url)).alias("host"),
    )
    templates = deduced(pages.where("host IS NOT NULL").select("host", F.col("key").cast("string").alias("page_id"), "html"), area)
    tokens = templates.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    if tokens <= BROADCAST_TOKENS:
        joined = pages.join(F.broadcast(templates), "host", "left")
    else:
        salted = pages.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)))
        copies = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("bigint"))
        joined = salted.join(copies, ["host", "salt"], "left")
    kind = pages.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[str, Template] = {}
        for batch in rows_of(batches):
            texts = []
            hosts = batch.column(3).to_pylist()
            for i, (source, host) in enumerate(zip(batch.column(2).to_pylist(), hosts)):
                if host not in built:
                    entries = batch.column(4)[i].as_py()
                    if len(built) >= 1000:
                        built.clear()
                    built[host] = Template([tuple(entry.values()) for entry in entries]) if entries else None
                texts.append(main_text(parse(source), built[host]) if source else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["key", "url", "text", "n_chars"],
            )

    found = joined.select("key", "url", "html", "host", "template").mapInArrow(
        run, f"key {kind}, url string, text string, n_chars bigint"
    )
    return found.withColumnRenamed("key", key).withColumnRenamed("url", url)


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
