"""Main text of web pages by wrapper inference: a union-free regular expression per host and layout.

A page is read as a stream of text blocks, each named by the path of block elements it lies in (with class, id and role words). The
streams of a host are aligned pairwise into one expression without unions: a block kept on one side of a mismatch becomes optional, runs
of equal blocks or of equal short groups become repetitions. Every stream is then laid on its layout's expression, which gives each block a place
there, and a place's text is a slot unless all pages that have it agree on it. Places then play one of two parts. Blocks in boilerplate elements (menus, page headers, footers, sidebars, notices, adverts, forms,
comments, hidden parts), judged block by block, and constant texts are template; of the rest, those in the layout's content element (article or
main where a page has one, else the deepest element with most of the variable text) are the article. A host has a wrapper for each layout: pages
with marked content are one, other pages go by the element that holds most of their own text. So pages of another make, or with hidden or
template blocks of their own, change nothing for the rest. A block that the expression has no place for goes with its path's other such blocks.

In Spark: one scan yields streams and their blocks with texts as hashes, aggregated by (host, layout, stream, place in it) with map-side combining, so
a host with a third of all pages is a few rows. Streams of a layout are merged in salted groups and then across groups; merging keeps one
expression in memory. Only distinct streams are laid on it, and their counts are summed by place. The table of wrappers is written to the shared folder and joined to the pages on the host: Spark broadcasts it if
its files are small and sorts both sides if not. The second scan reads the whole pages again; nothing is cut short.

Null html has no text and null urls have an empty host of their own. Pages that repeat count once when texts are compared, so copies do not
turn an article into a template. Hosts of fewer than `agree` different pages have no constant texts. An empty table gives an empty result. Columns
other than id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.llm.common import slices, table, write_table
from firmament.llm.registry import query
from firmament.llm.url_filter import host_of
from firmament.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object|canvas|audio|video|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s>/]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?/][^>]*>|[^<]+|<""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([\w:@.-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
OUTSIDE = frozenset("nav footer aside form button select dialog menu head".split())
JUNK_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar ad ads adbox advert adverts "
    "advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "share sharing social comment comments commentlist reply replies respond disqus related recommended recommendations widget toolbar pagination "
    "pager login signin signup register search searchbox skip complementary contentinfo form copyright legal disclaimer".split())
#: What may stand beside such a word within the content; "related-posts" is a box of links, "related-work" a section of the article.
BOX_WORDS = frozenset(
    "post posts article articles story stories link links list box section block area button buttons bar container wrapper wrap inner outer item items "
    "top bottom left right main site page global primary secondary message text module panel content title slot unit group row col column "
    "thread body author meta count form icons icon media news items more by in of the 0".split())
JUNK = re.compile(r"(?:^|[-_ ])(?:" + "|".join(sorted(JUNK_WORDS)) + r")(?:$|[-_ ])", re.I)
#: Words that name a neighbour's presence, and headers of the content, are no boilerplate.
SAID_OF_OTHERS = re.compile(r"(?<![^\s])(?:no|has|have|with|without)[-_]\S+", re.I)
OWN_HEADER = re.compile(r"(?<![^\s])(?:entry|post|article)[-_]header(?![^\s])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTENT = re.compile(r"^(?:article|main)\b|@(?:article|main)$|\barticleBody\b")


def names_a_box(words: str) -> bool:
    """Whether some class word says boilerplate and nothing else."""
    for word in words.lower().split():
        parts = set(re.split(r"[-_]+", re.sub(r"\d+", "0", word))) - {""}
        if parts & JUNK_WORDS and parts <= JUNK_WORDS | BOX_WORDS:
            return True
    return False


class Element:
    __slots__ = ("tag", "name", "junk", "worded", "content")

    def __init__(self, tag: str, attributes: str, inside: bool):
        found = {k.lower(): next((v for v in vs if v), "") for k, *vs in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        words = " ".join(x for x in (found.get("class", ""), found.get("id", "")) if x)
        role = found.get("role", "")
        self.tag = tag
        self.name = tag + "".join("." + re.sub(r"\d+", "0", w) for w in words.split()) + (f"@{role}" if role else "") + (
            " articleBody" if found.get("itemprop") == "articleBody" else "")
        self.content = bool(CONTENT.search(self.name))
        words = SAID_OF_OTHERS.sub(" ", words)
        if inside:
            words = OWN_HEADER.sub(" ", words)
        whole = tag in ("html", "body")
        self.worded = not whole and (names_a_box(words) if inside else bool(JUNK.search(words)))
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
        self.junk = tag in OUTSIDE or tag == "header" and not inside or not whole and bool(JUNK.search(role)) or hidden


def boilerplate(stack: list[Element]) -> bool:
    """Whether a block in these elements is none of the article's.

    Class words of the (outermost) content element and of those around it do not count: they speak of the page, not of its text. Neither does a
    form around the content element, or one that holds the whole body.
    """
    content = next((k for k, e in enumerate(stack) if e.content), -1)

    def drops(k: int, e: Element) -> bool:
        if e.tag == "form" and (k < content or all(x.tag in ("html", "body") for x in stack[:k])):
            return False
        return e.junk or e.worded and k > content

    return any(drops(k, e) for k, e in enumerate(stack))


def blocks(page: str) -> list[tuple[str, str, bool]]:
    """(path, text, whether in boilerplate) of every non-empty text block, in page order."""
    out: list[tuple[str, str, bool]] = []
    stack: list[Element] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.append(("/".join(e.name for e in stack), said, boilerplate(stack)))
            text.clear()

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            if m[1]:
                if m[1].lower() != "title":
                    text.append(" ")
            elif m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if m[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if at is not None:
                del stack[at:]
            continue
        if tag in VOID:
            continue
        while stack and (stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ())):
            stack.pop()
        if stack and stack[-1].tag == "head" and tag not in ("link", "meta", "base"):
            stack.pop()
        if not m[4].rstrip().endswith("/") or tag not in ("div", "p"):
            stack.append(Element(tag, m[4], any(e.content for e in stack)))
    flush()
    return out


def fold(tokens: list[str], longest: int = 4) -> list[list]:
    """[group, repeated] entries: runs of equal groups of up to `longest` blocks become one repeated group."""
    out: list[list] = []
    at = 0
    while at < len(tokens):
        for size in range(1, longest + 1):
            group, end = tokens[at:at + size], at + size
            while tokens[end:end + size] == group:
                end += size
            if end > at + size:
                out.append([group, True])
                at = end
                break
        else:
            out.append([[tokens[at]], False])
            at += 1
    return out


#: An entry of an expression: [blocks of the group, repeated, optional].
def start(stream: list[list]) -> list[list]:
    return [[group, repeated, False] for group, repeated in stream]


def align(expression: list[list], other: list[list]) -> list[list]:
    """The union-free generalisation of two expressions: what only one has is optional, what repeats in either repeats."""
    a, b = (["\x1f".join(e[0]) for e in x] for x in (expression, other))
    if a == b:
        return [[x[0], x[1] or y[1], x[2] or y[2]] for x, y in zip(expression, other)]
    out: list[list] = []
    for kind, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[x[0], x[1] or y[1], x[2] or y[2]] for x, y in zip(expression[i:j], other[k:n])]
        else:
            out += [[g, r, True] for g, r, _ in [*expression[i:j], *other[k:n]]]
    # Neighbours of equal blocks are one repetition.
    merged: list[list] = []
    for entry in out:
        if merged and merged[-1][0] == entry[0]:
            merged[-1][1], merged[-1][2] = True, merged[-1][2] and entry[2]
        else:
            merged.append(entry)
    return merged


def within(tokens: list[str], stream: list[list]) -> list[int]:
    """The place of every block among the blocks of its folded stream; repetitions share places."""
    out: list[int] = []
    base = 0
    for group, repeated in stream:
        out += range(base, base + len(group))
        while repeated and tokens[len(out):len(out) + len(group)] == group:
            out += range(base, base + len(group))
        base += len(group)
    return out


def laid(stream: list[list], expression: list[list]) -> list[int | None]:
    """For every block of a folded stream, its place among the blocks of the expression; none where they do not align."""
    a, b = (["\x1f".join(e[0]) for e in x] for x in (stream, expression))
    at, n = [], 0
    for e in expression:
        at.append(n)
        n += len(e[0])
    found: list[int | None] = [None] * len(stream)
    for i, j, size in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        found[i:i + size] = at[j:j + size]
    return [None if place is None else place + k for place, e in zip(found, stream) for k in range(len(e[0]))]


def written(expression: list[list], constant: set[int]) -> str:
    """The expression as text: #text is a slot, ' a constant (a place in `constant`); ? optional, + repeated."""
    out, n = [], 0
    for g, r, o in expression:
        said = " ".join(f"{p.rpartition('/')[2]}({chr(39) if n + k in constant else '#text'})" for k, p in enumerate(g))
        out.append(f"({said}){'+' if r else ''}{'?' if o else ''}")
        n += len(g)
    return " ".join(out)


def content_path(sizes: dict[str, int], share: float = 0.6) -> str:
    """The deepest element that holds at least `share` of the variable text."""
    total, best, sums = sum(sizes.values()), "", {}
    for path, n in sizes.items():
        steps = path.split("/")
        for k in range(1, len(steps) + 1):
            prefix = "/".join(steps[:k])
            sums[prefix] = sums.get(prefix, 0) + n
    for prefix, n in sums.items():
        last = prefix.rpartition("/")[2]
        if n >= share * total and len(prefix) > len(best) and not re.match(r"(?:p|h\d|li|ul|ol|dl|dt|dd|td|th|tr|tbody|table|pre|blockquote)\b", last):
            best = prefix
    return best


def is_marked(path: str) -> bool:
    return any(CONTENT.search(step) for step in path.split("/"))


def layout_of(found: list[tuple[str, str, bool]]) -> str:
    """The layout of a page: "" where elements mark its content, else the deepest element that holds most of its own free text.

    It is taken from the page alone, so a page of another make changes nothing for it.
    """
    sizes: dict[str, int] = {}
    for path, said, junk in found:
        if not junk:
            sizes[path] = sizes.get(path, 0) + len(said)
    return "" if any(map(is_marked, sizes)) else "/" + content_path(sizes)


def article_parts(stats: list[tuple[int | None, str, int, bool]]) -> tuple[set[str], set[int | str]]:
    """(paths of the article in one layout, its template within them). `stats`: (place, path, characters, constant) of free blocks.

    The template is named by places of the expression, and by path for blocks without a place. Marked content has none.
    """
    marked = {p for _, p, _, _ in stats if is_marked(p)}
    if marked:
        return marked, set()
    free: dict[str, int] = {}
    varies = [x for x in stats if not x[3]] or stats
    for _, path, n, _ in varies:
        free[path] = free.get(path, 0) + n
    inside = content_path(free)
    paths = {p for p in free if p == inside or p.startswith(inside + "/") or not inside}
    return paths, {p if k is None else k for k, p, _, constant in stats if constant and p in paths and varies is not stats}


def _streams(pages: DataFrame) -> DataFrame:
    """(host, layout, form, stream, page hash, place, path, characters, text hash): one row per page with its stream, and one per page and place of free
    blocks in that stream. `form` is the stream's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1, max_bytes=1 << 22):
            rows = []
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = blocks(page or "")
                layout = layout_of(found)
                whole = xxhash.xxh64_intdigest("\x1f".join(t for _, t, _ in found)) >> 1
                tokens = [p for p, _, _ in found]
                folded = fold(tokens)
                stream = json.dumps(folded)
                form = xxhash.xxh64_intdigest(stream) >> 1
                places: dict[int, list] = {}
                for place, (path, said, junk) in zip(within(tokens, folded), found):
                    if not junk:
                        x = places.setdefault(place, [path, 0, xxhash.xxh64()])
                        x[1] += len(said)
                        x[2].update(said + "\x1f")
                rows.append((host, layout, form, stream, whole, None, None, 0, 0))
                rows += [(host, layout, form, None, whole, k, p, n, h.intdigest() >> 1) for k, (p, n, h) in places.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    schema = pa.schema([("host", pa.string()), ("layout", pa.string()), ("form", pa.int64()), ("stream", pa.string()), ("page", pa.int64()), ("place", pa.int32()),
                        ("path", pa.string()), ("chars", pa.int64()), ("said", pa.int64())])
    return pages.mapInArrow(run, "host string, layout string, form long, stream string, page long, place int, path string, chars long, said long")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", agree: int = 3, salts: int = 16) -> DataFrame:
    """(host, layout, pages, wrapper, expression, article): a row per layout of a host; its pages (about), the expression as text and as JSON, and as JSON
    the article's paths and the template within them.

    A place of the expression whose free blocks say the same on all of at least `agree` different pages of the layout is template.
    """
    seen = write_table(_streams(pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html")))
                       .groupBy("host", "layout", "form", "stream", "place", "path").agg(
        F.sum("chars").alias("chars"), F.min("said").alias("low"), F.max("said").alias("high"), F.hll_sketch_agg("page").alias("pages")))
    group = ["host", "layout"]

    def merge(texts: pd.Series, loads) -> list[list] | None:
        whole = None
        for text in sorted(texts):
            one = loads(text)
            whole = one if whole is None else align(whole, one)
        return whole

    def chunk(g: pd.DataFrame) -> pd.DataFrame:
        return g[group].iloc[:1].assign(expression=json.dumps(merge(g["stream"], lambda t: start(json.loads(t)))))

    def layout(g: pd.DataFrame) -> pd.DataFrame:
        return g[group].iloc[:1].assign(expression=json.dumps(merge(g["expression"], json.loads)))

    streams = seen.where("stream is not null").select(*group, "form", "stream")
    salted = streams.withColumn("salt", F.pmod(F.xxhash64("stream"), F.lit(salts)))
    part = salted.groupBy(*group, "salt").applyInPandas(lambda g: chunk(g), "host string, layout string, expression string")
    whole = cut_lineage(part.groupBy(*group).applyInPandas(lambda g: layout(g), "host string, layout string, expression string"))

    @F.udf(T.ArrayType(T.IntegerType()))
    def places(stream, expression):
        return laid(json.loads(stream), json.loads(expression))

    laid_out = streams.join(whole, group).select(*group, "form", F.posexplode(places("stream", "expression")).alias("place", "slot"))
    alone = F.when(F.col("slot").isNull(), F.col("path"))  # blocks of one place have one path
    slots = seen.where("place is not null").join(laid_out, [*group, "form", "place"]).groupBy(*group, "slot", alone.alias("alone")).agg(
        F.min("path").alias("path"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("pages")).alias("pages"))
    stats = slots.groupBy(*group).agg(F.collect_list(F.struct("slot", "path", "chars", "low", "high", "pages")).alias("slots"))

    counts = seen.where("stream is not null").groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("pages")).alias("pages"))

    @F.udf(T.StructType([T.StructField("wrapper", T.StringType()), T.StructField("article", T.StringType())]))
    def judge(expression, rows):
        known = [(r.slot, r.path, r.chars, r.low == r.high and r.pages >= agree) for r in rows or []]
        paths, template = article_parts(known)
        return (written(json.loads(expression), {k for k, _, _, constant in known if constant and k is not None}),
                json.dumps({"paths": sorted(paths), "template": sorted(template, key=str)}))

    return whole.join(counts, group).join(stats, group, "left").select(*group, "pages", "expression", judge("expression", "slots").alias("r")).select(
        *group, "pages", "expression", "r.*")


@lru_cache(maxsize=256)
def _layouts(packed: str) -> dict[str, tuple[list[list], frozenset[str], frozenset[int | str]]]:
    """layout -> (expression, the article's paths, its template)."""
    out = {}
    for layout, x in json.loads(packed).items():
        article = json.loads(x["article"])
        out[layout] = json.loads(x["expression"]), frozenset(article["paths"]), frozenset(article["template"])
    return out


def by_wrapper(found: list[tuple[str, str, bool]], expression: list[list], paths: frozenset[str], template: frozenset[int | str]) -> list[str]:
    """The texts of a page's article blocks: in one of its layout's article paths, and at no template place of the layout's expression."""
    if not template:
        return [said for path, said, junk in found if path in paths and not junk]
    tokens = [p for p, _, _ in found]
    folded = fold(tokens)
    slots = laid(folded, expression)
    out = []
    for place, (path, said, junk) in zip(within(tokens, folded), found):
        if not junk and path in paths and (path if slots[place] is None else slots[place]) not in template:
            out.append(said)
    return out


def own_paths(found: list[tuple[str, str, bool]], layout: str) -> set[str]:
    """The article's paths as far as the page alone tells: marked ones, else those in the layout's element."""
    if not layout:
        return {p for p, _, _ in found if is_marked(p)}
    inside = layout[1:]
    return {p for p, _, _ in found if p == inside or p.startswith(inside + "/") or not inside}


def extract_text(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", agree: int = 3) -> DataFrame:
    """(id, url, text): the article of every page, one row per input row.

    A page of a marked layout, or of one with fewer than `agree` pages, is judged by itself; another page is laid on the expression of its layout. Those
    of a host travel with its pages as one map, in which layouts made from random class names (of a page each) do not occur.
    """
    src = pages.select(id_col, F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"), host_of(F.col(url_col).cast("string")).alias("host"))
    by_host = wrappers.where((F.col("layout") != "") & (F.col("pages") >= agree)).groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layout", F.struct("expression", "article"))))).alias("layouts"))
    joined = src.join(by_host, "host", "left").select(id_col, "_url", "_html", "layouts")
    out = T.StructType([pages.schema[id_col], T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2, max_bytes=1 << 22):
            texts = []
            for page, layouts in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                found = blocks(page or "")
                layout = layout_of(found)
                wrapper = _layouts(layouts or "{}").get(layout)
                if wrapper and wrapper[1]:
                    texts.append("\n".join(by_wrapper(found, *wrapper)))
                else:
                    wanted = own_paths(found, layout)
                    texts.append("\n".join(said for path, said, junk in found if path in wanted and not junk))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    return joined.mapInArrow(run, out)


@query("op9_html_extraction")
def op9_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    texts = extract_text(pages, write_table(infer_wrappers(pages)))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
