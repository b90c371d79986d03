"""HTML extraction by wrappers: union-free regular expressions inferred for each host.

A page is a stream of text tokens; a token's label is the path of elements that it stands in and what it is: a text slot (#), a text that is
mostly links (L), or a text that all pages of the host share (=, a constant). Neighbouring equal tokens, and groups of up to three that repeat,
become repeated ones. The streams of a host are aligned one after the other: what both have becomes one column, what only some have an
optional one. The columns then tell template from article: constants and link lists that all pages have are template, and the article is where the
slots' text is. Tags and class words alone decide only for hosts of a page or two.

Every page takes part, whatever a host's size: counts of texts and class words are sums by host and text, streams are aligned in the order of their
text by host and salt, then the salts' wrappers, so the result doesn't depend on the order or the partitions of the pages."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import checkpoint, is_small, salted_lookup, worker_state

#: Elements without an end tag; whose content is no text; that are part of a line; that hold boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea select math audio video title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
#: Elements that are no step of a path, as every page may have or leave them, or as they hold a block of text.
PLAIN = frozenset("html body p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot pre".split())
#: Words of class, id and role that mark boilerplate, and that mark an article.
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr banner notice notices alert popup modal overlay share sharing social comment comments reply replies respond disqus related recommended newsletter subscribe subscription signup login search pagination pager toolbar contentinfo complementary".split())
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())
#: A start tag of the second kind ends an open element of the first.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end doesn't look past.
SCOPE = frozenset("article main section div table ul ol dl body html nav aside header footer form blockquote".split())
#: Pages from which a host's wrapper decides; part of its pages that must share a class word for it to be a step's mark; part of the pages of the hosts
#: where a text occurs at all that must have it for it to be a host's template, and not a line that many articles share.
WRAPPED_PAGES, MARK_SHARE, TEMPLATE_SHARE = 3, 0.1, 0.8

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>",
    re.S | re.I,
)
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_raw_ends = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+(/?)>", re.I) for name in RAW}


class Block:
    """A block of text: its path (keys of the elements around it, outermost first), the text, its characters and those in links."""

    __slots__ = ("path", "text", "chars", "linked")

    def __init__(self, path: tuple[str, ...], text: str, chars: int, linked: int) -> None:
        self.path, self.text, self.chars, self.linked = path, text, chars, linked


def hash_of(text: str) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def words_of_attributes(attrs: str) -> set[str]:
    return {w for m in _MARK.finditer(attrs) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}


def _raw_end(source: str, name: str, at: int, missing: set[str]) -> int:
    """Where the raw element that began before `at` ends: after the end tag that matches it, or at once if there is none."""
    if name in missing:
        return at
    depth = 1
    for found in _raw_ends[name].finditer(source, at):
        if found[1]:
            depth -= 1
            if not depth:
                return found.end()
        elif not found[0].endswith("/>") and name in ("svg", "object"):
            depth += 1
    missing.add(name)
    return at


def blocks_of(source: str, marks: frozenset[int] | None = None) -> Iterator[Block]:
    """The blocks of text of a page outside of boilerplate elements, in order, however deep they are. marks: hashes of the class words that belong to
    a path besides the fixed ones; None: all do."""
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, steps of the path, within boilerplate
    path: list[str] = []
    line: list[str] = []
    open_tags: dict[str, int] = {}
    missing: set[str] = set()
    known_marks: dict[str, str] = {}
    size = linked = links = at = 0

    def flush() -> Iterator[Block]:
        nonlocal size, linked
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            line.clear()
            if text and not stack[-1][2]:
                yield Block(tuple(path), text, size, linked)
            size = linked = 0

    def close(to: int) -> None:
        nonlocal links
        for tag, _, _ in stack[to:]:
            open_tags[tag] -= 1
            links -= tag == "a"
        del stack[to:]
        del path[stack[-1][1] :]

    def add(text: str) -> None:
        nonlocal size, linked
        if not stack[-1][2]:
            line.append(text)
            n = len(text.strip())
            size += n
            linked += n * (links > 0)

    while True:
        token = TOKEN.search(source, at)
        stop = token.start() if token else len(source)
        if stop > at:
            add(source[at:stop])
        if token is None:
            break
        at = token.end()
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not token["end"] and not token["attrs"].endswith("/"):
                at = _raw_end(source, name, at, missing)
            continue
        inline = name in INLINE
        if token["end"]:
            if open_tags.get(name):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        if not inline:
                            yield from flush()
                        close(i)
                        break
                    if inline and stack[i][0] not in INLINE:
                        break
            elif not inline:
                yield from flush()
            continue
        if name == "br":
            add(" ")
            continue
        if not inline:
            yield from flush()
            ends = IMPLIED_END.get(name, {"p"})
            if any(open_tags.get(e) for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
        if name in VOID or token["attrs"].endswith("/"):
            continue
        if not inline:
            key = ""
            if token["attrs"]:
                key = known_marks.get(token["attrs"])
                if key is None:
                    words = words_of_attributes(token["attrs"])
                    if marks is not None:
                        words = {w for w in words if w in BOILERPLATE_WORDS or w in ARTICLE_WORDS or hash_of(w) in marks}
                    key = known_marks[token["attrs"]] = " ".join(sorted(words))
            if name not in PLAIN or name not in ("html", "body") and not BOILERPLATE_WORDS.isdisjoint(key.split()):
                path.append(f"{name}.{key}" if key else name)
        open_tags[name] = open_tags.get(name, 0) + 1
        links += name == "a"
        stack.append((name, len(path), stack[-1][2] or name in BOILERPLATE))
    yield from flush()


# ---- wrappers -----------------------------------------------------------------------------------
# A column: [label, repeated, pages, blocks, characters, of them in links]

SLOT, LINKS, CONSTANT = "#", "L", "="


def label_of(block: Block, constants: frozenset[int]) -> str:
    """Path and kind. A constant's label has its text's hash, so it is aligned with itself only."""
    kind = LINKS if 2 * block.linked > block.chars else SLOT
    if constants:
        h = hash_of(block.text)
        if h in constants:
            kind = f"{CONSTANT}{h}"
    return "/".join(block.path) + "|" + kind


def folded(columns: list[list], sizes: tuple[int, ...] = (1, 2, 3)) -> tuple[list[list], list[int]]:
    """A stream with repeated groups of up to three columns folded to one, and the folded column of each given one."""
    place = list(range(len(columns)))
    for size in sizes:
        out: list[list] = []
        moved: list[int] = []
        for column in columns:
            out.append(column)
            moved.append(len(out) - 1)
            if len(out) >= 2 * size and all(out[-size + k][0] == out[-2 * size + k][0] for k in range(size)):
                again = out[-size:]
                del out[-size:]
                for k, c in enumerate(again):
                    out[k - size] = _sum(out[k - size], c, True)
                for k in range(size):
                    moved[len(moved) - size + k] -= size
        columns, place = out, [moved[p] for p in place]
    return columns, place


def _sum(a: list, b: list, within: bool = False) -> list:
    """Two equal columns as one: of one page (`within`: repeated), or of different pages."""
    return [a[0], within or a[1] or b[1], max(a[2], b[2]) if within else a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5] + b[5]]


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The longest common subsequence of two label streams, as index pairs."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    out = [(i, i) for i in range(head)]
    if n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            row, below, label = best[i], best[i + 1], a[head + i]
            for j in range(m - 1, -1, -1):
                row[j] = below[j + 1] + 1 if label == b[head + j] else max(below[j], row[j + 1])
        i = j = 0
        while i < n and j < m:
            if a[head + i] == b[head + j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """One wrapper of two: columns of both are added up, columns of one only stand between them (a's first)."""
    out: list[list] = []
    i = j = 0
    for x, y in [*matched([c[0] for c in a], [c[0] for c in b]), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            out.append(_sum(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def stream(page: list[Block], constants: frozenset[int] = frozenset()) -> tuple[list[list], list[int]]:
    """A page's folded columns, and the column of each block."""
    return folded([[label_of(b, constants), False, 1, 1, b.chars, b.linked] for b in page])


def as_expression(columns: list[list], pages: int) -> str:
    """The wrapper as a regular expression over labelled texts."""
    return " ".join(f"({c[0]})" + ("*" if c[1] and c[2] < pages else "+" if c[1] else "?" if c[2] < pages else "") for c in columns)


def _path(label: str) -> tuple[str, ...]:
    path = label.rpartition("|")[0]
    return tuple(path.split("/")) if path else ()


def _marks(key: str) -> list[str]:
    return key.partition(".")[2].split()


def kept_columns(columns: list[list], pages: int) -> list[bool]:
    """Which columns of a wrapper hold the article."""
    paths = [_path(c[0]) for c in columns]
    kinds = [c[0].rpartition("|")[2][0] for c in columns]
    mass = [c[4] - c[5] if k == SLOT else 0 for c, k in zip(columns, kinds)]
    total = sum(mass)

    def flagged(path: tuple[str, ...], spared: tuple[str, ...]) -> int:
        """Steps down to the first element that class words mark as boilerplate; 0: none."""
        for i, key in enumerate(path, 1):
            if key.partition(".")[0] not in ("article", "main") and path[:i] != spared and not BOILERPLATE_WORDS.isdisjoint(_marks(key)):
                return i
        return 0

    spared: tuple[str, ...] = ("",)
    marked = [flagged(p, spared) for p in paths]
    clean = [0 if f else m for m, f in zip(mass, marked)]
    while 5 * sum(clean) < total:  # nearly all text is in marked elements: the largest of them is the article's
        by: dict[tuple[str, ...], int] = {}
        for p, m, f in zip(paths, mass, marked):
            if f:
                by[p[:f]] = by.get(p[:f], 0) + m
        most = max(sorted(by), key=by.__getitem__)
        if 2 * by[most] < total or most == spared:
            break
        spared = most
        marked = [flagged(p, spared) for p in paths]
        clean = [0 if f else m for m, f in zip(mass, marked)]
    constant = sum(c[4] for c, k, f in zip(columns, kinds, marked) if k == CONSTANT and not f)
    copies = constant > sum(clean)  # pages that are copies of each other, not a template around different texts
    if copies:
        clean = [m if f or k != CONSTANT else c[4] for m, f, k, c in zip(clean, marked, kinds, columns)]
    region = _region(paths, clean, columns, pages)
    out = []
    for c, p, k, f in zip(columns, paths, kinds, marked):
        inside = not f and any(p[: len(r)] == r for r in region)
        listed = k == LINKS and c[1] and (10 * c[2] >= 9 * pages if pages >= WRAPPED_PAGES else region == [()])
        out.append(inside and not listed and (k != CONSTANT or copies))
    return out


def _region(paths: list[tuple[str, ...]], mass: list[int], columns: list[list], pages: int) -> list[tuple[str, ...]]:
    """Paths of the elements of the article: down from the root as long as one element has most of the text, and nothing that most pages
    have stands beside it. For a host of a page or two, article and main elements and class words come first."""
    total = sum(mass)
    if pages < WRAPPED_PAGES:
        for rule in (lambda k: k.partition(".")[0] == "article", lambda k: k.partition(".")[0] == "main" or "main" in _marks(k), lambda k: not ARTICLE_WORDS.isdisjoint(_marks(k))):
            found: dict[tuple[str, ...], int] = {}
            for p, m in zip(paths, mass):
                for i, key in enumerate(p, 1):
                    if rule(key):
                        found[p[:i]] = found.get(p[:i], 0) + m
                        break
            found = {p: m for p, m in found.items() if m}
            if found and 2 * sum(found.values()) >= total:
                return sorted(found)
    node: tuple[str, ...] = ()
    while True:
        direct = sum(c[2] for p, m, c in zip(paths, mass, columns) if p == node and m)
        below: dict[tuple[str, ...], int] = {}
        for p, m in zip(paths, mass):
            if len(p) > len(node) and p[: len(node)] == node:
                below[p[: len(node) + 1]] = below.get(p[: len(node) + 1], 0) + m
        most = max(sorted(below), key=below.__getitem__, default=None)
        if most is None or 2 * direct >= pages or 2 * below[most] < total:
            return [node]
        node = most


def extract(source: str, wrapper: tuple[list[str], list[bool]] | None, constants: frozenset[int] = frozenset(), marks: frozenset[int] | None = None) -> str:
    """The article's text, a block a line: the blocks whose tokens align with columns that the wrapper (labels, kept) keeps. Without a wrapper, or
    if that leaves nothing, the page is its own wrapper."""
    page = list(blocks_of(source, marks))
    if wrapper is not None:
        columns, place = stream(page, constants)
        keep = [False] * len(columns)
        for i, j in matched([c[0] for c in columns], wrapper[0]):
            keep[i] = wrapper[1][j]
        if any(keep):
            return "\n".join(b.text for b, k in zip(page, place) if keep[k])
    columns, place = stream(page)
    keep = kept_columns(columns, 1)
    return "\n".join(b.text for b, k in zip(page, place) if keep[k])


# ---- the operator -------------------------------------------------------------------------------

#: Entries that a task adds up before it passes them on; parts in which a host's streams are aligned first.
HELD, SALTS = 200_000, 16


def host_of(url: object):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_constants(pages: DataFrame) -> DataFrame:
    """host, pages, constants (hashes of the texts that all its pages have, if it has WRAPPED_PAGES or more and the text isn't common elsewhere), marks (hashes of the class words that at
    least MARK_SHARE of its pages have): one row a host of pages(host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("html")
        held: dict[tuple[str, int, int], int] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*held)) or [(), (), ()]
            types = (pa.string(), pa.int32(), pa.int64())
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(held.values(), pa.int64())], names=["host", "kind", "h", "n"])
            held.clear()
            return batch

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                source = source.as_py() or ""
                found = {(host, 0, 0)}
                found.update((host, 1, hash_of(b.text)) for b in blocks_of(source, frozenset()))
                found.update((host, 2, hash_of(w)) for t in set(re.findall(r"<[a-zA-Z][^<>]*(?:class|id|role)\s*=[^<>]*>", source)) for w in words_of_attributes(t))
                for key in found:
                    held[key] = held.get(key, 0) + 1
                if len(held) >= HELD:
                    yield out()
        yield out()

    counts = pages.select("host", "html").mapInArrow(run, "host string, kind int, h long, n long")
    counts = checkpoint(counts.groupBy("host", "kind", "h").agg(F.sum("n").alias("n")))
    hosts = checkpoint(counts.filter("kind = 0").select("host", F.col("n").alias("pages")))
    rest = salted_lookup(counts.filter("kind > 0"), hosts, "host", is_small(hosts, 50_000), spread=F.col("h"))
    texts = rest.filter((F.col("kind") == 1) & (F.col("pages") >= WRAPPED_PAGES))
    everywhere = checkpoint(texts.filter(F.col("n") == F.col("pages")))
    found = everywhere.select("h").distinct()
    common = texts.join(F.broadcast(found) if is_small(everywhere) else found.hint("merge"), "h", "left_semi")
    common = common.groupBy("h").agg(F.sum("n").alias("on"), F.sum("pages").alias("of")).filter(F.col("on") < F.col("of") * TEMPLATE_SHARE)
    everywhere = everywhere.join(common.select("h"), "h", "left_anti").select("host", "kind", "h")
    rest = everywhere.unionByName(rest.filter((F.col("kind") == 2) & (F.col("n") >= F.col("pages") * MARK_SHARE)).select("host", "kind", "h"))
    # bounded: a constant is on the host's shortest page, and a page has a bounded share of frequent class words
    lists = rest.groupBy("host").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("h")))).alias(name) for k, name in ((1, "constants"), (2, "marks"))))
    none = F.array().cast("array<long>")
    return hosts.join(lists, "host", "left").select("host", "pages", F.coalesce("constants", none).alias("constants"), F.coalesce("marks", none).alias("marks"))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, columns (JSON), n (pages): one wrapper a host. pages(host, html, pages, constants, marks); hosts of fewer than WRAPPED_PAGES pages have none."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("html")
        held: dict[tuple[str, str], list] = {}

        def out() -> pa.RecordBatch:
            keys = list(zip(*held)) or [(), ()]
            salt = [hash_of(s) % SALTS for s in keys[1]]
            sums = list(zip(*((n, json.dumps(c, separators=(",", ":"))) for n, c in held.values()))) or [(), ()]
            batch = pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(salt, pa.int32()), pa.array(keys[1], pa.string()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.string())], names=["host", "salt", "labels", "n", "columns"])
            held.clear()
            return batch

        for batch in batches:
            sets: dict[tuple, tuple[frozenset[int], frozenset[int]]] = {}
            for host, source, constants, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in sets:
                    sets[host] = frozenset(constants), frozenset(marks)
                constants, marks = sets[host]
                columns, _ = stream(list(blocks_of(source or "", marks)), constants)
                key = host, "\n".join(f"{c[0]}{'+' * c[1]}" for c in columns)
                if key in held:
                    held[key] = [held[key][0] + 1, [_sum(a, b) for a, b in zip(held[key][1], columns)]]
                else:
                    held[key] = [1, columns]
                    if len(held) >= 5_000:
                        yield out()
        yield out()

    def merge(by: int):
        """Aligns the rows of equal first `by` columns in their order; equal streams are added up first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, n, held, same, last = None, 0, [], None, None

            def settle() -> None:
                nonlocal held, same
                if same is not None:
                    held = aligned(held, same) if held else same
                same = None

            def row() -> pa.RecordBatch:
                settle()
                return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1] if by == 2 else 0], pa.int32()), pa.array([""]), pa.array([n]), pa.array([json.dumps(held, separators=(",", ":"))])], names=["host", "salt", "labels", "n", "columns"])

            for batch in batches:
                for host, salt, labels, k, columns in zip(*(c.to_pylist() for c in batch.columns)):
                    now = (host, salt)[:by]
                    if key is not None and now != key:
                        yield row()
                        n, held, same = 0, [], None
                    columns = json.loads(columns)
                    if same is not None and now == key and labels == last and labels:
                        same = [_sum(a, b) for a, b in zip(same, columns)]
                    else:
                        settle()
                        same = columns
                    key, last, n = now, labels, n + k
            if key is not None:
                yield row()

        return run

    schema = "host string, salt int, labels string, n long, columns string"
    many = pages.filter(F.col("pages") >= WRAPPED_PAGES).select("host", "html", "constants", "marks")
    parts = many.mapInArrow(streams, schema).repartition("host", "salt").sortWithinPartitions("host", "salt", "labels").mapInArrow(merge(2), schema)
    return parts.repartition("host").sortWithinPartitions("host", "salt").mapInArrow(merge(1), schema).select("host", "n", "columns")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text for each row of pages(page_id, url, html): the article's text, a block a line.

    Null or empty html, and pages without an article, give the empty text. Pages with a null or odd url share the host "". Character references are
    decoded; white space within a block is one space. Equal pages of a host give equal texts; repeated rows are extracted alike; an empty table
    gives no rows; other columns are ignored."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    hosts = checkpoint(host_constants(rows))
    small = is_small(hosts, 50_000)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = []
            for n, columns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                columns = json.loads(columns)
                plans.append(json.dumps([[c[0] for c in columns], kept_columns(columns, n)], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plans, pa.string())], names=["host", "plan"])

    wrappers = host_wrappers(salted_lookup(rows, hosts, "host", small, spread=F.col("page_id")))
    plans = checkpoint(hosts.join(wrappers.mapInArrow(kept, "host string, plan string"), "host", "left").drop("pages"))
    rows = salted_lookup(rows, plans, "host", small, spread=F.col("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("html")
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            hosts_, lists = batch.column(3).to_pylist(), [batch.column(k) for k in (4, 5, 6)]
            for i, source in enumerate(batch.column(2)):
                host = hosts_[i]
                if host not in known:
                    if len(known) > 5_000:
                        known.clear()
                    constants, marks, plan = (c[i].as_py() for c in lists)
                    known[host] = json.loads(plan) if plan else None, frozenset(constants), frozenset(marks) if plan else None
                texts.append(extract(source.as_py() or "", *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(texts, pa.string())], names=["page_id", "url", "host", "text"])

    return rows.select("page_id", "url", "html", "host", "constants", "marks", "plan").mapInArrow(run, f"page_id {kind}, url string, host string, text string")
