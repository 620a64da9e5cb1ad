"""Main text of web pages by wrappers inferred from the pages of the same host.

A page is a stream of text blocks, each under its path of elements (names, ids, classes and roles, digits folded, at any depth
and length; told by a hash). A wrapper is a union-free regular expression over such streams. It is inferred by aligning page
after page with what is known of the host:

- consecutive blocks of one path, and repeats of up to GROUP blocks, fold to a repeated group;
- the streams' k-th occurrences of equal blocks and groups are paired, and the longest increasing run of pairs is the alignment;
- what the alignment leaves out on either side becomes optional;
- a block whose text differs between pages becomes a slot; text equal on all pages stays fixed.

Wrappers align with each other as pages do, so each partition folds its pages first, and the folds of a host are aligned MERGED at a
time in rounds; no host's pages meet in one task.

The wrapper decides by place: its fixed blocks on at least FIXED_PAGES pages, and slots that are mostly links, are template. Menus,
headers, footers, sidebars, notices, adverts, forms, comments and the like are also told by element, class or id, and where a page
has an article or main element, that is what template is looked for in by these names alone, as copies of an article on one
host would make it look fixed.

Parsing is lenient: unclosed elements end with their parent, unknown markup is skipped, text stays. Null or empty html gives an empty
text, as does a page without main text; a null url is host "". Repeated rows and null ids are extracted each; a very long page is
read whole; an empty table gives an empty one; columns besides page_id, url and html, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._core import BROADCAST_BYTES, parts, written

#: Pages on which text outside an article has to be the same to count as template; share of link text that makes a menu.
FIXED_PAGES, LINKS = 3, 0.6
#: Most blocks or groups in a repeated group; items held in a partition before they are handed on; wrappers aligned in a task's row
#: of a round; salts of a host's pages where wrappers are too many to broadcast.
GROUP, HELD, MERGED, SALTS = 8, 50_000, 32, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b(?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?|<[!?][^>]*+>?|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
# Elements that stand in a line of text, elements without content, template elements, and words of classes and ids.
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROP = set("nav header footer aside form menu dialog button fieldset head".split())
_BOILER = re.compile(
    r"(?:^|[-_ ])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|aside|comment|comments|reply|replies|respond|disqus|ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|"
    r"cookie|cookies|consent|notice|notices|banner|alert|gdpr|share|sharing|social|related|recommended|subscribe|subscription|newsletter|signup|login|search|breadcrumb|breadcrumbs|pagination|pager|popup|modal|overlay|widget|toolbar|skip|copyright|legal|tags|meta)(?:$|[-_ \d])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[-_ ])(?:comment|comments|reply|replies|respond|disqus)(?:$|[-_ \d])", re.I)
_MAIN = {"article", "main"}
_HEADING = re.compile(r"h[1-6]$")
_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

OPTIONAL, REPEATED = 1, 2
#: Places in an item: of all, of a block, of a group.
KEY, FLAGS, PAGES, WHAT = range(4)
FIXED, CHARS, LINKED, AT, TAG, ROLE = range(6)


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", url or "", re.I)
    return found.group(1).rpartition("@")[2].partition(":")[0].lower() if found else ""


class _Element:
    """An open element: the hash of its path and what the names on the path tell of its text."""

    __slots__ = ("name", "path", "main", "dropped", "heading_only")

    def __init__(self, name: str, above: _Element | None, attributes: str) -> None:
        self.name = name
        self.main, self.dropped, self.heading_only = (above.main, above.dropped, above.heading_only) if above else (False, "", False)
        marks, label = [], name
        if "=" in attributes:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            ids, classes = (_DIGITS.sub("0", " ".join(sorted(found.get(k, "").split()))) for k in ("id", "class"))
            marks = [m for m in (ids, classes, found.get("role", "")) if m]
            label = f"{name}#{ids}.{classes}@{found.get('role', '')}"
        self.path = xxhash.xxh64_intdigest(label, (above.path if above else 0)) >> 1
        if name in ("html", "body"):
            return
        if any(map(_COMMENTS.search, marks)):
            self.dropped = "comments"
        elif name in _MAIN or "main" in marks:
            self.main = True
            if self.dropped == "marks":  # a layout's name around an article says little
                self.dropped = ""
        elif name == "header" and self.main:
            self.heading_only = True
        elif name in _DROP:
            self.dropped = "element"
        elif any(map(_BOILER.search, marks)):
            self.dropped = self.dropped or "marks"

    def role(self) -> str:
        """main, drop or other."""
        if self.dropped or self.heading_only and not _HEADING.match(self.name):
            return "drop"
        return "main" if self.main else "other"


Block = tuple[int, str, str, int, str]
_ROOT = _Element("", None, "")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: path, element, role, characters in links, and text with white space folded."""
    out: list[Block] = []
    stack: list[_Element] = []
    text: list[str] = []
    links, in_link = 0, False

    def end() -> None:
        nonlocal links
        if text:
            if folded := " ".join(html.unescape("".join(text)).split()):
                at = stack[-1] if stack else _ROOT
                out.append((at.path, at.name, at.role(), min(links, len(folded)), folded))
            text.clear()
        links = 0

    open_: dict[str, int] = {}  # how many elements of a name are open

    def cut(k: int) -> None:
        for x in stack[k:]:
            open_[x.name] -= 1
        del stack[k:]

    for found in _TOKEN.finditer(page):
        token = found.group()
        if token[0] != "<" or token == "<":
            text.append(token)
            if in_link:
                links += len(token.strip())
            continue
        name = found.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                in_link = not found.group(2)
            elif name == "br":
                text.append(" ")
            continue
        end()
        if found.group(2):
            if open_.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                cut(k)
            in_link = False
        else:
            if stack and stack[-1].name == "p":
                cut(len(stack) - 1)
            if name in _CLOSES and open_.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in _CLOSES[name]:
                        break
                    if stack[k].name == name:
                        cut(k)
                        break
            if name not in _VOID and not found.group(4).endswith("/"):
                stack.append(_Element(name, stack[-1] if stack else None, found.group(4)))
                open_[name] = open_.get(name, 0) + 1
    end()
    return out


# Items of a wrapper or page: [key, flags, pages, [text's checksum or -1 for a slot, characters, in links, blocks of the page, element,
# role]] for a block and [key, flags, pages, [items]] for a group.


def _group_key(items: list) -> int:
    return xxhash.xxh64_intdigest(",".join(str(x[KEY]) for x in items)) >> 1


def _is_group(item: list) -> bool:
    return isinstance(item[WHAT][0], list)


def _joined(a: list, b: list, same_page: bool, inside: bool = False) -> list:
    """Two items of one key as one; of one page, where one follows the other unless inside groups that do, or of two."""
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    flags = a[FLAGS] & b[FLAGS] | REPEATED if same_page and not inside else a[FLAGS] | b[FLAGS]
    if _is_group(a):
        return [a[KEY], flags, pages, [_joined(x, y, same_page, True) for x, y in zip(a[WHAT], b[WHAT], strict=True)]]
    x, y = a[WHAT], b[WHAT]
    return [a[KEY], flags, pages, [x[FIXED] if x[FIXED] == y[FIXED] else -1, x[CHARS] + y[CHARS], x[LINKED] + y[LINKED], x[AT] + y[AT], *x[TAG:]]]


def folded(items: list, groups: dict[int, int]) -> list:
    """Items with repeats as repeated groups; what stands once in the form of a known group (key, size) becomes that group."""
    out: list = []
    for item in items:
        out.append(item)
        again = True
        while again:
            again = False
            if len(out) > 1 and out[-1][KEY] == out[-2][KEY]:
                out[-2:] = [_joined(out[-2], out[-1], True)]
                again = True
                continue
            for size in range(2, GROUP + 1):
                if len(out) < size:
                    break
                last = out[-size:]
                key = _group_key(last)
                whole = [key, 0, max(x[PAGES] for x in last), last]
                if len(out) > size and out[-size - 1][KEY] == key:
                    out[-size - 1 :] = [_joined(out[-size - 1], whole, True)]
                elif len(out) >= 2 * size and all(x[KEY] == y[KEY] for x, y in zip(out[-2 * size : -size], last, strict=True)):
                    before = out[-2 * size : -size]
                    out[-2 * size :] = [_joined([key, 0, max(x[PAGES] for x in before), before], whole, True)]
                elif key in groups:
                    out[-size:] = [whole]
                else:
                    continue
                again = True
                break
    return out


def groups_of(items: list) -> dict[int, int]:
    """The groups among items and in them: key and size."""
    found: dict[int, int] = {}
    for x in items:
        if _is_group(x):
            found |= {x[KEY]: len(x[WHAT])} | groups_of(x[WHAT])
    return found


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """The alignment: of the pairs of k-th occurrences of equal keys, the longest run that increases on both sides."""
    seen: dict[int, int] = {}
    where: dict[tuple[int, int], int] = {}
    for j, x in enumerate(b):
        seen[x[KEY]] = seen.get(x[KEY], 0) + 1
        where[x[KEY], seen[x[KEY]]] = j
    seen.clear()
    ends: list[int] = []
    chain: list[tuple[int, int, int]] = []  # i, j, and the chain entry before
    last: list[int] = []
    for i, x in enumerate(a):
        seen[x[KEY]] = seen.get(x[KEY], 0) + 1
        j = where.get((x[KEY], seen[x[KEY]]))
        if j is None:
            continue
        k = bisect_left(ends, j)
        chain.append((i, j, last[k - 1] if k else -1))
        ends[k : k + 1], last[k : k + 1] = [j], [len(chain) - 1]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = chain[at]
        out.append((i, j))
    return out[::-1]


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers, or of one and a page's folded items."""
    if not a or not b:
        return [[x[KEY], x[FLAGS] | OPTIONAL, *x[PAGES:]] for x in a or b]
    a, b = folded(a, groups_of(b)), folded(b, groups_of(a))
    b = folded(b, groups_of(a))
    out, i, j = [], 0, 0
    alone = lambda x: [x[KEY], x[FLAGS] | OPTIONAL, *x[PAGES:]]
    for x, y in [*matched(a, b), (len(a), len(b))]:
        out += map(alone, a[i:x])
        out += map(alone, b[j:y])
        if x < len(a):
            out.append(_joined(a[x], b[y], False))
        i, j = x + 1, y + 1
    return folded(out, {})


def page_items(page: list[Block], keep: bool = False) -> list:
    """A page's blocks as folded items; with their places if keep."""
    items = [[path, 0, 1, [zlib.crc32(text.encode("utf-8", "replace")), len(text), links, [k] if keep else [], tag, role]] for k, (path, tag, role, links, text) in enumerate(page)]
    return folded(items, {})


def expression(items: list) -> str:
    """A wrapper as one union-free regular expression: elements with text or #text slots, groups, ?, + and *."""
    out = []
    for x in items:
        inside = expression(x[WHAT]) if _is_group(x) else f"{x[WHAT][TAG]}:{'#text' if x[WHAT][FIXED] < 0 else 'text'}"
        out.append(("(" + inside + ")" if _is_group(x) else inside) + ("", "?", "+", "*")[x[FLAGS]])
    return " ".join(out)


def _is_template(block: list) -> bool:
    _, _, pages, (fixed, chars, links, _, _, role) = block
    return role == "other" and (fixed >= 0 and pages >= FIXED_PAGES or links > LINKS * chars)


def _any_template(items: list) -> bool:
    return any(_any_template(x[WHAT]) if _is_group(x) else _is_template(x) for x in items)


def template_places(wrapper: list, page: list[Block]) -> set[int]:
    """The blocks of a page that stand at template places of the wrapper."""
    items = folded(page_items(page, True), groups_of(wrapper))
    known = folded(wrapper, groups_of(items))
    todo = [(known[i], items[j]) for i, j in matched(known, items)]
    out: set[int] = set()
    while todo:
        rule, item = todo.pop()
        if _is_group(rule):
            todo += zip(rule[WHAT], item[WHAT], strict=True)
        elif _is_template(rule):
            out.update(item[WHAT][AT])
    return out


SCHEMA = "host string, part long, pages long, wrapper string"


def _rows(found: dict[str, tuple[int, list]], part: int) -> pa.RecordBatch:
    hosts = sorted(found)
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts, pa.string()), pa.array([part] * len(hosts), pa.int64()), pa.array([found[h][0] for h in hosts], pa.int64()), pa.array([json.dumps(found[h][1], separators=(",", ":")) for h in hosts], pa.string())],
        names=["host", "part", "pages", "wrapper"],
    )


def _taken(found: dict[str, tuple[int, list]], host: str, pages: int, items: list) -> int:
    """Aligns items with the host's wrapper so far; how many items it has more."""
    if host not in found:
        found[host] = pages, items
        return len(items)
    before = found[host]
    found[host] = before[0] + pages, align(before[1], items)
    return len(found[host][1]) - len(before[1])


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, tuple[int, list]] = {}
    held, number = 0, 0
    for batch in batches:
        for part in parts(batch, 1):
            for url, page, number in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                held += _taken(found, host_of(url), 1, page_items(blocks(page.as_py() or "")))
            if held > HELD:
                yield _rows(found, number)
                found, held = {}, 0
    if found:
        yield _rows(found, number)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and part; one wrapper of each is held."""
    now, found = None, {}
    for batch in batches:
        for host, part, pages, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, part) != now and found:
                yield _rows(found, now[1])
                found = {}
            now = host, part
            _taken(found, host, pages, json.loads(wrapper))
    if found:
        yield _rows(found, now[1])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper (JSON, as expression() reads it) of every host of pages(url, html)."""
    rows = pages.select(F.col("url").cast("string"), F.col("html").cast("string"), F.monotonically_increasing_id().alias("part"))
    out = written(rows.mapInArrow(_inferred, SCHEMA))
    while (most := out.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        order = F.row_number().over(Window.partitionBy("host").orderBy("part")) - 1
        dealt = out.withColumn("part", F.floor(order / MERGED).cast("long")) if most > MERGED else out.withColumn("part", F.lit(0).cast("long"))
        out = written(dealt.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_merged, SCHEMA))
    return out.select("host", "pages", "wrapper")


def main_text(page: str, wrapper: list, known: dict | None = None) -> str:
    """The main text of a page under its host's wrapper; known remembers what streams of one form gave."""
    found = blocks(page)
    if any(x[2] == "main" for x in found):
        return " ".join(x[4] for x in found if x[2] == "main")
    if not wrapper:
        return " ".join(x[4] for x in found if x[2] != "drop")
    form = tuple(x[0] for x in found)
    if known is None or form not in known:
        out = template_places(wrapper, found)
        if known is not None:
            known[form] = out
    else:
        out = known[form]
    return " ".join(x[4] for k, x in enumerate(found) if x[2] != "drop" and k not in out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loaded: dict[str, tuple[list, dict]] = {}
    for batch in batches:
        for part in parts(batch, 2):
            texts = []
            for page, wrapper in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                if len(loaded) > 10_000:
                    loaded.clear()
                key = wrapper or ""
                if key not in loaded:
                    loaded[key] = json.loads(wrapper) if wrapper else [], {}
                rules, known = loaded[key]
                if len(known) > 1000:
                    known.clear()
                texts.append(main_text(page.as_py() or "", rules, known))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _with_template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrappers (host, wrapper) that have template places."""
    for batch in batches:
        yield batch.filter(pa.array([_any_template(json.loads(x)) for x in batch.column(1).to_pylist()], pa.bool_()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html)."""
    ruled = written(wrappers(pages).select("host", "wrapper").mapInArrow(_with_template, "host string, wrapper string"))
    size = ruled.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#\s@]*@)?([^/?#\s:@]*)", 1))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(ruled), "host", "left")
    else:  # the pages of a large host are dealt to several tasks
        salted = ruled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.spark_partition_id() % SALTS).join(salted, ["host", "salt"], "left")
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.select("page_id", "url", "html", "wrapper").mapInArrow(_extracted, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
