"""Main text of web pages, with site templates removed by recurrence.

Every page is parsed to a tree and every element's subtree is hashed (tag, class and contents). Spark
counts on how many pages of its host a subtree stands; one that stands on at least MIN_PAGES pages and
SHARE of the host's pages is template and goes. Inside an article that rule spares running text (paragraphs,
headings, quotes, tables, inline elements), as articles share passages. What names itself a menu,
header, footer, sidebar, notice, advert, form, script, style or reader comments goes in any case; outside of articles also
what names itself a list of related or shared things, a search or a widget. What is left of all articles that stand in no other
(else main, else body, where blocks of links go too) is the text.

Counting is by (host, hash) with sums made in the workers first; a host's list of templates holds at most
1/SHARE times the subtrees of a page, and reaches the pages by join_by_key, which spreads a hot host's pages.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; broken markup is
repaired as browsers do in the main points (implied ends, stray ends, raw script text, an unclosed tag is
text); pages of any length are parsed whole; repeated pages each get a row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import join_by_key, small_batches, written

MIN_PAGES, SHARE = 5, 0.3

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*?)>""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RUNNING = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tr td th dl dt dd li br figure figcaption".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
GONE = frozenset("head script style noscript template nav footer aside form button select textarea input iframe svg canvas object embed applet menu dialog title audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that name what is no main text, wherever it stands.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies notice notices consent gdpr popup modal overlay newsletter sidebar comment comments disqus replies breadcrumb breadcrumbs menu nav navbar navigation footer masthead topbar".split()
)
#: The same, but within an article such a block may be part of it.
OUTER_WORDS = frozenset("promotion subscribe subscription signup share sharing social related recommended recommendations trending reply respond pagination pager toolbar login search widget widgets skip".split())


class Page:
    """A parsed page. Nodes are numbered in page order; a text belongs to the node around it."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent, self.last = ["#"], [""], [0], [0]
        self.items: list[tuple[int, str | int]] = []  # (node, text) or (child, -1) as it begins
        stack = [0]

        def pop_to(i: int) -> None:
            for n in stack[i:]:
                self.last[n] = len(self.tag) - 1
            del stack[i:]

        def close(names, fence=frozenset()) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in names:
                    return pop_to(i)
                if self.tag[stack[i]] in fence:
                    return None

        at, find, size = 0, TOKEN.search, len(source)
        while at < size and (m := find(source, at)):
            if m.start() > at:
                self.items.append((stack[-1], source[at : m.start()]))
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if m[1]:
                if name == "p" and "p" not in (self.tag[n] for n in stack):
                    continue
                close((name,), FENCE - {name} if name in INLINE or name in ("p", "li", "td", "th", "tr") else frozenset())
                continue
            if name in CLOSES_P:
                close(("p",), FENCE)
            if name in SAME:
                close(SAME[name], frozenset(("ul", "ol", "table", "dl", "select")) if name != "tr" else frozenset(("table",)))
            n = len(self.tag)
            self.tag.append(name)
            self.attrs.append(m[3])
            self.parent.append(stack[-1])
            self.last.append(n)
            self.items.append((n, -1))
            if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
                continue
            if raw := RAW.get(name):
                end = raw.search(source, at)
                self.items.append((n, source[at : end.start() if end else size]))
                at = source.find(">", end.start()) + 1 or size if end else size
                continue
            stack.append(n)
        if at < size:
            self.items.append((stack[-1], source[at:]))
        pop_to(0)

    def marks(self, n: int) -> tuple[set[str], bool]:
        """The words of the node's class and id, and whether its role or state rules it out."""
        if not self.attrs[n].strip(" /"):
            return set(), False
        words, out = set(), False
        for k, v in ATTR.findall(self.attrs[n]):
            k, v = k.lower(), v.strip("\"'")
            if k in ("class", "id"):
                words.update(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", v).lower()))
            elif k == "role":
                out |= v.lower() in ROLES
            elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
                out = True
        return words, out

    def hashes(self) -> list[int]:
        """A signed 64-bit hash of each node's subtree."""
        parts: list[list[str]] = [[t, " ".join(sorted(self.marks(i)[0]))] for i, t in enumerate(self.tag)]
        kids: list[list] = [[] for _ in self.tag]
        for n, t in self.items:
            if t == -1:
                kids[self.parent[n]].append(n)
            elif s := " ".join(t.split()):
                kids[n].append(s)
        out = [0] * len(self.tag)
        for n in range(len(self.tag) - 1, -1, -1):
            own = "\x00".join((*parts[n], *(f"\x01{out[k]}" if isinstance(k, int) else k for k in kids[n])))
            out[n] = xxhash.xxh64_intdigest(own.encode("utf-8", "replace")) - (1 << 63)
        return out

    def text(self, templates: frozenset[int] | set[int]) -> str:
        tags, n_nodes = self.tag, len(self.tag)
        named = [t in GONE for t in tags]
        in_article = [False] * n_nodes
        hashed = self.hashes() if templates else []
        gone = [False] * n_nodes
        for n in range(1, n_nodes):
            p = self.parent[n]
            in_article[n] = in_article[p] or tags[n] == "article"
            words, out = self.marks(n)
            heads = (tags[n] == "header" or "header" in words) and not in_article[n]
            template = bool(templates) and hashed[n] in templates and not (in_article[n] and tags[n] in RUNNING) and tags[n] not in ("html", "body", "article", "main")
            own = tags[n] not in ("html", "body") and (named[n] or out or heads or bool(words & WORDS) or not in_article[p] and bool(words & OUTER_WORDS))
            gone[n] = gone[p] or own or template
        sizes = [0] * n_nodes
        linked = [0] * n_nodes
        for n, t in self.items:
            if t != -1 and not gone[n]:
                sizes[n] += len(t)
        for n in range(n_nodes - 1, 0, -1):
            linked[n] = sizes[n] if tags[n] == "a" else linked[n]
            sizes[self.parent[n]] += sizes[n]
            linked[self.parent[n]] += linked[n]
        roots: list[int] = []
        for kind in ("article", "main"):
            for n in range(1, n_nodes):  # in page order; what stands within a root belongs to it
                if not gone[n] and sizes[n] and not (roots and n <= self.last[roots[-1]]) and (tags[n] == kind or kind == "main" and "main" in self.attrs[n] and self._is_main(n)):
                    roots.append(n)
            if roots:
                break
        out: list[str] = []
        within = [not roots] * n_nodes
        for r in roots:
            within[r : self.last[r] + 1] = [True] * (self.last[r] + 1 - r)
        lists = [False] * n_nodes
        if not roots:
            for n in range(1, n_nodes):
                lists[n] = lists[self.parent[n]] or tags[n] in ("ul", "ol", "div", "section", "table", "p") and sizes[n] > 0 and linked[n] > 0.6 * sizes[n]
        before = roots[0] if roots else 0
        for n, t in self.items:
            if not within[n]:
                continue
            if before != n:  # a boundary of a block between two texts parts them
                if tags[n] not in INLINE or tags[before] not in INLINE:
                    a, b = before, n
                    if self._parts(a, b):
                        out.append(" ")
                before = n
            if t == -1:
                if tags[n] == "br" or tags[n] not in INLINE:
                    out.append(" ")
            elif not gone[n] and not lists[n]:
                out.append(html.unescape(t))
        return " ".join("".join(out).split())

    def _is_main(self, n: int) -> bool:
        return bool(re.search(r"""\brole\s*=\s*["']?main\b""", self.attrs[n]))

    def _parts(self, a: int, b: int) -> bool:
        """Whether a block begins or ends between a place in node a and a later one in node b."""
        up = set()
        n = a
        while True:
            up.add(n)
            if n == 0:
                break
            n = self.parent[n]
        n, block = b, False
        while n not in up:
            block |= self.tag[n] not in INLINE
            n = self.parent[n]
        while a != n:
            block |= self.tag[a] not in INLINE
            a = self.parent[a]
        return block


def _host(url: str | None) -> str:
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()


def templates(pages: DataFrame, url: str = "url", source: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, n_pages, hashes): the subtrees that recur over each host's pages, for hosts that have such."""
    import pyarrow as pa

    def count(batches):
        for b in batches:
            seen: Counter = Counter()
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = _host(u)
                seen[host, None] += 1
                seen.update((host, x) for x in set(Page(h or "").hashes()[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "hash", "n"])

    counts = small_batches(pages).select(url, source).mapInArrow(count, "host string, hash long, n long").groupBy("host", "hash").agg(F.sum("n").alias("n"))
    # a template stands on min_pages pages at least: what stands on fewer goes before the hosts meet
    some = written(counts.where(F.col("hash").isNull() | (F.col("n") >= min_pages)), "subtrees")
    hosts = some.groupBy("host").agg(F.max(F.when(F.col("hash").isNull(), F.col("n"))).alias("n_pages"), F.count(F.lit(1)).alias("entries"))
    often = join_by_key(some.where(F.col("hash").isNotNull()), hosts, ["host"], "entries", some.count(), "inner").where(F.col("n") >= share * F.col("n_pages"))
    return often.groupBy("host").agg(F.max("n_pages").alias("n_pages"), F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """One row for each page: key, url and text."""
    import pyarrow as pa

    found = written(templates(pages, url, source, min_pages, share), "templates")
    total = pages.count()
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(F.regexp_replace(u, r"(?s)^.*?://", ""), r"^(?:[^/?#]*@)?([^/?#@]*)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), host.alias("host"))
    rows = join_by_key(rows, found, ["host"], "n_pages", total)

    def run(batches):
        for b in batches:
            known: dict[tuple, frozenset] = {}
            texts = []
            for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = known.setdefault(tuple(x or ()), frozenset(x or ()))
                texts.append(Page(h or "").text(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[key, "url", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return small_batches(rows).select("key", "url", "html", "hashes").mapInArrow(run, f"`{key}` {kind}, url string, text string")
