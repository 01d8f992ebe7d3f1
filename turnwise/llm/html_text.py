"""Main text of web pages by consensus paths.

Each page's containers are scored and vote, with their generalised tag-class path, for where the text of their host stands. Spark sums the
votes; every page is then read again with its host's winning path, and with its own best container where that path is absent. All containers
on the path give their text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_rows, written

#: Containers of a page that vote.
VOTES = 3
#: Percent of a page's text outside links that its best container holds at least, where no article or main holds most of it.
COVERS = 85
#: Steps of a path that are compared.
PATH_STEPS = 64
#: Hosts up to which the winning paths are broadcast (each a few hundred bytes); beyond that they are joined by a shuffle.
BROADCAST_HOSTS = 100_000

_MARK = re.compile(
    r"""<!--(?:.*?--!?>|.*)"""
    r"""|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attributes2>[^>]*+)>"""
    r"""|<[/!?][^>]*+>"""
    r"""|<[a-z/!?][^>]*+\Z""",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?P<name>class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?(?=[\s/>]|\Z)""", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
_HOST = re.compile(r"://([^/?#]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article blockquote body center div main section table tbody td tr".split())
NOISE_TAGS = frozenset("aside audio button canvas datalist dialog footer head header input label menu nav object select svg video".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "discussion feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification notifications pager pagination paywall "
    "popup promo promoted promotion recommended recommendations related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription teaser toolbar widget".split()
)
#: In a class or id beside a noise word: the element may hold more than the noise.
HOLDER_WORDS = frozenset("container layout page wrap wrapper".split())
#: What readers say is noise however long it is.
READER_WORDS = frozenset("comment comments discussion disqus feedback replies respond".split())
#: After a noise word in one name: still that noise (``share-buttons``). Any other word after it makes a name of its own (``share-price``).
PART_WORDS = frozenset(
    "area bar block blocks body bottom box btn button buttons card cards center column content count entries entry feed form grid group head "
    "heading icon icons inline inner item items left link links list listing main message middle outer overlay panel post posts right row "
    "section slot stories story strip text thread title top unit".split()
) | HOLDER_WORDS
#: Before a noise word: the element only says whether there is such a thing elsewhere.
TELLING_WORDS = frozenset("has no with without".split())
LISTED = frozenset("dd dt figcaption li".split())
NEVER_NOISE = frozenset("html body main article".split())
#: Tags that end an open element of the same group.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    step: str
    noise: bool
    first: int
    container: int
    listed: bool = False
    in_article: bool = False
    in_header: bool = False
    in_link: bool = False
    doubtful: bool = False
    said: bool = False
    labelled: bool = False
    after: int = -1
    score: float = 0.0
    text: int = 0
    linked: int = 0


@dataclass
class Page:
    """Nodes in page order, and the runs of text outside noise; a break is a run of one line end. A node covers the runs [first, after)."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)

    def text(self, node: Node) -> str:
        return " ".join("".join(self.runs[node.first : node.after]).split())

    def path(self, node: Node) -> str:
        """The steps to a node, the nearest ``PATH_STEPS`` of them, and how many go before these."""
        steps, more = [node.step], node.depth - PATH_STEPS + 1
        while node.parent >= 0 and len(steps) < PATH_STEPS:
            node = self.nodes[node.parent]
            steps.append(node.step)
        return (f"{more}>" if more > 0 else "") + ">".join(reversed(steps))


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w]


def _label(attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether a name among the classes and the id is one of noise, whether a noise word stands in one of them at all, and whether that is
    about readers' comments."""
    named = found = said = False
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = _words(name)
        at = [k for k, w in enumerate(words) if w in NOISE_WORDS and not (k and words[k - 1] in TELLING_WORDS)]
        found = found or bool(at)
        if at and all(w in PART_WORDS for w in words[at[-1] + 1 :]):
            named = True
            said = said or words[at[-1]] in READER_WORDS
    return named, found, said


def _noise(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is noise by what it is, whether it may be (what it encloses decides), and whether it is about readers' comments.

    A name is never enough to make noise of what holds the page's article, its title or nearly all of its text. Within an article only
    names that end in a noise word are asked about.
    """
    if tag in NOISE_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true" or _UNSEEN.search(attributes.get("style", "")):
        return True, False, False
    if tag in NEVER_NOISE:
        return False, False, False
    role = attributes.get("role", "").lower()
    if role in NOISE_ROLES and role != "form":
        return True, False, False
    named, found, said = _label(attributes)
    return False, named or tag == "form" or role == "form" or (found and not in_article), said


def _step(tag: str, classes: str) -> str:
    """A tag with its classes, digits generalised."""
    return ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", c.lower()) for c in classes.split()})])


def parse(source: str) -> Page:
    page = Page()
    nodes, runs = page.nodes, page.runs
    nodes.append(Node("html", -1, 0, "html", False, 0, 0))
    stack = [0]
    opened: Counter[str] = Counter()

    def text(piece: str) -> None:
        node = nodes[stack[-1]]
        if node.noise or not piece:
            return
        piece = html.unescape(piece)
        runs.append(piece)
        size = len(piece) - piece.count(" ")
        node.text += size
        if node.in_link:
            node.linked += size

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = nodes[stack.pop()]
            node.after = len(runs)
            opened[node.tag] -= 1

    def find(tags: set | frozenset, barrier: frozenset) -> int | None:
        if not any(opened[t] > 0 for t in tags):
            return None
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]].tag
            if tag in tags:
                return depth
            if tag in barrier:
                return None
        return None

    at = 0
    for m in _MARK.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            runs.append("\n")
        if m["end"] or m["end2"]:
            depth = find({tag}, frozenset())
            if depth is not None and tag != "html":
                close(depth)
            continue
        if tag == "html":
            continue
        if tag in ENDS_P and (depth := find({"p"}, frozenset({"table", "td", "th", "button", "object"}))) is not None:
            close(depth)
        if tag in ENDS and (depth := find(ENDS[tag], frozenset({"ul", "ol", "dl", "table", "select"}))) is not None:
            close(depth)
        if tag in VOID:
            continue
        raw = m["attributes"] or m["attributes2"] or ""
        attributes = {a["name"].lower(): a["a"] or a["b"] or a["c"] or "" for a in _ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw.lower() else {}
        parent = nodes[stack[-1]]
        own_noise, doubtful, said = _noise(tag, attributes, parent.in_article)
        noise = parent.noise or own_noise
        opens = tag == "header" and parent.in_article and not parent.noise
        header = opens or (parent.in_header and not own_noise and not doubtful)
        if header and (tag in HEADINGS or tag == "p"):
            noise = False  # the title and the lead of an article may stand in its own header
        in_article = parent.in_article or tag in ("article", "main")
        self_closed = raw.rstrip().endswith("/") and tag not in BLOCK
        own = tag in CONTAINERS
        nodes.append(
            Node(
                tag, stack[-1], parent.depth + 1, _step(tag, attributes.get("class", "")), noise, len(runs),
                container=len(nodes) if own else parent.container, listed=not own and (parent.listed or tag in LISTED),
                in_article=in_article, in_header=header, in_link=parent.in_link or tag == "a",
                doubtful=doubtful and not noise, said=said, labelled=tag in ("article", "main") and _label(attributes)[0],
            )
        )
        if self_closed:
            nodes[-1].after = len(runs)
        else:
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    text(source[at:])
    close(0)
    _settle(page)
    _score(page)
    return page


def _settle(page: Page) -> None:
    """What becomes of forms and of elements named after noise.

    They are noise unless they enclose the page's articles (or main); on pages without such, unless they enclose the titles and ``COVERS``
    percent of the text outside links; and within an article, unless nothing but titles would be left of it. An element about readers'
    comments is no exception within an article. The smallest are judged first.
    """
    nodes = page.nodes
    doubtful = [k for k, node in enumerate(nodes) if node.doubtful]
    if not doubtful:
        return
    last, plain, heads = list(range(len(nodes))), [node.text - node.linked for node in nodes], [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag in HEADINGS:
            heads[k] = plain[k]
        above = nodes[k].parent
        last[above] = max(last[above], last[k])
        plain[above] += plain[k]
        heads[above] += heads[k]
    articles = [k for k, node in enumerate(nodes) if node.tag in ("article", "main") and not node.noise and not node.labelled]
    titles = [k for k, node in enumerate(nodes) if node.tag == "h1" and not node.noise]
    around = {}
    for k in doubtful:
        above = nodes[k].parent
        while above >= 0 and nodes[above].tag not in ("article", "main"):
            above = nodes[above].parent
        around[k] = above
    cut: set[int] = set()
    for k in sorted(doubtful, key=lambda k: (plain[k], -k)):
        within = [slice(bisect_left(places, k), bisect_right(places, last[k])) for places in (articles, titles)]
        if around[k] >= 0:
            holds = not nodes[k].said and nodes[k].tag != "form" and 0 < plain[k] - heads[k] == plain[around[k]] - heads[around[k]]
        elif articles:
            holds = within[0].stop - within[0].start == len(articles)
        else:
            holds = within[1].stop - within[1].start == len(titles) and 0 < COVERS * plain[0] <= 100 * plain[k]
        if holds:
            continue
        cut.add(k)
        del articles[within[0]], titles[within[1]]
        gone, title, above = plain[k], heads[k], nodes[k].parent
        while (gone or title) and above >= 0:
            plain[above] -= gone
            heads[above] -= title
            above = nodes[above].parent
    upto = -1
    for k in sorted(cut):
        if k <= upto:
            continue
        upto = last[k]
        for node in nodes[k : upto + 1]:
            node.noise, node.text, node.linked = True, 0, 0
        for at in range(nodes[k].first, nodes[k].after):
            page.runs[at] = "\n"


def _score(page: Page) -> None:
    """Text speaks for the container it stands in, and half as much for the container around that; links speak against."""
    nodes = page.nodes
    own = [0.0] * len(nodes)
    for node in nodes:
        plain = (node.text - node.linked) * (0.5 if node.listed else 1.0)
        if node.noise or plain <= 0:
            continue
        own[node.container] += plain
        if node.container:
            own[nodes[nodes[node.container].parent].container] += plain / 2
    for k in range(len(nodes) - 1, 0, -1):  # sums over subtrees
        parent = nodes[nodes[k].parent]
        parent.text += nodes[k].text
        parent.linked += nodes[k].linked
    for k, node in enumerate(nodes):
        if own[k] and node.text:
            bonus = 1.25 if node.tag in ("article", "main") else 1.0
            node.score = own[k] * bonus * (1 - node.linked / node.text)


def _best(page: Page) -> Node | None:
    """The article or main that holds most of the page's text outside links (an article that is alone in such a main before that), else
    the lowest container that holds ``COVERS`` percent of it."""
    nodes = page.nodes
    whole = nodes[0].text - nodes[0].linked
    if whole <= 0:
        return None
    marked = [n for n in nodes if n.tag in ("article", "main") and not n.noise]
    for node in marked:
        if 2 * (node.text - node.linked) > whole:
            inner = [n for n in marked if node.tag == "main" and n.tag == "article" and node.first <= n.first and n.after <= node.after and n.depth > node.depth]
            alone = [n for n in inner if n.after - n.first == max(m.after - m.first for m in inner)]
            titles = [n for n in nodes if n.tag == "h1" and not n.noise and node.first <= n.first and n.after <= node.after]
            within = [n for n in inner + titles if alone and alone[0].first <= n.first and n.after <= alone[0].after]
            if len(alone) == 1 and len(within) == len(inner) + len(titles) and 2 * (alone[0].text - alone[0].linked) > whole:
                return alone[0]
            return node
    holding = [n for n in nodes if (n.tag in CONTAINERS or n.parent < 0) and n.tag != "blockquote" and not n.noise and 100 * (n.text - n.linked) >= COVERS * whole]
    return max(holding, key=lambda n: n.depth)


def votes(source: str) -> list[tuple[str, float]]:
    """Paths of the best containers of a page: the best one's whole vote, and for the next half of their share of the best score."""
    page = parse(source)
    chosen = _best(page)
    if chosen is None:
        return []
    scored = sorted((n for n in page.nodes if n.score > 0), key=lambda n: (-n.score, n.first))
    best = {page.path(chosen): 1.0}
    for node in scored:
        if len(best) == VOTES:
            break
        best.setdefault(page.path(node), round(node.score / scored[0].score / 2, 3))
    return list(best.items())


def _title_before(page: Page, node: Node) -> str:
    """The text of an ``h1`` beside the container and before it, where the container has no title of its own (an ``h1``, or a heading
    before all its other text)."""
    nodes = page.nodes
    heads = [n for n in nodes if n.tag in HEADINGS and not n.noise and n.text]
    inside = [n for n in heads if node.first <= n.first and n.after <= node.after]
    if any(n.tag == "h1" or not "".join(page.runs[node.first : n.first]).strip() for n in inside):
        return ""
    before = [n for n in heads if n.tag == "h1" and n.parent == node.parent and n.after <= node.first]
    return " ".join(page.text(n) for n in before[-1:])


def extract(source: str, path: str | None) -> tuple[str, str | None]:
    """The text of all containers on ``path`` that hold text outside links, in page order, or of the page's best container, and the path of
    these. Where the best container is an article or main, a path that gives less than half of its text does not count. A title that
    stands before an article or main, and not in it, comes first."""
    page = parse(source)
    last = path.rpartition(">")[2] if path else None

    def on(step: str | None, path: str | None) -> list[Node]:
        return [n for n in page.nodes if n.step == step and not n.noise and n.text > n.linked and page.path(n) == path]

    best = _best(page)
    if best is None:
        return "", None
    chosen = on(last, path)
    covered = sum(n.text - n.linked for n in chosen)
    if not chosen or (best.tag in ("article", "main") and 2 * covered < best.text - best.linked):
        chosen = on(best.step, page.path(best))
    title = _title_before(page, chosen[0]) if chosen and chosen[0].tag in ("article", "main") else ""
    return (" ".join(filter(None, [title, *map(page.text, chosen)])), page.path(chosen[0])) if chosen else ("", None)


def host_of(url: bytes | None) -> str:
    found = _HOST.search((url or b"").decode())
    return found[1].lower() if found else ""


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): the path with most votes per host; of equal ones the first by name.

    Votes are summed per host and path before they are shuffled, so a host with a third of all pages is a few rows a task.
    """

    def make():
        def work(urls, sources):
            for u, h in zip(urls, sources, strict=True):
                yield host_of(u), [{"path": p, "vote": v} for p, v in votes((h or b"").decode())]

        return work

    found = map_rows(pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html")), make, "host string, votes array<struct<path:string,vote:double>>")
    cast = found.select("host", F.explode("votes").alias("v")).select("host", "v.path", F.round(F.col("v.vote") * 1000).cast("long").alias("vote"))
    sums = cast.groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("vote")).alias("v"), "path")).alias("best")).select("host", "best.path")


def main_text(pages: DataFrame, url: str = "url", source: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """``text`` and the ``path`` it was found at (null if there is no text), beside the struct ``row`` of the input's columns (``keep``: of
    those only).

    Null or empty pages, and pages without text outside noise, have the empty text. A null URL counts as the host ''. Repeated pages are
    read one by one (and vote each), an empty table gives an empty result, columns of any name may come along.
    """
    columns = [F.col(f"`{c}`") for c in (pages.columns if keep is None else keep)]
    given = pages.select(F.struct(*columns).alias("row"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"))
    paths = written(host_paths(pages, url, source), "host-paths").withColumnRenamed("path", "host_path")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))
    if paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    joined = given.withColumn("host", host).join(paths, "host", "left").select("row", "html", "host_path")

    def make():
        return lambda sources, found: [extract((h or b"").decode(), None if p is None else p.decode()) for h, p in zip(sources, found, strict=True)]

    return map_rows(joined, make, "text string, path string", carry=["row"])
