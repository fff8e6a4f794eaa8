"""Operator 2: main text of web pages, by a vote of each host's pages on the path of their main container."""

from __future__ import annotations

import hashlib
import html
import re
import string
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import cut, keep

# Element names of HTML by what they do to a text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav header footer aside button select option textarea input iframe svg canvas object audio video menu dialog label fieldset".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "html", "body"}
CONTAINERS = frozenset("article main section div td body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert".split())
#: Words of class and id names, between other letters' ends, that mark parts beside the article.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|widget\w*|related|recommend\w*|footer|"
    r"cookies?|consent|gdpr|notification|popup|modal|overlay|comments?|commentlist|respond|replies|reply|disqus|share\w*|sharing|social\w*|newsletter|subscribe|signup|login|"
    r"pagination|pager|toolbar|hidden)(?:$|[\s_-])",
    re.I,
)
#: Words that mark such parts outside an article, and its own lead within one.
TOP_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Words that mark such parts as often as articles on these things: see Page._doubted.
SLIGHT_WORDS = re.compile(r"(?:^|[\s_-])(?:notice|alert|side|discussion|copyright|legal|disclaimer|tags?|foot)(?:$|[\s_-])", re.I)
#: Elements that only an article has, and those that show that a form stands around a whole page.
OF_ARTICLE, OF_PAGE = frozenset({"article", "main", "h1"}), frozenset({"article", "main", "h1", "nav", "header", "footer"})
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+>?", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(hidden)(?=\s|/|$)")


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _skipped(tag: str, attr: dict[str, str], inside: bool, lenient: bool) -> bool:
    """Whether an element goes by its name or attributes. inside: within an article, whose headers hold its title and lead; lenient: no class words."""
    names = (attr.get("class", ""), attr.get("id", ""))
    if tag in SKIPPED:
        return not (tag == "header" and inside and not BESIDE.search(names[0]))
    if not attr or tag in ("html", "body", "article", "main"):
        return "hidden" in attr
    return (
        "hidden" in attr or attr.get("aria-hidden") == "true" or attr.get("role", "").lower() in ROLES
        or "display:none" in attr.get("style", "").replace(" ", "").lower()
        or not lenient and any(BESIDE.search(x) or not inside and TOP_WORDS.search(x) for x in names)
    )


def general(tag: str, attr: dict[str, str]) -> str:
    """A step of a path: the tag and its classes in order, with numbers as one sign so that page-specific classes agree."""
    names = sorted({re.sub(r"\d+", "0", c.lower()) for c in attr.get("class", "").split()})
    return tag + "".join(f".{c}" for c in names)


class Page:
    """The blocks of text outside skipped parts and the tree of containers they stand in.

    Containers of one path are one node: its number's parent and step (see general()) are numbers and short strings, so a page of any depth
    takes memory in proportion to its length. Parents have smaller numbers than their children; 0 is the page as a whole.
    """

    def __init__(self, page: str):
        self._start()
        self._read(page)
        if not self.blocks:  # class words may have taken all: they name the subject if a headline or an article was among it
            self._start()
            self._read(page, True)
            inside = self._articles()
            if not any(head or inside[node] for node, _, _, head in self.blocks):
                self.blocks = []
        n = len(self.parent)
        self.whole = [0] * n  # unlinked characters, of the node and below
        self.score = [0.0] * n  # those of the node itself and half of each child's score; article and main count double
        for node, _, full, _ in self.blocks:
            self.whole[node] += full
            self.score[node] += full
        for node in range(n - 1, 0, -1):
            self.whole[self.parent[node]] += self.whole[node]
            self.score[self.parent[node]] += self.score[node] / 2
        for node in range(1, n):
            self.score[node] *= 2 if self.tag(node) in ("article", "main") else 1

    def _start(self) -> None:
        self.parent, self.step, self.named = [0], [""], {}
        self.blocks: list[tuple[int, str, int, bool]] = []  # node, text, unlinked characters, whether a headline

    def tag(self, node: int) -> str:
        return self.step[node].split(".", 1)[0]

    def _node(self, parent: int, step: str) -> int:
        if (found := self.named.get((parent, step))) is None:
            found = self.named[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
        return found

    def _articles(self) -> list[bool]:
        """Whether each node is an article or main, or within one."""
        inside = [False] * len(self.parent)
        for k in range(1, len(self.parent)):
            inside[k] = inside[self.parent[k]] or self.tag(k) in ("article", "main")
        return inside

    def _doubted(self, parts: list[tuple[str, int, int, bool]]) -> None:
        """Takes out forms, and elements of doubtful class words (tag, first block, end, whether within an article) that aren't the article: those
        beside an article or main with text, and elsewhere those with no more than half of the page's unlinked characters."""
        inside = self._articles()
        article = any(full and inside[node] for node, _, full, _ in self.blocks)
        upto = [0, *accumulate(full for _, _, full, _ in self.blocks)]
        change = [0] * (len(self.blocks) + 1)
        for tag, begin, end, within in parts:
            if tag == "form" or (article and not within) or 2 * (upto[end] - upto[begin]) <= upto[-1]:
                change[begin] += 1
                change[end] -= 1
        self.blocks = [b for b, gone in zip(self.blocks, accumulate(change)) if not gone]

    def _read(self, page: str, lenient: bool = False) -> None:
        stack: list[tuple[str, int, bool, int, bool]] = []  # tag, node, within a skipped part, blocks before, whether it is doubted
        doubted: list[tuple[str, int, int, bool]] = []
        cleared: list[list] = []  # [tag, whether] of the open doubted elements: whether they hold what only an article or a page has
        opened: dict[str, int] = {}
        buffer: list[str] = []
        linked, node, skip, main = 0, 0, False, 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.blocks.append((node, text, max(0, len(text) - 2 * linked), bool(opened.get("h1"))))
            linked = 0

        def pop(k: int) -> None:
            nonlocal node, skip, main
            if any(t[0] in BLOCKS or t[4] for t in stack[k:]):
                flush()
            for tag, _, _, before, slight in reversed(stack[k:]):
                opened[tag] -= 1
                main -= tag in ("article", "main")
                if slight and not cleared.pop()[1]:
                    doubted.append((tag, before, len(self.blocks), main > 0))
            del stack[k:]
            node, skip = (stack[-1][1], stack[-1][2]) if stack else (0, False)

        def close(tag: str, within: frozenset[str] = frozenset()) -> None:
            if not opened.get(tag):
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    return pop(k)
                if stack[k][0] in within:
                    return None

        at, n, links = 0, len(page), 0
        while at < n:
            m = TOKEN.search(page, at)
            end = m.start() if m else n
            if end > at and not skip:
                buffer.append(page[at:end])
                linked += (end - at) * (links > 0)
            if not m:
                break
            at = m.end()
            tag, inner = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not tag:
                continue
            if m[1] or m[4]:
                links -= tag == "a" and links > 0
                if tag != "br":
                    close(tag, frozenset({"td", "th", "table"}) if tag in ("li", "p") else frozenset())
                continue
            if tag in VOID:
                if tag in ("br", "hr") and not skip:
                    buffer.append(" ") if tag == "br" else flush()
                continue
            if tag in CLOSES_P:
                close("p", frozenset({"td", "th", "li", "div", "article", "section", "main", "body", "table"}))
            elif tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                for other in {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, (tag,)):
                    close(other, frozenset({"ul", "ol", "table", "dl", "select", "div", "article"}))
            if tag in ("article", "main") and opened.get("nav"):
                close("nav")  # one that bad markup has left open
                links = 0
            if tag in BLOCKS:
                flush()
            attr = _attributes(inner)
            links += tag == "a"
            slight = False
            if not skip:
                if tag in OF_PAGE:
                    for c in cleared:
                        c[1] = c[1] or tag in OF_ARTICLE or c[0] == "form"
                skip = _skipped(tag, attr, main > 0, lenient)
                names = f"{attr.get('class', '')} {attr.get('id', '')}" if attr and tag not in ("html", "body", "article", "main") else ""
                slight = not skip and (tag == "form" or not lenient and bool(names) and bool(SLIGHT_WORDS.search(names)))
                if slight:
                    flush()
                    cleared.append([tag, False])
            if tag in CONTAINERS and not skip:
                node = self._node(node, general(tag, attr))
            if tag in RAW:
                over = re.compile(rf"</{tag}", re.I).search(page, at)
                at = over.start() if over else n
            stack.append((tag, node, skip, len(self.blocks), slight))
            opened[tag] = opened.get(tag, 0) + 1
            main += tag in ("article", "main")
            if inner.rstrip().endswith("/") and tag in ("svg", "iframe"):
                pop(len(stack) - 1)
        flush()
        pop(0)
        if doubted:
            self._doubted(doubted)

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.step[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def signs(self) -> list[int]:
        """A 64-bit hash of each node's path."""
        out = [0]
        for node in range(1, len(self.parent)):
            out.append(_sign(f"{out[self.parent[node]]}>{self.step[node]}"))
        return out

    def depth(self, node: int) -> int:
        n = 0
        while node:
            node, n = self.parent[node], n + 1
        return n

    def find(self, sign: int) -> int:
        """The node of a path's hash, 0 if it isn't here or has no text."""
        node = next((k for k, x in enumerate(self.signs()) if x == sign), 0)
        return node if node and self.within(node) else 0

    def best(self) -> int:
        """The node of the highest score, the deepest one among equals."""
        return max(range(1, len(self.parent)), key=lambda k: (self.score[k], k), default=0)

    def _inside(self, node: int) -> list[bool]:
        inside = [False] * len(self.parent)
        for k in range(len(self.parent)):
            inside[k] = k == node or (k > 0 and inside[self.parent[k]])
        return inside

    def climbed(self, node: int, repeated: frozenset[int] = frozenset()) -> int:
        """node, or the lowest container above it that has all of the text: an article over sibling containers stays whole. article and main end
        the climb; blocks outside node whose hash is in repeated don't count."""
        whole = self.whole
        if repeated:
            inside, whole = self._inside(node), [0] * len(self.parent)
            for k, text, full, head in self.blocks:
                whole[k] += full * (inside[k] or head or _sign(text) not in repeated)
            for k in range(len(whole) - 1, 0, -1):
                whole[self.parent[k]] += whole[k]
        out = node
        while self.parent[node] and self.tag(node) not in ("article", "main"):
            node = self.parent[node]
            out = node if whole[node] > whole[out] else out
        return out

    def within(self, node: int) -> list[str]:
        """The blocks of a node and of those below it."""
        inside = self._inside(node)
        return [b[1] for b in self.blocks if inside[b[0]]]

    def beside(self, node: int) -> set[int]:
        """Hashes of the blocks outside a node, but for headlines."""
        inside = self._inside(node)
        return {_sign(text) for k, text, _, head in self.blocks if not head and not inside[k]}

    def article(self, node: int, repeated: frozenset[int] = frozenset()) -> list[str]:
        """The blocks of a container and of what it was climbed() to, without those outside it that its host repeats; and where they hold no headline,
        one that stands before them in main."""
        own, wide = self._inside(node), self._inside(top := self.climbed(node, repeated))
        above, k = set(), top
        while k:
            k = self.parent[k]
            above.add(k)
        mains = [k for k in above if self.tag(k) == "main"]
        above = {k for k in above if mains and k >= min(mains)} if not any(head and wide[k] for k, _, _, head in self.blocks) else set()
        return [text for k, text, _, head in self.blocks if own[k] or (wide[k] and (head or not repeated or _sign(text) not in repeated)) or (head and k in above)]


def _sign(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host_of(url):
    """Between the first :// and the next /, ? or #, lower-cased; null or no ://: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url.substr(F.instr(url, "://") + 3, F.length(url)), "/", 1)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


#: Pages of a host, of different main texts, that have a block outside their main container when it is the host's own, at least; and their share of all.
REPEATED, SHARE = 3, 0.5


def votes(pages: DataFrame) -> DataFrame:
    """host, sign (of the path that most of the host's pages chose for their main container, the deepest among equals) and repeated: hashes of the
    blocks outside that container which at least REPEATED pages of different main texts and SHARE of all such pages have.

    Blocks are counted by pages' main texts, so copies of one page repeat nothing. As a block needs SHARE of the pages, a host's list is at
    most 1 / SHARE times as long as its pages have blocks beside their containers on average.
    """

    def run(batches):
        keep("html_extract")
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                tree = Page(page or "")
                node = tree.best()
                rows.append((tree.signs()[node], tree.depth(node), _sign("\n".join(tree.within(node))), list(tree.beside(node)) if node else []))
            sign, depth, main, beside = zip(*rows) if rows else ((), (), (), ())
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("host"), *(pa.array(x, t) for x, t in zip((sign, depth, main, beside), types))], ["host", "sign", "depth", "main", "beside"])

    chosen = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    chosen = cut(chosen.mapInArrow(run, "host string, sign long, depth int, main long, beside array<long>").where("depth > 0"))
    path = chosen.groupBy("host", "sign", "depth").agg(F.count("*").alias("n")).groupBy("host").agg(F.max_by("sign", F.struct("n", "depth", "sign")).alias("sign"))
    mains = chosen.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("mains"))
    block = chosen.select("host", "main", F.explode("beside").alias("block")).distinct().groupBy("host", "block").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    repeated = block.join(mains, "host").where(F.col("n") >= SHARE * F.col("mains")).groupBy("host").agg(F.collect_list("block").alias("repeated"))
    return path.join(repeated, "host", "left")


#: Characters of the path that is reported, and of all hosts' rows (with eight a hash) that are broadcast.
PATH, BROADCAST = 2_000, 32_000_000


def extract(pages: DataFrame, limit: int = 20_000) -> DataFrame:
    """page_id, url, text, n_chars, path, agreed: the blocks of the host's path, or of the page's own best path where the host's isn't there; on a
    page with text beside that container that its host doesn't repeat, of the one above that has both, less what the host repeats.

    Blocks are joined by a line feed in page order, white space inside them is one space. Null and empty pages and pages without text give
    an empty text; repeated rows give their texts again; extra columns aren't read. A page of any length or depth takes memory in proportion
    to its length. Hosts' paths and repeated blocks are hashes; those of up to limit hosts and BROADCAST characters are broadcast, more are
    joined by a shuffle of the pages (a host of very many pages is then split by Spark's handling of skewed joins).
    """
    hosts = cut(votes(pages))
    size = hosts.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + 8 * (F.greatest(F.size("repeated"), F.lit(0)) + 1)), F.lit(0))).first()
    hosts = F.broadcast(hosts) if size[0] <= limit and size[1] <= BROADCAST else hosts
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")).join(hosts, "host", "left")
    schema = "page_id long, url string, text string, n_chars long, path string, agreed boolean"

    def run(batches):
        keep("html_extract")
        for batch in batches:
            texts, used, agreed = [], [], []
            for page, sign, repeated in zip(*(batch.column(c).to_pylist() for c in ("html", "sign", "repeated"))):
                tree = Page(page or "")
                node = tree.find(sign) if sign is not None else 0
                agreed.append(node > 0)
                node = node or tree.best()
                texts.append("\n".join(tree.article(node, frozenset(repeated or ()))))
                used.append(tree.path(node)[:PATH])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string()), pa.array(agreed, pa.bool_())],
                ["page_id", "url", "text", "n_chars", "path", "agreed"],
            )

    return rows.select("page_id", "url", "html", "sign", "repeated").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
