"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: elements and text strings, each told apart by the path of open elements it stands under. Over all
pages of a host, a token's occurrence vector is how often each page holds it. Tokens of one vector form an
equivalence class; what each of its pages holds k times, like two paragraphs of a notice, counts as k tokens of the same vector.
Vectors are compared by fingerprints - the sums over pages of a hash of the page, once and times the count - so
they can be summed in any order, whatever the number of pages, and one hot host is summed by many tasks.

A class is valid if most of the host's pages have it, if it has two tokens at least (a sentence that happens to be on
many pages is alone; a notice comes with its element) and if the elements around its tokens are in valid classes too, so that
classes nest. Nested, they are the host's template: elements, and strings that it repeats. What it doesn't fix are slots, each the
part of an element outside of the template's elements within it. The smallest element that holds the slots' text is the article;
from its text go the template's strings and those of its elements that are menus (mostly links), notices (mostly
repeated strings) or named as boilerplate. Navigation, footers, forms and the like go by their tags, on any page.

A host of copied articles would see them as its template: if strings that repeat are most of its article's text, or most of a
page's, they stay.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, small_batches

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ROOMS = frozenset("html body main article section div center table td".split())
NEVER = frozenset("head nav header footer aside form button menu dialog".split()) | RAW
CLOSES_P = BLOCKS - {"body", "html", "td", "th"}
#: Words of class names and ids that mark what is not the article. A name counts if all its words are of these or of the neutral
#: ones: "related-posts" does, "related-work" does not. Those of the second group do not where a word of the article stands beside them.
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promotion cookie cookies consent notice notices newsletter "
    "subscribe popup modal comment comments commentlist replies respond disqus sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead share sharing "
    "social related recommended pagination pager toolbar".split()
)
_FRAME = frozenset("header footer".split())
_OWN = frozenset("article post entry content section story chapter body text".split())
_NEUTRAL = frozenset("page site main top bottom left right box block bar area slot unit list links link items item wrap wrapper container inner outer widget group row col module the global primary secondary posts articles icons buttons".split())
_COMMENTS = frozenset("comment comments commentlist replies".split())
_WORDS = re.compile(r"[^\W_]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_SPACE = re.compile(r"\s+")

#: A class is the host's template if this share of its pages has it, it has so many tokens, and the host so many pages.
SUPPORT, LEAST_TOKENS, LEAST_PAGES = 0.6, 2, 5
#: An element of the template is a menu if links hold this share of its text, and a notice if repeated strings do.
LINKS, REPEATED = 0.6, 0.8
#: Repeated strings that hold more than this share of a text are the text.
COPIES = 0.5


def events(page: str | None) -> Iterator[tuple]:
    """("open", tag, attributes), ("close", tag) and ("text", string) of a page; raw elements are passed over whole."""
    page = page or ""
    at, lower = 0, None
    while m := _PIECE.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag
            continue
        yield "open", tag, m[3]
        if tag in RAW and not m[3].rstrip().endswith("/"):
            lower = page.lower() if lower is None else lower  # same length: lower() of ASCII tags is all that matters
            end = lower.find("</" + tag, at) if len(lower) == len(page) else page.find("</" + m[2], at)
            if end < 0:
                return
            at = end
    if at < len(page):
        yield "text", page[at:]


def attributes(raw: str) -> dict[str, str]:
    return {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(raw)}


def named_aside(tag: str, names: list[str]) -> bool:
    """Whether one of an element's classes, or its id, says that it is not part of an article."""
    if tag in ("html", "body", "main"):  # their classes speak of the whole page
        return False
    for name in names:
        words = set(_WORDS.findall(name.lower()))
        if tag == "article":
            if words & _COMMENTS:
                return True
        elif words & _ASIDE and words <= _ASIDE | _FRAME | _NEUTRAL | _OWN or words & _FRAME and words <= _FRAME | _NEUTRAL:
            return True
    return False


class Walk:
    """A page's nodes in order: (path, "<tag>" or text, shut), where shut says that boilerplate encloses the node.

    Elements open and close as browsers do it for the cases that matter: void elements have no content, a block
    closes an open paragraph, li/dt/dd/tr/td/th/option close their like, and a close tag closes what is open within.
    """

    _LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
    _STOP = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

    def __init__(self, page: str | None, dropped: frozenset[str] = frozenset(), names: bool = True):
        """dropped: paths of elements that count as boilerplate; names: whether names of elements are looked at."""
        self.stack: list[tuple[str, str, bool]] = []  # tag, path, shut
        self.page, self.dropped, self.names = page, dropped, names

    def _down_to(self, k: int) -> None:
        del self.stack[k:]

    def nodes(self) -> Iterator[tuple[str, str | None, str, bool]]:
        """(path, tag or None for text, text, shut)"""
        for kind, *rest in events(self.page):
            if kind == "text":
                tag, path, shut = self.stack[-1] if self.stack else ("", "", False)
                if not shut or rest[0].strip():
                    yield path, None, rest[0], shut
                continue
            tag = rest[0]
            if kind == "close":
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] == tag:
                        self._down_to(k)
                        if tag in BLOCKS:
                            yield self.stack[-1][1] if self.stack else "", "/" + tag, "", False
                        break
                    if self.stack[k][0] in ("article", "main", "body", "td", "nav", "footer", "aside") and tag not in BLOCKS:
                        break
                continue
            if tag in CLOSES_P and any(t == "p" for t, _, _ in self.stack):
                k = max(i for i, (t, _, _) in enumerate(self.stack) if t == "p")
                if not any(t in ("table", "button", "object") for t, _, _ in self.stack[k:]):
                    self._down_to(k)
            elif tag in self._LIKE:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k][0] in self._STOP[tag]:
                        break
                    if self.stack[k][0] in self._LIKE[tag]:
                        self._down_to(k)
                        break
            known = attributes(rest[1]) if rest[1].strip() else {}
            names = [*(known.get("class") or "").split(), known.get("id") or ""] if self.names else []
            above, shut = (self.stack[-1][1], self.stack[-1][2]) if self.stack else ("", False)
            label = tag + ("." + ".".join(sorted(known["class"].split())) if known.get("class") else "") + ("#" + known["id"] if known.get("id") and not any(c.isdigit() for c in known["id"]) else "")
            path = f"{above}/{label}"
            own = tag in NEVER and tag not in ("header",) or tag == "header" and "/article" not in above and "/main" not in above
            own = own or path in self.dropped or bool(names) and named_aside(tag, names) or known.get("role", "").lower() in _ROLES or "hidden" in known or known.get("aria-hidden") == "true"
            own = own or "display:none" in known.get("style", "").replace(" ", "").lower()
            yield path, tag, "", shut or own
            if tag not in VOID:
                self.stack.append((tag, path, shut or own))


def clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", url or "")
    return (m[1].rpartition("@")[2].lower() if m else "").removeprefix("www.")


def token_counts(page: str | None, names: bool = True) -> tuple[Counter, dict[str, int]]:
    """How often the page has each token; and how many characters of text each element holds outside of boilerplate."""
    tokens: Counter = Counter()
    held: dict[str, int] = defaultdict(int)
    for path, tag, text, shut in Walk(page, names=names).nodes():
        if tag is None:
            if said := clean(text):
                tokens[path, said] += 1
                if not shut:
                    held[path] += len(said)
        elif tag[0] != "/":
            tokens[path, ""] += 1
    return tokens, held


def short(said: str) -> str:
    """A string as tokens name it: itself, or its hash if it is long."""
    import xxhash

    return said if len(said) <= 64 else "#" + xxhash.xxh64_hexdigest(said.encode("utf-8", "surrogatepass"))


def token_frames(names: bool = True):
    """For mapInArrow over (page_id, url, html): (host, path, string, pages, total, seen, print, chars) summed within runs of pages.

    Long strings stand as their hash, so a token's size is bounded. Each run also has the token ("", ""), which counts pages.
    chars is the text an element holds outside of boilerplate, and for a string all of its occurrences'.
    """
    import pyarrow as pa
    import xxhash

    def flush(sums):
        cols = list(zip(*((h, p, s, *v) for (h, p, s), v in sums.items()), strict=True))
        kinds = [pa.string()] * 3 + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "path", "string", "pages", "total", "seen", "print", "chars"])

    def run(batches):
        sums: dict[tuple[str, str, str], list[int]] = {}
        for b in batches:
            for page_id, url, page in zip(b.column(0), b.column(1), b.column(2), strict=True):
                host, url = host_of(url.as_py()), url.as_py()
                mark = xxhash.xxh64_intdigest(f"{page_id.as_py()} {url}", 11)
                tokens, held = token_counts(page.as_py(), names)
                tokens["", ""] += 1
                for (path, said), n in tokens.items():
                    at = sums.setdefault((host, path, short(said)), [0, 0, 0, 0, 0])
                    at[0] += 1
                    at[1] += n
                    at[2] = (at[2] + mark) & 0xFFFFFFFF  # sums of 32-bit prints cannot overflow 64 bits
                    at[3] = (at[3] + n * mark) & 0xFFFFFFFF
                    at[4] += n * len(said) if said else held.get(path, 0)
            if len(sums) > 200_000:
                yield flush(sums)
                sums = {}
        if sums:
            yield flush(sums)

    return run


def valid_classes(rows: list[tuple[str, str, int, int, int, int, int]], least_tokens: int = LEAST_TOKENS) -> list[list[tuple[str, str]]]:
    """Equivalence classes of a host's frequent tokens that make its template: those of enough tokens that nest in others.

    A class nests if the parent of each of its elements, and the element of each of its strings, is in a valid class; leaving
    one out can leave others without a parent, so this is repeated until it holds.
    """
    classes: dict[tuple[int, int, int], list[tuple[str, str]]] = defaultdict(list)
    for path, said, n, total, seen, mark, _ in rows:
        each = total // n  # of vectors whose entries are 0 or each, each is taken out
        even = total == each * n and (mark - each * seen) & 0xFFFFFFFF == 0
        classes[(n, n, seen & 0xFFFFFFFF) if even else (n, total, mark & 0xFFFFFFFF)].append((path, said))
    valid = [sorted(c) for c in classes.values() if len(c) >= least_tokens]
    while True:
        paths = {path for c in valid for path, said in c if not said}
        around = lambda path, said: path if said else path.rpartition("/")[0]
        nested = [c for c in valid if all(around(p, s) in paths or not around(p, s) for p, s in c)]
        if len(nested) == len(valid):
            return sorted(nested)
        valid = nested


def kind_of(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0].partition("#")[0]


def article_of(held: dict[str, int]) -> str | None:
    """The smallest element that holds all text of article and main elements, if that is half of all; or else nearly all text.
    held: characters of text directly in each element, outside of boilerplate."""
    below: Counter = Counter()
    for path, n in held.items():
        parts = path.split("/")
        for k in range(2, len(parts) + 1):
            below["/".join(parts[:k])] += n
    top = sum(held.values())
    if not top:
        return None
    inside = lambda q, p: q == p or q.startswith(p + "/")
    own = [p for p in below if below[p] and kind_of(p) in ("article", "main")]
    outer = [p for p in own if not any(q != p and inside(p, q) for q in own)]
    told = [q for q in held if held[q] and any(inside(q, p) for p in outer)]
    room = [p for p in below if kind_of(p) in ROOMS]
    named = [p for p in room if all(inside(q, p) for q in told)] if sum(below[p] for p in outer) >= 0.5 * top else []
    return max(named or [p for p in room if below[p] >= 0.9 * top], key=lambda p: (p.count("/"), p), default=None)


def deduce(rows: list[tuple[str, str, int, int, int, int, int]], pages: int, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS) -> dict:
    """A host's template from its frequent tokens (path, string, pages, total, seen, print, chars): {"article": path or None,
    "dropped": [path ...], "constant": [(path, string) ...], "classes": [[path ...] ...]}.

    A host of fewer than least_pages pages gives no classes: only its article's element.
    """
    valid = valid_classes(rows, least_tokens) if pages >= least_pages else []
    fixed = {t for c in valid for t in c}
    chars = {(path, said): k for path, said, *_, k in rows}
    held = {path: k for (path, said), k in chars.items() if not said}
    constant = [t for t in fixed if t[1]]
    fresh = Counter(held)  # text of the slots: without the strings that repeat
    for path, said in constant:
        fresh[path] -= min(chars[path, said], fresh[path])
    slots = fresh if sum(fresh.values()) >= (1 - COPIES) * sum(held.values()) else held
    article = article_of({p: n for p, n in slots.items() if n > 0})
    inside = lambda q, p: q == p or q.startswith(p + "/")
    mine = {p: n for p, n in held.items() if article and inside(p, article)}
    said_in, frequent = Counter(), 0
    for (path, said), n in chars.items():
        if said and path in mine:
            frequent += min(n, mine[path])
            if (path, said) in fixed:
                said_in[path] += min(n, mine[path])
    if frequent > COPIES * sum(mine.values()):  # copies, of valid classes or not
        constant, said_in = [], Counter()
    whole, dropped = sum(mine.values()), []
    for path in sorted(p for p, said in fixed if not said and article and inside(p, article) and p != article and kind_of(p) in BLOCKS - {"p", "h1"}):
        under = {p: n for p, n in mine.items() if inside(p, path)}
        all_, links = sum(under.values()), sum(n for p, n in under.items() if any(kind_of("/" + x) == "a" for x in p[len(path) :].split("/")))
        repeats = sum(said_in[p] for p in under)
        if all_ and all_ <= COPIES * whole and (links >= LINKS * all_ or repeats >= REPEATED * all_) and not any(inside(path, d) for d in dropped):
            dropped.append(path)
    return {"article": article, "dropped": dropped, "constant": sorted(constant), "classes": [[p + ("\t" + s if s else "") for p, s in c] for c in valid]}


def extract(page: str | None, article: str | None, constant: frozenset[tuple[str, str]] = frozenset(), dropped: frozenset[str] = frozenset(), names: bool = True) -> str:
    """The text of the page's article: blocks in page order, one a line, without the template's strings and dropped elements.

    Without the article's element on this page, the first of article, main and body that has text serves, by the same rules.
    Where the template's strings are most of the text, as on a copy, they stay.
    """
    nodes = list(Walk(page, dropped, names).nodes())
    wanted = [article] if article else []
    for last in ("article", "main", "body", ""):
        found = [p for p, tag, _, _ in nodes if tag == last] if last else [""]
        wanted += list(dict.fromkeys(found)) if last else found
    for slot in wanted:
        texts = []
        for without in (constant, frozenset()) if constant else (frozenset(),):
            blocks: list[str] = []
            now: list[str] = []

            def close():
                if said := _SPACE.sub(" ", html.unescape("".join(now))).strip():
                    blocks.append(said)  # noqa: B023
                now.clear()  # noqa: B023

            for path, tag, text, shut in nodes:
                inside = not slot or path == slot or path.startswith(slot + "/")
                if tag is not None:
                    if tag.lstrip("/") in BLOCKS:
                        close()
                    elif tag == "br" and inside:
                        now.append(" ")
                elif inside and not shut and not (without and (path, short(clean(text))) in without):
                    now.append(text)
            close()
            texts.append("\n".join(blocks))
        if texts[-1]:
            return texts[0] if len(texts[0]) >= (1 - COPIES) * len(texts[-1]) else texts[-1]
    return ""


def extract_frames(keep: list[str], names: bool):
    """For mapInArrow over (page_id, url, html, host template as JSON): (page_id, url, text, n_chars, template)."""
    import pyarrow as pa

    def run(batches):
        known: dict[str | None, tuple] = {None: (None, frozenset(), frozenset())}
        for b in batches:
            out, articles = [], []
            for page, raw in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if raw not in known:
                    if len(known) > 2000:
                        del known[next(k for k in known if k is not None)]
                    t = json.loads(raw)
                    known[raw] = t["article"], frozenset((x["path"], x["string"]) for x in t["constant"]), frozenset(t["dropped"])
                article, constant, dropped = known[raw]
                articles.append(article)
                out.append(extract(page.as_py(), article, constant, dropped, names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(articles, pa.string())], keep)

    return run


def deduce_frames(least_pages: int, least_tokens: int):
    """For applyInPandas over one host's frequent tokens."""
    import pandas as pd

    def run(key, pdf):
        whole = pdf[pdf.path == ""]
        pages = int(whole.pages.sum())
        rows = [tuple(r) for r in pdf[pdf.path != ""][["path", "string", "pages", "total", "seen", "print", "chars"]].itertuples(index=False)]
        t = deduce(rows, pages, least_pages, least_tokens)
        return pd.DataFrame([{"host": key[0], "pages": pages, "article": t["article"], "dropped": t["dropped"], "constant": [{"path": p, "string": s} for p, s in t["constant"]], "classes": t["classes"]}])

    return run


def host_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS, names: bool = True) -> DataFrame:
    """(host, pages, article, dropped, constant array<struct<path,string>>, classes array<array<string>>), a row a host.

    Statistics cover every page. A token must be on ``support`` of its host's pages, strings also on ``least_pages`` pages; the
    tokens of a host that pass are at most those of one page divided by support, so a host's template is small.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    partial = rows.mapInArrow(token_frames(names), "host string, path string, string string, pages long, total long, seen long, print long, chars long")
    sums = partial.groupBy("host", "path", "string").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "seen", "print", "chars")])
    sums = materialize(sums.where((F.col("string") == "") | (F.col("pages") >= least_pages)), "page-tokens")
    sizes = sums.where("path = '' and string = ''").select("host", F.col("pages").alias("n"))
    frequent = sums.join(sizes, "host").where(F.col("pages") >= support * F.col("n")).select(*sums.columns)
    kinds = "host string, pages long, article string, dropped array<string>, constant array<struct<path:string,string:string>>, classes array<array<string>>"
    return frequent.groupBy("host").applyInPandas(deduce_frames(least_pages, least_tokens), kinds)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template: bool = True, names: bool = True, **params) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars, template), the last being the path of its host's article.

    Null, empty and text-less pages have the empty text; pages without a host share the host ''; rows that repeat an id or a url are
    pages of their own; texts of any length are read whole; other columns are not read; an empty table gives none.
    template=False leaves the hosts' templates out, names=False the names of classes and ids.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s]*)", 1)), "^www\\.", "")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"), host.alias("_host"))
    if template:
        known = host_templates(pages, id_col, url_col, html_col, names=names, **params)
        known = materialize(known.select("host", F.to_json(F.struct("article", "dropped", "constant"), {"ignoreNullFields": "false"}).alias("known")), "templates")
        rows = rows.join(known, rows["_host"] == known["host"], "left")
    else:
        small_batches(pages.sparkSession)
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    return rows.select("page_id", "url", "html", "known").mapInArrow(extract_frames(["page_id", "url", "text", "n_chars", "template"], names), "page_id long, url string, text string, n_chars long, template string")
