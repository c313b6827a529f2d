"""Main text of web pages by consensus host paths.

Pass 1 parses every page and scores its containers: the characters of the text blocks in it, less those in links,
a block counting in full for its parent and by half for each step further up.  A container's name is its *generalised
path*: tags and classes from the body down, digits replaced.  Spark adds the scores of a path over
all pages of a host (partial aggregates, so a host with a third of all pages costs no more than others) and
ranks all paths of each host.  Pass 2 parses the page again and extracts the best-ranked path that it
has; a page that has none of them, or no text there, falls back to its own best container, then to its body.

An ``h1`` beside the container, or beside an element around it, goes in front.  In the extracted container menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out, by tag, role and the words of class and id.  Words don't decide alone: what holds more than half of the page's
characters stays (but for comments), and inside an ``article`` a class like ``related-work`` is no chrome, as its other word says something.
A form that holds more than half of the page is a container.  A ``header`` inside the container gives its
headings only.  Character references are decoded, white space within a block becomes one space, blocks are trimmed and
joined by two line feeds.

Defined results: null and empty html give an empty text; paths with equal totals are ranked by name; markup that is broken or unclosed is repaired as far as
implied end tags go; a page without tags is one block; rows that repeat a page are rows of their own; a null url has
the host ""; an empty table gives an empty table; html of any length is read whole, in time
linear in it; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stage, text_of

DECAY, DEPTH, NESTING = 0.5, 32, 512

# -- fixed values: HTML's own lists -------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, up to the scopes.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}

# -- what isn't main text -----------------------------------------------------------------------
DROP_TAGS = frozenset("aside button canvas datalist dialog embed footer form head iframe input map menu nav noembed noframes noscript object script select style svg template textarea title audio video".split())
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts alert announcement anuncio anzeige comentario comentarios commentaire commentaires copyright kommentar kommentare publicidad publicite toc warning werbung advertisement advertising adsense adslot banner bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus feedback foot footer gdpr hidden login masthead menu menubar modal nav navbar navigation navmenu newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended registration related replies reply respond responses rss search share sharebar sharing sidebar sidenav signup skip skyscraper social sponsor sponsored sponsorship subscribe subscription tagcloud taboola toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comentario comentarios comment comments commentaire commentaires commentlist discussion disqus kommentar kommentare replies reply respond responses".split())
#: Words that say nothing beside one of those.
PLAIN_WORDS = frozenset("area articles bar block body bottom box btn button buttons card cell center col column container content desktop element form global group holder icons inline inner item items left links list main mobile module outer page panel post posts primary right row secondary section site slot social stories thread top unit user wrap wrapper zone".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    up: "Node | None"
    kids: list = field(default_factory=list)  # nodes and texts
    path: str = ""
    chars: int = 0  # visible characters in it
    in_article: bool = False
    share: float = 0.0  # of the page's visible characters

    def is_header(self) -> bool:
        """A header element, or one by its class or id: of it only headings are text."""
        if self.tag == "header":
            return True
        names = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}" if self.attrs and self.tag not in HEADINGS else ""
        return "header" in names.lower() and any(w.lower() == "header" for w in _CAMEL.split(names))

    def dropped(self) -> bool:
        if self.tag == "form":
            return self.share <= 0.5  # a form around the page is a container
        if self.tag in DROP_TAGS:
            return True
        a = self.attrs
        if not a:
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in DROP_ROLES or _HIDDEN.search(a.get("style", "")):
            return True
        if self.tag in ("html", "body", "article", "main"):
            return False
        return any(map(self._means_chrome, (a.get("class", "") + " " + a.get("id", "")).split()))

    def _means_chrome(self, name: str) -> bool:
        """Whether a class or id says that this isn't main text: by any of its words if it holds less than half of the page, and
        inside an article only if its other words say nothing.  What is named after comments always is."""
        words = [w.lower() for w in _CAMEL.split(name) if w]
        if not any(w in DROP_WORDS for w in words):
            return False
        if any(w in COMMENT_WORDS for w in words) and (not self.in_article or all(w in DROP_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words)):
            return True
        if self.share > 0.5:
            return False
        return not self.in_article or all(w in DROP_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(raw):
        out.setdefault(k.lower(), entities.unescape(v[1:-1] if v[:1] in "\"'" else v) if v else "")
    return out


def _tokens(page: str):
    """Texts and tags in order: (text, None, None, 0, 0), or ("", end mark, name, first and last place of the attributes).  Linear: a tag whose quotes take
    in the rest of the page ends at its first ``>``, and after a few of those quotes are no longer heeded."""
    at, text, n, lost, heed = 0, 0, len(page), 0, True
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            comment, data = page.startswith("<!--", at), page.startswith("<![CDATA[", at)
            end = page.find("-->" if comment else "]]>" if data else ">", at + 2)
            if end < 0 and not comment:
                break
            if at > text:
                yield page[text:at], None, None, 0, 0
            if data:
                yield page[at + 9 : end].replace("&", "&amp;"), None, None, 0, 0
            at = text = n if end < 0 else end + (1 if not (comment or data) else 3)
            continue
        m = _NAME.match(page, at)
        if m is None:
            at += 1
            continue
        end, spot = -1, m.end()
        while heed and (mark := _MARK.search(page, spot)):
            if mark[0] == ">":
                end = mark.start()
                break
            close = page.find(mark[0], mark.end())
            spot = mark.end() if close < 0 else close + 1
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:
                break
            lost += 1
            heed = lost < 8
        if at > text:
            yield page[text:at], None, None, 0, 0
        yield "", m[1], m[2].lower(), m.end(), end
        at = text = end + 1
        if not m[1] and (tag := m[2].lower()) in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if stop is None:
                yield page[at:], None, None, 0, 0
                return
            if stop.start() > at:
                yield page[at : stop.start()], None, None, 0, 0
            at = text = stop.start()
    if text < n:
        yield page[text:], None, None, 0, 0


def parse(page: str) -> Node:
    """A tree with one root; end tags without a start are ignored, missing ones are implied, and elements below ``NESTING`` levels lie
    beside one another."""
    root = Node("html", {}, None, path="html")
    here, made, depth, opened = root, [root], 1, {"html": 1}

    def close(node: Node) -> None:
        """Ends the open elements up to ``node``, too."""
        nonlocal here, depth
        while True:
            opened[here.tag] -= 1
            depth -= 1
            done, here = here is node, here.up
            if done:
                return

    for text, mark, tag, first, last in _tokens(page):
        if mark is None:
            here.kids.append(text)
            if here.tag not in UNSEEN:
                here.chars += len(text) - text.count(" ") - text.count("\n")
            continue
        if mark:
            if tag == "br":
                here.kids.append(" ")
            elif tag != "html" and opened.get(tag):
                node = here
                while node.tag != tag:
                    node = node.up
                close(node)
            continue
        if tag == "html":
            root.attrs |= _attributes(page[first:last])
            continue
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            node, top = here, None
            while any(opened.get(e) for e in ends) and node is not None and node.tag not in scope:
                if node.tag in ends:
                    top = node
                node = node.up
            if top is not None:
                close(top)
        elif tag in ENDS_P and opened.get("p"):
            node = here
            while node is not None and node.tag != "p" and node.tag not in ("td", "th", "li", "div", "article", "section", "button", "body"):
                node = node.up
            if node is not None and node.tag == "p":
                close(node)
        raw = page[first:last]
        attrs = _attributes(raw)
        node = Node(tag, attrs, here, path=generalised(tag, attrs, here), in_article=here.in_article or here.tag == "article")
        here.kids.append(node)
        made.append(node)
        if (tag not in VOID and not raw.rstrip().endswith("/") or tag in BLOCK and tag != "hr") and (depth < NESTING or tag in RAW):
            here, depth = node, depth + 1
            opened[tag] = opened.get(tag, 0) + 1
    for node in reversed(made):
        if node.up is not None and node.tag not in UNSEEN:
            node.up.chars += node.chars
    for node in made:
        node.share = node.chars / root.chars if root.chars else 0.0
    return root


def generalised(tag: str, attrs: dict[str, str], up: Node) -> str:
    """The path of an element: tags with their classes, digits as #.  Below ``DEPTH`` steps a hash stands for it."""
    own = tag
    if c := attrs.get("class", "").split():
        own += "." + ".".join(sorted({_DIGITS.sub("#", x.lower()) for x in c}))
    elif i := attrs.get("id", "").strip():
        own += "@" + _DIGITS.sub("#", i.lower())
    path = f"{up.path}/{own}"
    return path if path.count("/") < DEPTH and up.path[0] != "#" else "#" + xxhash.xxh64_hexdigest(path.encode("utf-8", "replace"))


def _tidy(parts: list[str]) -> str:
    return _SPACE.sub(" ", entities.unescape("".join(parts))).strip()


#: Elements that show no text of their own.
UNSEEN = frozenset("audio canvas datalist embed head iframe input map noembed noframes object script select style svg template textarea title video".split())


def blocks(top: Node, everything: bool = False) -> list[tuple[Node, str, int]]:
    """Text blocks below an element, in page order: the block's element, its text, characters in links.
    ``everything``: all text that a reader sees, not the main text only."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal parts, linked
        if parts and (text := _tidy(parts)):
            out.append((owner, text, linked))
        parts, linked = [], 0

    # (node, next child, in a link, its block, headings only); iterative, as trees can be deep
    stack = [[top, 0, False, top, False]]
    while stack:
        frame = stack[-1]
        node, k, link, owner, only = frame
        if k == len(node.kids):
            stack.pop()
            if node.tag in BLOCK or node is top:
                flush(node)
            continue
        frame[1] += 1
        kid = node.kids[k]
        if isinstance(kid, str):
            if not only:
                parts.append(kid)
                linked += len(kid) if link else 0
        elif kid.tag in ("br", "wbr", "hr", "img"):
            if kid.tag == "hr":
                flush(owner)
            elif kid.tag != "wbr":
                parts.append(" ")
        elif not (kid.tag in UNSEEN if everything else kid.dropped()):
            block = kid.tag in BLOCK
            if block:
                flush(owner)
            heads = not everything and (only or kid.is_header()) and kid.tag not in HEADINGS
            stack.append([kid, 0, link or kid.tag == "a", kid if block else owner, heads])
    return out


def containers(root: Node) -> dict[str, float]:
    """Scores of a page's containers by their generalised paths."""
    body = find_body(root)
    found: dict[int, tuple[Node, float]] = {}
    for owner, text, linked in blocks(body):
        worth = len(text) - min(len(text), linked)
        if not worth:
            continue
        node = owner if owner is body or owner.up is None else owner.up
        share = 1.0
        while node is not None and share > 1e-6:
            found[id(node)] = (node, found.get(id(node), (node, 0.0))[1] + worth * share)
            if node is body:
                break
            share *= DECAY
            node = node.up
    scores: dict[str, float] = {}
    for node, s in found.values():
        s *= {"article": 1.5, "main": 1.3}.get(node.tag, 1.0)
        scores[node.path] = max(scores.get(node.path, 0.0), s)
    return scores


def find_body(root: Node) -> Node:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "body":
            return node
        todo += [k for k in node.kids if not isinstance(k, str)][::-1]
    return root


def _find(root: Node, path: str) -> list[Node]:
    """All elements with a path, none inside another."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.path == path:
            out.append(node)
        elif path[0] == "#" or path.startswith(node.path + "/"):
            todo += [k for k in node.kids if not isinstance(k, str)][::-1]
    return out


def heading(node: Node) -> list[str]:
    """The page's main headings that stand right before an element, or before one that it is in."""
    out: list[str] = []
    while node.up is not None and node.tag != "body":
        before = []
        for kid in node.up.kids:
            if kid is node:
                break
            if not isinstance(kid, str) and kid.tag == "h1" and not kid.dropped():
                before += [t for _, t, _ in blocks(kid)]
        out, node = before + out, node.up
    return out


def extract(page: str, ranked: list[str]) -> str:
    """The text of the first of the host's paths that the page has."""
    if not page:
        return ""
    root = parse(page)
    for path in (*ranked, None):
        if path is None:
            own = containers(root)
            if not own:
                break
            path = min(own, key=lambda p: (-own[p], p))
        found = _find(root, path)
        texts = [t for node in found for _, t, _ in blocks(node)]
        if texts:
            return "\n\n".join(heading(found[0]) + texts)
    return "\n\n".join(t for _, t, _ in blocks(find_body(root)))


def host_of(url):
    """Host of a URL column, in lower case, without port; "" if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _score(batches):
    names = ["id", "h", "host", "path", "score"]
    for b in batches:
        rows = []
        for i, h, host, page in zip(*(b[c].to_pylist() for c in ("id", "h", "host", "html"))):
            rows += [(i, h, host, p, s) for p, s in containers(parse(page)).items()] if page else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))], names)


def _extract(batches):
    names = ["id", "url", "text", "n_chars"]
    for b in batches:
        texts = [extract(page, ranked or []) for page, ranked in zip(b["html"].to_pylist(), b["ranked"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)


def extract_main(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    page = text_of(df[html_col])
    pages = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(df[url_col], page).alias("h"), df[url_col].cast("string").alias("url"), page.alias("html"))
    votes = stage(pages.select("id", "h", host_of(F.col("url")).alias("host"), "html").mapInArrow(_score, "id long, h long, host string, path string, score double"), "paths")
    totals = votes.groupBy("host", "path").agg(F.sum("score").alias("total"))
    # all paths of a host are ranked, by (total, path); a page compares those that it has
    ranks = totals.select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), F.round("total", 3).alias("total"))
    # the host's paths that a page has, best first; decided on these small rows, not on html
    chosen = votes.join(ranks, (F.col("host") == F.col("w_host")) & (F.col("path") == F.col("w_path")))
    chosen = chosen.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct((-F.col("total")).alias("less"), "path"))).alias("r")).select(F.col("id").alias("c_id"), F.col("h").alias("c_h"), F.col("r.path").alias("ranked"))
    met = pages.join(stage(chosen, "ranked"), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left")
    return met.select("id", "url", "html", "ranked").mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnRenamed("id", "page_id")
