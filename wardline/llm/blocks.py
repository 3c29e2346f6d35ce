"""Pages as flat text blocks: one linear scan of the markup, no tree is built.

A block is the text between two block-level tags. The scan keeps a stack of open elements and
gives each block what the classifier looks at: its words, how many stand in links, the tag, and
where it stands (see ``Block``)."""
from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Elements of HTML by what they do to text.
#: Their content is no text of the page; it ends at their end tag, whatever it holds.
RAW = "script style textarea title xmp iframe noembed noframes noscript"
#: Elements without an end tag.
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Elements that start a new block.
BLOCK = """address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset
 figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
 search section select summary table tbody td tfoot th thead tr ul"""
#: Elements that show no text, or no text of the article, with all that they hold.
HIDDEN = "audio canvas datalist math object svg template video"
#: Elements that a new one of the same kind ends, and the elements that bound this.
ENDED = {"li": "ul ol menu dir", "dd": "dl", "dt": "dl", "tr": "table", "td": "table", "th": "table", "option": "select"}
# Words in class, id and role that mark what is not the article, and what is.
#: Elements that are never the article.
BESIDE_TAGS = "nav aside footer menu dialog form header search button select fieldset"
BESIDE = """ad ads adv advert adverts advertisement advertisements adsense alert alertdialog banner breadcrumb breadcrumbs complementary
 consent contentinfo cookie cookies copyright crumbs dialog disclaimer dropdown foot footer form gdpr header login masthead menu menubar
 modal nav navbar navi navigation newsletter notice notices notification outbrain overlay pager pagination paging paywall popup
 popular promo promos promotion recommend recommended recommendations related search share sharing sidebar signin signup skip social sponsor
 sponsored subscribe subscription taboola toast toolbar topbar trending widget widgets"""
BESIDE_PARTS = "advert|breadcrumb|cookie|copyright|footer|masthead|navbar|navig|newsletter|popup|sidebar|sponsor|(?:menu|nav|header)$"
COMMENTS = "comment|disqus|^repl(?:y|ies)$|^respond$"
MAIN = "content main maincontent"
ARTICLE = "article articlebody entry post story"
#: With these words ``header`` is the article's own, and ``widget`` any part of a page; before
#: ``sidebar`` they speak of the layout.
OWN_HEADER = "article entry post story title"
ANY_WIDGET = "elementor"
LAYOUT = "has no with without"
#: Titles of sections that follow an article: readers' comments, and links to other pages.
COMMENT_TITLE = r"(?:reader |leserinnen-)?(?:comments?|commentaires?|kommentare?|comentarios?|leave a (?:reply|comment)|discussion|responses?)"
LINKS_TITLE = (r"related(?: \w+)?|you (?:may|might) also like|read (?:more|next)|more (?:from|stories|articles)\b.*|share this.*"
               r"|tags|à lire aussi|articles liés|mehr zum thema|das könnte sie auch interessieren|te puede interesar|artículos relacionados")
#: Phrases of notices, forms, adverts and page ends.
PHRASES = ("cookie", "©", "copyright", "all rights reserved", "alle rechte", "tous droits", "todos los derechos", "privacy policy", "terms of use",
           "terms of service", "subscribe", "newsletter", "sign up", "sign in", "log in", "login", "advertis", "anzeige", "publicité", "publicidad",
           "sponsored", "share this", "share on", "follow us", "read more", "javascript", "click here", "buy now", "posted by", "leave a reply",
           "leave a comment", "datenschutz", "impressum", "mentions légales", "aviso legal")

_RAW, _VOID, _BLOCK, _HIDDEN, _TAGS, _BESIDE, _MAIN, _ARTICLE, _OWN, _LAYOUT = (
    frozenset(x.split()) for x in (RAW, VOID, BLOCK, HIDDEN, BESIDE_TAGS, BESIDE, MAIN, ARTICLE, OWN_HEADER, LAYOUT))
_ENDED = {k: frozenset(v.split()) for k, v in ENDED.items()}
_PARTS, _COMMENTS = re.compile(BESIDE_PARTS), re.compile(COMMENTS)
_TITLES = [re.compile(rf"\W*(?:\d+ )?(?:{t})\W*(?:\d+\W*)?", re.I) for t in (LINKS_TITLE, COMMENT_TITLE)]
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_TAG_END = re.compile(r"""((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Marks of elements; a comment section is never unmarked.
_NONE, _IN_MAIN, _IN_ARTICLE, _ASIDE, _IN_COMMENTS = 0, 1, 2, -1, -2


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words in links
    place: int  # -1 in an element marked as no article, 0 unmarked, 1 in a main part, 2 in an article
    heading: bool
    item: bool  # of a list
    section: int  # 1 below a title of links, 2 below a title of comments (the title included)
    phrase: bool  # holds a phrase of notices, forms, adverts or page ends
    ended: bool  # ends as a sentence does


def _mark(tag: str, attributes: dict[str, str]) -> int:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')} {attributes.get('itemprop', '')}"
    found = [w.lower() for w in _WORD.findall(names)] if tag not in ("html", "body") else []
    words = {w for i, w in enumerate(found) if not (w == "sidebar" and i and found[i - 1] in _LAYOUT)}
    if any(map(_COMMENTS.search, words)):
        return _IN_COMMENTS
    beside = {w for w in words if w in _BESIDE or _PARTS.search(w)}
    if words & _OWN:
        beside -= {"header"}
    if ANY_WIDGET in words:
        beside -= {"widget"}
    if tag in _TAGS or beside:
        return _ASIDE
    if tag == "article" or words & _ARTICLE:
        return _IN_ARTICLE
    return _IN_MAIN if tag == "main" or words & _MAIN else _NONE


class _Scan:
    """Open elements, text since the last block boundary, and the blocks found."""

    def __init__(self) -> None:
        self.parent, self.mark, self.tag, self.open, self.close, self.section, self.rank = [-1], [0], [""], [0], [0], [0], [0]
        self.stack = [0]
        self.depth: dict[str, list[int]] = {}  # where in the stack the open elements of each kind stand
        self.walls = [0]  # where block elements stand
        self.articles = 0
        self.hidden = 0  # depth of the outermost element that is not shown
        self.link = 0  # depth at which the open link stands
        self.runs: list[tuple[int, str, bool]] = []
        self.found: list[tuple] = []
        self.heads: set[int] = set()

    def text(self, s: str) -> None:
        if not self.hidden:
            self.runs.append((self.stack[-1], unescape(s) if "&" in s else s, bool(self.link)))

    def flush(self) -> None:
        """End a block."""
        runs, self.runs = self.runs, []
        words = "".join(r[1] for r in runs).split()
        if not words:
            return
        text, top = " ".join(words), self.stack[-1]
        linked = len("".join(r[1] if r[2] else " " for r in runs).split()) if any(r[2] for r in runs) else 0
        if len(text) > 12 * len(words):  # scripts without spaces
            n = len(text) // 12
            linked, words = linked * n // len(words), [""] * n
        heading = next((n for n in self._up(top) if self.tag[n][:1] == "h" and self.tag[n][1:].isdigit()), 0)
        box = self.parent[heading] if heading else top
        if heading and len(text) < 80:
            rank = int(self.tag[heading][1])
            kind = next((k for k, t in ((2, _TITLES[1]), (1, _TITLES[0])) if t.fullmatch(text)), 0)
            if kind:
                self.section[box], self.rank[box] = max(kind, self.section[box]), rank
            elif self.section[box] == 1 and rank <= self.rank[box]:
                self.section[box] = 0  # a new part of the same rank
        self.found.append((text, len(words), min(linked, len(words)), {r[0] for r in runs if not r[1].isspace()}, heading > 0,
                           any(self.tag[n] in ("li", "dt", "dd", "option") for n in self._up(top)), self.section[box],
                           len(words) < 60 and any(map(text.lower().__contains__, PHRASES)), text[-1] in ".!?…:;\"»”"))

    def _up(self, node: int):
        """The node and its ancestors up to four levels."""
        for _ in range(4):
            if node <= 0:
                return
            yield node
            node = self.parent[node]

    def push(self, tag: str, attributes: dict[str, str], at: int) -> None:
        top = self.stack[-1]
        mark = _mark(tag, attributes)
        if mark == _ASIDE and tag == "header" and self.articles:
            mark = _NONE  # the article's own
        self.articles += mark == _IN_ARTICLE
        self.parent.append(top)
        self.mark.append(mark)
        self.tag.append(tag)
        self.open.append(at)
        self.close.append(1 << 62)
        self.section.append(self.section[top])
        self.rank.append(0)
        self.depth.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.walls.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        if not self.hidden and (tag in _HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true"
                                or _UNSHOWN.search(attributes.get("style", ""))):
            self.hidden = len(self.stack)
        if tag == "a" and "href" in attributes and not self.link:
            self.link = len(self.stack)

    def pop(self, at: int) -> None:
        node = self.stack.pop()
        tag = self.tag[node]
        self.close[node] = at
        self.depth[tag].pop()
        self.articles -= self.mark[node] == _IN_ARTICLE
        if tag in _BLOCK:
            self.walls.pop()
        if len(self.stack) < self.hidden:
            self.hidden = 0
        if len(self.stack) < self.link:
            self.link = 0

    def end(self, tag: str, at: int, bounds: frozenset[str] = frozenset()) -> None:
        """Close the innermost element ``tag`` and all in it, unless one of ``bounds`` stands between;
        the end of an inline element closes no block."""
        here = self.depth.get(tag)
        if not here:
            return
        inline = tag not in _BLOCK and "-" not in tag
        if (inline and self.walls[-1] > here[-1]) or any(self.depth[t][-1] > here[-1] for t in bounds if self.depth.get(t)):
            return
        for _ in range(len(self.stack) - here[-1]):
            self.pop(at)

    def blocks(self) -> list[Block]:
        marks = self.mark
        commented = [False] * len(marks)
        for n in range(1, len(marks)):
            commented[n] = marks[n] == _IN_COMMENTS or commented[self.parent[n]]
        core = next(filter(None, ([n for n, m in enumerate(marks) if m == kind and not commented[n]] for kind in (_IN_ARTICLE, _IN_MAIN))), [])
        first, last = (min(self.open[n] for n in core), max(self.open[n] for n in core)) if core else (0, 0)
        place = [0]
        for n in range(1, len(marks)):
            m, above = marks[n], place[self.parent[n]]
            if m == _ASIDE and core and self.open[n] < first and self.close[n] > last:
                m = _NONE  # it holds all articles: a layout's name, or a form around the page
            if m == _ASIDE and self.tag[n] == "form" and n in self.heads:
                m = _NONE
            place.append(-1 if above < 0 or m < 0 else max(m, above))
        return [Block(t, w, k, max((place[n] for n in nodes), default=0), *rest) for t, w, k, nodes, *rest in self.found]


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in page order. References are decoded, white space is one space."""
    s, at, scan = html, 0, _Scan()
    while (m := _START.search(s, at)):
        if m.start() > at:
            scan.text(s[at:m.start()])
        comment, closing, name = m.groups()
        if comment:
            end = _COMMENT_END.search(s, m.start() + 2)
            at = end.end() if end else len(s)
            continue
        if name is None:  # declarations and bogus comments
            at = (s.find(">", m.end() - 1) + 1) or len(s)
            continue
        end = _TAG_END.match(s, m.end())
        if not end:
            at = len(s)
            break
        at, tag = end.end(), name.lower()
        if tag == "br":
            scan.text(" ")
            continue
        if tag in _BLOCK:
            scan.flush()
        if closing:
            scan.end(tag, m.start())
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(s, at)
            at = end.start() if end else len(s)
            continue
        if tag in _VOID or (tag == "form" and scan.depth.get("form")):  # forms don't nest
            continue
        if tag in _BLOCK:
            scan.end("p", m.start(), frozenset(("td", "th", "button", "table", "object")))
            for other in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)):
                if tag in _ENDED:
                    scan.end(other, m.start(), _ENDED[tag])
        elif tag == "a":
            scan.end("a", m.start())
        attributes: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(end.group(1)) if end.group(1) else ():
            attributes.setdefault(k.lower(), v.strip("\"'"))
        scan.push(tag, attributes, m.start())
        if tag == "h1":
            scan.heads.update(scan.stack[d] for d in scan.depth.get("form", ()))
    if at < len(s):
        scan.text(s[at:])
    scan.flush()
    return scan.blocks()
