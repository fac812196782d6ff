"""One web page as blocks: a small reader that keeps the open elements, closes those whose end tags are left out, sums up text and links
of each element, and scores the elements that may hold the article. Everything that needs no tree is a column in ``pages``.

Each start tag, end tag and piece of text costs its own length: counters say what is open, and sums go from children to parents once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

#: Elements, roles and parts of class and id names that are no article text.
STRUCTURAL = "nav header footer aside form input button dialog details summary menu menuitem noscript".split()
ROLES = "navigation complementary contentinfo banner form search menu menubar".split()
MEDIA = "figure figcaption picture video audio canvas embed object iframe svg".split()
MEDIA_NAMES = "caption credit gallery slideshow media- image- photo- figure- thumbnail".split()
PROMOTION = "share subscribe newsletter donate paywall register login related recommended trending outbrain taboola sponsored promo cta signup follow-us social comment disqus ad-container advertisement banner-ad sidebar".split()
SUMMARY = "summary ai-summary tldr tl-dr key-points highlights quick-read brief takeaway key-takeaway kortversjon oppsummering sammendrag hovedpoeng nokkelpunkt".split()
INFORMATION = "infobox info-box factbox fact-box callout pullquote sidebar-box aside-box tip-box note-box warning-box faktaboks infoboks".split()
#: Parts of class names that go before the article is sought: players, lists of shortcuts, advertisements, tools, banners.
PLAYERS = "player-control video-control video-player vjs- jw- plyr mejs video-js audio-player podcast-player listen-button audio-controls".split()
TOOLS = "keyboard-shortcuts hotkey shortcut-list help-modal share-buttons social-share sharing-tools comments-section comment-form subscribe-form email-signup site-header site-footer mega-menu related-articles more-stories read-next".split()
BANNERS = "cookie-banner gdpr consent-banner privacy-notice".split()
PRE_ROLES = "slider progressbar menubar".split()
#: Parts of class and id names of spans that go, and of class names that stand for emphasis.
SPANS = "caption credit byline share subscribe promo related recommended tldr summary ai takeaway highlights icon badge label tag meta".split()
ITALIC = "italic emphasis em emphasized oblique".split()
BOLD = "bold strong fw-bold font-bold semibold font-semibold".split()
#: Inline elements that stay in markup, and what some become.
INLINE = "a strong em code sub sup mark del ins s u abbr".split()
RENAMED = {"b": "strong", "i": "em"}
#: Names that speak for and against an element that may hold the article.
FOR = re.compile("article|body|content|entry|hentry|h-entry|main|page|post|text|blog|story")
AGAINST = re.compile("hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget")
TAG_SCORE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
CANDIDATES, LEAST_ARTICLE, LEAST_SCORED, LEAST_TABLE, LEAST_PIXELS = 5, 500, 25, 200, 10

BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "tr"}
CONTAINER = {"div", "section", "article", "main", "body", "ul", "ol", "dl", "table", "address", "fieldset", *STRUCTURAL, *MEDIA}
VOID = {"br", "hr", "img", "input", "meta", "link", "embed", "col", "source", "wbr", "area", "base", "track"}
SKIPPED = ("script", "style", "title", "template", "textarea", "select", "option")
#: Start tags that close an open element of these names, up to the names that bound the search.
_P_ENDS = (BLOCK - {"li", "dt", "dd", "tr"}) | (CONTAINER - {"body", "button", "input", "noscript", "picture", "video", "audio", "canvas", "embed", "object", "iframe", "svg", "menuitem"}) | {"hr"}
_BOUND_P = {"td", "th", "table", "caption", "button", "object", "html"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"td", "th", "tr"}, {"table"}), **{t: ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}


def _pixels(attrs: dict[str, str | None], style: str) -> bool:
    """Whether an element says that it is narrower or lower than ``LEAST_PIXELS``, or its letters smaller."""
    sizes = [attrs.get(k) or "" for k in ("width", "height")] + re.findall(r"(?<![\w-])(?:font-size|width|height):(\d+(?:\.\d+)?)px", style)
    return any(float(s) < LEAST_PIXELS for s in sizes if re.fullmatch(r"\d+(?:\.\d+)?", s))


def reason_of(tag: str, attrs: dict[str, str | None]) -> str | None:
    """Why an element should go: the first rule that fits its name, role, or class and id."""
    own = (attrs.get("class") or "").lower()
    names, role = f"{own} {attrs.get('id') or ''}".lower(), (attrs.get("role") or "").lower()
    style = (attrs.get("style") or "").replace(" ", "").lower()
    has = lambda parts, where=names: any(p in where for p in parts)
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    early = has((*PLAYERS, *TOOLS), own) or role in PRE_ROLES or "google_ads" in names or "data-ad" in attrs or "video" in (attrs.get("data-testid") or "") or "keyboard" in (attrs.get("aria-label") or "") or (tag in ("div", "aside", "section") and has(BANNERS, own))
    rules = (
        ("structural", tag in STRUCTURAL or role in ROLES), ("media", tag in MEDIA or has(MEDIA_NAMES)), ("hidden", hidden), ("promotion", has(PROMOTION) or bool({"ad", "ads"} & set(names.split()))),
        ("summary-box", has(SUMMARY)), ("info-box", has(INFORMATION)), ("pre-clean", early), ("tiny", tag not in VOID and _pixels(attrs, style)),
    )
    return next((name for name, found in rules if found), None)


def _styled(parts: list[str], names: tuple[str, ...], style: str, values: tuple[str, ...], attrs: dict[str, str | None]) -> bool:
    own = (attrs.get("class") or "").lower()
    return any(p in own for p in parts) or any(any(n in k for n in names) or (v or "").lower() in values for k, v in attrs.items()) or bool(re.search(style, attrs.get("style") or ""))


def span_role(attrs: dict[str, str | None]) -> str | None:
    """What a span becomes: ``remove``, an element of emphasis, or nothing but its content."""
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
    if any(p in names for p in SPANS):
        return "remove"
    if _styled(ITALIC, ("italic",), "font-style.*italic", ("italic", "emphasis"), attrs):
        return "em"
    return "strong" if _styled(BOLD, ("bold", "strong"), "font-weight.*(?:bold|[789]00)", ("bold", "strong"), attrs) else None


def _element(tag: str, attrs: tuple[tuple[str, str | None], ...]) -> tuple[str | None, str, int]:
    """What an element's name and attributes say by themselves: why it should go, as which selector, and the weight of its names."""
    given = dict(attrs)
    reason, names = reason_of(tag, given), f"{given.get('class') or ''} {given.get('id') or ''}".lower()
    where = tag + (f"#{given['id']}" if given.get("id") else "") + "".join(f".{c}" for c in (given.get("class") or "").split()) if reason else ""
    return reason, where, 25 * (bool(FOR.search(names)) - bool(AGAINST.search(names))) + TAG_SCORE.get(tag, 0)


#: The same of elements with short attributes, which pages and sites repeat: a task knows a few thousand of them.
LONGEST_KNOWN = 200
_known_element = lru_cache(maxsize=4096)(_element)


class PageReader(HTMLParser):
    """Collects the blocks of a page; ``blocks`` gives them once the page has been fed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # by element: parent, name, reason, selector, weight of its names, characters, characters in links, score
        self.parent, self.name, self.reason, self.where, self.weight, self.chars, self.linked, self.score = [-1], ["page"], [None], [""], [0], [0], [0], [0.0]
        self.open, self.counts, self.removed = [0], Counter(), 0
        self.marks: list[str | None] = [None]  # of each open element, what it is in markup
        self.inline: list[str] = []  # those of them that are inline elements
        self.found: list[list] = []
        self.tag, self.text, self.markup, self.clean, self.links, self.table = "div", [], [], [], 0, None
        self.tables: list[int] = []

    def _end_block(self) -> None:
        content = " ".join("".join(self.text).split())
        if content:
            at = self.open[-1]
            self.found.append([at, self.tag, content, self.links, self.table])
            clean, markup = "".join(self.clean), "".join(self.markup)
            if self.tag == "pre":
                self.found[-1] += [clean.strip(), markup.strip()]
            else:
                self.found[-1] += [" ".join(clean.split()).removeprefix("| "), re.sub(r"\s+", " ", markup).strip().removeprefix("| ")]
            if self.tag in ("p", "pre", "tr", "blockquote", "div") and len(content) >= LEAST_SCORED and self.reason[at] is None:
                self._credit(at if self.tag == "div" else self.parent[at], 1 + content.count(",") + min(len(content) // 100, 3))
        self.tag, self.text, self.markup, self.clean, self.links = "div", [], [], [], 0
        self.markup.extend(self.inline)  # emphasis that is open goes on in the next block

    def _credit(self, at: int, points: float) -> None:
        for level in range(5):
            if at <= 0:
                return
            self.score[at] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at = self.parent[at]

    def _close(self) -> None:
        tag, mark = self.name[self.open.pop()], self.marks.pop()
        self.counts[tag] -= 1
        if mark == "":
            self.removed -= 1
        elif mark:
            self.inline.pop()
            self.markup.append(f"</{re.match('<([a-z]+)', mark)[1]}>")

    def _imply(self, tag: str) -> None:
        ends = [({"p"}, _BOUND_P)] if tag in _P_ENDS and self.counts["p"] else []
        ends += [IMPLIED[tag]] if tag in IMPLIED else []
        for closes, bounds in ends:
            if any(self.counts[t] for t in closes):
                at = next((k for k in range(len(self.open) - 1, 0, -1) if self.name[self.open[k]] in closes or self.name[self.open[k]] in bounds), 0)
                while at and self.name[self.open[at]] in closes:
                    if tag not in ("td", "th"):
                        self._end_block()
                    while len(self.open) > at:
                        self._close()
                    at = len(self.open) - 1 if self.name[self.open[-1]] in closes else 0

    def handle_starttag(self, tag, attrs):
        self._imply(tag)
        if tag in VOID:
            self.text.append(" ")
            self.clean.append(" ")
            self.markup.append(" ")
            return
        given = dict(attrs)
        if tag in BLOCK or tag in CONTAINER:
            self._end_block()
        if tag in ("td", "th") and self.text:
            for out in (self.text, self.clean, self.markup):
                out.append(" | ")
        up = self.open[-1]
        inherited = self.reason[up]
        short = len(tag) + sum(len(k) + len(v or "") for k, v in attrs) <= LONGEST_KNOWN
        reason, where, weight = (_known_element if short else _element)(tag, tuple(attrs))
        own = inherited or reason
        self.where.append(self.where[up] if inherited else where)
        self.weight.append(weight)
        for column, value in ((self.parent, up), (self.name, tag), (self.reason, own), (self.chars, 0), (self.linked, 0), (self.score, 0.0)):
            column.append(value)
        self.open.append(len(self.name) - 1)
        self.counts[tag] += 1
        self._mark(RENAMED.get(tag, tag), given)
        if tag in BLOCK:
            self.tag = tag
        if tag == "table" and self.counts["table"] == 1:
            self.table = len(self.tables)
            self.tables.append(0)

    def _mark(self, tag: str, attrs: dict[str, str | None]) -> None:
        """What an element is in markup: a start tag without attributes but a link's, nothing, or removed ("")."""
        in_code = self.counts["code"] + self.counts["pre"] > (tag in ("code", "pre"))
        mark = None
        if tag == "span" and not in_code:
            tag = span_role(attrs) or tag
        if tag == "remove" or tag in SKIPPED:
            mark = ""
            self.removed += 1
        elif tag == "a":
            href = attrs.get("href") or ""
            mark = None if href in ("", "#") or href.startswith("javascript:") else f'<a href="{entities.escape(href)}">'
        elif tag == "code":
            language = [c for c in (attrs.get("class") or "").split() if c.startswith("language-")]
            mark = f'<code class="{entities.escape(" ".join(language))}">' if language else "<code>"
        elif tag in INLINE:
            mark = f"<{tag}>"
        self.marks.append(mark)
        if mark:
            self.inline.append(mark)
            self.markup.append(mark)

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        if tag in BLOCK or tag in CONTAINER:
            self._end_block()
        if tag == "table" and self.counts["table"] == 1:
            self.table = None
        while self.name[self.open[-1]] != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        if self.removed and any(self.counts[t] for t in SKIPPED):  # what is skipped is removed
            return
        self.text.append(data)
        if not self.removed:
            self.clean.append(data)
            self.markup.append(entities.escape(data, quote=False))
        n, at = len(data.strip()), self.open[-1]
        self.chars[at] += n
        if self.table is not None:
            self.tables[self.table] += n
        if self.counts["a"]:
            self.links += n
            self.linked[at] += n

    def blocks(self) -> list[tuple]:
        """(tag, content, link characters, reason, selector, clean text, markup, ranks of the candidates that hold it) of each block."""
        self._end_block()
        for k in range(len(self.name) - 1, 0, -1):
            self.chars[self.parent[k]] += self.chars[k]
            self.linked[self.parent[k]] += self.linked[k]
        rank = {k: i + 1 for i, k in enumerate(self._candidates())}
        inside: list[tuple[int, ...]] = [()]
        for k in range(1, len(self.name)):
            up = inside[self.parent[k]]
            inside.append((*up, rank[k]) if k in rank else up)
        out = []
        for at, tag, content, links, table, clean, markup in self.found:
            small = table is not None and self.tables[table] <= LEAST_TABLE
            reason, where = (self.reason[at], self.where[at]) if self.reason[at] or not small else ("small-table", "table")
            out.append((tag, content, links, reason, where or None, clean, re.sub(r"<(\w+)[^>]*>(\s*)</\1>", r"\2", markup) if "</" in markup else markup, list(inside[at])))
        return out

    def _candidates(self) -> list[int]:
        """The elements with the best scores: what their text earns and their names add, less for links; an element that is named as the
        article and long enough comes first."""
        scored = [(self.name[k] in ("article", "main") and self.chars[k] >= LEAST_ARTICLE, (self.score[k] + self.weight[k]) * (1 - self.linked[k] / max(1, self.chars[k])), -k) for k in range(1, len(self.name)) if self.score[k] > 0]
        return [-x[2] for x in sorted(scored, reverse=True)[:CANDIDATES]]


def read_page(html: str | None) -> list[tuple]:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    return reader.blocks()
