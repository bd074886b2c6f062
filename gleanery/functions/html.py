"""One pass over a page's HTML: the fields that the article job needs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from gleanery.functions.dates import VISIBLE_DATES

# Fixed values of the HTML standard.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN_TAGS = frozenset("script style template rt rp".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
# What does not belong to an article's text.
SKIPPED_PARENTS = frozenset(("aside", "nav", "footer"))
SKIPPED_CLASS = "caption"

_SPACE = re.compile(r"\s+")
_DATES = [re.compile(pattern, re.IGNORECASE) for pattern in VISIBLE_DATES]


@dataclass(frozen=True)
class PageRules:
    """Site-specific names used while reading a page.

    With ``implied_end_tags`` an unclosed ``p`` ends where the next block starts,
    as in browsers. Without it an unclosed block also holds the blocks after it,
    so that their text appears in both.
    """

    content_class: str = "ArticleContent_article"
    body_class: str = "article-body"
    implied_end_tags: bool = True


class _Text:
    """Text strings below one element, trimmed and joined by blanks."""

    def __init__(self, skip: bool = False):
        self.parts: list[str] = []
        self.skip = skip
        self.live = True  # until its element ends

    def value(self) -> str:
        return _SPACE.sub(" ", " ".join(self.parts)).strip()


class _Container:
    def __init__(self):
        self.text = _Text()
        self.blocks: list[_Text] = []

    def value(self) -> list[str]:
        blocks = [b.value() for b in self.blocks if not b.skip]
        blocks = [b for b in blocks if b]
        whole = self.text.value()
        return blocks or ([whole] if whole else [])


class PageReader(HTMLParser):
    def __init__(self, rules: PageRules):
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.open: list[tuple[str, list]] = []
        # Where each tag is open, so that no step walks over all that is open.
        self.places: dict[str, list[int]] = {}
        self.hidden = 0
        self.skipped = 0
        self.listening: list[_Text] = []
        self.buffer: list[str] = []
        self.visible = _Text()
        self.meta: dict[str, str | None] = {}
        self.times: list[str] = []
        self.scripts: list[str] = []
        self.h1: _Text | None = None
        self.body: _Text | None = None
        self.by_class: _Container | None = None
        self.by_article: _Container | None = None
        self.by_main: _Container | None = None
        self.script: list[str] | None = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        else:
            self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if self.rules.implied_end_tags:
            self._end_implied(tag)
        # The last of repeated attributes counts; a bare attribute is an empty string.
        named = {name: value or "" for name, value in attrs}
        if tag == "meta":
            self._add_meta(named)
        elif tag == "time" and "datetime" in named:
            self.times.append(named["datetime"])
        elif tag == "script" and named.get("type") == "application/ld+json":
            self.script = []
        if tag in VOID_TAGS:
            return
        self._push(tag, self._listeners(tag, named.get("class", "")))

    def handle_endtag(self, tag):
        self._flush()
        if tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def _push(self, tag, listeners):
        self.places.setdefault(tag, []).append(len(self.open))
        self.hidden += tag in HIDDEN_TAGS
        self.skipped += tag in SKIPPED_PARENTS
        self.listening.extend(listeners)
        self.open.append((tag, listeners))

    def _pop_to(self, size):
        while len(self.open) > size:
            tag, listeners = self.open.pop()
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN_TAGS
            self.skipped -= tag in SKIPPED_PARENTS
            for text in listeners:
                text.live = False
            if listeners:
                del self.listening[-len(listeners) :]

    def finish(self) -> PageReader:
        self.close()
        self._flush()
        if self.script is not None:
            self.scripts.append("".join(self.script))
        return self

    def visible_dates(self) -> list[str]:
        text = " ".join(self.visible.parts)
        return [m.group(1) for m in (p.search(text) for p in _DATES) if m]

    def _end_implied(self, tag):
        if tag in CLOSES_PARAGRAPH:
            self._end_open("p", CLOSES_PARAGRAPH - {"p"})
        if tag == "li":
            self._end_open("li", frozenset(("ul", "ol", "menu")))

    def _end_open(self, tag, scope):
        """End the innermost ``tag`` unless a tag of ``scope`` was opened inside it."""
        if self.places.get(tag):
            at = self.places[tag][-1]
            if all(not self.places.get(name) or self.places[name][-1] < at for name in scope):
                self._pop_to(at)

    def _add_meta(self, named):
        for kind in ("name", "property", "itemprop"):
            if kind in named:
                self.meta.setdefault(f"{kind}:{named[kind]}", named.get("content"))

    def _listeners(self, tag, classes) -> list[_Text]:
        """Texts that everything below the new element belongs to, itself included."""
        added: list[_Text] = []
        if tag == "h1" and self.h1 is None:
            self.h1 = _Text()
            added.append(self.h1)
        if tag in ("p", "li"):
            skip = self.skipped > 0 or any(SKIPPED_CLASS in name.lower() for name in classes.split())
            for container in self._open_containers():
                block = _Text(skip)
                container.blocks.append(block)
                added.append(block)
        if tag == "div" and self.body is None and self.rules.body_class in classes.split():
            self.body = _Text()
            added.append(self.body)
        if tag == "div" and self.by_class is None and self.rules.content_class in classes:
            self.by_class = _Container()
            added.append(self.by_class.text)
        if tag == "article" and self.by_article is None:
            self.by_article = _Container()
            added.append(self.by_article.text)
        if tag == "main" and self.by_main is None:
            self.by_main = _Container()
            added.append(self.by_main.text)
        return added

    def _open_containers(self):
        return [c for c in (self.by_class, self.by_article, self.by_main) if c is not None and c.text.live]

    def _flush(self):
        if not self.buffer:
            return
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text or self.hidden:
            return
        self.visible.parts.append(text)
        for target in self.listening:
            target.parts.append(text)


def read_page(html: str, rules: PageRules) -> PageReader:
    reader = PageReader(rules)
    reader.feed(html)
    return reader.finish()


class LinkReader(HTMLParser):
    """What the link job needs: anchors and structured data, outside comments and scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.anchors: list[str] = []
        self.scripts: list[str] = []
        self.script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            named = dict(attrs)
            if named.get("href"):
                self.anchors.append(named["href"])
        elif tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self.script = []

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None

    def finish(self) -> LinkReader:
        self.close()
        if self.script is not None:
            self.scripts.append("".join(self.script))
        return self


def read_links(html: str) -> LinkReader:
    reader = LinkReader()
    reader.feed(html)
    return reader.finish()
