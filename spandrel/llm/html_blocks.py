"""Pages to leaf blocks: runs of text within one block-level element, with the tags above them."""

from __future__ import annotations

from html.parser import HTMLParser

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = set("script style noscript template iframe head title textarea select".split())
#: What may stand in a head; anything else ends one that was left open.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Within these, every element is part of the line.
EMBEDDED = set("svg math object".split())
#: An element of a key ends any open one of its values, up to the nearest element of SCOPES.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = set("ul ol dl table div section article aside nav main header footer form body html blockquote".split())


class Block:
    """A leaf: its text with white space as it stood, the tokens of its path, and how many of its characters are in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.silent = self.embedded = 0
        self.parts: list[str] = []
        self.linked = self.in_link = 0
        self.out: list[Block] = []
        self.path: tuple[str, ...] = ()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append(Block(text, self.path, self.linked))
            self.parts, self.linked = [], 0

    def _close(self, place: int) -> None:
        """Close every element from this place of the stack on."""
        for tag, _ in self.stack[place:]:
            if self._breaks(tag) and tag not in EMBEDDED:
                self.flush()
            self.silent -= tag in SILENT
            self.embedded -= tag in EMBEDDED
            self.in_link -= tag == "a"
        del self.stack[place:]

    def _breaks(self, tag: str) -> bool:
        return tag not in INLINE and not self.embedded

    def _end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self._close(len(self.stack) - 1)

    def _nearest(self, tags: set[str], scopes: set[str]) -> int | None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in scopes:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif self._breaks(tag):
                self.flush()
            return
        if tag == "body":
            self._close(0)
        if self._breaks(tag) and tag not in EMBEDDED:
            self.flush()
            if (k := self._nearest({"p"}, SCOPES | {"td", "th", "li", "dd"})) is not None:
                self._close(k)
            if tag in ENDS and (k := self._nearest(ENDS[tag], SCOPES - {"body"})) is not None:
                self._close(k)
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                for word in value.lower().replace("_", "-").split():
                    names += [f"{key[0]}.{word}", *(f"w.{x}" for x in word.split("-") if x)]
        self.stack.append((tag, tuple(names)))
        self.silent += tag in SILENT
        self.embedded += tag in EMBEDDED
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._close(k)
                return
        if self._breaks(tag):
            self.flush()

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        if self.silent:
            return
        if not self.parts:
            self.path = tuple(n for _, names in self.stack for n in names)
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    p = _Parser()
    p.feed(html)
    p.close()
    p.flush()
    return p.out
