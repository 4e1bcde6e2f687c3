"""Main text of pages by their element tree: a forgiving parse with the standard library, in Arrow batches.

Spark has no HTML parser, so these are pandas UDFs; what a regex can say is in text.py. Trees are
built per page and dropped with it. A page that is null or empty gives an empty text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

JUNK_TAGS = frozenset("script style noscript iframe svg form button input select textarea".split())
JUNK_ROLES = frozenset("banner navigation contentinfo search complementary".split())
JUNK = ("nav", "menu", "sidebar", "footer", "header", "breadcrumb", "cookie", "banner", "share", "social", "related", "comment", "widget", "popup", "newsletter", "ad-", "advert")
SAFE = ("content", "article", "main", "post", "entry", "text", "body")
PRIORITY = ("single-post", "article-content", "post-content", "entry-content", "article-body")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "kids", "name", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.kids, self.parent = name, attrs, [], parent

    def walk(self):
        """This node's elements, in order of the page; no recursion, pages may nest deeply."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def strings(self):
        todo = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            else:
                todo += reversed(n.kids)

    def text(self, sep: str = "") -> str:
        return sep.join(t for t in (s.strip() for s in self.strings()) if t)

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.kids.remove(self)
            self.parent = None

    @property
    def classes(self) -> str:
        return " ".join((self.attrs.get("class") or "").split()).lower()

    @property
    def ident(self) -> str:
        return (self.attrs.get("id") or "").lower()


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[page]", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    p = _Parser()
    p.feed(html or "")
    p.close()
    return p.root


def safe(signature: str) -> bool:
    """Whether a signature names something that is likely to hold the text itself."""
    s = signature.lower()
    return any(w in s for w in SAFE)


def cleaned(root: Node, most_links: float = 0.6) -> Node:
    """The tree without scripts and forms, without elements whose role, class or id is that of page furniture, and without blocks that are mostly links; what has a safe name is kept, and blocks with a safe element in them."""
    for n in list(root.walk()):
        if n.name in JUNK_TAGS:
            n.drop()
    gone = []
    for n in root.walk():
        if (n.attrs.get("role") or "") in JUNK_ROLES:
            gone.append(n)
        elif not (any(w in n.classes for w in SAFE) or any(w in n.ident for w in SAFE)) and (any(w in n.ident for w in JUNK) or any(w in n.classes for w in JUNK)):
            gone.append(n)
    for n in gone:
        n.drop()
    gone = []
    for n in root.walk():
        if n.name in ("div", "ul", "section", "aside"):
            size = len(n.text())
            if size >= 10 and sum(len(a.text()) for a in n.walk() if a.name == "a") > most_links * size and not any(w in k.classes for k in n.walk() for w in SAFE):
                gone.append(n)
    for n in gone:
        n.drop()
    return root


def selected(root: Node) -> str:
    """Text of the block that is likely the content: the smallest of over 100 characters with a class that says so, else the largest of semantic elements, safe names and big blocks, else all."""
    best = None
    for n in root.walk():
        if n.name not in ("body", "html") and any(p in n.classes for p in PRIORITY):
            t = n.text()
            if len(t) > 100 and (best is None or len(t) < best[0]):
                best = (len(t), n)
    if best is None:
        for n in root.walk():
            if n.name in ("body", "html", "[page]"):
                continue
            size = len(n.text())
            fits = size > 50 and (n.name in ("main", "article", "section") or any(w in n.classes or w in n.ident for w in SAFE)) or size > 200 and n.name in ("div", "section")
            if fits and (best is None or size > best[0]):
                best = (size, n)
    return SPACE.sub(" ", (best[1] if best else root).text(" ")).strip()


def main_text(html: str | None) -> str:
    """cleaned() and selected(); where that leaves less than 50 characters, the whole page without scripts."""
    t = selected(cleaned(parse(html)))
    if len(t) >= 50:
        return t
    root = parse(html)
    for n in list(root.walk()):
        if n.name in JUNK_TAGS:
            n.drop()
    return SPACE.sub(" ", root.text(" ")).strip()


@F.pandas_udf(T.StringType())
def main_content(html: pd.Series) -> pd.Series:
    return html.map(main_text)


@F.pandas_udf(T.StringType())
def without_furniture(html: pd.Series) -> pd.Series:
    return html.map(lambda h: SPACE.sub(" ", cleaned(parse(h)).text(" ")).strip())


_ISO = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})")


def _iso(y: str, m: str, d: str) -> str | None:
    import datetime

    try:
        return datetime.date(int(y), int(m), int(d)).isoformat()
    except ValueError:
        return None


def _time_under(html: str | None, levels: int, name: str) -> str | None:
    """The first time element's date whose ancestor so many levels up has a class of that name."""
    for n in parse(html).walk():
        if n.name == "time":
            up = n
            for _ in range(levels):
                up = up.parent if up is not None else None
            m = _ISO.match((n.attrs.get("datetime") or "").strip())
            if up is not None and m and name in up.classes.split():
                found = _iso(*m.groups())
                if found:
                    return found
    return None


@F.pandas_udf(T.StringType())
def date_in_content(html: pd.Series) -> pd.Series:
    """Date of the first time element whose grandparent has class content: the article's own, not those of listings beside it."""
    return html.map(lambda h: _time_under(h, 2, "content"))


@F.pandas_udf(T.StringType())
def date_published(html: pd.Series) -> pd.Series:
    """Date of the first time element under one of class published."""
    return html.map(lambda h: _time_under(h, 1, "published"))


_FORMS = (re.compile(r"(?P<d>\d{1,2})\.\s*(?P<m>\d{1,2})\.\s*(?P<y>\d{4})"), re.compile(r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"), re.compile(r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4})"))
_MARKS = r"(?:vydáno|publikováno|aktualizováno|zveřejněno|datum|published|posted|updated|date)[:\s]+.{0,20}?"
_MARKED = tuple(re.compile(_MARKS + f.pattern, re.IGNORECASE | re.DOTALL) for f in _FORMS)


def _form(m: re.Match | None) -> str | None:
    return None if m is None else _iso(m["y"], m["m"], m["d"])


def dated(html: str | None) -> str | None:
    """Date of a page: of an element whose class speaks of dates, from its datetime or, where it is a time element or published, its text; else after a mark of publication in the first 5000 characters."""
    root = parse(html)
    for n in root.walk():
        if n.name in ("time", "span", "div", "p") and re.search("date|time|publish|meta", n.classes):
            found = _form(_FORMS[1].match((n.attrs.get("datetime") or "").strip()))
            if found:
                return found
            if n.name == "time" or "pub" in n.classes:
                t = n.text()
                for f in _FORMS:
                    if m := f.search(t):
                        return _form(m)
    t = root.text(" ")[:5000]
    for f in _MARKED:
        if m := f.search(t):
            return _form(m)
    return None


@F.pandas_udf(T.StringType())
def date_by_context(html: pd.Series) -> pd.Series:
    return html.map(dated)


ROLES = re.compile(r"(?i)\b(ředitel(?:ka)?|předsed(?:a|kyně)|koordinátor(?:ka)?|director|chair|coordinator|manager|expert)\b")
PERSON = re.compile(r"\b([A-ZÁ-Ž][a-zá-ž]+ [A-ZÁ-Ž][a-zá-ž]+)\b")


@F.udtf(returnType="name string, role string")
class Personnel:
    """Names in sections for teams and staff, with a role within 100 characters after them."""

    def eval(self, html: str):
        seen = set()
        for n in parse(html).walk():
            if any(w in f"{n.classes} {n.ident}" for w in ("team", "staff", "people", "contact")):
                t = n.text(" ")
                for m in PERSON.finditer(t):
                    role = ROLES.search(t, m.end(), m.end() + 100)
                    if m[1] not in seen:
                        seen.add(m[1])
                        yield m[1], role[1].lower() if role else None
