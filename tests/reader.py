"""A stack-based HTML reader on the standard parser, for comparison only."""

from html.entities import html5
from html.parser import HTMLParser

from coursemill.functions.markup import BOILERPLATE_TAGS, TRACKED_TAGS, VOID_TAGS

NAMES = {n.rstrip(";"): c for n, c in html5.items()}


class Node:
    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Node("")
        self.stack = [self.root]
        self.data = []

    def flush(self):
        if self.data:
            self.stack[-1].children.append("".join(self.data))
            self.data = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID_TAGS:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.data.append(data)

    def handle_entityref(self, name):
        self.data.append(NAMES.get(name, "&" + name))

    def handle_charref(self, name):
        self.data.append(chr(int(name[1:], 16) if name[0] in "xX" else int(name)))

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()


def parse(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    reader.flush()
    return reader.root


def strings(node):
    if node.tag in ("script", "style"):
        return
    for child in node.children:
        if isinstance(child, str):
            yield child
        else:
            yield from strings(child)


def text(node):
    return "".join(s.strip() for s in strings(node))


def walk(node):
    for child in node.children:
        if not isinstance(child, str):
            yield child
            yield from walk(child)


def elements(page):
    return [(n.tag, text(n)) for n in walk(parse(page)) if n.tag in TRACKED_TAGS]


def content(page):
    """Text lines of the content area after boilerplate removal."""
    tree = parse(page)
    nodes = list(walk(tree))
    root = next((n for n in nodes if n.tag == "main"), None) or next((n for n in nodes if n.tag == "article"), tree)
    for node in list(walk(root)):
        if node.tag in BOILERPLATE_TAGS and node in node.parent.children:
            node.parent.children.remove(node)
    return "\n".join(s.strip() for s in strings(root) if s.strip())
