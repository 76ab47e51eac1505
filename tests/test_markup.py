"""Element scan against a tree walk over random nested pages."""

import random
from html.parser import HTMLParser

import pytest

from sieve.functions import markup
from sieve.operators import ranks
from sieve.operators.abstracts import page_text_without


class Node:
    def __init__(self, name, attrs=()):
        self.name, self.attrs, self.parts = name, dict(attrs), []

    def text(self, without=()):
        return "".join(p if isinstance(p, str) else "" if p.name in without else p.text(without) for p in self.parts)

    def walk(self):
        for p in self.parts:
            if isinstance(p, Node):
                yield p
                yield from p.walk()


class Tree(HTMLParser):
    """A plain tree: an end tag closes the innermost open element of its name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.stack = [Node("root")]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs)
        self.stack[-1].parts.append(node)
        if tag not in markup.VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].parts.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].parts.append(data)

    @property
    def root(self):
        return self.stack[0]


def page(rng, n=60, tags=("ul", "li", "div", "p", "table", "tr", "td", "b", "br")):
    """A page whose elements nest, stay open or are closed without being open."""
    out, open_ = [], []
    for k in range(n):
        kind = rng.random()
        if kind < 0.4:
            tag = rng.choice(tags)
            mark = rng.choice(["", "", f" id='i{k % 7}'", ' class="x>y"', f' ID="i{k % 5}" data-id="i1"'])
            out.append(f"<{tag.upper() if rng.random() < 0.1 else tag}{mark}{'/' if rng.random() < 0.05 else ''}>")
            open_.append(tag)
        elif kind < 0.65 and open_:
            tag = open_.pop() if rng.random() < 0.8 else rng.choice(tags)
            out.append(f"</{tag}>")
        elif kind < 0.7:
            out.append(rng.choice(["<!-- <ul> hidden -->", "<script>if (a < b) '<ul>'</script>", "<style>li > a {}</style>"]))
        else:
            out.append(rng.choice([f"text{k} ", "\n", f"a &amp; b{k}", f"x{k} "]))
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    return [page(rng, rng.randrange(0, 120)) for _ in range(150)] + ["", "no markup", "<ul>open", "</ul>closed", "<ul><li>a<li>b</ul>after", None]


def test_removed_elements(spark, pages):
    df = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "k int, h string")
    for names in (["script", "style", "li", "ul"], ["table"], ["div", "script", "style"]):
        got = {r["k"]: r["t"] for r in df.select("k", page_text_without("h", names).alias("t")).collect()}
        for k, html in enumerate(pages):
            assert got[k] == Tree(html or "").root.text(names), (names, html)


def test_element_by_id(spark, pages):
    df = spark.createDataFrame([(k, h, f"i{k % 7}") for k, h in enumerate(pages)], "k int, h string, e string")
    got = {r["k"]: r["t"] for r in df.select("k", markup.text_by_id("h", "e").alias("t")).collect()}
    found = 0
    for k, html in enumerate(pages):
        first = next((n for n in Tree(html or "").root.walk() if n.attrs.get("id") == f"i{k % 7}"), None)
        assert got[k] == (None if first is None else first.text()), html
        found += first is not None
    assert found > 40


def test_rows_of_nested_tables(spark):
    rng = random.Random(9)
    pages = [page(rng, rng.randrange(10, 150), ("table", "table", "tr", "tr", "td", "td", "p", "ul")) for _ in range(120)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "k int, h string")
    cells = markup.table_cells("h")
    got = {r["k"]: r["cells"] for r in df.select("k", cells.alias("cells")).collect()}
    some = 0
    for k, html in enumerate(pages):
        table = next((n for n in Tree(html).root.walk() if n.name == "table"), None)
        want = [] if table is None else [[c.text() for c in row.walk() if c.name == "td"] for row in table.walk() if row.name == "tr"]
        assert (got[k] or []) == want, html
        some += bool(want)
    assert some > 40


def test_rank_rows_with_a_table_in_a_cell(spark):
    html = ("<table><tr><th>T</th></tr><tr><td>One <table><tr><td>in</td></tr></table></td><td> V1 </td><td>S</td><td>A*</td></tr>"
            "<tr><td>Two</td><td>V2</td><td>S</td><td>B</td></table><table><tr><td>later</td></tr></table>")
    rows = ranks.rank_rows(spark.createDataFrame([(1, html)], "page_id long, html string"), "conference").collect()
    # the cell's own table adds a cell to its row, as in a tree search
    assert [(r["lookup_key"], r["pos"], r["rank_text"]) for r in rows] == [("in", 1, "S"), ("V2", 3, "B")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("<p>x</p>", "a")], "h string, e string")
    plan = df.select(page_text_without("h"), markup.text_by_id("h", "e"), markup.table_cells("h"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
