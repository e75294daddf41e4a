import pytest
from pyspark.sql import functions as F

from corpusguard.operators import links
from corpusguard.plans.site import check_site

CARD = '<a class="hextra-feature-card" href="/">c</a>'


def home(inner):
    marks = "<div data-knowledge-stats data-published-documents=1 data-published-categories=1></div>"
    return f"<h1>Home</h1>{marks}{CARD * 3}{inner}"


def problems(spark, *files, site="h.example"):
    pages = spark.createDataFrame([(site, f, h) for f, h in files], "site string, file string, html string")
    return sorted((r["file"], r["kind"], r["target"]) for r in check_site(pages).collect())


FORMS = ('<a href="{}">t</a>', "<a href='{}'>t</a>", "<a href={}>t</a>", "<img alt=x src={}>")


def test_every_form_of_every_link(spark):
    """One page per form and target; targets that exist stand beside ones that don't."""
    there, absent = ["/p/b&amp;c", "/p/v1.2", "/p/", "/p/#top", "?q=1"], ["/p/bb", "/p/v1.3", "/q/", "x.html"]
    files = [("index.html", home("")), ("p/index.html", "p"), ("p/b&c.html", "p"), ("p/v1.2.html", "p")]
    expected = []
    for k, form in enumerate(FORMS):
        for m, target in enumerate(there + absent):
            file = f"links/{k}-{m}.html"
            files.append((file, form.format(target)))
            if target in absent:
                path = target.strip("/") if target.startswith("/") else f"links/{target}"
                expected.append((file, "missing_target", path))
    assert problems(spark, *files) == sorted(expected)


def test_folder_is_no_page(spark):
    """A page beside a folder doesn't stand for it, and a folder needs an index of its own."""
    files = [("index.html", home("<a href=/f>x</a><a href=/g/>x</a>")), ("f/y.html", "y"), ("f.html", "f"), ("g/h/index.html", "h")]
    assert [(f, t) for f, _, t in problems(spark, *files)] == [("index.html", "f"), ("index.html", "g")]


@pytest.mark.parametrize(
    "file, titles, repeated",
    [
        ("docs/k/index.html", ("A &lt; B", "A &lt;  B"), True),
        ("docs/k/index.html", ("A", "B"), False),
        ("docs/k/index.html", ("A", "B", "A"), False),
        ("docs/k/l.html", ("A", "A"), False),
        ("news/index.html", ("A", "A"), False),
    ],
)
def test_repeated_title(spark, file, titles, repeated):
    body = "".join(f"<h1 id=t{k}><i>{title}</i></h1>" for k, title in enumerate(titles))
    found = problems(spark, ("index.html", home("")), (file, body))
    assert found == ([(file, "repeated_title", None)] if repeated else [])


def test_home_contract(spark):
    assert problems(spark, ("index.html", "<h1>plain</h1>")) == [("index.html", "page_contract", None)]
    bad_count = home(CARD)
    assert problems(spark, ("index.html", bad_count)) == [("index.html", "page_contract", None)]


RESOLVE = [
    ("", "external", None),
    ("#a", "external", None),
    ("//cdn/x", "external", None),
    ("mailto:a@b", "external", None),
    ("https://other.example/x", "external", None),
    ("HTTPS://H.example:443/x%20y", "internal", "x y"),
    ("?q=1", "external", None),
    ("../x", "internal", "x"),
    ("../../x", "invalid", None),
    ("/../x", "invalid", None),
    ("/", "internal", "."),
    ("y.html#z", "internal", "d/y.html"),
    ("a+b%2Bc", "internal", "d/a+b+c"),
    ("a%zz", "invalid", None),
    ("a:b", "external", None),
    ("1a:b", "invalid", None),
    (".//x/./y/", "internal", "d/x/y"),
    ("http://h.example", "external", None),
    ("http://h.example:x/y", "invalid", None),
]


def test_resolve(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RESOLVE)], "i int, raw string")
    resolved = rows.select("i", links.resolve_link(F.lit("h.example"), F.lit("d/p.html"), F.col("raw")).alias("r"))
    got = {r["i"]: (r["r"]["status"], r["r"]["target"]) for r in resolved.collect()}
    assert [got[i] for i in range(len(RESOLVE))] == [(s, t) for _, s, t in RESOLVE]


@pytest.mark.parametrize("pages_of_hot_link", [300])
def test_hot_missing_target_stays_whole(spark, pages_of_hot_link):
    """One target holding nearly all links: every page is reported, none twice."""
    pages = spark.range(pages_of_hot_link).select(
        F.lit("s").alias("site"),
        F.concat(F.lit("p"), "id", F.lit(".html")).alias("file"),
        F.concat(F.lit("<a href=/gone>x</a><a href='/gone'>y</a><a href=/p"), "id", F.lit(".html>me</a>")).alias("html"),
    )
    rows = links.broken_links(links.page_targets(pages), pages).collect()
    assert len(rows) == pages_of_hot_link == len({r["file"] for r in rows})
    assert {r["target"] for r in rows} == {"gone"}


def test_sites_do_not_mix(spark):
    pages = spark.createDataFrame(
        [("one", "a.html", "<a href=/b.html>x</a>"), ("two", "b.html", "ok")], "site string, file string, html string"
    )
    rows = links.broken_links(links.page_targets(pages), pages).collect()
    assert [(r["site"], r["target"]) for r in rows] == [("one", "b.html")]
