"""Main text of pages: marked-up pages by their markup, others by what their host repeats."""

import html
import re

import numpy as np
import pytest

from maskwright.llm import main_text as M

SF = "/root/testdata/sf0.01"


def alone(page):
    read = M.read_page(page)
    return [b.text for b, ok in zip(read.blocks, M.kept_blocks(read, None)) if ok]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, []), ("", []), ("<p> \n </p>", []), ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b>c<br>d&nbsp;e<td>\n f</p>", ["abc d e f"]),
        ("<nav><a>Home</a></nav><header>H</header><article><h1>T</h1><p>x<p>y<ul><li>1<li>2</ul></article><aside>s</aside><footer>f</footer>", ["T", "x", "y", "1", "2"]),
        ("<article><header><h1>T</h1>by me</header><p>x<article class=comment>no</article>y</article><section id=comments>z</section>", ["T", "x", "y"]),
        ("<body class='has-sidebar'><div id='page'><div class='post-content with-ads'><h2>T</h2><div>one <span class=ad>buy</span> two</div><form>f</form><div class='cookie-notice'>c</div></div><div>rest</div></div>", ["T", "one two"]),
        ("<div role=main><p>x</p><div class=shareBar>s</div></div><div>y</div>", ["x"]),
        ("<article>1 < 2 &amp;lt; x<script>var a='</p>'</script><style>p{}</style><!-- no --> y</article>", ["1 < 2 &lt; x y"]),
        ("<article><p>x</p><p title=\"a>b\">y</p><div class=\"a", ["x", "y"]), ("<article>a<p>b<!-- c", ["a", "b"]), ("<article>a<script>b", ["a"]),
        ("<form action=x><div class=widget>w</div><div>the whole page stands in a form</div></form>", ["the whole page stands in a form"]),
        ("<p hidden>h</p><p style='display: none'>n</p><p aria-hidden=true>a</p><p>x</p>", ["x"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a b", "c"]), ("<article class=teaser>t</article><article><p>x</p></article>", ["x"]),
        ("</p></div><i>a</p>b</i>" + "<div>" * 3000 + "deep", ["a", "b", "deep"]),
    ],
)
def test_markup(page, text):
    assert alone(page) == text


def test_a_long_page_is_read_in_whole():
    page = "<article>" + "".join(f"<p>word{i} &eacute;" for i in range(100_000))
    assert alone(page) == [f"word{i} é" for i in range(100_000)]


def brute_spread(streams, depth):
    """For each token of each stream, the most streams that share one of the substrings of ``depth`` tokens around it."""
    grams = {}
    at = lambda s: [(k, tuple(s[k : k + depth])) for k in range(len(s) - depth + 1) if 0 not in s[k : k + depth]]
    for i, s in enumerate(streams):
        for _, g in at(s):
            grams.setdefault(g, set()).add(i)
    out = [[1] * len(s) for s in streams]
    for i, s in enumerate(streams):
        for k, g in at(s):
            for x in range(k, k + depth):
                out[i][x] = max(out[i][x], len(grams[g]))
    return out


@pytest.mark.parametrize("group_tokens", [1 << 16, 40])
def test_spreads_equal_brute_force(spark, monkeypatch, group_tokens):
    monkeypatch.setattr(M, "GROUP_TOKENS", group_tokens)
    rng = np.random.default_rng(2)
    common = [rng.integers(1, 50, int(n)).tolist() for n in (9, 14, 30)]
    hosts = {}
    for key in range(60):
        parts = [common[k] for k in rng.integers(0, 3, int(rng.integers(0, 3)))] + [rng.integers(1, 4 if key % 3 else 9999, int(rng.integers(0, 25))).tolist(), [0]]
        hosts.setdefault(f"h{key % 2}", []).append((key * 7919, [int(t) for k in rng.permutation(len(parts)) for t in parts[k]]))
    rows = [(h, k, len(s), bytearray(np.array(s, np.uint32).tobytes())) for h, v in hosts.items() for k, s in v]
    got = {r["key"]: r["spread"] for r in M.page_spreads(spark.createDataFrame(rows + rows[:1], "host string, key long, n long, tokens binary")).collect()}
    for v in hosts.values():
        assert [got[k] for k, _ in v] == brute_spread([s for _, s in v], M.DEPTH)
    assert max(max(s, default=1) for s in got.values()) > 5


@pytest.mark.parametrize("group_tokens", [1 << 16, 300])
def test_what_a_host_repeats_goes_from_pages_without_markup(spark, monkeypatch, group_tokens):
    monkeypatch.setattr(M, "GROUP_TOKENS", group_tokens)
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    rows, want = [], {}
    for i in range(40):
        body = [prose(int(rng.integers(12, 60))) for _ in range(3)] if i < 34 or i == 37 else want[30 + i % 2].split("\n\n")
        page = f"<div><div>Start here to see all that our site has got</div><div>{'</div><div>'.join(body)}</div><div>Write to us at any time if you have a question, we answer soon</div></div>"
        rows.append((i, f"http://www.Example.org:80/{i}", page))
        want[i] = "\n\n".join(body)
    rows += [(100, "http://alone.example/x", "<div>Start here to see all that our site has got</div>"), (101, None, None), (102, "x", ""), (0, rows[0][1], rows[0][2])]
    want |= {100: "Start here to see all that our site has got", 101: "", 102: ""}
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = M.main_text(df).collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert M.main_text(df.where("page_id < 0")).count() == 0


def test_query_equals_the_marked_article_on_the_given_table(spark):
    """The table's pages mark their articles; a pattern cut to them stands against the reader."""
    got = {r["page_id"]: r for r in M.op13_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"(?:</?(?:p|b|br|h1)>)+", article))
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
    assert sum(r["n_repeated"] > 0 for r in got.values()) > 10
