from __future__ import annotations

import random
from collections import defaultdict

import pytest

from spiketide.llm import html_main as h
from spiketide.llm import queries
from spiketide.llm.frames import load

SF = "/root/testdata/sf0.001"

CASES = [
    ("<nav><a>Menu</a></nav><article><h1>Title</h1><p>One &amp; two<br>three&nbsp; four</article><footer>x</footer>", "Title\nOne & two three four"),
    ("<article><p><b>Open<br><p>second <i>it</i>alic</p><div class='comments'><p>reader</p></div></article>", "Open\nsecond italic"),
    ("<article><header><h1>Head</h1></header><aside>no</aside><p>yes</p><form><p>no</p></form></article>", "Head\nyes"),
    ("<div class='ad-slot'>buy</div><main><p>a<script>if (a<b) '</p>'</script>b</p><!-- c > d --><ul><li>x<li>y</ul></main>", "a b\nx\ny"),
    ("<body class='has-sidebar'><article>text &lt;b&gt; &#233;<div id=cookie-notice>ok?</div> tail</article>", "text <b> é\ntail"),
    ("<p>no article here</p><div role='navigation'>menu</div><p hidden>not</p>end", "no article here\nend"),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<title>t</title><article></article>", ""),
    ("a < b and <article>c < d</article>", "c < d"),
    (None, ""),
    ("", ""),
    ("plain text", "plain text"),
]


@pytest.mark.parametrize("copies", [1, 2])
def test_markup(spark, copies):
    rows = [(i, f"http://h{i}/x", page, "k") for i, (page, _) in enumerate(CASES)] * copies + [(None, None, CASES[0][0], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(pages).collect()
    want = sorted([(str(i), text) for i, (_, text) in enumerate(CASES)] * copies + [("None", CASES[0][1])])
    assert sorted((str(r.page_id), r.text) for r in got) == want
    assert h.extract(pages.limit(0)).collect() == []


WRAPPED = [
    ("<div class='layout has-sidebar'><nav>m</nav><article><p>in a layout</p></article></div>", "in a layout"),
    ("<div id='page' class='with-header'><article>in a page</article></div>", "in a page"),
    ("<body><form action=x><header>top</header><main><p>in a form</p></main><footer>f</footer></form></body>", "in a form"),
    ("<p>Site</p><div class='layout sidebar-right'><div ROLE=MAIN>by role here</div></div>", "by role here"),
    ("<div class='header'><article>under a header class</article></div>", "under a header class"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p class='notice'>mind</p><p class='related-work'>others</p></article>", "Title\nmind\nothers"),
    ("<article><div class='ad-slot'>buy</div>kept<div id='comment-12'>no</div><div class='related'><article>teaser</article></div></article>", "kept"),
    ("<article>story</article><div class='sidebar'><article>a teaser</article></div><form><article>box</article></form>", "story"),
    ("<div>the long text of this page stands in a plain element</div><div class='sidebar'><article>teaser</article></div>", "the long text of this page stands in a plain element"),
    ("<nav><article>n</article></nav><aside><article>a</article></aside><footer><main>f</main></footer><div class='comments'><article>c</article></div>", ""),
    ("<body class='comments'><article>open to readers</article></body>", "open to readers"),
]


@pytest.mark.parametrize("page, text", WRAPPED)
def test_articles_in_wrappers(page, text):
    blocks = h.blocks_of(page)
    main = [t for k, t in blocks if k == h.MAIN]
    assert "\n".join(main or [t for k, t in blocks if k == h.OPEN]) == text


def test_repeated_runs_of_a_host_go(spark, monkeypatch):
    monkeypatch.setattr(h, "PART_WORDS", 60)
    draw = random.Random(4)
    line = " ".join(f"boiler{k}" for k in range(12))
    rows, want = [], {}
    for i in range(12):
        own = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(9)) for _ in range(3)]
        host = "one.org" if i < 8 else f"other{i}.org"
        page = f"<div>{own[0]}</div><div>{line}</div><div>{own[1]} {line}</div><p>{own[2]}</p>"
        rows.append((i, f"https://{host}/{i}", page))
        want[i] = "\n".join(own) if i < 8 else "\n".join([own[0], line, f"{own[1]} {line}", own[2]])
    rows.append((12, "https://copies.org/1", "<p>" + line + "</p>"))
    want[12] = line
    rows += [(13, f"https://copies.org/{k}", rows[-1][2]) for k in range(5)]
    want[13] = line
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.page_id] for r in got)


def test_headings_of_the_menu_and_near_copies_stay(spark, monkeypatch):
    monkeypatch.setattr(h, "PART_WORDS", 300)
    draw = random.Random(5)
    menu = "".join(f"<li>{w}</li>" for w in "Home News Sport Money Travel Food Music Films Books Games Radio Help".split())
    text = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    foot = text(15)
    rows, want = [], {}
    for i in range(6):
        lead, own = text(9), text(30)
        rows.append((i, f"http://news.org/{i}", f"<nav><ul>{menu}</ul></nav><p>{lead}</p><h2>News</h2><p>{own}</p><div>{foot}</div>"))
        want[i] = f"{lead}\nNews\n{own}"
    story = text(80).split()
    for i in range(6, 12):
        told = " ".join([*story[: 10 * (i - 5)], f"changed{i}", *story[10 * (i - 5) + 1 :]])
        rows.append((i, f"http://news.org/{i}", f"<nav><ul>{menu}</ul></nav><h2>Sport</h2><p>{told}</p><div>{foot}</div>"))
        want[i] = f"Sport\n{told}"
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def told(draw: random.Random, n: int) -> str:
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))


@pytest.mark.parametrize("words", [40, 100_000])
def test_the_array_judges_pages_with_articles(spark, monkeypatch, words):
    monkeypatch.setattr(h, "PART_WORDS", words)
    monkeypatch.setattr(h, "LEAST_BUCKETS", 3)
    draw = random.Random(6)
    teaser, licence, menu = told(draw, 12), told(draw, 15), told(draw, 10)
    rows, want = [], {}
    for i in range(5):
        own = told(draw, 30)  # a story in a plain block beside a teaser of the whole host
        rows.append((i, f"http://a.org/{i}", f"<nav>{menu}</nav><article class=card>{teaser}</article><div>{own}</div>"))
        want[i] = own
    for i in range(5, 9):  # a licence in each article stays
        own = told(draw, 30)
        rows.append((i, f"http://a.org/{i}", f"<nav>{menu}</nav><article><p>{own}</p><p>{licence}</p></article><div>{told(draw, 50)}</div>"))
        want[i] = f"{own}\n{licence}"
    rows.append((9, "http://b.org/9", f"<article class=card>{teaser}</article><div>{told(draw, 30)}</div>"))  # of one page of its host
    want[9] = teaser
    rows.append((10, "http://a.org/10", f"<nav>{menu}</nav><article>{teaser}</article><p>{told(draw, 5)}</p>"))
    want[10] = teaser
    for i in range(11, 15):  # without plain blocks a repeated article stays
        rows.append((i, "http://c.org/", f"<nav>{told(draw, 9)}</nav><article>{licence}</article>"))
        want[i] = licence
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)


def test_an_article_and_its_bare_versions_are_one_page_of_a_host(spark):
    draw = random.Random(7)
    story = told(draw, 60)
    rows = [(i, "http://p.org/", f"<nav>{told(draw, 3)}</nav><article>{story}</article>") for i in range(3)]
    rows.append((3, "http://p.org/print", f"<p>{story}</p>"))
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [story] * 4


def test_tokens_are_those_of_the_words():
    words = ["a", "b", "ab", "ba", "a\x01", "é", "x" * 5000, "x" * 5001, "\x01", "\x00a", "a\x00"]
    draw = random.Random(10)
    for _ in range(50):
        picked = [draw.choice(words) for _ in range(draw.randrange(1, 20))]
        at = h.tokens_of(" ".join(picked), 5).tolist()
        assert len(at) == len(picked) and all((x == y) == (v == w) for x, v in zip(at, picked) for y, w in zip(at, picked))
    assert h.tokens_of("a b\nc").tolist() == [int(h.tokens_of(w)[0]) for w in ("a", "b", "\x00", "c")]
    assert len(h.tokens_of("")) == 1 and h.tokens_of("a")[0] != h.tokens_of("a", 1)[0]


@pytest.mark.parametrize("words", [60, 100_000])
def test_repeated_runs_as_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(h, "PART_WORDS", words)
    draw = random.Random(9)
    phrases = [told(draw, 9) for _ in range(6)]
    rows, seen = [], defaultdict(set)
    for i in range(60):
        page = f"<nav>{draw.choice(phrases)}</nav><article>{draw.choice(phrases)} {told(draw, 4)} {draw.choice(phrases)}</article>"
        rows.append((f"http://h{i % 4}.org/", page))
    rows += rows[:5]
    runs_of = {}
    for url, page in rows:
        stream, salt = h.stream_of(h.blocks_of(page)), h.salt_of(h.host_of(url))
        key = h.key_of(stream, salt)
        runs_of[key] = set(h.windows(h.tokens_of(stream, salt)).view("i8").tolist())
        for run in runs_of[key]:
            seen[run].add(key)
    want = {k: kept for k, runs in runs_of.items() if (kept := {r for r in runs if len(seen[r]) >= h.PAGES})}
    pages = spark.createDataFrame(rows, "url string, html string").repartition(3)
    got = h.boilerplate(pages, h.met_runs(pages)).collect()
    assert want and {r.key: set(r.runs) for r in got} == want and all(len(set(r.runs)) == len(r.runs) for r in got)


def test_suffix_array_as_brute_force():
    draw = random.Random(8)
    streams = ["\n".join(" ".join(draw.choice("ab") for _ in range(draw.randint(1, 30))) for _ in range(3)) for _ in range(8)] + ["a b"]
    seen = defaultdict(set)
    for k, s in enumerate(streams):
        for run in h.windows(h.tokens_of(s)).view("i8").tolist():
            seen[run].add(k)
    runs, pages = h.repeated_runs(streams)
    assert dict(zip(runs.tolist(), pages.tolist())) == {r: len(p) for r, p in seen.items()}


def test_query(spark):
    pages = {r.page_id: r for r in load(spark, SF, "pages").collect()}
    got = queries.op7_html_main_text(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        page = pages[r.page_id]
        assert r.url == page.url and r.n_chars == len(r.text)
        inner = page.html.split("<article>")[1].split("</article>")[0]
        assert "<" not in r.text and "©" not in r.text and r.text.split("\n")[0].split()[0] in inner
