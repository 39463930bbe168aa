import random

from quillspark.llm import page_diff as D


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        found, rest = D.shared(a, b), iter(b)
        assert len(found) == lcs(a, b) and all(a[i] in rest for i in sorted(found))


def test_zones():
    page = '<head><title>t</title></head><nav>n</nav><header>h</header><article><h1>T &amp; t</h1><p>a<b>b</b> c&nbsp;d<br>e<div class="comments"><p>no</p></div><script>"</p>"</script></article><footer>f'
    assert D.main_text(D.page_lines(page), None) == "T & t ab c d e"


def test_difference_without_main_container(spark):
    shell = "<html><body><div>Site name</div><p>{}</p><div>All rights</div></body></html>"
    rows = [(i, f"http://h.example/a/{i}", shell.format(f"own text {i}")) for i in range(40)] + [(90, "http://lone.example/x", shell.format("alone")), (91, None, None), (92, "http://void.example/q", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as lines", "2 as part")
    for ranges in (1, 7):
        got = {r.page_id: r for r in D.extract(pages, ranges=ranges).collect()}
        assert len(got) == 43 and all(got[i].text == f"own text {i}" for i in range(40))
        assert got[90].text == "Site name alone All rights" and got[91].text == "" and got[92].n_chars == 0
    assert D.extract(pages.where("false")).count() == 0


def test_copies_without_main_container(spark):
    shell = "<html><body><div>Site name</div><p>{}</p><div>All rights</div></body></html>"
    rows = [(1, "http://m.example/a/1", shell.format("story")), (2, "http://m.example/a/2", shell.format("story")), (3, "http://two.example/1", shell.format("tale")), (4, "http://two.example/2", shell.format("tale"))]
    rows.append((5, "http://m.example/b", shell.format("other")))
    got = {r.page_id: r.text for r in D.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ranges=1).collect()}
    # page 1 has copies only; page 2 also has a neighbour that tells the site's lines
    assert got == {1: "Site name story All rights", 2: "story", 3: "Site name tale All rights", 4: "Site name tale All rights", 5: "other"}


def run(spark, rows, ranges=1):
    return {r.page_id: r.text for r in D.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), ranges=ranges).collect()}


def test_difference_decides_inside_the_main_container(spark, monkeypatch):
    shell = '<body><article class="post"><h1 class="t">Daily notes</h1><div class="k7"><h2>Friday</h2><p>Join us</p></div><div class="body"><p class="x1">own {0} a long story that no other page tells</p><p>recurs</p><p class="x2">own {0} again</p><p class="x3">recurs</p></div></article><article class="card"><h3>Pinned</h3><p>elsewhere</p></article></body>'
    rows = [(i, f"http://h.example/a/{i}", shell.format(i)) for i in range(40)] + [(90, "http://lone.example/x", shell.format(90))]
    text = "Daily notes own {0} a long story that no other page tells recurs own {0} again recurs"
    for ranges in (1, 7):
        got = run(spark, rows, ranges)
        assert all(got[i] == text.format(i) for i in range(40))
        assert got[90] == "Daily notes Friday Join us own 90 a long story that no other page tells recurs own 90 again recurs Pinned elsewhere"
    # the stage is what tells: without deleted lines every text is another
    lines, other = D.page_lines(rows[0][2]), D.page_lines(rows[1][2])
    before = D.main_text(lines, other)
    monkeypatch.setattr(D, "shared", lambda a, b: set())
    assert before == text.format(0) and D.main_text(lines, other) == got[90].replace("90", "0")


def test_copies_and_open_tags_inside_the_main_container(spark):
    # copies don't tell the site's lines; page 2 has another neighbour that does
    shell = '<main><div class="k7">Join us</div><section class="s"><p>{}</p><p>{}</p></section></main>'
    rows = [(1, "http://m.example/a/1", shell.format("a story", "told")), (2, "http://m.example/a/2", shell.format("a story", "told")), (3, "http://m.example/b", shell.format("another", "tale"))]
    assert run(spark, rows) == {1: "Join us a story told", 2: "a story told", 3: "another tale"}
    # paragraphs whose end tags were left out are of one kind; side zones' lines aren't met
    a, b = (D.page_lines(f'<nav>own 1</nav><article><p class="q"><b>own {i} long<br><p class="q">recurs<p class="q"><b>end {i}<p class="q">recurs</article>') for i in (1, 2))
    assert D.main_text(a, b) == "own 1 long recurs end 1 recurs"
    c = D.page_lines('<article><p>own text</p><div class="z">News</div></article>')
    assert D.main_text(c, D.page_lines("<nav>News</nav><article><p>other</p></article>")) == "own text News"
    assert D.main_text(D.page_lines('<article><div class="z">a<span class="entry-content">b</span>c</div>'), None) == "abc"
