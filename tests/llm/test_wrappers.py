from __future__ import annotations

import random

from grainline.llm import wrappers

SCHEMA = "page_id long, url string, html string, host string, rule string"


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "h", "r") for r in rows], SCHEMA)
    return {r.page_id: r for r in wrappers.extract_pages(spark, frame).collect()}


def article(r, n):
    return [" ".join(f"w{r.randrange(1000)}" for _ in range(r.randint(4, 30))) for _ in range(n)]


def test_templates_of_several_hosts(spark):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(30):
        p = article(r, r.randint(1, 5))
        body = f"<h1>T{i} &amp; co</h1>" + "".join(f"<p>{x[:9]}<b> {x[9:]}</b>\n</p>" for x in p)
        rows.append((i, f"https://A.example.com/{i}", f"<!DOCTYPE html><html><head><title>no</title><script>var a='</p><article>';</script></head><body class=with-sidebar><header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></ul></nav>"
                     f"<div class='cookie-notice'>We use cookies</div><article>{body}<aside>Related</aside><form>Mail <input></form></article><section id=comments><p>first!</p></section><footer>&copy; x</footer></body></html>"))
        want[i] = "\n".join([f"T{i} & co", *[" ".join(f"{x[:9]} {x[9:]}".split()) for x in p]])
    for i in range(30, 60):
        p = article(r, r.randint(1, 5))
        body = "".join(f"<p>{x}<br>\n more" for x in p)  # p is never closed
        side = "<div class=sidebar><p>Elsewhere today</p></div>" if i % 2 else ""
        rows.append((i, f"http://b.example.org:80/{i}", f"<body><div id=top>Brand</div><div class='post-content'>{body}<div class='share-buttons'>Share it</div><div class=adv-box>Buy</div></div>{side}<div id=page-footer>bye</div></body>"))
        want[i] = "\n".join(f"{x} more" for x in p)
    for i in range(60, 80):
        p = article(r, 6)
        rows.append((i, f"//c.example.net/{i}", f"<body><div><div>Fixed words</div><div>{''.join(f'<p>{x}</p>' for x in p)}</div></div></body>"))
        want[i] = "\n".join(p)
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want
    assert all(x.n_chars == len(x.text) for x in got.values())


def test_wrapper_is_union_free():
    w, n = wrappers.infer([f"<ul>{'<li>x' * k}</ul>{'<p>y</p>' if k % 2 else ''}<i>{k}</i>" for k in range(1, 5)])
    assert n == 4
    assert w.regex() == "<><ul>(<li>x</>)+</>(<p>y</>)?<i>#</></>"


def test_edge_cases(spark):
    page = "<article>one &lt;b&gt; <!-- <p> --> two</article>"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "http://x.org/", None), (2, None, page), (3, "http://x.org/a", ""), (4, "http://x.org/b", "plain text"), (5, "bad url", "<"), (5, "bad url", "<"), (6, "http://y.org", deep), (None, "http://z.org", page),
            (7, "http://w.org", "<article>" + "<p>word word</p>" * 20_000 + "</article>"), (8, "http://v.org", "<p title='a>b'>x &#x41;&eacute;&nbsp;y</p><script>never</script><p>cut <b")]
    got = run(spark, rows)
    assert {k: v.text for k, v in got.items() if k != 7} == {1: "", 2: "one <b> two", 3: "", 4: "plain text", 5: "<", 6: "deep text", None: "one <b> two", 8: "x Aé y\ncut <b"}
    assert got[7].n_chars == 20_000 * 10 - 1
    assert run(spark, []) == {}


def test_all_pages_of_a_host_make_its_wrapper(spark):
    r = random.Random(8)
    rows, want = [], {}
    for i in range(200):  # a rare layout of its own; one heading is the same on most pages, one line on all: both are article text
        p, head = article(r, r.randint(2, 4)), f"T{i}" if i % 9 == 0 else "Report"
        inner = f"<h1>{head}</h1><span>Read this first</span>" + "".join(f"<p>{x}</p>" for x in p)
        box = f"<div class=post>{inner}</div>" if i % 20 == 3 else f"<article>{inner}</article>"
        rows.append((i, f"http://two.example.org/{i}", f"<body><div>Brand {i}</div>{box}<div>Elsewhere {i * i}</div></body>"))
        want[i] = "\n".join([head, "Read this first", *p])
    for i in range(200, 240):  # copies are one page
        p = article(r, 3)
        page = f"<body><div>Brand</div><article><h2>Always here</h2>{''.join(f'<p>{x}</p>' for x in p)}</article></body>"
        rows += [(i + 1000 * k, f"http://copies.example.org/{i}", page) for k in range(10)]
        want |= {i + 1000 * k: "\n".join(["Always here", *p]) for k in range(10)}
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want


def test_runs_of_two_in_turn():
    w, _ = wrappers.infer(["<dl><dt>1<dd>a<dt>2<dd>b<dt>3<dd>c</dl><i>q</i><dl><dt>4<dd>d</dl>"])
    assert w.regex() == "<><dl>(<dt>#</>)+(<dd>#</>)+</><i>q</><dl><dt>4</><dd>d</></></>"


def test_order_of_rows_does_not_matter(spark):
    r = random.Random(9)
    rows = [(i, "http://x.org", f"<body>{''.join(r.choice(['<p>a', '<i>b</i>', '<ul><li>c</ul>', f'<b>{i}</b>']) for _ in range(9))}</body>") for i in range(200)]
    first = {i: x.text for i, x in run(spark, rows).items()}
    r.shuffle(rows)
    assert {i: x.text for i, x in run(spark, rows).items()} == first


def test_long_pages_and_pages_without_the_containers(spark):
    r = random.Random(10)
    rows, want = [], {}
    for i in range(3):  # a host of long pages only
        p = [" ".join(["long"] * 100) + f" {i} {k}" for k in range(2500)]
        page = f"<body><div>Brand</div><article>{''.join(f'<p>{x}</p>' for x in p)}</article><div>Elsewhere</div></body>"
        assert len(page) > 1 << 20
        rows.append((i, "http://long.example.org", page))
        want[i] = "\n".join(p)
    for i in range(3, 43):  # every tenth page has no container that its key tells
        p = article(r, 5)
        inner = "<span>Read this first</span>" + "".join(f"<p>{x} {x}</p>" for x in p)
        box = f"<div class=x>{inner}</div>" if i % 5 == 0 else f"<article>{inner}</article>"
        rows.append((i, "http://some.example.org", f"<body><div>Brand</div>{box}</body>"))
        want[i] = "\n".join([*([] if i % 5 == 0 else ["Read this first"]), *[f"{x} {x}" for x in p]])
    got = run(spark, rows)
    assert {i: got[i].text for i in want} == want


def _texts(pages):
    rule = wrappers.rules(*wrappers.infer(pages))
    return [wrappers.extract(p, rule) for p in pages]


def test_the_number_of_pages_does_not_change_a_text():
    pages = [f"<body><p>Brand</p><article><h2>Summary</h2><p>Text {i}</p></article></body>" for i in range(8)]
    for n in (1, 2, 4, 6, 8):
        assert _texts(pages[:n]) == [f"Summary\nText {i}" for i in range(n)]


def test_a_form_around_the_article_is_layout():
    r = random.Random(12)
    pages, bare = [], []
    for _ in range(8):
        p = [" ".join(x) for x in (r.choices("abcdefgh", k=30), r.choices("ijklm", k=30))]
        inner = "".join(f"<p>{x}</p>" for x in p)
        mail = "<form><label>Mail</label><input></form>"
        pages.append((f"<body><form id='aspnetForm'><div class=menu>Home</div><article>{inner}{mail}</article></form></body>", "\n".join(p)))
        bare.append((f"<body><div>Brand</div><form action=x><div><div>{inner}</div></div></form></body>", "\n".join(p)))
    for rows in (pages, bare, pages[:1], bare[:1]):
        assert _texts([x for x, _ in rows]) == [y for _, y in rows]


def test_a_weak_word_does_not_hide_most_of_the_article():
    assert _texts(["<main><section class='legal'><p>Law text</p></section><p>x</p></main>"]) == ["Law text\nx"]
    notes = [f"<main><p>Long text number {i} {'word ' * 40}</p><div class=notice>Note {i}</div></main>" for i in range(6)]
    assert [t.count("Note") for t in _texts(notes)] == [0] * 6
    fixed = [f"<main><div class=legal>{'All rights are reserved. ' * 9}</div><p>Text {i}</p></main>" for i in range(6)]
    assert _texts(fixed) == [f"Text {i}" for i in range(6)]


def test_formulas_and_depth():
    assert _texts(["<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>"]) == ["Let x=1."]
    deep = "<article>" + "<div>" * 250 + "<nav>Menu</nav><p>Text</p>" + "</div>" * 250 + "</article>"
    assert _texts([deep]) == ["Text"]


def test_longest_common_sequence():
    r = random.Random(11)
    for _ in range(500):
        a, b = (r.choices("abcdefgh"[: r.randint(1, 8)], k=r.randint(0, 30)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = wrappers._common(a, b)
        assert len(got) == best[-1][-1]
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
