"""Main texts of pages: written by hand, and the suffixes against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import html

KIND = "page_id long, url string, html string, text string, n_chars int"
CHROME = (
    '<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">'
    '<header class=top><a href="/">Home</a> Site name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>'
    '<div class="cookie-notice" id=c1>We use cookies.</div><form><label>Search</label><input name=q><button>Go</button></form>'
)
END = '<section id="comments"><article class="comment"><p>First!</p></article></section><aside>See also</aside><div class="ad banner">Buy now</div><noscript>Enable it</noscript><footer>&copy; 2024</footer></body></html>'


def article(body):
    return f"{CHROME}<article>{body}</article>{END}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (article("<header><h1>A &amp; B</h1></header><p>One\n two&nbsp;three<br>four <b>bo</b>ld</p>"), "A & B\n\nOne two three four bold"),
        (article("<p><b>Never closed.<br><p>Next<p>Third<div>in <i>a</i> div</div>tail"), "Never closed.\n\nNext\n\nThird\n\nin a div\n\ntail"),
        (article('<p>Kept</p><div class="ad">Not kept</div><p>Also <span class="share-buttons">tweet</span> kept</p><footer>by me</footer>'), "Kept\n\nAlso\n\nkept"),
        (article("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><th>f</table>&lt;p&gt; &#233;&#x1F600;"), "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\n<p> é😀"),
        (article("<p hidden>no</p><p style='display: none'>no</p><p title='a > b'>yes</p><!-- <p>no</p> --><template><p>no</p></template>"), "yes"),
        (f"{CHROME}<main><h1>T</h1><p>x < y and <3</p></main>{END}", "T\n\nx < y and <3"),
        ('<form id="all"><main><p>Wrapped page</p></main></form>', "Wrapped page"),
        ('<nav>menu</nav><div id="content"><h1>T</h1><p>text</p></div><div>elsewhere</div>', "T\n\ntext"),
        ("plain text only", "plain text only"),
        ("<article><p>Cut off in the mid", "Cut off in the mid"),
        ("<article>a<!-- never closed <p>b</p></article>", "a"),
        ("<article>a<script>never closed <p>b</p></article>", "a"),
        ("<article></article>", ""),
        (None, ""),
        ("", ""),
        ("<" * 50 + "a" * 3, "<" * 50 + "aaa"),
        ("<a" * 200_000, "<a" * 200_000),
        ("<article>" + "<div>" * 50_000 + "deep" + "</div>" * 20_000 + "</article>", "deep"),
    ],
)
def test_texts_of_single_pages(spark, page, want):
    blocks = html.blocks_of(page or "")
    for part in ("content", "holder", "open"):
        if own := [b.text for b in blocks if b.part == part]:
            break
    assert "\n\n".join(own) == want


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def open_page(rng, host, own, passage=""):
    """A page without any element or name that tells its parts."""
    return f"<body><div><div>{host} is your site for everything there is and more</div><div>Read what others think of it today</div></div><div><div><b>{words(rng, 4)}</b><p>{own}</p>{passage}</div></div><div>All rights reserved by {host} and its many owners since 1999</div></body>"


@pytest.fixture(scope="module")
def site():
    rng, rows, want = random.Random(3), [], []
    for k in range(60):
        host = ["one.test", "TWO.test", "one.test", "three.test"][k % 4]
        own = [words(rng, rng.randint(12, 60)) for _ in range(3)]
        page = open_page(rng, host.lower(), own[0], "".join(f"<p>{x}</p>" for x in own[1:]))
        title = page.split("<b>")[1].split("</b>")[0]
        rows.append((k, f"https://{host}/p/{k}?x=://y", page, "mine", k))
        want.append((k, "\n\n".join([title, *own])))
    return rows, want


def test_what_a_host_repeats_goes(spark, site):
    rows, want = site
    shared = words(random.Random(9), 30)
    extra = [
        (60, "http://one.test/article", article(f"<p>{shared}</p>"), None, 0),  # articles keep what they share
        (61, "http://one.test/copy", article(f"<p>{shared}</p>"), None, 0),
        (62, "http://pair.test/1", f"<p>{shared}</p><p>once more</p>", None, 0),  # copies of a page don't wipe each other out
        (62, "http://pair.test/1", f"<p>{shared}</p><p>once more</p>", None, 0),
        (63, "http://alone.test/", f"<p>{shared}</p>", None, 0),
        (None, None, None, None, None),
        (64, "no address", "", None, 0),
    ]
    texts = [*want, (60, shared), (61, shared), (62, f"{shared}\n\nonce more"), (62, f"{shared}\n\nonce more"), (63, shared), (None, ""), (64, "")]
    made = spark.createDataFrame([*rows, *extra], KIND).repartition(7)
    got = html.main_text(made)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = lambda r: (r[0] is None, r[0] or 0)
    found = sorted(((r.page_id, r.text) for r in got.collect()), key=by)
    assert found == sorted(texts, key=by)
    assert {(r.page_id, r.n_chars) for r in got.collect()} == {(k, len(t)) for k, t in texts}
    assert html.main_text(made.limit(0)).count() == 0


def test_a_run_on_most_pages_goes_from_copies_too(spark):
    rng = random.Random(4)
    own = words(rng, 25)
    pages = [(k, "http://h.test/", open_page(random.Random(1), "h.test", own), None, 0) for k in range(3)]
    pages += [(k, "http://h.test/", open_page(rng, "h.test", words(rng, 40)), None, 0) for k in range(3, 40)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, KIND)).collect()}
    assert all("rights reserved" not in t and "your site" not in t for t in got.values())
    assert all(own in got[k] for k in range(3))


def test_sampled_suffixes_meet_in_every_shared_run():
    rng = random.Random(2)
    least = html.AGREE + html.WINDOW - 1
    for _ in range(200):
        run = [f" {rng.randint(0, 5)}" for _ in range(least)]
        a, b = ([*(f" {rng.randint(0, 5)}" for _ in range(rng.randint(0, 40))), *run, *(f" {rng.randint(0, 5)}" for _ in range(rng.randint(8, 40)))] for _ in range(2))
        (at_a, keys_a), (at_b, keys_b) = (html.sampled_suffixes(t, "h") for t in (a, b))
        assert set(keys_a) & set(keys_b)
        agreeing = {(i, j) for i, x in zip(at_a, keys_a) for j, y in zip(at_b, keys_b) if x == y}
        pad = lambda t, i: tuple((t + [None] * html.AGREE)[i : i + html.AGREE])
        assert agreeing == {(i, j) for i in at_a for j in at_b if pad(a, i) == pad(b, j)}
    assert not set(html.sampled_suffixes(run, "h")[1]) & set(html.sampled_suffixes(run, "other")[1])


def test_what_most_articles_of_a_host_hold_goes_from_them(spark):
    """A notice that no name tells, within the article on every page, goes; what a quarter share stays, as does a page copied over its host."""
    rng = random.Random(8)
    notice, passage, copied = words(rng, 14), words(rng, 20), words(rng, 40)
    pages, want = [], {}
    for k in range(40):
        own = [words(rng, 30), *([passage] if k % 4 == 0 else []), words(rng, 50)]
        pages.append((k, "http://news.test/", article("".join(f"<p>{x}</p>" for x in (own[0], notice, *own[1:]))), None, 0))
        want[k] = "\n\n".join(own)
    for k in range(40, 70):
        text = copied if k < 58 else words(rng, 30)
        pages.append((k, "http://copy.test/", article(f"<p>{text}</p>"), None, 0))
        want[k] = text
    for k in range(70, 79):  # too few articles to tell
        own = words(rng, 30)
        pages.append((k, "http://few.test/", article(f"<p>{own}</p><p>{notice}</p>"), None, 0))
        want[k] = f"{own}\n\n{notice}"
    for k in range(79, 95):  # articles alike in most of their words
        own = words(rng, 10)
        pages.append((k, "http://alike.test/", article(f"<p>{copied}</p><p>{own}</p>"), None, 0))
        want[k] = f"{copied}\n\n{own}"
    made = spark.createDataFrame(pages, KIND).repartition(5)
    assert {r.page_id: r.text for r in html.main_text(made).collect()} == want


def test_keys_on_most_pages_leave_a_task():
    rng = np.random.default_rng(5)
    for held in (1, 40, 1000):
        lists = [(f"h{rng.integers(3)}", np.unique(rng.integers(0, 9, rng.integers(0, 9)))) for _ in range(60)]
        batches = [pa.RecordBatch.from_arrays([pa.array([h for h, _ in part]), pa.array([k for _, k in part], pa.list_(pa.int64()))], names=["host", "own_keys"]) for part in (lists[:25], lists[25:])]
        got = {(r["host"], r["key"]) for b in html._common(iter(batches), held) for r in b.to_pylist()}
        for host in ("h0", "h1", "h2"):
            own = [k for h, k in lists if h == host]
            most = {(host, x) for x in range(9) if 2 * sum(x in k for k in own) > len(own)}
            assert most <= got and (held < 1000 or most == {x for x in got if x[0] == host})
