"""Nothing that belongs to a result is cut: long and short blocks, wrappers, unclosed elements."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from repeatwise.llm import html, langid, neardup
from test_llm_groups import near_copies, plain_groups

SHORTS = [f"Line {i}." for i in range(200)]
BLOCK = "and so on " * 600


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")])
def test_a_very_long_block_cuts_no_short_ones(open_, close):
    shorts = "".join(f"<p>{x}</p>" for x in SHORTS)
    for inner, want in ((f"<p>{BLOCK}</p>{shorts}", [BLOCK.strip(), *SHORTS]),
                        (f"{shorts}<p>{BLOCK}</p>", [*SHORTS, BLOCK.strip()]),
                        (f"{shorts}<p>{BLOCK}</p>{shorts}", [*SHORTS, BLOCK.strip(), *SHORTS])):
        page = f"<html><body><nav>menu</nav>{open_}{inner}{close}<footer>foot</footer></body></html>"
        assert html.main_text(page).split("\n") == want


STORY = "<h1>Head</h1><p>The first paragraph of the story, of ordinary length.</p><p>Short.</p>"
TOLD = "Head\nThe first paragraph of the story, of ordinary length.\nShort."


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'data-hidden="false"', 'title="the hidden truth"', "data-role='banner'", "x-id=ad",
    'aria-hidden="false"', 'class="has-sidebar"', 'class="no-sidebar wide"', 'class="with-comments"',
    'id="page-header-fixed"', "class='legal-analysis'", "class=share-price"])
def test_wrappers_that_only_look_like_boilerplate(attributes):
    assert html.main_text(f"<body><nav>menu</nav><div {attributes}>{STORY}</div></body>") == TOLD
    assert html.main_text(f"<body><div {attributes}><main>{STORY}</main></div></body>") == TOLD


@pytest.mark.parametrize("open_,close", [
    ('<div class="sidebar">', "</div>"), ('<div id="overlay"><section class="social">', "</section></div>"),
    ("<form id=f>", "</form>")])
def test_marked_elements_in_wrappers_with_a_name(open_, close):
    for tag in ("article", "main"):
        assert html.main_text(f"{open_}<p>no</p><{tag}>{STORY}</{tag}>{close}") == TOLD


@pytest.mark.parametrize("open_,close", [
    ("<div hidden>", "</div>"), ('<div aria-hidden = "true">', "</div>"), ("<div class=ad>", "</div>"),
    ('<div class="wide site-footer">', "</div>"), ('<div class="ad-300x250">', "</div>"), ("<div id='comment-17'>", "</div>"),
    ('<div role="navigation">', "</div>"), ("<nav><article>", "</article></nav>"),
    ('<div class="comments"><article class="comment">', "</article></div>"),
    ('<article><div class="related"><article>', "</article></div></article>")])
def test_boilerplate_stays_out(open_, close):
    assert html.main_text(f"<article>{STORY}</article>{open_}<p>{'no text ' * 60}</p>{close}") == TOLD


@pytest.mark.parametrize("name", [
    "comments-section", "user-comments", "reader-comments", "post-comments", "comment-thread", "disqus_thread",
    "related-posts", "ad-slot", "google-ad", "cookie-bar", "left-sidebar", "sidebar-left", "newsletter-box",
    "page-footer", "social-share-bar", "article-footer", "breadcrumb-trail"])
def test_names_with_a_telling_part(name):
    for x in (f'class="{name}"', f'class="x1 {name}"', f'id="{name}"'):
        assert html.main_text(f"<article>{STORY}</article><div {x}><p>{'no text ' * 60}</p></div>") == TOLD
        assert html.main_text(f"<body><div {x}><p>{'no text ' * 60}</p></div><div>{STORY}</div></body>") == TOLD


@pytest.mark.parametrize("name", ["comments-open", "no-ads", "with-sidebar", "not-related", "ad-free-story", "has-footer"])
def test_names_that_deny_it(name):
    assert html.main_text(f"<div class='{name}'>{STORY}</div>") == TOLD


def test_articles_lend_no_weight_to_their_neighbours():
    assert html.main_text(f"<div><a href=x>Home</a></div><div><a href=y>About</a></div><article>{STORY}</article>"
                          "<p>Powered by X</p><p>Call us now</p>") == TOLD
    assert html.main_text(f"<div>Login</div><main>{STORY}</main><div>Top</div><div>12 px</div>") == TOLD
    # A long paragraph that an author forgot to mark is text.
    more = "and it goes on for quite a while " * 20
    assert html.main_text(f"<article>{STORY}</article><p>{more}</p>") == f"{TOLD}\n{more.strip()}"


def test_short_blocks_of_plain_pages_stay():
    long = "a long paragraph of text " * 30
    page = "".join(f"<p>{x}</p>" for x in ("Q1.", "Q2.", "Q3.", "Q4.", long, long, long, "C.", "D.", "E end."))
    want = ["Q1.", "Q2.", "Q3.", "Q4.", *[long.strip()] * 3, "C.", "D.", "E end."]
    assert html.main_text(page).split("\n") == want
    menu = "".join(f"<li><a href=x>Entry {i}</a></li>" for i in range(9))
    assert html.main_text(f"<ul>{menu}</ul>{page}<ul>{menu}</ul>").split("\n") == want
    # One line that is a link stays between text, as it may be a source.
    assert html.main_text("<p>one</p><p><a href=x>two</a></p><p>three</p>") == "one\ntwo\nthree"


def plain_kept(lines):
    """Surge and dive line by line, with every sum written out."""
    links = [x.own == 0 and not x.marked and not x.boilerplate for x in lines]
    good = []
    for i, x in enumerate(lines):
        beside = [links[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        good.append(not x.boilerplate and not (links[i] and any(beside)))
    marked = any(x.marked for x, g in zip(lines, good) if g)
    alone = [g and (x.marked if marked else x.own >= len(x.text) / 2) for x, g in zip(lines, good)]
    largest = 0
    for i in range(len(lines)):
        total = 0
        for j in range(i, min(i + html.WINDOW, len(lines))):
            if good[j]:
                total += min(max(1, lines[j].own), html.LONG) + (html.ANCHOR if alone[j] else 0)
        largest = max(largest, total)

    def reaches(i, step):
        if not good[i]:
            return False
        near = [i + step * k for k in range(html.WINDOW) if 0 <= i + step * k < len(lines)]
        return alone[i] or sum(max(1, lines[j].own) for j in near if good[j] and not alone[j]) >= html.SHARE * largest

    first = [i for i in range(len(lines)) if reaches(i, 1)]
    last = [i for i in range(len(lines)) if reaches(i, -1)]
    return [i for i in range(len(lines)) if good[i] and first and last and first[0] <= i <= last[-1]]


def test_lines_are_kept_as_by_brute_force():
    r = random.Random(3)
    for k in range(4000):
        n = r.randint(0, 14)
        lines = []
        for _ in range(n):
            size = r.choice([1, 5, 40, 300, 2000])
            own = r.choice([0, 0, size, size, size // 2, size // 4])
            lines.append(html.Line("x" * size, own, k % 2 > 0 and r.random() < .3, r.random() < .2))
        assert html.kept_lines(lines) == plain_kept(lines)


@pytest.mark.parametrize("before", [
    "<html><head><title>x</title><body>", "<html><head><meta charset=u><title>x</title><style>p{}</style><p hidden>x</p>",
    "<head><title>x</title><script>var a='<p>';</script><body>", "<title>x</head><body>", "<title>x<body>",
    "<title>How to use a <div> and a <script></title><body>", "<select><option>x<option>x", "<ul><li><button>x<li><button>x</button></ul>",
    "<div><button>x</div>", "<noscript>x", "<object data=x><param name=x>x", "<svg><path d=x><g>x", "<template>x", "<canvas>",
    "<iframe src=x>", "<iframe src=x><p hidden></p><iframe src=y>no</iframe>",
    "<button><div><p>x</p></div></button>", "<noscript><div><button>x</div></noscript>", "<object><object><p>x</p></object>x</object>"])
def test_elements_without_an_end_tag(before):
    assert html.main_text(f"{before}<article>{STORY}</article>") == TOLD
    assert html.main_text(f"{before}<div>{STORY}</div></body>") == TOLD
    assert html.main_text(f"<article>{STORY}{before}</article>") == TOLD


def test_dropped_elements_inside_a_line():
    assert html.main_text("<p>one <b><button>x</b> two <svg><title>x</title><path/></svg>three <select><option>x</select> four") \
        == "one two three four"
    assert html.main_text("<p>one <my-card><button>x <i>x</i> x</my-card> two") == "one\ntwo"
    assert html.main_text("<p>one</p>" + "<button>x" * 3000 + "<p>two</p>" + "</div>" * 3000) == "one\ntwo"


def test_pipeline_joins_documents_from_80_per_cent_on(spark):
    rows = [(i, t, "en", "s") for i, t in near_copies(n_groups=20, seed=6)]
    # Two groups of five-word sets that share 80 and 82 of every 100 shingles, and one that shares 79.
    for g, both in enumerate((160, 164, 158)):
        words = [f"g{g}w{i}" for i in range(204)]
        side = (200 - both) // 2
        shared = words[:both + 4]
        rows += [(1000 + 2 * g + k, " ".join(shared + [f"g{g}s{k}w{i}" for i in range(side)]), "en", "s") for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    want = plain_groups([r[:2] for r in rows], threshold=80)[1]
    kept = {r["doc_id"] for r in corpus_pipeline.duplicate_stage(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert {1000, 1002, 1004, 1005} <= kept and not {1001, 1003} & kept


def test_language_stage_rejects_gibberish_unlearned_and_mixed_texts(spark):
    r = random.Random(8)
    known = {x: ["".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(300)]
             for x, letters in (("aa", "aeinrst"), ("bb", "oulmdpc"))}
    text = lambda words, n=60: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(known[x]), x) for i in range(100) for x in known]
    rows = [(2 * i + j, *row[1:]) for i in range(100) for j, row in enumerate(rows[2 * i:2 * i + 2])]
    gibberish = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(6000)]
    rows += [(1000 + i, text(gibberish), None) for i in range(30)]
    rows += [(2000 + i, "все люди рождаются свободными и равными в своем достоинстве и правах " * 4, None) for i in range(5)]
    rows += [(3000 + i, text(known["aa"], 50) + " " + text(known["bb"], 50), None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {x["doc_id"] for x in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert kept == set(range(200))


@pytest.mark.parametrize("threshold", [60, 80, 85])
def test_sketches_of_pairs_at_the_threshold_agree(threshold):
    r = np.random.default_rng(threshold)
    same = r.binomial(neardup.SIGNATURE, threshold / 100, 200_000) / neardup.SIGNATURE
    sketch = lambda n: bytes(n) + b"\1" * (neardup.SIGNATURE - n)
    pairs = [pa.array([1]), pa.array([2])]
    least = min(n for n in range(1, 65) if sum(b.num_rows for b in neardup._agree(threshold)(iter([
        pa.RecordBatch.from_arrays([*pairs, pa.array([sketch(64)]), pa.array([sketch(n)])], list("abxy"))]))))
    assert (same * 64 < least).mean() < 2e-4
    assert neardup.branching_of(85) == pytest.approx(0.7) and neardup.branching_of(threshold) < threshold / 100


def test_words_are_split_where_there_is_no_letter():
    assert langid.words_of("x² m²") == ["x", "m"] and langid.words_of("a½bc d") == ["a", "bc", "d"]
    assert langid.words_of("² ½ 12") == []
