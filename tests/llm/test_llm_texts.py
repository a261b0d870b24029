"""Quality rules, language ID, lines and pages against brute force and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repeatwise.llm import html, langid, lines, quality
from repeatwise.llm.work import documents, held_out

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_quality(text, least=8):
    """Each count by comparing all pairs of places."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    marked = lambda size: {p for i in range(n) if best[i] >= size for p in range(i, i + best[i])}
    windows = Counter(tuple(words[i:i + 8]) for i in range(n - 7))
    repeated = {p for i in range(n - 7) if windows[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    size = [len(w.encode()) for w in words]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": n, "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup,
        "n_repeat_words": len(repeated),
        "covered": sum(size[p] for p in marked(least)) / max(1, sum(size)),
        "longest_words": max([b for b in best if b >= least], default=0),
        "base_failed": n < 20 or 100 * len(repeated) > 30 * n}


@pytest.mark.parametrize("least", [3, 8])
def test_quality_equals_brute_force(spark, least):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "é#", "cc\n", "d<"]) for _ in range(r.randint(0, 90))) for _ in range(80)]
    passage = " ".join(f"w{i}" for i in range(12))
    texts += [None, "", " \n", f"{passage} x {passage}\n" + " ".join(f"u{i}" for i in range(80)),
              "same line here\n" * 9, passage + " y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for row in quality.quality_rules(df, min_repeat=least).collect():
        want = plain_quality(row["text"], least)
        got = row["quality"].asDict()
        assert {k: got[k] for k in want} == pytest.approx(want), row["text"]
        assert got["kept"] == (not want["base_failed"] and got["covered"] <= 0.3 and got["longest"] <= 0.25)
        assert sum(b - a for a, b in zip(got["spans"][::2], got["spans"][1::2])) >= got["longest_words"]


def test_repeats_that_only_the_method_sees(spark):
    own = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    phrase = lambda k: " ".join(f"buy now today {own(10 * i, 10 * i + k)}" for i in range(20))
    texts = {
        "stutter": " ".join(f"x{i} " * 6 for i in range(20)),
        "phrase": phrase(2),
        "passage of 5 words, 12 times": " ".join(f"one two three four five {own(9 * i, 9 * i + 3)}" for i in range(12)),
        "clean": own(0, 200), "two words often": " ".join(f"of the {own(9 * i, 9 * i + 3)}" for i in range(20)),
        "phrase now and then": phrase(10), "a line said twice": f"{own(0, 7)}\n{own(10, 90)}\n{own(0, 7)}"}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r["name"]: r["quality"] for r in quality.quality_rules(df).collect()}
    assert not any(q["base_failed"] for q in got.values())
    assert {n for n, q in got.items() if not q["kept"]} == {"stutter", "phrase", "passage of 5 words, 12 times"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4))
def test_suffix_repeats(texts):
    bounds = np.cumsum([0, *map(len, texts)])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = np.array([10 * k + w for k, t in enumerate(texts) for w in t], np.int64)
    got = quality.suffix_repeats(words, bounds[1:][owner])
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and owner[i] == owner[j] and max(i, j) + k < bounds[owner[i] + 1] \
                    and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        assert got[i] == best


def test_quality_of_awkward_rows(awkward, nothing):
    out = quality.quality_rules(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()  # its column is replaced
    failed = {r["text"] for r in out.where("quality.base_failed").collect()}
    assert {None, "", "word", "\n".join(["same line"] * 50)} <= failed
    assert quality.quality_rules(nothing).count() == 0


def brute_probability(word, pieces, p):
    """Sum over all segmentations, one by one."""
    text, total = "▁" + word, 0.0
    for cut in range(1 << (len(text) - 1)):
        parts, start = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or cut >> (i - 1) & 1:
                parts.append(text[start:i])
                start = i
        value = 1.0
        for part in parts:
            value *= p[pieces.index(part)] if part in pieces else p[len(pieces)] if len(part) == 1 else 0
        total += value
    return total


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba"])
    p = np.random.default_rng(1).random((len(pieces) + 2, 1))
    p[-1] = 0
    lattice = langid.Lattice(pieces)
    for words in (["aba", "bab", "axb"], ["a"], ["abaab", "zzzzz"]):
        sums = lattice.forward(lattice.places(words), p)[-1][:, 0]
        assert sums == pytest.approx([brute_probability(w, pieces, p[:, 0]) for w in words])


def test_expected_uses_add_up_to_the_text():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba"])
    p = np.random.default_rng(2).random((len(pieces) + 2, 1))
    p[-1] = 0
    lattice = langid.Lattice(pieces)
    used = lattice.expected(lattice.places(["abab", "baba"]), p, np.array([2.0, 1.0]))
    sizes = np.array([*map(len, pieces), 1, 0])
    assert (used * sizes).sum() == pytest.approx(3 * 5)


def test_language_on_held_out_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, PIECES, allowed=~held_out(F.col("doc_id")))
    out = langid.predict(docs, model).where(held_out(F.col("doc_id"))).select("lang", "language.*", F.col("language.lang").alias("p"))
    rows = out.toDF("lang", "l", "score", "p").collect()
    assert sum(r["lang"] == r["p"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark, awkward, nothing):
    model = langid.fit(awkward, PIECES)
    assert model.langs == ["de", "fr"]
    out = langid.predict(awkward, model, into="quality")
    assert out.columns == awkward.columns and out.count() == awkward.count()
    for r in out.collect():
        if not any(map(str.isalpha, r["text"] or "")):
            assert tuple(r["quality"]) == ("und", 0.0)
        else:
            assert r["quality"]["lang"] in model.langs and 0.5 <= r["quality"]["score"] <= 1
    none = langid.fit(nothing, PIECES)
    assert none.langs == []
    assert {r[0] for r in langid.predict(awkward, none).select("language.lang").collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_language_sample_is_bounded(spark):
    rows = [(i, "ab cd", "x") for i in range(50)] + [(7, "ab cd", "x")] * 100 + [(None, "q", "x")] * 40
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert langid.sample(df, "text", "lang", "doc_id", None, 10).count() == 10


def test_language_sample_is_the_least_of_each_language(spark):
    rows = [(i, f"t{i}", "x") for i in range(3000)] + [(i, f"u{i}", "y") for i in range(7)]
    # Copies of some ids make a language look larger than it is.
    rows += [(i % 40, f"v{i % 40}", "z") for i in range(4000)] + [(i, "n", None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    hashed = df.select("lang", F.xxhash64("doc_id").alias("h"), "text").where("lang IS NOT NULL").distinct().collect()
    want = []
    for lang in "xyz":
        want += sorted((r["h"], r["lang"], r["text"]) for r in hashed if r["lang"] == lang)[:30]
    got = langid.sample(df, "text", "lang", "doc_id", None, 30).collect()
    assert sorted(map(tuple, got)) == sorted(w[1:] for w in want)
    assert langid.sample(df.where("false"), "text", "lang", "doc_id", None, 30).count() == 0


def plain_lines(rows, ratio, least):
    pages = Counter(s for _, _, s in rows)
    seen = Counter((s, x) for _, t, s in rows for x in {y.strip(" ") for y in (t or "").split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return sorted((i, s, None if t is None else
                   "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone)) for i, t, s in rows)


def test_lines_equal_brute_force(spark):
    r = random.Random(5)
    some = ["menu", " menu ", "", "a", "b", "c d", "long line of text", "é"]
    rows = [(i, "\n".join(r.choice(some) + (str(i) if r.random() < .5 else "") for _ in range(r.randint(0, 9))),
             r.choice(["s0", "s0", "s1", ""])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(5)
    got = lines.drop_boilerplate(df, ratio=0.15, min_pages=5)
    assert sorted(map(tuple, got.select("doc_id", "source", "text").collect())) == plain_lines(rows, 0.15, 5)


def test_lines_of_awkward_rows(awkward, nothing):
    out = lines.drop_boilerplate(awkward, n_lines="n", n_dropped="gone")
    assert out.columns == [*awkward.columns, "n", "gone"] and out.count() == awkward.count()
    assert out.where("text IS NULL").count() == awkward.where("text IS NULL").count()
    assert out.where("text IS NULL AND n = 0 AND gone = 0").count() == awkward.where("text IS NULL").count()
    assert lines.drop_boilerplate(nothing).count() == 0


def test_null_hosts_are_one_host(spark):
    rows = [(i, f"menu\nline {i}", None) for i in range(20)] + [(99, "menu", "other")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df).collect()}
    assert got[3] == "line 3" and got[99] == "menu"


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="</p>no";</script></head>
<body><header><nav><a href="/">no menu</a></nav></header><div class="ad">no advert {filler}</div>{open}
<h1>Head &amp; line</h1><p>First   paragraph, <b>bold</b>\n and <a href="x">a link</a> {filler}<p>Short.
<p>Last &lt;one&gt;&nbsp;here. {filler}</p>{close}<!-- no --><div id="comments"><p>no comment {filler}</p></div>
<form><input value="no"><p>no form {filler}</p></form><aside>no aside {filler}</aside><footer>no &copy; foot</footer>"""


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<div id='story'>", "</div>"), ("<main>", "")])
def test_main_text(open_, close):
    filler = "and so on " * 30
    text = html.main_text(PAGE.format(filler=filler, open=open_, close=close))
    filler = filler.strip()
    assert text == (f"Head & line\nFirst paragraph, bold and a link {filler}\nShort.\nLast <one> here. {filler}")


def test_main_text_of_awkward_pages(spark):
    pages = [None, "", "   ", "<p>", "<script>x", "<!-- open", "plain text", "<p>a<p>b", "<nav>only menu</nav>",
             "<article>" + "<p>long</p>" * 20000 + "</article>", "<a <b>x", "&amp &am", "</div></p>x"]
    df = spark.createDataFrame([(i, p, "u") for i, p in enumerate(pages)], "page_id int, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extracted(df).collect()}
    assert got[0] == got[1] == got[2] == got[3] == got[4] == got[5] == got[8] == ""
    assert got[6] == "plain text" and got[7] == "a\nb" and got[9].count("\n") == 19999
    assert got[11] == "& &am" and got[12] == "x"
    assert html.extracted(df.limit(0)).count() == 0


def test_articles_of_the_given_pages(spark, sf_dir):
    import html as references

    for r in html.extracted(documents(spark, sf_dir, "pages")).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S).group(1)
        inner = re.sub(r"<[^>]+>", "", re.sub(r"<(/?p|/?h1|br)\b[^>]*>", "\n", inner))
        want = [" ".join(references.unescape(x).split()) for x in inner.split("\n")]
        assert r["text"] == "\n".join(x for x in want if x)
