import collections
import html
import re

import pytest
from pyspark.sql import functions as F

from stereoscope.llm import html_blocks, quality_qda, quality_rules, text_stats, toxicity
from stereoscope.llm.html_blocks import main_text

from .conftest import ODD, SF


def brute_statistics(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(covered),
            "n_distinct": len(set(ws)), "n_chars": len(t), "n_pipes": t.count("|"), "n_bang": t.count("!")}


REPEATS = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e x f a b c d e", "1 2 3 4 5", "1 2 3 4", "x\n\nx\n x\nx\ty\nx", "# <a> | & x\x0bx\x0cy", "q w e r t y " * 400]


def test_statistics_match_brute_force(spark, small, odd, none):
    rows = small[1] + [(r[0], r[1]) for r in ODD] + [(1000 + i, t) for i, t in enumerate(REPEATS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = text_stats.base_statistics(df).collect()
    want = collections.Counter((i, *sorted(brute_statistics(t).items())) for i, t in rows)
    names = sorted(brute_statistics(""))
    assert collections.Counter((r["doc_id"], *((n, r[n]) for n in names)) for r in got) == want
    assert text_stats.base_statistics(none).count() == 0


def test_rules_on_the_tables(spark, small, labels, odd, none):
    out = quality_rules.judged(small[0], labels).collect()
    assert len(out) == len(small[1])
    for r in out:
        want = brute_statistics(dict(small[1])[r["doc_id"]])
        assert all(r[k] == want[k] for k in quality_rules.BASE)
        assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    assert quality_rules.judged(odd, labels).count() == len(ODD)
    assert quality_rules.judged(none, labels).count() == 0
    assert quality_rules.judged(odd, labels.limit(0)).filter("rule != 0").count() == 0


def test_rules_find_planted_conditions(spark):
    """Low quality is planted as two conjunctions; the list finds both and nothing else."""
    import random
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((i, a, b, c, int(not (a > 0.8 and b > 0.5) and not c < 0.1), i % 3 != 0))
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, c double, y int, grow boolean")
    rules = quality_rules.learn(df, ["a", "b", "c"])
    got = df.select("y", quality_rules.verdict(rules).alias("rule")).collect()
    assert sum((r["rule"] == 0) == (r["y"] == 1) for r in got) > 0.97 * len(got)
    assert 2 <= len(rules) <= 8
    assert quality_rules.learn(df.filter("y = 1"), ["a", "b", "c"]) == [] == quality_rules.learn(df.limit(0), ["a", "b", "c"])


SF1 = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF1}/documents.parquet").filter("doc_id < 2500"), spark.read.parquet(f"{SF1}/labels.parquet")


def test_classifier_on_held_out_rows(spark, larger):
    docs, labels = larger
    out = quality_qda.scored(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    rank, good = out.score.rank(), out.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and ((out.predicted == 1) == good).mean() > 0.95


def test_classifier_equals_densities(spark):
    """The emitted expression against the two normal densities."""
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, [1, 2, .5], (300, 3))])
    y = [0] * 200 + [1] * 300
    df = spark.createDataFrame([(*map(float, r), k) for r, k in zip(x, y)], "a double, b double, c double, y int")
    m = quality_qda.fit(df, ["a", "b", "c"])
    got = [r[0] for r in df.select(m.score()).collect()]
    z = (x - m.centre) / m.scale
    dens = {k: -0.5 * (((z - m.mean[k]) @ m.inverse[k].T) ** 2).sum(1) - 0.5 * m.log_det[k] + m.log_prior[k] for k in (0, 1)}
    assert np.allclose(got, 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-9)


def test_classifier_of_odd_rows(spark, odd, none, labels):
    out = quality_qda.scored(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_qda.scored(none, labels).count() == 0
    assert {r["score"] for r in quality_qda.scored(odd, labels.limit(0)).collect()} == {0.0}
    one = labels.withColumn("quality", F.lit(1))
    assert {r["score"] for r in quality_qda.scored(odd, one).collect()} <= {0.0, 1.0}


def test_toxicity_on_held_out_rows(spark, larger):
    docs, labels = larger
    out = toxicity.scored(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert ((out.toxic == 0) & (out.predicted == 1)).sum() <= 2
    en = out[(out.lang == "en") & (out.toxic == 1)]  # recall by language: test_toxicity_recall_by_language
    assert (en.predicted == 1).mean() > 0.85


def test_entries_are_judged_by_their_own_counts(spark):
    """12 of 4,000 toxic documents share a word that no other has: 0.3%, and no chance."""
    rows = spark.range(8000).selectExpr("id as _id", "concat('w', id, ' x', id, ' y', id, if(id < 12, ' zopenco', if(id < 4000, ' idiot', ''))) as _text", "int(id < 4000) as y")
    assert {e.strip()[:4] for e in toxicity.learn_entries(rows)} == {"idio"}  # 2^-12 at a share of a half
    more = rows.unionByName(spark.range(8000, 40000).selectExpr("id as _id", "concat('w', id, ' x', id, ' y', id) as _text", "0 as y"))
    assert {e.strip()[:4] for e in toxicity.learn_entries(more)} == {"zope", "idio"}
    assert toxicity._beyond_chance(10, 0, 0.11) and toxicity._beyond_chance(60, 5, 0.11)
    assert not toxicity._beyond_chance(8, 0, 0.11) and not toxicity._beyond_chance(9, 1, 0.11)


def test_scores_stay_normalised_by_length(spark):
    """Toxic texts are long here and say much, but less by length."""
    rows = [(4.0, 10, 0)] * 40 + [(5.0, 20, 0)] * 40 + [(40.0, 2000, 1)] * 40 + [(60.0, 1000, 1)] * 40 + [(0.0, 30, 0)] * 200
    base, by_weight, by_length = toxicity.calibrate(spark.createDataFrame(rows, "weight double, n_words long, y int"))
    assert by_weight == 0 and by_length > 0


def test_toxicity_recall_by_language(spark):
    """Held-out rows of the whole table. Spanish has the fewest labels; its floor is what 12 rows show."""
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    out = toxicity.scored(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert ((out.toxic == 0) & (out.predicted == 1)).sum() <= 2
    recall = (out[out.toxic == 1].groupby("lang").predicted.mean()).to_dict()
    assert set(recall) == {"de", "en", "es", "fr"}
    assert min(recall["de"], recall["en"], recall["fr"]) > 0.85 and recall["es"] > 0.3


def test_toxicity_folds_and_spares(spark, labels):
    assert toxicity.folded_words("1d1оt MОRON!! mоron's d$g $cum «ｉｄｉｏｔ» i​diot") == toxicity.folded_words("idiot moron moron s dsg scum idiot idiot")
    lex = toxicity.Lexicon({" idiot ": 5.0, " moro": 3.0}, [" not idiot "])
    found = lex.automaton()
    weigh = lambda t: sorted(w for w, _ in toxicity.hits(found, toxicity.folded_words(t)).values())
    assert weigh("an idiot, two morons; moro") == [3.0, 3.0, 5.0]
    assert weigh("not idiot but idiot") == [5.0] and weigh("idiotic amoron") == [] == weigh("")


def test_toxicity_of_odd_rows(spark, odd, none, labels, clashing):
    out = toxicity.scored(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(none, labels).count() == 0
    assert {r["score"] for r in toxicity.scored(odd, labels.limit(0)).collect()} == {0.5}
    kept = toxicity.without_toxic(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == len(ODD)


def test_rejected_documents_are_those_that_score_high(spark, odd, larger):
    """The filter, which reads the text inside the kept document, and the scores agree; null texts stay."""
    docs, labels = larger
    docs = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000), allowMissingColumns=True)
    high = {r["doc_id"] for r in toxicity.scored(docs, labels).filter("predicted = 1").collect()}
    out = toxicity.without_toxic(docs, labels)
    assert high and out.columns == docs.columns
    assert out.exceptAll(docs).count() == 0
    assert sorted(r["doc_id"] for r in docs.exceptAll(out).collect()) == sorted(high)


def test_pages_of_the_tables(spark):
    """These pages put the main text into one article of headings and paragraphs."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_blocks.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert texts[r["page_id"]] == "\n".join(b for b in blocks if b)


LONG = "A long paragraph with plenty of text to read, that goes on and on for a while so that it counts; more and more words here."


def test_page_parts_that_are_no_main_text():
    parts = ["<nav>x</nav>", "<header>x</header>", "<footer>x</footer>", "<aside>x</aside>", "<form>x</form>", "<script>var a='</p>x';</script>", "<style>x{}</style>",
             "<div class='ad'>x</div>", "<div id=cookie-notice>x<div>x</div></div>", "<section class='comments'><article><p>x</p></article></section>", "<!-- x <p>x -->",
             "<ul class='main-menu'><li>x</li></ul>", "<div role=navigation>x</div>", "<p hidden>x</p>", "<article class=comment>x</article>", "<p class='sponsored'>x"]
    for p in parts:
        assert main_text(f"<html><body>{p}<article><h1>T &amp; t</h1>{p}<p>a <b>b</b>\n c</p>{p}<p>d&#233;</p>{p}</article>{p}</body></html>") == "T & t\na b c\ndé", p


def test_pages_without_an_article():
    page = f"<body class=no-sidebar><header>Site</header><div id=menu><a>m</a></div><div class=content><h2>Title</h2><p>Short.</p><p>{LONG}</p><p>Next<br>line</p></div><div class=comments><p>{LONG}</p></div><footer>f</footer>"
    assert main_text(page) == f"Title\nShort.\n{LONG}\nNext line"
    assert main_text("<p>only short</p>") == "only short"


def test_articles_that_are_not_the_main_text():
    teaser = "<article><h3>Other</h3><p>Short teaser.</p></article>"
    assert main_text(f"<main><h1>T</h1><p>{LONG}</p></main><aside>{teaser}</aside>") == f"T\n{LONG}"
    assert main_text(f"<main><h1>T</h1><p>{LONG}</p></main><div>{teaser}</div>") == f"T\n{LONG}"
    assert main_text(f"<div class=post><p>{LONG}</p></div><section class=comments>{teaser}</section>") == LONG
    assert LONG in main_text(f"<div class=post><p>{LONG}</p></div><div>{teaser}{teaser}</div>")
    assert main_text(f"<div class=post><p>{LONG}</p></div><main></main><article></article>") == LONG
    assert main_text(f"<main>x<article><p>{LONG}</p></article><article>b</article></main>") == f"{LONG}\nb"


def test_names_that_only_mention_other_parts():
    for mark in ("class='content no-sidebar'", "class='post has-comments'", "class='post comments-open'", "class='share-enabled'", "class='post share-price'", "id=withSidebar",
                 "class='overflow-hidden'", "class='main header'", "aria-label='Social security today'"):
        for tag in ("div", "section", "article"):
            assert main_text(f"<body><nav>x</nav><{tag} {mark}><h1>T</h1><p>{LONG}</p></{tag}><footer>f</footer></body>") == f"T\n{LONG}", (tag, mark)
    assert main_text(f"<form id=aspnetForm><p>{LONG}</p><form class=search>x</form></form>").startswith(LONG)
    short, said = f"<p>{LONG[:60]}</p>", LONG[:60]
    for mark in ("comments", "comments-area", "comment-list", "related-posts", "ad-container", "cookie-bar", "sidebarRight", "main-menu"):
        assert main_text(f"<article>{short}<div class='{mark}'>x</div></article><div class='{mark}'><p>{LONG}</p></div>") == said, mark
    assert main_text(f"<h1>T</h1><div class=discussion><p>{LONG}</p></div>") == f"T\n{LONG}"


def test_short_lines_beside_the_text_stay():
    ad, lines = "<div class=ad>x</div>", lambda *ls: "".join(f"<p>{t}</p>" for t in ls)
    want = ["Title", LONG, LONG, "Short close.", "The end."]
    for cut in (ad, ad * 4, "<form>x</form>", "<script>x</script>" + ad):
        for tag in ("div", "body"):
            assert main_text(f"<header>s</header><{tag}><h1>Title</h1>{lines(LONG, LONG)}{cut}{lines('Short close.', 'The end.')}</{tag}><footer>f</footer>").split("\n") == want, cut
    opening = ["Title", "By me.", "One.", "Two.", "Three.", LONG, "End."]
    assert main_text(f"<div>Site</div><nav>x</nav><div><h1>Title</h1>{lines('By me.', 'One.')}{ad}<div>Two.</div>{lines('Three.', LONG)}{ad}<section><p>End.</p></section></div>").split("\n") == opening
    menu = "<p><a>a</a></p>" * 3
    assert main_text(f"<div>{menu}<p>x</p>{menu}{lines('One.', LONG, 'End.')}{menu}<p>Imprint</p></div>").split("\n") == ["One.", LONG, "End."]
    assert main_text(f"<div><p>{LONG}</p></div>{ad}<div><p>Other</p><p>box</p></div>") == LONG


def test_odd_pages(spark):
    for page in ["", " ", "<", "<p", "<!--", "<script>x", "</p>", "<p>" * 5000, "<nav>" * 5000, "<a b='", "&#xD800;&#0;", "<article>", "<article></article>"]:
        main_text(page)
    df = spark.createDataFrame([(1, None, "u", "x"), (2, "", None, "x"), (2, "<p>b</p>", "u", None), (None, "<article><p>é</p>", "u", "x")], "page_id long, html string, url string, _html string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_blocks.extracted(df).collect()) == [(0, "é"), (1, ""), (2, ""), (2, "b")]
    assert html_blocks.extracted(df.limit(0)).count() == 0


PARA = "A long paragraph of the main text, with more than enough words to be a surge by itself, as articles have them. " * 2


@pytest.mark.parametrize("page, want", [
    # an article's own header holds its heading; the page's header does not
    (f"<body><header>Site</header><article><header><h1>Title</h1><p>By A. Writer</p></header><p>{PARA}</p></article></body>", ["Title", "By A. Writer", PARA]),
    (f"<body><header><h1>Site</h1></header><main><header class=entry-header><h1>Title</h1></header><p>{PARA}</p></main></body>", ["Title", PARA]),
    (f"<body><article><header><nav>menu</nav></header><p>{PARA}</p></article></body>", [PARA]),
    # a heading in the article stays, whatever its class says of its looks; one over what others write goes
    (f"<article><h2 class=notice-title>Notice of change</h2><p>{PARA}</p><h2 class=comments-title>Comments</h2></article>", ["Notice of change", PARA]),
    (f"<article><h2 hidden>Gone</h2><p>{PARA}</p></article>", [PARA]),
    # lines of links between and after the text of an unmarked container
    (f"<div><p>{PARA}</p><p><a href=x>The whole report</a></p></div><div><a href=y>elsewhere</a></div>", [PARA, "The whole report"]),
    (f"<div><p>{PARA}</p><ul>" + "".join(f"<li><a href={k}>Item {k}</a>" for k in range(5)) + "</ul><p>That is all.</p></div>", [PARA, *[f"Item {k}" for k in range(5)], "That is all."]),
    (f"<div><p>{PARA}</p><ul class=menu>" + "".join(f"<li><a href={k}>Item {k}</a>" for k in range(5)) + "</ul><p>That is all.</p></div>", [PARA, "That is all."]),
    (f"<div><p>{PARA}</p><ul>" + "".join(f"<li><a href={k}>Item {k}</a>" for k in range(5)) + "</ul></div>", [PARA]),
    # lines that lie on the page itself: a row of links ends them
    (f"<body><p>{PARA}</p><ul>" + "".join(f"<li><a href={k}>Item {k}</a>" for k in range(5)) + "</ul><p>Copyright</p></body>", [PARA]),
])
def test_headings_and_links_that_belong_to_the_text(page, want):
    assert main_text(page) == "\n".join(w.strip() for w in want)
