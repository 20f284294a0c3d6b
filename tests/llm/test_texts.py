"""SimHash groups, token files, language, quality and main text against plain Python."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sqlweave.llm import languageid, maintext, quality, rangecoder, simhash, tokenfiles
from sqlweave.llm.components import smallest_reachable
from sqlweave.llm.queries import VOCABULARY

ODD = [None, "", " ", "\n", "one", "One two", "a  b\n\n c ", "ÀÉ 漢字 🙂 é́", "x\x00y", "!" * 50, "w " * 30000, "don't <|endoftext|> stop"]


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_fingerprints_equal_brute_force():
    for text in ODD:
        if text is None or len(text) < 1000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_close_pairs_find_every_pair_within_two_bits(spark):
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(6):
            q = p
            for _ in range(rng.randrange(4)):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
            p = q if rng.random() < 0.3 else p
    signed = lambda p: p - (p >> 63 << 64)
    got = simhash.close_pairs(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    want = {(signed(a), signed(b)) for a in prints for b in prints if signed(a) < signed(b) and (a ^ b).bit_count() <= 2}
    assert Counter((r["u"], r["v"]) for r in got) == Counter(want)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i + 1, i) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | {7: 7, 8: 7, 9: 7}


def near_documents():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:6])]
    rows += [(200 + i, t + " tail") for i, t in enumerate(base)] + [(300 + i, t) for i, t in enumerate(ODD)]
    return [*rows, (None, base[0]), (None, "nameless only"), (3, base[3]), (3, base[4]), (3, base[3])]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_documents()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    prints = {r: plain_fingerprint(r[1]) for r in set(rows)}
    roots = plain_components(set(prints.values()))
    least = {}
    for (doc_id, _), p in prints.items():
        if doc_id is not None:
            least[roots[p]] = min(doc_id, least.get(roots[p], doc_id))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((r[0], f"{prints[r]:016x}", least.get(roots[prints[r]])) for r in rows)
    kept = simhash.keep_first(docs).collect()
    assert len(kept) == len(set(roots.values()))
    assert {roots[prints[(r["doc_id"], r["text"])]] for r in kept} == set(roots.values())
    for r in kept:
        assert r["doc_id"] == least.get(roots[prints[(r["doc_id"], r["text"])]])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0


def test_pipeline_links_near_copies_by_similarity(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, near, far = [], [], []
    for i in range(60):
        base = fresh(300)
        rows.append((i, " ".join(base)))
        tail = fresh(rng.choice([5, 20, 40, 150, 300]))
        rows.append((1000 + i, " ".join(base + tail)))
        (near if len(tail) < 60 else far).append(1000 + i)
    # One shingle makes over half of all, the rest differs.
    rows += [(2000 + i, " ".join(["row"] * 400 + fresh(100))) for i in range(5)] + [(3000, None), (3001, " "), (3002, "a b"), (3003, "A  b")]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(kept & set(near)) <= 0.05 * len(near) and set(far) <= kept
    assert set(range(2000, 2005)) <= kept and kept & set(range(3000, 3004)) == {3000, 3002}


@pytest.mark.parametrize("n", [0, 1, 7, 4095, 4096, 9000])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.2, n) % 50257
    blocks = rangecoder.encode(ids, 50257)
    assert (rangecoder.decode(rangecoder.split(b"".join(blocks))) == ids).all()
    assert len(blocks) == -(-n // rangecoder.BLOCK_IDS)


def test_range_coder_extremes_and_single_blocks():
    ids = np.array([50256, 0] * 3000 + list(range(3000)) + [1, 2, 3] * 1000)
    blocks = rangecoder.encode(ids, 50257, block_ids=1000)
    assert (rangecoder.decode(blocks) == ids).all()
    assert (rangecoder.decode([blocks[5], blocks[0]]) == np.concatenate([ids[5000:6000], ids[:1000]])).all()
    assert sum(map(len, rangecoder.encode(np.array([1, 2, 3] * 4000), 50257))) < 1000


def test_range_coder_finds_damage():
    (block,) = rangecoder.encode(np.arange(500), 50257)
    with pytest.raises(ValueError):
        rangecoder.decode([block[:60] + bytes([block[60] ^ 8]) + block[61:]])
    for broken in (block[:-1], block[2:], b"x" + block):
        with pytest.raises(ValueError):
            rangecoder.split(broken)


def test_stored_words_give_the_ids_of_whole_texts():
    plain = Tokenizer.from_file(VOCABULARY)
    words = tokenfiles.Encoder(VOCABULARY)
    rng = random.Random(9)
    marks = [" ", "  ", "\n", "\t", " \n", "a", "b", "don", "'s", "'", "é", "́", "漢", "\xa0", "\x1c", "\x85", " ", "1", "23", "!", "<|endoftext|>", "🙂", "Ⅻ", "\x00"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text, code in zip(texts, words.encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_equal_plain_encoding(spark, tmp_path):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(None, "last"), (2, "b"), (2, "a"), (2, "a")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(5)
    got = sorted(tokenfiles.tokenise(docs, VOCABULARY, str(tmp_path / "files")).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(VOCABULARY)
    seen, at, order = [], 0, []
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        order.append((r["doc_id"] is None, r["doc_id"] or 0))
        seen.append((r["doc_id"], r["n_tokens"], r["ids_crc32"]))
    assert order == sorted(order)
    want = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows]
    assert Counter(seen) == Counter((d, len(ids), crc32(np.array(ids, "<u4").tobytes())) for d, ids in want)
    assert tokenfiles.tokenise(docs.limit(0), VOCABULARY).count() == 0


def test_language_filters(spark):
    rng = random.Random(1)
    stems = {"xx": "ka lo mi tu re".split(), "yy": "ska blü prö glä".split(), "zz": "кот дом лес река".split()}
    rows = [(i, " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(30)), lang) for i, lang in enumerate([*stems] * 40)]
    known = spark.createDataFrame([*rows, (900, None, "xx"), (901, "lo lo", None), (902, "", "yy")], "doc_id long, text string, lang string")
    filters = languageid.train(known)
    assert filters.languages == ["xx", "yy", "zz"]
    for lang in stems:
        text = " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(8))
        best, score = filters.predict(text)
        assert best == lang and 0.5 < score <= 1
    for text in (None, "", "123 !? _", "\x00"):
        assert filters.predict(text) == ("und", 0.0)
    assert filters.predict("KALO" * 20000)[0] == "xx"
    judged = languageid.identify(known.withColumn("score", F.lit("old")), filters)
    assert judged.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and judged.count() == known.count()
    assert languageid.identify(known.limit(0), filters).count() == 0
    nothing = languageid.train(known.limit(0))
    assert nothing.predict("some text") == ("und", 0.0)


def test_false_positive_correction():
    """A filter that holds every slot says nothing: its language never wins."""
    settings = languageid.Settings(slot_bits=8, hashes=2)
    slices = np.full((1, 256), 1, np.uint64)
    for s in settings.slots(languageid.ngrams("hello there")):
        slices[0, s] |= np.uint64(2)
    filters = languageid.Filters(settings, ["full", "some"], slices, np.array([1.0, 0.05]))
    assert filters.predict("hello there") == ("some", 1.0)


@pytest.mark.parametrize("text", ["½", "² ①", "Ⅷ 12 _ !", "٣٤", "\u0301", "", None])
def test_a_text_without_letters_has_no_language(spark, text):
    rows = [(1, "some plain words", "en"), (1, "some plain words", "en"), (2, "einige andere worte", "de")]
    filters = languageid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languageid.Settings(min_count=1))
    assert filters.predict(text) == ("und", 0.0)
    assert filters.predict("½ some plain words ②")[0] == "en"


def test_quality_samples_without_moving_other_texts(spark):
    rows = [(i, f"text {i}", i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[5][:2], (None, "x"), (700, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:200]] + [(3, 0), (7, None), (None, 1)], "doc_id long, quality int")
    sample = quality.sample_labelled(docs, labels, quality.Settings(sample_docs=50))
    got = sample.collect()
    assert {(r["doc_id"], r["text"], r["quality"]) for r in got} <= set(rows[:200]) and len({r["doc_id"] for r in got}) == 50
    every = {r["doc_id"] for r in quality.sample_labelled(docs, labels).collect()}
    assert every == set(range(200))


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(0x4E00 + 50 * i)}{chr(0x4E01 + 50 * i)}{chr(0x4E02 + 50 * i)} " * 5, f"l{i:02}") for i in range(70)]
    filters = languageid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [filters.predict(t)[0] for _, t, _ in rows] == [lang for _, _, lang in rows]


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "river", "runs", "past", "old", "mills"]) for _ in range(40)) for _ in range(80)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "now", "|", "click"]) for _ in range(40)) for _ in range(80)]
    rows = [(i, t, 1 if t in good else 0) for i, t in enumerate(good + bad)] + [(999, "the river", None), (998, None, 1), (997, "", 0)]
    known = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    weights = quality.train(known)
    assert (weights == quality.train(known.repartition(7))).all()
    asked = spark.createDataFrame(
        [(1, "the old river runs", "s"), (2, "click now $$$ BUY!!", "s"), (3, None, "s"), (4, "", "s"), (5, "old " * 40000, "s")],
        "doc_id long, text string, score string",
    )
    got = {r["doc_id"]: r for r in quality.score_quality(asked, weights).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[3]["score"] == got[4]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert quality.score_quality(asked.limit(0), weights).count() == 0
    blank = quality.train(known.limit(0))
    assert {r["score"] for r in quality.score_quality(asked, blank).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad box">Buy</div>
<div class="cookie-notice">We use cookies</div><aside>side</aside><div role=banner>b</div>
<article class=post><header><h1>A &amp; B</h1></header><p>One <b>two<br>three</b>&nbsp;four<p>Five  &lt;six&gt; 1 < 2
<div>seven<span> eight</span></div><ul><li>nine<li>ten</ul><form>f<input></form><table><tr><td>c1<td>c2</table>
<section id="comments"><article class="comment"><p>nice</p></article></section></article>
<div class="related">more</div><footer>&copy; x</footer></body></html>"""


def test_main_text_keeps_the_article_only():
    assert maintext.main_text(PAGE) == "A & B\nOne two three four\nFive <six> 1 < 2\nseven eight\nnine\nten\nc1\nc2"
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<article></article>") == ""
    assert maintext.main_text("just &lt;text&gt; <b>here") == "just <text> here"
    assert maintext.main_text("<div>a<div>b</div>c</div><script>never closed") == "a\nb\nc"
    assert maintext.main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    assert maintext.main_text("</p></div>x<p>y</article>") == "x\ny"


def test_recurring_subtrees_go_but_article_paragraphs_stay(spark):
    def page(i):
        return f"<div class=box><p>Our   shop is open</p></div><article><p>own {i}</p><p>said by all</p><div>read more here</div></article><div><p>end {i}</p></div>"

    rows = [(i, f"http://h.org/{i}", page(i), "t") for i in range(12)] + [(50 + i, "http://other.org/", page(0), "t") for i in range(15)]
    rows += [(99, None, None, "t"), (98, "x", "<p>alone</p>", None), (0, "http://h.org/0", page(0), "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = maintext.extract_pages(pages, min_pages=10).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert by_id[3] == "own 3\nsaid by all" and by_id[50] == "own 0\nsaid by all\nread more here"
    assert by_id[99] == "" and by_id[98] == "alone"
    assert maintext.extract_pages(pages.limit(0)).count() == 0


def test_templates_without_article(spark):
    rows = [(i, "http://h.org", f"<div><p>menu of the site</p></div><p>text {i}</p>") for i in range(10)]
    got = maintext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=10).collect()
    assert {r["text"] for r in got} == {f"text {i}" for i in range(10)}


@pytest.mark.parametrize("page", [
    "<article class='post no-sidebar'><p>body</p></article>", "<article class='post comments-open share'><p>body</p></article>",
    "<main class='has-sidebar'><p>body</p></main>", "<div class='content-sidebar-wrap'><article><p>body</p></article></div>",
    "<div id=widget><div><main>body</main></div></div>", "<div class='content-sidebar-wrap'><p>body</p></div>",
    "<article><div class='no-sidebar'>body</div><div class='share-widget'>x</div><p class='ad ad-1'>x</p></article>",
])
def test_names_never_drop_main_elements(page):
    assert maintext.main_text(page) == "body"


@pytest.mark.parametrize("page,text", [
    ('<body><form id="aspnetForm"><div><article><p>Kept</p><input></article></div></form></body>', "Kept"),
    ("<noscript><img src=x><article><p>Kept</p></article>", "Kept"),
    ("<article hidden>Kept</article><div role=dialog><article>too</article></div>", "Kept\ntoo"),
    ("<main><h1>Title</h1><p>Long main text</p></main><section><article><p>Teaser</p></article></section>", "Title\nLong main text"),
    ("<main><h1>Title</h1><p>Lead</p><article><p>Body of some length</p></article><p>after</p></main>", "Title\nLead\nBody of some length"),
    ("<main></main><article><p>one</p></article><article>two</article>", "one\ntwo"),
    ('<div id="form"><p>Body text</p></div>', "Body text"),
    ("<div class=comments><p>a comment longer than the page</p></div><p>text</p>", "text"),
    ('<article>A <span class="share">kept</span> b <span class=ad>x</span></article>', "A kept b"),
    ("<aside><article>teaser</article></aside><p>text</p>", "text"),
])
def test_wrappers_never_take_the_text_with_them(page, text):
    assert maintext.main_text(page) == text


def test_long_recurring_blocks_of_articles_go(spark):
    notice = "<p>Subscribe now to read all that our editors write</p>"
    rows = [(i, f"http://h.org/{i}", f"<article><h2>Summary</h2><p>{'own words ' * 9}{i}</p>{notice}<ul><li>yes</li></ul></article>") for i in range(12)]
    rows += rows[:2]
    got = maintext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=10).collect()
    assert len(got) == 14 and {r["text"] for r in got} == {f"Summary\n{'own words ' * 9}{i}\nyes" for i in range(12)}


def test_header_names_in_an_article_stay():
    page = "<div class=header>site</div><article><div class='article-header'><h1>Title</h1></div><div class=header>by me</div><p>body</p></article>"
    assert maintext.main_text(page) == "Title\nby me\nbody"
    assert maintext.main_text("<div class=header>site</div><p>body</p>") == "body"


def test_copies_with_other_adverts_make_no_template(spark):
    whole = "<article><div><p>a long first paragraph</p><p>and a second one</p></div><section>third part of it</section></article>"
    bare = "<div><p>a long first paragraph</p></div><div><p>and a second, longer one</p></div><div><p>then the third of them</p></div><div><p>and the fourth and last</p></div>"
    for body in (whole, bare):
        rows = [(i, "http://h.org", f"<div><p>ad {i}</p></div>{body}") for i in range(12)]
        got = maintext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=10).collect()
        assert all("a long first paragraph" in r["text"] and r["text"].count("\n") >= 2 for r in got)


def test_templates_of_a_section_of_a_large_host(spark):
    notice = "<div><p>notice of this section</p></div>"
    rows = [(i, f"http://h.org/{i}", f"{notice if i < 12 else ''}<p>text {i}</p>") for i in range(100)]
    got = maintext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=10).collect()
    assert {r["text"] for r in got} == {f"text {i}" for i in range(100)}
