"""Nearest neighbours and the whole pipeline against brute force, and the registered queries."""

import ast
import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sqlweave.llm import decontaminate, languageid, linespread, maintext, mixture, multiindex, quality, simhash, tokenfiles, urlrules
from sqlweave.llm.queries import QUERIES, VOCABULARY
from sqlweave.session import load

SF = "/root/testdata/sf0.001"


def nearest(rows, k, every):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[i] = min(v, sound.get(i, v))
    usual = Counter(map(len, sound.values())).most_common(1)[0][0]
    sound = {i: np.array(v, float) for i, v in sound.items() if len(v) == usual}
    out = set()
    for q in sound:
        if q % every == 0:
            near = sorted((float(np.sqrt(((sound[i] - sound[q]) ** 2).sum())), i) for i in sound if i != q)[:k]
            out |= {(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(near, 1)}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}


def test_all_candidates_ties_and_unfit_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, float(i % 2)]) for i in range(12)]
    rows += [(100, None), (200, [0.0, 0.0, 0.0]), (300, [1.0, nan, 0.0]), (400, [inf, 1.0, 1.0]), (500, [1.0, None, 2.0]), (600, []), (None, [1.0, 1.0, 1.0]), (700, [1.0]), (3, [0.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    for k in (3, 10, 50):
        assert found(multiindex.search(table, k, every=2)) == nearest(rows, k, 2)
    assert multiindex.search(table.limit(0)).count() == 0
    assert multiindex.search(table.filter("vec_id = 200")).count() == 0


def test_every_length_is_searched(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(6)]
    got = multiindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, every=100)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == {(0, 1, 1), (0, 2, 2), (100, 1, 101), (100, 2, 102)}


def test_one_repeated_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = multiindex.Settings(block_rows=64)
    assert found(multiindex.search(table, 5, 10, small)) == nearest(rows, 5, 10)


@pytest.mark.parametrize("structured", [True, False])
def test_recall(spark, structured):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    if structured:
        x = x[rng.integers(0, 40, 3000)] * 3 + rng.normal(size=(3000, 16)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(multiindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 50))
    want = nearest(rows, 10, 50)
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)


def test_walks_hold_a_vector_once_a_bin(spark, monkeypatch):
    """Walks over vectors without structure come to most cells; those share bins, and a large cell has several."""
    rng = np.random.default_rng(6)
    x = [*rng.normal(size=(2000, 8)), *[np.full(8, 9.0)] * 600]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    written = []
    keep = multiindex.materialise
    monkeypatch.setattr(multiindex, "materialise", lambda df: written.append(keep(df)) or written[-1])
    settings = multiindex.Settings(cell_rows=5, block_rows=200)
    got = found(multiindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 10, settings))
    want = nearest(rows, 10, 10)
    assert Counter(q for q, *_ in got) == Counter(q for q, *_ in want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    asked = [df.count() for df in written if "q" in df.columns]
    # 260 queries, and bins of which any two that follow each other hold more than 200 of 2,600 rows.
    assert len(asked) == 2 and max(asked) <= 260 * 27


def test_floats_are_searched_like_doubles(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 8)).astype(np.float32))]
    floats = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    doubles = floats.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert multiindex.search(floats, 5, 20).dtypes == multiindex.search(doubles, 5, 20).dtypes
    assert found(multiindex.search(floats, 5, 20)) == found(multiindex.search(doubles, 5, 20))


def test_traversal_rises(spark):
    rng = np.random.default_rng(0)
    left, right = rng.random(7), rng.random(5)
    walked = list(multiindex._traverse(left, right))
    assert [round(t, 12) for t, _, _ in walked] == sorted(round(a + b, 12) for a in left for b in right)
    assert len({(i, j) for _, i, j in walked}) == 35


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_equal_their_sql(spark, con, name):
    build, sql = QUERIES[name]
    df = build(spark, SF)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert set(columns) == set(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in cursor.fetchall())


def test_held_out_language_and_quality(spark):
    documents = {r["doc_id"]: r for r in load(spark, SF, "documents").collect()}
    judged = [r for r in QUERIES["op1_language_id"][0](spark, SF).collect() if r["held_out"]]
    assert sum(documents[r["doc_id"]]["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged) > 0
    labels = {r["doc_id"]: r["quality"] for r in load(spark, SF, "labels").collect()}
    scored = [(labels[r["doc_id"]], r["score"]) for r in QUERIES["op4_quality"][0](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    pairs = [(g, b) for y, g in scored if y for z, b in scored if not z]
    assert sum(g > b for g, b in pairs) >= 0.8 * len(pairs)


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("size", [10, 100, 700])
def test_near_texts_share_a_part_of_their_anchors(size):
    """Pairs of similarity 0.8 exactly, the hardest that count."""
    rng = np.random.default_rng(size)
    shared = -(-16 * size // 18)
    pairs = [rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64) for _ in range(250)]
    left, right = (simhash.home_anchors(np.stack([simhash.wide_sums(x) for x in side])) for side in ([h[:size] for h in pairs], [h[size - shared :] for h in pairs]))
    met = (left == right)[:, np.array(simhash.PART_PLACES)].all(2)
    assert met.any(1).mean() >= 0.9
    # Of unrelated texts one in millions shares a part.
    assert not (left == np.roll(right, 1, 0))[:, np.array(simhash.PART_PLACES)].all(2).any()


def test_near_groups_link_through_any_member(spark):
    """Two groups of near copies that only one pair of members joins, and one text alike to none."""
    rng = np.random.default_rng(8)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    base, far = draw(400), draw(400)
    bridge = base[:]
    bridge[180:212] = draw(32)
    other = bridge[:]
    other[100:132] = draw(32)
    texts = [" ".join(x) for x in (base, base[:-1], base[1:], base[2:], bridge, other, other[:-2], other[1:], far)]
    sets = [five_words(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert alike(0, 4) and alike(4, 5) and not any(alike(i, j) for i in range(4) for j in range(5, 8))
    rows = [(i, t) for i, t in enumerate(texts)] + [(20 + i, t) for i, t in enumerate(texts)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs, 5, 0.8).collect()) == [0, 8]
    without = docs.filter("doc_id % 20 != 4")
    assert sorted(r["doc_id"] for r in simhash.keep_first(without, 5, 0.8).collect()) == [0, 5, 8]


@pytest.mark.parametrize("rare_texts", [1, 3, 64])
def test_links_over_common_and_rare_shingles(spark, monkeypatch, rare_texts):
    """Two groups of near copies whose only link is found after all have met their leads."""
    monkeypatch.setattr(simhash, "RARE_TEXTS", rare_texts)
    rng = np.random.default_rng(8)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    base = draw(400)
    bridge = base[:180] + draw(32) + base[212:]
    other = bridge[:100] + draw(32) + bridge[132:]
    texts = [x[i:] for x in (base, bridge, other) for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.keep_first(docs, 5, 0.8).collect()] == [0]
    without = docs.filter("doc_id not between 6 and 11")
    assert sorted(r["doc_id"] for r in simhash.keep_first(without, 5, 0.8).collect()) == [0, 12]


def test_near_copies_that_are_not_linked_are_not_paired(spark, monkeypatch):
    """Texts of one origin, each changed in four places: similarity to one another is near 0.6."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 150)]
    texts = []
    for i in range(150):
        text = base[:]
        for j, place in enumerate(rng.permutation(14)[:4]):
            text[10 * place + 5] = f"x{i}x{j}"
        texts.append(" ".join(text))
    asked, confirmed = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_first(docs, 5, 0.8).count() == 150
    # First each text meets its leads, then those it may be similar to.
    assert asked[0] > 0 and asked[1] <= 150


def test_marks_never_differ_more_than_texts():
    rng = np.random.default_rng(6)
    for n, changed in ((0, 3), (1, 1), (9, 1), (150, 40), (3000, 700), (40000, 9000)):
        both = np.unique(rng.integers(0, 1 << 63, n + 2 * changed, dtype=np.uint64))
        left, right = both[: len(both) - changed], both[changed:]
        ones = int(np.bitwise_count((simhash.parity_marks(left) ^ simhash.parity_marks(right)).view(np.uint64)).sum())
        assert ones <= len(np.setxor1d(left, right)) and (n > 1000 or ones >= 0.8 * len(np.setxor1d(left, right)))


def test_near_copies_of_common_shingles_are_not_paired(spark, monkeypatch):
    """Texts of one origin, each changed in three places: most of their shingles are common, few pairs are similar."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 150)]
    texts = []
    for i in range(200):
        text = base[:]
        for j, place in enumerate(rng.permutation(14)[:3]):
            text[10 * place + 5] = f"x{i}x{j}"
        texts.append(" ".join(text))
    asked, confirmed = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(docs, 5, 0.8).collect()}
    sets = [five_words(t) for t in texts]
    root = list(range(len(texts)))
    links = [(d, e) for e in root[:] for d in range(e) if len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
    for _ in links:
        for d, e in links:
            root[d] = root[e] = min(root[d], root[e])
    assert len(links) > 5 and kept == {d for d, r in enumerate(root) if d == r}
    # First each text meets its leads, then those it is similar to, though all leave open that they are by their number of common shingles.
    assert asked[1] <= 200


CLASHES = (
    "kept_0 id hash w_id w_hash first text_hash fp root anchor key n_words_ found item_ids best told p __hash __key __p score_ content place gone stays "
    "h n rank size_ threshold times p_ d q v cell chunk x value label marked limit sketch bits"
).split()


@pytest.mark.parametrize("operator", ["identify", "keep_first", "keep_near", "quality", "main_text", "urls", "lines", "overlaps", "mix"])
def test_extra_columns_may_have_any_name(spark, operator):
    """Each operator on a table with its own inner names as columns, with a repeated row, nulls and an empty text."""
    if operator in ("main_text", "urls"):
        html = "<html><body><article><p>Some words of one page.</p></article></body></html>"
        rows = [(1, "http://a.org/x", html), (1, "http://a.org/x", html), (None, None, None), (2, "", "")]
        table = spark.createDataFrame(rows, "page_id long, url string, html string")
    else:
        rows = [(1, "one two three four five six\nseven", "a", "en"), (1, "one two three four five six\nseven", "a", "en"), (None, None, None, None), (3, "", "b", "de")]
        table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    wide = table.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)], F.lit("z").alias("odd.name"))
    run = {
        "identify": lambda t: languageid.identify(t, languageid.train(t)),
        "keep_first": simhash.keep_first,
        "keep_near": lambda t: simhash.keep_first(t, 5, 0.8),
        "quality": lambda t: quality.score_quality(t, quality.train(quality.sample_labelled(t, t.select("doc_id", F.lit(1).alias("quality"))))),
        "main_text": maintext.extract_pages,
        "urls": lambda t: urlrules.judge_urls(t, spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")),
        "lines": linespread.drop_site_boilerplate,
        "overlaps": lambda t: decontaminate.find_overlaps(t, spark.createDataFrame([(1, "two three four")], "item_id long, text string")),
        "mix": mixture.mix_sources,
    }[operator]
    got = run(wide)
    assert [c for c in got.columns if c in wide.columns] == [c for c in wide.columns if operator != "main_text" or c != "html"]
    rows = got.collect()
    # A null and an empty text are near-duplicates, as repeated rows are.
    assert len(rows) == (2 if operator.startswith("keep") else 4)
    assert {tuple(r[c] for c in [*CLASHES, "odd.name"]) for r in rows} == {(*range(len(CLASHES)), "z")}
    plain = [c for c in run(table).columns]
    count = lambda found: Counter(tuple(r[c] for c in plain) for r in found)
    assert count(rows) == count(run(table).collect())
    assert run(wide.limit(0)).count() == 0


def test_pipeline_equals_its_parts_done_plainly(spark):
    docs = load(spark, SF, "documents")
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, stages[-1], SF)
        rows = out.collect()
        stages.append(spark.createDataFrame(rows, out.schema))
        if name != "token_files":
            assert out.columns == docs.columns
    first, named, single, clean, mixed, tokens = [s.collect() for s in stages]
    assert {r["doc_id"] for r in named} == {r["doc_id"] for r in first if any(c.isalpha() for c in r["text"] or "")}
    # Brute force over all pairs of five-word shingle sets. Pairs near 0.8 that share no part may be missed.
    sets = {r["doc_id"]: five_words(r["text"]) for r in named}
    root = {d: d for d in sets}
    links = [(d, e) for d in sets for e in sets if d < e and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
    for _ in links:
        for d, e in links:
            root[d] = root[e] = min(root[d], root[e])
    gone, want = {r["doc_id"] for r in named} - {r["doc_id"] for r in single}, {d for d, r in root.items() if d != r}
    assert gone <= want and len(gone) >= 0.9 * len(want) > 0
    windows = set()
    words = lambda t: [w for w in "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t or "").split(" ") if w]
    for item in load(spark, SF, "benchmark").collect():
        w = words(item["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    dirty = lambda t: any(tuple(t[i : i + n]) in windows for n in lengths for i in range(len(t) - n + 1))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single if not dirty(words(r["text"]))}
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixture.mix_sources(stages[3]).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in taken.items() if n})
    encoder = tokenfiles.Encoder(VOCABULARY)
    want = Counter((r["doc_id"], len(encoder.encode([r["text"]])[0]) // 4 + 1) for r in mixed)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens) == want
    assert [r["start"] for r in sorted(tokens, key=lambda r: r["start"])] == np.cumsum([0] + [r["n_tokens"] for r in sorted(tokens, key=lambda r: r["start"])])[:-1].tolist()


def test_pipeline_of_an_empty_table(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == 0


def test_native_operators_use_no_python():
    """Line spread and decontamination stay on built-in functions."""
    for name in ("linespread.py", "decontaminate.py", "secretscan.py"):
        tree = ast.parse((Path(decontaminate.__file__).parent / name).read_text())
        used = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
        assert not used & {"udf", "pandas_udf", "mapInPandas", "mapInArrow", "applyInPandas", "rdd", "toPandas"}
