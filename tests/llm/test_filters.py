"""URL rules, line spread, benchmark overlap and mixtures against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sqlweave.llm import decontaminate, linespread, mixture, urlrules
from sqlweave.llm.queries import RULES

RULE_DDL = "host string, path string, verdict string"


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "https://a.b.example.org/en/1?q#f", "http://example.org/en/2",
    "http://example.org", "http://x.com/fr/a", "http://x.com/de/a#/fr/", "http://com/de/", "http://notexample.org/es/",
    "http://ÉXample.net/a b", "ftp://example.org?x=/es/", "http://u://x/", "http://a..org/", "http://" + "a." * 300 + "org/" + "p" * 20000,
]


def test_url_rules_equal_brute_force(spark):
    rows = [(i, u, f"h{i}", "kept") for i, u in enumerate(URLS)] + [(0, None, "h0", "kept"), (None, URLS[4], "h", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, `odd.name` string")
    got = urlrules.judge_urls(pages, spark.createDataFrame(RULES, RULE_DDL)).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "odd.name", "host", "path", "rule", "verdict"}
    assert Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter(
        (i, u, *plain_verdict(u, RULES)) for i, u, _, _ in rows
    )


def test_equal_rules_block_and_empty_tables_stay_empty(spark):
    rules = [("A.org", "/x", "allow"), ("a.org", "/x", "block"), (None, "/", "block"), ("org", None, "block")]
    known = spark.createDataFrame(rules, RULE_DDL)
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r) for r in urlrules.judge_urls(pages, known).collect()] == [(1, "http://a.org/x", "a.org", "/x", "a.org/x", "block")]
    assert urlrules.judge_urls(pages.limit(0), known).count() == 0
    assert urlrules.judge_urls(pages, known.limit(0), default="block").collect()[0]["verdict"] == "block"


def test_line_spread_removes_lines_of_many_sites_only(spark):
    rows = [(i, f"own {i}\n  shared \nnear\n\nall", f"s{i}" if i < 4 else "s0") for i in range(8)]
    rows = [(i, t.replace("near", "near" if i < 2 or i > 3 else "other"), s) for i, t, s in rows]
    rows += [(None, None, None), (20, "", "s9"), (21, "shared", None), (0, rows[0][1], "s0"), (22, "x\n" * 5000 + "all", "s1")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_removed int")
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip() and site is not None:
                sites[line.strip()].add(site)

    def cleaned(text):
        if text is None:
            return None, 0, 0
        lines = text.split("\n")
        stay = [x for x in lines if len(sites.get(x.strip(), ())) < 3]
        return "\n".join(stay), len(lines), len(lines) - len(stay)

    # A margin of 1 sends every line to the exact count, a margin of 0 none.
    for margin in (0.0, linespread.MARGIN, 1.0):
        got = linespread.drop_site_boilerplate(docs, 3, margin=margin).collect()
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == Counter((r[0], *cleaned(r[1])) for r in rows)
    assert linespread.drop_site_boilerplate(docs.limit(0), 3).count() == 0


def overlap(text, items):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]

    mine, hit, found = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        if not theirs:
            continue
        size = min(10, len(theirs))
        for w in {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}:
            for i in range(len(mine) - size + 1):
                if tuple(mine[i : i + size]) == w:
                    hit.update(range(i, i + size))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(mine), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_overlaps_equal_brute_force(spark):
    w = [f"w{i}" for i in range(40)]
    items = [
        (1, " ".join(w[:25])), (1, " ".join(w[:25])), (2, "two WORDS"), (3, "Ünï"), (None, " ".join(w[30:40])), (4, None), (5, " .. "),
        (12, " ".join(w[5:20])), (6, "a a a a a a a a a a a a"), (7, "one two three"),
    ]
    docs = [
        (1, "x, " + " ".join(w[3:18]).upper() + " y"), (2, "Two-words and ÜNÏ ünï"), (3, " ".join(w[30:40])), (4, None), (5, ""), (6, "a " * 30),
        (6, "a " * 9), (None, " ".join(w)), (8, " ".join(w[:9])), (9, "one two\nthree one two"), (9, "one two\nthree one two"),
        (10, "filler " * 5000 + " ".join(w[10:21])), (11, " ".join(w[:12] + w[:12])),
    ]
    left = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_hit int")
    right = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, words string")
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.find_overlaps(left, right)
    assert Counter((r["doc_id"], r["text"], *[r[n] for n in names]) for r in got.collect()) == Counter((*d, *overlap(d[1], items)) for d in docs)
    assert decontaminate.find_overlaps(left.limit(0), right).count() == 0
    none = decontaminate.find_overlaps(left, right.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)


def plain_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    open_ = set(names)
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        part = {s: rest * weight[s] / total for s in open_}
        over = {s for s in open_ if target[s] + part[s] >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] += part[s]
            break
        for s in over:
            rest -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_mixture_meets_targets(spark, seed):
    names = ["b", None, "a", "", "é", "Z"]
    rows = [(i, " ".join(["w"] * ((i * 7 + seed) % 23)) or None, names[i % 6] if i % 3 else "b", -1, "x") for i in range(900)]
    rows += [(5, rows[5][1], rows[5][2], -1, "x"), (None, "one  two\tthree\n", "tiny", -1, "x"), (7001, "w " * 50000, "long", -1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, `a.b` string")
    got = mixture.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
    target = plain_targets(sizes, [5, 2, 1], 1.5, 2.0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixture.mix_sources(docs.repartition(7)).collect()
    key = lambda rs: Counter((r["doc_id"], r["text"], r["source"], r["taken"]) for r in rs)
    assert key(again) == key(got)
    assert mixture.mix_sources(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixture.mix_sources(docs.filter("text is null")).collect()].count(0) == docs.filter("text is null").count()


def test_count_words(spark):
    texts = [None, "", " ", "a", "\t a \x0b b\x0c\r\nc ", "a\x85b\xa0c", "x\x00y z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixture.count_words(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
