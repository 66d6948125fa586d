"""Quality rules, sharding, mixing, URL filter and extraction against brute force and their laws."""

import collections
import math
import re
import zlib

import pytest
from fixtures import awkward_texts, frame, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from claimgrid.llm import extract, line_rules, mixing, sharding, url_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules -------------------------------------------------------------------------


def normal(line):
    return re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")


def brute_rules(rows, min_docs, min_share, min_kept):
    hosts, seen = collections.Counter(s for _, _, s in rows), collections.Counter()
    for _, t, s in rows:
        seen.update({(s, normal(x)) for x in (t or "").split("\n") if normal(x)})
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, again = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                again |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(
            len(normal(x).split(" "))
            for x in t.split("\n")
            if normal(x) and (seen[s, normal(x)] >= min_docs or (seen[s, normal(x)] >= 5 and seen[s, normal(x)] / hosts[s] >= min_share))
        )
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        kept = not failed and len(w) - gone >= min_kept * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed, kept, gone))
    return sorted(out, key=repr)


def test_quality_rules(spark):
    notice = "Please Read   the Notice below before going on with this long page of ours"
    rows = awkward_texts()
    rows += [(900 + n, f"{notice}\n{' '.join(f'u{n}x{k}' for k in range(15 if n % 2 else 40))} # * | <b>", "hot") for n in range(12)]
    rows += [(950, "\n".join([notice.lower()] * 3), "hot")]
    rows += [(1000 + n, f"shared by a few of a large host\nown {n}" if n < 9 else f"a line of ten\nown {n}" if n < 19 else f"own {n}", "large") for n in range(300)]
    for min_docs in (5, 10):
        got = plain(line_rules.rated(frame(spark, rows), min_docs=min_docs))
        assert got == brute_rules(rows, min_docs, 0.1, 0.5)
    lost = {x[0] for x in got if x[8] > 0 and isinstance(x[0], int) and x[0] >= 1000}
    assert lost == set(range(1009, 1019))  # ten documents are enough in any host, nine are not in a large one
    removed = [x for x in got if x[8] > 0]
    assert len(removed) >= 13
    docs = frame(spark, rows)
    lost = line_rules.removed_lines(docs, line_rules.frequent_lines(docs, 5))
    cleaned = line_rules.without_lines(docs, lost)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    texts = {x.doc_id: x.text for x in cleaned.where("source = 'hot'").collect()}
    assert texts[950] == "" and texts[900].startswith("u0x0 ")
    assert line_rules.rated(docs.where("false")).count() == 0


# ---- sharding ------------------------------------------------------------------------------


def test_shards(spark):
    rows = awkward_texts()
    got = sharding.assign_shards(frame(spark, rows), 5).collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == want
    for shard in range(5):
        places = sorted(x.slot for x in got if x.shard == shard)
        assert places == list(range(len(places)))
    assert all(x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < 5 for x in got)
    assert sharding.assign_shards(frame(spark, rows).where("false"), 5).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(8, 5000), min_size=1, max_size=120), st.integers(1, 9))
def test_map_is_balanced_and_moves_little(sizes, n):
    sums = [(7 * k, s, 1 + k % 3) for k, s in enumerate(sizes)]
    entries = sharding.draw_up(sums, n)

    def loads(entries, n):
        out = [0] * n
        for _, _, shard, size, _, _ in entries:
            out[shard] += size
        return out

    first = loads(entries, n)
    assert max(first) - min(first) <= max(sizes)
    for shard in range(n):  # positions follow each other without a gap
        own = [e for e in entries if e[2] == shard]
        assert [e[5] for e in own] == [sum(x[4] for x in own[:k]) for k in range(len(own))]
    grown = sharding.rebalanced(entries, sums, n + 1)
    after = loads(grown, n + 1)
    assert max(after) - min(after) <= max(sizes) and grown[0][0] == 2
    same = sharding.rebalanced(entries, sums, n)
    assert max(loads(same, n)) - min(loads(same, n)) <= max(first) - min(first)


def test_versions_are_stored(spark, tmp_path):
    sums = [(k, 100 + k, 1) for k in range(30)]
    one = sharding.draw_up(sums, 3)
    two = sharding.rebalanced(one, sums, 4)
    sharding.save_map(spark, one, str(tmp_path))
    sharding.save_map(spark, two, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 1) == one
    assert sharding.load_map(spark, str(tmp_path), 2) == two


# ---- mixing --------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal, rest, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_ and rest > 1e-9:
        share = rest / sum(weight[s] for s in open_)
        for s in open_:
            goal[s] += share * weight[s]
        rest = sum(max(0, goal[s] - most * sizes[s]) for s in open_)
        for s in names:
            goal[s] = min(goal[s], most * sizes[s])
        open_ = {s for s in open_ if goal[s] < most * sizes[s]}
    return goal


def test_mix(spark):
    rows = [r for r in awkward_texts() if len(r[1] or "") < 50_000]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    words = lambda t: len(WORD.findall(t or ""))
    assert collections.Counter((x.doc_id, x.source, x["size"]) for x in got) == collections.Counter((i, s, words(t)) for i, t, s in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    goal, taken = brute_targets(sizes), collections.Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, goal[x.source], abs_tol=1e-6)
        assert x.taken <= 3 * x["size"] and (x["size"] == 0 or x.taken % x["size"] == 0)
        taken[x.source] += x.taken
    for s in goal:
        smallest = min((words(t) for _, t, x in rows if x == s and words(t)), default=0)
        assert abs(taken[s] - goal[s]) <= smallest / 2 + 1  # few documents: whole ones only
    assert plain(mixing.mix(docs)) == plain(mixing.mix(docs.repartition(2)))
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns
    counts = collections.Counter()
    for x in mixture.collect():
        counts[x.source] += words(x.text)
    assert counts == +taken
    assert mixing.mix(docs.where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 200))
def test_subset_sum_is_nearest(lengths, budget):
    sums = {0}
    for length, n in lengths.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    found = mixing.subset_sum(list(lengths), list(lengths.values()), budget)
    assert all(0 < n <= lengths[x] for x, n in found.items())
    total = sum(x * n for x, n in found.items())
    possible = [s for s in sums if s <= budget + min(lengths)]
    assert abs(total - budget) == min(abs(s - budget) for s in possible)


# ---- URL filter ----------------------------------------------------------------------------


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = (
    [f"https://a{k}.example.org/en/{k}" for k in range(25)]
    + [f"http://Shop{k}.com/de/casino-{k}?x=1" for k in range(25)]
    + [f"http://news{k}.COM/fr/article-{k}#top" for k in range(25)]
    + ["http://x.example.org/es/1", "http://org/", "http://org", "http://notorg.net/", "ftp://com/fr/", "http://com/fr", "http://xcom/fr/"]
    + [None, "", "no scheme", "://", "a://b://c/d", "http://Ä.com/de/ü", "http://q.com?/de/", "http://news.net/article-7", "http://s.net/casino-9"]
    + ["http://news1.COM/fr/article-1#top"] * 2
)


def brute_scores(sites, learn, order=url_model.ORDER):
    tables = {v: collections.Counter() for v in ("allow", "block")}
    pad = lambda s: url_model.START * order + s + url_model.END
    for s, v in learn:
        p = pad(s)
        for k in range(order, len(p)):
            for n in range(order + 1):
                tables[v][p[k - n : k + 1]] += 1
    contexts = {}
    for v, t in tables.items():
        contexts[v] = collections.defaultdict(lambda: [0, 0])
        for g, n in t.items():
            contexts[v][len(g), g[:-1]][0] += n
            contexts[v][len(g), g[:-1]][1] += 1

    def p(v, gram):
        low = p(v, gram[1:]) if len(gram) > 1 else 1 / url_model.ALPHABET
        n, kinds = contexts[v].get((len(gram), gram[:-1]), (0, 0))
        return low if n == 0 else (tables[v][gram] + kinds * low) / (n + kinds)

    def score(s):
        q = pad(s)
        grams = [q[k - order : k + 1] for k in range(order, len(q))]
        return sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in grams) / len(grams)

    return {s: score(s) for s in sites}


def test_urls(spark):
    pages = spark.createDataFrame([(n, u, "x", 1.0) for n, u in enumerate(URLS)], "page_id long, url string, host string, score double").repartition(3)
    got = {x.page_id: x for x in url_model.judged(pages).collect()}
    assert len(got) == len(URLS)
    held = {x.s for x in spark.createDataFrame([("".join(brute_parts(u)),) for u in URLS], "s string").where(url_model.held_out("s")).collect()}
    learn = []
    for n, u in enumerate(URLS):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, rule), u
        if rule:
            assert got[n].verdict == verdict and got[n].score is None
            if host + path not in held:
                learn.append((host + path, verdict))
    want = brute_scores({x.host + x.path for x in got.values()}, learn)
    for x in got.values():
        assert x.rule or math.isclose(x.score, want[x.host + x.path], abs_tol=1e-9)
    asked = {URLS[n]: got[n].verdict for n in got if not got[n].rule}
    assert asked["http://news.net/article-7"] == "allow" and asked["http://s.net/casino-9"] == "block"
    assert url_model.judged(pages.where("false")).count() == 0


def test_url_joins_broadcast_nothing(spark, monkeypatch):
    """Exploded rows are many times their table's files, by which Spark would broadcast them."""
    plans = []

    def seen(step):
        def run(df):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return step(df)

        return run

    monkeypatch.setattr(url_model, "stored", seen(url_model.stored))
    monkeypatch.setattr(url_model, "threshold", seen(url_model.threshold))
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    seen(lambda df: df)(url_model.judged(pages))
    assert sum("SortMergeJoin" in p for p in plans) == url_model.ORDER + 4
    assert not any("Broadcast" in p for p in plans)


# ---- extraction ----------------------------------------------------------------------------

PAGES = {
    "<html><body><nav><a>Menu</a></nav><article><h1>Title</h1><p>One  two<br>three</p><p>A &amp; B &eacute;&#33;</article><footer>f</footer>": "Title\n\nOne two three\n\nA & B é!",
    "<body><div class='sidebar'>s</div><main><p>x<p>y<aside>no</aside><form>f<input value='>'></form></main></body>": "x\n\ny",
    "<article><p>a<script>var x='</p>';</script>b<!-- <p>c --></p><ul><li>1<li>2</ul><div class=comments><p>first!</div></article>": "ab\n\n1\n\n2",
    "<div><p>plain <b>bold</b> text</p><div id='cookie-notice'>We use</div><table><tr><td>1<td>2</table></div>": "plain bold text\n\n1\n\n2",
    "no markup at all  &lt;here&gt;": "no markup at all <here>",
    "<header>top</header><article><header><h1>H</h1></header><p>1 < 2</p><section class='ad-box ad'>buy</section></article>": "H\n\n1 < 2",
    "": "",
    "<p>   </p>": "",
    "<article>broken <p>para <b>open": "broken\n\npara open",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_single_pages(page):
    assert extract.main_text(page, None, set()) == PAGES[page]


def test_template_of_a_host(spark):
    shell = "<html><body><div class=x1><p>All about things</p></div><div class=x2><h2>{t}</h2><p>{a}</p><p><i>Read on</i> {b}</p></div><div class=x3>{c}</div></body></html>"
    rows = [(n, f"http://H.test/{n}", shell.format(t=f"T{n}", a=f"body {n} " * 9, b=f"more {n} " * 5, c=f"v{n}")) for n in range(9)]
    rows += [(100, None, None), (101, "http://other.test/", "<p>alone</p>"), (102, "bad", ""), rows[0]]
    pages = spark.createDataFrame([(*r, "m", "f") for r in rows], "page_id long, url string, html string, main string, fixed string").repartition(3)
    got = extract.extract_main_text(pages).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.n_chars == len(x.text)
        if x.page_id < 100:  # the slot that varies, without its fixed words
            n = x.page_id
            assert x.text == f"T{n}\n\n{('body %d ' % n * 9).strip()}\n\n{('more %d ' % n * 5).strip()}"
    assert {x.page_id: x.text for x in got if x.page_id >= 100} == {100: "", 101: "alone", 102: ""}
    assert extract.extract_main_text(pages.where("false")).count() == 0


def test_template_decides_before_names(spark):
    shell = (
        "<body><nav><a>{t} menu</a></nav><article class=teaser>Short {t}</article><div class=x7><h2>{t}</h2><p>{a}</p>"
        "<section class=related><p>{b}</p></section></div><footer>{t}</footer></body>"
    )
    rows = [(n, f"http://h.test/{n}", shell.format(t=f"T{n}", a=f"body {n} " * 30, b=f"other {n}")) for n in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x.page_id: x.text for x in extract.extract_main_text(pages).collect()}
    # The slot with the data, not the element called article; the small slot beside it has the template's word.
    assert got == {n: f"T{n}\n\n{('body %d ' % n * 30).strip()}" for n in range(8)}


NAMED = {
    '<div class="content no-sidebar"><article><p>long text</article></div>': "long text",
    '<div class="post tags-news"><article><p>long text</article></div>': "long text",
    '<div class="page has-header"><div><p>long text</div></div>': "long text",
    '<div class="sidebar"><article><p>long text</article></div><div class=ad>buy</div>': "long text",
    "<article><p>first part<section class=legal><p>second part</section></article>": "first part\n\nsecond part",
    '<article><p>first part<section class="related work"><p>second</section></article>': "first part\n\nsecond",
    '<article><p>first part<section class="notice"><p>second</section></article>': "first part\n\nsecond",
    '<article><p title="the hidden valley">seen</p><p hidden>not seen</p><p style="display: none">nor this</p></article>': "seen",
    "<form class=login><p>all that is here</p></form>": "all that is here",
    "<article><p>long text</p></article><div class='ad box'>buy</div><div class='cookie-notice'>yes</div>": "long text",
}


@pytest.mark.parametrize("page", list(NAMED))
def test_names_drop_no_text(page):
    assert extract.main_text(page, None, set()) == NAMED[page]
