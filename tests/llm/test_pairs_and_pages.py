import math
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from blockprep.llm import components, minhash, pages, topk
from tests.llm.odd import empty, odd_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def classes(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_classes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = classes(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"]) == expected[row["doc_id"]], row
            assert row["kept"] == (row["doc_id"] == row["component_id"])


def test_classes_of_odd_documents(spark):
    docs = odd_documents(spark, "bucket string, id string")
    check_classes(docs)
    assert minhash.near_duplicates(empty(docs)).count() == 0


def test_classes_around_the_threshold(spark):
    """Families of drifting copies, and many texts that share a long passage only."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, number = [], 0
    for _ in range(6):
        text = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(8):
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append((number := number + 1, " ".join(text)))
    passage = [word() for _ in range(60)]
    rows += [(number := number + 1, " ".join(passage + [word() for _ in range(25)])) for _ in range(40)]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string"))


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    """Each text of an id is compared and kept for itself; only linked and repeated rows go."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (7, b + " more"), (7, c), (8, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    links = [(1, 36, 1, True), (5, 37, 1, False), (5, 36, 5, True), (5, 36, 5, True), (7, 37, 5, False), (7, 36, 7, True)]
    assert got == sorted([*links, (8, 0, 8, True), (8, 0, 8, True)])
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in left) == [(1, a), (5, b), (7, c), (8, ""), (8, "")]


def test_stars_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 9)] + [(20, 30), (30, 25), (25, 20), (40, 40)]
    got = {tuple(r) for r in components.stars(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, 1) for i in range(2, 10)} | {(25, 20), (30, 20)}


def test_densified_bins_are_all_filled():
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, i, dtype=np.uint64)) for i in (0, 1, 3, 500)]
    bins = minhash.bin_values(sets)
    assert (bins[0] == 0).all() and all(set(bins[i]) <= set(sets[i].tolist()) for i in (1, 2, 3))


@pytest.mark.parametrize("tile", [8192, 50])
def test_top_k_equals_brute_force(spark, tile):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300, rows[7][1]), (301, rows[7][1]), (400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0] * 3), (None, rows[1][1]), (5, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, v in usable:
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(found[:10])}
    got = {tuple(r) for r in topk.top_k(table, table.where("vec_id % 100 = 0"), tile=tile, chunk=3).collect()}
    assert got == expected
    assert topk.top_k(empty(table), empty(table)).count() == 0


def test_top_k_prunes_blocks_and_stays_exact_beyond_floats():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (20, 16))
    rows = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 10, (4000, 16))).astype(np.int64)
    ids, asked = np.arange(4000), np.arange(0, 4000, 400)
    found, scored = topk.search_tile(ids, rows, asked, rows[asked], 10)
    assert scored < 0.7 * len(ids) * len(asked)
    big, _ = topk.search_tile(ids[:200], rows[:200] << 30, asked[:1], rows[:1] << 20, 3)
    small, _ = topk.search_tile(ids[:200], rows[:200], asked[:1], rows[:1], 3)
    assert [(q, i, s << 50) for q, i, s in small] == big


def test_scores_beyond_64_bits_are_the_nearest_long(spark):
    rows = [(0, [1e10, 1.0]), (1, [1e10, 0.0]), (2, [-1e10, 0.0]), (3, [3e10, 5.0]), (4, [1e300, 0.0]), (5, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    low, high = -(2**63), 2**63 - 1
    cut = lambda x: max(low, min(high, x))
    whole = {i: [cut(math.floor(1024 * x)) for x in v] for i, v in rows}
    score = {i: cut(sum(a * b for a, b in zip(whole[0], whole[i]))) for i in range(1, 6)}
    expected = [(0, k + 1, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))]
    assert score[1] == score[3] == high and score[2] == low
    for tile in (2, 8192):
        got = topk.top_k(table, table.where("vec_id = 0"), tile=tile).orderBy("rank")
        assert [tuple(r) for r in got.collect()] == expected


PAGE = """<html><head><title>x</title></head><body><div class="cookie-notice">We use cookies</div>
<header><h1>Site</h1></header><nav>m</nav><article class="post"><header><h1>T &amp; U</h1></header>
<div class="share-buttons">Share</div><p>One&nbsp;two<br>three <i>f</i>our<p>Five<ul><li>a<li>b</ul><form>q<input></form>
<section class="comments"><article class="comment"><p>much longer reader comment, longer than all else on this page</p></article></section>
</article><aside>side</aside><script>if (a<b) "</p>"</script><footer>c</footer>"""


def test_main_text():
    assert pages.main_text(PAGE, set()) == "T & U\nOne two\nthree four\nFive\na\nb"
    cases = {"": "", "<": "<", "a<b>c": "ac", "</p></div>": "", "<!-- x": "", "<script>x": "", "<div hidden>z</div>k": "k", "<p>a<p>b": "a\nb"}
    for source, text in cases.items():
        assert pages.main_text(source, set()) == text, source


@pytest.mark.parametrize("broadcast", [pages.BROADCAST_BYTES, -1])
def test_templates_of_a_host_go_and_copied_articles_stay(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pages, "BROADCAST_BYTES", broadcast)
    box, shell = "<div><span>read our other stories</span></div>", "<body>{}<div><p>{}</p></div></body>"
    rows = [(i, "http://A.example/x?y", shell.format(box, f"story {i}")) for i in range(8)]
    rows += [(100 + i, "https://b.example:80/", "<body><div><div><p>copied story</p></div></div></body>") for i in range(20)]
    rows += [(200, None, shell.format(box, "elsewhere")), (201, "http://a.example", None), (None, "", ""), (None, "", "")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in pages.extract_text(table).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    assert all(by_id[i] == f"story {i}" for i in range(8)) and all(by_id[100 + i] == "copied story" for i in range(20))
    assert by_id[200] == "read our other stories\nelsewhere" and by_id[201] == "" and by_id[None] == ""
    assert pages.extract_text(empty(table)).count() == 0


def test_all_articles_of_a_page_and_main_before_a_teaser():
    parts = "<main><article><p>part one</article><div>between</div><article><p>the second part</article></main>"
    assert pages.main_text(parts, set()) == "part one\nthe second part"
    story = f"<main><div>{prose(3, 60)}</div></main>"
    assert pages.main_text(f"{story}<article>teaser</article>", set()) == prose(3, 60)


def extracted(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return dict(pages.extract_text(table).select("page_id", "text").collect())


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_inline_links_are_no_templates(spark):
    """A link in many paragraphs of one page, and of many pages, stays in its sentences."""
    told = lambda k: f"<p>{prose(k, 30)} <a>Smith</a> and <span>Jones</span> went.</p>"
    rows = [(i, "http://a.example/", "<body><div>" + "".join(told(10 * i + k) for k in range(6)) + "</div></body>") for i in range(7)]
    got = extracted(spark, rows)
    assert all(text.count("Smith and Jones went.") == 6 for text in got.values())


def test_near_copies_are_one_page_and_articles_stay_whole(spark):
    story, table, box = prose(1, 200), "<table><tr><td>unchanged figures</td></tr></table>", "<div>from our sponsors</div>"
    near = "<body><div><p>{}</p></div><div>aside {}</div></body>"
    edited = "<body><div><p>{} edit {}</p>{}</div></body>"
    article = "<body>{}<article><p>{}</p>{}</article></body>"
    rows = [(i, "http://a.example/", near.format(story, i)) for i in range(8)]
    rows += [(10 + i, "http://b.example/", edited.format(story, i, table)) for i in range(8)]
    rows += [(20 + i, "http://c.example/", article.format(box, prose(50 + i, 40), table + box)) for i in range(8)]
    rows += [(100 + i, "http://d.example/", f"<body>{box}<div>{prose(100 + i, 40)}</div></body>") for i in range(30)]
    rows += [(200 + i, "http://d.example/", f"<body>{box}<div>{story}</div><p>{prose(200 + i, 300)}</p></body>") for i in range(6)]
    got = extracted(spark, rows)
    for i in range(8):
        assert got[i] == f"{story}\naside {i}"
        assert got[10 + i] == f"{story} edit {i}\nunchanged figures"
        assert got[20 + i] == f"{prose(50 + i, 40)}\nunchanged figures\nfrom our sponsors"
    assert all(got[100 + i] == prose(100 + i, 40) for i in range(30))
    assert all(got[200 + i] == f"{story}\n{prose(200 + i, 300)}" for i in range(6))


def test_names_do_not_take_the_story():
    """Layout names, negations, subjects and page-wide forms leave the text; names of furniture still go."""
    story = prose(9, 30)
    cases = {
        f'<div class="content-sidebar-wrap"><main><article>{story}</article></main></div>': story,
        f'<article class="post no-sidebar">{story}</article>': story,
        f"<form><nav>menu</nav><article>{story}</article></form>": story,
        f'<article>{story}<section id="discussion"><h2 id="search">Discussion</h2>found</section></article>': f"{story}\nDiscussion\nfound",
        f'<p title="the hidden cost">{story}</p><p hidden>z</p>': story,
        f"<main>{story}</main><main>more</main>": f"{story}\nmore",
        f'<div class="ad-300x250">buy</div><div id="site-footer">f</div><div>{story}</div>': story,
        f'<div>few words</div><div class="comments-area"><article>{story}</article></div>': "few words",
        f'<body><form class="newsletter">{story}</form>k</body>': "k",
        f'<p>cut</p><div class="a" <p>{story}</p><a href="http://x': f"cut\n{story}",
    }
    for source, text in cases.items():
        assert pages.main_text(source, set()) == text, source


@pytest.mark.parametrize(
    "source",
    [
        "<a " + '"' * 10_000,
        "<p>x" + '<a x="' * 10_001,
        "<a x='\"'" * 10_000,
        "<a " + "a" * 100_000 + ">",
        "<div>" * 30_000 + "t" + "</div></p>" * 30_000,
        "<p><table><td>" + "<div>" * 30_000,
        "<header><h1>" * 15_000,
        "<" * 100_000,
    ],
)
def test_broken_pages_are_read_in_proportion(source):
    start = time.process_time()
    page = pages.Page(source)
    pages.main_text(page, {1})
    pages.block_hashes(page)
    assert time.process_time() - start < 5


def test_paragraphs_of_a_site_go_where_names_say_nothing(spark):
    """Blocks of any kind are counted, not only containers."""
    rows = [(i, "http://a.example/", f"<body><h5>Our site</h5><p>{prose(i, 60)}</p><p>All rights kept</p></body>") for i in range(9)]
    assert extracted(spark, rows) == {i: prose(i, 60) for i in range(9)}
