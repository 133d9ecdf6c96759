"""HTML extraction, line de-duplication and mixing against plain versions."""

import html
import math
import random
import re
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledger_spark.llm import htmltext, linededup, mixing

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, source string"


def blocks(source):
    return [b["text"] for b in htmltext.Page(source, htmltext._Kinds()).content()]


@pytest.mark.parametrize("source,expected", [
    (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]),
    ("<article><p>One <b>two</b><p>Three<br>four</p></article>", ["One two", "Three four"]),
    ("<header>H</header><nav>N</nav><main><h1>T</h1><ul><li>a<li>b</ul></main><footer>F</footer>", ["T", "a", "b"]),
    ("<article><header><h1>T</h1></header><p>x</p><div class='share-bar'>s</div><section id=comments><p>c</p></section></article>",
     ["T", "x"]),
    ("<div class='cookie-notice'>c</div><div class=text><p>x &eacute;&#8212;&bogus;</p></div><script>'<p>no</p>'</script>", ["x é—&bogus;"]),
    ("<div class='top'><a href=1>A</a> <a href=2>B</a></div><p>text with <a href=3>a link</a> in it</p>", ["text with a link in it"]),
    ("<form><p>name</p></form><p hidden>h</p><p style='display:none'>n</p><p>v</p>", ["v"]),
    ("<p>a < b</p><p title=\"x>y\">q</p><!-- <p>no</p> --><p>end", ["a < b", "q", "end"]),
    ("<p>x<!-- never closed <p>y", ["x"]), ("<script>never closed <p>x", []),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
])
def test_blocks_of_a_page(source, expected):
    assert blocks(source) == expected


@pytest.mark.parametrize("source,expected", [
    ("<html class=no-sidebar><body class='has-sidebar comments-open'><p>x</p></body>", ["x"]),
    ("<body class=sidebar style='display:none'><p>x</p></body>", ["x"]),
    ("<div id=page class='right-sidebar comments-open'><p>x</p></div>", ["x"]),
    ("<div class=sidebar><p>s</p><article><p>x</p></article></div><p>y</p>", ["x"]),
    ("<form><main><p>x</p></main></form>", ["x"]),
    ("<article><p>x</p></article><div class=related><article><p>teaser</p></article></div>", ["x"]),
    ("<article><section class=commentary><p>x</p></section><div class='naval-history side-by-side'><p>y</p></div></article>", ["x", "y"]),
    ("<article><p>x</p><div class='share-bar'>s</div><div class=cookieNotice>c</div><div hidden><p>h</p></div></article>", ["x"]),
])
def test_only_whole_class_words_leave_out_and_never_the_article(source, expected):
    assert blocks(source) == expected


@pytest.mark.parametrize("piece", ["<a ", '<a href="x> ', "<!", "<p><div>", "</p>", "<script", "&amp", "<p title='a<b'>x"])
def test_odd_markup_is_read_in_linear_time(piece):
    begin = time.perf_counter()
    page = htmltext.Page(piece * 30_000 + "</p>" * 30_000, htmltext._Kinds())
    page.content()
    assert len(htmltext.Template().merge(htmltext.read_skeleton(page.skeleton()))) == len(page.labels)
    assert time.perf_counter() - begin < 10


def plain_score(a, b):
    """Simple tree matching, the recursive definition."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_score(x, y))
    return 1 + best[-1][-1]


def random_tree(rng, depth=3):
    return rng.choice("abc") if depth < 3 else "page", [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []


def test_alignment_keeps_the_most_nodes():
    rng = random.Random(2)
    for _ in range(60):
        one, two = random_tree(rng), random_tree(rng)
        template = htmltext.Template()
        first = template.merge(one)
        size = len(template.labels)
        second = template.merge(two)
        shared = sum(s < size for s in second)
        assert len(set(first)) == len(first) and len(set(second)) == len(second)
        assert shared == plain_score(one, two)
        assert template.merge(one) == first


def test_skeleton_round_trip():
    page = htmltext.Page("<div class='b a'><p>x</p><p>y</p><ul><li>z</ul></div>", htmltext._Kinds())
    tree = htmltext.read_skeleton(page.skeleton())
    assert tree == ("page", [("div.b.a", [("p", []), ("ul", [("li", [])])])])


def test_constant_slots_are_template(spark):
    """Unlabelled boilerplate goes; copies of a page and repeated paragraphs do not."""
    def page(i, extra=""):
        return (f"<div class=zone1>Our shop is best</div><div class=zone2><p>Story number {i} about {i * 7}.</p>"
                f"<p>Shared legal line.</p>{extra}</div><div class=zone3>Call {1 + i % 2} now</div>")
    rows = [(i, f"https://h.example/{i}", page(i, "<h2>x</h2>" if i % 3 else "")) for i in range(60)]
    rows += [(100 + i, "http://copies.example/x", page(1)) for i in range(40)]
    rows += [(200, None, page(5)), (201, "no host", None)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host")).collect()}
    assert got[0] == "Story number 0 about 0.\nShared legal line."
    assert got[4] == "Story number 4 about 28.\nShared legal line."
    assert got[100].startswith("Our shop is best\nStory number 1") and got[201] == "" and got[200].startswith("Our shop")
    assert len(got) == len(rows)


def test_constant_blocks_inside_the_article_are_template(spark):
    """A notice, advert or heading that every page of the host repeats, wherever it stands; not on a host of few pages."""
    def page(i):
        notice, advert = "<p>Subscribe to our letter.</p>", "<ul><li>Buy now</li></ul>"
        body = [f"<p>Story {i} begins.</p>", f"<p>It goes on {i * 3}.</p>" + ("<p>Seen here and there.</p>" if i % 4 == 0 else "")]
        body.insert(i % 3, notice)
        return f"<article><h2>The Daily</h2><h1>Title {i}</h1>{''.join(body)}{advert}</article>"
    rows = [(i, f"https://many.example/{i}", page(i)) for i in range(40)]
    rows += [(100 + i, f"https://few.example/{i}", page(i)) for i in range(3)]
    rows += [(200 + i, f"https://copies.example/{i}", page(1)) for i in range(40)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(40):
        seen = "\nSeen here and there." if i % 4 == 0 else ""
        assert got[i] == f"Title {i}\nStory {i} begins.\nIt goes on {i * 3}.{seen}"
    assert all("Subscribe to our letter." in got[k] and "Buy now" in got[k] for k in [*range(100, 103), *range(200, 240)])


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_no_pages(spark):
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


def plain_chain(values):
    """A longest increasing subsequence by comparing all pairs; of several the one that
    ends last, its element before that last, and so on."""
    length = []
    for i, v in enumerate(values):
        length.append(1 + max((length[j] for j in range(i) if values[j] < v), default=0))
    chain, at, want = [], len(values), max(length, default=0)
    while want:
        at = max(j for j in range(at) if length[j] == want and (not chain or values[j] < values[chain[-1]]))
        chain.append(at)
        want -= 1
    return chain[::-1]


def test_the_longest_chain():
    rng = random.Random(3)
    for _ in range(500):
        values = rng.sample(range(100), rng.randint(1, 25))
        assert linededup.longest_increasing(np.array(values)).tolist() == plain_chain(values)
    assert linededup.longest_increasing(np.arange(9)).tolist() == list(range(9))


def passage(seed, sentences=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    return " ".join(" ".join(word() for _ in range(10)).capitalize() + "." for _ in range(sentences))


def test_units_join_to_the_text_and_follow_the_words():
    for text in [None, "", " \n ", "one", "ünï cödé\u00a0x \u2028y", "  lead and tail \n\n", passage(1), f"{passage(2)}\n{passage(3)}"]:
        pieces, words = linededup.units(text)
        assert ("".join(pieces) if pieces else text or "") == (text or "") or not (text or "").strip()
        assert words == [len(p.encode().split()) for p in pieces] and all(words)
    inner = {p.strip() for p in linededup.units(passage(4))[0][1:-1]}
    around = {p.strip() for p in linededup.units(f"other words {passage(4)} more words\nline")[0]}
    assert len(inner) > 5 and inner <= around


def plain_lines(words, least=linededup.BLOCK_WORDS):
    """(first unit, units) of the shortest runs of ``least`` words from and up to each unit."""
    out = set()
    for i in range(len(words)):
        j = next((j for j in range(i + 1, len(words) + 1) if sum(words[i:j]) >= least), None)
        out |= {(i, j - i)} if j else set()
        k = next((k for k in range(i, -1, -1) if sum(words[k:i + 1]) >= least), None)
        out |= {(k, i + 1 - k)} if k is not None else set()
    return sorted(out)


def test_lines_are_the_shortest_runs_and_cover_every_stretch():
    rng = random.Random(6)
    for _ in range(200):
        words = np.array([rng.randint(1, 9) for _ in range(rng.randint(0, 40))], np.int64)
        h = np.array([rng.randrange(5) for _ in words], np.uint64)  # equal units as well
        first, size, line = linededup.lines(h, words)
        found = list(zip(first.tolist(), size.tolist()))
        assert found == plain_lines(words.tolist())
        same = {}
        for (i, n), x in zip(found, line.tolist()):
            assert same.setdefault(tuple(h[i:i + n].tolist()), x) == x  # equal runs, equal hash
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if words[i:j].sum() >= linededup.BLOCK_WORDS:
                    inside = [set(range(a, a + n)) for a, n in found if i <= a and a + n <= j]
                    assert set().union(*inside) == set(range(i, j))


def test_every_passage_of_50_words_shares_a_line_hash():
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    for _ in range(2000):
        shared = text(50)
        one, two = (set(linededup.lines(*linededup.unit_hashes(f"{text(30)} {shared} {text(30)}".encode()))[2].tolist())
                    for _ in range(2))
        assert one & two


def test_a_passage_whose_parts_stand_in_earlier_documents(spark):
    """Each line of the passage is common; the passage as a whole is only in documents 50 and 60."""
    lines = [" ".join(passage(60 + i).split()[:12]) for i in range(8)]
    shared = "\n".join(lines)
    docs = [(i, f"{passage(80 + i)}\n{line}\n{passage(90 + i)}") for i, line in enumerate(lines)]
    docs += [(50, f"{shared}\n{passage(100)}"), (60, f"{passage(101)}\n{shared}")]
    got = {r.doc_id: r.text for r in linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k] == t for k, t in docs[:-1])
    assert got[60].strip() == passage(101)


def plain_alignments(mine, theirs):
    """Units cut by alignment after alignment. ``mine``: (first unit, units, line) in order;
    ``theirs``: line -> (first unit, units) in the owner."""
    cut, left = set(), mine
    while left:
        seen, here = set(), []
        for i, n, line in left:
            if line not in seen:
                seen.add(line)
                here.append((i, n, theirs[line]))
        for k in plain_chain([x[2] for x in here]):
            cut |= set(range(here[k][0], here[k][0] + here[k][1]))
        left = [x for x in left if not cut & set(range(x[0], x[0] + x[1]))]
    return cut


def test_alignment_decides_and_leaves_no_shared_line():
    rng, differs = random.Random(12), 0
    for _ in range(400):
        size = [0, *(rng.randint(1, 9) for _ in range(14))]
        b = [rng.randint(1, 14) for _ in range(rng.randint(0, 25))]
        a = []
        for i in (rng.randint(0, 20) for _ in range(rng.randint(1, 4))):
            a += [*b[i:i + rng.randint(3, 9)], rng.randint(1, 14)]
        words = [size[x] for x in a]
        theirs = {}
        for i, n in plain_lines([size[x] for x in b]):
            theirs.setdefault(tuple(b[i:i + n]), (i, n))
        mine = [(i, n, tuple(a[i:i + n])) for i, n in plain_lines(words) if tuple(a[i:i + n]) in theirs]
        cut = plain_alignments(mine, theirs)
        if mine:
            place = lambda x: x[0] << linededup.SIZE_BITS | x[1]
            got = linededup.aligned_blocks(np.array([place(x) for x in mine]), np.array([place(theirs[x[2]]) for x in mine]))
            assert set(got.tolist()) == cut
        covered = set().union(*(set(range(i, i + n)) for i, n, _ in mine))
        assert cut <= covered and all(cut & set(range(i, i + n)) for i, n, _ in mine)
        differs += cut != covered  # without the alignment all that any shared line covers would go
    assert differs > 5


def test_moved_and_repeated_passages_are_cut(spark):
    p, q = passage(21), passage(22)
    docs = [(1, f"{q}\n{p}\n{passage(23)}"), (2, f"{p}\nown words\n{q}"), (3, f"{p}\nbetween\n{p}\nend")]
    got = {r.doc_id: r.text for r in linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1]
    for text, own in ((got[2], ["own", "words"]), (got[3], ["between", "end"])):
        assert len(text.split()) < 2 + 3 * linededup.BLOCK_WORDS and set(own) <= set(text.split())
        assert not any(" ".join(x.split()[20:-20]) in text for x in (p, q))


def plain_dedup(docs):
    """Every document's lines looked up in all documents; ``docs`` are (id, text), ids distinct."""
    pieces = {k: linededup.units(t) for k, t in docs}
    runs = {k: [(i, n, tuple(p.strip() for p in u[i:i + n])) for i, n in plain_lines(w)] for k, (u, w) in pieces.items()}
    holders = {}
    for k in sorted(runs):
        for i, n, line in runs[k]:
            holders.setdefault(line, (k, (i, n)))  # the owner and its first place
    out = []
    for k, text in docs:
        cut = set()
        for owner in {holders[line][0] for _, _, line in runs[k]} - {k}:
            mine = [x for x in runs[k] if holders[x[2]][0] == owner]
            cut |= plain_alignments(mine, {x[2]: holders[x[2]][1] for x in mine})
        u = pieces[k][0]
        out.append((k, "".join(p for j, p in enumerate(u) if j not in cut) if u else text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_the_plain_version(spark, seed):
    """Random documents of shared, moved, repeated and broken passages, text ids."""
    rng = random.Random(seed)
    parts = [passage(200 + 40 * seed + i, rng.randint(1, 5)) for i in range(12)]
    docs = []
    for i in range(60):
        chosen = [rng.choice(parts) if rng.random() < 0.7 else passage(9000 + 100 * seed + i, 2) for _ in range(rng.randint(1, 6))]
        words = " ".join(chosen).split()
        if rng.random() < 0.5:
            words = words[rng.randint(0, 8):]
        docs.append((f"k{i:03d}", "".join(w + ("\n" if rng.random() < 0.04 else " ") for w in words)))
    got = linededup.deduplicate(spark.createDataFrame(docs, "doc_id string, text string"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == plain_dedup(docs)


def test_line_dedup_keeps_any_column_and_any_id(spark):
    p = passage(31)
    rows = [((1 << 63) - 1, f"{p} tail one"), (None, f"{p} tail two"), (None, f"{p} three"), (-5, f"head {p}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("cut", "_cut", "CUT_ID", "cut_version", "cut_units", "line", "owner", "mine", "theirs", "version", "id"):
        docs = docs.withColumn(name, F.lit("x"))
    got = linededup.deduplicate(docs)
    assert got.columns == [*docs.columns, "__cut"] and {r.cut for r in got.collect()} == {"x"}
    cut = {(r.doc_id, r.text.split()[-1]): r["__cut"] > 0 for r in got.collect()}
    assert cut == {(-5, p.split()[-1]): False, ((1 << 63) - 1, "one"): True, (None, "two"): True, (None, "three"): True}
    assert linededup.drop_repeats(docs).columns == docs.columns


def test_a_row_without_text_shares_an_id(spark):
    p = passage(33)
    rows = [(1, p), (2, None), (2, f"{p} own"), (2, ""), (3, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.cut) for r in linededup.deduplicate(docs).collect() if r.doc_id == 2 and r.text)
    assert [r[1].split()[-1] for r in got] == ["own"] and got[0][2] > 0
    assert linededup.deduplicate(docs).count() == 5


def test_a_very_long_text_with_many_owners(spark):
    parts = [passage(400 + i) for i in range(150)]
    docs = [(i, f"{x} {passage(600 + i, 1)}") for i, x in enumerate(parts)] + [(1000, " ".join(parts[::-1]) * 3)]
    got = {r.doc_id: r.text for r in linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(plain_dedup(docs)) and len(got[1000]) < 0.3 * len(docs[-1][1])


def test_line_dedup_against_all_pairs(spark):
    shared, other = passage(1), passage(2)
    docs = [(1, f"Intro one here. {shared}\nTail one."), (2, f"Something else. {shared} Tail two."), (3, passage(3)),
            (4, f"{passage(4)}\n{other}\n{passage(5)}"), (5, f"{other}\n{shared}"), (6, f"{passage(4)}\n{other}\n{passage(5)}"),
            (7, "Short line.\nShort line.\n"), (8, "Short line.\n"), (9, "no stops " + shared.replace(".", "").lower()),
            (10, shared.replace(".", "").lower() + " either")]
    got = linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == plain_dedup(docs)
    kept = {r.doc_id: r.text for r in linededup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert 6 not in kept and {1, 3, 4, 7, 8, 9} <= set(kept) and kept[8] == docs[7][1]
    middle = " ".join(shared.split()[10:-10])
    assert sum(middle in t for t in kept.values()) == 1
    assert sum(" ".join(shared.replace(".", "").lower().split()[10:-10]) in t for t in kept.values()) == 1


def test_line_dedup_nulls_repeats_hot_passage_and_columns(spark):
    hot = passage(9)
    rows = [(None, f"{hot} no id", "n"), (1, None, "a"), (2, "", "a"), (3, hot, "b"), (3, hot, "b"), (3, f"{hot} other version", "b")]
    rows += [(10 + i, f"{passage(100 + i, 3)}\n{hot}", "c") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS cut", "2 AS id", "3 AS words")
    kept = linededup.drop_repeats(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    middle = " ".join(hot.split()[10:-10])
    assert len(rows) == 206 and sum(middle in (r.text or "") for r in rows) == 3  # the versions of document 3
    assert linededup.drop_repeats(docs.limit(0)).count() == 0


WEIGHTS = [{"a": 1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1 / 20 for i in range(20)}, {s: 1 / 3 for s in "abc"},
           {"a": 0.0001, "b": 0.9999}, {"a": 0.123456789, "b": 0.7, "c": 2}, {f"s{i}": 1 + i % 7 for i in range(1000)}]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_every_slot_stays_within_a_block_of_the_targets(weights):
    """Against the exact targets, over far more slots than any rounding would forgive."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    whole = sum(exact.values())
    assert mixing.units_of(weights) == {s: w / whole * sum(mixing.units_of(weights).values()) for s, w in exact.items()}
    n = 3000 if len(weights) > 100 else 12_000
    plan = mixing.schedule(mixing.units_of(weights), {s: n for s in weights})
    order = sorted((int(t), s) for s, x in plan.items() for t in x[:, 0])
    assert [t for t, _ in order] == list(range(n * len(weights)))
    end = min(int(x[-1, 0]) for x in plan.values())  # all sources have blocks up to here
    w, done = {s: x / whole for s, x in exact.items()}, Counter()
    for t, s in order[:min(end, 30_000)]:
        done[s] += 1
        k = done[s] - 1
        assert k / w[s] < t + 1 <= -(-(k + 1) // w[s])      # released, and in time
        if t % 97 == 0 or len(w) < 10:
            assert all(abs(done[x] - (t + 1) * w[x]) < 1 for x in w)


def plain_schedule(units, blocks):
    """(slot, source, block, release, deadline), slot by slot over all released blocks."""
    left, out, begin = {s: n for s, n in blocks.items() if n}, [], 0
    while left:
        w = {s: Fraction(units[s], sum(units[x] for x in left)) for s in left}
        done, t = Counter(), 0
        while all(done[s] < left[s] for s in left):
            released = [s for s in left if done[s] / w[s] < t + 1]
            s = min(released, key=lambda s: (-(-(done[s] + 1) // w[s]), list(left).index(s)))
            out.append((begin + t, s, blocks[s] - left[s] + done[s], begin + done[s] // w[s], begin - (-(done[s] + 1) // w[s])))
            done[s] += 1
            t += 1
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
        begin += t
    return out


def test_the_schedule_against_a_slot_by_slot_version():
    rng = random.Random(2)
    cases = [({"a": 5, "b": 3, "c": 1}, {"a": 40, "b": 7, "c": 30}), ({"a": 1}, {"a": 0}), ({"a": 10 ** 20, "b": 1}, {"a": 9, "b": 3})]
    cases += [({s: rng.randint(1, 9) for s in "abcdef"}, {s: rng.randint(0, 30) for s in "abcdef"}) for _ in range(20)]
    for units, blocks in cases:
        got = [(int(t), s, k, int(r), int(d)) for s, x in mixing.schedule(units, blocks).items() for k, (t, r, d) in enumerate(x.tolist())]
        assert sorted(got) == sorted(plain_schedule(units, blocks))


def test_mix_is_a_permutation_close_to_its_targets(spark):
    rows = [(i, None, "big" if i % 3 else f"s{i % 4}") for i in range(3000)] + [(None, "x", None), (5, "again", "big"), (5, "again", "big")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS mix_slot", "'z' AS stream", "9 AS total", "4 AS k")
    for name in ("row", "order", "bucket", "number", "Slots", "chunk", "starts", "at", "their", "__number", "__stream"):
        docs = docs.withColumn(name, F.lit("kept"))
    targets = {"big": 0.4, "s0": 0.3, "s1": 0.2, "s2": 0.1}
    mixed = mixing.mix(docs, targets, block_rows=4)
    assert mixed.columns == [*[c for c in docs.columns if c != "mix_slot"], *mixing.OUTPUT]
    got = sorted(mixed.collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(len(rows))) and {r.number for r in got} == {"kept"}
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(a), str(c)) for a, _, c in rows)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    whole = sum(targets.values()) + 2 * 0.1 / 1024  # two sources have no target
    seen = Counter()
    for n, r in enumerate(got[:400], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - n * w / whole) < 2 * 4 for s, w in targets.items())


def test_mix_follows_the_plain_schedule(spark):
    rows = [(i, "t", None if i % 11 == 0 else f"s{i % 5 % 3}") for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_rows=8).collect()
    n = Counter(r[2] for r in rows)
    names = sorted(n, key=lambda s: (s is None, s))
    units = mixing.units_of({s: Fraction(math.isqrt(n[s] * 10 ** 12), 10 ** 6) for s in names})
    plan, start, want = plain_schedule(units, {s: -(-n[s] // 8) for s in names}), 0, Counter()
    for t, s, k, r, d in plan:
        size = min(8, n[s] - 8 * k)
        want.update((start + j, s, t, r, d) for j in range(size))
        start += size
    assert Counter((r.mix_position, r.source, r.mix_slot, r.mix_release, r.mix_deadline) for r in got) == want


def test_rows_without_ids_spread_over_tasks(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("hot").alias("source"))
    mixed = mixing.mix(docs)
    assert mixed.agg(F.count_distinct("mix_position"), F.min("mix_position"), F.max("mix_position")).first()[:] == (100_000, 0, 99_999)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(shiftrightunsigned" in plan  # a row's own number decides its bucket
    per_bucket = docs.select(F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.monotonically_increasing_id()), 8), F.lit(98)).alias("b")).groupBy("b").count()
    assert per_bucket.count() == 98 and per_bucket.agg(F.max("count")).first()[0] < 2 * 1024


def test_mix_edge_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.mix(docs).count() == 0 and mixing.mix(docs).columns == [*docs.columns, *mixing.OUTPUT]
    many = spark.createDataFrame([(i, "t", f"s{i % 300}") for i in range(900)], DOCS)
    got = mixing.mix(many)
    assert sorted(r.mix_position for r in got.select("mix_position").collect()) == list(range(900))
    assert got.filter(F.col("mix_slot") >= F.col("mix_deadline")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(many, {"s1": 0.0})
