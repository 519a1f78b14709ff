import html
import re
import time

import numpy as np

from codeloom.llm import html_extract as hx
from codeloom.sources.tables import table


def article(page):
    """The given pages keep their text in headings and paragraphs of one article."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    found = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in found if b)


def test_given_pages_are_extracted_whole(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in hx.extract_main_text(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def errors(model, pages):
    """Wrong labels by the whole way through an extractor, and all labels."""
    extractor, wrong, total = hx.Extractor(model), 0, 0
    for chain, labels in pages:
        root, copies = extractor.root(), []
        for b in chain:  # pages are composed below roots of their own
            steps, at = [], b.path
            while at.parent is not None:
                steps.append(at)
                at = at.parent
            path = root
            for s in reversed(steps):
                path = path.child(s.tag, s.attributes)
            copies.append(b._replace(path=path))
        scores = extractor.scores(copies)
        slow = [hx.summed(model, ["bias", *hx.path_features(b.path), *f]) for b, f in zip(chain, hx.chain_features(chain), strict=True)]
        assert np.allclose(scores, slow) or not chain
        wrong += sum(a != b for a, b in zip(hx.decode(scores, model), labels, strict=True))
        total += len(labels)
    return wrong, total


def test_held_out_layouts():
    model = hx.default_model()
    wrong, total = errors(model, hx.labelled_pages(150, 77))
    assert wrong < 0.01 * total
    wrong, total = errors(model, hx.labelled_pages(150, 78, plain=1.0))
    assert wrong < 0.04 * total


def test_layouts_with_names_never_seen():
    half = lambda k: ({part: names[k::2] for part, names in hx.PART_NAMES.items()}, hx.MAIN_NAMES[k::2])
    model = hx.train(hx.labelled_pages(600, 5, *half(0)))
    wrong, total = errors(model, hx.labelled_pages(200, 99, *half(1)))
    assert wrong < 0.08 * total, (wrong, total)


def test_plain_divisions_give_their_text():
    extractor = hx.Extractor(hx.default_model())
    first, second = "This is the first paragraph of the text, and it says something.", "The second paragraph goes on for a while, too."
    assert extractor.main_text(f'<div class="x2"><h1>A title</h1><div>{first}</div><div>{second}</div></div>') == f"A title\n\n{first}\n\n{second}"
    menu = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(6))
    assert extractor.main_text(f'<div class="q7">{menu}</div><div class="x2"><h1>A title</h1><div>{first}</div><div>{second}</div></div>') == f"A title\n\n{first}\n\n{second}"


def test_hostile_pages_are_read_in_one_pass():
    extractor = hx.Extractor(hx.default_model())
    for page in ('<a "' * 250_000, "<div>x" * 200_000, "<a <" * 200_000 + 'x=">"', "<div></div>" * 100_000, "".join(f"<div class=c{i}>x" for i in range(50_000)), "<b>" * 100_000 + "<h1>y</h1>" * 50_000, "<script" * 100_000, "<!--" * 100_000, "<a x='" * 100_001 + ">", "</b>" * 200_000, "&" * 1_000_000):
        began = time.time()
        extractor.main_text(page)
        assert time.time() - began < 20, page[:12]
    deep = hx.blocks("<div>x" * 2_000 + "</div>" * 2_000 + "<p>y")
    assert len(deep) == 2_001 and hx.path_features(deep[-1].path) == ["0:p", "p"]


def test_viterbi_is_the_best_of_all_chains():
    pick = np.random.default_rng(3)
    model = hx.Model({}, np.zeros((0, 2)), pick.normal(size=(2, 2)), pick.normal(size=2))
    scores = list(pick.normal(size=(7, 2)))
    value = lambda y: model.first[y[0]] + sum(s[k] for s, k in zip(scores, y, strict=True)) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False))
    every = [[n >> i & 1 for i in range(7)] for n in range(128)]
    assert hx.decode(scores, model) == max(every, key=value)


def test_blocks_of_awkward_markup():
    texts = lambda p: [b.text for b in hx.blocks(p)]
    assert texts("<p>a &lt;b&gt;&nbsp; c<br>d<p>e<script>x<p>y</script>f<style>z") == ["a <b> c d", "ef"]
    assert texts("a < b <!-- <p>no --> c") == ["a < b c"]
    assert texts('<div title="a > b">x</div><div title="open>y</div>') == ["x", "y"]
    assert texts("") == [] and texts("</p></b>x") == ["x"]
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]


def test_awkward_rows(spark):
    long = "<article>" + "<p>word </p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", long, 1), (3, "u", long, 1), (None, "u", "<nav>x", 1)]
    got = hx.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 0, 20_000 * 6 - 2, 20_000 * 6 - 2]
    assert hx.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
