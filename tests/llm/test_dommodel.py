"""Tree model: exact marginals against enumeration; text against the pages' own structure."""

import html
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import dommodel
from ctxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def article(page):
    """Of the generated pages: the article's blocks."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
    return " ".join(re.sub("</?b>", "", x) for x in blocks if x)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op6_dom_model"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_held_out_pages_without_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pot = dommodel.train(pages.where("page_id % 2 = 0"))
    held = [r["html"] for r in pages.where("page_id % 2 = 1").collect()]
    bare = [re.sub(r"<(/?)(article|nav|footer)", r"<\1div", p).replace(' class="ad"', "") for p in held]
    right = sum(dommodel.main_text(b, pot) == article(p) for p, b in zip(held, bare, strict=True))
    assert right >= 0.9 * len(held)


def test_marginals_are_exact():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n = 8
        nodes = [dommodel.Node(-1 if k == 0 else int(rng.integers(0, k)), (f"n{k}",)) for k in range(n)]
        pot = dommodel.Potentials({f"name:n{k}": float(rng.normal()) for k in range(n)}, np.log(rng.dirichlet([1, 1], 2)).tolist())
        weight, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(y[k] * pot.trait[f"name:n{k}"] for k in range(n)) + sum(pot.pair[y[x.parent]][y[k]] for k, x in enumerate(nodes) if k))
            weight += w
            ones += w * np.array(y)
        assert dommodel.marginals(nodes, pot) == pytest.approx((ones / weight).tolist())


POT = dommodel.estimate({})


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<", ""), ("<!-- cut", ""),
    ("<main>Good <a href='x>y'>li&eacute;</a> 1 < 2 &amp b<p>two<br>three\n four<script>var a='</p>'</script></main><footer>no</footer>", "Good lié 1 < 2 & b two three four"),
    ("<article><p>a<ul><li>b<li>c</ul><aside>no</aside><div class='comments'><p>no</div>d</article>", "a b c d"),
    ("<nav><a href=/>no</a></nav><article><b>bo</b>ld<p", "bold"),
    ("<header>no</header><main><table><tr><td>x<td>y</table></main><form>no</form>", "x y"),
    ("<article><p title=\"cut>text here", "text here"),
    ("</div></p><article>ok</section></article>", "ok"),
    ("<article>" + "<div>" * 20_000 + "deep", "deep"),
])
def test_markup(page, text):
    assert dommodel.main_text(page, POT) == text


def test_edge_rows(spark):
    rows = [(1, "u", None), (None, None, "<article>x &lt; y</article>"), (1, "u", "<article>" + "word " * 200_000 + "</article>"), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = sorted(((r["page_id"], r["n_chars"]) for r in dommodel.extract(pages, dommodel.train(pages)).collect()), key=repr)
    assert got == sorted([(1, 0), (None, 5), (1, 999_999), (2, 0)], key=repr)
    assert dommodel.extract(pages.limit(0), dommodel.train(pages.limit(0))).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ("<form><input list=s><datalist id=s><option value=a><option value=b></datalist></form><article>all of it</article>", "all of it"),
    ("<nav><button>no</nav><article>all <p>of it</article>", "all of it"),
    ("<object data=x><article>a<button>no</button><select><option>no<option>no</select> b", "a b"),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></math> be</p><canvas>shown</canvas><video src=v>words</video></article>", "let x=2 be shown words"),
    ("<article><svg viewBox='0'><title>no</title><path d=x /><g/></svg><p>rest</article>", "rest"),
    ('<article><p>H<span class="low">2</span>O <span class="ad">buy</span> is <a class="sponsored" href=x>here</a> wet.</p></article>', "H2O is wet."),
    ('<article><p>a <a href="/?id=ad">link</a> <span class="x"><div>in</div> it</span> out', "a link in it out"),
    ("<article>" + '<span class="x">' * 20_000 + "deep", "deep"),
])
def test_nothing_is_lost_behind_unclosed_controls_and_inline_names_tell(page, text):
    assert dommodel.main_text(page, POT) == text


@pytest.mark.parametrize("pad", [0, 5_000])
@pytest.mark.parametrize("tag", ["script", "SCRIPT", "ScRipt"])
def test_raw_elements_end_where_they_end_whatever_the_length_of_the_page(pad, tag):
    page = "<article><p>" + "\u0130" * 12 + f"</p><script>x</{tag}>kept text here<p>more</p>" + " " * pad + "</article>"
    assert dommodel.main_text(page, POT) == "\u0130" * 12 + " kept text here more"
    assert dommodel.main_text(f"<article>a<script>x</\u017fcript>y</{tag}>b" + " " * pad, POT) == "ab"


@pytest.mark.parametrize("gap", [0, 1, 150, 250, 10_000])
def test_white_space_before_a_quoted_value_may_be_long(gap):
    page = f"<article><p title={' ' * gap}'a>b'>text</p><p {' ' * gap}>more</article>"
    assert dommodel.main_text(page, POT) == "text more"
