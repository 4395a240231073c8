import math
import re

import numpy as np
import pytest

from termini.llm import html_text as H

SF = "/root/testdata/sf0.001"
LONG = "A long sentence of the article that says something worth reading, with commas and words. " * 3


def slow_smooth(ratio):
    out = []
    for k in range(len(ratio)):
        near = [(j, math.exp(-0.5 * ((j - k) / H.SIGMA) ** 2)) for j in range(len(ratio)) if abs(j - k) <= int(3 * H.SIGMA)]
        out.append(sum(ratio[j] * w for j, w in near) / sum(w for _, w in near))
    return out


def slow_cut(values):
    """The border of two clusters by trying all of two-means' steps on a plain list."""
    low, high = min(values), max(values)
    for _ in range(32):
        below, above = [v for v in values if v <= (low + high) / 2], [v for v in values if v > (low + high) / 2]
        if not below or not above:
            break
        low, high = sum(below) / len(below), sum(above) / len(above)
    return (low + high) / 2


def slow_main(lines, regions, content, rich):
    """The selection rule spelt out line by line, by walking each line's path."""

    def path(k):
        out = [k]
        while k:
            k = regions[k].parent
            out.append(k)
        return out

    paths = [path(x.region) for x in lines]
    held = lambda k, flags: sum(len(x.text) for x, p, f in zip(lines, paths, flags, strict=True) if f and k in p)
    out = {k for k, r in enumerate(regions) if k and r.furniture and not (r.by_word and r.anchor and held(k, content) > H.HALF * held(0, content))}
    free = [not out & set(p) for p in paths]
    if not any(c and f for c, f in zip(content, free, strict=True)):
        content = [True] * len(lines)
    flags = [c and f for c, f in zip(content, free, strict=True)]
    chief = 0
    while regions[chief].name not in ("article", "main"):
        down = [k for k, r in enumerate(regions) if k and r.parent == chief and held(k, flags) >= (H.HALF if r.name in ("article", "main") else H.CHIEF) * held(0, flags)]
        if not down:
            break
        chief = max(down, key=lambda k: held(k, flags))
    links = lambda k: sum(x.linked for x, p, f in zip(lines, paths, free, strict=True) if f and k in p)
    menus = {k for k in range(len(regions)) if k != chief and k and not held(k, rich) and links(k) > H.LINKS * held(k, free)}
    keep = [f and chief in p and not menus & set(p[: p.index(chief)]) for p, f in zip(paths, free, strict=True)]
    first = keep.index(True) if any(keep) else 0
    return [k or (n < first and lines[n].title and free[n]) for n, k in enumerate(keep)]


def test_smoothing_and_threshold_against_plain_sums():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 12, 13, 14, 60):
        ratio = draw.exponential(50, n)
        if n >= 13:
            assert H._smooth(ratio) == pytest.approx(slow_smooth(ratio.tolist()))
        assert H._threshold(H._smooth(ratio)) == pytest.approx(slow_cut(H._smooth(ratio).tolist()))


def test_selection_against_brute_force():
    draw = np.random.default_rng(4)
    names = ["div", "div", "section", "article", "ul", "main"]
    for _ in range(400):
        regions = [H.Region(0, "", False, False)]
        for k in range(1, int(draw.integers(2, 12))):
            by_word = bool(draw.random() < 0.15)
            regions.append(H.Region(int(draw.integers(0, k)), names[draw.integers(len(names))], by_word or bool(draw.random() < 0.1), by_word, bool(draw.random() < 0.2)))
        lines = []
        for _ in range(int(draw.integers(1, 25))):
            text = "x" * int(draw.integers(1, 200))
            lines.append(H.Line(text, 1, int(draw.integers(0, len(text) + 1)) if draw.random() < 0.4 else 0, int(draw.integers(0, len(regions))), bool(draw.random() < 0.1)))
        content, rich = draw.random(len(lines)) < 0.5, draw.random(len(lines)) < 0.3
        assert H.selected(lines, regions, content, rich).tolist() == slow_main(lines, regions, content.tolist(), rich.tolist())


def test_the_ratios_select_whatever_the_names_of_elements(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    inside = [re.search("(?s)<article>(.*)</article>", h)[1] for h in pages]
    same = 0
    for html, article in zip(pages, inside, strict=True):
        whole, alone = H.main_text(html), H.main_text(f"<div>{article}</div>")
        assert whole == alone == H.main_text(re.sub(r"<(/?)article>", r"<\1div>", html))
        same += whole == H.main_text(re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", html).replace('class="ad"', ""))
    assert same >= 0.9 * len(pages)  # no element and no word says what is furniture


def test_short_blocks_inside_the_main_text_stay():
    body = f"<h1>Title</h1><p>{LONG}</p><ul><li>one item<li>two</ul><blockquote>short</blockquote><table><tr><td>1<td>2</table><section id=related-work><h2>Related work</h2><p>{LONG}</p></section><p>{LONG}</p>"
    want = ["Title", LONG.strip(), "one item", "two", "short", "1", "2", "Related work", LONG.strip(), LONG.strip()]
    cards = "<aside><article><p>Teaser one</p></article></aside><div><a href=x>More of this</a></div>"
    for page in (f"<body><div class=has-sidebar>{body}</div>{cards}", f"<body><div class='sidebar layout'><div>{body}</div></div>{cards}", f"<body><nav>Home</nav><main>{body}</main><footer>c</footer>{cards}"):
        assert H.main_text(page).split("\n") == want
    assert H.main_text(f"<div><p>{LONG}</p><ul><li><a>Next</a><li><a>Previous</a></ul><div class=comments><p>{LONG * 9}</p></div><p>{LONG}</p></div>").split("\n") == [LONG.strip()] * 2
    assert H.main_text("<article><p>Be.</p></article><div class=ad>Buy this very good thing now, it is worth it.</div>") == "Be."
    assert H.main_text("<nav>only a menu</nav>") == "" and H.main_text("</p></div><b>x") == "x"


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, region string"
    rows = [(1, "u", "<p>a &amp; b</p>", "x", "y", "z"), (1, "u", "<p>a &amp; b</p>", "x", "y", "z"), (None, None, None, None, None, None), (2, "v", "", "x", "y", "z"), (3, "w", f"<div><p>{LONG * 4000}</p></div>", "x", "y", "z")]
    got = H.op4(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), str(r.url), r.text[:6], r.n_chars) for r in got) == [("1", "u", "a & b", 5), ("1", "u", "a & b", 5), ("2", "v", "", 0), ("3", "w", "A long", len((LONG * 4000).strip())), ("None", "None", "", 0)]
    assert H.op4(spark.createDataFrame([], schema)).count() == 0
