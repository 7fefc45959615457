import pytest

from weftline.llm import html as H


def test_held_out_pages_are_extracted_whole():
    model = H.trained_model()
    pages = list(H.labelled_pages(150, seed=77))
    exact = sum(H.main_text(p, model) == "\n".join(" ".join(c.split()) for c in content) for p, content in pages)
    assert exact >= 140


def test_viterbi_equals_brute_force():
    import itertools

    model = H.trained_model()
    for page, _ in H.labelled_pages(12, seed=5):
        rows = H.features(H.blocks_of(page))[:9]
        e = model.scores(rows)
        best = max(itertools.product((0, 1), repeat=len(rows)), key=lambda y: sum(e[i, c] for i, c in enumerate(y)) + sum(model.t[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(model.decode(rows)) == best


def test_blocks():
    text = lambda h: [b[0] for b in H.blocks_of(h)]
    assert text(None) == text("") == text("<p>   </p>") == []
    assert text("<p>a&amp;b &lt;c&gt; &#233;&nbsp;d\n e</p>") == ["a&b <c> é d e"]
    assert text("<p>one<p>two<br>three<li>x<li>y") == ["one", "two three", "x", "y"]
    assert text("a<script>var t='</p>';</script><style>p{}</style>b<!-- c -->d") == ["abd"]
    assert text("<p><b>bold<br><p>next</article></div></p>after") == ["bold", "next", "after"]
    assert text("<td>1<td>2</tr>") == ["1", "2"]
    assert text("1 < 2 & 3 &am") == ["1 < 2 & 3 &am"]


def test_table(spark):
    page = "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>Title here</h1><p>First   words of it.</p><p>Second &amp; last words.</p></article><footer>&copy; x &middot; all of it</footer></body></html>"
    want = "Title here\nFirst words of it.\nSecond & last words."
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, None), (3, "v", "", ""), (None, "w", "<article><p>" + "long words here. " * 40_000 + "</p></article>", "")]
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == want and by[1].n_chars == len(want)
    assert by[2].text == by[3].text == "" and by[None].n_chars > 600_000
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_head_without_end_tag():
    text = lambda h: [b[0] for b in H.blocks_of(h)]
    for page in ("<html><head><title>x</title><body><article><p>text", "<head><title>x</title><article><p>text", "<head><meta charset=utf-8><link rel=a><style>p{}</style><p>text", "<head><script>a</script>text", "<head><title>x</title><noscript><img src=a></noscript></head><body>text", "<head><template><p>no</p></template><body>text"):
        assert text(page) == ["text"], page


def test_digits_of_a_whole_block():
    digits = lambda x: H._feature("digits=True") in H.features([(x, frozenset(), "p", 0)])[0]
    assert digits("a" * 200 + "1" * 400) and not digits("1" * 200 + "a" * 4000)


FIRST = "The quick brown fox jumps over the lazy dog while a second clause keeps the sentence going, and it ends here. Another sentence follows it."
SECOND = "A further paragraph tells more about the same thing, with commas, numbers such as 42, and a proper end. It has two sentences as well."


def test_layouts_without_telling_names():
    model, both = H.trained_model(), f"<p>{FIRST}</p><p>{SECOND}</p>"
    said = "<p>Nice post, thanks a lot for it.</p><p>I do not agree with this at all, sorry.</p>"
    menu = '<a href="/">Home</a><br><a href="/n">News</a><br><a href="/c">Contact us</a>'
    pages = [f'<html><body><div class="c1">{both}</div></body></html>', f'<div class="zq7"><div class="k"><div>{both}</div></div></div>', f'<article>{both}<section class="comments">{said}</section></article>', f"<table><tr><td>{menu}</td><td>{both}</td></tr></table>"]
    for page in pages:
        assert H.main_text(page, model) == f"{FIRST}\n{SECOND}"
    assert H.main_text(f"{FIRST}\n {SECOND}", model) == f"{FIRST} {SECOND}"


def test_depth_costs_linear_time():
    import time

    seconds = []
    for n in (4_000, 32_000):
        began = time.process_time()
        assert len(H.blocks_of("<div>" * n + "x" + "</div>" * n)) == 1
        H.blocks_of("<p><b>" * n + "x")
        seconds.append(time.process_time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.02)


def test_scores_summed_by_element_equal_those_of_whole_feature_lists():
    model = H.trained_model()
    for page, _ in H.labelled_pages(40, seed=9):
        blocks = H.blocks_of(page)
        assert model.decode_blocks(blocks) == model.decode(H.features(blocks))


def test_features_of_ancestors_count_once():
    (block,) = H.blocks_of('<div class="one"><section><div class="one two"><p>x')
    want = {H._feature(x) for x in ("t=div", "c=one", "t=section", "c=two", "t=p")}
    assert sorted(block.own) == sorted(want)
    first, second = H.blocks_of('<div class="one"><p>x</p></div><div class="two"><p>y</p></div>')
    assert H._feature("c=one") in first.own and H._feature("c=one") not in second.own


def test_depth_of_distinct_classes_costs_linear_time():
    import time

    model, seconds = H.trained_model(), []
    for n in (4_000, 32_000):
        page = "".join(f'<div class="{"".join(chr(97 + int(d)) for d in f"{i:05d}")}">' for i in range(n)) + "x" + "</div>" * n + "y"
        began = time.process_time()
        H.main_text(page, model)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.02)


NEWS = ["The committee met on Tuesday to discuss the new bridge over the river, which has been closed since March.", "Engineers said that repairs would take at least two years, and that costs may rise further.", "Local shops fear for their trade. Many have asked the council for help.", "A second crossing is planned, but no date has been set for it so far."]
CHINESE = ["昨天下午,市政府在会议中心宣布了新的交通规划,预计将在未来五年内逐步实施,涉及多条主要道路。", "专家认为,这项规划能够有效缓解城市拥堵问题,但也需要更多的资金支持和公众参与。", "居民对此看法不一,有人支持,也有人担心施工期间的出行不便。"]
ARABIC = ["أعلنت الحكومة يوم الثلاثاء عن خطة جديدة لتطوير شبكة النقل العام في المدن الكبرى خلال السنوات المقبلة.", "وقال الخبراء إن المشروع سيحتاج إلى تمويل كبير وإلى مشاركة القطاع الخاص."]
RUSSIAN = ["Правительство объявило во вторник о новом плане развития общественного транспорта в крупных городах страны.", "По словам экспертов, проект потребует значительных средств и участия частных компаний."]
JAPANESE = ["政府は火曜日、今後五年間で大都市の公共交通網を整備する新しい計画を発表した。", "専門家によると、この計画には多額の資金と民間企業の参加が必要だという。"]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 Some Paper. All rights reserved.</footer>"


def _all(texts, tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>" for x in texts)


#: name: (body, content). Real sentences; glossaries, figures, questions, columns and postback forms are in no training page.
LAYOUTS = {
    "paragraphs are div": (f"{NAV}<div id=x1>{_all(NEWS, 'div')}</div>{FOOT}", NEWS),
    "nothing but div": (f"<div id=x1>{_all(NEWS, 'div')}</div>", NEWS),
    "reply thread": (f'{NAV}<div class=post><h1>Bridge closed</h1>{_all(NEWS)}</div><div class="replies"><div><b>Ann</b><p>I cross it every day, this is bad news.</p></div><div><b>Bob</b><p>Told you so!</p></div></div>{FOOT}', ["Bridge closed", *NEWS]),
    "Chinese": (f'<div class="menu"><a href="/">首页</a><a href="/n">新闻</a></div><div class="a">{_all(CHINESE)}</div><div class="footer">版权所有 2020</div>', CHINESE),
    "Chinese alone": (f'<div class="a">{_all(CHINESE)}</div>', CHINESE),
    "Arabic": (f'{NAV}<div class="q"><div class="w">{_all(ARABIC)}</div></div>{FOOT}', ARABIC),
    "Russian in div": (f'{NAV}<div class="q7">{_all(RUSSIAN, "div")}</div>{FOOT}', RUSSIAN),
    "Japanese": (f"{NAV}<main>{_all(JAPANESE)}</main>{FOOT}", JAPANESE),
    "code and list at the end": (f"{NAV}<article><h1>How to build</h1>{_all(NEWS[:2])}<pre>make all\nmake install</pre><ol><li>Fetch the sources</li><li>Unpack them</li><li>Run make</li></ol></article>{FOOT}", ["How to build", *NEWS[:2], "make all make install", "Fetch the sources", "Unpack them", "Run make"]),
    "notice without a name": (f'<div class="x9"><p>We use cookies to improve your experience. By using this site you accept our privacy policy.</p><button>OK</button></div>{NAV}<article><h1>Bridge closed</h1>{_all(NEWS)}</article>{FOOT}', ["Bridge closed", *NEWS]),
    "glossary": (f"{NAV}<article><h1>Glossary</h1><p>{NEWS[0]}</p><dl><dt>Span</dt><dd>The part of a bridge between two supports.</dd><dt>Pier</dt><dd>A support in the water, made of stone or steel.</dd></dl></article>{FOOT}", ["Glossary", NEWS[0], "Span", "The part of a bridge between two supports.", "Pier", "A support in the water, made of stone or steel."]),
    "figure": (f"{NAV}<article><h1>Bridge</h1><p>{NEWS[0]}</p><figure><img src=a><figcaption>The old bridge in March.</figcaption></figure><p>{NEWS[1]}</p></article>{FOOT}", ["Bridge", NEWS[0], "The old bridge in March.", NEWS[1]]),
    "columns": (f'<div class="row"><div class="col-3"><ul><li><a href=/a>Sports</a></li><li><a href=/b>Culture</a></li></ul></div><div class="col-9"><h2>Bridge</h2>{_all(NEWS)}</div></div>{FOOT}', ["Bridge", *NEWS]),
    "questions": (f"{NAV}<main><h1>Questions</h1><details><summary>When does it open?</summary><p>{NEWS[3]}</p></details><details><summary>Who pays?</summary><p>{NEWS[1]}</p></details></main>{FOOT}", ["Questions", "When does it open?", NEWS[3], "Who pays?", NEWS[1]]),
    "newsletter inside": (f'{NAV}<article><h1>Bridge</h1>{_all(NEWS[:2])}<div class="k3"><p>Subscribe to our newsletter and never miss a story.</p><form><input type=email><button>Go</button></form></div>{_all(NEWS[2:])}</article>{FOOT}', ["Bridge", *NEWS]),
    "page in a form": (f'<form id=aspnetForm method=post><input type=hidden name=v>{NAV}<div class=mid><h1>Bridge</h1>{_all(NEWS)}</div>{FOOT}</form>', ["Bridge", *NEWS]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_pages_written_by_hand(name):
    body, content = LAYOUTS[name]
    assert H.main_text(f"<html><body>{body}</body></html>", H.trained_model()) == "\n".join(content)


def test_a_line_of_a_footer_stays_in_an_article():
    content = [NEWS[0], "All rights reserved.", NEWS[1], "Accept cookies to continue."]
    assert H.main_text(f"{NAV}<article>{_all(content)}</article>{FOOT}", H.trained_model()) == "\n".join(content)
