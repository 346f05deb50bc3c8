from pyspark.sql import functions as F

from riskloom.functions import html
from riskloom.sources.articles import clean_pages

LONG = "正文" * 60
PAGE = f"""<html><head><title>站点 &amp; 首页</title><style>p{{}}</style><script>var x="<h1>假</h1>";</script></head>
<body><!-- <p>2019-01-01</p> --><nav><h1> </h1><p>导航导航导航导航导航导航</p></nav><div class="ad">发布 2024年3月7日 <p>广告位招租广告位招租</p></div>
<article><h1>标 <b>题</b></h1><p>{LONG}<p><b>第二段 &lt;有&gt; 十个字以上的内容</b> 尾<div><p>嵌套的段落也要算在正文里面</p></div></article>
<p>页脚外的段落不属于正文容器</p><footer><p>版权所有版权所有版权所有版权所有</p></footer></body></html>"""


def test_title_date(one):
    assert one(html.page_title, PAGE) == "站点 & 首页"  # the first h1 is blank
    assert one(html.page_title, "<h1>标 <b>题</b></h1>") == "标题"
    assert one(html.page_date, PAGE) == "2024-03-07"
    assert one(html.page_date, "<p>2024.13.99</p>") == "2024-13-99"
    assert one(html.page_date, "<p>" + "字" * 2000 + "2024-01-01</p>") is None


def test_entities_decode_once(one):
    assert one(html.decode_entities, "&amp;lt; &lt; &#65;&#x4e2d; &bogus; & &middot;") == "&lt; < A中 &bogus; & ·"


def test_main_text(spark):
    out = clean_pages(spark.createDataFrame([(1, PAGE)], "id int, html string")).first()
    assert out["text"] == f"{LONG}\n第二段 <有> 十个字以上的内容 尾\n嵌套的段落也要算在正文里面"


def test_container_choice(one):
    def pick(page):
        return html.main_container(html.blocks(page))

    tie = "<div><p>一二三四五</p></div><section><p>六七八九十</p></section>"
    assert one(pick, tie)["start"] == 1  # the earlier one wins
    # text inside an inner container does not count for the outer one
    got = one(pick, "<div><p>一</p><div><p>二三</p></div><p>四五六</p></div>")
    assert (got["len"], got["start"]) == (4, 1)
    assert one(pick, "<p>没有容器</p>") is None
    assert one(pick, "<div>没有段落</div>") is None


def test_short_container_means_whole_page(spark):
    page = "<div><p>容器里的一个短段落，有十几个字</p></div><p>容器外的另一个段落，也有十几个字</p>"
    pages = spark.createDataFrame([(page, " \n"), (page, " 别的提取器 "), ("<div>没有段落<br>只有文字</div>", None)], "html string, other string")
    rows = [r["text"] for r in clean_pages(pages, main_text="other").select("text").collect()]
    assert rows[0] == "容器里的一个短段落，有十几个字\n容器外的另一个段落，也有十几个字"
    assert rows[1] == "别的提取器"
    assert rows[2] == "没有段落\n只有文字"


def test_unclosed_markup_is_harmless(spark):
    page = "<div>" * 500 + "<p>字" * 500 + "<" + "</div>" * 900
    assert clean_pages(spark.createDataFrame([(page,)], "html string")).select(F.length("text")).first()[0] > 0


def test_control_character_is_no_cut(spark):
    page = "<div><p>甲乙丙丁戊己\u0001庚辛壬癸子丑寅卯</p></div>"
    assert clean_pages(spark.createDataFrame([(page,)], "html string")).first()["text"] == "甲乙丙丁戊己庚辛壬癸子丑寅卯"
