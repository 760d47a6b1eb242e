import pytest

from mapquarry.llm import html_text

P = "This is a paragraph of the article and it has many words that are in the list of stop words for a test."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        (f"<article><h1>Title</h1><p>{P}<p>Short.</article>", f"Title\n{P}\nShort."),
        (f"<article><p>{P}</p><div class='ad'>Buy the best of it now and for ever</div><p>End</p></article>", f"{P}\nEnd"),
        (f"<header><h1>Site</h1></header><main><p>{P}</p></main><aside><p>{P}</p></aside><footer>c</footer>", P),
        (f"<article><p>{P}</p><section id='comments'><p>{P} Nice.</p></section></article>", P),
        (f"<article><p>{P}</p></article><article class='comment'><p>{P} I agree.</p></article>", P),
        ("<article><p>A &amp; B&nbsp;&lt;tag&gt; &copy; &#233;\n\t x</p></article>", "A & B <tag> © é x"),
        (f"<article><script>var t='</p><p>{P}</p>';</script><style>p{{}}</style><p>{P}</p><form><label>Name of the user</label></form></article>", P),
        (f"<article><p><b>{P}<br><p>{P} Two.</article>", f"{P}\n{P} Two."),
        (f"<article><p>line one<br>line two<br/><br/>line three</p><p>{P}</p></article>", f"line one line two\nline three\n{P}"),
        (f"<article><p>### %%% *** $$$ ### &&& ||| ### %%% *** $$$</p><p>{P}</p></article>", f"### %%% *** $$$ ### &&& ||| ### %%% *** $$$\n{P}"),
        (f"<div class='menu'><li><a>x</a></li></div><div><h2>Head</h2><p>{P}</p><p>Tiny bit.</p><p>{P}</p></div><div>Copyright</div>", f"Head\n{P}\nTiny bit.\n{P}\nCopyright"),
        (f"<article><p>{P}</p><!-- <p>{P}</p> --><p hidden>{P}</p><p>2 < 3 and 5 > 4</p></article>", f"{P}\n2 < 3 and 5 > 4"),
        (f"<article><p title=\"a > b\">{P}</p><p>cut off <b", f"{P}\ncut off"),
        (f"<div id='cookie-notice'>{P}</div><article><div class='share-buttons'>Share it</div><blockquote>{P}</blockquote></article>", P),
        (f"<div class='content with-sidebar'><article><p>{P}</p></article></div>", P),
        (f"<div class='layout-no-sidebar'><article><p>{P}</p></article></div>", P),
        (f"<article class='post comments-open share-enabled'><p>{P}</p></article>", P),
        (f"<form id='aspnetForm'><div class='menu'><a href=x>Home</a></div><div><p>{P}</p><p>{P}</p></div></form>", f"{P}\n{P}"),
        (f"<div class='header-wrapper widget-area'><article><p>{P}</p></article></div>", P),
        (f"<div><p>{P}</p></div><form class='search'><p>Type what you are looking for in the box and press the button for it</p></form>", P),
        (f"<article><p>{P}</p></article><div class='comments'><article><p>{P} {P} {P} {P}</p></article></div>", P),
        (f"<div id='comments' class='comments-area'><p>{P}</p></div>", ""),
        ("<body><ul><li><a href=a>ホーム</a></li></ul><div><p>今日は天気がとても良いので、家族と一緒に公園を散歩しました。桜の花が咲いていて、とても綺麗でした。</p></div><footer>著作権</footer></body>", "今日は天気がとても良いので、家族と一緒に公園を散歩しました。桜の花が咲いていて、とても綺麗でした。"),
        ("<body><div><p>Dnes je velmi hezky, proto jsme se rodinou prochazeli parkem kolem reky a mostu.</p></div><div><a href=x>Domu</a> <a href=y>Kontakt</a></div></body>", "Dnes je velmi hezky, proto jsme se rodinou prochazeli parkem kolem reky a mostu."),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_table(spark):
    rows = [(1, "u", f"<article><p>é {P}</p></article>", "x"), (None, None, None, "x"), (1, "u", "", "x"), (2**60 + 1, "v", "<p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(html_text.extract(df).collect(), key=str)
    assert {(r.page_id, r.n_chars) for r in got} == {(1, len(P) + 2), (None, 0), (1, 0), (2**60 + 1, 0)} and len(got) == 4
    assert html_text.extract(df.where("false")).count() == 0


def test_long_page():
    n = 20_000
    page = "<article>" + "<div>" * 300 + "".join(f"<p>word {k} of the text</p>" for k in range(n))
    assert html_text.main_text(page).count("\n") == n - 1
