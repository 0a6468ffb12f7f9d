from lucidframe.llm import html_extract

NOTICE = "<div>Prices on this page are given without any warranty at all</div>"


def texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def story(i):
    return f"Story {i} tells of things that happened {i} days ago in town {i}"


def test_section_menus_of_a_large_host_go(spark):
    rows = []
    for i in range(600):  # twelve sections of 50 pages, each with a menu of its own
        menu = " ".join(f"topic{i % 12}x{k}" for k in range(9))
        rows.append((i, f"http://big/{i}", f"<div>{menu}</div><p>{story(i)}</p>"))
    assert texts(spark, rows) == {i: story(i) for i in range(600)}


def test_articles_of_the_host_do_not_protect_boilerplate(spark):
    rows = [(i, f"http://h/{i}", f"{NOTICE}<p>{story(i)}</p>") for i in range(10)]
    rows += [(i, f"http://h/{i}", f"<nav>Home of {i}</nav><article>{story(i)}</article>") for i in range(10, 100)]
    assert texts(spark, rows) == {i: story(i) for i in range(100)}


def test_a_story_on_two_pages_stays_whatever_the_host_size(spark):
    copied = "The very same story with many words was told on two of the pages here"
    for n in (3, 10, 11, 40):
        rows = [(i, f"http://h/{i}", f"{NOTICE}<p>{copied if i < 2 else story(i)}</p><p>number {i}</p>") for i in range(n)]
        assert texts(spark, rows) == {i: f"{copied if i < 2 else story(i)} number {i}" for i in range(n)}


def test_a_passage_that_stories_share_in_different_places_stays(spark):
    shared = "A saying of seven or more words that many stories of this host quote"
    want = {}
    for i in range(200):
        parts = [f"Part {k} of story {i} was told on day {i}x{k} here" for k in range(7)]
        if i < 28:
            parts.insert(i % 7, shared)
            parts += [f"Then part {k} of story {i} came {i}y{k}" for k in range(i // 7)]
        want[i] = " ".join(parts), "".join(f"<p>{p}</p>" for p in parts)
    assert texts(spark, [(i, f"http://h/{i}", h + NOTICE) for i, (_, h) in want.items()]) == {i: t for i, (t, _) in want.items()}


def test_a_head_without_an_end():
    page = "<html><head><meta charset=utf-8><title>T</title><style>p{}</style><script>x</script>"
    for rest in ("<body><p>one</p><div>two</div></body>", "<p>one</p><div>two</div>", "one<div>two</div>", "<body><xmp>x</xmp><p>one</p>two"):
        assert html_extract.blocks(page + rest) == [("plain", "one"), ("plain", "two")]
    assert html_extract.blocks("<head><template><p>no</p></template> <link rel=x></head><body>yes") == [("plain", "yes")]


def test_a_story_beside_an_article_teaser(spark):
    tease = "<article>Read this next about the old town and its people</article>"
    long = [" ".join(f"{w}{i}" for w in ("long", "story", "told", "here", "with", "many", "words", "and", "more", "of", "them", "still")) * 5 for i in range(6)]
    rows = [(i, f"http://h/{i}", f"<div>{tease}</div><div>{long[i]}</div>{NOTICE}") for i in range(6)] + [(9, "http://one/", f"<p>{long[0]}</p>{tease}")]
    want = {i: long[i] for i in range(6)} | {9: f"{long[0]} Read this next about the old town and its people"}
    assert texts(spark, rows) == want
