"""Pages without or with several article elements, and links in them."""

from jointedge.llm.html_extract import blocks, main_text

STORY = "".join(f"<p>Long sentence number {i}, which goes on and on, as content does.</p>" for i in range(6))


def test_links_in_an_article_stay():
    page = f"<body><article><h1><a href=1>Title</a></h1>{STORY}<ul><li><a href=2>Source one</a></li></ul></article></body>"
    text = main_text(page)
    assert text.startswith("Title\n\n") and text.endswith("Source one") and text.count("Long sentence") == 6


def test_pages_with_no_or_several_articles():
    links = "<div><a href=1>Home</a> <a href=2>About</a></div>"
    two = main_text(f"<body>{links}<article><h2>First</h2>{STORY}</article><article><h2>Second</h2>{STORY}</article></body>")
    assert two.count("Long sentence") == 12 and "Second" in two and "Home" not in two
    outside = main_text(f"<body>{links}<article><p>Teaser.</p></article><div>{STORY}</div></body>")
    assert outside.count("Long sentence") == 6 and "Teaser." in outside and "Home" not in outside
    assert main_text(f"<body>{links}<div>{STORY}</div></body>").count("Long sentence") == 6


def test_link_text_is_counted_decoded():
    assert blocks("<p><a>&lt;&amp;&gt;</a> bc</p>")[0][0][:3:2] == ("<&> bc", 3)


def test_noise_wins_over_content_words_and_teasers_go():
    thread = '<div class="post-comments"><p>Nice one, thanks, really.</p></div><div class="comment-body"><p>So true, all of it, yes.</p></div><div id="main-nav"><p>News, sport, more of it.</p></div>'
    for page in (f"<body><div class=wrap>{STORY}{thread}</div></body>", f"<body><article>{STORY}{thread}</article></body>", f"<body><article>{STORY}<article class=comment><p>Reader, here, with some words.</p></article></article></body>"):
        text = main_text(page)
        assert text.count("Long sentence") == 6 and not any(w in text for w in ("thanks", "true", "News", "Reader"))
    assert main_text(f'<body><div class="content has-sidebar">{STORY}</div></body>').count("Long sentence") == 6
    teaser = main_text(f"<body><article><h1>Title</h1>{STORY}</article><article><p><a href=1>Other story</a> in short.</p></article></body>")
    assert teaser.startswith("Title") and teaser.count("Long sentence") == 6 and "Other" not in teaser


LONG = "A story, told at length, goes on. And on, of course; there is more of it. " * 3


def test_misleading_names_keep_their_text():
    assert main_text(f"<article><h1>Title</h1><div class='legal-news'><p>{LONG}</p><p>{LONG}</p></div></article>").count("A story") == 6
    assert main_text(f"<main><div class='notice-board'><p>{LONG}</p></div></main>").count("A story") == 3
    assert "The share rose" in main_text(f"<article><p>{LONG}</p><div class='share-price'>The share rose by 3.5, to 20.1, at noon.</div></article>")
    for page in (f"<body><div class='sidebar'><p>{LONG}</p><p>{LONG}</p></div><p>Tiny.</p></body>", f"<article><h1>T</h1><div class='content-widget'><p>{LONG}</p><p>{LONG}</p></div></article>"):
        assert main_text(page).count("A story") == 6  # what holds nearly all of the page is the story
    half = main_text(f"<body><div id=story><p>{LONG}</p><p>{LONG}</p></div><div class='promo-box'><p>{LONG}</p></div></body>")
    assert half.count("A story") == 6


def test_the_score_decides_on_marked_pages_too(monkeypatch):
    """A list of links in the article, names of noise, and what stands beside an article: without the scores the result is another."""
    from jointedge.llm import html_extract

    links = "".join(f"<li><a href={i}>Tag {i}</a></li>" for i in range(5))
    page = f"<body><div><p>{LONG}</p></div><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul><div class='share'>Share this</div></article></body>"
    text = main_text(page)
    assert text.startswith("A story") and text.count("A story") == 12 and "Tag" not in text and "Share" not in text
    real = html_extract.path_scores
    monkeypatch.setattr(html_extract, "path_scores", lambda found: dict.fromkeys(real(found), 1.0))
    assert main_text(page) != text and "Tag 3" in main_text(page)
    monkeypatch.setattr(html_extract, "path_scores", lambda found: dict.fromkeys(real(found), 0.0))
    assert main_text(page) != text


def test_comments_in_an_article_go_though_they_read_like_it():
    page = f"<article><p>{LONG}</p><p>{LONG}</p><section class='comments'><p>{LONG.replace('story', 'reply')}</p></section></article>"
    assert main_text(page).count("A story") == 6 and "reply" not in main_text(page)


def brute_paths(blocks_, threshold=0.3):
    """Path scores by their definition, over lists: the mean size and punctuation of a path, smoothed over its neighbours, less links."""
    order = list(dict.fromkeys(b[1] for b in blocks_))
    mine = {p: [b for b in blocks_ if b[1] == p] for p in order}
    size = {p: sum(len(b[0]) for b in mine[p]) / len(mine[p]) for p in order}
    points = {p: sum(sum(c in ".,;:!?" for c in b[0]) for b in mine[p]) / len(mine[p]) for p in order}
    unlinked = {p: 1 - sum(b[2] for b in mine[p]) / sum(len(b[0]) for b in mine[p]) for p in order}
    score = {}
    for i, p in enumerate(order):
        near = [(q, 2 if q == p else 1) for q in order[max(0, i - 1) : i + 2]]
        mean = lambda v: sum(v[q] * w for q, w in near) / sum(w for _, w in near)
        score[p] = (mean(size) * (1 + mean(points))) ** 0.5 * unlinked[p]
    bar = threshold * sum(len(b[0]) * score[b[1]] for b in blocks_) / sum(len(b[0]) for b in blocks_)
    return [b[0] for b in blocks_ if score[b[1]] >= bar]


def test_unmarked_pages_follow_the_path_scores():
    import random

    rng = random.Random(3)
    for _ in range(50):
        page = "".join(f"<{t}>" + "".join(f"<p>{'word, ' * rng.randrange(1, 60)}</p>" if rng.random() < 0.7 else f"<p><a>{'link ' * rng.randrange(1, 9)}</a> x</p>" for _ in range(rng.randrange(1, 5))) + f"</{t}>" for t in rng.choices(["div", "section", "ul", "dl"], k=8))
        assert main_text(page) == "\n\n".join(brute_paths(blocks(page)[0]))


def test_unclosed_tags_take_linear_time():
    import time

    took = []
    for n in (10_000, 100_000):
        began = time.perf_counter()
        main_text("<div>x" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]
