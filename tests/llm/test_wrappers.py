"""Whole articles: several templates, class words, optional parts, copies, siblings, raw elements."""

import random
import sys

from arborist.llm import wrappers


sys.setrecursionlimit(wrappers.DEPTH)


def prose(seed, n=25):
    rng = random.Random(seed)
    return f"{seed} " + " ".join(rng.choice("lorem ipsum dolor sit amet nunc".split()) for _ in range(n))


def texts_of(spark, bodies, host="h.example"):
    rows = [(k, f"https://{host}/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    found = {r["page_id"]: r["main_text"] for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    return [found[k] for k in range(len(bodies))]


def test_every_page_of_a_host_with_several_templates(spark):
    bodies, want = [], []
    for k in range(4):
        news, travel, main, plain, second = (prose(f"{name}{k}", n) for name, n in (("n", 60), ("t", 30), ("m", 20), ("p", 20), ("s", 20)))
        bodies += [f"<article class='post category-news'><p>{news}</p></article>", f"<article class='post category-travel'><p>{travel}</p></article>"]
        bodies += [f"<main><h1>Head {k}</h1><p>{main}</p></main>", f"<div class=text><p>{plain}</p></div>"]
        bodies += [f"<article class=one><p>{news}</p></article><hr><article class=two><p>{second}</p></article>"]
        want += [news, travel, f"Head {k}\n{main}", plain, f"{news}\n{second}"]
    assert texts_of(spark, bodies) == want


def test_class_words_cut_no_article_off(spark):
    opened = ["<div class='container has-sidebar'><article>", "<main class='no-sidebar'>", "<div class='page with-comments'><article class='post tag-menu'>", "<article class='category-social'>"]
    opened += ["<div class='widget'><article>", "<form id='aspnetForm'><main>", "<article class='post social'>", "<article><div class='widget'>"]
    for k, head in enumerate(opened):
        body = [prose(f"w{k}{j}") for j in range(3)]
        found = texts_of(spark, [f"{head}<p>{b}</p><div class='ad-1'>buy {b}</div><ul class='share'><li>send {b}</li></ul>" for b in body])
        assert found == body, head


def test_text_without_a_partner_in_the_wrapper_is_kept():
    bodies = [f"<div class=x>{b}</div>" for b in ("<h2>a1</h2><div>a2<ul><li>a3</li></ul></div>", "<h2>b1</h2><figure>b2</figure><div>b3</div>", "<h2>c1</h2><div>c2</div><h2>c3</h2><div>c4</div>")]
    wrapper, rare = (wrappers.page_tree(f"<body>{b}</body>")[0] for b in (bodies[2], bodies[1]))
    wrapper = wrappers.merge(wrapper, rare)
    found = [wrappers.extract(f"<body>{b}</body>", wrappers.Host(wrapper)) for b in bodies]
    assert found == ["a1\na2\na3", "b1\nb2\nb3", "c1\nc2\nc3\nc4"]


def test_alignment_is_a_longest_common_subsequence_at_every_size():
    rng = random.Random(2)
    for n, m, letters in [*((rng.randrange(40), rng.randrange(40), "uvwx") for _ in range(300)), (600, 700, "uvwxyz")]:
        a, b = ([wrappers.Node(rng.choice(letters)) for _ in range(k)] for k in (n, m))
        row = [0] * (m + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x.label == y.label else max(row[j], last[j + 1]))
        pairs = wrappers.align(a, b)
        assert [x for x, _ in pairs if x] == a and [y for _, y in pairs if y] == b
        both = [(x, y) for x, y in pairs if x and y]
        assert len(both) == row[-1] and all(x.label == y.label for x, y in both)


def test_copies_do_not_make_text_a_template(spark):
    page = f"<div class=text><h2>Title</h2><p>{prose('c')}</p></div>"
    assert texts_of(spark, [page] * 4) == [f"Title\n{prose('c')}"] * 4
    plain = [f"<div class=text><h2>Title {k}</h2><p>{prose(f'd{k}')}</p><div class=low>Always</div></div>" for k in range(4)]
    optional = f"<div class=text><h2>Title x</h2><p>{prose('x')}</p><blockquote>{prose('q')}</blockquote><div class=low>Always</div></div>"
    copies = [optional.replace("<div", f"<script>track({k})</script><div") for k in range(3)]
    found = texts_of(spark, plain + copies)
    assert found == [f"Title {k}\n{prose(f'd{k}')}" for k in range(4)] + [f"Title x\n{prose('x')}\n{prose('q')}"] * 3


def test_siblings_of_the_main_part_are_kept(spark):
    links = "<ul>" + "".join(f"<li><a href=/{n}>go to {n}</a></li>" for n in range(5)) + "</ul>"
    parts = [(f"Head {k}", f"lead {prose(f'l{k}', 8)}", [prose(f"b{k}{j}") for j in range(3)], prose(f"s{k}", 12)) for k in range(4)]
    plain = [f"{links}<div><h1>{h}</h1><div class=lead>{e}</div><div class=wrap><div class=body>{''.join(f'<p>{p}</p>' for p in b)}</div><div class=second>{s}</div></div></div>" for h, e, b, s in parts]
    want = ["\n".join([h, e, *b, s]) for h, e, b, s in parts]
    assert texts_of(spark, plain) == want
    around = [f"<div id=main>{links}<h1>{h}</h1><article>{''.join(f'<p>{p}</p>' for p in b)}</article><div class=second>{s}</div></div>" for h, _, b, s in parts]
    assert texts_of(spark, around) == ["\n".join([h, *b, s]) for h, _, b, s in parts]


def test_text_after_a_raw_element_is_whole_after_capital_dotted_i():
    page = f"<HEAD><title>x</title><header>no end of head</header><body><article><p>{'İ' * 9} bir</p><SCRIPT>a</ſcript>b</Script ><p>iki üç</p><svg><g/></svg><p>dört</p></article>"
    host = wrappers.Host(wrappers.page_tree(page)[0])
    assert wrappers.extract(page, host) == f"{'İ' * 9} bir\niki üç\ndört"
    assert [v for k, v, _ in wrappers.events("<script>İİ</script>dört<iframe>x</IFRAME>beş") if k == "text"] == ["dört", "beş"]


# what the wrapper decides

COMPOUND = "comment-list comments-area post-comments related-posts social-share ad-banner cookie-banner newsletter-signup share-buttons".split()


def host_of_pages(pages):
    total = None
    for page in pages:
        tree = wrappers.page_tree(page)[0]
        total = tree if total is None else wrappers.merge(total, tree)
    return wrappers.Host(total)


def test_an_empty_wrapper_gives_no_text():
    for body in ("<nav><a href=/>x</a></nav><article><h1>Head {k}</h1><p>{p}</p></article><footer>low {k}</footer>", "<div class=text><h1>Head {k}</h1><p>{p}</p></div>"):
        pages = [f"<body>{body.format(k=k, p=prose(f'e{k}'))}</body>" for k in range(3)]
        host, empty = host_of_pages(pages), wrappers.Host(wrappers.Node("#page"))
        assert [wrappers.extract(p, host) for p in pages] == [f"Head {k}\n{prose(f'e{k}')}" for k in range(3)]
        assert [wrappers.extract(p, empty) for p in pages] == [""] * 3


def test_compound_class_names_cut_their_blocks_off(spark):
    for k, name in enumerate(COMPOUND):
        for opened, closed in (("<article>", "</article>"), ("<div class=story>", "</div>")):
            body = [[prose(f"{k}{j}{i}", 40) for i in range(3)] for j in range(4)]
            pages = [f"{opened}<h1>Head {j}</h1><p>{b[0]}</p><p>{b[1]}</p><div class='{name}'><p>one says {b[2][:60]}</p><p>two {j}</p></div>{closed}" for j, b in enumerate(body)]
            assert texts_of(spark, pages) == [f"Head {j}\n{b[0]}\n{b[1]}" for j, b in enumerate(body)], (name, opened)


def test_names_of_headings_and_positions_need_more_than_a_word():
    head = "<div class='page-header'><h1>Head {k}</h1><p>{lead}</p></div><h2 class='menu-title'>Part {k}</h2><p class='banner-text'>{p}</p>"
    pages = [f"<body><article>{head.format(k=k, lead=prose(f'l{k}'), p=prose(f'p{k}'))}</article></body>" for k in range(4)]
    host = host_of_pages(pages)
    assert wrappers.extract(pages[1], host).split("\n")[-2:] == ["Part 1", prose("p1")]


def test_hosts_of_one_and_two_pages_without_tags(spark):
    menu = "<div><a href=/>Menu</a> <a href=/h>Home</a></div>"
    page = menu + "<div class=x><h1>Head {k}</h1><p>{p}</p><p>{q}</p></div><div>Copyright 2024</div>"
    two = [page.format(k=k, p=prose(f"p{k}", 30), q=prose(f"q{k}", 30)) for k in range(2)]
    want = [f"Head {k}\n{prose(f'p{k}', 30)}\n{prose(f'q{k}', 30)}" for k in range(2)]
    assert texts_of(spark, two) == want
    assert texts_of(spark, two[:1]) == want[:1]
    assert texts_of(spark, two[:1] * 3) == want[:1] * 3


def test_template_lines_at_the_edges_of_articles_only():
    page = "<body><article><div>Our paper since 1900</div><h1>Head {k}</h1><h2>Background</h2><p>{p}</p><div>Read all about it</div></article></body>"
    many = [page.format(k=k, p=prose(f"p{k}")) for k in range(5)]
    host = host_of_pages(many)
    assert [wrappers.extract(p, host) for p in many] == [f"Head {k}\nBackground\n{prose(f'p{k}')}" for k in range(5)]
    few = host_of_pages(many[:2])  # two pages are no proof against an article
    assert wrappers.extract(many[0], few) == f"Our paper since 1900\nHead 0\nBackground\n{prose('p0')}\nRead all about it"


def test_depth_is_no_limit():
    deep = "<div>" * 3000
    pages = [f"<body>{deep}<aside>side {k} {prose('a')}</aside><article><p>{prose(f'd{k}')}</p></article></body>" for k in range(2)]
    host = host_of_pages(pages)
    packed = wrappers.Node.unpack(host.wrapper.pack())
    assert [wrappers.extract(p, wrappers.Host(packed)) for p in pages] == [prose("d0"), prose("d1")]


def test_labels_without_end_share_a_node():
    def name(k):
        return "".join(chr(97 + int(c)) for c in f"{k:05d}")

    pages = [f"<body><main>{''.join(f'<section class=s{name(9 * k + j)}><p>{prose(f'{k}.{j}')}</p></section>' for j in range(9))}</main></body>" for k in range(120)]
    host = host_of_pages(pages)
    main = host.wrapper.children[0].children[0]
    assert len(main.children) <= wrappers.RARE_CHILDREN + 9 and any(c.label == "section *" for c in main.children)
    assert [wrappers.extract(p, host) for p in pages[::40]] == ["\n".join(prose(f"{k}.{j}") for j in range(9)) for k in (0, 40, 80)]
    assert wrappers.label_of("div", " class='css-1x9ab item-12'") == wrappers.label_of("div", ' class="css-7y item-3"') == "div css-# item-#"


def test_slots_against_brute_force():
    """Pages that agree on their tags: a slot is template where its texts agree on enough different pages."""
    rng = random.Random(8)
    for _ in range(60):
        n, places = rng.randrange(1, 7), rng.randrange(1, 6)
        tags = [rng.choice(["h1", "p", "div", "pre"]) for _ in range(places)]
        tags = [t for i, t in enumerate(tags) if t not in tags[:i]]
        table = sorted({tuple(f"{t} {rng.choice('ab')}" for t in tags) for _ in range(n)})
        host = host_of_pages(["".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, row, strict=True)) for row in table])
        for i, child in enumerate(host.wrapper.children):
            same = len({row[i] for row in table}) == 1
            assert child.label == tags[i] and child.pages == len(table)
            assert host.template(child.children[0]) == (same and len(table) >= 2)
            assert host.template(child.children[0], True) == (same and len(table) >= 4)


def test_clashing_and_extra_columns(spark):
    rows = [(k, f"https://c.example/{k}", f"<article><p>{prose(f'c{k}')}</p></article>", "h", "p", "w") for k in range(3)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, host STRING, _page STRING, wrapper STRING")
    found = sorted(wrappers.extract_main_text(df).collect())
    assert found[0].asDict() == dict(zip(df.columns, rows[0], strict=True)) | {"main_text": prose("c0")} and len(found) == 3
