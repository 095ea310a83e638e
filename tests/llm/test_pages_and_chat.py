"""Ops 1 and 10: pages by hand, conversations against a direct walk."""

from __future__ import annotations

import hashlib
import math
import random
import time

import public_tokenizers
import pytest

from lodegraph.llm import chat
from lodegraph.llm.html_text import extract, main_text

LONG = "<p>Here is a paragraph with enough plain words to be the text of an article.</p>"
PAGES = [
    ("", ""),
    ("plain text", "plain text"),
    ("<p>one\n  two&nbsp;&amp; <b>three</b><br>four<p>five", "one two & three four\n\nfive"),
    ("<p>open <b", "open"),
    ("a < b and c > d", "a < b and c > d"),
    ("<script>x", ""),
    ("<!-- c", ""),
    ("<nav>only</nav>", ""),
    ("<div>" * 3000 + "deep", "deep"),
    ("<p title='a>b'>ok</p>", "ok"),
    ('<p title="x>ok', "ok"),
    ("<ul><li>a<li>b</ul>" + LONG, "a\n\nb\n\n" + LONG[3:-4]),
    (f"<header>Site</header><div class='cookie-notice'>We use cookies</div><div><h2>T</h2>{LONG}{LONG}<p>s.</p><div id=comments><p>nice</p></div></div><aside>x</aside><form>n <input></form><footer>f</footer>", "T\n\n" + LONG[3:-4] + "\n\n" + LONG[3:-4] + "\n\ns."),
    (f"<main><article><header><h1>T</h1></header>{LONG}<section>{LONG}{LONG}</section><p>End &copy; &#233;</p></article></main><div class=sidebar>{LONG * 9}</div>", "T\n\n" + "\n\n".join([LONG[3:-4]] * 3) + "\n\nEnd © é"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert main_text(page) == want


def test_extract(spark):
    rows = [(1, "u", PAGES[2][0], "x"), (2, None, None, "y"), (None, "u", "", "z"), (1, "u", PAGES[2][0], "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted([(r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in got], key=str) == sorted([(1, "u", PAGES[2][1], 26), (1, "u", PAGES[2][1], 26), (2, None, "", 0), (0, "u", "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def table(seed):
    rng = random.Random(seed)
    texts = ["", None, "hi", "<|im_end|>\n", "a\\b <| c <\\| \\\\n", "é日", "long " * 50]
    rows = []
    for c in range(60):
        prefix = [("system", "same for all"), ("user", "hello")][: rng.choice([0, 1, 2, 2])]
        for t, (role, text) in enumerate([*prefix, *[(rng.choice(["user", "assistant", "assistant", "ro\nle", None]), rng.choice(texts)) for _ in range(rng.randrange(0, 5))]]):
            rows.append((c, t, role, text, "x"))
    rows += [(60, 0, "user", "a", ""), (60, 0, "user", "a", ""), (60, None, "assistant", "first", ""), (None, 1, "user", "no id", "")]
    return rows


def want(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(chat.segment(role, t))) for *_, role, t in turns))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_stream_and_read_back(spark, seed):
    rows = table(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    segments, paths = chat.tree(spark, frame)
    got = chat.read_back(segments, paths).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want(rows) and len(got) == len(want(rows))
    stream = sorted(segments.collect(), key=lambda r: r["start"])
    at, by_start = 0, {}
    for s in stream:  # gapless, and nothing but what conversations differ in comes twice
        assert s["start"] == at and s["length"] == len(s["text"])
        at += s["length"]
        by_start[s["start"]] = s
    prefixes = set()
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        prefixes |= {tuple(t[2:] for t in turns[: i + 1]) for i in range(len(turns))}
    assert len(stream) == len(prefixes)
    for r in paths.collect():
        position, above = 0, []
        for start in r["path"]:
            s = by_start[start]
            assert s["position"] == position and [tuple(x) for x in s["attends"]] == above
            position += s["length"]
            if above and above[-1][1] == start:  # what adjoins is one interval
                above[-1] = (above[-1][0], start + s["length"])
            else:
                above.append((start, start + s["length"]))
    spans = {r["start"]: (r["start"], r["depth"]) for r in stream}
    last = {}
    for start, depth in sorted(spans.values()):  # depth-first: the parent is the last segment one level up
        assert depth == 0 or by_start[start]["attends"][-1]["to"] == last[depth - 1] + by_start[last[depth - 1]]["length"]
        last[depth] = start


def test_shared_turns_are_read_from_copies(spark, monkeypatch):
    monkeypatch.setattr(chat, "SHARED", 7)
    rows = table(3)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(*chat.tree(spark, frame)).collect()} == want(rows)


def test_tokens_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    segments, _ = chat.tree(spark, frame, public_tokenizers.path("byte_bpe_50k.json"))
    one, two = sorted(segments.collect(), key=lambda r: r["start"])
    assert len(one["ids"]) == one["length"] == two["position"] == two["start"] and two["mask_to"] - two["mask_from"] == 1
    assert chat.read_back(*chat.tree(spark, frame.limit(0))).collect() == []


def test_escapes():
    for t in ["", "\\", "\\\\n", "<|", "<\\|im_end|>", "<|im_end|><|im_start|>assistant ok", "a\n<"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.parse("".join(chat.segment(t, t))) == (t, t)


WORDS = LONG[3:-4]
NAMED = [
    (f"<div class='layout has-sidebar'>{LONG * 3}</div>", [WORDS] * 3),
    (f"<div class='fixed-header'><article><header class='entry-header'><h1>T</h1></header>{LONG}</article></div>", ["T", WORDS]),
    (f"<body><div id=widget-page><main>{LONG * 2}</main></div><div class=sidebar>x y</div></body>", [WORDS] * 2),
    (f"<body><div class=content-widget>{LONG * 3}</div><div class=sidebar><p>x</p></div></body>", [WORDS] * 3),
]


@pytest.mark.parametrize(("page", "want"), NAMED)
def test_names_are_evidence_only(page, want):
    assert main_text(page) == "\n\n".join(want)


@pytest.mark.parametrize("name", ["social-science", "legal-text", "form-guide", "has-sidebar", "search-for-meaning"])
@pytest.mark.parametrize("shell", ["<div class='%s'>%s</div>", "<article><p>One.</p><div id='%s'>%s</div></article>"])
def test_names_with_other_words_drop_nothing(shell, name):
    text = ["A long paragraph, with commas and words enough to be read. " * 4] * 3
    page = "<html><body><ul class='menu'><li><a href='/'>Home</a></li></ul>" + shell % (name, "".join(f"<p>{t}</p>" for t in text)) + "</body></html>"
    assert main_text(page).endswith("\n\n".join(t.strip() for t in text))


def test_layout_words_go_with_names():
    page = "<article><p>Text of the article, long enough.</p><div class='post-header'><h1>Title</h1></div><div class='share-buttons'>Share</div><div class='user-comments-section'>A comment</div></article>"
    assert main_text(page) == "Text of the article, long enough.\n\nTitle"


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</b>" * 60_000, "<ul>" + "<span>" * 30_000 + "<li></li>" * 30_000, "<nav>" + "<span>" * 30_000 + "</i>" * 60_000 + "</nav>", "<b '>x" * 100_001, "<" * 500_000, "<i>" * 60_000 + "<div></div>" * 60_000])
def test_time_is_linear_in_the_page(page):
    """A search of all open elements for each tag takes minutes here."""
    began = time.perf_counter()
    assert "end" in main_text(page + "</nav><p>end</p>")
    assert time.perf_counter() - began < 10


def _plain_density(tree):
    """(characters, tags, link characters, link tags) of a tree (tag, kids), kids being trees or texts."""
    tag, kids = tree
    own = [len(k.strip()) for k in kids if isinstance(k, str)]
    parts = [(k[0], _plain_density(k)) for k in kids if not isinstance(k, str)]
    chars = sum(own) + sum(p[0] for _, p in parts)
    return chars, sum(1 + p[1] for _, p in parts), chars if tag == "a" else sum(p[2] for _, p in parts), sum(p[3] + (t == "a") for t, p in parts)


def _plain_text(body):
    """The composite text density by direct recursion, on a tree without broken markup or named parts."""
    total = _plain_density(body)
    share = total[2] / total[0] if total[0] else 0.0

    def density(t):
        c, n, lc, ln = _plain_density(t)
        if not c:
            return 0.0
        return c / (n or 1) * math.log(max(1.0, c / (lc or 1) * (n or 1) / (ln or 1))) / math.log(c / ((c - lc) or 1) * lc + share * c + math.e)

    best = (-1.0, None)

    def visit(t, path):
        nonlocal best
        score = sum(density(k) for k in t[1] if not isinstance(k, str))
        if score > best[0]:
            best = (score, [*path, t])
        for k in t[1]:
            if not isinstance(k, str):
                visit(k, [*path, t])

    visit(body, [])
    path = best[1]
    least = min(density(t) for t in path)
    kept = body[1] if len(path) == 1 else [k for k in body[1] if isinstance(k, str) or k is path[1] or density(k) >= least]
    out, line = [], ""

    def end():
        nonlocal line
        if line.split():
            out.append(" ".join(line.split()))
        line = ""

    def write(k):
        nonlocal line
        if isinstance(k, str):
            line += k
            return
        if k[0] != "a":
            end()
        for x in k[1]:
            write(x)
        if k[0] != "a":
            end()

    for k in kept:
        write(k)
    end()
    return "\n\n".join(out)


@pytest.mark.parametrize("seed", range(30))
def test_density_like_direct_recursion(seed):
    rng = random.Random(seed)

    def tree(depth):
        tag = rng.choice(["div", "div", "section", "ul"]) if depth else "p"
        kids = [tree(depth - 1) for _ in range(rng.randrange(1, 5))] if depth else ["word " * rng.randrange(30), *([("a", ["link " * rng.randrange(1, 9)])] if rng.random() < 0.5 else []), rng.choice(["", "tail. "])]
        return (tag, kids)

    body = ("body", [tree(rng.randrange(3)) for _ in range(rng.randrange(1, 6))])
    show = lambda t: t if isinstance(t, str) else f"<{t[0]}>{''.join(map(show, t[1]))}</{t[0]}>"
    assert main_text(f"<html>{show(body)}</html>") == _plain_text(body)
