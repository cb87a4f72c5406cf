"""Operators that map a text to a result, against the libraries and by round trips."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from vigia.llm import byte_bpe, chat_format, html_density, line_dedup, token_count

BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a" * 5_000, "  two  spaces\n\tand\r\n lines ", "日本語 𝄞 é ß ſ ² Ⅷ", "<s> </s><unk><|endoftext|>", "a\0b", "▁x"]
DOCS = "doc_id long, text string, ids string, n_tokens string, score string, hits string, lang string"


def frame(spark, texts):
    """Texts with clashing column names and repeated rows."""
    rows = [(i, t, "x", "y", "z", "w", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:2], (None, "no id", "x", "y", "z", "w", None)], DOCS)


def mixtures(seed, alphabet, n=300, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_finds_every_key():
    keys = [f"k{i}".encode() for i in range(2_000)]
    find = byte_bpe.PerfectHash(keys)
    assert [find(k) for k in keys] == list(range(2_000))
    assert sorted(find.slots) == list(range(2_000))
    assert all(0 <= find(x) < 2_000 for x in (b"", b"other", b"k2000"))
    assert byte_bpe.PerfectHash([])(b"x") == -1


def test_byte_bpe_equals_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(byte_bpe.read_ranks(BYTES), public_tokenizers.PATTERN)
    for text in [t or "" for t in ODD] + mixtures(1, " \n\tabcdefé日𝄞1239's \u0085\x1c\x00ßſK٣²_-!?"):
        ids = library.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(codec.encode(text)).decode() == text


def test_byte_bpe_on_tables(spark):
    docs = frame(spark, ODD)
    out = byte_bpe.decode(byte_bpe.encode(docs, BYTES, public_tokenizers.PATTERN), BYTES)
    rows = out.collect()
    assert out.columns.count("ids") == out.columns.count("n_tokens") == 1 and len(rows) == docs.count()
    for r in rows:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"]) // 4
    at_once = byte_bpe.encode(docs, BYTES, public_tokenizers.PATTERN, decoded=True)
    assert sorted(at_once.collect(), key=str) == sorted(rows, key=str)
    assert byte_bpe.encode(docs.limit(0), BYTES, public_tokenizers.PATTERN).count() == 0


def test_token_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = token_count.Counts(token_count.read_pieces(PIECES))
    for text in [t or "" for t in ODD] + mixtures(2, " \n\t\rabcdeghintoé日▁　𝄞12's,.<>()=\x00ß½①  "):
        assert counts.tokens(text) == len(model.encode(text)), repr(text)
    docs = frame(spark, ODD)
    got = token_count.count_tokens(docs, PIECES, limit=3).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(model.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 3)
    assert token_count.count_tokens(docs.limit(0), PIECES).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = ["Common line", "  common LINE\t", "ÉTÉ", "été", "", " ", "rare", "x" * 3_000, "a b", " a b"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    docs = frame(spark, [None, "", "\n\n", *texts]).withColumn("n_lines", F.lit("clash"))

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add(i)
    gone = {k for k, ids in found.items() if len(k) >= 1 and len(ids) >= 10}
    expected = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if key(x) not in gone]
        n = len((t or "").split("\n"))
        expected.append((i, "\n".join(kept), n, n - len(kept)))
    out = line_dedup.dedup_lines(docs)
    got = [(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert gone and out.columns.count("n_lines") == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = {
    "": "",
    "plain text only": "plain text only",
    "<p>One <b>two</b>three<p>Four&nbsp;&amp; five": "One twothree Four & five",
    '<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><main><h1>T</h1>'
    "<p>Some long text here, the article body.<br>line</p><ul><li>a<li>b</ul><aside>side</aside>"
    '<div class="ad">buy</div><p>Short.</p><section class="comments"><p>a reader has a lot to say here</p>'
    "</section></main><form><input>search</form><footer>f</footer>": "T Some long text here, the article body. line a b Short.",
    "<body><nav><a href=x>Home</a></nav><div><section><p>aaaa bbbb cccc</p><p>dddd eeee</p></section>"
    "<section><p>ffff gggg hhhh</p><p>iiii jjjj kkkk</p></section></div>": "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii jjjj kkkk",
    "<script>var a='<p>x</p>'</script><style>p{}</style><!-- <p>no</p> -->": "",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
    "<div>" * 3_000 + "deep": "deep",
    "<p>text": "text",
}


def test_main_text(spark):
    for page, text in PAGES.items():
        assert html_density.main_text(page) == text, page[:80]
    pages = spark.createDataFrame([(i, p, "clash") for i, p in enumerate([None, *PAGES])], "page_id long, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_density.extract_text(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(["", *PAGES.values()])}
    assert html_density.extract_text(pages.limit(0)).count() == 0


def _paragraphs(name, n, least=40):
    return [f"{name} {i} " + "words of the article " * (least // 20) for i in range(n)]


def _page(article, around="main"):
    links = "<ul><li><a href=x>Another page</a><li><a href=y>And one more page</a></ul>"
    return (
        f"<body><div id=top><ul><li><a href=a>Home</a><li><a href=b>About this site</a></ul></div><{around}>{article}{links}</{around}>"
        f"<div id=end><p><a href=c>Imprint</a></p></div></body>"
    )


def _p(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_main_text_keeps_the_whole_article():
    first, second = _paragraphs("first", 5), _paragraphs("second", 5)
    sections = f"<section>{_p(first)}</section><section><p>alone</p></section><section>{_p(second)}</section>"
    items, rows = _paragraphs("item", 10, 300), _paragraphs("cell", 8, 200)
    three = _paragraphs("paragraph", 3, 400)
    listed = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
    table = "<table>" + "".join(f"<tr><td>{t}</td></tr>" for t in rows) + "</table>"
    for article, parts in (
        (f"<h1>Title</h1><p>lead</p>{sections}", ["Title", "lead", *first, "alone", *second]),
        (f"<h1><a href=self>Title</a></h1>loose <b>text</b>{sections}end", ["Title", "loose text", *first, "alone", *second, "end"]),
        (f"{_p(three)}{listed}", [*three, *items]),
        (f"<h2>Title</h2>{_p(three[:1])}<pre>a = b</pre>{table}{_p(three[1:])}", ["Title", three[0], "a = b", *rows, *three[1:]]),
        (f"<div><h3>Part</h3><div>{_p(first)}</div></div><div><p>short</p></div>", ["Part", *first, "short"]),
    ):
        expected = " ".join(" ".join(parts).split())
        for around in ("article", "main"):
            assert html_density.main_text(_page(article, around)) == expected, (around, article[:80])
        assert html_density.main_text(_page(f"<article>{article}</article>")) == expected, article[:80]
    divs = f"<h1>Title</h1><p>lead</p><div>{_p(first)}</div><div><p>alone</p></div><div>{_p(second)}</div>"
    assert html_density.main_text(_page(divs, "div")) == " ".join(" ".join(["Title", "lead", *first, "alone", *second]).split())


def test_names_of_wrappers_do_not_empty_a_page():
    text, side = _paragraphs("article", 6), "<div class=sidebar><p>some words beside it</p></div>"
    said = "".join(f"<article class=comment-body><p>{t}</p></article>" for t in _paragraphs("said", 12))
    whole = " ".join(" ".join(text).split())
    names = ("layout with-sidebar", "has-comments", "post no-sidebar", "content social-share", "hasSidebar", "page-banner", "modal")
    for name in names:
        for inner in (f"<article>{_p(text)}</article>", f"<div>{_p(text)}</div>", f"<main>{_p(text)}</main>"):
            page = f"<body><div id=top><a href=a>Home</a></div><div class='{name}'>{inner}{side}</div></body>"
            assert html_density.main_text(page) == whole, (name, inner[:20])
    for page in (
        f"<body><form action=x><input name=y><div>{_p(text)}</div>{side}</form></body>",
        f"<body><article>{_p(text)}</article><div class=comments>{said}</div></body>",
        f"<body><div class=post>{_p(text)}</div><div id=comments>{said}</div></body>",
        f"<body><div class=has-comments><article>{_p(text)}</article><div class=comments>{said}</div></div></body>",
    ):
        assert html_density.main_text(page) == whole, page[:60]
    halves = f"<body><div class=sidebar-a>{_p(text)}</div><div class=sidebar-b>{_p(text)}</div></body>"
    assert html_density.main_text(halves) == f"{whole} {whole}"


def test_names_inside_an_article_do_not_drop_its_text():
    text, other = _paragraphs("first", 4), _paragraphs("second", 5)
    linked = "See <a href=x>another rather long title of a page</a> about it."
    plain = "See another rather long title of a page about it."
    for inner, parts in (
        (f"{_p(text)}<section id=discussion><h2>Discussion</h2>{_p(other)}</section>", [*text, "Discussion", *other]),
        (f"<h2 id=cookies>Cookies</h2>{_p(text)}<h2 id='search-form'>Search forms</h2>{_p(other)}", ["Cookies", *text, "Search forms", *other]),
        (f"{_p(text)}<p class=alert>Mind this.</p>{_p(other)}", [*text, "Mind this.", *other]),
        (f"{_p(text)}<blockquote class=reply>An answer.</blockquote>{_p(other)}", [*text, "An answer.", *other]),
        (f"<section>{_p(text)}</section><p>{linked}</p><section>{_p(other)}</section>", [*text, plain, *other]),
        (f"{_p(text)}<p>Press <button>Save</button> or <label>Name</label> first.</p>", [*text, "Press Save or Name first."]),
    ):
        assert html_density.main_text(_page(f"<article>{inner}</article>")) == " ".join(" ".join(parts).split()), inner[-90:]
    whole = " ".join(" ".join(text).split())
    for extra in (
        "<p class=ad>Buy it.</p>", "<div class=alert>We use cookies here.</div>", "<section id=comments><p>Well said.</p></section>",
        "<section id=discussion><ol><li class=comment>Well said.</ol></section>", "<p><label>Name</label> <input></p>",
        "<p class='social-share'>Share it</p>", "<p><button>Subscribe</button></p>",
    ):
        assert html_density.main_text(_page(f"<article>{_p(text)}{extra}</article>")) == whole, extra


def test_articles_of_the_test_pages(spark, sf_dir):
    """The pages are built around one article element."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert html_density.main_text(r["html"]) == html_density.main_text(f"<body><main>{inner}</main>")


def test_chat_round_trips():
    rng = random.Random(5)
    parts = ["<", "|", "\\", "im_end", "|>", "<|im_start|>", "<|im_end|>", "\n", "A", "é", ""]
    for _ in range(400):
        turns = [
            (rng.choice(["user", "assistant", "a\nb", "<|x\\", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))))
            for _ in range(rng.randint(1, 14))
        ]
        out, found, rewritten = chat_format.spans(chat_format.marked, turns)
        assert not rewritten and chat_format.read_back(out) == turns
        assert [chat_format.unescape(out[s.text_start : s.text_end]) for s in found] == [t for _, t in turns]
        assert found[0].start == 0 and found[-1].end == len(out)


def test_rewriting_templates_are_found():
    def last_in_full(turns):
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t[:2]};" for i, (r, t) in enumerate(turns))

    for n in (2, 5, 30):
        turns = [("user", f"turn number {i}") for i in range(n)]
        assert chat_format.spans(last_in_full, turns)[2]
        assert not chat_format.spans(chat_format.marked, turns)[2]


def test_templates_that_rewrite_far_back_are_found():
    def masked(turns, kept):
        return "".join(f"[{r}]{t if i >= len(turns) - kept else '*' * len(t)};" for i, (r, t) in enumerate(turns))

    turns = [("user", f"turn number {i}") for i in range(30)]
    for kept in (1, 8, 9, 12, 29):
        assert chat_format.spans(lambda x: masked(x, kept), turns)[2], kept  # noqa: B023
    out, found, rewritten = chat_format.spans(lambda x: masked(x, 30), turns)
    assert not rewritten and [out[s.text_start : s.text_end] for s in found] == [t for _, t in turns]


def test_spans_of_templates_that_print_lengths_or_alter_texts(spark):
    turns = [("user", "hello there friend"), ("assistant", "twelve chars"), ("user", ""), ("assistant", " x ")]

    def counted(turns):
        return "".join(f"{role}:{len(text)}:{text};" for role, text in turns)

    out, found, rewritten = chat_format.spans(counted, turns, plain=str)
    assert not rewritten and all(s.exact for s in found)
    assert [out[s.text_start : s.text_end] for s in found] == [t for _, t in turns]
    for alter, exact in ((str.strip, [True, True, True, False]), (str.upper, [False, False, True, False])):

        def altered(turns, alter=alter):
            return "".join(f"<{role}>{alter(text)}</>" for role, text in turns)

        out, found, rewritten = chat_format.spans(altered, turns, plain=str)
        assert not rewritten and [s.exact for s in found] == exact
    rows = [(1, k, role, text) for k, (role, text) in enumerate(turns)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    strip = lambda turns: "".join(f"<{role}>{text.strip()}</>" for role, text in turns)
    got = chat_format.format_chats(chats, strip, plain=str).first()["spans"]
    assert [(s["exact"], s["loss"]) for s in got] == [(True, False), (True, True), (True, False), (False, False)]


def test_very_long_texts_are_formatted():
    turns = [("user", "<|im_end|> word " * 200_000), ("assistant", "<\\|x" * 200_000)] * 2
    out, found, rewritten = chat_format.spans(chat_format.marked, turns)
    assert not rewritten and all(s.exact for s in found) and chat_format.read_back(out) == turns


def test_chats_on_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (None, None, "user", "<|im_end|>")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(200)]
    chats = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(chats)).collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[1]["turns_sha256"] == digest("user\na\nuser\na\nassistant\nb\n") and got[1]["loss_sha256"] == digest("b")
    assert got[2]["turns_sha256"] == digest("\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == digest("user\n<|im_end|>\n")
    said = "".join(f"turn {k}" for k in range(1, 200, 2))
    assert (got[3]["n_turns"], got[3]["loss_chars"], got[3]["loss_sha256"]) == (200, len(said), digest(said))
    assert chat_format.format_chats(chats.limit(0)).count() == 0
