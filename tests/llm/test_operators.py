"""The training-data operators against brute force, round trips and held-out accuracy on small tables."""

import collections
import hashlib
import html as entities
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import chat, chunks, decontam, exact, html, kneser, langid, near, pack, queries, toxic

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"
ODD = [None, "", " \n", "a", "É é", "x" * 50_000, "w " * 30_000, "same text here", "same text here", "SAME text here", "<|endoftext|> ퟿"]


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, and columns named like results."""
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(None, "no id", None, 0), (7, "same text here", "en", 7)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept bigint")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, kept bigint")


# chat

CONV = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_chat_reads_back_what_went_in(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[AND]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/s>", "INST]", "\n", "é", "$1", "AND]", "]"]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "a[/ROLE]", None]), rng.choice([None, "", "".join(rng.choices(bits, k=rng.randint(1, 8)))]), "x"))
    out = chat.format_chat(spark.createDataFrame(rows, CONV)).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("l", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    want = collections.defaultdict(list)
    for c, _, r, x, _ in rows:
        want[c].append((r or "", x or ""))
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.t] == want[r.conv_id]
        assert r.l == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert [(m.role, len(m.texts)) for m in r.messages] == [(k, len(list(g))) for k, g in __import__("itertools").groupby(want[r.conv_id], lambda p: p[0])]


def test_chat_ties_repeats_nulls_and_no_rows(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "user", "first", ""), (None, 0, "assistant", "x", "")]
    got = {r.conv_id: [t.text for t in r.t] for r in chat.format_chat(spark.createDataFrame(rows, CONV)).withColumn("t", chat.read_turns(F.col("formatted"))).collect()}
    assert got == {1: ["first", "a", "a", "b"], None: ["x"]}
    assert chat.format_chat(spark.createDataFrame([], CONV)).count() == 0


# packing


def vocabulary():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def check_packing(rows, texts, size, end=2):
    t = vocabulary()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        first = (len(ids) - 1) % size + 1
        edges = [0, *range(first, len(ids) + 1, size)]
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(i, a, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        for r in got:
            raw = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert bytes(r.ids) == raw
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(seqs), sum(r.length for r in rows)


def test_packing_is_gapless_and_tight(spark, docs, odd, none):
    rows = pack.pack(docs, queries.vocabulary(), size=256).collect()
    n, total = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 256)
    assert n <= math.ceil(total / 256) * 1.05 + 1
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(pack.pack(some, queries.vocabulary(), size=64).collect(), {r.doc_id: r.text for r in some.collect()}, 64)
    assert pack.pack(odd, queries.vocabulary()).agg(F.sum("length")).first()[0] == pack.token_pieces(odd, queries.vocabulary()).agg(F.sum("length")).first()[0]
    assert pack.pack(none, queries.vocabulary()).count() == 0


def test_packed_sequences_hold_their_pieces(docs):
    packed = pack.pack(docs, queries.vocabulary())
    rows = packed.collect()
    for s in pack.sequences(packed).collect():
        assert bytes(s.ids) == b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset))


def test_plan_is_best_fit_over_counts():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randint(1, 60)
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, size + 1), rng.randint(1, size))}
        plan = pack.plan_best_fit(counts, size)
        bins, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for length, rank, n, first, offset in plan:
            ranks[length] += range(rank, rank + n)
            for k in range(n):
                bins[first + k].append((offset, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        for parts in bins.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= size
        # best fit one piece at a time, longest first
        rooms = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(size - n)
        assert len(bins) == len(rooms)


def test_tokens_are_the_libraries_own():
    t, encode = vocabulary(), pack.tokenizer(queries.vocabulary())
    rng = random.Random(5)
    pool = [chr(i) for i in range(0x3100)] + list(" \t\n\u0085 　'sdt09") * 40 + ["<|endoftext|>", "<|end"] * 50
    for _ in range(5_000):
        s = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        assert t.encode(s, add_special_tokens=False).ids == list(encode(s)), ascii(s)


def test_tokens_of_long_white_space_are_the_librarys():
    t, encode = vocabulary(), pack.tokenizer(queries.vocabulary())
    for run in (" " * 1_000_000, "\n" * 1_000_000, " \n\t\u00a0" * 250_000, " " * 9_999, " " * 10_000):
        s = f"a<|endoftext|>{run}b c"
        assert t.encode(s, add_special_tokens=False).ids == list(encode(s))


# languages


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_spans_and_odd_texts(spark, docs, odd, none):
    m = langid.fit(docs)
    part = {r.lang: " ".join(r.text.split()[:40]) for r in docs.collect() if len(r.text.split()) > 60}
    mixed = part["en"] + " " + part["de"]
    rows = spark.createDataFrame([(0, mixed), (1, None), (2, ""), (3, "12 .!"), (4, "漢字")], DOC)
    got = {r.doc_id: r.language for r in langid.label(rows, m).collect()}
    assert [s.lang for s in got[0].spans] in (["en", "de"], ["en", "fr", "de"])
    assert abs(got[0].spans[0].end - len(part["en"])) < 60
    assert all((got[i].lang, got[i].score, got[i].spans) == ("und", 0.0, []) for i in (1, 2, 3))
    assert got[4].lang in m.langs
    out = langid.label(odd, m, out="kept")
    assert out.count() == odd.count() and out.columns == odd.columns
    empty = langid.fit(none)
    assert empty.langs == [] and {r.language.lang for r in langid.label(docs, empty).collect()} == {"und"}
    assert langid.label(none, m).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 6, 5)
        text = np.repeat(np.arange(5), sizes)
        score, prior = rng.normal(0, 3, (len(text), 3)), rng.normal(0, 1, 3)
        path = langid.viterbi(text, score, 5, prior, 2.0)
        for t in range(5):
            s = score[text == t]
            value = lambda p: prior[p[0]] + sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
            if len(s):
                assert math.isclose(value(list(path[text == t])), max(value(p) for p in itertools.product(range(3), repeat=len(s))))


def test_many_languages_and_scripts_that_none_uses(spark):
    """200 languages: switches go back to the right one. Texts in a script that no learned language uses score 0."""
    score = np.full((12, 200), -5.0, np.float32)
    score[:6, 150], score[6:, 190] = 5.0, 5.0
    path = langid.viterbi(np.zeros(12, int), score, 1, np.zeros(200), 2.0)
    assert path.tolist() == [150] * 6 + [190] * 6
    rows = [(i, "the house and the garden " * 5, "en") for i in range(30)] + [(100 + i, "das Haus und der Garten " * 5, "de") for i in range(5)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_rows=10)
    assert m.langs == ["de", "en"] and m.prior[1] > m.prior[0]  # the rare one is learned, the common one stays likelier
    asked = [(1, "これは日本語です"), (2, "это русский текст"), (3, "the garden это"), (4, "das Haus"), (5, "123 !?")]
    got = {r.doc_id: r.language for r in langid.label(spark.createDataFrame(asked, DOC), m).collect()}
    assert (got[1].score, got[1].known, got[2].score, got[2].known) == (0.0, 0.0, 0.0, 0.0)
    assert got[3].lang == "en" and got[3].score == got[3].known == pytest.approx(9 / 12) and got[4].score == 1.0 and got[5].lang == "und"


def test_set_sizes_beyond_16_bits_in_one_part():
    """Counts of shared shingles keep their value beyond 65,535."""
    size = np.bincount(np.zeros(70_000, int), minlength=near.PARTS).astype("<u4")
    assert np.frombuffer(size.tobytes(), "<u4")[0] == 70_000
    source = open(near.__file__).read()
    assert "<u2" not in source


# repeated passages


def test_passages_of_over_fifty_words_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuéö", k=rng.randint(2, 9)))
    body = [[word() for _ in range(rng.randint(60, 250))] for _ in range(120)]
    line, planted = [word() for _ in range(12)], set()
    for _ in range(30):
        passage = [word() for _ in range(rng.randint(55, 90))]
        for d in rng.sample(range(80), 2):
            i = rng.randrange(len(body[d]))
            body[d][i:i] = passage
            planted.add(d)
    for d in range(80, 120):
        i = rng.randrange(len(body[d]))
        body[d][i:i] = line
    df = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(body)], DOC)
    texts = [" ".join(b) for b in body]
    got = chunks.repeated_passages(df).collect()
    assert len({r.doc_id for r in got} & planted) >= 0.97 * len(planted)
    assert {r.doc_id for r in got} <= planted
    for r in got:
        span = texts[r.doc_id][r.start : r.end]
        assert span in texts[r.first_id] or len(span) > 40
    cleaned = {r.doc_id: r.text for r in chunks.without_repeats(df).collect()}
    for r in got:
        if not r.first:
            assert texts[r.doc_id][r.start : r.end] not in cleaned[r.doc_id]
    assert sum(map(len, cleaned.values())) == sum(map(len, texts)) - sum(r.end - r.start for r in got if not r.first)


def test_chunks_resist_insertions_and_odd_texts(odd, none):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgéz", k=6)) for _ in range(3_000))
    cut = lambda t: set(chunks.Grams([t], 20).chunks()[1].tolist())
    moved = text[:9_000] + " INSERTED " + text[9_000:]
    assert len(cut(text)) > 500 and len(cut(text) - cut(moved)) <= 4
    ends = chunks.Grams([text], 20).chunks()[0]
    assert np.diff(ends).max() <= 8 and np.diff(ends).min() >= 1
    assert chunks.repeated_passages(none).count() == 0
    got = chunks.repeated_passages(odd, least_words=3).collect()
    assert {r.doc_id for r in got} == {6, 7, 8}  # "w w w" in itself, and the texts that are equal in case
    assert chunks.without_repeats(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).columns == odd.columns


def test_equal_stretches_have_equal_chunks_between_their_own_cuts():
    """Any 20 words that stand in different surroundings, periodic ones too, hold a whole chunk, and the chunks that count are the same."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choices("abcde", k=rng.randint(1, n)))
    for trial in range(300):
        kinds = [lambda: word(6), lambda: word(1), lambda: "sh,", lambda: rng.choice(["la", "li"])]
        stretch = " ".join(kinds[trial % 4]() for _ in range(20))
        found = []
        for _ in range(2):
            lead = " ".join(word(5) for _ in range(rng.randint(0, 30)))
            text = f"{lead} {stretch} {' '.join(word(5) for _ in range(rng.randint(0, 30)))}".strip()
            g = chunks.Grams([text], 20)
            right, digest, best = g.chunks()
            k, width = chunks.window(20)
            i = len(lead.split())
            low, high = best[i + k], best[i + 20 - width]
            assert i < low < high <= i + 19
            found.append(digest[(right > low) & (right <= high)].tolist())
        assert found[0] == found[1] and found[0]


def test_passages_of_51_words_and_periodic_ones_are_all_found(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuéö", k=rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(51) for _ in range(60)] + [" ".join(["sh,"] * 60), " ".join(["thndhe"] * 51), " ".join(["la li lu"] * 25), "A b  C\n" * 20]
    texts = [f"{words(rng.randint(0, 40))} {p} {words(rng.randint(0, 40))}" for p in passages for _ in range(2)]
    got = collections.defaultdict(list)
    for r in chunks.repeated_passages(spark.createDataFrame(list(enumerate(texts)), DOC)).collect():
        got[r.doc_id].append(texts[r.doc_id][r.start : r.end])
    for i, text in enumerate(texts):
        p = passages[i // 2].strip()
        if i % 2 or i < 120:
            assert any(p in g and len(g) < len(p) + 12 for g in got[i]), (p, got[i])
        else:
            assert any(p.startswith(g) for g in got[i])


def test_passages_equal_all_stretches_of_twenty_words(spark):
    rng = random.Random(15)
    pool = [" ".join(rng.choices(["a", "bb", "ccc", "é"], k=rng.randint(1, 30))) for _ in range(40)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(120)] + [None, "", "a " * 19, "a " * 300]
    n, places = 20, collections.defaultdict(list)
    for d, t in enumerate(texts):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for k in range(len(at) - n + 1):
            places[t[at[k][0] : at[k + n - 1][1]]].append((d, k, at[k][0], at[k + n - 1][1]))
    want = {(d, x) for found in places.values() if len(found) > 1 for d, _, a, b in found for x in range(a, b)}
    got = chunks.repeated_passages(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()
    assert {(r.doc_id, x) for r in got for x in range(r.start, r.end)} == want
    assert {r.doc_id for r in got if r.first} >= {found[0][0] for found in places.values() if len(found) > 1 and found[0][1] == 0}
    assert all(r.words == len((texts[r.doc_id][r.start : r.end]).split()) >= n for r in got)


# language model


def test_kneser_ney_equals_brute_force(spark, docs):
    rows = docs.collect()
    toks = {r.doc_id: [*tokens(r.text), "\0end"] for r in rows}
    train = [d for d in toks if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for d in train for w in toks[d])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for d in train for p in zip(["\0start", *toks[d]], toks[d]))
    cont = collections.Counter(b for _, b in pairs)
    total = sum(cont.values())

    def discounts(values):
        n1, n2, n3, n4 = (max(1e-9, sum(x == i for x in values)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return [min(h, max(0.05, x)) for x, h in zip(raw, (0.95, 1.9, 2.85))]

    d2, d1 = discounts(pairs.values()), discounts(cont.values())
    off = lambda d, k: d[min(k, 3) - 1] if k else 0
    spare = sum(off(d1, k) for k in cont.values()) / total
    after = collections.defaultdict(lambda: [0, 0.0])
    for (a, _), k in pairs.items():
        after[a][0] += k
        after[a][1] += off(d2, k)
    low_p = lambda w: (cont[w] - off(d1, cont[w])) / total + spare / (v + 1)

    def p(a, w):
        if a not in after:
            return low_p(w)
        k = pairs[a, w]
        return (k - off(d2, k)) / after[a][0] + after[a][1] / after[a][0] * low_p(w)

    assert math.isclose(sum(p(toks[train[0]][0], w) for w in c) + p(toks[train[0]][0], "\0unknown"), 1, rel_tol=1e-9)
    for r in queries.op5_kneser_ney(spark, SF).collect():
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip(["\0start", *t], t)), rel_tol=1e-9)


def test_kneser_ney_odd_texts(odd, none, docs):
    got = kneser.score(odd, kneser.fit(odd)).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    empty = kneser.fit(none)
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in kneser.score(docs, empty).collect())
    assert kneser.score(none, empty).count() == 0


# pages


def test_main_text_of_labelled_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_main_text(spark, SF).collect():
        article = pages[r.page_id].html.partition("<article>")[2].partition("</article>")[0]
        plain = re.sub(r"<[^>]*(>|$)", lambda m: "" if re.match(r"</?(b|i|a|em)\b", m[0]) else " ", article)
        want = " ".join(entities.unescape(plain).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


PAGE = """<html><head><title>Title words here</title><script>if (a < b) { x("</p>") }</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a><li><a href=/x>About us</a></ul></nav></header>
<div class="cookie-notice">We use cookies and so does everyone else, please accept them all.</div>
<{tag}><h1>The story</h1><p>First <b>bo</b>ld &amp; plain&nbsp;text of the story goes on for a while.<p>Second   paragraph<br>with a break.
<div class="ad">Buy this now, it is cheap and good.</div><ul><li>one point<li>another point</ul><table><tr><td>cell a<td>cell b</table>
<form>Your name <input name=a><button>Send</button></form><p>Last paragraph.</p></{tag}>
<section id="comments"><p>I do not agree with this article at all, said a reader.</p></section>
<aside>Related stories are listed in here.</aside><footer>&copy; all rights reserved</footer></body></html>"""
STORY = "The story First bold & plain text of the story goes on for a while. Second paragraph with a break. one point another point cell a cell b Last paragraph."


def test_main_text_with_and_without_an_article_element(spark):
    pages = spark.createDataFrame([(1, PAGE.replace("{tag}", "article")), (2, PAGE.replace("{tag}", "div")), (3, None), (4, ""), (5, "plain words only"), (6, "<p>cut <b"), (7, "<nav><a>only menu</a></nav>"), (2, PAGE.replace("{tag}", "div"))], "page_id bigint, html string")
    w = html.learn(pages)
    got = collections.defaultdict(list)
    for r in html.extract(pages, w).collect():
        got[r.page_id].append(r.main_text)
    assert got == {1: [STORY], 2: [STORY, STORY], 3: [""], 4: [""], 5: ["plain words only"], 6: ["cut"], 7: [""]}
    assert html.extract(pages.limit(0), html.learn(pages.limit(0)), out="html").columns == ["page_id", "html"]


def test_main_text_inside_marked_wrappers_and_forms(spark):
    wraps = ['<div class="layout has-sidebar">', '<div id="menu-open">', '<section class="social-science">', '<div class="ad-free"><div class="with-banner">', '<form action="x">', '<div class="banner">']
    close = lambda w: "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", w)))
    inner = re.search(r"<body[^>]*>(.*?)(</body>|$)", PAGE, re.S)[1] if "<body" in PAGE else PAGE
    pages, tail = [], '<div class="site-sidebar"><p>Buy shoes now</p></div><div class="comments"><article>I like it</article></div>'
    for tag in ("article", "div"):
        for w in wraps:
            pages.append(f"<html><body>{w}{inner.replace('{tag}', tag)}{tail}{close(w)}</body></html>")
    pages.append(f'<html><body class="has-sidebar">{inner.replace("{tag}", "div")}{tail}</body></html>')
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    w = html.learn(spark.createDataFrame([(1, PAGE.replace("{tag}", "article"))], "page_id bigint, html string"))
    got = {r.page_id: r.main_text for r in html.extract(df, w).collect()}
    assert got == {i: STORY for i in range(len(pages))}


def test_best_region_is_the_greatest_sum():
    rng = random.Random(6)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 14))]
        a, b = html.best_region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


# toxicity


def test_toxicity_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.predicted) for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect() if r.doc_id in labels]
    hits = sum(y and p for y, p in got)
    assert hits >= 0.9 * sum(y for y, _ in got) and hits >= 0.95 * sum(p for _, p in got)


def test_factorization_learns_pairs(spark):
    """Either word alone is clean, both together are toxic: no sum of single weights below the threshold can say so as clearly."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append((i, " ".join(rng.choices(["tree", "house", "river", "cloud", "stone"], k=6) + ["group"] * a + ["insult"] * b)))
        labels.append((i, int(a and b)))
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    m = toxic.fit(docs, labels, evidence=3.0, epochs=60)
    said = {r.text: r.toxicity for r in toxic.score(spark.createDataFrame([(1, "tree group"), (2, "tree insult"), (3, "tree group insult"), (4, None), (5, "")], DOC), m).collect()}
    assert said["tree group insult"] > 0.6 > 0.3 > max(said["tree group"], said["tree insult"], said[None])
    assert said[None] == said[""]


def test_toxic_pairs_are_learned_where_each_word_alone_is_at_the_base_rate(spark):
    """As fit does it by default; a pair's words are in as many toxic rows as any, as other rows are toxic by a word of their own."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3_000):
        a, b = i % 5 == 0, i // 5 % 5 == 0
        c = i // 25 % 4 == 0 and not (a or b)
        rows.append((i, " ".join(rng.choices(["tree", "house", "river", "cloud", "stone", "wall", "field"], k=6) + ["group"] * a + ["insult"] * b + ["slur"] * c)))
        labels.append((i, int(a and b or c)))
    m = toxic.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    base = sum(y for _, y in labels) / len(labels)
    for word in ("group", "insult"):
        mine = [y for (_, t), (_, y) in zip(rows, labels) if word in t]
        assert abs(sum(mine) / len(mine) - base) < 0.01
    said = {r.text: r.toxicity for r in toxic.score(spark.createDataFrame([(1, "tree group"), (2, "tree insult"), (3, "tree group insult"), (4, "tree slur"), (5, "tree")], DOC), m).collect()}
    assert min(said["tree group insult"], said["tree slur"]) > 0.6 > 0.3 > max(said["tree group"], said["tree insult"], said["tree"])


def test_toxicity_margin_is_that_of_all_pairs():
    rng = np.random.default_rng(1)
    m = toxic.Model(0.3, rng.normal(0, 1, 50), rng.normal(0, 1, (50, 3)))
    term, count = np.array([1, 4, 9, 9, 2, 30, 31]), np.array([3, 0, 4])
    want = []
    for t in ([1, 4, 9], [], [9, 2, 30, 31]):
        want.append(0.3 + sum(m.w[i] for i in t) + sum(m.v[a] @ m.v[b] for k, a in enumerate(t) for b in t[k + 1 :]))
    assert np.allclose(toxic.margins(term, count, m), want)


def test_toxicity_odd_texts(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, None), (None, 1), (6, 0), (6, 1)], "doc_id bigint, toxic int")
    got = toxic.score(odd, toxic.fit(odd, labels), out="kept")
    assert got.columns == odd.columns and all(0 <= r.kept <= 1 for r in got.collect())
    assert toxic.score(none, toxic.fit(none, labels)).count() == 0


# near duplicates


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = tokens(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in texts}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = {}
    for g in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // rng.choice([12, 25, 60])))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += passage
            texts[len(texts)] = rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.1 else x for x in w)
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), DOC)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """Lists longer than a block are compared block by block with the same result."""
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = random.Random(19)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), DOC)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd_texts(odd, none):
    got = near.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (0, 1, 2))
    assert {r.component_id for r in got if r.doc_id in (7, 8, 9)} == {7}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None)]
    assert near.near_duplicates(none).count() == 0
    assert near.keep_one(odd).columns == odd.columns and near.keep_one(none).count() == 0


# decontamination


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(800):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        assert decontam.Pattern(p).best(t) == distance(p, t)


def test_contaminations_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    items = {i: " ".join(word() for _ in range(rng.randint(3, 30))) + rng.choice(["", "."]) for i in range(20)}
    texts = {}
    for d in range(80):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            x = list(items[rng.randrange(20)])
            for _ in range(rng.randint(0, max(1, len(x) // 9))):
                i = rng.randrange(len(x))
                x[i : i + rng.randint(0, 1)] = rng.choice(["", "f", "G", "é"])
            w.insert(rng.randrange(len(w) + 1), "".join(x).upper())
        texts[d] = "  ".join(w)
    want = set()
    for d, t in texts.items():
        for i, x in items.items():
            n = decontam.normal(x)[1:-1]
            if len(n) >= decontam.LEAST_CHARS and distance(n, decontam.normal(t))[0] <= len(n) // decontam.CHARS_PER_EDIT:
                want.add((d, i, distance(n, decontam.normal(t))[0]))
            elif len(n) < decontam.LEAST_CHARS and f" {n} " in decontam.normal(t):
                want.add((d, i, 0))
    got = decontam.contaminations(spark.createDataFrame(list(texts.items()), DOC), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and want
    for r in got:
        if r.distance == 0:
            assert decontam.normal(texts[r.doc_id][r.start : r.end]) == decontam.normal(items[r.item_id])


def test_contaminations_odd_texts_and_blocks(spark, odd, none, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "w " * 20)], "item_id bigint, text string")
    out = decontam.find_items(odd, odd_items, out="kept")
    assert out.columns == odd.columns and {r.doc_id for r in out.collect() if r.kept} == {6}
    assert decontam.contaminations(none, bench).count() == 0 and decontam.contaminations(odd, bench.limit(0)).count() == 0
    whole = sorted(map(tuple, decontam.contaminations(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1_500)
    assert sorted(map(tuple, decontam.contaminations(docs, bench).collect())) == whole and whole


def test_short_items_and_items_of_symbols(spark):
    items = [(1, "What is two plus two?"), (2, "∑ ≤ ∞"), (3, "yes"), (4, "?!"), (5, "  "), (6, None)]
    texts = [(10, "Q: what is TWO plus two"), (11, "what is two plus twoo"), (12, "we have ∑  ≤\n∞ here"), (13, "∑≤∞"), (14, "yesterday"), (15, "Well, yes."), (16, "odd ?! marks"), (17, "odd?! marks"), (18, None)]
    got = decontam.contaminations(spark.createDataFrame(texts, DOC), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(10, 1, 0), (12, 2, 0), (15, 3, 0), (16, 4, 0)}
    text = dict(texts)
    assert {text[r.doc_id][r.start : r.end] for r in got} == {"what is TWO plus two", "∑  ≤\n∞", "yes", "?!"}


CLASH = ["_id", "_sha", "_cut", "_as_id", "_as_text", "_items0", "items0", "row", "id", "digest", "gone_id", "found_id", "found_sha", "as_id", "as_text", "passage_id", "passage_cut", "stays", "kept", "word", "n", "h1"]


def test_columns_of_any_name_pass_through(spark):
    """Every operator that gives back its input's rows keeps columns named like its own helpers."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long), (2, long), (2, long.upper()), (3, long + " x"), (4, None), (5, "few words"), (None, "few words")]
    df = spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(rows)], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASH))
    bench = spark.createDataFrame([(1, "few words")], "item_id bigint, text string")
    for out in (exact.keep_one(df), near.keep_one(df), chunks.without_repeats(df.where("doc_id is not null").dropDuplicates(["doc_id"])), decontam.find_items(df, bench, out="found").drop("found"), toxic.score(df, toxic.fit(df, df.select("doc_id", F.lit(1).alias("toxic")))).drop("toxicity")):
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[c].startswith(c) and r[c][len(c):] == r["_id"][3:] for c in CLASH)


# exact duplicates


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(3)
    index, live = exact.CuckooIndex(2), {}
    for step in range(6_000):
        d = hashlib.sha256(str(rng.randrange(1_500)).encode()).digest()
        if rng.random() < 0.7:
            index.insert(d, (step, step), 1)
            live[d] = live.get(d, 0) + 1
        else:
            assert index.delete(d) == (live.pop(d, None) is not None)
    assert {e[0]: e[2] for e in index.entries.values()} == live and index.resizes > 0
    assert all((index.find(hashlib.sha256(str(i).encode()).digest()) is not None) == (hashlib.sha256(str(i).encode()).digest() in live) for i in range(1_500))


def test_cuckoo_index_with_equal_places():
    """Digests that share fingerprint and buckets are told apart by their content."""
    index = exact.CuckooIndex(2)
    same = [b"\1" * 10 + bytes([i]) * 22 for i in range(8)]
    for i, d in enumerate(same):
        index.insert(d, (i, i), 1)
    assert [index.entries[index.find(d)][1][0] for d in same] == list(range(8))


def test_index_table_updates(spark, docs):
    rows = exact.digests(docs)
    half, rest = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    whole = {(bytes(r.digest), r.rows) for r in exact.build(rows, 3).collect()}
    assert {(bytes(r.digest), r.rows) for r in exact.update(exact.build(half, 3), 3, insert=rest).collect()} == whole
    left = exact.update(exact.build(rows, 3), 3, delete=half)
    gone = {bytes(r.digest) for r in half.collect()}
    assert {bytes(r.digest) for r in left.collect()} == {d for d, _ in whole} - gone


def test_exact_dedup_odd_texts(spark, odd, none):
    got = exact.exact_dedup(odd).collect()
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    for rows in groups.values():
        assert sum(r.kept for r in rows) == 1 and all(r.group_size == len(rows) and r.keep_id == max((x.doc_id for x in rows if x.doc_id is not None), default=None) for r in rows)
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns and sorted(low(r.text) for r in kept.collect()) == sorted({low(t) for t in [*ODD, "no id"]})
    assert exact.exact_dedup(none).count() == 0 and exact.keep_one(none).count() == 0


def test_keep_one_takes_one_of_rows_that_repeat_id_and_normalised_text(spark):
    docs = spark.createDataFrame([(1, "Abc"), (1, "aBC"), (2, None), (2, ""), (3, "abc d"), (3, "other"), (None, "n"), (None, "N")], DOC)
    assert sorted((r.doc_id or 0, low(r.text)) for r in exact.keep_one(docs).collect()) == [(0, "n"), (1, "abc"), (2, ""), (3, "abc d"), (3, "other")]


def test_bitmaps_reach_the_workers_as_files(spark, monkeypatch):
    """The same bits as ``bitmap`` with no bitmap collected or broadcast by the driver (before, it did both); repeated passages find them there."""
    from tenura.llm import chunks, common

    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    want = common.bitmap(hashes)
    monkeypatch.setattr(common, "bitmap", None)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("the driver sent a bitmap"))
    got = common.SharedBits(hashes.repartition(5), "bits")
    assert (np.asarray(got.value) == want).all() and os.listdir(os.path.dirname(got.path)) == ["bits"]
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"one two {words}"), (2, f"three {words} four"), (3, "other")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["words"], r["first"]) for r in chunks.repeated_passages(docs).collect())
    assert found == [(1, 40, True), (2, 40, False)]
