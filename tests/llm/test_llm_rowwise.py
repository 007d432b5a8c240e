"""Line dedup, quality rules, packing, languages, licences, pages, chats: edge cases and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import chat_format, html_extract, language_id, license_scan, line_dedup, packing, quality_rules

SCHEMA = "doc_id long, text string, lang string, n_lines long, __x string"


def table(spark, texts, ids=None):
    """Documents with extra columns, one of them named like a result's."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD = [None, "", " ", "\n\n", "a", "a\na\nb", "Same line.\nother", "same LINE. \nmore", "\tSAME line.\x0b", "x" * 50_000 + "\nsame line.", "a\na\nb"]


# --- line dedup ---------------------------------------------------------------


def lines_by_hand(texts, ids, min_docs, keep_first):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    docs = defaultdict(set)
    for n, t in enumerate(texts):
        for x in (t or "").split("\n"):
            docs[key(x)].add(n)
    bad = {k for k, v in docs.items() if k and len(v) >= min_docs}
    first = {k: min((ids[n] for n in docs[k] if ids[n] is not None), default=None) for k in bad}
    out = []
    for i, t in zip(ids, texts, strict=True):
        seen, kept = set(), []
        for x in (t or "").split("\n"):
            k = key(x)
            if k in bad:
                if not keep_first or first[k] != i or k in seen:
                    continue
                seen.add(k)
            kept.append(x)
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_lines(spark, keep_first, broadcast):
    ids = [*range(len(ODD) - 2), None, 3]
    docs = table(spark, ODD, ids)
    out = line_dedup.dedup_lines(docs, min_docs=3, keep_first=keep_first, broadcast_bytes=broadcast)
    assert out.schema["doc"].dataType.names == docs.columns
    got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)
    assert got == lines_by_hand(ODD, ids, 3, keep_first)


def test_lines_many_texts_and_full_filter(spark):
    rng = random.Random(1)
    texts = ["\n".join(f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    docs = table(spark, texts).repartition(5)
    for bits in (line_dedup.SHARD_BITS, line_dedup.SHARD_BITS * 4):
        out = line_dedup.dedup_lines(docs, min_docs=10, max_bits=bits)
        got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)
        assert got == lines_by_hand(texts, list(range(300)), 10, False)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_bloom_pair_never_misses():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    bits = line_dedup.SHARD_BITS
    a, b = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for x in line_dedup._positions(h[:2000], bits):
        line_dedup._put(a, x)
    for x in line_dedup._positions(h[1000:], bits):
        line_dedup._put(b, x)
    both = a & b
    assert np.logical_and.reduce([line_dedup._has(both, x) for x in line_dedup._positions(h[1000:2000], bits)]).all()
    assert (line_dedup._unpack(line_dedup._pack(a)) == a).all()


# --- quality rules ------------------------------------------------------------


def test_quality_counts_by_hand(spark):
    texts = [*ODD, "one two three one two three", "a b c d a b c", "w " * 60 + ".", "Menu | Home"]
    for r in quality_rules.quality(table(spark, texts)).collect():
        text = r.doc.text or ""
        words = text.encode().split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == (len(words), sum(len(w.decode()) for w in words), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(covered))


def test_quality_verdicts(spark):
    prose = " ".join(f"Sentence{i} number{i} ends{i} here{i}." for i in range(20))
    junk = " ".join(f"word{i}###" for i in range(80))
    texts = [prose, junk, prose + "\nHome | Login | Menu\nAll rights reserved.", prose + "\n" + "\n".join(f"no stop in this line {i} at all and so on {i * 7}" for i in range(60)), None]
    got = {r.doc.doc_id: r for r in quality_rules.quality(table(spark, texts)).collect()}
    assert [got[i]["kept"] for i in range(5)] == [True, False, True, False, False]
    assert got[2]["clean"] == prose and got[4]["clean"] is None
    assert quality_rules.quality(table(spark, [])).count() == 0


# --- packing ------------------------------------------------------------------


def test_packing_is_whole_and_gapless(spark, sf):
    from tokenizers import Tokenizer

    texts = [*ODD, "alpha beta. gamma " * 3000, "don't stop, now! " * 40, None, "<|endoftext|> X."]
    ids = [*range(len(texts) - 1), 0]
    rows = packing.pack(table(spark, texts, ids)).collect()
    tk = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        own = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(own), 4096):
            part = own[p : p + 4096]
            want[i, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(table(spark, [])).count() == 0


def plain_best_fit(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [x for x in left if x >= s]
        if fit:
            left.remove(min(fit))
        left.append((min(fit) if fit else capacity) - s)
    return len(left)


def fewest(sizes, capacity):
    """Exact number of bins of a few items."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[k] >= sizes[i]:
                bins[k] -= sizes[i]
                go(i + 1, bins)
                bins[k] += sizes[i]
        bins.append(capacity - sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randrange(6, 40)
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_instance(counts, capacity)
        n = sum(k for _, k in fixed)
        rest = [s for s in range(capacity, 0, -1) for _ in range(counts[s])]
        assert n + fewest(rest, capacity) == fewest(sizes, capacity)


def test_runs_hold_every_item_once():
    rng = np.random.default_rng(0)
    for _ in range(60):
        capacity = int(rng.integers(5, 60))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(0, 150)))
        counts = np.bincount(sizes, minlength=capacity + 1)
        table_, n = packing.slot_runs(counts, capacity)
        used = Counter()
        for length in np.unique(sizes):
            runs = table_[table_[:, 0] == length]
            for rank in range(counts[length]):
                run = runs[np.searchsorted(runs[:, 1], rank, side="right") - 1]
                step = rank - run[1]
                for cell in range(run[4] + step % run[2] * length, run[4] + step % run[2] * length + length):
                    used[run[3] + step // run[2], cell] += 1
        assert set(used.values()) <= {1} and len(used) == sizes.sum() and all(c < capacity for _, c in used)
        assert n <= plain_best_fit(list(sizes), capacity)


# --- languages ----------------------------------------------------------------


def test_language_profiles_by_hand(spark):
    texts = ["the cat and the dog.", "le chat et le chien, là", None, "12 34", "the the the", "le le"]
    docs = spark.createDataFrame(list(zip(range(6), texts, ["en", "fr", "en", "en", None, "fr"], strict=True)), "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(docs.filter("doc_id < 4"), profile_size=30)

    def grams(t):
        out = Counter()
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = f" {w} "
            out.update(w)
            out.update(p[i : i + 2] for i in range(len(p) - 1))
            out.update(p[i : i + 3] for i in range(len(p) - 2))
        return out

    code = lambda g: sum((1 if c == " " else ord(c)) << (21 * i) for i, c in enumerate(reversed(g)))
    want = [code(g) for g, _ in sorted(grams(texts[0]).items(), key=lambda x: (-x[1], code(x[0])))[:30]]
    assert [r.gram for r in profiles.filter("lang = 'en'").orderBy("rank").collect()] == want
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, profiles, profile_size=30).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "fr", "und", "und", "en", "fr"] and got[2][1] == 0 and 0 < got[0][1] <= 1
    none = language_id.predict(docs, profiles.limit(0))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark, sf):
    out = language_id.op9_language_id(spark, sf.replace("sf0.001", "sf0.01"))
    truth = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "lang")
    right = out.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# --- licences -----------------------------------------------------------------


def test_licences(spark):
    mit = license_scan._MIT
    whole = "The MIT Licence (MIT)\nCopyright (c) 2020, Some One\n\n" + mit.upper().replace("COPYRIGHT HOLDERS", "copyright holders")
    texts = [whole, "Text.\nReleased under the M I T License.", "Text.\n  released UNDER the  MIT licence!\nLicensed under Creative Commons BY NC 4.0", whole + " and more", None, "", "Copyright (c) 2020 x"]
    got = {r.doc_id: (r.license_id, r.n_notices) for r in license_scan.scan(table(spark, texts)).collect()}
    assert got[0] == ("MIT", 0)
    assert got[1] == (None, 0) and got[2] == ("CC-BY-NC-4.0", 2)
    assert [got[i] for i in (3, 4, 5, 6)] == [(None, 0)] * 4
    assert license_scan.scan(table(spark, [])).count() == 0


def test_licences_by_digest_or_without_mark(spark):
    import os
    import re

    assert all(re.search(license_scan.MARK, t) for _, t in license_scan.TEXTS + license_scan.NOTICES)
    own = (("Own", "Do as you like.\nNo one minds."), ("Own", "Do as you please."))
    long = " ".join(f"word{i}" for i in range(200_000))
    texts = ["DO AS YOU LIKE\n\nno one -- minds", "x\ndo as you please!\ndo as you please", long, long, "Do as you"]
    rows = license_scan.scan(table(spark, texts, [0, 1, 2, 2, None]), own, ()).collect()
    assert Counter((r.doc_id, r.license_id, r.n_notices) for r in rows) == Counter([(0, "Own", 0), (1, "Own", 2), (2, None, 0), (2, None, 0), (None, None, 0)])
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [n for n in names if os.path.exists(f"{folder}/{n}")]
    texts = [open(f"{folder}/{n}", encoding="utf-8").read() for n in found]
    texts += [t.upper().replace("\n", "\n  ") + "\n" for t in texts]
    got = {r.doc_id: r.license_id for r in license_scan.scan(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [names[n] for n in found] * 2


# --- pages --------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>Menu</nav>
<div class="cookie-notice">We use cookies</div><div id="wrap"><div class="content post-123"><h2>Title &amp; more</h2><p>First <a href=x>link</a> text.<p>Second <b>bo</b>ld<br>line
<ul><li>one<li>two</ul><div class="ad">Buy</div><form>Name<button>Go</button></form><script>var t="</p>"</script><table><tr><td>c1<td>c2</table><!-- no -->
<div class="comments"><p>Nice post! a really long comment, the longest text of the page by far, again and again</p></div></div><aside>side</aside></div><footer>foot</footer></body></html>"""


def test_page_text():
    found = html_extract.parse(PAGE)
    assert html_extract.text_of(found, []) == "Title & more First link text. Second bold line one two c1 c2"
    assert html_extract.text_of(html_extract.parse("<p>a<div>b</p>c"), []) == "a b c"


def test_page_names_and_inline_elements():
    """Names prune only where all their words say so, text elements only as adverts or comments; pictures and break chances are no blocks."""
    inside = {
        '<p class="legal">The court ruled.</p>': "The court ruled.",
        '<section class="search-results-study">We asked.</section>': "We asked.",
        '<div class="commentary">It holds.</div>': "It holds.",
        "super<wbr>cali price<img src=x>less <ruby>漢<rt>kan</rt></ruby>": "supercali priceless 漢kan",
        '<span class="hljs-comment">// no</span>': "// no",
        '<p class="advert">Buy</p><span class="ad">now</span><p class="comment">Nice</p>': "",
        '<div class="ad-slot">Buy</div><div class="cookie-banner">We use</div><section id="user-comments">Hm</section><ul class="share-buttons"><li>Share</ul>': "",
        '<div class="legal">Imprint</div><div class="related-posts">More</div><div class="searchBox">Find</div>': "",
    }
    for part, want in inside.items():
        found = html_extract.parse(f"<body><article><p>Start of it.</p>{part}<p>End of it.</p></article></body>")
        assert html_extract.text_of(found, []) == " ".join(x for x in ("Start of it.", want, "End of it.") if x)
    found = html_extract.parse("<article>" + "<p>One of many words.</p>" * 50_000 + "</article>")  # very long
    assert html_extract.text_of(found, []) == " ".join(["One of many words."] * 50_000)


def test_pages_vote_by_host(spark, sf):
    odd = "<body><main><p>short</p></main><div class='teaser'><p>%s</p></div></body>" % ("a longer teaser text here " * 5)
    same = "<body><main><p>%s</p></main></body>" % ("the article of this page goes on " * 9)
    rows = [(i, "http://h.org/1", same) for i in range(5)] + [(9, "http://h.org/2", odd), (10, None, None), (11, "no url", ""), (12, "http://x.y/z", "plain words"), (12, "http://x.y/z", "plain words")]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    for limit in (100, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages, broadcast_hosts=limit).collect()}
        assert got[9] == ("short", 5) and got[10] == ("", 0) and got[11] == ("", 0) and got[12] == ("plain words", 11)
    assert html_extract.extract(pages).count() == 10 and html_extract.extract(pages.limit(0)).count() == 0


def test_pages_of_a_host_with_many_templates(spark):
    body = "<p>%s</p>" % ("the article of this page goes on " * 9)
    rows = [(i, "http://h.org/1", f"<body><div class='t{'abcdef'[i % 6]}'>{body}</div></body>") for i in range(12)]
    rows.append((20, "http://h.org/2", f"<body><div class='rare'>{body}</div><div class='rare'>second</div><div class='rare'>third</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (100, 0):
        got = {r.page_id: r.text for r in html_extract.extract(pages, broadcast_hosts=limit).collect()}
        assert len(got) == 13 and got[20].endswith("goes on second third") and got[0].endswith("goes on")


def test_pages_of_the_test_data(spark, sf):
    import html
    import re

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op8_html_extraction(spark, sf).collect():
        part = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", " ", re.sub(r"</?b>", "", part))).split())
        assert (r.text, r.n_chars) == (want, len(want))


# --- chats --------------------------------------------------------------------


def test_chats(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIn Python please."),
        (1, 1, "assistant", "> how do I SORT a list\n\nUse the sorted function."),
        (1, 2, "user", "Something else entirely here."),
        (1, 3, "user", "Ann wrote:\n> Use the sorted function.\n>> How do I sort a list?\nThanks a lot!"),
        (1, 4, "user", "> nobody ever said this line\nok then"),
        (2, 0, "user", "> Use the sorted function.\nother conversation"),
        (None, None, None, None), (3, 0, "user", "Same message twice."), (3, 0, "user", "Same message twice."), (3, 1, "user", "> Same message twice.\n> > > deeper\nyes"),
    ]
    chats = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, body string")
    got = {(r.conv_id, r.turn, r.body): r for r in chat_format.format_chats(chats).collect()}
    assert len(chat_format.format_chats(chats).collect()) == len(rows)
    assert got[1, 1, "Use the sorted function."].reply_to == 0
    three = got[1, 3, "Thanks a lot!"]
    assert (three.reply_to, three.thread, three.n_quotes, three.n_linked) == (1, 0, 2, 2)
    four = got[1, 4, "ok then"]
    assert (four.reply_to, four.thread, four.n_quotes, four.n_linked) == (None, 4, 1, 0)
    order = [k[1] for k, _ in sorted(((k, r) for k, r in got.items() if k[0] == 1), key=lambda x: x[1].position)]
    assert order == [0, 1, 3, 2, 4]
    assert got[2, 0, "other conversation"].reply_to is None and got[3, 1, "yes"].reply_to == 0
    assert got[None, None, ""].position == 0
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_chats_quote_passages(spark):
    long = "The first part of a long line, which goes on and on, and the last part of it."
    rows = [
        (1, 0, long),
        (1, 1, "> The first part of a long line, which\n> goes on and on, and\n> the last part of it.\nWrapped."),
        (1, 2, "One line of mine.\nAnd a second one.\n\nA third."),
        (1, 3, "> One line of mine. And a second one. A third.\nJoined."),
        (1, 4, "I agree"),
        (1, 5, "> I agree\nShort."),
        (1, 6, "> One line of mine.\n> [...]\n> A third.\nCut."),
        (1, 7, ">> goes on and on\n> Bob wrote:\n>> I agree\n> Joined.\nDeep."),
        (1, 8, "> agree with\nNot said."),
    ]
    got = {r.turn: r for r in chat_format.format_chats(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert {t: got[t].reply_to for t in (1, 3, 5, 6, 7, 8)} == {1: 0, 3: 2, 5: 4, 6: 2, 7: 3, 8: None}
    assert [(got[t].n_quotes, got[t].n_linked) for t in (1, 3, 5, 6, 7, 8)] == [(1, 1)] * 4 + [(3, 3), (1, 0)]
    assert got[7].thread == 2 and got[7].body == "Deep."


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_chats_by_sql(spark):
    """One-word, nested, wrapped and repeated quotes, sibling branches and a null conversation, against the SQL."""
    rng = random.Random(7)
    lines = ["Yes.", "Is it?", "The cat is on the mat, yes sir.", "Why?", "I agree with this plan", "plan", "So be it", "yes sir"]
    rows = []
    for conv in (1, 2, None, -(2**63)):
        said: list[str] = []
        for turn in range(14):
            parts = []
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                body = rng.choice([*said, *lines]) if said else rng.choice(lines)
                quoted = [x for x in body.split("\n") if x][: rng.randint(1, 3)]
                if rng.random() < 0.3:
                    quoted = " ".join(quoted).replace(", ", ",\n").split("\n")
                parts += [rng.choice(["> ", ">", ">> ", " > > "]) + q for q in quoted]
                parts.append(rng.choice(["", "Ann wrote:", rng.choice(lines)]))
            own = [rng.choice(lines) for _ in range(rng.randint(1, 3))]
            rows.append((conv, turn, "user", "\n".join([*parts, *own])))
            said.append("\n".join(own))
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    # Null does not join in SQL, and stands for itself in the other conversations' place.
    table = pa.table({"conv_id": pa.array([-1 if r[0] is None else r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    con = duckdb.connect()
    con.register("conversations", table)
    rel = con.sql(chat_format.SQL)
    want = sorted(rel.fetchall(), key=str)
    names = [c for c in rel.columns]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(-1 if c == "conv_id" and r[c] is None else r[c] for c in names) for r in got.collect()), key=str) == want
    assert sum(r[names.index("n_linked")] for r in want) > 20


def test_chats_in_any_shape(spark):
    """A long chain of replies, and many replies to one message, in reply order."""
    chain = [(1, 0, "u", "start of it 0")] + [(1, t, "u", f"> start of it {t - 1}\nstart of it {t}") for t in range(1, 40)]
    star = [(2, 0, "u", "The question")] + [(2, t, "u", f"> The question\nanswer {t}" if t % 2 else f"> answer {t - 1}\ncomment {t}") for t in range(1, 30)]
    got = chat_format.format_chats(spark.createDataFrame(chain + star, "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == list(range(40))
    assert {r.thread for r in got if r.conv_id == 1} == {0}
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position)]
    assert order == list(range(30))
    nested = [(3, 0, "u", "Root one"), (3, 1, "u", "> Root one\nFirst answer"), (3, 2, "u", "> Root one\nSecond answer"), (3, 3, "u", "> First answer\nBack to the first"), (3, 4, "u", "Other root")]
    got = chat_format.format_chats(spark.createDataFrame(nested, "conv_id long, turn long, role string, text string")).collect()
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == [0, 1, 3, 2, 4]


def test_odd_column_names(spark):
    """Names with dots, and those that the operators use themselves."""
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "x"), (2, "der hund und die katze", "de", "y"), (3, None, "de", "z"), (4, "der der der", None, "z")], "`the.id` long, `a.text` string, `rank` string, gram string")
    profiles = language_id.learn_profiles(docs, "a.text", "rank")
    got = language_id.predict(docs.unionAll(docs.limit(1)), profiles, "the.id", "a.text").collect()
    assert sorted((r["the.id"], r.lang_pred) for r in got) == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "de")]
    assert language_id.predict(docs.limit(0), profiles, "the.id", "a.text").collect() == []
    longest = spark.createDataFrame([(9, "der hund und die katze " * 40_000)], "`the.id` long, `a.text` string")
    assert language_id.predict(longest, profiles, "the.id", "a.text").first().lang_pred == "de"
    html = "<html><body><article><p>One text of some length, which stands here.</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.b/c", html, "n"), (2, None, None, "m")], "`p.id` long, host string, `the.html` string, path string")
    for hosts in (1000, 0):
        out = html_extract.extract(pages, "p.id", "host", "the.html", broadcast_hosts=hosts)
        assert out.columns == ["p.id", "host", "text", "n_chars"]
        assert sorted((r["p.id"], r["host"], r.text) for r in out.collect()) == [(1, "http://a.b/c", "One text of some length, which stands here."), (2, None, "")]


def test_profiles_are_cut_before_they_meet(spark):
    docs = spark.createDataFrame([("a b c", "x")], "text string, lang string")
    assert "WindowGroupLimit" in language_id.learn_profiles(docs)._jdf.queryExecution().executedPlan().toString()
