"""BPE, PII, licenses, HTML, language ID, quality, CTW, fingerprints: against brute force, round trips or held-out rows."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlake.llm import bpe, ctw, fingerprint, html, langid, licenses, pii, quality
from factlake.llm._common import buffers

DOC = "doc_id long, text string, lang string, source string, n_chars long, `count` long, sketch string, key string, part int"
LONG = "word other words " * 20000


def odd_rows(spark):
    """Nulls in all columns, empty and long texts, repeated rows, clashing column names."""
    rows = [(1, "Hello there, world. Call +1 (974) 555-3436", "en", "a", 5), (1, "Hello there, world. Call +1 (974) 555-3436", "en", "a", 5), (2, None, None, None, None), (None, "no id here", "en", "a", 1),
            (3, "", "en", None, 0), (4, LONG, "en", "b", 1), (5, "!!! ???", "fr", "b", 2), (6, "日本語 🙂", None, "c", 3)]
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], DOC)


# BPE -----------------------------------------------------------------------------------------------------------------

def slow_bpe(piece: bytes, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return tuple(ranks[p] for p in parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_matches_naive_merging_and_library():
    import tiktoken

    ranks = bpe.load_ranks(bpe.VOCABULARY)
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice("aeiouthnrsé <!") for _ in range(rng.randint(0, 30))).encode()
        assert bpe.merge(piece, ranks) == slow_bpe(piece, ranks)
    enc = bpe.Encoder(ranks)
    lib = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    for t in ["", "It's  the\n\n end ", "1234 ab", "日本語🙂 é", "a" * 300]:
        assert enc.encode(t) == lib.encode_ordinary(t) and enc.decode(enc.encode(t)) == t


def test_bpe_side_by_side(monkeypatch):
    """Short pre-tokens are merged side by side, none by itself, as the queue merges them; texts are split alike by both patterns."""
    import regex

    ranks = bpe.load_ranks(bpe.VOCABULARY)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("aeiouthnrsé <!ß日🙂") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["a" * n for n in range(1, 33)] + ["thething" * 4, " internationalisation", "\0\0"]
    want = {p: [*bpe.merge(p.encode(), ranks)] for p in pieces}
    both = "".join(chr(c) for c in range(bpe.SIMPLE)) + "".join(rng.choice("a é'sé\x1c\x85\xa0 \t\n5²") + rng.choice("  'tx1") for _ in range(4000))
    enc = bpe.Encoder(ranks)
    assert enc.find(both) == regex.findall(bpe.SPLIT, both) and enc.find(both + "日 本") == regex.findall(bpe.SPLIT, both + "日 本")
    with monkeypatch.context() as m:
        m.setattr(bpe, "merge", None)
        enc.learn({p for p in want if len(p.encode()) <= 32})
    assert all(bpe.array("i", enc[p]).tolist() == ids for p, ids in want.items())
    m = "word" * 3000  # long ones by the queue, remembered or not
    assert enc.decode(enc.encode(m)) == m and m not in enc
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert enc.encode(" ".join(pieces)) == [*bpe.array("i", b"".join(map(enc.__getitem__, enc.find(" ".join(pieces)))))] and enc.decode(enc.encode(both)) == both


def test_bpe_query_round_trip(spark):
    df = odd_rows(spark)
    out = bpe.encode_decode(df)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "decoded"]
    got = sorted(((r.doc_id or 0, r.decoded, r.n_tokens) for r in out.collect()), key=str)
    assert [g[1] for g in got] == [r[1] for r in sorted(((r.doc_id or 0, r.text) for r in df.collect()), key=str)]
    assert out.where("decoded IS NULL AND token_ids IS NOT NULL").count() == 0
    assert bpe.encode_decode(df.limit(0)).count() == 0


# PII -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [2, 3, 7, 16, 100, 257])
def test_permuter_is_a_bijection_without_fixed_points(n):
    p = pii.Permuter("key")
    image = [p.forward("x", i, n) for i in range(n)]
    assert sorted(image) == list(range(n)) and all(i != j for i, j in enumerate(image))
    assert [p.backward("x", j, n) for j in image] == list(range(n))
    assert image != [pii.Permuter("other").forward("x", i, n) for i in range(n)] or n < 4


def test_pii_formats_and_links():
    p = pii.Pseudonymiser("key")
    card = "4929348385146306"
    new, n = p(f"{card} and {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}")
    a, b = new.split(" and ")
    assert n == 2 and a != card and b.replace(" ", "") == a and pii.luhn_digit(a[:-1]) == a[-1]
    assert p("1787556152378721") == ("1787556152378721", 0)  # fails its check digit
    x, y = p("2024-02-29")[0], p("29.02.2024")[0]
    assert x != "2024-02-29" and x == "-".join(reversed(y.split(".")))
    assert p("2024-02-30 999.1.1.1 000-12-1234")[1] == 0
    iban = p("DE89370400440532013000")[0]
    assert iban[:2] == "DE" and len(iban) == 22 and pii._iban_mod(iban) == 1
    mail = p("jo.an12@mail.example.com")[0]
    assert mail.endswith("@mail.example.com") and mail[2] == "." and mail != "jo.an12@mail.example.com"
    ssn = p("123-45-6789")[0]
    assert ssn != "123-45-6789" and p(ssn)[1] == 1
    phone = p("+1 (974) 555-3436")[0]
    assert phone.startswith("+1 (") and phone != "+1 (974) 555-3436"
    key = p('"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"')[0]
    assert len(key) == 42 and key != '"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("after", ["", " BIC", " BIC: X", " BBRUBEBB", " 2024 and", " GB82 WEST 1234 5698 7654 32", " 4929348385146306"])
def test_iban_before_other_tokens(iban, after):
    new, n = pii.Pseudonymiser("key")(f"pay {iban}{after}")
    own = new[4 : 4 + len(iban)].replace(" ", "")
    assert iban not in new and pii._iban_mod(own) == 1 and n == (2 if len(after) > 16 else 1)
    assert len(new) == len(f"pay {iban}{after}") and (n == 2 or new.endswith(after))
    assert pii.Pseudonymiser("key")("ID12 3456 7890 4929348385146306")[1] == 1  # no IBAN, but a card in what it took


@pytest.mark.parametrize("digits", [128, 512, 1024, 5000])
def test_long_secrets_are_permuted_whole(digits):
    rng = random.Random(digits)
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(digits))
    new, n = pii.Pseudonymiser("key")(f"key={secret}.")
    kept = sum(a == b for a, b in zip(secret, new[4:]))
    assert n == 1 and len(new) == digits + 5 and kept < digits / 16 + 5 * math.sqrt(digits / 16)
    p = pii.Permuter("key")
    x = int(secret, 16)
    assert p.backward("hex", p.forward("hex", x, 16**digits), 16**digits) == x


def test_addresses_are_linked_whatever_their_case():
    p = pii.Pseudonymiser("key")
    a, b = p("john.doe@x.com")[0], p("John.Doe@x.com")[0]
    assert a != "john.doe@x.com" and b.lower() == a and b[0].isupper() and b[5].isupper()
    assert p("a@b.com_foo@x.org")[1] == 2 and "foo@" not in p("a@b.com_foo@x.org")[0] and ".ann@" not in p("x .ann@x.org")[0]
    long = "ab1" * 3000
    assert p(f"{long}@x.org")[1] == 1 and long not in p(f"{long}@x.org")[0]


@pytest.mark.parametrize("text", ["a1" * 500_000, "0a" * 500_000, "a." * 500_000 + "@", "a@" * 500_000, "1-" * 500_000, "+1" * 500_000, "a@" + "b." * 500_000 + "1"])
def test_pii_is_linear(text):
    import time

    began = time.process_time()
    pii.Pseudonymiser("key")(text)
    assert time.process_time() - began < 5


def slow_pii(text, key):
    """Each finding by trying every kind at every place with patterns of their own."""
    import re

    kinds = {k: re.compile(v) for k, v in (("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))}
    step = pii.Permuter(key).forward
    return {k: {m[0]: pii._KINDS[k](m[0], step) for m in v.finditer(text) if pii._KINDS[k](m[0], step)} for k, v in kinds.items()}


def test_pii_query_equals_other_finders(spark, sf):
    """All mail addresses, IP addresses and social security numbers that plain patterns find are replaced as they should be."""
    from factlake.llm.queries import op3_pii

    new = {r.doc_id: (r.text, r.n_found) for r in op3_pii(spark, sf).collect()}
    seen = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = slow_pii(r.text, pii.TEST_KEY)
        for values in own.values():
            for old, by in values.items():
                seen += 1
                assert by in new[r.doc_id][0] and (old not in new[r.doc_id][0]), (r.doc_id, old)
        if not new[r.doc_id][1]:
            assert new[r.doc_id][0] == r.text
    assert seen > 5


def test_no_pseudonyms_without_a_key(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(odd_rows(spark))


def test_pii_rows(spark):
    df = odd_rows(spark)
    out = pii.pseudonymise(df, key="k")
    assert out.columns == [*df.columns, "n_found"] and out.count() == df.count()
    rows = {(r.doc_id, r.n_found) for r in out.collect()}
    assert (1, 1) in rows and (2, 0) in rows
    assert out.where("text LIKE '%974%'").count() == 0
    assert [r.text for r in out.where("doc_id = 4").collect()] == [LONG]
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "k", count="count")
    assert pii.pseudonymise(df.limit(0), "k", count=None).columns == df.columns


# licenses --------------------------------------------------------------------------------------------------------------

def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[-1]))
        prev = cur
    return prev[-1]


def test_patience_alignment():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcdefghijklmnopqrst"))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.align(list("abcdef"), list("xabcyef"))) == 5


def test_license_scan(spark):
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for name, text in licenses.TEMPLATES.items():
        words = licenses.tokens(text)
        assert name in [f[0] for f in s("one two " + text.upper().replace(" ", "!! ") + " three")]
        dropped = " ".join(w for i, w in enumerate(words) if i != len(words) // 2)
        if (len(words) - 1) / len(words) >= 0.8:
            found = [(f[0], f[1]) for f in s("x " * 900 + dropped)]
            assert any(n == name or n.split("-")[0] == name.split("-")[0] for n, _ in found), (name, found)
    assert s("nothing of the kind is licensed here or there") == []
    both = s(licenses.TEMPLATES["MIT"] + " and more " + licenses.TEMPLATES["CC-BY-NC-4.0"])
    assert [f[0] for f in both] == ["MIT", "CC-BY-NC-4.0"]
    df = odd_rows(spark).withColumn("text", F.when(F.col("doc_id") == 1, "Released under the MIT License.").otherwise(F.col("text")))
    assert [(r.doc_id, r.license) for r in licenses.scan(df).collect()] == [(1, "MIT"), (1, "MIT")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_a_license_needs_its_name_and_version(spark):
    s = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE, licenses.NAMES)
    for text, want in (("Released under the BSD License", ["BSD"]), ("Released under the Apache License", []), ("Licensed under CC BY 3.0", ["CC-BY-3.0"]), ("Licensed under the MIT License.", ["MIT"]),
                       ("This work is licensed under the GNU General Public License, version 1", []), ("This work is licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"])):
        assert [f[0] for f in s(text)] == want, text
    for name, text in licenses.TEMPLATES.items():
        assert [f[:2] for f in s(f"zz {text} zz")] == [(name, 1.0)], name


def slow_scan(text, templates, coverage, names):
    """Findings by aligning around every word of a text, the best of overlapping ones kept."""
    own, found = licenses.tokens(text), set()
    for name, t in ((n, licenses.tokens(t)) for n, t in templates.items()):
        need = set(licenses.tokens(names.get(name, "")))
        for i in range(len(own)):
            lo = max(0, i - len(t) - 4)
            pairs = licenses.align(t, own[lo : i + len(t) + 5])
            if len(pairs) >= coverage * len(t) and need <= {t[a] for a, _ in pairs}:
                found.add((name, len(pairs) / len(t), len(pairs), lo + pairs[0][1], lo + pairs[-1][1]))
    kept = []
    for f in sorted(found, key=lambda f: (-f[2], -f[1], -len(licenses.tokens(templates[f[0]])), f[0], f[3])):
        if all(f[4] < k[3] or f[3] > k[4] for k in kept):
            kept.append(f)
    return {f[:3] for f in kept}


def test_license_query_equals_brute_force(spark, sf):
    from factlake.llm.queries import op4_licenses

    got: dict = {}
    for r in op4_licenses(spark, sf).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.coverage, r.matched_words))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").collect()}
    hot = [d for d in texts if d in got or "icense" in (texts[d] or "")][:40] + list(texts)[:25]
    for d in hot:
        assert got.get(d, set()) == slow_scan(texts[d], licenses.TEMPLATES, licenses.COVERAGE, licenses.NAMES), d
    assert len(got) > 0


def test_long_templates_are_found_twice():
    rng = random.Random(4)
    long = [rng.choice(["the", "of", "license"]) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(900)]
    copy = [w for w in long if rng.random() > 0.08]
    s = licenses.Scanner({"own": " ".join(long)}, 0.8)
    found = s(" ".join(["filler"] * 300 + long + ["filler"] * 500 + copy + ["filler"] * 40))
    assert [f[0] for f in found] == ["own", "own"] and found[0][1] == 1 and found[0][3] == 300 and found[1][1] > 0.8
    assert s(" ".join(copy[:600])) == [] and licenses.Scanner({"none": "!!"}, 0.8)("a b") == []


# HTML ------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>One <b>two</b>three<p>Four<br>five &amp; six", "One twothree\n\nFour\nfive & six"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "* a\n* b\n  * c\n* d"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>12</table>", "Name  | Qty\napple | 12"),
        ("a<script>b</script><style>c</style><!-- d --><template>e</template>f", "af"),
        ("<div hidden>a</div><div style='display: none'>b</div><p aria-hidden=true>c</p><nav>d</nav>", "d"),
        ("<title>t</title><pre>\n a  b\n   c</pre>", " a  b\n   c"),
        ("<h1>H</h1>text<h2>I</h2>", "H\n\ntext\n\nI"),
        ("", ""),
        ("< 3 and <", "< 3 and <"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("plain &eacute;", "plain é"),
    ],
)
def test_render(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize(
    "row,text",
    [
        ("<form><td>x</td><td>y</td></form>", "x | y"),
        ("<b>Total</b>", "Total"),
        ("<td>a</td><font><a>b</a> <i>c</i></font><td>d", "a | b c | d"),
        ("<form>Name <b>q</b><td>x<div><td>y</div></form><td>z", "Name q | x | y | z"),
        ("<div><table><tr><td>in</table></div><td>x", "in | x"),
        ("<form> <input type=hidden></form><td>x<td>y", "x | y"),
        ("<div hidden>n</div><td>x", "x"),
        ("<b>" * 3000 + "<td>x", "x"),
    ],
)
def test_elements_between_row_and_cell(row, text):
    assert html.render(f"<table><tr>{row}</tr></table>") == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<svg><title>t</title><text>Axis</text><text>Two</text></svg>x", "Axis\nTwo\nx"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"),
        ("<input value=Name> <input type=password value=p><input placeholder=City>", "Name City"),
        ("<table><tr><th rowspan=2>A<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>wide<td>z</table>", "A | b | c\n  | d | e\nwide  | z"),
        ("<table><tr><td>a<td rowspan=0>s<tr><td>b<tr><td>c<td>d</table>", "a | s\nb |\nc |   | d"),
        ("a <b c='d>e", "a e"),
        ("<p>x <a href=", "x <a href="),
    ],
)
def test_render_more(page, text):
    assert html.render(page) == text


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a x=\"'" * 150_000, "<!" * 500_000, "<" * 1_000_000, "<script>" + "</script " * 120_000, "<![CDATA[" * 100_000, "<table>" + "<tr><td colspan=1000 rowspan=0>x" * 30_000])
def test_html_is_linear(page):
    import time

    began = time.process_time()
    html.render(page)
    assert time.process_time() - began < 6


@pytest.mark.parametrize("rows", [3, 60, 170, 400, 2000])
def test_rows_of_a_table_do_not_depend_on_its_size(rows):
    """Cells that reach down stand in their columns whatever follows; above REACHING cells all text is kept."""
    head = "<table><tr><td rowspan=0>s<td>a<tr><td>b<tr><td>c"
    lines = html.render(head + "".join(f"<tr><td rowspan=0>x<td>y{k}" for k in range(rows)) + "</table>").split("\n")
    assert [" ".join(x.split()) for x in lines[:5]] == ["s | a", "| b", "| c", "| x | y0", "| | x | y1"]
    assert [x.split()[-1] for x in lines[3:]] == [f"y{k}" for k in range(rows)] and all("x" in x for x in lines[3:])
    assert max(x.count("|") for x in lines) == min(rows, html.REACHING) + 1


def test_html_deep_and_rows(spark):
    assert html.render("<div>" * 5000 + "x") == "x"
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(((r.page_id, r.text) for r in html.extract(df).collect()), key=str) == sorted([(1, None), (None, "x"), (2, "")], key=str)
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_all_visible_words(spark, sf):
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(30).collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        import html as entities

        want = re.sub(r"<[^>]*>", " ", body)
        assert "".join(entities.unescape(want).split()) == "".join(re.sub(r"(?m)^\s*\* ", "", html.render(r.html)).split())


# language ID and quality -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("texts", [["a"], ["a", "b"], ["", "x"], ["ab", "cd"], ["", ""], []])
def test_language_of_tiny_texts(spark, texts):
    """Chunks of texts of a byte or two, and a tiny text before a very long one."""
    raw = [t.encode() for t in texts]
    codes, owner = langid.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [set(codes[owner == k].tolist()) for k in range(len(texts))] == [{(n - 1) << 24 | int.from_bytes(r[i : i + n], "big") for n in (1, 2, 3) for i in range(len(r) - n + 1)} for r in raw]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(90, "a", "en"), (91, "hello world " * 100_000, "en")]
    assert langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == len(rows)


def slow_language(texts, langs, rows):
    """Kernel matrices by sets and a dense solve: the scores that the collapsed weights should give."""
    model = langid.fit_texts(texts, langs)
    known = {int(g): k for k, g in enumerate(model.grams)}

    def grams(t):
        b = bytes(langid._FOLD[np.frombuffer(t.lower().encode(), np.uint8)])
        return {(n - 1) << 24 | int.from_bytes(b[i : i + n], "big") for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    return [np.sum([model.weights[known[g]] for g in grams(t) if g in known] or [np.zeros(len(model.languages))], axis=0) / math.sqrt(max(1, len(grams(t)))) for t in rows], model


def test_language_query_equals_brute_force(spark, sf):
    from factlake.llm.queries import op2_langid

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sample = [(r.text, r.lang) for r in docs.collect()]
    assert max(sum(x == n for _, x in sample) for n in model.languages) <= langid.SAMPLE  # all are learnt here, whatever the order
    slow, _ = slow_language([t for t, _ in sample], [n for _, n in sample], [t for _, t in rows])
    got = {r.doc_id: r for r in op2_langid(spark, sf).collect()}
    for (d, t), s in zip(rows, slow):
        assert abs(got[d].score - s.max()) < 1e-3
        if np.sort(s)[-1] - np.sort(s)[-2] > 1e-3:
            assert got[d].language == model.languages[int(s.argmax())]


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").collect()
    model = langid.fit_texts([r.text for r in rows[:400]], [r.lang for r in rows[:400]])
    data, offs = buffers(pa.array([r.text.lower() for r in rows[400:]]))
    got = np.array(model.languages)[model.scores(data, offs).argmax(axis=1)]
    assert (got == np.array([r.lang for r in rows[400:]])).mean() > 0.99


def test_language_presence_is_exact():
    texts = ["abca", "", "é a", "ab"]
    data, offs = buffers(pa.array(texts))
    codes, owner = langid.presence(data, offs)
    for i, t in enumerate(texts):
        raw = bytes(langid._FOLD[np.frombuffer(t.encode(), np.uint8)]) if t else b""
        want = {(n, raw[k : k + n]) for n in (1, 2, 3) for k in range(len(raw) - n + 1)}
        assert len(codes[owner == i]) == len(want)


def test_language_rows(spark):
    df = odd_rows(spark)
    out = {(r.doc_id, r.language, r.accepted) for r in langid.identify(df).collect()}
    assert (2, None, False) in out and (3, None, False) in out and (5, None, False) in out and (1, "en", True) in out
    kept = langid.identify(df, keep=True)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 2
    assert langid.identify(df.limit(0)).count() == 0
    assert langid.identify(df.withColumn("lang", F.lit(None).cast("string")), keep=True).count() == 0


def test_all_labelled_languages_are_learnt(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(202)], "doc_id long, text string, lang string").coalesce(1).cache()
    assert langid.fit(df).languages == sorted(f"l{i}" for i in range(202))
    df.unpersist()


def test_language_keeps_clean_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert langid.identify(df, keep=True).count() >= 0.995 * df.count()


def test_quality_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").orderBy("doc_id").limit(1600).collect()
    fit, test = rows[:1200], rows[1200:]
    model = quality.fit_texts([r.text for r in fit], [r.quality for r in fit], [r.toxic for r in fit])
    data, offs = buffers(pa.array([r.text for r in test]))
    got = model.scores(data, offs)[0] >= 0
    assert (got[:, 0] == (np.array([r.quality for r in test]) > 0)).mean() > 0.97
    toxic = np.array([r.toxic for r in test]) > 0
    assert (got[:, 1] & ~toxic).sum() <= 2 and (got[:, 1] & toxic).sum() >= 0.7 * toxic.sum()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 3))
    side = x @ [1.0, -2.0, 0.5] - 0.1
    x, side = x[np.abs(side) > 0.4], side[np.abs(side) > 0.4]
    y = np.sign(side)
    w = quality.descend([np.arange(3)] * len(x), list(x), y, 3, np.full(len(x), 100.0), 500)
    assert (np.sign(x @ w[:3] + w[3]) == y).all()


def test_quality_rows(spark):
    df = odd_rows(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 1), (None, 1, 1), (99, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, labels).collect()
    assert len(out) == df.count() and not any(r.keep for r in out if r.doc_id in (2, 3, 5))
    assert quality.classify(df.limit(0), labels).count() == 0 and quality.classify(df, labels.limit(0)).count() == df.count()


# CTW ---------------------------------------------------------------------------------------------------------------------

def slow_ctw(texts):
    counts, seen = {}, []
    for t in texts:
        b = t.encode()
        for i, x in enumerate(b):
            ctx = tuple(b[i - k] if i >= k else 0 for k in range(1, ctw.DEPTH + 1))
            path = [((1 << k) | (x >> (8 - k)), (x >> (7 - k)) & 1) for k in range(8)]
            for p, bit in path:
                for d in range(ctw.DEPTH + 1):
                    counts.setdefault((ctx[:d], p), [0, 0])[bit] += 1
            seen.append((t, ctx, path))
    g = math.lgamma
    own = {k: g(a + 0.5) + g(b + 0.5) - g(a + b + 1) - 2 * g(0.5) for k, (a, b) in counts.items()}
    kids, weighted = {}, {}
    for c, p in counts:
        if c:
            kids.setdefault((c[:-1], p), []).append((c, p))

    def w(k):
        if k not in weighted:
            weighted[k] = own[k] if len(k[0]) == ctw.DEPTH else np.logaddexp(own[k], sum(map(w, kids[k]))) + math.log(0.5)
        return weighted[k]

    def prob(ctx, p, bit, d=0):
        k = (ctx[:d], p)
        here = (counts[k][bit] + 0.5) / (sum(counts[k]) + 1)
        if d == ctw.DEPTH:
            return here
        s = math.exp(own[k] + math.log(0.5) - w(k))
        return s * here + (1 - s) * prob(ctx, p, bit, d + 1)

    out = dict.fromkeys(texts, 0.0)
    for t, ctx, path in seen:
        out[t] -= sum(math.log2(prob(ctx, p, bit)) for p, bit in path)
    return out


def test_ctw_matches_recursion_on_both_paths(spark):
    texts = ["abracadabra abra", "banana band", "the the cat", "é", "xyz"]
    want = slow_ctw(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "doc_id long, text string")
    model = ctw.train(df)
    for sent in (10**6, 0):
        out = {r.doc_id: r for r in ctw.score(df, model, sent).collect()}
        for i, t in enumerate(texts):
            assert out[i].bits == pytest.approx(want[t], rel=1e-5) and out[i].n_bytes == len(t.encode())
            assert out[i].bits_per_byte == pytest.approx(want[t] / len(t.encode()), rel=1e-5)
        assert out[5].n_bytes == 0 and out[5].bits == 0 and out[5].bits_per_byte is None and out[6].n_bytes is None and out[6].bits is None


def test_ctw_rows(spark):
    df = odd_rows(spark)
    assert ctw.query(df).count() == df.count() and ctw.query(df.limit(0)).count() == 0


# fingerprints --------------------------------------------------------------------------------------------------------------

def test_sketches_merge_and_estimate(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    a = [rng.choice(words) for _ in range(3000)]
    b = a[:2000] + [rng.choice(words) for _ in range(1000)]
    df = spark.createDataFrame([(1, "s", " ".join(a)), (2, "s", " ".join(b)), (3, "t", "one two"), (4, "t", None), (5, None, "")], "doc_id long, source string, text string")
    sk = fingerprint.sketches(df)
    rows = {r.doc_id: r.sketch for r in sk.collect()}
    shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    assert len(rows[1]) == fingerprint.K and rows[1] == sorted(set(rows[1])) and len(rows[3]) == 1 and rows[4] == [] and rows[5] == []
    merged = {r.source: r.merged for r in fingerprint.merge(sk, "source").collect()}
    assert merged["s"] == sorted(set(rows[1]) | set(rows[2]))[: fingerprint.K]
    x, y = sk.where("doc_id = 1").select(F.col("sketch").alias("a")), sk.where("doc_id = 2").select(F.col("sketch").alias("b"))
    r = x.crossJoin(y).select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_count(F.col("a")).alias("n")).first()
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(r.j - true) < 0.15 and abs(r.c - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.2 and abs(r.n / len(shingles(a)) - 1) < 0.3
    out = {q.doc_id: q for q in fingerprint.query(df).collect()}
    assert out[4].n_distinct == 0 and out[4].containment == 0 and out[5].source_distinct == 0 and out[1].containment > 0.7
    assert fingerprint.query(odd_rows(spark)).count() == 8 and fingerprint.query(df.limit(0)).count() == 0


def test_near_documents_equal_brute_force(spark):
    """Every document against every other by its sketch: those at 0.6 and above are found, with the columns' estimates."""
    rng = random.Random(12)
    texts = [[rng.choice([f"w{i}" for i in range(500)]) for _ in range(rng.choice([3, 60, 400]))] for _ in range(40)]
    for t in texts[:25]:
        for edits in (1, 3, 12):
            own = list(t)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            texts.append(own)
    rows = [(i, "s", " ".join(t)) for i, t in enumerate(texts)] + [(900, "s", " ".join(texts[0])), (901, "t", None), (902, None, ""), (None, "t", " ".join(texts[1])), (0, "s", " ".join(texts[0]))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit("clash"))
    out = fingerprint.query(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    groups = {}
    for r in by.values():
        if r.sketch:
            groups.setdefault(tuple(r.sketch), []).append(r.doc_id)
    reps = {min(ids): np.array(s) for s, ids in groups.items()}
    scanned = fingerprint.scan(df).cache()
    of = {r.key: r.group_id for r in scanned.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("group_id")).collect()}
    pairs = [(of[r.a], of[r.b], (r.resemblance, r.a_in_b), (r.resemblance, r.b_in_a)) for r in fingerprint.near(scanned).collect()]
    got = {(i, j): x for i, j, x, _ in pairs} | {(j, i): x for i, j, _, x in pairs}
    slow = {(i, j): fingerprint._compared(a, b, fingerprint.K)[:2] for i, a in reps.items() for j, b in reps.items() if i != j}
    slow = {x: v for x, v in slow.items() if v[0] >= fingerprint.NEAR}
    assert len(got) == 2 * len(pairs) and set(got) <= set(slow) and all(got[x] == pytest.approx(slow[x]) for x in got)
    assert len(slow) > 60 and len(got) >= 0.95 * len(slow)
    # classes: what chains of the pairs join
    least = {i: i for i in reps}
    while new := {i: m for i, j in got if (m := min(least[i], least[j])) < least[i]}:
        least |= new
    assert all(r.class_id == least[r.group_id] for r in by.values() if r.sketch) and len(set(least.values())) < len(reps)
    sizes = Counter(r.class_id for r in by.values())
    assert all(r.class_size == (sizes[r.class_id] if r.sketch else 0) for r in by.values())
    assert by[900].group_id == 0 and by[900].class_id == 0 and by[901].group_id is None and by[901].class_id is None and by[902].class_size == 0
    assert [(r.group_id, r.class_id, r.class_size) for r in out if r.doc_id is None] == [(None, None, 0)]
    x = spark.createDataFrame([(by[0].sketch, by[40].sketch)], "a array<long>, b array<long>").select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert (x.r, x.c) == pytest.approx(fingerprint._compared(np.array(by[0].sketch), np.array(by[40].sketch), fingerprint.K)[:2])


def test_classes_take_few_comparisons(monkeypatch):
    """A bucket of copies with an edit each takes about one comparison a document, as does one of documents that merely share a passage."""
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(0, 2**63 - 1, n)
    base, passage = draw(110), draw(30)
    near = [np.unique(np.concatenate([base, draw(18)])) for _ in range(300)]
    apart = [np.unique(np.concatenate([passage, draw(98)])) for _ in range(300)]
    own = near + apart
    compared, of = [], fingerprint._Near.of
    monkeypatch.setattr(fingerprint._Near, "of", lambda self, x, others: compared.append(len(others)) or of(self, x, others))
    n = fingerprint._Near(own, fingerprint.K, fingerprint.NEAR)
    for part in n.parts(np.arange(len(own))):
        n.connect(part)
    assert len({n.root(x) for x in range(300)}) == 1 and len({n.root(x) for x in range(300, 600)}) == 300
    assert sum(compared) < 2000
    rows = [own[i] for i in (0, 7, 350, 351)]
    edge = np.cumsum([0, *map(len, rows)])
    for x in (3, 300):
        assert list(fingerprint._alike(own[x], np.concatenate(rows), edge, 128)) == pytest.approx([fingerprint._compared(own[x], r, 128)[0] for r in rows])


def test_sketch_holds_the_smallest_hashes():
    text = " ".join(f"w{i}" for i in range(700))
    small, n = fingerprint.sketch_batch(pa.array([text, None, text]), 16, 3)
    whole, m = fingerprint.sketch_batch(pa.array([text]), 10**6, 3)
    assert list(n) == [16, 0, 16] and list(small[:16]) == list(whole[:16]) and list(small[16:]) == list(whole[:16]) and m[0] == 698
    assert list(itertools.chain(small[:16])) == sorted(small[:16])
