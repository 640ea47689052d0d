"""N-gram Jaccard join, decontamination and the pipeline, against brute force."""

import os
import random
import re
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factlake.llm import bpe, decontam, jaccard, langid, pii
from tests.llm.test_text_operators import odd_rows

WORD = re.compile(r"[0-9a-z_\x80-\U0010ffff]+")


def grams(t, n):
    w = WORD.findall(t.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def slow_join(rows, t, n):
    """rows: (doc_id, text); pairs as jaccard.join defines them."""
    sets = {}
    for i, x in rows:
        if i is not None and x is not None and grams(x, n):
            sets.setdefault(grams(x, n), set()).add(i)
    out = {(min(ids), i, 1.0) for ids in sets.values() for i in ids if i != min(ids)}
    reps = [(min(ids), s) for s, ids in sets.items()]
    for a in range(len(reps)):
        for b in range(a + 1, len(reps)):
            (i, x), (j, y) = reps[a], reps[b]
            o = len(x & y)
            if o and i != j and o >= t * (len(x) + len(y) - o) - 1e-9:
                out.add((min(i, j), max(i, j), round(o / (len(x) + len(y) - o), 6)))
    return out


def corpus(seed, n=120):
    """Texts of few words with copies, edited copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = [rng.choice(vocabulary[: rng.choice([20, 300])]) for _ in range(rng.choice([0, 1, 2, 5, 30, 80]))]
            texts.append(" ".join(w + (passage if kind > 0.8 else [])))
    return texts


@pytest.mark.parametrize("seed,t,n", [(1, 0.5, 3), (2, 0.6, 2), (3, 0.8, 1), (4, 0.3, 2)])
def test_join_equals_brute_force(spark, seed, t, n):
    rows = [(i if i % 17 else i + 1, x) for i, x in enumerate(corpus(seed))] + [(None, "a b c d"), (500, None), (501, ""), (502, "??")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {(r.doc_id, r.other_id, r.jaccard) for r in jaccard.join(df, t, n).collect()}
    assert got == slow_join(rows, t, n)


@pytest.mark.parametrize("seed,t,n", [(1, 0.5, 3), (2, 0.6, 2)])
def test_all_pairs_of_documents(spark, seed, t, n):
    """Copies with each other and with near duplicates; a doc_id with two texts, repeated rows."""
    rows = [(i if i % 17 else i + 1, x) for i, x in enumerate(corpus(seed))]
    rows += [*rows[:3], (None, "a b c d"), (500, None), (501, "")]
    sets = sorted({(i, grams(x, n)) for i, x in rows if i is not None and x is not None and grams(x, n)}, key=lambda r: r[0])
    want = [(i, j, round(len(x & y) / len(x | y), 6)) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if i != j and len(x & y) >= t * len(x | y) - 1e-9]
    got = [tuple(r) for r in jaccard.all_pairs(spark.createDataFrame(rows, "doc_id long, text string"), t, n).collect()]
    assert sorted(got) == sorted(want) and len(want) > len(slow_join(rows, t, n))


def slow_linked(rows, t, n):
    """rows: (doc_id, text); rows as jaccard.linked defines them."""
    sets = sorted({(i, grams(x, n)) for i, x in rows if i is not None and x is not None and grams(x, n)}, key=lambda r: r[0])
    near = [[j for j, (_, y) in enumerate(sets) if j != k and len(x & y) >= t * len(x | y) - 1e-9] for k, (_, x) in enumerate(sets)]
    least = [i for i, _ in sets]
    while (new := [min([least[k], *(least[j] for j in js)]) for k, js in enumerate(near)]) != least:
        least = new
    out = [(i, min(j for j, y in sets if y == x), least[k], sum(sets[j][0] != i for j in near[k])) for k, (i, x) in enumerate(sets)]
    return sorted(out + [(i, i, i, 0) for i in {i for i, _ in rows} - {i for i, _ in sets} - {None}])


@pytest.mark.parametrize("seed,t,n", [(1, 0.5, 3), (2, 0.6, 2), (4, 0.3, 2)])
def test_linked_equals_brute_force(spark, monkeypatch, seed, t, n):
    """A row per document whatever its links; doc_ids with two texts, near ones too, repeated rows, texts without a word."""
    rows = [(i if i % 17 else i + 1, x) for i, x in enumerate(corpus(seed))]
    long_ = " ".join(f"v{k}" for k in range(60))
    rows += [*rows[:3], (None, "a b c d"), (500, None), (501, ""), (502, "??"), (600, long_), (600, long_ + " x"), (601, long_ + " y"), (602, long_), (603, long_ + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    want = slow_linked(rows, t, n)
    assert sorted(tuple(r) for r in jaccard.linked(df, t, n).collect()) == want
    monkeypatch.setattr(jaccard, "SENT_KEYS", 0)
    assert sorted(tuple(r) for r in jaccard.linked(df, t, n).collect()) == want
    assert jaccard.linked(df.limit(0), t, n).count() == 0


def test_op10_has_a_row_per_document(spark, sf):
    import __spark_entry__

    ids = [r.doc_id for r in __spark_entry__.queries()["op10_jaccard"](spark, sf).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_join_through_shuffled_sets(spark, monkeypatch):
    """The same pairs when lists are too long to be sent, groups are split and records meet at points."""
    rows = list(enumerate(corpus(7)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SENT_KEYS", 0), ("GROUP_PAIRS", 3), ("MANY", 1)):
        monkeypatch.setattr(jaccard, name, value)
    assert {(r.doc_id, r.other_id, r.jaccard) for r in jaccard.join(df, 0.5, 3).collect()} == slow_join(rows, 0.5, 3)


def test_sketches_never_rule_out_a_pair():
    """Counts over hash ranges, also of sets whose sketches have different numbers of ranges, bound the difference from below."""
    rng = np.random.default_rng(6)
    for _ in range(400):
        common = rng.integers(0, 1 << 56, rng.integers(1, 90))
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 56, rng.integers(0, 60))])) for _ in range(2)]
        size = np.array([len(s) for s in sets])
        raw = jaccard._sketches(np.concatenate(sets), np.repeat([0, 1], size), size)
        counts = [jaccard._from_sketch(raw[k].as_buffer()).astype(int) for k in (0, 1)]
        while len(counts[0]) != len(counts[1]):
            k = int(len(counts[1]) > len(counts[0]))
            counts[k] = np.minimum(counts[k].reshape(-1, 2).sum(axis=1), 3)
        assert np.abs(counts[0] - counts[1]).sum() <= len(np.setxor1d(*sets))
        assert list(jaccard._unpacked(pa.py_buffer(jaccard._packed(sets[0])))) == list(sets[0] >> 8)


def slow_keep(rows, t, n):
    pairs = slow_join(rows, t, n)
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b, _ in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i for i, _ in rows if i is None or find(i) == i}


def test_keep_one_of_each_group(spark):
    rows = list(enumerate(corpus(9)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == slow_keep(rows, jaccard.THRESHOLD, jaccard.N)
    odd = odd_rows(spark)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert jaccard.keep_one(odd.limit(0)).count() == 0 and jaccard.join(odd.limit(0)).count() == 0


def test_shared_tables_are_cleared(spark):
    from factlake.llm._common import clear_shared, written

    t = written(spark.range(3).toDF("x"), "gone")
    assert t.count() == 3
    path = t.inputFiles()[0].removeprefix("file://")
    clear_shared(spark)
    assert not os.path.exists(path)


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.key: r.least for r in jaccard.components(pairs).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


# decontamination -----------------------------------------------------------------------------------------------------------

def slow_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(150):
        a = bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 70)))
        b = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 90)))
        assert decontam.distance(a, b)[0] == slow_distance(a, b)


def normal(t):
    return " ".join(WORD.findall(t.lower()))


def corrupt(t, share, rng):
    s = list(normal(t))
    for _ in range(int(share * len(s))):
        p, o = rng.randrange(len(s)), rng.random()
        if o < 0.34:
            s[p] = rng.choice("abcdefghijk ")
        elif o < 0.67:
            s.insert(p, rng.choice("abcdefghijk "))
        else:
            s.pop(p)
    return "".join(s)


def test_recall_up_to_the_bound_and_no_false_finding(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(60).collect()]
    index = decontam.Index([i for i, _ in items], [t for _, t in items])
    rng = random.Random(5)
    for share in (0.0, 0.05, 0.1, 0.14):
        texts = [rng.choice(docs) + " " + corrupt(t, share, rng) + ". " + rng.choice(docs) for _, t in items]
        found = {(d, x) for d, x, _, _ in index.find(pa.array(texts))}
        assert np.mean([(k, k) in found for k in range(len(items))]) >= (1.0 if share == 0 else 0.9)
    few = items[:12]
    small = decontam.Index([i for i, _ in few], [t for _, t in few])
    texts = docs[:25] + [docs[0] + corrupt(t, 0.05, rng) for _, t in few[:5]]
    got = {(d, x) for d, x, _, _ in small.find(pa.array(texts))}
    want = {(d, x) for d, t in enumerate(texts) for x, (_, i) in enumerate(few) if slow_distance(normal(i), normal(t)[-900:]) <= int(decontam.SHARE * len(normal(i)))}
    assert got <= want | {(d, x) for d, x in got if slow_distance(normal(few[x][1]), normal(texts[d])) <= int(decontam.SHARE * len(normal(few[x][1])))}
    assert len(want & got) >= 0.9 * len(want)


def spread(t, share, kind, rng):
    """floor(share * length) edits of one kind, evenly over the normal form."""
    s, n = list(normal(t)), int(share * len(normal(t)))
    for p in sorted((int((k + 0.5) * len(s) / n) for k in range(n)), reverse=True):
        if kind == "pop":
            s.pop(p)
        elif kind == "insert":
            s.insert(p, rng.choice("0123456789"))
        else:
            s[p] = rng.choice("0123456789")
    return "".join(s)


def test_every_passage_at_the_bound_is_found(spark, monkeypatch):
    """Edits of each kind spread evenly at the full bound, random ones, and copies of items of one to eight words."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").orderBy("item_id").limit(60).collect()]
    rng = random.Random(8)
    short = [" ".join(normal(t).split()[: 1 + k % 8]) for k, t in enumerate(texts[:24])]
    docs = [(k, f"zz {spread(t, decontam.SHARE, kind, rng)} zz") for k, t in enumerate(texts) for kind in ("pop", "insert", "swap")]
    docs += [(k, f"zz {corrupt(t, decontam.SHARE, rng)} zz") for k, t in enumerate(texts)]
    docs += [(k + len(texts), f"zz {t} zz") for k, t in enumerate(short)]
    docs += [(k + len(texts), f"zz {spread(t, decontam.SHARE, kind, rng)} zz") for k, t in enumerate(short) for kind in ("pop", "insert", "swap")]
    items = [normal(t).encode() for t in texts + short]
    # a lost one-letter word takes a space with it, and an edit of a non-ASCII letter counts twice: such are past the bound
    docs = [(x, t) for x, t in docs if decontam.distance(items[x], normal(t).encode())[0] <= int(decontam.SHARE * len(items[x]))]
    assert len(docs) > 250
    for dense in (decontam.DENSE, 0):
        monkeypatch.setattr(decontam, "DENSE", dense)
        index = decontam.Index(list(range(len(texts + short))), texts + short)
        found = {(d, x) for d, x, _, _ in index.find(pa.array([t for _, t in docs]))}
        assert not [(d, x) for d, (x, _) in enumerate(docs) if (d, x) not in found]


def test_search_equals_brute_force():
    rng = random.Random(9)
    items = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    docs = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 200))) for _ in range(40)] + ["a", "", "b" * 90]
    got = {(d, x): e for d, x, e, _ in decontam.Index(list(range(len(items))), items).find(pa.array(docs))}
    want = {(d, x): e for d, t in enumerate(docs) for x, i in enumerate(items) if normal(i) and (e := slow_distance(normal(i), normal(t))) <= int(decontam.SHARE * len(normal(i)))}
    assert got == want


def test_decontamination_rows(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the tower"
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, ""), (None, "another item that nobody has ever quoted anywhere at all")], "item_id long, text string")
    odd = odd_rows(spark).withColumn("text", F.when(F.col("doc_id") == 6, F.lit(f"start {passage.upper()} end")).otherwise(F.col("text")))
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontam.search(odd, items).collect()) == [(6, 1, 0), (6, 2, 0)]
    monkeypatch.setattr(decontam, "SLICE", 60)
    assert sorted((r.doc_id, r.item_id) for r in decontam.search(odd, items).collect()) == [(6, 1), (6, 2)]
    left = decontam.remove(odd, items)
    assert left.columns == odd.columns and left.count() == 7 and left.where("doc_id = 6").count() == 0
    assert decontam.search(odd.limit(0), items).count() == 0 and decontam.search(odd, items.limit(0)).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark):
    folder = tempfile.mkdtemp()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    first = docs.first()
    more = spark.createDataFrame([(9001, "", "en", "a", 0), (9002, None, None, None, None), (None, "a text without any number of its own", "en", "a", 1), (first.doc_id, first.text, first.lang, first.source, first.n_chars)], docs.schema)
    docs = docs.unionByName(more)
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, folder).collect()}

    model = langid.fit(docs)
    known = {(r.doc_id) for r in langid.identify(docs, model).where("accepted").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known]
    keep = slow_keep(rows, jaccard.THRESHOLD, jaccard.N)
    rows = list({r for r in rows if r[0] in keep})
    items = [normal(r.text) for r in bench.collect()]
    exact = {i for i, t in rows if any(x in normal(t) for x in items)}
    index = decontam.Index(list(range(len(items))), items)
    rows = [r for r, bad in zip(rows, [bool(index.find(pa.array([t]))) for _, t in rows]) if not bad]
    assert not exact & {i for i, _ in rows}
    swap = pii.Pseudonymiser(pii.TEST_KEY)
    assert got == {(i, swap(t)[0]) for i, t in rows}
    enc = bpe.Encoder(bpe.load_ranks(bpe.VOCABULARY))
    for r in corpus_pipeline.run(spark, folder).limit(5).collect():
        assert enc.encode(r.decoded) == list(r.token_ids)


def test_stages_on_empty_and_odd_documents(spark, tmp_path):
    bench = spark.createDataFrame([(1, "an item that is in none of these texts whatever happens to them")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (odd_rows(spark), odd_rows(spark).limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.count() <= df.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns


@pytest.mark.parametrize("crowd", [4, 64])
def test_near_copies_are_linked_by_their_hub(spark, monkeypatch, crowd):
    """Of many near copies most pairs aren't formed; classes, links and what stays are as by brute force, copies and documents with two texts included."""
    rng, rows = random.Random(5), []
    for base in range(2):
        own = [f"w{base}x{k}" for k in range(90)]
        for _ in range(160):
            x = list(own)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14, 20])):
                x[rng.randrange(90)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(x)))
    rows += [(len(rows) + k, rows[7 * k][1]) for k in range(20)] + [(k, rows[k + 30][1]) for k in range(4)] + [(10**6, "other words here"), (10**6 + 1, None)]
    sets = sorted({(i, frozenset(zip(w, w[1:]))) for i, t in rows if t for w in [t.split()]}, key=lambda x: (x[0], sorted(x[1])))
    near = [[i for i, (_, y) in enumerate(sets) if len(x & y) >= 0.6 * len(x | y) - 1e-9] for _, x in sets]
    seen, least = {}, {}
    for s in range(len(sets)):
        todo = [s] if s not in seen else []
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = s
                todo += near[k]
        least[seen[s]] = min(least.get(seen[s], 10**9), sets[s][0])
    want = sorted((d, least[seen[i]], sum(sets[j][0] != d for j in near[i])) for i, (d, _) in enumerate(sets)) + [(10**6 + 1, 10**6 + 1, 0)]
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    formed, write = {}, jaccard.written

    def counted(df, label):
        out = write(df, label)
        formed[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.links) for r in jaccard.linked(df).collect()) == want
    assert 0 < formed["jaccard-pairs"] < 160 * 159 / 2, formed  # a quarter of the pairs of two groups' sets would be more
    stay = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert stay == {min(d for i, (d, _) in enumerate(sets) if seen[i] == s) for s in set(seen.values())} | {10**6 + 1}
