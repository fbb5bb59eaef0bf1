"""Search, language and vector codes against plain Python: odd rows, ties, tiny segments and slices."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import language_id, lexical_search, oracle, queries, vector_codes

SCHEMA = "doc_id long, text string, lang string, rank int, score long, item long, id long"
LONG = "Überlänge " * 4000


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def texts(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "naïve", "x1", "zeta", "ß", "donaudampfschiff", "a", f"w{rng.randrange(40)}"])
    found = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return [None, "", "...", "42 7", "!?", "the the the", "the the the", found[3], found[3], LONG, "x" * 50_000, "日本語 テキスト", "\x00the\x00"] + found


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], 1, 2, 3, 4) for i, t in enumerate(texts())]
    return out + [out[20], out[20], (None, "the zeta alone", "en", 1, 2, 3, 4), (None, None, None, 1, 2, 3, 4), (7, "two texts of one id, the zeta", "de", 1, 2, 3, 4)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall(low(t)))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, t in items:
        asked[item] |= set(term.findall(low(t)))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tiny", [False, True])
def test_search(spark, table, rows, tiny, monkeypatch):
    items = [(1, "The naïve ZETA"), (2, "w1 w2 w3 the a x1"), (2, "w9 ß"), (3, ""), (4, None), (None, "the zeta"), (5, "absent terms only"), (6, LONG), (1, "The naïve ZETA")]
    if tiny:
        for name, value in (("SEGMENT", 300), ("SEGMENT_DOCS", 7), ("RANGE", 2), ("STEP", 4), ("SHORT", 3), ("BLOCK", 40)):
            monkeypatch.setattr(lexical_search, name, value)
    asked = spark.createDataFrame([(i, t, "q", 9) for i, t in items], "item_id long, text string, lang string, doc_id long")
    for k in (3, 50):
        got = lexical_search.ranked_search(table, asked, k)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_search([r[:2] for r in rows], items, k)
    assert lexical_search.ranked_search(table.limit(0), asked).count() == 0
    assert lexical_search.ranked_search(table, asked.limit(0)).count() == 0
    assert lexical_search.ranked_search(table.filter("text is null"), asked).count() == 0


def test_search_skips_without_loss():
    """With a high threshold most ranges go unread, and the best rows are the same."""
    rng = np.random.default_rng(4)
    n = 5000
    lists = []
    for size in (30, 200, 3000, 4500):
        docs = np.sort(rng.choice(n, size, replace=False))
        lists.append((docs, rng.integers(1, 10**9 // size, size)))
    dense = np.zeros(n, np.int64)
    for docs, scores in lists:
        dense[docs] += scores
    for begin in (0, 17):  # ids that leave ties to be settled
        best, ids = lexical_search.Best(20), (np.arange(n) * 7919 + begin) % n
        lexical_search.best_of_item(lists, {}, [0, 1, 2, 3], n, best, ids, np.zeros(n, bool))
        want = sorted(zip((-dense).tolist(), ids.tolist(), strict=True))[:20]
        assert list(zip((-best.scores).tolist(), best.ids.tolist(), strict=True)) == want


def brute_language(rows):
    word = re.compile("[a-z\x80-\U0010ffff]+")
    docs = [(i, word.findall(low(t)), lang, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0, bool(re.search(r"[^\W\d_]", t or "")), t) for i, t, lang in rows]
    names = sorted({lang for _, _, lang, held, _, t in docs if lang is not None and not held and t is not None})
    count = defaultdict(Counter)
    for _, ws, lang, held, _, _ in docs:
        if lang is not None and not held:
            for w in ws:
                count[w][lang] += 1
    total = Counter()
    for c in count.values():
        total.update(c)
    cut = lambda w, n: {p[k : k + n] for p in [f"\2{w}\3"] for k in range(len(p) - n + 1)} - {"\2", "\3"}
    grams = {n: defaultdict(Counter) for n in (1, 2, 3, 4)}
    for w, c in count.items():
        for n, own in grams.items():
            for g in cut(w, n):
                own[g].update(list(c))
    sums = {n: sum(own.values(), Counter()) for n, own in grams.items()}

    def value(w, lang):
        if w in count:
            return math.log((count[w][lang] + 0.5) / (total[lang] + 0.5 * len(count)))
        for n in (4, 3, 2, 1):
            if own := [g for g in cut(w, n) if g in grams[n]]:
                return sum(math.log((grams[n][g][lang] + 0.5) / (sums[n][lang] + 0.5 * len(grams[n]))) for g in own) / len(own)
        return 0.0

    out = []
    for i, ws, _, held, spoken, _ in docs:
        if not spoken or not names:
            out.append((i, held, "und", 0.0))
            continue
        s = [sum(value(w, lang) for w in ws) for lang in names]
        best = max(range(len(names)), key=lambda k: (s[k], -k))
        out.append((i, held, names[best], round(1 / sum(math.exp(x - s[best]) for x in s), 5)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tiny", [False, True])
def test_language(spark, table, rows, tiny, monkeypatch):
    if tiny:
        monkeypatch.setattr(language_id, "SLICE", 400)
        monkeypatch.setattr(language_id, "SHARD", 2000)
    got = language_id.identify(table).collect()
    assert sorted(((r["id"], r["held_out"], r["lang_pred"], round(r["score"], 5)) for r in got), key=repr) == brute_language([r[:3] for r in rows])
    assert language_id.identify(table.limit(0)).count() == 0
    nothing = language_id.identify(table.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]


def test_language_of_unseen_words(spark):
    train = [(1, "gestern schwimmen schwammen", "de"), (2, "yesterday swimming thing", "en")]
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _, _ in train)
    held = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 5 == 0)
    df = spark.createDataFrame([*train, (held, "schwimmt", None), (held, "things", None), (held, "日本", None)], "doc_id long, text string, lang string")
    assert sorted((r["lang_pred"], r["score"]) for r in language_id.identify(df).filter("held_out").collect())[0] == ("de", 0.5)
    assert {r["lang_pred"] for r in language_id.identify(df.filter("text = 'things' or not text like '%schwimmt'")).filter("held_out").collect()} == {"de", "en"}


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.documents(spark, folder)
    right = queries.op12_language_id(spark, folder).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    n, ok = right.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and ok >= 0.95 * n


def test_nearest_entry_is_exact():
    rng = np.random.default_rng(8)
    for k, length, spread in ((1, 3, 50), (16, 8, 900), (64, 2, 6), (16, 5, 2**26)):
        entries = rng.integers(-spread, spread + 1, (k, length))
        entries[k // 2] = entries[0]  # a tie
        x = np.concatenate([rng.integers(-spread, spread + 1, (300, length)), rng.integers(-2, 3, (50, length)), entries, np.full((1, length), 2**26)])
        index, distance = vector_codes.Codebook(entries).nearest(x)
        every = ((x[:, None] - entries) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def brute_codes(rows):
    ok = sorted([(i, lab, [min(max(math.floor(4096 * x), -(2**26)), 2**26) for x in v]) for i, lab, v in rows if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: (r[0] is None, r[0], np.array(r[2], "<i4").tobytes()))
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    d = len(ok[0][2]) // 8
    part = lambda v, p: v[p * d : p * d + d]
    books = [[part(r[2], p) for r in ok[:16]] for p in range(8)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        new = [list(b) for b in books]
        for p in range(8):
            held = defaultdict(list)
            for _, _, v in ok:
                held[near(v, p)[1]].append(part(v, p))
            for e, members in held.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [(i, lab, [near(v, p) for p in range(8)]) for i, lab, v in ok]
    by_label = Counter()
    for _, lab, n in found:
        by_label[lab] += sum(x for x, _ in n)
    return sorted([(i, "".join(f"{e:02x}" for _, e in n), sum(x for x, _ in n), by_label[lab], digest) for i, lab, n in found], key=repr)


def test_vector_codes(spark):
    rng = random.Random(3)
    rows = [(i, (None, 1, 2)[i % 3], [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(10, 90)]
    rows += [rows[4], rows[4], (None, None, rows[5][2]), (200, 1, None), (201, 1, []), (202, 2, [0.5] * 15 + [None]), (203, 2, [float("nan")] * 16), (204, None, [float("inf")] * 16), (205, 1, [0.1] * 8), (206, 1, [0.1] * 12), (207, 5, [3e38] * 16), (9, 1, [-0.0001] * 16)]
    schema = "vec_id long, label int, embedding array<float>, code string, error int"
    as_float = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    df = spark.createDataFrame([(*r, "c", 1) for r in as_float], schema).repartition(3)
    got = vector_codes.product_codes(df).select("id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(as_float)
    few = vector_codes.product_codes(df.filter("vec_id between 10 and 13")).collect()
    assert len(few) == 4 and all(r["error"] == 0 for r in few)
    assert vector_codes.product_codes(df.limit(0)).count() == 0
    assert vector_codes.product_codes(df.filter("vec_id = 200")).count() == 0


def test_codes_of_the_table_equal_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.sql(oracle.product_codes_sql(parts=4, entries=8, rounds=2)).fetchall()
    got = vector_codes.product_codes(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), parts=4, entries=8, rounds=2)
    assert sorted(map(tuple, got.select("id", "code", "error", "label_error", "codebooks_sha256").collect())) == sorted(want)
