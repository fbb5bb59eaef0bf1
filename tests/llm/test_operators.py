"""Operators against plain Python: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import time
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import anchors, bpe, exact_dedup, kneser_ney, line_dedup, ngram_join, oracle, packing, quality_classifier, quality_rules, queries, sharding, substring_dedup, suffix_dedup
from tidewatch.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, h int, shard string, kept string, bucket int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """(id, text): copies, near copies, shared passages, periodic and odd texts."""
    rng = random.Random(11)
    base, passage, line = prose(rng, 120), prose(rng, 45), "one line\nand a second line\nthird line here\nfourth one too"
    texts = [None, "", "  \n\t ", "word", "two words", base, base, base.upper(), f" {base}", base.replace(" ", "\t")]
    for k in range(12):
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 10 + k)} {passage} {prose(rng, 15)}" for k in range(8)]
    texts += [passage, prose(rng, 3000), "a b " * 90, "ab" * 300, "é" * 250 + "x", "é" * 250 + "y", "日本語 テキスト " * 40, "x" * 199, "x" * 200, "x" * 201]
    texts += [f"{prose(rng, 30)}\n{line}\n{prose(rng, 20)}" for _ in range(5)] + [line, line + "\n" + line, "<|endoftext|> a b 'ſs ~~ \x1c"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, len(t or ""), 5, 6, "z", "q", 3) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns, key="id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_sharding(table, docs, empty):
    got = by_id(sharding.byte_prefix_shards(table, 5), "size", "text_crc32", "shard", "slot", key="doc_id")
    assert got == brute.shard_rows(docs, 5)
    assert sharding.byte_prefix_shards(empty, 5).count() == 0
    same = table.filter("doc_id = 5").union(table.filter("doc_id = 5")).union(table.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r["slot"] for r in sharding.byte_prefix_shards(same, 1).collect()) == [0, 1, 2]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(table, docs, empty, size, percent, monkeypatch):
    want = brute.components(docs, size, percent)
    assert by_id(ngram_join.ngram_components(table, size, percent), "n_shingles", "component_id") == want
    assert ngram_join.ngram_components(empty, size, percent).count() == 0


def test_ngram_join_in_blocks_with_frequent_order(table, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT_DOCS", 2)
    assert by_id(ngram_join.ngram_components(table, 3, 90), "n_shingles", "component_id") == brute.components(docs, 3, 90)


def test_fragments_cut_the_global_order():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(2**20, 200).astype(np.uint64) << np.uint64(44) | np.uint64(7)) for _ in range(30)]
    short, df = np.unique(np.concatenate(sets) >> np.uint64(32), return_counts=True)
    tokens, df = short[df > 1].astype(np.uint32), df[df > 1]
    rare, frequent = ngram_join.token_fragments(tokens, df, sum(map(len, sets)))
    assert (np.diff(frequent[np.lexsort((tokens, df))]) >= 0).all() and (not len(frequent) or (frequent.min() >= rare and frequent.max() < ngram_join.FRAGMENTS))
    parts = [ngram_join.cut_in_fragments(s, tokens, rare, frequent) for s in sets]
    assert all((np.sort(np.concatenate(p)) == s).all() for p, s in zip(parts, sets, strict=True))
    whole = sum(ngram_join.overlaps([p[f] for p in parts], [p[f] for p in parts]) for f in range(ngram_join.FRAGMENTS))
    assert (whole == [[len(np.intersect1d(x, y)) for y in sets] for x in sets]).all()


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for _ in range(200):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, n // 8 + 2))], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 2))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                level = [ngram_join.size_class(len(x), percent) for x in (a, b)]
                draw = lambda more: [ngram_join.sketch(x, ngram_join.fragments(c + more, percent)) for x, c in zip((a, b), level, strict=True)]  # noqa: B023, E731
                near = ngram_join.similar_sketches(np.array([len(a), len(b)]), draw(0), draw(1), np.arange(2), np.arange(2), percent)
                assert near[0, 1]


def test_exact_dedup(table, docs, empty):
    want = brute.exact(docs)
    for cut in (-1, 6, 10_000):
        out = exact_dedup.exact_dedup(table.filter(f"doc_id <= {cut}"), table.filter(f"doc_id > {cut}")).withColumn("sha", F.lower(F.hex("digest")))
        assert by_id(out, "keep_id", "group_size", "kept", "sha") == want
    assert exact_dedup.exact_dedup(empty, empty).count() == 0
    nameless = exact_dedup.exact_dedup(empty, table.filter("doc_id in (5, 6)").withColumn("doc_id", F.when(F.col("doc_id") == 6, 6)))
    assert {(r["id"], r["keep_id"], r["kept"]) for r in nameless.collect()} == {(None, 6, False), (6, 6, True)}


def test_perfect_hash_is_a_bijection():
    digests = np.random.default_rng(2).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    levels, rank = exact_dedup.build_levels(digests)
    assert sorted(rank) == list(range(5000)) and (exact_dedup.find_slots(levels, digests) == rank).all()


@pytest.mark.parametrize("shard_bytes", [1_500_000, 300])
def test_substring_dedup(table, docs, empty, shard_bytes):
    w = anchors.Windows("words", 20, 8, shard_bytes)
    out = substring_dedup.substring_dedup(table, w).withColumn("sha", F.sha2("kept", 256))
    assert by_id(out, "n_elements", "n_removed", "sha") == brute.substring(docs)
    assert substring_dedup.substring_dedup(empty, w).count() == 0


@pytest.mark.parametrize("shard_bytes", [2_000_000, 900])
def test_suffix_dedup(table, docs, empty, shard_bytes):
    w = anchors.Windows("bytes", 200, 64, shard_bytes)
    out = suffix_dedup.suffix_dedup(table, w).withColumn("sha", F.sha2("kept", 256))
    assert by_id(out, "n_elements", "n_removed", "n_spans", "sha") == brute.suffixes(docs)
    assert suffix_dedup.suffix_dedup(empty, w).count() == 0


def test_suffix_dedup_keeping_the_first(table, docs):
    got = by_id(suffix_dedup.suffix_dedup(table, keep_first=True), "n_removed")
    seen = set()
    for i, t in docs:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 199):
            if b[k : k + 200] in seen:
                gone |= set(range(k, k + 200))
            seen.add(b[k : k + 200])
        assert got[i] == (len(gone),)


def test_suffix_array_and_automaton_on_small_alphabets():
    rng = random.Random(1)
    for _ in range(150):
        d = bytes(rng.choice(b"abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 60)))
        order = suffix_dedup.suffix_array(np.frombuffer(d, np.uint8))
        assert order.tolist() == sorted(range(len(d)), key=lambda i: d[i:])
        automaton, seen = substring_dedup.SuffixAutomaton(), set()
        for s in (d[: len(d) // 2], d[len(d) // 2 :], d):
            gone = [0] * len(s)
            for k in range(len(s) - 2):
                if s[k : k + 3] in seen:
                    gone[k : k + 3] = [1] * 3
                seen.add(s[k : k + 3])
            mine = [0] * len(s)
            for a, b in automaton.seen_before(list(s), 3):
                mine[a:b] = [1] * (b - a)
            assert mine == gone


def test_suffix_array_of_runs_and_periods():
    rng = np.random.default_rng(5)
    for k in range(60):
        d = np.tile(rng.integers(0, 3, rng.integers(1, 6)).astype(np.uint8), 12)
        d = np.repeat(d, rng.integers(1, 9, len(d))) if k % 2 else d
        assert suffix_dedup.suffix_array(d).tolist() == sorted(range(len(d)), key=lambda i: d[i:].tobytes()), d
    for d in (b"a" * 2_000_000, b"ab" * 500_000, b"a" * 600_000 + b"b" * 600_000):
        data = np.frombuffer(d, np.uint8)
        started = time.process_time()
        order = suffix_dedup.suffix_array(data)
        value, before = suffix_dedup.permuted_common_prefixes(data, suffix_dedup.eight_bytes(data), order)
        assert time.process_time() - started < 5
        assert np.array_equal(np.sort(order), np.arange(len(data)))
        for a, b in zip(order[:-1].tolist()[::99_991], order[1:].tolist()[::99_991], strict=True):
            assert d[a:] < d[b:] and before[b] == a and d[a : a + value[b]] == d[b : b + value[b]] and d[a : a + value[b] + 1] != d[b : b + value[b] + 1]


def test_quality_rules(table, docs, empty):
    out = quality_rules.host_quality_rules(table)
    assert by_id(out, *quality_rules.FIGURES, "base_failed") == {i: brute.rule_figures(t) for i, t in docs}
    assert quality_rules.host_quality_rules(empty).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "clean") for i in range(50)] + [(100 + i, "bad", "spam") for i in range(300)] + [(500, good, "spam"), (501, good, None), (502, "bad", "clean")]
    out = by_id(quality_rules.host_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")), "base_failed", "kept")
    assert out[500] == (False, False) and out[501] == (False, True) and out[502] == (True, False) and out[3] == (False, True)


def test_hosts_fall_by_any_rule_and_rates_equal_plain_python(spark, tmp_path):
    """One host of symbols, one of repeated lines, both beyond the base rules; the rest fail at random."""
    rng, rows = random.Random(4), []
    for i in range(900):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 60, 60, 60, 20)))]
        host = rng.choice(("a", "a", "a", "b", "c", "symbols", "lines", None))
        if host == "symbols" and rng.random() < 0.9 or rng.random() < 0.03:
            words[::5] = ["#x"] * len(words[::5])
        lines = [" ".join(words[k : k + 10]) for k in range(0, len(words), 10)]
        if host == "lines" and rng.random() < 0.8:
            lines += [words[0]] * 5
        rows.append((i, "\n".join(lines), host))
    rows += [(900, None, "b"), (901, "", "c"), (901, "", "c"), (902, "w " * 60, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fails = {name: [] for name in quality_rules.RULES}
    for _, text, host in rows:
        n, chars, symbols, dup_lines, repeats, _ = brute.rule_figures(text)
        n_lines = sum(bool(brute.words(x)) for x in (text or "").split("\n"))
        found = {"few_words": n < 50, "repeats": repeats > 0.5 * n, "symbols": symbols > 0.1 * n, "short_words": chars < 2 * n, "dup_lines": 10 * dup_lines > 3 * n_lines}
        for name in fails:
            if host is not None:
                fails[name].append((host, found[name]))
    want, bad = {}, set()
    for name, pairs in fails.items():
        hosts = defaultdict(list)
        for host, f in pairs:
            hosts[host].append(f)
        n, mean = len(pairs), sum(f for _, f in pairs) / len(pairs)
        scatter = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in hosts.values()) - (len(hosts) - 1) * mean * (1 - mean)
        share = n - sum(len(x) ** 2 for x in hosts.values()) / n - (len(hosts) - 1)
        weight = min(1000.0, max(1.0, mean * (1 - mean) * share / scatter - 1)) if scatter > 1e-9 * n else 1000.0
        for host, x in hosts.items():
            rate = (sum(x) + mean * weight) / (len(x) + weight)
            want[host, name] = rate
            if rate - 2 * math.sqrt(rate * (1 - rate) / (len(x) + weight + 1)) > min(2 * mean, (1 + mean) / 2):
                bad.add(host)
    assert bad == {"symbols", "lines"}
    out = quality_rules.host_quality_rules(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        for name in quality_rules.RULES:
            assert r[f"rate_{name}"] is None if r["host"] is None else math.isclose(r[f"rate_{name}"], want[r["host"], name], abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["host"] not in bad)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(oracle.OP6)
    got = queries.op6_quality_rules(spark, str(tmp_path)).select(sql.columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall()) and sum(not r["kept"] and not r["base_failed"] for r in got) > 100


def test_bpe_equals_the_library_and_decodes(table, docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    got = by_id(bpe.encode(table, VOCABULARY), "token_ids", "decoded")
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))
    digests = by_id(bpe.encode_digests(table, VOCABULARY), "n_tokens", "ids_sha256", "decoded_sha256")
    assert digests == {i: (len(a), hashlib.sha256(np.array(a, "<u4").tobytes()).hexdigest(), brute.sha(b)) for i, (a, b) in got.items()}
    assert bpe.encode(empty, VOCABULARY).count() == 0


def test_bpe_on_random_unicode():
    rng, library, encoder = random.Random(3), Tokenizer.from_file(VOCABULARY), bpe.Encoder(VOCABULARY)
    pools = [range(256), [*range(0xD800), *range(0xE000, 0x11000)], [ord(c) for c in " \t\n\x1c\x85\xa0'sa1²é"], [ord(c) for c in "aaab '"]]
    texts = ["".join(chr(rng.choice(p)) for _ in range(rng.randrange(40))) for p in pools for _ in range(300)]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing(table, docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(table, VOCABULARY, 256).collect():
        own = want[r["id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["id"]])
        pieces[r["id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, ends in [*((pieces[i], [len(w)]) for i, w in want.items()), *((p, range(1, 257)) for p in places.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at in ends
    assert sorted(places) == list(range(len(places)))
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def test_level_array_minimises_the_sum_of_squares():
    rng, levels, fill = random.Random(5), packing.LevelArray(12), {}
    for _ in range(300):
        n = rng.randint(1, 12)
        open_levels = [h for h in fill.values() if h < 12]
        square = lambda hs: sum(hs.count(h) ** 2 for h in set(hs))
        rest = lambda h: [*(open_levels[: open_levels.index(h)] + open_levels[open_levels.index(h) + 1 :]), *([h + n] if h + n < 12 else [])]  # noqa: B023, E731
        best = min([square(open_levels + ([n] if n < 12 else [])), *(square(rest(h)) for h in set(open_levels) if h + n <= 12)])
        window, at = levels.place(n)
        assert fill.get(window, 0) == at
        fill[window] = at + n
        if n < 12:
            assert square([h for h in fill.values() if h < 12]) == best


def removed_lines_occur_earlier(docs, got):
    """Kept lines are the document's lines in order, and each one that is gone starts earlier."""
    seen = set()
    for i, t in docs:
        kept, n_lines, removed = got[i]
        own, left = (t or "").split("\n"), kept.split("\n")
        assert n_lines == len(own) and removed == len(own) - (len(left) if kept or removed < len(own) else 0)
        left = left if removed < len(own) else []
        for line in own:
            if left and line == left[0]:
                left.pop(0)
            else:
                assert line in seen
            seen.add(line)
        assert not left


def test_line_dedup(table, docs, empty):
    got = by_id(line_dedup.line_dedup(table), "kept_text", "n_lines", "n_removed")
    removed_lines_occur_earlier(docs, got)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_removes_whole_passages(spark):
    rng = random.Random(4)
    line = lambda: prose(rng, 6, 5000)
    docs, sizes, want = [], {}, 0
    for k in range(60):
        n = 4 + k % 12
        passage = [line() for _ in range(n)]
        if k % 3 == 0:
            passage[1] = ""
        for copy in range(2):
            docs.append((2 * k + copy, "\n".join([*[line() for _ in range(rng.randrange(5))], *passage, *[line() for _ in range(rng.randrange(5))]])))
        sizes[2 * k + 1] = n
    docs += [(500, docs[0][1]), (501, "one\ntwo"), (502, "one\ntwo"), (503, "again and again\n" * 30)]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")), "kept_text", "n_lines", "n_removed")
    removed_lines_occur_earlier(docs, got)
    assert got[500][0] == got[502][0] == "" and got[503][2] >= 20
    whole = [i for i, n in sizes.items() if got[i][2] >= n]
    assert len([i for i in whole if sizes[i] >= 8]) >= 0.95 * len([i for i in sizes if sizes[i] >= 8]) and len(whole) >= 0.75 * len(sizes)
    assert all(got[i][2] in (0, *range(sizes[i] - 1, sizes[i] + 3)) for i in sizes)


def test_borders_against_loops():
    rng = random.Random(8)
    for _ in range(300):
        lengths = [rng.randrange(9) for _ in range(rng.randrange(1, 5))]
        values = np.array([rng.choice([rng.randrange(2**63), 7]) for _ in range(sum(lengths))], np.uint64)
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        want = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rolled = [None if i == a else int(line_dedup.window_hashes(values[i - 1 : i + 1], 2)[0]) for i in range(a, b)]
            big = lambda i: 2**64 if not 0 <= i < len(rolled) or rolled[i] is None else rolled[i]  # noqa: B023, E731
            for i in range(b - a):
                k = 0
                while rolled[i] is not None and i - k > 0 and rolled[i - k - 1] == rolled[i]:
                    k += 1
                plateau = k % 2 == 1 and i + 1 < len(rolled) and rolled[i + 1] == rolled[i]
                least = big(i) < big(i - 1) and big(i) < big(i + 1)
                want.append((least or plateau) and i >= 1 and b - a - 1 - i >= 2)
        assert line_dedup.borders(values, at).tolist() == want


def test_chunk_borders_resist_shifts():
    rng = random.Random(9)
    body = "\n".join(prose(rng, 5) for _ in range(60))
    cuts = []
    for text in (body, "new first line\nand another\n" + body):
        data = np.frombuffer(text.encode(), np.uint8)
        c = line_dedup.chunks(data, np.array([0, len(data)]))
        cuts.append({data[a:b].tobytes() for a, b in zip(c["start"], c["end"], strict=True)})
    assert len(cuts[0] - cuts[1]) <= 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(240):
        junk = i % 4 == 3
        words = [rng.choice(["the", "rain", "falls", "over", "green", "hills", "and", "rivers", "sing"]) for _ in range(rng.randint(20, 90))]
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), rng.choice(["en", "xx", None])))
        if i < 160:
            marks.append((i, 0 if junk else 1, 0))
    return spark.createDataFrame(rows + [(900, None, "en"), (901, "", None)], "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_documents(labelled, empty):
    docs, labels = labelled
    out = by_id(quality_classifier.classify(docs, labels), "kept")
    held = [i for i in range(160, 240)]
    assert all(out[i][0] == (i % 4 != 3) for i in held) and out[900][0] and out[901][0]
    assert quality_classifier.classify(empty, labels).count() == 0
    assert all(r["kept"] for r in quality_classifier.classify(docs, labels.filter("doc_id < 0")).collect())


def test_classifier_equals_plain_kneser_ney(spark, monkeypatch):
    """Perplexities of every document, over several shards, slices and copies of the model."""
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(3, 60), 50) + rng.choice(["", " é", " \u0448\u0443 \U0001f600"]) for _ in range(60)]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)] + [(90, None, "en"), (91, "", "xx"), (92, texts[0], "xx"), (None, texts[1], "en")]
    marks = [(i, 1 if i % 4 else 0, 0) for i in range(50)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_classifier, "SLICES_A_COPY", 1)
    monkeypatch.setattr(quality_classifier, "STEP", 1 / 16)
    out = {r["id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    own = {r["label_id"] for r in quality_classifier.marks_of(labels).filter("mark = 1").collect()}
    order = 6
    digits = lambda t: "".join(chr(x) for c in t for x in ([ord(c)] if ord(c) < 512 else [512 + ord(c) // 512 % 512, ord(c) % 512]))
    for lang in ("en", None, "xx"):
        p, _ = brute.kneser_ney([digits(t) for i, t, x in rows if i in own and (x == lang or lang == "xx")], order)
        for i, t, x in rows:
            if x == lang and i is not None and t:
                padded = (0,) * (order - 1) + tuple(map(ord, digits(t)))
                steps = [-math.log(p(padded[k : k + order])) for k in range(len(digits(t)))]
                assert out[i]["n_symbols"] == len(steps)
                assert abs(math.log(out[i]["perplexity"]) - sum(round(16 * s) / 16 for s in steps) / len(steps)) < 1e-2, (i, lang)
    assert out[90]["kept"] and out[91]["kept"] and None in out


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(4)
    data = rng.integers(1, 6, 500).astype(np.uint16)
    codes, counts = np.unique(kneser_ney.grams(data, np.array([0, 200, 500])), return_counts=True)
    held = kneser_ney.tables(codes, counts, least=1)
    model = kneser_ney.Model(held, {n: kneser_ney.discounts(kneser_ney.kinds(t[1])) for n, t in held.items()})
    for context in [*np.unique(codes >> np.uint64(10))[:40], np.uint64(12345)]:
        asked = (context << np.uint64(10)) + np.arange(1024, dtype=np.uint64)
        assert abs(model.probabilities(asked, np.full(1024, 1 / 1024)).sum() - 1) < 1e-9


def test_classifier_finds_toxic_words_and_repetition(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(200):
        w = prose(rng, 80).split()
        if i % 5 == 4:  # ordinary prose with three bad words
            for k in range(3):
                w[20 + 4 * k] = "w17o"
        rows.append((i, " ".join(w), "en"))
        if i < 150:
            marks.append((i, 1, int(i % 5 == 4)))
    rows.append((999, "w1 " * 300, "en"))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {i: k for i, (k,) in by_id(quality_classifier.classify(docs, labels), "kept").items()}
    assert not any(kept[i] for i in range(150, 200) if i % 5 == 4) and not kept[999]
    assert sum(kept[i] for i in range(150, 200) if i % 5 != 4) >= 38


def test_steps_of_answers_are_not_clipped():
    log_p, evidence = -np.array([0.0, 1.5, 15.9375, 16.0, 25.125, 90.0]), np.array([0.0, 3.0, 0.0, 17.5, 0.0, 1.0])
    p, e = quality_classifier.from_steps(*quality_classifier.in_steps(log_p, evidence))
    assert (p * quality_classifier.STEP == -log_p).all() and (e * quality_classifier.STEP == evidence).all()
    whole, more = quality_classifier.in_steps(log_p[:3], evidence[:3])
    assert more is None and (quality_classifier.from_steps(whole, more)[0] * quality_classifier.STEP == -log_p[:3]).all()
