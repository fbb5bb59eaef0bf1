"""Operator 12 - language of a text by its words, unseen words by their character n-grams.

Documents are cut into slices; a slice keeps its distinct words and how often each
document has them.  Words go by hash to shards, where the counts of all slices are
summed, and the sums come back to the slices that asked: what travels is a slice's
distinct words, not its text; the slices lie in buckets (a catalog table that is dropped
at once), so that they stay where they are.  Words that no training document has are looked up by
their n-grams: the longest ones of which the training words have any decide.  The
n-grams are counted over the distinct training words of a language and joined with
those of the unseen words.  Model and questions are spread over tasks; the driver only
sees sums by language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .spark_util import bucketed, discard, discard_table, width
from .text_arrays import doc_of, mix, ranges, release, runs, slices, span_hashes, text_bytes, window_hashes, windows_inside

#: Bytes of text in a slice, and in the slices that one shard answers for.
SLICE, SHARD = 4 << 20, 16 << 20
#: Languages that sums are held for; more distinct values are no languages.
LANGUAGES = 4096
#: Added to every count.
SMOOTH = 0.5
#: Lengths of character n-grams, the longest first.
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"

#: A-Z, a-z and all bytes beyond ASCII make words; A-Z count as a-z.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: First byte of the keys of words beyond 8 bytes; no text has it.
_LONG = np.uint64(0xFF << 56)
_BEGIN, _END = 2, 3
_ZSTD = pa.Codec("zstd", 3)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, byte by byte of all, compressed.

    Their size (with 128 added where they are not compressed) and number come first.
    """
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    raw = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()
    small = _ZSTD.compress(raw, asbytes=True) if len(raw) > 64 else raw
    return bytes([kind.itemsize + 128 * (len(raw) <= 64)]) + len(values).to_bytes(8, "little") + small


def widened(body: bytes) -> np.ndarray:
    size, n = body[0] % 128, int.from_bytes(body[1:9], "little")
    raw = body[9:] if body[0] >= 128 else _ZSTD.decompress(body[9:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel().astype(np.int64)


def keys_of(body: bytes) -> np.ndarray:
    return widened(body).view(np.uint64)


def bytes_of(body: bytes) -> np.ndarray:
    return widened(body).astype(np.uint8)


def ascending(values: np.ndarray) -> bytes:
    """Ascending numbers by their steps."""
    return narrow(np.diff(values, prepend=0))


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word of up to 8 bytes as itself, a longer one by a hash of 56 bits."""
    size, key = end - start, np.zeros(len(start), np.uint64)
    for j in range(8):
        at = np.minimum(start + j, max(len(data) - 1, 0))
        key |= np.where(size > j, data[at], 0).astype(np.uint64) << np.uint64(56 - 8 * j)
    long = np.flatnonzero(size > 8)
    if len(long):
        key[long] = _LONG | span_hashes(data, start[long], end[long]) >> np.uint64(8)
    return key


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    return data[np.repeat(start, size) + ranges(size)]


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys) % np.uint64(shards)).astype(np.int64)


COUNTED = "sid long, ids array<long>, held binary, spoken binary, keys binary, long_sizes binary, longs binary, sizes binary, words binary, counts binary, train_words binary, train_langs binary, train_counts binary"


def _counted(sid: int, batch: pa.RecordBatch) -> dict:
    data, at = text_bytes(batch.column("text"))
    start, end = runs(LETTER[data], at) if len(data) else (np.zeros(0, np.int64),) * 2
    data, doc = _LOWER[data], doc_of(np.searchsorted(start, at))
    keys, first, word = np.unique(word_keys(data, start, end), return_index=True, return_inverse=True)
    pair, count = np.unique(doc * max(len(keys), 1) + word, return_counts=True)
    doc, word = pair // max(len(keys), 1), pair % max(len(keys), 1)
    lang = batch.column("lang").to_numpy(zero_copy_only=False)
    known = lang[doc] >= 0
    langs = int(lang.max(initial=0)) + 1
    train, place = np.unique(word[known] * langs + lang[doc[known]], return_inverse=True)
    total = np.bincount(place, count[known], len(train)).astype(np.int64)
    head = doc != np.concatenate([[-1], doc[:-1]])
    long = np.flatnonzero(keys >= _LONG)
    gaps = np.diff(word, prepend=0)
    return {
        "sid": sid, "ids": batch.column("id").to_pylist(), "held": batch.column("held").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), "spoken": batch.column("spoken").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
        "keys": narrow(keys), "long_sizes": narrow((end - start)[first[long]]), "longs": narrow(joined(data, start[first[long]], end[first[long]])),
        "sizes": narrow(np.bincount(doc, minlength=batch.num_rows)), "words": narrow(np.where(head, word, gaps)), "counts": narrow(count),
        "train_words": ascending(train // langs), "train_langs": narrow(train % langs), "train_counts": narrow(total),
    }


def count_words(read: DataFrame) -> DataFrame:
    """One row per slice of (id, held, spoken, lang, text): COUNTED.  ``lang`` is the number of
    the language that a document is learnt from with, else -1."""
    schema = pa.schema([("sid", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c.split()[0], pa.binary()) for c in COUNTED.split(", ")[2:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, part in enumerate(slices(batches, SLICE)):
            yield pa.RecordBatch.from_pylist([_counted(base + number, part)], schema)

    return read.mapInArrow(run, COUNTED)


ASKED = "shard int, sid long, keys binary, long_sizes binary, longs binary, train_words binary, train_langs binary, train_counts binary"


def _part(keys: np.ndarray, sizes: np.ndarray, longs: np.ndarray, chosen: np.ndarray) -> dict:
    """The chosen ones (ascending places) of ascending keys, with the bytes of the long ones."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    own = chosen[keys[chosen] >= _LONG] - (len(keys) - len(sizes))
    return {"keys": narrow(keys[chosen]), "long_sizes": narrow(sizes[own]), "longs": narrow(joined(longs, at[own], at[own + 1]))}


def ask(counted: DataFrame, shards: int) -> DataFrame:
    """ASKED: the words of each slice that a shard has, and their counts by language."""
    schema = pa.schema([("shard", pa.int32()), ("sid", pa.int64()), *[(c.split()[0], pa.binary()) for c in ASKED.split(", ")[2:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            keys, sizes, longs = keys_of(r["keys"]), widened(r["long_sizes"]), bytes_of(r["longs"])
            word, lang, count = np.cumsum(widened(r["train_words"])), widened(r["train_langs"]), widened(r["train_counts"])
            shard = _shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys)) - edge[shard[order]]
            mine = np.argsort(shard[word], kind="stable")
            train_edge = np.searchsorted(shard[word][mine], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(edge)).tolist():
                t = mine[train_edge[s] : train_edge[s + 1]]
                rows.append({"shard": s, "sid": r["sid"], **_part(keys, sizes, longs, order[edge[s] : edge[s + 1]]), "train_words": ascending(place[word[t]]), "train_langs": narrow(lang[t]), "train_counts": narrow(count[t])})
            yield pa.RecordBatch.from_pylist(rows, schema)
        release()

    return counted.select("sid", "keys", "long_sizes", "longs", "train_words", "train_langs", "train_counts").mapInArrow(run, ASKED)


MODEL, ANSWER, UNSEEN = 0, 1, 2
SUMMED = "kind int, shard int, sid long, keys binary, long_sizes binary, longs binary, n binary, langs binary, counts binary, tokens array<long>, n_words long"


def _summed(languages: int):
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("sid", pa.int64()), *[(c, pa.binary()) for c in ("keys", "long_sizes", "longs", "n", "langs", "counts")], ("tokens", pa.list_(pa.int64())), ("n_words", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()
        own = [keys_of(r["keys"]) for r in asked]
        keys, first, where = np.unique(np.concatenate(own), return_index=True, return_inverse=True)
        at = np.concatenate([[0], np.cumsum([len(k) for k in own])])
        codes = np.concatenate([where[a + np.cumsum(widened(r["train_words"]))] * languages + widened(r["train_langs"]) for a, r in zip(at, asked, strict=False)])
        code, back = np.unique(codes, return_inverse=True)
        total = np.bincount(back, np.concatenate([widened(r["train_counts"]) for r in asked]), len(code)).astype(np.int64)
        lang = code % languages
        edge = np.searchsorted(code // languages, np.arange(len(keys) + 1))
        n = np.diff(edge)
        # Bytes of the long words: each from the first slice that has it.
        long = np.flatnonzero(keys >= _LONG)
        sizes, parts, slice_of = np.zeros(len(long), np.int64), [b""] * len(long), np.searchsorted(at, first[long], "right") - 1
        for s in np.unique(slice_of).tolist():
            size, text = widened(asked[s]["long_sizes"]), bytes_of(asked[s]["longs"]).tobytes()
            end, bare = np.cumsum(size), len(own[s]) - len(size)
            for k in np.flatnonzero(slice_of == s).tolist():
                i = int(first[long[k]] - at[s]) - bare
                parts[k], sizes[k] = text[int(end[i] - size[i]) : int(end[i])], size[i]
        longs = np.frombuffer(b"".join(parts), np.uint8)
        shard = asked[0]["shard"]
        known = np.flatnonzero(n > 0)
        rows = [
            {"kind": MODEL, "shard": shard, **_part(keys, sizes, longs, known), "n": narrow(n[known]), "langs": narrow(lang), "tokens": np.bincount(lang, total, languages).astype(np.int64).tolist(), "n_words": len(known)},
            {"kind": UNSEEN, "shard": shard, **_part(keys, sizes, longs, np.flatnonzero(n == 0))},
        ]
        for a, z, r in zip(at[:-1].tolist(), at[1:].tolist(), asked, strict=True):
            w = where[a:z]
            got = np.repeat(edge[w], n[w]) + ranges(n[w])
            rows.append({"kind": ANSWER, "shard": shard, "sid": r["sid"], "keys": narrow(keys[w[n[w] == 0]]), "n": narrow(n[w]), "langs": narrow(lang[got]), "counts": narrow(total[got])})
        out = pa.Table.from_pylist(rows, schema)
        release()
        return out

    return run


def _windows(r: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word's place and hash of each distinct n-gram of the padded words of a row."""
    keys, sizes = keys_of(r["keys"]), widened(r["long_sizes"])
    short = keys[: len(keys) - len(sizes)].astype(">u8").view(np.uint8)
    lengths = np.concatenate([(short.reshape(-1, 8) != 0).sum(1), sizes]).astype(np.int64)
    raw = np.concatenate([short[short != 0], bytes_of(r["longs"])])
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    whole = np.concatenate([[0], np.cumsum(lead)])
    end = np.cumsum(lengths)
    chars = whole[end] - whole[end - lengths]
    if chars.sum() != len(points):  # bytes that are no UTF-8 count one each
        points, chars = raw.astype(np.uint32), lengths
    at = np.concatenate([[0], np.cumsum(chars + 2)])
    values = np.zeros(at[-1], np.uint64)
    values[at[:-1]], values[at[1:] - 1] = _BEGIN, _END
    values[np.repeat(at[:-1] + 1, chars) + ranges(chars)] = points
    word = doc_of(at)
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = windows_inside(at, n, len(values))
    if n == 1:
        inside = inside & (values > _END)
    word, gram = word[: len(inside)][inside], window_hashes(mix(values + np.uint64(n << 32)), n)[inside]
    order = np.lexsort((gram, word))
    word, gram = word[order], gram[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (gram[1:] != gram[:-1])
    return word[new], gram[new]


def gram_counts(model: DataFrame, n: int) -> DataFrame:
    """gram, lang, c: in how many known words of a language each n-gram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            word, gram = _windows(r, n)
            have, langs = widened(r["n"]), widened(r["langs"])
            at = np.concatenate([[0], np.cumsum(have)])
            lang = langs[np.repeat(at[word], have[word]) + ranges(have[word])]
            gram = np.repeat(gram, have[word])
            order = np.lexsort((gram, lang))
            gram, lang = gram[order], lang[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (lang[1:] != lang[:-1])
            head = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(gram[head].view(np.int64)), pa.array(lang[head], pa.int32()), pa.array(np.diff(np.append(head, len(gram))))], names=["gram", "lang", "c"])
        release()

    return model.select("keys", "long_sizes", "longs", "n", "langs").mapInArrow(run, "gram long, lang int, c long").groupBy("gram", "lang").agg(F.sum("c").alias("c"))


def word_grams(unseen: DataFrame, n: int) -> DataFrame:
    """key, gram: the distinct n-grams of each unseen word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            word, gram = _windows(r, n)
            yield pa.RecordBatch.from_arrays([pa.array(widened(r["keys"])[word]), pa.array(gram.view(np.int64))], names=["key", "gram"])
        release()

    return unseen.select("keys", "long_sizes", "longs").mapInArrow(run, "key long, gram long")


def back_off(model: DataFrame, unseen: DataFrame, languages: int) -> tuple[DataFrame | None, dict[int, np.ndarray]]:
    """key, n, langs, gains of the unseen words, and by n the log of SMOOTH over the language's sum.

    The gain of a language is the mean, over the word's n-grams that any training word has,
    of log((c + SMOOTH) / SMOOTH); n is the longest length at which there is one.
    """
    out, base = None, {}
    for n in LENGTHS:
        grams = word_grams(unseen, n)
        if out is not None:  # words that have no answer yet
            grams = grams.join(out.select("key"), "key", "left_anti")
        grams = cut(grams)
        if grams.isEmpty() and out is not None:
            continue
        counts = cut(gram_counts(model, n))
        sums = {r["lang"]: r["s"] for r in counts.groupBy("lang").agg(F.sum("c").alias("s")).collect()}
        distinct = counts.agg(F.count_distinct("gram")).first()[0]
        base[n] = np.log(SMOOTH / (np.array([sums.get(i, 0) for i in range(languages)]) + SMOOTH * max(distinct, 1)))
        by_gram = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "c")).alias("counts"))
        hits = grams.join(by_gram, "gram").groupBy("key").agg(F.count("*").alias("k"), F.flatten(F.collect_list("counts")).alias("counts"))
        hits = hits.select("key", "k", F.explode("counts").alias("g")).groupBy("key", "g.lang").agg((F.sum(F.log((F.col("g.c") + SMOOTH) / SMOOTH)) / F.first("k")).alias("gain"))
        own = cut(hits.groupBy("key").agg(F.lit(n).alias("n"), F.collect_list(F.struct("lang", "gain")).alias("gains")))
        out = own if out is None else out.union(own)
    return out, base


def _scored(base: dict[int, np.ndarray], names: list[str]):
    """Predictions of the documents of a slice from its answers."""

    def one(r: dict) -> dict[str, list]:
        size, word, count = (widened(r[c]) for c in ("sizes", "words", "counts"))
        doc = np.repeat(np.arange(len(size)), size)
        at = np.concatenate([[0], np.cumsum(size)])
        total = np.cumsum(word)
        before = np.concatenate([[0], total])[at[:-1]]
        word = total - np.repeat(before, size)
        keys = keys_of(r["keys"])
        shards = {a["shard"]: a for a in r["answers"] or []}
        level = np.full(len(keys), -1, np.int64)
        at_word, at_lang, gain = [], [], []
        for own in np.split(order := np.argsort(shard := _shard_of(keys, r["shards"]), kind="stable"), np.flatnonzero(np.diff(shard[order])) + 1) if len(keys) else []:
            a = shards[int(shard[own[0]])]
            n = widened(a["n"])
            level[own[n > 0]] = 0
            at_word.append(np.repeat(own, n))
            at_lang.append(widened(a["langs"]))
            gain.append(np.log((widened(a["counts"]) + SMOOTH) / SMOOTH))
        for f in r["unseen"] or []:
            w = int(np.searchsorted(keys, np.uint64(f["key"] % 2**64)))
            level[w] = f["n"]
            at_word.append(np.full(len(f["gains"]), w))
            at_lang.append(np.array([g["lang"] for g in f["gains"]], np.int64))
            gain.append(np.array([g["gain"] for g in f["gains"]]))
        at_word, at_lang, gain = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((at_word, np.int64), (at_lang, np.int64), (gain, np.float64)))
        order = np.argsort(at_lang, kind="stable")
        edge = np.searchsorted(at_lang[order], np.arange(len(names) + 1))
        scores = np.zeros((len(names), len(size)))
        for i in range(len(names)):
            value = np.zeros(len(keys))
            for n, floors in base.items():
                value[level == n] = floors[i]
            own = order[edge[i] : edge[i + 1]]
            value[at_word[own]] += gain[own]
            scores[i] = np.bincount(doc, count * value[word], len(size))
        spoken = np.frombuffer(r["spoken"], np.uint8).astype(bool) & bool(names)
        best = scores.argmax(0) if names else np.zeros(len(size), np.int64)
        top = scores.max(0, initial=-np.inf)
        with np.errstate(invalid="ignore"):
            posterior = 1 / np.exp(scores - top).sum(0) if names else np.zeros(len(size))
        return {
            "id": r["ids"], "held_out": np.frombuffer(r["held"], np.uint8).astype(bool).tolist(),
            "lang_pred": [names[b] if s else UNKNOWN for b, s in zip(best.tolist(), spoken.tolist(), strict=True)], "score": np.where(spoken, np.round(posterior, 6), 0.0).tolist(),
        }

    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(one(batch.slice(k, 1).to_pylist()[0]), schema)
        release()

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """id, held_out, lang_pred and score of every row of ``docs``.

    Learnt from are rows with text and language whose crc32(id as text) mod ``folds`` is not
    0; a null id counts as the empty text, whose remainder is 0.  Words are runs of ASCII
    letters (A-Z as a-z) and characters beyond ASCII.  A language's score is the sum, over
    a text's words, of log((c + 0.5) / (T + 0.5 V)): c times the word, of T words, of V
    distinct ones in all languages; for words never learnt the mean of that over their
    character n-grams (ends of the word included), of the longest of 4 to 1 characters
    that any learnt word has, counted over a language's distinct words.  Of equal scores the
    first language by name is taken.  ``score`` is its share of exp(scores), to 6 digits.

    A null text, one without a letter, and every text where nothing is learnt give ``und``
    with score 0; letters without any known n-gram give the first language and an equal
    share.  Repeated rows each count and have the same answer.  More than LANGUAGES distinct
    language values are an error, as sums by language are sent to every task.
    """
    identity = F.col(id_col).cast("long")
    held = F.pmod(F.crc32(F.coalesce(identity.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
    read = docs.select(identity.alias("id"), held.alias("held"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    learnt = F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.col("held")
    names = sorted(r["lang"] for r in read.filter(learnt).select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} distinct values in {lang_col}")
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(width(docs.sparkSession), -(-size // SHARD))
    number = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1, F.lit(-1)) if names else F.lit(-1)
    counted, place = bucketed(count_words(read.select("id", "held", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken"), F.when(learnt, number).otherwise(-1).cast("int").alias("lang"), "text")), "sid", max(width(docs.sparkSession), -(-size // SLICE)))
    summed = cut(ask(counted, shards).groupBy("shard").applyInArrow(_summed(max(len(names), 1)), SUMMED))
    model, unseen = summed.filter(F.col("kind") == MODEL), summed.filter(F.col("kind") == UNSEEN)
    tokens = {r["pos"]: r["s"] for r in model.select(F.posexplode("tokens")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    n_words = model.agg(F.sum("n_words")).first()[0] or 0
    found, base = back_off(model, unseen, len(names)) if names else (None, {})
    base[0] = np.log(SMOOTH / (np.array([tokens.get(i, 0) for i in range(len(names))]) + SMOOTH * max(n_words, 1)))
    answered = summed.filter(F.col("kind") == ANSWER)
    answers = answered.groupBy("sid").agg(F.collect_list(F.struct("shard", "n", "langs", "counts")).alias("answers"))
    judged = counted.select("sid", "ids", "held", "spoken", "keys", "sizes", "words", "counts").join(answers, "sid", "left")
    if found is not None:
        asked = answered.select("sid", "keys").mapInArrow(_exploded, "sid long, key long").join(found, "key")
        judged = judged.join(asked.groupBy("sid").agg(F.collect_list(F.struct("key", "n", "gains")).alias("unseen")), "sid", "left")
    else:
        judged = judged.withColumn("unseen", F.lit(None).cast("array<struct<key:bigint,n:int,gains:array<struct<lang:int,gain:double>>>>"))
    out = cut(judged.withColumn("shards", F.lit(shards)).mapInArrow(_scored(base, names), "id long, held_out boolean, lang_pred string, score double"))
    discard(docs.sparkSession, place)
    discard_table(summed)
    return out


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sid, keys in zip(batch.column("sid").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            own = widened(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), sid)), pa.array(own)], names=["sid", "key"])
