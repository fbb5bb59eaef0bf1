"""Operator 9 - quality by perplexity under an interpolated modified Kneser-Ney model.

The model counts n-grams of six symbols (code points, ``kneser_ney``) of all trusted text,
by language and for all languages together.  Its count table grows with the corpus and
stays in Spark, sharded by the context's last two symbols.  Documents are packed into
slices, written once.  A slice asks each shard for its distinct n-grams; the shard works
out the Kneser-Ney probabilities from its counts; the answers are joined back to the slice
and summed by document.  With each n-gram come the numbers of trusted and of bad documents
that hold it, from which a second figure is drawn, the evidence against a document.

A document is rejected when its perplexity is above its language's limit or, for mere
repetition, below a lower one, or when its evidence is above its language's limit.  The
limits are quantiles of trusted documents that were held out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .spark_util import bucketed, cut, discard, let_go, width
from .text_arrays import release, slices

#: Quantile of held-out trusted documents, and how far a perplexity may lie beyond it.
QUANTILE, MARGIN = 0.99, 1.15
#: Scores of short documents are drawn to the language's mean as if so many more symbols scored it.
PRIOR_SYMBOLS = 60
#: One trusted document in so many is held out for the limits.
HELD_OUT = 5
#: Discount of the number of bad documents that hold an n-gram.
DISCOUNT = 0.75
TRUSTED, BAD, HELD = 1, 2, 3
#: Model of all languages; a language's own is its name after "=".
ALL = "*"
#: Bytes of text in a slice, and for each shard of the model at most (SHARDS shards at most).
SLICE, SHARD, SHARDS = 32 << 20, 32 << 20, 4096
#: Most buckets of the table of slices (Spark allows 100,000); a bucket's slices are read one by one.
BUCKETS = 1 << 16
#: Slices that one copy of the model answers.
SLICES_A_COPY = 256
#: Seconds to wait where the files of earlier steps must be gone.
WAIT = 1.5
#: Distinct n-grams that a task holds before it hands its counts on.
_HELD = 3 << 19
#: Bytes of text that are worked on at a time.
_AT_ONCE = 3 << 19
#: Steps of the answers: log probabilities and evidence travel as single bytes, with two bytes beyond 255 steps.
STEP = 1 / 16


def frozen(**columns: np.ndarray) -> bytes:
    """Arrays of one length as compressed Arrow; ``gram`` (ascending) as differences."""
    if "gram" in columns:
        columns["gram"] = np.diff(columns["gram"], prepend=np.uint64(0))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    return _written([batch], batch.schema, 3)


def thawed(body: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(body).read_next_batch()
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
    if "gram" in out:
        out["gram"] = np.cumsum(out["gram"], dtype=np.uint64)
    return out


def _written(batches: list[pa.RecordBatch], schema: pa.Schema, level: int) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """sid, body: ``docs`` in slices of about SLICE bytes of text, each of several batches.

    Table and path; it is bucketed by sid, so that answers come to the slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out(number: int) -> pa.RecordBatch:
            body = _written(held, held[0].schema, 6)
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([body], pa.binary())], names=["sid", "body"])

        number = 0
        for batch in slices(batches, _AT_ONCE):
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE:
                yield out(number)
                number, size = number + 1, 0
                held.clear()
        if held:
            yield out(number)

    return bucketed(docs.mapInArrow(run, "sid long, body binary"), "sid", buckets)


def opened(body: bytes) -> Iterator[pa.RecordBatch]:
    return iter(pa.ipc.open_stream(body))


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """Language, rows and texts; a null language is ''."""
    lang = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
    for name in sorted(set(lang)):
        rows = np.flatnonzero(lang == name)
        yield name, rows, batch.column("text").take(pa.array(rows))


def document_counts(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, n-gram) pairs: document, n-gram, and how often it occurs there."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((codes, doc))
    codes, doc = codes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])])) if len(codes) else np.zeros(0, np.int64)
    return doc[first], codes[first], np.diff(np.append(first, len(codes)))


def count_ngrams(marked: DataFrame, shards: int) -> DataFrame:
    """shard, model, body (n-gram; c, its occurrences in TRUSTED text; documents marked
    TRUSTED and BAD that hold it): partial sums of each task over (lang, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                sums = kn.summed(*[np.concatenate(c) for c in zip(*parts, strict=True)])
                shard = kn.shard_of(sums[0], shards)
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    own = order[edge[s] : edge[s + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array(["=" + lang]), pa.array([frozen(**{n: c[own] for n, c in zip(("gram", "c", "good", "bad"), sums, strict=True)})], pa.binary())], names=["shard", "model", "body"]
                    )

        for batch in slices(batches, _AT_ONCE):
            marks = np.array(batch.column("mark").to_pylist(), np.int64)
            for lang, rows, texts in by_language(batch):
                doc, codes, c = document_counts(*_codes(texts))
                trusted = (marks[rows] == TRUSTED)[doc].astype(np.int64)
                held.setdefault(lang, []).append(kn.summed(codes, c * trusted, trusted, 1 - trusted))
                size += len(held[lang][-1][0])
            if size > _HELD:
                for lang, parts in held.items():
                    held[lang] = [kn.summed(*[np.concatenate(c) for c in zip(*parts, strict=True)])]
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size > _HELD // 2:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    return marked.select("lang", "mark", "text").mapInArrow(run, "shard int, model string, body binary")


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = kn.symbols(texts)
    return kn.grams(data, at), at


COLUMNS = ("gram", "c", "good", "bad")


def _sums(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return dict(zip(COLUMNS, kn.summed(*[np.concatenate([h[c] for h in held]) for c in COLUMNS]), strict=True))


def _trusted(sums: dict[str, np.ndarray]) -> kn.Table:
    seen = sums["c"] > 0
    return sums["gram"][seen], sums["c"][seen]


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's sums by model, with ``part``, what it adds to the model's base table and discounts;
    for ALL (the sum of the others) that part alone."""
    held: dict[str, list[dict[str, np.ndarray]]] = {}
    shard = None
    for batch in batches:
        for s, model, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = s
            held.setdefault(model, []).append(thawed(body.as_py()))
            if len(held[model]) > 32:
                held[model] = [_sums(held[model])]
    sums = {model: _sums(parts) for model, parts in held.items()}
    for model, own in [*sums.items(), (ALL, _sums(list(sums.values())))]:
        orders = kn.tables(*_trusted(own))
        codes, counts = np.unique(kn.suffix(orders[kn.BASE + 1][0], kn.BASE), return_counts=True)
        seen = np.concatenate([kn.kinds(orders[n][1]) for n in range(kn.BASE + 1, kn.ORDER + 1)])
        part = frozen(gram=np.append(codes, np.full(len(seen), codes[-1] if len(codes) else 0, np.uint64)), c=np.append(counts, seen))
        body = None if model == ALL else frozen(**own)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([model]), pa.array([body], pa.binary()), pa.array([part], pa.binary())], names=["shard", "model", "body", "part"])


_STATS = kn.KINDS * (kn.ORDER - kn.BASE)


def base_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A model's base table and the counts of counts of its higher orders, summed over shards."""
    codes, counts, seen, model = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(_STATS, np.int64), None
    for batch in batches:
        for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            model, own = name, thawed(part.as_py())
            seen = seen + own["c"][-_STATS:]
            codes, counts = kn.summed(np.append(codes, own["gram"][:-_STATS]), np.append(counts, own["c"][:-_STATS]))
    part = frozen(gram=np.append(codes, np.full(_STATS, codes[-1] if len(codes) else 0, np.uint64)), c=np.append(counts, seen))
    yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([part], pa.binary())], names=["model", "base"])


class Shard:
    """One model's part of a shard: log probability and evidence of n-grams of order ORDER."""

    def __init__(self, sums: dict[str, np.ndarray], base: bytes, good: int, bad: int):
        own = thawed(base)
        lower = kn.tables(own["gram"][:-_STATS], own["c"][:-_STATS], kn.BASE, 1)
        seen = own["c"][-_STATS:].reshape(-1, kn.KINDS)
        taken = {n: kn.discounts(kn.kinds(t[1])) for n, t in lower.items()} | {n: kn.discounts(seen[n - kn.BASE - 1]) for n in range(kn.BASE + 1, kn.ORDER + 1)}
        self.lower, self.upper = kn.Model(lower, taken), kn.Model(kn.tables(*_trusted(sums)), taken)
        self.sums, self.good, self.bad = sums, max(good, 1), max(bad, 1)

    def answer(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.upper.probabilities(asked, self.lower.probabilities(asked, np.full(len(asked), 1 / kn.SYMBOLS)))
        place, seen = kn.find(self.sums["gram"], asked)
        if not len(self.sums["gram"]):
            return np.log(p), np.zeros(len(asked))
        good, bad = np.where(seen, self.sums["good"][place], 0), np.where(seen, self.sums["bad"][place], 0)
        evidence = np.log(np.maximum(bad - DISCOUNT, 1e-9) / self.bad) - np.log((good + 1) / self.good)
        return np.log(p), np.where(bad > 0, np.maximum(evidence, 0.0), 0.0)


def distinct(body: bytes) -> dict[str, np.ndarray]:
    """The slice's distinct n-grams by language."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in opened(body):
        for lang, _, texts in by_language(batch):
            held.setdefault(lang, []).append(np.unique(_codes(texts)[0]))
            if sum(map(len, held[lang])) > _HELD:
                held[lang] = [np.unique(np.concatenate(held[lang]))]
    return {lang: np.unique(np.concatenate(parts)) for lang, parts in held.items()}


def questions(packed: DataFrame, shards: int) -> DataFrame:
    """sid, shard, model, body: the n-grams that each slice asks of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, body in zip(batch.column("sid").to_pylist(), batch.column("body"), strict=True):
                for lang, codes in distinct(body.as_py()).items():
                    shard = kn.shard_of(codes, shards)
                    for s in np.unique(shard).tolist():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([sid], pa.int64()), pa.array([s], pa.int32()), pa.array(["=" + lang]), pa.array([frozen(gram=codes[shard == s])], pa.binary())], names=["sid", "shard", "model", "body"]
                        )
        release()

    return packed.select("sid", "body").mapInArrow(run, "sid long, shard int, model string, body binary")


def answers(asked: DataFrame, model: DataFrame, copies: int) -> DataFrame:
    """sid, shard, model, answer: log probability and evidence of each n-gram, in steps.

    ``model`` has (shard, model, body, base, good, bad).  Rows of a shard arrive sorted, its
    model before the questions, so a task holds one shard and a batch.  A language without
    trusted text is answered by the model ALL.
    """
    none = lambda kind: F.lit(None).cast(kind)
    known = model.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("shard", "copy", F.lit(0).alias("kind"), none("long").alias("sid"), "model", "body", "base", "good", "bad")
    rows = known.union(asked.select("shard", F.pmod(F.xxhash64("sid"), F.lit(copies)).cast("int"), F.lit(1), "sid", "model", "body", none("binary"), none("long"), none("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if (r["shard"], r["copy"]) != now:
                    now, held, ready = (r["shard"], r["copy"]), {}, {}
                if r["kind"] == 0:
                    held[r["model"]] = (r["body"], r["base"], r["good"], r["bad"])
                    continue
                name = r["model"] if r["model"] in held else ALL
                if name not in ready:
                    ready[name] = _shard_from(held, name)
                codes = thawed(r["body"])["gram"]
                log_p, evidence = ready[name].answer(codes) if ready[name] else (np.zeros(len(codes)), np.zeros(len(codes)))
                whole, more = in_steps(log_p, evidence)
                yield pa.RecordBatch.from_arrays([pa.array([r["sid"]], pa.int64()), pa.array([r["shard"]], pa.int32()), pa.array([r["model"]]), pa.array([whole], pa.binary()), pa.array([more], pa.binary())], names=["sid", "shard", "model", "answer", "more"])

    return rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind").mapInArrow(run, "sid long, shard int, model string, answer binary, more binary")


def in_steps(log_p: np.ndarray, evidence: np.ndarray) -> tuple[bytes, bytes | None]:
    """Both figures in steps: a byte each, and two bytes each for the few n-grams where a byte is too short."""
    p, e = np.rint(-log_p / STEP), np.rint(evidence / STEP)
    long = np.flatnonzero((p > 255) | (e > 255))
    more = frozen(at=long.astype(np.int32), p=p[long].astype(np.uint16), e=e[long].astype(np.uint16)) if len(long) else None
    p[long], e[long] = 0, 0
    return frozen(p=p.astype(np.uint8), e=e.astype(np.uint8)), more


def from_steps(whole: bytes, more: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    answer = thawed(whole)
    p, e = answer["p"].astype(np.uint16), answer["e"].astype(np.uint16)
    if more is not None:
        long = thawed(more)
        p[long["at"]], e[long["at"]] = long["p"], long["e"]
    return p, e


def _shard_from(held: dict[str, tuple], name: str) -> Shard | None:
    if name not in held:
        return None
    bodies = [thawed(b) for m, (b, *_) in held.items() if b is not None and name in (m, ALL)]
    empty = {c: np.zeros(0, np.uint64 if c == "gram" else np.int64) for c in COLUMNS}
    return Shard(_sums(bodies) if bodies else empty, *held[name][1:])


def score(packed: DataFrame, answered: DataFrame, shards: int) -> DataFrame:
    """sid, row, id, lang, n_symbols, log_likelihood, evidence (the largest of any n-gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sid, body, got in ((b.column("sid")[k].as_py(), b.column("body")[k].as_py(), b.column("got")[k].as_py()) for b in batches for k in range(b.num_rows)):
            found = {(g["model"], g["shard"]): (g["answer"], g["more"]) for g in got or []}
            known: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for lang, codes in distinct(body).items():
                shard, p, e = kn.shard_of(codes, shards), np.zeros(len(codes), np.uint16), np.zeros(len(codes), np.uint16)
                for s in np.unique(shard).tolist():
                    p[shard == s], e[shard == s] = from_steps(*found["=" + lang, s])
                known[lang] = codes, p, e
            first = 0
            for batch in opened(body):
                n, total, most = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for lang, rows, texts in by_language(batch):
                    own, at = _codes(texts)
                    codes, p, e = known[lang]
                    u, back = np.unique(own, return_inverse=True)
                    place = np.searchsorted(codes, u)
                    n[rows] = np.diff(at)
                    total[rows] = -STEP * np.diff(np.concatenate([[0], np.cumsum(p[place][back], dtype=np.int64)])[at])
                    full = rows[np.diff(at) > 0]
                    if len(full):
                        most[full] = STEP * np.maximum.reduceat(e[place][back], at[:-1][np.diff(at) > 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, sid)), pa.array(np.arange(first, first + batch.num_rows), pa.int64()), batch.column("id"), pa.array([x or "" for x in batch.column("lang").to_pylist()], pa.string()), pa.array(n), pa.array(total), pa.array(most)],
                    names=["sid", "row", "id", "lang", "n_symbols", "log_likelihood", "evidence"],
                )
                first += batch.num_rows
        release()

    got = answered.groupBy("sid").agg(F.collect_list(F.struct("model", "shard", "answer", "more")).alias("got"))
    return packed.join(got, "sid", "left").select("sid", "body", "got").mapInArrow(run, "sid long, row long, id long, lang string, n_symbols long, log_likelihood double, evidence double")


def train(marked: DataFrame, shards: int) -> DataFrame:
    """shard, model, body, base, good, bad: the model, from (lang, mark, text) of marked documents."""
    merged = cut(count_ngrams(marked, shards).groupBy("shard").applyInArrow(merge, "shard int, model string, body binary, part binary"))
    base = merged.select("model", "part").groupBy("model").applyInArrow(base_of, "model string, base binary")
    number = lambda m: F.sum((F.col("mark") == m).cast("long"))
    own = marked.groupBy(F.concat(F.lit("="), F.coalesce("lang", F.lit(""))).alias("model")).agg(number(TRUSTED).alias("good"), number(BAD).alias("bad"))
    sizes = cut(own)
    sizes = sizes.union(sizes.agg(F.lit(ALL), F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))))
    return cut(merged.drop("part").join(base, "model").join(sizes.filter("good > 0"), "model").select("shard", "model", "body", "base", "good", "bad"))


def marks_of(labels: DataFrame) -> DataFrame:
    """id and mark of every labelled document: BAD with any label that calls it bad or toxic, else
    TRUSTED or (one in HELD_OUT) HELD where a label calls it good."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    held = F.when(F.pmod(F.xxhash64("label_id", F.lit(9)), F.lit(HELD_OUT)) == 0, HELD).otherwise(TRUSTED)
    return (
        labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.coalesce(F.max(good), F.lit(False)).alias("good"), F.coalesce(F.max(bad), F.lit(False)).alias("bad"))
        .select("label_id", F.when(F.col("bad"), BAD).when(F.col("good"), held).cast("int").alias("mark"))
        .filter("mark is not null")
    )


def limits(scores: DataFrame, quantile: float, margin: float) -> DataFrame:
    """model, mean (log likelihood of a symbol), upper, lower, evidence_limit, from scored documents with a mark.

    A model's limits come from its HELD documents, or from its TRUSTED ones where none is held
    out; the lower one from both, as copies of counted documents score lower than others.
    """
    trusted = scores.filter(F.col("mark").isin(TRUSTED, HELD)).withColumn("model", F.explode(F.array(F.concat(F.lit("="), "lang"), F.lit(ALL))))
    kinds = trusted.groupBy("model").agg(F.max((F.col("mark") == HELD).cast("int")).alias("has_held"))
    both = trusted.join(kinds, "model").withColumn("own", (F.col("mark") == HELD) | (F.col("has_held") == 0))
    total = lambda c: F.sum(F.when(F.col("own"), F.col(c)))
    means = both.groupBy("model").agg((total("log_likelihood") / F.greatest(total("n_symbols"), F.lit(1))).alias("mean"))
    at = lambda c, q: F.percentile_approx(c, q, 10_000)
    own = lambda c: F.when(F.col("own"), F.col(c))
    found = both.join(means, "model").withColumn("drawn", drawn()).groupBy("model").agg((margin * at(own("drawn"), quantile)).alias("upper"), (at("drawn", 1 - quantile) / margin).alias("lower"), at(own("evidence"), quantile).alias("evidence_limit"))
    return means.join(found, "model")


def drawn() -> F.Column:
    """Perplexity drawn to the mean of the model."""
    return F.exp(-(F.col("log_likelihood") + PRIOR_SYMBOLS * F.col("mean")) / (F.col("n_symbols") + PRIOR_SYMBOLS))


FIGURES = ["id", "lang", "n_symbols", "perplexity", "shrunk", "upper", "lower", "evidence", "evidence_limit", "kept"]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, carry: tuple[str, ...] = ()) -> DataFrame:
    """FIGURES of every row of ``docs`` and the columns ``carry`` (``_name`` for a column ``name``).

    Trusted are documents that ``labels`` (doc_id, quality, toxic) calls good and not toxic,
    bad those with a label that calls them bad or toxic; null ids have no label, rows with
    one id share its label, and every row has its own verdict.  The upper limit of a
    language is ``margin`` times the ``quantile`` of the held-out documents' perplexities,
    drawn to the language's mean; the lower limit is the opposite quantile of all
    trusted ones divided by ``margin``; the evidence's limit is its quantile.  A language without trusted text is
    judged by the model and the limits of all.  An empty or null text has the mean
    perplexity and is kept, as every document is while nothing is trusted.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry if c not in (id_col, text_col, lang_col)])
    marks = cut(marks_of(labels))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(SHARDS, max(width(docs.sparkSession), -(-size // SHARD)))
    # Always by shuffle, whatever the labels' size: their number grows with the corpus.
    marked = read.select("id", "lang", "text").join(marks.hint("merge"), F.col("id") == F.col("label_id"))
    model = train(marked.filter(F.col("mark").isin(TRUSTED, BAD)), shards)
    let_go(docs.sparkSession, WAIT)
    packed, place = pack(read, max(width(docs.sparkSession), min(BUCKETS, -(-size // SLICE))))
    copies = 1 + packed.count() // SLICES_A_COPY
    answered = cut(answers(questions(packed, shards), model, copies))
    del model, marked  # their files go with them
    let_go(docs.sparkSession, WAIT)
    scores = cut(score(packed, answered, shards))
    del answered
    if not carry:  # else the rows come from the slices
        discard(docs.sparkSession, place)
    let_go(docs.sparkSession, WAIT)
    found = limits(scores.join(marks, F.col("id") == F.col("label_id")), quantile, margin)
    everyone = found.filter(F.col("model") == ALL).select(*[F.col(c).alias(f"all_{c}") for c in found.columns if c != "model"])
    judged = scores.withColumn("model", F.concat(F.lit("="), "lang")).join(found, "model", "left").join(F.broadcast(everyone), how="left")
    for c in ("mean", "upper", "lower", "evidence_limit"):
        judged = judged.withColumn(c, F.coalesce(c, f"all_{c}"))
    judged = judged.withColumns({
        "perplexity": F.exp(-F.col("log_likelihood") / F.greatest("n_symbols", F.lit(1))),
        "shrunk": drawn(),
    }).withColumn("kept", (F.col("n_symbols") == 0) | F.coalesce(F.col("shrunk") <= F.col("upper"), F.lit(True)) & F.coalesce(F.col("shrunk") >= F.col("lower"), F.lit(True)) & F.coalesce(F.col("evidence") <= F.col("evidence_limit"), F.lit(True)))
    return judged.select(FIGURES) if not carry else with_rows(packed, judged, read, {id_col: "id", text_col: "text", lang_col: "lang"}, carry)


def with_rows(packed: DataFrame, judged: DataFrame, read: DataFrame, names: dict[str, str], carry: tuple[str, ...]) -> DataFrame:
    """The packed rows with their figures."""
    verdicts = judged.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("row", *FIGURES))).alias("verdicts"))
    own = {f"_{c}": names.get(c, f"_{c}") for c in carry}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, first = batch.column("verdicts").slice(k, 1).flatten(), 0
                for part in opened(batch.column("body")[k].as_py()):
                    mine = rows.slice(first, part.num_rows)
                    first += part.num_rows
                    yield pa.RecordBatch.from_arrays([*[mine.field(1 + i) for i in range(len(FIGURES))], *[part.column(c) for c in own.values()]], names=[*FIGURES, *own])
        release()

    kinds = ", ".join(f"{c} {judged.schema[c].dataType.simpleString()}" for c in FIGURES)
    more = ", ".join(f"{c} {read.schema[n].dataType.simpleString()}" for c, n in own.items())
    return packed.join(verdicts, "sid").select("body", "verdicts").mapInArrow(run, f"{kinds}, {more}")
