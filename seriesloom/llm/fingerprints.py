"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once. The top bits of the hash choose one of BINS bins, and each bin keeps its least hash. An empty bin takes the
value of another by optimal densification: bin i tries bins (a_i + t b_i) mod BINS for t = 0, 1, ... with hashed a_i and odd b_i, which passes
every bin, until one is full. Four low-order bits of each value are stored, sixteen to a long. Two fingerprints agree by chance in a share
C = 1/16 of the bins, so the likeness is (share that agrees - C) / (1 - C), cut to 0..1."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.llm.common import SPACE, is_small

#: log2 of the number of bins, bits kept of a value, bins in a long.
BIN_BITS, BITS = 9, 4
BINS, PACKED = 1 << BIN_BITS, 64 // BITS
#: Tries of an empty bin that are looked up in tables; the rest of its walk is worked out from the full bins.
TRIES = 12
#: Documents in a run of neighbouring ids, and the most runs.
RUN_ROWS, MOST_RUNS = 2_000, 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int) -> Column:
    """Hashes of the runs of `width` words; of the whole sequence if there are fewer; none without words."""
    words = F.array_remove(F.split(text, SPACE), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + j] for j in range(width)]))
        return F.when(F.size(h) >= width, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, grams)


def bin_of(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2


def _least(grams: Column) -> Column:
    """The least hash of each bin that has any, in order of bins."""
    return let(F.sort_array(grams), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def _dense(least: Column) -> Column:
    """Low-order bits of each bin's value in order, null for an empty bin."""
    empty = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
    value = lambda x: F.array(x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    run = F.transform(least, lambda x, i: F.concat(empty(bin_of(x) - F.when(i == 0, F.lit(0)).otherwise(bin_of(F.get(least, i - 1)) + 1)), value(x)))
    return F.concat(F.flatten(run), empty(BINS - 1 - bin_of(F.element_at(least, -1))))


def _steps() -> list[tuple[int, int]]:
    """a and odd b of each bin."""
    draw = [int.from_bytes(hashlib.md5(f"bin {i}".encode()).digest()[:8], "little") for i in range(BINS)]
    return [(h % BINS, (h >> 32) % BINS | 1) for h in draw]


def _table(values: Iterable[int]) -> Column:
    """An array that the optimiser folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _densified(least: Column, dense: Column) -> Column:
    steps = _steps()
    tries = [_table((a + t * b) % BINS for a, b in steps) for t in range(TRIES)]
    start, back = _table(a for a, _ in steps), _table(pow(b, -1, BINS) for _, b in steps)

    def farther(i: Column, full: Column) -> Column:
        """The full bin that the walk of bin i meets first: bin j is met after (j - a) / b steps."""
        met = F.transform(full, lambda j: ((j - F.get(start, i)) * F.get(back, i)).bitwiseAND(F.lit(BINS - 1)) * BINS + j)
        return F.get(dense, F.array_min(met).bitwiseAND(F.lit(BINS - 1)))

    return let(F.transform(least, bin_of), lambda full: F.transform(dense, lambda v, i: F.coalesce(v, *[F.get(dense, F.get(t, i)) for t in tries], farther(i, full))))


def _packed(values: Column) -> Column:
    def one(w: Column) -> Column:
        return F.aggregate(F.slice(values, w * PACKED + 1, PACKED), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.cast("long")))

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PACKED - 1)), one)


def signature(text: Column, width: int = 5) -> Column:
    """The packed values as array<bigint>; without words, an empty array. Equal texts have equal signatures."""
    empty = F.array().cast("array<bigint>")
    return let(shingle_hashes(text, width), lambda g: F.when(F.size(g) > 0, let(_least(g), lambda m: let(_dense(m), lambda d: let(_densified(m, d), _packed)))).otherwise(empty))


def as_text(sig: Column) -> Column:
    """Hexadecimal digits, one for each bin; the empty text for an empty signature."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 64 // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures; of two empty ones 1, of an empty and another 0."""
    ones = F.lit(int("1" * PACKED, 16))

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (1, 2):  # the lowest bit of each group of four becomes the or of all
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(ones))

    chance = 1.0 / (1 << BITS)
    same = 1 - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda n, d: n + d.cast("int")) / F.lit(BINS)
    both = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_chars, fingerprint for each row of docs(doc_id, text); a null text is empty, and an empty text has an empty fingerprint."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), as_text(signature(F.col("text"), width)).alias("fingerprint"))


def _runs(docs: DataFrame) -> tuple[Callable[[Column], Column], int, int]:
    """A function from doc_id to a run of neighbouring ids, and the first and last run; none of them is empty. Run -1 holds null ids.

    The borders are quantiles of the ids: some tens of thousands of numbers at most, found by binary search."""
    n, nulls, least = docs.agg(F.count("doc_id"), F.count(F.lit(1)) - F.count("doc_id"), F.min("doc_id")).first()
    count = min(MOST_RUNS, -(-n // RUN_ROWS)) if n else 1
    borders: list[int] = []
    if count > 1:
        at = [i / count for i in range(1, count)]
        borders = sorted({x for x in docs.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * count))).first()[0] if x > least})
    first, last = (-1 if nulls else 0), len(borders) if n else -1
    if not borders:
        return (lambda i: F.when(i.isNull(), F.lit(-1)).otherwise(F.lit(0))), first, last
    table = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")  # folded to one literal
    steps = F.array(*[F.lit(1 << k) for k in range(len(borders).bit_length() - 1, -1, -1)])

    def run(i: Column) -> Column:
        return F.when(i.isNull(), F.lit(-1)).otherwise(F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(borders)) & (F.get(table, lo + s - 1) <= i), lo + s).otherwise(lo)))

    return run, first, last


def with_next(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text, sig, next_text, next_sig: the next document by descending doc_id; after the last comes the first.

    Equal ids are ordered by text; null ids come last. Ids are cut into runs at quantiles, and the head of each run is copied to the end of the
    run before, so one shuffle by run finds every neighbour and no task sees all rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    run_of, first, last = _runs(docs)
    if last < first:
        last = first
    rows = docs.withColumn("run", run_of(F.col("doc_id")))
    tops = rows.groupBy("run").agg(F.max("doc_id").alias("_top")).withColumnRenamed("run", "_run")
    same = F.col("run") == F.col("_run")
    heads = rows.join(F.broadcast(tops) if is_small(tops) else tops.hint("merge"), same & F.col("doc_id").eqNullSafe(F.col("_top")))
    heads = heads.groupBy("run").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    before = F.when(F.col("run") == last, F.lit(first)).otherwise(F.col("run") + 1)  # the run that a head is next to
    both = rows.withColumn("extra", F.lit(0)).unionByName(heads.withColumn("run", before.cast("int")).withColumn("extra", F.lit(1)))
    both = both.withColumn("sig", signature(F.col("text"), width))
    w = Window.partitionBy("run").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    both = both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sig", F.lead("sig").over(w))
    return both.filter("extra = 0").select("doc_id", "text", "sig", "next_text", "next_sig")


def edited_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs(doc_id, text).

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document's.
    Null texts are empty; empty texts have empty fingerprints, alike only to each other; equal texts have equal fingerprints; a single document
    is its own next; equal ids are ordered by text and null ids come last; an empty table gives no rows; other columns are ignored."""
    rows = with_next(docs, width).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sig", signature(F.col("edited"), width))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
