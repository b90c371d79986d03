"""Set-similarity join on word n-grams by a prefix trie, with exact links and connected components.

1. Texts that are equal word for word share one row, grouped by their content.
2. Each of these gives signatures, of which linked sets share at least one (see signatures.py). They are combined within tasks first, so a
   signature that a third of all texts has comes once from each part of a task. What shares signatures forms blocks, and every link lies in a block.
3. The texts of a block meet in tasks of bounded size, a large block in pairs of chunks, where a prefix trie over their globally ordered shingles
   finds every link (see prefix_trie.py). Shingles are compared by their words there: no link rests on a hash.
4. Components over the links and the counts go back to all documents.
No pair is ever listed for copies, and no signature, block or partner is capped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from seriesloom.llm.common import by_ids, checkpoint, discard, gathered, is_small, mix, normalised_texts, salted_lookup, sha256s, shingle_sets, short_batches, sliced, split_lookup, worker_state
from seriesloom.llm.components import connected_components, stars
from seriesloom.llm.prefix_trie import join_units
from seriesloom.llm.signatures import signatures

#: Bytes of text in a chunk of a block (two chunks meet in a task): the least, the most, and in between the root of the block's bytes times the third, so
#: that chunks and the times that each is read grow alike.
CHUNK_BYTES, LARGEST_CHUNK, CHUNK_ROOT = 1 << 19, 3 << 20, 1 << 16
#: Signatures that a task combines at once, grams that it counts at once; bytes of text of the units that are joined at once.
SIGNATURES_AT_ONCE, GRAMS_AT_ONCE, JOINED_BYTES = 500_000, 1_000_000, 1 << 18
#: Grams are frequent if more than one text in so many holds them, and more than so many texts; at most so many grams are kept.
FREQUENT_SHARE, LEAST_FREQUENT, MOST_FREQUENT = 1_000, 20, 1 << 18


def _docs(docs: DataFrame) -> DataFrame:
    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_sizes(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """doc_id, sha (SHA-256 of the text's words with one space between them), n (size of its set) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join")
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for at, _, cut in shingle_sets(batch.column(1), width, lower):
                n[at : at + len(cut) - 1] = np.diff(cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), sha256s(normalised_texts(batch.column(1), lower)), pa.array(n)], names=["doc_id", "sha", "n"])

    return _docs(docs).mapInArrow(run, "doc_id long, sha binary, n long")


def distinct_texts(docs: DataFrame, lower: bool) -> DataFrame:
    """node (a number), sha, words (the normalised text), least (the smallest doc_id), copies (rows), bytes: one row for each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join")
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                words = normalised_texts(part.column(1), lower)
                rows = pa.RecordBatch.from_arrays([part.column(0), sha256s(words), pa.array(words, pa.binary()).cast(pa.string())], names=["doc_id", "sha", "words"])
                yield rows.filter(pa.array([len(w) > 0 for w in words], pa.bool_()))

    rows = _docs(docs).mapInArrow(run, "doc_id long, sha binary, words string")
    found = rows.groupBy("sha", "words").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return found.select(F.monotonically_increasing_id().alias("node"), "sha", "words", "least", "copies", F.octet_length("words").cast("long").alias("bytes"))


def frequent_grams(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of grams that more than one in FREQUENT_SHARE of the texts(words) hold, the MOST_FREQUENT most frequent of them (2 MB).

    Counted over all texts; a gram's count in a part of a task only counts if it is that frequent there, so it may come out low. Which grams are
    found has no influence on results, only on the size of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join")
        held: list[np.ndarray] = []
        size = sets = 0

        def out() -> pa.RecordBatch:
            gram, count = np.unique(np.concatenate(held), return_counts=True)
            often = count > max(1, sets // FREQUENT_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.array(count[often])], names=["gram", "count"])

        for batch in batches:
            for _, grams, cut in shingle_sets(batch.column(0), width, False):
                held.append(grams)
                size += len(grams)
                sets += len(cut) - 1
                if size >= GRAMS_AT_ONCE:
                    yield out()
                    held, size, sets = [], 0, 0
        if size:
            yield out()

    least = max(LEAST_FREQUENT, texts.count() // FREQUENT_SHARE)
    found = texts.select("words").mapInArrow(run, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).filter(F.col("count") > least)
    rows = found.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def candidate_edges(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): edges that connect any two nodes of texts(node, words) that can link."""
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_grams(texts, width))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def out() -> pa.RecordBatch:
            """Each signature once; what else held it is tied to that node here."""
            node, sign = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(sign, kind="stable")
            node, sign = node[order], sign[order]
            new = np.ones(len(sign), bool)
            new[1:] = sign[1:] != sign[:-1]
            hub = node[np.flatnonzero(new)][np.cumsum(new) - 1]
            tied = np.flatnonzero(node != hub)
            a, b = stars(node[tied], hub[tied]) if len(tied) else (np.zeros(0, np.int64),) * 2
            key = np.concatenate([sign[new], mix(a.view(np.uint64) + mix(b.view(np.uint64)))]).view(np.int64)
            other = pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(b)])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([node[new], a])), other], names=["key", "node", "other"])

        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for at, grams, cut in shingle_sets(batch.column(1), width, False):
                of, sign = signatures(grams, cut, num, den, frequent.value)
                held.append((nodes[at + of], sign))
                count += len(sign)
                if count >= SIGNATURES_AT_ONCE:
                    yield from sliced(out())
                    held, count = [], 0
        if count:
            yield from sliced(out())

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their keys: those of one key are tied to the first."""
        last, hub_before = None, 0
        for batch in gathered(batches):
            key, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or key[0] != last
            hubs = np.concatenate([[hub_before], node[new]])
            hub = hubs[np.cumsum(new)]
            last, hub_before = key[-1], int(hub[-1])
            tied = np.flatnonzero(node != hub)
            local = batch.column(2)
            given = np.flatnonzero(local.is_valid().to_numpy(zero_copy_only=False))
            a = np.concatenate([node[tied], node[given]])
            b = np.concatenate([hub[tied], local.fill_null(0).to_numpy(zero_copy_only=False)[given]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], names=["a", "b"])

    rows = texts.select("node", "words").mapInArrow(make, "key long, node long, other long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(tie, "a long, b long")


def _units(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """unit, cross, side, node, copies, words: the texts that meet in a task. A block of c chunks gives a unit for each chunk and each pair of chunks."""
    rows = checkpoint(blocks.withColumnRenamed("component", "block").join(texts.select("node", "bytes", "copies").hint("merge"), "node"))
    sizes = rows.groupBy("block").agg(F.sum("bytes").alias("all_bytes"))
    chunk = F.greatest(F.lit(float(CHUNK_BYTES)), F.least(F.lit(float(LARGEST_CHUNK)), F.sqrt(F.col("all_bytes") * float(CHUNK_ROOT))))
    large = checkpoint(sizes.filter(F.col("all_bytes") > CHUNK_BYTES).select("block", F.ceil(F.col("all_bytes") / chunk).cast("int").alias("chunks")))
    rows = salted_lookup(rows, large, "block", is_small(large), spread=F.col("node")).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = checkpoint(rows.select("node", "block", "copies", "chunk", "chunks"))
    rows = texts.select("node", "words").join(F.broadcast(rows) if is_small(rows) else rows.hint("merge"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.concat_ws(":", "block", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = rows.select(unit.alias("unit"), (F.col("chunk") != F.col("other")).alias("cross"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", "copies", "words")
    return rows.repartition("unit").sortWithinPartitions("unit")


def _links(texts: DataFrame, edges: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b, links: with b, edges that connect what links connect; with a null b, rows that link with a's text, unit by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join")
        last, unit, cross, side, node, copies, words, size = None, [], [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            own = np.array(node, np.int64)
            links, label = join_units(np.array(unit, np.int64), words, np.array(copies, np.int64), np.array(side, np.int64), np.array(cross, bool), width, num, den)
            tied, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(links)
            b = pa.concat_arrays([pa.array(own[label[tied]]), pa.nulls(len(some), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[tied], own[some]])), b, pa.array(np.concatenate([np.zeros(len(tied), np.int64), links[some]]))], names=["a", "b", "links"])

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5).cast(pa.binary()).to_pylist())
            for key, crossed, on, name, weight, text in rows:
                if key != last:
                    if size >= JOINED_BYTES:
                        yield out()
                        unit, cross, side, node, copies, words, size = [], [], [], [], [], [], 0
                    last = key
                    cross.append(crossed)
                unit.append(len(cross) - 1)
                side.append(on)
                node.append(name)
                copies.append(weight)
                words.append(text)
                size += len(text)
        if unit:
            yield out()

    blocks = checkpoint(connected_components(edges))
    return _units(texts, blocks).mapInArrow(run, "a long, b long, links long")


def _classes(docs: DataFrame, width: int, num: int, den: int, lower: bool) -> tuple[DataFrame, DataFrame, int]:
    """Rows of docs as by set_sizes; one row for each distinct text with words: sha, least, copies, head (a number of its class),
    component_id, class_size, n_links; and the rows of docs."""
    keys = checkpoint(set_sizes(docs, width, lower))
    total = keys.count()
    texts = checkpoint(distinct_texts(docs, lower))
    edges = checkpoint(candidate_edges(texts, width, num, den))
    links = checkpoint(_links(texts, edges, width, num, den))
    discard(edges)
    found = checkpoint(connected_components(links.filter("b IS NOT NULL").select("a", "b")))
    rows = texts.select("node", "sha", "least", "copies")
    linked = checkpoint(found.join(rows.select("node", "least", "copies").hint("merge"), "node"))
    classes = checkpoint(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("members")))
    linked = split_lookup(linked.select("node", "component"), classes, "component", "members", linked.count())
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    out = rows.join(linked.join(counts.hint("merge"), "node").hint("merge"), "node", "left")
    own = (F.coalesce("component", "node").alias("head"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("class_size", "copies").alias("class_size"))
    out = checkpoint(out.select("sha", "least", "copies", *own, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    discard(texts, links, found)
    return keys, out, total


def similarity_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, class_size, n_links.

    Words are runs of anything but ASCII white space, A-Z lower-cased if `lower`. A document's set holds its distinct runs of `width`
    words; with fewer words, the whole sequence; without words (empty or null text), nothing, and it links with nothing. Two documents
    link when den * |both| >= num * |either|. component_id is the smallest doc_id reachable by links, itself included; class_size is the
    number of rows of the component; n_links is the number of other rows that the row links with, copies included. Rows that repeat an
    id stand for themselves; equal sets link whatever their ids. Null ids are larger than any other: a component of null ids only has a
    null component_id. An empty table gives no rows. Other columns are ignored.

    Links are decided by words, equal texts by SHA-256; n_shingles counts 64-bit hashes of shingles."""
    keys, classes, total = _classes(docs, width, num, den, lower)
    some = split_lookup(keys.filter("n > 0"), classes.select("sha", "component_id", "class_size", "n_links", "copies"), "sha", "copies", total)
    some = some.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size", "n_links")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return some.union(keys.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), one, none))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each class of similar texts (the smallest doc_id), columns unchanged.

    Rows are told apart by id and text, so unrelated texts that share an id or have none all stay. Null ids are larger than any other. Where
    the smallest id, or a null id in a class of null ids only, has several texts in a class, the one of the smallest digest stays, then the
    smallest text. Rows without words all stay."""
    keys, classes, total = _classes(docs, width, num, den, True)
    if keys.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        rows = split_lookup(keys.filter("n > 0"), classes.select("sha", "component_id", "copies"), "sha", "copies", total)
        return by_ids(docs, checkpoint(rows.filter("component_id < doc_id").select("doc_id")), "doc_id", "left_anti")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sha")).alias("first")
    stay = checkpoint(classes.groupBy("head").agg(first).select("first.least", "first.sha"))
    rows = _keyed_rows(docs)
    full = rows.filter("words").join(stay.hint("merge"), [rows["sha"] == stay["sha"], rows["doc_id"].eqNullSafe(stay["least"])], "left_semi")
    full = full.groupBy("sha").agg(F.min_by("row", F.col("row.text")).alias("row"))
    return rows.filter("NOT words").select("row").union(full.select("row")).select("row.*")


def _keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a struct of all columns), sha, words (whether there are any) for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("n-gram join")
        for batch in batches:
            words = normalised_texts(batch.column(1), True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sha256s(words), pa.array([len(w) > 0 for w in words], pa.bool_())], names=["doc_id", "row", "sha", "words"])

    schema = StructType([rows.schema["doc_id"], rows.schema["row"], StructField("sha", BinaryType()), StructField("words", BooleanType())])
    return rows.mapInArrow(run, schema)
