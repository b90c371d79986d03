"""Shared pieces of the corpus operators: checkpoints, size-checked joins, vectorised word hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesloom.functions.tables import swept

#: The white space that separates words, as a Java/RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows (or bytes) up to which a side of a join is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where that is unset, and only on a local master, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="seriesloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it again.

    A lost executor costs a read, not the work before, and the planner knows the table's true size. Shuffle files go at once."""
    path = f"{shared_folder(df.sparkSession)}/seriesloom-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `checkpoint` wrote, once nothing reads them any more (what came from them is written itself)."""
    for df in tables:
        path = _written.pop(df, None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column (in any case) has it."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (checkpointed) table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """left_semi or left_anti join on a key. ids is broadcast when its counted rows are within the limit, else both sides shuffle
    and adaptive execution splits skewed keys."""
    return rows.join(F.broadcast(ids) if is_small(ids, limit) else ids.hint("merge"), key, how)


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, small: bool, salts: int = 16, spread: Column | None = None) -> DataFrame:
    """Left join of rows with a table that has one row for a key. A table proved small is broadcast; a larger one is copied to `salts`
    salts, so that one hot key meets its rows in as many tasks."""
    if small:
        return rows.join(F.broadcast(table), key, "left")
    spread = F.monotonically_increasing_id() if spread is None else spread
    [salt] = unused([*rows.columns, *table.columns], "salt")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, salt], "left").drop(salt)


#: A key is hot if it has more than this share of the rows, so there are at most HOT_KEYS of them.
HOT_KEYS = 1_000


def split_lookup(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with a (checkpointed) table that has one row for a key and, in column `size`, at least the number of rows that hold the key.

    Keys with more than total / HOT_KEYS rows are broadcast: at most HOT_KEYS, as their rows can't add up to more than all. The others
    shuffle, none of them large."""
    hot = table.filter(F.col(size) > F.lit(max(1.0, total / HOT_KEYS)))
    common = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.join(F.broadcast(hot.select(key)), key, "left_anti").hint("merge"), key)
    return rows.join(common, key).unionByName(rest)


def smallest(rows: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The n distinct rows of each key that come first by `order`, a 64-bit hash; ties by all columns.

    The distinct hashes of a key are counted first (about), and only rows below a bound that lets some more than n pass are ranked; so no
    task reads a whole key. That fewer than n pass where there are more has a chance of less than 1e-9."""
    names = rows.columns
    place, found, rank = unused(names, "place", "found", "rank")
    rows = rows.select("*", order.alias(place))
    sizes = checkpoint(rows.groupBy(*keys).agg(F.approx_count_distinct(place, 0.05).alias(found)))
    rows = rows.join(F.broadcast(sizes) if is_small(sizes, 50_000) else sizes.hint("merge"), keys)
    share = (1.25 * n + 6 * n**0.5 + 20) / F.col(found)
    rows = rows.filter(F.col(place).cast("double") / float(1 << 64) + 0.5 < share).drop(found).distinct()
    by = Window.partitionBy(*keys).orderBy(place, *names)
    return rows.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) <= n).select(*names)


def bucket_of(spark_id: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo; null for a null id."""
    return F.crc32(spark_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column) -> Column:
    """True for the rows that labels may not be learned from; a null id is never held out."""
    return F.coalesce(bucket_of(doc_id, 3) == 1, F.lit(False))


# ---- batches for Python workers ----------------------------------------------------------------

#: Rows of text that go to a Python worker at once: a batch stands in the executor's direct memory and in the worker.
TEXT_ROWS = 1_000


def short_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the rows of an Arrow batch by TEXT_ROWS in its session, which stays so: the planner reads the setting when a query runs.
    A lower bound that the session has is kept. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order in batches of at least so many, but for the last; for narrow rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batch in batches of at most so many rows: a batch that comes back stands whole in the executor's direct memory, which keeps the room."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


# ---- state of Python workers --------------------------------------------------------------------

_state: dict[object, object] = {}


def _give_back() -> None:
    """Where the C library is glibc: hands free memory back, and has large arrays mapped on their own, so that they are given back when freed."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def worker_state(key: object, make: Callable[[], object] = lambda: None) -> object:
    """What an operator keeps in a Python worker between tasks, such as vocabulary tables and memos. A worker serves any operator that comes, so it
    keeps one operator's state at a time: the first call under another key frees what was kept."""
    if key not in _state:
        _state.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _give_back()
        _state[key] = make()
    return _state[key]


# ---- word hashes over Arrow buffers -------------------------------------------------------------

#: Odd multipliers of the polynomial and finaliser hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2, _LEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

#: Bytes of text hashed at once (its arrays take about a hundred times as much); a piece is cut between words.
PIECE = 1 << 17

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE + 1)
        _powers, _inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INV))
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps by design."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def range_hashes(raw: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of byte ranges [start, end) of one buffer, equal for equal bytes wherever they stand."""
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=sums[1:])
    return [mix((sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64) * _LEN) for s, e in spans]


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at the given document starts."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    cut[n] = True
    cut = cut[:n]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Whole texts of an Arrow string array as (bytes, document starts within them, index of the first document).

    Nulls are empty. A text longer than PIECE comes in several pieces of one document, cut after white space."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        if hi - lo <= PIECE or to > at + 1:
            yield raw[lo:hi], offsets[at:to] - lo, at
        else:
            while lo < hi:
                end = min(lo + PIECE, hi)
                if end < hi:
                    gaps = np.flatnonzero(is_space(raw[lo:end]))
                    if len(gaps):
                        end = lo + int(gaps[-1]) + 1
                    else:  # one word longer than a piece: up to the next white space
                        after = np.flatnonzero(is_space(raw[end:hi]))
                        end = end + int(after[0]) + 1 if len(after) else hi
                yield raw[lo:end], np.zeros(1, np.int64), at
                lo = end
        at = to


def encoded_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The words of a buffer, which are all that isn't white space in it, as numbers and a dictionary."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = raw[~is_space(raw)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


#: Seed of the word hash.
WORD_SEED = np.uint64(0x5EED0F3A11C7)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word raw[start:end]: its length and its bytes, eight at a time, each through the finaliser, which is a bijection; so words
    of one length up to eight bytes never share one."""
    size = ends - starts
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    h, which, at, left = mix(size.astype(np.uint64) * _LEN + WORD_SEED), None, starts, size
    while len(left):
        taken = eights[at]
        short = np.flatnonzero(left < 8)
        taken[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        if which is None:
            h = mix(h ^ taken)
        else:
            h[which] = mix(h[which] + _BASE ^ taken)
        more = np.flatnonzero(left > 8)
        which, at, left = more if which is None else which[more], at[more] + 8, left[more] - 8
    return h


def dictionary_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """word_hashes of the words of the dictionary."""
    found = words.dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    raw = np.frombuffer(found.buffers()[2], np.uint8) if found.buffers()[2] is not None else np.zeros(0, np.uint8)
    return word_hashes(raw, offsets[:-1], offsets[1:])


def words_by_document(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, documents, word hashes, word offsets of each document); words are runs of anything but ASCII white space."""
    held: list[np.ndarray] = []
    held_at = -1
    for raw, starts, at in pieces(texts):
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
        s, e = runs(~is_space(raw), starts[starts < len(raw)]) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        hashes = word_hashes(raw, s, e)
        if held_at >= 0 and at != held_at:
            yield _one(held_at, held)
            held_at = -1
        if len(starts) == 1:  # may go on in the next piece
            held = held + [hashes] if held_at == at else [hashes]
            held_at = at
        else:
            yield at, len(starts), hashes, np.append(np.searchsorted(s, starts), len(s))
    if held_at >= 0:
        yield _one(held_at, held)


def normalised_texts(texts: pa.Array, lower: bool) -> list[bytes]:
    """Each text's words with one space between them; nulls are empty."""
    out: list[list[bytes]] = [[] for _ in range(len(texts))]
    for raw, starts, at in pieces(texts):
        raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw) if lower else raw.copy()
        keep = ~is_space(raw)
        s = runs(keep, starts[starts < len(raw)])[0] if len(raw) else np.zeros(0, np.int64)
        first = np.searchsorted(s, starts)  # the first word of each document has no space before it
        later = np.ones(len(s), bool)
        later[first[first < len(s)]] = False
        raw[s[later] - 1] = 32
        keep[s[later] - 1] = True
        cut = np.append(np.concatenate([[0], np.cumsum(keep)])[starts], keep.sum())
        data = raw[keep].tobytes()
        for i in range(len(starts)):
            if cut[i] < cut[i + 1]:
                out[at + i].append(data[cut[i] : cut[i + 1]])
    return [b" ".join(parts) for parts in out]


def sha256s(texts: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())


def shingle_places(size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of documents of these sizes: the document of each word, words from it to the document's end, and whether a shingle begins there.

    With fewer words than the width, the whole sequence is one shingle."""
    doc = np.repeat(np.arange(len(size)), size)
    whole = np.repeat(size, size)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return doc, whole - place, (place + width <= whole) | ((whole < width) & (place == 0))


def shingle_hashes(words: np.ndarray, left: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles that begin at the words `at`, from word hashes."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    value, left = np.zeros(len(at), np.uint64), left[at]
    for j in range(width):
        there = np.flatnonzero(left > j)
        value[there] += words[at[there] + j] * factors[j]
    return mix(value + np.minimum(left, width).astype(np.uint64) * _LEN)


def _one(at: int, parts: list[np.ndarray]) -> tuple[int, int, np.ndarray, np.ndarray]:
    hashes = np.concatenate(parts)
    return at, 1, hashes, np.array([0, len(hashes)])


def shingle_sets(texts: pa.Array, width: int, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, sorted distinct shingle hashes of a run of documents, offsets by document).

    With fewer words than the width, the whole sequence is one shingle; without words the set is empty."""
    for at, n, hashes, cut in words_by_document(texts, lower):
        doc, left, begins = shingle_places(np.diff(cut), width)
        begins = np.flatnonzero(begins)
        doc, value = doc[begins], shingle_hashes(hashes, left, begins, width)
        if len(value):
            ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1  # documents are in order already
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                value[lo:hi].sort()
            new = np.ones(len(value), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            doc, value = doc[new], value[new]
        yield at, value, np.searchsorted(doc, np.arange(n + 1))
