"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder as a byte-to-text state machine.

The BPE encoding of each prefix of a byte string ends in one token, and that token is the only one that (a) ends the prefix, (b) encodes
as itself, and (c) stays apart from the token before it, i.e. the bytes of the two encode as just these two. So one left-to-right pass keeps,
for each position, the last token of the prefix; an automaton of all tokens lists what can end there.

Lookahead. Whatever follows position e, the token that covers the border e begins at some s <= e, and what lies between is a proper prefix
of a token that merges can make, or nothing. Such a token is no longer than the longest one that the merge list really makes out of its own
bytes, M (a listed token that merges never reach doesn't count); so s is one of the M positions e - M + 1 to e, and the encoding of the whole
passes through one of them. Tokens on which the paths from all of these agree are final and are emitted; M - 1 bytes of lookahead suffice.
What is kept is the M positions and the few behind them on which the paths still differ."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import short_batches, worker_state

#: Fixed value: the pattern that cuts text before byte-level merges.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text cut into pretokens at once.
BLOCK = 1 << 16
#: Entries of a generation of the memo of short pretokens, and of the memo of token pairs. A full generation becomes the old one, from which
#: pretokens that come again are taken over; so frequent ones stay known and memory is bounded.
MEMO = 200_000
SHORT = 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Merges:
    """A vocabulary with its merge list."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        of = {c: b for b, c in enumerate(byte_characters())}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = {bytes(of[c] for c in k): v for k, v in vocab.items()}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = bytes(of[c] for c in a), bytes(of[c] for c in b)
            self.merge.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        # in a list as training makes it, each token has one merge, which comes after those of its parts
        self.parts = {made: pair for pair, (_, made) in self.merge.items()}
        self.rank = {made: rank for rank, made in self.merge.values()}
        self.ordered = len(self.parts) == len(self.merge) and all(self.rank.get(x, -1) < rank for pair, (rank, _) in self.merge.items() for x in pair)
        self.ends = ahocorasick.Automaton()  # over bytes as characters; gives the tokens that end at each byte, longest first
        for token, number in self.ids.items():
            self.ends.add_word(token.decode("latin-1"), (len(token), number))
        self.ends.make_automaton()
        self.pair_memo: dict[int, bool] = {}
        self.made_memo: dict[int, bool] = {}
        self.word_memo: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.lookahead = self.sufficient_lookahead()
        self.cut = regex.compile(PRETOKEN)
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def sufficient_lookahead(self) -> int:
        """M: the length of the longest token that merges make of its own bytes, found from the longest one down."""
        return next((len(t) for t in sorted(self.ids, key=len, reverse=True) if self.plain(t) == [self.ids[t]]), 1)

    def plain(self, data: bytes) -> list[int]:
        """BPE by its definition: the leftmost pair of least rank is merged, again and again."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merge[out[i], out[i + 1]][1]]
        return out

    def is_made(self, token: int) -> bool:
        """Whether merges make this token of its own bytes."""
        found = self.made_memo.get(token)
        if found is None:
            found = self.made_memo[token] = self.plain(self.bytes_of[token]) == [token]
        return found

    def apart(self, before: int, token: int) -> bool:
        """Whether a token stands after another (-1: at the start) in an encoding: by encoding the two, or, for an ordered merge list, faster:
        the merges that made the two are undone from the last one on, the right part of the left token and the left part of the right one. If
        at any time the two that touch could merge before the one that was undone last, they wouldn't have stayed apart."""
        found = self.is_made(token)
        if found and before >= 0 and not self.ordered:
            found = self.plain(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        elif found and before >= 0:
            merge, rank, parts = self.merge, self.rank, self.parts
            a, b, limit = before, token, len(merge) + 1
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            while True:
                joined = merge.get((a, b))
                if joined is not None and joined[0] < limit:
                    found = False
                    break
                if ra > rb:
                    limit, a = ra, parts[a][1]
                    ra = rank.get(a, -1)
                elif rb >= 0:
                    limit, b = rb + 1, parts[b][0]
                    rb = rank.get(b, -1)
                else:
                    break
        if len(self.pair_memo) >= MEMO:
            self.pair_memo.clear()
        self.pair_memo[before << 32 | token] = found
        return found


class Transducer:
    """Streams the bytes of one pretoken to token ids."""

    STEP = 512

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.base, self.seen = 0, 0  # the first position that is kept, and the last
        self.last, self.parent = [-1], [-1]  # for positions base to seen: the last token of the prefix, where it starts
        self.found = merges.ends.iter("")

    def push(self, data: bytes) -> list[int]:
        """Takes bytes; returns the ids that became final."""
        out = []
        for at in range(0, len(data), self.STEP):
            self._step(data[at : at + self.STEP])
            out += self._settle()
        return out

    def _step(self, data: bytes) -> None:
        known, apart, last, parent, base, seen = self.m.pair_memo.get, self.m.apart, self.last, self.parent, self.base, self.seen
        self.found.set(data.decode("latin-1"))  # goes on where the bytes before ended
        for end, (n, token) in self.found:
            start = end + 1 - n
            if end < seen or start < base:
                continue
            before = last[start - base]
            fits = n == 1 or known(before << 32 | token)  # where no longer token fits, the byte's own one does
            if fits or fits is None and apart(before, token):
                last.append(token)
                parent.append(start)
                seen = end + 1
        self.seen = seen

    def _settle(self) -> list[int]:
        """Emits the tokens before the point where the paths from the last `lookahead` positions meet."""
        end = self.seen
        heap = [-p for p in range(max(self.base, end - self.m.lookahead + 1), end + 1)]
        heapq.heapify(heap)
        while True:
            top = -heapq.heappop(heap)
            while heap and -heap[0] == top:
                heapq.heappop(heap)
            if not heap or top <= self.base:
                break
            heapq.heappush(heap, -self.parent[top - self.base])
        out = self._path(top)
        if top > self.base:
            # the token that ends at the meeting point is kept: later tokens are checked against it
            del self.last[: top - self.base], self.parent[: top - self.base]
            self.base = top
        return out

    def _path(self, at: int) -> list[int]:
        out = []
        while at > self.base:
            out.append(self.last[at - self.base])
            at = self.parent[at - self.base]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._path(self.seen)


def short_word(m: Merges, data: bytes) -> list[int]:
    """The transducer's pass for a pretoken that is shorter than its step: nothing is emitted before the end."""
    known, apart, n = m.pair_memo.get, m.apart, len(data)
    last, size, seen = [-1] * (n + 1), [0] * (n + 1), 0
    for end, (k, token) in m.ends.iter(data.decode("latin-1")):
        if end < seen:
            continue
        before = last[end + 1 - k]
        fits = k == 1 or known(before << 32 | token)
        if fits or fits is None and apart(before, token):
            seen = end + 1
            last[seen], size[seen] = token, k
    out, at = [], n
    while at:
        out.append(last[at])
        at -= size[at]
    return out[::-1]


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in blocks cut before a space that follows a non-space: no pretoken crosses such a point and none depends on what is beyond."""
    at, n = 0, len(text)
    border = regex.compile(r"\S\s")
    while n - at > size:
        cut = None
        for found in border.finditer(text, at + size - 256, min(n, at + size)):
            cut = found.start() + 1
        if cut is None:
            found = border.search(text, at + size)
            if found is None:
                break
            cut = found.start() + 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(m: Merges, text: str) -> Iterator[bytes]:
    """Packed little-endian uint32 ids of a text, block by block."""
    memo = m.word_memo

    def one(word: str) -> bytes:
        if len(word) <= SHORT:
            out = m.old_words.get(word) or array("I", short_word(m, word.encode())).tobytes()
            if len(memo) >= MEMO:
                m.old_words = memo.copy()
                memo.clear()
            memo[word] = out
            return out
        run, packed = Transducer(m), array("I")
        for at in range(0, len(word), BLOCK):
            packed.extend(run.push(word[at : at + BLOCK].encode()))
        packed.extend(run.finish())
        return packed.tobytes()

    for part in m.marks.split(text) if m.marks else [text]:
        if part in m.special:
            yield array("I", [m.special[part]]).tobytes()
        elif part:
            for block in blocks(part):
                get = memo.get
                yield b"".join([get(w) or one(w) for w in m.cut.findall(block)])


class Decoder:
    """Incremental state machine from ids to text; bytes of an unfinished character wait for the next ids."""

    def __init__(self, m: Merges) -> None:
        self.bytes_of = m.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int], last: bool = False) -> str:
        get = self.bytes_of.get
        return self.state.decode(b"".join([get(i, b"") for i in ids]), last)


def decode(m: Merges, packed: bytes, step: int = 1 << 16) -> str:
    ids = np.frombuffer(packed, "<u4")
    run = Decoder(m)
    return "".join([run.push(ids[i : i + step].tolist()) for i in range(0, len(ids), step)] + [run.push([], True)])


class _Source:
    """A broadcast file with its digest, by which a worker knows the tables that it has built."""

    def __init__(self, spark, path: str) -> None:
        text = open(path, encoding="utf-8").read()
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.value = spark.sparkContext.broadcast(text)

    def __call__(self) -> str:
        return self.value.value


#: Bytes of output after which a batch is passed on.
BATCH_BYTES = 2 << 20


def bpe(docs: DataFrame, path: str, decoded: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with ids (binary: little-endian unsigned 32-bit ids of the whole text) and decoded (the text read back from the ids).

    path: a tokenizers file of a byte-level BPE; it is read by the driver and broadcast (a few MB). Strings of special tokens in a text
    become those tokens, as the tokenizers library does by default. Null and empty texts have no ids and decode to the empty text.
    Equal texts have equal ids; an empty table gives no rows; repeated rows are encoded alike. Other columns are ignored."""
    source = _Source(docs.sparkSession, path)
    columns = [*keep, "_text"]
    rows = short_batches(docs).select(*[F.col(c) for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", ids binary" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_state(("bpe", source.digest), lambda: Merges(source()))
        for batch in batches:
            texts = batch.column(len(columns) - 1)
            at, ids, back, size = 0, [], [], 0
            for i, text in enumerate(texts):
                text = text.as_py()
                packed = b"".join(encode(m, text))
                ids.append(packed)
                size += len(packed)
                if decoded:
                    back.append(decode(m, packed))
                    size += len(text)
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    arrays = [c.slice(at, i + 1 - at) for c in batch.columns[:-1]] + [pa.array(ids, pa.binary())] + ([pa.array(back, pa.string())] if decoded else [])
                    yield pa.RecordBatch.from_arrays(arrays, names=[*columns[:-1], "ids", *["decoded"] * decoded])
                    at, ids, back, size = i + 1, [], [], 0

    return rows.mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with decoded: the text of the packed ids in `ids`; null ids give the empty text, unknown ids nothing."""
    source = _Source(rows.sparkSession, path)
    rows = rows.select(*[F.col(c) for c in keep], F.col("ids").alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_ids") + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_state(("bpe", source.digest), lambda: Merges(source()))
        for batch in batches:
            text = [decode(m, x.as_py() or b"") for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string())], names=[*keep, "decoded"])

    return rows.mapInArrow(run, schema)
