"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Where the next character has no edge, the failure link of a node leads to the node of what is
left of its string once the greedy longest tokens are taken off its front, and the node knows how many tokens those are. So a word's
greedy longest-match length is a sum of counts over one pass, and no piece is ever built."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.bpe import _Source, byte_characters
from seriesloom.llm.common import worker_state

#: Fixed value: the pattern that cuts lower-cased text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
MEMO = 500_000


class Automaton:
    """edges, failure link and popped tokens by node; node 0 is the root. A failure link of -1: no token fits."""

    def __init__(self, tokens: list[str]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.token = [False]
        for t in tokens:
            node = 0
            for c in t:
                node = self.edges[node].setdefault(c, len(self.edges))
                if node == len(self.edges):
                    self.edges.append({})
                    self.token.append(False)
            if t:
                self.token[node] = True
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        queue = deque([0])
        while queue:  # breadth first: the links of shorter strings are known
            node = queue.popleft()
            for c, child in self.edges[node].items():
                queue.append(child)
                if self.token[child]:  # the whole string is one token
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at >= 0 and c not in self.edges[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.pops[child] = self.edges[at][c], popped

    def count(self, word: str) -> int | None:
        """Tokens of the greedy longest-match segmentation; None if some place has no token."""
        node = total = 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for c in word:
            while c not in edges[node]:
                if fail[node] < 0:
                    return None
                total += pops[node]
                node = fail[node]
            node = edges[node][c]
        while node:
            if fail[node] < 0:
                return None
            total += pops[node]
            node = fail[node]
        return total


class Counter:
    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.automaton = Automaton(sorted(t for t in spec["model"]["vocab"] if t not in special))
        self.character = byte_characters()
        self.cut = regex.compile(WORD)
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        found = self.automaton.count("".join([self.character[b] for b in word.encode()]) + END)
        found = 1 if found is None else found  # an unknown word is one token
        if len(word) <= 48:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def text(self, text: str) -> tuple[int, int]:
        get = self.memo.get
        words = tokens = 0
        for found in _blocks(text):
            part = self.cut.findall(found.lower())
            words += len(part)
            tokens += sum([get(w) or self.word(w) for w in part])
        return words, tokens


def _blocks(text: str, size: int = 1 << 16) -> Iterator[str]:
    """Cut before white space only, so that no word is broken."""
    at = 0
    space = regex.compile(r"\s")
    while len(text) - at > size:
        found = space.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs(doc_id, text): words of the lower-cased whole text, and the tokens of their greedy
    longest-match segmentation over the vocabulary file's tokens, in which "</w>" ends a word.

    Null and empty texts count 0; a word that no tokens spell counts 1; equal texts count alike; an empty table gives no rows; other
    columns are ignored. path: a tokenizers file, read by the driver and broadcast (a few MB)."""
    source = _Source(docs.sparkSession, path)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("word pieces", source.digest), lambda: Counter(source()))
        for batch in batches:
            both = [counter.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([b[k] for b in both], pa.int64()) for k in (0, 1))], names=["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
