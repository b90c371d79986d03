"""Similarity join of bounded units of documents by a prefix trie.

Shingles are told apart by their words, not by hashes, and ordered by one global order (their 64-bit hash, equal in every unit). The sets go
into a path-compressed trie; sets that begin alike share a path, so their common overlap with a query is added up once. All queries of a
unit go down the trie together, level by level, as arrays of (query, node, overlap): a step adds the overlap of the node's run of tokens, and
leaves a subtree that can't reach the threshold even with all tokens that remain in the query and below the node."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from seriesloom.llm.common import dictionary_hashes, encoded_words, is_space, runs, shingle_hashes, shingle_places

#: Work taken down the trie at once: tokens of a unit's trie times queries, and cells of the queries' membership table.
TOKENS_AT_ONCE, CELLS_AT_ONCE = 2_000_000, 16_000_000


def shingle_ids(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the shingle sets, document and number of each distinct shingle of a document): numbers are equal for shingles of equal words only,
    and ordered by the shingles' hashes. texts: words with one space between them."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    s, e = runs(~is_space(raw), starts[lengths > 0]) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc, left, begins = shingle_places(np.diff(np.append(np.searchsorted(s, starts), len(s))), width)
    if not len(s):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = encoded_words(raw, s, e)
    word = coded.indices.to_numpy().astype(np.int64)
    at = np.flatnonzero(begins)
    value = shingle_hashes(dictionary_hashes(coded)[word], left, at, width)
    words = np.full((len(at), width), -1, np.int64)
    for j in range(width):
        there = np.flatnonzero(left[at] > j)
        words[there, j] = word[at[there] + j]
    order = np.argsort(value, kind="stable")
    new = value[order[1:]] != value[order[:-1]]
    differ = (words[order[1:]] != words[order[:-1]]).any(1)
    if (differ & ~new).any():  # different words with one hash: their words decide
        order = np.lexsort((*words.T, value))
        new = (value[order[1:]] != value[order[:-1]]) | (words[order[1:]] != words[order[:-1]]).any(1)
    number = np.empty(len(at), np.int64)
    number[order] = np.concatenate([[0], np.cumsum(new)])
    top = int(number.max()) + 1
    pairs = np.unique(doc[at] * top + number)
    doc = pairs // top
    return np.bincount(doc, minlength=len(texts)), doc, pairs % top


@dataclass
class Tries:
    """One trie a unit, as arrays over nodes. A node stands for tokens start to depth of the path of the set `rep`, and for sorted sets up to high - 1;
    smallest and longest bound what is below. Children of node i are children[child_at[i] : child_at[i + 1]], the sets that end
    in it ends[end_at[i] : end_at[i + 1]]; roots[u] is the root of unit u, or -1."""

    start: np.ndarray
    depth: np.ndarray
    rep: np.ndarray
    high: np.ndarray
    smallest: np.ndarray
    longest: np.ndarray
    children: np.ndarray
    child_at: np.ndarray
    ends: np.ndarray
    end_at: np.ndarray
    roots: np.ndarray


def _by(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes grouped by key, and where each key's begin."""
    return np.argsort(keys, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def _gather(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes at[i], at[i] + 1, ... (size[i] of them) for all i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)


def build(unit: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, cut: np.ndarray, units: int) -> Tries:
    """Tries of sets that are sorted by unit and path; tokens[cut[i] : cut[i + 1]] is the path of set i."""
    n = len(unit)
    long = np.diff(cut)
    both = np.minimum(long[1:], long[:-1]) * (unit[1:] == unit[:-1])
    index = _gather(np.zeros(len(both), np.int64), both)
    owner = np.repeat(np.arange(len(both)), both)
    differ = tokens[cut[owner + 1] + index] != tokens[cut[owner] + index]
    shared = both.copy()
    where = np.flatnonzero(differ)
    first, some = np.unique(owner[where], return_index=True)
    shared[first] = index[where[some]]
    start, depth, rep, high, smallest, longest, parent = [], [], [], [], [], [], []
    roots, end_of = np.full(units, -1, np.int64), np.zeros(n, np.int64)

    def add(d: int, i: int, size: int, length: int) -> int:
        for column, value in zip((start, depth, rep, high, smallest, longest, parent), (0, d, i, i, size, length, -1)):
            column.append(value)
        return len(depth) - 1

    def hang(x: int, below: int, stop: int) -> None:
        parent[x], start[x], high[x] = below, depth[below], stop
        smallest[below], longest[below] = min(smallest[below], smallest[x]), max(longest[below], longest[x])

    stack: list[int] = []
    for i, (u, size, length, same) in enumerate(zip(unit.tolist(), sizes.tolist(), long.tolist(), [0, *shared.tolist()])):
        fresh = not i or u != unit[i - 1]
        while stack and (fresh or depth[stack[-1]] > same):
            x = stack.pop()
            if not stack:
                high[x] = i
                break
            if not fresh and depth[stack[-1]] < same:
                stack.append(add(same, rep[x], smallest[x], longest[x]))
            hang(x, stack[-1], i)
        if fresh:
            stack = [add(0, i, size, length)]
            roots[u] = stack[0]
        if length > depth[stack[-1]]:
            stack.append(add(length, i, size, length))
        else:
            smallest[stack[-1]] = min(smallest[stack[-1]], size)
        end_of[i] = stack[-1]
    while stack:
        x = stack.pop()
        if stack:
            hang(x, stack[-1], n)
        else:
            high[x] = n
    columns = [np.array(c, np.int64) for c in (start, depth, rep, high, smallest, longest)]
    up = np.array(parent, np.int64)
    inner = np.flatnonzero(up >= 0)
    order, child_at = _by(up[inner], len(up))
    ends, end_at = _by(end_of, len(up))
    return Tries(*columns, inner[order], child_at, ends, end_at, roots)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest member of its group) after joining the groups of a[i] and b[i] for all i."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def join_units(unit: np.ndarray, texts: list[bytes], weights: np.ndarray, side: np.ndarray, cross: np.ndarray, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of documents: in each unit two documents link when den * shared shingles >= num * all their shingles. links is the weight of the
    others that a document links with; documents of one label (an index) are connected by links.

    unit: ascending from 0; in units of which cross holds only documents of different sides meet, in others all. A document is once in a unit."""
    n, units = len(texts), len(cross)
    label, links = np.arange(n), np.zeros(n, np.int64)
    sizes, doc, number = shingle_ids(texts, width)
    if not len(doc):
        return links, label
    # tokens that one document of the unit holds only count in its size
    top = int(number.max()) + 1
    key = unit[doc] * top + number
    known, place, held_by = np.unique(key, return_inverse=True, return_counts=True)
    rank = np.cumsum(held_by > 1) - 1
    kept = held_by[place] > 1
    doc, token = doc[kept], rank[place[kept]]
    shared = known[held_by > 1] // top
    token_at = np.searchsorted(shared, np.arange(units + 1))
    token -= token_at[unit[doc]]
    cut = np.searchsorted(doc, np.arange(n + 1))
    long = np.diff(cut)
    usable = np.flatnonzero(long)
    stored = usable[~cross[unit[usable]] | (side[usable] == 1)]
    packed = token.astype(">u4")
    stored = np.array(sorted(stored.tolist(), key=lambda i: (unit[i], packed[cut[i] : cut[i + 1]].tobytes())), np.int64)
    if not len(stored):
        return links, label
    paths = token[_gather(cut[stored], long[stored])]
    path_cut = np.concatenate([[0], np.cumsum(long[stored])])
    trie = build(unit[stored], sizes[stored], paths, path_cut, units)
    position = np.full(n, -1, np.int64)  # in the sorted sets; a query meets only later ones of its own trie
    position[stored] = np.arange(len(stored))
    position[cross[unit]] = -1
    asked = usable[(~cross[unit[usable]] | (side[usable] == 0)) & (trie.roots[unit[usable]] >= 0)]
    in_trie = np.zeros(units + 1, np.int64)
    np.add.at(in_trie, unit[stored[trie.rep]], trie.depth - trie.start)
    cost = np.maximum(in_trie[unit[asked]] / TOKENS_AT_ONCE, np.diff(token_at)[unit[asked]] / CELLS_AT_ONCE)
    part = np.floor(np.cumsum(cost)).astype(np.int64)
    at = 0
    while at < len(asked):
        to = int(np.searchsorted(part, part[at], "right"))
        q, y = _descend(trie, asked[at:to], unit, sizes, token, cut, np.diff(token_at), paths, path_cut, position, stored, num, den)
        links += np.bincount(q, weights[y], n).astype(np.int64) + np.bincount(y, weights[q], n).astype(np.int64)
        label = merged(label, q, y)
        at = to
    return links, label


def _descend(trie: Tries, asked: np.ndarray, unit: np.ndarray, sizes: np.ndarray, token: np.ndarray, cut: np.ndarray, tokens: np.ndarray, paths: np.ndarray, path_cut: np.ndarray, position: np.ndarray, stored: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (query, stored document) of some queries."""
    both = num + den
    long = (cut[asked + 1] - cut[asked]).astype(np.int64)
    cells = np.cumsum(tokens[unit[asked]]) - tokens[unit[asked]]
    mine = np.repeat(cells, long) + token[_gather(cut[asked], long)]  # ascending
    held = np.zeros(int(cells[-1] + tokens[unit[asked[-1]]]), bool)
    held[mine] = True
    ends = np.cumsum(long)
    found_q, found_y = [], []
    q, node = np.arange(len(asked)), trie.roots[unit[asked]]
    overlap = np.zeros(len(q), np.int64)
    while len(q):
        number = trie.end_at[node + 1] - trie.end_at[node]
        some = np.flatnonzero(number)
        if len(some):
            y = trie.ends[_gather(trie.end_at[node[some]], number[some])]
            of, o = np.repeat(q[some], number[some]), np.repeat(overlap[some], number[some])
            hit = (y > position[asked[of]]) & (both * o >= num * (sizes[asked[of]] + sizes[stored[y]]))
            found_q.append(asked[of[hit]])
            found_y.append(stored[y[hit]])
        number = trie.child_at[node + 1] - trie.child_at[node]
        child = trie.children[_gather(trie.child_at[node], number)]
        q, overlap = np.repeat(q, number), np.repeat(overlap, number)
        size = sizes[asked[q]]
        below = trie.longest[child] - trie.start[child]
        most = overlap + np.minimum(below, long[q] - overlap)
        keep = (trie.high[child] > position[asked[q]] + 1) & (both * most >= num * (size + np.maximum(trie.smallest[child], most)))
        q, child, overlap = q[keep], child[keep], overlap[keep]
        if not len(q):
            break
        run = trie.depth[child] - trie.start[child]
        at = path_cut[trie.rep[child]] + trie.start[child]
        hits = held[np.repeat(cells[q], run) + paths[_gather(at, run)]]
        overlap = overlap + np.add.reduceat(hits, np.cumsum(run) - run, dtype=np.int64)
        # what remains of the query behind the run, and below the node
        left = ends[q] - np.searchsorted(mine, cells[q] + paths[at + run - 1], "right")
        most = overlap + np.minimum(left, trie.longest[child] - trie.depth[child])
        keep = both * most >= num * (sizes[asked[q]] + np.maximum(trie.smallest[child], most))
        q, node, overlap = q[keep], child[keep], overlap[keep]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_y])
