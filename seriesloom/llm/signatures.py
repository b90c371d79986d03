"""Exact candidate search for a set-similarity join: signatures that linked sets are sure to share.

Two sets of a and b grams that link with num / den lack at most d = (den - num) (a + b) / (num + den) grams of each other. If hash space is cut
into more than d slices, the two agree on at least one of them whole. So a set gives one signature a slice, made of all its grams there, for
sets of its own size class and for the next larger class, and linked sets share a signature.

There are about a third more slices than that, and a set keeps its d + 1 fullest. This loses nothing: if n slices of a set hold grams, at least n - d of them are
whole in the other set, and a set drops n - d - 1 at most. Both drop by one order (grams, then place), so of the slices that they share they drop together
no more than the one that drops more. What is kept holds two grams, mostly three and more, so what shares one is nearly always alike: a few grams or a passage
in common don't connect documents, not even very long ones, of whose slices many hold a single gram.

Grams that very many sets hold (any given set of them) are left out of the first cut: what is left of two linked sets differs no more than they do,
so the argument holds, and a passage that a third of all documents share ties none of them.

A slice that is empty in both sets says nothing. A set with so many empty slices that d changes could fall on all the others gives the
signatures of another cut too, of all its grams, and after ROUNDS cuts a signature for each gram; two sets that both do so meet there. So no link
is missed."""

from __future__ import annotations

import numpy as np

from seriesloom.llm.common import mix

ROUNDS = 5
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def class_bounds(largest: int, num: int, den: int) -> np.ndarray:
    """The smallest sizes of the size classes, two beyond that of the largest set: linked sets are of one class or of neighbouring ones."""
    bounds = [1]
    while len(bounds) < 3 or bounds[-3] <= largest:
        bounds.append(bounds[-1] * den // num + 1)
    return np.array(bounds, np.int64)


def slices_of(bounds: np.ndarray, num: int, den: int) -> np.ndarray:
    """Slices of each class but the last: more than the grams in which linked sets of the class can differ, by about a third."""
    most = (den - num) * 2 * (bounds[1:] - 1) // (num + den) + 1
    return most + 1 + most * 5 // 16


def members(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def signatures(grams: np.ndarray, cut: np.ndarray, num: int, den: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) pairs of sets grams[cut[i] : cut[i + 1]] (sorted distinct 64-bit hashes). Empty sets have none. frequent: sorted hashes, the
    same for all sets that are to meet."""
    size = np.diff(cut)
    sets, found = [], []
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bounds = class_bounds(int(size.max()), num, den)
    slices = slices_of(bounds, num, den)
    own = np.searchsorted(bounds, size, "right") - 1
    rare = ~members(grams, frequent)
    for up in (0, 1):
        which = np.flatnonzero(size)
        scheme = own[which] + up
        other = np.minimum(bounds[scheme + 1] - 1, size[which] * den // num)
        which, scheme, other = (x[other >= bounds[scheme]] for x in (which, scheme, other))
        for turn in range(ROUNDS + 1):
            if not len(which):
                break
            n, count = size[which], slices[scheme]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(cut[which] - ends + n, n)
            owner = np.repeat(np.arange(len(which)), n)
            h = grams[at]
            salt = mix(scheme.astype(np.uint64) * _K[0] + np.full(len(which), turn + 1, np.uint64) * _K[1])
            if turn == ROUNDS:
                sets.append(which[owner])
                found.append(mix(h + salt[owner]))
                break
            if turn == 0:
                h, owner = h[rare[at]], owner[rare[at]]
            elif turn > 1:
                h = mix(h + mix(np.full(1, turn, np.uint64)))
            place = ((h >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)
            code = (np.cumsum(count) - count)[owner] + place.astype(np.int64)  # ascending in the first two turns, as grams are
            if turn > 1:
                order = np.argsort(code, kind="stable")
                code, h, owner = code[order], h[order], owner[order]
            if not len(code):
                continue
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            total = np.add.reduceat(mix(h ^ _K[3]), first)
            of, held = owner[first], np.diff(np.append(first, len(code)))
            differ = (den - num) * (n + other) // (num + den)
            full = np.bincount(of, minlength=len(which))
            order = np.lexsort((-held, of))  # stable: of equal ones the first slices
            kept = order[np.arange(len(order)) - (np.cumsum(full) - full)[of] <= differ[of]]
            sets.append(which[of[kept]])
            found.append(mix(total[kept] + mix(salt[of[kept]] + (code[first[kept]] - (np.cumsum(count) - count)[of[kept]]).astype(np.uint64) * _K[2])))
            bad = full <= differ
            which, scheme, other = which[bad], scheme[bad], other[bad]
    return np.concatenate(sets), np.concatenate(found)
