"""The prefix tree over globally ordered sets, and the exact similarity join on it."""

from __future__ import annotations

import numpy as np


def needed(percent: int, a, b):
    """The least overlap at which sets of a and b elements reach percent of their union."""
    return -(-percent * (a + b) // (100 + percent))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class _Groups:
    """Which places are known to be connected: a label each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
        return a != b


def trie_links(members: list[np.ndarray], probes: list[np.ndarray], percent: int, known: _Groups, member_at: list[int], probe_at: list[int]) -> list[tuple[int, int]]:
    """Pairs (place of a member, place of a probe) that reach percent, enough to connect whatever pairs connect.

    Sets are arrays of distinct tokens in the global order; places index ``known``, which
    takes every link found. The members' common beginnings are the trie's inner paths. One
    traversal serves all probes: a vector holds each probe's overlap with the path so far,
    is shared by all members below, and grows by the postings (token to probes) of the next
    stretch. A subtree is given up when no probe's overlap plus the remaining length can
    reach what its shortest member needs, or when all that could are connected already.
    """
    found: list[tuple[int, int]] = []
    order = sorted(range(len(members)), key=lambda i: members[i].tobytes())
    lengths = np.array([len(members[i]) for i in order])
    depth_of = [0, *[_shared(members[order[k - 1]], members[order[k]]) for k in range(1, len(order))]]
    sizes = np.array([len(p) for p in probes])
    tokens, local = np.unique(np.concatenate(probes), return_inverse=True)
    by_token = np.argsort(local, kind="stable")
    posting = np.repeat(np.arange(len(probes)), sizes)[by_token]
    count = np.bincount(local, minlength=len(tokens))
    start = np.cumsum(count) - count
    probe_place = np.array(probe_at)

    def grown(path: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(tokens, path), len(tokens) - 1)
        at = at[tokens[at] == path]
        many = count[at]
        total = int(many.sum())
        if not total:
            return overlap
        where = np.repeat(start[at] - (np.cumsum(many) - many), many) + np.arange(total)
        return overlap + np.bincount(posting[where], minlength=len(overlap))

    def open_probes(depth: int, overlap: np.ndarray, first: int, last: int) -> np.ndarray:
        low, high = int(lengths[first:last].min()), int(lengths[first:last].max())
        need = np.maximum(needed(percent, sizes, low), -(-percent * np.maximum(sizes, low) // 100))
        return np.flatnonzero(np.minimum(overlap + high - depth, sizes) >= need)

    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(len(probes), np.int64))]
    k = 0
    while k < len(order):
        member, branch = members[order[k]], depth_of[k]
        while stack[-1][0] > branch:
            stack.pop()
        if stack[-1][0] < branch:
            stack.append((branch, grown(member[stack[-1][0] : branch], stack[-1][1])))
            last = k + 1
            while last < len(order) and depth_of[last] >= branch:
                last += 1
            if not len(open_probes(branch, stack[-1][1], k, last)):  # the subtree from here on holds nothing
                k = last
                continue
        depth, overlap = stack[-1]
        place = member_at[order[k]]
        hopeful = open_probes(depth, overlap, k, k + 1)
        if (known.label[probe_place[hopeful]] != known.label[place]).any():
            total = grown(member[depth:], overlap)
            for p in np.flatnonzero(total >= needed(percent, sizes, len(member))).tolist():
                if known.join(place, probe_at[p]):
                    found.append((place, probe_at[p]))
        k += 1
    return found


def connected(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the sets that connect whatever sets any links connect."""
    places = list(range(len(sets)))
    return trie_links(sets, sets, percent, _Groups(len(sets)), places, places)


def connected_across(members: list[np.ndarray], member_labels: list[int], probes: list[np.ndarray], probe_labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (member, probe) between different labels that connect whatever labels any links connect."""
    number = {x: i for i, x in enumerate(dict.fromkeys([*member_labels, *probe_labels]))}
    member_at, probe_at = [number[x] for x in member_labels], [number[x] for x in probe_labels]
    labels = list(number)
    return [(labels[a], labels[b]) for a, b in trie_links(members, probes, percent, _Groups(len(labels)), member_at, probe_at)]
