"""Deep-shallow sorting of byte strings, with the common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

#: Words of eight bytes that multikey quicksort looks at before blind tries take over.
SHALLOW_WORDS = 3
SMALL = 8


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differs.bit_length() + 7) // 8


class _Node:
    """Inner node of a blind trie: strings below agree on ``depth`` bytes; -1 is the end of a string."""

    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, leaf: int) -> None:
        self.depth, self.leaf, self.children = depth, leaf, {}


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Order of ``members`` and the common prefix of each with the one before (0 for the first).

    A string walks down by the branching bytes alone, is compared once with a string found
    there, and is hung in where the two part. Equal strings share a leaf.
    """
    leaves: dict[int, list[int]] = {members[0]: [members[0]]}
    root: _Node | int = members[0]
    for new in members[1:]:
        s, node = strings[new], root
        while isinstance(node, _Node):
            node = node.children.get(_byte(s, node.depth), node.leaf)
        n = common(s, strings[node])
        if n == len(s) == len(strings[node]):
            leaves[node].append(new)
            continue
        leaves[new] = [new]
        above, at = None, root
        while isinstance(at, _Node) and at.depth < n:
            above, at = at, at.children[_byte(s, at.depth)]
        if isinstance(at, _Node) and at.depth == n:
            at.children[_byte(s, n)] = new
            continue
        split = _Node(n, new)
        other = strings[at.leaf if isinstance(at, _Node) else at]
        split.children = {_byte(s, n): new, _byte(other, n): at}
        if above is None:
            root = split
        else:
            above.children[_byte(s, above.depth)] = split
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[_Node | int, int]] = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, _Node):
            below = [node.children[b] for b in sorted(node.children, reverse=True)]
            stack += [(x, node.depth) for x in below[:-1]]
            stack.append((below[-1], before))
        else:
            same = leaves[node]
            order += same
            shared += [before] + [len(strings[node])] * (len(same) - 1)
    return order, shared


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of ``strings``, and the common prefix of each with its predecessor.

    Multikey quicksort orders them by their first words; strings that agree
    beyond that depth go to blind tries.
    """
    if len(strings) <= SMALL:
        order, shared = blind_trie(strings, list(range(len(strings))))
        return np.array(order), np.array(shared)
    width = 8 * SHALLOW_WORDS
    words = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(-1, SHALLOW_WORDS)
    words = words.astype(np.uint64)
    groups: list[np.ndarray] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(strings)), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) == 1 or depth == SHALLOW_WORDS:
            groups.append(members)
            continue
        keys = words[members, depth]
        pivot = keys[len(keys) // 2]
        less, equal = keys < pivot, keys == pivot
        for part, deeper in ((members[~(less | equal)], depth), (members[equal], depth + 1), (members[less], depth)):
            if len(part):
                stack.append((part, deeper))
    order: list[int] = []
    shared: list[int] = []
    for members in groups:
        ordered, prefix = blind_trie(strings, members.tolist())
        if order:
            prefix[0] = common(strings[order[-1]], strings[ordered[0]])
        order += ordered
        shared += prefix
    return np.array(order), np.array(shared)
