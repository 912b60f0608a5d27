"""BK-trees over 64-bit fingerprints, held as numpy arrays.

A node's children are keyed by their Hamming distance to it. Trees are built level by
level: all items below a node are keyed at once, and the first item of each key
becomes the child. A search follows only the edges whose key lies within the radius
of the query's own distance to the node.
"""

import numpy as np


class BKTree:
    def __init__(self, items):
        self.items = np.asarray(items, np.uint64)
        n = len(self.items)
        self.key = np.zeros(n, np.int64)  # distance to the parent
        parent = np.full(n, -1, np.int64)
        below, at = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(below):
            key = np.bitwise_count(self.items[below] ^ self.items[at]).astype(np.int64)
            _, first, group = np.unique(at * 65 + key, return_index=True, return_inverse=True)
            child = below[first]
            parent[child], self.key[child] = at[first], key[first]
            at = child[group]
            deeper = below != at
            below, at = below[deeper], at[deeper]
        order = np.argsort(parent, kind="stable")
        self.children = order[1:] if n else order  # the root comes first
        self.first = np.searchsorted(parent[self.children], np.arange(n))
        self.count = np.bincount(parent[self.children], minlength=n) if n else np.zeros(0, np.int64)

    def within(self, queries, radius, block=512):
        """Pairs (query index, item index) at most `radius` apart."""
        queries = np.asarray(queries, np.uint64)
        found = [np.zeros((0, 2), np.int64)]
        for start in range(0, len(queries) if len(self.items) else 0, block):
            query = np.arange(start, min(start + block, len(queries)))
            node = np.zeros(len(query), np.int64)
            while len(node):
                far = np.bitwise_count(queries[query] ^ self.items[node]).astype(np.int64)
                hit = far <= radius
                found.append(np.stack([query[hit], node[hit]], 1))
                counts = self.count[node]
                query, far = np.repeat(query, counts), np.repeat(far, counts)
                steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                node = self.children[np.repeat(self.first[node], counts) + steps]
                near = np.abs(self.key[node] - far) <= radius
                query, node = query[near], node[near]
        return np.concatenate(found)


def forest(n, pairs):
    """The smallest index each of n items is linked to, over any number of links."""
    root = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
