"""Slow, plain NumPy forms of the density operators, for comparison."""

import numpy as np


def cosine_matrix(x):
    x = np.asarray(x, dtype=np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    zero = (norms == 0).ravel()
    u = x / np.where(norms == 0, 1, norms)
    d = np.round(np.maximum(1 - u @ u.T, 0), 12)
    d[np.ix_(zero, zero)] = 0
    np.fill_diagonal(d, 0)
    return d


def core_distances(d, min_samples):
    k = min(min_samples, len(d) - 1)
    return np.sort(d, axis=1)[:, k]


def mutual_reachability(d, cores):
    return np.maximum(d, np.maximum(cores[:, None], cores[None, :]))


def spanning_weights(w):
    """Sorted edge weights of a minimum spanning tree (Prim)."""
    n = len(w)
    inside, best, out = np.zeros(n, bool), w[0].copy(), []
    inside[0] = True
    for _ in range(n - 1):
        masked = np.where(inside, np.inf, best)
        j = int(masked.argmin())
        out.append(masked[j])
        inside[j] = True
        best = np.minimum(best, w[j])
    return np.sort(out)


def tree_clusters(n, edges, m):
    """Labels from ``(weight, a, b)`` edges over ``n`` points, merged in order."""
    parent = list(range(2 * n - 1))
    size = [1] * n + [0] * (n - 1)
    kids = {}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (w, a, b) in enumerate(sorted(edges)):
        left, right = top(a), top(b)
        node = n + i
        parent[left] = parent[right] = node
        size[node] = size[left] + size[right]
        kids[node] = (left, right, 1 / max(w, 1e-12))

    def leaves(node):
        stack, out = [node], []
        while stack:
            x = stack.pop()
            if x in kids:
                stack += kids[x][:2]
            else:
                out.append(x)
        return out

    clusters = []  # birth, parent, stability, children, point leaves

    def walk(node, birth, up):
        me = len(clusters)
        clusters.append({"up": up, "stability": 0.0, "kids": [], "points": leaves(node)})
        while node in kids:
            left, right, density = kids[node]
            big = [c for c in (left, right) if size[c] >= m]
            if len(big) == 2:
                clusters[me]["stability"] += size[node] * (density - birth)
                for c in big:
                    clusters[me]["kids"].append(walk(c, density, me))
                return me
            gone = size[node] if not big else min(size[left], size[right]) if size[left] != size[right] else size[right]
            if len(big) == 1:
                gone = size[node] - size[big[0]]
            clusters[me]["stability"] += gone * (density - birth)
            if not big:
                return me
            node = big[0]
        return me

    labels = np.full(n, -1)
    if n < m:
        return labels
    walk(2 * n - 2, 0.0, None)
    picked, value = {}, {}
    for c in reversed(range(len(clusters))):
        below = sum(value[k] for k in clusters[c]["kids"])
        picked[c] = c != 0 and below <= clusters[c]["stability"]
        value[c] = max(clusters[c]["stability"], below)
    found = []

    def choose(c):
        if picked[c]:
            found.append(clusters[c]["points"])
        else:
            for k in clusters[c]["kids"]:
                choose(k)

    choose(0)
    for number, points in enumerate(sorted(found, key=min)):
        labels[points] = number
    return labels
