"""Best-fit-decreasing bin packing with a balanced tree of open bins."""

from __future__ import annotations

from collections.abc import Sequence


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


def _height(n) -> int:
    return n.height if n else 0


def _fix(n):
    n.height = 1 + max(_height(n.left), _height(n.right))
    return n


def _rotate_right(n):
    top = n.left
    n.left, top.right = top.right, n
    _fix(n)
    return _fix(top)


def _rotate_left(n):
    top = n.right
    n.right, top.left = top.left, n
    _fix(n)
    return _fix(top)


def _balance(n):
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _rotate_left(n.left)
        return _rotate_right(n)
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _rotate_right(n.right)
        return _rotate_left(n)
    return _fix(n)


def _insert(n, key):
    if n is None:
        return _Node(key)
    if key < n.key:
        n.left = _insert(n.left, key)
    else:
        n.right = _insert(n.right, key)
    return _balance(n)


def _pop_least(n):
    if n.left is None:
        return n.key, n.right
    key, n.left = _pop_least(n.left)
    return key, _balance(n)


def _remove(n, key):
    if key < n.key:
        n.left = _remove(n.left, key)
    elif key > n.key:
        n.right = _remove(n.right, key)
    elif n.left is None or n.right is None:
        return n.left or n.right
    else:
        n.key, n.right = _pop_least(n.right)
    return _balance(n)


class OpenBins:
    """Height-balanced search tree of (remaining capacity, bin number)."""

    def __init__(self):
        self.root = None

    def add(self, remaining: int, number: int) -> None:
        self.root = _insert(self.root, (remaining, number))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds ``size``."""
        found, n = None, self.root
        while n:
            if n.key[0] >= size:
                found, n = n.key, n.left
            else:
                n = n.right
        if found:
            self.root = _remove(self.root, found)
        return found


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each item; an item over ``capacity`` has a bin of its own."""
    bins, place, opened = OpenBins(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        remaining, number = bins.take_tightest(sizes[i]) or (max(capacity, sizes[i]), opened)
        opened += number == opened
        place[i] = number
        if remaining > sizes[i]:
            bins.add(remaining - sizes[i], number)
    return place


def pack_into(sizes: Sequence[int], n_bins: int) -> list[int]:
    """Items in at most ``n_bins`` bins of the least common capacity that best fit finds.

    Items of at least the mean load of the bins still free get a bin each, so
    they do not loosen the capacity of the others.
    """
    place = [0] * len(sizes)
    rest = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left, total, number = n_bins, sum(sizes), 0
    while left > 1 and rest and sizes[rest[0]] * left >= total:
        place[rest[0]] = number
        total -= sizes[rest[0]]
        rest, left, number = rest[1:], left - 1, number + 1
    if not rest:
        return place
    inner = [sizes[i] for i in rest]
    low, high = -(-total // left), -(-total // left) + inner[0]
    best = None
    while low <= high:  # best fit needs no more than ``left`` bins at ``high``
        middle = (low + high) // 2
        tried = best_fit_decreasing(inner, middle)
        if max(tried) < left:
            best, high = tried, middle - 1
        else:
            low = middle + 1
    for i, b in zip(rest, best, strict=True):
        place[i] = number + b
    return place
