"""An adaptive radix tree over byte strings: node layouts that grow, paths that are compressed."""

from __future__ import annotations

from collections.abc import Iterator

# Children that a layout holds (the last two address children by byte).
LAYOUTS = (4, 16, 48, 256)


class Node:
    """``path`` leads here from the parent, first byte included; ``item`` belongs to the key that ends here.

    Up to 4, then 16 children: their bytes and the children side by side. Up to 48: a table from byte to
    slot. Above: a child for each byte. ``sample`` is an item that lies at or below the node.
    """

    __slots__ = ("path", "item", "sample", "layout", "keys", "kids")

    def __init__(self, path: bytes, item: int, sample: int):
        self.path, self.item, self.sample = path, item, sample
        self.layout = 0
        self.keys: bytearray | None = None
        self.kids: list = []

    def find(self, byte: int) -> Node | None:
        if self.layout == 0:
            return None
        if self.layout <= 16:
            slot = self.keys.find(byte)
            return self.kids[slot] if slot >= 0 else None
        if self.layout == 48:
            slot = self.keys[byte]
            return self.kids[slot - 1] if slot else None
        return self.kids[byte]

    def put(self, child: Node) -> None:
        """Add a child, or replace the one that begins with the same byte."""
        byte = child.path[0]
        if self.layout <= 16 and self.layout and (slot := self.keys.find(byte)) >= 0:
            self.kids[slot] = child
            return
        if self.layout == 48 and self.keys[byte]:
            self.kids[self.keys[byte] - 1] = child
            return
        if self.layout == 256:
            self.kids[byte] = child
            return
        if self.layout == 0:
            self.layout, self.keys = 4, bytearray()
        elif len(self.kids) == self.layout:
            self._grow()
        if self.layout == 256:
            self.kids[byte] = child
        elif self.layout == 48:
            self.kids.append(child)
            self.keys[byte] = len(self.kids)
        else:
            self.keys.append(byte)
            self.kids.append(child)

    def _grow(self) -> None:
        """Move to the next larger layout."""
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            slots = bytearray(256)
            for slot, byte in enumerate(self.keys):
                slots[byte] = slot + 1
            self.layout, self.keys = 48, slots
        else:
            full: list = [None] * 256
            for byte, slot in enumerate(self.keys):
                if slot:
                    full[byte] = self.kids[slot - 1]
            self.layout, self.keys, self.kids = 256, None, full

    def children(self) -> Iterator[Node]:
        return (k for k in self.kids if k is not None)


def _shared(a: bytes, b: bytes) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def insert(root: Node, key: bytes, item: int) -> None:
    """Add a key; a path that it leaves half way is split there."""
    parent, node, at = None, root, 0
    while True:
        path = node.path
        if key.startswith(path, at):
            at += len(path)
        else:
            shared = _shared(path, key[at : at + len(path)])
            upper = Node(path[:shared], -1, node.sample)
            node.path = path[shared:]
            upper.put(node)
            parent.put(upper)
            node = upper
            at += shared
        if at == len(key):
            node.item = item
            return
        child = node.find(key[at])
        if child is None:
            node.put(Node(key[at:], item, item))
            return
        parent, node = node, child


def build(keys: list[bytes]) -> Node:
    """The tree of distinct keys; a key's item is its place in the list."""
    root = Node(b"", -1, 0)
    for item, key in enumerate(keys):
        insert(root, key, item)
    return root
