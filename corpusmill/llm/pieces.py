"""A fixed public piece vocabulary as a trie that numpy walks for many positions at once."""

from __future__ import annotations

import numpy as np

WORD_START = "▁"
EMPTY = -1


def read_pieces(path: str, lower: bool = True) -> list[str]:
    """Pieces of a sentencepiece vocabulary that a word can hold, in id order; with lower only those in lower case."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(p for p in pieces if p and (not lower or p == p.lower()) and WORD_START not in p[1:]))


class PieceTrie:
    """Children of (node, code point) in an open-addressing table; node 0 is the root."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        nodes: dict[str, int] = {"": 0}
        edges = []
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges.append((nodes[p[: k - 1]] << 21 | ord(p[k - 1]), nodes[p[:k]]))
        self.piece = np.full(len(nodes), EMPTY, dtype=np.int64)
        for i, p in enumerate(pieces):
            self.piece[nodes[p]] = i
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY, dtype=np.int64)
        self.nodes = np.full(1 << self.bits, EMPTY, dtype=np.int32)
        slots = self._slot(np.array([k for k, _ in edges], dtype=np.int64)).tolist()
        for (key, node), s in zip(edges, slots):
            while self.keys[s] != EMPTY:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.nodes[s] = key, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Child of each node by each code point, EMPTY where there is none."""
        keys = nodes.astype(np.int64) << 21 | codes
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.nodes[slots], EMPTY)
        todo = np.flatnonzero((seen != keys) & (seen != EMPTY))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.nodes[slots[todo[hit]]]
            todo = todo[~hit & (seen != EMPTY)]
        return out


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each with the word mark before it, in one array, and the marked lengths."""
    flat = WORD_START + WORD_START.join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64), lengths
