"""Byte-pair encoding as a deterministic automaton over tokens, compiled into tables.

The automaton starts with one state per byte and an arc from every state to every byte. Each merge `(u, v) -> w`, in
rank order, is one gadget on it:

* a new state `w` takes over the outgoing arcs of `v`, and arcs labelled `w` appear wherever an arc `u` led,
* the arc `v` is taken from state `u`, because `u v` can't stand side by side any more.

What is left after the last gadget accepts exactly the right encodings, and every string has one path through it. A
vocabulary of 50k tokens leaves some 10^9 arcs, so the gadgets work on their complement. Arc `v` of state `u` is copied,
if it isn't there any more, to every state that ends in `u` by a later merge and to every label that begins with `v` by
one. With states in depth-first order of the trees "ends in" and labels in that of "begins with", later merges first, both
are intervals: a gadget takes out one rectangle. `compiled` cuts the rectangles by state into a sorted list of the
intervals of labels that have no arc: about 20 a state, a few megabytes for a whole vocabulary.

The labels are spelled in bytes by a second table, from (node, byte) to node. Encoding a word walks both tables: as
prefixes of right encodings are right encodings, every position has one state only, and the labels of the arcs on the
way back from the last position are the ids. Decoding puts the labels of the arcs together. The tables are compiled once,
by the driver, and sent to the workers as one block of bytes, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import json
import pickle
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right

import regex

#: Pattern that splits a text before the merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts without the characters of `_AWKWARD`, in terms of the faster standard module.
_FAST = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_FAST_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_FULL = regex.compile(SPLIT)

#: Characters on which the two modules differ: numbers that aren't decimal digits, and the separators 1C-1F.
_AWKWARD = frozenset("\x1c\x1d\x1e\x1f") | {
    chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")
}


def split_words(text: str) -> list[str]:
    """The pieces within which merges happen; joined again they are the text."""
    if not _AWKWARD.isdisjoint(set(text)):
        return _FULL.findall(text)
    return (_FAST_ASCII if text.isascii() else _FAST).findall(text)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in the .json files: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in out.values():
            out[chr(spare)] = b
            spare += 1
    return out


def _spans(tokens, half, rank):
    """Positions of the tokens in depth-first order of the trees in which `half[w]` is above `w`, later merges first;
    the position after each tree; and the children of each token."""
    below: dict[int, list[int]] = {}
    for w in tokens:
        if rank[w] >= 0:
            below.setdefault(half[w], []).append(w)
    for k in below.values():
        k.sort(key=lambda w: -rank[w])
    at, end, n = {}, {}, 0
    todo = [(w, False) for w in tokens if rank[w] < 0]
    while todo:
        w, left = todo.pop()
        if left:
            end[w] = n
            continue
        at[w] = n
        n += 1
        todo.append((w, True))
        todo.extend((c, False) for c in reversed(below.get(w, ())))
    return at, end, below


def compiled(tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> dict:
    """The tables of a vocabulary, as arrays.

    `state` and `label` give a token its place as a state and as a label; the labels without an arc from the state at
    place `x` are those in `[lo, hi)` at `row[x]` to `row[x + 1]`. `edge` (node * 256 + byte) leads to `node`, and `token`
    is what a node spells, -1 for no token. `text` and `cut` hold the bytes of the tokens by id.
    """
    import numpy as np

    top = max(tokens.values()) + 1
    rank, left, right = [-1] * top, [-1] * top, [-1] * top
    pair: dict[tuple[int, int], int] = {}
    for r, (u, v) in enumerate(merges):
        a, b, w = tokens[u], tokens[v], tokens[u + v]
        if rank[w] < 0:
            rank[w], left[w], right[w] = r, a, b
        pair.setdefault((a, b), r)
    ids = sorted(tokens.values())
    states, states_end, ends_in = _spans(ids, right, rank)
    labels, labels_end, begins_with = _spans(ids, left, rank)

    def until(at, end, below, w, r, same):
        """The place after `w` and the tokens made of it later than by merge `r` (or by it, if `same`)."""
        c = below.get(w, ())
        n = bisect_right(c, -r if same else -r - 1, key=lambda x: -rank[x])
        return end[c[n - 1]] if n else at[w] + 1

    # one gadget a merge; equal pairs merge from the left, so what the same merge makes is gone as a label only
    cuts = np.array([(states[u], until(states, states_end, ends_in, u, r, False), labels[v], until(labels, labels_end, begins_with, v, r, True)) for (u, v), r in pair.items()] or np.zeros((0, 4)), dtype=np.int64)
    wide = cuts[:, 1] - cuts[:, 0]
    x = np.repeat(cuts[:, 0], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    lo, hi = np.repeat(cuts[:, 2], wide), np.repeat(cuts[:, 3], wide)
    order = np.lexsort((-hi, lo, x))
    x, lo, hi = x[order], lo[order], hi[order]
    # intervals of a state lie apart or within each other: only the outermost count
    reach = x * (top + 1) + hi
    outer = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])[: len(x)]
    x, lo, hi = x[outer], lo[outer], hi[outer]

    edge: dict[int, int] = {}
    token = [-1]
    for t, i in tokens.items():
        node = 0
        for byte in t:
            k = node << 8 | byte
            node = edge.get(k)
            if node is None:
                node = edge[k] = len(token)
                token.append(-1)
        token[node] = i
    place = lambda at: np.array([at.get(i, -1) for i in range(top)], dtype=np.int32)
    text = {i: t for t, i in tokens.items()}
    return {
        "state": place(states), "label": place(labels), "row": np.searchsorted(x, np.arange(len(ids) + 1)).astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32),
        "edge": np.fromiter(edge, dtype=np.int64, count=len(edge)), "node": np.fromiter(edge.values(), dtype=np.int32, count=len(edge)), "token": np.array(token, dtype=np.int32),
        "text": np.frombuffer(b"".join(text.get(i, b"") for i in range(top)), dtype=np.uint8), "cut": np.cumsum([0] + [len(text.get(i, b"")) for i in range(top)]).astype(np.int64),
    }


class Automaton:
    """Encoder and decoder of one vocabulary by its tables. Texts of special tokens are ordinary text."""

    def __init__(self, tables: dict):
        self.tables = tables
        whole = lambda n: array("i", tables[n].tobytes())
        self.state, self.label, self.row, self.lo, self.hi, self.token = (whole(n) for n in ("state", "label", "row", "lo", "hi", "token"))
        self.next = dict(zip(tables["edge"].tolist(), tables["node"].tolist()))
        text, cut = tables["text"].tobytes(), tables["cut"].tolist()
        self.labels = {i: text[cut[i] : cut[i + 1]] for i in range(len(cut) - 1) if cut[i] < cut[i + 1]}

    @classmethod
    def of(cls, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> "Automaton":
        return cls(compiled(tokens, merges))

    @classmethod
    def from_json(cls, path: str) -> "Automaton":
        """From a byte-level BPE file with `vocab` and `merges`."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = _byte_alphabet()
        raw = lambda s: bytes(plain[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        tokens = {}
        for s, i in model["vocab"].items():
            if all(c in plain for c in s):
                tokens[raw(s)] = i
        made = [(raw(a), raw(b)) for a, b in merges]
        reach = {u + v for u, v in made} | {bytes([b]) for b in range(256)}
        return cls.of({t: i for t, i in tokens.items() if t in reach}, made)

    @classmethod
    def from_ranks(cls, path: str) -> "Automaton":
        """From a file of base64 tokens and ranks; the merge that makes a token is what the lower ranks leave of it."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merges = []
        for token, own in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                at = min(
                    (i for i in range(len(parts) - 1) if ranks.get(parts[i] + parts[i + 1], own) < own),
                    key=lambda i: ranks[parts[i] + parts[i + 1]],
                    default=None,
                )
                if at is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                merges.append((parts[0], parts[1]))
        return cls.of(ranks, merges)

    @classmethod
    def load(cls, path: str) -> "Automaton":
        return cls.from_json(path) if path.endswith(".json") else cls.from_ranks(path)

    @classmethod
    def unpacked(cls, block: bytes) -> "Automaton":
        """From what `packed` gave."""
        return cls(pickle.loads(block))

    def packed(self) -> bytes:
        return pickle.dumps(self.tables, protocol=5)

    def arc(self, a: int, b: int) -> bool:
        """Whether state `a` has an arc labelled `b`: the label isn't in one of the state's gaps."""
        x, y = self.state[a], self.label[b]
        begin = self.row[x]
        i = bisect_right(self.lo, y, begin, self.row[x + 1]) - 1
        return i < begin or y >= self.hi[i]

    def word(self, w: bytes) -> array:
        """Ids of one word."""
        # Depth first, longest label first: a position has one state, so none is entered twice.
        n = len(w)
        state = [-1] * (n + 1)
        came = [0] * (n + 1)
        step, token, arc = self.next.get, self.token, self.arc
        todo: list[tuple[int, int, int]] = []
        i = 0
        while state[n] < 0:
            node = 0
            for k in range(i, n):
                node = step(node << 8 | w[k])
                if node is None:
                    break
                t = token[node]
                if t >= 0 and state[k + 1] < 0:
                    todo.append((i, k + 1, t))
            while todo:
                i, k, t = todo.pop()
                if state[k] < 0 and (not i or arc(state[i], t)):
                    state[k], came[k] = t, i
                    i = k
                    break
            else:
                break
        if state[n] < 0:
            raise ValueError("the vocabulary doesn't cover these bytes")
        out, k = array("i"), n
        while k:
            out.append(state[k])
            k = came[k]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for w in split_words(text):
            out += self.word(w.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids) -> str:
        """The text of the labels; whole characters come back exactly."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class WordTable(dict):
    """Ids of the words met so far, as bytes of 4-byte integers. Cleared when it holds `most` words: memory stays bounded."""

    def __init__(self, automaton: Automaton, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.automaton, self.most, self.longest = automaton, most, longest
        self.chunks = _ChunkTable(self, most)

    def __missing__(self, w: str) -> bytes:
        ids = self.automaton.word(w.encode("utf-8", "surrogatepass")).tobytes()
        if len(w) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[w] = ids
        return ids

    def words(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, split_words(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text.

        A blank before anything but white space always begins a word, so unless blanks meet other white space the text
        falls apart at its blanks and most of the parts are in the table already.
        """
        if _BLANK_RUN.search(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return self.words(first) + b"".join(map(self.chunks.__getitem__, rest)) if rest else self.words(first)


class _ChunkTable(dict):
    """Ids of a blank and what follows it up to the next blank."""

    def __init__(self, words: WordTable, most: int, longest: int = 24):
        super().__init__()
        self.parts, self.most, self.longest = words, most, longest

    def __missing__(self, chunk: str) -> bytes:
        ids = self.parts.words(" " + chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


_BLANK_RUN = re.compile(r" (?:\s|$)")

_LOADED: dict[str, WordTable] = {}


def word_table(path: str, block: bytes | None = None) -> WordTable:
    """The table of this process for a vocabulary file, from the compiled `block` if there is one."""
    t = _LOADED.get(path)
    if t is None:
        t = _LOADED[path] = WordTable(Automaton.load(path) if block is None else Automaton.unpacked(block))
    return t


def shared_tables(spark, path: str):
    """`() -> WordTable` for the workers: the vocabulary is compiled here, once, and broadcast (some ten megabytes, whatever the data)."""
    kept = getattr(spark.sparkContext, "_fleetweave_tables", None)
    if kept is None:
        kept = spark.sparkContext._fleetweave_tables = {}
    if path not in kept:
        kept[path] = spark.sparkContext.broadcast(word_table(path).automaton.packed())
    block = kept[path]
    return lambda: word_table(path, block.value) if path not in _LOADED else _LOADED[path]
