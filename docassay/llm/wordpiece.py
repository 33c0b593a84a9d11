"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

Pieces that begin a word and pieces that continue one are two tries. Each trie node has a
failure link: the state after the greedy pieces of its own string are popped, and how many are. Failure links are
folded into one transition table, whose entries hold the next state and the number of pieces
popped on the way, so that every byte of a text is one look-up and no piece is built. All words
of a slice of texts advance together, byte by byte, in numpy.

A word is a run of bytes other than ASCII white space. A word that the greedy rule cannot cover counts as
one unknown token. The vocabulary is a parameter: a file of base64 tokens and ranks, in which
tokens with a leading space begin a word.

Defined cases: null and blank texts have no words and no tokens; an empty table gives an empty
result; repeated rows stay; an input column named like a result column is replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import buffers, map_text, sums

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_WORD = 512
_POP = 24  # table entries: state in the low bits, popped pieces above; 64 bits wide where 32 do not hold them
_STATE = (1 << _POP) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_built: dict[int, "Automaton"] = {}


def read_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word, and pieces that continue one."""
    with open(path, "rb") as file:
        tokens = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    return sorted({t[1:] for t in tokens if t[:1] == b" " and len(t) > 1}), sorted({t for t in tokens if t[:1] != b" "})


class Automaton:
    """State 0 is dead, 1 begins a word, 2 stands after whole pieces."""

    DEAD, BEGIN, AFTER = 0, 1, 2

    def __init__(self, begin: list[bytes], after: list[bytes]):
        child: dict[tuple[int, int], int] = {}
        whole = [False, False, False]
        levels: list[list[tuple[int, int, int]]] = []  # (parent, byte, node) by depth
        for root, pieces in ((self.BEGIN, begin), (self.AFTER, after)):
            for piece in pieces:
                node = root
                for depth, byte in enumerate(piece):
                    at = child.get((node, byte))
                    if at is None:
                        at = child[node, byte] = len(whole)
                        whole.append(False)
                        if depth == len(levels):
                            levels.append([])
                        levels[depth].append((node, byte, at))
                    node = at
                if piece:
                    whole[node] = True
        n = len(whole)
        if n > _STATE:
            raise ValueError("the vocabulary has too many nodes")
        fail, pops = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.table = table = np.zeros((n, 256), np.int32)
        is_whole = np.array(whole)
        nodes = np.array([self.BEGIN, self.AFTER])
        for depth in range(len(levels) + 1):
            # A missing child goes where the failure state goes, with the pieces popped on the way.
            if depth:
                row = table[fail[nodes]].astype(np.int64)
                alive = (row & _STATE) != self.DEAD
                row = np.where(alive, row + (pops[nodes][:, None] << _POP), 0)
                if table.dtype == np.int32 and row.max() > np.iinfo(np.int32).max:
                    self.table = table = table.astype(np.int64)
                table[nodes] = row
            if depth == len(levels):
                break
            parent, byte, node = np.array(levels[depth]).T
            step = table[fail[parent], byte].astype(np.int64) if depth else np.zeros(len(node), np.int64)
            state, popped = step & _STATE, step >> _POP
            fail[node] = np.where(is_whole[node], self.AFTER, state)
            pops[node] = np.where(is_whole[node], 1, np.where(state == self.DEAD, 0, pops[parent] + popped))
            table[parent, byte] = node
            nodes = node
        # Pieces popped at the end of a word; -1 where no cover exists.
        self.end = end = np.full(n, -1, np.int64)
        end[self.AFTER] = 0
        for level in levels:
            node = np.array(level)[:, 2]
            end[node] = np.where(end[fail[node]] >= 0, end[fail[node]] + pops[node], -1)

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of each word; -1 for one without a cover."""
        order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
        start, size = start[order], size[order]
        state, total = np.full(len(start), self.BEGIN, np.int64), np.zeros(len(start), np.int64)
        long = int(np.searchsorted(-size, -LONG_WORD, "left"))
        for i in range(long):
            own, sum_ = self.BEGIN, 0
            for byte in data[start[i] : start[i] + size[i]].tolist():
                step = int(self.table[own, byte])
                own, sum_ = step & _STATE, sum_ + (step >> _POP)
                if own == self.DEAD:
                    break
            state[i], total[i] = own, sum_
        flat = self.table.ravel()
        for j in range(int(size[long]) if long < len(size) else 0):
            n = int(np.searchsorted(-size, -j, "left"))
            step = flat[(state[long:n] << 8) + data[start[long:n] + j]]
            state[long:n] = step & _STATE
            total[long:n] += step >> _POP
        last = self.end[state]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(last >= 0, total + last, -1)
        return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each word, and the index of each text's first; one more at the end."""
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < len(data))]
    before[edge], after[edge - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1 - start, np.searchsorted(start, off)


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_tokens`` and ``n_unknown``."""
    begin, after = read_vocabulary(vocabulary)
    key = hash((tuple(begin), tuple(after)))
    sent = docs.sparkSession.sparkContext.broadcast((key, begin, after))  # as large as the vocabulary file

    def make():
        key, begin, after = sent.value
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(begin, after)
        automaton = _built[key]

        def compute(column: pa.Array) -> dict:
            data, off = buffers(column)
            start, size, first = words(data, off)
            found = automaton.count(data, start, size)
            unknown = found < 0
            tokens = sums(np.where(unknown, 1, found), first).astype(np.int64)
            return {"n_words": np.diff(first), "n_tokens": tokens, "n_unknown": sums(unknown, first).astype(np.int64)}

        return compute

    return map_text(docs, text, make, [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])
