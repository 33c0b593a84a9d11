"""Quality rules by distribution divergence: a text against references of the languages.

Two histograms of every text, character classes and common words, are compared with those of each language by the
Jensen-Shannon distance (base 2, from 0 to 1). A language's references are counted over all documents that name it. Its
common words are those that make up at least one in ``RARITY`` of its words, so it has at most ``RARITY`` of them, and none depends on
ties; all other words are one cell. A language takes part if it holds at least one in ``RARITY`` of all words, so
there are at most ``RARITY`` of these too, and the references can be broadcast whatever the corpus.

A text is judged by the language that is nearest to it. A short text strays from its own distribution by chance: n draws over k cells are
expected to give a divergence of (k - 1) / (8 n ln 2). That is taken off before the distance is compared with ``MOST_CLASSES`` or
``MOST_WORDS``, and texts below ``LEAST_CHARS`` characters or ``LEAST_TERMS`` words are not judged by that histogram at all.

Plain rules come first: a text fails with fewer than ``LEAST_WORDS`` words (runs other than white space), or if more than half of them stand in windows of
three words that the text holds twice or more.

Words of a histogram are runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case.

Defined cases: null and empty texts have no words and fail; a null language takes no part in references; without any
language only the plain rules decide; repeated rows count as often as they occur; an empty table gives an empty result; an input column
named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import _LOWER, Tokens, buffers, map_text, mix, slices, span_hash, windows
from .cluster import cut

LEAST_WORDS, REPEATED = 50, 50  # words; per cent of the words
RARITY, LEAST_TERMS, LEAST_CHARS = 1000, 100, 300
MOST_WORDS, MOST_CLASSES = 0.3, 0.3
WINDOW = 3
SYMBOLS, MARKS = b"#*$%&|<>", b".,;:!?'\"()-"
#: Character classes of ASCII; class 6 are characters beyond it, and bytes that continue one have none.
LOWER, UPPER, DIGIT, SPACE, MARK, OTHER, WIDE = range(7)
CLASSES = 7
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "nearest"]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CLASS = np.full(256, OTHER, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWER, UPPER, DIGIT
_CLASS[_SPACE] = SPACE
_CLASS[list(MARKS)] = MARK
_CLASS[128:192], _CLASS[192:] = -1, WIDE


def per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the flags of each text are set; text i has flags[off[i]:off[i + 1]]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def in_text(h: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal values of the same text."""
    return mix(h + mix(document.astype(np.uint64) + np.uint64(1)))


def spans_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; no run goes beyond its text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


class Words(Tokens):
    """The words of many texts: runs of anything but ASCII white space, as written."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.start, self.end = spans_of(~_SPACE[data], off)
        self.first = np.searchsorted(self.start, off)
        self.hash = span_hash(data, self.start, self.end)


def plain(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the plain rules for each text, and whether it fails them."""
    words = Words(data, off)
    n_words = words.count
    # Lines that hold a word, other than the first of those that are equal.
    line_start, line_end = spans_of(data != 10, off)
    full = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end = line_start[full], line_end[full]
    line_text = np.searchsorted(off, line_start, "right") - 1
    n = len(off) - 1
    different = np.unique(in_text(span_hash(data, line_start, line_end), line_text), return_index=True)[1]
    n_dup_lines = np.bincount(line_text, minlength=n) - np.bincount(line_text[different], minlength=n)
    # Words that any window covers which its text holds twice.
    h, at = windows(words, WINDOW)
    _, where, often = np.unique(in_text(h, np.searchsorted(words.first, at, "right") - 1), return_inverse=True, return_counts=True)
    twice = at[often[where] > 1]
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    n_repeat_words = per_text(np.cumsum(edge)[:-1] > 0, words.first)
    return {
        "n_words": n_words,
        "word_chars": per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), off),
        "n_symbols": per_text(_SYMBOL[data], off),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED * n_words),
    }


def classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text, how many characters each class has."""
    kind = _CLASS[data]
    return np.stack([per_text(kind == k, off) for k in range(CLASSES)], 1)


def terms(data: np.ndarray, off: np.ndarray) -> Tokens:
    """Runs of ASCII letters, digits and characters beyond ASCII; their hashes take only A-Z as equal to a-z."""
    found = Tokens(data, off, hashed=False)
    found.hash = span_hash(_LOWER[data], found.start, found.end)
    return found


# --- references -------------------------------------------------------------------------------------------------------


def lang_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, key, n): of each language, the characters of each class (kind 0), the words in all (1), and each hashed word (2)."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t")).where("lang is not null and t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "t"):
                data, off = buffers(part.column("t"))
                own, found = part.column("lang").dictionary_encode(), terms(data, off)
                code, number = own.indices.to_numpy(), len(own.dictionary)
                held = np.zeros((number, CLASSES), np.int64)
                np.add.at(held, code, classes(data, off))
                every = np.bincount(code, found.count, number).astype(np.int64)
                token_lang = code[found.document()]
                order = np.lexsort((found.hash, token_lang))
                h, token_lang = found.hash[order], token_lang[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (token_lang[1:] != token_lang[:-1]))) if len(h) else np.zeros(0, np.int64)
                which = np.concatenate([np.repeat(np.arange(number), CLASSES), np.arange(number), token_lang[new]])
                kind = np.repeat(np.array([0, 1, 2], np.int8), [number * CLASSES, number, len(new)])
                key = np.concatenate([np.tile(np.arange(CLASSES), number), np.zeros(number, np.int64), h[new].view(np.int64)])
                often = np.concatenate([held.ravel(), every, np.diff(np.append(new, len(h)))])
                yield pa.RecordBatch.from_arrays([own.dictionary.take(pa.array(which)), pa.array(kind), pa.array(key), pa.array(often)], ["lang", "kind", "key", "n"])

    found = rows.mapInArrow(count, "lang string, kind tinyint, key long, n long")
    return found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class References:
    """Of each language: its name, class shares, the share of its common words together and their number; and of every common word its languages.

    word: hashes, ascending, one for each (word, language) in ``of`` and ``share``.
    """

    names: list[str]
    classes: np.ndarray
    common: np.ndarray
    cells: np.ndarray
    word: np.ndarray
    of: np.ndarray
    share: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """The references of the languages of ``docs``, counted over all of it."""
    counts = cut(lang_counts(docs, text, lang))
    words = counts.where("kind = 1")
    every = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = words.where((F.col("n") > 0) & (F.col("n") * RARITY >= every)).select("lang", F.col("n").alias("of_lang"))  # at most RARITY
    names = sorted(r.lang for r in large.collect())
    place = {x: i for i, x in enumerate(names)}
    held = counts.join(F.broadcast(large), "lang")
    share = np.zeros((len(names), CLASSES))
    for r in held.where("kind = 0").collect():  # RARITY x CLASSES at most
        share[place[r.lang], r.key] = r.n
    share /= np.maximum(share.sum(1, keepdims=True), 1)
    found = held.where((F.col("kind") == 2) & (F.col("n") * RARITY >= F.col("of_lang")))  # RARITY x RARITY at most
    found = found.select("lang", "key", (F.col("n") / F.col("of_lang")).alias("share")).toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    of = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)[order]
    part = found["share"].to_numpy()[order]
    return References(names, share, np.bincount(of, part, len(names)), np.bincount(of, minlength=len(names)) + 1, key[order], of, part)


# --- divergence -------------------------------------------------------------------------------------------------------


def half(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a cell with the share p in one and q in the other adds to the divergence for the one, in bits."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p / 2 * np.log2(2 * p / (p + q)), 0.0)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return half(p, q) + half(q, p)


def distance(found: np.ndarray, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distance that a divergence stands for, less what chance alone gives n draws over so many cells."""
    return np.sqrt(np.maximum(found - (cells - 1) / (8 * np.log(2) * np.maximum(n, 1)), 0.0))


def class_distances(data: np.ndarray, off: np.ndarray, known: References) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each text's characters from each language, and the text's characters."""
    count = classes(data, off)
    n = count.sum(1)
    p = count / np.maximum(n, 1)[:, None]
    found = divergence(p[:, None, :], known.classes[None, :, :]).sum(2)
    return distance(found, np.array([CLASSES]), n[:, None]), n


def word_distances(data: np.ndarray, off: np.ndarray, known: References) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each text's words from each language, and the text's words.

    A common word that a text does not hold adds half its share; so only those that it holds are looked at.
    """
    found = terms(data, off)
    n, many = found.count, len(known.names)
    begin = np.searchsorted(known.word, found.hash)
    number = np.searchsorted(known.word, found.hash, "right") - begin
    hit = np.flatnonzero(number)
    document = found.document()
    pair, often = np.unique(document[hit] * max(len(known.word), 1) + begin[hit], return_counts=True)
    text, begin = np.divmod(pair, max(len(known.word), 1))
    number = np.searchsorted(known.word, known.word[begin], "right") - begin
    at = np.repeat(begin - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
    p = np.repeat(often / n[text], number)
    cell = np.repeat(text, number) * many + known.of[at]
    added = divergence(p, known.share[at]) - known.share[at] / 2
    size = (len(n), many)
    total = np.bincount(cell, added, size[0] * many).reshape(size) + known.common / 2
    rest = np.maximum(1 - np.bincount(cell, p, size[0] * many).reshape(size), 0)
    total += divergence(rest, np.maximum(1 - known.common, 0)[None, :])
    return distance(total, known.cells[None, :], n[:, None]), n


def judge(docs: DataFrame, known: References, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns RESULT: counts, base_failed, kept, both distances from the nearest language (null where a text is too short for one), and its name."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        own = sent.value

        def compute(column: pa.Array) -> dict:
            data, off = buffers(column)
            out = plain(data, off)
            if not own.names:
                nothing = pa.nulls(len(column), pa.float64())
                return out | {"kept": ~out["base_failed"], "class_distance": nothing, "word_distance": nothing, "nearest": pa.nulls(len(column), pa.string())}
            by_class, n_chars = class_distances(data, off, own)
            by_word, n_terms = word_distances(data, off, own)
            fits_class, fits_word = n_chars >= LEAST_CHARS, n_terms >= LEAST_TERMS
            both = np.maximum(by_class / MOST_CLASSES * fits_class[:, None], by_word / MOST_WORDS * fits_word[:, None])
            best = np.argmin(both, 1)
            row = np.arange(len(best))
            out["kept"] = ~out["base_failed"] & (both[row, best] <= 1)
            out["class_distance"] = pa.array(by_class[row, best], mask=~fits_class)
            out["word_distance"] = pa.array(by_word[row, best], mask=~fits_word)
            out["nearest"] = pa.array(np.array(own.names, object)[best], pa.string(), mask=~(fits_class | fits_word))
            return out

        return compute

    kinds = [*[T.LongType()] * 5, *[T.BooleanType()] * 2, *[T.DoubleType()] * 2, T.StringType()]
    return map_text(docs, text, make, list(map(T.StructField, RESULT, kinds)), keep_text)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the text, with the columns RESULT; the references are those of ``docs`` itself."""
    return judge(docs, learn(docs, text, lang), text)
