"""Normalisation and comparison of declared and observed values, as native Column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_ACCENTED = [(chr(c), base) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)]
ACCENTED, PLAIN = ("".join(x) for x in zip(*_ACCENTED))
SPACES = r"[\s\x{A0}]+"
CHUNK = 32


def words_in(values: list[str]) -> Column:
    """A constant array, folded into one literal when the plan is optimised; it is quicker to build than a literal for each value."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used and in whatever lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def offsets(parts: Column, gap: int = 0) -> Column:
    """Where each of an array's texts begins if they follow each other, ``gap`` characters apart.

    Sums are made in chunks: one growing array would be copied for each part. They are made of four parts at a time, as steps of a fold cost more than additions.
    """

    def chunk(lengths: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("at"))
        return F.aggregate(lengths, start, lambda s, n: F.struct((s["total"] + n).alias("total"), F.concat(s["at"], F.array(s["total"])).alias("at")))

    def joined_up(chunks: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<array<int>>").alias("at"))
        shifted = lambda s, c: F.array(F.transform(c["at"], lambda v: v + s["total"]))
        return F.aggregate(chunks, start, lambda s, c: F.struct((s["total"] + c["total"]).alias("total"), F.concat(s["at"], shifted(s, c)).alias("at")), lambda s: F.flatten(s["at"]))

    def placed(lengths: Column) -> Column:
        last = F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / CHUNK).cast("int")
        return joined_up(F.transform(F.sequence(F.lit(0), last), lambda k: chunk(F.slice(lengths, k * CHUNK + 1, CHUNK))))

    def by_fours(lengths: Column) -> Column:
        # Three zeros stand after the lengths, so that the last four are whole.
        groups = F.sequence(F.lit(0), F.greatest(F.floor(F.size(lengths) / 4).cast("int") - 1, F.lit(0)))
        four = lambda k: [F.get(lengths, k * 4 + i) for i in range(4)]
        begins = lambda at, k: F.array(*accumulate([at, *four(k)[:3]]))
        return F.slice(F.flatten(F.transform(once(F.transform(groups, lambda k: reduce(add, four(k))), placed), begins)), 1, F.size(lengths) - 3)

    return once(F.concat(F.transform(parts, lambda p: F.length(p) + gap), F.array(*[F.lit(0)] * 3)), by_fours)


def placed(parts: Column, gap: int = 0) -> Column:
    """An array's texts with their ``offsets``: text, start."""
    zipped = lambda own, at: F.transform(own, lambda p, i: F.struct(p.alias("text"), F.get(at, i).alias("start")))
    return once(parts, lambda own: once(offsets(own, gap), lambda at: zipped(own, at)))


def whitespace(v: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(v, SPACES, " "))


def strip_diacritics(v: Column) -> Column:
    return F.regexp_replace(F.translate(v, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def exact(v: Column) -> Column:
    """Lower case, without diacritics and corporate suffixes; null becomes ''."""
    return whitespace(F.regexp_replace(strip_diacritics(F.lower(F.coalesce(v, F.lit("")))), K.CORPORATE_SUFFIX, ""))


def expand_states(v: Column) -> Column:
    """State names as codes, replaced in list order (so "west virginia" becomes "west va")."""
    states = F.from_json(F.lit(json.dumps([{"name": n, "code": c} for n, c in K.STATES.items()])), "array<struct<name: string, code: string>>")
    word = lambda s: F.concat(F.lit(r"\b"), s["name"], F.lit(r"\b"))
    # The plain search keeps the regular expression to texts that hold the name.
    return F.aggregate(states, v, lambda out, s: F.when(F.contains(out, s["name"]), F.regexp_replace(out, word(s), s["code"])).otherwise(out))


def producer_tokens(v: Column) -> Column:
    plain = F.regexp_replace(expand_states(strip_diacritics(F.lower(F.coalesce(v, F.lit(""))))), r"[^a-z0-9\s]", " ")
    drop = ["", *K.NOISE_TOKENS, *K.PROCESS_TOKENS, *K.CORPORATE_TOKENS]
    return F.array_except(F.array_distinct(F.split(plain, r"\s+")), words_in(drop))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def implies_domestic(v: Column) -> Column:
    state = F.arrays_overlap(producer_tokens(v), words_in(K.STATE_CODES))
    return F.coalesce((v != "") & ~v.rlike(r"(?i)^\s*imported\s+by\b") & state, F.lit(False))


def country(v: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(exact(v), r"^(?:product|produce|made)\s+of\s+", ""), r"^country\s+of\s+origin\s+", "")
    plain = F.trim(plain)
    return F.when(plain.isin(K.USA_NAMES), "usa").otherwise(plain)


def no_declaration(v: Column) -> Column:
    return exact(v).isin(K.NO_DECLARATION)


def lexicon_text(v: Column) -> Column:
    plain = F.regexp_replace(F.lower(strip_diacritics(F.coalesce(v, F.lit("")))), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "['’]", ""), "[^a-z0-9]+", " "))


def type_only(v: Column) -> Column:
    return lexicon_text(v).rlike("|".join(f"(?:{p})" for p in K.WINE_STYLES))


def lexicon_keys(entries: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(key, canonical name), longest key first; equally long ones in the order of the list."""

    def key(name: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower().replace("&", " and ")
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain.replace("'", "").replace("’", "")).split())

    found = [(key(name), canonical) for canonical, others in entries.items() for name in (canonical, *others)]
    return sorted(found, key=lambda x: -len(x[0]))


def no_places() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<at: int, size: int, name: string, key: string>>")


def greedy(placed: Column) -> Column:
    """Of places (at, size, name, key) in order of preference those that neither overlap a chosen one nor repeat its name."""

    def take(held: Column, e: Column) -> Column:
        clash = F.exists(held, lambda h: ((e["at"] < h["at"] + h["size"]) & (e["at"] + e["size"] > h["at"])) | (h["name"] == e["name"]))
        return F.when(clash, held).otherwise(F.concat(held, F.array(e)))

    return F.aggregate(placed, no_places(), take)


def lexicon_found(v: Column, entries: dict[str, list[str]]) -> Column:
    """What a text names of a lexicon, as an array of at, size, name (the canonical one) and key (as it stands in ``lexicon_text``): longest key first, only a key's first place, no overlap, each name once."""
    keys = F.from_json(F.lit(json.dumps([{"key": f" {k} ", "name": c} for k, c in lexicon_keys(entries)])), "array<struct<key: string, name: string>>")
    any_key = " (?:" + "|".join(sorted({k for k, _ in lexicon_keys(entries)}, reverse=True)) + ") "
    def found(t: Column) -> Column:
        held = F.filter(keys, lambda e: F.contains(t, e["key"]))
        placed = F.transform(held, lambda e: F.struct(F.instr(t, e["key"]).alias("at"), (F.length(e["key"]) - 2).alias("size"), e["name"].alias("name"), F.trim(e["key"]).alias("key")))
        return F.when(t.rlike(any_key), greedy(placed)).otherwise(no_places())

    return once(F.concat(F.lit(" "), lexicon_text(v), F.lit(" ")), found)


def lexicon_matches(v: Column, entries: dict[str, list[str]]) -> Column:
    """Canonical names found in a text, by the greedy choice of ``lexicon_found``."""
    return F.transform(lexicon_found(v, entries), lambda e: e["name"])


def varietal(v: Column) -> Column:
    """Canonical grape names, joined; null without any."""
    return F.nullif(F.array_join(lexicon_matches(v, K.VARIETALS), ", "), F.lit(""))


def appellation(v: Column) -> Column:
    """The canonical appellation with the longest key; null without any."""
    return F.get(lexicon_matches(v, K.APPELLATIONS), F.lit(0))


def varietal_claim(v: Column) -> Column:
    return F.when(~no_declaration(v) & ~type_only(v), varietal(v))


def appellation_claim(v: Column) -> Column:
    """The canonical appellation, else the text itself; null where nothing or only a style is declared."""
    return F.when(~no_declaration(v), F.coalesce(appellation(v), F.when(~type_only(v), F.nullif(F.trim(v), F.lit("")))))


def family(v: Column) -> Column:
    """The one product family that a text names, else null."""

    def named(plain: Column) -> Column:
        hits = [plain.rlike(K.WINE_WORDS) | type_only(v) | varietal(v).isNotNull(), plain.rlike(K.MALT_WORDS), plain.rlike(K.SPIRIT_WORDS)]
        found = F.array_compact(F.array(*[F.when(h, name) for h, name in zip(hits, K.FAMILIES)]))
        return once(found, lambda f: F.when(F.size(f) == 1, f[0]))

    return once(exact(v), named)


def class_families() -> Column:
    """The class families as a constant: members, and the words of the members."""
    rows = [{"members": f, "words": sorted({w for m in f for w in m.split()})} for f in K.CLASS_FAMILIES]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<members: array<string>, words: array<string>>>")


def alias_equivalent(a: Column, b: Column) -> Column:
    return F.exists(class_families(), lambda f: F.array_contains(f["members"], a) & F.array_contains(f["members"], b))


def class_tokens(v: Column) -> Column:
    """Tokens of a class name and all words of the families that have such a token as a member."""

    def expanded(own: Column) -> Column:
        near = F.filter(class_families(), lambda f: F.arrays_overlap(own, f["members"]))
        return F.array_distinct(F.concat(own, F.flatten(F.transform(near, lambda f: f["words"]))))

    return once(F.array_except(F.array_distinct(F.split(v, r"\s+")), words_in([""])), expanded)


def token_containment(a: Column, b: Column) -> Column:
    return once(class_tokens(a), lambda x: once(class_tokens(b), lambda y: (F.size(x) > 0) & (F.size(y) > 0) & (subset(x, y) | subset(y, x))))


def producer_match(form: Column, label: Column) -> Column:
    """One side's tokens lie within the other's, or a line of the form within the label, or they overlap enough."""

    def compared(a: Column, b: Column) -> Column:
        line = F.exists(F.split(form, "\n+"), lambda x: once(producer_tokens(x), lambda t: (F.size(t) >= 2) & subset(t, b)))
        return ((F.size(a) >= 2) & subset(a, b)) | ((F.size(b) >= 2) & subset(b, a)) | (jaccard(a, b) >= K.PRODUCER_THRESHOLD) | line

    return once(producer_tokens(form), lambda a: once(producer_tokens(label), lambda b: compared(a, b)))


def country_match(form: Column, label: Column) -> Column:
    return once(country(form), lambda a: once(country(label), lambda b: F.when(a == "imported", (b != "usa") & (b != "")).otherwise(a == b)))


def class_type_match(form: Column, label: Column, label_family: Column | None = None) -> Column:
    """Equal; or, where the form names a family as such, the label is of it; or aliases or contained tokens."""
    of_label = family(label) if label_family is None else label_family
    other = lambda a, b: alias_equivalent(a, b) | token_containment(a, b)
    compare = lambda a, b: F.when(a == b, True).when(a.isin([f.lower() for f in K.FAMILIES]), F.coalesce(of_label == F.upper(a), F.lit(False))).otherwise(other(a, b))
    return once(exact(form), lambda a: once(exact(label), lambda b: compare(a, b)))


def content_tokens(v: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), r"[^a-z\s]", " ")
    return F.filter(F.array_distinct(F.split(plain, r"\s+")), lambda t: F.length(t) >= 3)


def anchor_coverage(v: Column, anchors: list[str]) -> Column:
    return F.size(F.array_intersect(content_tokens(v), words_in(anchors))) / F.lit(len(anchors))


def comparison_text(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), "[^a-z0-9]+", " "))


def eval_text(v: Column) -> Column:
    return F.lower(whitespace(v))


def parity_text(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), "[^a-z0-9.%/ ]+", ""), " +", " "))


def presence_match(a: Column, b: Column) -> Column:
    """Both empty, or a token of three or more characters of one side that contains or is part of one of the other."""
    long = lambda v: F.filter(F.split(v, " "), lambda t: F.length(t) >= 3)

    def compared(x: Column, y: Column, p: Column, q: Column) -> Column:
        found = F.exists(p, lambda t: F.exists(q, lambda u: F.contains(t, u) | F.contains(u, t)))
        return F.when((x == "") | (y == "") | (F.size(p) == 0) | (F.size(q) == 0), x == y).otherwise(found)

    return once(parity_text(a), lambda x: once(parity_text(b), lambda y: once(long(x), lambda p: once(long(y), lambda q: compared(x, y, p, q)))))


def scrub(v: Column) -> Column:
    return reduce(lambda out, p: F.regexp_replace(out, p, K.REDACTED.replace("$", r"\$")), K.SECRETS, v)


def error_category(v: Column) -> Column:
    out = None
    for name, pattern in K.ERROR_CATEGORIES:
        out = F.when(v.rlike(pattern), name) if out is None else out.when(v.rlike(pattern), name)
    return out.otherwise("other")


def joined(*parts: Column) -> Column:
    """Non-empty parts joined by a comma; null without any."""
    return F.nullif(F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))
