"""Contracts for JSON documents as expressions over variants: one message, ``path: what``, for everything that breaks them.

Checks are put together like the documents they describe. A plain value gives one message or null, an object or a list the array of its members' messages;
members of lists and maps are named by their place or key. What is missing, or of another kind, gives one message and none for what it should hold.

A document is read once, as structs, maps and lists of the parts that its checks look at: a way from the root to each part would decode the names of all members that
it passes, for each part anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import once

ROOT = "(root)"


@dataclass(frozen=True)
class At:
    """A place in a document: where it stands inside a variant column, its name (a string, or a column inside lists and maps), and what was read there for its check."""

    base: Column
    inner: str = "$"
    name: str | Column = ""
    held: Column | None = None

    def get(self, kind: str) -> Column:
        return self.base if (self.inner, kind) == ("$", "variant") else F.try_variant_get(self.base, self.inner, kind)

    @property
    def kind(self) -> Column:
        """The type of what stands here, VOID for JSON's null; null where nothing does."""
        return F.schema_of_variant(self.get("variant"))

    def under(self, name: str | Column) -> str | Column:
        if isinstance(self.name, str) and isinstance(name, str):
            return f"{self.name}.{name}" if self.name else name
        start = F.lit(f"{self.name}." if self.name else "") if isinstance(self.name, str) else F.concat(self.name, F.lit("."))
        return F.concat(start, F.lit(name) if isinstance(name, str) else name)

    def field(self, name: str, held: Column | None = None) -> At:
        return At(self.base, f"{self.inner}['{name}']", self.under(name), held)

    def says(self, *what: str | Column) -> Column:
        start = F.lit(f"{self.name or ROOT}: ") if isinstance(self.name, str) else F.concat(self.name, F.lit(": "))
        return F.concat(start, *[F.lit(w) if isinstance(w, str) else w for w in what])


@dataclass(frozen=True)
class Check:
    """find: the message at a place (null: none), or with ``many`` the array of messages, nulls among them. kind: the type that it reads there, or ``parts``: what it reads instead."""

    find: Callable[[At], Column]
    many: bool = False
    kind: str = "variant"
    parts: Callable[[At], Column] | None = None

    def read(self, at: At, use: Callable[[Column], Column]) -> Column:
        """``use`` of what is read at a place."""
        return use(at.held) if at.held is not None else once(self.reading(at), use)

    def reading(self, at: At) -> Column:
        return self.parts(at) if self.parts else at.get(self.kind)

    def member(self, raw: Column, held: Column, name: Column) -> At:
        """The place of a member that was read with its list or map; ``raw`` is worked out only for one of another kind."""
        return At(held, name=name) if self.kind == "variant" else At(raw, name=name, held=held)

    def messages(self, at: At) -> Column:
        return self.find(at) if self.many else F.array(self.find(at))


def value(message: str, fits: Callable[[At, Column], Column], optional: bool = False, nullable: bool = False) -> Check:
    """A plain value for which ``fits(place, kind)`` holds."""

    def find(at: At) -> Column:
        kind, void = at.kind, F.is_variant_null(at.get("variant"))
        good = F.when(void, None if nullable else at.says(message)).when(fits(at, kind), None)
        return good.when(kind.isNull(), None if optional else at.says("required")).otherwise(at.says(message))

    return Check(find)


def text(**how) -> Check:
    return value("expected string", lambda at, kind: kind == "STRING", **how)


def flag(**how) -> Check:
    return value("expected boolean", lambda at, kind: kind == "BOOLEAN", **how)


def one_of(values: list[str], **how) -> Check:
    return value("expected one of " + ", ".join(values), lambda at, kind: (kind == "STRING") & at.get("string").isin(values), **how)


def matching(pattern: str, name: str, **how) -> Check:
    return value(f"expected {name}", lambda at, kind: (kind == "STRING") & at.get("string").rlike(pattern), **how)


def number(least: float | None = None, most: float | None = None, whole: bool = False, **how) -> Check:
    limits = [f"{word} {limit:g}" for word, limit in (("from", least), ("to", most)) if limit is not None]

    def good(n: Column) -> Column:
        ok = n == F.floor(n) if whole else n.isNotNull()
        ok = ok & (n >= least) if least is not None else ok
        return ok & (n <= most) if most is not None else ok

    def fits(at: At, kind: Column) -> Column:
        return kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & F.exists(F.array(at.get("double")), good)  # converted once

    return value(" ".join(["expected a whole number" if whole else "expected a number", *limits]), fits, **how)


def anything() -> Check:
    """Whatever stands there, or nothing."""
    return Check(lambda at: F.lit(None).cast("string"))


def _holding(at: At, what: str, optional: bool, nullable: bool, inside: Column, part: Column) -> Column:
    """The messages of an object's or a list's members, or the one about the thing itself. ``part``: not null in such a thing only; spares to spell out its type."""
    kind = at.kind
    none = F.array().cast("array<string>")
    out = F.when(part.isNotNull(), inside).when(kind.isNull(), none if optional else F.array(at.says("required")))
    return (out.when(kind == "VOID", none) if nullable else out).otherwise(F.array(at.says(f"expected {what}")))


def record(fields: dict[str, Check], optional: bool = False, nullable: bool = False) -> Check:
    """An object with these fields; it may have others. No two names may differ in case only."""
    read = ", ".join(f"`{name.replace('`', '``')}`: {own.kind}" for name, own in fields.items())

    def inside(at: At, held: Column) -> Column:
        parts = []
        for many, run in groupby(((own, name) for name, own in fields.items()), lambda x: x[0].many):
            # A plain part was read as a variant of its own; of others, what was read stands beside the place.
            places = [(own, At(held[name], name=at.under(name)) if own.kind == "variant" else at.field(name, held[name])) for own, name in run]
            parts += [own.find(place) for own, place in places] if many else [F.array(*[own.find(place) for own, place in places])]
        return _holding(at, "object", optional, nullable, F.concat(*parts) if len(parts) > 1 else parts[0], held)

    own = Check(lambda at: own.read(at, lambda held: inside(at, held)), many=True, kind=f"struct<{read}>")
    return own


def mapping(member: Check, keys: list[str] | None = None, optional: bool = False, nullable: bool = False) -> Check:
    """An object whose values all fit ``member``, and whose keys are among ``keys``."""

    def inside(at: At, held: Column) -> Column:
        entries = F.map_entries(held)
        raw = at.get("map<string, variant>")
        found = F.flatten(F.transform(entries, lambda e: member.messages(member.member(F.try_element_at(raw, e["key"]), e["value"], at.under(e["key"])))))
        if keys is not None:
            found = F.concat(F.transform(F.filter(entries, lambda e: ~e["key"].isin(keys)), lambda e: at.says("unknown key ", e["key"])), found)
        return _holding(at, "object", optional, nullable, found, held)

    own = Check(lambda at: own.read(at, lambda held: inside(at, held)), many=True, kind=f"map<string, {member.kind}>")
    return own


def listing(member: Check, optional: bool = False, nullable: bool = False) -> Check:
    """A list whose members all fit ``member``."""

    def inside(at: At, held: Column) -> Column:
        raw = at.get("array<variant>")
        found = F.flatten(F.transform(held, lambda x, i: member.messages(member.member(F.get(raw, i), x, at.under(i.cast("string"))))))
        return _holding(at, "array", optional, nullable, found, held)

    own = Check(lambda at: own.read(at, lambda held: inside(at, held)), many=True, kind=f"array<{member.kind}>")
    return own


def variants(by: str, forms: dict[str, Check]) -> Check:
    """An object of one of several forms, told apart by a string field."""

    def parts(at: At) -> Column:
        return F.struct(at.field(by).get("string").alias("by"), *[form.reading(at).alias(f"form_{i}") for i, form in enumerate(forms.values())])

    def inside(at: At, held: Column) -> Column:
        out = F
        for i, (name, form) in enumerate(forms.items()):
            out = out.when(held["by"] == name, form.find(At(at.base, at.inner, at.name, held[f"form_{i}"])))
        out = out.when(F.coalesce(at.kind.startswith("OBJECT"), F.lit(False)), F.array(at.field(by).says("expected one of " + ", ".join(forms))))
        return out.otherwise(F.array(at.says("expected object")))

    own = Check(lambda at: own.read(at, lambda held: inside(at, held)), many=True, parts=parts)
    return own


def checked(lines: DataFrame, value: str, check: Check, document: str, found: str) -> DataFrame:
    """``lines`` with the variant of its JSON column ``value`` and its problems: the messages, joined; null without any.

    What the checks read comes out of a generator, and so do the problems: no later use of either repeats it. Between the two the checks stand outside of lambdas, so that
    they are compiled; only those of members of lists and maps are not.
    """
    v, read, joined = F.col(document), f"{document}read", f"{document}joined"
    rows = lines.withColumn(document, F.try_parse_json(F.col(value)))
    kept = rows.columns
    rows = rows.select(*kept, F.inline(F.array(F.struct(check.reading(At(v)).alias(read)))))
    messages = F.when(v.isNull(), F.array(F.lit(f"{ROOT}: not JSON"))).otherwise(check.messages(At(v, held=F.col(read))))
    rows = rows.select(*kept, F.array_join(messages, "; ").alias(joined))
    return rows.select(*kept, F.inline(F.array(F.struct(F.when(F.col(joined) != "", F.col(joined)).alias(found)))))
