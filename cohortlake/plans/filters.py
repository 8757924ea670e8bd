"""The filter language: text to a tree, and the tree to per-member flags and a condition over them.

A filter is set algebra over the members of each segment, not a predicate on rows, so a leaf
becomes an aggregate (did the member have such a record in the segment?) and AND, OR and NOT
combine the aggregates of one pass.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlake.functions.encoders import hashed

from .config import Dimension, IndexConfig

LONG = 1 << 63


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Always:
    pass


@dataclass(frozen=True)
class OneOf:
    dim: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Between:
    dim: str
    low: int | None
    high: int | None


@dataclass(frozen=True)
class And:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Not:
    inner: Filter


Filter = Always | OneOf | Between | And | Or | Not

_SPACE = re.compile(r"\s*")
_NAME = re.compile(r"\w+")
_BARE = re.compile(r"[^\s,()]+")
_QUOTED = re.compile(r'"([^"]*)"')
_BOUND = re.compile(r"(>=|<=|>|<)\s*(-?[0-9]+)")
_RANGE = re.compile(r"\[\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\]")


class _Text:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, pattern: re.Pattern) -> re.Match | None:
        self.at = _SPACE.match(self.text, self.at).end()
        found = pattern.match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def word(self, keyword: str) -> bool:
        return self.take(re.compile(rf"{keyword}(?!\w)", re.IGNORECASE)) is not None

    def mark(self, sign: str) -> bool:
        return self.take(re.compile(re.escape(sign))) is not None

    def fail(self, what: str) -> FilterError:
        return FilterError(f"{what} at {self.at} in {self.text!r}")

    def chain(self, keyword: str, kind: type, part) -> Filter:
        out = part()
        while self.word(keyword):
            out = kind(out, part())
        return out

    def either(self) -> Filter:
        return self.chain("OR", Or, lambda: self.chain("AND", And, self.negated))

    def negated(self) -> Filter:
        return Not(self.negated()) if self.word("NOT") else self.atom()

    def atom(self) -> Filter:
        if self.mark("("):
            inner = self.either()
            if not self.mark(")"):
                raise self.fail("')' is missing")
            return inner
        name = self.take(_NAME)
        if not name or not self.mark(":"):
            raise self.fail("a dimension and ':' are missing")
        return self.condition(name[0])

    def condition(self, dim: str) -> Filter:
        self.at = _SPACE.match(self.text, self.at).end()
        sign = self.text[self.at : self.at + 1]
        if sign in ("<", ">", "["):
            if found := self.take(_RANGE):
                return Between(dim, self.number(found[1]), self.number(found[2]))
            if found := self.take(_BOUND):
                n = self.number(found[2])
                return {">": Between(dim, n + 1, None), ">=": Between(dim, n, None), "<": Between(dim, None, n - 1), "<=": Between(dim, None, n)}[found[1]]
            raise self.fail("a whole number is missing")
        values = [self.value()]
        while self.mark(","):
            values.append(self.value())
        return OneOf(dim, tuple(values))

    def number(self, text: str) -> int:
        if not -LONG <= int(text) < LONG:
            raise self.fail("a number is out of range")
        return int(text)

    def value(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        if self.text[self.at : self.at + 1] == '"':
            found = self.take(_QUOTED)
            if not found:
                raise self.fail("'\"' is missing")
            return found[1]
        found = self.take(_BARE)
        if not found:
            raise self.fail("a value is missing")
        return found[0]


def parse(text: str | None) -> Filter:
    """The tree of a filter; none or a blank one is everything."""
    if text is None or not text.strip():
        return Always()
    source = _Text(text)
    out = source.either()
    source.take(_SPACE)
    if source.at < len(text):
        raise source.fail("more text than a filter")
    return out


def leaves(tree: Filter) -> Iterator[OneOf | Between]:
    if isinstance(tree, (And, Or)):
        yield from leaves(tree.left)
        yield from leaves(tree.right)
    elif isinstance(tree, Not):
        yield from leaves(tree.inner)
    elif not isinstance(tree, Always):
        yield tree


def ranges(tree: Filter) -> list[str]:
    return [x.dim for x in leaves(tree) if isinstance(x, Between)]


def within(value: Column, low: int | None, high: int | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (value >= F.lit(low))
    if high is not None:
        out = out & (value <= F.lit(high))
    return out & value.isNotNull()


def holds(cfg: IndexConfig, leaf: OneOf | Between, column: Callable[[Dimension], Column] = lambda dim: F.col(f"dim_{dim.name}")) -> Column | None:
    """Whether a record meets a leaf; None if no record can. column is where a dimension's value is."""
    dim = cfg.dimension(leaf.dim)
    if dim is None:
        return None
    value = column(dim)
    if isinstance(leaf, Between):
        if not dim.numeric:
            warnings.warn(f"{leaf.dim} has no order, so a range of it is empty", stacklevel=3)
            return None
        return within(value, leaf.low, leaf.high)
    if dim.hashed:
        return value.isin(*[hashed(F.lit(v), dim.encoding, dim.hashAlgo) for v in leaf.values])
    if not dim.numeric:
        return value.isin(*leaf.values)
    numbers = [int(v) for v in leaf.values if re.fullmatch(r"[+-]?[0-9]{1,19}", v) and -LONG <= int(v) < LONG]
    return value.isin(*numbers) if numbers else None


def open_ended(tree: Filter) -> bool:
    """Whether a member of which no record meets any leaf is found. If not, records that meet no leaf need not be read."""
    if isinstance(tree, Not):
        return not open_ended(tree.inner)
    if isinstance(tree, And):
        return open_ended(tree.left) and open_ended(tree.right)
    if isinstance(tree, Or):
        return open_ended(tree.left) or open_ended(tree.right)
    return isinstance(tree, Always)


@dataclass
class Flags:
    """Aggregates by name, and the condition over them that the tree makes.

    test gives the condition on a row for a leaf (None: no row can meet it), last the aggregate for a member's last value.
    """

    test: Callable[[OneOf | Between], Column | None]
    last: Callable[[str], Column]
    by_last_value: frozenset[str] = frozenset()
    aggregates: dict[str, Column] = field(default_factory=dict)
    tests: list[Column] = field(default_factory=list)
    names: dict[OneOf | Between, str | None] = field(default_factory=dict)

    def condition(self, tree: Filter) -> Column:
        if isinstance(tree, Always):
            return F.lit(True)
        if isinstance(tree, Not):
            return ~self.condition(tree.inner)
        if isinstance(tree, And):
            return self.condition(tree.left) & self.condition(tree.right)
        if isinstance(tree, Or):
            return self.condition(tree.left) | self.condition(tree.right)
        if isinstance(tree, Between) and tree.dim in self.by_last_value:
            name = f"last_{tree.dim}"
            self.aggregates[name] = self.last(tree.dim)
            return F.coalesce(within(F.col(name), tree.low, tree.high), F.lit(False))
        if tree not in self.names:
            test = self.test(tree)
            self.names[tree] = None if test is None else f"leaf_{len(self.aggregates)}"
            if test is not None:
                self.tests.append(test)
                self.aggregates[self.names[tree]] = F.coalesce(F.bool_or(test), F.lit(False))
        return F.lit(False) if self.names[tree] is None else F.col(self.names[tree])

    def met(self) -> Column:
        """Whether a row meets some leaf."""
        return reduce(lambda a, b: a | b, self.tests, F.lit(False))
