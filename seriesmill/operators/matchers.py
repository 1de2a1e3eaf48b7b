"""Label matchers as columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.labelset import get

OPERATORS = ("=", "!=", "=~", "!~")


class NoPositiveMatchers(ValueError):
    """Every matcher also accepts a series without the label: the query would scan everything."""


class BadRegex(ValueError):
    """A pattern that can't be compiled."""


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown matcher {self.op!r}")
        if self.op in ("=~", "!~"):
            try:
                patterns.read(self.value)
            except patterns.PatternError as e:
                raise BadRegex(str(e)) from e

    def accepts(self, value: str) -> bool:
        found = self.value == value if self.op in ("=", "!=") else patterns.read(self.value).accepts(value)
        return found == (self.op in ("=", "=~"))

    @property
    def positive(self) -> bool:
        return not self.accepts("")

    def column(self, labels: Column, metric_name: Column | None = None) -> Column:
        """On the real column of the metric's name where there is one, which a scan can use."""
        value = metric_name if self.name == "__name__" and metric_name is not None else get(labels, self.name)
        match self.op:
            case "=":
                return value == self.value
            case "!=":
                return value != self.value
            case "=~":
                return value.rlike(patterns.whole(self.value))
            case _:
                return ~value.rlike(patterns.whole(self.value))


def all_of(matchers: list[Matcher], labels: Column, metric_name: Column | None = None, need_positive: bool = True) -> Column:
    if need_positive and not any(m.positive for m in matchers):
        raise NoPositiveMatchers("at least one matcher must not accept the empty value")
    return reduce(lambda a, b: a & b, (m.column(labels, metric_name) for m in matchers), F.lit(True))


def query_status(series_count: int, matchers: list[tuple[str, str, str]]) -> str:
    """The status that a selection by (name, op, value) ends with, given how many series it found."""
    try:
        built = [Matcher(*m) for m in matchers]
    except BadRegex:
        return "RegexpError"
    if not any(m.positive for m in built):
        return "NoPositiveMatchers"
    return "Match" if series_count else "NoMatch"
