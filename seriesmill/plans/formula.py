"""The formula language: ``y ~ p(12) + q(7, 28) + month() + price`` -> FeatureSpec.

A small tokenizer and a recursive reader; nothing is evaluated.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<name>[A-Za-z_.][\w.]*|`[^`]+`)|(?P<op>[()+,:~*^-]))")

#: Terms with a list of windows: name -> (prefix of the column, least window).
ROLLING = {"q": ("ma", 1), "rollsum": ("rollsum", 1), "rollsd": ("rollsd", 1), "rollmin": ("rollmin", 1), "rollmax": ("rollmax", 1), "rollslope": ("rollslope", 2)}
CALENDAR = ("dow", "month", "dom", "eom", "woy", "hod", "moh")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    """One generated column: kind is lag, trend, cal, raw, xlag, xma or a rolling prefix; n its lag, window or degree."""

    kind: str
    column: str
    source: str = ""
    n: int = 0


@dataclass
class FeatureSpec:
    target: str
    terms: list[Term] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [t.column for t in self.terms]

    def of(self, *kinds: str) -> list[Term]:
        return [t for t in self.terms if t.kind in kinds]

    @property
    def rolling(self) -> list[Term]:
        return self.of("ma", "rollsum", "rollsd", "rollmin", "rollmax", "rollslope")

    @property
    def recursive(self) -> bool:
        """Whether a forecast needs earlier forecasts."""
        return bool(self.of("lag") or self.rolling)

    @property
    def exogenous(self) -> list[str]:
        return list(dict.fromkeys(t.source for t in self.of("raw", "xlag", "xma")))

    @property
    def memory(self) -> int:
        """Values of history that a target feature looks at."""
        return max([t.n for t in self.of("lag") + self.rolling], default=0)

    def degenerate(self) -> list[str]:
        """Windows that, with a full run of lags below them, spell out the target itself."""
        lags = {t.n for t in self.of("lag")}
        return [t.column for t in self.of("ma", "rollsum") if t.n > 1 and set(range(1, t.n)) <= lags]


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or not m.group().strip():
                raise FormulaError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, want: str | None = None) -> str:
        kind, value = self.peek()
        if want is not None and value != want and kind != want:
            raise FormulaError(f"expected {want!r}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def numbers(self) -> list[int] | None:
        """The numbers of one argument: 3, 1:4, c(1, 7) or -1; None if there is none."""
        kind, value = self.peek()
        if value == "c":
            self.take()
            self.take("(")
            out: list[int] = []
            while self.peek()[1] != ")":
                out += self.numbers() or []
                if self.peek()[1] == ",":
                    self.take()
            self.take(")")
            return out
        sign = 1
        if value == "-":
            self.take()
            sign = -1
            kind, value = self.peek()
        if kind != "num":
            return None
        low = sign * int(self.take())
        if self.peek()[1] == ":":
            self.take()
            high = int(self.take("num"))
            return list(range(low, high + 1)) if low <= high else list(range(low, high - 1, -1))
        return [low]


def parse(formula: str, columns: Iterable[str] | None = None) -> FeatureSpec:
    """The features a formula asks for; ``columns``, if given, are those of the table, to check names against.

    ``p(k)`` stands for lags 1 to k; ``p(a:b)``, ``p(c(1, 7))`` and ``p(1, 7)`` for
    just those. Repeated terms are joined. The target of ``log(y) ~ ...`` is y.
    """
    known = None if columns is None else set(columns)
    left, tilde, right = formula.partition("~")
    if not tilde or not right.strip():
        raise FormulaError("a formula needs a target and terms: y ~ p(7) + dow()")
    names = [v.strip("`") for kind, v in _Reader(left).tokens if kind == "name"]
    names = [n for n in names if known is None or n in known] or names
    if not names:
        raise FormulaError("no target on the left")
    spec = FeatureSpec(names[0])
    if known is not None and spec.target not in known:
        raise FormulaError(f"target {spec.target!r} is not a column")
    r = _Reader(right)
    found: dict[str, Term] = {}

    def add(kind: str, column: str, source: str = "", n: int = 0) -> None:
        found.setdefault(column, Term(kind, column, source or spec.target, n))

    def series(name: str) -> str:
        if known is not None and name not in known:
            raise FormulaError(f"{name!r} is not a column")
        return name

    while True:
        name = r.take("name").strip("`")
        if r.peek()[1] != "(":
            if name != "1":
                add("raw", series(name), name)
        else:
            r.take("(")
            args: list[list[int]] = []
            variable = None
            if name in ("lag", "ma"):
                variable = series(r.take("name").strip("`"))
                r.take(",")
            while r.peek()[1] != ")":
                got = r.numbers()
                if got is None:
                    raise FormulaError(f"{name}() takes whole numbers, found {r.peek()[1]!r}")
                args.append(got)
                if r.peek()[1] == ",":
                    r.take()
            r.take(")")
            flat = sorted({x for a in args for x in a})
            if name == "p":
                if len(args) == 1 and len(args[0]) == 1 and r.tokens[r.at - 2][0] == "num" and r.tokens[r.at - 3][1] == "(":
                    flat = list(range(1, flat[0] + 1)) if flat[0] >= 1 else flat
                if not flat or flat[0] < 1:
                    raise FormulaError("p() takes lags of 1 or more")
                for n in flat:
                    add("lag", f"{spec.target}_lag_{n}", n=n)
            elif name in ROLLING:
                prefix, least = ROLLING[name]
                if not flat or flat[0] < least:
                    raise FormulaError(f"{name}() takes windows of {least} or more")
                for n in flat:
                    add(prefix, f"{spec.target}_{prefix}_{n}", n=n)
            elif name == "trend":
                for n in flat or [1]:
                    if n < 1:
                        raise FormulaError("trend() takes degrees of 1 or more")
                    add("trend", f"trend{n}", n=n)
            elif name in CALENDAR:
                if flat:
                    raise FormulaError(f"{name}() takes no numbers")
                add("cal", name)
            elif name == "lag":
                if not flat or flat[0] < 0:
                    raise FormulaError("lag() takes lags of 0 or more")
                for n in flat:
                    add("xlag" if n else "raw", f"{variable}_lag_{n}" if n else variable, variable, n)
            elif name == "ma":
                if not flat or flat[0] < 1:
                    raise FormulaError("ma() takes windows of 1 or more")
                for n in flat:
                    add("xma", f"{variable}_ma_{n}", variable, n)
            else:
                raise FormulaError(f"unknown term {name}()")
        if r.peek()[0] == "end":
            break
        if r.peek()[1] != "+":
            raise FormulaError(f"terms are joined by +, found {r.peek()[1]!r}")
        r.take()
    spec.terms = list(found.values())
    if not spec.terms:
        raise FormulaError("no terms on the right")
    if bad := spec.degenerate():
        warnings.warn(f"{', '.join(bad)} and the lags below determine {spec.target} exactly on training rows; the forecast will repeat an old value", stacklevel=2)
    return spec
