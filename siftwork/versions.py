"""Versions of the rules and of what belongs to them: each names its base and what it changes; SIFTWORK_VERSION, if set,
names the default."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column

from siftwork.functions import rules


@dataclass(frozen=True)
class Version:
    """base: the version whose settings hold where this one is silent (None); senior and fallback: seniority tokens of a
    senior title and of one that says nothing; numeric: whether the numeric scorer goes with it."""

    name: str
    base: str | None = None
    senior: str | None = None
    fallback: str | None = None
    numeric: bool | None = None

    def seniority(self, title: Column) -> Column:
        return rules.seniority(title, self.senior, self.fallback)


#: Fixed values.
VERSIONS: dict[str, Version] = {
    "v12": Version("v12", None, "LEVEL_2", "LEVEL_1", False),
    "v13": Version("v13", "v12", "LEVEL_3", "LEVEL_2"),
    "v13.1": Version("v13.1", "v13"),
}
DEFAULT = "v13.1"


def resolved(name: str | None = None) -> Version:
    """A version with its bases' settings filled in; the session's default without a name."""
    name = name or os.environ.get("SIFTWORK_VERSION", DEFAULT)
    if name not in VERSIONS:
        raise ValueError(f"unknown version {name}; known: {', '.join(VERSIONS)}")
    own = VERSIONS[name]
    if own.base is None:
        return own
    base = resolved(own.base)
    return replace(own, **{f: getattr(base, f) for f in ("senior", "fallback", "numeric") if getattr(own, f) is None})


#: Classifiers by name: a column of titles to tokens. Others can be added.
CLASSIFIERS: dict[str, Callable[[Column], Column]] = {name: (lambda c, name=name: resolved(name).seniority(c)) for name in VERSIONS}
