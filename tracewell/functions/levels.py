"""Log levels: spelling, order and score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level names in rank order (unknown ranks highest) and the
# accepted spellings of each.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal", "unknown")
SPELLINGS = {
    "trace": ("trace",),
    "debug": ("debug", "dbg", "d"),
    "info": ("info", "information", "i"),
    "warn": ("warn", "warning", "w"),
    "error": ("error", "err", "e"),
    "fatal": ("fatal", "critical", "crit", "f"),
}
SCORES = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4, "fatal": 5, "unknown": 2}
ERROR_RANK = LEVELS.index("error")

_EDGE_PUNCTUATION = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"


def rank_of(level: str) -> int:
    """Rank of a level name, for building literals."""
    return LEVELS.index(level)


def _lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a constant map, null where it is missing."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_level(text: Column) -> Column:
    """Level name of any accepted spelling; everything else is ``unknown``."""
    bare = F.regexp_replace(F.lower(text), _EDGE_PUNCTUATION, "")
    names = {spelling: level for level, spellings in SPELLINGS.items() for spelling in spellings}
    return F.coalesce(_lookup(bare, names), F.lit("unknown"))


def level_rank(level: Column) -> Column:
    """Order of severity, ``unknown`` highest; null stays null."""
    return _lookup(level, {name: i for i, name in enumerate(LEVELS)})


def level_of_rank(rank: Column) -> Column:
    """Inverse of :func:`level_rank`."""
    return _lookup(rank, dict(enumerate(LEVELS)))


def level_score(level: Column) -> Column:
    """Second scale, on which ``unknown`` counts like ``info``."""
    return _lookup(level, SCORES)


def level_label(level: Column) -> Column:
    """Display spelling such as ``Error``."""
    return F.initcap(level)


def at_least(level: Column, minimum: str, unknown_passes: bool = True) -> Column:
    """Level at or above ``minimum``; ``unknown`` passes unless told otherwise."""
    names = LEVELS[rank_of(minimum):]
    return level.isin(*[n for n in names if unknown_passes or n != "unknown"])
