"""Mutations and corruptions of lines that keep, or drift from, a format."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fingerprint import MONTHS

#: Which parts of a line mutants differ in (stability is stated for these). A line is read once, from the left, and the first class that fits takes the text.
#: Classes are grouped by how they begin, so that most characters fail three short tests.
VARIABLE = re.compile(
    rf"""(?=\d)(?:
      (?P<stamp>\d{{4}}-\d\d-\d\d(?:T\d\d:\d\d:\d\d)?)(?P<zone>Z|[+-]\d\d:?\d\d)?
      |(?P<address>\d{{1,3}}(?:\.\d{{1,3}}){{3}})
      |(?:(?<==)|(?<=":))(?P<count>\d{{1,5}})\b)
    |\b(?:(?=[A-Z])(?P<month>{MONTHS})(?P<gap>\s+)\d{{1,2}}\s+\d\d:\d\d:\d\d\b
      |(?P<name>[a-z][a-z0-9-]*\d{{1,4}})\b)
    |(?=:)(?<=\d)(?P<port>:\d{{1,5}})\b""",
    re.VERBOSE,
)
PLAIN = re.compile(r"[^\W\d_]+[.,]?")
CONSONANTS, VOWELS = "bdgklmnprstvz", "aeiou"


def below(rng: random.Random, n: int) -> int:
    """A number from 0 to n - 1, in fewer steps than randrange takes."""
    return int(rng.random() * n)


def clock(rng: random.Random) -> str:
    second = below(rng, 86_400)
    return f"{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def stamp(m: re.Match, rng: random.Random) -> str:
    day = f"{2000 + below(rng, 60)}-{1 + below(rng, 12):02d}-{1 + below(rng, 28):02d}"
    return day + (f"T{clock(rng)}" if "T" in m["stamp"] else "") + (m["zone"] or "")


def word(rng: random.Random) -> str:
    return "".join([CONSONANTS[below(rng, len(CONSONANTS))] + VOWELS[below(rng, len(VOWELS))] for _ in range(2 + below(rng, 3))])


#: A new value of each class, of the same token class as the old one.
MAKERS: dict[str, Callable[[re.Match, random.Random], str]] = {
    "stamp": stamp,
    "zone": stamp,
    "gap": lambda m, rng: f"{m['month']}{m['gap']}{1 + below(rng, 28):02d} {clock(rng)}",
    "address": lambda m, rng: "%d.%d.%d.%d" % tuple(rng.randbytes(4)),
    "port": lambda m, rng: f":{below(rng, 65_536)}",
    "count": lambda m, rng: str(below(rng, 100_000)),
    "name": lambda m, rng: f"{word(rng)}-{1 + below(rng, 9_999)}",
}


def other_words(line: str, rng: random.Random) -> str:
    """line with each run of plain words replaced by a run of other words, of one to twice as many."""
    out: list[str] = []
    run = 0
    for token in [*line.split(" "), None]:
        if token and PLAIN.fullmatch(token) and token not in MONTHS.split("|"):
            run += 1
            continue
        out += [word(rng) for _ in range(rng.randint(1, 2 * run))] if run else []
        run = 0
        out += [] if token is None else [token]
    return " ".join(out)


def mutate_text(line: str, seed: int, vary_text: bool = False) -> str:
    """A line of the same shape with other values; vary_text also changes runs of plain words. A line and seed always give the same mutant."""
    rng = random.Random(seed)
    line = VARIABLE.sub(lambda m: MAKERS[m.lastgroup](m, rng), line)
    return other_words(line, rng) if vary_text else line


@F.pandas_udf(StringType())
def mutate_seeded(line: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else mutate_text(x, int(s)) for x, s in zip(line, seed, strict=True)])


def mutate(line: Column, seed: Column) -> Column:
    """Mutant of a line, by a seed and the line itself."""
    return mutate_seeded(line, F.xxhash64(line, seed))


def escalation_span(duration_s: Column, drift_after_s: Column) -> Column:
    """Over how many seconds a drift escalates: what is left of the run when it starts, one at least."""
    return F.greatest(duration_s - drift_after_s, F.lit(1.0))


def drift_phase(since_s: Column, span_s: Column) -> Column:
    """How far a drift that started so long ago has come, 0 to 1."""
    return F.least(F.greatest(since_s / span_s, F.lit(0.0)), F.lit(1.0))


def corrupt_syslog(line: Column, index: Column, phase: Column) -> Column:
    """The share phase of the lines, chosen by index, loses its source: each third by a renamed key, the others by a value that is no address."""
    chosen = F.pmod(index * F.lit(2654435761), F.lit(1000)) / 1000 < phase
    renamed = F.regexp_replace(line, r"^(.*?)\bSRC=", "$1SRCADDR=")
    replaced = F.regexp_replace(line, r"^(.*?)\bSRC=\S*", "$1SRC=uplink-trust-0x4f")
    return F.when(chosen & (F.pmod(index, F.lit(3)) == 0), renamed).when(chosen, replaced).otherwise(line)
