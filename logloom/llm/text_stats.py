"""Per-document rule statistics in plain Python and numpy, shared by the quality operators."""

from __future__ import annotations

import numpy as np

from .common import WHITE

#: The characters that the rules count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def word_ids(words: list[bytes]) -> tuple[np.ndarray, int]:
    """The words as small numbers in order of appearance, and how many there are."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, len(known)


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """How many words lie in windows of that many words that occur twice or more; exact."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys, radix = ids[:n], max(distinct, 1)
    size = radix
    for k in range(1, window):
        if size > (2**62) // radix:  # renumber before the mixed radix overflows
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            size = n
        keys, size = keys * radix + ids[k : k + n], size * radix
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def stats(text: str | None) -> dict[str, float]:
    """Counts of one whole text; a null counts as empty."""
    text = text or ""
    words = text.encode().split()
    ids, distinct = word_ids(words)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, WHITE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(ids, distinct),
        "n_lines": len(lines),
        "n_distinct": distinct,
        "top_word": int(np.bincount(ids).max()) if n else 0,
        "n_upper": sum(map(bytes.isupper, words)),
        "n_loud": text.count("!") + text.count("?"),
        "n_stops": text.count(".") + text.count(","),
        "n_digits": sum(map(text.count, "0123456789")),
        "n_long": sum(len(w) > 14 for w in words),
        "n_short": sum(len(w) < 4 for w in words),
    }


FEATURES = ("log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "top_rate", "upper_rate", "loud_rate", "stop_rate", "digit_rate", "long_rate", "short_rate")


#: Rates carry the weight of this many typical words, so that short texts are not odd by chance.
PRIOR_WORDS = 20


def features(s: dict[str, float]) -> list[float]:
    """The statistics as rates, in the order of FEATURES."""
    n = s["n_words"] + PRIOR_WORDS
    return [
        float(np.log1p(s["n_words"])),
        (s["word_chars"] + 5 * PRIOR_WORDS) / n,
        s["n_symbols"] / n,
        s["n_dup_lines"] / (s["n_lines"] + 2),
        s["n_repeat_words"] / n,
        (s["n_distinct"] + PRIOR_WORDS) / n**0.9,  # distinct words grow slower than words
        s["top_word"] / n,
        s["n_upper"] / n,
        s["n_loud"] / n,
        s["n_stops"] / n,
        s["n_digits"] / (s["word_chars"] + 5 * PRIOR_WORDS),
        s["n_long"] / n,
        s["n_short"] / n,
    ]
