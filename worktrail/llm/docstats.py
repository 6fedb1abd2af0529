"""Statistics of whole documents, computed from the bytes of a column a slice at a time."""

from __future__ import annotations

import numpy as np

from worktrail.llm.words import Words, mix

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What models see. Shares lie between 0 and 1; none depends on language, source or key.
FEATURES = [
    "log_words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "comma_share", "digit_share",
    "wide_share", "distinct_share", "top_word_share", "echo_share", "log_lines", "words_per_line",
]


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _byte_set(b"#*$%&|<>")
_UPPER = _byte_set(bytes(range(65, 91)))
_BANG = _byte_set(b"!?")
_COMMA = _byte_set(b",.;:")
_DIGIT = _byte_set(b"0123456789")
_LEADING = _byte_set(bytes(x for x in range(256) if x & 0xC0 != 0x80 and x not in b" \t\n\v\f\r"))
_WIDE = _byte_set(bytes(range(0xC0, 256)))
_NEWLINE = _byte_set(b"\n")
_BLANK = b" \t\x0b\x0c\r"


def _per_text(words: Words, kind: np.ndarray) -> np.ndarray:
    """Bytes of a kind in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(kind[words.data]), words.offsets))


def _runs(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of a text: (order, first place of each run in it, run of each place)."""
    tied = mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tied, kind="stable")
    tied = tied[order]
    new = np.ones(len(tied), dtype=bool)
    new[1:] = tied[1:] != tied[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _repeated_lines(words: Words) -> np.ndarray:
    out = np.zeros(words.texts, dtype=np.int64)
    raw = words.data.tobytes()
    for at in range(words.texts):
        lines = [x for x in raw[words.offsets[at] : words.offsets[at + 1]].split(b"\n") if x.strip(_BLANK)]
        out[at] = len(lines) - len(set(lines))
    return out


def counts_and_features(words: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """COUNTS as integers, and FEATURES as a matrix of one row per text.

    Texts without words have zero counts and zero features; windows never cross texts.
    """
    n, owner, hashes = words.counts, words.owner(), words.hashes()
    texts = words.texts
    repeat = np.zeros(len(hashes), dtype=bool)
    at = words.windows(3)
    if len(at):
        grams = mix(mix(hashes[at] * np.uint64(3) + hashes[at + 1]) * np.uint64(5) + hashes[at + 2])
        order, begin, run = _runs(owner[at], grams)
        size = np.diff(np.append(begin, len(order)))
        again = at[order[size[run] > 1]]
        for k in range(3):
            repeat[again + k] = True
    order, begin, _ = _runs(owner, hashes)
    size = np.diff(np.append(begin, len(order)))
    of_run = owner[order[begin]]
    distinct = np.bincount(of_run, minlength=texts)
    top = np.zeros(texts, dtype=np.int64)
    np.maximum.at(top, of_run, size)
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    counts = {
        "n_words": n,
        "word_chars": _per_text(words, _LEADING),
        "n_symbols": _per_text(words, _SYMBOL),
        "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": np.bincount(owner[repeat], minlength=texts),
    }
    some, chars = np.maximum(n, 1), np.maximum(counts["word_chars"], 1)
    lines = _per_text(words, _NEWLINE) + 1
    columns = [
        np.log1p(n),
        np.minimum(counts["word_chars"] / some, 50.0),
        counts["n_symbols"] / chars,
        counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / some,
        _per_text(words, _UPPER) / chars,
        _per_text(words, _BANG) / chars,
        _per_text(words, _COMMA) / chars,
        _per_text(words, _DIGIT) / chars,
        _per_text(words, _WIDE) / chars,
        distinct / some,
        top / some,
        np.bincount(owner[echo], minlength=texts) / some,
        np.log1p(lines),
        np.log1p(n / lines),
    ]
    matrix = np.stack(columns, axis=1)
    matrix[n == 0] = 0.0
    return counts, matrix
