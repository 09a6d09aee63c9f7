"""Numbers that describe the writing of a text, for the quality classifier."""

from __future__ import annotations

import zlib

import numpy as np

from tracewell.llm.perplexity import IS_SPACE, Flat, flags, measures

UPPER, LOWER, DIGIT = (flags(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
GROUPS = {"hash_star": b"#*", "dollar_percent": b"$%", "and_bar": b"&|", "angle": b"<>", "bang": b"!", "stop_comma": b".,", "question": b"?", "other_marks": b":;'\"()-/@_=+[]{}\\~^`"}
GROUP_FLAGS = {name: flags(x) for name, x in GROUPS.items()}

NAMES = [
    "log_words", "chars_per_word", "share_signs", "share_dup_lines", "share_repeat_words", "log_lines", "words_per_line",
    "share_upper", "share_lower", "share_digit", "share_high", "share_space", *GROUPS, "distinct_words", "share_short_words",
    "share_long_words", "packed", "sign_ended_words",
]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of NAMES per text; empty texts have zeros. Whole texts count."""
    flat = Flat(texts)
    n_words, word_chars, n_symbols, n_dup, n_repeat = measures(flat)
    size = np.maximum(np.diff(flat.ends, prepend=0), 1)
    words = np.maximum(n_words, 1)
    lines = np.array([x.count(b"\n") + 1 for x in texts])
    raw = flat.bytes
    split = [x.split() for x in texts]
    lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in split]
    columns = [
        np.log1p(n_words),
        word_chars / words,
        n_symbols / size,
        n_dup / lines,
        n_repeat / words,
        np.log1p(lines),
        np.log1p(n_words / lines),
        *(flat.per_text(x[raw]) / size for x in (UPPER, LOWER, DIGIT)),
        flat.per_text(raw >= 0x80) / size,
        flat.per_text(IS_SPACE[raw]) / size,
        *(flat.per_text(x[raw]) / size for x in GROUP_FLAGS.values()),
        np.array([len(set(x)) for x in split]) / words,
        np.array([(x <= 2).sum() for x in lengths]) / words,
        np.array([(x >= 14).sum() for x in lengths]) / words,
        np.array([len(zlib.compress(x, 1)) for x in texts]) / (size + 16),
        np.array([x.count(b"* ") + x.count(b"$ ") + x.count(b"# ") + x.count(b"& ") + x.count(b"% ") + x.count(b"! ") for x in texts]) / words,
    ]
    out = np.column_stack([np.asarray(x, np.float64) for x in columns]) if texts else np.zeros((0, len(NAMES)))
    out[[not x for x in texts]] = 0.0
    return out
