"""Statistics of whole texts, computed for Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textspans import VISIBLE, buffers, groups, mixed, spans, word_hashes

#: Words of the windows whose repetition is counted.
REPEAT_WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_ROUND = np.array([pow(0xD6E8FEB86659FD93, j, 1 << 64) for j in range(REPEAT_WINDOW)], np.uint64)

#: The counts of a text, in the order of ``counts``' columns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_chars", "upper", "lower", "digits", "stops", "commas", "shouts", "echoes", "spaces")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


_FOLD = np.stack(
    [
        VISIBLE & ((np.arange(256) & 0xC0) != 0x80),
        _class(SYMBOLS),
        np.ones(256),
        (np.arange(256) & 0xC0) != 0x80,
        _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _class(b"abcdefghijklmnopqrstuvwxyz"),
        _class(b"0123456789"),
        _class(b"."),
        _class(b","),
        _class(b"!?"),
        ~VISIBLE,
    ],
    axis=1,
).astype(np.float64)


def repeated(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """True for each word that lies in a window found twice or more in its own text."""
    n, w = len(hashes), REPEAT_WINDOW
    if n < w:
        return np.zeros(n, bool)
    doc = np.repeat(np.arange(len(counts)), counts)
    own = np.flatnonzero(doc[w - 1 :] == doc[: n - w + 1])
    if not len(own):
        return np.zeros(n, bool)
    total = hashes[: n - w + 1].copy()
    for j in range(1, w):
        total += hashes[j : n - w + 1 + j] * _ROUND[j]
    keys = mixed(mixed(total) + doc[: n - w + 1].astype(np.uint64))[own]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    edge = np.zeros(n + 1, np.int64)
    if len(twice):
        twice = np.unique(twice)
        hit = own[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        edge[hit] += 1
        edge[hit + w] -= 1
    return np.cumsum(edge[:n]) > 0


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, len(COUNTS)))
    starts, ends, counts = spans(data, offsets, VISIBLE)
    hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), counts)
    histogram = np.zeros((n, 256))
    raw = data.tobytes()
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        histogram[i] = np.bincount(data[a:b], minlength=256)
        lines = raw[a:b].split(b"\n")
        real = [x for x in lines if x.strip()]
        out[i, 3], out[i, 5] = len(real) - len(set(real)), len(lines)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[:, 0] = counts
    out[:, [1, 2, 6, 7, 8, 9, 10, 11, 12, 13, 15]] = histogram @ _FOLD
    out[:, 4] = np.bincount(doc, repeated(hashes, counts), minlength=n)
    out[:, 14] = np.bincount(doc, echo, minlength=n)
    return out


def text_counts(column: pa.Array) -> np.ndarray:
    """A row of ``COUNTS`` for each text of a string column; null counts as empty.

    Words are runs of anything but ASCII white space; ``n_dup_lines`` are lines
    with a word that equal an earlier line; ``n_repeat_words`` are words in
    windows of eight found twice or more in the text, the first included;
    ``echoes`` are words equal to the one before.
    """
    data, offsets = buffers(column)
    parts = [_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in groups(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)))


#: The statistics made of the counts: rates that don't grow with a text, on a log scale.
FEATURES = ("length", "word_length", "symbol_rate", "dup_line_share", "repeat_share", "line_length", "upper_share", "digit_rate", "stop_rate", "comma_rate", "shout_rate", "echo_share")


def features(counts: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row for each text; an empty text is all zeros but for finite values."""
    c = dict(zip(COUNTS, counts.T, strict=True))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    share = lambda x, of: np.log1p(20 * x / np.maximum(of, 1))
    return np.stack(
        [
            np.log1p(c["n_words"]),
            np.log1p(c["word_chars"] / words),
            share(c["n_symbols"], words),
            share(c["n_dup_lines"], c["n_lines"]),
            share(c["n_repeat_words"], words),
            np.log1p(chars / np.maximum(c["n_lines"], 1)),
            share(c["upper"], c["upper"] + c["lower"]),
            share(c["digits"], chars),
            share(c["stops"], words),
            share(c["commas"], words),
            share(c["shouts"], words),
            share(c["echoes"], words),
        ],
        axis=1,
    )


def batches_with_counts(batches: Iterator[pa.RecordBatch], text: int, rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their counts, so that few rows are worked on at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, text_counts(part.column(text))
