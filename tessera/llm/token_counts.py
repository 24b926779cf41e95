"""Token counts per section by offset-mapped attribution.

A whole document is encoded once; encoding its sections one by one would give
other tokens at their edges. Token spans and section spans are both sorted
intervals over the bytes of the text, joined by binary search. A token inside
one section counts there. A token that crosses a boundary counts in the section
that holds most of its bytes, the first of them on a tie: every token counts
once, and the counts of a document add up to its tokens.

Sections are the lines of a text (a line end belongs to the line before it), or
any ascending byte bounds given by ``sections_of``.

Defined cases: a null or empty text has one empty section without tokens;
repeated rows each give their sections; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, slices


class RankEncoder:
    """Byte-level BPE from a file of ranks, with the byte length of every token."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def ends(self, text: bytes) -> np.ndarray:
        """End offset of every token of the whole text."""
        return np.cumsum(self.length[np.array(self.encoding.encode_ordinary(text.decode()), np.int64)])


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """One per worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[(path, pattern)] = RankEncoder(path, pattern)
    return _ENCODERS[(path, pattern)]


def line_bounds(text: bytes) -> np.ndarray:
    """Ascending byte bounds of the lines: 0, the end of each line, the end of the text."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(text)]]))


def attribute(token_ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section [bounds[k], bounds[k + 1])."""
    sections = max(1, len(bounds) - 1)
    if not len(token_ends):
        return np.zeros(sections, np.int64)
    begin = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(bounds, begin, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    home = first.copy()
    for t in np.flatnonzero(last > first).tolist():  # crosses a boundary
        span = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[span + 1], token_ends[t]) - np.maximum(bounds[span], begin[t])
        home[t] = span[int(np.argmax(held))]
    return np.bincount(home, minlength=sections)


def section_tokens(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   sections_of: Callable[[bytes], np.ndarray] = line_bounds) -> DataFrame:
    """One row per section: doc_id, section, start_byte, end_byte, n_chars, n_tokens."""
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                own = encoder(ranks_path, pattern)
                rows, starts, stops, chars, counts, number = [], [], [], [], [], []
                for k, text in enumerate(byte_texts(part.column(1))):
                    bounds = sections_of(text)
                    if len(bounds) < 2:
                        bounds = np.array([0, len(text)])
                    raw = np.frombuffer(text, np.uint8)
                    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    n = len(bounds) - 1
                    rows.append(np.full(n, k))
                    number.append(np.arange(n))
                    starts.append(bounds[:-1])
                    stops.append(bounds[1:])
                    chars.append(upto[bounds[1:]] - upto[bounds[:-1]])
                    counts.append(attribute(own.ends(text), bounds))
                whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(whole(rows)), *map(whole, (number, starts, stops, chars, counts))],
                    ["doc_id", "section", "start_byte", "end_byte", "n_chars", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {id_type}, section long, start_byte long, end_byte long, n_chars long, n_tokens long")
