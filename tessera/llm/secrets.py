"""Secret scan: fixed patterns, and password guess cost in credential contexts.

Base kinds are regular expressions over the whole text, leftmost and
non-overlapping per kind, with matches under a least length dropped.

``guess_bits`` adds what patterns of fixed shape miss: a value that stands in a
credential context (``password is ...``, ``pwd: ...``) is cut by dynamic
programming into words, dates, repeats, keyboard walks and brute-force
characters so that the sum of log2 guesses is least. A value whose cheapest
segmentation still costs ``min_bits`` is a secret (kind ``guess``), unless a base
span holds all of it. A value that goes on behind a base span is one secret to its
end, whatever its cost; base spans stay as they are. A value that is one word of
letters may be prose (``the password: something about ...``): it must also cost
``WORD_BITS`` (``IS_BITS`` after ``is``) by the corpus's own letter pairs, which ``letter_costs`` counts over
all documents (27 x 27 numbers), so words that read like the corpus pass up to
some 15 letters and a random or joined word doesn't. Values are taken whole,
whatever their length (in quotes to the closing one); each step of the program
looks at spans of bounded length only, so it is linear.

Spans are code points, end exclusive. Defined cases: null and empty texts have
no spans; repeated rows each give a row; an empty table gives no rows; extra
columns are kept by ``redact`` and not read otherwise, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, map_slices, slices, str_texts

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a whole run or nothing, so the same as dropping short runs
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|"""  # whatever stands before: dbPassword
    r"""credentials?)["']?\s{0,3}([:=]>?|=>|is\b)\s{0,3}(["'`]?)([^\s"'`<>]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("pass", "pwd", "secret", "token", "key", "credential")
MIN_BITS = 36.0
WORD_BITS, IS_BITS = 60.0, 80.0  # of a value that is one word of letters; of one after ``is``

# Common password words, most guessed first.
WORDS = (
    "password 123456 qwerty admin welcome login letmein monkey dragon master secret test user guest root "
    "changeme default pass hello love summer winter spring autumn iloveyou princess sunshine shadow football "
    "baseball superman batman trustno access server system oracle mysql postgres manager office company "
    "super computer internet service data database backup public private example sample demo temp temporary "
    "token apikey key none null true false value string your my the and for this that with from here "
    "january february march april may june july august september october november december monday friday "
    "michael jennifer jordan thomas daniel robert charlie andrew jessica ashley nicole hunter killer soccer "
    "hockey ranger buster tigger cookie pepper ginger banana orange purple yellow silver golden diamond "
    "flower freedom whatever matrix phoenix mustang maverick mercedes corvette ferrari porsche yamaha"
).split()
_RANK = {w: math.log2(i + 2) for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                   r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_DATE_BITS = math.log2(365 * 120)
_SWITCH = 1.0  # to name the kind of a segment


def _char_bits(c: str) -> float:
    if c.isascii():
        if c.isdigit():
            return math.log2(10)
        if c.isalpha():
            return math.log2(26) if c.islower() else math.log2(26) + 0.5
        return math.log2(33)
    return 10.0


def segment(value: str) -> tuple[float, list[tuple[str, str]]]:
    """Least log2 guesses for ``value`` and the (kind, piece) segmentation that has them.

    Pieces end at position j; best[j] is the cheapest way to reach it. Ties keep
    the first piece found, in the order brute, word, date, walk, repeat.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := _DATE.match(low, i)):
            dates.setdefault(m.end(), []).append(i)
    walk = 0  # start of the keyboard walk that ends here

    for j in range(1, n + 1):
        def offer(i: int, bits: float, kind: str) -> None:
            if best[i] + bits < best[j] - 1e-12:
                best[j], back[j] = best[i] + bits, (i, kind)

        offer(j - 1, _char_bits(value[j - 1]) + (0.0 if back[j - 1][1] == "brute" else _SWITCH), "brute")
        for i in range(max(0, j - _LONGEST), j - 1):
            bits = _RANK.get(low[i:j])
            if bits is None and (bits := _RANK.get(plain[i:j])) is not None:
                bits += 2.0  # letters replaced by look-alikes
            if bits is not None:
                offer(i, bits + _SWITCH + (1.0 if value[i:j] != low[i:j] else 0.0), "word")
        for i in dates.get(j, ()):
            offer(i, _DATE_BITS + _SWITCH, "date")
        if j > 1 and (low[j - 2], low[j - 1]) not in _NEXT:
            walk = j - 1
        if j - walk >= 3:
            offer(walk, math.log2(47) + math.log2(j - walk) + 2.0 + _SWITCH, "walk")
        for unit in range(1, min(8, j // 2) + 1):  # a unit seen just before costs its count only
            if low[j - unit:j] == low[j - 2 * unit:j - unit]:
                start = j - unit
                while start >= unit and j - start < 64 * unit and low[start - unit:start] == low[j - unit:j]:
                    start -= unit
                first = start + unit
                offer(first, math.log2((j - first) // unit + 1) + _SWITCH, "repeat")
    pieces, j = [], n
    while j:
        i, kind = back[j]
        if kind == "brute" and pieces and pieces[-1][0] == "brute":
            pieces[-1] = ("brute", value[i:j] + pieces[-1][1])
        else:
            pieces.append((kind, value[i:j]))
        j = i
    return best[n], pieces[::-1]


def guess_bits(value: str) -> float:
    return segment(value)[0]


def _pairs(raw: np.ndarray) -> np.ndarray:
    """How often each letter (1-26 for a-z, 0 for all else) follows another."""
    letter = raw | 0x20
    code = np.where((letter >= 97) & (letter <= 122), letter - 96, 0).astype(np.int64)
    return np.bincount(code[:-1] * 27 + code[1:], minlength=27 * 27)


def _pair_bits(count: np.ndarray) -> np.ndarray:
    """The known words' pairs and some in equal shares are added; no letter costs more than log2(52)."""
    known = _pairs(np.frombuffer((" " + " ".join(WORDS) + " ").encode(), np.uint8))
    count = (count + 2 * known).reshape(27, 27).astype(float)
    count[:, 0] = 0
    share = (count + 0.5) / (count + 0.5).sum(1, keepdims=True)
    return -np.log2(0.5 * share + 0.5 / 26)


def letter_costs(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Bits of each letter (1-26 for a-z) after another (0: the begin of a word), counted over all texts."""
    def run(batches):
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += _pairs(np.frombuffer(b" " + b" ".join(byte_texts(part.column(0))) + b" ", np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27)), pa.array(total)], ["pair", "n"])

    texts = documents.select(F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 729 numbers
    count = np.zeros(27 * 27)
    for r in found:
        count[r["pair"]] = r["n"]
    return _pair_bits(count)


_KNOWN_WORDS = _pair_bits(np.zeros(27 * 27))


def letter_bits(word: str, letters: np.ndarray | None = None) -> float:
    """Bits of a word of letters a-z, letter after letter."""
    code = [ord(c) - 96 for c in word.lower()]
    costs = _KNOWN_WORDS if letters is None else letters
    return float(sum(costs[a, b] for a, b in zip([0, *code], code)))


_LETTERS = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*", re.ASCII)


def is_secret(value: str, joint: str, min_bits: float, letters: np.ndarray | None) -> bool:
    if _LETTERS.fullmatch(value) and letter_bits(value, letters) < (IS_BITS if joint.lower() == "is" else WORD_BITS):
        return False
    return guess_bits(value) >= min_bits


def scan(text: str, min_bits: float = MIN_BITS, letters: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret value), sorted: by start, then kind as listed."""
    found, low = [], text.lower()
    named = any(word in low for word in _NAMES)  # a text without any of them has no context to look for
    for m in _ASSIGN.finditer(text) if named else ():
        if m.end(2) - m.start(2) >= 12:
            found.append((m.start(), 0, m.end(), m.start(2)))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            found.append((m.start(), 1, m.end(), m.start()))
    for m in _HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start()))
    base = sorted(found)
    for m in _CONTEXT.finditer(text) if named else ():
        joint, quote, value = m.groups()
        if not (quote and text.startswith(quote, m.end())):
            value = value.rstrip(".,;:!?)]}")
        start, end = m.start(3), m.start(3) + len(value)
        if not value or any(s <= start and end <= e for s, _, e, _ in base):
            continue
        beyond = any(s <= start < e for s, _, e, _ in base)
        if beyond or is_secret(value, joint, min_bits, letters):
            found.append((start, 3, end, start))
    return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def secret_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_bits: float = MIN_BITS, letters: np.ndarray | None = None) -> DataFrame:
    """One row per document row: counts of the base kinds, digest of the base spans, all spans, count of ``guess``.

    ``letters`` are the corpus's ``letter_costs``; without them those of ``WORDS`` are used.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t, min_bits, letters) for t in str_texts(batch.column(1))]
        count = lambda kind: pa.array([sum(s[1] == kind for s in r) for r in rows], pa.int64())
        digest = [hashlib.sha256(_joined([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), count(0), count(1), count(2), pa.array(digest, pa.string()),
             pa.array([_joined(r) for r in rows], pa.string()), count(3)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return map_slices(docs, kernel, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, "
                                    "base_sha256 string, spans string, n_guess long")


def redact_text(text: str, mask: str = "[SECRET]", min_bits: float = MIN_BITS, letters: np.ndarray | None = None) -> str:
    """Every secret value replaced by ``mask``; overlapping values become one."""
    out, at = [], 0
    for value, end in sorted((v, e) for _, _, e, v in scan(text, min_bits, letters)):
        if value >= at:
            out += [text[at:value], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(documents: DataFrame, text_col: str = "text", count_col: str | None = "n_chars",
           mask: str = "[SECRET]", letters: np.ndarray | None = None) -> DataFrame:
    """The documents with secrets masked (and their length column kept true); no row is dropped."""
    field = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, field):
                texts = part.column(field).to_pylist()
                masked = pa.array([t and redact_text(t, mask, letters=letters) for t in texts], part.schema.field(field).type)
                yield part.set_column(field, part.schema.field(field), masked)

    out = documents.mapInArrow(run, documents.schema)
    if count_col in documents.columns:
        kind = documents.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.col(text_col).isNull(), F.col(count_col))
                             .otherwise(F.length(text_col).cast(kind)))
    return out.select(*documents.columns)
