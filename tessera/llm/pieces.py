"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words (a run of spaces opens a word; no piece holds a space
after another character, so no merge crosses a cut). The distinct words of a
slice become flat numpy arrays of symbols. A round takes, per word, the least
rank among its adjacent pairs, merges the leftmost pair of that rank in every
word at once, and compacts; words without a pair left drop out. A very long
word would need as many rounds as it has symbols, so it is cut where no piece
spans two adjacent characters and merged through a heap of pairs: the same
order of merges, in n log n.

Ids are exactly the library's for a BPE model with byte fallback, the identity
normaliser and a space before the text; other models are refused. The
vocabulary file is a path, read on each executor.

Defined cases: null and empty texts have no ids; repeated rows each give a
row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_slices

SPACE = "▁"
_NONE = np.iinfo(np.int32).max
#: Words of more characters merge through a heap; the ids are the same.
LONG = 512
#: Characters of a text that are encoded at once.
PART_CHARS = 1 << 22


class PieceModel:
    """Merge tables of one model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {}
        normal = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[p] = i
        probe = " a  b "
        if len(self.byte_id) != 256 or sp.decode(sp.encode(probe)) != probe:
            raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space after another character")
        # symbols: pieces by id, then characters that only occur inside pieces
        self.symbol = dict(normal)
        for p in normal:
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.text_of = {i: p for p, i in self.symbol.items()}
        self.size = size
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in normal.items()}
        self.surface.update({i: bytes([b]) for b, i in self.byte_id.items()})
        scores = {p: sp.get_score(i) for p, i in normal.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs, self.bonds = {}, set()
        for p, i in normal.items():
            self.bonds.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a, b)] = (rank[scores[p]], i)
        self.pairs = pairs
        self.width = max(self.symbol.values()) + 1
        self._index(pairs)
        self.lines = "\n" not in self.symbol
        #: a character that is in no piece has a symbol of its own, from ``width`` on
        self.symbol_of_code = np.arange(0x110000, dtype=np.int32) + self.width
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.symbol_of_code[ord(c)] = i
        byte_ids = set(self.byte_id.values())
        self.number = [str(i) for i in range(size)]
        #: text of a piece, None for a byte; control pieces are empty and the unknown one has its surface
        self.plain = [None if i in byte_ids else self.surface[i].decode() if i in self.surface
                      else sp.decode([i]) if sp.is_unknown(i) else "" for i in range(size)]
        # bytes of every piece and the decimal digits of every id, back to back
        self.piece_bytes, self.piece_at = _rows([b if (p := self.plain[i]) is None else p.encode()
                                                 for i, b in ((i, self.surface.get(i)) for i in range(size))])
        self.digits, self.digits_at = _rows([f"{i},".encode() for i in range(size)])

    # -- merges -----------------------------------------------------------
    def _index(self, pairs: dict) -> None:
        """Pair keys in an open-addressing table of at most one eighth full, probed in numpy."""
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        bits = int(np.ceil(np.log2(len(keys) + 1))) + 3
        self.down, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slots = np.full(1 << bits, -1, np.int64)
        self.keys = np.full(1 << bits, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]  # one of those that share a slot stays
            slots[at[left[free]]] = left[free]
            left = left[slots[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask
        self.ranks = np.array([r for r, _ in pairs.values()], np.int32)[slots]
        self.made = np.array([m for _, m in pairs.values()], np.int32)[slots]
        self.ranks[slots < 0], self.made[slots < 0] = _NONE, -1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; no rank if it doesn't merge."""
        key = left.astype(np.int64) * self.width + right
        key[(left >= self.width) | (right >= self.width)] = 0
        at = self._slot(key)
        there = self.keys[at]
        again = np.flatnonzero((there != key) & (there != -1))
        while len(again):
            at[again] = (at[again] + 1) & self.mask
            there = self.keys[at[again]]
            again = again[(there != key[again]) & (there != -1)]
        return self.ranks[at], self.made[at]

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, in word order, and how many each word has."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        names = np.arange(len(words))
        sym = self.symbol_of_code[codes]
        starts = np.cumsum(lens) - lens
        last = np.zeros(len(sym), bool)
        last[starts + lens - 1] = True
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins here
        made = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = self._lookup(sym[inner], sym[inner + 1])
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(names):
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                out = np.repeat(done, lens)
                ended.append((names[done], lens[done], sym[out]))
                keep = ~out
                sym, last, rank, made = sym[keep], last[keep], rank[keep], made[keep]
                lens, names, least = lens[~done], names[~done], least[~done]
                if not len(names):
                    break
                starts = np.cumsum(lens) - lens
            at = np.flatnonzero(rank == np.repeat(least, lens))
            owner = np.searchsorted(starts, at, "right") - 1
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = owner[1:] != owner[:-1]
            at = at[leftmost]  # one per word
            sym[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, last, rank, made = sym[keep], last[keep], rank[keep], made[keep]
            lens = lens - 1
            starts = np.cumsum(lens) - lens
            at = at - np.arange(len(at))  # one symbol fewer per word before
            rank[at], made[at] = _NONE, -1
            right = at[~last[at]]
            rank[right], made[right] = self._lookup(sym[right], sym[right + 1])
            before = at[at > starts] - 1
            rank[before], made[before] = self._lookup(sym[before], sym[before + 1])
        names = np.concatenate([e[0] for e in ended])
        lens = np.concatenate([e[1] for e in ended])
        flat = np.concatenate([e[2] for e in ended])
        order = np.argsort(names)
        begin = (np.cumsum(lens) - lens)[order]
        lens = lens[order]
        return flat[np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(len(flat))], lens

    def _heap(self, segment: str) -> list[int]:
        """The same merges for one long segment, by a heap of (rank, place)."""
        sym = self.symbol_of_code[[ord(c) for c in segment]].tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and (p := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(heap, (p[0], i, sym[i], sym[j], p[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [s for s in sym if s >= 0]

    # -- words ------------------------------------------------------------
    def _cut(self, word: str) -> list[str]:
        """A word cut where no piece spans the two characters."""
        if not word:
            return []
        out, at = [], 0
        for k, bond in enumerate(zip(word, word[1:]), 1):
            if bond not in self.bonds:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in word order, and how many each word has."""
        long = [k for k, w in enumerate(words) if len(w) > LONG or not w]
        if long:
            some = [w for w in words if 0 < len(w) <= LONG]
            flat, lens = self.merge_rounds(some) if some else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            parts, at, cut = [], 0, np.concatenate([[0], np.cumsum(lens)])
            for n, k in enumerate(long):
                upto = k - n  # short words before it
                parts += [flat[cut[at]:cut[upto]], np.array(
                    [i for part in self._cut(words[k]) for i in self._heap(part)], np.int32)]
                at = upto
            flat = np.concatenate([*parts, flat[cut[at]:]])
            lens = np.insert(lens, np.array(long) - np.arange(len(long)), [len(p) for p in parts[1::2]])
        else:
            flat, lens = self.merge_rounds(words)
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):  # symbols that are no piece: their bytes
            own = [self._bytes_of(i) for i in flat[odd].tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = [len(o) for o in own]
            word = np.repeat(np.arange(len(lens)), lens)
            lens = np.bincount(word, times, len(lens)).astype(np.int64)
            start = (np.cumsum(times) - times)[odd]
            flat = np.repeat(flat, times)
            flat[_ranges(start, times[odd])] = [i for o in own for i in o]
        return flat, lens

    def _bytes_of(self, symbol: int) -> tuple[int, ...]:
        char = chr(symbol - self.width) if symbol >= self.width else self.text_of[symbol]
        return tuple(self.byte_id[b] for b in char.encode("utf-8", "surrogatepass"))

    _OPEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words_of(self, text: str) -> list[str]:
        """Words of a text, the spaces before them included. Joined they are the text after one space.

        A line end is in no piece, so it is a word of its own.
        """
        if not text:
            return []
        out: list[str] = []
        for k, line in enumerate(text.replace(SPACE, " ").split("\n") if self.lines else [text.replace(SPACE, " ")]):
            if k:
                out.append("\n")
            else:
                line = " " + line
            if "  " in line or line[-1:] == " ":
                out += self._OPEN.findall(line.replace(" ", SPACE))
            elif line:
                words = line.replace(" ", " " + SPACE).split(" ")
                out += words if words[0] else words[1:]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].tolist()

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts, and how many each text has. A byte that no UTF-8 text holds parts them."""
        texts = texts.cast(pa.large_string())
        opened = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x
                                               for x in (" ", texts, "")))
        plain = pc.and_(pc.invert(pc.or_(pc.match_substring(opened, "  "), pc.match_substring(texts, SPACE))),
                        pc.greater(pc.binary_length(texts), 0))
        fast = opened.filter(plain).cast(pa.large_binary())
        if self.lines:
            fast = pc.replace_substring(fast, b"\n", b"\xff\n\xff")
        fast = pc.split_pattern(pc.replace_substring(fast, b" ", b"\xff" + SPACE.encode()), b"\xff")
        counts = np.zeros(len(texts), np.int64)
        simple = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        counts[simple] = pc.list_value_length(fast).to_numpy(zero_copy_only=False)
        rest = np.setdiff1d(np.arange(len(texts)), simple)
        if not len(rest):
            return fast.flatten(), counts
        # runs of spaces: cut in Python
        slow = [[w.encode() for w in self.words_of(texts[k].as_py())] for k in rest.tolist()]
        counts[rest] = [len(w) for w in slow]
        every = pa.concat_arrays([fast.flatten(), pa.array([w for ws in slow for w in ws], pa.large_binary())])
        begin = np.zeros(len(texts), np.int64)
        order = np.concatenate([simple, rest])
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return every.take(pa.array(_ranges(begin, counts))), counts

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. A very long text goes in parts, so that memory stays bounded."""
        if not (pc.max(pc.utf8_length(texts)).as_py() or 0) > PART_CHARS:
            return self._encode(texts)
        out = []
        for text in texts.to_pylist():
            parts = [self._encode(pa.array([p], pa.large_string()))[0] for p in parts_of(text)]
            out.append(np.concatenate(parts))
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; every distinct word is encoded once."""
        words, counts = self._words(texts)
        coded = words.dictionary_encode()
        flat, lens = self.encode_words([w.decode() for w in coded.dictionary.to_pylist()])
        code = coded.indices.to_numpy(zero_copy_only=False)
        begin = np.cumsum(lens) - lens
        ids = flat[_ranges(begin[code], lens[code])]
        ends = np.concatenate([[0], np.cumsum(lens[code])])
        cut = np.concatenate([[0], np.cumsum(counts)])
        return [ids[ends[a]:ends[b]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def digits_of(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return _gather(self.digits, self.digits_at, ids)[:-1]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """``decode`` for ids of ``encode``, whose byte pieces are whole characters."""
        raw = _gather(self.piece_bytes, self.piece_at, ids)
        return raw[1:] if raw[:1] == b" " else raw

    def join(self, ids: list[int]) -> str:
        """Pieces joined; byte pieces read as UTF-8 (a bad byte is U+FFFD)."""
        parts = [self.plain[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        out, run = [], bytearray()
        for i, part in zip(ids, parts):
            if part is None:
                run += self.surface[i]
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(part)
        return "".join([*out, _utf8(run)])

    def decode(self, ids: list[int]) -> str:
        """``join`` without the space before the text."""
        text = self.join(ids)
        return text[1:] if ids and self.surface.get(ids[0], b"")[:1] == b" " and self.plain[ids[0]] is not None else text


def parts_of(text: str) -> list[str]:
    """A text cut at single spaces, which go: the space before a text stands for each."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        k = text.find(" ", at + PART_CHARS)
        while k >= 0 and (text[k - 1] in (" ", SPACE) or text[k + 1:k + 2] in ("", " ", SPACE)):
            k = text.find(" ", k + 1)
        if k < 0:
            break
        out.append(text[at:k])
        at = k + 1
    return [*out, text[at:]]


def _rows(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])])


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] places, then the same for the next."""
    total = np.cumsum(count)
    return np.repeat(begin - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def _gather(data: np.ndarray, at: np.ndarray, rows: np.ndarray, step: int = 1 << 19) -> bytes:
    """The rows' bytes back to back, made in bounded steps."""
    return b"".join(data[_ranges(at[r], at[r + 1] - at[r])].tobytes()
                    for r in (rows[k:k + step] for k in range(0, len(rows), step)))


def _utf8(raw: bytearray) -> str:
    """UTF-8 text; every byte that is not part of a character is one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join("�" * (len(c.encode("utf-8", "surrogateescape"))) if "\udc80" <= c <= "\udcff" else c
                       for c in raw.decode("utf-8", "surrogateescape"))


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_output: bool = False) -> DataFrame:
    """One row per document row: number and digest of its ids, digest of the decoded text.

    ``with_output`` adds the ids and the decoded text themselves.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(model_path)
        ids = m.encode_texts(pc.fill_null(batch.column(1), ""))
        decoded = [m.decode_bytes(i) for i in ids]
        sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
        columns = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), sha(map(m.digits_of, ids)), sha(decoded)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_output:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_slices(docs, kernel, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                      + (", ids array<int>, decoded string" if with_output else ""))
