"""Token counts by prefix dynamic programming over a byte-fallback piece vocabulary.

For byte-pair merging, whether the tokens of a prefix end in piece t depends only on t fitting after the last
piece of the shorter prefix. So one pass over the characters stores, for every prefix, its last piece and its
exact token count, without ever encoding the prefix. No piece of the vocabulary has a word mark after another
character, so merges never cross into a new word: the table of a text is the running sum of its words' tables,
and words met before come from a bounded cache.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, sliced, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Words kept in each of the two generations of a worker's table cache. Bounds memory, never results.
CACHE_WORDS = 600_000
#: Longer words are not cached.
CACHE_CHARS = 40
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = f"(?:[^\\w{MARK}\n]|[\\d_])"
_SEGMENTS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: The same, cut further between letters and other characters.
_FINE = re.compile(f"{MARK}*[^\\W\\d_]+|{MARK}+{_OTHER}*|{_OTHER}+|\n")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


# Fixed values of the model file: the fields of its parts, the kind of a byte-pair model and of a user-defined piece.
_PIECE, _TRAINER, _NORMALIZER, _DENORMALIZER = 1, 2, 3, 5
_MODEL_TYPE, _BYTE_PAIRS, _PIECE_TYPE, _USER_DEFINED = 3, 2, 3, 4
_SWITCHES = {35: ("byte_fallback", 0, 1), 24: ("treat_whitespace_as_suffix", 0, 0)}
_NORMAL = {3: ("add_dummy_prefix", 1, 1), 4: ("remove_extra_whitespaces", 1, 0), 5: ("escape_whitespaces", 1, 1)}


def unfit(model: bytes) -> list[str]:
    """What of a serialized model the prefix tables would count wrongly; nothing for a model that they fit."""
    parts: dict[int, list] = {}
    for number, value in _fields(model):
        parts.setdefault(number, []).append(value)
    trainer, normal = (dict(_fields(parts.get(n, [b""])[-1])) for n in (_TRAINER, _NORMALIZER))
    out = [] if trainer.get(_MODEL_TYPE, 1) == _BYTE_PAIRS else ["it is no byte-pair model"]
    out += [f"{name} is {held}" for held_in, rules in ((trainer, _SWITCHES), (normal, _NORMAL)) for number, (name, default, wanted) in rules.items() if (held := held_in.get(number, default)) != wanted]
    if normal.get(2) or normal.get(6):
        out.append("it has a normaliser")
    if any(dict(_fields(p)).get(_PIECE_TYPE) == _USER_DEFINED for p in parts.get(_PIECE, [])):
        out.append("it has user-defined pieces")
    return out


class _Known(dict):
    """Words to their tables: the last pieces' numbers, then the counts, as bytes where a word is short enough to keep.

    Two generations of CACHE_WORDS words: when the newer is full the older goes, and words still in use come along."""

    def __init__(self, tables: PrefixTables):
        super().__init__()
        self.tables, self.older = tables, {}

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            lasts, counts = self.tables.word(word)
            if len(word) > CACHE_CHARS:
                return lasts + counts
            found = array("I", lasts).tobytes() + bytes(counts)  # 4 tokens a character at most
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def counts(self, word: str) -> np.ndarray:
        found, n = self[word], len(word)
        return np.frombuffer(found, np.uint8)[4 * n :] if isinstance(found, bytes) else np.array(found[n:], np.int32)


class PrefixTables:
    """Exact token counts of every prefix of a word, kept for words met before."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if found := unfit(model.serialized_model_proto()):
            raise ValueError(f"prefix tables don't fit this model: {', '.join(found)}")
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has a word mark inside, so words can't be counted apart")
        # A merge can only cross where a piece has those two characters side by side. Letters and other characters (but for
        # the mark) never are, save in pieces with the characters kept here: texts that have one are cut at marks alone.
        beside = {(a, b) for p in self.rank for a, b in zip(p, p[1:]) if MARK not in (a, b)}
        self.mixing = sorted({c for a, b in beside if bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for c in (a, b) if ord(c) > 127})
        self.coarse = any(bool(_LETTER.match(a)) != bool(_LETTER.match(b)) and max(ord(a), ord(b)) < 128 for a, b in beside)
        # Numbers of the pieces from 1; 0 for what only ends some piece. Characters that are no piece get numbers as they come.
        self.names, self.cost = ["", *self.rank], [0, *([1] * len(self.rank))]
        self.number = {p[k:]: 0 for p in self.rank for k in range(len(p))} | {p: i for i, p in enumerate(self.names) if i}
        self.lone: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.known = _Known(self)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its definition: merge the best-scored neighbours, leftmost first, while any merge."""
        parts = list(text)
        while True:
            scored = [(-s, i) for i in range(len(parts) - 1) if (s := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not scored:
                return parts
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def character(self, c: str) -> int:
        """The number of a single character that is no piece: it is spelt in bytes."""
        if c not in self.lone:
            self.lone[c] = len(self.names)
            self.names.append(c)
            self.cost.append(len(c.encode("utf-8", "replace")))
        return self.lone[c]

    def after(self, key: int) -> bool:
        """Whether a piece stays a token of its own right after the token before it (number 0: the start of a word)."""
        if len(self.fits) >= 2 * CACHE_WORDS:
            self.fits.clear()
        last, piece = self.names[key >> 21], self.names[key & 0x1FFFFF]
        ok = self.fits[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return ok

    def word(self, word: str) -> tuple[list[int], list[int]]:
        """(lasts, counts): of the first i + 1 characters of a word the number of the last token, and how many tokens."""
        number, fits, cost, n = self.number.get, self.fits.get, self.cost, len(word)
        lasts, counts = [0], [0]
        known = self.known.get
        for k in range(n - 1, max(n - 5, 0), -1):  # go on from a word met before with a few characters less
            if (found := known(word[:k])) is not None and isinstance(found, bytes):
                lasts += array("I", found[: 4 * k])
                counts += found[4 * k :]
                break
        for i in range(len(counts), n + 1):
            j = i - 1
            starts, pieces = [j], [number(word[j]) or self.character(word[j])]
            while j and (piece := number(word[j - 1 : i])) is not None:
                j -= 1
                if piece:
                    starts.append(j)
                    pieces.append(piece)
            while True:  # the longest piece is tried first; exactly one fits
                j, piece = starts.pop(), pieces.pop()
                key = lasts[j] << 21 | piece
                ok = fits(key)
                if ok or ok is None and self.after(key):
                    break
            counts.append(counts[j] + cost[piece])
            lasts.append(piece)
        return lasts[1:], counts[1:]

    def segments(self, text: str) -> list[str]:
        """Parts of the marked text that no merge crosses."""
        if not text:
            return []
        fine = not self.coarse and not any(c in text for c in self.mixing)
        return (_FINE if fine else _SEGMENTS).findall(MARK + text.replace(" ", MARK))

    def count(self, text: str | None) -> int:
        return sum([t[-1] for t in map(self.known.__getitem__, self.segments(text or ""))])

    def fit(self, text: str, limit: int) -> int:
        """fit_chars() of the text's prefixes, from the one segment in which the limit is passed: any later prefix has more."""
        at, total = -1, 0
        before, part = (at, total), ""
        for segment in self.segments(text):
            if total >= limit:
                break
            before, part = (at, total), segment
            at, total = at + len(segment), total + self.known[segment][-1]
        if total > limit:
            inside = np.nonzero(self.known.counts(part).astype(np.int64) <= limit - before[1])[0]
            at = before[0] + 1 + int(inside[-1]) if len(inside) else before[0]
        return max(at, 0)

    def prefixes(self, text: str | None) -> np.ndarray:
        """counts[k]: tokens of the first k characters, k from 0 to len(text)."""
        out = np.zeros(len(text or "") + 1, np.int32)
        at, total = -1, 0  # the mark before the text is no character of its own
        for segment in self.segments(text or ""):
            table = self.known.counts(segment)
            lo = at + 1
            out[max(lo, 0) : lo + len(table)] = total + table[max(-lo, 0) :].astype(np.int32)
            at, total = at + len(table), total + int(table[-1])
        out[0] = 0
        return out


_LOADED: dict[str, PrefixTables] = {}


def tables(model_file: str) -> PrefixTables:
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixTables(model_file)
    return _LOADED[model_file]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fit_chars(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    return int(np.nonzero(counts <= budget)[0][-1])


def token_counts(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within limit), and with
    prefixes=True prefix_tokens, the exact count at every prefix.

    model_file must exist on every executor; by default it is found there. A null text counts as empty: no bytes, no
    tokens. Each row is counted by itself: repeated rows and null ids keep their rows, an empty table gives none, and
    other columns are ignored. The cache of word tables is bounded; a text of any length is counted whole.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())]
    schema = pa.schema(fields + [("prefix_tokens", pa.list_(pa.int32()))] * prefixes)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = tables(model_file or model_path())
        for batch in sliced(batches):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            totals = [dp.count(t) for t in texts]
            tables_of = [dp.prefixes(t) for t in texts] if prefixes else []
            out = [column(batch, "doc_id"), [len(t.encode()) for t in texts], totals, [n > limit for n in totals], [len(t) if n <= limit else dp.fit(t, limit) for t, n in zip(texts, totals)]]
            yield build(schema, out + ([[p.tolist() for p in tables_of]] if prefixes else []))

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * prefixes)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
