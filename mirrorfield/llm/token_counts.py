"""Token counts by prefix dynamic programming.

A text falls into pre-tokens (by the tokenizer's pattern), and tokens never cross them. Within a pre-token, the
encoding of every prefix is known from its last token: prefix i ends with the one token t for which the encoding of
prefix i - |t| followed by t is what merging would give. So count[i] = count[i - |t|] + 1, found for all prefixes
in one pass, without encoding any of them again. Counts of a text's prefixes follow by adding up over pre-tokens; the
prefixes that end inside a pre-token's beginning that the pattern would cut otherwise are encoded through the same tables.

The counts of a pre-token's prefixes are kept for further use, in a table of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfield.llm.common import pieces, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Pre-tokens whose counts a worker keeps at most, and the longest of them in characters.
KEPT, KEPT_LENGTH = 600_000, 64
#: Bits of a token's number.
_SHIFT = 20
#: The usual pattern, and what is the same to the faster standard library over characters whose classes agree in both.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SIMPLE_WORDS = r""" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_SIMPLE = re.compile("[\x00-\x1b\x20-\x7f\u00c0-\u017f\u2010-\u2027]*")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of all prefixes, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words, self.blank = regex.compile(pattern), regex.compile(r"\s{2,}")
        self.simple = re.compile(_SIMPLE_WORDS) if pattern == _PATTERN else None
        self.simple_blank = re.compile(r"\s{2,}")
        merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        ranks: dict[tuple[bytes, bytes], int] = {}
        for at, pair in enumerate(merges):
            ranks.setdefault(pair, at)
        every = {bytes([b]): b for b in range(256)}
        for a, b in ranks:
            for token in (a, b, a + b):
                every.setdefault(token, len(every))
        #: The rank of a merge, by the numbers of its two sides.
        self.rank = {every[a] << _SHIFT | every[b]: r for (a, b), r in ranks.items()}
        #: By number: the last merge when a token's own bytes are encoded, as its sides' numbers and its rank; -1 for single bytes.
        self.left, self.right, self.last_rank = ([-1] * len(every) for _ in range(3))
        #: Tokens that their own bytes encode to.
        self.number: dict[bytes, int] = {}
        for token, n in every.items():
            found = self._made(token, ranks)
            if found:
                self.left[n], self.right[n], self.last_rank[n] = every[found[0]], every[found[1]], ranks[found]
            if found or len(token) == 1:
                self.number[token] = n
        #: Finds the tokens that end at each byte.
        self.ending = ahocorasick.Automaton()
        for token, n in self.number.items():
            self.ending.add_word(token.decode("latin-1"), (n, len(token)))
        self.ending.make_automaton()
        self.fitting: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.kept_deltas: dict[str, bytes] = {}

    @staticmethod
    def _made(token: bytes, ranks: dict[tuple[bytes, bytes], int]) -> tuple[bytes, bytes] | None:
        """The last merge when a token's own bytes are encoded; None if they don't become the token."""
        parts, last = [token[i : i + 1] for i in range(len(token))], None
        while len(parts) > 1:
            best, at = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                return None
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [last[0] + last[1]]
        return last

    def _fits(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of tokens a and b together gives these two tokens again.

        Merges are undone from the last to the first, so the pieces at the border are seen at every stage; they must
        never have had a merge of their own that came before the one that was undone. Merges of the same rank run
        from left to right.
        """
        rank, last, bound = self.rank, self.last_rank, 1 << 60
        while True:
            if rank.get(a << _SHIFT | b, bound) < bound:
                return False
            left, right = last[a], last[b]
            if left > right:
                a, bound = self.right[a], left
            elif right >= 0:
                b, bound = self.left[b], right + 1
            else:
                return True

    def byte_counts(self, word: bytes) -> list[int]:
        """Token counts of all prefixes of a pre-token, from the empty one on."""
        fitting = self.fitting
        counts, last, done = [0], [0], 0
        for end, (token, length) in self.ending.iter(word.decode("latin-1")):
            if end < done:
                continue
            if start := end + 1 - length:
                pair = last[start] << _SHIFT | token
                fit = fitting.get(pair)
                if fit is None:
                    if len(fitting) >= KEPT:
                        fitting.clear()
                    fit = fitting[pair] = self._fits(last[start], token)
                if not fit:
                    continue
            counts.append(counts[start] + 1)
            last.append(token)
            done += 1
        return counts

    def steps(self, word: str) -> tuple[int, ...]:
        """Token counts at the end of each of a pre-token's characters."""
        found = self.kept.get(word)
        if found is None:
            raw = word.encode()
            counts = self.byte_counts(raw)
            if len(raw) == len(word):
                found = tuple(counts[1:])
            else:
                found = tuple(counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80)
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if self.special:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def plain(self, part: str) -> int:
        """Tokens of a text without special strings: the counts of its pre-tokens' longest prefixes."""
        kept, steps = self.kept.get, self.steps
        words = self.simple if self.simple and _SIMPLE.fullmatch(part) else self.words
        return sum([(kept(word) or steps(word))[-1] for word in words.findall(part)])

    def count(self, text: str) -> int:
        return sum(1 if special else self.plain(part) for part, special in self.segments(text))

    def deltas(self, word: str) -> bytes:
        """What each of a pre-token's characters adds to the count, two bytes each; the beginnings of a contraction are none yet."""
        found = self.kept_deltas.get(word)
        if found is None:
            counts = list(self.steps(word))
            if word[0] == "'":
                counts[:-1] = [self.plain(word[:i]) for i in range(1, len(word))]
            found = np.diff(counts, prepend=0).astype("<i2").tobytes()
            if len(word) <= KEPT_LENGTH:
                if len(self.kept_deltas) >= KEPT:
                    self.kept_deltas.clear()
                self.kept_deltas[word] = found
        return found

    def prefix_deltas(self, text: str) -> np.ndarray:
        """The differences of prefix_counts: a text's are those of its pre-tokens, one after the other, but where white space may end a prefix."""
        if self.special and self.special.search(text):
            return np.diff(self.prefix_counts(text)).astype("<i2")
        simple = self.simple and _SIMPLE.fullmatch(text)
        kept, deltas = self.kept_deltas.get, self.deltas
        out = np.frombuffer(b"".join([kept(word) or deltas(word) for word in (self.simple if simple else self.words).findall(text)]), "<i2")
        runs = list((self.simple_blank if simple else self.blank).finditer(text))
        if runs:
            out = out.copy()
        for run in runs:
            at, end = run.span()
            own = np.frombuffer(deltas(run[0]), "<i2")
            if end < len(out):
                out[end] += out[at:end].sum() - own.sum()
            out[at:end] = own
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i: the tokens of text[:i] encoded by itself, i from 0 to the text's length.

        A prefix is cut as the text is, but for its end: white space that ends it is one pre-token, the beginning of a
        contraction is not one yet, and the beginning of a special string is plain text that joins what is before it.
        """
        out = np.zeros(len(text) + 1, np.int32)
        at = before = 0
        part_before = ""
        for part, special in self.segments(text):
            if special:
                base = before - self.plain(part_before)
                for i in range(1, len(part)):
                    out[at + i] = base + self.plain(part_before + part[:i])
                at, before, part_before = at + len(part), before + 1, ""
                out[at] = before
                continue
            for m in self.words.finditer(part):
                counts = self.steps(m[0])
                out[at + m.start() + 1 : at + m.end() + 1] = np.add(before, counts)
                if m[0][0] == "'":
                    for i in range(1, len(m[0])):
                        out[at + m.start() + i] = before + self.plain(m[0][:i])
                before += counts[-1]
            for m in self.blank.finditer(part):
                out[at + m.start() + 1 : at + m.end() + 1] = np.add(out[at + m.start()], self.steps(m[0]))
            at, part_before = at + len(part), part
        return out


_counters: dict[str, PrefixCounter] = {}


def counter(path: str, pattern: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path, pattern)
    return _counters[path]


def token_prefixes(docs: DataFrame, path: str | None = None, limit: int = LIMIT, store: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, prefixes) for each row.

    prefixes: the token count at every prefix, from the empty one to the whole text, by code points, as the differences
    from one to the next in two bytes each (little endian); left out if store is False. n_tokens is the last
    prefix's. A null text counts as empty; repeated rows and null ids stay; other columns are ignored; no rows give no rows.
    path: a vocabulary file that every executor can read.
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path(), public_tokenizers.PATTERN
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", *["prefixes"] * store]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path, pattern)
        for batch in pieces(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64())]
            if store:
                steps = [counts.prefix_deltas(t) for t in texts]
                n = [int(s.sum(dtype=np.int64)) for s in steps]
                stored = [pa.array([s.tobytes() for s in steps], pa.binary())]
            else:
                n, stored = [counts.count(t) for t in texts], []
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array([x > limit for x in n]), *stored], names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", prefixes binary" * store
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def tokens_at(prefixes: bytes, chars: int) -> int:
    """Tokens of the text cut after so many code points, from the stored counts."""
    return int(np.frombuffer(prefixes, "<i2", min(chars, len(prefixes) // 2)).sum())


def chars_within(prefixes: bytes, budget: int) -> int:
    """The longest prefix, in code points, of at most budget tokens."""
    counts = np.r_[0, np.cumsum(np.frombuffer(prefixes, "<i2"), dtype=np.int64)]
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefixes(table(spark, sf_dir, "documents"))
