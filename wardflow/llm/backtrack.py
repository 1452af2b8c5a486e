"""BPE without a merge loop: longest token matches, checked pair by pair, with steps back; decoding by offsets."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
MEMO_CHARS, MEMO_WORDS = 48, 1 << 19  # words to remember: length of one, number of them in a worker
MEMO_PAIRS = 1 << 20  # pairs of tokens to remember

# Letters and digits of Unicode 17, which the tokenizer file's library (Unicode 16) counts as neither.
LATER = r"""
՘ ֋-֌ ࢏ ౜ ೜ ₏ ₝-₟ ꟎-꟏ ꟒ ꟔ ꟝ ꟢ ꟱ ꭬-꭭
\U000107BB-\U000107BF \U00010940-\U00010959 \U00010EC5-\U00010EC7 \U00010ED9-\U00010EEE \U00011B0A \U00011DB0-\U00011DDB
\U00011DE0-\U00011DE9 \U00011DF1 \U0001246F \U00012475-\U0001247F \U00012550-\U00012686 \U00016EA0-\U00016EB8
\U00016EBB-\U00016ED3 \U00016FF2-\U00016FF6 \U000187F8-\U000187FF \U00018CD6-\U00018CDA \U00018D09-\U00018D20
\U00018D80-\U00018DF2 \U00018E00-\U00019191 \U000191A0-\U000191D2 \U0001B123-\U0001B128 \U0001B168 \U0001D6A6
\U0001DF1F-\U0001DF24 \U0001DF2B-\U0001DF81 \U0001DF90-\U0001DF96 \U0001DFCD-\U0001DFFF \U0001E6C0-\U0001E6DE
\U0001E6E0-\U0001E6E2 \U0001E6E4-\U0001E6E5 \U0001E6E7-\U0001E6ED \U0001E6F0-\U0001E6F4 \U0001E6FE-\U0001E6FF
\U0002B73A-\U0002B73F \U0002B81E \U0002CEA2-\U0002CEAD \U000323B0-\U00033479 \U0003D000-\U0003FC3F
""".split()


def split_pattern(letter: str, digit: str, space: str, module=regex) -> re.Pattern | regex.Pattern:
    """The split of byte-level BPE: words, numbers, contractions, other signs and white space."""
    other, flags = (rf"[\S--[{letter}{digit}]]", regex.V1) if "--" in letter else (rf"[^{space}{letter}{digit}]", 0)
    return module.compile(rf" ?[{letter}]+| ?[{digit}]+|'(?:[stmd]|re|ve|ll)| ?{other}+|[{space}]+(?![^{space}])|[{space}]+", flags)


def latin(kind: str) -> str:
    """The letters (or digits) below U+0250 as a class for the standard matcher, the faster of the two."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


_LATIN_WORDS = split_pattern(latin("L"), latin("N"), r" \t-\r\x85\xa0", re)
_WORDS = split_pattern(r"\p{L}", r"\p{N}", r"\s")
_OLDER_WORDS = split_pattern(rf"\p{{L}}--[{''.join(LATER)}]", rf"\p{{N}}--[{''.join(LATER)}]", r"\s")
_BEYOND_LATIN = re.compile(r"[^\x00-\u024f]")
_IS_LATER = regex.compile(f"[{''.join(LATER)}]")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Exact merges of a vocabulary in time linear in the text.

    A sequence of tokens is what merging gives exactly when every two neighbours stay apart if merged alone, so
    the longest token that goes with the one before it is taken at each place. Where none goes, the place is
    marked as a dead end and the token before it gives way to its next shorter prefix. A place is marked once.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        signs = byte_signs()
        raw = {token: bytes(signs[c] for c in token) for token in vocab}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, at in vocab.items():
            self.bytes_of[at] = raw[token]
        for token, at in special.items():
            self.bytes_of[at] = token.encode()
        self.special = special
        self.by_byte = [vocab.get(sign) for sign, _ in sorted(signs.items(), key=lambda s: s[1])]
        if None in self.by_byte:
            raise ValueError("the vocabulary lacks single bytes")
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for k, (left, right) in enumerate(merges):
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            if self.rank.setdefault(pair, k) == k:
                halves.setdefault(whole, pair)
        born = {whole: self.rank[pair] for whole, pair in halves.items()}
        # What a token shows to its neighbour: its last (first) part at each depth, with the rank that ends that part.
        self.endings, self.beginnings = ([self._edge(t, halves, born, side) for t in range(size)] for side in (1, 0))
        # Only a token whose halves come out of merging, and stay whole next to each other below its rank, comes out itself.
        made = {t for t in vocab.values() if t not in halves and len(self.bytes_of[t]) == 1}
        for t in sorted(born, key=born.get):
            if made.issuperset(halves[t]) and not self._meet(*halves[t], below=born[t]):
                made.add(t)
        of = {self.bytes_of[t]: t for t in sorted(made, reverse=True)}
        self.known = of
        # Longest first among the tokens that end at a place of the reversed text: those that begin there in the text.
        self.automaton = ahocorasick.Automaton()
        for spelled, t in of.items():
            if len(spelled) > 1:  # single bytes need no search
                self.automaton.add_word(spelled[::-1].decode("latin-1"), t)
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * size
        for spelled, t in of.items():
            self.shorter[t] = next((of[spelled[:n]] for n in range(len(spelled) - 1, 0, -1) if spelled[:n] in of), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sizes = [len(b) for b in self.bytes_of]
        self.lengths = np.array(self.sizes, np.int64)
        self.offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.lengths)))
        self.store = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._special_words = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.memo: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _edge(token: int, halves: dict, born: dict, side: int) -> list[tuple[int, float]]:
        parts, until = [(token, float("inf"))], token
        while until in halves:
            parts.append((halves[until][side], born[until]))
            until = halves[until][side]
        return parts

    def _meet(self, left: int, right: int, below: float) -> bool:
        """Whether a merge across the border of two tokens comes before the merges that end its parts."""
        rank = self.rank
        for a, a_ends in self.endings[left]:
            for b, b_ends in self.beginnings[right]:
                k = rank.get((a, b))
                # Equal ranks are merged from the left: the part on the left is used up first, the one on the right is not.
                if k is not None and k < a_ends and k <= b_ends and k < below:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        """The pair table, filled as pairs turn up: whether the two tokens stay apart when their bytes are merged."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = not self._meet(left, right, float("inf"))
        return fits

    def encode_bytes(self, data: bytes) -> list[int]:
        """Tokens of one word of the split."""
        whole = self.known.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        # By distance from the end; the longest token that begins at a place is reported first, so it is kept last.
        longest = dict(list(self.automaton.iter(data[::-1].decode("latin-1")))[::-1]).get
        sizes, shorter, pairs, single = self.sizes, self.shorter, self.pairs, self.by_byte
        out, dead, last, at = [], set(), -1, 0
        token = longest(n - 1, single[data[0]])
        while True:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits if fits is not None else self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                last, at = token, end
                token = longest(n - 1 - at, single[data[at]])
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def words(self, text: str) -> list[str]:
        """The words of the split; which of the matchers finds them is a matter of cost only."""
        if not _BEYOND_LATIN.search(text):
            return _LATIN_WORDS.findall(text)
        return (_OLDER_WORDS if _IS_LATER.search(text) else _WORDS).findall(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens are found before the split, as the tokenizer file has them."""
        if self._special_words is None or not self._special_words.search(text):
            return self._ordinary(text)
        ids, at = [], 0
        for match in self._special_words.finditer(text):
            ids += self._ordinary(text[at:match.start()])
            ids.append(self.special[match.group()])
            at = match.end()
        return ids + self._ordinary(text[at:])

    def _ordinary(self, text: str) -> list[int]:
        memo, split = self.memo, self.words(text)
        try:
            return list(chain.from_iterable(map(memo.__getitem__, split)))
        except KeyError:
            return list(chain.from_iterable([memo.get(w) or self._word(w) for w in split]))

    def _word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.encode_bytes(word.encode()))
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """All tokens' bytes, gathered from one store by the offset of each id."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        first = self.offsets[ids] - (ends - sizes)
        return self.store[np.repeat(first, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str) -> Encoder:
    with open(tokenizer_file, encoding="utf-8") as lines:
        spec = json.load(lines)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    vocab = {token: at for token, at in spec["model"]["vocab"].items() if token not in added}
    return Encoder(vocab, merges, added)


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """One row per document: its ids, how many, and the text they decode to (broken UTF-8 as U+FFFD).

    The file is a byte-level BPE tokenizer as JSON and must be readable at `tokenizer_file` on every executor;
    special tokens in a text become their ids. A null text counts as empty (no ids). Repeated rows and null ids
    give one row each; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file)
        for batch in batches:
            for part in text_slices(batch):
                ids = [enc.encode(t) if t else [] for t in part.column("text").to_pylist()]
                counts = np.array([len(i) for i in ids], np.int64)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
                decoded = [enc.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array(decoded, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """`(doc_id, ids)` back to `(doc_id, text)`; null ids count as none, an id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = [enc.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
