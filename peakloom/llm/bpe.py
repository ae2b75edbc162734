"""Byte-pair encoding with word ends, read from a tokenizer's JSON file.

Splitting follows that file: special strings are cut out of the raw text first; the rest is
normalised (NFC, white space to one blank, lower case character by character) and split into
contractions, runs of letters, single digits and runs of other characters.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: The splitting pattern and the white space class of the tokenizer file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD_END = "</w>"
#: Bytes up to which a word is merged with a list of ranks; longer ones by a heap. The rank of no pair.
SHORT, NONE = 64, 1 << 60
#: Words of one length from which they are merged side by side.
SIDE_BY_SIDE = 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordBPE:
    """Exact merges by rank. Ids of a word are a tuple; strings() gives the tokens as the vocabulary writes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END, path
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in self.alphabet]
        self.last = [self.vocab[c + WORD_END] for c in self.alphabet]
        self.ranks: dict[int, int] = {}  # of a pair of ids
        self.made: list[int] = []  # by rank, the id that the pair becomes
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.vocab[a] << 20 | self.vocab[b], rank)
            self.made.append(self.vocab[a + b])
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int64)
        self.all_pieces = regex.compile(SPLIT.pattern + "|\n")

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings stand for themselves."""
        if self.cut is None or "<|" not in text or not self.cut.search(text):
            return SPLIT.findall(normal(text))
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else SPLIT.findall(normal(part))
        return out

    def split(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces of all chunks (without blanks and line ends) in order: the distinct ones, and of each piece its place among them and its chunk's place."""
        text, order = "\n".join(chunks), np.arange(len(chunks))
        if self.cut is not None and "<|" in text:  # special strings are cut out of the raw text
            own = np.array(["<|" in c for c in chunks])
            order = np.concatenate([np.flatnonzero(~own), np.flatnonzero(own)])
            plain = [c for c, special in zip(chunks, own, strict=True) if not special]
            found = self.all_pieces.findall(lowered("\n".join([*plain, ""])))
            found += [w for c, special in zip(chunks, own, strict=True) if special for w in (*self.pieces(c), "\n")]
        else:
            found = self.all_pieces.findall(lowered(text))  # white space is in no piece, so it may stand as it is
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if "\n" not in words:
            return words, at, np.zeros(len(at), np.int64)
        end = words.index("\n")
        ends = at == end
        chunk = order[np.minimum(np.cumsum(ends), len(chunks) - 1)]
        words.pop(end)
        at, chunk = at[~ends], chunk[~ends]
        return words, np.where(at > end, at - 1, at), chunk

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where there is none."""
        pair = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], NONE)

    def merges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge, for many words: their ids one after another, and how many each has. Words of one length are merged side by side: a step joins one pair in each, so those not finished stay equally long."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        inner, last, made = np.array(self.inner), np.array(self.last), np.array(self.made)
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > SHORT or len(rows) < SIDE_BY_SIDE:
                finished += [(rows[k : k + 1], np.array([self.merge(words[r].decode())])) for k, r in enumerate(rows.tolist())]
                continue
            raw = data[starts[rows][:, None] + np.arange(n)]
            ids = inner[raw]
            ids[:, -1] = last[raw[:, -1]]
            found = self.rank(ids[:, :-1], ids[:, 1:])
            while len(rows) and n > 1:
                i = found.argmin(1)  # the leftmost of the lowest
                best = found[np.arange(len(rows)), i]
                live = best != NONE
                if not live.all():
                    finished.append((rows[~live], ids[~live]))
                    rows, ids, found, i, best = rows[live], ids[live], found[live], i[live], best[live]
                    if not len(rows):
                        break
                new, k = made[best], np.arange(len(rows))
                ids = ids[np.arange(n) != i[:, None] + 1].reshape(len(rows), n - 1)
                ids[k, i] = new
                found = found[np.arange(n - 1) != i[:, None]].reshape(len(rows), n - 2)
                n -= 1
                k = np.flatnonzero(i > 0)
                found[k, i[k] - 1] = self.rank(ids[k, i[k] - 1], new[k])
                k = np.flatnonzero(i < n - 1)
                found[k, i[k]] = self.rank(new[k], ids[k, i[k] + 1])
            if len(rows):
                finished.append((rows, ids))
        many = np.zeros(len(words), np.int64)
        for rows, ids in finished:
            many[rows] = ids.shape[1]
        out, starts = np.empty(int(many.sum()), np.int64), np.cumsum(many) - many
        for rows, ids in finished:
            out[starts[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, many

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: join the adjacent pair of lowest rank, leftmost first, until none is left."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return tuple(self.joined(ids) if len(ids) <= SHORT else self.joined_by_heap(ids))

    def joined(self, ids: list[int]) -> list[int]:
        """For short words: the ranks of all pairs stand in a list, of which a join changes two."""
        ids, rank, none = [*ids], self.ranks.get, NONE
        found = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i] = new = self.made[best]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = rank(ids[i - 1] << 20 | new, none)
            if i < len(found):
                found[i] = rank(new << 20 | ids[i + 1], none)
        return ids

    def joined_by_heap(self, ids: list[int]) -> list[int]:
        """For words of any length: a heap of pairs over a linked list, n log n. A pair that has changed since it was pushed is passed over."""
        n, get = len(ids), self.ranks.get
        ids, after, before = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = (new := self.made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def chunks(self, text: str) -> list[str]:
        """The text between blanks and line ends: no special string, pre-token or composition reaches over them, so each may be split by itself."""
        return text.replace("\n", " ").split(" ")

    def ids(self, piece: str) -> tuple[int, ...]:
        return (self.special[piece],) if piece in self.special else self.merge(piece)

    def surface(self, token: str) -> str | None:
        """The pre-token that a word-final vocabulary string spells, if its bytes are UTF-8."""
        if not token.endswith(WORD_END):
            return None
        back = {c: b for b, c in enumerate(self.alphabet)}
        try:
            return bytes(back[c] for c in token[: -len(WORD_END)]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return None

    def whole_tokens(self) -> dict[str, int]:
        """Pre-tokens proved to encode alone as exactly one token: the splitter leaves them whole and the merges end in that id."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        out = {}
        for token, i in self.vocab.items():
            if token.endswith(WORD_END):
                try:
                    word = bytes(back[c] for c in token[: -len(WORD_END)]).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    continue
                if word and self.pieces(word) == [word] and self.merge(word) == (i,):
                    out[word] = i
        return out


def lowered(text: str) -> str:
    """NFC, lower case of each character by itself (so no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def normal(text: str) -> str:
    """NFC, lower case, white space runs to one blank."""
    return SPACE.sub(" ", lowered(text))


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)
