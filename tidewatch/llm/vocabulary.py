"""Token ids and their bytes, from vocabulary files of public tokenizers.

``ByteTokens`` gives the ids that the tokenizers library gives for a whole text with a byte-level BPE
file and without special tokens. Byte-level BPE merges inside pre-tokens only. Texts are cut at white space into chunks
that no pre-token crosses, in NumPy over the bytes of many texts; every distinct chunk is cut into pre-tokens and put through
the library's model once per Python worker, and looked up after that by a hash whose hits are compared byte by byte.
Where the cutting rules of this module and the library's own pre-tokenizer disagree about a character (both are asked when
a character is first seen), texts holding it go through the library whole.
"""

from __future__ import annotations

import gc
import os
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

# Fixed value: the cutting rule of byte-level BPE.
PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = frozenset(map(chr, range(32, 127))) | {"\n", "\t", "\r", "\x0b", "\x0c"}
CACHED_CHUNKS, CACHED_WORDS = 2_000_000, 400_000  # bounds of memory; ids do not depend on them
BYTES_AT_ONCE = 1_500_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the rest follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks start in the bytes of texts that start at ``starts``.

    A run of white space ends a chunk. Its last character is parted from the rest if a word follows: a space
    starts the word's chunk, any other character stands alone.
    """
    blank = _BLANK[data]
    inner = np.ones(len(data), bool)
    inner[starts] = False
    before = np.r_[False, blank[:-1]]
    word = ~blank & before & inner
    cut = blank & ~before
    cut |= word & np.r_[False, data[:-1] != 32]
    cut[:-1] |= word[1:]
    cut[starts] = True
    return np.flatnonzero(cut)


class ByteTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.back = {ord(letter): b for b, letter in self.letters.items()}
        self.seen, self.odd = set(PLAIN), set()
        self.words: dict[str, bytes] = {}
        ones = np.ones(0, np.uint64)
        self.power, self.inverse = ones, ones
        self._forget()

    def _forget(self) -> None:
        # Hashes of known chunks in order, each with its number; by number: place and length of the bytes, place and number of
        # the ids, and whether the library must see the whole text.
        self.hash, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.long, self.first, self.count = (np.zeros(0, np.int32) for _ in range(4))
        self.strange, self.flat, self.bytes = np.zeros(0, bool), np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def token_bytes(self) -> list[bytes]:
        names = {i: name for name, i in self.library.get_vocab(with_added_tokens=True).items()}
        return [bytes(self.back[ord(c)] for c in name) if (name := names.get(i, "")) and all(ord(c) in self.back for c in name)
                else b"" for i in range(max(names) + 1)]

    def _strange(self, chunk: str) -> bool:
        """Does the chunk hold characters that this module must not judge? New ones are tried out on the library."""
        chars = set(chunk)
        for c in chars - self.seen:
            self.seen.add(c)
            probe = f"a{c}a1{c}1!{c}!{c} {c}{c}\n{c} {c}a {c}1 {c}! {c}"
            own = [self._mapped(word) for word in PRETOKEN.findall(probe)]
            if c.isspace() or own != [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(probe)]:
                self.odd.add(c)
        return bool(self.odd) and not self.odd.isdisjoint(chars)

    def _mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def _learn(self, new: np.ndarray, data: bytes, low: np.ndarray, high: np.ndarray) -> None:
        """Take up chunks by hash; low and high are places in ``data``."""
        out, count, strange, model, words = [], [], [], self.library.model, self.words
        gc.disable()  # nothing here is cyclic, and a collection visits all that is held
        for a, b in zip(low.tolist(), high.tolist()):
            chunk = data[a:b].decode()
            strange.append(not (chunk.isascii() and chunk.isprintable()) and self._strange(chunk))
            n = 0
            for word in (chunk,) if chunk.isalpha() and chunk.isascii() else PRETOKEN.findall(chunk):
                ids = words.get(word)
                if ids is None:
                    ids = words[word] = array("I", [t.id for t in model.tokenize(self._mapped(word))]).tobytes()
                out.append(ids)
                n += len(ids)
            count.append(n >> 2)
        gc.enable()
        if len(words) > CACHED_WORDS:
            words.clear()
        count, long = np.array(count, np.int32), (high - low).astype(np.int32)
        ends = np.cumsum(long)
        taken = np.frombuffer(data, np.uint8)[np.repeat(low - ends + long, long) + np.arange(ends[-1])]
        place = np.searchsorted(self.hash, new)
        self.number = np.insert(self.number, place, np.arange(len(self.long), len(self.long) + len(new), dtype=np.int32))
        self.hash = np.insert(self.hash, place, new)
        for name, values in (("at", (len(self.bytes) + ends - long).astype(np.int32)), ("long", long), ("count", count), ("strange", np.array(strange, bool)),
                             ("first", (len(self.flat) + np.cumsum(count) - count).astype(np.int32)), ("bytes", taken), ("flat", np.frombuffer(b"".join(out), np.uint32))):
            setattr(self, name, np.concatenate((getattr(self, name), values)))

    def _hashes(self, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(self.power) < len(data) + 1:
            n = len(data) + 1
            self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]) for base in (_BASE, _BASE_INVERSE))
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.add(data, np.uint64(1), out=total[1:])
        total[1:] *= self.power[:len(data)]
        np.cumsum(total, out=total)
        mixed = (total[high] - total[low]) * self.inverse[low]
        return mixed ^ (mixed >> np.uint64(29))

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        encoded = [t.encode() for t in texts]
        size, at, parts = np.cumsum([0, *map(len, encoded)]), 0, []
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(size, size[at] + BYTES_AT_ONCE, "right")) - 1)
            parts.append(self._encode(texts[at:stop], encoded[at:stop]))
            at = stop
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _encode(self, texts: Sequence[str], encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.hash) > CACHED_CHUNKS or len(self.bytes) > 12 * CACHED_CHUNKS or len(self.flat) > 12 * CACHED_CHUNKS:
            self._forget()
        raw = b"".join(encoded)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(list(map(len, encoded)))
        starts = np.r_[0, ends[:-1]]
        low = chunk_starts(data, starts[starts < ends])
        high = np.r_[low[1:], len(data)]
        distinct, where, of = np.unique(self._hashes(data, low, high), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = place < len(self.hash)
        fresh[inside] = self.hash[place[inside]] != distinct[inside]
        if fresh.any():
            self._learn(distinct[fresh], raw, low[where[fresh]], high[where[fresh]])
            place = np.searchsorted(self.hash, distinct)
        entry = self.number[place][of]
        doc = np.searchsorted(ends, low, "right")
        # Texts with characters left to the library, or with a chunk that only shares its hash with a known one.
        wrong = self.strange[entry] | (self.long[entry] != high - low)
        stored = np.arange(len(data), dtype=np.int32)
        stored += np.repeat((self.at[entry] - low).astype(np.int32), high - low)
        differ = np.flatnonzero(self.bytes[np.minimum(stored, len(self.bytes) - 1)] != data)
        whole = np.unique(np.concatenate((doc[wrong], np.searchsorted(ends, differ, "right"))))
        width = self.count[entry]
        last = np.cumsum(width)
        places = np.arange(last[-1], dtype=np.int32)
        places += np.repeat((self.first[entry] - last + width).astype(np.int32), width)
        ids = self.flat[places]
        lengths = np.bincount(doc, width, len(texts)).astype(np.int64)
        if len(whole):
            pieces = np.split(ids, np.cumsum(lengths)[:-1])
            for i in whole.tolist():
                pieces[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                lengths[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, lengths


class PieceTokens:
    """Ids of a piece model with byte fallback; the model puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()

    def token_bytes(self) -> list[bytes]:
        model = self.model
        return [bytes([int(piece[3:5], 16)]) if model.is_byte(i)
                else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode()
                for i, piece in enumerate(model.id_to_piece(list(range(self.size))))]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(list(texts), num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    """One tokenizer for all tasks of a Python worker."""
    return ByteTokens(path)


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)
