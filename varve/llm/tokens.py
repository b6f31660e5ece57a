"""Public tokenizers inside tasks, loaded once a process from a path.

Word-level and byte-level BPE vocabularies are also run as ranks by ``tiktoken``,
which is several times faster and returns the same ids: a vocabulary in order of
its merges encodes each of its entries to itself, so merging by rank and merging
by the merge list take the same steps.  Only texts of characters whose classes
do not differ between regular expression engines go that way; any other text
is encoded by the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from varve.llm.kernels import distinct_words, spans, words

#: Printable ASCII, Latin, Greek (but sigma, whose lower case depends on its place), Cyrillic, kana, Han and
#: Hangul as they are in every version of Unicode since 3.0.
_PLAIN = r"\x21-\x7e\xa1-\xac\xae-ȠȢ-ȳΑ-ΡΤ-ρτ-ώЀ-ҁҐ-ӄぁ-ゔァ-ヺ一-龥가-힣"
_ODD = regex.compile(f"[^\n{_PLAIN}]+")
_ODD_TEXT = regex.compile(rf"[^\x20\t\n\r{_PLAIN}]")
#: Fixed value: how byte-level BPE cuts a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _bytes_of(entry: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in entry)


class WordEncoder:
    """Encodes single words, whatever stands beside them, with a tokenizer that cuts at white space and marks the ends of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        mark = spec["model"].get("end_of_word_suffix")
        cut = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        if not mark or not cut:
            raise ValueError("a tokenizer that marks the ends of words is needed")
        self.pattern = regex.compile(rf"\n|{cut[0]}")
        letters = byte_letters()
        special = set(self.special)
        # the end of a word is written as a zero byte, which the texts encoded here do not hold
        ranks = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for entry, k in spec["model"]["vocab"].items():
            if entry not in special:
                whole = entry.endswith(mark)
                ranks[_bytes_of(entry.removesuffix(mark), letters) + b"\0" * whole] = k
                self.ends[k] = whole
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's begin."""
        joined = b"\n".join(found).decode()
        odd = self._odd(joined, found)
        if odd:
            plain = [w for k, w in enumerate(found) if k not in odd]
            ids, sizes = self._plain(b"\n".join(plain).decode(), len(plain))
            own = {k: np.array(self.tokenizer.encode(found[k].decode(), add_special_tokens=False).ids, np.uint32) for k in odd}
            which = np.array([k not in odd for k in range(len(found))])
            every = np.empty(len(found), np.int64)
            every[which] = sizes
            every[~which] = [len(own[k]) for k in range(len(found)) if k in odd]
            bounds = np.concatenate([[0], np.cumsum(every)])
            flat = np.empty(int(bounds[-1]), np.uint32)
            flat[spans(bounds[:-1][which], sizes)] = ids
            for k, x in own.items():
                flat[bounds[k] : bounds[k + 1]] = x
            return flat, bounds
        ids, sizes = self._plain(joined, len(found))
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _odd(self, joined: str, found: list[bytes]) -> set[int]:
        """Which words hold a character that is not plain, or the string of a special token."""
        places = [m.start() for m in _ODD.finditer(joined)]
        for s in self.special:
            at = joined.find(s)
            while at >= 0:
                places.append(at)
                at = joined.find(s, at + 1)
        if not places:
            return set()
        starts = np.cumsum([0, *(len(w.decode()) + 1 for w in found)])
        return set((np.searchsorted(starts, places, "right") - 1).tolist())

    def _plain(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``n`` plain words, one a line, and how many each has."""
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = self.pattern.findall(unicodedata.normalize("NFC", joined).lower())
        place = {p: k for k, p in enumerate(dict.fromkeys(parts))}
        which = np.array([place[p] for p in parts], np.int64)
        ids = np.array(self.ranks.encode_ordinary("\0".join(place) + "\0"), np.uint32)
        bounds = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        line = which == place.get("\n", -1)
        word = np.cumsum(line)[~line]
        which = which[~line]
        sizes = bounds[which + 1] - bounds[which]
        return ids[spans(bounds[which], sizes)], np.bincount(word, weights=sizes, minlength=n).astype(np.int64)


class WordTable:
    """Ids of the words met in a process; each word is encoded once until there are WORDS of them."""

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and where each text's begin (one entry more than texts)."""
        starts, ends, first = words(buf, offsets)
        found, which = distinct_words(buf, starts, ends)
        if len(self.known) > WORDS:
            self.clear()
        place = pc.index_in(found, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = place < 0
        place[new] = np.arange(len(self.known), len(self.known) + int(new.sum()))
        if new.any():
            fresh = found.filter(pa.array(new))
            ids, bounds = self.encoder.encode(fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
            self.bounds = np.concatenate([self.bounds, len(self.ids) + bounds[1:]])
            self.ids = np.concatenate([self.ids, ids])
        begin, size = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        sizes = size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        if (size == 1).all():
            return self.ids[begin[which]], total[first]
        return self.ids[spans(begin[which], sizes)], total[first]


class ByteEncoder:
    """Byte-level BPE of whole texts; strings of special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for entry, k in vocab.items():
            if entry not in special:
                self.pieces[k] = _bytes_of(entry, letters)
        ranks = {p: k for k, p in enumerate(self.pieces) if p}
        self.ranks = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if _ODD_TEXT.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


class PieceEncoder:
    """Pieces with a mark for space, which the encoder itself puts before a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@functools.lru_cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache
def word_table(path: str) -> WordTable:
    """The table that the tasks of a process share, one after another."""
    return WordTable(word_encoder(path))


@functools.lru_cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@functools.lru_cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
