"""Byte-level BPE helpers that run inside tasks.

A text splits before each space; no piece of the byte-level pattern crosses
such a cut, except where white space goes on behind the space. Those texts,
texts that hold the special string, and texts with code points whose Unicode
class may differ between library versions, go to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable
from sys import getsizeof

import numpy as np
import public_tokenizers
import regex

from folioscope.llm.common import ENTRY_BYTES, LONGEST_KEY, MEMO_BYTES, Memo

#: The tokenizer file and the special string it knows (fixed values of the file).
BYTE_BPE = "byte_bpe_50k.json"
END_OF_TEXT = "<|endoftext|>"
#: Code points whose class all Unicode versions in use agree on.
_AGREED = re.compile("[\\x00-\\u0557\\u2010-\\u206f\\u20a0-\\u2fff\\u3040-\\u9fa5\\uac00-\\ud7a3]*")
_PIECES = regex.compile(public_tokenizers.PATTERN).findall
#: The same pattern with its classes spelled out for the code points below 256 (fixed values of Unicode), for the faster engine.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_PIECES = re.compile(
    f"'(?:[smtd]|ll|ve|re)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
).findall


def tokenizer_path(name: str = BYTE_BPE) -> str:
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's encoder, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_words(text: str) -> list[str] | None:
    """Keys of a text's words: each stands for a space and itself, but the first,
    which a space in front marks as the beginning of the text.

    None: the text goes to the library whole.
    """
    if END_OF_TEXT in text:
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if not _AGREED.fullmatch(text):
            return None
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    return keys


def cut_pieces(text: str) -> list[str]:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PIECES(text)
    return _LATIN_PIECES(text)


def key_pieces(key: str) -> list[str] | None:
    """The pieces of a key's word by the byte-level pattern; None where white space follows the
    space, since the pattern may then join it with white space in front."""
    if key[:1] == " ":
        return cut_pieces(key[1:])
    if not key or key[0].isspace():
        return None
    return cut_pieces(" " + key)


def id_type(path: str) -> type:
    return np.uint16 if library(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


class WordTable:
    """What each word of a worker's texts gives, from what its pieces give by ``of_piece``; ``total`` joins these.

    A word that is one piece is kept among the words alone; ``pieces`` holds the other ones.
    """

    def __init__(self, of_piece: Callable[[str], object], total: Callable[[Iterable], object]):
        self.of_piece, self.total = of_piece, total
        self.words = Memo(self.of_key, owner="tokens")
        self.pieces = Memo(of_piece, MEMO_BYTES // 4, "tokens")

    def of_key(self, key: str):
        """None where the whole text has to be given to the library."""
        if key.isalpha():
            return self.of_piece(" " + key)
        end = key[-1:]
        if end in ".,;:!?" and key[:-1].isalpha():
            return self.total((self.words[key[:-1]], self.pieces[end]))
        found = key_pieces(key)
        return None if found is None else self.total([self.of_some(x) for x in found])

    def of_some(self, piece: str):
        word = piece[1:]
        return self.words[word] if piece[:1] == " " and word.isalpha() else self.pieces[piece]


@functools.lru_cache(maxsize=4)
def byte_model(path: str):
    """The library's merging model over the file's vocabulary and merges, with each byte as its own Latin-1 character."""
    from tokenizers.models import BPE

    model = vocabulary(path)["model"]
    byte = str.maketrans({c: chr(b) for c, b in byte_symbols().items()})
    merges = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
    return BPE({piece.translate(byte): i for piece, i in model["vocab"].items()}, [(a.translate(byte), b.translate(byte)) for a, b in merges])


#: Keys whose pieces the model may code together with other keys: letters, and simple punctuation and line ends between them.
_TOGETHER = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?]?(?:\n[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?]?)*").fullmatch
#: Words of one call of the model.
TOGETHER_WORDS = 1_000


def cut_by_classes(tokens: Iterable[bytes]) -> bool:
    """Whether no token that can occur in ``_TOGETHER`` keys reaches over a boundary of their pieces, so that
    coding them in one call gives what coding each one gives: a space stands only first, and
    letters (with all bytes from 128), simple punctuation and line ends don't mix."""
    mixed = re.compile(rb"[A-Za-z\x80-\xff.,;:!?] |[A-Za-z\x80-\xff][.,;:!?\n]|[.,;:!?\n][A-Za-z\x80-\xff]|[.,;:!?]\n|\n[.,;:!?]").search

    def occurs(token: bytes) -> bool:
        try:
            return all(c.isalpha() or c in " .,;:!?\n" for c in token.decode())
        except UnicodeDecodeError:
            return True

    return not any(mixed(x) and occurs(x) for x in tokens)


class Words(dict):
    """Ids by word; keys that it lacks are noted in ``lacking``."""

    def __init__(self):
        super().__init__()
        self.lacking: list[str] = []

    def __missing__(self, key: str) -> None:
        self.lacking.append(key)


class Encoder:
    """Ids of one worker's words, as bytes of ``id_type``, by the library's model.

    Words that several texts lack are coded in common calls. What is remembered is
    bounded in bytes, in two generations.
    """

    #: Stands for a key whose text has to be encoded whole.
    WHOLE = 0

    def __init__(self, path: str, limit: int = MEMO_BYTES):
        self.dtype, self.limit, self.tokenize = id_type(path), limit, byte_model(path).tokenize
        listed = pieces(path)
        self.begins = np.array([x[:1] == b" " for x in listed])
        self.together = cut_by_classes(listed)
        self.pieces = Memo(self.code_piece, limit // 4, "tokens")
        self.words, self.old, self.held = Words(), Words(), 0

    def forget(self) -> None:
        self.words, self.old, self.held = Words(), Words(), 0
        self.pieces.forget()

    def ids(self, text: str) -> np.ndarray:
        return np.array([t.id for t in self.tokenize(text if text.isascii() else text.encode().decode("latin-1"))], self.dtype)

    def code_piece(self, piece: str) -> bytes:
        return self.ids(piece).tobytes()

    def code_alone(self, key: str) -> bytes | int:
        found = key_pieces(key)
        return self.WHOLE if found is None else b"".join([self.pieces[x] for x in found])

    def code_together(self, keys: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(keys), TOGETHER_WORDS):
            ids = self.ids(" " + " ".join(keys[i : i + TOGETHER_WORDS]))
            at = (np.flatnonzero(self.begins[ids]) * ids.itemsize).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
        return out

    def code(self, keys: Iterable[str]) -> dict[str, bytes | int]:
        """Ids of distinct keys that ``words`` lacks, remembered but for very long keys."""
        coded, common, old = {}, [], self.old
        for k in keys:
            if k in old:
                coded[k] = old[k]
            elif self.together and (k.isalpha() or _TOGETHER(k)):
                common.append(k)
            else:
                coded[k] = self.code_alone(k)
        coded.update(zip(common, self.code_together(common)))
        if self.held >= self.limit:
            self.words, self.old, self.held = Words(), self.words, 0
        kept = {k: v for k, v in coded.items() if len(k) <= LONGEST_KEY}
        self.words.update(kept)
        self.held += sum(map(getsizeof, kept)) + sum(map(getsizeof, kept.values())) + ENTRY_BYTES * len(kept)
        return coded

    def look_up(self, split: list[list[str]]) -> list[list[bytes | int]]:
        """Ids of each list's keys in turn."""
        words, lacking = self.words, self.words.lacking
        out, unfinished = [], []
        for keys in split:
            before = len(lacking)
            out.append(list(map(words.__getitem__, keys)))
            if len(lacking) > before:
                unfinished.append(len(out) - 1)
        if unfinished:
            coded = self.code(set(lacking))
            lacking.clear()
            for i in unfinished:
                out[i] = [coded[k] if v is None else v for k, v in zip(split[i], out[i])]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_whole(path: str, text: str) -> np.ndarray:
    return np.array(library(path).encode(text, add_special_tokens=False).ids, id_type(path))


def encode_bytes(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text, as the library's ``encode`` gives them, as bytes of ``id_type``."""
    split = [split_words(x) for x in texts]
    found = iter(encoder(path).look_up([x for x in split if x is not None]))
    out = []
    for text, keys in zip(texts, split):
        try:
            out.append(encode_whole(path, text).tobytes() if keys is None else b"".join(next(found)))
        except TypeError:  # a key that can't stand alone
            out.append(encode_whole(path, text).tobytes())
    return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


@functools.lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet's character for each byte: visible Latin-1 characters stand
    for themselves, the other bytes in order for the code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id: the bounded id-to-piece table that decoding joins with."""
    j = vocabulary(path)
    symbol = byte_symbols()
    table = {i: bytes(symbol[c] for c in piece) for piece, i in j["model"]["vocab"].items()}
    table |= {x["id"]: x["content"].encode() for x in j["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]
