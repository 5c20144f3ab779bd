"""Token ids by a public tokenizer, word by word with a bounded memory of what each word gave.

Splitting at white space is exact for these tokenizers: a token never spans from a visible character to a following
space, so a text's ids are those of its words (each with the space before it) in a row; nor does one span a letter and a
full stop or comma. Texts with separators on
which Python and the tokenizer disagree, or with a special token's string, are encoded whole by the tokenizer.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

#: Words whose ids a worker keeps in each of two generations (results do not depend on it).
KEPT_WORDS = 400_000
#: Bytes of text encoded at once where memory allows: each distinct word in them is looked for once.
SLICE = 1 << 21
#: New words put into one text for the tokenizer.
_TOGETHER = 500
#: Control characters that Python alone takes for white space, and the one that marks keys here.
_CONTROL = ("\0", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: A full stop or comma that does not follow a letter or digit; after one of those it is a token's first character.
_LOOSE_MARK = re.compile(r"[.,](?<=[\W_].)")
#: What else is white space in Latin-1.
_OTHER_SPACE = ("\t", "\x0b", "\x0c", "\r", "\xa0")
#: Two separators in a row.
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_PIECES = re.compile(r"\s*\S+|\s+$")
#: The letters of Latin-1: a word of them alone is one piece of the model, and composed already.
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
#: Words put into one text for the model alone.
_LETTERS_TOGETHER = 100
#: Stands between them: one piece of one id, which no word of letters holds.
_BETWEEN = "!"


class _Memory(dict):
    """Ids of words. A word that is not there is taken from ``older``, or gets room for its ids and is put down in ``new``."""

    def __init__(self, older: dict[str, bytes]) -> None:
        super().__init__()
        self.older = older
        self.new: dict[str, bytearray] = {}

    def __missing__(self, key: str) -> bytes | bytearray:
        found = self.older.get(key)
        if found is None:
            found = self.new[key] = bytearray()
        self[key] = found
        return found


class Encoder:
    """Encodes texts to little-endian ids of ``dtype`` (2 bytes where the vocabulary allows, else 4)."""

    def __init__(self, path: str, keeps_spaces: bool, kept: int = KEPT_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core: no threads beside it
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.keeps_spaces = keeps_spaces
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Memory({})
        self.line = len(self._raw(["\n"])[0]) if keeps_spaces else 0
        self.of_letters = self._model_alone()

    @property
    def older(self) -> dict[str, bytes]:
        return self.known.older

    def _model_alone(self) -> Callable[[str], object] | None:
        """What tells keys of letters, which may go to the model alone; None if its ids are not the tokenizer's."""
        bytes_ = ByteLevel(add_prefix_space=False, use_regex=False)
        letter = [bytes_.pre_tokenize_str(chr(c))[0][0] for c in range(128)]
        table = [*letter, *(bytes_.pre_tokenize_str(chr(c))[0][0][1] for c in range(128, 192)), *[""] * 64]
        for lead, first in ((0xC2, "\x80"), (0xC3, "\xc0")):
            table[lead] = bytes_.pre_tokenize_str(first)[0][0][0]
        # spaces part the model's pieces, a NUL is a word's own space; bytes of other characters do not occur
        table[0], table[32] = letter[32], " "
        self.letters = "".join(c or "\ufffe" for c in table)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        mark = self.model.encode(_BETWEEN, add_special_tokens=False).ids
        self.between = mark[0] if len(mark) == 1 else -1
        probe = [*_LETTERS, *(_LETTERS[i:i + n] for n in (2, 3, 5, 9) for i in range(len(_LETTERS))), "the", "d", "ll", "Words"]
        probe += [f"\n{w}" for w in probe] if self.keeps_spaces else []
        if len(mark) != 1 or self._model_words(probe) != self._raw_words([self._source(k) for k in probe]):
            return None
        return re.compile(("\n?" if self.keeps_spaces else "") + f"[{_LETTERS}]+").fullmatch

    def _model_words(self, keys: list[str]) -> list[bytes]:
        """Ids of keys of letters: the pieces that the tokenizer would cut, in its bytes' letters, go to its model."""
        own, texts, out, width = "\0" if self.keeps_spaces else "", [], [], self.dtype.itemsize
        for i in range(0, len(keys), _LETTERS_TOGETHER):
            text = own + f" {_BETWEEN} {own}".join(keys[i:i + _LETTERS_TOGETHER])
            text = text.replace("\0\n", "\n ") if self.keeps_spaces else text.lower()
            texts.append(codecs.charmap_decode(text.encode(), "strict", self.letters)[0])
        for e in self.model.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            raw, start = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == self.between) * width).tolist():
                out.append(raw[start:end])
                start = end + width
            out.append(raw[start:])
        return out

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _raw_words(self, words: list[str]) -> list[bytes]:
        """Ids of words without special tokens: many to a text, with a special token between them."""
        if not self.special:
            return self._raw(words)
        mark, out = self.tokenizer.token_to_id(self.special[0]), []
        texts = [self.special[0].join(words[i:i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = array(self.code, e.ids)
            start = 0
            for end in np.flatnonzero(np.frombuffer(ids, self.dtype) == mark).tolist():
                out.append(ids[start:end].tobytes())
                start = end + 1
            out.append(ids[start:].tobytes())
        return out

    def _split(self, text: str) -> str | list[str] | None:
        """Words as keys, in one string with spaces between them where no key holds one; None where the tokenizer must
        see the whole text."""
        if any(c in text for c in _CONTROL) or any(s in text for s in self.special):
            return None
        plain = not _LOOSE_MARK.search(text)
        if plain and not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:  # other alphabets' letters are left to the tokenizer
                plain = False
        simple = plain and not any(c in text for c in _OTHER_SPACE)
        if not self.keeps_spaces:
            text = text.lower().replace(".", " .").replace(",", " ,") if plain else text
            return text.replace("\n", " ") if simple else text.split()
        if simple and text and text[0] not in " \n" and text[-1] not in " \n" and not any(p in text for p in _PAIRS):
            # single separators between visible characters: one key per word, "\n" marks a line's first word
            return "\n" + text.replace("\n", " \n").replace(".", " \0.").replace(",", " \0,")
        parts = text.split()
        gaps = len(parts) - 1
        if parts and text.count(" ") + text.count("\n") == gaps and sum(map(len, parts)) + gaps == len(text):
            text = ("\n" + text).replace("\n", " \n")
            return (text.replace(".", " \0.").replace(",", " \0,") if plain else text).split(" ")[1:]
        return [p if p[0].isspace() else "\0" + p for p in _PIECES.findall(text)]

    def _source(self, key: str) -> str:
        if key[:1] == "\0":
            return key[1:]
        return key if not self.keeps_spaces or key[0].isspace() else " " + key

    def _learn(self) -> None:
        """Ids of the new keys from the tokenizer or, for words of letters, from its model."""
        new = self.known.new
        letters = [k for k in new if self.of_letters(k)] if self.of_letters else []
        found = dict(zip(letters, self._model_words(letters)))
        others = [k for k in new if k not in found]
        found.update(zip(others, self._raw_words([self._source(k) for k in others])))
        for key, ids in found.items():
            new[key][:] = ids
        self.known.update(found)
        self.known.new = {}

    def forget(self) -> None:
        """Give the memory of all words back; they are learned again."""
        self.known = _Memory({})

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        if len(self.known) > self.kept:
            self.known.older = {}
            self.known = _Memory(self.known)
        split = [self._split(t) for t in texts]
        # distinct words of the strings of keys first; new words hold empty places, filled before the ids are joined
        strings = pc.split_pattern(pa.array([k for k in split if isinstance(k, str)], pa.large_string()), " ")
        words = strings.flatten().dictionary_encode()
        places = list(map(self.known.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        found = [list(map(self.known.__getitem__, keys)) if isinstance(keys, list) else None for keys in split]
        self._learn()
        ids = pa.array(places, pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.asarray(strings.offsets)].tolist() if len(ids) else []
        data, row, out = memoryview(ids.buffers()[2] or b""), 0, []
        for text, keys, parts in zip(texts, split, found):
            if keys is None:
                out.append(self._raw([text])[0])
            elif parts is None:
                out.append(bytes(data[ends[row] + self.line:ends[row + 1]]))
                row += 1
            else:
                joined = b"".join(parts)
                out.append(joined[self.line:] if keys and keys[0][0] == "\n" and text[0] != "\n" else joined)
        return out


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, keeps_spaces: bool, kept: int = KEPT_WORDS) -> Encoder:
    """One encoder per worker process; it lives on between tasks."""
    if (path, keeps_spaces, kept) not in _ENCODERS:
        _ENCODERS[path, keeps_spaces, kept] = Encoder(path, keeps_spaces, kept)
    return _ENCODERS[path, keeps_spaces, kept]


def encoded(path: str, keeps_spaces: bool) -> Callable[[list[str]], list[bytes]]:
    return lambda texts: encoder(path, keeps_spaces).encode(texts)
