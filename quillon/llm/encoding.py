"""Whole-text encoding with a public tokenizer file, fast where words repeat.

The tokenizer drops white space and splits words with a regular expression, so the ids of a text are those of
its words in turn, and the ids of a word are those of its pieces. Each distinct word and piece goes through the
tokenizers library once per worker; tables are emptied when they reach their limit, so memory is bounded.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models

#: Most words kept by one worker.
WORDS = 300_000
_ready: dict[str, Callable] = {}


def _byte_names() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Words to their ids' bytes.

    Words in plain letters (Latin, already normalised, of one case or with simple lower-case forms) are tokenised by
    the library's model directly, without the normalisers that would leave them as they are; a single mark at the
    end is split off. All other words go whole through the library.
    """

    def __init__(self, tokenizer: Tokenizer, shape: dict, pattern: str) -> None:
        model = shape["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.tokenize = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0).tokenize
        self.names, self.whole, self.cut = _byte_names(), tokenizer.encode, regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        if not _simple(word):
            ids = np.array(self.whole(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        elif word.isalpha():
            shown = word if word.isascii() else "".join([self.names[b] for b in word.encode()])
            ids = array("I", [x.id for x in self.tokenize(shown)]).tobytes()
        elif word[-1] in ".,;:!?" and (rest := word[:-1]).isalpha():
            ids = self[rest] + self[word[-1]]
        elif len(pieces := self.cut(word)) > 1:
            ids = b"".join([self[x] for x in pieces])
        else:
            ids = np.array(self.whole(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) >= WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def _simple(word: str) -> bool:
    """Whether the normaliser leaves a word as it is: lower-case Latin-1 (composed by nature) without special tokens."""
    if word.isascii():
        return "<|" not in word and (word.islower() or not any(x.isupper() for x in word))
    return max(word) < "\u0100" and "<|" not in word and word == word.lower()


def _lower(text: str) -> str:
    """In Latin-1, lower() changes single letters only, as the normaliser does; other texts are left to it."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _part_marks(texts: pa.Array) -> pa.Array:
    """Put a blank before a comma or full stop that ends a word: fewer distinct words, the same ids.

    Texts in which such a mark follows anything but a Latin letter or digit keep their form: a run of marks is one
    piece, and letters elsewhere may leave a mark behind when normalised.
    """
    runs = pc.match_substring_regex(texts, r"[^0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}][.,]\s")
    parted = texts
    for mark in ",.":
        for space in " \n":
            parted = pc.replace_substring(parted, mark + space, f" {mark}{space}")
    return pc.if_else(runs, texts, parted)


def encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from whole texts to all their ids (unsigned 32-bit) and the bounds of each text in them.

    The ids of a text equal those of the library's encode(text, add_special_tokens=False).
    """
    if path in _ready:
        return _ready[path]
    tokenizer = Tokenizer.from_file(path)
    shape = json.loads(tokenizer.to_str())
    split = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    spaced = [x.get("pattern") for x in (shape.get("normalizer") or {}).get("normalizers", [])]
    if shape["model"].get("end_of_word_suffix") and split.get("behavior") == "Removed" and split.get("invert") and {"Regex": "\\s+"} in spaced:
        words = _Words(tokenizer, shape, split["pattern"]["Regex"])

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            parts = pc.ascii_split_whitespace(_part_marks(pa.array([_lower(x) for x in texts], pa.large_string())))
            distinct = parts.values.dictionary_encode()
            ids = [words[x] for x in distinct.dictionary.to_numpy(zero_copy_only=False)]
            flat, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            first, code = np.cumsum(size) - size, distinct.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(size[code])])
            place = np.arange(ends[-1]) + np.repeat(first[code] - ends[:-1], size[code])
            return flat[place], ends[parts.offsets.to_numpy()]
    else:

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4") for x in texts]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])

    return _ready.setdefault(path, encode)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts (null: empty) of about `most` bytes, each with its first row; only one is held at a time."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="left")) + 1)
        yield at, [x or "" for x in texts.slice(at, until - at).to_pylist()]
        at = until
    pa.default_memory_pool().release_unused()  # workers live on, with other work


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
