"""Token counts by section: whole documents are encoded once and token spans are joined to sections."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from quillon.llm.encoding import chunks, tokenizer_path

RULES = ("first", "last", "most")
#: Most pieces kept by one worker.
PIECES = 1_000_000
SECTIONS = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, n_doc_tokens long"
#: The splitting pattern that byte-level tokenizers name only by a flag; a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ready: dict[str, tuple] = {}


class _Spans(dict):
    """Pieces of the splitting pattern to (starts, ends) of their tokens in the piece, in code points."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.encode = tokenizer.encode

    def __missing__(self, piece: str) -> tuple[bytes, bytes]:
        if len(self) >= PIECES:
            self._forget()
        spans = np.array(self.encode(piece, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        found = spans[:, 0].tobytes(), spans[:, 1].tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def _forget(self) -> None:
        """Drop the later half: what came first is, as a rule, what is frequent."""
        kept = dict(islice(self.items(), PIECES // 2))
        self.clear()
        self.update(kept)


def spanner(path: str):  # noqa: ANN201
    """A function from a whole text to the starts and ends of its tokens in code points.

    For byte-level tokenizers without normalisation the tokens of a text are those of its pieces, each of which is
    encoded once per worker; any other tokenizer encodes the text in one go.
    """
    if path in _ready:
        return _ready[path]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    shape = json.loads(tokenizer.to_str())
    first = shape.get("pre_tokenizer") or {}
    if not shape.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space"):
        # offsets of whole pieces, blanks included
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
        tokenizer.post_processor = None
        spans, split = _Spans(tokenizer), regex.compile(BYTE_LEVEL).findall

        def run(text: str) -> tuple[np.ndarray, np.ndarray]:
            pieces = split(text)
            found = [spans[x] for x in pieces]
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            base = np.repeat(np.cumsum(sizes) - sizes, np.fromiter((len(a) for a, _ in found), np.int64, len(found)) // 8)
            return tuple(np.frombuffer(b"".join([x[k] for x in found]), np.int64) + base for k in (0, 1))
    else:

        def run(text: str) -> tuple[np.ndarray, np.ndarray]:
            found = np.array(tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return found[:, 0], found[:, 1]

    return _ready.setdefault(path, run)


def line_starts(text: str) -> np.ndarray:
    """Starts of the lines of a text; a line holds its line break. Empty text: one empty line."""
    at = [0]
    while (found := text.find("\n", at[-1])) >= 0 and found + 1 < len(text):
        at.append(found + 1)
    return np.array(at, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section, by an interval join of the two ascending lists of spans.

    A token that crosses a boundary goes, whole, to the section of its first code point (`first`), of its last (`last`), or to
    the one of these two that holds more of it, the earlier on a tie (`most`).
    """
    a = np.searchsorted(sections, starts, side="right") - 1
    b = np.maximum(a, np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1)
    to = a if rule == "first" else b
    if rule == "most":
        bounds = np.append(sections, size)
        to = np.where(ends - sections[b] > bounds[a + 1] - starts, b, a)
    return np.bincount(to, minlength=len(sections)), np.bincount(to[a != b], minlength=len(sections))


def section_tokens(docs: DataFrame, tokenizer: str | None = None, rule: str = "first") -> DataFrame:
    """One row per line of every document: doc_id, section, start, end, n_tokens, n_crossing, n_doc_tokens.

    Lines are counted from 0 and hold their line break; their tokens sum to those of the whole document, n_doc_tokens. Null
    text: empty; empty text has one line without tokens. Repeated rows and null doc_ids: each row for itself. Other
    columns are ignored. No documents: an empty result.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = spanner(path)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in chunks(batch, most=2_000_000):
                lines = [line_starts(x) for x in texts]
                found = [spans(x) for x in texts]
                pairs = [attribute(a, b, s, len(x), rule) for (a, b), s, x in zip(found, lines, texts, strict=True)]
                sizes = np.array([len(s) for s in lines])
                last = np.repeat(np.array([len(x) for x in texts]), sizes)
                starts = np.concatenate(lines)
                ends = np.append(starts[1:], 0)
                final = np.cumsum(sizes) - 1
                ends[final] = last[final]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(at, at + len(texts)), sizes))),
                        pa.array((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)),
                        pa.array(starts), pa.array(ends),
                        pa.array(np.concatenate([x for x, _ in pairs]).astype(np.int64)), pa.array(np.concatenate([x for _, x in pairs]).astype(np.int64)),
                        pa.array(np.repeat(np.array([len(a) for a, _ in found], np.int64), sizes)),
                    ],
                    names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "n_doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(count, SECTIONS)
