"""Token ids of whole texts with a public tokenizer, fast enough for a corpus.

A byte-level BPE never merges across its pre-tokens, and one space followed by a non-space always starts a pre-token.
So a text is cut at such spaces, each distinct piece is encoded once per Python worker, and the ids of a text are the
joined ids of its pieces: the same ids as encoding the whole text (tests compare them). Pieces of
characters below U+0250, on whose classes all versions of Unicode agree, are split here, all others by the library's own
pre-tokenizer, since its tables of letters and numbers are those that count. Literals of the vocabulary's
added tokens (such as an end-of-text mark) get their own id, as the library does by itself; the text between them is
encoded apart. The caches are bounded; a full one is emptied, which costs time, not correctness.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import relieve

PIECES, WORDS = 900_000, 900_000
_MARKS = ".,;:!?"
_STABLE = re.compile("[\0-\u024f]*").fullmatch


class Pieces(dict):
    """Ids of pieces (without their leading space); an unknown one is encoded when first asked for."""

    def __init__(self, encoder: TextEncoder):
        super().__init__()
        self.encoder, self.words, self.merge = encoder, encoder.words, encoder.merge
        self.code, self.alphabet = encoder.code, encoder.alphabet
        self.marks = {m: encoder._ids(m) for m in _MARKS}

    def __missing__(self, piece: str) -> bytes:
        # a piece of letters is one word; the same with a mark at its end shares that word's ids
        if piece.isalpha():
            if piece.isascii():
                own = "\u0120" + piece
            elif _STABLE(piece):
                own = "\u0120" + piece.encode().decode("latin-1").translate(self.alphabet)
            else:
                own = None
            ids = self[piece] = self.encoder.foreign(" " + piece) if own is None else array(self.code, [t.id for t in self.merge(own)]).tobytes()
            return ids
        if not piece.isascii() and not _STABLE(piece):
            ids = self[piece] = self.encoder.foreign(" " + piece)
            return ids
        if piece[-1:] in self.marks and (word := piece[:-1]).isalpha():
            ids = self[piece] = self[word] + self.marks[piece[-1]]
            return ids
        ids = b""
        for w in self.encoder.split(" " + piece):
            own = self.words.get(w)
            if own is None:
                own = self.words[w] = self.encoder._ids(w)
            ids += own
        self[piece] = ids
        return ids


class TextEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes (2 where the vocabulary fits)."""

    def __init__(self, tokenizer_path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self._require_byte_level(json.loads(self.tok.to_str()))
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.dtype = np.dtype(f"<u{self.width}")
        self.split = regex.compile(PATTERN).findall
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # words are kept here; the model's own cache would only be written
        self.merge, self.library = self.tok.model.tokenize, self.tok.pre_tokenizer.pre_tokenize_str
        # the byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the other bytes follow from 256 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.odd = regex.compile(r" (?:\s|$)").search
        self.cut = regex.compile(r" (?=\S)").split
        self.added = {t.content: array(self.code, [i]).tobytes() for i, t in self.tok.get_added_tokens_decoder().items()}
        # the leftmost literal counts, of those that start together the longest
        literals = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, literals)) + ")").split if literals else None
        self.words: dict[str, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        self.pieces = Pieces(self)

    @staticmethod
    def _require_byte_level(spec: dict) -> None:
        """ValueError unless cutting texts at spaces gives the ids of the whole text for this tokenizer."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model["type"] == "BPE"
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not plain or odd or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("this encoder takes byte-level BPE tokenizers without normalizer, prefix space or stripping added tokens")

    def _ids(self, word: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's own merges over its byte alphabet."""
        if word.isascii() and word[1:].isalpha():
            own = "\u0120" + word[1:] if word[0] == " " else word if word[0].isalpha() else word.translate(self.alphabet)
        else:
            own = word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.merge(own)]).tobytes()

    def foreign(self, piece: str) -> bytes:
        """Ids of a piece with characters from U+0250 on, split by the library into words of its byte alphabet."""
        own = b""
        for w, _ in self.library(piece):
            ids = self.spelled.get(w)
            if ids is None:
                ids = self.spelled[w] = array(self.code, [t.id for t in self.merge(w)]).tobytes()
            own += ids
        return own

    def _parts(self, text: str) -> list[str]:
        """The pieces of a text, without the space that starts each but the first."""
        return self.cut(text) if self.odd(text) else text.split(" ")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as bytes."""
        out = []
        for text in texts:
            if self.marks and any(m in text for m in self.added):
                out.append(b"".join(self.added.get(t) or self._plain(t) for t in self.marks(text) if t))
            else:
                out.append(self._plain(text))
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            if len(self.words) > WORDS:
                self.words.clear()
            if len(self.spelled) > WORDS:
                self.spelled.clear()
        return out

    def _plain(self, text: str) -> bytes:
        parts = self._parts(text)
        return self._first(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:]))

    def _first(self, piece: str) -> bytes:
        if not _STABLE(piece):
            return self.foreign(piece)
        return b"".join(self.words.get(w) or self._ids(w) for w in self.split(piece))

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, so that its caches serve all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (binary, little-endian, 2 bytes each where the vocabulary fits, else 4).

    ``end_id`` is appended to every row. A null text counts as empty; null and repeated doc_ids stay as they are; other
    columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        relieve()
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                ids = [x + end for x in enc.encode_many([t or "" for t in texts.slice(at, 500).to_pylist()])]
                n = pa.array([len(x) // enc.width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")
