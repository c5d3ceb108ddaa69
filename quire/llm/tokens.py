"""Token ids of whole texts, as little-endian unsigned 32-bit binaries."""

from __future__ import annotations

import array
import base64
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


class _Odd(Exception):
    """A white-space run of two or more: the words around it aren't independent."""


class Encoder(dict):
    """Byte-level BPE ids of a text, kept by word.

    The pattern that cuts a text before merging starts a new piece at every space that a
    non-space follows, so a space and the run after it have the same ids in any text. Words
    are therefore looked up one by one; texts with longer white space are encoded whole. With json_path, a
    tokenizer file of the same vocabulary, texts that hold one of its added tokens are left to that tokenizer.
    """

    def __init__(self, ranks_path: str, most: int = 300_000, json_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most
        self.whole, self.added = None, ()
        if json_path:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(json_path)
            self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.tails = {c: self.pack(self.plain(c)) for c in ".,;:!?"}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        a = array.array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Odd
        if len(word) > 2 and word[-1] in self.tails and word[:-1].isalpha():
            out = self[word[:-1]] + self.tails[word[-1]]
        else:
            out = self.pack(self.plain(" " + word))
        if len(word) <= 32:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of the text; none for an empty one."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.pack(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self) > self.most:
            self.clear()
        head, *rest = text.split(" ")
        try:
            if not head and rest:
                raise _Odd
            return self.pack(self.plain(head)) + b"".join(map(self.__getitem__, rest))
        except _Odd:
            return self.pack(self.plain(text))


def default_ranks() -> str:
    """The 50k byte-level vocabulary of byte_bpe_50k.json, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_json() -> str:
    """The tokenizer file of that vocabulary, with its added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids of every document of (doc_id, text), each with end_id appended.

    A document of more than size ids is cut into pieces of size, the first of which may be shorter;
    start counts the document's ids before a piece. The text of an added token (<|endoftext|>) is plain text, unless
    json_path names the tokenizer file whose added tokens count. Null texts count as empty: one piece, end_id alone.
    Repeated rows and null doc_ids keep their pieces; an empty table gives none.
    """
    path = ranks_path or default_ranks()
    tail = Encoder.pack([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, json_path=json_path)
        for batch in batches:
            doc, piece, start, length, ids = [], [], [], [], []
            held = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder.encode(text.as_py()) + tail
                n = len(data) // 4
                at, step = 0, n % size or size
                k = 0
                while at < n:
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(step)
                    ids.append(data[4 * at : 4 * (at + step)])
                    at, step, k = at + step, size, k + 1
                held += len(data)
                if held > 16_000_000:
                    yield made()
                    doc, piece, start, length, ids = [], [], [], [], []
                    held = 0
            yield made()

    return pick(docs, "doc_id", "text").mapInArrow(cut, PIECES_SCHEMA)
