"""Problem 7: encoding whole texts with a public byte-level BPE as a streaming transducer.

After a pre-token's first i bytes the encoder holds, for every reachable position, the one token that ends there in
the encoding of that prefix (byte-level BPE has exactly one: the token whose pairing with the token before it
survives the merge list). A later byte can only build on positions within the longest token, so everything that all
live positions agree on is stable and is emitted at once: memory is bounded by the lookahead, not by the text.
``lookahead`` is computed from the merge list. Decoding runs an incremental byte-to-text automaton.

Defined results
    null or empty text    the empty list
    special-token text    ordinary text: no special token is ever produced
    lone surrogates       can't occur in a Spark string
    very long texts       read whole; a run without a break is streamed, never cut
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published pre-token pattern of this vocabulary family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers, and the longest that it remembers.
MEMO, MEMO_BYTES = 200_000, 64


def _printable_bytes() -> dict[str, int]:
    """The published printable stand-in of every byte: itself if it prints, else the next free code point."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the split of every token, read from the tokenizer file's text."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        stand_in = _printable_bytes()
        self.tokens: dict[bytes, int] = {}
        for shown, n in model["vocab"].items():
            if all(c in stand_in for c in shown):
                self.tokens[bytes(stand_in[c] for c in shown)] = n
        ids = model["vocab"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.merge[a, b] = (rank, whole)
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (a, b), rank
        self.bytes_of = {n: t for t, n in self.tokens.items()}
        self.longest = max(map(len, self.tokens))
        self.merged_longest = max((len(self.bytes_of[n]) for n in self.rank), default=1)
        self.suffixes = {t[k:] for t in self.tokens for k in range(len(t))}
        self._fits: dict[tuple[int, int], bool] = {}

    @property
    def lookahead(self) -> int:
        """Bytes that must be held back at most before a live position can no longer be built on.

        It follows from the merge list: a later byte can only change boundaries under a token that some merge makes, so
        the longest result of a merge suffices, however long other entries of the vocabulary are.
        """
        return self.merged_longest

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is what the merge list makes of their bytes.

        Both are taken apart along the seam, latest merge first. The pair fails as soon as the two tokens at the
        seam have a merge that comes before the merge which hid them.
        """
        known = self._fits.get((a, b))
        if known is not None:
            return known
        left, right = a, b
        taken_left = taken_right = 1 << 60  # rank of the merge that takes the token at the seam away, on each side
        good = True
        while True:
            m = self.merge.get((left, right))
            # of equal ranks the leftmost goes first: the merge inside a before the seam, the seam before that inside b
            if m is not None and m[0] < taken_left and m[0] <= taken_right:
                good = False
                break
            ra, rb = self.rank.get(left, -1), self.rank.get(right, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                taken_left, left = ra, self.halves[left][1]
            else:
                taken_right, right = rb, self.halves[right][0]
        if len(self._fits) > MEMO * 5:
            self._fits.clear()
        self._fits[a, b] = good
        return good


class Transducer:
    """Bytes of one pre-token in, stable token ids out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = b""
        self.last = [-1]  # by position in the window: the token that ends there; position 0 is a final boundary
        self.before = -1  # the token that ends at position 0, if any

    def _ending(self, at: int) -> int:
        tokens, suffixes, fits, last = self.v.tokens, self.v.suffixes, self.v.fits, self.last
        for k in range(1, min(at, self.v.longest) + 1):
            piece = self.window[at - k : at]
            if piece not in suffixes:
                break
            token = tokens.get(piece)
            if token is not None:
                previous = self.before if at == k else last[at - k]
                if previous < 0 or fits(previous, token):
                    return token
        raise ValueError("the vocabulary lacks a single-byte token")

    def _boundaries(self, at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(at)
            at -= len(self.v.bytes_of[self.last[at]])
        return out

    def _emit(self, cut: int) -> list[int]:
        ends = self._boundaries(cut)[::-1]
        ids = [self.last[e] for e in ends]
        self.before = ids[-1]
        self.window, self.last = self.window[cut:], [-1, *self.last[cut + 1 :]]
        return ids

    def feed(self, data: bytes) -> list[int]:
        """Ids that no later byte can change."""
        out: list[int] = []
        step = self.v.lookahead
        for k in range(0, len(data), step):
            part = data[k : k + step]
            self.window += part
            for at in range(len(self.last), len(self.window) + 1):
                self.last.append(self._ending(at))
            if len(self.window) >= 2 * step:
                end = len(self.window)
                common = set(self._boundaries(end))
                for at in range(end - step + 1, end):
                    common.intersection_update(self._boundaries(at))
                if common:
                    out += self._emit(max(common))
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.window)) if self.window else []
        self.window, self.last, self.before = b"", [-1], -1
        return out


class _Memo(dict):
    """Packed ids (little-endian, four bytes each) by pre-token; a pre-token that isn't known runs through the transducer."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.transducer = Transducer(vocabulary)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = array("i", self.transducer.feed(data) + self.transducer.finish()).tobytes()
        if len(data) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, text: str):
        import regex

        self.vocabulary = Vocabulary(text)
        self.pieces = regex.compile(PATTERN).findall
        self.known = _Memo(self.vocabulary)

    def packed(self, text: str | None) -> bytes:
        """The ids of ``text``, four bytes each; the pre-tokens of a batch share what is known."""
        return b"".join(map(self.known.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


class Decoder:
    """Ids in, text out as soon as its bytes are complete; bytes that aren't UTF-8 come out as U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.machine.decode(self.bytes_of[n]) for n in ids)

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


@lru_cache(maxsize=4)
def _encoder(text: str) -> Encoder:
    return Encoder(text)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", count_only: bool = False) -> DataFrame:
    """(``id_col``, ``ids``), or with ``count_only`` (``id_col``, ``n_tokens``).

    The driver reads the tokenizer file, of fixed size, once and ships it to the workers.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(_read(path))
    source = documents.select(id_col, text_col)
    schema = T.StructType([source.schema[0], T.StructField("n_tokens", T.IntegerType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(shipped.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                packed = [encoder.packed(t.as_py()) for t in part.column(1)]
                sizes = np.array([len(x) // 4 for x in packed], np.int32)
                if count_only:
                    column = pa.array(sizes)
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, ``text``) of encoded documents; a null list gives null."""
    shipped = encoded.sparkSession.sparkContext.broadcast(_read(path))

    def text_of(ids: pd.Series) -> pd.Series:
        decoder = Decoder(_encoder(shipped.value).vocabulary)
        return pd.Series([None if x is None else decoder.feed(x) + decoder.finish() for x in ids], dtype=object)

    return encoded.select(id_col, F.pandas_udf(text_of, T.StringType())(ids_col).alias("text"))
