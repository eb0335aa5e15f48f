"""Byte-level BPE in linear time: longest matches, backtracking, memoised adjacency.

The bytes of the vocabulary are mapped to Latin-1 so that pyahocorasick can hold them.  A piece is
encoded from left to right with the longest token at each place.  A token may follow another only
if the merges would leave the border between the two as it is; that is decided once for each pair.
Where no token may follow, the last one is taken back and a shorter one is tried, and a place that
was left in this way is never entered again, so a piece of n bytes takes O(n) steps.  The result is
the one that applying the merges by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import session, texts_of

#: Entries of a memo at most.
MEMO = 1 << 18


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The definition of BPE: merge the adjacent pair of lowest rank until none has a rank under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank >= (1 << 60 if below is None else below):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Codec:
    """Encoder and decoder of one vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
            else:
                parts = merge_by_rank(token, ranks, rank)
                if len(parts) != 2:
                    continue  # no sequence of merges makes it: only a piece that equals it gets it
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.split[rank], self.joined[pair] = pair, rank
            self.length[rank] = len(token)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = {rank: self._prefix(self.bytes_of[rank]) for rank in self.length}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix of this token, or -1."""
        for n in range(len(token) - 1, 0, -1):
            r = self.ranks.get(token[:n])
            if r is not None and r in self.length:
                return r
        return -1

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges keep the border between two tokens.

        The border is lost if a merge across it comes before the merges that build the tokens on
        either side.  The tokens are taken apart from the latest merge back, and at each state
        the merge across is compared with the merge undone last; equal ranks go to the left one.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self._may_follow(left, right)
            if len(self.fits) >= MEMO:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        bound = 1 << 60  # merges across of at least this rank come too late
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left, undo_right = self.split[left][1] != left, self.split[right][0] != right
            if not undo_left and not undo_right:
                return True
            if undo_left and (left > right or not undo_right):
                bound, left = left, self.split[left][1]
            else:
                bound, right = right + 1, self.split[right][0]

    def _encode(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        if whole is not None:
            return array("I", (whole,)).tobytes()
        n, length, fits, shorter = len(piece), self.length, self.fits, self.shorter
        longest = [-1] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):  # by end, the longest first
            start = end - length[rank] + 1
            longest[start] = rank  # a later match at this start is longer
        out: list[int] = []
        shut: set[int] = set()
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + length[token]
            if end not in shut:
                ok = last < 0
                if not ok:
                    ok = fits.get((last, token))
                    if ok is None:
                        ok = self.may_follow(last, token)
                if ok:
                    out.append(token)
                    last, at = token, end
                    if at < n:
                        token = longest[at]
                    continue
            token = shorter[token]
            if token < 0:  # nothing may stand here: take the last token back and shorten it
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte")
                shut.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self.pieces, []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = self._encode(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) >= MEMO:  # the memo of before holds what is used often
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


_CODECS: dict[str, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, built once in each Python process."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Return ``key, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, a binary, ``with_ids``) for every row.

    ``vocabulary`` is the path of a tiktoken file, read on the driver and sent to the executors (a
    few MB; its size does not follow the documents).  Null texts count as empty: no ids, and the
    digests of nothing.  A piece of any length is encoded in time linear in it.  Repeated rows give
    equal rows; other columns are not read; empty tables give empty results.  Rows stay where they
    are: there is no shuffle.
    """
    spark = session(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = codec(data.value, pattern), None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows: list[tuple[int, str, str, bytes]] = []
                for x in texts_of(batch.column(1), start, 64):
                    if last is None or x != last[0]:  # copies that follow each other are encoded once
                        ids = own.encode(x)
                        last = (x, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), ids))
                    rows.append(last[1])
                columns = [batch.column(0).slice(start, 64), *(pa.array(c) for c in zip(*rows, strict=True))]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
                yield pa.RecordBatch.from_arrays(columns[: 4 + with_ids], names[: 4 + with_ids])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
