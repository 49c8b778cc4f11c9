"""Byte-level BPE encoding and decoding: overlapping chunks, stitched where their pre-token boundaries meet again.

A text is cut into chunks, each with an overlap into the next, and every chunk is pre-tokenised on its own, in any task.  A
chunk's first boundaries depend on where the cut fell; the pattern has no look-behind, so from the first position where a
chunk and its left neighbour both have a boundary, both give the same pre-tokens.  Such a position exists in every overlap:
an overlap holds a blank after a character that is none, which is a boundary wherever one starts, or it runs to the end of
the text.  Each chunk encodes its pre-tokens up to where its right neighbour takes over (it finds that position itself, in
the overlap) and notes how many ids its own first boundaries come after; stitching drops the ids before the position that
the left neighbour names.  A pre-token is encoded by rank merges over its bytes; decoding concatenates each id's bytes.

Defined results: a null text is an empty one (no ids); repeated rows are each encoded; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scanner
from .common import Recent, by_chunks

CHUNK, OVERLAP, MEMO = 1 << 14, 1 << 9, 250_000
#: A boundary wherever pre-tokenisation starts: between a character that is no blank and a blank.
SURE = re.compile(f"[^{scanner.SPACE}][{scanner.SPACE}]")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def merged(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The ids of one pre-token: the neighbours of least rank, leftmost first, become one, until none can."""
    if len(word) > 96:
        return _merged_long(ranks, word)
    never = len(ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], never) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < never:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
    return [ranks[p] for p in parts]


def _merged_long(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same by a heap of candidate pairs over a linked list of parts; a pair changed since it was pushed is passed over."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts at each position
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not live[i] or middle >= n or end[middle] != stop:
            continue
        live[middle] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if array("I", [1]).tobytes()[0] != 1:
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encodes by the ranks in a file; ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, digest: bool = False):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.digest = digest
        self.bytes_of = {packed([v]): k for k, v in self.ranks.items()}
        self.memo = Recent(self.word, MEMO, 64)

    def word(self, word: str) -> bytes:
        data = word.encode()
        whole = self.ranks.get(data)
        return packed(merged(self.ranks, data) if whole is None else [whole])

    def encoded(self, words: list[str]) -> list[bytes]:
        return list(map(self.memo.__getitem__, words))

    def ids(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return self.stitched([self.part(x) for x in self.cut(text, chunk, overlap)])

    # --- chunks --------------------------------------------------------------------------------------------------------

    def cut(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """Chunks with their overlaps, each as "length of the overlap at its end:text"."""
        out, at = [], 0
        while len(text) - at > chunk:
            cut = at + chunk
            sure = SURE.search(text, cut)
            if sure is None:
                break
            if sure.start() + 1 - cut > chunk:  # no boundary is sure for long: the chunk goes on up to one
                cut = sure.start()
            end = min(len(text), max(cut + overlap, sure.start() + 2))
            out.append(f"{end - cut}:{text[at:end]}")
            at = cut
        return [*out, f"0:{text[at:]}"]

    def part(self, piece: str) -> tuple[dict[int, int], bytes, int]:
        """(bytes of ids before each early boundary, ids up to where the next chunk takes over, that place in the next)."""
        size, _, text = piece.partition(":")
        overlap = int(size)
        find = scanner.byte_level(text)
        words = find.findall(text)
        meet = 0
        if overlap:
            cut = len(text) - overlap
            theirs, p = {0}, 0
            for w in find.findall(text[cut:]):
                p += len(w)
                theirs.add(p)
            theirs.discard(overlap)  # what ends the chunk may go on
            p = 0
            for k, w in enumerate(words):
                if p >= cut and p - cut in theirs:
                    meet, words = p - cut, words[:k]
                    break
                p += len(w)
            else:
                raise AssertionError("no common boundary in an overlap")
        sure = SURE.search(text)  # the left neighbour takes leave here at the latest
        ids, early, p, n = self.encoded(words), {}, 0, 0
        for w, x in zip(words, ids, strict=True):
            if sure and p > sure.start() + 1:
                break
            early[p] = n
            p, n = p + len(w), n + len(x)
        early[p] = n
        return early, b"".join(ids), meet

    @staticmethod
    def stitched(parts: list[tuple[dict[int, int], bytes, int]]) -> bytes:
        out, at = [], 0
        for early, ids, meet in parts:
            out.append(ids[early[at] :])
            at = meet
        return b"".join(out)

    def join(self, parts: list[tuple[dict[int, int], bytes, int]]) -> tuple[int, bytes, bytes]:
        """(n_tokens, ids, what they decode to), or the SHA-256 of both."""
        ids = self.stitched(parts)
        back = self.decode(ids)
        if self.digest:
            return len(ids) // 4, hashlib.sha256(ids).hexdigest().encode(), hashlib.sha256(back).hexdigest().encode()
        return len(ids) // 4, ids, back

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.bytes_of[ids[i : i + 4]] for i in range(0, len(ids), 4)])


@lru_cache(4)
def codec(path: str, digest: bool = False) -> Codec:
    return Codec(path, digest)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(_id, n_tokens, _ids, _decoded): packed ids and the bytes they decode to, or the SHA-256 of both.

    Only chunks of texts longer than ``chunk`` are shuffled.
    """
    return by_chunks(docs, partial(codec, path or default_ranks(), digest), "n_tokens long, _ids binary, _decoded binary", chunk, id_col, text_col)


def query(docs: DataFrame) -> DataFrame:
    return encode(docs, digest=True).select(F.col("_id").alias("doc_id"), "n_tokens", F.col("_ids").cast("string").alias("ids_sha256"), F.col("_decoded").cast("string").alias("decoded_sha256"))
