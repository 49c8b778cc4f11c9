"""Token counts by a compiled finite-state transducer whose chunk maps compose through a prefix scan.

**The machine.**  The vocabulary's merges are compiled to a deterministic transducer over characters; each transition is
annotated with the tokens it emits, and a closing transition (a blank, a special string, the end) with those still open.
Between pre-tokens there is one state.  Within a pre-token a state is, for each place where a vocabulary entry that has
begun may still end further on, a triple: the entry's node in the trie of all entries, the last token of the encoding up to
that place, and the tokens emitted up to there, less those up to here.  Reading a byte moves the nodes; the token that now
ends the encoding is the one that stands beside its predecessor in a valid way, and exactly one does.  Two neighbours are
valid when no merge across their border comes before the merges that made them.  Counts in a state are relative and places
are bounded by the longest entry, so the states are finitely many.  They are compiled when first reached and kept in a
bounded table (as a lazy automaton's are); paths from blank to blank that were walked once are kept as one transition.

**Chunk maps.**  A chunk's map says what the chunk does to whatever state it is entered in: (head, count, exit) are the
characters up to the first blank or special string, the tokens emitted from there on, and the state that the chunk ends in.
A chunk without one is all head.  Maps compose by reading the right one's head from the left one's exit; this is
associative, so the maps of a text are composed pairwise, level by level.  Normalisation (NFC, lower case) is done in
chunks: cuts fall only before characters that no character before them combines with and that special strings don't hold
inside.

Defined results: a null text is empty (0 tokens); repeated rows are each counted; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache, partial
from unicodedata import is_normalized, normalize

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scanner
from .common import Recent, by_chunks

#: Characters of a chunk; bounds of the tables of transitions and of a generation of kept paths, and the longest kept path.
CHUNK, TRANSITIONS, PATHS, PATH_BYTES = 1 << 14, 400_000, 250_000, 64
#: Fixed value: the mark of a unit that ends a pre-token.
END = "</w>"
BLANKS = re.compile("[\t-\r ]")
#: The pre-tokens of lower-case ASCII without blanks and quotes.
RUNS = re.compile(b"[a-z]+|[0-9]|[^a-z0-9]+")
OPEN = "'"  # a contraction may have begun: the state holds what was read of it


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of_unit() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Merges:
    """Tokens as numbers: byte b is b, byte b that ends a pre-token is 256 + b, the result of merge r is 512 + r."""

    def __init__(self, merges: list[list[str]]):
        unit = byte_of_unit()
        number = {c: b for c, b in unit.items()} | {c + END: 256 + b for c, b in unit.items()}
        self.units: list[tuple[int, ...]] = [(s,) for s in range(512)]
        self.parts: list[tuple[int, int] | None] = [None] * 512
        self.rank: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = number[left], number[right]
            self.rank[pair] = len(self.units)
            number[left + right] = len(self.units)
            self.units.append(self.units[pair[0]] + self.units[pair[1]])
            self.parts.append(pair)
        self.child: dict[int, int] = {}  # node * 512 + unit -> node of the trie
        self.token, self.inner = [-1], [True]  # a node's token; whether entries go on below it
        for t, units in enumerate(self.units):
            node = 0
            for u in units:
                below = self.child.get(node * 512 + u)
                if below is None:
                    below = self.child[node * 512 + u] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = below
            self.token[node] = t
        self._valid: dict[int, bool] = {}
        self._reachable: dict[int, bool] = {}

    def _spine(self, t: int, side: int) -> list[int]:
        """The tokens at one edge of t while it is built, t last."""
        out = [t]
        while self.parts[t] is not None:
            t = self.parts[t][side]
            out.append(t)
        return out[::-1]

    def _first_across(self, a: int, b: int) -> float:
        """The number of the first merge across the border of a and b; infinite where both are complete before any."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else float("inf")
            next_right = right[j + 1] if j + 1 < len(right) else float("inf")
            across = self.rank.get((left[i], right[j]), float("inf"))
            if across < next_left and across <= next_right:  # at equal merges the place further left comes first
                return across
            if next_left == next_right == float("inf"):
                return float("inf")
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def reachable(self, t: int) -> bool:
        """Whether the encoding of t's own units is t."""
        found = self._reachable.get(t)
        if found is None:
            pair = self.parts[t]
            found = self._reachable[t] = pair is None or (self.reachable(pair[0]) and self.reachable(pair[1]) and self._first_across(*pair) == t)
        return found

    def valid(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: nothing before)."""
        if a < 0:
            return self.reachable(b)
        found = self._valid.get(a << 20 | b)
        if found is None:
            found = self.reachable(b) and self._first_across(a, b) == float("inf")
            if len(self._valid) < 2 * TRANSITIONS:
                self._valid[a << 20 | b] = found
        return found

    def step(self, state: tuple, unit: int) -> tuple[tuple, int]:
        """The state after a unit, and the tokens that it adds."""
        alive, last, delta = [], -1, 0
        for node, before, count in state:  # the longest token first
            node = self.child.get(node * 512 + unit, 0)
            if node:
                t = self.token[node]
                if last < 0 <= t and self.valid(before, t):
                    last, delta = t, count + 1
                if self.inner[node]:
                    alive.append((node, before, count))
        return (*((n, t, c - delta) for n, t, c in alive), (0, last, 0)), delta


    def last(self, state: tuple, unit: int) -> int:
        """The tokens that a unit adds which nothing follows."""
        for node, before, count in state:
            node = self.child.get(node * 512 + unit, 0)
            if node and (t := self.token[node]) >= 0 and self.valid(before, t):
                return count + 1
        raise AssertionError("no token ends here")


FRESH = ((0, -1, 0),)
#: Between pre-tokens: (kind of the open pre-token, its state without its last byte, that byte).
START = ("", FRESH, 0)


class CountTransducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges([m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special, self.mark = re.compile("|".join(map(re.escape, special))), special[0][:2]
        inside = {c for s in special for c in s[1:]}
        plain = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        self.sure = re.compile(f"[{plain}ぁ-ゖァ-ヺ一-鿿가-힣]")
        self._anew()
        self.paths = Recent(self._path, PATHS, PATH_BYTES)

    def _anew(self) -> None:
        """Empty tables.  States are values, so nothing else changes."""
        self.within: list[tuple] = [FRESH]  # states within a pre-token
        self.within_index: dict[tuple, int] = {FRESH: 0}
        self.bytes: dict[int, tuple[int, int]] = {}  # state << 8 | byte -> (state, tokens emitted)
        self.states: list[tuple] = [("", 0, 0)]  # of the whole machine; within a pre-token by number
        self.index: dict[tuple, int] = {("", 0, 0): 0}
        self.table: dict[int, tuple[int, int]] = {}  # state << 21 | character -> (state, tokens emitted)

    def _entered(self, state: tuple) -> int:
        """The number of a state that is given as a value."""
        kind, inner, waiting = state
        at = self.within_index.get(inner)
        if at is None:
            at = self.within_index[inner] = len(self.within)
            self.within.append(inner)
        return self._number((kind, at, waiting))

    def _number(self, state: tuple) -> int:
        at = self.index.get(state)
        if at is None:
            at = self.index[state] = len(self.states)
            self.states.append(state)
        return at

    # --- transitions ---------------------------------------------------------------------------------------------------

    def _byte(self, at: int, byte: int) -> tuple[int, int]:
        """The transition on a byte that does not end its pre-token, entered into the table."""
        after, n = self.merges.step(self.within[at], byte)
        to = self.within_index.get(after)
        if to is None:
            to = self.within_index[after] = len(self.within)
            self.within.append(after)
        self.bytes[at << 8 | byte] = to, n
        return to, n

    def _within(self, state: tuple, kind: str, data: bytes) -> tuple[tuple, int]:
        """Bytes of a pre-token that goes on or begins; the last byte waits, since it may end the pre-token."""
        _, at, waiting = state
        n = 0
        units = (bytes([waiting]) if state[0] else b"") + data
        for u in units[:-1]:
            at, e = self.bytes.get(at << 8 | u) or self._byte(at, u)
            n += e
        return (kind, at, units[-1]), n

    def _close(self, state: tuple) -> int:
        """Tokens emitted when the text ends here, or a boundary follows."""
        if state[0].startswith(OPEN):  # what looked like a contraction is none: its quote stands alone
            state, n = self._broken(state)
            return n + self._close(state)
        return self.merges.last(self.within[state[1]], 256 + state[2]) if state[0] else 0

    def _broken(self, state: tuple) -> tuple[tuple, int]:
        after, n = self._within(self.states[0], "O", b"'")
        for c in state[0][1:]:
            after, e = self._read(after, c)
            n += e
        return after, n

    def _read(self, state: tuple, c: str) -> tuple[tuple, int]:
        if state[0].startswith(OPEN):
            seen = state[0] + c
            if seen in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"):
                return self.states[0], self._alone(seen)
            if seen in ("'r", "'v", "'l"):
                return (seen, 0, 0), 0
            after, n = self._broken(state)
            after, e = self._read(after, c)
            return after, n + e
        kind = scanner.kind(c)
        if kind == state[0]:
            return self._within(state, kind, c.encode())
        closed = self._close(state)
        if kind == "S":
            return self.states[0], closed
        if kind == "N":
            return self.states[0], closed + self._alone(c)
        if c == "'":
            return (OPEN, 0, 0), closed
        after, n = self._within(self.states[0], kind, c.encode())
        return after, closed + n

    def _alone(self, word: str) -> int:
        state, n = self._within(self.states[0], "L", word.encode())
        return n + self._close(state)

    def compile(self, at: int, c: str) -> tuple[int, int]:
        """The transition of a state on a character, entered into the table."""
        after, n = self._read(self.states[at], c)
        found = self.table[at << 21 | ord(c)] = self._number(after), n
        return found

    def _walk(self, state: tuple, text: str) -> tuple[int, int]:
        if len(self.table) + len(self.bytes) > TRANSITIONS:
            self._anew()
        at, table, total = self._entered(state), self.table, 0
        for c in text:
            at, n = table.get(at << 21 | ord(c)) or self.compile(at, c)
            total += n
        return at, total

    def walk(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state after a text, as a value, and the tokens emitted on the way."""
        at, total = self._walk(state, text)
        kind, inner, waiting = self.states[at]
        return (kind, self.within[inner], waiting), total

    def closed(self, state: tuple) -> int:
        """Tokens still open in a state given as a value."""
        return self._close(self.states[self._entered(state)])

    def _path(self, word: bytes) -> int:
        """Tokens of a path from blank to blank."""
        if not word.isalpha():
            if word.isascii() and b"'" not in word and len(runs := RUNS.findall(word)) > 1:  # every run ends between pre-tokens
                return sum(map(self.paths.__getitem__, runs))
            at, n = self._walk(START, word.decode())
            return n + self._close(self.states[at])
        if len(self.table) + len(self.bytes) > TRANSITIONS:
            self._anew()
        at, table, total = 0, self.bytes, 0
        for u in word[:-1]:
            at, n = table.get(at << 8 | u) or self._byte(at, u)
            total += n
        return total + self.merges.last(self.within[at], 256 + word[-1])

    # --- chunks --------------------------------------------------------------------------------------------------------

    def cut(self, text: str, chunk: int = CHUNK) -> list[str]:
        out, at = [], 0
        while len(text) - at > chunk:
            found = self.sure.search(text, at + chunk)
            if found is None:
                break
            out.append(text[at : found.start()])
            at = found.start()
        return [*out, text[at:]]

    def normal(self, text: str) -> str:
        if not text.isascii() and not is_normalized("NFC", text):
            text = normalize("NFC", text)
        return scanner.lower(text)

    def part(self, text: str) -> tuple[int, str, bool, int, tuple]:
        """The map of a chunk: (its bytes, head, whether anything follows the head, tokens from there on, exit)."""
        size = len(text.encode())
        between = [self.normal(x) for x in (self.special.split(text) if self.mark in text else [text])]
        found = BLANKS.search(between[0])
        if found is None and len(between) == 1:
            return size, between[0], False, 0, START
        at = found.start() if found else len(between[0])
        head, between[0], n = between[0][:at], between[0][at:], len(between) - 1
        for k, run in enumerate(between):
            words = run.encode().split()
            if k == len(between) - 1:
                last = words.pop().decode() if words and not BLANKS.match(run[-1]) else ""
            n += sum(map(self.paths.__getitem__, words))
        exit_, e = self.walk(START, last)
        return size, head, True, n + e, exit_

    def compose(self, a: tuple, b: tuple) -> tuple:
        if not a[2]:
            return a[0] + b[0], a[1] + b[1], b[2], b[3], b[4]
        state, n = self.walk(a[4], b[1])
        if not b[2]:
            return a[0] + b[0], a[1], True, a[3] + n, state
        return a[0] + b[0], a[1], True, a[3] + n + self.closed(state) + b[3], b[4]

    def join(self, maps: list[tuple]) -> tuple[int, int]:
        """(bytes, tokens) of the text whose chunks have these maps."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        size, head, more, n, exit_ = maps[0]
        return size, (self.paths[head.encode()] if head else 0) + (n + self.closed(exit_) if more else 0)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.join([self.part(x) for x in self.cut(text, chunk)])[1]


@lru_cache(2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(_id, n_bytes, n_tokens) for each row.  Only chunks of texts longer than ``chunk`` are shuffled."""
    return by_chunks(docs, partial(transducer, path or default_path()), "n_bytes long, n_tokens long", chunk, id_col, text_col)


def query(docs: DataFrame, limit: int = 2048) -> DataFrame:
    return count_tokens(docs).select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
