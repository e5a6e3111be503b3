"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A token sequence is what the merges make of a text exactly if they leave every pair of
neighbouring tokens apart when given the two alone: the first merge across a boundary would
already happen between the two tokens at it.  So the tokens of every prefix of a text are those
of a shorter prefix and one more token, which is unique.  The machine reads a byte and gives
that last token of the prefix.  It has to know the bytes of the longest token that may still be
open, and the last token at each place where such a token may have begun: that is a state.
States and their steps are made when first reached.  A token is certain, and emitted, once all
places where the next one may begin have it behind them, so the lookahead is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, free_names, text_bytes

#: states, pairs and pieces that a task remembers; what goes beyond is worked out again each time
STATES, PAIRS, PIECES, PIECE_BYTES = 30_000, 250_000, 250_000, 40
NEVER = 1 << 62
#: bytes of a piece after which certain tokens are emitted
FLUSH = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and rank, as the rank files of public tokenizers have them."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def merged(ranks: dict[bytes, int], text: bytes) -> list[int]:
    """Plain merging: always the leftmost pair of least rank."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == NEVER:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class State:
    """``open``: longest end of the text that begins a longer token; ``lasts``: the last token of
    the text, and of the text less 1, 2, ... bytes, for every place inside ``open``."""

    __slots__ = ("open", "lasts", "last", "go")

    def __init__(self, open_bytes: bytes, lasts: tuple):
        self.open, self.lasts, self.last, self.go = open_bytes, lasts, lasts[0], {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.names = names_of(ranks)
        self.starts = {token[:n] for token in ranks for n in range(1, len(token))}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, list] = {}
        self.ends: dict[tuple, tuple] = {}
        self.states: dict[tuple, State] = {}
        self.start = State(b"", (-1,))

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges leave ``right`` after ``left`` (or alone, after -1)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self._history(right)[-1][0] == NEVER and (left < 0 or self._meets(left, right))
        self.pairs[(left + 1) << 32 | right] = found
        return found

    def _history(self, token: int) -> list[tuple]:
        """``(rank of the next merge, first part, last part)`` after each merge of a token's bytes.
        The last rank is ``NEVER``, or 0 if the merges do not end in the one token."""
        found = self.histories.get(token)
        if found is None:
            parts, found = [bytes((b,)) for b in self.names[token]], []
            while True:
                rank, i = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
                if rank == NEVER:
                    break
                found.append((rank, parts[0], parts[-1]))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            found.append((NEVER if len(parts) == 1 else 0, parts[0], parts[-1]))
            self.histories[token] = found
        return found

    def _meets(self, left: int, right: int) -> bool:
        """Play the merges of both tokens by rank; apart if none across the boundary comes first."""
        ours, theirs = self._history(left), self._history(right)
        i = j = 0
        while True:
            (mine, _, end), (other, start, _) = ours[i], theirs[j]
            across = self.ranks.get(end + start, NEVER)
            if across < mine and across <= other:
                return False
            if mine <= other:
                if mine == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _ends(self, open_bytes: bytes, byte: int) -> tuple:
        """Tokens that may end with ``byte`` as (length less one, rank), longest first, and the
        bytes that stay open after it."""
        text = open_bytes + bytes((byte,))
        tokens = tuple((len(text) - i - 1, rank) for i in range(len(text)) if (rank := self.ranks.get(text[i:])) is not None)
        still = next((text[i:] for i in range(len(text)) if text[i:] in self.starts), b"")
        if len(self.ends) >= PAIRS:
            self.ends.clear()
        self.ends[open_bytes, byte] = tokens, still
        return tokens, still

    def _step(self, state: State, byte: int) -> State:
        tokens, still = self.ends.get((state.open, byte)) or self._ends(state.open, byte)
        lasts, pairs = state.lasts, self.pairs
        for before, rank in tokens:
            apart = pairs.get((lasts[before] + 1) << 32 | rank)
            if apart or apart is None and self._apart(lasts[before], rank):
                break
        key = still, (rank, *lasts[:len(still)])
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = State(*key)
        state.go[byte] = new
        return new

    def encode(self, text: bytes) -> bytes:
        """Ids of one piece as native unsigned 32-bit integers."""
        state, tails, out, full, i = self.start, [], [], len(self.states) >= self.limit, 0
        for i, byte in enumerate(text):
            new = state.go.get(byte)
            if new is None:
                if full:
                    self._on(text[i:], state.open, tails, out)
                    break
                new = self._step(state, byte)
            state = new
            tails.append(state.last)
            if len(tails) >= FLUSH:
                self._flush(tails, len(state.open), out)
        done, at, names = [], len(tails), self.names
        while at > 0:
            done.append(tails[at - 1])
            at -= len(names[done[-1]])
        out += reversed(done)
        return array("I", out).tobytes()

    def _on(self, text: bytes, still: bytes, tails: list[int], out: list[int]) -> None:
        """Go on without making states, once the table is full: the same steps on plain lists."""
        ends, pairs = self.ends, self.pairs
        for byte in text:
            tokens, still = ends.get((still, byte)) or self._ends(still, byte)
            n = len(tails) - 1
            for before, rank in tokens:
                left = tails[n - before] if before <= n else out[-1] if out else -1
                apart = pairs.get((left + 1) << 32 | rank)
                if apart or apart is None and self._apart(left, rank):
                    break
            tails.append(rank)
            if len(tails) >= FLUSH:
                self._flush(tails, len(still), out)

    def _flush(self, tails: list[int], still: int, out: list[int]) -> None:
        """Move tokens that all places where the next token may begin have behind them."""
        paths, n = [], len(tails)
        for at in range(n - still, n + 1):
            path = {}
            while at > 0:
                path[at] = tails[at - 1]
                at -= len(self.names[path[at]])
            paths.append(path)
        sure = sorted(set(paths[0]).intersection(*paths[1:]))
        if sure:
            out += [paths[0][at] for at in sure]
            del tails[:sure[-1]]


class Pieces(dict):
    """Ids of pieces seen before; a piece that is a token as a whole is that token."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.machine = ranks, Transducer(ranks)

    def __missing__(self, piece: str) -> bytes:
        text = piece.encode()
        rank = self.ranks.get(text)
        ids = self.machine.encode(text) if rank is None else array("I", (rank,)).tobytes()
        if len(text) <= PIECE_BYTES and len(self) < PIECES:  # frequent pieces come early
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.split, self.pieces = regex.compile(pattern).findall, Pieces(ranks)

    def __call__(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return little(b"".join(map(self.pieces.__getitem__, self.split(text))))


def little(ids: bytes) -> bytes:
    if array("I", b"\1\0\0\0")[0] == 1:
        return ids
    values = array("I", ids)
    values.byteswap()
    return values.tobytes()


def utf8_steps() -> dict[tuple, dict[int, tuple]]:
    """Steps of the UTF-8 machine: state -> byte -> state.  A state is the range that the next byte
    must lie in and the number of bytes after that one; ``START`` is the end of a character."""
    tail = lambda left: (0x80, 0xBF, left)
    # fixed values: lead bytes of characters of two to four bytes and the range of their second byte
    leads = {(0xC2, 0xDF): tail(0), (0xE0, 0xE0): (0xA0, 0xBF, 1), (0xE1, 0xEC): tail(1), (0xED, 0xED): (0x80, 0x9F, 1), (0xEE, 0xEF): tail(1),
             (0xF0, 0xF0): (0x90, 0xBF, 2), (0xF1, 0xF3): tail(2), (0xF4, 0xF4): (0x80, 0x8F, 2)}
    steps = {START: {**dict.fromkeys(range(0x80), START), **{b: state for (low, high), state in leads.items() for b in range(low, high + 1)}}}
    for low, high, left in {*leads.values(), tail(0), tail(1)}:
        steps[low, high, left] = dict.fromkeys(range(low, high + 1), tail(left - 1) if left else START)
    return steps


START = ()
STEPS = utf8_steps()
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def characters(data: bytes) -> tuple[str, bytes]:
    """The characters of ``data`` and the bytes at its end that may begin another.  Each longest run
    of bytes that begins a character but does not end one is U+FFFD, as is a byte that begins none."""
    out, state, begin, value = [], START, 0, 0
    for i, byte in enumerate(data):
        new = STEPS[state].get(byte)
        if new is None and state != START:
            out.append(REPLACEMENT)
            state, new = START, STEPS[START].get(byte)
        if state == START:
            begin, value = i, byte if byte < 0x80 else byte & (0x3F >> (new[2] + 1 if new else 0))
        else:
            value = value << 6 | byte & 0x3F
        if new is None:
            out.append(REPLACEMENT)
        elif new == START:
            out.append(chr(value))
        state = new or START
    return "".join(out), data[begin:] if state != START else b""


class StreamDecoder:
    """Bytes and text of ids that come in runs; a character may be cut by the end of a run.

    The machine's state is the open bytes of a character.  What a token adds to the text in a state,
    and the state after it, is worked out by the UTF-8 steps when first met and kept.  Bytes that are
    no UTF-8 become U+FFFD in the text; the bytes themselves stay as they are.
    """

    def __init__(self, names: list[bytes]):
        self.names, self.nodes, self.kept = names, {}, 0
        self.node = self._node(b"")

    def _node(self, still: bytes) -> dict:
        """Steps from a state: id -> (text, steps of the next state); -1 -> its open bytes."""
        return self.nodes.setdefault(still, {-1: still})

    def _step(self, node: dict, token: int) -> tuple[str, dict]:
        text, still = characters(node[-1] + self.names[token])
        if self.kept >= PAIRS:  # the node itself is still in use
            self.nodes, self.kept = {}, 0
        node[token] = found = text, self._node(still)
        self.kept += 1
        return found

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.names.__getitem__, ids))

    def feed(self, ids) -> str:
        out, node = [], self.node
        for token in ids:
            text, node = node.get(token) or self._step(node, token)
            out.append(text)
        self.node = node
        return "".join(out)

    def end(self) -> str:
        """What is left of a cut character; the decoder is then at the start of another text."""
        cut, self.node = self.node[-1], self._node(b"")
        return REPLACEMENT if cut else ""

    def text(self, ids: array) -> str:
        """Text of all ids, ``RUN`` at a time."""
        return "".join([*(self.feed(ids[i:i + RUN]) for i in range(0, len(ids), RUN)), self.end()])


def names_of(ranks: dict[bytes, int]) -> list[bytes]:
    names = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        names[rank] = token
    return names


#: ids that are decoded at once, and rows that are handed back at once
RUN, ROWS = 1 << 16, 500


def unpacked(ids: bytes) -> array:
    values = array("I", little(ids))
    return values


def encode(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """Column: ids of whole texts, packed as little-endian unsigned 32-bit integers.

    A null text is the empty text and has no ids.  ``ranks_path`` is a file every executor has;
    each task reads it once.
    """
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(load_ranks(ranks_path), pattern)
        for batch in batches:
            yield by_slices(encoder, pa.binary(), batch)

    return run(text_bytes(text).cast("string"))


def decode(ids: str | Column, ranks_path: str) -> Column:
    """Column: the bytes that packed ids stand for; null for null."""
    return _decoded(ids, ranks_path, "binary")


def decode_text(ids: str | Column, ranks_path: str) -> Column:
    """Column: the text that packed ids stand for, read in runs by the UTF-8 machine."""
    return _decoded(ids, ranks_path, "string")


def _decoded(ids, ranks_path, kind):
    as_text = kind == "string"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stream = StreamDecoder(names_of(load_ranks(ranks_path)))

        def one(packed):
            return None if packed is None else stream.text(unpacked(packed)) if as_text else stream.bytes(unpacked(packed))

        for batch in batches:
            yield by_slices(one, pa.string() if as_text else pa.binary(), batch)

    return run(F.col(ids) if isinstance(ids, str) else ids)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed) and ``n_tokens``; columns of these names are replaced."""
    out = docs.withColumn("ids", encode(text_col, ranks_path, pattern))
    return out.withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def round_tripped(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed), ``n_tokens`` and ``decoded_sha256``; columns of these names are replaced.

    The last is the digest of the bytes of the text that the stream machine reads from the ids: that of the text itself,
    where nothing is lost.  A null text is the empty text.
    """
    kind = pa.struct([("ids", pa.binary()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("ids binary, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = load_ranks(ranks_path)
        encoder, stream = Encoder(ranks, pattern), StreamDecoder(names_of(ranks))

        def one(text):
            ids = encoder(text)
            return {"ids": ids, "decoded_sha256": hashlib.sha256(stream.text(unpacked(ids)).encode()).hexdigest()}

        for batch in batches:
            yield by_slices(one, kind, batch)

    both, = free_names(docs, "both")
    out = docs.withColumn(both, run(text_bytes(text_col).cast("string")))
    out = out.withColumn("ids", F.col(both)["ids"]).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
    return out.withColumn("decoded_sha256", F.col(both)["decoded_sha256"]).drop(both)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: packed ids of whole texts and the bytes of the text that the stream
    machine reads from the ids."""
    def run(batches):
        ranks = load_ranks(ranks_path)
        encoder, stream = Encoder(ranks, pattern), StreamDecoder(names_of(ranks))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                back = [stream.text(unpacked(i)).encode() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                                                 ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", text_bytes("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: number of tokens, digest of its ids, digest of the decoded bytes.

    Null and empty texts have no tokens; repeated rows keep their rows; other columns are ignored.
    """
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
