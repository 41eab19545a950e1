"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A token sequence is what the merges produce exactly if every neighbouring pair is what
the merges produce of that pair alone.  So the last token of every prefix follows from
the last tokens of shorter prefixes, and the encoder can run over bytes from left to
right.  Its nondeterministic part is "at which earlier position does the token that I am
inside of begin"; the determinised state holds all positions that are still possible,
with the token that ends at each.  States and moves are made when first met and kept.

A token leaves the transducer as soon as every possible continuation agrees on it; the
lookahead is bounded by the longest token, and so is the memory for a piece of any length.

Texts are cut into pieces by the tokenizer's pattern first; pieces are encoded apart.
Null text counts as empty.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textkernel import release

#: Pieces whose output is remembered, moves after which the machine starts afresh, and pairs of tokens that are known.
PIECE_MEMO = 100_000
MOVE_MEMO = 600_000
PAIR_MEMO = 300_000
#: Ids that the streaming decoder is fed at a time.
DECODE_IDS = 4096
#: Vocabularies above this size are refused (they travel to each executor once).
MAX_VOCABULARY_BYTES = 64 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes, least: int = 1) -> list[int]:
    """The defining procedure: merge the neighbours of lowest rank, leftmost first, until none (or ``least`` parts) is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, far = ranks.get, 1 << 62
    weights = [get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
    while len(weights) >= least:
        low = min(weights)
        if low == far:
            break
        i = weights.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del weights[i]
        if i < len(weights):
            weights[i] = get(parts[i] + parts[i + 1], far)
        if i:
            weights[i - 1] = get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes in, token ids out.

    A state is ``(tail, ends)``: ``tail`` is the longest suffix of what was read that is a
    proper beginning of some token, so a token that covers the next byte begins inside it;
    ``ends[k]`` is the token that ends ``k`` positions back, for each of these places
    (``START`` where the piece begins, ``NONE`` where no path passes).
    """

    START, NONE = -2, -1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.text = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.beginnings = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.closing: dict[bytes, tuple[list[tuple[int, int]], bytes]] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; they are made again as they are met.  What does not name a state stays."""
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (self.START,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        if len(self.fit) > PAIR_MEMO:
            self.fit.clear()
        if len(self.closing) > PAIR_MEMO:
            self.closing.clear()

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives back just these two."""
        key = (left, right)
        if (known := self.fit.get(key)) is None:
            known = self.fit[key] = self._apart(left, right)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """As ``fits``: the merges beside the border are undone, the latest first, and none across it may have come before."""
        text, size, halves = self.text, self.size, self.halves
        if not (self._ordered(a) and self._ordered(b)):
            return merge_by_rank(self.ranks, text[a] + text[b]) == [a, b]
        across, limit = self.ranks.get, 1 << 62
        while across(text[a] + text[b], limit) >= limit:
            if size[a] > 1 and (a > b or size[b] == 1):
                limit, a = a, halves[a][1]
            elif size[b] > 1:
                limit, b = b + 1, halves[b][0]  # of equal ranks the left pair is merged first
            else:
                return True
        return False

    def _ordered(self, token: int) -> bool:
        """Whether merges of rising rank make ``token``; the two tokens of the last one are noted."""
        if self.size[token] == 1:
            return True
        if token not in self.halves:
            pair = merge_by_rank(self.ranks, self.text[token], 2)
            good = len(pair) == 2 and all(self.size[t] == 1 or (t < token and self._ordered(t)) for t in pair)
            self.halves[token] = (pair[0], pair[1]) if good else None
        return self.halves[token] is not None

    def suffixes(self, read: bytes) -> tuple[list[tuple[int, int]], bytes]:
        """The tokens that ``read`` ends with, longest first, and the tail it leaves."""
        found = [(len(read) - i, t) for i in range(len(read)) if (t := self.ranks.get(read[i:])) is not None]
        tail = next((read[i:] for i in range(len(read)) if read[i:] in self.beginnings), b"")
        known = self.closing[read] = (found, tail)
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after one more byte, and the last token of all that was read."""
        tail, ends = self.states[state]
        read = tail + bytes((byte,))
        found, new = self.closing.get(read) or self.suffixes(read)
        last = self.NONE
        for size, token in found:
            before = ends[size - 1]
            if before == self.START or (before >= 0 and self.fits(before, token)):
                last = token
                break
        target = (new, (last, *ends[: len(new)]))
        if (number := self.number.get(target)) is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << 8 | byte] = (number, last)
        return move

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Tokens of a piece of any length, each given out once every continuation agrees on it."""
        state, lasts, held = 0, [], 0
        for byte in piece:
            move = self.moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            lasts.append(move[1])
            held += 1
            if held >= 8 * self.longest:
                yield from (settled := self._settled(state, lasts))
                lasts = lasts[sum(self.size[t] for t in settled) :]
                held = len(lasts) - 4 * self.longest
        yield from self._back(lasts, len(lasts))

    def _back(self, lasts: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            token = lasts[at - 1]
            out.append(token)
            at -= self.size[token]
        out.reverse()
        return out

    def _settled(self, state: int, lasts: list[int]) -> list[int]:
        """What the paths to all places where the next token may begin have in common."""
        places = [len(lasts) - k for k, t in enumerate(self.states[state][1]) if t != self.NONE and k <= len(lasts)]
        paths = [self._back(lasts, at) for at in places]
        common = []
        for column in zip(*paths, strict=False):
            if len(set(column)) > 1:
                break
            common.append(column[0])
        return common

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > MOVE_MEMO:
            self.reset()
        if len(piece) > 64 * self.longest:
            return list(self.stream(piece))
        state, moves, lasts = 0, self.moves, []
        for byte in piece:
            state, last = moves.get(state << 8 | byte) or self.step(state, byte)
            lasts.append(last)
        return self._back(lasts, len(lasts))

    def encoded(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers.

        Short pieces are remembered; of two generations of them the older one goes, so frequent pieces stay known.
        """
        found = self.pieces.get(piece) or self.older.get(piece)
        if found is None:
            found = array("I", self.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= PIECE_MEMO:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found


# --- decoding -------------------------------------------------------------------------


def _utf8_machine() -> tuple[list[list[int]], int]:
    """The table ``[state, byte] -> state`` of well-formed UTF-8; 0 is between characters, the last rejects.

    States 1-3 await that many continuation bytes; 4-7 are the lead bytes after which the
    second byte is restricted (E0, ED, F0, F4).
    """
    dead = 8
    table = np.full((9, 256), dead, np.uint8)
    table[0, 0x00:0x80] = 0
    table[0, 0xC2:0xE0] = 1
    table[0, 0xE0:0xF0] = 2
    table[0, 0xF0:0xF5] = 3
    for state, lead, low, high, then in ((4, 0xE0, 0xA0, 0xBF, 1), (5, 0xED, 0x80, 0x9F, 1), (6, 0xF0, 0x90, 0xBF, 2), (7, 0xF4, 0x80, 0x8F, 2)):
        table[0, lead] = state
        table[state, low : high + 1] = then
    for state in (1, 2, 3):
        table[state, 0x80:0xC0] = state - 1
    return table.tolist(), dead


UTF8, DEAD = _utf8_machine()


class StreamDecoder:
    """Feeds token ids in, gives out bytes or text as soon as its characters are complete.

    The bytes of a character that a token boundary cuts are held back.  The machine steps
    through the last bytes only, as many as such a character can have.  Bytes that are
    no UTF-8 are passed on; as text they become U+FFFD, as a replacing decoder gives.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.held = b""

    def feed_bytes(self, ids: Iterable[int]) -> bytes:
        raw = self.held + b"".join(map(self.pieces.__getitem__, ids))
        complete, state = len(raw), 0
        # An incomplete character has three bytes at most, and its lead byte restarts the machine in any state.
        for i, byte in enumerate(raw[-3:], max(len(raw) - 3, 0)):
            before, state = state, UTF8[state][byte]
            if state == DEAD:  # judge this byte afresh
                state = UTF8[0][byte]
                state = 0 if state == DEAD else state
                complete = i
            elif before == 0:
                complete = i
        if not state:
            complete = len(raw)
        self.held = raw[complete:]
        return raw[:complete]

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def finish_bytes(self) -> bytes:
        out, self.held = self.held, b""
        return out

    def finish(self) -> str:
        return self.finish_bytes().decode("utf-8", "replace")


class Codec:
    """A transducer with the pattern that cuts texts into pieces, and the way back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.cut = regex.compile(pattern).findall
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def encode_bytes(self, text: str) -> bytes:
        known, encoded = self.machine.pieces.get, self.machine.encoded
        return b"".join([known(piece) or encoded(piece) for piece in self.cut(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_stream(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        decoder = StreamDecoder(self.table)
        for part in ids:
            yield decoder.feed(part)
        yield decoder.finish()


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One codec in each Python worker for a vocabulary, so that its machine stays warm."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _CODECS:
        size = np.frombuffer(raw[:4], "<u4")[0]
        lengths = np.frombuffer(raw[4 : 4 + 8 * size], "<u4").reshape(-1, 2)
        at, ranks = 4 + 8 * int(size), {}
        for rank, n in lengths.tolist():
            ranks[raw[at : at + n]] = rank
            at += n
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _packed(ranks: dict[bytes, int]) -> bytes:
    head = np.array([(r, len(t)) for t, r in ranks.items()], "<u4")
    return np.array([len(ranks)], "<u4").tobytes() + head.tobytes() + b"".join(ranks)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep_ids: bool = True, keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns the columns ``keep`` (all but the text by default) with ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``token_ids`` and ``decoded``.
    Columns of the input that bear such a name are left out.  One narrow pass, no shuffle.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * keep_ids + ["decoded"] * keep_text
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*made, text)]
    vocabulary = docs.sparkSession.sparkContext.broadcast(_packed(load_ranks(path)))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["token_ids array<int>"] * keep_ids, *["decoded string"] * keep_text])

    def run(batches):
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for begin in range(0, batch.num_rows, 512):
                n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
                part = column.slice(begin, 512)
                for x in part:
                    raw = codec.encode_bytes(x.as_py() or "")
                    ids = array("I", raw)
                    decoder = StreamDecoder(codec.table)
                    back = b"".join([decoder.feed_bytes(ids[i : i + DECODE_IDS]) for i in range(0, len(ids), DECODE_IDS)]) + decoder.finish_bytes()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        ids_out.append(np.frombuffer(raw, "<i4"))
                    if keep_text:
                        text_out.append(back.decode("utf-8", "replace"))
                columns = [batch.column(i).slice(begin, 512) for i in range(len(keep))]
                columns += [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if keep_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                if keep_text:
                    columns.append(pa.array(text_out, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])
        release()

    return docs.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(run, schema)
