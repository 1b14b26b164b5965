"""Byte-level BPE encoding by a lazily determinised transducer, and decoding by an incremental UTF-8 machine.

Encoding. After i bytes of a pretoken, the encoding of the prefix is known: its last token is the one
that may stand after the last token of a shorter prefix (``bpe.PairTest``). A prefix is live while
some longer token could still start at its end. The transducer's state is the live prefixes
with their last tokens; when only the whole is live, its tokens can't change any more and are
emitted, so the lookahead is at most the longest token. States and transitions are made when first met and kept
in tables of bounded size.

Decoding joins the ids' bytes and feeds them in pieces to a state machine over the bytes of UTF-8, which holds
back an unfinished character.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows are encoded
each; a null ``doc_id`` stays null; an empty table gives no rows; very long texts are encoded whole, a pretoken
of any length at a bounded lookahead; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .batches import kept, map_batches, texts_of
from .bpe import PairTest


class _State(dict):
    """``key``: the bytes since the first live prefix, and then for each live prefix its offset there and its last token's id
    (-1: none), all in one tuple, which is the state's key as well: with many states it is their keys that take memory.

    Maps a byte to (next state, id and length of the token at which the prefix that the byte completes
    ends, whether all tokens up to there are settled). Entries are made when first asked for.
    """

    __slots__ = ("key", "machine")

    def __missing__(self, byte: int) -> tuple:
        m, (tail, *live) = self.machine, self.key
        tail += bytes((byte,))
        ids, tokens, openings = m.ids, m.tokens, m.openings
        onward, found = [], None
        for at, last in zip(live[::2], live[1::2], strict=True):
            t = tail[at:]
            # the vocabulary's own bytes are compared, so what is known of pairs keeps no copies
            if found is None and (i := ids.get(t)) is not None and m.stands(tokens.get(last), tokens[i]):
                found = i
            if t in openings:
                onward += (at, last)
        if found is None:
            raise ValueError(f"no token ends at byte {byte}")
        onward += (len(tail), found)
        first = onward[0]
        onward[::2] = [at - first for at in onward[::2]]
        got = self[byte] = (m.state((tail[first:], *onward)), found, len(tokens[found]), len(onward) == 2)
        return got


class Transducer:
    """Once the whole is the only live prefix, the tokens up to it are settled and leave; a live prefix is
    shorter than the whole by less than the longest token, so no more lookahead is needed."""

    def __init__(self, ranks: dict[bytes, int], keep_states: int = 300_000):
        self.ids, self.keep_states = ranks, keep_states
        self.tokens = {i: t for t, i in ranks.items()}
        self.openings = {t[:k] for t in ranks for k in range(1, len(t))}
        self.stands = PairTest(lambda whole: [whole[i : i + 1] for i in range(len(whole))], lambda a, b: ranks.get(a + b))
        self._empty()

    def _empty(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self.state((b"", 0, -1))

    def release(self) -> None:
        """Let go of all states, which refer to each other, and of the pairs tested."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.stands.known.clear()
        self._empty()

    def state(self, key: tuple) -> _State:
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = _State()
            got.key, got.machine = key, self
        return got

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self.states) > self.keep_states:
            self._empty()
        state, out, held = self.start, [], []
        for byte in piece:
            to = state[byte]
            state = to[0]
            held.append(to)
            if to[3] and len(held) > 64:
                out += self._settled(held)
                held = []
        return (*out, *self._settled(held))

    @staticmethod
    def _settled(held: list[tuple]) -> list[int]:
        """The tokens of the held bytes, read back from the last one."""
        out, at = [], len(held)
        while at > 0:
            to = held[at - 1]
            out.append(to[1])
            at -= to[2]
        out.reverse()
        return out


def utf8_machine() -> list[list[int]]:
    """Next state for each state and byte. 0: between characters; 1, 2, 3: so many continuation bytes to come; 4 to 7: the
    next one is restricted, after E0 (no overlong), ED (no surrogate), F0 (no overlong), F4 (up to U+10FFFF); BROKEN otherwise."""
    steps = [[BROKEN] * 256 for _ in range(BROKEN)]

    def put(state: int, first: int, last: int, to: int) -> None:
        for b in range(first, last + 1):
            steps[state][b] = to

    for lead in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        put(0, *lead)
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        put(state, first, last, to)
    return steps


BROKEN = 8
_STEPS = utf8_machine()
_BEYOND_ASCII = re.compile(rb"[\x80-\xff]")


class Utf8Stream:
    """Text from bytes that arrive in pieces, by a state machine over single bytes.

    An unfinished character waits for its rest. Where the machine breaks, the bytes since the last whole character
    become one U+FFFD, and the byte at which it broke is looked at again, as a possible beginning.
    """

    def __init__(self):
        self.held, self.state = b"", 0

    def feed(self, piece: bytes) -> str:
        if not self.state and piece.isascii():
            return piece.decode("ascii")
        data, state, steps = self.held + piece, self.state, _STEPS
        out, begin, whole = [], 0, 0  # begin: of what isn't given out yet; whole: end of the last whole character
        i = len(self.held)
        while i < len(data):
            if not state:  # ASCII leads from between characters to between characters
                ahead = _BEYOND_ASCII.search(data, i)
                i = whole = ahead.start() if ahead else len(data)
                if ahead is None:
                    break
            state = steps[state][data[i]]
            i += 1
            if not state:
                whole = i
            elif state == BROKEN:
                out += (data[begin:whole].decode(), "\ufffd")
                if i - 1 > whole:  # it broke off a character that had begun
                    i -= 1
                begin = whole = i
                state = 0
        self.held, self.state = data[whole:], state
        out.append(data[begin:whole].decode())
        return "".join(out)

    def end(self) -> str:
        rest, self.held, self.state = self.held, b"", 0
        return "\ufffd" if rest else ""


class _Known(dict):
    """Pretokens met lately: when the table is full it becomes the older half, whose entries return when used."""

    def __init__(self, transducer: Transducer, keep: int):
        self.transducer, self.keep, self.older = transducer, keep, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece)
        if got is None:
            got = self.transducer.encode(piece.encode())
        self[piece] = got
        return got


class ByteBpe:
    """A vocabulary file of lines ``base64 rank`` with the pattern that cuts texts into pretokens."""

    def __init__(self, path: str, pattern: str, keep: int = 250_000):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pieces = regex.compile(pattern)
        self.known = _Known(Transducer(ranks), keep)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]

    def release(self) -> None:
        self.known.transducer.release()
        self.known.clear()
        self.known.older = {}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces.findall(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int], piece: int = 4096) -> str:
        stream = Utf8Stream()
        return "".join([*(stream.feed(self.decode_bytes(ids[i : i + piece])) for i in range(0, len(ids), piece)), stream.end()])


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One per worker process. The vocabulary stays, so the collector needn't look at it again."""

    def build() -> ByteBpe:
        got = ByteBpe(path, pattern)
        gc.freeze()
        return got

    return kept(f"byte_bpe {path} {pattern}", build)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (the text that the ids give back)."""

    def make():
        b = byte_bpe(vocabulary, pattern)

        def step(batch):
            ids = [b.encode(x) for x in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [b.decode(x) for x in ids]}

        return step

    return map_batches(texts_of(docs), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests are taken where the ids are made, so no id leaves the worker."""

    def make():
        b = byte_bpe(vocabulary, pattern)
        name, sha = b.names.__getitem__, lambda x: hashlib.sha256(x).hexdigest()

        def step(batch):
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = b.encode(text)
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(name, ids)).encode()))
                decoded_sha.append(sha(b.decode(ids).encode()))
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

        return step

    return map_batches(texts_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
