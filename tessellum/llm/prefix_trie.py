"""BPE encoding over a trie of the distinct words, and decoding.

A batch's pretokens that aren't known yet go into a trie. It is walked depth first, and every node gets the last token of
the encoding of the bytes that lead to it. That token is the one among those ending there that may stand after the last
token of a shorter prefix (``bpe.PairTest``), so it follows from the nodes above, and a prefix that many words share is
encoded once for all. A word's tokens are read back from its node upwards. Which tokens end at a node
is told by a machine whose state is the longest end of the bytes read that begins a token.

Edges hold whole stretches of bytes, so the trie has two nodes a word at most, and a word of any length takes one step a byte.

Defined results: a null or empty text has no ids and decodes to nothing; special strings inside a text become their ids,
unless ``specials`` is off; repeated rows are encoded each; a null ``doc_id`` stays null; an empty table gives no rows;
very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .batches import kept, map_batches, texts_of
from .bpe import PairTest
from .token_counts import byte_alphabet

#: The pretoken pattern of the byte-level kind, a fixed value; white space is the Unicode property (U+001C to U+001F are none).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class Node:
    """``label``: the bytes of the edge that leads here. ``word``: the word that ends here, if any."""

    __slots__ = ("below", "label", "word")

    def __init__(self, label: bytes, word: str | None = None):
        self.label, self.word, self.below = label, word, {}


def common(a: bytes, b: bytes) -> int:
    """How many bytes both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def trie(words: Iterable[str]) -> Node:
    root = Node(b"")
    for word in words:
        node, rest = root, word.encode()
        while rest:
            child = node.below.get(rest[0])
            if child is None:
                child = node.below[rest[0]] = Node(rest)
                rest = b""
            elif rest.startswith(child.label):
                rest = rest[len(child.label) :]
            else:
                n = common(child.label, rest)
                fork = node.below[rest[0]] = Node(rest[:n])
                child.label = child.label[n:]
                fork.below[child.label[0]] = child
                child, rest = fork, rest[n:]
            node = child
        node.word = word
    return root


class Known(dict):
    """What ``of`` gives for the words of the batches lately: when more than ``keep`` are held, they become the older half, whose entries return when used."""

    def __init__(self, of: Callable[[set[str]], dict[str, bytes]], keep: int):
        self.of, self.keep, self.older = of, keep, {}

    def release(self) -> None:
        self.clear()
        self.older = {}

    def holding(self, words: set[str]) -> Known:
        """This table, which then has all the words; it holds ``keep`` and those of one batch at most."""
        if len(self) > self.keep:
            self.older = dict(self)
            self.clear()
        new = words - self.keys()
        back = new & self.older.keys()
        self.update((w, self.older[w]) for w in back)
        if new := new - back:
            self.update(self.of(new))
        return self


class _Ends(dict):
    """The next state by byte. ``found``: (length, id, what may stand before it) of the tokens that end here, longest first."""

    __slots__ = ("found", "read", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, read: bytes):
        self.vocabulary, self.read = vocabulary, read
        ids = vocabulary.ids
        self.found = [(len(read) - k, i, vocabulary.after(i)) for k in range(len(read)) if (i := ids.get(read[k:])) is not None]

    def __missing__(self, byte: int) -> _Ends:
        got = self[byte] = self.vocabulary.ends(self.read + bytes((byte,)))
        return got


class _After(dict):
    """Whether the token may stand after each of those met before it, by id (``bpe.PairTest``); -1: at the beginning."""

    __slots__ = ("id", "vocabulary")

    def __init__(self, vocabulary: Vocabulary, id_: int):
        self.vocabulary, self.id = vocabulary, id_

    def __missing__(self, left: int) -> bool:
        v = self.vocabulary
        v.pairs += 1
        got = self[left] = v.stands._test(v.bytes[left] if left >= 0 else None, v.bytes[self.id])
        return got


class Vocabulary:
    """A tokenizer file of the kind byte-level BPE: no normaliser, no space put before the text."""

    def __init__(self, path: str, keep: int = 300_000, keep_pairs: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        ranks = {tuple(map(raw, m if isinstance(m, list) else m.split(" "))): k for k, m in enumerate(model["merges"])}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in specials:
            self.ids.pop(content.encode(), None)
        self.specials = specials
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True)) or r"(?!)")
        self.bytes = [b""] * (max([*self.ids.values(), *specials.values()]) + 1)
        for t, i in [*self.ids.items(), *((c.encode(), i) for c, i in specials.items())]:
            self.bytes[i] = t
        self.names = [str(i) for i in range(len(self.bytes))]
        self.begins = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.stands = PairTest(lambda whole: [whole[i : i + 1] for i in range(len(whole))], lambda a, b: ranks.get((a, b)))
        self.pieces = regex.compile(PRETOKEN)
        self.keep_pairs = keep_pairs
        self.states: dict[bytes, _Ends] = {}
        self.afters: dict[int, _After] = {}
        self.pairs = 0
        self.known = Known(self.of_words, keep)

    def release(self) -> None:
        """Let go of all states, pairs and words met."""
        self.forget()
        self.known.release()

    def forget(self) -> None:
        """Begin the tables of states and pairs anew."""
        for met in (*self.states.values(), *self.afters.values()):
            met.clear()
        self.states, self.afters, self.pairs = {}, {}, 0

    def after(self, i: int) -> _After:
        got = self.afters.get(i)
        if got is None:
            got = self.afters[i] = _After(self, i)
        return got

    def ends(self, read: bytes) -> _Ends:
        while read not in self.begins:
            read = read[1:]
        got = self.states.get(read)
        if got is None:
            got = self.states[read] = _Ends(self, read)
        return got

    def of_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct word, as bytes of 32-bit numbers."""
        if self.pairs > self.keep_pairs:
            self.forget()
        out: dict[str, bytes] = {}
        lasts, sizes, states = [-1], [0], [self.ends(b"")]
        todo = [(trie(words), 0)]
        while todo:
            node, depth = todo.pop()
            del lasts[depth + 1 :], sizes[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for byte in node.label:
                state = state[byte]
                depth += 1
                for size, i, after in state.found:
                    if after[lasts[depth - size]]:
                        lasts.append(i)
                        sizes.append(size)
                        break
                else:
                    raise ValueError(f"no token ends at byte {byte}")
                states.append(state)
            if node.word is not None:
                ids, at = array("i"), depth
                while at:
                    ids.append(lasts[at])
                    at -= sizes[at]
                ids.reverse()
                out[node.word] = ids.tobytes()
            todo += [(child, depth) for child in node.below.values()]
        return out

    def table(self, words: set[str]) -> dict[str, bytes]:
        """A table that has ``of_words`` for all the words."""
        return self.known.holding(words)

    def encode(self, texts: list[str], specials: bool = True) -> list[np.ndarray]:
        """The ids of each text."""
        cut, parts = [], []
        for text in texts:
            own = []
            if specials and self.special.search(text):
                at = 0
                for m in self.special.finditer(text):
                    own += [self.pieces.findall(text[at : m.start()]), self.specials[m[0]]]
                    at = m.end()
                own.append(self.pieces.findall(text[at:]))
            else:
                own.append(self.pieces.findall(text))
            parts.append(own)
            cut += [x for x in own if not isinstance(x, int)]
        table = self.table(set().union(*cut))
        of = lambda x: array("i", [x]).tobytes() if isinstance(x, int) else b"".join(map(table.__getitem__, x))
        return [np.frombuffer(b"".join(map(of, own)), np.int32) for own in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """Broken UTF-8 becomes U+FFFD, as far as a character could have gone on."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    """One per worker process. The vocabulary stays, so the collector needn't look at it again."""

    def build() -> Vocabulary:
        got = Vocabulary(path)
        gc.freeze()
        return got

    return kept(f"prefix_trie {path}", build)


def encode_texts(docs: DataFrame, path: str, specials: bool = True) -> DataFrame:
    """doc_id, ids (array of int), decoded (the text that the ids give back)."""

    def make():
        v = vocabulary(path)

        def step(batch):
            ids = [x.tolist() for x in v.encode(batch.column("text").to_pylist(), specials)]
            return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [v.decode(x) for x in ids]}

        return step

    return map_batches(texts_of(docs), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, specials: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests are taken where the ids are made, so no id leaves the worker."""

    def make():
        v = vocabulary(path)
        name, sha = v.names.__getitem__, lambda x: hashlib.sha256(x.encode()).hexdigest()

        def step(batch):
            n, ids_sha, decoded_sha = [], [], []
            for x in v.encode(batch.column("text").to_pylist(), specials):
                ids = x.tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(name, ids))))
                decoded_sha.append(sha(v.decode(ids)))
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

        return step

    return map_batches(texts_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
