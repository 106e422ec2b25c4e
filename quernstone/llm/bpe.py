"""Byte-level BPE encoding and decoding (operator 1).

Encoding: a nondeterministic machine guesses where tokens end. Its states are (last token, node of the token trie); it
may end a token only if the token after the last one would really stand there after all merges (two tokens fit if the
merges of their joined bytes give just these two; a sequence is the encoding of its bytes if every two neighbours fit).
`Transducer` determinises this machine lazily: a state is a set of such guesses, each with the tokens that it has not
emitted yet, and what all guesses agree on is emitted at once. Tokens thus come out after a bounded lookahead: a guess
lives no longer than the longest token that goes on. States and transitions are made when first met and kept; beyond
`limit` states they are dropped and made again, within a piece as well, so memory is bounded whatever a text holds.

Decoding: `Utf8Machine` takes token ids one by one and gives the text that is complete so far; its state between tokens
is what an unfinished character needs. Transitions by token are kept as well.

Defined cases: a null or empty text has no tokens, and the hashes of empty strings; very long runs of letters or white
space take time in proportion to their length; repeated rows give repeated rows; a null doc_id stays null; other columns
are not read.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import bounded_batches, columns_of, documents, id_and_text

#: The vocabulary of the query; a parameter of everything else.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States of a transducer, kept pairs of tokens, and words with their tokens, before they are dropped and made again.
STATES, PAIRS, WORDS = 400_000, 500_000, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of byte strings, and the trie of those that merging can give."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        #: Node 0 is the root; child of (node, byte); the token that ends at a node.
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for b, i in ranks.items():
            if len(self.merged(b)) != 1:
                continue
            at = 0
            for x in b:
                nxt = self.child[at].get(x)
                if nxt is None:
                    nxt = self.child[at][x] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                at = nxt
            self.token[at] = i

    def merged(self, b: bytes, below: int | None = None) -> list[bytes]:
        """The parts of a short string after all merges (below a rank), lowest rank first and leftmost among equals."""
        parts = [b[i : i + 1] for i in range(len(b))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or below is not None and best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts of a token along its left or right edge, each with the rank of the merge that swallows it."""
        known = self.spines[right].get(token)
        if known is None:
            known, b, limit = [], self.bytes[token], float("inf")
            while True:
                known.append((b, limit))
                if len(b) == 1:
                    break
                limit = self.ranks[b]
                b = self.halves(b)[right]
            self.spines[right][token] = known
        return known

    def halves(self, b: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        parts = self.merged(b, self.ranks[b])
        return parts[0], parts[1]

    def fit(self, a: int, b: int) -> bool:
        """Whether b stands after a when all merges of their joined bytes are done.

        A merge over the boundary takes place if two edge parts join at a lower rank than the merges that swallow
        them within a and b; at equal rank the one further left comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ranks, known = self.ranks, True
            for x, within_a in self.spine(a, True):
                for y, within_b in self.spine(b, False):
                    r = ranks.get(x + y)
                    if r is not None and r < within_a and r <= within_b:
                        known = False
                        break
                if not known:
                    break
            self.pairs[a, b] = known
        return known


class _State:
    """Guesses (pending tokens, last token, trie node), the longest running first, and last the one that ends a token here.

    There is just one of the last kind, as the encoding of what was read is unique. What reading a byte does is filled
    in when met.
    """

    __slots__ = ("guesses", "next")

    def __init__(self, guesses: tuple):
        self.guesses = guesses
        self.next: dict[int, tuple[tuple[int, ...], _State]] = {}


class Transducer:
    """Bytes in, token ids out, state by state."""

    def __init__(self, vocabulary: Vocabulary, limit: int = STATES):
        self.vocabulary, self.limit = vocabulary, limit
        self.states: dict[tuple, _State] = {}
        self._fresh()

    def _fresh(self) -> None:
        """Drops all states, in the midst of a piece too: a reader goes on from the state it holds.

        States refer to one another, so each is emptied here; no garbage collection is needed.
        """
        for state in self.states.values():
            state.next = {}
        self.start = _State((((), -1, 0),))
        self.states = {self.start.guesses: self.start}

    def _read(self, state: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        v = self.vocabulary
        child, ends, pairs = v.child, v.token, v.pairs
        after, ended = [], None
        for pending, last, node in state.guesses:
            to = child[node].get(byte)
            if to is None:
                continue
            if child[to]:
                after.append((pending, last, to))
            token = ends[to]
            if ended is None and token is not None:
                fits = last < 0 or pairs.get((last, token))
                if fits or fits is None and v.fit(last, token):
                    ended = (pending + (token,), token, 0)
        if ended is None:
            raise ValueError("the vocabulary lacks a single byte")
        after.append(ended)
        first, agreed = after[0][0], 0
        if len(after) == 1:
            agreed = len(first)
        else:
            for column in zip(*[g[0] for g in after], strict=False):
                if column.count(column[0]) < len(column):
                    break
                agreed += 1
        guesses = tuple([(g[0][agreed:], g[1], g[2]) for g in after] if agreed else after)
        to = self.states.get(guesses)
        if to is None:
            if len(self.states) >= self.limit:
                self._fresh()
            to = self.states[guesses] = _State(guesses)
        made = state.next[byte] = (first[:agreed], to)
        return made

    def encode(self, data: bytes) -> list[int]:
        state, out = self.start, []
        for byte in data:
            step = state.next.get(byte) or self._read(state, byte)
            if step[0]:
                out.extend(step[0])
            state = step[1]
        return out + self._end(state)

    def _end(self, state: _State) -> list[int]:
        """The one guess that ends a token here: the encoding of what was read is unique."""
        return list(state.guesses[-1][0])


class Utf8Machine:
    """Token ids in, text out: a character comes when its last byte does; a byte that can't belong to one gives U+FFFD.

    The state is (bytes still to come, bits so far, least and greatest next byte).
    """

    START = (0, 0, 0x80, 0xBF)

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.known = tokens, {}
        self.state: tuple[int, int, int, int] = self.START

    @staticmethod
    def step(state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
        left, bits, low, high = state
        done = Utf8Machine.START
        if left:
            if not low <= byte <= high:
                after, text = Utf8Machine.step(done, byte)
                return after, "�" + text
            bits = bits << 6 | byte & 0x3F
            return (done, chr(bits)) if left == 1 else ((left - 1, bits, 0x80, 0xBF), "")
        if byte < 0x80:
            return done, chr(byte)
        if 0xC2 <= byte <= 0xDF:
            return (1, byte & 0x1F, 0x80, 0xBF), ""
        if 0xE0 <= byte <= 0xEF:
            return (2, byte & 0x0F, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), ""
        if 0xF0 <= byte <= 0xF4:
            return (3, byte & 0x07, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), ""
        return done, "�"

    def feed(self, token: int) -> str:
        made = self.known.get((self.state, token))
        if made is None:
            state, out = self.state, []
            for byte in self.tokens[token]:
                state, text = self.step(state, byte)
                out.append(text)
            if len(self.known) >= PAIRS:
                self.known.clear()
            made = self.known[self.state, token] = state, "".join(out)
        self.state = made[0]
        return made[1]

    def finish(self) -> str:
        left, self.state = self.state[0], self.START
        return "�" if left else ""


class Codec:
    """Texts to ids and back. A pattern cuts texts into pieces, each encoded by itself; lately seen pieces are kept with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.transducer = Transducer(self.vocabulary)
        self.pieces = regex.compile(pattern)
        self.machine = Utf8Machine(self.vocabulary.bytes)
        self.whole: dict[int, str] = {}
        for i in self.vocabulary.bytes:
            text = self.machine.feed(i)
            if self.machine.state == Utf8Machine.START and "\ufffd" not in text:
                self.whole[i] = text
            self.machine.finish()
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        if len(self.known) > WORDS:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    ids = tuple(self.transducer.encode(piece.encode("utf-8", "replace")))
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        try:  # most texts are made of tokens that hold whole characters: the machine is at its start after each
            return "".join([self.whole[i] for i in ids])
        except KeyError:
            feed = self.machine.feed
            return "".join([feed(i) for i in ids]) + self.machine.finish()


@contextmanager
def _no_collection() -> Iterator[None]:
    """While a batch is at work: states make no garbage, and looking through them time and again is most of the cost."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@functools.cache
def codec(vocabulary: str, pattern: str | None) -> Codec:
    """One for each worker process; the vocabulary is a path, or the name of an installed public one."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    return Codec(read_ranks(path), pattern or public_tokenizers.PATTERN)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """doc_id and ids of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for ids, texts in columns_of(batches, "doc_id", "text"):
            with _no_collection():
                found = [c.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for docs, ids in columns_of(batches, "doc_id", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([c.decode(i or []) for i in ids], pa.string())], names=["doc_id", "text"])

    bounded_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, lasting: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding, and decoding of those ids, in one pass.

    lasting: workers keep their states for the next task; else they give the memory back after each.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        names = _Decimal()
        for docs, texts in columns_of(batches, "doc_id", "text"):
            n, a, b = [], [], []
            with _no_collection():
                for t in texts:
                    ids = c.encode(t)
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not lasting:
            c = None
            codec.cache_clear()
            gc.collect()

    bounded_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Decimal(dict):
    def __missing__(self, i: int) -> str:
        self[i] = s = str(i)
        return s


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


def encode_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the digests of what the pipeline keeps."""
    return digests(docs, lasting=False)


def round_trip(docs: DataFrame) -> Column:
    """A condition on digests() joined with docs: the decoded text is the text."""
    return F.col("decoded_sha256") == F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
