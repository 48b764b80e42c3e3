"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. The BPE of every prefix of a piece ends in one token: the only suffix of it that is a
token and may stand after the last token of what comes before (two tokens may stand side by side
if the BPE of their bytes is these two). A state of the transducer is the last settled token and
the bytes since then; it knows the last token at each of them, and the longest suffix with which a
token begins. A step by a byte takes that suffix one further, finds the last token at the new
position, and emits all tokens that the starts from which one may still go on agree upon, so that
never more bytes than the longest token wait. States and steps are kept when a state has been met
often enough, and looked up from then on; what is left of a short piece in a state seldom met takes
the same steps without keeping them. A full table is emptied and fills again.

Decoding. Ids give bytes; an automaton over byte classes tells how many bytes at the end of a
buffer belong to a character that is not complete, so text can be given out piece by piece.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import parts

#: Entries of a worker's tables (pieces, states, pairs of tokens); a full table is emptied.
CACHE_ROWS, STATES, PAIRS = 400_000, 100_000, 400_000
#: Meetings of a state without a step for a byte before that step is kept.
MEETINGS = 4
#: Texts encoded at once: what waits in a worker is theirs.
BATCH = 256
#: Ids decoded at once.
STREAM = 4096
#: White space in a text other than these four makes the splitting by white space unsafe.
_EXOTIC = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: White space and a word of Latin letters that a mark (no apostrophe) or white space ends, or
#: white space and all up to the next, or white space.
_CHUNK = re.compile("[ \n\t\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n\t\r!-&(-/:-@\\[-`{-~]|$)|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: A space and letters: one pre-token, where chunks() gives it as a piece.
WORD = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LONG = 64
_TOKEN = (1 << 20) - 1


def chunks(text: str) -> list[str] | None:
    """Pieces whose borders no pre-token crosses and that do not depend on their neighbours: before
    white space that follows something else, and after a run of letters. None if the text holds rarer white space, for which that does not hold."""
    return None if _EXOTIC.search(text) else _CHUNK.findall(text)


class PieceCache:
    """Encodes texts piece by piece (see chunks) to bytes, each different piece of some texts looked up
    once; unknown pieces go to ``ask``, which encodes many at once."""

    def __init__(self, ask, rows: int = CACHE_ROWS):
        self.ask, self.rows = ask, rows
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """No reference cycles are made here, so Python need not search the tables for them."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.freeze()
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = self.pieces
        if len(pieces) > self.rows:
            pieces.clear()
        split = [chunks(t) for t in texts]
        flat = [p for s in split if s is not None for p in s]
        places = pa.array(flat, pa.large_string()).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(places > np.maximum.accumulate(np.r_[-1, places[:-1]])) if flat else []
        words = [flat[i] for i in first]
        made = list(map(pieces.get, words))
        new = [w for w, m in zip(words, made, strict=True) if m is None]
        if new:
            answers = self.ask(new)
            fresh = iter(answers)
            made = [next(fresh) if m is None else m for m in made]
            pieces.update((w, m) for w, m in zip(new, answers, strict=True) if len(w) <= _LONG)
        every = pa.array(made, pa.large_binary()).take(pa.array(places))
        data, at = every.buffers()[2], np.frombuffer(every.buffers()[1], dtype=np.int64, count=len(every) + 1) if len(every) else [0]
        data, done, out = memoryview(data) if data else b"", 0, []
        for t, s in zip(texts, split, strict=True):
            if s is None:
                out += self.ask([t])
            else:
                end = done + len(s)
                out.append(bytes(data[at[done] : at[end]]))
                done = end
        return out


class _Suffix:
    """Bytes with which a token begins, the tokens that end with them (length, token; longest first),
    the lengths of their ends with which a longer token begins, and where a byte leads."""

    __slots__ = ("goes", "next", "text", "tokens")

    def __init__(self, text: bytes, ranks: dict[bytes, int], beginnings: set[bytes]):
        ends = [(len(text) - i, text[i:]) for i in range(len(text))]
        self.text = text
        self.tokens = tuple((n, ranks[e]) for n, e in ends if e in ranks)
        self.goes = tuple(n for n, e in ends if e in beginnings)
        self.next: dict[int, _Suffix] = {}


class Transducer:
    """Encodes the bytes of one pre-token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.beginnings = {t[:i] for t in ranks for i in range(1, len(t))}
        self.suffixes: dict[bytes, _Suffix] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.clear()

    def clear(self) -> None:
        self.beside: dict[int, bool] = {}
        self.number: dict[tuple[int, bytes], int] = {}
        #: Last settled token, bytes since then, the last token at each of them with its start (start
        #: times 2^20 and token), suffix.
        self.states: list[tuple[int, bytes, tuple, _Suffix]] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.met: dict[int, int] = {}
        self._state(-1, b"", (), self._suffix(b""))

    def _suffix(self, text: bytes) -> _Suffix:
        """Of the longest end of the text that a token is or begins with."""
        while text and text not in self.beginnings and text not in self.ranks:
            text = text[1:]
        known = self.suffixes.get(text)
        if known is None:
            known = self.suffixes[text] = _Suffix(text, self.ranks, self.beginnings)
        return known

    def _state(self, before: int, pending: bytes, last: tuple, suffix: _Suffix) -> int:
        at = self.number.get((before, pending))
        if at is None:
            at = self.number[before, pending] = len(self.states)
            self.states.append((before, pending, last, suffix))
        return at

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token of several bytes; None if merges do not make it."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return None
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts that stand at the token's right (0) or left (1) border while it is merged, each
        with the rank of the merge that ends it."""
        known = self.spines.get((token, side))
        if known is None:
            part, until, known = self.token[token], float("inf"), []
            while True:
                known.append((part, until))
                if len(part) == 1:
                    break
                halves = self._halves(part)
                if halves is None:
                    known = []
                    break
                part, until = halves[1 - side], self.ranks[part]
            self.spines[token, side] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Whether no merge over the border of a and b comes before those that make a and b. Of equal
        merges the one further left comes first."""
        left, right = self._spine(a, 0), self._spine(b, 1)
        get, known = self.ranks.get, bool(left and right)
        for x, until_x in left:
            for y, until_y in right:
                rank = get(x + y)
                if rank is not None and rank < until_x and rank <= until_y:
                    known = False
        self.beside[a << 20 | b] = known
        return known

    def _longer(self, suffix: _Suffix, byte: int) -> _Suffix:
        made = suffix.next[byte] = self._suffix(suffix.text + byte.to_bytes())
        return made

    def _last(self, before: int, last: tuple | list, suffix: _Suffix, n: int) -> int:
        """The last token of n pending bytes that end with the suffix, and its start: of the tokens that
        end there the only one that fits what comes before it."""
        known = self.beside.get
        for size, token in suffix.tokens:
            start = n - size
            if start < 0:
                continue
            ahead = last[start - 1] & _TOKEN if start else before
            fits = ahead < 0 or known(ahead << 20 | token)
            if self._fits(ahead, token) if fits is None else fits:
                return start << 20 | token
        raise ValueError("the vocabulary lacks a byte")

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the state that follows, and what is settled on the way."""
        before, pending, last, suffix = self.states[state]
        pending += byte.to_bytes()
        longer = suffix.next.get(byte) or self._longer(suffix, byte)
        n = len(pending)
        last = (*last, self._last(before, last, longer, n))
        open_ = [n - size for size in longer.goes if size <= n]
        if open_ and not open_[0]:  # a token may still span all that is pending
            made = self._state(before, pending, last, longer), ()
        else:
            open_.append(n)
            while len(open_) > 1:  # back to the border that the ways to all of them pass
                at = last[open_.pop() - 1] >> 20
                if at > open_[-1]:
                    open_.append(at)
                elif at < open_[-1] and at not in open_:
                    insort(open_, at)
            cut = open_[0]
            if not cut:
                made = self._state(before, pending, last, longer), ()
            else:
                made = self._state(last[cut - 1] & _TOKEN, pending[cut:], tuple([x - (cut << 20) for x in last[cut:]]), longer), self._path(last, cut)
        self.steps[state << 8 | byte] = made
        return made

    def _rest(self, state: int, rest: bytes) -> tuple[int, ...]:
        """The tokens of what is pending and the rest, by steps that are not kept."""
        before, pending, last, suffix = self.states[state]
        last, n, known = list(last), len(pending), self.beside.get
        for byte in rest:
            suffix = suffix.next.get(byte) or self._longer(suffix, byte)
            n += 1
            for size, token in suffix.tokens:  # as in _last
                start = n - size
                if start < 0:
                    continue
                ahead = last[start - 1] & _TOKEN if start else before
                fits = ahead < 0 or known(ahead << 20 | token)
                if self._fits(ahead, token) if fits is None else fits:
                    last.append(start << 20 | token)
                    break
        return self._path(last, n)

    @staticmethod
    def _path(last: tuple | list, at: int) -> tuple[int, ...]:
        out = []
        while at:
            x = last[at - 1]
            at = x >> 20
            out.append(x & _TOKEN)
        out.reverse()
        return tuple(out)

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is a token as a whole is that token: every token is its own BPE."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES or len(self.beside) > PAIRS:
            self.clear()
        out: list[int] = []
        state, known, short = 0, self.steps.get, len(piece) <= _LONG
        for i, byte in enumerate(piece):
            way = known(state << 8 | byte)
            if way is None:
                times = self.met.get(state, 0)
                if short and times < MEETINGS:
                    self.met[state] = times + 1
                    out += self._rest(state, piece[i:])
                    return out
                way = self.step(state, byte)
            state, emitted = way
            if emitted:
                out += emitted
        _, pending, last, _ = self.states[state]
        if pending:
            out += self._path(last, len(pending))
        return out


class Utf8Tail:
    """Automaton over UTF-8: how many bytes at the end of a buffer wait for more."""

    def __init__(self):
        self.need, self.low, self.high, self.seen = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> int:
        """Only the last three bytes can wait; what is before them needs no step."""
        if len(data) > 4 and not self.need:
            data = data[-4:]
        for b in data:
            if self.need and self.low <= b <= self.high:
                self.need, self.low, self.high, self.seen = self.need - 1, 0x80, 0xBF, self.seen + 1
                continue
            self.low, self.high = 0x80, 0xBF
            self.need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
            self.seen = 1
            if b in (0xE0, 0xF0):
                self.low = 0xA0 if b == 0xE0 else 0x90
            elif b in (0xED, 0xF4):
                self.high = 0x9F if b == 0xED else 0x8F
        return self.seen if self.need else 0


class Codec:
    """Texts to ids and back, for one vocabulary file of ranks (base64 token, rank) and a pattern
    of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.bytes_of = {str(i): t for t, i in ranks.items()}
        self.cache = PieceCache(lambda texts: [self._plain(t) for t in texts])

    def _plain(self, text: str) -> bytes:
        """Decimal ids, a space after each."""
        encode, out = self.fst.encode, []
        for piece in (text,) if WORD(text) else self.split(text):
            out += encode(piece.encode("utf-8", "surrogatepass"))
        return b"%d " * len(out) % tuple(out)

    def ids_texts(self, texts: list[str]) -> list[str]:
        """Decimal ids joined by one space, of every text."""
        return [x[:-1].decode() for at in range(0, len(texts), BATCH) for x in self.cache.encode(texts[at : at + BATCH])]

    def digests(self, ids: str) -> tuple[int, str, str]:
        """Number of decimal ids, SHA-256 of them and of the text that the streaming decoder gives out."""
        split, decoded = ids.split(), hashlib.sha256()
        for text in self._stream(split[at : at + STREAM] for at in range(0, len(split), STREAM)):
            decoded.update(text.encode())
        return len(split), hashlib.sha256(ids.encode()).hexdigest(), decoded.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.ids_texts([text])[0].split()]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, map(str, ids)))

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of lists of ids as they come: a character split over tokens waits until complete."""
        return self._stream(map(str, ids) for ids in parts)

    def _stream(self, parts: Iterable[Iterable[str]]) -> Iterator[str]:
        tail, held = Utf8Tail(), b""
        for ids in parts:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
            waits = tail.feed(data)
            held += data
            ready, held = held[: len(held) - waits], held[len(held) - waits :]
            if ready:
                yield ready.decode("utf-8", "replace")
        if held:
            yield held.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id_col, ids array<int>) of every row, or with ``digests`` (id_col, n_tokens, ids_sha256,
    decoded_sha256), where the streaming decoder gives the decoded text from the ids. Null texts count
    as empty and give no ids; other columns are not read; repeated rows give repeated rows. The vocabulary's path must be readable on every executor. Rows are never grouped, so
    hot keys do not matter; a text is handled whole. Empty tables give no rows."""
    file, own = default_vocabulary() if path is None or pattern is None else (path, pattern)
    file, own = path or file, pattern or own

    def run(batches):
        made = codec(file, own)
        for part in parts(batches, BATCH):
            texts = made.ids_texts([t or "" for t in part.column(1).to_pylist()])
            if digests:
                rows = [made.digests(t) for t in texts]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            else:
                columns = [pa.array([[int(x) for x in t.split()] for t in texts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "ids"]
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {rest}")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) from (id_col, ids). Null ids give null; bytes that are no UTF-8 are replaced."""
    file, own = default_vocabulary() if path is None or pattern is None else (path, pattern)
    file, own = path or file, pattern or own

    def run(batches):
        made = codec(file, own)
        for batch in parts(batches, BATCH):
            texts = ["".join(made.decode_stream([ids])) if ids is not None else None for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, F.col("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
