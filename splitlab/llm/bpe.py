"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

A sequence of tokens is the merge result of its bytes exactly if every two neighbours are (their joined bytes
merge to just the two). So each prefix of a piece has one last token: the one that ends there and fits the last
token of the prefix before it. The transducer reads bytes and puts out that last token; its state holds the
places where a token that is not finished yet may have begun, with the last token before each. Tokens are
final as soon as the ways back from all those places meet, which is at most one vocabulary entry later. States
and steps are made when a text first needs them.

Machines live in the Python worker. Their states, and the memo of whole pieces, are dropped and built anew when
they reach a fixed number, so memory is bounded; results do not depend on it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import getitem

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from splitlab.llm.frames import pick, with_ids

MAX_STATES = 70_000
MAX_PIECES = 180_000
CHUNK = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The merges by definition: the lowest rank first, the leftmost of equals. For short inputs."""
    never = len(ranks) + (1 << 40)
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [ranks.get(data[i : i + 2], never) for i in range(len(data) - 1)]
    while pairs:
        best = min(pairs)
        if best == never:
            break
        at = pairs.index(best)
        parts[at] += parts.pop(at + 1)
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], never)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], never)
    return [ranks[part] for part in parts]


class _State(dict):
    """The steps that are known, by byte; others are made when they are first taken."""

    __slots__ = ("places", "last", "machine")

    def __init__(self, places: tuple[tuple[bytes, int], ...], machine: Transducer):
        self.places = places  # (bytes read since the place, last token before it), the present place at the end
        self.last = places[-1][1]
        self.machine = machine

    def __missing__(self, byte: int) -> _State:
        return self.machine._step(self, byte)


class Transducer:
    """Encodes one piece; ``run`` is the machine, ``piece`` adds the rule that a whole entry stands for itself."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.width = {rank: len(token) for token, rank in ranks.items()}
        self.open = {token[:n] for token in ranks for n in range(1, len(token))}
        self.longest = max(map(len, ranks), default=1)
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.start = self._state(((b"", -1),))

    def _state(self, places) -> _State:
        found = self.states.get(places)
        if found is None:
            found = self.states[places] = _State(places, self)
        return found

    def _fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            first = self.spelling[left] if left >= 0 else b""
            want = [left, right] if left >= 0 else [right]
            known = self.fits[left, right] = merge(self.ranks, first + self.spelling[right]) == want
        return known

    def _step(self, state: _State, byte: int) -> _State:
        tail = bytes([byte])
        reached, kept = -1, []
        for read, last in state.places:
            read += tail
            token = self.ranks.get(read)
            if token is not None and reached < 0 and self._fit(last, token):
                reached = token
            if read in self.open:
                kept.append((read, last))
        kept.append((b"", reached))
        found = state[byte] = self._state(tuple(kept))
        return found

    def _settle(self, state: _State, lasts: list[int]) -> tuple[list[int], list[int]]:
        """(final tokens, last tokens of the places after them) where the ways back from all places meet."""
        ends = {len(lasts) - len(read) for read, _ in state.places}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - self.width[lasts[far - 1]])
        meet = ends.pop()
        return self._back(lasts[:meet]), lasts[meet:]

    def _back(self, lasts: list[int]) -> list[int]:
        out, at = [], len(lasts)
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= self.width[token]
        out.reverse()
        return out

    def run(self, data: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self._reset()
        if len(data) < 2 * self.longest:  # nothing settles before the end
            passed = list(accumulate(data, getitem, initial=self.start))
            out, at = [], len(data)
            while at:
                token = passed[at].last
                out.append(token)
                at -= self.width[token]
            out.reverse()
            return out
        state, lasts, out = self.start, [], []
        for byte in data:
            state = state[byte]
            lasts.append(state.last)
            if len(lasts) >= 2 * self.longest:  # bounded lookahead: at most the last entry is still open
                final, lasts = self._settle(state, lasts)
                out += final
        return out + self._back(lasts)

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.run(data)


class _Pieces(dict):
    """Tokens of whole pieces; a miss runs the transducer. Pieces not asked for again leave after two rounds."""

    def __init__(self, machine: Transducer, limit: int):
        super().__init__()
        self.machine, self.limit, self.older = machine, limit // 2, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.machine.piece(piece.encode()))
        if len(piece) < 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """Incremental decoder: the state is the start of a character whose last bytes have not come yet."""

    #: First byte's lower bound -> length of the character.
    LENGTHS = ((0xF0, 4), (0xE0, 3), (0xC0, 2))

    def __init__(self, errors: str = "strict"):
        self.errors, self.pending = errors, b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                if next(length for least, length in self.LENGTHS if byte >= least) > back:
                    cut = len(data) - back
                break
            if byte < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", self.errors)

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", self.errors)


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES):
        self.machine = Transducer(ranks, max_states)
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.machine, max_pieces)
        self.spelling = self.machine.spelling

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))

    def decode(self, ids: list[int], errors: str = "strict") -> Iterator[str]:
        """Text in chunks as the ids stream in; characters split between tokens come out whole."""
        stream = Utf8Stream(errors)
        for at in range(0, len(ids), CHUNK):
            yield stream.feed(self.decode_bytes(ids[at : at + CHUNK]))
        yield stream.close()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> Codec:
    return Codec(load_ranks(path), pattern, max_pieces, max_states)


def encode_documents(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every whole text and the text that they decode to.

    Null texts count as empty: no ids, an empty decoded text. Repeated rows are encoded each by itself; an
    empty table gives no rows; other columns are left behind.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(batches):
        tool = codec(path, pattern)
        for batch in batches:
            for row in range(0, len(batch), 64):  # few texts at a time: their ids take more room than they do
                part = batch.iloc[row : row + 64]
                ids = [tool.encode(x or "") for x in part[text]]
                yield pd.DataFrame({"doc_id": part[doc_id], "ids": ids, "decoded": ["".join(tool.decode(x)) for x in ids]})

    return _per_document(df, doc_id, text, work, "ids array<int>, decoded string")


def digest_documents(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     doc_id: str = "doc_id", text: str = "text", max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) through the same codec, without moving the ids to the JVM.

    The limits are those of a worker's memos; larger ones take memory and save time. Rows as in ``encode_documents``.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(batches):
        tool = codec(path, pattern, max_pieces, max_states)
        names = {i: str(i) for i in tool.spelling}
        for batch in batches:
            rows = []
            for value in batch[text]:
                ids = tool.encode(value or "")
                decoded = hashlib.sha256()
                for part in tool.decode(ids):
                    decoded.update(part.encode())
                spelled = " ".join(map(names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(spelled).hexdigest(), decoded.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch[doc_id].to_numpy())
            yield out

    return _per_document(df, doc_id, text, work, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _per_document(df, doc_id, text, work, columns) -> DataFrame:
    return with_ids(pick(df, doc_id, text), doc_id, work, "doc_id", columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: texts of one language and source stand together within a task, so machines and memos meet fewer words at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return digest_documents(docs.sortWithinPartitions("lang", "source"), max_pieces=4 * MAX_PIECES, max_states=4 * MAX_STATES)
