"""Byte-level BPE encoding and decoding as a bounded-lookahead streaming transducer.

A text is cut into pieces (words with a leading space, numbers, runs of signs or white
space) and each piece is merged by the merge list. Bytes that have not been read yet can
only change tokens near the end of what has been read; ``lookahead`` computes from the
merge list how near. Tokens that end further back are stable and are emitted at once, so
a piece of any length needs a buffer of fixed size. Decoding turns ids into bytes and
bytes into characters with an incremental UTF-8 state machine.

Defined results: a null text encodes to no ids and decodes to the empty text; a special
token's string in a text becomes its id, as in the tokenizers library's default; extra
columns are never read, so their names may clash with the results'. Repeated rows are
encoded one by one, an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, functions as F

from latelane.llm.common import file_bytes, map_rows

# Fixed value: the public pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WINDOW = 1 << 16  # characters cut into pieces at a time
BLOCK = 512  # bytes a transducer reads beyond the lookahead before it emits
SHORT = 64  # bytes up to which a piece is kept in the piece cache
CACHE_PIECES = 300_000  # pieces a process remembers; the cache starts anew when full
CACHE_WORDS = 600_000  # the same for words with what follows up to the next space
_NONE = 1 << 30
_SHIFT = 20


def byte_symbols() -> dict[str, int]:
    """Symbol of the vocabulary file for each byte: printable ones stand for themselves,
    the others for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    symbols = {chr(b): b for b in printable}
    return symbols | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge list, token bytes and special tokens of a tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, symbols = spec["model"], byte_symbols()
        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of: dict[int, bytes] = {
            i: bytes(symbols[c] for c in token) for token, i in ids.items() if token not in special
        }
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = ids[c]
        self.rules: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rules.append((ids[left], ids[right], ids[left + right]))
        self.rank = {(a << _SHIFT) | b: r for r, (a, b, _) in enumerate(self.rules)}
        self.lookahead = lookahead(self.rules, {i: len(b) for i, b in self.bytes_of.items()})

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of a piece: always the lowest-ranked pair, the leftmost of equals."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > SHORT:
            return self._merged_long(ids)
        rank_of, rules = self.rank.get, self.rules
        ranks = [rank_of((a << _SHIFT) | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = rules[best][2]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i] << _SHIFT) | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1] << _SHIFT) | ids[i], _NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for blocks of a long piece."""
        n, rank_of = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := rank_of((ids[i] << _SHIFT) | ids[j], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i = heapq.heappop(heap)
            left, right, new = self.rules[r]
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]


def lookahead(rules: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes from the end of what was read within which tokens may still change.

    Compare a text with the same text continued. Rule by rule, the token sequences agree up
    to some place. A rule (u, v) moves that place back by |u| if u ends there and v starts
    there in one of the two; v has then grown rightwards from the u of the rule that made
    the former move. So the moves form chains of rules of rising rank in which each v has
    the former u on its left edge; the heaviest chain is the bound.
    """
    lefts: dict[int, set[int]] = defaultdict(set)
    heaviest: dict[int, int] = {}

    def behind(token: int) -> int:
        best, open_tokens, seen = 0, [token], {token}
        while open_tokens:
            t = open_tokens.pop()
            best = max(best, heaviest.get(t, 0))
            for left in lefts[t] - seen:
                seen.add(left)
                open_tokens.append(left)
        return best

    for u, v, new in rules:
        chain = length[u] + behind(v)
        heaviest[u] = max(heaviest.get(u, 0), chain)
        lefts[new].add(u)
    return max(heaviest.values(), default=0)


class Transducer:
    """Bytes of one piece in, stable ids out; ``finish`` gives the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.buffer = vocabulary, bytearray()

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        margin = self.vocabulary.lookahead
        for start in range(0, len(data), BLOCK):
            self.buffer += data[start : start + BLOCK]
            if len(self.buffer) < margin + BLOCK:
                continue
            stable, end = len(self.buffer) - margin, 0
            for token in self.vocabulary.merged(bytes(self.buffer)):
                n = len(self.vocabulary.bytes_of[token])
                if end + n > stable:
                    break
                out.append(token)
                end += n
            del self.buffer[:end]
        return out

    def finish(self) -> list[int]:
        rest = self.vocabulary.merged(bytes(self.buffer))
        self.buffer.clear()
        return rest


class _Pieces(dict):
    """Packed ids (little-endian, 4 bytes each) of the pieces met so far, bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > SHORT:
            machine = Transducer(self.vocabulary)
            return packed(machine.feed(data)) + packed(machine.finish())
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = packed(self.vocabulary.merged(data))
        self[piece] = ids
        return ids


def packed(ids: Iterable[int]) -> bytes:
    data = array("I", ids)
    if data.itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
        return b"".join(i.to_bytes(4, "little") for i in data)
    return data.tobytes()


def unpacked(data: bytes) -> list[int]:
    if array("I").itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]
    ids = array("I")
    ids.frombytes(data)
    return ids.tolist()


class _SpaceInRun(Exception):
    """White space stands before a space, which then need not begin a piece."""


class _Words(dict):
    """Packed ids of a space and the word after it, up to the next space; bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        if not word or word[-1].isspace():
            raise _SpaceInRun
        if len(word) > SHORT:
            return b"".join(self.encoder.by_pattern(" " + word))
        encoder = self.encoder
        found = encoder.pattern.findall(" " + word)
        if len(found) == 1:
            ids = packed(encoder.vocabulary.merged(found[0].encode()))
        else:
            ids = b"".join(map(encoder.pieces.__getitem__, found))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Streams a text's ids as packed blocks; state does not grow with the text.

    A space after anything but white space always begins a piece. So texts are cut at such
    spaces first, and words met before cost one look-up.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces, self.words = _Pieces(vocabulary), _Words(self)
        self.pattern = regex.compile(PIECES)
        ordered = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None

    def blocks(self, text: str) -> Iterator[bytes]:
        start = 0
        for hit in self.special.finditer(text) if self.special else ():
            yield from self._span(text[start : hit.start()])
            yield packed([self.vocabulary.special[hit.group()]])
            start = hit.end()
        yield from self._span(text[start:] if start else text)

    def _span(self, text: str) -> Iterator[bytes]:
        start, end = 0, len(text)
        while start < end:
            cut = end
            if end - start > WINDOW:
                cut = text.rfind(" ", start + 1, start + WINDOW)
                if cut < 0 or text[cut - 1].isspace():
                    yield from self.by_pattern(text[start:])
                    return
            yield from self._window(text[start:cut] if cut - start < end else text)
            start = cut

    def _window(self, text: str) -> Iterator[bytes]:
        first, *words = text.split(" ")
        try:
            if first[-1:].isspace():
                raise _SpaceInRun
            ids = b"".join(map(self.words.__getitem__, words))
        except _SpaceInRun:
            yield from self.by_pattern(text)
            return
        yield from self.by_pattern(first)
        yield ids

    def by_pattern(self, text: str) -> Iterator[bytes]:
        """Cut by the pattern, a window at a time."""
        start, end = 0, len(text)
        packed_ids = self.pieces.__getitem__
        while end - start > WINDOW:
            found = self.pattern.findall(text, start, start + WINDOW)
            # The window's edge can change its last two pieces; they are read again.
            sure = found[:-2]
            if sure:
                yield b"".join(map(packed_ids, sure))
                start += WINDOW - len(found[-1]) - len(found[-2])
                continue
            stop = self.pattern.match(text, start).end()
            machine = Transducer(self.vocabulary)
            for at in range(start, stop, WINDOW):
                yield packed(machine.feed(text[at : min(stop, at + WINDOW)].encode()))
            yield packed(machine.finish())
            start = stop
        yield b"".join(map(packed_ids, self.pattern.findall(text, start, end)))


class Decoder:
    """Ids in, text out: characters leave as soon as their bytes are complete."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of, ids)))

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


_loaded: dict[bytes, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The process's encoder for a vocabulary file, kept between tasks."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(content))
    return _loaded[key]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``ids`` (array of int) of every row; a null text has no ids."""
    content = df.sparkSession.sparkContext.broadcast(file_bytes(path))  # the file's fixed size

    def make():
        machine = encoder(content.value)
        return lambda k, t: [(k, unpacked(b"".join(machine.blocks(t or ""))))]

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[0].dataType.simpleString()
    return map_rows(rows, f"`{key}` {kind}, ids array<int>", make, size=lambda r: 4 * len(r[1]))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and ``text`` of every row's ids; null ids give the empty text.

    Bytes that are no UTF-8 become U+FFFD, an id outside the vocabulary raises KeyError.
    """
    content = df.sparkSession.sparkContext.broadcast(file_bytes(path))

    def make():
        vocabulary = encoder(content.value).vocabulary

        def each(k, tokens):
            machine = Decoder(vocabulary)
            return [(k, machine.feed(tokens or []) + machine.finish())]

        return each

    rows = df.select(F.col(key), F.col(ids))
    kind = rows.schema[0].dataType.simpleString()
    return map_rows(rows, f"`{key}` {kind}, text string", make, size=lambda r: len(r[1]))


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Count and SHA-256 of every document's ids and of the text decoded from them.

    Ids and decoded characters are hashed block by block as they leave the two machines.
    """
    content = df.sparkSession.sparkContext.broadcast(file_bytes(path))

    def make():
        machine = encoder(content.value)

        def each(doc_id, text):
            ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
            decoder = Decoder(machine.vocabulary)
            for block in machine.blocks(text or ""):
                ids_hash.update(block)
                n += len(block) // 4
                text_hash.update(decoder.feed(unpacked(block)).encode())
            text_hash.update(decoder.finish().encode())
            return [(doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest())]

        return each

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(df.select("doc_id", "text"), schema, make)
