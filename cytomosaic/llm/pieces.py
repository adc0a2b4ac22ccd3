"""SentencePiece encoding and decoding with source offsets.

The text is normalised by the longest prefix found in the model's compiled character map; each normalised byte remembers
the source byte it came from. Merging then works on the normalised text, and each piece's span is projected back through
that record. Texts are cut where no piece of the vocabulary can reach across, so the merges of a chunk are the merges of
the whole text, and equal chunks are merged once per task.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import binaries, lists, map_batches

SPACE = "▁"
#: Distinct chunks, and their characters, a task remembers before it starts afresh; bytes of texts encoded at once.
REMEMBERED_CHUNKS, REMEMBERED_CHARS = 200_000, 4_000_000
BYTES_AT_ONCE = 4 << 20
#: Chunks up to this many characters are merged side by side, longer ones one by one.
SHORT = 24
NEVER = np.int32(2**31 - 1)
# piece types of the model file (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


class CharacterMap:
    """The compiled map: a double-array trie over source bytes whose leaves point at replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :] if blob else b""

    def longest_prefix(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``text[at:]`` and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Pieces:
    """A BPE model file, read from its bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != BPE:
            raise ValueError("only BPE models are supported")
        rules = proto.normalizer_spec
        self.chars = CharacterMap(rules.precompiled_charsmap)
        self.dummy_prefix, self.trim = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.escape, self.suffix = rules.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix
        if self.suffix or not self.escape:
            raise ValueError("models with spaces as suffixes or unescaped spaces are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unknown = self.types.index(UNKNOWN)
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.costs = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        inner = [p for p in self.ids if len(p) > 1]
        reaching = {c for p in inner for c in p}
        self.alone = alone = "" if "\n" in reaching else "\n"
        self.across = across = any(SPACE in p.lstrip(SPACE) for p in inner)
        # chunks end where no piece reaches across: before spaces, and around a character that no longer piece has
        self.chunks = re.compile(".+" if across else f"{alone or '(?!)'}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+", re.S)
        self.plain = not self.chars.units and not self.trim
        self.known: dict[str, bytes] = {}  # ids and source sizes by turns
        self.known_chars = 0
        self._pairs = None
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        for b, i in enumerate(self.bytes_ids or []):
            self.surface[i] = chr(b)
        # pieces whose text depends on their neighbours, or that are no text
        easy = {*self.ids.values(), *(self.bytes_ids or [])[:128]}
        self.hard = np.array([self.trim or i not in easy for i in range(len(self.pieces))])

    # --- normalisation -------------------------------------------------------------------------------------------

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, the source byte it starts from."""
        if not text:
            return b"", np.zeros(1, np.int32)
        space = SPACE.encode()
        steps: list[tuple[int, int, bytes]] = []
        at = 0
        while at < len(text):
            hit = self.chars.longest_prefix(text, at)
            if hit is None:
                first = text[at]
                width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                hit = width, text[at : at + width]
                if first >= 0x80 and not _valid(hit[1]):  # a byte of no character, as the library takes it
                    hit = 1, "�".encode()
            steps.append((at, at + hit[0], hit[1]))
            at += hit[0]
        if self.trim:  # leading and trailing spaces go
            lead = 0
            while lead < len(steps) and steps[lead][2] == b" ":
                lead += 1
            steps = steps[lead:]
        if not steps:
            return b"", np.array([len(text)], np.int32)
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += space
            source += [steps[0][0]] * 3
        blank = self.trim
        for start, _, piece in steps:
            if blank:
                piece = piece.lstrip(b" ")
            escaped = piece.replace(b" ", space)
            out += escaped
            source += [start] * len(escaped)
            if piece:
                blank = self.trim and piece.endswith(b" ")
        end = steps[-1][1]
        if self.trim:
            while out.endswith(space) and len(out) > 3 * self.dummy_prefix:
                del out[-3:]
                end = source[-3]
                del source[-3:]
        return bytes(out), np.array([*source, end], np.int32)

    # --- merging -------------------------------------------------------------------------------------------------

    def merge(self, chunk: str) -> list[str]:
        """Best score first, then leftmost, until no neighbours make a piece."""
        parts: list[str] = list(chunk)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []
        cost = self.costs.get

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = parts[left] + parts[right]
                found = cost(both)
                if found is not None:
                    heapq.heappush(heap, (found, left, right, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != len(both) or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def pieces_of(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a chunk and how many normalised bytes each takes; of a character's byte pieces the last takes all."""
        ids, sizes = [], []
        for part in self.merge(chunk):
            number, raw = self.ids.get(part), part.encode()
            if number is not None:
                ids.append(number)
                sizes.append(len(raw))
            elif self.bytes_ids:
                ids += [self.bytes_ids[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def cut(self, text: bytes) -> list[str] | None:
        """The chunks of a text whose normalisation only marks spaces; None for any other text."""
        if not self.plain or SPACE.encode() in text:
            return None
        try:
            chars = text.decode()
        except UnicodeDecodeError:
            return None
        if self.across or "  " in chars or chars[:1] == " ":
            return self.chunks.findall((SPACE if self.dummy_prefix else "") + chars.replace(" ", SPACE))
        chars = ((SPACE if self.dummy_prefix else "") + chars).replace(" ", " " + SPACE)
        return list(filter(None, (chars.replace(self.alone, f" {self.alone} ") if self.alone else chars).split(" ")))

    def encode_all(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids, and the first and the end source byte of each."""
        cut = [self.cut(t or b"") for t in texts]
        every = set().union(*[c for c in cut if c])
        new = every.difference(self.known)
        chars = sum(map(len, new))
        if len(self.known) + len(new) > REMEMBERED_CHUNKS or self.known_chars + chars > REMEMBERED_CHARS:
            self.known.clear()
            new, chars, self.known_chars = every, sum(map(len, every)), 0
        self.learn(new)
        self.known_chars += chars
        return [self.encode(t, c) for t, c in zip(texts, cut, strict=True)]

    def encode(self, text: bytes | None, cut: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not text:
            empty = np.empty(0, np.int32)
            return empty, empty, empty
        if cut is not None:
            turns = np.frombuffer(b"".join(map(self.known.__getitem__, cut)), np.int32).reshape(-1, 2)
            ends = np.cumsum(turns[:, 1], dtype=np.int32)
            starts = ends - turns[:, 1]
            if self.dummy_prefix:
                starts, ends = np.maximum(starts - 1, 0), ends - 1
            return turns[:, 0], starts, ends
        norm, source = self.normalise(text)
        ids, sizes = [], []
        for chunk in self.chunks.findall(norm.decode()):
            more, widths = self.pieces_of(chunk)
            ids += more
            sizes += widths
        ends = np.cumsum(np.array(sizes, np.int64))
        starts = ends - np.array(sizes, np.int64)
        return np.array(ids, np.int32), source[starts], source[ends]

    def learn(self, chunks: set[str]) -> None:
        """Remember ids and source sizes of chunks whose spaces are single source bytes."""
        short = sorted((c for c in chunks if len(c) <= SHORT), key=len)
        rest = [c for c in chunks if len(c) > SHORT]
        for at in range(0, len(short), 4096):
            rest += self.merge_many(short[at : at + 4096])
        for chunk in rest:
            ids, sizes = self.pieces_of(chunk)
            if chunk[0] == SPACE:  # three bytes here, one in the source
                sizes = [s and s - 2 * self.pieces[i].count(SPACE) for i, s in zip(ids, sizes, strict=True)]
            self.known[chunk] = array("i", [x for both in zip(ids, sizes, strict=True) for x in both]).tobytes()

    def pairs(self) -> tuple[np.ndarray, ...]:
        """For each two pieces that make a piece: a key, the rank of the outcome, and the outcome; made when first asked for."""
        if self._pairs is None:
            ranks = {c: r for r, c in enumerate(sorted(set(self.costs.values())))}
            found = [
                (self.ids[p[:i]] << 21 | self.ids[p[i:]], ranks[self.costs[p]], number)
                for p, number in self.ids.items()
                for i in range(1, len(p))
                if p[:i] in self.ids and p[i:] in self.ids
            ]
            keys, rank, made = np.array(sorted(found), np.int64).T
            char = np.arange(0x110000, dtype=np.int64) + len(self.pieces)  # a character without a piece joins nothing
            for piece, number in self.ids.items():
                if len(piece) == 1:
                    char[ord(piece)] = number
            size = np.array([len(p.replace(SPACE, " ").encode()) for p in self.pieces], np.int32)
            self._pairs = keys, rank.astype(np.int32), made, char, size
        return self._pairs

    def merge_many(self, chunks: list[str]) -> list[str]:
        """Merge chunks side by side and remember them; returns those with characters that have no piece."""
        keys, rank, made, char, size = self.pairs()
        lengths = np.array([len(c) for c in chunks])
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        width = int(lengths.max())
        symbols = np.full((len(chunks), width + 1), 1 << 20, np.int64)
        inside = np.arange(width + 1) < lengths[:, None]
        symbols[inside] = char[points]
        columns = np.arange(width)

        def look(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = left << 21 | right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, rank[at], NEVER), at

        costs = look(symbols[:, :-1], symbols[:, 1:])[0]
        rows = np.arange(len(chunks))
        while len(rows):
            at = costs[rows].argmin(axis=1)
            going = costs[rows, at] != NEVER
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            own = symbols[rows]
            own[np.arange(len(rows)), at] = made[look(symbols[rows, at], symbols[rows, at + 1])[1]]
            shifted = np.take_along_axis(own, np.minimum(columns + (columns > at[:, None]), width), 1)
            symbols[rows, :-1] = shifted
            symbols[rows, -1] = 1 << 20
            costs[rows] = np.take_along_axis(
                np.concatenate([costs[rows], np.full((len(rows), 1), NEVER, np.int32)], 1), columns + (columns >= at[:, None]), 1
            )
            lengths[rows] -= 1
            costs[rows, at] = look(symbols[rows, at], symbols[rows, at + 1])[0]
            left = np.maximum(at - 1, 0)
            costs[rows, left] = np.where(at > 0, look(symbols[rows, left], symbols[rows, left + 1])[0], costs[rows, left])
        inside = np.arange(width + 1) < lengths[:, None]
        flat = symbols[inside]
        odd = flat >= len(self.pieces)
        turns = np.stack([flat.astype(np.int32), size[np.where(odd, 0, flat)]], 1).tobytes()
        ends = (8 * np.cumsum(lengths)).tolist()
        strange = set(np.repeat(np.arange(len(chunks)), lengths)[odd].tolist())
        begin, left_over = 0, []
        for i, (chunk, end) in enumerate(zip(chunks, ends, strict=True)):
            if i in strange:
                left_over.append(chunk)
            else:
                self.known[chunk] = turns[begin:end]
            begin = end
        return left_over

    # --- decoding ------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces. Bytes that make no character give U+FFFD each."""
        if not len(ids):
            return ""
        if self.hard[ids].any():
            return self.decode_any(ids.tolist())
        text = "".join(map(self.surface.__getitem__, ids.tolist()))
        if self.dummy_prefix and text[:1] == " " and self.types[ids[0]] == NORMAL:
            return text[1:]
        return text

    def decode_any(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in [*ids, -1]:
            if i >= 0 and self.types[i] == BYTE:
                raw.append(self.bytes_ids.index(i))
                first = False
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
            if i < 0:
                break
            if self.types[i] == NORMAL:
                text = self.surface[i]
                if first and (self.dummy_prefix or self.trim):
                    text = text.lstrip(" ") if self.trim else text.removeprefix(" ")
                first = first and self.trim and not text
                out.append(text)
            elif self.types[i] == UNKNOWN:
                out.append(" ⁇ ")
                first = False
        return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is part of no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """The id column with ``ids``, ``starts`` and ``ends`` (arrays of int) for each row, and the decoded text if a name is given.

    Spans are source bytes, end exclusive. The space put before the text has an empty span at 0; of a character written
    as byte pieces the last piece has the span and the others are empty. A null or empty text has no pieces. A byte that is
    part of no character counts as U+FFFD. Rows are independent: repeated rows and null ids stay as they are, other columns
    are not read.
    """

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        pieces = Pieces(model)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            done = pieces.encode_all(binaries(batch, "text"))
            columns = {name: lists([d[i] for d in done], pa.int32()) for i, name in enumerate(("ids", "starts", "ends"))}
            if decoded:
                columns[decoded] = pa.array([pieces.decode(d[0]) for d in done], pa.string())
            return {id_col: batch.column(0), **columns}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_col), F.col(text_col).alias("text")),
        start,
        f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>" + (f", `{decoded}` string" if decoded else ""),
        most_bytes=BYTES_AT_ONCE,
    )


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and the text of the ids. Null ids give an empty text."""
    fields = [f for f in encoded.schema.fields if f.name != out_col]

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        pieces = Pieces(model)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            at = batch.schema.get_field_index(ids_col)
            column = batch.column(at)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [pieces.decode(values[a:b]) for a, b in zip(ends, ends[1:])]  # noqa: B905
            return {**{f.name: batch.column(i) for i, f in enumerate(fields)}, out_col: pa.array(texts, pa.string())}

        return work

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], f"`{out_col}` string"])
    return map_batches(encoded.select(*[F.col(f"`{f.name}`") for f in fields]), start, schema)
