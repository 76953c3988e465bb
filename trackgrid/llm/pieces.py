"""Operator 13: SentencePiece encoding with places in the source, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds;
every normalised byte remembers where its source starts. Merges then join characters to
pieces, and a piece's normalised bytes lead back to the bytes of the source it stands for.

Texts are encoded row by row in Arrow batches; no shuffle is needed. Merges never cross a
place where no piece of the vocabulary has a blank behind another character, so a text is cut
there and each distinct part is merged once by a task.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from trackgrid.llm.common import arrow_type, text_blocks

#: The sign that stands for a blank, kinds of pieces and the kind of model that merges.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGING = 2

#: Distinct parts of texts after which a task begins to forget, and the longest it remembers.
REMEMBERED, LONGEST = 1 << 17, 64
#: Parts that are merged side by side.
SIDE_BY_SIDE = 4096
#: Largest model file that is sent to tasks.
MAX_MODEL = 64 << 20
#: Ids that a task decodes in one step (one row may hold more).
STEP = 1 << 19


def _fields(data: bytes):
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            value = data[at:at + size]
            at += size
        yield tag >> 3, value


class Normalizer:
    """Normalisation by a compiled character map: a double array of prefixes and the texts they become."""

    def __init__(self, spec: bytes = b""):
        fields = dict(_fields(spec))
        self.dummy, self.squeeze, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))
        self.map = fields.get(2, b"")
        self.units = self.texts = None
        if self.map:
            size = struct.unpack_from("<I", self.map)[0]
            self.units = np.frombuffer(self.map, "<u4", size // 4, 4).tolist()
            self.texts = self.map[4 + size:]
            # Characters of ASCII that no prefix starts with, followed by another of ASCII, stay as they are.
            free = [b for b in range(128) if b != 32 and not self._starts(bytes([b])) and not any(self._starts(bytes([b, c])) for c in range(128))]
            self.plain = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in free) + rb"]+(?=[\x00-\x7F]|\Z)") if free else None

    def _starts(self, prefix: bytes) -> bool:
        """Whether the map has ``prefix`` or, for two bytes, anything that begins with it."""
        node, unit = 0, self.units[0]
        node ^= self._offset(unit)
        for byte in prefix:
            node ^= byte
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != byte:
                return False
            node ^= self._offset(unit)
        return len(prefix) > 1 or bool(unit >> 8 & 1)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the longest mapped prefix at ``at`` becomes and its length; else one character as it is."""
        units = self.units
        node, value, length = self._offset(units[0]), -1, 0
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value, length = units[node] & 0x7FFFFFFF, k + 1 - at
        if length:
            return self.texts[value:self.texts.index(b"\0", value)], length
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at:at + size], size

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped text and the source place of each of its bytes, blanks as they are."""
        out, sources, counts = [], [], []
        at = 0
        while at < len(data):
            run = self.plain and self.plain.match(data, at)
            if run:
                piece, size = run.group(), run.end() - at
                sources.append(np.arange(at, at + size))
            else:
                piece, size = self._prefix(data, at)
                sources.append(np.full(len(piece), at))
            out.append(piece)
            counts.append(len(piece))
            at += size
        return b"".join(out), np.concatenate(sources) if sources else np.zeros(0, np.int64)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source place of each byte and of the end."""
        text, source = self._mapped(data) if self.map else (data, np.arange(len(data)))
        end, sign = len(data), BLANK.encode() if self.escape else b" "
        raw = np.frombuffer(text, np.uint8)
        blank = raw == 32
        if self.squeeze and blank.any():
            # Blanks at the front and behind a blank go; those at the end follow below, signs of blanks with them.
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            raw, source, blank = raw[keep], source[keep], blank[keep]
            text = raw.tobytes()
        if not data or self.squeeze and not len(raw):
            return b"", np.array([end])
        if self.escape:
            source = np.repeat(source, np.where(blank, len(sign), 1))
            text = text.replace(b" ", sign)
        if self.dummy:
            text, source = sign + text, np.concatenate([np.full(len(sign), source[0] if len(source) else 0), source])
        source = np.append(source, end)
        while self.squeeze and text.endswith(sign):
            text, source = text[:-len(sign)], source[:len(source) - len(sign)]
        return text, source


class PieceModel:
    """Pieces and rules of a SentencePiece model that merges pairs."""

    def __init__(self, data: bytes):
        self.normalizer, trainer, self.pieces, scores, kinds = Normalizer(), {}, [], [], []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                self.normalizer = Normalizer(value)
        if trainer.get(3, 1) != MERGING or trainer.get(24, 0) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or not self.normalizer.escape:
            raise ValueError("only merging models of normal, byte and control pieces with blanks in front are supported")
        self.kinds = np.array(kinds, np.int64)
        self.unknown, self.end = trainer.get(40, 0), trainer.get(42, 2)
        self.unknown_surface = trainer.get(44, " ⁇ ".encode())
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.kinds == BYTE).tolist()} if trainer.get(35, 0) else {}
        # Where no piece has a blank behind another character, merges never cross from a word to the blank after it.
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.part = re.compile("(?s:.+)" if crossing else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.base = len(self.pieces) + 0x110000
        self.byte_sizes = np.array([len(p.encode()) for p in self.pieces], np.int64)
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)], np.int64)
        self._merge_table()
        # Decoding: what each piece stands for; pieces of bytes are one byte.
        spelled = [b"" if k == CONTROL else self.unknown_surface if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode()
                   for p, k in zip(self.pieces, kinds)]
        self.spelled = spelled
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(spelled), np.uint8)
        self.blank_first = np.array([k == NORMAL and p.startswith(BLANK) for p, k in zip(self.pieces, kinds)])

    def _merge_table(self) -> None:
        """Symbols (pieces, then code points of characters that are none) and what two of them next to each other make."""
        self.codes = len(self.pieces) + np.arange(0x110000)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.codes[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return self.ids.get(part, len(self.pieces) + ord(part) if len(part) == 1 else None)

        made = {}
        order = {x: k for k, x in enumerate(sorted(set(self.scores.values())))}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is not None and right is not None:
                    made[left * self.base + right] = (order[self.scores[piece]], i)
        keys = np.array(sorted(made), np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_rank, self.pair_made = (np.array([*[made[k][c] for k in keys.tolist()], -1], np.int64) for c in (0, 1))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (-1 where it makes no piece) and the piece it makes."""
        key = left * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1), self.pair_made[at]

    def _merge_step(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of parts of similar length and how many each has: in every round each part joins its best pair, the leftmost of equals."""
        n, width = len(parts), max(map(len, parts)) + 1
        sizes = np.fromiter(map(len, parts), np.int64, n)
        inside = np.arange(width) < sizes[:, None]
        symbol = np.full((n, width), -1, np.int64)
        symbol[inside] = self.codes[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        rank, made = np.full((n, width), -1, np.int64), np.zeros((n, width), np.int64)
        both = inside[:, :-1] & inside[:, 1:]
        rank[:, :-1][both], made[:, :-1][both] = self._pairs(symbol[:, :-1][both], symbol[:, 1:][both])
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        row = np.arange(n)
        while True:
            at = rank[row].argmax(1)
            going = rank[row, at] >= 0
            row, at = row[going], at[going]
            if not len(row):
                return symbol[inside], inside.sum(1)
            gone = after[row, at]
            symbol[row, at] = made[row, at]
            inside[row, gone] = False
            rank[row, gone] = rank[row, at] = -1
            follower = after[row, gone]
            after[row, at] = follower
            inner = follower < sizes[row]
            r, left, right = row[inner], at[inner], follower[inner]
            before[r, right] = left
            rank[r, left], made[r, left] = self._pairs(symbol[r, left], symbol[r, right])
            left = before[row, at]
            inner = left >= 0
            r, left, right = row[inner], left[inner], at[inner]
            rank[r, left], made[r, left] = self._pairs(symbol[r, left], symbol[r, right])

    def _coded(self, symbol: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids of parts and the normalised bytes that each takes, 32 bits of both; of bytes of one character the last takes all."""
        point = symbol - len(self.pieces)
        length = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        piece = point < 0
        many = np.where(piece | (not self.bytes), 1, length)
        of, k = np.repeat(np.arange(len(symbol)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids = np.where(piece, symbol, self.unknown)[of]
        sizes = np.where(piece, self.byte_sizes[np.where(piece, symbol, 0)], length)[of]
        if self.bytes:
            at = np.flatnonzero(~piece[of])
            cp, n, k = point[of[at]], length[of[at]], k[at]
            lead = np.where(n == 1, 0, (0xF00 >> n) & 0xFF)
            ids[at] = self.byte_ids[np.where(k == 0, lead | cp >> 6 * (n - 1), 0x80 | cp >> 6 * np.maximum(n - 1 - k, 0) & 0x3F)]
            sizes[at] = np.where(k == n - 1, n, 0)
        ends = (8 * np.cumsum(np.add.reduceat(many, np.cumsum(counts) - counts))).tolist()
        packed = (ids << 32 | sizes).tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_all(self, parts: list[str]) -> list[bytes]:
        """Codes of parts (none is empty), merged side by side in steps of similar length; long ones on their own."""
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        out: list = [None] * len(parts)
        at = 0
        while at < len(order):
            here = order[at:at + SIDE_BY_SIDE]
            if len(parts[here[0]]) > LONGEST:
                here = here[:1]
                pieces = self._merged_long(parts[here[0]])
                symbol = np.array([self.ids.get(p, len(self.pieces) + ord(p[0])) for p in pieces], np.int64)
                counts = np.array([len(pieces)])
            else:
                here = [k for k in here if len(parts[k]) <= LONGEST]
                symbol, counts = self._merge_step([parts[k] for k in here])
            for k, codes in zip(here, self._coded(symbol, counts)):
                out[k] = codes
            at += len(here)
        return out

    def _merged_long(self, part: str) -> list[str]:
        """Pieces of one part of any length from a heap of pairs; a character that is no piece stays one."""
        scores, symbols = self.scores, list(part)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            both = symbols[left] + symbols[right]
            score = scores.get(both)
            if score is not None:
                heap.append((-score, left, right, both))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        heapq.heapify(heap)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            # A pair is out of date once either side has been joined to something else.
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < len(symbols):
                    joined = symbols[a] + symbols[b]
                    score = scores.get(joined)
                    if score is not None:
                        heapq.heappush(heap, (-score, a, b, joined))
        return [s for s in symbols if s is not None]

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of each text and the bytes of the source, from start to end, that each stands for."""
        normal = [self.normalizer(data) for data in texts]
        parts = [self.part.findall(text.decode()) for text, _ in normal]
        every = np.empty(sum(map(len, parts)), object)
        every[:] = list(chain.from_iterable(parts))
        code, distinct = pd.factorize(every)
        codes = self._codes(distinct.tolist())
        # Ids and sizes of the distinct parts side by side, then those of all parts from there.
        counts = np.fromiter(map(len, codes), np.int64, len(codes)) // 8
        many = counts[code]
        at = np.repeat((np.cumsum(counts) - counts)[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.frombuffer(b"".join(codes), np.int64)[at]
        all_ids, all_ends = (both >> 32).astype(np.int32), np.cumsum(both & 0xFFFFFFFF)
        bounds = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
        out = []
        for k, (_, source) in enumerate(normal):
            cut = slice(bounds[k], bounds[k + 1])
            ids, ends = all_ids[cut], all_ends[cut] - (all_ends[bounds[k] - 1] if bounds[k] else 0)
            if not self.bytes and len(ids):
                # Unknown pieces next to each other are one.
                last = np.append((ids[:-1] != self.unknown) | (ids[1:] != self.unknown), True)
                ids, ends = ids[last], ends[last]
            starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
            out.append((ids, source[starts], source[ends]))
        return out

    def _codes(self, distinct: list[str]) -> list[bytes]:
        """Codes of distinct parts; what was needed lately is remembered."""
        new, old = self._new, self._old
        codes = [new.get(p) or old.get(p) for p in distinct]
        missing = [k for k, c in enumerate(codes) if c is None]
        for k, c in zip(missing, self._merge_all([distinct[k] for k in missing])):
            codes[k] = c
        new.update(zip(distinct, codes))
        for part in [p for p in distinct if len(p) > LONGEST]:
            del new[part]
        if len(new) > REMEMBERED:
            self._new, self._old = {}, new
        return codes

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one text."""
        return self.encode_all([data])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: pieces side by side without the blank in front; bytes that are no character become U+FFFD each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("ids outside of the vocabulary")
        ids = ids[self.kinds[ids] != CONTROL]
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        cut = int(len(ids) > 0 and (self.normalizer.dummy or self.normalizer.squeeze) and self.blank_first[ids[0]])
        try:
            return self.table[at][cut:].tobytes().decode()
        except UnicodeDecodeError:
            out, run = [], []
            for i in [*ids.tolist(), None]:
                if i is not None and self.kinds[i] == BYTE:
                    run.append(self.spelled[i])
                    continue
                out.append(_characters(b"".join(run)))
                run = []
                if i is not None:
                    out.append(self.spelled[i].decode())
            return "".join(out)[cut:]


def _characters(run: bytes) -> str:
    """Characters of a run of bytes; each byte that belongs to none is U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at:at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def _model(docs: DataFrame, model_file: str):
    """The model file, read once and sent to tasks; returns what makes the model, once per Python worker."""
    if os.path.getsize(model_file) > MAX_MODEL:
        raise ValueError(f"the model file is larger than {MAX_MODEL} bytes")
    with open(model_file, "rb") as f:
        data = f.read()
    PieceModel(data)
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def model() -> PieceModel:
        key = hash(sent.value)
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = PieceModel(sent.value)
        return _MODELS[key]

    return model


_MODELS: dict[int, PieceModel] = {}


def encode(docs: DataFrame, model_file: str, *, end: bool = True, text: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Ids of every whole text, as the library gives them without sampling, and where in the text each comes from.

    Adds to the columns ``keep`` (all by default) ``n_tokens``, ``ids``, with the end id last if ``end``, and, if
    ``spans``, ``id_starts`` and ``id_ends``: places in the text's UTF-8 bytes, one per id. Of the bytes a character
    falls back to, the last stands for the character and the others for nothing at its place; the end id
    stands for nothing at the text's end. A blank that is only put in front stands for nothing of its own.

    NULL is empty text; empty texts have the end id only. Signs of the vocabulary inside a text (``</s>``) are ordinary
    text. Rows are encoded one by one, so repeated rows and ids give repeated results, and an empty table an
    empty one. Very long texts are encoded whole; a part without blanks takes time as its length times the logarithm.
    Columns of the input with the new names are replaced.
    """
    new = ["n_tokens", "ids", "id_starts", "id_ends"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    ddl = "n_tokens long, ids array<int>" + (", id_starts array<int>, id_ends array<int>" if spans else "")
    added = StructType.fromDDL(ddl)
    kind = arrow_type(added["ids"].dataType)
    model = _model(docs, model_file)

    def task(batches):
        codes = model()
        for batch in batches:
            # One batch for each block of text, since ids and places take more room than the text.
            for first, n, data, starts in text_blocks(batch, text):
                raw = data.tobytes()
                columns: list[list[np.ndarray]] = [[], [], []]
                texts = [raw[starts[k]:starts[k + 1]] for k in range(n)]
                for k, found in enumerate(codes.encode_all(texts)):
                    last = (codes.end, starts[k + 1] - starts[k], starts[k + 1] - starts[k])
                    for column, values, x in zip(columns, found, last):
                        column.append(np.append(values, x).astype(np.int32) if end else values.astype(np.int32))
                sizes = np.array([len(x) for x in columns[0]], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, np.concatenate(c), type=kind) for c in (columns if spans else columns[:1])]
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), *lists], names=names)

    docs = docs.select(*dict.fromkeys([*keep, text]))
    out = StructType([docs.schema[c] for c in keep] + list(added))
    names = out.names
    return docs.mapInArrow(task, out)


def decode(encoded: DataFrame, model_file: str, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Texts of lists of ids, as the library decodes them, in ``decoded_text`` beside the columns ``keep`` (all by default).

    NULL and empty lists are empty texts, NULL ids in a list are left out; begin, end and other control ids stand for nothing and an unknown piece for
    the model's sign. Ids that are not in the vocabulary are an error. Rows are decoded one by one: repeated rows repeat
    and an empty table gives an empty one. A column of the new name is replaced.
    """
    keep = [c for c in (encoded.columns if keep is None else keep) if c != "decoded_text"]
    model = _model(encoded, model_file)

    def task(batches):
        codes = model()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            total = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.minimum(np.searchsorted(total, np.arange(STEP, (total[-1] if len(total) else 0) + STEP, STEP)) + 1, len(total)))
            for first, last in zip([0, *cuts], [*cuts, len(column)]):
                part = batch.slice(first, last - first)
                texts = [codes.decode(np.zeros(0, np.int64) if not row.is_valid else row.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)) for row in column.slice(first, last - first)]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=names)

    encoded = encoded.select(*dict.fromkeys([*keep, ids]))
    out = StructType([encoded.schema[c] for c in keep] + list(StructType.fromDDL("decoded_text string")))
    names = out.names
    return encoded.mapInArrow(task, out)
