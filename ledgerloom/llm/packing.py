"""Packing documents into training sequences: bounded-space online best fit.

Each partition streams its documents past a fixed number of open windows of ``capacity`` tokens.

* A document's whole windows close at once; what remains is placed in the fullest window that it fits in.
* If it fits in none and no window may be opened, the fullest is emitted.  Where more than ``slack`` tokens of it
  are free, the head of the remainder fills them first, so an emitted window never wastes more than ``slack``.
* What is open at the end of a partition is merged: the windows of ``fan_in`` partitions meet in one task (at most
  ``fan_in * open_windows`` windows, whatever the partitions hold), whole windows are placed best fit, largest
  first, and what is still not full is laid end to end, cut at ``capacity``, its tail at powers of two, which need
  no padding.

So memory is bounded by the windows, nothing is sorted or shuffled but the leftovers, and only leftovers are ever cut
a second time.  Pieces with their ids are written once to the shared folder.

A piece's place: ``sequence_id`` and ``offset`` there, gapless from 0.  Sequences are numbered inside their
partition (or merging task), whose number is the upper half, so no counter is shared.  ``padded_length`` gives what
a sequence takes.

Token ids are those of the public ``tokenizers`` library.  Its vocabulary is applied to each run of non-blanks alone
and remembered: the normaliser, the split and the merges of a vocabulary whose pattern never crosses white space
give the same ids there; any other vocabulary is refused.

Defined results: a null or empty text, or one of blanks, is its end token alone; texts are taken whole; repeated
rows are packed each, null ids too; ties (equally full windows) go to the one opened first; bytes that aren't UTF-8
become U+FFFD; an empty table gives no rows; of the input's columns only the id is returned, and the other
columns are the operator's own.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from .common import BYTE_LEVEL, Memo, as_bytes, settle, text_bytes

MAX_VOCABULARY_BYTES = 64 << 20
#: Upper bit of the numbers of sequences that merging makes.
MERGED = 1 << 62
_WORDS = 1 << 19
_LONGEST = 48
#: Words of ASCII and of letters up to U+017F but U+0130: each is its own NFC, and lower-casing gives letters of that range.
_PLAIN = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-įı-ſ]+").fullmatch
# Fixed value: the vocabulary's own pattern, for such words after lower-casing.
_MATCHES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+").findall
_OUT_BYTES = 4 << 20


def read_vocabulary(path: str) -> str:
    """A tokenizer's JSON file, if it treats each run of non-blanks alone."""
    with open(path, encoding="utf-8") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} characters")
    made = json.loads(data)
    split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or r"[^\s\p{L}\p{N}]+" not in split["pattern"].get("Regex", ""):
        raise ValueError(f"{path}: only vocabularies whose matches hold no white space, which is removed, can be applied word by word")
    return data


class WordIds:
    """Ids of texts, word by word; words are remembered in two generations, so memory is bounded and frequent words stay.

    Most words are of ASCII and Latin letters.  They are lower-cased and cut by the pattern here, and each match, which
    is remembered too, goes to the library's merges directly; all other words take the library's whole way.
    """

    def __init__(self, vocabulary: str, most: int = _WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        made = json.loads(vocabulary)
        self.plain = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and made["model"]["type"] == "BPE" and all(t["content"].startswith("<|") for t in made["added_tokens"])
        self.most, self.young, self.old = most, {}, {}
        self.matches = Memo(self._match, most // 2, _LONGEST)

    def _match(self, text: str) -> bytes:
        """Ids of one match of the pattern, already normalised."""
        shown = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(BYTE_LEVEL)  # such words have no blanks
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, others = {}, []
        for w in words:
            text = w.decode("utf-8", "replace")
            if self.plain and len(w) <= _LONGEST and _PLAIN(text) and "<|" not in text:  # special tokens begin with that
                young, of = self.matches.young.get, self.matches.of
                found[w] = b"".join([young(m) or of(m) for m in _MATCHES(text.lower())])
            else:
                others.append((w, text))
        for (w, _), made in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
            found[w] = b"".join([i.to_bytes(4, "little") for i in made.ids])
        return found

    def packed(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = text.split()
        found = list(map(self.young.get, words))
        if None in found:
            new: dict[bytes, bytes | None] = {w: self.old.get(w) for w, ids in zip(words, found, strict=True) if ids is None}
            new |= self._new([w for w, ids in new.items() if ids is None])
            found = [ids if ids is not None else new[w] for w, ids in zip(words, found, strict=True)]
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young.update((w, ids) for w, ids in new.items() if len(w) <= _LONGEST)
        return b"".join(found)


_built: dict[str, WordIds] = {}


def _words(key: str, vocabulary: str) -> WordIds:
    if key not in _built:
        _built.clear()
        _built[key] = WordIds(vocabulary)
    return _built[key]


class Window:
    """Pieces (id, start, ids, tokens of its document) and how many tokens they have."""

    def __init__(self, number: int):
        self.number, self.fill, self.pieces = number, 0, []

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[2]) // 4

    def rows(self) -> Iterator[tuple]:
        """(id, start, length, ids, tokens of its document, sequence, offset) of each piece."""
        offset = 0
        for doc, start, ids, of in self.pieces:
            yield doc, start, len(ids) // 4, ids, of, self.number, offset
            offset += len(ids) // 4


def cut(piece: tuple, tokens: int) -> tuple[tuple, tuple]:
    doc, start, ids, of = piece
    return (doc, start, ids[: 4 * tokens], of), (doc, start + tokens, ids[4 * tokens :], of)


class OpenWindows:
    """At most ``most`` open windows; ``put`` gives the windows that a piece of any length closes."""

    def __init__(self, capacity: int, most: int, slack: int, first: int):
        self.capacity, self.most, self.slack, self.next = capacity, most, slack, first
        self.by_fill: list[tuple[int, int]] = []  # (fill, minus the number): of equals the first opened is the last
        self.windows: dict[int, Window] = {}

    def _new(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def _take(self, at: int) -> Window:
        return self.windows.pop(-self.by_fill.pop(at)[1])

    def put(self, piece: tuple) -> Iterator[Window]:
        while (left := len(piece[2]) // 4) >= self.capacity:
            window = self._new()
            head, piece = cut(piece, self.capacity)
            window.add(head)
            yield window
        while left:
            fits = bisect_left(self.by_fill, (self.capacity - left + 1,)) - 1
            if fits < 0 and len(self.windows) == self.most:
                fullest = self._take(-1)
                if (free := self.capacity - fullest.fill) > self.slack:
                    head, piece = cut(piece, free)
                    fullest.add(head)
                    left -= free
                yield fullest
                continue
            window = self._take(fits) if fits >= 0 else self._new()
            window.add(piece)
            if window.fill == self.capacity:
                yield window
            else:
                self.windows[window.number] = window
                insort(self.by_fill, (window.fill, -window.number))
            return

    def rest(self) -> list[Window]:
        return [self.windows[-n] for _, n in self.by_fill]


def merge_windows(windows: list[Window], capacity: int, slack: int, first: int) -> list[Window]:
    """Close what partitions left open: whole windows best fit, largest first; what is not full after that is cut."""
    made: list[Window] = []
    for window in sorted(windows, key=lambda w: (-w.fill, w.number)):
        fits = [w for w in made if w.fill + window.fill <= capacity]
        into = max(fits, key=lambda w: (w.fill, -w.number)) if fits else Window(len(made))
        if not fits:
            made.append(into)
        for piece in window.pieces:
            into.add(piece)
    done = [w for w in made if w.fill >= capacity - slack]
    open_pieces = [p for w in made if w.fill < capacity - slack for p in w.pieces]
    left = sum(len(p[2]) // 4 for p in open_pieces)
    window = None
    for piece in open_pieces:
        while piece[2]:
            if window is None:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                window = Window(0)
            head, piece = cut(piece, min(room, len(piece[2]) // 4))
            window.add(head)
            room, left = room - len(head[2]) // 4, left - len(head[2]) // 4
            if not room:
                done.append(window)
                window = None
    for n, w in enumerate(done):
        w.number = first + n
    return done


def padded_length(fill, capacity: int = 4096):
    """What a sequence of ``fill`` tokens takes: itself at a power of two, else ``capacity``."""
    return F.when(fill.bitwiseAND(fill - 1) == 0, fill).otherwise(F.lit(capacity))


def _batch(rows: list[tuple], names: list[str], kind: pa.Schema, more: dict) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kind.field(n).type) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns + [pa.array([v] * len(rows), kind.field(n).type) for n, v in more.items()], schema=kind)


def pack(docs: DataFrame, path: str, end_token: int = 2, capacity: int = 4096, open_windows: int = 16, slack: int = 32, fan_in: int = 16,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (packed), ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    vocabulary = read_vocabulary(path)
    shared = spark.sparkContext.broadcast((hashlib.sha256(vocabulary.encode()).hexdigest(), vocabulary))
    own = [("start", LongType()), ("length", LongType()), ("ids", BinaryType()), ("doc_tokens", LongType()), ("sequence_id", LongType()), ("offset", LongType())]
    pieces = StructType([StructField("__id", docs.schema[id_column].dataType), *[StructField(n, t) for n, t in own]])
    packed = StructType([*pieces.fields, StructField("open", BooleanType()), StructField("part", LongType())])
    names, end = pieces.names, end_token.to_bytes(4, "little")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, part, words = to_arrow_schema(packed), TaskContext.get().partitionId(), _words(*shared.value)
        space, rows, size = OpenWindows(capacity, open_windows, slack, part << 32), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.packed(as_bytes(text.as_py())) + end
                for window in space.put((doc.as_py(), 0, ids, len(ids) // 4)):
                    rows += window.rows()
                    size += 4 * window.fill
                if size >= _OUT_BYTES:
                    yield _batch(rows, names, kind, {"open": False, "part": part})
                    rows, size = [], 0
        if rows:
            yield _batch(rows, names, kind, {"open": False, "part": part})
        if left := [r for w in space.rest() for r in w.rows()]:
            yield _batch(left, names, kind, {"open": True, "part": part})

    def merge(table: pa.Table) -> pa.Table:
        windows: dict[int, Window] = {}
        for row in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.setdefault(row["sequence_id"], Window(row["sequence_id"])).add((row["__id"], row["start"], row["ids"], row["doc_tokens"]))
        done = merge_windows(list(windows.values()), capacity, slack, MERGED | (table["group"][0].as_py() << 32))
        kind = pa.schema([f for f in table.schema if f.name in names])
        return pa.Table.from_batches([_batch([r for w in done for r in w.rows()], names, kind, {})])

    placed = settle(docs.select(F.col(id_column).alias("__id"), text_bytes(text_column).alias("__t")).mapInArrow(place, packed), "pack-pieces")
    left = placed.filter("open").select(*names, F.floor(F.col("part") / fan_in).cast("bigint").alias("group"))
    merged = left.groupBy("group").applyInArrow(merge, pieces)
    return placed.filter("not open").select(*names).unionByName(merged).withColumnRenamed("__id", id_column)
