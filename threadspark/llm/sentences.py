"""SentencePiece encoding and decoding through a table of distinct chunks.

In the vocabulary no piece holds a whitespace marker after another character, so no merge crosses the
start of a marked word, and a text's ids are those of its marked words in order; the same holds for the decoded text. Each task keeps a table of the
distinct words it has met: a word is segmented, printed and decoded once while the table holds it, and the occurrences take what it found by position. One table
over the whole corpus would need every occurrence in a shuffle, several times the size of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadspark.llm.common import batches, rows_of

MARK = "▁"
#: Bytes of distinct chunks that a task keeps, about; beyond it the half that was not asked for lately goes, which costs time and changes no result.
TABLE_BYTES = 160 << 20

_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_processors: dict[str, object] = {}


def processor(model: str):
    """The library's processor for a model file, loaded once per worker."""
    if model not in _processors:
        import sentencepiece

        _processors[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _processors[model]


def check_separable(model: str) -> None:
    """Refuse a model whose pieces cross whitespace markers or whose normaliser changes texts."""
    sp = processor(model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    sample = "a  b\tÅ c "
    if crossing or sp.normalize(sample) != MARK + sample.replace(" ", MARK):
        raise ValueError(f"{model}: words can't be encoded one by one")


class ChunkTable:
    """What the library makes of distinct marked words, in two generations of ``size`` bytes together.

    Only strings are kept, so that the collector has nothing to visit: the printed ids, and the decoded text where it isn't the word itself.
    """

    def __init__(self, model: str, size: int = TABLE_BYTES) -> None:
        self.sp, self.most = processor(model), size // 2
        self.mark_id = self.sp.piece_to_id(MARK)
        self.before = self.sp.encode("a")
        # what decoding makes of a piece by itself; nothing where pieces are decoded together
        every = range(self.sp.get_piece_size())
        self.texts = {i: self.sp.id_to_piece(i) for i in every if not (self.sp.is_byte(i) or self.sp.is_unknown(i) or self.sp.is_control(i))}
        self.numbers = [str(i) for i in every]
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.weight = 0

    def _segment(self, chunks: list[str]) -> None:
        # the library puts the first marker before every text; a marker alone is a piece, not an empty text
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        texts, numbers = self.texts.__getitem__, self.numbers.__getitem__
        for c, ids in zip(chunks, found, strict=True):
            if c == MARK:
                ids = [self.mark_id]
            self.young[c] = printed = ",".join(map(numbers, ids))
            self.weight += 250 + 2 * len(c) + len(printed)
            try:
                if "".join(map(texts, ids)) == c:
                    continue
            except KeyError:
                pass
            # behind another word, as the library leaves out the first marker of a text
            text = self.sp.decode(self.before + ids)[1:]
            if text != c.replace(MARK, " "):
                self.odd[c] = text
                self.weight += 250 + 4 * len(c)

    def look_up(self, text: str) -> list[str]:
        """The chunks of a text in order; all of them are in ``young`` afterwards."""
        if not text:
            return []
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        if self.weight > self.most:
            self.old, self.young, self.weight = self.young, {}, 0
            self.odd = {c: x for c, x in self.odd.items() if c in self.old}
        young, old = self.young, self.old
        new = []
        for c in dict.fromkeys(chunks):
            if c not in young:
                if c in old:
                    young[c] = printed = old[c]
                    self.weight += 250 + 2 * len(c) + len(printed)
                else:
                    new.append(c)
        if new:
            self._segment(new)
        return chunks

    def _printed(self, chunks: list[str]) -> str:
        return ",".join(map(self.young.__getitem__, chunks))

    def _decoded(self, text: str, chunks: list[str]) -> str:
        if self.odd.keys().isdisjoint(chunks):
            return text.replace(MARK, " ")
        return "".join([self.odd[c] if c in self.odd else c.replace(MARK, " ") for c in chunks])[1:]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin and end ids."""
        printed = self._printed(self.look_up(text))
        return list(map(int, printed.split(","))) if printed else []

    def decoded(self, text: str) -> str:
        """What the library decodes the ids of a text to."""
        return self._decoded(text, self.look_up(text))

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of a text's ids, and the SHA-256 of the printed ids and of the decoded text."""
        chunks = self.look_up(text)
        printed, decoded = self._printed(chunks), self._decoded(text, chunks)
        count = printed.count(",") + 1 if printed else 0
        return count, sha256(printed.encode()).hexdigest(), sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids. A null or empty text has no ids; repeated rows and ids, and null ids, give a row each.

    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    check_separable(model)

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model, table_bytes)
        yield from batches(((i, chunks.encode(t or "")) for i, t in rows_of(incoming)), "doc_id long, ids array<int>", 64)

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the decoded text of each row of ``encoded``; null ids decode to the empty text."""
    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        rows = ((i, ids, sp.decode(ids or [])) for i, ids in rows_of(incoming))
        yield from batches(rows, "doc_id long, ids array<int>, text string", 64)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def token_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs``, in one pass; ids and texts don't leave the task.

    Odd rows are treated as by ``encode_texts``; an empty text has no ids and decodes to the empty text.
    """
    check_separable(model)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model, table_bytes)
        yield from batches(((i, *chunks.digests(t or "")) for i, t in rows_of(incoming)), out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, out)
